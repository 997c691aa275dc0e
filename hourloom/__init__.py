"""Hourly campaign-spend analytics and 12-hour forecasting, as plain Spark jobs.

Every operator is a ``DataFrame -> DataFrame`` function, to be chained with
``df.transform``.  ``plans`` holds the composed jobs.
"""

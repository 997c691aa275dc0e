"""Incremental form of the ingest job: new page files since the last run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hourloom.schema import PAGE
from hourloom.sources.insights import explode_pages, flatten_insights


def stream_insights(spark: SparkSession, pages_dir: str, files_per_batch: int = 1000) -> DataFrame:
    """Flat facts as a stream over a directory where pages land."""
    pages = spark.readStream.schema(PAGE).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_per_batch).json(pages_dir)
    return flatten_insights(explode_pages(pages))


def ingest_new_pages(
    spark: SparkSession, pages_dir: str, output_path: str, checkpoint_path: str
) -> None:
    """Append the facts of pages not seen before, then stop."""
    query = (
        stream_insights(spark, pages_dir)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start(output_path)
    )
    query.awaitTermination()

"""Steps that line and sentence removal share: which rows are one document, and what is cut out of each.

A document is an identifier with a text: rows that share both are one document, rows that share one of them alone are not.
``doc_id`` and ``text_key`` tell documents apart.  A row without an identifier takes a hash of its text for one, below all
usual identifiers, so that such rows come first and spread like others; the lowest bit of the key says which rows these are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["doc_id", "text_key"]
#: Stands for a null identifier where rows need no telling apart.
NO_ID = -(1 << 63)


def key_columns(id_column: str = "doc_id", text_column: str = "text") -> list[Column]:
    """``doc_id`` and ``text_key`` of a row, both 64 bits and never null."""
    given = F.col(id_column).cast("long")
    no_text = F.col(text_column).isNull()  # a null text is not an empty one
    alone = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(text_column, no_text, F.lit("id")), 2)
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text_column, no_text), 1), 1)
    return [F.coalesce(given, alone).alias("doc_id"), high.bitwiseOR(given.isNull().cast("long")).alias("text_key")]


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, text_key, text."""
    return docs.select(*key_columns(id_column, text_column), F.col(text_column).alias("text"))


def attach(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Every row of docs with the array ``marks`` of its document, or null."""
    return docs.join(marks, KEY, "left")


def plain_id() -> Column:
    """The identifier as it was given."""
    return F.when(F.col("text_key").bitwiseAND(1) == 0, F.col("doc_id")).alias("doc_id")

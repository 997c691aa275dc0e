"""The corpus pipeline: documents in, a cleaned, deduplicated, mixed and tokenised corpus out.

Every stage works on all rows its predecessor kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.durable import scratch_path, stored
from hourloom.llm import mixing, near, pieces, quality, removal, templates
from hourloom.llm.queries import MIX_WEIGHTS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the model is fitted on the labelled rows."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs.select(*COLUMNS), model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates stay in the first document only, and n_chars is that of the new text.

    Documents of which no word is left go: all their lines stand in other documents.  Those that had no word before stay.
    """
    rows = docs.select(*[F.col(c).alias(f"row_{c}") for c in COLUMNS], *removal.key_columns())
    marks = templates.dropped_lines(removal.keyed(docs, "doc_id", "text"))
    shorter = F.expr(r"array_join(filter(split(row_text, '\n', -1), (x, i) -> not array_contains(marks, i)), '\n')")
    marked = removal.attach(rows, marks).withColumn("shorter", F.when(F.col("marks").isNotNull(), shorter))
    left = marked.where(r"shorter is null or shorter rlike '[^\\x20\\x09-\\x0D]'")
    n_chars = F.coalesce(F.length("shorter").cast("long"), F.col("row_n_chars"))
    return left.select("row_doc_id", F.coalesce("shorter", "row_text"), "row_lang", "row_source", n_chars).toDF(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that with the smallest doc_id (null last), then text key."""
    rows = near.near_groups(docs).where("root is not null").select("doc_id", "text_key", "root")
    texts = stored(rows.groupBy("doc_id", "text_key", "root").agg(F.count(F.lit(1)).alias("n")), "texts")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    firsts = texts.groupBy("root").agg(F.min(order).alias("first"))
    marks = texts.join(firsts, "root").select("doc_id", "text_key", "n", (order != F.col("first")).alias("gone")).where("gone or n > 1")
    marks = stored(marks.withColumnsRenamed({"doc_id": "marked_id", "text_key": "marked_key"}), "marks")
    keyed = docs.select(*COLUMNS).withColumn("text_key", near.text_key())
    same = F.col("doc_id").eqNullSafe(F.col("marked_id")) & F.col("text_key").eqNullSafe(F.col("marked_key"))
    once = keyed.join(marks, same, "left_anti").select(*COLUMNS)
    repeated = keyed.join(marks.where("not gone"), same, "left_semi")
    return once.unionByName(repeated.groupBy("doc_id", "text_key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in mixed order."""
    return mixing.in_order(mixing.mix(docs.select(*COLUMNS), MIX_WEIGHTS)).select(*COLUMNS)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every document, with its slot and place in the mixed order.

    The columns of documents can't carry the order, so it is taken again from the same rows, weights and hashes.
    """
    mixed = mixing.mix(docs.select("doc_id", "text", "source"), MIX_WEIGHTS).select("row.doc_id", "row.text", "source", "slot", "place")
    return pieces.sample_pieces(mixed, carried=["source", "slot", "place"])


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("piece encoding", pieces_stage),
]
# Classifier, signatures and sampling have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

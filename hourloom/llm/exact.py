"""Exact deduplication: a tree merge of sorted digest runs.

Every document becomes a digest record (64-bit sort key, SHA-256, byte length, identifier).
Records are dealt over ``leaves`` runs by a hash of the identifier, so that copies of one text
are spread evenly.  In each binomial round, runs whose numbers differ in the lowest bits meet: the
exchange deals them by (run, key) and sorts them, and one pass merges equal neighbours.  Two
records merge only where key, SHA-256 and length all agree; the larger identifier stays with the
sum of the counts.  After the last round there is one record for each text.  The winners then go
back down to the runs, and from the runs to the rows, so that no exchange ever holds more of one
text than one run does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.durable import stored
from hourloom.llm import spans

LEAVES_BITS = 6
ROUND_BITS = 2
_RECORD = ["run", "key", "sha", "size"]


def _digests(bits: int):
    schema = pa.schema([("doc_id", pa.int64()), ("run", pa.int32()), ("key", pa.int64()), ("sha", pa.binary()), ("size", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for c in spans.chunks(b.column(1)):
                lowered = spans.LOWER[c.data].tobytes()
                texts = [lowered[s:e] for s, e in zip(c.offsets[:-1], c.offsets[1:])]
                own = b.column(0).slice(c.first, c.rows)
                # Null identifiers share run 0.
                seed = np.nan_to_num(ids[c.first : c.first + c.rows].astype(np.float64), nan=0).astype(np.int64) if own.null_count else ids[c.first : c.first + c.rows]
                yield spans.batch(
                    {
                        "doc_id": own.cast(pa.int64()),
                        "run": (spans.mix(seed.astype(np.int64).view(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int32),
                        "key": np.array([xxhash.xxh3_64_intdigest(t) for t in texts], dtype=np.uint64).view(np.int64),
                        "sha": [hashlib.sha256(t).digest() for t in texts],
                        "size": np.diff(c.offsets),
                    },
                    schema,
                )

    return digest


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges equal neighbours of a sorted stream; only the last record is carried from batch to batch."""
    rest: pa.Table | None = None
    schema = None
    for b in batches:
        schema = b.schema
        table = pa.Table.from_batches([b])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        merged = table.group_by(_RECORD, use_threads=False).aggregate([("keep_id", "max"), ("n", "sum")])
        merged = merged.rename_columns([*_RECORD, "keep_id", "n"]).select(schema.names).cast(schema)
        rest = merged.slice(merged.num_rows - 1)
        yield from merged.slice(0, merged.num_rows - 1).to_batches()
    if rest is not None:
        yield from rest.to_batches()


def merge_round(runs: DataFrame, bits: int = ROUND_BITS) -> DataFrame:
    """One round: runs whose numbers agree but for the lowest ``bits`` become one."""
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        runs.withColumn("run", F.shiftright("run", bits))
        .repartition(parts, "run", "key")
        .sortWithinPartitions(*_RECORD)
        .mapInArrow(_merge, "run int, key bigint, sha binary, size bigint, keep_id bigint, n bigint")
    )


def exact_duplicates(docs: DataFrame, leaves_bits: int = LEAVES_BITS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z.  Null counts as empty, and empty texts
    equal each other.  The largest identifier of a group stays; null identifiers lose against all
    others.  Rows that repeat an identifier count each and share the verdict.  Other columns of the
    input are not looked at.  An empty table gives an empty result.
    """
    rows = stored(
        docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(
            _digests(leaves_bits), "doc_id bigint, run int, key bigint, sha binary, size bigint"
        ),
        "digests",
    )
    leaves = rows.groupBy(*_RECORD).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    runs = leaves
    for done in range(0, leaves_bits, ROUND_BITS):
        runs = merge_round(runs, min(ROUND_BITS, leaves_bits - done))
    winners = runs.select("key", "sha", "size", "keep_id", F.col("n").alias("group_size"))
    per_run = leaves.select(*_RECORD).join(winners, ["key", "sha", "size"])
    return rows.join(per_run, _RECORD).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )

"""How the sources of a language differ in their words, audited over a vocabulary kept as minimal acyclic transducers.

1. Terms and the documents of a language that have them are counted; terms of enough documents are kept.
2. Kept terms, sorted, become transducers: ranges of at most ``SHARD_TERMS`` terms, each built by the task that holds the
   range.  A term's ordinal is the number of terms of its language before it, in byte order.
3. The text is streamed through the transducers and recounted as counts of ordinals by language and source; no term leaves its task.
   Transducers are broadcast in lots of at most ``LOT_BYTES``; a vocabulary of more lots is recounted lot by lot.
4. Smoothed shares are compared between all sources of a language, block of ordinals by block, and with the language as a whole.
   Ties go by ordinal; only the terms reported are turned back into text.

Shares are whole numbers of a thousand millionth, so all arithmetic is exact.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hourloom.durable import scratch_path, stored
from hourloom.llm.transducer import Builder, Transducer

MIN_DOCUMENTS, TOP_TERMS = 10, 10
SHARD_TERMS, LOT_BYTES = 1 << 16, 64 << 20
RUN = 1 << 20  # bytes of one text looked at together
HELD_TERMS = 1 << 19  # different terms that a task counts before it hands them on
SALTS = 16
BLOCK_CELLS = 1 << 20  # (source, term) cells compared together
UNIT = 1_000_000_000
#: A-Z become a-z, other letters stay (every byte from 0x80 on is part of one), all else parts terms.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = "lang string, source string, block bigint, salt int, places array<int>, n array<bigint>"
_NAMES = [c.split()[0] for c in _COUNTS.split(", ")]
_KINDS = (pa.string(), pa.string(), pa.int64(), pa.int32())
_SHARD = "lang string, shard bigint, first binary, root int, size int, keys binary, targets binary, adds binary, final binary"


def _runs(text: pa.Scalar) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    data = text.as_buffer().to_pybytes().translate(_TERM) if text.is_valid else b""
    start = 0
    while start < len(data):
        stop = data.find(b" ", start + RUN)
        stop = len(data) if stop < 0 else stop
        yield data[start:stop].split()
        start = stop


def _documents_of_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, terms in counts.items():
            if terms:
                yield pa.record_batch([pa.array([lang] * len(terms)), pa.array(terms.keys(), pa.binary()), pa.array(terms.values(), pa.int64())], names=["lang", "term", "n"])
        counts.clear()

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(2)):
            terms: set[bytes] = set()
            for run in _runs(text):
                terms.update(run)
            counts[lang].update(terms)
            if sum(map(len, counts.values())) > HELD_TERMS:
                yield from out()
    yield from out()


def _rows(docs: DataFrame, lang_column: str, source_column: str, text_column: str) -> DataFrame:
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_column, "lang"), (source_column, "source"), (text_column, "text"))]
    return docs.select(*text)


def _build(shard_terms: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, lang, first, builder = TaskContext.get().partitionId() << 32, None, None, None

        def out() -> pa.RecordBatch:
            values = (lang, shard, first, *builder.done().parts())
            kinds = (pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
            return pa.record_batch([pa.array([v], t) for v, t in zip(values, kinds)], names=[c.split()[0] for c in _SHARD.split(", ")])

        for b in batches:
            for new, term in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if builder is None or new != lang or builder.size >= shard_terms:
                    if builder is not None:
                        yield out()
                        shard += 1
                    lang, first, builder = new, term, Builder()
                builder.add(term)
        if builder is not None:
            yield out()

    return build


def vocabulary(rows: DataFrame, min_documents: int = MIN_DOCUMENTS, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """Transducers of the kept terms of each language (a stored table); shards ascend with their terms."""
    counted = rows.mapInArrow(_documents_of_terms, "lang string, term binary, n bigint").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    kept = stored(counted.where(F.col("n") >= min_documents).select("lang", "term"), "terms")
    ordered = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return stored(ordered.mapInArrow(_build(shard_terms), _SHARD), "transducers")


class Range(NamedTuple):
    """A transducer, its first term and the ordinal of that."""

    first: bytes
    base: int
    transducer: Transducer


class Lot:
    """Some transducers by language."""

    def __init__(self, ranges: dict[str, list[Range]]):
        self.ranges = ranges

    def ordinals(self, lang: str, terms: list[bytes]) -> np.ndarray:
        """The ordinals of sorted terms, -1 for those that do not belong to the lot."""
        ranges, out = self.ranges.get(lang, []), np.full(len(terms), -1, dtype=np.int64)
        cuts = [*[bisect_left(terms, r.first) for r in ranges], len(terms)]
        for r, a, b in zip(ranges, cuts, cuts[1:]):
            found = r.transducer.ordinals(terms[a:b])
            out[a:b] = np.where(found >= 0, found + r.base, -1)
        return out


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def _recount(lot, width: int):
    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        salt = TaskContext.get().partitionId() % SALTS

        def out() -> Iterator[pa.RecordBatch]:
            for lang, sources in counts.items():
                terms = sorted(set().union(*sources.values()))
                ordinal = dict(zip(terms, lot.value.ordinals(lang, terms).tolist()))
                for source, met in sources.items():
                    ordinals = np.fromiter(map(ordinal.__getitem__, met), dtype=np.int64, count=len(met))
                    order = np.argsort(ordinals)[np.count_nonzero(ordinals < 0) :]
                    n = np.fromiter(met.values(), dtype=np.int64, count=len(met))[order]
                    ordinals = ordinals[order]
                    blocks, first = np.unique(ordinals // width, return_index=True)
                    if len(blocks):
                        bounds = np.append(first, len(ordinals))
                        keys = [pa.array([x] * len(blocks), t) for x, t in ((lang, pa.string()), (source, pa.string()))]
                        yield pa.record_batch([*keys, pa.array(blocks), pa.array([salt] * len(blocks), pa.int32()), _lists(ordinals % width, bounds, pa.int32()), _lists(n, bounds, pa.int64())], names=_NAMES)
            counts.clear()

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                mine = counts[lang][source]
                for run in _runs(text):
                    mine.update(run)
            if sum(len(c) for sources in counts.values() for c in sources.values()) > HELD_TERMS:
                yield from out()
        yield from out()

    return recount


def _sum_up(width: int):
    """Sums rows of the same key, which come one after the other; one block is held at a time."""

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, np.zeros(width, dtype=np.int64)

        def out() -> pa.RecordBatch:
            places = np.flatnonzero(sums)
            bounds = np.array([0, len(places)])
            return pa.record_batch([*[pa.array([v], t) for v, t in zip(key, _KINDS)], _lists(places, bounds, pa.int32()), _lists(sums[places], bounds, pa.int64())], names=_NAMES)

        for b in batches:
            keys = zip(*[b.column(i).to_pylist() for i in range(4)])
            for k, places, n in zip(keys, b.column(4), b.column(5)):
                if k != key:
                    if key is not None:
                        yield out()
                    key, sums[:] = k, 0
                sums[places.values.to_numpy()] += n.values.to_numpy()
        if key is not None:
            yield out()

    return sum_up


def _index(shards: DataFrame) -> DataFrame:
    """lang, shard, base (ordinal of the first term), size, bytes: a row for each shard."""
    upto = Window.partitionBy("lang").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("keys") + F.length("targets") + F.length("adds") + F.length("final")
    return shards.select("lang", "shard", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("base"), "size", size.alias("bytes"))


def lots(shards: DataFrame, lot_bytes: int = LOT_BYTES) -> list[dict[int, int]]:
    """Shard to base, for each lot: consecutive shards of ``lot_bytes`` together, or one larger shard."""
    out: list[dict[int, int]] = []
    held = lot_bytes
    for r in _index(shards).orderBy("lang", "shard").toLocalIterator():
        if not out or held + r.bytes > lot_bytes:
            out.append({})
            held = 0
        out[-1][r.shard] = r.base
        held += r.bytes
    return out


def recount(rows: DataFrame, shards: DataFrame, width: int = 4096, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """lang, source, block, places, n: occurrences of kept terms by source (a stored table), for blocks of ``width`` ordinals; terms that a source lacks have no place."""
    spark = rows.sparkSession
    path = scratch_path(spark, "parts")
    spark.createDataFrame([], _COUNTS).write.parquet(path)
    for lot in lots(shards, lot_bytes):
        ranges: dict[str, list[Range]] = defaultdict(list)
        # Of one lot: its bytes are counted above.
        for r in shards.where(F.col("shard").between(min(lot), max(lot))).orderBy("lang", "shard").toLocalIterator():
            ranges[r.lang].append(Range(bytes(r.first), lot[r.shard], Transducer.of(*r[3:])))
        shared = spark.sparkContext.broadcast(Lot(dict(ranges)))
        parts = rows.mapInArrow(_recount(shared, width), _COUNTS)
        # By salt, so that a source in all tasks is summed by several; then, over all lots, by source and block.
        _summed(parts, width).write.mode("append").parquet(path)
        shared.unpersist()
    return stored(_summed(spark.read.schema(_COUNTS).parquet(path).withColumn("salt", F.lit(0)), width), "counts")


def _summed(parts: DataFrame, width: int) -> DataFrame:
    key = ["lang", "source", "block", "salt"]
    return parts.repartition(*key).sortWithinPartitions(*key).mapInArrow(_sum_up(width), _COUNTS)


def _shares(n: np.ndarray, total: int, terms: int) -> np.ndarray:
    """Smoothed shares in units of a thousand millionth, rounded down, plus 1; in numbers of any length where 64 bits are too few."""
    wide = n if int(n.max(initial=0)) < (1 << 63) // UNIT - 2 else n.astype(object)
    return 1 + (UNIT * (wide + 2) // (total + 2 * terms)).astype(np.int64)


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _compare(top: int, width: int):
    def compare(block: pa.Table) -> pa.Table:
        """One block of ordinals of one language: the distances of all its sources, and each source's first terms."""
        block = block.sort_by("source")
        lang, number, terms = (block[c][0].as_py() for c in ("lang", "block", "terms"))
        sources, totals = block["source"].to_pylist(), block["total"].to_pylist()
        size = min(width, terms - number * width)
        counts = np.zeros((len(sources), max(size, 0)), dtype=np.int64)
        for mine, places, n in zip(counts, block["places"], block["n"]):
            if places.is_valid:
                mine[places.values.to_numpy()] = n.values.to_numpy()
        rows: list[tuple] = []
        sums = np.zeros((len(sources), len(sources)), dtype=np.int64)
        if size > 0:
            p = np.array([_shares(n, total, terms) for n, total in zip(counts, totals)])
            q = _shares(counts.sum(axis=0), sum(totals), terms)
            for i in range(len(sources)):
                sums[i, i + 1 :] = sums[i + 1 :, i] = _far(p[i], p[i + 1 :]).sum(axis=1)
                more = np.flatnonzero((counts[i] > 0) & (p[i] > q))
                value = _far(p[i, more], q[more])
                rows += [(sources[i], None, number * width + int(more[k]), int(value[k])) for k in np.lexsort((more, -value))[:top]]
        rows += [(sources[i], sources[j], None, int(sums[i, j])) for i in range(len(sources)) for j in range(len(sources)) if i != j]
        columns = list(zip(*rows)) or [[]] * 4
        kinds = {"source": pa.string(), "item": pa.string(), "ordinal": pa.int64(), "value": pa.int64()}
        return pa.table({"lang": pa.array([lang] * len(rows), pa.string()), **{name: pa.array(c, t) for c, (name, t) in zip(columns, kinds.items())}})

    return compare


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lang, base, wanted, *parts in zip(*[c.to_pylist() for c in b.columns]):
            transducer = Transducer.of(*parts)
            words = [transducer.word(o - base) for o in wanted]
            yield pa.record_batch([pa.array([lang] * len(wanted)), pa.array(wanted), pa.array(words, pa.binary())], names=["lang", "ordinal", "term"])


def source_divergence(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS, shard_terms: int = SHARD_TERMS, lot_bytes: int = LOT_BYTES,
    lang_column: str = "lang", source_column: str = "source", text_column: str = "text",
) -> DataFrame:
    """lang, source, part, item, value, rank.

    Null language, source and text count as empty ones.  Part ``pair``: each other source of the language and the summed distance of
    all kept terms (0 without any), all ranks.  Part ``term``: the ``top`` terms that a source has more of than its language.
    Rows that repeat count each; other columns are not looked at.  A language's only source has no pairs; an empty table gives no row.
    """
    rows = _rows(docs, lang_column, source_column, text_column)
    groups = stored(rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("documents")), "groups")
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    width = max(1, min(4096, BLOCK_CELLS // most))
    shards = vocabulary(rows, min_documents, shard_terms)
    counts = recount(rows, shards, width, lot_bytes)

    sizes = _index(shards).groupBy("lang").agg(F.sum("size").alias("terms"))
    in_block = F.aggregate("n", F.lit(0).cast("long"), lambda total, n: total + n)
    totals = counts.groupBy("lang", "source").agg(F.sum(in_block).alias("total"))
    known = groups.join(totals, ["lang", "source"], "left").join(sizes, ["lang"], "left")
    known = known.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    blocks = known.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"(terms - 1) div {width}"), F.lit(0)))))
    cells = blocks.join(counts, ["lang", "source", "block"], "left").select("lang", "source", "block", "total", "terms", "places", "n")
    # A block has at most BLOCK_CELLS counts, or one for each source.
    parts = stored(cells.groupBy("lang", "block").applyInArrow(_compare(top, width), "lang string, source string, item string, ordinal bigint, value bigint"), "compared")

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = parts.where("ordinal is null").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(by_value))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    best = parts.where("ordinal is not null").drop("item").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    wanted = best.select("lang", "ordinal").distinct().join(_index(shards).withColumnRenamed("lang", "of"), F.expr("lang = of and ordinal >= base and ordinal < base + size"))
    lists = wanted.groupBy("lang", "shard", "base").agg(F.sort_array(F.collect_set("ordinal")).alias("wanted"))
    words = lists.join(shards, ["lang", "shard"]).select("lang", "base", "wanted", "root", "size", "keys", "targets", "adds", "final").mapInArrow(_words, "lang string, ordinal bigint, term binary")
    terms = best.join(words, ["lang", "ordinal"]).withColumn("item", F.col("term").cast("string"))

    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.withColumn("part", F.lit("term")).select(columns))

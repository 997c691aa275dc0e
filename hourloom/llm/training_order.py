"""Training-order materialisation: token sequences in a keyed random order, in fixed-stride shards.

Texts are tokenised (a byte-pair vocabulary read from a file, a parameter) and packed, with an end mark after each document, into
sequences of ``length`` tokens within each task.  A sequence's index is its task's offset (prefix sums over one count
per task) plus its place in the task.  A keyed Feistel network over the smallest even number of bits that
holds all indexes, walked on until it falls among them, permutes the indexes to global slots: a bijection
that any task can compute alone.  Ranges of slots become shards; every record of a shard has the same number of bytes,
so slot s lies in shard s // shard_slots at byte (s % shard_slots) * stride, and reading can resume anywhere.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hourloom.durable import discard, scratch_path
from hourloom.llm import spans

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
LENGTH, SHARD_SLOTS, KEY, ROUNDS = 1024, 2048, 20240131, 6
RUN = 1 << 18  # characters tokenised together
BLOCK = 64  # sequences compressed together
MAX_HELD = 64 << 20  # bytes of sequences that a task holds while it fills blocks
_LEVEL = 6
_SPACE = re.compile(r"(?<=\S) (?=\S)")
_HEAD = np.dtype([("slot", "<i8"), ("first", "<i8"), ("last", "<i8"), ("n", "<i4")])  # first and last doc_id, number of tokens
_NO_ID = -(1 << 63)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def feistel(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    out = index.astype(np.uint64)
    walking = np.ones(len(out), dtype=bool)
    while walking.any():
        x = out[walking]
        left, right = x >> h, x & mask
        for r in range(ROUNDS):
            salt = spans.mix(np.array([key + r], dtype=np.uint64) * _GOLDEN)
            left, right = right, left ^ (spans.mix(right + salt) & mask)
        out[walking] = (left << h) | right
        walking = out >= np.uint64(n)
    return out.astype(np.int64)


class Tokens:
    """Token ids as bytes, two for each."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a text, in pieces.  A single space between two other characters always begins a token, so texts can be cut there."""
        start = 0
        while start < len(text):
            cut = _SPACE.search(text, start + RUN)
            stop = cut.start() if cut else len(text)
            yield np.array(self.coder.encode_ordinary(text[start:stop]), dtype=np.uint16).tobytes()
            start = stop


def _block(heads: np.ndarray, tokens: bytes) -> tuple[int, bytes, bytes]:
    """Sequences as one row: their number, their heads and their tokens, compressed together."""
    return len(heads), heads.tobytes(), zstandard.compress(tokens, _LEVEL)


def _pack(vocabulary, length: int):
    names = ["task", "place", "n", "heads", "packed"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    width = 2 * length

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task, place = Tokens(vocabulary.value), TaskContext.get().partitionId(), 0
        rest, owner = bytearray(), None  # tokens not yet in a block, and the document they begin with
        heads: list[tuple] = []  # of the full sequences at the beginning of rest

        def row() -> pa.RecordBatch:
            block = _block(np.array(heads, dtype=_HEAD), bytes(rest[: len(heads) * width]))
            return pa.record_batch([pa.array([v], t) for v, t in zip((task, place, *block), kinds)], names=names)

        doc = None
        for b in batches:
            for doc, text in zip(b.column(0).fill_null(_NO_ID).to_pylist(), b.column(1)):
                if owner is None:
                    owner = doc
                for ids in tokens.encode(text.as_py() or ""):
                    rest += ids
                rest += struct.pack("<H", END)
                while len(rest) >= (len(heads) + 1) * width:
                    heads.append((-1, owner, doc, length))
                    owner = doc if len(rest) > len(heads) * width else None
                    if len(heads) == BLOCK:
                        yield row()
                        del rest[: BLOCK * width]
                        place, heads = place + BLOCK, []
        left = len(rest) - len(heads) * width
        if left:
            heads.append((-1, owner, doc, left // 2))
            rest += b"\xff" * (width - left)
        if heads:
            yield row()

    return pack


def _place(n: int, key: int, shard_slots: int, parts: int, length: int):
    """Blocks of packed sequences to blocks of sequences that belong to one range of shards."""
    names, shards, width = ["part", "n", "heads", "packed"], -(-n // shard_slots), 2 * length

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list]] = {}
        held = 0

        def row(part: int) -> pa.RecordBatch:
            heads, tokens = waiting.pop(part)
            block = _block(np.array(heads, dtype=_HEAD), b"".join(tokens))
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array([v], t) for v, t in zip((part, *block), kinds)], names=names)

        for b in batches:
            for first, count, heads, packed in zip(*[c.to_pylist() for c in b.columns]):
                heads, tokens = np.frombuffer(heads, dtype=_HEAD).copy(), zstandard.decompress(packed)
                heads["slot"] = feistel(np.arange(first, first + count), n, key)
                at = heads["slot"] // shard_slots * parts // shards
                for i, part in enumerate(at.tolist()):
                    mine = waiting.setdefault(part, ([], []))
                    mine[0].append(heads[i])
                    mine[1].append(tokens[i * width : (i + 1) * width])
                    held += 1
                    if len(mine[0]) == BLOCK:
                        held -= BLOCK
                        yield row(part)
                if held * width > MAX_HELD:
                    for part in list(waiting):
                        yield row(part)
                    held = 0
        for part in list(waiting):
            yield row(part)

    return place


def _records(shard_slots: int, length: int):
    size = _HEAD.itemsize + 2 * length

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for heads, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                heads = np.frombuffer(heads, dtype=_HEAD)
                tokens = np.frombuffer(zstandard.decompress(packed), dtype=np.uint8).reshape(len(heads), -1)
                values = np.hstack([heads.view(np.uint8).reshape(len(heads), -1), tokens])
                bounds = pa.array(np.arange(len(heads) + 1, dtype=np.int32) * size)
                values = pa.Array.from_buffers(pa.binary(), len(heads), [None, bounds.buffers()[1], pa.py_buffer(values.tobytes())])
                slots = np.ascontiguousarray(heads["slot"])
                yield pa.record_batch([pa.array(slots // shard_slots), pa.array(slots), values], names=["shard", "slot", "value"])

    return records


def stride(length: int = LENGTH) -> int:
    """Bytes of a record: head, tokens, and the byte that ends it."""
    return _HEAD.itemsize + 2 * length + 1


def materialise(
    docs: DataFrame, path: str, length: int = LENGTH, shard_slots: int = SHARD_SLOTS, key: int = KEY, vocabulary_path: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text"
) -> int:
    """Writes the shards under ``path`` (shard=N/part-*) and returns the number of sequences.

    Null and empty texts give an end mark only; null identifiers are kept as such.  Rows are packed as they stand, repeated or not.  The last
    sequence of a task may be short: its head tells how many tokens count.  An empty table gives no shard.  Which documents
    share a sequence follows from how Spark splits the input; the order of sequences follows from the key.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Path(vocabulary_path).read_bytes())
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    table = scratch_path(spark, "sequences")
    schema = "task int, place bigint, n int, heads binary, packed binary"
    rows.mapInArrow(_pack(vocabulary, length), schema).write.option("compression", "none").parquet(table)
    blocks = spark.read.schema(schema).parquet(table)
    # One row for each task of the packing: few, whatever the data.
    per_task = blocks.groupBy("task").agg(F.sum("n").alias("n"))
    offsets = per_task.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    n = per_task.agg(F.sum("n")).first()[0] or 0
    # That table has a row for each task, so its size is known to be small.
    indexed = blocks.join(F.broadcast(offsets), "task").select((F.col("before") + F.col("place")).alias("first"), "n", "heads", "packed")
    # Slots are spread evenly, so ranges of shards are known beforehand and need no sampling.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = indexed.mapInArrow(_place(max(n, 1), key, shard_slots, parts, length), "part int, n int, heads binary, packed binary")
    ranged = placed.repartitionById(parts, "part").select("heads", "packed")
    records = ranged.mapInArrow(_records(shard_slots, length), "shard bigint, slot bigint, value binary").sortWithinPartitions("shard", "slot")
    # The text writer writes the bytes as they are and its separator after each record.
    records.select("shard", F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").partitionBy("shard").text(path)
    discard(spark, table)
    return n


def read_shards(spark: SparkSession, path: str, length: int = LENGTH, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(slot, shard, position, first_id, last_id, n_tokens, tokens) of all records, in slot order within each shard."""
    size, head = stride(length), _HEAD.itemsize
    names = ["slot", "shard", "position", "first_id", "last_id", "n_tokens", "tokens"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                raw = raw.as_buffer()
                for start in range(0, raw.size, 512 * size):
                    rows = []
                    for at in range(start, min(start + 512 * size, raw.size), size):
                        slot, first, last, n = struct.unpack("<qqqi", raw[at : at + head].to_pybytes())
                        ids = [None if x == _NO_ID else x for x in (first, last)]
                        rows.append((slot, slot // shard_slots, at // size, *ids, n, raw[at + head : at + head + 2 * n].to_pybytes()))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, "slot bigint, shard bigint, position bigint, first_id bigint, last_id bigint, n_tokens int, tokens binary")

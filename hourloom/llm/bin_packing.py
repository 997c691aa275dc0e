"""Packing documents into as few token sequences as possible, by minimum bin slack.

A document is its token ids and an end mark; longer ones than a sequence are cut into pieces of full length and a rest.
How pieces fill sequences depends on their lengths alone, so the search needs the number of pieces of each length and nothing
else: a table of at most ``length`` rows, whatever the corpus.  For each sequence the longest piece left is set, and a subset-sum
over bits of an integer (bit s: some pieces sum to s) finds the fullest combination of the others; of equally full ones that with the longest
pieces, so that short ones stay to fill later gaps.  A combination is taken as often as all of its lengths last, since
the search would find it again; every combination found uses up a length, so there are at most ``length`` of them.

Each piece then finds its place alone: its rank among the pieces of its length (its task's offset plus its place in the task)
falls into the stretch of ranks that one combination took.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections import Counter
from collections.abc import Collection, Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hourloom.durable import scratch_path

LENGTH, END = 4096, 1
RUN = 1 << 20  # bytes of text tokenised together
CACHE_WORDS, CACHE_BYTES = 1 << 19, 40  # words whose ids a worker remembers, and the longest such word
#: Characters beyond Latin and marks of special tokens; the vocabulary's pattern for all others, or a line end.
_FAR = re.compile(r"[^\x00-\u012f\u0131-\u017f]|<\|")
_LETTERS, _NUMBERS = "a-zªµºß-öø-ſ", "0-9²³¹¼½¾"
_PART = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\x09-\x0d\x20\x85\xa0{_LETTERS}{_NUMBERS}]+")
_BREAK = b"\xff" * 4
#: Byte-level vocabularies show each byte as a character: printable ones as themselves, the others from U+0100 on in order.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHOWN = {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
_HELD = 4 << 20  # bytes of ids in an Arrow batch
_PIECES = "task int, nth bigint, doc_id bigint, piece int, start bigint, length int, ids binary"


# ---------------------------------------------------------------- tokens


class Coder:
    """Token ids as bytes, little-endian, four each.

    No token of this vocabulary crosses a blank, and neither does its normalisation, so words between blanks are encoded alone and
    remembered.  Words of Latin letters, digits and signs (to U+017F: nothing there changes under composition) are split here as the vocabulary's
    own pattern does and go to its merges directly; all others go through the whole tokenizer.
    """

    def __init__(self, vocabulary: bytes, special_as_text: bool):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_buffer(vocabulary)
        self.whole.encode_special_tokens = special_as_text
        self.merges = self.whole.model
        self.words: dict[bytes, bytes] = {}
        self.parts = {"\n": _BREAK}

    def _merge(self, part: str) -> bytes:
        shown = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(_SHOWN)
        return array("I", [t.id for t in self.merges.tokenize(shown)]).tobytes()

    def _learn(self, words: list[bytes]) -> None:
        text = b"\n".join(words).decode()
        if _FAR.search(text):
            near = []
            for word in words:
                if _FAR.search(one := word.decode()):
                    self.words[word] = array("I", self.whole.encode(one, add_special_tokens=False).ids).tobytes()
                else:
                    near.append(word)
            words, text = near, b"\n".join(near).decode()
        parts = _PART.findall(text.lower())
        fresh = set(parts).difference(self.parts)
        for part in fresh:
            self.parts[part] = self._merge(part)
        self.words.update(zip(words, b"".join(map(self.parts.__getitem__, parts)).split(_BREAK)))
        _forget(self.parts, fresh)
        self.parts["\n"] = _BREAK

    def encode(self, text: bytes) -> Iterator[bytes]:
        """The ids of a text, in runs."""
        start = 0
        while start < len(text):
            stop = min(start + RUN, len(text))
            while stop < len(text) and text[stop] not in b" \t\n\r\x0b\x0c":
                stop += 1
            words = text[start:stop].split()
            new = list(set(words).difference(self.words))
            if new:
                self._learn(new)
            yield b"".join(map(self.words.__getitem__, words))
            _forget(self.words, new)
            start = stop


def _forget(known: dict, fresh: Collection) -> None:
    for long in [x for x in fresh if len(x) > CACHE_BYTES]:
        del known[long]
    if len(known) > CACHE_WORDS:
        known.clear()


@functools.lru_cache(maxsize=2)
def _coder(vocabulary: bytes, special_as_text: bool) -> Coder:
    return Coder(vocabulary, special_as_text)


def _cut(ids: Iterator[bytes], length: int, end: int) -> Iterator[bytes]:
    """The pieces of one document."""
    rest, width = bytearray(), 4 * length
    for run in ids:
        rest += run
        while len(rest) > width:
            yield bytes(rest[:width])
            del rest[:width]
    rest += end.to_bytes(4, "little")
    for at in range(0, len(rest), width):
        yield bytes(rest[at : at + width])


def _tokenise(vocabulary, length: int, end: int, special_as_text: bool):
    schema = pa.schema([("task", pa.int32()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids", pa.binary())])

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, seen = _coder(vocabulary.value, special_as_text), TaskContext.get().partitionId(), Counter()
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                start = 0
                for k, ids in enumerate(_cut(coder.encode(text.as_buffer().to_pybytes() if text.is_valid else b""), length, end)):
                    n = len(ids) // 4
                    rows.append((task, seen[n], doc, k, start, n, ids))
                    seen[n] += 1
                    start += n
                    held += len(ids)
                    if held >= _HELD:
                        yield out()
                        rows, held = [], 0
        if rows:
            yield out()

    return tokenise


def token_pieces(
    docs: DataFrame, vocabulary_path: str, length: int = LENGTH, end: int = END, special_as_text: bool = False, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per piece, written to the shared folder: doc_id, piece, start, length, ids (little-endian, four bytes each), and task and
    nth (place among the task's pieces of that length).

    Null and empty texts are an end mark alone.  Repeated and null identifiers are kept as they stand; other columns are not looked at.
    ``special_as_text``: names of special tokens in a text are ordinary text.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Path(vocabulary_path).read_bytes())
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    table = scratch_path(spark, "pieces")
    rows.mapInArrow(_tokenise(vocabulary, length, end, special_as_text), _PIECES).write.option("compression", "zstd").parquet(table)
    return spark.read.schema(_PIECES).parquet(table)


# ---------------------------------------------------------------- minimum bin slack


class Fill(NamedTuple):
    """``times`` sequences with the same pieces: (length, how many), longest first."""

    times: int
    parts: tuple[tuple[int, int], ...]


def fullest(available: list[tuple[int, int]], room: int) -> dict[int, int]:
    """How many of each length fill ``room`` best.  ``available``: (length, count), longest first."""
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # length, how many together, sums that could be had before
    full = 1 << room
    for size, count in available:
        left, together = min(count, room // size), 1
        while left > 0:
            k = min(together, left)
            steps.append((size, k, reach))
            reach |= (reach << (size * k)) & mask
            left, together = left - k, 2 * together
        if reach & full:
            break
    target, chosen = reach.bit_length() - 1, Counter()
    for size, k, before in reversed(steps):
        if not before >> target & 1:  # short lengths only where the longer ones don't do
            chosen[size] += k
            target -= size * k
    return chosen


def minimum_bin_slack(counts: dict[int, int], length: int = LENGTH) -> list[Fill]:
    """Sequences of ``length`` for all pieces; ``counts`` has the number of pieces by length."""
    if any(not 0 < size <= length for size in counts):
        raise ValueError(f"pieces have 1 to {length} tokens")
    left, fills = {k: counts[k] for k in sorted(counts, reverse=True) if counts[k]}, []
    while left:
        seed = next(iter(left))
        rest = [(size, n - (size == seed)) for size, n in left.items()]
        parts = fullest(rest, length - seed)
        parts[seed] += 1
        times = min(left[size] // n for size, n in parts.items())
        fills.append(Fill(times, tuple(sorted(parts.items(), reverse=True))))
        for size, n in parts.items():
            left[size] -= n * times
            if not left[size]:
                del left[size]
    return fills


# ---------------------------------------------------------------- places


class Places:
    """From (length, rank among the pieces of that length) to (sequence, offset)."""

    def __init__(self, fills: list[Fill]):
        taken, rows, sequence = Counter(), [], 0
        for times, parts in fills:
            offset = 0
            for size, n in parts:
                rows.append((size, taken[size], sequence, offset, n))
                taken[size] += n * times
                offset += n * size
            sequence += times
        self.sequences = sequence
        self.rows = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        self.keys = self._key(self.rows[:, 0], self.rows[:, 1])

    @staticmethod
    def _key(size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return (size.astype(np.int64) << 44) | rank

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, first, sequence, offset, n = self.rows[np.searchsorted(self.keys, self._key(size, rank), "right") - 1].T
        return sequence + (rank - first) // n, offset + (rank - first) % n * size


def place(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of ``pieces`` (with task, nth and length; all other columns stay) and their sequence_id and offset.

    Every sequence is filled without gaps from 0.  An empty table gives no row.  The table is read twice, so it must be a stored one.
    """
    spark = pieces.sparkSession
    clash = {"rank", "sequence_id", "offset", "_first"} & set(pieces.columns)
    if clash:
        raise ValueError(f"columns of these names are made here: {sorted(clash)}")
    per_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    # A window has a row for each task that has pieces of this length.
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    # At most ``length`` rows.
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(minimum_bin_slack(counts, length)))
    ranked = pieces.join(offsets, ["task", "length"]).withColumn("rank", F.col("_first") + F.col("nth"))
    kept = [c for c in pieces.columns]
    rows = ranked.select(*kept, "rank")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, ranks = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            found = places.value.find(sizes, ranks)
            yield pa.record_batch([*[b.column(i) for i in range(len(kept))], *[pa.array(x, pa.int64()) for x in found]], names=[*kept, "sequence_id", "offset"])

    schema = rows.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    return rows.mapInArrow(find, schema)


def sequences(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens, ids, and the documents in their order."""
    placed = place(pieces.select("task", "nth", "doc_id", "piece", "length", "ids"), length)
    # A group holds at most ``length`` pieces.
    ordered = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids", "length"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    total = F.aggregate("parts", F.lit(0), lambda acc, p: acc + p["length"])
    documents = F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset")))
    return ordered.select("sequence_id", total.alias("n_tokens"), joined.alias("ids"), documents.alias("documents"))


def pack(docs: DataFrame, vocabulary_path: str, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, vocabulary_path, length)
    slim = pieces.select("task", "nth", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return place(slim, length).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")

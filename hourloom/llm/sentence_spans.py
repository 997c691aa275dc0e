"""Substring deduplication by sliding sentence spans.

A sentence ends after a word that ends in one of .!? (closing quotes and brackets may follow) or at a line
break.  Every run of ``run`` consecutive sentences is hashed; where such a run is short, it is taken longer at
either end until it has ``min_words`` words, and fewer sentences than a run count alone if they have ``long_words``.
The hashes meet in one global aggregation, which keeps the first place of each (smallest doc_id, then
position); every other place is a repeated span, and all sentences that a repeated span covers are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.durable import stored
from hourloom.llm import spans
from hourloom.llm.removal import KEY, attach, keyed, plain_id

RUN, MIN_WORDS, LONG_WORDS = 2, 15, 25
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?")] = True
_CLOSE = np.zeros(256, dtype=bool)
_CLOSE[list(b"\"')]}")] = True


class Sentences:
    """Sentences of a chunk as ranges of its words."""

    def __init__(self, chunk: spans.Chunk):
        self.words = w = spans.Words(chunk)
        n = len(w.starts)
        last = w.data[w.ends - 1] if n else np.zeros(0, dtype=np.uint8)
        before = w.data[np.maximum(w.ends - 2, w.starts)] if n else last
        stop = _STOP[last] | (_CLOSE[last] & _STOP[before])
        breaks = np.concatenate([[0], np.cumsum(chunk.data == 10)])
        if n:
            stop[:-1] |= (breaks[w.starts[1:]] > breaks[w.ends[:-1]]) | (w.rows[1:] != w.rows[:-1])
            stop[-1] = True
        self.ends = np.flatnonzero(stop) + 1
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)[: len(self.ends)]
        self.rows = w.rows[self.starts] if len(self.starts) else np.zeros(0, dtype=np.int64)
        self.bounds = np.searchsorted(self.rows, np.arange(chunk.rows + 1))

    def runs(self, run: int, min_words: int, long_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) sentences of all spans."""
        n = len(self.starts)
        own = np.arange(n)
        ends = np.append(self.starts, self.ends[-1:])  # words before sentence i
        low, high = self.bounds[self.rows], self.bounds[self.rows + 1] - 1
        # The shortest run from i onwards and the shortest one up to i that have enough sentences and words.
        onwards = np.maximum(own + run - 1, np.searchsorted(ends, ends[own] + min_words, "left") - 1)
        upto = np.minimum(own - run + 1, np.searchsorted(ends, ends[own + 1] - min_words, "right") - 1)
        parts = [(own[onwards <= high], onwards[onwards <= high]), (upto[upto >= low], own[upto >= low])]
        for k in range(1, run):
            last = own + k - 1
            ok = last <= high
            ok[ok] = ends[last[ok] + 1] - ends[own[ok]] >= long_words
            parts.append((own[ok], last[ok]))
        both = np.unique(np.stack([np.concatenate([p[k] for p in parts]) for k in (0, 1)]), axis=1) if n else np.zeros((2, 0), dtype=np.int64)
        return both[0], both[1]


def _scan(run: int, min_words: int, long_words: int):
    schema = pa.schema([("span", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("place", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            for c in spans.chunks(b.column(2)):
                s = Sentences(c)
                low, high = s.runs(run, min_words, long_words)
                if len(low):
                    rows = s.rows[low]
                    shift = s.bounds[rows]
                    hashes = spans.prefix_hashes(s.words.hashes(), s.starts[low], s.ends[high])
                    place = ((low - shift) << 32) + (high - shift)
                    yield spans.batch({"span": hashes.view(np.int64), "doc_id": ids[c.first + rows], "text_key": keys[c.first + rows], "place": place}, schema)

    return scan


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_key", "text", "n_sentences", "n_removed", "removed"]
    for b in batches:
        for c in spans.chunks(b.column(2)):
            s = Sentences(c)
            marks = b.column(3).slice(c.first, c.rows).to_pylist()
            nulls = b.column(2).slice(c.first, c.rows).is_null().to_numpy(zero_copy_only=False)
            texts, counts, removed = [], np.diff(s.bounds), []
            for i, own in enumerate(marks):
                raw, at = c.text(i), int(c.offsets[i])
                gone = np.zeros(counts[i] + 1, dtype=np.int64)
                for place in own or ():
                    low, high = place >> 32, place & 0xFFFFFFFF
                    if high < counts[i]:
                        gone[low] += 1
                        gone[high + 1] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                ranges = list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))
                kept, done = [], 0
                for low, high in ranges:
                    first = s.bounds[i] + low
                    kept.append(raw[done : int(s.words.starts[s.starts[first]]) - at])
                    after = s.bounds[i] + high + 1
                    done = int(s.words.starts[s.starts[after]]) - at if high + 1 < counts[i] else len(raw)
                kept.append(raw[done:])
                texts.append(None if nulls[i] else b"".join(kept).decode())
                removed.append([{"low": x, "high": y} for x, y in ranges])
            yield pa.record_batch(
                [*[b.column(k).slice(c.first, c.rows) for k in (0, 1)], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array([sum(r["high"] - r["low"] + 1 for r in x) for x in removed], pa.int64()), pa.array(removed, pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))],
                names=names,
            )


def repeated_spans(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, text_key, marks): all non-first places of repeated spans, for documents that have any; docs: doc_id, text_key, text.

    A place is its first sentence, shifted by 32 bits, plus its last one.  First places are stored, so that the join
    stands alone in its stage and a span that very many documents have is divided between tasks at run time.
    """
    found = stored(docs.mapInArrow(_scan(run, min_words, long_words), "span bigint, doc_id bigint, text_key bigint, place bigint"), "spans")
    here = F.struct(*KEY, "place")
    firsts = found.groupBy("span").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = stored(firsts.select("span", "first"), "first-places")
    again = found.join(firsts, "span").where(here != F.col("first"))
    return again.groupBy(*KEY).agg(F.collect_set("place").alias("marks"))


def remove_repeated_spans(
    docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: doc_id, text without repeated spans, n_sentences, n_removed, removed.

    ``removed`` lists the (low, high) ranges of removed sentences.  Comparison ignores the case of A-Z and the
    amount of white space between words.  Texts shorter than a run have no span; null stays null and has no sentence.
    Rows without a doc_id come first, in an order by their texts.  Rows that share doc_id and text are one document, and its first
    place stays in each of them; rows that share a doc_id alone are judged each on its own text.  Other columns are not looked at.
    """
    docs = keyed(docs, id_column, text_column)
    marked = attach(docs, repeated_spans(docs, run, min_words, long_words))
    schema = "doc_id bigint, text_key bigint, text string, n_sentences bigint, n_removed bigint, removed array<struct<low:int,high:int>>"
    return marked.mapInArrow(_cut, schema).select(plain_id(), "text", "n_sentences", "n_removed", "removed")

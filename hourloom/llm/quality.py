"""Quality rules: counting rules, then a calibrated logistic regression on hashed n-grams.

Features are the words (A-Z lower-cased) and the character bigrams and 4-grams of the whole text, hashed to
2**16 buckets each; a row's score is an intercept plus the mean weight of its n-grams of each kind.
The regression is fitted on labelled rows, of which ``max_labelled`` at most are taken, in
the order of a hash of their identifier; one row in five is held out, and a logistic curve through
its scores turns scores into probabilities.  Scoring runs over Arrow batches of all rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm import spans

MAX_LABELLED = 3000
THRESHOLD = 0.5
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 20, 30, 8
BITS = 16
GRAMS = (2, 4)
_KINDS = 1 + len(GRAMS)
_STEPS, _RATE, _RIDGE = 150, 0.5, 1e-4

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_CONTINUED = (np.arange(256) & 0xC0) == 0x80


@dataclass
class Model:
    """``weights``: one row for each kind of n-gram.  Probability: 1 / (1 + exp(-(slope * score + shift)))."""

    weights: np.ndarray
    intercept: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, score: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * score + self.shift)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, weights=self.weights.astype(np.float32), rest=np.array([self.intercept, self.slope, self.shift]))
        return out.getvalue()

    @staticmethod
    def from_bytes(raw: bytes) -> Model:
        with np.load(io.BytesIO(raw)) as x:
            return Model(x["weights"], *map(float, x["rest"]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def ngrams(chunk: spans.Chunk, words: spans.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind, the buckets of all n-grams of the chunk and the bounds of each row's."""
    shift = np.uint64(64 - BITS)
    out = [((words.hashes() >> shift).astype(np.int64), words.bounds)]
    points = np.frombuffer(chunk.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    firsts = np.concatenate([[0], np.cumsum(~_CONTINUED[chunk.data])])[chunk.offsets]
    for n in GRAMS:
        count = np.maximum(np.diff(firsts) - n + 1, 0)
        h = np.zeros(max(len(points) - n + 1, 0), dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0x2545F4914F6CDD1D) + points[k : k + len(h)]
        buckets = ((h * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
        if len(buckets) and chunk.rows > 1:
            inside = np.ones(len(points), dtype=bool)
            for k in range(1, n):  # n-grams that reach into the next row
                edge = firsts[1:] - k
                inside[edge[(edge >= firsts[:-1])]] = False
            buckets = buckets[inside[: len(buckets)]]
        out.append((buckets, np.concatenate([[0], np.cumsum(count)])))
    return out


def _means(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    n = np.diff(bounds)
    return (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(n, 1)


def scores(model: Model, grams: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return model.intercept + sum(_means(model.weights[k][buckets], bounds) for k, (buckets, bounds) in enumerate(grams))


def base_counts(chunk: spans.Chunk, raw: spans.Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """The counting rules; ``hashes``: of the words as they stand, one for each."""
    rows = chunk.rows
    letters = np.concatenate([[0], np.cumsum(~_CONTINUED[chunk.data] & ~spans.SPACE[chunk.data])])[chunk.offsets]
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[chunk.data])])[chunk.offsets]
    windows, at = raw.windows(hashes, WINDOW)
    keyed = windows + spans.mix(raw.rows[at].astype(np.uint64) + np.uint64(1))
    _, inverse, count = np.unique(keyed, return_inverse=True, return_counts=True)
    first = at[count[inverse.ravel()] > 1]
    edges = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, first + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edges[:-1]) > 0)])
    repeated_lines = np.zeros(rows, dtype=np.int64)
    for i in np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(chunk.data == 10)])[chunk.offsets])):
        lines = [x for x in chunk.text(i).split(b"\n") if x.strip(b" \t\n\v\f\r")]
        repeated_lines[i] = len(lines) - len(set(lines))
    return {
        "n_words": raw.counts,
        "word_chars": np.diff(letters),
        "n_symbols": np.diff(symbols),
        "n_dup_lines": repeated_lines,
        "n_repeat_words": covered[raw.bounds[1:]] - covered[raw.bounds[:-1]],
    }


# ---------------------------------------------------------------- training

_EXAMPLE = "doc_id bigint, label int, kinds array<int>, buckets array<int>, shares array<float>"


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in spans.chunks(b.column(2)):
            grams = ngrams(c, spans.Words(c))
            kinds, buckets, shares = [], [], []
            for i in range(c.rows):
                parts = [np.unique(v[e[i] : e[i + 1]], return_counts=True) for v, e in grams]
                kinds.append(np.concatenate([np.full(len(u), k, dtype=np.int32) for k, (u, _) in enumerate(parts)]))
                buckets.append(np.concatenate([u for u, _ in parts]).astype(np.int32))
                shares.append(np.concatenate([n / max(n.sum(), 1) for _, n in parts]).astype(np.float32))
            yield pa.record_batch(
                [b.column(0).slice(c.first, c.rows), b.column(1).slice(c.first, c.rows), *[pa.array(x, pa.list_(t)) for x, t in ((kinds, pa.int32()), (buckets, pa.int32()), (shares, pa.float32()))]],
                names=["doc_id", "label", "kinds", "buckets", "shares"],
            )


def fit(ids: np.ndarray, labels: np.ndarray, features: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """Fits the regression (full-batch Adam) on four rows in five and the calibration on the fifth.

    ``features``: for each row its places in the flattened weights and their shares.  With no rows the
    probability is one; with one class only it is that class's, softened.
    """
    size = _KINDS << BITS
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(labels) + 1)
        return Model(np.zeros((_KINDS, 1 << BITS), dtype=np.float32), 0.0, 1.0, float(np.log(share / max(1 - share, 1e-9))))
    held = spans.mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(5) == 0
    if held.all() or not held.any() or len(set(labels[~held])) < 2:
        held = np.zeros(len(labels), dtype=bool)
    rows = np.repeat(np.arange(len(labels)), [len(p) for p, _ in features])
    places, shares = np.concatenate([p for p, _ in features]), np.concatenate([s for _, s in features]).astype(np.float64)
    trained = ~held[rows]
    r, p, s = rows[trained], places[trained], shares[trained]
    weights, bias = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    n = int((~held).sum())
    for t in range(1, _STEPS + 1):
        miss = np.where(held, 0, _sigmoid(np.bincount(r, s * weights[p], len(labels)) + bias) - labels)
        g = np.bincount(p, s * miss[r], size) / n + _RIDGE * weights / n
        gb = miss.sum() / n
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        weights -= _RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        bias -= _RATE * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    score = np.bincount(rows, shares * weights[places], len(labels)) + bias
    use = held if held.any() and len(set(labels[held])) == 2 else np.ones(len(labels), dtype=bool)
    slope, shift = _calibration(score[use], labels[use])
    return Model(weights.reshape(_KINDS, -1).astype(np.float32), float(bias), slope, shift)


def _calibration(score: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic curve through held-out scores, with softened targets, by Newton steps."""
    good = labels.sum()
    target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (len(labels) - good + 2))
    scale = max(float(np.abs(score).mean()), 1e-6)
    x = np.stack([score / scale, np.ones(len(score))])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(w @ x)
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), x @ (p - target) + 1e-3 * w)
        w -= np.clip(step, -2, 2)
    return float(w[0] / scale), float(w[1])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in zip(*[b.column(k).to_numpy(zero_copy_only=False) for k in range(5)])]
    rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
    ids, labels = np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)
    model = fit(ids, labels, [((r[2].astype(np.int64) << BITS) | r[3], r[4]) for r in rows])
    yield pa.record_batch([pa.array([model.to_bytes()], pa.binary())], names=["model"])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """The model from at most ``max_labelled`` labelled rows; rows without identifier or label are left out."""
    sample = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    # The sample is bounded by max_labelled, so it can be broadcast.
    rows = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    found = rows.mapInArrow(_examples, _EXAMPLE).repartition(1).mapInArrow(_train, "model binary").first()
    return Model.from_bytes(bytes(found["model"])) if found else fit(np.zeros(0), np.zeros(0), [])


# ---------------------------------------------------------------- scoring

_VERDICT = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, probability double, kept boolean"
)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its counts, ``base_failed``, the probability of good quality, and ``kept``.

    Null or blank texts have no words and fail the base rules.  Identifiers may be null or repeated: rows
    are judged each on its own.  Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.to_bytes())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.from_bytes(shared.value)
        for b in batches:
            for c in spans.chunks(b.column(1)):
                words = spans.Words(c)
                raw = spans.span_hashes(c.data, words.starts, words.ends)
                counts = base_counts(c, words, raw)
                failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEATED_PERCENT * counts["n_words"])
                likely = own.probability(scores(own, ngrams(c, words)))
                yield pa.record_batch(
                    [b.column(0).slice(c.first, c.rows), *[pa.array(x, pa.int64()) for x in counts.values()], pa.array(failed), pa.array(likely), pa.array(~failed & (likely >= threshold))],
                    names=["doc_id", *counts, "base_failed", "probability", "kept"],
                )

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(judge, _VERDICT)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Trains on the labelled rows and judges every document."""
    return score(docs, train(docs, labels, max_labelled), threshold)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, that pass the counting rules and the model."""
    shared = docs.sparkSession.sparkContext.broadcast(model.to_bytes())
    at = docs.columns.index(text_column)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.from_bytes(shared.value)
        for b in batches:
            for c in spans.chunks(b.column(at)):
                words = spans.Words(c)
                counts = base_counts(c, words, spans.span_hashes(c.data, words.starts, words.ends))
                good = (counts["n_words"] >= MIN_WORDS) & (100 * counts["n_repeat_words"] <= MAX_REPEATED_PERCENT * counts["n_words"])
                good &= own.probability(scores(own, ngrams(c, words))) >= threshold
                yield b.slice(c.first, c.rows).filter(pa.array(good))

    return docs.mapInArrow(passing, docs.schema)

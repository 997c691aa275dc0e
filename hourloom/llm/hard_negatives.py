"""Hard negatives by secondary sort.

Rows stream past lots of anchors (broadcast, at most ``LOT_BYTES`` each), in blocks.  A task keeps, for each anchor, what can still be part
of the answer: first its nearest rows of the same label, which give the positives; then, with the positives' scores known, the first
rows of other labels under each of them.  Positives and negatives then meet in one shuffle, dealt by anchor and sorted within partitions by
(anchor, descending score, positives first, id): an iterator reads them as they come, opens a window at each positive, gives the negatives
that follow to all open windows, and closes a window when it is full or the score has fallen too low.  No anchor's rows are ever held together.

Components are whole numbers (256 times the value, rounded down), so scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.durable import scratch_path, stored
from hourloom.llm.removal import NO_ID

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
LEAST, MOST = 80, 100  # a negative's score in hundredths of the positive's
LOT_BYTES = 16 << 20
TILE = 1 << 21  # scores computed together
_FOUND = "anchor bigint, anchor_id bigint, score bigint, negative boolean, id bigint, row bigint"


def usable(rows: DataFrame, id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding") -> DataFrame:
    """row, id, label, vector: the rows that take part, numbered (a stored table).  Vectors are scaled, rounded down and packed."""
    vector, long = F.col(vector_column), F.col(label_column).cast("long")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    plain = rows.where(long.isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"), long.alias("label"), F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("vector")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [v.values.to_numpy() for v in b.column(3)]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array([v.astype("<i8").tobytes() for v in values], pa.binary())], names=["row", "id", "label", "vector"])

    # The work grows with the square of the bytes, so more tasks share it than bytes alone would make.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(plain.mapInArrow(pack, "row bigint, id bigint, label bigint, vector binary").repartition(parts, "row"), "vectors")


# ---------------------------------------------------------------- scores


def _matrix(vectors: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows; shorter ones count as filled up with zeros."""
    sizes = np.array([len(v) // 8 for v in vectors])
    if len(vectors) and (sizes == width).all():
        return np.frombuffer(b"".join(vectors), dtype="<i8").reshape(-1, width)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for row, v in zip(out, vectors):
        row[: len(v) // 8] = np.frombuffer(v, dtype="<i8")
    return out


def _product(exact_in_floats: bool):
    """Inner products of whole numbers.  Doubles hold every sum below 2^53 exactly, and multiply faster."""
    if exact_in_floats:
        return lambda a, b: (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return lambda a, b: a @ b.T


def _firsts(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each owner: by descending score, then id, then row number."""
    order = np.lexsort((rows, ids, -score, owner))
    starts = np.searchsorted(owner[order], owner[order])
    return order[np.arange(len(order)) - starts < k]


class Anchors:
    """A lot of anchors and the best rows a task has met so far: for each anchor, or for each of its windows."""

    def __init__(self, table: dict[str, list], width: int, k: int, windows: bool, product):
        self.row, self.id, self.label = (np.array(table[c], dtype=np.int64) for c in ("row", "id", "label"))
        self.vectors, self.k, self.windows, self.product = _matrix(table["vector"], width), k, windows, product
        low = table["low"] if windows else [[0]] * len(self.row)
        self.owner = np.repeat(np.arange(len(self.row)), [len(x) for x in low])  # anchor of each window
        self.high = np.array([s for x in low for s in x], dtype=np.int64)
        self.best = np.zeros((4, 0), dtype=np.int64)  # window, score, id, row
        self.bar = np.full(len(self.owner), np.iinfo(np.int64).min)  # a row below this can't come among the first k

    def meet(self, row: np.ndarray, ids: np.ndarray, label: np.ndarray, vectors: np.ndarray) -> None:
        step = max(1, TILE // max(1, len(row)))
        for a in range(0, len(self.row), step):
            scores = self.product(self.vectors[a : a + step], vectors)
            same = self.label[a : a + step, None] == label[None, :]
            first, last = np.searchsorted(self.owner, [a, a + step])
            if not self.windows:
                hit = same & (self.row[a : a + step, None] != row[None, :]) & (scores >= self.bar[first:last, None])
                window, at = np.nonzero(hit)
                self._add(window + first, scores[window, at], ids[at], row[at])
                continue
            for nth in range(int(np.bincount(self.owner[first:last] - a).max(initial=0))):
                # The nth window of each anchor of the tile.
                starts = np.searchsorted(self.owner, np.arange(a, min(a + step, len(self.row))))
                mine = starts + nth
                has = (mine < len(self.owner)) & (self.owner[np.minimum(mine, len(self.owner) - 1)] == np.arange(a, a + len(mine)))
                mine = mine[has]
                part, high = scores[has], self.high[mine, None]
                hit = ~same[has] & (part <= high) & (part >= self.bar[mine, None]) & (LEAST * high <= MOST * part)
                window, at = np.nonzero(hit)
                self._add(mine[window], part[window, at], ids[at], row[at])

    def _add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        if not len(window):
            return
        touched = np.unique(window)
        kept = np.isin(self.best[0], touched)
        all_of = np.concatenate([self.best[:, kept], np.stack([window, score, ids, row])], axis=1)
        all_of = all_of[:, _firsts(all_of[1], all_of[2], all_of[3], all_of[0], self.k)]
        self.best = np.concatenate([self.best[:, ~kept], all_of], axis=1)
        full, n = np.unique(all_of[0], return_counts=True)
        lowest = np.minimum.reduceat(all_of[1], np.append(0, np.cumsum(n)[:-1]))
        self.bar[full[n == self.k]] = lowest[n == self.k]

    def found(self) -> pa.RecordBatch:
        window, score, ids, row = self.best
        anchor = self.owner[window]
        if self.windows and len(window):  # one row may be among the first of several windows
            _, at = np.unique(np.stack([anchor, row]), axis=1, return_index=True)
            anchor, score, ids, row = anchor[at], score[at], ids[at], row[at]
        columns = [self.row[anchor], self.id[anchor], score, np.full(len(anchor), self.windows), ids, row]
        return pa.record_batch([pa.array(c) for c in columns], names=[c.split()[0] for c in _FOUND.split(", ")])


def _score(lot, width: int, k: int, windows: bool, exact_in_floats: bool):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(lot.value, width, k, windows, _product(exact_in_floats))
        for b in batches:
            row, ids, label = (b.column(i).to_numpy() for i in range(3))
            anchors.meet(row, ids, label, _matrix(b.column(3).to_pylist(), width))
        yield anchors.found()

    return score


def _nearest(vectors: DataFrame, anchors: DataFrame, n_anchors: int, width: int, k: int, windows: bool, exact_in_floats: bool, lot_bytes: int) -> DataFrame:
    """Of each task, the rows that can be among the first k of an anchor or a window (a stored table)."""
    spark, path = vectors.sparkSession, scratch_path(vectors.sparkSession, "nearest")
    lots = -(-n_anchors * max(width, 1) * 8 // lot_bytes)
    for nth in range(lots):
        table: dict[str, list] = {c: [] for c in anchors.columns}
        for r in anchors.where(F.pmod(F.xxhash64("row"), F.lit(lots)) == nth).toLocalIterator():
            for c in table:
                table[c].append(bytes(r[c]) if c == "vector" else r[c])
        shared = spark.sparkContext.broadcast(table)
        vectors.mapInArrow(_score(shared, width, k, windows, exact_in_floats), _FOUND).write.mode("append").parquet(path)
        shared.unpersist()
    return spark.read.schema(_FOUND).parquet(path)


# ---------------------------------------------------------------- secondary sort


def _in_order(found: DataFrame) -> DataFrame:
    """The sort key: anchor, descending score, positives before negatives, then id; row numbers settle repeated ids."""
    key = F.struct("anchor", (-F.col("score")).alias("below"), "negative", "id", "row")
    return found.select(key.alias("key"), "anchor_id").repartition("key.anchor").sortWithinPartitions("key")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, bool, int | None, int], int | None]]:
    for b in batches:
        key = b.column(0)
        yield from zip(zip(*[key.field(i).to_pylist() for i in range(5)]), b.column(1).to_pylist())


def _first_positives(k: int):
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, n, out = None, 0, []
        for (own, below, _, id_, row), anchor_id in _stream(batches):
            n = n + 1 if own == anchor else 1
            anchor = own
            if n <= k:
                out.append((own, anchor_id, -below, False, id_, row))
            if len(out) >= 4096:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return pick


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _FOUND.split(", ")])


def _windows(k: int):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows, out = None, [], []  # windows: [positive_id, positive score, negatives so far]
        for (own, below, negative, id_, _), anchor_id in _stream(batches):
            if own != anchor:
                anchor, windows = own, []
            if not negative:
                windows.append([id_, -below, 0])
                continue
            windows = [w for w in windows if w[2] < k and LEAST * w[1] <= MOST * -below]
            for w in windows:
                if w[1] >= -below:
                    w[2] += 1
                    out.append((anchor_id, w[0], w[2], id_, w[1], -below))
            if len(out) >= 4096:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return walk


def hard_negatives(
    rows: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding", lot_bytes: int = LOT_BYTES
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor``: a condition on ``id``.  Rows with a null label or vector, or a null or non-finite component, take no part.  Each row is one of its own:
    rows that repeat an identifier are other rows, and ties between them are settled by their order of reading.  Rows with a null identifier
    are no anchors and come first in ties.  Vectors of different lengths count as filled up with zeros.  Other columns are not looked at.  An
    empty table, or one without anchors, gives no row.  Vectors whose scores may exceed 2^56 are an error.
    """
    vectors = usable(rows, id_column, label_column, vector_column)
    names = {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    schema = ", ".join(f"{c} {t}" for c, t in names.items())
    anchors = vectors.where((F.col("id") != NO_ID) & is_anchor)
    n = anchors.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    width, bound = _bounds(vectors)
    if bound >= 1 << 56:
        raise ValueError("scores of these vectors can exceed 2^56")
    floats = bound < 1 << 53
    near = _nearest(vectors, anchors, n, width, positives, False, floats, lot_bytes)
    chosen = stored(_in_order(near).mapInArrow(_first_positives(positives), _FOUND), "positives")
    low = chosen.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_set("score")).alias("low"))
    far = _nearest(vectors, anchors.join(low, "row"), n, width, negatives, True, floats, lot_bytes)
    found = _in_order(chosen.unionByName(far)).mapInArrow(_windows(negatives), schema)
    return found.select(*[F.nullif(c, F.lit(NO_ID)).alias(c) if c in ("positive_id", "negative_id") else c for c in names])


def _bounds(vectors: DataFrame) -> tuple[int, int]:
    """The longest vector, and what no score exceeds: the largest sum of squares."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, most = 0, 0.0
        for b in batches:
            for v in b.column(0):
                v = np.frombuffer(v.as_buffer(), dtype="<i8").astype(np.float64)
                width, most = max(width, len(v)), max(most, float(v @ v))
        yield pa.record_batch([pa.array([width], pa.int32()), pa.array([most])], names=["width", "most"])

    found = vectors.select("vector").mapInArrow(measure, "width int, most double").agg(F.max("width"), F.max("most")).first()
    return found[0], int(min(found[1] * 1.000001 + 1, 2.0**63))

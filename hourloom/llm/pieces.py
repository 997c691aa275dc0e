"""SentencePiece encoding with sampled segmentations, and lossless decoding.

The piece vocabulary comes from a model file (a parameter).  Over the lattice of all pieces that match a text,
a forward pass sums the probabilities of all segmentations up to each place, and a backward pass samples from the end,
choosing among the pieces that end at a place in proportion to the mass they bring.  Random numbers are
a hash of (seed, row key, place), so that a row's segmentation depends on nothing else.  Spaces become
the escape mark U+2581, with which pieces may only begin; so the lattice falls apart into units
between spaces, and equal units of a chunk share one forward pass.  Characters without a piece, and U+2581 itself,
go to byte pieces, so decoding gives the text back byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm import spans

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED, TEMPERATURE = 17, 3.0
SLICE_POINTS = 1 << 19
#: Tables of piece hashes have 2 ** SLOT_BITS places and stay in the cache of a core.
SLOT_BITS = 20
_MARK, _LITERAL_MARK, _BREAK = 0x2581, 0x110000, 10
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Pieces:
    """The vocabulary: weights by rank (p ~ (rank + 10) ** -1/temperature) and tables for matching and decoding."""

    def __init__(self, model: bytes, temperature: float = TEMPERATURE):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        self.raw: list[bytes] = [b""] * n
        self.byte_ids = np.zeros(256, dtype=np.int32)
        by_length: dict[int, list[tuple[int, int]]] = {}
        rank = 0
        self.weights = np.zeros(n)
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if "▁" in piece.lstrip("▁") or "\n" in piece:
                    raise ValueError(f"piece {i} has an escape mark or a line break inside")
                self.raw[i] = piece.replace("▁", " ").encode()
                self.weights[i] = -np.log(rank + 10) / temperature
                by_length.setdefault(len(piece), []).append((i, rank))
                rank += 1
        self.byte_weight = -np.log(2 * (rank + 10)) / temperature
        ids = [i for rows in by_length.values() for i, _ in rows]
        texts = [np.array([ord(c) for c in sp.id_to_piece(i)], dtype=np.uint64) for i in ids]
        flat, lengths = np.concatenate(texts), np.array([len(t) for t in texts])
        ends = np.cumsum(lengths)
        hashes = spans.prefix_hashes(flat, ends - lengths, ends)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(ids, dtype=np.int32)[order]
        self.longest = int(lengths.max())
        self.maybe = np.zeros(1 << SLOT_BITS, dtype=bool)
        self.maybe[_slot(hashes)] = True
        # Pieces of a slot lie next to each other, since slots are the first bits of the sorted hashes.
        self.first, slots = np.zeros(1 << SLOT_BITS, dtype=np.int32), _slot(self.hashes)
        self.first[slots[::-1]] = np.arange(len(slots), dtype=np.int32)[::-1]
        self.crowd = int(np.unique(slots, return_counts=True)[1].max())
        # Slots of all beginnings of pieces: where a text goes on like none of them, no longer piece can match.
        self.begun = np.zeros(1 << SLOT_BITS, dtype=bool)
        for size in range(1, self.longest + 1):
            some = np.flatnonzero(lengths >= size)
            starts = (ends - lengths)[some]
            self.begun[_slot(spans.prefix_hashes(flat, starts, starts + size))] = True

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the pieces with these hashes, -1 where there is none."""
        at = self.first[_slot(hashes)]
        found = np.where(self.hashes[at] == hashes, at, -1)
        for further in range(1, self.crowd):
            left = np.flatnonzero(found < 0)
            other = np.minimum(at[left] + further, len(self.hashes) - 1)
            found[left] = np.where(self.hashes[other] == hashes[left], other, -1)
        return found

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join([self.raw[i] for i in ids.tolist()])


def _order(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Stable order by two whole numbers, from the lowest 16 bits on, which are sorted in linear time."""
    order = np.arange(len(first))
    for number in (second, first):
        for shift in range(0, int(number.max(initial=0)).bit_length(), 16):
            order = order[np.argsort((number[order] >> shift).astype(np.uint16), kind="stable")]
    return order


def _lattice(p: Pieces, points: np.ndarray, lengths: np.ndarray):
    """Edges of the lattices of some units (their points one after another), sorted by the node they end in.

    Nodes are the places between characters: unit u has lengths[u] + 1 of them.  Returns the first node of
    each unit and, for the edges, source node, piece (-1: bytes), cumulated share among the edges into the node; and
    the bounds of each node's edges.
    """
    total, n_nodes = len(points), int(lengths.sum()) + len(lengths)
    ends = np.cumsum(lengths)
    unit = np.repeat(np.arange(len(lengths)), lengths)
    left = ends[unit] - np.arange(total)
    base = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    node = np.arange(total) + unit  # node before each point
    sums = np.zeros(total + 1, dtype=np.uint64)
    np.cumsum(spans.mix(points) * spans._powers("up", total), out=sums[1:])
    down = spans._powers("down", total + 1)
    starts, sizes, ids = [], [], []
    single = np.zeros(total, dtype=bool)
    at = np.arange(total)
    for size in range(1, p.longest + 1):
        at = at[left[at] >= size]
        if not len(at):
            break
        h = spans.mix((sums[at + size] - sums[at]) * down[at] + np.full(1, size, dtype=np.uint64) * _GOLDEN)
        slot = _slot(h)
        likely = np.flatnonzero(p.maybe[slot])
        place = p.place(h[likely])
        same = place >= 0
        some, place = at[likely[same]], place[same]
        at = at[p.begun[slot]]
        if size == 1:
            single[some] = True
        starts.append(some)
        sizes.append(np.full(len(some), size))
        ids.append(p.ids[place])
    bare = np.flatnonzero(~single)
    starts.append(bare)
    sizes.append(np.ones(len(bare), dtype=np.int64))
    ids.append(np.full(len(bare), -1, dtype=np.int32))
    start, size, piece = np.concatenate(starts), np.concatenate(sizes), np.concatenate(ids)
    c = np.where(points[bare] == _LITERAL_MARK, _MARK, points[bare])
    n_bytes = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
    weight = np.concatenate([p.weights[piece[: len(piece) - len(bare)]], p.byte_weight * n_bytes])
    source, target = node[start], node[start] + size
    depth = target - base[unit[start]]
    order = _order(depth, target)
    source, target, piece, weight, depth = source[order], target[order], piece[order], weight[order], depth[order]
    mass = np.zeros(n_nodes)
    share = np.empty(len(source))
    cuts = np.flatnonzero(np.diff(depth)) + 1
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(depth)]])):
        value = mass[source[a:b]] + weight[a:b]
        first = np.flatnonzero(np.concatenate([[True], target[a + 1 : b] != target[a : b - 1]]))
        count = np.diff(np.append(first, b - a))
        top = np.maximum.reduceat(value, first)
        value = np.exp(value - np.repeat(top, count))
        sum_ = np.add.reduceat(value, first)
        mass[target[a + first]] = top + np.log(sum_)
        run = np.cumsum(value)
        before = np.repeat(run[first] - value[first], count)
        share[a:b] = (run - before) / np.repeat(sum_, count)
    low, high = np.zeros(n_nodes, dtype=np.int64), np.zeros(n_nodes, dtype=np.int64)
    if len(target):
        first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
        low[target[first]], high[target[first]] = first, np.append(first[1:], len(target))
    return base, source, piece, share, low, high


def encode(p: Pieces, chunk: spans.Chunk, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts): the sampled pieces of all rows one after another, and how many each row has."""
    points = np.frombuffer(chunk.data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    firsts = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])[chunk.offsets]
    points[points == _MARK] = _LITERAL_MARK
    points[points == 32] = _MARK
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int32), np.zeros(chunk.rows, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[firsts[:-1][firsts[:-1] < n]] = True
    new[1:] |= ((points[1:] == _MARK) & (points[:-1] != _MARK)) | (points[1:] == _BREAK) | (points[:-1] == _BREAK)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], n)
    row = np.searchsorted(firsts, begin, "right") - 1
    chosen = np.full(n, -2, dtype=np.int32)
    done = 0
    while done < len(begin):
        last = max(done + 1, int(np.searchsorted(end, begin[done] + SLICE_POINTS, "right")))
        b, e, r = begin[done:last], end[done:last], row[done:last]
        _, first, same = np.unique(spans.prefix_hashes(points, b, e) if last - done == len(begin) else spans.prefix_hashes(points[b[0] : e[-1]], b - b[0], e - b[0]), return_index=True, return_inverse=True)
        lengths = (e - b)[first]
        inner = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(b[first], lengths)
        base, source, piece, share, low, high = _lattice(p, points[inner], lengths)
        same = same.ravel()
        node, bottom, place, key, origin = base[same] + (e - b), base[same], e, keys[r], firsts[r]
        while len(node):
            u = (spans.mix(key + (place - origin).astype(np.uint64) * _GOLDEN) >> np.uint64(11)) * 2.0**-53
            edge, top = low[node], high[node] - 1
            going = np.flatnonzero((edge < top) & (u >= share[edge]))
            while len(going):
                edge[going] += 1
                going = going[(edge[going] < top[going]) & (u[going] >= share[edge[going]])]
            place = place - (node - source[edge])
            chosen[place] = piece[edge]
            node = source[edge]
            more = node > bottom
            node, bottom, place, key, origin = node[more], bottom[more], place[more], key[more], origin[more]
        done = last
    at = np.flatnonzero(chosen != -2)
    ids = chosen[at]
    bare = ids == -1
    repeat = np.ones(len(ids), dtype=np.int64)
    if bare.any():
        kinds, which = np.unique(np.where(points[at[bare]] == _LITERAL_MARK, _MARK, points[at[bare]]), return_inverse=True)
        coded = [p.byte_ids[list(chr(int(k)).encode())] for k in kinds]
        repeat[bare] = np.array([len(x) for x in coded])[which.ravel()]
        out = np.repeat(ids, repeat)
        stops = np.cumsum(repeat)
        wide = np.zeros((len(kinds), 4), dtype=np.int32)
        for k, x in enumerate(coded):
            wide[k, : len(x)] = x
        begin_at, which = stops[bare] - repeat[bare], which.ravel()
        for j in range(4):
            has = repeat[bare] > j
            out[begin_at[has] + j] = wide[which[has], j]
        ids = out
    tokens = np.concatenate([[0], np.cumsum(repeat)])
    return ids, np.diff(tokens[np.searchsorted(at, firsts)])


def sample_pieces(
    docs: DataFrame, model_path: str = MODEL, seed: int = SEED, temperature: float = TEMPERATURE, id_column: str = "doc_id", text_column: str = "text", carried: Sequence[str] = ()
) -> DataFrame:
    """One row per document: doc_id, n_pieces, ids, their SHA-256, and ``lossless`` (decoding gives the text back).

    The row key is the doc_id (null: a key of its own), so rows with equal doc_id and text are segmented alike.  Null
    and empty texts have no pieces.  White space, case and characters outside the vocabulary are all kept.  Columns named in
    ``carried`` follow as they are; others are not looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    own = "doc_id bigint, n_pieces bigint, ids array<int>, ids_sha256 string, lossless boolean"
    names = ["doc_id", "n_pieces", "ids", "ids_sha256", "lossless"]

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pieces(model.value, temperature)
        for b in batches:
            known = b.column(0).fill_null(-(1 << 63)).to_numpy().view(np.uint64)
            for c in spans.chunks(b.column(1), SLICE_POINTS):
                keys = spans.mix(known[c.first : c.first + c.rows] + np.full(1, seed, dtype=np.uint64) * _GOLDEN)
                ids, counts = encode(p, c, keys)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                parts = [ids[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
                columns = [
                    b.column(0).slice(c.first, c.rows),
                    pa.array(counts, pa.int64()),
                    spans.list_column(ids, counts, pa.int32()),
                    pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in parts], pa.string()),
                    pa.array([p.decode(x) == c.text(i) for i, x in enumerate(parts)], pa.bool_()),
                ]
                rest = [b.column(2 + k).slice(c.first, c.rows) for k in range(len(carried))]
                yield pa.record_batch([*columns, *rest], names=[*names, *carried])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), *[F.col(f"`{c}`") for c in carried])
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:]]
    return rows.mapInArrow(segment, ", ".join([own, *types]))


def decode_pieces(coded: DataFrame, model_path: str = MODEL, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """One row per row of stored piece ids: doc_id and text.

    Null ids give a null text and no ids an empty one.  An id outside the vocabulary, a null among the ids, or bytes that
    are no UTF-8 raise an error: such ids were not made by this vocabulary.  Other columns are not looked at.
    """
    model = coded.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def text(p: Pieces, doc: object, ids: pa.Array) -> str:
        if ids.null_count:
            raise ValueError(f"a null among the piece ids of {doc}")
        values = ids.to_numpy()
        if len(values) and (values.min() < 0 or values.max() >= len(p.raw) or not all(p.raw[i] for i in np.unique(values))):
            raise ValueError(f"an unknown piece id in those of {doc}")
        return p.decode(values).decode()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pieces(model.value, TEMPERATURE)
        for b in batches:
            for start in range(0, b.num_rows, 64):
                part = b.slice(start, 64)
                texts = [None if ids.values is None else text(p, doc, ids.values) for doc, ids in zip(part.column(0).to_pylist(), part.column(1))]
                yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col(id_column).cast("long").alias("doc_id"), F.col(ids_column).cast("array<int>").alias("ids")).mapInArrow(join, "doc_id bigint, text string")

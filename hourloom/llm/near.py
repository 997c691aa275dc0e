"""Near-duplicate grouping: SuperMinHash signatures, banding, verification and union-find.

*Signatures.*  Every element draws its ranks along one permutation of the registers (a lazy
Fisher-Yates shuffle seeded by the element): step j gives the value j + r to one register.  A
row needs no further step once all its registers hold a value, since later steps only give larger
ones; texts of a few hundred shingles stop after two or three.

*Candidates.*  128 registers make 32 bands of four.  At a similarity of 0.85 a pair shares no band
with probability 5e-11, at 0.8 with 5e-8.  Texts with equal shingle sets are one node from the
start.  In a bucket, every member is compared with the smallest one.  Buckets whose
members then lie in several components go on: members that can't be similar to any other, by
the number of shingles that only they have, leave; the others are compared with the member
nearest to the common core; then those members of different components are compared that
exact bounds on their common shingles don't tell apart.  No pair inside a component is made, and no bucket is cut.

*Verification* compares the full shingle sets.  *Grouping* contracts links by union-find inside
partitions and spreads the smallest node over what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.durable import stored
from hourloom.llm import spans

REGISTERS, BANDS = 128, 32
STEPS = np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(words: spans.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word shingles and their rows; a shorter text is one shingle."""
    values = words.hashes()
    hashes, at = words.windows(values, size)
    parts, rows = [hashes], [words.rows[at]]
    for n in range(1, size):
        short = np.flatnonzero(words.counts == n)
        parts.append(spans.run_hashes(values, words.bounds[short], n))
        rows.append(short)
    hashes, rows = np.concatenate(parts), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return hashes[order], rows[order]


def super_minhash(hashes: np.ndarray, rows: np.ndarray, n_rows: int, m: int = REGISTERS) -> np.ndarray:
    """Registers (n_rows x m) of the elements ``hashes``, of which each belongs to a row."""
    registers = np.full(n_rows * m, _EMPTY, dtype=np.uint64)
    places = None
    for j in range(m):
        if not len(hashes):
            break
        draw = spans.mix(hashes + STEPS[j])
        k = ((draw >> np.uint64(32)) % np.uint64(m - j)).astype(np.int64) + j
        if places is None:
            chosen = k
        else:
            own = np.arange(len(hashes))
            chosen = places[own, k].astype(np.int64)
            places[own, k] = places[:, j]
        np.minimum.at(registers, rows * m + chosen, (np.uint64(j) << np.uint64(32)) | (draw & np.uint64(0xFFFFFFFF)))
        full = registers.reshape(n_rows, m).max(axis=1) < (np.uint64(j + 1) << np.uint64(32))
        going = ~full[rows]
        if j == 0:
            hashes, rows, k = hashes[going], rows[going], k[going]
            places = np.tile(np.arange(m, dtype=np.uint8), (len(hashes), 1))
            places[np.arange(len(hashes)), k] = 0
        elif not going.all():
            hashes, rows, places = hashes[going], rows[going], places[going]
    return registers.reshape(n_rows, m)


_SIGNED = "doc_id bigint, text_key binary, n_shingles bigint, node binary, bands array<bigint>, s1 bigint, s2 bigint"


def _signatures(size: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_key", pa.binary()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64())), ("s1", pa.int64()), ("s2", pa.int64())]
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in spans.chunks(b.column(1)):
                hashes, rows = shingle_hashes(spans.Words(c), size)
                bounds = np.searchsorted(rows, np.arange(c.rows + 1))
                sets = [np.unique(hashes[s:e]) for s, e in zip(bounds[:-1], bounds[1:])]
                registers = super_minhash(hashes, rows, c.rows)
                keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (c.rows, 1))
                width = REGISTERS // BANDS
                for k in range(width):
                    keys = spans.mix(keys * np.uint64(0x9E3779B97F4A7C15) + registers[:, k::width])
                bits = np.packbits((spans.mix(registers) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                full = np.diff(bounds) > 0
                yield spans.batch(
                    {
                        "doc_id": b.column(0).slice(c.first, c.rows),
                        "text_key": b.column(2).slice(c.first, c.rows).cast(pa.binary()),
                        "n_shingles": [len(s) for s in sets],
                        "node": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                        "bands": spans.list_column(keys[full].view(np.int64).ravel(), np.where(full, BANDS, 0), pa.int64()),
                        "s1": np.ascontiguousarray(bits[:, 0]),
                        "s2": np.ascontiguousarray(bits[:, 1]),
                    },
                    schema,
                )

    return sign


def _sets(size: int):
    schema = pa.schema([("node", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in spans.chunks(b.column(0)):
                hashes, rows = shingle_hashes(spans.Words(c), size)
                bounds = np.searchsorted(rows, np.arange(c.rows + 1))
                sets = [np.unique(hashes[s:e]) for s, e in zip(bounds[:-1], bounds[1:])]
                values = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
                yield spans.batch(
                    {
                        "node": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                        "shingles": spans.list_column(values.view(np.int64), np.array([len(s) for s in sets]), pa.int64()),
                    },
                    schema,
                )

    return gather


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one partition: each node with the smallest node of its tree."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    found = [(x, root(x)) for x in parent if root(x) != x]
    for i in range(0, len(found), 10_000):
        part = found[i : i + 10_000]
        yield pa.record_batch([pa.array([x for x, _ in part], pa.binary()), pa.array([y for _, y in part], pa.binary())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for all nodes that have a link.

    ``links``: two binary columns a and b.  Rounds stop when no root changes any more.
    """
    forest = links.mapInArrow(_forest, "a binary, b binary").distinct()
    edges = stored(forest.select("a", "b").union(forest.select("b", "a")).toDF("node", "other"), "edges")
    roots = stored(edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "roots")
    while True:
        seen = edges.join(roots.select(F.col("node").alias("other"), F.col("root").alias("near")), "other")
        least = seen.groupBy("node").agg(F.min("near").alias("near"))
        next_roots = roots.join(least, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        # The root's own root: paths halve in each round.
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("further"))
        next_roots = stored(
            next_roots.join(jump, "root", "left").select("node", F.least("root", F.coalesce("further", "root")).alias("root"), "old"), "roots"
        )
        changed = next_roots.where("root <> old").limit(1).count()
        roots = next_roots.select("node", "root")
        if not changed:
            return roots


def _sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The full shingle sets of the wanted nodes, from the whole texts."""
    low = wanted.join(nodes.select("node", "low"), "node").select(F.col("low").alias("doc_id")).distinct()
    texts = docs.join(low.where("doc_id is not null"), "doc_id", "left_semi").select("text")
    # Null identifiers are no key: where a wanted set has no other, all their texts are read where they lie.
    nameless = low.where("doc_id is null").limit(1).select(F.lit(1).alias("any"))
    texts = texts.unionAll(docs.where("doc_id is null").crossJoin(F.broadcast(nameless)).select("text"))
    sets = texts.mapInArrow(_sets(size), "node binary, shingles array<bigint>").where("node is not null")
    return stored(sets.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) of the pairs whose full shingle sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    linked = 100 * both >= percent * (F.size("x") + F.size("y") - both)
    return stored(pairs.join(left, "a").join(right, "b").where(linked).select("a", "b"), "links")


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members, with their roots, of those buckets that hold more than one component."""
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return rooted.join(mixed, "key")


def _sides(fields: list[str], *sides: str) -> list[list]:
    return [[F.col(f).alias(f"{f}_{side}") for f in fields] + [F.col("node").alias(side)] for side in sides]


def text_key(column: str = "text"):
    """What tells texts of one identifier apart."""
    return F.unhex(F.md5(column))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a document's set holds its
    distinct ``size``-word shingles (fewer words: the whole sequence).  Documents are linked where
    100 * intersection >= ``percent`` * union; components are the classes of the links' closure and
    bear their smallest doc_id.  Null or blank texts have an empty set and are linked with
    nothing.  Rows that share a doc_id count as one document if their texts are equal, and each on
    its own text otherwise; a null doc_id is never a component's name unless no other is there, and then the
    smallest shingle set's rows are kept.  Other columns are not looked at.  Sets are compared as sets of 64-bit hashes.
    """
    return near_groups(docs, size, percent, id_column, text_column).select("doc_id", "n_shingles", "component_id", "kept")


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``near_duplicates`` with ``text_key`` and ``root``, the group itself (null for blank texts)."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    signed = stored(docs.withColumn("text_key", text_key()).mapInArrow(_signatures(size), _SIGNED), "signatures")
    nodes = stored(
        signed.where("node is not null").groupBy("node").agg(
            F.min("doc_id").alias("low"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "s1", "s2")]
        ),
        "nodes",
    )
    banded = nodes.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(banded.join(shared.select("key", "pivot"), "key"), "members")
    facts = nodes.select("node", "n_shingles", "s1", "s2")

    # Sets whose sizes differ too much can't be similar; sketches that differ too much aren't, but for one in 10**9.
    q = (100 - percent) / 200
    differing = int(128 * q + 6.5 * (128 * q * (1 - q)) ** 0.5)
    fits = (
        (100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b"))
        & (F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b"))) + F.bit_count(F.col("s2_a").bitwiseXOR(F.col("s2_b"))) <= differing)
    )
    left, right = _sides(["n_shingles", "s1", "s2"], "a", "b")
    first = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    first = stored(first.join(facts.select(*left), "a").join(facts.select(*right), "b").where(fits).select("a", "b"), "pairs")
    in_pairs = first.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = _verified(first, _sets_of(in_pairs, nodes, docs, size), percent)
    roots = components(links)

    # Buckets that still hold several components.  Two of their members can share only shingles that
    # several of them have, so each member's own shingles bound its similarity to all others.
    left_open = stored(_open(members.select("key", "node"), roots).select("key", "node"), "open")
    if left_open.limit(1).count():
        sets = _sets_of(left_open.select("node").distinct(), nodes, docs, size)
        each = sets.select("node", F.explode("shingles").alias("shingle"))
        own = each.groupBy("shingle").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n")).where("n = 1")
        facts = stored(
            facts.join(nodes.select("node", "bands"), "node").join(own.groupBy("node").agg(F.count(F.lit(1)).alias("own")), "node", "left")
            .join(left_open.select("node").distinct(), "node", "left_semi")
            .withColumn("common", F.col("n_shingles") - F.coalesce("own", F.lit(0))),
            "facts",
        )
        known = left_open.join(facts, "node")
        least = known.groupBy("key").agg(F.min("n_shingles").alias("least"))
        most = F.col("common")
        possible = 100 * most >= percent * (F.col("n_shingles") + F.greatest("least", "common") - most)
        able = stored(known.join(least, "key").where(possible).drop("least", "own"), "able")
        fields = ["n_shingles", "s1", "s2", "common", "root", "bands"]
        left, right = _sides(fields, "a", "b")
        shared = F.least("common_a", "common_b")
        fits = fits & (100 * shared >= percent * (F.col("n_shingles_a") + F.col("n_shingles_b") - shared))
        # The member with the fewest shingles of its own is the nearest to all others.
        order = F.struct(F.col("n_shingles") - F.col("common"), F.col("node"))
        rooted = stored(_open(able, roots), "rooted")
        pivots = stored(rooted.groupBy("key").agg(F.min_by(F.struct("node", *fields), order).alias("p")).select("key", "p.*"), "pivots")
        pairs = pivots.select("key", *left).join(rooted.select("key", *right), "key").where((F.col("root_a") != F.col("root_b")) & fits)
        links = links.union(_verified(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets, percent))
        roots = components(links)

        # What that leaves open: two members share at most what neither lacks of the pivot's set, and what
        # both have besides.  Bitmaps of the lacking shingles bound the first part for a pair.
        rest = _open(able.drop("root"), roots).join(pivots.select("key", F.col("node").alias("pivot")), "key")
        lacks = F.array_except("core", "shingles")

        def bitmap(half: int):
            bit = F.expr(f"aggregate(lacking, 0L, (m, v) -> m | if(pmod(v, 128) div 64 = {half}, shiftleft(1L, cast(pmod(v, 64) as int)), 0L))")
            return bit.alias(f"lacks{half}")

        marked = (
            rest.join(sets, "node").join(sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("core")), "pivot")
            .withColumn("lacking", lacks)
            .select("key", "node", *fields, F.size("core").alias("core"), bitmap(0), bitmap(1), (F.col("common") - F.size("core") + F.size("lacking")).alias("besides"))
        )
        marked = stored(marked, "marked")
        left, right = _sides([*fields, "lacks0", "lacks1", "besides"], "a", "b")
        either = sum(F.bit_count(F.col(f"lacks{h}_a").bitwiseOR(F.col(f"lacks{h}_b"))) for h in (0, 1))
        shared = F.least("common_a", "common_b", F.col("core") - either + F.least("besides_a", "besides_b"))
        bound = 100 * shared >= percent * (F.col("n_shingles_a") + F.col("n_shingles_b") - shared)
        # A pair that shares several buckets is made in one of them.
        once = F.col("key") == F.array_min(F.array_intersect("bands_a", "bands_b"))
        across = marked.select("key", "core", *left).join(marked.select("key", *right), "key")
        across = across.where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & fits & bound & once).select("a", "b")
        found = _verified(across, sets, percent)
        if found.limit(1).count():
            roots = components(links.union(found))

    rooted = nodes.select("node", "low").join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    names = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(names, "root").select("node", "root", "component_id")
    nameless = F.col("component_id").isNull() & (F.col("node").isNull() | (F.col("node") == F.col("root")))
    return (
        signed.select("doc_id", "text_key", "n_shingles", "node")
        .join(named, "node", "left")
        .select("doc_id", "text_key", "n_shingles", "node", "root", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), nameless))
        .drop("node")
    )

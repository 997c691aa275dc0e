"""Transducers against sorted lists, and the audit against a count by hand."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourloom.llm import divergence, transducer

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_transducer_orders_and_recalls():
    rng = random.Random(2)
    words = sorted({bytes(rng.choice(b"abc\xc3\xa9\xff") for _ in range(rng.randint(0, 9))) for _ in range(3000)})
    made = transducer.Transducer.of(*transducer.build(words).parts())
    assert made.ordinals(words).tolist() == list(range(len(words)))
    assert [made.word(i) for i in range(len(words))] == words
    known = set(words)
    others = [w for w in (bytes(rng.choice(b"abcd\xc3") for _ in range(rng.randint(0, 30))) for _ in range(3000)) if w not in known]
    assert others and set(made.ordinals(others).tolist()) == {-1}
    with pytest.raises(IndexError):
        made.word(len(words))


def test_transducer_is_minimal():
    words = sorted({stem + end for stem in (b"walk", b"talk", b"stalk") for end in (b"", b"s", b"ed", b"ing")})
    made = transducer.build(words)
    # One state for each different set of endings.
    endings = {tuple(w[k:] for w in words if w.startswith(p[:k])) for p in words for k in range(len(p) + 1)}
    assert len(made.final) == len(endings)


def test_transducer_edges():
    empty = transducer.build([])
    assert empty.ordinals([b"", b"a"]).tolist() == [-1, -1] and empty.size == 0
    only = transducer.build([b""])
    assert only.ordinals([b"", b"a"]).tolist() == [0, -1] and only.word(0) == b""
    with pytest.raises(ValueError):
        transducer.build([b"b", b"a"])


def _brute(rows, least, top):
    groups, documents, counts = set(), collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        key = (lang or "", source or "")
        terms = TERM.findall((text or "").translate(LOWER))
        groups.add(key)
        documents[key[0]].update(set(terms))
        counts[key].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in documents[lang].items() if n >= least), key=str.encode)
        mine = sorted(g for g in groups if g[0] == lang)
        whole = sum((counts[g] for g in mine), collections.Counter())

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {g: share(counts[g]) for g in mine}, share(whole)
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for g in mine:
            pairs = [(h[1], sum(far(p[g][t], p[h][t]) for t in kept)) for h in mine if h != g]
            terms = [(t, far(p[g][t], q[t])) for t in kept if counts[g][t] and p[g][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, g[1], part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return out


def _rows():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcÉéßÜ😀Z") for _ in range(rng.randint(1, 4))) for _ in range(120)]
    rows = []
    for _ in range(260):
        lang, source = rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", "a", "a", "é", "z", "A", None])
        rows.append((lang, source, rng.choice([" ", "\n", "1", "_", "\u007f"]).join(rng.choice(words[:60] if source == "a" else words) for _ in range(rng.randint(0, 40)))))
    rows += [("en", "only nulls", None), ("fr", "x", "rare words here"), ("fr", "y", ""), ("xx", "alone", None), *[rows[0]] * 12]
    return rows + [("en", "long", "abc é9 " * 200_000 + "x" * 100_000)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string").select(
        "*", *[F.lit(1).alias(c) for c in ("n", "term", "ordinal", "shard", "value", "rank", "item", "doc_id", "block", "p")]
    )


@pytest.mark.parametrize("shard_terms,lot_bytes,held,cells", [(1 << 16, 64 << 20, 1 << 17, 1 << 20), (7, 600, 50, 64)])
def test_divergence(spark, monkeypatch, shard_terms, lot_bytes, held, cells):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", cells)
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    rows = _rows()
    got = divergence.source_divergence(_frame(spark, rows).repartition(3), min_documents=5, shard_terms=shard_terms, lot_bytes=lot_bytes)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    expected = collections.Counter(_brute(rows, 5, 10))
    assert collections.Counter(tuple(r) for r in got.collect()) == expected


def test_lots_are_bounded(spark):
    rows = divergence._rows(_frame(spark, _rows()), "lang", "source", "text")
    shards = divergence.vocabulary(rows, 5, shard_terms=7)
    sizes = {r.shard: r.bytes for r in divergence._index(shards).collect()}
    lots = divergence.lots(shards, 3000)
    assert len(lots) > 2 and max(sum(sizes[s] for s in lot) for lot in lots) <= 3000
    assert [s for lot in lots for s in lot] == sorted(sizes)
    few, many = divergence.recount(rows, shards), divergence.recount(rows, shards, lot_bytes=3000)
    n = lambda rows: sorted((r.lang, r.source, r.block, p, k) for r in rows.collect() for p, k in zip(r.places, r.n))
    assert n(few) == n(many)


def test_large_counts_stay_exact():
    n = np.array([0, 7, 10**12, 3 * 10**9], dtype=np.int64)
    total = int(n.sum())
    assert divergence._shares(n, total, 4).tolist() == [1 + 10**9 * (int(k) + 2) // (total + 8) for k in n]


def test_empty_table(spark):
    assert divergence.source_divergence(_frame(spark, [])).collect() == []


def test_no_kept_terms(spark):
    got = sorted(map(tuple, divergence.source_divergence(_frame(spark, [("en", "a", "x"), ("en", "b", None), (None, None, None)])).collect()))
    assert got == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]

"""The training-data operators against brute force, on small tables with nulls, ties, copies and clashing columns."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hourloom.llm import archives, exact, extraction, mixing, near, pieces, quality, sentence_spans, spans, templates, training_order

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Columns whose names the operators use themselves.
CLASHING = ["run", "key", "node", "marks", "slot", "n", "root"]


def _texts(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k)).capitalize() + "."
    base = ["\n".join(" ".join(sentence(rng.randint(2, 12)) for _ in range(3)) for _ in range(rng.randint(1, 5))) for _ in range(n)]
    passage = " ".join(sentence(9) for _ in range(7))
    out = [*base, base[0], base[1].upper().replace("É", "é"), base[2] + "\n" + passage, base[3] + "\n" + passage, "", None, "  \n ", "one", "one two", "x" * 5000]
    for k in range(8):  # near copies of one long text
        words = (base[4] + " " + base[5] + " " + base[6]).split(" ")
        words[k * 3 % len(words)] = f"new{k}"
        out.append(" ".join(words))
    return out + ["Hello 17 of 20\nsame line here", "Hello 99 of 21\nsame line here", "▁ 日本 😀\t \x0b end  "]


def _docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "src%d" % (i % 3) if i % 7 else None, *[1] * len(CLASHING)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in CLASHING)).repartition(3)


def _empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, page_id long, url string, html string")


def test_exact_duplicates(spark):
    texts = _texts()
    got = {r.doc_id: r for r in exact.exact_duplicates(_docs(spark, texts)).collect()}
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[(t or "").translate(LOWER)].append(i)
    assert len(got) == len(texts)
    for normal, members in groups.items():
        for i in members:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (max(members), len(members), i == max(members))
            assert r.text_sha256 == hashlib.sha256(normal.encode()).hexdigest()


def test_exact_duplicates_null_ids(spark):
    got = exact.exact_duplicates(_docs(spark, ["a", "A", "b"], [None, 5, None])).collect()
    assert sorted((r.doc_id is None, r.keep_id, r.kept) for r in got if r.group_size == 2) == [(False, 5, True), (True, 5, False)]
    assert [(r.keep_id, r.kept) for r in got if r.group_size == 1] == [(None, True)]


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    texts = _texts()
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    name = list(range(len(texts)))
    for _ in name:
        for a in range(len(sets)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    name[a] = name[b] = min(name[a], name[b])
    got = near.near_duplicates(_docs(spark, texts), size, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), name[i], name[i] == i) for i in range(len(texts))}
    assert len(set(name[-11:-3])) == 1


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 500, dtype=np.uint64)
    b = np.concatenate([a[:400], rng.integers(0, 1 << 62, 100, dtype=np.uint64)])
    r = near.super_minhash(np.concatenate([a, b]), np.repeat([0, 1], 500), 2)
    assert abs((r[0] == r[1]).mean() - 400 / 600) < 0.15


def test_template_lines(spark):
    texts = _texts()
    got = {r.doc_id: r for r in templates.drop_template_lines(_docs(spark, texts)).collect()}
    n = len(texts)
    assert got[n - 3].text == texts[n - 3] and got[n - 2].text == ""  # differing numbers only
    assert got[60].text == "" and got[0].text == texts[0]  # an exact copy loses every line
    assert got[65].text is None and got[65].n_lines == 0 and got[64].text == ""
    exact_lines = collections.defaultdict(set)
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            if WORD.search(line):
                exact_lines[line].add(i)
    for line, ids in exact_lines.items():
        for i in ids - {min(ids)}:
            assert line not in got[i].text.split("\n")


def test_template_general_field(spark):
    texts = ["user anna logged in from the north gate today", "user bert logged in from the south gate today", "user carl logged out of it all by night now"]
    got = {r.doc_id: r.n_dropped for r in templates.drop_template_lines(_docs(spark, ["a b c d " + t for t in texts])).collect()}
    assert got[2] == 0


def test_sentence_spans(spark):
    texts = _texts()
    got = {r.doc_id: r for r in sentence_spans.remove_repeated_spans(_docs(spark, texts)).collect()}
    assert got[62].text == texts[62][: len(texts[62])] or got[62].n_removed
    passage = texts[63].rsplit("\n", 1)[1]
    assert passage in got[62].text or got[62].n_removed >= 3
    assert passage not in got[63].text
    assert got[60].text == "" and got[0].n_removed == 0 and got[65].text is None
    assert all(got[i].n_removed == 0 for i in range(7, 60))


def test_quality_counts_and_model(spark):
    rng = random.Random(5)
    good = [" ".join(rng.choice(["tree", "house", "river", "cloud", "stone"]) for _ in range(40)) for _ in range(60)]
    bad = [" ".join(rng.choice(["BUY!!", "NOW!!", "$$$", "WIN!!", "FREE!!"]) for _ in range(40)) for _ in range(60)]
    texts = [*good, *bad, None, "", "a b", "x y z\nx y z\n" * 20]
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 120, 2)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_rules(_docs(spark, texts), labels).collect()}
    held = [i for i in range(1, 120, 2) if not got[i].base_failed]
    assert sum(got[i].kept == (i < 60) for i in held) / len(held) > 0.95
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_pieces_sampling_and_round_trip(spark):
    texts = _texts()
    rows = pieces.sample_pieces(_docs(spark, texts)).collect()
    again = {r.doc_id: r.ids for r in pieces.sample_pieces(_docs(spark, texts).repartition(7)).collect()}
    assert all(r.lossless and r.ids == again[r.doc_id] and r.n_pieces == len(r.ids) for r in rows)
    p = pieces.Pieces(open(pieces.MODEL, "rb").read(), 3.0)
    by_text = {p.raw[i].decode(): i for i in p.ids.tolist()}

    def all_ways(s):
        if not s:
            yield (), 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in by_text:
                for rest, w in all_ways(s[k:]):
                    yield (by_text[s[:k]], *rest), w + p.weights[by_text[s[:k]]]

    ways = dict(all_ways("their"))
    total = sum(map(math.exp, ways.values()))
    n = 20_000
    chunk = next(spans.chunks(pa.array(["their"] * n)))
    ids, counts = pieces.encode(p, chunk, spans.mix(np.arange(n, dtype=np.uint64)))
    seen = collections.Counter(tuple(x.tolist()) for x in np.split(ids, np.cumsum(counts)[:-1]))
    assert set(seen) <= set(ways)
    assert all(abs(seen[k] / n - math.exp(w) / total) < 0.02 for k, w in ways.items())


def test_mixing_is_pfair(spark):
    rows = [(i, "a" if i % 2 else "b" if i % 3 else None if i % 4 else "c") for i in range(3000)] + [(7, "a"), (None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, source string").withColumn("slot", F.lit(1))
    weights = {"a": 5, "b": 3}
    got = mixing.mix(docs, weights, block_rows=4, shard_rows=500).collect()
    assert collections.Counter((r.row.doc_id, r.row.source) for r in got) == collections.Counter(rows)
    slots = {r.slot: r.source for r in got}
    blocks = collections.defaultdict(set)
    for r in got:
        blocks[r.source].add((r.slot, r.block))
    names = list(blocks)
    w = {s: weights.get(s, 1) for s in names}
    total = sum(w.values())
    whole = min(len(blocks[s]) // w[s] for s in names) * total
    count = collections.Counter()
    for k in range(whole):
        count[slots[k]] += 1
        assert all(abs(count[s] - (k + 1) * w[s] / total) < 1 for s in names)
    for s in names:
        assert [b for _, b in sorted(blocks[s])] == list(range(len(blocks[s])))


def test_extraction(spark):
    frame = '<nav><ul><li>Home</li></ul></nav><div class="cookie-notice">We use cookies</div>'
    pages = [
        (1, "http://h.org/a/1.html?x=1", f"<html><head><title>T</title><style>p{{}}</style></head><body>{frame}<p>Site line</p><article><h1>A &amp; B</h1><p>One<b>two</b><br>three<p>Four&nbsp;five</article><div>Rights</div></body>"),
        (2, "http://h.org/a/2.html", f"<body>{frame}<p>Site line</p><div>Own words</div><div>Rights</div><section id=comments><p>me too</p></section></body>"),
        (3, None, None), (4, "http://h.org/a/3.html", ""), (5, "http://z.org/", "plain < text"),
    ]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, lines int")
    got = {r.page_id: r for r in extraction.extract_text(df).collect()}
    assert [got[i].text for i in range(1, 6)] == ["A & B Onetwo three Four five", "Own words", "", "", "plain < text"]
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(extraction.common_lines(a, b)) == best[-1][-1]


def test_archives(spark, tmp_path):
    big = "<p>é" + "x" * 1200 + "\r\n\r\nWARC/1.1\r\n"
    pages = [(1, "http://a/ b", big), (2, None, big), (3, "http://c", big), (4, "http://d", "small"), (5, "http://e", "small"), (6, "u", None), (None, "n", "null id")]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, size int")
    arcs = [str(tmp_path / f"arc{v}") for v in (1, 2)]
    archives.write_arc(df.where("page_id % 2 = 0 or page_id is null"), arcs[0], 1, records_per_file=3)
    archives.write_arc(df.where("page_id % 2 = 1"), arcs[1], 2)
    archives.convert(archives.read_arc(spark, *arcs), str(tmp_path / "warc"), records_per_file=3)
    got = {r.page_id: r for r in archives.read_warc(spark, str(tmp_path / "warc")).collect()}
    assert len(got) == len(pages)
    for i, _, body in pages:
        raw = (body or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 3) if i in (1, 2) else ("response", None))
    with pytest.raises(ValueError):
        list(archives.arc_records(b"filedesc://x 0 0 text/plain 4\n9 0\n\n"))


def test_training_order(spark, tmp_path, monkeypatch):
    for n in (1, 2, 5, 1000, 4097):
        assert sorted(training_order.feistel(np.arange(n), n)) == list(range(n))
    texts = _texts()
    n = training_order.materialise(_docs(spark, texts), str(tmp_path / "s"), length=16, shard_slots=10)
    rows = sorted(training_order.read_shards(spark, str(tmp_path / "s"), 16, 10).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(n)) and all(r.position == r.slot % 10 and r.shard == r.slot // 10 for r in rows)
    coder = training_order.Tokens(open(training_order.VOCABULARY, "rb").read())
    want = collections.Counter(training_order.END for _ in texts)
    for t in texts:
        want.update(coder.coder.encode_ordinary(t or ""))
    for run in (1, 3, 50):
        monkeypatch.setattr(training_order, "RUN", run)
        for t in [*texts, " x", "x ", "a  b c", "a\n b", "a\u00a0 b c", "it's 12 ... x"]:
            assert b"".join(coder.encode(t or "")) == np.array(coder.coder.encode_ordinary(t or ""), dtype=np.uint16).tobytes()
    assert collections.Counter(x for r in rows for x in np.frombuffer(r.tokens, dtype=np.uint16).tolist()) == want


def test_empty_tables(spark, tmp_path):
    empty = _empty(spark)
    for df in (
        exact.exact_duplicates(empty), near.near_duplicates(empty), templates.drop_template_lines(empty), sentence_spans.remove_repeated_spans(empty),
        pieces.sample_pieces(empty), mixing.mix(empty, {"a": 1}), extraction.extract_text(empty),
        quality.quality_rules(empty, spark.createDataFrame([], "doc_id long, quality int")),
    ):
        assert df.count() == 0
    assert training_order.materialise(empty, str(tmp_path / "none")) == 0

"""Rows with null and repeated identifiers lose only what other documents have, against brute force."""

import random

import corpus_pipeline as C
from hourloom.llm import sentence_spans, templates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, marks string, text_key string"


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "m", "k") for i, t in rows], SCHEMA).repartition(3)


def _sentences(rng, n):
    return [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 9999)) for _ in range(9)) + "." for _ in range(n)]


def _rows():
    rng = random.Random(3)
    common, own = _sentences(rng, 3), [_sentences(rng, 2) for _ in range(8)]
    text = lambda k, *more: " ".join([*own[k], *more])
    rows = [(1, text(0, *common)), (5, text(1, *common)), (5, text(2)), (None, text(3, *common)), (None, text(4, *common)), (None, text(5)), (None, text(6)), (7, text(7)), (7, text(7))]
    return rows, common, own


def test_spans_by_row(spark):
    rows, common, own = _rows()
    got = sentence_spans.remove_repeated_spans(_frame(spark, rows + [(None, None), (None, ""), (8, None)])).collect()
    assert len(got) == len(rows) + 3
    passage = " ".join(common)
    texts = [r.text or "" for r in got]
    assert sum(passage in t for t in texts) == 1 and sum(any(s in t for s in common) for t in texts) == 1
    assert next(r.doc_id for r in got if passage in (r.text or "")) is None  # rows without an identifier come first
    for k, (i, t) in enumerate(rows):  # no sentence that only one document has goes, from equal rows neither
        mine = " ".join(own[min(k, 7)])
        assert [r.doc_id for r in got if mine in (r.text or "")] == [i] * (2 if i == 7 else 1), k
    assert sorted((r.doc_id or 0) for r in got if r.text is None) == [0, 8]


def test_all_spans_against_brute_force(spark):
    rng = random.Random(8)
    pool = _sentences(rng, 30)
    docs = [[rng.choice(pool) for _ in range(rng.randint(0, 6))] for _ in range(60)]
    rows = [(rng.choice([None, k, k // 2]), " ".join(d)) for k, d in enumerate(docs)]
    got = sentence_spans.remove_repeated_spans(_frame(spark, rows), run=2, min_words=1, long_words=10**6).collect()
    texts = {}
    for (i, t), d in zip(rows, docs):
        texts[(i, t)] = d
    known = sorted((key for key in texts if key[0] is not None), key=lambda key: key[0])
    nameless = {key for key in texts if key[0] is None}
    tied = {i for i, _ in known if sum(j == i for j, _ in known) > 1}
    first, places = {}, {}
    for key, d in texts.items():
        for k in range(len(d) - 1):
            places.setdefault((d[k], d[k + 1]), []).append((key, k))
    removed = {(r.doc_id, r.text): r for r in got}
    assert len(got) == len(rows) and removed
    by_text = {}
    for r in got:
        by_text.setdefault((r.doc_id, r.n_sentences), []).append(r)
    for key, d in texts.items():
        if key in nameless or key[0] in tied:
            continue  # among these the order is by a hash
        r = next(r for r in got if r.doc_id == key[0] and r.n_sentences == len(d))
        gone = set()
        for k in range(len(d) - 1):
            own = places[(d[k], d[k + 1])]
            if any(o in nameless or o[0] < key[0] or (o == key and at < k) for o, at in own):
                gone |= {k, k + 1}
        assert {x for m in r.removed for x in range(m.low, m.high + 1)} == gone and r.text.split() == " ".join(s for k, s in enumerate(d) if k not in gone).split()
    # Every pair of neighbouring sentences of the corpus stands somewhere still, or its sentences do.
    left = " ".join(r.text for r in got)
    assert all(s in left for d in docs if len(d) > 1 for s in d)


def _lines():
    shared = "this line stands in many of the documents here"
    rows = [(1, f"one alpha\n{shared}"), (5, f"two beta gamma\n{shared}"), (5, "zero to keep\nthree delta"), (None, f"four e f g h i\n{shared}"), (None, f"five j k l m n o\n{shared}"), (None, "six p q r s t u v"), (9, shared), (9, shared), (4, None), (None, ""), (6, " \n")]
    return rows, shared


def test_lines_by_row(spark):
    rows, shared = _lines()
    got = templates.drop_template_lines(_frame(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r.n_dropped for r in got) == 5
    want = [(i, t) if t is None else (i, "\n".join(x for x in t.split("\n") if x != shared)) for i, t in rows]
    keeper = next(r for r in got if r.text and shared in r.text)
    assert keeper.doc_id is None and sum(shared in (r.text or "") for r in got) == 1
    strip = lambda i, t: (str(i), None if t is None else "\n".join(x for x in t.split("\n") if x != shared))
    key = lambda x: (x[0], x[1] is not None, x[1] or "")
    assert sorted((strip(r.doc_id, r.text) for r in got), key=key) == sorted((strip(*x) for x in want), key=key)


def test_line_stage_drops_what_it_empties(spark, tmp_path):
    rows, shared = _lines()
    got = C.line_stage(spark, _frame(spark, rows), str(tmp_path))
    assert got.columns == C.COLUMNS
    got = got.collect()
    assert not [r for r in got if r.doc_id == 9]  # both rows had that line alone
    assert sorted((str(r.doc_id), r.text) for r in got if not (r.text or "").strip()) == [("4", None), ("6", " \n"), ("None", "")]
    assert len(got) == len(rows) - 2 and all(r.text is None or r.n_chars == len(r.text) for r in got)


def test_tables_without_rows(spark, tmp_path):
    empty = _frame(spark, [(1, "x")]).where("false")
    assert sentence_spans.remove_repeated_spans(empty).count() == templates.drop_template_lines(empty).count() == C.line_stage(spark, empty, str(tmp_path)).count() == 0

"""Near copies of rows whose identifiers are null, repeated or shared by different texts."""

from hourloom.llm import near

LONG = " ".join(f"w{i}" for i in range(200))
OTHER = " ".join(f"v{i}" for i in range(200))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _near(text, k=0):
    words = text.split(" ")
    words[k] = "new"
    return " ".join(words)


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)


def test_null_ids_are_linked(spark):
    rows = [(None, LONG), (None, _near(LONG)), (None, OTHER), (9, "a b c d e f")]
    got = near.near_duplicates(_frame(spark, rows)).collect()
    assert sorted(r.kept for r in got) == [False, True, True, True]
    assert near.near_groups(_frame(spark, rows)).select("root").distinct().count() == 3
    named = near.near_duplicates(_frame(spark, [*rows, (4, _near(LONG, 150))])).collect()
    assert sorted((r.doc_id is None, r.kept) for r in named if r.component_id == 4) == [(False, True), (True, False), (True, False)]

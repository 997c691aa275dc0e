"""Copies of a page whose markup labels nothing: differencing takes the site's lines, not the text."""

from hourloom.llm import extraction


def test_copies_keep_their_text(spark):
    page = lambda own: f"<body><div>Site line</div><div>{own}</div><div>Rights</div></body>"
    pages = [(1, "http://h.org/a/1", page("Own one")), (2, "http://h.org/a/1", page("Own one")), (2, "http://h.org/a/1", page("Own one")),
             (3, "http://h.org/a/2", page("Own two")), (4, "http://h.org/a/3", page("Own two")), (5, "http://z.org/1", page("Alone")), (6, "http://z.org/1", page("Alone"))]
    got = extraction.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    want = [(1, "Own one"), (2, "Own one"), (2, "Own one"), (3, "Own two"), (4, "Own two"), (5, "Site line Alone Rights"), (6, "Site line Alone Rights")]
    assert sorted((r.page_id, r.text) for r in got) == want
    assert {r.page_id: r.paired_with for r in got} == {1: 3, 2: 3, 3: 2, 4: 2, 5: None, 6: None}

"""Neighbours over the edges of ranges, against pairing and alignment written out for the whole table."""

import random

import pytest

from hourloom.llm import extraction


def _longest(a, b):
    """Length of a longest common subsequence, by the full table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def _brute(pages):
    """Per page: (page_id, text of the lines that its nearest neighbour lacks, paired_with, n_shared_lines)."""
    rows = []
    for page_id, url, lines in pages:
        host, _, path = url.split("://")[1].partition("/")
        rows.append((host, "/" + path, page_id, lines))
    rows.sort()
    out = []
    for i, (host, path, page_id, lines) in enumerate(rows):
        best = None
        for side in (range(i - 1, -1, -1), range(i + 1, len(rows))):
            other = next((rows[j] for j in side if rows[j][0] != host or rows[j][3] != lines), None)
            if other and other[0] == host:
                common = next((k for k, (x, y) in enumerate(zip(path + "\0", other[1] + "\1")) if x != y), 0)
                if best is None or common > best[0]:
                    best = (common, other)
        shared = _longest(lines, best[1][3]) if best else 0
        out.append((page_id, best[1][2] if best else None, shared, len(lines) - shared))
    return sorted(out)


def _pages(seed, n, copies):
    rng = random.Random(seed)
    pages = []
    for k in range(n):
        own = [f"own {k} {j}" for j in range(rng.randrange(3))] if rng.random() > copies else ["copy"] * rng.randrange(1, 3)
        lines = ["top", *own, rng.choice(["end", "close", "end"])]
        pages.append((k, f"http://h{rng.randrange(2)}.org/{rng.choice('abc')}/{rng.randrange(30)}", lines))
    return pages


@pytest.mark.parametrize("seed,n,copies", [(1, 60, 0.1), (2, 60, 0.8), (3, 40, 1.0)])
def test_ranges_change_nothing(spark, seed, n, copies):
    pages = _pages(seed, n, copies)
    rows = [(k, url, "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>") for k, url, lines in pages]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = set()
    for ranges in (1, 4, 25):
        got = extraction.extract_text(df.repartition(3), ranges=ranges).collect()
        assert sorted((r.page_id, r.paired_with, r.n_shared_lines, r.n_open_lines - r.n_shared_lines) for r in got) == _brute(pages), ranges
        texts.add(tuple(sorted((r.page_id, r.text) for r in got)))
    assert len(texts) == 1


def test_one_run_of_copies_over_all_ranges(spark):
    page = lambda own: f"<body><div>Site</div><div>{own}</div></body>"
    rows = [(0, "http://h.org/a", page("First"))] + [(k, f"http://h.org/b/{k:03d}", page("Copy")) for k in range(1, 60)] + [(60, "http://h.org/c", page("Last")), (None, "http://h.org/c", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for ranges in (1, 12):
        got = extraction.extract_text(df, ranges=ranges).collect()
        assert len(got) == 62 and {r.text for r in got if r.page_id and 0 < r.page_id < 60} == {"Copy"}
        assert {r.paired_with for r in got if r.page_id and 0 < r.page_id < 60} == {0}
        assert [(r.text, r.n_chars) for r in got if r.page_id is None] == [("", 0)]
    empty = extraction.extract_text(df.limit(0), ranges=3)
    assert empty.count() == 0 and empty.columns[:4] == ["page_id", "url", "text", "n_chars"]

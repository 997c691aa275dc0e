"""Archives: an empty table, pages longer than a batch, more records than a file holds."""

import hashlib

from hourloom.durable import scratch_path
from hourloom.llm import archives


def _round_trip(spark, rows, per_file=2000, version=1):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    archives.write_arc(pages, arc, version, per_file)
    archives.convert(archives.read_arc(spark, arc), warc, per_file)
    return archives.read_warc(spark, warc).collect()


def test_empty_table(spark):
    assert _round_trip(spark, []) == []


def test_long_pages_and_full_files(spark, monkeypatch):
    monkeypatch.setattr(archives, "BATCH_CHARS", 1000)
    long = "<p>é\r\n\r\nWARC/1.1\n</p>" * 120_000
    rows = [(1, "u1", long), (2, "u2", long), (3, None, None), (4, "u 4", "x")] + [(10 + i, f"v{i}", "y" * i) for i in range(60)]
    for version in (1, 2):
        got = {r.page_id: r for r in _round_trip(spark, rows, per_file=7, version=version)}
        assert len(got) == len(rows)
        for page_id, _, html in rows:
            body = (html or "").encode()
            assert (got[page_id].payload_bytes, got[page_id].payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert (got[1].record_type, got[1].refers_to, got[2].record_type, got[2].refers_to) == ("revisit", 2, "response", None)

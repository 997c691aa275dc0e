"""Decoding of stored piece ids gives back every text."""

import pytest

from hourloom.llm import pieces


def test_round_trip_of_stored_ids(spark, tmp_path):
    texts = ["", "plain words here", "Ünï▁code \U0001f600\n\n tabs\t end ", "x" * 70000, "many words " * 30000, "\u0000odd"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "no id"), (3, None)], "doc_id long, text string").selectExpr("*", "'s' as source", "doc_id as ids")
    path = str(tmp_path / "coded")
    pieces.sample_pieces(docs, carried=["source", "ids"][:1]).write.parquet(path)
    stored = spark.read.parquet(path)
    assert stored.columns == ["doc_id", "n_pieces", "ids", "ids_sha256", "lossless", "source"] and stored.where("source <> 's' or not lossless").count() == 0
    got = pieces.decode_pieces(stored.withColumn("text", pieces.F.lit("clash"))).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([*((str(i), t) for i, t in enumerate(texts)), ("None", "no id"), ("3", "")])


def test_null_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode_pieces(rows).collect()} == {1: None, 2: ""}
    for bad in ([10**6], [-1], [None]):
        with pytest.raises(Exception, match="piece id"):
            pieces.decode_pieces(spark.createDataFrame([(1, bad)], "doc_id long, ids array<int>")).collect()

"""The near dedup stage of the pipeline takes its verdict back to rows by identifier and text."""

import corpus_pipeline as C

from .test_near_keys import LONG, OTHER, _frame, _near


def test_stage_judges_rows_not_identifiers(spark, tmp_path):
    rows = [(1, LONG), (5, _near(LONG)), (5, OTHER), (None, _near(LONG, 9)), (7, "x y z x y"), (7, "x y z x y"), (8, ""), (None, "")]
    got = C.near_stage(spark, _frame(spark, rows), str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("1", LONG), ("5", OTHER), ("7", "x y z x y"), ("8", ""), ("None", "")])

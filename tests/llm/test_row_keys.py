"""Null and repeated ids in exact and line deduplication."""

from helixlake.llm import exact_dedup, line_dedup

SCHEMA = "doc_id long, text string"


def test_every_text_keeps_a_row(spark):
    rows = [(None, "alone"), (None, "two"), (1, "two"), (2, "x"), (2, "y"), (2, "y"), (None, None), (None, ""), (None, "alone"), (3, "x")]
    got = exact_dedup.drop_exact_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.text or "", r.doc_id) for r in got) == [("", None), ("alone", None), ("two", 1), ("x", 3), ("y", 2)]


def test_lines_are_dropped_by_row(spark):
    rows = [(i, f"common\nown {i}") for i in range(9)] + [(20, "common\na"), (20, "b\ncommon"), (20, "b\ncommon"), (None, "c\ncommon\nd"), (None, None)]
    got = line_dedup.drop_common_lines(spark.createDataFrame(rows, SCHEMA)).filter("doc_id IS NULL OR doc_id = 20").collect()
    want = [("", 1, 0), ("a", 2, 1), ("b", 2, 1), ("b", 2, 1), ("c\nd", 3, 1)]
    assert sorted((r.kept_text, r.n_lines, r.n_dropped) for r in got) == want

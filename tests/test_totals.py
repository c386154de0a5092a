"""Rows of totals in sheets."""

from tabdelta.operators.tables import totals_rows


def test_only_rows_with_a_label_are_gone_through(spark):
    """First cells are sought in rows with a total's label alone; a label further on in a row is none."""
    rows = [(0, 0, (2, None, "Total", None)), (0, 1, (1, 5.0, None, None)), (1, 0, (1, 1.0, None, None)), (1, 1, (2, None, "Total", None)), (2, 0, (0, None, None, None)), (2, 1, (2, None, " sub total ", None)), (3, 0, (2, None, "Totally", None))]
    found = totals_rows(spark.createDataFrame(rows, "r long, c int, cell struct<kind:tinyint,num:double,text:string,formula:string>"))
    assert sorted(map(tuple, found.collect())) == [(0, "Total"), (2, "sub total")]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()

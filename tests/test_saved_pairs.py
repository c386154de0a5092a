"""Pairs of rows that followed formulas read are worked out once."""

from tabdelta.operators.compare import compare_sheets

from .test_follow import register


def test_pairs_and_moves_are_read_from_files(spark):
    """each reader of the pairs shuffled both tables again."""
    names = [f"n{k}" for k in range(8)]
    found = compare_sheets(register(spark, names), register(spark, ["n99", *names[:3], *names[4:]]))
    files = found.diff.pairs.inputFiles()
    states = {r["key"]: r["state"] for r in found.diff.row_states.collect()}
    found.close()
    assert all(any(f"/{name}-" in f for f in files) for name in ("pairs", "moves"))
    assert states == {**{n: "unchanged" for n in names}, "n3": "removed", "n99": "added"}

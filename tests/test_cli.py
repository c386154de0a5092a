import json

import pytest

from tabdelta import cli


def write(path, text):
    path.write_text(text)
    return str(path)


def test_compare(spark, tmp_path, capsys):
    old = write(tmp_path / "old.csv", "id;qty;who\n1;5;ann\n2;6;bob\n3;7;cy\n")
    new = write(tmp_path / "new.csv", "id;qty;who\n1;5;ann\n2;60;bob\n4;1;di\n")
    assert cli.main(["compare", old, new, "--key", "id", "--json"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["key"] == ["id"] and got["counts"]["real_changes"] == 3 and got["counts"]["rows_added"] == 1
    assert "qty of 2: 6 → 60." in got["findings"]["medium"]
    assert cli.main(["compare", old, new]) == 0 and "3 real change(s), 0 need attention." in capsys.readouterr().out


def test_merge(spark, tmp_path, capsys):
    base = write(tmp_path / "b.csv", "id,p\n1,10\n2,20\n3,30\n")
    a = write(tmp_path / "a.csv", "id,p\n1,11\n2,21\n3,30\n")
    b = write(tmp_path / "c.csv", "id,p\n1,10\n2,22\n4,40\n")
    out = str(tmp_path / "out")
    assert cli.main(["merge", base, a, b, "--key", "id", "--out", out]) == 1
    assert "MERGE_UNRESOLVED" in capsys.readouterr().err
    assert cli.main(["merge", base, a, b, "--key", "id", "--out", out, "--resolve", "CELL:Sheet1:2:p=Copy 2"]) == 0
    assert sorted(tuple(r) for r in spark.read.parquet(f"{out}/table").collect()) == [(1, 11), (2, 22), (4, 40)]
    assert {r.decision for r in spark.read.parquet(f"{out}/log").collect()} == {"auto", "resolved: B"}
    assert cli.main(["merge", base, a, b, "--key", "id", "--out", out, "--resolve", "nothing"]) == 2


@pytest.mark.parametrize(("text", "want"), [("CELL:s:k=v:p=A", ("CELL:s:k=v:p", "A", None, None)), ("x=both:K9", ("x", "both", None, "K9")), ("x=Keep Edits", ("x", "keepEdits", None, None)), ("x=typed:5", ("x", "typed", "5", None))])
def test_answers(text, want):
    assert cli.parse_answer(text) == want

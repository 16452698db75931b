"""Rows that do not keep to a pinned schema leave a trace."""

import json

from threatloom.sources import datasets, sinks

SCHEMA = "a int, `b.c` double, t string"


def test_malformed_cells_and_lines_are_rejected_with_their_reason(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b.c,t\n1,2.5,x\none,2.5,y\n3,,nan\n4,1e3,z,more\n5\n6,2..5,q\n-,7.0,?\n")
    checked = datasets.read_checked(spark, str(tmp_path / "x.csv"), SCHEMA)
    rows, rejected = datasets.split_rejected(checked)
    assert rows.columns == ["a", "b.c", "t"]
    kept = {r["a"]: tuple(r)[1:] for r in rows.collect()}
    assert kept[1] == (2.5, "x") and kept[3][0] is None and set(kept) <= {1, 3, None}
    found = rejected.collect()
    cells = sorted(sorted(r["cells"].items()) for r in found if r["line"] is None)
    assert [("a", "one")] in cells and [("b.c", "2..5")] in cells
    assert {r["line"] for r in found} - {None} == {"4,1e3,z,more", "5"}
    assert rows.count() + len(found) == 7 and all(r["file"].endswith("x.csv") for r in found)
    sinks.write_rejected(rejected, str(tmp_path / "rejected"))
    lines = [json.loads(line) for p in (tmp_path / "rejected").glob("*.json") for line in p.read_text().splitlines()]
    assert len(lines) == len(found) and all("@timestamp" in line for line in lines)


def test_a_table_that_was_not_checked_has_no_rejected_rows(spark):
    rows, rejected = datasets.split_rejected(spark.range(3))
    assert rows.count() == 3 and rejected.count() == 0

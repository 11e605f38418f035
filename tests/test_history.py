"""Incremental loads of the match history."""

import pytest

from formline.sinks import history as H

ROW = "Date string, Home string, Away string, HG int, source_file string"


def load(spark, path, rows, batch, schema=ROW):
    return H.append_batch(spark, path, spark.createDataFrame(rows, schema), batch)


def read(spark, path):
    return sorted((r["Date"], r["Home"], r["HG"]) for r in H.read_history(spark, path).collect())


def test_only_new_rows_are_added_and_repeated_loads_add_none(spark, tmp_path):
    path = str(tmp_path / "h")
    first = [("01/02/2026", "A", "B", 1, "f1"), ("01/02/2026", "A", "B", 1, "f1"), (None, "A", "C", 2, "f1"), ("", "A", "D", 2, "f1"), ("odd", "E", "F", 3, None)]
    assert load(spark, path, first, "one") == 3  # repeats inside a load stay
    second = [("01/02/2026", "A", "B", 9, "f2"), ("odd", "E", "F", 9, "f2"), ("02/02/2026", "A", "B", 4, "f3"), ("05/03/2026", "G", "H", 5, "f4")]
    assert load(spark, path, second, "two") == 2
    assert load(spark, path, second, "two") == 0  # committed: not looked at
    assert load(spark, path, second, "three") == 0  # nothing new
    assert read(spark, path) == sorted([("01/02/2026", "A", 1)] * 2 + [("odd", "E", 3), ("02/02/2026", "A", 4), ("05/03/2026", "G", 5)])
    assert [(c["batch"], c["n_new"], c["files"]) for c in H.commits(spark, path)] == [("one", 3, ["f1"]), ("two", 2, ["f3", "f4"]), ("three", 0, [])]


def test_a_load_that_broke_off_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "h")
    load(spark, path, [("01/02/2026", "A", "B", 1, "f")], "one")
    import pyspark.sql.readwriter as rw
    original = rw.DataFrameWriter.json
    monkeypatch.setattr(rw.DataFrameWriter, "json", lambda *a, **k: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        load(spark, path, [("02/02/2026", "C", "D", 2, "f")], "two")
    monkeypatch.setattr(rw.DataFrameWriter, "json", original)
    assert read(spark, path) == [("01/02/2026", "A", 1)]
    assert load(spark, path, [("02/02/2026", "C", "D", 2, "f")], "two") == 1
    assert len(read(spark, path)) == 2


def test_keys_are_compared_with_the_months_of_the_load_only(spark, tmp_path):
    path = str(tmp_path / "h")
    load(spark, path, [(f"01/{m:02d}/2026", "A", "B", m, "f") for m in range(1, 13)], "one")
    plan = H.read_history(spark, path, ["2026-03"])._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "2026-03" in plan.split("PartitionFilters: [")[1].split("], ")[0] and "month" in filters
    assert H.read_history(spark, path, ["2026-03"]).count() == 1


def test_new_columns_come_last(spark, tmp_path):
    path = str(tmp_path / "h")
    load(spark, path, [("01/02/2026", "A", "B", 1, "f")], "one")
    load(spark, path, [("2026-02-07", "A", "B", "L")], "two", "Date string, Home string, Away string, League string")
    df = H.read_history(spark, path)
    assert df.columns == ["Date", "Home", "Away", "HG", "League"]
    assert sorted((r["Date"], r["HG"], r["League"]) for r in df.collect()) == [("01/02/2026", 1, None), ("2026-02-07", None, "L")]


def test_empty_loads(spark, tmp_path):
    path = str(tmp_path / "h")
    with pytest.raises(ValueError, match="no history"):
        H.read_history(spark, path)
    assert load(spark, path, [(None, "A", "B", 1, "f")], "nothing") == 0
    assert load(spark, path, [("01/02/2026", "A", "B", 1, "f")], "one") == 1
    assert len(read(spark, path)) == 1

import datetime as dt

import pytest

from cellflow.config import Config, resolve
from cellflow.sources import io


def test_month_files_and_drift(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "k long, x long").write.parquet(str(tmp_path / "log_2024-01.parquet"))
    spark.createDataFrame([(1.0, 2.5)], "k double, x double").write.parquet(str(tmp_path / "log_2024-02.parquet"))
    found = io.month_files(spark, str(tmp_path), dt.date(2024, 1, 1), dt.date(2024, 2, 1), "log")
    assert list(found) == [dt.date(2024, 1, 1), dt.date(2024, 2, 1)]
    got = io.drifting(spark, list(found.values()), {"k": "long", "x": "double"}).orderBy("x").collect()
    assert [tuple(r) for r in got] == [(1, 2.0), (1, 2.5)]
    with pytest.raises(FileNotFoundError):
        io.month_files(spark, str(tmp_path), dt.date(2024, 1, 1), dt.date(2024, 3, 1))
    with pytest.raises(ValueError):
        io.drifting(spark, list(found.values()), {"missing": "long"})


def test_lookup_with_a_mark(spark, tmp_path):
    path = tmp_path / "cells.csv"
    path.write_bytes("﻿Cell;Room\n1;A\n2;B\n".encode())
    assert [tuple(r) for r in io.lookup_csv(spark, str(path), ["Cell", "Room"]).collect()] == [("1", "A"), ("2", "B")]
    with pytest.raises(ValueError):
        io.lookup_csv(spark, str(path), ["Group"])


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([(2, "a|b"), (1, None)], "k int, t string")
    io.write_parquet(f, str(tmp_path / "p"))
    assert io.columns_of(spark, str(tmp_path / "p")) == ["k", "t"]
    io.write_csv(f, str(tmp_path / "c"))
    assert io.written_csv(spark, str(tmp_path / "c"), "k int, t string").count() == 2
    io.report_csv(f, str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    assert "a\\|b" in io.report("Title", {"Rows": f, "Note": "text\n"})
    assert [r["k"] for r in io.sample(f, ["k"], 1).collect()] == [1]


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("gap: 6\nbands: [[1, 2], [3, 4]]\n")
    c = Config.load(tmp_path / "c.yaml")
    assert c.gap == 6 and c.bands == ((1, 2), (3, 4)) and c.window == 7
    (tmp_path / "d.yaml").write_text("gpa: 6\n")
    with pytest.raises(ValueError):
        Config.load(tmp_path / "d.yaml")
    assert resolve("x", tmp_path) == tmp_path / "x"
    assert [m.month for m in io.months(dt.date(2023, 11, 5), dt.date(2024, 2, 1))] == [11, 12, 1, 2]

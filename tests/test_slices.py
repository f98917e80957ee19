"""Slices change whole or not at all, and their columns are known without their files."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from spendlens.schema import PASSES
from spendlens.sinks import slices
from spendlens.sinks.tables import write_pass
from spendlens.sources import warehouse as wh
from spendlens.streaming import resume
from tests.test_pipeline import insight, land, small_daily

BASE = PASSES["base"]


def stored(spark, root):
    return sorted((r["month"], r["ad_id"], r["spend"]) for r in wh.scan_pass(spark, root, BASE).select("month", "ad_id", "spend").collect())


def test_a_writer_that_dies_before_publishing_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "raw")
    write_pass(small_daily(spark, ["2024-01-05", "2024-02-05"]), root)
    before = stored(spark, root)
    open_reader = wh.scan_pass(spark, root, BASE)

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(slices, "publish", die)
        with pytest.raises(KeyboardInterrupt):
            write_pass(small_daily(spark, ["2024-02-06", "2024-02-07"], 9.0), root)
    assert len(os.listdir(f"{root}/pass=base/month=2024-02")) == 2  # the new files lie there, unnamed
    assert stored(spark, root) == before
    assert slices.sweep(spark, root) == 1 and stored(spark, root) == before
    write_pass(small_daily(spark, ["2024-02-06"], 9.0), root)
    assert stored(spark, root) == [("2024-01", "ad0", 1.0), ("2024-02", "ad0", 9.0)]
    assert sorted(r["spend"] for r in open_reader.collect()) == [1.0, 1.0]  # a reader from before still has its files
    assert slices.sweep(spark, root) == 1 and stored(spark, root)[1][2] == 9.0


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    root = str(tmp_path / "raw")
    write_pass(small_daily(spark, ["2024-01-05"]), root)
    with pytest.raises(RuntimeError, match="another writer"):
        slices.publish(spark, root, {}, 0)


def test_views_open_no_footer(spark, tmp_path):
    root = str(tmp_path / "raw")
    write_pass(small_daily(spark, ["2024-01-05"]).drop("campaign_name"), root)
    write_pass(small_daily(spark, ["2024-02-05"]), root)
    for path in glob.glob(f"{root}/pass=*/month=*/v=*/*.parquet"):
        with open(path, "r+b") as f:
            f.truncate(4)
    df = wh.scan_pass(spark, root, BASE)
    assert {"campaign_name", "ad_id", "spend", "pass", "month"} <= set(df.columns) and "v" not in df.columns
    with pytest.raises(Exception):
        df.collect()


def test_months_of_other_types_stay_readable(spark, tmp_path):
    root = str(tmp_path / "raw")
    write_pass(small_daily(spark, ["2024-01-05"]).withColumn("spend", F.lit(3)), root)
    write_pass(small_daily(spark, ["2024-02-05"], 2.5), root)
    got = {r["month"]: float(r["spend"]) for r in wh.scan_pass(spark, root, BASE).collect()}
    assert got == {"2024-01": 3.0, "2024-02": 2.5}


def test_a_unit_is_rebuilt_once_a_run_and_a_dead_run_is_taken_up(spark, tmp_path, monkeypatch):
    landing, root, state = tmp_path / "landing", str(tmp_path / "raw"), str(tmp_path / "state")
    for k in range(3):
        land(landing, [insight(str(k), f"2024-01-0{k + 1}")], "2024-01", f"{k}.json")
    rebuilt = []
    whole = resume.rebuild_units

    def counting(spark, landing, units, root):
        rebuilt.append(sorted(units))
        if len(rebuilt) == 1:
            raise KeyboardInterrupt
        whole(spark, landing, units, root)

    monkeypatch.setattr(resume, "rebuild_units", counting)
    with pytest.raises(KeyboardInterrupt):
        resume.ingest(spark, str(landing), root, state, files_per_batch=1)
    resume.ingest(spark, str(landing), root, state)  # nothing new has landed
    assert rebuilt == [[("base", "2024-01")]] * 2
    assert wh.scan_pass(spark, root, BASE).count() == 3
    resume.ingest(spark, str(landing), root, state)
    assert len(rebuilt) == 2

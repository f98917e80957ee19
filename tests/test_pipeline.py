"""Ingestion, storage, streaming, plans and the registered queries."""

import json
import os

import pytest
from pyspark.sql import functions as F

from spendlens.plans import star
from spendlens.schema import FUNNEL_ACTIONS, PASSES, pass_schema
from spendlens.sinks.tables import ids_as_text, write_csv, write_pass
from spendlens.sources import insights as ins
from spendlens.sources import warehouse as wh
from spendlens.streaming import resume

BASE = PASSES["base"]


def insight(ad, day, actions=None, **extra):
    row = {"ad_id": ad, "campaign_id": "c1", "date_start": day, "spend": "1.5", "impressions": "10"}
    if actions is not None:
        row["actions"] = [{"action_type": t, "value": v} for t, v in actions]
    return {**row, **extra}


def land(folder, rows, month, name="a.json"):
    path = folder / "pass=base" / f"month={month}"
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_flatten_traps(spark, tmp_path):
    rows = [
        insight("1", "2024-01-02", [("purchase", "2"), ("purchase", "3.5"), ("lead", "x"), (None, "4"), ("", "5"), ("mystery", "7")]),
        insight("2", "not a day", []),
        insight("3", "2024-01-03", spend="abc", impressions=None),
    ]
    (tmp_path / "x.json").write_text("\n".join(json.dumps(r) for r in rows))
    flat = ins.flatten(ins.read_insights(spark, str(tmp_path)), BASE)
    assert {f.name: f.dataType for f in flat.schema} == {f.name: f.dataType for f in pass_schema(BASE)}
    out = {r["ad_id"]: r for r in flat.collect()}
    assert out["1"]["purchase"] == 4  # last duplicate wins, then half-even rounding
    assert out["1"]["lead"] is None and out["1"]["comment"] is None
    assert out["2"]["date"] is None and out["2"]["actions_raw"] is None
    assert out["3"]["spend"] is None and out["3"]["actions_raw"] is None
    found = ins.recovered_actions(flat.select("ad_id", "actions_raw")).where("action_type = 'mystery'").collect()
    assert [(r["ad_id"], r["value"]) for r in found] == [("1", 7.0)]


def test_last_duplicate_helper(spark):
    df = spark.createDataFrame([([("a", "1"), ("a", "bad"), ("b", "2"), ("a", "3")],)], "actions array<struct<action_type:string,value:string>>")
    row = df.select(ins.action_value(F.col("actions"), "a").alias("a"), ins.action_index(F.col("actions")).alias("m")).first()
    assert row["a"] == 3.0 and row["m"] == {"a": 3.0, "b": 2.0}


def small_daily(spark, days, spend=1.0):
    rows = [("base", d, f"ad{i}", "c", "Evento #45 x", spend) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "pass_name string, date string, ad_id string, campaign_id string, campaign_name string, spend double")
    return df.withColumn("date", F.col("date").cast("date"))


def test_write_pass_replaces_only_its_slices(spark, tmp_path):
    root = str(tmp_path / "raw")
    write_pass(small_daily(spark, ["2024-01-05", "2024-02-05", "2024-02-06"]), root)
    before = sorted(os.listdir(f"{root}/pass=base/month=2024-01"))
    write_pass(small_daily(spark, ["2024-02-07"], 9.0), root)
    write_pass(small_daily(spark, ["2024-02-07"]).where("false"), root)
    got = {r["month"]: (r["n"], r["s"]) for r in wh.scan_pass(spark, root, BASE).groupBy("month").agg(F.count("*").alias("n"), F.sum("spend").alias("s")).collect()}
    assert got == {"2024-01": (1, 1.0), "2024-02": (1, 9.0)}
    assert sorted(os.listdir(f"{root}/pass=base/month=2024-01")) == before


def test_narrow_month_is_reconciled_and_views_follow(spark, tmp_path):
    root = str(tmp_path / "raw")
    wide = small_daily(spark, ["2024-02-05"])
    for a in (*FUNNEL_ACTIONS, "impressions", "ctr", "ad_name"):
        wide = wide.withColumn(a, F.lit(None).cast("string" if a == "ad_name" else "double"))
    write_pass(small_daily(spark, ["2024-01-05"]), root)
    write_pass(wide.withColumn("purchase", F.lit(2.0)), root)
    created = wh.register_views(spark, root)
    assert created == ["ads_daily", "funnel_by_month", "ad_lifecycle"]
    assert wh.available(spark, ["ads_daily", "ads_by_region"]) == ["ads_daily"]
    got = {str(r["month"]): r["purchase"] for r in spark.table("funnel_by_month").collect()}
    assert got == {"2024-01-01": None, "2024-02-01": 2.0}  # no data stays null


def test_scan_prunes_partitions_and_columns(spark, tmp_path):
    root = str(tmp_path / "raw")
    write_pass(small_daily(spark, ["2024-01-05", "2024-02-05"]), root)
    df = wh.scan_pass(spark, root, BASE).where("month = '2024-02' AND spend > 0").select("ad_id")
    plan = df._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "PushedFilters: [IsNotNull(spend), GreaterThan(spend,0.0)]" in plan
    assert "ReadSchema: struct<ad_id:string,spend:double>" in plan


def test_csv_drops_raw_payload(spark, tmp_path):
    df = spark.createDataFrame([("1", "[]")], "ad_id string, actions_raw string")
    write_csv(df, str(tmp_path / "slim"))
    write_csv(df, str(tmp_path / "full"), full=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "slim")).columns == ["ad_id"]
    assert spark.read.option("header", True).csv(str(tmp_path / "full")).columns == ["ad_id", "actions_raw"]


def test_csv_doubles_quotes(spark, tmp_path):
    write_csv(spark.createDataFrame([('say "hi", you',)], "note string").coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_text()
    assert text == 'note\n"say ""hi"", you"\n'


def test_units_replace_their_own_slice_only(spark, tmp_path):
    """A July file with a row of August, and files with unreadable dates."""
    landing, root = tmp_path / "landing", str(tmp_path / "raw")
    land(landing, [insight("1", "2001-07-03"), insight("2", "2001-08-01"), insight("3", "never")], "2001-07")
    land(landing, [insight("4", "2001-08-02"), insight("5", "2001-08-03"), insight("6", "never")], "2001-08")
    resume.refresh(spark, str(landing), root, ["2001-07", "2001-08", "2001-09"], ["base", "region"])
    resume.refresh(spark, str(landing), root, ["2001-07"], ["base"])

    def stored():
        return sorted((r["month"], r["ad_id"]) for r in wh.scan_pass(spark, root, BASE).select("month", "ad_id").collect())

    assert stored() == [("2001-07", x) for x in "123"] + [("2001-08", x) for x in "456"]
    other = landing / "pass=unheard" / "month=2001-07"
    other.mkdir(parents=True)
    (other / "a.json").write_text("{}")
    with pytest.raises(Exception, match="unheard"):
        resume.ingest(spark, str(landing), root, str(tmp_path / "state"))
    with pytest.raises(Exception, match="unheard"):  # the failed batch is not taken as done
        resume.ingest(spark, str(landing), root, str(tmp_path / "state"))


def test_stream_reads_a_batch_once(spark, tmp_path):
    landing = tmp_path / "landing"
    for month in ("2024-01", "2024-02"):
        land(landing, [insight(str(i), f"{month}-02") for i in range(5)], month)
    query = resume.ingest(spark, str(landing), str(tmp_path / "raw"), str(tmp_path / "state"))
    assert sum(p["numInputRows"] for p in query.recentProgress) == 10


def test_stream_resumes_and_corrects(spark, tmp_path):
    landing, root, state = tmp_path / "landing", str(tmp_path / "raw"), str(tmp_path / "state")
    land(landing, [insight("1", "2024-01-02"), insight("2", "2024-01-03")], "2024-01")
    land(landing, [insight("1", "2024-02-02")], "2024-02")

    def counts():
        return {r["month"]: r["count"] for r in wh.scan_pass(spark, root, BASE).groupBy("month").count().collect()}

    resume.ingest(spark, str(landing), root, state, files_per_batch=1)
    assert counts() == {"2024-01": 2, "2024-02": 1}
    january = sorted(os.listdir(f"{root}/pass=base/month=2024-01"))
    land(landing, [insight("9", "2024-02-09")], "2024-02", "late.json")
    resume.ingest(spark, str(landing), root, state)
    resume.ingest(spark, str(landing), root, state)
    assert counts() == {"2024-01": 2, "2024-02": 2}
    assert sorted(os.listdir(f"{root}/pass=base/month=2024-01")) == january
    land(landing, [insight("1", "2024-02-02", spend="8")], "2024-02")
    resume.refresh(spark, str(landing), root, ["2024-02"], ["base"])
    total = wh.scan_pass(spark, root, BASE).where("month = '2024-02'").agg(F.sum("spend")).first()[0]
    assert total == 9.5


def test_star_pieces(spark):
    daily = small_daily(spark, ["2024-01-05", "2024-01-08"])
    dim = star.dim_campaign(daily).first()
    assert dim["event_id"] == "45" and dim["n_ads"] == 2
    days = star.dim_date(daily).orderBy("date").collect()
    assert len(days) == 4 and days[1]["day_name"] == "Saturday" and days[1]["is_weekend"]
    assert days[0]["month_label"] == "Jan 2024" and days[0]["week"] == 1
    long_id = spark.createDataFrame([(123456789012345678,)], "ad_id bigint")
    assert ids_as_text(long_id).first()["ad_id"] == "123456789012345678"


SMALL = "/root/testdata/sf0.001"
PICKED = [
    "agg1_funnel_by_month", "agg16_fatigue_profile", "sta9_exact_auc", "sta5_cluster_bootstrap_multinomial",
    "sta5_cluster_bootstrap_poisson", "seg5_placement_ranking", "rea3_reallocation_totals", "tri4_feature_frame",
    "tri9_decision_curve", "txt10_has_urgency", "img1_7_image_features", "agg10_fact_hourly", "prj1_flatten_insight",
]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")
@pytest.mark.parametrize("key", PICKED)
def test_registered_query_equals_sql(spark, key):
    import duckdb

    from bindings import catalogue
    from bindings.check import TABLES, compare

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    _, note = compare(key, catalogue.queries()[key], catalogue.oracle_sql()[key], spark, con, SMALL)
    assert note.startswith("ok"), note


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) >= 120

"""What a ranking and a star leave on disk, and that their tables are whole."""

import datetime as dt
import os
import time

from pyspark.sql import functions as F

from bindings import tables as tb
from bindings.q_segments import FAMILY_SPECS
from spendlens.operators.sharing import discard, settled
from spendlens.plans import star
from spendlens.session import _CLEANUP, scope
from spendlens.sinks.tables import write_table


def shuffled(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {str(blocks.apply(i).name()) for i in range(blocks.size()) if str(blocks.apply(i).name()).startswith("shuffle")}


def left_over(spark, before):
    """Shuffle files that are there and were not before; Spark removes them in another thread."""
    for _ in range(50):
        if not (left := shuffled(spark) - before):
            break
        time.sleep(0.2)
    return left


def small_tables(spark, root):
    """Lines of six parts, two orders a day, all segments of every family."""
    day = lambda i: dt.datetime(2024, 1, 1 + i % 28, i % 24)
    rows = {
        "customer": ([(i, i % 4, f"age{i % 2}") for i in range(8)], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "nation": ([(i, f"n{i}") for i in range(4)], "n_nationkey int, n_name string"),
        "part": ([(i, f"name{i}", f"Brand#{i % 2 + 1}1", "t", i) for i in range(6)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "orders": ([(i, i % 8, f"p{i % 2}") for i in range(56)], "o_orderkey long, o_custkey long, o_orderpriority string"),
        "lineitem": (
            [(i % 56, i % 6, 1 + i % 3, 5.0, 100.0 + i, 0.05, "ARN"[i // 7 % 3], "OF"[i % 2], day(i)) for i in range(600)],
            "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double,"
            " l_returnflag string, l_linestatus string, l_shipdate timestamp",
        ),
        "events": ([(day(i), i, ("click", "signup", "view")[i % 3], 1.0 + i % 5) for i in range(600)], "ts timestamp, user_id long, event_type string, value double"),
    }
    for name, (some, schema) in rows.items():
        spark.createDataFrame(some, schema).write.parquet(f"{root}/{name}.parquet")
    return str(root)


def test_copies_leave_no_shuffle_files(spark, tmp_path):
    before = shuffled(spark)
    counted = settled(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    write_table(counted.repartition(3, "k"), f"{tmp_path}/t")
    assert not left_over(spark, before)
    assert spark.conf.get(_CLEANUP, "false") == "false"
    assert counted.count() == 7 and spark.read.parquet(f"{tmp_path}/t").count() == 7


def test_discard(spark):
    with scope(spark) as owned:
        one, two = settled(spark.range(3), "one"), settled(spark.range(4), "two", task_bytes=100)
        discard(one)
        assert [os.path.exists(p) for p in owned.paths] == [False, True] and two.count() == 4


def test_families_store_neither_views_nor_units(spark, tmp_path):
    d = small_tables(spark, tmp_path)
    with scope(spark) as owned:
        stacked = star.segment_statistics(tb.views(spark, d), FAMILY_SPECS, n_boot=20, mode="poisson")
        got = {r["dimension"]: r["n"] for r in stacked.groupBy("dimension").agg(F.count(F.lit(1)).alias("n")).collect()}
        kept = {os.path.basename(p).rsplit("-", 1)[0] for p in owned.paths if os.path.exists(p)}
    assert set(got) == set(FAMILY_SPECS) and got["region"] == 4 and got["device"] == 2
    assert kept == {"segments", "inferred", "scored"}


def test_star_stores_its_own_tables_only(spark, tmp_path):
    d = small_tables(spark, tmp_path)
    before = shuffled(spark)
    with scope(spark) as owned:
        views = tb.views(spark, d)
        paths = star.export_star(star.star_tables(views, skip_stats=True), f"{tmp_path}/star")
        assert not left_over(spark, before)
        assert {os.path.basename(p).rsplit("-", 1)[0] for p in owned.paths} == {"ads"}
        for name, view in (("fact_daily", "ads_daily"), ("fact_placement", "ads_by_placement")):
            back, want = spark.read.parquet(paths[name]), views[view]
            assert [back.count(), back.agg(F.sum("spend")).first()[0]] == [want.count(), want.agg(F.sum("spend")).first()[0]]
        days = spark.read.parquet(paths["dim_date"])
        assert days.count() == 28 and days.agg(F.min("date")).first()[0] == dt.date(2024, 1, 1)


def test_dimensions_of_ads_with_several_names(spark):
    """An ad under two names and in two campaigns, null names, null days: still one row an ad, one ad a campaign."""
    day = lambda n: dt.date(2024, 1, n)
    rows = [
        ("c1", "B", "a1", "y", "s2", "t", day(3), 1.0), ("c1", "A", "a1", "x", "s1", None, day(5), 2.0), ("c1", None, "a1", None, None, "t", day(1), None),
        ("c2", "Z", "a1", "x", "s1", "t", None, 4.0), ("c2", "Z", None, "n", "s1", "t", day(2), 8.0), (None, None, "a2", "q", "s3", "u", day(9), 16.0),
    ]
    daily = spark.createDataFrame(rows, "campaign_id string, campaign_name string, ad_id string, ad_name string, adset_id string, adset_name string, date date, spend double")
    want = [(None, None, day(9), day(9), 1, 16.0), ("c1", "A", day(1), day(5), 1, 3.0), ("c2", "Z", day(2), day(2), 1, 12.0)]
    columns = ["campaign_id", "campaign_name", "first_day", "last_day", "n_ads", "total_spend"]
    ads = [(None, "n", "s1", "t", "c2", day(2), day(2), 1), ("a1", "x", "s1", "t", "c1", day(1), day(5), 4), ("a2", "q", "s3", "u", None, day(9), day(9), 1)]
    order = lambda found: sorted(map(tuple, found), key=lambda r: r[0] or "")
    for campaigns, each in ((star.dim_campaign(daily), star.dim_ad(daily)), (star.campaigns_of(star.ad_totals(daily)), star.ads_of(star.ad_totals(daily)))):
        assert order(campaigns.select(columns).collect()) == want
        assert order(each.select("ad_id", "ad_name", "adset_id", "adset_name", "campaign_id", "first_day", "last_day", "active_days").collect()) == ads

"""Ingestion, storage and catalog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import tables as tb
from bindings.registry import query
from spendlens.operators.creative import delivered_creatives
from spendlens.operators.funnel import ad_lifecycle, funnel_by_period
from spendlens.schema import CREATIVE_SOURCE_SCHEMA, FUNNEL_ACTIONS, PASSES, insight_schema
from spendlens.session import scratch_path
from spendlens.sinks.tables import write_csv, write_pass, write_table
from spendlens.sources import creatives as cr
from spendlens.sources import insights as ins
from spendlens.sources import warehouse as wh
from spendlens.streaming import resume

TYPE = (
    "CASE WHEN l_linenumber % 5 = 0 THEN NULL WHEN l_returnflag = 'R' THEN 'initiate_checkout'"
    " WHEN l_returnflag = 'A' THEN 'add_to_cart' WHEN l_linestatus = 'F' THEN 'link_click'"
    " ELSE 'custom_event' END"
)
VALUE = (
    "CASE WHEN l_suppkey % 9 = 0 THEN 'bad' WHEN l_suppkey % 9 = 1 THEN NULL"
    " ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) || '.5' END"
)


def insight_rows(spark, d):
    """Orders as nested insight objects, with every defect a landed row may have."""
    act = F.struct(
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        F.expr(TYPE).alias("action_type"),
        F.expr(VALUE).alias("value"),
    )
    lists = (
        tb.load(spark, d, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sort_array(F.collect_list(act)).alias("a"))
        .select(
            "l_orderkey",
            F.transform("a", lambda x: F.struct(x["action_type"].alias("action_type"), x["value"].alias("value"))).alias("actions"),
        )
    )
    key = F.col("o_orderkey")
    return (
        tb.load(spark, d, "orders")
        .join(lists, key == F.col("l_orderkey"), "left")
        .select(
            F.concat(F.lit("c"), F.col("o_custkey") % 50).alias("campaign_id"),
            F.concat(F.lit("Campaign "), F.col("o_custkey") % 50).alias("campaign_name"),
            F.lit(None).cast("string").alias("adset_id"),
            F.lit(None).cast("string").alias("adset_name"),
            key.cast("string").alias("ad_id"),
            F.col("o_orderpriority").alias("ad_name"),
            F.when(key % 97 == 0, "not a date")
            .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
            .alias("date_start"),
            F.when(key % 13 == 0, "n/a").otherwise((key % 1000).cast("string")).alias("impressions"),
            (key % 31).cast("string").alias("clicks"),
            F.format_string("%.2f", "o_totalprice").alias("spend"),
            F.lit(None).cast("string").alias("reach"),
            F.lit("").alias("frequency"),
            F.lit("1.25").alias("cpm"),
            F.lit("abc").alias("cpc"),
            F.lit("0.5").alias("ctr"),
            F.when(key % 3 == 0, "18-24").otherwise("25-34").alias("age"),
            F.when(key % 2 == 0, "female").otherwise("male").alias("gender"),
            "actions",
            F.slice("actions", 1, 1).alias("action_values"),
        )
    )


def landed(spark, d):
    """The insight rows written as JSON lines and read back with the pinned schema."""
    path = scratch_path(spark, "landing")
    insight_rows(spark, d).write.json(path)
    return ins.read_insights(spark, path, PASSES["age_gender"].breakdowns)


LANDED_SQL = f"""
WITH act AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    {TYPE} AS action_type, {VALUE} AS value FROM lineitem),
ok AS (SELECT *, TRY_CAST(value AS DOUBLE) AS v,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM act),
valid AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, action_type ORDER BY pos DESC) AS back
    FROM ok WHERE action_type IS NOT NULL AND v IS NOT NULL),
last AS (SELECT l_orderkey,
    CAST(round_even(max(v) FILTER (action_type = 'link_click'), 0) AS BIGINT) AS link_click,
    CAST(round_even(max(v) FILTER (action_type = 'add_to_cart'), 0) AS BIGINT) AS add_to_cart,
    CAST(round_even(max(v) FILTER (action_type = 'initiate_checkout'), 0) AS BIGINT) AS initiate_checkout
    FROM valid WHERE back = 1 GROUP BY 1),
first AS (SELECT l_orderkey, max(v) FILTER (action_type = 'add_to_cart') AS add_to_cart_value
    FROM ok WHERE pos = 1 AND action_type IS NOT NULL GROUP BY 1),
raw AS (SELECT l_orderkey, '[' || string_agg('{{"action_type":' || coalesce('"' || action_type || '"', 'null') ||
    ',"value":' || coalesce('"' || value || '"', 'null') || '}}', ',' ORDER BY pos) || ']' AS actions_raw FROM ok GROUP BY 1),
src AS (SELECT *, CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderdate AS DATE) END AS date FROM orders)
"""


@query(
    "src2_insight_json_scan",
    LANDED_SQL
    + """SELECT CAST(o_orderkey AS VARCHAR) AS ad_id,
    CASE WHEN o_orderkey % 97 = 0 THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_start,
    CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' ELSE CAST(o_orderkey % 1000 AS VARCHAR) END AS impressions,
    CAST((SELECT count(*) FROM ok WHERE ok.l_orderkey = o_orderkey) AS BIGINT) AS n_actions FROM src""",
)
def src2(spark, d):
    rows = landed(spark, d)
    n = F.coalesce(F.size("actions"), F.lit(0))
    return rows.select("ad_id", "date_start", "impressions", F.greatest(n, F.lit(0)).alias("n_actions"))


ACTION_SQL = ", ".join(
    f"CAST(round_even(max(v) FILTER (action_type = '{a}' AND back = 1), 0) AS BIGINT) AS {a}" for a in FUNNEL_ACTIONS
)
AMOUNT_SQL = ", ".join(f"max(v) FILTER (action_type = '{a}') AS {a}_value" for a in FUNNEL_ACTIONS)


@query(
    "prj1_flatten_insight",
    LANDED_SQL
    + f""", every AS (SELECT l_orderkey, {ACTION_SQL} FROM valid GROUP BY 1),
    amounts AS (SELECT l_orderkey, {AMOUNT_SQL} FROM ok WHERE pos = 1 AND action_type IS NOT NULL GROUP BY 1)
    SELECT 'age_gender' AS pass_name, CAST(date AS VARCHAR) AS date, 'c' || (o_custkey % 50) AS campaign_id,
    'Campaign ' || (o_custkey % 50) AS campaign_name, CAST(NULL AS VARCHAR) AS adset_id, CAST(NULL AS VARCHAR) AS adset_name,
    CAST(o_orderkey AS VARCHAR) AS ad_id, o_orderpriority AS ad_name,
    CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 1000 AS DOUBLE) END AS impressions,
    CAST(o_orderkey % 31 AS DOUBLE) AS clicks, o_totalprice AS spend, CAST(NULL AS DOUBLE) AS reach, CAST(NULL AS DOUBLE) AS frequency,
    CAST(1.25 AS DOUBLE) AS cpm, CAST(NULL AS DOUBLE) AS cpc, CAST(0.5 AS DOUBLE) AS ctr,
    every.* EXCLUDE (l_orderkey), amounts.* EXCLUDE (l_orderkey), CASE WHEN o_orderkey % 3 = 0 THEN '18-24' ELSE '25-34' END AS age,
    CASE WHEN o_orderkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender, actions_raw
    FROM src LEFT JOIN every ON every.l_orderkey = o_orderkey LEFT JOIN amounts ON amounts.l_orderkey = o_orderkey
    LEFT JOIN raw ON raw.l_orderkey = o_orderkey""",
    dp={"spend": 2},
    dates=("date",),
)
def prj1(spark, d):
    """All columns of a flattened pass."""
    return ins.flatten(landed(spark, d), PASSES["age_gender"])


@query(
    "prj2_action_index",
    LANDED_SQL
    + "SELECT CAST(l_orderkey AS VARCHAR) AS ad_id, action_type, v AS value FROM valid WHERE back = 1",
)
def prj2(spark, d):
    indexed = insight_rows(spark, d).select("ad_id", ins.action_index(F.col("actions")).alias("m"))
    return indexed.select("ad_id", F.explode("m").alias("action_type", "value"))


@query(
    "prj3_action_pivot",
    LANDED_SQL
    + """SELECT 'c' || (o_custkey % 50) AS campaign_id,
    sum(v) FILTER (action_type = 'link_click') AS link_click,
    sum(v) FILTER (action_type = 'add_to_cart') AS add_to_cart,
    sum(v) FILTER (action_type = 'initiate_checkout') AS initiate_checkout,
    CAST(NULL AS DOUBLE) AS purchase
    FROM valid JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""",
)
def prj3(spark, d):
    wide = ins.pivot_actions(insight_rows(spark, d), ["campaign_id"])
    return wide.select("campaign_id", "link_click", "add_to_cart", "initiate_checkout", "purchase")


@query(
    "prj4_tolerant_numeric",
    """SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN o_orderkey % 13 <> 0 THEN 1 END) AS BIGINT) AS n_impressions,
    sum(CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 1000 AS DOUBLE) END) AS impressions FROM orders""",
)
def prj4(spark, d):
    from spendlens.functions.scalars import tolerant_double

    rows = insight_rows(spark, d).select(tolerant_double("impressions").alias("i"))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count("i").alias("n_impressions"), F.sum("i").alias("impressions")
    )


@query(
    "prj5_tolerant_date",
    """SELECT CASE WHEN o_orderkey % 97 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date,
    CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1""",
    dates=("date",),
)
def prj5(spark, d):
    from spendlens.functions.scalars import tolerant_date

    return insight_rows(spark, d).groupBy(tolerant_date("date_start").alias("date")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "prj6_half_even_long",
    "SELECT l_quantity / 2 AS x, CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS y, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2",
)
def prj6(spark, d):
    from spendlens.functions.scalars import half_even_long

    half = tb.load(spark, d, "lineitem").groupBy((F.col("l_quantity") / 2).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    return half.select("x", half_even_long("x").alias("y"), "n")


@query(
    "prj7_raw_payload",
    LANDED_SQL + "SELECT CAST(o_orderkey AS VARCHAR) AS ad_id, actions_raw FROM src LEFT JOIN raw ON l_orderkey = o_orderkey",
)
def prj7(spark, d):
    return insight_rows(spark, d).select("ad_id", ins.raw_payload(F.col("actions")).alias("actions_raw"))


@query(
    "prj8_recover_custom_action",
    LANDED_SQL
    + """SELECT action_type, CAST(count(*) AS BIGINT) AS n, sum(v) AS value FROM ok
    WHERE action_type IS NOT NULL GROUP BY 1""",
)
def prj8(spark, d):
    raw = insight_rows(spark, d).select("ad_id", ins.raw_payload(F.col("actions")).alias("actions_raw"))
    found = ins.recovered_actions(raw).where("action_type IS NOT NULL")
    return found.groupBy("action_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


@query(
    "prj8_event_props",
    "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1",
)
def prj8_props(spark, d):
    k = F.variant_get(F.parse_json("props"), "$.k", "bigint")
    return tb.load(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("k"))


CREATIVE_COLS = [f.name for f in CREATIVE_SOURCE_SCHEMA.fields]


@query("src3_creative_flatten", tb.with_tables("creatives_or_none", "SELECT * FROM creatives_or_none"))
def src3(spark, d):
    path = scratch_path(spark, "ads")
    tb.creative_source(spark, d, missing=True).write.json(path)
    return cr.flatten_creatives(cr.read_creative_source(spark, path))


@query(
    "src4_creative_scan",
    tb.with_tables("creatives", "SELECT ad_id, object_type, cta, CAST(length(body) AS BIGINT) AS body_length FROM creatives"),
)
def src4(spark, d):
    path = scratch_path(spark, "creatives")
    write_table(tb.creatives(spark, d), path)
    return cr.read_creatives(spark, path).select("ad_id", "object_type", "cta", F.length("body").alias("body_length"))


@query(
    "snk4_creative_write",
    tb.with_tables(
        "creatives",
        "SELECT object_type, CAST(count(*) AS BIGINT) AS n, CAST(count(title) AS BIGINT) AS titled, "
        "CAST(count(distinct cta) AS BIGINT) AS ctas FROM creatives GROUP BY 1",
    ),
)
def snk4(spark, d):
    path = scratch_path(spark, "creatives")
    write_table(tb.creatives(spark, d), path)
    return cr.read_creatives(spark, path).groupBy("object_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("title").alias("titled"), F.countDistinct("cta").alias("ctas")
    )


@query(
    "prj19_first_usable_url",
    tb.with_tables(
        "creatives",
        """SELECT ad_id, coalesce(nullif(trim(image_url), ''), nullif(trim(thumbnail_url), '')) AS url FROM creatives
        WHERE coalesce(nullif(trim(image_url), ''), nullif(trim(thumbnail_url), '')) IS NOT NULL""",
    ),
)
def prj19(spark, d):
    return cr.picture_urls(tb.creatives(spark, d))


@query(
    "jn5_delivered_creatives",
    tb.with_tables(
        ["creatives", "ads_daily"],
        "SELECT ad_id, creative_id, image_url FROM creatives WHERE ad_id IN (SELECT ad_id FROM ads_daily WHERE spend > 0)",
    ),
)
def jn5(spark, d):
    return delivered_creatives(tb.creatives(spark, d), tb.ads_daily(spark, d)).select("ad_id", "creative_id", "image_url")


def stored_pass(spark, d):
    """ads_daily written as the partitioned base pass; returns its root folder."""
    root = scratch_path(spark, "raw")
    write_pass(tb.ads_daily(spark, d).withColumn("pass_name", F.lit("base")), root)
    return root


MONTHLY = """SELECT 'base' AS pass, strftime(date, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS n_rows,
    sum(spend) AS spend, CAST(sum(initiate_checkout) AS BIGINT) AS initiate_checkout FROM ads_daily GROUP BY 1, 2"""


def _monthly(df):
    return df.groupBy("pass", "month").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("spend").alias("spend"),
        F.sum("initiate_checkout").alias("initiate_checkout"),
    )


@query("src1_pass_scan", tb.with_tables("ads_daily", MONTHLY), dp={"spend": 2})
def src1(spark, d):
    return _monthly(wh.scan_pass(spark, stored_pass(spark, d), PASSES["base"], pinned=True))


@query("snk1_partitioned_write", tb.with_tables("ads_daily", MONTHLY), dp={"spend": 2})
def snk1(spark, d):
    """Write every slice, then write one year again: other slices stay, none doubles."""
    root = stored_pass(spark, d)
    again = tb.ads_daily(spark, d).withColumn("pass_name", F.lit("base")).where(F.year("date") == 1997)
    write_pass(again, root)
    return _monthly(wh.scan_pass(spark, root, PASSES["base"]))


@query(
    "snk2_csv_export",
    tb.with_tables(
        "ads_daily",
        "SELECT ad_id, CAST(date AS VARCHAR) AS date, spend, initiate_checkout, CAST(NULL AS VARCHAR) AS note FROM ads_daily"
        """ UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, NULL, NULL, md5('say "hi", ' || text || chr(10) || '"') FROM documents""",
    ),
    dp={"spend": 2},
)
def snk2(spark, d):
    """Numbers, and free text with quotes, commas and line ends, written and read back."""
    daily = tb.ads_daily(spark, d).withColumn("actions_raw", F.lit("[]"))
    notes = tb.load(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("ad_id"),
        F.concat(F.lit('say "hi", '), "text", F.lit('\n"')).alias("note"),
    )
    back = []
    for name, table in (("csv", daily), ("notes", notes)):
        path = scratch_path(spark, name)
        write_csv(table, path)
        kept = table.drop("actions_raw")
        options = {"header": True, "quote": '"', "escape": '"', "multiLine": True}
        back.append(spark.read.schema(kept.schema).options(**options).csv(path))
    numbers, words = back
    words = words.select("ad_id", F.md5(F.col("note").cast("binary")).alias("note"))
    out = numbers.select("ad_id", F.col("date").cast("string").alias("date"), "spend", "initiate_checkout")
    return out.unionByName(words, allowMissingColumns=True)


@query(
    "set1_union_by_name",
    tb.with_tables(
        "ads_daily",
        """SELECT CAST(year(date) AS BIGINT) AS year, CAST(count(*) AS BIGINT) AS n_rows,
        CAST(sum(CASE WHEN year(date) >= 1998 THEN video_view END) AS BIGINT) AS video_view FROM ads_daily GROUP BY 1""",
    ),
)
def set1(spark, d):
    """Months before 1998 are stored without one column; reading reconciles them."""
    root = scratch_path(spark, "raw")
    base = tb.ads_daily(spark, d).withColumn("pass_name", F.lit("base"))
    write_pass(base.where(F.year("date") < 1998).drop("video_view"), root)
    write_pass(base.where(F.year("date") >= 1998), root)
    return wh.scan_pass(spark, root, PASSES["base"]).groupBy(F.year("date").alias("year")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("video_view").alias("video_view")
    )


CATALOG = {"ads_daily": 23, "ads_by_age_gender": 25, "ads_by_placement": 26, "ads_by_region": 24, "campaigns_by_hour": 16}


@query(
    "src7_catalog_profile",
    tb.with_tables(
        list(CATALOG),
        " UNION ALL ".join(f"SELECT '{v}' AS view, CAST(count(*) AS BIGINT) AS n_rows, CAST({n} AS BIGINT) AS n_columns FROM {v}" for v, n in CATALOG.items())
        + """ UNION ALL SELECT 'funnel_by_month', count(DISTINCT date_trunc('month', date)), 12 FROM ads_daily
        UNION ALL SELECT 'ad_lifecycle', count(DISTINCT ad_id), 10 FROM ads_daily""",
    ),
)
def src7(spark, d):
    """All seven views; each is counted where it is, nothing is copied."""
    views = {name: tb.VIEWS[name](spark, d) for name in CATALOG}
    views["funnel_by_month"] = funnel_by_period(views["ads_daily"])
    views["ad_lifecycle"] = ad_lifecycle(views["ads_daily"])
    return wh.catalog_profile(views)


LEDGER = """ledger AS (SELECT 'base' AS pass, strftime(date, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS rows FROM ads_daily GROUP BY 2
    UNION ALL SELECT 'age_gender', strftime(date, '%Y-%m'), count(*) FROM ads_by_age_gender GROUP BY 2
    UNION ALL SELECT 'placement', strftime(date, '%Y-%m'), count(*) FROM ads_by_placement GROUP BY 2
    UNION ALL SELECT 'region', strftime(date, '%Y-%m'), count(*) FROM ads_by_region GROUP BY 2
    UNION ALL SELECT 'hourly', 'lump', count(*) FROM campaigns_by_hour)"""
LEDGER_VIEWS = ["ads_daily", "ads_by_age_gender", "ads_by_placement", "ads_by_region", "campaigns_by_hour"]


def ledger(spark, d):
    month = F.date_format("date", "yyyy-MM").alias("month")
    return wh.ledger(
        {
            "base": tb.ads_daily(spark, d).select(month),
            "age_gender": tb.ads_by_age_gender(spark, d).select(month),
            "placement": tb.ads_by_placement(spark, d).select(month),
            "region": tb.ads_by_region(spark, d).select(month),
            "hourly": tb.campaigns_by_hour(spark, d).select(F.lit("lump").alias("month")),
        }
    )


@query(
    "src8_rows_per_pass",
    tb.with_tables(
        LEDGER_VIEWS,
        "SELECT pass, CAST(sum(rows) AS BIGINT) AS rows FROM ledger GROUP BY 1 UNION ALL SELECT 'TOTAL', CAST(sum(rows) AS BIGINT) FROM ledger",
        LEDGER,
    ),
)
def src8(spark, d):
    from spendlens.operators.funnel import rows_per_pass

    return rows_per_pass(ledger(spark, d))


# --- incremental --------------------------------------------------------------

# the month a row landed in is its order's; every 97th date is unreadable, every 89th lies a month later
INSIGHT_MONTHS = """SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS n_rows,
    sum({}) AS spend, CAST(count(*) FILTER (o_orderkey % 97 = 0) AS BIGINT) AS undated,
    CAST(count(*) FILTER (o_orderkey % 97 <> 0 AND o_orderkey % 89 = 0) AS BIGINT) AS off_month FROM orders GROUP BY 1"""


def land(spark, d, landing, keep, mode, spend=None):
    months = tb.load(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("ad_id"), F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.when((F.col("o_orderkey") % 89 == 0) & (F.col("o_orderkey") % 97 != 0), F.add_months("o_orderdate", 1)).alias("later"),
    )
    rows = insight_rows(spark, d).join(months, "ad_id").where(keep)
    rows = rows.withColumn("date_start", F.coalesce(F.date_format("later", "yyyy-MM-dd"), "date_start"))
    if spend is not None:
        rows = rows.withColumn("spend", spend)
    rows = rows.withColumn("pass", F.lit("base"))
    columns = [f.name for f in insight_schema(()).fields]
    rows.select(*columns, "pass", "month").write.partitionBy("pass", "month").mode(mode).option(
        "partitionOverwriteMode", "dynamic"
    ).json(landing)


def _by_month(spark, root):
    return wh.scan_pass(spark, root, PASSES["base"], pinned=True).groupBy("month").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("spend").alias("spend"),
        F.count(F.when(F.col("date").isNull(), 1)).alias("undated"),
        F.count(F.when(F.date_format("date", "yyyy-MM") != F.col("month"), 1)).alias("off_month"),
    )


@query("inc1_resume", INSIGHT_MONTHS.format("o_totalprice"), dp={"spend": 2})
def inc1(spark, d):
    """Two landings, three stream runs: each month ends up stored exactly once."""
    landing, root, state = (scratch_path(spark, n) for n in ("landing", "raw", "state"))
    land(spark, d, landing, "month < '1998'", "append")
    resume.ingest(spark, landing, root, state)
    land(spark, d, landing, "month >= '1998'", "append")
    resume.ingest(spark, landing, root, state)
    resume.ingest(spark, landing, root, state)
    return _by_month(spark, root)


@query(
    "inc2_refresh_recent",
    INSIGHT_MONTHS.format("CASE WHEN strftime(o_orderdate, '%Y-%m') IN ('2001-07', '2001-08') THEN 2 * o_totalprice ELSE o_totalprice END"),
    dp={"spend": 2},
)
def inc2(spark, d):
    """A correction lands for all of 2001; only the two latest months are redone."""
    from spendlens.operators.funnel import month_calendar, recent_months

    landing, root = scratch_path(spark, "landing"), scratch_path(spark, "raw")
    land(spark, d, landing, "true", "append")
    months = [r["month"] for r in spark.read.schema("month string").json(landing).select("month").distinct().collect()]
    resume.refresh(spark, landing, root, months, ["base"])
    doubled = F.format_string("%.2f", F.col("spend").cast("double") * 2)
    land(spark, d, landing, "substr(month, 1, 4) = '2001'", "overwrite", doubled)
    newest = tb.load(spark, d, "orders").agg(F.date_add(F.max("o_orderdate").cast("date"), 1).alias("today"))
    latest = [r["label"] for r in recent_months(month_calendar(newest, 12), 2).collect()]
    resume.refresh(spark, landing, root, latest, ["base"])
    return _by_month(spark, root)


@query(
    "inc3_idempotent_rebuild",
    tb.with_tables(
        "ads_daily",
        """SELECT ad_id, CAST(min(date) AS VARCHAR) AS first_day, CAST(count(*) AS BIGINT) AS active_days,
        sum(spend) AS spend FROM ads_daily GROUP BY 1""",
    ),
    dp={"spend": 2},
    dates=("first_day",),
)
def inc3(spark, d):
    """Derived tables are rebuilt over themselves; views are replaced, raw data stays."""
    root, out = stored_pass(spark, d), scratch_path(spark, "derived")
    for _ in range(2):
        wh.register_views(spark, root)
        write_table(spark.table("ad_lifecycle"), out)
    return spark.read.parquet(out).select("ad_id", "first_day", "active_days", "spend")

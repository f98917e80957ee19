"""The driver's tables seen as advertising tables, in Spark and in SQL.

ad = part, campaign = brand, day = ship date, spend = extended price, checkout =
returned line; breakdowns come from customers, orders and nations; hours from
the event stream; copy from the documents; pictures from the embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.schema import HOUR_RANGE

AD_NAME = (
    "CASE p_partkey % 6 WHEN 0 THEN 'Reel ' WHEN 1 THEN 'POST ' WHEN 2 THEN 'story '"
    " WHEN 3 THEN 'Carousel ' WHEN 4 THEN 'video ' ELSE 'banner ' END || p_name"
)
CAMPAIGN_NAME = (
    "CASE WHEN p_brand LIKE 'Brand#1%' THEN p_brand || ' launch'"
    " WHEN p_brand LIKE 'Brand#2%' THEN '20' || substr(p_brand, 7) || ' summer'"
    " ELSE 'evergreen' END"
)
ENTITY = {
    "campaign_id": "p_brand",
    "campaign_name": CAMPAIGN_NAME,
    "adset_id": "p_brand || '-' || CAST(p_size % 5 AS VARCHAR(9))",
    "adset_name": "'set ' || p_type",
    "ad_id": "CAST(l_partkey AS VARCHAR(20))",
    "ad_name": AD_NAME,
}
DOUBLES = {
    "impressions": "SUM(l_quantity) * 100",
    "clicks": "CAST(SUM(l_linenumber) AS DOUBLE)",
    "spend": "SUM(l_extendedprice)",
    "reach": "SUM(l_quantity) * 60",
    "frequency": "1 + MAX(l_discount) * 10",
    "cpm": "SUM(l_extendedprice) / (SUM(l_quantity) * 100) * 1000",
    "ctr": "CAST(SUM(l_linenumber) AS DOUBLE) / (SUM(l_quantity) * 100) * 100",
    "purchase_value": "SUM(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN l_extendedprice END)",
}
COUNTS = {
    "link_click": "SUM(l_linenumber)",
    "landing_page_view": "SUM(CASE WHEN l_linestatus = 'F' THEN 3 END)",
    "view_content": "COUNT(*)",
    "add_to_cart": "SUM(CASE WHEN l_returnflag IN ('A', 'R') THEN 2 END)",
    "initiate_checkout": "SUM(CASE WHEN l_returnflag = 'R' THEN 1 END)",
    "purchase": "SUM(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 1 END)",
    "video_view": "SUM(CASE WHEN l_linenumber <= 2 THEN 1 END)",
    "post_engagement": "SUM(CASE WHEN l_linenumber >= 3 THEN l_linenumber END)",
}
NO_PIXEL = [c for c in COUNTS if c != "link_click"]

AGE_GENDER = {
    "age": "c_mktsegment",
    "gender": "CASE WHEN c_custkey % 40 = 0 THEN NULL WHEN c_nationkey % 3 = 0 THEN 'female'"
    " WHEN c_nationkey % 3 = 1 THEN 'male' ELSE 'unknown' END",
}
PLACEMENT = {
    "publisher_platform": "l_returnflag",
    "platform_position": "l_linestatus",
    "impression_device": "o_orderpriority",
}
REGION = {"region": "n_name"}

PIXEL_WIDTH, PIXEL_HEIGHT = 11, 2


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pass(spark, d, rows: DataFrame, dims: dict, pixel: bool = True) -> DataFrame:
    """Aggregate on the narrow keys first; part attributes join the smaller result."""
    day = F.col("l_shipdate").cast("date").alias("date")
    sums = [F.expr(e).alias(n) for n, e in DOUBLES.items()]
    sums += [F.expr(e).cast("bigint").alias(n) for n, e in COUNTS.items()]
    keys = [F.expr(e).alias(n) for n, e in dims.items()]
    grouped = rows.groupBy("l_partkey", day, *keys).agg(*sums)
    if not pixel:
        gone = {c: F.lit(None).cast("bigint") for c in NO_PIXEL}
        grouped = grouped.withColumns({**gone, "purchase_value": F.lit(None).cast("double")})
    part = load(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_type", "p_name")
    entity = [f"{e} AS {n}" for n, e in ENTITY.items()]
    joined = grouped.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.selectExpr("date", *entity, *dims, *DOUBLES, *COUNTS)


def _ordered(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return load(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def ads_daily(spark, d) -> DataFrame:
    return _pass(spark, d, load(spark, d, "lineitem"), {})


def ads_by_age_gender(spark, d) -> DataFrame:
    customer = load(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    rows = _ordered(spark, d).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return _pass(spark, d, rows, AGE_GENDER)


def ads_by_placement(spark, d) -> DataFrame:
    return _pass(spark, d, _ordered(spark, d), PLACEMENT)


def ads_by_region(spark, d) -> DataFrame:
    customer = load(spark, d, "customer").select("c_custkey", "c_nationkey")
    nation = load(spark, d, "nation").select("n_nationkey", "n_name")
    rows = _ordered(spark, d).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return _pass(spark, d, rows, REGION, pixel=False)


def campaigns_by_hour(spark, d) -> DataFrame:
    kind = lambda name: F.count(F.when(F.col("event_type") == name, 1))
    hh = F.lpad(F.hour("ts").cast("string"), 2, "0")
    none = F.lit(None).cast("bigint")
    return (
        load(spark, d, "events")
        .groupBy(
            F.col("ts").cast("date").alias("date"),
            (F.col("user_id") % 20).cast("string").alias("campaign_id"),
            F.concat(hh, F.lit(":00:00 - "), hh, F.lit(":59:59")).alias(HOUR_RANGE),
        )
        .agg(
            (F.count(F.lit(1)) * 100.0).alias("impressions"),
            F.lit(None).cast("double").alias("reach"),
            kind("click").cast("double").alias("clicks"),
            F.sum("value").alias("spend"),
            kind("click").alias("link_click"),
            kind("view").alias("landing_page_view"),
            none.alias("view_content"),
            kind("error").alias("add_to_cart"),
            kind("signup").alias("initiate_checkout"),
            kind("purchase").alias("purchase"),
            F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("purchase_value"),
            none.alias("video_view"),
            none.alias("post_engagement"),
        )
    )


VIEWS = {
    "ads_daily": ads_daily,
    "ads_by_age_gender": ads_by_age_gender,
    "ads_by_placement": ads_by_placement,
    "ads_by_region": ads_by_region,
    "campaigns_by_hour": campaigns_by_hour,
}


def views(spark, d, names=tuple(VIEWS)) -> dict[str, DataFrame]:
    """The views by name; whoever reads one computes it with the columns that it takes, and nothing is stored."""
    return {name: VIEWS[name](spark, d) for name in names}


def creative_source(spark, d, missing: bool = False) -> DataFrame:
    """Documents as nested ad objects; with ``missing``, every eleventh has no creative at all."""
    doc = F.col("doc_id")
    kind = F.when(doc % 3 == 0, "VIDEO").when(doc % 3 == 1, "SHARE").otherwise("PHOTO")
    nested = F.struct(
        F.concat(F.lit("c"), doc).alias("id"),
        F.concat(F.lit("copy "), F.col("lang")).alias("name"),
        F.when(doc % 4 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("about "), "text")).alias("title"),
        F.col("text").alias("body"),
        F.when(doc % 5 == 0, "  ").when(doc % 5 == 1, F.concat(F.lit(" http://img/"), doc)).alias("image_url"),
        F.when(doc % 7 != 0, F.concat(F.lit("http://thumb/"), doc)).alias("thumbnail_url"),
        kind.alias("object_type"),
        F.col("source").alias("call_to_action_type"),
        F.when(doc % 3 == 0, F.concat(F.lit("v"), doc)).when(doc % 3 == 1, "").alias("video_id"),
        F.concat(F.lit("s"), doc).alias("effective_object_story_id"),
    )
    return load(spark, d, "documents").select(
        doc.cast("string").alias("id"),
        F.concat(F.lit("ad "), doc).alias("name"),
        F.when(doc % 2 == 0, "ACTIVE").otherwise("PAUSED").alias("status"),
        F.lit("2024-01-01T00:00:00+0000").alias("created_time"),
        (F.when(doc % 11 != 0, nested) if missing else nested).alias("creative"),
    )


def creatives(spark, d) -> DataFrame:
    from spendlens.sources.creatives import flatten_creatives

    return flatten_creatives(creative_source(spark, d))


def pictures(spark, d) -> DataFrame:
    """Embeddings as 11 x 2 pictures in the layout of Spark's image source.

    22 pixels of three channels take all 64 values and the first two again.
    """
    level = F.transform(
        F.concat("embedding", F.slice("embedding", 1, 2)),
        lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e + 0.55) * 255))).cast("int"),
    )
    text = F.array_join(F.transform(level, lambda v: F.lpad(F.hex(v), 2, "0")), "")
    image = F.struct(
        F.concat(F.lit("mem:/"), F.col("vec_id"), F.lit(".jpg")).alias("origin"),
        F.lit(PIXEL_HEIGHT).alias("height"),
        F.lit(PIXEL_WIDTH).alias("width"),
        F.lit(3).alias("nChannels"),
        F.lit(16).alias("mode"),
        F.unhex(text).alias("data"),
    )
    return load(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("ad_id"), image.alias("image"))


# --- the same tables in SQL ---------------------------------------------------


def _sql_pass(dims: dict, source: str, pixel: bool = True) -> str:
    keys = {"date": "CAST(l_shipdate AS DATE)", **ENTITY, **dims}
    cols = [f"{e} AS {n}" for n, e in keys.items()]
    for n, e in DOUBLES.items():
        cols.append(f"{e} AS {n}" if pixel or n != "purchase_value" else f"CAST(NULL AS DOUBLE) AS {n}")
    for n, e in COUNTS.items():
        hidden = not pixel and n in NO_PIXEL
        cols.append(f"CAST({'NULL' if hidden else e} AS BIGINT) AS {n}")
    group = ", ".join(str(i + 1) for i in range(len(keys)))
    return f"SELECT {', '.join(cols)} FROM {source} GROUP BY {group}"


def _sql_creatives(has: str) -> str:
    return (
        f"SELECT CAST(doc_id AS VARCHAR) AS ad_id, 'ad ' || doc_id AS ad_name, "
        f"CASE WHEN doc_id % 2 = 0 THEN 'ACTIVE' ELSE 'PAUSED' END AS ad_status, "
        f"'2024-01-01T00:00:00+0000' AS created_time, "
        f"CASE WHEN {has} THEN 'c' || doc_id END AS creative_id, "
        f"CASE WHEN {has} THEN 'copy ' || lang END AS creative_name, "
        f"CASE WHEN {has} AND doc_id % 4 <> 0 THEN 'about ' || text END AS title, "
        f"CASE WHEN {has} THEN text END AS body, "
        f"CASE WHEN {has} THEN CASE doc_id % 3 WHEN 0 THEN 'VIDEO' WHEN 1 THEN 'SHARE' ELSE 'PHOTO' END END AS object_type, "
        f"CASE WHEN {has} THEN source END AS cta, "
        f"CASE WHEN {has} THEN CASE doc_id % 3 WHEN 0 THEN 'v' || doc_id WHEN 1 THEN '' END END AS video_id, "
        f"CASE WHEN {has} THEN CASE doc_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN ' http://img/' || doc_id END END AS image_url, "
        f"CASE WHEN {has} AND doc_id % 7 <> 0 THEN 'http://thumb/' || doc_id END AS thumbnail_url, "
        f"CASE WHEN {has} THEN 's' || doc_id END AS story_id FROM documents"
    )


_LINES = "lineitem JOIN part ON l_partkey = p_partkey"
_ORDERED = f"{_LINES} JOIN orders ON l_orderkey = o_orderkey"
_BUYERS = f"{_ORDERED} JOIN customer ON o_custkey = c_custkey"

_EV = "CAST(COUNT(*) FILTER (event_type = '{}') AS {})"
CTES = {
    "ads_daily": _sql_pass({}, _LINES),
    "ads_by_age_gender": _sql_pass(AGE_GENDER, _BUYERS),
    "ads_by_placement": _sql_pass(PLACEMENT, _ORDERED),
    "ads_by_region": _sql_pass(REGION, f"{_BUYERS} JOIN nation ON c_nationkey = n_nationkey", pixel=False),
    "campaigns_by_hour": (
        "SELECT CAST(ts AS DATE) AS date, CAST(user_id % 20 AS VARCHAR) AS campaign_id, "
        f"strftime(ts, '%H') || ':00:00 - ' || strftime(ts, '%H') || ':59:59' AS {HOUR_RANGE}, "
        "COUNT(*) * CAST(100 AS DOUBLE) AS impressions, CAST(NULL AS DOUBLE) AS reach, "
        f"{_EV.format('click', 'DOUBLE')} AS clicks, SUM(value) AS spend, "
        f"{_EV.format('click', 'BIGINT')} AS link_click, {_EV.format('view', 'BIGINT')} AS landing_page_view, "
        "CAST(NULL AS BIGINT) AS view_content, "
        f"{_EV.format('error', 'BIGINT')} AS add_to_cart, {_EV.format('signup', 'BIGINT')} AS initiate_checkout, "
        f"{_EV.format('purchase', 'BIGINT')} AS purchase, "
        "SUM(CASE WHEN event_type = 'purchase' THEN value END) AS purchase_value, "
        "CAST(NULL AS BIGINT) AS video_view, CAST(NULL AS BIGINT) AS post_engagement "
        "FROM events GROUP BY 1, 2, 3"
    ),
    "creatives": _sql_creatives("true"),
    "creatives_or_none": _sql_creatives("doc_id % 11 <> 0"),
}


def with_tables(names, body: str, extra: str = "") -> str:
    """SQL text: the named tables as CTEs, further CTEs, then the body."""
    names = [names] if isinstance(names, str) else list(names)
    ctes = ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in names)
    return f"WITH {ctes}{', ' + extra if extra else ''}\n{body}"

"""Projections, funnel, lifecycle, calendar and measure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import q_ingest
from bindings import tables as tb
from bindings.registry import query
from spendlens.functions import scalars as sc
from spendlens.operators import funnel, segments, triage
from spendlens.plans import star
from spendlens.schema import HOUR_RANGE, PASSES

DAILY = "ads_daily"


def t(names, body, extra=""):
    return tb.with_tables(names, body, extra)


def big(expr):
    return f"CAST({expr} AS BIGINT)"


# --- projections --------------------------------------------------------------


@query(
    "prj9_null_to_zero",
    t(DAILY, f"""SELECT campaign_id, {big('sum(coalesce(initiate_checkout, 0))')} AS ic,
    {big('count(coalesce(purchase, 0))')} AS n, {big('count(purchase)')} AS known FROM ads_daily GROUP BY 1"""),
)
def prj9(spark, d):
    return tb.ads_daily(spark, d).groupBy("campaign_id").agg(
        F.sum(sc.or_zero("initiate_checkout")).alias("ic"),
        F.count(sc.or_zero("purchase")).alias("n"),
        F.count("purchase").alias("known"),
    )


@query(
    "prj10_delivery_filter",
    f"""SELECT l_returnflag, {big('count(*)')} AS n, sum(l_extendedprice) AS spend FROM lineitem
    WHERE l_extendedprice > 0 AND l_quantity > 0 AND l_extendedprice IS NOT NULL GROUP BY 1""",
    dp={"spend": 2},
)
def prj10(spark, d):
    rows = tb.load(spark, d, "lineitem").where("l_extendedprice > 0 AND l_quantity > 0")
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("spend"))


@query(
    "prj11_safe_ratio",
    t(DAILY, """SELECT ad_id, sum(initiate_checkout) / nullif(sum(landing_page_view), 0) AS lpv_rate,
    sum(spend) / nullif(sum(initiate_checkout), 0) AS cpa FROM ads_daily GROUP BY 1"""),
    dp={"lpv_rate": 9, "cpa": 6},
)
def prj11(spark, d):
    g = tb.ads_daily(spark, d).groupBy("ad_id").agg(
        F.sum("initiate_checkout").alias("ic"), F.sum("landing_page_view").alias("lpv"), F.sum("spend").alias("spend")
    )
    return g.select("ad_id", sc.ratio("ic", "lpv").alias("lpv_rate"), sc.ratio("spend", "ic").alias("cpa"))


EVENT_ID = """coalesce(nullif(regexp_extract(campaign_name, '#(\\d{2,})', 1), ''),
    nullif(regexp_extract(campaign_name, '^\\s*(\\d{2,})\\b', 1), ''), campaign_id)"""


@query("prj12_event_id", t(DAILY, f"SELECT DISTINCT campaign_id, campaign_name, {EVENT_ID} AS event_id FROM ads_daily"))
def prj12(spark, d):
    c = tb.ads_daily(spark, d).select("campaign_id", "campaign_name").distinct()
    return c.withColumn("event_id", sc.event_id("campaign_name", "campaign_id"))


@query(
    "prj13_hour_of_day",
    f"SELECT {big('hour(ts)')} AS hour, {big('count(DISTINCT (CAST(ts AS DATE), user_id % 20))')} AS n FROM events GROUP BY 1",
)
def prj13(spark, d):
    return tb.campaigns_by_hour(spark, d).groupBy(sc.hour_of_range(HOUR_RANGE).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


FORMAT = "CASE WHEN regexp_extract(lower(ad_name), '(reel|post|story|carousel|video)', 1) = '' THEN 'other' ELSE regexp_extract(lower(ad_name), '(reel|post|story|carousel|video)', 1) END"


@query(
    "prj14_creative_format",
    t(DAILY, f"SELECT {FORMAT} AS format, {big('count(DISTINCT ad_id)')} AS ads FROM ads_daily GROUP BY 1"),
)
def prj14(spark, d):
    ads = tb.ads_daily(spark, d).select("ad_id", "ad_name").distinct()
    return ads.groupBy(sc.creative_format("ad_name").alias("format")).agg(F.count("ad_id").alias("ads"))


@query(
    "prj15_format_flags",
    t([DAILY, "creatives"], f"""SELECT c.ad_id, {big("coalesce(object_type = 'VIDEO', false)")} AS is_video,
    {big("CASE WHEN lower(a.ad_name) LIKE '%reel%' THEN 1 ELSE 0 END")} AS is_reel
    FROM creatives c JOIN (SELECT ad_id, min(ad_name) AS ad_name FROM ads_daily GROUP BY 1) a ON a.ad_id = c.ad_id"""),
)
def prj15(spark, d):
    from spendlens.operators.creative import with_format_flags

    names = tb.ads_daily(spark, d).groupBy("ad_id").agg(F.min("ad_name").alias("ad_name"))
    joined = tb.creatives(spark, d).select("ad_id", "object_type").join(names, "ad_id")
    return with_format_flags(joined).select("ad_id", "is_video", "is_reel")


@query(
    "prj16_star_is_video",
    t("creatives", f"""SELECT ad_id, coalesce(video_id IS NOT NULL AND video_id <> '', false) AS is_video,
    {big('length(body)')} AS body_length FROM creatives"""),
)
def prj16(spark, d):
    return star.creative_attributes(tb.creatives(spark, d)).select("ad_id", "is_video", "body_length")


@query(
    "prj18_segment_label",
    t("ads_by_age_gender", f"""SELECT coalesce(age, 'nan') || ' / ' || coalesce(gender, 'nan') AS segment,
    {big('count(*)')} AS n FROM ads_by_age_gender GROUP BY 1"""),
)
def prj18(spark, d):
    label = sc.segment_label(["age", "gender"]).alias("segment")
    return tb.ads_by_age_gender(spark, d).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


CALENDAR = """today AS (SELECT CAST(max(o_orderdate) AS DATE) + 10 AS today FROM orders),
months AS (SELECT today, CAST(unnest(generate_series(date_trunc('month', today) - INTERVAL 36 MONTH,
    date_trunc('month', today), INTERVAL 1 MONTH)) AS DATE) AS first FROM today),
cal AS (SELECT strftime(first, '%Y-%m') AS label, first, least(last_day(first), today - 1) AS last FROM months
    WHERE least(last_day(first), today - 1) >= first)"""


def calendar(spark, d, months=37):
    newest = tb.load(spark, d, "orders").agg(F.date_add(F.max("o_orderdate").cast("date"), 10).alias("today"))
    return funnel.month_calendar(newest, months)


@query("prj20_month_calendar", f"WITH {CALENDAR} SELECT * FROM cal", dates=("first", "last"))
def prj20(spark, d):
    return calendar(spark, d, funnel.RETENTION_MONTHS)


@query(
    "prj21_recent_months",
    f"WITH {CALENDAR} SELECT * FROM cal ORDER BY label DESC LIMIT 3",
    dates=("first", "last"),
)
def prj21(spark, d):
    return funnel.recent_months(calendar(spark, d), 3)


SPINE = """span AS (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders),
spine AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM span)"""


@query(
    "prj22_date_attributes",
    f"""WITH {SPINE} SELECT date, {big('year(date)')} AS year, {big('month(date)')} AS month,
    strftime(date, '%Y-%m') AS month_key, strftime(date, '%b %Y') AS month_label, {big('weekofyear(date)')} AS week,
    {big('isodow(date)')} AS day_of_week, dayname(date) AS day_name, isodow(date) >= 6 AS is_weekend FROM spine""",
    dates=("date",),
)
def prj22(spark, d):
    days = tb.load(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return funnel.with_date_attributes(funnel.date_spine(days))


@query("jn12_date_spine", f"WITH {SPINE} SELECT {big('count(*)')} AS n, min(date) AS lo, max(date) AS hi FROM spine", dates=("lo", "hi"))
def jn12(spark, d):
    days = tb.load(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return funnel.date_spine(days).agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi"))


TOTALS = """tot AS (SELECT sum(impressions) AS impressions, sum(link_click) AS link_clicks,
    sum(landing_page_view) AS landing_page_views, sum(add_to_cart) AS add_to_cart,
    sum(initiate_checkout) AS initiate_checkout, sum(purchase) AS purchase FROM ads_daily WHERE spend > 0),
stages AS (SELECT * FROM (VALUES (0, 'Impressions'), (1, 'Clics sur lien'), (2, 'Vues de page'), (3, 'Ajouts au panier'),
    (4, 'Paiements initiés'), (5, 'Achats')) v(i, stage)),
vol AS (SELECT i, stage, CAST(CASE i WHEN 0 THEN impressions WHEN 1 THEN link_clicks WHEN 2 THEN landing_page_views
    WHEN 3 THEN add_to_cart WHEN 4 THEN initiate_checkout ELSE greatest(purchase, 1) END AS DOUBLE) AS volume FROM stages, tot),
rates AS (SELECT i, stage, volume, round(volume / nullif(lag(volume) OVER (ORDER BY i), 0), 5) AS pass_rate FROM vol)"""


@query("prj23_funnel_stages", t(DAILY, f"SELECT {big('i')} AS stage_order, stage, volume FROM vol", TOTALS))
def prj23(spark, d):
    return funnel.funnel_stages(funnel.funnel_totals(tb.ads_daily(spark, d)), purchase_floor=1)


@query(
    "agg4_stage_pass_rates",
    t(DAILY, f"SELECT {big('i')} AS stage_order, stage, {big('volume')} AS volume, pass_rate FROM rates", TOTALS),
)
def agg4(spark, d):
    return funnel.stage_pass_rates(funnel.funnel_stages(funnel.funnel_totals(tb.ads_daily(spark, d))))


@query(
    "prj26_broken_pixel_alert",
    t(DAILY, f"""SELECT {big('purchase')} AS purchase, {big('initiate_checkout')} AS initiate_checkout,
    CAST(purchase AS DOUBLE) / initiate_checkout * 100 AS pass_rate_pct FROM tot
    WHERE purchase < 1000000000 AND initiate_checkout > 0""", TOTALS),
    dp={"pass_rate_pct": 6},
)
def prj26(spark, d):
    return funnel.broken_pixel_alert(funnel.funnel_totals(tb.ads_daily(spark, d)), max_purchases=1_000_000_000)


# --- funnel and lifecycle -----------------------------------------------------

STAGE_SUMS = """sum(spend) AS spend, sum(impressions) AS impressions, CAST(sum(link_click) AS BIGINT) AS link_clicks,
    CAST(sum(landing_page_view) AS BIGINT) AS landing_page_views, CAST(sum(add_to_cart) AS BIGINT) AS add_to_cart,
    CAST(sum(initiate_checkout) AS BIGINT) AS initiate_checkout, CAST(sum(purchase) AS BIGINT) AS purchase"""
PCTS = """round(sum(add_to_cart) / nullif(sum(landing_page_view), 0) * 100, 2) AS lpv_to_cart_pct,
    round(sum(initiate_checkout) / nullif(sum(add_to_cart), 0) * 100, 2) AS cart_to_checkout_pct,
    round(sum(purchase) / nullif(sum(initiate_checkout), 0) * 100, 2) AS checkout_to_purchase_pct,
    round(sum(spend) / nullif(sum(initiate_checkout), 0), 4) AS cost_per_checkout"""


@query(
    "agg1_funnel_by_month",
    t(DAILY, f"SELECT date_trunc('month', date) AS month, {STAGE_SUMS}, {PCTS} FROM ads_daily GROUP BY 1"),
    dp={"spend": 2},
    dates=("month",),
)
def agg1(spark, d):
    return funnel.funnel_by_period(tb.ads_daily(spark, d))


@query(
    "agg1_funnel_by_day",
    t("campaigns_by_hour", f"SELECT date AS day, {STAGE_SUMS}, {PCTS} FROM campaigns_by_hour GROUP BY 1"),
    dp={"spend": 2},
    dates=("day",),
)
def agg1_day(spark, d):
    return funnel.funnel_by_period(tb.campaigns_by_hour(spark, d), "day")


LIFE = """life AS (SELECT ad_id, min(ad_name) AS ad_name, min(campaign_name) AS campaign_name, min(date) AS first_day,
    max(date) AS last_day, CAST(count(*) AS BIGINT) AS active_days, sum(spend) AS spend, sum(impressions) AS impressions,
    avg(ctr) AS avg_ctr, CAST(sum(initiate_checkout) AS BIGINT) AS initiate_checkout FROM ads_daily GROUP BY 1)"""


@query(
    "agg2_ad_lifecycle",
    t(DAILY, "SELECT * FROM life", LIFE),
    dp={"spend": 2, "avg_ctr": 4},
    dates=("first_day", "last_day"),
)
def agg2(spark, d):
    return funnel.ad_lifecycle(tb.ads_daily(spark, d))


@query(
    "agg3_funnel_totals",
    t(DAILY, "SELECT impressions, CAST(link_clicks AS BIGINT) AS link_clicks, CAST(landing_page_views AS BIGINT) AS landing_page_views, CAST(add_to_cart AS BIGINT) AS add_to_cart, CAST(initiate_checkout AS BIGINT) AS initiate_checkout, CAST(purchase AS BIGINT) AS purchase FROM tot", TOTALS),
)
def agg3(spark, d):
    return funnel.funnel_totals(tb.ads_daily(spark, d))


SCOPE = """SELECT CAST(count(DISTINCT ad_id) AS BIGINT) AS ads, CAST(count(DISTINCT campaign_id) AS BIGINT) AS campaigns,
    CAST(count(DISTINCT date) AS BIGINT) AS days, round(sum(spend), 2) AS spend,
    CAST(sum(initiate_checkout) AS BIGINT) AS initiate_checkout, min(date) AS first_day, max(date) AS last_day
    FROM ads_daily WHERE spend > 0"""


@query("agg5_account_scope", t(DAILY, SCOPE), dates=("first_day", "last_day"))
def agg5(spark, d):
    return funnel.account_scope(tb.ads_daily(spark, d))


@query(
    "agg6_kpi_header",
    t(DAILY, f"""SELECT sum(spend) AS spend, {big('sum(initiate_checkout)')} AS checkouts, {big('sum(purchase)')} AS purchases,
    sum(spend) / nullif(sum(initiate_checkout), 0) AS cost_per_checkout,
    sum(purchase) / nullif(sum(initiate_checkout), 0) * 100 AS checkout_to_purchase_pct,
    date_trunc('month', min(date)) AS first_month, date_trunc('month', max(date)) AS last_month FROM ads_daily"""),
    dp={"spend": 2, "cost_per_checkout": 6, "checkout_to_purchase_pct": 6},
    dates=("first_month", "last_month"),
)
def agg6(spark, d):
    return funnel.kpi_header(funnel.funnel_by_period(tb.ads_daily(spark, d)))


@query(
    "agg11_cpa_by_placement",
    t("ads_by_placement", f"""SELECT seg, spend, {big('conv')} AS conv, spend / conv AS cpa,
    sum(spend) OVER () / sum(conv) OVER () AS mean_cpa FROM (SELECT publisher_platform || ' / ' || platform_position AS seg,
    sum(spend) AS spend, sum(initiate_checkout) AS conv FROM ads_by_placement WHERE spend > 0 GROUP BY 1
    HAVING sum(spend) > 400 AND sum(initiate_checkout) > 0) g"""),
    dp={"spend": 2, "cpa": 6, "mean_cpa": 6},
)
def agg11(spark, d):
    return funnel.cost_by_placement(tb.ads_by_placement(spark, d))


@query(
    "agg12_cpa_by_hour",
    t("campaigns_by_hour", f"""SELECT {big('hour')} AS hour, spend, {big('conv')} AS conv, spend / nullif(conv, 0) AS cpa,
    sum(spend) OVER () / sum(conv) OVER () AS mean_cpa FROM (SELECT CAST(substr({HOUR_RANGE}, 1, 2) AS INT) AS hour,
    sum(spend) AS spend, sum(initiate_checkout) AS conv FROM campaigns_by_hour WHERE spend > 0 GROUP BY 1) g"""),
    dp={"spend": 2, "cpa": 6, "mean_cpa": 6},
)
def agg12(spark, d):
    return funnel.cost_by_hour(tb.campaigns_by_hour(spark, d))


@query(
    "agg13_cpa_by_age_gender",
    t("ads_by_age_gender", """SELECT age, max(CASE WHEN gender = 'female' THEN cpa END) AS female,
    max(CASE WHEN gender = 'male' THEN cpa END) AS male FROM (SELECT age, gender, sum(spend) / sum(initiate_checkout) AS cpa
    FROM ads_by_age_gender WHERE gender IN ('female', 'male') AND spend > 0 GROUP BY 1, 2
    HAVING sum(initiate_checkout) > 30) g GROUP BY 1"""),
    dp={"female": 6, "male": 6},
)
def agg13(spark, d):
    return funnel.cost_by_age_gender(tb.ads_by_age_gender(spark, d))


@query("agg14_lifetime_histogram", t(DAILY, f"SELECT active_days, {big('count(*)')} AS n_ads FROM life GROUP BY 1", LIFE))
def agg14(spark, d):
    return funnel.lifetime_histogram(funnel.ad_lifecycle(tb.ads_daily(spark, d)))


SURVIVAL = """SELECT CAST(g.d AS BIGINT) AS d, avg(CASE WHEN active_days >= g.d THEN 1.0 ELSE 0.0 END) AS share
    FROM life, (SELECT unnest(generate_series(1, (SELECT max(active_days) FROM life))) AS d) g GROUP BY 1"""


@query("agg15_survival", t(DAILY, SURVIVAL, LIFE), dp={"share": 9})
def agg15(spark, d):
    return funnel.survival(funnel.ad_lifecycle(tb.ads_daily(spark, d)))


@query("jn13_threshold_join", t(DAILY, SURVIVAL, LIFE), dp={"share": 9})
def jn13(spark, d):
    """The same share as a theta join of thresholds with the lifetime histogram."""
    h = funnel.lifetime_histogram(funnel.ad_lifecycle(tb.ads_daily(spark, d)))
    top = h.agg(F.max("active_days").alias("m"), F.sum("n_ads").alias("all"))
    grid = top.select(F.explode(F.sequence(F.lit(1).cast("bigint"), "m")).alias("d"), "all")
    joined = grid.join(h, F.col("active_days") >= F.col("d"))
    return joined.groupBy("d").agg((F.sum("n_ads") / F.max("all")).alias("share"))


PANEL = """panel AS (SELECT *, row_number() OVER (PARTITION BY ad_id ORDER BY date) AS day_n,
    count(*) OVER (PARTITION BY ad_id) AS lifetime FROM ads_daily WHERE spend > 0 AND impressions > 0)"""


def panel(spark, d):
    return triage.daily_panel(tb.ads_daily(spark, d))


@query(
    "agg16_fatigue_profile",
    t(DAILY, f"""SELECT {big('day_n')} AS day_n, {big('count(DISTINCT ad_id)')} AS n, quantile_cont(ctr, 0.5) AS ctr
    FROM panel WHERE lifetime >= 12 GROUP BY 1 HAVING count(DISTINCT ad_id) >= 10""", PANEL),
    dp={"ctr": 9},
)
def agg16(spark, d):
    return funnel.fatigue_profile(panel(spark, d))


@query(
    "agg17_lifetime_performance",
    t(DAILY, f"""SELECT ad_id, min(campaign_id) AS campaign_id, min(ad_name) AS ad_name, sum(spend) AS spend,
    sum(impressions) AS impressions, sum(clicks) AS clicks, {big('sum(initiate_checkout)')} AS checkouts,
    sum(clicks) / sum(impressions) * 100 AS ctr, coalesce(sum(initiate_checkout), 0) / sum(spend) AS icr
    FROM ads_daily WHERE spend > 0 GROUP BY 1 HAVING sum(spend) >= 20"""),
    dp={"spend": 2, "ctr": 9, "icr": 12},
)
def agg17(spark, d):
    from spendlens.operators.creative import lifetime_performance

    return lifetime_performance(tb.ads_daily(spark, d))


COVER = f"{CALENDAR}, {q_ingest.LEDGER}"


@query(
    "agg19_coverage_matrix",
    t(q_ingest.LEDGER_VIEWS, """SELECT m.month, ln(1 + max(rows) FILTER (pass = 'base')) AS base,
    ln(1 + max(rows) FILTER (pass = 'placement')) AS placement, ln(1 + max(rows) FILTER (pass = 'region')) AS region,
    CAST(NULL AS DOUBLE) AS unheard
    FROM (SELECT label AS month FROM cal UNION SELECT month FROM ledger WHERE month <> 'lump') m
    LEFT JOIN ledger l ON l.month = m.month GROUP BY 1""", COVER),
    dp={"base": 9, "placement": 9, "region": 9},
)
def agg19(spark, d):
    return funnel.coverage_matrix(q_ingest.ledger(spark, d), calendar(spark, d), ["base", "placement", "region", "unheard"])


@query("agg19_off_calendar", t(q_ingest.LEDGER_VIEWS, "SELECT * FROM ledger WHERE month = 'lump'", q_ingest.LEDGER))
def agg19_off(spark, d):
    return funnel.off_calendar(q_ingest.ledger(spark, d))


@query(
    "jn11_grid_completion",
    t(q_ingest.LEDGER_VIEWS, """SELECT p.pass, c.label AS month, l.rows FROM cal c, (VALUES ('base'), ('age_gender'), ('placement'), ('region'), ('hourly')) p(pass)
    LEFT JOIN ledger l ON l.pass = p.pass AND l.month = c.label""", COVER),
)
def jn11(spark, d):
    return funnel.expected_grid(q_ingest.ledger(spark, d), calendar(spark, d), list(PASSES))


@query(
    "set3_expected_or_seen_months",
    t(q_ingest.LEDGER_VIEWS, "SELECT label AS month FROM cal UNION SELECT month FROM ledger WHERE month <> 'lump'", COVER),
)
def set3(spark, d):
    return funnel.coverage_matrix(q_ingest.ledger(spark, d), calendar(spark, d), ["base"]).select("month")


@query(
    "agg21_budget_share",
    t("ads_by_age_gender", """SELECT gender, sum(spend) / sum(sum(spend)) OVER () AS spend_share,
    sum(initiate_checkout) / sum(sum(initiate_checkout)) OVER () AS conversion_share FROM ads_by_age_gender GROUP BY 1"""),
    dp={"spend_share": 9, "conversion_share": 9},
)
def agg21(spark, d):
    return segments.budget_vs_outcome_shares(tb.ads_by_age_gender(spark, d), ["gender"], "initiate_checkout")


# --- windows and calendar measures --------------------------------------------


@query(
    "win1_active_day_index",
    t(DAILY, f"SELECT ad_id, CAST(date AS VARCHAR) AS date, {big('day_n')} AS day_n FROM panel", PANEL),
    dates=("date",),
)
def win1(spark, d):
    return panel(spark, d).select("ad_id", "date", "day_n")


@query(
    "win2_lifetime",
    t(DAILY, f"SELECT ad_id, {big('max(day_n)')} AS lifetime FROM panel GROUP BY 1 HAVING max(day_n) >= 25", PANEL),
)
def win2(spark, d):
    rows = panel(spark, d).where("lifetime >= 25")
    return rows.groupBy("ad_id").agg(F.max("day_n").alias("lifetime"))


@query(
    "jn4_eligibility_semi_join",
    t(DAILY, f"""SELECT ad_id, {big('count(*)')} AS n, sum(spend) AS spend FROM panel
    WHERE ad_id IN (SELECT ad_id FROM panel GROUP BY 1 HAVING max(day_n) >= 30) GROUP BY 1""", PANEL),
    dp={"spend": 2},
)
def jn4(spark, d):
    return panel(spark, d).where("lifetime >= 30").groupBy("ad_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("spend").alias("spend")
    )


MONTH_SPEND = """m AS (SELECT date_trunc('month', date) AS month, sum(spend) AS spend FROM ads_daily GROUP BY 1),
sp AS (SELECT CAST(unnest(generate_series(CAST((SELECT min(month) FROM m) AS TIMESTAMP), CAST((SELECT max(month) FROM m) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month)"""


@query(
    "win11_previous_month",
    t(DAILY, """SELECT sp.month, spend, lag(spend) OVER (ORDER BY sp.month) AS previous_spend,
    (spend - lag(spend) OVER (ORDER BY sp.month)) / nullif(lag(spend) OVER (ORDER BY sp.month), 0) AS variation
    FROM sp LEFT JOIN m ON m.month = sp.month""", MONTH_SPEND),
    dp={"spend": 2, "previous_spend": 2, "variation": 9},
    dates=("month",),
)
def win11(spark, d):
    return funnel.previous_month(tb.ads_daily(spark, d))


@query(
    "win12_year_to_date",
    t(DAILY, """SELECT date, sum(spend) AS spend, sum(sum(spend)) OVER (PARTITION BY year(date) ORDER BY date
    ROWS UNBOUNDED PRECEDING) AS spend_ytd FROM ads_daily GROUP BY 1"""),
    dp={"spend": 2, "spend_ytd": 2},
    dates=("date",),
)
def win12(spark, d):
    return funnel.year_to_date(tb.ads_daily(spark, d))


@query(
    "win13_launch_window",
    t(DAILY, f"""SELECT a.ad_id, sum(CASE WHEN date - first_day <= 1 THEN a.spend END) AS spend_launch,
    {big('sum(CASE WHEN date - first_day <= 1 THEN a.initiate_checkout END)')} AS checkouts_launch,
    {big('max(date - first_day)')} AS days_since_launch,
    sum(CASE WHEN date - first_day <= 1 THEN a.initiate_checkout END) / nullif(sum(CASE WHEN date - first_day <= 1 THEN a.spend END), 0) AS launch_rule
    FROM ads_daily a JOIN life ON life.ad_id = a.ad_id GROUP BY 1""", LIFE),
    dp={"spend_launch": 2, "launch_rule": 12},
)
def win13(spark, d):
    daily = tb.ads_daily(spark, d)
    return funnel.launch_window(daily)


@query(
    "win14_rest_index",
    t("ads_by_age_gender", """SELECT age, gender, spend, conversions, (conversions / spend) /
    ((sum(conversions) OVER () - conversions) / (sum(spend) OVER () - spend)) AS rest_index FROM (SELECT age, gender,
    sum(spend) AS spend, CAST(sum(initiate_checkout) AS DOUBLE) AS conversions FROM ads_by_age_gender GROUP BY 1, 2) g"""),
    dp={"spend": 2, "rest_index": 9},
)
def win14(spark, d):
    return segments.rest_index(tb.ads_by_age_gender(spark, d), ["age", "gender"], "initiate_checkout")


# --- measures -----------------------------------------------------------------

MEASURES = """sum(spend) AS spend, sum(impressions) AS impressions, CAST(sum(link_click) AS BIGINT) AS link_clicks,
    CAST(sum(initiate_checkout) AS BIGINT) AS checkouts, CAST(sum(purchase) AS BIGINT) AS purchases,
    sum(link_click) / nullif(sum(impressions), 0) AS ctr_link, sum(spend) / nullif(sum(impressions), 0) * 1000 AS cpm,
    sum(spend) / nullif(sum(initiate_checkout), 0) AS cost_per_checkout,
    sum(initiate_checkout) / nullif(sum(spend), 0) AS checkouts_per_dollar,
    sum(purchase) / nullif(sum(initiate_checkout), 0) AS checkout_to_purchase"""
MEASURE_DP = {
    "spend": 2, "ctr_link": 9, "cpm": 6, "cost_per_checkout": 6, "checkouts_per_dollar": 12, "checkout_to_purchase": 9,
}


@query("mea1_base_measures", t(DAILY, f"SELECT campaign_id, {MEASURES} FROM ads_daily GROUP BY 1"), dp=MEASURE_DP)
def mea1(spark, d):
    return funnel.measures(tb.ads_daily(spark, d), ["campaign_id"])


@query(
    "mea2_by_event_id",
    t(DAILY, f"SELECT {EVENT_ID} AS event_id, {MEASURES} FROM ads_daily GROUP BY 1"),
    dp=MEASURE_DP,
)
def mea2(spark, d):
    daily = tb.ads_daily(spark, d)
    dim = star.dim_campaign(daily).select("campaign_id", "event_id")
    return funnel.measures(daily.join(dim, "campaign_id"), ["event_id"])


@query(
    "mea3_placement_scatter",
    t("ads_by_placement", f"SELECT publisher_platform, platform_position, {MEASURES} FROM ads_by_placement GROUP BY 1, 2"),
    dp=MEASURE_DP,
)
def mea3(spark, d):
    return funnel.measures(tb.ads_by_placement(spark, d), ["publisher_platform", "platform_position"])


@query(
    "mea3_ad_scatter",
    t([DAILY, "creatives"], f"""SELECT a.ad_id, c.is_video, ctr_link, checkouts_per_dollar FROM (SELECT ad_id, {MEASURES} FROM ads_daily GROUP BY 1) a
    LEFT JOIN (SELECT ad_id, coalesce(video_id <> '', false) AS is_video FROM creatives) c ON c.ad_id = a.ad_id"""),
    dp={"ctr_link": 9, "checkouts_per_dollar": 12},
)
def mea3_ads(spark, d):
    daily = tb.ads_daily(spark, d)
    dim = star.dim_ad(daily, tb.creatives(spark, d)).select("ad_id", "is_video")
    return funnel.measures(daily, ["ad_id"]).join(dim, "ad_id").select("ad_id", "is_video", "ctr_link", "checkouts_per_dollar")


@query(
    "mea4_night_spend_share",
    "SELECT sum(CASE WHEN hour(ts) BETWEEN 3 AND 7 THEN value ELSE 0 END) AS night_spend, sum(value) AS spend, sum(CASE WHEN hour(ts) BETWEEN 3 AND 7 THEN value ELSE 0 END) / sum(value) AS night_share FROM events",
    dp={"night_spend": 2, "spend": 2, "night_share": 9},
)
def mea4(spark, d):
    return funnel.night_spend_share(tb.campaigns_by_hour(spark, d))


@query(
    "mea5_frequency_by_life_stage",
    t(DAILY, f"""SELECT CASE WHEN day_n <= 3 THEN 'early' WHEN day_n BETWEEN 8 AND 12 THEN 'mid' ELSE 'late' END AS stage,
    {big('count(*)')} AS n, avg(frequency) AS mean_frequency FROM panel
    WHERE day_n <= 3 OR day_n BETWEEN 8 AND 12 OR day_n > 15 GROUP BY 1""", PANEL),
    dp={"mean_frequency": 9},
)
def mea5(spark, d):
    return funnel.frequency_by_life_stage(panel(spark, d))


@query(
    "mea6_monthly_coverage",
    t(DAILY, f"""SELECT strftime(date, '%Y-%m') AS month, {big('count(*)')} AS n_rows, sum(spend) AS spend,
    avg(CASE WHEN coalesce(spend, 0) > 0 THEN 1.0 ELSE 0.0 END) AS spend_coverage FROM ads_daily GROUP BY 1"""),
    dp={"spend": 2, "spend_coverage": 9},
)
def mea6(spark, d):
    return funnel.monthly_coverage(tb.ads_daily(spark, d))

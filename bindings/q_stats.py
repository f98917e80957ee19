"""Statistical kernels on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import tables as tb
from bindings.q_funnel import PANEL, big, panel
from bindings.registry import query
from bindings.sql_tails import normal_two_sided, rho_p, student_two_sided
from bindings.sql_draws import key_text, multinomial_ctes, poisson_ctes
from spendlens.operators import bootstrap, ordering, stats


def lines(spark, d):
    return tb.load(spark, d, "lineitem")


# --- ranks, centring, group sizes ---------------------------------------------


@query(
    "win3_group_centring",
    """SELECT p_partkey, p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_brand) AS centred FROM part""",
    dp={"centred": 6},
)
def win3(spark, d):
    return stats.centred(tb.load(spark, d, "part"), "p_brand", {"centred": "p_retailprice"}, 1).select("p_partkey", "centred")


@query(
    "win4_group_size_filter",
    f"SELECT l_partkey, {big('count(*)')} AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 30",
)
def win4(spark, d):
    kept = stats.centred(lines(spark, d), "l_partkey", {"c": "l_quantity"}, 30)
    return kept.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))


P_ROWS = """(SELECT l_returnflag AS family, power(((l_orderkey * 7919 + l_partkey * 104729) % 100003) / 100003, 2) AS p
    FROM lineitem)"""


def p_rows(spark, d):
    raw = ((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729) % 100003) / 100003
    return lines(spark, d).select(F.col("l_returnflag").alias("family"), F.pow(raw, F.lit(2.0)).alias("p"))


BH_SQL = """SELECT family, p, least(1.0, min(s) OVER (PARTITION BY family ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) AS q
    FROM (SELECT family, p, p * count(*) OVER (PARTITION BY family) / row_number() OVER (PARTITION BY family ORDER BY p) AS s FROM {src} x) y"""


@query("sta3_benjamini_hochberg", f"SELECT family, p, min(q) AS q, {big('count(*)')} AS n FROM ({BH_SQL.format(src=P_ROWS)}) z GROUP BY 1, 2", dp={"p": 12, "q": 9})
def sta3(spark, d):
    out = stats.benjamini_hochberg(p_rows(spark, d), "p", "q", ["family"])
    return out.groupBy("family", "p").agg(F.min("q").alias("q"), F.count(F.lit(1)).alias("n"))


PART_P = "(SELECT p_brand AS family, power((p_partkey * 7919 % 10007) / 10007, 2) AS p FROM part)"


@query("win7_bh_step_up", BH_SQL.format(src=PART_P), dp={"p": 12, "q": 9})
def win7(spark, d):
    p = F.pow((F.col("p_partkey") * 7919 % 10007) / 10007, F.lit(2.0))
    rows = tb.load(spark, d, "part").select(F.col("p_brand").alias("family"), p.alias("p"))
    return stats.benjamini_hochberg(rows, "p", "q", ["family"])


@query(
    "win8_average_rank",
    f"""SELECT l_returnflag, l_quantity, max(r) AS mid_rank, {big('count(*)')} AS n FROM (SELECT l_returnflag, l_quantity,
    rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) +
    (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS r FROM lineitem) x GROUP BY 1, 2""",
)
def win8(spark, d):
    return ordering.mid_ranks(lines(spark, d), "l_quantity", ["l_returnflag"])


# --- tests and correlations ---------------------------------------------------

BRANDS = """tot AS (SELECT sum(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) / sum(l_extendedprice) AS rate FROM lineitem),
br AS (SELECT p_brand, sum(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS o, sum(l_extendedprice) * max(rate) AS e
    FROM lineitem JOIN part ON l_partkey = p_partkey, tot GROUP BY 1)"""


def brands(spark, d):
    from spendlens.operators.segments import segment_totals

    rows = tb.ads_daily(spark, d).select(
        F.col("campaign_id").alias("p_brand"), "spend", F.coalesce("initiate_checkout", F.lit(0)).cast("double").alias("conversions")
    )
    return segment_totals(rows, ["p_brand"])


@query(
    "sta1_pearson_dispersion",
    f"WITH {BRANDS} SELECT greatest(1.0, sum(power(o - e, 2) / e) / (count(*) - 1)) AS dispersion FROM br WHERE e > 0",
    dp={"dispersion": 9},
)
def sta1(spark, d):
    return stats.pearson_dispersion(brands(spark, d), "conversions", "expected")


@query("sta2_score_z", f"WITH {BRANDS} SELECT p_brand, (o - e) / sqrt(1.5 * e) AS z FROM br", dp={"z": 9})
def sta2(spark, d):
    return brands(spark, d).select("p_brand", stats.score_z("conversions", "expected", F.lit(1.5)).alias("z"))


@query(
    "sta2_score_test_p",
    f"WITH {BRANDS}, zs AS (SELECT p_brand, (o - e) / sqrt(1.5 * e) AS z FROM br) SELECT p_brand, z, {normal_two_sided('z')} AS p_value FROM zs",
    dp={"z": 9, "p_value": 9},
)
def sta2_p(spark, d):
    return stats.score_test(brands(spark, d), "conversions", "expected", F.lit(1.5)).select("p_brand", "z", "p_value")


SPEARMAN = """ranked AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rx,
    rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS ry FROM lineitem),
rho AS (SELECT l_returnflag, count(*) AS n, corr(rx, ry) AS rho FROM ranked GROUP BY 1)"""


@query(
    "sta8_spearman",
    f"WITH {SPEARMAN} SELECT l_returnflag, {big('n')} AS n, rho, rho * sqrt((n - 2) / (1 - rho * rho)) AS t_stat FROM rho",
    dp={"rho": 9, "t_stat": 5},
)
def sta8(spark, d):
    return stats.spearman(lines(spark, d), "l_quantity", "l_extendedprice", ["l_returnflag"], with_p=False)


LANG_RANKS = """ranked AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS rx,
    rank() OVER (PARTITION BY lang ORDER BY quality) + (count(*) OVER (PARTITION BY lang, quality) - 1) / 2 AS ry
    FROM documents JOIN labels ON labels.doc_id = documents.doc_id),
rho AS (SELECT lang, count(*) AS n, corr(rx, ry) AS rho FROM ranked GROUP BY 1)"""


@query(
    "sta8_spearman_p",
    f"WITH {LANG_RANKS} SELECT lang, {big('n')} AS n, rho, rho * sqrt((n - 2) / (1 - rho * rho)) AS t_stat, {rho_p('rho', 'n')} AS p_value FROM rho",
    dp={"rho": 9, "t_stat": 6, "p_value": 9},
)
def sta8_p(spark, d):
    docs = tb.load(spark, d, "documents").join(tb.load(spark, d, "labels"), "doc_id")
    return stats.spearman(docs, "n_chars", "quality", ["lang"])


@query(
    "sta9_exact_auc",
    f"""SELECT l_linestatus, {big('n1')} AS n_pos, {big('n0')} AS n_neg, (r1 - n1 * (n1 + 1) / 2) / (n1 * n0) AS auc FROM (
    SELECT l_linestatus, sum(CASE WHEN y THEN r END) AS r1, count(*) FILTER (y) AS n1, count(*) FILTER (NOT y) AS n0 FROM (
    SELECT l_linestatus, l_returnflag = 'R' AS y, rank() OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice) +
    (count(*) OVER (PARTITION BY l_linestatus, l_extendedprice) - 1) / 2 AS r FROM lineitem) x GROUP BY 1) z""",
    dp={"auc": 9},
)
def sta9(spark, d):
    rows = lines(spark, d).withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return stats.exact_auc(rows, "l_extendedprice", "y", ["l_linestatus"])


SCORED = """scored AS (SELECT d.doc_id, n_chars / 50000 AS p, quality AS y FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def scored_docs(spark, d):
    docs = tb.load(spark, d, "documents").join(tb.load(spark, d, "labels"), "doc_id")
    return docs.select("doc_id", (F.col("n_chars") / 50000).alias("p"), F.col("quality").alias("y"))


@query("sta11_brier", f"WITH {SCORED} SELECT avg(power(p - y, 2)) AS brier FROM scored", dp={"brier": 9})
def sta11(spark, d):
    return scored_docs(spark, d).agg(stats.brier("p", "y").alias("brier"))


@query(
    "sta12_calibration",
    f"""WITH {SCORED}, e AS (SELECT quantile_cont(p, 0.25) AS a, quantile_cont(p, 0.5) AS b, quantile_cont(p, 0.75) AS c FROM scored)
    SELECT CAST(CASE WHEN p <= a THEN 1 WHEN p <= b THEN 2 WHEN p <= c THEN 3 ELSE 4 END AS BIGINT) AS bin,
    {big('count(*)')} AS n, avg(p) AS predicted, avg(y) AS observed FROM scored, e GROUP BY 1""",
    dp={"predicted": 9, "observed": 9},
)
def sta12(spark, d):
    return stats.calibration(scored_docs(spark, d), "p", "y")


SLOPES = """slopes AS (SELECT ad_id, count(ctr) AS n, regr_slope(ctr, day_n) / avg(ctr) * 100 AS slope_pct FROM panel
    WHERE lifetime >= 12 GROUP BY 1 HAVING count(ctr) >= 8 AND stddev_samp(ctr) > 0)"""


def slopes(spark, d):
    return stats.relative_slope(panel(spark, d).where("lifetime >= 12"), "ad_id", "day_n", "ctr")


@query(
    "sta13_relative_slope",
    tb.with_tables("ads_daily", f"SELECT ad_id, {big('n')} AS n, slope_pct FROM slopes", f"{PANEL}, {SLOPES}"),
    dp={"slope_pct": 9},
)
def sta13(spark, d):
    return slopes(spark, d)


@query(
    "sta14_slope_summary",
    tb.with_tables(
        "ads_daily",
        f"""SELECT {big('count(*)')} AS n, avg(slope_pct) AS mean_slope, quantile_cont(slope_pct, 0.5) AS median_slope,
        avg(CASE WHEN slope_pct < 0 THEN 1.0 ELSE 0.0 END) AS share_negative,
        avg(slope_pct) / (stddev_samp(slope_pct) / sqrt(count(*))) AS t_stat FROM slopes""",
        f"{PANEL}, {SLOPES}",
    ),
    dp={"mean_slope": 9, "median_slope": 9, "share_negative": 9, "t_stat": 6},
)
def sta14(spark, d):
    return stats.slope_summary(slopes(spark, d))


@query(
    "sta14_slope_test_p",
    tb.with_tables(
        "ads_daily",
        f"""SELECT {big('n')} AS n, mean_slope, median_slope, share_negative, t_stat, {student_two_sided('t_stat', '(n - 1)')} AS p_value FROM (
        SELECT count(*) AS n, avg(slope_pct) AS mean_slope, quantile_cont(slope_pct, 0.5) AS median_slope,
        avg(CASE WHEN slope_pct < 0 THEN 1.0 ELSE 0.0 END) AS share_negative,
        avg(slope_pct) / (stddev_samp(slope_pct) / sqrt(count(*))) AS t_stat FROM slopes) x""",
        f"{PANEL}, {SLOPES}",
    ),
    dp={"mean_slope": 9, "median_slope": 9, "share_negative": 9, "t_stat": 6, "p_value": 6},
)
def sta14_p(spark, d):
    return stats.slope_test(slopes(spark, d))


@query(
    "sta15_median_split",
    f"""SELECT o_orderstatus, {big('sum(CASE WHEN o_totalprice > m THEN 1 ELSE 0 END)')} AS above, {big('count(*)')} AS n
    FROM orders, (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM orders) x GROUP BY 1""",
)
def sta15(spark, d):
    split = stats.above_median(tb.load(spark, d, "orders"), "o_totalprice", "y")
    return split.groupBy("o_orderstatus").agg(F.sum("y").alias("above"), F.count(F.lit(1)).alias("n"))


@query(
    "jn14_stats_broadcast",
    """SELECT l_returnflag, sum(l_extendedprice) / max(t) AS share, count(*) / max(n) AS row_share FROM lineitem,
    (SELECT sum(l_extendedprice) AS t, count(*) AS n FROM lineitem) x GROUP BY 1""",
    dp={"share": 9, "row_share": 9},
)
def jn14(spark, d):
    g = lines(spark, d).groupBy("l_returnflag").agg(F.sum("l_extendedprice").alias("s"), F.count(F.lit(1)).alias("c"))
    t = g.agg(F.sum("s").alias("t"), F.sum("c").alias("n"))
    return g.crossJoin(F.broadcast(t)).select(
        "l_returnflag", (F.col("s") / F.col("t")).alias("share"), (F.col("c") / F.col("n")).alias("row_share")
    )


# --- bootstrap ----------------------------------------------------------------

N_BOOT = 2000
SEG_UNITS = """units AS (SELECT l_returnflag || '|' || l_linestatus AS seg, CAST(l_suppkey AS VARCHAR) AS unit,
    CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS DOUBLE) AS C, sum(l_extendedprice) AS S FROM lineitem GROUP BY 1, 2)"""
CI = "quantile_cont(rate, 0.025) AS rate_ci_low, quantile_cont(rate, 0.975) AS rate_ci_high"


def seg_units(spark, d):
    rows = lines(spark, d).select(
        F.concat("l_returnflag", F.lit("|"), "l_linestatus").alias("seg"),
        F.col("l_suppkey").cast("string").alias("unit"),
        (F.col("l_quantity") > 25).cast("double").alias("c"),
        F.col("l_extendedprice").alias("s"),
    )
    return bootstrap.cluster_units(rows, ["seg"], "unit", "c", "s")


@query(
    "sta4_row_bootstrap_ci",
    f"""WITH rows_ AS (SELECT 'all' AS stratum, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS C, o_totalprice AS S FROM orders),
    {multinomial_ctes("rows_", "stratum", "o_orderkey", N_BOOT)},
    rates AS (SELECT b, sum(C) / sum(S) AS rate FROM boot_hit GROUP BY 1)
    SELECT {CI}, {big('count(rate)')} AS n_valid FROM rates""",
    dp={"rate_ci_low": 15, "rate_ci_high": 15},
)
def sta4(spark, d):
    rows = tb.load(spark, d, "orders").withColumn("c", (F.col("o_orderstatus") == "F").cast("double"))
    return bootstrap.row_bootstrap_interval(rows, "o_orderkey", "c", "o_totalprice", N_BOOT, mode="multinomial")


@query(
    "sta5_cluster_bootstrap_multinomial",
    f"""WITH {SEG_UNITS}, {multinomial_ctes("units", "seg", "unit", N_BOOT)}
    SELECT st AS seg, {big('b')} AS b, sum(C) / sum(S) AS rate FROM boot_hit GROUP BY 1, 2""",
    dp={"rate": 15},
)
def sta5_multinomial(spark, d):
    return bootstrap.bootstrap_rates(seg_units(spark, d), ["seg"], "unit", N_BOOT, mode="multinomial")


POISSON_RATES = f"""{SEG_UNITS}, {poisson_ctes("units", key_text("seg", "unit"), N_BOOT)},
    rates AS (SELECT seg, b, sum(w * C) / sum(w * S) AS rate FROM boot_w GROUP BY 1, 2)"""


@query("sta5_cluster_bootstrap_poisson", f"WITH {POISSON_RATES} SELECT seg, {big('b')} AS b, rate FROM rates", dp={"rate": 15})
def sta5_poisson(spark, d):
    return bootstrap.bootstrap_rates(seg_units(spark, d), ["seg"], "unit", N_BOOT, mode="poisson")


@query(
    "sta6_bootstrap_pvalue",
    f"""WITH {POISSON_RATES}, ref AS (SELECT sum(C) / sum(S) AS ref FROM units)
    SELECT seg, least(1.0, greatest(2 * least(avg(CASE WHEN rate <= ref THEN 1.0 ELSE 0.0 END),
    avg(CASE WHEN rate >= ref THEN 1.0 ELSE 0.0 END)), 1 / (count(rate) + 1))) AS p_value FROM rates, ref GROUP BY 1""",
    dp={"p_value": 9},
)
def sta6(spark, d):
    units = seg_units(spark, d)
    ref = units.agg((F.sum("C") / F.sum("S")).alias("ref"))
    rates = bootstrap.bootstrap_rates(units, ["seg"], "unit", N_BOOT, mode="poisson")
    return rates.crossJoin(F.broadcast(ref)).groupBy("seg").agg(bootstrap.bootstrap_p("rate", "ref").alias("p_value"))


@query(
    "sta7_percentile_ci",
    f"WITH {POISSON_RATES} SELECT seg, {CI}, {big('count(rate)')} AS n_valid FROM rates GROUP BY 1",
    dp={"rate_ci_low": 15, "rate_ci_high": 15},
)
def sta7(spark, d):
    return bootstrap.interval(bootstrap.bootstrap_rates(seg_units(spark, d), ["seg"], "unit", N_BOOT, mode="poisson"), ["seg"])


@query(
    "sta7_exact_percentiles",
    """SELECT l_returnflag, quantile_cont(l_extendedprice, 0.025) AS lo, quantile_cont(l_extendedprice, 0.5) AS mid,
    quantile_cont(l_extendedprice, 0.975) AS hi FROM lineitem GROUP BY 1""",
    dp={"lo": 6, "mid": 6, "hi": 6},
)
def sta7_exact(spark, d):
    return ordering.exact_percentiles(
        lines(spark, d), "l_extendedprice", {"lo": 0.025, "mid": 0.5, "hi": 0.975}, ["l_returnflag"]
    )


AUC_UNITS = "units AS (SELECT CAST(p_partkey AS VARCHAR) AS unit, p_retailprice AS s, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS y FROM part)"
WEIGHTED_AUC = """areas AS (SELECT {keys}b, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM (
    SELECT {keys}b, s, pos, neg, coalesce(sum(neg) OVER (PARTITION BY {keys}b ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
    FROM (SELECT {keys}b, s, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS pos, sum(CASE WHEN y = 1 THEN 0 ELSE w END) AS neg
    FROM boot_w WHERE w > 0 GROUP BY ALL) g) h GROUP BY ALL)"""
AUC_CI = "quantile_cont(auc, 0.025) AS auc_low, quantile_cont(auc, 0.975) AS auc_high, CAST(count(auc) AS BIGINT) AS n_valid"


@query(
    "sta10_bootstrap_auc_ci",
    f"""WITH {AUC_UNITS}, {poisson_ctes("units", key_text("unit"), N_BOOT)}, {WEIGHTED_AUC.format(keys="")} SELECT {AUC_CI} FROM areas""",
    dp={"auc_low": 9, "auc_high": 9},
)
def sta10(spark, d):
    rows = tb.load(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("unit"),
        F.col("p_retailprice").alias("s"),
        (F.col("p_size") > 25).cast("int").alias("y"),
    )
    return bootstrap.auc_interval(rows, "unit", "s", "y", N_BOOT)

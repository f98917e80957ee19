"""Segment ranking and reallocation on several families."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import tables as tb
from bindings.q_funnel import big
from bindings.registry import query
from bindings.sql_draws import key_text, multinomial_ctes, poisson_ctes
from spendlens.operators import reallocation, segments
from spendlens.plans import published, star
from spendlens.schema import HOUR_RANGE

N_BOOT = 2000
# family -> (view, dimensions, cluster column, outcome)
BINDINGS = {
    "age_gender": ("ads_by_age_gender", ("age", "gender"), "ad_id", "initiate_checkout"),
    "placement": ("ads_by_placement", ("publisher_platform", "platform_position"), "ad_id", "initiate_checkout"),
    "device": ("ads_by_placement", ("impression_device",), "ad_id", "initiate_checkout"),
    "region": ("ads_by_region", ("region",), "ad_id", "link_click"),
    "hourly": ("campaigns_by_hour", (HOUR_RANGE,), "campaign_id", "initiate_checkout"),
}
SEG_DP = {
    "spend": 2, "conversions": 2, "expected": 6, "z_poisson": 6, "perf_index": 9, "rate": 12, "account_rate": 12,
    "cost_per_conv": 4, "spend_share": 9, "reference_rate": 12, "rate_ci_low": 12, "rate_ci_high": 12, "p_value": 9,
    "q_value": 9, "cpc_ci_low": 4, "cpc_ci_high": 4,
}


def segment_ctes(family: str, mode: str, min_expected: float = 5.0, min_share: float = 0.002) -> str:
    """CTEs from the family's view to ``scored`` and ``excluded``."""
    view, dims, cluster, outcome = BINDINGS[family]
    dim_list = ", ".join(dims)
    label = " || ' / ' || ".join(f"coalesce({c}, 'nan')" for c in dims)
    stratum = key_text(*dims)
    known = " AND ".join(f"{c} IS NOT NULL" for c in dims)
    if mode == "poisson":
        boot = poisson_ctes("boot_units", "stratum || " + key_text("unit"), N_BOOT)
        rates = "SELECT stratum, b, sum(w * C) / nullif(sum(w * S), 0) AS rate FROM boot_w GROUP BY 1, 2"
    else:
        boot = multinomial_ctes("boot_units", "stratum", "unit", N_BOOT, text="stratum")
        rates = "SELECT st AS stratum, b, sum(C) / nullif(sum(S), 0) AS rate FROM boot_hit GROUP BY 1, 2"
    return f"""
seg_rows AS (SELECT {dim_list}, {cluster} AS unit, CAST(spend AS DOUBLE) AS spend,
    CAST(coalesce({outcome}, 0) AS DOUBLE) AS conv FROM {view} WHERE spend > 0),
grouped AS (SELECT {dim_list}, {label} AS segment, {stratum} AS stratum, sum(spend) AS spend, sum(conv) AS conversions,
    count(*) AS n_rows, CASE WHEN {known} THEN count(DISTINCT unit) ELSE 0 END AS n_ads FROM seg_rows GROUP BY {dim_list}),
tot AS (SELECT *, sum(spend) OVER () AS ts, sum(conversions) OVER () AS tc FROM grouped),
ex AS (SELECT *, spend * (tc / ts) AS expected, (tc - conversions) / nullif(ts - spend, 0) AS ref FROM tot),
kept AS (SELECT * FROM ex WHERE expected >= {min_expected} AND spend >= {min_share} * ts),
excluded AS (SELECT * FROM ex WHERE NOT (expected >= {min_expected} AND spend >= {min_share} * ts)),
phi AS (SELECT CASE WHEN count(*) > 1 THEN greatest(1.0, sum(power(conversions - expected, 2) / expected) / nullif(count(*) - 1, 0)) ELSE 1.0 END AS phi FROM kept WHERE expected > 0),
boot_units AS (SELECT k.stratum, r.unit, sum(r.conv) AS C, sum(r.spend) AS S FROM seg_rows r JOIN kept k
    ON {" AND ".join(f"k.{c} = r.{c}" for c in dims)} WHERE k.n_ads >= 2 GROUP BY 1, 2),
{boot},
rates AS ({rates}),
inf AS (SELECT rates.stratum, quantile_cont(rate, 0.025) AS lo, quantile_cont(rate, 0.975) AS hi,
    least(1.0, greatest(2 * least(avg(CASE WHEN rate <= ref THEN 1.0 ELSE 0.0 END), avg(CASE WHEN rate >= ref THEN 1.0 ELSE 0.0 END)),
    1 / (count(rate) + 1))) AS p FROM rates JOIN kept ON kept.stratum = rates.stratum WHERE rate IS NOT NULL GROUP BY 1),
pv AS (SELECT k.*, lo, hi, coalesce(p, 1.0) AS p_value, sqrt(phi * expected) AS se FROM kept k CROSS JOIN phi LEFT JOIN inf ON inf.stratum = k.stratum),
bh AS (SELECT *, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value, segment) AS s FROM pv),
scored AS (SELECT segment, {dim_list}, spend, conversions, {big('n_rows')} AS n_rows, expected,
    CASE WHEN se > 0 THEN (conversions - expected) / se ELSE 0 END AS z_poisson, conversions / expected AS perf_index,
    conversions / spend AS rate, tc / ts AS account_rate, CASE WHEN conversions > 0 THEN spend / conversions END AS cost_per_conv,
    spend / ts AS spend_share, {big('n_ads')} AS n_ads, ref AS reference_rate, lo AS rate_ci_low, hi AS rate_ci_high, p_value,
    least(1.0, min(s) OVER (ORDER BY p_value DESC, segment DESC ROWS UNBOUNDED PRECEDING)) AS q_value,
    least(1.0, min(s) OVER (ORDER BY p_value DESC, segment DESC ROWS UNBOUNDED PRECEDING)) < 0.05 AS significant,
    CASE WHEN hi > 0 THEN 1 / hi END AS cpc_ci_low, CASE WHEN lo > 0 THEN 1 / lo END AS cpc_ci_high FROM bh)"""


def sql(family, mode, body, **floors):
    return tb.with_tables(BINDINGS[family][0], body, segment_ctes(family, mode, **floors))


def ranking(spark, d, family, mode, **options):
    view, dims, cluster, outcome = BINDINGS[family]
    return segments.rank_segments(
        getattr(tb, view)(spark, d), dims, cluster=cluster, outcome=outcome, n_boot=N_BOOT, mode=mode, **options
    )


def _register(key, family, mode):
    @query(key, sql(family, mode, "SELECT * FROM scored"), dp=SEG_DP)
    def run(spark, d):
        return ranking(spark, d, family, mode).scored

    return run


_register("seg5_placement_ranking", "placement", "poisson")
_register("seg5_age_gender_ranking", "age_gender", "poisson")
_register("seg5_device_ranking", "device", "poisson")
_register("seg5_region_ranking", "region", "poisson")
_register("seg5_hourly_ranking", "hourly", "multinomial")


@query(
    "seg2_group_totals",
    tb.with_tables("ads_by_age_gender", f"""SELECT age, gender, spend, conversions, {big('n_rows')} AS n_rows,
    sum(spend) OVER () AS total_spend, sum(conversions) OVER () AS total_conversions,
    spend * (sum(conversions) OVER () / sum(spend) OVER ()) AS expected FROM (SELECT age, gender, sum(spend) AS spend,
    CAST(sum(coalesce(initiate_checkout, 0)) AS DOUBLE) AS conversions, count(*) AS n_rows FROM ads_by_age_gender
    WHERE spend > 0 GROUP BY 1, 2) g"""),
    dp={"spend": 2, "total_spend": 2, "expected": 6},
)
def seg2(spark, d):
    rows = tb.ads_by_age_gender(spark, d).where("spend > 0").select(
        "age", "gender", "spend", F.coalesce("initiate_checkout", F.lit(0)).cast("double").alias("conversions")
    )
    return segments.segment_totals(rows, ["age", "gender"])


@query(
    "seg3_excluded_segments",
    sql("age_gender", "poisson", f"SELECT age, gender, spend, conversions, {big('n_rows')} AS n_rows, expected FROM excluded", min_share=0.05),
    dp={"spend": 2, "expected": 6},
)
def seg3(spark, d):
    return ranking(spark, d, "age_gender", "poisson", min_spend_share=0.05).excluded


@query(
    "agg18_excluded_summary",
    sql("age_gender", "poisson", f"SELECT {big('count(*)')} AS n_segments, coalesce(sum(spend), 0) AS spend FROM excluded", min_share=0.05),
    dp={"spend": 2},
)
def agg18(spark, d):
    return segments.excluded_summary(ranking(spark, d, "age_gender", "poisson", min_spend_share=0.05).excluded)


@query(
    "seg4_segment_rates",
    sql("device", "poisson", """SELECT segment, impression_device, rate, perf_index, cost_per_conv, spend_share, z_poisson FROM scored"""),
    dp={k: SEG_DP[k] for k in ("rate", "perf_index", "cost_per_conv", "spend_share", "z_poisson")},
)
def seg4(spark, d):
    scored = ranking(spark, d, "device", "poisson").scored
    return scored.select("segment", "impression_device", "rate", "perf_index", "cost_per_conv", "spend_share", "z_poisson")


@query(
    "seg6_cost_interval",
    sql("age_gender", "poisson", "SELECT segment, cost_per_conv, cpc_ci_low, cpc_ci_high FROM scored"),
    dp={"cost_per_conv": 4, "cpc_ci_low": 4, "cpc_ci_high": 4},
)
def seg6(spark, d):
    return ranking(spark, d, "age_gender", "poisson").scored.select("segment", "cost_per_conv", "cpc_ci_low", "cpc_ci_high")


@query(
    "seg7_ranking_summary",
    sql("placement", "poisson", f"""SELECT (SELECT max(ts) FROM ex) AS total_spend, (SELECT max(tc) FROM ex) AS total_conversions,
    (SELECT max(tc) / max(ts) FROM ex) AS global_rate, phi AS dispersion, (SELECT {big('count(*)')} FROM kept) AS n_tested,
    (SELECT {big('count(*)')} FROM excluded) AS n_excluded, CAST({N_BOOT} AS BIGINT) AS n_boot, 'poisson' AS mode FROM phi"""),
    dp={"total_spend": 2, "global_rate": 12, "dispersion": 4},
)
def seg7(spark, d):
    return ranking(spark, d, "placement", "poisson").summary


@query(
    "seg7_no_outcome",
    tb.with_tables("ads_by_region", f"""SELECT sum(spend) AS total_spend, CAST(0 AS DOUBLE) AS total_conversions, CAST(0 AS DOUBLE) AS global_rate,
    CAST(0 AS BIGINT) AS n_tested, CAST(0 AS BIGINT) AS n_excluded, CAST(0 AS BIGINT) AS n_scored FROM ads_by_region WHERE spend > 0"""),
    dp={"total_spend": 2},
)
def seg7_empty(spark, d):
    """Pixel checkouts by region do not exist: nothing is ranked, the account's spend stands."""
    view, dims, cluster, _ = BINDINGS["region"]
    out = segments.rank_segments(
        tb.ads_by_region(spark, d), dims, cluster=cluster, outcome="initiate_checkout", n_boot=N_BOOT, mode="poisson"
    )
    scored = out.scored.agg(F.count(F.lit(1)).alias("n_scored"))
    totals = out.summary.select("total_spend", "total_conversions", "global_rate", "n_tested", "n_excluded")
    return totals.crossJoin(F.broadcast(scored))


@query("win5_spend_shares", sql("placement", "poisson", "SELECT segment, spend_share, expected FROM scored"), dp={"spend_share": 9, "expected": 6})
def win5(spark, d):
    return ranking(spark, d, "placement", "poisson").scored.select("segment", "spend_share", "expected")


@query("win6_leave_one_out", sql("device", "poisson", "SELECT segment, reference_rate FROM scored"), dp={"reference_rate": 12})
def win6(spark, d):
    return ranking(spark, d, "device", "poisson").scored.select("segment", "reference_rate")


@query(
    "jn6_null_segments",
    sql("age_gender", "poisson", "SELECT segment, n_ads, p_value, rate_ci_low FROM scored WHERE gender IS NULL"),
    dp={"p_value": 9, "rate_ci_low": 12},
)
def jn6(spark, d):
    scored = ranking(spark, d, "age_gender", "poisson").scored
    return scored.where("gender IS NULL").select("segment", "n_ads", "p_value", "rate_ci_low")


@query(
    "prj24_index_interval",
    sql("device", "poisson", "SELECT segment, rate_ci_low / account_rate AS perf_ci_low, rate_ci_high / account_rate AS perf_ci_high FROM scored"),
    dp={"perf_ci_low": 9, "perf_ci_high": 9},
)
def prj24(spark, d):
    scored = segments.with_index_interval(ranking(spark, d, "device", "poisson").scored)
    return scored.select("segment", "perf_ci_low", "perf_ci_high")


@query(
    "top1_ranked_segments",
    sql("age_gender", "poisson", f"SELECT segment, perf_index, {big('row_number() OVER (ORDER BY perf_index DESC, segment)')} AS place FROM scored"),
    dp={"perf_index": 9},
)
def top1(spark, d):
    from pyspark.sql import Window

    scored = ranking(spark, d, "age_gender", "poisson").scored
    place = F.row_number().over(Window.orderBy(F.desc("perf_index"), "segment"))
    return scored.select("segment", "perf_index", place.alias("place"))


@query(
    "top2_head_and_tail",
    sql("age_gender", "poisson", """SELECT segment, perf_index, CASE WHEN r <= 4 THEN 'head' ELSE 'tail' END AS part FROM (
    SELECT segment, perf_index, row_number() OVER (ORDER BY perf_index DESC, segment) AS r, count(*) OVER () AS n FROM scored) x
    WHERE r <= 4 OR (n > 8 AND r > n - 4)"""),
    dp={"perf_index": 9},
)
def top2(spark, d):
    scored = ranking(spark, d, "age_gender", "poisson").scored
    return segments.head_and_tail(scored, 4).select("segment", "perf_index", "part")


# --- reallocation -------------------------------------------------------------

MOVED = """d AS (SELECT * FROM scored WHERE significant AND perf_index < 1),
r AS (SELECT *, spend / sum(spend) OVER () * (SELECT sum(spend) FROM d) AS extra_spend FROM scored WHERE significant AND perf_index > 1),
m AS (SELECT *, spend + extra_spend AS new_spend, rate * (spend + extra_spend) AS linear_conversions,
    conversions * power((spend + extra_spend) / spend, 0.8) AS saturated_conversions FROM r WHERE extra_spend IS NOT NULL),
z AS (SELECT (SELECT sum(conversions) FROM scored) AS base, (SELECT sum(conversions) FROM d) AS lost,
    (SELECT sum(spend) FROM d) AS freed, sum(conversions) AS rc, sum(linear_conversions) AS l, sum(saturated_conversions) AS s FROM m HAVING count(*) > 0)"""


def moved_sql(body):
    return tb.with_tables("ads_by_placement", body, segment_ctes("placement", "poisson") + ", " + MOVED)


def moved(spark, d):
    return reallocation.simulate(ranking(spark, d, "placement", "poisson").scored)


@query(
    "rea1_donors_recipients",
    moved_sql("SELECT 'donor' AS role, segment, spend FROM d UNION ALL SELECT 'recipient', segment, spend FROM m"),
    dp={"spend": 2},
)
def rea1(spark, d):
    out = moved(spark, d)
    donors = out.donors.select(F.lit("donor").alias("role"), "segment", "spend")
    return donors.unionByName(out.recipients.select(F.lit("recipient").alias("role"), "segment", "spend"))


ROW_DP = {"spend": 2, "extra_spend": 2, "new_spend": 2, "linear_conversions": 6, "saturated_conversions": 6}


@query(
    "rea2_reallocation_rows",
    moved_sql("SELECT segment, spend, extra_spend, new_spend, linear_conversions, saturated_conversions FROM m"),
    dp=ROW_DP,
)
def rea2(spark, d):
    return moved(spark, d).recipients.select("segment", *ROW_DP)


@query("win9_recipient_share", moved_sql("SELECT segment, spend / sum(spend) OVER () AS share FROM m"), dp={"share": 9})
def win9(spark, d):
    out = moved(spark, d).recipients
    total = out.agg(F.sum("extra_spend").alias("freed"))
    return out.crossJoin(F.broadcast(total)).select("segment", (F.col("extra_spend") / F.col("freed")).alias("share"))


@query("top3_largest_donors", moved_sql("SELECT segment, spend FROM d ORDER BY spend DESC, segment LIMIT 3"), dp={"spend": 2})
def top3(spark, d):
    return moved(spark, d).donors.select("segment", "spend").limit(3)


TOTAL_DP = {
    "freed_spend": 2, "linear_conversions": 6, "saturated_conversions": 6, "saturation": 2, "linear_gain": 6,
    "linear_gain_pct": 6, "saturated_gain": 6, "saturated_gain_pct": 6,
}


@query(
    "rea3_reallocation_totals",
    moved_sql("""SELECT freed AS freed_spend, lost AS lost_conversions, base AS baseline_conversions, base - lost - rc + l AS linear_conversions,
    base - lost - rc + s AS saturated_conversions, CAST(0.8 AS DOUBLE) AS saturation, l - lost - rc AS linear_gain,
    (l - lost - rc) / base * 100 AS linear_gain_pct, s - lost - rc AS saturated_gain, (s - lost - rc) / base * 100 AS saturated_gain_pct FROM z"""),
    dp=TOTAL_DP,
)
def rea3(spark, d):
    return moved(spark, d).totals


# --- several families ---------------------------------------------------------

FAMILY_SPECS = {
    name: segments.SegmentSpec(name, view, dims, cluster, outcome if name == "region" else None, name != "region")
    for name, (view, dims, cluster, outcome) in BINDINGS.items()
}
STAT_DP = {k: v for k, v in SEG_DP.items() if k in star.STAT_COLUMNS}


def all_families_sql(mode):
    """Each family as a nested statement of its own, stacked."""
    cols = ", ".join(c for c in star.STAT_COLUMNS if c != "dimension")
    return "\nUNION ALL\n".join(
        f"SELECT '{f}' AS dimension, {cols} FROM ({sql(f, mode, f'SELECT {cols} FROM scored')}) AS {f}" for f in BINDINGS
    )


@query("seg8_all_families", all_families_sql("poisson"), dp=STAT_DP)
def seg8(spark, d):
    return star.segment_statistics(tb.views(spark, d), FAMILY_SPECS, n_boot=N_BOOT, mode="poisson")


@query(
    "set2_stacked_results",
    f"SELECT dimension, CAST(count(*) AS BIGINT) AS n, max(account_rate) AS account_rate FROM ({all_families_sql('poisson')}) a GROUP BY 1",
    dp={"account_rate": 12},
)
def set2(spark, d):
    out = star.segment_statistics(tb.views(spark, d), FAMILY_SPECS, n_boot=N_BOOT, mode="poisson")
    return out.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.max("account_rate").alias("account_rate"))


@query(
    "snk6_segment_table",
    sql("placement", "poisson", """SELECT segment AS "Emplacement", round_even(spend, 0) AS "Dépense ($)", round_even(conversions, 0) AS "Conversions",
    round(cost_per_conv, 2) AS "Coût / conv. ($)", round(cpc_ci_low, 2) AS "IC bas", round(cpc_ci_high, 2) AS "IC haut",
    round(perf_index, 2) AS "Indice", round(q_value, 4) AS "q", CASE WHEN significant THEN 'oui' ELSE '' END AS "Significatif" FROM scored"""),
)
def snk6_segments(spark, d):
    return published.segment_table(ranking(spark, d, "placement", "poisson").scored, "Emplacement")

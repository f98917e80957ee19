"""Early triage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import tables as tb
from bindings.q_funnel import FORMAT, PANEL, big, panel
from bindings.q_stats import AUC_CI, WEIGHTED_AUC
from bindings.registry import query
from bindings.sql_tails import rho_p
from bindings.sql_draws import key_text, poisson_ctes
from bindings.sql_newton import newton_ctes, newton_score
from spendlens.operators import stats, triage

EARLY, MIN_DAYS = 2, 5
TRIAGE = f"""{PANEL},
elig AS (SELECT * FROM panel WHERE lifetime >= {MIN_DAYS}),
early AS (SELECT ad_id, campaign_id, ad_name, sum(spend) AS e_spend, sum(impressions) AS e_imp, sum(clicks) AS e_clicks,
    avg(cpm) AS e_cpm, {big('sum(coalesce(landing_page_view, 0))')} AS e_lpv, {big('sum(coalesce(add_to_cart, 0))')} AS e_atc,
    {big('sum(coalesce(initiate_checkout, 0))')} AS e_ic, min(date) AS first_day FROM elig WHERE day_n <= {EARLY} GROUP BY 1, 2, 3),
late AS (SELECT ad_id, sum(spend) AS l_spend, {big('sum(coalesce(initiate_checkout, 0))')} AS l_ic, {big('count(*)')} AS l_days
    FROM elig WHERE day_n > {EARLY} GROUP BY 1),
base AS (SELECT early.*, l_spend, l_ic, l_days FROM early JOIN late ON late.ad_id = early.ad_id WHERE e_spend > 0 AND l_spend > 0),
feat AS (SELECT *, e_ic / e_spend AS e_icr, e_atc / e_spend AS e_atcr, e_lpv / e_spend AS e_lpvr, l_ic / l_spend AS late_icr,
    ln(1 + e_ic / e_spend) AS log_icr, ln(1 + e_atc / e_spend) AS log_atcr, ln(1 + e_lpv / e_spend) AS log_lpvr,
    ln(1 + coalesce(e_cpm, (SELECT quantile_cont(e_cpm, 0.5) FROM base))) AS log_cpm, ln(1 + e_spend) AS log_spend,
    {FORMAT} AS format, CAST({FORMAT} = 'reel' AS BIGINT) AS is_reel FROM base),
med AS (SELECT quantile_cont(late_icr, 0.5) AS med FROM feat),
lab AS (SELECT feat.*, CASE WHEN late_icr > med THEN 1 ELSE 0 END AS y FROM feat, med)"""


def sql(body, extra=""):
    return tb.with_tables("ads_daily", body, TRIAGE + (", " + extra if extra else ""))


def frame(spark, d):
    return triage.feature_frame(tb.ads_daily(spark, d), EARLY, MIN_DAYS)


@query(
    "tri1_daily_panel",
    sql(f"SELECT ad_id, date, {big('day_n')} AS day_n, {big('lifetime')} AS lifetime, {big('coalesce(initiate_checkout, 0)')} AS ic FROM elig"),
    dates=("date",),
)
def tri1(spark, d):
    return panel(spark, d).where(F.col("lifetime") >= MIN_DAYS).select("ad_id", "date", "day_n", "lifetime", "ic")


EARLY_DP = {"e_spend": 2, "e_cpm": 6}


@query(
    "tri2_early_features",
    sql("SELECT ad_id, campaign_id, ad_name, e_spend, e_imp, e_clicks, e_cpm, e_lpv, e_atc, e_ic, first_day FROM base"),
    dp=EARLY_DP,
    dates=("first_day",),
)
def tri2(spark, d):
    out = triage.early_and_late(panel(spark, d), EARLY, MIN_DAYS).where("e_spend > 0 AND l_spend > 0")
    return out.select("ad_id", "campaign_id", "ad_name", "e_spend", "e_imp", "e_clicks", "e_cpm", "e_lpv", "e_atc", "e_ic", "first_day")


@query("tri3_late_outcome", sql("SELECT ad_id, l_spend, l_ic, l_days FROM late"), dp={"l_spend": 2})
def tri3(spark, d):
    return triage.early_and_late(panel(spark, d), EARLY, MIN_DAYS).select("ad_id", "l_spend", "l_ic", "l_days")


@query("jn1_early_late_join", sql("SELECT ad_id, e_spend, l_spend FROM base"), dp={"e_spend": 2, "l_spend": 2})
def jn1(spark, d):
    out = triage.early_and_late(panel(spark, d), EARLY, MIN_DAYS)
    return out.where("e_spend > 0 AND l_spend > 0").select("ad_id", "e_spend", "l_spend")


RATE_DP = {"e_icr": 12, "e_atcr": 12, "e_lpvr": 12, "late_icr": 12}
LOG_DP = {"log_icr": 12, "log_atcr": 12, "log_lpvr": 12, "log_cpm": 9, "log_spend": 9}


@query(
    "tri4_feature_frame",
    sql("SELECT ad_id, e_icr, e_atcr, e_lpvr, late_icr, log_icr, log_atcr, log_lpvr, log_cpm, log_spend, format, is_reel FROM feat"),
    dp={**RATE_DP, **LOG_DP},
)
def tri4(spark, d):
    return frame(spark, d).select("ad_id", *RATE_DP, *LOG_DP, "format", "is_reel")


@query("prj17_log_features", sql("SELECT ad_id, log_icr, log_atcr, log_lpvr, log_cpm, log_spend FROM feat"), dp=LOG_DP)
def prj17(spark, d):
    return frame(spark, d).select("ad_id", *LOG_DP)


SPLIT = """us AS (SELECT *, epoch_us(CAST(first_day AS TIMESTAMP)) AS us FROM feat),
bound AS (SELECT CASE WHEN count(*) FILTER (us < {cut}) > 0 AND count(*) FILTER (us >= {cut}) > 0 THEN CAST({cut} AS DOUBLE)
    ELSE quantile_cont(us, 0.75) END AS b FROM us),
split AS (SELECT us.*, b, CASE WHEN us >= b THEN 1 ELSE 0 END AS is_test FROM us, bound)"""
LATE_CUT = SPLIT.format(cut="epoch_us(TIMESTAMP '2026-08-01')")
MID_CUT = SPLIT.format(cut="epoch_us(TIMESTAMP '1995-02-15')")


@query("tri5_temporal_split_fallback", sql(f"SELECT ad_id, {big('is_test')} AS is_test, CAST(b AS BIGINT) AS boundary_us FROM split", LATE_CUT))
def tri5(spark, d):
    """The default cutoff lies after all first days, so the quantile decides."""
    out = triage.temporal_split(frame(spark, d))
    return out.select("ad_id", "is_test", F.unix_micros("boundary").alias("boundary_us"))


@query("tri5_temporal_split_fixed", sql(f"SELECT ad_id, {big('is_test')} AS is_test, CAST(b AS BIGINT) AS boundary_us FROM split", MID_CUT))
def tri5_fixed(spark, d):
    out = triage.temporal_split(frame(spark, d), "1995-02-15")
    return out.select("ad_id", "is_test", F.unix_micros("boundary").alias("boundary_us"))


@query(
    "tri5_split_status",
    sql(f"SELECT {big('sum(1 - is_test)')} AS n_train, {big('sum(is_test)')} AS n_test, 'ok' AS status FROM split", LATE_CUT),
)
def tri5_status(spark, d):
    return triage.split_status(triage.temporal_split(frame(spark, d))).select("n_train", "n_test", "status")


def _rank(x, part=""):
    return f"rank() OVER ({part}ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2"


WITHIN = f"""big AS (SELECT campaign_id FROM feat GROUP BY 1 HAVING count(*) >= 3),
sub AS (SELECT feat.*, e_icr - avg(e_icr) OVER (PARTITION BY campaign_id) AS e_c, late_icr - avg(late_icr) OVER (PARTITION BY campaign_id) AS l_c
    FROM feat WHERE campaign_id IN (SELECT campaign_id FROM big)),
rk AS (SELECT campaign_id, {_rank('e_icr')} AS r1, {_rank('late_icr')} AS r2, {_rank('e_c')} AS r3, {_rank('l_c')} AS r4 FROM sub)"""


@query(
    "tri6_within_campaign_signal",
    sql(f"""SELECT {big('count(*)')} AS n_ads, {big('count(DISTINCT campaign_id)')} AS n_campaigns, corr(r1, r2) AS raw_rho,
    corr(r3, r4) AS within_rho FROM rk""", WITHIN),
    dp={"raw_rho": 6, "within_rho": 4},
)
def tri6(spark, d):
    return triage.within_group_signal(frame(spark, d)).select("n_ads", "n_campaigns", "raw_rho", "within_rho")


@query(
    "tri6_within_campaign_p",
    sql(f"""SELECT n_ads, n_campaigns, raw_rho, {rho_p('raw_rho', 'n_ads')} AS raw_p, within_rho, {rho_p('within_rho', 'n_ads')} AS within_p FROM (
    SELECT {big('count(*)')} AS n_ads, {big('count(DISTINCT campaign_id)')} AS n_campaigns, corr(r1, r2) AS raw_rho, corr(r3, r4) AS within_rho FROM rk) x""", WITHIN),
    dp={"raw_rho": 6, "within_rho": 4, "raw_p": 6, "within_p": 4},
)
def tri6_p(spark, d):
    return triage.within_group_signal(frame(spark, d))


@query(
    "top7_early_rule",
    sql("SELECT ad_id, e_icr <= (SELECT quantile_cont(e_icr, 0.25) FROM feat) AS flagged FROM feat"),
)
def top7(spark, d):
    return triage.early_rule(frame(spark, d)).select("ad_id", "flagged")


@query("tri7_label_threshold", sql("SELECT med AS threshold, CAST(sum(y) AS BIGINT) AS positives FROM lab, med GROUP BY 1"), dp={"threshold": 12})
def tri7_threshold(spark, d):
    f = frame(spark, d)
    from spendlens.operators.ordering import exact_percentiles

    middle = exact_percentiles(f, "late_icr", {"threshold": 0.5})
    positives = stats.above_median(f, "late_icr", "y").agg(F.sum("y").alias("positives"))
    return middle.crossJoin(F.broadcast(positives))


MODEL_BOOT = 2000


def _evaluation(spark, d):
    return triage.fit_and_evaluate(triage.temporal_split(frame(spark, d)), MODEL_BOOT)


def _auc(score, rows, prefix=""):
    """Area under the curve of one score over the rows, by mid-ranks."""
    return f"""(SELECT (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y))
    FROM (SELECT y, {_rank(score)} AS r FROM {rows}) {prefix}a)"""


def _interval(name, rows, key):
    """CTE ``name``: the bootstrap interval of the AUC over ``rows`` (unit, campaign_id, ad_name, s, y)."""
    body = f"{poisson_ctes(rows, key, MODEL_BOOT)},\n{WEIGHTED_AUC.format(keys='')}"
    return f"{name} AS (WITH {body.strip()} SELECT {AUC_CI} FROM areas)"


UNIT = ("unit", "campaign_id", "ad_name")
EARLY_FEATURES = triage.FEATURES
#: The model of the temporal split: the label is cut at the training median.
TEMPORAL = f"""{LATE_CUT},
tm AS (SELECT quantile_cont(late_icr, 0.5) AS threshold FROM split WHERE is_test = 0),
tl AS MATERIALIZED (SELECT split.*, threshold, CASE WHEN late_icr > threshold THEN 1 ELSE 0 END AS y FROM split, tm),
train AS MATERIALIZED (SELECT 0 AS model, y, {", ".join(EARLY_FEATURES)} FROM tl WHERE is_test = 0),
{newton_ctes("train", EARLY_FEATURES)},
ts AS MATERIALIZED (SELECT tl.*, {newton_score("tl", EARLY_FEATURES)} AS p FROM tl, nw_fit, nw_scale),
test AS MATERIALIZED (SELECT ad_id AS unit, campaign_id, ad_name, p AS s, y FROM ts WHERE is_test = 1),
{_interval("tci", "test", key_text(*UNIT))}"""
METRICS = f"""SELECT {big('count(*) FILTER (is_test = 0)')} AS n_train, {big('count(*) FILTER (is_test = 1)')} AS n_test, any_value(threshold) AS threshold,
    avg((p - y) * (p - y)) FILTER (is_test = 1) AS brier, avg(y) FILTER (is_test = 1) AS positive_rate_test,
    {_auc("p", "ts WHERE is_test = 1")} AS auc_model, {_auc("e_icr", "ts WHERE is_test = 1")} AS auc_rule, {_auc("p", "ts WHERE is_test = 0")} AS auc_train,
    (SELECT auc_low FROM tci) AS auc_low, (SELECT auc_high FROM tci) AS auc_high, 'ok' AS status FROM ts"""
METRICS_DP = {"threshold": 12, "brier": 6, "positive_rate_test": 9, "auc_model": 9, "auc_rule": 9, "auc_train": 9, "auc_low": 9, "auc_high": 9}


@query("tri7_logistic_triage", sql(METRICS, TEMPORAL).replace("WITH ", "WITH RECURSIVE ", 1), dp=METRICS_DP)
def tri7(spark, d):
    return _evaluation(spark, d).metrics


COEFFICIENTS = " UNION ALL ".join(f"SELECT '{f}' AS feature, w[{i + 1}] AS coefficient FROM nw_fit" for i, f in enumerate(EARLY_FEATURES))


@query("tri7_coefficients", sql(COEFFICIENTS, TEMPORAL).replace("WITH ", "WITH RECURSIVE ", 1), dp={"coefficient": 6})
def tri7_coefficients(spark, d):
    return _evaluation(spark, d).coefficients


CALIBRATION = """SELECT bin, CAST(count(*) AS BIGINT) AS n, avg(s) AS predicted, avg(y) AS observed FROM (
    SELECT s, y, greatest(1, CAST((s > e[1]) AS BIGINT) + CAST((s > e[2]) AS BIGINT) + coalesce(CAST((s > e[3]) AS BIGINT), 0)
        + coalesce(CAST((s > e[4]) AS BIGINT), 0) + coalesce(CAST((s > e[5]) AS BIGINT), 0)) AS bin
    FROM test, (SELECT list_distinct_sorted AS e FROM (SELECT list_sort(list_distinct(CASE least(4, greatest(2, n // 8))
        WHEN 2 THEN [lo, h, hi] WHEN 3 THEN [lo, t1, t2, hi] ELSE [lo, q1, h, q3, hi] END)) AS list_distinct_sorted FROM (
        SELECT count(s) AS n, min(s) AS lo, max(s) AS hi, quantile_cont(s, 0.5) AS h, quantile_cont(s, 1.0 / 3) AS t1, quantile_cont(s, 2.0 / 3) AS t2,
        quantile_cont(s, 0.25) AS q1, quantile_cont(s, 0.75) AS q3 FROM test) q) c) x) b GROUP BY bin"""


@query("tri7_calibration", sql(CALIBRATION, TEMPORAL).replace("WITH ", "WITH RECURSIVE ", 1), dp={"predicted": 6, "observed": 9})
def tri7_calibration(spark, d):
    return _evaluation(spark, d).calibration


@query(
    "tri8_group_folds",
    sql(f"""SELECT campaign_id, {big('CASE WHEN t < 5 THEN t ELSE 9 - t END')} AS fold, {big('n')} AS n FROM (
    SELECT campaign_id, n, (row_number() OVER (ORDER BY n DESC, campaign_id) - 1) % 10 AS t FROM (
    SELECT campaign_id, count(*) AS n FROM feat GROUP BY 1) x) y"""),
)
def tri8_folds(spark, d):
    folds = triage.group_folds(frame(spark, d), "campaign_id")
    return folds.groupBy("campaign_id").agg(F.max("fold").alias("fold"), F.count(F.lit(1)).alias("n"))


UNI = f"""units AS (SELECT ad_id AS unit, campaign_id, ad_name, e_icr AS s, y FROM lab),{poisson_ctes("units", key_text("'rule_cv'", "unit", "campaign_id", "ad_name"), MODEL_BOOT)},
{WEIGHTED_AUC.format(keys="")}, ci AS (SELECT {AUC_CI} FROM areas),
auc AS (SELECT count(*) AS n, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS auc FROM (
    SELECT y, {_rank('e_icr')} AS r FROM lab) x)"""


@query(
    "tri8_univariate_auc",
    sql(f"SELECT 'rule_cv' AS evaluation, {big('n')} AS n, auc, auc_low, auc_high, auc_low > 0.5 AS above_chance, 'ok' AS status FROM auc, ci", UNI),
    dp={"auc": 9, "auc_low": 9, "auc_high": 9},
)
def tri8_univariate(spark, d):
    labelled = stats.above_median(frame(spark, d), "late_icr", "y")
    long = labelled.select("ad_id", "campaign_id", "ad_name", "y", F.lit("rule_cv").alias("evaluation"), F.col("e_icr").alias("s"))
    return triage.evaluation_rows(long, MODEL_BOOT)


FOLDS = """gf AS (SELECT campaign_id, CASE WHEN t < k THEN t ELSE 2 * k - 1 - t END AS fold, k FROM (
    SELECT campaign_id, k, (row_number() OVER (ORDER BY n DESC, campaign_id) - 1) % (2 * k) AS t FROM (
    SELECT campaign_id, count(*) AS n, least(5, count(*) OVER ()) AS k FROM {rows} GROUP BY 1) x) y)"""
CV = f"""{FOLDS.format(rows="lab")},
cl AS MATERIALIZED (SELECT lab.*, fold, k FROM lab JOIN gf ON gf.campaign_id = lab.campaign_id),
ct AS MATERIALIZED (SELECT m.fold AS model, y, {", ".join(EARLY_FEATURES)} FROM cl JOIN (SELECT DISTINCT fold FROM gf) m ON m.fold <> cl.fold),
{newton_ctes("ct", EARLY_FEATURES)},
cs AS MATERIALIZED (SELECT cl.*, {newton_score("cl", EARLY_FEATURES)} AS oof FROM cl JOIN nw_fit ON nw_fit.model = fold JOIN nw_scale ON nw_scale.model = fold),
cvm AS MATERIALIZED (SELECT ad_id AS unit, campaign_id, ad_name, oof AS s, y FROM cs), cvr AS MATERIALIZED (SELECT ad_id AS unit, campaign_id, ad_name, e_icr AS s, y FROM cs),
{_interval("cim", "cvm", key_text("'model_cv'", *UNIT))},
{_interval("cir", "cvr", key_text("'rule_cv'", *UNIT))},
cv AS (SELECT 'model_cv' AS evaluation, count(*) AS n, {_auc("s", "cvm")} AS auc, (SELECT auc_low FROM cim) AS auc_low, (SELECT auc_high FROM cim) AS auc_high FROM cvm
    UNION ALL SELECT 'rule_cv', count(*), {_auc("s", "cvr")}, (SELECT auc_low FROM cir), (SELECT auc_high FROM cir) FROM cvr)"""
AUC_DP = {"auc": 9, "auc_low": 9, "auc_high": 9}
SHOWN = f"evaluation, {big('n')} AS n, auc, auc_low, auc_high, auc_low > 0.5 AS above_chance, 'ok' AS status, (SELECT {big('max(k)')} FROM gf) AS n_splits"


@query("tri8_grouped_cv_auc", sql(f"SELECT {SHOWN} FROM cv", CV).replace("WITH ", "WITH RECURSIVE ", 1), dp=AUC_DP)
def tri8(spark, d):
    return triage.grouped_cv_auc(frame(spark, d), n_boot=MODEL_BOOT)


BOTH = f"""SELECT c.*, (SELECT CASE WHEN r > m THEN 'rule' ELSE 'model' END FROM (
    SELECT max(auc) FILTER (evaluation = 'model_cv') AS m, max(auc) FILTER (evaluation = 'rule_cv') AS r FROM cv) v) AS winner
    FROM (SELECT {SHOWN} FROM cv UNION ALL SELECT * FROM (WITH {{temporal}} SELECT 'model_temporal', n_test, auc_model, auc_low, auc_high, auc_low > 0.5, 'ok', CAST(NULL AS BIGINT) FROM ({METRICS}) t) tt) c"""


@query("tri10_model_vs_rule", sql(BOTH.format(temporal="RECURSIVE " + TEMPORAL), CV).replace("WITH ", "WITH RECURSIVE ", 1), dp=AUC_DP)
def tri10(spark, d):
    """Cross-validated model and rule next to the temporal test, with the winner."""
    f = frame(spark, d)
    cv = triage.grouped_cv_auc(f, n_boot=MODEL_BOOT)
    test = triage.fit_and_evaluate(triage.temporal_split(f), MODEL_BOOT).metrics
    temporal = test.select(
        F.lit("model_temporal").alias("evaluation"),
        F.col("n_test").alias("n"),
        F.col("auc_model").alias("auc"),
        "auc_low",
        "auc_high",
        (F.col("auc_low") > 0.5).alias("above_chance"),
        "status",
    )
    rows = cv.unionByName(temporal, allowMissingColumns=True)
    return rows.crossJoin(F.broadcast(triage.verdict(rows).select("winner")))


CURVE = """ranked AS (SELECT ad_id, l_spend, l_ic, row_number() OVER (ORDER BY e_icr, ad_id, campaign_id, ad_name) AS r, count(*) OVER () AS n FROM feat),
cuts AS (SELECT q, CAST(round_even((SELECT count(*) FROM feat) * q, 0) AS BIGINT) AS k FROM (VALUES (CAST(0.0 AS DOUBLE)), (0.1), (0.2), (0.25), (0.33), (0.4), (0.5)) v(q)),
sums AS (SELECT q, k, coalesce(sum(CASE WHEN r <= k THEN l_spend END), 0) AS freed, coalesce(sum(CASE WHEN r <= k THEN l_ic END), 0) AS lost,
    sum(CASE WHEN r > k THEN l_spend END) AS ks, sum(CASE WHEN r > k THEN l_ic END) AS ki, sum(l_ic) AS base FROM ranked, cuts GROUP BY 1, 2)"""
CURVE_SQL = f"""SELECT q AS cut_fraction, k AS ads_cut, freed AS spend_freed, CAST(lost AS DOUBLE) AS conv_lost,
    ki * power((ks + freed) / ks, 0.8) AS projected_conv, (ki * power((ks + freed) / ks, 0.8) / base - 1) * 100 AS gain_pct FROM sums"""
CURVE_DP = {"spend_freed": 2, "projected_conv": 6, "gain_pct": 6}


@query("tri9_decision_curve", sql(CURVE_SQL, CURVE), dp=CURVE_DP)
def tri9(spark, d):
    return triage.decision_curve(frame(spark, d), "e_icr")


@query("win10_cumulative_cut", sql("SELECT q AS cut_fraction, k AS ads_cut, freed AS spend_freed FROM sums", CURVE), dp={"spend_freed": 2})
def win10(spark, d):
    return triage.decision_curve(frame(spark, d), "e_icr").select("cut_fraction", "ads_cut", "spend_freed")


MODEL_CURVE = TEMPORAL + ", tfeat AS (SELECT * FROM ts WHERE is_test = 1), " + CURVE.replace("FROM feat", "FROM tfeat").replace("ORDER BY e_icr", "ORDER BY p")


@query("tri9_model_decision_curve", sql(CURVE_SQL, MODEL_CURVE).replace("WITH ", "WITH RECURSIVE ", 1), dp=CURVE_DP)
def tri9_model(spark, d):
    return triage.decision_curve(_evaluation(spark, d).scored.where("is_test = 1"), "p")

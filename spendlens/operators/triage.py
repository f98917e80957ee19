"""Early triage of ads: features of the first active days against what follows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.scalars import creative_format, or_zero, ratio
from spendlens.operators import bootstrap, newton, stats
from spendlens.operators.newton import LogisticFit
from spendlens.operators.ordering import exact_percentiles, with_row_position, with_running_sums
from spendlens.operators.sharing import settled, shared

# Model inputs and the cut fractions of the decision curve.
FEATURES = ("log_icr", "log_atcr", "log_lpvr", "log_cpm", "log_spend", "is_reel")
CUT_FRACTIONS = (0.0, 0.1, 0.2, 0.25, 0.33, 0.4, 0.5)
DEFAULT_CUTOFF = "2026-08-01"
MIN_TRAIN, MIN_TEST = 40, 15


def daily_panel(ads_daily: DataFrame) -> DataFrame:
    """Delivered ad-days with their active-day number and the ad's lifetime.

    ``ads_daily`` has one row per ad and day, so a window holds at most as many
    rows as there are days.
    """
    delivered = ads_daily.where("spend > 0 AND impressions > 0")
    by_day = Window.partitionBy("ad_id").orderBy("date")
    whole = Window.partitionBy("ad_id")
    return delivered.withColumns(
        {
            "lpv": or_zero("landing_page_view"),
            "atc": or_zero("add_to_cart"),
            "ic": or_zero("initiate_checkout"),
            "day_n": F.row_number().over(by_day),
            "lifetime": F.count(F.lit(1)).over(whole),
        }
    )


def early_and_late(panel: DataFrame, early_days: int = 2, min_days: int = 5) -> DataFrame:
    """One row per (ad, campaign, name) seen early, joined to the ad's late outcome.

    Both windows come from one pass: late sums per name are summed again per ad,
    which keeps the rule that a renamed ad yields two early rows.
    """
    keys = ["ad_id", "campaign_id", "ad_name"]
    early, late = F.col("day_n") <= early_days, F.col("day_n") > early_days

    def when(side, column):
        return F.when(side, F.col(column))

    parts = (
        panel.where(F.col("lifetime") >= min_days)
        .groupBy(*keys)
        .agg(
            F.sum(when(early, "spend")).alias("e_spend"),
            F.sum(when(early, "impressions")).alias("e_imp"),
            F.sum(when(early, "clicks")).alias("e_clicks"),
            F.avg(when(early, "cpm")).alias("e_cpm"),
            F.sum(when(early, "lpv")).alias("e_lpv"),
            F.sum(when(early, "atc")).alias("e_atc"),
            F.sum(when(early, "ic")).alias("e_ic"),
            F.min(when(early, "date")).alias("first_day"),
            F.count(F.when(early, 1)).alias("__early"),
            F.sum(when(late, "spend")).alias("__ls"),
            F.sum(when(late, "ic")).alias("__li"),
            F.count(F.when(late, 1)).alias("__ld"),
        )
    )
    per_ad = Window.partitionBy("ad_id")
    joined = parts.withColumns(
        {
            "l_spend": F.sum("__ls").over(per_ad),
            "l_ic": F.sum("__li").over(per_ad),
            "l_days": F.sum("__ld").over(per_ad),
        }
    )
    present = F.col("__early") > 0
    for k in keys:
        present = present & F.col(k).isNotNull()
    return joined.where(present & (F.col("l_days") > 0)).drop("__early", "__ls", "__li", "__ld")


def feature_frame(ads_daily: DataFrame, early_days: int = 2, min_days: int = 5) -> DataFrame:
    """The triage dataset: rates, late efficiency and log features per ad."""
    base = early_and_late(daily_panel(ads_daily), early_days, min_days)
    base = settled(base.where("e_spend > 0 AND l_spend > 0"), "triage")
    base = base.withColumns(
        {
            "e_icr": ratio("e_ic", "e_spend"),
            "e_atcr": ratio("e_atc", "e_spend"),
            "e_lpvr": ratio("e_lpv", "e_spend"),
            "late_icr": ratio("l_ic", "l_spend"),
            "format": creative_format("ad_name"),
        }
    )
    middle = exact_percentiles(base, "e_cpm", {"__cpm": 0.5})
    out = base.crossJoin(F.broadcast(middle)).withColumns(
        {
            "log_icr": F.log1p("e_icr"),
            "log_atcr": F.log1p("e_atcr"),
            "log_lpvr": F.log1p("e_lpvr"),
            "log_cpm": F.log1p(F.coalesce("e_cpm", "__cpm")),
            "log_spend": F.log1p("e_spend"),
            "is_reel": (F.col("format") == "reel").cast("int"),
        }
    )
    return out.drop("__cpm")


def temporal_split(
    df: DataFrame, cutoff: str | None = DEFAULT_CUTOFF, test_fraction: float = 0.25
) -> DataFrame:
    """Append ``boundary`` and ``is_test`` (first day on or after the boundary).

    A cutoff that leaves one side empty is replaced by the quantile of the
    first days, decided inside the plan from one aggregated row.
    """
    day = F.unix_micros(F.col("first_day").cast("timestamp"))
    stamped = df.withColumn("__us", day)
    fixed = F.lit(cutoff).cast("timestamp") if cutoff else F.lit(None).cast("timestamp")
    sides = stamped.agg(
        F.count(F.when(F.col("__us") < F.unix_micros(fixed), 1)).alias("__before"),
        F.count(F.when(F.col("__us") >= F.unix_micros(fixed), 1)).alias("__after"),
    )
    fallback = exact_percentiles(stamped, "__us", {"__q": 1.0 - test_fraction})
    chosen = sides.crossJoin(F.broadcast(fallback)).select(
        F.when(
            (F.col("__before") > 0) & (F.col("__after") > 0), F.unix_micros(fixed).cast("double")
        )
        .otherwise(F.col("__q"))
        .alias("__b")
    )
    return (
        stamped.crossJoin(F.broadcast(chosen))
        .withColumns(
            {
                "boundary": F.timestamp_micros(F.col("__b").cast("bigint")),
                "is_test": (F.col("__us") >= F.col("__b")).cast("int"),
            }
        )
        .drop("__us", "__b")
    )


def split_status(split: DataFrame) -> DataFrame:
    """Sizes of both sides and whether a model may be fitted on them."""
    n_test = F.coalesce(F.sum("is_test"), F.lit(0))
    n_train = F.count(F.lit(1)) - n_test
    return split.agg(
        n_train.alias("n_train"),
        n_test.alias("n_test"),
        F.max("boundary").alias("boundary"),
        F.when((n_train < MIN_TRAIN) | (n_test < MIN_TEST), "too small").otherwise("ok").alias("status"),
    )


def within_group_signal(
    df: DataFrame, group: str = "campaign_id", min_ads: int = 3, min_rows: int = 10
) -> DataFrame:
    """Rank correlation of early and late efficiency, raw and centred within groups.

    One row; below ``min_rows`` only the counts are filled.
    """
    sub = settled(
        stats.centred(df, group, {"e_c": "e_icr", "l_c": "late_icr"}, min_size=min_ads), "centred"
    )
    sizes = sub.agg(
        F.count(F.lit(1)).alias("n_ads"), F.countDistinct(group).alias("n_campaigns")
    )
    long = sub.select(
        F.inline(
            F.array(
                F.struct(F.lit("raw").alias("scope"), F.col("e_icr").alias("x"), F.col("late_icr").alias("y")),
                F.struct(F.lit("within").alias("scope"), F.col("e_c").alias("x"), F.col("l_c").alias("y")),
            )
        )
    )
    rho = stats.spearman(long, "x", "y", ["scope"])

    def pick(scope, column):
        return F.max(F.when((F.col("scope") == scope) & (F.col("n") >= min_rows), F.col(column)))

    wide = rho.agg(
        pick("raw", "rho").alias("raw_rho"),
        pick("raw", "p_value").alias("raw_p"),
        pick("within", "rho").alias("within_rho"),
        pick("within", "p_value").alias("within_p"),
    )
    return sizes.crossJoin(F.broadcast(wide))


def early_rule(df: DataFrame, quantile: float = 0.25) -> DataFrame:
    """The shipped rule: flag ads in the bottom quartile of early checkouts per dollar."""
    edge = exact_percentiles(df, "e_icr", {"__edge": quantile})
    return (
        df.crossJoin(F.broadcast(edge))
        .withColumn("flagged", F.col("e_icr") <= F.col("__edge"))
        .drop("__edge")
    )


# --- model --------------------------------------------------------------------


def fit_logistic(train: DataFrame, features, label: str, c: float = 0.5) -> LogisticFit:
    """L2 logistic regression on standardised columns by Newton steps; the intercept is not penalised."""
    return newton.fit_one(train, features, label, c)


@dataclass
class TriageEvaluation:
    fit: LogisticFit | None
    scored: DataFrame
    metrics: DataFrame
    calibration: DataFrame
    coefficients: DataFrame


def _not_fitted(split: DataFrame, status: str, features) -> TriageEvaluation:
    """The evaluation of a split that is too small: sizes and status, all else null or empty."""
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    scored = split.select("*", *none("double", "threshold"), *none("int", "y"), *none("double", "p"))
    sizes = split_status(split).select(
        "n_train", "n_test", *none("double", "threshold", "brier", "positive_rate_test", "auc_model", "auc_rule", "auc_train", "auc_low", "auc_high"),
        F.lit(status).alias("status"),
    )
    spark = split.sparkSession
    calibration = spark.createDataFrame([], "bin int, n bigint, predicted double, observed double")
    coefficients = spark.createDataFrame([(f, None) for f in features], "feature string, coefficient double")
    return TriageEvaluation(None, scored, sizes, calibration, coefficients)


def fit_and_evaluate(split: DataFrame, n_boot: int = 2000, features=FEATURES) -> TriageEvaluation:
    """Train before the boundary, judge after it.

    The label threshold is the training median, applied unchanged to the test ads.
    When a side is too small nothing is fitted: ``fit`` is None, the metrics row
    says so in ``status``, scores and coefficients are null.
    """
    spark = split.sparkSession
    split = settled(split, "split")
    status = split_status(split).first()["status"]
    if status != "ok":
        return _not_fitted(split, status, features)
    middle = exact_percentiles(split.where("is_test = 0"), "late_icr", {"threshold": 0.5})
    labelled = settled(
        split.crossJoin(F.broadcast(middle)).withColumn(
            "y", (F.col("late_icr") > F.col("threshold")).cast("int")
        ),
        "labelled",
    )
    fit = fit_logistic(labelled.where("is_test = 0"), features, "y")
    scored = labelled.withColumn("p", fit.score())
    test = scored.where("is_test = 1")
    areas = stats.exact_auc(
        scored.select(
            "y",
            F.inline(
                F.array(
                    F.struct(
                        F.when(F.col("is_test") == 1, "model").otherwise("train").alias("what"),
                        F.col("p").alias("s"),
                    ),
                    F.struct(
                        F.when(F.col("is_test") == 1, "rule").alias("what"), F.col("e_icr").alias("s")
                    ),
                )
            ),
        ).where("what IS NOT NULL"),
        "s",
        "y",
        ["what"],
    )
    wide = areas.agg(
        *[
            F.max(F.when(F.col("what") == w, F.col("auc"))).alias(f"auc_{w}")
            for w in ("model", "rule", "train")
        ]
    )
    sizes = scored.agg(
        F.sum(1 - F.col("is_test")).alias("n_train"),
        F.sum("is_test").alias("n_test"),
        F.max("threshold").alias("threshold"),
        F.avg(F.when(F.col("is_test") == 1, (F.col("p") - F.col("y")) ** 2)).alias("brier"),
        F.avg(F.when(F.col("is_test") == 1, F.col("y"))).alias("positive_rate_test"),
    )
    ids = [c for c in ("ad_id", "campaign_id", "ad_name") if c in test.columns]
    ci = bootstrap.auc_interval(test, ids, "p", "y", n_boot)
    metrics = sizes.crossJoin(F.broadcast(wide)).crossJoin(
        F.broadcast(ci.select("auc_low", "auc_high"))
    ).withColumn("status", F.lit("ok"))
    return TriageEvaluation(
        fit, scored, metrics, stats.calibration(test, "p", "y"), fit.coefficients(spark)
    )


def group_folds(df: DataFrame, group: str, n_splits: int = 5) -> DataFrame:
    """Append ``fold``: whole groups dealt by size, back and forth over the folds."""
    sizes = df.groupBy(group).agg((-F.count(F.lit(1))).alias("__neg"))
    placed = shared(with_row_position(sizes, ["__neg", group], "__pos"))
    k = F.least(F.lit(n_splits), F.col("__groups"))
    total = placed.agg(F.count(F.lit(1)).alias("__groups"))
    turn = F.pmod(F.col("__pos"), 2 * k)
    fold = F.when(turn < k, turn).otherwise(2 * k - 1 - turn)
    dealt = placed.crossJoin(F.broadcast(total)).select(group, fold.cast("int").alias("fold"))
    return df.join(dealt, group)


def usable_folds(folded: DataFrame, label: str) -> list[int]:
    """Folds whose training side holds both classes (one summary row per fold)."""
    rows = folded.groupBy("fold").agg(
        F.sum(label).alias("pos"), F.count(F.lit(1)).alias("n")
    ).collect()
    pos, n = sum(r["pos"] for r in rows), sum(r["n"] for r in rows)
    return sorted(
        r["fold"] for r in rows if 0 < pos - r["pos"] < n - r["n"]
    )


def out_of_fold(
    df: DataFrame, features, label: str, group: str, n_splits: int = 5, impute: bool = False
) -> DataFrame:
    """Scores from models that never saw the row's group; one-class folds are skipped.

    All folds' models are fitted in the same passes. ``impute`` fills missing features
    with the medians of the rows a model learns from. Adds ``fold`` and ``oof``.
    """
    folded = settled(group_folds(df, group, n_splits), "folds")
    models = newton.fit_models(folded, features, label, usable_folds(folded, label), "fold", impute=impute)
    score = F.lit(None).cast("double")
    for fold, model in models.items():
        score = F.when(F.col("fold") == fold, model.score()).otherwise(score)
    return folded.withColumn("oof", score)


def fold_count(folded: DataFrame) -> int:
    """How many folds there are: ``n_splits``, or the number of groups if there are fewer."""
    return (folded.agg(F.max("fold").alias("last")).first()["last"] or 0) + 1


def grouped_cv_auc(
    df: DataFrame, n_splits: int = 5, n_boot: int = 2000, group: str = "campaign_id"
) -> DataFrame:
    """Model and single-rule AUC on out-of-fold scores, one row per evaluation, with the number of folds."""
    labelled = stats.above_median(df, "late_icr", "y")
    folded = settled(out_of_fold(labelled, FEATURES, "y", group, n_splits), "scored")
    scored = folded.where("oof IS NOT NULL")
    long = scored.select(
        *[c for c in ("ad_id", "campaign_id", "ad_name") if c in scored.columns],
        "y",
        F.inline(
            F.array(
                F.struct(F.lit("model_cv").alias("evaluation"), F.col("oof").alias("s")),
                F.struct(F.lit("rule_cv").alias("evaluation"), F.col("e_icr").alias("s")),
            )
        ),
    )
    return evaluation_rows(long, n_boot).withColumn("n_splits", F.lit(fold_count(folded)))


def evaluation_rows(long: DataFrame, n_boot: int, min_rows: int = 20, row_id=("ad_id", "campaign_id", "ad_name")) -> DataFrame:
    """(evaluation, s, y, row id) to AUC with interval, an above-chance flag and a status.

    Under ``min_rows`` the row stays, without AUC, with status "too few rows".
    """
    long = settled(long, "evaluated")
    areas = stats.exact_auc(long, "s", "y", ["evaluation"])
    ids = [c for c in row_id if c in long.columns]
    ci = bootstrap.auc_interval(long, ids, "s", "y", n_boot, keys=["evaluation"])
    n = (F.col("n_pos") + F.col("n_neg")).alias("n")
    enough = F.col("n_pos") + F.col("n_neg") >= min_rows
    shown = lambda c: F.when(enough, F.col(c)).alias(c)
    return areas.join(ci, "evaluation").select(
        "evaluation", n, shown("auc"), shown("auc_low"), shown("auc_high"),
        F.when(enough, F.col("auc_low") > 0.5).alias("above_chance"),
        F.when(enough, "ok").otherwise("too few rows").alias("status"),
    )


def verdict(rows: DataFrame, model: str = "model_cv", rule: str = "rule_cv") -> DataFrame:
    """Which of the two wins in cross-validation; null when either has no AUC."""

    def area(name):
        return F.max(F.when(F.col("evaluation") == name, F.col("auc")))

    return rows.agg(area(model).alias("auc_model"), area(rule).alias("auc_rule")).withColumn(
        "winner", F.when(F.col("auc_rule") > F.col("auc_model"), "rule").when(F.col("auc_rule") <= F.col("auc_model"), "model")
    )


def decision_curve(
    scored: DataFrame,
    score: str = "p",
    ties=("ad_id", "campaign_id", "ad_name"),
    saturation: float = 0.8,
    fractions=CUT_FRACTIONS,
) -> DataFrame:
    """Gain from cutting the lowest-scored share of ads, for every cut fraction.

    The order is total (score, then those of ``ties`` that there are, unique per row); its running sums are read at the k-th
    row of each fraction, so no task sees the whole ranking.
    """
    ties = [t for t in ties if t in scored.columns]
    base = shared(
        scored.select(
            F.col(score).alias("__s"),
            *ties,
            F.col("l_spend").cast("double").alias("__spend"),
            F.col("l_ic").cast("double").alias("__ic"),
            F.lit(1).cast("bigint").alias("__n"),
        )
    )
    totals = base.agg(
        F.sum("__n").alias("n"), F.sum("__spend").alias("spend"), F.sum("__ic").alias("ic")
    )
    grid = F.explode(F.array(*[F.lit(float(q)) for q in fractions])).alias("cut_fraction")
    cuts = totals.select("n", "spend", "ic", grid).withColumn(
        "k", F.bround(F.col("n") * F.col("cut_fraction")).cast("bigint")
    )
    run = with_running_sums(
        base, ["__s", *ties], {"at": "__n", "spend_at": "__spend", "ic_at": "__ic"}
    ).select("at", "spend_at", "ic_at")
    last = totals.select(
        F.col("n").alias("at"), F.col("spend").alias("spend_at"), F.col("ic").alias("ic_at")
    )
    steps = run.unionByName(last)
    found = F.broadcast(cuts).join(steps, F.col("k") == F.col("at"))
    keep_spend = F.col("spend") - F.col("spend_at")
    keep_ic = F.col("ic") - F.col("ic_at")
    projected = keep_ic * F.pow(F.col("spend") / F.nullif(keep_spend, F.lit(0.0)), F.lit(saturation))
    return (
        found.where((F.col("k") < F.col("n")) & (keep_spend > 0))
        .select(
            "cut_fraction",
            F.col("k").alias("ads_cut"),
            F.col("spend_at").alias("spend_freed"),
            F.col("ic_at").alias("conv_lost"),
            projected.alias("projected_conv"),
            F.when(F.col("ic") != 0, (projected / F.nullif(F.col("ic"), F.lit(0.0)) - 1) * 100).alias(
                "gain_pct"
            ),
        )
        .orderBy("cut_fraction")
    )

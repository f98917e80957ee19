"""What an ad is against how it performs: dataset, associations, models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.images import IMAGE_FEATURES
from spendlens.functions.scalars import name_has, or_zero, ratio, type_is, yes_or_blank
from spendlens.functions.text import TEXT_FEATURES, with_text_features
from spendlens.operators import boosting, stats
from spendlens.operators.sharing import settled
from spendlens.operators.triage import (
    evaluation_rows,
    fold_count,
    group_folds,
    out_of_fold,
    usable_folds,
)

META_FEATURES = ("is_video", "is_reel")
ALL_FEATURES = (*TEXT_FEATURES, *IMAGE_FEATURES, *META_FEATURES)
MIN_ADS = 40

# Features shown in the published table, with their labels.
PUBLISHED_FEATURES = {
    "is_video": "Vidéo",
    "aspect_ratio": "Format vertical",
    "is_reel": "Reel",
    "contrast": "Contraste",
    "colorfulness": "Colorfulness",
    "saturation": "Saturation",
    "has_date": "Mention de date",
    "n_emoji": "Nombre d'emojis",
    "n_question": "Question",
    "caps_ratio": "Proportion de majuscules",
}


def lifetime_performance(ads_daily: DataFrame, min_spend: float = 20.0) -> DataFrame:
    """Delivered totals per ad above the spend floor, with both targets."""
    perf = (
        ads_daily.where("spend > 0")
        .groupBy("ad_id")
        .agg(
            F.min("campaign_id").alias("campaign_id"),
            F.min("ad_name").alias("ad_name"),
            F.sum("spend").alias("spend"),
            F.sum("impressions").alias("impressions"),
            F.sum("clicks").alias("clicks"),
            F.sum("initiate_checkout").alias("checkouts"),
        )
        .where(F.col("spend") >= min_spend)
    )
    return perf.withColumns(
        {
            "ctr": ratio("clicks", "impressions") * 100,
            "icr": ratio(or_zero("checkouts"), "spend"),
        }
    )


def with_creative(perf: DataFrame, creatives: DataFrame) -> DataFrame:
    """Inner join on the ad with only the columns the features need."""
    return perf.join(creatives.select("ad_id", "body", "object_type", "cta"), "ad_id")


def with_format_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"is_video": type_is("object_type", "VIDEO"), "is_reel": name_has("ad_name", "reel")}
    )


def dataset(
    ads_daily: DataFrame,
    creatives: DataFrame,
    images: DataFrame | None = None,
    min_spend: float = 20.0,
) -> DataFrame:
    """One row per ad: performance, copy features, image features, format flags.

    ``images`` is an image-feature table keyed by ad_id; ads without a picture
    (or all ads, when it is absent) get nulls there. The body is dropped once
    its features exist, so later shuffles do not carry the text.
    """
    base = with_format_flags(with_creative(lifetime_performance(ads_daily, min_spend), creatives))
    base = with_text_features(base, "body").drop("body")
    if images is None:
        full = base.withColumns({f: F.lit(None).cast("double") for f in IMAGE_FEATURES})
    else:
        full = base.join(images.select("ad_id", *IMAGE_FEATURES), "ad_id", "left")
    return settled(full, "creative")


def dataset_status(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(n.alias("n_ads"), F.when(n < MIN_ADS, "too small").otherwise("ok").alias("status"))


def delivered_creatives(creatives: DataFrame, ads_daily: DataFrame) -> DataFrame:
    """Creatives of ads that delivered at least once."""
    delivered = ads_daily.where("spend > 0").select("ad_id").distinct()
    return creatives.join(delivered, "ad_id", "left_semi")


def long_features(df: DataFrame, target: str, features) -> DataFrame:
    """(campaign_id, feature, x, y) with rows where both are known."""
    stack = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]
    )
    flat = df.select("campaign_id", F.col(target).cast("double").alias("y"), F.explode(stack).alias("s"))
    return flat.select("campaign_id", "s.feature", "s.x", "y")


def associations(df: DataFrame, target: str, features=ALL_FEATURES, min_rows: int = 20) -> DataFrame:
    """Rank correlation of each feature with the target, raw and within campaigns.

    All features and both scopes run as one job keyed by (scope, feature).
    Campaign means come from the rows of campaigns with two ads or more; each
    mean ignores the missing values of its own column. Two BH families.
    """
    long = long_features(df, target, features)
    sizes = (
        df.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("__size")).where("__size >= 2")
    )
    means = (
        long.groupBy("campaign_id", "feature")
        .agg(F.avg("x").alias("__mx"), F.avg("y").alias("__my"))
        .join(sizes, "campaign_id", "left_semi")
    )
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    raw = long.where(known).select(F.lit("raw").alias("scope"), "feature", "x", "y")
    within = (
        long.where(known)
        .join(means, ["campaign_id", "feature"])
        .select(
            F.lit("within").alias("scope"),
            "feature",
            (F.col("x") - F.col("__mx")).alias("x"),
            (F.col("y") - F.col("__my")).alias("y"),
        )
    )
    both = settled(raw.unionByName(within), "pairs")
    usable = (
        both.groupBy("scope", "feature")
        .agg(F.count(F.lit(1)).alias("__n"), F.stddev_pop("x").alias("__sd"))
        .where((F.col("__n") >= min_rows) & (F.col("__sd") > 0))
    )
    rho = stats.spearman(both, "x", "y", ["scope", "feature"]).join(
        F.broadcast(usable.select("scope", "feature")), ["scope", "feature"]
    )
    rho = settled(rho, "rho")  # one row per scope and feature
    outer = rho.where("scope = 'raw'").select("feature", "n", "rho", "p_value")
    inner = rho.where("scope = 'within'").select(
        "feature", F.col("rho").alias("rho_within"), F.col("p_value").alias("p_within")
    )
    # one row per feature from here on
    out = outer.join(inner, "feature", "left")
    out = stats.step_up(out, "p_value", "q_value")
    out = stats.step_up(out, "p_within", "q_within")
    out = out.withColumns(
        {
            "significant": F.coalesce(F.col("q_value") < 0.05, F.lit(False)),
            "holds_within": F.coalesce(
                (F.col("q_within") < 0.05) & (F.signum("rho_within") == F.signum("rho")), F.lit(False)
            ),
        }
    )
    return out.select(
        "feature", "n", "rho", "p_value", "rho_within", "p_within", "q_value", "significant",
        "q_within", "holds_within",
    )


def strongest(assoc: DataFrame, n: int = 10) -> DataFrame:
    return assoc.orderBy(F.desc(F.abs("rho")), "feature").limit(n)


def association_counts(assoc: DataFrame) -> DataFrame:
    return assoc.agg(
        F.count(F.lit(1)).alias("n_features"),
        F.count(F.when(F.col("significant"), 1)).alias("n_significant"),
        F.count(F.when(F.col("holds_within"), 1)).alias("n_holding_within"),
    )


def both_targets(ctr: DataFrame, icr: DataFrame) -> DataFrame:
    """Within-campaign effect of each feature on attention and on conversion."""
    left = ctr.select(
        "feature", F.col("rho_within").alias("ctr_effect"), F.col("holds_within").alias("ctr_robust")
    )
    right = icr.select(
        "feature", F.col("rho_within").alias("icr_effect"), F.col("holds_within").alias("icr_robust")
    )
    return left.join(right, "feature")


def robust_on_either(ctr: DataFrame, icr: DataFrame) -> DataFrame:
    both = both_targets(ctr, icr)
    return both.where(F.col("ctr_robust") | F.col("icr_robust")).orderBy("ctr_effect", "feature")


def inversion_table(ctr: DataFrame, icr: DataFrame, labels=PUBLISHED_FEATURES) -> DataFrame:
    """The published attention-against-conversion table."""
    names = F.create_map(*[F.lit(v) for kv in labels.items() for v in kv])
    both = both_targets(ctr, icr).where(F.col("feature").isin(*labels))
    return both.select(
        names[F.col("feature")].alias("Caractéristique"),
        F.round("ctr_effect", 3).alias("Effet sur le CTR"),
        F.round("icr_effect", 3).alias("Effet sur la conversion"),
        yes_or_blank("ctr_robust").alias("Robuste (CTR)"),
        yes_or_blank("icr_robust").alias("Robuste (conv.)"),
    ).orderBy(F.desc("Effet sur le CTR"), "Caractéristique")


def best_and_worst(df: DataFrame, target: str, n: int = 5) -> DataFrame:
    """Top and bottom n ads by a target, each by a bounded top-k."""
    columns = df.select("ad_id", "ad_name", target)
    best = columns.orderBy(F.desc(target), "ad_id").limit(n).withColumn("part", F.lit("best"))
    worst = columns.orderBy(F.asc(target), "ad_id").limit(n).withColumn("part", F.lit("worst"))
    return best.unionByName(worst)


# --- models -------------------------------------------------------------------


def usable_features(df: DataFrame, features, min_known: float = 0.8) -> list[str]:
    """Features known for more than the given share of ads (one summary row)."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count(f).alias(f) for f in features]
    ).first()
    return [f for f in features if row[f] > row["n"] * min_known]


def logistic_cv(df: DataFrame, target: str, n_splits: int = 5, n_boot: int = 2000, features=ALL_FEATURES):
    """Grouped cross-validated AUC of a logistic model for an above-median target."""
    base = stats.above_median(df, target, "y")
    chosen = usable_features(df, features)
    scored = settled(out_of_fold(base, chosen, "y", "campaign_id", n_splits, impute=True), "scored")
    long = scored.where("oof IS NOT NULL").select(
        "ad_id", "y", F.lit("logistic").alias("evaluation"), F.col("oof").alias("s")
    )
    return _with_sizes(evaluation_rows(long, n_boot), len(chosen), fold_count(scored))


def _with_sizes(rows: DataFrame, n_features: int, n_splits: int) -> DataFrame:
    return rows.withColumns({"n_features": F.lit(n_features), "n_splits": F.lit(n_splits)})


def boosted_cv(df: DataFrame, target: str, n_splits: int = 5, n_boot: int = 2000, features=ALL_FEATURES, trees: int = boosting.TREES) -> DataFrame:
    """The same protocol with histogram-boosted trees (depth 3, rate 0.06, leaves of 15)."""
    folded = settled(group_folds(stats.above_median(df, target, "y"), "campaign_id", n_splits), "folds")
    chosen = usable_features(folded, features)
    fits = boosting.fit_boosted(folded, chosen, "y", usable_folds(folded, "y"), "fold", trees)
    if fits:
        oof = boosting.scored(folded, fits, "fold", ["ad_id", "y"], "s")
    else:
        oof = folded.select("ad_id", "y", F.lit(None).cast("double").alias("s"))
    long = oof.where("s IS NOT NULL").withColumn("evaluation", F.lit("gradient_boosting"))
    return _with_sizes(evaluation_rows(long, n_boot), len(chosen), fold_count(folded))


def boosted_tree(df: DataFrame, target: str, features=ALL_FEATURES) -> DataFrame:
    """The first tree of a boosted model of all ads, node by node."""
    base = stats.above_median(df, target, "y")
    fit = boosting.fit_boosted(base, usable_features(base, features), "y", [0], trees=1)[0]
    return fit.nodes(df.sparkSession)

"""Ranking of delivery segments on conversion rate, with inference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.scalars import ratio, segment_label
from spendlens.operators import bootstrap, stats
from spendlens.operators.sharing import discard, settled
from spendlens.schema import HOUR_RANGE

DEFAULT_OUTCOME = "initiate_checkout"
OUTCOME_CHOICES = ("link_click", "landing_page_view", "add_to_cart", "initiate_checkout", "purchase")


@dataclass(frozen=True)
class SegmentSpec:
    """Which view and columns define a family of segments."""

    name: str
    view: str
    dims: tuple[str, ...]
    cluster: str = "ad_id"
    outcome: str | None = None
    may_reallocate: bool = True


FAMILIES = {
    s.name: s
    for s in (
        SegmentSpec("age_gender", "ads_by_age_gender", ("age", "gender")),
        SegmentSpec("placement", "ads_by_placement", ("publisher_platform", "platform_position")),
        SegmentSpec("device", "ads_by_placement", ("impression_device",)),
        SegmentSpec(
            "region", "ads_by_region", ("region",), outcome="link_click", may_reallocate=False
        ),
        SegmentSpec("hourly", "campaigns_by_hour", (HOUR_RANGE,), cluster="campaign_id"),
    )
}


@dataclass
class SegmentRanking:
    """Lazy results: tested segments, segments under a floor, one summary row."""

    scored: DataFrame
    excluded: DataFrame
    summary: DataFrame
    mode: str


def segment_totals(rows: DataFrame, dims) -> DataFrame:
    """Per-segment sums with shares against the whole; null values form a group."""
    grouped = rows.groupBy(*dims).agg(
        F.sum("spend").alias("spend"),
        F.sum("conversions").alias("conversions"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    return with_expectation(grouped)


def with_expectation(grouped: DataFrame) -> DataFrame:
    """Append totals over all segments and the outcome expected at the global rate."""
    totals = grouped.agg(
        F.coalesce(F.sum("spend"), F.lit(0.0)).alias("total_spend"),
        F.coalesce(F.sum("conversions"), F.lit(0.0)).alias("total_conversions"),
    )
    rate = F.col("total_conversions") / F.nullif(F.col("total_spend"), F.lit(0.0))
    return grouped.crossJoin(F.broadcast(totals)).withColumn("expected", F.col("spend") * rate)


def leave_one_out_rate():
    """Rate of everything but the segment itself; null when nothing else was spent."""
    rest = F.col("total_spend") - F.col("spend")
    return F.when(
        rest > 0,
        (F.col("total_conversions") - F.col("conversions")) / F.nullif(rest, F.lit(0.0)),
    )


def rank_segments(
    df: DataFrame,
    dims,
    *,
    cluster: str = "ad_id",
    outcome: str = DEFAULT_OUTCOME,
    exposure: str = "spend",
    min_expected: float = 5.0,
    min_spend_share: float = 0.002,
    fdr_alpha: float = 0.05,
    n_boot: int = 2000,
    seed: int = 0,
    mode: str = "poisson",
    null_safe: bool = False,
) -> SegmentRanking:
    """Score every segment of ``dims`` against the whole.

    A null dimension value forms a segment but, unless ``null_safe``, matches no
    rows at inference: no interval, zero clusters, p = 1.
    """
    dims = list(dims)
    rows = df.where(F.col(exposure) > 0).select(
        *dims,
        F.col(cluster).alias("cluster_id"),
        F.col(exposure).cast("double").alias("spend"),
        F.coalesce(F.col(outcome).cast("double"), F.lit(0.0)).alias("conversions"),
    )
    units = settled(
        bootstrap.cluster_units(rows, dims, "cluster_id", "conversions", "spend"), "units"
    )
    every = settled(
        with_expectation(
            units.groupBy(*dims).agg(
                F.sum("S").alias("spend"),
                F.sum("C").alias("conversions"),
                F.sum("n_rows").alias("n_rows"),
                F.count(F.lit(1)).alias("__clusters"),
            )
        ),
        "segments",
    )
    # without any outcome nothing is ranked, but the account's totals stand
    grouped = every.where("total_spend > 0 AND total_conversions > 0")
    keep = (F.col("expected") >= min_expected) & (
        F.col("spend") >= F.lit(min_spend_share) * F.col("total_spend")
    )
    excluded = grouped.where(~keep).select(*dims, "spend", "conversions", "n_rows", "expected")
    kept = grouped.where(keep)
    dispersion = stats.pearson_dispersion(kept, "conversions", "expected")
    kept = kept.crossJoin(F.broadcast(dispersion))
    global_rate = F.col("total_conversions") / F.col("total_spend")
    matched = F.lit(True)
    if not null_safe:
        for d in dims:
            matched = matched & F.col(d).isNotNull()
    kept = kept.withColumns(
        {
            "z_poisson": stats.score_z("conversions", "expected", F.col("dispersion")),
            "perf_index": ratio("conversions", "expected"),
            "rate": ratio("conversions", "spend"),
            "account_rate": global_rate,
            "cost_per_conv": F.when(F.col("conversions") > 0, ratio("spend", "conversions")),
            "spend_share": ratio("spend", "total_spend"),
            "n_ads": F.when(matched, F.col("__clusters")).otherwise(F.lit(0)).cast("bigint"),
            "reference_rate": leave_one_out_rate(),
        }
    ).drop("__clusters")

    tested = kept.where(matched).select(*[F.col(d).alias(f"__k_{d}") for d in dims], "reference_rate")
    same = [F.col(d).eqNullSafe(F.col(f"__k_{d}")) for d in dims]
    in_scope = units.join(tested, same, "left_semi")
    rates = bootstrap.bootstrap_rates(in_scope, dims, "cluster_id", n_boot, seed, mode)
    compared = rates.join(tested, same).drop(*[f"__k_{d}" for d in dims])
    ends = F.percentile("rate", F.array(F.lit(0.025), F.lit(0.975)))
    inferred = (
        compared.groupBy(*dims)
        .agg(ends.alias("__ci"), bootstrap.bootstrap_p("rate", "reference_rate").alias("__p"))
        .select(
            *[F.col(d).alias(f"__k_{d}") for d in dims],
            F.col("__ci")[0].alias("rate_ci_low"),
            F.col("__ci")[1].alias("rate_ci_high"),
            "__p",
        )
    )
    scored = kept.join(inferred, same, "left").drop(*[f"__k_{d}" for d in dims])
    scored = scored.withColumn("p_value", F.coalesce(F.col("__p"), F.lit(1.0))).drop("__p")
    scored = settled(scored, "inferred")
    discard(units)  # what follows reads segments alone
    scored = stats.benjamini_hochberg(scored, "p_value", "q_value")
    scored = scored.withColumns(
        {
            "significant": F.col("q_value") < fdr_alpha,
            "cpc_ci_low": F.when(F.col("rate_ci_high") > 0, ratio(F.lit(1.0), "rate_ci_high")),
            "cpc_ci_high": F.when(F.col("rate_ci_low") > 0, ratio(F.lit(1.0), "rate_ci_low")),
            "segment": segment_label(dims),
        }
    )
    columns = [
        "segment", *dims, "spend", "conversions", "n_rows", "expected", "z_poisson", "perf_index",
        "rate", "account_rate", "cost_per_conv", "spend_share", "n_ads", "reference_rate",
        "rate_ci_low", "rate_ci_high", "p_value", "q_value", "significant",
        "cpc_ci_low", "cpc_ci_high",
    ]
    scored = settled(scored.select(*columns), "scored")
    ranked = F.col("total_conversions") > 0
    counts = every.agg(
        F.max("total_spend").alias("total_spend"),
        F.max("total_conversions").alias("total_conversions"),
        F.count(F.when(ranked & keep, 1)).alias("n_tested"),
        F.count(F.when(ranked & ~keep, 1)).alias("n_excluded"),
    )
    summary = counts.crossJoin(F.broadcast(dispersion)).select(
        F.coalesce("total_spend", F.lit(0.0)).alias("total_spend"),
        F.coalesce("total_conversions", F.lit(0.0)).alias("total_conversions"),
        F.coalesce(ratio("total_conversions", "total_spend"), F.lit(0.0)).alias("global_rate"),
        "dispersion",
        "n_tested",
        "n_excluded",
        F.lit(n_boot).alias("n_boot"),
        F.lit(mode).alias("mode"),
    )
    return SegmentRanking(
        scored.orderBy(F.desc("perf_index"), "segment"), excluded, summary, mode
    )


def rank_family(df: DataFrame, spec: SegmentSpec, outcome: str = DEFAULT_OUTCOME, **options):
    """rank_segments with the columns of a registered family."""
    return rank_segments(
        df, spec.dims, cluster=spec.cluster, outcome=spec.outcome or outcome, **options
    )


def head_and_tail(scored: DataFrame, n: int, order: str = "perf_index", tie: str = "segment"):
    """Best n and worst n rows; the tail only when the frame has more than 2n rows."""
    top = Window.orderBy(F.desc(order), F.asc(tie))
    placed = scored.withColumns(
        {"__r": F.row_number().over(top), "__n": F.count(F.lit(1)).over(Window.partitionBy())}
    )
    part = F.when(F.col("__r") <= n, "head").when(
        (F.col("__n") > 2 * n) & (F.col("__r") > F.col("__n") - n), "tail"
    )
    return placed.withColumn("part", part).where("part IS NOT NULL").drop("__r", "__n")


def excluded_summary(excluded: DataFrame) -> DataFrame:
    return excluded.agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.coalesce(F.sum("spend"), F.lit(0.0)).alias("spend"),
    )


def with_index_interval(scored: DataFrame) -> DataFrame:
    """Confidence limits on the performance-index scale."""
    return scored.withColumns(
        {
            "perf_ci_low": ratio("rate_ci_low", "account_rate"),
            "perf_ci_high": ratio("rate_ci_high", "account_rate"),
        }
    )


def rest_index(df: DataFrame, dims, outcome: str, exposure: str = "spend") -> DataFrame:
    """Descriptive index: segment rate over the rate of all other segments."""
    grouped = df.groupBy(*dims).agg(
        F.sum(exposure).alias("spend"), F.sum(outcome).cast("double").alias("conversions")
    )
    both = with_expectation(grouped)
    rest = ratio(
        F.col("total_conversions") - F.col("conversions"), F.col("total_spend") - F.col("spend")
    )
    return both.select(
        *dims, "spend", "conversions", (ratio("conversions", "spend") / F.nullif(rest, F.lit(0.0))).alias("rest_index")
    )


def budget_vs_outcome_shares(df: DataFrame, dims, outcome: str, exposure: str = "spend"):
    """Share of exposure against share of outcome per segment."""
    grouped = df.groupBy(*dims).agg(
        F.sum(exposure).alias("spend"),
        F.coalesce(F.sum(outcome), F.lit(0)).cast("double").alias("conversions"),
    )
    both = with_expectation(grouped)
    return both.select(
        *dims,
        ratio("spend", "total_spend").alias("spend_share"),
        ratio("conversions", "total_conversions").alias("conversion_share"),
    )

"""Star schema for BI tools: three dimensions, five facts, one statistics table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.scalars import event_id, hour_of_range, or_zero
from spendlens.operators.funnel import date_spine, with_date_attributes
from spendlens.operators.segments import FAMILIES, rank_family
from spendlens.operators.sharing import settled
from spendlens.schema import FACT_METRICS, HOUR_RANGE, PASSES
from spendlens.sinks.tables import ids_as_text, write_csv, write_table

STAT_COLUMNS = (
    "dimension", "segment", "spend", "conversions", "n_ads", "rate", "account_rate", "perf_index",
    "cost_per_conv", "rate_ci_low", "rate_ci_high", "cpc_ci_low", "cpc_ci_high", "p_value",
    "q_value", "significant",
)


AD_NAMES = ("campaign_id", "campaign_name", "ad_id", "ad_name", "adset_id", "adset_name")


def ad_totals(ads_daily: DataFrame, names=AD_NAMES) -> DataFrame:
    """Window, days and spend of every ad under each of the names that its rows have.

    Names are keys here: a smallest text as an aggregate would have every row sorted.
    """
    return ads_daily.groupBy(*names).agg(
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
        F.count(F.lit(1)).alias("active_days"),
        F.sum("spend").alias("spend"),
    )


def dim_date(ads_daily: DataFrame) -> DataFrame:
    return with_date_attributes(date_spine(ads_daily))


def dim_campaign(ads_daily: DataFrame) -> DataFrame:
    """Campaigns with their window, ad count and spend."""
    return campaigns_of(ad_totals(ads_daily, ["campaign_id", "campaign_name", "ad_id"]))


def campaigns_of(totals: DataFrame) -> DataFrame:
    """``dim_campaign`` from ``ad_totals``.

    Collapsed to (campaign, ad) first, so a campaign with most of the rows is
    combined map-side and the distinct count is a plain count.
    """
    per_ad = totals.groupBy("campaign_id", "ad_id").agg(
        F.min("campaign_name").alias("campaign_name"),
        F.min("first_day").alias("first_day"),
        F.max("last_day").alias("last_day"),
        F.sum("spend").alias("spend"),
    )
    out = per_ad.groupBy("campaign_id").agg(
        F.min("campaign_name").alias("campaign_name"),
        F.min("first_day").alias("first_day"),
        F.max("last_day").alias("last_day"),
        F.count("ad_id").alias("n_ads"),
        F.sum("spend").alias("total_spend"),
    )
    return out.withColumn("event_id", event_id("campaign_name", "campaign_id"))


def creative_attributes(creatives: DataFrame) -> DataFrame:
    """One row per ad from the creative table."""
    has_video = F.coalesce(F.col("video_id") != "", F.lit(False))
    return creatives.groupBy("ad_id").agg(
        F.min("object_type").alias("object_type"),
        F.min("cta").alias("cta"),
        F.min(has_video).alias("is_video"),
        F.min(F.length("body")).alias("body_length"),
        F.min("title").alias("title"),
    )


def dim_ad(ads_daily: DataFrame, creatives: DataFrame | None = None) -> DataFrame:
    names = ["campaign_id", "ad_id", "ad_name", "adset_id", "adset_name"]
    return ads_of(ad_totals(ads_daily, names), creatives)


def ads_of(totals: DataFrame, creatives: DataFrame | None = None) -> DataFrame:
    """``dim_ad`` from ``ad_totals``."""
    ads = totals.groupBy("ad_id").agg(
        F.min("ad_name").alias("ad_name"),
        F.min("adset_id").alias("adset_id"),
        F.min("adset_name").alias("adset_name"),
        F.min("campaign_id").alias("campaign_id"),
        F.min("first_day").alias("first_day"),
        F.max("last_day").alias("last_day"),
        F.sum("active_days").alias("active_days"),
    )
    return ads if creatives is None else ads.join(creative_attributes(creatives), "ad_id", "left")


def fact(df: DataFrame, dims=(), key: str = "ad_id") -> DataFrame:
    """Rows with known spend; missing metrics become 0."""
    keys = ["ad_id", "campaign_id"] if key == "ad_id" else [key]
    return df.where("spend IS NOT NULL").select(
        F.col("date").cast("date").alias("date"),
        *keys,
        *dims,
        *[or_zero(m).alias(m) for m in FACT_METRICS],
    )


def fact_hourly(df: DataFrame) -> DataFrame:
    staged = fact(df, [HOUR_RANGE], key="campaign_id")
    return staged.withColumn("hour", hour_of_range(HOUR_RANGE)).drop(HOUR_RANGE)


def segment_statistics(
    views: dict[str, DataFrame], families=FAMILIES, **options
) -> DataFrame:
    """Scored segments of every family whose view exists, stacked."""
    out = None
    for spec in families.values():
        if spec.view not in views:
            continue
        ranking = rank_family(views[spec.view], spec, **options)
        part = ranking.scored.withColumn("dimension", F.lit(spec.name)).select(*STAT_COLUMNS)
        out = part if out is None else out.unionByName(part)
    return out


def star_tables(
    views: dict[str, DataFrame],
    creatives: DataFrame | None = None,
    skip_stats: bool = False,
    **options,
) -> dict[str, DataFrame]:
    """All tables of the schema that the available views allow; ids as text.

    The dimensions are read from one stored table of ads, so that each view is
    computed once for its fact and once for what is collapsed from it.
    """
    daily = views["ads_daily"]
    totals = settled(ad_totals(daily), "ads")
    days = totals.select(F.explode(F.array("first_day", "last_day")).alias("date"))
    tables = {
        "dim_date": dim_date(days),
        "dim_campaign": campaigns_of(totals),
        "dim_ad": ads_of(totals, creatives),
        "fact_daily": fact(daily),
    }
    for name in ("age_gender", "placement", "region"):
        spec = PASSES[name]
        if spec.view in views:
            tables[f"fact_{name}"] = fact(views[spec.view], spec.breakdowns)
    if "campaigns_by_hour" in views:
        tables["fact_hourly"] = fact_hourly(views["campaigns_by_hour"])
    if not skip_stats:
        statistics = segment_statistics(views, **options)
        if statistics is not None:
            tables["stat_segments"] = statistics
    return {name: ids_as_text(df) for name, df in tables.items()}


def export_star(tables: dict[str, DataFrame], root: str, also_csv: bool = False) -> dict[str, str]:
    """Write every table under ``root``; returns the paths."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{root}/{name}"
        write_table(df, paths[name])
        if also_csv:
            write_csv(df, f"{root}/csv/{name}")
    return paths

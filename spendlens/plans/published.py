"""Tables as published in the shared spreadsheet (rounded, French headings)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.scalars import ratio, yes_or_blank
from spendlens.operators import funnel


def funnel_table(ads_daily: DataFrame) -> DataFrame:
    rates = funnel.stage_pass_rates(funnel.funnel_stages(funnel.funnel_totals(ads_daily)))
    return rates.orderBy("stage_order").select(
        F.col("stage").alias("Étape"),
        F.col("volume").alias("Volume"),
        F.col("pass_rate").alias("Taux de passage"),
    )


def segment_table(scored: DataFrame, label: str) -> DataFrame:
    return scored.select(
        F.col("segment").alias(label),
        F.bround("spend").alias("Dépense ($)"),
        F.bround("conversions").alias("Conversions"),
        F.round("cost_per_conv", 2).alias("Coût / conv. ($)"),
        F.round("cpc_ci_low", 2).alias("IC bas"),
        F.round("cpc_ci_high", 2).alias("IC haut"),
        F.round("perf_index", 2).alias("Indice"),
        F.round("q_value", 4).alias("q"),
        yes_or_blank("significant").alias("Significatif"),
    )


def summary_table(ads_daily: DataFrame) -> DataFrame:
    """Scope figures and the checkout-to-purchase rate, one row."""
    scope = funnel.account_scope(ads_daily)
    totals = funnel.funnel_totals(ads_daily)
    rate = F.coalesce(ratio("purchase", "initiate_checkout") * 100, F.lit(0.0))
    return scope.crossJoin(F.broadcast(totals.select(F.round(rate, 2).alias("pass_rate_pct"))))

"""What-if: move the budget of significant under-performers to significant winners."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.operators.sharing import shared

DEFAULT_SATURATION = 0.8


@dataclass
class Reallocation:
    donors: DataFrame
    recipients: DataFrame
    totals: DataFrame


def simulate(
    scored: DataFrame,
    saturation: float = DEFAULT_SATURATION,
    donor_index_max: float = 1.0,
    recipient_index_min: float = 1.0,
) -> Reallocation:
    """All three frames are empty unless both sides have a segment.

    The role sums fit one row, so every figure comes from one pass over the
    scored frame plus a broadcast of that row.
    """
    role = F.when(
        F.col("significant") & (F.col("perf_index") < donor_index_max), "donor"
    ).when(F.col("significant") & (F.col("perf_index") > recipient_index_min), "recipient")
    marked = shared(scored.withColumn("role", role))

    def part(name, column):
        return F.sum(F.when(F.col("role") == name, F.col(column)))

    sums = marked.agg(
        part("donor", "spend").alias("freed_spend"),
        part("donor", "conversions").alias("lost_conversions"),
        part("recipient", "spend").alias("recipient_spend"),
        part("recipient", "conversions").alias("recipient_conversions"),
        F.sum("conversions").alias("baseline_conversions"),
    ).where("freed_spend IS NOT NULL AND recipient_spend > 0")
    both = marked.where("role IS NOT NULL").crossJoin(F.broadcast(sums))
    side = [
        "freed_spend", "lost_conversions", "recipient_spend", "recipient_conversions",
        "baseline_conversions", "role",
    ]
    donors = both.where("role = 'donor'").drop(*side)
    extra = F.col("spend") / F.col("recipient_spend") * F.col("freed_spend")
    moved = (
        both.where("role = 'recipient'")
        .withColumn("extra_spend", extra)
        .withColumn("new_spend", F.col("spend") + F.col("extra_spend"))
        .withColumn("linear_conversions", F.col("rate") * F.col("new_spend"))
        .withColumn(
            "saturated_conversions",
            F.col("conversions") * F.pow(F.col("new_spend") / F.col("spend"), F.lit(saturation)),
        )
    )
    kept = F.col("baseline_conversions") - F.col("lost_conversions") - F.col("recipient_conversions")
    gains = moved.groupBy(*side[:-1]).agg(
        F.sum("linear_conversions").alias("__lin"), F.sum("saturated_conversions").alias("__sat")
    )
    totals = gains.select(
        "freed_spend",
        "lost_conversions",
        "baseline_conversions",
        (kept + F.col("__lin")).alias("linear_conversions"),
        (kept + F.col("__sat")).alias("saturated_conversions"),
        F.lit(saturation).alias("saturation"),
    )
    for kind in ("linear", "saturated"):
        gain = F.col(f"{kind}_conversions") - F.col("baseline_conversions")
        pct = F.when(
            F.col("baseline_conversions") != 0,
            gain / F.nullif(F.col("baseline_conversions"), F.lit(0.0)) * 100,
        ).otherwise(F.lit(0.0))
        totals = totals.withColumns({f"{kind}_gain": gain, f"{kind}_gain_pct": pct})
    return Reallocation(
        donors.orderBy(F.desc("spend"), "segment"),
        moved.drop(*side).orderBy(F.desc("extra_spend"), "segment"),
        totals,
    )

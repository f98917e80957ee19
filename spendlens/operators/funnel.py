"""Funnel views, cost tables and calendar-aware measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.scalars import hour_of_range, or_zero, ratio
from spendlens.operators.ordering import exact_percentiles
from spendlens.schema import HOUR_RANGE

# Stage labels as published, in funnel order, with their columns.
FUNNEL_STAGES = (
    ("Impressions", "impressions"),
    ("Clics sur lien", "link_clicks"),
    ("Vues de page", "landing_page_views"),
    ("Ajouts au panier", "add_to_cart"),
    ("Paiements initiés", "initiate_checkout"),
    ("Achats", "purchase"),
)
_STAGE_SOURCES = {
    "impressions": "impressions",
    "link_clicks": "link_click",
    "landing_page_views": "landing_page_view",
    "add_to_cart": "add_to_cart",
    "initiate_checkout": "initiate_checkout",
    "purchase": "purchase",
}


def _stage_sums():
    return [F.sum(src).alias(out) for out, src in _STAGE_SOURCES.items()]


def funnel_by_period(df: DataFrame, period: str = "month") -> DataFrame:
    """Stage sums, pass rates (percent, 2 dp) and cost per checkout by period.

    Every row counts, delivered or not: there is no spend filter here.
    """
    sums = df.groupBy(F.trunc("date", period).alias(period) if period != "day" else F.col("date").alias("day")).agg(
        F.sum("spend").alias("spend"), *_stage_sums()
    )

    def pct(num, den):
        return F.round(ratio(num, den) * 100, 2)

    return sums.withColumns(
        {
            "lpv_to_cart_pct": pct("add_to_cart", "landing_page_views"),
            "cart_to_checkout_pct": pct("initiate_checkout", "add_to_cart"),
            "checkout_to_purchase_pct": pct("purchase", "initiate_checkout"),
            "cost_per_checkout": F.round(ratio("spend", "initiate_checkout"), 4),
        }
    ).orderBy(period)


def ad_lifecycle(df: DataFrame) -> DataFrame:
    """One row per ad: names, activity window, totals, unweighted mean CTR."""
    return df.groupBy("ad_id").agg(
        F.min("ad_name").alias("ad_name"),
        F.min("campaign_name").alias("campaign_name"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
        F.count(F.lit(1)).alias("active_days"),
        F.sum("spend").alias("spend"),
        F.sum("impressions").alias("impressions"),
        F.round(F.avg("ctr"), 4).alias("avg_ctr"),
        F.sum("initiate_checkout").alias("initiate_checkout"),
    )


def funnel_totals(df: DataFrame) -> DataFrame:
    """Stage totals of delivered rows, one row."""
    return df.where("spend > 0").agg(*_stage_sums())


def funnel_stages(totals: DataFrame, purchase_floor: int | None = None) -> DataFrame:
    """Totals row to (stage_order, stage, volume) rows."""
    parts = []
    for i, (label, column) in enumerate(FUNNEL_STAGES):
        volume = F.col(column).cast("double")
        if column == "purchase" and purchase_floor is not None:
            volume = F.greatest(volume, F.lit(float(purchase_floor)))
        parts.append(
            F.struct(F.lit(i).alias("stage_order"), F.lit(label).alias("stage"), volume.alias("volume"))
        )
    return totals.select(F.inline(F.array(*parts)))


def stage_pass_rates(stages: DataFrame) -> DataFrame:
    """Volume over the previous stage, as a ratio with 5 decimals (six rows in all)."""
    previous = F.lag("volume").over(Window.orderBy("stage_order"))
    return stages.withColumn("previous", previous).select(
        "stage_order",
        "stage",
        F.coalesce("volume", F.lit(0.0)).cast("bigint").alias("volume"),
        F.round(ratio("volume", "previous"), 5).alias("pass_rate"),
    )


def broken_pixel_alert(totals: DataFrame, max_purchases: int = 100) -> DataFrame:
    """A row with the checkout-to-purchase rate when purchases are implausibly few."""
    return totals.where((F.col("purchase") < max_purchases) & (F.col("initiate_checkout") > 0)).select(
        "purchase",
        "initiate_checkout",
        (ratio("purchase", "initiate_checkout") * 100).alias("pass_rate_pct"),
    )


def account_scope(df: DataFrame) -> DataFrame:
    """Distinct ads, campaigns and days of delivery with totals and period.

    Distinct (ad, campaign, day) first: the distinct counts then run on the
    much smaller table that the map-side combine leaves.
    """
    base = (
        df.where("spend > 0")
        .groupBy("ad_id", "campaign_id", "date")
        .agg(F.sum("spend").alias("spend"), F.sum("initiate_checkout").alias("ic"))
    )
    return base.agg(
        F.countDistinct("ad_id").alias("ads"),
        F.countDistinct("campaign_id").alias("campaigns"),
        F.countDistinct("date").alias("days"),
        F.round(F.sum("spend"), 2).alias("spend"),
        F.sum("ic").alias("initiate_checkout"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
    )


def kpi_header(monthly: DataFrame) -> DataFrame:
    """Account totals over the monthly funnel view."""
    return monthly.agg(
        F.sum("spend").alias("spend"),
        F.sum("initiate_checkout").alias("checkouts"),
        F.sum("purchase").alias("purchases"),
        F.min("month").alias("first_month"),
        F.max("month").alias("last_month"),
    ).withColumns(
        {
            "cost_per_checkout": ratio("spend", "checkouts"),
            "checkout_to_purchase_pct": ratio("purchases", "checkouts") * 100,
        }
    )


def cost_table(
    df: DataFrame,
    keys: dict,
    outcome: str = "initiate_checkout",
    min_spend: float | None = None,
    min_outcome: float | None = None,
) -> DataFrame:
    """Cost per outcome by group, next to the mean over the groups that are kept."""
    grouped = (
        df.where("spend > 0")
        .groupBy(*[expr.alias(name) for name, expr in keys.items()])
        .agg(F.sum("spend").alias("spend"), F.sum(outcome).alias("conv"))
    )
    if min_spend is not None:
        grouped = grouped.where(F.col("spend") > min_spend)
    if min_outcome is not None:
        grouped = grouped.where(F.col("conv") > min_outcome)
    overall = grouped.agg(ratio(F.sum("spend"), F.sum("conv")).alias("mean_cpa"))
    return grouped.withColumn("cpa", ratio("spend", "conv")).crossJoin(F.broadcast(overall))


def cost_by_placement(df: DataFrame, min_spend: float = 400.0) -> DataFrame:
    label = F.concat("publisher_platform", F.lit(" / "), "platform_position")
    return cost_table(df, {"seg": label}, min_spend=min_spend, min_outcome=0).orderBy("cpa", "seg")


def cost_by_hour(df: DataFrame) -> DataFrame:
    return cost_table(df, {"hour": hour_of_range(HOUR_RANGE)}).orderBy("hour")


def cost_by_age_gender(df: DataFrame, genders=("female", "male"), min_outcome: int = 30):
    """Age rows by gender columns of cost per outcome; ages without data stay as nulls."""
    kept = (
        df.where(F.col("gender").isin(*genders) & (F.col("spend") > 0))
        .groupBy("age", "gender")
        .agg(F.sum("spend").alias("spend"), F.sum("initiate_checkout").alias("conv"))
        .where(F.col("conv") > min_outcome)
    )
    return (
        kept.groupBy("age")
        .pivot("gender", list(genders))
        .agg(F.sum("spend") / F.nullif(F.sum("conv"), F.lit(0)))
        .orderBy("age")
    )


def lifetime_histogram(lifecycle: DataFrame) -> DataFrame:
    return lifecycle.groupBy("active_days").agg(F.count(F.lit(1)).alias("n_ads"))


def survival(lifecycle: DataFrame) -> DataFrame:
    """Share of ads active for at least d days, for every d up to the longest life.

    Runs on the histogram, whose height is the number of distinct lifetimes.
    """
    histogram = lifetime_histogram(lifecycle)
    spine = histogram.agg(F.max("active_days").alias("m")).select(
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))).alias("active_days")
    )
    onward = Window.orderBy("active_days").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    filled = spine.join(histogram, "active_days", "left").withColumn("n_ads", or_zero("n_ads"))
    return filled.select(
        F.col("active_days").alias("d"),
        (F.sum("n_ads").over(onward) / F.sum("n_ads").over(whole)).alias("share"),
    )


def measures(df: DataFrame, keys=()) -> DataFrame:
    """The base measure set for any grouping."""
    sums = df.groupBy(*keys).agg(
        F.sum("spend").alias("spend"),
        F.sum("impressions").alias("impressions"),
        F.sum("link_click").alias("link_clicks"),
        F.sum("initiate_checkout").alias("checkouts"),
        F.sum("purchase").alias("purchases"),
    )
    return sums.withColumns(
        {
            "ctr_link": ratio("link_clicks", "impressions"),
            "cpm": ratio("spend", "impressions") * 1000,
            "cost_per_checkout": ratio("spend", "checkouts"),
            "checkouts_per_dollar": ratio("checkouts", "spend"),
            "checkout_to_purchase": ratio("purchases", "checkouts"),
        }
    )


def night_spend_share(df: DataFrame, first: int = 3, last: int = 8) -> DataFrame:
    """Spend share of the hours first <= h < last."""
    hour = hour_of_range(HOUR_RANGE)
    night = F.sum(F.when((hour >= first) & (hour < last), F.col("spend")).otherwise(F.lit(0.0)))
    return df.agg(
        night.alias("night_spend"),
        F.sum("spend").alias("spend"),
        ratio(night, F.sum("spend")).alias("night_share"),
    )


def frequency_by_life_stage(panel: DataFrame) -> DataFrame:
    """Mean frequency early (day <= 3), mid (8 to 12) and late (> 15) in life."""
    stage = (
        F.when(F.col("day_n") <= 3, "early")
        .when(F.col("day_n").between(8, 12), "mid")
        .when(F.col("day_n") > 15, "late")
    )
    return (
        panel.withColumn("stage", stage)
        .where("stage IS NOT NULL")
        .groupBy("stage")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("frequency").alias("mean_frequency"))
    )


def monthly_coverage(df: DataFrame) -> DataFrame:
    """Rows and spend per month with the share of rows that carry spend."""
    return df.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("spend").alias("spend"),
        F.avg((F.coalesce("spend", F.lit(0.0)) > 0).cast("double")).alias("spend_coverage"),
    )


# --- calendar -----------------------------------------------------------------


RETENTION_MONTHS = 37


def month_calendar(anchor: DataFrame, months_back: int, today: str = "today", retention: int | None = RETENTION_MONTHS) -> DataFrame:
    """The last N months as (label, first, last), oldest first.

    ``anchor`` is one row holding today's date; today itself is excluded. A month
    without any complete day is dropped. N is at least 1 and at most ``retention``,
    the months the source keeps (None: no limit, for data that has landed); a
    number outside raises an error.
    """
    if months_back < 1 or (retention is not None and months_back > retention):
        raise ValueError(f"months_back is {months_back}, but 1 to {retention or 'any'} are kept")
    start = F.add_months(F.trunc(today, "month"), -(months_back - 1))
    months = anchor.select(
        F.col(today).alias("__t"),
        F.explode(
            F.sequence(start, F.trunc(today, "month"), F.expr("INTERVAL 1 MONTH"))
        ).alias("first"),
    )
    last = F.least(F.last_day("first"), F.date_sub("__t", 1))
    return (
        months.select(F.date_format("first", "yyyy-MM").alias("label"), "first", last.alias("last"))
        .where("last >= first")
        .orderBy("label")
    )


def recent_months(calendar: DataFrame, n: int) -> DataFrame:
    """The n latest windows: those a refresh writes again."""
    return calendar.orderBy(F.desc("label")).limit(n)


def date_spine(df: DataFrame, date: str = "date") -> DataFrame:
    """Every calendar day between the first and the last date."""
    span = df.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    return span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("date"))


def with_date_attributes(days: DataFrame) -> DataFrame:
    weekday = F.weekday("date") + 1
    return days.withColumns(
        {
            "year": F.year("date"),
            "month": F.month("date"),
            "month_key": F.date_format("date", "yyyy-MM"),
            "month_label": F.date_format("date", "MMM yyyy"),
            "week": F.weekofyear("date"),
            "day_of_week": weekday,
            "day_name": F.date_format("date", "EEEE"),
            "is_weekend": weekday >= 6,
        }
    )


def previous_month(df: DataFrame) -> DataFrame:
    """Monthly spend next to the previous calendar month (gaps count as no spend)."""
    monthly = df.groupBy(F.trunc("date", "month").alias("month")).agg(F.sum("spend").alias("spend"))
    span = monthly.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    spine = span.select(
        F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("month")
    )
    # one row per calendar month, so the unpartitioned window stays tiny
    before = F.lag("spend").over(Window.orderBy("month"))
    return (
        spine.join(monthly, "month", "left")
        .withColumn("previous_spend", before)
        .withColumn("variation", ratio(F.col("spend") - F.col("previous_spend"), "previous_spend"))
    )


def year_to_date(df: DataFrame) -> DataFrame:
    """Daily spend with its running total since 1 January."""
    daily = df.groupBy("date").agg(F.sum("spend").alias("spend"))
    running = (
        Window.partitionBy(F.year("date"))
        .orderBy("date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return daily.withColumn("spend_ytd", F.sum("spend").over(running))


def launch_window(df: DataFrame, first_days: DataFrame | None = None, days: int = 1) -> DataFrame:
    """Per ad: spend and checkouts within ``days`` calendar days of the first one.

    Rows are summed by ad and day before anything is shuffled. The first day is
    the ad's earliest in ``df`` (a window over a row for each day), unless
    ``first_days`` names it.
    """
    since = F.datediff("date", "first_day")
    early = since <= days
    daily = df.groupBy("ad_id", "date").agg(F.sum("spend").alias("spend"), F.sum("initiate_checkout").alias("initiate_checkout"))
    if first_days is None:
        joined = daily.withColumn("first_day", F.min("date").over(Window.partitionBy("ad_id")))
    else:
        joined = daily.join(first_days.select("ad_id", "first_day"), "ad_id")
    return joined.groupBy("ad_id").agg(
        F.sum(F.when(early, F.col("spend"))).alias("spend_launch"),
        F.sum(F.when(early, F.col("initiate_checkout"))).alias("checkouts_launch"),
        F.max(since).alias("days_since_launch"),
    ).withColumn("launch_rule", ratio("checkouts_launch", "spend_launch"))


def hour_weekday_matrix(fact_hourly: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Checkouts per dollar by hour (rows) and weekday (columns)."""
    # English day names, Monday first.
    days = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
    joined = fact_hourly.join(dim_date.select("date", "day_name"), "date")
    return (
        joined.groupBy("hour")
        .pivot("day_name", days)
        .agg(F.sum("initiate_checkout") / F.nullif(F.sum("spend"), F.lit(0.0)))
    )


# --- fatigue ------------------------------------------------------------------


def fatigue_profile(panel: DataFrame, min_life: int = 12, min_ads: int = 10) -> DataFrame:
    """Median CTR by active-day number over long-lived ads."""
    long_lived = panel.where(F.col("lifetime") >= min_life)
    counts = long_lived.groupBy("day_n").agg(F.countDistinct("ad_id").alias("n"))
    middle = exact_percentiles(long_lived, "ctr", {"ctr": 0.5}, ["day_n"])
    return counts.where(F.col("n") >= min_ads).join(middle, "day_n", "left")


# --- coverage of the landed partitions ----------------------------------------


def rows_per_pass(ledger: DataFrame) -> DataFrame:
    """Rows by pass plus a TOTAL line."""
    return (
        ledger.groupingSets([["pass"], []], "pass")
        .agg(F.sum("rows").cast("bigint").alias("rows"), F.grouping("pass").alias("__g"))
        .select(F.when(F.col("__g") == 1, "TOTAL").otherwise(F.col("pass")).alias("pass"), "rows")
    )


def coverage_matrix(ledger: DataFrame, calendar: DataFrame, passes) -> DataFrame:
    """Month rows by pass columns of log1p(rows); months come from both sides.

    Entries that are not calendar months are left to ``off_calendar``.
    """
    on_calendar = ledger.where(F.col("month").rlike(r"^\d{4}-\d{2}$"))
    months = (
        calendar.select(F.col("label").alias("month"))
        .union(on_calendar.select("month"))
        .distinct()
    )
    wide = (
        on_calendar.groupBy("month")
        .pivot("pass", list(passes))
        .agg(F.log1p(F.sum("rows").cast("double")))
    )
    return months.join(wide, "month", "left")


def off_calendar(ledger: DataFrame) -> DataFrame:
    return ledger.where(~F.col("month").rlike(r"^\d{4}-\d{2}$")).select("pass", "month", "rows")


def expected_grid(ledger: DataFrame, calendar: DataFrame, passes) -> DataFrame:
    """Every expected (pass, month) unit with its row count, null when missing."""
    names = F.explode(F.array(*[F.lit(p) for p in passes])).alias("pass")
    units = calendar.select(F.col("label").alias("month"), names)
    return units.join(ledger.select("pass", "month", "rows"), ["pass", "month"], "left")

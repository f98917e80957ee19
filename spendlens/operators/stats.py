"""Statistical kernels over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.tails import normal_two_sided, student_two_sided
from spendlens.operators.sharing import shared
from spendlens.operators.ordering import (
    exact_percentiles,
    row_mid_ranks,
    value_counts,
    with_running_sums,
    with_slices,
)


def pearson_dispersion(
    df: DataFrame, observed: str, expected: str, n_params: int = 1, keys=()
) -> DataFrame:
    """Quasi-Poisson dispersion, never below 1; 1 when no degree of freedom is left."""
    usable = F.col(expected) > 0
    residual = F.when(
        usable, (F.col(observed) - F.col(expected)) ** 2 / F.nullif(F.col(expected), F.lit(0.0))
    )
    dof = F.count(F.when(usable, 1)) - F.lit(n_params)
    value = F.when(dof <= 0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(1.0), F.sum(residual) / F.nullif(dof, F.lit(0)))
    )
    return df.groupBy(*keys).agg(F.coalesce(value, F.lit(1.0)).alias("dispersion"))


def score_z(observed: str, expected: str, dispersion: Column) -> Column:
    se = F.sqrt(F.greatest(dispersion, F.lit(1.0)) * F.col(expected))
    return F.when(se > 0, (F.col(observed) - F.col(expected)) / F.nullif(se, F.lit(0.0))).otherwise(
        F.lit(0.0)
    )


def score_test(df: DataFrame, observed: str, expected: str, dispersion: Column) -> DataFrame:
    """Append z and its two-sided normal p."""
    scored = df.withColumn("z", score_z(observed, expected, dispersion))
    return scored.withColumn("p_value", normal_two_sided()("z"))


def benjamini_hochberg(df: DataFrame, p: str, out: str, family=()) -> DataFrame:
    """FDR-adjusted p-values per family; null p stays null and is not counted.

    Works on the distinct p-values with their running counts, so the family may
    be of any size: rank(p) = number of tests with a value <= p, and the
    step-up minimum is taken inside each slice and over the later slices. The values
    are cut into slices once; counts run forward over them, the minimum backward.
    """
    family = list(family)
    counted = value_counts(df, p, family)
    cut = with_slices(counted, [p], family)  # the one order both scans use
    whole, slice_ = Window.partitionBy(*family), Window.partitionBy(*family, "__slice")
    earlier = whole.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*family, "__slice").agg(F.sum("n").alias("__t")).select(
        *family, "__slice", F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__off"), F.sum("__t").over(whole).alias("__m")
    )
    up = slice_.orderBy(p).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scaled = cut.withColumn("__rank", F.sum("n").over(up)).join(sizes, [*family, "__slice"]).withColumn(
        "__s", F.col(p) * F.col("__m") / (F.col("__off") + F.col("__rank"))
    )
    down = slice_.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scaled = shared(scaled.select(*family, p, "__slice", F.min("__s").over(down).alias("__in")))
    later = whole.orderBy(F.desc("__slice")).rowsBetween(Window.unboundedPreceding, -1)
    tails = scaled.groupBy(*family, "__slice").agg(F.min("__in").alias("__min")).select(
        *family, "__slice", F.coalesce(F.min("__min").over(later), F.lit(1.0)).alias("__tail")
    )
    adjusted = scaled.join(tails, [*family, "__slice"]).select(
        *family, F.col(p), F.least(F.col("__in"), F.col("__tail"), F.lit(1.0)).alias(out)
    )
    return df.join(adjusted, [*family, p], "left")


def benjamini_hochberg_frame(p: str, family=()) -> Column:
    """The same adjustment as a window column, for result frames of bounded height."""
    p_col = F.col(p)
    whole = Window.partitionBy(*family)
    up = whole.orderBy(F.col(p).asc_nulls_last())
    rank = F.sum(F.when(p_col.isNotNull(), 1)).over(
        up.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return p_col * F.count(p_col).over(whole) / rank


def step_up(df: DataFrame, p: str, out: str, family=()) -> DataFrame:
    """Append BH q-values to a result frame known to be small (one window per family)."""
    scaled = df.withColumn("__scaled", benjamini_hochberg_frame(p, family))
    down = (
        Window.partitionBy(*family)
        .orderBy(F.col(p).desc_nulls_first())
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    q = F.when(F.col(p).isNotNull(), F.least(F.min("__scaled").over(down), F.lit(1.0)))
    return scaled.withColumn(out, q).drop("__scaled")


def spearman(df: DataFrame, x: str, y: str, keys=(), with_p: bool = True) -> DataFrame:
    """Rank correlation per key: columns keys, n, rho, t_stat (and p_value).

    Row pairs are collapsed to distinct (x, y) with their number. Both sides are stacked
    so that one ordering pass ranks them all, in place: a value that most rows share is
    cut into slices like any other, and the two ranks of a pair meet by the pair.
    """
    keys = list(keys)
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    pairs = (
        df.select(*keys, xd.alias("__x"), yd.alias("__y"))
        .where(F.col("__x").isNotNull() & F.col("__y").isNotNull() & ~F.isnan("__x") & ~F.isnan("__y"))
        .groupBy(*keys, "__x", "__y")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    one = lambda side, v, other: F.struct(F.lit(side).alias("side"), F.col(v).alias("v"), F.col(other).alias("other"))
    sides = pairs.select(*keys, "__n", F.inline(F.array(one("x", "__x", "__y"), one("y", "__y", "__x"))))
    ranked = row_mid_ranks(sides, "v", "__n", ["other"], [*keys, "side"])
    first = F.col("side") == "x"
    at = lambda on, c: F.max(F.when(on, F.col(c)))
    both = (
        ranked.withColumns({"__x": F.when(first, F.col("v")).otherwise(F.col("other")), "__y": F.when(first, F.col("other")).otherwise(F.col("v"))})
        .groupBy(*keys, "__x", "__y")
        .agg(F.max("__n").alias("__n"), at(first, "mid_rank").alias("rx"), at(~first, "mid_rank").alias("ry"))
    )
    n = F.col("__n")
    sums = both.groupBy(*keys).agg(
        F.sum("__n").alias("n"),
        F.sum(n * F.col("rx") * F.col("ry")).alias("__xy"),
        F.sum(n * F.col("rx") * F.col("rx")).alias("__xx"),
        F.sum(n * F.col("ry") * F.col("ry")).alias("__yy"),
    )
    centre = (F.col("n") + 1) / 2
    shift = F.col("n") * centre * centre
    sx, sy = F.col("__xx") - shift, F.col("__yy") - shift
    rho = F.when((sx > 0) & (sy > 0), (F.col("__xy") - shift) / F.sqrt(sx * sy))
    out = sums.select(*keys, "n", rho.alias("rho"))
    out = out.withColumn(
        "t_stat",
        F.when(
            F.abs("rho") < 1,
            F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho"))),
        ),
    )
    if with_p:
        exact = F.when(F.abs("rho") >= 1, F.lit(0.0))
        tail = student_two_sided()("t_stat", (F.col("n") - 2).cast("double"))
        out = out.withColumn("__p", tail).withColumn(
            "p_value", F.coalesce(exact, F.col("__p"))
        ).drop("__p")
    return out


def exact_auc(df: DataFrame, score: str, label: str, keys=(), weight: str | None = None) -> DataFrame:
    """Area under the ROC curve by mid-ranks: columns keys, n_pos, n_neg, auc.

    ``weight`` repeats a row (bootstrap counts). A one-class group gets a null.
    """
    keys = list(keys)
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    positive = F.when(F.col(label) == 1, w).otherwise(F.lit(0))
    negative = F.when(F.col(label) == 1, F.lit(0)).otherwise(w)
    counted = value_counts(df, score, keys, __pos=positive, __neg=negative)
    run = with_running_sums(counted, [score], {"__below": "__neg"}, keys)
    wins = F.col("__pos") * (F.col("__below") + F.col("__neg") / 2)
    totals = run.groupBy(*keys).agg(
        F.sum("__pos").alias("n_pos"), F.sum("__neg").alias("n_neg"), F.sum(wins).alias("__wins")
    )
    area = F.col("__wins") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))
    return totals.select(*keys, "n_pos", "n_neg", area.alias("auc"))


def brier(score: str, label: str) -> Column:
    return F.avg((F.col(score) - F.col(label)) ** 2)


def calibration(df: DataFrame, score: str, label: str) -> DataFrame:
    """Quantile bins of the score: n, mean prediction, mean outcome per bin.

    Bins are right-closed between distinct quantile edges; their number follows
    the sample size (one per eight rows, between two and four).
    """
    size = df.agg(F.count(score).alias("__n")).select(
        F.least(F.lit(4), F.greatest(F.lit(2), F.expr("CAST(floor(__n / 8) AS INT)"))).alias("__q")
    )
    probs = {"e1_2": 1 / 2, "e1_3": 1 / 3, "e2_3": 2 / 3, "e1_4": 1 / 4, "e3_4": 3 / 4}
    cuts = exact_percentiles(df, score, {"lo": 0.0, "hi": 1.0, **probs}).crossJoin(size)
    inner = (
        F.when(F.col("__q") == 2, F.array("lo", "e1_2", "hi"))
        .when(F.col("__q") == 3, F.array("lo", "e1_3", "e2_3", "hi"))
        .otherwise(F.array("lo", "e1_4", "e1_2", "e3_4", "hi"))
    )
    cuts = cuts.select(F.array_distinct(inner).alias("__edges"))
    binned = df.where(F.col(score).isNotNull()).crossJoin(F.broadcast(cuts))
    below = F.size(F.filter("__edges", lambda e: e < F.col(score)))
    return (
        binned.withColumn("bin", F.greatest(below, F.lit(1)))
        .groupBy("bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(score).alias("predicted"),
            F.avg(label).alias("observed"),
        )
    )


def relative_slope(df: DataFrame, entity: str, x: str, y: str, min_rows: int = 8) -> DataFrame:
    """Per entity, the least-squares slope of y on x as a percentage of mean y."""
    fitted = df.groupBy(entity).agg(
        F.count(y).alias("n"),
        F.regr_slope(y, x).alias("__slope"),
        F.avg(y).alias("__mean"),
        F.stddev_samp(y).alias("__sd"),
    )
    usable = (F.col("n") >= min_rows) & (F.col("__sd") > 0)
    return fitted.where(usable).select(
        entity, "n", (F.col("__slope") / F.nullif(F.col("__mean"), F.lit(0.0)) * 100).alias("slope_pct")
    )


def slope_summary(slopes: DataFrame, slope: str = "slope_pct") -> DataFrame:
    """Mean, median, share declining and the one-sample t of a set of slopes."""
    basics = slopes.agg(
        F.count(slope).alias("n"),
        F.avg(slope).alias("mean_slope"),
        F.avg((F.col(slope) < 0).cast("double")).alias("share_negative"),
        (F.avg(slope) / F.nullif(F.stddev_samp(slope) / F.sqrt(F.count(slope)), F.lit(0.0))).alias(
            "t_stat"
        ),
    )
    middle = exact_percentiles(slopes, slope, {"median_slope": 0.5})
    return basics.crossJoin(F.broadcast(middle))


def slope_test(slopes: DataFrame, slope: str = "slope_pct") -> DataFrame:
    """slope_summary with the two-sided p of its t statistic."""
    return slope_summary(slopes, slope).withColumn(
        "p_value", student_two_sided()("t_stat", (F.col("n") - 1).cast("double"))
    )


def above_median(df: DataFrame, value: str, label: str) -> DataFrame:
    """Append a 0/1 label: strictly above the exact median of the column."""
    middle = exact_percentiles(df, value, {"__median": 0.5})
    return (
        df.crossJoin(F.broadcast(middle))
        .withColumn(label, F.coalesce(F.col(value) > F.col("__median"), F.lit(False)).cast("int"))
        .drop("__median")
    )


def centred(df: DataFrame, group: str, columns: dict[str, str], min_size: int = 2) -> DataFrame:
    """Keep groups of at least ``min_size`` rows; append value minus group mean.

    Group means come from a pre-aggregated join rather than a window, so a group
    holding most of the rows is never sorted into one task.
    """
    means = (
        df.groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("__size"),
            *[F.avg(src).alias(f"__m_{out}") for out, src in columns.items()],
        )
        .where(F.col("__size") >= min_size)
    )
    joined = df.join(means, group)
    return joined.withColumns(
        {out: F.col(src) - F.col(f"__m_{out}") for out, src in columns.items()}
    ).drop("__size", *[f"__m_{out}" for out in columns])


"""Global order statistics without pulling a whole order into one task.

Ranks, running totals and exact percentiles need a total order. A window with
no partition would sort everything in one task, so the rows are first range
partitioned on (keys, ordering); each partition is a slice. Slices are scanned
on their own and the slice totals, a short table, are added on top.

Inputs carry one row per (keys, ordering); equal values are collapsed to counts
beforehand, so a value shared by a third of all rows is a single row here, and
a key holding most rows is cut into many slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.operators.sharing import settled, shared
from spendlens.session import ship

#: Rows that a ranking task holds at once; a slice of ranked rows is no longer.
SLICE_ROWS = 100_000


def with_slices(df: DataFrame, order_by, keys=()) -> DataFrame:
    """Add ``__slice``, non-decreasing in (keys, ordering).

    The sliced table is kept, so every reader sees the same slice numbers; a
    lost block is computed again with the same range bounds. Without a fixed
    partition count AQE merges small slices, down to one for small inputs.
    """
    ranged = df.repartitionByRange(*keys, *order_by)
    return shared(ranged.withColumn("__slice", F.spark_partition_id()))


def with_running_sums(
    df: DataFrame, order_by, sums: dict[str, str], keys=(), totals: dict[str, str] | None = None
) -> DataFrame:
    """For each ``sums`` entry {new column: source column}, the total of all earlier rows.

    ``totals`` entries get the total over all rows of the key.
    """
    keys, order_by = list(keys), list(order_by)
    cut = with_slices(df, order_by, keys)
    totals = totals or {}
    per_slice = cut.groupBy(*keys, "__slice").agg(
        *[F.sum(src).alias(f"__t_{out}") for out, src in {**sums, **totals}.items()]
    )
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *keys,
        "__slice",
        *[
            F.coalesce(F.sum(f"__t_{out}").over(earlier), F.lit(0)).alias(f"__o_{out}")
            for out in sums
        ],
        *[F.sum(f"__t_{out}").over(whole).alias(out) for out in totals],
    )
    inside = (
        Window.partitionBy(*keys, "__slice")
        .orderBy(*order_by)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    out = cut.withColumns(
        {o: F.coalesce(F.sum(src).over(inside), F.lit(0)) for o, src in sums.items()}
    ).join(offsets, [*keys, "__slice"])
    out = out.withColumns({o: F.col(o) + F.col(f"__o_{o}") for o in sums})
    return out.drop("__slice", *[f"__o_{o}" for o in sums])


def value_counts(df: DataFrame, value: str, keys=(), **weights: Column) -> DataFrame:
    """One row per (keys, value) with ``n`` and any extra summed weights."""
    extra = [F.sum(w).alias(name) for name, w in weights.items()]
    return (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"), *extra)
    )


def mid_ranks(df: DataFrame, value: str, keys=()) -> DataFrame:
    """Average rank of every distinct value: columns keys, value, n, mid_rank."""
    counted = value_counts(df, value, keys)
    ranked = with_running_sums(counted, [value], {"__before": "n"}, keys)
    return ranked.select(
        *keys, value, "n", (F.col("__before") + (F.col("n") + 1) / 2).alias("mid_rank")
    )


def row_mid_ranks(rows: DataFrame, value: str, weight: str, tie_order, keys=()) -> DataFrame:
    """Append ``mid_rank``, the average rank of a row's value in its key, to every row.

    Rows stand for ``weight`` equal ones. They are range partitioned by key, value and
    ``tie_order`` and stored; a task scans its range in slices of ``SLICE_ROWS``, and
    equal values may lie in several. The scan of a slice counts what comes before a value
    and how often it is there. A value at either end of a slice is put together with its
    like from a table of two values for each slice. No row is joined by its value.
    """
    keys, tie_order = list(keys), list(tie_order)
    group = F.concat(F.lit(""), *[F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in map(F.col, keys)])
    named = rows.withColumn("__g", group)
    order = ["__g", value, *tie_order]
    cut = named.repartitionByRange(*order).sortWithinPartitions(*order)
    columns = cut.columns
    at = [columns.index(c) for c in ("__g", value, weight)]

    most = SLICE_ROWS

    def scan(batches):
        first, held, rows, number = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, most - rows)
                held.append(some)
                batch, rows = batch.slice(some.num_rows), rows + some.num_rows
                if rows == most:
                    yield from one_slice(held, first + number)
                    held, rows, number = [], 0, number + 1
        if held:
            yield from one_slice(held, first + number)

    def one_slice(held, slice_):
        whole = pa.Table.from_batches(held)
        g, v, n = (whole.column(i).combine_chunks().to_numpy(zero_copy_only=False) for i in at)
        new_group = np.append(True, g[1:] != g[:-1])
        begins = np.flatnonzero(new_group | np.append(True, v[1:] != v[:-1]))
        ties = np.add.reduceat(n, begins)
        upto = np.cumsum(ties) - ties
        own = np.searchsorted(begins, np.flatnonzero(new_group))  # the group's first run
        before = upto - np.repeat(upto[own], np.diff(np.append(own, len(begins))))
        size = np.diff(np.append(begins, len(v)))
        more = {"__slice": np.full(len(v), slice_, np.int64), "__before": np.repeat(before, size).astype(np.int64), "__ties": np.repeat(ties, size).astype(np.int64)}
        for name, values in more.items():
            whole = whole.append_column(name, pa.array(values))
        yield from whole.to_batches(max_chunksize=50_000)

    ship(rows.sparkSession)
    schema = T.StructType([*cut.schema.fields, T.StructField("__slice", T.LongType()), T.StructField("__before", T.LongType()), T.StructField("__ties", T.LongType())])
    scanned = settled(cut.mapInArrow(scan, schema), "ranks")
    ends = scanned.groupBy("__g", "__slice").agg(
        F.sum(weight).alias("total"), F.min(value).alias("lo"), F.max(value).alias("hi"),
        F.min_by("__ties", value).alias("lo_ties"), F.max_by("__ties", value).alias("hi_ties"), F.max_by("__before", value).alias("hi_before"),
    )
    earlier = Window.partitionBy("__g").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = settled(ends.withColumn("off", F.coalesce(F.sum("total").over(earlier), F.lit(0))), "slices")  # one row for each slice of a key
    edge = ends.select("__g", F.col("lo").alias("v"), F.col("off").alias("start"), F.col("lo_ties").alias("ties")).unionByName(
        ends.filter("lo <> hi").select("__g", F.col("hi").alias("v"), (F.col("off") + F.col("hi_before")).alias("start"), F.col("hi_ties").alias("ties"))
    )
    whole_edge = edge.groupBy("__g", "v").agg(F.min("start").alias("start"), F.sum("ties").alias("ties"))
    rank = (F.col("start") + (F.col("ties") + 1) / 2).alias("rank")
    known = lambda side: whole_edge.select("__g", F.col("v").alias(side), rank.alias(f"{side}_rank"))
    places = ends.join(known("lo"), ["__g", "lo"]).join(known("hi"), ["__g", "hi"]).select("__g", "__slice", "off", "lo", "hi", "lo_rank", "hi_rank")
    inner = F.col("off") + F.col("__before") + (F.col("__ties") + 1) / 2
    mid = F.when(F.col(value) == F.col("lo"), F.col("lo_rank")).when(F.col(value) == F.col("hi"), F.col("hi_rank")).otherwise(inner)
    return scanned.join(places, ["__g", "__slice"]).select(*rows.columns, mid.alias("mid_rank"))


def exact_percentiles(df: DataFrame, value: str, probs: dict[str, float], keys=()) -> DataFrame:
    """Linear-interpolated percentiles, one output column per ``probs`` entry.

    The order statistics are looked up in the running counts of the distinct
    values; nothing is gathered per key.
    """
    keys = list(keys)
    counted = value_counts(df, value, keys)
    run = with_running_sums(counted, [value], {"__before": "n"}, keys, {"__total": "n"})
    picks, outs = [], []
    for i, (name, p) in enumerate(probs.items()):
        pos = (F.col("__total") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("__before") <= at) & (at < F.col("__before") + F.col("n"))
            picks.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"__{side}{i}"))
        spread = F.col(f"__hi{i}") - F.col(f"__lo{i}")
        last = (F.col("__total") - 1) * F.lit(float(p))
        outs.append((F.col(f"__lo{i}") + spread * (last - F.floor(last))).alias(name))
    found = run.groupBy(*keys).agg(F.max("__total").alias("__total"), *picks)
    return found.select(*keys, *outs)


def exact_median(df: DataFrame, value: str, out: str, keys=()) -> DataFrame:
    return exact_percentiles(df, value, {out: 0.5}, keys)


def with_row_position(df: DataFrame, order_by, out: str, keys=()) -> DataFrame:
    """Zero-based position in a total order (``order_by`` must be unique per key)."""
    one = df.withColumn("__one", F.lit(1).cast("bigint"))
    return with_running_sums(one, order_by, {out: "__one"}, keys).drop("__one")

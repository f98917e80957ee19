"""Distributed cluster bootstrap of ratio statistics.

Rows are first collapsed to one unit per (stratum, cluster). Two schemes:

* ``multinomial``: K draws with replacement from the K units of a stratum. Draw
  number i of replicate b picks unit hash(stratum, b, i) mod K. Draws meet their units
  as packed offsets into blocks of positions. Where all draws of a stratum outnumber
  the 2^31 of half a circle of hash words, no draw is made: a unit finds the draws that
  pick it by the inverse of the hash, and every replicate is an arc of that circle.
* ``poisson``: every unit gets an independent Poisson(1) count per replicate.
  No join; a task multiplies counts (replicates x units) with the units' outcome and
  exposure, so only (tasks x strata x replicates) sums are shuffled. Meant for many units.

The scheme never depends on the size of the data: ``poisson`` unless the caller
names the other. A null cluster id is a cluster of its own in both. Texts that
name a stratum or a unit give every part its length first, so values that hold
the separator cannot make two of them one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions import draws
from spendlens.operators.sharing import shared
from spendlens.operators.ordering import with_slices
from spendlens.session import ship

#: From so many draws of a stratum on, units look up the draws that pick them.
WIDE = 2**31
#: Poisson counts that a task makes at once; its arrays of them stay in a core's cache.
CELLS = 1 << 17


def _spread(units: DataFrame, *by: str) -> DataFrame:
    """Redistribute units before they are multiplied by the replicates.

    The fixed count keeps AQE from merging them: it sizes partitions by the bytes
    it sees here, not by the rows that follow.
    """
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(n, *by)


def key_text(*parts: str):
    """One text for several columns: each as its length, a colon and itself; null as a dash."""
    each = [F.col(p).cast("string") for p in parts]
    return F.concat(F.lit(""), *[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in each])


def cluster_units(
    rows: DataFrame, strata, cluster: str, outcome: str, exposure: str
) -> DataFrame:
    """One row per (stratum, cluster) with summed outcome C, exposure S and row count."""
    return rows.groupBy(*strata, cluster).agg(
        F.sum(outcome).alias("C"), F.sum(exposure).alias("S"), F.count(F.lit(1)).alias("n_rows")
    )


def poisson_replicates(units: DataFrame, key, n_boot: int, seed: int = 0) -> DataFrame:
    """Explode every unit into its replicates with a Poisson(1) count ``w``.

    Zero counts stay: filtering on ``w`` would be pushed below the projections
    and inline the whole mixing chain into one expression.
    """
    keyed = units.withColumn("__k", F.concat_ws("|", F.lit(str(seed)), key))
    keyed = keyed.withColumns(
        {"__h1": draws.key_word(F.col("__k"), 0), "__h2": draws.key_word(F.col("__k"), 1)}
    ).drop("__k")
    each = _spread(keyed, "__h1", "__h2").withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    start = F.col("__h1") + F.col("b").cast("bigint") * F.lit(draws.REPLICATE_STEP)
    each = draws.mixed(each, start, "__d")
    each = draws.mixed(each, F.col("__d") + F.col("__h2"), "__u")
    each = each.withColumn("w", draws.poisson_weight("__u"))
    return each.drop("__h1", "__h2", "__d", "__u")


def _poisson_sums(units: DataFrame, strata, unit: str, n_boot: int, seed: int, cells: int = CELLS) -> DataFrame:
    """Totals of C and S for each (stratum, replicate), as products of count matrices.

    A task draws the counts of all replicates for some units of a stratum at a time,
    units x replicates, and multiplies them with the units' C and S. What is shuffled is
    one row for each task, stratum and replicate, whatever the units.
    """
    stratum = (key_text(*strata) if strata else F.lit("")).alias("__g")
    keyed = units.select(*strata, stratum, F.concat_ws("|", F.lit(str(seed)), key_text(*strata, unit)).alias("__k"), "C", "S").select(
        *strata, "__g", draws.key_word(F.col("__k"), 0).alias("__h1"), draws.key_word(F.col("__k"), 1).alias("__h2"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("C", "S")],
    )
    cut = _spread(keyed, "__h1", "__h2").sortWithinPartitions("__g")
    k = len(strata)
    schema = cut.select(*strata).schema.add("b", "integer").add("C", "double").add("S", "double")

    def run(batches):
        names, held, sums = None, None, None
        b = np.arange(1, n_boot + 1)
        none = pa.array(np.zeros(n_boot, dtype=np.int64))

        def totals():
            columns = [*[c.take(none) for c in names], pa.array(b, pa.int32()), pa.array(sums[0]), pa.array(sums[1])]
            return pa.RecordBatch.from_arrays(columns, names=[*strata, "b", "C", "S"])

        step = max(1, cells // n_boot)
        counts, drawn = draws.PoissonCounts(b, step), np.empty((step, n_boot))
        for batch in batches:
            g = batch.column(k).to_numpy(zero_copy_only=False)
            h1, h2, c, s = (batch.column(k + i).to_numpy() for i in range(1, 5))
            at = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.empty(0, np.int64)
            for lo, hi in zip(at, np.append(at[1:], len(g))):
                if g[lo] != held:
                    if names is not None:
                        yield totals()
                    held, names, sums = g[lo], [batch.column(i).slice(lo, 1) for i in range(k)], np.zeros((2, n_boot))
                for i in range(lo, hi, step):
                    some = slice(i, min(i + step, hi))
                    w = drawn[: some.stop - i]
                    w[:] = counts(h1[some], h2[some])
                    sums += np.stack([c[some], s[some]]) @ w
        if names is not None:
            yield totals()

    ship(units.sparkSession)
    return cut.mapInArrow(run, schema).groupBy(*strata, "b").agg(F.sum("C").alias("C"), F.sum("S").alias("S"))


def _positions(units: DataFrame, unit: str) -> DataFrame:
    """Dense 0-based position ``__i`` of a unit in its stratum, and the size ``__K``.

    Units are numbered in the order of the hash of their id, slice by slice of a
    range partitioning, so no task ever sorts a whole stratum.
    """
    keyed = units.withColumn("__w", draws.key_word(key_text(unit), 0))
    spread = with_slices(keyed, ["__w", unit], ["__st"]).withColumnRenamed("__slice", "__bk")
    sizes = spread.groupBy("__st", "__bk").agg(F.count(F.lit(1)).alias("__n"))
    stratum = Window.partitionBy("__st")
    sizes = sizes.select(
        "__st",
        "__bk",
        F.coalesce(
            F.sum("__n").over(stratum.orderBy("__bk").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("__off"),
        F.sum("__n").over(stratum).alias("__K"),
    )
    inside = Window.partitionBy("__st", "__bk").orderBy("__w", F.col(unit).asc_nulls_first())
    numbered = spread.withColumn("__r", F.row_number().over(inside))
    return (
        numbered.join(sizes, ["__st", "__bk"])
        .withColumn("__i", (F.col("__off") + F.col("__r") - 1).cast("bigint"))
        .drop("__bk", "__r", "__off", "__w")
    )


def _known(column) -> tuple[np.ndarray, np.ndarray]:
    """Values with 0 for null, and 1 where there is a value."""
    return column.fill_null(0.0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False).astype(np.float64)


def _sum_columns(totals: np.ndarray) -> list[pa.Array]:
    """Sums of C and S, null where nothing was known; rows of ``totals`` are C, S and how many were known of each."""
    return [pa.array(totals[i], mask=totals[i + 2] == 0) for i in range(2)]


def _multinomial_sums(units: DataFrame, strata, unit: str, n_boot: int, seed: int) -> DataFrame:
    """Totals of C and S over the K draws of each (stratum, replicate)."""
    placed = _positions(units.withColumn("__st", key_text(*strata)), unit)
    placed = shared(placed.select(
        *strata, "__st", draws.key_word(F.concat_ws("|", F.lit(str(seed)), F.col("__st")), 0).alias("__h"),
        "__i", "__K", F.col("C").cast("double").alias("C"), F.col("S").cast("double").alias("S"),
    ))
    ship(units.sparkSession)
    wide = (F.col("__K") * n_boot >= WIDE) & (F.col("__K") <= 2**32)
    some = placed.where("__i = 0").agg(F.count(F.when(wide, 1)).alias("wide"), F.count(F.when(~wide, 1)).alias("narrow")).first()
    sums = _window_sums(placed.where(wide), n_boot) if some["wide"] else None
    if some["narrow"] or sums is None:
        drawn = _drawn_sums(placed.where(~wide), n_boot)
        sums = drawn if sums is None else drawn.unionByName(sums)
    names = placed.where("__i = 0").select("__st", *strata)
    return sums.join(names, "__st").drop("__st")


def _drawn_sums(placed: DataFrame, n_boot: int, chunk: int = 1 << 18, most: int = 1 << 19, cells: int = 1 << 24) -> DataFrame:
    """Draws are made in chunks and sent to blocks of positions, two bytes a draw."""
    block = max(1 << 8, min(1 << 16, cells // n_boot))
    some = placed.where("__i = 0").select(
        "__st", "__h", "__K", F.explode(F.expr(f"sequence(0L, __K - 1, {chunk}L)")).alias("lo"),
        F.expr(f"greatest(1L, {most}L div least(__K, {chunk}L))").alias("step"),
    )
    some = some.select("*", F.explode(F.expr(f"sequence(1L, {n_boot}L, step)")).alias("b0"))

    def draw(batches):
        for batch in batches:
            for r in batch.to_pylist():
                b = np.arange(r["b0"], min(r["b0"] + r["step"], n_boot + 1))
                at = draws.picks(r["__h"], b, np.arange(r["lo"], min(r["lo"] + chunk, r["__K"])), r["__K"])
                key = (((at // block) * len(b) + np.arange(len(b))[:, None]) << 16 | at % block).ravel()
                key.sort()
                blocks = -(-r["__K"] // block)
                ends = np.searchsorted(key, np.arange(blocks * len(b) + 1) << 16)
                packed, sizes = (key & 0xFFFF).astype(np.uint16), np.diff(ends).astype(np.uint32).reshape(blocks, len(b))
                for k in np.flatnonzero(sizes.any(1)):
                    data = packed[ends[k * len(b)] : ends[(k + 1) * len(b)]]
                    yield pa.RecordBatch.from_pylist(
                        [{"__st": r["__st"], "__block": int(k), "b0": r["b0"], "sizes": sizes[k].tobytes(), "data": data.tobytes()}], schema=sent
                    )

    sent = pa.schema([("__st", pa.string()), ("__block", pa.int64()), ("b0", pa.int64()), ("sizes", pa.binary()), ("data", pa.binary())])
    drawn = _spread(some, "__st", "lo", "b0").mapInArrow(draw, "__st string, __block long, b0 long, sizes binary, data binary")
    blocks = placed.select("__st", (F.col("__i") / block).cast("long").alias("__block"), (F.col("__i") % block).cast("int").alias("__o"), "C", "S")

    def add(key, units, rows):
        values = np.zeros((4, block))
        at = units.column("__o").to_numpy()
        for i, c in enumerate(("C", "S")):
            values[i, at], values[i + 2, at] = _known(units.column(c).combine_chunks())
        whole = [False, False, values[2].all(), values[3].all()]
        totals = np.zeros((4, n_boot))
        for b0, sizes, data in zip(*(rows.column(c).to_pylist() for c in ("b0", "sizes", "data"))):
            sizes, at = np.frombuffer(sizes, np.uint32).astype(np.int64), np.frombuffer(data, np.uint16)
            some = np.flatnonzero(sizes)
            begin = (np.cumsum(sizes) - sizes)[some]
            for i in range(4):
                totals[i, b0 - 1 + some] += sizes[some] if whole[i] else np.add.reduceat(values[i][at], begin)
        b = np.flatnonzero(totals[2:].any(0))
        return pa.table([pa.array([key[0].as_py()] * len(b), pa.string()), pa.array(b + 1, pa.int32()), *_sum_columns(totals[:, b])], names=["__st", "b", "C", "S"])

    both = blocks.groupBy("__st", "__block").cogroup(drawn.groupBy("__st", "__block"))
    sums = both.applyInArrow(add, "__st string, b int, C double, S double")
    return sums.groupBy("__st", "b").agg(F.sum("C").alias("C"), F.sum("S").alias("S"))


def _arcs(h: int, k: int, n_boot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The circle cut at both ends of every replicate's arc: cuts, and each arc's first and last cut."""
    first = draws.first_draws(h, np.arange(1, n_boot + 1))
    last = (first + k) & draws.MASK
    cuts = np.unique(np.concatenate([[0], first, last]))
    return cuts, np.searchsorted(cuts, first), np.searchsorted(cuts, last)


def _window_sums(placed: DataFrame, n_boot: int, cells: int = 1 << 20) -> DataFrame:
    """Units add C and S to the cells of the circle whose draws pick them; a replicate sums the cells of its arc.

    The unit at position i of K is picked by the words i, i + K, i + 2K, ... below 2^32, so
    that all units of a stratum together look up 2^32 words, whatever K and the replicates.
    What is shuffled is one row for each task, stratum and cell, two cells a replicate.
    """
    cut = _spread(placed.select("__st", "__h", "__K", "__i", "C", "S"), "__st", "__i").sortWithinPartitions("__st")

    def run(batches):
        held, cuts, totals = None, None, None

        def out():
            some = np.flatnonzero(totals[2:].any(0))
            same = [pa.array([v] * len(some), t) for v, t in zip(held, (pa.string(), pa.int64(), pa.int64()))]
            return pa.RecordBatch.from_arrays([*same, pa.array(some, pa.int64()), *map(pa.array, totals[:, some])], names=names)

        for batch in batches:
            st = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(np.append(True, st[1:] != st[:-1])) if len(st) else np.empty(0, np.int64)
            i = batch.column(3).to_numpy()
            values = [w for pair in zip(*(_known(batch.column(c)) for c in (4, 5))) for w in pair]  # C, S, known C, known S
            known = [bool(w.all()) for w in values[2:]]
            for lo, hi in zip(at, np.append(at[1:], len(st))):
                if held is None or st[lo] != held[0]:
                    if held is not None:
                        yield out()
                    held = [batch.column(c)[int(lo)].as_py() for c in range(3)]
                    cuts = _arcs(held[1], held[2], n_boot)[0]
                    totals = np.zeros((4, len(cuts)))
                    near = np.searchsorted(cuts, np.arange(2**20 + 1) << 12, side="right") - 1  # the cell of every 4096th place
                    after, most = np.append(cuts[1:], 2**32).astype(np.uint64), int(np.diff(near).max())
                k = held[2]
                rounds = -(-(2**32) // k)
                step = max(1, cells // (hi - lo))
                for m in range(0, rounds, step):
                    word = i[None, lo:hi] + (np.arange(m, min(m + step, rounds)) * k)[:, None]
                    hit, times = word < 2**32, len(word)
                    place = draws.draw_numbers(word)
                    cell = near[place >> np.uint32(12)]
                    for _ in range(most):
                        cell += after[cell] <= place
                    cell[~hit] = len(cuts)
                    for j in range(4):
                        if j < 2 or not known[j - 2]:
                            weight = np.broadcast_to(values[j][lo:hi], (times, hi - lo)).ravel()
                            totals[j] += np.bincount(cell.ravel(), weight, len(cuts) + 1)[:-1]
                        else:
                            totals[j] += np.bincount(cell.ravel(), minlength=len(cuts) + 1)[:-1]
        if held is not None:
            yield out()

    names = ["__st", "__h", "__K", "cell", "C", "S", "nC", "nS"]
    found = cut.mapInArrow(run, "__st string, __h long, __K long, cell long, C double, S double, nC double, nS double")
    summed = found.groupBy("__st", "__h", "__K", "cell").agg(*[F.sum(c).alias(c) for c in ("C", "S", "nC", "nS")])

    def arcs(table):
        """The cells of one stratum, two a replicate."""
        st, h, k = (table.column(c)[0].as_py() for c in names[:3])
        cuts, first, last = _arcs(h, k, n_boot)
        totals = np.zeros((4, len(cuts)))
        totals[:, table.column("cell").to_numpy()] = [table.column(c).to_numpy() for c in names[4:]]
        inside = [totals[:, a:z].sum(1) if a < z else totals[:, a:].sum(1) + totals[:, :z].sum(1) for a, z in zip(first, last)]
        return pa.table(
            [pa.array([st] * n_boot, pa.string()), pa.array(np.arange(1, n_boot + 1), pa.int32()), *_sum_columns(np.array(inside).T)], names=["__st", "b", "C", "S"]
        )

    return summed.groupBy("__st").applyInArrow(arcs, "__st string, b int, C double, S double")


def bootstrap_rates(
    units: DataFrame,
    strata,
    unit: str,
    n_boot: int = 2000,
    seed: int = 0,
    mode: str = "poisson",
) -> DataFrame:
    """Replicate rates of sum(C)/sum(S): columns strata, b, rate.

    Strata with fewer than two units or no exposure yield no replicate; a
    replicate without exposure has a null rate.
    """
    strata = list(strata)
    sizes = (
        units.groupBy(*strata)
        .agg(F.count(F.lit(1)).alias("__K"), F.sum("S").alias("__S"))
        .where("__K >= 2 AND __S > 0")
        .select(*[F.col(s).alias(f"__j_{s}") for s in strata])
    )
    same = [F.col(s).eqNullSafe(F.col(f"__j_{s}")) for s in strata]
    usable = units.join(sizes, same, "left_semi") if strata else units.crossJoin(sizes.limit(1))
    usable = usable.select(*strata, unit, "C", "S")
    if mode == "poisson":
        sums = _poisson_sums(usable, strata, unit, n_boot, seed)
    elif mode == "multinomial":
        sums = _multinomial_sums(usable, strata, unit, n_boot, seed)
    else:
        raise ValueError(f"unknown resampling mode {mode!r}")
    rate = F.when(F.col("S") > 0, F.col("C") / F.nullif(F.col("S"), F.lit(0.0)))
    return sums.select(*strata, "b", rate.alias("rate"))


def interval(rates: DataFrame, strata, alpha: float = 0.05) -> DataFrame:
    """Percentile interval per stratum; a group holds at most ``n_boot`` rates."""
    ends = F.percentile("rate", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return (
        rates.groupBy(*strata)
        .agg(ends.alias("__ci"), F.count("rate").alias("n_valid"))
        .select(
            *strata,
            F.col("__ci")[0].alias("rate_ci_low"),
            F.col("__ci")[1].alias("rate_ci_high"),
            "n_valid",
        )
    )


def bootstrap_p(rate: str, reference: str):
    """Aggregate column: two-sided bootstrap p against ``reference``.

    Twice the smaller tail share, kept within [1 / (valid + 1), 1]; 1 when no
    replicate is valid or the reference is null.
    """
    usable = F.col(rate).isNotNull() & F.col(reference).isNotNull()
    low = F.avg(F.when(usable, (F.col(rate) <= F.col(reference)).cast("double")))
    high = F.avg(F.when(usable, (F.col(rate) >= F.col(reference)).cast("double")))
    floor = F.lit(1.0) / (F.count(F.when(usable, 1)) + 1)
    return F.coalesce(
        F.least(F.lit(1.0), F.greatest(F.lit(2.0) * F.least(low, high), floor)), F.lit(1.0)
    )


def row_bootstrap_interval(
    rows: DataFrame,
    row_id: str,
    outcome: str,
    exposure: str,
    n_boot: int = 2000,
    alpha: float = 0.05,
    seed: int = 0,
    mode: str = "poisson",
) -> DataFrame:
    """Interval of sum(outcome)/sum(exposure) when single rows are resampled."""
    units = rows.select(
        F.lit("all").alias("stratum"),
        F.col(row_id).alias("row_id"),
        F.col(outcome).cast("double").alias("C"),
        F.col(exposure).cast("double").alias("S"),
    )
    units = shared(units)
    rates = bootstrap_rates(units, ["stratum"], "row_id", n_boot, seed, mode)
    return interval(rates, ["stratum"], alpha).drop("stratum")


def auc_interval(
    df: DataFrame,
    row_id,
    score: str,
    label: str,
    n_boot: int = 2000,
    alpha: float = 0.05,
    seed: int = 0,
    keys=(),
) -> DataFrame:
    """Percentile interval of the AUC per key; one-class replicates are skipped.

    ``row_id`` names the column or columns that make a row unique. Rows are range
    partitioned by score once, equal scores over several partitions when they are
    many. A task draws the counts of all replicates for its rows, some rows
    at a time, and gives sums for each replicate: of the lowest and the highest
    score it has, which others may share, and of all scores between. The
    negatives of lower scores are added to that short table. What is shuffled
    after the first exchange is partitions x replicates, whatever the rows.
    """
    keys = list(keys)
    ids = [row_id] if isinstance(row_id, str) else list(row_id)
    value = F.col(score).cast("double")
    group = (key_text(*keys) if keys else F.lit("")).alias("__g")
    kept = df.where(value.isNotNull() & ~F.isnan(value))
    rows = kept.select(
        group, value.alias("__score"), F.coalesce((F.col(label) == 1), F.lit(False)).alias("__y"),
        F.concat(F.lit(f"{seed}|"), key_text(*keys, *ids)).alias("__k"),
    ).select("__g", "__score", "__y", draws.key_word(F.col("__k"), 0).alias("__h1"), draws.key_word(F.col("__k"), 1).alias("__h2"))
    order = ["__g", "__score"]
    cut = rows.repartitionByRange(*order, "__h1", "__h2").sortWithinPartitions(*order)

    def run(batches):
        batches = list(batches)  # one range of scores
        if not batches:
            return
        whole = pa.Table.from_batches(batches).combine_chunks()
        g = whole.column("__g").to_numpy(zero_copy_only=False)
        at = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else g
        for lo, hi in zip(at, np.append(at[1:], len(g))):
            yield from _partition_sums(whole.slice(lo, hi - lo), n_boot)

    ship(df.sparkSession)
    sums = cut.mapInArrow(run, "__g string, at double, edge boolean, b int, pos long, neg long, wins double")
    scores = sums.groupBy("__g", "at", "edge", "b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("wins").alias("wins"))
    tied = F.when(F.col("edge"), F.col("pos") * F.col("neg") / 2).otherwise(F.col("wins"))
    lower = Window.partitionBy("__g", "b").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = scores.withColumns({"wins": tied, "below": F.coalesce(F.sum("neg").over(lower), F.lit(0))})
    total = placed.groupBy("__g", "b").agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("wins") + F.col("pos") * F.col("below")).alias("w")
    )
    areas = total.select("__g", (F.col("w") / F.nullif(F.col("p") * F.col("n"), F.lit(0))).alias("auc"))
    ends = F.percentile("auc", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    found = areas.groupBy("__g").agg(ends.alias("__ci"), F.count("auc").alias("n_valid"))
    if keys:
        found = found.join(kept.select(*keys, group).distinct(), "__g")
    return found.select(
        *keys, F.col("__ci")[0].alias("auc_low"), F.col("__ci")[1].alias("auc_high"), "n_valid"
    )


def _partition_sums(table: pa.Table, n_boot: int, cells: int = CELLS):
    """Sums of each replicate for rows of one key, sorted by score: both edge scores, and between.

    Rows are scanned once from low to high, for all replicates side by side: a positive
    one wins against the negatives below it, and half of those that have its score.
    """
    score, y = table.column("__score").to_numpy(), table.column("__y").to_numpy(zero_copy_only=False)
    h1, h2 = (table.column(c).to_numpy() for c in ("__h1", "__h2"))
    new = np.append(True, score[1:] != score[:-1])
    tie, of = np.flatnonzero(new), np.cumsum(new) - 1  # where each distinct score begins
    by = np.lexsort((y, of))  # of equal scores the negatives come first
    y, h1, h2 = y[by], h1[by], h2[by]
    mixed = (np.maximum.reduceat(y, tie) != np.minimum.reduceat(y, tie))[of]  # a score of both classes
    turn = np.append(True, (y[1:] != y[:-1]) | (new[1:] & (mixed[1:] | mixed[:-1])))
    last = len(tie) - 1
    ends = np.append(tie, len(score))
    parts = [(0, 1, True)] + ([(last, last + 1, True)] if last else []) + ([(1, last, False)] if last > 1 else [])
    b = np.arange(1, n_boot + 1)
    step = max(1, cells // n_boot)
    counts, drawn = draws.PoissonCounts(b, step), np.empty((step, n_boot))
    for first, after, edge in parts:
        lo, hi = ends[first], ends[after]
        pos, neg, wins, tied = np.zeros((4, n_boot))  # whole numbers or halves, exact below 2^52
        for i in range(lo, hi, step):
            some = slice(i, min(i + step, hi))
            w = drawn[: some.stop - i]
            w[:] = counts(h1[some], h2[some])
            if edge:
                pos += y[some].astype(np.float64) @ w
                neg += (~y[some]).astype(np.float64) @ w
                continue
            at = np.flatnonzero(np.append(True, turn[i + 1 : some.stop]))
            for j, z in zip(at, np.append(at[1:], len(w))):
                n = w[j] if z == j + 1 else w[j:z].sum(axis=0)
                if y[i + j]:
                    pos += n
                    wins += n * (neg - tied / 2 if mixed[i + j] else neg)
                else:
                    neg += n
                    if mixed[i + j]:
                        if new[i + j]:
                            tied[:] = 0
                        tied += n
        if edge:
            wins = pos * neg / 2
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([table.column("__g")[0].as_py()] * n_boot, pa.string()), pa.array(np.full(n_boot, score[tie[first]])),
                pa.array([edge] * n_boot), pa.array(b, pa.int32()), pa.array(pos.astype(np.int64)), pa.array(neg.astype(np.int64)),
                pa.array(wins),
            ],
            names=["__g", "at", "edge", "b", "pos", "neg", "wins"],
        )

"""Gradient-boosted trees for a 0/1 label: second-order steps on histograms, many models in one pass.

Features are cut into at most ``BINS`` bins once: between any two of their values where
there are few, else at evenly spaced quantiles. A tree grows level by level. For each
level one aggregate adds up gradient, second derivative and rows by (model, node,
feature, bin); from that table, whose size does not depend on the rows, each node takes
the split of the largest gain, and leaves take Newton steps. Rows are stored as bins in
the shared folder with their margins so far, which are stored again every ``KEEP`` trees,
so that a pass applies few trees and lineage stays short.

Gradients are rounded to fixed-point numbers before they are added. Sums of whole numbers
do not depend on their order, so that the same rows always give the same trees.

Models are folds, as in ``newton``: model m learns from the rows whose fold is not m, with
its own medians for missing values and its own bins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.operators.newton import _medians, _training
from spendlens.operators.ordering import value_counts, with_running_sums
from spendlens.operators.sharing import settled
from spendlens.session import ship

# The published learner's parameters and its defaults.
DEPTH, TREES, RATE, LEAF_ROWS, BINS, LEAF_CURVE = 3, 150, 0.06, 15, 255, 1e-3
#: A split must gain more than this; rounding noise is no gain.
LEAST_GAIN = 1e-9
KEEP = 25
#: Stored bytes of binned rows for one task of a pass.
TASK_BYTES = 8 << 20
WIDTH = BINS + 1


@dataclass
class Tree:
    """Nodes by number: 0 is the root, 2k + 1 and 2k + 2 are the children of k; feature -1 is a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    rows: np.ndarray

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The deepest node of each row; ``bins`` are features x rows."""
        node = np.zeros(bins.shape[1], dtype=np.int16)
        for k in np.flatnonzero(self.feature >= 0):  # parents come before their children
            child = (bins[self.feature[k]] > self.bin[k]).astype(np.int16) + np.int16(2 * k + 1)
            node = np.where(node == k, child, node)
        return node


@dataclass
class BoostedFit:
    features: tuple[str, ...]
    medians: np.ndarray
    edges: list[np.ndarray]
    baseline: float
    trees: list[Tree] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bins of raw features, as features x rows; a value on an edge belongs below it."""
        x = np.where(np.isnan(x), self.medians, x)
        return np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(self.edges)]).astype(np.uint8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        return self.baseline + sum((t.value[t.leaf_of(bins)] for t in self.trees), np.zeros(len(x)))

    def nodes(self, spark, tree: int = 0) -> DataFrame:
        """One row a node of a tree: its split or its value."""
        t = self.trees[tree]
        rows = []
        for k in np.flatnonzero(t.rows):
            f = int(t.feature[k])
            split = (self.features[f], float(self.edges[f][t.bin[k]]), float(t.gain[k]), None) if f >= 0 else (None, None, None, float(t.value[k]))
            rows.append((int(k), int(t.rows[k]), *split))
        return spark.createDataFrame(rows, "node int, n long, feature string, threshold double, gain double, value double")


def _edges(training: DataFrame, features, medians: dict, bins: int) -> dict[int, list[np.ndarray]]:
    """Bin edges of each model and feature; some hundred numbers each reach the driver."""
    fill = F.lit(None).cast("double")
    for m, of in medians.items():
        values = F.create_map(*[F.lit(v) for f in features for v in (f, of[f])])
        fill = F.when(F.col("__model") == m, values[F.col("feature")]).otherwise(fill)
    stack = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features])
    long = training.select("__model", F.explode(stack).alias("s")).select("__model", "s.feature", "s.x")
    counted = value_counts(long.withColumn("x", F.coalesce("x", fill)), "x", ["__model", "feature"])
    keys = ["__model", "feature"]
    counted = counted.withColumn("__one", F.lit(1).cast("long"))
    run = with_running_sums(counted, ["x"], {"lo": "n"}, keys, {"total": "n", "values": "__one"}).withColumn("hi", F.col("lo") + F.col("n"))
    few = run.filter(F.col("values") <= bins).withColumn("next", F.lead("x").over(Window.partitionBy(*keys).orderBy("x")))
    between = few.filter("next is not null").select(*keys, ((F.col("x") + F.col("next")) / 2).alias("edge"))
    # quantile k of ``bins`` lies at k (total - 1) / bins: the mean of the values at its floor and ceiling
    last = "(total - 1)"
    steps = {
        "low": f"sequence(greatest(1, (lo * {bins} + {last} - 1) div {last}), least({bins} - 1, (hi * {bins} + {last} - 1) div {last} - 1))",
        "high": f"sequence(greatest(1, ((lo - 1) * {bins}) div {last} + 1), least({bins} - 1, ((hi - 1) * {bins}) div {last}))",
    }
    begin = {
        "low": f"greatest(1, (lo * {bins} + {last} - 1) div {last}) <= least({bins} - 1, (hi * {bins} + {last} - 1) div {last} - 1)",
        "high": f"lo > 0 AND greatest(1, ((lo - 1) * {bins}) div {last} + 1) <= least({bins} - 1, ((hi - 1) * {bins}) div {last})",
    }
    # the smallest value lies at the ceiling of no quantile but its own run's
    begin["high"] = begin["high"].replace("lo > 0 AND ", "hi > 1 AND ")
    many = run.filter(F.col("values") > bins)
    at = lambda side: many.filter(begin[side]).select(*keys, F.explode(F.expr(steps[side])).alias("k"), F.col("x").alias(side))
    quantiles = at("low").join(at("high"), [*keys, "k"]).select(*keys, ((F.col("low") + F.col("high")) / 2).alias("edge"))
    found: dict = {}
    for r in between.unionByName(quantiles).distinct().collect():
        found.setdefault((r["__model"], r["feature"]), []).append(r["edge"])
    return {m: [np.array(sorted(found.get((m, f), []))) for f in features] for m in medians}


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.where(h > 0, g * g / np.where(h > 0, h, 1), 0)


def _grow(tree: Tree, level: int, g: np.ndarray, h: np.ndarray, n: np.ndarray, edges, depth: int, leaf_rows: int, rate: float) -> None:
    """Splits the open nodes of a level; g, h, n are nodes x features x bins."""
    first = 2**level - 1
    for k in range(2**level):
        node = first + k
        if not n[k, 0].sum():
            continue
        total = (g[k, 0].sum(), h[k, 0].sum(), n[k, 0].sum())
        left = [np.cumsum(v[k], axis=1) for v in (g, h, n)]
        right = [t - v for t, v in zip(total, left)]
        fits = np.arange(WIDTH)[None, :] < np.array([len(e) for e in edges])[:, None]
        fits &= (left[2] >= leaf_rows) & (right[2] >= leaf_rows) & (left[1] >= LEAF_CURVE) & (right[1] >= LEAF_CURVE)
        gain = np.where(fits, _gain(left[0], left[1]) + _gain(right[0], right[1]) - _gain(total[0], total[1]), -1.0)
        best = int(gain.argmax())
        f, b = divmod(best, WIDTH)
        tree.rows[node] = total[2]
        if gain[f, b] <= LEAST_GAIN:
            tree.value[node] = -rate * total[0] / total[1] if total[1] > 0 else 0.0
            continue
        tree.feature[node], tree.bin[node], tree.gain[node] = f, b, gain[f, b]
        if level == depth - 1:
            for child, side in ((2 * node + 1, left), (2 * node + 2, right)):
                tree.rows[child] = side[2][f, b]
                tree.value[child] = -rate * side[0][f, b] / side[1][f, b]


def _histograms(binned: DataFrame, models: list[int], widths: dict, recent: dict, growing: dict, level: int, scale: float) -> dict:
    """Sums by (node, feature, bin) of a level for each model: arrays of gradients, second derivatives, rows.

    ``widths`` has the number of bins of each feature. A task and a model give one row, its sums
    end to end, and these are added up by model.
    """
    d, nodes = len(next(iter(widths.values()))), 2**level

    def run(batches):
        sums = {m: [np.zeros((3, nodes, w), np.int64) for w in widths[m]] for m in models}
        for fold, y, bins, margin in _blocks(batches, len(models), d):
            for i, m in enumerate(models):
                node = growing[m].leaf_of(bins[i]) - (nodes - 1)
                pick = np.flatnonzero((fold != m) & (node >= 0))
                b = bins[i].take(pick, axis=1)
                z = margin[i][pick] + sum((t.value[t.leaf_of(b)] for t in recent[m]), np.zeros(len(pick)))
                p = 1 / (1 + np.exp(-z))
                g, h = np.rint((p - y[pick]) * scale), np.rint(p * (1 - p) * scale)
                node = node[pick].astype(np.intp)
                for f, w in enumerate(widths[m]):
                    at = node * w + b[f]
                    for j, weight in enumerate((g, h, None)):
                        sums[m][f][j] += np.bincount(at, weight, nodes * w).astype(np.int64).reshape(nodes, w)
        rows = [(m, np.concatenate([v.ravel() for v in total]).tobytes()) for m, total in sums.items() if total[0][2].any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.binary())], names=["model", "sums"])

    def add(table):
        total = sum(np.frombuffer(v.as_py(), np.int64) for v in table.column("sums"))
        return pa.table({"model": table.column("model")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    summed = binned.mapInArrow(run, "model int, sums binary").groupBy("model").applyInArrow(add, "model int, sums binary")
    out = {}
    for r in summed.collect():  # bounded: models x nodes x features x bins
        whole, at, flat = np.zeros((3, nodes, d, WIDTH)), 0, np.frombuffer(bytes(r["sums"]), np.int64)
        for f, w in enumerate(widths[r["model"]]):
            whole[:, :, f, :w] = flat[at : at + 3 * nodes * w].reshape(3, nodes, w)
            at += 3 * nodes * w
        out[r["model"]] = [whole[0] / scale, whole[1] / scale, whole[2]]
    return out


BLOCK = "__fold binary, __y binary, __bins binary, __margin binary"


def _block(fold: np.ndarray, y: np.ndarray, bins: np.ndarray, margin: np.ndarray) -> pa.RecordBatch:
    """Some rows as one: folds, labels, bins (models x features x rows) and margins (models x rows)."""
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (fold, y, bins, margin)], names=["__fold", "__y", "__bins", "__margin"])


def _blocks(batches, k: int, d: int):
    """What ``_block`` packed, block by block."""
    for batch in batches:
        for fold, y, bins, margin in zip(*(batch.column(i) for i in range(4))):
            fold = np.frombuffer(fold.as_buffer(), np.int32)
            yield (
                fold, np.frombuffer(y.as_buffer(), np.float64),
                np.frombuffer(bins.as_buffer(), np.uint8).reshape(k, d, len(fold)), np.frombuffer(margin.as_buffer(), np.float64).reshape(k, len(fold)),
            )


def _with_margins(binned: DataFrame, models: list[int], d: int, recent: dict) -> DataFrame:
    """The binned rows with the trees since the last copy added to their margins, stored."""

    def run(batches):
        for fold, y, bins, margin in _blocks(batches, len(models), d):
            after = np.stack([margin[i] + sum((t.value[t.leaf_of(bins[i])] for t in recent[m]), np.zeros(len(y))) for i, m in enumerate(models)])
            yield _block(fold, y, bins, after)

    return settled(binned.mapInArrow(run, BLOCK), "boosted", TASK_BYTES)


def fit_boosted(
    rows: DataFrame, features, label: str, models: list[int], fold: str | None = None, trees: int = TREES, rate: float = RATE,
    depth: int = DEPTH, leaf_rows: int = LEAF_ROWS, bins: int = BINS,
) -> dict[int, BoostedFit]:
    """A fit for each of ``models`` from the rows whose ``fold`` is another (all rows without ``fold``)."""
    features = tuple(features)
    ship(rows.sparkSession)
    plain = settled(
        rows.select(
            (F.col(fold) if fold else F.lit(-1)).cast("int").alias("__fold"), F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("__y"),
            *[F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(f) for f in features],
        ),
        "boosting",
    )
    training = _training(plain, models)
    vectors = plain.select("__fold", "__y", F.array(*[F.coalesce(F.col(f), F.lit(float("nan"))) for f in features]).alias("__x"))
    medians = _medians(vectors, features, models)
    medians = {m: {f: of[f] if of.get(f) is not None else 0.0 for f in features} for m, of in medians.items()}
    models = [m for m in models if m in medians]
    if not models:
        return {}
    edges = _edges(training, features, medians, bins)
    shares = {r["__model"]: (r["p"], r["n"]) for r in training.groupBy("__model").agg(F.avg("__y").alias("p"), F.count(F.lit(1)).alias("n")).collect()}
    edge = lambda p: min(max(p, 1e-15), 1 - 1e-15)
    fits = {
        m: BoostedFit(features, np.array([medians[m][f] for f in features]), edges[m], float(np.log(edge(shares[m][0]) / (1 - edge(shares[m][0])))))
        for m in models
    }
    d = len(features)

    def cut(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, d)
                fold = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
                start = np.repeat([fits[m].baseline for m in models], n)
                yield _block(fold, batch.column(1).to_numpy(zero_copy_only=False), np.stack([fits[m].bins(x) for m in models]), start)

    binned = settled(vectors.mapInArrow(cut, BLOCK), "binned", TASK_BYTES)
    widths = {m: [len(e) + 1 for e in edges[m]] for m in models}
    most = max(n for _, n in shares.values())
    scale = float(2 ** min(30, 62 - int(most).bit_length()))
    size = 2 ** (depth + 1) - 1
    recent: dict[int, list] = {m: [] for m in models}
    for t in range(trees):
        if t and t % KEEP == 0:
            binned = _with_margins(binned, models, d, recent)
            recent = {m: [] for m in models}
        growing = {m: Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros(size), np.zeros(size, np.int64)) for m in models}
        for level in range(depth):
            if level and all((tree.feature[2 ** (level - 1) - 1 : 2**level - 1] < 0).all() for tree in growing.values()):
                break
            for m, sums in _histograms(binned, models, widths, recent, growing, level, scale).items():
                _grow(growing[m], level, *sums, edges[m], depth, leaf_rows, rate)
        for m in models:
            recent[m].append(growing[m])
            fits[m].trees.append(growing[m])
    return fits


def scored(rows: DataFrame, fits: dict[int, BoostedFit], fold: str, keep: list[str], out: str) -> DataFrame:
    """``keep`` and the probability from the model of each row's own fold (null without one)."""
    some = next(iter(fits.values()))
    vector = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in some.features]).alias("__x")
    read = rows.select(*keep, F.col(fold).cast("int").alias("__fold"), vector)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = batch.column(len(keep)).fill_null(-1).to_numpy(zero_copy_only=False)
            x = batch.column(len(keep) + 1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            p = np.full(n, np.nan)
            for m, fit in fits.items():
                pick = own == m
                if pick.any():
                    p[pick] = 1 / (1 + np.exp(-fit.margin(x[pick])))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(p, from_pandas=True)], names=[*keep, out])

    schema = read.select(*keep).schema.add(out, "double")
    return read.mapInArrow(run, schema)

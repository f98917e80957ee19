"""Logistic regression by Newton steps, many models in one pass.

Every step is one aggregate: for weights w, tasks sum the gradient and the second
derivatives of the log-loss over their rows as matrix products, and these sums, some
(features + 1)^2 numbers a model, are added up by place and solved on the driver. The
objective is ``c`` times the summed log-loss plus half the squared weights of the
standardised features; the intercept is free. It is strictly convex in the weights, so
that steps from zero reach the one optimum; a step that makes the objective worse is
halved. Six to nine passes fit all models.

Models are folds: model m learns from the rows whose fold is not m. Means, scales and,
if asked for, the medians that stand for missing values come from the same rows. The
rows are stored once in the shared folder with just what the steps read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.operators.sharing import settled
from spendlens.session import ship

TOLERANCE = 1e-9
MOST_STEPS = 60
#: Stored bytes of rows for one task of a step.
TASK_BYTES = 8 << 20


@dataclass
class LogisticFit:
    """A fitted model; ``score`` is a column expression over the raw features."""

    features: tuple[str, ...]
    means: list[float]
    scales: list[float]
    weights: list[float]
    intercept: float
    medians: dict[str, float] = field(default_factory=dict)
    steps: int = 0
    converged: bool = True

    def margin(self) -> Column:
        margin = F.lit(self.intercept)
        for name, m, s, w in zip(self.features, self.means, self.scales, self.weights):
            x = F.col(name).cast("double")
            if name in self.medians:
                x = F.coalesce(x, F.lit(self.medians[name]))
            margin = margin + F.lit(w) * ((x - F.lit(m)) / F.lit(s))
        return margin

    def score(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))

    def coefficients(self, spark) -> DataFrame:
        rows = sorted(zip(self.features, self.weights), key=lambda r: -abs(r[1]))
        return spark.createDataFrame(rows, "feature string, coefficient double")

    def status(self, spark) -> DataFrame:
        """One row on how the fit went."""
        return spark.createDataFrame([(self.steps, "ok" if self.converged else "not converged")], "steps int, status string")


def _training(rows: DataFrame, models: list[int]) -> DataFrame:
    """The rows once for each model that learns from them."""
    of = F.array(*[F.lit(m) for m in models])
    return rows.withColumn("__model", F.explode(F.filter(of, lambda m: ~m.eqNullSafe(F.col("__fold")))))


#: Bits of a value that a pass over the rows settles, see ``_medians``.
DIGIT = 8


def _places(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; both zeros are one."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits, bits ^ np.int64(-(2**63))).view(np.uint64)


def _value(place: int) -> float:
    """The double that has a place in ``_places``."""
    bits = place ^ (1 << 63) if place >> 63 else ~place & (2**64 - 1)
    return float(np.array([bits], dtype=np.uint64).view(np.float64)[0])


def _digits(vectors: DataFrame, asked: list[tuple[int, int]], shift: int) -> dict[tuple[int, int], dict[int, np.ndarray]]:
    """How many rows of each fold have each next digit, for every (feature, digits before)."""

    def run(batches):
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            fold = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            folds, of = np.unique(fold, return_inverse=True)
            raw = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(fold), -1)
            for i, (f, before) in enumerate(asked):
                place = _places(np.ascontiguousarray(raw[:, f]))
                hit = ~np.isnan(raw[:, f])
                if shift + DIGIT < 64:
                    hit &= place >> np.uint64(shift + DIGIT) == np.uint64(before)
                digit = ((place[hit] >> np.uint64(shift)) & np.uint64(2**DIGIT - 1)).astype(np.int64)
                found = np.bincount(of[hit] << DIGIT | digit, minlength=len(folds) << DIGIT).reshape(len(folds), -1)
                for k, n in zip(folds, found):
                    totals[i, int(k)] = totals.get((i, int(k)), 0) + n
        for (i, k), n in totals.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), i), pa.int32()), pa.array(np.full(len(some), k), pa.int32()), pa.array(some, pa.int32()), pa.array(n[some], pa.int64())],
                names=["asked", "fold", "digit", "n"],
            )

    summed = vectors.mapInArrow(run, "asked int, fold int, digit int, n long").groupBy("asked", "fold", "digit").agg(F.sum("n").alias("n"))
    out: dict[tuple[int, int], dict[int, np.ndarray]] = {key: {} for key in asked}
    for r in summed.collect():  # features x folds x digits, not rows
        out[asked[r["asked"]]].setdefault(r["fold"], np.zeros(2**DIGIT, dtype=np.int64))[r["digit"]] = r["n"]
    return out


def _medians(vectors: DataFrame, features, models: list[int]) -> dict[int, dict[str, float]]:
    """Exact medians of the known values that each model learns from, between the two middle ones.

    Their places are found digit by digit: a pass counts the next digit of the values
    that begin as a middle one does. Nothing is sorted or shuffled but these counts.
    """
    middle: dict[tuple[int, int, int], tuple[int, int]] = {}  # model, feature, which of the two: digits so far, rows before
    known: dict[tuple[int, int], int] = {}
    for shift in range(64 - DIGIT, -1, -DIGIT):
        top = shift + DIGIT == 64
        asked = [(f, 0) for f in range(len(features))] if top else sorted({(f, before) for (_, f, _), (before, _) in middle.items()})
        counts = _digits(vectors, asked, shift)

        def learnt(m, f, before, counts=counts):
            return sum((n for k, n in counts[f, before].items() if k != m), np.zeros(2**DIGIT, dtype=np.int64))

        if top:
            known = {(m, f): int(learnt(m, f, 0).sum()) for m in models for f in range(len(features))}
            middle = {(m, f, side): (0, (n - 1 + side) // 2) for (m, f), n in known.items() if n for side in (0, 1)}
        for (m, f, side), (before, rank) in middle.items():
            upto = np.cumsum(learnt(m, f, before))
            digit = int(np.searchsorted(upto, rank, side="right"))
            middle[m, f, side] = before << DIGIT | digit, rank - (int(upto[digit - 1]) if digit else 0)
    out: dict[int, dict[str, float]] = {}
    for (m, f), n in known.items():
        if n:
            lo, hi = (_value(middle[m, f, side][0]) for side in (0, 1))
            out.setdefault(m, {})[features[f]] = lo + (hi - lo) * ((n - 1) / 2 - (n - 1) // 2)
    return out


def _scaling(training: DataFrame, features, medians) -> dict[int, tuple[int, list[float], list[float]]]:
    """Rows, means and population deviations (1 where they are 0) of each model's filled-in features."""

    def filled(f):
        if not medians:
            return F.col(f)
        value = F.lit(None).cast("double")
        for m, of in medians.items():
            value = F.when(F.col("__model") == m, F.lit(of[f])).otherwise(value)
        return F.coalesce(F.col(f), value)

    columns = {f"x{i}": filled(f) for i, f in enumerate(features)}
    facts = training.select("__model", *[c.alias(n) for n, c in columns.items()]).groupBy("__model").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(f"m_{n}") for n in columns], *[F.stddev_pop(n).alias(f"s_{n}") for n in columns]
    )
    return {
        r["__model"]: (r["n"], [r[f"m_{n}"] for n in columns], [r[f"s_{n}"] or 1.0 for n in columns]) for r in facts.collect()
    }


def _sums(rows: DataFrame, models: dict) -> dict[int, np.ndarray]:
    """For each model the log-loss, the gradient and the second derivatives, laid end to end.

    ``models`` gives fill-in, means, scales and weights of each; rows are ``__fold, __y, __x``.
    """

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fold = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            raw = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            for m, (fill, means, scales, w) in models.items():
                pick = fold != m
                x = raw[pick]
                x = np.where(np.isnan(x), fill, x) if fill is not None else x
                x = np.column_stack([(x - means) / scales, np.ones(len(x))])
                z = x @ w
                p = 1.0 / (1.0 + np.exp(-z))
                loss = np.logaddexp(0.0, z).sum() - z @ y[pick]
                part = np.concatenate([[loss], x.T @ (p - y[pick]), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])
                totals[m] = totals.get(m, 0.0) + part
        for m, total in totals.items():
            at = np.arange(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), m), pa.int32()), pa.array(at, pa.int32()), pa.array(total)], names=["model", "at", "value"])

    summed = rows.mapInArrow(run, "model int, at int, value double").groupBy("model", "at").agg(F.sum("value").alias("value"))
    out: dict[int, list] = {}
    for r in summed.collect():  # squared features, not rows
        out.setdefault(r["model"], []).append((r["at"], r["value"]))
    return {m: np.array([v for _, v in sorted(parts)]) for m, parts in out.items()}


def fit_models(
    rows: DataFrame, features, label: str, models: list[int], fold: str | None = None, c: float = 0.5,
    impute: bool = False, tolerance: float = TOLERANCE, most_steps: int = MOST_STEPS,
) -> dict[int, LogisticFit]:
    """A fit for each of ``models``, from the rows whose ``fold`` is another (all rows without ``fold``).

    Rows with a missing feature take part only with ``impute``; a null label is 0.
    """
    features = tuple(features)
    ship(rows.sparkSession)
    plain = rows.select(
        (F.col(fold) if fold else F.lit(-1)).cast("int").alias("__fold"), F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("__y"),
        *[F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(f) for f in features],
    )
    if not impute:
        plain = plain.dropna(subset=list(features))
    plain = settled(plain, "newton", TASK_BYTES)
    training = _training(plain, models)
    vectors = plain.select("__fold", "__y", F.array(*[F.coalesce(F.col(f), F.lit(float("nan"))) for f in features]).alias("__x"))
    medians = _medians(vectors, features, models) if impute else {}
    scaling = _scaling(training, features, medians)
    d = len(features)
    ridge = np.append(np.ones(d), 0.0)

    live = [m for m in models if m in scaling]
    weight = {m: np.zeros(d + 1) for m in live}
    step = {m: np.zeros(d + 1) for m in live}
    value = {m: np.inf for m in live}
    steps, done = {m: 0 for m in live}, set()
    prepared = {
        m: (np.array([medians[m][f] for f in features]) if impute else None, np.array(scaling[m][1]), np.array(scaling[m][2])) for m in live
    }
    for _ in range(most_steps):
        now = [m for m in live if m not in done]
        if not now:
            break
        sums = _sums(vectors, {m: (*prepared[m], weight[m]) for m in now})
        for m in now:
            w = weight[m]
            worth = c * sums[m][0] + 0.5 * float(ridge @ (w * w))
            if worth > value[m] + 1e-9 * abs(value[m]):  # went too far
                step[m] = step[m] / 2
                weight[m] = w - step[m]
                continue
            value[m] = worth
            slope = c * sums[m][1 : d + 2] + ridge * w
            curve = c * sums[m][d + 2 :].reshape(d + 1, d + 1) + np.diag(ridge)
            step[m] = -np.linalg.solve(curve, slope)
            weight[m] = w + step[m]
            steps[m] += 1
            if np.abs(step[m]).max() <= tolerance:
                done.add(m)
    return {
        m: LogisticFit(features, scaling[m][1], scaling[m][2], [float(v) for v in weight[m][:d]], float(weight[m][d]), medians.get(m, {}), steps[m], m in done)
        for m in live
    }


def fit_one(rows: DataFrame, features, label: str, c: float = 0.5, impute: bool = False) -> LogisticFit:
    """One model from all rows."""
    return fit_models(rows, features, label, [0], None, c, impute)[0]

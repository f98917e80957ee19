"""Newton fits and boosted trees against plain implementations."""

import numpy as np
from pyspark.sql import functions as F

from spendlens.operators import boosting, newton


def table(spark, n=240, seed=5, missing=True):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n) * 3 + 1, rng.integers(0, 4, n).astype(float), rng.normal(size=n)])
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.5 * x[:, 0] - x[:, 1] + 0.3 * x[:, 2] ** 2)))).astype(int)
    if missing:
        x[rng.random(n) < 0.1, 0] = np.nan
    fold = rng.integers(0, 3, n)
    rows = [(k, *[None if np.isnan(v) else float(v) for v in r], int(t), int(f)) for k, (r, t, f) in enumerate(zip(x, y, fold))]
    return x, y, fold, spark.createDataFrame(rows, "id long, a double, b double, c double, y int, fold int").repartition(3)


def plain_newton(x, y, c):
    z = np.column_stack([(x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1), np.ones(len(x))])
    w, pen = np.zeros(z.shape[1]), np.diag([*[1.0] * x.shape[1], 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(c * z.T @ (z * (p * (1 - p))[:, None]) + pen, c * z.T @ (p - y) + pen @ w)
    return w


def filled(x, train):
    return np.where(np.isnan(x), np.nanmedian(x[train], axis=0), x)


def test_all_folds_at_once_equal_single_fits(spark):
    x, y, fold, df = table(spark)
    fits = newton.fit_models(df, ("a", "b", "c"), "y", [0, 1, 2], "fold", c=0.5, impute=True)
    for m, fit in fits.items():
        train = fold != m
        want = plain_newton(filled(x, train)[train], y[train], 0.5)
        assert np.allclose([*fit.weights, fit.intercept], want, atol=1e-8) and fit.converged and fit.steps < 12
        assert fit.status(spark).first()["status"] == "ok"


def test_medians_by_digits_are_exact(spark):
    """Against numpy, with gaps, zeros of both signs, extremes and a null fold."""
    rng = np.random.default_rng(3)
    n = 501
    x = np.column_stack([rng.normal(size=n), rng.choice([-2.0, -0.0, 0.0, 3.5], n), rng.choice([1e308, -1e308, 5e-324, -np.inf, np.inf], n), np.full(n, np.nan)])
    x[:, :3][rng.random((n, 3)) < 0.2] = np.nan
    fold = [None if k % 50 == 0 else k % 3 for k in range(n)]
    df = spark.createDataFrame([(f, 0.0, [float(v) for v in r]) for f, r in zip(fold, x)], "__fold int, __y double, __x array<double>").repartition(5)
    got = newton._medians(df, ("a", "b", "c", "d"), [0, 1, 2])
    for m in range(3):
        train = np.array([f != m for f in fold])
        for name, column in zip("abc", x.T):
            known = np.sort(column[train & ~np.isnan(column)])
            lo, hi = known[(len(known) - 1) // 2], known[len(known) // 2]
            want = lo + (hi - lo) * ((len(known) - 1) % 2 / 2)
            assert got[m][name] == want or np.isnan(want) and np.isnan(got[m][name])
        assert "d" not in got[m]
    assert newton._medians(df.limit(0), ("a",), [0]) == {}


def test_rows_with_missing_features_are_left_out_without_imputation(spark):
    x, y, _, df = table(spark)
    known = ~np.isnan(x[:, 0])
    fit = newton.fit_one(df, ("a", "b", "c"), "y", c=2.0)
    assert np.allclose([*fit.weights, fit.intercept], plain_newton(x[known], y[known], 2.0), atol=1e-8)


def test_steps_that_go_too_far_are_halved(spark):
    rows = [(float(k), int(k > 3)) for k in range(8)] * 3  # separable: weights stay finite by the penalty alone
    df = spark.createDataFrame(rows, "a double, y int")
    x, y = np.array([[r[0]] for r in rows]), np.array([r[1] for r in rows])
    fit = newton.fit_one(df, ("a",), "y", c=1e4)
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(len(x))])
    p = 1 / (1 + np.exp(-z @ [*fit.weights, fit.intercept]))
    assert fit.converged and np.allclose(1e4 * z.T @ (p - y) + [fit.weights[0], 0], 0, atol=1e-4)
    constant = newton.fit_one(df.withColumn("b", F.lit(2.0)), ("a", "b"), "y")
    assert constant.weights[1] == 0.0


def plain_boosting(x, y, trees, rate=0.06, depth=3, least=15):
    """Exact greedy trees on the values themselves, one node at a time."""
    p = y.mean()
    z = np.full(len(y), np.log(p / (1 - p)))

    def grow(rows, level):
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-9, None, None)
        if level < depth:
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for edge in (values[1:] + values[:-1]) / 2:
                    left = x[rows, f] <= edge
                    if least <= left.sum() <= len(rows) - least:
                        gl, hl = grad[rows][left].sum(), hess[rows][left].sum()
                        gain = gl**2 / hl + (g - gl) ** 2 / (h - hl) - g**2 / h
                        if gain > best[0] + 1e-7:
                            best = (gain, f, edge)
        if best[1] is None:
            z[rows] += -rate * g / h
            return
        left = x[rows, best[1]] <= best[2]
        grow(rows[left], level + 1)
        grow(rows[~left], level + 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        grad, hess = p - y, p * (1 - p)
        grow(np.arange(len(y)), 0)
    return z


def test_trees_equal_exact_greedy_trees(spark, monkeypatch):
    x, y, fold, df = table(spark)
    monkeypatch.setattr(boosting, "KEEP", 2)  # margins are stored in between
    fits = boosting.fit_boosted(df, ("a", "b", "c"), "y", [0, 2], "fold", trees=5)
    for m, fit in fits.items():
        train = fold != m
        whole = filled(x, train)
        assert np.allclose(fit.margin(whole[train]), plain_boosting(whole[train], y[train], 5), atol=1e-6)
    scored = {r["id"]: r["p"] for r in boosting.scored(df, fits, "fold", ["id"], "p").collect()}
    for k in range(len(y)):
        m = int(fold[k])
        want = None if m == 1 else 1 / (1 + np.exp(-fits[m].margin(x[k : k + 1])[0]))
        assert scored[k] is None if want is None else abs(scored[k] - want) < 1e-12
    again = boosting.fit_boosted(df.repartition(7), ("a", "b", "c"), "y", [0], "fold", trees=5)[0]
    assert all((t.feature == s.feature).all() and (t.value == s.value).all() for t, s in zip(again.trees, fits[0].trees))


def test_passes_read_blocks_and_give_a_row_a_model(spark, monkeypatch):
    """Rows are stored in blocks, and a level's sums reach the driver as one row a model, whatever the bins."""
    x, y, fold, df = table(spark)
    kept, settled = [], boosting.settled
    monkeypatch.setattr(boosting, "settled", lambda df, name, *a: kept.append((name, settled(df, name, *a))) or kept[-1][1])
    boosting.fit_boosted(df, ("a", "b", "c"), "y", [0, 2], "fold", trees=1)
    binned = dict(kept)["binned"]
    assert binned.count() <= 3
    (f, labels, bins, margin), *_ = boosting._blocks(binned.toArrow().to_batches(), 2, 3)
    assert bins.shape == (2, 3, len(f)) and margin.shape == (2, len(f)) and set(labels) <= {0.0, 1.0}


def test_trees_are_walked_to_the_deepest_node():
    tree = boosting.Tree(np.array([1, -1, 0, -1, -1, -1, -1]), np.array([4, 0, 7, 0, 0, 0, 0]), np.zeros(7), np.zeros(7), np.zeros(7))
    bins = np.array([[0, 7, 8, 255], [4, 5, 5, 255]], dtype=np.uint8)
    assert tree.leaf_of(bins).tolist() == [1, 5, 6, 6]


def test_many_values_are_cut_at_quantiles(spark):
    rng = np.random.default_rng(1)
    for n in (300, 1001):
        x = np.round(rng.normal(size=n), 2) if n == 1001 else rng.normal(size=n)
        df = spark.createDataFrame([(float(v), int(v > 0)) for v in x], "a double, y int")
        fit = boosting.fit_boosted(df, ("a",), "y", [0], trees=1, bins=16)[0]
        want = np.unique(np.percentile(x, np.linspace(0, 100, 17)[1:-1], method="midpoint"))
        assert np.allclose(fit.edges[0], want)


def test_few_rows_give_a_leaf_and_one_class_a_constant(spark):
    df = spark.createDataFrame([(float(k), k % 2) for k in range(20)], "a double, y int")
    fit = boosting.fit_boosted(df, ("a",), "y", [0], trees=2)[0]
    assert [r["feature"] for r in fit.nodes(spark).collect()] == [None]
    same = boosting.fit_boosted(df.withColumn("y", F.lit(1)), ("a",), "y", [0], trees=1)[0]
    assert np.isfinite(same.margin(np.array([[1.0]]))).all()

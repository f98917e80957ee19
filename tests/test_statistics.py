"""Kernels against brute force on small data."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendlens.functions import draws, tails
from spendlens.operators import bootstrap, ordering, stats


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 1500
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "k": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]),
            "x": np.round(rng.normal(size=n), 1),
            "y": np.round(rng.normal(size=n), 2),
            "l": rng.integers(0, 2, n),
        }
    )
    pdf.loc[rng.random(n) < 0.35, "x"] = 0.0  # a value shared by a third of the rows
    return pdf


def test_mid_ranks_match_pandas(spark, frame):
    got = ordering.mid_ranks(spark.createDataFrame(frame), "x", ["k"]).toPandas()
    want = frame.assign(r=frame.groupby("k").x.rank()).groupby(["k", "x"]).r.first()
    assert len(got) == len(want)
    for row in got.itertuples():
        assert row.mid_rank == want[(row.k, row.x)]


@pytest.mark.parametrize("parts", ["1", "7", "60"])
def test_percentiles_do_not_depend_on_partitioning(spark, frame, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(frame).repartition(int(parts))
        got = ordering.exact_percentiles(df, "y", {"lo": 0.025, "mid": 0.5, "hi": 0.975}, ["k"])
        got = got.toPandas().set_index("k")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for k, g in frame.groupby("k"):
        want = np.percentile(g.y, [2.5, 50, 97.5])
        assert np.allclose(got.loc[k, ["lo", "mid", "hi"]].astype(float), want)


def test_percentiles_skip_nulls_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert ordering.exact_median(df, "v", "m").first()["m"] == 2.0


def test_spearman_matches_rank_correlation(spark, frame):
    got = stats.spearman(spark.createDataFrame(frame), "x", "y", ["k"]).toPandas().set_index("k")
    for k, g in frame.groupby("k"):
        assert got.loc[k, "rho"] == pytest.approx(g.x.rank().corr(g.y.rank()))
        assert 0 <= got.loc[k, "p_value"] <= 1


def test_ranking_holds_few_rows_at_once(spark, monkeypatch):
    """A task ranks its range slice by slice; values and groups go on over the ends of slices."""
    monkeypatch.setattr(ordering, "SLICE_ROWS", 7)
    kept, settled = [], ordering.settled
    monkeypatch.setattr(ordering, "settled", lambda df, name, *a: kept.append((name, settled(df, name, *a))) or kept[-1][1])
    values = [0.0] * 40 + [1.0] * 3 + [2.5] * 20 + [float(v) for v in range(3, 20)]
    rows = [(k, v, i, 1 + i % 3) for k in "ab" for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, v double, i int, n long").repartition(3)
    pdf = pd.DataFrame(rows, columns=["k", "v", "i", "n"])
    each = pdf.loc[pdf.index.repeat(pdf.n)]
    want = each.assign(r=each.groupby("k").v.rank()).groupby(["k", "i"]).r.first().to_dict()
    got = {(r["k"], r["i"]): r["mid_rank"] for r in ordering.row_mid_ranks(df, "v", "n", ["i"], ["k"]).collect()}
    assert got == want
    slices = dict(kept)["ranks"].groupBy("__slice").count().collect()
    assert max(r["count"] for r in slices) <= 7 and len(slices) >= len(rows) / 7


def test_spearman_perfect_and_constant(spark):
    df = spark.createDataFrame([("up", i, 2 * i) for i in range(6)] + [("flat", 1, i) for i in range(6)], "k string, x int, y int")
    got = {r["k"]: r for r in stats.spearman(df, "x", "y", ["k"]).collect()}
    assert got["up"]["rho"] == pytest.approx(1.0) and got["up"]["p_value"] == pytest.approx(0.0, abs=1e-12)
    assert got["flat"]["rho"] is None


def test_auc_equals_pair_count(spark, frame):
    got = stats.exact_auc(spark.createDataFrame(frame), "x", "l").first()
    pos, neg = frame[frame.l == 1].x.to_numpy(), frame[frame.l == 0].x.to_numpy()
    pairs = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    assert got["auc"] == pytest.approx(pairs / (len(pos) * len(neg)))
    one = stats.exact_auc(spark.createDataFrame(frame[frame.l == 1]), "x", "l").first()
    assert one["auc"] is None


def test_weighted_auc_repeats_rows(spark, frame):
    small = frame.head(200).assign(w=lambda p: p.id % 4)
    weighted = stats.exact_auc(spark.createDataFrame(small), "y", "l", weight="w").first()["auc"]
    repeated = small.loc[small.index.repeat(small.w)]
    plain = stats.exact_auc(spark.createDataFrame(repeated), "y", "l").first()["auc"]
    assert weighted == pytest.approx(plain)


def _bh(p):
    p = np.asarray(p)
    return np.array([min(1.0, min(v * len(p) / np.sum(p <= v) for v in p if v >= q)) for q in p])


def test_benjamini_hochberg_definition(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.random(120) ** 3, 2)
    df = spark.createDataFrame([(float(v),) for v in p] + [(None,)], "p double")
    for adjust in (stats.benjamini_hochberg, stats.step_up):
        got = adjust(df, "p", "q").toPandas()
        known = got[got.p.notna()].sort_values("p")
        assert len(got) == 121 and got[got.p.isna()].q.isna().all()
        assert np.allclose(known.q, _bh(np.sort(p)))


def test_calibration_matches_quantile_cut(spark):
    rng = np.random.default_rng(9)
    for n in (12, 26, 200):
        pdf = pd.DataFrame({"p": np.round(rng.random(n), 2), "y": rng.integers(0, 2, n)})
        bins = pd.qcut(pdf.p, q=min(4, max(2, n // 8)), duplicates="drop")
        want = pdf.groupby(bins, observed=True).agg(n=("y", "size"), p=("p", "mean"), y=("y", "mean"))
        got = stats.calibration(spark.createDataFrame(pdf), "p", "y").orderBy("bin").toPandas()
        assert list(got.n) == list(want.n)
        assert np.allclose(got.predicted, want.p) and np.allclose(got.observed, want.y)


def test_dispersion_floor_and_degrees_of_freedom(spark):
    wide = spark.createDataFrame([(10.0, 20.0), (40.0, 30.0)], "o double, e double")
    assert stats.pearson_dispersion(wide, "o", "e").first()[0] == pytest.approx(100 / 20 + 100 / 30)
    tight = spark.createDataFrame([(20.0, 20.0), (30.0, 30.0), (1.0, 0.0)], "o double, e double")
    assert stats.pearson_dispersion(tight, "o", "e").first()[0] == 1.0
    single = spark.createDataFrame([(5.0, 50.0)], "o double, e double")
    assert stats.pearson_dispersion(single, "o", "e").first()[0] == 1.0


def test_tail_probabilities(spark):
    df = spark.createDataFrame([(2.0, 5.0), (0.0, 9.0), (-12.7062, 1.0), (1.959964, 1e6)], "t double, nu double")
    t = [r[0] for r in df.select(tails.student_two_sided()("t", "nu")).collect()]
    assert t[0] == pytest.approx(0.1019395, abs=1e-6)
    assert t[1] == 1.0
    assert t[2] == pytest.approx(0.05, abs=1e-5)
    assert t[3] == pytest.approx(0.05, abs=1e-5)
    z = [r[0] for r in df.select(tails.normal_two_sided()("t")).collect()]
    assert z[3] == pytest.approx(0.05, abs=1e-6) and z[1] == 1.0


def test_relative_slope(spark):
    rows = [("a", i, 2.0 + 0.5 * i) for i in range(10)] + [("flat", i, 3.0) for i in range(10)] + [("short", i, i * 1.0) for i in range(5)]
    got = stats.relative_slope(spark.createDataFrame(rows, "e string, x int, y double"), "e", "x", "y").collect()
    assert [r["e"] for r in got] == ["a"]
    assert got[0]["slope_pct"] == pytest.approx(0.5 / 4.25 * 100)


# --- bootstrap ----------------------------------------------------------------


@pytest.fixture(scope="module")
def units():
    rng = np.random.default_rng(1)
    rows = []
    for seg, k in (("big", 300), ("mid", 60), ("one", 1)):
        for i in range(k):
            s = float(rng.gamma(4, 5))
            rows.append((seg, f"{seg}{i}", float(rng.poisson(0.2 * s)), s))
    return rows


SCHEMA = "seg string, unit string, C double, S double"


def test_both_schemes_agree_and_skip_single_clusters(spark, units):
    df = spark.createDataFrame(units, SCHEMA)
    out = {}
    for mode in ("multinomial", "poisson"):
        rates = bootstrap.bootstrap_rates(df, ["seg"], "unit", 600, mode=mode)
        ci = {r["seg"]: r for r in bootstrap.interval(rates, ["seg"]).collect()}
        assert set(ci) == {"big", "mid"}
        assert all(r["n_valid"] == 600 for r in ci.values())
        out[mode] = ci
    pdf = pd.DataFrame(units, columns=["seg", "unit", "C", "S"])
    for seg in ("big", "mid"):
        g = pdf[pdf.seg == seg]
        point = g.C.sum() / g.S.sum()
        widths = []
        for ci in out.values():
            assert ci[seg]["rate_ci_low"] < point < ci[seg]["rate_ci_high"]
            widths.append(ci[seg]["rate_ci_high"] - ci[seg]["rate_ci_low"])
        assert widths[0] == pytest.approx(widths[1], rel=0.2)
        idx = np.random.default_rng(0).integers(0, len(g), (2000, len(g)))
        ref = np.percentile(g.C.to_numpy()[idx].sum(1) / g.S.to_numpy()[idx].sum(1), [2.5, 97.5])
        assert widths[0] == pytest.approx(ref[1] - ref[0], rel=0.2)


@pytest.mark.parametrize("mode", ["multinomial", "poisson"])
def test_draws_do_not_depend_on_partitioning(spark, units, mode):
    def run(parts):
        df = spark.createDataFrame(units, SCHEMA).repartition(parts)
        rows = bootstrap.bootstrap_rates(df, ["seg"], "unit", 20, mode=mode).collect()
        return {(r["seg"], r["b"]): r["rate"] for r in rows}

    a, b = run(1), run(9)
    assert a.keys() == b.keys() and len(a) == 40
    assert all(math.isclose(a[k], b[k], rel_tol=1e-12) for k in a)


def test_multinomial_draws_exactly_k_units(spark):
    df = spark.createDataFrame([("s", f"u{i}", 1.0, 1.0) for i in range(17)], SCHEMA)
    sums = bootstrap._multinomial_sums(df, ["seg"], "unit", 30, 0).collect()
    assert len(sums) == 30 and all(r["C"] == 17.0 for r in sums)


def test_multinomial_sums_without_a_row_per_draw(spark):
    """Both ways of adding up draws, against every draw looked up one by one; null adds nothing, NaN only where it is drawn."""
    k, n_boot, h = 2**20 + 7, 5, 123456789
    held = {0: (1.0, 2.0), 1: (None, 3.0), 70_001: (4.0, None), 524_288: (float("nan"), 1.0), k - 1: (0.25, 8.0)}
    rows = [("s", h, i, k, c, v) for i, (c, v) in held.items()]
    placed = spark.createDataFrame(rows, "__st string, __h long, __i long, __K long, C double, S double").cache()
    want = {}
    for b in range(1, n_boot + 1):
        hit = draws.picks(h, np.array([b]), np.arange(k), k)[0]
        n = {i: int((hit == i).sum()) for i in held}
        want[b] = [
            math.fsum(n[i] * pair[j] for i, pair in held.items() if n[i] and pair[j] is not None)
            if any(n[i] and pair[j] is not None for i, pair in held.items()) else None
            for j in range(2)
        ]
    for way in (bootstrap._drawn_sums, bootstrap._window_sums):
        got = {r["b"]: [r["C"], r["S"]] for r in way(placed, n_boot).collect()}
        for b, pair in want.items():
            for x, y in zip(got.get(b, [None, None]), pair):
                assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, nan_ok=True)), (way, b)


def test_array_counts_equal_column_counts(spark):
    """Counts for arrays, a byte each, are those of the column expressions, also for words near 2^32."""
    words = [(0, 0), (2**32 - 1, 2**32 - 1), (1, 2**32 - 1), *[(k * 2654435761 % 2**32, k * 40503 % 2**32) for k in range(1, 60)]]
    df = spark.createDataFrame(words, "h1 long, h2 long").withColumn("b", F.explode(F.array(F.lit(1), F.lit(77), F.lit(2000))))
    df = draws.mixed(df, F.col("h1") + F.col("b").cast("bigint") * F.lit(draws.REPLICATE_STEP), "d")
    df = draws.mixed(df, F.col("d") + F.col("h2"), "u").withColumn("w", draws.poisson_weight("u"))
    want = {(r["h1"], r["h2"], r["b"]): r["w"] for r in df.collect()}
    h1, h2 = (np.array(v, dtype=np.int64) for v in zip(*words))
    got = draws.poisson_counts(h1, h2, np.array([1, 77, 2000]))
    assert got.dtype == np.uint8
    assert all(got[i, j] == want[(*pair, b)] for i, b in enumerate((1, 77, 2000)) for j, pair in enumerate(words))


def test_words_go_back_to_their_draws():
    h, b = 987654321, np.array([1, 2000])
    i = np.array([0, 1, 77, 2**31])
    words = draws.picks(h, b, i, 2**32)
    first = draws.first_draws(h, b)
    assert ((draws.draw_numbers(words).astype(np.int64) - first[:, None]) % 2**32 == i).all()


def test_bootstrap_p_bounds(spark):
    df = spark.createDataFrame([(float(i), -1.0, None) for i in range(9)], "rate double, below double, none double")
    row = df.agg(bootstrap.bootstrap_p("rate", "below").alias("a"), bootstrap.bootstrap_p("rate", "none").alias("b")).first()
    assert row["a"] == pytest.approx(1 / 10) and row["b"] == 1.0


@pytest.mark.parametrize("mode", ["multinomial", "poisson"])
def test_separators_and_null_clusters(spark, mode):
    """Values that hold the separator stay apart; a null cluster is a cluster of its own."""
    rows = [("a|b", "c", f"u{i}", 0.1, 1.0) for i in range(30)] + [("a", "b|c", f"u{i}", 0.9, 1.0) for i in range(30)]
    rows += [("n", None, f"u{i}", 0.5, 1.0) for i in range(10)] + [("n", None, None, 5.0, 10.0)]
    df = spark.createDataFrame(rows, "x string, y string, unit string, C double, S double")
    got = bootstrap.bootstrap_rates(df, ["x", "y"], "unit", 40, mode=mode).collect()
    for x, y, rate in (("a|b", "c", 0.1), ("a", "b|c", 0.9), ("n", None, 0.5)):
        own = [r["rate"] for r in got if r["x"] == x and r["y"] == y]
        assert len(own) == 40 and own == pytest.approx([rate] * 40)


@pytest.mark.parametrize("parts", [1, 5])
def test_auc_interval_against_weighted_ranks(spark, parts):
    """Many ties, so that one score lies in several partitions."""
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.integers(0, 4)) if i % 3 else 1.0, int(rng.random() < 0.4), "k" if i % 5 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, s double, l int, g string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r["g"]: r for r in bootstrap.auc_interval(df, "id", "s", "l", 60, keys=["g"]).collect()}
        key = bootstrap.F.concat_ws("|", bootstrap.key_text("g", "id"))
        each = bootstrap.poisson_replicates(df, key, 60)
        areas = stats.exact_auc(each, "s", "l", ["g", "b"], weight="w").toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    auc = areas[areas.g == "k"].auc.to_numpy(dtype=float)
    assert got["k"]["n_valid"] == got[None]["n_valid"] == len(auc) == 60
    assert [got["k"]["auc_low"], got["k"]["auc_high"]] == pytest.approx(np.percentile(auc, [2.5, 97.5]))


@pytest.mark.parametrize("kinds", [1, 2, 3, 40, 10**9])
def test_auc_sums_of_a_range_against_matrices(kinds):
    """One scan of the rows, in a few MB whatever the rows, gives the sums over matrices of all counts."""
    rng = np.random.default_rng(kinds)
    n, n_boot = 3000, 500
    score = np.sort(rng.integers(0, kinds, n) / 7)
    y, h1, h2 = rng.random(n) < 0.4, rng.integers(0, 2**32, n), rng.integers(0, 2**32, n)
    rows = pa.table({"__g": ["g"] * n, "__score": score, "__y": y, "__h1": h1, "__h2": h2})
    tracemalloc.start()
    got = list(bootstrap._partition_sums(rows, n_boot))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20
    w = draws.poisson_counts(h1, h2, np.arange(1, n_boot + 1)).astype(np.int64)
    values = np.unique(score)
    pos, neg = (np.stack([(w * k)[:, score == v].sum(1) for v in values]) for k in (y, ~y)) if kinds < 100 else (
        np.where(y, w, 0).T, np.where(y, 0, w).T)
    parts = [(0, 1)] + [(len(pos) - 1, len(pos))] * (len(pos) > 1) + [(1, len(pos) - 1)] * (len(pos) > 2)
    assert [(b.column("edge")[0].as_py(), b.num_rows) for b in got] == [(True, n_boot), (True, n_boot), (False, n_boot)][: len(parts)]
    for batch, (i, j) in zip(got, parts):
        p, q = pos[i:j], neg[i:j]
        want = [p.sum(0), q.sum(0), (p * (q.cumsum(0) - q / 2)).sum(0)]
        for name, values_ in zip(("pos", "neg", "wins"), want):
            assert batch.column(name).to_pylist() == values_.tolist(), name


def test_counts_are_made_in_the_same_arrays():
    """Blocks of rows, also shorter ones, give what all rows at once give, and ask for no further memory."""
    rng = np.random.default_rng(3)
    h1, h2 = rng.integers(0, 2**32, (2, 150))
    b = np.arange(1, 1001)
    whole = draws.poisson_counts(h1, h2, b)
    counts = draws.PoissonCounts(b, 64)
    tracemalloc.start()
    parts = [counts(h1[i : i + 64], h2[i : i + 64]).T.copy() for i in range(0, 150, 64)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (np.concatenate(parts, axis=1) == whole).all() and peak < 150 * 1000 + (1 << 16)


def test_auc_interval_covers_point(spark, frame):
    df = spark.createDataFrame(frame).withColumn("s", F.col("y") + F.col("l"))
    point = stats.exact_auc(df, "s", "l").first()["auc"]
    ci = bootstrap.auc_interval(df, "id", "s", "l", 100).first()
    assert ci["auc_low"] < point < ci["auc_high"] and ci["n_valid"] == 100

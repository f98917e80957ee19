"""Segments, reallocation, triage and creative semantics on hand-made rows."""

import datetime as dt
import struct
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlens.functions import images as im
from spendlens.functions import text as tx
from spendlens.operators import creative, funnel, reallocation, segments, stats, triage
from spendlens.sources.creatives import read_thumbnails


def seg_rows():
    rows = []
    for i in range(40):
        rows.append(("good", f"a{i % 20}", 100.0, 40 + i % 5))
        rows.append(("bad", f"a{i % 20}", 100.0, 10 + i % 3))
        rows.append((None, f"a{i % 20}", 30.0, 8))
    rows += [("single", "only", 400.0, 100)] * 3
    rows += [("tiny", "a1", 1.0, 50), ("free", "a1", 0.0, 9)]
    return rows


@pytest.fixture()
def ranked(spark):
    df = spark.createDataFrame(seg_rows(), "dim string, ad_id string, spend double, conv int")
    return segments.rank_segments(df, ["dim"], outcome="conv", n_boot=200, mode="multinomial")


def test_segment_traps(ranked):
    rows = {r["segment"]: r for r in ranked.scored.collect()}
    assert set(rows) == {"good", "bad", "nan", "single"}
    null, single = rows["nan"], rows["single"]
    assert (null["n_ads"], null["p_value"], null["rate_ci_low"]) == (0, 1.0, None)
    assert (single["n_ads"], single["p_value"], single["rate_ci_low"]) == (1, 1.0, None)
    assert rows["good"]["significant"] and rows["bad"]["significant"]
    excluded = {r["dim"]: r for r in ranked.excluded.collect()}
    assert set(excluded) == {"tiny"}  # zero spend is filtered before grouping
    s = ranked.summary.first()
    assert s["n_tested"] == 4 and s["n_excluded"] == 1 and s["mode"] == "multinomial"
    total_spend = sum(r[2] for r in seg_rows())
    assert s["total_spend"] == total_spend  # excluded segments count in the totals
    good = rows["good"]
    assert good["perf_index"] == pytest.approx(good["rate"] / s["global_rate"])
    rest = (s["total_conversions"] - good["conversions"]) / (total_spend - good["spend"])
    assert good["reference_rate"] == pytest.approx(rest)
    assert good["cpc_ci_low"] == pytest.approx(1 / good["rate_ci_high"])


def test_null_safe_option(spark):
    df = spark.createDataFrame(seg_rows(), "dim string, ad_id string, spend double, conv int")
    out = segments.rank_segments(df, ["dim"], outcome="conv", n_boot=50, mode="poisson", null_safe=True)
    row = out.scored.where("dim IS NULL").first()
    assert row["n_ads"] == 20 and row["rate_ci_low"] is not None


def test_no_outcome_gives_typed_empty_results(spark):
    df = spark.createDataFrame([("x", "a", 5.0, None)], "dim string, ad_id string, spend double, conv int")
    out = segments.rank_segments(df, ["dim"], outcome="conv", n_boot=20)
    assert out.scored.count() == 0 and "q_value" in out.scored.columns
    summary = out.summary.first()
    assert summary["global_rate"] == 0.0 and summary["total_spend"] == 5.0 and summary["n_tested"] == 0
    moved = reallocation.simulate(out.scored)
    assert moved.totals.count() == 0 and moved.donors.count() == 0


def test_reallocation_arithmetic(spark):
    rows = [("w1", 100.0, 50.0, 0.5, 2.0, True), ("w2", 300.0, 120.0, 0.4, 1.6, True),
            ("l", 200.0, 10.0, 0.05, 0.2, True), ("m", 50.0, 10.0, 0.2, 0.8, False)]
    df = spark.createDataFrame(rows, "segment string, spend double, conversions double, rate double, perf_index double, significant boolean")
    out = reallocation.simulate(df)
    t = out.totals.first()
    new1, new2 = 100 + 200 * 0.25, 300 + 200 * 0.75
    linear = 10 + 0.5 * new1 + 0.4 * new2
    saturated = 10 + 50 * (new1 / 100) ** 0.8 + 120 * (new2 / 300) ** 0.8
    assert t["freed_spend"] == 200 and t["lost_conversions"] == 10 and t["baseline_conversions"] == 190
    assert t["linear_conversions"] == pytest.approx(linear)
    assert t["saturated_gain_pct"] == pytest.approx((saturated - 190) / 190 * 100)
    assert [r["segment"] for r in out.recipients.collect()] == ["w2", "w1"]


# --- triage -------------------------------------------------------------------


def daily(spark, ads):
    rows = []
    for ad, (camp, names, n, rate) in ads.items():
        for i in range(n):
            day = dt.date(2024, 1, 1) + dt.timedelta(days=2 * i)
            rows.append((ad, names[min(i, len(names) - 1)], camp, day, 10.0 + i, 100.0, 5.0, 2.0, 4, 3, int(rate * (i + 1))))
    rows.append(("zz", "off", "c9", dt.date(2024, 1, 1), 0.0, 100.0, 1.0, 1.0, 1, 1, 1))
    return spark.createDataFrame(
        rows,
        "ad_id string, ad_name string, campaign_id string, date date, spend double, impressions double, clicks double, cpm double,"
        " landing_page_view int, add_to_cart int, initiate_checkout int",
    )


def test_renamed_ad_and_eligibility(spark):
    df = daily(spark, {"a": ("c1", ["Reel x", "Post x"], 6, 1), "b": ("c1", ["video"], 4, 1), "c": ("c2", ["My Story"], 5, 2)})
    out = {(r["ad_id"], r["ad_name"]): r for r in triage.feature_frame(df).collect()}
    assert set(out) == {("a", "Reel x"), ("a", "Post x"), ("c", "My Story")}
    assert out[("a", "Reel x")]["is_reel"] == 1 and out[("a", "Post x")]["format"] == "post"
    assert out[("a", "Reel x")]["e_spend"] == 10.0 and out[("a", "Post x")]["e_spend"] == 11.0
    for name in ("Reel x", "Post x"):  # the late outcome belongs to the ad, not the name
        assert out[("a", name)]["l_spend"] == 12 + 13 + 14 + 15 and out[("a", name)]["l_days"] == 4
    assert out[("c", "My Story")]["first_day"] == dt.date(2024, 1, 1)


def test_decision_curve_against_loop(spark):
    rng = np.random.default_rng(2)
    n = 45
    rows = [(f"ad{i:02d}", "n", float(np.round(rng.random(), 1)), float(rng.gamma(2, 10)), int(rng.poisson(5))) for i in range(n)]
    df = spark.createDataFrame(rows, "ad_id string, ad_name string, p double, l_spend double, l_ic int")
    got = triage.decision_curve(df).collect()
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    for row, q in zip(got, triage.CUT_FRACTIONS):
        k = int(round(n * q))
        cut, keep = order[:k], order[k:]
        spend, ic = sum(r[3] for r in keep), sum(r[4] for r in keep)
        freed = sum(r[3] for r in cut)
        assert row["ads_cut"] == k and row["spend_freed"] == pytest.approx(freed)
        assert row["projected_conv"] == pytest.approx(ic * ((spend + freed) / spend) ** 0.8)


def test_folds_keep_groups_whole_and_balanced(spark):
    rows = [(g, i) for g, n in zip("abcdefg", (30, 20, 12, 9, 5, 3, 1)) for i in range(n)]
    folds = triage.group_folds(spark.createDataFrame(rows, "g string, i int"), "g", 5)
    per = folds.groupBy("g").agg(F.countDistinct("fold").alias("k")).collect()
    assert all(r["k"] == 1 for r in per)
    assert folds.select("fold").distinct().count() == 5
    few = triage.group_folds(spark.createDataFrame([("a", 1), ("b", 2)], "g string, i int"), "g", 5)
    assert few.select("fold").distinct().count() == 2


def test_temporal_split_falls_back(spark):
    days = [(f"a{i}", dt.date(2024, 1, 1) + dt.timedelta(days=i)) for i in range(8)]
    df = spark.createDataFrame(days, "ad_id string, first_day date")
    assert triage.temporal_split(df).agg(F.sum("is_test")).first()[0] == 2
    fixed = triage.temporal_split(df, "2024-01-04").agg(F.sum("is_test")).first()[0]
    assert fixed == 5
    assert triage.split_status(triage.temporal_split(df)).first()["status"] == "too small"


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 2)) * [2, 5] + [1, -3]
    y = (rng.random(200) < 1 / (1 + np.exp(-(x[:, 0] - 0.2 * x[:, 1])))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    fit = triage.fit_logistic(df, ("a", "b"), "y", c=0.5)
    z = np.column_stack([np.ones(200), (x - x.mean(0)) / x.std(0)])
    w, pen = np.zeros(3), np.diag([0.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(0.5 * z.T @ (z * (p * (1 - p))[:, None]) + pen, 0.5 * z.T @ (p - y) + pen @ w)
    assert np.allclose([fit.intercept, *fit.weights], w, atol=1e-3)
    got = np.array([r[0] for r in df.select(fit.score()).collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-z @ w)), atol=1e-3)


def test_label_is_strictly_above_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double")
    assert sorted(r["y"] for r in stats.above_median(df, "v", "y").collect()) == [0, 0, 0, 1]


# --- creative -----------------------------------------------------------------

BODIES = [None, "", "Dernières PLACES! #fun @me 200 DH\nle 12 août ?", "plain words only", "Réservez vite 🎉✨ 50 dirham", "ÉTÉ 3 MARS\n\n", "99 madame 5avril"]


def test_text_features_against_python(spark):
    import re

    df = spark.createDataFrame([(i, b) for i, b in enumerate(BODIES)], "i int, body string")
    got = {r["i"]: r for r in tx.with_text_features(df).collect()}
    for i, body in enumerate(BODIES):
        raw = body or ""
        flat = "".join(c for c in unicodedata.normalize("NFD", raw.lower()) if unicodedata.category(c) != "Mn")
        letters = [c for c in raw if c.isalpha()]
        r = got[i]
        assert r["n_chars"] == len(raw) and r["n_words"] == len(raw.split())
        assert r["n_lines"] == (raw.count("\n") + 1 if raw else 0)
        assert r["n_hashtags"] == raw.count("#") and r["n_question"] == raw.count("?")
        assert r["caps_ratio"] == pytest.approx(sum(c.isupper() for c in letters) / len(letters) if letters else 0)
        assert r["has_urgency"] == any(t in flat for t in tx.URGENCY_TERMS)
        assert r["has_price"] == bool(re.search(rf"\d+\s*({tx.CURRENCY_WORDS})", flat))
        assert r["has_date"] == bool(re.search(rf"\b\d{{1,2}}\s*({tx.MONTH_NAMES})\b", flat))
    assert got[4]["n_emoji"] == 2


def png(pixels):
    h, w, _ = pixels.shape
    raw = b"".join(b"\x00" + pixels[y].astype(np.uint8).tobytes() for y in range(h))

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def brute_features(pixels):
    a = pixels / 255.0
    r, g, b = a[..., 0], a[..., 1], a[..., 2]
    lum = 0.2126 * r + 0.7152 * g + 0.0722 * b
    hi, lo = a.max(2), a.min(2)
    sat = np.divide(hi - lo, hi, out=np.zeros_like(hi), where=hi > 0)
    rg, yb = r - g, (r + g) / 2 - b
    gy, gx = np.gradient(lum)
    return {
        "aspect_ratio": pixels.shape[1] / pixels.shape[0],
        "brightness": lum.mean(),
        "saturation": sat.mean(),
        "contrast": lum.std(),
        "colorfulness": np.hypot(rg.std(), yb.std()) + 0.3 * np.hypot(rg.mean(), yb.mean()),
        "edge_density": np.hypot(gx, gy).mean(),
        "dark_ratio": (lum < 0.25).mean(),
    }


def test_image_features_from_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    half = np.zeros((8, 10, 3))
    half[:, 5:] = 255
    pics = {"noise": rng.integers(0, 256, (12, 7, 3)), "black": np.zeros((5, 5, 3)), "half": half}
    for name, px in pics.items():
        (tmp_path / f"{name}.png").write_bytes(png(np.asarray(px)))
    (tmp_path / "broken.png").write_bytes(b"not a picture")
    images = read_thumbnails(spark, str(tmp_path))
    assert images.count() == 4
    got = {r["ad_id"]: r for r in im.image_features(images).collect()}
    assert set(got) == set(pics)  # the unreadable file yields no features
    for name, px in pics.items():
        for feature, want in brute_features(np.asarray(px, dtype=float)).items():
            assert got[name][feature] == pytest.approx(want, abs=1e-9), (name, feature)


def test_large_pictures_average_every_pixel():
    import time

    rng = np.random.default_rng(1)
    px = rng.integers(0, 256, (7, 10, 3)).astype(np.uint8)
    got = im.pixels(7, 10, 3, px[:, :, ::-1].tobytes(), max_side=4)
    assert got.shape == (3, 4, 3)
    assert got[0, 0] == pytest.approx(px[:3, :3].mean(axis=(0, 1)) / 255) and got[2, 3] == pytest.approx(px[6, 9] / 255)
    big = rng.integers(0, 256, (320, 320, 3)).astype(np.uint8).tobytes()
    start = time.process_time()
    im.statistics(im.pixels(320, 320, 3, big), 1.0)
    assert time.process_time() - start < 0.1


def test_associations_centre_within_campaigns(spark):
    rng = np.random.default_rng(8)
    rows = []
    for c in range(8):
        for _ in range(12):
            x = float(rng.integers(0, 6))
            rows.append((f"c{c}", f"ad{len(rows)}", x + 10 * c, x, 3.0, -10.0 * c + x + float(rng.normal()) * 0.1))
    df = spark.createDataFrame(rows, "campaign_id string, ad_id string, f1 double, f2 double, const double, t double")
    got = {r["feature"]: r for r in creative.associations(df, "t", ("f1", "f2", "const")).collect()}
    assert set(got) == {"f1", "f2"}  # a constant feature is skipped
    assert got["f1"]["rho"] < -0.9 and got["f1"]["rho_within"] > 0.9
    assert not got["f1"]["holds_within"] and got["f2"]["holds_within"]


def test_survival_and_calendar(spark):
    life = spark.createDataFrame([(1,), (3,), (3,), (5,)], "active_days int")
    got = {r["d"]: r["share"] for r in funnel.survival(life).collect()}
    assert got == {1: 1.0, 2: 0.75, 3: 0.75, 4: 0.25, 5: 0.25}
    today = spark.createDataFrame([(dt.date(2024, 3, 1),)], "today date")
    cal = funnel.month_calendar(today, 3).collect()
    assert [r["label"] for r in cal] == ["2024-01", "2024-02"]  # March has no complete day yet
    assert cal[-1]["last"] == dt.date(2024, 2, 29)

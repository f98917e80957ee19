import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spendlens.llm import neardup as N

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bag(text):
    w = WORD.findall((text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similar(x, y):
    a, b = bag(x), bag(y)
    if not a and not b:
        return (x or "") == (y or "")
    return 5 * sum((a & b).values()) >= 4 * sum((a | b).values())


def brute(rows):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and similar(rows[i][1], rows[j][1]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))]


def corpus(seed=2):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: rng.choice(vocabulary, n).tolist()
    texts = [" ".join(say(int(rng.integers(1, 80)))) for _ in range(60)]
    base = say(120)
    for _ in range(60):  # a large group of near copies
        w = list(base)
        for _ in range(int(rng.integers(1, 4))):
            w[int(rng.integers(0, len(w)))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0].upper() + "!"] * 3 + ["a b a b a b a b a b a b a b", "a b a b a b", "x", "X.", "x y", None, "", "...", "..."]
    return [(i, t, "kept") for i, t in enumerate(texts)]


def test_registers_agree_as_often_as_the_multisets_overlap():
    rng = np.random.default_rng(0)
    for low, high in ((1, 2), (1, 40), (3, 4)):
        a = {int(h): int(rng.integers(low, high)) for h in rng.integers(1, 2**62, 300)}
        b = {h: (c if rng.random() < 0.7 else int(rng.integers(low, 2 * high))) for h, c in a.items() if rng.random() < 0.9}
        b |= {int(h): 1 for h in rng.integers(1, 2**62, 20)}
        true = sum(min(a.get(h, 0), b.get(h, 0)) for h in a | b) / sum(max(a.get(h, 0), b.get(h, 0)) for h in a | b)
        agree = []
        for salt in range(40):
            row = np.repeat([0, 1], [len(a), len(b)])
            h = np.array([*a, *b], dtype=np.uint64) * np.uint64(2 * salt + 1)
            s = N.signatures(row, h, np.array([*a.values(), *b.values()]), 2)
            agree.append((s[0] == s[1]).mean())
        assert np.mean(agree) == pytest.approx(true, abs=0.02)


def test_overlap_of_multisets():
    a = pa.array(["a b a b a b a b", "x y", "", "p q r s t u"])
    b = pa.array(["a b a b a b", "x y", "x", "p q r s t v"])
    got = N.overlap(a, b)
    assert got.tolist() == [sum((bag(x) & bag(y)).values()) for x, y in zip(a.to_pylist(), b.to_pylist())]


def test_classes_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    want = brute(rows)
    sizes = Counter(want)
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in N.classify(docs).collect()}
    assert got == {i: (c, sizes[c]) for i, c in enumerate(want)}
    kept = N.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(sizes)


def test_rounds_find_links_that_leaders_miss(spark):
    """All keys share one bucket; most links are not with its leader."""
    from pyspark.sql import functions as F

    from spendlens.llm.components import resolve

    ws = N.Workspace(spark, "test")
    nodes = spark.range(60).select(F.col("id").alias("key"))
    buckets = nodes.select(F.lit(1).alias("bucket"), "key").unionByName(nodes.filter("key < 9").select(F.lit(2).alias("bucket"), "key"))
    verify = lambda pairs: pairs.filter("a % 20 = b % 20 and b - a <= 20")  # noqa: E731  chains of three
    got = {r["key"]: r["root"] for r in resolve(ws, nodes, buckets, verify).collect()}
    assert got == {i: i % 20 for i in range(60)}


def test_sketch_bounds(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**16, (50, N.REGISTERS)).astype("<u2")
    b = a.copy()
    for i in range(50):
        change = rng.choice(N.REGISTERS, 2 * i, replace=False)
        b[i, change] = rng.integers(0, 2**16, len(change))
    sa, sb = N.sketches(a).tolist(), N.sketches(b).tolist()
    rows = [(i, band, 10, 10, sa[i], sb[i], None, None) for i in range(50) for band in range(N.BANDS)]
    df = spark.createDataFrame(rows, "i int, band int, x_n int, y_n int, x_sketch array<int>, y_sketch array<int>, x_histogram array<tinyint>, y_histogram array<tinyint>")
    got = df.select("i", "band", N.near("x", "y").alias("near"), N.first("x", "y").alias("first")).collect()
    apart = ((a & 15) != (b & 15)).sum(axis=1)
    for r in got:
        same = ((a[r["i"]] & 15) == (b[r["i"]] & 15)).reshape(N.BANDS, N.ROWS).all(axis=1)
        assert r["near"] == (apart[r["i"]] <= 57) and r["first"] == (same[r["band"]] and not same[: r["band"]].any())
    assert not df.withColumn("x_n", F.lit(7)).filter(N.near("x", "y")).count()


def test_histograms_never_reject_a_link(spark):
    """Pairs around the threshold: whatever is similar passes, most that is not is rejected."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, truth = [], []
    for i in range(80):
        a = rng.choice(vocabulary, 150).tolist()
        b = list(a)
        for _ in range(i // 6):
            b[int(rng.integers(0, 150))] = "other"
        a, b = " ".join(a), " ".join(b)
        side = lambda t: (N.counted(*N.shingles(pa.array([t]))), sum(bag(t).values()))
        (ha, na), (hb, nb) = side(a), side(b)
        rows.append((i, na, nb, [0] * N.BANDS, [0] * N.BANDS, N.histograms(*ha, 1)[0].tolist(), N.histograms(*hb, 1)[0].tolist()))
        truth.append(similar(a, b))
    df = spark.createDataFrame(rows, "i int, x_n int, y_n int, x_sketch array<int>, y_sketch array<int>, x_histogram array<tinyint>, y_histogram array<tinyint>")
    got = {r["i"]: r["near"] for r in df.select("i", N.near("x", "y").alias("near")).collect()}
    assert all(got[i] for i in range(80) if truth[i]) and sum(got[i] for i in range(80) if not truth[i]) < 15


def test_bitmaps_never_reject_a_link(spark):
    """Repeats, and texts whose bitmaps differ in length: whatever is similar passes, most that is not is rejected."""
    rng = np.random.default_rng(6)
    rows, truth = [], []
    for i in range(160):
        n = (100, 127, 128, 700, 3000)[i % 5]
        a = [f"w{k}" for k in rng.integers(0, 10**6, n)] + ["x y"] * (i % 3)
        b = list(a)
        for at in rng.choice(len(b), int(n * i / 4000), replace=False):
            b[at] = "other"
        b += [f"w{k}" for k in rng.integers(0, 10**6, i % 7)]
        a, b = " ".join(a), " ".join(b)
        row = [i]
        for t in (a, b):
            r = N.counted(*N.shingles(pa.array([t])))
            row += [int(r[2].sum()), *[c.to_pylist()[0] for c in N.bitmaps(*r, 1)]]
        rows.append(tuple(row))
        truth.append(similar(a, b))
    side = lambda x: f"{x}_n int, {x}_bits array<long>, {x}_ones long, {x}_half array<long>, {x}_half_ones long"
    df = spark.createDataFrame(rows, f"i int, {side('x')}, {side('y')}")
    got = {r["i"]: r["near"] for r in df.select("i", N.roomy("x", "y").alias("near")).collect()}
    assert any(len(r[2]) != len(r[7]) for r in rows) and 20 < sum(truth) < 140
    assert all(got[i] for i in range(160) if truth[i]) and sum(got[i] for i in range(160) if not truth[i]) < 20


def test_pages_that_are_not_alike_enough_are_no_pairs(spark, monkeypatch):
    """Long pages at similarity 0.72 in common buckets: their number does not show in the pairs that are verified."""
    seen, plain = [], N.resolve

    def counting(ws, nodes, buckets, verify, *more):
        def counted(pairs):
            seen.append(pairs.count())
            return verify(pairs)

        return plain(ws, nodes, buckets, counted, *more)

    monkeypatch.setattr(N, "resolve", counting)
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    common = word(600)
    rows = [(i, " ".join(common + word(115))) for i in range(100)]
    got = {r["doc_id"]: r["class_id"] for r in N.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(100)} and sum(seen) < 100


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame(
        [(None, "one two three four five six", "a"), (3, "one two three four five six", "b"), (3, "one two three four five six", "c"), (None, None, "d")],
        "doc_id long, text string, lang string",
    )
    got = Counter(tuple(r) for r in N.classify(docs).collect())
    assert got == Counter({(None, 3, 3): 1, (3, 3, 3): 2, (None, None, 1): 1})
    assert sorted((r["doc_id"] or 0) for r in N.deduplicate(docs).collect()) == [0, 3]
    assert N.classify(docs.limit(0)).count() == 0 and N.deduplicate(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [58, 107])
def test_links_inside_a_bucket_of_many_components(spark, seed):
    """Pages of much common text: the two that are near share only large buckets, lead none of
    them, and have equal sketches in an earlier band that is no bucket of both."""
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    common = word(400)
    page = lambda n: " ".join(common + word(n))
    rows = [(i, page(200)) for i in range(120)] + [(120, page(42)), (121, page(42))]
    want = brute(rows)
    assert want[121] == 120 and len(set(want)) == 121
    got = {r["doc_id"]: r["class_id"] for r in N.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(want))

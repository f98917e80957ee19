from collections import Counter, defaultdict

import numpy as np
import pytest

from spendlens.llm import mixing, sharding


def test_matrix_is_exact_and_fair():
    m = sharding.matrix([5, 0, 17, 3], 4, seed=1)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 3] and m.sum(axis=0).tolist() == [7, 6, 6, 6]
    means = np.mean([sharding.matrix([10, 30], 2, s)[0, 0] for s in range(800)])
    assert abs(means - 5) < 0.25
    big = [sharding.draw(np.random.default_rng(s), 2 * 10**9, 10**9, 9 * 10**5) for s in range(200)]
    assert abs(np.mean(big) - 6 * 10**5) < 200 and 200 < np.std(big) < 700


@pytest.mark.parametrize("n", [1, 2, 3, 10, 255, 256, 257])
def test_permutation_is_a_bijection(n):
    at = np.arange(n)
    got = sharding.permuted(at, np.full(n, n), np.full(n, 9, dtype=np.uint64))
    assert sorted(got.tolist()) == at.tolist()


def test_shards_are_exact_slots_gapless_rows_whole(spark):
    rows = [(i % 50, None if i % 7 == 0 else "é" * (i % 5), i) for i in range(500)] + [(None, "a", -1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot long").repartition(5)
    out = sharding.shuffle(docs, 7)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "shard", "slot"]
    sizes = Counter(r["shard"] for r in got)
    assert sorted(sizes) == list(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(7):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((a, b) for a, b, _ in rows)
    assigned = {(r["size"], r["text_crc32"]) for r in sharding.assign(docs, 7).collect()}
    assert (8, 0) in assigned and (10, __import__("zlib").crc32("é".encode())) in assigned
    assert sharding.shuffle(docs.limit(0), 7).count() == 0


def shares(sizes, weights=(1, 2, 3), cap=3):
    """Targets by repeated resharing of what is over the limit."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else share[s] for s in names}
        full |= over


def test_targets_copies_and_repeatability(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        source = ["hot", "b", "tiny", None, "é", "empty"][min(int(rng.exponential(1.2)), 5)] if i % 3 else "hot"
        n = 0 if source == "empty" else int(rng.integers(0, 40))
        rows.append((i if i % 10 else 0, source, None if i % 97 == 0 else " ".join(["w"] * n), "x"))
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, target string")
    out = mixing.mix(docs)
    got = out.collect()
    assert len(got) == len(rows) and out.columns[:3] == ["doc_id", "source", "text"]
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = shares(sizes)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 40, s
    again = mixing.mix(docs.repartition(3)).select("doc_id", "source", "text", "copies").collect()
    assert Counter(again) == Counter(r[:3] + (r["copies"],) for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_expected_copies_are_kept(spark):
    rows = [(i, s, "w " * (1 + i % 4)) for s in ("a", "b") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    totals = Counter()
    for seed in range(6):
        for r in mixing.mix(docs, weights=(1, 3), seed=seed).collect():
            totals[r["source"]] += r["copies"]
    assert abs(totals["a"] / 360 - 0.5) < 0.06 and abs(totals["b"] / 360 - 1.5) < 0.06


def test_stored_scans_need_no_copy(spark, tmp_path):
    rows = [(i % 90, f"s{i % 3}", "w " * (i % 7), i) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, source string, text string, other long").repartition(6).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    key = lambda df: Counter(df.select("doc_id", "source", "text", "other", "copies").collect())
    assert key(mixing.mix(docs, stored=True)) == key(mixing.mix(docs))
    dealt = sharding.shuffle(docs, 4, stored=True).collect()
    assert Counter((r["doc_id"], r["source"], r["text"], r["other"]) for r in dealt) == Counter(rows)
    for s in range(4):
        assert sorted(r["slot"] for r in dealt if r["shard"] == s) == list(range(75))

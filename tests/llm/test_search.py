import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from spendlens.llm import search as S

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, top=50):
    """Every document scored for every item; docs are (doc_id, text), items (item_id, text)."""
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, total = len(counted), sum(k for *_, k in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for t, k in df.items()}
    out = Counter()
    for item, text in items:
        found = []
        for i, c, k in counted:
            m = 50 + 50 * k * n // total
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(words(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        for rank, (score, _, i) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:top], 1):
            out[item, rank, i, -score] += 1
    return out


def corpus(n, seed=3):
    rng = np.random.default_rng(seed)
    common = [f"c{k}" for k in range(12)]
    topics = [[f"t{a}x{b}" for b in range(30)] for a in range(6)]
    docs = []
    for i in range(n):
        topic = topics[int(rng.integers(6))]
        k = int(rng.integers(0, 60))
        docs.append((i, " ".join(str(rng.choice(common)) if rng.random() < 0.6 else str(rng.choice(topic)) for _ in range(k))))
    docs += [(n + k, docs[k][1]) for k in range(0, 60, 3)]  # copies: equal scores
    items = [(j, " ".join([*rng.choice(topics[j % 6], 4), *rng.choice(common, 3)])) for j in range(20)]
    return docs, items


def read(df):
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def frames(spark, docs, items, parts=4):
    return (
        spark.createDataFrame([(*d, "x", 1.5) for d in docs], "doc_id long, text string, item_id string, score double").repartition(parts),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def test_search_equals_brute_force_over_many_shards(spark):
    docs, items = corpus(900)
    d, b = frames(spark, docs, items)
    for top in (50, 3):
        assert read(S.search(d, b, top, shard_bytes=20_000, long=20, block=8)) == brute(docs, items, top)
    assert read(S.search(d, b, group_bytes=400, shard_rows=50, long=5, block=2)) == brute(docs, items)  # several groups of items
    assert read(S.search(d, b)) == brute(docs, items)


def build(docs, **sizes):
    counted = [w for w in (words(t) for _, t in docs) if w]
    return S.build(np.array([i for i, _ in docs]), pa.array([t for _, t in docs]), len(counted), sum(map(len, counted)), **sizes)


def items_of(shard, docs, items):
    row, h, _, _ = S.terms_of(pa.array([t for _, t in items]))
    vocabulary = np.unique(h)
    n = len(shard.ids)
    df = dict(zip(shard.vocabulary.tolist(), shard.df.tolist()))
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in vocabulary.tolist()])
    return S.Items(row, h, vocabulary, weight)


def test_blocks_bound_their_documents_and_are_skipped():
    docs, items = corpus(900)
    shard = build(docs, long=20, block=8)
    assert len(shard.of) > 2 * len(shard.long) > 0
    for b in range(len(shard.of)):  # a summary is the maximum over its block, coordinate by coordinate
        dense = np.zeros((shard.cuts[b + 1] - shard.cuts[b], len(shard.vocabulary)), dtype=int)
        for k, doc in enumerate(shard.members[shard.cuts[b] : shard.cuts[b + 1]]):
            at = slice(shard.starts[doc], shard.starts[doc + 1])
            dense[k, shard.terms[at]] = shard.impacts[at]
        assert (dense[:, shard.of[b]] > 0).all() and (dense[:, shard.long].max(0) == shard.summary[b]).all()
    for k, term in enumerate(shard.long):  # the blocks of a list hold each of its documents once
        held = np.concatenate([shard.members[shard.cuts[b] : shard.cuts[b + 1]] for b in np.flatnonzero(shard.of == term)])
        assert sorted(held) == sorted(shard.posted[shard.lists[term] : shard.lists[term + 1]])
    group = items_of(shard, docs, items)
    best = [S.Best(5) for _ in group.numbers]
    opened = S.search_shard(shard, group, best)
    blocks = np.bincount(shard.of, minlength=len(shard.vocabulary))
    offered = sum(int(blocks[np.searchsorted(shard.vocabulary, group.vocabulary[t])].sum()) for t in group.terms)
    assert 0 < opened < 0.6 * offered
    want = brute(docs, items, 5)
    got = Counter((int(i), r, int(d), int(s)) for i, mine in zip(group.numbers, best) for r, (d, s) in enumerate(zip(mine.id, mine.score), 1))
    assert got == want


def test_nulls_ties_repeated_rows_and_empty_tables(spark):
    docs = [(1, None), (2, ""), (3, "alpha beta"), (3, "alpha beta"), (None, "alpha beta"), (4, "Alpha-BETA é1 é1"), (5, "..."), (6, "beta"), (7, "other")]
    items = [(1, "alpha é1"), (1, "beta"), (2, None), (3, "..."), (4, "nowhere"), (None, "other words")]
    d, b = frames(spark, docs, items)
    assert read(S.search(d, b)) == brute(docs, items)
    assert read(S.search(d, b, 2)) == brute(docs, items, 2)
    assert S.search(d.limit(0), b).count() == 0
    assert S.search(d, b.limit(0)).count() == 0


@pytest.mark.parametrize("long", [1, 2, 1000])
def test_lists_may_all_be_long_or_short(long):
    docs, items = corpus(120)
    shard = build(docs, long=long, block=4)
    group = items_of(shard, docs, items)
    best = [S.Best(50) for _ in group.numbers]
    S.search_shard(shard, group, best)
    got = Counter((int(i), r, int(d), int(s)) for i, mine in zip(group.numbers, best) for r, (d, s) in enumerate(zip(mine.id, mine.score), 1))
    assert got == brute(docs, items)


def test_a_very_long_text_is_one_document(spark):
    docs = [(1, "word " * 2_000_000 + "needle"), (2, "needle"), (3, "word other")]
    items = [(1, "needle word")]
    d, b = frames(spark, docs, items)
    assert read(S.search(d, b)) == brute(docs, items)

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spendlens.llm import lm_score as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=120):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        words = rng.choice(["The", "cat", "sat.", "é", "on", "mat", f"rare{i}"], int(rng.integers(0, 30)), p=[0.3, 0.2, 0.15, 0.1, 0.1, 0.1, 0.05])
        rows.append((i, "\n".join(words.tolist()), "x"))
    return rows + [(None, "the cat", "x"), (n, None, "x"), (n + 1, "", "x"), (3, rows[3][1], "x")]


def brute(rows, order=3, prior=L.PRIOR):
    """Scores by dictionaries, one token after the other."""
    key = lambda d: "" if d is None else str(d)
    held = lambda d: zlib.crc32(key(d).encode()) % 7 == 2
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = [WORD.findall(lower(t)) + ["</s>"] for _, t, _ in rows]
    counts = Counter()
    for (d, _, _), w in zip(rows, tokens):
        if not held(d):
            counts.update(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1)
    vocabulary = sum(len(g) == 1 for g in counts)

    def p(h, w):
        if not h:
            return (counts[(w,)] + vocabulary / (vocabulary + 1)) / (total + vocabulary)
        k = prior[len(h) + 1]
        return (counts[h + (w,)] + k * p(h[1:], w)) / (counts[h] + k)

    out = []
    for (d, _, _), w in zip(rows, tokens):
        score = sum(math.log10(p(tuple(w[max(0, i - order + 1) : i]), x)) for i, x in enumerate(w))
        base = sum(math.log10((counts[(x,)] + 1) / (total + vocabulary + 1)) for x in w)
        out.append((d, held(d), len(w), sum(counts[(x,)] > 0 for x in w), total, base, score))
    # weights out of a state sum to one: all words of the vocabulary and one unknown word
    known = [g[0] for g in counts if len(g) == 1]
    for h in [(), ("the",), ("the", "cat"), ("never",)]:
        assert sum(p(h, w) for w in known) + p(h, "?") == pytest.approx(1)
    return out


@pytest.mark.parametrize("least", [L.LEAST, 300])
def test_scores_against_dictionaries(spark, monkeypatch, least):
    """Also with many small blocks and ranges."""
    monkeypatch.setattr(L, "LEAST", least)
    monkeypatch.setattr(L, "CELL", 1)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    got = sorted((tuple(r) for r in L.score(docs).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    want = sorted(brute(rows), key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5]) and g[6] == pytest.approx(w[6])


def test_packing_round_trip():
    rng = np.random.default_rng(2)
    for n in (1, 2, 1000):
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        assert (L.unpack(L.pack(x), n, np.uint64) == x).all()
    assert len(L.unpack(b"", 0, np.uint64)) == 0


def test_no_training_rows_and_empty_table(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = L.score(docs, train=F.lit(False)).collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in rows} == {(3, 0, 0), (1, 0, 0)}
    assert all(r["score"] == 0 for r in rows)
    assert L.score(docs.limit(0)).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("piece", [1, 3, 1000])
def test_the_walk_equals_the_closed_form(order, piece):
    rng = np.random.default_rng(order)
    texts = pa.array([" ".join(rng.choice(list("abcdefg"), int(rng.integers(0, 40)))) for _ in range(60)] + [None, ""])
    train = (np.arange(62) % 3 > 0).astype(np.float64)
    row, h = L.tokens(texts)
    prior = {2: 5.0, 3: 2.0, 4: 1.0}
    counts, places = [], []
    for n in range(1, order + 1):
        _, c, at, place = L.listed(row, h, train, n)
        counts.append(c.astype(np.float64))
        places.append((at, place))
    tokens = int(counts[0].sum())
    vocabulary = int((counts[0] > 0).sum())
    logs, _, _ = L.traverse(row, h, counts, places, tokens, vocabulary, prior)
    machine = L.Automaton(counts, places, tokens, vocabulary, prior)
    assert machine.walk(row, 62, piece) == pytest.approx(np.bincount(row, weights=logs, minlength=62))
    out = machine.keys // machine.words  # weights of the arcs that leave a state, and of its failure arc, leave no more than 1
    assert (np.bincount(out, weights=10**machine.logs) < 1 + 1e-9).all() and (machine.failing <= 0).all()
    empty = L.Automaton([np.zeros(len(c)) for c in counts], places, 0, 0, prior)
    assert empty.walk(row, 62) == pytest.approx(np.zeros(62))

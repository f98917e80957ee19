import hashlib
import re

import numpy as np
import pytest

from spendlens.llm import fingerprint as P

PIECE = re.compile(r"[^\n]{%d,}?[ ]|[^\n]+" % P.PIECE)


def pieces(text):
    return set(PIECE.findall(text or ""))


def jaccard(a, b):
    a, b = pieces(a), pieces(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def say(rng, n):
    return " ".join(rng.choice(["alpha", "béta", "gamma", "delta", "x"], n).tolist())


def texts():
    rng = np.random.default_rng(4)
    out = ["\n".join(say(rng, int(rng.integers(1, 60))) for _ in range(int(rng.integers(0, 12)))) for _ in range(60)]
    out += [None, "", "one", "one", "same line\nsame line\n\nsame line", say(rng, 6000), out[3], "a\nb"]
    return out


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        q = len(t) // 4
        yield d, t, t[: len(t) - q] + after[:q], after


def test_contract_against_sets(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, near_next string").repartition(5)
    got = {r["doc_id"]: r for r in P.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    seen = {}
    for d, text, changed, after in expected(rows):
        r = got[d]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(jaccard(text, changed)) and r["near_next"] == pytest.approx(jaccard(text, after))
        assert seen.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        if changed == text:
            assert r["edited_fingerprint"] == r["fingerprint"]
    assert len({r["fingerprint"] for r in got.values()}) > 55


def test_small_sketches_are_retried_larger(spark, monkeypatch):
    monkeypatch.setattr(P, "CELLS", 1)
    rows = list(enumerate(texts()[:20]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["near_next"] for r in P.fingerprints(docs).collect()}
    assert all(got[d] == pytest.approx(jaccard(t, after)) for d, t, _, after in expected(rows))


def test_peeling_recovers_the_differing_digests(spark):
    rng = np.random.default_rng(9)
    lines = [say(rng, 9) + f" {i}" for i in range(40)]
    rows = [(1, "\n".join(lines), "\n".join(lines[5:] + ["new one"])), (2, "same", "same"), (3, None, "only here")]
    first = spark.createDataFrame([(i, a) for i, a, _ in rows], "id long, text string")
    second = spark.createDataFrame([(i, b) for i, _, b in rows], "id long, text string")
    from pyspark.sql import functions as F

    digest = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in lines + ["new one", "only here"]], "s string").select("s", F.xxhash64("s")).collect()}
    got = {(r["id"], r["digest"], r["side"]) for r in P.differences(first, second, "id", cells=12).collect()}
    assert got == {(1, digest[x], 1) for x in lines[:5]} | {(1, digest["new one"], 2), (3, digest["only here"], 2)}


def test_single_null_repeated_and_empty(spark):
    one = spark.createDataFrame([(None, "a b c d\nline")], "doc_id long, text string")
    r = P.fingerprints(one).collect()[0]
    assert r["near_next"] == 1.0 and r["n_chars"] == 12
    two = spark.createDataFrame([(None, "x"), (5, "y\nz"), (5, "y\nz")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 99, r["near_next"]) for r in P.fingerprints(two).collect())
    assert got == [(5, 0.0), (5, 1.0), (99, 0.0)]
    assert P.fingerprints(two.limit(0)).count() == 0

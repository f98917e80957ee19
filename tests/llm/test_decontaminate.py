import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from spendlens.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    out = []
    for text in docs:
        w, hit, got = words(text), set(), set()
        for item_id, item in items:
            q = words(item)
            n = min(window, len(q))
            for j in range(len(q) - n + 1) if n else ():
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == q[j : j + n]:
                        hit |= set(range(i, i + n))
                        got.add(item_id)
        out.append((len(w), len(hit), sorted(g for g in got if g is not None)))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=25), max_size=6))
def test_suffix_array_sorts_suffixes_within_documents(docs):
    h = np.array([x for d in docs for x in d], dtype=np.uint64)
    end = np.repeat(np.cumsum([len(d) for d in docs] or [0]), [len(d) for d in docs] or [0]).astype(np.int64)
    order = D.suffix_array(h, end) if len(h) else np.empty(0, dtype=int)
    got = [tuple(h[i : end[i]].tolist()) for i in order]
    assert got == sorted(got) and sorted(order.tolist()) == list(range(len(h)))


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    say = lambda n: " ".join(rng.choice(["Ab", "cé", "x1", "d"], n).tolist())
    items = [(i, say(int(rng.integers(1, 12)))) for i in range(12)] + [(None, "Ab d d x1"), (7, say(6)), (50, None), (51, ""), (52, "--")]
    docs = [say(int(rng.integers(0, 60))) for _ in range(40)] + [None, "", "...", items[0][1] + "\n" + items[1][1]]
    docs += [docs[0], "Ab-d,D x1"]
    d = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(docs)], "doc_id long, text string, n_hit string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 60):  # one block of the test set, and several
        rows = D.find(d, b, window=5, benchmark_block=block).orderBy("doc_id").collect()
        assert [(r["n_words"], r["n_hit"], r["items"]) for r in rows] == brute(docs, items, 5)
        assert all(sum(e - s for s, e in r["spans"]) == r["n_hit"] for r in rows)
    assert D.find(d, b, window=5).columns.count("n_hit") == 1


def test_longest_match_and_removal(spark):
    item = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame(
        [(1, "a b " + " ".join(f"w{i}" for i in range(5, 30)) + " c", "en"), (2, "quite clean words", None), (3, None, "en")],
        "doc_id long, text string, lang string",
    )
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    rows = {r["doc_id"]: r for r in D.find(docs, bench).collect()}
    assert rows[1]["longest_match"] == 25 and rows[1]["spans"] == [[2, 27]] and rows[2]["longest_match"] == 0
    kept = D.remove(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {2, 3}
    assert D.digest(D.find(docs, bench.limit(0))).filter("contaminated").count() == 0
    assert D.find(docs.limit(0), bench).count() == 0


def test_the_deepest_interval_of_each_place():
    rng = np.random.default_rng(2)
    lo = rng.integers(0, 90, 200)
    hi = lo + rng.integers(1, 11, 200)
    depth = rng.integers(1, 50, 200)
    want = np.zeros(100, dtype=int)
    for a, b, d in zip(lo, hi, depth):
        want[a:b] = np.maximum(want[a:b], d)
    assert (D._deepest(100, lo, hi, depth) == want).all() and (D._deepest(3, lo[:0], hi[:0], depth[:0]) == 0).all()


def test_one_word_over_and_over_takes_memory_in_proportion():
    import tracemalloc

    text, item = "spam " * 20_000, "spam " * 3_000
    shard = pa.record_batch({"text": [text, "eggs", "spam " * 12]})
    q = D.Queries([(7, item), (8, "spam " * 20), (9, "eggs spam")], D.WINDOW)
    tracemalloc.start()
    got = D.scan(shard, lambda k: q, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["n_hit"] == [20_000, 0, 0] and got["items"] == [[7, 8], [], []]
    assert got["longest_match"][0] == 3_000 and peak < 100e6

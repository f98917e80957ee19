import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from spendlens.llm import divergence as D

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, min_df=3, top=200):
    """The whole audit over dictionaries; rows are (text, lang, source)."""
    rows = [(t or "", la or "", s or "") for t, la, s in rows]
    df, count, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for t, la, s in rows:
        sources[la].add(s)
        df[la].update(set(words(t)))
        count[la, s].update(words(t))
        count[la].update(words(t))
    out = set()
    for la, names in sources.items():
        kept = [t for t, n in df[la].items() if n >= min_df]

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // q
        of, whole = {s: share(count[la, s]) for s in names}, share(count[la])
        for s in names:
            pair = [(-sum(f(of[s][t], of[o][t]) for t in kept), o.encode(), o) for o in names if o != s]
            term = [(-f(of[s][t], whole[t]), t.encode(), t) for t in kept if count[la, s][t] and of[s][t] > whole[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out |= {(la, s, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)}
    return out


def read(df):
    return {tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()}


def random_rows(n, seed=1):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{'abcdefghij'[k % 10] * (1 + k // 10)}" for k in range(60)] + ["Éa", "éa", "Ñandú", "a", "b", "ab"]
    out = []
    for _ in range(n):
        k = int(rng.integers(0, 40))
        text = "".join(str(rng.choice(vocabulary)) + str(rng.choice([" ", "\n", "1", "-", "_"])) for _ in range(k))
        out.append((text, str(rng.choice(["en", "fr"])), "hot" if rng.random() < 0.4 else f"s{int(rng.integers(5))}"))
    return out


def test_pointers_sort_as_words_do():
    text = ["Zeta alpha alphabet ALPHA", "", "abcdefgh abcdefghi abcdefgh", "x" * 40 + " " + "x" * 39 + "y é", "abcdefghabcdefgh abcdefghabcdefgi"]
    raw, bounds = D.W.texts(pa.array(text))
    row, lo, length = D.pointers(raw, bounds)
    data = np.append(D._LOWER[raw], np.zeros(8, dtype=np.uint8))
    order, begins = D.sort_pointers(data, lo, length)
    got = [bytes(data[lo[i] : lo[i] + length[i]]) for i in order]
    assert got == sorted(got) == sorted(w.encode() for t in text for w in words(t))
    assert begins.tolist() == [k == 0 or got[k] != got[k - 1] for k in range(len(got))]


def test_long_division_is_exact():
    count = np.array([[0, 5, 999], [10**15, 7, 3]])
    total = np.array([10**15, 12, 1002])
    got = D.shares(count, total, 4)
    assert got.tolist() == [[1 + 10**9 * (int(c) + 1) // (int(t) + 4) for c, t in zip(line, total)] for line in count]


def test_audit_equals_brute_force(spark):
    rows = random_rows(300)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    assert read(D.audit(docs)) == brute(rows)
    assert read(D.audit(docs, cells=32, slice_bytes=500)) == brute(rows)  # many slices, many blocks
    assert read(D.audit(docs, min_df=20, top_terms=3)) == brute(rows, 20, 3)


def test_nulls_empty_texts_clashing_columns_and_ties(spark):
    rows = [(None, None, None), ("", "en", "s"), ("one two one", "en", "t"), ("One two", "en", "t"), ("two one", "en", None)]
    rows += [("solo", "xx", "only")] * 2 + [("rare words", "yy", "a"), ("other", "yy", "b")] + [("tie eit", None, "u")] * 3
    schema = "text string, lang string, source string"
    docs = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], schema + ", n long, term string, value int")
    got = read(D.audit(docs))
    assert got == brute(rows)
    assert ("yy", "a", "pair", "b", 0, 1) in got and not any(r[0] == "xx" for r in got)
    assert D.audit(spark.createDataFrame([], schema)).count() == 0


def test_a_long_text_is_never_cut(spark):
    rows = [("word " * 400_000 + "last", "en", "a"), ("word", "en", "b"), ("word last last", "en", "c"), ("last", "en", "c")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert read(D.audit(docs, slice_bytes=1000)) == brute(rows)

"""Benchmark decontamination: suffix arrays of the training text, searched by test suffixes.

Documents are taken in blocks of about 4 MB; each block is one shard of the
training text. A shard's words get a suffix array (prefix doubling, sorting
again only what is still tied; a suffix ends with its document). Every test
suffix that can hold a window is binary-searched in every shard, word by word,
which narrows an interval of the array: at window length the interval holds all
places of that window, and where the interval runs empty is the longest match.

The benchmark is not assumed small: it is dealt by hash into blocks of about
``benchmark_block`` bytes, each sent out as a broadcast of its own, and a shard
is searched by one block after the other. Documents are read once and never
shuffled, so a lost executor only repeats its own shards.

Defined results: a null or empty text has no words, no hits and is clean; equal
items and repeated rows count by ``item_id``; items with a null id hit words and
are listed by nothing; an empty benchmark hits nothing; all columns of the
documents pass through, and a column named like a result is replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.llm import words as W
from spendlens.llm.common import small_batches

WINDOW = 13
SHARD_BYTES = 4 << 20
BENCHMARK_BLOCK = 16 << 20

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("longest_match", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.LongType())),
    ]
)


def suffix_array(h: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``h``; suffix i is h[i:end[i]], a prefix sorts first."""
    n = len(h)
    order = np.argsort(h, kind="stable")
    spot = np.arange(n)
    first = np.ones(n, dtype=bool)
    first[1:] = h[order[1:]] != h[order[:-1]]
    start = np.maximum.accumulate(np.where(first, spot, 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = start
    lone = first & np.append(first[1:], True)
    active = spot[~lone]
    k = 1
    while len(active):
        sfx = order[active]
        nxt = sfx + k
        tail = np.where(nxt < end[sfx], rank[np.minimum(nxt, n - 1)] + 1, 0)
        key = rank[sfx] * (n + 2) + tail
        by = np.argsort(key, kind="stable")
        sfx, key, tail = sfx[by], key[by], tail[by]
        order[active] = sfx
        first = np.ones(len(key), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        rank[sfx] = np.maximum.accumulate(np.where(first, active, 0))
        lone = first & np.append(first[1:], True)
        active = active[~lone & (tail > 0)]
        k *= 2
    return order


def _narrow(h, end, order, lo, hi, depth, target):
    """Cuts each interval to the suffixes whose word at ``depth`` is ``target``."""

    def bisect(left, right, beyond):
        left, right = left.copy(), right.copy()
        open_ = np.flatnonzero(left < right)
        while len(open_):
            mid = (left[open_] + right[open_]) >> 1
            at = order[mid] + depth
            word = np.where(at < end[order[mid]], h[np.minimum(at, len(h) - 1)], 0)
            t = target[open_]
            low = (word <= t) if beyond else (word < t)
            left[open_[low]] = mid[low] + 1
            right[open_[~low]] = mid[~low]
            open_ = open_[left[open_] < right[open_]]
        return left

    a = bisect(lo, hi, False)
    return a, bisect(a, hi, True)


class Queries:
    """Test suffixes that can hold a window: the words of all items, ends, owners."""

    def __init__(self, items: list[tuple[int | None, str]], window: int):
        column = pa.array([t or "" for _, t in items], type=pa.large_string())
        row, _, _, self.h = W.hashed(*W.texts(column), W.ALNUM)
        self.ids = [i for i, _ in items]
        n = len(self.h)
        per_item = np.bincount(row, minlength=len(items)) if n else np.zeros(len(items), dtype=np.int64)
        stop = np.cumsum(per_item)
        self.end = stop[row] if n else np.empty(0, dtype=np.int64)
        begin = (stop - per_item)[row] if n else self.end
        at = np.arange(n)
        whole = (per_item[row] < window) & (at == begin) if n else np.empty(0, dtype=bool)
        usable = (self.end - at >= window) | whole
        self.start = at[usable]
        self.row = row[usable]
        self.need = np.minimum(window, (self.end - at)[usable])
        self.length = (self.end - at)[usable]


def search(h, end, order, q: Queries):
    """Yields (suffix index, first place, last place + 1) of each window found, then the longest lengths.

    Returns windows as three arrays and, for the same suffixes, the longest
    match and its interval.
    """
    alive = np.arange(len(q.start))
    sorted_h = h[order]
    target = q.h[q.start]
    lo = np.searchsorted(sorted_h, target, "left")
    hi = np.searchsorted(sorted_h, target, "right")
    keep = lo < hi
    alive, lo, hi = alive[keep], lo[keep], hi[keep]
    found, best = [], []
    depth = 1
    while len(alive):
        done = q.need[alive] == depth
        if done.any():
            found.append((alive[done], lo[done], hi[done]))
        reached = q.need[alive] <= depth
        more = q.length[alive] > depth
        if (reached & ~more).any():
            s = reached & ~more
            best.append((alive[s], np.full(s.sum(), depth), lo[s], hi[s]))
        was, wlo, whi = alive[more], lo[more], hi[more]
        lo, hi = _narrow(h, end, order, wlo, whi, depth, q.h[q.start[was] + depth])
        keep = lo < hi
        gone = ~keep & (q.need[was] <= depth)
        if gone.any():
            best.append((was[gone], np.full(gone.sum(), depth), wlo[gone], whi[gone]))
        alive, lo, hi = was[keep], lo[keep], hi[keep]
        depth += 1
    return found, best


def _places(order, lo, hi):
    """All array entries of many intervals, and which interval each is of."""
    size = hi - lo
    owner = np.repeat(np.arange(len(lo)), size)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return order[lo[owner] + inside], owner


def _distinct(lo, hi):
    """Distinct intervals and which of them each given one is."""
    both, which = np.unique(np.stack([lo, hi], axis=1), axis=0, return_inverse=True)
    return both[:, 0], both[:, 1], which.ravel()


def _deepest(n: int, lo, hi, depth):
    """For each of ``n`` places the largest depth of the intervals that hold it.

    An interval is two halves of a power of two in length, which are handed down from
    long to short: n log n steps, however the intervals overlap.
    """
    if not len(lo):
        return np.zeros(n, dtype=np.int64)
    level = np.floor(np.log2(hi - lo)).astype(np.int64)
    by_level = [np.zeros(n, dtype=np.int64) for _ in range(int(level.max()) + 1)]
    for k in np.unique(level).tolist():
        own = level == k
        np.maximum.at(by_level[k], lo[own], depth[own])
        np.maximum.at(by_level[k], hi[own] - (1 << k), depth[own])
    for k in range(len(by_level) - 1, 0, -1):
        half = 1 << (k - 1)
        np.maximum(by_level[k - 1], by_level[k], out=by_level[k - 1])
        np.maximum(by_level[k - 1][half:], by_level[k][:-half], out=by_level[k - 1][half:])
    return by_level[0]


def _matched(row, order, lo, hi, which, item, n_items: int, most: int = 1 << 22):
    """Distinct documents x items of intervals of one depth, in blocks of about ``most`` pairs at a time.

    Equal windows are one interval, and intervals of one depth do not overlap: their
    places are no more than the shard's words. ``which`` and ``item`` are the test windows'.
    """
    at, owner = _places(order, lo, hi)
    docs = np.unique(owner * (int(row.max()) + 1) + row[at])
    doc_of, in_doc = np.divmod(docs, int(row.max()) + 1)
    asked = np.unique(which * n_items + item)
    item_of, in_item = np.divmod(asked, n_items)
    first = np.searchsorted(item_of, np.arange(len(lo) + 1))
    times = np.diff(first)[doc_of]  # items that meet each document
    stop = np.cumsum(times)
    out, a = np.empty(0, dtype=np.int64), 0
    while a < len(docs):
        b = max(a + 1, int(np.searchsorted(stop, (stop[a - 1] if a else 0) + most, side="right")))
        n = times[a:b]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pairs = np.repeat(in_doc[a:b], n) * n_items + in_item[np.repeat(first[doc_of[a:b]], n) + inside]
        out = np.unique(np.append(out, pairs))
        a = b
    return at, out


def scan(shard: pa.RecordBatch, load, n_blocks: int) -> dict[str, list]:
    """Results of one shard; ``load(k)`` gives the k-th block of test suffixes."""
    rows = shard.num_rows
    row, _, _, h = W.hashed(*W.texts(shard.column(shard.schema.get_field_index("text"))), W.ALNUM)
    per = np.bincount(row, minlength=rows)
    stop = np.cumsum(per)
    longest = np.zeros(rows, dtype=np.int64)
    cover = np.zeros(len(h) + 1, dtype=np.int64)
    items: dict[int, set] = {}
    if len(h):
        end = stop[row]
        order = suffix_array(h, end)
        for k in range(n_blocks):
            q = load(k)
            found, best = search(h, end, order, q)
            for suffix, lo, hi in found:  # the windows of one length
                lo, hi, which = _distinct(lo, hi)
                at, pairs = _matched(row, order, lo, hi, which, q.row[suffix], len(q.ids))
                np.add.at(cover, at, 1)
                np.add.at(cover, at + q.need[suffix[0]], -1)
                for doc, item in zip((pairs // len(q.ids)).tolist(), (pairs % len(q.ids)).tolist()):
                    got = items.setdefault(doc, set())
                    if q.ids[item] is not None:
                        got.add(q.ids[item])
            if best:
                depth = np.concatenate([d for _, d, _, _ in best])
                lo, hi = (np.concatenate([b[i] for b in best]) for i in (2, 3))
                np.maximum.at(longest, row[order], _deepest(len(h), lo, hi, depth))
    hit = np.cumsum(cover[:-1]) > 0
    n_hit = np.bincount(row[hit], minlength=rows) if len(h) else per
    spans: list = [[] for _ in range(rows)]
    for doc in np.flatnonzero(n_hit).tolist():
        a = stop[doc] - per[doc]
        mark = np.diff(np.concatenate(([0], hit[a : stop[doc]].astype(np.int8), [0])))
        spans[doc] = np.stack([np.flatnonzero(mark == 1), np.flatnonzero(mark == -1)], 1).tolist()
    return {
        "n_words": per.tolist(),
        "n_hit": n_hit.tolist(),
        "longest_match": longest.tolist(),
        "spans": spans,
        "items": [sorted(items.get(i, ())) for i in range(rows)],
    }


def _benchmark_blocks(benchmark: DataFrame, most: int):
    """The test set as broadcasts of about ``most`` bytes each, dealt by hash of the item."""
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-int(size) // most))
    deal = items.withColumn("__block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    sc = benchmark.sparkSession.sparkContext
    out = []
    for k in range(n):
        part = deal.filter(F.col("__block") == k).orderBy("item_id", "text").collect()
        out.append(sc.broadcast([(r["item_id"], r["text"]) for r in part]))
    return out


def find(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, benchmark_block: int = BENCHMARK_BLOCK, keep: list[str] | None = None) -> DataFrame:
    """Adds words, hit words, longest match, hit spans [from, to) and items to each document.

    ``keep`` names the columns to return beside the results (default: all).
    """
    small_batches(documents.sparkSession)
    sent = _benchmark_blocks(benchmark, benchmark_block)
    names = [c for c in (documents.columns if keep is None else keep) if c not in RESULT.names]
    kept = [documents.schema[c] for c in names]
    read = documents.select(*dict.fromkeys([*names, "text"]))
    schema = T.StructType([*kept, *RESULT.fields])

    def run(batches):
        ready: dict = {}

        def load(k):
            if k not in ready:
                ready.clear()  # one block of the test set in memory at a time
                ready[k] = Queries(sent[k].value, window)
            return ready[k]

        results = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64())]
        for shard in W.blocks(batches, most=SHARD_BYTES):
            got = scan(shard, load, len(sent))
            arrays = [shard.column(shard.schema.get_field_index(c)) for c in names]
            arrays += [pa.array(got[c], type=t) for c, t in zip(RESULT.names, results)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *RESULT.names])

    return read.mapInArrow(run, schema)


def contaminated():
    """Hit words make up at least a twentieth of the document."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def remove(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    return find(documents, benchmark, **options).filter(~contaminated()).select(*documents.columns)


def digest(found: DataFrame) -> DataFrame:
    """Item list as count and SHA-256, and the verdict."""
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

#: The digest by comparing all windows as texts.
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
),
m AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, win)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
found AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN found ON d.doc_id = found.doc_id
"""

"""Source divergence audit: how each source's use of words departs from its language's and from other sources'.

Method. Texts are taken in slices of Arrow buffers. A pointer to each word's first
byte is made, and the pointers of a slice are sorted by the words they point at: a
multikey quicksort whose character is eight bytes, so that a pass sorts the pointers
of every run of equal beginnings by the next eight bytes, and only runs that are
longer than one and have not ended go on to the next pass. A run of equal words
yields, for each (lang, source) of the slice, its occurrences and its documents.
Spark adds up the slices' runs: combined before the shuffle by (lang, source, term),
so that a word of every document is one row for each task, then gathered by
(lang, term), which has one entry for each source at most.

Measure. Each language keeps its terms in at least ``min_df`` documents, V of them.
A group's, or the language's, share of a term is p = 1 + floor(10^9 (count + 1) /
(N + V)), N being its count of all kept terms. The departure of p from q is
floor((p - q)^2 / q), in integers. The sum over all kept terms compares two sources
(part ``pair``), one term's value a source with its language (part ``term``).

Pairs of sources are what is asked for, so there are S^2 rows a language; the work
behind them is done on blocks of terms x sources of bounded size.

Defined results: null text, lang and source are ''; a group without words takes part
with counts of zero; a language without kept terms has pairs of value 0 and no terms;
repeated rows count as often as they stand there; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendlens.llm import words as W
from spendlens.llm.common import Workspace

MIN_DF = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
SLICE_BYTES = 8 << 20
#: Terms x sources of one block of the comparison of sources.
CELLS = 1 << 20
#: Words of letters and everything beyond ASCII.
LETTERS = W.byte_table([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])[0]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pointers(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of every word of texts laid end to end."""
    n = len(data)
    mask = LETTERS[data]
    begins, ends = mask.copy(), mask.copy()
    begins[1:] &= ~mask[:-1]
    ends[:-1] &= ~mask[1:]
    edges = bounds[(bounds > 0) & (bounds < n)]
    begins[edges] = mask[edges]
    ends[edges - 1] = mask[edges - 1]
    lo = np.flatnonzero(begins)
    return np.searchsorted(bounds, lo, side="right") - 1, lo, np.flatnonzero(ends) + 1 - lo


def _characters(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes of each word as one number, zeros after its end; ``data`` has eight bytes to spare."""
    raw = np.lib.stride_tricks.sliding_window_view(data, 8)[at]
    number = np.ascontiguousarray(raw).view(">u8").ravel().astype(np.uint64)
    beyond = np.clip(8 - left, 0, 7).astype(np.uint64) * np.uint64(8)
    return np.where(left > 0, number >> beyond << beyond, np.uint64(0))


def sort_pointers(data: np.ndarray, lo: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pointers by their words, and whether each begins a run of equal words.

    ``data`` is in lower case, with eight bytes to spare. No word holds a zero byte,
    so that zeros after its end sort it before longer ones.
    """
    n = len(lo)
    order, begins = np.arange(n), np.zeros(n, dtype=bool)
    begins[:1] = True
    open_, depth = np.arange(n), 0  # places in ``order`` whose run is not settled
    while len(open_):
        who = order[open_]
        char = _characters(data, lo[who] + depth, length[who] - depth)
        run = np.cumsum(begins[open_])
        by = np.argsort(char) if run[-1] == 1 else np.lexsort((char, run))
        who, char = who[by], char[by]
        order[open_] = who
        new = np.ones(len(open_), dtype=bool)
        new[1:] = (run[1:] != run[:-1]) | (char[1:] != char[:-1])
        begins[open_] = new
        depth += 8
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(new)))
        goes_on = (size > 1) & (np.maximum.reduceat(length[who], at) > depth)
        open_ = open_[np.repeat(goes_on, size)]
    return order, begins


def runs(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of one slice: the run's term, a row of its (lang, source), occurrences and documents there."""
    raw, bounds = W.texts(batch.column(batch.schema.get_field_index("text")))
    row, lo, length = pointers(raw, bounds)
    group = _groups(batch)
    data = np.zeros(len(raw) + 8, dtype=np.uint8)
    data[: len(raw)] = _LOWER[raw]
    order, begins = sort_pointers(data, lo, length)
    run = np.cumsum(begins) - 1
    doc = row[order]
    by = np.lexsort((doc, group[doc], run))
    run, doc = run[by], doc[by]
    of = group[doc]
    first = np.ones(len(run), dtype=bool)
    first[1:] = (run[1:] != run[:-1]) | (of[1:] != of[:-1])
    fresh = first.copy()
    fresh[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(first)
    n = np.diff(np.append(at, len(run)))
    df = np.add.reduceat(fresh.astype(np.int64), at) if len(at) else n
    heads = order[begins]
    size = length[heads]
    stop = np.append(0, np.cumsum(size))
    inside = np.repeat(lo[heads] - stop[:-1], size) + np.arange(stop[-1])
    words = pa.Array.from_buffers(pa.large_string(), len(heads), [None, pa.py_buffer(stop.astype(np.int64)), pa.py_buffer(data[inside])])
    return words.take(pa.array(run[at])).cast(pa.string()), doc[at], n, df


def _groups(batch: pa.RecordBatch) -> np.ndarray:
    """A number for each row that tells its (lang, source)."""
    parts = [np.asarray(pc.dictionary_encode(batch.column(batch.schema.get_field_index(c))).indices).astype(np.int64) for c in ("lang", "source")]
    return parts[0] * (int(parts[1].max(initial=0)) + 1) + parts[1]


def plain(documents: DataFrame) -> DataFrame:
    """text, lang and source with '' for null."""
    return documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def term_counts(documents: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``lang, source, term, n, df``: occurrences and documents of every term in every group."""

    def run(batches):
        for block in W.blocks(batches, most=slice_bytes, rows=100_000):
            term, doc, n, df = runs(block)
            at = pa.array(doc)
            lang, source = (block.column(block.schema.get_field_index(c)).take(at) for c in ("lang", "source"))
            whole = pa.RecordBatch.from_arrays([lang, source, term, pa.array(n), pa.array(df)], names=["lang", "source", "term", "n", "df"])
            for a in range(0, whole.num_rows, 50_000):
                yield whole.slice(a, 50_000)

    found = plain(documents).mapInArrow(run, "lang string, source string, term string, n long, df long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (count + 1) / (total + kept)), exact for every count."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.floor(F.call_function("div", wide(count + 1) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + kept)))


def shares(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """``share`` of a matrix by long division, three decimals at a time: no product leaves 64 bits."""
    whole = total + kept
    rest, out = count + 1, np.zeros_like(count)
    for _ in range(3):
        rest = rest * 1000
        digit = rest // whole
        rest -= digit * whole
        out = out * 1000 + digit
    return out + 1


def departure(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _compared(batches):
    """Sums over a block's terms for every two sources of its language."""
    for batch in batches:
        for lang, sources, totals, kept, entries in zip(*(batch.column(i) for i in range(5))):
            names = sources.values
            per_term = entries.values
            flat = per_term.flatten()
            at = np.asarray(pc.index_in(flat.field("source"), value_set=names))
            size = np.asarray(pc.list_value_length(per_term))
            count = np.zeros((len(size), len(names)), dtype=np.int64)
            count[np.repeat(np.arange(len(size)), size), at] = np.asarray(flat.field("n"))
            p = shares(count, np.asarray(totals.values), kept.as_py())
            s = len(names)
            sums = np.stack([((p[:, k : k + 1] - p) ** 2 // p).sum(axis=0) for k in range(s)])
            a, b = np.divmod(np.arange(s * s), s)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang.as_py()] * (s * s), pa.string()), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(sums.ravel())],
                names=["lang", "source", "item", "value"],
            ).filter(pa.array(a != b))


def audit(documents: DataFrame, min_df: int = MIN_DF, top_terms: int = TOP_TERMS, cells: int = CELLS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``lang, source, part, item, value, rank``; see the module's text for the two parts."""
    ws = Workspace(documents.sparkSession, "divergence", batches=True)
    counts = term_counts(documents, slice_bytes)
    terms = ws.settle(
        counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("entries"))
        .filter(F.col("df") >= min_df).drop("df"),
        "terms",
    )
    each = terms.select("lang", "term", F.col("n").alias("all"), F.explode("entries").alias("e")).select("lang", "term", "all", "e.source", "e.n")
    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"))
    found = each.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = ws.settle(
        plain(documents.select("lang", "source", F.lit("").alias("text"))).select("lang", "source").distinct()
        .join(found, ["lang", "source"], "left").join(kept, "lang", "left")
        .select("lang", "source", zero("total"), zero("kept"), zero("lang_total")),
        "groups",
    )

    by_lang = groups.groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("source", "total"))).alias("of"), F.max("kept").alias("kept")
    ).select("lang", F.col("of.source").alias("sources"), F.col("of.total").alias("totals"), "kept")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("kept") * F.size("sources") / F.lit(cells)))
    dealt = (
        terms.select("lang", "term", "entries").join(by_lang.select("lang", blocks.alias("blocks")), "lang")
        .groupBy("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")).agg(F.collect_list("entries").alias("entries"))
    )
    sums = (
        dealt.join(by_lang, "lang").select("lang", "sources", "totals", "kept", "entries")
        .mapInArrow(_compared, "lang string, source string, item string, value long")
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    )
    every = by_lang.select("lang", F.explode("sources").alias("source"), "sources").select("lang", "source", F.explode("sources").alias("item")).filter("source <> item")
    pairs = every.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", zero("value"))

    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("all"), F.col("lang_total"), F.col("kept"))
    over = each.join(groups, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q")).filter("p > q")
    single = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), departure(F.col("p"), F.col("q")).alias("value"))

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    ranked = [f.select("*", place) for f in (pairs, single)]
    return ranked[0].unionByName(ranked[1].filter(F.col("rank") <= top_terms))


#: The audit by counting words in SQL.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM d
),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DF}),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept ON w.lang = kept.lang AND w.term = kept.term GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY 1),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
g AS (
  SELECT o.lang, o.source, coalesce(t.total, 0) AS total, coalesce(l.v, 0) AS v, l.total AS lang_total
  FROM (SELECT DISTINCT lang, source FROM d) o LEFT JOIN t ON t.lang = o.lang AND t.source = o.source LEFT JOIN l ON l.lang = o.lang
),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v) AS p,
    1 + ({SCALE}::HUGEINT * (kept.n + 1)) // (g.lang_total + g.v) AS q
  FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u
) WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""

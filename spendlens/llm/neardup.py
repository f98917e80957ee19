"""Near duplicates by BagMinHash signatures, bands and exact multiset overlap.

A text is the multiset of its five-word shingles (a shorter text: one shingle of
all its words). Two texts are linked when the weighted Jaccard similarity of the
multisets, sum of minima over sum of maxima, is ``SIMILARITY`` or more; linked
documents form classes.

Signature. A shingle's weight is its count, cut into the blocks (0, 1], (1, 2],
(2, 4], (4, 8] ...; each block of each shingle is a Poisson process in time with
the block's length as rate, seeded by the shingle. Points fall on a random
register and on a random weight of the block, and those above the shingle's
weight are thinned out. A register keeps its earliest point, so two registers
agree with probability equal to the weighted Jaccard similarity. Only points up
to a time at which all registers are expected full are made, about m log m a
text whatever its length; texts with an empty register go on to twice the time.

Candidates. Equal multisets are one node. Bands of rows are buckets; a bucket
of one node is dropped. How the nodes of a bucket meet without all pairs is told
in ``components.resolve``: leaders first, further ones only where a bucket holds
different components. Part of that join is a cheap test on sizes, on four bits
of each register, four deviations below the threshold, and on histograms and bitmaps of
the shingles; what passes is decided by the exact overlap of the texts. No bucket is cut and no link lost by size.

With bands of 6 rows, 32 of them, a pair at similarity 0.8 shares no bucket
with probability 6e-5 (at 0.9: 1e-11) and fails the cheap test with 3e-5.

Defined results: texts without words are linked when they are equal (null is
the empty text); repeated rows are members of the same class; a class is named
by its smallest doc_id (null when it has none); an empty table gives no rows;
other columns pass through ``deduplicate`` untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.llm import words as W
from spendlens.llm.common import Workspace, aside, numbered
from spendlens.llm.components import resolve

SHINGLE = 5
SIMILARITY = (4, 5)  # as a fraction: 0.8
ROWS, BANDS = 6, 32
REGISTERS = ROWS * BANDS
CLASSES = 256
BITMAP_WORDS = 256
BITMAP = {"bits": T.ArrayType(T.LongType()), "ones": T.LongType(), "half": T.ArrayType(T.LongType()), "half_ones": T.LongType()}
U = W.U


def shingles(column) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the shingles of all texts, repeats included."""
    row, _, _, h = W.hashed(*W.texts(column), W.ALNUM)
    r, s = W.grams(row, h, SHINGLE)
    per = np.bincount(row, minlength=len(column))
    short = np.flatnonzero((per > 0) & (per < SHINGLE))
    if len(short):
        stop = np.cumsum(per)
        placed = lambda w: W.mix(w + U(7) * np.arange(1, len(w) + 1, dtype=U))
        extra = [W.mix(np.bitwise_xor.reduce(placed(h[stop[i] - per[i] : stop[i]]), keepdims=True)) for i in short]
        r, s = np.append(r, short), np.append(s, np.concatenate(extra))
        by = np.argsort(r, kind="stable")
        r, s = r[by], s[by]
    return r, s


def counted(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of each multiset, ordered by row and hash."""
    by = np.lexsort((h, row))
    row, h = row[by], h[by]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(first)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def signatures(row: np.ndarray, h: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
    """Registers of all multisets: ``rows`` x ``REGISTERS`` 16-bit names of the earliest points."""
    levels = np.ceil(np.log2(count.astype(np.float64))).astype(np.int64) + 1 if len(count) else count
    of = np.repeat(np.arange(len(h)), levels)
    level = np.arange(len(of)) - np.repeat(np.cumsum(levels) - levels, levels)
    base = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    rate = np.maximum(base, 1.0)
    fits = np.minimum((count[of] - base) / rate, 1.0)  # share of the block below the weight
    doc = row[of]
    seed = W.mix(h[of] + U(0xA24BAED4963EE407) * (level + 1).astype(U))
    total = np.bincount(doc, weights=rate * fits, minlength=rows)
    out = np.full(rows * REGISTERS, ~U(0), dtype=U)
    todo = total > 0
    span = np.log(REGISTERS) + 3.0
    while todo.any():
        until = np.zeros(rows)
        until[todo] = REGISTERS * span / total[todo]
        live = np.flatnonzero(todo[doc])
        time, k = np.zeros(len(live)), 0
        while len(live):
            k += 1
            point = W.mix(seed[live] + U(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log(((point >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) * REGISTERS / (rate[live] * REGISTERS)
            near = time <= until[doc[live]]
            live, time, point = live[near], time[near], point[near]
            more = W.mix(point ^ U(0xD1B54A32D192ED03))
            kept = (more >> U(40)).astype(np.float64) * 2.0**-24 < fits[live]
            at = doc[live[kept]] * REGISTERS + ((more[kept] & U(0xFFFFFF)) % U(REGISTERS)).astype(np.int64)
            name = time[kept].astype(np.float32).view(np.uint32).astype(U) << U(32) | (point[kept] & U(0xFFFFFFFF))
            np.minimum.at(out, at, name)
        full = (out.reshape(rows, REGISTERS) != ~U(0)).all(axis=1)
        todo &= ~full
        span *= 2
    return (W.mix(out) & U(0xFFFF)).astype("<u2").reshape(rows, REGISTERS)


def describe(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    """Node key, number of shingles and signature of each text (null signature: no words)."""
    column = batch.column(batch.schema.get_field_index("text"))
    row, h, count = counted(*shingles(column))
    rows = batch.num_rows
    n = np.bincount(row, weights=count, minlength=rows).astype(np.int64)
    edge = np.searchsorted(row, np.arange(rows + 1))
    keys = []
    for i in range(rows):
        if n[i]:
            a, b = edge[i], edge[i + 1]
            body = b"w" + h[a:b].tobytes() + count[a:b].tobytes()
        else:
            body = b"t" + (column[i].as_py() or "").encode()
        keys.append(hashlib.blake2b(body, digest_size=16).digest())
    signed = signatures(row, h, count, rows)
    return {
        "__key": pa.array(keys, pa.binary()),
        "__n": pa.array(n),
        "__sig": pa.array([signed[i].tobytes() if n[i] else None for i in range(rows)], pa.binary()),
        "__histogram": pa.array(histograms(row, h, count, rows), pa.list_(pa.int8())),
        "__sketch": pa.array(list(sketches(signed)), pa.list_(pa.int32())),
    }


def overlap(a, b) -> np.ndarray:
    """Sum of minima of the multisets of two columns of texts, row by row."""
    ra, ha, ca = counted(*shingles(a))
    rb, hb, cb = counted(*shingles(b))
    row, h = np.concatenate([ra, rb]), np.concatenate([ha, hb])
    count = np.concatenate([ca, cb])
    by = np.lexsort((h, row))
    row, h, count = row[by], h[by], count[by]
    twin = np.flatnonzero((row[1:] == row[:-1]) & (h[1:] == h[:-1])) if len(h) else by
    least = np.minimum(count[twin], count[twin + 1]) if len(twin) else count[:0]
    return np.bincount(row[twin] if len(twin) else row[:0], weights=least, minlength=len(a)).astype(np.int64)


def sketches(signed: np.ndarray) -> np.ndarray:
    """Four bits of each register, the six of a band to a number: rows x BANDS."""
    nibbles = (signed & 0xF).astype(np.int32).reshape(len(signed), BANDS, ROWS)
    return (nibbles << (4 * np.arange(ROWS, dtype=np.int32))).sum(axis=2, dtype=np.int32)


def histograms(row: np.ndarray, h: np.ndarray, count: np.ndarray, rows: int) -> list:
    """Shingles by hash in ``CLASSES`` classes; None for texts of too many shingles."""
    n = np.bincount(row, weights=count, minlength=rows)
    at = row * CLASSES + (W.mix(h) % U(CLASSES)).astype(np.int64)
    table = np.bincount(at, weights=count, minlength=rows * CLASSES).reshape(rows, CLASSES)
    fits = (n > 0) & (n <= 20 * CLASSES) & (table.max(axis=1) < 128)
    return [t if ok else None for t, ok in zip(table.astype(np.int8), fits)]


def bitmaps(row: np.ndarray, h: np.ndarray, count: np.ndarray, rows: int) -> list[pa.Array]:
    """Shingles as bits, each repeat of one its own: ``bits, ones, half, half_ones`` of each row.

    A row gets eight to sixteen bits a shingle, up to ``BITMAP_WORDS`` words, a power of two;
    ``half`` is what the same shingles give in half the bits.
    """
    n = np.bincount(row, weights=count, minlength=rows).astype(np.int64)
    level = np.ceil(np.log2(np.clip(n / 8.0, 2, BITMAP_WORDS))).astype(np.int64)  # words, as a power of two
    of = np.repeat(np.arange(len(h)), count)
    again = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    item = W.mix(h[of] + U(0x9FB21C651E98DF25) * again.astype(U))
    out = []
    for size in (level, level - 1):
        ends = np.append(0, np.cumsum(1 << size))
        at = (item >> (U(58) - size[row[of]].astype(U))).astype(np.int64)
        table = np.zeros(64 * ends[-1], dtype=np.uint8)
        table[64 * ends[row[of]] + at] = 1
        words = np.packbits(table, bitorder="little").view("<i8")
        ones = np.add.reduceat(table, 64 * ends[:-1], dtype=np.int64) if rows else n
        out += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words)), pa.array(ones)]
    return out


def roomy(x: str, y: str) -> Column:
    """Whether the bitmaps of two nodes allow the similarity; every link passes.

    A bit that one text has and the other lacks is at least one shingle not shared. Texts
    whose bitmaps differ in length are compared in the length of the shorter one.
    """

    def room(bits: str, ones: str, other: str, other_ones: str) -> str:
        both = f"aggregate(zip_with({x}_{bits}, {y}_{other}, (a, b) -> bit_count(a & b)), 0L, (n, c) -> n + c)"
        most = f"(least({x}_n - {x}_{ones}, {y}_n - {y}_{other_ones}) + {both})"
        return f"{most} * {sum(SIMILARITY)} >= ({x}_n + {y}_n) * {SIMILARITY[0]}"

    whole, left, right = room("bits", "ones", "bits", "ones"), room("half", "half_ones", "bits", "ones"), room("bits", "ones", "half", "half_ones")
    return F.expr(
        f"CASE WHEN size({x}_bits) = size({y}_bits) THEN {whole} WHEN size({x}_half) = size({y}_bits) THEN {left}"
        f" WHEN size({x}_bits) = size({y}_half) THEN {right} ELSE true END"
    )


def near(x: str, y: str) -> Column:
    """Whether sizes, sketches and histograms of two nodes allow the similarity.

    Sketches may be four deviations below it. Two texts share no more shingles
    than the smaller counts of all classes, so histograms reject without error.
    """
    share = SIMILARITY[0] / SIMILARITY[1]
    differ = (1 - share) * 15 / 16  # four bits agree by chance, too
    most = int(REGISTERS * differ + 4 * (REGISTERS * differ * (1 - differ)) ** 0.5)
    # one bit for each register whose four bits differ
    spread = f"transform(zip_with({x}_sketch, {y}_sketch, (a, b) -> a ^ b), d -> d | shiftright(d, 1) | shiftright(d, 2) | shiftright(d, 3))"
    apart = f"aggregate({spread}, 0, (n, d) -> n + bit_count(d & {int('1' * ROWS, 16)}))"
    both = f"aggregate(zip_with({x}_histogram, {y}_histogram, (a, b) -> int(least(a, b))), 0, (n, c) -> n + c)"
    room = f"coalesce({both} * {sum(SIMILARITY)} >= ({x}_n + {y}_n) * {SIMILARITY[0]}, true)"
    return F.expr(f"least({x}_n, {y}_n) * {SIMILARITY[1]} >= greatest({x}_n, {y}_n) * {SIMILARITY[0]} AND {apart} <= {most} AND {room}")


def first(x: str, y: str, bands: str = "sketch") -> Column:
    """The bucket's band is the first in which the two nodes have equal ``bands``.

    ``link`` takes the buckets themselves: sketches can agree in an earlier band
    that is no bucket of both, and the pair would be made nowhere.
    """
    return F.expr(f"array_position(zip_with({x}_{bands}, {y}_{bands}, (a, b) -> a = b), true) = band + 1")


def _overlapping(batches):
    """Keeps pairs whose exact similarity is high enough."""
    for batch in W.blocks(W.blocks(batches, "ta"), "tb"):
        a, b = (batch.column(batch.schema.get_field_index(c)) for c in ("ta", "tb"))
        na, nb = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("na", "nb"))
        both = overlap(a, b)
        linked = both * SIMILARITY[1] >= (na + nb - both) * SIMILARITY[0]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked))


def signed(ws: Workspace, documents: DataFrame, stored: bool) -> tuple[DataFrame, DataFrame]:
    """The documents with a row number, and row number, doc_id and description of each, stored."""
    source = numbered(ws, documents, stored)
    schema = (
        "__rid long, doc_id long, __key binary, __n long, __sig binary, __histogram array<tinyint>, __sketch array<int>"
    )

    def run(batches):
        for block in W.blocks(batches):
            got = describe(block)
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), *got.values()], names=["__rid", "doc_id", *got])

    read = source.select("__rid", F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source, ws.settle(read.mapInArrow(run, schema), "signed")


def link(ws: Workspace, source: DataFrame, rows: DataFrame) -> DataFrame:
    """``key, root`` for nodes that are linked to others; see ``signed`` for the two tables."""
    nodes = ws.settle(
        rows.filter("__sig is not null").groupBy(F.col("__key").alias("key")).agg(
            F.first("__n").alias("n"), F.first("__sig").alias("sig"), F.first("__sketch").alias("sketch"), F.first("__histogram").alias("histogram"), F.min("__rid").alias("__rid")
        ),
        "nodes",
    )
    of_bands = F.expr(f"transform(sequence(0, {BANDS - 1}), band -> xxhash64(band, substring(sig, band * {2 * ROWS} + 1, {2 * ROWS})))")
    spread = nodes.select("key", F.posexplode(of_bands).alias("band", "bucket"))
    several = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("bucket")
    buckets = ws.settle(spread.join(several, "bucket"), "buckets")
    wanted = nodes.join(buckets.select("key").distinct(), "key", "left_semi")
    wanted = ws.settle(wanted.select("key", "n", "sketch", "histogram", of_bands.alias("buckets"), "__rid"), "wanted")
    texts = source.select("__rid", "text").join(wanted, "__rid").drop("__rid")  # one of each node
    schema = T.StructType([*texts.schema.fields, *(T.StructField(name, kind) for name, kind in BITMAP.items())])

    def mapped(batches):
        for block in W.blocks(batches):
            got = bitmaps(*counted(*shingles(block.column(block.schema.get_field_index("text")))), block.num_rows)
            yield pa.RecordBatch.from_arrays([*block.columns, *got], names=[*block.schema.names, *BITMAP])

    texts = ws.settle(texts.mapInArrow(mapped, schema), "texts")

    def verify(pairs: DataFrame) -> DataFrame:
        text = lambda x: texts.select(F.col("key").alias(x), F.col("text").alias(f"t{x}"), F.col("n").alias(f"n{x}"))
        return pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb", "na", "nb").mapInArrow(
            _overlapping, "a binary, b binary"
        )

    roots = resolve(ws, texts.drop("text"), buckets, verify, lambda x, y: near(x, y) & roomy(x, y), lambda x, y: first(x, y, "buckets"))
    ws.drop(nodes, buckets, wanted, texts)
    return roots


def classify(documents: DataFrame, stored: bool = False) -> DataFrame:
    """``doc_id, class_id, class_size`` for each document.

    ``stored`` says that the rows are a plain scan of files, which gives each row
    the same number every time; other rows are stored first.
    """
    ws = Workspace(documents.sparkSession, "neardup", batches=True)
    source, rows = signed(ws, documents.select("doc_id", "text"), stored)
    roots = link(ws, source, rows)
    per_key = rows.groupBy(F.col("__key").alias("key")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    placed = per_key.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    classes = placed.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("rows").alias("class_size"))
    of_key = ws.settle(placed.select("key", "root").join(classes, "root").select("key", "class_id", "class_size"), "classes")
    return rows.select("doc_id", F.col("__key").alias("key")).join(of_key, "key").select("doc_id", "class_id", "class_size")


def deduplicate(documents: DataFrame, stored: bool = False) -> DataFrame:
    """One document of each class: the one of smallest doc_id (nulls last), with its own columns."""
    ws = Workspace(documents.sparkSession, "neardup", batches=True)
    plain, back = aside(documents)
    source, rows = signed(ws, plain, stored)
    roots = link(ws, source, rows)
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("__rid").alias("rid"))
    per_key = rows.groupBy(F.col("__key").alias("key")).agg(F.min(first).alias("first"))
    placed = per_key.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    kept = ws.settle(placed.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.rid").alias("__rid")), "kept")
    ws.drop(rows)
    return source.join(kept, "__rid", "left_semi").select(*plain.columns).withColumnsRenamed(back)


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

#: Classes by the exact similarity of all documents that share a shingle.
ORACLE = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, s, count(*) AS c FROM (
    SELECT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)
  ) GROUP BY ALL
),
n AS (SELECT doc_id, sum(c) AS n FROM s GROUP BY 1),
both_ AS (
  SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.c, y.c)) AS both_
  FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE both_ * 5 >= (na.n + nb.n - both_) * 4
  UNION ALL
  SELECT min(documents.doc_id) OVER (PARTITION BY coalesce(text, '')), documents.doc_id
  FROM documents JOIN d ON d.doc_id = documents.doc_id WHERE len(w) = 0
),
two AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, two.b FROM reach JOIN two ON reach.b = two.a
),
classes AS (SELECT a AS doc_id, min(b) AS class_id, count(*) AS class_size FROM reach GROUP BY 1)
SELECT doc_id, class_id, class_size FROM classes
"""

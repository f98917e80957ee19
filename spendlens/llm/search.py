"""Ranked lexical search, exact, over an index of geometric blocks.

Index. Documents are dealt to shards of bounded bytes as they are scanned. A shard has
its vocabulary (64-bit hashes of terms), the terms of each document with their impacts
(what a term adds to a score, but for the term's weight), and posting lists. The posting
list of a term that many of the shard's documents hold, a *long* list, is cut into blocks
of documents that are alike: some of the list's documents, evenly spread over it, are
centres, and each document goes to the centre whose impacts of long terms are most
similar. A block's summary is the coordinatewise maximum of the impacts of the long terms
over its documents. A shard is made in the task that searches it and kept for that search
only: its arrays are as large as its texts, so nothing of them is written.

Search. For each item, documents that hold one of its other, *short* terms are scored.
What is left holds long terms only, so that the product of a block's summary and the
item's weights bounds the score of every document left in it. Blocks go from the highest
bound down, and a block is skipped only if its bound is below the score of the
``top``-th best document so far; equal bounds are looked into. Nothing is approximated.
Scores of other shards help: a task carries its best scores from shard to shard, and one
in ``SEEDS`` documents is searched first, whose ``top``-th best score is a bound for all.

The shards' best documents are combined in two steps, by item and a salt, then by item,
so that an item of many shards is no hot task. Items are searched in groups of bounded
bytes; a group's terms are all that is broadcast.

Score. With N documents that have a term and L terms in all, a document of n terms has
m = 50 + (50 n N) div L; a term in df documents weighs floor(1000 ln((2N + 2) / (2 df +
1))); a document that holds it tf times scores weight * ((10^9 tf) div (1000 tf + 20 m)).

Terms are told apart by hashes of 64 bits: two of a million terms share one with a
probability of 3e-8.

Defined results: null texts have no terms; documents and items without terms are not
found and find nothing; scores of 0 are left out; equal scores come by ascending doc_id
(nulls last); repeated documents are found each for itself; each row of the items,
repeated ones too, gets its own ranks; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendlens.llm import words as W
from spendlens.llm.common import Workspace

TOP = 50
SHARD_BYTES, SHARD_ROWS = 2 << 20, 1_000
#: A term in so many documents of a shard has a long list; so many documents make a block.
LONG, BLOCK = 64, 32
SEEDS = 16
GROUP_BYTES = 4 << 20
SALTS = 32
NO_ID = np.iinfo(np.int64).max
U = W.U


def terms_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) of all texts, ordered by row and term, and the terms of each row with repeats."""
    row, _, _, h = W.hashed(*W.texts(column), W.ALNUM)
    n = np.bincount(row, minlength=len(column))
    by = np.lexsort((h, row))
    row, h = row[by], h[by]
    at = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))[: len(h)])
    return row[at], h[at], np.diff(np.append(at, len(h))), n


class Shard:
    """The index of some documents."""

    #: ids: doc_id of each document, ``NO_ID`` for null. vocabulary: sorted hashes. terms, impacts: by document,
    #: from starts. long: the long terms. cuts: a block's documents in members. of: a block's term. summary: blocks x long.

    def __init__(self, **parts):
        self.__dict__.update(parts)
        size = len(self.vocabulary)
        docs = np.repeat(np.arange(len(self.ids)), np.diff(self.starts))
        by = np.argsort(self.terms, kind="stable")
        self.posted, self.gains, self.df = docs[by], self.impacts[by], np.bincount(self.terms, minlength=size)
        self.lists = np.append(0, np.cumsum(self.df))
        self.is_long, self.column_of = np.zeros(size, dtype=bool), np.zeros(size, dtype=np.int64)
        self.is_long[self.long] = True
        self.column_of[self.long] = np.arange(len(self.long))
        pick = self.is_long[self.terms]
        self.dense = np.zeros((len(self.ids), len(self.long)))  # impacts of the long terms
        self.dense[docs[pick], self.column_of[self.terms[pick]]] = self.impacts[pick]


def impact(tf: np.ndarray, n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """What a term adds to a document's score, but for its weight."""
    m = 50 + 50 * n.astype(np.int64) * documents // words
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def build(ids: np.ndarray, column, documents: int, words: int, long: int = LONG, block: int = BLOCK) -> Shard | None:
    """The shard of some documents, or None if none has a term."""
    row, h, tf, n = terms_of(column)
    if not len(row):
        return None
    has = np.flatnonzero(n)
    place = np.cumsum(n > 0) - 1
    vocabulary, terms = np.unique(h, return_inverse=True)
    impacts = impact(tf, n[row], documents, words)
    row = place[row]
    starts = np.searchsorted(row, np.arange(len(has) + 1))
    df = np.bincount(terms, minlength=len(vocabulary))
    often = np.flatnonzero(df >= long)
    column_of = np.full(len(vocabulary), -1)
    column_of[often] = np.arange(len(often))
    pick = column_of[terms] >= 0
    dense = np.zeros((len(has), len(often)), dtype=np.int32)
    dense[row[pick], column_of[terms[pick]]] = impacts[pick]
    alike = dense.astype(np.float32)
    alike /= np.maximum(np.linalg.norm(alike, axis=1, keepdims=True), 1)
    members, cuts, of, summary = [], [0], [], [np.empty((0, len(often)), dtype=np.int32)]
    for k, term in enumerate(often):
        held = np.flatnonzero(dense[:, k])
        centres = held[:: block]
        nearest = (alike[held] @ alike[centres].T).argmax(axis=1)
        by = np.argsort(nearest, kind="stable")
        size = np.bincount(nearest, minlength=len(centres))
        size = size[size > 0]
        members.append(held[by])
        summary.append(np.maximum.reduceat(dense[held[by]], np.append(0, np.cumsum(size)[:-1]), axis=0))
        cuts.extend(cuts[-1] + np.cumsum(size))
        of.extend([term] * len(size))
    return Shard(
        ids=ids[has], vocabulary=vocabulary, starts=starts, terms=terms, impacts=impacts, long=often,
        members=np.concatenate(members) if members else np.empty(0, dtype=np.int64), cuts=np.array(cuts),
        of=np.array(of, dtype=np.int64), summary=np.concatenate(summary),
    )


class Best:
    """The best ``top`` documents so far of one item, by score and then ascending id."""

    def __init__(self, top: int, floor: int = 0):
        self.top, self.floor = top, floor
        self.score, self.id = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    @property
    def needed(self) -> int:
        """A document of a lower score is not among the best."""
        return max(self.floor, int(self.score[-1]), 1) if len(self.score) == self.top else max(self.floor, 1)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.needed
        if not good.any():
            return
        score, ids = np.append(self.score, score[good]), np.append(self.id, ids[good])
        by = np.lexsort((ids, -score))[: self.top]
        self.score, self.id = score[by], ids[by]


class Items:
    """Terms and weights of a group of items: item number and place in ``vocabulary`` of each of their terms."""

    def __init__(self, item: np.ndarray, term: np.ndarray, vocabulary: np.ndarray, weight: np.ndarray):
        self.vocabulary, self.weight = vocabulary, weight
        by = np.argsort(item, kind="stable")
        self.numbers, start = np.unique(item[by], return_index=True)
        self.terms = np.split(np.searchsorted(vocabulary, term[by]), start[1:]) if len(item) else []


def search_shard(shard: Shard, items: Items, best: list[Best]) -> int:
    """Adds the shard's documents to the items' best; returns how many blocks were looked into.

    Sums are whole numbers below 2^53, so that matrix products of doubles are exact.
    """
    at = np.searchsorted(shard.vocabulary, items.vocabulary)
    at[at == len(shard.vocabulary)] = 0
    there = shard.vocabulary[at] == items.vocabulary
    known = [t[there[t]] for t in items.terms]
    asked = np.zeros((len(known), len(shard.long)))
    for k, t in enumerate(known):
        t = t[shard.is_long[at[t]]]
        asked[k, shard.column_of[at[t]]] = items.weight[t]
    bounds = asked @ shard.summary.T.astype(np.float64)
    first, last = np.searchsorted(shard.of, shard.long), np.searchsorted(shard.of, shard.long, side="right")
    opened = 0
    for k, t in enumerate(known):
        if not len(t):
            continue
        local, weight, mine = at[t], items.weight[t], best[k]
        long = shard.is_long[local]
        lists, weights = shard.column_of[local[long]], weight[long].astype(np.float64)
        scores = lambda docs: (short[docs] + shard.dense[docs[:, None], lists] @ weights).astype(np.int64)  # noqa: B023, E731
        seen, short = np.zeros(len(shard.ids), dtype=bool), np.zeros(len(shard.ids))
        for term, w in zip(local[~long], weight[~long]):
            posted = slice(shard.lists[term], shard.lists[term + 1])
            seen[shard.posted[posted]] = True
            short[shard.posted[posted]] += w * shard.gains[posted]
        docs = np.flatnonzero(seen)
        if len(docs):
            mine.add(scores(docs), shard.ids[docs])
        if len(lists):
            blocks = np.concatenate([np.arange(first[c], last[c]) for c in lists])
            blocks = blocks[np.argsort(-bounds[k, blocks], kind="stable")]
            step = 4
            while len(blocks):
                blocks = blocks[: int((bounds[k, blocks] >= mine.needed).sum())]
                now, blocks = blocks[:step], blocks[step:]
                step *= 2
                if not len(now):
                    break
                opened += len(now)
                docs = np.unique(np.concatenate([shard.members[shard.cuts[b] : shard.cuts[b + 1]] for b in now]))
                docs = docs[~seen[docs]]
                if len(docs):
                    seen[docs] = True
                    mine.add(scores(docs), shard.ids[docs])
    return opened


def _counts(batches, asked: np.ndarray):
    """How many documents have a term, and terms in all (term 0, in df and n), and the asked terms' documents."""
    documents = words = 0
    df = np.zeros(len(asked), dtype=np.int64)
    for block in W.blocks(batches, most=SHARD_BYTES):
        row, _, _, h = W.hashed(*W.texts(block.column(0)), W.ALNUM)
        documents, words = documents + len(np.unique(row)), words + len(row)
        at = np.searchsorted(asked, h)
        at[at == len(asked)] = 0
        known = asked[at] == h if len(asked) else np.zeros(len(h), dtype=bool)
        pairs = np.unique(at[known] * (block.num_rows + 1) + row[known])  # one for each document and term
        df += np.bincount(pairs // (block.num_rows + 1), minlength=len(asked))
    yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([documents]), pa.array([words])], names=["term", "df", "n"])
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(asked[some].view(np.int64)), pa.array(df[some]), pa.array(np.zeros(len(some), np.int64))], names=["term", "df", "n"])


def search(
    documents: DataFrame, items: DataFrame, top: int = TOP, group_bytes: int = GROUP_BYTES,
    shard_bytes: int = SHARD_BYTES, shard_rows: int = SHARD_ROWS, long: int = LONG, block: int = BLOCK,
) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the best ``top`` documents of each item."""

    def terms(batches):
        for part in W.blocks(batches):
            row, h, _, _ = terms_of(part.column(1))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(h.view(np.int64))], names=["item", "term"])

    ws = Workspace(documents.sparkSession, "search", batches=True)
    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kept = ws.settle(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    asked = ws.settle(kept.select("item", "text").mapInArrow(terms, "item long, term long"), "asked")
    groups = max(1, -(-16 * asked.count() // group_bytes))
    deal = F.pmod(F.xxhash64("item"), F.lit(groups))
    whole = None
    for k in range(groups):
        found = ws.settle(_search_group(read, asked.filter(deal == k), top, (shard_bytes, shard_rows, long, block)), f"found{k}")
        whole = found if whole is None else whole.unionByName(found)
    return kept.select("item", "item_id").join(whole, "item").select("item_id", "rank", "doc_id", "score")


def _search_group(read: DataFrame, asked: DataFrame, top: int, sizes: tuple[int, int, int, int]) -> DataFrame:
    """``item, rank, doc_id, score`` of a group whose items and terms are bounded in size."""
    sc = asked.sparkSession.sparkContext
    pairs = asked.toPandas()
    item, term = pairs["item"].to_numpy(np.int64), pairs["term"].to_numpy(np.int64).view(U)
    vocabulary = np.unique(term)
    sent = sc.broadcast(vocabulary)
    counted = read.select("text").mapInArrow(lambda batches: _counts(batches, sent.value), "term long, df long, n long")
    totals = {r["term"]: r for r in counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).collect()}  # terms of the group alone
    documents, words = (totals[0]["df"], totals[0]["n"]) if 0 in totals else (0, 0)
    df = [totals[t]["df"] if t in totals else 0 for t in vocabulary.view(np.int64).tolist()]
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * k + 1))) for k in df], dtype=np.int64)
    group = sc.broadcast((item, term, vocabulary, weight))
    most_bytes, most_rows, long, block = sizes

    def best_of(rows: DataFrame, floors) -> DataFrame:
        def run(batches):
            own = Items(*group.value)
            best = [Best(top, floors.value.get(int(i), 0) if floors else 0) for i in own.numbers]
            for part in W.blocks(batches, most=most_bytes, rows=most_rows):
                ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                shard = build(ids, part.column(1), documents, words, long, block)
                if shard:
                    search_shard(shard, own, best)
            for number, mine in zip(own.numbers, best):
                if len(mine.id):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine.id), number)), pa.array(mine.id), pa.array(mine.score)], names=["item", "doc_id", "score"])

        out = rows.mapInArrow(run, "item long, doc_id long, score long")
        for keys in (["item", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))], ["item"]):
            place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id"))
            out = out.withColumn("rank", place).filter(F.col("rank") <= top)
        return out

    seeds = best_of(read.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SEEDS)) == 0), None)
    floors = sc.broadcast({r["item"]: r["score"] for r in seeds.filter(F.col("rank") == top).select("item", "score").collect()})
    return best_of(read, floors).select(
        "item", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score"
    )


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

#: The search by scoring every document that shares a term.
ORACLE = f"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, unnest({_WORDS}) AS t FROM documents),
q AS MATERIALIZED (SELECT DISTINCT i, item_id, t FROM (SELECT row_number() OVER () AS i, item_id, unnest({_WORDS}) AS t FROM benchmark)),
l AS MATERIALIZED (SELECT r, doc_id, count(*) AS n FROM w GROUP BY ALL),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM l),
p AS (SELECT r, t, count(*) AS tf FROM w WHERE t IN (SELECT t FROM q) GROUP BY ALL),
v AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY t, docs),
scored AS (
  SELECT i, item_id, doc_id, r, CAST(sum(weight * (1000000000 * tf // (1000 * tf + 20 * (50 + 50 * n * docs // words)))) AS BIGINT) AS score
  FROM q JOIN p USING (t) JOIN v USING (t) JOIN l USING (r), s GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
) WHERE rank <= {TOP}
"""

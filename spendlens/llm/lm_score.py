"""Language-model scores by a weighted backoff automaton over all training texts.

The model. States are histories of up to ``order`` - 1 words seen in training.
A seen n-gram is an arc of weight p(w | h) = (c(hw) + K p(w | h')) / (c(h) + K),
where h' is h without its first word; a missing arc is replaced by the failure
arc to h', of weight K / (c(h) + K), which is 1 where h was never seen. Under
the empty history, words and one unknown word share p(w) = (c(w) + V / (V + 1))
/ (N + V). The weights out of each state sum to 1. A text is traversed from left
to right, from the empty history to the end token, adding log10 weights.

The automaton grows with the corpus and is never held or sent as a whole. Texts
are taken in blocks; a block lists its distinct n-grams (hashes) with their
training counts, packed as sorted differences, one row for each range of hashes.
A range adds up the counts of all blocks and gives each block the totals of the
n-grams it listed: the states and arcs that block can reach. The block is then
walked with just these (``Automaton``), all its texts side by side. ``traverse`` is the
same in closed form, arc + failure x lower order at every position, for the tests. An
n-gram is one entry for each block, however often it occurs, so a frequent word, pair or
passage makes no hot range.

Blocks and ranges both hold ``max(4 MB, sqrt(18 KB x input))`` of text, so the
packed rows (blocks x ranges) grow in proportion to the input and a task's
memory with its square root: 4 MB up to 1 GB, 23 MB at 30 GB, 136 MB at 1 TB.

Defined results: a null or empty text is its end token; tokens are told apart by
64-bit hashes; without training rows N and V are 0 and every token has
probability 1; repeated rows are scored, and counted, each; an empty table
gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm import words as W
from spendlens.llm.common import Workspace, crc_mod

ORDER = 3
PRIOR = {2: 3000.0, 3: 4.0}  # K by order: words of prior weight given to the shorter history
LEAST, CELL = 4 << 20, 18 << 10
PIECE = 1024  # words of a text that are walked one after the other
U = W.U
END = U(0x5851F42D4C957F2D)


def training(name: str = "doc_id") -> Column:
    return crc_mod(name, 7) != 2


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all words, each text followed by the end token."""
    row, _, _, h = W.hashed(*W.texts(column), W.SPACED)
    ends = np.searchsorted(row, np.arange(len(column)), side="right")
    return np.insert(row, ends, np.arange(len(column))), np.insert(h, ends, END)


def ngrams(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the last word, hash) of the n-grams within rows."""
    if len(h) < n:
        return np.empty(0, np.int64), h[:0]
    out = h[: len(h) - n + 1]
    for k in range(1, n):
        out = W.mix(out * U(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
    out = out[at]
    if n > 1:  # five bytes of difference are enough to tell longer n-grams apart
        out = out & ~U(0xFF)
    return at + n - 1, out


def listed(row, h, train, n: int):
    """Distinct n-grams in order, training counts, and the place of each position's n-gram."""
    at, grams = ngrams(row, h, n)
    seen, place = np.unique(grams, return_inverse=True)
    counts = np.bincount(place, weights=train[row[at]], minlength=len(seen)).astype(np.uint32)
    return seen, counts, at, place


def pack(values: np.ndarray) -> bytes:
    """Bytes of an integer array by significance, compressed."""
    planes = values.view(np.uint8).reshape(len(values), -1).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int, kind) -> np.ndarray:
    if not n:
        return np.empty(0, kind)
    size = n * np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(blob, size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(-1, n).T).view(kind).reshape(n)


def ranges(seen: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of hashes begins, and the end."""
    edges = np.array([k * (1 << 64) // parts for k in range(parts)], dtype=U)
    return np.append(np.searchsorted(seen, edges), len(seen))


def blocks(batches, most: int):
    """(block number, batch): numbered by partition and place, the same on every run over stored rows."""
    base = TaskContext.get().partitionId() << 24
    for k, block in enumerate(W.blocks(batches, most=most, rows=1 << 30)):
        yield base + k, block


LISTED = "part int, block long, n array<int>, ids array<binary>, counts array<binary>"
TOTALS = "block long, part int, n array<int>, totals array<binary>, vocabulary long, tokens long"
BINARIES = pa.list_(pa.binary())


def list_ngrams(documents: DataFrame, order: int, most: int, parts: int) -> DataFrame:
    """One row for each block and range: its n-grams and their training counts."""

    def run(batches):
        for number, block in blocks(batches, most):
            row, h = tokens(block.column(1))
            train = block.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            lists = []
            for n in range(1, order + 1):
                seen, counts, _, _ = listed(row, h, train, n)
                lists.append((seen, counts, ranges(seen, parts)))
            for start in range(0, parts, 64):
                some = range(start, min(start + 64, parts))
                cut = lambda k: [(s[e[k] : e[k + 1]], c[e[k] : e[k + 1]]) for s, c, e in lists]
                cuts = [cut(k) for k in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(some), pa.int32()),
                        pa.array([number] * len(some), pa.int64()),
                        pa.array([[len(s) for s, _ in c] for c in cuts], pa.list_(pa.int32())),
                        pa.array([[pack(np.diff(s, prepend=s[:1])) if len(s) else b"" for s, _ in c] for c in cuts], BINARIES),
                        pa.array([[pack(np.append(s[:1], n.astype(U))) if len(s) else b"" for s, n in c] for c in cuts], BINARIES),
                    ],
                    names=["part", "block", "n", "ids", "counts"],
                )

    return documents.mapInArrow(run, LISTED)


def add_up(table: pa.Table) -> pa.Table:
    """Totals of one range for every block that listed something in it."""
    table = table.combine_chunks()
    sizes = np.array(table.column("n").to_pylist(), dtype=np.int64).reshape(table.num_rows, -1)
    ids, counts = table.column("ids").to_pylist(), table.column("counts").to_pylist()
    out = [[] for _ in range(table.num_rows)]
    vocabulary = total = 0
    for k in range(sizes.shape[1]):
        heads, own = [], []
        for i in range(table.num_rows):
            n = int(sizes[i, k])
            if n:
                tail = unpack(counts[i][k], n + 1, U)
                gaps = unpack(ids[i][k], n, U)
                heads.append(np.cumsum(np.append(tail[:1], gaps[1:])))
                own.append(tail[1:])
            else:
                heads.append(np.empty(0, U))
                own.append(np.empty(0, U))
        seen, place = np.unique(np.concatenate(heads), return_inverse=True)
        sums = np.bincount(place, weights=np.concatenate(own).astype(np.float64), minlength=len(seen))
        if k == 0:
            vocabulary, total = int((sums > 0).sum()), int(sums.sum())
        back = np.split(sums[place].astype(np.uint64), np.cumsum(sizes[:, k])[:-1])
        for i, b in enumerate(back):
            out[i].append(pack(b) if len(b) else b"")
    first = np.arange(table.num_rows) == 0
    return pa.table(
        {
            "block": table.column("block"),
            "part": table.column("part"),
            "n": table.column("n").cast(pa.list_(pa.int32())),
            "totals": pa.array(out, BINARIES),
            "vocabulary": pa.array(np.where(first, vocabulary, 0), pa.int64()),
            "tokens": pa.array(np.where(first, total, 0), pa.int64()),
        }
    )


def traverse(row, h, totals: list[np.ndarray], places, n_train: int, vocabulary: int, prior=PRIOR):
    """log10 weight of each token, and whether it is known.

    ``totals[k]`` are counts of the block's (k+1)-grams, ``places[k]`` says which
    belongs to which position. Every position sums arc + failure x lower
    order over all orders, which equals following failure arcs from its state:
    a check of ``Automaton``, which does follow them.
    """
    count = []
    for k, (at, place) in enumerate(places):
        c = np.zeros(len(h))
        c[at] = totals[k][place]
        count.append(c)
    known = count[0] > 0
    weight = (count[0] + vocabulary / (vocabulary + 1)) / (n_train + vocabulary) if n_train else np.ones(len(h))
    for k in range(1, len(count)):
        history = np.zeros(len(h))  # the count of the k words before, where they are of the same text
        history[1:] = count[k - 1][:-1]
        inside = np.zeros(len(h), dtype=bool)
        inside[places[k][0]] = True
        history[~inside] = 0
        failure = prior[k + 1] / (history + prior[k + 1])
        arc = count[k] / (history + prior[k + 1])
        weight = arc + failure * weight
    return np.log10(weight), known, count[0]


class Automaton:
    """The states and arcs that one block of texts can reach.

    ``counts[k]`` are the training counts of the block's distinct (k+1)-grams,
    ``places[k]`` the positions they end at and which of them stands there. State 0 is
    the empty history; a seen k-gram, k < order, is a state. An arc is found by its state
    and word among sorted keys, and has a log10 weight and the state it leads to: the
    longest seen history that the words then end with.
    """

    def __init__(self, counts: list[np.ndarray], places: list, n_train: int, vocabulary: int, prior=PRIOR):
        order, self.words = len(counts), max(1, len(counts[0]))
        size = len(places[0][0])
        ends = [np.full(size, -1) for _ in range(order)]  # the (k+1)-gram that ends at each position
        last = [np.zeros(len(c), dtype=np.int64) for c in counts]  # a position where each gram ends
        for k, (at, place) in enumerate(places):
            ends[k][at] = place
            last[k][place] = at
        self.word = ends[0]
        state, number = [], 1
        for k in range(order - 1):
            seen = counts[k] > 0
            state.append(np.where(seen, number + np.cumsum(seen) - 1, 0))
            number += int(seen.sum())
        self.failure, self.failing = np.zeros(number, dtype=np.int64), np.zeros(number)
        weight = (counts[0] + vocabulary / (vocabulary + 1)) / (n_train + vocabulary) if n_train else np.ones(len(counts[0]))
        keys, logs, targets = [np.arange(len(counts[0]))], [np.log10(weight)], [state[0] if order > 1 else np.zeros(len(counts[0]), dtype=np.int64)]
        for k in range(1, order):
            at = last[k]
            history, suffix = ends[k - 1][at - 1], ends[k - 1][at]
            room = counts[k - 1][history] + prior[k + 1]
            weight = counts[k] / room + prior[k + 1] / room * weight[suffix]
            seen = np.flatnonzero(counts[k] > 0)
            keys.append(state[k - 1][history[seen]] * self.words + self.word[at[seen]])
            logs.append(np.log10(weight[seen]))
            targets.append(state[k][seen] if k < order - 1 else state[k - 1][suffix[seen]])
            own = np.flatnonzero(counts[k - 1] > 0)  # the states of k words
            if k > 1:
                self.failure[state[k - 1][own]] = state[k - 2][ends[k - 2][last[k - 1][own]]]
            self.failing[state[k - 1][own]] = np.log10(prior[k + 1] / (counts[k - 1][own] + prior[k + 1]))
        by = np.argsort(np.concatenate(keys))
        self.keys, self.logs, self.targets = (np.concatenate(v)[by] for v in (keys, logs, targets))
        self.memory = order - 1

    def walk(self, row: np.ndarray, rows: int, piece: int = PIECE) -> np.ndarray:
        """log10 weight of each text: all texts a word at a time, each carrying its state.

        A long text is walked in pieces at once. The state is settled by the last order - 1
        words, so a piece begins as many words early, without counting them.
        """
        length = np.bincount(row, minlength=rows)
        begin = np.cumsum(length) - length
        n = -(-length // piece)
        text = np.repeat(np.arange(rows), n)
        at = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * piece
        early = np.minimum(at, self.memory)
        start, steps = begin[text] + at - early, np.minimum(piece, length[text] - at) + early
        by = np.argsort(-steps, kind="stable")
        text, start, steps, early = text[by], start[by], steps[by], early[by]
        total, state = np.zeros(len(text)), np.zeros(len(text), dtype=np.int64)
        going = np.searchsorted(-steps, -np.arange(steps[0] if len(steps) else 0), side="left")
        for t, m in enumerate(going.tolist()):
            word, at_state, gain = self.word[start[:m] + t], state[:m], np.zeros(m)
            open_ = np.arange(m)
            while True:
                key = at_state[open_] * self.words + word[open_]
                arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                there = self.keys[arc] == key
                found, arc = open_[there], arc[there]
                gain[found] += self.logs[arc]
                at_state[found] = self.targets[arc]
                open_ = open_[~there]
                if not len(open_):
                    break
                gain[open_] += self.failing[at_state[open_]]
                at_state[open_] = self.failure[at_state[open_]]
            total[:m] += np.where(t >= early[:m], gain, 0)
        return np.bincount(text, weights=total, minlength=rows)


def score(documents: DataFrame, train: Column | None = None, order: int = ORDER, stored: bool = False) -> DataFrame:
    """Scores of all texts. ``stored`` says that the rows are a plain scan of files."""
    spark = documents.sparkSession
    ws = Workspace(spark, "lm", batches=True)
    # blocks are cut as rows are scanned: both scans must cut files alike, whatever executors come or go
    spark.conf.set("spark.sql.files.minPartitionNum", spark.conf.get("spark.sql.files.minPartitionNum", None) or str(spark.sparkContext.defaultParallelism))
    rows = documents.select("doc_id", "text", (training() if train is None else train).alias("train"))
    if not stored:
        rows = ws.settle(rows, "rows")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    most = max(LEAST, math.isqrt(CELL * int(size)))
    parts = max(1, -(-int(size) // most))
    found = list_ngrams(rows, order, most, parts)
    totals = ws.settle(found.groupBy("part").applyInArrow(add_up, TOTALS), "totals")
    vocabulary, n_train = totals.agg(F.coalesce(F.sum("vocabulary"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()

    def number(batches):
        for k, block in blocks(batches, most):
            yield pa.RecordBatch.from_arrays(
                [*block.columns, pa.array([k] * block.num_rows, pa.int64())], names=["doc_id", "text", "train", "block"]
            )

    numbered = rows.mapInArrow(number, "doc_id long, text string, train boolean, block long")

    def walk(docs: pa.Table, mine: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        mine = mine.sort_by("part").combine_chunks()
        row, h = tokens(docs.column("text"))
        none = np.zeros(docs.num_rows)
        sizes, blobs = mine.column("n").to_pylist(), mine.column("totals").to_pylist()
        sums, places = [], []
        for k in range(order):
            seen, _, at, place = listed(row, h, none, k + 1)
            got = [unpack(b[k], n[k], np.uint64) for n, b in zip(sizes, blobs) if n[k]]
            got = np.concatenate(got) if got else np.empty(0, np.uint64)
            if len(got) != len(seen):
                raise RuntimeError("a block is not what it was when its n-grams were listed: store the rows first")
            sums.append(got.astype(np.float64))
            places.append((at, place))
        c = sums[0][places[0][1]]
        score = Automaton(sums, places, n_train, vocabulary).walk(row, docs.num_rows)
        base = np.log10((c + 1) / (n_train + (vocabulary + 1)))
        add = lambda x: np.bincount(row, weights=x, minlength=docs.num_rows)
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": pa.array(~docs.column("train").to_numpy().astype(bool)),
                "n_tokens": pa.array(add(None).astype(np.int64)),
                "n_known": pa.array(add((c > 0).astype(float)).astype(np.int64)),
                "train_tokens": pa.array([n_train] * docs.num_rows, pa.int64()),
                "base_score": pa.array(add(base)),
                "score": pa.array(score),
            }
        )

    return numbered.groupBy("block").cogroup(totals.select("block", "part", "n", "totals").groupBy("block")).applyInArrow(
        walk, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )

"""Uniform shuffle into shards with exact sizes: a hypergeometric communication matrix.

1. The rows are stored as they lie; neighbouring stored partitions make a sender.
2. How many rows each sender gives to each shard is drawn exactly: senders in
   turn draw from what is left of all shards (multivariate hypergeometric), so
   rows add up to the sender's rows and columns to the shard's size.
3. Inside a sender a keyed permutation of its places decides which rows go where.
4. Rows are exchanged by shard and place.
5. Inside a shard a second keyed permutation gives the final slot.

The driver holds one number for each stored partition and the matrix, at most
``MAX_SENDERS`` x shards numbers; both are what is broadcast. The permutations
are Feistel networks on 0..n-1 (walking on until a number falls inside), worked
out for each row alone: no shard and no sender has to fit in memory, and no key
can be hot.

Defined results: sizes of shards differ by one at most, the first ones are the
larger; a null text has no bytes and the checksum of the empty text; repeated
rows are shuffled like any others; an empty table gives no rows; other columns
pass through, and a column named like a result is replaced by it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.llm.common import Workspace, aside, located, text_or_empty
from spendlens.llm.words import U, mix

LAW = "rows"
SEED = 20260
MAX_SENDERS = 4096
ROUNDS = 6


def draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn without replacement are of the ``good``."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    # beyond NumPy's range: invert the distribution around its mode, to 12 deviations
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    sd = math.sqrt(n * (good / total) * (bad / total) * ((total - n) / (total - 1))) + 2
    a, b = max(low, int(mode - 12 * sd)), min(high, int(mode + 12 * sd))
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    mass = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def matrix(senders: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Rows each sender gives to each shard, dealt as a uniform shuffle deals them."""
    total = sum(senders)
    left = [total // shards + (k < total % shards) for k in range(shards)]
    rng = np.random.default_rng(seed)
    out = np.zeros((len(senders), shards), dtype=np.int64)
    for i, n in enumerate(senders):
        pool = sum(left)
        for k in range(shards):
            got = draw(rng, left[k], pool - left[k], n)
            pool -= left[k]
            left[k] -= got
            n -= got
            out[i, k] = got
    return out


def permuted(at: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed bijection of 0..n-1, at ``at``; n and key for each row."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(np.float64)) / 2)).astype(U)
    side = (U(1) << half) - U(1)
    out, todo = at.astype(U), np.arange(len(at))
    limit = n.astype(U)
    while len(todo):
        h, s, k = half[todo], side[todo], key[todo]
        a, b = out[todo] >> h, out[todo] & s
        for r in range(ROUNDS):
            a, b = b, a ^ (mix(b ^ mix(k + U(r))) & s)
        out[todo] = (a << h) | b
        todo = todo[out[todo] >= limit[todo]]
    return out.astype(np.int64)


def shuffle(df: DataFrame, shards: int, seed: int = SEED, stored: bool = False) -> DataFrame:
    """Adds ``shard`` and ``slot`` to each row; laid out and sorted by both.

    The senders are files: those of ``df`` itself with ``stored``, which says that the
    rows are a plain scan of files; other rows are stored first. A row's place in its
    file does not depend on how a read cuts the files into tasks.
    """
    ws = Workspace(df.sparkSession, "sharding", batches=True)
    results = ("shard", "slot")
    plain, back = aside(df)
    rows = plain.drop(*results)
    laid = located(rows) if stored else None
    if laid is None:
        laid = located(ws.settle(rows, "laid"))
    laid = laid.select(*rows.columns, F.col("__file").alias("__part"), "__place")
    counts = {r["__part"]: r["count"] for r in laid.groupBy("__part").count().collect()}
    parts = max(counts, default=-1) + 1
    size = np.array([counts.get(p, 0) for p in range(parts)], dtype=np.int64)
    group = max(1, -(-parts // MAX_SENDERS))
    sender_of = np.arange(parts) // group
    before = np.cumsum(size) - size
    n_of = np.bincount(sender_of, weights=size, minlength=0).astype(np.int64)
    before = before - (np.cumsum(n_of) - n_of)[sender_of]  # rows of the same sender in earlier partitions
    dealt = matrix(n_of.tolist(), shards, seed)
    sizes = dealt.sum(axis=0)
    sent = df.sparkSession.sparkContext.broadcast((sender_of, before, n_of, dealt))
    names = rows.columns
    schema = T.StructType([*laid.schema.fields[: len(names)], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def deal(batches):
        sender_of, before, n_of, dealt = sent.value
        ends = np.cumsum(dealt, axis=1)
        above = np.cumsum(dealt, axis=0) - dealt
        for batch in batches:
            part = batch.column(len(names)).to_numpy()
            at = batch.column(len(names) + 1).to_numpy()
            sender = sender_of[part]
            at = permuted(at + before[part], n_of[sender], mix(sender.astype(U) + U(seed)))
            shard = np.empty(len(at), dtype=np.int64)
            for s in np.unique(sender):
                own = sender == s
                shard[own] = np.searchsorted(ends[s], at[own], side="right")
            at = at - (ends - dealt)[sender, shard] + above[sender, shard]
            slot = permuted(at, sizes[shard], mix(shard.astype(U) + U(seed ^ 0x5EED)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(shard.astype(np.int32)), pa.array(slot)],
                names=[*names, *results],
            )

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return laid.mapInArrow(deal, schema).repartitionByRange(n, *results).sortWithinPartitions(*results).withColumnsRenamed(back)


def assign(documents: DataFrame, shards: int = 24, seed: int = SEED) -> DataFrame:
    """Size, checksum, shard and slot of each document, without its text."""
    text = text_or_empty()
    rows = documents.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
    )
    return shuffle(rows, shards, seed).withColumn("grown_shard", F.lit(None).cast("int"))

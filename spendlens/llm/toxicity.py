"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, word pairs and pairs with
one or two words between, hashed to ``BUCKETS`` coordinates. FTRL-proximal keeps
a learning rate for each coordinate and an L1 threshold, so only coordinates
with steady evidence get a weight.

Learning takes at most ``sample`` labelled documents (those with the smallest
hash of doc_id; the bound is the documented parameter), because FTRL is a
sequential method: one task runs it over this bounded set, with two numbers for
each coordinate. Weights are broadcast: never more than ``BUCKETS`` pairs, in
practice some hundreds. Scoring reads whole texts and needs no shuffle.

Defined results: a null or empty text has no features and scores by the
intercept; labels that are null count as missing, several labels of one
document as toxic if one is; repeated documents are scored alike; with no usable
label every score is 0.5; columns of the documents pass through, and one named
like a result is replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.llm import words as W
from spendlens.llm.common import Workspace, crc_mod, small_batches

BUCKETS = 1 << 24
SAMPLE = 20_000
EPOCHS = 6
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 4.0, 1.0, 6.0, 0.02
RESULTS = ["score", "predicted"]


def features(batch: pa.RecordBatch, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) pairs of all texts of a batch, sorted by row, each once.

    ``wanted`` marks the buckets to return (default: all).
    """
    row, _, _, h = W.hashed(*W.texts(batch.column(batch.schema.get_field_index("text"))), W.ALNUM)
    keys = []
    for k, (r, g) in enumerate([(row, h), W.grams(row, h, 2), W.grams(row, h, 2, 2), W.grams(row, h, 2, 3)]):
        at = W.mix(g + W.U(k)) & W.U(BUCKETS - 1)
        if wanted is not None:
            some = wanted[at]
            r, at = r[some], at[some]
        keys.append((r.astype(W.U) << W.U(24)) | at)
    key = np.unique(np.concatenate(keys))
    return (key >> W.U(24)).astype(np.int64), (key & W.U(BUCKETS - 1)).astype(np.int64)


def ftrl(docs: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Nonzero coordinates, their weights, and the intercept after ``epochs`` passes."""
    z, n = np.zeros(BUCKETS + 1, np.float32), np.zeros(BUCKETS + 1, np.float32)  # the last is the intercept

    def weight(i):
        at, l1 = z[i], np.where(i < BUCKETS, L1, 0.0)
        over = np.abs(at) - l1
        return np.where(over > 0, -np.sign(at) * over / ((BETA + np.sqrt(n[i])) / ALPHA + L2), 0.0)

    rng = np.random.default_rng(len(docs))
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            i = np.append(docs[k], BUCKETS)
            w = weight(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y[k]
            old = n[i]
            z[i] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / ALPHA * w
            n[i] = old + g * g
    moved = np.flatnonzero(np.abs(z[:-1]) > L1)
    return moved, weight(moved), float(weight(np.array([BUCKETS]))[0])


def train(documents: DataFrame, labels: DataFrame, use: Column | None = None, sample: int = SAMPLE):
    """Coordinates, weights and intercept learned from labelled documents.

    ``use`` is a condition on doc_id for the rows to learn from.
    """
    ws = Workspace(documents.sparkSession, "toxicity", batches=True)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    if use is not None:
        known = known.filter(use)
    known = known.groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").cast("double").alias("__y"))
    chosen = ws.settle(known.orderBy(F.xxhash64("__id"), "__id").limit(sample), "labels")  # bounded by ``sample``
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    # one text of each labelled document: repeated rows must not add weight or size
    texts = texts.groupBy("__id", "__y").agg(F.min("text").alias("text"))

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("__id")
        docs, y = [], table.column("__y").to_numpy()
        for block in W.blocks(iter(table.combine_chunks().to_batches())):
            row, at = features(block)
            docs += np.split(at.astype(np.int32), np.searchsorted(row, np.arange(1, block.num_rows)))
        at, w, bias = ftrl(docs, y)
        return pa.table({"at": pa.array(np.append(at, -1), pa.int64()), "w": pa.array(np.append(w, bias), pa.float64())})

    fitted = texts.withColumn("__all", F.pmod("__id", F.lit(1))).groupBy("__all").applyInArrow(fit, "at long, w double").collect()  # at most BUCKETS + 1 rows
    ws.drop(chosen)
    pairs = sorted((r["at"], r["w"]) for r in fitted)
    at = np.array([a for a, _ in pairs if a >= 0], np.int64)
    return at, np.array([w for a, w in pairs if a >= 0]), sum(w for a, w in pairs if a < 0)


def score(documents: DataFrame, model, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Adds score and predicted to each document."""
    small_batches(documents.sparkSession)
    names = [c for c in (documents.columns if keep is None else keep) if c not in RESULTS]
    sent = documents.sparkSession.sparkContext.broadcast(model)
    read = documents.select(*dict.fromkeys([*names, "text"]))
    schema = T.StructType([*[documents.schema[c] for c in names], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        at, w, bias = sent.value
        wanted = np.zeros(BUCKETS, dtype=bool)
        wanted[at] = True
        for block in W.blocks(batches):
            row, bucket = features(block, wanted)
            sums = bias + np.bincount(row, weights=w[np.searchsorted(at, bucket)], minlength=block.num_rows)
            p = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            arrays = [block.column(block.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*names, *RESULTS]
            )

    return read.mapInArrow(run, schema)


def learnable(name: str = "doc_id") -> Column:
    """Documents that labels may be learned from."""
    return crc_mod(name, 4) != 2


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document, learned from the rows that are not held out."""
    model = train(documents, labels, use=learnable())
    scored = score(documents, model, keep=["doc_id"])
    return scored.select("doc_id", (~learnable()).alias("held_out"), "score", "predicted")


def accept(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    model = train(documents, labels, use=learnable())
    keep = documents.columns
    marked = documents.withColumnRenamed("score", "__score").withColumnRenamed("predicted", "__predicted")
    kept = score(marked, model).filter(F.col("predicted") == 0).drop("score", "predicted")
    return kept.withColumnRenamed("__score", "score").withColumnRenamed("__predicted", "predicted").select(*keep)

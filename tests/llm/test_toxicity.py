import zlib

import numpy as np
import pyarrow as pa

from spendlens.llm import toxicity as X


def sample(spark, n=900):
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(n):
        words = rng.choice(["the", "of", "and", "Tree", "sky", "été"], int(rng.integers(3, 40))).tolist()
        y = int(rng.random() < 0.3)
        if y:
            words[int(rng.integers(0, len(words)))] = ["Vile", "NASTY"][i % 2]
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1, y))
    docs += [(n, None, "x"), (n + 1, "", "x"), (None, "vile", "x"), (0, docs[0][1], "x")]
    labels += [(None, 1, 1), (5, 0, None), (n, None, 0), (7, 1, labels[7][2])]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, score string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        dict((a, c) for a, _, c in labels if a is not None and c is not None),
    )


def test_features_are_distinct_ngrams_and_skipgrams():
    batch = pa.record_batch({"text": pa.array(["a b c d", "A b", "", None, "a a a"])})
    row, at = X.features(batch)
    counts = np.bincount(row, minlength=5).tolist()
    assert counts == [4 + 3 + 2 + 1, 2 + 1, 0, 0, 1 + 1 + 1]  # words, pairs, one and two words between
    assert set(at[row == 1]) < set(at[row == 0])  # case does not matter


def test_held_out_accuracy_and_contract(spark):
    docs, labels, truth = sample(spark)
    rows = X.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(key.encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_weights_are_sparse_and_labels_of_held_out_rows_unused(spark):
    docs, labels, _ = sample(spark)
    at, w, _ = X.train(docs, labels, use=X.learnable())
    assert 0 < len(at) < 200 and np.all(w != 0)
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(X.learnable(), F.col("toxic")).otherwise(1 - F.col("toxic")))
    again = X.train(docs, turned, use=X.learnable())
    assert at.tolist() == again[0].tolist() and w.tolist() == again[1].tolist()


def test_empty_tables_and_filter(spark):
    docs, labels, truth = sample(spark)
    assert {r["score"] for r in X.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert X.classify(docs.limit(0), labels).count() == 0
    kept = X.accept(docs, labels)
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.collect()}
    clean = {d for d, y in truth.items() if y == 0}
    assert len(clean - left) < 0.03 * len(clean) and len(left & {d for d, y in truth.items() if y}) < 10

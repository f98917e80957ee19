from collections import Counter

import pytest

import corpus_pipeline as P
from spendlens.llm import decontaminate, neardup, toxicity
from spendlens.llm.common import DOCUMENT_COLUMNS
from tests.llm.test_decontaminate import brute as windows
from tests.llm.test_neardup import similar

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs.collect()
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
        if name != P.STAGES[-1][0]:
            assert docs.columns == DOCUMENT_COLUMNS
    return out


def test_documents_predicted_toxic_go(spark, stages):
    before = {r["doc_id"] for r in stages["documents"]}
    after = {r["doc_id"] for r in stages["toxicity"]}
    rejected = {
        r["doc_id"] for r in toxicity.classify(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()
    }
    assert rejected and after == before - rejected


def test_one_of_each_near_duplicate_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages["toxicity"]]
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if find(a) != find(b) and similar(x, y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    assert sorted(r["doc_id"] for r in stages["near_duplicates"]) == sorted({find(d) for d in root})


def test_contaminated_documents_go(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in stages["near_duplicates"]]
    bad = {d for (d, _), (n, hit, _) in zip(rows, windows([t for _, t in rows], items, 13)) if hit and 20 * hit >= n}
    assert {r["doc_id"] for r in stages["decontamination"]} == {d for d, _ in rows} - bad


def test_mixing_and_sharding(stages):
    before = {r["doc_id"]: r for r in stages["decontamination"]}
    taken = Counter(r["doc_id"] for r in stages["mixing"])
    assert set(taken) <= set(before) and max(taken.values()) <= 3
    dealt = stages["sharding"]
    assert Counter(r["doc_id"] for r in dealt) == taken
    sizes = Counter(r["shard"] for r in dealt)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == P.SHARDS
    for s in sizes:
        assert sorted(r["slot"] for r in dealt if r["shard"] == s) == list(range(sizes[s]))


def test_extra_columns_and_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0
    rows = spark.createDataFrame(
        [(1, "a clean text", None, None, 12, "x", 0.5), (None, None, None, None, None, None, None)],
        "doc_id long, text string, lang string, source string, n_chars long, shard string, score double",
    )
    path = str(tmp_path / "extra")
    rows.write.parquet(path)
    extra = spark.read.parquet(path)
    for _, stage in P.STAGES:
        assert stage(spark, extra, SF).columns[:5] == DOCUMENT_COLUMNS
    assert P.STAGES[-1][1](spark, extra, SF).count() == 2
    assert neardup.deduplicate(extra).columns == extra.columns
    assert decontaminate.remove(extra, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 2

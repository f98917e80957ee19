"""Rows keep their numbers when files are read in other pieces, and users' own names for columns."""

from collections import Counter

import pytest

from spendlens.llm import lines, mixing, neardup, sharding
from spendlens.llm.common import Workspace, aside, located, numbered


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = [(k, f"line {k % 40} of some words that stand here\nand another line {k} with its own words", f"s{k % 3}", k % 5) for k in range(3_000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n long").repartition(3).write.option("parquet.block.size", "20000").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def pieces(spark):
    def cut(n):
        spark.conf.set("spark.sql.files.minPartitionNum", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield cut
    spark.conf.unset("spark.sql.files.minPartitionNum")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_numbers_do_not_depend_on_how_files_are_cut(spark, stored, pieces):
    rows = numbered(Workspace(spark, "t"), stored, True)
    got, parts = [], []
    for n in (1, 40):
        pieces(n)
        fresh = rows.select("doc_id", "__rid")
        parts.append(spark.read.parquet(*stored.inputFiles()).rdd.getNumPartitions())
        got.append(dict(map(tuple, fresh.filter("n >= 0").collect())))
    assert parts[0] < parts[1] and got[0] == got[1] and len(set(got[0].values())) == 3_000
    assert located(spark.range(3)) is None
    assert numbered(Workspace(spark, "t"), spark.range(3), True).select("__rid").distinct().count() == 3


def test_results_do_not_depend_on_how_files_are_cut(spark, stored, pieces):
    def sharded():
        return {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shuffle(stored, 5, stored=True).collect()}

    def mixed():
        return {r["doc_id"]: r["copies"] for r in mixing.mix(stored, stored=True).collect()}

    def cleaned(n):
        out = lines.deduplicate(stored.filter("doc_id < 200"), stored=True)
        pieces(n)  # between what is stored and what is read at last
        return {r["doc_id"]: (r["text"], r["n_removed"]) for r in out.collect()}

    pieces(1)
    first = sharded(), mixed(), cleaned(30)
    pieces(40)
    again = sharded(), mixed(), cleaned(1)
    assert first == again
    slots = Counter(shard for shard, _ in first[0].values())
    assert len(set(first[0].values())) == 3_000 and max(slots.values()) - min(slots.values()) <= 1


def test_own_names_are_not_taken_for_the_users(spark):
    rows = [(k, f"{k % 5} is one line of words here\nline {k} alone with more words", "s", f"u{k}", k, k * 2) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __rid string, __part long, user__rid long")
    plain, back = aside(docs)
    assert plain.withColumnsRenamed(back).columns == docs.columns and not any(c.startswith("__") for c in plain.columns)
    same = lambda got: all((r["__rid"], r["__part"], r["user__rid"]) == (f"u{r['doc_id']}", r["doc_id"], 2 * r["doc_id"]) for r in got)
    for out in (neardup.deduplicate(docs), lines.deduplicate(docs.withColumn("__lines", docs["doc_id"])), mixing.mix(docs), sharding.shuffle(docs, 3)):
        got = out.collect()
        assert got and same(got) and set(docs.columns) <= set(out.columns)
    assert all(r["__lines"] == r["doc_id"] for r in lines.deduplicate(docs.withColumn("__lines", docs["doc_id"])).collect())

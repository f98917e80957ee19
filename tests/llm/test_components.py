import random

import pyarrow as pa
import pytest

from spendlens.llm.common import Workspace
from spendlens.llm.components import components, resolve


def brute(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "empty"])
def test_components(spark, kind):
    r = random.Random(4)
    links = {
        "random": [(r.randrange(300), r.randrange(300)) for _ in range(170)],
        "chain": [(i, i + 1) for i in range(120)],
        "star": [(0, i) for i in range(1, 200)] + [(7, 7), (5, 0)],
        "empty": [],
    }[kind]
    got = components(spark.createDataFrame(links, "a long, b long"))
    want = brute([x for x in links if x[0] != x[1]])
    assert {x["node"]: x["root"] for x in got.collect()} == want


def resolved(spark, members, linked):
    """Classes of keys by ``resolve``, and how many pairs were verified; ``members`` lists the keys of each bucket."""
    seen = spark.sparkContext.accumulator(0)
    keys = sorted({k for m in members for k in m})
    ws = Workspace(spark, "t")
    nodes = spark.createDataFrame([(k,) for k in keys], "key long")
    buckets = spark.createDataFrame([(b, k) for b, m in enumerate(members) for k in m], "bucket long, key long")

    def verify(pairs):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch.filter(pa.array([linked(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.bool_()))

        return pairs.select("a", "b").mapInArrow(run, "a long, b long")

    got = {r["key"]: r["root"] for r in resolve(ws, nodes, buckets, verify).collect()}
    return got, seen.value


def test_a_star_is_settled_by_its_middle(spark):
    """Copies that are like their original and not like each other; each shares half of its buckets."""
    r = random.Random(1)
    copies = list(range(1, 201))
    members = [[500, *[c for c in copies if r.random() < 0.5]] for _ in range(16)]
    got, tested = resolved(spark, members, lambda a, b: 500 in (a, b))
    assert {got[c] for c in copies} == {1} and got[500] == 1 and tested < 300


def test_every_pair_of_a_bucket_is_decided(spark):
    """Several components in one bucket, and links that only one pair of them has."""
    r = random.Random(2)
    members = [list(range(60)), [*range(40, 90)], [3, 80]]
    links = {tuple(sorted(r.sample(m, 2))) for m in members for _ in range(20)}
    got, tested = resolved(spark, members, lambda a, b: (a, b) in links)
    assert got == brute(links)
    assert tested <= sum(len(m) * (len(m) - 1) // 2 for m in members)


def recorded(monkeypatch):
    """The steps that are stored from now on, with their plans."""
    steps, settle = {}, Workspace.settle

    def run(self, df, step, *args, **kwargs):
        steps[step] = df._jdf.queryExecution().optimizedPlan().toString()
        return settle(self, df, step, *args, **kwargs)

    monkeypatch.setattr(Workspace, "settle", run)
    return steps


def test_a_chain_inside_one_task_needs_one_round(spark, monkeypatch):
    steps = recorded(monkeypatch)
    links = [(i, i + 1) for i in range(300)]
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {x["node"]: x["root"] for x in got.collect()} == dict.fromkeys(range(301), 0)
    assert "points0" in steps and "points1" not in steps


def test_both_sides_of_a_round_are_written_by_few_tasks(spark, monkeypatch):
    """Descriptions of a skewed bucket come from as many tasks as there is work for, not from all shuffle partitions."""
    steps = recorded(monkeypatch)
    links = {(i, 80 + i) for i in range(80)}
    got, tested = resolved(spark, [list(range(160))], lambda a, b: (a, b) in links)
    assert got == brute(links) and tested <= 160 * 159 // 2
    assert steps["pairs1"].count("Repartition") >= 2 and "one1" not in steps

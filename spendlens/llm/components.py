"""Connected components of a table of links, by contraction.

First each task replaces the links it reads by a forest of stars, so that chains inside
one task need no rounds. Every round each node points to the neighbour (or itself) that comes first,
links are moved to the nodes pointed at, and links inside one node go. In every
other round nodes come in their own order, which folds a group around its
smallest node at once; in between in a hashed order, so that chains of any order
shrink by a constant factor and the number of rounds is logarithmic. Links and pointers of a round are stored in
the shared folder; nothing but a count reaches the driver. Minima are combined
before they are shuffled, so a node with a third of all links is no hot task.
Stored tables are read by as many tasks as their bytes ask for: a table of few links
is contracted in one task without any exchange, a large one by many.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import Workspace

#: Stored bytes of pairs, some ten thousand, that are verified at once.
FEW = 1 << 19


def _stars(batches):
    """Links ``a, b`` of one task as stars: each node with the smallest it is connected to here."""
    root: dict = {}

    def find(x):
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    schema = None
    for batch in batches:
        schema = batch.schema
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    found = [(top, x) for x in list(root) if (top := find(x)) != x]
    for at in range(0, len(found), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(side, f.type) for side, f in zip(zip(*found[at : at + 50_000]), schema)], schema=schema)


def components(links: DataFrame, a: str = "a", b: str = "b", tasks: int | None = None) -> DataFrame:
    """``node, root`` for every node that has a link; root is the smallest node of its component.

    ``tasks`` limits the tasks that gather the links, if the caller knows them to be few.
    """
    ws = Workspace(links.sparkSession, "components")
    edges = ws.settle(
        links.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges", fit=True, tasks=tasks
    )
    if not edges.isEmpty():
        edges, whole = ws.settle(edges.mapInArrow(_stars, edges.schema), "stars", fit=True), edges
        ws.drop(whole)
    hops, k = [], 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct((F.xxhash64(F.lit(k), c) if k % 2 else F.lit(0).cast("long")).alias("p"), F.col(c).alias("n"))
        points = ws.settle(
            both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("m"))
            .select("node", F.least("m", rank("node"))["n"].alias("to")),
            f"points{k}", fit=True, tasks=ws.tasks(edges, per=1 << 20),
        )
        hops.append(points)
        moved = (
            edges.join(points.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(points.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        )
        edges, last = ws.settle(moved, f"edges{k}", fit=True, tasks=ws.tasks(edges, per=1 << 20)), edges
        ws.drop(last)
        k += 1
    ws.drop(edges)
    if not hops:
        return links.select(F.col(a).alias("node"), F.col(a).alias("root")).limit(0)
    end = hops[-1]
    for points in reversed(hops[:-1]):  # follow the pointers from the last round back
        after = end.select(F.col("node").alias("to"), F.col("to").alias("end"))
        end = points.join(after, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    end = ws.settle(end, "ends", fit=True, tasks=ws.tasks(*hops, per=1 << 20))
    ws.drop(*hops)
    least = end.groupBy("to").agg(F.min("node").alias("root"))
    return end.join(least, "to").select("node", "root")


def merged(ws: Workspace, classes: DataFrame, links: DataFrame, step: str) -> DataFrame:
    """``key, root`` of the components that ``classes`` and new links form together, stored.

    Only the links' ends are contracted, as the roots of what they belong to.
    """
    root = lambda c: classes.select(F.col("key").alias(c), F.col("root").alias(f"{c}_root"))
    ends = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    few = ws.tasks(links, per=1 << 20)
    found = ws.settle(components(ends, tasks=few).withColumnRenamed("root", "end"), f"{step}-found", fit=True, tasks=few)
    old = classes.join(found, classes["root"] == found["node"], "left").select("key", F.coalesce("end", "root").alias("root"))
    new = found.join(classes, found["node"] == classes["key"], "left_anti").select(F.col("node").alias("key"), F.col("end").alias("root"))
    out = ws.settle(old.unionByName(new), step, fit=True, tasks=ws.tasks(classes, found, per=1 << 20))
    ws.drop(found)
    return out


def resolve(
    ws: Workspace,
    nodes: DataFrame,
    buckets: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    near: Callable[[str, str], Column] | None = None,
    first: Callable[[str, str], Column] | None = None,
) -> DataFrame:
    """``key, root`` of the keys that are linked, given ``bucket, key`` of all candidates.

    ``verify`` takes pairs ``a, b`` (a < b) and returns those that are links.
    ``near`` is a cheap test that links pass, on columns of ``nodes`` (by key) with
    the two given prefixes; ``first`` is true in one of the buckets that two keys
    share and may use the bucket's other columns, given without prefix.

    Every two keys of a bucket are decided or end in one component, but not as all
    pairs: first each key with the one that meets most others in all its buckets, which
    is the middle of a star of copies that are like it and not like each other. This
    is done in an eighth of the buckets and then, where the two are not in one component yet, in the others. That leader is
    done, and buckets that still hold several components take more leaders (64,
    2048, ... expected, up to all): those outside the bucket's largest component, where
    they are no more than that, as every two components have one there; else any. Where there
    are many pairs, of those between the same two components one is
    verified before the others, which need no test if it is a link. A group of close
    copies is settled by few pairs. Buckets are never gathered: leaders meet their bucket
    by a join that splits, and the cheap test is part of that join. What a round has
    stored goes when the next has read it, but for the pairs without a link.
    """
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    side = lambda x: nodes.select(*[F.col(c).alias(f"{x}_{c}") for c in nodes.columns])
    near = near or (lambda x, y: F.lit(True))
    first = first or (lambda x, y: F.lit(True))
    classes = ws.settle(nodes.select("key", F.col("key").alias("root")).limit(0), "classes", fit=True)
    unlinked: list[DataFrame] = []

    def tried(pairs: DataFrame, step: str) -> None:
        """Verifies stored pairs and takes the links into the classes."""
        nonlocal classes
        links = ws.settle(verify(pairs.select("a", "b")), f"links-{step}", fit=True, tasks=ws.tasks(pairs, per=1 << 16))  # some thousand pairs a task
        unlinked.append(ws.settle(pairs.select("a", "b").join(links, ["a", "b"], "left_anti"), f"unlinked-{step}", fit=True, tasks=ws.tasks(pairs, per=1 << 20)))
        if not links.isEmpty():
            after = merged(ws, classes, links, f"classes-{step}")
            ws.drop(classes)
            classes = after
        ws.drop(links)

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs ``a, b`` that are in different components, with their roots in order."""
        root = lambda c: classes.select(F.col("key").alias(c), F.col("root").alias(f"{c}_root"))
        known = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").withColumns({f"{c}_root": F.coalesce(f"{c}_root", c) for c in "ab"})
        return known.filter("a_root <> b_root").select("a", "b", F.least("a_root", "b_root").alias("lo"), F.greatest("a_root", "b_root").alias("hi"))

    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = ws.settle(buckets.join(sizes, "bucket"), "met", fit=True)
    weight = met.groupBy("key").agg(F.sum("size").alias("weight"))
    leaders_of = met.join(weight, "key").groupBy("bucket").agg(F.max(F.struct("weight", "key"))["key"].alias("leader"))
    led = ws.settle(met.drop("size").join(leaders_of, "bucket").filter("key <> leader"), "led", fit=True)
    ws.drop(met)
    early = F.pmod(F.xxhash64("bucket"), F.lit(8)) == 0
    for step, chosen in (("early", early), ("led", ~early)):
        at_leader = led.filter(chosen).select(*ordered("leader", "key")).distinct()
        pairs = ws.settle(
            apart(at_leader).select("a", "b").join(side("x"), F.col("b") == F.col("x_key"))
            .join(side("y"), (F.col("a") == F.col("y_key")) & near("x", "y")).select("a", "b"),
            f"pairs-{step}", fit=True, tasks=ws.tasks(led, per=1 << 20),
        )
        tried(pairs, step)
        ws.drop(pairs)

    left, k = led.drop("leader"), 0
    while True:
        named = left.join(classes, "key", "left").withColumn("root", F.coalesce("root", "key"))
        rooted = named.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
        open_ = rooted.groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("top")).filter(F.col("size") > F.col("top.n"))
        k += 1
        most = 64.0 * 32.0 ** (k - 1)
        draw = F.shiftrightunsigned(F.xxhash64(F.lit(k), "key"), 11) / F.lit(float(1 << 53))
        leads = F.when(F.col("size") - F.col("top.n") <= most, F.col("root") != F.col("top.root")).otherwise(draw < F.lit(most) / F.col("size"))
        now = ws.settle(
            named.join(open_, "bucket").withColumn("leads", leads).drop("size", "top"),
            f"open{k}", fit=True, tasks=ws.tasks(led, per=1 << 20),
        )
        ws.drop(led)
        led = now
        if now.isEmpty():
            ws.drop(now, *unlinked)
            return classes
        # few tasks write both sides: a skewed bucket is cut along them, and the cuts of both sides are multiplied
        cut = ws.tasks(now, per=1 << 18)
        wide = now.join(side("x"), F.col("key") == F.col("x_key")).drop("key").coalesce(cut)
        leaders = (
            now.filter("leads").select("bucket", "key", F.col("root").alias("lead_root"), F.lit(True).alias("led"))
            .join(side("y"), F.col("key") == F.col("y_key")).drop("key").coalesce(cut)
        )
        # of two leaders, the pair is made once
        once = ~F.col("leads") | (F.col("x_key") < F.col("y_key"))
        fresh = (
            wide.alias("w").join(leaders.alias("l"), (F.col("w.bucket") == F.col("l.bucket")) & (F.col("root") != F.col("lead_root")) & once & first("x", "y") & near("x", "y"))
            .select(*ordered("x_key", "y_key"), F.least("root", "lead_root").alias("lo"), F.greatest("root", "lead_root").alias("hi")).distinct()
        )
        fresh = fresh.join(reduce(DataFrame.unionByName, unlinked), ["a", "b"], "left_anti")
        fresh = ws.settle(fresh, f"pairs{k}", fit=True, tasks=ws.tasks(now, per=1 << 18))
        left = now.filter("not leads").drop("root", "leads")
        if ws.paths[id(fresh)][2] < FEW:
            tried(fresh, f"all{k}")
            ws.drop(fresh)
            continue
        one = fresh.groupBy("lo", "hi").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")
        one = ws.settle(one, f"one{k}", fit=True, tasks=ws.tasks(fresh, per=1 << 20))
        tried(one, f"one{k}")
        rest = ws.settle(apart(fresh.select("a", "b")).select("a", "b").join(one, ["a", "b"], "left_anti"), f"rest{k}", fit=True, tasks=ws.tasks(fresh, per=1 << 20))
        if not rest.isEmpty():
            tried(rest, f"rest{k}")
        ws.drop(fresh, one, rest)

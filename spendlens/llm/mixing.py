"""Mixing sources to target weights by pivotal rounding of copy probabilities.

A source's target is its weighted share of all words, at most ``CAP`` times its
own words, what is cut off being shared anew by weight. Each document is due
target / source words copies: the whole part is certain, the rest a copy
probability. Pivotal rounding pairs two documents of a source with a fractional
probability and moves word mass from one to the other, in a random direction,
until one of them is integral; expected copies stay as they were, and so do the
words of the pair. A chunk of documents is folded this way to one residual; the
residuals are chunked and folded again, level by level, until each source has
one, which is rounded alone. A source's words miss its target by that one
document at most.

DataFrame functions only. Chunks hold ``CHUNK`` consecutive documents of one
source in hashed order, so a source of any size is spread over all tasks, and
the tree is log(documents) / log(CHUNK) levels deep. Draws are hashes of the
document's place in that order: reruns agree, whatever the partitioning.

Defined results: a null or empty text has size 0 and is taken with 0 words; a
null source is a source of its own, after all others; a source without words
has target 0; repeated rows are documents of their own; an empty table gives no
rows; other columns pass through, and a column named like a result is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import Workspace, aside, numbered, ranked, text_or_empty, unit_hash

CHUNK = 64
CAP = 3
SEED = 71
RESULTS = ["size", "source_size", "target", "copies", "taken"]


def word_count(name: str = "text"):
    return F.regexp_count(text_or_empty(name), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """One row for each source: words, weight, target and its place in code point order.

    One row for each source is all that meets in one task, as the sharing needs.
    The excess is shared by level filling: with sources in order of limit over
    weight, those before some place are full and the rest share what is left.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("at", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("at") - 1, F.lit(len(weights))) + 1).cast("int"))
    )
    limit = (cap * F.col("source_size")).cast("double")
    every = Window.orderBy(limit / F.col("weight"), "at")
    past = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    filled = per.withColumns(
        {
            "limit": limit,
            "full_before": F.coalesce(F.sum(limit).over(past), F.lit(0.0)),
            "weight_left": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(past), F.lit(0)),
            "all_words": F.sum("source_size").over(whole).cast("double"),
        }
    )
    level = (F.col("all_words") - F.col("full_before")) / F.col("weight_left")
    # the first source that isn't full at its level sets the level of all after it
    own = F.when(F.col("limit") >= level * F.col("weight"), F.struct(limit / F.col("weight"), F.col("at"), level.alias("level")))
    settled = filled.withColumn("level", F.min(own).over(whole)["level"])
    return settled.select(
        "source", "source_size", F.col("at").cast("long").alias("at"),
        F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"),
    )


def _pair(held, new, draw):
    """Moves word mass between two fractional documents until one is integral.

    Both are structs (id, size, p) with 0 < p < 1 and size > 0. Mass may go to
    ``new`` (a words) or to ``held`` (b words); going to new with probability
    b / (a + b) keeps both expectations. Returns (the one left, id and copy of
    the one settled); an equal end settles both, the one left then has p 0 or 1.
    """
    a = F.least(held["p"] * held["size"], (1 - new["p"]) * new["size"])
    b = F.least((1 - held["p"]) * held["size"], new["p"] * new["size"])
    to_new = draw * (a + b) < b
    held_empty = held["p"] * held["size"] <= (1 - new["p"]) * new["size"]
    held_full = (1 - held["p"]) * held["size"] <= new["p"] * new["size"]
    settles_held = F.when(to_new, held_empty).otherwise(held_full)
    held_p = F.when(to_new, F.when(held_empty, 0.0).otherwise(held["p"] - a / held["size"])).otherwise(
        F.when(held_full, 1.0).otherwise(held["p"] + b / held["size"])
    )
    new_p = F.when(to_new, F.when(held_empty, new["p"] + a / new["size"]).otherwise(1.0)).otherwise(
        F.when(held_full, new["p"] - b / new["size"]).otherwise(0.0)
    )
    one = lambda d, p: F.struct(d["id"].alias("id"), d["size"].alias("size"), p.alias("p"))
    left = F.when(settles_held, one(new, new_p)).otherwise(one(held, held_p))
    done = F.when(settles_held, F.struct(held["id"].alias("id"), held_p.cast("int").alias("copy"))).otherwise(
        F.struct(new["id"].alias("id"), new_p.cast("int").alias("copy"))
    )
    return left, done


def _fold(items, seed: int, level: int):
    """Folds an array of fractional documents: (the residual or null, the settled)."""
    first = items[0]

    def step(state, new):
        held = state["held"]
        draw = unit_hash(seed, level, held["id"], new["id"])
        left, done = _pair(held, new, draw)
        settled_new = (held["p"] <= 0) | (held["p"] >= 1)
        return F.struct(
            F.when(settled_new, new).otherwise(left).alias("held"),
            F.concat(
                state["done"],
                F.array(F.when(settled_new, F.struct(held["id"].alias("id"), F.round(held["p"]).cast("int").alias("copy"))).otherwise(done)),
            ).alias("done"),
        )

    start = F.struct(first.alias("held"), F.slice(F.transform(items, lambda x: F.struct(x["id"].alias("id"), F.lit(0).alias("copy"))), 1, 0).alias("done"))
    return F.aggregate(F.slice(items, 2, F.lit(1 << 30)), start, step)


def pivotal(ws: Workspace, due: DataFrame, seed: int = SEED) -> DataFrame:
    """Copies (0 or 1) of fractional documents ``source_at, at, id, size, p``.

    ``at`` numbers a source's documents without gaps. Returns ``id, copy``.
    """
    done, level, now = None, 0, due
    while True:
        chunked = now.groupBy("source_at", F.floor(F.col("at") / CHUNK).alias("at")).agg(
            F.sort_array(F.collect_list(F.struct("id", "size", "p"))).alias("items")
        )
        folded = ws.settle(
            chunked.select("source_at", "at", _fold(F.col("items"), seed, level).alias("s")), f"level{level}"
        )
        part = folded.select(F.explode("s.done").alias("d")).select("d.id", "d.copy")
        done = part if done is None else done.unionByName(part)
        now = folded.select("source_at", "at", "s.held.*")
        if not now.filter(F.col("at") > 0).limit(1).count():
            last = now.select("id", (unit_hash(seed, "last", "id") < F.col("p")).cast("int").alias("copy"))
            return done.unionByName(last)
        level += 1


def mix(
    documents: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    cap: int = CAP,
    seed: int = SEED,
    keep: list[str] | None = None,
    stored: bool = False,
) -> DataFrame:
    """Adds size, source_size, target, copies and taken (copies x size) to each document.

    ``keep`` names the columns to return beside the results (default: all);
    ``stored`` says that the rows are a plain scan of files.
    """
    ws = Workspace(documents.sparkSession, "mixing")
    plain, back = aside(documents)
    names = [c for c in (documents.columns if keep is None else keep) if c not in RESULTS]
    names = [{old: new for new, old in back.items()}.get(c, c) for c in names]
    source = numbered(ws, plain, stored)
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), text_or_empty()).alias("__order")
    narrow = ws.settle(
        source.select("__rid", F.col("source").alias("__source"), F.col("doc_id").alias("__doc"), order, word_count().alias("size")), "narrow"
    )
    # numbered within all sources together; a source's first number is its offset
    placed = ranked(ws, narrow, [F.col("__source").asc_nulls_last(), "__order", "__doc"], "__id")
    goal = targets(placed.select(F.col("__source").alias("source"), "size"), weights, cap)
    first = placed.groupBy("__source").agg(F.min("__id").alias("__first"))
    goal = goal.join(first, F.col("source").eqNullSafe(F.col("__source"))).select(
        F.col("__source").alias("__s"), "at", "source_size", "target", "__first"
    )
    goal = ws.settle(goal, "goal")  # one row for each source
    ws.drop(narrow)
    all_rows = placed.join(goal, F.col("__source").eqNullSafe(F.col("__s"))).withColumn(
        "__rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )
    part = F.col("__rate") - F.floor("__rate")
    due = all_rows.filter((F.col("size") > 0) & (part > 0)).select(
        F.col("at").alias("source_at"), (F.col("__id") - F.col("__first")).alias("at"), F.col("__id").alias("id"),
        F.col("size").cast("double").alias("size"), part.alias("p"),
    )
    copy = ws.settle(pivotal(ws, due, seed), "copies")
    out = all_rows.join(copy, F.col("__id") == F.col("id"), "left").withColumn(
        "copies", F.floor("__rate").cast("long") + F.coalesce(F.col("copy"), F.lit(0))
    )
    results = ["size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")]
    if set(names) <= {"doc_id", "source"}:
        return out.select(*[F.col({"doc_id": "__doc", "source": "__source"}[c]).alias(c) for c in names], *results)
    mixed = out.select(F.col("__rid").alias("__row"), *results)
    return source.select("__rid", *names).join(mixed, F.col("__rid") == F.col("__row")).select(*names, *RESULTS).withColumnsRenamed(back)

"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line; a longer line is cut at the first space after ``PIECE``
characters. A document is the set of its paragraphs' 64-bit digests. Its sketch
has three tables of ``CELLS`` cells; a digest falls in one cell of each and adds
1 to its count, itself to its key (xor) and its check to its check (xor). The
sketch of equal size, written out cell by cell, is the fingerprint.

Two versions are compared by subtracting cell from cell: what both have cancels.
A cell that holds one digest (count 1 or -1, check right, at its place) gives it
away; it is taken out of the other two tables, which lays more cells open. Tables
take turns, so a digest is found by one cell at a time. When cells stay closed,
the pair is done again with a larger sketch from the digests: two cells for each
paragraph of both, then four, eight ... The likeness of the two is common digests
over all digests.

DataFrame functions only. Digests are laid out by document once; cells, waves of
peeling and sums are grouped below the document, so none of them is exchanged
again. The next document is found in ranges of doc_id of equal size whose first
row is also sent to the range before, so whole texts are exchanged once and no
task holds more than its range.

Defined results: a null text is the empty text; texts without paragraphs are
alike (1.0); null ids come last; documents of equal doc_id are ordered by text;
repeated rows are documents of their own; the next document of the last is the
first (of a single document: itself); an empty table gives no rows.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import Workspace, ranked, text_or_empty

PIECE = 100
CELLS = 8
WAVES = 15
ATTEMPTS = 12


def digests(text: Column) -> Column:
    """Distinct digests of a text's paragraphs."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[^\n]{{{PIECE},}}?[ ]|[^\n]+"), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def check(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit("check")), 32)


def place(key: Column, j: int, cells: Column) -> Column:
    """The cell of a digest in table ``j``, numbered through all three tables."""
    return F.pmod(F.xxhash64(F.lit(j), key, cells), cells) + j * cells


def _sums() -> list[Column]:
    return [F.sum("c").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h")]


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cells ``keys, cell, c, k, h`` of rows ``keys, cells, sign, set`` (an array of digests)."""
    key = rows.select(*keys, "cells", "sign", F.explode("set").alias("k"))
    cell = F.explode(F.array(*[place(F.col("k"), j, F.col("cells")) for j in range(3)])).alias("cell")
    spread = key.select(*keys, "cells", "sign", "k", cell)
    return (
        spread.select(*keys, "cells", "cell", F.col("sign").alias("c"), "k", check(F.col("k")).alias("h"))
        .groupBy(*keys, "cells", "cell").agg(*_sums())
    )


def peel(cells: DataFrame, keys: list[str], name_found: bool = False, waves: int = WAVES) -> DataFrame:
    """Takes lone digests out of subtracted cells, one table after the other.

    Returns cells that stay closed (cell >= 0) and what was found: cell -1 for
    digests of the first version, -2 for those of the second; ``c`` counts them,
    and with ``name_found`` there is one row for each, the digest in ``id``.
    """
    now = cells.withColumn("id", F.lit(0).cast("long")).filter("c <> 0 or k <> 0 or h <> 0")
    fields = lambda cell, c, k, h, i: F.struct(
        cell.cast("long").alias("cell"), c.cast("long").alias("c"), k.alias("k"), h.alias("h"), i.alias("id")
    )
    zero = F.lit(0).cast("long")
    for w in range(waves):
        j = w % 3
        c, k, h, at = F.col("c"), F.col("k"), F.col("h"), F.col("cell")
        lone = (at >= 0) & (F.abs(c) == 1) & (F.floor(at / F.col("cells")) == j) & (h == check(k)) & (at == place(k, j, F.col("cells")))
        found = fields(F.when(c > 0, -1).otherwise(-2), F.lit(1), zero, zero, k if name_found else zero)
        out = [fields(place(k, o, F.col("cells")), -c, k, h, zero) for o in range(3) if o != j]
        moved = now.select(
            *keys, "cells", F.explode(F.when(lone, F.array(found, *out)).otherwise(F.array(fields(at, c, k, h, F.col("id"))))).alias("x")
        ).select(*keys, "cells", "x.*")
        now = moved.groupBy(*keys, "cells", "cell", "id").agg(*_sums()).filter("cell < 0 or c <> 0 or k <> 0 or h <> 0")
    return now


def differences(first: DataFrame, second: DataFrame, by: str, cells: int = CELLS) -> DataFrame:
    """``by, digest, side`` of paragraphs that one version alone has (side 1 or 2); side 0: did not peel.

    ``first`` and ``second`` have ``by`` and ``text``.
    """
    side = lambda df, s: df.select(F.col(by).alias("row"), F.lit(cells).cast("long").alias("cells"), F.lit(s).alias("sign"), digests(text_or_empty()).alias("set"))
    both = side(first, 1).unionByName(side(second, -1)).repartition("row")
    left = peel(sketch(both, ["row"]), ["row"], name_found=True)
    return left.select(F.col("row").alias(by), F.when(F.col("cell") < 0, F.col("id")).alias("digest"), F.when(F.col("cell") == -1, 1).when(F.col("cell") == -2, 2).otherwise(0).alias("side")).distinct()


def with_next(ws: Workspace, documents: DataFrame) -> DataFrame:
    """``doc_id, text, set, next_text, next_set`` of every document."""
    text = text_or_empty()
    key = F.struct(F.col("doc_id").isNull().cast("int").alias("n"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("d"), F.xxhash64(text).alias("h"))
    rows = documents.select("doc_id", text.alias("text"), key.alias("key"))
    order = ranked(ws, rows.select("key"), ["key"])
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = max(1, math.ceil(order.count() / parts))
    firsts = sorted({tuple(r["key"]) for r in order.filter(F.col("__rank") % step == 0).select("key").collect()})  # one for each range
    if not firsts:
        firsts = [(0, 0, 0)]
    bounds = F.from_json(
        F.lit(json.dumps([{"n": n, "d": d, "h": h} for n, d, h in firsts])), "array<struct<n:int,d:bigint,h:bigint>>"
    )
    steps = max(1, len(firsts)).bit_length() + 1
    span = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.lit(0).alias("lo"), F.lit(len(firsts)).alias("hi")),
        lambda s, _: F.when(
            F.get(bounds, F.floor((s["lo"] + s["hi"]) / 2).cast("int")) <= F.col("key"),
            F.struct(F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("lo"), s["hi"].alias("hi")),
        ).otherwise(F.struct(s["lo"].alias("lo"), F.greatest(s["lo"] + 1, F.floor((s["lo"] + s["hi"]) / 2).cast("int")).alias("hi"))),
    )["lo"]
    ranged = rows.withColumn("range", span)
    last = len(firsts) - 1
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("after"))
    before = F.struct(F.when(F.col("range") == 0, last).otherwise(F.col("range") - 1).alias("range"), F.lit(1).alias("after"))
    sent = ranged.select(
        "doc_id", "text", "key",
        F.explode(F.when(F.col("key") == F.get(bounds, F.col("range")), F.array(own, before)).otherwise(F.array(own))).alias("x"),
    ).select("doc_id", "text", "key", "x.*")
    beside = Window.partitionBy("range").orderBy("after", "key")
    sent = sent.repartition(parts, "range").withColumn("set", digests(F.col("text")))
    return sent.select(
        "doc_id", "text", "set", "after",
        F.lead("text").over(beside).alias("next_text"), F.lead("set").over(beside).alias("next_set"),
    ).filter("after = 0").drop("after")


def edited(n: Column, text: Column, after: Column) -> Column:
    """The last quarter of the text replaced by the beginning of the next one."""
    q = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n - q).cast("int")), F.substring(after, F.lit(1), q))


def _pairs(sets: DataFrame, cells: Column) -> DataFrame:
    """Signed rows ``row, pair, cells, sign, set`` of the pairs named in ``again``."""
    side = lambda p, s, c: F.struct(F.lit(p).alias("pair"), F.lit(s).alias("sign"), F.col(c).alias("set"))
    each = F.array(side("edited", 1, "set"), side("edited", -1, "edited_set"), side("next", 1, "set"), side("next", -1, "next_set"))
    asked = F.filter(each, lambda x: F.array_contains(F.col("again"), x["pair"]))
    return sets.select("row", cells.cast("long").alias("cells"), F.explode(asked).alias("x")).select("row", "cells", "x.*")


def _count(peeled: DataFrame) -> DataFrame:
    """Digests found of each pair, and cells still closed."""
    return peeled.groupBy("row", "pair").agg(
        F.sum(F.when(F.col("cell") < 0, F.col("c")).otherwise(0)).alias("found"),
        F.sum(F.when(F.col("cell") >= 0, 1).otherwise(0)).alias("closed"),
    )


def fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness to it and to the next document's."""
    ws = Workspace(documents.sparkSession, "fingerprint")
    n = F.char_length("text").cast("long")
    both = with_next(ws, documents).withColumn("edited", edited(n, F.col("text"), F.col("next_text")))
    sets = ws.settle(
        both.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", n.alias("n_chars"),
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            "set", digests(F.col("edited")).alias("edited_set"), "next_set",
        ),
        "sets",
    )
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_row = sets.repartition(parts, "row")
    version = lambda v, c: F.struct(F.lit(v).alias("version"), F.col(c).alias("set"))
    versions = by_row.select(
        "row", F.lit(CELLS).cast("long").alias("cells"), F.lit(1).alias("sign"),
        F.explode(F.array(version(0, "set"), version(1, "edited_set"), version(2, "next_set"))).alias("x"),
    ).select("row", "cells", "sign", "x.*")
    base = ws.settle(sketch(versions, ["row", "version"]), "base")

    # subtract the sketches of the versions, cell by cell
    pair = lambda p, s: F.struct(F.lit(p).alias("pair"), F.lit(s).alias("sign"))
    of_version = (
        F.when(F.col("version") == 0, F.array(pair("edited", 1), pair("next", 1)))
        .when(F.col("version") == 1, F.array(pair("edited", -1))).otherwise(F.array(pair("next", -1)))
    )
    subtracted = (
        base.repartition(parts, "row").select("row", "cells", "cell", "c", "k", "h", F.explode(of_version).alias("x"))
        .select("row", "x.pair", "cells", "cell", (F.col("c") * F.col("x.sign")).alias("c"), "k", "h")
        .groupBy("row", "pair", "cells", "cell").agg(*_sums())
    )
    known = ws.settle(_count(peel(subtracted, ["row", "pair"])), "found0")
    done, failed = known.filter("closed = 0"), known.filter("closed > 0").select("row", "pair")
    held = [known]
    for k in range(1, ATTEMPTS + 1):
        if not failed.limit(1).count():
            break
        again = failed.groupBy("row").agg(F.collect_set("pair").alias("again")).join(sets, "row")
        # two cells for each paragraph of both versions at first, spread over three tables
        larger = F.ceil((F.size("set") + F.greatest(F.size("edited_set"), F.size("next_set"))) * (2.0**k / 3)) + 4
        redo = peel(sketch(_pairs(again, larger), ["row", "pair"]), ["row", "pair"])
        got = ws.settle(_count(redo), f"found{k}")
        held.append(got)
        done, failed = done.unionByName(got.filter("closed = 0")), got.filter("closed > 0").select("row", "pair")
    else:
        if failed.limit(1).count():
            raise RuntimeError("a sketch did not open at any size")
    found = done.groupBy("row").agg(*[F.sum(F.when(F.col("pair") == p, F.col("found"))).alias(f"found_{p}") for p in ("edited", "next")])

    cell = F.concat_ws(":", "cell", "c", F.hex("k"), F.hex("h"))
    written = lambda v: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("version") == v, F.struct("cell", cell.alias("s"))))), lambda x: x["s"]), ",")
    strings = base.groupBy("row").agg(written(0).alias("own"), written(1).alias("changed"))
    out = sets.join(strings, "row", "left").join(found, "row", "left")
    text = lambda count, cells: F.concat(F.size(count).cast("string"), F.lit("|"), F.coalesce(cells, F.lit("")))

    def near(other: str, different: str) -> Column:
        total, apart = F.size("set") + F.size(other), F.coalesce(different, F.lit(0))
        return F.when(total == 0, 1.0).otherwise((total - apart) / (total + apart)).cast("double")

    return out.select(
        "doc_id", "n_chars", "edited_sha256", text("set", F.col("own")).alias("fingerprint"),
        text("edited_set", F.col("changed")).alias("edited_fingerprint"),
        near("edited_set", "found_edited").alias("near_edited"), near("next_set", "found_next").alias("near_next"),
    )

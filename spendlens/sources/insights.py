"""Landed insight rows (nested JSON) to tidy pass tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.scalars import half_even_long, tolerant_date, tolerant_double
from spendlens.schema import (
    DELIVERY_METRICS,
    ENTITY_COLUMNS,
    FUNNEL_ACTIONS,
    PassSpec,
    insight_schema,
)

RAW_ACTION_SCHEMA = "array<struct<action_type:string,value:string>>"


def read_insights(spark: SparkSession, path, breakdowns=None) -> DataFrame:
    """JSON lines with a pinned schema; unreadable fields turn null."""
    schema = insight_schema() if breakdowns is None else insight_schema(breakdowns)
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def valid_actions(actions) -> Column:
    """Entries with a type and a numeric value, as an array of (key, value)."""
    typed = F.transform(
        actions, lambda e: F.struct(e["action_type"].alias("key"), tolerant_double(e["value"]).alias("value"))
    )
    return F.filter(
        typed, lambda e: e["key"].isNotNull() & (e["key"] != "") & e["value"].isNotNull()
    )


def action_index(actions) -> Column:
    """Action list as a map; of duplicate types the last entry wins.

    Earlier duplicates are removed before the map is built, so the result does
    not depend on the session's map-key policy; lists without any skip that step.
    """
    entries = valid_actions(actions)
    keys = F.transform(entries, lambda e: e["key"])
    last_only = F.filter(
        F.transform(entries, lambda e, i: F.struct(e.alias("e"), i.alias("i"))),
        lambda p: ~F.exists(
            F.slice(entries, p["i"] + 2, F.greatest(F.size(entries) - p["i"] - 1, F.lit(0))),
            lambda later: later["key"] == p["e"]["key"],
        ),
    )
    unique = F.size(F.array_distinct(keys)) == F.size(keys)
    return F.map_from_entries(
        F.when(unique, entries).otherwise(F.transform(last_only, lambda p: p["e"]))
    )


def action_value(actions, action: str) -> Column:
    """Value of the last valid entry of one action type, null when absent."""
    hits = F.filter(valid_actions(actions), lambda e: e["key"] == action)
    return F.try_element_at(hits, F.lit(-1))["value"]


def pivot_actions(df: DataFrame, keys, actions: str = "actions") -> DataFrame:
    """Long-form pivot: one column per action type, summed over rows of a key."""
    long = df.select(*keys, F.explode(valid_actions(F.col(actions))).alias("a"))
    return (
        long.select(*keys, "a.key", "a.value")
        .groupBy(*keys)
        .pivot("key", list(FUNNEL_ACTIONS))
        .agg(F.sum("value"))
    )


def raw_payload(actions) -> Column:
    return F.when(F.size(actions) > 0, F.to_json(actions, {"ignoreNullFields": "false"}))


def recovered_actions(df: DataFrame, raw: str = "actions_raw") -> DataFrame:
    """Explode the kept payload again: every action type, planned for or not."""
    parsed = F.from_json(raw, RAW_ACTION_SCHEMA)
    return df.select("*", F.explode(parsed).alias("__a")).select(
        "*", F.col("__a.action_type").alias("action_type"), tolerant_double("__a.value").alias("value")
    ).drop("__a")


def flatten(df: DataFrame, spec: PassSpec, keep=()) -> DataFrame:
    """Insight rows to the tidy columns of a pass, with pinned types; ``keep`` stays as it is."""
    counts = action_index(F.col("actions"))
    amounts = action_index(F.col("action_values"))
    staged = df.withColumns({"__counts": counts, "__amounts": amounts})
    columns = [F.lit(spec.name).alias("pass_name"), tolerant_date("date_start").alias("date")]
    columns += [F.col(c) for c in ENTITY_COLUMNS]
    columns += [tolerant_double(c).alias(c) for c in DELIVERY_METRICS]
    for action in FUNNEL_ACTIONS:
        columns += [
            half_even_long(F.try_element_at("__counts", F.lit(action))).alias(action),
            F.try_element_at("__amounts", F.lit(action)).alias(f"{action}_value"),
        ]
    columns += [F.col(b) for b in spec.breakdowns]
    return staged.select(*columns, raw_payload(F.col("actions")).alias("actions_raw"), *keep)

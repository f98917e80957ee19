"""Registration of checked queries: a Spark callable and, where possible, its SQL twin.

Output conventions shared by both sides: bigint integers, dates as ISO text,
doubles rounded where the order of a sum may change the last bits.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _spark_side(df, dp, dates):
    changes = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            changes[field.name] = F.col(f"`{field.name}`").cast("bigint")
    for name, digits in dp.items():
        changes[name] = F.round(F.col(f"`{name}`"), digits) + F.lit(0.0)
    for name in dates:
        changes[name] = F.col(f"`{name}`").cast("date").cast("string")
    return df.withColumns(changes) if changes else df


def _sql_side(sql, dp, dates):
    if not dp and not dates:
        return sql
    parts = [f'round("{n}", {d}) + CAST(0 AS DOUBLE) AS "{n}"' for n, d in dp.items()]
    parts += [f'CAST(CAST("{n}" AS DATE) AS VARCHAR) AS "{n}"' for n in dates]
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM (\n{sql}\n) AS checked"


def query(key: str, sql: str | None = None, dp: dict | None = None, dates=()):
    """Decorator: register a (spark, sf_dir) -> DataFrame function under ``key``."""
    dp = dp or {}

    def wrap(fn):
        def run(spark, sf_dir):
            return _spark_side(fn(spark, sf_dir), dp, dates)

        if key in QUERIES:
            raise KeyError(f"duplicate query {key}")
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = _sql_side(sql, dp, dates)
        return fn

    return wrap

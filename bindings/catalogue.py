"""Collects every registered query. Importing a module registers its queries."""

from __future__ import annotations

from bindings import registry
from bindings import q_ingest, q_funnel, q_stats, q_segments, q_triage, q_creative, q_star  # noqa: F401
from spendlens.operators.sharing import release


def queries() -> dict:
    def runner(fn):
        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            release()  # tables kept by the previous query
            return fn(spark, sf_dir)

        return run

    return {key: runner(fn) for key, fn in registry.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)

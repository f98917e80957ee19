"""Intermediate tables that several branches of one plan read.

Without this, column pruning gives every branch its own copy of the upstream
work. The tables are kept with MEMORY_AND_DISK; a lost executor recomputes its
blocks from the lineage. A ``session.scope`` owns what is kept or stored inside it and
frees it at its end; ``release`` frees what was kept outside of any.
"""

from __future__ import annotations

import weakref

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from spendlens.session import _SCOPES, scratch_path, tidy

_KEPT: list[DataFrame] = []
#: Where the tables that ``settled`` returned are stored.
_STORED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared(df: DataFrame) -> DataFrame:
    """Mark a table as read more than once; evaluated lazily, once."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    (_SCOPES[-1].kept if _SCOPES else _KEPT).append(kept)
    return kept


def release() -> int:
    """Unpersist everything marked so far; returns how many tables were freed."""
    freed = 0
    while _KEPT:
        kept = _KEPT.pop()
        try:
            kept.unpersist()
            freed += 1
        except Exception:  # the session that owned it is gone
            pass
    return freed


def settled(df: DataFrame, name: str, task_bytes: int | None = None) -> DataFrame:
    """Write a pivotal table to the shared scratch folder and go on from the copy.

    Used once per analysis, right after the pass over the large input: later
    steps neither repeat that pass when an executor is lost nor carry its plan.
    With ``task_bytes`` the copy is read by a task for so many stored bytes: passes
    that are made hundreds of times get no more tasks than they have work for.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if task_bytes:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        size = target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
        out = out.coalesce(max(1, -(-size // task_bytes)))
    _STORED[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a copy that ``settled`` returned, once nothing that is still to run reads it."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(_STORED.pop(df))
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

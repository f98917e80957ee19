"""Incremental, resumable ingestion of landed insight files.

Landing layout: ``<landing>/pass=<name>/month=<YYYY-MM>/*.json``. A unit is one
(pass, month). The stream checkpoint remembers which files were taken in, so a
rerun only touches units with new files. A touched unit is rebuilt from all of
its landed files, once a run, and replaces its slice at one moment, hence a retried batch, a late
correction and a unit split over several batches all give the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from spendlens.schema import PASSES, insight_schema
from spendlens.sinks.tables import write_pass
from spendlens.sources.insights import flatten

NOTE = T.StructType([T.StructField(c, T.StringType()) for c in ("pass", "month")])


def _reader(reader, landing: str):
    schema = insight_schema()
    for key in ("pass", "month"):
        schema = schema.add(T.StructField(key, T.StringType()))
    return reader.schema(schema).option("basePath", landing)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def rebuild_units(spark: SparkSession, landing: str, units, root: str) -> None:
    """Rewrite the slices of the given (pass, month) units from their landed files.

    Only the folders of these units are listed and read. A unit replaces its own
    slice and no other: rows stay in the month they landed in, also those dated
    in another month or without a readable date. At most one unit per pass and
    retained month, so ``units`` is a short list.
    """
    unknown = sorted({str(p) for p, _ in units} - set(PASSES))
    if unknown:
        raise ValueError(f"landed files of unknown passes: {', '.join(unknown)}")
    for spec in PASSES.values():
        folders = [f"{landing}/pass={p}/month={m}" for p, m in units if p == spec.name]
        folders = [f for f in folders if _exists(spark, f)]
        if folders:
            rows = _reader(spark.read, landing).json(folders)
            write_pass(flatten(rows, spec, keep=["month"]), root)


def ingest(spark: SparkSession, landing: str, root: str, state: str, files_per_batch: int | None = None):
    """Process everything that has landed since the last call, then stop.

    Batches note which units they touch in ``<state>-units``; after the last one each
    unit is rebuilt once and the notes go. A run that dies before that leaves its notes,
    which the next run takes up, so no landed file is forgotten. Files of an unknown pass
    fail the batch, which leaves them to a later run.
    """
    notes = f"{state}-units"
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def take_in(batch: DataFrame, number: int) -> None:
        touched = batch.select("pass", "month").distinct().collect()  # at most one a pass and month; one reading of the files
        unknown = sorted({str(r["pass"]) for r in touched} - set(PASSES))
        if unknown:
            raise ValueError(f"landed files of unknown passes: {', '.join(unknown)}")
        spark.createDataFrame(touched, NOTE).coalesce(1).write.mode("overwrite").json(f"{notes}/batch={number}")

    query = (
        _reader(reader, landing).json(landing)
        .writeStream.foreachBatch(take_in)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if _exists(spark, notes):
        units = [tuple(r) for r in spark.read.schema(NOTE).json(f"{notes}/*").distinct().collect()]
        rebuild_units(spark, landing, units, root)
        target = spark._jvm.org.apache.hadoop.fs.Path(notes)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return query


def refresh(spark: SparkSession, landing: str, root: str, months, passes=tuple(PASSES)) -> None:
    """Redo the given months of the given passes; every other slice stays as it is."""
    rebuild_units(spark, landing, [(p, m) for p in passes for m in months], root)

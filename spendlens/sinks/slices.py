"""Versioned slices of a table and the manifest that says which of them count.

A slice is a (pass, month) folder. Every write puts its files into a version folder of
their own, ``pass=<p>/month=<m>/v=<version>``, beside what is there, and then publishes a
new manifest by one rename. A reader takes the last manifest and the version folders it
names: before the rename it sees the old slices whole, after it the new ones, and a writer
that dies in between leaves files that nothing names. ``sweep`` removes what no manifest
in use names any more.

The manifest also holds each slice's schema, so that a scan neither lists partition
folders nor opens footers to find out about columns.

One writer at a time is expected for a root; a manifest that has been published
meanwhile makes the second writer fail, not overwrite.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDER = "_manifest"


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, pattern = _fs(spark, f"{root}/{FOLDER}/*.json")
    return sorted(int(f.getPath().getName().split(".")[0]) for f in fs.globStatus(pattern) or [])


def _read(spark: SparkSession, root: str, number: int) -> dict[str, dict]:
    fs, path = _fs(spark, f"{root}/{FOLDER}/{number:012d}.json")
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def manifest(spark: SparkSession, root: str) -> dict[str, dict]:
    """Folder of each slice to its version folder and schema, as last published; empty if never."""
    numbers = _numbers(spark, root)
    return _read(spark, root, numbers[-1]) if numbers else {}


def publish(spark: SparkSession, root: str, slices: dict[str, dict], after: int) -> None:
    """Makes ``slices`` the manifest that follows number ``after``."""
    fs, final = _fs(spark, f"{root}/{FOLDER}/{after + 1:012d}.json")
    _, made = _fs(spark, f"{root}/{FOLDER}/.{uuid.uuid4().hex}.tmp")
    out = fs.create(made, False)
    out.write(bytearray(json.dumps(slices, sort_keys=True).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(made, final):
        fs.delete(made, False)
        raise RuntimeError(f"another writer has published to {root}")


def replace_slices(df: DataFrame, root: str, keys=("pass", "month")) -> list[str]:
    """Writes ``df`` as new versions of exactly the slices it holds; returns their folders."""
    spark = df.sparkSession
    numbers = _numbers(spark, root)
    before = _read(spark, root, numbers[-1]) if numbers else {}
    version = f"b{uuid.uuid4().hex}"
    (
        df.withColumn("v", F.lit(version))
        .hint("rebalance", *[F.col(k) for k in keys])
        .write.mode("append").partitionBy(*keys, "v").parquet(root)
    )
    fs, pattern = _fs(spark, "/".join([root, *[f"{k}=*" for k in keys], f"v={version}"]))
    schema = T.StructType([f for f in df.schema.fields if f.name not in keys]).jsonValue()
    written = {}
    for status in fs.globStatus(pattern) or []:
        parts = status.getPath().toString().split("/")[-len(keys) - 1 :]
        written["/".join(parts[:-1])] = {"folder": "/".join(parts), "schema": schema}
    if written:
        publish(spark, root, {**before, **written}, numbers[-1] if numbers else 0)
    return sorted(written)


def scan(spark: SparkSession, root: str, slices: dict[str, dict]) -> DataFrame:
    """The rows of the named slices; a column that a slice lacks reads as null.

    Slices of one schema are one scan. Where types differ, the scans are cast to the
    wider one: the type of the slice that comes last, or text if one of them is text.
    """
    by_schema: dict[str, list[str]] = {}
    for entry in slices.values():
        by_schema.setdefault(json.dumps(entry["schema"], sort_keys=True), []).append(f"{root}/{entry['folder']}")
    frames, kinds = [], {}
    for text in sorted(by_schema, key=lambda t: max(by_schema[t])):
        schema = T.StructType.fromJson(json.loads(text))
        frames.append(spark.read.schema(schema).option("basePath", root).parquet(*sorted(by_schema[text])).drop("v"))
        for field in schema.fields:
            kinds[field.name] = T.StringType() if isinstance(kinds.get(field.name), T.StringType) else field.dataType
    out = None
    for frame in frames:
        cast = frame.withColumns({f.name: F.col(f"`{f.name}`").cast(kinds[f.name]) for f in frame.schema.fields if f.name in kinds and kinds[f.name] != f.dataType})
        out = cast if out is None else out.unionByName(cast, allowMissingColumns=True)
    return out


def sweep(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Removes version folders that none of the last ``keep`` manifests names, and older manifests."""
    numbers = _numbers(spark, root)
    if not numbers:
        return 0
    used = {entry["folder"] for n in numbers[-keep:] for entry in _read(spark, root, n).values()}
    fs, pattern = _fs(spark, f"{root}/*/*/v=*")
    gone = 0
    for status in fs.globStatus(pattern) or []:
        if "/".join(status.getPath().toString().split("/")[-3:]) not in used:
            gone += bool(fs.delete(status.getPath(), True))
    for n in numbers[:-keep]:
        fs.delete(_fs(spark, f"{root}/{FOLDER}/{n:012d}.json")[1], False)
    return gone

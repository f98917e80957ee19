"""Views over the partitioned pass tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.operators.funnel import ad_lifecycle, funnel_by_period
from spendlens.schema import PASSES, PassSpec, pass_schema
from spendlens.sinks.slices import manifest, scan


def _slices(slices: dict, spec: PassSpec) -> dict:
    return {k: v for k, v in slices.items() if k.startswith(f"pass={spec.name}/")}


def has_pass(spark: SparkSession, root: str, spec: PassSpec) -> bool:
    """Whether any slice of the pass has been published (or lies in a root without manifest)."""
    slices = manifest(spark, root)
    return bool(_slices(slices, spec)) if slices else _exists(spark, f"{root}/pass={spec.name}/month=*")


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def scan_pass(spark: SparkSession, root: str, spec: PassSpec, pinned: bool = False) -> DataFrame:
    """All months of a pass; columns missing from a month read as null.

    Slices and their columns come from the manifest, so that no footer is opened to
    find them. A root without manifest is scanned as it lies: by the pinned schema of the
    pass, or with the columns of all footers united by name. ``pass`` and ``month`` are
    partition columns, so filters on them prune slices before any file is opened.
    """
    slices = manifest(spark, root)
    if slices:
        found = scan(spark, root, _slices(slices, spec))
        if not pinned:
            return found
        missing = {f.name: F.lit(None).cast(f.dataType) for f in pass_schema(spec).fields if f.name not in found.columns}
        return found.withColumns(missing)
    reader = spark.read.schema(pass_schema(spec)) if pinned else spark.read.option("mergeSchema", True)
    return reader.option("basePath", root).parquet(f"{root}/pass={spec.name}")


def register_views(spark: SparkSession, root: str) -> list[str]:
    """Create the view of every pass that has data, plus the derived views."""
    created = []
    for spec in PASSES.values():
        if has_pass(spark, root, spec):
            scan_pass(spark, root, spec).createOrReplaceTempView(spec.view)
            created.append(spec.view)
    if "ads_daily" in created:
        daily = spark.table("ads_daily")
        funnel_by_period(daily).createOrReplaceTempView("funnel_by_month")
        ad_lifecycle(daily).createOrReplaceTempView("ad_lifecycle")
        created += ["funnel_by_month", "ad_lifecycle"]
    return created


def available(spark: SparkSession, names) -> list[str]:
    return [n for n in names if spark.catalog.tableExists(n)]


def catalog_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Row and column count of each table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("view"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
        )
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def ledger(tables: dict[str, DataFrame]) -> DataFrame:
    """(pass, month, rows) of what is stored, from the partition columns alone."""
    parts = [
        df.groupBy("month").agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("pass"), "month", "rows"
        )
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

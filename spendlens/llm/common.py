"""Shared folders, stored copies and hashing used by the corpus operators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.session import scratch_path, ship, tidy

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Stored bytes of a small table for one task.
TASK_BYTES = 4 << 20


class Workspace:
    """Stored copies of one operator run, in the folder all executors share.

    A copy cuts the lineage: a lost executor makes later steps read it again and
    never repeats what made it. ``drop`` removes copies whose readers are done.
    """

    def __init__(self, spark: SparkSession, name: str, batches: bool = False):
        self.spark, self.name, self.paths = spark, name, {}
        if batches:
            small_batches(spark)

    def path(self, step: str) -> str:
        return scratch_path(self.spark, f"{self.name}-{step}")

    def settle(self, df: DataFrame, step: str, fit: bool = False, tasks: int | None = None) -> DataFrame:
        """Stores a table and returns the copy; with ``fit`` it is read by a task for every ``TASK_BYTES``.

        ``tasks`` limits the tasks of the last step before the copy, see ``tasks``.
        """
        path = self.path(step)
        if tasks:
            df = df.coalesce(tasks)
        with tidy(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        size = 0
        if fit:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            size = target.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
            out = out.coalesce(max(1, -(-size // TASK_BYTES)))
        self.paths[id(out)] = (out, path, size)
        return out

    def tasks(self, *frames: DataFrame, per: int) -> int:
        """Tasks for work over stored tables (with ``fit``): one for every ``per`` bytes, all cores at least.

        Small tables get no more tasks than they have work for, whatever the number of
        shuffle partitions; large ones are not held back.
        """
        return max(self.spark.sparkContext.defaultParallelism, -(-sum(self.paths[id(f)][2] for f in frames) // per))

    def drop(self, *frames: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for frame in frames:
            path = self.paths.pop(id(frame))[1]
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


def small_batches(spark: SparkSession) -> None:
    """Readies Python workers: this package, and batches they can hold (ten thousand whole texts are too many)."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_mod(name: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % n


def unit_hash(*parts) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


#: Bits of a row number that count within a file; the rest number the files.
PLACE_BITS = 40


def aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with other names for columns that could be taken for this library's own, and their way back."""
    back: dict[str, str] = {}
    for name in df.columns:
        if name.startswith("__") or name.lower() == "_metadata":
            new = f"user{name}"
            while new.lower() in {c.lower() for c in [*df.columns, *back]}:
                new = f"u{new}"
            back[new] = name
    return df.withColumnsRenamed({old: new for new, old in back.items()}), back


def located(rows: DataFrame) -> DataFrame | None:
    """Adds the number of a row's file, ``__file``, and its place in it, ``__place``.

    Both come from the stored files themselves, not from how a read cuts them into
    tasks, so that they are the same in every read. Files are numbered by path; their
    list, which Spark keeps on the driver for any scan, is joined as a broadcast. None
    if the rows are not a scan of files that number their rows, or of more than 2^20.
    """
    try:
        marked = rows.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__place"))
    except AnalysisException:
        return None
    paths = sorted(r[0] for r in marked.select("__path").distinct().collect())  # one for each file
    if len(paths) > 1 << 20:
        return None
    files = rows.sparkSession.createDataFrame(list(zip(paths, range(len(paths)))), "__path string, __file int")
    return marked.join(F.broadcast(files), "__path").drop("__path")


def numbered(ws: Workspace, rows: DataFrame, stored: bool) -> DataFrame:
    """Adds a unique row number ``__rid`` that is the same whenever the rows are read.

    With ``stored``, rows of a scan of files are numbered by file and place in it; other
    rows are stored with their number.
    """
    placed = located(rows) if stored else None
    if placed is None:
        return ws.settle(rows.withColumn("__rid", F.monotonically_increasing_id()), "rows")
    rid = F.shiftleft(F.col("__file").cast("long"), PLACE_BITS) + F.col("__place")
    return placed.withColumn("__rid", rid).drop("__file", "__place")


def ranked(ws: Workspace, df: DataFrame, order: list, rank: str = "__rank") -> DataFrame:
    """Adds the gapless position of each row in ``order`` without a single task.

    Rows are range partitioned and sorted, stored, counted for each partition,
    and get the partition's offset plus their place inside. Rows equal in
    ``order`` are numbered in any order. Nothing but one row for each partition
    is summed in one place, and that table is bounded by the partition count.
    """
    part, at = F.spark_partition_id(), F.monotonically_increasing_id()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = ws.settle(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order)
        .select("*", part.alias("__part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")),
        "ranked",
    )
    counts = laid.groupBy("__part").count().collect()  # one row for each partition
    offsets, total = [], 0
    for row in sorted(counts, key=lambda r: r["__part"]):
        offsets.append((row["__part"], total))
        total += row["count"]
    spark = df.sparkSession
    starts = spark.createDataFrame(offsets, "__part int, __start long")
    return laid.join(F.broadcast(starts), "__part").withColumn(
        rank, F.col("__start") + F.col("__at")
    ).drop("__part", "__at", "__start")

"""Session defaults and the shared scratch location."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def build_session(app: str = "spendlens", master: str | None = None, **conf) -> SparkSession:
    """Session tuned for large scans; cluster submissions override through spark-defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    if (master or "").startswith("local"):
        settings.setdefault("spark.checkpoint.dir", own_folder())
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which every executor can reach.

    A local session that was not made by ``build_session`` and has no such
    setting gets a folder of this process, removed at its end.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = own_folder()
    path = os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
    if _SCOPES:
        _SCOPES[-1].paths.append(path)
    return path


#: Spark then removes the shuffle files of a query when it has run, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of a table written inside go with the end of the write.

    For copies that are read from their files afterwards: nothing comes back to what was shuffled.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


_SCOPES: list[scope] = []


class scope:
    """Owns what operators store or keep while it is open; its end removes it all.

    Results are read lazily from stored copies, so read or write them inside::

        with scope(spark):
            rank_family(spark.table(spec.view), spec).scored.write.parquet(out)

    Scopes may be nested: a copy belongs to the innermost. Without one, copies stay in
    ``spark.checkpoint.dir`` until someone removes them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], []

    def __enter__(self) -> scope:
        _SCOPES.append(self)
        return self

    def __exit__(self, *_) -> None:
        _SCOPES.remove(self)
        for frame in self.kept:
            frame.unpersist()
        for path in self.paths:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


_OWN: list[str] = []


def own_folder() -> str:
    """One temporary folder of this process, for local sessions alone; removed at exit."""
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="spendlens-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of the session, once for each application.

    Workers need not have it installed: its source goes out as a zip through
    Spark's own file distribution.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(own_folder(), f"spendlens-{uuid.uuid4().hex[:12]}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)

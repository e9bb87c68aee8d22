"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Folders made for local sessions that name none, by application.
_LOCAL_ROOTS: dict[str, str] = {}


def build(cpus: str | int = "*", partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("presstide")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    A local session without one gets a temporary folder; a cluster without one
    is an error, since a machine's own disk is lost with that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    # local-cluster has executors with folders of their own.
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="presstide-")
    return _LOCAL_ROOTS[app]


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path under the scratch root; nothing is created or reused."""
    return f"{scratch_root(spark)}/presstide/{label}-{uuid.uuid4().hex}"


#: Spark's setting that removes the shuffle files of a query when the query ends.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Spark's setting for aggregates over objects, as sketches are: by hash until it has too many groups, or by sorting.
HASHED_OBJECTS = "spark.sql.execution.useObjectHashAggregateExec"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    """Queries run inside have this setting; it is put back after."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffles_dropped(spark: SparkSession):
    """Queries run inside leave no shuffle files behind."""
    return _setting(spark, CLEAN_SHUFFLES, "true")


def sorted_aggregates(spark: SparkSession):
    """Sketches of very many groups are built from rows sorted once, the order of the result."""
    return _setting(spark, HASHED_OBJECTS, "false")


def folders_open(spark: SparkSession, n: int):
    """Tasks that write a table by folders keep so many open, and rows that come folder by folder are not sorted."""
    return _setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(n))


def persist_table(df, label: str):
    """Write ``df`` to the shared folder and read it back, cutting its lineage.

    Unlike a cached plan, the files outlive any executor. Storing a per-key
    aggregate before joining it back also matters for skew: adaptive execution
    splits a hot key only where both join inputs are plain shuffles, and not
    where one is an aggregate still sitting on its own shuffle. The write's own
    shuffle files go when it is done, so a chain of tables holds one step's at a time.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    with shuffles_dropped(spark):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

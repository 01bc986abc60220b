"""Session settings and durable checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: folders of staged tables of the innermost ``temporary`` block
_FOLDERS: ContextVar[list[str] | None] = ContextVar("_FOLDERS", default=None)
_EXCLUDED = "spark.sql.adaptive.optimizer.excludedRules"


def local_session(cpus: str | int | None = None, name: str = "docquarry") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    cpus = str(cpus or os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("DOCQUARRY_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    fall back to a temporary folder: an executor on another machine could not
    read it back after a loss.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="docquarry-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def staged(df: DataFrame, *partitions: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    For results that several later steps use: they read columns they need from
    the table instead of computing ``df`` again, also after an executor is lost.
    """
    return staged_in_turn([df], *partitions, compression=compression)


def staged_in_turn(frames: Iterable[DataFrame], *partitions: str, compression: str | None = None) -> DataFrame:
    """``staged`` for one table that comes as several frames of the same columns, written one after the other."""
    path = None
    for df in frames:
        if path is None:
            path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
            if (folders := _FOLDERS.get()) is not None:
                folders.append(path)
        writer = df.write.mode("append").partitionBy(*partitions) if partitions else df.write.mode("append")
        (writer.option("compression", compression) if compression else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _tidy(spark: SparkSession) -> dict[str, str]:
    """Settings that remove the shuffle files of a step when it ends, not when the driver's memory is next tidied.

    A join with an empty side would end its step while stages of the other side still
    read such files, so all of them are awaited.
    """
    excluded = [spark.conf.get(_EXCLUDED, ""), "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"]
    return {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        _EXCLUDED: ",".join(filter(None, excluded)),
    }


class Temporary:
    """Folders of the tables staged in a ``temporary`` block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def clear(self) -> None:
        """Delete the tables staged so far: no later step may read them."""
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        while self.folders:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(self.folders.pop())
            place.getFileSystem(hadoop).delete(place, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Temporary]:
    """Tables staged inside the block go when it ends, shuffle files when their step does.

    For a chain that is finished at the end of the block; a lazy result of it
    would read tables that are gone.
    """
    made = Temporary(spark)
    token = _FOLDERS.set(made.folders)
    try:
        with settings(spark, _tidy(spark)):
            yield made
    finally:
        _FOLDERS.reset(token)
        made.clear()

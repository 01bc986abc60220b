"""Keyed result tables that streams add to, batch by batch, exactly once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

Merge = Callable[[str], Column]


class MergedTable:
    """A table of one row per key whose columns are merged by aggregations.

    Every column beside the keys has an aggregation that can be applied again to
    its own results (``max``, ``min``, ``sum``, ...).  A batch is reduced to one row
    per key, in every task before the shuffle, and written as a folder of its own;
    nothing that is there is rewritten.  A ledger entry then names the folders that
    make up the table.  It is written under another name and renamed, so readers
    see the table before or after a batch, never between.  The entry also holds
    the last batch of each writer: a batch that comes again after a failure is
    written over its own unfinished folder, or left out if it was entered.

    After ``every`` batches the folders are merged into one.  Folders that neither
    of the last two entries names are deleted.  One writer at a time may add; a
    stream that starts from a new checkpoint needs a new ``writer`` name, as its
    batches count from 0 again.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], merges: Mapping[str, Merge], schema: StructType, every: int = 20):
        self.spark, self.path, self.keys, self.merges, self.every = spark, path.rstrip("/"), keys, merges, every
        self.schema = StructType([schema[name] for name in (*keys, *merges)])

    # --- reading --------------------------------------------------------------------

    def read(self) -> DataFrame:
        """The whole table as of the last entry."""
        return self.merged(self._parts(self.entry()))

    def merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[merge(name).alias(name) for name, merge in self.merges.items()])

    def entry(self) -> dict:
        """The last ledger entry."""
        numbers = [int(n) for n in self._names("ledger") if n.isdigit()]
        if not numbers:
            return {"number": 0, "folders": [], "writers": {}}
        last = self._path("ledger", f"{max(numbers):012d}")
        stream = self._fs().open(last)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    # --- writing --------------------------------------------------------------------

    def add(self, batch: DataFrame, epoch: int, writer: str = "stream") -> None:
        """Merge one batch; for ``foreachBatch``."""
        now = self.entry()
        if epoch <= now["writers"].get(writer, -1):
            return
        folder = f"batch-{writer}-{epoch}"
        self._write(self.merged(batch), folder)
        folders = [*now["folders"], folder]
        if len(folders) > self.every:
            whole = f"merged-{now['number'] + 1}"
            self._write(self.merged(self._parts({"folders": folders})), whole)
            folders = [whole]
        self._enter({"number": now["number"] + 1, "folders": folders, "writers": now["writers"] | {writer: epoch}})
        self._sweep({*folders, *now["folders"]})

    def _write(self, rows: DataFrame, folder: str) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/{folder}")

    def _parts(self, entry: dict) -> DataFrame:
        if not entry["folders"]:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in entry["folders"]])

    def _enter(self, entry: dict) -> None:
        fs, name = self._fs(), f"{entry['number']:012d}"
        draft, final = self._path("ledger", f"draft-{uuid.uuid4().hex}"), self._path("ledger", name)
        out = fs.create(draft)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"{self.path}: entry {name} was written by somebody else")

    def _sweep(self, wanted: set[str]) -> None:
        for name in self._names():
            if name.startswith(("batch-", "merged-")) and name not in wanted:
                self._fs().delete(self._path(name), True)

    # --- files, wherever Spark can reach them -----------------------------------------

    def _path(self, *parts: str) -> JavaObject:
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _fs(self) -> JavaObject:
        return self._path().getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, *parts: str) -> list[str]:
        folder = self._path(*parts)
        return [s.getPath().getName() for s in self._fs().listStatus(folder)] if self._fs().exists(folder) else []

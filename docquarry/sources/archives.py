"""Compressed downloads."""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry import constants as C
from docquarry.plans.spread import pieces

# first bytes of a zstandard and of a gzip file
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
GZIP_MAGIC = b"\x1f\x8b"
# bytes unpacked at a time
READ_BYTES = 1 << 20


def decompress(blob: bytes, limit: int = C.MAX_DECOMPRESSED) -> bytes:
    """Unpack by the leading bytes; anything else is returned as it is.

    The unpacked size is bounded, so a small hostile file cannot fill a task.
    """
    if blob[:4] == ZSTD_MAGIC:
        stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(blob))
    elif blob[:2] == GZIP_MAGIC:
        stream = gzip.GzipFile(fileobj=io.BytesIO(blob))
    else:
        stream = io.BytesIO(blob)
    parts, size = [], 0
    # in pieces: one read of the whole limit makes room for all of it
    while size <= limit and (part := stream.read(min(READ_BYTES, limit + 1 - size))):
        parts.append(part)
        size += len(part)
    if size > limit:
        raise ValueError(f"more than {limit} bytes after unpacking")
    return b"".join(parts)


def unpack(blobs: DataFrame, limit: int = C.MAX_DECOMPRESSED) -> DataFrame:
    """Text of binary rows (``name``, ``content``); ``error`` tells what could not be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "content"):
            texts, errors = [], []
            for blob in piece.column("content"):
                try:
                    text, problem = decompress(blob.as_py(), limit).decode("utf-8"), None
                except (ValueError, OSError, EOFError, zlib.error, zstandard.ZstdError) as found:
                    text, problem = None, str(found)
                texts.append(text)
                errors.append(problem)
            columns = {"name": piece.column("name"), "text": pa.array(texts, pa.string()), "error": pa.array(errors, pa.string())}
            yield pa.record_batch(columns)

    return blobs.select("name", "content").mapInArrow(run, "name string, text string, error string")


def read_rustdoc(spark: SparkSession, path: str) -> DataFrame:
    """Downloaded documentation files named ``crate/version.json[.gz|.zst]``."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), "content")
    parts = F.split("name", "/")
    return unpack(raw).where(F.col("text").isNotNull()).select(
        F.element_at(parts, -2).alias("crate"),
        F.regexp_replace(F.element_at(parts, -1), r"\.json.*$", "").alias("version"),
        "text",
    )


def pick_format(available: DataFrame) -> DataFrame:
    """The best stored format per release: zstandard, then gzip, then plain."""
    order = F.when(F.col("name").endswith(".zst"), 1).when(F.col("name").endswith(".gz"), 2).otherwise(3)
    return available.groupBy("crate", "version").agg(F.min_by("name", order).alias("name"))


def compress(rows: DataFrame, codec: str) -> DataFrame:
    """Compressed form of text rows (``name``, ``text``) as ``name``, ``content``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zst = zstandard.ZstdCompressor()
        for piece in pieces(batches, "text"):
            packed = []
            for text in piece.column("text"):
                data = text.as_py().encode()
                if codec == "zst":
                    data = zst.compress(data)
                elif codec == "gz":
                    data = gzip.compress(data, mtime=0)
                packed.append(data)
            names = [None if name is None else f"{name}.{codec}" for name in piece.column("name").to_pylist()]
            yield pa.record_batch({"name": pa.array(names, pa.string()), "content": pa.array(packed, pa.binary())})

    return rows.select("name", "text").mapInArrow(run, "name string, content binary")

"""Vectors for texts.

A model is any function from a list of texts to a matrix.  It runs once per
Arrow batch on the executors; none is bundled, so the default is a hashing
embedder, which is deterministic and needs no files.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from docquarry import constants as C

_WORD = re.compile(r"\w+")


def hashing_model(dim: int = C.DEFAULT_DIM) -> Callable[[list[str]], np.ndarray]:
    """Signed word counts hashed into ``dim`` places, scaled to length one."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for row, text in zip(out, texts):
            for word in _WORD.findall(text.lower()):
                code = xxhash.xxh64_intdigest(word)
                row[code % dim] += 1.0 if code >> 63 else -1.0
        sizes = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(sizes == 0, 1, sizes)

    return embed


def item_text(limit: int | None = None):
    """Header and documentation as one text; ``limit`` cuts it for small models."""
    text = F.concat_ws(" ", F.coalesce("header", F.lit("")), F.coalesce("content", F.lit("")))
    return text if limit is None else F.substring(text, 1, limit)


def embed(
    rows: DataFrame,
    text,
    model: Callable[[list[str]], np.ndarray] | None = None,
    column: str = "embedding",
) -> DataFrame:
    """Add a vector of ``text`` to every row; only the text goes through Python."""
    model = model or hashing_model()

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(model(batch.fillna("").tolist())), dtype=object)

    return rows.drop(column).withColumn(column, run(text))


def embed_examples(examples: DataFrame, model=None) -> DataFrame:
    """Vectors of code examples, from their text, language and context."""
    from docquarry.functions.code import embedding_text

    text = embedding_text(F.col("example_text"), F.col("language"), F.col("context"))
    return embed(examples, text, model)

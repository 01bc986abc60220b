"""Long texts full of matches."""

import re
import time

import pytest
from pyspark.sql import functions as F

from docquarry.llm import pii


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_places(spark, n):
    text = "ä" + "".join(f"x{i} 😀 " for i in range(n)) + "end"
    row = spark.createDataFrame([(text,)], "body string").select(pii._matches(F.col("body"), "[0-9]+", "[0-9]").alias("m")).first()
    assert [tuple(m) for m in row.m] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", text)]


def test_a_megabyte_of_numbers_takes_linear_time(spark):
    numbers = "4111 1111 1111 1111, +1 415 555 0199; 10.0.0.7 a@b.org 77; "
    docs = spark.createDataFrame([(i, numbers * k) for i, k in enumerate((1, 2_000, 16_000))], "doc_id long, text string").repartition(3)
    started = time.time()
    found = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert time.time() - started < 120
    once = {tuple(s) for s in found[0].spans}
    assert len(once) >= 4
    for i, k in ((1, 2_000), (2, 16_000)):
        assert found[i].n_card == k * found[0].n_card and found[i].n_phone == k and found[i].n_email == k
        base = {(s.start % len(numbers), s.kind) for s in found[i].base}
        assert base == {(s.start, s.kind) for s in found[0].base}

"""Dropping exact copies against plain Python: both ways to reach the scan."""

import random

import pytest

from docquarry.llm.exact_dedup import drop_copies


def staying(rows):
    """Per text the row with the largest id; a null id is the smallest."""
    best = {}
    for row in rows:
        text = row[1] or ""
        if text not in best or (row[0] is not None and (best[text][0] is None or row[0] > best[text][0])):
            best[text] = row
    return sorted(((row[0], row[1] or "") for row in best.values()), key=repr)


def mixed(count):
    rng = random.Random(3)
    long = "b" * 300  # equal prefixes, other ends
    texts = [None, "", "a", long, long + "c", *[f"x{i}" for i in range(30)]]
    return [(rng.choice([None, *range(40)]), rng.choice(texts), "other") for _ in range(count)]


@pytest.mark.parametrize("limit", [500_000, 0])
@pytest.mark.parametrize(
    "rows", [mixed(300), [(i, f"t{i % 7}", "o") for i in range(50)], [(1, "same", "o")] * 20, []],
    ids=["mixed", "no repeated ids", "one row repeated", "empty"],
)
def test_drop_copies(spark, rows, limit):
    # columns named as those of the operator
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string").selectExpr("*", "1 AS id", "2 AS whole")
    out = drop_copies(docs, broadcast_keys=limit)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text or "") for r in out.collect()), key=repr) == staying(rows)

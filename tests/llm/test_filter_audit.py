"""The filter audit against a run of all 120 chains, document by document."""

import itertools
import re

import numpy as np
import pytest

from docquarry.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, id string, part string, word string, words int, label int"


def rows_given():
    long = " ".join(f"w{i}" for i in range(260))
    texts = [None, "", " \t\n ", "a b c", "a b c", "A B C", "x|y", long, long, long, long + " #", "W" + long, long.replace("w", "W"), "same " * 300, "same " * 300, "é" * 300 + " Ü", "z" * 50_000]
    rows = [(i, t, ("en", "fr", None, "")[i % 4]) for i, t in enumerate(texts)]
    return rows + [(7, long, "fr"), (None, long, "en"), (None, "a b c", "en"), (90, "a b c", "de"), (91, "a b c", "de"), (91, "a b c", "de")]


LABELS = [(3, 1, 0), (4, 1, 1), (5, 0, 1), (7, 1, None), (8, None, 1), (8, 1, 0), (90, 1, 1), (91, 1, 0), (700, 1, 1), (None, 1, 1)]


def by_chains(rows, labels):
    marks = {}
    for i, quality, toxic in labels:
        if i is not None:
            q, t = marks.get(i, (0, 0))
            marks[i] = max(q, quality or 0), max(t, toxic or 0)
    docs = []
    for i, text, lang in rows:
        t = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        bad = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        docs.append((lang or "", bad, marks.get(i, (0, 0))))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                failing = [d for d in own if d[1][f]]
                alone = [d for d in failing if sum(d[1].values()) == 1]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), len(alone), sum(d[2][0] for d in gone), sum(d[2][1] for d in gone)]
                shapley[f] += len(gone)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_equals_the_chains(spark):
    rows = rows_given()
    docs = spark.createDataFrame([(*r, "i", "p", "w", 1, 2) for r in rows], SCHEMA).repartition(4)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels).collect()
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == by_chains(rows, LABELS)
    assert len(got) == 600 * len({r.part for r in got})


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "a", "en", "i", "p", "w", 1, 2)], SCHEMA)
    got = filter_audit.audit(one, labels).collect()
    assert len(got) == 600 and {r.good_lost for r in got} == {0}


@pytest.mark.parametrize("n", [0, 1, 95, 96, 97, 1_000, 5_003])
def test_carry_save_counts(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert filter_audit.positional_popcount(words).tolist() == [int((words >> np.uint32(b) & 1).sum()) for b in range(32)]


def test_a_survival_word_is_the_truth_table_of_its_failures():
    for failing in itertools.chain.from_iterable(itertools.combinations(range(5), k) for k in range(6)):
        word = filter_audit.FULL
        for f in failing:
            word &= filter_audit.truth_word(f)
        assert [word >> s & 1 for s in range(32)] == [int(not any(s >> f & 1 for f in failing)) for s in range(32)]

"""Spans that no base pattern meets."""

import random

from docquarry.llm import pii

#: kind, text before, span, text after
PLANTED = [
    ("email", "write to ", "jane{n}.doe (at) host{n} (dot) org", ", please"),
    ("email", "", "jo{n}[at]mail{n}[dot]example[dot]com", ". Next one"),
    ("email", "mail ", "kim{n} @ host{n}.net", ". Then we go"),
    ("phone", "call ", "(415) 555-01{n}", " today"),
    ("phone", "or ", "415-555-01{n}", ". 3 more"),
    ("ip", "the server ", "10 . 20 . 30 . 1{n}", " is up"),
    ("card", "pay by card ", "4111.1111.1111.1111", " now"),
]
#: what looks near but is none
OTHERS = ["at 10:20:30:{n} sharp", "parts 1. 2. 3. 4. of {n}", "see @user{n}.name there", "order 12345678{n} came", "sum 4111.1111.1111.1112 of", "room ({n}) 12 34 56", "hello @ noon{n}"]


def test_added(spark):
    rnd, rows, want = random.Random(7), [], set()
    words = ["".join(rnd.choice("aeinorst") for _ in range(5)) for _ in range(80)]
    for i in range(280):
        n = str(10 + i % 90)
        lead = " ".join(rnd.choices(words, k=6)) + " "
        kind, before, span, after = PLANTED[i % len(PLANTED)]
        before, span = lead + before, span.replace("{n}", n)
        want.add((i, len(before), pii.KINDS.index(kind), len(before) + len(span)))
        rows.append((i, before + span + after))
        rows.append((1000 + i, lead + OTHERS[i % len(OTHERS)].replace("{n}", n)))
        rows.append((2000 + i, lead + f"a{n}@b.org, 10.0.0.{n} and +1 (415) 555-01{n} or 4111 1111 1111 1111"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = pii.find_pii(docs).collect()
    added = {(r.doc_id, *s) for r in found for s in set(map(tuple, r.spans)) - set(map(tuple, r.base))}
    assert added == want
    assert all(len(r.base) == 4 for r in found if r.doc_id >= 2000)

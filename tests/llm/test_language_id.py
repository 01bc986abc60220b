"""Language identification: its parts against plain counts, and held-out accuracy."""

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import language_id
from docquarry.llm.common import fold

SCHEMA = "doc_id long, text string, lang string, language string, place long, score int"
SYLLABLES = {"aa": "ba du ki lo", "bb": "ber gen sch tz", "cc": "ció ñar ez os", "dd": "eau oi çon ré", "ee": "жа ни ко те", "ff": "thr ing ly st", "gg": "ウィ カ ト ノ", "hh": "zx qv wk jj"}


def corpus(langs, n, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = langs[i % len(langs)]
        words = ["".join(rnd.choice(SYLLABLES[lang].split()) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(3, 60))]
        out.append((i, " ".join(words).capitalize() + ".", lang, "x", 1, 2))
    return out


def grams(text, sizes=language_id.SIZES):
    out, last = [32], True
    for c in text.lower() + " ":
        if c.isalpha():
            out.append(ord(c))
        elif not last:
            out.append(32)
        last = not c.isalpha()
    found = collections.Counter()
    for n in sizes:
        for at in range(len(out) - n + 1):
            if n > 1 or out[at] != 32:
                found[tuple(out[at : at + n])] += 1
    return found


TEXTS = ["", " ", "...", "a", "Straße  und-Öl\n", "ABC abc", "x" * 50, "a1b2 İstanbul ΣΑΣ", "日本 語!", " lead and trail ", "\ud800 lone"]


@pytest.mark.parametrize("chars", [1, 2, 7, 1_000_000])
def test_counts_equal_plain_ones(monkeypatch, chars):
    monkeypatch.setattr(language_id, "CHARS", chars)
    width = 1 << language_id.HASH_BITS
    for first, counts, total in language_id.gram_counts(TEXTS, width):
        for text, row, n in zip(TEXTS[first:], counts, total):
            want = grams(text)
            assert n == sum(want.values()) == row.sum(), text
            assert sorted(row[row > 0]) == sorted(want.values()) or len(want) > (row > 0).sum(), text
            codes = np.array([c for g in want for c in g], np.uint32)
            expected = np.zeros(width)
            at = 0
            for g, k in want.items():
                own = codes[at : at + len(g)]
                slots = [s for size, (_, s) in zip(language_id.SIZES, language_id.gram_slots(own, np.zeros(len(g), np.int32))) if size == len(g)]
                expected[slots[0][0]] += k
                at += len(g)
            assert (row == expected).all(), text


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 7, 20])
def test_codewords_lie_apart(n):
    code = language_id.codewords(n)
    columns = [tuple(c) for c in code.T]
    assert len(code) == n and all(len(set(c)) == 2 for c in columns)
    assert len(set(columns) | {tuple(-v for v in c) for c in columns}) == 2 * len(columns)
    if 2 < n <= language_id.EXHAUSTIVE:
        assert {int((a != b).sum()) for a, b in itertools.combinations(code, 2)} == {2 ** (n - 2)}
    if n > language_id.EXHAUSTIVE:
        assert language_id.code_distance(code) >= 7


@pytest.mark.parametrize("langs", ["aa bb", "aa bb cc dd", "aa bb cc dd ee ff gg hh"])
def test_held_out_documents_are_recognised(spark, langs):
    rows = corpus(langs.split(), 800)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    model = language_id.learn(docs.where(fold("doc_id", 4) != 2), sample_rows=400)
    held = language_id.identify(docs.where(fold("doc_id", 4) == 2).drop("lang"), model).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(held) > 150 and model.names == langs.split()
    assert sum(r.language.lang == truth[r.doc_id] for r in held) >= 0.99 * len(held)
    assert all(0 <= r.language.score <= 1 for r in held) and sum(r.language.ambiguous for r in held) < 0.1 * len(held)


def test_decoding_equals_a_plain_sum(spark):
    docs = spark.createDataFrame(corpus("aa bb cc dd".split(), 200), SCHEMA)
    model = language_id.learn(docs)
    text = "Badu schtz ber eau oiré"
    want = grams(text)
    index = {int(s): i for i, s in enumerate(model.slots)}
    x = np.zeros(len(model.slots))
    for g, k in want.items():
        slot = next(int(s[0]) for size, (_, s) in zip(language_id.SIZES, language_id.gram_slots(np.array(g, np.uint32), np.zeros(len(g), np.int32))) if size == len(g))
        if slot in index:
            x[index[slot]] += k
    margins = np.sqrt(x / sum(want.values())) @ model.weights + model.bias
    loss = [sum(t * np.log1p(np.exp(-c * m)) for t, c, m in zip(model.trust[i], model.code[i], margins)) for i in range(4)]
    odds = np.exp(-model.sharpness * (np.array(loss) - min(loss)))
    got = spark.createDataFrame([(1, text)], "doc_id long, text string").select(language_id.identified(F.col("text"), model).alias("l")).first().l
    best = int(np.argmin(loss))
    assert got.lang == model.names[best] and got.score == pytest.approx(odds[best] / odds.sum())
    assert got.wrong_bits == int((margins * model.code[best] <= 0).sum())


def test_a_mixed_text_is_ambiguous_and_letters_decide(spark):
    docs = spark.createDataFrame(corpus("aa bb".split(), 400), SCHEMA)
    model = language_id.learn(docs)
    asked = [(1, None), (2, ""), (3, "12 + 34 !?\n"), (4, "badu " * 200), (5, "BADU KILO"), (5, "BADU KILO"), (6, "badukilo 77 " * 120_000)]
    got = language_id.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()
    assert [(r.doc_id, r.language.lang) for r in sorted(got, key=lambda r: r.doc_id)] == [(1, "und"), (2, "und"), (3, "und"), (4, "aa"), (5, "aa"), (5, "aa"), (6, "aa")]
    assert all(r.language.score == 0 and r.language.ambiguous for r in got if r.language.lang == "und")
    margins = np.array([[0.001], [9.0]])
    _, chance, _ = model.decode(margins)
    assert abs(chance[0, 0] - chance[0, 1]) < language_id.LEAD < chance[1, 0]


def test_little_to_learn_from(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert language_id.learn(none).names == []
    docs = spark.createDataFrame([(1, "abc def", None, "x", 1, 2), (2, None, "aa", "x", 1, 2), (3, "123", "bb", "x", 1, 2)], SCHEMA)
    empty = language_id.learn(docs)
    assert empty.names == []
    assert {r.language.lang for r in language_id.identify(docs, empty).collect()} == {"und"}
    assert language_id.identify(none, empty).collect() == []
    one = language_id.learn(spark.createDataFrame([(1, "abc def", "aa", "x", 1, 2), (1, "abc def", "aa", "x", 1, 2)], SCHEMA))
    got = language_id.identify(docs, one).collect()
    assert {(r.doc_id, r.language.lang, r.language.score) for r in got} == {(1, "aa", 1.0), (2, "und", 0.0), (3, "und", 0.0)}

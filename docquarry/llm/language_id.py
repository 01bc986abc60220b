"""Language identification by error-correcting output codes over letter n-grams."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import fold, query, table
from docquarry.operators.topn import first_per_group
from docquarry.session import staged

UNKNOWN = "und"
SIZES = (1, 2, 3)
HASH_BITS = 16
FEATURES = 2_048
#: labelled documents the classifiers are fitted on, shared out equally among the languages, chosen by hash
SAMPLE_ROWS = 6_000
#: one in this many sampled documents measures the bits and is not fitted on
MEASURED = 5
#: documents a feature must occur in
LEAST_DOCS = 3
STEPS, RIDGE = 200, 1e-3
#: up to this many languages get all two-way splits of them, more get ten bits per doubling
EXHAUSTIVE = 6
#: the winner's lead in probability below which a document is ambiguous
LEAD = 0.2
#: characters and documents looked at together
CHARS, TOGETHER = 1_000_000, 256
SEED = 5


# --- n-grams ------------------------------------------------------------------------


@functools.cache
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letter_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points and text numbers: lower case, every run of other characters one blank, a blank at both ends."""
    padded = [f" {t.lower()} ".encode("utf-32-le", "surrogatepass") for t in texts]
    codes = np.frombuffer(b"".join(padded), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(p) // 4 for p in padded])
    letter = _is_letter()[codes]
    keep = letter.copy()
    if len(keep):
        keep[0] = True
        keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    return np.where(letter, codes, np.uint32(32))[keep], owner[keep]


def gram_slots(codes: np.ndarray, owner: np.ndarray, seen: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, slot) of the n-grams of each size; those that end in the first ``seen`` codes were counted before."""
    rolled = codes.copy()
    for n in range(1, max(SIZES) + 1):
        if n > 1:
            rolled = rolled[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n in SIZES:
            mixed = (rolled ^ (rolled >> np.uint32(16))) * np.uint32(0x9E3779B1) + np.uint32(n * 0x7F4A7C15 & 0xFFFFFFFF)
            fine = owner[: len(mixed)] == owner[n - 1 :]
            fine &= codes[: len(mixed)] != 32 if n == 1 else True
            fine[: max(seen - n + 1, 0)] = False
            yield owner[: len(mixed)][fine], (mixed >> np.uint32(32 - HASH_BITS))[fine].astype(np.int64)


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with some characters together, or of one long text."""
    first = 0
    while first < len(texts):
        last, chars = first, 0
        while last < len(texts) and last - first < TOGETHER and (last == first or chars + len(texts[last]) < CHARS):
            chars, last = chars + len(texts[last]), last + 1
        yield first, last
        first = last


def gram_counts(texts: list[str], width: int, place: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, counts, all n-grams) of some texts at a time.

    ``place`` gives the column of each slot, -1 for none.  A long text is read in
    pieces, with the n-grams over their borders.
    """
    for first, last in _runs(texts):
        counts, total = np.zeros((last - first) * width), np.zeros(last - first)
        pieces = [texts[first:last]]
        if last - first == 1 and len(texts[first]) > CHARS:
            whole = texts[first].lower()
            pieces = [[whole[at : at + CHARS]] for at in range(0, len(whole), CHARS)]
        before = np.empty(0, np.uint32)
        for number, piece in enumerate(pieces):
            codes, owner = letter_codes(piece)
            if len(pieces) > 1:
                inner = codes[int(number > 0 and piece[0][0].isalpha()) : len(codes) - int(number < len(pieces) - 1 and piece[0][-1].isalpha())]
                if len(before) and before[-1] == 32 and len(inner) and inner[0] == 32:
                    inner = inner[1:]
                codes, seen = np.concatenate((before, inner)), len(before)
                owner, before = np.zeros(len(codes), np.int32), codes[-(max(SIZES) - 1) :]
            else:
                seen = 0
            for own, slot in gram_slots(codes, owner, seen):
                total += np.bincount(own, minlength=last - first)
                at = slot if place is None else place[slot]
                own, at = (own, at) if place is None else (own[at >= 0], at[at >= 0])
                counts += np.bincount(own.astype(np.int64) * width + at, minlength=len(counts))
        yield first, counts.reshape(last - first, width), total


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Roots of the n-grams' shares: a text's length doesn't matter and frequent ones don't rule."""
    return np.sqrt(counts / np.maximum(total, 1)[:, None])


# --- codes --------------------------------------------------------------------------


def codewords(languages: int, seed: int = SEED) -> np.ndarray:
    """One row of +1 and -1 per language; no column is constant, equal to another or its opposite.

    Up to six languages have all such columns, which puts any two rows equally far
    apart.  More have ten columns per doubling, the draw of 100 whose nearest rows
    are farthest apart.
    """
    if languages <= EXHAUSTIVE:
        splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=max(languages - 1, 0)) if -1 in rest]
        return np.array(splits, dtype=np.int8).T.reshape(languages, -1)
    rng, best, far = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(languages)))
    for _ in range(100):
        columns: dict[bytes, np.ndarray] = {}
        while len(columns) < bits:
            column = rng.choice(np.array([1, -1], dtype=np.int8), languages)
            if abs(int(column.sum())) <= languages - 2:
                columns.setdefault((column * column[0]).tobytes(), column)
        code = np.stack(list(columns.values()), axis=1)
        distance = (bits - code.astype(np.int32) @ code.T) // 2
        least = int(distance[~np.eye(languages, dtype=bool)].min())
        if least > far:
            best, far = code, least
    return best


def code_distance(code: np.ndarray) -> int:
    """Bits in which the two nearest codewords differ."""
    if len(code) < 2:
        return 0
    distance = (code.shape[1] - code.astype(np.int32) @ code.T) // 2
    return int(distance[~np.eye(len(code), dtype=bool)].min())


@dataclass
class Languages:
    """Names, their codewords, and one linear n-gram classifier for each bit."""

    names: list[str]
    code: np.ndarray  # languages x bits
    slots: np.ndarray  # of the features
    weights: np.ndarray  # features x bits
    bias: np.ndarray  # bits
    trust: np.ndarray  # languages x bits, rows sum to 1
    sharpness: float

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Loss of every language, their probabilities, wrong bits of every language."""
        agree = margins[:, None, :] * self.code[None]
        loss = (np.logaddexp(0, -agree) * self.trust[None]).sum(axis=2)
        odds = np.exp(-self.sharpness * (loss - loss.min(axis=1, keepdims=True)))
        return loss, odds / odds.sum(axis=1, keepdims=True), (agree <= 0).sum(axis=2)


def fit_bits(x: np.ndarray, language: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of all bits: logistic loss with a ridge, by accelerated gradient steps."""
    y = code[language].astype(np.float32)
    scale = (1 / (x.std(axis=0) + 1e-3)).astype(np.float32)
    x = x * scale
    v = np.ones(x.shape[1], dtype=np.float32)
    for _ in range(30):  # largest eigenvalue of the features' second moments
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = np.float32(1 / (0.25 * (float(np.linalg.norm(x @ v) ** 2) / len(x) + 1) * 1.1 + RIDGE))
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    ahead_w, ahead_b, speed = w, b, 1.0
    for _ in range(STEPS):
        error = -y / (1 + np.exp(np.clip(y * (x @ ahead_w + ahead_b), -30, 30)))
        new_w = ahead_w - step * (x.T @ error / np.float32(len(x)) + np.float32(RIDGE) * ahead_w)
        new_b = ahead_b - step * error.mean(axis=0)
        new_speed = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        push = np.float32((speed - 1) / new_speed)
        ahead_w, ahead_b = new_w + push * (new_w - w), new_b + push * (new_b - b)
        w, b, speed = new_w, new_b, new_speed
    return (w * scale[:, None]).astype(np.float64), b.astype(np.float64)


def fit(x: np.ndarray, language: np.ndarray, measured: np.ndarray, names: list[str], slots: np.ndarray) -> Languages:
    """Classifiers of all bits from rows ``x``; ``measured`` rows only weigh the bits and set the sharpness.

    A bit is trusted for a language as far as it is right, beyond chance, on that
    language's measured rows.  The sharpness of probabilities is the likeliest one
    of a few for these rows.
    """
    code = codewords(len(names))
    fitted = ~measured if (~measured).any() else np.ones(len(x), bool)
    weights, bias = fit_bits(x[fitted], language[fitted], code)
    margins = x[measured].astype(np.float64) @ weights + bias
    trust = np.full(code.shape, 1.0)
    for i in range(len(names)):
        own = margins[language[measured] == i]
        if len(own):
            right = ((own * code[i]) > 0).sum(axis=0)
            trust[i] = np.maximum((right + 1) / (len(own) + 2) - 0.5, 0.01)
    model = Languages(names, code, slots, weights, bias, trust / trust.sum(axis=1, keepdims=True), 1.0)
    if len(margins):
        fits = {}
        for model.sharpness in (1.0, 2.0, 4.0, 8.0, 16.0):
            chance = model.decode(margins)[1][np.arange(len(margins)), language[measured]]
            fits[model.sharpness] = float(np.log(np.maximum(chance, 1e-9)).mean())
        model.sharpness = max(fits, key=fits.get)
    return model


# --- learning and predicting over tables ----------------------------------------------


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Languages:
    """Fit on at most ``sample_rows`` of the given documents, the same number of each language.

    Rows without a language or a letter teach nothing.  Which rows are taken is
    decided by a hash of the id.  Features are the slots whose mean share differs
    most between languages for their spread within them.
    """
    taught = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    taught = taught.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in taught.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    empty = Languages([], np.zeros((0, 0), np.int8), np.empty(0, np.int64), np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)), 1.0)
    if not sizes:
        return empty
    names = sorted(sizes)
    each = max(sample_rows // len(names), 1)
    # a hash threshold keeps most rows from being moved, the exact number is taken of the rest
    place = F.xxhash64("id", F.lit(SEED))
    parts = 1 << 20
    limit = F.create_map(*[F.lit(v) for name in names for v in (name, min(parts, int(parts * (1.3 * each + 60) / sizes[name]) + 1))])
    near = taught.where(F.pmod(place, F.lit(parts)) < F.element_at(limit, F.col("lang"))).withColumn("place", place)
    sample = staged(first_per_group(near, ["lang"], ["place", "id", "text"], each))
    width = 1 << HASH_BITS

    def spread_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, list[np.ndarray]] = {}
        docs_of: dict[str, int] = {}
        for frame in frames:
            langs = frame.lang.tolist()
            for text, lang in zip(frame.text.tolist(), langs):
                _, counts, total = next(gram_counts([text], width))
                if not total[0]:
                    continue
                x = shares(counts, total)[0]
                own = sums.setdefault(lang, [np.zeros(width) for _ in range(3)])
                own[0] += x
                own[1] += x * x
                own[2] += x > 0
                docs_of[lang] = docs_of.get(lang, 0) + 1
        for lang, (one, two, many) in sums.items():
            at = np.flatnonzero(many)
            yield pd.DataFrame({"lang": lang, "slot": np.append(at, -1), "one": np.append(one[at], 0.0), "two": np.append(two[at], 0.0), "many": np.append(many[at], docs_of[lang]).astype(np.int64)})

    cells = staged(
        sample.mapInPandas(spread_of, "lang string, slot long, one double, two double, many long")
        .groupBy("lang", "slot").agg(F.sum("one").alias("one"), F.sum("two").alias("two"), F.sum("many").alias("many"))
    )
    docs_of = {r.lang: r.many for r in cells.where("slot = -1").collect()}
    if not docs_of:
        return empty
    names = sorted(docs_of)
    number = F.element_at(F.create_map(*[F.lit(v) for n in names for v in (n, docs_of[n])]), F.col("lang"))
    mean = F.col("one") / number
    within = F.col("two") / number - mean * mean
    by_slot = cells.where("slot >= 0").groupBy("slot").agg(
        (F.sum(mean * mean) / len(names) - F.pow(F.sum(mean) / len(names), 2)).alias("between"), F.sum(F.greatest(within, F.lit(0.0))).alias("within"), F.sum("many").alias("many")
    )
    strength = F.col("between") / F.sqrt(F.col("within") + 1e-6)
    best = by_slot.where(F.col("many") >= min(LEAST_DOCS, sum(docs_of.values()))).orderBy(strength.desc(), "slot").limit(FEATURES).collect()
    slots = np.sort(np.array([r.slot for r in best], dtype=np.int64))
    index = np.full(width, -1, dtype=np.int64)
    index[slots] = np.arange(len(slots))
    numbers = {n: i for i, n in enumerate(names)}

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first, counts, total in gram_counts(frame.text.tolist(), len(slots), index):
                part = frame.iloc[first : first + len(total)][total > 0]
                cells = [row.tobytes() for row in shares(counts, total)[total > 0].astype(np.float32)]
                yield pd.DataFrame({"language": part.lang.map(numbers).astype(np.int64), "place": part.place, "cells": cells})

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        if not parts:
            return
        rows = pd.concat(parts).sort_values(["place", "language", "cells"], kind="stable")
        x = np.frombuffer(b"".join(rows.cells), dtype=np.float32).reshape(len(rows), -1)
        measured = np.arange(len(rows)) % MEASURED == 0
        model = fit(x, rows.language.to_numpy(), measured, names, slots)
        yield pd.DataFrame({"cells": [a.astype(np.float64).tobytes() for a in (model.weights, model.bias, model.trust, np.array([model.sharpness]))], "nth": range(4)})

    found = sample.mapInPandas(vectors, "language long, place long, cells binary").repartition(1).mapInPandas(train, "cells binary, nth int").collect()
    weights, bias, trust, sharpness = (np.frombuffer(r.cells) for r in sorted(found, key=lambda r: r.nth))
    code = codewords(len(names))
    return Languages(names, code, slots, weights.reshape(len(slots), -1), bias, trust.reshape(code.shape), float(sharpness[0]))


def identified(text: Column, model: Languages) -> Column:
    """struct<lang, score, runner_up, wrong_bits, ambiguous> of a whole text; see ``identify``."""
    names = model.names
    index = np.full(1 << HASH_BITS, -1, dtype=np.int64)
    index[model.slots] = np.arange(len(model.slots))
    radius = max(code_distance(model.code) - 1, 0) // 2

    @F.pandas_udf("lang string, score double, runner_up string, wrong_bits int, ambiguous boolean")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [t or "" for t in part.tolist()]
            out = pd.DataFrame({"lang": UNKNOWN, "score": 0.0, "runner_up": None, "wrong_bits": 0, "ambiguous": True}, index=range(len(texts)))
            for first, counts, total in gram_counts(texts, len(model.slots), index) if names else ():
                rows = np.flatnonzero(total > 0)
                if not len(rows):
                    continue
                _, chance, wrong = model.decode(shares(counts, total)[rows] @ model.weights + model.bias)
                order = np.argsort(-chance, axis=1, kind="stable")
                win = order[:, 0]
                score = chance[np.arange(len(rows)), win]
                out.loc[first + rows, "lang"] = [names[i] for i in win]
                out.loc[first + rows, "score"] = score
                bits = wrong[np.arange(len(rows)), win]
                out.loc[first + rows, "wrong_bits"] = bits
                lead = score
                if len(names) > 1:
                    out.loc[first + rows, "runner_up"] = [names[i] for i in order[:, 1]]
                    lead = score - chance[np.arange(len(rows)), order[:, 1]]
                out.loc[first + rows, "ambiguous"] = (lead < LEAD) | (bits > radius)
            yield out

    return predict(text)


def identify(docs: DataFrame, model: Languages, text_col: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct ``into``: lang, score, runner_up, wrong_bits, ambiguous.

    Bits are predicted from the whole text; the language whose codeword costs the
    least loss, bits weighed by their trust, is chosen.  ``score`` is its share of
    the exponentials of all losses.  ``wrong_bits`` differ from its codeword.  A
    text is ambiguous when the runner-up is within 0.2 or when more bits are wrong
    than the code can correct.  Null texts and texts without a letter are ``und``
    with score 0, as is everything when nothing was learned; equal losses go to the
    first language by code point.  A column named ``into`` is replaced, all other
    columns and repeated rows stay.
    """
    return docs.withColumn(into, identified(F.col(text_col), model))


@query("op12_language_id")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(fold("doc_id", 4) != 2))
    rows = identify(docs.select("doc_id", "text"), model)
    return rows.select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"),
        F.col("language.runner_up").alias("runner_up"), F.col("language.wrong_bits").alias("wrong_bits"), F.col("language.ambiguous").alias("ambiguous"),
    )

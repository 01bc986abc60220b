"""Toxicity: linear model over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import fold, giving_back, query, table, whole_text

#: n-gram lengths and the hashed feature space
SIZES = (3, 4, 5)
HASH_BITS = 20
#: labelled rows the model is fitted on, for each class, chosen by hash
ROWS_PER_CLASS = 3_000
#: features kept after fitting the ratios
FEATURES = 2_048
#: documents a feature must occur in
LEAST_DOCS = 4
STEPS, RIDGE = 300, 0.003
THRESHOLD = 0.7


def ngram_slots(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document number, slot) of every n-gram of every text, one size at a time.

    Case is folded, every text has a blank at both ends, and no n-gram spans two.
    """
    padded = [f" {t.lower()} ".encode("utf-32-le", "surrogatepass") for t in texts]
    codes = np.frombuffer(b"".join(padded), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(p) // 4 for p in padded])
    rolled = codes.copy()
    for n in range(2, max(SIZES) + 1):
        rolled = rolled[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n in SIZES:
            mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n * 0x632BE59B & 0xFFFFFFFF)
            yield owner, (mixed >> np.uint32(32 - HASH_BITS)).astype(np.int32)


def _present(texts: list[str], keep: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct document * 2**HASH_BITS + slot; ``keep`` marks wanted slots."""
    found = []
    for (owner, slots), n in zip(ngram_slots(texts), SIZES):
        at = np.arange(len(slots)) if keep is None else np.flatnonzero(keep[slots])
        at = at[owner[at] == owner[at + n - 1]]
        found.append((owner[at].astype(np.int64) << HASH_BITS) | slots[at])
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def logit(p: float) -> float:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(texts: list[str], toxic: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots, their weights and the intercept.

    ``prior`` is the toxic share of all labelled rows; the sample has another one.
    """
    positive, space = toxic.astype(bool), 1 << HASH_BITS
    for_, against = np.zeros(space, dtype=np.int32), np.zeros(space, dtype=np.int32)
    for text, y in zip(texts, positive):
        (for_ if y else against)[_present([text])] += 1  # of one text: slots alone
    n_for, n_against = max(positive.sum(), 1), max((~positive).sum(), 1)
    all_for, all_against = for_.sum(dtype=np.int64) + space, against.sum(dtype=np.int64) + space
    often = np.flatnonzero(for_ + against >= LEAST_DOCS)
    for_, against = for_[often].astype(np.float64), against[often].astype(np.float64)
    pooled = (for_ + against) / (n_for + n_against)
    spread = np.sqrt(pooled * (1 - pooled) * (1 / n_for + 1 / n_against)) + 1e-9
    strength = np.abs(for_ / n_for - against / n_against) / spread
    best = np.sort(np.argsort(-strength, kind="stable")[:FEATURES])
    best = best[strength[best] > 0]
    chosen = often[best]
    ratio = np.log(((for_[best] + 1) / all_for) / ((against[best] + 1) / all_against))
    del often, for_, against, pooled, spread, strength

    # slots of all texts would take more than the texts: the chosen ones are looked up again
    keep = np.zeros(space, dtype=bool)
    keep[chosen] = True
    x = np.zeros((len(texts), len(chosen)), dtype=np.float32)
    for i, text in enumerate(texts):
        x[i, np.searchsorted(chosen, _present([text], keep))] = 1
    x *= ratio.astype(np.float32)
    # logistic loss with a ridge, by accelerated gradient steps
    y = positive.astype(np.float64)
    w, b = np.zeros(len(chosen)), 0.0
    bound = 0.25 + RIDGE
    if len(chosen):
        v = np.ones(len(chosen), dtype=np.float32)
        for _ in range(30):  # largest eigenvalue of the features' second moments
            v = x.T @ (x @ v)
            v /= np.linalg.norm(v) + 1e-12
        bound = 0.25 * (float(np.linalg.norm(x @ v) ** 2) / len(texts) + 1) * 1.1 + RIDGE
    step, ahead_w, ahead_b, speed = 1 / bound, w.copy(), b, 1.0
    for _ in range(STEPS):
        z = x @ ahead_w.astype(np.float32) + ahead_b
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        new_w = ahead_w - step * (x.T @ error.astype(np.float32) / len(texts) + RIDGE * ahead_w)
        new_b = ahead_b - step * error.mean()
        new_speed = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead_w = new_w + (speed - 1) / new_speed * (new_w - w)
        ahead_b = new_b + (speed - 1) / new_speed * (new_b - b)
        w, b, speed = new_w, new_b, new_speed
    shift = logit(prior) - logit(positive.mean())
    return chosen.astype(np.int64), w * ratio, float(b + shift)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_class: int = ROWS_PER_CLASS) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on at most ``rows_per_class`` labelled rows of each class.

    Ids with fold 1 of 3 are held out.  Null labels and ids count as unlabelled,
    of several labels of one id the largest holds.  Without rows of both classes
    the model has no features and scores everything with the prior.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col, 3) != 1))
        .groupBy(F.col(id_col).alias("label_id")).agg((F.max(label_col) > 0).cast("int").alias("label_toxic"))
    )
    counts = {r.label_toxic: r["count"] for r in known.groupBy("label_toxic").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    flat = np.empty(0, np.int64), np.empty(0), float(logit(prior))
    if not counts.get(0) or not counts.get(1):
        return flat
    by_hash = known.withColumn("label_place", F.xxhash64("label_id"))
    sample = by_hash.where("label_toxic = 1").orderBy("label_place", "label_id").limit(rows_per_class).unionByName(
        by_hash.where("label_toxic = 0").orderBy("label_place", "label_id").limit(rows_per_class)
    )
    texts = docs.select(F.col(id_col).alias("doc"), whole_text(text_col).alias("body"))
    found = texts.join(F.broadcast(sample), F.col("doc") == F.col("label_id")).select("label_place", "label_id", "body", "label_toxic")

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        if not parts:
            return
        rows = pd.concat(parts).sort_values(["label_place", "label_id", "body"], kind="stable")
        if rows.label_toxic.nunique() < 2:
            return
        slots, weights, intercept = fit(rows.body.tolist(), rows.label_toxic.to_numpy(), prior)
        yield pd.DataFrame({"slot": np.append(slots, -1), "weight": np.append(weights, intercept)})

    model = found.repartition(1).mapInPandas(giving_back(learn), "slot long, weight double").collect()
    if not model:
        return flat
    own = [r for r in model if r.slot >= 0]
    return np.array([r.slot for r in own], np.int64), np.array([r.weight for r in own]), next(r.weight for r in model if r.slot < 0)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of a toxic label from the whole text."""
    slots, weights, intercept = model
    slots, weights = slots.astype(np.int32), weights.astype(np.float64)

    @F.pandas_udf("double")
    @giving_back
    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight_of = np.zeros(1 << HASH_BITS)
        weight_of[slots] = weights
        keep = weight_of != 0
        for part in parts:
            texts, sums = part.tolist(), np.full(len(part), intercept)
            first = 0
            while first < len(texts):  # a dozen bytes and more for every character
                last, chars = first, 0
                while last < len(texts) and (last == first or chars + len(texts[last]) < 500_000):
                    chars, last = chars + len(texts[last]), last + 1
                seen = _present(texts[first:last], keep)
                sums[first:last] += np.bincount(seen >> HASH_BITS, weight_of[seen & ((1 << HASH_BITS) - 1)], last - first)
                first = last
            del part, texts  # before the next batch comes
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums, -30, 30))))

    return docs.withColumn(into, probability(whole_text(text_col)))


def drop_toxic(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that score below ``threshold``, with all their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("whole"), F.col(text_col).alias("text"))
    return score(rows, model).where(F.col("score") < threshold).select("whole.*")


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )

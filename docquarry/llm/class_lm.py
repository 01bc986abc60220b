"""Class-based bigram language model: exchange clustering of words, smoothed scores."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import fold, query, table, whole_text
from docquarry.session import staged

#: word classes; words whose classes the exchange finds, the others join by their contexts
CLASSES, CORE = 32, 500
SWEEPS = 8
#: classes of the core model that are no word class, and the mark of an unseen word
REST, END, UNSEEN = CLASSES, CLASSES + 1, 255
#: tokens of one block and words of one bucket, at most on average
BLOCK_TOKENS, BUCKET_WORDS = 2_000_000, 150_000
#: strength of the prior of a class's transitions
PRIOR = 2.0


def _packed(tokens: np.ndarray) -> bytes:
    """Low and high halves apart: the high ones are nearly all zero."""
    return (tokens & 0xFFFF).astype("<u2").tobytes() + (tokens >> 16).astype("<u2").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    halves = np.frombuffer(data, dtype="<u2").astype(np.int32)
    return halves[: len(halves) // 2] | halves[len(halves) // 2 :] << 16


def _blocks(docs: DataFrame, id_col: str, text_col: str, held: str) -> DataFrame:
    """Staged rows of some thousand documents each, tokens as numbers of the block's own words.

    ``places`` numbers the words from 0 by first use; ``words`` has their hashes
    and ``trained`` how often training documents of the block use them.
    """

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, nth = TaskContext.get().partitionId(), 0

        def block(rows: list) -> pd.DataFrame:
            tokens = np.concatenate([r[2] for r in rows])
            train = np.repeat([not r[1] for r in rows], [len(r[2]) for r in rows])
            return pd.DataFrame({
                "block": [part << 32 | nth],
                "ids": [[r[0] for r in rows]],
                "held": [[r[1] for r in rows]],
                "lengths": [np.array([len(r[2]) for r in rows], dtype=np.int64)],
                "tokens": [_packed(tokens)],
                "words": [np.array([xxhash.xxh64_intdigest(w) for w in places], dtype="<u8").tobytes()],
                "trained": [np.bincount(tokens[train], minlength=len(places)).astype("<i4").tobytes()],
            })

        rows, size = [], 0
        places: dict[bytes, int] = defaultdict()
        places.default_factory = places.__len__
        for frame in frames:
            for doc, text, is_held in zip(frame.doc, frame.body, frame.held):
                words = text.encode("utf-8", "surrogatepass").lower().split()
                rows.append((None if pd.isna(doc) else int(doc), bool(is_held), np.fromiter(map(places.__getitem__, words), np.int32, len(words))))
                size += len(words)
                if size >= BLOCK_TOKENS:
                    yield block(rows)
                    rows, size, nth = [], 0, nth + 1
                    places.clear()
        if rows:
            yield block(rows)

    schema = "block long, ids array<long>, held array<boolean>, lengths array<long>, tokens binary, words binary, trained binary"
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), whole_text(text_col).alias("body"), F.expr(held).alias("held"))
    return staged(rows.mapInPandas(number, schema))


def _slices(words: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Bucket numbers with the places of their words, in the order of the hashes."""
    order = np.argsort(words, kind="stable")
    of = (words[order] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    cuts = np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))
    for b in range(buckets):
        if cuts[b] < cuts[b + 1]:
            yield b, order[cuts[b] : cuts[b + 1]]


def _counted(blocks: DataFrame, buckets: int) -> tuple[int, int, np.ndarray]:
    """Tokens and distinct tokens in training texts, without ends, and the core words' hashes."""

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for words, trained in zip(frame.words, frame.trained):
                words, trained = np.frombuffer(words, "<u8"), np.frombuffer(trained, "<i4")
                rows = [(b, words[at].tobytes(), trained[at].tobytes()) for b, at in _slices(words, buckets)]
                yield pd.DataFrame(rows, columns=["bucket", "words", "trained"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        words = np.concatenate([np.frombuffer(w, "<u8") for w in group.words])
        trained = np.concatenate([np.frombuffer(n, "<i4") for n in group.trained])
        words, at = np.unique(words, return_inverse=True)
        sums = np.bincount(at, trained, len(words)).astype(np.int64)
        top = np.lexsort((words, -sums))[:CORE]
        top = top[sums[top] > 0]
        return pd.DataFrame({
            "word": np.append(words[top].view(np.int64), 0), "n": np.append(sums[top], sums.sum()), "distinct": np.append(np.zeros(len(top), np.int64), (sums > 0).sum()),
            "total": np.append(np.zeros(len(top), bool), True),
        })

    found = staged(
        blocks.select("words", "trained").mapInPandas(deal, "bucket int, words binary, trained binary")
        .groupBy("bucket").applyInPandas(add, "word long, n long, distinct long, total boolean")
    )
    whole = found.where("total").agg(F.sum("n").alias("n"), F.sum("distinct").alias("v")).first()
    core = found.where("NOT total").orderBy(F.desc("n"), "word").limit(CORE).collect()
    return whole.n or 0, whole.v or 0, np.array([r.word for r in core], dtype=np.int64).view(np.uint64)


def _training_pairs(tokens: np.ndarray, lengths: np.ndarray, held: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes before and at every place of the training texts, ends included.

    ``tokens`` are classes of all texts in a row; an end stands before each text.
    """
    starts = np.cumsum(lengths) - lengths
    with_ends = np.insert(tokens, starts, end)  # every text's end stands for its begin
    lengths = lengths + 1
    after = np.append(with_ends[1:], with_ends.dtype.type(end))
    after[np.cumsum(lengths) - 1] = end
    keep = np.repeat(~held, lengths)
    return with_ends[keep], after[keep]


def exchange(pairs: np.ndarray, words: int) -> np.ndarray:
    """Classes of the core words; ``pairs`` counts words and then the rest and the end.

    Words move one by one to the class that raises the likelihood of the class
    bigrams most, until a sweep moves none.
    """
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    of = np.concatenate((np.arange(words) % CLASSES, [REST, END]))
    size = CLASSES + 2
    n = np.zeros((size, size))
    np.add.at(n, (of[:, None], of[None, :]), pairs)
    ks = np.arange(CLASSES)
    for _ in range(SWEEPS):
        moved = 0
        for w in range(words):
            own = pairs[w, w]
            right = np.bincount(of, pairs[w], size)
            left = np.bincount(of, pairs[:, w], size)
            right[of[w]] -= own
            left[of[w]] -= own
            n[of[w], :] -= right
            n[:, of[w]] -= left
            n[of[w], of[w]] -= own
            rows, cols = n[:CLASSES], n[:, :CLASSES].T
            gain = (f(rows + right) - f(rows)).sum(1) + (f(cols + left) - f(cols)).sum(1)
            both = n[ks, ks]
            gain -= f(both + right[ks]) - f(both) + f(both + left[ks]) - f(both)
            gain += f(both + right[ks] + left[ks] + own) - f(both)
            out, into = n.sum(1)[:CLASSES], n.sum(0)[:CLASSES]
            gain -= f(out + right.sum() + own) - f(out) + f(into + left.sum() + own) - f(into)
            best = int(np.argmax(gain))
            moved += best != of[w]
            of[w] = best
            n[best, :] += right
            n[:, best] += left
            n[best, best] += own
        if not moved:
            break
    return of[:words]


def _core_of(words: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Number of each word among the core words (sorted by hash), their count for others."""
    if not len(core):
        return np.zeros(len(words), dtype=np.int64)
    at = np.minimum(np.searchsorted(core, words), len(core) - 1)
    return np.where(core[at] == words, at, len(core))


def score_texts(docs: DataFrame, held: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held`` is an SQL condition; rows that meet it are scored but not learnt from.
    Words have A-Z in lower case; every text has one end token.  ``score`` is log10
    of P(class | class before) * P(word | class) summed over tokens.  Transitions
    are smoothed by the classes' own shares; each class keeps the share of its
    words seen once for words never seen (one token type), after which the next
    class follows the overall shares.  So the probabilities of all tokens sum to 1.
    Null is the empty text, which has one token; null ids stay null; rows that
    repeat are scored alike; an empty table gives no rows; without training rows
    all words are unseen.

    Blocks hold some thousand documents as numbers of their own words.  Word
    statistics of all blocks meet in buckets of the word hash, as arrays; the
    answers go back to the blocks.  Only class tables, the core words and their
    pairs reach the driver: their size is fixed by CLASSES and CORE.
    """
    blocks = _blocks(docs, id_col, text_col, held)
    entries = blocks.agg(F.sum(F.octet_length("words")).alias("n"), F.count("*").alias("blocks")).first()
    buckets = max(8, -(-(entries.n or 0) // 8 // BUCKET_WORDS))
    texts = blocks.select(F.sum(F.size(F.filter("held", lambda x: ~x))).alias("n")).first().n or 0
    n_words, v_words, core = _counted(blocks, buckets)
    core = np.sort(core)
    m = len(core)

    def core_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((m + 2) * (m + 2), dtype=np.int64)
        for frame in frames:
            for tokens, lengths, is_held, words in zip(frame.tokens, frame.lengths, frame.held, frame.words):
                of = _core_of(np.frombuffer(words, "<u8"), core).astype(np.int32)
                before, after = _training_pairs(of[_unpacked(tokens)], np.asarray(lengths), np.asarray(is_held, bool), m + 1)
                counts += np.bincount(before * (m + 2) + after, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"pair": at, "n": counts[at]})

    used = ["tokens", "lengths", "held", "words"]
    found = blocks.select(*used).mapInPandas(core_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    pairs = np.zeros((m + 2) * (m + 2))
    pairs[found.pair.to_numpy(np.int64)] = found.n.to_numpy()
    pairs = pairs.reshape(m + 2, m + 2)
    core_class = exchange(pairs, m)
    of = np.concatenate((core_class, [REST, END])).astype(np.int64)
    seen = np.zeros((CLASSES + 2, CLASSES + 2))
    np.add.at(seen, (of[:, None], of[None, :]), pairs)
    seen += 0.5
    # log-likelihood of a word of class k after class g, and before class h
    enter = np.log(seen / seen.sum(1, keepdims=True))[:, :CLASSES] - np.log(seen.sum(0)[:CLASSES])
    leave = np.log(seen / seen.sum(1, keepdims=True))[:CLASSES].T

    def contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, tokens, lengths, is_held, words, trained in zip(frame.block, frame.tokens, frame.lengths, frame.held, frame.words, frame.trained):
                words, trained = np.frombuffer(words, "<u8"), np.frombuffer(trained, "<i4")
                tokens, lengths, is_held = _unpacked(tokens), np.asarray(lengths), np.asarray(is_held, bool)
                in_core = _core_of(words, core)
                classes = of[in_core].astype(np.uint8)[tokens]
                stop = np.cumsum(lengths)
                left, right = np.empty_like(classes), np.empty_like(classes)
                left[1:], right[:-1] = classes[:-1], classes[1:]
                left[(stop - lengths)[lengths > 0]] = END
                right[stop[lengths > 0] - 1] = END
                take = ~np.repeat(is_held, lengths) & (classes == REST)
                order = np.argsort(tokens[take], kind="stable")
                around = np.stack((left[take][order], right[take][order]), axis=1).astype(np.uint8)
                n = np.bincount(tokens[take], minlength=len(words))
                first = np.cumsum(n) - n
                rows = []
                for b, at in _slices(words, buckets):
                    inner = np.repeat(first[at] - (np.cumsum(n[at]) - n[at]), n[at]) + np.arange(n[at].sum())
                    rows.append((block, b, words[at].tobytes(), trained[at].tobytes(), n[at].astype("<i4").tobytes(), around[inner].tobytes()))
                yield pd.DataFrame(rows, columns=["block", "bucket", "words", "trained", "n", "around"])

    def assign(group: pd.DataFrame) -> pd.DataFrame:
        words = [np.frombuffer(w, "<u8") for w in group.words]
        sizes = [len(w) for w in words]
        every, at = np.unique(np.concatenate(words), return_inverse=True)
        totals = np.bincount(at, np.concatenate([np.frombuffer(x, "<i4") for x in group.trained]), len(every)).astype(np.int64)
        n = np.concatenate([np.frombuffer(x, "<i4") for x in group.n])
        around = np.frombuffer(b"".join(group.around), np.uint8).reshape(-1, 2)
        whose = np.repeat(at, n)
        # contexts of every word, counted by class
        size = CLASSES + 2
        count = lambda side: np.bincount(whose * size + around[:, side], minlength=len(every) * size).reshape(-1, size)
        likely = count(0).astype(np.float32) @ enter.astype(np.float32)
        likely += count(1).astype(np.float32) @ leave.astype(np.float32)
        best = np.argmax(likely, axis=1).astype(np.uint8)
        mine = _core_of(every, core)
        best = np.where(mine < m, core_class[np.minimum(mine, max(m - 1, 0))] if m else 0, best).astype(np.uint8)
        best[totals == 0] = UNSEEN
        known = totals > 0
        class_total = np.bincount(best[known], totals[known], CLASSES).astype(np.int64)
        class_once = np.bincount(best[totals == 1], minlength=CLASSES).astype(np.int64)
        rows, start = [], 0
        for block, size in zip(group.block, sizes):
            here = at[start : start + size]
            rows.append((block, group.bucket.iloc[0], best[here].tobytes(), totals[here].astype("<i8").tobytes(), None, None))
            start += size
        rows.append((-1, group.bucket.iloc[0], None, None, class_total, class_once))
        return pd.DataFrame(rows, columns=["block", "bucket", "classes", "totals", "class_total", "class_once"])

    answers = staged(
        blocks.select("block", *used, "trained")
        .mapInPandas(contexts, "block long, bucket int, words binary, trained binary, n binary, around binary")
        .groupBy("bucket")
        .applyInPandas(assign, "block long, bucket int, classes binary, totals binary, class_total array<long>, class_once array<long>")
    )
    sums = answers.where("block < 0").select(F.posexplode(F.arrays_zip("class_total", "class_once")).alias("k", "c")).groupBy("k").agg(
        F.sum("c.class_total").alias("n"), F.sum("c.class_once").alias("once")
    ).collect()
    total, once = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums:
        total[r.k], once[r.k] = r.n, r.once
    unseen = (once + 0.5) / (total + 1)
    n_all, v_all = n_words + texts, v_words + (texts > 0)
    base_of = lambda c: np.log10((c + 0.1) / (n_all + 0.1 * (v_all + 1)))

    def classed(_: tuple, block: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        words = np.frombuffer(row.words, "<u8")
        classes, totals = np.empty(len(words), np.uint8), np.empty(len(words), np.int64)
        by_bucket = {b: (c, t) for b, c, t in zip(answer.bucket, answer.classes, answer.totals)}
        for b, at in _slices(words, buckets):
            classes[at], totals[at] = np.frombuffer(by_bucket[b][0], np.uint8), np.frombuffer(by_bucket[b][1], "<i8")
        tokens, lengths = _unpacked(row.tokens), np.asarray(row.lengths)
        owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        k = np.minimum(classes, CLASSES - 1)
        with np.errstate(divide="ignore"):
            emitted = np.where(classes == UNSEEN, 0, np.log10((1 - unseen[k]) * totals / np.maximum(total[k], 1)))
        per_doc = lambda values: np.bincount(owner, values[tokens], len(lengths))
        sequence = classes[tokens]
        as_class = np.where(sequence == UNSEEN, 0, sequence).astype(np.int16)
        before, after = _training_pairs(as_class, lengths, np.asarray(row.held, bool), CLASSES)
        steps = np.bincount(before * (CLASSES + 1) + after, minlength=(CLASSES + 1) ** 2)
        return pd.DataFrame({
            "ids": [row.ids], "held": [row.held], "lengths": [lengths], "sequence": [sequence.tobytes()], "steps": [steps],
            "known": [per_doc((totals > 0).astype(float)).astype(np.int64)], "base": [per_doc(base_of(totals))], "emitted": [per_doc(emitted)],
        })

    schema = "ids array<long>, held array<boolean>, lengths array<long>, sequence binary, steps array<long>, known array<long>, base array<double>, emitted array<double>"
    done = staged(
        blocks.groupBy("block").cogroup(answers.where("block >= 0").select("block", "bucket", "classes", "totals").groupBy("block")).applyInPandas(classed, schema)
    )
    steps = np.zeros((CLASSES + 1) ** 2)
    for r in done.select(F.posexplode("steps").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():
        steps[r.at] = r.n
    steps = steps.reshape(CLASSES + 1, CLASSES + 1)
    share = (steps.sum(0) + 1) / (steps.sum() + CLASSES + 1)
    follow = (steps + PRIOR * share) / (steps.sum(1, keepdims=True) + PRIOR)
    follow = np.vstack((follow, share))  # after an unseen word
    worth = np.log10(np.hstack((follow, follow[:, :CLASSES] @ unseen[:, None])))  # last column: an unseen word

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                sequence, lengths = np.frombuffer(row.sequence, np.uint8).astype(np.int16), np.asarray(row.lengths)
                sequence[sequence == UNSEEN] = CLASSES + 1
                starts = np.cumsum(lengths) - lengths
                padded = np.insert(sequence, starts, CLASSES)
                after = np.append(padded[1:], padded.dtype.type(CLASSES))
                after[np.cumsum(lengths + 1) - 1] = CLASSES
                owner = np.repeat(np.arange(len(lengths)), lengths + 1)
                moved = np.bincount(owner, worth[padded, after], len(lengths))
                yield pd.DataFrame({
                    id_col: pd.array([None if i is None or pd.isna(i) else int(i) for i in row.ids], dtype="Int64"),
                    "held_out": np.asarray(row.held, bool),
                    "n_tokens": lengths + 1,
                    "n_known": np.asarray(row.known) + (texts > 0),
                    "train_tokens": n_all,
                    "base_score": np.asarray(row.base) + base_of(texts),
                    "score": np.asarray(row.emitted) + moved,
                })

    return done.drop("steps").mapInPandas(
        scored, f"{id_col} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


@query("op6_class_lm")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held", fold("doc_id", 10) == 0)
    return score_texts(docs, "held")

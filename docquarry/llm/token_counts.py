"""Token counts of a BPE piece model by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import query, table, whole_text

#: stands for a blank inside pieces
BLANK = "▁"
#: words whose counts a worker remembers
REMEMBERED = 400_000
#: words merged in one array
BATCH_WORDS = 50_000
LIMIT = 4096
#: rank of a pair that no piece joins
NONE = 1 << 40


class PieceMerges:
    """Merge table of a BPE piece model and the counts it gives."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        ids = {model.id_to_piece(i): i for i in plain}
        # equal scores share a rank: the leftmost pair goes first
        _, ranks = np.unique([-model.get_score(i) for i in plain], return_inverse=True)
        rank_of = dict(zip(plain, ranks.tolist()))
        pairs = []
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs.append((left << 20 | right, rank_of[i], i))
        table = np.array(pairs, dtype=np.int64).reshape(-1, 3)
        self.ranks, self.merged = np.append(table[:, 1], NONE), np.append(table[:, 2], 0)
        self._index(table[:, 0])
        #: characters without a piece count their UTF-8 bytes
        self.first_unknown = size
        points = np.arange(0x110000)
        self.symbol = size + 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        longer = [p for p in ids if len(p) > 1]
        #: no piece goes over a line end, nor over the start of a run of blanks
        self.lines_apart = not any("\n" in p for p in longer)
        self.words_apart = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in longer)
        self.known: dict[str, int] = {}

    def words(self, text: str) -> list[str]:
        """The text cut where no merge can cross; blanks written as ``BLANK``."""
        if not text:
            return []
        if not (self.words_apart and self.lines_apart):
            return [BLANK + text.replace(" ", BLANK)]
        if "  " in text or BLANK in text or text[0] == " " or "\n " in text:
            return re.findall(f"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+", BLANK + text.replace(" ", BLANK))
        return (BLANK + text.replace(" ", " " + BLANK)).replace("\n", " \n ").split(" ")

    def _index(self, keys: np.ndarray) -> None:
        """Two hash tables: the second holds what met a taken slot in the first."""
        self.bits, self.factors = (22, 18), [0x9E3779B97F4A7C15, 0]
        self.slots = [np.full(1 << b, len(keys), dtype=np.int32) for b in self.bits]
        self.keys = np.append(keys, -1)
        at = self._slot(keys, 0)
        self.slots[0][at] = np.arange(len(keys))
        rest = np.flatnonzero(self.slots[0][at] != np.arange(len(keys)))
        factor = 0xC2B2AE3D27D4EB4F
        while True:  # until no two of the few left share a slot
            self.factors[1] = factor
            at = self._slot(keys[rest], 1)
            if len(np.unique(at)) == len(rest):
                break
            factor = (factor * 6364136223846793005 + 1442695040888963407) % (1 << 64) | 1
        self.slots[1][at] = rest

    def _slot(self, pairs: np.ndarray, level: int) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(self.factors[level]) >> np.uint64(64 - self.bits[level])).astype(np.int64)

    def _find(self, pairs: np.ndarray) -> np.ndarray:
        """Number of each pair in the merge table; its length where there is none."""
        at = self.slots[0][self._slot(pairs, 0)].astype(np.int64)
        other = np.flatnonzero((self.keys[at] != pairs) & (at < len(self.keys) - 1))
        if len(other):
            at[other] = self.slots[1][self._slot(pairs[other], 1)]
            at[other[self.keys[at[other]] != pairs[other]]] = len(self.keys) - 1
        return at

    def _pairs(self, symbols: np.ndarray, owner: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Numbers of the pairs that begin at the places ``left``."""
        right = np.minimum(left + 1, len(symbols) - 1)
        found = self._find(symbols[left] << 20 | symbols[right])
        found[(owner[left] != owner[right]) | (right == left)] = len(self.keys) - 1
        return found

    def merge(self, words: list[str]) -> np.ndarray:
        """Symbols left of every word when no pair can be merged any more.

        One round merges the best pair of each word, from the left where it
        occurs several times; only pairs beside a merge are looked up again.
        """
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbols, owner = self.symbol[points], np.repeat(np.arange(len(words)), sizes)
        left = np.zeros(len(words), dtype=np.int64)
        single = np.zeros(len(words), dtype=bool)  # words that take one merge at a time
        pairs = self._pairs(symbols, owner, np.arange(len(symbols)))
        while len(symbols):
            rank = self.ranks[pairs]
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lengths = np.diff(np.append(starts, len(symbols)))
            best = np.minimum.reduceat(rank, starts)
            done = best == NONE
            if done.any():
                out = np.repeat(done, lengths)
                left += np.bincount(owner[out], np.maximum(symbols[out] - self.first_unknown, 1), len(words)).astype(np.int64)
                symbols, owner, pairs, rank = symbols[~out], owner[~out], pairs[~out], rank[~out]
                best, lengths = best[~done], lengths[~done]
                if not len(symbols):
                    break
            chosen = rank == np.repeat(best, lengths)
            # of overlapping pairs every other one counts, from the left
            begins = chosen.copy()
            begins[1:] &= ~chosen[:-1]
            spots = np.flatnonzero(chosen)
            spots = spots[(spots - np.maximum.accumulate(np.where(begins, np.arange(len(chosen)), 0))[spots]) % 2 == 0]
            first = np.concatenate(([True], owner[spots[1:]] != owner[spots[:-1]]))
            if single.any():
                keep = first | ~single[owner[spots]]
                spots, first = spots[keep], first[keep]
            new = self._applied(symbols, owner, pairs, spots)
            if not first.all():
                # where a merge makes a better pair than its own, that one goes first
                top = np.full(len(words), NONE)
                top[owner[spots]] = rank[spots]
                changed = new[3]
                better = self.ranks[new[2][changed]] < top[new[1][changed]]
                several = np.zeros(len(words), dtype=bool)
                several[owner[spots[~first]]] = True
                again = np.unique(new[1][changed][better])
                again = again[several[again]]
                if len(again):
                    single[again] = True
                    new = self._applied(symbols, owner, pairs, spots[first | ~single[owner[spots]]])
            symbols, owner, pairs, _ = new
        return left

    def _applied(self, symbols: np.ndarray, owner: np.ndarray, pairs: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, owners and pairs after merging at ``spots``; places whose pair is new."""
        merged = symbols.copy()
        merged[spots] = self.merged[pairs[spots]]
        keep = np.ones(len(symbols), dtype=bool)
        keep[spots + 1] = False
        merged, owner, pairs = merged[keep], owner[keep], pairs[keep]
        at = spots - np.arange(len(spots))
        beside = np.zeros(len(merged), dtype=bool)
        beside[at] = True
        beside[np.maximum(at - 1, 0)] = True
        changed = np.flatnonzero(beside)
        pairs[changed] = self._pairs(merged, owner, changed)
        return merged, owner, pairs, changed

    def counts(self, texts: list[str]) -> list[int]:
        cut = [self.words(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = sorted(set().union(*cut) - self.known.keys(), key=len)
        known = self.known
        first = 0
        while first < len(fresh):
            # long words in smaller groups
            group = max(1, min(BATCH_WORDS, 1_000_000 // max(len(fresh[first]), 1)))
            part = fresh[first : first + group]
            known.update(zip(part, self.merge(part).tolist()))
            first += group
        return [sum(map(known.__getitem__, words)) for words in cut]


@lru_cache(maxsize=2)
def _merges(path: str) -> PieceMerges:
    return PieceMerges(path)


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT, text_col: str = "text", limit_col: str = "over_limit") -> DataFrame:
    """``docs`` with n_bytes, n_tokens and whether the tokens exceed ``limit``.

    Counts equal those of the piece library for the model at ``model_path`` (a
    path that every executor has), without begin or end.  A null or empty text
    has no tokens; rows that repeat are counted alike; no text is cut.

    A text falls into words that no merge can cross.  The distinct words of a
    batch lie in one ragged array of symbols.  Every round finds the lowest rank
    in each word and merges that pair in all words at once, until no word has a
    pair left; the symbols that survive are the count.
    """

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        merges = _merges(model_path)
        for part in parts:
            texts = part.tolist()
            out: list[int] = []
            first = 0
            while first < len(texts):
                last, chars = first, 0
                while last < len(texts) and (last == first or chars + len(texts[last]) < 4_000_000):
                    chars, last = chars + len(texts[last]), last + 1
                out += merges.counts(texts[first:last])
                first = last
            yield pd.Series(out, dtype="int64")

    return (
        docs.withColumn("n_bytes", F.octet_length(whole_text(text_col)).cast("long"))
        .withColumn("n_tokens", count(whole_text(text_col)))
        .withColumn(limit_col, F.col("n_tokens") > limit)
    )


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")

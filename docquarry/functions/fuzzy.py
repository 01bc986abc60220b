"""Path similarity.

The ratios follow the public definitions of the Indel similarity family: the
normalised insert/delete distance of two strings, of their sorted tokens, of
their token sets, and of the best-fitting substring.  One string is matched
against whole Arrow batches of candidates, in parallel over the partitions.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from docquarry import constants as C
from docquarry.functions.paths import last_segment

_NOT_WORD = re.compile(r"\W")


def lookup_form(text: str) -> str:
    return _NOT_WORD.sub(" ", unicodedata.normalize("NFC", text)).strip().lower()


def _places(text: str) -> dict[str, int]:
    """For every character the bit set of its positions."""
    out: dict[str, int] = {}
    for i, ch in enumerate(text):
        out[ch] = out.get(ch, 0) | (1 << i)
    return out


def _shared(places: dict[str, int], size: int, other: str) -> int:
    """Longest common subsequence of a prepared text and another, a bit per row cell."""
    row = full = (1 << size) - 1
    for ch in other:
        hit = row & places.get(ch, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def common_length(a: str, b: str) -> int:
    return _shared(_places(a), len(a), b)


def ratio(a: str, b: str) -> float:
    size = len(a) + len(b)
    return 100.0 if size == 0 else 200.0 * common_length(a, b) / size


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = left & right
    if shared and (left <= right or right <= left):
        return 100.0
    only_left = " ".join(sorted(left - right))
    only_right = " ".join(sorted(right - left))
    shared_size = len(" ".join(sorted(shared)))
    gap = 1 if shared else 0
    whole_left = shared_size + gap + len(only_left)
    whole_right = shared_size + gap + len(only_right)
    apart = len(only_left) + len(only_right) - 2 * common_length(only_left, only_right)
    best = 100.0 * (1 - apart / (whole_left + whole_right))
    if shared:
        best = max(
            best,
            100.0 * (1 - (gap + len(only_left)) / (shared_size + whole_left)),
            100.0 * (1 - (gap + len(only_right)) / (shared_size + whole_right)),
        )
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string against any window of the longer one."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = _best_window(short, long)
    if best < 100.0 and len(a) == len(b):
        best = max(best, _best_window(long, short))
    return best


def _best_window(short: str, long: str) -> float:
    """Windows that begin or end with a foreign character are never the best ones."""
    size, places = len(short), _places(short)
    best = 0.0
    for end in range(1, len(long) + size):
        window = long[max(0, end - size) : end]
        if window[-1 if end <= len(long) else 0] not in places:
            continue
        total = size + len(window)
        if 200.0 * len(window) / total > best:
            best = max(best, 200.0 * _shared(places, size, window) / total)
    return best


def path_score(query: str, candidate: str, cutoff: float = C.FUZZY_CUTOFF) -> float:
    """Weighted similarity of two paths in 0..1; parts below the cutoff count 0."""
    return _score(lookup_form(query), lookup_form(candidate), cutoff, 0.0)


def _score(query: str, candidate: str, cutoff: float, needed: float) -> float:
    if len(query) >= C.FUZZY_PREFIX and query[: C.FUZZY_PREFIX] not in candidate:
        return 0.0

    def part(value: float) -> float:
        return value / 100.0 if value >= cutoff * 100 else 0.0

    score = C.FUZZY_TOKEN_SET * part(token_set_ratio(query, candidate))
    score += C.FUZZY_TOKEN_SORT * part(token_sort_ratio(query, candidate))
    # the windowed ratio is the dear one; skip it where even 100 could not help
    if score + C.FUZZY_PARTIAL >= needed:
        score += C.FUZZY_PARTIAL * part(partial_ratio(query, candidate))
    return max(0.0, min(1.0, score))


def path_score_column(
    query: str, candidate: Column, cutoff: float = C.FUZZY_CUTOFF, needed: float = 0.0
) -> Column:
    """``path_score`` of a literal query against a column.

    Scores that stay below ``needed`` may be returned too low; pass 0 for exact
    values everywhere.
    """
    prepared = lookup_form(query)

    @F.pandas_udf(DoubleType())
    def score(paths: pd.Series) -> pd.Series:
        return paths.map(
            lambda p: None if p is None else _score(prepared, lookup_form(p), cutoff, needed)
        )

    return score(candidate)


def tail_bonus(query: str, candidate: Column) -> Column:
    """Extra score when the last path segments agree in full or in part."""
    parts = [p for p in query.split("::") if p]
    tail = F.lower(last_segment(F.regexp_replace(candidate, ":+$", "")))
    if not parts:
        return F.lit(0.0)
    mine = parts[-1].lower()
    return (
        F.when(F.coalesce(tail, F.lit("")) == "", 0.0)
        .when(tail == mine, C.FUZZY_SAME_TAIL_BONUS)
        .when(tail.contains(mine), C.FUZZY_PART_TAIL_BONUS)
        .when(F.lit(mine).contains(tail), C.FUZZY_PART_TAIL_BONUS * C.FUZZY_REVERSE_FACTOR)
        .otherwise(0.0)
    )


def adaptive_threshold(query: str) -> float:
    """Short queries are matched more leniently."""
    length = len(query.strip())
    for longest, threshold in C.FUZZY_THRESHOLDS:
        if length <= longest:
            return threshold
    return C.FUZZY_THRESHOLD_LONG


def adaptive_threshold_column(query: Column) -> Column:
    length = F.length(F.trim(query))
    out = None
    for longest, threshold in C.FUZZY_THRESHOLDS:
        hit = length <= longest
        out = F.when(hit, threshold) if out is None else out.when(hit, threshold)
    return out.otherwise(C.FUZZY_THRESHOLD_LONG)

"""Text normalisation, query words and snippets."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docquarry import constants as C
from docquarry.functions.binding import once


def _unicode_form(form: str):
    @F.pandas_udf(StringType())
    def normalize(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return normalize


# Spark has no Unicode normalisation, so this one step runs as an Arrow batch, and
# only for text that can change: below U+0300 everything is composed already, and
# the second class holds the Latin letters without a compatibility form
_nfc = _unicode_form("NFC")
_nfkc = _unicode_form("NFKC")
_MAY_COMPOSE = r"[^\x{00}-\x{2FF}]"
_MAY_FOLD = r"[^\x{00}-\x{9F}\x{C0}-\x{131}]"


def nfc(text: Column) -> Column:
    return F.coalesce(_nfc(F.when(text.rlike(_MAY_COMPOSE), text)), text)


def nfkc(text: Column) -> Column:
    return F.coalesce(_nfkc(F.when(text.rlike(_MAY_FOLD), text)), text)


def lookup_form(text: Column, composed: bool = False) -> Column:
    """Lower case with punctuation as blanks; pass ``composed`` for NFC input."""
    source = text if composed else nfc(text)
    return F.lower(F.trim(F.regexp_replace(source, r"[^\p{L}\p{N}_]", " ")))


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def query_form(text: Column) -> Column:
    return collapse_whitespace(nfkc(text))


def _literal_map(pairs: dict, value=F.lit) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), value(v))])


def american_spelling(text: Column) -> Column:
    """Replace whole British words and keep the case pattern of each."""
    table = _literal_map(C.SPELLING)

    def respell(word: Column) -> Column:
        target = F.try_element_at(table, F.lower(word))
        first = F.substring(word, 1, 1)
        capital = F.concat(F.upper(F.substring(target, 1, 1)), F.substring(target, 2, 100))
        return (
            F.when(target.isNull(), word)
            .when(word == F.upper(word), F.upper(target))
            .when(first == F.upper(first), capital)
            .otherwise(target)
        )

    return F.array_join(F.transform(F.split(text, " "), respell), " ")


def expand_terms(text: Column) -> Column:
    """Add the long form of known abbreviations; a term is kept once, in order."""
    table = _literal_map(C.TERM_EXPANSIONS, lambda terms: F.array(*[F.lit(t) for t in terms]))
    terms = F.transform(
        F.split(text, " "),
        lambda w: F.coalesce(F.try_element_at(table, F.lower(w)), F.array(w)),
    )
    return F.array_join(F.array_distinct(F.flatten(terms)), " ")


def prepare_query(text: Column) -> Column:
    """The search form of a query column; null when empty or too long."""
    usable = (F.trim(text) != "") & (F.length(F.trim(text)) <= C.MAX_QUERY_LENGTH)
    return F.when(usable, expand_terms(american_spelling(query_form(text))))


def snippet(
    text: Column,
    target: int = C.SNIPPET_TARGET,
    shortest: int = C.SNIPPET_MIN,
    longest: int = C.SNIPPET_MAX,
) -> Column:
    """A readable excerpt: whole sentences, else whole words, else a plain cut.

    A sentence adds at least two characters and so does a word, which bounds how
    many of either can matter; the rest of a long text is never looked at.
    """
    dots = F.lit("...")

    def by_sentence(parts: Column) -> Column:
        def grow(state: Column, i: Column) -> Column:
            ending = F.when(i < F.size(parts), ". ").otherwise("")
            longer = F.concat(state, F.get(parts, i - 1), ending)
            return F.when(F.length(state) >= shortest, state).otherwise(longer)

        steps = F.sequence(F.lit(1), F.least(F.size(parts), F.lit(shortest)))
        return F.aggregate(steps, F.lit(""), grow)

    def add_word(state: Column, word: Column) -> Column:
        longer = F.concat(state["text"], F.when(state["text"] != "", " ").otherwise(""), word)
        return F.when(F.length(state["text"]) >= target, state).otherwise(
            F.struct(longer.alias("text"), state["text"].alias("before"))
        )

    def finish_words(state: Column) -> Column:
        line, before = state["text"], state["before"]
        cut = F.concat(F.substring(text, 1, longest), dots)
        return (
            F.when((F.length(line) >= target) & (F.length(line) + 3 <= longest), F.concat(line, dots))
            .when((F.length(line) >= target) & (before != ""), F.concat(before, dots))
            .when((F.length(line) < target) & (F.length(line) >= shortest), line)
            .otherwise(cut)
        )

    # the last part of a limited split is the unsplit rest and is dropped
    start = F.regexp_replace(text, r"(?U)^\s+", "")
    words = F.filter(F.slice(F.split(start, r"(?U)\s+", target + 1), 1, target), lambda w: w != "")
    empty = F.struct(F.lit("").alias("text"), F.lit("").alias("before"))
    by_word = once(F.aggregate(words, empty, add_word), finish_words)

    sentences = F.split(text, r"(?U)[.!?]\s+", shortest + 1)
    grown = once(sentences, by_sentence)
    fits = once(
        grown, lambda g: F.when(F.length(g).between(shortest, longest), F.trim(g)).otherwise(by_word)
    )
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "").when(F.length(text) <= longest, text).otherwise(fits)
    )


def estimated_tokens(text: Column) -> Column:
    """Four characters to a token."""
    return F.floor(F.length(text) / 4)


def context_window(text: Column, needle: str, reach: int = 100) -> Column:
    """The first hit of ``needle``, ignoring case, with ``reach`` characters around it."""
    at = F.locate(needle.lower(), F.lower(text))
    start = F.greatest(at - reach, F.lit(1))
    length = at + len(needle) + reach - start
    return F.when(at > 0, F.substring(text, start, length))

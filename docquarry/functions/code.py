"""Code examples in documentation text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry import constants as C
from docquarry import schemas
from docquarry.functions.binding import once

_EXAMPLES_DDL = "array<struct<code:string,language:string,detected:boolean>>"


def fenced_blocks(text: Column) -> Column:
    """Every non-empty fenced block as ``struct<tag, code>``, in order."""
    whole = F.regexp_extract_all(text, F.lit(C.FENCED_BLOCK), F.lit(0))
    blocks = F.transform(
        whole,
        lambda block: F.struct(
            F.lower(F.regexp_extract(block, C.FENCED_BLOCK, 1)).alias("tag"),
            F.regexp_replace(F.regexp_extract(block, C.FENCED_BLOCK, 2), r"^\s+|\s+$", "").alias("code"),
        ),
    )
    return F.filter(blocks, lambda b: b["code"] != "")


def code_examples(text: Column, default_language: str = "rust") -> Column:
    """Examples of a text with the tag as language; untagged ones count as detected.

    Untagged blocks get ``default_language``.
    """
    return F.transform(
        fenced_blocks(text),
        lambda b: F.struct(
            b["code"].alias("code"),
            F.when(b["tag"] == "", default_language).otherwise(b["tag"]).alias("language"),
            (b["tag"] == "").alias("detected"),
        ),
    )


def examples_json(text: Column) -> Column:
    """The stored JSON form; null when there is no example."""
    return once(code_examples(text), lambda found: F.when(F.size(found) > 0, F.to_json(found)))


def parse_examples(stored: Column) -> Column:
    """Read stored examples, whichever form they were written in.

    Accepts a list of objects, a list of plain strings, or one plain string.
    """
    as_objects = F.from_json(stored, schemas.EXAMPLES)
    as_strings = F.from_json(stored, schemas.STRINGS)
    trimmed = F.trim(stored)
    single = F.get(F.from_json(F.concat(F.lit("["), trimmed, F.lit("]")), schemas.STRINGS), F.lit(0))

    def wrap(code: Column) -> Column:
        return F.struct(
            code.alias("code"), F.lit("rust").alias("language"), F.lit(False).alias("detected")
        )

    def fill(example: Column) -> Column:
        return F.struct(
            example["code"].alias("code"),
            F.coalesce(example["language"], F.lit("rust")).alias("language"),
            F.coalesce(example["detected"], F.lit(False)).alias("detected"),
        )

    parsed = (
        F.when(trimmed.rlike(r'^\[\s*\{'), F.transform(as_objects, fill))
        .when(trimmed.rlike(r'^\[\s*"'), F.transform(as_strings, wrap))
        .when(trimmed.startswith('"'), F.array(wrap(single)))
    )
    return F.filter(parsed, lambda e: F.coalesce(e["code"], F.lit("")) != "")


def normalize_code(code: Column) -> Column:
    """Drop blank and comment lines and collapse runs of blanks."""
    lines = F.transform(
        F.split(code, "\n"), lambda line: F.trim(F.regexp_replace(line, r"\s+", " "))
    )

    def keep(line: Column) -> Column:
        wanted = line != ""
        for marker in C.COMMENT_MARKERS:
            wanted = wanted & ~line.startswith(marker)
        return wanted

    return F.array_join(F.filter(lines, keep), "\n")


def example_hash(code: Column, language: Column) -> Column:
    """16 hex digits that equal examples of one language share."""
    text = F.concat_ws(":", language, normalize_code(code))
    return F.substring(F.sha2(text, 256), 1, 16)


def embedding_text(code: Column, language: Column, context: Column) -> Column:
    """What an example is embedded from."""
    tag = F.when(
        (F.coalesce(language, F.lit("")) != "") & (language != "unknown"),
        F.concat(F.lit("Language: "), language),
    )
    about = F.when(
        F.coalesce(context, F.lit("")) != "",
        F.concat(F.lit("Context: "), F.substring(context, 1, C.EXAMPLE_CONTEXT_CHARS)),
    )
    return F.concat_ws("\n\n", tag, about, code)

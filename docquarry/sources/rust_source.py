"""Documentation read straight from Rust source files.

A file is one row (``crate``, ``file``, ``text``) and is worked on inside that
row, so no source text is shuffled.  Declarations come from array functions;
macros, whose bodies need brackets counted, from one pass over the pieces of each
file that has a macro in it.
"""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry import constants as C
from docquarry.plans.spread import pieces, spread

ROW = "crate string, item_path string, header string, item_type string, signature string, content string, visibility string"
MACRO_ROW = f"{ROW}, definition string, arms array<string>"
#: a fragment of a macro pattern: its name and kind
FRAGMENT = r"\$(\w+)\s*:\s*(\w+)"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Source files of ``name-version.crate`` archives, one row per file.

    Large files, tests, examples and benches are passed over.
    """
    archives = spark.read.format("binaryFile").load(path).select("path", "content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, blob in zip(batch["path"], batch["content"]):
                crate = re.sub(r"-\d.*$", "", name.rsplit("/", 1)[-1])
                with tarfile.open(fileobj=io.BytesIO(blob), mode="r:gz") as tar:
                    for member in tar:
                        wanted = member.name.endswith(".rs") and member.size <= C.MAX_SOURCE_FILE
                        if not wanted or any(d in member.name for d in C.SKIPPED_DIRECTORIES):
                            continue
                        text = tar.extractfile(member).read().decode("utf-8", errors="ignore")
                        yield pd.DataFrame({"crate": [crate], "file": [member.name], "text": [text]})

    return archives.mapInPandas(unpack, "crate string, file string, text string")


def module_path(crate: Column, file: Column) -> Column:
    """Module of a source file; ``lib.rs`` is the crate, ``mod.rs`` its folder."""
    inner = F.when(file.contains("/"), F.regexp_replace(file, "^[^/]*/", "")).otherwise(file)
    path = F.replace(F.replace(inner, F.lit(".rs"), F.lit("")), F.lit("/"), F.lit("::"))
    return F.when(path.endswith("::lib"), crate).otherwise(F.regexp_replace(path, "::mod$", ""))


def _signature(lines: Column) -> Column:
    """Join a declaration with its next lines up to the one that ends it."""
    ended = r"[;{}]\s*$"
    text = F.aggregate(
        lines,
        F.struct(F.lit("").alias("text"), F.lit(False).alias("done")),
        lambda s, line: F.struct(
            F.when(s["done"], s["text"]).otherwise(F.concat(s["text"], F.lit(" "), F.trim(line))).alias("text"),
            (s["done"] | line.rlike(ended)).alias("done"),
        ),
        lambda s: F.trim(F.regexp_replace(s["text"], r"\s+", " ")),
    )
    cut = F.concat(F.substring(text, 1, C.SIGNATURE_CHARS - 3), F.lit("..."))
    return F.when(F.length(text) > C.SIGNATURE_CHARS, cut).otherwise(text)


def declarations(files: DataFrame) -> DataFrame:
    """Public declarations that are documented, and all public functions."""
    any_declaration = "|".join(f"(?:{pattern})" for _, pattern in C.DECLARATIONS)
    lines = F.split("text", "\n")
    numbered = F.transform(lines, lambda line, i: F.struct(i.alias("at"), line.alias("line")))
    no_docs = F.array().cast("array<string>")

    def step(state: Column, x: Column) -> Column:
        line = x["line"]
        is_doc, blank = line.rlike(C.DOC_LINE), F.trim(line) == ""
        entry = F.struct(x["at"].alias("at"), state["docs"].alias("docs"))
        added = F.concat(state["docs"], F.array(F.regexp_extract(line, C.DOC_LINE, 1)))
        found = ~is_doc & line.rlike(any_declaration)
        return F.struct(
            F.when(is_doc, added).when(blank, state["docs"]).otherwise(no_docs).alias("docs"),
            F.when(found, F.concat(state["out"], F.array(entry))).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(
        no_docs.alias("docs"), F.array().cast("array<struct<at:int,docs:array<string>>>").alias("out")
    )
    hits = F.aggregate(numbered, start, step, lambda s: s["out"])
    framed = F.transform(
        hits,
        lambda h: F.struct(
            h["docs"].alias("docs"),
            F.slice(lines, h["at"] + 1, F.lit(C.SIGNATURE_LINES + 1)).alias("lines"),
        ),
    )
    rows = spread(files).select(
        "crate", module_path(F.col("crate"), F.col("file")).alias("module"), F.inline(framed)
    )
    line = F.get("lines", F.lit(0))
    kinds = F.array_compact(
        F.array(
            *[
                F.when(
                    line.rlike(pattern),
                    F.struct(F.lit(kind).alias("kind"), F.regexp_extract(line, pattern, 1).alias("name")),
                )
                for kind, pattern in C.DECLARATIONS
            ]
        )
    )
    single = rows.select("*", F.explode(kinds).alias("k"))
    return single.where((F.size("docs") > 0) | (F.col("k.kind") == "fn")).select(
        "crate",
        F.concat_ws("::", "module", "k.name").alias("item_path"),
        F.col("k.name").alias("header"),
        F.col("k.kind").alias("item_type"),
        _signature(F.col("lines")).alias("signature"),
        F.array_join("docs", "\n").alias("content"),
        F.lit("public").alias("visibility"),
    )


def module_docs(files: DataFrame) -> DataFrame:
    """One module item per file that starts with inner documentation."""
    head = F.slice(F.split("text", "\n", C.INNER_DOC_SCAN_LINES + 1), 1, C.INNER_DOC_SCAN_LINES)
    docs = F.transform(
        F.filter(head, lambda line: line.rlike(C.INNER_DOC_LINE)),
        lambda line: F.regexp_extract(line, C.INNER_DOC_LINE, 1),
    )
    rows = files.select("crate", module_path(F.col("crate"), F.col("file")).alias("item_path"), docs.alias("docs"))
    name = F.split_part("item_path", F.lit("::"), F.lit(-1))
    return rows.where(F.size("docs") > 0).select(
        "crate",
        "item_path",
        name.alias("header"),
        F.lit("module").alias("item_type"),
        F.concat(F.lit("mod "), name).alias("signature"),
        F.array_join("docs", "\n").alias("content"),
        F.lit("public").alias("visibility"),
    )


# --- macros ----------------------------------------------------------------------

#: what matters while a file is read from its start: a doc line, a comment or literal to
#: pass over, an attribute, a definition, or anything else, which parts docs from what follows
_PIECE = re.compile(
    r'''(?m:^)[ \t]*///(?P<doc>[^\n]*)
    |(?P<comment>//[^\n]*|/\*.*?\*/)
    |(?P<attribute>\#!?\[)
    |(?P<rules>macro_rules!\s+(?P<rules_name>\w+))
    |(?P<scoped>pub\s+macro\s+(?P<scoped_name>\w+)\s*(?=[({]))
    |(?P<function>pub\s+fn\s+(?P<function_name>\w+))
    |\br(?P<hashes>\#*)".*?"(?P=hashes)
    |"(?:[^"\\]|\\.)*"
    |'(?:[^'\\\n]|\\[^\n][^'\n]*)'
    |\w+
    |[^\w\s]''',
    re.DOTALL | re.VERBOSE,
)
#: an attribute that makes a function a macro: its kind and, for derives, the derived name
_PROC = re.compile(r"#\[(proc_macro\w*)(?:\(\s*(\w+))?")
_TOKEN = re.compile(
    r'''\br(#*)".*?"\1|"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/|'(?:[^'\\\n]|\\[^\n][^'\n]*)'|[(\[{]|[)\]}]''', re.DOTALL
)


def _body(text: str, at: int) -> tuple[int, list[str]]:
    """End of the brackets that open at or after ``at``, and the groups right inside them.

    Brackets in strings, characters and comments do not count, and groups come
    without strings and comments.  Brackets that never close end at ``at``.
    """
    depth, groups, parts, last = 0, [], [], at
    for token in _TOKEN.finditer(text, at):
        mark = token.group(0)
        if depth >= 2:
            parts.append(text[last : token.start()])
        last = token.end()
        if mark in "([{":
            parts = [*parts, mark] if depth >= 2 else []
            depth += 1
        elif mark in ")]}":
            depth -= 1
            if depth >= 2:
                parts.append(mark)
            elif depth == 1:
                groups.append("".join(parts))
            elif depth <= 0:
                return token.end(), groups
        elif depth >= 2:
            parts.append(" ")
    return at, []


def _shorten(text: str, longest: int) -> str:
    text = re.sub(r"\s+", " ", text)
    return text if len(text) <= longest else text[: longest - 3] + "..."


def find_macros(text: str) -> list[dict]:
    """Macros of one file: name, kind, signature, docs, visibility, definition and arms.

    One pass over the pieces of the file: doc lines and attributes are held until
    the definition they belong to, and dropped at any other code.  Definitions are
    passed over whole, so macros that a macro writes are not listed.

    The signature is for display: the definition on one line, shortened.  The
    definition is the whole source of the macro, and ``arms`` has the whole matcher
    of each arm.
    """
    found: list[dict] = []
    docs: list[str] = []
    attributes: list[str] = []
    at = 0
    while piece := _PIECE.search(text, at):
        at = piece.end()
        if piece["doc"] is not None:
            said = piece["doc"]
            docs.append(said[1:] if said[:1].isspace() else said)
            continue
        if piece["comment"] is not None and not piece["comment"].startswith("//"):
            continue
        if piece["attribute"]:
            at = max(at, _body(text, piece.end() - 1)[0])
            attributes.append(text[piece.start() : at])
            continue
        item: dict = {}
        if piece["rules"]:
            at, groups = _body(text, at)
            public = any(a.startswith("#[macro_export") for a in attributes)
            item = {"name": piece["rules_name"], "visibility": "public" if public else "crate", "arms": groups[::2]}
        elif piece["scoped"]:
            opened = at
            at, groups = _body(text, opened)
            arms = groups[::2]
            if text[opened] == "(":  # one arm beside the name, not several in the braces
                arms = [_TOKEN.sub(lambda t: t.group(0) if t.group(0) in "([{)]}" else " ", text[opened + 1 : at - 1])]
                at, _ = _body(text, at)
            item = {"name": piece["scoped_name"], "visibility": "public", "arms": arms}
        elif piece["function"]:
            for attribute in attributes:
                if marked := _PROC.match(attribute):
                    kind = "derive macro" if marked[2] else marked[1].replace("_", " ")
                    shown = f"{attribute} {piece['function']}"
                    item = {"name": marked[2] or piece["function_name"], "kind": kind, "visibility": "public", "arms": [], "definition": shown, "root": True}
        if item:
            item.setdefault("kind", "macro")
            item.setdefault("definition", text[piece.start() : at])
            longest = C.MACRO_SIGNATURE_CHARS if piece["rules"] else C.SIGNATURE_CHARS
            found.append(item | {"signature": _shorten(item["definition"], longest), "docs": "\n".join(docs)})
        docs, attributes = [], []
    return found


def macro_parameters(matcher: str) -> list[tuple[str, str]]:
    """Names and readable kinds of the fragments in a macro pattern."""
    return [(n, C.MACRO_FRAGMENTS.get(k, k)) for n, k in re.findall(r"\$(\w+):(\w+)", matcher)]


def macro_arms(macros: DataFrame) -> DataFrame:
    """One row per fragment of every arm of a macro, from the arm's whole matcher."""
    kinds = F.create_map(*[F.lit(x) for pair in C.MACRO_FRAGMENTS.items() for x in pair])
    single = macros.select("item_path", F.explode("arms").alias("arm"))
    names = F.regexp_extract_all("arm", F.lit(FRAGMENT), F.lit(1))
    specs = F.regexp_extract_all("arm", F.lit(FRAGMENT), F.lit(2))
    pairs = F.arrays_zip(names.alias("name"), specs.alias("spec"))
    rows = single.select("item_path", F.inline(pairs).alias("name", "spec"))
    return rows.select(
        "item_path", "name", F.coalesce(F.try_element_at(kinds, F.col("spec")), F.col("spec")).alias("type")
    )


def macros(files: DataFrame) -> DataFrame:
    """Macro items of all files that contain a macro definition, with their whole source and arms."""
    has_macro = F.col("text").rlike(r"macro_rules!|#\[proc_macro|pub\s+macro\s")
    rows = files.where(has_macro).select(
        "crate", module_path(F.col("crate"), F.col("file")).alias("module"), "text"
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in MACRO_ROW.split(", ")]
        kinds = [pa.list_(pa.string()) if c.endswith(">") else pa.string() for c in MACRO_ROW.split(", ")]
        for piece in pieces(batches, "text"):
            found = [
                (
                    crate,
                    f"{crate if m.get('root') else module}::{m['name']}",
                    m["name"],
                    m["kind"],
                    m["signature"],
                    m["docs"],
                    m["visibility"],
                    m["definition"],
                    m["arms"],
                )
                for crate, module, text in zip(*(piece.column(c).to_pylist() for c in ("crate", "module", "text")))
                for m in find_macros(text)
            ]
            if found:
                yield pa.record_batch([pa.array(values, kind) for values, kind in zip(zip(*found), kinds)], names=names)

    return rows.mapInArrow(extract, MACRO_ROW)


def source_items(files: DataFrame) -> DataFrame:
    """Everything found in source files, in the shape of the item table."""
    return module_docs(files).unionByName(macros(files).drop("definition", "arms")).unionByName(declarations(files))

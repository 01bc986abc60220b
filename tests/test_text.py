import re

import pytest
from pyspark.sql import functions as F

from docquarry import params
from docquarry.functions import code, intelligence, paths, signatures, text


def one(spark, column, *values):
    rows = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in rows.select(column(F.col("x"))).collect()]


def snippet(content, target=300, low=200, high=400):
    """Sentence by sentence, then word by word."""
    if not content or len(content) <= high:
        return content
    parts, so_far = re.split(r"[.!?]\s+", content), ""
    for i, part in enumerate(parts):
        longer = so_far + part + (". " if i < len(parts) - 1 else "")
        if low <= len(longer) <= high:
            return longer.strip()
        if len(longer) > high:
            break
        so_far = longer
    so_far = ""
    for word in content.split():
        longer = f"{so_far} {word}".strip()
        if len(longer) >= target:
            if len(longer) + 3 <= high:
                return longer + "..."
            return (so_far or content[:high]) + "..."
        so_far = longer
    return so_far if len(so_far) >= low else content[:high] + "..."


CASES = [
    "",
    "short",
    "One sentence. " * 60,
    "word " * 200,
    "x" * 900,
    "a" * 150 + ". " + "b" * 300 + " c" * 100,
    "\n\n lead " + "y" * 390 + " tail" * 30,
    "A! B? " * 100,
    "w" * 100 + " " * 500 + "z",
]


def test_snippets_follow_the_steps(spark):
    assert one(spark, text.snippet, *CASES) == [snippet(c) for c in CASES]


QUERIES = {
    "async  Serialise": "async asynchronous Serialize",
    "COLOUR of fn": "COLOR of fn function",
    "vec vec": "vec vector",
    "ﬁle": "file",
    "normal": "normal",
}


def test_queries_are_prepared_alike_on_both_sides(spark):
    assert [params.search_text(q) for q in QUERIES] == list(QUERIES.values())
    assert one(spark, text.prepare_query, *QUERIES) == list(QUERIES.values())
    for bad in ("", "   ", "x" * 501, None):
        with pytest.raises(ValueError):
            params.search_text(bad)


def test_lookup_form_composes(spark):
    assert one(spark, text.lookup_form, "éa::B_c-d") == ["éa  b_c d"]


def test_code_blocks(spark):
    doc = "```rust\nlet a;\n```\ntext\n```\nx\n```\n```toml\n  \n```"
    (found,) = one(spark, code.code_examples, doc)
    assert [(e["code"], e["language"], e["detected"]) for e in found] == [("let a;", "rust", False), ("x", "rust", True)]
    assert one(spark, code.normalize_code, "// c\n a   b \n\n* d\nz") == ["a b\nz"]


def test_signature_parts(spark):
    sig = "fn f(a: HashMap<K, V>, b: (u8, u8), c: [u8; 3]) -> Result<A, B> where T: X {"
    assert one(spark, signatures.return_type, sig) == ["Result<A, B>"]
    assert one(spark, signatures.split_top_level, "a: HashMap<K, V>, b: [u8; 3]") == [["a: HashMap<K, V>", "b: [u8; 3]"]]
    assert one(spark, intelligence.error_types, sig, "fn g() -> u8") == [["B"], []]
    assert one(spark, intelligence.where_bounds, "fn f<T>() where T: A<X, Y>, U: B {") == [["T: A<X, Y>", "U: B"]]
    assert one(spark, intelligence.lifetimes, "fn f<'a, 'b>(x: &'a str)") == [["'a", "'b"]]


def test_paths(spark):
    fix = lambda x: paths.valid_path(x, F.lit("9"), F.lit("function"))
    got = one(spark, fix, "a::b", "crate", " ", "my-crate::x y", "1::2", "!!!")
    assert [tuple(r) for r in got] == [
        ("a::b", False),
        ("crate", False),
        ("function::9", True),
        ("my_crate::x_y", True),
        ("sanitized::9", True),
        ("sanitized::9", True),
    ]
    (long,) = one(spark, fix, "a" * 300)
    assert long["path"] == "a" * 256


def test_parameters():
    assert params.to_int(" 5 ", "k", 1, 20) == 5
    assert params.to_bool("yes", "b") is True and params.to_bool("0", "b") is False
    assert params.version("1.2.3-rc.1") == "1.2.3-rc.1" and params.version("") is None
    for call in (
        lambda: params.to_int("x", "k", 1, 20),
        lambda: params.to_int(21, "k", 1, 20),
        lambda: params.crate_name("Bad Name"),
        lambda: params.version("1.2"),
        lambda: params.item_path("a::::b"),
        lambda: params.module_path("a::"),
        lambda: params.SearchFilters(item_type="class"),
        lambda: params.SearchFilters(visibility="private", crate="a", home_crate="b"),
        lambda: params.SearchFilters(has_examples=True, min_doc_length=6000),
    ):
        with pytest.raises(ValueError):
            call()

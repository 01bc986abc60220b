"""Macros are read to their end, however long."""

from docquarry.sources import rust_source


def test_every_arm(spark):
    arms = "\n".join(f"    (k{i}, $a{i}:expr, $($b{i}: ident),*) => {{ let x: u8 = '{{'; f(\"}}\", $a{i}) }}; // ($no:expr) {{" for i in range(40))
    text = f"macro_rules! many {{\n{arms}\n}}\nmacro_rules! round (\n    ($r:ty) => ($r);\n);\n"
    text += "pub macro one($($o:tt),*) {\n" + "    f();\n" * 30 + "    $q:x\n}\npub macro two {\n    ($t:pat) => { 1 },\n    ($u:path) => { 2 }\n}\n"
    files = spark.createDataFrame([("kit", "src/lib.rs", text)], "crate string, file string, text string")
    found = rust_source.macros(files).cache()
    got = {r.header: r for r in found.collect()}
    assert set(got) == {"many", "round", "one", "two"}
    assert got["many"].definition == text[: text.index("\nmacro_rules! round")]
    assert got["one"].definition.endswith("$q:x\n}") and len(got["many"].arms) == 40 and len(got["two"].arms) == 2
    want = {(x + str(i), t) for i in range(40) for x, t in (("a", "expression"), ("b", "identifier"))}
    rows = [(r["name"], r["type"]) for r in rust_source.macro_arms(found).collect()]
    assert len(rows) == len(set(rows)) == 84
    assert want <= set(rows) and {n for n, _ in rows} - {n for n, _ in want} == {"r", "o", "t", "u"}
    assert "definition" not in rust_source.source_items(files).columns

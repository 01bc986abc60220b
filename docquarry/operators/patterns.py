"""Usage patterns, error types and module statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docquarry.functions.text import context_window
from docquarry.operators.topn import first_per_group

METHOD_CALL = r"\b(\w+)\.(\w+)\s*\("
GENERIC = r"<([^>]+)>"
RESULT = r"Result<([^,>]+)(?:,\s*([^>]+))?>"


def _groups(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _none() -> Column:
    return F.array().cast("array<string>")


def usage_counts(items: DataFrame, crate: str, limit: int = 10, row_limit: int | None = None) -> DataFrame:
    """Frequent patterns of four kinds, each with its own share of the result.

    Half of ``limit`` goes to methods, a quarter each to simple generics, error
    handling and trait implementations.  All rows count; ``row_limit`` restricts
    the count to the items with the longest examples.
    """
    rows = items.where(
        F.col("examples").isNotNull() | F.col("signature").isNotNull() | F.col("content").contains("```")
    )
    if row_limit is not None:
        rows = rows.orderBy(F.length("examples").desc_nulls_last(), "item_path").limit(row_limit)
    signature, examples = F.coalesce("signature", F.lit("")), F.coalesce("examples", F.lit(""))

    def tagged(values: Column, kind: str) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("pattern")))

    def has(text: str, label: str) -> Column:
        return F.when(signature.contains(text), F.array(F.lit(label))).otherwise(_none())

    functions = F.transform(_groups(signature, r"fn\s+(\w+)", 1), lambda m: F.concat(F.lit("fn "), m))
    calls = F.slice(_groups(examples, r"\.(\w+)\(", 1), 1, 5)
    calls = F.transform(calls, lambda m: F.concat(F.lit("."), m, F.lit("()")))
    simple = F.filter(_groups(signature, GENERIC, 1), lambda g: ~g.contains(","))
    generics = F.transform(simple, lambda g: F.concat(F.lit("<"), g, F.lit(">")))
    traits = F.transform(
        _groups(examples, r"impl\s+(\w+)\s+for\s+(\w+)", 1),
        lambda t: F.concat(F.lit("impl "), t, F.lit(" for Type")),
    )
    found = F.concat(
        tagged(functions, "method"),
        tagged(calls, "method"),
        tagged(generics, "generic"),
        tagged(has("Result<", "Result<T, E>"), "error_handling"),
        tagged(has("Option<", "Option<T>"), "error_handling"),
        tagged(traits, "trait_impl"),
    )
    counts = rows.select(F.inline(found)).groupBy("type", "pattern").agg(F.count("*").alias("frequency"))
    order = [F.desc("frequency"), F.asc("pattern")]
    shares = first_per_group(counts, ["type"], order, max(limit // 2, 1), "_turn")
    share = F.when(F.col("type") == "method", limit // 2).otherwise(limit // 4)
    best = shares.where(F.col("_turn") <= share).orderBy(*order, "type").limit(limit)
    return best.select("pattern", "type", "frequency", F.lit(crate).alias("crate"))


def pattern_category(pattern: Column) -> Column:
    dot, bracket = F.locate(".", pattern), F.locate("(", pattern)
    return (
        F.when((dot > 0) & (bracket > 0) & (dot < bracket), "method_call")
        .when(pattern.contains("Result<"), "error_handling")
        .when(pattern.contains("Option<"), "optional_value")
        .when(pattern.contains("<"), "generic_type")
        .when(pattern.contains("impl"), "trait_implementation")
        .otherwise("other")
    )


def pattern_uses(items: DataFrame) -> DataFrame:
    """Every pattern use as ``pattern``, ``item_path``, ``seq``, ``context``."""
    signature, examples = F.coalesce("signature", F.lit("")), F.coalesce("examples", F.lit(""))

    def calls(text: Column) -> Column:
        return F.zip_with(
            _groups(text, METHOD_CALL, 1),
            _groups(text, METHOD_CALL, 2),
            lambda a, b: F.concat(a, F.lit("."), b, F.lit("()")),
        )

    def hits(values: Column, context) -> Column:
        return F.transform(
            values, lambda v: F.struct(v.alias("pattern"), context(v).alias("context"))
        )

    generics = F.transform(_groups(signature, GENERIC, 1), lambda g: F.concat(F.lit("Generic<"), g, F.lit(">")))
    results = F.zip_with(
        _groups(signature, RESULT, 1),
        _groups(signature, RESULT, 2),
        lambda ok, err: F.concat(
            F.lit("Result<"), ok, F.lit(", "), F.when(err == "", "Error").otherwise(err), F.lit(">")
        ),
    )
    head = F.substring("signature", 1, 100)
    found = F.concat(
        hits(calls(signature), lambda v: head),
        hits(generics, lambda v: head),
        hits(results, lambda v: head),
        hits(calls(examples), lambda v: _around(F.col("examples"), v)),
    )
    return items.where(F.col("examples").isNotNull() | F.col("signature").isNotNull()).select(
        "item_path", F.posexplode(found).alias("seq", "use")
    ).select("item_path", "seq", "use.*")


def _around(text: Column, call: Column, reach: int = 50) -> Column:
    """The text around the first use of a call, found by its name up to the bracket."""
    name = F.regexp_replace(call, r"\(\)$", "")
    at = F.position(name, text)
    start = F.greatest(at - reach, F.lit(1))
    return F.substring(text, start, at + F.length(name) + 1 + reach - start)


def usage_patterns(items: DataFrame, limit: int = 10, min_frequency: int = 2, samples: int = 3) -> DataFrame:
    """The most frequent patterns with confidence, kind and a few places of use.

    Counting reduces before the shuffle.  Samples are looked up for the at most
    ``limit`` winners only, so no list of all uses of a pattern is ever built.
    """
    uses = pattern_uses(items)
    counts = uses.groupBy("pattern").agg(F.count("*").alias("frequency"))
    best = counts.where(F.col("frequency") >= min_frequency).orderBy(F.desc("frequency"), "pattern").limit(limit)
    shown = first_per_group(
        uses.join(best.select("pattern"), "pattern"),
        ["pattern"],
        [F.asc("item_path"), F.asc("seq")],
        samples,
        "_turn",
    )
    entry = F.struct("_turn", "item_path", "context")
    examples = shown.groupBy("pattern").agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    return (
        best.join(examples, "pattern")
        .select(
            "pattern",
            "frequency",
            F.least(F.lit(1.0), F.col("frequency") / 10.0).alias("confidence"),
            pattern_category(F.col("pattern")).alias("pattern_type"),
            F.transform(
                "_e", lambda e: F.struct(e["item_path"].alias("item"), e["context"].alias("context"))
            ).alias("examples"),
        )
        .orderBy(F.desc("frequency"), "pattern")
    )


def confidence_score(frequency: Column, total: Column) -> Column:
    """Mean of the plain and the logarithmic share, at most 1."""
    share = frequency / total
    scaled = F.ln(frequency + 1) / F.ln(total + 1)
    return F.when(total == 0, 0.0).otherwise(F.least(F.lit(1.0), (share + scaled) / 2))


def common_examples(items: DataFrame, pattern: str, limit: int = 5) -> DataFrame:
    """Examples that mention a pattern, with the text around it."""
    snippet = context_window(F.col("examples"), pattern)
    return (
        items.select("item_path", "item_type", "signature", snippet.alias("snippet"))
        .where(F.col("snippet").isNotNull())
        .orderBy("item_path")
        .withColumn("pattern_match", F.lit(pattern))
        .limit(limit)
    )


def module_analysis(items: DataFrame, module: str, top: int = 5) -> DataFrame:
    """Counts below a path prefix, one row per ``facet`` and ``value``.

    All facets come from one pass: every item is expanded to its facet values
    and counted once.
    """
    inside = items.where(F.lower("item_path").startswith(module.lower()))
    signature = F.coalesce("signature", F.lit(""))

    def tagged(values: Column, facet: str) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value")))

    returns = F.when(
        signature.contains(" -> "), F.array(F.trim(F.split_part(signature, F.lit(" -> "), F.lit(-1))))
    ).otherwise(_none())
    deprecated = F.when(F.coalesce("deprecated", F.lit(False)), F.array(F.lit("true"))).otherwise(_none())
    found = F.concat(
        tagged(F.array(F.lit("all")), "total"),
        tagged(F.array(F.coalesce("item_type", F.lit("unknown"))), "type"),
        tagged(F.array(F.coalesce("visibility", F.lit("public"))), "visibility"),
        tagged(deprecated, "deprecated"),
        tagged(F.filter(_groups(signature, GENERIC, 1), lambda g: ~g.contains(",")), "generic"),
        tagged(returns, "return"),
    )
    counts = inside.select(F.inline(found)).groupBy("facet", "value").agg(F.count("*").alias("n"))
    limited = F.col("facet").isin("generic", "return")
    best = first_per_group(counts.where(limited), ["facet"], [F.desc("n"), F.asc("value")], top)
    return counts.where(~limited).unionByName(best)


def error_catalog(items: DataFrame, pattern: str | None = None, samples: int = 3) -> DataFrame:
    """Every error type with its count and the first items that return it."""
    uses = items.select("item_path", "signature", F.explode("error_types").alias("error_type"))
    if pattern is not None:
        uses = uses.where(F.lower("error_type").contains(pattern.lower()))
    counts = uses.groupBy("error_type").agg(F.count("*").alias("occurrence_count"))
    first = first_per_group(uses, ["error_type"], [F.asc("item_path")], samples)
    entry = F.struct("item_path", "signature")
    examples = first.groupBy("error_type").agg(F.sort_array(F.collect_list(entry)).alias("example_items"))
    return counts.join(examples, "error_type").orderBy(F.desc("occurrence_count"), "error_type")


def api_evolution(releases: DataFrame, items: DataFrame) -> DataFrame:
    """Item counts and stability per release; releases without items are kept.

    Items are counted before the join, so a release that holds many of them
    meets the release list as one row.
    """
    counts = items.groupBy("crate", "version").agg(
        F.count_distinct("item_path").alias("item_count"),
        F.count_distinct(F.when(F.col("deprecated"), F.col("item_path"))).alias("deprecated_count"),
        F.count_distinct("item_type").alias("type_diversity"),
    )
    stats = releases.select("crate", "version").distinct().join(counts, ["crate", "version"], "left").na.fill(
        0, ["item_count", "deprecated_count", "type_diversity"]
    )
    return stats.withColumn(
        "stability_score",
        1.0 - F.col("deprecated_count") / F.greatest(F.col("item_count"), F.lit(1)),
    )


def evolution_steps(stats: DataFrame, order: Column) -> DataFrame:
    """Changes from each release of a crate to the next one in ``order``."""
    w = W.partitionBy("crate").orderBy(order)
    previous = {c: F.lag(c).over(w) for c in ("version", "item_count", "deprecated_count")}
    return (
        stats.select("*", *[column.alias(f"_{name}") for name, column in previous.items()])
        .where(F.col("_version").isNotNull())
        .select(
            "crate",
            F.col("_version").alias("from_version"),
            F.col("version").alias("to_version"),
            (F.col("item_count") - F.col("_item_count")).alias("item_change"),
            (F.col("deprecated_count") - F.col("_deprecated_count")).alias("deprecated_change"),
            (F.col("item_count") / F.greatest(F.col("_item_count"), F.lit(1)) - 1).alias("growth_rate"),
        )
    )

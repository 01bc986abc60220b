"""Reading rustdoc JSON into entity tables.

One file is one row.  ``index`` and ``paths`` are exploded to one row per item,
so everything after the first step is spread over the cluster whatever the size
of a single crate.  Kind-specific bodies stay JSON text until the step that
needs them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry import constants as C
from docquarry.functions import code, intelligence, paths, signatures
from docquarry.operators.typenav import methods_with_defaults
from docquarry.plans.spread import spread
from docquarry.session import settings, staged

ITEM = (
    "struct<name:string,docs:string,visibility:string,attrs:array<string>,deprecation:string,"
    "crate_id:bigint,links:map<string,string>,inner:map<string,string>>"
)
PATH = "struct<crate_id:bigint,path:array<string>,kind:string,name:string>"
#: staged tables hold texts, which it makes much smaller than the default at no more time
CODEC = "zstd"


@dataclass
class Parsed:
    """``index`` and ``paths`` entries of a set of files, one row each.

    ``row_id`` numbers the rows of ``index`` in the order they are stored in.
    """

    index: DataFrame
    paths: DataFrame

    @cached_property
    def entries(self) -> DataFrame:
        """``parse_items`` without texts, staged: most tables start from it."""
        return staged(parse_items(self).drop("docs", "links"), compression=CODEC)

    @cached_property
    def blocks(self) -> DataFrame:
        """``impls`` with the full path of their trait, staged: types are rendered once."""
        return staged(resolve_traits(impls(self), self.known, "trait_ref", "trait_path"), compression=CODEC)

    @cached_property
    def known(self) -> DataFrame:
        """``full_paths``, staged: blocks, places and links look them up."""
        return staged(full_paths(self), compression=CODEC)


def parse(files: DataFrame) -> Parsed:
    """Parse every file (``crate``, ``version``, ``text``) once.

    All entity tables are built from the staged entries, so the JSON text is
    neither read nor parsed again.  A file that is not JSON yields no rows.
    """
    parsed = F.from_json("text", f"struct<index:map<string,{ITEM}>,paths:map<string,{PATH}>>")
    rows = spread(files).select("crate", "version", parsed.alias("j"))

    def entries(part: str, item: Callable, place: Callable) -> Column:
        source = F.map_entries(F.col(f"j.{part}"))
        return F.transform(
            F.coalesce(source, F.array().cast(f"array<struct<key:string,value:{ITEM if part == 'index' else PATH}>>")),
            lambda e: F.struct(
                F.lit(part).alias("part"), e["key"].alias("item_id"), item(e).alias("item"), place(e).alias("place")
            ),
        )

    both = F.concat(
        entries("index", lambda e: e["value"], lambda e: F.lit(None).cast(PATH)),
        entries("paths", lambda e: F.lit(None).cast(ITEM), lambda e: e["value"]),
    )
    listed = rows.select("crate", "version", F.inline(both)).withColumn("row_id", F.monotonically_increasing_id())
    # both parts are written side by side, so the texts are not sorted by part first
    with settings(files.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": "2"}):
        stored = staged(listed, "part", compression=CODEC)
    index = stored.where(F.col("part") == "index").select("crate", "version", "item_id", "row_id", "item.*")
    places = stored.where(F.col("part") == "paths").select(
        "crate",
        "version",
        "item_id",
        F.col("place.crate_id").alias("path_crate_id"),
        F.col("place.path").alias("path"),
        F.col("place.kind").alias("path_kind"),
        F.col("place.name").alias("path_name"),
    )
    return Parsed(index, places)


KEY = ["crate", "version", "item_id"]


def _json(column: str | Column, path: str) -> Column:
    return F.get_json_object(column, path)


def _json_array(column: str | Column, path: str) -> Column:
    return F.from_json(_json(column, path), "array<string>")


def parse_items(files: Parsed) -> DataFrame:
    """Items with their kind, path and raw body, before any enrichment.

    Entries with neither a name nor documentation are left out.
    """
    named = files.index.where(
        (F.coalesce("name", F.lit("")) != "") | (F.coalesce("docs", F.lit("")) != "")
    )
    rows = named.join(files.paths, KEY, "left")
    inner_kind = F.get(F.map_keys("inner"), F.lit(0))
    rows = rows.withColumn("inner_kind", inner_kind).withColumn(
        "body", F.try_element_at("inner", F.col("inner_kind"))
    )
    known = F.coalesce("inner_kind", "path_kind", F.lit("unknown"))
    has_place = (F.coalesce(F.size("path"), F.lit(0)) > 0) | (F.coalesce("name", F.lit("")) != "")
    full_path = F.when(has_place, paths.join_path(F.col("path"), F.col("name"))).otherwise(
        F.concat(F.lit("item_"), "item_id")
    )
    return rows.withColumns(
        {"item_type": paths.normalize_kind(known), "item_path": full_path}
    ).drop("inner")


def function_parts(body: Column) -> dict[str, Column]:
    """Declaration fields of a function body, in either of its two layouts."""
    return {
        "inputs": F.coalesce(_json_array(body, "$.decl.inputs"), _json_array(body, "$.sig.inputs")),
        "output": F.coalesce(_json(body, "$.decl.output"), _json(body, "$.sig.output")),
        "generics": _json_array(body, "$.generics.params"),
    }


def with_signature(items: DataFrame, name: bool = True) -> DataFrame:
    """Add ``signature`` for functions, aliases and associated constants."""
    body = F.col("body")
    parts = function_parts(body)
    is_function = F.col("inner_kind").isin("function", "method")
    inputs = F.when(is_function, F.coalesce(parts["inputs"], F.array().cast("array<string>")))
    output = F.when(is_function, parts["output"])
    plain_type = F.when(
        F.col("inner_kind").isin("type_alias", "typedef", "assoc_const", "assoc_type", "constant", "static"),
        F.coalesce(_json(body, "$.type"), _json(body, "$.default")),
    )
    rows = items.withColumns(
        {
            "_names": F.transform(inputs, signatures.input_name),
            "_types": signatures.type_names(F.transform(inputs, signatures.input_type)),
            "_output": signatures.type_name(output),
            "_plain": signatures.type_name(plain_type),
        }
    )
    params = F.zip_with(
        "_names", "_types", lambda n, t: F.concat(n, F.lit(": "), F.coalesce(t, F.lit("Unknown")))
    )
    returns = F.when(
        F.coalesce("_output", F.lit("")).isin("", "unit", "null"), ""
    ).otherwise(F.concat(F.lit(" -> "), "_output"))
    generics = signatures.generic_names(parts["generics"])
    prefix = F.concat(F.lit("fn "), "name") if name else F.lit("")
    call = F.concat(
        prefix, F.coalesce(generics, F.lit("")), F.lit("("), F.array_join(params, ", "), F.lit(")"), returns
    )
    return rows.withColumn("signature", F.when(is_function, call).otherwise(F.col("_plain"))).drop(
        "_names", "_types", "_output", "_plain"
    )


def item_heads(items: DataFrame) -> DataFrame:
    """The columns of the item table that need no text, and ``docs`` if ``items`` has them."""
    rows = with_signature(items)
    bounds = F.coalesce(
        F.when(F.col("item_type") == "trait", _json("body", "$.bounds")),
        _json("body", "$.generics.where_predicates"),
    )

    def filled(value: Column) -> Column:
        return F.when(~F.coalesce(value, F.lit("[]")).isin("[]", "null", ""), value)

    return rows.select(
        *KEY,
        "row_id",
        "item_path",
        "item_type",
        F.coalesce(
            F.when(F.col("name") != "", F.col("name")), F.element_at("path", -1), F.col("item_type")
        ).alias("header"),
        F.coalesce("visibility", F.lit("public")).alias("visibility"),
        F.col("deprecation").isNotNull().alias("deprecated"),
        intelligence.stability(F.col("attrs"), F.col("deprecation")).alias("stability_level"),
        "signature",
        filled(_json("body", "$.generics.params")).alias("generic_params"),
        filled(bounds).alias("trait_bounds"),
        intelligence.error_types(F.col("signature")).alias("error_types"),
        intelligence.feature_requirements(F.col("attrs")).alias("feature_requirements"),
        "attrs",
        *(["docs"] if "docs" in rows.columns else []),
    )


def with_texts(heads: DataFrame) -> DataFrame:
    """The item table from ``item_heads`` and ``docs``: what is read from texts."""
    docs = F.coalesce("docs", F.lit(""))
    safety = intelligence.safety_info(F.col("attrs"), F.col("signature"), docs)
    return heads.withColumns(
        {
            "content": docs,
            "doc_length": F.length(docs),
            "parent_id": paths.parent_of(F.col("item_path")),
            "examples": code.examples_json(docs),
            "safety_info": safety,
            "is_safe": safety["is_safe"],
        }
    ).drop("docs", "attrs", "row_id")


def items_table(files: Parsed) -> DataFrame:
    """The item table: text, signature, examples and code facts of every item."""
    return with_texts(item_heads(parse_items(files)))


def modules_table(files: Parsed) -> DataFrame:
    """Modules with parents by path and a real count of the items they hold."""
    rows = files.paths.where(F.lower("path_kind").isin("module", "mod") & (F.size("path") > 0))
    modules = rows.select(
        "crate",
        "version",
        "item_id",
        F.element_at("path", -1).alias("name"),
        F.array_join("path", "::").alias("path"),
        (F.size("path") - 1).alias("depth"),
    )
    parents = modules.select("crate", "version", F.col("path").alias("_up"), F.col("item_id").alias("parent_id"))
    placed = modules.withColumn("_up", paths.parent_of(F.col("path"))).join(
        parents, ["crate", "version", "_up"], "left"
    )
    # two narrow columns: not worth staging for them alone
    items = (files.entries if "entries" in vars(files) else parse_items(files)).where(F.col("item_type") != "module")
    counts = items.groupBy("crate", "version", paths.parent_of(F.col("item_path")).alias("path")).agg(
        F.count("*").alias("item_count")
    )
    return (
        placed.join(counts, ["crate", "version", "path"], "left")
        .withColumn("item_count", F.coalesce("item_count", F.lit(0)))
        .drop("_up")
    )


# --- implementations and traits --------------------------------------------------


def standard_trait(name: Column) -> Column:
    """Full path of a well-known trait; any other name stays."""
    table = F.create_map(*[F.lit(x) for pair in C.STD_TRAITS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), name)


def _trait_id(ref: Column) -> Column:
    return F.coalesce(_json(ref, "$.id"), _json(ref, "$.resolved_path.id"), _json(ref, "$.path.id"))


def _trait_name(ref: Column) -> Column:
    text = _json(ref, "$.path")
    return F.coalesce(
        _json(ref, "$.resolved_path.name"),
        _json(ref, "$.path.name"),
        F.when(~F.coalesce(text, F.lit("{")).startswith("{"), text),
        standard_trait(_json(ref, "$.name")),
    )


def full_paths(files: Parsed) -> DataFrame:
    """The full path of every id in the path table, foreign ones included.

    Some files list the parent only; the item's own name is then added.
    """
    names = files.index.select(*KEY, "name")
    full = F.when(
        F.size("path") > 0, paths.join_path(F.col("path"), F.coalesce("name", F.lit("")))
    ).otherwise(F.col("path_name"))
    return files.paths.join(names, KEY, "left").select(*KEY, full.alias("full"))


def resolve_traits(rows: DataFrame, known: DataFrame, ref: str, out: str) -> DataFrame:
    """Add the full path of a trait reference: by its id, else by its name."""
    table = known.select("crate", "version", F.col("item_id").alias("_tid"), F.col("full").alias("_full"))
    keyed = rows.withColumn("_tid", _trait_id(F.col(ref)))
    return (
        keyed.join(table, ["crate", "version", "_tid"], "left")
        .withColumn(out, F.coalesce("_full", _trait_name(F.col(ref))))
        .drop("_tid", "_full")
    )


def impls(files: Parsed) -> DataFrame:
    """All impl blocks with the rendered type and, if any, the trait reference."""
    rows = files.index.select(*KEY, "attrs", "deprecation", F.col("inner")["impl"].alias("body"))
    rows = rows.where(F.col("body").isNotNull() & _json("body", "$.for").isNotNull())
    return rows.withColumns(
        {
            "impl_type_path": signatures.type_name(_json("body", "$.for")),
            "trait_ref": _json("body", "$.trait"),
            "members": _json_array("body", "$.items"),
        }
    )


def trait_impls(files: Parsed) -> DataFrame:
    """``impl Trait for Type`` blocks; inherent blocks are left out."""
    rows = files.blocks.where(F.col("trait_ref").isNotNull())
    params = _json("body", "$.generics.params")
    names = F.transform(
        F.from_json(params, "array<string>"), lambda p: F.coalesce(_json(p, "$.name"), F.lit("?"))
    )
    where = _json("body", "$.generics.where_predicates")
    has_params, has_where = F.size(names) > 0, ~F.coalesce(where, F.lit("[]")).isin("[]", "null")
    generic = F.when(
        has_params, F.concat(F.lit("<"), F.array_join(names, ", "), F.lit(">"))
    ).otherwise("")
    synthetic = F.coalesce(_json("body", "$.synthetic") == "true", F.lit(False))
    negative = F.coalesce(
        (_json("body", "$.negative") == "true") | (_json("body", "$.polarity") == "negative"), F.lit(False)
    )
    blanket = _json("body", "$.blanket_impl")
    rendered = signatures.type_name(F.concat(F.lit('{"resolved_path": '), "trait_ref", F.lit("}")))
    arguments = F.coalesce(F.regexp_extract(rendered, "(<.*)$", 1), F.lit(""))
    return rows.where(F.col("trait_path").isNotNull()).select(
        *KEY,
        "trait_path",
        "impl_type_path",
        F.when(has_params, params).alias("generic_params"),
        F.when(has_where, where).alias("where_clauses"),
        (blanket.isNotNull() | synthetic).alias("is_blanket"),
        negative.alias("is_negative"),
        synthetic.alias("is_synthetic"),
        F.concat(
            F.lit("impl"), generic, F.lit(" "), "trait_path", arguments, F.lit(" for "), "impl_type_path",
            F.when(has_where, " where ...").otherwise(""),
        ).alias("impl_signature"),
        intelligence.stability(F.col("attrs"), F.col("deprecation")).alias("stability_level"),
    )


def traits(files: Parsed) -> DataFrame:
    """Trait definitions with member ids; ``supertrait_rows`` lists their bounds."""
    rows = files.entries.where(F.col("inner_kind") == "trait")
    return rows.select(
        *KEY,
        F.col("item_path").alias("trait_path"),
        _json_array("body", "$.items").alias("members"),
        _json_array("body", "$.bounds").alias("bounds"),
        F.coalesce(_json("body", "$.is_unsafe") == "true", F.lit(False)).alias("is_unsafe"),
        F.when(F.size(_json_array("body", "$.generics.params")) > 0, _json("body", "$.generics.params")).alias(
            "generic_params"
        ),
        intelligence.stability(F.col("attrs"), F.col("deprecation")).alias("stability_level"),
    )


def supertrait_rows(files: Parsed) -> DataFrame:
    """``trait_path``, ``supertrait`` for every bound of every trait."""
    rows = traits(files).select("crate", "version", "trait_path", F.explode("bounds").alias("bound"))
    ref = F.coalesce(_json("bound", "$.trait_bound.trait"), F.col("bound"))
    rows = resolve_traits(rows.withColumn("ref", ref), full_paths(files), "ref", "supertrait")
    return rows.where(F.col("supertrait").isNotNull()).select("crate", "version", "trait_path", "supertrait")


def associated_items(files: Parsed) -> DataFrame:
    """Members of traits, found by id in the index."""
    members = traits(files).select(
        "crate", "version", "trait_path", "stability_level", F.explode("members").alias("item_id")
    )
    rows = members.join(
        files.index.select(*KEY, "name", "visibility", "inner"), KEY
    ).withColumn("kind", F.get(F.map_keys("inner"), F.lit(0)))
    body = F.try_element_at("inner", F.col("kind"))
    rows = rows.withColumn("body", body).withColumn("_type", signatures.type_name(_json("body", "$.type")))
    item_kind = (
        F.when(F.col("kind") == "assoc_const", "const")
        .when(F.col("kind").isin("function", "method"), "function")
        .otherwise("type")
    )
    name = F.coalesce("name", F.lit(""))
    typed = F.when(F.col("_type").isNotNull(), F.concat(F.lit(": "), "_type")).otherwise("")
    has_decl = F.coalesce(_json("body", "$.decl"), _json("body", "$.sig")).isNotNull()
    signature = (
        F.when(item_kind == "const", F.concat(F.lit("const "), name, typed))
        .when(item_kind == "type", F.concat(F.lit("type "), name))
        .otherwise(F.concat(F.lit("fn "), name, F.when(has_decl, "(...)").otherwise("()")))
    )
    return rows.select(
        "crate",
        "version",
        F.col("trait_path").alias("container_path"),
        name.alias("item_name"),
        item_kind.alias("item_kind"),
        signature.alias("item_signature"),
        F.coalesce(_json("body", "$.default"), _json("body", "$.value")).alias("default_value"),
        F.coalesce("visibility", F.lit("pub")).alias("visibility"),
        "stability_level",
        "item_id",
    )


def methods(files: Parsed) -> DataFrame:
    """Methods of all impl blocks: inherent ones, trait ones, inherited defaults."""
    blocks = files.blocks
    index = files.index.select(
        *KEY, "name", "visibility", F.coalesce(F.col("inner")["function"], F.col("inner")["method"]).alias("body")
    )
    members = blocks.select(
        "crate", "version", "impl_type_path", "trait_path", F.explode("members").alias("item_id")
    )
    rows = members.join(index.where(F.col("body").isNotNull()), KEY)
    rows = with_signature(rows.withColumn("inner_kind", F.lit("function")))
    first = F.get(function_parts(F.col("body"))["inputs"], F.lit(0))

    def flag(*places: str) -> Column:
        out = F.lit(False)
        for place, word in [p.split("=") for p in places]:
            out = out | F.coalesce(_json("body", place) == word, F.lit(False))
        return out

    found = rows.select(
        "crate",
        "version",
        F.col("impl_type_path").alias("parent_type_path"),
        F.col("name").alias("method_name"),
        F.col("signature").alias("full_signature"),
        flag("$.decl.header.asyncness=async", "$.header.is_async=true").alias("is_async"),
        flag("$.decl.header.unsafety=unsafe", "$.header.is_unsafe=true").alias("is_unsafe"),
        flag("$.decl.header.constness=const", "$.header.is_const=true").alias("is_const"),
        F.coalesce("visibility", F.lit("pub")).alias("visibility"),
        F.when(F.col("trait_path").isNull(), "inherent").otherwise("trait").alias("method_kind"),
        F.col("trait_path").alias("trait_source"),
        signatures.receiver(first).alias("receiver_type"),
        "item_id",
    )
    scope = ["crate", "version"]
    own = found.where(F.col("trait_source").isNotNull()).select(
        *scope, F.col("parent_type_path").alias("impl_type_path"), F.col("trait_source").alias("trait_path"), "method_name"
    )
    defaults = associated_items(files).where(F.col("item_kind") == "function").select(
        *scope, F.col("container_path").alias("trait_path"), F.col("item_name").alias("method_name")
    )
    pairs = blocks.where(F.col("trait_path").isNotNull())
    inherited = methods_with_defaults(own, defaults, pairs, scope).where("is_default")
    extra = inherited.select(
        *scope,
        F.col("impl_type_path").alias("parent_type_path"),
        "method_name",
        F.concat(F.lit("fn "), "method_name", F.lit("()")).alias("full_signature"),
        F.lit("trait").alias("method_kind"),
        F.col("trait_path").alias("trait_source"),
        F.concat(F.lit("default_"), "method_name").alias("item_id"),
    )
    return found.unionByName(extra, allowMissingColumns=True)


def trait_rows(files: Parsed) -> DataFrame:
    """Rows of the table of implementations: impl blocks, and traits as their own definitions."""
    defined = traits(files).select(
        *KEY, "trait_path", F.col("trait_path").alias("impl_type_path"), "generic_params", "stability_level",
        F.lit(False).alias("is_blanket"), F.lit(False).alias("is_negative"),
        F.concat(F.when(F.col("is_unsafe"), "unsafe trait ").otherwise("trait "), "trait_path").alias("impl_signature"),
        F.lit(True).alias("is_definition"),
    )
    blocks = trait_impls(files).withColumn("is_definition", F.lit(False))
    return blocks.unionByName(defined, allowMissingColumns=True)


# --- places and generics ---------------------------------------------------------


def _ids(*places: str) -> Column:
    """Member ids from the first of several places that has a list; they may be numbers."""
    return F.coalesce(*[_json_array("body", place) for place in places])


def located_paths(files: Parsed) -> DataFrame:
    """``located_path`` of members that the path table leaves out, by what holds them.

    Methods lie under the type of their impl block, those of a trait's impl under
    type and trait; associated items, variants, fields and module members under
    their container.  Where several members of a release would share a path, each
    gets a hash of its impl block and signature, so none replaces another.
    """
    known = files.known.select("crate", "version", F.col("item_id").alias("_type_id"), F.col("full").alias("_type"))
    blocks = files.blocks.withColumns({
        "_type_id": _json("body", "$.for.resolved_path.id"),
        "_trait": signatures.type_name(F.concat(F.lit('{"resolved_path": '), "trait_ref", F.lit("}"))),
    }).join(known, ["crate", "version", "_type_id"], "left")
    # a type without a place keeps its name, less its arguments
    name = F.coalesce("_type", F.regexp_replace("impl_type_path", "<.*", ""))
    of_blocks = blocks.select(
        "crate", "version",
        F.concat_ws("::", name, paths.last_segment(F.col("trait_path"))).alias("owner"),
        F.concat_ws("|", "impl_type_path", "_trait", _json("body", "$.generics.where_predicates")).alias("block"),
        F.explode("members").alias("item_id"),
    )
    holders = files.entries.where(F.coalesce("inner_kind", F.lit("")) != "impl")
    of_holders = holders.select(
        "crate", "version", F.col("item_path").alias("owner"), F.lit("").alias("block"),
        F.explode(_ids("$.items", "$.variants", "$.kind.plain.fields", "$.fields", "$.kind.struct.fields")).alias("item_id"),
    )
    owners = of_blocks.unionByName(of_holders).groupBy(*KEY).agg(F.min(F.struct("owner", "block")).alias("o"))
    bodies = files.index.where(F.coalesce("name", F.lit("")) != "").select(
        *KEY, "name", F.xxhash64(F.to_json("inner")).alias("_inner")
    )
    members = owners.join(bodies, KEY).join(files.paths.where(F.size("path") > 0), KEY, "left_anti").select(
        *KEY, F.concat_ws("::", "o.owner", "name").alias("short"), F.concat_ws("|", "o.block", "_inner").alias("long")
    )
    taken = members.groupBy("crate", "version", "short").agg(F.count("*").alias("_sharing"))
    apart = F.concat_ws("_", "short", F.substring(F.sha2("long", 256), 1, C.KEY_HASH_LENGTH))
    return members.join(taken, ["crate", "version", "short"]).select(
        *KEY, F.when(F.col("_sharing") > 1, apart).otherwise(F.col("short")).alias("located_path")
    )


def with_places(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Rows of ``item_path`` with the path of their container where their own lacks it."""
    placed = rows.join(places, KEY, "left")
    return placed.withColumn("item_path", F.coalesce("located_path", "item_path")).drop("located_path")


def generic_constraints(files: Parsed, places: DataFrame | None = None) -> DataFrame:
    """Generic parameters of items with all their bounds, from the list and the where clauses.

    One row per item and parameter: ``bounds`` joins the distinct bounds with
    `` + `` in the order they are written and is null without any; a const
    parameter has its type there.  Predicates on anything but a bare parameter
    (``T::Item: Debug``) belong to no parameter and are left out.  ``places`` are
    ``located_paths`` at hand.
    """
    places = located_paths(files) if places is None else places
    generic = files.entries.where(F.size(_json_array("body", "$.generics.params")) > 0)
    found = signatures.generic_parameters(_json("body", "$.generics.params"), _json("body", "$.generics.where_predicates"))
    # apart from the join, so that only the two lists go through Python with the keys
    listed = generic.select(*KEY, "item_path", found.alias("found"))
    return with_places(listed, places).select(*KEY, "item_path", F.inline("found")).select(
        *KEY, "item_path", "param_name", "param_kind", "bounds", "default_value",
        F.lit(None).cast("string").alias("variance"),  # not part of the format
        "position",
    )


# --- links -----------------------------------------------------------------------


def reexports(files: Parsed) -> DataFrame:
    """``use`` items: the alias, what it stands for, and whether it is a glob."""
    rows = files.index.withColumn(
        "use", F.coalesce(F.col("inner")["use"], F.col("inner")["Use"], F.col("inner")["import"])
    )
    rows = rows.where(_json("use", "$.source").isNotNull())
    name = F.coalesce("name", _json("use", "$.name"), paths.last_segment(_json("use", "$.source")))
    glob = F.coalesce(_json("use", "$.is_glob"), _json("use", "$.glob")) == "true"
    return rows.select(
        "crate",
        "version",
        F.concat_ws("::", "crate", name).alias("alias_path"),
        _json("use", "$.source").alias("actual_path"),
        F.coalesce(glob, F.lit(False)).alias("is_glob"),
        F.lit("reexport").alias("link_type"),
        F.lit(1.0).alias("confidence_score"),
    )


def cross_references(files: Parsed) -> DataFrame:
    """Documentation links between items of the path table."""
    known = files.known.where(F.col("full").isNotNull())
    links = files.index.select(*KEY, F.explode("links").alias("link_text", "target_id"))
    source = known.select("crate", "version", "item_id", F.col("full").alias("source_path"))
    target = known.select("crate", "version", F.col("item_id").alias("target_id"), F.col("full").alias("target_path"))
    joined = links.join(source, KEY).join(target, ["crate", "version", "target_id"])
    return joined.select("crate", "version", "source_path", "target_path", "link_text")

"""Parts of a declaration: parameters, return type, rendered types."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from docquarry import constants as C


def split_top_level(text: Column) -> Column:
    """Split at commas that no bracket encloses."""
    start = F.struct(
        F.lit(0).alias("depth"), F.lit("").alias("part"), F.array().cast("array<string>").alias("out")
    )

    def step(state: Column, ch: Column) -> Column:
        cut = (ch == ",") & (state["depth"] == 0)
        depth = (
            state["depth"]
            + F.when(ch.isin("(", "<", "[", "{"), 1).otherwise(0)
            - F.when(ch.isin(")", ">", "]", "}"), 1).otherwise(0)
        )
        closed = F.concat(state["out"], F.array(F.trim(state["part"])))
        return F.struct(
            F.when(cut, state["depth"]).otherwise(depth).alias("depth"),
            F.when(cut, "").otherwise(F.concat(state["part"], ch)).alias("part"),
            F.when(cut, closed).otherwise(state["out"]).alias("out"),
        )

    def finish(state: Column) -> Column:
        return F.when(
            state["part"] != "", F.concat(state["out"], F.array(F.trim(state["part"])))
        ).otherwise(state["out"])

    return F.aggregate(F.split(text, ""), start, step, finish)


def parameters(signature: Column) -> Column:
    """Parameters between the first parentheses."""
    inside = F.regexp_extract(signature, r"\((.*?)\)", 1)
    return F.when(inside == "", F.array().cast("array<string>")).otherwise(split_top_level(inside))


def return_type(signature: Column) -> Column:
    found = F.trim(F.regexp_extract(signature, C.RETURN_TYPE, 1))
    return F.when(signature.rlike(C.RETURN_TYPE), found)


def _listed(trees: list | None, between: str = ", ") -> str:
    return between.join(text for text in map(render_type, trees or []) if text)


def _path(body: dict | str) -> str:
    """A path with its generic arguments; ``Fn`` traits have theirs in parentheses."""
    if isinstance(body, str):
        return body
    name, args = body.get("path", body.get("name", "")), body.get("args") or {}
    within = args.get("angle_bracketed") or {}
    inner = _listed([a["type"] for a in within.get("args") or [] if isinstance(a, dict) and "type" in a])
    if called := args.get("parenthesized"):
        output = render_type(called.get("output"))
        return f"{name}({_listed(called.get('inputs'))})" + (f" -> {output}" if output else "")
    return f"{name}<{inner}>" if inner else name


def _bounds(bounds: list) -> str:
    """Traits of ``dyn`` and ``impl`` types."""
    paths = [b.get("trait_bound", b).get("trait") for b in bounds if isinstance(b, dict)]
    return " + ".join(_path(p) for p in paths if p)


def _is_mutable(body: dict) -> bool:
    return bool(body.get("is_mutable") or body.get("mutable"))


def _reference(body: dict) -> str | None:
    lifetime = (body.get("lifetime") or "").lstrip("'")
    target = render_type(body.get("type"))
    words = [f"'{lifetime}" if lifetime else "", "mut" if _is_mutable(body) else "", target or ""]
    return target and "&" + " ".join(w for w in words if w)


def _tuple(trees: list) -> str | None:
    inner = _listed(trees)
    return inner and f"({inner},)" if len(trees) == 1 else inner and f"({inner})"


def _qualified(body: dict) -> str:
    owner, trait = render_type(body.get("self_type")), body.get("trait")
    return f"<{owner} as {_path(trait)}>::{body['name']}" if trait else f"{owner}::{body['name']}"


#: how each kind of type of the rustdoc format is written
TYPE_WRITERS = {
    "resolved_path": _path,
    "path": _path,
    "generic": str,
    "primitive": str,
    "borrowed_ref": _reference,
    "raw_pointer": lambda body: f"*{'mut' if _is_mutable(body) else 'const'} {render_type(body.get('type'))}",
    "tuple": _tuple,
    "slice": lambda body: (text := render_type(body)) and f"[{text}]",
    "array": lambda body: (text := render_type(body.get("type"))) and f"[{text}; {body.get('len', 'N')}]",
    "dyn_trait": lambda body: f"dyn {_bounds(body.get('traits') or [])}",
    "impl_trait": lambda body: f"impl {_bounds(body)}",
    "qualified_path": _qualified,
    "function_pointer": lambda body: "fn(...)",
    "name": str,
    "id": str,
}


def render_type(tree: dict | str | None) -> str | None:
    """Readable form of a type tree: an object whose key is its kind.

    A kind the table lacks, or one with nothing to write, is ``UnknownType``; a
    text stands for itself.  The tree nests, so this is plain Python.
    """
    if not isinstance(tree, dict):
        return str(tree) if tree else None
    kind = next((k for k in TYPE_WRITERS if tree.get(k)), None)
    return (kind and TYPE_WRITERS[kind](tree[kind])) or "UnknownType"


def _render_json(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return render_type(json.loads(text))
    except ValueError:
        return text


@F.pandas_udf(StringType())
def type_name(tree: pd.Series) -> pd.Series:
    """Readable type of a JSON type tree."""
    return tree.map(_render_json)


@F.pandas_udf(ArrayType(StringType()))
def type_names(trees: pd.Series) -> pd.Series:
    """``type_name`` over an array of JSON type trees."""
    return trees.map(lambda row: None if row is None else [_render_json(t) for t in row])


def _node(value) -> dict:
    """A JSON object, also one that is written as a text; anything else holds nothing."""
    if isinstance(value, str):
        try:
            value = json.loads(value, parse_float=str)
        except ValueError:
            return {}
    return value if isinstance(value, dict) else {}


def _at(value, *keys: str):
    """What lies under ``keys``, or None."""
    for key in keys:
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _members(value) -> list:
    """A JSON array, also one that is written as a text; anything else has no members."""
    if isinstance(value, str):
        try:
            value = json.loads(value, parse_float=str)
        except ValueError:
            return []
    return value if isinstance(value, list) else []


def _as_text(value) -> str | None:
    """A text as it is, any other value as JSON."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def _first(*values):
    return next((v for v in values if v is not None), None)


def _bare(name) -> str | None:
    """A name without the quote of a lifetime."""
    text = _as_text(name)
    return text and text.removeprefix("'")


def _rendered(tree) -> str | None:
    return _render_json(tree) if isinstance(tree, str) else render_type(tree)


def _bound(bound) -> str | None:
    """One bound as it is written; a lifetime stands for itself."""
    node = _node(bound)
    trait = _first(_at(node, "trait_bound", "trait"), _at(node, "trait"))
    if isinstance(trait, str) and trait.lstrip().startswith("{"):
        trait = _node(trait) or trait
    if isinstance(trait, dict) and next(iter(trait), None) != "resolved_path":
        trait = {"resolved_path": trait}
    text = _rendered(_first(trait, _at(node, "outlives"), bound))
    relaxed = _at(node, "trait_bound", "modifier") == "maybe"
    return f"?{text}" if relaxed and text is not None else text


def _parameters(params: str | None, where: str | None) -> list[dict]:
    """Named parameters with their distinct bounds, those of the list before those of the clauses."""
    nodes = [_node(p) for p in _members(params)]
    names = [_bare(node.get("name")) for node in nodes]
    bounds: dict[str, dict] = {name: {} for name in names if name is not None}

    def add(name: str | None, trees: list) -> None:
        if name in bounds:
            bounds[name].update(dict.fromkeys(t for t in map(_bound, trees) if t is not None))

    for name, node in zip(names, nodes):
        kind = node.get("kind")
        const = _at(kind, "const", "type")
        add(name, _members(_at(kind, "type", "bounds")) + _members(_at(kind, "lifetime", "outlives"))
            + ([] if const is None else [const]))
    for clause in map(_node, _members(where)):
        name = _first(_at(clause, "bound_predicate", "type", "generic"), _at(clause, "lifetime_predicate", "lifetime"),
                      _at(clause, "region_predicate", "lifetime"))
        add(_bare(name), _members(_at(clause, "bound_predicate", "bounds"))
            + _members(_at(clause, "lifetime_predicate", "outlives")))
    rows = []
    for position, (name, node) in enumerate(zip(names, nodes)):
        if name is None:
            continue
        kind = node.get("kind")
        is_lifetime, is_const = _at(kind, "lifetime") is not None, _at(kind, "const") is not None
        rows.append({
            "position": position,
            "param_name": f"'{name}" if is_lifetime else _as_text(node["name"]),
            "param_kind": "lifetime" if is_lifetime else "const" if is_const else "type",
            "bounds": " + ".join(bounds[name]) or None,
            "default_value": _first(_rendered(_at(kind, "type", "default")), _as_text(_at(kind, "const", "default"))),
        })
    return rows


PARAMETER = StructType(
    [StructField("position", IntegerType())]
    + [StructField(name, StringType()) for name in ("param_name", "param_kind", "bounds", "default_value")]
)


@F.arrow_udf(ArrayType(PARAMETER))
def generic_parameters(params: pa.Array, where: pa.Array) -> pa.Array:
    """Generic parameters of an item from the JSON of its list and its where clauses.

    Each text is parsed once, as JSON paths in nested lambdas parse it for every
    field of every bound.
    """
    rows = [_parameters(p, w) for p, w in zip(params.to_pylist(), where.to_pylist())]
    return pa.array(rows, pa.list_(pa.struct([(f.name, pa.int32() if f.name == "position" else pa.string()) for f in PARAMETER])))


def input_name(tree: Column) -> Column:
    """Parameter name of one input, an object or a ``[name, type]`` pair."""
    return F.coalesce(
        F.get_json_object(tree, "$.name"), F.get_json_object(tree, "$[0]"), F.lit("_")
    )


def input_type(tree: Column) -> Column:
    """Type tree of one input, as JSON."""
    return F.coalesce(F.get_json_object(tree, "$.type"), F.get_json_object(tree, "$[1]"))


def generic_names(params: Column) -> Column:
    """``<'a, T: Clone, const N: usize>`` from an array of JSON parameters; '' if none."""

    def one(param: Column) -> Column:
        name = F.get_json_object(param, "$.name")
        bounds = F.from_json(F.get_json_object(param, "$.kind.type.bounds"), "array<string>")
        traits = F.transform(
            bounds,
            lambda b: F.coalesce(
                F.get_json_object(b, "$.trait.resolved_path.name"),
                F.get_json_object(b, "$.trait.path.name"),
                F.get_json_object(b, "$.trait.name"),
                F.get_json_object(b, "$.trait"),
            ),
        )
        const_type = F.coalesce(
            F.get_json_object(param, "$.kind.const.type.primitive"),
            F.get_json_object(param, "$.kind.const.type.name"),
            F.get_json_object(param, "$.kind.const.type"),
        )
        return (
            F.when(F.get_json_object(param, "$.kind.lifetime").isNotNull(), F.concat(F.lit("'"), name))
            .when(const_type.isNotNull(), F.concat(F.lit("const "), name, F.lit(": "), const_type))
            .when(
                F.get_json_object(param, "$.kind.const").isNotNull(), F.concat(F.lit("const "), name)
            )
            .when(F.size(traits) > 0, F.concat(name, F.lit(": "), F.array_join(traits, " + ")))
            .otherwise(name)
        )

    shown = F.filter(F.transform(params, one), lambda p: p.isNotNull())
    return F.when(
        F.size(shown) > 0, F.concat(F.lit("<"), F.array_join(shown, ", "), F.lit(">"))
    ).otherwise("")


def receiver(first_input: Column) -> Column:
    """``self``, ``&self`` or ``&mut self``; null for a plain function."""
    tree = input_type(first_input)
    mutable = F.coalesce(
        F.get_json_object(tree, "$.borrowed_ref.is_mutable") == "true",
        F.get_json_object(tree, "$.borrowed_ref.mutable") == "true",
        F.get_json_object(tree, "$.borrowed_ref.mutability") == "mutable",
        F.lit(False),
    )
    borrowed = F.get_json_object(tree, "$.borrowed_ref").isNotNull()
    return F.when(
        input_name(first_input) == "self",
        F.when(borrowed & mutable, "&mut self").when(borrowed, "&self").otherwise("self"),
    )

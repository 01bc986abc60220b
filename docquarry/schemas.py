"""Table schemas.  Nothing in the package infers a schema from data."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _table(*fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields])


S, L, I, D, B, TS = (
    StringType(),
    LongType(),
    IntegerType(),
    DoubleType(),
    BooleanType(),
    TimestampType(),
)
STRINGS = ArrayType(S)
VECTOR = ArrayType(FloatType())
EXAMPLE = _table(("code", S), ("language", S), ("detected", B))
EXAMPLES = ArrayType(EXAMPLE)

# every entity table is partitioned by crate and version instead of being kept
# in one file per release
CRATES = _table(
    ("crate", S),
    ("version", S),
    ("id", L),
    ("description", S),
    ("repository", S),
    ("documentation", S),
    ("created_at", TS),
)
MODULES = _table(
    ("crate", S),
    ("version", S),
    ("id", L),
    ("name", S),
    ("path", S),
    ("parent_id", L),
    ("depth", I),
    ("item_count", L),
)
REEXPORTS = _table(
    ("crate", S),
    ("version", S),
    ("alias_path", S),
    ("actual_path", S),
    ("is_glob", B),
    ("link_text", S),
    ("link_type", S),
    ("target_item_id", S),
    ("confidence_score", D),
)
ITEMS = _table(
    ("crate", S),
    ("version", S),
    ("id", L),
    ("item_path", S),
    ("header", S),
    ("content", S),
    ("doc_length", I),
    ("embedding", VECTOR),
    ("item_type", S),
    ("signature", S),
    ("parent_id", S),
    ("examples", S),
    ("visibility", S),
    ("deprecated", B),
    ("generic_params", S),
    ("trait_bounds", S),
    ("stability_level", S),
    ("safety_info", _table(("is_safe", B), ("unsafe_reason", S), ("safety_docs", S))),
    ("error_types", STRINGS),
    ("feature_requirements", STRINGS),
    ("is_safe", B),
)
EXAMPLE_ITEMS = _table(
    ("crate", S),
    ("version", S),
    ("item_id", L),
    ("item_path", S),
    ("example_hash", S),
    ("example_text", S),
    ("language", S),
    ("context", S),
    ("embedding", VECTOR),
)
INGESTION_STATUS = _table(
    ("crate_id", L),
    ("status", S),
    ("started_at", TS),
    ("updated_at", TS),
    ("completed_at", TS),
    ("error_message", S),
    ("items_processed", L),
    ("total_items", L),
    ("checkpoint_data", S),
    ("ingestion_tier", S),
)
TRAIT_IMPLS = _table(
    ("crate", S),
    ("version", S),
    ("trait_path", S),
    ("impl_type_path", S),
    ("generic_params", S),
    ("where_clauses", S),
    ("is_blanket", B),
    ("is_negative", B),
    ("impl_signature", S),
    ("stability_level", S),
    ("item_id", S),
    ("is_definition", B),
)
METHODS = _table(
    ("crate", S),
    ("version", S),
    ("parent_type_path", S),
    ("method_name", S),
    ("full_signature", S),
    ("generic_params", S),
    ("where_clauses", S),
    ("return_type", S),
    ("is_async", B),
    ("is_unsafe", B),
    ("is_const", B),
    ("visibility", S),
    ("method_kind", S),
    ("trait_source", S),
    ("receiver_type", S),
    ("stability_level", S),
    ("item_id", S),
)
ASSOCIATED_ITEMS = _table(
    ("crate", S),
    ("version", S),
    ("container_path", S),
    ("item_name", S),
    ("item_kind", S),
    ("item_signature", S),
    ("default_value", S),
    ("visibility", S),
    ("stability_level", S),
    ("item_id", S),
)
GENERIC_CONSTRAINTS = _table(
    ("crate", S),
    ("version", S),
    ("item_path", S),
    ("param_name", S),
    ("param_kind", S),
    ("bounds", S),
    ("default_value", S),
    ("variance", S),
    ("position", I),
)

# unique keys the store enforces on write
KEYS = {
    "items": ["crate", "version", "item_path"],
    "reexports": ["crate", "version", "alias_path", "actual_path", "link_type"],
    "example_items": ["crate", "version", "example_hash"],
    "trait_impls": ["crate", "version", "trait_path", "impl_type_path", "generic_params"],
    "methods": ["crate", "version", "parent_type_path", "method_name", "full_signature"],
    "associated_items": ["crate", "version", "container_path", "item_name", "item_kind"],
    "generic_constraints": ["crate", "version", "item_path", "param_name"],
}

"""The wording of changes, hints, notes and reasons.

Results are compared and searched by these texts, so they are part of the
format.  ``{name}`` stands for a column.
"""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# what changed in an item
ITEM_REMOVED = "Item removed from API"
ITEM_ADDED = "New item added to API"
SIGNATURE_CHANGED = "Function/type signature changed"
MADE_PRIVATE = "Changed from public to private"
VISIBILITY_CHANGED = "Visibility changed to {visibility}"
DEPRECATED = "Item marked as deprecated"
GENERICS_CHANGED = "Generic parameters changed"
BOUNDS_CHANGED = "Trait bounds changed"

# why a change breaks users
BREAKS_REMOVED = "Public item removed from API"
BREAKS_SIGNATURE = "Function/method signature incompatibly changed"
BREAKS_VISIBILITY = "Visibility reduced from public"
BREAKS_GENERICS = "Generic parameters or bounds changed"
BREAKS_ENUM = "Enum variant added without #[non_exhaustive]"
BREAKS_STRUCT = "Field added to publicly constructible struct"
BREAKS_TRAIT = "Required method added to trait"

# hints: (issue, suggested fix)
HINT_REMOVED = ("'{path}' has been removed", "Find alternative API or remove usage of '{path}'")
HINT_SIGNATURE = ("Function signature has changed", "Update function calls to match new signature")
HINT_PRIVATE = ("Item is no longer publicly accessible", "Use alternative public API or refactor code")

# advice: (action, description, hint)
ADVICE_REMOVED = ("remove_usage", "Remove all usages of '{path}'", "Search for alternative APIs or refactor code")
ADVICE_SIGNATURE = ("update_calls", "Update all calls to '{path}'", "Update function calls to match new signature")
ADVICE_PRIVATE = ("find_alternative", "'{path}' is no longer public", "Find alternative public API or refactor")
ADVICE_GENERIC = (
    "update_types",
    "Update type parameters for '{path}'",
    "Adjust generic type arguments and constraints",
)

# migration notes
NOTE_REMOVED = (
    "The item '{old}' has been removed. Check release notes for alternatives or deprecation notices."
)
NOTE_ADDED = "New item '{new}' was added. Consider using it if it replaces deprecated functionality."
NOTE_MOVED = "Item was moved from '{old}' to '{new}'. Update your imports accordingly."
NOTE_RENAMED = "Item was renamed from '{old}' to '{new}'. Update all references."
NOTE_MODIFIED = "The signature of '{old}' has changed. Review the new API at '{new}' for compatibility."
NOTE_OTHER = "Change detected: {change}. Review documentation for migration guidance."

# telling methods apart
MANY_KINDS = "Multiple methods found: inherent and trait implementations"
INHERENT_FIRST = "Inherent method takes precedence by default"
FROM_TRAITS = "Trait methods from: {sources}"
RECEIVERS = "Different receiver types: {receivers}"
SOME_CONST = "Both const and non-const versions available"

# steps of an upgrade: (title, description, counted column)
UPGRADE_STEPS = [
    ("Address Breaking Changes", "Fix {n} breaking changes", "breaking_changes"),
    ("Replace Deprecated Items", "Update {n} deprecated items", "deprecated_items"),
    ("Explore New Features", "Learn about {n} new items", "added_items"),
]

# steps of a first reading: (title, item types)
READING_STEPS = [
    ("Core Concepts", ["module", "trait"]),
    ("Key Data Structures", ["struct", "enum"]),
    ("Common Functions", ["function"]),
]


def fill(template: str, **columns: Column) -> Column:
    """A template as a Column."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[columns[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])

"""Parameter checks that run before a plan is built."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from docquarry import constants as C


def to_int(value, name: str, low: int, high: int) -> int | None:
    if value is None:
        return None
    try:
        number = int(str(value).strip())
    except ValueError:
        raise ValueError(f"{name} must be a whole number, got {value!r}") from None
    if not low <= number <= high:
        raise ValueError(f"{name} must be between {low} and {high}, got {number}")
    return number


def to_float(value, name: str, low: float, high: float) -> float | None:
    if value is None:
        return None
    try:
        number = float(value)
    except (TypeError, ValueError):
        raise ValueError(f"{name} must be a number, got {value!r}") from None
    if not low <= number <= high:
        raise ValueError(f"{name} must be between {low} and {high}, got {number}")
    return number


def to_bool(value, name: str) -> bool | None:
    if value is None or isinstance(value, bool):
        return value
    text = str(value).strip().lower()
    if text in ("true", "1", "yes", "on"):
        return True
    if text in ("false", "0", "no", "off", ""):
        return False
    raise ValueError(f"{name} must be true or false, got {value!r}")


def crate_name(value) -> str:
    text = "" if value is None else str(value).strip()
    if not text:
        raise ValueError("a crate name is required")
    if len(text) > C.MAX_CRATE_NAME:
        raise ValueError(f"a crate name has at most {C.MAX_CRATE_NAME} characters")
    if not re.match(C.CRATE_NAME, text):
        raise ValueError("a crate name has lower-case letters, digits, '-' and '_' only")
    return text


def version(value) -> str | None:
    if value is None or not str(value).strip():
        return None
    text = str(value).strip()
    if text != "latest" and not re.match(C.SEMVER, text):
        raise ValueError(f"not a semantic version: {text!r}")
    return text


def item_path(value) -> str:
    text = "" if value is None else str(value).strip()
    if not text:
        raise ValueError("an item path is required")
    if len(text) > C.MAX_PATH_LENGTH:
        raise ValueError(f"a path has at most {C.MAX_PATH_LENGTH} characters")
    if text != "crate" and not re.match(C.VALID_PATH, text):
        raise ValueError(f"not a path of identifiers joined by '::': {text!r}")
    return text


def module_path(value) -> str | None:
    if value is None or not str(value).strip():
        return None
    text = str(value).strip()
    if len(text) > C.MAX_PATH_LENGTH:
        raise ValueError(f"a path has at most {C.MAX_PATH_LENGTH} characters")
    parts = text.split("::")
    if not re.match(C.MODULE_PATH, text) or any(not part for part in parts):
        raise ValueError(f"not a module path: {text!r}")
    return text


def safe_regex(pattern: str) -> str:
    """Refuse patterns that can take exponential time or do not compile."""
    for shape in C.UNSAFE_REGEX_SHAPES:
        if re.search(shape, pattern):
            raise ValueError(f"pattern {pattern!r} nests or repeats quantifiers")
    try:
        re.compile(pattern)
    except re.error as problem:
        raise ValueError(f"invalid pattern {pattern!r}: {problem}") from None
    return pattern


def crate_list(value) -> list[str]:
    """Crate names from a list or a comma-separated text: each once, five at most."""
    names = value.split(",") if isinstance(value, str) else list(value or [])
    unique = list(dict.fromkeys(crate_name(n) for n in names if str(n).strip()))
    if len(unique) > C.MAX_CRATES_PER_SEARCH:
        raise ValueError(f"at most {C.MAX_CRATES_PER_SEARCH} crates can be searched together")
    return unique


def search_text(value) -> str:
    """The prepared form of one query; the column form is ``text.prepare_query``."""
    text = "" if value is None else str(value).strip()
    if not text:
        raise ValueError("a query is required")
    if len(text) > C.MAX_QUERY_LENGTH:
        raise ValueError(f"a query has at most {C.MAX_QUERY_LENGTH} characters")
    words = []
    for word in unicodedata.normalize("NFKC", text).split():
        target = C.SPELLING.get(word.lower())
        if target is None:
            words.append(word)
        elif word.isupper():
            words.append(target.upper())
        else:
            words.append(target.capitalize() if word[0].isupper() else target)
    terms = [t for w in words for t in C.TERM_EXPANSIONS.get(w.lower(), [w])]
    return " ".join(dict.fromkeys(terms))


def _choice(value, name: str, allowed: list[str]) -> str | None:
    if value is None or value == "":
        return None
    text = str(value).strip().lower()
    if text not in allowed:
        raise ValueError(f"{name} must be one of {allowed}, got {text!r}")
    return text


@dataclass
class SearchFilters:
    """Checked optional filters of a search."""

    item_type: str | None = None
    crate: str | None = None
    module: str | None = None
    has_examples: bool | None = None
    min_doc_length: int | None = None
    visibility: str | None = None
    deprecated: bool | None = None
    stability: str | None = None
    home_crate: str | None = None

    def __post_init__(self):
        self.item_type = _choice(self.item_type, "item_type", C.SEARCHABLE_KINDS)
        self.visibility = _choice(self.visibility, "visibility", C.VISIBILITIES)
        self.stability = _choice(self.stability, "stability", C.STABILITIES)
        self.crate = None if self.crate in (None, "") else crate_name(self.crate)
        self.module = module_path(self.module)
        self.has_examples = to_bool(self.has_examples, "has_examples")
        self.deprecated = to_bool(self.deprecated, "deprecated")
        self.min_doc_length = to_int(self.min_doc_length, "min_doc_length", *C.DOC_LENGTH_BOUNDS)
        elsewhere = self.home_crate is not None and self.crate not in (None, self.home_crate)
        if elsewhere and self.module:
            raise ValueError("a module filter works inside the searched crate only")
        if elsewhere and self.visibility == "private":
            raise ValueError("private items are visible inside their own crate only")
        if self.has_examples and self.min_doc_length and self.min_doc_length > C.LONG_DOC_WITH_EXAMPLES:
            raise ValueError("min_doc_length is too high together with has_examples")

    def as_dict(self) -> dict:
        names = ["item_type", "crate", "module", "has_examples", "min_doc_length"]
        names += ["visibility", "deprecated", "stability"]
        return {n: getattr(self, n) for n in names}

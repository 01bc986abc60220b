from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.functions import fuzzy
from docquarry.operators import lookup

PATHS = [
    "tokio::task::spawn",
    "tokio::spawn_blocking",
    "tokio::spawn_local",
    "tokio::runtime::Runtime",
    "tokio::task::JoinHandle",
    "serde::ser::Serialize",
    "serde::de::Deserialize",
    "std::vec::Vec",
    "std::collections::HashMap",
]
words = st.text(alphabet="abc _", max_size=9)


def common_by_table(a: str, b: str) -> int:
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            same = rows[i - 1][j - 1] + 1
            rows[i][j] = same if x == y else max(rows[i - 1][j], rows[i][j - 1])
    return rows[-1][-1]


def partial_by_windows(a: str, b: str) -> float:
    """Every window of the longer text, nothing skipped."""

    def best(short, long):
        n = len(short)
        windows = [long[:i] for i in range(1, n)]
        windows += [long[i : i + n] for i in range(len(long) - n + 1)]
        windows += [long[i:] for i in range(len(long) - n + 1, len(long))]
        return max(200 * common_by_table(short, w) / (n + len(w)) for w in windows if w)

    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long = sorted((a, b), key=len)
    return max(best(short, long), best(long, short)) if len(a) == len(b) else best(short, long)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_common_length(a, b):
    assert fuzzy.common_length(a, b) == common_by_table(a, b)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_partial_ratio(a, b):
    assert abs(fuzzy.partial_ratio(a, b) - partial_by_windows(a, b)) < 1e-9


def test_known_ratios():
    assert fuzzy.ratio("this is a test", "this is a test!") == 200 * 14 / 29
    assert fuzzy.token_sort_ratio("fuzzy was a bear", "was a bear fuzzy") == 100.0
    assert fuzzy.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100.0
    assert fuzzy.token_set_ratio("", "x") == 0.0
    assert fuzzy.partial_ratio("test", "this is a test!") == 100.0


def test_path_score_limits():
    assert fuzzy.path_score("tokio::spawn", "tokio::spawn") == 1.0
    assert fuzzy.path_score("zz::top", "tokio::spawn") == 0.0


def test_thresholds():
    found = [fuzzy.adaptive_threshold("x" * n) for n in (5, 6, 10, 11, 20, 21)]
    assert found == [0.55, 0.6, 0.6, 0.63, 0.63, 0.65]


def test_suggestions_equal_brute_force(spark):
    items = spark.createDataFrame([(p,) for p in PATHS * 2], "item_path string")
    for query in ("tokio::spwan", "serde::Deserialise", "HashMap", "std::vec", "tokio::runtime"):
        got = [r["item_path"] for r in lookup.fuzzy_suggestions(items, query, 5).collect()]
        threshold = min(0.6, fuzzy.adaptive_threshold(query))
        scored = []
        for path in PATHS:
            base = fuzzy.path_score(query, path, threshold)
            mine, other = query.split("::")[-1].lower(), path.split("::")[-1].lower()
            bonus = 0.15 if mine == other else 0.08 if mine in other else 0.048 if other in mine else 0
            if base and min(1, base + bonus) >= threshold:
                scored.append((-min(1, base + bonus), path))
        assert got == [p for _, p in sorted(scored)[:5]]


def test_typo_finds_path(spark):
    items = spark.createDataFrame([(p,) for p in PATHS], "item_path string")
    assert lookup.fuzzy_suggestions(items, "tokio::spwan_blocking").first()["item_path"] == "tokio::spawn_blocking"


def test_aliases(spark):
    asked = [("tokio", "spawn"), ("std", "HashMap"), ("x", "tokio::spawn"), ("x", "y"), ("x", "crate")]
    rows = spark.createDataFrame(asked, "crate string, path string")
    got = {(r["crate"], r["path"]): r["resolved_path"] for r in lookup.resolve_aliases(rows).collect()}
    assert got == {
        ("tokio", "spawn"): "tokio::task::spawn",
        ("std", "HashMap"): "std::collections::HashMap",
        ("x", "tokio::spawn"): "tokio::task::spawn",
        ("x", "y"): "y",
        ("x", "crate"): "crate",
    }

"""Different items keep different keys, however their paths are stored."""

from docquarry import constants as C
from docquarry.sources import store


def test_no_item_lost(spark):
    long = "a::" + "b" * 300
    given = ["a::x-y", "a::x_y", "a::x.y", " a::x_y ", long + "c", long + "d", "a" * 254 + "::c", "a" * 254 + "::d", "9::9", "a::plain"]
    rows = [(p, i, "function", "h", f"doc {i}", None, None, i) for i, p in enumerate(given)]
    chunks = spark.createDataFrame(
        rows, "item_path string, item_id long, item_type string, header string, doc string, visibility string, deprecated boolean, seq long"
    )
    got = {r.item_id: r.item_path for r in store.upsert_items(None, chunks).collect()}
    # only the path with blanks around it names an item that is there
    assert set(got) == {0, 2, 3, 4, 5, 6, 7, 8, 9}
    assert len(set(got.values())) == 9
    assert got[3] == "a::x_y" and got[9] == "a::plain"
    assert all(len(p) <= C.MAX_PATH_LENGTH for p in got.values())
    # new rows of the same paths replace the stored ones
    again = store.upsert_items(store.upsert_items(None, chunks), chunks)
    assert {r.item_id: r.item_path for r in again.collect()} == got

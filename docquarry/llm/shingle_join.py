"""Near-duplicate documents: Jaccard join of 5-word shingles with tiles and bitmaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.common import giving_back, query, table, whole_text
from docquarry.llm.components import components
from docquarry.session import staged

WORDS = 5
#: documents link when 100 * intersection >= 80 * union
NEEDED, OF = 4, 9  # so 9 * intersection >= 4 * (size + other size)
#: sizes of one band differ by at most this factor, so links reach the next band only
BAND = 1.25
BITMAP_LONGS = 16
#: sets beyond this size have a second bitmap of two to four bits a shingle, as the first one is full
WIDE_FROM = BITMAP_LONGS * 32
#: shingles that so many documents of one batch share are ordered last, the most frequent ones at most
COMMON_IN_BATCH, COMMON = 4, 1 << 15
BATCH_CHARS = 1_000_000
#: ids of documents under exact comparison that are broadcast, 8 bytes each
BROADCAST_IDS = 1_000_000
#: texts are hashed in blocks of about so many bytes
BLOCK_BYTES = 1 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(29))


#: a number per byte; capitals count as small letters, blanks as nothing
_letters = _mixed(np.arange(1, 257, dtype=np.uint64) * FACTOR)
_letters[65:91] = _letters[97:123]
_blank = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_letters[_blank] = 0


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in a row, and the number of words of each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    gap = _blank[data]
    first = ~gap
    first[1:] &= gap[:-1]
    starts = np.flatnonzero(first)
    froms = np.cumsum([0, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(starts, froms))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), counts
    place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))
    powers = np.full(int(place.max()) + 1, FACTOR)
    powers[0] = 1
    return _mixed(np.add.reduceat(_letters[data[starts[0] :]] * np.cumprod(powers)[place], starts - starts[0])), counts


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts in a row, and their owners."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    block = np.cumsum([len(t) for t in encoded]) // BLOCK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(encoded)]
    parts = [word_hashes(encoded[i:j]) for i, j in zip(cuts, cuts[1:]) if i < j]
    counts = np.concatenate([np.zeros(0, dtype=np.int64), *(c for _, c in parts)])
    single = np.concatenate([*(h for h, _ in parts), np.zeros(WORDS, dtype=np.uint64)]) + np.uint64(1)
    total, ends = int(counts.sum()), np.cumsum(counts)
    rolled, whole = np.zeros(total, dtype=np.uint64), np.ones(total, dtype=bool)
    for i in range(WORDS):
        rolled *= FACTOR
        rolled += single[i : i + total]
        if i:  # a shingle that starts here would reach into the next text
            whole[np.maximum(ends - i, 0)[counts > 0]] = False
    for few in range(1, WORDS):
        # a text of fewer words is one shingle
        at = (ends - counts)[counts == few]
        value = np.zeros(len(at), dtype=np.uint64)
        for i in range(few):
            value = value * FACTOR + single[at + i]
        rolled[at], whole[at] = value, True
    owner = np.repeat(np.arange(len(texts)), np.where(counts < WORDS, counts > 0, counts - WORDS + 1))
    return _mixed(rolled[whole]).view(np.int64), owner


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts in a row, sorted per text; owners; set sizes."""
    rolled, owner = shingle_hashes(texts)
    ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
    for start, end in zip([0, *ends[:-1]], ends):
        rolled[start:end].sort()
    if len(rolled):
        new = np.concatenate(([True], (rolled[1:] != rolled[:-1]) | (owner[1:] != owner[:-1])))
        rolled, owner = rolled[new], owner[new]
    return rolled, owner, np.bincount(owner, minlength=len(texts))


def set_names(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of every set; 0 for the empty one."""
    mixed = (shingles.view(np.uint64) ^ (shingles.view(np.uint64) >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    names, has = np.zeros(len(sizes), dtype=np.uint64), sizes > 0
    if len(shingles):
        names[has] = np.add.reduceat(mixed ^ (mixed >> np.uint64(27)), (np.cumsum(sizes) - sizes)[has])
    return names.view(np.int64)


def _wide_maps(shingles: np.ndarray, sizes: np.ndarray) -> list[np.ndarray | None]:
    """Bitmaps of the large sets; their length is a power of two."""
    ends = np.cumsum(sizes)
    maps: list[np.ndarray | None] = [None] * len(sizes)
    for i in np.flatnonzero(sizes > WIDE_FROM):
        bits = np.zeros(1 << (2 * int(sizes[i]) - 1).bit_length(), dtype=bool)
        bits[shingles[ends[i] - sizes[i] : ends[i]].view(np.uint64) % np.uint64(len(bits))] = True
        maps[i] = np.packbits(bits).view(np.int64)
    return maps


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of bounded text size."""
    for frame in frames:
        sizes = frame.body.str.len().to_numpy().cumsum() // BATCH_CHARS
        for _, piece in frame.groupby(sizes, sort=True):
            yield piece


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents share, rarest first, and how often they were counted.

    They are ordered last in every document, which keeps shared passages out of
    the prefixes.  Any order gives the same links; the list only saves work, and
    its length is bounded.
    """

    def repeated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in _batches(frames):
            shingles, _ = shingle_hashes(piece.body.tolist())
            found, times = np.unique(shingles, return_counts=True)
            often = times >= COMMON_IN_BATCH
            yield pd.DataFrame({"shingle": found[often], "times": times[often]})

    rows = texts.mapInPandas(giving_back(repeated), "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times"))
    top = rows.orderBy(F.desc("times"), "shingle").limit(COMMON).collect()
    top.reverse()
    return np.array([r.shingle for r in top], dtype=np.int64), np.array([r.times for r in top], dtype=np.int64)


def _described(texts: DataFrame, common: np.ndarray, times: np.ndarray) -> DataFrame:
    """Per document: node (hash of its set), set size, bitmaps, prefix and what it shares.

    The latter sums the counts of all its common shingles: the text that a group
    of near copies stems from has most of what they share.
    """
    by_hash = np.argsort(common, kind="stable")
    sorted_common = common[by_hash]
    # most shingles are ruled out by their last bits
    listed = np.zeros(1 << 20, dtype=bool)
    listed[common & (len(listed) - 1)] = True

    def places(shingles: np.ndarray) -> np.ndarray:
        """Place in the list of common shingles, -1 for others."""
        late = np.full(len(shingles), -1, dtype=np.int64)
        maybe = np.flatnonzero(listed[shingles & (len(listed) - 1)])
        if len(maybe):
            at = np.minimum(np.searchsorted(sorted_common, shingles[maybe]), len(sorted_common) - 1)
            late[maybe] = np.where(sorted_common[at] == shingles[maybe], by_hash[at], -1)
        return late

    def prefix(shingles: np.ndarray, late: np.ndarray, reach: int) -> np.ndarray:
        """The part of a set that any linked set must meet: common shingles last."""
        rare = shingles[late < 0]
        if len(rare) >= reach:
            return rare[:reach]
        last = np.flatnonzero(late >= 0)
        return np.concatenate((rare, shingles[last[np.argsort(late[last], kind="stable")]]))[:reach]

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in _batches(frames):
            shingles, owner, sizes = shingle_sets(piece.body.tolist())
            bits = np.zeros((len(piece), BITMAP_LONGS * 64), dtype=bool)
            bits[owner, shingles.view(np.uint64) % np.uint64(BITMAP_LONGS * 64)] = True
            maps = np.packbits(bits, axis=1).view(np.int64)
            node = set_names(shingles, sizes)
            wide = _wide_maps(shingles, sizes)
            late, starts = places(shingles), np.cumsum(sizes) - sizes
            reach = np.where(sizes > 0, sizes - (4 * sizes + 4) // 5 + 1, 0)
            listing = late >= 0
            shares = np.bincount(owner[listing], weights=times[late[listing]], minlength=len(piece)).astype(np.int64)
            yield pd.DataFrame({
                "doc": piece.doc.to_numpy(),
                "node": node,
                "n": sizes,
                "bitmap": list(maps),
                "wide": wide,
                "prefix": [prefix(shingles[s : s + n], late[s : s + n], r) for s, n, r in zip(starts, sizes, reach)],
                "shares": shares,
            })

    return texts.mapInPandas(giving_back(describe), "doc long, node long, n long, bitmap array<long>, wide array<long>, prefix array<long>, shares long")


def _fits(n: str, m: str) -> Column:
    """Sizes that allow a link."""
    return (5 * F.col(n) >= 4 * F.col(m)) & (5 * F.col(m) >= 4 * F.col(n))


def _bitmap_bound(n: str, m: str, a: str, b: str) -> Column:
    """Bits of one set that the other lacks are shingles it lacks: a bound on the overlap."""
    lacks = lambda x, y: sum((F.bit_count(F.col(x)[i].bitwiseAND(F.bitwise_not(F.col(y)[i]))) for i in range(BITMAP_LONGS)), F.lit(0))
    overlap = F.least(F.col(n) - lacks(a, b), F.col(m) - lacks(b, a))
    return OF * overlap >= NEEDED * (F.col(n) + F.col(m))


def _close(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that sizes and bitmaps allow, with the document that stands for each side."""
    side = lambda end: sets.select(
        F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("bitmap").alias(f"map_{end}"), F.col("doc").alias(f"doc_{end}")
    )
    return (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .where(_fits("n_a", "n_b") & _bitmap_bound("n_a", "n_b", "map_a", "map_b")).drop("n_a", "n_b", "map_a", "map_b")
    )


def _within_wide(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that the bitmaps of large sets allow too.

    Sizes that may link give lengths that are equal or one the double of the
    other; the longer one is folded.  Pairs with a small set stay.  Only bitmaps
    of sets in a pair travel.
    """
    ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("wanted")).distinct())
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    large = sets.where("wide is not null").join(ids, F.col("node") == F.col("wanted"), "left_semi")
    side = lambda end: large.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("wide").alias(f"wide_{end}"))

    def folded(own: str, other: str) -> Column:
        length = F.size(other)
        halves = F.transform(F.slice(own, 1, length), lambda x, i: x.bitwiseOR(F.col(own)[i + length]))
        return F.when(F.size(own) > length, halves).otherwise(F.col(own))

    def lacks(own: str, other: str) -> Column:
        bits = F.zip_with(own, other, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
        return F.aggregate(bits, F.lit(0), lambda total, x: total + x)

    overlap = F.least(F.col("n_a") - lacks("even_a", "even_b"), F.col("n_b") - lacks("even_b", "even_a"))
    return (
        pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
        .withColumns({"even_a": folded("wide_a", "wide_b"), "even_b": folded("wide_b", "wide_a")})
        .where(F.col("wide_a").isNull() | F.col("wide_b").isNull() | (OF * overlap >= NEEDED * (F.col("n_a") + F.col("n_b"))))
        .select(*pairs.columns)
    )


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Names (name_a, name_b) of the pairs whose sets link, by exact intersection of sorted arrays.

    The two whole texts of a pair travel, which is less than their hashes.  Ids
    of the documents in question are sent to the scan while they are few, so the
    other texts stay where they are.
    """
    ids = staged(pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("wanted")).distinct())
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    wanted = texts.join(ids, F.col("doc").eqNullSafe(F.col("wanted")), "left_semi")

    def intersect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = []
            for a, b, x, y in zip(frame.a, frame.b, frame.x, frame.y):
                shingles, owner, sizes = shingle_sets([x, y])
                # an id may stand for several texts
                if (set_names(shingles, sizes) == (a, b)).all():
                    x, y = shingles[owner == 0], shingles[owner == 1]
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    good.append(OF * int((y[at] == x).sum()) >= NEEDED * (len(x) + len(y)))
                else:
                    good.append(False)
            yield frame.loc[good, ["name_a", "name_b"]]

    both = pairs.join(wanted.toDF("key_a", "x"), F.col("doc_a").eqNullSafe(F.col("key_a"))).join(
        wanted.toDF("key_b", "y"), F.col("doc_b").eqNullSafe(F.col("key_b"))
    )
    return both.select("a", "b", "x", "y", "name_a", "name_b").mapInPandas(giving_back(intersect), "name_a long, name_b long")


def shingle_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    Sets are distinct 5-word shingles of the text with A-Z in lower case; fewer
    words make one shingle, no word an empty set that links with nothing (its
    component is its own id).  Documents link when 100 * intersection >= 80 *
    union; a component is named by its smallest id.  Null is the empty text, null
    ids are smaller than none, rows that repeat are in one component, an empty
    table gives no rows, other columns are ignored.  No link is lost: rows with
    equal sets are one node, and

    1. two linked sets share a shingle in their prefixes (a fifth of each, in one
       order that puts common shingles last), so nodes meet in the tiles of their
       prefix shingles and size band;
    2. every node is compared with the leader of the tile it most often shares,
       and components of these links are found;
    3. what is left are tiles that hold nodes of different components: pairs
       across components and neighbouring bands that pass the place bound and the
       bitmap bounds (large sets have a wider bitmap).  The exact intersection takes the best pair of every two
       components first, then eight times as many each round, until every pair is
       tested or lies in one component, where it can no longer change the result.
       So groups of copies do not grow with the square of their size.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), whole_text(text_col).alias("body"))
    described = staged(_described(texts, *_common(texts)))
    sets = staged(
        described.where("n > 0").groupBy("node").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), F.first("wide").alias("wide"))
    )
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(BAND))).cast("int")
    met = described.select("node", F.col("n").cast("int").alias("n"), "shares", F.posexplode("prefix").alias("place", "shingle"))
    # the smaller set of a link has the first shared shingle in the first ninth of its order
    same, tile = Window.partitionBy("shingle"), Window.partitionBy("shingle", "band")
    meeting = staged(
        met.withColumn("low", F.min("node").over(same)).withColumn("high", F.max("node").over(same))
        .withColumn("many", F.count("*").over(same)).withColumn("early", F.min(F.expr("9L * place - n")).over(same))
        .where("low <> high and early <= 0")
        .select("shingle", "node", "n", "place", band.alias("band"), "many", "shares").distinct()
    )
    # the text that copies stem from shares most with the others: it leads its tiles
    favour = meeting.groupBy("node").agg(F.struct(F.max("shares"), F.sum("many")).alias("favour"))
    shared = staged(
        meeting.drop("many", "shares").join(favour, "node")
        .withColumn("leader", F.max(F.struct("favour", "node", "n")).over(tile))
        .select("shingle", "node", "n", "place", "band", F.col("leader.node").alias("leader"), F.col("leader.n").alias("leader_n"))
    )
    stars = (
        shared.where((F.col("node") != F.col("leader")) & _fits("n", "leader_n"))
        .groupBy("node", "leader").count()
        .groupBy("node").agg(F.max(F.struct("count", "leader")).alias("most"))
        .select(F.least("node", "most.leader").alias("a"), F.greatest("node", "most.leader").alias("b")).distinct()
    )
    stars = _within_wide(staged(_close(stars, sets)), sets)
    stars = staged(stars.withColumns({"name_a": F.col("a"), "name_b": F.col("b")}))
    roots = components(_linked(stars, texts).toDF("a", "b"))
    named = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("leader", "leader_n")
    open_ = staged(
        named.withColumn("low", F.min("root").over(same)).withColumn("high", F.max("root").over(same))
        .where("low <> high").drop("low", "high").distinct()
    )
    # of a link, the smaller set has the first shared shingle in the first ninth of its order
    one = open_.where("9L * place <= n").select("shingle", F.col("node").alias("a"), "n", F.col("place").alias("i"), F.col("root").alias("root_a"),
                       F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    other = open_.select("shingle", F.col("node").alias("b"), F.col("n").alias("m"), F.col("place").alias("j"), F.col("root").alias("root_b"), "band")
    # at the first shingle they share, what follows bounds the overlap
    follows = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    pairs = (
        one.join(other, ["shingle", "band"])
        .where((F.col("root_a") != F.col("root_b")) & ((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b")))))
        .where(_fits("n", "m") & (OF * follows >= NEEDED * (F.col("n") + F.col("m"))))
        .groupBy("a", "b").count()
    )
    left, most = staged(_within_wide(staged(_close(pairs, sets)), sets)), 1
    while True:
        name = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"name_{end}"))
        across = (
            left.join(name("a"), "a", "left").join(name("b"), "b", "left")
            .withColumns({"name_a": F.coalesce("name_a", "a"), "name_b": F.coalesce("name_b", "b")}).where("name_a <> name_b")
        )
        best = Window.partitionBy(F.least("name_a", "name_b"), F.greatest("name_a", "name_b")).orderBy(F.desc("count"), "a", "b")
        ranked = staged(across.withColumn("nth", F.row_number().over(best)))
        if ranked.isEmpty():
            break
        merged = components(_linked(ranked.where(F.col("nth") <= most), texts).toDF("a", "b"))
        up = merged.toDF("below", "above")
        roots = staged(
            roots.join(up, F.col("root") == F.col("below"), "left").select("node", F.coalesce("above", "root").alias("root"))
            .unionByName(merged.join(roots.select("node"), "node", "left_anti"))
        )
        left, most = ranked.where(F.col("nth") > most).drop("name_a", "name_b", "nth"), most * 8
    member = described.select("doc", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = member.where("n > 0").groupBy("root").agg(F.min("doc").alias("name"))
    names = staged(names)
    return member.join(names, "root", "left").select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc")).alias("component_id"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id, with all columns.

    Rows that share that id all stay.
    """
    groups = shingle_components(docs, id_col, text_col)
    gone = groups.where(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("gone_id")).distinct()
    # whole rows in one column, so that no name of theirs can clash
    rows = docs.select(F.struct(*docs.columns).alias("whole"), F.col(id_col).alias("id"))
    return rows.join(staged(gone), F.col("id").eqNullSafe(F.col("gone_id")), "left_anti").select("whole.*")


@query("op4_shingle_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(table(spark, sf_dir, "documents"))

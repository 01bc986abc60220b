"""Mixing sources to target weights by Sainte-Laguë apportionment of token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.common import WORD, query, table, whole_text
from docquarry.session import staged

WEIGHTS = (5, 2, 1)
#: a source gives its words at most this often
EPOCHS = 3
#: words of a block: this many, fewer where that would give under MIN_BLOCKS blocks
BLOCK_WORDS, MIN_BLOCKS = 32_768, 65_536
SEED = "mix-1"


def word_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """Staged narrow rows: id, source, size in words, place in the seeded order."""
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return staged(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long").alias("size"),
            F.substring(F.md5(F.concat(F.lit(f"{seed}:"), ident).cast("binary")), 1, 16).alias("place"),
        )
    )


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: source, nth, weight, source_size, total, target.

    Sources by code point, null last, take the weights in turn and share all
    words; a target stops at ``epochs`` times its source's size and the excess
    goes to the others by weight.  That is one water level: sources fill up in
    the order of limit per weight, and the level is what is left for each unit
    of weight at the first source that does not fill up.
    """
    one = Window.partitionBy()  # one row per source
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy(F.col("limit") / F.col("weight"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    named = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("nth", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") - 1) % len(weights) + 1))
        .withColumn("limit", F.col("source_size") * epochs)
        .withColumn("total", F.sum("source_size").over(one))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / F.col("open"))
    )
    fits = F.col("level") * F.col("weight") <= F.col("limit")
    return named.withColumn("level", F.min(F.when(fits, F.struct(F.col("limit") / F.col("weight"), "nth", "level"))).over(one)["level"]).select(
        "source", "nth", "weight", "source_size", "total",
        F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")).alias("target"),
        (F.col("limit").cast("double") <= F.col("level") * F.col("weight")).alias("full"),
    )


def block_quotas(
    targets: DataFrame,
    shards: int = 16,
    epochs: int = EPOCHS,
    block_words: int = BLOCK_WORDS,
    min_blocks: int = MIN_BLOCKS,
) -> DataFrame:
    """One row per source and shard: blocks of the source, quota of the shard, total quota.

    The blocks go to sources one by one by the highest quotient target / (2k + 1),
    k being what the source has so far (ties: first source).  The apportionment
    is monotone in the number of blocks, so shard h has the seats between the
    h-th and the next part of all blocks.  Webster's result lies within
    n * share / 2 + 1 of the exact share, so only quotients in that range are
    ranked and what is below is given at once; a source whose target is its
    limit gets every block ``epochs`` times.
    """
    one = Window.partitionBy()
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("total") / min_blocks))).cast("long")
    sized = targets.withColumn("block", block).withColumn(
        "n_blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long")
    )
    share = (
        sized.where("NOT full")
        .withColumn("votes", F.sum("target").over(one))
        .withColumn("seats", F.round(F.col("votes") / F.col("block")).cast("long"))
        .withColumn("n", F.count("*").over(one))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .withColumn("house", F.floor(F.col("seats") * (F.col("shard") + 1) / shards).cast("long"))
        .withColumn("ideal", F.col("house") * F.col("target") / F.col("votes"))
        .withColumn("slack", F.col("n") * F.col("target") / F.col("votes") / 2 + 1.5)
        .withColumn("sure", F.greatest(F.lit(0), F.floor(F.col("ideal") - F.col("slack"))).cast("long"))
        .withColumn("free", F.col("house") - F.sum("sure").over(Window.partitionBy("shard")))
    )
    ranked = share.withColumn(
        "k", F.explode(F.sequence(F.col("sure"), F.ceil(F.col("ideal") + F.col("slack")).cast("long")))
    ).withColumn(
        "rank",
        F.row_number().over(
            Window.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), "nth")
        ),
    )
    seats = ranked.groupBy("source", "nth", "shard", "block", "n_blocks").agg(
        (F.min("sure") + F.sum((F.col("rank") <= F.col("free")).cast("long"))).alias("seats")
    )
    full = (
        sized.where("full")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .select("source", "nth", "shard", "block", "n_blocks", F.floor(F.col("n_blocks") * epochs * (F.col("shard") + 1) / shards).cast("long").alias("seats"))
    )
    by_source = Window.partitionBy("nth").orderBy("shard")
    upper = F.least(F.col("seats"), F.col("n_blocks") * epochs)
    return (
        seats.unionByName(full).withColumn("seats", upper)
        .withColumn("quota", F.col("seats") - F.coalesce(F.lag("seats").over(by_source), F.lit(0)))
        .withColumn("total_quota", F.max("seats").over(Window.partitionBy("nth")))
        .select("source", "nth", "shard", "block", "n_blocks", "quota", "total_quota")
    )


def _picked_below(x: Column) -> Column:
    """Words below place ``x`` of a source that lie in its extra blocks.

    Of n blocks in seeded order the r extra ones are spread evenly from a seeded
    offset: block j is extra when (j * r + offset) / n steps to the next whole number.
    """
    j = F.floor(x / F.col("block"))
    count = lambda i: F.floor((i * F.col("r") + F.col("offset")) / F.col("n_blocks"))
    return F.col("block") * count(j) + (x - j * F.col("block")) * (count(j + 1) - count(j))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    epochs: int = EPOCHS,
    shards: int = 16,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken.

    Documents of a source lie in a seeded order, cut into blocks of equal words.
    ``block_quotas`` says how many blocks the source gives; whole rounds take
    every block, the rest is a seeded, evenly spread choice.  ``taken`` counts
    the words of the document in chosen blocks, repeats counted.  Null texts
    have size 0, a null source is a source, null ids are ordered as one value,
    rows that repeat in full follow each other, an empty table gives no rows.

    Places come from sums per (source, 4,096 seeded parts), so that no task sorts
    a whole source.
    """
    sizes = word_sizes(docs, id_col, text_col, source_col, seed)
    targets = staged(source_targets(sizes, weights, epochs))
    quotas = block_quotas(targets, shards, epochs).where(F.col("shard") == shards - 1)
    name = F.coalesce(F.concat(F.lit(f"{seed}:"), F.col("q.source")), F.lit("null"))
    plan = targets.alias("t").join(quotas.alias("q"), F.col("t.nth") == F.col("q.nth")).select(
        "t.source", "t.source_size", "t.target", "q.block", "q.n_blocks",
        F.expr("CASE WHEN q.n_blocks = 0 THEN 0 ELSE q.total_quota div q.n_blocks END").alias("rounds"),
        F.expr("CASE WHEN q.n_blocks = 0 THEN 0 ELSE q.total_quota % q.n_blocks END").alias("r"),
        F.when(F.col("q.n_blocks") > 0, F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % F.col("q.n_blocks")).otherwise(0).alias("offset"),
    )
    part = F.substring("place", 1, 3)
    parts = sizes.groupBy("source", part.alias("part")).agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words")
    parts = parts.alias("p").join(plan.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select(
        F.col("p.source").alias("of"), "part", "ahead", "source_size", "target", "block", "n_blocks", "rounds", "r", "offset"
    )
    parts = staged(parts)
    within = Window.partitionBy("source", "in_part").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        sizes.withColumn("in_part", part)
        .withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(parts, F.col("source").eqNullSafe(F.col("of")) & (F.col("in_part") == F.col("part")))
        .withColumn("from", F.col("ahead") + F.col("inside"))
    )
    extra = _picked_below(F.col("from") + F.col("size")) - _picked_below(F.col("from"))
    taken = F.col("rounds") * F.col("size") + F.when(F.col("n_blocks") > 0, extra).otherwise(0)
    return rows.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        taken.cast("long").alias("taken"), "place",
    )


def mixed_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as whole documents: each row as often as it is taken, all columns kept.

    A document taken for 1.4 times its words appears once or twice, by a seeded
    number; in the mean a source gives its target.  Rows that share id, source
    and size appear equally often, and documents without words are left out.
    """
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    chance = F.conv(F.substring("place", 9, 8), 16, 10).cast("double") / 4294967296.0
    times = F.floor(F.col("taken") / F.col("size") + chance).cast("int")
    wanted = (
        taken.where("size > 0").groupBy(F.col(id_col).alias("mix_id"), F.col(source_col).alias("mix_source"), F.col("size").alias("mix_size"))
        .agg(F.max(times).alias("mix_times")).where("mix_times > 0")
    )
    size = F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long")
    # whole rows in one column, so that no name of theirs can clash
    rows = docs.select(F.struct(*docs.columns).alias("whole"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))
    found = rows.join(
        wanted,
        F.col("id").eqNullSafe(F.col("mix_id")) & F.col("source").eqNullSafe(F.col("mix_source")) & (F.col("size") == F.col("mix_size")),
    )
    return found.select("whole", F.explode(F.sequence(F.lit(1), F.col("mix_times")))).select("whole.*")


ORACLE = f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 16) AS place
  FROM documents),
named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth
  FROM sizes GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][(nth - 1) % 3 + 1] AS weight, 3 * source_size AS lim, CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM named),
levels AS (
  SELECT *, (total - coalesce(CAST(sum(lim) OVER ahead AS BIGINT), 0))
    / (CAST(sum(weight) OVER () AS BIGINT) - coalesce(CAST(sum(weight) OVER ahead AS BIGINT), 0)) AS own_level
  FROM weighed
  WINDOW ahead AS (ORDER BY lim / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT own_level AS level FROM levels WHERE own_level * weight <= lim ORDER BY lim / weight, nth LIMIT 1),
targets AS (
  SELECT l.*, least(CAST(lim AS DOUBLE), level * weight) AS target, lim <= level * weight AS is_full,
    greatest(1, least({BLOCK_WORDS}, total // {MIN_BLOCKS})) AS block
  FROM levels l, level),
blocks AS (
  SELECT *, CAST(ceil(source_size / block) AS BIGINT) AS n_blocks,
    (SELECT sum(target) FROM targets WHERE NOT is_full) AS votes,
    (SELECT count(*) FROM targets WHERE NOT is_full) AS n
  FROM targets),
share AS (
  SELECT *, CAST(round(votes / block) AS BIGINT) AS house,
    greatest(0, CAST(floor(round(votes / block) * target / votes - (n * target / votes / 2 + 1.5)) AS BIGINT)) AS sure,
    CAST(ceil(round(votes / block) * target / votes + (n * target / votes / 2 + 1.5)) AS BIGINT) AS top
  FROM blocks WHERE NOT is_full),
quotients AS (
  SELECT nth, sure, house, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, nth) AS place
  FROM (SELECT *, unnest(generate_series(sure, top)) AS k FROM share)),
seats AS (
  SELECT nth, any_value(sure) + count(*) FILTER (
    place <= house - (SELECT sum(sure) FROM share)) AS seats
  FROM quotients GROUP BY nth),
plan AS (
  SELECT b.*, CASE WHEN is_full THEN 3 * n_blocks ELSE least(coalesce(seats, 0), 3 * n_blocks) END AS quota,
    CASE WHEN n_blocks > 0 THEN CAST('0x' || substr(md5(coalesce('{SEED}:' || source, 'null')), 1, 8) AS BIGINT) % n_blocks ELSE 0 END AS start
  FROM blocks b LEFT JOIN seats USING (nth)),
placed AS (
  SELECT s.doc_id, s.size, p.*, CASE WHEN n_blocks > 0 THEN quota // n_blocks ELSE 0 END AS rounds,
    CASE WHEN n_blocks > 0 THEN quota % n_blocks ELSE 0 END AS r, greatest(n_blocks, 1) AS nb,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY place, s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x
  FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, size, source_size, target, CAST(rounds * size
    + block * (((x + size) // block * r + start) // nb)
    + ((x + size) % block) * ((((x + size) // block + 1) * r + start) // nb - ((x + size) // block * r + start) // nb)
    - block * ((x // block * r + start) // nb)
    - (x % block) * (((x // block + 1) * r + start) // nb - (x // block * r + start) // nb) AS BIGINT) AS taken
FROM placed
"""


@query("op9_mix", ORACLE)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("place")

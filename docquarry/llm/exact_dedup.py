"""Exact duplicate groups by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import query, table, whole_text
from docquarry.session import staged

#: characters hashed in the second round
PREFIX_CHARS = 256
#: keys of repeated (length, prefix) pairs that are broadcast, 16 bytes each
BROADCAST_KEYS = 500_000


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    broadcast_keys: int = BROADCAST_KEYS,
    digest_all: bool = False,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest (binary SHA-256).

    Texts are equal when identical; null is the empty text.  The row with the
    largest id stays; a null id is smaller than any other, and of rows that
    repeat both id and text one stays.  An empty table gives no rows; other
    columns are ignored, whatever their names.

    Round 1 counts byte lengths, round 2 counts (length, prefix hash) among
    repeated lengths; both move narrow rows only.  Round 3 hashes the whole
    content of rows whose pair repeats.  While the repeated pairs are at most
    ``broadcast_keys`` they are sent to the scan, so the other texts are not
    hashed; beyond, every text is hashed in the scan and only digests move.
    ``digest`` is null where rounds 1 and 2 decided, unless ``digest_all``.
    """
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("body"))
    keyed = texts.withColumns({
        "n_bytes": F.octet_length("body"),
        "prefix": F.xxhash64(F.substring("body", 1, prefix_chars)),
    })
    sketch = staged(keyed.select("n_bytes", "prefix"))
    lengths = sketch.groupBy("n_bytes").count().where("count > 1").select("n_bytes")
    pairs = staged(
        sketch.groupBy("n_bytes", "prefix").count()  # before the join: a hot pair is one row
        .join(lengths, "n_bytes", "left_semi").where("count > 1")
        .select("n_bytes", "prefix", F.lit(True).alias("open"))
    )
    digest = F.unhex(F.sha2(F.col("body").cast("binary"), 256))
    if pairs.count() <= broadcast_keys:
        marked = keyed.join(F.broadcast(pairs), ["n_bytes", "prefix"], "left").withColumn(
            "digest", digest if digest_all else F.when(F.col("open"), digest)
        )
    else:
        marked = keyed.withColumn("digest", digest).drop("body").join(pairs, ["n_bytes", "prefix"], "left")
        if not digest_all:
            marked = marked.withColumn("digest", F.when(F.col("open"), F.col("digest")))
    hashed = staged(marked.select("id", "digest", F.coalesce("open", F.lit(False)).alias("open")))

    candidates = hashed.where("open")
    groups = staged(
        candidates.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )
    # rows that repeat id and text are told apart by a counter
    repeated = candidates.groupBy("id", "digest").agg(F.count("*").alias("times"))
    copies = repeated.join(groups, "digest", "left").select(
        "id", "digest",
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth"),
    )
    alone = hashed.where("NOT open").select(
        "id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(1).alias("nth")
    )
    return alone.unionByName(copies).select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        "digest",
    )


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_keys: int = BROADCAST_KEYS
) -> DataFrame:
    """The documents that stay, with all their columns.

    Only the dropped rows of surviving groups are listed, as id and digest, and
    taken out of the scan.  Up to ``broadcast_keys`` of them are sent to it: then
    no text moves, and only texts under a listed id are hashed again.  Beyond,
    every text is hashed in the scan and rows are shuffled once by id and digest.
    Null texts are empty texts, null ids are ids like any other; of rows that
    repeat id and text one stays, whichever its other columns; an empty table
    stays empty.  Other columns pass through, whatever their names.
    """
    groups = exact_groups(docs, id_col, text_col, broadcast_keys=broadcast_keys)
    dropped = staged(
        groups.where("NOT kept").select(
            F.col(id_col).alias("mark_id"), F.col("digest").alias("mark_digest"),
            (~F.col(id_col).eqNullSafe(F.col("keep_id"))).alias("gone"),
        ).distinct()
    )
    listed, repeats = dropped.agg(F.count("*"), F.count_if(~F.col("gone"))).head()
    # whole rows in one column, so that no name of theirs can clash
    rows = docs.select(F.struct(*docs.columns).alias("whole"), F.col(id_col).alias("id"))
    digest = F.unhex(F.sha2(F.coalesce(F.col("whole").getField(text_col), F.lit("")).cast("binary"), 256))
    if listed <= broadcast_keys:
        ids = F.broadcast(dropped.select(F.col("mark_id").alias("open_id"), F.lit(True).alias("open")).distinct())
        opened = rows.join(ids, F.col("id").eqNullSafe(F.col("open_id")), "left")
        hashed, marks = opened.withColumn("digest", F.when(F.col("open"), digest)), F.broadcast(dropped)
    else:
        hashed, marks = rows.withColumn("digest", digest), dropped
    same = F.col("id").eqNullSafe(F.col("mark_id")) & (F.col("digest") == F.col("mark_digest"))
    found = hashed.join(marks, same, "left").select("whole", "id", "digest", "gone")
    staying = found.where("gone IS NULL").select("whole.*")
    if repeats == 0:
        return staying
    # rows that stay and repeat id and text in full
    return staying.union(found.where("NOT gone").dropDuplicates(["id", "digest"]).select("whole.*"))


@query(
    "op3_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
      row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
      sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_groups(table(spark, sf_dir, "documents"), digest_all=True)
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))

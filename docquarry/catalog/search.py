"""Registered vector, ranking, fusion and pattern searches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docquarry.catalog.corpus import derived, query_vector, table, with_tables
from docquarry.catalog.registry import query
from docquarry.functions import text, vectors
from docquarry.operators import pivots, search, trigrams
from docquarry.plans.spread import spread
from docquarry.session import shared_dir

DISTANCE = """sqrt(list_sum(list_transform(range(1, len({t}.embedding) + 1),
  lambda j: pow(CAST({t}.embedding[j] AS DOUBLE) - CAST(q.embedding[j] AS DOUBLE), 2))))"""
QUERY = "(SELECT embedding FROM embeddings WHERE vec_id = 0) q"
MEASURED = f"measured AS MATERIALIZED (SELECT i.*, {DISTANCE.format(t='i')} AS distance FROM items i, {QUERY} WHERE i.embedding IS NOT NULL)"
SCORE = """greatest(0.0, least(1.0, 0.6 * (1 - distance) + 0.15 * ((1 - distance) * CASE item_type
    WHEN 'function' THEN 1.2 WHEN 'trait' THEN 1.15 WHEN 'struct' THEN 1.1 WHEN 'trait_impl' THEN 1.1
    WHEN 'module' THEN 0.9 ELSE 1.0 END) + 0.1 * least(1.0, coalesce(length(content), 0) / 1000.0)
    + 0.15 * CASE WHEN coalesce(examples, '') <> '' THEN 1.2 ELSE 1.0 END))"""


def _oracle(*ctes: str, final: str, tables: str = "items") -> str:
    return with_tables(tables, "WITH " + ", ".join([MEASURED, *ctes]) + " " + final)


@query(
    "knn1_nearest",
    f"""SELECT e.vec_id AS vec_id, round({DISTANCE.format(t='e')}, 6) AS distance
    FROM embeddings e, {QUERY} ORDER BY {DISTANCE.format(t='e')}, vec_id LIMIT 10""",
)
def knn1_nearest(spark, sf_dir):
    vectors_table = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    near = search.nearest(vectors_table, query_vector(spark, sf_dir), 10)
    return near.select(F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


@query(
    "knn1_pruned",
    f"""SELECT e.vec_id AS vec_id, round({DISTANCE.format(t='e')}, 6) AS distance
    FROM embeddings e, {QUERY} ORDER BY {DISTANCE.format(t='e')}, vec_id LIMIT 10""",
)
def knn1_pruned(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    layout = pivots.PivotLayout.write(rows, f"{shared_dir(spark)}/pivots-{uuid.uuid4().hex}")
    near = layout.nearest(query_vector(spark, sf_dir), 10)
    return near.select(F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


FILTERS = dict(item_type="function", crate="en", min_doc_length=200)
FILTER_SQL = "item_type = 'function' AND starts_with(item_path, 'en::') AND length(content) >= 200"


@query(
    "knn1_filtered_before",
    _oracle(
        f"near AS (SELECT * FROM measured WHERE {FILTER_SQL} ORDER BY distance, id LIMIT 15)",
        final=f"SELECT id, item_path, round(distance, 6) AS distance, round({SCORE}, 6) AS score FROM near",
    ),
)
def knn1_filtered_before(spark, sf_dir):
    items = derived(spark, sf_dir, "items")
    out = search.candidates(items, query_vector(spark, sf_dir), 5, "pre", **FILTERS)
    return out.select("id", "item_path", _r("distance"), _r("score"))


@query(
    "knn1_filtered_after",
    _oracle(
        "near AS (SELECT * FROM measured ORDER BY distance, id LIMIT 30)",
        final=f"""SELECT id, item_path, round(distance, 6) AS distance, round({SCORE}, 6) AS score
        FROM near WHERE {FILTER_SQL}""",
    ),
)
def knn1_filtered_after(spark, sf_dir):
    items = derived(spark, sf_dir, "items")
    out = search.candidates(items, query_vector(spark, sf_dir), 20, "post", **FILTERS)
    return out.select("id", "item_path", _r("distance"), _r("score"))


@query(
    "knn1_late_read",
    _oracle(
        final="""SELECT id, item_path, length(content) AS doc_length, round(distance, 6) AS distance
        FROM measured ORDER BY measured.distance, id LIMIT 15"""
    ),
)
def knn1_late_read(spark, sf_dir):
    out = search.nearest_late(derived(spark, sf_dir, "items"), query_vector(spark, sf_dir), 15)
    return out.select("id", "item_path", F.length("content").cast("bigint").alias("doc_length"), _r("distance"))


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


NEAR15 = "near AS (SELECT * FROM measured ORDER BY distance, id LIMIT 15)"
SCORED = f"scored AS (SELECT *, {SCORE} AS score FROM near)"


@query(
    "rnk1_composite_score",
    _oracle(
        NEAR15,
        SCORED,
        final="""SELECT item_path, item_type, round(score, 6) AS score FROM scored
        ORDER BY scored.score DESC, distance, id LIMIT 5""",
    ),
)
def rnk1_composite_score(spark, sf_dir):
    found = search.candidates(derived(spark, sf_dir, "items"), query_vector(spark, sf_dir), 5)
    return search.ranked(found, 5).select("item_path", "item_type", _r("score"))


@query(
    "rnk1_score_all_items",
    _oracle(
        f"scored AS (SELECT *, {SCORE} AS score FROM measured)",
        final="""SELECT item_type, count(*) AS n, round(avg(score), 6) AS mean_score,
        round(max(score), 6) AS best_score FROM scored GROUP BY item_type""",
    ),
)
def rnk1_score_all_items(spark, sf_dir):
    items = derived(spark, sf_dir, "items").where("embedding IS NOT NULL")
    distance = vectors.l2_distance("embedding", query_vector(spark, sf_dir))
    scored = items.withColumn("score", search.composite_score(distance))
    return scored.groupBy("item_type").agg(
        F.count("*").alias("n"),
        F.round(F.avg("score"), 6).alias("mean_score"),
        F.round(F.max("score"), 6).alias("best_score"),
    )


COSINE = """list_sum(list_transform(range(1, len(c.embedding) + 1),
    lambda j: CAST(c.embedding[j] AS DOUBLE) * CAST(s.embedding[j] AS DOUBLE)))
  / (sqrt(list_sum(list_transform(c.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))
   * sqrt(list_sum(list_transform(s.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))))"""


def _diversify_sql(k: int, by: str = "") -> list[str]:
    """One CTE per pick, from ``cand`` with ``pos`` by relevance."""
    part = f"PARTITION BY {by}" if by else ""
    key = f"c.{by} = s.{by} AND " if by else ""
    name = by or "1"
    out = ["pick1 AS MATERIALIZED (SELECT cand.*, 1 AS position FROM cand WHERE pos = 1)"]
    for step in range(2, k + 1):
        out.append(
            f"""pick{step} AS MATERIALIZED (SELECT * FROM pick{step - 1} UNION ALL
            SELECT * EXCLUDE (gain, turn), {step} AS position FROM (
              SELECT g.*, row_number() OVER ({part} ORDER BY gain DESC, pos) AS turn FROM (
                SELECT c.*, 0.6 * c.score + 0.4 * (1 - greatest(0, m.closest)) AS gain FROM cand c JOIN (
                  SELECT c.id AS cid, max({COSINE}) AS closest FROM cand c JOIN pick{step - 1} s
                  ON {key} c.id <> s.id GROUP BY c.id) m ON m.cid = c.id
                WHERE c.id NOT IN (SELECT id FROM pick{step - 1})) g) WHERE turn = 1)"""
        )
    return out


CAND = "cand AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, distance, id) AS pos FROM scored)"


@query(
    "mmr1_diversify",
    _oracle(
        NEAR15,
        SCORED,
        CAND,
        *_diversify_sql(5),
        final="SELECT position, item_path, round(score, 6) AS score FROM pick5",
    ),
)
def mmr1_diversify(spark, sf_dir):
    found = search.candidates(derived(spark, sf_dir, "items"), query_vector(spark, sf_dir), 5)
    return search.diversify(found, 5).select("position", "item_path", _r("score"))


@query(
    "search_items",
    _oracle(
        "near AS (SELECT * FROM measured WHERE visibility = 'public' ORDER BY distance, id LIMIT 13)",
        SCORED,
        CAND,
        *_diversify_sql(3),
        final="SELECT position, item_path, header, item_type, round(score, 6) AS score FROM pick3",
    ),
)
def search_items(spark, sf_dir):
    items = derived(spark, sf_dir, "items")
    out = search.search(items, query_vector(spark, sf_dir), 3, visibility="public")
    return out.select("position", "item_path", "header", "item_type", _r("score"))


@query(
    "knn2_see_also",
    _oracle(
        NEAR15,
        SCORED,
        "top AS (SELECT * FROM scored ORDER BY score DESC, distance, id LIMIT 3)",
        "wide AS (SELECT * FROM measured ORDER BY distance, id LIMIT 20)",
        final="""SELECT item_path, item_type, round(distance, 6) AS distance FROM wide
        WHERE 1 - wide.distance >= -0.5 AND item_path NOT IN (SELECT item_path FROM top)
        ORDER BY wide.distance, id LIMIT 5""",
    ),
)
def knn2_see_also(spark, sf_dir):
    # random vectors are far apart, so the threshold is lowered to keep rows
    items, vector = derived(spark, sf_dir, "items"), query_vector(spark, sf_dir)
    top = search.ranked(search.candidates(items, vector, 5), 3)
    out = search.see_also(items, vector, top, k=20, threshold=-0.5)
    return out.select("item_path", "item_type", _r("distance"))


EXAMPLE_MEASURED = (
    f"measured AS (SELECT i.*, {DISTANCE.format(t='i')} AS distance FROM example_items i, {QUERY})"
)


@query(
    "knn3_search_examples",
    with_tables(
        "example_items",
        f"""WITH {EXAMPLE_MEASURED},
        near AS (SELECT * FROM measured WHERE language = 'rust' ORDER BY distance, id LIMIT 15),
        keyed AS (SELECT *, substr(sha256(language || ':' || example_text), 1, 16) AS example_hash FROM near),
        firsts AS (SELECT *, row_number() OVER (PARTITION BY example_hash ORDER BY distance, id) AS turn FROM keyed)
        SELECT item_path, example_text, language, round(1 - distance, 6) AS score FROM firsts
        WHERE turn = 1 ORDER BY distance, id LIMIT 10""",
    ),
)
def knn3_search_examples(spark, sf_dir):
    from docquarry.functions.code import example_hash

    examples = derived(spark, sf_dir, "example_items").withColumn(
        "example_hash", example_hash(F.col("example_text"), F.col("language"))
    )
    out = search.search_examples(examples, query_vector(spark, sf_dir), 10, language="rust")
    return out.select("item_path", "example_text", "language", _r("score"))


@query(
    "knn4_item_examples",
    _oracle(
        "near AS (SELECT * FROM measured WHERE examples IS NOT NULL ORDER BY distance, id LIMIT 24)",
        """single AS (SELECT id, item_path, distance, n,
          CASE WHEN json_type(examples, '$[' || n || ']') = 'VARCHAR' THEN json_extract_string(examples, '$[' || n || ']')
            ELSE json_extract_string(examples, '$[' || n || '].code') END AS code,
          coalesce(json_extract_string(examples, '$[' || n || '].language'), 'rust') AS language
          FROM (SELECT *, unnest(range(CAST(json_array_length(examples) AS BIGINT))) AS n FROM near))""",
        """firsts AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY distance, id, n) AS turn
          FROM single WHERE language = 'rust')""",
        final="""SELECT item_path, code, round(1 / (1 + distance), 6) AS score FROM firsts WHERE turn = 1
        ORDER BY distance, id, n LIMIT 8""",
    ),
)
def knn4_item_examples(spark, sf_dir):
    out = search.search_item_examples(
        derived(spark, sf_dir, "items"), query_vector(spark, sf_dir), 8, language="rust"
    )
    return out.select("item_path", "code", _r("score"))


REGEX = "(th|en)[a-z]*ing"
REGEX_HITS = f"""hits AS (SELECT *, CASE
  WHEN regexp_matches(item_path, '(?i){{p}}') AND regexp_extract(item_path, '(?i){{p}}') = item_path THEN CAST(1.5 AS DOUBLE)
  WHEN regexp_matches(item_path, '(?i){{p}}') THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END AS score
  FROM items WHERE regexp_matches(item_path, '(?i){{p}}') OR regexp_matches(content, '(?i){{p}}'))"""


@query(
    "rex1_regex_search",
    with_tables(
        "items",
        "WITH "
        + REGEX_HITS.format(p="src1?7::doc_[0-9]*7|stupid")
        + "SELECT id, item_path, score FROM hits ORDER BY score DESC, id LIMIT 20",
    ),
)
def rex1_regex_search(spark, sf_dir):
    out = search.regex_search(derived(spark, sf_dir, "items"), "src1?7::doc_[0-9]*7|stupid", 20)
    return out.select("id", "item_path", "score")


@query(
    "rex1_trigram_search",
    with_tables(
        "items",
        "WITH "
        + REGEX_HITS.format(p="src1?7::doc_[0-9]*7|stupid")
        + "SELECT id, item_path, score FROM hits ORDER BY score DESC, id LIMIT 20",
    ),
)
def rex1_trigram_search(spark, sf_dir):
    items = derived(spark, sf_dir, "items")
    index = trigrams.TrigramIndex.write(items, f"{shared_dir(spark)}/trigrams-{uuid.uuid4().hex}")
    return index.search(items, "src1?7::doc_[0-9]*7|stupid", 20).select("id", "item_path", "score")


@query(
    "rex1_first_hits",
    with_tables(
        "items",
        "WITH "
        + REGEX_HITS.format(p=REGEX)
        + """, firsts AS (SELECT * FROM hits WHERE examples IS NULL ORDER BY id LIMIT 10)
        SELECT id, item_path, score FROM firsts""",
    ),
)
def rex1_first_hits(spark, sf_dir):
    items = derived(spark, sf_dir, "items")
    out = search.regex_search(items, REGEX, 10, first_hits=True, has_examples=False)
    return out.select("id", "item_path", "score")


CRATES = ["en", "de", "fr", "es"]
PER_CRATE = """near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY crate ORDER BY distance, id) AS rn
  FROM measured) WHERE rn <= 20)"""
CRATE_CAND = """cand AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY crate ORDER BY score DESC, distance, id) AS pos
  FROM scored)"""


def _fused(source: str, position: str) -> str:
    return f"""SELECT item_path, round(sum(1.0 / (60 + {position})), 6) AS score FROM {source}
    GROUP BY item_path ORDER BY sum(1.0 / (60 + {position})) DESC,
    min(array_position(['en', 'de', 'fr', 'es'], crate)), item_path LIMIT 5"""


@query(
    "rrf1_cross_crate",
    _oracle(PER_CRATE, SCORED, CRATE_CAND, *_diversify_sql(10, "crate"), final=_fused("pick10", "position")),
)
def rrf1_cross_crate(spark, sf_dir):
    items = derived(spark, sf_dir, "items")
    out = search.cross_crate_search(items, query_vector(spark, sf_dir), CRATES, 5)
    return out.select("item_path", _r("score"))


@query(
    "rrf1_ranked_only",
    _oracle(PER_CRATE, SCORED, CRATE_CAND, "top AS (SELECT * FROM cand WHERE pos <= 10)", final=_fused("top", "pos")),
)
def rrf1_ranked_only(spark, sf_dir):
    items = derived(spark, sf_dir, "items")
    out = search.cross_crate_search(items, query_vector(spark, sf_dir), CRATES, 5, diverse=False)
    return out.select("item_path", _r("score"))


@query(
    "mth1_vector_measures",
    f"""SELECT e.label AS label, count(*) AS n, round(avg({DISTANCE.format(t='e')}), 6) AS mean_l2,
      round(max({COSINE.replace('c.', 'e.').replace('s.', 'q.')}), 6) AS best_cosine,
      round(avg(ln(1 + e.vec_id)), 6) AS mean_ln, round(avg(log10(1 + e.vec_id)), 6) AS mean_log10
    FROM embeddings e, {QUERY} GROUP BY e.label""",
)
def mth1_vector_measures(spark, sf_dir):
    vector = query_vector(spark, sf_dir)
    rows = table(spark, sf_dir, "embeddings")
    return rows.groupBy("label").agg(
        F.count("*").alias("n"),
        F.round(F.avg(vectors.l2_distance("embedding", vector)), 6).alias("mean_l2"),
        F.round(F.max(vectors.cosine_similarity("embedding", vector)), 6).alias("best_cosine"),
        F.round(F.avg(F.ln(1 + F.col("vec_id"))), 6).alias("mean_ln"),
        F.round(F.avg(F.log10(1 + F.col("vec_id"))), 6).alias("mean_log10"),
    )


# a sentence or word adds two characters at least, so the first 250 decide
SNIPPET = r"""
cut AS (SELECT id, content,
  string_split_regex(content, '[.!?]\s+') AS sents,
  string_split_regex(trim(regexp_replace(content, '\s+', ' ', 'g')), ' ') AS words FROM pages_of_text),
sent_steps AS (SELECT id, i, array_to_string(sents[1:i], '. ') || CASE WHEN i < len(sents) THEN '. ' ELSE '' END AS t
  FROM (SELECT *, unnest(range(1, least(len(sents), 250) + 1)) AS i FROM cut)),
by_sent AS (SELECT id, arg_min(t, i) AS t FROM sent_steps WHERE length(t) >= 200 GROUP BY id),
word_steps AS (SELECT id, i, array_to_string(words[1:i], ' ') AS t, array_to_string(words[1:i-1], ' ') AS before
  FROM (SELECT *, unnest(range(1, least(len(words), 400) + 1)) AS i FROM cut)),
by_word AS (SELECT id, arg_min(t, i) AS t, arg_min(before, i) AS before FROM word_steps WHERE length(t) >= 300 GROUP BY id)
SELECT c.id AS id, CASE WHEN length(c.content) <= 400 THEN c.content
  WHEN s.t IS NOT NULL AND length(s.t) <= 400 THEN trim(s.t)
  WHEN w.t IS NOT NULL AND length(w.t) + 3 <= 400 THEN w.t || '...'
  WHEN w.t IS NOT NULL AND w.before <> '' THEN w.before || '...'
  WHEN w.t IS NULL AND length(array_to_string(c.words, ' ')) >= 200 THEN array_to_string(c.words, ' ')
  ELSE substr(c.content, 1, 400) || '...' END AS snippet
FROM cut c LEFT JOIN by_sent s ON s.id = c.id LEFT JOIN by_word w ON w.id = c.id
"""


@query("snp1_snippet", with_tables("pages_of_text", "WITH " + SNIPPET.strip()))
def snp1_snippet(spark, sf_dir):
    docs = spread(derived(spark, sf_dir, "pages_of_text"))
    return docs.select("id", text.snippet(F.col("content")).alias("snippet"))

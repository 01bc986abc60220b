"""Personal data: base patterns, high-recall candidates and boosted trees that select among them."""

from __future__ import annotations

import functools

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import query, table, whole_text
from docquarry.session import staged

KINDS = ("email", "ip", "card", "phone")
#: fixed values: the base patterns.  A match can only begin where a run of its first
#: class begins or the last match ended, so the guards before them change no match
#: but keep long runs linear; nothing after a run can be given back, so runs are possessive.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: what a text must hold before a pattern is tried
NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": "[+]"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: generators that also propose written-out, unmarked, overlong or misformed spans
WIDE = {
    "email": r"[A-Za-z0-9._%+-]{1,64} ?(?:@|[(\[]at[)\]]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{1,63}){0,8}",
    "ip": r"(?<![0-9])[0-9]{1,4}(?: ?[.:] ?[0-9]{1,4}){3,7}",
    "card": r"(?<![0-9])[0-9](?:[ .-]{0,2}[0-9]){10,19}",
    "phone": r"[+(]?[0-9][0-9 ().-]{6,22}[0-9]",
}
#: words near a span that speak for it
CUES = "mail|contact|write|phone|tel|call|fax|mobile|card|visa|pay|account|ip|server|host|address"
CONTEXT = 24
#: words of each kind that speak for it when no digit stands between
OWN_CUES = {"email": "mail|contact|write", "ip": "ip|server|host|address", "card": "card|visa|pay|account", "phone": "phone|tel|call|fax|mobile"}
#: the part of a proposed span before the end of a sentence, if that part is a whole one
WHOLE = {
    "email": r"^(.*?(?:@|[(\[]at[)\]]) ?[A-Za-z0-9-]+(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]+)*?(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z]{2,12})\. .*$",
    "ip": r"^([0-9]{1,4}(?: ?[.:] ?[0-9]{1,4}){3})\. .*$",
    "card": r"^([0-9](?:[ .-]{0,2}[0-9]){11,18}?)\. .*$",
    "phone": r"^([+(]?[0-9](?:[ ().-]*[0-9]){8,14}?)\. .*$",
}
#: usual ways to write each kind, which need no word that speaks for them
SHAPES = {
    "email": r"^[^ @]+(?: @ |@| ?[(\[]at[)\]] ?)[^ @]",
    "ip": r"^[0-9.]+$|^(?:[^0-9]*[0-9]){7}",
    "card": r"^[0-9]+$|^[0-9]{4}([ .-]{1,2})[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$|^[0-9]{4}([ .-]{1,2})[0-9]{6}\2[0-9]{4,5}$",
    "phone": r"^\+|^(?:00?1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$|^00[1-9][0-9]{0,2}[ .-]",
}
#: candidates the trees are fitted on, at most; trees and their depth
FIT_ROWS, TREES, DEPTH = 4_000, 10, 3
#: wanted precision of what the trees add, measured on all candidates
PRECISION = 0.995
#: steps of the scores
STEPS = 10_000
#: matches that are placed together
BLOCK = 256
#: code points of a cell of a text; only spans that share one are compared
CELL = 512


def _matches(text: Column, pattern: str, needs: str) -> Column:
    """Array of (start, end, hit) of the leftmost matches, in code points, end exclusive.

    The pieces between the matches give the starts.  Matches are placed inside
    blocks of ``BLOCK`` first and the blocks then moved by what lies before them,
    as every step of a fold copies what it has so far.
    """
    empty = F.expr("CAST(array() AS array<struct<start:int,end:int,hit:string>>)")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(F.split(text, pattern, -1), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))

    def place(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        end = start + F.length(x["hit"])
        found = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"))
        return F.struct(F.concat(done["found"], F.array(found)).alias("found"), end.alias("at"))

    def blocks(x: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int"))
        none = F.struct(empty.alias("found"), F.lit(0).alias("at"))
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(x, b * BLOCK + 1, F.lit(BLOCK)), none, place))

    def move(done: Column, block: Column) -> Column:
        moved = F.transform(block["found"], lambda m: F.struct(
            (m["start"] + done["at"]).alias("start"), (m["end"] + done["at"]).alias("end"), m["hit"].alias("hit")))
        return F.struct(F.concat(done["found"], F.array(moved)).alias("found"), (done["at"] + block["at"]).alias("at"))

    nothing = F.struct(F.expr("CAST(array() AS array<array<struct<start:int,end:int,hit:string>>>)").alias("found"), F.lit(0).alias("at"))
    # an array of one element binds its value, which is then computed once
    matched = F.array(F.filter(both, lambda x: x["hit"].isNotNull()))
    placed = F.transform(matched, lambda x: F.aggregate(blocks(x), nothing, move, lambda done: F.flatten(done["found"])))
    return F.when(text.rlike(needs), F.get(placed, F.lit(0))).otherwise(empty)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The check sum of a card number: every second digit from the right is doubled."""
    n = F.length(digits)
    worth = lambda d, i: F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + worth(F.substring(digits, i, F.lit(1)).cast("int"), i))
    return F.when(n > 0, total % 10 == 0).otherwise(False)


def _holds(kind: str, hit: Column) -> Column:
    """The check of a base match."""
    n = F.length(_digits(hit))
    return {
        "email": F.lit(True),
        "ip": hit.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"),
        "card": F.when(n.between(12, 19), _luhn(_digits(hit))).otherwise(False),
        "phone": n.between(9, 15),
    }[kind]


def base_spans(text: Column, kind: str) -> Column:
    """Base spans of one kind; matches that fail its check are dropped."""
    return F.filter(_matches(text, BASE[kind], NEEDS[kind]), lambda m: _holds(kind, m["hit"]))


def _plain(hit: Column) -> Column:
    """A span with its written-out marks as marks and without blanks."""
    marked = F.regexp_replace(F.regexp_replace(hit, r"[(\[]at[)\]]", "@"), r"[(\[]dot[)\]]", ".")
    return F.replace(marked, F.lit(" "), F.lit(""))


def _checked(kind: str, hit: Column) -> Column:
    """The check of a span of any writing, on its plain form or its digits."""
    plain, digits = _plain(hit), _digits(hit)
    return {
        "email": plain.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,12}$"),
        "ip": plain.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": F.when(F.length(digits).between(13, 19), digits.rlike("^[2-6]") & _luhn(digits)).otherwise(False),
        "phone": F.length(digits).between(9, 15),
    }[kind]


def _of_kind(make) -> Column:
    """What ``make`` gives for the name of the row's kind."""
    return F.coalesce(*[F.when(F.col("kind") == i, make(k)) for i, k in enumerate(KINDS)])


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind."""
    names = F.array(*map(F.lit, KINDS))
    rows = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.concat_ws(",", rows)


def _features() -> dict[str, Column]:
    hit, before, after = F.col("hit"), F.col("before"), F.col("after")
    digits = _digits(hit)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return {
        **{f"is_{k}": flag(F.col("kind") == i) for i, k in enumerate(KINDS)},
        "length": F.length(hit).cast("double"),
        "n_digits": F.length(digits).cast("double"),
        "n_letters": F.length(F.regexp_replace(hit, "[^A-Za-z]", "")).cast("double"),
        "n_marks": F.length(F.regexp_replace(hit, "[A-Za-z0-9 ]", "")).cast("double"),
        "n_blanks": F.length(F.regexp_replace(hit, "[^ ]", "")).cast("double"),
        "n_dots": F.length(F.regexp_replace(hit, "[^.]", "")).cast("double"),
        "groups": F.regexp_count(hit, F.lit("[0-9]+")).cast("double"),
        "has_at": flag(F.contains(hit, F.lit("@"))),
        "has_plus": flag(F.startswith(hit, F.lit("+"))),
        "has_paren": flag(F.contains(hit, F.lit("("))),
        "luhn": flag(F.when(F.length(digits).between(12, 19), _luhn(digits))),
        "octets": flag(hit.rlike(rf"^{OCTET}(\.{OCTET}){{3}}$")),
        "ends_in_name": flag(hit.rlike(r"\.[A-Za-z]{2,12}$")),
        "after_alnum": flag(before.rlike("[A-Za-z0-9]$")),
        "before_alnum": flag(after.rlike("^[A-Za-z0-9]")),
        "after_mark": flag(before.rlike("[.,:;+-]$")),
        "before_mark": flag(after.rlike("^[.,:;-][0-9]")),
        "cue": flag(F.lower(before).rlike(rf"\b(?:{CUES})\b")),
        "own_cue": flag(_of_kind(lambda k: F.lower(before).rlike(rf"\b(?:{OWN_CUES[k]})\b[^0-9]*$"))),
        "checked": flag(_of_kind(lambda k: _checked(k, hit))),
        "shaped": flag(_of_kind(lambda k: hit.rlike(SHAPES[k]))),
    }


def _in_cells(spans: DataFrame) -> DataFrame:
    """Every span once for each cell of its text that it lies in."""
    cell = lambda at: F.floor(at / CELL)
    return spans.withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end") - 1))))


def _overlapping(spans: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs of ``spans`` and overlapping ``others``, whose columns are named o_...; equal pairs may repeat."""
    other = _in_cells(others)
    other = other.select(*[F.col(c).alias(f"o_{c}") for c in other.columns])
    same = (F.col("row") == F.col("o_row")) & (F.col("cell") == F.col("o_cell"))
    return _in_cells(spans).join(other, same & (F.col("o_start") < F.col("end")) & (F.col("o_end") > F.col("start")))


def find_pii(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    precision: float = PRECISION,
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base, spans.

    ``base`` and ``spans`` are arrays of (start, kind number, end) in code points;
    the counts are those of base spans.  Base spans are the leftmost matches of
    the base patterns that pass their checks and are always among the spans.
    Wide generators propose further, overlapping spans.  A candidate counts as
    good if it is a base span, or if its plain form passes the check of its kind,
    it is written in a usual way or after a word that speaks for it, and it
    touches no letter or digit; a candidate that no base pattern meets can be
    good too.  Boosted trees learn this from the candidates' format and the text
    around them, on at most ``fit_rows`` distinct ones, dealt over kinds and
    labels.  Scores of all candidates are counted by kind; the threshold of a kind
    is the lowest score from which at least ``precision`` of all candidates, and
    of those that touch no base span, are good.  What reaches it and touches no
    base span is added, the best of overlapping ones.

    Null is the empty text; texts without spans have empty arrays; texts of any
    length take time in proportion; null ids and rows that repeat are treated row by row; an empty table gives no rows; other
    columns are ignored.  Without good candidates nothing is added, without others
    all are.
    """
    text = F.col("body")
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("body"))

    def proposals(kind: str) -> Column:
        def whole(m: Column) -> Column:
            part = F.regexp_extract(m["hit"], WHOLE[kind], 1)
            hit = F.when(part != "", part).otherwise(m["hit"])
            return F.struct(m["start"].alias("start"), (m["start"] + F.length(hit)).alias("end"), hit.alias("hit"))

        return F.transform(_matches(text, WIDE[kind], r"@|[(\[]at[)\]]" if kind == "email" else "[0-9]"), whole)

    wide = {f"wide_{k}": proposals(k) for k in KINDS}
    # a place is looked up in short pieces, as a text is read from its start to every place
    pieces = {"pieces": F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CELL}}}"), F.lit(0))}
    found = rows.withColumns({f"base_{k}": base_spans(text, k) for k in KINDS} | wide | pieces)

    def around_at(at: Column, n: Column) -> Column:
        piece = F.floor(at / CELL).cast("int")
        both = F.concat(F.coalesce(F.get("pieces", piece), F.lit("")), F.coalesce(F.get("pieces", piece + 1), F.lit("")))
        return F.substring(both, at - piece * CELL + 1, n)

    def of_kind(name: str, i: int, context: bool) -> Column:
        def span(m: Column) -> Column:
            own = [m["start"].alias("start"), F.lit(i).alias("kind"), m["end"].alias("end")]
            around = [
                m["hit"].alias("hit"),
                around_at(F.greatest(m["start"] - CONTEXT, F.lit(0)), F.least(m["start"], F.lit(CONTEXT))).alias("before"),
                around_at(m["end"], F.lit(4)).alias("after"),
            ]
            return F.struct(*own, *(around if context else []))

        return F.transform(F.col(f"{name}_{KINDS[i]}"), span)

    base = F.concat(*[of_kind("base", i, False) for i in range(len(KINDS))])
    proposed = F.concat(*[of_kind("wide", i, True) for i in range(len(KINDS))])
    kept = staged(
        found.select(
            F.monotonically_increasing_id().alias("row"), "id",
            *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
            base.alias("base"), proposed.alias("proposed"),
        )
    )
    features, place = _features(), ["row", "start", "kind", "end"]
    proposed_spans = kept.where(F.size("proposed") > 0).select("row", F.explode("proposed").alias("c")).select("row", "c.*")
    base_rows = kept.where(F.size("base") > 0).select("row", F.explode("base").alias("b")).select("row", "b.*")
    equal = (F.col("o_start") == F.col("start")) & (F.col("o_end") == F.col("end")) & (F.col("o_kind") == F.col("kind"))
    met = _overlapping(proposed_spans.select(*place), base_rows).groupBy(*place).agg(F.bool_or(equal).alias("is_base"))
    candidates = staged(
        proposed_spans.withColumns(features).join(met, place, "left")
        .withColumns({
            "label": (
                F.coalesce("is_base", F.lit(False))
                | F.expr("checked = 1 AND (shaped = 1 OR own_cue = 1) AND after_alnum = 0 AND before_alnum = 0")
            ).cast("double"),
            "free": F.col("is_base").isNull(),
            # equal spans in equal surroundings have one place
            "lot": F.xxhash64("hit", "before", "after"),
        })
        .select(*place, "label", "free", "lot", *features)
    )
    # distinct candidates, as many of every kind and label
    key = ["kind", "label", "lot"]
    lots = staged(candidates.select(*key).distinct())
    share = fit_rows // (2 * len(KINDS))
    parts = [lots.where((F.col("kind") == k) & (F.col("label") == v)).orderBy("lot").limit(share) for k in range(len(KINDS)) for v in (0.0, 1.0)]
    fitted = staged(functools.reduce(DataFrame.unionByName, parts))
    sample = staged(
        candidates.select(*key, *features).join(F.broadcast(fitted), key).dropDuplicates(key)
        .repartition(1).sortWithinPartitions(*key)
    )
    labels = {r.label for r in sample.select("label").distinct().collect()}
    added = None
    if 1.0 in labels:
        if 0.0 in labels:
            to_vector = VectorAssembler(inputCols=list(features), outputCol="features")
            trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=1, labelCol="label").fit(to_vector.transform(sample).select("features", "label"))
            rated = trees.transform(to_vector.transform(candidates)).withColumn("p", F.floor(vector_to_array("probability")[1] * STEPS).cast("int"))
        else:
            rated = candidates.withColumn("p", F.lit(STEPS))
        scored = staged(rated.select("row", "start", "kind", "end", "free", "label", "p"))
        # lowest score of each kind from which the wanted share is good, of all and of the free ones
        by_score = scored.groupBy("kind", "p").agg(
            F.sum("label").alias("good"), F.count("*").alias("all"),
            F.sum(F.col("label") * F.col("free").cast("int")).alias("free_good"), F.count_if("free").alias("free"),
        ).orderBy("kind", F.desc("p")).collect()
        least: dict[int, int] = {}
        kind, sums = None, [0.0] * 4
        for r in by_score:  # at most STEPS rows of a kind
            if r.kind != kind:
                kind, sums = r.kind, [0.0] * 4
            sums = [a + b for a, b in zip(sums, (r.good, r["all"], r.free_good, r.free))]
            if sums[0] >= precision * sums[1] and sums[2] >= precision * sums[3]:
                least[kind] = r.p
        if least:
            limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(p)) for k, p in least.items()])
            chosen = scored.where("free").where(F.col("p") >= limit).select("row", "start", "kind", "end", "p")
            order = lambda p: F.struct(F.col(f"{p}p"), -F.col(f"{p}start"), -F.col(f"{p}kind"), F.col(f"{p}end"))
            beaten = _overlapping(chosen, chosen).where(order("o_") > order("")).select(*place).distinct()
            best = chosen.join(beaten, place, "left_anti")
            added = best.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    if added is None:
        out = kept.withColumn("spans", F.col("base"))
    else:
        out = kept.drop("proposed").join(added, "row", "left").withColumn("spans", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added")))
    return out.select(F.col("id").alias(id_col), *[f"n_{k}" for k in KINDS], "base", "spans")


@query("op1_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[f"n_{k}" for k in KINDS],
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )

"""Each operator against a brute-force version, on a fixture with every edge case."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from docquarry.llm import bpe_codec, class_lm, exact_dedup, mixing, pii, sharding, shingle_join, token_counts, toxicity, vector_dedup
from docquarry.llm.components import components

#: an extra column and names the operators use inside
SCHEMA = "doc_id long, text string, source string, lang string, score string, row long, node string, n long, stay_id int"


def _rows():
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdeé ß日") for _ in range(rnd.randint(1, 6))).replace(" ", "") or "x" for _ in range(300)]
    rows = []
    for i in range(60):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 120))]
        rows.append((i, " ".join(words), f"s{i % 4}"))
        if i % 5 == 0:  # near copy: the first words are cut off
            rows.append((100 + i, " ".join(words[max(1, len(words) // 12) :]), "s1"))
        if i % 7 == 0:  # exact copy
            rows.append((200 + i, " ".join(words), None))
    rows += [
        (300, None, "s0"), (301, "", "s0"), (302, " \t\n ", "s9"), (303, "Only Three Words", "s9"), (304, "only three words", "s9"),
        (305, "long " * 3000, "s2"), (306, "y" * 30_000, "s2"), (None, "no id here at all today", "s1"), (None, "no id here at all today", "s1"),
        (307, "same row", "s3"), (307, "same row", "s3"), (308, "<|endoftext|> in  text<|endoftext|>", "s3"), (309, "a▁b \x00 c\r\n\x0bd　e", "s3"),
        (310, "mail a.b+c@d-e.f.org, 10.0.0.255 or 999.1.1.1; +1 (415) 555-0199 4111 1111 1111 1111", "s3"),
    ]
    return rows


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", "x", 1, "n", 2, 3) for i, t, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(found, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in found.collect())


def test_exact_groups(docs, rows, none):
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    want = collections.Counter()
    for ids in groups.values():
        keep = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            want[i, keep, len(ids), i == keep and left > 0] += 1
            left -= i == keep
    for limit in (exact_dedup.BROADCAST_KEYS, 0):  # both ways to reach the scan
        for digest_all in (False, True):
            found = exact_dedup.exact_groups(docs, broadcast_keys=limit, digest_all=digest_all)
            assert bag(found, "doc_id", "keep_id", "group_size", "kept") == want
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.text or "") for r in left.collect()) == sorted(groups)
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_shards(docs, rows, none):
    found = sharding.shard_by_bytes(docs, 4).collect()
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == want
    sizes = collections.Counter()
    for r in found:
        sizes[r.shard] += r["size"]
    largest = max(r["size"] for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= largest + 0.03 * sum(sizes.values()) / 4
    for shard in range(4):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert bag(sharding.shard_by_bytes(docs.repartition(7), 4), "doc_id", "shard") == collections.Counter((r.doc_id, r.shard) for r in found)
    assert sharding.shard_by_bytes(none).count() == 0


def test_shards_split_a_hot_text(spark):
    hot = spark.range(4000).selectExpr("id AS doc_id", "IF(id < 2000, 'hot text', concat('t', id)) AS text")
    sizes = [r.b for r in sharding.shard_by_bytes(hot, 16).groupBy("shard").sum("size").toDF("s", "b").collect()]
    assert len(sizes) == 16 and max(sizes) <= 1.03 * sum(sizes) / 16


def test_mix(docs, rows, none):
    found = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert collections.Counter((r.doc_id, r.source, r["size"]) for r in found) == collections.Counter((i, s, size(t)) for i, t, s in rows)
    by = collections.Counter()
    for i, t, s in rows:
        by[s] += size(t)
    names = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    open_, targets, left = set(by), {}, sum(by.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 3 * by[s]]
        if not full:
            break
        for s in full:
            targets[s] = 3 * by[s]
            open_.remove(s)
            left -= targets[s]
    targets |= {s: level * weight[s] for s in open_}
    taken = collections.Counter()
    for r in found:
        assert math.isclose(r.target, targets[r.source], rel_tol=1e-12) and r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in by:
        assert abs(taken[s] - targets[s]) <= 0.02 * targets[s] + 2
    copies = mixing.mixed_copies(docs)
    assert copies.columns == docs.columns and copies.count() > 0
    assert mixing.mix(none).count() == 0 and mixing.mixed_copies(none).count() == 0


def test_apportionment_is_highest_quotients(spark):
    sizes = spark.createDataFrame([(s, n) for s, n in (("a", 900), ("b", 400), ("c", 70), ("d", 630))], "source string, size long")
    targets = mixing.source_targets(sizes).collect()
    quotas = mixing.block_quotas(mixing.source_targets(sizes), shards=3, block_words=10, min_blocks=1).collect()
    open_ = [t for t in targets if not t.full]
    votes = sum(t.target for t in open_)
    for shard in range(3):
        house, seats = math.floor(round(votes / 10) * (shard + 1) / 3), collections.Counter()
        for _ in range(house):
            best = max(open_, key=lambda t: (t.target / (2 * seats[t.source] + 1), -t.nth))
            seats[best.source] += 1
        for t in open_:
            assert sum(q.quota for q in quotas if q.source == t.source and q.shard <= shard) == seats[t.source]


def test_pii(docs, rows, none):
    def base(text):
        out = []
        for k, kind in enumerate(pii.KINDS):
            pattern = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}[kind]
            for m in re.finditer(pattern, text):
                d = re.sub("[^0-9]", "", m[0])
                luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
                if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0,
                    "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                    out.append((m.start(), k, m.end()))
        return sorted(out)

    odd = ["a@b.c_d@e.f", "1.2.3.4.5 300.1.1.1 001.2.3.255", "é😀 +1 (415) 555-0199 x@y.z.", "4111-1111-1111-1111", "1" * 5000, "a." * 3000 + "@b" + ".c" * 3000, "+" * 300 + "1"]
    spark = docs.sparkSession
    for frame, texts in ((docs, [(i, t) for i, t, _ in rows]), (spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), list(enumerate(odd)))):
        found = pii.find_pii(frame).collect()
        want = collections.Counter((i, tuple(base(t or ""))) for i, t in texts)
        assert collections.Counter((r.doc_id, tuple(sorted((s.start, s.kind, s.end) for s in r.base))) for r in found) == want
        assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in found)
    assert pii.find_pii(none).count() == 0


def test_toxicity(spark, sf_dir, none):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("aeinorst") for _ in range(5)) for _ in range(80)]
    rows, marks = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = [rnd.choice(words) for _ in range(40)] + ["zzgruk"] * bad
        rnd.shuffle(text)
        rows.append((i, " ".join(text)))
        marks += [(i, int(bad))] * (1 + i % 2)
    rows += [(1000, None), (1001, ""), (None, "zzgruk"), (1002, "zzgruk " * 5000)]
    marks += [(2000, 1), (1001, None), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    found = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((found[i] >= 0.7) == (i % 4 == 0) for i in held)
    assert found[1002] > 0.7 and found[1000] == found[1001] < 0.7
    plain = toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 0")))
    assert plain.select("score").distinct().count() == 1
    assert toxicity.score(none, toxicity.train(none, labels), into="p").count() == 0


def test_shingle_components(docs, rows, none):
    sets = []
    for i, t, _ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and 100 * len(x & y) >= 80 * len(x | y):
            root[top(b)] = top(a)
    want = collections.Counter()
    for a, (i, s) in enumerate(sets):
        ids = [sets[b][0] for b in range(len(sets)) if top(b) == top(a) and sets[b][0] is not None]
        want[i, len(s), (min(ids, default=None) if s else i)] += 1
    assert bag(shingle_join.shingle_components(docs), "doc_id", "n_shingles", "component_id") == want
    shingle_join.BROADCAST_IDS, kept = 0, shingle_join.BROADCAST_IDS
    try:
        assert bag(shingle_join.shingle_components(docs), "doc_id", "n_shingles", "component_id") == want
    finally:
        shingle_join.BROADCAST_IDS = kept
    assert shingle_join.drop_near_copies(docs).columns == docs.columns
    assert shingle_join.shingle_components(none).count() == 0


def test_shingle_links_of_large_sets(spark):
    """Overlaps on both sides of the threshold, and sizes on both sides of a doubling of the bitmap."""
    rnd, rows = random.Random(11), []
    for i, size in enumerate((540, 1020, 1030, 2040, 2060, 2600)):
        base = [f"w{i}.{rnd.randrange(10**6)}" for _ in range(size)]
        rows.append(base)
        for share in (0.05, 0.1, 0.18, 0.195, 0.205, 0.22, 0.4):
            rows.append(base[int(size * share) :])
            rows.append(base[: size - int(size * share / 2)] + [f"x{rnd.randrange(10**6)}" for _ in range(int(size * share / 2))])
    shingles = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b]):
            low, high = sorted((top(a), top(b)))
            root[high] = low
    want = collections.Counter((i, len(s), top(i)) for i, s in enumerate(shingles))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    assert bag(shingle_join.shingle_components(docs), "doc_id", "n_shingles", "component_id") == want
    sets = [np.sort(np.frombuffer(rnd.randbytes(8 * n), np.int64)) for n in (600, 740, 1500)]
    for x, y in itertools.permutations(sets[:2] + [np.sort(np.append(sets[0], sets[1][:120]))], 2):
        maps = shingle_join._wide_maps(np.concatenate((x, y)), np.array([len(x), len(y)]))
        frame = spark.createDataFrame([(1, len(x), maps[0].tolist()), (2, len(y), maps[1].tolist())], "node long, n long, wide array<long>")
        kept = shingle_join._within_wide(spark.createDataFrame([(1, 2)], "a long, b long"), frame).count()
        # unrelated sets are told apart, links never
        assert kept == (9 * len(np.intersect1d(x, y)) >= 4 * (len(x) + len(y)))


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 450), (7, 7)]
    found = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert all(found[i] == 0 for i in range(201)) and found[500] == found[450] == found[400] == 400


def test_class_lm(docs, rows, none):
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    texts = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None]) for i, t, _ in rows]
    counts = collections.Counter(w for i, ws in texts if not held(i) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    want = collections.Counter()
    for i, ws in texts:
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
        want[i, held(i), len(ws), sum(counts[w] > 0 for w in ws), total, round(base, 6)] += 1
    found = class_lm.score_texts(docs.drop("held"), "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 10, 0) = 0").collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    assert all(math.isfinite(r.score) for r in class_lm.score_texts(docs, "true").collect())
    assert class_lm.score_texts(none, "false").count() == 0


def test_exchange_separates_languages():
    pairs = np.zeros((42, 42))
    rnd = np.random.default_rng(1)
    for _ in range(4000):
        side = rnd.integers(2) * 20
        pairs[side + rnd.integers(20), side + rnd.integers(20)] += 1
    classes = class_lm.exchange(pairs, 40)
    assert not set(classes[:20]) & set(classes[20:])


ALPHABET = "ab  \n\t'é日😀%%1290.▁　\x00"


def _odd_texts():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 90))) for _ in range(1200)]
    return texts + ["", "  ", "a" * 3000, "ab" * 2000, "<|endoftext|>x <|endoftext|>", " a b " * 50, "abc " * 1000, "we'll it's\n\n  go " * 40]


def test_token_counts(docs, rows, none):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = _odd_texts()
    assert token_counts.PieceMerges(path).counts(texts) == [len(x) for x in library.encode(texts)]
    want = collections.Counter((i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t, _ in rows)
    assert bag(token_counts.token_counts(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(none, path).count() == 0


def test_bpe_codec(docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    ids = lambda t: library.encode(t, add_special_tokens=False).ids
    texts = _odd_texts() + [" ".join(w * 3 for w in ALPHABET) * 60]
    for text, (found, back) in zip(texts, bpe_codec.ChunkCodec(path).encode(texts)):
        assert np.frombuffer(found, "<u4").tolist() == ids(text) and back.decode() == text
    want = collections.Counter()
    for i, t, _ in rows:
        x = ids(t or "")
        want[i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()] += 1
    coded = bpe_codec.encode(docs, path)
    assert bag(coded, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert all(r.decoded == (r.text or "") and list(r.ids) == ids(r.text or "") for r in coded.collect())
    assert bpe_codec.encode(none, path, with_text=False).count() == 0


def test_vector_links(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 20))
    rows = []
    for i in range(400):
        v = centres[i % 40] + rng.normal(size=20) * rng.choice([0, 0.05, 0.25])
        rows.append((i, v.tolist(), i % 2, "x"))
    rows += [(900, None, 0, "x"), (901, [0.0] * 20, 0, "x"), (902, [1.0, None] * 10, 0, "x"), (903, [float("nan")] * 20, 0, "x"), (904, [], 1, "x"),
             (905, rows[0][1], None, "x"), (None, rows[0][1], 0, "x"), (906, [2 * x for x in rows[0][1]], 0, "x"), (906, rows[0][1], 0, "x"), (907, [1.0, 2.0], 0, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string")
    good = [k for k, (i, v, l, _) in enumerate(rows) if i is not None and l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, root = collections.defaultdict(set), list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(good, 2):
        x, y = np.array(rows[a][1]), np.array(rows[b][1])
        if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
            links[a].add(b), links[b].add(a)
            root[top(b)] = top(a)
    found = vector_dedup.vector_links(frame).collect()
    assert len(found) == len(rows)
    n_found, n_want = sum(r.n_links for r in found), sum(map(len, links.values()))
    assert 0.97 * n_want <= n_found <= n_want
    names = collections.defaultdict(list)
    for k in range(len(rows)):
        names[top(k)].append(rows[k][0])
    want = collections.Counter((rows[k][0], min((i for i in names[top(k)] if i is not None), default=None)) for k in range(len(rows)))
    got = collections.Counter((r.vec_id, r.component_id) for r in found)
    assert sum((want & got).values()) >= 0.97 * len(rows)
    for r in found:
        assert r.kept == (r.vec_id == r.component_id if r.vec_id is not None else True)
        assert r.vec_id not in (900, 901, 902, 903, 904, 905, 907, None) or r.n_links == 0
    assert vector_dedup.vector_links(frame.limit(0)).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == docs.columns
        assert after.select("doc_id").join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        before = corpus_pipeline.staged(after)
        if name == "shingle_join":
            assert shingle_join.shingle_components(before).where("doc_id <> component_id").count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() == before.count()
    with pytest.raises(Exception):
        corpus_pipeline.run(spark, "/nowhere")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0

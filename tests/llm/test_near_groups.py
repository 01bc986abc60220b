import itertools
import random

from docquarry.llm import shingle_join


def test_pairs_of_a_group_of_near_copies(spark, monkeypatch):
    """Texts that link with their origin, half of them not with each other: pairs grow with the texts."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(240):
        words = list(base)
        for at in rnd.sample(range(150), 1 + i % 3):
            words[at] = f"x{rnd.randrange(10**6)}"
        rows.append(words)
    rows.insert(100, base)
    rows += [[f"y{rnd.randrange(10**6)}" for _ in range(60)] for _ in range(20)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    apart = 0
    for a, b in itertools.combinations(range(len(rows)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((top(a), top(b)))
            root[high] = low
        else:
            apart += a < 241 and b < 241
    assert apart > 5000
    tested, within = [], shingle_join._within_wide

    def counted(pairs, sets):
        tested.append(pairs.count())
        return within(pairs, sets)

    monkeypatch.setattr(shingle_join, "_within_wide", counted)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    found = {tuple(r) for r in shingle_join.shingle_components(docs).collect()}
    assert found == {(i, len(s), top(i)) for i, s in enumerate(sets)}
    assert sum(tested) < 5 * len(rows), tested

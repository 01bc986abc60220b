"""Arrays of the text operators are no wider than their values."""

import tracemalloc

import numpy as np

from docquarry.llm import bpe_codec, class_lm, common, toxicity


def peak(work):
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_pairs_of_a_block():
    rnd = np.random.default_rng(3)
    lengths = rnd.integers(0, 60, 20_000)
    held, packed = rnd.random(20_000) < 0.1, class_lm._packed(rnd.integers(0, 500, lengths.sum()))
    found, most = peak(lambda: class_lm._training_pairs(class_lm._unpacked(packed), lengths, held, 501))
    before, at = found[:2]
    texts = np.split(class_lm._unpacked(packed), np.cumsum(lengths)[:-1])
    whole = [np.concatenate(([501], t, [501])) for t, h in zip(texts, held) if not h]
    assert (before == np.concatenate([w[:-1] for w in whole])).all() and (at == np.concatenate([w[1:] for w in whole])).all()
    assert before.dtype == at.dtype == np.int32
    assert most < 30 * lengths.sum()


def test_slots_of_labelled_texts():
    rnd = np.random.default_rng(4)
    texts = ["".join(map(chr, rnd.integers(97, 123, 4_000))) for _ in range(400)]
    slots = sum(len(toxicity._present([t])) for t in texts)
    model, most = peak(lambda: toxicity.fit(texts, np.arange(400) % 2, 0.5))
    assert len(model[0]) == len(model[1]) > 0
    # the tables of all slots have some 90 MB; the rest is for the rows
    assert most < 95_000_000 + 6 * slots


def test_fitting_keeps_no_slots_of_rows():
    rnd = np.random.default_rng(5)
    texts = ["".join(map(chr, rnd.integers(97, 123, 4_000))) for _ in range(400)]
    _, most = peak(lambda: toxicity.fit(texts, np.arange(400) % 2, 0.5))
    # two counts of every slot, 4 bytes each, some arrays of the slots in several texts and the chosen columns
    assert most < 60_000_000


def test_chosen_slots_and_their_ratios():
    texts = ["bad word here"] * 6 + ["good word there"] * 7 + ["badly"]
    toxic = np.array([1] * 6 + [0] * 7 + [1])
    slots, weights, _ = toxicity.fit(texts, toxic, 0.5)
    count = np.zeros((2, 1 << toxicity.HASH_BITS))
    for text, y in zip(texts, toxic):
        count[y, toxicity._present([text])] += 1
    # what lies in equally large shares of both classes or in few texts says nothing
    share = count / np.array([[7], [7]])
    wanted = np.flatnonzero((count.sum(axis=0) >= toxicity.LEAST_DOCS) & (share[0] != share[1]))
    assert slots.tolist() == wanted.tolist()
    assert (weights[count[1, slots] > count[0, slots]] != 0).all()


def test_memory_goes_back_after_the_last_batch(monkeypatch):
    said = []
    monkeypatch.setattr(common, "_give_back", lambda: said.append("back"))

    @common.giving_back
    def doubled(parts):
        for part in parts:
            said.append(part)
            yield 2 * part

    assert list(doubled(iter([1, 2]))) == [2, 4]
    assert said == [1, 2, "back"]
    assert list(doubled(iter([]))) == [] and said[-2:] == ["back", "back"]


def test_a_task_leaves_no_chunks():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    codec = bpe_codec._codec(path)
    rows = list(bpe_codec.coded_rows(path, iter([["some words of a text"], ["and others"]])))
    assert [len(r) for r in rows] == [1, 1]
    assert bpe_codec._codec(path) is codec and not codec.known and codec.held == 0

"""The recurrent toxicity network: gradients, windows, blocks, held-out accuracy, defined cases."""

import random
import zlib

import numpy as np
import pytest

from turnloom.llm import toxicity as tox

SCHEMA = "doc_id bigint, text string, score string, toxic string, lang string"


def plain_words(raw):
    """Words of a text, read character by character."""
    text = "".join(x if x.isalnum() or ord(x) > 127 else " " for x in raw.decode())
    return ["".join(c.lower() if ord(c) < 256 else c for c in x).encode() for x in text.split()]


def naive_logit(net, words, raws):
    """One window's logit, word by word and unit by unit, in double precision."""
    w = {k: v.astype(float) for k, v in net.weights.items()}
    ends = np.concatenate([[0], np.cumsum(words.counts)])
    xs = []
    for i in range(len(words)):
        pieces = words.pieces[ends[i] : ends[i + 1]]
        mean = w["piece"][pieces].mean(0) if len(pieces) else np.zeros(tox.EMBED)
        xs.append(np.concatenate([w["word"][words.slots[i]], mean]))
    h_ = tox.HIDDEN
    sides = []
    for d, order in ((0, range(len(xs))), (1, range(len(xs) - 1, -1, -1))):
        h, out = np.zeros(h_), [None] * len(xs)
        for t in order:
            a, b = xs[t] @ w["input"][d] + w["bias"][d, 0], h @ w["state"][d]
            r, z = (1 / (1 + np.exp(-(a[k * h_ : (k + 1) * h_] + b[k * h_ : (k + 1) * h_]))) for k in (0, 1))
            fresh = np.tanh(a[2 * h_ :] + r * b[2 * h_ :])
            h = z * h + (1 - z) * fresh
            out[t] = h
        sides.append(out)
    states = np.array([np.concatenate([f, b]) for f, b in zip(*sides)])
    score = np.exp(np.tanh(states @ w["attend"]) @ w["query"])
    return float((score / score.sum()) @ states @ w["out"] + w["shift"][0])


def texts_of(draw, n, bad=False):
    words = [f"{draw.choice('abcdefghk')}{draw.choice(['lo', 'ma', 'ti'])}{draw.choice('rst')}" for _ in range(n)]
    if bad:
        for _ in range(max(1, n // 15)):
            words[draw.randrange(n)] = "vrax" + draw.choice(["lo", "ma", "en", "ute"])
    return " ".join(words).encode()


def test_words_and_slots_do_not_depend_on_what_stands_around():
    raw = "Ab, É漢x ab  a\n\n#été%ABC".encode()
    words, places = tox.words_of(np.frombuffer(raw, np.uint8))
    assert len(words) == len(plain_words(raw)) == 6
    assert raw[places[4] :].decode() == "été%ABC"
    alone, _ = tox.words_of(np.frombuffer("été".encode(), np.uint8))
    other, _ = tox.words_of(np.frombuffer("x ÉTÉ!".encode(), np.uint8))
    assert alone.slots[0] == other.slots[1] == words.slots[4]
    assert words.slots[0] == words.slots[2] and list(words.counts) == [1, 5, 1, 0, 4, 2]
    assert list(alone.pieces) == list(other.pieces[-4:])


def test_logits_equal_a_naive_network_whatever_the_padding():
    draw = random.Random(2)
    raws = [texts_of(draw, n) for n in (1, 3, 17, 64)]
    words, borders = tox.words_of_texts(raws)
    net = tox.Network.fresh()
    index, mask = tox.laid_out(borders[:-1], np.diff(borders))
    found = net.run(net.vectors(words)[index], mask)
    for i, raw in enumerate(raws):
        own, _ = tox.words_of(np.frombuffer(raw, np.uint8))
        assert found[i] == pytest.approx(naive_logit(net, own, raw), abs=2e-4)


def test_gradients_equal_differences():
    draw = random.Random(3)
    words, borders = tox.words_of_texts([texts_of(draw, n) for n in (5, 9, 2)])
    net = tox.Network({k: v.astype(float) for k, v in tox.Network.fresh().weights.items()})
    index, mask = tox.laid_out(borders[:-1], np.diff(borders))
    slope = np.array([0.7, -1.2, 0.4])

    def loss():
        vectors = np.zeros((len(words), 2 * tox.EMBED))
        ends = np.concatenate([[0], np.cumsum(words.counts)])
        for i in range(len(words)):
            vectors[i, : tox.EMBED] = net.weights["word"][words.slots[i]]
            if words.counts[i]:
                vectors[i, tox.EMBED :] = net.weights["piece"][words.pieces[ends[i] : ends[i + 1]]].mean(0)
        one = [naive_logit(net, words.some(a, b), None) for a, b in zip(borders[:-1], borders[1:])]
        return float(np.dot(one, slope))

    grads = net.gradients(words, index, mask, lambda _: slope)
    pick = np.random.default_rng(4)
    for name, value in net.weights.items():
        flat, grad = value.reshape(-1), grads[name].reshape(-1)
        used = np.flatnonzero(np.abs(grad) > 1e-3)
        for at in pick.choice(used, min(4, len(used)), replace=False):
            old = flat[at]
            flat[at] = old + 1e-4
            up = loss()
            flat[at] = old - 1e-4
            down = loss()
            flat[at] = old
            assert grad[at] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=2e-4), name


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 112, 113, 500, 1001):
        covered = {i for s in tox.window_starts(n) for i in range(s, min(n, s + tox.WINDOW))}
        assert covered == set(range(n))
        assert all(s + tox.WINDOW <= n for s in tox.window_starts(n)) or n < tox.WINDOW


@pytest.mark.parametrize("block", [700, 1900, 5000])
def test_blocks_of_a_long_text_give_what_the_whole_gives(monkeypatch, block):
    draw = random.Random(block)
    raws = [texts_of(draw, n, bad=True) for n in (1500, 64, 112, 113, 900)] + [b"x" * 40 + b" ." * 3000, b"", b"..!"]
    detector = tox.Detector(tox.Network.fresh(), np.array([0.1, 1, 1, 1]))
    whole = detector.summaries(raws)
    monkeypatch.setattr(tox, "BLOCK_BYTES", block)
    assert np.allclose(detector.summaries(raws), whole, atol=1e-5)
    assert tox.excerpt(raws[0]).split() == [
        w for s in tox.window_starts(1500)[np.linspace(0, 30, 8).astype(int)] for w in raws[0].split()[s : s + 64]]


def test_learns_unseen_endings_and_leaves_clean_texts_alone(spark):
    draw = random.Random(8)
    rows = [(i, texts_of(draw, draw.randrange(20, 300), bad=i % 4 == 0).decode(), "x", "y", "en") for i in range(700)]
    documents = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(700)], "doc_id bigint, toxic int")
    found = tox.scored(documents, tox.train_from(documents, labels)).collect()
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(700) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in found)
    right = [r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held]
    assert np.mean(right) >= 0.95
    assert sum(r["predicted"] for r in held if r["doc_id"] % 4) <= 2


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "a"), (None, "some words"), (6, "word " * 300_000), (6, "é" * 1_500_000), (7, "a"), (7, "a")]
    documents = spark.createDataFrame([(a, b, "s", "t", None) for a, b in rows], SCHEMA)
    labels = [(None, 1), (4, None), (1, 1), (2, 0), (6, 1), (6, 0), (7, 1), (7, 1), (99, 0)]
    for known in (labels, [(1, 1), (2, 1), (6, 1), (7, 1)], []):
        detector = tox.train_from(documents, spark.createDataFrame(known, "doc_id bigint, toxic int"))
        found = tox.scored(documents, detector)
        assert found.where("score between 0 and 1 and held_out is not null").count() == len(rows)
        blank = {r["score"] for r in found.collect() if r["doc_id"] in (1, 2, 3)}
        assert len(blank) == 1
    empty = spark.createDataFrame([], SCHEMA)
    detector = tox.train_from(empty, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert tox.scored(empty, detector).collect() == [] and detector.scores([b"x"])[0] == pytest.approx(0.5)

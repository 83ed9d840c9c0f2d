"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word is a run of letters, digits and characters beyond ASCII, in lower case. Its input vector joins a
learned vector of the hashed word with the mean of learned vectors of its hashed four-byte pieces, so
endings and spellings that were never seen still say something. Windows of WINDOW words, each partly over
the one before and together over the whole text, go through the network: gated recurrent units from both
sides, attention over all places of the window, one logit. A text's score comes from the mean and the
highest of its windows' probabilities, by a logistic regression fitted on the texts learned from.

Everything works on arrays of bytes: no Python object per word or character. Texts are read in blocks of
at most a MiB, so texts of any length take the same memory; the last words of a block go to the next.

Defined cases: texts without words, null and empty ones have no window and get the score of zero mean
and zero highest probability; a run of letters over a MiB counts as several words; without labelled rows
of both classes every score is the share of label 1, or 0.5 without any; rows with equal ids are scored
one by one; a label whose doc_id or toxic is null teaches nothing, and a text labelled twice teaches
twice; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import arrow_map, lowest, raw_texts, scratch, texts

WINDOW, STRIDE = 64, 48
WORD_SLOTS, PIECE_SLOTS, EMBED = 1 << 14, 1 << 14, 8
HIDDEN, ATTEND = 8, 8
PIECE = 4
BLOCK_BYTES = 1 << 20
#: At most this many labelled rows, those with the smallest digests of their ids, are learned from, and of
#: each this many windows, spread evenly over the text. Scoring has no such bounds.
SAMPLE_ROWS, SAMPLE_WINDOWS = 4_000, 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _letters() -> np.ndarray:
    """Lower-case byte of each byte that belongs to a word, else 0."""
    out = np.zeros(256, np.uint8)
    for a, b in ((48, 57), (97, 122), (128, 255)):
        out[a : b + 1] = np.arange(a, b + 1)
    out[65:91] = np.arange(97, 123)
    return out


_LOWER = _letters()


def plain(raw: np.ndarray) -> np.ndarray:
    """Bytes of words in lower case (ASCII and Latin-1 letters), zero between words."""
    out = _LOWER[raw]
    if len(out) > 1:
        after = np.flatnonzero(out[:-1] == 0xC3) + 1
        second = out[after]
        big = (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        out[after[big]] += 0x20
    return out


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


@dataclass
class Words:
    """Slots of each word, slots of all words' pieces in a row, and how many pieces each word has."""

    slots: np.ndarray
    pieces: np.ndarray
    counts: np.ndarray

    def some(self, first: int, last: int) -> Words:
        ends = np.concatenate([[0], np.cumsum(self.counts)])
        return Words(self.slots[first:last], self.pieces[ends[first] : ends[last]], self.counts[first:last])

    def __len__(self) -> int:
        return len(self.slots)


def joined(parts: list[Words]) -> Words:
    return Words(*(np.concatenate([getattr(x, name) for x in parts]) for name in ("slots", "pieces", "counts")))


def words_of(raw: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words of a block of bytes, and the place of each word's first byte."""
    data = np.zeros(len(raw) + 2, np.uint8)  # a zero on both sides
    data[1:-1] = plain(raw)
    inside = data != 0
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    if not len(starts):
        return Words(np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int64)), starts
    with np.errstate(over="ignore"):
        powers = np.full(len(data), _BASE, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, out=total[1:])
        back = np.full(len(data), _BACK, np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        slots = (_mixed((total[ends] - total[starts]) * back[starts]) % np.uint64(WORD_SLOTS)).astype(np.int32)
        # pieces start at the zero before a word and end with the zero after it
        codes = np.zeros(len(data) - PIECE + 1 if len(data) >= PIECE else 0, np.uint32)
        for i in range(PIECE):
            codes += data[i : len(codes) + i].astype(np.uint32) << np.uint32(8 * i)
        counts = np.maximum(0, ends - starts + 2 - PIECE + 1)
        offsets = np.cumsum(counts) - counts
        places = np.arange(int(counts.sum())) - np.repeat(offsets - (starts - 1), counts)
        pieces = codes[places] * np.uint32(2654435761)
        pieces = (pieces >> np.uint32(32 - 14)).astype(np.int32) % PIECE_SLOTS
    return Words(slots, pieces, counts), starts - 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights; both directions are kept side by side along a first axis."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 3) -> Network:
        draw = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return draw.normal(0, scale, shape).astype(np.float32)

        h = HIDDEN
        return Network({
            "word": normal(WORD_SLOTS, EMBED, scale=0.3), "piece": normal(PIECE_SLOTS, EMBED, scale=0.3),
            "input": normal(2, 2 * EMBED, 3 * h, scale=0.25), "bias": np.zeros((2, 1, 3 * h), np.float32),
            "state": normal(2, h, 3 * h, scale=0.25),
            "attend": normal(2 * h, ATTEND, scale=0.2), "query": normal(ATTEND, scale=0.2),
            "out": normal(2 * h, scale=0.2), "shift": np.full(1, -1.0, np.float32)})

    def vectors(self, words: Words) -> np.ndarray:
        """Input vectors of words: the word's own, and the mean of its pieces'."""
        out = np.zeros((len(words), 2 * EMBED), np.float32)
        out[:, :EMBED] = self.weights["word"][words.slots]
        used = np.flatnonzero(words.counts)
        if len(used):
            heads = (np.cumsum(words.counts) - words.counts)[used]
            sums = np.add.reduceat(self.weights["piece"][words.pieces], heads, axis=0)
            out[used, EMBED:] = sums / words.counts[used, None]
        return out

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows: x is time, window, input; mask is time, window.

        Beyond a window's last word states stay as they are, so windows of any length run together.
        """
        w, (steps, n) = self.weights, mask.shape
        gates = np.stack([x.reshape(-1, x.shape[2]) @ w["input"][d] for d in (0, 1)]).reshape(2, steps, n, -1)
        gates += w["bias"][:, None]
        states = np.zeros((2, steps, n, HIDDEN), np.float32)
        h, saved = np.zeros((2, n, HIDDEN), np.float32), []
        for t in range(steps):
            at = (t, steps - 1 - t)
            given = np.stack([gates[0, at[0]], gates[1, at[1]]])
            alive = np.stack([mask[at[0]], mask[at[1]]])[:, :, None]
            inner = h @ w["state"]
            both = _sigmoid(given[:, :, : 2 * HIDDEN] + inner[:, :, : 2 * HIDDEN])
            reset, update = both[:, :, :HIDDEN], both[:, :, HIDDEN:]
            fresh = np.tanh(given[:, :, 2 * HIDDEN :] + reset * inner[:, :, 2 * HIDDEN :])
            step = alive * (1 - update)
            before, h = h, h + step * (fresh - h)
            states[0, at[0]], states[1, at[1]] = h[0], h[1]
            if keep:
                saved.append((before, reset, update, fresh, inner[:, :, 2 * HIDDEN :], alive))
        both = np.concatenate([states[0], states[1]], axis=2)
        hidden = np.tanh(both @ w["attend"])
        weight = np.exp(np.clip(hidden @ w["query"], -30, 30)) * mask
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = (weight[:, :, None] * both).sum(0)
        logit = pooled @ w["out"] + w["shift"][0]
        return (logit, (gates, saved, both, hidden, weight, pooled)) if keep else logit

    def gradients(self, words: Words, index: np.ndarray, mask: np.ndarray, weigh) -> dict[str, np.ndarray]:
        """Gradients of a loss over windows of words; index is time, window; weigh(logits) is its slope."""
        w, h_ = self.weights, HIDDEN
        vectors = self.vectors(words)
        x = vectors[index]
        logit, (_, saved, both, hidden, weight, pooled) = self.run(x, mask, keep=True)
        slope = weigh(logit).astype(np.float32)
        grads = {"out": slope @ pooled, "shift": np.array([slope.sum()])}
        d_pooled = slope[:, None] * w["out"]
        d_both = weight[:, :, None] * d_pooled
        d_weight = (both * d_pooled).sum(2)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        grads["query"] = np.tensordot(d_score, hidden, 2)
        d_hidden = d_score[:, :, None] * w["query"] * (1 - hidden**2)
        flat = both.reshape(-1, 2 * h_)
        grads["attend"] = flat.T @ d_hidden.reshape(-1, ATTEND)
        d_both = d_both + d_hidden @ w["attend"].T
        steps, n = mask.shape
        d_gates = np.zeros((2, steps, n, 3 * h_), np.float32)
        grads["state"] = np.zeros_like(w["state"])
        turned = w["state"].transpose(0, 2, 1)
        d_h = np.zeros((2, n, h_), np.float32)
        for t in range(steps - 1, -1, -1):
            before, reset, update, fresh, inner, alive = saved[t]
            at = (t, steps - 1 - t)
            d_h = d_h + np.stack([d_both[at[0], :, :h_], d_both[at[1], :, h_:]])
            step = alive * (1 - update)
            d_fresh = d_h * step * (1 - fresh**2)
            d_update = -d_h * alive * (fresh - before) * update * (1 - update)
            d_reset = d_fresh * inner * reset * (1 - reset)
            d_gate = np.concatenate([d_reset, d_update, d_fresh], axis=2)
            d_inner = np.concatenate([d_reset, d_update, d_fresh * reset], axis=2)
            d_gates[0, at[0]], d_gates[1, at[1]] = d_gate[0], d_gate[1]
            grads["state"] += before.transpose(0, 2, 1) @ d_inner
            d_h = d_h * (1 - step) + d_inner @ turned
        grads["bias"] = d_gates.sum((1, 2))[:, None]
        flat_x = x.reshape(-1, 2 * EMBED)
        spread = d_gates.reshape(2, -1, 3 * h_)
        grads["input"] = np.stack([flat_x.T @ spread[d] for d in (0, 1)])
        d_x = spread[0] @ w["input"][0].T + spread[1] @ w["input"][1].T
        d_x *= mask.reshape(-1, 1)
        d_vectors = np.stack([
            np.bincount(index.ravel(), weights=d_x[:, i], minlength=len(words)) for i in range(2 * EMBED)], axis=1)
        shares = np.repeat(d_vectors[:, EMBED:] / np.maximum(1, words.counts)[:, None], words.counts, axis=0)
        for name, slots, values, size in (
                ("word", words.slots, d_vectors[:, :EMBED], WORD_SLOTS), ("piece", words.pieces, shares, PIECE_SLOTS)):
            grads[name] = np.stack([np.bincount(slots, weights=values[:, i], minlength=size) for i in range(EMBED)], axis=1)
        return grads


def window_starts(n: int) -> np.ndarray:
    """First words of the windows of a text of n words: every STRIDE, and a last one at its end."""
    if n <= WINDOW:
        return np.zeros(min(1, n), np.int64)
    starts = np.arange(0, n - WINDOW + 1, STRIDE)
    return starts if starts[-1] == n - WINDOW else np.append(starts, n - WINDOW)


def laid_out(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and mask (time, window) of windows with these first words and lengths."""
    steps = np.arange(int(lengths.max()))[:, None]
    return np.minimum(starts + steps, starts + lengths - 1), (steps < lengths).astype(np.float32)


@dataclass
class Detector:
    """A network and the regression from (mean, highest) window probability to a text's score."""

    network: Network | None
    regression: np.ndarray

    def probabilities(self, words: Words, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of each window, 1,024 of about equal length at a time."""
        out = np.zeros(len(starts), np.float32)
        vectors = self.network.vectors(words)
        order = np.argsort(lengths, kind="stable")
        for at in range(0, len(order), 1024):
            chosen = order[at : at + 1024]
            index, mask = laid_out(starts[chosen], lengths[chosen])
            out[chosen] = _sigmoid(self.network.run(vectors[index], mask))
        return out

    def long_text(self, raw: bytes) -> tuple[int, float, float]:
        """Windows, sum and maximum of their probabilities for a text of many blocks."""
        n, total, most, kept = 0, 0.0, 0.0, None
        for block, last in blocks(raw):
            words, _ = words_of(np.frombuffer(block, np.uint8))
            words = joined([kept, words]) if kept is not None else words
            starts = window_starts(len(words))
            if not last:  # whole steps only; what they do not cover goes on, the overlap included
                starts = starts[(starts % STRIDE == 0) & (starts + WINDOW <= len(words))][: -1]
                kept = words.some(int(starts[-1]) + STRIDE if len(starts) else 0, len(words))
            if len(starts):
                found = self.probabilities(words, starts, np.minimum(WINDOW, len(words) - starts))
                n, total, most = n + len(found), total + float(found.sum()), max(most, float(found.max()))
        return n, total, most

    def summaries(self, raws: list[bytes]) -> np.ndarray:
        """Mean and highest window probability of each text."""
        out = np.zeros((len(raws), 2))
        at = 0
        while at < len(raws):
            if len(raws[at]) > BLOCK_BYTES:
                n, total, most = self.long_text(raws[at])
                out[at] = total / max(1, n), most
                at += 1
                continue
            end, size = at, 0
            while end < len(raws) and size + len(raws[end]) + 1 <= BLOCK_BYTES + 1:
                size += len(raws[end]) + 1
                end += 1
            words, borders = words_of_texts(raws[at:end])
            counts = np.diff(borders)
            lists = [window_starts(n) for n in counts.tolist()]
            owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            starts = np.concatenate(lists) if lists else np.empty(0, np.int64)
            if len(starts):
                found = self.probabilities(words, starts + borders[owner], np.minimum(WINDOW, counts[owner] - starts))
                n = np.bincount(owner, minlength=len(lists))
                out[at:end, 0] = np.bincount(owner, weights=found, minlength=len(lists)) / np.maximum(1, n)
                np.maximum.at(out[:, 1], at + owner, found)
            at = end
        return out

    def scores(self, raws: list[bytes]) -> np.ndarray:
        inputs = self.summaries(raws) if self.network is not None else np.zeros((len(raws), 2))
        return 1 / (1 + np.exp(-np.clip(_regressors(inputs) @ self.regression, -30, 30)))


def blocks(raw: bytes) -> Iterator[tuple[bytes, bool]]:
    """Blocks of a text, cut between words where there is such a place, and whether it is the last."""
    at = 0
    while len(raw) - at > BLOCK_BYTES:
        between = np.flatnonzero(_LOWER[np.frombuffer(raw, np.uint8, BLOCK_BYTES, at)] == 0)
        end = at + (int(between[-1]) + 1 if len(between) else BLOCK_BYTES)
        yield raw[at:end], False
        at = end
    yield raw[at:], True


def words_of_texts(raws: list[bytes]) -> tuple[Words, np.ndarray]:
    """Words of several texts in a row, and the number of each text's first word there."""
    data = np.frombuffer(b" ".join(raws), np.uint8)
    words, places = words_of(data)
    ends = np.cumsum([len(x) + 1 for x in raws])
    return words, np.concatenate([[0], np.searchsorted(places, ends)])


def _regressors(inputs: np.ndarray) -> np.ndarray:
    mean, most = inputs[:, 0], inputs[:, 1]
    return np.stack([np.ones(len(inputs)), 4 * mean, 4 * most, 4 * mean**2], axis=1)


def regression(inputs: np.ndarray, labels: np.ndarray, decay: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps."""
    x = _regressors(inputs)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - labels) / len(x) + decay * w
        bend = (x * (p * (1 - p))[:, None]).T @ x / len(x) + decay * np.eye(len(w))
        w -= np.linalg.solve(bend, slope)
    return w


def train_network(raws: list[bytes], labels: np.ndarray, epochs: int = 6, rate: float = 0.01, texts_at_once: int = 48) -> Network:
    """A text's label holds for its windows together: the loss is that of their log mean exp logit.

    Adam over small groups of texts in a fixed random order.
    """
    cut = []
    for raw in raws:
        words, _ = words_of(np.frombuffer(raw, np.uint8))
        starts = window_starts(len(words))
        if len(starts) > SAMPLE_WINDOWS:
            starts = starts[np.linspace(0, len(starts) - 1, SAMPLE_WINDOWS).astype(int)]
        cut.append([words.some(int(s), int(min(s + WINDOW, len(words)))) for s in starts])
    rows = np.array([i for i, x in enumerate(cut) if x])
    network, draw = Network.fresh(), np.random.default_rng(7)
    first, second = ({k: np.zeros_like(v) for k, v in network.weights.items()} for _ in range(2))
    step, last = 0, epochs * -(-len(rows) // texts_at_once)
    for _ in range(epochs):
        order = draw.permutation(rows)
        for at in range(0, len(order), texts_at_once):
            chosen = order[at : at + texts_at_once]
            windows = [w for i in chosen for w in cut[i]]
            owner = np.repeat(np.arange(len(chosen)), [len(cut[i]) for i in chosen])
            lengths = np.array([len(w) for w in windows])
            index, mask = laid_out(np.cumsum(lengths) - lengths, lengths)

            def weigh(logit, owner=owner, chosen=chosen):
                n = np.bincount(owner)
                top = np.full(len(n), -np.inf)
                np.maximum.at(top, owner, logit)
                spread = np.exp(logit - top[owner])
                total = np.bincount(owner, weights=spread)
                whole = top + np.log(total / n)
                error = (1 / (1 + np.exp(-np.clip(whole, -30, 30))) - labels[chosen]) / len(n)
                return error[owner] * spread / total[owner]

            grads = network.gradients(joined(windows), index, mask, weigh)
            step += 1
            speed = rate * (1 - 0.9 * step / last)
            for name, value in network.weights.items():
                grad = grads[name].astype(np.float32)
                if name in ("word", "piece"):
                    grad += 1e-5 * value
                first[name] += 0.1 * (grad - first[name])
                second[name] += 0.001 * (grad**2 - second[name])
                value -= speed * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return network


def same_for_all(labels: np.ndarray) -> Detector:
    """The detector that one class, or no label at all, allows."""
    share = min(max(float(labels.mean()), 1e-3), 1 - 1e-3) if len(labels) else 0.5
    return Detector(None, np.array([np.log(share / (1 - share)), 0, 0, 0]))


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_from(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Detector:
    """Learn from labelled rows outside the held-out third, `sample_rows` at most.

    The driver gets SAMPLE_WINDOWS windows of each text for the network, and two numbers of each whole
    text for the regression.
    """
    marked = lowest(
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))),
        ["doc_id", "toxic"], sample_rows)
    known = texts(documents).join(F.broadcast(marked), "doc_id")  # at most sample_rows pairs of integers
    known = scratch(  # a doc_id may have several texts
        known.orderBy(F.xxhash64("doc_id", "toxic"), "doc_id", "toxic", F.xxhash64("text")).limit(sample_rows)
        .repartition(F.col("doc_id")))

    def cut(batch: pa.RecordBatch) -> dict:
        return {"toxic": batch.column("toxic"), "shown": [excerpt(raw) for raw in raw_texts(batch.column("text"))]}

    rows = sorted(map(tuple, arrow_map(known, cut, "toxic int, shown binary").collect()))
    marks = np.array([float(x == 1) for x, _ in rows])
    if not 0 < marks.sum() < len(marks):
        return same_for_all(marks)
    detector = Detector(train_network([bytes(x) for _, x in rows], marks), np.zeros(4))
    shared = documents.sparkSession.sparkContext.broadcast(detector)  # a fixed number of weights

    def sum_up(batch: pa.RecordBatch) -> dict:
        found = shared.value.summaries(raw_texts(batch.column("text")))
        return {"toxic": batch.column("toxic"), "mean": found[:, 0], "most": found[:, 1]}

    rows = np.array(sorted(map(tuple, arrow_map(known, sum_up, "toxic int, mean double, most double").collect())))
    detector.regression = regression(rows[:, 1:], (rows[:, 0] == 1).astype(float))
    return detector


def excerpt(raw: bytes, windows: int = SAMPLE_WINDOWS) -> bytes:
    """Words of the text, or of so many windows, spread evenly, if it has more; 64 bytes of a word at most."""
    counts = [len(words_of(np.frombuffer(block, np.uint8))[0]) for block, _ in blocks(raw)]
    starts = window_starts(sum(counts))
    spans = [(0, sum(counts))]
    if len(starts) > windows:
        spans = [(s, s + WINDOW) for s in starts[np.linspace(0, len(starts) - 1, windows).astype(int)].tolist()]
    found, at = [], 0
    for (block, _), n in zip(blocks(raw), counts):
        chosen = [(max(0, a - at), min(n, b - at)) for a, b in spans if a < at + n and b > at]
        at += n
        if chosen:
            words = plain(np.frombuffer(block, np.uint8)).tobytes().replace(b"\0", b" ").split()
            found += [x[:64] for a, b in chosen for x in words[a:b]]
    return b" ".join(found)


def scored(documents: DataFrame, detector: Detector, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(detector)  # a fixed number of weights

    def work(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "score": shared.value.scores(raw_texts(batch.column("text")))}

    rows = arrow_map(texts(documents), work, "doc_id bigint, score double")
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))

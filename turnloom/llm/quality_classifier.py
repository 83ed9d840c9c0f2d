"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

The model is trained on the driver from a bounded sample of labelled rows and scores every text
in Arrow batches. Pairwise interactions cost linear time: the sum over pairs of
<v_i, v_j> x_i x_j is half of the square of the sum minus the sum of squares, factor by factor.

Defined cases: null and empty texts have only the structure features and get a score; without
labelled rows of both classes every score is the share of label 1, or 0.5 without any; rows with
equal ids are scored one by one; a label whose doc_id or quality is null teaches nothing.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import arrow_map, lowest, raw_texts, texts

WORD_SLOTS = 4096
#: At most this many labelled rows, those with the smallest digests of their ids, are learned from.
SAMPLE_ROWS = 6_000
FACTORS = 8
_STRUCTURE = 12
SIZE = WORD_SLOTS + _STRUCTURE
_SYMBOLS = b"#*$%&|<>"


def structure(raw: bytes, words: list[bytes]) -> list[float]:
    """Shares that describe the form of a text, and its length as metadata; all within 0 and 1."""
    size, n = max(1, len(raw)), max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper = sum(map(raw.count, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return [
        1.0,
        min(1.0, np.log1p(len(words)) / 12),
        min(1.0, np.log1p(len(raw)) / 14),
        min(1.0, len(raw) / n / 16),
        min(1.0, 8 * sum(map(raw.count, _SYMBOLS)) / size),
        min(1.0, 2 * upper / size),
        min(1.0, 8 * (raw.count(b"!") + raw.count(b"?")) / size),
        min(1.0, 8 * (raw.count(b".") + raw.count(b",")) / size),
        len(set(words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, n / max(1, len(lines)) / 100),
        min(1.0, 8 * sum(map(raw.count, b"0123456789")) / size),
    ]


def features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of one text: log word counts scaled to length 1, then the structure."""
    words = raw.split()
    slots = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % WORD_SLOTS
    counts = np.bincount(slots, minlength=WORD_SLOTS) if len(words) else np.zeros(WORD_SLOTS)
    used = np.flatnonzero(counts)
    values = np.log1p(counts[used])
    values /= max(1e-9, float(np.sqrt((values**2).sum())))
    return (
        np.concatenate([used, np.arange(WORD_SLOTS, SIZE)]),
        np.concatenate([values, structure(raw, words)]))


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, slots: np.ndarray, values: np.ndarray) -> float:
        v = self.factors[slots] * values[:, None]
        pairs = 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return self.bias + float(self.weights[slots] @ values) + pairs


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12,
          rate: float = 0.02, decay: float = 1e-5, batch: int = 64) -> Machine:
    """Logistic loss by Adam over small batches in a fixed random order."""
    share = float(labels.mean()) if len(labels) else 0.5
    if not 0 < share < 1:
        share = min(max(share, 1e-3), 1 - 1e-3) if len(labels) else 0.5
        return Machine(float(np.log(share / (1 - share))), np.zeros(SIZE), np.zeros((SIZE, FACTORS)))
    draw = np.random.default_rng(7)
    part = [np.array([np.log(share / (1 - share))]), np.zeros(SIZE), draw.normal(0, 0.02, (SIZE, FACTORS))]
    first, second = [np.zeros_like(p) for p in part], [np.zeros_like(p) for p in part]
    step = 0
    for _ in range(epochs):
        order = draw.permutation(len(rows))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            x = np.zeros((len(chosen), SIZE))
            for i, row in enumerate(chosen):
                x[i, rows[row][0]] = rows[row][1]
            sums = x @ part[2]
            squares = (x**2) @ (part[2] ** 2)
            z = part[0] + x @ part[1] + 0.5 * (sums**2 - squares).sum(1)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[chosen]) / len(chosen)
            grads = [
                np.array([error.sum()]),
                x.T @ error + decay * part[1],
                x.T @ (error[:, None] * sums) - part[2] * ((x**2).T @ error)[:, None] + decay * part[2]]
            step += 1
            for p, g, m, v in zip(part, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g**2 - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Machine(float(part[0][0]), part[1], part[2])


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves no rest modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_from(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Learn from labelled rows outside the held-out fifth, `sample_rows` at most.

    Each row sends WORD_SLOTS sparse values at most to the driver, which bounds the whole.
    """
    marked = lowest(
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))),
        ["doc_id"], sample_rows)

    def work(batch: pa.RecordBatch) -> dict:
        found = [features(raw) for raw in raw_texts(batch.column("text"))]
        return {
            "doc_id": batch.column("doc_id"), "quality": batch.column("quality"),
            "slots": [a.astype("<u2").tobytes() for a, _ in found],
            "amounts": [b.astype("<f4").tobytes() for _, b in found]}

    rows = arrow_map(
        texts(documents).join(F.broadcast(marked), "doc_id"),  # at most sample_rows pairs of integers
        work, "doc_id bigint, quality int, slots binary, amounts binary")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "slots", "amounts").limit(sample_rows).collect()
    labels_ = np.array([float(r["quality"] == 1) for r in rows])
    return train([
        (np.frombuffer(r["slots"], "<u2").astype(np.int64), np.frombuffer(r["amounts"], "<f4").astype(float))
        for r in rows], labels_)


def scored(documents: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(machine)  # a fixed number of weights

    def work(batch: pa.RecordBatch) -> dict:
        model = shared.value
        margins = [model.margin(*features(raw)) for raw in raw_texts(batch.column("text"))]
        return {
            "doc_id": batch.column("doc_id"),
            "score": 1 / (1 + np.exp(-np.clip(np.array(margins), -30, 30)))}

    rows = arrow_map(texts(documents), work, "doc_id bigint, score double")
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))

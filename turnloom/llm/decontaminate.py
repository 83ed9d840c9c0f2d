"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Windows of a ladder of sizes slide over every text; each item uses the largest size that fits into
it with room for the step, and the next ones down to half of that, so a window of an untouched
copy always lies fully inside the item and meets one of the item's own windows bit for bit. Each
fingerprint of 64 bits is looked up by its four blocks of 16 bits with one flipped bit each: by the
pigeonhole principle this finds every item fingerprint within 7 bits. What is found is compared
with the item by the weighted Jaccard similarity of five-word shingles, at every start around it.

The benchmark is a stated query set: it is taken in blocks of bounded size, each broadcast and held
against all rows. Nothing of the documents is shuffled or gathered.

Defined cases: null and empty texts hold nothing; items without words are in nothing; items of
fewer than five words are one shingle; texts shorter than an item are compared as a whole; rows
with equal ids are scanned one by one; equal items are all reported; of equally similar places
the first counts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import arrow_map, raw_texts, rolling, scratch, small_batches, split_batch, texts

SIMILARITY = 0.75
SHINGLE = 5
RADIUS = 7
LEAST_HALF = 8
LADDER = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128)
#: Words of the items of one block; what is broadcast is a fixed multiple of this.
BLOCK_WORDS = 200_000
_PIECE = 1 << 15
_ONE_BIT = np.array([0, *(1 << i for i in range(16))], np.uint64)


def step_of(size: int) -> int:
    return max(1, size // 4)


def sizes_of(n_words: int) -> list[int]:
    """Window sizes of an item: the largest that fits with its step, and one of about half."""
    fits = [x for x in LADDER if x + step_of(x) - 1 <= n_words]
    if not fits:
        return []
    half = [x for x in fits if LEAST_HALF <= x <= max(LEAST_HALF, fits[-1] // 2)]
    return sorted({fits[-1], *half[-1:]})


def offsets_of(n_words: int, size: int) -> np.ndarray:
    """Windows of an item that are indexed: a whole step's worth at start, middle and end.

    Any copy of one of these stretches holds a window of the text's grid, whatever its offset; a
    change in one place of an item leaves one of the stretches untouched.
    """
    step, last = step_of(size), n_words - size
    runs = [np.arange(x, x + step) for x in (0, (last - step) // 2, last - step + 1)]
    return np.unique(np.clip(np.concatenate(runs), 0, last))


def fingerprints(sums: np.ndarray, size: int, step: int) -> np.ndarray:
    """SimHash of each window of `size` words, every `step` words: majority of each bit."""
    return majority(sums[:, size::step] - sums[:, : sums.shape[1] - size : step], size)


def windows_of(starts: np.ndarray, size: int) -> np.ndarray:
    """First words of the windows, every step from each text's first word, that lie inside a text."""
    step = step_of(size)
    counts = np.maximum(0, (np.diff(starts) - size) // step + 1)
    firsts = np.cumsum(counts) - counts
    return np.repeat(starts[:-1], counts) + step * (np.arange(counts.sum()) - np.repeat(firsts, counts))


def majority(counts: np.ndarray, size: int) -> np.ndarray:
    """One number of 64 bits of each window's counts."""
    lanes = np.ascontiguousarray(counts.T).view(np.uint8)
    return np.packbits(lanes > size // 2, axis=1, bitorder="little").view(np.uint64).ravel()


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """Running counts of set bits, one byte each, eight counts to a number.

    Counts run over into each other, but the difference of two sums is again exact while a window
    has fewer than 256 words.
    """
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
    sums = np.zeros((8, len(hashes) + 1), np.uint64)
    np.cumsum(bits.T, axis=1, out=sums[:, 1:])
    return sums


class Blocks:
    """Multi-index over fingerprints: all within RADIUS of a query are found."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.starts, self.members = [], []
        for block in range(4):
            keys = (values >> np.uint64(16 * block)) & np.uint64(0xFFFF)
            near = (keys[:, None] ^ _ONE_BIT[None, :]).ravel().astype(np.int64)
            self.members.append((np.argsort(near, kind="stable") // len(_ONE_BIT)).astype(np.int32))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(near, minlength=1 << 16))]).astype(np.int32))

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query number, value number) of every pair within RADIUS bits."""
        found = []
        for block in range(4):
            keys = ((queries >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.int64)
            first = self.starts[block][keys]
            counts = self.starts[block][keys + 1] - first
            some = np.flatnonzero(counts)
            counts = counts[some]
            query = np.repeat(some, counts)
            inside = np.arange(len(query)) - np.repeat(np.cumsum(counts) - counts, counts)
            value = self.members[block][np.repeat(first[some], counts) + inside]
            close = np.bitwise_count(queries[query] ^ self.values[value]) <= RADIUS
            found.append(np.stack([query[close], value[close].astype(np.int64)]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pairs[0], pairs[1]


def shingles(hashes: np.ndarray) -> np.ndarray:
    return rolling(hashes, SHINGLE) if len(hashes) >= SHINGLE else rolling(hashes, max(1, len(hashes)))


def similarity(a: Counter, b: Counter, weights: dict[int, float], usual: float) -> float:
    """Sum of the smaller over sum of the larger weighted counts."""
    total = sum(weights.get(k, usual) * n for k, n in a.items()) + sum(weights.get(k, usual) * n for k, n in b.items())
    both = sum(weights.get(k, usual) * min(n, b[k]) for k, n in a.items() if k in b)
    return both / (total - both) if total > both else float(bool(total))


@dataclass
class Item:
    item_id: int | None
    hashes: np.ndarray
    shingles: Counter


class Index:
    """Fingerprints and shingles of a block of benchmark items.

    `total` items of the whole benchmark have words, and `often` tells how many of them have each of
    the block's shingles, if more than one has; without them the block is the whole benchmark.
    """

    def __init__(self, items: list[tuple[int | None, bytes]], total: int | None = None, often: dict[int, int] | None = None):
        self.items = []
        for item_id, raw in items:
            _, hashes, _ = split_batch([raw.lower()])
            if len(hashes):
                self.items.append(Item(item_id, hashes, Counter(shingles(hashes).tolist())))
        shown = Counter(k for item in self.items for k in item.shingles)
        total, often = (len(self.items), shown) if often is None else (total, often)
        self.usual = float(np.log1p(max(1, total)))
        self.weights = {k: float(np.log1p(total / n)) for k, n in often.items() if n > 1}
        self.known = np.sort(np.fromiter(shown, np.uint64, len(shown)))
        self.classes: dict[int, tuple[Blocks, np.ndarray, np.ndarray]] = {}
        found: dict[int, list] = {}
        for number, item in enumerate(self.items):
            for size in sizes_of(len(item.hashes)):
                offsets = offsets_of(len(item.hashes), size)
                prints = fingerprints(bit_sums(item.hashes), size, 1)[offsets]
                found.setdefault(size, []).append((prints, np.full(len(prints), number), offsets))
        for size, parts in sorted(found.items()):
            prints, owners, places = (np.concatenate(x) for x in zip(*parts))
            self.classes[size] = (Blocks(prints), owners, places)

    def candidates(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows (window, item number, place where the item would start), of windows near an item's.

        The texts stand in a row; each has its own grid of windows from its first word on.
        """
        found = [np.empty((0, 3), np.int64)]
        most = max(self.classes, default=0)
        grids = {size: windows_of(starts, size) for size in self.classes}
        for at in range(0, len(hashes) if most else 0, _PIECE):
            sums = bit_sums(hashes[at : at + _PIECE + most - 1])
            for size, (blocks, owners, places) in self.classes.items():
                lo, hi = np.searchsorted(grids[size], [at, at + _PIECE])
                window = grids[size][lo:hi]
                if not len(window):
                    continue
                inside = window - at
                query, value = blocks.near(majority(sums[:, inside + size] - sums[:, inside], size))
                window = window[query]
                found.append(np.stack([window, owners[value], window - places[value]], axis=1))
        return np.concatenate(found)

    def holds(self, hashes: np.ndarray, least: float, found: list[tuple[int, int]]) -> dict[int, tuple[float, int]]:
        """Best similarity and its place, for each item that one text holds."""
        own = shingles(hashes)
        met: dict[int, tuple[float, int]] = {}
        tried: dict[int, set[int]] = {}
        spots = np.searchsorted(self.known, own)
        hit = np.zeros(len(own) + 1, np.int64)
        if len(self.known):
            np.cumsum(self.known[np.minimum(spots, len(self.known) - 1)] == own, out=hit[1:])
        for number, start in found:
            item = self.items[number]
            n = len(item.hashes)
            slack = max(2, n // 4)
            lo, hi = max(0, start - slack), min(max(0, len(hashes) - n), start + slack)
            width = n - SHINGLE + 1 if n >= SHINGLE else 1
            if n >= SHINGLE and hit[min(len(own), hi + width)] == hit[min(len(own), lo)]:
                continue
            for place in range(lo, hi + 1):
                if place in tried.setdefault(number, set()):
                    continue
                tried[number].add(place)
                if n >= SHINGLE:
                    there = Counter(own[place : place + width].tolist())
                else:
                    there = Counter(shingles(hashes[place : place + n]).tolist())
                alike = similarity(item.shingles, there, self.weights, self.usual)
                if alike >= least and alike > met.get(number, (0.0, 0))[0]:
                    met[number] = (alike, place)
        return met

    def batch(self, raws: list[bytes], least: float) -> list[dict[int, tuple[float, int]]]:
        """Items that each text holds; the texts are fingerprinted in one row."""
        _, hashes, starts = split_batch([raw.lower() for raw in raws])
        rows = self.candidates(hashes, starts)
        text = np.searchsorted(starts, rows[:, 0], "right") - 1
        rows = np.unique(np.stack([text, rows[:, 1], rows[:, 2] - starts[text]], axis=1), axis=0)
        out: list[dict[int, tuple[float, int]]] = [{} for _ in raws]
        if len(rows):
            edges = np.flatnonzero(np.diff(rows[:, 0])) + 1
            for part in np.split(rows, edges):
                i = int(part[0, 0])
                out[i] = self.holds(hashes[starts[i] : starts[i + 1]], least, part[:, 1:].tolist())
        return out


def _frequencies(items: DataFrame) -> tuple[int, DataFrame]:
    """How many items have words, and of each block's shingles that several items have, how many."""
    def work(batch: pa.RecordBatch) -> dict:
        found = {"block": batch.column("block"), "shingles": []}
        for raw in raw_texts(batch.column("text")):
            _, hashes, _ = split_batch([raw.lower()])
            found["shingles"].append(np.unique(shingles(hashes)).view(np.int64) if len(hashes) else [])
        return found

    small_batches(items.sparkSession)
    sets = scratch(arrow_map(items.select("block", "text"), work, "block bigint, shingles array<bigint>"))
    own = scratch(sets.select("block", F.explode("shingles").alias("shingle")).groupBy("block", "shingle").agg(F.count("*").alias("n")))
    often = own.groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1")
    return sets.where("size(shingles) > 0").count(), scratch(own.drop("n").join(often, "shingle"))


def indexes(benchmark: DataFrame):
    """The benchmark in blocks of about BLOCK_WORDS words, one after another.

    Shingles weigh by the items of all blocks, so the blocks' number changes no similarity.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("text is not null")
    words = items.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    blocks = words // BLOCK_WORDS + 1
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    total, often = _frequencies(items) if blocks > 1 else (None, None)  # one block knows all items
    for block in range(blocks):
        rows = items.where(F.col("block") == block).orderBy("item_id", "text").collect()
        counts = None if often is None else {
            r["shingle"] % (1 << 64): r["n"] for r in often.where(F.col("block") == block).collect()}
        yield Index([(r["item_id"], r["text"].encode()) for r in rows], total, counts)


SCHEMA = "doc_id bigint, item_id bigint, similarity double, start_word bigint, n_words bigint"


def contaminated(documents: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Pairs of documents and items they hold, with the best similarity and where it is."""
    rows, out = texts(documents), None
    for index in indexes(benchmark):
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def work(batch: pa.RecordBatch, shared=shared) -> dict:
            index = shared.value
            found = [
                (doc_id, index.items[k].item_id, alike, place, len(index.items[k].hashes))
                for doc_id, met in zip(
                    batch.column("doc_id").to_pylist(), index.batch(raw_texts(batch.column("text")), least))
                for k, (alike, place) in sorted(met.items())]
            names = ("doc_id", "item_id", "similarity", "start_word", "n_words")
            return {name: [x[i] for x in found] for i, name in enumerate(names)}

        part = arrow_map(rows, work, SCHEMA)
        out = part if out is None else out.unionAll(part)
    return out


def _flag(shared, least: float):
    def flag(text: pa.Array) -> pa.Array:
        return pa.array([bool(x) for x in shared.value.batch(raw_texts(text), least)], pa.bool_())

    return F.arrow_udf(flag, "boolean")


def holds_any(documents: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> list[Column]:
    """Boolean columns, one per block of the benchmark: whether the row's text holds an item."""
    small_batches(documents.sparkSession)
    context = documents.sparkSession.sparkContext
    text = F.col("text").cast("string")
    return [_flag(context.broadcast(index), least)(text) for index in indexes(benchmark)]


def decontaminated(documents: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows, with all their columns, that hold no benchmark item."""
    for flag in holds_any(documents, benchmark, least):
        documents = documents.where(~flag)
    return documents

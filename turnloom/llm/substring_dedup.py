"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

Documents are dealt into batches by a digest of their id. A batch sends each of its window hashes
once, with the smallest doc_id that has it, to the hash's bucket; so a window that a third of all
texts share reaches its bucket once per batch. The bucket answers, per batch, which of those
hashes start in an earlier document of another batch, one bit each. The batch then joins the
repeated windows of each text into maximal intervals and removes the words they cover.

Buckets and batches grow in number with the table, so that neither grows in size. Window hashes
have 64 bits; among n different windows about n * n / 2**65 pairs are expected to collide.

Defined cases: a null text has no words; rows with a null doc_id stay whole and are no source; rows
with equal ids do not remove each other's windows; texts of fewer than `width` words stay whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import raw_texts, rolling, split_batch, texts

WIDTH = 13
BATCH_CHARS = 4 << 20
BUCKET_WINDOWS = 1 << 20
_FOUND = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


@dataclass(frozen=True)
class Layout:
    """Numbers of batches and buckets of one run."""

    batches: int
    buckets: int

    @staticmethod
    def of(rows: DataFrame) -> Layout:
        chars = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
        return Layout(max(16, chars // BATCH_CHARS + 1), max(16, chars // (4 * BUCKET_WINDOWS) + 1))


def windows(raws: list[bytes], width: int):
    """Words of each text, hash and text number of each window, and first place of each text's windows."""
    lists, hashes, starts = split_batch(raws)
    everything = rolling(hashes, width)
    inside = np.zeros(len(everything), bool)
    counts = np.maximum(np.diff(starts) - width + 1, 0)
    for start, count in zip(starts[:-1][counts > 0], counts[counts > 0]):
        inside[start : start + count] = True
    firsts = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=firsts[1:])
    return lists, everything[inside], np.repeat(np.arange(len(raws)), counts), firsts


def first_owners(hashes: np.ndarray, ids: np.ndarray):
    """Distinct hashes in order, the smallest id of each, and which of them each window has."""
    distinct, where = np.unique(hashes, return_inverse=True)
    owners = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(owners, where, ids)
    return distinct, owners, where


def _sorted_batch(table: pa.Table):
    ids = np.array(table.column("doc_id").to_pylist(), np.int64)
    return ids, raw_texts(table.column("text"))


def _bucket_of(distinct: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash; rises with the hash, so a bucket's hashes stand together."""
    return ((distinct >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _runs(bucket: np.ndarray):
    """(bucket, start, stop) of each bucket's hashes."""
    edges = np.flatnonzero(np.diff(bucket)) + 1
    stops = [*edges.tolist(), len(bucket)]
    return zip(bucket[[0, *edges]].tolist(), [0, *stops[:-1]], stops) if len(bucket) else ()


def _ask(rows: DataFrame, layout: Layout, width: int) -> DataFrame:
    """Per batch and bucket: distinct hashes and their first owners, packed."""
    def work(table: pa.Table) -> pa.Table:
        ids, raws = _sorted_batch(table)
        _, hashes, owner, _ = windows(raws, width)
        distinct, owners, _ = first_owners(hashes, ids[owner])
        parts = list(_runs(_bucket_of(distinct, layout.buckets)))
        batch = table.column("_batch")[0].as_py()
        lists, places = [], []
        for _, a, b in parts:
            known, place = np.unique(owners[a:b], return_inverse=True)
            lists.append(known.astype("<i8").tobytes())
            places.append(place.astype("<u2" if len(known) < 1 << 16 else "<u4").tobytes())
        return pa.table({
            "_bucket": pa.array([x for x, _, _ in parts], pa.int64()),
            "_batch": pa.array([batch] * len(parts), pa.int64()),
            "hashes": pa.array([distinct[a:b].astype("<u8").tobytes() for _, a, b in parts], pa.binary()),
            "owners": pa.array(lists, pa.binary()), "places": pa.array(places, pa.binary())})

    return rows.groupBy("_batch").applyInArrow(
        work, "_bucket bigint, _batch bigint, hashes binary, owners binary, places binary")


def _owners(known: bytes, places: bytes, count: int) -> np.ndarray:
    kind = "<u2" if len(places) == 2 * count else "<u4"
    return np.frombuffer(known, "<i8")[np.frombuffer(places, kind)]


def _answer(asked: DataFrame) -> DataFrame:
    """Per bucket and batch: one bit per hash, set if a smaller id elsewhere has that window."""
    def work(table: pa.Table) -> pa.Table:
        given = [np.frombuffer(x, "<u8") for x in table.column("hashes").to_pylist()]
        sizes = [len(x) for x in given]
        owners = np.concatenate([
            _owners(k, p, n) for k, p, n in zip(
                table.column("owners").to_pylist(), table.column("places").to_pylist(), sizes)])
        values = np.concatenate(given)
        order = np.argsort(values, kind="stable")
        values = values[order]
        heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        least = np.minimum.reduceat(owners[order], heads)
        later = np.empty(len(values), bool)
        later[order] = owners[order] > np.repeat(least, np.diff([*heads, len(values)]))
        stops = np.cumsum(sizes)
        bits = [np.packbits(later[stop - n : stop]).tobytes() for n, stop in zip(sizes, stops)]
        return pa.table({
            "_batch": table.column("_batch"), "_bucket": table.column("_bucket"),
            "bits": pa.array(bits, pa.binary()), "size": pa.array(sizes, pa.int64())})

    return asked.groupBy("_bucket").applyInArrow(work, "_batch bigint, _bucket bigint, bits binary, size bigint")


def removed_words(n_words: int, repeated: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a repeated window: windows joined into maximal intervals."""
    edges = np.zeros(n_words + 1, np.int64)
    n = len(repeated)
    edges[:n] += repeated
    edges[width : width + n] -= repeated
    return np.cumsum(edges[:-1]) > 0


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _cut(width: int, layout: Layout):
    def work(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        ids, raws = _sorted_batch(table)
        lists, hashes, owner, firsts = windows(raws, width)
        distinct, owners, where = first_owners(hashes, ids[owner])
        elsewhere = np.zeros(len(distinct), bool)
        told = {b: (bits, n) for b, bits, n in zip(
            *(answers.column(x).to_pylist() for x in ("_bucket", "bits", "size")))}
        for bucket, a, b in _runs(_bucket_of(distinct, layout.buckets)):
            bits, n = told[bucket]
            if n != b - a:
                raise ValueError("an answer does not fit its batch")
            elsewhere[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
        repeated = elsewhere[where] | (ids[owner] > owners[where])
        out = []
        for i, words in enumerate(lists):
            gone = removed_words(len(words), repeated[firsts[i] : firsts[i + 1]], width)
            out.append((int(gone.sum()), _digest([w for w, g in zip(words, gone) if not g] if gone.any() else words)))
        return pa.table({
            "doc_id": pa.array(ids), "n_words": pa.array([len(x) for x in lists], pa.int64()),
            "n_removed": pa.array([x for x, _ in out], pa.int64()),
            "kept_sha256": pa.array([x for _, x in out], pa.string())})

    return work


def _whole(rows: DataFrame) -> DataFrame:
    """Rows that take no part: everything is kept."""
    from turnloom.llm.common import arrow_map

    def work(batch: pa.RecordBatch) -> dict:
        lists = [raw.split() for raw in raw_texts(batch.column("text"))]
        return {"doc_id": batch.column("doc_id"), "n_words": [len(x) for x in lists],
                "n_removed": [0] * len(lists), "kept_sha256": [_digest(x) for x in lists]}

    return arrow_map(rows, work, _FOUND)


def deduplicated(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """Words, removed words and digest of the rest of every row."""
    rows = texts(documents)
    layout = Layout.of(rows)
    dealt = rows.where("doc_id is not null").withColumn(
        "_batch", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(layout.batches)))
    answers = _answer(_ask(dealt, layout, width))
    found = dealt.groupBy("_batch").cogroup(answers.groupBy("_batch")).applyInArrow(_cut(width, layout), _FOUND)
    return found.unionByName(_whole(rows.where("doc_id is null")))

"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

1. A sketch of fixed width counts shingles; (count level, hash) is the global order, rare first.
2. Texts with equal sets form classes, represented by their smallest doc_id.
3. By the prefix principle two sets within the threshold share a shingle among their rarest ones.
   Rarest shingles are dealt into buckets; those that the sketch shows to be hot into several, whose
   leaders meet again. Few holders of a shingle are all paired; of many, each is paired with the
   one that has fewest rare shingles of its own, which is next to what the others are copies of.
   A pair is dropped if the rarest shingles that it shares and all of either set beyond those
   compared could not reach the threshold.
4. The order is cut into fragments of equal weight. Each candidate pair's overlap is counted per
   fragment, in groups of a bounded number of partners, and summed per pair: the counts are exact.
   The rare fragments come first; a pair goes on to the others only if it can still be similar.
5. Linked classes are joined into components. Holders of a shingle that are still in different ones
   meet in blocks of bounded size: those that may be similar send their fragments, each pair of blocks
   and fragment gives one matrix of partial overlaps, the matrices are summed per pair of blocks, and of
   the links found there only as many leave as join components.

Any order gives the same links; the sketch only decides how few candidates there are.

Defined cases: null and empty texts have no shingles and are alone; texts of fewer words than a
shingle have one, their whole sequence; rows with a null doc_id are alone and have no component;
rows that repeat a doc_id are one document with several texts, linked if one of them is; ties are
settled by the smaller id; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import arrow_map, give_back, raw_texts, rolling, scratch, split_batch, texts
from turnloom.llm.components import components

WIDTH = 5
SLOT_BITS = 22
_SHIFT = np.uint64(64 - SLOT_BITS)
_BLOCK = 1 << 15  # slots whose counts travel together
FRAGMENTS = 16
EARLY = 5  # fragments that are counted first
PAIRED = 8  # holders of one shingle that are all paired
PART = 4096  # holders of a hot shingle that meet in one bucket
BLOCK = 256  # classes that meet in one group after the first links
PARTNERS = 256  # partners of one class that are counted in one group
BUCKET = 1 << 19  # postings of a bucket


def shingle_hashes(raws: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, in lower case; a short text is one shingle."""
    _, hashes, starts = split_batch([raw.lower() for raw in raws])
    everything = rolling(hashes, width)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(everything[a : b - width + 1]))
        elif b > a:
            out.append(rolling(hashes[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


@dataclass(frozen=True)
class Order:
    """The global order: count levels of the slots, parts of hot ones, and where fragments end."""

    levels: np.ndarray
    parts: np.ndarray
    pivots: np.ndarray

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """Sorted keys of a set: level in the top six bits, then the hash."""
        level = self.levels[(hashes >> _SHIFT).astype(np.int64)].astype(np.uint64)
        return np.sort((level << np.uint64(58)) | (hashes >> np.uint64(6)))

    @staticmethod
    def of(counts: np.ndarray) -> Order:
        # what a slot has beyond the mean tells of frequent shingles; the noise of the rest only
        # decides which rare shingles come first
        excess = np.maximum(0, counts - np.ceil(counts.mean()))
        levels = np.minimum(63, np.floor(1.5 * np.log2(1 + excess))).astype(np.uint8)
        most = np.zeros(64)
        np.maximum.at(most, levels, excess)
        weight = np.bincount(levels, weights=counts, minlength=64)
        ends = np.concatenate([[0], np.cumsum(weight)])
        pivots = []
        for i in range(1, FRAGMENTS):
            wanted = ends[-1] * i / FRAGMENTS
            level = min(63, int(np.searchsorted(ends, wanted, "right")) - 1)
            inside = (wanted - ends[level]) / max(1.0, weight[level])
            pivots.append((level << 58) + int(min(inside, 1 - 1e-9) * (1 << 58)))
        return Order(levels, (most // PART).astype(np.int64) + 1, np.array(pivots, np.uint64))


def count_sketch(documents: DataFrame, width: int = WIDTH) -> np.ndarray:
    """How many texts' shingles fall into each slot; a fixed number of slots reaches the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, np.int32)
        for batch in batches:
            for slots in shingle_hashes(raw_texts(batch.column("text")), width):
                np.add.at(counts, (slots >> _SHIFT).astype(np.int64), 1)
        blocks = [
            zlib.compress(counts[a : a + _BLOCK].astype("<i8").tobytes(), 1) for a in range(0, len(counts), _BLOCK)]
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(range(len(blocks)), pa.int32()), "counts": pa.array(blocks, pa.binary())})
        give_back()

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x.as_py()), "<i8") for x in table.column("counts"))
        return pa.table({
            "block": table.column("block")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "block int, counts binary"
    few = texts(documents).select("text").mapInArrow(count, schema).withColumn("_part", F.expr("spark_partition_id() div 64"))
    few = few.groupBy("block", "_part").applyInArrow(lambda t: add(t.select(["block", "counts"])), schema)
    rows = few.groupBy("block").applyInArrow(add, schema).collect()
    out = np.zeros(1 << SLOT_BITS, np.int64)
    for row in rows:
        out[row["block"] * _BLOCK :][:_BLOCK] = np.frombuffer(zlib.decompress(row["counts"]), "<i8")
    return out


def _set_table(documents: DataFrame, order: Broadcast, percent: int, width: int) -> DataFrame:
    """Size, digest and rarest shingles of every row's set."""
    def work(batch: pa.RecordBatch) -> dict:
        sets = [order.value.keys(x) for x in shingle_hashes(raw_texts(batch.column("text")), width)]
        digests = np.array([
            np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), "<i8") for x in sets]).reshape(-1, 2)
        return {
            "doc_id": batch.column("doc_id"), "n": [len(x) for x in sets],
            "d1": digests[:, 0], "d2": digests[:, 1],
            "rarest": [x[: prefix_size(len(x), percent)].tobytes() if len(x) else b"" for x in sets]}

    return arrow_map(texts(documents), work, "doc_id bigint, n bigint, d1 bigint, d2 bigint, rarest binary")


def prefix_size(n, percent: int):
    """How many of a set's n shingles must hold one that a similar set has there, too."""
    return n - (percent * n + 99) // 100 + 1


def needed(a, b, percent: int):
    """The overlap that sets of these sizes need."""
    return -(-percent * (a + b) // (100 + percent))


def _postings(classes: DataFrame, order: Broadcast, buckets: int) -> DataFrame:
    """Rarest shingles by bucket, packed: per batch of classes one row per bucket."""
    def work(batch: pa.RecordBatch) -> dict:
        ids = np.array(batch.column("rep").to_pylist(), np.int64)
        sizes = np.array(batch.column("n").to_pylist(), np.int64)
        lists = [np.frombuffer(x, "<u8") for x in batch.column("rarest").to_pylist()]
        keys = np.concatenate(lists)
        last = np.array([x[-1] for x in lists], np.uint64)
        owner = np.repeat(np.arange(len(ids)), [len(x) for x in lists])
        mixed = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        parts = order.value.parts[(keys >> np.uint64(58)).astype(np.int64)]
        salt = (ids[owner] * 2654435761 & 0x7FFFFFFF) % parts
        bucket = (mixed.astype(np.int64) + salt * 40503) % buckets
        by = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[by])) + 1
        found = {"bucket": [], "keys": [], "ids": [], "sizes": [], "last": [], "owners": [], "salts": []}
        for chosen in np.split(by, edges):
            own, place = np.unique(owner[chosen], return_inverse=True)
            hot = salt[chosen] if (parts[chosen] > 1).any() else np.empty(0, np.int64)
            found["bucket"].append(int(bucket[chosen[0]]))
            found["keys"].append(keys[chosen].tobytes())
            found["ids"].append(ids[own].astype("<i8").tobytes())
            found["sizes"].append(sizes[own].astype("<i8").tobytes())
            found["last"].append(last[own].tobytes())
            found["owners"].append(place.astype("<u2").tobytes())
            found["salts"].append(hot.astype("<i8").tobytes())
        return found

    return arrow_map(classes, work, 
        "bucket bigint, keys binary, ids binary, sizes binary, last binary, owners binary, salts binary")


def fits(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sizes allow the threshold."""
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _unpacked(table: pa.Table, part: int):
    """Keys, ids, set sizes, last rarest shingles and salts of a part of a bucket's postings."""
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for row in zip(*(table.column(x).to_pylist() for x in ("keys", "ids", "sizes", "last", "owners", "salts"))):
        keys = np.frombuffer(row[0], "<u8")
        mine = (keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(62) == part
        owner = np.frombuffer(row[4], "<u2")[mine]
        out[0].append(keys[mine])
        for place, kind in ((1, "<i8"), (2, "<i8"), (3, "<u8")):
            out[place].append(np.frombuffer(row[place], kind)[owner])
        out[4].append(np.frombuffer(row[5], "<i8")[mine] if row[5] else np.zeros(len(owner), np.int64))
    # of a run's holders the one whose rarest shingles reach furthest comes first
    by = np.lexsort((np.concatenate(out[1]), ~np.concatenate(out[3]), np.concatenate(out[4]), np.concatenate(out[0])))
    return [np.concatenate(x)[by] for x in out]


def _each_pair(a: np.ndarray, b: np.ndarray, least: np.ndarray):
    """Distinct pairs, how often each was met, and the smallest of its values."""
    by = np.lexsort((b, a))
    a, b, least = a[by], b[by], least[by]
    if not len(a):
        return a, b, least, least
    heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[heads], b[heads], np.diff([*heads, len(a)]), np.minimum.reduceat(least, heads)


def _meet(order: Broadcast, percent: int):
    """Pairs of one bucket, and the holders of shingles with many of them.

    kind 0: a pair with the shingles it shares here and how many it must share in all; 1 and 2: a
    holder, and a leader, of a shingle with many; 3: a holder's pair with its leader.
    """
    def some(table: pa.Table, part: int) -> pa.Table:
        keys, ids, sizes, last, salts = _unpacked(table, part)
        if not len(keys):
            return pa.table({x.split()[0]: pa.array([], pa.int64()) for x in _MET.split(", ")})
        fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (salts[1:] != salts[:-1])])
        heads = np.flatnonzero(fresh)
        counts = np.diff([*heads, len(keys)])
        run = np.repeat(np.arange(len(heads)), counts)
        hot = order.value.parts[(keys[heads] >> np.uint64(58)).astype(np.int64)] > 1
        many = (counts > PAIRED) | hot

        def alike(a, b):
            good = (ids[a] != ids[b]) & fits(sizes[a], sizes[b], percent)
            return a[good], b[good]

        pairs = [np.flatnonzero((run[step:] == run[:-step]) & ~many[run[step:]]) for step in range(1, PAIRED)]
        a, b = alike(np.concatenate(pairs), np.concatenate([x + i for i, x in enumerate(pairs, 1)]))
        short = np.where(last[a] <= last[b], a, b)  # all of this set's rarest shingles were compared
        rest = sizes[short] - prefix_size(sizes[short], percent)
        least = np.maximum(1, needed(sizes[a], sizes[b], percent) - rest)
        few_a, few_b, shared, wanted = _each_pair(np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), least)
        b = np.flatnonzero(many[run] & ~fresh)
        a, b = alike(heads[run[b]], b)
        star_a, star_b, _, _ = _each_pair(np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), sizes[a])
        held = np.flatnonzero(many[run])
        leads = fresh[held] & hot[run[held]]
        n, m = len(few_a), len(star_a)
        columns = {
            "kind": (np.zeros(n), np.full(m, 3), np.where(leads, 2, 1)),
            "key": (np.zeros(n), np.zeros(m), keys[held].view(np.int64)),
            "a": (few_a, star_a, ids[held]), "b": (few_b, star_b, sizes[held]),
            "shared": (shared, np.zeros(m), np.zeros(len(held))),
            "least": (wanted, np.zeros(m), np.zeros(len(held)))}
        return pa.table({k: pa.array(np.concatenate([x.astype(np.int64) for x in v])) for k, v in columns.items()})

    def work(table: pa.Table) -> pa.Table:
        found = pa.concat_tables([some(table, part) for part in range(4)])  # a quarter in memory at a time
        give_back()
        return found

    return work


_MET = "kind bigint, key bigint, a bigint, b bigint, shared bigint, least bigint"


def _among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id may be one of `ids`: a bitmap of fixed size lets few others through."""
    slot = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) + 1).alias("_slot")
    bits = ids.select(slot).groupBy(F.bitmap_bucket_number("_slot").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))
    marked = rows.where("doc_id is not null").select("*", slot)
    marked = marked.join(F.broadcast(bits), F.bitmap_bucket_number("_slot") == F.col("_bucket"))  # 512 rows of 4 KB at most
    return marked.where(F.expr("""bit_get(
        cast(conv(hex(substring(_bits, cast(bitmap_bit_position(_slot) div 8 as int) + 1, 1)), 16, 10) as int),
        cast(bitmap_bit_position(_slot) % 8 as int)) = 1""")).select(*rows.columns)


def _pieces(documents: DataFrame, pairs: DataFrame, order: Broadcast, width: int, first: int, last: int) -> DataFrame:
    """Fragments `first` to `last` of both sets of each pair, sent to the groups where they meet."""
    # written first, so that the join with it has shuffles of its own, which may be split
    parts = scratch(pairs.groupBy("a").agg((F.count("*") / PARTNERS + 1).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")
    needs = pairs.join(parts.hint("merge"), "a").select(F.col("b").alias("need"), F.struct("a", part.alias("part")).alias("to"))
    own = parts.select(F.col("a").alias("need"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "a")
    needs = needs.unionAll(own.select("need", F.struct("a", "part").alias("to")))
    wanted = scratch(needs.groupBy("need").agg(F.collect_list("to").alias("to")))  # as many as a class has groups
    rows = _among(texts(documents), wanted.select(F.col("need").alias("doc_id")))
    # by a merge at every size: what is wanted grows with the table
    rows = rows.join(wanted.hint("merge"), F.col("doc_id") == F.col("need")).select("doc_id", "text", "to")

    def cut(batch: pa.RecordBatch) -> dict:
        sets = [order.value.keys(x) for x in shingle_hashes(raw_texts(batch.column("text")), width)]
        found = {x: [] for x in ("a", "part", "fragment", "doc_id", "digest", "n", "keys")}
        for doc_id, targets, keys in zip(batch.column("doc_id").to_pylist(), batch.column("to").to_pylist(), sets):
            digest = int(np.frombuffer(hashlib.blake2b(keys.tobytes(), digest_size=8).digest(), "<i8")[0])
            ends = [0, *np.searchsorted(keys, order.value.pivots).tolist(), len(keys)]
            for fragment in range(first, last):
                packed = keys[ends[fragment] : ends[fragment + 1]].tobytes()
                for to in targets:
                    for name, value in zip(found, (to["a"], to["part"], fragment, doc_id, digest, len(keys), packed)):
                        found[name].append(value)
        return found

    schema = "a bigint, part int, fragment int, doc_id bigint, digest bigint, n bigint, keys binary"
    return arrow_map(rows, cut, schema, together=32)  # a row makes as many pieces as it has partners


def _partial(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Overlap of one class's fragment with that of each partner, and both fragments' sizes.

    A set counts once however many rows have it.
    """
    a = key[0].as_py()
    rows = list({x[:2]: x for x in zip(*(table.column(x).to_pylist() for x in ("doc_id", "digest", "n", "keys")))}.values())
    others = [x for x in rows if x[0] != a]
    lengths = np.array([len(x[3]) // 8 for x in others], np.int64)
    values = np.frombuffer(b"".join(x[3] for x in others), "<u8")
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    found = []
    for own, digest, n, keys in rows:
        if own == a:
            mine = np.frombuffer(keys, "<u8")
            hits = np.zeros(len(values) + 1, np.int64)
            if len(mine):
                spots = np.minimum(np.searchsorted(mine, values), len(mine) - 1)
                np.cumsum(mine[spots] == values, out=hits[1:])
            shared = hits[ends[1:]] - hits[ends[:-1]]
            found += [
                (a, digest, n, x[0], x[1], x[2], int(s), len(mine), int(k)) for x, s, k in zip(others, shared, lengths)]
    return pa.table({k: pa.array([x[i] for x in found], pa.int64()) for i, k in enumerate(_COUNTED)})


_PAIR = ("a", "da", "na", "b", "db", "nb")
_COUNTED = (*_PAIR, "shared", "ka", "kb")


def _counted(pieces: DataFrame) -> DataFrame:
    """Overlaps summed per pair over the fragments."""
    counts = pieces.groupBy("a", "part", "fragment").applyInArrow(_partial, ", ".join(f"{x} bigint" for x in _COUNTED))
    return counts.groupBy(*_PAIR).agg(*[F.sum(x).alias(x) for x in ("shared", "ka", "kb")])


def _overlaps(documents: DataFrame, pairs: DataFrame, order: Broadcast, percent: int, width: int) -> DataFrame:
    """Pairs (a, b) whose exact overlap, summed over fragments, reaches the threshold."""
    n, both = F.col("na") + F.col("nb"), F.col("shared")
    early = _counted(_pieces(documents, pairs, order, width, 0, EARLY))
    most = both + F.least(F.col("na") - F.col("ka"), F.col("nb") - F.col("kb"))
    early = scratch(early.where((100 + percent) * most >= percent * n))
    late = _counted(_pieces(documents, early.select("a", "b").distinct(), order, width, EARLY, FRAGMENTS))
    total = early.unionAll(late.join(early.select(*_PAIR), [*_PAIR], "left_semi").select(*early.columns))
    return (
        total.groupBy(*_PAIR).agg(F.sum("shared").alias("shared"))
        .where((100 + percent) * both >= percent * n).select("a", "b").distinct())


def may_be_similar(rows: list[tuple], others: list[tuple], percent: int) -> np.ndarray:
    """Which of the (size, rarest shingles) rows may reach the threshold with which of the others."""
    sizes, more = (np.array([x[0] for x in side], np.int64) for side in (rows, others))
    sets, more_sets = ([x[1] for x in side] for side in (rows, others))
    shared = count_matrix(sets, more_sets)
    last, more_last = (np.array([x[-1] for x in side], np.uint64) for side in (sets, more_sets))
    # how many of each set's rarest shingles are not beyond the other's last one
    seen = np.stack([np.searchsorted(x, more_last, "right") for x in sets])
    more_seen = np.stack([np.searchsorted(x, last, "right") for x in more_sets], axis=1)
    rest = np.minimum(sizes[:, None] - seen, more[None, :] - more_seen)
    return fits(sizes[:, None], more[None, :], percent) & (
        shared + rest >= needed(sizes[:, None], more[None, :], percent))


_APART = "lead bigint, one int, two int, block int, node bigint, component bigint"


def _still_apart(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Holders of one leader's shingles that may be similar to one of another component, by pair of blocks.

    members: lead, node, component. Every two blocks of a lead's holders meet in one group, which
    returns holders, not pairs of them.
    """
    sizes = scratch(members.groupBy("lead").agg((F.count("*") / BLOCK + 1).cast("int").alias("blocks")))
    spread = (
        members.join(sizes.hint("merge"), "lead")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    rows = spread.select(
        "lead", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "node", "component")
    held = _among(sets.where("n > 0").select("doc_id", "n", "rarest"), members.select(F.col("node").alias("doc_id")))
    rows = rows.join(held.withColumnRenamed("doc_id", "node").hint("merge"), "node")

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        one, two = key[1].as_py(), key[2].as_py()
        names = ("block", "node", "component", "n", "rarest")
        found = list(zip(*(table.column(x).to_pylist() for x in names)))
        sides = [[x for x in found if x[0] == block] for block in (one, two)]
        kept = set()
        if sides[0] and sides[1]:
            good = may_be_similar(*([(x[3], np.frombuffer(x[4], "<u8")) for x in side] for side in sides), percent)
            groups = [np.array([x[2] for x in side], np.int64) for side in sides]
            good &= groups[0][:, None] != groups[1][None, :]
            for side, some in zip(sides, (good.any(1), good.any(0))):
                kept |= {x[:3] for x, met in zip(side, some) if met}
        rows = [(key[0].as_py(), one, two, *x) for x in sorted(kept)]
        columns = [x.split() for x in _APART.split(", ")]
        return pa.table({
            name: pa.array([row[i] for row in rows], pa.int64() if kind == "bigint" else pa.int32()) for i, (name, kind) in enumerate(columns)})

    return rows.groupBy("lead", "one", "two").applyInArrow(work, _APART)


_HELD = np.dtype([("node", "<i8"), ("component", "<i8"), ("digest", "<i8"), ("n", "<i8")])


def count_matrix(rows: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many keys each of the sorted sets shares with each of the others."""
    shared = np.zeros((len(rows), len(others)), np.float32)
    values = np.concatenate([*rows, *others]) if rows or others else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(rows) + len(others)), [len(x) for x in [*rows, *others]])
    _, column, often = np.unique(values, return_inverse=True, return_counts=True)
    place = np.cumsum(often > 1) - 1
    kept = often[column] > 1
    owner, column = owner[kept], place[column[kept]]
    for at in range(0, int((often > 1).sum()), 4096):
        mine = (column >= at) & (column < at + 4096)
        has = np.zeros((len(rows) + len(others), 4096), np.float32)
        has[owner[mine], column[mine] - at] = 1
        shared += has[: len(rows)] @ has[len(rows) :].T
    return shared.astype(np.int32)


def forest(rows: np.ndarray, others: np.ndarray, links: np.ndarray) -> list[tuple[int, int]]:
    """Of the links, as few as join the same components: less than there are rows and others."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    out = []
    for i, j in np.argwhere(links).tolist():
        a, b = top(int(rows["component"][i])), top(int(others["component"][j]))
        if a != b:
            above[max(a, b)] = min(a, b)
            out.append((int(rows["node"][i]), int(others["node"][j])))
    return out


def _joining(documents: DataFrame, apart: DataFrame, order: Broadcast, percent: int, width: int) -> DataFrame:
    """Links (a, b) that join components of holders which are still apart.

    Each pair of blocks and fragment gives one matrix of partial overlaps, packed; matrices are summed
    per pair of blocks, where the threshold is applied: pairs of texts never become rows, and of their
    links only a spanning forest leaves.
    """
    targets = scratch(apart.groupBy("node").agg(
        F.collect_list(F.struct("lead", "one", "two", "block", "component")).alias("to")))  # as many as its lead has blocks
    rows = _among(texts(documents), targets.select(F.col("node").alias("doc_id")))
    rows = rows.join(targets.hint("merge"), F.col("doc_id") == F.col("node")).select("doc_id", "text", "to")
    schema = "lead bigint, one int, two int, fragment int, block int, component bigint, node bigint, digest bigint, n bigint, keys binary"

    def cut(batch: pa.RecordBatch) -> dict:
        sets = [order.value.keys(x) for x in shingle_hashes(raw_texts(batch.column("text")), width)]
        found = {x.split()[0]: [] for x in schema.split(", ")}
        for doc_id, to, keys in zip(batch.column("doc_id").to_pylist(), batch.column("to").to_pylist(), sets):
            digest = int(np.frombuffer(hashlib.blake2b(keys.tobytes(), digest_size=8).digest(), "<i8")[0])
            ends = [0, *np.searchsorted(keys, order.value.pivots).tolist(), len(keys)]
            for fragment in range(FRAGMENTS if len(keys) else 0):
                packed = keys[ends[fragment] : ends[fragment + 1]].tobytes()
                for x in to:
                    row = (x["lead"], x["one"], x["two"], fragment, x["block"], x["component"], doc_id, digest, len(keys), packed)
                    for name, value in zip(found, row):
                        found[name].append(value)
        return found

    def multiply(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        names = ("block", "node", "component", "digest", "n", "keys")
        # a set counts once however many rows have it
        found = sorted({x[:2] + x[3:4]: x for x in zip(*(table.column(x).to_pylist() for x in names))}.values())
        sides = [[x for x in found if x[0] == key[i].as_py()] for i in (1, 2)]
        counts = count_matrix(*([np.frombuffer(x[5], "<u8") for x in side] for side in sides))
        held = [np.array([x[1:5] for x in side], np.int64).reshape(-1, 4).tobytes() for side in sides]
        return pa.table({
            "lead": [key[0].as_py()], "one": pa.array([key[1].as_py()], pa.int32()), "two": pa.array([key[2].as_py()], pa.int32()),
            "rows": held[:1], "others": held[1:], "counts": [zlib.compress(counts.astype("<i4").tobytes(), 1)]})

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows, others = (np.frombuffer(table.column(x)[0].as_py(), _HELD) for x in ("rows", "others"))
        shared = sum(np.frombuffer(zlib.decompress(x.as_py()), "<i4").astype(np.int64) for x in table.column("counts"))
        shared = np.reshape(shared, (len(rows), len(others)))
        links = (100 + percent) * shared >= percent * (rows["n"][:, None] + others["n"][None, :])
        links &= rows["component"][:, None] != others["component"][None, :]
        found = forest(rows, others, links)
        give_back()
        return pa.table({k: pa.array([x[i] for x in found], pa.int64()) for i, k in enumerate("ab")})

    counted = arrow_map(rows, cut, schema, together=32).groupBy("lead", "one", "two", "fragment").applyInArrow(
        multiply, "lead bigint, one int, two int, rows binary, others binary, counts binary")
    return counted.groupBy("lead", "one", "two").applyInArrow(add, "a bigint, b bigint").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def joined(documents: DataFrame, percent: int = 75, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    spark = documents.sparkSession
    order = spark.sparkContext.broadcast(Order.of(count_sketch(documents, width)))
    sets = scratch(_set_table(documents, order, percent, width))
    held = sets.where("doc_id is not null and n > 0")
    classes = scratch(held.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")))
    firsts = held.join(classes.withColumnRenamed("rep", "doc_id").hint("merge"), ["n", "d1", "d2", "doc_id"])
    shown = sets.agg(F.sum(F.length("rarest") / 8).alias("n")).first()["n"] or 0
    buckets = max(16, int(shown) // BUCKET + 1)
    met = scratch(
        _postings(firsts.select(F.col("doc_id").alias("rep"), "n", "rarest"), order, buckets)
        .groupBy("bucket").applyInArrow(_meet(order, percent), _MET))
    few = (
        met.where("kind = 0").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("least").alias("least"))
        .where("shared >= least").select("a", "b"))
    leaders = scratch(met.where("kind = 2").groupBy("key").agg(F.min("a").alias("top")))
    tops = (
        met.where("kind = 2").join(leaders, "key").where("a > top")
        .select(F.col("top").alias("a"), F.col("a").alias("b")))
    stars = met.where("kind = 3").select("a", "b").unionAll(tops)
    pairs = scratch(few.unionAll(stars).distinct())
    links = scratch(_overlaps(documents, pairs, order, percent, width))

    # texts that share an id are one document
    reps = held.join(classes, ["n", "d1", "d2"]).select("doc_id", "rep")
    several = (
        reps.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.collect_set("rep").alias("all"))
        .where("a < b").select("a", F.explode("all").alias("b")))
    links = links.unionAll(several)
    groups = scratch(components(links))

    # holders of a shingle with many of them that ended in different components
    many = (
        met.where("kind in (1, 2)").select("key", F.col("a").alias("node"))
        .join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))
    # shingles with the same holders have the same lead, so these meet once
    open_keys = many.groupBy("key").agg(
        F.min("component").alias("x"), F.max("component").alias("y"),
        F.min(F.struct(F.xxhash64("node"), "node")).alias("lead"))
    open_keys = scratch(open_keys.where("x < y").select("key", F.col("lead.node").alias("lead")))
    members = scratch(many.join(open_keys, "key").select("lead", "node", "component").distinct())
    apart = scratch(_still_apart(members, sets, percent))
    if not apart.isEmpty():
        groups = scratch(components(links.unionAll(scratch(_joining(documents, apart, order, percent, width)))))

    found = classes.join(groups, F.col("rep") == F.col("node"), "left")
    found = found.select("n", "d1", "d2", F.coalesce("component", "rep").alias("component"))
    return (
        sets.drop("rarest").join(found, ["n", "d1", "d2"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"),
                F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")))


def keep_first(documents: DataFrame, percent: int = 75, width: int = WIDTH) -> DataFrame:
    """The rows, with all their columns, of the smallest doc_id of each component."""
    later = joined(documents, percent, width).where("doc_id != component_id").select(F.col("doc_id").alias("_later")).distinct()
    return documents.join(later, F.col("doc_id").cast("long") == F.col("_later"), "left_anti")

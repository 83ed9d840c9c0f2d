"""Merkle manifest of a dataset: digests, proofs and their folding by time-forward processing.

Nodes carry labels (tree, level, index), which order the computation. A node's digest is a message to
its parent, queued under the parent's label; whoever takes the smallest label finds all children there.
The queue is external: a shuffle deals messages into slices of labels (SLICE leaves under one node and
all that lies above them up to it), each slice is swept with a heap, and the slices' roots are the
messages of the next, 4,096 times smaller, round. The reversed sweep starts at the root: a slice gets
the proof suffix of its root, once, and delivers to each of its leaves its own siblings and that suffix.

One tree per value of `group`, whose subroots are the leaves of one more tree. Ranks come from sorted
ranges and the sizes of the ranges before, so a group with most of the rows is no task of its own.

Defined cases: a null value is `-` in a leaf; a null group is a tree of its own, the first one; a null id
sorts first and is never tampered with; ties of an id are ordered by leaf, and rows that repeat whole
have leaves of their own; columns that are named as fields but missing count as null; other columns are
not looked at; an empty table has no rows and no root.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import scratch

ARITY = 8
SLICE_LEVELS = 4
SLICE = ARITY**SLICE_LEVELS
RANGE_ROWS = 1 << 18
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest_of(values: list[Column]) -> Column:
    """H of the values: `-` if null, else byte count, colon and value."""
    shown = [x.cast("string") for x in values]
    return F.sha2(F.concat(*[
        F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in shown]).cast("binary"), 256)


def leaves(documents: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id") -> DataFrame:
    """tree, id, leaf, and the leaf after tampering where the id's crc32 is divisible by 3."""
    known = {x.lower(): x for x in documents.columns}
    column = {x: F.col(f"`{known[x]}`") if x in known else F.lit(None).cast("string") for x in (*fields, group, key)}
    ident = column[key].cast("long")
    struck = F.crc32(ident.cast("string").cast("binary")) % 3 == 0
    lowered = {"text": F.translate(column["text"].cast("string"), _UPPER, _UPPER.lower())}
    return documents.select(
        F.coalesce(F.concat(F.lit("v"), column[group].cast("string")), F.lit("n")).alias("tree"),
        ident.alias("id"), digest_of([column[x] for x in fields]).alias("leaf"),
        F.when(struck, digest_of([lowered.get(x, column[x]) for x in fields])).alias("tampered"))


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Add place (from 0 in its tree, by `order`) and total (rows of the tree).

    Rows are dealt into sorted ranges; rows alike in all columns are told apart by a drawn number, so
    many of them spread over ranges. Only a count per tree and range is gathered.
    """
    count = rows.count()
    ranges = max(16, count // RANGE_ROWS + 1)
    by = [F.col(tree).asc_nulls_first(), *[F.col(x).asc_nulls_first() for x in order], F.col("_draw")]
    dealt = scratch(  # written, as its borders are sampled anew by every run
        rows.withColumn("_draw", F.rand(11)).repartitionByRange(ranges, *by).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(tree, "_range").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(tree).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        tree, "_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy(tree)).alias("total"))
    inside = F.row_number().over(Window.partitionBy("_range", tree).orderBy(*by[1:])) - 1
    return (
        dealt.withColumn("place", inside).join(scratch(sizes), ["_range", tree])
        .withColumn("place", F.col("place") + F.col("_before")).drop("_range", "_draw", "_before"))


def levels_of(total: int) -> int:
    """Levels of a slice of a tree with so many nodes: all four if it has more slices than one."""
    levels = 0
    while levels < SLICE_LEVELS and ARITY**levels < total:
        levels += 1
    return levels


def sweep(digests: list[str], levels: int) -> Iterator[tuple[int, int, list[str]]]:
    """Level, index and children of each inner node, and at last the root: labels in their order.

    Every digest is queued under its parent's label and taken when that label is the smallest.
    """
    queue = [(1, i // ARITY, i, x) for i, x in enumerate(digests)]  # sorted, so a heap
    while queue:
        level, index = queue[0][:2]
        if level > levels:
            yield level, index, [queue[0][3]]
            return
        children = []
        while queue and queue[0][:2] == (level, index):
            children.append(heapq.heappop(queue)[3])
        yield level, index, children
        above = sha256("".join(children).encode()).hexdigest()
        heapq.heappush(queue, (level + 1, index // ARITY, index, above))


def slice_root(digests: list[str], levels: int) -> str:
    root = ""
    for _, _, children in sweep(digests, levels):
        root = children[0]
    return root


def paths(digests: list[str], levels: int, suffix: bytes) -> list[bytes]:
    """The way from each leaf to the root: per level its place in the run, how many siblings, and these.

    Labels are taken in falling order, parents before children, each handing its suffix down.
    """
    nodes = list(sweep(digests, levels))[:-1]
    handed = {(levels, 0): suffix}
    for level, index, children in reversed(nodes):
        rest = handed.pop((level, index))
        for place, _ in enumerate(children):
            others = "".join(children[:place] + children[place + 1 :]).encode()
            handed[level - 1, index * ARITY + place] = bytes([place, len(children) - 1]) + others + rest
    return [handed[0, i] for i in range(len(digests))]


def read_path(path: bytes) -> Iterator[tuple[int, list[str]]]:
    """Place in the run and siblings, level by level."""
    at = 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        text = path[at + 2 : at + 2 + 64 * n].decode()
        yield place, [text[64 * i : 64 * i + 64] for i in range(n)]
        at += 2 + 64 * n


def proof_digest(path: bytes) -> str:
    return sha256("".join("".join(siblings) for _, siblings in read_path(path)).encode()).hexdigest()


def fold(leaf: str, path: bytes) -> str:
    """The root that a leaf and its siblings give."""
    for place, siblings in read_path(path):
        leaf = sha256("".join([*siblings[:place], leaf, *siblings[place:]]).encode()).hexdigest()
    return leaf


def _sliced(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("slice", F.expr(f"place div {SLICE}"))


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("place")


def _roots(nodes: DataFrame) -> DataFrame:
    """tree, place, total, digest of the next round: one row per slice."""
    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = table.column("total")[0].as_py()
        root = slice_root(_in_order(table).column("digest").to_pylist(), levels_of(total))
        return pa.table({
            "tree": pa.array([key[0].as_py()], pa.string()), "place": pa.array([key[1].as_py()], pa.int64()),
            "total": pa.array([-(-total // SLICE)], pa.int64()), "digest": pa.array([root], pa.string())})

    return _sliced(nodes).select("tree", "slice", "place", "total", "digest").groupBy("tree", "slice").applyInArrow(
        work, "tree string, place bigint, total bigint, digest string")


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each round, and (tree, digest, total) of the roots; each round is a written table."""
    rounds, done = [nodes], None
    while True:
        above = scratch(_roots(rounds[-1]))
        done = above.where("total = 1") if done is None else done.unionAll(above.where("total = 1"))
        above = above.where("total > 1")
        if above.isEmpty():
            return rounds, done.select("tree", "digest")
        rounds.append(above)


_PATH = "tree string, slice bigint, path binary, subroot string"


def _handed(nodes: DataFrame, suffixes: DataFrame, work, schema: str) -> DataFrame:
    """Slices meet the suffix of their root, which travels once a slice."""
    def both(table: pa.Table, suffix: pa.Table) -> pa.Table:
        table = _in_order(table)
        total = table.column("total")[0].as_py()
        suffix = suffix.to_pylist()[0]
        found = paths(table.column("digest").to_pylist(), levels_of(total), suffix["path"])
        return work(table, found, suffix["subroot"])

    return _sliced(nodes).groupBy("tree", "slice").cogroup(suffixes.groupBy("tree", "slice")).applyInArrow(both, schema)


def descend(rounds: list[DataFrame], suffixes: DataFrame) -> DataFrame:
    """(tree, slice, path, subroot) of the first round's slices, from those of the trees' roots.

    A tree's root is the root of a slice of the last round that the tree takes part in.
    """
    def work(table: pa.Table, found: list[bytes], subroot: str) -> pa.Table:
        return pa.table({
            "tree": table.column("tree"), "slice": table.column("place"), "path": pa.array(found, pa.binary()),
            "subroot": pa.array([subroot] * len(found), pa.string())})

    handed = None
    for nodes in reversed(rounds[1:]):
        ends = nodes.where(f"total <= {SLICE} and place = 0").select("tree")
        mine = suffixes.join(ends, "tree", "left_semi")
        handed = scratch(_handed(nodes, mine if handed is None else mine.unionAll(handed), work, _PATH))
    ends = rounds[0].where(f"total <= {SLICE} and place = 0").select("tree")
    mine = suffixes.join(ends, "tree", "left_semi")
    return mine if handed is None else mine.unionAll(handed)


def manifest(documents: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id") -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, path, folded_root and verified of every row.

    path holds per level one byte of place, one of count, and the siblings' digests.
    """
    def leaf_rows(table: pa.Table, found: list[bytes], subroot: str) -> pa.Table:
        given, struck = table.column("digest").to_pylist(), table.column("tampered").to_pylist()
        return pa.table({
            "id": table.column("id"), "leaf": table.column("digest"),
            "subroot": pa.array([subroot] * len(found), pa.string()),
            "proof_sha256": pa.array([proof_digest(x) for x in found], pa.string()),
            "path": pa.array(found, pa.binary()),
            "folded_root": pa.array([fold(y or x, path) for x, y, path in zip(given, struck, found)], pa.string())})

    first = scratch(ranked(leaves(documents, fields, group, key).withColumnRenamed("leaf", "digest"), "tree", ["id", "digest", "tampered"]))
    rounds, subroots = climb(first)
    trees = scratch(ranked(subroots.select(F.lit("").alias("top"), F.col("tree").alias("name"), "digest"), "top", ["name"]))
    top = trees.select(F.col("top").alias("tree"), "place", "total", "digest", "name")
    upper, roots = climb(top.drop("name"))
    root = roots.first()
    start = roots.select("tree", F.lit(0).cast("bigint").alias("slice"), F.lit(b"").alias("path"), F.col("digest").alias("subroot"))

    def tree_rows(table: pa.Table, found: list[bytes], _: str) -> pa.Table:
        return pa.table({
            "tree": table.column("name"), "slice": pa.array([0] * len(found), pa.int64()),
            "path": pa.array(found, pa.binary()), "subroot": table.column("digest")})

    suffixes = scratch(_handed(top, descend(upper, start), tree_rows, _PATH))
    rows = _handed(
        first, scratch(descend(rounds, suffixes)), leaf_rows,
        "id bigint, leaf string, subroot string, proof_sha256 string, path binary, folded_root string")
    said = F.lit(root["digest"] if root else None).cast("string")
    return rows.withColumns({"root": said, "verified": F.col("folded_root") == said})

"""Digest trees over files: two large sets are compared by the parts that differ.

Every path falls into one of 16**depth buckets by the digest of its name. A bucket's digest is that of its
sorted paths and digests, an inner node's that of its sixteen children's, up to the root. A saved tree keeps
its few nodes in one table and its leaves in one folder per bucket, so a comparison goes down where
digests differ and reads the leaves of these buckets only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.hashing import sha256
from turnloom.operators.resume import compare_checksums
from turnloom.operators.validate import guard
from turnloom.sources.sinks import replace_folder

#: Leaves that one bucket should hold, about, and folders that a tree has at most: 16**3.
LEAVES, DEEPEST = 4096, 3
_NONE = "0" * 64


def depth_for(files: int) -> int:
    """As deep as needed for buckets of about LEAVES leaves."""
    depth = 0
    while depth < DEEPEST and files > LEAVES * 16**depth:
        depth += 1
    return depth


def _bucket(depth: int) -> Column:
    return F.substring(F.md5(F.col("path").cast("binary")), 1, depth) if depth else F.lit("")


def _said(values: Column) -> Column:
    return sha256(F.array_join(values, "\n"))


def tree_nodes(digests: DataFrame, depth: int) -> DataFrame:
    """``level, prefix, sha256, files`` of every node; level 0 is the root. Empty nodes are left out.

    ``digests``: ``path, sha256`` with one row per path. Leaves of a bucket meet as digests of 32 bytes,
    already hashed one by one, so a bucket is one row of a bounded share of the files.
    """
    leaf = F.struct("path", "sha256")
    level = digests.groupBy(_bucket(depth).alias("prefix")).agg(
        _said(F.transform(F.sort_array(F.collect_list(leaf)), lambda x: F.concat_ws(":", x["path"], x["sha256"]))).alias("sha256"),
        F.count(F.lit(1)).alias("files"), F.count_distinct("path").alias("_paths"))
    level = guard(level, F.col("files") == F.col("_paths"), "a path has several digests").drop("_paths")
    nodes = level.withColumn("level", F.lit(depth))
    for up in range(depth - 1, -1, -1):
        child = F.struct(F.right("prefix", F.lit(1)).alias("digit"), "sha256")
        level = level.groupBy(F.substring("prefix", 1, up).alias("prefix")).agg(
            _said(F.transform(F.sort_array(F.collect_list(child)), lambda x: F.concat_ws(":", x["digit"], x["sha256"]))).alias("sha256"),
            F.sum("files").alias("files"))
        nodes = nodes.unionByName(level.withColumn("level", F.lit(up)))
    return nodes.select("level", "prefix", "sha256", "files")


def save_tree(digests: DataFrame, path: str, depth: int | None = None) -> None:
    """Write ``path, sha256`` rows and their tree. Trees to be compared must have one depth."""
    spark = digests.sparkSession
    told = digests.select("path", "sha256")
    depth = depth_for(told.count()) if depth is None else depth
    if not 0 <= depth <= DEEPEST:
        raise ValueError(f"a tree is 0 to {DEEPEST} levels deep")

    def write(new: str) -> None:
        leaves = told.withColumn("bucket", F.concat(F.lit("b"), _bucket(depth))).repartition("bucket")
        leaves.write.partitionBy("bucket").parquet(f"{new}/leaves")
        saved = spark.read.schema("path string, sha256 string, bucket string").parquet(f"{new}/leaves")
        tree_nodes(saved, depth).coalesce(1).write.parquet(f"{new}/nodes")

    replace_folder(spark, path, write)


def _nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("level int, prefix string, sha256 string, files long").parquet(f"{path}/nodes")


def differing_buckets(spark: SparkSession, left: str, right: str) -> list[str]:
    """Prefixes of the buckets that differ, found from the root down; at most 16**DEEPEST short texts."""
    sides = [_nodes(spark, x) for x in (left, right)]
    depths = {x.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0] for x in sides if not x.isEmpty()}
    if len(depths) > 1:
        raise ValueError("the trees differ in depth")
    depth, found = (depths or {0}).pop(), [""]
    for level in range(depth + 1):
        a, b = (
            x.where((F.col("level") == level) & F.substring("prefix", 1, max(0, level - 1)).isin(found)).select("prefix", F.col("sha256").alias(name))
            for x, name in zip(sides, ("a", "b")))
        met = a.join(b, "prefix", "full").where(F.coalesce("a", F.lit(_NONE)) != F.coalesce("b", F.lit(_NONE)))
        found = sorted(r["prefix"] for r in met.collect())
        if not found:
            return []
    return found


def saved_leaves(spark: SparkSession, path: str, buckets: list[str]) -> DataFrame:
    """Leaves of some buckets of a saved tree; the other folders are not listed or read."""
    schema = "path string, sha256 string"
    held = {r["prefix"] for r in _nodes(spark, path).where(F.col("prefix").isin(buckets)).select("prefix").collect()}
    folders = [f"{path}/leaves/bucket=b{x}" for x in buckets if x in held]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def compare_trees(spark: SparkSession, left: str, right: str) -> DataFrame:
    """What :func:`compare_checksums` says of all leaves, from those of differing buckets."""
    buckets = differing_buckets(spark, left, right)
    return compare_checksums(*(saved_leaves(spark, x, buckets) for x in (left, right)))

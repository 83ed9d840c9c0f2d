"""Gates and remainders that let a stopped run go on where it was."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom import fixed
from turnloom.functions.hashing import seeded_key


def remaining(inputs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inputs without a saved result."""
    return inputs.join(done.select(*keys), list(keys), "left_anti")


def prefix_status(saved: DataFrame, index: str = "index") -> DataFrame:
    """One row: saved rows, distinct indices, highest index, and whether they are 0..n-1."""
    return saved.agg(
        F.count(F.lit(1)).alias("saved"), F.count_distinct(index).alias("distinct"),
        F.coalesce(F.max(index), F.lit(-1)).alias("highest"),
        F.coalesce(F.min(index), F.lit(0)).alias("lowest"),
    ).withColumn(
        "is_prefix",
        (F.col("saved") == F.col("distinct")) & (F.col("saved") == F.col("highest") + 1)
        & (F.col("lowest") == 0))


def require_prefix(saved: DataFrame, inputs: int, index: str = "index") -> int:
    """Number of saved rows, once they are known to be the first of the inputs."""
    status = prefix_status(saved, index).first()
    if not status["is_prefix"] or status["saved"] > inputs:
        raise ValueError(fixed.ERROR_SAVED_ROWS)
    return status["saved"]


def prefix_mismatches(saved: DataFrame, examples: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """Saved rows that differ from the example at the same position."""
    wanted = examples.select(order, F.struct(*columns).alias("_wanted"))
    return saved.join(wanted, order, "left").filter(
        ~F.struct(*columns).eqNullSafe(F.col("_wanted"))).drop("_wanted")


def same_settings(previous: dict | None, current: dict) -> bool:
    canonical = lambda value: json.dumps(value, sort_keys=True, default=str)
    return previous is None or canonical(previous) == canonical(current)


def require_same_settings(previous: dict | None, current: dict) -> None:
    if not same_settings(previous, current):
        raise ValueError(fixed.ERROR_SETTINGS)


def compare_checksums(left: DataFrame, right: DataFrame) -> DataFrame:
    """Paths missing on a side or with different digests; empty when both sets agree."""
    a = left.select("path", F.col("sha256").alias("left_sha256"))
    b = right.select("path", F.col("sha256").alias("right_sha256"))
    return a.join(b, "path", "full").filter(~F.col("left_sha256").eqNullSafe(F.col("right_sha256")))


def spot_check(rows: DataFrame, key: str, size: int, seed: int = fixed.SEED) -> DataFrame:
    """``size`` rows for reading by eye: those whose keys have the smallest seeded digests.

    Every run, and every engine with md5, picks the same rows; each task keeps its first ``size``.
    """
    if size < 1:
        raise ValueError("a spot check needs a positive size")
    return rows.orderBy(seeded_key(seed, F.col(key)), key).limit(size)

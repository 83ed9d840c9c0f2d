"""Batches of bounded padded size: rows of about equal length go together.

A batch is padded to its longest row, so its cost is rows x longest. ``token_batches`` deals a whole table
into batches, as columns; ``pack`` does the same for the rows that a task holds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.operators.ordered import dense_position

_DIGITS = 4  # binary digits of a length that its class keeps: padding within a class is below 1/8


def padded_length(length: Column) -> Column:
    """The length rounded up to one with few binary digits; 0 counts as 1."""
    one = F.greatest(length.cast("long"), F.lit(1))
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), F.length(F.bin(one - 1)) - _DIGITS))
    return F.ceil(one / unit) * unit


def token_batches(rows: DataFrame, length: Column, order: str, budget: int) -> DataFrame:
    """Add ``padded`` and ``batch``: a row's length class and its batch's number in there.

    A batch holds as many rows of its class, in the order of an integer column, as fit ``budget`` when
    padded; a row longer than the budget is a batch. Positions are counted per block, so a class
    with most of the rows is no task of its own.
    """
    if budget < 1:
        raise ValueError("a token budget must be positive")
    placed = dense_position(rows.withColumn("padded", padded_length(length)), ["padded"], order, "_place")
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("padded")))
    return placed.withColumn("batch", F.floor(F.col("_place") / size)).drop("_place")


def batch_report(batched: DataFrame, length: str) -> DataFrame:
    """Per length class: rows, batches, tokens, and tokens after padding each batch to its longest row."""
    batches = batched.groupBy("padded", "batch").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(length).alias("_tokens"), F.max(length).alias("_longest"))
    return batches.groupBy("padded").agg(
        F.sum("_rows").alias("rows"), F.count(F.lit(1)).alias("batches"), F.sum("_tokens").alias("tokens"),
        F.sum(F.col("_rows") * F.col("_longest")).alias("padded_tokens"))


def pack(lengths: np.ndarray, budget: int, most: int | None = None) -> list[np.ndarray]:
    """Places of rows per batch, shortest rows first: rows x longest stays within ``budget``.

    A row over the budget is alone; ``most`` bounds the rows of a batch.
    """
    order = np.argsort(lengths, kind="stable")
    out, first = [], 0
    for i, place in enumerate(order):
        longest = max(1, int(lengths[place]))
        if i > first and ((i - first + 1) * longest > budget or i - first == most):
            out.append(order[first:i])
            first = i
    if first < len(order):
        out.append(order[first:])
    return out


def padding(lengths: np.ndarray, batches: list[np.ndarray]) -> float:
    """Share of padded tokens that are padding."""
    padded = sum(len(b) * int(lengths[b].max()) for b in batches)
    return 1 - int(lengths.sum()) / padded if padded else 0.0

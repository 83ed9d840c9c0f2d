"""Length and phrase profiles of reply texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom import fixed
from turnloom.functions import text
from turnloom.operators.selection import order_statistics


def _point_name(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")


def truncated_index_profile(
    rows: DataFrame, keys: Sequence[str], value: Column,
    points: Sequence[float] = fixed.PROFILE_POINTS,
) -> DataFrame:
    """Per group: rows, min, max and ``sorted[int(n * p)]`` of a whole number, for every point."""
    count = F.col("_rows").cast("double")
    profiled = order_statistics(rows, keys, value, {_point_name(p): (count * F.lit(float(p))).cast("long") for p in points})
    kind = rows.select(value.alias("v")).schema["v"].dataType
    names = ("min", "max", *map(_point_name, points))
    return profiled.withColumns({name: F.col(name).cast(kind) for name in names})


def message_counts(rows: DataFrame, keys: Sequence[str], messages: str = "messages") -> DataFrame:
    return rows.groupBy(*keys, F.size(messages).alias("messages")).agg(
        F.count(F.lit(1)).alias("rows"))


def phrase_hits(
    rows: DataFrame, reply: Column, phrases: Sequence[str] = fixed.CATCHPHRASES, keys: Sequence[str] = (),
) -> DataFrame:
    """Rows per phrase (once per row); phrases without a hit are left out.

    One pass: every phrase is a counter of the same aggregate.
    """
    return (
        rows.groupBy(*keys).agg(*[F.count_if(text.has_phrase(reply, p)).alias(p) for p in phrases])
        .unpivot(list(keys), [F.col(f"`{p}`") for p in phrases], "phrase", "rows")
        .filter("rows > 0")
    )


def phrase_summary(
    rows: DataFrame, reply: Column, phrases: Sequence[str] = fixed.CATCHPHRASES, keys: Sequence[str] = (),
) -> DataFrame:
    """All hits, rows with any hit, rows, and their percentage; one row per group."""
    hits = F.lit(0)
    for phrase in phrases:
        hits = hits + text.has_phrase(reply, phrase).cast("int")
    return (
        rows.select(*keys, hits.alias("_hits")).groupBy(*keys)
        .agg(F.sum("_hits").alias("hits"), F.count_if(F.col("_hits") > 0).alias("rows_with_hit"),
             F.count(F.lit(1)).alias("rows"))
        .withColumn("percent", F.lit(100.0) * F.col("rows_with_hit") / F.col("rows"))
    )


def dialogue_totals(lines: DataFrame, target: str = fixed.TARGET_SPEAKER) -> DataFrame:
    """Episodes, lines and lines of the target speaker."""
    return lines.groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("_lines"), F.count_if(F.lower("speaker") == target).alias("_target"),
    ).agg(
        F.count(F.lit(1)).alias("episodes"), F.sum("_lines").alias("lines"),
        F.sum("_target").alias("target_lines"))

"""Exact order statistics by radix selection: no sort, one to three scans.

A scan counts values per group and digit bucket, combined on the map side; only the buckets that hold a
wanted rank are looked at again, by their next digit. The first digit is the sign, the magnitude and 16
bits more, so whole numbers below 131,072 are settled by one scan, and any 64-bit ones by three.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.operators.ordered import first_digit, open_bits
from turnloom.session import settle

_NEXT = 24


def _placed(counts: DataFrame, keys: Sequence[str], digit: str) -> DataFrame:
    """Add how many rows of the group stand in buckets before; buckets are bounded in number."""
    before = Window.partitionBy(*keys).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def order_statistics(
    rows: DataFrame, keys: Sequence[str], value: Column, ranks: dict[str, Column],
) -> DataFrame:
    """Per group: ``rows, min, max`` and the value at each zero-based rank, a column over ``_rows``.

    ``value`` is a whole number; nulls are left out. A rank outside the group gives null.
    """
    keys = list(keys)
    inner = [f"_key{i}" for i in range(len(keys))] or ["_all"]
    named = [F.col(k).alias(i) for k, i in zip(keys, inner)] or [F.lit(1).alias("_all")]
    rows = rows.select(*named, value.cast("long").alias("_value")).where("_value is not null")
    rows = rows.withColumn("_digit", first_digit(F.col("_value")))
    counts = rows.groupBy(*inner, "_digit").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_value").alias("_low"), F.max("_value").alias("_high"))
    placed = _placed(counts, inner, "_digit").withColumn("_rows", F.sum("_n").over(Window.partitionBy(*inner)))

    def at(rank: Column) -> Column:
        here = (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
        return F.max(F.when(here, F.struct("_digit", "_low", "_high", (rank - F.col("_before")).alias("rank"))))

    found = settle(placed.groupBy(*inner).agg(
        F.max("_rows").alias("rows"), F.min("_low").alias("min"), F.max("_high").alias("max"),
        *[at(rank.cast("long")).alias(f"_at_{name}") for name, rank in ranks.items()]))
    columns = {name: F.col(f"_at_{name}")["_low"] for name in ranks}
    unsettled = [F.col(f"_at_{name}")["_low"] < F.col(f"_at_{name}")["_high"] for name in ranks]
    if ranks and not found.where(F.greatest(*[F.coalesce(x, F.lit(False)) for x in unsettled])).isEmpty():
        wide = found.select(*inner, F.explode(F.array(*[
            F.struct(F.lit(name).alias("point"), F.col(f"_at_{name}").alias("at")) for name in ranks])).alias("_t")).select(
                *inner, "_t.point", "_t.at.*").where("_low < _high")
        values = _refined(rows, wide, inner)
        found = _join(found, values, inner, "left")
        columns = {name: F.coalesce(F.col("_values")[name], column) for name, column in columns.items()}
    out = [F.col(i).alias(k) for k, i in zip(keys, inner)]
    return found.select(*out, "rows", "min", *[c.alias(n) for n, c in columns.items()], "max")


def _refined(rows: DataFrame, wanted: DataFrame, inner: list[str]) -> DataFrame:
    """Values of ranks whose first digit holds several: two more scans over these buckets only."""
    wanted = settle(wanted.select(*inner, "point", "_digit", "rank"))
    value, open_ = F.col("_value"), open_bits(F.col("_value"))
    buckets = wanted.select(*inner, "_digit").distinct()
    some = _join(rows, buckets, [*inner, "_digit"])
    second = F.call_function("shiftright", value, F.greatest(F.lit(0), open_ - _NEXT))
    counts = some.withColumn("_second", second).groupBy(*inner, "_digit", "_second").agg(F.count(F.lit(1)).alias("_n"))
    placed = _placed(counts, [*inner, "_digit"], "_second")
    in_second = settle(
        _join(wanted, placed, [*inner, "_digit"]).where("rank >= _before and rank < _before + _n")
        .select(*inner, "point", "_digit", "_second", (F.col("rank") - F.col("_before")).alias("rank")))
    last = _join(
        some.withColumn("_second", second), in_second.select(*inner, "_digit", "_second").distinct(), [*inner, "_digit", "_second"])
    counts = last.groupBy(*inner, "_digit", "_second", "_value").agg(F.count(F.lit(1)).alias("_n"))
    placed = _placed(counts, [*inner, "_digit", "_second"], "_value")
    settled = _join(in_second, placed, [*inner, "_digit", "_second"]).where("rank >= _before and rank < _before + _n")
    return settled.groupBy(*inner).agg(F.map_from_entries(F.collect_list(F.struct("point", "_value"))).alias("_values"))


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join in which a null group meets itself."""
    told = right.select(*[F.col(c).alias(f"_r{c}") if c in on else F.col(c) for c in right.columns])
    met = [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in on]
    return left.join(told, met, how).drop(*[f"_r{c}" for c in on])

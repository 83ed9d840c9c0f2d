"""Order-dependent operators that survive one group holding most of the rows.

A window over a whole episode, source or text group would put a hot group into
one task. The operators here cut each group into blocks of consecutive
positions, or into ranges of a sort key, work block by block, and pass only
per-block totals between blocks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.functions.arrays import suffix
from turnloom.functions.hashing import seeded_key
from turnloom.session import settle

BLOCK = 4096
_PREFIX_HEX = 4  # 16**4 ranges of a uniformly spread digest
_RANGE_ROWS = 1 << 18  # distinct values that one range holds, about
_FEWEST_RANGES = 64
_LEADING = 8  # bits of a first digit that one range spans


# --- consecutive positions ---

def look_back(
    rows: DataFrame, keys: Sequence[str], position: str, columns: dict[str, Column], n: int,
    block: int = BLOCK,
) -> DataFrame:
    """Add, per row, arrays over up to ``n`` rows right before it, oldest first.

    A null value leaves a gap in its array; wrap it in a struct to keep its place.
    ``position`` must be dense per group (0, 1, 2, ...), as a list index is; see
    :func:`dense_position` otherwise. Rows are windowed per block, and the last
    ``n`` rows of a block are also sent to the next block, so the result equals
    a window over the whole group while no task holds more than a block.
    """
    if n <= 0:
        return rows.withColumns({name: F.slice(F.array(value), 1, 0) for name, value in columns.items()})
    size = max(block, n)
    home = (F.col(position) / size).cast("long")
    reach = F.when(
        F.col(position) % size >= size - n, F.array(home, home + 1)
    ).otherwise(F.array(home))
    before = (
        Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(-n, -1)
    )
    spread = rows.withColumn("_block", F.explode(reach))
    return (
        spread.withColumns({name: F.collect_list(value).over(before) for name, value in columns.items()})
        .filter(F.col("_block") == home)
        .drop("_block")
    )


def trailing_matches(values: Column, wanted: Column) -> Column:
    """How many elements at the end of ``values`` equal ``wanted`` without a break."""
    broken = F.array_position(
        F.transform(F.reverse(values), lambda v: v.eqNullSafe(wanted)), F.lit(False))
    return F.when(broken > 0, broken - 1).otherwise(F.size(values)).cast("int")


def keep_trailing(values: Column, count: Column) -> Column:
    return F.when(count > 0, suffix(values, count)).otherwise(F.slice(values, F.lit(1), F.lit(0)))


def running_total(
    rows: DataFrame, keys: Sequence[str], position: str, value: Column, name: str,
    block: int = BLOCK,
) -> DataFrame:
    """Inclusive running sum of ``value`` per group in ``position`` order.

    Each block sums by itself; block totals are summed before they are joined
    back, so the widest window is one row per block.
    """
    at = (F.col(position) / block).cast("long")
    inside = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(
        Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    blocked = rows.withColumns({"_block": at, "_value": value})
    offsets = (
        blocked.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .drop("_sum")
    )
    return (
        blocked.withColumn("_inside", F.sum("_value").over(inside))
        .join(offsets, [*keys, "_block"])
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_block", "_value", "_inside", "_offset")
    )


def dense_position(
    rows: DataFrame, keys: Sequence[str], order: str, name: str, block: int = BLOCK,
) -> DataFrame:
    """Zero-based position per group in the order of a sparse integer column."""
    return running_total(rows, keys, order, F.lit(1), "_seen", block).withColumn(
        name, F.col("_seen") - 1).drop("_seen")


def position_gaps(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Groups whose positions are not exactly 0..n-1; empty when the contract holds."""
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(position).alias("positions"),
             F.min(position).alias("low"), F.max(position).alias("high"))
        .filter((F.col("low") != 0) | (F.col("high") != F.col("rows") - 1)
                | (F.col("positions") != F.col("rows")))
    )


# --- leading digits of whole numbers ---

_BITS = 16


def open_bits(value: Column) -> Column:
    """How many low bits the first digit leaves open."""
    plus = F.when(value < 0, -(value + 1)).otherwise(value)
    return F.greatest(F.lit(0), F.length(F.bin(plus)) - (_BITS + 1))


def first_digit(value: Column) -> Column:
    """A bucket number that grows with a whole number; at most 2**23 different ones."""
    plus = F.when(value < 0, -(value + 1)).otherwise(value)
    left = open_bits(value)
    code = left.cast("long") * (1 << _BITS) + F.call_function("shiftright", plus, left)
    return F.when(value < 0, -code - 1).otherwise(code)


# --- first row per key ---

def first_per_key(rows: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """The earliest row of every key.

    Written as ``row_number() = 1``: Spark then keeps one row per key on the map
    side before the shuffle, so a key with a third of all rows ships one row per
    map task.
    """
    place = Window.partitionBy("_key").orderBy(*order)
    return (
        rows.withColumn("_key", key)
        .withColumn("_place", F.row_number().over(place))
        .filter(F.col("_place") == 1)
        .drop("_key", "_place")
    )


# --- global order of distinct values ---

def digest_rank(values: DataFrame, column: str, seed: int) -> DataFrame:
    """Add ``digest_key``, 1-based ``digest_rank`` and ``digest_total`` to distinct values.

    The order is that of the seeded digest. Digests spread evenly, so ranking
    inside 65,536 fixed prefix ranges and adding the counts of the earlier
    ranges gives the exact global rank with small tasks only.
    """
    keyed = values.withColumn("digest_key", seeded_key(seed, F.col(column))).withColumn(
        "_range", F.substring("digest_key", 1, _PREFIX_HEX))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # At most 16**4 rows reach this unpartitioned window, whatever the input size.
    offsets = (
        keyed.groupBy("_range").agg(F.count(F.lit(1)).alias("_count"))
        .withColumns({
            "_offset": F.coalesce(F.sum("_count").over(earlier), F.lit(0)),
            "digest_total": F.sum("_count").over(Window.partitionBy()),
        })
        .drop("_count")
    )
    inside = Window.partitionBy("_range").orderBy("digest_key", column)
    return (
        keyed.withColumn("_inside", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_range")  # bounded: one row per prefix
        .withColumn("digest_rank", F.col("_inside") + F.col("_offset"))
        .drop("_range", "_inside", "_offset")
    )


def value_rank(values: DataFrame, column: str, name: str) -> DataFrame:
    """Add the zero-based rank of distinct values of any sortable type.

    Values are dealt into ranges, ranked inside each, and the sizes of the earlier ranges are added.
    """
    ranges = _FEWEST_RANGES + values.count() // _RANGE_ROWS
    # settled, because the borders of the ranges are sampled anew by every run
    ranged = settle(values.repartitionByRange(ranges, column).withColumn("_range", F.spark_partition_id()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).drop("_size")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(column)) - 1
    return (
        ranged.withColumn(name, inside).join(offsets, "_range")
        .withColumn(name, F.col(name) + F.col("_offset")).drop("_range", "_offset"))


def weighted_positions(counts: DataFrame, keys: Sequence[str], value: str, count: str) -> DataFrame:
    """Add ``before``: how many counted rows of the group sort below each distinct value.

    ``counts`` holds one row per group and distinct numeric value. Whole numbers are cut into ranges by
    their leading digits, of which there are a bounded number, others at approximate quantiles, which only
    balance the work; the positions are exact wherever the cuts fall.
    """
    if isinstance(counts.schema[value].dataType, T.IntegralType):
        ranged = counts.withColumn("_range", F.call_function(
            "shiftright", first_digit(F.col(value).cast("long")), F.lit(_LEADING)))
    else:
        counts = settle(counts)
        ranged = _value_ranges(counts, value)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1)
    # one row per group and range: a 2**18th of the distinct values, or 2**15 leading digits, meet in one task
    offsets = (
        ranged.groupBy(*keys, "_range").agg(F.sum(count).alias("_count"))
        .withColumn("_offset", F.coalesce(F.sum("_count").over(earlier), F.lit(0)))
        .drop("_count")
    )
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum(count).over(inside), F.lit(0)))
        .join(offsets, [*keys, "_range"])
        .withColumn("before", F.col("_inside") + F.col("_offset"))
        .drop("_range", "_inside", "_offset")
    )


def _value_ranges(counts: DataFrame, value: str) -> DataFrame:
    """Add ``_range``, which grows with ``value`` and splits the rows about evenly."""
    ranges = _FEWEST_RANGES + counts.count() // _RANGE_ROWS
    numbers = counts.withColumn("_number", F.col(value).cast("double"))
    cuts = numbers.approxQuantile("_number", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))
    edges = sorted(set(cuts))
    if not edges:
        return counts.withColumn("_range", F.lit(0))
    cutter = Bucketizer(
        splits=[-math.inf, *edges, math.inf], inputCol="_number", outputCol="_range", handleInvalid="keep")
    return cutter.transform(numbers).withColumn("_range", F.col("_range").cast("int")).drop("_number")

"""Radix selection against sorted lists."""

import random

import pytest
from pyspark.sql import functions as F

from turnloom.operators import profile
from turnloom.operators.selection import first_digit, order_statistics


def ranks():
    return {f"p{i}": (F.col("_rows").cast("double") * i / 8).cast("long") for i in range(9)}


def wanted(values):
    values = sorted(values)
    return [len(values), values[0], *[values[int(len(values) * i / 8)] for i in range(8)], None, values[-1]]


@pytest.mark.parametrize("wide", [False, True])
def test_ranks_of_groups_equal_sorted_lists(spark, wide):
    draw = random.Random(wide)
    odd = [lambda: draw.randrange(-(2**63), 2**63), lambda: draw.randrange(2**40, 2**40 + 9), lambda: draw.choice([2**63 - 1, -(2**63)]),
           lambda: draw.randrange(-300_000, 300_000)] if wide else []
    kinds = [lambda: draw.randrange(-5, 5), lambda: draw.randrange(131_072), *odd]
    rows = [(k, draw.choice(kinds)()) for k in ("a", "b", None) for _ in range(150)] + [("one", 7), ("none", None), ("a", None)]
    table = spark.createDataFrame(rows, "k string, v long")
    found = {r["k"]: list(r)[1:] for r in order_statistics(table, ["k"], F.col("v"), ranks()).collect()}
    assert found == {k: wanted([v for g, v in rows if g == k and v is not None]) for k in ("a", "b", None, "one")}
    assert list(order_statistics(table, [], F.col("v"), ranks()).first()) == wanted([v for _, v in rows if v is not None])
    assert order_statistics(table.limit(0), ["k"], F.col("v"), ranks()).isEmpty()


def test_the_first_digit_grows_with_the_value(spark):
    values = sorted({s * (2**k + d) for k in range(0, 63, 3) for d in (-1, 0, 1, 5) for s in (1, -1)})
    table = spark.createDataFrame([(v,) for v in values], "v long")
    digits = [r["d"] for r in table.select("v", first_digit(F.col("v")).alias("d")).orderBy("v").collect()]
    assert digits == sorted(digits)
    small = table.where("v between -100000 and 100000")
    assert small.select(first_digit(F.col("v")).alias("d")).distinct().count() == small.count()


def test_lengths_keep_their_type_and_need_no_sort(spark):
    table = spark.range(1000).select((F.col("id") % 7).alias("k"), (F.col("id") % 90).cast("int").alias("v"))
    found = profile.truncated_index_profile(table, ["k"], F.col("v"))
    assert found.schema["p50"].dataType.simpleString() == "int"
    assert "rangepartitioning" not in found._jdf.queryExecution().executedPlan().toString()

"""Phrase tables against one test per phrase."""

import random

import pytest
from pyspark.sql import functions as F

from turnloom.operators import phrases, profile


@pytest.fixture(scope="module")
def texts(spark):
    draw = random.Random(4)
    rows = [(i % 3 if i % 7 else None, "".join(draw.choice("abÄ ") for _ in range(draw.randrange(60)))) for i in range(300)]
    return spark.createDataFrame(rows + [(1, None), (1, "")], "k int, t string").repartition(3)


def table(spark, values):
    return spark.createDataFrame([(v,) for v in values], "phrase string")


def test_equals_one_counter_per_phrase(spark, texts):
    few = ["ab", "ä", "b a", "zz", "a", "ba"]
    for keys in ([], ["k"]):
        one = {tuple(r) for r in profile.phrase_hits(texts, F.col("t"), few, keys).collect()}
        assert {tuple(r) for r in phrases.table_hits(texts, F.col("t"), table(spark, few), keys).collect()} == one
        one = {tuple(r) for r in profile.phrase_summary(texts.where("t is not null"), F.col("t"), few, keys).collect()}
        found = phrases.table_summary(texts.where("t is not null"), F.col("t"), table(spark, few), keys)
        assert {tuple(r) for r in found.collect()} == one


@pytest.mark.parametrize("block", [phrases.BLOCK_CHARS, 20_000])
def test_ten_thousand_phrases_equal_brute_force(spark, texts, block):
    draw = random.Random(5)
    many = {"".join(draw.choice("abä ") for _ in range(draw.randrange(1, 9))) for _ in range(30_000)}
    many = sorted(many)[:10_000]
    told = [r["t"].lower() for r in texts.where("t is not null").collect()]
    wanted = {p: n for p in many if (n := sum(p in t for t in told))}
    given = table(spark, [p.upper() for p in many] + many[:50] + [None])
    found = {r["phrase"]: r["rows"] for r in phrases.table_hits(texts, F.col("t"), given, block_chars=block).collect()}
    assert found == wanted
    summary = phrases.table_summary(texts, F.col("t"), given, block_chars=block).first()
    assert (summary["hits"], summary["rows"]) == (sum(wanted.values()), 302)
    assert summary["rows_with_hit"] == sum(any(p in t for p in many) for t in told)


def test_an_empty_phrase_is_in_every_text_and_an_empty_table_in_none(spark, texts):
    assert [tuple(r) for r in phrases.table_hits(texts, F.col("t"), table(spark, ["", "ZZZ"])).collect()] == [("", 301)]
    assert phrases.table_hits(texts, F.col("t"), table(spark, [])).isEmpty()

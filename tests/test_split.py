import hashlib
import random

import pytest
from pyspark.sql import functions as F

from turnloom.operators import split


def pairs_of(spark, episodes):
    return spark.createDataFrame([(e, i, 5 + i) for e in episodes for i in range(2)], "episode string, line int, target_words int")


@pytest.mark.parametrize("n, fraction, held", [(231, 0.1, 23), (100, 0.29, 28), (1, 0.1, 1), (5, 0.0, 1), (4, 1.5, 4)])
def test_heldout_size(spark, n, fraction, held):
    assert spark.range(1).select(split.heldout_size(F.lit(n), fraction).alias("k")).first()["k"] == held


@pytest.mark.parametrize("n, fraction, seed", [(40, 0.1, 0), (40, 0.29, 7), (1, 0.1, 0), (3, 2.0, 0)])
def test_portable_split_holds_out_whole_episodes(spark, n, fraction, seed):
    titles = [f"episode {i}" for i in range(n)]
    got = split.split_pairs(pairs_of(spark, titles), fraction=fraction, seed=seed).collect()
    order = sorted(titles, key=lambda t: hashlib.md5(f"{seed}:{t}".encode()).hexdigest())
    held = set(order[:max(1, int(n * fraction))])
    assert {r["episode"] for r in got if r["split"] == "heldout"} == held
    assert len(got) == 2 * n and all((r["split"] == "heldout") == (r["episode"] in held) for r in got)


def test_exact_split_follows_the_seeded_shuffle(spark):
    titles = [f"episode {i}" for i in range(25)]
    got = split.split_pairs_exact(pairs_of(spark, titles), fraction=0.2, seed=3).collect()
    expected = sorted(titles)
    random.Random(3).shuffle(expected)
    assert {r["episode"] for r in got if r["split"] == "heldout"} == set(expected[:5])


def test_no_pairs_gives_an_empty_split(spark):
    empty = pairs_of(spark, ["a"]).filter("false")
    assert split.split_pairs(empty).count() == 0


def test_summary(spark):
    divided = pairs_of(spark, ["a", "b", "c"]).withColumn(
        "split", F.when(F.col("episode") == "a", "heldout").otherwise("train"))
    got = {r["scope"]: (r["pairs"], r["episodes"], r["mean_target_words"]) for r in split.split_summary(divided).collect()}
    assert got == {"all": (6, 3, 5.5), "train": (4, 2, 5.5), "heldout": (2, 1, 5.5)}

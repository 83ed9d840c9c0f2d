"""Train / held-out split by whole episodes."""

from __future__ import annotations

import random
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom import fixed
from turnloom.functions.hashing import seeded_key
from turnloom.operators.ordered import digest_rank, value_rank
from turnloom.session import settle

TRAIN, HELDOUT = "train", "heldout"


def heldout_size(groups: Column, fraction: float) -> Column:
    """Truncated share of the groups, at least one and at most all of them."""
    share = (groups.cast("double") * F.lit(float(fraction))).cast("long")
    return F.least(groups, F.greatest(F.lit(1), share))


def heldout_cutoff(
    pairs: DataFrame, episode: str = "episode", fraction: float = fixed.HELDOUT_FRACTION,
    seed: int = fixed.SEED,
) -> DataFrame:
    """One row: the digest key of the last held-out episode, and the group counts."""
    # settled, because the ranking reads the titles twice
    ranked = digest_rank(settle(pairs.select(episode).distinct()), episode, seed)
    size = heldout_size(F.col("digest_total"), fraction)
    return ranked.filter(F.col("digest_rank") == size).select(
        F.col("digest_key").alias("cutoff"), F.col("digest_total").alias("groups"),
        size.alias("heldout_groups"),
    )


def split_pairs(
    pairs: DataFrame, episode: str = "episode", fraction: float = fixed.HELDOUT_FRACTION,
    seed: int = fixed.SEED,
) -> DataFrame:
    """Add ``split``. Membership is one comparison against a scalar, so pairs do not move."""
    cutoff = heldout_cutoff(pairs, episode, fraction, seed).select("cutoff").scalar()
    held = seeded_key(seed, F.col(episode)) <= cutoff
    return pairs.withColumn("split", F.when(held, HELDOUT).otherwise(TRAIN))


def split_pairs_exact(
    pairs: DataFrame, episode: str = "episode", fraction: float = fixed.HELDOUT_FRACTION,
    seed: int = fixed.SEED,
) -> DataFrame:
    """The split of a seeded Mersenne Twister shuffle of the sorted episode titles.

    Titles are ranked on the cluster. The shuffle is one sequence by definition: the driver
    permutes the ranks, eight bytes each, and sends back those that are held out.
    """
    ranked = settle(value_rank(settle(pairs.select(episode).distinct()), episode, "_rank"))
    ranks = array("q", range(ranked.count()))
    random.Random(seed).shuffle(ranks)
    held = np.frombuffer(ranks[: max(1, int(len(ranks) * fraction))], np.int64)
    chosen = pairs.sparkSession.createDataFrame(pd.DataFrame({"_rank": held}), "_rank long")
    titles = ranked.join(chosen, "_rank").select(F.col(episode).alias("_held"))
    return (
        pairs.join(titles, F.col(episode).eqNullSafe(F.col("_held")), "left")
        .withColumn("split", F.when(F.col("_held").isNotNull(), HELDOUT).otherwise(TRAIN)).drop("_held"))


def split_summary(split: DataFrame, episode: str = "episode") -> DataFrame:
    """Pairs, episodes and mean reply length per split and overall."""
    return (
        split.groupBy("split", episode)
        .agg(F.count(F.lit(1)).alias("pairs"), F.sum("target_words").alias("words"))
        .groupingSets([["split"], []], "split")
        .agg(
            F.when(F.grouping("split") == 1, "all").otherwise(F.col("split")).alias("scope"),
            F.sum("pairs").alias("pairs"),
            F.count_distinct(episode).alias("episodes"),
            (F.sum("words") / F.sum("pairs")).alias("mean_target_words"),
        )
        .drop("split")
    )

"""Paired similarity of two models' replies to reference replies.

Input rows hold, per example, ``index, episode`` and per model a reply vector;
encoding and generation happen elsewhere and arrive as columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom import fixed
from turnloom.functions import arrays, text
from turnloom.operators.ordered import weighted_positions
from turnloom.session import settle

_SMALLEST_NORM = 1e-12


def generation(tokens: Column, reply: Column, stops: Sequence[int], cap: int) -> Column:
    """Generation struct of raw output tokens and their decoded text."""
    return F.struct(
        text.strip(reply).alias("text"),
        arrays.stop_position(tokens, stops).alias("tokens"),
        arrays.hit_token_limit(tokens, stops, cap).alias("hit_token_limit"),
    )


def fits_context(prompt_tokens: Column, cap: int, window: int) -> Column:
    return F.size(prompt_tokens) + cap <= window


def shorter_than_context(prompt_tokens: Column, window: int) -> Column:
    """The scoring rule: room for at least the next token."""
    return F.size(prompt_tokens) < window


def safe_cosine(left: Column, right: Column) -> Column:
    """Product of L2-normalised vectors; a zero vector scores zero."""
    scale = F.greatest(arrays.norm(left), F.lit(_SMALLEST_NORM)) * F.greatest(
        arrays.norm(right), F.lit(_SMALLEST_NORM))
    return arrays.dot(left, right) / scale


def score_pairs(rows: DataFrame, reference: str, base: str, sft: str) -> DataFrame:
    """Add ``base_cosine``, ``sft_cosine`` and their ``difference``."""
    return rows.withColumns({
        "base_cosine": safe_cosine(F.col(base), F.col(reference)),
        "sft_cosine": safe_cosine(F.col(sft), F.col(reference)),
    }).withColumn("difference", F.col("sft_cosine") - F.col("base_cosine"))


def long_form(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per example and model, from ``<model>`` generation and ``<model>_cosine`` columns."""
    sides = F.array(*[
        F.struct(
            F.lit(m).alias("model"), F.col(f"{m}_cosine").alias("reference_cosine"),
            F.col(f"{m}.text").alias("text"), F.col(f"{m}.tokens").alias("tokens"),
            F.col(f"{m}.hit_token_limit").alias("hit_token_limit"),
            F.col(f"{m}_encoder_tokens").alias("encoder_tokens"),
        ) for m in fixed.MODELS
    ])
    return rows.select(*keys, F.inline(sides))


def model_metrics(long: DataFrame, encoder_limit: int) -> DataFrame:
    return long.groupBy("model").agg(
        F.avg("reference_cosine").alias("mean_cosine_similarity"),
        F.avg("tokens").alias("mean_generated_tokens"),
        F.count_if(F.col("text") == "").alias("empty_responses"),
        F.count_if("hit_token_limit").alias("generation_limit_hits"),
        F.count_if(F.col("encoder_tokens") > encoder_limit).alias("embedding_truncations"),
    )


def paired_summary(rows: DataFrame, difference: str = "difference") -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("examples"),
        F.avg(difference).alias("mean_paired_difference"),
        F.avg((F.col(difference) > 0).cast("double")).alias("fraction_sft_higher"),
    )


def cluster_totals(rows: DataFrame, cluster: str, difference: str = "difference") -> DataFrame:
    """Sum and number of differences per cluster."""
    return rows.groupBy(F.col(cluster).alias("cluster")).agg(
        F.sum(difference).alias("total"), F.count(F.lit(1)).alias("members"))


def mean_words(long: DataFrame, reply: str = "text") -> DataFrame:
    return long.groupBy("model").agg(F.avg(text.word_count(F.col(reply))).alias("mean_words"))


# --- correlations ---

def correlations(rows: DataFrame, x: Column, y: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson and Spearman (average ranks) of two columns per group, with the row count.

    Rows without both values are left out. Equal ``(x, y)`` rows are counted first, so a value
    shared by a third of all rows weighs in as one row; ranks come from the value histograms. Sums
    are taken around the means, so large values with a small spread lose nothing; a constant column
    has no correlation (null).
    """
    keys = list(keys)
    cells = settle(
        rows.select(*keys, x.alias("x"), y.alias("y")).where("x is not null and y is not null")
        .groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("w")))

    def doubled_ranks(axis: str) -> DataFrame:
        counts = cells.groupBy(*keys, axis).agg(F.sum("w").alias("_n"))
        placed = weighted_positions(counts, keys, axis, "_n")
        return placed.select(*keys, axis, (2 * F.col("before") + F.col("_n") + 1).alias(f"rank_{axis}"))

    ranked = cells.join(doubled_ranks("x"), [*keys, "x"]).join(doubled_ranks("y"), [*keys, "y"])
    n = F.sum("w")
    means = cells.groupBy(*keys).agg(
        *[(F.sum(F.col("w") * F.col(axis).cast("double")) / n).alias(f"_{axis}") for axis in "xy"],
        (n + 1).alias("_rank"))  # doubled ranks are whole numbers around n + 1
    if keys:
        ranked = ranked.join(settle(means), keys)
    elif (only := means.first()) is not None:
        ranked = ranked.withColumns({name: F.lit(only[name]) for name in ("_x", "_y", "_rank")})

    def around(name: str, mean: str) -> Column:
        return F.col(name).cast("double") - F.col(mean)

    return ranked.groupBy(*keys).agg(
        n.alias("rows"),
        weighted_correlation(around("x", "_x"), around("y", "_y")).alias("pearson"),
        weighted_correlation(around("rank_x", "_rank"), around("rank_y", "_rank")).alias("spearman"),
    )


def weighted_correlation(a: Column, b: Column, weight: str = "w") -> Column:
    """Pearson correlation of counted cells with mean 0, as one aggregate expression."""
    w = F.col(weight).cast("double")
    return F.try_divide(F.sum(w * a * b), F.sqrt(F.sum(w * a * a)) * F.sqrt(F.sum(w * b * b)))

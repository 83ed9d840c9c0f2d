"""Resampling intervals of paired differences.

``portable`` draws come from labelled digests: any engine with md5 repeats them,
and so does a task that is run again. ``multinomial`` draws the distribution of
counts instead, for strata and cluster tables of any size. ``poisson`` weighs
clusters in one pass over rows, without a cluster table. ``exact`` draws are
those of one NumPy generator, for reproducing published runs; its raw words are
made in chunks by many tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom import fixed
from turnloom.functions.hashing import DRAWS_PER_DIGEST, digest, draw
from turnloom.operators.ordered import digest_rank, running_total, value_rank
from turnloom.operators.validate import guard
from turnloom.session import settle

_STEP = 4096
_MOST_STRATA = 1 << 12  # strata that travel as one array
RANGE_SLOTS = 1 << 16  # clusters that one task draws from
CHUNK = 1 << 20  # half-words of the generator that one task row stands for


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _count_up(rows: DataFrame, count: Column, name: str) -> DataFrame:
    """One row per integer below ``count``, unrolled in two steps to keep arrays short."""
    outer = rows.withColumns({"_count": count}).withColumn(
        "_outer", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_count") - 1) / _STEP))))
    first = F.col("_outer") * _STEP
    last = F.least(first + _STEP, F.col("_count")) - 1
    return outer.withColumn(name, F.explode(F.sequence(first, last))).drop("_count", "_outer")


def _digests_needed(slots: Column) -> Column:
    return F.ceil(slots / DRAWS_PER_DIGEST)


def _generator(*label) -> np.random.Generator:
    """A generator of its own for a label, seeded by 128 bits of its digest."""
    said = ":".join(map(str, label)).encode()
    return np.random.default_rng(int.from_bytes(hashlib.sha256(said).digest()[:16], "big"))


# --- clusters ---

def cluster_estimates(
    totals: DataFrame, samples: int = fixed.BOOTSTRAP_SAMPLES, seed: int = fixed.SEED,
) -> DataFrame:
    """``sample, estimate`` of resampling whole clusters with replacement.

    ``totals``: ``cluster, total, members``. Each estimate is the ratio of the
    drawn totals to the drawn member counts. Every sample makes its own draws in
    its own task; only the lookup of drawn clusters meets the cluster table.
    """
    spark = totals.sparkSession
    indexed = settle(
        digest_rank(totals, "cluster", seed)
        .withColumn("slot", F.col("digest_rank") - 1)
        .select("slot", "total", "members", F.col("digest_total").alias("clusters")))
    clusters = indexed.agg(F.max("clusters")).scalar()
    sampled = spark.range(0, samples, 1, min(samples, _tasks(spark))).withColumnsRenamed(
        {"id": "sample"}).withColumn("clusters", clusters)
    blocks = _count_up(sampled, _digests_needed(F.col("clusters")), "block").withColumn(
        "_digest", digest(seed, F.col("sample"), F.col("block")))
    drawn = blocks.select(
        "sample", "clusters", "block",
        F.posexplode(F.array(*[
            draw(F.col("_digest"), i, F.col("clusters")) for i in range(DRAWS_PER_DIGEST)
        ])).alias("_i", "slot"),
    ).filter(F.col("block") * DRAWS_PER_DIGEST + F.col("_i") < F.col("clusters"))
    return _ratio(drawn.select("sample", "slot").join(indexed.drop("clusters"), "slot"))


def _ratio(drawn: DataFrame) -> DataFrame:
    return drawn.groupBy("sample").agg(
        (F.sum("total") / F.sum("members")).alias("estimate"))


def cluster_estimates_multinomial(
    totals: DataFrame, samples: int = fixed.BOOTSTRAP_SAMPLES, seed: int = fixed.SEED,
) -> DataFrame:
    """The same distribution, drawn range by range: nothing but sums is shuffled.

    Each sample first settles how many of its draws fall into each range of clusters; a range then
    draws its share from the clusters it holds.
    """
    spark = totals.sparkSession
    indexed = settle(
        digest_rank(totals, "cluster", seed).withColumn("slot", F.col("digest_rank") - 1)
        .select("slot", "total", "members"))
    clusters = indexed.count()
    if not clusters:
        return spark.range(0).select(F.col("id").alias("sample"), F.lit(0.0).alias("estimate"))
    firsts = np.arange(0, clusters, RANGE_SLOTS)
    shares = np.minimum(RANGE_SLOTS, clusters - firsts) / clusters

    def settle_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sample in batch["id"]:
                counts = _generator(seed, "ranges", sample).multinomial(clusters, shares)
                yield pd.DataFrame({"range": np.arange(len(counts)), "sample": sample, "draws": counts})

    def draw_share(slots: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        slots = slots.sort_values("slot")
        total, members = slots["total"].to_numpy(float), slots["members"].to_numpy(float)
        found = []
        for place, sample, draws in zip(counts["range"], counts["sample"], counts["draws"]):
            chosen = _generator(seed, "slots", place, sample).integers(len(slots), size=draws)
            found.append((sample, total[chosen].sum(), members[chosen].sum()))
        return pd.DataFrame(found, columns=["sample", "total", "members"])

    counts = spark.range(0, samples, 1, min(samples, _tasks(spark))).mapInPandas(
        settle_counts, "range long, sample long, draws long")
    ranged = indexed.withColumn("range", F.floor(F.col("slot") / RANGE_SLOTS))
    return _ratio(ranged.groupBy("range").cogroup(counts.groupBy("range")).applyInPandas(
        draw_share, "sample long, total double, members double"))


def cluster_estimates_poisson(
    rows: DataFrame, cluster: Column, difference: Column, samples: int = fixed.BOOTSTRAP_SAMPLES,
    seed: int = fixed.SEED,
) -> DataFrame:
    """``sample, estimate`` of resampling whole clusters, in one pass over rows.

    In each sample a cluster counts as often as a Poisson variable of mean 1 says, which a digest of
    cluster and sample settles. So rows of a cluster agree without ever meeting: each task adds up two
    sums per sample, and only these are shuffled. There is no cluster table. The number of drawn
    clusters varies around their number, as the statistic is a ratio of sums.
    """
    keyed = rows.where(difference.isNotNull()).select(
        F.xxhash64(F.lit(seed), cluster).alias("cluster"), difference.cast("double").alias("difference"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, members = np.zeros(samples), np.zeros(samples)
        for batch in batches:
            found, place = np.unique(batch.column("cluster").to_numpy(), return_inverse=True)
            sums = np.bincount(place, weights=batch.column("difference").to_numpy(), minlength=len(found))
            counts = np.bincount(place, minlength=len(found)).astype(float)
            for at in range(0, len(found), _CLUSTERS):
                part = slice(at, at + _CLUSTERS)
                weights = poisson_weights(found[part], samples)
                total += sums[part] @ weights
                members += counts[part] @ weights
        yield pa.RecordBatch.from_pydict({
            "sample": pa.array(np.arange(samples), pa.int64()), "total": pa.array(total), "members": pa.array(members)})

    return _ratio(keyed.mapInArrow(add_up, "sample long, total double, members double"))


_CLUSTERS = 256  # whose weights are made together
#: Where a uniform 32-bit number stops to mean 0, 1, 2 ... of a Poisson variable of mean 1.
_STEPS = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(12)]) * 2.0**32


def poisson_weights(clusters: np.ndarray, samples: int) -> np.ndarray:
    """Weight of each cluster, named by a digest, in each sample."""
    with np.errstate(over="ignore"):
        x = clusters.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(_STEPS, (x >> np.uint64(32)).astype(float), "right").astype(float)


def cluster_estimates_exact(
    totals: DataFrame, samples: int = fixed.BOOTSTRAP_SAMPLES, seed: int = fixed.SEED,
) -> DataFrame:
    """The same with the draws of one NumPy generator over clusters sorted by name."""
    indexed = settle(value_rank(settle(totals), "cluster", "slot"))
    draws = sequential_draws(totals.sparkSession, [("", indexed.count())], samples, seed)
    return _ratio(draws.drop("stratum").join(indexed, "slot"))


# --- strata ---

def stratum_counts(rows: DataFrame, stratum: str, difference: str) -> DataFrame:
    """Sufficient statistics of differences in {-1, 0, 1} per stratum; others fail the job."""
    d = F.col(difference)
    checked = guard(rows, d.isin(-1, 0, 1), "a difference of marks is -1, 0 or 1")
    return checked.groupBy(F.col(stratum).alias("stratum")).agg(
        F.count(F.lit(1)).alias("members"),
        F.count_if(d == -1).alias("minus"), F.count_if(d == 0).alias("zero"))


def _per_sample(counts: DataFrame, samples: int) -> DataFrame:
    """One row per stratum and sample, made where the sample is: strata are few, and travel as one array."""
    spark = counts.sparkSession
    if counts.count() > _MOST_STRATA:
        return counts.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).repartition(
            _tasks(spark), "stratum", "sample")
    drawn = spark.range(0, samples, 1, min(samples, _tasks(spark))).select(F.col("id").cast("int").alias("sample"))
    strata = counts.agg(F.collect_list(F.struct(*counts.columns)).alias("all")).scalar()
    return drawn.withColumn("_s", F.explode(strata)).select("sample", "_s.*")


def _mean_of_sums(sums: DataFrame, counts: DataFrame) -> DataFrame:
    rows = counts.agg(F.sum("members")).scalar()
    return sums.groupBy("sample").agg((F.sum("_sum") / rows).alias("estimate"))


def stratified_estimates(
    counts: DataFrame, samples: int = fixed.BOOTSTRAP_SAMPLES, seed: int = fixed.SEED,
) -> DataFrame:
    """``sample, estimate`` of resampling rows within strata.

    A drawn row only matters through its difference, so a draw below ``minus``
    counts -1, the next ``zero`` draws count 0 and the rest +1. No row is looked up.
    """
    counts = settle(counts)
    blocks = _count_up(
        _per_sample(counts, samples), _digests_needed(F.col("members")), "block"
    ).withColumn("_digest", digest(seed, F.col("sample"), F.col("stratum"), F.col("block")))
    score = F.lit(0)
    for i in range(DRAWS_PER_DIGEST):
        u = draw(F.col("_digest"), i, F.col("members"))
        score = score + (
            F.when(F.col("block") * DRAWS_PER_DIGEST + i >= F.col("members"), 0)
            .when(u < F.col("minus"), -1)
            .when(u < F.col("minus") + F.col("zero"), 0)
            .otherwise(1))
    return _mean_of_sums(blocks.select("sample", score.alias("_sum")), counts)


def stratified_estimates_multinomial(
    counts: DataFrame, samples: int = fixed.BOOTSTRAP_SAMPLES, seed: int = fixed.SEED,
) -> DataFrame:
    """The same distribution from one count draw per stratum and sample.

    Work is samples x strata however many rows the strata hold. A stratum draws all its samples at
    once, from a generator of its own.
    """
    def draw_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, n, low, mid in zip(batch["stratum"], batch["members"], batch["minus"], batch["zero"]):
                drawn = _generator(seed, key).multinomial(n, [low / n, mid / n, (n - low - mid) / n], samples)
                yield pd.DataFrame({"sample": np.arange(samples), "_sum": drawn[:, 2] - drawn[:, 0], "_members": n})

    named = counts.select(F.col("stratum").cast("string").alias("stratum"), "members", "minus", "zero")
    sums = named.mapInPandas(draw_all, "sample long, _sum long, _members long")
    return sums.groupBy("sample").agg((F.sum("_sum") / F.sum("_members")).alias("estimate"))


def stratified_estimates_exact(
    rows: DataFrame, strata: Sequence[str], samples: int = fixed.BOOTSTRAP_SAMPLES,
    seed: int = fixed.SEED,
) -> DataFrame:
    """The same with the draws of one NumPy generator over the strata in the given order.

    ``rows``: ``stratum, slot, difference`` with dense zero-based slots per stratum.
    """
    settled = settle(rows.filter(F.col("stratum").isin(*strata)).select("stratum", "slot", "difference"))
    sizes = {r["stratum"]: r["count"] for r in settled.groupBy("stratum").count().collect()}
    missing = [s for s in strata if s not in sizes]
    if missing:
        raise ValueError(f"{fixed.ERROR_SUBJECTS}: {missing}")
    draws = sequential_draws(rows.sparkSession, [(s, sizes[s]) for s in strata], samples, seed)
    return draws.join(settled, ["stratum", "slot"]).groupBy("sample").agg(
        (F.sum("difference") / F.lit(sum(sizes.values()))).alias("estimate"))


# --- draws of one NumPy generator, made in parallel ---

def bounded_draws(seed: int, first: int, count: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Draws below ``bound`` from half-words ``first ...``, and which of them are valid.

    NumPy takes 32-bit halves of the raw words, the lower one first, multiplies them by the bound
    and rejects a half whose lower product word is too small. Any chunk of the raw words can be
    made by itself, as the generator can be advanced.
    """
    source = np.random.PCG64(seed)
    source.advance(first // 2)
    words = source.random_raw((count + first % 2 + 1) // 2).astype("<u8")
    halves = words.view("<u4")[first % 2 :][:count].astype(np.uint64)
    products = halves * np.uint64(bound)
    valid = (products & np.uint64(0xFFFFFFFF)) >= np.uint64(((1 << 32) - bound) % bound)
    return (products >> np.uint64(32)).astype(np.int64), valid


def sequential_draws(
    spark: SparkSession, strata: Sequence[tuple[str, int]], samples: int, seed: int,
) -> DataFrame:
    """``stratum, sample, slot``: what ``default_rng(seed)`` draws stratum by stratum, sample by sample."""
    parts, first = [], 0
    for stratum, size in strata:
        if size >= 1 << 32:
            raise ValueError("NumPy draws differently above 2**32 slots")
        part, first = _stratum_draws(spark, size, samples, seed, first)
        parts.append(part.select(F.lit(stratum).alias("stratum"), "sample", "slot"))
    return reduce(DataFrame.unionAll, parts)


def _stratum_draws(
    spark: SparkSession, size: int, samples: int, seed: int, first: int,
) -> tuple[DataFrame, int]:
    """Draws of one stratum and the half-word after the last one that it takes."""
    wanted = size * samples
    if size == 1:  # one slot takes no random words
        return spark.range(samples).select(F.col("id").alias("sample"), F.lit(0).cast("long").alias("slot")), first
    share = 1 - (((1 << 32) - size) % size) / (1 << 32)
    chunks = int((wanted + 8 * wanted**0.5) / share) // CHUNK + 2

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"chunk": batch["id"], "valid": [
                int(bounded_draws(seed, first + c * CHUNK, CHUNK, size)[1].sum()) for c in batch["id"]]})

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c, before in zip(batch["chunk"], batch["before"]):
                draws, valid = bounded_draws(seed, first + c * CHUNK, CHUNK, size)
                slots = draws[valid][: max(0, wanted - before)]
                yield pd.DataFrame({"sample": (before + np.arange(len(slots))) // size, "slot": slots})

    tasks = min(chunks, 4 * _tasks(spark))
    counted = settle(spark.range(0, chunks, 1, tasks).mapInPandas(count, "chunk long, valid long"))
    placed = settle(running_total(counted, [], "chunk", F.col("valid"), "upto").select(
        "chunk", (F.col("upto") - F.col("valid")).alias("before"), "upto"))
    last = placed.where((F.col("before") < wanted) & (F.col("upto") >= wanted)).first()
    if last is None:
        raise ValueError("too few random words were made")
    valid = bounded_draws(seed, first + last["chunk"] * CHUNK, CHUNK, size)[1]
    end = first + last["chunk"] * CHUNK + int(np.flatnonzero(valid)[wanted - last["before"] - 1]) + 1
    used = placed.where(F.col("before") < wanted).repartition(tasks, "chunk")
    return used.select("chunk", "before").mapInPandas(make, "sample long, slot long"), end


# --- intervals ---

def interval(estimates: DataFrame, bounds: Sequence[float] = fixed.INTERVAL) -> DataFrame:
    """Linearly interpolated quantiles of the estimates: one row ``samples, low, high``."""
    return estimates.agg(
        F.count(F.lit(1)).alias("samples"),
        F.percentile("estimate", F.lit(float(bounds[0]))).alias("low"),
        F.percentile("estimate", F.lit(float(bounds[1]))).alias("high"))

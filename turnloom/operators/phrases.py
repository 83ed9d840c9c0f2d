"""Phrase tables of any size: every phrase of a table in one pass over each text.

Phrases become an Aho-Corasick automaton, which reads a text once whatever the number of phrases, and is
broadcast. Its size is checked: a table too large for one automaton is dealt by a digest into blocks
that are not, and texts are read once per block.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.session import settle

#: Characters of phrases in one automaton: about 40 bytes of it each, so some 160 MB at most.
BLOCK_CHARS = 4 << 20


def _automaton(phrases: Sequence[str]):
    """Knows the number of each phrase; an empty phrase is in every text."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for number, phrase in enumerate(phrases):
        if phrase:
            found.add_word(phrase, number)
    if len(found):
        found.make_automaton()
    return found


def matcher(rows: DataFrame, phrases: Sequence[str]):
    """A function from a text column to the sorted numbers of the phrases that a text holds.

    ``phrases`` are in lower case and no longer than one block together; see :func:`blocks`.
    """
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps((_automaton(phrases), [i for i, p in enumerate(phrases) if not p])))
    ready: list = []

    @F.pandas_udf("array<int>")
    def numbers(texts: pd.Series) -> pd.Series:
        if not ready:
            ready.append(pickle.loads(shared.value))
        automaton, always = ready[0]
        known = len(automaton) > 0
        return pd.Series([
            [] if text is None else sorted({i for _, i in automaton.iter(text)}.union(always) if known else always)
            for text in texts])

    return lambda text: numbers(F.lower(text))


def blocks(phrases: DataFrame, column: str = "phrase", block_chars: int = BLOCK_CHARS) -> list[list[str]]:
    """Distinct phrases in lower case, dealt evenly into blocks of about ``block_chars`` characters at most.

    Only one block is on the driver at a time while it is built; all of them together are the tables
    that the tasks get, one by one.
    """
    told = phrases.select(F.lower(column).alias("phrase")).where("phrase is not null").distinct()
    chars = told.agg(F.sum(F.length("phrase"))).first()[0] or 0
    n = int(chars // block_chars) + 1
    if n > 1:
        told = settle(told.withColumn("_block", F.pmod(F.xxhash64("phrase"), F.lit(n))))
        parts = [told.where(F.col("_block") == i) for i in range(n)]
    else:
        parts = [told]
    return [sorted(r["phrase"] for r in part.collect()) for part in parts]


def _counted(rows: DataFrame, reply: Column, phrases: Sequence[str], keys: Sequence[str]) -> DataFrame:
    found = matcher(rows, phrases)
    table = rows.sparkSession.createDataFrame(list(enumerate(phrases)), "_number int, phrase string")
    return (
        rows.select(*keys, F.explode(found(reply)).alias("_number"))
        .groupBy(*keys, "_number").agg(F.count(F.lit(1)).alias("rows"))
        .join(F.broadcast(table), "_number")  # one block of phrases
        .select(*keys, "phrase", "rows"))


def table_hits(
    rows: DataFrame, reply: Column, phrases: DataFrame, keys: Sequence[str] = (), column: str = "phrase",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Rows per phrase (once per row) and group; phrases without a hit are left out.

    Case does not matter. Equal phrases count as one, a null one as none, an empty one is in every text.
    """
    parts = [_counted(rows, reply, part, keys) for part in blocks(phrases, column, block_chars)]
    return reduce(DataFrame.unionByName, parts)


def table_summary(
    rows: DataFrame, reply: Column, phrases: DataFrame, keys: Sequence[str] = (), column: str = "phrase",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """All hits, rows with any hit, rows, and their percentage; one row per group."""
    parts = blocks(phrases, column, block_chars)
    if len(parts) == 1:
        found = rows.select(*keys, F.size(matcher(rows, parts[0])(reply)).alias("_hits"))
    else:  # a row's hits in all blocks meet under its number in a written table
        held = settle(rows.select(*keys, reply.alias("_reply")).withColumn("_row", F.monotonically_increasing_id()))
        sides = [held.select(*keys, "_row", F.size(matcher(held, part)(F.col("_reply"))).alias("_hits")) for part in parts]
        found = reduce(DataFrame.unionByName, sides).groupBy(*keys, "_row").agg(F.sum("_hits").alias("_hits"))
    return (
        found.groupBy(*keys)
        .agg(F.sum("_hits").cast("long").alias("hits"), F.count_if(F.col("_hits") > 0).alias("rows_with_hit"),
             F.count(F.lit(1)).alias("rows"))
        .withColumn("percent", F.lit(100.0) * F.col("rows_with_hit") / F.col("rows")))

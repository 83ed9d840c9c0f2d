"""Line dedup: suffix array over line ids by distributed prefix doubling, in DataFrame functions.

Each line gets a digest of 128 bits; a text is a sequence of line ids. Doubling gives runs of 1, 2, 4, 8
... lines one name if and only if the runs are equal: these are the ranks of a suffix array, kept only
where a rank is shared, since a suffix whose rank is its own is in place already; doubling ends when no
rank is shared. Two ranks of the largest power of two within a run, one at its start and one that ends
where it ends, are the rank of a run of any length.

A repeated run counts if it has MIN_WORDS words, or is the whole of both texts and has a word, whatever
its number of lines; later copies of runs that count are deleted. The places that share a run's rank are an interval
of the suffix array whose common prefix is at least as long as the run; the earliest keeps its lines. To
find what maximal runs cover it is enough to look, from each line on and up to each line, at the shortest
run that counts: every part of a repeated run is repeated, too, and each line of a run that counts lies in
such a shortest one within it. What is deleted is joined into maximal runs.

A place is (doc_id, copy, line), and what goes is judged on the input. Names that many places share
are counted by map-side aggregates and met again by a join that adaptive execution may split.

Defined cases: a null text has no lines and stays null; an empty text is one empty line; texts without
words stay; rows with a null doc_id stay whole and are no source of copies; rows with equal doc_id and
text are one place and stay or go together; rows with equal doc_id and other texts are ordered by a digest
of the text; other columns, whatever their names, stay as they are; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import scratch

MIN_WORDS = 50
_KEY = ["doc_id", "copy"]
_WORD = r"[^\x20\x09-\x0D]+"


def _keyed(documents: DataFrame) -> DataFrame:
    """The whole row as one struct next to its key, so that no other column's name matters."""
    text = F.col("text").cast("string")
    return documents.select(
        F.struct(*[F.col(f"`{x}`") for x in documents.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"), text.alias("text"))


def line_table(documents: DataFrame) -> DataFrame:
    """doc_id, copy, line, a digest in two halves, words, and how many lines the text has."""
    lines = F.split("text", "\n", -1)
    return (
        _keyed(documents).where("doc_id is not null and text is not null")
        .select(*_KEY, F.size(lines).alias("lines"), F.posexplode(lines).alias("line", "words"))
        .select(*_KEY, "line", F.xxhash64("words").alias("name"), F.xxhash64(F.lit("second"), "words").alias("check"),
                F.regexp_count("words", F.lit(_WORD)).alias("words"), "lines"))


def _place(line: str = "line") -> Column:
    return F.struct(*_KEY, line)


def shared(names: DataFrame) -> DataFrame:
    """Rows whose name occurs at two places at least."""
    groups = scratch(
        names.groupBy("name", "check").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"))
        .where("first != last").select("name", "check"))  # a table, so the join below has shuffles that may be split
    return names.join(groups, ["name", "check"]).select(*names.columns)


def doubled(places: DataFrame, length: int) -> DataFrame:
    """Names of runs of twice `length` lines from names of runs of `length`."""
    here = Window.partitionBy(*_KEY).orderBy("line").rangeBetween(length, length)
    return (
        places.select(*_KEY, "line", "name", "check", F.first("name").over(here).alias("_name"),
                      F.first("check").over(here).alias("_check"))
        .where("_name is not null")
        .select(*_KEY, "line", F.xxhash64("name", "_name").alias("name"),
                F.xxhash64("check", "_check").alias("check")))


def shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """doc_id, copy, line, length of the shortest runs of shared lines that count, and of whole texts.

    Lines of a text that are shared and follow each other are a stretch. In one ordered by words so far,
    the first line that makes a run long enough, or the last one it can start at, is a running minimum or
    maximum.
    """
    by_line = Window.partitionBy(*_KEY).orderBy("line")
    told = lines.withColumn("stretch", F.col("line") - F.row_number().over(by_line))
    stretch = Window.partitionBy(*_KEY, "stretch")
    told = told.withColumn("upto", F.sum("words").over(stretch.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    told = scratch(told.select(*_KEY, "line", "words", "stretch", "upto", "lines"))
    before = F.col("upto") - F.col("words")

    def events(asked: Column, answer: Column) -> DataFrame:
        return told.select(*_KEY, "stretch", "line", F.explode(F.array(
            F.struct(F.lit(0).alias("asks"), answer.alias("value")), F.struct(F.lit(1).alias("asks"), asked.alias("value")))).alias("e")
        ).select(*_KEY, "stretch", "line", "e.*")

    known = F.when(F.col("asks") == 0, F.col("line"))
    so_far = (Window.unboundedPreceding, 0)
    down = stretch.orderBy(F.col("value").desc(), "asks").rowsBetween(*so_far)
    up = stretch.orderBy("value", "asks").rowsBetween(*so_far)
    onward = events(before + min_words, F.col("upto")).withColumn("end", F.min(known).over(down)).where("asks = 1 and end is not null")
    back = events(F.col("upto") - min_words, before).withColumn("start", F.max(known).over(up)).where("asks = 1 and start is not null")
    whole = told.groupBy(*_KEY).agg(
        F.count("*").alias("_n"), F.max("lines").alias("lines"), F.sum("words").alias("_words")).where("_n = lines and _words > 0")
    length = F.col("end") - F.col("line") + 1
    return (
        onward.select(*_KEY, "line", length.alias("length"))
        .unionAll(back.select(*_KEY, F.col("start").alias("line"), (F.col("line") - F.col("start") + 1).alias("length")))
        .unionAll(whole.select(*_KEY, F.lit(0).alias("line"), F.col("lines").alias("length"))).distinct())


def levels(lines: DataFrame, longest: int) -> DataFrame:
    """Shared places with their names at each power of two up to `longest` lines, and its exponent."""
    places, power, found = lines.select(*_KEY, "line", "name", "check"), 0, []
    while True:
        found.append(places.withColumn("power", F.lit(power)))
        if 2 << power > longest:
            break
        places = scratch(shared(scratch(doubled(places, 1 << power))))
        power += 1
        if places.isEmpty():
            break
    return reduce(DataFrame.unionAll, found)


def later_runs(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, copy, line, length of runs that count and occur at an earlier place, too."""
    lines = scratch(shared(scratch(line_table(documents))).dropDuplicates([*_KEY, "line"]))
    runs = scratch(shortest_runs(lines, min_words).withColumn("power", F.length(F.bin("length")) - 1))
    longest = runs.agg(F.max("length").alias("n")).first()["n"] or 1
    names = levels(lines, longest)
    ends = runs.withColumn("start", F.col("line")).withColumn("line", F.expr("line + length - cast(shiftleft(1, power) as int)"))
    on = [*_KEY, "line", "power"]
    half = ends.join(names.withColumnsRenamed({"name": "_name", "check": "_check"}), on).drop("line").withColumnRenamed("start", "line")
    named = scratch(half.join(names, on).select(
        *_KEY, "line", "length", F.xxhash64("length", "name", "_name").alias("name"), F.xxhash64("length", "check", "_check").alias("check")))
    groups = scratch(
        named.groupBy("name", "check").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"))
        .where("first != last").select("name", "check", "first"))
    return named.join(groups, ["name", "check"]).where(F.col("first") != _place()).select(*_KEY, "line", "length")


def removed_runs(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, copy and the maximal runs (first line, line after the last one) that go, in order."""
    found = later_runs(documents, min_words).select(*_KEY, F.col("line").alias("a"), (F.col("line") + F.col("length")).alias("b"))
    by = Window.partitionBy(*_KEY).orderBy("a", "b")
    reached = F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = found.withColumn("_new", (F.col("a") > F.coalesce(reached, F.lit(-1))).cast("int"))
    joined = fresh.withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = joined.groupBy(*_KEY, "_run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return runs.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))


def with_kept(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Each row as `row` with doc_id, its text and: lines, runs that go, kept (the other lines)."""
    gone = removed_runs(documents, min_words)
    return (
        _keyed(documents).join(gone, _KEY, "left").withColumn("lines", F.split("text", "\n", -1))
        .withColumn("kept", F.when(F.col("runs").isNull(), F.col("lines")).otherwise(F.filter(
            "lines", lambda _, i: ~F.exists("runs", lambda r: (i >= r["a"]) & (i < r["b"]))))))


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The table with later copies of runs of lines cut out; rows of which nothing is left go.

    n_chars, if there is such a column, counts the characters that are left.
    """
    rows = with_kept(documents, min_words).where("runs is null or size(kept) > 0")
    rows = rows.withColumn("_text", F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")))
    out = []
    for name in documents.columns:
        if name.lower() == "text":
            out.append(F.col("_text").alias(name))
        elif name.lower() == "n_chars":
            cut = F.length("_text").cast(documents.schema[name].dataType)
            out.append(F.when(F.col("runs").isNotNull(), cut).otherwise(F.col("row")[name]).alias(name))
        else:
            out.append(F.col("row")[name].alias(name))
    return rows.select(*out)


def report(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: lines, removed lines, maximal removed runs, lines of the longest, digest of the rest."""
    sizes = F.coalesce(F.transform("runs", lambda r: r["b"] - r["a"]), F.array().cast("array<int>"))
    rest = F.coalesce(F.array_join("kept", "\n"), F.lit(""))
    return with_kept(documents, min_words).select(
        "doc_id",
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.aggregate(sizes, F.lit(0), lambda a, x: a + x).cast("long").alias("n_removed"),
        F.size(sizes).cast("long").alias("n_runs"),
        F.coalesce(F.array_max(sizes), F.lit(0)).cast("long").alias("longest_run"),
        F.sha2(rest.cast("binary"), 256).alias("kept_sha256"))

"""Objects of one large JSON document, cut out where they lie by many tasks.

Spark's text reader splits files at any separator. Here it is the closing brace, so a task gets the
pieces of its byte range in order. Whether a range starts inside a string, how deeply nested, and which
element it continues depends on what stands before it, so a first pass sums up each range under both
assumptions about strings: parity of quotes, change of depth, objects opened by relative depth. Running
sums over the ranges of a file, one row each, give every range its true state. A second pass cuts elements
out; only those that cross a border of ranges are put together from fragments, by a shuffle.

What is not an element is the document's outline: the few texts around runs of elements, with a mark in
place of each run. It is parsed strictly, so stray text between elements is an error, not lost.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.operators.validate import guard
from turnloom.session import settle

_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*("?)|\\.|[{\[\]]', re.S)
_REST = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*("?)', re.S)
_COMMA = re.compile(r"\s*,\s*")
_MOST_RANGES = 1 << 18  # states of so many ranges are broadcast, about 20 MB
_BATCH_CHARS = 4 << 20


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Texts up to each closing brace, with their file and the start of their byte range.

    Both passes must see the same ranges, so the number that Spark aims for is held.
    """
    setting = "spark.sql.files.minPartitionNum"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, str(spark.sparkContext.defaultParallelism))
    return spark.read.text(path, lineSep="}").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


@dataclass
class _Scanner:
    """Reads pieces one by one; `inside` tells whether a string goes on, `depth` counts open brackets."""

    inside: bool
    depth: int = 0

    def brackets(self, piece: str) -> Iterator[tuple[int, int]]:
        """Position of each bracket outside strings, and the depth that holds before it."""
        at = 0
        if self.inside:
            rest = _REST.match(piece)
            at, self.inside = rest.end(), not rest.group(1)
        if not self.inside:
            for token in _TOKEN.finditer(piece, at):
                sign = piece[token.start()]
                if sign == '"':
                    self.inside = not token.group(1)
                elif sign != "\\":
                    yield token.start(), self.depth
                    self.depth += -1 if sign == "]" else 1

    def close(self) -> None:
        """The closing brace after a piece."""
        if not self.inside:
            self.depth -= 1


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[tuple]]]:
    """Rows of each range in turn; a task reads its ranges one after another."""
    rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))))
    row = next(rows, None)
    while row is not None:
        key, held = row[1:3], [row]

        def same() -> Iterator[tuple]:
            while held[0] is not None and held[0][1:3] == key:
                yield held[0]
                held[0] = next(rows, None)

        yield key, same()
        row = held[0]


_SUMMARY = "file string, block long, inside boolean, flips int, change long, opened map<int,long>"


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two rows per range: what it does if it starts outside, or inside, a string."""
    for (file, block), rows in _by_range(batches):
        scanners, opened = [_Scanner(False), _Scanner(True)], [Counter(), Counter()]
        for piece, *_ in rows:
            for scanner, seen in zip(scanners, opened):
                for at, depth in scanner.brackets(piece):
                    if piece[at] == "{":
                        seen[depth] += 1
                scanner.close()
        yield pa.RecordBatch.from_pydict({
            "file": [file] * 2, "block": [block] * 2, "inside": [False, True],
            "flips": pa.array([int(scanners[0].inside)] * 2, pa.int32()),
            "change": [x.depth for x in scanners],
            "opened": pa.array([list(x.items()) for x in opened], pa.map_(pa.int32(), pa.int64()))})


def _states(pieces: DataFrame, level: int) -> DataFrame:
    """Per range: whether it starts inside a string, its depth, the elements opened before it, and
    whether its last piece ends the file without a brace.

    A document ends at depth 0, so if every piece is taken to end with a brace, one too many is closed
    exactly if the last piece has none.
    """
    sums = settle(pieces.mapInArrow(_sum_up, _SUMMARY))
    of_file = Window.partitionBy("file")
    before = of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def earlier(name: str) -> Column:
        return F.coalesce(F.sum(name).over(before), F.lit(0))

    starts = sums.where("not inside").select("file", "block", (earlier("flips") % 2 == 1).alias("inside"))
    told = sums.join(starts, ["file", "block", "inside"]).withColumns({
        "depth": earlier("change").cast("int"), "total": F.sum("change").over(of_file),
        "flipped": F.sum("flips").over(of_file) % 2, "last": F.max("block").over(of_file)})
    told = guard(told, F.col("total").isin(0, -1) & (F.col("flipped") == 0),
                 F.concat(F.lit("brackets or quotes of the document do not match: "), "file"))
    told = told.withColumn("opened", F.coalesce(F.try_element_at("opened", F.lit(level) - F.col("depth")), F.lit(0)))
    return told.select(
        "file", "block", "inside", "depth", earlier("opened").alias("first"),
        ((F.col("block") == F.col("last")) & (F.col("total") == -1)).alias("ends"))


#: Fragments and texts outside have a column of their own, so that parsing values, which Spark may do
#: before it looks at the kind, never meets them.
_CUT = "file string, kind string, element long, block long, place long, value string, other string"


def _marked(rows: Iterator[tuple]) -> Iterator[tuple[tuple, bool]]:
    """Rows with whether each is the last one."""
    held = next(rows, None)
    while held is not None:
        row, held = held, next(rows, None)
        yield row, held is None


def _cut(level: int):
    """Whole elements, fragments of elements that cross a border, and texts outside elements."""
    def of_range(file: str, block: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        scanner, element, parts, whole = None, 0, [], False
        for place, ((piece, _, _, inside, depth, first, ends), final) in enumerate(_marked(rows)):
            if scanner is None:
                scanner, element = _Scanner(inside, depth), first - 1
            gap, held, after = 0, scanner.depth > level, scanner.depth == level
            for at, depth_here in scanner.brackets(piece):
                if piece[at] == "{" and depth_here == level:
                    text = piece[:at]
                    if not (after and _COMMA.fullmatch(text)):
                        yield file, "gap", element, block, place, text
                    element, gap, held, whole = element + 1, at, True, True
            unclosed = final and ends
            said = piece[gap:] + ("" if unclosed else "}")
            if not unclosed:
                scanner.close()
            if not held:
                yield file, "gap", element, block, place, said
                continue
            parts.append(said)
            if scanner.depth == level:
                yield file, "whole" if whole else "part", element, block, place, "".join(parts)
                parts, whole = [], False
        if parts:
            yield file, "part", element, block, place, "".join(parts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for (file, block), rows in _by_range(batches):
            for row in of_range(file, block, rows):
                found.append(row)
                size += len(row[5])
                if size > _BATCH_CHARS:
                    yield _cut_batch(found)
                    found, size = [], 0
        if found:
            yield _cut_batch(found)

    return work


def _cut_batch(found: list[tuple]) -> pa.RecordBatch:
    kinds = {
        "file": pa.string(), "kind": pa.string(), "element": pa.int64(), "block": pa.int64(), "place": pa.int64(),
        "value": pa.string(), "other": pa.string()}
    rows = [(*row[:5], *((row[5], None) if row[1] == "whole" else (None, row[5]))) for row in found]
    return pa.RecordBatch.from_pydict({
        name: pa.array(values, kind) for (name, kind), values in zip(kinds.items(), zip(*rows))})


def json_elements(spark: SparkSession, path: str, level: int) -> tuple[DataFrame, DataFrame]:
    """Objects opened at depth ``level`` of the documents of ``path``, and texts outside them.

    Elements: ``file, element, value`` with elements numbered from 0 in each file. Texts outside:
    ``file, element, block, place, value``, where ``element`` is the one before; see :func:`outlines`.
    """
    pieces = _pieces(spark, path)
    states = settle(_states(pieces, level))
    if states.count() <= _MOST_RANGES:
        known = pieces.join(F.broadcast(states), ["file", "block"], "left")
    else:
        known = pieces.withColumn("_row", F.monotonically_increasing_id()).join(
            states.hint("merge"), ["file", "block"], "left").sortWithinPartitions("file", "block", "_row")
    known = guard(known, F.col("depth").isNotNull(), "the byte ranges of a document changed between two reads")
    cut = settle(known.select("value", "file", "block", "inside", "depth", "first", "ends").mapInArrow(_cut(level), _CUT))
    across = cut.where("kind = 'part'").groupBy("file", "element").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "other"))), lambda x: x["other"]), "").alias("value"))
    elements = cut.where("kind = 'whole'").select("file", "element", "value").unionByName(across)
    return elements, cut.where("kind = 'gap'").select("file", "element", "block", "place", F.col("other").alias("value"))


def _outline(file: str, gaps: list[tuple]) -> str:
    """A document's text with a string like "3:7" where elements 3 to 6 stand."""
    said, at = [], 0
    for element, _, _, value in sorted(gaps):
        if element + 1 > at:
            said.append(f'"{at}:{element + 1}"')
            at = element + 1
        said.append(value)
    text = "".join(said)
    try:
        json.loads(text)
    except json.JSONDecodeError as problem:
        raise ValueError(f"{file} is not one JSON document: {problem}") from None
    return text


def outlines(gaps: DataFrame) -> DataFrame:
    """``file, outline``: each document with "first:last" in place of each run of elements.

    What stands between runs must be small enough for one row; it fails where it is not strict JSON.
    """
    def work(table: pa.Table) -> pa.Table:
        file = table.column("file")[0].as_py()
        rows = zip(*(table.column(x).to_pylist() for x in ("element", "block", "place", "value")))
        return pa.table({"file": [file], "outline": [_outline(file, list(rows))]})

    return gaps.groupBy("file").applyInArrow(work, "file string, outline string")

"""Readers for JSON documents, JSON lines and raw bytes."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom import schemas
from turnloom.functions.text import is_blank
from turnloom.operators.validate import guard
from turnloom.session import settle
from turnloom.sources.json_elements import json_elements, outlines

_PIECE = 8 << 20
SOURCE_ORDER = ("source_file", "source_block", "source_row")


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    """Episodes of JSON array documents; ``episode_id`` goes on from file to file, by file name.

    A document of any size is read by many tasks; one that is not an array of objects fails the read.
    """
    elements, gaps = json_elements(spark, path, 1)
    outline = settle(guard(
        outlines(gaps), F.col("outline").rlike(r'^\s*\[\s*("0:\d+")?\s*\]\s*$'),
        F.concat(F.lit("not an array of objects: "), F.col("file"))))
    count = F.coalesce(F.try_to_number(F.regexp_extract("outline", r":(\d+)", 1), F.lit("999999999999")).cast("long"), F.lit(0))
    # one row per file
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(outline.select("file", F.coalesce(F.sum(count).over(earlier), F.lit(0)).alias("_offset")))
    return elements.join(offsets, "file").select(
        (F.col("_offset") + F.col("element")).alias("episode_id"),
        F.from_json("value", schemas.EPISODE, {"mode": "FAILFAST"}).alias("_e")).select("episode_id", "_e.*")


def read_choice_items(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """Settings and item frame of one choice-data document, whose questions are read by many tasks.

    What is left without the questions must fit the driver: a few texts per subject.
    """
    elements, gaps = json_elements(spark, path, 4)
    found = outlines(gaps).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{path} must be one document")
    document = json.loads(found[0]["outline"])
    runs = []
    for subject in document["subjects"]:
        for split in ("dev", "test"):
            for run in subject.get(split) or []:
                first, last = map(int, run.split(":"))
                runs.append((subject["subject"], split, first, last))
    schema = "subject string, split string, _first long, _last long"
    placed = elements.join(
        F.broadcast(spark.createDataFrame(runs, schema)),  # two rows a subject
        (F.col("element") >= F.col("_first")) & (F.col("element") < F.col("_last")))
    items = placed.select(
        "subject", "split", (F.col("element") - F.col("_first")).cast("int").alias("idx"),
        F.from_json("value", schemas.QUESTION, {"mode": "FAILFAST"}).alias("_q"))
    header = {name: value for name, value in document.items() if name != "subjects"}
    return header, items.select("subject", "split", "idx", "_q.question", "_q.choices", "_q.answer")


def read_episode_lines(spark: SparkSession, path: str) -> DataFrame:
    """Episodes written one per line, each with its ``episode_id``; splits across tasks."""
    schema = T.StructType([T.StructField("episode_id", T.LongType())] + schemas.EPISODE.fields)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_lines(
    spark: SparkSession, path: str, schema: T.StructType, skip_blank: bool = False,
) -> DataFrame:
    """Typed JSON lines plus columns that sort back to file order.

    A malformed line always fails the read; a blank one does unless skipped.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("source_block"),
        F.monotonically_increasing_id().alias("source_row"))
    present = ~is_blank(F.col("value"))
    lines = lines.filter(present) if skip_blank else guard(
        lines, present, F.concat(F.lit("blank line in "), F.col("source_file")))
    return lines.select(
        *SOURCE_ORDER, F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_row")
    ).select(*SOURCE_ORDER, "_row.*")


def read_json_document(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One row from a file that holds one JSON object."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("mode", "FAILFAST").json(path, multiLine=True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_settings(spark: SparkSession, path: str) -> dict | None:
    """A small settings document as a dict, or None where there is none yet."""
    if not exists(spark, path):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, sha256`` of every file, hashed by the tasks in pieces of a fixed size.

    Spark lists the files; their bytes are never held as a row, so files may have any size.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            found = []
            for name in batch["path"]:
                # local paths come as file:/x, object stores with the name of their Hadoop client
                name = re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", name))
                system, place = fs.FileSystem.from_uri(quote(name, safe=":/"))
                value = hashlib.sha256()
                with system.open_input_stream(place) as stream:
                    while piece := stream.read(_PIECE):
                        value.update(piece)
                found.append(value.hexdigest())
            yield batch.assign(sha256=found)

    return listed.repartition("path").mapInPandas(digest, "path string, bytes long, sha256 string")


def require_digest(files: DataFrame, expected: str) -> None:
    """Refuse data that is not the frozen file."""
    if [r["sha256"] for r in files.limit(2).collect()] != [expected]:
        raise ValueError("the data file is not the one that the manifest was frozen for")

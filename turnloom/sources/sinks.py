"""Writers. A failed write leaves what was there before."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators.pairs import pair_documents
from turnloom.operators.resume import remaining
from turnloom.operators.validate import guard
from turnloom.sources.files import exists


def replace_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Write a folder next to its place and swap it in once the job has committed.

    Spark's own overwrite deletes the old folder before the new rows exist. If the new folder
    cannot be moved in, the old one is moved back.
    """
    new, old = f"{path}.{uuid.uuid4().hex}.tmp", f"{path}.{uuid.uuid4().hex}.old"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write(new)
    except Exception:
        fs.delete(hadoop_path(new), True)
        raise
    had_old = exists(spark, path)
    if had_old and not fs.rename(hadoop_path(path), hadoop_path(old)):
        raise OSError(f"could not set {path} aside")
    try:
        moved = fs.rename(hadoop_path(new), hadoop_path(path))
    except Exception:
        moved = False
    if not moved:
        if had_old and not fs.rename(hadoop_path(old), hadoop_path(path)):
            raise OSError(f"could not move the new rows to {path}; the old ones are in {old}")
        fs.delete(hadoop_path(new), True)
        raise OSError(f"could not move the new rows to {path}; the old ones are still there")
    if had_old:
        fs.delete(hadoop_path(old), True)


def write_episode_lines(lines: DataFrame, titles: DataFrame, path: str) -> None:
    """Nested episodes, one JSON object per line, after the caller's completeness check.

    ``titles``: ``episode_id, title, url``. An episode is one page, so its lines
    fit a row.
    """
    nested = lines.groupBy("episode_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("line", "speaker", "text", "scene"))),
        lambda l: F.struct(l.speaker.alias("speaker"), l.text.alias("text"), l.scene.alias("scene")),
    ).alias("lines"))
    episodes = titles.join(nested, "episode_id").select("episode_id", "title", "url", "lines")
    replace_folder(lines.sparkSession, path, lambda new: episodes.write.json(new))


def write_pair_lines(pairs: DataFrame, path: str, order: Sequence[str] = ("episode_id", "line")) -> None:
    """One folder of JSON lines per split, in source order across its part files.

    Ranges of the order become files, so no single task writes a whole split.
    """
    documents = pair_documents(pairs).select(
        "split", *order, F.to_json(F.struct("messages", "meta")).alias("value"))
    ordered = (
        documents.repartitionByRange("split", *order)
        .sortWithinPartitions("split", *order)
        .select("split", "value")
    )
    replace_folder(pairs.sparkSession, path, lambda new: ordered.write.partitionBy("split").text(new))


def append_results(results: DataFrame, path: str, keys: Sequence[str], schema=None) -> None:
    """Append only rows whose keys are not saved yet; running it twice changes nothing."""
    spark = results.sparkSession
    if exists(spark, path):
        results = remaining(results, spark.read.schema(schema or results.schema).json(path), keys)
    results.write.mode("append").json(path)


def finite_or_fail(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """JSON has no NaN or infinity; fail the write instead of storing one."""
    ok: Column = F.lit(True)
    for name in columns:
        value = F.col(name).cast("double")
        ok = ok & (value.isNull() | (~F.isnan(value) & (F.abs(value) != float("inf"))))
    return guard(rows, ok, "Out of range float values are not JSON compliant")


def write_json_document(spark: SparkSession, path: str, value: dict) -> None:
    """Replace a small JSON document in one step: write next to it, then rename over it."""
    text = json.dumps(value, indent=2, ensure_ascii=False, allow_nan=False) + "\n"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    partial = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(conf)
    out = fs.create(partial, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(
        fs.makeQualified(partial), fs.makeQualified(target), options)


def write_json_arrays(rows: DataFrame, path: str, order: Sequence[str], arrays: int) -> None:
    """Write rows as JSON objects, in order, into files that hold one JSON array each.

    Rows are dealt by ranges of the order, so the files' names sort as their rows do.
    """
    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = "["
        for batch in batches:
            for value in batch.column("value").to_pylist():
                yield pa.RecordBatch.from_pydict({"value": [said + value]})
                said = ","
        yield pa.RecordBatch.from_pydict({"value": ["]" if said == "," else "[]"]})

    shown = rows.repartitionByRange(arrays, *order).sortWithinPartitions(*order).select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    shown.mapInArrow(bracketed, "value string").write.text(path)

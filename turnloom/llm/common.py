"""Words, hashes, Arrow batches and shared scratch tables of the operators.

Every operator first picks the columns it needs by name and casts them, so null columns, extra
columns and other integer types do not matter. A null text has no words.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 512
BATCH_BYTES = 8 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def shared_dir(spark: SparkSession) -> str:
    """Folder named in spark.checkpoint.dir; a private one only for a local master without it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.conf.set("spark.checkpoint.dir", folder := tempfile.mkdtemp(prefix="turnloom-llm-"))
    return folder


def scratch(rows: DataFrame) -> DataFrame:
    """Write rows as Parquet to the shared folder and read them back: lineage ends there."""
    path = f"{shared_dir(rows.sparkSession)}/llm-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds: rows, and bytes where the version knows that setting."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lowest(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """The `most` rows with the smallest digests of the columns `by`: a sample that any run repeats.

    Digests are spread evenly, so a bound on them lets about that many rows out of all tasks
    together, however many tasks there are; the order and the limit then make the number exact.
    """
    place = F.xxhash64(*by)
    share = min(1.0, (1.5 * most + 200) / max(1, rows.count()))
    bound = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
    return (
        rows.where(place <= F.lit(bound)).withColumn("_place", place)
        .orderBy("_place", *rows.columns).limit(most).drop("_place"))


def texts(documents: DataFrame) -> DataFrame:
    """doc_id long and text string of every row, whatever else the table has."""
    small_batches(documents.sparkSession)
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text, empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def lowered(raw: bytes) -> bytes:
    """A-Z in lower case; other characters stay (bytes.lower only knows ASCII)."""
    return raw.lower()


def word_hashes(words: Iterable[bytes], count: int) -> np.ndarray:
    """64-bit hash of each word."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, count)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread every input bit over all bits (finaliser of a multiply-xorshift generator)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of each run of `width` values, from prefix sums modulo 2**64."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        powers = np.full(len(hashes), _BASE, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers, out=sums[1:])
        inverse = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        return mixed((sums[width:] - sums[:n]) * inverse)


def split_batch(raws: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, hashes of all of them in a row, and each text's first place there."""
    lists = [raw.split() for raw in raws]
    starts = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=starts[1:])
    hashes = word_hashes(chain.from_iterable(lists), int(starts[-1]))
    return lists, hashes, starts


def give_back() -> None:
    """Return freed memory to the system, as workers live on from task to task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def arrow_map(rows: DataFrame, work, schema: str, together: int = BATCH_ROWS, done=lambda: None) -> DataFrame:
    """mapInArrow with a function from a batch of at most `together` rows to a dict of columns.

    `done` is called at the end of each task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema), prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, together):
                found = work(whole.slice(at, together))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[f.name], f.type) if not isinstance(found[f.name], pa.Array)
                     else found[f.name].cast(f.type) for f in arrow], schema=arrow)
        done()
        give_back()

    return rows.mapInArrow(run, schema)

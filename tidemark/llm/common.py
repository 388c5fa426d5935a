"""Small helpers of the operators: tables, unique names, shared folders, Arrow text buffers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_folder

#: Text bytes that one numpy step works on; bounds the memory of a Python worker.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` below the shared checkpoint folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI and the path inside it; a bare path is a local one."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column, without copying; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (wide or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        raise TypeError(f"not a text column: {column.type}")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at.astype(np.int64)


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes; a longer text is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def single(batch: pa.RecordBatch, name: str) -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def range_shard(keys: DataFrame, key: str, shards: int, sample: int = 20_000) -> Column:
    """The number of the range a key is in: ascending ranges of about equal row counts.

    The bounds come from the keys whose hash is lowest - the same keys however the input is
    partitioned, about ``sample`` of them - so the ranges are deterministic and only the key column
    is read for them. Null keys are in range 0. Every row has a range; the sample sets bounds only.
    """
    rows = keys.count()
    if shards <= 1 or rows == 0:
        return F.lit(0)
    step = max(1, rows // sample)
    chosen = keys.select(key).filter(F.pmod(F.xxhash64(key), F.lit(step)) == 0).filter(F.col(key).isNotNull())
    found = sorted(r[0] for r in chosen.distinct().limit(8 * sample).collect())
    bounds = sorted({found[len(found) * i // shards] for i in range(1, shards)}) if found else []
    if not bounds:
        return F.lit(0)
    # Two levels, so that a row meets about 2 * sqrt(shards) bounds.
    width = max(1, int(len(bounds) ** 0.5))
    every, coarse = F.lit(np.array(bounds)), F.lit(np.array(bounds[::width]))
    passed = F.size(F.filter(coarse, lambda b: b <= F.col(key)))
    near = F.slice(every, (F.greatest(passed, F.lit(1)) - 1) * width + 1, F.lit(width))
    place = (F.greatest(passed, F.lit(1)) - 1) * width + F.size(F.filter(near, lambda b: b <= F.col(key)))
    return F.when(F.col(key).isNull(), 0).otherwise(place).cast("int")


def input_tasks(df: DataFrame) -> int:
    """Tasks that reading ``df`` takes, but one per core at least: they follow the input's size."""
    return max(df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism)

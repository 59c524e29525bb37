"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that separate words and are stripped from line ends.
SPACE = b" \t\n\x0b\x0c\r"
#: The same, inside a regular-expression class.
SPACE_CLASS = r"\x20\x09-\x0D"

_ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<bigint>": pa.list_(pa.int64()),
    "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder.

    The session no longer takes a union's partitioning from its branches: Spark 4.1 does so though adaptive execution may coalesce each
    branch in its own way, and a grouping above then gives one key several rows.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set, as in tests."""
    return spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The plan below is cut there, so a lost executor costs a reread of that table
    and not a recomputation. The table is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/vellum-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """What is run inside sends Python at most ``rows`` rows a batch; after it, the session's setting holds again."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def give_back() -> None:
    """At a task's end, memory that Arrow and the C library hold free goes back to the system: a worker stays beside those of the next stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_arrays(columns: list[list], types: list[str]) -> list[pa.Array]:
    return [pa.array(c, type=_ARROW[t]) for c, t in zip(columns, types, strict=True)]


#: Bytes of text that a function gets at once, or one longer text.
PART = 4 << 20


def append(df: DataFrame, make: Callable[[], Callable[[list[bytes]], list]], fields: dict[str, str], text: str = "text") -> DataFrame:
    """Add columns that a function computes from whole texts, some ``PART`` bytes of them at a time.

    ``make`` runs once a task and returns the function, which takes the texts
    as UTF-8 and returns one list or Arrow array for each new column.
    """
    at = df.columns.index(text)
    names, types = list(fields), list(fields.values())
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in fields.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in split(batch, at, PART):
                new = [c if isinstance(c, pa.Array) else pa.array(c, type=_ARROW[t]) for c, t in zip(compute(utf8(part.column(at))), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *names])
        give_back()

    return df.mapInArrow(run, schema)


def split(batch: pa.RecordBatch, column: str | int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have at most ``size`` bytes together, or one longer text."""
    ends = np.cumsum([0, *pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()])
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + size, side="right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def flat_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], fields: dict[str, str], last: bool = False, most: tuple[str, int] | None = None) -> DataFrame:
    """Rows of another schema from each Arrow batch.

    ``make`` runs once a task and returns a function from a batch to one list or array
    for each field. With ``last``, that function is called once more with None at the task's end. ``most`` names a column of texts and how many of its bytes, or one longer text, a batch holds.
    """
    names, types = list(fields), list(fields.values())
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()

        def out(batch):
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=_ARROW[t]) for c, t in zip(compute(batch), types, strict=True)], names=names)

        for batch in batches:
            for part in split(batch, *most) if most else [batch]:
                yield out(part)
        if last:
            yield out(None)
        del compute
        give_back()

    return df.mapInArrow(run, schema)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that whatever else a table holds can't clash."""
    return df.select(*(F.col(f"`{n}`") for n in names))

"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: ``[\x20\x09-\x0D]``, as a Java character class.
JAVA_SPACE = r"[\x20\x09-\x0D]"
#: Settings under which stage tables are written: shuffle files go as soon as the
#: table is there, and a batch for a Python worker holds a bounded number of bytes.
WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; works for any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder of its machine; on a
    cluster that is an error, for executors would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="braidline-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings are ``values`` meanwhile, and what they were afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it is computed once,
    its lineage ends there, and it survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with settings(spark, WHILE_WRITING):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def unsent(df: DataFrame) -> DataFrame:
    """For a side of a join: neither side is broadcast, whatever size the planner takes from files.

    A table of 10 MB may be millions of rows, and those made from it many times more;
    the driver would hold them all.  Both sides are sorted instead, and spill.
    """
    return df.hint("merge")


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of texts and where each begins (one place more than rows); null is empty."""
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, places, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(places, np.int64 if wide else np.int32)[array.offset:array.offset + len(array) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def portions(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes each, or of one row."""
    a = 0
    while a < len(at) - 1:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield a, b
        a = b


def keyed(docs: DataFrame, key: str, text: str, of: Callable[[pa.RecordBatch], list[pa.Array]], columns: str, more: dict[str, Column] | None = None) -> DataFrame:
    """(k, more, columns) of every row, the columns made from Arrow batches with k, t and ``more``.

    Keys and ``more`` go through as they are, so null and wide ones stay exact.
    """
    more = more or {}
    own = docs.select(F.col(key).alias("k"), *(c.alias(n) for n, c in more.items()), F.col(text).alias("t"))
    held = ["k", *more]
    names = [*held, *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), *of(batch)], names)

    schema = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in held)
    return own.mapInArrow(run, f"{schema}, {columns}")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}" in taken:
        name += "_"
    return f"_{name}"


def content_id(text: str | Column) -> tuple[Column, Column]:
    """The first 128 bits of a text's SHA-256 as two longs: equal for equal texts only."""
    sha = F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)
    return tuple(F.conv(F.substring(sha, a, 16), 16, -10).cast("long") for a in (1, 17))


def id_crc(column: str):
    """CRC-32 of an id written as decimal text; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(-1))


def drop_stage(df: DataFrame) -> None:
    """Delete a stage table that nothing will read again."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stage_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

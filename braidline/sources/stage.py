"""Stage tables: results that are written once to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Paths of what is staged, by application and name.
_PATHS: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="braidline-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


#: A task that sorts or hashes gets about so many bytes of the tables that are read.
TASK_BYTES = 16 << 20


def tasks(*dfs: DataFrame) -> int:
    """Into how many tasks the rows go: by the bytes of the tables that are read, Spark's own number at least."""
    total = 0
    for df in dfs:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
        total += sum(s for s in sizes if s < 1 << 60)  # beyond that: a size that Spark does not know
    return max(int(dfs[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))


def spread(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """``df`` dealt out by its keys before a window or a join on them, so that what a task holds
    does not grow with the table.  Small tables are left to Spark."""
    n = tasks(df) if n is None else n
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def staged(spark: SparkSession, what: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The stage table of that name of this application; made when first asked for."""
    key = (spark.sparkContext.applicationId, what)
    if key not in _PATHS or not exists(spark, _PATHS[key]):
        _PATHS[key] = stage(make(), "view").stage_path
    return spark.read.parquet(_PATHS[key])

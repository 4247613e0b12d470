"""Staged tables in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, the context's checkpoint folder counts; in local mode a
    temporary folder is made, elsewhere a folder under the warehouse is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        named = "file://" + tempfile.mkdtemp(prefix="weftline-")
    else:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_weftline"
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a cut of lineage that outlives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    # shuffle files of the job just done go when the driver drops what refers to them; don't wait until its heap is full
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Remove the files behind staged tables that nothing reads any more."""
    for df in tables:
        hadoop = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        jvm = df.sparkSession.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of whole texts small; larger settings of the session are lowered."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


Batches = Iterator[pa.RecordBatch]


def given_back(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, after which the worker gives memory that it no longer uses back; Spark keeps workers for later tasks."""

    def whole(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
        if trim is not None:
            trim(0)

    return whole


def is_small(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has at most ``rows`` rows; looks at no more than that many and one."""
    return df.limit(rows + 1).count() <= rows


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it as long as ``df`` has such a column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

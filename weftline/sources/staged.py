"""Tables written to the folder that driver and executors share, where a plan has to be cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the cluster names it; only where nothing is named a folder is chosen, a temporary one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        alone = master.startswith("local") and not master.startswith("local-cluster")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='weftline-')}" if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_weftline")
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def staged(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a Parquet table in the shared folder: what is read from it is the same at every read, whatever executors are lost."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)

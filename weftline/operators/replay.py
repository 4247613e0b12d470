"""Model calls behind an interface; here they are replayed from a recorded table, and nothing reaches a network."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


class Client(Protocol):
    """Answers a batch of prompts, in their order."""

    def generate(self, prompts: list[str]) -> list[str | None]: ...


def answered(rows: DataFrame, make_client: Callable[[], Client], prompt: str = "prompt", answer: str = "raw_response") -> DataFrame:
    """``rows`` with the client's answer to each prompt; a client is made once a task, batches follow Arrow's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            yield batch.assign(**{answer: client.generate(batch[prompt].tolist())})

    base = rows.drop(answer)
    return base.mapInPandas(run, StructType([*base.schema.fields, StructField(answer, StringType())]))


def replayed(rows: DataFrame, recorded: DataFrame, key: str = "example_id", answer: str = "raw_response", most_attempts: int = 3) -> DataFrame:
    """``rows`` with the first recorded attempt (key, attempt, answer, accepted) that was accepted, of ``most_attempts`` at most."""
    good = recorded.where(F.col("accepted") & (F.col("attempt") <= most_attempts))
    first = good.groupBy(key).agg(F.min_by(answer, "attempt").alias(answer), F.min("attempt").alias("attempt"))
    return rows.join(first, key)


def append_records(records: DataFrame, path: str, key: str = "assignment_id") -> DataFrame:
    """Add records to a log of Parquet files, without those whose key is in it; the log as it stands then.

    A run that was cut off is taken up where it stopped: what it wrote counts.
    """
    spark = records.sparkSession
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
        records = records.join(spark.read.schema(records.schema).parquet(path).select(key), key, "left_anti").select(*records.columns)
    records.dropDuplicates([key]).write.mode("append").parquet(path)
    return spark.read.schema(records.schema).parquet(path)

"""Helpers of the corpus operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.state import shared_folder

#: White space and words as the contracts of the queries define them (Java and Python regex classes).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def new_folder(spark, name: str) -> str:
    """A new path under the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as Parquet in the shared folder and reads it back: lost executors never repeat the work before."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value) with `value` worked out once per row, however often the lambda functions in `body` use it."""
    return F.transform(F.array(value), body)[0]


@contextmanager
def small_batches(spark, records: int = 256, size: int = 16 << 20):
    """What is run inside gives Python so many rows, or about so many bytes, at a time: for rows with long texts."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(records), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names hold."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")

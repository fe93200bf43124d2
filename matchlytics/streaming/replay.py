"""Runs a streaming plan over everything that is available and hands back its output as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.state import shared_folder


def work_folder(spark: SparkSession) -> str:
    """A new folder under the shared folder of the session."""
    return f"{shared_folder(spark)}/replay-{uuid.uuid4()}"


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """File stream over a parquet table, one file or a folder of files, with their schema.

    Spark takes a plain path for a folder, so the last letter is written as a one-letter glob.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def match_ends(rows: DataFrame, by: str = "match_id") -> DataFrame:
    """Stream of the ends of matches (by, ts): the time of the last row of each, written as a table first."""
    path = f"{work_folder(rows.sparkSession)}/ends"
    rows.groupBy(by).agg(F.max("ts").alias("ts")).write.parquet(path)
    return stream_table(rows.sparkSession, path)


def run_available(plan: DataFrame) -> DataFrame:
    """Writes all closed results of a streaming plan to files and reads them back.

    Where the plan knows the ends of the matches, that is everything.
    """
    spark = plan.sparkSession
    folder = work_folder(spark)
    query = (plan.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out")
             .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(plan.schema).parquet(f"{folder}/out")

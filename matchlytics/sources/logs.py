"""Tool logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LOG_KEYWORDS
from ..functions.ordered import keys_of
from ..functions.text import contains_any


def triage_log(lines: DataFrame, *, by="run_id", keywords=LOG_KEYWORDS, tail: int = 12) -> DataFrame:
    """The last distinct error lines of a run (by first occurrence), or its last lines if none is flagged."""
    keys = keys_of(by)
    flagged = lines.filter(contains_any(F.lower("line"), keywords))
    first = flagged.groupBy(*keys, "line").agg(F.min("line_no").alias("line_no"))
    # the rank filter also runs ahead of the exchange, so a run sends `tail` rows per task
    late = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("line_no")))
    errors = first.withColumn("_r", late).filter(F.col("_r") <= tail).withColumn("flagged", F.lit(True))
    quiet = (lines.select(*keys, "line", "line_no").withColumn("_r", late).filter(F.col("_r") <= tail)
             .join(errors.select(*keys).distinct(), keys, "left_anti").withColumn("flagged", F.lit(False)))
    return errors.unionByName(quiet).select(*keys, "line_no", "line", "flagged")

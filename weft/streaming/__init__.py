"""Alignments that arrive as files: the row-wise steps over a stream.

Parsing and features look at one line at a time, so they run on a stream of PAF files as they are. What
needs whole sets (representatives, comparisons) runs on the tables that such a stream has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.features import alninfo
from weft.sources import paf


def stream_alninfo(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    """The 36-column table of each PAF file that appears in ``folder``."""
    lines = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_a_trigger).text(folder)
    good, _ = paf.parse(lines.select(F.regexp_replace("value", "\\r+$", "").alias("value")))
    return alninfo(good)

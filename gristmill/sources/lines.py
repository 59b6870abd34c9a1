"""Lines of text files with their places: the file, and the byte at which a line begins.

Files are read in byte ranges by Spark's own reader. A line's place follows from the lengths of the lines before it in its
range, and of the ranges before that in its file; only the ranges' totals meet, never a file's lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import settled


def read_placed(spark: SparkSession, path: str) -> DataFrame:
    """value, file, place of each line, and last: whether it is the last of its file. Lines end with a line feed."""
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select("value", meta.file_path.alias("file"), meta.file_block_start.alias("range"), F.monotonically_increasing_id().alias("n"))
    lines = settled(lines)  # the numbers only order lines within a range, so they are made once
    size = F.octet_length("value").cast("long") + 1
    totals = lines.groupBy("file", "range").agg(F.sum(size).alias("bytes"), F.max("n").alias("end"))
    before = Window.partitionBy("file").orderBy("range")  # ranges of one file
    totals = totals.select("file", "range", "end", (F.sum("bytes").over(before) - F.col("bytes")).alias("begin"), F.lead("range").over(before).isNull().alias("tail"))
    own = lines.withColumn("ahead", F.sum(size).over(Window.partitionBy("file", "range").orderBy("n")) - size)  # lines of one range
    both = own.join(totals, ["file", "range"])
    return both.select("value", "file", (F.col("begin") + F.col("ahead")).alias("place"), (F.col("tail") & (F.col("n") == F.col("end"))).alias("last"))

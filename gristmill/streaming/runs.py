"""Workflows over streams of envelopes: the same program as over a table, since it keeps no state between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.workflow import Workflow
from ..sources.envelopes import decode


def stream_envelopes(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return decode(lines.withColumn("run_id", F.sha2("value", 256)))


def run_stream(workflow: Workflow, envelopes: DataFrame, folder: str) -> StreamingQuery:
    """Runs what has arrived and ends; called again, it goes on where it ended. Results: parquet files in folder/runs."""

    def put(batch: DataFrame, number: int) -> None:
        runs = workflow.run(batch.where("error IS NULL"))
        bad = batch.where("error IS NOT NULL").select("run_id", F.lit("failed").alias("status"), "error", F.lit(None).cast("string").alias("payload"))
        flat = runs.select("run_id", "status", "error", F.to_json("payload").alias("payload"))
        flat.unionByName(bad).write.mode("overwrite").parquet(f"{folder}/runs/batch={number}")

    return envelopes.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()

"""Operator 9: exact deduplication as a stateful stream.

Arrivals (digest, doc_id, locator of the content) stream through keyed state without expiry, which Spark keeps on disk
(RocksDB): for each digest the stable identifier of the row that stays, its locator, and the number of equal rows. The
same state serves later arrivals, when the caller keeps its folder. Digests that were hit are then checked on the full
bytes of the two rows; rows whose bytes differ (a collision) are grouped by their bytes instead.

Texts are equal when identical; null counts as empty. Of equal texts the row with the largest doc_id stays (null is
below all others). Repeated rows, the same doc_id and text, are copies like others; each has its row in the result, and
all of those that carry the largest doc_id count as kept (``exact_dedup_rows`` lets one of them stay). Very long texts are
hashed and compared whole. Columns other than doc_id and text may have any names. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, fresh, one_of_each, shared_path, table

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: doc_id that stands for null within the operator.
_NULL_ID = -(1 << 63)


def stream_state(arrivals: DataFrame, folder: str, files_per_batch: int = 10_000) -> DataFrame:
    """Streams the arrivals (digest, id, locator) into keyed state under folder; returns the state they touched.

    Calls with the same folder continue the same state: only new files of arrivals are read.
    """
    spark = arrivals.sparkSession
    arrivals.write.mode("append").parquet(f"{folder}/arrivals")
    stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/arrivals")
    # a binary digest is the key; the largest struct is the row that stays
    state = stream.groupBy("digest").agg(F.max(F.struct("id", "locator")).alias("stays"), F.count(F.lit(1)).alias("group_size"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")  # a repeated batch replaces its own

    keys = {"spark.sql.streaming.stateStore.providerClass": _PROVIDER, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.stateStore.unloadOnCommit": "true"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    schema = f"digest binary, stays struct<id: bigint, locator: {arrivals.schema['locator'].dataType.simpleString()}>, group_size bigint, batch int"
    changes = spark.read.schema(schema).option("basePath", f"{folder}/changes").parquet(f"{folder}/changes/*")
    last = changes.groupBy("digest").agg(F.max_by(F.struct("stays", "group_size"), "batch").alias("s"))
    return last.select("digest", F.col("s.stays.id").alias("stay_id"), F.col("s.stays.locator").alias("locator"), F.col("s.group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (hex) of every row."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "dedup")
    d = documents(docs).withColumn("id", F.coalesce("doc_id", F.lit(_NULL_ID)))
    rows = d.select("id", F.unhex(F.sha2("text", 256)).alias("digest"), F.input_file_name().alias("locator"))
    arrivals = cut(rows)
    if arrivals.isEmpty():
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")
    state = cut(stream_state(arrivals, folder))
    hits = state.where("group_size > 1").select("digest", "stay_id")
    # full bytes of the rows of each group that was hit, beside those of the row that stays; rows are found by id and digest,
    # so that rows that only share an id (or have none) do not meet, and a large group is dealt evenly
    own = d.select("id", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    others = arrivals.select("id", "digest").join(hits, "digest").where("id <> stay_id").select("id", "digest").distinct()
    stays = hits.withColumnRenamed("stay_id", "id").join(own, ["id", "digest"]).select("digest", F.col("text").alias("stay_text"))
    stays = one_of_each(stays, ["digest"])
    differ = cut(others.join(own, ["id", "digest"]).join(stays, "digest").where("text <> stay_text").select("digest"))
    group = arrivals.join(state, "digest").select("id", "digest", F.col("stay_id").alias("keep"), "group_size")
    if not differ.isEmpty():
        bad = differ.distinct()
        split = own.join(bad, "digest", "left_semi")
        kept = split.groupBy("digest", "text").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("group_size"))
        group = group.join(bad, "digest", "left_anti").unionByName(split.join(kept, ["digest", "text"]).select("id", "digest", "keep", "group_size"))
    plain = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    return group.select(
        plain("id").alias("doc_id"), plain("keep").alias("keep_id"), "group_size", (F.col("id") == F.col("keep")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def exact_dedup_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: one for each text; of repeated rows, any one."""
    id_, digest = fresh(docs, "id", "digest")
    kept = exact_dedup(docs).where("kept").select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias(id_), F.unhex("text_sha256").alias(digest)).distinct()
    keyed = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)), digest: F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))})
    return one_of_each(keyed.join(kept, [id_, digest], "left_semi"), [id_, digest]).select(*docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       coalesce(doc_id = max(doc_id) OVER w, true) AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

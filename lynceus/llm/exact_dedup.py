"""Exact deduplication over a stream of documents.

The stream keeps one state row per content digest in a disk-backed store, without expiry: the stable identifier that
stays (the largest id), its content locator (id and file) and the number of rows seen. A digest hit is only a
suggestion; the bytes of every hit are compared with the bytes the locator names before a row is given up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lynceus.llm.base import stored
from lynceus.session import new_table_path

#: Keyed state lives in RocksDB: its size is bounded by disk, not by executor memory.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # an open store holds some MB of local disk
}


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digest_state(stream: DataFrame, id_col: str, text_col: str, digest=sha256_hex) -> DataFrame:
    """Streaming aggregation: one state row per digest. Rows of one digest are combined before they are shuffled."""
    rows = stream.select(
        digest(F.coalesce(text_col, F.lit(""))).alias("digest"), F.col(id_col).alias("id"),
        F.col("_metadata.file_path").alias("file"))
    return rows.groupBy("digest").agg(
        F.max(F.struct("id", "file")).alias("locator"), F.count(F.lit(1)).alias("seen"))


def drain(spark: SparkSession, path: str, state_dir: str, id_col: str = "doc_id", text_col: str = "text",
          digest=sha256_hex, files_per_batch: int | None = None) -> DataFrame:
    """Reads what is new under ``path`` (Parquet) into the state kept in ``state_dir``; returns the whole state.

    Calling it again with the same ``state_dir`` continues where the last call stopped: (digest, keep_id, file, seen).
    """
    now = spark.read.parquet(path)
    reader, path = spark.readStream.schema(now.schema), path.rstrip("/")
    if [f.rsplit("/", 1)[-1] for f in now.inputFiles()] == [path.rsplit("/", 1)[-1]]:  # a stream watches folders: one file is its folder's
        path, name = path.rsplit("/", 1)
        reader = reader.option("pathGlobFilter", name)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    try:
        for k, v in STATE_STORE.items():
            spark.conf.set(k, v)
        query = (
            digest_state(reader.parquet(path), id_col, text_col, digest).writeStream.outputMode("update")
            .format("noop").option("checkpointLocation", state_dir).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    state = spark.read.format("statestore").load(state_dir)
    locator = state.schema["value"].dataType.names[0]
    seen = state.schema["value"].dataType.names[1]
    return state.select(
        F.col("key.digest").alias("digest"), F.col(f"value.{locator}.id").alias("keep_id"),
        F.col(f"value.{locator}.file").alias("file"), F.col(f"value.{seen}").alias("seen"))


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
                state_dir: str | None = None, digest=sha256_hex, files_per_batch: int | None = None) -> DataFrame:
    """One row per row under ``path``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as the empty text. Of equal texts the largest id stays (a null id
    stays only when all are null); rows that repeat an id are all returned and all counted, and the rows that carry the
    staying id are kept. Other columns are not read. An empty table gives an empty result.

    Groups of one need nothing more. In larger groups every row's bytes are compared with those of the row the state
    points to; where a digest stands for several texts, its rows are grouped again by their bytes.
    """
    state = stored(drain(spark, path, state_dir or new_table_path(spark, "digests"), id_col, text_col, digest, files_per_batch), "state")
    docs = spark.read.parquet(path).select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    keyed = docs.select("id", digest(F.col("text")).alias("digest"), sha256_hex(F.col("text")).alias("text_sha256"), "text")
    shared = state.where("seen > 1")
    light = keyed.select("id", "digest", "text_sha256")
    single = light.join(state.where("seen = 1").select("digest"), "digest").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    hits = stored(keyed.join(shared.select("digest", "keep_id", "seen"), "digest"), "hits")
    held = stored(
        hits.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("text").alias("held_text")), "held")
    checked = stored(hits.join(held, "digest").select(
        "id", "digest", "text_sha256", "keep_id", "seen", (F.col("text") == F.col("held_text")).alias("same")), "compared")
    torn = checked.where("not same").select("digest").distinct()
    grouped = checked.select("id", "keep_id", F.col("seen").alias("group_size"), "text_sha256", "digest")
    if not torn.isEmpty():
        grouped = grouped.join(torn, "digest", "left_anti")
        rows = keyed.join(torn, "digest", "left_semi")
        sizes = rows.groupBy("digest", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        grouped = grouped.unionByName(
            rows.join(sizes, ["digest", "text"]).select("id", "keep_id", "group_size", "text_sha256", "digest"))
    out = single.unionByName(grouped.drop("digest"))
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")

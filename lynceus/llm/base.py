"""Helpers the corpus operators share: stored tables, bounded text slices, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lynceus.session import new_table_path, ship_package

#: Bytes of text handled at once inside a task.
SLICE_BYTES = 4 << 20
#: Bytes of rows sent to a Python worker at once (or one longer row).
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder as Parquet and read back: lineage ends here, and a lost executor loses nothing."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_slices(batches: Iterable, limit: int = SLICE_BYTES) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of Arrow batches whose first two columns are an id and a text; null texts become empty.

    A slice holds ``limit`` bytes of text or one longer text, so memory follows the longest text, not the batch.
    """
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = t.as_py() or ""
            if texts and size + len(t) > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
        if texts:
            yield ids, texts
    # a worker outlives its task: what the pools hold would be missing in the stages after it
    pa.default_memory_pool().release_unused()


def without(docs: DataFrame, ids: DataFrame, id_col: str, broadcast_rows: int = 2_000_000) -> DataFrame:
    """Rows of ``docs`` whose id is not in ``ids`` (one column); ids are broadcast up to a counted size (8 bytes each), beyond it the join shuffles."""
    gone = stored(ids.toDF("__gone").where("__gone is not null").distinct(), "gone")
    side = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    return docs.join(side, F.col(id_col) == F.col("__gone"), "left_anti")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def ready(spark: SparkSession) -> SparkSession:
    """Ships the package and bounds Arrow batches by bytes: whole texts differ in length by orders of magnitude."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of undirected ``edges`` (a, b), component = smallest reachable node.

    Alternating large-star and small-star steps; each round is one grouped aggregation and one join over the edges,
    written to the shared folder. The number of rounds is logarithmic in practice; a star of any width is aggregated
    map-side first and its join can be split, so one hot node is no obstacle. Self loops are allowed, null ends drop.
    """
    spark = edges.sparkSession
    cur = stored(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    nodes = cur.select(F.col("u").alias("node")).union(cur.select("v")).distinct()
    before = None
    for _ in range(max_rounds):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", "m"))
        nxt = stored(small.where("u <> v").distinct(), "edges")
        state = tuple(nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        cur = nxt
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    label = cur.groupBy("u").agg(F.min("v").alias("m"))
    return nodes.join(label, nodes.node == label.u, "left").select("node", F.coalesce("m", "node").alias("component"))

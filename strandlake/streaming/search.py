"""Queries that arrive as files are searched against a fixed target store, micro-batch by micro-batch.

The screening quantile is per query over the whole store, so batches don't depend on one another and no state or
watermark is needed; the checkpoint makes each query file count once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlake.operators.embed import HashEmbedder, embed
from strandlake.params import AlignParams, ScreenParams
from strandlake.plans.search import search
from strandlake.schema import INDEX


def stream_search(
    spark: SparkSession,
    query_folder: str,
    targets: DataFrame,
    target_residues: DataFrame,
    output: str,
    checkpoint: str,
    align: AlignParams = AlignParams(),
    screening: ScreenParams = ScreenParams(),
    cutoff: float = 0.3,
    make_embedder: Callable = HashEmbedder,
    once: bool = True,
    vectors: DataFrame | None = None,
) -> StreamingQuery:
    """Start a stream over Parquet query indexes in ``query_folder``; each batch's hits are written below ``output`` by batch number, so a repeated batch replaces itself.

    The queries' residue vectors are looked up in ``vectors`` if that is given, else made by the embedder.
    """

    def run(batch: DataFrame, number: int) -> None:
        residues = embed(batch, make_embedder) if vectors is None else vectors.join(batch.select("run_index").distinct(), "run_index", "left_semi")
        hits = search(batch, residues, targets, target_residues, align, screening, cutoff)
        hits.write.mode("overwrite").parquet(f"{output}/batch={number}")

    queries = spark.readStream.schema(INDEX).parquet(query_folder)
    writer = queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_window_counts(rows: DataFrame, time: str = "ts", size: str = "1 hour", late: str = "1 hour", key: str = "event_type") -> DataFrame:
    """Counts per time window and key of a stream, with late rows up to ``late``."""
    timed = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, size), key).agg(F.count("*").alias("n"))

"""Sequences with vectors, derived by Spark from the ``embeddings`` table.

Sequence ``s`` holds the vectors ``25 s .. 25 s + 49``, so neighbours share half of their residues. Targets are noisy: each
vector is mixed with another one. A residue's letter comes from its label. Queries are the sequences whose number is
divisible by 20, against all targets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.session import broadcast_if_small, table

STEP, LENGTH, EVERY = 25, 50, 20
OWN, OTHER, JUMP = 0.8, 0.6, 37
LETTERS = "ACDEFGHIKL"


@dataclass(frozen=True)
class Fixture:
    queries: DataFrame
    targets: DataFrame
    query_index: DataFrame
    target_index: DataFrame
    pairs: DataFrame


def fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    n = vectors.count()
    block = F.floor(F.col("vec_id") / STEP)
    placed = vectors.withColumn("run_index", F.explode(F.array(block - 1, block))).where((F.col("run_index") >= 0) & (F.col("run_index") <= n // STEP - 2))
    placed = placed.withColumn("pos", (F.col("vec_id") - STEP * F.col("run_index")).cast("int"))
    other = vectors.select(F.col("vec_id").alias("_j"), F.col("e").alias("_e"))
    mixed = placed.join(other, (F.col("vec_id") * JUMP) % n == F.col("_j"))
    mixed = mixed.select("run_index", "pos", F.zip_with("e", "_e", lambda a, b: F.lit(OWN) * a + F.lit(OTHER) * b).alias("vec"))
    letter = F.substring(F.lit(LETTERS), F.col("label") + 1, F.lit(1))
    texts = placed.groupBy("run_index").agg(F.array_sort(F.collect_list(F.struct("pos", letter.alias("l")))).alias("_l"))
    index = texts.select("run_index", F.concat(F.lit("S"), F.lpad(F.col("run_index").cast("string"), 6, "0")).alias("id"), F.array_join(F.transform("_l", lambda r: r["l"]), "").alias("sequence"))
    index = index.withColumn("description", F.concat(F.lit("from vector "), (F.col("run_index") * STEP).cast("string")))
    asked = F.col("run_index") % EVERY == 0
    queries = placed.where(asked).select("run_index", "pos", F.col("e").alias("vec"))
    q = queries.select(F.col("run_index").alias("queryid")).distinct()
    t = placed.select(F.col("run_index").alias("dbid")).distinct()
    return Fixture(queries, mixed, index.where(asked), index, t.join(broadcast_if_small(q, 100_000), F.lit(True)).select("queryid", "dbid"))

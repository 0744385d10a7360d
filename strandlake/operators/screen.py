"""Screening: which targets are worth an alignment with which query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.vectors import norm, pool
from strandlake.operators.matrices import matrix, to_matrices, unit_rows
from strandlake.operators.ranking import spread
from strandlake.params import POOL_WIDTH, ScreenParams
from strandlake.session import broadcast_if_small, cut, cut_counted, small_enough


#: Residues of queries that are held by every task at once.
HELD_RESIDUES = 200_000


def pooled(residues: DataFrame, width: int = POOL_WIDTH) -> DataFrame:
    """``(run_index, pos, vec)`` with each ``width`` dimensions averaged."""
    return residues.select("run_index", "pos", pool(F.col("vec"), width).alias("vec"))


def folds(residues: DataFrame, kernel: int, stride: int) -> DataFrame:
    """``(run_index, fold, start, fvec, fnorm)``: windows of ``kernel`` residues every ``stride``, flattened, and their length."""
    whole = to_matrices(residues).where(F.col("n") >= kernel).withColumn("dim", (F.size("emb") / F.col("n")).cast("int"))
    at = whole.select("run_index", "dim", "emb", F.posexplode(F.sequence(F.lit(0), F.col("n") - kernel, F.lit(stride))).alias("fold", "start"))
    cut = at.select("run_index", "fold", "start", F.slice("emb", F.col("start") * F.col("dim") + 1, F.col("dim") * kernel).alias("fvec"))
    return cut.withColumn("fnorm", norm(F.col("fvec")))


def kernel_size(queries: DataFrame, targets: DataFrame, params: ScreenParams) -> int:
    """The fold length: one short sequence shortens it for all."""
    lengths = queries.groupBy("run_index").count().unionByName(targets.groupBy("run_index").count())
    shortest = lengths.agg(F.min("count")).first()[0]
    return min(params.kernel, shortest) if shortest else params.kernel


def _fold_matrix(m: np.ndarray, kernel: int, stride: int) -> np.ndarray:
    at = np.arange(0, len(m) - kernel + 1, stride)
    return unit_rows(np.lib.stride_tricks.sliding_window_view(m, (kernel, m.shape[1]))[at, 0].reshape(len(at), -1))


def _scores_in_blocks(queries: DataFrame, targets: DataFrame, rows_of: Callable[[np.ndarray], np.ndarray], query_block: int) -> DataFrame:
    """``(queryid, dbid, score)``: the greatest product of any row that ``rows_of`` makes of the query's matrix with any of the target's.

    The queries are held in blocks of at most about ``query_block`` sequences and ``HELD_RESIDUES`` residues (counted); the targets are scanned once per
    block and multiplied in Arrow batches, so nothing but the scores is shuffled.
    """
    q, t = to_matrices(queries), spread(to_matrices(targets), "run_index")
    n, residues = q.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = 1 if n <= query_block and residues <= HELD_RESIDUES else max(n // query_block, residues // HELD_RESIDUES) + 1
    out = None
    for k in range(blocks):
        own = q if blocks == 1 else q.where(F.pmod(F.xxhash64("run_index"), F.lit(blocks)) == k)
        rows = [(r.run_index, rows_of(matrix(r.emb, r.n))) for r in own.collect()]  # bounded by query_block
        held = queries.sparkSession.sparkContext.broadcast(rows)

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            keys = np.array([key for key, _ in held.value], np.int64)
            if not len(keys):
                return
            side = np.concatenate([m for _, m in held.value])
            begin = np.cumsum([0, *(len(m) for _, m in held.value)])[:-1]
            for batch in batches:
                for key, n, emb in batch.itertuples(index=False):
                    best = (side @ rows_of(matrix(emb, n)).T).max(axis=1)
                    if np.isnan(best).any():
                        raise ValueError(f"target {key} or a query has a vector of length 0")
                    yield pd.DataFrame({"queryid": keys, "dbid": key, "score": np.maximum.reduceat(best, begin)})

        part = t.mapInPandas(scan, "queryid long, dbid long, score double")
        out = part if out is None else out.unionByName(part)
    return out


def chunk_scores(queries: DataFrame, targets: DataFrame, kernel: int, stride: int, query_block: int = 2_000) -> DataFrame:
    """``(queryid, dbid, score)``: the greatest cosine of any fold of the query with any fold of the target. A fold of length 0 is an error."""
    return _scores_in_blocks(queries, targets, lambda m: _fold_matrix(m, kernel, stride), query_block)


def quantile_by_query(scores: DataFrame, quantile: float, bins: int = 4096) -> DataFrame:
    """``(queryid, threshold)``: the exact quantile (linear interpolation) of each query's scores; null and NaN don't count.

    Scores are never sorted. The two ranks that the quantile lies between are looked for in ``bins`` equal bins between the least
    and the greatest score, then in the bin that holds them, and so on, until a bin holds one value only. Each round
    counts by bin before anything is shuffled, so a query may have any number of targets, ties and outliers.
    """
    known = scores.where("score is not null and not isnan(score)").select("queryid", "score")
    span = known.groupBy("queryid").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("*").alias("n"))
    at = (F.col("n") - 1) * F.lit(quantile)
    rank = F.explode(F.array(F.floor(at), F.least(F.floor(at) + 1, F.col("n") - 1)))
    open_rows = F.count_if(F.col("lo") < F.col("hi"))
    span, now = cut_counted(span.select("queryid", "lo", "hi", F.lit(0).cast("long").alias("below"), (at - F.floor(at)).alias("share"), rank.alias("rank")).distinct(), "ranks", open=open_rows)
    done = span.where("lo >= hi or lo is null")
    while now["open"]:
        asked = span.where("lo < hi")
        held = known.join(broadcast_if_small(asked), "queryid").where("score between lo and hi")
        bin_ = F.least(F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        counted = held.withColumn("_bin", bin_).groupBy("queryid", "rank", "share", "below", "_bin").agg(F.count("*").alias("_c"), F.min("score").alias("lo"), F.max("score").alias("hi"))
        before = F.col("below") + F.sum("_c").over(Window.partitionBy("queryid", "rank").orderBy("_bin")) - F.col("_c")
        found = counted.withColumn("below", before).where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("_c")))
        span, now = cut_counted(found.select("queryid", "lo", "hi", "below", "share", "rank"), "ranks", open=open_rows)
        done = done.unionByName(span.where("lo >= hi"))
    ends = done.groupBy("queryid").agg(F.min_by("lo", "rank").alias("_a"), F.max_by("lo", "rank").alias("_b"), F.first("share").alias("_f"))
    return ends.select("queryid", (F.col("_a") + F.col("_f") * (F.col("_b") - F.col("_a"))).alias("threshold"))


def keep_quantile(scores: DataFrame, quantile: float) -> DataFrame:
    """The targets of each query at or above the exact quantile of its scores; ties at it stay. The scores are computed once and written."""
    scores = cut(scores, "scores")
    return scores.join(broadcast_if_small(quantile_by_query(scores, quantile)), "queryid").where("score >= threshold").drop("threshold")


def whole_sequence_screen(queries: DataFrame, targets: DataFrame, quantile: float = 0.9, query_block: int = 20_000) -> DataFrame:
    """``(queryid, dbid, score)``: cosine of residue sums, at or above one quantile over each query's targets. A sum of length 0 is an error."""
    if not 0 < quantile < 1:
        raise ValueError("quantile must be between 0 and 1")
    return keep_quantile(_scores_in_blocks(queries, targets, lambda m: unit_rows(m.sum(axis=0, keepdims=True)), query_block), quantile)


def symmetric_pairs(pairs: DataFrame, value: str = "score") -> DataFrame:
    """One direction of each pair, self pairs included; pairs without a value go."""
    return pairs.where((F.col("dbid") >= F.col("queryid")) & F.col(value).isNotNull())


def screen(queries: DataFrame, targets: DataFrame, params: ScreenParams, width: int = POOL_WIDTH, symmetric: bool = False) -> DataFrame:
    """``(queryid, dbid, score)`` of the pairs to align. If screening is off, or there are too few targets, every pair passes with score 1."""
    few = small_enough(targets.select("run_index").distinct(), params.least_targets)
    if params.only_scan or (0 < params.percentile and not few):
        q, t = pooled(queries, width), pooled(targets, width)
        scores = chunk_scores(q, t, kernel_size(queries, targets, params), params.stride)
        kept = keep_quantile(scores, params.percentile / 100)
    else:
        q, t = queries.select(F.col("run_index").alias("queryid")).distinct(), targets.select(F.col("run_index").alias("dbid")).distinct()
        q = F.broadcast(q) if small_enough(q, 100_000) else q
        kept = t.join(q, F.lit(True)).select("queryid", "dbid", F.lit(1.0).alias("score"))
    return symmetric_pairs(kept) if symmetric else kept


def screen_json(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """``(queryid, result)``: per query a JSON object ``{target: {file, score}}``, targets in order, scores to 3 decimals."""
    named = pairs.join(files.select(F.col("run_index").alias("dbid"), "file"), "dbid")
    entry = F.struct(F.col("dbid"), F.struct("file", F.round("score", 3).alias("score")).alias("v"))
    sorted_ = F.array_sort(F.collect_list(entry))
    return named.groupBy("queryid").agg(F.to_json(F.map_from_entries(F.transform(sorted_, lambda e: F.struct(e["dbid"].cast("string"), e["v"])))).alias("result"))



"""Hits: redundancy, overlap, and truth comparison."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["queryid", "dbid"]


def filter_hits(hits: DataFrame) -> DataFrame:
    """Per pair and start cell the hit with the best score, of ties the longest, then the first path; then one per ``(pathid, dbid, len, score)``. Scores that agree to 9 decimals tie."""
    w = Window.partitionBy(*PAIR, "y1", "x1").orderBy(F.round("score", 9).desc(), F.col("len").desc(), "pathid", "spanid")
    first = hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    again = Window.partitionBy(*PAIR, "pathid", "len", F.round("score", 9)).orderBy("y1", "x1")
    return first.withColumn("_n", F.row_number().over(again)).where("_n = 1").drop("_n")


def overlap(hits: DataFrame) -> DataFrame:
    """``(queryid, dbid, i, j, share)``: share of hit ``j``'s points that hit ``i`` of the same pair also has, for ``i`` after ``j`` (by path, then span); only where they share a point.

    The points are joined by cell, so only hits that meet are compared.
    """
    rank = F.row_number().over(Window.partitionBy(*PAIR).orderBy("pathid", "spanid")) - 1
    points = hits.withColumn("_r", rank).select(*PAIR, "_r", F.explode(F.array_distinct("indices")).alias("_p"), F.size("indices").alias("_n"))
    a, b = points.withColumnsRenamed({"_r": "i"}).drop("_n"), points.withColumnsRenamed({"_r": "j"})
    both = a.join(b, [*PAIR, "_p"]).where("i > j")
    return both.groupBy(*PAIR, "i", "j").agg((F.count("*") / F.first("_n")).alias("share"))


def unique_hits(hits: DataFrame, tolerance: float = 0.8) -> DataFrame:
    """Greedy by path and span: a hit stays unless more than ``tolerance`` of an earlier kept hit's points are among its own. A group is the hits of one pair."""
    columns = hits.columns

    def keep(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["pathid", "spanid"], ignore_index=True)
        kept: list[set] = []
        stay = np.zeros(len(part), bool)
        for k, cells in enumerate(part["indices"]):
            own = {(c["y"], c["x"]) for c in cells}
            if all(len(own & other) <= tolerance * len(other) for other in kept):
                kept.append(own)
                stay[k] = True
        return part.loc[stay, columns]

    return hits.groupBy(*PAIR).applyInPandas(keep, hits.schema)


def best_diagonal(cells: DataFrame, value: str = "c") -> DataFrame:
    """``(queryid, dbid, best)``: the greatest sum over a diagonal."""
    sums = cells.groupBy(*PAIR, (F.col("y") - F.col("x")).alias("_d")).agg(F.sum(value).alias("_s"))
    return sums.groupBy(*PAIR).agg(F.max("_s").alias("best"))


def truth_overlap(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Agreement of found alignments with true ones, per pair, on the query and on the target side.

    Both tables have ``(queryid, dbid, y, x)``, one row per aligned residue pair, in order ``k``. For each side the two lists of
    residues are laid against each other at every offset; the best offset's matches are divided by the size of the truth
    and of the alignment: ``q_truth, q_found, t_truth, t_found``. A pair without a common residue has zeros.
    """
    sizes = truth.groupBy(*PAIR).agg(F.count("*").alias("_nt")).join(found.groupBy(*PAIR).agg(F.count("*").alias("_nf")), PAIR)
    out = sizes
    for side, axis in (("q", "x"), ("t", "y")):
        a = found.select(*PAIR, F.col(axis).alias("_r"), F.col("k").alias("_kf"))
        b = truth.select(*PAIR, F.col(axis).alias("_r"), F.col("k").alias("_kt"))
        matches = a.join(b, [*PAIR, "_r"]).groupBy(*PAIR, (F.col("_kf") - F.col("_kt")).alias("_o")).agg(F.count("*").alias("_m"))
        out = out.join(matches.groupBy(*PAIR).agg(F.max("_m").alias(f"_{side}")), PAIR, "left")
    share = lambda m, n: F.coalesce(F.col(m), F.lit(0)) / F.col(n)
    return out.select(*PAIR, share("_q", "_nt").alias("q_truth"), share("_q", "_nf").alias("q_found"), share("_t", "_nt").alias("t_truth"), share("_t", "_nf").alias("t_found"))

"""Residue tables as matrices, one row per sequence."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_matrices(residues: DataFrame) -> DataFrame:
    """``(run_index, n, emb)``: the vectors of a sequence laid end to end by position. A row is as large as one sequence."""
    rows = residues.groupBy("run_index").agg(F.array_sort(F.collect_list(F.struct("pos", "vec"))).alias("_r"))
    return rows.select("run_index", F.size("_r").alias("n"), F.flatten(F.transform("_r", lambda r: r["vec"])).cast("array<double>").alias("emb"))


def matrix(emb, n: int) -> np.ndarray:
    return np.asarray(emb, np.float64).reshape(n, -1)


def unit_rows(m: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return m / np.sqrt((m * m).sum(axis=1, keepdims=True))

"""Residue-level scores as relational plans: one row per residue pair ``(queryid, dbid, y, x, c)``.

``y`` counts in the target, ``x`` in the query, both from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.vectors import dot, unit
from strandlake.operators.ranking import spread

PAIR = ["queryid", "dbid"]


def residue_pairs(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Cosine of all residues of each given pair. Vectors are brought to length 1 once, before they are joined by key.

    This plan stays in the JVM; :func:`strandlake.operators.align.similarity_cells` gives the same rows by matrix products and is
    several times faster where a pair's matrices fit a task.
    """
    q = queries.select(F.col("run_index").alias("queryid"), F.col("pos").alias("x"), unit(F.col("vec")).alias("a"))
    t = targets.select(F.col("run_index").alias("dbid"), F.col("pos").alias("y"), unit(F.col("vec")).alias("b"))
    return spread(pairs.select(*PAIR), *PAIR).join(t, "dbid").join(q, "queryid").select(*PAIR, "y", "x", dot(F.col("a"), F.col("b")).alias("c"))


def signal_enhancement(cells: DataFrame) -> DataFrame:
    """Mean of the cell's z-scores in its column and in its row (population deviation)."""
    col, row = Window.partitionBy(*PAIR, "x"), Window.partitionBy(*PAIR, "y")

    def z(w):
        return (F.col("c") - F.avg("c").over(w)) / F.stddev_pop("c").over(w)

    return cells.withColumn("c", (z(col) + z(row)) / 2)


def global_znorm(cells: DataFrame) -> DataFrame:
    """Z-score over the whole pair, with 1e-3 added to the deviation."""
    stats = cells.groupBy(*PAIR).agg(F.avg("c").alias("_m"), F.stddev_pop("c").alias("_s"))
    return cells.join(stats, PAIR).withColumn("c", (F.col("c") - F.col("_m")) / (F.col("_s") + 1e-3)).drop("_m", "_s")


def score_matrix(cells: DataFrame) -> DataFrame:
    """``h``: the best sum of a run along the diagonal that ends in the cell, at least 0 (gaps play no part here).

    With S the running sum along the diagonal, h = S - min(0, running minimum of S). Both windows share one shuffle on
    the named diagonal.
    """
    along = Window.partitionBy(*PAIR, "diag").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    summed = cells.withColumn("diag", F.col("y") - F.col("x")).withColumn("_s", F.sum("c").over(along))
    return summed.withColumn("h", F.col("_s") - F.least(F.lit(0.0), F.min("_s").over(along))).drop("_s", "diag")


def best_cell(scored: DataFrame) -> DataFrame:
    """``(queryid, dbid, max_h, y, x)``: the cell with the greatest score; of ties the first by ``y``, then ``x``. Pre-aggregated, so one row per pair and task is shuffled."""
    return scored.groupBy(*PAIR).agg(F.max(F.struct("h", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))).alias("_b")).select(
        *PAIR, F.col("_b.h").alias("max_h"), (-F.col("_b.ny")).alias("y"), (-F.col("_b.nx")).alias("x")
    )


def border_starts(scored: DataFrame, lengths: DataFrame, cutoff: int, factor: int) -> DataFrame:
    """``(queryid, dbid, pathid, my, mx, h)``: where tracebacks start, in matrix coordinates (from 1).

    The border runs down the last column and then back along the last row, leaving out its first ``cutoff`` cells on
    either side (or none if the side is shorter). Of each ``factor`` consecutive cells the first greatest is taken; an
    incomplete last group is dropped. ``lengths`` has ``(queryid, dbid, nt, nq)``. Border cells at matrix position 0
    have score 0.
    """
    sized = lengths.withColumns({
        "_ch": F.when(F.col("nt") < cutoff, 0).otherwise(F.lit(cutoff)),
        "_cw": F.when(F.col("nq") < cutoff, 0).otherwise(F.lit(cutoff)),
    })
    right = sized.select(*PAIR, "nt", "nq", "_ch", "_cw", F.explode(F.sequence("_ch", "nt")).alias("my")).withColumns({"mx": F.col("nq"), "b": F.col("my") - F.col("_ch")})
    bottom = sized.where("_cw < nq").select(*PAIR, "nt", "nq", "_ch", "_cw", F.explode(F.sequence("_cw", F.col("nq") - 1)).alias("mx"))
    bottom = bottom.withColumns({"my": F.col("nt"), "b": F.col("nt") - F.col("_ch") + F.col("nq") - F.col("mx")})
    border = right.select(*PAIR, "my", "mx", "b").unionByName(bottom.select(*PAIR, "my", "mx", "b"))
    cells = scored.select(*PAIR, (F.col("y") + 1).alias("my"), (F.col("x") + 1).alias("mx"), "h")
    valued = border.join(cells, [*PAIR, "my", "mx"], "left").withColumn("h", F.coalesce("h", F.lit(0.0)))
    grouped = valued.groupBy(*PAIR, F.floor(F.col("b") / factor).cast("int").alias("pathid")).agg(
        F.count("*").alias("_n"), F.max(F.struct("h", (-F.col("b")).alias("nb"), "my", "mx")).alias("_b")
    )
    return grouped.where(F.col("_n") == factor).select(*PAIR, "pathid", F.col("_b.my").alias("my"), F.col("_b.mx").alias("mx"), F.col("_b.h").alias("h"))


def moving_mean(values: DataFrame, window: int, keys: list[str], order: str, value: str = "v") -> DataFrame:
    """``m``: mean of the last ``window`` values; the first values share the first full mean, the last ``window`` the last one; 0 where the value isn't positive."""
    w = Window.partitionBy(*keys)
    run = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sized = values.withColumns({"_n": F.count("*").over(w), "_k": F.row_number().over(w.orderBy(order)) - 1, "_p": F.sum(value).over(run)})
    width = F.least(F.lit(window), F.col("_n"))
    end = F.greatest(width - 1, F.least(F.col("_k"), F.col("_n") - window - 1))
    sized = sized.withColumns({"_w": width, "_e": end})
    prefix = sized.select(*keys, F.col("_k").alias("_at"), F.col("_p").alias("_pv"))
    upper = prefix.withColumnsRenamed({"_at": "_e", "_pv": "_pe"})
    lower = prefix.select(*keys, (F.col("_at") + 1).alias("_b"), F.col("_pv").alias("_pb"))
    joined = sized.join(upper, [*keys, "_e"]).withColumn("_b", F.col("_e") + 1 - F.col("_w")).join(lower, [*keys, "_b"], "left")
    mean = (F.col("_pe") - F.coalesce("_pb", F.lit(0.0))) / F.col("_w")
    return joined.withColumn("m", F.when(F.col(value) > 0, mean).otherwise(0.0)).drop("_n", "_k", "_p", "_w", "_e", "_b", "_pe", "_pb")


def runs_above(values: DataFrame, threshold: float, keys: list[str], order: str, value: str = "m") -> DataFrame:
    """``(keys, first, last, size, final)`` of each run of consecutive values at or above ``threshold``; NaN never breaks a run."""
    w = Window.partitionBy(*keys).orderBy(order)
    below = (F.col(value) < threshold) & ~F.isnan(value)
    marked = values.withColumns({"_i": F.sum(below.cast("int")).over(w), "_k": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*keys))})
    runs = marked.where(~below).groupBy(*keys, "_i").agg(F.min("_k").alias("first"), F.max("_k").alias("last"), F.first("_n").alias("_n"))
    return runs.select(*keys, "first", "last", (F.col("last") - F.col("first") + 1).alias("size"), (F.col("last") == F.col("_n") - 1).alias("final"))

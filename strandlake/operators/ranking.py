"""Positions within groups of any size, and even work for tasks that compute more than they read."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.session import broadcast_if_small, cut, scratch_path

#: Rows of a range partition that is walked by one task (in few columns), and partitions at least; each more of one group costs a round.
WALK_ROWS, LEAST_WALKS = 2_000_000, 4
#: ``(columns of a stretch, state before it, whether its group ends with it) -> (output columns, state after it)``
Step = Callable[[dict[str, np.ndarray], bytes | None, bool], tuple[dict[str, np.ndarray], bytes]]


def all_cores(spark: SparkSession, rows: int = 0, rows_per_task: int = 1) -> int:
    """How many tasks keep all cores busy with rows that cost far more than their bytes: twice the cores, more if a task had more than ``rows_per_task``.

    A repartition with a number isn't merged for being small.
    """
    return max(2 * spark.sparkContext.defaultParallelism, rows // rows_per_task)


def spread(df: DataFrame, *by: str | Column) -> DataFrame:
    """Small inputs over all cores: a stage whose rows cost far more than their bytes mustn't run in one task."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *by)


def positions(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``name``: position from 0 of each row within its group, by ``order``.

    The rows are sorted over all partitions, so a group of any size is shared among tasks; a row's position is its offset
    in the partition plus the sizes of the group's parts before it. Rows that tie keep an arbitrary, fixed order.
    """
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_m", F.monotonically_increasing_id())
    placed = cut(placed, "positions").withColumn("_p", F.shiftright("_m", 33))
    parts = placed.groupBy(*keys, "_p").agg(F.min("_m").alias("_m0"), F.count("*").alias("_c"))
    base = parts.withColumn("_b", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_p")) - F.col("_c")).drop("_c")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, "_p")]
    joined = placed.alias("l").join(broadcast_if_small(base).alias("r"), same)
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("r._b") + F.col("l._m") - F.col("r._m0")).alias(name))


def totals_before(df: DataFrame, order: list[str], values: dict[str, Column]) -> DataFrame:
    """A column for each of ``values``: its sum over all rows before this one, by ``order``. Rows are sorted over range partitions, whose sums are laid end to end."""
    placed = df.withColumns(values).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    placed = cut(placed, "totals").withColumn("_p", F.shiftright("_m", 33))
    parts = placed.groupBy("_p").agg(*(F.sum(c).alias(c) for c in values))
    before = Window.orderBy("_p")  # one row per partition
    base = parts.select("_p", *((F.sum(c).over(before) - F.col(c)).alias(f"_0{c}") for c in values))
    within = Window.partitionBy("_p").orderBy("_m")
    sums = placed.withColumns({c: F.sum(c).over(within) - F.col(c) for c in values})
    return sums.join(F.broadcast(base), "_p").withColumns({c: F.col(c) + F.col(f"_0{c}") for c in values}).select(*df.columns, *values)


def walk(df: DataFrame, key: str, order: list[str | Column], columns: list[str], step: Step, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their place ``_m``, and what ``step`` gives (``schema``: whole numbers and strings) as it goes through each group in order.

    ``key`` is a string that is never null; ``step`` sees ``_m``, ``_k`` (the key) and ``columns``. The rows are sorted over
    range partitions of at most about ``WALK_ROWS`` rows, so a group of any size is shared among tasks. A group that goes on in the next partition hands its
    state over: first all stretches that begin a group are walked, then those that continue one, one partition further in each
    round. There are as many rounds as the largest group has partitions; a task holds one partition and one state.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "walk")
    placed = df.repartitionByRange(max(LEAST_WALKS, df.count() // WALK_ROWS), key, *order).sortWithinPartitions(key, *order).withColumn("_m", F.monotonically_increasing_id())
    placed.write.parquet(f"{path}/rows")

    def rows(names: list[str]) -> DataFrame:
        return spark.read.schema(placed.schema).parquet(*(f"{path}/rows/{n}" for n in names)).withColumn("_p", F.shiftright("_m", 33))

    # one row per partition
    file = F.element_at(F.split(F.input_file_name(), "/"), -1)
    edges = rows([""]).withColumn("_f", file).groupBy("_p").agg(F.min_by(key, "_m").alias("head"), F.max_by(key, "_m").alias("tail"), F.collect_set("_f").alias("files")).orderBy("_p").collect()
    depth, follows = {e["_p"]: 0 for e in edges}, {}
    for a, b in zip(edges, edges[1:]):
        if a["tail"] == b["head"]:
            follows[a["_p"]] = b["_p"]
            depth[b["_p"]] = 1 + (depth[a["_p"]] if a["head"] == a["tail"] else 0)

    fields = [f.split() for f in schema.split(", ")]

    def run(part: pd.DataFrame, state: bytes | None) -> pd.DataFrame:
        part, p = part.sort_values("_m"), int(part["_p"].iloc[0])
        values = {c: part[c].to_numpy() for c in ("_m", "_k", *columns)}
        k = values["_k"]
        bounds = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        spans = list(zip(bounds, bounds[1:]))
        spans = spans[:1] if state is not None else spans[depth[p] > 0 :]
        got, passed = [], []
        for a, b in spans:
            ends = b < len(k) or p not in follows
            out, after = step({c: v[a:b] for c, v in values.items()}, state, ends)
            got.append(out)
            passed = [] if ends else [(follows[p], after)]
        frame = {}
        for n, kind in fields:
            own = [*(g[n] for g in got), *(np.array(["" if kind == "string" else 0]) for _ in passed)]
            # strings stay objects: as Arrow chunks they can't be handed back
            frame[n] = pd.Series(np.concatenate(own) if own else [], dtype=object if kind == "string" else "int64")
        n = sum(len(g[fields[0][0]]) for g in got)
        frame["_to"] = pd.Series([-1] * n + [to for to, _ in passed], dtype="int64")
        frame["_state"] = pd.Series([b""] * n + [after for _, after in passed], dtype=object)
        return pd.DataFrame(frame)

    slim, full = ["_p", "_m", F.col(key).alias("_k"), *columns], f"{schema}, _to long, _state binary"
    rounds = max(depth.values(), default=0) + 1
    for r in range(rounds):
        if r == 0:
            done = rows([""]).select(*slim).groupBy("_p").applyInPandas(lambda part: run(part, None), full)
        else:
            here = rows([n for e in edges if depth[e["_p"]] == r for n in e["files"]]).select(*slim)
            state = spark.read.schema(full).parquet(f"{path}/round-{r - 1}").where("_to >= 0").select(F.col("_to").alias("_p"), "_state")
            done = here.groupBy("_p").cogroup(state.groupBy("_p")).applyInPandas(lambda part, before: run(part, before["_state"].iloc[0]) if len(part) else pd.DataFrame(), full)
        done.write.parquet(f"{path}/round-{r}")
    out = spark.read.schema(full).parquet(*(f"{path}/round-{r}" for r in range(rounds))).where("_to < 0").drop("_to", "_state")
    return rows([""]).drop("_p"), out

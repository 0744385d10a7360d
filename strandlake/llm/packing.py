"""Filling containers of fixed capacity with whole items of varying length.

Sum-of-squares packing: each item goes where the sum of the squared counts of open bins by residual gap becomes
smallest. A job is packed in blocks of bounded size, drawn at random, so each block has the job's mix of lengths; the
emptiest bins of all blocks are then opened again and packed together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.topn import latest_rows
from strandlake.operators.ranking import all_cores
from strandlake.session import broadcast_if_small, cut

BLOCK_ITEMS = 20_000
REOPENED = 32
#: Capacity up to which every gap has a place of its own in memory.
DENSE = 1 << 16
NEVER = np.iinfo(np.int64).max


class DenseGaps:
    """Counts of open bins by gap, one place for each gap below the capacity."""

    def __init__(self, capacity: int):
        self.count = np.zeros(capacity, np.int64)

    def change(self, s: int) -> tuple[int, int]:
        """The gap that holds an item of size ``s`` at the smallest change of the sum of squares (the smallest gap of several), and that change."""
        here = self.count[s:]
        if not len(here):
            return 0, NEVER
        change = np.where(here > 0, 2 * (self.count[: len(here)] - here + 1), NEVER)
        change[0] -= 1 if here[0] else 0  # that bin is full then and no longer counts
        k = int(change.argmin())
        return s + k, int(change[k])

    def at(self, gap: int) -> int:
        return int(self.count[gap])

    def add(self, gap: int, n: int) -> None:
        self.count[gap] += n


class SparseGaps(DenseGaps):
    """The same with a place for gaps that occur only: for capacities of any size."""

    def __init__(self, capacity: int):
        self.gap, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def change(self, s: int) -> tuple[int, int]:
        first = int(np.searchsorted(self.gap, s))
        gap, here = self.gap[first:], self.count[first:]
        if not len(gap):
            return 0, NEVER
        place = np.minimum(np.searchsorted(self.gap, gap - s), len(self.gap) - 1)
        left = np.where(self.gap[place] == gap - s, self.count[place], 0)
        change = np.where(here > 0, 2 * (left - here + 1) - (gap == s), NEVER)
        k = int(change.argmin())
        return int(gap[k]), int(change[k])

    def at(self, gap: int) -> int:
        k = int(np.searchsorted(self.gap, gap))
        return int(self.count[k]) if k < len(self.gap) and self.gap[k] == gap else 0

    def add(self, gap: int, n: int) -> None:
        k = int(np.searchsorted(self.gap, gap))
        if k == len(self.gap) or self.gap[k] != gap:
            self.gap, self.count = np.insert(self.gap, k, gap), np.insert(self.count, k, 0)
        self.count[k] += n
        if not self.count[k]:
            self.gap, self.count = np.delete(self.gap, k), np.delete(self.count, k)


def sum_of_squares(sizes: np.ndarray, capacity: int, dense: int = DENSE) -> np.ndarray:
    """Bin of each item, in the given order. Items of size 0 join the first bin; no item may exceed ``capacity``.

    Capacities up to ``dense`` have a place for each gap, greater ones only for the gaps that occur; the bins are the same.
    """
    bins = np.empty(len(sizes), np.int64)
    gaps = (DenseGaps if capacity <= dense else SparseGaps)(capacity)  # a full bin has gap 0 and isn't counted
    by_gap: dict[int, list[int]] = {}
    made = 0
    for i, s in enumerate(sizes.tolist()):
        if s == 0:
            made = max(made, 1)
            bins[i] = 0
            if made == 1 and i == 0 and capacity:
                by_gap.setdefault(capacity, []).append(0)
            continue
        gap, best = gaps.change(s)
        fresh = 2 * gaps.at(capacity - s) + 1 if s < capacity else 0
        if spare := by_gap.get(capacity):
            b, left = spare.pop(), capacity - s
            if not spare:
                del by_gap[capacity]
        elif best <= fresh:
            b, left = by_gap[gap].pop(), gap - s
            gaps.add(gap, -1)
        else:
            b, left = made, capacity - s
            made += 1
        bins[i] = b
        if left:
            gaps.add(left, 1)
            by_gap.setdefault(left, []).append(b)
    return bins


def pack_block(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Sum-of-squares packing in falling order of size, which leaves small items to fill what the large ones left."""
    falling = np.argsort(-sizes, kind="stable")
    bins = np.empty(len(sizes), np.int64)
    bins[falling] = sum_of_squares(sizes[falling], capacity)
    return bins


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["item", "part"], ignore_index=True)
    bins = pack_block(frame["size"].to_numpy(np.int64), int(frame["capacity"].iloc[0]))
    return frame.assign(bin=bins)


ITEMS = "grp long, item long, part int, first long, size long, capacity int, block long, blocks long, bin long"


def pack_items(items: DataFrame, block_items: int = BLOCK_ITEMS, reopened: int = REOPENED) -> DataFrame:
    """``(grp, batch_no, item, part, first, size, capacity)`` of ``items`` ``(grp, item, part, first, size, capacity)``; ``batch_no`` counts from 1 in each group.

    Blocks of about ``block_items`` are packed each in one task. Of each block of a group that has several, the
    ``reopened`` emptiest bins are packed again with those of the group's other blocks (again in blocks of that size).
    """
    spark, columns = items.sparkSession, ["grp", "item", "part", "first", "size", "capacity"]
    counts = cut(items.groupBy("grp").agg(F.count("*").alias("n"), F.ceil(F.count("*") / block_items).alias("blocks")), "blocks")
    # a block costs by its items, not by its bytes: numbered tasks, so that small blocks aren't merged into few of them
    tasks = all_cores(spark, counts.agg(F.sum("n")).first()[0] or 0, block_items)
    placed = items.join(broadcast_if_small(counts.drop("n")), "grp").withColumn("block", F.pmod(F.xxhash64("item", "part"), F.col("blocks")))
    first = cut(placed.select(*columns, "block", "blocks").repartition(tasks, "grp", "block").groupBy("grp", "block").applyInPandas(_pack, ITEMS), "packed")
    by_bin = Window.partitionBy("grp", "block").orderBy("fill", "bin")
    bins = first.where("blocks > 1").groupBy("grp", "block", "bin").agg(F.sum("size").alias("fill"), F.first("capacity").alias("cap"))
    emptiest = cut(bins.where("fill < cap").withColumn("_n", F.row_number().over(by_bin)).where(F.col("_n") <= reopened).select("grp", "block", "bin"), "reopened")
    again = first.join(broadcast_if_small(emptiest), ["grp", "block", "bin"], "left_semi").select(*columns)
    more = again.groupBy("grp").agg(F.ceil(F.count("*") / block_items).alias("blocks"))
    again = again.join(broadcast_if_small(more), "grp").withColumn("block", -1 - F.pmod(F.xxhash64("item", "part"), F.col("blocks")))
    second = again.select(*columns, "block", "blocks").groupBy("grp", "block").applyInPandas(_pack, ITEMS)
    kept = first.join(broadcast_if_small(emptiest), ["grp", "block", "bin"], "left_anti")
    full = cut(kept.unionByName(second), "bins")
    # dense numbers: bins are counted within their block, blocks are laid end to end
    used = full.select("grp", "block", "bin").distinct()
    numbered = used.withColumn("no", F.row_number().over(Window.partitionBy("grp", "block").orderBy("bin")))
    sizes = numbered.groupBy("grp", "block").agg(F.max("no").alias("n"))
    ends = sizes.withColumn("base", F.sum("n").over(Window.partitionBy("grp").orderBy("block")) - F.col("n")).drop("n")
    out = full.join(numbered, ["grp", "block", "bin"]).join(broadcast_if_small(ends), ["grp", "block"])
    return out.select("grp", (F.col("base") + F.col("no")).alias("batch_no"), "item", "part", "first", "size", "capacity")


def job_capacity(checkpoints: DataFrame) -> DataFrame:
    """``(job_id, capacity)`` from the jobs' ``start`` rows; if they don't agree, the greatest. Null or non-positive values say nothing."""
    start = checkpoints.where((F.col("stage") == "start") & (F.col("res_per_batch") > 0) & F.col("job_id").isNotNull())
    return start.groupBy("job_id").agg(F.max("res_per_batch").alias("capacity"))


def batch_totals(packed: DataFrame) -> DataFrame:
    """``(job_id, sequences, residues, overfull)`` of the batches of :func:`pack_sequences`: what must be the same however the items lie; ``overfull`` counts batches above their capacity."""
    fill = packed.groupBy("job_id", "batch_no").agg(F.sum("size").alias("fill"), F.max("capacity").alias("cap"))
    over = fill.groupBy("job_id").agg(F.count_if(F.col("fill") > F.col("cap")).alias("overfull"))
    own = packed.groupBy("job_id", "run_index").agg(F.count("*").alias("rows"), F.max("part").alias("parts"), F.sum("size").alias("size"))
    whole = own.groupBy("job_id").agg(F.count_if(F.col("rows") == F.col("parts")).alias("sequences"), F.sum("size").alias("residues"))
    return whole.join(over, "job_id")


def pack_sequences(sequences: DataFrame, checkpoints: DataFrame, default_capacity: int = 6000, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``(job_id, batch_no, run_index, part, first, size, capacity)``: the sequences of each job in batches of at most ``capacity`` residues.

    A sequence longer than the capacity comes out in parts ``1, 2, ...`` that begin at residue ``first`` (from 0), all of
    full size but the last; every other one is whole, with part 1.

    Defined results: each ``run_index`` counts once, with its row loaded last; the length is ``seqlens``, or that of
    ``seq`` where it is null, or 0 where both are; a length of 0 takes no room but has a place; rows with a null
    ``run_index`` or ``job_id`` are left out; a job without a usable start row has ``default_capacity``; empty tables give
    no row; other columns, of any name, are ignored.
    """
    length = F.coalesce(F.col("seqlens"), F.length("seq"), F.lit(0)).cast("long")
    rows = sequences.where("run_index is not null and job_id is not null").select("run_index", "loaded_at", "job_id", F.greatest(length, F.lit(0)).alias("len"))
    rows = latest_rows(rows, "run_index", "loaded_at", ["job_id", "len"])
    rows = rows.join(broadcast_if_small(job_capacity(checkpoints)), "job_id", "left").withColumn("capacity", F.coalesce("capacity", F.lit(default_capacity)).cast("int"))
    last = F.greatest(F.ceil(F.col("len") / F.col("capacity")), F.lit(1))
    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(1), last.cast("int"))))
    first = (F.col("part") - 1).cast("long") * F.col("capacity")
    items = parts.select(F.col("job_id").alias("grp"), F.col("run_index").alias("item"), "part", first.alias("first"), F.least(F.col("capacity"), F.col("len") - first).alias("size"), "capacity")
    packed = pack_items(cut(items, "items"), block_items)
    return packed.select(F.col("grp").alias("job_id"), "batch_no", F.col("item").alias("run_index"), "part", "first", "size", "capacity")

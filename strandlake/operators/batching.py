"""Preparing sequences for an embedding job: clean-up, batches, shares of ranks, resume, and FASTA chunks."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.residues import clean
from strandlake.operators.ranking import positions, walk
from strandlake.session import broadcast_if_small, cut

BLOCK = 50_000
RESIDUES_PER_BATCH = 6_000
SLICE_RESIDUES = 7_680
MULTIPLE_RESIDUES = 4_000


def prepare_sequences(index: DataFrame, truncate: int = 1000, sequence: str = "sequence") -> DataFrame:
    """Sequences in upper case and cut to ``truncate`` residues, with their length ``seqlen``; rows without a sequence are left out."""
    if truncate < 1:
        raise ValueError("truncate must be at least 1")
    done = index.where(F.col(sequence).isNotNull()).withColumn(sequence, clean(F.col(sequence), truncate))
    return done.withColumn("seqlen", F.length(sequence))


def prepare_jobs(index: DataFrame, checkpoints: DataFrame, sequence: str = "sequence") -> DataFrame:
    """As :func:`prepare_sequences`, cut to the ``truncate_len`` of the start rows of each sequence's job; whole if the job has none."""
    start = checkpoints.where("stage = 'start' and job_id is not null").groupBy("job_id").agg(F.max("truncate_len").alias("_cut"))
    rows = index.where(F.col(sequence).isNotNull()).join(broadcast_if_small(start), "job_id", "left")
    cut_ = F.substring(F.col(sequence), F.lit(1), F.coalesce("_cut", F.length(sequence)))
    return rows.withColumn(sequence, clean(cut_)).withColumn("seqlen", F.length(sequence)).drop("_cut")


def length_statistics(prepared: DataFrame) -> DataFrame:
    return prepared.agg(F.count("*").alias("sequences"), F.min("seqlen").alias("shortest"), F.avg("seqlen").alias("mean_length"), F.max("seqlen").alias("longest"))


def fixed_batches(df: DataFrame, batch_size: int, position: str = "run_index") -> DataFrame:
    """``batch_id`` by position: ``batch_size`` rows each, the last one short."""
    return df.withColumn("batch_id", F.floor(F.col(position) / batch_size))


def rank_share(batches: DataFrame, ranks: int, total_batches: int) -> DataFrame:
    """``rank`` of each batch: equal contiguous shares, the last rank takes the rest."""
    share = max(1, total_batches // ranks)
    return batches.withColumn("rank", F.least(F.floor(F.col("batch_id") / share), F.lit(ranks - 1)))


def resume_from(batches: DataFrame, last_batch: int) -> DataFrame:
    """The batches from ``last_batch`` on; that one is done again."""
    return batches.where(F.col("batch_id") >= last_batch)


def resume_share(shares: DataFrame, points: DataFrame) -> DataFrame:
    """The batches of :func:`rank_share` that each rank still has to do: from its recorded batch ``(rank, last_batch)`` on, which is done again; all of them if it has no record.

    A record before the first batch of its rank is an error, which is raised while the rows are computed. A record behind the
    last one leaves nothing.
    """
    first = shares.groupBy("rank").agg(F.min("batch_id").alias("_first"))
    own = first.join(points.groupBy("rank").agg(F.max("last_batch").alias("last_batch")), "rank", "left")
    known = F.coalesce("last_batch", F.col("_first"))
    wrong = F.raise_error(F.concat(F.lit("batch "), known.cast("string"), F.lit(" isn't one of rank "), F.col("rank").cast("string"))).cast("long")
    own = own.select("rank", F.when(known < F.col("_first"), wrong).otherwise(known).alias("_from"))
    return shares.join(broadcast_if_small(own), "rank").where(F.col("batch_id") >= F.col("_from")).select(*shares.columns)


def not_done(index: DataFrame, done: DataFrame, key: str = "run_index") -> DataFrame:
    """Rows whose key has no result yet: a resume that may be repeated at any time."""
    return index.join(done.select(key).distinct(), key, "left_anti")


def groups_of_four(lengths: np.ndarray, budget: int = RESIDUES_PER_BATCH, final: bool = True) -> list[tuple[int, int]]:
    """Contiguous batches of whole fours of sequences, as many as keep the budget, but for the last four.

    The four that breaks the budget, or the last one if all are kept, opens the next batch; if a batch has no other four, it takes two
    sequences of it, or one if two are too long. Sequences beyond the last whole four, if all fours are kept, are a batch
    of their own. If more sequences follow (not ``final``), only the batches that are settled are given.
    """
    n, begin, out = len(lengths), 0, []
    total = np.append(0, np.cumsum(lengths))
    while begin < n:
        fit = int(np.searchsorted(total, total[begin] + budget, side="right")) - 1
        kept, (whole, odd) = (fit - begin) // 4, divmod(n - begin, 4)
        if kept >= whole and not final:
            break
        if kept >= whole and odd:
            ends = sorted({begin, begin + 4 * whole, n})
            return out + list(zip(ends, ends[1:]))
        size = 4 * min(kept, whole - 1) or (2 if total[begin + 2] - total[begin] <= budget else 1)
        out.append((begin, begin + size))
        begin += size
    return out


def over_multiples(lengths: np.ndarray, budget: int = SLICE_RESIDUES) -> list[tuple[int, int]]:
    """Contiguous slices; one opens with each sequence whose running total passes the next multiple of the budget, one multiple per sequence. No empty slice."""
    return _runs(_opened(lengths, budget))


def before_multiples(lengths: np.ndarray, budget: int = MULTIPLE_RESIDUES) -> list[tuple[int, int]]:
    """As :func:`over_multiples`, but each batch opens one sequence earlier. No empty batch."""
    opened = _opened(lengths, budget)
    return _runs(np.append(opened[1:], opened[-1:]))


def _opened(lengths: np.ndarray, budget: int) -> np.ndarray:
    """How many multiples count as passed up to each sequence: those that its total has passed, but no more than one further than the sequence before it.

    That is the position plus the least of "passed minus position" so far, which needs no walk.
    """
    at = np.arange(len(lengths))
    passed = np.maximum(-(-np.cumsum(lengths) // budget) - 1, 0)
    return at + np.minimum(np.minimum.accumulate(passed - at), 1) if len(at) else at


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    edges = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def resume_points(checkpoints: DataFrame) -> DataFrame:
    """``(job_id, rank_id, last_batch)`` of each job's and rank's last saved checkpoint; that batch is done again. A null rank is a job in one process."""
    last = checkpoints.where("job_id is not null").groupBy("job_id", "rank_id").agg(F.max(F.struct("saved_at", "last_batch")).alias("_r"))
    return last.select("job_id", "rank_id", F.col("_r.last_batch").alias("last_batch"))


def plan_batches(df: DataFrame, planner: Callable[[np.ndarray], list[tuple[int, int]]], group: str = "job_id", order: str = "run_index", length: str = "seqlen", block: int = BLOCK) -> DataFrame:
    """``(group, block, batch_no, first, last, sequences, residues)``: the batches of one of this module's planners for each whole group in the order of ``order``.

    A group of any size is shared among tasks. Cuts at multiples follow from running totals and running minima over range
    partitions; :func:`groups_of_four`, which goes forward from batch to batch, hands its open batch from one range partition to the
    next (:func:`walk`). ``block`` only numbers the batches by the ``block`` positions in which they begin; the plan doesn't
    depend on it. A null length counts as 0; a null group is a group.
    """
    rows = df.select(F.col(group).cast("long").alias("g"), F.col(order).cast("long").alias("o"), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("n"))
    if planner is over_multiples:
        out = _at_multiples(rows, SLICE_RESIDUES, 0)
    elif planner is before_multiples:
        out = _at_multiples(rows, MULTIPLE_RESIDUES, 1)
    elif planner is groups_of_four:

        def step(part: dict[str, np.ndarray], state: bytes | None, ends: bool) -> tuple[dict[str, np.ndarray], bytes]:
            o, n = (part[c].astype(np.int64, casting="safe") for c in "on")
            at, no = 0, 0
            if state is not None:
                at, no, held_o, held_n = pickle.loads(state)
                o, n = np.append(held_o, o), np.append(held_n, n)
            spans = groups_of_four(n, final=ends)
            total = np.append(0, np.cumsum(n))
            a, b = np.array(spans, np.int64).reshape(-1, 2).T
            out = {"k": np.repeat(part["_k"][:1], len(a)), "at": at + a, "batch_no": no + np.arange(len(a)), "first": o[a], "last": o[b - 1], "sequences": b - a, "residues": total[b] - total[a]}
            done = int(b[-1]) if len(b) else 0
            return out, b"" if ends else pickle.dumps((at + done, no + len(a), o[done:], n[done:]))

        keyed = rows.withColumn("k", F.coalesce(F.col("g").cast("string"), F.lit("")))
        _, out = walk(keyed, "k", ["o"], ["o", "n"], step, "k string, at long, batch_no long, first long, last long, sequences long, residues long")
        out = out.withColumn("g", F.when(F.col("k") != "", F.col("k")).cast("long"))
    else:
        raise ValueError("the planner must be over_multiples, groups_of_four or before_multiples")
    numbers = [F.col("batch_no").cast("int").alias("batch_no"), "first", "last", F.col("sequences").cast("int").alias("sequences"), "residues"]
    return out.select(F.col("g").alias(group), F.floor(F.col("at") / block).alias("block"), *numbers)


def _at_multiples(rows: DataFrame, budget: int, earlier: int) -> DataFrame:
    """Batches that open with each sequence (``earlier``: so many before it) at which :func:`_opened` rises, for each whole group ``g``."""
    placed = rows.repartitionByRange("g", "o").sortWithinPartitions("g", "o").withColumn("_m", F.monotonically_increasing_id())
    placed = cut(placed, "multiples").withColumn("_p", F.shiftright("_m", 33))
    before = Window.partitionBy("g").orderBy("_p")  # one row per group and partition

    def laid(df: DataFrame, base: DataFrame) -> DataFrame:
        """Each row with what stands before its partition."""
        joined = df.alias("l").join(broadcast_if_small(base).alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("g", "_p")])
        return joined.select("l.*", *[F.col(f"r.{c}") for c in base.columns if c not in ("g", "_p")])

    parts = placed.groupBy("g", "_p").agg(F.sum("n").alias("_n"), F.count("*").alias("_c"))
    base = parts.select("g", "_p", (F.sum("_n").over(before) - F.col("_n")).alias("_n0"), (F.sum("_c").over(before) - F.col("_c")).alias("_c0"), F.sum("_c").over(Window.partitionBy("g")).alias("_all"))
    within = Window.partitionBy("g", "_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumns({"_s": F.sum("n").over(within), "_i": F.row_number().over(Window.partitionBy("g", "_p").orderBy("_m")) - 1})
    at = laid(own, base).withColumns({"_s": F.col("_s") + F.col("_n0"), "at": F.col("_i") + F.col("_c0")})
    at = cut(at.withColumn("_d", F.greatest(F.ceil(F.col("_s") / budget) - 1, F.lit(0)) - F.col("at")).select("g", "_p", "_m", "o", "n", "_s", "at", "_d", "_all"), "multiples")
    lows = at.groupBy("g", "_p").agg(F.min("_d").alias("_low"))
    lows = lows.select("g", "_p", F.coalesce(F.min("_low").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1)).alias("_low0"))
    lowest = F.least(F.min("_d").over(within), F.col("_low0"), F.lit(1))
    opened = laid(at, lows).withColumn("_b", F.col("at") + lowest)
    ends = opened.groupBy("g", "_b").agg(F.min("at").alias("_x"), F.max("at").alias("_y"), F.max("_all").alias("_all"))
    if earlier:
        last = F.col("_all") - 1
        ends = ends.select("g", "_b", F.greatest(F.col("_x") - earlier, F.lit(0)).alias("_x"), F.when(F.col("_y") == last, last).otherwise(F.col("_y") - earlier).alias("_y")).where("_y >= 0")
    found = ends.drop("_all").alias("e")
    for end, columns in (("_x", {"first": "o", "_sx": "_s", "_nx": "n"}), ("_y", {"last": "o", "_sy": "_s"})):
        side = at.select("g", "at", *[F.col(c).alias(k) for k, c in columns.items()]).alias("s")
        found = found.join(side, F.col("e.g").eqNullSafe(F.col("s.g")) & (F.col(f"e.{end}") == F.col("s.at"))).select("e.*", *columns).alias("e")
    out = found.select("g", "_b", F.col("_x").alias("at"), "first", "last", (F.col("_y") - F.col("_x") + 1).alias("sequences"), (F.col("_sy") - F.col("_sx") + F.col("_nx")).alias("residues"))
    return positions(out, ["g"], ["_b"], "batch_no")


def split_by_length(df: DataFrame, chunk: int, max_length: int, length: str = "seqlen", order: str = "run_index") -> DataFrame:
    """``part``: ``CPU`` for sequences above ``max_length``; the others in chunks from 1 by rising length."""
    rows = df.withColumn("_long", F.col(length) > max_length)
    short = positions(rows.where("not _long"), ["_long"], [length, order], "_n").withColumn("part", F.floor(F.col("_n") / chunk + 1).cast("string"))
    return short.drop("_n", "_long").unionByName(rows.where("_long").withColumn("part", F.lit("CPU")).drop("_long"))

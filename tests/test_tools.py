import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandlake.operators import tools
from strandlake.operators.batching import before_multiples, groups_of_four, over_multiples, plan_batches, rank_share, resume_points, resume_share, split_by_length
from strandlake.operators.ranking import positions
from strandlake.schema import OUTPUT_COLUMNS

COLUMNS = [*OUTPUT_COLUMNS, "sdesc"]


def make_hits(spark, n=600, subjects=5, seed=1):
    rng, rows = random.Random(seed), []
    for k in range(n):
        q = rng.randint(0, 400)
        t = max(0, q + rng.randint(-40, 40)) if rng.random() < 0.7 else rng.randint(0, 400)
        sid = "hot" if rng.random() < 0.4 else f"s{rng.randint(1, subjects)}"
        rows.append((f"q{k}", round(rng.random(), 3), 0.5, 0.25, sid, q, q + 20, f"A{k}", "|", f"C{k}", t, t + 20, 500, 600, 21, "d"))
    return rows, spark.createDataFrame(rows, COLUMNS)


def chains_by_hand(rows):
    frame = pd.DataFrame(rows, columns=COLUMNS).sort_values(["sid", "qstart", "tstart", "qend", "tend", "qid"])
    out = []
    for _, g in frame.groupby("sid"):
        open_ = []
        for r in g.itertuples():
            if open_:
                dq, dt = r.qstart - open_[0].qstart, r.tstart - open_[0].tstart
                if dq < 0 or dt < 0 or (max(dq, dt) and min(dq, dt) / max(dq, dt) < 0.7):
                    out.append(open_)
                    open_ = []
            open_ = [*open_, r]
        out.append(open_)
    return sorted((c[0].sid, c[0].qstart, c[-1].qend, "~~~~~".join(r.qseq for r in c), len(c)) for c in out)


def test_chain_merge_over_many_partitions(spark):
    rows, df = make_hits(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = tools.merge_chains(df.repartition(9)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.sid, r.qstart, r.qend, r.qseq, r.merged) for r in got) == chains_by_hand(rows)


def test_chain_limits(spark):
    base = lambda q, t: ("q", 0.5, 0.5, 0.5, "s", q, q + 5, "A", "|", "C", t, t + 5, 9, 9, 6, None)
    for other, merged in (((10, 10), 1), ((17, 20), 1), ((17, 21), 2), ((20, 9), 2)):
        df = spark.createDataFrame([base(10, 10), base(*other)], "qid string, score double, ident double, similarity double, sid string, qstart int, qend int, qseq string, con string, tseq string, tstart int, tend int, tlen int, qlen int, match_len int, sdesc string")
        expected = merged if other != (17, 20) else (1 if min(7, 10) / max(7, 10) >= 0.7 else 2)
        assert tools.merge_chains(df).count() == expected
    assert tools.merge_chains(df.limit(0)).count() == 0


def test_lanes(spark):
    rng = random.Random(3)
    rows = [(f"q{k % 3}", k, round(rng.random(), 2), (q := rng.randint(0, 80)), q + rng.randint(1, 30)) for k in range(60)]
    df = spark.createDataFrame(rows, "qid string, hit_id long, score double, qstart int, qend int")
    for by in ("score", "qend"):
        got = {r.hit_id: r.lane for r in tools.pack_lanes(df, by).collect()}
        for q in ("q0", "q1", "q2"):
            left = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2] if by == "score" else r[4], r[1]))
            lane, last, expected = 1, 0, {}
            while left:
                fit = next((r for r in left if r[3] >= last), None)
                if fit is None:
                    lane, last = lane + 1, 0
                    continue
                expected[fit[1]], last = lane, fit[4]
                left.remove(fit)
            assert {k: got[k] for k in expected} == expected


def lanes_by_hand(rows):
    expected = {}
    for q in {r[0] for r in rows}:
        left = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        lane, last = 1, 0
        while left:
            fit = next((r for r in left if r[3] >= last), None)
            if fit is None:
                lane, last = lane + 1, 0
                continue
            expected[fit[1]], last = lane, fit[4]
            left.remove(fit)
    return expected


def test_lanes_of_a_query_over_many_partitions(spark, monkeypatch):
    whole = []
    monkeypatch.setattr(tools, "_lanes", lambda *a: whole.append(a))  # no query here may be one group
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.8 else f"q{k % 9}", k, round(rng.random(), 2), (q := rng.randint(0, 80)), q + rng.randint(0, 30)) for k in range(900)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "qid string, hit_id long, score double, qstart int, qend int").repartition(7)
        got = {r.hit_id: (r.lane, r.shade) for r in tools.pack_lanes(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {k: v[0] for k, v in got.items()} == lanes_by_hand(rows)
    low, high = min(r[2] for r in rows if r[0] == "hot"), max(r[2] for r in rows if r[0] == "hot")
    assert all(abs(got[r[1]][1] - (r[2] - low) / (high - low)) < 1e-12 for r in rows if r[0] == "hot")


def test_lanes_that_move_back(spark):
    rng = random.Random(6)
    rows = [(f"q{k % 3}", k, round(rng.random(), 2), (q := rng.randint(20, 80)), q + rng.randint(-20 if k % 3 else 0, 30)) for k in range(120)]
    got = {r.hit_id: r.lane for r in tools.pack_lanes(spark.createDataFrame(rows, "qid string, hit_id long, score double, qstart int, qend int")).collect()}
    assert got == lanes_by_hand(rows)


def test_every_hit_is_drawn(spark, data):
    from strandlake.plans.queries import QUERIES

    rows = QUERIES["all_plot_rows"](spark, data)
    assert rows.groupBy("qid").count().where("count > 25").count() and QUERIES["plot_lanes"](spark, data).count() == rows.count()


def passing_multiples(lengths, budget):
    """Positions that open a slice: row by row, one multiple each."""
    total, limit, out = 0, budget, []
    for k, n in enumerate(lengths):
        total += n
        if total > limit:
            out.append(k)
            limit += budget
    return out


def spans_of(opens, n):
    edges = sorted({0, n, *(k for k in opens if 0 < k < n)})
    return list(zip(edges, edges[1:]))


def fours_by_hand(lengths, budget):
    """Fours are added until one breaks the budget or none is left; the last one is given back."""
    out, begin, n = [], 0, len(lengths)
    while begin < n:
        fours = [lengths[k : k + 4] for k in range(begin, n, 4)]
        taken = []
        for four in fours:
            taken.append(four)
            if sum(map(sum, taken)) > budget:
                break
        size = sum(map(len, taken))
        if len(taken[-1]) < 4:
            if size > 4:
                out.append((begin, begin + size - len(taken[-1])))
            return [*out, (n - len(taken[-1]), n)]
        size = size - 4 if size > 4 else 2 if sum(taken[0][:2]) <= budget else 1
        out.append((begin, begin + size))
        begin += size
    return out


def test_planners():
    rng = random.Random(0)
    assert over_multiples([5, 5, 5], 7) == [(0, 1), (1, 2), (2, 3)]
    assert groups_of_four([10] * 4) == [(0, 2), (2, 4)]
    assert groups_of_four([10] * 8) == [(0, 4), (4, 6), (6, 8)]
    for _ in range(400):
        lengths = [rng.choice([0, rng.randint(50, 999), rng.randint(50, 999)]) for _ in range(rng.randint(1, 60))]
        budget = rng.choice([999, 1500, 3000, 6000])
        spans = groups_of_four(lengths, budget)
        assert spans == fours_by_hand(lengths, budget)
        assert [b for _, b in spans[:-1]] == [a for a, _ in spans[1:]] and spans[0][0] == 0 and spans[-1][1] == len(lengths)
        opens = passing_multiples(lengths, budget)
        assert over_multiples(lengths, budget) == spans_of(opens, len(lengths))
        assert before_multiples(lengths, budget) == spans_of([k - 1 for k in opens], len(lengths))


def test_planned_blocks_cover_a_group(spark):
    df = spark.range(1000).select(F.lit(7).alias("job_id"), F.col("id").alias("run_index"), (F.col("id") % 90 + 10).alias("seqlen"))
    got = plan_batches(df, groups_of_four, block=300).orderBy("block", "batch_no").collect()
    assert sum(r.sequences for r in got) == 1000 and [r["last"] + 1 for r in got[:-1]] == [r["first"] for r in got[1:]]


@pytest.mark.parametrize("planner", [over_multiples, groups_of_four, before_multiples])
def test_a_job_is_planned_whole(spark, planner):
    rng = random.Random(7)
    rows = [(rng.choice([7, 7, 7, 7, 8, None]), k, rng.choice([0, 1, 5000]) if k % 50 == 0 else rng.randint(50, 999)) for k in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "job_id long, run_index long, seqlen int").repartition(5)
        got = plan_batches(df, planner, block=100).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in (7, 8, None):
        at, n = (np.array(x) for x in zip(*(r[1:] for r in rows if r[0] == g)))
        expected = [(k, a // 100, at[a], at[b - 1], b - a, n[a:b].sum()) for k, (a, b) in enumerate(planner(n))]
        assert sorted((r.batch_no, r.block, r["first"], r["last"], r.sequences, r.residues) for r in got if r.job_id == g) == expected


def test_rank_share(spark):
    got = rank_share(spark.range(11).withColumnRenamed("id", "batch_id"), 3, 11)
    assert [r.rank for r in got.orderBy("batch_id").collect()] == [0] * 3 + [1] * 3 + [2] * 5


def test_resume_in_the_share_of_a_rank(spark):
    shares = rank_share(spark.range(11).withColumnRenamed("id", "batch_id"), 3, 11)
    points = spark.createDataFrame([(0, 1), (1, 5), (1, 4)], "rank long, last_batch long")
    assert sorted(r.batch_id for r in resume_share(shares, points).collect()) == [1, 2, 5, 6, 7, 8, 9, 10]
    early = spark.createDataFrame([(2, 4)], "rank long, last_batch long")
    with pytest.raises(Exception, match="isn't one of rank 2"):
        resume_share(shares, early).collect()


def test_split_by_length(spark):
    df = spark.createDataFrame([(0, 9), (1, 3), (2, 3), (3, 100), (4, 5)], "run_index long, seqlen int")
    assert {r.run_index: r.part for r in split_by_length(df, 2, 50).collect()} == {1: "1", 2: "1", 4: "2", 0: "2", 3: "CPU"}


def test_report_and_top(spark):
    _, df = make_hits(spark, 30)
    top = tools.top_hits(df, 5)
    assert [r["index"] for r in top.orderBy("index").collect()] == [1, 2, 3, 4, 5]
    line = tools.report_lines(top).orderBy("index").first()
    assert line.header.startswith("  1 ") and ">d" in line.body and "Identities=50%" in line.body
    everything = tools.top_hits(df).orderBy("index").collect()
    assert [r["index"] for r in everything] == list(range(1, 31)) and [r.score for r in everything] == sorted((r.score for r in everything), reverse=True)


def test_positions_of_a_hot_group(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.randint(0, 99), k) for k in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = positions(spark.createDataFrame(rows, "g string, o int, k long").repartition(5), ["g"], ["o", "k"], "n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = {}
    for g in ("hot", "a", "b", None):
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])):
            expected[r[2]] = n
    assert {r.k: r.n for r in got} == expected


def test_batches_before_multiples():
    assert before_multiples([3, 3, 3, 3], 5) == [(0, 2), (2, 4)]
    rng = random.Random(0)
    for _ in range(50):
        lengths = [rng.randint(50, 999) for _ in range(rng.randint(2, 60))]
        spans = before_multiples(lengths)
        assert spans[0][0] == 0 and spans[-1][1] == len(lengths) and all(b == c for (_, b), (c, _) in zip(spans, spans[1:])) and all(b > a for a, b in spans)


def test_resume_points(spark):
    rows = [(1, None, 5, 1), (1, None, 9, 2), (2, 0, 3, 1), (2, 1, None, 7), (None, 0, 1, 1)]
    df = spark.createDataFrame(rows, "job_id long, rank_id int, last_batch int, saved_at int")
    assert {tuple(r) for r in resume_points(df).collect()} == {(1, None, 9), (2, 0, 3), (2, 1, None)}

"""Tools on delivered hits: chain merge, top k, reports, lanes, class fields."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.residues import SPACER
from strandlake.operators.ranking import all_cores, positions, spread, walk
from strandlake.session import broadcast_if_small, cut

LEAST_RATIO = 0.7
#: Rows of a range partition that is walked by one task.
PARTITION_ROWS = 1_000_000
ORDER = ["sid", "qstart", "tstart", "qend", "tend", "qid", "score", "qseq", "tseq"]


def _chains(part: pd.DataFrame, anchor: tuple | None) -> tuple[np.ndarray, tuple | None]:
    """The place ``_m`` of the hit that opened each row's chain, given the anchor ``(sid, qstart, tstart, _m)`` before them; and the anchor after them."""
    chain = np.zeros(len(part), np.int64)
    for k, (sid, q, t, m) in enumerate(zip(*(part[c].tolist() for c in ("sid", "qstart", "tstart", "_m")))):
        if anchor is not None and anchor[0] == sid:
            dq, dt = q - anchor[1], t - anchor[2]
            if dq >= 0 and dt >= 0 and (max(dq, dt) == 0 or min(dq, dt) / max(dq, dt) >= LEAST_RATIO):
                chain[k] = anchor[3]
                continue
        anchor = (sid, q, t, m)
        chain[k] = m
    return chain, anchor


def chain_numbers(hits: DataFrame) -> DataFrame:
    """``chain``: hits of one subject that follow one another along both sequences get one number, which no other chain has.

    In the order of ``qstart`` a hit joins the open chain if, against the chain's first hit, it lies ahead on both sides by
    distances of a ratio of at least 0.7 (equal starts join); else it opens the next chain.

    The hits are range-partitioned by subject and position into partitions of at most about ``PARTITION_ROWS`` rows, so one
    subject may fill many. Each partition is walked as if nothing went before; then again with the anchor that its
    predecessor ended with, until no partition's last anchor changes; a chain's number is the place of its first hit.
    Rows with a null subject or start are left out.
    """
    rows = hits.where("sid is not null and qstart is not null and tstart is not null")
    order = [c for c in ORDER if c in hits.columns]
    tasks = all_cores(hits.sparkSession, rows.count(), PARTITION_ROWS)
    placed = cut(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "chains")
    slim = placed.select(F.shiftright("_m", 33).alias("_p"), "_m", "sid", F.col("qstart").cast("long").alias("qstart"), F.col("tstart").cast("long").alias("tstart"))

    def ends(anchors: dict[int, tuple]):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("_m")
            p = int(part["_p"].iloc[0])
            _, last = _chains(part, anchors.get(p))
            return pd.DataFrame([(p, *last, part["sid"].iloc[0])], columns=["_p", "sid", "qstart", "tstart", "_m", "first"])

        return run

    anchors: dict[int, tuple] = {}
    while True:
        # one row per partition
        got = sorted(slim.groupBy("_p").applyInPandas(ends(anchors), "_p long, sid string, qstart long, tstart long, _m long, first string").collect(), key=lambda r: r[0])
        before = {b[0]: (a[1], a[2], a[3], a[4]) for a, b in zip(got, got[1:]) if a[1] == b[5]}
        if before == anchors:
            break
        anchors = before
    final = anchors

    def mark(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_m")
        return pd.DataFrame({"_m": part["_m"], "chain": _chains(part, final.get(int(part["_p"].iloc[0])))[0]})

    return placed.join(slim.groupBy("_p").applyInPandas(mark, "_m long, chain long"), "_m")


def merge_chains(hits: DataFrame, least_score: float | None = None, decimals: int = 2) -> DataFrame:
    """One row per chain of each subject: mean rates to ``decimals``, first start, last end, texts joined by ``~~~~~``.

    A chain of one hit comes out as it is. Rows with a null subject or start are left out.
    """
    rows = hits if least_score is None else hits.where(F.col("score") >= least_score)
    chained = chain_numbers(rows)
    first, last = (lambda c: F.min_by(c, "_m")), (lambda c: F.max_by(c, "_m"))

    def joined(c: str, spacer: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_m", c))), lambda r: r[c]), spacer)

    def mean(c: str) -> Column:
        return F.when(F.count("*") > 1, F.round(F.avg(c), decimals)).otherwise(F.first(c))

    out = chained.groupBy("chain").agg(
        F.first("sid").alias("sid"), first("qid").alias("qid"), mean("score").alias("score"), mean("ident").alias("ident"), mean("similarity").alias("similarity"),
        first("qstart").alias("qstart"), last("qend").alias("qend"), joined("qseq", SPACER).alias("qseq"), joined("con", " " * len(SPACER)).alias("con"),
        joined("tseq", SPACER).alias("tseq"), first("tstart").alias("tstart"), last("tend").alias("tend"), first("tlen").alias("tlen"), first("qlen").alias("qlen"),
        F.when(F.count("*") > 1, last("qend") - first("qstart") + 1).otherwise(F.first("match_len")).alias("match_len"), first("sdesc").alias("sdesc"), F.count("*").alias("merged"),
    )
    return out.drop("chain")


def top_hits(rows: DataFrame, k: int = 0) -> DataFrame:
    """The ``k`` best rows (0: all) by score, with ``index`` from 1; ties by query, subject and position."""
    order = [F.col("score").desc_nulls_last(), "qid", "sid", "qstart", "tstart", "qseq", "tseq"]
    best = rows.orderBy(*order).limit(k) if k else rows.orderBy(*order)
    if k:
        return best.withColumn("index", F.row_number().over(Window.orderBy(*order)))
    from strandlake.sources.sequences import number_rows

    return number_rows(cut(best, "ranked"), "_i").withColumn("index", F.col("_i") + 1).drop("_i")


#: The title of the text report, and the warning in a merged match.
REPORT_TITLE = " No Hit                         Score   Query    Template"
MERGED_WARNING = 'Warning: this is a merged match. The linking points are indicated with "~~~~~"'


def _wide(text: Column, width: int, side: str) -> Column:
    """Spaces up to ``width`` on the right, on the left or on both sides; longer texts stay as they are."""
    spare = F.greatest(F.lit(width) - F.length(text), F.lit(0))
    left = {"left": F.lit(0), "right": spare, "middle": F.floor(spare / 2).cast("int")}[side]
    return F.concat(F.repeat(F.lit(" "), left), text, F.repeat(F.lit(" "), spare - left))


def report_lines(rows: DataFrame) -> DataFrame:
    """``header`` (a line of the table under :data:`REPORT_TITLE`) and ``body`` (the block ``No k``) of the text report for each row of :func:`top_hits`.

    Positions are printed from 1; a null description is printed as ``nan``.
    """
    at = lambda c: (F.col(c) + 1).cast("string")
    number, score = F.col("index").cast("string"), F.col("score").cast("string")
    spans = [_wide(F.concat(at(f"{s}start"), F.lit("-"), at(f"{s}end")), width, "middle") for s, width in (("q", 10), ("t", 8))]
    head = F.concat_ws(" ", _wide(number, 3, "right"), _wide(F.col("sid"), 27, "left"), _wide(score, 5, "left"), *spans, F.concat(F.lit("("), F.col("tlen").cast("string"), F.lit(")")))
    rates = F.concat(F.lit("Score="), score, F.lit(" Identities="), F.bround(F.col("ident") * 100).cast("int").cast("string"), F.lit("% Similarity="), F.bround("similarity", 2).cast("string"))
    warning = F.when(F.instr("qseq", SPACER) > 0, F.lit(MERGED_WARNING + "\n\n")).otherwise("")
    sides = [F.concat_ws(" ", F.lit(mark), _wide(at(f"{s}start"), 6, "right"), F.col(f"{s}seq"), _wide(at(f"{s}end"), 6, "left")) for mark, s in (("Q", "q"), ("T", "t"))]
    block = [F.concat(F.lit("\n\nNo "), number), F.concat(F.lit(">"), F.coalesce("sdesc", F.lit("nan"))), F.concat(rates, F.lit("\n")), F.concat(warning, sides[0]), F.concat(F.lit(" " * 9), F.col("con")), sides[1]]
    return rows.select("index", head.alias("header"), F.concat_ws("\n", *block).alias("body"))


def class_field(description: Column, name: str, following: str) -> Column:
    """The field ``name: ...`` of a comma-separated description, up to the next named field; null if it isn't there."""
    begin, end = F.instr(description, f", {name}: "), F.instr(description, f", {following}:")
    return F.when((begin > 0) & (end > begin), F.substring(description, begin + 2, end - begin - 2))


def class_fields(rows: DataFrame, description: str = "sdesc") -> DataFrame:
    """Columns ``X``, ``H`` and ``T`` out of the description."""
    d = F.col(description)
    return rows.withColumns({"X": class_field(d, "X", "H"), "H": class_field(d, "H", "T"), "T": class_field(d, "T", "F")})


def colour_numbers(rows: DataFrame, unnamed: str = "X: NO_X_NAME") -> DataFrame:
    """``(X, T, colour)``: X groups numbered in order of their name from 0; the unnamed group has none (grey)."""
    groups = rows.where("X is not null and T is not null").select("X", "T").distinct()
    names = groups.where(F.col("X") != unnamed).select("X").distinct()
    numbered = positions(names, [], ["X"], "colour")
    return groups.join(broadcast_if_small(numbered), "X", "left")


def plot_rows(hits: DataFrame, least_score: float = 0.0, most: int = 0, order: str = "hit_id") -> DataFrame:
    """Hits to draw: at or above the score, the first ``most`` of each query in the order of ``order`` (0: all), with ``len``."""
    kept = hits.where(F.col("score") >= least_score).withColumn("len", F.col("qend") - F.col("qstart"))
    if not most:
        return kept
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(order))).where(F.col("_n") <= most).drop("_n")


def pack_lanes(hits: DataFrame, by: str = "score", order: str = "hit_id") -> DataFrame:
    """``(qid, order, lane, shade)``: drawing lanes from 1, and the score scaled to 0..1 within the query.

    Hits are taken by falling score or rising ``qend`` (ties by ``order``): the first unplaced one that begins at or after
    the last end goes next to it; if there is none, the next lane begins. A query of one score has shade 0.

    While no hit ends before it begins, that is the same as putting each hit in turn into the first lane that has room: only
    the lanes' ends are carried on, and a query of any size is walked over range partitions (:func:`walk`). With a hit that
    ends before it begins a lane can move back; such a query is walked lane by lane as one group.
    """
    rows = hits.where("qid is not null and qstart is not null and qend is not null").select("qid", order, F.col("score").cast("double").alias("score"), "qstart", "qend")
    rows = cut(rows, "lanes")
    scores = F.coalesce("score", F.lit(float("nan")))
    queries = cut(rows.groupBy("qid").agg(F.min(scores).alias("_low"), F.max(scores).alias("_high"), F.max(F.col("qend") < F.col("qstart")).alias("_back"), F.min("qstart").alias("_first")), "lane-queries")
    if queries.where("_first < 0").head(1):
        raise ValueError("a hit begins before position 0")
    sort = [F.col(by).desc() if by == "score" else F.col(by), F.col(order)]
    back = queries.where("_back").select("qid")
    turned = bool(back.head(1))
    forward = rows.join(broadcast_if_small(back), "qid", "left_anti") if turned else rows
    placed, lanes = walk(forward, "qid", sort, ["qstart", "qend"], _first_fit, "_m long, lane int")
    out = placed.join(lanes, "_m").select("qid", order, "lane", "score")
    if turned:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = None  # the last query of a batch may go on in the next one
            for batch in batches:
                held = batch if held is None else pd.concat([held, batch], ignore_index=True)
                q = held["qid"].to_numpy()
                edges = np.flatnonzero(q[1:] != q[:-1]) + 1
                if len(edges):
                    yield _lanes(held.iloc[: edges[-1]], order)
                    held = held.iloc[edges[-1] :].reset_index(drop=True)
            if held is not None and len(held):
                yield _lanes(held, order)

        whole = spread(rows.join(broadcast_if_small(back), "qid", "left_semi"), "qid").sortWithinPartitions("qid", *sort)
        out = out.unionByName(whole.mapInPandas(run, f"qid string, {order} {dict(hits.dtypes)[order]}, lane int, score double"))
    shade = F.when((F.col("_high") > F.col("_low")) & ~F.isnan("_high"), (F.col("score") - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)
    return out.join(broadcast_if_small(queries), "qid").select("qid", order, "lane", shade.alias("shade"))


def _first_fit(part: dict[str, np.ndarray], state: bytes | None, ends: bool) -> tuple[dict[str, np.ndarray], bytes]:
    """The first lane with room for each hit; the state is the end of each lane. A tree of the least ends finds the lane."""
    lane = np.zeros(len(part["_m"]), np.int32)
    held = np.frombuffer(state or b"", np.int64).tolist()
    n, room = len(held), 1
    while room < max(8, n):
        room *= 2

    def tree(leaves: list[int]) -> list[float]:
        t = [np.inf] * room + leaves + [np.inf] * (room - len(leaves))
        for i in range(room - 1, 0, -1):
            t[i] = min(t[2 * i], t[2 * i + 1])
        return t

    least = tree(held)
    for k, (s, e) in enumerate(zip(part["qstart"].tolist(), part["qend"].tolist())):
        if least[1] <= s:
            i = 1
            while i < room:
                i *= 2
                if least[i] > s:
                    i += 1
        else:
            if n == room:
                leaves = least[room:]
                room *= 2
                least = tree(leaves)
            i, n = room + n, n + 1
        lane[k], least[i] = i - room + 1, e
        while i > 1:
            i //= 2
            low = min(least[2 * i], least[2 * i + 1])
            if least[i] == low:
                break
            least[i] = low
    return {"_m": part["_m"], "lane": lane}, b"" if ends else np.array(least[room : room + n], np.int64).tobytes()


def _lanes(part: pd.DataFrame, order: str) -> pd.DataFrame:
    """Lanes of whole queries that follow one another, each in drawing order."""
    q, start, end = (part[c].to_numpy() for c in ("qid", "qstart", "qend"))
    edges = [0, *(np.flatnonzero(q[1:] != q[:-1]) + 1).tolist(), len(q)]
    lane = np.zeros(len(q), np.int32)
    for a, b in zip(edges, edges[1:]):
        s, e, left, number = start[a:b].tolist(), end[a:b].tolist(), list(range(b - a)), 0
        while left:
            # one walk fills a lane: the first that fits starts over from the front, as a lane's end can also move back
            number, last = number + 1, 0
            while (k := next((k for k in left if s[k] >= last), None)) is not None:
                lane[a + k], last = number, e[k]
                left.remove(k)
    return pd.DataFrame({"qid": q, order: part[order].to_numpy(), "lane": lane, "score": part["score"].to_numpy()})

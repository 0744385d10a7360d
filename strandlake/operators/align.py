"""Alignment of screened pairs by numpy kernels over Arrow batches.

The similarity of a pair is one matrix product; the score matrix goes row by row; all tracebacks of a pair step together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.matrices import matrix, to_matrices, unit_rows
from strandlake.operators.ranking import spread
from strandlake.params import STOP_SCORE, AlignParams
from strandlake.schema import HIT
from strandlake.session import broadcast_if_small, small_enough

#: Rows that a task holds before it hands them over.
OUT_ROWS = 200_000
COLUMNS = ["queryid", "dbid", "pathid", "spanid", "span_start", "span_end", "indices", "score", "len", "mode", "y1", "x1"]


def similarity_map(query: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Cosine of each residue pair, ``[target, query]``."""
    return unit_rows(target) @ unit_rows(query).T


def enhanced(a: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return ((a - a.mean(0)) / a.std(0) + (a - a.mean(1, keepdims=True)) / a.std(1, keepdims=True)) / 2


def normal(a: np.ndarray) -> np.ndarray:
    return (a - a.mean()) / (a.std() + 1e-3)


def score_local(a: np.ndarray) -> np.ndarray:
    """Best run along each diagonal, with a zero row and column in front."""
    h = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    for i in range(a.shape[0]):
        np.maximum(h[i, :-1] + a[i], 0, out=h[i + 1, 1:])
    return h


def score_global(a: np.ndarray, gap: float) -> np.ndarray:
    """Linear gaps, never below 0. The chain of left moves is a running maximum of the cells with their gap costs undone."""
    h = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    cost = gap * np.arange(a.shape[1] + 1)
    for i in range(a.shape[0]):
        row = np.zeros(a.shape[1] + 1)
        row[1:] = np.maximum(np.maximum(h[i, :-1] + a[i], h[i, 1:] - gap), 0)
        h[i + 1] = np.maximum.accumulate(row + cost) - cost
        h[i + 1, 0] = 0
    return h


def borders(h: np.ndarray, cutoff: int, factor: int) -> np.ndarray:
    """Start cells of tracebacks, see :func:`strandlake.operators.score.border_starts`."""
    bottom, right = h.shape[0] - 1, h.shape[1] - 1
    down = np.arange(cutoff if bottom >= cutoff else 0, bottom + 1)
    back = np.arange(cutoff if right >= cutoff else 0, right)[::-1]
    cells = np.concatenate([np.stack([down, np.full_like(down, right)], 1), np.stack([np.full_like(back, bottom), back], 1)])
    if factor == 1:
        return cells
    whole = cells[: len(cells) // factor * factor].reshape(-1, factor, 2)
    best = h[whole[:, :, 0], whole[:, :, 1]].argmax(axis=1)
    return whole[np.arange(len(whole)), best]


def tracebacks(h: np.ndarray, starts: np.ndarray, gap: float) -> list[np.ndarray]:
    """Paths (end to start, matrix coordinates) from all start cells at once.

    A step goes to the diagonal neighbour if it is at least as good as the two others, else up if strictly better than left,
    else left. A gap costs from the second step in a row that isn't diagonal on. A path ends at the first row or column, or when
    the best neighbour is below the stop score.
    """
    y, x = starts[:, 0].copy(), starts[:, 1].copy()
    diagonal = np.ones(len(starts), bool)
    alive = np.arange(len(starts))
    trail = [(alive, y.copy(), x.copy())]
    while True:
        alive = alive[(y[alive] > 1) & (x[alive] > 1)]
        if not len(alive):
            break
        cy, cx = y[alive], x[alive]
        penalty = np.where(diagonal[alive], 0.0, gap)
        up, left, diag = h[cy - 1, cx] - penalty, h[cy, cx - 1] - penalty, h[cy - 1, cx - 1]
        go_diag = (diag >= up) & (diag >= left)
        go_up = ~go_diag & (up > left)
        best = np.where(go_diag, diag, np.where(go_up, up, left))
        on = best >= STOP_SCORE
        alive, go_diag, go_up = alive[on], go_diag[on], go_up[on]
        if not len(alive):
            break
        y[alive] -= go_diag | go_up
        x[alive] -= go_diag | ~go_up
        diagonal[alive] = go_diag
        trail.append((alive, y[alive].copy(), x[alive].copy()))
    owner, py, px = (np.concatenate(part) for part in zip(*trail))
    order = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.diff(owner[order])) + 1
    return np.split(np.stack([py[order], px[order]], 1), cuts) if len(starts) else []


def smoothed(v: np.ndarray, window: int) -> np.ndarray:
    n, w = len(v), min(window, len(v))
    prefix = np.append(0.0, np.cumsum(v))
    end = np.maximum(w - 1, np.minimum(np.arange(n), n - window - 1))
    return (prefix[end + 1] - prefix[end + 1 - w]) / w * (v > 0)


def spans(means: np.ndarray, least: int, threshold: float) -> list[tuple[int, int]]:
    """First and last position of each run at or above the threshold: ``least`` long inside, longer than that at the end."""
    n = len(means)
    breaks = np.flatnonzero(means < threshold)
    edges = np.concatenate([[-1], breaks, [n]])
    size = np.diff(edges) - 1
    long = size >= np.where(np.arange(len(size)) == len(size) - 1, least + 1, least)
    return [(int(a) + 1, int(a + s)) for a, s in zip(edges[:-1][long], size[long])]


def path_hits(a: np.ndarray, paths: list[np.ndarray], params: AlignParams) -> list[tuple]:
    """Hits of a pair: ``(pathid, spanid, start, end, indices, score, len)``."""
    least, out = params.span, []
    for pathid, path in enumerate(paths):
        if path.size < least or path.min() < 1:
            continue
        cells = path[::-1] - 1
        y, x = cells[:, 0], cells[:, 1]
        if params.mode == "local":
            values = a[y, x]
            found = spans(smoothed(values, params.window) if params.window > 1 else values, least, params.threshold)
        else:
            found = [(0, len(path))]
        for spanid, (start, stop) in enumerate(found):
            if stop - start < least:
                continue
            kept = cells[start : stop - 1] if params.mode == "local" else cells
            if min(kept[-1] - kept[0]) > least:
                out.append((pathid, spanid, start, stop, kept, float(a[kept[:, 0], kept[:, 1]].mean()), stop - start))
    return out


def align(query: np.ndarray, target: np.ndarray, params: AlignParams) -> list[tuple]:
    """All hits of one pair, filtered if asked for."""
    a = similarity_map(query, target)
    if params.enhance:
        a = enhanced(a)
    b = normal(a) if params.normalise else a
    h = score_local(b) if params.mode == "local" else score_global(b, params.gap)
    starts = borders(h, params.min_span, params.bfactor) if params.mode == "local" else np.array([[h.shape[0] - 1, h.shape[1] - 1]])
    hits = path_hits(a, tracebacks(h, starts, params.gap), params)
    return filtered(hits) if params.filter_hits else hits


def filtered(hits: list[tuple]) -> list[tuple]:
    """Of the hits that start in one cell the best (then longest, then first path), in falling order of score; scores that agree to 9 decimals tie."""
    best: dict[tuple[int, int], tuple] = {}
    for hit in hits:
        key = tuple(hit[4][0].tolist())
        rank = (-round(hit[5], 9), -hit[6], hit[0])
        if key not in best or rank < best[key][0]:
            best[key] = (rank, hit)
    seen: dict[tuple, tuple] = {}
    for _, hit in sorted(best.values(), key=lambda v: v[0]):
        seen.setdefault((hit[0], hit[6], round(hit[5], 9)), hit)
    return list(seen.values())


def _frame(queryid: int, dbid: int, hits: list[tuple], mode: str) -> pd.DataFrame:
    rows = [(queryid, dbid, p, s, a, b, [{"y": int(y), "x": int(x)} for y, x in cells.tolist()], score, n, mode, int(cells[0, 0]), int(cells[0, 1])) for p, s, a, b, cells, score, n in hits]
    return pd.DataFrame(rows, columns=COLUMNS)


def align_pairs(pairs: DataFrame, queries: DataFrame, targets: DataFrame, params: AlignParams, held_residues: int = 200_000) -> DataFrame:
    """Hits of the given ``(queryid, dbid)`` pairs; see ``strandlake.schema.HIT``.

    If the queries have at most ``held_residues`` residues (checked), their matrices are broadcast and each target's matrix
    meets its list of queries once. Beyond that both matrices are joined to the pairs, which are spread by pair.
    Pairs without vectors on either side give no row; repeated pairs are aligned once.
    """
    spark = pairs.sparkSession
    wanted = pairs.select("queryid", "dbid").distinct()
    t = to_matrices(targets).select(F.col("run_index").alias("dbid"), F.col("n").alias("nt"), F.col("emb").alias("b"))
    if small_enough(queries.select("run_index"), held_residues):
        rows = to_matrices(queries.join(broadcast_if_small(wanted.select(F.col("queryid").alias("run_index")).distinct()), "run_index", "left_semi")).collect()  # bounded by held_residues
        held = spark.sparkContext.broadcast({r.run_index: matrix(r.emb, r.n) for r in rows})
        work = wanted.groupBy("dbid", F.pmod(F.xxhash64("queryid"), F.lit(16)).alias("_s")).agg(F.collect_list("queryid").alias("qs")).join(t, "dbid").select("dbid", "nt", "b", "qs")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for dbid, nt, b, qs in batch.itertuples(index=False):
                    target = matrix(b, nt)
                    for queryid in qs:
                        if (query := held.value.get(queryid)) is not None and (hits := align(query, target, params)):
                            yield _frame(queryid, dbid, hits, params.mode)

        return spread(work, "dbid", "qs").mapInPandas(run, HIT)

    q = to_matrices(queries).select(F.col("run_index").alias("queryid"), F.col("n").alias("nq"), F.col("emb").alias("a"))
    work = wanted.join(q, "queryid").join(t, "dbid").select("queryid", "dbid", "nq", "a", "nt", "b")

    def run_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for queryid, dbid, nq, a, nt, b in batch.itertuples(index=False):
                if hits := align(matrix(a, nq), matrix(b, nt), params):
                    yield _frame(queryid, dbid, hits, params.mode)

    return spread(work, "queryid", "dbid").mapInPandas(run_pairs, HIT)


def by_matrix(pairs: DataFrame, queries: DataFrame, targets: DataFrame, made: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``(queryid, dbid)`` and what ``made`` gives of each pair's similarity map: the map stays in the task that computes it, only the rows of ``schema`` leave it."""
    q = to_matrices(queries).select(F.col("run_index").alias("queryid"), F.col("n").alias("nq"), F.col("emb").alias("a"))
    t = to_matrices(targets).select(F.col("run_index").alias("dbid"), F.col("n").alias("nt"), F.col("emb").alias("b"))
    work = pairs.select("queryid", "dbid").distinct().join(q, "queryid").join(t, "dbid").select("queryid", "dbid", "nq", "a", "nt", "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for queryid, dbid, nq, a, nt, b in batch.itertuples(index=False):
                part = made(similarity_map(matrix(a, nq), matrix(b, nt)))
                n = len(next(iter(part.values())))
                rows.append({"queryid": np.full(n, queryid), "dbid": np.full(n, dbid), **part})
                held += n
                if held >= OUT_ROWS:
                    yield _stacked(rows)
                    rows, held = [], 0
            if held:
                yield _stacked(rows)

    return spread(work, "queryid", "dbid").mapInPandas(run, f"queryid long, dbid long, {schema}")


def _stacked(rows: list[dict[str, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame({c: np.concatenate([r[c] for r in rows]) for c in rows[0]})


def _cells(m: np.ndarray, name: str) -> dict[str, np.ndarray]:
    y, x = np.indices(m.shape, np.int32)
    return {"y": y.ravel(), "x": x.ravel(), name: m.ravel()}


def path_cells(pairs: DataFrame, queries: DataFrame, targets: DataFrame, params: AlignParams) -> DataFrame:
    """``(queryid, dbid, pathid, k, y, x, c)``: every cell of every traceback, from its start on, in residue coordinates."""

    def made(m: np.ndarray) -> dict[str, np.ndarray]:
        h = score_local(m) if params.mode == "local" else score_global(m, params.gap)
        starts = borders(h, params.min_span, params.bfactor) if params.mode == "local" else np.array([[h.shape[0] - 1, h.shape[1] - 1]])
        paths = [p[::-1] - 1 for p in tracebacks(h, starts, params.gap)]
        cells = [p[(p >= 0).all(axis=1)] for p in paths]
        size = [len(p) for p in cells]
        at = np.concatenate([*cells, np.zeros((0, 2), np.int64)]).astype(np.int64)
        return {"pathid": np.repeat(np.arange(len(cells), dtype=np.int32), size), "k": np.concatenate([*(np.arange(n) for n in size), np.zeros(0)]).astype(np.int32), "y": at[:, 0], "x": at[:, 1], "c": m[at[:, 0], at[:, 1]]}

    return by_matrix(pairs, queries, targets, made, "pathid int, k int, y int, x int, c double")


def similarity_cells(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """``(queryid, dbid, y, x, c)`` as :func:`strandlake.operators.score.residue_pairs`, by one matrix product per pair."""
    return by_matrix(pairs, queries, targets, lambda m: _cells(m, "c"), "y int, x int, c double")


def enhanced_cells(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """As :func:`strandlake.operators.score.signal_enhancement` of all cells; none is shuffled."""
    return by_matrix(pairs, queries, targets, lambda m: _cells(enhanced(m), "c"), "y int, x int, c double")


def normal_cells(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """As :func:`strandlake.operators.score.global_znorm` of all cells; none is shuffled."""
    return by_matrix(pairs, queries, targets, lambda m: _cells(normal(m), "c"), "y int, x int, c double")


def score_cells(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """As :func:`strandlake.operators.score.score_matrix`, ``(queryid, dbid, y, x, h)``; no cell is shuffled."""
    return by_matrix(pairs, queries, targets, lambda m: _cells(score_local(m)[1:, 1:], "h"), "y int, x int, h double")


def best_cells(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """As :func:`strandlake.operators.score.best_cell`: one row leaves the task for each pair."""

    def made(m: np.ndarray) -> dict[str, np.ndarray]:
        h = score_local(m)[1:, 1:]
        y, x = np.unravel_index([h.argmax()], h.shape)  # the first of several by y, then x
        return {"max_h": h[y, x], "y": y, "x": x}

    return by_matrix(pairs, queries, targets, made, "max_h double, y int, x int")


def best_diagonals(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """As :func:`strandlake.operators.hits.best_diagonal`."""

    def made(m: np.ndarray) -> dict[str, np.ndarray]:
        y, x = np.indices(m.shape)
        return {"best": np.bincount((y - x + m.shape[1] - 1).ravel(), weights=m.ravel()).max(keepdims=True)}

    return by_matrix(pairs, queries, targets, made, "best double")


def start_cells(pairs: DataFrame, queries: DataFrame, targets: DataFrame, cutoff: int, factor: int) -> DataFrame:
    """As :func:`strandlake.operators.score.border_starts`, ``(queryid, dbid, pathid, my, mx, h)``."""

    def made(m: np.ndarray) -> dict[str, np.ndarray]:
        h = score_local(m)
        at = borders(h, cutoff, factor)
        return {"pathid": np.arange(len(at), dtype=np.int32), "my": at[:, 0], "mx": at[:, 1], "h": h[at[:, 0], at[:, 1]]}

    return by_matrix(pairs, queries, targets, made, "pathid int, my int, mx int, h double")


def path_mask(paths: DataFrame) -> DataFrame:
    """``(queryid, dbid, y, x)``: each cell that any path of a pair goes through, once."""
    return paths.select("queryid", "dbid", "y", "x").distinct()

"""The whole search: screen, align, format, order."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strandlake.operators.align import align_pairs
from strandlake.operators.output import check_scores, final_order, format_hits, mirror_hits
from strandlake.operators.screen import screen
from strandlake.params import AlignParams, ScreenParams


def search(
    queries: DataFrame,
    query_residues: DataFrame,
    targets: DataFrame,
    target_residues: DataFrame,
    align: AlignParams = AlignParams(),
    screening: ScreenParams = ScreenParams(),
    cutoff: float = 0.3,
    reduce_duplicates: bool = False,
    raw: bool = False,
) -> DataFrame:
    """Delivered hits of every query against every target; ``raw`` gives the hits as they are aligned.

    ``queries`` and ``targets`` are indexes ``(run_index, id, description, sequence)``, the residues their vectors.
    ``reduce_duplicates`` aligns one direction of each pair and adds the other one; it is meant for queries = targets.
    """
    pairs = screen(query_residues, target_residues, screening, symmetric=reduce_duplicates)
    hits = check_scores(align_pairs(pairs, query_residues, target_residues, align), align.enhance)
    if raw:
        return hits
    rows = format_hits(hits, queries, targets, cutoff)
    if reduce_duplicates:
        rows = mirror_hits(rows, targets.select("id", "description"))
    return final_order(rows)

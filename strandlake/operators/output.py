"""From hits to the delivered table: descriptions, rendering, rates, cut-off, mirror rows, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.residues import consensus, identity, render, similarity
from strandlake.schema import OUTPUT_COLUMNS
from strandlake.session import broadcast_if_small


def format_hits(hits: DataFrame, queries: DataFrame, targets: DataFrame, cutoff: float = 0.3, half_even: bool = True) -> DataFrame:
    """The delivered columns of all hits that score at least ``cutoff`` (before rounding).

    ``queries`` and ``targets`` are indexes ``(run_index, id, sequence, description)``. Coordinates count from 0 and include
    both ends. Rates are rounded to 2 decimals and scores to 3, half to even unless asked otherwise.
    """
    rounded = F.bround if half_even else F.round
    q = queries.select(F.col("run_index").alias("queryid"), F.col("id").alias("qid"), F.col("sequence").alias("_qs"))
    t = targets.select(F.col("run_index").alias("dbid"), F.col("id").alias("sid"), F.col("sequence").alias("_ts"), F.col("description").alias("sdesc"))
    rows = hits.where(F.col("score") >= cutoff).join(broadcast_if_small(q, 20_000), "queryid").join(broadcast_if_small(t, 20_000), "dbid")
    first, last = F.element_at("indices", 1), F.element_at("indices", -1)
    rows = rows.withColumns({
        "qstart": first["x"], "qend": last["x"], "tstart": first["y"], "tend": last["y"],
        "qlen": F.length("_qs"), "tlen": F.length("_ts"),
        "qseq": render(F.col("indices"), F.col("_qs"), "x"), "tseq": render(F.col("indices"), F.col("_ts"), "y"),
    })
    rows = rows.withColumns({
        "match_len": F.col("qend") - F.col("qstart") + 1,
        "con": consensus(F.col("qseq"), F.col("tseq")),
        "ident": rounded(identity(F.col("qseq"), F.col("tseq")), 2),
        "similarity": rounded(similarity(F.col("qseq"), F.col("tseq")), 2),
        "score": rounded("score", 3),
    })
    return rows.select(*OUTPUT_COLUMNS, "sdesc")


def round_scaled(value: Column, decimals: int) -> Column:
    """Scaled, rounded to a whole number (half away from zero) and scaled back, as DuckDB rounds doubles.

    Spark's ``round`` takes the shortest decimal text of the value instead: 0.5005, as a double a little below that, is 0.501
    there and 0.5 here. Null, NaN, infinities and values too large to scale stay as they are.
    """
    scaled = value * F.lit(10.0**decimals)
    return F.when(F.abs(scaled) < F.lit(float("inf")), F.round(scaled) / F.lit(10.0**decimals)).otherwise(value)


def mirror_hits(rows: DataFrame, descriptions: DataFrame | None = None, decimals: int = 2) -> DataFrame:
    """Add, for each hit whose pair was never found the other way round, the hit with its sides swapped; scores to ``decimals`` by :func:`round_scaled`.

    ``con`` and ``match_len`` stay as they are. ``sdesc``, if present, becomes the description of the new subject, from
    ``descriptions`` ``(id, description)``, or null. Rows with a null ``qid`` or ``sid`` aren't mirrored.
    """
    known = rows.select(F.col("qid").alias("sid"), F.col("sid").alias("qid")).distinct()
    lonely = rows.where("qid is not null and sid is not null").join(known, ["qid", "sid"], "left_anti")
    swap = {"qid": "sid", "sid": "qid", "qstart": "tstart", "tstart": "qstart", "qend": "tend", "tend": "qend", "qseq": "tseq", "tseq": "qseq", "qlen": "tlen", "tlen": "qlen"}
    mirrored = lonely.select(*[F.col(swap.get(c, c)).alias(c) for c in rows.columns if c != "sdesc"])
    if "sdesc" in rows.columns:
        if descriptions is None:
            mirrored = mirrored.withColumn("sdesc", F.lit(None).cast("string"))
        else:
            named = descriptions.where("id is not null").groupBy(F.col("id").alias("sid")).agg(F.max("description").alias("sdesc"))
            mirrored = mirrored.join(named, "sid", "left")
    return rows.unionByName(mirrored.select(*rows.columns)).withColumn("score", round_scaled(F.col("score"), decimals))


def final_order(rows: DataFrame) -> DataFrame:
    """By query and score, both falling; ties by subject and position."""
    return rows.orderBy(F.col("qid").desc(), F.col("score").desc(), "sid", "tstart", "qstart")


def check_scores(rows: DataFrame, enhanced: bool, bound: float = 1.01) -> DataFrame:
    """Fails while it is computed if a score exceeds ``bound``, unless the signal was enhanced."""
    if enhanced:
        return rows
    return rows.withColumn("score", F.when(F.col("score") <= bound, F.col("score")).otherwise(F.raise_error(F.lit("a score is above its bound")).cast("double")))

"""The N best rows of every group, read from a clustered layout by its statistics.

The current rows are written once, ordered by group and falling score over all files, in Parquet row groups of bounded
size. Row groups are then taken in falling order of their greatest score; one that lies strictly below the N-th score
that its only group has reached already isn't read. The order spreads a group of any size over many files. A row group of
several groups is always read: in this order all but its first and last group lie in it whole, so nothing is known of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.operators.ranking import all_cores
from strandlake.session import broadcast_if_small, cut, scratch_path

ROW_GROUP_BYTES = 1 << 20
#: Row groups that are read in one task at most on average, and those of a file that stay together.
TASK_ROW_GROUPS, NEIGHBOURS = 128, 16
STATS = "path string, rg int, rows long, lo string, hi string, top double, low double"


def latest_rows(df: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """Of each ``key`` the row with the greatest ``version``; of rows that tie, the one that is greatest in ``columns``, taken in their order."""
    best = df.groupBy(key).agg(F.max(F.struct(version, *columns)).alias("_r"))
    return best.select(key, *[F.col("_r")[c].alias(c) for c in columns])


def _place(path: str) -> tuple:
    """File system and inner path of a file as Spark names it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def _statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Row-group statistics from the files' footers."""
    import pyarrow.parquet as pq

    for batch in batches:
        rows = []
        for path in batch["path"]:
            store, inner = _place(path)
            meta = pq.read_metadata(inner, filesystem=store)
            names = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
            for k in range(meta.num_row_groups):
                group, score = (meta.row_group(k).column(names[c]).statistics for c in ("g", "s"))
                text = [None, None] if group is None or not group.has_min_max else [x.decode() if isinstance(x, bytes) else str(x) for x in (group.min, group.max)]
                bound = (score.max, score.min) if score is not None and score.has_min_max else (np.inf, -np.inf)
                rows.append((path, k, meta.row_group(k).num_rows, *text, *bound))
        yield pd.DataFrame(rows, columns=["path", "rg", "rows", "lo", "hi", "top", "low"])


def _first_of_runs(frame: pd.DataFrame, n: int) -> pd.DataFrame:
    """The first ``n`` rows of each run of equal ``g``."""
    g = frame["g"].to_numpy()
    head = np.append(True, g[1:] != g[:-1]) if len(g) else np.zeros(0, bool)
    at = np.arange(len(g))
    return frame[at - np.maximum.accumulate(np.where(head, at, 0)) < n]


def _reader(n: int):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        parts = list(batches)
        if not parts:
            return
        asked = pd.concat(parts, ignore_index=True)  # names of row groups, a few bytes for each MB of data
        nth: dict[str, float] = {}
        best: dict[str, list[float]] = {}
        for path, rg, lo, hi, top in asked.sort_values(["top", "path", "rg"], ascending=[False, True, True])[["path", "rg", "lo", "hi", "top"]].itertuples(index=False):
            if lo is not None and lo == hi and top < nth.get(lo, -np.inf):
                continue
            store, inner = _place(path)
            with pq.ParquetFile(inner, filesystem=store) as f:
                frame = _first_of_runs(f.read_row_group(int(rg), columns=["g", "s", "t", "k"]).to_pandas(), n)
            for edge in {lo, hi} - {None}:  # only the groups at its edges can go on in other row groups
                scores = sorted([*best.get(edge, []), *frame["s"][frame["g"] == edge]], reverse=True)[:n]
                best[edge] = scores
                if len(scores) == n:
                    nth[edge] = scores[-1]
            if len(frame):
                yield frame

    return read


def top_n(df: DataFrame, group: str, score: str, tie: str, key: str, n: int = 10, row_group_bytes: int = ROW_GROUP_BYTES, max_files_listed: int = 200_000) -> DataFrame:
    """The first ``n`` rows ``(group, key)`` of each group by ``score`` falling, ``tie`` falling, ``key`` rising.

    ``group`` is a string, ``score`` a number, ``key`` a long that is unique in ``df`` (see :func:`latest_rows`).

    Defined results: rows with a null group, and rows whose score is null or NaN, take no part; a null ``tie`` comes
    after all others; a group with fewer rows gives all of them; repeated rows count once each; an empty table gives no
    row; other columns, of any name, are ignored; ``-0.0`` and ``0.0`` tie.
    """
    spark = df.sparkSession
    rows = df.select(F.col(group).alias("g"), (F.col(score).cast("double") + F.lit(0.0)).alias("s"), F.col(tie).cast("long").alias("t"), F.col(key).alias("k"))
    rows = rows.where(F.col("g").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
    order = [F.col("g"), F.col("s").desc(), F.col("t").desc_nulls_last(), F.col("k")]
    layout = scratch_path(spark, "topn")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.size", row_group_bytes).option("parquet.page.size", max(64 << 10, row_group_bytes // 8)).parquet(layout)

    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(layout).select("path")
    stats = cut(listed.repartition(all_cores(spark), "path").mapInPandas(_statistics, STATS), "topn-stats")
    pure = F.col("lo").isNotNull() & (F.col("lo") == F.col("hi"))
    # what the statistics alone prove: n rows of the group score at least this much. A row group has a row at least, so the n
    # row groups that are highest at their low end settle it; they are picked in every task before anything is shuffled
    highest = Window.partitionBy("lo").orderBy(F.col("low").desc(), "path", "rg")
    upper = stats.where(pure).select("lo", "low", "rows", "path", "rg").withColumn("_n", F.row_number().over(highest)).where(F.col("_n") <= n)
    reach = highest.rowsBetween(Window.unboundedPreceding, 0)
    floor = upper.withColumn("_have", F.sum("rows").over(reach)).where(F.col("_have") >= n).groupBy("lo").agg(F.max("low").alias("_floor"))
    wanted = stats.join(broadcast_if_small(floor, max_files_listed), "lo", "left").where(~F.coalesce(pure & (F.col("top") < F.col("_floor")), F.lit(False)))
    kind = T.StructType([T.StructField("g", T.StringType()), T.StructField("s", T.DoubleType()), T.StructField("t", T.LongType()), T.StructField("k", df.schema[key].dataType)])
    # neighbouring row groups go to one task, so that a group's later ones can be skipped; a large group still has many tasks,
    # and the tasks are numbered, as row groups are worth far more than the few bytes that name them
    tasks = all_cores(spark, stats.count(), TASK_ROW_GROUPS)
    found = wanted.select("path", "rg", "lo", "hi", "top").repartition(tasks, F.col("path"), F.floor(F.col("rg") / NEIGHBOURS)).mapInPandas(_reader(n), kind)
    last = Window.partitionBy("g").orderBy(*order[1:])
    return found.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= n).select(F.col("g").alias(group), F.col("k").alias(key))


def current_top_hits(hits: DataFrame, n: int = 10) -> DataFrame:
    """``(qid, hit_id)``: of each hit its last delivery, of those the ``n`` best of each query."""
    now = latest_rows(hits, "hit_id", "loaded_at", ["score", "match_len", "qid"])
    return top_n(now, "qid", "score", "match_len", "hit_id", n)

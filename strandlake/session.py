"""Session settings, the shared scratch folder and checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Settings that suit the operators of this library; a cluster's own values win where they are set.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.enableVectorizedReader": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session with this library's defaults; ``extra`` uses ``__`` for dots in setting names."""
    builder = SparkSession.builder.master(master).appName("strandlake")
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in (settings | {k.replace("__", "."): v for k, v in extra.items()}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they need no path of their own to it."""
    context, home = spark.sparkContext, os.path.dirname(os.path.abspath(__file__))
    if getattr(context, "_strandlake_sent", False) or not os.path.isdir(home):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="strandlake-"), "strandlake.zip")  # read by the driver only
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(home)))
    context.addPyFile(archive)
    context._strandlake_sent = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or one set here where it is unset (local runs)."""
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is deleted when the application ends."""
    path = f"{shared_dir(spark)}/strandlake/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back. Losing an executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """:func:`cut`, with aggregates (longs; null counts as 0) that are taken while the table is written, so they cost no job of their own.

    A task that runs again can be counted again: good for "nothing changed" and for sizes, not for exact totals.
    """
    seen = Observation()
    out = cut(df.observe(seen, *(c.alias(k) for k, c in counts.items())), name)
    return out, {k: seen.get.get(k) or 0 for k in counts}


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than it must."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """A broadcast hint behind a check of the row count; beyond it the join shuffles as usual (and splits skew by AQE)."""
    return F.broadcast(df) if small_enough(df, max_rows) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Delivered hits and embeddings as tables: readers and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.schema import OUTPUT

#: Spaces at the ends of a consensus string count, so they must outlive the file.
CSV = {"sep": ";", "header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: A file is read by one task, since a line end may lie inside a field; so files are kept to some 100 MB.
FILE_ROWS = 400_000


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """A ``;`` file of delivered hits, or a folder of them. Empty fields are null: an empty text isn't told from a missing one.

    Quoted fields may hold line ends, so a file isn't split: it is streamed by one task, folders are read file by file.
    """
    return spark.read.csv(path, schema=OUTPUT, multiLine=True, **CSV)


def write_hits(rows: DataFrame, path: str, separate: bool = False, one_file: bool = False) -> None:
    """``;`` files with a header; ``separate``: a folder per query. Line ends inside a field are quoted, for readers that take several lines as one row."""
    out = rows.repartition("qid") if separate else rows.coalesce(1) if one_file else rows
    writer = out.write.mode("overwrite").options(**CSV, maxRecordsPerFile=0 if one_file else FILE_ROWS)
    (writer.partitionBy("qid") if separate else writer).csv(path)


def write_json_lines(results: DataFrame, path: str) -> None:
    """One JSON object per query and line, keyed by the query."""
    results.select(F.concat(F.lit('{"'), F.col("queryid").cast("string"), F.lit('": '), F.col("result"), F.lit("}")).alias("value")).write.mode("overwrite").text(path)


def write_residues(residues: DataFrame, path: str, buckets: int = 64) -> None:
    """Residue vectors as Parquet, all residues of a sequence in one bucket folder."""
    bucketed = residues.withColumn("bucket", F.pmod(F.xxhash64("run_index"), F.lit(buckets)))
    bucketed.repartition("bucket").sortWithinPartitions("run_index", "pos").write.mode("append").partitionBy("bucket").parquet(path)


def read_residues(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("run_index", "pos", "vec")


def write_report(lines: DataFrame, path: str, title: str) -> None:
    """The text report of :func:`strandlake.operators.tools.report_lines`: the title, all headers, then all alignments, in order."""
    top = lines.sparkSession.range(1).select(F.lit(0).alias("_s"), F.lit(0).cast("long").alias("index"), F.lit(title).alias("value"))
    parts = [lines.select(F.lit(k).alias("_s"), F.col("index").cast("long").alias("index"), F.col(c).alias("value")) for k, c in ((1, "header"), (2, "body"))]
    top.unionByName(parts[0]).unionByName(parts[1]).orderBy("_s", "index").select("value").write.mode("overwrite").text(path)

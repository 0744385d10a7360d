"""Sequence indexes: FASTA, CSV, Parquet; positions and id fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.session import broadcast_if_small

#: The order in which index files are looked for.
SUFFIXES = [".csv", ".p", ".pkl", ".fas", ".fasta"]


def find_index(spark: SparkSession, path: str) -> str:
    """The first existing index file for ``path``, or ``path`` itself."""
    for suffix in ["", *SUFFIXES, ".parquet"]:
        hpath = spark._jvm.org.apache.hadoop.fs.Path(path + suffix)
        fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(hpath) and (suffix or path.endswith((*SUFFIXES, ".parquet"))):
            return path + suffix
    return path


def number_rows(df: DataFrame, name: str = "run_index") -> DataFrame:
    """Positions ``0 .. n-1`` in the order of ``df``'s partitions, which is file order for a scan; no sort, no shuffle of the rows."""
    at = df.withColumn("_m", F.monotonically_increasing_id())
    part, local = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    counts = at.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    base = counts.withColumn("_b", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_b")  # one row per partition
    return at.withColumn("_p", part).join(broadcast_if_small(base), "_p").withColumn(name, F.col("_b") + local).drop("_m", "_p", "_b")


def read_fasta(spark: SparkSession, path: str, id_mode: str = "token", number: bool = True) -> DataFrame:
    """``(run_index, id, description, sequence)`` of a FASTA file or folder.

    ``id`` is the header's first word (``id_mode="token"``; sequences in upper case) or the whole header
    (``id_mode="header"``; sequences as they are). White space inside a sequence is dropped; text before the first
    header and records without a header are left out.
    """
    text = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    # only the first record of a file keeps its ">"
    body = F.regexp_replace("value", r"^\s*>", "")
    head = F.trim(F.regexp_replace(F.substring_index(body, "\n", 1), "\r", ""))
    rest = F.regexp_replace(F.when(F.instr(body, "\n") > 0, F.substring(body, F.instr(body, "\n") + 1, F.length(body))).otherwise(""), r"\s", "")
    token = F.regexp_extract(head, r"^(\S+)", 1)
    rows = text.select(
        (token if id_mode == "token" else head).alias("id"),
        head.alias("description"),
        (F.upper(rest) if id_mode == "token" else rest).alias("sequence"),
    ).where(F.col("id") != "")
    return number_rows(rows).select("run_index", "id", "description", "sequence") if number else rows


def write_fasta(df: DataFrame, path: str, id_col: str = "id", description: str | None = None, sequence: str = "sequence", by: str | None = None) -> None:
    """One record per row: the header is the id and, if given, the description; with ``by``, a folder per value of that column."""
    head = F.col(id_col) if description is None else F.concat_ws(" ", id_col, description)
    records = df.where(F.col(sequence).isNotNull()).select(F.concat(F.lit(">"), head, F.lit("\n"), F.col(sequence)).alias("value"), *([by] if by else []))
    (records.repartition(by).write.partitionBy(by) if by else records.write).text(path)


def read_index(spark: SparkSession, path: str, cname: str = "sequence", sep: str = ",") -> DataFrame:
    """An index from FASTA, CSV or Parquet, by suffix: ``cname`` becomes ``sequence``, ``run_index`` counts the rows, ids fall back to it."""
    path = find_index(spark, path)
    if path.endswith((".fas", ".fasta")):
        return with_unique_ids(read_fasta(spark, path))
    if path.endswith(".parquet"):
        rows = spark.read.parquet(path)
    elif path.endswith(".csv"):
        rows = spark.read.csv(path, header=True, sep=sep, multiLine=False)
    else:
        raise ValueError(f"no reader for {path}")
    if cname not in rows.columns:
        raise ValueError(f"{path} has no column {cname}")
    if cname != "sequence":
        rows = rows.drop("sequence").withColumnRenamed(cname, "sequence")
    if "run_index" not in rows.columns:
        rows = number_rows(rows)
    if "description" not in rows.columns:
        rows = rows.withColumn("description", F.lit("na"))
    return with_unique_ids(rows)


def with_unique_ids(index: DataFrame) -> DataFrame:
    """Ids as they are if none is null or repeated, else ``run_index`` as id for all rows."""
    if "id" not in index.columns:
        return index.withColumn("id", F.col("run_index").cast("string"))
    bad = index.where("id is null").select(F.lit(1)).unionByName(index.groupBy("id").count().where("count > 1").select(F.lit(1)))
    return index.withColumn("id", F.col("run_index").cast("string")) if bad.take(1) else index


def is_index_valid(index: DataFrame, column: str = "run_index") -> bool:
    """Whether the column is an integer, without nulls and without repeats."""
    if dict(index.dtypes)[column] not in ("tinyint", "smallint", "int", "bigint"):
        return False
    return not index.where(F.col(column).isNull()).take(1) and not index.groupBy(column).count().where("count > 1").take(1)


def sequence_length(seqlens: Column, seq: Column) -> Column:
    return F.coalesce(seqlens, F.length(seq))


def store_files(index: DataFrame, folder: str) -> DataFrame:
    """Where the embedding of each sequence lies in a folder of one file per sequence."""
    return index.withColumn("file", F.concat(F.lit(folder.rstrip("/") + "/"), F.col("run_index").cast("string"), F.lit(".emb")))


def missing_embeddings(index: DataFrame, residues: DataFrame) -> DataFrame:
    """Sequences of the index without any residue vector; a complete store gives no row."""
    return index.join(residues.select("run_index").distinct(), "run_index", "left_anti")

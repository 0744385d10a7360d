"""Consolidating millions of tiny files into few well-sized ones.

The consolidated store is a Parquet folder partitioned by ``part_id`` and ``write``. A part holds the records of some
directories, about ``target_bytes`` together; a larger directory has parts of its own. Where a directory lies is decided
once and kept (its placement); if it outgrows its parts, or its part outgrows the target, it is placed anew, and the parts
that held it are rewritten in the same change. Only parts with more small files than allowed are rewritten (dynamic
partition overwrite), all others are left alone.

Each change is a numbered snapshot: a manifest of the writes that count in each part, and the placement. A change writes
under a name of its own and touches nothing that a reader or another writer sees; it counts from the moment its version's file is
created, which only one of several writers can do (this needs a file system whose exclusive creation is exclusive, as HDFS
has; not every object store does). Before that the version and the files that were read are checked. A writer that dies leaves
files that no manifest names, and at most an empty version file, which gives way after ``CLAIM_SECONDS``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.operators.ranking import totals_before
from strandlake.session import cut, cut_counted

RECORD = ["dir", "run_index"]
STORED = ["dir", "run_index", "file_id", "size_bytes", "modified_at", "payload"]
CONTENT = "dir string, run_index long, file_id long, size_bytes long, modified_at timestamp_ntz, payload binary"
MANIFEST = "part_id long, write string, files long, small long, bytes long"
PLACEMENT = "dir string, first long, fan long, held long"
CLAIM_SECONDS = 600
#: A directory or part is placed anew beyond so many times its target.
OVERFULL = 2
#: Tasks of a rewrite at most.
MOST_TASKS = 20_000


class SnapshotConflict(RuntimeError):
    """Another writer changed the store since it was read."""


@dataclass(frozen=True)
class CompactionReport:
    version: int
    parts_rewritten: int
    files_before: int
    files_after: int


def normal_dir(path: Column) -> Column:
    """A directory without its empty and ``.`` segments; null stays null."""
    return F.array_join(F.filter(F.split(path, "/"), lambda s: (s != "") & (s != ".")), "/")


def good_copy(ext: str = ".emb") -> Column:
    """Complete copies: the right extension and a payload of exactly the announced, positive size. Null in any of them: not good."""
    return F.coalesce((F.col("ext") == ext) & (F.col("size_bytes") > 0) & (F.octet_length("payload") == F.col("size_bytes")), F.lit(False))


def best_copies(copies: DataFrame) -> DataFrame:
    """``(dir, run_index, modified_at, file_id, size_bytes)``: one copy per record, modified last (null first of all), then the greatest ``file_id``. Pre-aggregated, without payloads."""
    best = copies.groupBy(*RECORD).agg(F.max(F.struct("modified_at", "file_id", "size_bytes")).alias("_b"))
    return best.select(*RECORD, "_b.modified_at", "_b.file_id", "_b.size_bytes")


def latest_copy(df: DataFrame) -> DataFrame:
    """:func:`best_copies` with all columns; needs ``part_id`` beside the record."""
    w = Window.partitionBy("part_id", *RECORD).orderBy(F.col("modified_at").desc_nulls_last(), F.col("file_id").desc_nulls_last())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# --- snapshots -----------------------------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()), hpath


def _read_text(spark: SparkSession, path: str) -> str:
    fs, hpath = _fs(spark, path)
    stream = fs.open(hpath)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _create_new(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that mustn't exist yet; of several writers only one succeeds. An empty one that was left behind gives way."""
    fs, hpath = _fs(spark, path)
    if fs.exists(hpath):
        status = fs.getFileStatus(hpath)
        if status.getLen() == 0 and status.getModificationTime() < (time.time() - CLAIM_SECONDS) * 1000:
            fs.delete(hpath, False)
    try:
        stream = fs.create(hpath, False)
    except Exception as e:
        raise SnapshotConflict(f"{path} was created by another writer") from e
    stream.write(bytearray(text.encode()))
    stream.close()


def _versions(spark: SparkSession, store: str) -> list[int]:
    fs, hpath = _fs(spark, f"{store}/snapshots")
    if not fs.exists(hpath):
        return []
    return sorted(int(s.getPath().getName()[1:-5]) for s in fs.listStatus(hpath) if s.getPath().getName().endswith(".json") and s.getLen())


def current_snapshot(spark: SparkSession, store: str) -> dict:
    """The last committed snapshot; version 0 for a new store."""
    done = _versions(spark, store)
    if not done:
        return {"version": 0, "write": None, "open_part": 0, "open_bytes": 0, "next_part": 1, "files": 0, "writes": 0, "parts": 0, "directories": 0}
    return json.loads(_read_text(spark, f"{store}/snapshots/v{done[-1]:08d}.json"))


def _state(spark: SparkSession, store: str, snapshot: dict, kind: str, schema: str) -> DataFrame:
    if snapshot["write"] is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{store}/state/{snapshot['write']}/{kind}")


def _listed(spark: SparkSession, store: str, glob: str = "write=*") -> DataFrame:
    """``(part_id, write, path, bytes, at)`` of data files, listed by Spark."""
    fs, hpath = _fs(spark, f"{store}/data/part_id=*/{glob}")
    found = fs.globStatus(hpath)
    if not found:
        return spark.createDataFrame([], "part_id long, write string, path string, bytes long, at timestamp")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{store}/data/part_id=*/{glob}")
    part, write = F.regexp_extract("path", r"part_id=(\d+)", 1).cast("long"), F.regexp_extract("path", r"write=([^/]+)", 1)
    return files.select(part.alias("part_id"), write.alias("write"), "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("at"))


def part_files(spark: SparkSession, store: str) -> DataFrame:
    """``(part_id, path, bytes)`` of every data file that counts in the current snapshot."""
    live = _state(spark, store, current_snapshot(spark, store), "manifest", MANIFEST)
    return _listed(spark, store).join(live.select("part_id", "write"), ["part_id", "write"], "left_semi").select("part_id", "path", "bytes")


def _small(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """A broadcast hint for a table whose rows are counted already."""
    return F.broadcast(df) if rows <= most else df


def _content(spark: SparkSession, store: str, live: DataFrame, writes: int) -> DataFrame:
    """The rows of the writes in ``live`` (``writes`` at most), with ``part_id``. Copies of one record may be among them."""
    fs, hpath = _fs(spark, f"{store}/data")
    if not writes or not fs.exists(hpath):
        return spark.createDataFrame([], CONTENT + ", part_id long")
    data = spark.read.schema(CONTENT + ", part_id long, write string").parquet(f"{store}/data")
    return data.join(_small(live.select("part_id", "write"), writes), ["part_id", "write"], "left_semi").select(*STORED, "part_id")


# --- placement -----------------------------------------------------------------------------------------------------


def _same(a: str, b: str, *columns: str) -> list[Column]:
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns]


def place(rows: DataFrame, placement: DataFrame, directories: int) -> DataFrame:
    """Add ``part_id``: the directory's part, or one of its parts by the record. The placement has so many ``directories``."""
    joined = rows.alias("r").join(_small(placement, directories).alias("p"), _same("r", "p", "dir"))
    return joined.select("r.*", (F.col("p.first") + F.pmod(F.xxhash64("r.run_index"), F.col("p.fan"))).alias("part_id"))


def _placed_anew(spark: SparkSession, snapshot: dict, placement: DataFrame, best: DataFrame, target: int, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """The placement with the arrivals (written to ``path``), the parts that lose a directory, and where the next ones go.

    Small directories fill the open part and then new ones, in their order; a large one gets ``fan`` new parts. Both follow
    from running totals over all directories that need a place. A total that was counted twice by a task that ran again only leaves
    numbers of parts unused.
    """
    added = best.groupBy("dir").agg(F.sum("size_bytes").alias("added"))
    both = added.alias("a").join(_small(placement, snapshot["directories"]).alias("p"), _same("a", "p", "dir"), "full")
    known = both.select(F.coalesce("a.dir", "p.dir").alias("dir"), "first", "fan", (F.coalesce("held", F.lit(0)) + F.coalesce("added", F.lit(0))).alias("held"))
    crowds = known.where("fan = 1").groupBy("first").agg(F.sum("held").alias("_h"), F.count("*").alias("_d")).where((F.col("_h") > OVERFULL * target) & (F.col("_d") > 1)).select("first", F.lit(True).alias("_over"))
    moves = F.col("first").isNull() | (F.col("held") > OVERFULL * target * F.col("fan")) | ((F.col("fan") == 1) & F.coalesce("_over", F.lit(False)))
    parts = F.when(F.col("held") > target, F.ceil(F.col("held") / target)).otherwise(0)
    marked = known.join(crowds, "first", "left").select("dir", "first", "fan", "held", moves.alias("_moves"), parts.alias("_fan"))
    taken = {"n": F.count(F.lit(1)), "bytes": F.sum(F.when(F.col("_moves") & (F.col("_fan") == 0), F.col("held"))), "fans": F.sum(F.when(F.col("_moves"), F.col("_fan"))), "moved": F.count_if("_moves")}
    marked, sums = cut_counted(marked, "placement", **taken)
    after = {**snapshot, "directories": sums["n"]}
    kept, left = marked.where("not _moves").select("dir", "first", "fan", "held"), spark.createDataFrame([], "part_id long")
    if sums["moved"]:
        moved = marked.where("_moves")
        left = moved.where("first is not null").select(F.explode(F.sequence("first", F.col("first") + F.col("fan") - 1)).alias("part_id")).distinct()
        # one order for both: a small directory counts by its bytes, a large one by its parts
        laid = totals_before(moved.select("dir", "held", "_fan"), ["dir"], {"_bytes": F.when(F.col("_fan") == 0, F.col("held")).otherwise(0), "_fans": F.col("_fan")})
        step = F.floor((F.lit(snapshot["open_bytes"]) + F.col("_bytes")) / target)
        opened = (snapshot["open_bytes"] + sums["bytes"]) // target
        next_part = snapshot["next_part"] + opened
        first = F.when(F.col("_fan") > 0, F.lit(next_part) + F.col("_fans")).when(step == 0, F.lit(snapshot["open_part"])).otherwise(snapshot["next_part"] + step - 1)
        kept = kept.unionByName(laid.select("dir", first.cast("long").alias("first"), F.greatest(F.col("_fan"), F.lit(1)).cast("long").alias("fan"), "held"))
        after |= {"open_part": snapshot["next_part"] + opened - 1 if opened else snapshot["open_part"], "open_bytes": (snapshot["open_bytes"] + sums["bytes"]) % target, "next_part": next_part + sums["fans"]}
    kept.write.parquet(path)
    return spark.read.schema(PLACEMENT).parquet(path), left, after


# --- compaction ----------------------------------------------------------------------------------------------------


def compact(
    spark: SparkSession,
    store: str,
    arrivals: DataFrame | None = None,
    *,
    target_bytes: int = 128 << 20,
    small_bytes: int = 32 << 20,
    max_small_files: int = 1,
    ext: str = ".emb",
) -> CompactionReport:
    """Take ``arrivals`` (one row per tiny file) into the store and rewrite each part that then has more than ``max_small_files`` files below ``small_bytes``.

    A record is a directory (compared without empty and ``.`` segments) and a ``run_index``; only good copies count and
    the one modified last stays, see :func:`good_copy` and :func:`best_copies`. Parts at or below the limit get their
    arrivals appended; :func:`read_store` resolves copies there. The copy of each arriving record is chosen over all cores
    without the payloads, which are shuffled once, to their parts.

    Defined results: an empty table leaves an empty store; a null directory or ``run_index`` is a value of its own;
    repeated rows are one copy; other columns, of any name, are not stored.
    """
    before = current_snapshot(spark, store)
    write = f"w{before['version'] + 1}-{uuid.uuid4().hex[:12]}"
    manifest, placement = (_state(spark, store, before, *kind) for kind in (("manifest", MANIFEST), ("placement", PLACEMENT)))
    leaving, after = spark.createDataFrame([], "part_id long"), before
    small = manifest.groupBy("part_id").agg(F.sum("small").alias("n"))
    good = best = None
    if arrivals is not None:
        good = arrivals.select("embeddingpath", "run_index", "file_id", "ext", "size_bytes", "modified_at", "payload").where(good_copy(ext))
        good = good.withColumn("dir", normal_dir(F.col("embeddingpath"))).select(*STORED)
        best, counts = cut_counted(best_copies(good), "best", n=F.count(F.lit(1)))
        if counts["n"]:
            placement, leaving, after = _placed_anew(spark, before, placement, best, target_bytes, f"{store}/state/{write}/placement")
            best = place(best, placement, after["directories"])
            small = small.unionByName(best.where(F.col("size_bytes") < small_bytes).groupBy("part_id").agg(F.count("*").alias("n")))
        else:
            best = None
    crowded = small.groupBy("part_id").agg(F.sum("n").alias("n")).where(F.col("n") > max_small_files).select("part_id")
    rewrite, n_rewrite = cut_counted(crowded.unionByName(leaving).distinct(), "rewrite", n=F.count(F.lit(1)))
    n_rewrite = n_rewrite["n"]
    if not n_rewrite and best is None:
        return CompactionReport(before["version"], 0, before["files"], before["files"])
    if best is None:
        placement.write.parquet(f"{store}/state/{write}/placement")

    chosen_parts = _small(rewrite, n_rewrite)
    old = manifest.join(chosen_parts, "part_id", "left_semi")
    sources = [place(_content(spark, store, old, before["writes"]).drop("part_id"), placement, after["directories"])]
    parts = n_rewrite
    if best is not None:
        # copies that aren't the best one of their record go no further; equal rows still do
        winners = _small(best.select(*RECORD, "file_id", "modified_at", "part_id"), counts["n"])
        sources.append(good.alias("r").join(winners.alias("b"), _same("r", "b", *RECORD, "file_id", "modified_at")).select("r.*", "b.part_id"))
        parts = max(parts, min(after["next_part"], counts["n"]))
    whole = sources[0] if len(sources) == 1 else sources[0].unionByName(sources[1])
    # one shuffle for the choice of the copy and for the layout; more tasks than parts, so that few tasks have several. Beyond
    # MOST_TASKS they have, and write them one after the other
    placed = latest_copy(whole.repartition(min(4 * parts, MOST_TASKS), "part_id")).withColumn("write", F.lit(write))
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part_id", "write").parquet(f"{store}/data")

    new = _listed(spark, store, f"write={write}").groupBy("part_id", "write").agg(F.count("*").alias("files"), F.count_if(F.col("bytes") < small_bytes).alias("small"), F.sum("bytes").alias("bytes"))
    manifest.join(chosen_parts, "part_id", "left_anti").unionByName(new).write.parquet(f"{store}/state/{write}/manifest")
    totals = _state(spark, store, {"write": write}, "manifest", MANIFEST).agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.count("*").alias("writes"), F.countDistinct("part_id").alias("parts")).first()
    if current_snapshot(spark, store)["version"] != before["version"] or (before["writes"] and _changed(spark, store, old)):
        raise SnapshotConflict(f"the store moved on from version {before['version']}")
    version = before["version"] + 1
    _create_new(spark, f"{store}/snapshots/v{version:08d}.json", json.dumps({**after, **totals.asDict(), "version": version, "write": write}))
    return CompactionReport(version, n_rewrite, before["files"], totals["files"])


def _changed(spark: SparkSession, store: str, read: DataFrame) -> bool:
    """Whether the files that were read aren't those of the manifest any more."""
    found = _listed(spark, store).groupBy("part_id", "write").agg(F.count("*").alias("_f"), F.sum("bytes").alias("_b"))
    return bool(read.join(found, ["part_id", "write"], "left").where(~(F.col("files").eqNullSafe(F.col("_f")) & F.col("bytes").eqNullSafe(F.col("_b")))).head(1))


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """Every record of the current snapshot once, without ``part_id``. Changes that are committed later don't show, until :func:`vacuum` drops what they replaced."""
    now = current_snapshot(spark, store)
    live = _state(spark, store, now, "manifest", MANIFEST)
    if now["writes"] == now["parts"]:  # each record stands once
        return _content(spark, store, live, now["writes"]).drop("part_id")
    several = live.groupBy("part_id").agg(F.count("*").alias("_w")).where("_w > 1").select("part_id")
    whole = _content(spark, store, live.join(several, "part_id", "left_anti"), now["writes"])
    return whole.unionByName(latest_copy(_content(spark, store, live.join(several, "part_id", "left_semi"), now["writes"]))).drop("part_id")


def vacuum(spark: SparkSession, store: str, keep: int = 2, least_age_seconds: int = 86_400) -> int:
    """Delete the files that none of the last ``keep`` snapshots names and that are older than ``least_age_seconds`` (writers may be at work on younger ones); gives their number."""
    live = None
    for v in _versions(spark, store)[-keep:]:
        own = _state(spark, store, json.loads(_read_text(spark, f"{store}/snapshots/v{v:08d}.json")), "manifest", MANIFEST).select("part_id", "write")
        live = own if live is None else live.unionByName(own)
    if live is None:
        return 0
    gone = _listed(spark, store).where(F.col("at") <= F.current_timestamp() - F.make_interval(secs=F.lit(least_age_seconds)))
    gone = cut(gone.join(live.distinct(), ["part_id", "write"], "left_anti").select("path"), "vacuum")

    def delete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for path in batch["path"]:
                place, inner = fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
                if place.get_file_info(inner).type != fs.FileType.NotFound:  # a task may run again
                    place.delete_file(inner)
            yield pd.DataFrame({"n": [len(batch)]})

    return gone.mapInPandas(delete, "n long").agg(F.sum("n")).first()[0] or 0

"""Command line: ``search``, ``embed``, ``merge``, ``report``, ``split``, ``pool``, ``lanes``."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandlake.operators.batching import prepare_sequences, split_by_length
from strandlake.operators.embed import Embedder, HashEmbedder, embed
from strandlake.operators.screen import pooled, screen, screen_json
from strandlake.operators.tools import REPORT_TITLE, merge_chains, pack_lanes, plot_rows, report_lines, top_hits
from strandlake.params import AlignParams, ScreenParams
from strandlake.plans.search import search
from strandlake.session import build_session
from strandlake.sources.sequences import is_index_valid, read_index, store_files, write_fasta
from strandlake.sources.tables import read_hits, read_residues, write_hits, write_json_lines, write_report, write_residues


def within(kind: type, low: float, high: float):
    """Type of an argument that is at least ``low`` and below ``high``."""

    def read(text: str):
        value = kind(text)
        if not low <= value < high:
            raise argparse.ArgumentTypeError(f"must be at least {low} and below {high}")
        return value

    return read


def embedder(name: str) -> Callable[[], Embedder]:
    """A maker of embedders: ``hash``, the stand-in, or ``module:callable``, which Python can import on the driver and the workers."""
    if name == "hash":
        return HashEmbedder
    module, _, made = name.partition(":")
    if not made:
        raise argparse.ArgumentTypeError("must be 'hash' or 'module:callable'")
    return getattr(importlib.import_module(module), made)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandlake")
    sub = top.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search", help="search queries in a database")
    s.add_argument("db"), s.add_argument("query"), s.add_argument("output")
    s.add_argument("--separate", action="store_true"), s.add_argument("--raw", action="store_true"), s.add_argument("--enh", action="store_true")
    s.add_argument("--reduce-duplicates", action="store_true"), s.add_argument("--only-scan", action="store_true"), s.add_argument("--global-aln", action="store_true")
    positive = within(int, 1, float("inf"))
    for name, kind, value in (
        ("cpc", within(float, 0, 100), 70.0), ("cpc-kernel-size", positive, 30), ("cpc-stride", positive, 10), ("alignment-cutoff", within(float, 0, 1), 0.3), ("win", within(int, 1, 50), 15),
        ("span", positive, 25), ("gap-ext", within(float, 0, float("inf")), 0.5), ("bfactor", positive, 2), ("sigma-factor", float, 2.0),
    ):
        s.add_argument(f"--{name}", type=kind, default=value)
    e = sub.add_parser("embed", help="embed an index; done sequences are skipped, so it may be repeated")
    e.add_argument("input"), e.add_argument("output"), e.add_argument("--cname", default="sequence"), e.add_argument("--truncate", type=positive, default=1000)
    e.add_argument("--batch-size", type=positive, default=32), e.add_argument("--embedder", type=embedder, default="hash")
    m = sub.add_parser("merge", help="merge chains of hits and keep the best")
    m.add_argument("csv"), m.add_argument("new_csv"), m.add_argument("--score", type=float), m.add_argument("--max-hits", type=int, default=0), m.add_argument("--skip-merge", action="store_true")
    r = sub.add_parser("report", help="text report of hits")
    r.add_argument("csv"), r.add_argument("output")
    p = sub.add_parser("pool", help="write pooled vectors of a database")
    p.add_argument("db"), p.add_argument("output")
    f = sub.add_parser("split", help="split a FASTA file by length")
    f.add_argument("input"), f.add_argument("prefix"), f.add_argument("--chunk", type=int, default=1000), f.add_argument("--max-length", type=int, default=3500)
    n = sub.add_parser("lanes", help="lanes of a drawing of hits")
    n.add_argument("csv"), n.add_argument("output"), n.add_argument("--score", type=float, default=0.0), n.add_argument("--maxseqs", type=int, default=0), n.add_argument("--by", choices=["score", "qend"], default="score")
    return top


def run_search(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.span < a.win and not a.only_scan:
        raise SystemExit("--span must be at least --win")
    if a.reduce_duplicates and a.query != a.db:
        raise SystemExit("--reduce-duplicates needs the database as the query")
    index = {k: read_index(spark, v) for k, v in (("db", a.db), ("query", a.query))}
    vectors = {k: read_residues(spark, f"{v}.emb.parquet") for k, v in (("db", a.db), ("query", a.query))}
    screening = ScreenParams(a.cpc, a.cpc_kernel_size, a.cpc_stride, only_scan=a.only_scan)
    if a.only_scan:
        pairs = screen(vectors["query"], vectors["db"], screening, symmetric=a.reduce_duplicates)
        write_json_lines(screen_json(pairs, store_files(index["db"], a.db)), a.output)
        return
    params = AlignParams(a.win, a.span, a.gap_ext, 0 if a.global_aln else a.bfactor, a.sigma_factor, a.enh or a.reduce_duplicates)
    hits = search(index["query"], vectors["query"], index["db"], vectors["db"], params, screening, a.alignment_cutoff, a.reduce_duplicates, a.raw)
    if a.raw:
        hits.write.mode("overwrite").parquet(a.output)
    else:
        write_hits(hits, a.output, separate=a.separate)


def run_embed(spark: SparkSession, a: argparse.Namespace) -> None:
    index = prepare_sequences(read_index(spark, a.input, a.cname), a.truncate)
    if not is_index_valid(index):
        raise SystemExit("the index isn't unique")
    hpath = spark._jvm.org.apache.hadoop.fs.Path(f"{a.output}.emb.parquet")
    there = hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath)
    done = read_residues(spark, f"{a.output}.emb.parquet") if there else None
    write_residues(embed(index, a.embedder, done, a.batch_size), f"{a.output}.emb.parquet")
    index.drop("seqlen").write.mode("overwrite").option("header", True).csv(f"{a.output}.csv")


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or build_session("local[*]")
    if a.command == "search":
        run_search(spark, a)
    elif a.command == "embed":
        run_embed(spark, a)
    elif a.command == "merge":
        rows = read_hits(spark, a.csv)
        rows = rows if a.score is None else rows.where(F.col("score") >= a.score)
        write_hits(top_hits(rows if a.skip_merge else merge_chains(rows), a.max_hits), a.new_csv)
    elif a.command == "report":
        write_report(report_lines(top_hits(read_hits(spark, a.csv))), a.output, REPORT_TITLE)
    elif a.command == "pool":
        pooled(read_residues(spark, f"{a.db}.emb.parquet")).write.mode("overwrite").parquet(a.output)
    elif a.command == "split":
        parts = split_by_length(prepare_sequences(read_index(spark, a.input), 1 << 30), a.chunk, a.max_length)
        write_fasta(parts, a.prefix, by="part")
    elif a.command == "lanes":
        rows = read_hits(spark, a.csv).withColumn("hit_id", F.monotonically_increasing_id())
        pack_lanes(plot_rows(rows, a.score, a.maxseqs), a.by).write.mode("overwrite").parquet(a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

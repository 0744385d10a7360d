"""Registered queries of the core. Their SQL is in :mod:`strandlake.plans.oracle`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.residues import alignment_rates, html_alignment
from strandlake.functions.udfs import register
from strandlake.functions.vectors import cosine, dimension_sums
from strandlake.operators import align, batching, hits, output, score, screen, tools
from strandlake.operators.compaction import compact, read_store
from strandlake.operators.embed import HashEmbedder, embed
from strandlake.operators.ranking import spread
from strandlake.operators.split_values import one_per_key, split_values
from strandlake.params import AlignParams, ScreenParams
from strandlake.plans.fixtures import fixture
from strandlake.plans.oracle import SQL  # noqa: F401
from strandlake.plans.search import search
from strandlake.session import scratch_path, table
from strandlake.sources import sequences, tables
from strandlake.streaming.search import stream_search, stream_window_counts

PARAMS = AlignParams(window=3, min_span=3, gap=0.5, bfactor=2, sigma=1.0, filter_hits=False)
KERNEL, STRIDE, QUANTILE = 10, 5, 0.7
FLAT = ["queryid", "dbid", "pathid", "spanid", "span_start", "span_end", "y1", "x1", "y2", "x2", "score", "len"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sequence once, with the length that is announced or found."""
    rows = table(spark, sf_dir, "seqindex").dropDuplicates(["run_index"])
    return rows.withColumn("seqlen", sequences.sequence_length(F.col("seqlens"), F.col("seq")))


def _matrices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    fx = fixture(spark, sf_dir)
    return fx.pairs, fx.queries, fx.targets


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = fixture(spark, sf_dir)
    return align.path_cells(fx.pairs, fx.queries, fx.targets, PARAMS)


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = fixture(spark, sf_dir)
    return align.align_pairs(fx.pairs, fx.queries, fx.targets, PARAMS)


def _flat(found: DataFrame) -> DataFrame:
    last = F.element_at("indices", -1)
    return found.withColumns({"y2": last["y"], "x2": last["x"], "score": F.round("score", 6)}).select(*FLAT)


# --- scores --------------------------------------------------------------------------------------------------------


@query
def residue_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan without Python."""
    fx = fixture(spark, sf_dir)
    return score.residue_pairs(fx.pairs, fx.queries, fx.targets).withColumn("c", F.round("c", 6))


@query
def path_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.path_mask(_paths(spark, sf_dir))


@query
def signal_enhancement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.enhanced_cells(*_matrices(spark, sf_dir)).withColumn("c", F.round("c", 5))


@query
def global_znorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.normal_cells(*_matrices(spark, sf_dir)).withColumn("c", F.round("c", 5))


@query
def score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.score_cells(*_matrices(spark, sf_dir)).select("queryid", "dbid", "y", "x", F.round("h", 5).alias("h"))


@query
def best_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.best_cells(*_matrices(spark, sf_dir)).withColumn("max_h", F.round("max_h", 5))


@query
def best_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.best_diagonals(*_matrices(spark, sf_dir)).withColumn("best", F.round("best", 5))


@query
def border_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.start_cells(*_matrices(spark, sf_dir), PARAMS.min_span, PARAMS.bfactor).withColumn("h", F.round("h", 5))


@query
def traceback_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).withColumn("c", F.round("c", 6))


@query
def moving_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = score.moving_mean(_paths(spark, sf_dir), PARAMS.window, ["queryid", "dbid", "pathid"], "k", "c")
    return means.select("queryid", "dbid", "pathid", "k", F.round("m", 6).alias("m"))


@query
def alignment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["queryid", "dbid", "pathid"]
    means = score.moving_mean(_paths(spark, sf_dir), PARAMS.window, keys, "k", "c")
    return score.runs_above(means, PARAMS.threshold, keys, "k")


@query
def local_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_hits(spark, sf_dir))


@query
def filtered_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(hits.filter_hits(_hits(spark, sf_dir)))


@query
def global_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = fixture(spark, sf_dir)
    return _flat(align.align_pairs(fx.pairs, fx.queries, fx.targets, AlignParams(3, 3, 0.5, 0, 1.0)))


@query
def overlap_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.overlap(_hits(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query
def unique_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(hits.unique_hits(_hits(spark, sf_dir)))


@query
def truth_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best hits against the residues that both sequences really share."""
    fx = fixture(spark, sf_dir)
    best = _hits(spark, sf_dir).groupBy("queryid", "dbid").agg(F.max_by("indices", F.struct(F.round("score", 9), "len", "pathid", "spanid")).alias("_i"))
    found = best.select("queryid", "dbid", F.posexplode("_i").alias("k", "_c")).select("queryid", "dbid", "k", F.col("_c.y").alias("y"), F.col("_c.x").alias("x"))
    near = fx.pairs.where(F.abs(F.col("queryid") - F.col("dbid")) <= 1).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(49))))
    truth = near.withColumn("y", F.col("x") + 25 * (F.col("queryid") - F.col("dbid"))).where("y between 0 and 49").withColumn("k", F.col("x"))
    out = hits.truth_overlap(found, truth)
    return out.select("queryid", "dbid", *[F.round(c, 6).alias(c) for c in ("q_truth", "q_found", "t_truth", "t_found")])


# --- screening -----------------------------------------------------------------------------------------------------


@query
def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = screen.pooled(fixture(spark, sf_dir).targets)
    return rows.select("run_index", "pos", *[F.round(F.element_at("vec", k + 1), 6).alias(f"v{k}") for k in range(4)])


@query
def fold_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = screen.folds(screen.pooled(fixture(spark, sf_dir).targets), KERNEL, STRIDE)
    return rows.select("run_index", F.col("fold").cast("long").alias("fold"), F.round("fnorm", 6).alias("fnorm"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = fixture(spark, sf_dir)
    return screen.chunk_scores(screen.pooled(fx.queries), screen.pooled(fx.targets), KERNEL, STRIDE)


@query
def chunk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).withColumn("score", F.round("score", 6))


@query
def chunk_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.keep_quantile(_chunks(spark, sf_dir), QUANTILE).withColumn("score", F.round("score", 6))


@query
def quantile_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact quantile over the delivered scores of each query of ``hits``."""
    rows = table(spark, sf_dir, "hits").where("qid is not null and score is not null and not isnan(score)")
    return screen.quantile_by_query(rows.select(F.col("qid").alias("queryid"), "score"), 0.9).withColumn("threshold", F.round("threshold", 6))


@query
def whole_sequence_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = fixture(spark, sf_dir)
    return screen.whole_sequence_screen(fx.queries, fx.targets, 0.7).withColumn("score", F.round("score", 6))


@query
def residue_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target's residues added up, and the cosine of that with its first residue."""
    dim = 64
    summed = fixture(spark, sf_dir).targets.groupBy("run_index").agg(*dimension_sums(F.col("vec"), dim), F.min_by("vec", "pos").alias("_first"))
    total = F.array(*[f"_s{i}" for i in range(dim)])
    return summed.select("run_index", F.round("_s0", 6).alias("s0"), F.round("_s63", 6).alias("s63"), F.round(cosine(total, F.col("_first")), 6).alias("c"))


@query
def symmetric_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.symmetric_pairs(_chunks(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query
def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = fixture(spark, sf_dir)
    pairs = screen.screen(fx.queries, fx.targets, ScreenParams(70, KERNEL, STRIDE, only_scan=True))
    return screen.screen_json(pairs, sequences.store_files(fx.target_index, "db"))


# --- output and tools ----------------------------------------------------------------------------------------------


@query
def search_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = fixture(spark, sf_dir)
    found = hits.filter_hits(_hits(spark, sf_dir))
    return output.final_order(output.format_hits(found, fx.query_index, fx.target_index, 0.3, half_even=False))


@query
def full_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screening, alignment and output in one plan."""
    fx = fixture(spark, sf_dir)
    return search(fx.query_index, fx.queries, fx.target_index, fx.targets, AlignParams(3, 3, sigma=1.0), ScreenParams(70, KERNEL, STRIDE))


@query
def streamed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`full_search`, of query files that a stream reads, with stored vectors."""
    fx = fixture(spark, sf_dir)
    asked, found = scratch_path(spark, "asked"), scratch_path(spark, "found")
    fx.query_index.select("run_index", "id", "description", "sequence").write.parquet(asked)
    run = stream_search(spark, asked, fx.target_index, fx.targets, found, scratch_path(spark, "stream-checkpoint"), AlignParams(3, 3, sigma=1.0), ScreenParams(70, KERNEL, STRIDE), vectors=fx.queries)
    run.awaitTermination()
    return spark.read.parquet(found).drop("batch")


@query
def vector_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function ``align_vectors`` in SQL, for all pairs."""
    fx = fixture(spark, sf_dir)
    register(spark)
    vectors = F.transform(F.array_sort(F.collect_list(F.struct("pos", "vec"))), lambda r: r["vec"])
    q, t = (d.groupBy(F.col("run_index").alias(k)).agg(vectors.alias(v)) for d, k, v in ((fx.queries, "queryid", "q"), (fx.targets, "dbid", "t")))
    rows = spread(fx.pairs.join(q, "queryid").join(t, "dbid"), "queryid", "dbid")
    found = spark.sql("SELECT p.queryid, p.dbid, a.* FROM {p} p, LATERAL align_vectors(p.q, p.t, 3, 3, 1.0D) a", p=rows)
    return found.withColumn("score", F.round("score", 6))


@query
def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness of a store: the sequences that the queries' vectors lack."""
    fx = fixture(spark, sf_dir)
    return sequences.missing_embeddings(fx.target_index, fx.queries).select("run_index", "id")


@query
def html_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivered alignment as a table of its three rows."""
    rows = table(spark, sf_dir, "hits")
    return rows.select("hit_id", "loaded_at", html_alignment(F.col("qseq"), F.col("con"), F.col("tseq")).alias("html"))


@query
def hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus, identity and similarity of every delivered alignment, computed anew."""
    rows = table(spark, sf_dir, "hits")
    rows = rows.select("hit_id", "loaded_at", alignment_rates(F.col("qseq"), F.col("tseq")).alias("_r"))
    return rows.select("hit_id", "loaded_at", "_r.con", F.round("_r.ident", 6).alias("ident"), F.round("_r.similarity", 6).alias("similarity"))


@query
def mirrored_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "hits").where("not isnan(score)").select("qid", "score", "sid", "qstart", "qend", "qseq", "con", "tseq", "tstart", "tend", "tlen", "qlen", "match_len")
    return output.mirror_hits(rows, decimals=3)


@query
def all_mirrored_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows: null and NaN scores too."""
    rows = table(spark, sf_dir, "hits").select("hit_id", "qid", "score", "sid", "qstart", "qend", "tstart", "tend", "tlen", "qlen", "match_len")
    return output.mirror_hits(rows, decimals=3)


@query
def score_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "hits").where("score >= 0.5 and not isnan(score)").select("hit_id", "qid", "sid", "score")


@query
def top_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "hits").where("score is not null and not isnan(score)").dropDuplicates(["hit_id", "score"])
    return tools.top_hits(rows, 100).select("index", "qid", "sid", "score")


@query
def hit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "hits").where("score is not null and not isnan(score)").dropDuplicates(["hit_id", "score"])
    return tools.report_lines(tools.top_hits(rows, 100)).withColumn("index", F.col("index").cast("long"))


@query
def merged_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.merge_chains(table(spark, sf_dir, "hits").where("score is not null and not isnan(score)"), 0.3, decimals=6)


@query
def class_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tools.class_fields(_index(spark, sf_dir), "description")
    return rows.select("run_index", "X", "H", "T")


@query
def colour_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.colour_numbers(tools.class_fields(_index(spark, sf_dir), "description")).withColumn("colour", F.col("colour").cast("long"))


def _drawn(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    rows = table(spark, sf_dir, "hits").where("qid is not null and not isnan(score)").groupBy("hit_id").agg(F.max(F.struct("loaded_at", "score", "qid", "qstart", "qend")).alias("r"))
    return tools.plot_rows(rows.select("hit_id", "r.score", "r.qid", "r.qstart", "r.qend"), 0.4, most)


@query
def plot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 of each query, as its SQL has it."""
    return _drawn(spark, sf_dir, 25).select("hit_id", "qid", "len")


@query
def all_plot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(spark, sf_dir, 0).select("hit_id", "qid", "len")


@query
def plot_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.pack_lanes(_drawn(spark, sf_dir, 0)).withColumn("shade", F.round("shade", 6))


# --- sequences and batches -----------------------------------------------------------------------------------------


@query
def prepared_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.prepare_sequences(_index(spark, sf_dir).drop("seqlen"), 1000, "seq").select("run_index", "seq", "seqlen")


@query
def length_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = batching.length_statistics(batching.prepare_sequences(_index(spark, sf_dir).drop("seqlen"), 1000, "seq"))
    return stats.withColumn("mean_length", F.round("mean_length", 6))


@query
def job_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences as their jobs take them: cut to the job's own ``truncate_len``."""
    return batching.prepare_jobs(_index(spark, sf_dir).drop("seqlen"), table(spark, sf_dir, "emb_checkpoint"), "seq").select("run_index", "seq", "seqlen")


@query
def whole_length_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the sequences before any cut."""
    rows = _index(spark, sf_dir).where("seq is not null").withColumn("seqlen", F.length("seq"))
    return batching.length_statistics(rows).withColumn("mean_length", F.round("mean_length", 6))


@query
def rank_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _index(spark, sf_dir)
    batches = batching.fixed_batches(rows.select("run_index"), 32)
    total = rows.agg(F.floor(F.max("run_index") / 32) + 1).first()[0] or 0
    return batching.rank_share(batches, 4, total)


@query
def slice_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = batching.plan_batches(_index(spark, sf_dir), batching.over_multiples)
    return planned.select("job_id", "first", "last", F.col("sequences").cast("long").alias("sequences"), "residues")


@query
def adaptive_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.plan_batches(_index(spark, sf_dir), batching.groups_of_four)


@query
def multiple_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.plan_batches(_index(spark, sf_dir), batching.before_multiples)


@query
def resume_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.resume_points(table(spark, sf_dir, "emb_checkpoint"))


@query
def resume_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of the index without a stored embedding."""
    done = table(spark, sf_dir, "embfile").where("ext = '.emb' and size_bytes > 0 and octet_length(payload) = size_bytes")
    return batching.not_done(_index(spark, sf_dir), done).select("run_index", "job_id", "seqlen")


@query
def length_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.split_by_length(_index(spark, sf_dir), 100, 800).select("run_index", "part")


@query
def unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.with_unique_ids(_index(spark, sf_dir)).select("run_index", "id")


@query
def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "fasta")
    rows = _index(spark, sf_dir).where("id is not null and seq != ''")
    sequences.write_fasta(rows, path, "id", sequence="seq")
    return sequences.read_fasta(spark, path).select("id", "description", "sequence")


@query
def hits_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "hits-csv")
    rows = table(spark, sf_dir, "hits").where("qid is not null and score is not null and not isnan(score)")
    tables.write_hits(rows.select(*tables.OUTPUT.fieldNames()), path)
    return tables.read_hits(spark, path).select("qid", "sid", "score", "qstart", "con", "match_len")


@query
def all_fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence; its number is its id where the ids don't serve."""
    path = scratch_path(spark, "fasta")
    sequences.write_fasta(sequences.with_unique_ids(_index(spark, sf_dir)).where("seq != ''"), path, "id", sequence="seq")
    return sequences.read_fasta(spark, path).select("id", "sequence")


@query
def all_hits_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows: null and NaN come back as they were, empty texts as null."""
    path = scratch_path(spark, "hits-csv")
    tables.write_hits(table(spark, sf_dir, "hits").select(*tables.OUTPUT.fieldNames()), path)
    return tables.read_hits(spark, path).select("qid", "sid", "score", "qstart", "con", "match_len", "sdesc")


@query
def embedded_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residues that the stand-in model makes of each sequence, and the sum of their vectors."""
    rows = batching.prepare_jobs(_index(spark, sf_dir).drop("seqlen"), table(spark, sf_dir, "emb_checkpoint"), "seq")
    vectors = embed(rows, lambda: HashEmbedder(8), sequence="seq")
    return vectors.groupBy("run_index").agg(F.count("*").alias("residues"), F.round(F.sum(F.element_at("vec", 1)), 6).alias("first_sum"))


@query
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly event counts by a stream that ends when its input does."""
    schema = table(spark, sf_dir, "events").schema
    path, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "stream-checkpoint")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counts = stream_window_counts(source)
    run = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    run.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start().awaitTermination()
    return spark.read.parquet(path).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


# --- general data operations ---------------------------------------------------------------------------------------


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consolidate all tiny files into a store, in two arrivals, and list the files whose content it holds."""
    store, files = scratch_path(spark, "store"), table(spark, sf_dir, "embfile")
    later = F.coalesce(F.pmod(F.xxhash64("file_id"), F.lit(2)) == 1, F.lit(True))
    compact(spark, store, files.where(~later))
    compact(spark, store, files.where(later))
    return read_store(spark, store).select("file_id")


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        split_values(one_per_key(table(spark, sf_dir, name), key, value), key, value, name)
        for name, key, value in (("seqindex", "run_index", "description"), ("hits", "hit_id", "sdesc"))
    ]
    return parts[0].unionByName(parts[1])

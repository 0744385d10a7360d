import pytest
from pyspark.sql import functions as F

from strandlake import cli
from strandlake.functions.residues import consensus, html_alignment, identity, relation, render, similarity
from strandlake.operators.batching import not_done, prepare_sequences
from strandlake.operators.embed import HashEmbedder, embed, to_half
from strandlake.params import AlignParams, ScreenParams
from strandlake.session import scratch_path
from strandlake.sources import sequences, tables
from strandlake.streaming.search import stream_search

FASTA = "> seq1 first one\nACDEF\nGHIKL\n\n>seq2 with > inside\r\nmnpq\r\n>empty\n>last\nSTVWY"


@pytest.fixture
def fasta(tmp_path):
    path = tmp_path / "in.fasta"
    path.write_text(FASTA)
    return str(path)


def test_fasta(spark, fasta):
    got = [tuple(r) for r in sequences.read_fasta(spark, fasta).orderBy("run_index").collect()]
    assert got == [(0, "seq1", "seq1 first one", "ACDEFGHIKL"), (1, "seq2", "seq2 with > inside", "MNPQ"), (2, "empty", "empty", ""), (3, "last", "last", "STVWY")]
    assert [r.id for r in sequences.read_fasta(spark, fasta, "header").orderBy("run_index").collect()][:2] == ["seq1 first one", "seq2 with > inside"]


def test_positions_over_many_files(spark, tmp_path):
    path = str(tmp_path / "parts")
    spark.range(50).repartition(7).select(F.col("id").cast("string")).write.text(path)
    got = sorted(r.run_index for r in sequences.number_rows(spark.read.text(path)).collect())
    assert got == list(range(50))


def test_index_files_and_ids(spark, tmp_path, fasta):
    (tmp_path / "db.csv").write_text("id,seq\na,ACD\na,GHI\n")
    base = str(tmp_path / "db")
    assert sequences.find_index(spark, base) == base + ".csv"
    got = [(r.run_index, r.id, r.sequence, r.description) for r in sequences.read_index(spark, base, "seq").orderBy("run_index").collect()]
    assert got == [(0, "0", "ACD", "na"), (1, "1", "GHI", "na")]
    with pytest.raises(ValueError):
        sequences.read_index(spark, base, "nothing")
    assert sequences.is_index_valid(sequences.read_index(spark, fasta)) and not sequences.is_index_valid(spark.createDataFrame([(1,), (1,)], "run_index long"))


def test_fasta_write_by_part(spark, tmp_path):
    df = spark.createDataFrame([("a", "AC", "1"), ("b", "GH", "CPU"), ("c", None, "1")], "id string, sequence string, part string")
    sequences.write_fasta(df, str(tmp_path / "out"), by="part")
    assert [r.id for r in sequences.read_fasta(spark, str(tmp_path / "out" / "part=CPU")).collect()] == ["b"]


def test_rendering(spark):
    df = spark.createDataFrame([([{"y": 0, "x": 0}, {"y": 1, "x": 1}, {"y": 1, "x": 2}, {"y": 2, "x": 3}], "ACDE", "AXF")], "i array<struct<y:int,x:int>>, q string, t string")
    out = df.select(render(F.col("i"), F.col("q"), "x").alias("q"), render(F.col("i"), F.col("t"), "y").alias("t"), relation(F.col("i")).alias("r")).first()
    assert (out.q, out.t, out.r) == ("ACDE", "AX-F", "|| |")
    row = spark.createDataFrame([("AC-DWB", "AV-EFZ")], "a string, b string")
    got = row.select(consensus(F.col("a"), F.col("b")).alias("c"), identity(F.col("a"), F.col("b")).alias("i"), similarity(F.col("a"), F.col("b")).alias("s"), html_alignment(F.col("a")).alias("h")).first()
    assert got.c == "|. +++" and got.i == pytest.approx(2 / 6) and got.s == pytest.approx(4 / 6) and got.h.startswith("<table><tr><td>A</td>")
    assert spark.createDataFrame([("", None)], "a string, b string").select(identity(F.col("a"), F.col("b")).alias("i")).first().i is None


def test_hit_files(spark, data, tmp_path):
    rows = spark.read.parquet(f"{data}/hits.parquet").where("qid is not null and not isnan(score)").select(*tables.OUTPUT.fieldNames()).limit(200)
    path = str(tmp_path / "hits")
    tables.write_hits(rows, path, one_file=True)
    assert sorted(map(str, tables.read_hits(spark, path).collect())) == sorted(map(str, rows.collect()))
    tables.write_hits(rows, path, separate=True)
    assert spark.read.option("header", True).option("sep", ";").csv(path).select("qid").distinct().count() == rows.select("qid").distinct().count()


def test_embedding_job_resumes(spark):
    index = spark.createDataFrame([(0, "acd"), (1, "GHIK"), (2, None), (3, "")], "run_index long, sequence string")
    ready = prepare_sequences(index, 3)
    first = embed(ready.where("run_index = 0")).cache()
    rest = embed(ready, done=first)
    assert [r.run_index for r in rest.select("run_index").distinct().collect()] == [1] and rest.count() == 3
    whole = {(r.run_index, r.pos): r.vec for r in embed(ready).collect()}
    assert len(whole) == 6 and all(whole[(r.run_index, r.pos)] == r.vec for r in first.unionByName(rest).collect())
    assert not_done(ready, embed(ready)).where("seqlen > 0").count() == 0
    assert to_half(first).first().vec != first.first().vec
    assert len(HashEmbedder(8)(["A", ""])[1]) == 0


def test_streamed_queries(spark, tmp_path):
    texts = ["ACDEFGHIKLMNPQRSTVWYACDEFGHIKLMNPQRSTVWY"[k:] + "ACDEFGHIKL"[:k] for k in range(4)]
    index = spark.createDataFrame([(k, f"t{k}", "d", t) for k, t in enumerate(texts)], "run_index long, id string, description string, sequence string")
    vectors = embed(index).cache()
    folder, out, cp = (str(tmp_path / d) for d in ("in", "out", "cp"))
    index.where("run_index = 0").write.mode("append").parquet(folder)
    run = lambda: stream_search(spark, folder, index, vectors, out, cp, AlignParams(window=3, min_span=5), ScreenParams(0)).awaitTermination()
    run()
    index.where("run_index = 1").write.mode("append").parquet(folder)
    run()
    got = spark.read.parquet(out)
    assert {(r.batch, r.qid) for r in got.select("batch", "qid").distinct().collect()} == {(0, "t0"), (1, "t1")}
    assert {r.sid for r in got.where("qid = 't1'").collect()} >= {"t1"}


def test_command_line(spark, tmp_path):
    records = "".join(f">s{k} d\n{('ACDEFGHIKLMNPQRSTVWY' * 3)[k : k + 45]}\n" for k in range(12))
    (tmp_path / "db.fasta").write_text(records)
    base, out = str(tmp_path / "db"), str(tmp_path / "out")
    for _ in range(2):
        cli.main(["embed", base + ".fasta", base], spark)
    assert tables.read_residues(spark, base + ".emb.parquet").count() == 12 * 45
    (tmp_path / "db.fasta").rename(tmp_path / "q.fasta")
    cli.main(["embed", str(tmp_path / "q.fasta"), str(tmp_path / "q")], spark)
    fasta = str(tmp_path / "q")
    args = ["--win", "3", "--span", "5", "--cpc", "50", "--cpc-kernel-size", "10", "--cpc-stride", "5"]
    spark.read.csv(base + ".csv", header=True).count()
    cli.main(["search", fasta, fasta, out, *args], spark)
    hits = tables.read_hits(spark, out)
    assert {(r.qid, r.sid) for r in hits.collect()} >= {(f"s{k}", f"s{k}") for k in range(12)}
    cli.main(["search", fasta, fasta, str(tmp_path / "scan"), "--only-scan", *args], spark)
    assert spark.read.text(str(tmp_path / "scan")).count() == 12
    cli.main(["merge", out, str(tmp_path / "merged"), "--max-hits", "7"], spark)
    assert spark.read.csv(str(tmp_path / "merged"), sep=";", header=True).count() == 7
    cli.main(["report", out, str(tmp_path / "report")], spark)
    cli.main(["lanes", out, str(tmp_path / "lanes")], spark)
    cli.main(["pool", fasta, str(tmp_path / "pooled")], spark)
    cli.main(["split", str(tmp_path / "q.fasta"), str(tmp_path / "split"), "--chunk", "5", "--max-length", "100"], spark)
    assert spark.read.parquet(str(tmp_path / "pooled")).count() == 12 * 45
    assert len(list((tmp_path / "split").glob("part=*"))) == 3
    report = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert any(v.startswith(" No Hit ") for v in report) and "No 1" in report and any(v.startswith("  1 s") for v in report)
    wrong = [["--win", "9", "--span", "3"], ["--win", "0"], ["--win", "50"], ["--cpc", "100"], ["--alignment-cutoff", "1"], ["--alignment-cutoff", "-0.1"], ["--cpc-stride", "0"], ["--bfactor", "0"]]
    for args in wrong:
        with pytest.raises(SystemExit):
            cli.main(["search", fasta, fasta, out, *args], spark)
    with pytest.raises(SystemExit):
        cli.main(["search", base, fasta, out, "--reduce-duplicates"], spark)
    for args in (["--batch-size", "0"], ["--embedder", "none"], ["--truncate", "0"]):
        with pytest.raises(SystemExit):
            cli.main(["embed", fasta + ".fasta", base, *args], spark)
    assert cli.embedder("strandlake.operators.embed:HashEmbedder") is cli.embedder("hash")


def test_completeness(spark):
    index = spark.createDataFrame([(0,), (1,)], "run_index long")
    residues = spark.createDataFrame([(0, 0)], "run_index long, pos int")
    assert [r.run_index for r in sequences.missing_embeddings(index, residues).collect()] == [1]
    assert sequences.store_files(index, "db/").orderBy("run_index").first().file == "db/0.emb"
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_rates_of_a_batch_are_the_expressions(spark):
    import random

    from strandlake.functions.residues import alignment_rates

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("ACDEFGHIKLMNPQRSTVWYBZX-*") for _ in range(rng.randint(0, 30)))
    rows = [(k, word() if k % 17 else None, word() if k % 13 else None) for k in range(500)]
    df = spark.createDataFrame(rows, "k long, a string, b string").where("a is null or b is null or length(a) = length(b) or k > 250")
    same = df.where("length(a) = length(b)").union(df.where("a is null or b is null"))
    same = same.withColumn("r", alignment_rates(F.col("a"), F.col("b")))
    a, b = F.col("a"), F.col("b")
    bad = same.where("a != '' and b != ''").where((F.col("r.con") != consensus(a, b)) | (F.col("r.ident") != identity(a, b)) | (F.col("r.similarity") != similarity(a, b)))
    assert bad.count() == 0
    assert same.where("(a is null or b is null) and (r.con is not null or r.ident is not null)").count() == 0
    cut = df.where("length(a) != length(b)").withColumn("r", alignment_rates(a, b)).where("length(r.con) != least(length(a), length(b))")
    assert cut.count() == 0


def test_sequences_are_cut_as_their_job_says(spark):
    from strandlake.operators.batching import prepare_jobs

    rows = spark.createDataFrame([(k, job, "ab" * 3000) for k, job in enumerate([1, 2, 3, None])] + [(9, 1, None)], "run_index long, job_id long, seq string")
    starts = spark.createDataFrame([(1, "start", 7), (1, "start", 7), (2, "start", None), (3, "middle", 7)], "job_id long, stage string, truncate_len int")
    got = {r.run_index: (r.seq, r.seqlen) for r in prepare_jobs(rows, starts, "seq").collect()}
    assert got == {0: ("ABABABA", 7)} | {k: ("AB" * 3000, 6000) for k in (1, 2, 3)}


def test_length_statistics_of_whole_sequences(spark, data):
    from strandlake.plans.queries import QUERIES, table

    longest = max(len(r.seq or "") for r in table(spark, data, "seqindex").select("seq").collect())
    assert QUERIES["whole_length_statistics"](spark, data).first().longest == longest > 1000

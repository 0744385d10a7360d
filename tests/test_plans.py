import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions.udfs import register
from strandlake.operators import align, hits, output, score, screen
from strandlake.params import AlignParams, ScreenParams
from strandlake.plans.fixtures import fixture
from strandlake.plans.search import search


@pytest.fixture(scope="module")
def fx(spark, data):
    return fixture(spark, data)


P = AlignParams(window=3, min_span=3, sigma=1.0)


def rows(df):
    return sorted((r.queryid, r.dbid, r.pathid, r.span_start, r.len, round(r.score, 6)) for r in df.collect())


def test_broadcast_and_shuffle_plans_agree(fx):
    a = align.align_pairs(fx.pairs, fx.queries, fx.targets, P)
    b = align.align_pairs(fx.pairs.repartition(7), fx.queries, fx.targets, P, held_residues=10)
    assert rows(a) == rows(b) and a.count()


def test_filter_in_the_kernel_is_the_filter_of_the_table(fx):
    plain = align.align_pairs(fx.pairs, fx.queries, fx.targets, AlignParams(window=3, min_span=3, sigma=1.0, filter_hits=False))
    assert rows(hits.filter_hits(plain)) == rows(align.align_pairs(fx.pairs, fx.queries, fx.targets, P))


def test_screen_blocks_agree_and_ties_stay(fx, spark):
    q, t = screen.pooled(fx.targets), screen.pooled(fx.targets)
    one = {(r[0], r[1]): r[2] for r in screen.chunk_scores(q, t, 10, 5).collect()}
    many = {(r[0], r[1]): r[2] for r in screen.chunk_scores(q, t, 10, 5, query_block=5).collect()}
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-9 for k in one)
    scores = spark.createDataFrame([(1, k, float(s)) for k, s in enumerate([1, 2, 2, 2, 3])], "queryid long, dbid long, score double")
    assert screen.keep_quantile(scores, 0.5).count() == 4


def test_quantile_is_exact(spark):
    rng = np.random.default_rng(1)
    values = {q: np.round(rng.normal(size=n), 2) for q, n in ((1, 1), (2, 2), (3, 1000), (4, 777))}
    values[5] = np.full(50, 0.25)
    df = spark.createDataFrame([(q, float(v)) for q, vs in values.items() for v in vs], "queryid long, score double")
    for share in (0.0, 0.37, 0.9, 1.0):
        got = dict(screen.quantile_by_query(df, share, bins=16).collect())
        assert all(abs(got[q] - np.quantile(vs, share)) < 1e-12 for q, vs in values.items())


def test_screen_is_off_for_few_targets(fx):
    few = fx.targets.where("run_index < 3")
    got = screen.screen(fx.queries, few, ScreenParams(70, 10, 5)).collect()
    assert len(got) == 3 and all(r.score == 1.0 for r in got)


def test_search_reports_the_diagonal(fx):
    got = search(fx.target_index, fx.targets, fx.target_index, fx.targets, P, ScreenParams(0), reduce_duplicates=True)
    found = {(r.qid, r.sid) for r in got.collect()}
    ids = [r.id for r in fx.target_index.collect()]
    assert all((i, i) in found for i in ids) and all((b, a) in found for a, b in found)


def test_mirror(spark):
    columns = ["qid", "score", "sid", "qstart", "qend", "qseq", "con", "tseq", "tstart", "tend", "tlen", "qlen", "match_len", "sdesc"]
    row = lambda q, s: (q, 0.5, s, 1, 2, "A", "|", "C", 3, 4, 9, 8, 2, "x")
    df = spark.createDataFrame([row("a", "b"), row("b", "a"), row("c", "d"), row("e", "e"), row(None, "f")], columns)
    names = spark.createDataFrame([("c", "see")], "id string, description string")
    got = [(r.qid, r.sid, r.qstart, r.tlen, r.sdesc) for r in output.mirror_hits(df, names).collect()]
    assert len(got) == 6 and ("d", "c", 3, 8, "see") in got


def test_overlap_and_unique(spark):
    cells = lambda *p: [{"y": y, "x": x} for y, x in p]
    data = [(1, 1, 0, 0, cells((0, 0), (1, 1))), (1, 1, 1, 0, cells((0, 0), (1, 1), (2, 2))), (1, 1, 2, 0, cells((5, 5)))]
    df = spark.createDataFrame(data, "queryid long, dbid long, pathid int, spanid int, indices array<struct<y:int,x:int>>")
    assert [tuple(r) for r in hits.overlap(df).collect()] == [(1, 1, 1, 0, 1.0)]
    assert sorted(r.pathid for r in hits.unique_hits(df).collect()) == [0, 2]
    assert sorted(r.pathid for r in hits.unique_hits(df, 1.0).collect()) == [0, 1, 2]


def test_truth_overlap(spark):
    schema = "queryid long, dbid long, y int, x int, k int"
    truth = spark.createDataFrame([(1, 2, k + 3, k, k) for k in range(10)], schema)
    found = spark.createDataFrame([(1, 2, k + 3, k, k - 2) for k in range(2, 7)], schema)
    assert tuple(hits.truth_overlap(found, truth).first()) == (1, 2, 0.5, 1.0, 0.5, 1.0)


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT cosine(array(1D, 0D), array(1D, 1D)) AS c").first().c == pytest.approx(2**-0.5)
    rng = np.random.default_rng(0)
    m = spark.createDataFrame([(rng.normal(size=(20, 8)).tolist(),)], "m array<array<double>>")
    m.createOrReplaceTempView("one")
    best = spark.sql("SELECT max(score) AS s FROM one, LATERAL align_vectors(m, m, 3, 4)").first().s
    assert best == pytest.approx(1.0)


def test_residue_dimension_pool(spark):
    from strandlake.functions.vectors import pool

    v = [float(k) for k in range(35)]
    got = spark.createDataFrame([(v,)], "v array<double>").select(pool(F.col("v")).alias("p")).first().p
    assert got == [sum(v[:16]) / 16, sum(v[16:32]) / 16]


def test_kernels_agree_with_the_relational_plans(fx):
    """The same cells, scores and starts, computed by joins and windows and by matrices."""
    m = fx.pairs, fx.queries, fx.targets
    cells = align.similarity_cells(*m)
    scored = score.score_matrix(cells)
    q = fx.queries.groupBy(F.col("run_index").alias("queryid")).agg(F.count("*").cast("int").alias("nq"))
    t = fx.targets.groupBy(F.col("run_index").alias("dbid")).agg(F.count("*").cast("int").alias("nt"))
    lengths = fx.pairs.join(q, "queryid").join(t, "dbid")
    both = [
        (score.residue_pairs(*m), cells), (score.signal_enhancement(cells), align.enhanced_cells(*m)), (score.global_znorm(cells), align.normal_cells(*m)), (scored.drop("c"), align.score_cells(*m)),
        (score.best_cell(scored), align.best_cells(*m)), (hits.best_diagonal(cells), align.best_diagonals(*m)), (score.border_starts(scored, lengths, 3, 2), align.start_cells(*m, 3, 2)),
    ]
    for a, b in both:
        columns = sorted(a.columns)
        assert columns == sorted(b.columns)
        keys = [c for c in columns if dict(a.dtypes)[c] != "double"]
        x, y = (d.select(*columns).toPandas().sort_values(keys, ignore_index=True) for d in (a, b))
        assert len(x) == len(y) and len(x) and (x[keys].to_numpy() == y[keys].to_numpy()).all()
        assert all(np.allclose(x[c], y[c]) for c in columns if c not in keys)


def test_quantile_with_outliers_and_ties(spark):
    """All scores but one in one bin, again and again; nulls and NaN."""
    values = [1e300, *(1.0 + 10.0**-k for k in range(16)), *[1.0] * 500, *np.linspace(0, 1e-9, 300).tolist()]
    rows = [(1, v) for v in values] + [(1, None), (1, float("nan")), (2, float("nan")), (3, 5.0)]
    df = spark.createDataFrame(rows, "queryid long, score double")
    for share in (0.0, 0.25, 0.5, 0.99, 1.0):
        got = dict(screen.quantile_by_query(df, share, bins=8).collect())
        assert got.keys() == {1, 3} and got[3] == 5.0 and abs(got[1] - np.quantile(values, share)) <= 1e-12 * abs(got[1])


def test_scores_are_computed_once(fx):
    """What is kept is read from the written scores: the plan has no kernel."""
    kept = screen.keep_quantile(screen.chunk_scores(screen.pooled(fx.queries), screen.pooled(fx.targets), 10, 5), 0.7)
    assert "MapInPandas" not in kept._jdf.queryExecution().toString() and kept.count()

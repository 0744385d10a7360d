import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from strandlake.plans import queries as core


def same(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(same, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def views(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{data}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_against_sql(spark, views, data, name):
    df = core.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(map(same, r)) for r in df.select(*columns).collect()), key=str)
    if name in core.SQL:
        cursor = views.execute(core.SQL[name])
        names = [c[0] for c in cursor.description]
        assert sorted(names) == columns
        assert got == sorted((tuple(same(dict(zip(names, r))[c]) for c in columns) for r in cursor.fetchall()), key=str)


def odd_hits(spark, data, folder, **odd):
    """Hits of one pair each, one for each odd value of a column; the rows of a query and those of its SQL."""
    base = spark.read.parquet(f"{data}/hits.parquet").where("qid is not null").first().asDict()
    rows = [base | {c: v, "hit_id": k} for k, (c, v) in enumerate((c, v) for c, vs in odd.items() for v in vs)]
    spark.createDataFrame(rows, spark.read.parquet(f"{data}/hits.parquet").schema).write.parquet(f"{folder}/hits.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW hits AS SELECT * FROM '{folder}/hits.parquet/*.parquet'")

    def both(name):
        cursor = con.execute(core.SQL[name])
        columns = [c[0] for c in cursor.description]
        return tuple(sorted((tuple(map(same, r)) for r in found), key=str) for found in (core.QUERIES[name](spark, str(folder)).select(*columns).collect(), cursor.fetchall()))

    return both


@pytest.mark.parametrize("name", ["mirrored_hits", "all_mirrored_hits"])
def test_mirrored_scores_round_as_in_sql(spark, data, tmp_path, name):
    """Halves that doubles miss, null, NaN, infinities, values too large to scale."""
    scores = [0.5005, 0.5015, -0.5005, 1.0005, 2.0035, 16.0845, 0.0005, 0.1, None, float("inf"), float("-inf"), 1e300, 1.7e308]
    got, wanted = odd_hits(spark, data, tmp_path, score=scores + [float("nan")] * (name == "all_mirrored_hits"))(name)
    assert got == wanted and len(got) >= len(scores)


def test_csv_keeps_odd_texts(spark, data, tmp_path):
    """Line ends of all kinds inside a field, quotes, separators, escapes, spaces and words that look like values."""
    texts = ["a\nb", "a\rb", "a\r\nb", "\n", '\\"x"\n;', "\n;;\n", 'a"b', "a\\", "a;b", " a ", "NaN", "null", "", "#x", None]
    scores = [float("nan"), None, float("inf"), float("-inf"), 0.5005, 1e-300]
    got, wanted = odd_hits(spark, data, tmp_path, qid=texts, sid=texts, con=texts, sdesc=texts, score=scores)("all_hits_csv_round_trip")
    assert got == wanted and len(got) == 4 * len(texts) + len(scores)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0

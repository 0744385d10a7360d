"""Schemas of the tables that the pipeline passes on."""

from pyspark.sql import types as T

INDEX = "run_index long, id string, description string, sequence string"
RESIDUE = "run_index long, pos int, vec array<double>"
HIT = (
    "queryid long, dbid long, pathid int, spanid int, span_start int, span_end int, indices array<struct<y:int,x:int>>, "
    "score double, len int, mode string, y1 int, x1 int"
)
#: The columns of the delivered table.
OUTPUT_COLUMNS = [
    "qid", "score", "ident", "similarity", "sid", "qstart", "qend", "qseq", "con", "tseq", "tstart", "tend", "tlen", "qlen", "match_len",
]
OUTPUT = T.StructType(
    [T.StructField(c, T.StringType() if c in ("qid", "sid", "qseq", "con", "tseq") else T.DoubleType() if c in ("score", "ident", "similarity") else T.IntegerType()) for c in OUTPUT_COLUMNS]
    + [T.StructField("sdesc", T.StringType())]
)

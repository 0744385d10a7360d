"""SQL names for the library's functions: ``cosine``, and the table function ``align_vectors``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from strandlake.operators.align import align
from strandlake.params import AlignParams

COSINE = """
CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
RETURN try_divide(
  aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x),
  sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)))
"""


@udtf(returnType="pathid int, spanid int, span_start int, span_end int, score double, len int", useArrow=True)
class AlignVectors:
    """Hits of one pair of matrices given as arrays of vectors; for use with ``LATERAL``."""

    def eval(self, query: list, target: list, window: int, min_span: int, sigma: float = 2.0) -> Iterator[tuple]:
        query, target = (np.stack([np.asarray(v, np.float64) for v in m]) for m in (query, target))
        hits = align(query, target, AlignParams(window=window, min_span=min_span, sigma=float(sigma)))
        for pathid, spanid, start, end, _, score, length in hits:
            yield pathid, spanid, start, end, score, length


def register(spark: SparkSession, cosine: str = "cosine", align_vectors: str = "align_vectors") -> None:
    spark.sql(COSINE.format(name=cosine))
    spark.udtf.register(align_vectors, AlignVectors)

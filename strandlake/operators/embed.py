"""The embedding job around a pluggable model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.batching import not_done
from strandlake.operators.ranking import spread
from strandlake.schema import RESIDUE

#: An embedder turns a list of sequences into one ``[length, dim]`` matrix each.
Embedder = Callable[[list[str]], list[np.ndarray]]


class HashEmbedder:
    """A deterministic stand-in for a language model: each residue's vector depends on itself and its neighbours."""

    def __init__(self, dim: int = 64, reach: int = 1):
        self.dim, self.reach = dim, reach
        codes = np.arange(256, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(dim, dtype=np.uint64)[None, :] * np.uint64(0xBF58476D1CE4E5B9)
        codes ^= codes >> np.uint64(31)
        codes *= np.uint64(0x94D049BB133111EB)
        self.base = (codes >> np.uint64(40)).astype(np.float64) / float(1 << 23) - 1.0

    def __call__(self, sequences: list[str]) -> list[np.ndarray]:
        out = []
        for s in sequences:
            own = self.base[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
            near = own.copy()
            for k in range(1, self.reach + 1):
                near[k:] += own[:-k] / (2 * k) if len(own) > k else 0
            out.append(near)
        return out


def embed(index: DataFrame, make_embedder: Callable[[], Embedder] = HashEmbedder, done: DataFrame | None = None, batch_size: int = 32, sequence: str = "sequence") -> DataFrame:
    """``(run_index, pos, vec)``: one row per residue. The model is made once per task; ``done`` rows are left out.

    Null and empty sequences give no row; repeated rows are embedded each for itself.
    """
    todo = index if done is None else not_done(index, done)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_embedder()
        for batch in batches:
            for k in range(0, batch.num_rows, batch_size):
                part = batch.slice(k, batch_size)
                made = [np.asarray(m, np.float64) for m in model(part.column(1).to_pylist())]
                size = np.array([len(m) for m in made])
                values = np.concatenate(made)
                at = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.int32())
                pos = np.arange(len(values), dtype=np.int32) - np.repeat(np.cumsum(size) - size, size).astype(np.int32)
                keys = part.column(0).take(pa.array(np.repeat(np.arange(len(size)), size)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(pos), pa.ListArray.from_arrays(at, pa.array(values.ravel()))], ["run_index", "pos", "vec"])

    rows = todo.where(F.length(sequence) > 0).select(F.col("run_index").cast("long").alias("run_index"), F.col(sequence).alias("s"))
    return spread(rows, "run_index").mapInArrow(run, RESIDUE)


def to_half(residues: DataFrame) -> DataFrame:
    """Vectors rounded as half-precision storage would; a whole Arrow batch at once."""
    at = residues.columns.index("vec")

    def rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(at)
            flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float64)
            ends = np.append(0, np.cumsum(pc.fill_null(vec.value_lengths(), 0).to_numpy())).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=vec.is_null() if vec.null_count else None)
            yield batch.set_column(at, batch.schema.field(at), made.cast(batch.schema.field(at).type))

    return residues.mapInArrow(rounded, residues.schema)

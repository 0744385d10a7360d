"""Several values packed in one field: one row per value, with its position.

The text of a whole Arrow batch is scanned at once. Which quote characters open a quoted piece depends on all pieces
before them in the row; that chain is resolved by pointer doubling over the candidate quotes, so that the number of numpy
passes grows with the logarithm of the pieces in a row and not with the rows or pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions.arrowtext import row_slices, string_parts, to_strings

SEPARATORS = "|;,\t"
QUOTES = "\"'"
SLICE_BYTES = 4 << 20
PIECE = pa.struct([pa.field("pos", pa.int32()), pa.field("piece", pa.string())])


def _quoted_regions(raw: np.ndarray, escaped_sep: np.ndarray, sep: np.ndarray, starts: np.ndarray, row_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the opening and closing quotes of all quoted pieces."""
    n, none = len(raw), np.zeros(0, np.int64)
    quote = np.isin(raw, np.frombuffer(QUOTES.encode(), np.uint8))
    if not quote.any():
        return none, none
    # the last character before each position that is not a space, within the row
    at = np.arange(n, dtype=np.int64)
    solid = np.where(raw != 32, at, -1)
    before = np.empty(n, np.int64)
    before[0] = -1
    np.maximum.accumulate(solid[:-1], out=before[1:]) if n > 1 else None
    before = np.where(before < starts[row_of], -1, before)
    cut_here = sep & ~escaped_sep
    candidates = np.flatnonzero(quote & ((before < 0) | cut_here[np.maximum(before, 0)]))
    if not len(candidates):
        return none, none
    close = np.full(len(candidates), -1, np.int64)
    row_end = np.append(starts[1:], n)[row_of[candidates]]
    for q in QUOTES.encode():
        mine = np.flatnonzero(raw[candidates] == q)
        if not len(mine):
            continue
        hits = np.flatnonzero(raw == q)
        fresh = np.append(True, (np.diff(hits) != 1) | (row_of[hits[1:]] != row_of[hits[:-1]]))
        first = hits[fresh]
        last = np.append(hits[np.flatnonzero(fresh)[1:] - 1], hits[-1])
        odd_last = last[(last - first) % 2 == 0]
        odd_first = first[(last - first) % 2 == 0]
        opener = candidates[mine]
        own = np.searchsorted(first, opener, side="right") - 1
        left = last[own] - opener  # quotes of the run that follow the opener; an odd number closes at the run's end
        later = np.searchsorted(odd_first, last[own], side="right")
        then = np.where(later < len(odd_last), odd_last[np.minimum(later, len(odd_last) - 1)] if len(odd_last) else n, n)
        close[mine] = np.where(left % 2 == 1, last[own], then)
    known = (close >= 0) & (close < row_end)
    # an opener without an end is plain: the chain goes on right behind it
    jump = np.searchsorted(candidates, np.where(known, close, candidates), side="right")
    stop = len(candidates)
    jump = np.append(jump, stop)
    row_c = row_of[candidates]
    head = np.append(True, row_c[1:] != row_c[:-1])
    same = np.append(row_c[np.minimum(jump[:-1], stop - 1)] == row_c, True)
    jump = np.where(same & (jump < stop), jump, stop)
    real = np.append(head, False)
    while (jump[:-1] < stop).any():
        real[jump[np.flatnonzero(real)]] = True
        jump = jump[jump]
    real = real[:-1] & known
    return candidates[real], close[real]


def split_lists(column: pa.Array) -> pa.ListArray:
    """The non-empty pieces of each string as a list of ``(pos, piece)``; positions count from 1."""
    offsets, raw = string_parts(column)
    n = len(raw)
    if not n:
        return pa.array([[]] * len(column), pa.list_(PIECE))
    filled = np.flatnonzero(np.diff(offsets) > 0)
    starts = offsets[:-1][filled]
    row_of = np.repeat(np.arange(len(filled)), np.diff(offsets)[filled])
    head = np.zeros(n, bool)
    head[starts] = True
    sep = np.isin(raw, np.frombuffer(SEPARATORS.encode(), np.uint8))
    slash = raw == 92
    after_slash = np.append(False, slash[:-1]) & ~head
    escaped = sep & after_slash
    opens, closes = _quoted_regions(raw, escaped, sep, starts, row_of)
    depth = np.zeros(n + 1, np.int32)
    depth[opens] += 1
    depth[closes] -= 1
    inside = np.cumsum(depth[:-1]) > 0  # from the opening quote up to the last character before the closing one
    marks = np.zeros(n, bool)
    marks[opens] = marks[closes] = True
    real = sep & ~escaped & ~inside
    # pieces: a separator opens the next piece; the row's start opens its first one
    piece = np.cumsum(head) + np.cumsum(real) - 1
    piece_rows = np.append(row_of[starts], row_of[real]) if len(starts) else row_of[:0]
    order = np.argsort(np.append(starts * 2, np.flatnonzero(real) * 2 + 1), kind="stable")
    piece_rows = piece_rows[order]
    heads = np.append(True, piece_rows[1:] != piece_rows[:-1])
    ordinal = np.arange(len(piece_rows)) - np.repeat(np.flatnonzero(heads), np.diff(np.append(np.flatnonzero(heads), len(piece_rows)))) + 1
    # what goes: separators, the marks, the second of two quotes inside, the slash before a plain separator
    gone = real | marks
    before_escaped = np.append(escaped[1:], False) & ~inside & slash
    gone |= before_escaped
    if len(opens):
        region = np.cumsum(np.bincount(opens, minlength=n))  # 1-based region of a position that is inside
        qchar = raw[opens][np.maximum(region - 1, 0)]
        doubled = inside & ~marks & (raw == qchar)
        at = np.flatnonzero(doubled)
        if len(at):
            fresh = np.append(True, np.diff(at) != 1)
            run_start = np.repeat(at[fresh], np.diff(np.append(np.flatnonzero(fresh), len(at))))
            gone[at[(at - run_start) % 2 == 1]] = True
    # spaces at a piece's edges, outside quotes
    content = ~gone & ((raw != 32) | inside)
    keep_from = np.flatnonzero(content | marks)
    low = np.full(len(piece_rows), n, np.int64)
    high = np.full(len(piece_rows), -1, np.int64)
    np.minimum.at(low, piece[keep_from], keep_from)
    np.maximum.at(high, piece[keep_from], keep_from)
    at = np.arange(n)
    keep = ~gone & (at >= low[piece]) & (at <= high[piece])
    length = np.bincount(piece[keep], minlength=len(piece_rows))
    text_at = np.append(0, np.cumsum(length))
    full = np.flatnonzero(length)
    text = raw[keep]
    pieces = pa.StructArray.from_arrays([pa.array(ordinal[full].astype(np.int32)), to_strings(text.tobytes(), np.append(text_at[full], text_at[-1]))], fields=list(PIECE))
    children = np.bincount(filled[piece_rows[full]], minlength=len(column))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(children)), pa.int32()), pieces)


def split_batch(column: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Row ordinal, position from 1 and text of every non-empty piece of a string column: the lists, flattened with their parents."""
    lists = split_lists(column)
    flat = lists.flatten()
    return pc.list_parent_indices(lists), flat.field("pos"), flat.field("piece")


def split_values(df: DataFrame, key: str, value: str, tab_name: str | None = None, ignore: tuple[str, ...] = ("na",)) -> DataFrame:
    """Rows ``(row_key, pos, piece)``, with ``tab_name`` first if one is given.

    A separator is any of ``| ; ,`` and tab. A piece whose first non-space character is a quote runs quoted to the next
    such character: doubled inside it stands for itself; separators and backslashes inside are plain. Elsewhere quotes
    are plain and a backslash before a separator makes it plain and vanishes.

    Defined results: null, empty and ignored values give no row; empty pieces count for ``pos`` but give no row; a
    quote that never closes is plain text; text between a closing quote and the next separator is kept behind the quoted
    text as it stands, without the spaces at its end; only the space character counts as a space. Rows with a null key are kept (null key).
    Repeated rows are split each for itself; call :func:`one_per_key` first to have each key once. Other columns, of any
    name, are ignored.
    """
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("row_key", kind), T.StructField("pos", T.IntegerType()), T.StructField("piece", T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = batch.column(0), batch.column(1)
            offsets, _ = string_parts(values)
            for a, b in row_slices(offsets, SLICE_BYTES):
                rows, pos, pieces = split_batch(values.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a).take(rows), pos, pieces], ["row_key", "pos", "piece"])

    wanted = df.where(usable(F.col(value), ignore)).select(F.col(key).alias("row_key"), F.col(value).alias("value"))
    out = wanted.mapInArrow(scan, schema)
    return out if tab_name is None else out.select(F.lit(tab_name).alias("tab_name"), "row_key", "pos", "piece")


def usable(value: Column, ignore: tuple[str, ...] = ("na",)) -> Column:
    return value.isNotNull() & ~value.isin("", *ignore)


def one_per_key(df: DataFrame, key: str, value: str, ignore: tuple[str, ...] = ("na",)) -> DataFrame:
    """Each key once with its greatest usable value; pre-aggregated before the shuffle, so a hot key is no burden."""
    return df.where(usable(F.col(value), ignore)).groupBy(key).agg(F.max(value).alias(value))

"""Expressions on residue strings: clean-up, consensus, identity, similarity, rendering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.arrowtext import string_parts, to_strings

#: Residues that count as alike, group by group.
GROUPS = ["GAVLI", "FYW", "CM", "ST", "KRH", "DENQ", "P", "-", "X"]
#: For each residue, the others whose exchange the BLOSUM62 matrix (public) scores at 0 or more. None reaches 6.
EXCHANGES = {
    "A": "CGSTVX", "R": "NQEHKZ", "N": "RDQEGHKSTBZ", "D": "NQESBZ", "C": "A", "Q": "RNDEHKMSBZ", "E": "RNDQHKSBZ", "G": "ANS", "H": "RNQEYBZ",
    "I": "LMFV", "L": "IMFV", "K": "RNQESBZ", "M": "QILFV", "F": "ILMWY", "S": "ANDQEGKTBZX", "T": "ANSVX", "W": "FY", "Y": "HFW", "V": "AILMT",
    "B": "NDQEHKSZ", "Z": "RNDQEHKSB", "X": "AST",
}
PAIRS = " ".join(a + b for a, others in EXCHANGES.items() for b in others)
LETTERS = "".join(GROUPS)
CODES = "".join(chr(97 + k) * len(g) for k, g in enumerate(GROUPS))
SPACER = "~~~~~"


def clean(sequence: Column, truncate: int | None = None) -> Column:
    """Upper case, cut to ``truncate`` residues."""
    return F.upper(sequence if truncate is None else F.substring(sequence, 1, truncate))


def letters(s: Column) -> Column:
    return F.split(s, "")


def consensus(a: Column, b: Column) -> Column:
    """Per column: a space beside a gap, ``|`` for equal residues, ``+`` for an exchange at 0 or more, else ``.``; unknown letters match themselves only."""

    def one(x: Column, y: Column) -> Column:
        return F.when((x == "-") | (y == "-"), " ").when(x == y, "|").when(F.instr(F.lit(PAIRS), F.concat(x, y)) % 3 == 1, "+").otherwise(".")

    return F.array_join(F.zip_with(letters(a), letters(b), one), "")


def _equal_share(a: Column, b: Column) -> Column:
    same = F.zip_with(letters(a), letters(b), lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0)))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.aggregate(same, F.lit(0), lambda n, x: n + x) / F.least(F.length(a), F.length(b)))


def identity(a: Column, b: Column) -> Column:
    """Share of equal columns, gaps included; null for empty strings."""
    return _equal_share(a, b)


def similarity(a: Column, b: Column) -> Column:
    """Share of columns whose residues are of one group; letters outside all groups match themselves only."""
    return _equal_share(F.translate(a, LETTERS, CODES), F.translate(b, LETTERS, CODES))


def render(indices: Column, sequence: Column, axis: str) -> Column:
    """A residue wherever the coordinate of ``axis`` moved on, else a gap."""

    def one(p: Column, i: Column) -> Column:
        fresh = (i == 0) | (p[axis] != F.try_element_at(indices, i)[axis])
        return F.when(fresh, F.substring(sequence, p[axis] + 1, F.lit(1))).otherwise("-")

    return F.array_join(F.transform(indices, one), "")


def relation(indices: Column) -> Column:
    """``|`` where both coordinates moved on, else a space."""

    def one(p: Column, i: Column) -> Column:
        before = F.try_element_at(indices, i)
        return F.when((i == 0) | ((p["y"] != before["y"]) & (p["x"] != before["x"])), "|").otherwise(" ")

    return F.array_join(F.transform(indices, one), "")


def html_alignment(*rows: Column) -> Column:
    """A table of one HTML row per string, a cell per column."""
    lines = [F.concat(F.lit("<tr><td>"), F.array_join(letters(r), "</td><td>"), F.lit("</td></tr>")) for r in rows]
    return F.concat(F.lit("<table>"), *lines, F.lit("</table>"))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Consensus character of two residues, and group of a residue, by byte."""
    con = np.full((256, 256), ord("."), np.uint8)
    for a, others in EXCHANGES.items():
        con[ord(a), list(others.encode())] = ord("+")
    np.fill_diagonal(con, ord("|"))
    con[ord("-"), :] = con[:, ord("-")] = ord(" ")
    group = np.arange(256, dtype=np.int16) + 256
    for k, letters_ in enumerate(GROUPS):
        group[list(letters_.encode())] = k
    return con, group


CON, GROUP = _tables()


def rates_of(a: pa.Array, b: pa.Array) -> pa.StructArray:
    """``con``, ``ident`` and ``similarity`` of aligned strings, a whole Arrow batch at once; all null where either is null, the rates also where either is empty.

    The same as :func:`consensus`, :func:`identity` and :func:`similarity`, for strings of ASCII letters.
    """
    (ao, ar), (bo, br) = string_parts(a), string_parts(b)
    n = np.minimum(np.diff(ao), np.diff(bo))
    out = np.append(0, np.cumsum(n))
    within = np.arange(out[-1]) - np.repeat(out[:-1], n)
    x, y = ar[within + np.repeat(ao[:-1], n)], br[within + np.repeat(bo[:-1], n)]
    full = np.flatnonzero(n)
    rate = np.full((2, len(n)), np.nan)
    for k, same in enumerate((x == y, GROUP[x] == GROUP[y])):
        if len(full):
            rate[k, full] = np.add.reduceat(same.astype(np.int64), out[:-1][full]) / n[full]
    text = to_strings(CON[x, y].tobytes(), out)
    missing = np.asarray(pc.or_(a.is_null(), b.is_null()))
    text = pc.if_else(pa.array(missing), pa.scalar(None, pa.string()), text)
    rates = [pa.array(r, pa.float64(), mask=np.isnan(r) | missing) for r in rate]
    return pa.StructArray.from_arrays([text, *rates], ["con", "ident", "similarity"])


def alignment_rates(a: Column, b: Column) -> Column:
    """``rates_of`` as a column; for tables of many alignments, where the expressions' cost per letter counts."""

    @F.arrow_udf("con string, ident double, similarity double")
    def rates(x: pa.Array, y: pa.Array) -> pa.Array:
        return rates_of(x, y)

    return rates(a, b)

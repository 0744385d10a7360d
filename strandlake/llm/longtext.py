"""Cutting a text that is too long for one pass of the vectorised scanners."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

REACH = 1 << 16
WORDLIKE = re.compile(rb"[A-Za-z] (?=[A-Za-z])|[^\s]\n(?=[A-Za-z])")


def line_pieces(raw: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of about ``size`` bytes that end behind a line end; a longer line is cut behind a space, or else before any character."""
    at = 0
    while len(raw) - at > size:
        window = raw[at : at + size]
        for mark in (10, 13, 32):
            found = np.flatnonzero(window == mark)
            if len(found):
                end = at + int(found[-1]) + 1
                break
        else:
            end = at + int(np.flatnonzero((window & 0xC0) != 0x80)[-1])
        end = end if end > at else min(at + size, len(raw))
        yield at, end
        at = end
    yield at, len(raw)


def token_pieces(raw: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of pieces that end where a pre-token ends whatever stands around: before the space between two letters, or behind a line end between text. Without such a place the piece goes on."""
    at = 0
    while len(raw) - at > size:
        look = at + size
        while look < len(raw):
            chunk = raw[look : look + REACH].tobytes()
            if (m := WORDLIKE.search(chunk)) is not None:
                look += m.start() + 1 + (chunk[m.start() + 1] == 10)
                break
            look += REACH - 2
        if look >= len(raw):
            break
        yield at, look
        at = look
    yield at, len(raw)

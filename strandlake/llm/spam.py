"""Keyword-stuffed and link-list pages, by a hidden Markov model over the lines of a text.

Each line gives a few discrete observations (share of addresses, of function words, of code characters, of words that the
text keeps repeating, whether a neighbour has the same column shape, ...). The model labels the lines as prose, code, data,
link list, tag list or menu; a document is flagged if the last three hold most of its text.

The texts are scanned once; what the lines show is written as one number per line, and the rounds of the fit and the
labels read only that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions.arrowtext import row_slices, string_parts
from strandlake.llm.longtext import line_pieces
from strandlake.session import cut

SLICE_BYTES = 1 << 20
SLICE_LINES = 1 << 15
LONG_BYTES = 4 << 20
#: A document is flagged if more than this share of its text is in link lists, tag lists or menus.
THRESHOLD = 0.5
#: Rounds of the fit; the weight of the prior in each state, in lines; and how far a fitted probability may leave its prior, as a factor.
FIT_ROUNDS, PRIOR_LINES, MOST_DRIFT = 3, 5_000, 1.2
STATES = ["prose", "code", "data", "links", "tags", "menu"]
SPAM = [3, 4, 5]

#: Function words of some languages, which sentences hold and keyword lists don't.
FUNCTION_WORDS = (
    "a about after again all also an and any are as at be because been before but by can could did do does each every for from had has have he her his how "
    "if in into is it its more most must no not of on one only or other our out over same she should so some such than that the their them then there these "
    "they this those to under until up us was we were what when where whether which while who will with would you your "
    "au avec ce cette dans des du elle est et il je la le les mais ne ou par pas pour que qui si sont sur un une "
    "aber als auch auf aus bei das dem den der die ein eine es im ist mit nach nicht oder sich und von wie zu "
    "como con del el en los para pero por sin su y "
    "che da di e della ma non per sono "
    "com em não o os uma "
    "de een het niet op te van "
    "в и на не но по с что"
).split()

CODE_BYTES = b"(){}[]=<>&*!$\\\"_:@^~%`"
#: What a line shows, and into how many values each is divided.
FIELDS = {"links": 4, "function": 3, "code": 4, "repeat": 4, "end": 3, "tight": 4, "digits": 4, "length": 5, "shape": 2, "lead": 4, "items": 3}
_VALUES = np.array(list(FIELDS.values()))
#: A line's values as one number: the weight of each field in it.
_WEIGHTS = np.append(1, np.cumprod(_VALUES[:-1]))
#: Where each field begins in a table of all values of all fields.
_FIRST = np.append(0, np.cumsum(_VALUES))

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_CODE = np.zeros(256, bool)
_CODE[list(CODE_BYTES)] = True
_URL_END = np.zeros(256, bool)
_URL_END[list(b" \t\r\n\"'<>)]|")] = True
#: Separators of cells, if no space stands on either side.
_CELL = np.zeros(256, bool)
_CELL[list(b",;=.\t|")] = True
#: Signs that part the items of a list if they stand between spaces.
_BETWEEN = np.zeros(256, bool)
_BETWEEN[list(b"|/*-")] = True
#: Marks that lead a directive.
_MARK = np.zeros(256, bool)
_MARK[list(b"#@%.")] = True
#: Column shape: letters, digits and spaces count as their kind, every other character as itself, line ends not at all.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 97
_KIND[48:58] = 48
_KIND[[9, 11, 12]] = 32
_KIND[[10, 13]] = 0
#: Ends of sentences beyond ASCII: the ideographic full stop, full-width marks, the Devanagari danda and the Arabic question mark, by their last two bytes.
_STOPS = [(0x80, 0x82), (0xBC, 0x81), (0xBC, 0x9F), (0xA5, 0xA4), (0xD8, 0x9F)]


def _word_hash(word: bytes) -> int:
    h = 0
    for k, c in enumerate(word):
        h = (h + c * pow(0x100000001B3, k, 1 << 64)) % (1 << 64)
    return h * 0x9E3779B97F4A7C15 % (1 << 64)


@dataclass
class LineScanner:
    """Observations of all non-blank lines of a batch of texts."""

    function: np.ndarray = field(default_factory=lambda: np.sort(np.array([_word_hash(w.encode()) for w in set(FUNCTION_WORDS)], np.uint64)))
    up: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    down: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            a, b = np.full(n, 0x100000001B3, np.uint64), np.full(n, pow(0x100000001B3, -1, 1 << 64), np.uint64)
            a[:1] = b[:1] = 1
            with np.errstate(over="ignore"):
                self.up, self.down = np.cumprod(a, dtype=np.uint64), np.cumprod(b, dtype=np.uint64)

    def scan(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Text ordinal and size of each line that isn't blank, and its observation in each of ``FIELDS``.

        A long text is taken in pieces, after its words were counted over all pieces; the counts of a line that was cut are
        added up again, so it counts as one. Only a word above ``LONG_BYTES`` is taken for several.
        """
        if len(offsets) != 2 or len(raw) <= LONG_BYTES:
            return self._digest(self._counts(raw, offsets))
        pieces = list(line_pieces(raw, LONG_BYTES))
        words, counts = (np.concatenate(x) for x in zip(*(self._counts(raw[a:b], np.array([0, b - a]), count_only=True) for a, b in pieces)))
        known, back = np.unique(words, return_inverse=True)
        table = known, np.bincount(back, weights=counts, minlength=len(known)).astype(np.int64)
        parts = [self._counts(raw[a:b], np.array([0, b - a]), table) for a, b in pieces]
        whole = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        begins = np.ones(len(whole["text"]), bool)
        at = 0
        for (a, _), p in zip(pieces, parts):
            begins[at] = a == 0 or raw[a - 1] in (10, 13)
            at += len(p["text"])
        return self._digest(whole if begins.all() else _joined(whole, np.flatnonzero(begins)))

    def _counts(self, raw: np.ndarray, offsets: np.ndarray, table: tuple[np.ndarray, np.ndarray] | None = None, count_only: bool = False):
        """What stands in each line, blank ones included; or, with ``count_only``, the hash of each word and how often it stands."""
        n = len(raw)
        if not n:
            return (np.zeros(0, np.uint64), np.zeros(0, np.int64)) if count_only else {k: np.zeros(0, np.uint64 if k == "shape" else np.int64) for k in _COUNTED}
        starts = offsets[:-1][np.diff(offsets) > 0]
        head = np.zeros(n, bool)
        head[starts] = True
        head[1:] |= (raw[:-1] == 10) | (raw[:-1] == 13)
        begin = np.flatnonzero(head)
        lines = len(begin)
        total = lambda mask: np.add.reduceat(mask, begin, dtype=np.int32)
        url, image = self._addresses(raw, head)

        low = _FOLD[raw]
        part = _WORD[raw] & ~url
        wide = np.flatnonzero((raw[:-1] == 0xC2) & (raw[1:] == 0xA0))  # the no-break space
        part[wide] = part[wide + 1] = False
        first = part.copy()
        first[1:] &= ~part[:-1] | head[1:]
        last = np.zeros(n + 1, bool)
        last[1:n] = part[:-1] & (~part[1:] | first[1:])
        last[n] = part[-1]
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        self._powers(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(low * self.up[:n], dtype=np.uint64, out=sums[1:])
            h = (sums[b] - sums[a]) * self.down[a] * np.uint64(0x9E3779B97F4A7C15)
        line = np.cumsum(head, dtype=np.int32) - 1
        word_line = line[a]
        # the last text that begins at an offset is the one that isn't empty
        text_of_line = np.searchsorted(offsets, begin, side="right") - 1
        place = np.minimum(np.searchsorted(self.function, h), len(self.function) - 1)
        is_function = self.function[place] == h
        if table is None:
            with np.errstate(over="ignore"):
                words_seen, back, count = np.unique(h + text_of_line[word_line].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), return_inverse=True, return_counts=True)
            if count_only:
                return words_seen, count
            times = count[back]
        else:
            times = table[1][np.searchsorted(table[0], h)]
        often = (times >= 4) & ~is_function & ~_DIGIT[raw[a]]
        number = np.bincount(word_line, minlength=lines)

        solid = raw > 32
        tail = np.maximum.reduceat(np.where(solid, np.arange(n), -1), begin)
        front = np.minimum.reduceat(np.where(solid, np.arange(n), n), begin)
        cell = _CELL[raw] & ~url
        cell[1:] &= _WORD[raw[:-1]]
        cell[:-1] &= _WORD[raw[1:]]
        cell[[0, -1]] = False
        cell[1:-1] &= ~((raw[1:-1] == 46) & _DIGIT[raw[:-2]] & _DIGIT[raw[2:]])  # the point of a number
        # what parts the items of a list: commas and semicolons, other signs between spaces, and a number sign before a word
        blank = (raw <= 32) | head
        item = (raw == 44) | (raw == 59)
        item[1:-1] |= _BETWEEN[raw[1:-1]] & blank[:-2] & (raw[2:] <= 32)
        item[1:-1] |= (raw[1:-1] == 35) & _WORD[raw[2:]] & (raw[:-2] == 32)
        mark = _MARK[raw]
        mark[:-1] &= _WORD[raw[1:]] & ~_DIGIT[raw[1:]]
        mark[-1] = False
        mark[1:] &= (raw[:-1] <= 32) | head[1:]
        kind = _KIND[raw]
        keep = kind > 0
        keep[1:] &= (kind[1:] != kind[:-1]) | head[1:]
        held = np.flatnonzero(keep)
        upto = np.searchsorted(held, np.append(begin, n))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(held) + 1, np.uint64)
            np.cumsum(kind[held].astype(np.uint64) * self.up[: len(held)], dtype=np.uint64, out=sums[1:])
            shape = (sums[upto[1:]] - sums[upto[:-1]]) * self.down[upto[:-1]]
        return {
            "text": text_of_line, "solid": total(solid), "url": total(url & ~image & solid), "code": total(_CODE[raw] & ~url), "digits": total(_DIGIT[raw] & ~url), "cells": total(cell),
            "words": number, "function": np.bincount(word_line, weights=is_function, minlength=lines).astype(np.int64), "often": np.bincount(word_line, weights=often, minlength=lines).astype(np.int64),
            "tail": np.where(tail >= 0, raw[tail], 0), "stop": self._stops(raw, tail), "lead": self._leads(raw, begin, front, mark), "marks": total(mark), "shape": shape, "items": total(item & ~url), "equals": total((raw == 61) & ~url), "dense": total((raw >= 0xE3) & (raw <= 0xE9)),
        }

    @staticmethod
    def _addresses(raw: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which bytes belong to an address ``scheme://...``; and which of those to that of an image, which is no link."""
        n = len(raw)
        at = np.flatnonzero(raw[: max(0, n - 3)] == 58)
        at = at[(raw[at + 1] == 47) & (raw[np.minimum(at + 2, n - 1)] == 47) & (at >= 4)]
        if not len(at):
            return np.zeros(n, bool), np.zeros(n, bool)
        stop = np.append(np.flatnonzero(_URL_END[raw] | head), n)
        s = np.maximum(np.where(raw[at - 1] == 115, at - 5, at - 4), 0)
        e = stop[np.searchsorted(stop, at)]

        def covered(s: np.ndarray, e: np.ndarray) -> np.ndarray:
            depth = np.zeros(n + 1, np.int32)
            np.add.at(depth, s, 1)
            np.add.at(depth, e, -1)
            return np.cumsum(depth[:-1]) > 0

        # "![name](address": the bracket that opens last before the address has a "!" before it
        opens = np.flatnonzero(raw == 91)
        k = np.searchsorted(opens, s) - 1
        near = opens[np.maximum(k, 0)] if len(opens) else np.zeros_like(s)
        image = (k >= 0) & (near >= 1) & (s >= 2) & (raw[np.maximum(s - 2, 0)] == 93) & (raw[np.maximum(s - 1, 0)] == 40) & (raw[np.maximum(near - 1, 0)] == 33)
        return covered(s, e), covered(s[image], e[image])

    @staticmethod
    def _leads(raw: np.ndarray, begin: np.ndarray, front: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """How each line begins: with a mark and a name (1), a mark of a comment, heading or rule (2), spaces (3), or otherwise (0)."""
        last = len(raw) - 1
        a, b = raw[np.minimum(front, last)], raw[np.minimum(front + 1, last)]
        comment = ((a == 35) & ((b == 32) | (b == 35))) | ((a == 47) & ((b == 47) | (b == 42))) | ((a == 45) & (b == 45))
        return np.where(mark[np.minimum(front, last)], 1, np.where(comment, 2, np.where(front > begin, 3, 0)))

    @staticmethod
    def _stops(raw: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Whether the last solid bytes end a sentence."""
        own, before = raw[tail], raw[np.maximum(tail - 1, 0)]
        out = np.isin(own, np.frombuffer(b".!?", np.uint8))
        for x, y in _STOPS:
            out |= (before == x) & (own == y)
        return out & (tail >= 0)

    @staticmethod
    def _digest(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        full = c["solid"] > 0
        c = {k: v[full] for k, v in c.items()}
        share = lambda part, whole: part / np.maximum(whole, 1)
        text, words, shape = c["text"], c["words"], c["shape"]
        alike = (shape[1:] == shape[:-1]) & (text[1:] == text[:-1])
        long = words + c["dense"] // 2  # two ideographs or kana count as a word
        statement = np.isin(c["tail"], np.frombuffer(b";{}(=", np.uint8))
        seen = {
            "links": np.digitize(share(c["url"], c["solid"]), [0.01, 0.2, 0.45]),
            "function": np.digitize(share(c["function"], words), [1e-9, 0.09]),
            "code": np.digitize(share(c["code"], c["solid"]), [0.012, 0.045, 0.12]),
            "repeat": np.digitize(share(c["often"], words - c["function"]), [0.2, 0.5, 0.8]),
            "end": np.where((c["stop"] > 0) & (long >= 4), 1, np.where(statement, 2, 0)),
            "tight": np.where((c["equals"] == 1) & (words > 0), 3, np.digitize(share(c["cells"], words), [0.04, 0.4])),  # 3: an assignment
            "digits": np.digitize(share(c["digits"], c["solid"]), [0.05, 0.25, 0.6]),
            "length": np.digitize(long, [2, 3, 9, 40]),
            "shape": np.append(False, alike) | np.append(alike, False) if len(text) else np.zeros(0, bool),
            "lead": np.where((c["lead"] == 1) & ((c["marks"] > 1) | (words < 2)), 0, c["lead"]),
            "items": np.where(words < 4, 0, np.digitize(share(c["items"], words), [0.12, 0.3])),
        }
        return text, c["solid"], {k: v.astype(np.int8) for k, v in seen.items()}


_COUNTED = ["text", "solid", "url", "code", "digits", "cells", "words", "function", "often", "tail", "stop", "lead", "marks", "shape", "items", "equals", "dense"]


def _joined(c: dict[str, np.ndarray], begin: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of whole lines out of those of their pieces, which begin at ``begin``."""
    out = {}
    for k, v in c.items():
        if k in ("text", "lead"):
            out[k] = v[begin]
        elif k == "shape":
            with np.errstate(over="ignore"):
                out[k] = np.add.reduceat(v, begin)
        elif k in ("tail", "stop"):  # of the last piece that isn't blank
            last = np.maximum.reduceat(np.where(c["solid"] > 0, np.arange(len(v)), -1), begin)
            out[k] = np.where(last >= 0, v[last], 0)
        else:
            out[k] = np.add.reduceat(v, begin)
    return out


#: The model before it is fitted: how often each value of each field is expected, as weights in a state.
PRIOR_EMISSION = {
    "prose": {"links": [80, 10, 7, 3], "function": [6, 14, 80], "code": [66, 22, 9, 3], "repeat": [70, 22, 6, 2], "end": [22, 76, 2], "tight": [80, 16, 2.5, 1.5], "digits": [86, 12, 1.5, 0.5], "length": [2, 3, 12, 71, 12], "shape": [97, 3], "lead": [88, 2, 6, 4], "items": [88, 11, 1]},
    "code": {"links": [92, 4, 3, 1], "function": [66, 22, 12], "code": [16, 16, 22, 46], "repeat": [38, 20, 18, 24], "end": [56, 5, 39], "tight": [30, 20, 28, 22], "digits": [60, 24, 12, 4], "length": [27, 19, 37, 14, 3], "shape": [75, 25], "lead": [40, 14, 10, 36], "items": [60, 20, 20]},
    "data": {"links": [97, 1, 1, 1], "function": [90, 7, 3], "code": [62, 24, 9, 5], "repeat": [45, 22, 20, 13], "end": [97, 2, 1], "tight": [2, 4, 86, 8], "digits": [10, 24, 40, 26], "length": [6, 14, 68, 10, 2], "shape": [8, 92], "lead": [92, 3, 2, 3], "items": [3, 7, 90]},
    "links": {"links": [2, 2, 6, 90], "function": [88, 4, 8], "code": [20, 5, 25, 50], "repeat": [30, 20, 20, 30], "end": [97, 2, 1], "tight": [70, 6, 2, 22], "digits": [96, 3, 0.7, 0.3], "length": [10, 24, 60, 5, 1], "shape": [70, 30], "lead": [89, 1, 3, 7], "items": [70, 20, 10]},
    "tags": {"links": [96, 2, 1, 1], "function": [88, 9, 3], "code": [70, 20, 7, 3], "repeat": [2, 8, 24, 66], "end": [95, 2, 3], "tight": [69, 12, 18, 1], "digits": [83, 14, 2.5, 0.5], "length": [1, 2, 14, 34, 49], "shape": [60, 40], "lead": [85, 1, 11, 3], "items": [45, 10, 45]},
    "menu": {"links": [95, 3, 1, 1], "function": [94, 4, 2], "code": [90, 6, 3, 1], "repeat": [4, 16, 50, 30], "end": [98, 1, 1], "tight": [71, 25, 3, 0.5], "digits": [64, 23, 12, 1], "length": [2, 13, 79, 5, 1], "shape": [50, 50], "lead": [95.5, 0.5, 3, 1], "items": [75, 15, 10]},
}
#: Weights of the first line's state, and of the next line's state being the same one.
PRIOR_FIRST = [30, 36, 4, 10, 10, 10]
PRIOR_STAY = [70, 92, 92, 90, 85, 90]


def pack(seen: dict[str, np.ndarray]) -> np.ndarray:
    """The values of each line as one number."""
    return sum(seen[f].astype(np.int32) * int(w) for f, w in zip(FIELDS, _WEIGHTS))


@dataclass
class LineModel:
    """Probabilities of a hidden Markov model over ``STATES``: of the first state, of each step, and of each value of each field, laid end to end, in each state."""

    first: np.ndarray
    step: np.ndarray
    emission: np.ndarray

    @classmethod
    def prior(cls) -> LineModel:
        k = len(STATES)
        stay = np.array(PRIOR_STAY, float) / 100
        step = np.repeat(((1 - stay) / (k - 1))[:, None], k, axis=1)
        np.fill_diagonal(step, stay)
        emission = np.concatenate([_shares(np.array([PRIOR_EMISSION[s][f] for s in STATES], float)) for f in FIELDS], axis=1)
        return cls(_shares(np.array(PRIOR_FIRST, float)), step, emission)

    @classmethod
    def refitted(cls, counts: np.ndarray) -> LineModel:
        """The model of these expected counts (as :meth:`expected` gives them) and the prior, which weighs as ``PRIOR_LINES`` lines in each state.

        No probability leaves its prior by more than the factor ``MOST_DRIFT``: a kind of line that none of the states was
        made for can't change what a state stands for.
        """
        prior, k = cls.prior(), len(STATES)
        first, step, seen = counts[:k], counts[k : k + k * k].reshape(k, k), counts[k + k * k :].reshape(k, -1)
        fields = [_near(prior.emission[:, a:b], seen[:, a:b]) for a, b in zip(_FIRST, _FIRST[1:])]
        return cls(_near(prior.first, first), _near(prior.step, step), np.concatenate(fields, axis=1))

    def likelihood(self, code: np.ndarray) -> np.ndarray:
        """Log likelihood of each line in each state."""
        kinds, back = np.unique(code, return_inverse=True)
        columns = _FIRST[:-1] + kinds[:, None] // _WEIGHTS % _VALUES
        return np.log(self.emission)[:, columns].sum(axis=2).T[back]

    def expected(self, text: np.ndarray, code: np.ndarray) -> np.ndarray:
        """How often each first state, each step and each value in each state is expected, over all ways through each text (forward and backward passes)."""
        k = len(STATES)
        if not len(text):
            return np.zeros(k + k * k + self.emission.size)
        score = self.likelihood(code)
        score = np.exp(score - score.max(axis=1, keepdims=True))
        begin, length = _texts(text)
        ahead, back = np.empty_like(score), np.ones_like(score)
        ahead[begin] = _shares(self.first * score[begin])
        for t in range(1, int(length[0])):
            here = begin[: int(np.searchsorted(-length, -t, side="left"))] + t
            ahead[here] = _shares(ahead[here - 1] @ self.step * score[here])
        steps = np.zeros((k, k))
        for t in range(int(length[0]) - 1, 0, -1):
            here = begin[: int(np.searchsorted(-length, -t, side="left"))] + t
            onward = score[here] * back[here]
            behind = onward @ self.step.T
            steps += (ahead[here - 1] / (ahead[here - 1] * behind).sum(axis=1, keepdims=True)).T @ onward
            back[here - 1] = _shares(behind)
        state = _shares(ahead * back)
        kinds, inverse = np.unique(code, return_inverse=True)
        by_kind = np.stack([np.bincount(inverse, weights=state[:, s], minlength=len(kinds)) for s in range(k)])
        columns = _FIRST[:-1] + kinds[:, None] // _WEIGHTS % _VALUES
        emitted = np.zeros(self.emission.shape)
        for c in columns.T:
            np.add.at(emitted, (slice(None), c), by_kind)
        return np.concatenate([state[begin].sum(axis=0), (steps * self.step).ravel(), emitted.ravel()])

    def label(self, text: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Most probable states of all lines: the texts of a batch step forward together, the longest ones last."""
        if not len(text):
            return np.zeros(0, np.int8)
        score, step = self.likelihood(code), np.log(self.step)
        begin, length = _texts(text)
        best = np.empty_like(score)
        came = np.zeros(score.shape, np.int8)
        best[begin] = np.log(self.first) + score[begin]
        for t in range(1, int(length[0])):
            here = begin[: int(np.searchsorted(-length, -t, side="left"))] + t
            ways = best[here - 1][:, :, None] + step
            came[here] = ways.argmax(axis=1)
            best[here] = ways.max(axis=1) + score[here]
        state = np.zeros(len(text), np.int8)
        end = begin + length - 1
        state[end] = best[end].argmax(axis=1)
        for t in range(int(length[0]) - 1, 0, -1):
            here = begin[: int(np.searchsorted(-length, -t, side="left"))] + t
            state[here - 1] = came[here, state[here]]
        return state


def _shares(m: np.ndarray) -> np.ndarray:
    return m / m.sum(axis=-1, keepdims=True)


def _near(prior: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shares of the counts and the prior, none further from its prior than the factor ``MOST_DRIFT``: what a bound takes or gives is shared by the others."""
    low, high = prior / MOST_DRIFT, prior * MOST_DRIFT
    free = _shares(prior * PRIOR_LINES + counts)
    # the scale at which the bounded shares add up to 1, by bisection; at 1 / MOST_DRIFT ** 2 ... all are at a bound
    a, b = np.full((*prior.shape[:-1], 1), -50.0), np.full((*prior.shape[:-1], 1), 50.0)
    for _ in range(60):
        mid = (a + b) / 2
        over = np.clip(free * np.exp(mid), low, high).sum(axis=-1, keepdims=True) > 1
        a, b = np.where(over, a, mid), np.where(over, mid, b)
    return _shares(np.clip(free * np.exp((a + b) / 2), low, high))


def _texts(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of each text, the longest text first."""
    begin = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    length = np.diff(np.append(begin, len(text)))
    order = np.argsort(-length, kind="stable")
    return begin[order], length[order]


def observe_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, seen, size)``: of each text the non-blank lines in order, as one number each (:func:`pack`), and their bytes that aren't white space. Written once."""
    kind = T.StructType([docs.schema[key], T.StructField("seen", T.ArrayType(T.IntegerType())), T.StructField("size", T.ArrayType(T.IntegerType()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LineScanner()
        for batch in batches:
            offsets, raw = string_parts(batch.column(1))
            for a, b in row_slices(offsets, SLICE_BYTES):
                line_text, size, seen = scanner.scan(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at = pa.array(np.searchsorted(line_text, np.arange(b - a + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(v, pa.int32())) for v in (pack(seen), size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists], kind.fieldNames())

    return cut(docs.select(key, text).mapInArrow(scan, kind), "lines")


def _line_slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows ``a`` to ``b`` of a batch of :func:`observe_lines`, and text ordinal, number and size of their lines."""
    seen, size = batch.column("seen"), batch.column("size")
    at = np.append(0, np.cumsum(seen.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
    codes, sizes = seen.flatten().to_numpy(), size.flatten().to_numpy()
    for a, b in row_slices(at, SLICE_LINES):
        yield a, b, np.repeat(np.arange(b - a), np.diff(at[a : b + 1])), codes[at[a] : at[b]], sizes[at[a] : at[b]]


def fit_line_model(lines: DataFrame, rounds: int = FIT_ROUNDS) -> LineModel:
    """Expectation and maximisation over all lines of :func:`observe_lines`, from the prior.

    Each round reads all lines; a task gives one table of some 300 expected counts (in thousandths), and only their sum gets to the driver.
    """
    model = LineModel.prior()
    for _ in range(rounds):
        sent = lines.sparkSession.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for _, _, text, code, _ in _line_slices(batch):
                    own = sent.value.expected(text, code)
                    total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(np.rint(total * 1000).astype(np.int64))], ["k", "n"])

        rows = lines.select("seen", "size").mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
        sent.unpersist()
        if not rows:
            break
        n = np.zeros(len(rows))
        for k, c in rows:
            n[k] = c / 1000
        model = LineModel.refitted(n)
    return model


def label_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", model: LineModel | None = None) -> DataFrame:
    """``(key, lines, prose, code, data, links, tags, menu, spam_share)``: how much of each text (in bytes that aren't white space) is in lines of each kind.

    Without a ``model`` one is fitted on all of ``docs``.

    Defined results: null, empty and blank texts have no lines and a share of 0; repeated rows are labelled each for itself;
    a text of any length is read whole; an empty table gives no row; other columns, of any name, are ignored.
    """
    lines = observe_lines(docs, key, text)
    fitted = docs.sparkSession.sparkContext.broadcast(model or fit_line_model(lines))
    fields = [docs.schema[key], T.StructField("lines", T.LongType()), *(T.StructField(s, T.LongType()) for s in STATES), T.StructField("spam_share", T.DoubleType())]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, k = fitted.value, len(STATES)
        for batch in batches:
            for a, b, line_text, code, size in _line_slices(batch):
                n = b - a
                state = model.label(line_text, code)
                bytes_in = np.bincount(line_text * k + state, weights=size, minlength=n * k).reshape(n, k).astype(np.int64)
                share = bytes_in[:, SPAM].sum(axis=1) / np.maximum(bytes_in.sum(axis=1), 1)
                columns = [pa.array(np.bincount(line_text, minlength=n).astype(np.int64)), *(pa.array(bytes_in[:, s]) for s in range(k)), pa.array(share)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), *columns], [f.name for f in fields])

    return lines.mapInArrow(mark, T.StructType(fields))


def find_spam_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, model: LineModel | None = None) -> DataFrame:
    """``(key)`` of the documents most of whose text is in link lists, tag lists or menus; see :func:`label_pages`. Each key once."""
    return label_pages(docs, key, text, model).where(F.col("spam_share") > threshold).select(key).distinct()

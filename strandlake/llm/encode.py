"""Encoding of a corpus with a byte-level BPE vocabulary.

Whole batches are cut into pre-tokens by vectorised rules on character classes. A pre-token that is in the vocabulary is
resolved by a minimal perfect hash on its bytes; each distinct other one is merged once, with a heap over linked bytes.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandlake.functions.arrowtext import row_slices, string_parts
from strandlake.llm.longtext import token_pieces

SLICE_BYTES = 1 << 20
CACHE_WORDS = 400_000
WIDE = 16  # bytes of a pre-token that fit the hash's two machine words

#: The characters that the pre-tokenizer's pattern treats as white space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The endings that the pattern splits off after an apostrophe.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]

OTHER, LETTER, NUMBER, SPACE, BLANK = range(5)  # BLANK is the space character itself
MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """The vocabulary's file: in the folder of the public tokenizers, or in ``/opt/tokenizers``."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def load_ranks(path: str) -> tuple[dict[bytes, int], dict[bytes, int]]:
    """Ids of all tokens, and the merge rank of those that a merge makes, by their bytes."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return ids, ids
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {x["content"] for x in model.get("added_tokens", [])}
    plain = lambda t: bytes(shown[c] for c in t)
    ids = {plain(t): i for t, i in model["model"]["vocab"].items() if t not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    return ids, {plain(a + b): k for k, (a, b) in enumerate(merges)}


def merge_bytes(word: bytes, ids: dict[bytes, int], ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges in order of rank, leftmost first, by a heap over linked pieces."""
    n = len(word)
    end = list(range(1, n + 1))  # of the piece that begins here
    prev = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := end[i]) >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := prev[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return [ids[word[i : end[i]]] for i in range(n) if alive[i]]


def _mix(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + n.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def key_words(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two machine words for each word: its bytes, or, of one above ``WIDE`` bytes, its first eight, and its next and last eight mixed."""
    padded = np.append(raw, np.zeros(WIDE, np.uint8))
    view = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    low, high = view[at] & MASK[np.minimum(size, 8)], view[at + 8] & MASK[np.clip(size - 8, 0, 8)]
    wide = np.flatnonzero(size > WIDE)
    with np.errstate(over="ignore"):
        high[wide] = high[wide] * np.uint64(0x9FB21C651E98DF25) ^ view[at[wide] + size[wide] - 8]
    return low, high


@dataclass
class PerfectHash:
    """Minimal perfect hash of words by their size and :func:`key_words`: as many slots as words, found by one displacement per bucket."""

    shift: np.ndarray  # by bucket; a negative one names the slot itself
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray
    value: np.ndarray

    @staticmethod
    def slots(h: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            g = (h ^ (np.maximum(shift, 0).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xFF51AFD7ED558CCD)
        return np.where(shift < 0, -shift - 1, ((g >> np.uint64(32)) % np.uint64(n)).astype(np.int64))

    @classmethod
    def build(cls, words: list[bytes], values: list[int]) -> PerfectHash:
        n = len(words)
        size = np.array([len(w) for w in words], np.int64)
        low, high = key_words(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)
        if len(set(zip(low.tolist(), high.tolist(), size.tolist()))) < n:
            raise ValueError("two long words of the vocabulary have the same key")
        h = _mix(low, high, size)
        buckets = max(1, n // 4)
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        count = np.bincount(bucket, minlength=buckets)
        begin = np.cumsum(count) - count
        shift, taken, place = np.zeros(buckets, np.int64), np.zeros(n, bool), np.zeros(n, np.int64)
        tries = np.arange(1 << 10, dtype=np.int64)
        for b in np.argsort(-count, kind="stable"):
            mine = order[begin[b] : begin[b] + count[b]]
            if len(mine) < 2:
                break
            base = 0
            while True:
                at = cls.slots(h[mine][None, :], (tries + base)[:, None], n)
                free = ~taken[at].any(axis=1)
                for k in np.flatnonzero(free):
                    if len(set(at[k].tolist())) == len(mine):
                        break
                else:
                    base += len(tries)
                    continue
                shift[b], place[mine] = base + k, at[k]
                taken[at[k]] = True
                break
        single = np.flatnonzero(count == 1)
        spare = np.flatnonzero(~taken)[: len(single)]
        shift[single] = -spare - 1
        place[order[begin[single]]] = spare
        out = cls(shift, *(np.empty(n, t) for t in (np.uint64, np.uint64, np.int64, np.int32)))
        out.low[place], out.high[place], out.size[place], out.value[place] = low, high, size, values
        return out

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Values of the words, -1 of others."""
        h = _mix(low, high, size)
        at = self.slots(h, self.shift[(h % np.uint64(len(self.shift))).astype(np.int64)], len(self.value))
        hit = (self.low[at] == low) & (self.high[at] == high) & (self.size[at] == size)
        return np.where(hit, self.value[at], -1)


def character_classes() -> np.ndarray:
    """Class of every code point."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    kind = {"L": LETTER, "N": NUMBER}
    table[:] = [kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)]
    table[WHITE_SPACE] = SPACE
    table[0x20] = BLANK
    return table


class Encoder:
    """What a task needs to encode; made once by the driver and broadcast (a few MB, given by the vocabulary)."""

    def __init__(self, path: str):
        self.ids, self.ranks = load_ranks(path)
        # a word of the vocabulary that merging wouldn't reach isn't resolved whole
        whole = [w for w in self.ids if merge_bytes(w, self.ids, self.ranks) == [self.ids[w]]]
        self.hash = PerfectHash.build(whole, [self.ids[w] for w in whole])
        self.long = {self.ids[w]: w for w in whole if len(w) > WIDE}  # these are compared byte by byte
        self.classes = character_classes()
        self.cache: dict[bytes, list[int]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def words(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Byte offsets at which pre-tokens begin; ``starts`` are those of the (non-empty) texts."""
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        if len(lead) == len(raw):
            code, c = raw, self.classes[:128][raw]
        else:
            code = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            c = self.classes[code]
        n = len(c)
        head = np.zeros(n + 1, bool)
        head[np.searchsorted(lead, starts)] = True
        head[n] = True
        group = np.where(c == BLANK, SPACE, c)
        begin = head.copy()
        begin[1:n] |= group[1:] != group[:-1]
        space = group == SPACE
        # the last white space before something else: the space character goes with what follows, another one stands alone
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~head[1:n])
        begin[last] = True
        begin[last[c[last] == BLANK] + 1] = False
        tick = np.flatnonzero((code == 0x27) & begin[:n])
        if len(tick):
            ahead = np.append(code, np.zeros(3, code.dtype))
            heads = np.append(head, [True, True])
            for ending in ENDINGS:
                k = len(ending)
                ok = np.ones(len(tick), bool)
                for j, ch in enumerate(ending, 1):
                    ok &= (ahead[tick + j] == ord(ch)) & ~heads[np.minimum(tick + j, n + 2)]
                hit = tick[ok]
                begin[hit + 1] = False
                begin[hit + 1 + k] = True
        return lead[np.flatnonzero(begin[:n])]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and the number of ids of each."""
        n_texts = len(offsets) - 1
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(n_texts, np.int64)
        starts = offsets[:-1][np.diff(offsets) > 0]
        at = self.words(raw, starts)
        size = np.diff(np.append(at, len(raw)))
        found = self.hash.find(*key_words(raw, at, size), size)
        for k in np.flatnonzero((found >= 0) & (size > WIDE)).tolist():
            if raw[at[k] : at[k] + size[k]].tobytes() != self.long[int(found[k])]:
                found[k] = -1
        miss = np.flatnonzero(found < 0)
        count = np.ones(len(at), np.int64)
        if len(miss):
            data, cache = raw.tobytes(), self.cache
            if len(cache) > CACHE_WORDS:
                cache.clear()
            rest: list[int] = []
            sizes = np.empty(len(miss), np.int64)
            for k, (a, b) in enumerate(zip(at[miss].tolist(), (at[miss] + size[miss]).tolist())):
                word = data[a:b]
                ids = cache.get(word)
                if ids is None:
                    ids = merge_bytes(word, self.ids, self.ranks)
                    if b - a <= 64:
                        cache[word] = ids
                rest += ids
                sizes[k] = len(ids)
            count[miss] = sizes
            out = np.empty(int(count.sum()), np.int32)
            single = np.ones(len(out), bool)
            first = np.cumsum(count) - count
            filler = np.repeat(first[miss] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            single[filler] = False
            out[single] = found[found >= 0]
            out[filler] = rest
        else:
            out = found.astype(np.int32)
        per_text = np.add.reduceat(count, np.searchsorted(at, starts)) if len(starts) else np.zeros(0, np.int64)
        result = np.zeros(n_texts, np.int64)
        result[np.diff(offsets) > 0] = per_text
        return out, result


def encode_corpus(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``(key, ids)``: the ids of each text without special tokens; strings of special tokens are ordinary text.

    Defined results: null and empty texts give an empty list; repeated rows are encoded each for itself; a text of any
    length is encoded whole; an empty table gives no row; other columns, of any name, are ignored.
    """
    encoder = df.sparkSession.sparkContext.broadcast(Encoder(path or vocabulary_path()))
    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder.value
        for batch in batches:
            offsets, raw = string_parts(batch.column(1))
            for a, b in row_slices(offsets, SLICE_BYTES):
                own, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                if b - a > 1 or len(own) <= 2 * SLICE_BYTES:
                    ids, counts = coder.encode(own, at)
                else:
                    parts = [coder.encode(own[x:y], np.array([0, y - x]))[0] for x, y in token_pieces(own, SLICE_BYTES)]
                    ids, counts = np.concatenate(parts), np.array([sum(map(len, parts))])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], [key, "ids"])

    return df.select(key, text).mapInArrow(scan, schema)

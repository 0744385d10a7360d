"""Evaluation passages in training text: documents that share a run of words with a held-out item.

Words are maximal runs of ASCII letters and digits, in lower case. The items' word windows are hashed once; the corpus
is scanned in place, window by window, against that set, and each hit is compared word by word. A long text is taken in
pieces that hand their last words over, so its length changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions.arrowtext import row_slices, string_parts
from strandlake.session import broadcast_if_small, cut

WINDOW = 12
SLICE_BYTES = 2 << 20
BITS = 20
BASE, STEP = 0x100000001B3, 0x9E3779B97F4A7C15
WORD = re.compile(rb"[0-9a-z]+")
#: Items broadcast at once, and bytes of their prompts; a longer prompt is taken in pieces of half of that.
MAX_ITEMS, MAX_BYTES = 50_000, 8 << 20

LOWER = np.zeros(256, np.uint8)  # 0: not part of a word
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    LOWER[_c] = _c
    LOWER[bytes([_c]).upper()[0]] = _c


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


class Windows:
    """Word bounds and window hashes of texts."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.back = pow(BASE, -1, 1 << 64)
        self.up = self.down = np.zeros(0, np.uint64)

    def words(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-case bytes (0 between words), begin and end of each word, and its hash."""
        low = LOWER[raw]
        part = low != 0
        n = len(raw)
        begins = part.copy()
        begins[1:] &= ~part[:-1]
        edge = offsets[(offsets > 0) & (offsets < n)]
        begins[edge] |= part[edge]
        ends = np.zeros(n + 1, bool)
        ends[1:n] = part[:-1] & (~part[1:] | begins[1:])
        ends[n] = bool(n) and part[-1]
        a, b = np.flatnonzero(begins), np.flatnonzero(ends)
        if len(self.up) < n + 1:
            self.up, self.down = _powers(n + 1, BASE), _powers(n + 1, self.back)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(low * self.up[:n], dtype=np.uint64, out=total[1:])
            h = (total[b] - total[a]) * self.down[a] + (b - a).astype(np.uint64)
            h ^= h >> np.uint64(31)
            h *= np.uint64(STEP)
            h ^= h >> np.uint64(29)
        return low, a, b, h

    def hashes(self, h: np.ndarray) -> np.ndarray:
        """Hash of the window that begins at each word; the last ``window - 1`` words begin none."""
        m = len(h) - self.window + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(m, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.window):
                out = out * np.uint64(BASE) + h[k : k + m]
            out *= np.uint64(STEP)
            out ^= out >> np.uint64(32)
        return out


def normal_words(text: str) -> list[bytes]:
    return WORD.findall(LOWER[np.frombuffer(text.encode(), np.uint8)].tobytes()) if text else []


class LeakIndex:
    """The items' windows: sorted hashes with a bit map before them, and the words and items of each."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.window = window
        self.items: dict[bytes, list[int]] = {}
        self.longest = 0
        for item, prompt in items:
            words = normal_words(prompt)
            self.longest = max(self.longest, max(map(len, words), default=0))
            for k in range(len(words) - window + 1):
                owners = self.items.setdefault(b" ".join(words[k : k + window]), [])
                if item not in owners:
                    owners.append(item)
        texts = list(self.items)
        raw = np.frombuffer(b" ".join(texts), np.uint8)
        made = Windows(window)
        h = made.hashes(made.words(raw, np.array([0, len(raw)]))[3])[::window] if texts else np.zeros(0, np.uint64)
        self.sorted = np.sort(h)
        self.map = np.zeros(1 << BITS, bool)
        self.map[(h >> np.uint64(64 - BITS)).astype(np.int64)] = True
        self._windows: Windows | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_windows": None}

    def scan(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[int], int, int]]:
        """Text ordinal, items, and byte bounds of every window that stands in an item."""
        if self._windows is None:
            self._windows = Windows(self.window)
        if not len(raw) or not len(self.sorted):
            return
        if len(offsets) == 2 and len(raw) > 2 * SLICE_BYTES:
            yield from self._scan_long(raw)
            return
        low, a, b, h = self._windows.words(raw, offsets)
        near = self._near(h)
        text_of = np.searchsorted(offsets, a[near], side="right") - 1
        inside = b[near + self.window - 1] <= offsets[text_of + 1]
        for k, t in zip(near[inside].tolist(), text_of[inside].tolist()):
            words = b" ".join(low[x:y].tobytes() for x, y in zip(a[k : k + self.window].tolist(), b[k : k + self.window].tolist()))
            if owners := self.items.get(words):
                yield t, owners, int(a[k]), int(b[k + self.window - 1])

    def _near(self, h: np.ndarray) -> np.ndarray:
        """Where windows begin whose hash is that of an item's window."""
        g = self._windows.hashes(h)
        near = np.flatnonzero(self.map[(g >> np.uint64(64 - BITS)).astype(np.int64)])
        place = np.searchsorted(self.sorted, g[near])
        return near[self.sorted[np.minimum(place, len(self.sorted) - 1)] == g[near]]

    def _scan_long(self, raw: np.ndarray) -> Iterator[tuple[int, list[int], int, int]]:
        """One text, piece by piece: the last ``window - 1`` words of each piece stand before those of the next one."""
        keep = self.window - 1
        held: list[bytes] = []
        held_a, held_b, held_h = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for at, end, giant in word_pieces(raw, SLICE_BYTES, self.longest):
            if giant:  # a word longer than any of the items': it matches none, and no window reaches over it
                held, held_a, held_b, held_h = [], held_a[:0], held_b[:0], held_h[:0]
                continue
            own = raw[at:end]
            low, a, b, h = self._windows.words(own, np.array([0, len(own)]))
            c = len(held)
            all_a, all_b, all_h = np.append(held_a, a + at), np.append(held_b, b + at), np.append(held_h, h)

            def word(k: int, held=held, low=low, a=a, b=b, c=c) -> bytes:
                return held[k] if k < c else low[a[k - c] : b[k - c]].tobytes()

            for k in self._near(all_h).tolist():
                if owners := self.items.get(b" ".join(word(j) for j in range(k, k + self.window))):
                    yield 0, owners, int(all_a[k]), int(all_b[k + keep])
            rest = max(0, len(all_h) - keep)
            held = [word(k) for k in range(rest, len(all_h))]
            held_a, held_b, held_h = all_a[rest:], all_b[rest:], all_h[rest:]


def word_pieces(raw: np.ndarray, size: int, longest: int) -> Iterator[tuple[int, int, bool]]:
    """Bounds of pieces of about ``size`` bytes that cut no word; a word longer than both ``size`` and ``longest`` is a piece of its own, marked as such."""
    at = 0
    while at < len(raw):
        end = min(at + size, len(raw))
        if end == len(raw):
            yield at, end, False
            return
        gaps = np.flatnonzero(LOWER[raw[at:end]] == 0)
        if len(gaps):
            end = at + int(gaps[-1]) + 1
            yield at, end, False
        else:
            while end < len(raw):
                gaps = np.flatnonzero(LOWER[raw[end : end + size]] == 0)
                if len(gaps):
                    end += int(gaps[0])
                    break
                end = min(end + size, len(raw))
            yield at, end, end - at > max(size, longest)
        at = end


def _prompts(eval_items: DataFrame, item: str, prompt: str, window: int, max_bytes: int) -> DataFrame:
    """``(item, prompt)`` of the items, each once; a prompt above ``max_bytes`` in pieces that share ``window - 1`` words."""
    rows = eval_items.where(F.col(item).isNotNull() & F.col(prompt).isNotNull()).select(item, prompt).distinct()
    kind = rows.schema

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = [], []
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = normal_words(text)
                upto = np.cumsum([len(w) + 1 for w in words])
                first = 0
                while first < len(words) - window + 1:
                    last = int(np.searchsorted(upto, (upto[first - 1] if first else 0) + max_bytes, side="right"))
                    last = max(last, first + window)
                    keys.append(key)
                    texts.append(b" ".join(words[first:last]).decode())
                    if last >= len(words):
                        break
                    first = last - window + 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(texts, batch.schema.field(1).type)], kind.fieldNames())

    long = F.octet_length(prompt) > max_bytes
    return rows.where(~long).unionByName(rows.where(long).mapInArrow(parted, kind))


def _indexes(eval_items: DataFrame, item: str, prompt: str, window: int, max_items: int, max_bytes: int) -> Iterator[LeakIndex]:
    """Indexes of blocks of items: of about ``max_items`` prompts and ``max_bytes`` bytes at most. Each costs one scan of the corpus."""
    prompts = _prompts(eval_items, item, prompt, window, max_bytes // 2)
    n, size = prompts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(prompt)), F.lit(0))).first()
    blocks = max(1, -(-n // max_items), -(-2 * size // max_bytes) if size > max_bytes else 1)
    for k in range(blocks):
        own = prompts if blocks == 1 else prompts.where(F.pmod(F.xxhash64(item, prompt), F.lit(blocks)) == k)
        yield LeakIndex([(r[0], r[1]) for r in own.collect()], window)  # bounded by max_items and max_bytes


def find_leaks(docs: DataFrame, eval_items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", prompt: str = "prompt", window: int = WINDOW, max_items: int = MAX_ITEMS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``(key, item)``: each document that has ``window`` words in a row that also stand in a row in the item's prompt.

    About ``max_items`` items, and ``max_bytes`` bytes of prompts, are broadcast at once; more are taken in blocks, one scan each.

    Defined results: null and empty texts or prompts, and prompts shorter than the window, give no row; prompts listed
    under several items give a row for each; rows with an equal key are one document; rows with a null item are left
    out; line ends and all other characters only part words; a text or prompt of any length is read whole; other columns,
    of any name, are ignored.
    """
    spark = docs.sparkSession
    schema = T.StructType([docs.schema[key], T.StructField(item, eval_items.schema[item].dataType)])
    found = None
    for made in _indexes(eval_items, item, prompt, window, max_items, max_bytes):
        index = spark.sparkContext.broadcast(made)

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                offsets, raw = string_parts(batch.column(1))
                for a, b in row_slices(offsets, SLICE_BYTES):
                    pairs = list({(t, o): None for t, owners, _, _ in index.value.scan(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for o in owners})
                    if pairs:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([a + t for t, _ in pairs])), pa.array([o for _, o in pairs], batch_type)], [key, item])

        batch_type = pa.int64() if isinstance(schema[item].dataType, T.LongType) else pa.int32() if isinstance(schema[item].dataType, T.IntegerType) else pa.string()
        part = docs.select(key, text).mapInArrow(scan, schema)
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def remove_leaks(docs: DataFrame, eval_items: DataFrame, *, how: str = "spans", key: str = "doc_id", text: str = "text", item: str = "item_id", prompt: str = "prompt", window: int = WINDOW, max_items: int = MAX_ITEMS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The corpus without leaked passages: ``how="spans"`` cuts them out of the text, ``how="documents"`` drops the documents.

    A span reaches from the first to the last byte of the joined windows of all items: if these are taken in blocks, each
    block is looked for in the original text, and the spans of all are cut at once. Defined results: texts without a leak, null and
    empty ones are unchanged; repeated rows are treated each for itself; all columns are kept.
    """
    if how == "documents":
        leaked = find_leaks(docs, eval_items, key=key, text=text, item=item, prompt=prompt, window=window, max_items=max_items, max_bytes=max_bytes)
        return docs.join(leaked.select(key).distinct(), key, "left_anti")
    if how != "spans":
        raise ValueError("how must be 'spans' or 'documents'")
    row, mark = (n + "_" * max(map(len, docs.columns)) for n in ("_row", "_spans"))  # longer than any other name
    send, at = docs.sparkSession.sparkContext.broadcast, docs.columns.index(text)
    blocks = _indexes(eval_items, item, prompt, window, max_items, max_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:  # no row has to be found again: scan and cut in one pass
        scan = _span_finder(send(first), row, mark)

        def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans: list[list[int]] = [[] for _ in range(batch.num_rows)]
                numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], [row, text])
                for hits in scan([numbered]):
                    for k, own in zip(*(c.to_pylist() for c in hits.columns)):
                        spans[k] = own
                yield _without(batch, at, spans)

        return docs.mapInArrow(both, docs.schema)
    base = cut(docs.withColumn(row, F.monotonically_increasing_id()), "leaks")  # the numbers must stay as they are
    parts = [base.select(row, text).mapInArrow(_span_finder(send(one), row, mark), f"{row} long, {mark} array<long>") for one in chain([first, second], blocks)]
    found = reduce(DataFrame.unionByName, parts)
    joined = base.join(broadcast_if_small(found.groupBy(row).agg(F.flatten(F.collect_list(mark)).alias(mark))), row, "left").select(*docs.columns, mark)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            yield _without(batch.select(range(last)), at, [own or [] for own in batch.column(last).to_pylist()])

    return joined.mapInArrow(cut_out, docs.schema)


def _span_finder(index: Broadcast, row: str, mark: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches ``(row, text)`` to ``(row, spans)`` of the texts that hold a passage: begin and end in turn, as they are found."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = string_parts(batch.column(1))
            spans: dict[int, list[int]] = {}
            for a, b in row_slices(offsets, SLICE_BYTES):
                for t, _, x, y in index.value.scan(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                    shift = int(offsets[a] - offsets[a + t])
                    own = spans.setdefault(a + t, [])
                    if own and own[-2] <= x + shift <= own[-1]:
                        own[-1] = max(own[-1], y + shift)
                    else:
                        own += [x + shift, y + shift]
            if spans:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(list(spans))), pa.array(list(spans.values()), pa.list_(pa.int64()))], [row, mark])

    return scan


def _without(batch: pa.RecordBatch, at: int, spans: list[list[int]]) -> pa.RecordBatch:
    """The batch with the bytes of the spans cut out of its texts; spans may overlap and come in any order."""
    if not any(spans):
        return batch
    offsets, raw = string_parts(batch.column(at))
    texts = batch.column(at).to_pylist()
    for t, flat in enumerate(spans):
        if flat:
            own: list[int] = []
            for x, y in sorted(zip(flat[::2], flat[1::2])):
                if own and x <= own[-1]:
                    own[-1] = max(own[-1], y)
                else:
                    own += [x, y]
            begin = int(offsets[t])
            cuts = [0, *own, int(offsets[t + 1]) - begin]
            texts[t] = b"".join(raw[begin + x : begin + y].tobytes() for x, y in zip(cuts[::2], cuts[1::2])).decode()
    return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

"""Benchmark decontamination by suffix arrays of the training texts.

Each group of documents is a shard: its words, those of the benchmark as
numbers, lie end to end with a stop after each document. The shard's suffix
array is sparse: only suffixes whose first words begin some benchmark window
are in it, and no other suffix can match one. Every benchmark suffix whose
first words occur in the shard is binary-searched, and the run of equal prefixes gives the locations; neighbours
in the array give the longest verbatim match. The documents are never shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_map, as_bytes, extended, groups, shielded

WINDOW = 10
#: Words of the benchmark that go to the workers at once; a larger one is taken in blocks.
BLOCK_WORDS = 2_000_000
#: Bytes of text in a shard.
SHARD_BYTES = 4 << 20
#: Words of a suffix that it is sorted by; matches go on beyond them.
LONGEST = 256

_WORD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def item_words(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words are runs of digits, a-z and bytes over U+007F."""
    return text.translate(_WORD).split()


class _Block:
    """Some benchmark items: number of each word, and each item's words as big-endian bytes, four to a word."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.number: dict[bytes, int] = {}
        for _, words in items:
            for w in words:
                self.number.setdefault(w, len(self.number) + 1)
        self.items = [(i, np.array([self.number[w] for w in words], ">u4")) for i, words in items]
        self.shortest = min((min(len(x), window) for _, x in self.items), default=0)
        self.head = min(self.shortest, 3)
        places = [(k, s) for k, (_, x) in enumerate(self.items) for s in range(len(x) - min(len(x), window) + 1)]
        starts = [self.items[k][1][s : s + self.head] for k, s in places]
        self.heads, of = np.unique(self._code(np.array(starts, np.uint64).reshape(-1, self.head).T), return_inverse=True) if starts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(of, kind="stable")
        self.windows = [places[i] for i in order.tolist()]  # (item, first word), by head
        self.begin = np.searchsorted(of[order], np.arange(len(self.heads) + 1))

    def _code(self, words: np.ndarray) -> np.ndarray:
        code = np.zeros(words.shape[1], np.uint64)
        for w in words:
            code = code * np.uint64(1 << 21) + w.astype(np.uint64)
        return code

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Places whose first words begin a window of this block, and the windows (item, first word) that they may begin."""
        n = len(words) - self.head + 1
        if n <= 0 or not len(self.heads):
            return np.zeros(0, np.int64), []
        at = np.flatnonzero(words[:n] > 0)
        for i in range(1, self.head):
            at = at[words[at + i] > 0]
        code = self._code(np.array([words[at + i] for i in range(self.head)]))
        k = np.minimum(np.searchsorted(self.heads, code), len(self.heads) - 1)
        known = self.heads[k] == code
        return at[known], [w for h in np.unique(k[known]).tolist() for w in self.windows[self.begin[h] : self.begin[h + 1]]]


def _shard(texts: list[list[bytes]], block: _Block, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(item, document, place in it, words of the window, words of the match) of each match; the last are counted on to the first difference where the match begins."""
    get = block.number.get
    each = np.fromiter(map(len, texts), np.int64, len(texts))
    words = np.zeros(int(each.sum()) + len(texts), ">u4")  # a stop, 0, ends each document
    ends = np.cumsum(each + 1)
    place = np.ones(len(words), bool)
    place[ends - 1] = False
    words[place] = np.fromiter((get(w, 0) for t in texts for w in t), np.int64, int(each.sum()))
    at, windows = block.candidates(words.astype(np.int64))
    if not len(at):
        return
    data = words.tobytes()
    doc = np.searchsorted(ends, at, side="right")
    suffixes = sorted((data[4 * p : 4 * min(p + LONGEST, int(ends[d]))], int(p), int(d)) for p, d in zip(at, doc, strict=True))
    keys = [s[0] for s in suffixes]
    for k, s in windows:
        item = block.items[k][1]
        size, whole = min(len(item), window), item.data
        part = bytes(whole[s : s + size])
        low = bisect_left(keys, part)
        high = bisect_right(keys, part + b"\xff" * 4, low)
        for _, p, d in suffixes[low:high]:
            same = size
            if not (s and p and words[p - 1] == item[s - 1]):  # else the match from a word earlier is longer
                while s + same < len(item) and words[p + same] == item[s + same]:
                    same += 1
            yield k, d, p - int(ends[d] - each[d] - 1), size, same


def _hits(batches: Iterator[pa.RecordBatch], at: int, block, window: int, n_own: int) -> Iterator[pa.RecordBatch]:
    """Merge one block's matches into the columns that follow the documents' own."""
    b = block.value
    for batch in batches:
        texts = as_bytes(batch.column(at))
        before = [c.to_pylist() for c in batch.columns[n_own:]]
        n_words, hits, items, longest = [], [], [], []
        for lo, hi in groups(list(map(len, texts)), SHARD_BYTES):
            words = [item_words(t) for t in texts[lo:hi]]
            hit: list[set] = [set() for _ in words]
            found: list[set] = [set() for _ in words]
            most = [0] * len(words)
            for k, d, p, size, same in _shard(words, b, window):
                hit[d].update(range(p, p + size))
                found[d].add(k)
                most[d] = max(most[d], same)
            for j, w in enumerate(words):
                old = [c[lo + j] for c in before] if before else [len(w), [], [], 0]
                n_words.append(len(w))
                hits.append(sorted(hit[j].union(*(range(x["start"], x["end"]) for x in old[1]))))
                items.append(sorted(old[2] + [b.items[k][0] for k in found[j]], key=str))
                longest.append(max(most[j], old[3]))
        spans = [_spans(h) for h in hits]
        item_type = pa.list_(b.item_type)
        out = [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, item_type), pa.array(longest, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:n_own], *out], [*batch.schema.names[:n_own], *ADDED])


def _spans(words: list[int]) -> list[dict]:
    out: list[dict] = []
    for w in words:
        if out and out[-1]["end"] == w:
            out[-1]["end"] = w + 1
        else:
            out.append({"start": w, "end": w + 1})
    return out


ADDED = ("n_words", "hit_spans", "items", "longest_match")


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Add to each document its words, the spans of words that benchmark windows hit, the items found, and the longest match.

    A window is ``window`` consecutive words of an item, or all the words of a
    shorter one; items without words, or null, have none. A null document has
    no words. Items are read to the driver in blocks of bounded size, so a
    large benchmark takes several passes within the same tasks. Columns with
    the added names are replaced, others stay, and no row is merged or lost.
    """
    rest = docs.drop(*ADDED)
    own = rest.columns
    spark = docs.sparkSession
    kind = benchmark.schema[item].dataType
    item_type = to_arrow_type(kind)
    schema = extended(rest.schema, f"n_words long, hit_spans array<struct<start:long,end:long>>, items array<{kind.simpleString()}>, longest_match long")
    out = rest

    def add(out: DataFrame, items: list) -> DataFrame:
        block = _Block(items, window)
        block.item_type = item_type
        shared = spark.sparkContext.broadcast(block)
        return arrow_map(out, partial(_hits, at=own.index(text), block=shared, window=window, n_own=len(own)), schema)

    items: list = []
    size = 0
    for row in benchmark.select(item, item_text).toLocalIterator():
        words = item_words((row[1] or "").encode())
        if not words:
            continue
        if items and size + len(words) > BLOCK_WORDS:
            out, items, size = add(out, items), [], 0
        items.append((row[0], words))
        size += len(words)
    return add(out, items) if items or out is rest else out


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that no benchmark window hits, with their own columns, whatever their names. Null and empty texts stay, equal rows stay as many."""
    mine, back = shielded(docs, ADDED)
    return find_leaks(mine, benchmark, **options).filter(F.size("hit_spans") == 0).select(*back)

"""Removal of word sequences that also start earlier in the corpus.

A window is ``length`` consecutive words; its anchor is the leftmost of its
word k-grams whose hash is least. Equal windows have equal anchors at equal
offsets, so it is enough to compare contexts: an anchor with the words of all
its windows. Chunks of documents first ask how often their anchors occur at
all. The contexts of repeated anchors then form reference shards, dealt by
anchor: a shard's contexts, earliest first, are streamed for matching
statistics through a suffix automaton of those before them, and the spans of at
least ``length`` words that match are removed. A shard is sent to the task of
its anchors instead of to all tasks: broadcasting every shard to every document
would cost the square of the corpus. Anchors with very many contexts are dealt
by whole windows instead, of which only the least place counts. What is known
twice within a chunk is settled there and never sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import arrow_map, as_bytes, extended, groups, tidily

LENGTH, GRAM = 20, 6
#: Bytes of text in a chunk.
CHUNK_BYTES = 2 << 20
#: Contexts of an anchor that one automaton takes; anchors with more are dealt by window.
CONTEXTS = 512
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


class Automaton:
    """Suffix automaton of several sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, after: dict) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, q: int, c) -> int:
        r = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = r
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = r
            p = self.link[p]
        return r

    def add(self, sequence: list) -> None:
        last, after, link, length = 0, self.next, self.link, self.length
        for c in sequence:
            q = after[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, q, c)
                continue
            new, p = self._state(length[last] + 1, 0, {}), last
            while p != -1 and c not in after[p]:
                after[p][c] = new
                p = link[p]
            if p != -1:
                q = after[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            last = new

    def statistics(self, sequence: list) -> list[int]:
        """Length of the longest match that ends with each symbol."""
        out, v, n, after = [], 0, 0, self.next
        for c in sequence:
            while v and c not in after[v]:
                v = self.link[v]
                n = self.length[v]
            v = after[v].get(c, 0)
            n = n + 1 if v else 0
            out.append(n)
        return out


#: Bytes whose words are hashed at once.
_SLICE = 1 << 21
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b]), 1) for b in range(256)], np.uint64)


@cache
def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))


def _word_hashes(joined: bytes, byte: np.ndarray) -> np.ndarray:
    """Hash of each word of a joined text: a polynomial of its bytes modulo 2**64, from sums over the whole text, then mixed."""
    out, n, lo = np.zeros(len(byte) - 1, np.uint64), len(byte) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(byte, byte[lo] + _SLICE, side="right")) - 1)
        start, end = byte[lo:hi] - byte[lo], byte[lo + 1 : hi + 1] - byte[lo] - 1
        size = int(end[-1])
        table = max(size, _SLICE)
        terms = _BYTES[np.frombuffer(joined, np.uint8, size, int(byte[lo]))] * _powers(_ODD[0], table)[:size]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms)))
        out[lo:hi] = (total[end] - total[start]) * _powers(pow(_ODD[0], -1, 2**64), table)[start]
        lo = hi
    out = (out ^ (out >> np.uint64(32))) * np.uint64(_ODD[1])
    return out ^ (out >> np.uint64(29))


#: k-grams are compared by the upper bits of their hashes; the lower ones make room for a place.
_PLACE_BITS = 22


def _leftmost_least(value: np.ndarray, span: int) -> np.ndarray:
    """Offset of the leftmost least value in each run of ``span``; values have ``_PLACE_BITS`` zero bits at the top."""
    n = len(value)
    if n >> _PLACE_BITS:
        return np.lib.stride_tricks.sliding_window_view(value, span).argmin(axis=1)
    best, reach = value << np.uint64(_PLACE_BITS) | np.arange(n, dtype=np.uint64), 1
    while 2 * reach <= span:
        best, reach = np.minimum(best[:-reach], best[reach:]), 2 * reach
    if reach < span:
        best = np.minimum(best[: n - span + 1], best[span - reach :])
    return (best & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64) - np.arange(n - span + 1)


class _Chunk:
    """Words of some texts, and the contexts of their windows.

    Of each context: ``anchor`` and ``text`` hashes, first word ``at``, number
    of windows ``n``, document's ``order`` and first word there, ``start``.
    ``first`` is the local context with the same words that starts earliest.
    """

    def __init__(self, texts: list[bytes], order: np.ndarray, length: int = LENGTH, gram: int = GRAM):
        each, joined = [], []
        for t in texts:
            words = t.split()
            each.append(len(words))
            if words:
                joined.append(b" ".join(words))
        self.length = length
        self.joined = b" ".join(joined)
        self.each = np.array(each, np.int64)
        # where words begin; a last one that is none
        self.byte = np.concatenate(([0], np.flatnonzero(np.frombuffer(self.joined, np.uint8) == 0x20) + 1, [len(self.joined) + 1]))[0 if self.joined else 1 :]
        word = _word_hashes(self.joined, self.byte)
        self.doc = np.repeat(np.arange(len(texts)), self.each)
        self.began = np.cumsum(self.each) - self.each
        n, span = len(word), length - gram + 1
        if n < length:
            empty = np.zeros(0, np.int64)
            self.anchor = self.text = np.zeros(0, np.uint64)
            self.at = self.n = self.order = self.start = self.first = empty
            return
        code = np.zeros(n - gram + 1, np.uint64)
        for i in range(gram):
            code += word[i : i + len(code)] * np.uint64((_ODD[0] + 2 * i * _ODD[2]) % 2**64)
        code = (code ^ (code >> np.uint64(32))) * np.uint64(_ODD[3])
        code ^= code >> np.uint64(29)
        place = np.arange(n - length + 1) + _leftmost_least(code >> np.uint64(_PLACE_BITS), span)
        whole = np.flatnonzero(self.doc[: n - length + 1] == self.doc[length - 1 :])
        place = place[whole]
        fresh = np.concatenate(([True], place[1:] != place[:-1])) if len(place) else np.zeros(0, bool)
        self.at = whole[fresh]
        self.n = np.diff(np.append(np.flatnonzero(fresh), len(place)))
        self.anchor = code[place[fresh]]
        joined, digest = self.joined, xxhash.xxh64_intdigest
        ends = self.byte[self.at + self.n + length - 1] - 1
        self.text = np.fromiter((digest(joined[a:b]) for a, b in zip(self.byte[self.at].tolist(), ends.tolist(), strict=True)), np.uint64, len(ends))
        doc = self.doc[self.at]
        self.order, self.start = order[doc], self.at - self.began[doc]
        by = np.lexsort((self.start, self.order, self.anchor, self.text))
        new = np.concatenate(([True], (self.text[by[1:]] != self.text[by[:-1]]) | (self.anchor[by[1:]] != self.anchor[by[:-1]]))) if len(by) else np.zeros(0, bool)
        self.first = np.zeros(len(by), np.int64)
        self.first[by] = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))] if len(by) else by
        for k in np.flatnonzero(self.first != np.arange(len(by))).tolist():  # equal hashes are not taken for equal words
            if self.bytes_of(k) != self.bytes_of(self.first[k]):
                self.first[k] = k

    def bytes_of(self, k: int) -> bytes:
        return self.joined[self.byte[self.at[k]] : self.byte[self.at[k] + self.n[k] + self.length - 1] - 1]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, and contexts of each with different words (255: that many or more)."""
        own, n = np.unique(self.anchor[np.unique(self.first)], return_counts=True)
        return own, np.minimum(n, 255).astype(np.uint8)


def _order(ids: pa.Array) -> np.ndarray:
    return pa.compute.fill_null(ids.cast(pa.int64()), -(2**63)).to_numpy(zero_copy_only=False)


def _ipc(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def _open(blob: bytes, text: int, id_: int, length: int) -> tuple[pa.Table, _Chunk]:
    own = pa.ipc.open_stream(blob).read_all().combine_chunks()
    return own, _Chunk(as_bytes(own.column(text)), _order(own.column(id_).combine_chunks()), length)


def _pack(batches: Iterator[pa.RecordBatch], text: int, id_: int, buckets: int, length: int) -> Iterator[pa.RecordBatch]:
    waiting, size, made = [], 0, TaskContext.get().partitionId() << 32

    def flush() -> Iterator[pa.RecordBatch]:
        blob = _ipc(waiting)
        _, chunk = _open(blob, text, id_, length)
        number = (xxhash.xxh64(blob, seed=made).intdigest() >> exchange.HOME_BITS << exchange.HOME_BITS) - 2**63 + exchange.home(made)
        yield exchange.rows([(number, -1, blob)])
        own, n = chunk.anchors()
        bucket = (own % np.uint64(buckets)).astype(np.int64)
        for k in range(buckets):
            if (at := np.flatnonzero(bucket == k)).size:
                yield exchange.rows([(number, k, exchange.squeeze(own[at]), exchange.squeeze(n[at]))])

    for batch in batches:
        sizes = [len(x) for x in as_bytes(batch.column(text))]
        for a, b in groups(sizes, CHUNK_BYTES):
            waiting.append(batch.slice(a, b - a))
            size += sum(sizes[a:b])
            if size >= CHUNK_BYTES:
                yield from flush()
                waiting, size, made = [], 0, made + 1
    if waiting:
        yield from flush()


def _classify(asked: pa.Table) -> pa.Table:
    """Of every chunk's anchors: 0 if there is one context at one place, 1 if few, 2 if many in all."""
    rows = asked.to_pylist()
    keys = [exchange.expand(r["a"], np.uint64) for r in rows]
    own, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate([exchange.expand(r["b"], np.uint8) for r in rows]), len(own))
    kind = ((total > 1).astype(np.uint8) + (total > CONTEXTS))[at]
    parts = np.split(kind, np.cumsum([len(k) for k in keys])[:-1])
    return pa.Table.from_batches([exchange.rows([(r["chunk"], r["bucket"], exchange.squeeze(p), r["a"]) for r, p in zip(rows, parts, strict=True)])])


def _blob(chunk: pa.Table) -> tuple[int, bytes]:
    own = chunk.filter(pa.compute.equal(chunk["bucket"], -1))
    if len(own) != 1:
        raise RuntimeError("answers without their chunk: its rows came in another order when a task was redone")
    return own["chunk"][0].as_py(), own["a"][0].as_py()


def _send(packed: pa.Table, found: pa.Table, text: int, id_: int, buckets: int, length: int) -> pa.Table:
    """A chunk's contexts whose anchors are repeated, to the shards; bucket rows by anchor, then by window."""
    number, blob = _blob(packed)
    _, chunk = _open(blob, text, id_, length)
    answers = found.to_pylist()
    keys = np.concatenate([np.zeros(0, np.uint64), *[exchange.expand(r["b"], np.uint64) for r in answers]])
    kinds = np.concatenate([np.zeros(0, np.uint8), *[exchange.expand(r["a"], np.uint8) for r in answers]])
    if len(keys) != len(chunk.anchors()[0]):
        raise RuntimeError("a chunk's anchors were not answered: its rows came in another order when a task was redone")
    by = np.argsort(keys)
    own = np.unique(chunk.first)
    kind = kinds[by][np.searchsorted(keys[by], chunk.anchor[own])] if len(own) else np.zeros(0, np.uint8)
    out = []
    few = own[kind == 1]
    bucket = (chunk.anchor[few] % np.uint64(buckets)).astype(np.int64)
    for k in np.unique(bucket):
        at = few[bucket == k]
        words = exchange.pack_words([chunk.bytes_of(i) for i in at])
        out.append((number, int(k), *words, exchange.squeeze(chunk.anchor[at]), exchange.squeeze(np.concatenate((chunk.order[at], chunk.start[at]))), exchange.squeeze(at.astype(np.int32))))
    many = own[kind == 2]
    if len(many):
        context = np.repeat(many, chunk.n[many])
        offset = np.arange(len(context)) - np.repeat(np.cumsum(chunk.n[many]) - chunk.n[many], chunk.n[many])
        first = chunk.at[context] + offset
        ends = chunk.byte[first + length] - 1
        digests = b"".join(xxhash.xxh128_digest(chunk.joined[a:b]) for a, b in zip(chunk.byte[first].tolist(), ends.tolist(), strict=True))
        window = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        bucket = (window[:, 0] % np.uint64(buckets)).astype(np.int64)
        for k in np.unique(bucket):
            at = np.flatnonzero(bucket == k)
            place = np.concatenate((chunk.order[context[at]], chunk.start[context[at]] + offset[at]))
            out.append((number, int(k), exchange.squeeze(window[at].reshape(-1)), None, None, exchange.squeeze(place), exchange.squeeze(np.concatenate((context[at], offset[at])).astype(np.int32))))
    return pa.Table.from_batches([exchange.rows(out)])


def _judge(asked: pa.Table, length: int) -> pa.Table:
    """Windows of a bucket's contexts that start earlier elsewhere, as bits; and whole windows of anchors with many contexts."""
    out, shards, windows = [], {}, []
    for r, row in enumerate(asked.to_pylist()):
        place = exchange.expand(row["d"], np.int64).reshape(2, -1)
        if row["b"] is None:
            windows.append((exchange.expand(row["a"], np.uint64).reshape(-1, 2), place, row))
            continue
        marks = np.zeros(place.shape[1], np.uint16)
        out.append((row["chunk"], row["bucket"], marks, row["e"], b"few"))
        texts = exchange.unpack_words(row["a"], row["b"])
        for i, (anchor, order, start, text) in enumerate(zip(exchange.expand(row["c"], np.uint64).tolist(), *place.tolist(), texts, strict=True)):
            shards.setdefault(anchor, []).append((order, start, text, marks, i))
    for contexts in shards.values():
        if len(contexts) < 2:
            continue
        contexts.sort(key=lambda c: c[:2])
        first: dict[bytes, tuple[int, int]] = {}
        automaton = None
        mark_of: dict[bytes, int] = {}
        held = None
        for order, start, text, marks, i in contexts:
            if text in first:
                if first[text] != (order, start):
                    marks[i] = 0xFFFF
                else:
                    marks[i] = mark_of[text]
                continue
            first[text] = (order, start)
            words = text.split(b" ")
            bits = 0
            if held is None:
                held = words
            else:
                if automaton is None:
                    automaton = Automaton()
                    automaton.add(held)
                for e, n in enumerate(automaton.statistics(words)):
                    if n >= length:
                        bits |= 1 << (e - length + 1)
                automaton.add(words)
            mark_of[text] = marks[i] = bits
    rows = [(c, b, exchange.squeeze(m), None, e, None, k) for c, b, m, e, k in out]
    if windows:
        key = np.concatenate([w for w, _, _ in windows])
        order, start = np.concatenate([p for _, p, _ in windows], axis=1)
        by = np.lexsort((start, order, key[:, 1], key[:, 0]))
        new = np.concatenate(([True], (key[by[1:]] != key[by[:-1]]).any(axis=1)))
        first = np.empty(len(by), np.int64)
        first[by] = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
        later = ((order != order[first]) | (start != start[first])).astype(np.uint16)
        for part, (_, _, row) in zip(np.split(later, np.cumsum([len(w) for w, _, _ in windows])[:-1]), windows, strict=True):
            rows.append((row["chunk"], row["bucket"], exchange.squeeze(part), None, row["e"], None, b"window"))
    return pa.Table.from_batches([exchange.rows(rows)])


def _remove(packed: pa.Table, found: pa.Table, text: int, id_: int, length: int) -> pa.Table:
    _, blob = _blob(packed)
    own, chunk = _open(blob, text, id_, length)
    bits = np.zeros(len(chunk.at), np.int64)
    for row in found.to_pylist():
        marks, at = exchange.expand(row["a"], np.uint16).astype(np.int64), exchange.expand(row["c"], np.int32)
        if row["e"] == b"few":
            bits[at] = marks
        else:
            context, offset = at.reshape(2, -1)
            np.bitwise_or.at(bits, context, marks << offset)
    first = chunk.first
    later = (chunk.order != chunk.order[first]) | (chunk.start != chunk.start[first])
    bits = np.where(later, 0xFFFF, bits[first])
    covered = np.zeros(len(chunk.doc) + 1, np.int64)
    for i in range(int(chunk.n.max(initial=0))):
        at = chunk.at[(chunk.n > i) & ((bits >> i) & 1 > 0)] + i
        np.add.at(covered, at, 1)
        np.add.at(covered, at + length, -1)
    gone = np.cumsum(covered)[:-1] > 0
    removed = np.bincount(chunk.doc, gone, len(chunk.each)).astype(np.int64)
    kept, spans = [], []
    joined, byte = chunk.joined, chunk.byte
    for began, n, lost in zip(chunk.began.tolist(), chunk.each.tolist(), removed.tolist(), strict=True):
        if not lost:
            kept.append(joined[byte[began] : byte[began + n] - 1] if n else b"")
            spans.append([])
            continue
        inner = np.concatenate(([False], gone[began : began + n], [False])).astype(np.int8)
        edge = np.diff(inner)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        spans.append([{"start": int(a), "end": int(b)} for a, b in zip(starts, ends, strict=True)])
        keep = zip([0, *ends.tolist()], [*starts.tolist(), n], strict=True)
        kept.append(b" ".join(joined[byte[began + a] : byte[began + b] - 1] for a, b in keep if a < b))
    out = own
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for name, column in zip(ADDED, (pa.array(chunk.each), pa.array(removed), pa.array(spans, span_type), pa.array(kept, pa.binary()).cast(pa.string())), strict=True):
        out = out.append_column(name, column)
    return out


ADDED = ("n_words", "n_removed", "removed_spans", "kept_text")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add to each document its words, those removed, their spans, and the kept words joined by one space.

    A word is removed if it lies in a window of ``length`` words whose sequence
    also starts earlier: in a document of smaller id, or before in the same
    one. Ids are integers; null is less than any. Rows of equal id count as one
    document: their equal windows at equal places are not earlier than each
    other. A null text has no words. Columns with the added names are replaced,
    all others stay; an empty table gives an empty result.
    """
    assert GRAM < length <= GRAM + 15, "a context has a bit for each of its windows"
    rest = docs.drop(*ADDED)
    at = {"text": rest.columns.index(text), "id_": rest.columns.index(id), "length": length}
    buckets = exchange.bucket_count(docs)
    packed = exchange.at_home(arrow_map(rest, partial(_pack, buckets=buckets, **at), exchange.SCHEMA), buckets)
    kinds = exchange.by_bucket(packed, buckets).groupBy("bucket").applyInArrow(lambda asked: tidily(_classify)(asked), exchange.SCHEMA)
    sent = exchange.meet(packed, kinds, buckets, lambda packed, found: tidily(_send)(packed, found, buckets=buckets, **at), exchange.SCHEMA)
    judged = sent.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(lambda asked: tidily(_judge)(asked, length), exchange.SCHEMA)
    schema = extended(rest.schema, "n_words long, n_removed long, removed_spans array<struct<start:long,end:long>>, kept_text string")
    return exchange.meet(packed, judged, buckets, lambda packed, found: tidily(_remove)(packed, found, **at), schema)

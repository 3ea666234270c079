"""Byte-level BPE encoding and decoding of whole texts.

Encoding: pre-tokens with their positions, the distinct ones shuffled, each
encoded once where its hash bucket lies, ids joined back to the chunks and laid
out by position. Decoding: a broadcast join of ids, in their places, with the
table of token bytes, which has one row for each token of the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from . import exchange
from .common import as_bytes, extended, groups, map_batches, quoted, tidily
from .merging import ByteMerger, read_ranks

@cache
def _vocabulary(path: str) -> ByteMerger:
    return ByteMerger(path)


def token_table(path: str) -> pa.Array:
    """The bytes of each token, by id; null where the vocabulary has none."""
    ranks = read_ranks(path)
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.binary())


@cache
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


def _cut(texts: list[bytes], pattern: str) -> tuple[np.ndarray, pa.Array]:
    find = _pattern(pattern).findall
    found = [find(t.decode()) for t in texts]
    return np.fromiter(map(len, found), np.int64, len(found)), pa.array([w for f in found for w in f], pa.string()).cast(pa.binary())


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Ids of the words of each chunk, bucket by bucket; within a bucket each distinct word is encoded once."""
    vocabulary, known, bucket = _vocabulary(path), {}, -1
    for batch in batches:
        for row in batch.to_pylist():
            words = exchange.unpack_words(row["a"], row["b"])
            if row["bucket"] != bucket:
                known, bucket = {}, row["bucket"]
            missing = [w for w in words if w not in known]
            ids, n = vocabulary.encode(missing)
            ids, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
            known.update(zip(missing, (ids[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
            own = list(map(known.__getitem__, words))
            yield exchange.rows([(row["chunk"], row["bucket"], exchange.squeeze(np.frombuffer(b"".join(own), "<u4")), exchange.squeeze(np.fromiter(map(len, own), np.int32, len(own)) // 4), row["c"])])


def _lay_out(ids: pa.ChunkedArray, each: np.ndarray, lids: np.ndarray, _, answers: list[dict], __) -> pa.Table:
    total = 1 + max((int(exchange.expand(x["c"], np.int32).max()) for x in answers), default=-1)
    start, count, flat, at = np.zeros(total, np.int64), np.zeros(total, np.int64), [], 0
    for x in answers:
        own, n = exchange.expand(x["c"], np.int32), exchange.expand(x["b"], np.int32).astype(np.int64)
        count[own], start[own] = n, at + np.cumsum(n) - n
        flat.append(exchange.expand(x["a"], "<u4"))
        at += len(flat[-1])
    flat = np.concatenate([np.zeros(0, "<u4"), *flat])
    parts, ends = [], np.cumsum(each, dtype=np.int64).tolist()
    for a, b in zip([0, *ends], ends, strict=False):
        n = count[own := lids[a:b]]
        before = np.cumsum(n) - n
        parts.append(flat[np.repeat(start[own] - before, n) + np.arange(int(n.sum()))].astype("<u4").tobytes())
    return pa.table({"id": ids, "ids": pa.array(parts, pa.binary())})


def encode(docs: DataFrame, ranks_path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of each whole text: (id, ids), ids as little-endian unsigned 32-bit integers in a binary.

    A null text is empty and has no tokens; a null id stays null; rows that are
    alike stay as many as they are. Other columns of ``docs``, whatever their
    names, are not carried. An empty table gives an empty result.
    """
    narrow = docs.select(docs[id].alias("id"), docs[text].alias("text"))
    buckets = exchange.bucket_count(docs)
    packed = exchange.at_home(exchange.chunks(narrow, partial(_cut, pattern=pattern), buckets), buckets)
    answers = exchange.by_bucket(packed, buckets).sortWithinPartitions("bucket").mapInArrow(partial(tidily(_encode), path=ranks_path), exchange.SCHEMA)
    kind = narrow.schema["id"].dataType.simpleString()
    return exchange.assemble(packed, answers, buckets, _lay_out, f"id {kind}, ids binary").withColumnRenamed("id", id)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the decoded bytes of the ``ids`` column (as ``encode`` makes it; null decodes to empty).

    An id outside the vocabulary fails the job: no bytes stand for it.
    """
    kept = encoded.drop(into)
    schema = extended(kept.schema, f"{quoted(into)} binary")

    table = encoded.sparkSession.sparkContext.broadcast(token_table(ranks_path))

    def run(batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
        out = []
        rows = as_bytes(batch.column(at))
        for a, b in groups(list(map(len, rows))):
            n = np.array([0, *map(len, rows[a:b])], np.int64) // 4
            joined = table.value.take(pa.array(np.frombuffer(b"".join(rows[a:b]), "<u4")))
            if joined.null_count:
                raise ValueError("an id that is not in the vocabulary")
            per_row = pa.LargeListArray.from_arrays(pa.array(np.cumsum(n)), joined)
            out += pa.compute.binary_join(per_row.cast(pa.list_(pa.binary())), pa.scalar(b"", pa.binary())).to_pylist()
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, into])

    return map_batches(kept, partial(run, at=kept.columns.index(ids)), schema)

"""Look up every distinct word of a corpus once, and bring the answers back in place.

A *chunk* is a run of one task's documents. Its words become local numbers, so
that a document is an array of numbers, and each distinct word of the chunk is
sent once, packed with the other words of its hash bucket. Whoever answers
sees each word in one bucket only; the answers go back by chunk. What is
shuffled thus follows the distinct words of chunks, never the tokens, and a
very frequent word weighs as much as any other. A chunk's number is a hash of
its place and content, and ends in the number of its home, the task that its
answers meet it in, so that chunks are dealt evenly. If a lost task were redone
over rows in another order, its answers would be missing, which fails the job,
never change.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, groups, tidily

#: A chunk ends at about so many tokens, or bytes of text, which long words come to first.
CHUNK_TOKENS, CHUNK_BYTES = 3_000_000, 64 << 20

#: Lowest bits of a chunk's number, for its home.
HOME_BITS = 16

SCHEMA = "chunk long, bucket int, a binary, b binary, c binary, d binary, e binary"
SCHEMA_NAMES = ("chunk", "bucket", *"abcde")


@cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(data: np.ndarray | bytes) -> bytes:
    """Compressed bytes; of numbers, the low bytes of all come first, then the next ones."""
    if isinstance(data, np.ndarray):
        data = data.view(np.uint8).reshape(-1, data.dtype.itemsize).T.tobytes()
    return _zstd()[0].compress(data)


def expand(blob: bytes, dtype=None) -> np.ndarray | bytes:
    data = _zstd()[1].decompress(blob)
    if dtype is None:
        return data
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).reshape(-1).view(dtype)


def pack_words(words: list[bytes]) -> tuple[bytes, bytes]:
    return squeeze(b"".join(words)), squeeze(np.fromiter(map(len, words), np.int32, len(words)))


def unpack_words(blob: bytes, lengths: bytes) -> list[bytes]:
    data, ends = expand(blob), np.cumsum(expand(lengths, np.int32), dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def ids_ipc(column: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([column], ["id"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def ids_read(blob: bytes) -> pa.ChunkedArray:
    return pa.ipc.open_stream(blob).read_all().column(0)


def rows(found: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array([r[i] if i < len(r) else None for r in found], t) for i, t in enumerate(types)], ["chunk", "bucket", *"abcde"])


def home(place: int) -> int:
    """Chunks of a task come one or two at a time, so each task's have neighbouring homes."""
    return (2 * (place >> 32) + (place & 0xFFFFFFFF)) & ((1 << HOME_BITS) - 1)


def at_home(rows_: DataFrame, tasks: int) -> DataFrame:
    """The rows of each chunk in the task of its home."""
    number = F.col("chunk").bitwiseAND((1 << HOME_BITS) - 1) % tasks
    return rows_.withColumn("home", number.cast("int")).repartitionById(tasks, F.col("home"))


def meet(left: DataFrame, right: DataFrame, tasks: int, fn: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """fn(rows of a chunk on the left, on the right) for each chunk that is on the left."""

    def run(mine: pa.Table, rest: pa.Table) -> pa.Table:
        if not mine.num_rows:
            raise RuntimeError("answers without their chunk: its rows came in another order when a task was redone")
        return fn(mine, rest)

    sides = [(x if "home" in x.columns else at_home(x, tasks)).groupBy("home", "chunk") for x in (left, right)]
    return sides[0].cogroup(sides[1]).applyInArrow(lambda mine, rest: run(mine, rest), schema)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """Number of words of each text, and all words: runs without space and U+0009 to U+000D."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inner = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    first = inner.copy()
    first[1:] &= ~inner[:-1]
    begin = np.flatnonzero(first)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    each = np.diff(np.searchsorted(begin, starts))
    length = np.diff(np.append(np.cumsum(inner)[begin] - 1, np.count_nonzero(inner)))
    offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
    return each, pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[inner].tobytes())])


def chunks(docs: DataFrame, cut: Callable[[list[bytes]], tuple[np.ndarray, pa.Array]], buckets: int, weigh: str | None = None, carry: Callable[[list[bytes]], bytes] | None = None, size: int = CHUNK_TOKENS) -> DataFrame:
    """Packed chunks of ``docs``, whose first column is an id and the second the text.

    ``cut`` gives the number of words of each text, and all words as an Arrow
    array. A row with bucket -1 holds a chunk's documents: ids, numbers of
    words, local word numbers, the column named by ``weigh`` as 0 or 1, and what
    ``carry`` makes of the distinct words. The others hold the words of a
    bucket, their local numbers, and their counts in documents of weight 1.
    """
    named, most = docs.columns, CHUNK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 32, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            place, made = task + made, made + 1
            coded = pa.concat_arrays(pieces).dictionary_encode()
            lids, flat = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            each, weight = np.concatenate(sizes).astype(np.int32), np.array(weights, np.uint8)
            sign = xxhash.xxh64(b"".join(flat), seed=place)
            sign.update(lids.tobytes())
            chunk = (sign.intdigest() >> HOME_BITS << HOME_BITS) - 2**63 + home(place)
            yield rows([(chunk, -1, ids_ipc(pa.chunked_array(ids).combine_chunks()), squeeze(each), squeeze(lids), squeeze(weight), carry(flat) if carry else None)])
            counts = np.bincount(lids[np.repeat(weight, each) > 0], minlength=len(flat)).astype(np.int64)
            bucket = np.fromiter(map(zlib.crc32, flat), np.int64, len(flat)) % buckets
            order = np.argsort(bucket, kind="stable")
            starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in range(buckets):
                if len(own := order[starts[k] : starts[k + 1]]):
                    yield rows([(chunk, k, *pack_words([flat[i] for i in own]), squeeze(own.astype(np.int32)), squeeze(counts[own]))])

        pieces, sizes, ids, weights, tokens, taken = [], [], [], [], 0, 0
        for batch in batches:
            data = as_bytes(batch.column(1))
            weight = batch.column(2).to_pylist() if weigh else [0] * len(data)
            for a, b in groups(list(map(len, data))):
                ids.append(batch.column(0).slice(a, b - a))
                weights += [int(bool(x)) for x in weight[a:b]]
                each, flat = cut(data[a:b])
                sizes.append(each)
                pieces.append(flat)
                tokens, taken = tokens + len(flat), taken + sum(map(len, data[a:b]))
                if tokens >= size or taken >= most:
                    yield from flush()
                    pieces, sizes, ids, weights, tokens, taken = [], [], [], [], 0, 0
        if ids:
            yield from flush()

    assert not weigh or named[2] == weigh
    return docs.mapInArrow(tidily(run), SCHEMA)


#: Bytes of input, as Spark's statistics have them, to a bucket at most.
BUCKET_BYTES = 8 << 20


def bucket_count(docs: DataFrame) -> int:
    """As many buckets as shuffles have partitions, and more for a large input, so that a bucket fits in a task."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES if size < 1 << 60 else 0)


def _words_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.compute.greater_equal(batch.column("bucket"), 0))


def by_bucket(packed: DataFrame, buckets: int) -> DataFrame:
    """The words' rows. A Python filter, so that the plan below stays one with the documents' and its exchange is used twice."""
    return packed.select(*SCHEMA_NAMES).mapInArrow(tidily(_words_only), SCHEMA).repartitionById(buckets, F.col("bucket"))


def assemble(packed: DataFrame, answers: DataFrame, buckets: int, fn: Callable[..., pa.Table], schema: str) -> DataFrame:
    """Documents of each chunk with the answers to its words: fn(ids, lengths, local numbers, weights, answers, carried)."""

    def run(chunk: pa.Table, found: pa.Table, fn) -> pa.Table:
        answers = found.to_pylist()
        for row in chunk.filter(pa.compute.equal(chunk["bucket"], -1)).to_pylist():
            lids = expand(row["c"], np.int32)
            if sum(len(expand(x["c"], np.int32)) for x in answers) != 1 + lids.max(initial=-1):
                raise RuntimeError("a chunk's words were not answered: its rows came in another order when a task was redone")
            return fn(ids_read(row["a"]), expand(row["b"], np.int32), lids, expand(row["d"], np.uint8), answers, row["e"])
        raise RuntimeError("answers without their chunk")

    return meet(packed, answers, buckets, lambda chunk, found: tidily(run)(chunk, found, fn=fn), schema)

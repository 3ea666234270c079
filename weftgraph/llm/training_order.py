"""Training-order materialisation of token ids in fixed-stride binary shards.

Every sequence has an index: its rank by document id (null first), the hash of
the text, and its place in the document. A keyed Feistel permutation of the
indices, with cycle-walking, gives each sequence its slot in the training order.
So a slot depends on the documents and the key alone, not on files, partitions
or tasks. Slots are dealt by range; a task writes whole shards, of which a
record has a header and ``length`` ids. A slot lies at a known offset of a known
shard, and reading can go on from any slot. Every text is encoded once.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache, partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import exchange
from .common import Scratch, as_bytes, checkpoint, groups, quoted, set_checkpoint_dir, tidily
from .merging import read_ranks

LENGTH = 256
#: Records of a shard, but for the last one.
SHARD = 16_384
#: Shards that one task writes, at most.
SHARDS_OF_TASK = 4
#: Stretches of the training order that are dealt one after the other, so that only a part of the records lies on disk twice.
WAVES = 4
#: Ids that are dealt out at once.
CHUNK_IDS = 2_000_000
#: Rows looked at for each task, to split the documents into ranges of about the same size.
SAMPLE = 20
#: Record header: id, place in the document, ids that count, 1 if the id is null.
HEADER = np.dtype([("doc", "<i8"), ("part", "<u4"), ("n", "<u4"), ("null", "<u4")])


def permute(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """Slots of indices below ``n``: a permutation of range(n) for each key."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little") for r in range(rounds)]
    out = index.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        x = out[walk]
        left, right = x >> half, x & mask
        for k in keys:
            mixed = (right ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((mixed >> np.uint64(29)) & mask)
        out[walk] = left << half | right
        walk = walk[out[walk] >= np.uint64(n)]  # what left the range goes round again
    return out.astype(np.int64)


@cache
def _tokenizer(path: str, pattern: str):
    import tiktoken

    ranks = read_ranks(path)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def tokenizer(path: str, pattern: str) -> Callable[[list[str]], Iterator[np.ndarray]]:
    """Ids of each text by a rank file, then one end id: the first that is free."""

    def run(texts: list[str]) -> Iterator[np.ndarray]:
        encoding, end = _tokenizer(path, pattern)
        for t in texts:
            yield np.frombuffer(array("I", [*encoding.encode_ordinary(t), end]), np.uint32)

    return run


def _encode(batches: Iterator[pa.RecordBatch], tokens, dtype: str, cuts: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Documents' ids, and the range that each document is in."""
    for batch in batches:
        data = as_bytes(batch.column(3))
        rank = [(x is not None, x or 0, t, s) for x, t, s in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
        for a, b in groups(list(map(len, data))):
            ids = [x.astype(dtype).tobytes() for x in tokens([t.decode() for t in data[a:b]])]
            part = [bisect_right(cuts, r) for r in rank[a:b]]
            yield pa.record_batch([pa.array(part, pa.int32()), *(batch.column(k).slice(a, b - a) for k in range(3)), pa.array(ids, pa.binary())], ["part", "id", "tie", "copy", "ids"])


def _number(batches: Iterator[pa.RecordBatch], length: int, dtype: str) -> Iterator[pa.RecordBatch]:
    """Chunks of a range's documents in order, and the sequences of the range before each."""
    before, part, docs, ids, size = 0, -1, [], [], 0

    def flush() -> pa.RecordBatch:
        nonlocal before
        each = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(dtype).itemsize
        n = int((-(-each // length)).sum())
        row = [[part], [before], [n], [exchange.squeeze(np.frombuffer(b"".join(ids), dtype))], [exchange.squeeze(each)], [exchange.ids_ipc(pa.concat_arrays(docs))]]
        before += n
        return pa.record_batch([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "start", "n", "a", "b", "c"])

    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column(0)[0].as_py()
        docs.append(batch.column(1))
        ids += as_bytes(batch.column(4))
        size += batch.column(4).nbytes
        if size >= CHUNK_IDS * np.dtype(dtype).itemsize:
            yield flush()
            docs, ids, size = [], [], 0
    if ids:
        yield flush()


def _deal(batches: Iterator[pa.RecordBatch], length: int, dtype: str, offsets: dict[int, int], n: int, key: int, stretch: int, since: int, until: int) -> Iterator[pa.RecordBatch]:
    """Records of the slots from ``since`` to ``until``, by the stretch of slots that they fall in."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, each = exchange.expand(row["a"], dtype), exchange.expand(row["b"], np.int64)
            parts = -(-each // length)
            slot = permute(offsets[row["part"]] + row["start"] + np.arange(row["n"]), n, key)
            mine = np.flatnonzero((slot >= since) & (slot < until))
            if not len(mine):
                continue
            slot = slot[mine]
            own = np.repeat(np.arange(len(each)), parts)[mine]
            place = mine - (np.cumsum(parts) - parts)[own]
            size = np.minimum(length, each[own] - length * place)
            begin = (np.cumsum(each) - each)[own] + length * place
            body = np.zeros((len(own), length), dtype)
            inside = np.arange(length) < size[:, None]
            body[inside] = ids[(begin[:, None] + np.arange(length))[inside]]
            doc = exchange.ids_read(row["c"]).combine_chunks()
            head = np.zeros(len(own), HEADER)
            head["doc"] = pa.compute.fill_null(doc.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)[own]
            head["null"] = doc.is_null().to_numpy(zero_copy_only=False)[own]
            head["part"], head["n"] = place, size
            flat = np.concatenate((head.view(np.uint8).reshape(len(own), -1), body.view(np.uint8).reshape(len(own), -1)), axis=1)
            target = slot // stretch
            order = np.argsort(target, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(target[order]) > 0))
            found = [(int(target[at[0]]), exchange.squeeze(slot[at]), exchange.squeeze(flat[at].T.tobytes())) for at in np.split(order, starts[1:])]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["target", "slots", "records"])


def _write(batches: Iterator[pa.RecordBatch], uri: str, stride: int, shard: int, stretch: int, n: int) -> Iterator[pa.RecordBatch]:
    """Shards of a stretch of slots; a file gets its name when it is complete, so a task can be redone."""
    store, root = pa.fs.FileSystem.from_uri(uri)
    records, filled = None, 0
    for batch in batches:
        for target, slots, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if records is None:
                first = target * stretch
                records = np.zeros((min(stretch, n - first), stride), np.uint8)
            at = exchange.expand(slots, np.int64) - first
            records[at] = np.frombuffer(exchange.expand(data), np.uint8).reshape(stride, len(at)).T
            filled += len(at)
    if records is None:
        return
    if filled != len(records):
        raise RuntimeError("not every slot has one record")
    for a in range(0, len(records), shard):
        own = records[a : a + shard]
        number = (first + a) // shard
        name, temporary = f"{root}/shard-{number:09d}.bin", f"{root}/{TEMPORARY}/{number}-{uuid.uuid4().hex}"
        with store.open_output_stream(temporary) as out:
            out.write(own.data)
        store.move(temporary, name)
        yield pa.record_batch([[number], [name], [first + a], [len(own)], [hashlib.sha256(own.data).hexdigest()]], ["shard", "path", "first_slot", "records", "sha256"])


MANIFEST = "shard long, path string, first_slot long, records long, sha256 string"
TEMPORARY = "_unfinished"


def _cuts(rows: DataFrame, tasks: int) -> list[tuple]:
    """Bounds of ranges of (id, tie, copy) that hold about as many rows each. They share out the work and change no slot."""
    total = rows.count()
    some = rows.sample(min(1.0, SAMPLE * tasks / max(total, 1)), 1).toArrow()
    found = sorted((x is not None, x or 0, t, c) for x, t, c in zip(*(some[k].to_pylist() for k in ("id", "tie", "copy")), strict=True))
    return [found[k * len(found) // tasks] for k in range(1, tasks)] if found else []


def write_shards(docs: DataFrame, uri: str, tokens, key: int, vocabulary: int, id: str = "doc_id", text: str = "text", length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """Write the sequences of all texts to shards under ``uri``, a folder that all executors share, and return the manifest.

    A text's ids are cut every ``length``; the last sequence is filled with
    zeros, which its header does not count. A null text is empty: one sequence
    with what ``tokens`` gives for it, and it must give an id at least. Ids of
    documents are integers, of which null ones are marked; equal rows are
    sequences of their own, and which of them comes first makes no difference;
    other columns are not carried. An empty table writes nothing and gives an
    empty manifest. Ids are 16 bits wide up to a ``vocabulary`` of 65,536, else
    32. The manifest has (shard, path, first_slot, records, sha256); shard k
    holds the slots from k * ``shard`` on.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[id].dataType, IntegralType):
        raise TypeError("records hold integer ids")
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    rows = docs.select(F.col(quoted(id)).cast("long").alias("id"), F.xxhash64(body).alias("tie"), F.monotonically_increasing_id().alias("copy"), body.alias("text"))
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    stride = HEADER.itemsize + length * np.dtype(dtype).itemsize
    tasks = exchange.bucket_count(docs)
    scratch = Scratch(spark, "sequences")
    encoded = rows.mapInArrow(partial(tidily(_encode), tokens=tokens, dtype=dtype, cuts=_cuts(rows.drop("text"), tasks)), "part int, id long, tie long, copy long, ids binary")
    ranged = encoded.repartitionById(tasks, F.col("part")).sortWithinPartitions(F.col("id").asc_nulls_first(), "tie", "copy")
    numbered = scratch.write(ranged.mapInArrow(partial(tidily(_number), length=length, dtype=dtype), "part int, start long, n long, a binary, b binary, c binary"))
    offsets, n = {}, 0
    for part, size in sorted(tuple(r) for r in numbered.groupBy("part").agg(F.sum("n")).collect()):
        offsets[part], n = n, n + size
    store, root = pa.fs.FileSystem.from_uri(uri)
    store.create_dir(f"{root}/{TEMPORARY}", recursive=True)
    shards = -(-n // shard)
    stretch = shard * max(1, min(SHARDS_OF_TASK, -(-shards // tasks)))
    wave = stretch * max(1, -(-n // (stretch * WAVES)))
    manifests = []
    for first in range(0, max(n, 1), wave):
        dealt = numbered.mapInArrow(partial(tidily(_deal), length=length, dtype=dtype, offsets=offsets, n=n, key=key, stretch=stretch, since=first, until=first + wave), "target int, slots binary, records binary")
        dealt = dealt.repartitionById(max(1, -(-min(wave, n - first) // stretch)), F.col("target") - first // stretch)
        manifests.append(scratch.write(dealt.mapInArrow(partial(tidily(_write), uri=uri, stride=stride, shard=shard, stretch=stretch, n=n), MANIFEST)))
    manifest = checkpoint(reduce(DataFrame.unionByName, manifests))
    scratch.drop()
    store.delete_dir(f"{root}/{TEMPORARY}")
    return manifest


def _read(batches: Iterator[pa.RecordBatch], uri: str, length: int, dtype: str, start: int) -> Iterator[pa.RecordBatch]:
    store, _ = pa.fs.FileSystem.from_uri(uri)
    record = np.dtype([("head", HEADER), ("ids", dtype, (length,))])
    for batch in batches:
        for row in batch.to_pylist():
            with store.open_input_file(row["path"]) as file:
                slot = max(row["first_slot"], start)
                file.seek((slot - row["first_slot"]) * record.itemsize)
                while data := file.read(4096 * record.itemsize):
                    found = np.frombuffer(data, record)
                    head = found["head"]
                    ids = [x[:n].astype("<u4").tobytes() for x, n in zip(found["ids"], head["n"], strict=True)]
                    doc = pa.array(head["doc"].astype(np.int64), mask=head["null"] > 0)
                    yield pa.record_batch([pa.array(np.arange(slot, slot + len(found))), doc, pa.array(head["part"].astype(np.int64)), pa.array(np.full(len(found), row["shard"])), pa.array(ids, pa.binary())], ["slot", "doc_id", "part", "shard", "ids"])
                    slot += len(found)


def read_shards(manifest: DataFrame, uri: str, vocabulary: int, length: int = LENGTH, start: int = 0) -> DataFrame:
    """Sequences from slot ``start`` on, in slot order within each shard: (slot, doc_id, part, shard, ids), ids as little-endian unsigned 32-bit integers.

    Shards before ``start`` are not opened, and the one that holds it is read from its place on.
    """
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    left = manifest.filter(F.col("first_slot") + F.col("records") > start)
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(n).mapInArrow(partial(tidily(_read), uri=uri, length=length, dtype=dtype, start=start), "slot long, doc_id long, part long, shard long, ids binary")


def shared_folder(spark) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return os.path.join(set_checkpoint_dir(spark), f"shards-{uuid.uuid4().hex}")

"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints that differ in at most 3 of 64 bits share at least 5 of 8 bytes in
place, so in one half of 4 they share 3: each distinct fingerprint is posted
under the 8 triples of its bytes. In a list the shared positional bytes of each
pair are tallied, pairs with fewer than 5 are dropped, and the rest is verified.
Longer lists are posted again under all 5 bytes in place that a pair could share:
such a list has three free bytes, hence at most 2**24 members, and its links are
found by probing the places within 3 bits. Lists give a forest of their links,
never all pairs; equal texts and equal fingerprints are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, checkpoint, extended, groups, map_batches, quoted, tidily
from .components import components, forest

SEED, SHINGLE, BITS_APART = 42, 3, 3
#: Members of a list whose pairs are tallied one by one; longer lists are posted under more bytes.
LIST = 256
#: Members of a 5-byte list up to which all are compared in blocks; beyond it places are probed.
DENSE = 2048

TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
FIVES = list(combinations(range(8), 5))


def _hashes(text: bytes) -> list[int]:
    words = text.lower().split()
    if len(words) < SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined, at, starts = b" ".join(words), 0, []
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [*starts[SHINGLE:], at]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends, strict=False)]


def fingerprint(texts: list[bytes]) -> np.ndarray:
    """Signed 64-bit fingerprints: bit set if set in over half of the shingles' hashes; 0 without words."""
    found = [np.array(_hashes(t), np.uint64) for t in texts]
    each = np.fromiter(map(len, found), np.int64, len(found))
    total = np.zeros((len(texts), 64), np.int64)
    for a, b in groups(each.tolist(), 50_000):
        for lo in range(0, int(each[a:b].sum()), 100_000):
            own = np.concatenate(found[a:b])[lo : lo + 100_000]
            bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            doc = np.repeat(np.arange(a, b), each[a:b])[lo : lo + 100_000]
            first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            total[doc[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * total > each[:, None], axis=1, bitorder="little").reshape(-1).view(np.int64)


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp) of each row; a null text has no words."""
    narrow = docs.select(docs[id].alias("id"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = as_bytes(batch.column(1))
            fp = [fingerprint(data[a:b]) for a, b in groups(list(map(len, data)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0, np.int64), *fp]))], ["id", "fp"])

    return narrow.mapInArrow(tidily(run), f"id {narrow.schema['id'].dataType.simpleString()}, fp long")


def _post(fp, places: tuple[int, ...], number: int):
    """Key of some bytes in place: their set's number, then the bytes."""
    key = F.lit(number).cast("long")
    for p in places:
        key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255)))
    return key


def _links(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs share 5 bytes in place and differ in 3 bits at most."""
    apart = a ^ b
    shared = np.zeros(len(a), np.int8)
    for p in range(8):
        shared += ((apart >> np.uint64(8 * p)) & np.uint64(255)) == 0
    some = np.flatnonzero(shared >= 5)
    return some[np.bitwise_count(apart[some]) <= BITS_APART]


@cache
def _flips() -> np.ndarray:
    """All numbers of 24 bits with 1 to 3 bits set."""
    bits = [1 << i for i in range(24)]
    return np.array([sum(c) for n in range(1, BITS_APART + 1) for c in combinations(bits, n)], np.uint32)


def _long_list(key: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links in a list that shares five bytes."""
    if len(fp) <= DENSE:
        found = []
        for i in range(0, len(fp), 256):
            x, y = np.nonzero(np.bitwise_count(fp[i : i + 256, None] ^ fp[None, :]) <= BITS_APART)
            keep = x + i < y
            found.append((fp[x[keep] + i], fp[y[keep]]))
        return forest(*(np.concatenate([f[k] for f in found]) for k in (0, 1)))
    free = [p for p in range(8) if p not in FIVES[key >> 40]]
    value = np.zeros(len(fp), np.uint32)
    for k, p in enumerate(free):
        value |= ((fp >> np.uint64(8 * p)) & np.uint64(255)).astype(np.uint32) << np.uint32(8 * k)
    place = np.full(1 << 24, -1, np.int32)
    place[value] = np.arange(len(fp), dtype=np.int32)
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for flip in _flips():
        other = place[value ^ flip]
        at = np.flatnonzero(other > np.arange(len(fp)))
        a, b = np.concatenate((a, at)), np.concatenate((b, other[at].astype(np.int64)))
        if len(a) > 4 * len(fp):
            a, b = forest(a, b)
    a, b = forest(a, b)
    return fp[a], fp[b]


def _scan(batches: Iterator[pa.RecordBatch], five: bool) -> Iterator[pa.RecordBatch]:
    """Links of the lists of a partition that is sorted by key and fingerprint; of three bytes, members of longer lists go on as (fp, key)."""
    none = np.zeros(0, np.int64)
    hot = None

    def out(a, b, key=None):
        n = len(a)
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)) if key is None else pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()) if key is None else pa.array(key)], ["a", "b", "key"])

    def emit(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal hot
        if hot is not None:
            cut = int(np.searchsorted(keys, hot, side="right"))
            yield out(fps[:cut], None, keys[:cut])
            keys, fps = keys[cut:], fps[cut:]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else none
        size = np.diff(np.append(first, len(keys)))
        long = np.repeat(size > LIST, size)
        if five:
            for f, n in zip(first[size > LIST], size[size > LIST], strict=True):
                yield out(*_long_list(int(keys[f]), fps[f : f + n].view(np.uint64)))
        elif long.any():
            yield out(fps[long], None, keys[long])
        keys, fps = keys[~long], fps[~long].view(np.uint64)
        a, b = [], []
        for s in range(1, min(LIST, len(keys))):
            same = np.flatnonzero(keys[s:] == keys[:-s])
            if not len(same):
                break
            good = same[_links(fps[same], fps[same + s])]
            a.append(fps[good])
            b.append(fps[good + s])
        if a:
            yield out(*forest(np.concatenate(a), np.concatenate(b)))

    def settled(held: list) -> tuple[np.ndarray, np.ndarray]:
        keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
        if five and len(keys):  # the same member may be posted by several triples
            fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])))
            keys, fps = keys[fresh], fps[fresh]
        return keys, fps

    held: list = []  # of one key
    for batch in batches:
        own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(own[0]):
            continue
        held.append(own)
        if five and held[0][0][0] == own[0][-1]:
            continue  # one list goes on
        keys, fps = settled(held)
        end = int(np.searchsorted(keys, keys[-1]))
        if end:
            yield from emit(keys[:end], fps[:end])
            keys, fps = keys[end:], fps[end:]
            if hot is not None and keys[0] != hot:
                hot = None
        if not five and len(keys) > LIST:
            hot = int(keys[-1])
            yield out(fps, None, keys)
            keys, fps = none, none
        held = [(keys, fps)] if len(keys) else []
    if held:
        yield from emit(*settled(held))


def _lists(postings: DataFrame, five: bool) -> DataFrame:
    """Links (a, b), and from lists that are too long (a, key)."""
    dealt = postings.repartition("key").sortWithinPartitions("key", "fp")
    return dealt.select("key", "fp").mapInArrow(partial(tidily(_scan), five=five), "a long, b long, key long")


def links(nodes: DataFrame) -> DataFrame:
    """A forest (a, b) that connects distinct fingerprints (column fp) as their links do."""
    fp = F.col("fp")
    posted = nodes.select(fp, F.explode(F.array(*[_post(fp, t, k) for k, t in enumerate(TRIPLES)])).alias("key"))
    found = checkpoint(_lists(posted, False))
    more = found.filter("key IS NOT NULL").select(F.col("a").alias("fp"), F.shiftright("key", 24).alias("triple"))
    at = lambda t: [_post(fp, f, k) for k, f in enumerate(FIVES) if set(t) <= set(f)]
    choice = F.array(*[F.array(*at(t)) for t in TRIPLES])
    again = more.select("fp", F.explode(choice[F.col("triple").cast("int")]).alias("key"))
    return found.filter("b IS NOT NULL").select("a", "b").unionByName(_lists(again, True).select("a", "b"))


def _components(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the fingerprints in ``rows`` (id, fp): (fp, least id that has it), and (fp, root) of those that link to another."""
    nodes = checkpoint(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(nodes))
    return nodes, checkpoint(roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct()))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row.

    Rows whose fingerprints link, directly or through others, share a
    component, named by its least id; null ids name none, so a component of
    null ids only is null. Null and wordless texts have fingerprint 0 and link
    like any other. Equal rows stay as many; other columns are not carried; an
    empty table gives an empty result.
    """
    rows = checkpoint(fingerprints(docs, id, text))
    nodes, linked = _components(rows)
    least = linked.join(nodes, "fp").groupBy("root").agg(F.min("least").alias("component"))
    known = checkpoint(linked.join(least, "root").select("fp", "component"))
    final = checkpoint(nodes.join(known, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")))
    return rows.join(final, "fp").select(F.col("id").alias(id), "fp", "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with its own columns: that of the least id, null ids last.

    Rows of one id, or without any, are rows of their own: each is judged by
    its text, and of several with the chosen id and fingerprint the one of the
    least text stays. Null and wordless texts are near-duplicates of each
    other. An empty table gives an empty result.
    """
    rows = checkpoint(fingerprints(docs, id, text))
    nodes, linked = _components(rows)
    each = rows.join(linked, "fp", "left").select(F.coalesce("root", "fp").alias("root"), F.struct(F.col("id").isNull().alias("nameless"), "id", "fp").alias("row"))
    chosen = each.groupBy("root").agg(F.min("row").alias("row")).select("row.id", "row.fp")
    several = rows.groupBy("id").agg((F.col("id").isNull() | (F.count(F.lit(1)) > 1)).alias("several"))
    chosen = checkpoint(chosen.join(several, chosen["id"].eqNullSafe(several["id"])).select(chosen["id"], "fp", "several"))
    plain = chosen.filter("NOT several").select(F.col("id").alias(id))
    own = [quoted(c) for c in docs.columns]
    kept = docs.join(plain, id, "left_semi").select(*own)
    if chosen.filter("several").isEmpty():
        return kept
    odd = chosen.filter("several").select("id", "fp")
    mine = docs.select(F.struct(*own).alias("row"), docs[id].alias("id"), docs[text].alias("text")).alias("d").join(odd.select("id").distinct().alias("o"), F.col("d.id").eqNullSafe(F.col("o.id")), "left_semi")
    marked = _marked(mine).alias("m").join(odd.alias("o"), F.col("m.id").eqNullSafe(F.col("o.id")) & (F.col("m.fp") == F.col("o.fp")), "left_semi")
    one = marked.groupBy("id", "fp").agg(F.min_by("row", F.coalesce("text", F.lit(""))).alias("row"))
    return kept.unionByName(one.select("row.*"))


def _marked(rows: DataFrame) -> DataFrame:
    """(row, id, text) with the texts' fingerprints."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = as_bytes(batch.column(2))
        fp = [fingerprint(data[a:b]) for a, b in groups(list(map(len, data)))]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0, np.int64), *fp]))], [*batch.schema.names, "fp"])

    return map_batches(rows, run, extended(rows.schema, "fp long"))

"""Quality rules: word and line counts, and a hashed n-gram log-likelihood ratio.

The ratio weighs byte n-grams of trusted texts against those of the whole
corpus, as two multinomials over hash buckets. A document's score is the mean
over its n-grams, and it is kept if that reaches one threshold, set on all the
labelled documents. Corpus counts take in every document; only the buckets'
counts, whose number is fixed, leave the executors.

A mean over n-grams does not see some words in a long text. So a second ratio
weighs words by the labelled documents that have them, toxic against trusted.
The weights of a document's marked words are summed and divided by the root of
the number of its distinct words. That threshold is set on documents that the
weights were not fitted on; a document that reaches it is rejected. Of words,
only the marked ones, which are the model, leave the executors, and of scores
only the threshold.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import exchange
from .common import Scratch, as_bytes, extended, groups, map_batches, shuffles_dropped, tidily
from .decontamination import _WORD

#: Bytes of an n-gram, and bits of a bucket's number.
NGRAM, BITS = 3, 16
#: What rejecting a trusted document costs against keeping one labelled bad.
COST = 20
#: Parts of the labelled documents, each scored by what the others say of words; toxic documents that a word must be in, and the weight that marks it.
FOLDS, SEEN, MARKED = 5, 3, 3.0
SYMBOLS = b"#*$%&|<>"
WINDOW = 5


def _buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each text, white space as one space, and their numbers."""
    joined = [b" " + b" ".join(t.split()) + b" " for t in texts]
    data = np.frombuffer(b"".join(joined), np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, joined), np.int64, len(joined))
    each = np.maximum(lengths - NGRAM + 1, 0)
    if len(data) < NGRAM:
        return np.zeros(0, np.int64), each
    code = np.zeros(len(data) - NGRAM + 1, np.uint32)
    for i in range(NGRAM):
        code |= data[i : len(code) + i] << np.uint32(8 * i)
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    inside = np.arange(len(code)) - np.repeat(starts, lengths)[: len(code)] < np.repeat(each, lengths)[: len(code)]
    return bucket[inside], each


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BITS, np.int64)
    for batch in batches:
        texts = as_bytes(batch.column(0))
        for a, b in groups(list(map(len, texts))):
            total += np.bincount(_buckets(texts[a:b])[0], minlength=1 << BITS)
    used = np.flatnonzero(total)
    yield pa.record_batch([used, total[used]], ["bucket", "n"])


def _counted(texts: DataFrame) -> np.ndarray:
    found = texts.mapInArrow(tidily(_bucket_counts), "bucket long, n long").groupBy("bucket").agg(F.sum("n")).toPandas().to_numpy(np.int64)
    out = np.zeros(1 << BITS)
    out[found[:, 0]] = found[:, 1]
    return out


def _scores(texts: list[bytes], ratio: np.ndarray) -> np.ndarray:
    bucket, each = _buckets(texts)
    total = np.bincount(np.repeat(np.arange(len(texts)), each), ratio[bucket], len(texts))
    return total / np.maximum(each, 1)


def judged(labels: DataFrame, good: str, toxic: str = "false") -> DataFrame:
    """(doc_id, trusted, toxic) of all labelled documents; with several labels, trusted if all are, toxic if one is. Null ids and labels do not count."""
    named = labels.select("doc_id", F.expr(good).alias("trusted"), F.expr(toxic).alias("toxic")).dropna()
    return named.groupBy("doc_id").agg(F.min("trusted").alias("trusted"), F.max("toxic").alias("toxic"))


#: Bytes of texts that a task packs together.
PACKED = 32 << 20


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids and compressed texts of a task's documents, by bucket."""
    held: dict[int, list[tuple[pa.Array, list[bytes]]]] = defaultdict(list)
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for bucket, parts in held.items():
            ids, texts = pa.concat_arrays([x for x, _ in parts]), [t for _, own in parts for t in own]
            packed = (exchange.squeeze(exchange.ids_ipc(ids)), *exchange.pack_words(texts))
            yield pa.record_batch([pa.array([bucket], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], ["bucket", "ids", "texts", "sizes"])

    for batch in batches:
        bucket, texts = batch.column(0).to_numpy(), as_bytes(batch.column(2))
        for k in np.unique(bucket).tolist():
            at = np.flatnonzero(bucket == k)
            held[k].append((batch.column(1).take(pa.array(at)), [texts[i] for i in at]))
        size += sum(map(len, texts))
        if size >= PACKED:
            yield from flush()
            held.clear()
            size = 0
    yield from flush()


def _met(docs: pa.Table, labels: pa.Table, schema: pa.Schema) -> pa.Table:
    of = dict(zip(labels["doc_id"].to_pylist(), zip(labels["trusted"].to_pylist(), labels["toxic"].to_pylist(), strict=True), strict=True))
    out = []
    for row in docs.to_pylist():
        ids = exchange.ids_read(exchange.expand(row["ids"])).to_pylist()
        for id, text in zip(ids, exchange.unpack_words(row["texts"], row["sizes"]), strict=True):
            if id in of:
                out.append((id, text, *of[id]))
    return pa.Table.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, trusted, toxic) of the documents that have a label. Texts travel compressed, many together; no table is broadcast."""
    buckets = exchange.bucket_count(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    bucket = F.pmod(F.xxhash64(F.col("doc_id").cast(kind)), F.lit(buckets)).cast("int").alias("bucket")
    named = docs.filter("doc_id IS NOT NULL").select(bucket, "doc_id", "text").mapInArrow(tidily(_packed), "bucket int, ids binary, texts binary, sizes binary")
    told = labels.select(bucket, F.col("doc_id").cast(kind).alias("doc_id"), "trusted", "toxic")
    schema = pa.schema([("doc_id", to_arrow_type(docs.schema["doc_id"].dataType)), ("text", pa.binary()), ("trusted", pa.bool_()), ("toxic", pa.bool_())])
    sides = [x.repartitionById(buckets, F.col("bucket")).groupBy("bucket") for x in (named, told)]
    return sides[0].cogroup(sides[1]).applyInArrow(lambda a, b: tidily(_met)(a, b, schema=schema), f"doc_id {kind}, text binary, trusted boolean, toxic boolean")


def cheapest(scored: DataFrame, scratch: Scratch) -> DataFrame:
    """(score, lost): what it costs to part rows (score, below, above) at each score, ``below`` of those under it and ``above`` of the others.

    Sorted ranges are summed by themselves and meet by their totals, so no task has all scores.
    """
    each = scored.groupBy("score").agg(F.sum("below").alias("below"), F.sum("above").alias("above"))
    laid = scratch.write(each.repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    ranges = laid.groupBy("part").agg(F.sum("below").alias("b"), F.sum("above").alias("a"))
    before, after = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("part").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranges = ranges.select("part", (F.coalesce(F.sum("b").over(before), F.lit(0.0)) + F.sum("a").over(after)).alias("lost"))
    here = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    inner = laid.withColumn("more", F.coalesce(F.sum(F.col("below") - F.col("above")).over(here), F.lit(0.0)))
    return inner.join(F.broadcast(ranges), "part").select("score", (F.col("lost") + F.col("more")).alias("lost"))


def fit(docs: DataFrame, some: DataFrame, scratch: Scratch, cost: float = COST) -> tuple[np.ndarray, float]:
    """Log ratio of each bucket, and the threshold: of the labelled scores, the one that costs least to reject below, the lowest of several.

    ``some`` has (doc_id, trusted, toxic, text) of the labelled documents.
    Without a trusted document all ratios are 0 and everything passes.
    """
    target = _counted(some.filter("trusted").select("text"))
    if not target.any():
        return np.zeros(1 << BITS), -1.0
    log = lambda x: np.log((x + 1) / (x.sum() + len(x)))
    ratio = log(target) - log(_counted(docs.select("text")))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    score = lambda batch: pa.record_batch([batch.column(1), pa.array(_scores(as_bytes(batch.column(0)), shared.value))], ["trusted", "score"])
    scored = map_batches(some.select("text", "trusted"), score, "trusted boolean, score double")
    lost = cheapest(scored.select("score", F.when(F.col("trusted"), float(cost)).otherwise(0.0).alias("below"), F.when(F.col("trusted"), 0.0).otherwise(1.0).alias("above")), scratch)
    return ratio, lost.agg(F.min(F.struct("lost", "score"))["score"]).first()[0]


def _plain_words(text: bytes) -> set[bytes]:
    return set(text.translate(_WORD).split())


#: Words whose numbers a task holds before it sends them.
_HELD = 200_000
_NUMBERS = [f"n{k}{t}" for k in range(FOLDS) for t in (0, 1)]


def _judged_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each word, by fold and verdict."""
    n: dict[bytes, list[int]] = {}

    def flush() -> pa.RecordBatch:
        numbers = np.array(list(n.values()), np.int64).reshape(-1, 2 * FOLDS)
        return pa.record_batch([pa.array(list(n), pa.binary()), *map(pa.array, numbers.T.copy())], ["word", *_NUMBERS])

    for batch in batches:
        for text, fold, bad in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            for word in _plain_words(text):
                if (own := n.get(word)) is None:
                    own = n[word] = [0] * (2 * FOLDS)
                own[2 * fold + bad] += 1
            if len(n) > _HELD:
                yield flush()
                n.clear()
    yield flush()


def _weights(batch: pa.RecordBatch, sizes: np.ndarray) -> pa.RecordBatch:
    """Words that are marked by all documents or by those without some fold, with their weights there; nan where they are not."""
    number = np.stack([batch.column(1 + k).to_numpy() for k in range(2 * FOLDS)], axis=1).reshape(-1, FOLDS, 2)
    out = []
    for without in (*range(FOLDS), None):
        trusted, toxic = sizes.sum(0) - (sizes[without] if without is not None else 0)
        n = number.sum(1) - (number[:, without] if without is not None else 0)
        weight = np.log((n[:, 1] + 0.5) / (toxic + 1)) - np.log((n[:, 0] + 0.5) / (trusted + 1))
        out.append(np.where((n[:, 1] >= SEEN) & (weight >= MARKED), weight, np.nan))
    kept = np.flatnonzero(~np.isnan(out).all(0))
    return pa.record_batch([batch.column(0).take(pa.array(kept)), *(pa.array(w[kept]) for w in out)], ["word", *(f"w{k}" for k in range(FOLDS + 1))])


def _toxicity(text: bytes, weights: dict[bytes, float]) -> float:
    words = _plain_words(text)
    return sum(sorted(weights[w] for w in words.intersection(weights))) / np.sqrt(max(len(words), 1))


def _held_out(batch: pa.RecordBatch, weights) -> pa.RecordBatch:
    """Whether toxic, and the score by what the other folds say."""
    found = [_toxicity(t, weights.value[k]) for t, k in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True)]
    return pa.record_batch([batch.column(2), pa.array(found, pa.float64())], ["toxic", "score"])


def fit_toxic(some: DataFrame, scratch: Scratch, cost: float = COST) -> tuple[dict[bytes, float], float]:
    """Weights of the marked words, and the score from which a document is rejected: the one that costs least for held-out documents, the highest of several."""
    spark = some.sparkSession
    marked = some.filter("trusted OR toxic").select("text", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).alias("fold"), "toxic")
    sizes = np.zeros((FOLDS, 2), np.int64)
    for r in marked.groupBy("fold", "toxic").count().collect():
        sizes[r["fold"], int(r["toxic"])] = r["count"]
    if not sizes[:, 0].any() or not sizes[:, 1].any():
        return {}, np.inf
    counted = marked.mapInArrow(tidily(_judged_words), "word binary, " + ", ".join(f"{c} long" for c in _NUMBERS))
    number = counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in _NUMBERS]).filter(sum((F.col(f"n{k}1") for k in range(1, FOLDS)), F.col("n01")) >= SEEN)
    with shuffles_dropped(spark):
        told = map_batches(number, partial(_weights, sizes=sizes), "word binary, " + ", ".join(f"w{k} double" for k in range(FOLDS + 1))).toArrow()
    words = told["word"].to_pylist()
    weights = [{words[i]: float(w[i]) for i in np.flatnonzero(~np.isnan(w))} for w in (told[f"w{k}"].to_numpy() for k in range(FOLDS + 1))]
    held = spark.sparkContext.broadcast(weights[:FOLDS])
    scored = scratch.write(map_batches(marked, partial(_held_out, weights=held), "toxic boolean, score double"))
    lost = cheapest(scored.select("score", F.when(F.col("toxic"), 1.0).otherwise(0.0).alias("below"), F.when(F.col("toxic"), 0.0).otherwise(float(cost)).alias("above")), scratch)
    best = lost.filter("score > 0").agg(F.min(F.struct("lost", (-F.col("score")).alias("score"))).alias("x")).first()["x"]
    # to reject none costs all toxic ones, and is the highest of all scores
    least = np.inf if best is None or best["lost"] >= sizes[:, 1].sum() else -best["score"]
    return weights[FOLDS], least


def _repeats(texts: list[list[bytes]]) -> np.ndarray:
    """Words of each text in windows of 5 words found twice or more in it."""
    each = np.fromiter(map(len, texts), np.int64, len(texts))
    number = defaultdict()
    number.default_factory = number.__len__
    words = np.fromiter((number[w] for t in texts for w in t), np.int64, int(each.sum()))
    if len(words) < WINDOW:
        return np.zeros(len(texts), np.int64)
    doc = np.repeat(np.arange(len(texts)), each)
    rank = lambda x: np.unique(x, return_inverse=True)[1]
    one = rank(doc * len(number) + words)
    two = rank(one[:-1] * (one.max() + 1) + one[1:])
    four = rank(two[:-2] * (two.max() + 1) + two[2:])
    _, five, n = np.unique(four[:-1] * (one.max() + 1) + one[4:], return_inverse=True, return_counts=True)
    start = (n[five] > 1) & (doc[: -WINDOW + 1] == doc[WINDOW - 1 :])
    covered = np.zeros(len(words), bool)
    for i in range(WINDOW):
        covered[i : len(start) + i] |= start
    return np.bincount(doc, covered, len(texts)).astype(np.int64)


def _rules(batch: pa.RecordBatch, at: int, fitted) -> pa.RecordBatch:
    ratio, threshold, weights, most = fitted.value
    texts = as_bytes(batch.column(at))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "quality_score")
    out: dict[str, list[np.ndarray]] = {k: [] for k in names}
    bad = np.fromiter((bool(weights) and _toxicity(t, weights) >= most for t in texts), bool, len(texts))
    for a, b in groups(list(map(len, texts))):
        own = texts[a:b]
        words = [t.split() for t in own]
        lines = [[x for x in t.split(b"\n") if x.strip()] for t in own]
        points = [np.frombuffer(b"".join(w), np.uint8) & 0xC0 for w in words]
        out["n_words"].append(np.fromiter(map(len, words), np.int64, len(own)))
        out["word_chars"].append(np.fromiter((np.count_nonzero(p != 0x80) for p in points), np.int64, len(own)))
        out["n_symbols"].append(np.fromiter((len(t) - len(t.translate(None, SYMBOLS)) for t in own), np.int64, len(own)))
        out["n_dup_lines"].append(np.fromiter((len(x) - len(set(x)) for x in lines), np.int64, len(own)))
        out["n_repeat_words"].append(_repeats(words))
        out["quality_score"].append(_scores(own, ratio))
    done = {k: np.concatenate(v) if v else np.zeros(0, np.float64 if k == "quality_score" else np.int64) for k, v in out.items()}
    failed = (done["n_words"] < 10) | (100 * done["n_repeat_words"] > 20 * done["n_words"])
    kept = ~failed & (done["quality_score"] >= threshold) & ~bad
    return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, done.values()), pa.array(failed), pa.array(kept)], [*batch.schema.names, *names, "base_failed", "kept"])


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "quality_score", "base_failed", "kept")


def quality_rules(docs: DataFrame, labels: DataFrame, good: str = "quality = 1 AND toxic = 0", cost: float = COST, toxic: str = "toxic = 1") -> DataFrame:
    """Add the rules' counts, the ratio's score and the verdict ``kept`` to every document.

    A null text has no words and so fails the base rules. Documents without an
    id or a label are judged like others. Columns of ``docs`` with the added
    names are replaced; others stay; equal rows stay as many; empty tables give
    an empty result.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    some = scratch.write(labelled(docs, judged(labels, good, toxic)), compression="zstd")
    weights, most = fit_toxic(some, scratch, cost)
    fitted = docs.sparkSession.sparkContext.broadcast((*fit(docs, some, scratch, cost), weights, most))
    scratch.drop()
    rest = docs.drop(*ADDED)
    kinds = ["long"] * 5 + ["double", "boolean", "boolean"]
    schema = extended(rest.schema, ", ".join(f"{n} {k}" for n, k in zip(ADDED, kinds, strict=True)))
    return map_batches(rest, partial(_rules, at=rest.columns.index("text"), fitted=fitted), schema)

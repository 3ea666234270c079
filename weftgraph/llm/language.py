"""Language identification by mixtures of languages.

A language is a multinomial over hash buckets of byte trigrams. A document's
trigrams are taken as drawn from a mixture; expectation-maximisation gives its
proportions. Of the nested sets of the languages with the largest shares, the one
with the best likelihood less a penalty for each further language is selected,
and the largest share in it names the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, extended, groups, map_batches, tidily

BITS = 15
#: Languages that a model may hold; more is an error, never a cut.
LANGUAGES = 256
#: EM steps, and what a further language must add to the log-likelihood, in units of log(trigrams); trigrams overlap threefold.
STEPS, PENALTY = 12, 3.0
_LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
UNDETERMINED = "und"


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode()))


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram of letters in lower case, other bytes as one space, and the trigrams of each text."""
    joined = [b" " + b" ".join(t.decode().lower().encode().translate(_LETTERS).split()) + b" " for t in texts]
    data = np.frombuffer(b"".join(joined), np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, joined), np.int64, len(joined))
    each = np.maximum(lengths - 2, 0)
    code = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
    starts = np.cumsum(lengths) - lengths
    inside = np.arange(len(code)) - np.repeat(starts, lengths)[: len(code)] < np.repeat(each, lengths)[: len(code)]
    return ((code[inside] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64), each


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = as_bytes(batch.column(0)), batch.column(1).to_pylist()
        for a, b in groups(list(map(len, texts))):
            bucket, each = _trigrams(texts[a:b])
            of = np.repeat(np.arange(a, b), each)
            names = np.array(langs[a:b], object)
            for lang in set(names):
                own = bucket[(names == lang)[of - a]]
                total[lang] = total.get(lang, 0) + np.bincount(own, minlength=1 << BITS)
                if len(total) > LANGUAGES:
                    raise ValueError(f"over {LANGUAGES} languages")
    for lang, n in total.items():
        used = np.flatnonzero(n)
        yield pa.record_batch([pa.array([lang] * len(used), pa.string()), used, n[used]], ["lang", "bucket", "n"])


def fit(train: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and the probability of each bucket in each of them. Rows without text or language do not count."""
    rows = train.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, F.col(lang).cast("string"))
    counts = rows.mapInArrow(tidily(_count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    if (n := rows.select(lang).distinct().limit(LANGUAGES + 1).count()) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    found = counts.toPandas()
    langs = sorted(found["lang"].unique())
    table = np.zeros((len(langs), 1 << BITS))
    row = {x: k for k, x in enumerate(langs)}
    table[found["lang"].map(row).to_numpy(np.int64), found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return langs, (table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * (1 << BITS)) if n else table


def _mixture(p: np.ndarray, n: np.ndarray, doc: np.ndarray, first: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM: shares of the allowed languages in each document, and the log-likelihood."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    total = np.add.reduceat(n, first)
    for _ in range(STEPS):
        part = p * share[doc]
        seen = part.sum(axis=1)
        share = np.add.reduceat(part * (n / seen)[:, None], first, axis=0) / total[:, None]
    return share, np.add.reduceat(n * np.log((p * share[doc]).sum(axis=1)), first)


def infer(texts: list[bytes], model: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: shares in the selected set, shares among all languages, and the size of the set. Every text needs a trigram."""
    bucket, each = _trigrams(texts)
    key, n = np.unique(np.repeat(np.arange(len(texts)), each) << BITS | bucket, return_counts=True)
    doc, n = key >> BITS, n.astype(np.float64)
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    p = np.ascontiguousarray(model[:, key & (1 << BITS) - 1].T)
    full, _ = _mixture(p, n, doc, first, np.ones((len(texts), len(model))))
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    single = np.add.reduceat(n[:, None] * np.log(p), first, axis=0)
    best = np.where(single == single.max(axis=1, keepdims=True), 1.0, 0.0)
    best /= best.sum(axis=1, keepdims=True)
    value, size = single.max(axis=1), np.ones(len(texts), np.int64)
    price = penalty * np.log(np.maximum(each, 2))
    open_ = np.ones(len(texts), bool)
    for k in range(2, len(model) + 1):
        # a document whose k-th share is nothing gains nothing by a larger set
        open_ &= (np.where(rank == k - 1, full, 0).max(axis=1) > 1e-3)
        if not open_.any():
            break
        at = np.flatnonzero(open_)
        rows = np.isin(doc, at)
        number = np.cumsum(open_) - 1
        own = number[doc[rows]]
        begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        share, fits = _mixture(p[rows], n[rows], own, begin, (rank[at] < k).astype(np.float64))
        fits = fits - (k - 1) * price[at]
        better = fits > value[at]
        best[at[better]], value[at[better]], size[at[better]] = share[better], fits[better], k
    return best, full, size


def _predict(batch: pa.RecordBatch, at: int, fitted) -> pa.RecordBatch:
    langs, model = fitted.value
    texts = as_bytes(batch.column(at))
    pred: list[str] = [UNDETERMINED] * len(texts)
    score = np.zeros(len(texts))
    mixed: list = [[] for _ in texts]
    for a, b in groups(list(map(len, texts))):
        own = [i for i in range(a, b) if texts[i] and has_letter(texts[i])] if langs else []
        if not own:
            continue
        best, full, size = infer([texts[i] for i in own], model)
        for i, x, y, k in zip(own, best, full, size, strict=True):
            top = int(np.argmax(x))
            pred[i], score[i] = langs[top], min(1.0, max(0.0, float(y[top])))
            mixed[i] = [langs[j] for j in np.argsort(-x, kind="stable")[:k]]
    added = [pa.array(pred, pa.string()), pa.array(score), pa.array(mixed, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *ADDED])


ADDED = ("lang_pred", "score", "languages")


def identify(docs: DataFrame, train: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Add the predicted language, its share among all learned ones, and the selected set, largest share first.

    Only the texts and languages of ``train`` are learned. A text that is null
    or without a letter is ``und`` with score 0, as is every text if nothing
    was learned. Columns with the added names are replaced, others stay, equal
    rows stay as many, and an empty table gives an empty result.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(fit(train, text, lang))
    rest = docs.drop(*ADDED)
    schema = extended(rest.schema, "lang_pred string, score double, languages array<string>")
    return map_batches(rest, partial(_predict, at=rest.columns.index(text), fitted=fitted), schema)

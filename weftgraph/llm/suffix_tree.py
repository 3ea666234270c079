"""Scoring by a probabilistic suffix tree over words.

Symbols are the training corpus's words, the end of a text, and one for every
other word. A context is the run of up to ``depth`` words before a symbol that
the training texts have ``least`` times or more, an absolute number at every
size of the corpus, so the model grows with it. All its continuations count,
single ones too, and its distribution is smoothed towards that of its longest
proper suffix, at the root by an absolute discount whose mass is that of unseen
words. A context is retained if its distribution diverges enough from the
suffix's, that one smoothed towards the root: by the sum, over its occurrences,
of the log ratio of the two, each occurrence left out of what predicts it. That
rule is the same for all contexts at every size of the corpus. A symbol is scored by the longest retained context
before it; shorter ones, retained or not, are the inner nodes that smooth it.

Contexts and entries (context, symbol) are runs of symbols, and both numbers
are numbers of runs. They are counted size by size: a chunk of documents asks
the hash buckets once for each distinct run whose context is known to be
frequent, and says how likely its symbol is after the suffix. All runs of a
context meet in one bucket, which answers with each one's number in all chunks
and the verdict on the context. Those of a context of ``SPREAD`` occurrences are
spread over the buckets by themselves: each bucket adds up its share of the
context's divergence, and the shares' sum is the verdict. What a chunk knows of its places lies beside it in the
shared folder; a step's tables and shuffles go when the next one has them.
Of the model, only the hashes of retained contexts that are spread reach the
driver: one for ``SPREAD`` tokens and size at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import Scratch, checkpoint, quoted, shuffles_dropped, tidily

#: The divergence, in nats, is the best of 0, 1, 3 and 10 for held-out texts of sf0.1.
DEPTH, LEAST, DIVERGENCE, PRIOR = 4, 2, 3.0, 1.0
#: Tokens of a chunk: large, since a chunk asks for each of its runs once.
CHUNK = 4_600_000
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_END = np.uint64(0x5851F42D4C957F2D)
_HIGH = np.uint64(0xFFFFFFFF00000000)
#: Occurrences from which a context's runs are spread, so that no bucket must hold them all. It says nothing of the verdict.
SPREAD = 100_000
#: Marks, among the sizes of the groups of a question, a run that is dealt by itself; and the rows of a bucket's shares of divergences.
_APART, _SHARES = np.uint32(1 << 31), -5
#: Logarithms of probabilities are sent, and gains summed, in whole thousandths and millionths, so that no order of chunks changes them.
_LOG_UNIT, _GAIN_UNIT = 1e3, 1e6


def lower_words(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """A-Z lower-cased; words are runs without space and U+0009 to U+000D."""
    return exchange.words_of([t.lower() for t in texts])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M[1]
    return x ^ (x >> np.uint64(29))


class _Places:
    """Every symbol of a chunk's texts, ends included."""

    def __init__(self, row: dict):
        hashes, self.each, lids = exchange.expand(row["e"], np.uint64), exchange.expand(row["b"], np.int32), exchange.expand(row["c"], np.int32)
        size = self.each.astype(np.int64) + 1
        ends = np.cumsum(size) - 1
        self.n_words = len(hashes)
        self.is_word = np.ones(int(size.sum()), bool)
        self.is_word[ends] = False
        self.word = np.full(len(self.is_word), len(hashes), np.int32)  # the end's number is one past the words'
        self.word[self.is_word] = lids
        self.have = np.minimum(np.arange(len(self.word)) - np.repeat(ends - self.each, size), 255).astype(np.uint8)
        self.train_docs = exchange.expand(row["d"], np.uint8) > 0
        self.train = np.repeat(self.train_docs, size)
        self.of_word = _mix(np.append(hashes, _END) + _M[0])

    def per_document(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, np.cumsum(self.each.astype(np.int64) + 1) - self.each - 1) if len(self.each) else x

    def runs(self) -> Iterator[np.ndarray]:
        """Hashes of the run that ends at each place, of one symbol, of two, and so on."""
        one = self.of_word[self.word]
        key = one
        while True:
            yield key
            longer = np.zeros(len(key), np.uint64)
            if len(key):
                longer[1:] = _mix(key[:-1] * _M[2] + one[1:])
            key = longer

    def after(self, frequent: np.ndarray, size: int) -> np.ndarray:
        """Places whose context of ``size`` words is one of the frequent runs that end at the place before."""
        return np.append(False, frequent[:-1])[: len(frequent)] & (self.have >= size)


def _carry(words: list[bytes]) -> bytes:
    return exchange.squeeze(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))


def _word_counts(answers: list[dict], n_words: int) -> np.ndarray:
    count = np.zeros(n_words, np.int64)
    for x in answers:
        count[exchange.expand(x["c"], np.int32)] = exchange.expand(x["a"], np.int64)
    return count


def _spread(keys: np.ndarray, answers: list[np.ndarray]) -> np.ndarray:
    """To every key of a chunk, the answer for it: those to its sorted distinct keys, bucket by bucket."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.append(True, ranked[1:] != ranked[:-1])[: len(keys)]
    value = np.concatenate([np.zeros(0, np.int64), *answers])
    if len(value) != np.count_nonzero(new):
        raise RuntimeError("a chunk's runs were not answered")
    out = np.empty(len(keys), value.dtype)
    out[order] = value[np.cumsum(new) - 1]
    return out


#: Rows that a chunk keeps beside it: places after a frequent context, as bits; and twice the number of the run with their symbol, plus 1 if the context is retained.
def _live(size: int) -> int:
    return -10 * size - 1


def _number(size: int) -> int:
    return -10 * size - 2


def _kept(others: list[dict], bucket: int) -> bytes:
    return next(x["a"] for x in others if x["bucket"] == bucket)


def _places_of(others: list[dict], size: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(exchange.expand(_kept(others, _live(size))), np.uint8), count=n))


def _dealt_as(context: np.ndarray, run: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """The key by which runs are sorted and dealt: by the context first, but for runs that are dealt by themselves."""
    return (np.where(apart, run, context) & _HIGH) | (run & ~_HIGH)


def _last_runs(places: _Places, size: int, n: int = 2) -> list[np.ndarray]:
    """Hashes of the runs of the last ``n`` sizes up to ``size``."""
    return [x for k, x in zip(range(1, size + 1), places.runs(), strict=False) if k > size - n]


def _told(places: _Places, others: list[dict], size: int, words: np.ndarray, spread: int, frequent: float, retained: np.ndarray, runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, what is kept of them, numbers of the runs of ``size - 1`` symbols) from the answers for runs of ``size`` symbols."""
    before = words[places.word]
    if size > 2:
        before = np.zeros(len(places.word), np.int64)
        before[_places_of(others, size - 1, len(before))] = exchange.expand(_kept(others, _number(size - 1)), np.int64) >> 1
    at = _places_of(others, size, len(before))
    key = _dealt_as(runs[0][at - 1], runs[1][at], before[at - 1] >= spread)
    answers = sorted((x for x in others if x["bucket"] >= 0), key=lambda x: x["bucket"])
    told = _spread(key, [exchange.expand(x["a"], np.int64) for x in answers])
    if len(retained):
        apart = np.flatnonzero(before[at - 1] >= spread)
        told[apart] |= np.isin(runs[0][at[apart] - 1], retained)
    return at, told | (before[at - 1] >= frequent), before


def _ask(row: dict, others: list[dict], size: int, least: int, spread: int, frequent: float, retained: np.ndarray, ends: int, root: Callable, prior: float, buckets: int) -> Iterator[tuple]:
    """Questions for the runs of ``size`` symbols whose contexts are frequent, from what is known of the shorter ones."""
    places, chunk = _Places(row), row["chunk"]
    runs = _last_runs(places, size, 3)
    if size == 2:
        words = np.append(_word_counts(_all_words(row, others), places.n_words), ends)
        yield chunk, _number(1), exchange.squeeze(words)
        count = before = words[places.word]
    else:
        words = exchange.expand(_kept(others, _number(1)), np.int64)
        at, told, before = _told(places, others, size - 1, words, spread, frequent, retained, runs)
        yield chunk, _number(size - 1), exchange.squeeze(told)
        count = np.zeros(len(places.word), np.int64)
        count[at] = told >> 1
        del told
    live = places.after((count >= least) & places.is_word, size - 1)
    yield chunk, _live(size), exchange.squeeze(np.packbits(live).tobytes())
    at = np.flatnonzero(live)
    context = runs[-2][at - 1]
    key = _dealt_as(context, runs[-1][at], count[at - 1] >= spread)
    del runs, live
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    n = np.add.reduceat(places.train[at[order]], start, dtype=np.int32) if len(start) else np.zeros(0, np.int32)
    first = order[start]
    key, context = key[start], context[first]
    at = at[first]
    p = root(words)[places.word[at]]
    if size > 2:
        p = (np.maximum(count[at] - 1, 0) + prior * p) / (before[at - 1] - 1 + prior)
    unlikely = np.rint(np.log(p) * -_LOG_UNIT).astype(np.uint16)
    bucket = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    begin = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    for k in range(buckets):
        a, b = begin[k], begin[k + 1]
        if a < b:
            total = count[at[a:b] - 1]
            apart = total >= spread
            groups = np.flatnonzero(np.append(True, (context[a + 1 : b] != context[a : b - 1]) | apart[1:] | apart[:-1]))
            each, group, lone = np.diff(np.append(groups, b - a)).astype(np.uint32), context[a:b][groups], apart[groups]
            named, first, code = np.unique(group[lone], return_index=True, return_inverse=True)
            each[lone], group[lone] = _APART | code.astype(np.uint32), key[a:b][groups][lone]
            # after the groups, the contexts of the runs that are dealt by themselves, and their numbers
            hashes = np.concatenate([np.diff(group, prepend=np.uint64(0)), named, total[groups][lone][first].astype(np.uint64)])
            found = hashes, each, key[a:b].astype(np.uint32), n[a:b], unlikely[a:b]
            yield chunk, k, *map(exchange.squeeze, found)


def _asked(row: dict) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """What stands for the context of each run of a question; and of those dealt by themselves the places, contexts, and the contexts' numbers."""
    hashes, each = exchange.expand(row["a"], np.uint64), exchange.expand(row["b"], np.uint32)
    lone = each >= _APART
    size = np.where(lone, 1, each).astype(np.int64)
    named, total = np.split(hashes[len(each) :], 2)
    code = each[lone] & ~_APART
    return np.repeat(np.cumsum(hashes[: len(each)], dtype=np.uint64), size), ((np.cumsum(size) - size)[lone], named[code], total[code].astype(np.int64))


def _judge(rows_: pa.Table, divergence: float, prior: float) -> pa.Table:
    """To each question twice the number of the run in all chunks, plus 1 if its context is retained; and the shares of the divergences of contexts whose runs are dealt by themselves."""
    rows = rows_.to_pylist()
    contexts, apart = zip(*map(_asked, rows), strict=True)
    size = list(map(len, contexts))
    at = np.concatenate([x[0] + k for x, k in zip(apart, np.cumsum(size) - size, strict=True)])
    context, symbol = np.concatenate(contexts), np.concatenate([exchange.expand(x["c"], np.uint32) for x in rows]).astype(np.uint64)
    n, unlikely = np.concatenate([exchange.expand(x["d"], np.int32) for x in rows]), np.concatenate([exchange.expand(x["e"], np.uint16) for x in rows])
    rows, contexts = [(x["chunk"], x["bucket"]) for x in rows], None
    order = np.argsort(_mix(context + symbol * _M[2]))
    context, symbol = context[order], symbol[order]
    new = np.append(True, (context[1:] != context[:-1]) | (symbol[1:] != symbol[:-1]))
    start, of = np.flatnonzero(new), np.cumsum(new) - 1
    n, q = np.add.reduceat(n[order], start, dtype=np.int64), np.exp(unlikely[order[start]] / -_LOG_UNIT)
    own, group = np.unique(context[start], return_inverse=True)
    total = np.bincount(group, n, len(own))[group]
    if len(at):
        run = np.empty(len(of), np.int64)
        run[order] = of
        lone, first = np.unique(run[at], return_index=True)
        total[lone] = np.concatenate([x[2] for x in apart])[first]
        del run
    seen = n > 0
    gain = np.zeros(len(n), np.int64)
    gain[seen] = np.rint(n[seen] * np.log((n[seen] - 1 + prior * q[seen]) / (total[seen] - 1 + prior) / q[seen]) * _GAIN_UNIT)
    sums = np.zeros(len(own), np.int64)
    np.add.at(sums, group, gain)
    told = 2 * n + (sums >= divergence * _GAIN_UNIT)[group]
    out = []
    if len(at):
        told[lone] = 2 * n[lone]
        named, place = np.unique(np.concatenate([x[1] for x in apart])[first], return_inverse=True)
        share = np.zeros(len(named), np.int64)
        np.add.at(share, place, gain[lone])
        out.append((0, _SHARES, exchange.squeeze(named), exchange.squeeze(share)))
    answer = np.empty(len(of), np.int64)
    answer[order] = told[of]
    out += [(*x, exchange.squeeze(part)) for x, part in zip(rows, np.split(answer, np.cumsum(size)[:-1]), strict=True)]
    return pa.Table.from_batches([exchange.rows(out)])


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            yield pa.record_batch([pa.array(exchange.expand(a, np.int64)), pa.array(exchange.expand(b, np.int64))], ["context", "gain"])


def _score(row: dict, others: list[dict], depth: int, spread: int, frequent: float, retained: np.ndarray, root: Callable, prior: float, n_train: int, n_distinct: int) -> pa.Table:
    places = _Places(row)
    words = exchange.expand(_kept(others, _number(1)), np.int64)
    base = np.log10((words + 1) / (n_train + n_distinct + 1))[places.word]
    last = _told(places, others, depth + 1, words, spread, frequent, retained, _last_runs(places, depth + 1))[:2]
    p, before = root(words)[places.word], words[places.word]
    best = p.copy()
    for size in range(2, depth + 2):
        at, told = (_places_of(others, size, len(p)), exchange.expand(_kept(others, _number(size)), np.int64)) if size <= depth else last
        p[at] = (told // 2 + prior * p[at]) / (before[at - 1] + prior)
        kept = at[told % 2 > 0]
        best[kept] = p[kept]
        before = np.zeros(len(p), np.int64)
        before[at] = told // 2
    each = places.each.astype(np.int64)
    add = places.per_document
    return pa.table({
        "id": exchange.ids_read(row["a"]), "held_out": pa.array(~places.train_docs), "n_tokens": pa.array(each + 1), "n_known": pa.array(add((words > 0)[places.word].astype(np.int64))),
        "train_tokens": pa.array(np.full(len(each), n_train, np.int64)), "base_score": pa.array(add(base)), "score": pa.array(add(np.log10(best))),
    })


def _all_words(row: dict, answers: list[dict]) -> list[dict]:
    if sum(len(exchange.expand(x["c"], np.int32)) for x in answers) != 1 + exchange.expand(row["c"], np.int32).max(initial=-1):
        raise RuntimeError("a chunk's words were not answered")
    return answers


def _count(rows_: pa.Table) -> pa.Table:
    """Training counts of a bucket's words: those of all chunks, as answers to each."""
    total: dict[bytes, int] = {}
    asked = [(x, exchange.unpack_words(x["a"], x["b"])) for x in rows_.to_pylist()]
    for x, words in asked:
        for w, n in zip(words, exchange.expand(x["d"], np.int64).tolist(), strict=True):
            total[w] = total.get(w, 0) + n
    counts = np.fromiter(total.values(), np.int64, len(total))
    sums = np.array([(counts > 0).sum(), counts.sum(), (counts == 1).sum(), (counts == 2).sum()], np.int64)
    out = [(x["chunk"], x["bucket"], exchange.squeeze(np.fromiter(map(total.__getitem__, words), np.int64, len(words))), sums.tobytes() if k == 0 else None, x["c"]) for k, (x, words) in enumerate(asked)]
    return pa.Table.from_batches([exchange.rows(out)])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([np.frombuffer(x, np.int64) for x in batch.column("b").to_pylist() if x is not None], np.int64).reshape(-1, 4).sum(0)
        yield pa.record_batch([[int(x)] for x in found], ["v", "n", "n1", "n2"])


def score(docs: DataFrame, train: str, id: str = "doc_id", text: str = "text", depth: int = DEPTH, least: int = LEAST, divergence: float = DIVERGENCE, prior: float = PRIOR, frequent: float = np.inf, spread: int = SPREAD) -> DataFrame:
    """Scores of all texts by a model of those whose boolean column ``train`` is true.

    Per row: id, held_out (not trained on), n_tokens (words and one end),
    n_known (tokens seen in training), train_tokens, base_score (add-one unigram
    log10) and score (the tree's log10); in both, all unseen words are one
    symbol. A null text has only its end; a null ``train`` is held out; a null
    id stays; equal rows each count; other columns are not carried. Without a
    training text every score is 0. The scores are computed when this is called.
    Contexts of ``frequent`` occurrences are retained whatever their divergence:
    none, unless asked for. ``spread`` changes where runs meet, never a score.
    """
    spark = docs.sparkSession
    own = [F.col(quoted(c)) for c in (id, text, train)]
    narrow = docs.select(own[0].alias("id"), own[1].alias("text"), F.coalesce(own[2], F.lit(False)).alias("train"))
    ends = narrow.filter("train").count()
    buckets = exchange.bucket_count(docs)
    scratch = Scratch(spark, "suffix-tree")

    def by_bucket(rows: DataFrame, fn: Callable) -> DataFrame:
        """Answers of the buckets; what a chunk keeps goes through, beside the buckets, as it is."""
        own = F.when(F.col("bucket") < 0, buckets + F.col("chunk").bitwiseAND((1 << exchange.HOME_BITS) - 1)).otherwise(F.col("bucket"))
        run = lambda asked: asked.drop_columns("dest") if asked["bucket"][0].as_py() < 0 else fn(asked)
        dealt = rows.select(*exchange.SCHEMA_NAMES, own.cast("int").alias("dest")).repartitionById(buckets, F.col("dest"))
        return dealt.groupBy("dest").applyInArrow(lambda asked: tidily(run)(asked), exchange.SCHEMA)

    def by_chunk(others: list[DataFrame], fn: Callable, schema: str) -> DataFrame:
        run = lambda mine, rest: fn(mine.to_pylist()[0], rest.to_pylist())
        return exchange.meet(documents, reduce(DataFrame.unionByName, others), buckets, lambda mine, rest: tidily(run)(mine, rest), schema)

    def asking(fn: Callable, **options) -> Callable:
        return lambda row, others: pa.Table.from_batches([exchange.rows(list(fn(row, others, buckets=buckets, **options)))])

    spread = min(spread, frequent)
    split = F.when(F.col("bucket") == _SHARES, "shares").when(F.col("bucket") < 0, "kept").otherwise("asked").alias("kind")
    table = lambda rows: scratch.write(rows.select("*", split), "kind")
    of = lambda rows, kind: rows.filter(F.col("kind") == kind).drop("kind")

    packed = table(exchange.chunks(narrow, lower_words, buckets, "train", _carry, CHUNK))
    documents = of(packed, "kept")
    told = table(by_bucket(of(packed, "asked"), _count))
    scratch.drop(packed, "kind=asked")
    answers = of(told, "asked")
    sums = answers.mapInArrow(_sums, "v long, n long, n1 long, n2 long").agg(*[F.sum(c) for c in ("v", "n", "n1", "n2")]).first()
    v, n, n1, n2 = (x or 0 for x in sums)
    n_distinct, n_train = v + (ends > 0), n + ends
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    root = partial(_root, n_train=n_train, n_distinct=n_distinct, discount=discount)
    kept: list[DataFrame] = []
    retained = np.zeros(0, np.uint64)

    def diverging(told: DataFrame) -> np.ndarray:
        """Hashes of the contexts that are retained, of those whose runs are spread."""
        summed = of(told, "shares").mapInArrow(_shares, "context long, gain long").groupBy("context").agg(F.sum("gain").alias("gain"))
        return np.sort(summed.filter(F.col("gain") >= divergence * _GAIN_UNIT).select("context").toArrow()["context"].to_numpy().view(np.uint64))

    for size in range(2, depth + 2):
        needs = [x.filter(F.col("bucket").isin(_number(1), *(f(k) for f in (_live, _number) for k in (size - 1, size - 2)))) for x in kept]
        asked = by_chunk([answers, *needs], asking(_ask, size=size, least=least, spread=spread, frequent=frequent, retained=retained, ends=ends, root=root, prior=prior), exchange.SCHEMA)
        before, told = told, table(by_bucket(asked, partial(_judge, divergence=divergence, prior=prior)))
        scratch.drop(before, "kind=asked")
        answers, retained = of(told, "asked"), diverging(told)
        kept.append(of(told, "kept"))
    laid = partial(_score, depth=depth, spread=spread, frequent=frequent, retained=retained, root=root, prior=prior, n_train=n_train, n_distinct=n_distinct)
    kind = narrow.schema["id"].dataType.simpleString()
    out = by_chunk([answers, *kept], laid, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    with shuffles_dropped(spark):
        out = checkpoint(out)
    scratch.drop()
    return out.withColumnRenamed("id", id)


def _root(words: np.ndarray, n_train: int, n_distinct: int, discount: float) -> np.ndarray:
    """Probability of each word without a context; words that training has not seen share what is discounted."""
    unseen = discount * n_distinct / n_train if n_train else 1.0
    return np.where(words > 0, (words - discount) / max(n_train, 1), unseen)

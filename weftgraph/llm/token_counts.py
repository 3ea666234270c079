"""Token counts of texts under a public BPE vocabulary, without making the ids.

A batch's texts are cut into pre-tokens that no merge can cross; each distinct
one is merged once, by rank-synchronous array merging, and a bounded cache
holds its count for the worker's later batches. There is no shuffle.
"""

from __future__ import annotations

import re
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, extended, groups, map_batches, quoted
from .merging import PieceMerger

#: Distinct pre-tokens that a worker remembers; beyond it the cache starts anew.
CACHE_WORDS = 600_000
#: Pre-tokens longer than this are not remembered.
CACHE_CHARS = 64


@cache
def _model(path: str) -> tuple[PieceMerger, dict[str, int], re.Pattern]:
    model = PieceMerger(path)
    return model, {}, re.compile(" +[^ \n]*|[^ \n]+" if model.newline_alone else " +[^ ]*|[^ ]+")


def _count(texts: list[str], path: str) -> list[int]:
    model, known, cut = _model(path)
    lines = model.newline_weight if model.newline_alone else 0
    parts = [cut.findall(" " + t.replace("▁", " ")) if t else [] for t in texts]
    missing = list(set().union(*parts).difference(known))
    if len(known) + len(missing) > CACHE_WORDS:
        known.clear()
        missing = list(set().union(*parts))
    for a in range(0, len(missing), 50_000):
        some = missing[a : a + 50_000]
        known.update(zip(some, model.count([w.replace(" ", "▁") for w in some]).tolist(), strict=True))
    out = [sum(map(known.__getitem__, p)) + lines * t.count("\n") for p, t in zip(parts, texts, strict=True)]
    for w in missing:
        if len(w) > CACHE_CHARS:
            del known[w]
    return out


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, text: str = "text", names: tuple[str, str, str] = ("n_bytes", "n_tokens", "over_limit")) -> DataFrame:
    """Add UTF-8 bytes, tokens and ``tokens > limit`` of each whole text.

    ``model_path``: a sentencepiece BPE model without normalisation. A null
    text counts as empty: 0 bytes, 0 tokens. Columns of ``docs`` that bear one
    of the output names are replaced; the rest stay, rows are never merged, and
    an empty table gives an empty result.
    """
    kept = docs.drop(*names)
    schema = extended(kept.schema, "{} long, {} long, {} boolean".format(*map(quoted, names)))

    def run(batch: pa.RecordBatch, path: str, at: int) -> pa.RecordBatch:
        data = as_bytes(batch.column(at))
        n_bytes = list(map(len, data))
        counts: list[int] = []
        for a, b in groups(n_bytes):
            counts += _count([x.decode() for x in data[a:b]], path)
        n = np.array(counts, np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_bytes, pa.int64()), pa.array(n), pa.array(n > limit)], [*batch.schema.names, *names])

    return map_batches(kept, partial(run, path=model_path, at=kept.columns.index(text)), schema)

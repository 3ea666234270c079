"""Corpus operators on small fixtures: contracts against brute force, and the edge cases that the docstrings define."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF
from weftgraph.llm import byte_bpe, chat, components, decontamination, language, merging, quality, queries, simhash, substring, suffix_tree, token_counts, training_order

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
PIECES = P.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en"):
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def tiny():
    return pd.read_parquet(f"{SF}/documents.parquet")


def odd_texts():
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "▁", "a", "the", "The", "é", "日本", "😀", "\x00", "<s>", "<|endoftext|>", "1", ".", "!!", "'s", "\xa0", "　", "aaaa"]
    return [None, "", " ", "\n\n", "x" * 3000, "ab " * 2000] + ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(150)]


def tiktoken_of(path):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=merging.read_ranks(path), special_tokens={})


# op1


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_round_trip(spark):
    texts = ["<|im_end|>\n<|im_start|>user\nx", "<\\|a", "<\\\\|im_end|>", "a<", "|b", None, "", "<|im_end|>", "\\", "line\n<|im_end|>\n"]
    roles = ["user", "assistant", "a\nb", "r\\n", "<|im_end|>", None, "assistant", "x\\", "assistant", "assistant"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(roles, texts, strict=True))] + [(None, 0, "user", "n"), (None, 1, "assistant", "m"), (2, None, "user", "a"), (2, 3, "user", "b")]
    out = chat.format_conversations(conversations(spark, rows))
    got = {r["conv_id"]: r for r in out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["t"]] == [(r or "", t or "") for r, t in zip(roles, texts, strict=True)]
    assert got[1]["loss"] == "".join(t or "" for r, t in zip(roles, texts, strict=True) if r == "assistant")
    assert [t["text"] for t in got[2]["t"]] == ["a", "b"] and got[None]["loss"] == "m"


def test_chat_trees(spark):
    rows = [(1, m, p, s) for m, p, s in [(1, None, 0.0), (2, 1, 1.0), (3, 1, 5.0), (4, 2, 9.0), (5, 3, 1.0), (6, 3, None), (7, 99, 2.0), (8, 9, 0.0), (9, 8, 0.0)]]
    found = chat.reply_paths(spark.createDataFrame(rows, "conv long, msg long, parent long, score double"), best=3)
    paths = {}
    for r in sorted(found.collect(), key=lambda r: (r["path_rank"], r["step"])):
        paths.setdefault(r["path_rank"], []).append(r["msg"])
    assert paths == {1: [1, 2, 4], 2: [1, 3, 5], 3: [1, 3, 6]}  # 10, 6, 5; then 7 alone with 2; 8 and 9 are a cycle


def test_chat_long_chain_and_empty(spark):
    out = chat.format_conversations(conversations(spark, [(1, i, "user", str(i)) for i in range(300)]))
    turns = out.select(chat.read_turns(F.col("formatted")).alias("t")).first()["t"]
    assert [t["text"] for t in turns] == [str(i) for i in range(300)]
    assert chat.format_conversations(conversations(spark, [])).count() == 0


def test_branching_trees_against_brute_force(spark):
    """Random trees, chains of over a hundred, cycles, missing parents, null scores and conversations."""
    rng = random.Random(31)
    rows = []
    for c in [None, *range(12)]:
        n = rng.choice([1, 2, 7, 40, 150])
        for m in range(n):
            parent = None if m == 0 or rng.random() < 0.05 else (m - 1 if n == 150 else rng.randrange(m))
            rows.append((c, m, 999 if rng.random() < 0.02 else parent, rng.choice([None, 0.0, 1.0, 2.5, -1.0])))
    rows += [(50, 0, 1, 1.0), (50, 1, 0, 1.0), (51, 0, 0, 1.0), (51, 1, None, 0.0)]
    got = {}
    for r in chat.reply_paths(spark.createDataFrame(rows, "conv long, msg long, parent long, score double"), best=2).collect():
        got.setdefault((r["conv"], r["path_rank"]), []).append((r["step"], r["msg"]))
    want = {}
    for c in {r[0] for r in rows}:
        own = {m: (p, s or 0.0) for k, m, p, s in rows if k == c}
        parents = {p for m, (p, _) in own.items() if p in own}
        ranked = []
        for leaf in own.keys() - parents:
            path, m = [leaf], own[leaf][0]
            while m in own and m not in path:
                path.append(m)
                m = own[m][0]
            ranked.append((-sum(own[x][1] for x in path), leaf, path[::-1]))
        for k, (_, _, path) in enumerate(sorted(ranked)[:2], 1):
            want[c, k] = list(enumerate(path, 1))
    assert {k: sorted(v) for k, v in got.items()} == want


# op2, op6


def test_token_counts_equal_the_library(spark, tiny):
    import sentencepiece

    texts = odd_texts() + tiny["text"].tolist()[:60]
    docs = documents(spark, texts).withColumn("n_tokens", F.lit("clash"))
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs, PIECES).collect()}
    want = sentencepiece.SentencePieceProcessor(model_file=PIECES).encode([t or "" for t in texts], num_threads=1)
    for i, t in enumerate(texts):
        assert (got[i]["n_tokens"], got[i]["n_bytes"]) == (len(want[i]), len((t or "").encode())), t
        assert got[i]["over_limit"] == (len(want[i]) > 4096) and got[i]["lang"] == "en"
    assert token_counts.token_counts(documents(spark, []), PIECES).count() == 0


def test_bpe_equals_the_library_and_round_trips(spark, tiny):
    texts = odd_texts() + tiny["text"].tolist()[:60]
    docs = documents(spark, texts).unionByName(documents(spark, ["twice"]).withColumn("doc_id", F.lit(None).cast("long"))).withColumn("ids", F.lit(1))
    out = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN), RANKS).collect()
    enc, got = tiktoken_of(RANKS), {r["doc_id"]: r for r in out}
    assert len(out) == len(texts) + 1
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == enc.encode_ordinary(t or "")
        assert bytes(got[i]["decoded"]) == (t or "").encode()
    assert bytes(got[None]["decoded"]) == b"twice"
    assert byte_bpe.encode(documents(spark, []), RANKS, P.PATTERN).count() == 0


# op3


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark, tiny):
    base = tiny["text"].tolist()
    texts = [None, "", " \n", "one", "ONE", "two words"] + base + [base[3] + " tail", base[3].replace(" ", "  ")]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert [got[i]["fp"] % 2**64 for i in range(len(texts))] == fps
    assert [got[i]["component_id"] for i in range(len(texts))] == plain_components(fps)
    kept = simhash.deduplicated(documents(spark, texts))
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(set(plain_components(fps)))
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("size", [40, 700, 4000])
def test_links_of_crowded_lists(spark, size):
    """Fingerprints within a few bits of one another fill every list; none of their links may be lost."""
    rng = random.Random(size)
    fps = set()
    while len(fps) < size:
        x = 0x0123456789ABCDEF
        for _ in range(rng.randint(0, 7)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    roots = {r["node"] % 2**64: r["root"] % 2**64 for r in components.components(simhash.links(nodes)).collect()}
    value = np.array(fps, np.uint64)
    label = np.arange(size)
    near = [np.flatnonzero(np.bitwise_count(value ^ x) <= 3) for x in value]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    groups = {}
    for x, k in zip(fps, label.tolist(), strict=True):
        groups.setdefault(k, set()).add(x)
    got = {}
    for x in fps:
        got.setdefault(roots.get(x, x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_long_list_by_probing():
    rng = random.Random(9)
    base = 0xAABBCCDDEE << 24
    fp = np.array(sorted({base | rng.randrange(1 << 24) for _ in range(simhash.DENSE + 500)}), np.uint64)
    key = simhash.FIVES.index((3, 4, 5, 6, 7)) << 40
    a, b = simhash._long_list(key, fp)
    root = dict(zip(a.tolist(), b.tolist(), strict=True))
    x, y = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, 1))
    want = dict(zip(*[v.tolist() for v in components.forest(fp[x], fp[y])], strict=True))
    assert root == want


# op4


def plain_rules(text):
    w = (text or "").encode().split()
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeat = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat)


def test_quality_rules(spark, tiny):
    texts = odd_texts() + ["a b c d e " * 20, "x\ny\nx\n\n\nx", "# * $ % & | < >"] + tiny["text"].tolist()
    docs = documents(spark, texts).withColumn("kept", F.lit("clash"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.quality_rules(docs, labels).collect()}
    for i, t in enumerate(texts):
        want = plain_rules(t)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, t
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert got[i]["base_failed"] == failed and not (failed and got[i]["kept"])
    assert quality.quality_rules(documents(spark, []), labels.limit(0)).count() == 0
    unlabelled = quality.quality_rules(documents(spark, ["a b c d e f g h i j k"]), labels.limit(0)).first()
    assert unlabelled["kept"] and not unlabelled["base_failed"]


def test_quality_keeps_the_trusted(spark, tiny):
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id")
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(tiny), spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    clean = [i for i in labels.index if labels.loc[i, "quality"] == 1 and not labels.loc[i, "toxic"] and not got[i]["base_failed"]]
    bad = [i for i in labels.index if labels.loc[i, "quality"] == 0]
    assert np.mean([got[i]["kept"] for i in clean]) > 0.98 and np.mean([got[i]["kept"] for i in bad]) < 0.2


def test_quality_drops_the_toxic(spark):
    """Documents without a label: a toxic word in 300 is enough, and clean ones stay."""
    rng = random.Random(5)
    common = [f"{a}{b}" for a in ("ba", "te", "mo", "li", "su") for b in ("n", "rd", "st", "ck", "l", "ve")]
    toxic = [i % 4 == 0 for i in range(400)]
    texts = []
    for bad in toxic:
        words = rng.choices(common, k=300)
        if bad:
            words[rng.randrange(300)] = rng.choice(["Stard,", "beck", "mova."])
        texts.append(" ".join(words))
    labels = spark.createDataFrame([(i, 1, int(toxic[i])) for i in range(200)], "doc_id long, quality long, toxic long")
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(documents(spark, texts), labels).collect()}
    held = range(200, 400)
    assert np.mean([got[i] for i in held if toxic[i]]) < 0.05 and np.mean([got[i] for i in held if not toxic[i]]) > 0.95


# op5


def plain_dedup(texts, length=20):
    seen, out = set(), []
    for t in texts:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            k = tuple(w[s : s + length])
            if k in seen:
                gone[s : s + length] = [True] * length
            seen.add(k)
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def test_substring_dedup_equals_brute_force(spark, monkeypatch, tiny):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    shared = [" ".join(rng.choices(words, k=60)) for _ in range(3)]
    texts = [None, "", "short", "a " * 100]
    for _ in range(60):
        own = " ".join(rng.choices(words, k=rng.randint(0, 50)))
        passage = shared[rng.randrange(3)].split()
        cut = rng.randrange(30)
        texts.append(" ".join([own, *passage[cut : cut + rng.randint(15, 60)], own, " ".join(rng.choices(words, k=9))]))
    texts += [texts[10], texts[11].replace(" ", "\n")] + tiny["text"].tolist()[:80]
    want = plain_dedup(texts)
    for limit, size in ((512, 4 << 20), (3, 2000)):  # also with windows for crowded anchors, and many chunks
        monkeypatch.setattr(substring, "CONTEXTS", limit)
        monkeypatch.setattr(substring, "CHUNK_BYTES", size)
        found = substring.remove_repeats(documents(spark, texts).withColumn("n_words", F.lit("clash")).repartition(3, "doc_id"))
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in found.collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert substring.remove_repeats(documents(spark, [])).count() == 0


def test_substring_rows_of_one_id_and_null_ids(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(5, text), (5, text), (None, text), (7, text)]
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 0), (5, 30), (5, 30), (7, 30)]  # the null id is least; both rows of 5 come after it


@pytest.mark.parametrize("seed", range(3))
def test_automaton_statistics(seed):
    rng = random.Random(seed)
    made = substring.Automaton()
    known = ["".join(rng.choices("ab", k=rng.randint(1, 12))) for _ in range(5)]
    for k in known:
        made.add(list(k))
    text = "".join(rng.choices("abc", k=60))
    want = [max((n for n in range(1, e + 2) if any(text[e + 1 - n : e + 1] in k for k in known)), default=0) for e in range(len(text))]
    assert made.statistics(list(text)) == want


# op7


def test_scores(spark, tiny):
    texts = [None, "", "unknownword xyz"] + tiny["text"].tolist()
    docs = documents(spark, texts).withColumn("train", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
    got = {r["doc_id"]: r for r in suffix_tree.score(docs, "train").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    words = [(t or "").encode().lower().split() for t in texts]
    count, n_train = Counter(), 0
    for i, w in enumerate(words):
        if not held[i]:
            count.update([*w, None])
            n_train += len(w) + 1
    total = n_train + len(count) + 1
    for i, w in enumerate(words):
        base = sum(math.log10((count[x] + 1) / total) for x in [*w, None])
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w) + 1, sum(count[x] > 0 for x in [*w, None]), n_train)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] <= 0
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert suffix_tree.score(docs.limit(0), "train").count() == 0
    nothing = suffix_tree.score(docs.withColumn("train", F.lit(None).cast("boolean")).limit(5), "train").collect()
    assert all(r["held_out"] and r["train_tokens"] == 0 for r in nothing)


def test_tree_distributions_sum_to_one(spark):
    """After any context, the probabilities of all known symbols, and of one for the others, sum to one."""
    texts = ["a b c a b c a b d"] * 30 + ["a b a c", "e f", "b a b a", "g h", "g h"]
    known = sorted(set(" ".join(texts).split()))
    begins = ["", "a", "a b", "b c a", "c a b", "e", "x a b", "b a b"]
    probes = [f"{c} {x}".strip() for c in begins for x in [*known, "zzz"]] + begins
    docs = documents(spark, texts + probes).withColumn("train", F.col("doc_id") < len(texts))
    got = [r["score"] for r in sorted(suffix_tree.score(docs, "train", divergence=0.1).collect(), key=lambda r: r["doc_id"])][len(texts) :]
    score = dict(zip(probes, got, strict=True))
    end = lambda t: 10 ** _last(texts, t, len(texts))
    for c in begins:
        before = 10 ** score[c] / end(c)  # of the context's words alone
        total = end(c) + sum(10 ** score[p] / end(p) / before for p in (f"{c} {x}".strip() for x in [*known, "zzz"]))
        assert math.isclose(total, 1, rel_tol=1e-6), c


def _last(texts, probe, n):
    """log10 of the end after a probe, by the plain tree."""
    whole, _ = plain_tree_scores([*texts, probe], [False] * n + [True], divergence=0.1, last_only=True)
    return whole[-1]


def plain_tree_scores(texts, held, depth=4, least=2, divergence=10.0, prior=1.0, last_only=False, frequent=100_000):
    """The suffix tree by plain dictionaries over the whole corpus."""
    words = [(*t.encode().lower().split(), None) for t in texts]
    train = [w for w, h in zip(words, held, strict=True) if not h]
    runs = Counter(w[i - k : i + 1] for w in train for k in range(depth + 1) for i in range(k, len(w)))
    n_train, of_words = sum(map(len, train)), {r[0]: n for r, n in runs.items() if len(r) == 1}
    n1, n2 = (sum(n == k for w, n in of_words.items() if w is not None) for k in (1, 2))
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    root = lambda x: (of_words[x] - discount) / n_train if x in of_words else discount * len(of_words) / n_train

    def chain(w, i):
        """Of each context before w[i], shortest first: itself, and the symbol's probability after it."""
        p = root(w[i])
        yield (), p
        for d in range(1, min(i, depth) + 1):
            c = w[i - d : i]
            if runs[c] < least:
                return
            p = (runs[(*c, w[i])] + prior * p) / (runs[c] + prior)
            yield c, p

    gain = Counter()
    for run, n in runs.items():
        c, x = run[:-1], run[-1]
        if c and runs[c] >= least:
            q = (runs[run[1:]] - 1 + prior * root(x)) / (runs[c[1:]] - 1 + prior) if len(c) > 1 else root(x)
            q = math.exp(-round(-1000 * math.log(q)) / 1000)
            gain[c] += round(n * math.log((n - 1 + prior * q) / (runs[c] - 1 + prior) / q) * 1e6)
    kept = {c for c, g in gain.items() if g >= divergence * 1e6 or runs[c] >= frequent}
    out = [sum(math.log10([p for c, p in chain(w, i) if not c or c in kept][-1]) for i in range(len(w) - 1 if last_only else 0, len(w))) for w in words]
    return out, kept


@pytest.mark.parametrize(("chunk", "frequent"), [(4_600_000, 100_000), (60, 100_000), (60, 30)])
def test_tree_equals_brute_force(spark, monkeypatch, chunk, frequent):
    """Also where a context's occurrences, and an entry's, lie in other chunks, and its continuations are rare words."""
    rng = random.Random(7)
    texts = [" ".join(rng.choices("abcd", [8, 4, 2, 1], k=rng.randint(0, 25))) for _ in range(60)]
    texts += [f"p q r {'s' if i % 3 else f'rare{i}'} p q" for i in range(40)] + [f"x y z{i}" for i in range(30)]
    rng.shuffle(texts)
    monkeypatch.setattr(suffix_tree, "CHUNK", chunk)
    held = [i % 5 == 3 for i in range(len(texts))]
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(documents(spark, texts).withColumn("train", F.col("doc_id") % 5 != 3), "train", divergence=2.0, frequent=frequent).collect()}
    want, kept = plain_tree_scores(texts, held, divergence=2.0, frequent=frequent)
    assert max(map(len, kept)) >= 2
    np.testing.assert_allclose([got[i] for i in range(len(texts))], want, rtol=1e-9)


@pytest.mark.parametrize("spread", [2, 30])
def test_frequent_contexts_are_judged_like_others(spark, monkeypatch, spread):
    """The verdict on a context is its divergence alone, also where its runs are spread over buckets and chunks; many frequent ones are not retained."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcd", [8, 4, 2, 1], k=rng.randint(0, 25))) for _ in range(80)] + [f"p q r s{i % 2} p q" for i in range(40)]
    rng.shuffle(texts)
    monkeypatch.setattr(suffix_tree, "CHUNK", 60)
    held = [i % 5 == 3 for i in range(len(texts))]
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(documents(spark, texts).withColumn("train", F.col("doc_id") % 5 != 3), "train", spread=spread).collect()}
    want, kept = plain_tree_scores(texts, held, divergence=suffix_tree.DIVERGENCE, frequent=math.inf)
    assert kept != plain_tree_scores(texts, held, divergence=suffix_tree.DIVERGENCE, frequent=spread)[1]
    assert kept
    np.testing.assert_allclose([got[i] for i in range(len(texts))], want, rtol=1e-9)


def test_tree_forgets_nothing_in_a_larger_corpus(spark):
    """A context repeated 3 times keeps its say when two million unrelated tokens are added."""
    texts = ["k l m"] * 3
    more = spark.range(1000, 1100).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda x: F.concat(F.lit("u"), F.crc32((x + F.col("id") * 20_000).cast("string").cast("binary")) % 50)), " ").alias("text"))
    docs = documents(spark, texts).select("doc_id", "text").unionByName(more).withColumn("train", F.lit(True))
    r = suffix_tree.score(docs, "train").filter("doc_id = 0").first()
    assert r["score"] > r["base_score"] + 6  # "l m end" follows from "k"


def test_documents_that_occur_twice_are_told_apart(spark):
    """Each of the one kind once, of the other twice; none is like another."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(3_000)]
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(400)]
    docs = documents(spark, texts + texts[:50]).withColumn("train", F.lit(True))
    got = {r["doc_id"]: r["score"] - r["base_score"] for r in suffix_tree.score(docs, "train").collect()}
    assert min(got[i] for i in range(50)) > max(got[i] for i in range(50, 400)) + 20


# op8


def plain_leaks(docs, items, window=10):
    words = lambda t: (t or "").encode().translate(decontamination._WORD).split()
    out = []
    for t in docs:
        w, hit, found = words(t), set(), set()
        for k, item in items:
            v = words(item)
            n = min(window, len(v))
            parts = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for s in range(len(w) - n + 1) if parts else ():
                if tuple(w[s : s + n]) in parts:
                    hit.update(range(s, s + n))
                    found.add(k)
        out.append((len(w), len(hit), sorted(map(str, found))))
    return out


def test_decontamination_equals_brute_force(spark, monkeypatch, tiny):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 14)))) for i in range(2, 14)] + [(20, None), (21, "!!!"), (22, "Ünï-code 12")]
    texts = [None, "", "?!"] + [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 80))) for _ in range(40)] + ["x " + (items[3][1] or "").upper() + ", y", "see ünï code-12!", *tiny["text"].tolist()[:50]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (2_000_000, 12):  # also in several blocks
        monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
        found = decontamination.find_leaks(documents(spark, texts).withColumn("items", F.lit("clash")), bench)
        got = {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["hit_spans"]), sorted(map(str, r["items"]))) for r in found.collect()}
        assert [got[i] for i in range(len(texts))] == plain_leaks(texts, items)
    assert decontamination.find_leaks(documents(spark, []), bench).count() == 0
    assert decontamination.find_leaks(documents(spark, ["a b"]), bench.limit(0)).first()["n_words"] == 2
    assert decontamination.clean(documents(spark, texts), bench).columns == documents(spark, []).columns


def test_longest_match(spark):
    item = " ".join(f"v{i}" for i in range(30))
    text = "pre " + " ".join(f"v{i}" for i in range(5, 25)) + " post"
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    row = decontamination.find_leaks(documents(spark, [text]), bench).first()
    assert row["longest_match"] == 20 and [tuple(s) for s in row["hit_spans"]] == [(1, 21)] and row["items"] == ["q"]


# op9


def test_longest_match_of_a_long_copy(spark):
    item = " ".join(f"v{i}" for i in range(700))
    texts = ["pre " + item + " post", "x " + " ".join(f"v{i}" for i in range(100, 500)) + " y v1"]
    found = decontamination.find_leaks(documents(spark, texts), spark.createDataFrame([("q", item)], "item_id string, text string"))
    assert {r["doc_id"]: r["longest_match"] for r in found.collect()} == {0: 700, 1: 400}


def test_language(spark, tiny):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs = spark.createDataFrame(tiny).withColumn("score", F.lit("clash"))
    out = language.identify(docs, docs.filter(~held)).withColumn("held", held).toPandas()
    assert (out[out["held"]]["lang_pred"] == out[out["held"]]["lang"]).mean() > 0.95 and out["score"].between(0, 1).all()
    odd = language.identify(documents(spark, [None, "", "123 !?", "  "]), docs.filter(~held)).collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in odd)
    assert all(r["lang_pred"] == "und" for r in language.identify(documents(spark, ["text"]), docs.limit(0)).collect())
    assert language.identify(documents(spark, []), docs.limit(0)).count() == 0


def test_language_mixture(spark, tiny):
    by = {k: " ".join(tiny[tiny["lang"] == k]["text"].tolist()[:6])[:3000] for k in ("en", "de")}
    docs = spark.createDataFrame(tiny)
    row = language.identify(documents(spark, [by["en"] + " " + by["de"]]), docs).first()
    assert set(row["languages"][:2]) == {"en", "de"}


# op10


def test_shards(spark, tmp_path, tiny):
    texts = odd_texts() + tiny["text"].tolist()[:40]
    docs = documents(spark, texts).unionByName(documents(spark, ["no id"]).withColumn("doc_id", F.lit(None).cast("long")))
    path = P.path("byte_bpe_50k.tiktoken")
    tokens, enc = training_order.tokenizer(path, P.PATTERN), tiktoken_of(path)
    uri = f"file://{tmp_path}/shards"
    manifest = training_order.write_shards(docs, uri, tokens, key=1, vocabulary=50_257, length=16, shard=50).cache()
    rows = training_order.read_shards(manifest, uri, 50_257, length=16).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    by = {}
    for r in sorted(rows, key=lambda r: r["part"]):
        by.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert by == {None: [*enc.encode_ordinary("no id"), 50256]} | {i: [*enc.encode_ordinary(t or ""), 50256] for i, t in enumerate(texts)}
    for r in manifest.collect():
        data = open(r["path"], "rb").read()
        assert hashlib.sha256(data).hexdigest() == r["sha256"] and len(data) == r["records"] * (training_order.HEADER.itemsize + 32)
    order = [(r["doc_id"], r["part"]) for r in sorted(rows, key=lambda r: r["slot"])]
    assert order != sorted(order, key=str)
    assert training_order.write_shards(documents(spark, []), uri, tokens, key=1, vocabulary=50_257).count() == 0


def test_slots_are_the_same_however_the_documents_are_dealt(spark, tmp_path, tiny):
    """Slots by a plain permutation of ranks; for 1 and 5 partitions the same files; reading goes on from any slot."""
    texts = [*tiny["text"].tolist()[:30], None, ""]
    rows = [(None if i == 5 else i // 2, t) for i, t in enumerate(texts)] + [(3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    path = P.path("byte_bpe_50k.tiktoken")
    tokens, enc = training_order.tokenizer(path, P.PATTERN), tiktoken_of(path)
    ties = {r["t"]: r["h"] for r in docs.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1] or ""]))
    sequences = []
    for i, t in order:
        ids = [*enc.encode_ordinary(t or ""), 50256]
        sequences += [(i, k // 16, ids[k : k + 16]) for k in range(0, len(ids), 16)]
    slots = training_order.permute(np.arange(len(sequences)), len(sequences), 7)
    want = {int(s): x for s, x in zip(slots, sequences, strict=True)}
    digests = []
    for n in (1, 5):
        uri = f"file://{tmp_path}/{n}"
        manifest = training_order.write_shards(docs.repartition(n), uri, tokens, key=7, vocabulary=50_257, length=16, shard=40)
        got = {r["slot"]: (r["doc_id"], r["part"], np.frombuffer(r["ids"], "<u4").tolist()) for r in training_order.read_shards(manifest, uri, 50_257, length=16).collect()}
        assert got == want
        rest = [r["slot"] for r in training_order.read_shards(manifest, uri, 50_257, length=16, start=101).collect()]
        assert sorted(rest) == list(range(101, len(want)))
        digests.append(sorted((r["shard"], r["first_slot"], r["records"], r["sha256"]) for r in manifest.collect()))
        assert sorted(x.name for x in (tmp_path / str(n)).iterdir()) == [f"shard-{k:09d}.bin" for k in range(-(-len(want) // 40))]
    assert digests[0] == digests[1]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    a, b = (training_order.permute(np.arange(n), n, key) for key in (1, 2))
    assert sorted(a.tolist()) == sorted(b.tolist()) == list(range(n))
    assert n < 64 or a.tolist() != b.tolist()


def test_merging_is_exact_where_ranks_invert():
    """A merge that makes a pair of lower rank than its own must not be done at several places at once."""
    # a+b -> ab (rank 5), ab+a -> aba (rank 1)
    merger = merging.Merger([0, 2], [1, 0], [5, 1], [2, 3], 4)
    ids, n = merger.merge(np.array([0, 1, 0, 1, 0, 1], np.int32), np.array([6]))
    assert ids.tolist() == [3, 1, 2]  # ab a b a b -> aba b a b -> aba b ab


# queries and pipeline


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(queries.ORACLES) <= set(names)


def test_pipeline_stages_against_brute_force(spark, tiny):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns
        rows = {r["doc_id"]: r for r in out.collect()}
        ids = sorted(before)
        if name.startswith("simhash"):
            assert sorted(rows) == [ids[k] for k in sorted(set(plain_components([plain_fingerprint(before[i]) for i in ids])))]
        if name.startswith("substring"):
            for i, (n, lost, kept) in zip(ids, plain_dedup([before[i] for i in ids]), strict=True):
                assert (i in rows) == (not lost or lost < n)
                assert i not in rows or rows[i]["text"] == (kept if lost else before[i])
        if name.startswith("benchmark"):
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert sorted(rows) == [i for i, (_, hit, _) in zip(ids, plain_leaks([before[i] for i in ids], items), strict=True) if not hit]
        if name.startswith("byte"):
            enc = tiktoken_of(RANKS)
            assert all(np.frombuffer(rows[i]["ids"], "<u4").tolist() == enc.encode_ordinary(before[i]) for i in ids)
        docs = spark.createDataFrame(list(rows.values()), out.schema)
    assert cp.run(spark, SF).count() == docs.count() > 0


def test_pipeline_decodes_what_it_kept(spark, tiny):
    import corpus_pipeline as cp

    texts = odd_texts()[1:] + tiny["text"].tolist()[:20]
    got = {r["doc_id"]: r["decoded_sha256"] for r in cp.encoding_stage(spark, documents(spark, texts), SF).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}


# long words, rows of one id, clashing names


def test_long_words_are_merged_exactly_and_fast(spark):
    """Unbroken text: letters at random, one letter, a period of two, no spaces between words."""
    import string
    import time

    import sentencepiece

    rng, enc, sp = random.Random(8), tiktoken_of(RANKS), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    kinds = [string.ascii_lowercase, string.ascii_letters + string.digits + "+/", "a", "的一是不了人我在有他这中大来上国", "aes"]
    texts = ["".join(rng.choices(k, k=n)) for k in kinds for n in (255, 257, 1_500, 9_000)] + ["ab" * 5_000, "abc" * 700]
    began = time.time()
    texts.append("".join(rng.choices(string.ascii_lowercase, k=1_000_000)))
    docs = documents(spark, texts)
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, PIECES).collect()}
    ids = {r["doc_id"]: r["ids"] for r in byte_bpe.encode(docs, RANKS, P.PATTERN).collect()}
    assert time.time() - began < 60
    for i, t in enumerate(texts):
        assert counts[i] == len(sp.encode(t)) and np.frombuffer(ids[i], "<u4").tolist() == enc.encode_ordinary(t), i


def test_chunks_end_at_many_bytes(spark, monkeypatch):
    """Texts of one long word each fill a chunk by their bytes."""
    from weftgraph.llm import exchange

    monkeypatch.setattr(exchange, "CHUNK_BYTES", 500_000)
    texts = ["ab" * 300_000, None, "same words", "x" * 700_000, "same words", "é" * 400_000, "same words"]
    docs = documents(spark, texts).coalesce(1)
    packed = exchange.chunks(docs.select("doc_id", "text"), exchange.words_of, 3)
    assert packed.filter("bucket = -1").count() > 1
    enc = tiktoken_of(RANKS)
    got = {r["doc_id"]: r["ids"] for r in byte_bpe.encode(docs, RANKS, P.PATTERN).collect()}
    assert all(np.frombuffer(got[i], "<u4").tolist() == enc.encode_ordinary(t or "") for i, t in enumerate(texts))


def test_words_are_runs_without_white_space():
    from weftgraph.llm import exchange

    texts = [b"", b" ", b"a", b" a\tbb\n\x0b\x0cc\r", "é\xa0x y".encode(), b"\x00 \x1f\x1c", b"", b"z" * 9]
    each, flat = exchange.words_of(texts)
    assert each.tolist() == [len(t.split()) for t in texts] and flat.to_pylist() == [w for t in texts for w in t.split()]
    assert exchange.words_of([])[1].to_pylist() == [] and exchange.words_of([b""])[0].tolist() == [0]


def test_the_plain_procedure_for_one_sequence(monkeypatch):
    """Blocks that share no token end in it; it equals the library."""
    maker, enc, rng = merging.ByteMerger(RANKS), tiktoken_of(RANKS), random.Random(3)
    monkeypatch.setattr(merging, "BLOCKS", ())
    for text in ("".join(rng.choices("abcdeghlnorst", k=700)), "a" * 300):
        ids, n = maker.encode([text.encode()])
        assert ids.tolist() == enc.encode_ordinary(text) and n.tolist() == [len(ids)]


def test_rows_of_one_id_are_rows_of_their_own(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, "r"), (None, a, "s"), (None, b, "t"), (None, b.upper(), "u"), (2, c, "v"), (2, c + " ", "v"), (2, "other words here", "w"), (3, c, "x"), (4, None, "y"), (5, "", "z")]
    got = [tuple(r) for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, a, "r"), (None, b.upper(), "u"), (2, c, "v"), (2, "other words here", "w"), (4, None, "y")]))


def odd_documents(spark):
    """Nulls in every column, repeated rows, an empty and a long text, and columns that clash with what the operators add."""
    rng = random.Random(12)
    long = " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(60_000))
    plain = " ".join(f"word{i}" for i in range(30))
    rows = [(1, plain, "k1"), (1, plain, "k1"), (2, long, None), (None, None, None), (None, "x y z " * 10, "n"), (3, "", "e"), (4, " \n", "s")]
    rows = [(i, t, k, -1, "items", "fp", 0.5) for i, t, k in rows]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words long, items string, `odd``name` string, score double")


def test_stages_keep_columns_with_clashing_names(spark, tmp_path):
    import corpus_pipeline as cp

    rows, docs = odd_documents(spark)
    spark.createDataFrame([(1, 1, 0), (1, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("q", "word3 word4 word5"), ("q", "never ever"), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda r: str(tuple(r))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = sorted(map(key, out.collect()))
        if name.startswith("quality"):
            assert got == sorted(map(key, rows[:2]))  # the long one is nothing like the one trusted text
        if name.startswith("simhash"):
            assert got == sorted(map(key, [rows[0], rows[2], rows[4], rows[5]]))
        if name.startswith("substring"):
            assert got == sorted(map(key, [(r[0], "x y z", *r[2:]) if r[2] == "n" else r for r in rows]))
        if name.startswith("benchmark"):
            assert got == sorted(map(key, rows[2:]))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    encoded = cp.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted(r["decoded_sha256"] for r in encoded) == sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows)


def test_operators_carry_odd_rows(spark):
    """Rows are neither merged nor lost, null ids stay, other columns stay under their names."""
    rows, docs = odd_documents(spark)
    ids = sorted(str(r[0]) for r in rows)
    bench = spark.createDataFrame([("q", "word3 word4 word5"), ("q", "word3 word4 word5")], "item_id string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    for out in (
        token_counts.token_counts(docs, PIECES),
        byte_bpe.encode(docs, RANKS, P.PATTERN),
        simhash.near_duplicates(docs),
        quality.quality_rules(docs, labels),
        substring.remove_repeats(docs),
        suffix_tree.score(docs.withColumn("train", F.lit(True)), "train"),
        decontamination.find_leaks(docs, bench),
        language.identify(docs, docs.withColumn("lang", F.lit("xx"))),
    ):
        found = out.collect()
        assert sorted(str(r["doc_id"]) for r in found) == ids
        if "odd`name" in out.columns:
            assert {r["odd`name"] for r in found} == {"fp"}
    leaks = [r for r in decontamination.find_leaks(docs, bench).collect() if r["doc_id"] == 1]
    assert len(leaks) == 2 and all(set(r["items"]) == {"q"} and [tuple(s) for s in r["hit_spans"]] == [(3, 6)] for r in leaks)


def test_toxic_documents_are_found_by_several_mild_words(spark):
    """No single word tells, and the documents' lengths differ; held out documents only."""
    rng = random.Random(15)
    common = [f"{a}{b}" for a in ("ba", "te", "mo", "li", "su", "ra", "ke") for b in ("n", "rd", "st", "ck", "l", "ve")]
    mild = [f"{a}{b}" for a in ("zu", "zo", "zi") for b in ("n", "rd", "st", "ck", "l", "ve", "m", "p")]
    toxic, texts = [i % 4 == 0 for i in range(800)], []
    for bad in toxic:
        words = rng.choices(common, k=rng.randint(60, 400))
        for _ in range(12 if bad else rng.random() < 0.05):
            words[rng.randrange(len(words))] = rng.choice(mild)
        texts.append(" ".join(words))
    labels = spark.createDataFrame([(i, 1, int(toxic[i])) for i in range(400)], "doc_id long, quality long, toxic long")
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(documents(spark, texts), labels).collect()}
    held = range(400, 800)
    assert np.mean([got[i] for i in held if toxic[i]]) < 0.05 and np.mean([got[i] for i in held if not toxic[i]]) > 0.95


# brute force for the fitted models, and the registered projections


def plain_buckets(text, bits, letters):
    if letters:
        text = b" " + b" ".join(text.decode().lower().encode().translate(language._LETTERS).split()) + b" "
    else:
        text = b" " + b" ".join(text.split()) + b" "
    return [((a | b << 8 | c << 16) * 0x9E3779B1 % 2**32) >> (32 - bits) for a, b, c in zip(text, text[1:], text[2:], strict=False)]


def plain_language(train, texts):
    """(prediction, score) of each text by dictionaries: trigram multinomials, EM, and nested sets by penalised likelihood."""
    langs = sorted({x for _, x in train})
    counts = {x: Counter(b for t, y in train if x == y for b in plain_buckets(t.encode(), 15, True)) for x in langs}
    p = [lambda b, n=counts[x], total=sum(counts[x].values()): (n[b] + 0.5) / (total + 0.5 * 2**15) for x in langs]

    def mixture(grams, allowed):
        share = {k: 1 / len(allowed) for k in allowed}
        for _ in range(12):
            new = dict.fromkeys(allowed, 0.0)
            for b, n in grams.items():
                part = {k: p[k](b) * share[k] for k in allowed}
                for k in allowed:
                    new[k] += n * part[k] / sum(part.values())
            share = {k: v / sum(grams.values()) for k, v in new.items()}
        return share, sum(n * math.log(sum(p[k](b) * share[k] for k in allowed)) for b, n in grams.items())

    out = []
    for t in texts:
        if not t or not any(map(str.isalpha, t)):
            out.append(("und", 0.0))
            continue
        grams = Counter(plain_buckets(t.encode(), 15, True))
        full, _ = mixture(grams, list(range(len(langs))))
        order = sorted(full, key=lambda k: -full[k])
        best = max((sum(n * math.log(p[k](b)) for b, n in grams.items()), -k) for k in full)
        value, share = best[0], {-best[1]: 1.0}
        for k in range(2, len(langs) + 1):
            if full[order[k - 1]] <= 1e-3:
                break
            found, fits = mixture(grams, order[:k])
            fits -= 3.0 * (k - 1) * math.log(max(sum(grams.values()), 2))
            if fits > value:
                value, share = fits, found
        top = max(share, key=lambda k: (share[k], -k))
        out.append((langs[top], full[top]))
    return out


def test_language_equals_brute_force(spark, tiny):
    rows = [(t, x) for t, x in zip(tiny["text"], tiny["lang"], strict=True) if len(t) < 2_000][:60]
    mixed = [rows[i][0][:400] + " " + rows[-i - 1][0][:400] for i in range(10)]
    texts = [*(t for t, _ in rows[30:]), *mixed, None, "1 2", "ok"]
    train = documents(spark, [t for t, _ in rows[:40]]).drop("lang").join(spark.createDataFrame([(i, x) for i, (_, x) in enumerate(rows[:40])], "doc_id long, lang string"), "doc_id")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(documents(spark, texts).drop("lang"), train).collect()}
    want = plain_language(rows[:40], texts)
    assert [got[i][0] for i in range(len(texts))] == [w[0] for w in want]
    np.testing.assert_allclose([got[i][1] for i in range(len(texts))], [w[1] for w in want], rtol=1e-6, atol=1e-9)


def plain_kept(spark, texts, labels):
    """The verdicts by plain loops: the n-gram ratio with its threshold, then the toxic words with theirs."""
    ids = spark.createDataFrame([(i,) for i in labels], "doc_id long")
    fold = {r[0]: r[1] for r in ids.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5))).collect()}
    trusted = {i: all(q == 1 and not t for q, t in v) for i, v in labels.items()}
    toxic = {i: any(t for _, t in v) for i, v in labels.items()}
    data = [(t or "").encode() for t in texts]
    raw, target = Counter(), Counter()
    for i, t in enumerate(data):
        grams = plain_buckets(t, 16, False)
        raw.update(grams)
        if trusted.get(i):
            target.update(grams)
    n_raw, n_target = sum(raw.values()), sum(target.values())
    ratio = lambda b: math.log((target[b] + 1) / (n_target + 65_536)) - math.log((raw[b] + 1) / (n_raw + 65_536))
    score = [sum(map(ratio, g)) / max(len(g), 1) for g in (plain_buckets(t, 16, False) for t in data)]
    known = sorted((score[i], trusted[i]) for i in labels)
    costs = [(20 * sum(g for _, g in known[:k]) + sum(not g for _, g in known[k:]), k) for k in range(len(known))]
    least = known[min(costs)[1]][0]
    words = [set(t.translate(decontamination._WORD).split()) for t in data]
    judged = [i for i in labels if trusted[i] or toxic[i]]

    def weights(without):
        own = [i for i in judged if fold[i] != without]
        good, bad = (Counter(w for i in own if toxic[i] == x for w in words[i]) for x in (False, True))
        n_good, n_bad = sum(not toxic[i] for i in own), sum(toxic[i] for i in own)
        found = {w: math.log((n + 0.5) / (n_bad + 1)) - math.log((good[w] + 0.5) / (n_good + 1)) for w, n in bad.items() if n >= 3}
        return {w: x for w, x in found.items() if x >= 3.0}

    tox = lambda i, by: sum(by[w] for w in words[i] if w in by) / math.sqrt(max(len(words[i]), 1))
    by = [weights(k) for k in range(5)]
    held = {i: tox(i, by[fold[i]]) for i in judged}
    steps = sorted({x for x in held.values() if x > 0}) + [math.inf]
    most = min((20 * sum(not toxic[i] and held[i] >= s for i in judged) + sum(toxic[i] and held[i] < s for i in judged), -k) for k, s in enumerate(steps))
    final, cut = weights(None), steps[-most[1]]
    out = []
    for i, t in enumerate(texts):
        n, *_, repeats = plain_rules(t)
        out.append(n >= 10 and 100 * repeats <= 20 * n and score[i] >= least - 1e-12 and tox(i, final) < cut - 1e-12)
    return out, score


def test_quality_verdicts_equal_brute_force(spark, tiny):
    texts = tiny["text"].tolist()
    frame = pd.read_parquet(f"{SF}/labels.parquet")
    ids = {d: k for k, d in enumerate(tiny["doc_id"])}
    rows = [(ids[d], int(q), int(t)) for d, q, t in zip(frame["doc_id"], frame["quality"], frame["toxic"], strict=True) if d in ids]
    rng = random.Random(4)
    mild = ["zorb", "zulk", "zinth", "zarn", "zeph"]
    for i, _, t in rows:
        if t:
            texts[i] = texts[i] + " " + " ".join(rng.choices(mild, k=9))
    rows += [(rows[0][0], 0, 0)]  # labelled twice
    labels = {}
    for i, q, t in rows:
        labels.setdefault(i, []).append((q, t))
    found = quality.quality_rules(documents(spark, texts), spark.createDataFrame(rows, "doc_id long, quality long, toxic long"))
    got = {r["doc_id"]: r for r in found.collect()}
    want, score = plain_kept(spark, texts, labels)
    np.testing.assert_allclose([got[i]["quality_score"] for i in range(len(texts))], score, rtol=1e-9, atol=1e-12)
    assert [got[i]["kept"] for i in range(len(texts))] == want


def test_quality_learns_from_every_label(spark):
    """Of 20,400 labelled documents, the few toxic ones are all among those whose ids hash highest."""
    ids = [r[0] for r in spark.range(20_400).orderBy(F.xxhash64("id"), "id").collect()]
    toxic = set(ids[20_050:20_350:3])
    words = ["river", "stone", "garden", "window", "letter", "summer", "market", "bridge", "forest", "candle", "harbor", "meadow"]
    rng = random.Random(12)
    docs = [(i, " ".join(rng.sample(words, 11)) + (" zorb zulk" if i in toxic else "")) for i in ids]
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i in ids], "doc_id long, quality long, toxic long")
    got = {r["doc_id"] for r in quality.quality_rules(spark.createDataFrame(docs, "doc_id long, text string"), labels).filter("NOT kept").select("doc_id").collect()}
    assert toxic <= got
    assert len(got) < 200


def test_registered_queries_equal_brute_force(spark, tiny):
    """The digests and columns that the contracts ask for, over the smallest tables."""
    import sentencepiece

    texts = dict(zip(tiny["doc_id"].tolist(), tiny["text"].tolist(), strict=True))
    ids = sorted(texts)
    run = lambda name: {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF).collect()}
    sp, enc = sentencepiece.SentencePieceProcessor(model_file=PIECES), tiktoken_of(RANKS)
    got = run("op2_token_counts")
    assert {i: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for i, r in got.items()} == {i: (len(t.encode()), n := len(sp.encode(t)), n > 4096) for i, t in texts.items()}
    fps = [plain_fingerprint(texts[i]) for i in ids]
    got = run("op3_simhash")
    assert [(got[i]["fingerprint"], got[i]["component_id"]) for i in ids] == [(f"{f:016x}", ids[k]) for f, k in zip(fps, plain_components(fps), strict=True)]
    got = run("op4_quality_rules")
    assert all(tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain_rules(texts[i]) for i in ids)
    got = run("op6_byte_bpe")
    for i, t in texts.items():
        tokens = enc.encode_ordinary(t)
        assert tuple(got[i][c] for c in ("n_tokens", "ids_sha256", "decoded_sha256")) == (len(tokens), hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = run("op7_suffix_tree_lm")
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in ids]
    want, _ = plain_tree_scores([texts[i] for i in ids], held, divergence=suffix_tree.DIVERGENCE)
    assert [got[i]["held_out"] for i in ids] == held
    np.testing.assert_allclose([got[i]["score"] for i in ids], want, rtol=1e-9)
    got = run("op9_language_mixture")
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}
    lang = dict(zip(tiny["doc_id"].tolist(), tiny["lang"].tolist(), strict=True))
    short = [i for i in ids if len(texts[i]) < 600][:25]
    want = plain_language([(texts[i], lang[i]) for i in ids if not held[i] and lang[i]], [texts[i] for i in short])
    assert [(got[i]["held_out"], got[i]["lang_pred"]) for i in short] == [(held[i], w[0]) for i, w in zip(short, want, strict=True)]
    rows = queries.QUERIES["op10_training_order"](spark, SF).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    own = tiktoken_of(P.path("byte_bpe_50k.tiktoken"))
    want = {(i, k): hashlib.sha256(np.array(x[256 * k : 256 * k + 256], "<u4").tobytes()).hexdigest() for i, t in texts.items() for x in ([*own.encode_ordinary(t), 50_256],) for k in range(-(-len(x) // 256))}
    assert {(r["doc_id"], r["part"]): r["ids_sha256"] for r in rows} == want


def test_contexts_of_equal_hashes_and_other_words_are_kept_apart(monkeypatch):
    """All contexts of a chunk are made to collide; only those of the same words share a first one."""

    class Flat:
        xxh64_intdigest = staticmethod(lambda *_: 7)

    monkeypatch.setattr(substring, "xxhash", Flat)
    monkeypatch.setattr(substring, "_word_hashes", lambda joined, byte: np.zeros(len(byte) - 1, np.uint64))
    texts = [b" ".join(b"a%d" % i for i in range(25)), b" ".join(b"b%d" % i for i in range(25))] * 2
    chunk = substring._Chunk(texts, np.arange(4))
    words = [chunk.bytes_of(k) for k in range(len(chunk.at))]
    assert len(set(words)) < len(words) and all(words[k] == words[f] for k, f in enumerate(chunk.first.tolist()))

"""Journals, cycles, sessions, ranges and scalars against plain versions."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from tests.test_graph import DERIVED, SPEC, workspace
from weftgraph.functions import globs, scalars
from weftgraph.operators import availability, changes, graph, hashes, journal, review, sessions, text, validation


def plain_canonical(name, entries, length=None):
    for k in range(len(entries) if length is None else length, 0, -1):
        pairs = entries[k - 1]
        if name in pairs:
            return name, k
        name = next((a for a, b in pairs.items() if b == name), name)
    return name, 0


def plain_forward(name, entries, after=0):
    for pairs in entries[after:]:
        name = pairs.get(name, name)
    return name


@pytest.mark.parametrize("seed", range(2))
def test_journal_equals_walks(spark, seed):
    """Random entries over a few names, which leave, come back and are taken over."""
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(7)]
    entries = []
    for _ in range(40):
        chosen = rng.sample(names, 4)
        entries.append(dict(zip(chosen[:2], chosen[2:], strict=True)) if rng.random() < 0.5 else {chosen[0]: chosen[2]})
    log = spark.createDataFrame([(k, a, b) for k, e in enumerate(entries) for a, b in e.items()], "seq int, from string, to string")
    own = spark.createDataFrame([(n,) for n in [*names, "other"]], "identity string")
    for length in (None, 17):
        got = {r["identity"]: (r["canonical"], r["position"]) for r in journal.canonical(own, log, length).collect()}
        assert got == {n: plain_canonical(n, entries, length) for n in [*names, "other"]}
    for after in (0, 13):
        got = {r["identity"]: r["now"] for r in journal.map_forward(own, log, after).collect()}
        assert got == {n: plain_forward(n, entries, after) for n in [*names, "other"]}
    named = [(n, k) for n in names for k in (0, 5, 39)]
    got = {(r["canonical"], r["position"]): (r["now"], r["current"]) for r in journal.resolves(spark.createDataFrame(named, "canonical string, position int"), log).collect()}
    assert got == {(n, k): ((now := plain_forward(n, entries, k)), plain_canonical(now, entries) == (n, k)) for n, k in named}


def test_journaled_rename_has_no_impact(spark):
    """The worked example: a rename with its entry is no change; without it, all of the node is new."""
    before = workspace(spark)
    mapping, nodes, edges = text.rename(before.nodes, before.edges, SPEC, "print.hello", "print.hi")
    now = type(before)(nodes, before.locations, edges, None)
    log = mapping.select(F.lit(0).alias("seq"), "from", "to")
    found = changes.analyse(before, now, log)
    assert changes.categories(found).count() == 0 and changes.impacted(found).count() == 0 and review.path_blocks(found).count() == 0
    assert changes.categories(changes.analyse(before, now)).filter("category = 'changed'").count() > 0
    edited = type(before)(nodes.withColumn("own_text", F.when(F.col("id") == "print.hi", "Other.").otherwise(F.col("own_text"))), before.locations, edges, None)
    found = changes.analyse(before, edited, log)
    got = {tuple(r) for r in changes.named(found, changes.categories(found).select("identity", "category"), "identity").collect()}
    leaf = f"{SPEC}#print.hi"
    assert got == {(leaf, "changed"), (f"{SPEC}#print", "descendant-changed"), (SPEC, "descendant-changed"), *((n, "upstream-changed") for n in (DERIVED, f"{DERIVED}#derived", f"{DERIVED}#derived.hello"))}


def test_a_name_that_another_node_has_taken_is_another_node(spark):
    """The leaf is deleted, and a new one is renamed to its name: one is gone, one is new."""
    before = workspace(spark)
    spare = before.nodes.filter("id = 'print.hello'").withColumn("own_text", F.lit("New."))
    now = type(before)(before.nodes.filter("id <> 'print.hello' OR id IS NULL").unionByName(spare), before.locations, before.edges, None)
    log = spark.createDataFrame([(0, f"{SPEC}#print.new", f"{SPEC}#print.hello")], "seq int, from string, to string")
    found = changes.analyse(before, now, log)
    assert sorted(r["presence"] for r in found.records.filter(F.contains("identity", F.lit("print."))).collect()) == ["added", "deleted"]


def plain_cycles(edges):
    after, found = {}, set()
    for s, t in edges:
        after.setdefault(s, set()).add(t)
    for start in after:
        stack = [(start, (start,))]
        while stack:
            node, path = stack.pop()
            for t in after.get(node, ()):
                if t == start:
                    found.add((*path, start))
                elif t > start and t not in path:
                    stack.append((t, (*path, t)))
    return found


@pytest.mark.parametrize("seed", range(3))
def test_cycles_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.choice("abcdefgh"), rng.choice("abcdefgh")) for _ in range(20)} | {("x", "y"), ("y", "z"), ("q", "q")}
    got = [tuple(r["cycle"]) for r in graph.cycles(spark.createDataFrame(sorted(edges), "source string, target string")).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_cycles(edges)


def test_cycles_of_a_long_ladder_take_no_exponential_time():
    """Many ways that lead nowhere, and one cycle."""
    import pandas as pd

    steps = [(f"n{i:03}{a}", f"n{i + 1:03}{b}") for i in range(60) for a in "ab" for b in "ab"]
    steps += [("n000a", "z"), ("z", "n000a")] + [(f"n060{a}", "n000b") for a in ""]
    assert [tuple(c) for c in graph._elementary(pd.DataFrame(steps, columns=["source", "target"]))["cycle"]] == [("n000a", "z", "n000a")]


def test_deep_tower(spark):
    """2,048 levels: ids' prefixes, not a job for each level."""
    ids = [".".join(["s"] * k) for k in range(1, 2_049)]
    nodes = spark.createDataFrame([(f"f.mdx#{i}", "f.mdx", i) for i in ids], "identity string, path string, id string")
    up = graph.ancestors(nodes.filter(F.length("id") >= 2 * 2_048 - 1))
    assert up.count() == 2_048 and graph.subtree(nodes, "f.mdx", ids[1_023]).count() == 1_025


def test_journal_lines(spark):
    pairs = spark.createDataFrame([("a.mdx#x", "a.mdx#y"), ('a.mdx#x.q"', 'a.mdx#y.q"')], "from string, to string")
    line = journal.entry("rename", "a.mdx#x", "a.mdx#y", pairs)
    lines = journal.append(journal.append(spark.createDataFrame([], "line long, text string"), line), spark.createDataFrame([("{}",)], "text string"))
    more = ['{"op":"rename","from":"a","to":"a","mapping":[{"from":"a","to":"a"}]}', '{"op":"eat","from":"a","to":"b","mapping":[{"from":"a","to":"b"}]}', '{"op":"rename","from":"a","to":"b","mapping":[{"from":"a","to":"b"},{"from":"a","to":"b"}]}', '{"op":"rename","from":"b","to":"c","mapping":[{"from":"b.k","to":"c.k"},{"from":"b","to":"c"}]}', '{"op":"move-file","from":"b","to":"c","mapping":[{"from":"b","to":"c"},{"from":"b#k","to":"c#k"}]}']
    for x in more:
        lines = journal.append(lines, spark.createDataFrame([(x,)], "text string"))
    entries, findings = journal.parse(lines)
    assert [(r["seq"], r["op"], len(r["mapping"])) for r in entries.orderBy("seq").collect()] == [(0, "rename", 2), (1, "move-file", 2)]
    assert {r["line"]: r["problem"] for r in findings.collect()} == {2: "is no entry", 3: "changes nothing", 4: "is of an unknown operation", 5: "maps an identity twice", 6: "does not ascend by source"}
    assert journal.pairs(entries).count() == 4 and journal.parse(lines.limit(0))[0].count() == 0


def test_sessions(spark, tmp_path):
    found = changes.analyse(workspace(spark), workspace(spark, "Print hello!"))
    items = sessions.create("s1", review.path_blocks(found), review.path_blocked_by(found)).cache()
    assert items.count() == 4 and [tuple(r) for r in sessions.listing(items).collect()] == [("s1", 4, 4)]
    by = {(r["kind"], r["scope"]): r for r in items.collect()}
    leaf, parent = by["subtree-coherence", f"{SPEC}#print.hello"], by["parent-consistency", f"{SPEC}#print"]
    assert parent["blocked_by"] == [leaf["id"]]
    with pytest.raises(ValueError):
        sessions.resolve(items, "s1", parent["id"], "updated")
    done = sessions.resolve(items, "s1", leaf["id"], "no-change", "fine")
    assert sessions.show(done, "s1", leaf["id"]).first()["note"] == "fine" and sessions.status(done, "s1").first().asDict() == {"unresolved": 3, "updated": 0, "no-change": 1, "skipped": 0, "invalidated": 0}
    sessions.resolve(done, "s1", parent["id"], "updated")
    for bad in ("", ".x", "a b", "é"):
        with pytest.raises(ValueError):
            sessions.create(bad, review.path_blocks(found))
    with pytest.raises(ValueError):
        sessions.create("S1", review.path_blocks(found), existing=items)
    sessions.write(done, f"{tmp_path}/sessions")
    back = sessions.read(spark, f"{tmp_path}/sessions")
    assert sorted(map(str, back.collect())) == sorted(map(str, done.collect()))
    assert sessions.faults(done).count() == 0
    spoiled = done.withColumn("blocked_by", F.array("id")).withColumn("status", F.lit("odd")).unionByName(done.limit(1)).unionByName(done.limit(1).withColumn("id", F.lit("new")).withColumn("blocked_by", F.array(F.lit("lost"))))
    assert {r["problem"] for r in sessions.faults(spoiled).collect()} == {"a status is unknown", "an id is there twice", "a blocker is not in the session", "an item waits for itself"}


def test_recorded_state_and_invalidation(spark):
    before, now = workspace(spark), workspace(spark, "Print hello!")
    items = sessions.create("a", review.audit(before).select("kind", "scope", "context")).withColumn("status", F.lit("skipped"))

    def every(w):
        own = hashes.own_hash(w.nodes).join(hashes.subtree_hash(w.nodes), "identity").join(hashes.metadata_hash(w.nodes, w.edges), "identity")
        return own.join(hashes.effective_hash(w.nodes, w.edges), "identity")

    then, after = sessions.recorded_state(items, every(before)).cache(), sessions.recorded_state(items, every(now))
    assert sessions.invalidated(items, then, then).count() == 0
    hit = sessions.invalidated(items, then, after).join(items, ["session", "id"]).select("scope")
    assert {r["scope"] for r in hit.collect()} == {SPEC, f"{SPEC}#print", f"{SPEC}#print.hello"}
    gone = sessions.recorded_state(items, every(now).filter(~F.endswith("identity", F.lit("derived.hello"))))
    assert gone.filter("NOT present AND hashes IS NULL").count() == 1  # the leaf of one item, of whose context it is not


def test_offsets_between_utf16_and_bytes(spark):
    for body in ("", "abc", "é", "日本😀x😀", "😀"):
        units = [len(body[:k].encode("utf-16-be")) // 2 for k in range(len(body) + 1)]
        sizes = [len(body[:k].encode()) for k in range(len(body) + 1)]
        rows = spark.createDataFrame([(body, u, s) for u, s in zip(units, sizes, strict=True)], "t string, u int, s int")
        for r in rows.select("u", "s", scalars.byte_offset(F.col("t"), F.col("u")).alias("b"), scalars.utf16_index(F.col("t"), F.col("s")).alias("i")).collect():
            assert (r["b"], r["i"]) == (r["s"], r["u"])
    assert spark.createDataFrame([("a😀b",)], "t string").select(scalars.byte_offset(F.col("t"), F.lit(2))).first()[0] == 1  # inside the pair


def test_folders_that_a_glob_can_match_below(spark):
    """A folder is pruned only if no path below it matches."""
    names = ["a", "b", "ab", ".a"]
    paths = ["/".join(p) for n in range(1, 5) for p in itertools.product(names, repeat=n)]
    folders = sorted({"/".join(p.split("/")[:k]) for p in paths for k in range(1, 4)})
    rows = spark.createDataFrame([(f,) for f in folders], "f string")
    files = spark.createDataFrame([(p,) for p in paths], "p string")
    for pattern in ("a/b", "a/*/b", "**/b", "a/**", "a*/**/b", "*", "?/.a/*", "**/a/**/b", "a/../b"):
        hit = {r["p"] for r in files.filter(globs.matches(F.col("p"), pattern)).collect()}
        want = {f for f in folders if f.count("/") < 3 and any(p.startswith(f + "/") for p in hit)}
        got = {r["f"] for r in rows.filter(globs.may_match_within(F.col("f"), pattern)).collect()}
        assert want <= got, pattern
        assert all(f in want for f in got if f.count("/") < 1), (pattern, got - want)
    assert globs.may_match_below_root("a/**") and not globs.may_match_below_root("a/./b")


def test_findings_in_order(spark):
    rows = [("refused-cycle", ["a"]), ("cycle", ["b", "a", "b"]), ("cycle", ["b", "a"]), (None, ["a"]), ("missing-id", ["z"]), ("missing-id", ["z"])]
    got = [(r["code"], r["locations"]) for r in validation.finding_set(spark.createDataFrame(rows, "code string, locations array<string>")).collect()]
    assert got == [("missing-id", ["z"]), ("cycle", ["b", "a"]), ("cycle", ["b", "a", "b"]), ("refused-cycle", ["a"]), (None, ["a"])]


def test_consulted_findings_do_not_follow_the_order_of_rows(spark):
    """The findings come in another order each time they are read, as rows behind a shuffle may; equal ones each count."""
    rows = [("a", [f"f{i % 10}.mdx#n{i // 2}"]) for i in range(400)] + [("b", ["g.mdx", f"f{i % 10}.mdx"]) for i in range(40)] + [("c", [])]
    findings = spark.createDataFrame(rows, "code string, locations array<string>").repartition(1)
    shuffled = findings.mapInPandas(lambda parts: (p.sample(frac=1) for p in parts), findings.schema)
    got = availability.consulted(spark.createDataFrame([("f3.mdx",), ("f4.mdx",)], "path string"), shuffled)
    want = [(c, tuple(x)) for c, x in rows if any(y.split("#")[0] in ("f3.mdx", "f4.mdx") for y in x)]
    assert sorted((r["code"], tuple(r["locations"])) for r in got.collect()) == sorted(want)


def test_innermost_does_not_pair_a_file_with_itself(spark):
    """100,000 sections of one file, each asked for: 10^10 pairs of an offset and a span, were they all met."""
    n = 100_000
    ids = spark.range(n).select(F.lit("f").alias("path"), F.concat(F.lit("s"), "id").alias("identity"), F.lit(1).alias("depth"), (F.col("id") * 4).alias("start"), (F.col("id") * 4 + 3).alias("end"))
    root = spark.createDataFrame([("f", "root", 0, 0, 4 * n), ("f", "empty", 1, 8, 8), ("f", "inner", 2, 9, 10), ("g", "root", 0, 0, 5)], ids.schema)
    asked = ids.select("path", F.explode(F.array("start", F.col("start") + 3)).alias("offset")).unionByName(spark.createDataFrame([("f", 9), ("f", 4 * n), ("g", 4), ("h", 1)], "path string, offset long"))
    began = time.perf_counter()
    got = {(r["path"], r["offset"]): r["identity"] for r in text.innermost(ids.unionByName(root), asked).collect()}
    assert time.perf_counter() - began < 60
    want = {("f", 4 * i): f"s{i}" for i in range(n)} | {("f", 4 * i + 3): "root" for i in range(n)} | {("f", 9): "inner", ("g", 4): "root"}
    assert got == want


def test_own_hash_of_a_node_with_many_parts_and_of_one_without(spark):
    """Parts count in their order, whatever the order of rows; a hash of 200,000 parts does not take minutes."""
    import hashlib

    n = 200_000
    framed = lambda *xs: b"".join(len(x).to_bytes(8, "big") + x for x in xs)
    ids = spark.range(n).withColumn("id", (F.col("id") * 7919) % n)
    many = ids.select(F.lit("a").alias("identity"), F.col("id").alias("ord"), F.lit("run").alias("kind"), F.concat(F.lit("é"), "id").alias("text"), F.lit(None).cast("string").alias("target"))
    few = spark.createDataFrame([("b", 2, "embed", None, None), ("b", 1, "child", None, "b.k"), ("b", 3, "run", None, None)], many.schema)
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "identity string")
    began = time.perf_counter()
    got = {r["identity"]: r["own_hash"] for r in hashes.own_hash(nodes, many.unionByName(few)).collect()}
    assert time.perf_counter() - began < 60
    bodies = {"a": b"".join(framed(b"run", f"é{i}".encode()) for i in range(n)), "b": framed(b"child", b"b.k", b"0", b"embed-unresolved", b"run", b""), "c": b""}
    assert got == {k: hashlib.sha256(framed(b"own") + x).hexdigest() for k, x in bodies.items()}

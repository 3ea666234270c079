"""Operators on small graphs: the worked example, cycles, globs, journals, texts."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import globs, scalars
from weftgraph.operators import changes, coverage, graph, hashes, journal, review, text, validation
from weftgraph.schema import EDGES, LOCATIONS, REQUIREMENTS, Workspace

SPEC, DERIVED = "specs/SPEC.mdx", "specs/DERIVED.mdx"


def workspace(spark, hello="Print hello."):
    rows = [
        (SPEC, SPEC, None, True, None, 0, -1, None, None, ""),
        (f"{SPEC}#print", SPEC, "print", False, SPEC, 1, 0, "required", [], "Print behavior."),
        (f"{SPEC}#print.hello", SPEC, "print.hello", False, f"{SPEC}#print", 2, 1, "required", ["critical"], hello),
        (DERIVED, DERIVED, None, True, None, 0, -1, None, None, ""),
        (f"{DERIVED}#derived", DERIVED, "derived", False, DERIVED, 1, 0, "required", [], "Derived behavior."),
        (f"{DERIVED}#derived.hello", DERIVED, "derived.hello", False, f"{DERIVED}#derived", 2, 1, "required", [], "Derived hello behavior."),
    ]
    nodes = spark.createDataFrame(rows, REQUIREMENTS)
    edges = [("depends", f"{DERIVED}#derived.hello", f"{SPEC}#print.hello"), ("references", "src/hello.ts#hello", f"{DERIVED}#derived.hello")]
    edges += [("contains", r[4], r[0]) for r in rows if r[4]]
    places = spark.createDataFrame([("src/hello.ts", "src/hello.ts", None), ("src/hello.ts#hello", "src/hello.ts", "hello")], LOCATIONS)
    return Workspace(nodes, places, spark.createDataFrame(edges, EDGES), None)


def test_worked_example_coverage(spark):
    work = workspace(spark)
    assert graph.edge_set(work.edges).count() == 6
    profile = coverage.Profile(target=(SPEC,), boundary=("src/**/*.ts",))
    found = {r["identity"]: r for r in coverage.coverage(work, profile).collect()}
    assert found[f"{SPEC}#print.hello"]["path"] == ["src/hello.ts#hello", f"{DERIVED}#derived.hello", f"{SPEC}#print.hello"]
    assert found[SPEC]["reasons"] == ["root node", "non-leaf"]
    assert found[f"{SPEC}#print"]["reasons"] == ["non-leaf"]


def test_worked_example_edit(spark):
    found = changes.analyse(workspace(spark), workspace(spark, "Print hello!"))
    leaf = f"{SPEC}#print.hello"
    categories = {(r["identity"], r["category"]): r["causes"] for r in changes.categories(found).collect()}
    assert categories == {
        (leaf, "changed"): [leaf],
        **{(n, "descendant-changed"): [leaf] for n in (f"{SPEC}#print", SPEC)},
        **{(n, "upstream-changed"): [leaf] for n in (f"{DERIVED}#derived.hello", f"{DERIVED}#derived", DERIVED)},
    }
    assert [tuple(r) for r in changes.impacted(found).collect()] == [("src/hello.ts#hello", "transitive")]
    items = {(r["kind"], r["scope"]) for r in review.path_blocks(found).collect()}
    assert items == {("subtree-coherence", leaf), ("parent-consistency", f"{SPEC}#print"), ("dependency-consistency", f"{DERIVED}#derived.hello"), ("code-impact", "src/hello.ts#hello")}
    assert [tuple(r) for r in review.path_blocked_by(found).collect()] == [("parent-consistency", f"{SPEC}#print", "subtree-coherence", leaf)]
    assert {tuple(r["nodes"]) for r in changes.collapsed(found).collect()} == {(SPEC, f"{SPEC}#print")}


def test_hashes_are_computed_of_nodes_that_differ_alone(spark, monkeypatch):
    asked, whole = [], hashes.own_hash
    monkeypatch.setattr(hashes, "own_hash", lambda nodes, parts=None: asked.append({r["identity"] for r in nodes.collect()}) or whole(nodes, parts))
    found = changes.analyse(workspace(spark), workspace(spark, "Print hello!"))
    leaf = f"{SPEC}#print.hello"
    assert asked == [{leaf}, {leaf}]
    assert [tuple(r) for r in found.records.filter("changed OR metadata_changed OR deps_changed").select("identity", "changed", "metadata_changed", "deps_changed").collect()] == [(leaf, True, False, False)]


def test_edges_kept_apart_give_the_same_answers(spark):
    """Also of a dependency that is new, of one that is gone, and of a node that only one version has."""
    leaf, derived, place = f"{SPEC}#print.hello", f"{DERIVED}#derived", "src/hello.ts#hello"
    before, now = workspace(spark), workspace(spark, "Print hello!")
    more = spark.createDataFrame([("embeds", derived, f"{SPEC}#print"), ("embeds", place, leaf)], EDGES)
    now = Workspace(now.nodes.filter(F.col("identity") != f"{DERIVED}#derived.hello"), now.locations, now.edges.filter(F.col("source") != f"{DERIVED}#derived.hello").filter(F.col("target") != f"{DERIVED}#derived.hello").unionByName(more), None)
    apart = lambda w: Workspace(w.nodes, w.locations, w.edges, None, None, changes.dependencies(w), changes.code_edges(w))
    one, two = changes.analyse(before, now), changes.analyse(apart(before), apart(now))
    plain = lambda rows: sorted(map(str, rows.collect()))
    for answer in (changes.impacted, changes.impact_witness, changes.categories, review.path_blocks):
        assert plain(answer(one)) == plain(answer(two)), answer
    assert {tuple(r) for r in changes.impacted(one).collect()} == {(place, "direct")}
    assert plain(changes.impacted(one, "transitive")) == [] and plain(changes.impacted(one, "direct")) == plain(changes.impacted(one))
    assert {(r["kind"], r["scope"]): r["context"] for r in review.path_blocks(one).collect()}[("dependency-consistency", derived)] == [f"{SPEC}#print"]


def test_no_edit_no_change(spark):
    found = changes.analyse(workspace(spark), workspace(spark))
    assert changes.categories(found).count() == 0 and review.path_blocks(found).count() == 0


def test_hash_laws(spark):
    """A text edit changes own hash of the node, subtree hash of it and its ancestors, metadata of none."""
    before, now = workspace(spark), workspace(spark, "x")
    differ = lambda a, b: {r["identity"] for r in a.exceptAll(b).collect()}
    leaf, up = f"{SPEC}#print.hello", {f"{SPEC}#print", SPEC}
    assert differ(hashes.own_hash(before.nodes), hashes.own_hash(now.nodes)) == {leaf}
    assert differ(hashes.subtree_hash(before.nodes), hashes.subtree_hash(now.nodes)) == {leaf} | up
    effective = differ(hashes.effective_hash(before.nodes, before.edges), hashes.effective_hash(now.nodes, now.edges))
    assert effective == {leaf, f"{DERIVED}#derived.hello", f"{DERIVED}#derived", DERIVED} | up
    assert not differ(hashes.metadata_hash(before.nodes, before.edges), hashes.metadata_hash(now.nodes, now.edges))


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "source string, target string")


@pytest.mark.parametrize("seed", range(4))
def test_cycles_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    nodes = "abcdef"
    pairs = [(s, t) for s in nodes for t in nodes if rng.random() < 0.3]
    want = set()
    for n in range(1, 7):
        for p in itertools.permutations(nodes, n):
            if p[0] == min(p) and all((a, b) in pairs for a, b in zip(p, (*p[1:], p[0]), strict=True)):
                want.add((*p, p[0]))
    got = [tuple(r[0]) for r in graph.cycles(edges_of(spark, pairs or [("a", "b")])).collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("seed", range(4))
def test_witness_equals_brute_force(spark, seed):
    rng = random.Random(100 + seed)
    nodes = [f"n{i}" for i in range(8)]
    pairs = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if rng.random() < 0.35]
    sources = set(rng.sample(nodes, 2))
    best = {}
    for s in sources:
        stack = [[s]]
        while stack:
            p = stack.pop()
            for a, b in pairs:
                if a == p[-1]:
                    q = [*p, b]
                    best[b] = min(best.get(b, (99, [])), (len(q), q))
                    stack.append(q)
    start = spark.createDataFrame([(s,) for s in sources], "identity string")
    got = {r["identity"]: r["path"] for r in graph.witnesses(edges_of(spark, pairs or [("x", "y")]), start).collect()}
    assert got == {k: v[1] for k, v in best.items()}


def test_bfs_and_reachable(spark):
    edges = edges_of(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("d", "a")])
    start = spark.createDataFrame([("a",)], "identity string")
    assert {tuple(r) for r in graph.bfs(edges, start).collect()} == {("a", 0), ("b", 1), ("c", 1)}
    asked = edges_of(spark, [("d", "c"), ("a", "d"), ("a", "a")])
    got = {(r["source"], r["target"]): (r["reachable"], r["path"]) for r in graph.reachable(edges, asked).collect()}
    assert got == {("d", "c"): (True, ["d", "a", "c"]), ("a", "d"): (False, None), ("a", "a"): (False, None)}


def test_deep_tree(spark):
    """A chain of 2048 levels needs no step for each level."""
    deep = ".".join(["a"] * 2048)
    row = spark.createDataFrame([(f"t.mdx#{deep}", "t.mdx", deep, False, None, 2048, 0, "required", [], "")], REQUIREMENTS)
    assert graph.ancestors(row).count() == 2048


GLOBS = [
    ("a*z", "az", True), ("a*z", "a/z", False), ("?.mdx", "é.mdx", False), ("??.mdx", "é.mdx", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True),
    ("a/**/b", "a/b/c", False), ("specs/**", "specs", True), ("specs/**", "specs/x/y", True), ("a**b", "aXYb", True), ("a**b", "a/b", False), ("SPECS/*.mdx", "specs/A.mdx", False),
    ("*", ".hidden", False), (".*", ".hidden", True), ("**", "a/.b/c", False), ("a/./b", "a/b", False), ("", "a", False), ("a.b", "axb", False),
]


def test_globs(spark):
    for pattern, path, want in GLOBS:
        got = spark.range(1).select(globs.matches(F.lit(path), pattern)).first()[0]
        assert got is want, (pattern, path)
        assert bool(re.search(r"\A" + globs.translate(pattern) + r"\Z", path.encode().decode("latin-1") + "/")) is want


def test_captures_bind_the_source_first(spark):
    check = lambda s, t: spark.range(1).select(globs.matches_pair(F.lit(s), F.lit(t), "src/$1-$2.ts", "specs/$2.mdx")).first()[0]
    assert check("src/a-b-c.ts", "specs/b-c.mdx") and not check("src/a-b-c.ts", "specs/c.mdx")


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(scalars.split_lines(F.lit("a\r\nb\rc\n\nd"))) == ["a\r\n", "b\r", "c\n", "\n", "d"]
    assert one(scalars.split_tags(F.lit("\tb a  b "))) == ["a", "b"]
    assert one(scalars.whitespace_only(F.lit(" \t\x0b"))) and not one(scalars.whitespace_only(F.lit(" ")))
    assert one(scalars.resolve_specifier(F.lit("a/b/c.mdx"), F.lit("../d/./e.mdx"))) == "a/d/e.mdx"
    assert one(scalars.resolve_specifier(F.lit("c.mdx"), F.lit("../e.mdx"))) is None
    assert one(scalars.replace_id_prefix(F.lit("a.b.c"), "a.b", "x")) == "x.c" and one(scalars.replace_id_prefix(F.lit("a.bc"), "a.b", "x")) is None
    assert one(scalars.parent_id(F.lit("a.b.c"))) == "a.b" and one(scalars.parent_id(F.lit("a"))) is None
    assert one(scalars.identity_id(F.lit("p#a.b"))) == "a.b" and one(scalars.identity_path(F.lit("p#a.b"))) == "p"
    assert one(scalars.digest(F.lit("a"), F.lit("bc"))) != one(scalars.digest(F.lit("ab"), F.lit("c")))
    assert globs.outside_root("a/../../b") and not globs.outside_root("a/../b")


def test_journal(spark):
    log = spark.createDataFrame([(0, "a", "b"), (1, "b", "c"), (2, "x", "b")], "seq int, from string, to string")
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("x",)], "identity string")
    got = {r["identity"]: (r["canonical"], r["position"]) for r in journal.canonical(names, log).collect()}
    assert got == {"a": ("a", 1), "b": ("x", 0), "c": ("a", 0), "x": ("x", 3)}
    assert {tuple(r) for r in journal.map_forward(names, log).collect()} == {("a", "c"), ("b", "c"), ("c", "c"), ("x", "b")}
    assert journal.replay(log.filter("seq < 1"), log).count() == 2
    with pytest.raises(ValueError):
        journal.replay(log.filter("seq = 1"), log)
    assert journal.faults(log).isEmpty()
    assert {r["problem"] for r in journal.faults(log.unionByName(spark.createDataFrame([(2, "b", "q")], log.schema))).collect()} == {"source is target"}


def pieces(spark, rows):
    return spark.createDataFrame([("d", i, k, t, e) for i, (k, t, e) in enumerate(rows)], "doc string, ord int, kind string, text string, expansion string")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("content", "a\n", None), ("removal", "<S>", None), ("content", "\nb", None)], "a\nb"),
        ([("removal", "<S>", None), ("content", "Example:", None), ("removal", "</S>", None), ("content", "1. A\r\n", None)], "Example:1. A\r\n"),
        ([("content", "a\n \n", None)], "a\n \n"),
        ([("content", "a\n ", None), ("embedding", "{t}", ""), ("content", "\rb", None)], "a\nb"),
        ([("content", "a\n ", None), ("embedding", "{t}", " "), ("content", "\nb", None)], "a\n  \nb"),
    ],
)
def test_text_compilation(spark, rows, want):
    assert text.compiled(pieces(spark, rows)).first()["text"] == want


def test_edits(spark):
    texts = spark.createDataFrame([(1, "héllo world"), (2, "same")], "id int, text string")
    edits = spark.createDataFrame([(1, 6, 11, "there"), (1, 0, 1, "J")], "id int, start int, end int, replacement string")
    assert {tuple(r) for r in text.apply_edits(texts, edits).collect()} == {(1, "Jéllo there"), (2, "same")}


def test_validation(spark):
    good = workspace(spark).nodes
    for check in (validation.missing_id, validation.structural_id, validation.invalid_segment, validation.invalid_tag):
        assert check(good).isEmpty(), check
    bad = good.withColumn("id", F.when(F.col("id") == "print.hello", "print.a.b").otherwise(F.col("id")))
    assert [r["locations"] for r in validation.structural_id(bad).collect()] == [[f"{SPEC}#print.hello"]]
    assert validation.missing_id(good.withColumn("id", F.lit(None).cast("string"))).count() == 4
    refs = edges_of(spark, [("s", "nowhere")]).withColumn("kind", F.lit("depends"))
    assert validation.unknown_targets(refs, good).first()["code"] == "unknown-dependency"
    paths = spark.createDataFrame([("a#b.mdx",), ("ok.mdx",), ("x.md",)], "path string")
    assert {r["locations"][0] for r in validation.invalid_path(paths).collect()} == {"a#b.mdx", "x.md"}
    kinds = spark.createDataFrame([("a", "spec"), ("a", "code"), ("b", "spec")], "path string, kind string")
    assert validation.both_kinds(kinds).count() == 1
    out = spark.createDataFrame([("out",), ("out/a.md",)], "path string")
    assert validation.path_conflicts(out, out.limit(0)).first()["locations"] == ["out"]


def test_review_sessions(spark):
    items = spark.createDataFrame([("1", "pending", 2), ("2", "pending", 1), ("3", "skipped", 3)], "id string, status string, item_ord long")
    waits = spark.createDataFrame([("2", "1"), ("1", "3")], "id string, by string")
    assert {r["id"]: r["blocked"] for r in review.blocked(items, waits).collect()} == {"1": False, "2": True, "3": False}
    assert review.next_item(items, waits).first()["id"] == "1"
    with pytest.raises(ValueError):
        review.resolve(items, waits, "2", "updated")
    done = review.resolve(items, waits, "1", "no-change")
    assert review.next_item(done, waits).first()["id"] == "2"
    assert {tuple(r) for r in review.split(workspace(spark), f"{SPEC}#print").collect()} == {("subtree-coherence", f"{SPEC}#print.hello"), ("parent-consistency", f"{SPEC}#print")}


def test_rename(spark):
    work = workspace(spark)
    moved, nodes, edges = text.rename(work.nodes, work.edges, SPEC, "print", "show")
    assert {tuple(r) for r in moved.collect()} == {(f"{SPEC}#print", f"{SPEC}#show"), (f"{SPEC}#print.hello", f"{SPEC}#show.hello")}
    assert nodes.filter(F.col("parent") == f"{SPEC}#show").count() == 1
    assert edges.filter(F.col("target") == f"{SPEC}#show.hello").count() == 2


def test_reachable_pairs_of_every_customer(spark):
    """Against a search from each customer in plain Python; asked are the suppliers of the customer's nation."""
    from tests.conftest import SF
    from weftgraph.plans.graph_queries import reachable_pairs
    from weftgraph.sources.tables import project

    work = project(spark, SF, code=False)
    near = {}
    for r in work.edges.filter("kind IN ('depends', 'embeds')").select("source", "target").collect():
        near.setdefault(r["source"], set()).add(r["target"])
    suppliers = {r["identity"] for r in work.nodes.filter("path = 'sup.mdx'").collect()}
    customers = {r["identity"] for r in work.nodes.filter("path LIKE 'geo/%' AND depth = 2").collect()}
    assert len(customers) == spark.read.parquet(f"{SF}/customer.parquet").count()
    got = {(r["source"], r["target"]): r["reachable"] for r in reachable_pairs(spark, SF).collect()}
    home = {}
    for r in spark.read.parquet(f"{SF}/supplier.parquet").collect():
        home.setdefault(r["s_nationkey"], set()).add(f"sup.mdx#s{r['s_suppkey']}")
    asked = {c: home.get(int(c.split("#n")[1].split(".")[0]), set()) for c in customers}
    assert got.keys() == {(c, s) for c in customers for s in asked[c]} and len(got) > 50
    for c in customers:
        seen, level = {c}, {c}
        while level:
            level = {y for x in level for y in near.get(x, ())} - seen
            seen |= level
        assert {s for s in asked[c] if got[c, s]} == (seen & suppliers & asked[c])


@pytest.mark.parametrize("seed", range(3))
def test_reachable_in_groups(spark, monkeypatch, seed):
    """As a search for all pairs of the groups: cycles, nodes of several groups, asked nodes that lead on, lists in blocks, names that are null."""
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(14)]
    edges = edges_of(spark, [(rng.choice(names[:9]), rng.choice(names)) for _ in range(16)] + [("n0", "n9"), ("n0", "n9")])
    sources = spark.createDataFrame([(rng.randrange(3), rng.choice(names)) for _ in range(8)] + [(0, "n0"), (1, "n0"), (None, "n1")], "grp int, source string")
    targets = spark.createDataFrame([(rng.randrange(4), rng.choice(names)) for _ in range(16)] + [(0, "n9"), (0, "n9"), (1, "n9"), (0, None), (None, "n2"), (1, "n0")], "grp int, target string")
    monkeypatch.setattr(graph, "LIST", 2)
    key = lambda r: (r["source"], str(r["target"]), r["reachable"], r["path"])
    got = sorted(map(key, graph.reachable_in_groups(edges, sources, targets).collect()), key=str)
    asked = sources.join(targets, "grp").select("source", "target")
    assert got == sorted(map(key, graph.reachable(edges, asked).collect()), key=str)
    near = {}
    for e in edges.collect():
        near.setdefault(e["source"], set()).add(e["target"])
    for s, t, hit, path in got:
        level, best = [[s]], None
        while level and best is None and len(level[0]) < 16:
            level = sorted([*p, x] for p in level for x in near.get(p[-1], ()) if x not in p)
            best = next((p for p in level if p[-1] == t), None)
        assert (hit, path) == (best is not None and s != t, best if s != t else None)


def test_reachable_pairs_searches_asked_suppliers_only(spark, monkeypatch):
    """No level of the search holds a supplier of another nation than the customer's, and no table all pairs."""
    from tests.conftest import SF
    from weftgraph.plans.graph_queries import reachable_pairs

    kept, write = [], graph.checkpoint
    monkeypatch.setattr(graph, "checkpoint", lambda df: kept.append(write(df)) or kept[-1])
    rows = {(r["source"], r["target"]): r["reachable"] for r in reachable_pairs(spark, SF).collect()}
    hits = {pair for pair, hit in rows.items() if hit}
    held = {(r["origin"], r["at"]) for t in kept if {"origin", "at"} <= set(t.columns) for r in t.filter("at LIKE 'sup.mdx#%'").collect()}
    assert held == hits and hits

"""Traversal: filters, trees by id prefix, breadth-first levels, least shortest witnesses, cycles, evaluation over an acyclic graph."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import globs
from weftgraph.schema import checkpoint


#: Levels after which what is known is written as one table again.
COMPACT = 6

#: Targets of a group in one row, at about: each is looked for among a source's hits there. Pairs that a task returns, at about.
LIST, PAIRS = 500, 1_000_000


class TooDeep(RuntimeError):
    """A loop reached its limit of levels."""


def filter_nodes(nodes: DataFrame, group: list[str] | None = None, file: str | None = None, tag: str | None = None, coverage: str | None = None) -> DataFrame:
    """Conjunctive; roots have neither tag nor coverage and so match neither filter."""
    if group is not None:
        nodes = nodes.filter(globs.matches_any(F.col("path"), group))
    if file is not None:
        nodes = nodes.filter(globs.matches(F.col("path"), file))
    if tag is not None:
        nodes = nodes.filter(~F.col("is_root") & F.array_contains("tags", tag))
    if coverage is not None:
        nodes = nodes.filter(~F.col("is_root") & (F.col("coverage") == coverage))
    return nodes


def filter_edges(edges: DataFrame, kinds: Iterable[str] | None = None, source: str | None = None, target: str | None = None) -> DataFrame:
    if kinds is not None:
        edges = edges.filter(F.col("kind").isin(*kinds))
    if source is not None:
        edges = edges.filter(F.col("source") == source)
    return edges if target is None else edges.filter(F.col("target") == target)


def edge_set(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["kind", "source", "target"])


def ancestors(nodes: DataFrame) -> DataFrame:
    """(identity, ancestor, distance) for every node and proper ancestor, from the id's prefixes alone: no join, no recursion."""
    named = nodes.filter("id IS NOT NULL")
    segments = F.split("id", r"\.")
    above = F.transform(
        F.sequence(F.lit(0), F.size(segments) - 1),
        lambda k: F.struct(F.when(k == 0, F.col("path")).otherwise(F.concat("path", F.lit("#"), F.array_join(F.slice(segments, F.lit(1), k), "."))).alias("ancestor"), (F.size(segments) - k).alias("distance")),
    )
    return named.select("identity", F.explode(above).alias("a")).select("identity", "a.ancestor", "a.distance")


def subtree(nodes: DataFrame, path: str, id: str | None = None) -> DataFrame:
    """A node and what is below it."""
    own = nodes.filter(F.col("path") == path)
    return own if id is None else own.filter((F.col("id") == id) | F.startswith("id", F.lit(id + ".")))


def nearest_listed(nodes: DataFrame, listed: DataFrame) -> DataFrame:
    """(identity, nearest): for each listed node its nearest listed proper ancestor, null if there is none."""
    ids = listed.select("identity")
    up = ancestors(nodes.join(ids, "identity", "left_semi"))
    near = up.join(ids.withColumnRenamed("identity", "ancestor"), "ancestor").groupBy("identity").agg(F.min_by("ancestor", "distance").alias("nearest"))
    return ids.join(near, "identity", "left")


def compact(known: DataFrame, level: int) -> DataFrame:
    """What is known as one table again after some levels, else each level would read all of those before it as tables of their own."""
    return checkpoint(known) if level % COMPACT == 0 else known


def bfs(edges: DataFrame, sources: DataFrame, limit: int = 10_000) -> DataFrame:
    """(identity, distance) of all that is reached from the sources (column identity), which have distance 0."""
    edges = checkpoint(edges.select("source", "target").distinct())
    level = checkpoint(sources.select("identity").distinct().withColumn("distance", F.lit(0)))
    seen = level
    for d in range(1, limit + 1):
        step = level.join(edges, level["identity"] == edges["source"]).select(F.col("target").alias("identity")).distinct()
        level = checkpoint(step.join(seen, "identity", "left_anti").withColumn("distance", F.lit(d)))
        if level.isEmpty():
            return seen
        seen = compact(seen.unionByName(level), d)
    raise TooDeep(f"over {limit} levels")


def witnesses(edges: DataFrame, sources: DataFrame, limit: int = 10_000, first_hop_only: bool = False) -> DataFrame:
    """(identity, path): the least shortest path of one edge or more from any source to each node that has one.

    Shortest first, then least element by element in byte order. A source that
    others reach has its own row, but longer paths start anew at the source:
    of an acyclic graph no path leads back to it. Only the best path of each
    node travels, so a level costs one join and one partial minimum.
    """
    edges = checkpoint(edges.select("source", "target").distinct())
    begin = sources.select(F.col("identity").alias("source"), F.array("identity").alias("path")).distinct()
    grow = lambda level: level.join(edges, "source").groupBy("target").agg(F.min(F.concat("path", F.array("target"))).alias("path"))
    level = checkpoint(grow(begin).withColumnRenamed("target", "identity"))
    found = level
    for k in range(0 if first_hop_only else limit):
        # a source's own best path is never longer than what starts at it, so it goes no further
        ahead = level.join(sources.select("identity"), "identity", "left_anti").withColumnRenamed("identity", "source")
        step = grow(ahead).withColumnRenamed("target", "identity")
        level = checkpoint(step.join(found, "identity", "left_anti"))
        if level.isEmpty():
            return found
        found = compact(found.unionByName(level), k + 1)
    if first_hop_only:
        return found
    raise TooDeep(f"over {limit} levels")


def _search(edges: DataFrame, ends: DataFrame | None, begin: DataFrame, limit: int) -> DataFrame:
    """(origin, at, kind, last, via) of all that an origin reaches by an edge or more, itself left out; via: the nodes between, of the least shortest path.

    begin: (origin, kind), each origin once; edges: (source, target), each once;
    ends: (source, target, kind), edges that end a path, for origins of that kind alone.
    """

    def grow(level: DataFrame, via: Column) -> DataFrame:
        level = level.select("origin", F.col("at").alias("source"), "kind", via.alias("via"))
        # hashes come first in the keys, so that sorts seldom compare names
        meet = lambda other, *key: level.withColumn("h", F.xxhash64(*key)).join(other.withColumn("h", F.xxhash64(*key)), ["h", *key]).filter("origin <> target")
        to = lambda walked, last: walked.select(F.xxhash64("origin", "target").alias("hash"), "origin", F.col("target").alias("at"), "kind", F.lit(last).alias("last"), "via")
        step = to(meet(edges, "source"), False)
        return step if ends is None else step.unionByName(to(meet(ends, "source", "kind"), True))

    level = found = checkpoint(grow(begin.withColumn("at", F.col("origin")), F.array().cast("array<string>")))
    key = ["hash", "origin", "at"]
    for k in range(limit):
        ahead = level.filter("NOT last")
        if ahead.isEmpty():
            return found
        step = grow(ahead, F.concat("via", F.array("at"))).repartition(*key).groupBy(*key)
        step = step.agg(F.any_value("kind").alias("kind"), F.any_value("last").alias("last"), F.min("via").alias("via"))
        level = checkpoint(step.join(found.select(*key), key, "left_anti"))
        found = compact(found.unionByName(level), k + 1)
    raise TooDeep(f"over {limit} levels")


def _path() -> Column:
    return F.concat(F.array("origin"), "via", F.array("at")).alias("path")


def reachable(edges: DataFrame, pairs: DataFrame, limit: int = 10_000) -> DataFrame:
    """(source, target, reachable, path) of each asked pair: one search from each distinct source; a node reaches itself by no path."""
    edges = checkpoint(edges.select("source", "target").distinct())
    asked = pairs.select("source", "target").distinct()
    begin = asked.select(F.col("source").alias("origin"), F.lit(0).alias("kind")).distinct()
    found = _search(edges, None, begin, limit)
    hit = found.select(F.col("origin").alias("source"), F.col("at").alias("target"), _path())
    return asked.join(hit, ["source", "target"], "left").select("source", "target", F.col("path").isNotNull().alias("reachable"), "path")


def reachable_in_groups(edges: DataFrame, sources: DataFrame, targets: DataFrame, limit: int = 10_000) -> DataFrame:
    """``reachable`` for each source (grp, source) and all targets (grp, target) of its groups, without a join of the pairs.

    Asked targets that lead no further are reached from sources of their own
    groups only. Pairs without a path are what a source's hits leave of its
    list of targets, so they are made where they are returned.
    """
    edges = checkpoint(edges.select("source", "target").distinct())
    own = checkpoint(sources.filter("grp IS NOT NULL").groupBy("source").agg(F.array_sort(F.collect_set("grp")).alias("grps")))
    kinds = checkpoint(own.select("grps").distinct().withColumn("kind", F.monotonically_increasing_id()))
    own = checkpoint(own.join(kinds, "grps").select("source", "kind"))
    groups = kinds.select("kind", F.explode("grps").alias("grp"))
    wanted = checkpoint(groups.join(targets.select("grp", "target"), "grp").select("kind", "target").distinct())
    onward = checkpoint(edges.join(wanted.select(F.col("target").alias("source")).distinct(), "source").select(F.col("source").alias("target")).distinct())
    last = checkpoint(wanted.filter("target IS NOT NULL").join(onward, "target", "left_anti"))
    inner = edges.join(last.select("target").distinct(), "target", "left_anti")
    found = _search(inner, edges.join(last, "target"), own.select(F.col("source").alias("origin"), "kind"), limit)
    between = found.filter("NOT last").join(wanted.join(onward, "target", "left_semi").withColumnRenamed("target", "at"), ["kind", "at"], "left_semi")
    hit = found.filter("last").unionByName(between).select(F.col("origin").alias("source"), F.col("at").alias("target"), "kind", _path())

    sizes = checkpoint(wanted.groupBy("kind").agg(F.count("*").alias("size"), F.ceil(F.count("*") / LIST).alias("blocks")))
    asked = own.join(sizes, "kind")
    tasks = (asked.agg(F.sum("size")).first()[0] or 0) // PAIRS + 1
    block = F.pmod(F.xxhash64("target"), F.col("blocks")).alias("block")
    lists = wanted.join(sizes, "kind").groupBy("kind", block).agg(F.collect_list(F.struct("target")).alias("all"))
    lists = checkpoint(lists.select("kind", "block", F.transform("all", lambda x: x["target"]).alias("all")))
    got = hit.join(sizes, "kind").select("source", "target", block).repartition(tasks, "source", "block").groupBy("source", "block").agg(F.collect_list("target").alias("got"))
    asked = asked.select("source", "kind", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).repartition(tasks, "source", "block")
    missed = asked.join(got, ["source", "block"], "left").join(lists, ["kind", "block"]).select("source", "got", F.explode("all").alias("target"))
    missed = missed.filter(~F.coalesce(F.array_contains("got", F.col("target")), F.lit(False)))
    none = F.lit(None).cast("array<string>").alias("path")
    return hit.select("source", "target", F.lit(True).alias("reachable"), "path").unionByName(missed.select("source", "target", F.lit(False).alias("reachable"), none))


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges on which every node has one edge in and one out, after peeling: empty exactly if there is no cycle."""
    core = checkpoint(edges.select("source", "target").distinct())
    n = core.count()
    while True:
        alive = core.join(core.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        alive = alive.join(alive.select(F.col("target").alias("source")).distinct(), "source", "left_semi").select("source", "target")
        core = checkpoint(alive)
        if n == (n := core.count()):
            return core


def _label(edges: DataFrame) -> DataFrame:
    """(identity, label): weakly connected components of the few edges that lie on cycles."""
    both = checkpoint(edges.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct())
    label = checkpoint(both.groupBy(F.col("source").alias("identity")).agg(F.least(F.min("source"), F.min("target")).alias("label")))
    while True:
        near = both.join(label, both["target"] == label["identity"]).groupBy(F.col("source").alias("identity")).agg(F.min("label").alias("near"))
        now = checkpoint(label.join(near, "identity").select("identity", F.least("label", "near").alias("label")))
        if now.exceptAll(label).isEmpty():
            return now
        label = now


def _strong(after: dict[str, list[str]]) -> list[list[str]]:
    """Strongly connected components, by one depth-first search without recursion."""
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    path, on, out = [], set(), []
    for root in after:
        if root in number:
            continue
        work = [(root, iter(after[root]))]
        number[root] = low[root] = len(number)
        path.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            following = next(rest, None)
            if following is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    cut = path.index(node)
                    out.append(path[cut:])
                    on.difference_update(path[cut:])
                    del path[cut:]
            elif following not in number:
                number[following] = low[following] = len(number)
                path.append(following)
                on.add(following)
                work.append((following, iter(after.get(following, []))))
            elif following in on:
                low[node] = min(low[node], number[following])
    return out


def _elementary(part: pd.DataFrame) -> pd.DataFrame:
    """Closed walks of the elementary cycles of one component, each from its least node, in order.

    From each node in turn, within the strong component of it and the greater
    ones; a node that led nowhere stays blocked until one that it waits for is
    free again, so the time follows the cycles found, not the walks tried.
    """
    after: dict[str, list[str]] = {}
    for s, t in sorted(set(zip(part["source"], part["target"], strict=True)), key=lambda e: (e[0].encode(), e[1].encode())):
        after.setdefault(s, []).append(t)
        after.setdefault(t, [])
    found: list[list[str]] = []
    pieces = [x for x in _strong(after) if len(x) > 1 or x[0] in after[x[0]]]
    while pieces:
        own = set(pieces.pop())
        start = min(own, key=str.encode)
        inner = {n: [t for t in after[n] if t in own] for n in own}
        walk, blocked, waits = [start], {start}, {n: set() for n in own}
        work, closed = [iter(inner[start])], [False]
        while work:
            t = next(work[-1], None)
            if t is None:
                work.pop()
                node, led = walk.pop(), closed.pop()
                if closed:
                    closed[-1] |= led
                if led:
                    free = [node]
                    while free:
                        n = free.pop()
                        if n in blocked:
                            blocked.discard(n)
                            free += waits[n]
                            waits[n] = set()
                else:
                    for n in inner[node]:
                        waits[n].add(node)
            elif t == start:
                found.append([*walk, start])
                closed[-1] = True
            elif t not in blocked:
                walk.append(t)
                blocked.add(t)
                work.append(iter(inner[t]))
                closed.append(False)
        rest = {n: [t for t in ts if t != start] for n, ts in inner.items() if n != start}
        pieces += [x for x in _strong(rest) if len(x) > 1 or x[0] in rest[x[0]]]
    return pd.DataFrame({"cycle": sorted(found, key=lambda w: [n.encode() for n in w])}, columns=["cycle"])


def cycles(edges: DataFrame) -> DataFrame:
    """Every elementary cycle once, as the closed walk from its byte-least node. A self-loop is a cycle of one."""
    core = cyclic_core(edges)
    if core.isEmpty():
        return core.select(F.array("source").alias("cycle")).limit(0)
    named = core.join(_label(core), core["source"] == F.col("identity")).select("label", "source", "target")
    return named.groupBy("label").applyInPandas(lambda part: _elementary(part), "cycle array<string>")


def evaluate(nodes: DataFrame, needs: DataFrame, combine: Callable[[DataFrame], DataFrame], limit: int = 10_000) -> DataFrame:
    """Values of all nodes of an acyclic graph, from what they need upwards.

    ``nodes``: (identity, ...); ``needs``: (identity, need, ...), a bag. In each
    round ``combine`` gets the nodes that are due, joined with an array
    ``found`` of (the columns of needs, value) and gives (identity, value). A
    round costs one join of the needs with what became known in the last one.
    """
    needs = checkpoint(needs)
    wanted = needs.groupBy("identity").agg(F.count("*").alias("wanted"))
    waiting = checkpoint(nodes.join(wanted, "identity", "left").withColumn("wanted", F.coalesce("wanted", F.lit(0))))
    extra = [c for c in needs.columns if c != "identity"]
    kind = needs.schema
    empty = F.array().cast("array<struct<" + ",".join(f"{c}:{kind[c].dataType.simpleString()}" for c in extra) + ",value:string>>")
    fresh = checkpoint(combine(waiting.filter("wanted = 0").withColumn("found", empty)).select("identity", "value"))
    known, open_ = fresh, checkpoint(waiting.filter("wanted > 0"))
    gathered = None
    for _ in range(limit):
        if open_.isEmpty():
            return known
        new = needs.join(fresh.select(F.col("identity").alias("need"), "value"), "need").select("identity", F.struct(*extra, "value").alias("item"))
        gathered = checkpoint(new if gathered is None else gathered.unionByName(new))
        arrays = gathered.groupBy("identity").agg(F.collect_list("item").alias("found"))
        due = open_.join(arrays, "identity").filter(F.size("found") == F.col("wanted"))
        fresh = checkpoint(combine(due).select("identity", "value"))
        if fresh.isEmpty():
            raise ValueError("the graph has a cycle or a need without a node")
        known = known.unionByName(fresh)
        open_ = checkpoint(open_.join(fresh, "identity", "left_anti"))
        gathered = gathered.join(fresh, "identity", "left_anti")
    raise TooDeep(f"over {limit} levels")


def outgoing(edges: DataFrame, identity: str) -> DataFrame:
    return edges.filter(F.col("source") == identity)


def incoming(edges: DataFrame, identity: str) -> DataFrame:
    return edges.filter(F.col("target") == identity)


def unreferenced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge but containment targets."""
    return nodes.join(edges.filter("kind <> 'contains'").select(F.col("target").alias("identity")), "identity", "left_anti")


def ids(nodes: DataFrame, sources: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(path, ids): the ids of each source (path) in document order; a file without any keeps its row. With edges, only of unreferenced nodes."""
    own = nodes.filter("id IS NOT NULL")
    if edges is not None:
        own = unreferenced(own, edges)
    listed = own.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("doc_ord", "id"))).alias("s"))
    none = F.array().cast("array<string>")
    return sources.select("path").distinct().join(listed, "path", "left").select("path", F.coalesce(F.transform("s", lambda x: x["id"]), none).alias("ids"))


def occurrences(bag: DataFrame, nodes: DataFrame, file: str | None = None, target: str | None = None) -> DataFrame:
    """Occurrences in files of a glob, of one target, each with the range of its source where that has one; nodes: (identity, start, end)."""
    if file is not None:
        bag = bag.filter(globs.matches(F.col("file"), file))
    if target is not None:
        bag = bag.filter(F.col("target") == target)
    ranges = nodes.select(F.col("identity").alias("source"), F.struct("start", "end").alias("source_range"))
    return bag.join(ranges, "source", "left").select(*bag.columns, "source_range")


def report(nodes: DataFrame, edges: DataFrame, identity: str) -> DataFrame:
    """One node with its incoming and outgoing edges, each ordered."""
    ordered: Callable[[Column], Column] = lambda kept: F.array_sort(F.collect_list(kept))
    near = edges.filter((F.col("source") == identity) | (F.col("target") == identity))
    lists = near.agg(
        ordered(F.when(F.col("target") == identity, F.struct("source", "kind"))).alias("incoming"),
        ordered(F.when(F.col("source") == identity, F.struct("target", "kind"))).alias("outgoing"),
    )
    return nodes.filter(F.col("identity") == identity).crossJoin(F.broadcast(lists))

"""Dependency policies: one violation for each rule and edge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import globs
from weftgraph.schema import DEPENDENCY_KINDS, Workspace


@dataclass(frozen=True)
class Selector:
    """Exactly one of: globs of a group, globs of files, tags."""

    group: tuple[str, ...] | None = None
    files: tuple[str, ...] | None = None
    tags: tuple[str, ...] | None = None

    def test(self, path: Column, tags: Column) -> Column:
        if self.tags is not None:
            return F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, self.tags))), F.lit(False))
        return globs.matches_any(path, list(self.group or self.files or ()))


@dataclass(frozen=True)
class Rule:
    name: str
    type: str  # forbidden or allowedOnly
    source: Selector
    target: Selector
    kinds: tuple[str, ...] = DEPENDENCY_KINDS


def violations(work: Workspace, rules: list[Rule]) -> DataFrame:
    """(rule, kind, source, target). An end's path is in its identity; tags are joined only where a rule asks for them."""
    edges = work.edges.filter(F.col("kind").isin(*DEPENDENCY_KINDS))
    named = work.nodes.select("identity", "tags")
    for end, chosen in (("source", [r.source for r in rules]), ("target", [r.target for r in rules])):
        if any(s.tags is not None for s in chosen):
            edges = edges.join(named.select(F.col("identity").alias(end), F.col("tags").alias(f"{end}_tags")), end, "left")
        else:
            edges = edges.withColumn(f"{end}_tags", F.lit(None).cast("array<string>"))
    out = []
    for r in rules:
        path = lambda end: F.substring_index(end, "#", 1)
        left = r.source.test(path("source"), F.col("source_tags"))
        right = r.target.test(path("target"), F.col("target_tags"))
        globs_of = [s.files or s.group for s in (r.source, r.target)]
        if all(g and len(g) == 1 for g in globs_of) and "$" in globs_of[0][0]:
            right = globs.matches_pair(path("source"), path("target"), globs_of[0][0], globs_of[1][0])
        bad = left & (right if r.type == "forbidden" else ~right)
        out.append(F.when(F.col("kind").isin(*r.kinds) & bad, F.lit(r.name)))
    # one pass over the edges for all rules
    return edges.select(F.explode(F.array_compact(F.array(*out))).alias("rule"), "kind", "source", "target")

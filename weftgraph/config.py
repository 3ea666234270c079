"""Configuration: a closed literal vocabulary, validated on the driver and never executed.

    specs, code: {group: [glob, ...]}
    markdown: {"emit": bool, "outDir": str}
    coverage: [{"name", "target", "boundary", "boundaryKind", "mode", "targets", "targetTags", "edgeKinds"}]
    policy: [{"name", "type", "from", "to", "kinds"}], a selector being exactly one of
        {"group", "kind"}, {"files"}, {"tags"}
"""

from __future__ import annotations

from dataclasses import dataclass

from weftgraph.functions import globs
from weftgraph.operators.coverage import Profile
from weftgraph.operators.policy import Rule, Selector
from weftgraph.schema import DEPENDENCY_KINDS


class ConfigurationError(ValueError):
    """All problems of a configuration, one to a line."""


@dataclass(frozen=True)
class Configuration:
    specs: dict[str, list[str]]
    code: dict[str, list[str]]
    markdown: dict
    coverage: dict[str, Profile]
    policy: list[Rule]


KEYS = {
    "": ("specs", "code", "markdown", "coverage", "policy"),
    "markdown": ("emit", "outDir"),
    "coverage": ("name", "target", "boundary", "boundaryKind", "mode", "targets", "targetTags", "edgeKinds"),
    "policy": ("name", "type", "from", "to", "kinds"),
    "selector": ("group", "kind", "files", "tags"),
}


def load(data: dict) -> Configuration:
    """A configuration from literals; raises ``ConfigurationError`` with every problem found."""
    bad: list[str] = []

    def closed(kind: str, value, where: str) -> dict:
        if not isinstance(value, dict):
            bad.append(f"{where}: no object")
            return {}
        bad.extend(f"{where}: unknown key {k!r}" for k in value if k not in KEYS[kind])
        return value

    def strings(value, where: str) -> list[str]:
        value = [value] if isinstance(value, str) else value
        if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
            bad.append(f"{where}: no strings")
            return []
        return value

    def one_of(value, known: tuple, where: str):
        if value not in known:
            bad.append(f"{where}: {value!r} is none of {', '.join(known)}")
        return value

    top = closed("", data, "configuration")
    groups: dict[str, dict[str, list[str]]] = {}
    for kind in ("specs", "code"):
        groups[kind] = {n: strings(g, f"{kind}.{n}") for n, g in (top.get(kind) or {}).items()}
        bad.extend(f"{kind}.{n}: {g!r} lies outside the root" for n, gs in groups[kind].items() for g in gs if globs.outside_root(g))
    markdown = closed("markdown", top.get("markdown", {}), "markdown")

    def group(name, kind: str, where: str) -> tuple[str, ...]:
        found = groups["specs" if kind == "spec" else "code"].get(name)
        if found is None:
            bad.append(f"{where}: no {kind} group {name!r}")
        return tuple(found or ())

    def kinds(value, where: str) -> tuple[str, ...]:
        return tuple(DEPENDENCY_KINDS if value is None else [k for k in DEPENDENCY_KINDS if k in [one_of(x, DEPENDENCY_KINDS, where) for x in strings(value, where)]])

    profiles: dict[str, Profile] = {}
    for i, p in enumerate(top.get("coverage") or []):
        where = f"coverage[{i}]"
        p = closed("coverage", p, where)
        if p.get("name") in profiles or not isinstance(p.get("name"), str):
            bad.append(f"{where}: a name of its own is needed")
        side = one_of(p.get("boundaryKind", "code"), ("code", "spec"), f"{where}.boundaryKind")
        tags = p.get("targetTags")
        profiles[p.get("name")] = Profile(
            target=group(p.get("target"), "spec", where), boundary=group(p.get("boundary"), side, where), boundary_kind=side,
            mode=one_of(p.get("mode", "transitive"), ("direct", "transitive"), f"{where}.mode"), targets=one_of(p.get("targets", "leaves"), ("leaves", "all"), f"{where}.targets"),
            target_tags=None if tags is None else tuple(strings(tags, f"{where}.targetTags")), edge_kinds=kinds(p.get("edgeKinds"), f"{where}.edgeKinds"),
        )

    def selector(value, where: str) -> Selector:
        value = closed("selector", value, where)
        if sum(k in value for k in ("group", "files", "tags")) != 1 or ("kind" in value and "group" not in value):
            bad.append(f"{where}: exactly one of group, files and tags")
        if "group" in value:
            kind = value.get("kind") or ("spec" if value["group"] in groups["specs"] else "code")
            return Selector(group=group(value["group"], kind, where))
        if "tags" in value:
            return Selector(tags=tuple(strings(value["tags"], where)))
        return Selector(files=tuple(strings(value.get("files", []), where)))

    rules = []
    for i, r in enumerate(top.get("policy") or []):
        where = f"policy[{i}]"
        r = closed("policy", r, where)
        kind = one_of(r.get("type"), ("forbidden", "allowedOnly"), f"{where}.type")
        rules.append(Rule(str(r.get("name")), kind, selector(r.get("from", {}), f"{where}.from"), selector(r.get("to", {}), f"{where}.to"), kinds(r.get("kinds"), f"{where}.kinds")))
    if bad:
        raise ConfigurationError("\n".join(bad))
    return Configuration(groups["specs"], groups["code"], markdown, profiles, rules)

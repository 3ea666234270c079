"""Workspaces from files: spec documents and code, read and parsed on the executors.

The parser knows a documented subset of the source syntax and reports what it
does not know as findings, file by file:

- sections ``<S id="a.b" d={...} tags="x y" coverage="none">...</S>`` (also
  ``<Spec>`` at the top, without an id), nested and balanced, attributes
  quoted by ``"`` or ``'``;
- ``d={X.a.b}``, ``d={[X.a, "local.id"]}``: static chains and strings;
- embeddings ``{text(X.a.b)}``, comments ``{/* ... */}``;
- imports ``import X from "./other.mdx"`` at the start of a line;
- fenced code is content.

Of code, ``import X from "./spec.mdx"``, exported functions, classes and
constants as units, markers ``X.a.b;`` on a line of their own (references) and
``text(X.a.b)`` (embeddings) are known. Offsets count bytes of UTF-8.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions import globs, scalars
from weftgraph.operators import graph
from weftgraph.operators import journal as log
from weftgraph.operators import text as text_of
from weftgraph.schema import Workspace, checkpoint

TOKEN = re.compile(
    r"(?P<fence>^(?:```|~~~)[^\n]*\n.*?(?:^(?:```|~~~)[ \t]*$|\Z))|(?P<comment>\{/\*.*?\*/\})|(?P<embed>\{\s*text\(\s*(?P<ref>[^(){}]*?)\s*\)\s*\})"
    r"|(?P<close></(?:S|Spec)\s*>)|(?P<open><(?:S|Spec)(?=[\s>/])(?P<attrs>(?:[^>\"'{]|\"[^\"]*\"|'[^']*'|\{[^{}]*\})*)>)|(?P<import>^import\s+(?P<name>\w+)\s+from\s+[\"'](?P<from>[^\"']+)[\"'];?[ \t]*$)",
    re.S | re.M,
)
ATTRIBUTE = re.compile(r"(?P<name>[\w-]+)\s*=\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)'|\{(?P<c>[^{}]*)\})")
CHAIN = re.compile(r"\s*(?:(?P<string>\"[^\"]*\"|'[^']*')|(?P<chain>\w+(?:\.\w[\w-]*|\[\"[^\"]*\"\])*))\s*(?:,|\Z)")

ROWS = "path string, row string, ord int, id string, parent int, coverage string, tags array<string>, start int, end int, text string, ref string, expansion string, code string"


def _row(path: str, row: str, ord: int, **values) -> dict:
    out = dict.fromkeys(("id", "parent", "coverage", "tags", "start", "end", "text", "ref", "expansion", "code"))
    return {"path": path, "row": row, "ord": ord, **out, **values}


def _refs(value: str) -> list[str] | None:
    """Static references of a ``d`` attribute; null if some part is not static."""
    value = value.strip()
    value = value[1:-1] if value.startswith("[") and value.endswith("]") else value
    found, at = [], 0
    while at < len(value.strip()):
        m = CHAIN.match(value, at)
        if not m or not m[0]:
            return None
        found.append("." + m["string"][1:-1] if m["string"] else re.sub(r"\[\"([^\"]*)\"\]", r".\1", m["chain"]))
        at = m.end()
    return found


def parse_spec(path: str, data: bytes) -> Iterator[dict]:
    """Rows of a document: section, piece, ref, import, finding. A reference ``.id`` is local, ``X.id`` goes by the import X."""
    try:
        text = data.decode()
    except UnicodeDecodeError as e:
        yield _row(path, "finding", 0, code="unparseable-source", start=e.start, end=e.end)
        return
    if text.startswith("﻿"):
        yield _row(path, "finding", 0, code="unparseable-source", start=0, end=3)
        return
    at = lambda k: len(text[:k].encode())
    open_: list[dict] = [_row(path, "section", 0, start=0, end=len(data), tags=None)]
    sections, pieces, refs, imports, findings = [open_[0]], [], [], [], []
    last = 0

    def piece(kind: str, start: int, end: int, **values) -> None:
        pieces.append(_row(path, "piece", len(pieces), parent=open_[-1]["ord"], code=kind, text=text[start:end], start=at(start), end=at(end), **values))

    for m in TOKEN.finditer(text):
        if m["fence"]:
            continue
        if m.start() > last:
            piece("content", last, m.start())
        last = m.end()
        if m["comment"] or m["import"]:
            piece("removal", m.start(), m.end())
            if m["import"]:
                imports.append(_row(path, "import", len(imports), id=m["name"], ref=m["from"], start=at(m.start()), end=at(m.end())))
        elif m["embed"]:
            ref = _refs(m["ref"])
            if ref is None or len(ref) != 1:
                findings.append(_row(path, "finding", len(findings), code="invalid-argument", start=at(m.start()), end=at(m.end())))
            else:
                refs.append(_row(path, "ref", len(refs), parent=open_[-1]["ord"], code="embeds", ref=ref[0], start=at(m.start()), end=at(m.end())))
            piece("embedding", m.start(), m.end(), ref=ref[0] if ref else None)
        elif m["close"]:
            piece("removal", m.start(), m.end())
            if len(open_) == 1:
                findings.append(_row(path, "finding", len(findings), code="unparseable-source", start=at(m.start()), end=at(m.end())))
            else:
                open_.pop()["end"] = at(m.end())
        else:
            section = _row(path, "section", len(sections), parent=open_[-1]["ord"], coverage="required", tags=[], start=at(m.start()))
            seen = set()
            for a in ATTRIBUTE.finditer(m["attrs"]):
                value = next(v for v in (a["a"], a["b"], a["c"]) if v is not None)
                if a["name"] in seen or a["name"] not in ("id", "d", "tags", "coverage"):
                    findings.append(_row(path, "finding", len(findings), code="invalid-prop", start=at(m.start()), end=at(m.end())))
                    continue
                seen.add(a["name"])
                if a["name"] == "d":
                    for r in _refs(value) or []:
                        refs.append(_row(path, "ref", len(refs), parent=len(sections), code="depends", ref=r, start=at(m.start()), end=at(m.end())))
                    if _refs(value) is None:
                        findings.append(_row(path, "finding", len(findings), code="invalid-argument", start=at(m.start()), end=at(m.end())))
                elif a["name"] == "tags":
                    section["tags"] = sorted({t for t in re.split(r"[\t\n\x0b\f\r ]+", value) if t}, key=str.encode)
                else:
                    section[a["name"]] = value
            piece("removal", m.start(), m.end())
            if m["attrs"].rstrip().endswith("/"):
                section["end"] = at(m.end())
            else:
                open_.append(section)
            sections.append(section)
    if last < len(text):
        piece("content", last, len(text))
    for s in open_[1:]:
        findings.append(_row(path, "finding", len(findings), code="unparseable-source", start=s["start"], end=len(data)))
        s["end"] = len(data)
    yield from (*sections, *pieces, *refs, *imports, *findings)


UNIT = re.compile(r"^export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var|interface|type|enum)\s+(\w+)", re.M)
MARKER = re.compile(r"^[ \t]*(?P<marker>\w+(?:\.\w[\w-]*)+);[ \t]*$|\btext\(\s*(?P<call>\w+(?:\.\w[\w-]*)+)\s*\)", re.M)


def parse_code(path: str, data: bytes) -> Iterator[dict]:
    """Rows of a code file: unit, ref, import, finding. A unit reaches to the next one."""
    try:
        text = data.decode()
    except UnicodeDecodeError as e:
        yield _row(path, "finding", 0, code="unparseable-source", start=e.start, end=e.end)
        return
    at = lambda k: len(text[:k].encode())
    yield _row(path, "unit", 0, start=0, end=len(data))
    found = list(UNIT.finditer(text))
    for k, m in enumerate(found):
        end = found[k + 1].start() if k + 1 < len(found) else len(text)
        yield _row(path, "unit", k + 1, id=m[1], start=at(m.start()), end=at(end))
    names = set()
    for k, m in enumerate(m for m in TOKEN.finditer(text) if m["import"]):
        if m["from"].endswith(".mdx"):
            names.add(m["name"])
            yield _row(path, "import", k, id=m["name"], ref=m["from"], start=at(m.start()), end=at(m.end()))
    for k, m in enumerate(m for m in MARKER.finditer(text) if (m["marker"] or m["call"]).split(".")[0] in names):
        unit = sum(u.start() <= m.start() for u in found)
        yield _row(path, "ref", k, parent=unit, code="references" if m["marker"] else "embeds", ref=m["marker"] or m["call"], start=at(m.start()), end=at(m.end()))


def scan(spark: SparkSession, root: str, spec_groups: dict[str, list[str]], code_groups: dict[str, list[str]], marker: str = ".gen") -> DataFrame:
    """(path, kind, groups, bytes) of every file below ``root`` that a group's globs match; a file in groups of both kinds is in twice, one named with the marker of derived files not at all."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = posixpath.normpath(re.sub(r"^\w+:/*", "/", root)) + "/"
    own = read.select(F.substring_index("path", prefix, -1).alias("path"), F.col("content").alias("bytes"))
    kinds = []
    for kind, groups in (("spec", spec_groups), ("code", code_groups)):
        named = F.array_compact(F.array(*[F.when(globs.matches_any(F.col("path"), g), F.lit(n)) for n, g in groups.items()])) if groups else F.array().cast("array<string>")
        kinds.append(F.struct(F.lit(kind).alias("kind"), F.array_sort(named).alias("groups")))
    derived = F.col("path").rlike(rf"{re.escape(marker)}(?:[./]|$)")  # the marker ends a part of the name: my.genes.mdx is a source
    claimed = F.filter(F.array(*kinds), lambda x: F.size(x["groups"]) > 0)
    return own.filter(~derived).select("path", F.explode(claimed).alias("k"), "bytes").select("path", "k.kind", "k.groups", "bytes")


def parse(sources: DataFrame) -> DataFrame:
    """Rows (ROWS) of all sources; one file is parsed by one call, wherever it lies."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ROWS.split(", ")]
        for frame in frames:
            out = [r for path, kind, data in frame.itertuples(index=False) for r in (parse_spec if kind == "spec" else parse_code)(path, data)]
            made = pd.DataFrame(out, columns=columns)
            for c in ("ord", "parent", "start", "end"):
                made[c] = made[c].astype("Int32")
            yield made

    return sources.select("path", "kind", "bytes").mapInPandas(run, ROWS)


def load(sources: DataFrame) -> tuple[Workspace, DataFrame, DataFrame]:
    """The workspace of parsed sources, its pieces of text, and the findings of parser and references."""
    rows = checkpoint(parse(sources))
    section = rows.filter("row = 'section'")
    identity = F.when(F.col("id").isNull(), F.col("path")).otherwise(F.concat("path", F.lit("#"), "id"))
    named = section.withColumn("identity", identity)
    above = named.select("path", F.col("ord").alias("parent"), F.col("identity").alias("up"))
    pieces = rows.filter("row = 'piece'").select(F.col("path").alias("doc"), "ord", F.col("code").alias("kind"), "text", F.lit(None).cast("string").alias("expansion"))
    runs, events = _runs(rows, named, pieces)
    text = runs.groupBy("path", F.col("parent").alias("ord")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "").alias("own_text"))
    nodes = named.join(above, ["path", "parent"], "left").join(text, ["path", "ord"], "left").select(
        "identity", "path", "id", F.col("parent").isNull().alias("is_root"), F.col("up").alias("parent"),
        F.when(F.col("id").isNull(), 0).otherwise(F.size(F.split("id", r"\."))).alias("depth"), (F.col("ord") - 1).cast("long").alias("doc_ord"), "coverage", "tags", F.coalesce("own_text", F.lit("")).alias("own_text"),
    )
    nodes = checkpoint(nodes)
    unit = rows.filter("row = 'unit'")
    number = F.row_number().over(Window.partitionBy("path", "id").orderBy("ord"))
    unit = unit.withColumn("n", number).withColumn("unit", F.concat("id", F.when(F.col("n") > 1, F.concat(F.lit("@"), "n")).otherwise(F.lit(""))))
    unit = unit.withColumn("identity", F.when(F.col("id").isNull(), F.col("path")).otherwise(F.concat("path", F.lit("#"), "unit")))
    places = unit.select("identity", "path", "unit")
    link = rows.filter("row = 'import'").select("path", F.col("id").alias("name"), scalars.resolve_specifier(F.col("path"), F.col("ref")).alias("file"))
    ref = rows.filter("row = 'ref'").withColumn("name", F.substring_index("ref", ".", 1)).join(link, ["path", "name"], "left")
    file = F.when(F.col("name") == "", F.col("path")).otherwise(F.col("file"))
    rest = F.substr("ref", F.length("name") + 2)
    target = F.when(rest == "", file).otherwise(F.concat(file, F.lit("#"), rest))
    owner = named.select("path", F.col("ord").alias("parent"), F.col("identity").alias("source")).unionByName(unit.select("path", F.col("ord").alias("parent"), F.col("identity").alias("source")))
    ref = ref.withColumn("target", target).join(owner, ["path", "parent"], "left")
    known = nodes.select(F.col("identity").alias("target"))
    found = checkpoint(ref.join(known, "target", "left_semi").select("path", "start", "end", F.col("code").alias("kind"), "source", "target"))
    lost = ref.join(known, "target", "left_anti")
    code = F.when(F.col("code") == "depends", "unknown-dependency").when(F.col("code") == "references", "unknown-ts-reference").otherwise("unknown-text-target")
    findings = rows.filter("row = 'finding'").select("code", "path", "start", "end").unionByName(lost.select(code.alias("code"), "path", "start", "end"))
    contains = nodes.filter("parent IS NOT NULL").select(F.lit("contains").alias("kind"), F.col("parent").alias("source"), F.col("identity").alias("target"))
    edges = graph.edge_set(contains.unionByName(found.select("kind", "source", "target")))
    bag = found.select(F.col("path").alias("file"), F.col("start").cast("long"), F.col("end").cast("long"), "kind", "source", "target")
    owner = named.select("path", F.col("ord").alias("parent"), "identity")
    embedded = found.filter("kind = 'embeds'").select("path", "start", F.col("target").alias("embeds"))
    event = events.join(embedded, ["path", "start"], "left").select("path", "parent", (2 * F.col("n") - 1).alias("ord"), "kind", F.lit(None).cast("string").alias("text"), F.coalesce("child", "embeds").alias("target"))
    parts = runs.select("path", "parent", (2 * F.col("n")).alias("ord"), F.lit("run").alias("kind"), "text", F.lit(None).cast("string").alias("target")).unionByName(event)
    parts = checkpoint(parts.join(owner, ["path", "parent"]).select("identity", "ord", "kind", "text", "target"))
    return Workspace(nodes, places, edges, bag, parts), pieces, findings


def _runs(rows: DataFrame, named: DataFrame, pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs (path, parent, n, text) of each section, from 0, and its children and embeddings (path, parent, n, start, kind, child), the n-th after run n - 1.

    Embeddings are not expanded here, and hold their line as any content does.
    """
    where = rows.filter("row = 'piece'").select(F.col("path").alias("doc"), "ord", "parent", "start")
    left = text_of.shown(pieces.withColumn("expansion", F.when(F.col("kind") == "embedding", "x")))
    content = left.join(where, ["doc", "ord"]).select(F.col("doc").alias("path"), "parent", "start", "k", F.lit(0).alias("event"), F.lit(None).cast("string").alias("kind"), "text", F.lit(None).cast("string").alias("child"))
    kids = named.filter("parent IS NOT NULL").select("path", "parent", "start", F.lit("child").alias("kind"), F.col("identity").alias("child"))
    embeds = rows.filter("row = 'piece' AND code = 'embedding'").select("path", "parent", "start", F.lit("embed").alias("kind"), F.lit(None).cast("string").alias("child"))
    marks = kids.unionByName(embeds).select("path", "parent", "start", F.lit(0).alias("k"), F.lit(1).alias("event"), "kind", F.lit(None).cast("string").alias("text"), "child")
    order = Window.partitionBy("path", "parent").orderBy("start", "event", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = checkpoint(content.unionByName(marks).withColumn("n", F.sum("event").over(order)))
    events = laid.filter("event = 1").select("path", "parent", "n", "start", "kind", "child")
    texts = laid.filter("event = 0").groupBy("path", "parent", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "k", "text"))), lambda x: x["text"]), "").alias("text"))
    every = named.select("path", F.col("ord").alias("parent"), F.lit(0).cast("long").alias("n")).unionByName(events.select("path", "parent", F.col("n").cast("long")))
    return every.join(texts, ["path", "parent", "n"], "left").select("path", "parent", "n", F.coalesce("text", F.lit("")).alias("text")), events


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) of a journal's file; its last line may lack a terminator. No file is an empty journal."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        return spark.createDataFrame([], "line long, text string")
    whole = spark.read.format("binaryFile").load(path).select(F.regexp_replace(F.decode("content", "UTF-8"), r"\n\z", "").alias("t")).filter("t <> ''")
    return whole.select(F.posexplode(F.split("t", "\n"))).select((F.col("pos") + 1).cast("long").alias("line"), F.col("col").alias("text"))


def versions(spark: SparkSession, before: str, now: str, spec_groups: dict[str, list[str]], code_groups: dict[str, list[str]], journal: str = "journal.jsonl") -> tuple[Workspace, Workspace, DataFrame, int]:
    """A baseline's folder and a current one as workspaces, the current journal (seq, from, to), and how many of its entries the baseline knows; its journal must be the beginning of the current one."""
    sides = [load(scan(spark, root, spec_groups, code_groups))[0] for root in (before, now)]
    entries = [log.parse(read_journal(spark, f"{root}/{journal}")) for root in (before, now)]
    for _, findings in entries:
        if not findings.isEmpty():
            raise ValueError("the journal has faulty lines")
    pairs = [checkpoint(log.pairs(e)) for e, _ in entries]
    log.replay(*pairs)  # refuses
    length = entries[0][0].count()
    return sides[0], sides[1], pairs[1], length


def write_derived(rows: DataFrame, folder: str) -> None:
    """Derived files (path, text, sha256) as one Parquet table, complete or not at all."""
    rows.select("path", "text", "sha256").write.mode("overwrite").parquet(folder)


def read_derived(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def save(work: Workspace, folder: str) -> None:
    """Write a workspace as Parquet tables."""
    for name in ("nodes", "locations", "edges", "occurrences"):
        getattr(work, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def read(spark: SparkSession, folder: str) -> Workspace:
    return Workspace(*(spark.read.parquet(f"{folder}/{name}") for name in ("nodes", "locations", "edges", "occurrences")))

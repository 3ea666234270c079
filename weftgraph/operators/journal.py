"""Identity journal: canonical identities, forward mapping, replay, and its file.

Entries are (seq, from, to): the pairs of one entry share ``seq``. Each pair is
an event of two names, and each event points to the one that comes before it (or
after it) on the other name; walks are answered for all names at once by pointers
that double their reach, so a journal of any length costs its logarithm in joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.scalars import json_string
from weftgraph.schema import checkpoint

NEVER = 2**62


def _asof(asked: DataFrame, events: DataFrame, forward: bool) -> DataFrame:
    """asked (name, bound, ...) with the last event of the name before the bound, or the first from it on: struct ``event``, null if none."""
    keys = [c for c in asked.columns if c not in ("name", "bound")]
    both = asked.select("name", F.col("bound").alias("at"), F.lit(1).alias("side"), F.struct("bound", *keys).alias("q"), F.lit(None).cast(events.schema["event"].dataType).alias("event"))
    both = both.unionByName(events.select("name", F.col("seq").alias("at"), F.lit(0).alias("side"), F.lit(None).cast(both.schema["q"].dataType).alias("q"), "event"))
    # an event at the bound itself is not before it, but it is from it on
    order = [F.col("at").asc(), F.col("side").desc()] if not forward else [F.col("at").desc(), F.col("side").asc()]
    seen = F.last("event", ignorenulls=True).over(Window.partitionBy("name").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("event", seen).filter("q IS NOT NULL").select("name", "q.*", "event")


def _jump(steps: DataFrame) -> DataFrame:
    """steps (key, next, ...) as pointers, closed: of each key, the row of the last one on its way."""
    steps = checkpoint(steps)
    while not steps.filter("next IS NOT NULL").isEmpty():
        rest = [c for c in steps.columns if c not in ("key", "next")]
        over = steps.select(F.col("key").alias("next"), F.struct(F.col("next").alias("next"), *rest).alias("o"))
        open_ = steps.filter("next IS NOT NULL").join(over, "next").select("key", "o.*")
        steps = checkpoint(steps.filter("next IS NULL").unionByName(open_))
    return steps


def canonical(identities: DataFrame, journal: DataFrame, length: int | None = None) -> DataFrame:
    """(identity, canonical, position): backwards from the newest entry, or the one before ``length``; one that maps the name away ends the walk."""
    own = journal if length is None else journal.filter(F.col("seq") < length)
    seq = F.col("seq").cast("long")
    came = own.select(F.col("to").alias("name"), seq.alias("seq"), F.struct(F.lit(True).alias("came"), seq.alias("seq"), F.col("from").alias("other")).alias("event"))
    went = own.select(F.col("from").alias("name"), seq.alias("seq"), F.struct(F.lit(False).alias("came"), seq.alias("seq"), F.col("from").alias("other")).alias("event"))
    events = checkpoint(came.unionByName(went))
    step = _asof(came.select(F.col("event.other").alias("name"), F.col("seq").alias("bound"), F.struct(F.col("name").alias("name"), F.col("seq").alias("seq")).alias("key")), events, False)
    on = F.col("event.came") == True  # noqa: E712
    end = lambda name: (F.when(on, None).otherwise(name).alias("canonical"), F.when(F.col("event.came") == False, F.col("event.seq") + 1).when(F.col("event").isNull(), 0).alias("position"))  # noqa: E712, E731
    closed = _jump(step.select("key", F.when(on, F.struct(F.col("name").alias("name"), F.col("event.seq").alias("seq"))).alias("next"), *end(F.col("name"))))
    start = _asof(identities.select(F.col("identity").alias("name"), F.lit(NEVER).alias("bound"), "identity"), events, False)
    start = start.select("identity", F.when(on, F.struct(F.col("name").alias("name"), F.col("event.seq").alias("seq"))).alias("key"), *end(F.col("name")))
    far = closed.select("key", F.col("canonical").alias("c"), F.col("position").alias("p"))
    return start.join(far, "key", "left").select("identity", F.coalesce("canonical", "c").alias("canonical"), F.coalesce("position", "p").cast("int").alias("position"))


def _forward(asked: DataFrame, journal: DataFrame) -> DataFrame:
    """asked (name, bound, ...) with ``now``: the name after the entries from the bound on."""
    seq = F.col("seq").cast("long")
    went = journal.select(F.col("from").alias("name"), seq.alias("seq"), F.struct(seq.alias("seq"), F.col("to").alias("other")).alias("event"))
    events = checkpoint(went)
    at = lambda: F.when(F.col("event").isNotNull(), F.struct(F.col("name").alias("name"), F.col("event.seq").alias("seq")))
    step = _asof(events.select(F.col("event.other").alias("name"), (F.col("seq") + 1).alias("bound"), F.struct("name", "seq").alias("key")), events, True)
    closed = _jump(step.select("key", at().alias("next"), F.col("name").alias("last")))
    start = _asof(asked, events, True).withColumn("key", at())
    return start.join(closed.select("key", "last"), "key", "left").withColumn("now", F.coalesce("last", "name")).drop("key", "last", "event")


def map_forward(identities: DataFrame, journal: DataFrame, after: int = 0, until: int | None = None) -> DataFrame:
    """(identity, now): the name after the entries from ``after`` up to ``until``, exclusive."""
    own = journal if until is None else journal.filter(F.col("seq") < until)
    return _forward(identities.select(F.col("identity").alias("name"), F.lit(after).cast("long").alias("bound"), "identity"), own).select("identity", "now")


def resolves(named: DataFrame, journal: DataFrame) -> DataFrame:
    """(canonical, position, now, current): where a canonical identity has gone, and whether that name's own walk ends on it."""
    asked = named.select(F.col("canonical").alias("name"), F.col("position").cast("long").alias("bound"), "canonical", "position")
    out = checkpoint(_forward(asked, journal).select("canonical", "position", "now"))
    back = canonical(out.select(F.col("now").alias("identity")).distinct(), journal)
    back = back.select(F.col("identity").alias("now"), F.col("canonical").alias("c"), F.col("position").alias("p"))
    return out.join(back, "now").select("canonical", "position", "now", ((F.col("c") == F.col("canonical")) & (F.col("p") == F.col("position"))).alias("current"))


#: An entry's operations (fixed values), and its line in the journal's file: one JSON object without spaces, keys in this order.
OPERATIONS = ("rename", "move-file", "move-section")
ENTRY = "op string, `from` string, `to` string, mapping array<struct<`from`:string,`to`:string>>"


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (seq, op, from, to, mapping) and findings (code, line, problem) of journal lines (line, text), the first of number 1.

    A line is valid if it is, byte for byte, what ``serialize`` makes of it, its
    mapping ascends by source, holds the operated-on identity, and each other
    pair extends both roots by the same suffix. An entry's ``seq`` is its place
    among the valid ones.
    """
    read = lines.withColumn("e", F.from_json("text", ENTRY, {"mode": "PERMISSIVE"}))
    e = F.col("e")
    root = F.struct(e["from"].alias("from"), e["to"].alias("to"))
    mark = F.when(e["op"] == "move-file", "#").otherwise(".")
    suffix = lambda p: F.substr(p["from"], F.length(e["from"]) + 1)
    extends = lambda p: F.startswith(p["from"], F.concat(e["from"], mark)) & (p["to"] == F.concat(e["to"], suffix(p)))
    sources = F.transform(e["mapping"], lambda p: p["from"])
    problem = (
        F.when(e["op"].isNull() | e["from"].isNull() | e["to"].isNull() | e["mapping"].isNull(), "is no entry")
        .when(~e["op"].isin(*OPERATIONS), "is of an unknown operation")
        .when(serialize(e["op"], e["from"], e["to"], e["mapping"]) != F.col("text"), "is not in canonical form")
        .when(e["from"] == e["to"], "changes nothing")
        .when(F.size(F.array_distinct(sources)) != F.size(sources), "maps an identity twice")
        .when(F.array_sort(sources) != sources, "does not ascend by source")
        .when(~F.array_contains(e["mapping"], root), "does not map the operated-on identity")
        .when(~F.forall(e["mapping"], lambda p: (p == root) | extends(p)), "maps what the operation does not affect")
    )
    judged = checkpoint(read.select("line", "e", problem.alias("problem")))
    good = judged.filter("problem IS NULL").select("line", "e.*")
    number = F.row_number().over(Window.orderBy("line")) - 1  # a journal is written by people, one operation a line
    findings = judged.filter("problem IS NOT NULL").select(F.lit("journal-error").alias("code"), "line", "problem")
    return good.withColumn("seq", number).select("seq", "op", "from", "to", "mapping"), findings


def serialize(op, source, target, mapping) -> Column:
    """The line of an entry."""
    pair = lambda p: F.concat(F.lit('{"from":'), json_string(p["from"]), F.lit(',"to":'), json_string(p["to"]), F.lit("}"))
    return F.concat(F.lit('{"op":'), json_string(op), F.lit(',"from":'), json_string(source), F.lit(',"to":'), json_string(target), F.lit(',"mapping":['), F.array_join(F.transform(mapping, pair), ","), F.lit("]}"))


def entry(op: str, source: str, target: str, mapping: DataFrame) -> DataFrame:
    """(text): the line of a new entry with all its pairs (from, to)."""
    pairs = mapping.agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("mapping"))
    return pairs.select(serialize(F.lit(op), F.lit(source), F.lit(target), F.col("mapping")).alias("text"))


def append(prior: DataFrame, line: DataFrame) -> DataFrame:
    """Lines (line, text) with one more after the last."""
    last = prior.agg(F.coalesce(F.max("line"), F.lit(0)).alias("n"))
    return prior.unionByName(line.join(last, F.lit(True)).select((F.col("n") + 1).cast(prior.schema["line"].dataType).alias("line"), "text"))


def pairs(entries: DataFrame) -> DataFrame:
    """Parsed entries as (seq, from, to)."""
    return entries.select("seq", F.explode("mapping").alias("p")).select("seq", "p.from", "p.to")


def replay(before: DataFrame, now: DataFrame) -> DataFrame:
    """Entries since the baseline. Its entries must be the first ones of the journal, line for line."""
    n = before.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
    cols = ["seq", "from", "to"]
    prefix = now.filter(F.col("seq") < n).select(*cols)
    if not prefix.exceptAll(before.select(*cols)).isEmpty() or not before.select(*cols).exceptAll(prefix).isEmpty():
        raise ValueError("the baseline's journal is no prefix of the current one")
    return now.filter(F.col("seq") >= n)


def faults(journal: DataFrame) -> DataFrame:
    """(seq, problem) of entries that map one name twice, onto one name twice, or onto a name that they map away."""
    twice = lambda c, problem: journal.groupBy("seq", c).count().filter("count > 1").select("seq", F.lit(problem).alias("problem"))
    both = journal.select("seq", F.col("from").alias("name")).join(journal.select("seq", F.col("to").alias("name")), ["seq", "name"]).select("seq", F.lit("source is target").alias("problem"))
    return twice("from", "repeated source").unionByName(twice("to", "repeated target")).unionByName(both).distinct()

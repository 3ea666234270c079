"""File source and streaming extension."""

from pyspark.sql import functions as F

from weftgraph.operators import coverage, text
from weftgraph.sources import files
from weftgraph.streaming import arrivals

SPEC = """<S id="print">
Print behavior.
<S id="print.hello" tags="critical  b b">
Print hello. {/* not
content */}
</S>
</S>
```
<S id="fenced">
```
"""
DERIVED = """import SPEC from "./SPEC.mdx"
<S id='derived'>Derived behavior.
<S id="derived.hello" d={[SPEC.print.hello, "derived"]} coverage="none">Says é {text(SPEC.print)} {text(SPEC.nowhere)}</S>
</S>
"""
CODE = """import D from "../specs/DERIVED.mdx";
export function hello() {
  D.derived.hello;
  return text(D.derived.hello);
}
export function hello() {}
"""


def workspace(spark, tmp_path):
    for name, body in (("specs/SPEC.mdx", SPEC), ("specs/DERIVED.mdx", DERIVED), ("src/hello.ts", CODE), ("src/skip.js", "")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    return files.load(files.scan(spark, f"file://{tmp_path}", {"spec": ["specs/*.mdx"]}, {"src": ["src/**/*.ts"]}))


def test_workspace_from_files(spark, tmp_path):
    work, pieces, findings = workspace(spark, tmp_path)
    nodes = {r["identity"]: r for r in work.nodes.collect()}
    assert set(nodes) == {"specs/SPEC.mdx", "specs/SPEC.mdx#print", "specs/SPEC.mdx#print.hello", "specs/DERIVED.mdx", "specs/DERIVED.mdx#derived", "specs/DERIVED.mdx#derived.hello"}
    assert nodes["specs/SPEC.mdx#print.hello"]["tags"] == ["b", "critical"] and nodes["specs/DERIVED.mdx#derived.hello"]["coverage"] == "none"
    hello = "specs/DERIVED.mdx#derived.hello"
    assert {tuple(r) for r in work.edges.filter("kind <> 'contains'").collect()} == {
        ("depends", hello, "specs/SPEC.mdx#print.hello"), ("depends", hello, "specs/DERIVED.mdx#derived"), ("embeds", hello, "specs/SPEC.mdx#print"),
        ("references", "src/hello.ts#hello", hello), ("embeds", "src/hello.ts#hello", hello),
    }
    assert {r["identity"] for r in work.locations.collect()} == {"src/hello.ts", "src/hello.ts#hello", "src/hello.ts#hello@2"}
    assert [(r["code"], r["path"]) for r in findings.collect()] == [("unknown-text-target", "specs/DERIVED.mdx")]
    covered = coverage.coverage(work, coverage.Profile(target=("specs/SPEC.mdx",), boundary=("src/*.ts",)))
    assert covered.filter("status = 'covered'").first()["path"] == ["src/hello.ts#hello", hello, "specs/SPEC.mdx#print.hello"]
    done = {r["doc"]: r["text"] for r in text.compiled(pieces).collect()}
    assert done["specs/SPEC.mdx"] == 'Print behavior.\nPrint hello. \n```\n<S id="fenced">\n```\n'


def test_faulty_sources(spark):
    rows = [("a.mdx", "spec", b"\xff"), ("b.mdx", "spec", b"<S id='x'>"), ("c.mdx", "spec", b"<S id='x' id='y'></S>"), ("d.mdx", "spec", b"<S id='x' d={f()}></S>"), ("e.mdx", "spec", b"</S>")]
    sources = spark.createDataFrame(rows, "path string, kind string, bytes binary")
    found = {(r["path"], r["code"]) for r in files.parse(sources).filter("row = 'finding'").collect()}
    assert found == {("a.mdx", "unparseable-source"), ("b.mdx", "unparseable-source"), ("c.mdx", "invalid-prop"), ("d.mdx", "invalid-argument"), ("e.mdx", "unparseable-source")}


def test_save_and_read(spark, tmp_path):
    work, _, _ = workspace(spark, tmp_path)
    files.save(work, f"file://{tmp_path}/snapshot")
    again = files.read(spark, f"file://{tmp_path}/snapshot")
    assert again.edges.exceptAll(work.edges).isEmpty() and work.nodes.exceptAll(again.nodes).isEmpty()


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "depends", "a", "b"), ("2024-01-01 00:10:00", "depends", "a", "b"), ("2024-01-01 01:10:00", "embeds", "c", "b")]
    events = spark.createDataFrame(rows, "ts string, kind string, source string, target string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    arrivals.edge_stream(stream()).writeStream.format("memory").queryName("edges").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("edges").count() == 2
    arrivals.reference_counts(stream()).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["n"] for r in spark.table("counts").collect()) == [1, 2]


def load(spark, folder, **texts):
    for name, body in texts.items():
        (folder / f"{name}.mdx").write_text(body)
    return files.load(files.scan(spark, f"file://{folder}", {"all": ["*.mdx"]}, {}))[0]


def test_own_hash_follows_content_past_children_and_embeddings(spark, tmp_path):
    """Text moved past a child, an embedding added, dropped, retargeted or moved, all change the hash; its spelling does not."""
    from weftgraph.operators import hashes

    other = '<S id="t">T</S><S id="u">T</S>'
    bodies = {
        "a": 'one<S id="s">x</S>two {text(O.t)}',
        "b": 'onetwo <S id="s">x</S>{text(O.t)}',
        "c": 'one<S id="s">x</S>two {text(O.u)}',
        "d": 'one<S id="s">x</S>two ',
        "e": 'one<S id="s">x</S>two {  text( O["t"] ) }',
        "f": 'one<S id="s">x</S>{text(O.t)}two ',
    }
    found = {}
    for name, body in bodies.items():
        folder = tmp_path / name
        folder.mkdir()
        work = load(spark, folder, o=other, p=f'import O from "./o.mdx"\n<S id="r">{body.replace("id=" + chr(34) + "s", "id=" + chr(34) + "r.s")}</S>\n')
        found[name] = {r["identity"]: r["own_hash"] for r in hashes.own_hash(work.nodes, work.parts).collect()}["p.mdx#r"]
        if name == "a":
            content = {r["identity"]: [tuple(x) for x in r["content"]] for r in hashes.own_content(work.parts).collect()}
            assert content["p.mdx#r"] == [("run", "one", None), ("child", None, "p.mdx#r.s"), ("run", "two ", None), ("embed", None, "o.mdx#t"), ("run", "", None)]
            assert content["p.mdx"] == [("run", "", None), ("child", None, "p.mdx#r"), ("run", "\n", None)] and content["o.mdx#t"] == [("run", "T", None)]
    assert found["a"] == found["e"] and len({found[k] for k in "abcdf"}) == 5


def test_sources_that_hold_the_marker_in_a_name_stay(spark, tmp_path):
    for name in ("my.genes.mdx", "a.gen.js", "b.gen.d.ts", "c.mdx"):
        (tmp_path / name).write_text("x")
    (tmp_path / ".gen").mkdir()
    got = files.scan(spark, f"file://{tmp_path}", {"s": ["*.mdx"]}, {"c": ["*.js", "*.ts", "*.mdx"]})
    assert sorted((r["path"], r["kind"]) for r in got.select("path", "kind").collect()) == [("c.mdx", "code"), ("c.mdx", "spec"), ("my.genes.mdx", "code"), ("my.genes.mdx", "spec")]


def test_two_versions_with_a_journal(spark, tmp_path):
    """A section is renamed by a journaled entry that the baseline does not know; another text changes; an unread journal shows more."""
    from weftgraph.operators import changes

    body = '<S id="a">{0}<S id="a.b">B</S></S>\n<S id="c" d={{["{1}"]}}>C</S>\n'
    for name, text_, id in (("old", "A", "a"), ("new", "A2", "x")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.mdx").write_text(body.format(text_, f"{id}.b").replace('"a', f'"{id}'))
    line = '{"op":"rename","from":"f.mdx#a","to":"f.mdx#x","mapping":[{"from":"f.mdx#a","to":"f.mdx#x"},{"from":"f.mdx#a.b","to":"f.mdx#x.b"}]}'
    (tmp_path / "new" / "journal.jsonl").write_text(line)
    before, now, log, known = files.versions(spark, f"file://{tmp_path}/old", f"file://{tmp_path}/new", {"s": ["*.mdx"]}, {})
    found = changes.analyse(before, now, log, known)
    got = {tuple(r) for r in changes.named(found, changes.categories(found).select("identity", "category"), "identity").collect()}
    assert known == 0 and got == {("f.mdx#x", "changed"), ("f.mdx", "descendant-changed")}
    assert changes.categories(changes.analyse(before, now)).filter("category = 'changed'").count() > 3


def test_derived_files_are_kept(spark, tmp_path):
    pieces = load_pieces(spark, tmp_path)
    made = text.emit_markdown(pieces, "out")
    files.write_derived(made, f"{tmp_path}/derived")
    assert [(r["path"], r["text"]) for r in files.read_derived(spark, f"{tmp_path}/derived").collect()] == [("out/p.md", "T\n")]


def load_pieces(spark, folder):
    (folder / "p.mdx").write_text('<S id="r">\nT\n</S>\n')
    return files.load(files.scan(spark, f"file://{folder}", {"all": ["*.mdx"]}, {}))[1]

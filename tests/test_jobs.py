import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from graphloom.ontology import Ontology
from graphloom.operators import resolve
from graphloom.operators.store import GraphStore
from graphloom.plans import pipeline
from graphloom.sources import corpus
from graphloom.streaming import changes


@pytest.fixture
def notes(tmp_path):
    root = tmp_path / "notes"
    (root / ".git").mkdir(parents=True)
    (root / ".git/x.md").write_text("hidden")
    (root / "a.md").write_text("# A\n\nopening\n\n## One\n\nsee [b](b.md)\n\n### Deep\n\nmore\n\n## Two\n\nlast\n")
    (root / "b.md").write_text("## B\n\nback to [a](a.md#one)\n")
    (root / "m.lua").write_text('local x = require("n")\n')
    (root / "n.lua").write_text("return 1\n")
    return root


def test_scan_and_config(spark, notes):
    config = corpus.CorpusConfig.load(f'name = "n"\nroot = "{notes}"\nexclude = ["b*"]', {"include": ["**/*.md"]})
    assert [r["name"] for r in corpus.scan(spark, config).collect()] == ["a.md"]
    for bad in ('name = "a b"\nroot = "/"', 'name = "a"\nroot = "/"\ngranularity = "x"', 'name = "a"\nroot = "/"\nnope = 1'):
        with pytest.raises(ValueError):
            corpus.CorpusConfig.load(bad)
    got = spark.createDataFrame([("a.b.md",), ("x/y.md",), ("z.txt",)], "p string").select(F.col("p").rlike(corpus.glob_regex("**/*.md"))).collect()
    assert [r[0] for r in got] == [True, True, False]


def test_bootstrap_and_increment(spark, notes):
    store = GraphStore(spark)
    job = pipeline.Indexer(store, corpus.CorpusConfig("n", str(notes), granularity="section"))
    assert job.bootstrap().indexed == 4
    # plans grow with each phase; a saved store starts afresh
    store.save(str(notes / "../kept"))
    store = GraphStore.load(spark, str(notes / "../kept"), ["File", "Section", "Corpus"])
    edges = {(r["src_pk"].split("/")[-1], r["edge_type"], r["dst_pk"].split("/")[-1]) for r in store.edges().collect()}
    assert {("a.md", "CONTAINS", "a.md#one"), ("a.md#one", "PARENT_OF", "a.md#deep"), ("a.md#a", "NEXT_SIBLING", "a.md#one"), ("a.md#one", "REFERENCES", "b.md"), ("b.md#b", "REFERENCES", "a.md#one")} <= edges
    sections = {r["id"].split("#")[-1]: r for r in store.nodes("Section").collect()}
    assert set(sections) == {"a", "one", "deep", "two", "b"} and all(r["summary"] and r["embedding"] for r in sections.values())
    assert store.nodes("File").where("summary IS NOT NULL").count() == 4
    assert store.nodes("Corpus").first()["node_count"] == 4
    (notes / "b.md").unlink()
    (notes / "n.lua").write_text("return 2\n")
    job = pipeline.Indexer(store, corpus.CorpusConfig("n", str(notes), granularity="section"))
    assert {r["path"].split("/")[-1]: r["action"] for r in job.changes(corpus.scan(spark, job.config)).collect()} == {"a.md": "unchanged", "b.md": "removed", "m.lua": "unchanged", "n.lua": "changed"}
    assert job.increment() == pipeline.Result(1, 1, 2)


def test_edited_sections_are_indexed_anew(spark, notes):
    config = corpus.CorpusConfig("n", str(notes), granularity="section")

    class Provider(pipeline.Offline):
        def summarise(self, texts):
            return [" ".join(t.split()) for t in texts]

    store = GraphStore(spark)
    pipeline.Indexer(store, config, Provider()).bootstrap()
    store.save(str(notes / "../kept"))
    before = {r["id"].split("#")[-1]: r for r in store.nodes("Section").collect()}
    store = GraphStore.load(spark, str(notes / "../kept"), ["File", "Section", "Corpus"])
    (notes / "a.md").write_text((notes / "a.md").read_text().replace("more", "edited [n](n.lua)"))
    assert pipeline.Indexer(store, config, Provider()).increment().indexed == 1
    after = {r["id"].split("#")[-1]: r for r in store.nodes("Section").collect()}
    assert "edited" in after["deep"]["summary"] and "more" in before["deep"]["summary"] and "more" not in after["deep"]["summary"]
    assert after["two"]["summary"] == before["two"]["summary"] and after["two"]["inferred_at"] == before["two"]["inferred_at"]
    assert "edited" in after["one"]["summary"] and "more" in before["one"]["summary"]  # rolled up from its child
    assert after["deep"]["inferred_at"] > before["deep"]["inferred_at"]
    files = {r["path"].split("/")[-1]: r["summary"] for r in store.nodes("File").collect()}
    assert "edited" in files["a.md"] and "more" not in files["a.md"]
    edges = {(r["src_pk"].split("/")[-1], r["edge_type"], r["dst_pk"].split("/")[-1]) for r in store.edges().collect()}
    assert {("a.md#one", "REFERENCES", "b.md"), ("a.md#deep", "REFERENCES", "n.lua")} <= edges


def test_relate_writes_what_a_model_finds(spark):
    """Matched and minted entities, fragments, the whitelist, lexical precedence, failed units and corpus patterns."""

    class Model(pipeline.Offline):
        def relate(self, text, context, previous):
            if text == "fail":
                raise ValueError("no answer")
            rows = [("USES", "Technology", "redis", {"description": "a store", "name": "no", "color": "red"}), ("USES", "Technology", "Zig", {"description": text}), ("REFERENCES", "File", "b.md", {}), ("REFERENCES", "File", "a.md", {}), ("CONTAINS", "File", "b.md", {})]
            return json.dumps({"relationships": [{"type": t, "target_type": k, "target_name": n, "confidence": 0.9, "properties": p} for t, k, n, p in rows]})

    files = spark.createDataFrame([(p, p, "h", "c") for p in ("a.md", "b.md", "c.md")], "path string, name string, hash string, corpus string")
    store = GraphStore(spark, {"File": files, "Technology": spark.createDataFrame([("Redis", "c", "known")], "name string, corpus string, description string")})
    units = spark.createDataFrame([("File", "a.md", "a.md", ".md", "c", "a", "[b](b.md) JIRA-7", ""), ("File", "c.md", "c.md", ".md", "c", "c", "fail", "")], "label string, pk string, path string, suffix string, corpus string, title string, text string, context string")
    found = pipeline.inferred_rows(units, Model(), Ontology())
    patterns = [{"regex": "([A-Z]+-\\d+)", "edge_type": "REFERENCES", "target_type": "Ticket", "capture": 1, "formats": ["md"]}]
    rows = pipeline.relate(store, units.drop("context", "title"), Ontology(), found, Model(), patterns).collect()
    assert sorted(r["drop_reason"] for r in rows if r["drop_reason"]) == ["edge type cannot be written", "lexical edge is there", "target is the source"]
    edges = {(r["src_pk"], r["edge_type"], r["dst_pk"]): r["method"] for r in store.edges().collect()}
    assert edges == {("a.md", "REFERENCES", "b.md"): "lexical", ("a.md", "REFERENCES", "JIRA-7"): "lexical", ("a.md", "USES", "Redis"): "llm", ("a.md", "USES", "Zig"): "llm"}
    nodes = {r["name"]: r for r in store.nodes("Technology").collect()}
    assert set(nodes) == {"Redis", "Zig"} and nodes["Redis"]["description"] == "known" and nodes["Redis"]["description_fragments"] == ["a store"]
    assert nodes["Zig"]["description"] == "[b](b.md) JIRA-7" and nodes["Zig"]["name_norm"] == "zig" and nodes["Zig"]["embedding"] and nodes["Zig"]["corpus"] == "c"
    assert {r["path"] for r in store.nodes("File").where("inferred_at IS NOT NULL").collect()} == {"a.md"}


def test_indexing_asks_the_model_with_context(spark, tmp_path):
    """The corpus's linked entities, then files linked or alike, reach the model with each unit's text."""
    (tmp_path / "a.md").write_text("red fish [b](b.md)")
    (tmp_path / "b.md").write_text("red bird")

    class Model(pipeline.Offline):
        def relate(self, text, context, previous):
            rows = [] if previous else [{"type": "DOCUMENTS", "target_type": "Pattern", "target_name": "Fish", "confidence": 1, "reason": context}]
            return json.dumps({"relationships": rows})

    store = GraphStore(spark)
    job = pipeline.Indexer(store, corpus.CorpusConfig("n", str(tmp_path), include=["*.md"]), Model(), gleaning_rounds=1)
    assert job.bootstrap().indexed == 2
    seen = {r["src_pk"].split("/")[-1]: r["reason"] for r in store.edges("DOCUMENTS").collect()}
    assert seen["a.md"].startswith("File: ") and seen["a.md"].endswith("b.md") and seen["b.md"].endswith("a.md")
    assert [r["name"] for r in store.nodes("Pattern").collect()] == ["Fish"]
    assert store.nodes("File").where("inferred_at IS NOT NULL").count() == 2


def test_neighbours_of_a_unit(spark):
    """The file's own sections and linked files first, then similar ones of the corpus, without the unit itself."""
    files = spark.createDataFrame([(p, p, "h", c, t, v) for p, c, t, v in (("a", "c", "red fish", [1.0, 0.0]), ("b", "c", "blue", [0.0, 1.0]), ("d", "c", "red bird", [0.9, 0.1]), ("x", "o", "red fish", [1.0, 0.0]))], "path string, name string, hash string, corpus string, summary string, embedding array<float>")
    sections = spark.createDataFrame([(f"{p}#{n}", p, c, n, t) for p, c, n, t in (("a", "c", 1, "one"), ("a", "c", 0, "two"), ("b", "c", 0, "red"), ("x", "o", 0, "red"))], "id string, path string, corpus string, ordinal int, summary string")
    edge = spark.createDataFrame([("File", "b", "REFERENCES", "File", "a")], "src_label string, src_pk string, edge_type string, dst_label string, dst_pk string")
    store = GraphStore(spark, {"File": files, "Section": sections})
    store.upsert_edges(edge)
    units = spark.createDataFrame([("File", "a", "a", "c", "red"), ("Section", "a#0", "a", "c", "red")], "label string, pk string, path string, corpus string, title string")
    got = {(r["pk"], r["kind"], r["place"]): r["target"] for r in resolve.neighbours(store, units).collect()}
    assert got == {("a", "section", 1): "a#0", ("a", "section", 2): "a#1", ("a", "section", 3): "b#0", ("a#0", "section", 1): "a#1", ("a#0", "section", 2): "b#0", ("a", "file", 1): "b", ("a", "file", 2): "d", ("a#0", "file", 1): "b", ("a#0", "file", 2): "d"}


def test_logs_and_checkpoint(spark, tmp_path):
    rows = spark.createDataFrame([("p", "m", "s", 1, 2, "2024-05-01T00:00:00"), ("p", "m", "s", 10, 20, "2024-05-02T00:00:00")], corpus.USAGE)
    corpus.log_usage(rows, str(tmp_path / "usage"))
    (tmp_path / "usage/day=2024-05-02/bad.json").write_text("{oops\n")
    good, bad = corpus.json_lines(spark, str(tmp_path / "usage"), corpus.USAGE)
    assert tuple(corpus.costs(good, "2024-05-02").first()) == ("p", 10, 20) and bad.count() == 1
    point = corpus.Checkpoint(str(tmp_path / "c.json"))
    assert point.load() is None
    point.save("enumerate", 3, "x")
    assert point.load()["last_committed_batch"] == 3
    (tmp_path / "c.json").write_text('{"phase": 1, "last_committed_batch": true}')
    with pytest.raises(ValueError):
        point.load()


def test_providers_retry():
    calls, pauses = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "ok"

    assert pipeline.retried(flaky, sleep=pauses.append) == "ok" and 0.8 <= pauses[0] <= 1.2 and 1.6 <= pauses[1] <= 2.4
    with pytest.raises(ConnectionError):
        pipeline.retried(lambda: (_ for _ in ()).throw(ConnectionError()), tries=2, sleep=pauses.append)


T0 = dt.datetime(2024, 1, 1)


def burst_rows(spark):
    at = [0, 10, 39, 100, 125, 150, 175, 200]
    return spark.createDataFrame([("c", f"p{i % 3}", "m", T0 + dt.timedelta(seconds=s)) for i, s in enumerate(at)], changes.EVENT)


def test_bursts(spark):
    got = changes.bursts(burst_rows(spark), 30, 0).orderBy("start").collect()
    assert [(r["n_events"], r["n_paths"]) for r in got] == [(3, 3), (5, 3)]
    assert [r["n_events"] for r in changes.bursts(burst_rows(spark), 30, 60).orderBy("start").collect()] == [3, 3, 2]
    assert [r["n_events"] for r in changes.debounced(burst_rows(spark), 30).orderBy("start").collect()] == [3, 5]
    with pytest.raises(ValueError, match="window"):
        changes.caps(30, 10)


def test_streamed_bursts(spark, tmp_path):
    rows = [r.asDict() | {"ts": r["ts"].isoformat()} for r in burst_rows(spark).collect()]
    far = {"corpus": "zz", "path": "end", "kind": "m", "ts": (T0 + dt.timedelta(days=1)).isoformat()}
    (tmp_path / "in").mkdir()
    for n, part in enumerate((rows, [far], [far | {"ts": (T0 + dt.timedelta(days=2)).isoformat()}])):
        (tmp_path / f"in/{n}.json").write_text("\n".join(map(json.dumps, part)))
        os.utime(tmp_path / f"in/{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))  # files are taken by age
    stream = spark.readStream.schema(changes.EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = changes.debounced_by_age(stream, 30, 60, "10 seconds").writeStream.format("memory").queryName("aged").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.sql("SELECT size(paths) AS n, cast(start AS double) AS s FROM aged WHERE corpus = 'c' ORDER BY s").collect()
    assert [r["n"] for r in got] == [3, 3, 2]
    query = changes.debounced(stream, 30, "10 seconds").writeStream.format("memory").queryName("plain").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r["n_events"] for r in spark.sql("SELECT * FROM plain WHERE corpus = 'c' ORDER BY start").collect()] == [3, 5]


def test_sync_marks_what_succeeded(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/0.json").write_text("\n".join(json.dumps({"corpus": "c", "path": p, "kind": "m", "ts": T0.isoformat()}) for p in ("a", "b", "gone")))
    digests = changes.DigestStore(spark, str(tmp_path / "digests"))
    current = lambda: spark.createDataFrame([("a", "1"), ("b", "2")], "path string, digest string")
    fail = {"b"}

    def handle(work, _):
        return work.select("path", (~F.col("path").isin(*fail) if fail else F.lit(True)).alias("ok"))

    def run():
        query = changes.sync(changes.events(spark, str(tmp_path / "in")), handle, digests, current, str(tmp_path / "ckpt"), str(tmp_path / "failed"))
        query.awaitTermination(120)

    run()
    assert [tuple(r) for r in digests.read().collect()] == [("a", "1")]
    fail.clear()
    (tmp_path / "in/1.json").write_text(json.dumps({"corpus": "c", "path": "a", "kind": "m", "ts": T0.isoformat()}))
    run()
    assert sorted(tuple(r) for r in digests.read().collect()) == [("a", "1"), ("b", "2")]


def test_gates_and_replay(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git/HEAD").write_text("ref: refs/heads/main\n")
    assert changes.branch_allows(str(tmp_path), ["main"]) and not changes.branch_allows(str(tmp_path), ["dev"]) and changes.branch_allows(str(tmp_path), None)
    (tmp_path / ".git/HEAD").write_text("0123abcd\n")
    assert not changes.branch_allows(str(tmp_path), ["main"])
    assert not changes.git_busy(str(tmp_path))
    (tmp_path / ".git/index.lock").write_text("")
    assert changes.git_busy(str(tmp_path))
    rows = spark.createDataFrame([("a", T0), ("b", T0 + dt.timedelta(1)), ("c", None)], "path string, modified timestamp")
    assert sorted(r["path"] for r in changes.replayed(rows, T0 + dt.timedelta(hours=1)).collect()) == ["b", "c"]

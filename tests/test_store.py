import pytest
from pyspark.sql import functions as F

from graphloom.ontology import NODE_PROPERTIES, Ontology, identifier
from graphloom.operators import resolve, search, tools
from graphloom.operators.store import GraphStore
from graphloom.plans import cypher
from graphloom.schema import EDGE, conform

E = "src_label string, src_pk string, edge_type string, dst_label string, dst_pk string, origin string, confidence double"


@pytest.fixture
def store(spark):
    files = spark.createDataFrame([("a.md", "a.md", "h1", "c", "database migration forward only"), ("b.md", "b.md", "h2", "c", "unrelated foo bar text"), ("c.md", "c.md", "h3", "d", "migration of schema with indexes")], "path string, name string, hash string, corpus string, summary string")
    edges = spark.createDataFrame([("File", "a.md", "REFERENCES", "File", "b.md", "inferred", 0.9), ("File", "b.md", "REFERENCES", "File", "c.md", "structural", None), ("File", "c.md", "REFERENCES", "Ticket", "T-1", "inferred", 0.7), ("File", "a.md", "REFERENCES", "File", "a.md", "manual", 1.0)], E)
    tickets = spark.createDataFrame([("T-1", "authentication flow", "open", "c"), ("T-2", "other", "done", "c")], "id string, title string, status string, corpus string")
    s = GraphStore(spark, {"File": files, "Ticket": tickets})
    s.upsert_edges(edges)
    return s


def keys(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_upserts_write_over_and_keep(spark, store):
    store.upsert_nodes("File", spark.createDataFrame([("a.md", "h9", None), ("z.md", "h", "new")], "path string, hash string, summary string"))
    got = {r["path"]: (r["hash"], r["summary"], r["corpus"]) for r in store.nodes("File").collect()}
    assert got["a.md"] == ("h9", "database migration forward only", "c") and got["z.md"] == ("h", "new", None) and len(got) == 4
    rows = spark.createDataFrame([("R", "low", 1), ("R", "high", 2), ("R", None, 3)], "description string, severity string, seq int")
    store.upsert_nodes("Risk", rows, "seq")
    assert keys(store.nodes("Risk"), "description", "severity") == [("R", "high")]
    for bad in ("Nope", "a b"):
        with pytest.raises(ValueError):
            store.upsert_nodes(bad, rows)
    with pytest.raises(ValueError, match="need"):
        store.upsert_nodes("Ticket", rows)


def test_edges_need_both_ends(spark, store):
    lost = spark.createDataFrame([("File", "a.md", "USES", "File", "nobody", "inferred", 0.5)], E)
    store.upsert_edges(lost)
    assert store.edges().count() == 4
    again = spark.createDataFrame([("File", "a.md", "REFERENCES", "File", "b.md", None, 0.95)], E)
    store.upsert_edges(again)
    assert keys(store.edges().where("dst_pk = 'b.md'"), "origin", "confidence") == [("inferred", 0.95)]
    with pytest.raises(ValueError, match="edges need"):
        store.upsert_edges(lost.drop("dst_label"))


def test_deletes(spark, store):
    at = spark.createDataFrame([("File", "a.md")], "label string, pk string")
    store.delete_edges(at, origin="inferred")
    assert store.edges().count() == 3
    with pytest.raises(ValueError, match="origin or"):
        store.delete_edges(at)
    with pytest.raises(ValueError, match="label"):
        store.delete_edges(at.drop("label"), origin="inferred")
    store.detach_delete(spark.createDataFrame([("File", "c.md")], "label string, pk string"))
    assert keys(store.edges(), "src_pk", "dst_pk") == [("a.md", "a.md")]
    store.delete_corpus("c")
    assert store.view().count() == 0


def test_wipes_and_markers(spark, store):
    store.backfill_inferred_at(F.lit("2024-01-01").cast("timestamp"))
    assert keys(store.nodes("File").where("inferred_at IS NOT NULL"), "path") == [("a.md",), ("c.md",)]
    store.wipe("c", "llm")
    assert keys(store.nodes("File").where("summary IS NOT NULL"), "path") == [("c.md",)]
    assert store.edges(origin="inferred").count() == 1
    with pytest.raises(ValueError, match="scope"):
        store.wipe("c", "everything")
    store.clear_units(spark.createDataFrame([("Ticket", "T-1")], "label string, pk string"), both_ways=True)
    assert store.edges(origin="inferred").count() == 0


def test_prune_fragments_stats_and_migrations(spark, store):
    assert keys(store.prune_entities(0), "label", "n") == [("Ticket", 1)]
    store.prune_entities(0, dry_run=False)
    assert keys(store.nodes("Ticket"), "id") == [("T-1",)]
    rows = [("Ticket", "T-1", f"f{i % 14}", i) for i in range(28)]
    store.append_fragments(spark.createDataFrame(rows, "label string, pk string, fragment string, pos int"))
    assert store.nodes("Ticket").first()["description_fragments"] == [f"f{i}" for i in range(12)]
    assert resolve.merge_due(store).first()["description"].startswith("f0; f1")
    store.close_corpus("c")
    assert keys(store.nodes("Corpus"), "name", "node_count", "edge_count") == [("c", 2, 4)]
    assert store.apply_migrations() == [4, 5] and store.apply_migrations() == []
    assert store.duplicate_keys().count() == 0


def test_purge_rewrites_keys(spark):
    files = spark.createDataFrame([("C:\\win\\f.md", "h"), ("stub", None)], "path string, hash string")
    sections = spark.createDataFrame([("C:\\win\\f.md#x", "C:\\win\\f.md"), ("lost#y", None)], "id string, path string")
    s = GraphStore(spark, {"File": files, "Section": sections})
    s.upsert_edges(spark.createDataFrame([("File", "C:\\win\\f.md", "CONTAINS", "Section", "C:\\win\\f.md#x", "structural", None), ("File", "stub", "CONTAINS", "Section", "lost#y", "structural", None)], E))
    s.purge_stubs()
    assert keys(s.nodes("File"), "path") == [("C:/win/f.md",)]
    assert keys(s.edges(), "src_pk", "dst_pk") == [("C:/win/f.md", "C:/win/f.md#x")]


def test_save_and_load(spark, store, tmp_path):
    store.save(str(tmp_path))
    again = GraphStore.load(spark, str(tmp_path), ["File", "Ticket"])
    assert again.nodes("File").count() == 3 and keys(again.edges(), *EDGE.fieldNames()[:5]) == keys(store.edges(), *EDGE.fieldNames()[:5])


def test_tools(store):
    assert [tuple(r) for r in tools.describe_project(store, n=1).select("path", "inbound").collect()] == [("a.md", 1)]
    assert keys(tools.outbound(store, "c.md"), "id", "edge_type") == [("T-1", "REFERENCES")]
    assert [r["path"] or r["id"] for r in tools.related(store, "a.md", 9).collect()] == ["b.md", "c.md", "T-1"]
    assert tools.explain_relationship(store, "T-1", "c.md").first()["outbound"] is False
    assert tools.ticket_dossier(store, "T-2").first()["edge_type"] is None
    for bad in (("Nope", None), ("Ticket", "color"), ("Ticket", "a b")):
        with pytest.raises(ValueError):
            tools.list_entities(store, *bad)
    with pytest.raises(ValueError, match="node or a corpus"):
        tools.check_freshness(store)


def test_search(store, spark):
    got = store.full_text_search("File", "summary", "migration", 5)
    assert [r["pk"] for r in got.collect()] == ["a.md", "c.md"]
    assert store.full_text_search("File", "summary", "", 5).count() == 0
    assert [r["pk"] for r in store.full_text_search("File", "summary", '"migration of" -database', 5).collect()] == ["c.md"]
    vectors = spark.createDataFrame([("a.md", [1.0, 0.0]), ("b.md", [0.0, 1.0]), ("c.md", [0.7071, 0.7071]), ("n", None)], "pk string, embedding array<float>")
    near = search.vector_search(vectors, [1.0, 0.0], 2)
    assert [(r["pk"], round(r["score"], 3)) for r in near.collect()] == [("a.md", 1.0), ("c.md", 0.854)]
    assert search.vector_search(vectors, [1.0, 0.0], 3, 0.9).count() == 1
    for bad in (0, True, 1.5):
        with pytest.raises(ValueError):
            search.vector_search(vectors, [1.0], bad)
    one = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "pk string, rank int")
    two = spark.createDataFrame([("b", 1), ("c", 2)], "pk string, rank int")
    assert [r["pk"] for r in search.fuse(one, two, 9).collect()] == ["b", "a", "c"]

    def fails(_):
        raise ConnectionError

    assert [r["pk"] for r in search.hybrid_search(store, "migration", embed=fails).collect()] == ["a.md", "c.md"]
    assert search.hybrid_search(store, "x", kind="Client").count() == 0
    assert search.hybrid_search(store, "x", config=search.SearchConfig(mode="vector")).count() == 0
    with pytest.raises(ValueError, match="weights"):
        search.SearchConfig(vector_weight=0, fulltext_weight=0)


def test_toolbox(store, tmp_path):
    (tmp_path / "tools/c").mkdir(parents=True)
    (tmp_path / "tools/c/one.cypher").write_text("MATCH (f:File {path: $p}) RETURN f.hash AS h")
    box = tools.Toolbox(store, tools.corpus_tools(str(tmp_path)), translate=lambda q: "Sure:\n```cypher\nMATCH (f:File) RETURN count(f) AS n\n```")
    assert '\\"h\\": \\"h1\\"' in box.call("c.one", p="a.md")
    assert "ValueError" in box.call("c.one") and "KeyError" in box.call("nope")
    assert box.ask("how many?", "c").first()["n"] == 2


def test_cypher(store, spark):
    run = lambda q, **p: [tuple(r) for r in store.exec_read(q, **p).collect()]
    assert run("MATCH (f:File) RETURN f.path AS p ORDER BY p DESC SKIP 1 LIMIT 1") == [("b.md",)]
    assert run("MATCH (a)-[r]->(a) RETURN a.path AS p, type(r) AS t") == [("a.md", "REFERENCES")]
    assert sorted(run("MATCH (a:File)-[*1..2]->(b) RETURN DISTINCT b.path AS p, b.id AS i"), key=repr) == sorted([("b.md", None), ("c.md", None), ("a.md", None), (None, "T-1")], key=repr)
    assert sorted(run("MATCH (f:File) OPTIONAL MATCH (f)-[r:REFERENCES]->(t:Ticket) WITH f, count(r) AS n WHERE n = 0 RETURN collect(f.path) AS ps")[0][0]) == ["a.md", "b.md"]
    assert run("MATCH (t:Ticket) WHERE t.status IN $s AND t.title CONTAINS 'auth' RETURN t.id AS id", s=["open"]) == [("T-1",)]
    assert run("MATCH (f:File) WHERE NOT (f)-[:REFERENCES]->(:File) RETURN f.path AS p") == [("c.md",)]
    assert run("MATCH (a:File)-[r]-(b) WHERE startNode(r) = a RETURN count(*) AS n") == [(4,)]
    assert run("MATCH (f:File) WHERE any(x IN labels(f) WHERE x IN ['File']) AND f.path ENDS WITH '.md' AND f.hash =~ 'h[12]' RETURN count(*) AS n") == [(2,)]
    assert run("UNWIND [1, 2, 3] AS x WITH x WHERE x > 1 RETURN sum(x) AS s, avg(x) AS a") == [(5, 2.5)]
    assert run("MATCH (t:Ticket) RETURN t.status AS s, CASE t.status WHEN 'open' THEN 1 ELSE 0 END AS o ORDER BY s") == [("done", 0), ("open", 1)]
    for bad in ("CREATE (n)", "MATCH (n) SET n.x = 1 RETURN n", "MATCH (n)", "MATCH (n RETURN n", "MATCH (n) RETURN nope(n)", "MATCH (n) RETURN $x", "MATCH (a)-[*1..9]->(b) RETURN a"):
        with pytest.raises(ValueError):
            store.exec_read(bad)
    assert cypher.inject_corpus("MATCH (f:File {name: 'x'})--(g) RETURN f", "c") == "MATCH (f:File {corpus: 'c', name: 'x'})--(g) RETURN f"
    assert cypher.inject_corpus("MATCH (f:File) RETURN f", "c") == "MATCH (f:File {corpus: 'c'}) RETURN f"
    with pytest.raises(ValueError):
        cypher.inject_corpus("MATCH (f:File) RETURN f", "a'b")


def test_ontology(spark):
    o = Ontology.load({"edge_types": {"LIKES": ["File"], "ANY": {"src": [], "dst": ["Ticket"]}}, "node_aliases": {"Doc": "File"}, "edge_aliases": {"loves": "LIKES"}})
    assert o.validate_triple("Doc", "loves", "File") and not o.validate_triple("Ticket", "LIKES", "File") and o.validate_triple("x", "ANY", "Ticket")
    with pytest.raises(ValueError):
        o.validate_edge("File", "nope", "File")
    with pytest.raises(ValueError):
        Ontology().validate_node("File", {"color": 1})
    with pytest.raises(ValueError):
        identifier("a-b")
    assert len(NODE_PROPERTIES) == 14 and Ontology().constraints(spark).count() == 22 and len(Ontology().emittable) == 19


def test_resolution(spark):
    raw = spark.createDataFrame([("0.4",), ("7",), ('"High"',), ('"0.6"',), ("true",), ("NaN",), ('"x"',), (None,), ("-1",)], "c string")
    assert [r[0] for r in raw.select(resolve.confidence(F.col("c"))).collect()] == [0.4, 1.0, 0.9, 0.6, 0.0, 0.0, 0.0, 0.0, 0.0]
    known = spark.createDataFrame([("p#intro", "intro", "Intro"), ("p#11-sub", "11-sub", "1.1 Sub"), ("p#a", "a", "Same"), ("q#a", "a", "Same")], "id string, anchor string, title string")
    refs = spark.createDataFrame([(1, "p#intro"), (2, "z#intro"), (3, "§1.1"), (4, "Same"), (5, "INTRO"), (6, "nothing")], "ref long, target string")
    got = {r["ref"]: (r["pk"], r["rung"]) for r in resolve.resolve_sections(refs, known).collect()}
    assert got == {1: ("p#intro", "exact"), 2: ("p#intro", "fragment"), 3: ("p#11-sub", "number"), 5: ("p#intro", "slug")}
    entities = spark.createDataFrame([("c", "Technology", "PostgreSQL", "PostgreSQL", [1.0, 0.0]), ("c", "Technology", "Redis", "Redis", None)], "corpus string, label string, pk string, name string, embedding array<float>")
    mentions = spark.createDataFrame([("c", "Technology", " postgresql ", 1, None), ("c", "Technology", "PostgresSQL", 2, None), ("c", "Technology", "Elephant", 3, [0.99, 0.05]), ("c", "Technology", "Kafka Streams", 4, None), ("c", "Technology", "kafka streams", 5, None)], "corpus string, label string, name string, seq int, embedding array<float>")
    got = {r["seq"]: (r["pk"], r["rule"].split(":")[0], r["minted"]) for r in resolve.cascade(mentions, entities).collect()}
    assert got == {1: ("PostgreSQL", "exact-norm", False), 2: ("PostgreSQL", "fuzzy", False), 3: ("PostgreSQL", "embedding", False), 4: ("Kafka Streams", "minted", True), 5: ("Kafka Streams", "exact-norm", False)}


def test_cascade_takes_the_corpus_only_after_the_nearest(spark):
    """Entities of another corpus fill the places of the nearest; names that several entities have match none of them."""
    others = [("o", "Technology", f"O{i}", f"O{i}", [1.0, i / 1000]) for i in range(5)]
    entities = spark.createDataFrame([*others, ("c", "Technology", "Mine", "Mine", [1.0, 0.01]), ("c", "Technology", "Ab", "Ab", None), ("c", "Technology", "AB", "AB", None)], "corpus string, label string, pk string, name string, embedding array<float>")
    mentions = spark.createDataFrame([("c", "Technology", "far", 1, [1.0, 0.0]), ("c", "Technology", "near", 2, [1.0, 0.012]), ("c", "Technology", "ab", 3, None), ("c", "Technology", "aB", 4, None)], "corpus string, label string, name string, seq int, embedding array<float>")
    got = {r["seq"]: (r["pk"], r["minted"]) for r in resolve.cascade(mentions, entities).collect()}
    assert got == {1: ("far", True), 2: ("Mine", False), 3: ("ab", True), 4: ("aB", True)}


def test_answers_of_a_model():
    rows = resolve.answer_rows('so: {"relationships": [{"type": "USES", "target_type": "Technology", "target_name": "X", "confidence": "high", "reason": {"a": 1}, "properties": {"version": 2, "bad": {}, "list": ["a", "", 3]},}, 7, {"type": 1}]} done')
    assert rows[0] == {"edge_type": "USES", "target_type": "Technology", "target_name": "X", "confidence": '"high"', "reason": '{"a": 1}', "properties": {"version": ["2"], "list": ["a"]}}
    assert len(rows) == 2 and rows[1]["edge_type"] is None and resolve.answer_rows('{"relationships": 3}') == []
    with pytest.raises(ValueError):
        resolve.answer_rows("nothing")
    one = lambda *names: '{"relationships": [' + ",".join(f'{{"type": "USES", "target_type": "Technology", "target_name": "{n}"}}' for n in names) + "]}"
    answers, asked = [one("a", "b"), one("b ", "c"), one("c"), one("d")], []

    def ask(known):
        asked.append([r["target_name"] for r in known])
        return answers[len(asked) - 1]

    assert [r["target_name"] for r in resolve.gleaned(ask, Ontology(), 3)] == ["a", "b", "c"] and asked == [[], ["a", "b"], ["a", "b", "c"]]
    assert [r["target_name"] for r in resolve.gleaned(lambda known: one("a") if not known else "broken", Ontology(), 2)] == ["a"]


@pytest.mark.parametrize("few", [0, 100_000])
def test_related_exchanges_only_edges_at_its_nodes(spark, monkeypatch, few):
    monkeypatch.setattr(tools, "FEW", few)
    n = spark.range(40)
    name = lambda x: F.concat(F.lit("n"), (x % 40).cast("string"))
    ring = n.select(F.lit("Service").alias("src_label"), name(F.col("id")).alias("src_pk"), F.lit("USES").alias("edge_type"), F.lit("Service").alias("dst_label"), name(F.col("id") + 1).alias("dst_pk"))
    found = tools.related(GraphStore(spark, {"Service": n.select(name(F.col("id")).alias("name"))}, conform(ring, EDGE)), "n0", 3)
    assert [(r["name"], r["depth"]) for r in found.collect()] == [("n1", 1), ("n39", 1), ("n2", 2), ("n38", 2), ("n3", 3), ("n37", 3)]
    # rounds are kept, so one join with the nodes is left, and no plan exchanges all edges
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_graph_inputs_are_dealt_by_size(spark):
    from conftest import SF

    from graphloom.operators.store import dealt
    from graphloom.sources.tables import load

    rows = spark.range(1000)
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert [dealt(rows, rows, "id", x).rdd.getNumPartitions() for x in (size // 10, size // 20, size)] == [10, 20, 4]
    plan = load(spark, SF).degrees()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [l_orderkey") == 1 and plan.count("RepartitionByExpression [o_orderkey") == 1


def test_words_of_many_texts_are_counted_in_parts(spark):
    texts = spark.createDataFrame([(1, "red blue red"), (2, "blue"), (3, None)], "pk long, text string")
    found = search.matched_each(spark.createDataFrame([("q", "red blue")], "left_pk string, text string"), texts, 5)
    assert "RepartitionByExpression [pk" in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["pk"], r["rank"]) for r in found.orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_cascade_sends_each_name_to_python_once(spark, monkeypatch):
    import pandas as pd

    from graphloom.functions.text import normalised
    from graphloom.operators import resolve

    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(names: pd.Series, labels: pd.Series) -> pd.Series:
        seen.add(len(names))
        return pd.Series([None if n is None else normalised(n, x) for n, x in zip(names, labels, strict=True)])

    monkeypatch.setattr(resolve, "norm", counted)
    mentions = spark.range(3000).selectExpr("'c' AS corpus", "'Technology' AS label", "CASE id % 3 WHEN 0 THEN 'Redis' WHEN 1 THEN 'Mint  x' ELSE 'mint X' END AS name", "lpad(id, 6, '0') AS seq", "CAST(NULL AS array<float>) AS embedding")
    known = spark.sql("SELECT 'c' AS corpus, 'Technology' AS label, 'redis' AS pk, 'redis' AS name, CAST(NULL AS array<float>) AS embedding")
    found = {(r["pk"], r["rule"], r["minted"]): r["n"] for r in resolve.cascade(mentions, known).groupBy("pk", "rule", "minted").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert found == {("redis", "exact-norm", False): 1000, ("Mint  x", "minted", True): 1, ("Mint  x", "exact-norm", False): 1999}
    assert seen.value < 300

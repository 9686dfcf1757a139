"""Read-only questions to a graph store; each returns one DataFrame, with ties broken by key."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.ontology import FRESHNESS, NODE_PROPERTIES, identifier
from graphloom.operators.search import full_text_search, hybrid_search
from graphloom.operators.store import GraphStore, shared_folder
from graphloom.schema import shown

CUT = 400


def named(node_id: str, prefix: str = "") -> Column:
    """Nodes whose path, id or name is node_id: a file's path also finds its sections."""
    return (F.col(f"{prefix}path") == node_id) | (F.col(f"{prefix}id") == node_id) | (F.col(f"{prefix}name") == node_id)


def contains(text: Column, topic: str) -> Column:
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(F.lit(topic)))


def _end(view: DataFrame, end: str, label: str, pk: str) -> DataFrame:
    return view.select(*[F.col(c).alias(f"{end}_{c}") for c in view.columns]).withColumnRenamed(f"{end}_label", label).withColumnRenamed(f"{end}_pk", pk)


def describe_project(store: GraphStore, corpus: str | None = None, n: int = 40) -> DataFrame:
    """The n summarised files with the most edges into them."""
    files = store.nodes("File", corpus).where(F.col("summary").isNotNull()).select("path", "name", "summary", "key_points")
    inbound = store.edges().where("dst_label = 'File'").groupBy(F.col("dst_pk").alias("path")).agg(F.count(F.lit(1)).alias("inbound"))
    found = files.join(inbound, "path", "left").withColumn("inbound", F.coalesce("inbound", F.lit(0)).cast("long"))
    return found.orderBy(F.desc("inbound"), "path").limit(n)


def _neighbours(store: GraphStore, node_id: str, anchor: str, other: str) -> DataFrame:
    at = store.view().where(named(node_id)).select(F.col("label").alias(f"{anchor}_label"), F.col("pk").alias(f"{anchor}_pk"))
    edges = store.edges().join(at, [f"{anchor}_label", f"{anchor}_pk"], "left_semi")
    nodes = store.view().select(F.col("label").alias(f"{other}_label"), F.col("pk").alias(f"{other}_pk"), "path", "id", "name")
    return edges.join(nodes, [f"{other}_label", f"{other}_pk"]).select("path", "id", "name", "edge_type")


def inbound(store: GraphStore, node_id: str) -> DataFrame:
    """The source of each edge into the node."""
    return _neighbours(store, node_id, "dst", "src")


def outbound(store: GraphStore, node_id: str) -> DataFrame:
    """The destination of each edge out of the node."""
    return _neighbours(store, node_id, "src", "dst")


#: Nodes up to which a round's nodes are sent to every task: a plan's choice, not a result's.
FEW = 100_000


def related(store: GraphStore, node_id: str, depth: int = 2, limit: int = 50) -> DataFrame:
    """Nodes within 1 to 5 undirected steps, without the anchors: path, id, name, summary, the nearest first, then by key.

    A breadth-first search by joins: each round meets only nodes not met before, so hubs are expanded once. A round's nodes
    are kept and counted, and edges meet them where they are read: only edges at those nodes are exchanged, not all.
    """
    depth = max(1, min(5, depth))
    shared_folder(store.spark)

    def kept(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """df, and how joins see it: sent to every task where it is short."""
        df = df.checkpoint()
        return df, F.broadcast(df) if df.count() <= FEW else df

    edges = store.edges()
    frontier, near = kept(store.view().where(named(node_id)).select("label", "pk", F.lit(0).alias("depth")))
    seen = frontier
    for d in range(1, depth + 1):
        ways = []
        for a, b in (("src", "dst"), ("dst", "src")):
            at = near.select(F.col("label").alias(f"{a}_label"), F.col("pk").alias(f"{a}_pk"))
            ways.append(edges.join(at, [f"{a}_label", f"{a}_pk"], "left_semi").select(F.col(f"{b}_label").alias("label"), F.col(f"{b}_pk").alias("pk")))
        met = ways[0].unionByName(ways[1]).distinct()
        frontier, near = kept(met.join(seen.select("label", "pk"), ["label", "pk"], "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
    _, seen = kept(seen.where("depth > 0"))
    found = seen.join(store.view(), ["label", "pk"])
    return found.groupBy("path", "id", "name", "summary").agg(F.min("depth").alias("depth")).orderBy("depth", "path", "id", "name").limit(limit)


def get_file_summary(store: GraphStore, path: str) -> DataFrame:
    return store.nodes("File").where(F.col("path") == path).select("summary", "key_points")


def section_tree(store: GraphStore, path: str) -> DataFrame:
    """The sections that a file contains, by level and ordinal."""
    inside = store.edges("CONTAINS").where((F.col("src_label") == "File") & (F.col("src_pk") == path)).select(F.col("dst_pk").alias("id"))
    return store.nodes("Section").join(inside, "id", "left_semi").select("id", "title", "level", "ordinal", "summary").orderBy("level", "ordinal", "id")


def get_node(store: GraphStore, node_id: str) -> DataFrame:
    """The first node with that path, id or name: files first, then by label and key."""
    return store.view().where(named(node_id)).orderBy(F.when(F.col("label") == "File", 0).otherwise(1), "label", "pk").limit(1)


def explain_relationship(store: GraphStore, source: str, target: str) -> DataFrame:
    """Every edge between the two, either way, as seen from source."""
    view = store.view()
    at = lambda node_id, end: view.where(named(node_id)).select(F.col("label").alias(f"{end}_label"), F.col("pk").alias(f"{end}_pk"), shown().alias(f"{end}_shown"))
    found = store.undirected().join(at(source, "a"), ["a_label", "a_pk"]).join(at(target, "b"), ["b_label", "b_pk"])
    return found.select(F.col("a_shown").alias("source"), F.col("b_shown").alias("target"), "edge_type", "outbound", "origin", "confidence", "reason")


def ticket_dossier(store: GraphStore, ticket: str) -> DataFrame:
    """One row for each edge at the first ticket with that id or name: ticket_id, edge_type, outbound, and the neighbour."""
    tickets = store.view(["Ticket"]).where((F.col("id") == ticket) | (F.col("name") == ticket)).orderBy("pk").limit(1)
    at = tickets.select(F.col("label").alias("a_label"), F.col("pk").alias("a_pk"), F.col("id").alias("ticket_id"), F.col("title").alias("ticket_title"), F.col("status").alias("ticket_status"))
    far = store.view().select(F.col("label").alias("b_label"), F.col("pk").alias("b_pk"), shown().alias("neighbour"), "summary", "title")
    edges = store.undirected().join(at.select("a_label", "a_pk"), ["a_label", "a_pk"], "left_semi").join(far, ["b_label", "b_pk"])
    edges = edges.select("a_label", "a_pk", "edge_type", "outbound", F.col("b_label").alias("neighbour_label"), "neighbour", "summary", "title")
    return at.join(edges, ["a_label", "a_pk"], "left").drop("a_label", "a_pk")


def find_reusable(store: GraphStore, query: str, limit: int = 20) -> DataFrame:
    """Artifacts marked reusable among the best by description; the mark is looked at after the best are taken."""
    artifacts = store.nodes("Artifact")
    best = full_text_search(artifacts.select(F.col("id").alias("pk"), F.col("description").alias("text")), query, max(limit, 50))
    found = best.join(artifacts.where(F.col("reusable") == True).select(F.col("id").alias("pk"), "title", "description"), "pk")  # noqa: E712
    return found.orderBy(F.desc("score"), "pk").limit(limit)


def list_entities(store: GraphStore, kind: str, prop: str | None = None, value=None, corpus: str | None = None, limit: int = 50) -> DataFrame:
    """Nodes of a label with a property's value; both must be declared."""
    if kind not in NODE_PROPERTIES:
        raise ValueError(f"unknown kind {identifier(kind)!r}")
    found = store.nodes(kind, corpus)
    if prop is not None:
        if identifier(prop) not in NODE_PROPERTIES[kind]:
            raise ValueError(f"{kind} has no property {prop!r}")
        found = found.where(F.col(prop) == F.lit(value))
    keep = [c for c in found.columns if c != "embedding"]
    return found.select(F.lit(kind).alias("label"), *keep).orderBy(*[c for c in ("path", "id", "name", "description") if c in keep]).limit(limit)


def _paired(store: GraphStore, edges: DataFrame) -> DataFrame:
    view = store.view()
    side = lambda end: view.select(F.col("label").alias(f"{end}_label"), F.col("pk").alias(f"{end}_pk"), *[F.col(c).alias(f"{end}_{c}") for c in ("path", "id", "name", "corpus", "summary", "updated")])
    return edges.join(side("src"), ["src_label", "src_pk"]).join(side("dst"), ["dst_label", "dst_pk"])


def check_freshness(store: GraphStore, node_id: str | None = None, corpus: str | None = None, limit: int = 200) -> DataFrame:
    """Edges that say a node is outdated, at a node or, without one, touching a corpus."""
    if node_id is None and corpus is None:
        raise ValueError("name a node or a corpus")
    pairs = _paired(store, store.edges(*FRESHNESS))
    hit = named(node_id, "src_") | named(node_id, "dst_") if node_id is not None else (F.col("src_corpus") == corpus) | (F.col("dst_corpus") == corpus)
    return pairs.where(hit).orderBy("src_pk", "edge_type", "dst_pk").limit(limit).select(shown("src_").alias("source"), "edge_type", shown("dst_").alias("target"), "confidence", "reason")


def find_contradictions(store: GraphStore, topic: str | None = None, limit: int = 50) -> DataFrame:
    pairs = _paired(store, store.edges("CONTRADICTS"))
    if topic:
        pairs = pairs.where(contains(F.col("src_summary"), topic) | contains(F.col("dst_summary"), topic))
    return pairs.orderBy("src_pk", "dst_pk").limit(limit).select(shown("src_").alias("source"), shown("dst_").alias("target"), "confidence", "reason")


def whats_new(store: GraphStore, since: str, corpus: str | None = None, limit: int = 50) -> DataFrame:
    found = store.view().where(F.col("updated") >= F.to_timestamp(F.lit(since)))
    if corpus is not None:
        found = found.where(F.col("corpus") == corpus)
    return found.orderBy(F.desc("updated"), "label", "pk").limit(limit).select("label", shown().alias("node"), "updated")


def timeline_nodes(store: GraphStore, node_id: str | None = None, topic: str | None = None, limit: int = 50) -> DataFrame:
    """Neighbours of a node, or nodes whose summary or title names a topic, by when they last changed."""
    view = store.view()
    if node_id is not None:
        at = view.where(named(node_id)).select(F.col("label").alias("a_label"), F.col("pk").alias("a_pk"))
        near = store.undirected().join(at, ["a_label", "a_pk"], "left_semi").select(F.col("b_label").alias("label"), F.col("b_pk").alias("pk")).distinct()
        found = view.join(near, ["label", "pk"], "left_semi").join(at.select(F.col("a_label").alias("label"), F.col("a_pk").alias("pk")), ["label", "pk"], "left_anti")
    else:
        found = view.where(contains(F.col("summary"), topic or "") | contains(F.col("title"), topic or ""))
    found = found.withColumn("at", F.coalesce("updated", "inferred_at")).where(F.col("at").isNotNull())
    return found.orderBy(F.desc("at"), "label", "pk").limit(limit).select("label", shown().alias("node"), "at")


def timeline_supersedes(store: GraphStore, node_id: str | None = None, topic: str | None = None, limit: int = 50) -> DataFrame:
    pairs = _paired(store, store.edges("SUPERSEDES"))
    if node_id is not None:
        pairs = pairs.where(named(node_id, "src_") | named(node_id, "dst_"))
    elif topic:
        pairs = pairs.where(contains(F.col("src_summary"), topic) | contains(F.col("dst_summary"), topic))
    return pairs.orderBy("src_pk", "dst_pk").limit(limit).select(shown("src_").alias("newer"), shown("dst_").alias("older"))


def grep(texts: DataFrame, pattern: str, limit: int = 100) -> DataFrame:
    """corpus, path, line (from 1) and text (trimmed, cut) of lines that match a regular expression; by corpus, path, line.

    texts: corpus, path, text. The pattern must compile; Java's engine runs it.
    """
    re.compile(pattern)
    lines = texts.select("corpus", "path", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    found = lines.where(F.col("text").rlike(pattern)).orderBy("corpus", "path", "line").limit(limit)
    return found.select("corpus", "path", (F.col("line") + 1).cast("long").alias("line"), F.substring(F.trim("text"), 1, CUT).alias("text"))


def corpus_tools(home: str) -> dict[str, str]:
    """<corpus>.<tool> -> query text of every tools/<corpus>/<tool>.cypher below home; the read-only guard must pass each."""
    from graphloom.plans.cypher import assert_read_only

    found = {}
    for path in sorted(Path(home).glob("tools/*/*.cypher")):
        text = path.read_text(encoding="utf-8")
        assert_read_only(text)
        found[f"{path.parent.name}.{path.stem}"] = text
    return found


def placeholders(query: str) -> set[str]:
    return set(re.findall(r"\$([a-zA-Z_]\w*)", query, re.A))


class Toolbox:
    """The tools by name, with stored queries of corpora, as a server would offer them."""

    def __init__(self, store: GraphStore, stored: dict[str, str] | None = None, embed: Callable | None = None, texts: DataFrame | None = None, translate: Callable[[str], str] | None = None, vectors: DataFrame | None = None):
        self.store, self.stored, self.embed, self.texts, self.translate, self.vectors = store, stored or {}, embed, texts, translate, vectors

    def tools(self) -> dict[str, Callable]:
        s = self.store
        built = {f.__name__: (lambda f: lambda **a: f(s, **a))(f) for f in (describe_project, inbound, outbound, related, get_file_summary, section_tree, get_node, explain_relationship, ticket_dossier, find_reusable, list_entities, check_freshness, find_contradictions, whats_new, timeline_nodes, timeline_supersedes)}
        built["search"] = lambda query, **a: hybrid_search(s, query, embed=self.embed, vectors=self.vectors, **a)
        built["grep_corpus"] = lambda pattern, corpus=None, limit=100: grep(self.texts if corpus is None else self.texts.where(F.col("corpus") == corpus), pattern, limit)
        built["query_graph"] = lambda cypher: s.exec_read(cypher)
        built["ask"] = lambda question, corpus=None: self.ask(question, corpus)
        for name, query in self.stored.items():
            built[name] = (lambda q: lambda **a: self._stored(q, a))(query)
        return built

    def _stored(self, query: str, given: dict) -> DataFrame:
        if missing := placeholders(query) - set(given):
            raise ValueError(f"missing argument {', '.join(sorted(missing))}")
        return self.store.exec_read(query, **given)

    def ask(self, question: str, corpus: str | None = None) -> DataFrame:
        from graphloom.plans.cypher import extract_query, inject_corpus

        if self.translate is None:
            raise ValueError("no translator is set")
        query = extract_query(self.translate(question))
        return self.store.exec_read(inject_corpus(query, corpus) if corpus else query)

    def call(self, name: str, **arguments) -> str:
        """A JSON envelope with the rows, or with the error."""
        try:
            rows = [json.loads(r) for r in self.tools()[name](**arguments).toJSON().collect()]
        except Exception as e:  # noqa: BLE001  a tool's failure is its answer
            rows = {"error": f"{type(e).__name__}: {e}"}
        return json.dumps([{"type": "text", "text": json.dumps(rows, ensure_ascii=False)}], ensure_ascii=False)

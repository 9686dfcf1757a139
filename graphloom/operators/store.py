"""A property graph as DataFrames: one per label, and one of edges. Mutations give the store new DataFrames.

Nothing runs until a result is read. save() and load() keep a store as Parquet, nodes by corpus and edges by type.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.ontology import MINTABLE, NODE_PROPERTIES, ORIGINS, PRIMARY_KEY, identifier
from graphloom.schema import EDGE, EDGE_KEY, VIEW, as_view, canonical_path, columns, conform, node_schema

FRAGMENTS = 12
SCOPES = ("inferred", "summaries", "llm", "all")


@dataclass(frozen=True)
class Capabilities:
    name: str = "spark"
    concurrent_writers: int = 1
    supports_vector: bool = True
    supports_full_text: bool = True
    supports_graph_algorithms: bool = False
    requires_docker: bool = False


def merged(existing: DataFrame, updates: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """existing with each property of updates that is not null written over; new keys are added.

    Where updates name a key several times, the last value that is not null counts, by `order` (a column of updates).
    """
    names = [c for c in updates.columns if c not in keys and c != order]
    if order:
        last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in names]
        updates = updates.groupBy(*keys).agg(*last) if names else updates.select(*keys).distinct()
    new = updates.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in names])
    joined = existing.join(new, keys, "full_outer")
    return joined.select(*[F.coalesce(f"_u_{c}", c).alias(c) if c in names else F.col(c) for c in existing.columns])


def shared_folder(spark: SparkSession) -> None:
    """Let checkpoints go to the folder that the session names; only in local mode is a temporary one made where none is."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if found is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or f"file://{tempfile.mkdtemp(prefix='graphloom-')}")


def dealt(df: DataFrame, source: DataFrame, key: str, each: int = 4 << 20, least: int = 0) -> DataFrame:
    """df in partitions by key: one for each `each` bytes of the source that it is read from, at least one a core and `least`.

    What a task holds then depends neither on the input nor on how a session cuts files or joins small partitions.
    """
    size = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = min(-(-size // each), 10_000) if size < 1 << 44 else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # else a plan that does not know its size
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, least, parts), key)


class GraphStore:
    def __init__(self, spark: SparkSession, nodes: dict[str, DataFrame] | None = None, edges: DataFrame | None = None):
        self.spark = spark
        self._nodes = {k: conform(v, node_schema(k)) for k, v in (nodes or {}).items()}
        self._edges = edges if edges is not None else spark.createDataFrame([], EDGE)
        self.applied: list[int] = []

    # reading

    def nodes(self, label: str, corpus: str | None = None) -> DataFrame:
        if label not in NODE_PROPERTIES:
            raise ValueError(f"unknown label {identifier(label)!r}")
        found = self._nodes[label] if label in self._nodes else self.spark.createDataFrame([], node_schema(label))
        return found if corpus is None else found.where(F.col("corpus") == corpus)

    def view(self, labels: Iterable[str] | None = None) -> DataFrame:
        """All nodes, or those of some labels, in the columns that labels share; vectors are left out."""
        wanted = [x for x in (self._nodes if labels is None else labels) if x in self._nodes]
        frames = [as_view(self._nodes[x], x) for x in wanted]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], VIEW)

    def edges(self, *types: str, origin: str | None = None) -> DataFrame:
        found = self._edges if not types else self._edges.where(F.col("edge_type").isin(*types))
        return found if origin is None else found.where(F.col("origin") == origin)

    def undirected(self, *types: str) -> DataFrame:
        """Each edge from both ends, once for a loop: a_label, a_pk, b_label, b_pk, outbound and the edge's columns."""
        e = self.edges(*types)
        out = e.select("*", F.col("src_label").alias("a_label"), F.col("src_pk").alias("a_pk"), F.col("dst_label").alias("b_label"), F.col("dst_pk").alias("b_pk"), F.lit(True).alias("outbound"))
        back = e.where("NOT (src_label = dst_label AND src_pk = dst_pk)")
        back = back.select("*", F.col("dst_label").alias("a_label"), F.col("dst_pk").alias("a_pk"), F.col("src_label").alias("b_label"), F.col("src_pk").alias("b_pk"), F.lit(False).alias("outbound"))
        return out.unionByName(back)

    def degrees(self) -> DataFrame:
        """label, pk, degree of every node that has an edge; a loop counts once."""
        ends = F.when((F.col("src_label") == F.col("dst_label")) & (F.col("src_pk") == F.col("dst_pk")), F.array(F.struct(F.col("src_label").alias("label"), F.col("src_pk").alias("pk")))).otherwise(
            F.array(F.struct(F.col("src_label").alias("label"), F.col("src_pk").alias("pk")), F.struct(F.col("dst_label").alias("label"), F.col("dst_pk").alias("pk")))
        )
        return self._edges.select(F.explode(ends).alias("e")).groupBy("e.label", "e.pk").agg(F.count(F.lit(1)).alias("degree"))

    def exec_read(self, query: str, **parameters) -> DataFrame:
        from graphloom.plans.cypher import run

        return run(self, query, parameters)

    def vector_search(self, label: str, query: list[float], k: int, threshold: float | None = None, vectors: DataFrame | None = None) -> DataFrame:
        from graphloom.operators.search import vector_search

        key = PRIMARY_KEY[label]
        table = vectors if vectors is not None else self.nodes(label).select(F.col(key).alias("pk"), "embedding")
        return vector_search(table, query, k, threshold)

    def full_text_search(self, label: str, prop: str, query: str, k: int) -> DataFrame:
        from graphloom.operators.search import full_text_search

        return full_text_search(self.nodes(label).select(F.col(PRIMARY_KEY[label]).alias("pk"), F.col(identifier(prop)).alias("text")), query, k)

    def capabilities(self) -> Capabilities:
        return Capabilities()

    # writing

    def _keep(self, label: str, df: DataFrame) -> None:
        self._nodes[label] = conform(df, node_schema(label))

    def upsert_nodes(self, label: str, updates: DataFrame, order: str | None = None) -> None:
        """Merge by key: given properties are written, absent or null ones stay. `order` ranks rows of one key."""
        key = PRIMARY_KEY.get(label)
        if key is None:
            raise ValueError(f"unknown label {identifier(label)!r}")
        if key not in updates.columns:
            raise ValueError(f"{label} rows need {key}")
        known = [c for c in updates.columns if c in columns(label)] + ([order] if order else [])
        self._keep(label, merged(self.nodes(label), updates.where(F.col(key).isNotNull()).select(*known), [key], order))

    def upsert_edges(self, updates: DataFrame, order: str | None = None) -> None:
        """Merge by both ends and type. Edges one of whose ends is no node are left out, as a match would find none."""
        if missing := {"src_label", "dst_label"} - set(updates.columns):
            raise ValueError(f"edges need {', '.join(sorted(missing))}")
        rows = updates
        for end in ("src", "dst"):
            known = self.view().select(F.col("label").alias(f"{end}_label"), F.col("pk").alias(f"{end}_pk"))
            rows = rows.join(known, [f"{end}_label", f"{end}_pk"], "left_semi")
        fields = [c for c in EDGE.fieldNames() if c in rows.columns] + ([order] if order else [])
        self._edges = conform(merged(self._edges, rows.select(*fields), EDGE_KEY, order), EDGE)

    def delete_edges(self, keys: DataFrame, origin: str | None = None, edge_type: str | None = None) -> None:
        """Delete the outgoing edges of the nodes in keys (label, pk) of an origin, a type, or both."""
        if origin is None and edge_type is None:
            raise ValueError("name an origin or an edge type")
        if "label" not in keys.columns:
            raise ValueError("keys need label")
        if origin is not None and origin not in ORIGINS:
            raise ValueError(f"unknown origin {origin!r}")
        hit = F.lit(True)
        if origin is not None:
            hit = hit & (F.col("origin") == origin)
        if edge_type is not None:
            hit = hit & (F.col("edge_type") == identifier(edge_type))
        at = keys.select(F.col("label").alias("src_label"), F.col("pk").alias("src_pk")).distinct().withColumn("_at", F.lit(True))
        self._edges = self._edges.join(at, ["src_label", "src_pk"], "left").where(~(hit & F.coalesce("_at", F.lit(False)))).select(*EDGE.fieldNames())

    def set_properties(self, label: str, where: Column, **values: Column) -> None:
        df = self.nodes(label)
        for name, value in values.items():
            df = df.withColumn(identifier(name), F.when(where, value).otherwise(F.col(name)))
        self._keep(label, df)

    def remove_properties(self, label: str, where: Column, *names: str) -> None:
        self.set_properties(label, where, **{n: F.lit(None) for n in names if n in columns(label)})

    def detach_delete(self, keys: DataFrame) -> None:
        """Delete the nodes in keys (label, pk) with every edge at them."""
        keys = keys.select("label", "pk").distinct()
        for label in list(self._nodes):
            gone = keys.where(F.col("label") == label).select(F.col("pk").alias(PRIMARY_KEY[label]))
            self._keep(label, self._nodes[label].join(gone, PRIMARY_KEY[label], "left_anti"))
        for end in ("src", "dst"):
            gone = keys.select(F.col("label").alias(f"{end}_label"), F.col("pk").alias(f"{end}_pk"))
            self._edges = self._edges.join(gone, [f"{end}_label", f"{end}_pk"], "left_anti")
        self._edges = self._edges.select(*EDGE.fieldNames())

    def corpus_keys(self, corpus: str, labels: Iterable[str] | None = None) -> DataFrame:
        return self.view(labels).where(F.col("corpus") == corpus).select("label", "pk")

    def wipe(self, corpus: str, scope: str) -> None:
        """Remove a layer of one corpus: inferred edges and their markers, summaries, both (llm), or everything."""
        if scope not in SCOPES:
            raise ValueError(f"scope is one of {', '.join(SCOPES)}")
        if scope == "all":
            return self.delete_corpus(corpus)
        mine = F.col("corpus") == corpus
        if scope in ("inferred", "llm"):
            self.delete_edges(self.corpus_keys(corpus), origin="inferred")
            for label in ("File", "Section"):
                self.remove_properties(label, mine, "inferred_at")
        if scope in ("summaries", "llm"):
            for label in ("File", "Section"):
                self.remove_properties(label, mine, "summary", "key_points", "entities_mentioned", "summary_generated_at", "summary_input_hash")
        return None

    def clear_units(self, keys: DataFrame, both_ways: bool = False) -> None:
        """Before a unit is indexed again: its outgoing inferred edges (with both_ways also incoming), marker and summary go."""
        self.delete_edges(keys, origin="inferred")
        if both_ways:
            at = keys.select(F.col("label").alias("dst_label"), F.col("pk").alias("dst_pk")).distinct()
            self._edges = self._edges.where("origin <> 'inferred'").unionByName(self._edges.where("origin = 'inferred'").join(at, ["dst_label", "dst_pk"], "left_anti").select(*EDGE.fieldNames()))
        for label in ("File", "Section"):
            key = PRIMARY_KEY[label]
            at = keys.where(F.col("label") == label).select(F.col("pk").alias(key)).distinct().withColumn("_at", F.lit(True))
            df = self.nodes(label).join(at, key, "left")
            for name in ("inferred_at", "summary", "key_points", "entities_mentioned", "summary_generated_at", "summary_input_hash"):
                df = df.withColumn(name, F.when(F.col("_at").isNull(), F.col(name)))
            self._keep(label, df)

    def delete_corpus(self, corpus: str) -> None:
        keys = self.corpus_keys(corpus, [x for x in self._nodes if x in MINTABLE or x in ("File", "Section")])
        named = self.view(["Corpus"]).where(F.col("name") == corpus).select("label", "pk")
        self.detach_delete(keys.unionByName(named))

    def low_degree(self, at_most: int) -> DataFrame:
        """label, pk, degree of the mintable nodes with at most so many edges."""
        found = self.view([x for x in self._nodes if x in MINTABLE]).select("label", "pk").join(self.degrees(), ["label", "pk"], "left")
        return found.withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long")).where(F.col("degree") <= at_most)

    def prune_entities(self, at_most: int, dry_run: bool = True) -> DataFrame:
        """Nodes to prune per label, most first; they are deleted unless it is a dry run."""
        low = self.low_degree(at_most)
        counts = low.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")
        if not dry_run:
            self.detach_delete(low)
        return counts

    def append_fragments(self, fragments: DataFrame) -> None:
        """Add description fragments (label, pk, fragment, pos) that a node lacks, in order, while it has under twelve."""
        new = fragments.groupBy("label", "pk").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "fragment"))), lambda x: x["fragment"]).alias("_new"))
        for label in [x for x in self._nodes if x in MINTABLE and x != "Risk"]:
            key = PRIMARY_KEY[label]
            joined = self._nodes[label].join(new.where(F.col("label") == label).select(F.col("pk").alias(key), "_new"), key, "left")
            had = F.coalesce("description_fragments", F.array().cast("array<string>"))
            both = F.array_distinct(F.concat(had, "_new"))
            grown = F.slice(both, F.lit(1), F.greatest(F.size(had), F.lit(FRAGMENTS)))
            self._keep(label, joined.withColumn("description_fragments", F.when(F.col("_new").isNull(), F.col("description_fragments")).otherwise(grown)))

    def corpus_stats(self, corpus: str) -> DataFrame:
        """name, node_count (its files), edge_count (of the whole store) and corpus_edge_count (from its nodes)."""
        files = self.nodes("File", corpus).agg(F.count(F.lit(1)).alias("node_count"))
        edges = self._edges.agg(F.count(F.lit(1)).alias("edge_count"))
        mine = self._edges.join(self.corpus_keys(corpus).select(F.col("label").alias("src_label"), F.col("pk").alias("src_pk")), ["src_label", "src_pk"], "left_semi").agg(F.count(F.lit(1)).alias("corpus_edge_count"))
        rows = files.withColumn("name", F.lit(corpus)).join(edges.withColumn("name", F.lit(corpus)), "name").join(mine.withColumn("name", F.lit(corpus)), "name")
        return rows.select("name", "node_count", "edge_count", "corpus_edge_count")

    def close_corpus(self, corpus: str) -> None:
        self.upsert_nodes("Corpus", self.corpus_stats(corpus).drop("corpus_edge_count"))

    def duplicate_keys(self) -> DataFrame:
        """label, pk, n of keys that several nodes share: empty in a sound store."""
        return self.view().groupBy("label", "pk").agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    # migrations

    def backfill_inferred_at(self, now: Column) -> None:
        """Files and sections with an outgoing inferred edge get a marker, unless they have one."""
        sources = self.edges(origin="inferred").select("src_label", "src_pk").distinct()
        for label in ("File", "Section"):
            key = PRIMARY_KEY[label]
            at = sources.where(F.col("src_label") == label).select(F.col("src_pk").alias(key)).withColumn("_at", F.lit(True))
            self._keep(label, self.nodes(label).join(at, key, "left").withColumn("inferred_at", F.coalesce("inferred_at", F.when(F.col("_at"), now))))

    def purge_stubs(self) -> None:
        """Files without a hash and sections without a path go; backslashes in keys and paths become slashes, in edges too."""
        stubs = self.nodes("File").where("hash IS NULL").select(F.lit("File").alias("label"), F.col("path").alias("pk"))
        stubs = stubs.unionByName(self.nodes("Section").where("path IS NULL").select(F.lit("Section").alias("label"), F.col("id").alias("pk")))
        self.detach_delete(stubs)
        self._keep("File", self.nodes("File").withColumn("path", canonical_path(F.col("path"))))
        sections = self.nodes("Section")
        for name in ("id", "path", "file_id"):
            sections = sections.withColumn(name, canonical_path(F.col(name)))
        self._keep("Section", sections)
        for end in ("src", "dst"):
            owned = F.col(f"{end}_label").isin("File", "Section")
            self._edges = self._edges.withColumn(f"{end}_pk", F.when(owned, canonical_path(F.col(f"{end}_pk"))).otherwise(F.col(f"{end}_pk")))

    def apply_migrations(self, steps: dict[int, Callable[[GraphStore], None]] | None = None) -> list[int]:
        """Run the steps that have not been applied, by number; each is recorded once it has succeeded."""
        known: dict[int, Callable[[GraphStore], None]] = {4: lambda s: s.backfill_inferred_at(F.current_timestamp()), 5: lambda s: s.purge_stubs()}
        done = []
        for number, step in sorted((steps or known).items()):
            if number not in self.applied:
                step(self)
                self.applied.append(number)
                done.append(number)
        return done

    # keeping

    def settle(self, *labels: str) -> None:
        """Write the edges and the nodes of some labels (all, unless named) to the shared checkpoint folder, and go on from
        there: plans stay short, and a lost executor costs no rework of earlier phases."""
        shared_folder(self.spark)
        for label in labels or list(self._nodes):
            if label in self._nodes:
                self._nodes[label] = self._nodes[label].checkpoint()
        self._edges = self._edges.checkpoint()

    def save(self, path: str) -> None:
        for label, df in self._nodes.items():
            writer = df.write.mode("overwrite")
            (writer.partitionBy("corpus") if "corpus" in df.columns else writer).parquet(f"{path}/nodes/{label}")
        self._edges.write.mode("overwrite").partitionBy("edge_type").parquet(f"{path}/edges")
        self.spark.createDataFrame([(0, self.applied)], "schema_version int, applied array<int>").write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, labels: Iterable[str]) -> GraphStore:
        store = cls(spark, {x: spark.read.schema(node_schema(x)).parquet(f"{path}/nodes/{x}") for x in labels}, conform(spark.read.schema(EDGE).parquet(f"{path}/edges"), EDGE))
        store.applied = list(spark.read.parquet(f"{path}/meta").first()["applied"])
        return store

"""Indexing a corpus: files to sections to summaries, vectors, references and edges, as batch jobs on a store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import text as T
from graphloom.ontology import MINTABLE, PRIMARY_KEY, Ontology
from graphloom.operators import resolve
from graphloom.operators.store import GraphStore, shared_folder
from graphloom.schema import EDGE, TYPES, columns, conform
from graphloom.sources.corpus import CorpusConfig, by_format, scan


class Provider(Protocol):
    """What a language model and an embedder do for a batch of texts; must be picklable."""

    def summarise(self, texts: list[str]) -> list[str]: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Relater(Provider, Protocol):
    """A provider that also names what a text relates to."""

    def relate(self, text: str, context: str, previous: list[dict]) -> str:
        """JSON with "relationships": a list of type, target_type, target_name, confidence, reason and properties. `previous`
        holds those of earlier rounds on the same text."""
        ...


@dataclass
class Offline:
    """A provider without a network: the first words of a text, and hashed bags of words."""

    words: int = 100
    size: int = 64

    def summarise(self, texts: list[str]) -> list[str]:
        return [" ".join(t.split()[: self.words]) for t in texts]

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [T.bag_vector(t, self.size) for t in texts]


def retried(call: Callable, tries: int = 5, first: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] | None = None):
    """call(), again after a pause that doubles up to `most` and varies by a fifth, while it raises ConnectionError."""
    import random
    import time

    pause = first
    for n in range(tries):
        try:
            return call()
        except ConnectionError:
            if n == tries - 1:
                raise
            (sleep or time.sleep)(pause * random.uniform(0.8, 1.2))
            pause = min(most, 2 * pause)
    return None


def embedded(df: DataFrame, text: str, provider: Provider) -> DataFrame:
    """Adds embedding; texts go to the provider in batches bounded by number and size, a blank one as a space."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        given = [t if t and t.strip() else " " for t in texts]
        return pd.Series([v for part in T.batches(given) for v in retried(lambda part=part: provider.embed(part))])

    return df.withColumn("embedding", embed(text))


def summarised(df: DataFrame, text: str, provider: Provider) -> DataFrame:
    """Adds summary and error: a text that the provider fails on has no summary, and the others are not lost with it."""

    @F.pandas_udf("struct<summary: string, error: string>")
    def summarise(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                out.append((retried(lambda t=t: provider.summarise([t or ""]))[0], None))
            except Exception as e:  # noqa: BLE001  reported in the row
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["summary", "error"])

    return df.withColumn("_s", summarise(text)).select("*", "_s.summary", "_s.error").drop("_s")


# sections


def parse_sections(files: DataFrame, lowest: int = 2, highest: int = 4) -> DataFrame:
    """One row per section of files (path, corpus, text): id, file_id, path, corpus, hash and the parser's columns."""
    rows = files.select("path", "corpus", F.explode(T.sections_udf(lowest, highest)("text")).alias("s")).select("path", "corpus", "s.*")
    return rows.withColumn("id", F.concat("path", F.lit("#"), "anchor")).withColumn("file_id", F.col("path")).withColumn("hash", T.section_hash(F.col("title"), F.col("body")))


def _edge(df: DataFrame, src: tuple[str, Column], kind: str, dst: tuple[str, Column], **more: Column) -> DataFrame:
    return conform(df.select(F.lit(src[0]).alias("src_label"), src[1].alias("src_pk"), F.lit(kind).alias("edge_type"), F.lit(dst[0]).alias("dst_label"), dst[1].alias("dst_pk"), *[c.alias(n) for n, c in more.items()]), EDGE)


def structural_edges(sections: DataFrame) -> DataFrame:
    """CONTAINS from the file, PARENT_OF from the parent, NEXT_SIBLING from the one before it under the same parent."""
    kind = {"origin": F.lit("structural")}
    contains = _edge(sections, ("File", F.col("path")), "CONTAINS", ("Section", F.col("id")), **kind)
    parent = _edge(sections.where("parent_anchor IS NOT NULL"), ("Section", F.concat("path", F.lit("#"), "parent_anchor")), "PARENT_OF", ("Section", F.col("id")), **kind)
    before = F.lag("id").over(Window.partitionBy("path", "parent_anchor").orderBy("pos"))
    sibling = _edge(sections.withColumn("_b", before).where("_b IS NOT NULL"), ("Section", F.col("_b")), "NEXT_SIBLING", ("Section", F.col("id")), **kind)
    return contains.unionByName(parent).unionByName(sibling)


def parent_chains(sections: DataFrame, depth: int = 5) -> DataFrame:
    """sections with chain, the titles of their ancestors, outermost first; a parent that is missing ends it. Headings have six levels."""
    above = sections.select("path", F.col("anchor").alias("_a"), F.col("title").alias("_t"), F.col("parent_anchor").alias("_p"))
    out = sections.withColumn("chain", F.array().cast("array<string>")).withColumn("_at", F.col("parent_anchor"))
    for _ in range(depth):
        out = out.join(above.withColumnRenamed("_a", "_at"), ["path", "_at"], "left")
        out = out.withColumn("chain", F.when(F.col("_t").isNull(), F.col("chain")).otherwise(F.concat(F.array("_t"), "chain"))).drop("_at", "_t").withColumnRenamed("_p", "_at")
    return out.select(*sections.columns, "chain")


def top_level(store: GraphStore) -> DataFrame:
    """Sections that no section is the parent of."""
    children = store.edges("PARENT_OF").where("src_label = 'Section'").select(F.col("dst_pk").alias("id"))
    return store.nodes("Section").join(children, "id", "left_anti")


def leaves(store: GraphStore) -> DataFrame:
    return store.nodes("Section").join(store.edges("PARENT_OF").select(F.col("src_pk").alias("id")), "id", "left_anti")


def rollup_inputs(sections: DataFrame, parents: DataFrame) -> DataFrame:
    """pk, summaries of parents (pk, child: a section's id): their children's summaries by ordinal, without missing ones."""
    rows = parents.join(sections.where("summary IS NOT NULL").select(F.col("id").alias("child"), "ordinal", "summary"), "child")
    return rows.groupBy("pk").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "child", "summary"))), lambda x: x["summary"]).alias("summaries"))


def input_hash(prose: Column, summaries: Column) -> Column:
    return F.md5(F.concat(F.coalesce(prose, F.lit("")), F.lit("\0"), F.array_join(summaries, "\0")))


def roll_up(store: GraphStore, bodies: DataFrame, provider: Provider) -> None:
    """Summaries of parents from their children's and their own prose, deepest level first; unchanged inputs are skipped.

    bodies: id, body. At most six rounds, one per heading level.
    """
    levels = sorted((r["level"] for r in store.nodes("Section").select("level").distinct().collect() if r["level"]), reverse=True)
    for level in levels:  # six at most
        here = store.nodes("Section").where(F.col("level") == level)
        links = store.edges("PARENT_OF").join(here.select(F.col("id").alias("src_pk")), "src_pk", "left_semi").select(F.col("src_pk").alias("pk"), F.col("dst_pk").alias("child"))
        rows = links.select("pk").distinct().join(rollup_inputs(store.nodes("Section"), links), "pk", "left").join(bodies.select(F.col("id").alias("pk"), T.own_prose(F.col("body")).alias("prose")), "pk", "left")
        rows = rows.where((F.size(F.coalesce("summaries", F.array().cast("array<string>"))) > 0) | (F.trim(F.coalesce("prose", F.lit(""))) != ""))
        rows = rows.withColumn("summary_input_hash", input_hash(F.col("prose"), F.coalesce("summaries", F.array().cast("array<string>"))))
        known = here.select(F.col("id").alias("pk"), F.col("summary_input_hash").alias("_had"))
        rows = rows.join(known, "pk").where(~F.col("summary_input_hash").eqNullSafe(F.col("_had")))
        rows = rows.withColumn("_text", F.concat_ws("\n", "prose", F.array_join("summaries", "\n")))
        done = summarised(rows, "_text", provider).where("summary IS NOT NULL").select(F.col("pk").alias("id"), "summary", "summary_input_hash")
        if done.isEmpty():
            continue
        store.upsert_nodes("Section", embedded(done, "summary", provider).withColumn("summary_generated_at", F.current_timestamp()))
        store.settle("Section")


def derive_files(store: GraphStore, provider: Provider) -> None:
    """A file's summary and vector from those of its top-level sections; unchanged inputs are skipped."""
    links = store.edges("CONTAINS").join(top_level(store).select(F.col("id").alias("dst_pk")), "dst_pk", "left_semi").select(F.col("src_pk").alias("pk"), F.col("dst_pk").alias("child"))
    rows = rollup_inputs(store.nodes("Section"), links).withColumn("summary_input_hash", input_hash(F.lit(""), F.col("summaries")))
    known = store.nodes("File").select(F.col("path").alias("pk"), F.col("summary_input_hash").alias("_had"))
    rows = rows.join(known, "pk").where(~F.col("summary_input_hash").eqNullSafe(F.col("_had"))).withColumn("_text", F.array_join("summaries", "\n"))
    done = summarised(rows, "_text", provider).where("summary IS NOT NULL").select(F.col("pk").alias("path"), "summary", "summary_input_hash")
    store.upsert_nodes("File", embedded(done, "summary", provider).withColumn("summary_generated_at", F.current_timestamp()))


# relating


def _marked(kind: list[Column], rule: Column) -> Callable[[Column], Column]:
    return lambda x: F.struct(*kind, x.alias("target_name"), rule)


def lexical_rows(units: DataFrame, ontology: Ontology, patterns: list[dict] | None = None) -> DataFrame:
    """src_label, src_pk, pos, edge_type, target_type, target_name and rule of the references in units (label, pk, path,
    suffix, text): the format's own, then those of a corpus's patterns.

    A pattern has regex, edge_type, target_type, and may have capture (a group, 0 unless given) and formats (suffixes
    without a dot, all unless given). Of equal references of a unit the first stands; aliases are resolved.
    """
    found = T.references(F.col("text"), F.col("path"), F.col("suffix"))
    for p in patterns or []:
        kind = [F.lit(v).alias(n) for n, v in (("edge_type", p["edge_type"]), ("target_type", p["target_type"]))]
        rule = F.lit(f"pattern:{p['regex']}").alias("rule")
        values = T.custom_references(F.coalesce("text", F.lit("")), p["regex"], int(p.get("capture", 0)))
        if p.get("formats"):
            values = F.when(F.ltrim(F.coalesce("suffix", F.lit("")), F.lit(".")).isin(*p["formats"]), values).otherwise(F.array().cast("array<string>"))
        found = F.concat(found, F.transform(values, _marked(kind, rule)))
    rows = units.select(F.col("label").alias("src_label"), F.col("pk").alias("src_pk"), F.posexplode(found).alias("pos", "r")).select("src_label", "src_pk", "pos", "r.*")
    rows = rows.withColumn("edge_type", ontology.resolved(F.col("edge_type"), edges=True)).withColumn("target_type", ontology.resolved(F.col("target_type")))
    return rows.groupBy("src_label", "src_pk", "edge_type", "target_type", "target_name").agg(F.min(F.struct("pos", "rule")).alias("f")).select("src_label", "src_pk", "f.pos", "edge_type", "target_type", "target_name", "f.rule")


def inferred_rows(units: DataFrame, provider: Relater, ontology: Ontology, rounds: int = 0) -> DataFrame:
    """label, pk, rows and error: what the provider finds in units (label, pk, text, context), and in `rounds` further calls
    that look for what was missed. A unit whose first call fails has an error and no rows."""

    @F.pandas_udf(f"struct<rows: {resolve.ROWS}, error: string>")
    def ask(texts: pd.Series, contexts: pd.Series) -> pd.DataFrame:
        out = []
        for text, context in zip(texts, contexts, strict=True):
            try:
                out.append((resolve.gleaned(lambda known, t=text, c=context: retried(lambda: provider.relate(t or "", c or "", known)), ontology, rounds), None))
            except Exception as e:  # noqa: BLE001  reported in the row
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["rows", "error"])

    return units.select("label", "pk", ask("text", "context").alias("a")).select("label", "pk", "a.rows", "a.error")


def _typed(label: str, name: str) -> Column:
    """One property of a map of texts in its column's type; several texts of a plain property are joined by a comma."""
    given, kind = F.try_element_at("properties", F.lit(name)), TYPES.get(name, "string")
    if kind == "array<string>":
        return given
    text = F.array_join(given, ", ")
    return text if kind == "string" else text.try_cast(kind)


def resolved(store: GraphStore, rows: DataFrame, ontology: Ontology, provider: Provider | None = None, limits: resolve.Thresholds | None = None) -> DataFrame:
    """Rows of references with drop_reason, and for those that stand pk, rung or rule, minted and name_norm of their target.

    Rows: src_label, src_pk, corpus, edge_type, target_type, target_name, confidence, method, pos. Files and sections are
    looked up and never made; entities go through the cascade, with vectors of their names if there is a provider.
    """
    limits = limits or resolve.Thresholds()
    order = F.concat_ws("\0", F.col("src_pk"), F.col("src_label"), F.when(F.col("method") == "lexical", "0").otherwise("1"), F.lpad(F.col("pos").cast("string"), 9, "0"))
    rows = resolve.gated(resolve.validated(rows, ontology), ontology, limits.confidence).withColumn("seq", order).checkpoint()  # read by every ladder below
    live = rows.where("drop_reason IS NULL")
    files = resolve.resolve_files(live.where("target_type = 'File'").select(F.col("seq").alias("ref"), F.col("target_name").alias("target")), store.nodes("File").select("path", "name", "hash"))
    parts = resolve.resolve_sections(live.where("target_type = 'Section'").select(F.col("seq").alias("ref"), F.col("target_name").alias("target")), store.nodes("Section").select("id", "anchor", "title"))
    known = files.unionByName(parts).select(F.col("ref").alias("seq"), "pk", F.col("rung").alias("rule"), F.lit(False).alias("minted"), F.lit(None).cast("string").alias("name_norm"), F.lit(None).cast("array<float>").alias("vector"))
    named = live.where(F.col("target_type").isin(*sorted(MINTABLE))).select("corpus", F.col("target_type").alias("label"), F.col("target_name").alias("name"), "seq")
    met = sorted(r["label"] for r in named.select("label").distinct().collect())  # as many as the ontology has
    if met:
        entities = [store.nodes(x).select("corpus", F.lit(x).alias("label"), F.col(PRIMARY_KEY[x]).alias("pk"), F.col(PRIMARY_KEY[x]).alias("name"), "embedding") for x in met]
        if provider is None:
            mentions = named.withColumn("embedding", F.lit(None).cast("array<float>"))
        else:
            mentions = named.join(embedded(named.select("name").distinct(), "name", provider), "name")
        out = resolve.cascade(mentions, reduce(DataFrame.unionByName, entities), limits).join(mentions.select("seq", F.col("embedding").alias("vector")), "seq")
        known = known.unionByName(out.select("seq", "pk", "rule", "minted", "name_norm", "vector"))
    rows = rows.join(known, "seq", "left")
    owned = F.col("target_type").isin("File", "Section")
    why = F.when(F.col("pk").isNull(), "target is unknown").when(owned & (F.col("pk") == F.col("src_pk")) & (F.col("target_type") == F.col("src_label")), "target is the source")
    return resolve.covered(rows.withColumn("drop_reason", F.coalesce("drop_reason", why)))


def relate(store: GraphStore, units: DataFrame, ontology: Ontology, inferred: DataFrame | None = None, provider: Provider | None = None, patterns: list[dict] | None = None, limits: resolve.Thresholds | None = None) -> DataFrame:
    """Edges from units (label, pk, path, suffix, corpus, text) to what their texts refer to, replacing those inferred before.

    Lexical references come from the text; `inferred` adds what a model found: label, pk, rows and error, as inferred_rows()
    gives them. Units with an error keep their edges and get no marker; all others get one, also without edges. Targets that
    are files or sections must be known; entities are matched or minted. A minted entity gets its normalised name, vector
    and properties; a matched one the properties too, but its description as a fragment. Of several values of a property
    the last stands. Gives all rows with drop_reason.
    """
    shared_folder(store.spark)
    if inferred is not None:
        inferred = inferred.checkpoint()  # a model is asked once
        units = units.join(inferred.where("error IS NOT NULL").select("label", "pk"), ["label", "pk"], "left_anti")
    none = F.create_map().cast("map<string, array<string>>")
    rows = lexical_rows(units, ontology, patterns).select("src_label", "src_pk", "edge_type", "target_type", "target_name", F.lit(1.0).alias("confidence"), F.concat(F.lit("lexical:"), "rule").alias("reason"), F.lit("lexical").alias("method"), "pos", none.alias("properties"))
    if inferred is not None:
        model = inferred.where("error IS NULL").select(F.col("label").alias("src_label"), F.col("pk").alias("src_pk"), F.posexplode("rows").alias("pos", "r")).select("src_label", "src_pk", "pos", "r.*")
        model = model.withColumn("properties", resolve.whitelisted(F.col("properties"), ontology.resolved(F.col("target_type")), ontology))
        model = model.withColumn("confidence", resolve.confidence(F.col("confidence"))).withColumn("reason", resolve.reason(F.col("reason"))).withColumn("method", F.lit("llm"))
        rows = rows.unionByName(model)
    rows = rows.join(units.select(F.col("label").alias("src_label"), F.col("pk").alias("src_pk"), "corpus"), ["src_label", "src_pk"])
    rows = resolved(store, rows, ontology, provider, limits).checkpoint()  # read once for every label below
    live = rows.where("drop_reason IS NULL")
    kept = live.select("src_label", "src_pk", "edge_type", F.col("target_type").alias("dst_label"), F.col("pk").alias("dst_pk"), F.lit("inferred").alias("origin"), "confidence", "reason", "method", "pos")
    keys = units.select("label", "pk").distinct()
    store.delete_edges(keys, origin="inferred")
    met = {r["target_type"] for r in live.select("target_type").distinct().collect()}
    for label in sorted(MINTABLE & met):
        key = PRIMARY_KEY[label]
        names = [x for x in ontology.content_properties(label) if x != key and x in columns(label)]
        mine = live.where(F.col("target_type") == label)
        values = {x: _typed(label, x) for x in names}
        if "description" in values:
            values["description"] = F.when(F.col("minted"), values["description"])
        new = mine.select(F.col("pk").alias(key), "corpus", "seq", F.when(F.col("minted"), F.col("name_norm")).alias("name_norm"), F.when(F.col("minted"), F.col("vector")).alias("embedding"), *[c.alias(x) for x, c in values.items()])
        store.upsert_nodes(label, new, order="seq")
        if "description" in values:
            pieces = mine.where("NOT minted").select(F.lit(label).alias("label"), "pk", _typed(label, "description").alias("fragment"), F.col("seq").alias("pos"))
            store.append_fragments(pieces.where("fragment <> ''"))
    store.upsert_edges(resolve.first_of_triples(kept).drop("pos"))
    for label, key in (("File", "path"), ("Section", "id")):
        store.upsert_nodes(label, keys.where(F.col("label") == label).select(F.col("pk").alias(key)).withColumn("inferred_at", F.current_timestamp()))
    return rows


# differences


def stale_sections(stored: DataFrame, files: DataFrame, parts: DataFrame) -> DataFrame:
    """Stored sections (id, path) of files (path) that their new sections, parts (id), no longer have."""
    return stored.join(files.select("path"), "path", "left_semi").join(parts.select("id"), "id", "left_anti")


def due_sections(stored: DataFrame, parts: DataFrame) -> DataFrame:
    """id and action, added or changed, of the sections in parts (id, hash) that are new or whose hash is another than stored."""
    return triage(stored.join(parts.select("id"), "id", "left_semi"), parts, "id", "hash").where("action IN ('added', 'changed')")


def triage(stored: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """key and action of every unit in either: added, changed, removed or unchanged; a unit without a digest is changed."""
    both = stored.select(key, F.col(digest).alias("_was"), F.lit(True).alias("_s")).join(current.select(key, F.col(digest).alias("_is"), F.lit(True).alias("_c")), key, "full_outer")
    same = F.col("_was").isNotNull() & (F.col("_was") == F.col("_is"))
    return both.select(key, F.when(F.col("_s").isNull(), "added").when(F.col("_c").isNull(), "removed").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("changed").alias("action"))


def file_actions(changes: DataFrame) -> DataFrame:
    """Counts of each action."""
    return changes.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Result:
    indexed: int
    deleted: int
    skipped: int


class Indexer:
    """Keeps a store in step with a corpus: whole at first, then by differences of digests."""

    def __init__(self, store: GraphStore, config: CorpusConfig, provider: Provider | None = None, ontology: Ontology | None = None, gleaning_rounds: int = 0):
        self.store, self.config, self.gleaning_rounds = store, config, gleaning_rounds
        self.provider = provider or Offline()
        self.ontology = ontology or Ontology(node_aliases=config.node_aliases)

    def _relate(self, units: DataFrame) -> DataFrame:
        """Relate units (label, pk, path, suffix, corpus, title, text), by the model too if the provider can."""
        inferred = None
        if hasattr(self.provider, "relate"):
            context = resolve.contexts(self.store, units.drop("text", "suffix"))
            inferred = inferred_rows(units.join(context, ["label", "pk"]), self.provider, self.ontology, self.gleaning_rounds)
        return relate(self.store, units.drop("title"), self.ontology, inferred, self.provider if inferred is not None else None, self.config.patterns)

    def index(self, files: DataFrame) -> None:
        """Nodes, structural edges, summaries, vectors and references of files (as scan() gives them)."""
        store, c = self.store, self.config
        split = c.granularity == "section"
        marked, others = by_format(files) if split else (files.limit(0), files)
        whole = others.select(F.lit("File").alias("label"), F.col("path").alias("pk"), "path", F.col("type").alias("suffix"), "corpus", F.col("name").alias("title"), "text")
        nodes = files.select("path", "name", "type", "hash", "size", "corpus").withColumn("updated", F.current_timestamp())
        store.upsert_nodes("File", nodes)
        store.settle("File")
        plain = embedded(summarised(others, "text", self.provider), "text", self.provider).select("path", "summary", "embedding")
        store.upsert_nodes("File", plain)
        units = whole
        if split:
            parts = parse_sections(marked, c.heading_min_level, c.heading_max_level).checkpoint()
            # a section whose text changed loses its summary, its marker and the edges inferred from it; others keep theirs
            due = due_sections(store.nodes("Section"), parts).checkpoint()
            store.clear_units(due.where("action = 'changed'").select(F.lit("Section").alias("label"), F.col("id").alias("pk")))
            placed = parts.select("id", "file_id", "path", "corpus", "title", "level", "anchor", "ordinal", "parent_anchor", "hash")
            new = embedded(parts.join(due.select("id"), "id", "left_semi"), "body", self.provider).select("id", "embedding").withColumn("updated", F.current_timestamp())
            store.upsert_nodes("Section", placed)
            store.upsert_nodes("Section", new)
            stale = stale_sections(store.nodes("Section"), marked, parts)
            store.detach_delete(stale.select(F.lit("Section").alias("label"), F.col("id").alias("pk")))
            store.settle("Section")
            store.upsert_edges(structural_edges(parts))
            store.settle("File")
            pending = parts.join(leaves(store).where("summary IS NULL").select("id"), "id", "left_semi")
            store.upsert_nodes("Section", summarised(pending, "body", self.provider).select("id", "summary").where("summary IS NOT NULL"))
            store.settle("Section")
            roll_up(store, parts.select("id", "body"), self.provider)
            derive_files(store, self.provider)
            store.settle("File", "Section")
            new = parts.join(due.select("id"), "id", "left_semi")
            units = units.unionByName(new.select(F.lit("Section").alias("label"), F.col("id").alias("pk"), "path", F.lit(".md").alias("suffix"), "corpus", "title", F.col("body").alias("text")))
        self._relate(units)
        store.settle()
        for label in sorted(MINTABLE & set(store._nodes) - {"Risk"}):
            due = resolve.merge_due(store).where(F.col("label") == label)
            store.upsert_nodes(label, due.select(F.col("pk").alias(PRIMARY_KEY[label]), "description", "description_fragments"))
        store.close_corpus(c.name)
        store.settle()

    def bootstrap(self) -> Result:
        self.store.settle()
        files = scan(self.store.spark, self.config).checkpoint()
        self.index(files)
        return Result(files.count(), 0, 0)

    def changes(self, files: DataFrame) -> DataFrame:
        return triage(self.store.nodes("File", self.config.name), files, "path", "hash")

    def increment(self) -> Result:
        """Index what is new or changed, delete what is gone, leave the rest; empty files are left as they are."""
        self.store.settle()
        files = scan(self.store.spark, self.config).checkpoint()
        actions = self.changes(files).checkpoint()
        counts = {r["action"]: r["n"] for r in file_actions(actions).collect()}
        gone = actions.where("action = 'removed'").select("path")
        parts = self.store.nodes("Section").join(gone, "path", "left_semi").select(F.lit("Section").alias("label"), F.col("id").alias("pk"))
        self.store.detach_delete(gone.select(F.lit("File").alias("label"), F.col("path").alias("pk")).unionByName(parts))
        due = files.where("size > 0").join(actions.where("action IN ('added', 'changed')").select("path"), "path", "left_semi")
        n = due.count()
        if n:
            self.store.clear_units(due.select(F.lit("File").alias("label"), F.col("path").alias("pk")))
            self.index(due)
        return Result(n, counts.get("removed", 0), counts.get("unchanged", 0) + counts.get("added", 0) + counts.get("changed", 0) - n)

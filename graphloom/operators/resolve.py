"""From candidate references to edges: validation, coercion, and resolution of targets to known nodes."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.similarity import best_match
from graphloom.functions.text import norm, slug, tolerant_json
from graphloom.ontology import MINTABLE, PRIMARY_KEY, TARGETS, Ontology
from graphloom.operators.search import fuse_each, matched_each, similar_pairs
from graphloom.schema import canonical_path

REASON = 500
#: What a model's answer says, as columns.
ROWS = "array<struct<edge_type: string, target_type: string, target_name: string, confidence: string, reason: string, properties: map<string, array<string>>>>"
#: Words that stand for a confidence.
WORDS = {"high": 0.9, "medium": 0.7, "low": 0.5}


@dataclass(frozen=True)
class Thresholds:
    confidence: float = 0.5
    fuzzy: float = 90.0
    fuzzy_cutoff: float = 80.0
    fuzzy_length: int = 6
    embedding: float = 0.92
    neighbours: int = 5


def confidence(raw: Column) -> Column:
    """A JSON value's text as a number in 0 to 1: numbers and numeric strings are clamped, three words have values,
    and everything else, also true, false and NaN, is 0."""
    bare = F.lower(F.trim(F.regexp_replace(raw, '^"|"$', "")))
    number = F.when(bare.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)(e[-+]?\d+)?$"), bare.try_cast("double"))
    out = F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
    for word, value in WORDS.items():
        out = out.when(bare == word, F.lit(value))
    return F.coalesce(out, F.lit(0.0))


def reason(raw: Column) -> Column:
    return F.substring(F.coalesce(raw.cast("string"), F.lit("")), 1, REASON)


def _texts(value) -> list[str] | None:
    """A property's value as texts: a list's texts, or one of a text, number or truth value; None for all else."""
    if isinstance(value, list):
        return [x for x in value if isinstance(x, str) and x] or None
    if isinstance(value, (bool, int, float)):
        return [json.dumps(value)]
    return [value] if isinstance(value, str) and value else None


def answer_rows(answer: str) -> list[dict]:
    """The relationships of a model's answer in its order, confidence as JSON; a type or name that is no text is None, and what is no object is
    left out. ValueError without a JSON object."""
    found = tolerant_json(answer or "").get("relationships")
    text = lambda x: x if isinstance(x, str) else None
    out = []
    for row in found if isinstance(found, list) else []:
        if isinstance(row, dict):
            why, given = row.get("reason", ""), row.get("properties")
            values = {k: _texts(v) for k, v in given.items()} if isinstance(given, dict) else {}
            out.append({
                "edge_type": text(row.get("type")), "target_type": text(row.get("target_type")), "target_name": text(row.get("target_name")), "confidence": json.dumps(row.get("confidence", 0)),
                "reason": why if isinstance(why, str) else "" if why is None else json.dumps(why), "properties": {k: v for k, v in values.items() if v},
            })
    return out


def gleaned(ask: Callable[[list[dict]], str], ontology: Ontology, rounds: int = 0) -> list[dict]:
    """Rows of ask([]), then of up to `rounds` further calls that are given the sound rows so far; only new ones of these
    count, by type, target type and trimmed name. A round without any, or that fails, is the last."""
    key = lambda r: (ontology.edge_type(r["edge_type"]), ontology.label(r["target_type"]), r["target_name"].strip())
    sound = lambda r: all(r[k] for k in ("edge_type", "target_type", "target_name")) and key(r)[0] in ontology.emittable and key(r)[1] in TARGETS
    rows = answer_rows(ask([]))
    seen = {key(r) for r in rows if sound(r)}
    for _ in range(rounds):
        try:
            more = answer_rows(ask([r for r in rows if sound(r)]))
        except Exception:  # noqa: BLE001  what earlier rounds found stands
            break
        fresh = [r for r in more if sound(r) and key(r) not in seen]
        if not fresh:
            break
        rows += fresh
        seen |= {key(r) for r in fresh}
    return rows


def whitelisted(properties: Column, label: Column, ontology: Ontology) -> Column:
    """A map of property names to texts with only those that inference may write on nodes of the label."""
    table = F.create_map(*[F.lit(x) for name in sorted(ontology.nodes) for x in (name, ",".join(ontology.content_properties(name)))])
    allowed = F.split(F.coalesce(F.try_element_at(table, label), F.lit("")), ",")
    return F.map_filter(properties, lambda k, v: F.array_contains(allowed, k) & (F.size(v) > 0))


def validated(rows: DataFrame, ontology: Ontology) -> DataFrame:
    """Adds drop_reason to rows of edge_type, target_type, target_name, null where a row may stand; aliases are resolved."""
    edge, target = ontology.resolved(F.col("edge_type"), edges=True), ontology.resolved(F.col("target_type"))
    why = F.when(F.col("edge_type").isNull(), "edge type is no text").when(~edge.isin(*sorted(ontology.emittable)), "edge type cannot be written")
    why = why.when(F.col("target_type").isNull(), "target type is no text").when(~target.isin(*sorted(TARGETS)), "target cannot be referred to")
    why = why.when(F.col("target_name").isNull() | (F.trim("target_name") == ""), "target has no name")
    return rows.withColumn("drop_reason", why).withColumn("edge_type", edge).withColumn("target_type", target)


def gated(rows: DataFrame, ontology: Ontology, floor: float = 0.5) -> DataFrame:
    """Adds drop_reason for low confidence, system labels and triples that are not allowed; earlier reasons stay."""
    checked = ontology.allowed(rows.withColumn("dst_label", F.col("target_type")))
    why = F.when(F.col("confidence") < floor, "low confidence").when(F.col("target_type").isin("Corpus", "Meta"), "system label").when(~F.col("allowed"), "triple is not allowed")
    return checked.withColumn("drop_reason", F.coalesce("drop_reason", why)).drop("allowed", "dst_label")


def _unique(refs: DataFrame, known: DataFrame, on: Column, rung: str) -> DataFrame:
    """ref and pk where exactly one node fits."""
    met = refs.join(known, on).groupBy("ref").agg(F.countDistinct("pk").alias("n"), F.min("pk").alias("pk"))
    return met.where("n = 1").select("ref", "pk", F.lit(rung).alias("rung"))


def resolve_files(refs: DataFrame, files: DataFrame) -> DataFrame:
    """ref, pk, rung for references (ref, target) to files (path, name, hash): by path, else by an unambiguous name."""
    refs = refs.withColumn("target", canonical_path(F.col("target")))
    exact = refs.join(files.select(F.col("path").alias("pk")), F.col("target") == F.col("pk")).select("ref", "pk", F.lit("exact").alias("rung")).dropDuplicates(["ref"])
    rest = refs.join(exact, "ref", "left_anti").withColumn("_name", F.element_at(F.split("target", "/"), -1))
    named = files.where("hash IS NOT NULL").select(F.col("path").alias("pk"), "name")
    return exact.unionByName(_unique(rest, named, F.col("_name") == F.col("name"), "name"))


def resolve_sections(refs: DataFrame, known: DataFrame) -> DataFrame:
    """ref, pk, rung for references (ref, target) to sections (id, anchor, title): by id, anchor of a fragment, slug,
    title without case, or number; each rung but the first only where one section fits, and each takes what is left."""
    refs = refs.withColumn("target", canonical_path(F.col("target")))
    table = known.select(F.col("id").alias("pk"), "anchor", "title").withColumn("_t", F.lower("title"))
    exact = refs.join(table.select("pk"), F.col("target") == F.col("pk")).select("ref", "pk", F.lit("exact").alias("rung")).dropDuplicates(["ref"])
    out, rest = exact, refs.join(exact, "ref", "left_anti")
    rest = rest.withColumn("bare", F.trim(F.regexp_replace("target", "^§", "")))
    # a numbered title starts with its number, after a paragraph sign or not; joined by that first word
    numbered = table.withColumn("_n", F.regexp_extract("title", r"^§?(\d+(?:\.\d+)*)(?: |$)", 1)).where("_n <> ''")
    rungs = [
        ("fragment", table, F.when(F.instr("bare", "#") > 0, F.substring_index("bare", "#", -1)), F.col("anchor")),
        ("slug", table, slug(F.col("bare")), F.col("anchor")),
        ("title", table, F.lower("bare"), F.col("_t")),
        ("number", numbered, F.when(F.col("bare").rlike(r"^\d+(\.\d+)*$"), F.col("bare")), F.col("_n")),
    ]
    for rung, there, mine, theirs in rungs:
        found = _unique(rest.withColumn("_k", mine).where("_k IS NOT NULL"), there, F.col("_k") == theirs, rung)
        out, rest = out.unionByName(found), rest.join(found, "ref", "left_anti")
    return out


def name_map(known: DataFrame) -> DataFrame:
    """corpus, label, name_norm, pk of entities (corpus, label, pk, name_norm); pk is null where a name is ambiguous."""
    each = known.groupBy("corpus", "label", "name_norm").agg(F.countDistinct("pk").alias("n"), F.min("pk").alias("pk"))
    return each.select("corpus", "label", "name_norm", F.when(F.col("n") == 1, F.col("pk")).alias("pk"))


def resolve_exact(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """Adds pk to mentions (corpus, label, name_norm) with one known entity of that name."""
    return mentions.join(name_map(known), ["corpus", "label", "name_norm"], "left")


def _nearest(heads: DataFrame, known: DataFrame, limits: Thresholds) -> DataFrame:
    """corpus, label, name_norm, near: the nearest known entities of each head's label, of whatever corpus, best first, as JSON.

    Entities of other corpora take places among the nearest, as they would in one index over all corpora.
    """
    out = heads.select("corpus", "label", "name_norm").limit(0).withColumn("near", F.lit("[]"))
    asked = heads.where(F.size("embedding") > 0)
    for label in sorted(r["label"] for r in asked.select("label").distinct().collect()):  # as many as the ontology has
        there = known.where((F.col("label") == label) & (F.size("embedding") > 0)).select(F.to_json(F.struct("corpus", "pk"), {"ignoreNullFields": "false"}).alias("pk"), "embedding")
        mine = asked.where(F.col("label") == label).select(F.to_json(F.struct("corpus", "name_norm")).alias("pk"), "embedding")
        pairs = similar_pairs(mine, there, limits.neighbours).withColumn("k", F.from_json("pk", "corpus string, pk string")).withColumn("q", F.from_json("left_pk", "corpus string, name_norm string"))
        found = pairs.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "k"))).alias("n"))
        out = out.unionByName(found.select("q.corpus", F.lit(label).alias("label"), "q.name_norm", F.to_json(F.transform("n", lambda x: F.struct(x["score"].alias("score"), x["k"]["corpus"].alias("corpus"), x["k"]["pk"].alias("pk")))).alias("near")))
    return out


def cascade(mentions: DataFrame, known: DataFrame, limits: Thresholds | None = None) -> DataFrame:
    """Resolve mentions (corpus, label, name, seq, embedding) to entities (corpus, label, pk, name, embedding) or mint them.

    In the order of seq within a corpus and label: the one known entity of that normalised name; else the most alike
    name at `fuzzy` or more; else the first of the nearest vectors that is of the corpus, at `embedding` or more; else the
    mention becomes an entity that later ones can match. Distinct names are resolved once: a mention equal to an earlier
    one of its corpus and label shares its outcome, and matches what that one minted. A name that several known entities
    have matches none of them: each such mention is minted under its own spelling. Gives corpus, label, seq, name_norm, pk,
    rule and minted.
    """
    import numpy as np

    limits = limits or Thresholds()
    # Python gets distinct names, not mentions; a null name matches nothing. Were it deterministic, Spark would push the joins'
    # tests, with the Python function in them, down to all mentions
    once = F.pandas_udf(norm.func, "string").asNondeterministic()
    named = mentions.select("name", "label").where("name IS NOT NULL AND label IS NOT NULL").distinct()
    mentions = mentions.join(named.withColumn("name_norm", once("name", "label")), ["name", "label"])
    keys = ["corpus", "label", "name_norm"]
    heads = mentions.groupBy(*keys).agg(F.min_by(F.struct("name", "embedding"), "seq").alias("h"), F.min("seq").alias("seq")).select(*keys, "seq", "h.name", "h.embedding")
    table = known.withColumn("name_norm", norm("name", "label")).select("corpus", "label", "pk", "name_norm", "embedding")
    # a name with one known entity needs no order
    exact = resolve_exact(heads, table).where("pk IS NOT NULL").select(*keys, "seq", "pk", F.lit("exact-norm").alias("rule"), F.lit(False).alias("minted"))
    rest = heads.join(exact.select(*keys), keys, "left_anti")
    rest = rest.join(_nearest(rest, table, limits), keys, "left")

    def one(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame()
        names: dict[str, str | None] = {}
        for n, pk in zip(there["name_norm"], there["pk"], strict=True):
            names[n] = None if n in names and names[n] != pk else pk
        live = {n: pk for n, pk in names.items() if pk is not None}
        fresh: list[str] = []
        vectors: list = []
        out = []
        for r in asked.sort_values("seq").itertuples():
            pk, rule = None, None
            if len(r.name_norm) >= limits.fuzzy_length and live:
                met = best_match(r.name_norm, list(live), limits.fuzzy_cutoff)
                if met and met[1] >= limits.fuzzy:
                    pk, rule = live[met[0]], f"fuzzy:{met[1]:.1f}"
            vector = None if r.embedding is None or not len(r.embedding) else np.array(r.embedding, float)
            if pk is None and vector is not None:
                near = [(-x["score"], x["pk"], x.get("corpus")) for x in json.loads(r.near or "[]")]
                if vectors:
                    stack = np.stack(vectors)
                    scores = (1 + stack @ vector / np.maximum(1e-300, np.linalg.norm(stack, axis=1) * np.linalg.norm(vector))) / 2
                    near += [(-float(s), p, r.corpus) for s, p in zip(scores, fresh, strict=True)]
                of_corpus = [x for x in sorted(near, key=lambda x: x[:2])[: limits.neighbours] if x[2] == r.corpus]
                if of_corpus and -of_corpus[0][0] >= limits.embedding:
                    pk, rule = of_corpus[0][1], f"embedding:{-of_corpus[0][0]:.3f}"
            minted = pk is None
            if minted:
                rule = "minted"
                if r.name_norm not in names:
                    pk = names[r.name_norm] = live[r.name_norm] = r.name
                if vector is not None:
                    fresh.append(r.name)
                    vectors.append(vector)
            out.append((r.corpus, r.label, r.name_norm, r.seq, pk, rule, minted))
        return pd.DataFrame(out, columns=["corpus", "label", "name_norm", "seq", "pk", "rule", "minted"])

    rest = rest.select("corpus", "label", "name", "name_norm", "seq", "embedding", "near")
    there = table.select("corpus", "label", "pk", "name_norm")
    seq = dict(mentions.dtypes)["seq"]
    solved = rest.groupBy("corpus", "label").cogroup(there.groupBy("corpus", "label")).applyInPandas(one, f"corpus string, label string, name_norm string, seq {seq}, pk string, rule string, minted boolean")
    outcome = exact.unionByName(solved).withColumnRenamed("seq", "_head")
    later = F.col("minted") & F.col("pk").isNotNull() & (F.col("seq") != F.col("_head"))
    joined = mentions.join(outcome, keys)
    return joined.select("corpus", "label", "seq", "name_norm", F.coalesce("pk", "name").alias("pk"), F.when(later, "exact-norm").otherwise(F.col("rule")).alias("rule"), (F.col("minted") & ~later).alias("minted"))


def first_of_triples(rows: DataFrame) -> DataFrame:
    """Of resolved rows (src_label, src_pk, edge_type, dst_label, dst_pk, method, pos): lexical ones before others, and the
    last of several others; lexical ones by position."""
    lexical = F.col("method") == "lexical"
    order = Window.partitionBy("src_label", "src_pk", "edge_type", "dst_label", "dst_pk").orderBy(F.when(lexical, 0).otherwise(1), F.when(lexical, F.col("pos")).otherwise(-F.col("pos")))
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def covered(rows: DataFrame) -> DataFrame:
    """Resolved rows with drop_reason where a lexical row has the same triple; rows without a triple stay as they are."""
    lexical = rows.where("drop_reason IS NULL AND method = 'lexical'").select("src_label", "src_pk", "edge_type", "target_type", "pk").distinct().withColumn("_l", F.lit(True))
    joined = rows.join(lexical, ["src_label", "src_pk", "edge_type", "target_type", "pk"], "left")
    return joined.withColumn("drop_reason", F.coalesce("drop_reason", F.when(F.col("_l") & (F.col("method") != "lexical"), "lexical edge is there"))).drop("_l")


def candidates(store, cap: int = 15) -> DataFrame:
    """corpus, label, pk, degree, rank: the best linked entities of each corpus and label."""
    found = store.view(sorted(MINTABLE)).select("corpus", "label", "pk").join(store.degrees(), ["label", "pk"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    rank = F.row_number().over(Window.partitionBy("corpus", "label").orderBy(F.desc("degree"), "pk"))
    return found.withColumn("rank", rank).where(F.col("rank") <= cap)


def _similar(units: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """left_pk, pk, rank: rows of table (pk, corpus, text, embedding) like units (left_pk, corpus, title, embedding), by
    vectors and by the title's words. The corpus is looked at only after the k best of each leg are taken."""
    near = similar_pairs(units.where(F.size("embedding") > 0).select(F.col("left_pk").alias("pk"), "embedding"), table.where(F.size("embedding") > 0).select("pk", "embedding"), k)
    words = matched_each(units.select("left_pk", F.col("title").alias("text")), table.select("pk", "text"), k)
    within = units.select("left_pk", F.col("corpus").alias("_mine"))
    of_corpus = lambda df: df.join(within, "left_pk").join(table.select("pk", F.col("corpus").alias("_its")), "pk").where("_mine = _its")
    again = F.row_number().over(Window.partitionBy("left_pk").orderBy("rank"))  # places among those left
    return fuse_each(*[of_corpus(df).withColumn("rank", again).select("left_pk", "pk", "rank") for df in (near, words)], limit=k)


def neighbours(store, units: DataFrame, section_cap: int = 12, file_cap: int = 8, k: int = 10) -> DataFrame:
    """label, pk, kind, place, target: for units (label, pk, path, corpus, title) the sections of their file in order, then
    similar ones, and the files linked with theirs, then similar ones; each unit itself is left out."""
    vector = store.nodes("File").select(F.lit("File").alias("label"), F.col("path").alias("pk"), "embedding").unionByName(store.nodes("Section").select(F.lit("Section").alias("label"), F.col("id").alias("pk"), "embedding"))
    asked = units.join(vector, ["label", "pk"], "left").withColumn("left_pk", F.to_json(F.struct("label", "pk")))
    name = F.coalesce(F.when(F.trim("title") != "", F.col("title")), F.element_at(F.split("path", "/"), -1))
    asked = asked.withColumn("title", name)
    out = []
    sections = store.nodes("Section").select(F.col("id").alias("target"), "path", "corpus", "ordinal")
    same = asked.select("left_pk", "pk", "label", "path", "corpus").join(sections, ["path", "corpus"]).where("NOT (label = 'Section' AND pk = target)").select("left_pk", "target", F.lit(0).alias("leg"), F.col("ordinal").cast("long").alias("at"))
    table = store.nodes("Section").select(F.col("id").alias("pk"), "corpus", F.col("summary").alias("text"), "embedding")
    alike = lambda t: _similar(asked, t, k).select("left_pk", F.col("pk").alias("target"), F.lit(1).alias("leg"), F.col("rank").cast("long").alias("at"))
    out.append(("section", same.unionByName(alike(table)), section_cap))
    files = store.nodes("File").where("hash IS NOT NULL").select(F.col("path").alias("target"))
    linked = store.undirected().where("a_label = 'File' AND b_label = 'File'").select(F.col("a_pk").alias("path"), F.col("b_pk").alias("target")).distinct().join(files, "target", "left_semi")
    linked = asked.select("left_pk", "path").join(linked, "path").select("left_pk", "target", F.lit(0).alias("leg"), F.lit(0).cast("long").alias("at"))
    table = store.nodes("File").select(F.col("path").alias("pk"), "corpus", F.col("summary").alias("text"), "embedding")
    out.append(("file", linked.unionByName(alike(table)), file_cap))
    kinds = []
    for kind, rows, cap in out:
        own = asked.select("left_pk", "label", "pk", F.col("path").alias("_path"))
        mine = F.col("_path") if kind == "file" else F.when(F.col("label") == "Section", F.col("pk"))
        first = rows.groupBy("left_pk", "target").agg(F.min(F.struct("leg", "at")).alias("o")).join(own, "left_pk").where(~F.col("target").eqNullSafe(mine))
        place = F.row_number().over(Window.partitionBy("left_pk").orderBy("o", "target"))
        kinds.append(first.withColumn("place", place).where(F.col("place") <= cap).select("label", "pk", F.lit(kind).alias("kind"), "place", "target"))
    return kinds[0].unionByName(kinds[1])


def contexts(store, units: DataFrame) -> DataFrame:
    """label, pk, context of units (label, pk, path, corpus, title): the corpus's entities, then the unit's sections and files, by lines."""
    near = neighbours(store, units).groupBy("label", "pk").agg(F.sort_array(F.collect_list(F.struct("kind", "place", "target"))).alias("n"))
    of = lambda kind: F.array_join(F.transform(F.filter("n", lambda x: x["kind"] == kind), lambda x: x["target"]), ", ")
    line = lambda name, kind: F.when(of(kind) != "", F.concat(F.lit(f"{name}: "), of(kind)))
    joined = units.join(near, ["label", "pk"], "left").join(rendered(candidates(store)).withColumnRenamed("text", "_e"), "corpus", "left")
    return joined.select("label", "pk", F.concat_ws("\n", "_e", line("Section", "section"), line("File", "file")).alias("context"))


def rendered(found: DataFrame) -> DataFrame:
    """corpus and text: one line per label, in order, with its candidates."""
    lines = found.groupBy("corpus", "label").agg(F.sort_array(F.collect_list(F.struct("rank", "pk"))).alias("c")).select("corpus", "label", F.concat("label", F.lit(": "), F.array_join(F.transform("c", lambda x: x["pk"]), ", ")).alias("line"))
    return lines.groupBy("corpus").agg(F.sort_array(F.collect_list(F.struct("label", "line"))).alias("l")).select("corpus", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def merge_due(store, at_least: int = 6, words: int = 80) -> DataFrame:
    """label, pk, description of entities with six fragments or more: the fragments in one text of at most 80 words, and
    description_fragments, which then hold that text alone, so that it is merged again only after five more."""
    frames = []
    for label in sorted(MINTABLE - {"Risk"}):
        df = store.nodes(label).where(F.size("description_fragments") >= at_least)
        text = F.array_join(F.slice(F.split(F.array_join("description_fragments", "; "), " "), 1, words), " ")
        frames.append(df.select(F.lit(label).alias("label"), F.col(PRIMARY_KEY[label]).alias("pk"), text.alias("description")))
    return reduce(DataFrame.unionByName, frames).withColumn("description_fragments", F.array("description"))

"""Every query of the graph engine by name, with its DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import text as T
from graphloom.ontology import EDGE_ENDS, MINTABLE, Ontology
from graphloom.operators import resolve, search, tools
from graphloom.operators.store import GraphStore, merged
from graphloom.plans import pipeline
from graphloom.schema import EDGE, EDGE_KEY
from graphloom.sources import corpus
from graphloom.sources.tables import SQL, load, vectors
from graphloom.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SERVICE, CLIENT, ORDER, TALK, SINCE = "Supplier#000000001", "Customer#000000002", "order/7", "conv/1", "1998-07-01T00:00:00Z"


def query(sql: str | None = None, graph: bool = True):
    """Register a query under its name; with graph, its SQL starts from the graph's tables."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = (SQL + sql) if graph else sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


# questions to the graph


@query("SELECT path, name, summary, coalesce(n, 0)::BIGINT AS inbound FROM files LEFT JOIN (SELECT dst_pk, count(*) AS n FROM edges WHERE dst_label = 'File' GROUP BY 1) ON path = dst_pk WHERE summary IS NOT NULL ORDER BY inbound DESC, path LIMIT 40")
def describe_project(spark, sf_dir):
    return tools.describe_project(load(spark, sf_dir)).drop("key_points")


@query(f"SELECT n.path, n.id, n.name, edge_type FROM edges JOIN nodes n ON n.label = src_label AND n.pk = src_pk JOIN nodes a ON a.label = dst_label AND a.pk = dst_pk WHERE a.path = '{SERVICE}' OR a.id = '{SERVICE}' OR a.name = '{SERVICE}'")
def inbound(spark, sf_dir):
    return tools.inbound(load(spark, sf_dir), SERVICE)


@query(f"SELECT n.path, n.id, n.name, edge_type FROM edges JOIN nodes n ON n.label = dst_label AND n.pk = dst_pk JOIN nodes a ON a.label = src_label AND a.pk = src_pk WHERE a.path = '{TALK}' OR a.id = '{TALK}' OR a.name = '{TALK}'")
def outbound(spark, sf_dir):
    return tools.outbound(load(spark, sf_dir), TALK)


def _related(depth: int) -> str:
    rounds = ", both_ways AS (SELECT src_label AS al, src_pk AS ap, dst_label AS bl, dst_pk AS bp FROM edges UNION SELECT dst_label, dst_pk, src_label, src_pk FROM edges)"
    rounds += f", r0 AS (SELECT label, pk, 0 AS depth FROM nodes WHERE path = '{CLIENT}' OR id = '{CLIENT}' OR name = '{CLIENT}')"
    for d in range(1, depth + 1):
        rounds += f", r{d} AS (SELECT * FROM r{d - 1} UNION ALL SELECT bl, bp, {d} FROM (SELECT DISTINCT bl, bp FROM both_ways JOIN r{d - 1} ON al = label AND ap = pk AND depth = {d - 1}) WHERE NOT EXISTS (SELECT 1 FROM r{d - 1} s WHERE s.label = bl AND s.pk = bp))"
    return rounds + f" SELECT path, id, name, summary, min(depth)::INT AS depth FROM r{depth} JOIN nodes USING (label, pk) WHERE depth > 0 GROUP BY 1, 2, 3, 4 ORDER BY depth, path NULLS FIRST, id NULLS FIRST, name NULLS FIRST LIMIT 50"


@query(_related(2))
def related_depth2(spark, sf_dir):
    return tools.related(load(spark, sf_dir), CLIENT, 2)


@query(_related(3))
def related_depth3(spark, sf_dir):
    return tools.related(load(spark, sf_dir), CLIENT, 3)


@query(f"SELECT label, pk, corpus, path, id, name, title, summary FROM nodes WHERE path = '{TALK}' OR id = '{TALK}' OR name = '{TALK}' ORDER BY (label <> 'File')::INT, label, pk LIMIT 1")
def get_node(spark, sf_dir):
    return tools.get_node(load(spark, sf_dir), TALK).select("label", "pk", "corpus", "path", "id", "name", "title", "summary")


@query("SELECT summary FROM files WHERE path = 'doc/5'")
def get_file_summary(spark, sf_dir):
    return tools.get_file_summary(load(spark, sf_dir), "doc/5").select("summary")


@query(f"SELECT id, title, level, ordinal, summary FROM sections JOIN edges ON dst_pk = id AND edge_type = 'CONTAINS' WHERE src_pk = '{TALK}' ORDER BY level, ordinal, id")
def section_tree(spark, sf_dir):
    return tools.section_tree(load(spark, sf_dir), TALK)


@query(
    f"SELECT '{ORDER}' AS source, coalesce(b.path, b.id, b.name) AS target, edge_type, src_pk = '{ORDER}' AS outbound, origin, confidence, reason FROM edges JOIN nodes b ON (src_pk = '{ORDER}' AND b.label = dst_label AND b.pk = dst_pk) OR (dst_pk = '{ORDER}' AND b.label = src_label AND b.pk = src_pk) "
    f"WHERE b.label = 'Client' AND b.name = (SELECT c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = 7)"
)
def explain_relationship(spark, sf_dir):
    store = load(spark, sf_dir)
    client = store.edges("BELONGS_TO").where(F.col("src_pk") == ORDER).first()
    return tools.explain_relationship(store, ORDER, client["dst_pk"])


@query(
    f", e AS (SELECT edge_type, true AS outbound, dst_label AS l, dst_pk AS p FROM edges WHERE src_label = 'Ticket' AND src_pk = '{ORDER}' UNION ALL SELECT edge_type, false, src_label, src_pk FROM edges WHERE dst_label = 'Ticket' AND dst_pk = '{ORDER}') "
    f"SELECT t.id AS ticket_id, t.title AS ticket_title, t.status AS ticket_status, edge_type, outbound, n.label AS neighbour_label, coalesce(n.path, n.id, n.name) AS neighbour, n.summary, n.title FROM (SELECT * FROM nodes WHERE label = 'Ticket' AND id = '{ORDER}') t LEFT JOIN (e JOIN nodes n ON n.label = e.l AND n.pk = e.p) ON true"
)
def ticket_dossier(spark, sf_dir):
    return tools.ticket_dossier(load(spark, sf_dir), ORDER)


@query("SELECT label, name FROM nodes WHERE label = 'Technology' AND name = 'Brand#7'")
def list_entities(spark, sf_dir):
    return tools.list_entities(load(spark, sf_dir), "Technology", "name", "Brand#7").select("label", "name")


@query("SELECT id, status, title FROM nodes WHERE label = 'Ticket' AND status = 'P' ORDER BY id LIMIT 50")
def list_open_tickets(spark, sf_dir):
    return tools.list_entities(load(spark, sf_dir), "Ticket", "status", "P").select("id", "status", "title")


_PAIRS = ", pairs AS (SELECT e.*, coalesce(s.path, s.id, s.name) AS s, coalesce(d.path, d.id, d.name) AS d, s.corpus AS sc, d.corpus AS dc, s.summary AS ss, d.summary AS ds FROM edges e JOIN nodes s ON s.label = src_label AND s.pk = src_pk JOIN nodes d ON d.label = dst_label AND d.pk = dst_pk) "


@query(_PAIRS + "SELECT s AS source, edge_type, d AS target, confidence, reason FROM pairs WHERE edge_type IN ('SUPERSEDES', 'CONTRADICTS', 'NEEDS_UPDATE') AND (sc = 'src1' OR dc = 'src1') ORDER BY src_pk, edge_type, dst_pk LIMIT 200")
def check_freshness(spark, sf_dir):
    return tools.check_freshness(load(spark, sf_dir), corpus="src1")


@query(_PAIRS + f"SELECT s AS source, edge_type, d AS target, confidence, reason FROM pairs WHERE edge_type IN ('SUPERSEDES', 'CONTRADICTS', 'NEEDS_UPDATE') AND ('{ORDER}' IN (src_pk, dst_pk)) ORDER BY src_pk, edge_type, dst_pk LIMIT 200")
def check_freshness_node(spark, sf_dir):
    return tools.check_freshness(load(spark, sf_dir), node_id=ORDER)


@query(_PAIRS + "SELECT s AS source, d AS target, confidence, reason FROM pairs WHERE edge_type = 'CONTRADICTS' ORDER BY src_pk, dst_pk LIMIT 50")
def find_contradictions(spark, sf_dir):
    return tools.find_contradictions(load(spark, sf_dir))


@query("SELECT label, coalesce(path, id, name) AS node, strftime(updated, '%Y-%m-%d %H:%M:%S') AS updated FROM nodes WHERE updated >= TIMESTAMP '1998-07-01' ORDER BY nodes.updated DESC, label, pk LIMIT 50")
def whats_new(spark, sf_dir):
    return tools.whats_new(load(spark, sf_dir), SINCE).withColumn("updated", stamp("updated"))


@query(
    f", near AS (SELECT dst_label AS label, dst_pk AS pk FROM edges WHERE src_label = 'Client' AND src_pk = '{CLIENT}' UNION SELECT src_label, src_pk FROM edges WHERE dst_label = 'Client' AND dst_pk = '{CLIENT}') "
    "SELECT label, coalesce(path, id, name) AS node, strftime(updated, '%Y-%m-%d %H:%M:%S') AS at FROM nodes JOIN near USING (label, pk) WHERE updated IS NOT NULL ORDER BY updated DESC, label, pk LIMIT 50"
)
def timeline_nodes(spark, sf_dir):
    return tools.timeline_nodes(load(spark, sf_dir), CLIENT).withColumn("at", stamp("at"))


@query(_PAIRS + f"SELECT s AS newer, d AS older FROM pairs WHERE edge_type = 'SUPERSEDES' AND '{ORDER}' IN (src_pk, dst_pk) ORDER BY src_pk, dst_pk LIMIT 50")
def timeline_supersedes(spark, sf_dir):
    return tools.timeline_supersedes(load(spark, sf_dir), ORDER)


_GREP = r"(password|token)\s*=\s*"


@query(rf"SELECT corpus, path, line, left(trim(text, ' '), 400) AS text FROM (SELECT source AS corpus, 'doc/' || doc_id AS path, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1))::BIGINT AS line FROM documents) WHERE regexp_matches(text, '{_GREP}') ORDER BY corpus, path, line LIMIT 100", graph=False)
def grep_corpus(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("corpus"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "text")
    return tools.grep(docs, _GREP, 100)


# retrieval


def _vector(spark, sf_dir) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 3").first()["embedding"])


_NEAR = "SELECT 'doc/' || vec_id AS pk, round((1 + list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3))) / 2, 6) AS score FROM embeddings"


@query(f"SELECT * FROM ({_NEAR}) ORDER BY score DESC, pk LIMIT 10", graph=False)
def knn_search(spark, sf_dir):
    return search.vector_search(vectors(spark, sf_dir), _vector(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query(f"SELECT * FROM (SELECT * FROM ({_NEAR}) ORDER BY score DESC, pk LIMIT 50) WHERE score >= 0.6", graph=False)
def knn_threshold(spark, sf_dir):
    return search.vector_search(vectors(spark, sf_dir), _vector(spark, sf_dir), 50, 0.6).withColumn("score", F.round("score", 6))


def _bm25(source: str, terms: list[str]) -> str:
    counts = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS c{i}" for i, w in enumerate(terms))
    docs = ", ".join(f"count(*) FILTER (WHERE c{i} > 0) AS d{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n_docs - d{i} + 0.5) / (d{i} + 0.5)) * c{i} * 2.2 / (c{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(terms)))
    some = " OR ".join(f"c{i} > 0" for i in range(len(terms)))
    return (
        rf"tok AS (SELECT pk, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM ({source}) WHERE text IS NOT NULL), cnt AS (SELECT pk, len(t) AS n, {counts} FROM tok), "
        f"st AS (SELECT count(*) AS n_docs, avg(n) AS mean, {docs} FROM cnt), scored AS (SELECT pk, {score} AS score FROM cnt, st WHERE {some})"
    )


_TEXTS = "SELECT 'doc/' || doc_id AS pk, text FROM documents UNION ALL SELECT DISTINCT 'conv/' || conv_id, NULL FROM conversations"
_TERMS = "the licensed version"


@query(f"WITH {_bm25(_TEXTS, _TERMS.split())} SELECT pk, round(score, 6) AS score FROM scored ORDER BY round(score, 9) DESC, pk LIMIT 20", graph=False)
def bm25_search(spark, sf_dir):
    found = search.full_text_search(load(spark, sf_dir).nodes("File").select(F.col("path").alias("pk"), F.col("summary").alias("text")), _TERMS, 20)
    return found.withColumn("score", F.round("score", 6))


@query(f"WITH {_bm25("SELECT 'part/' || p_partkey AS pk, p_type AS text FROM part", ['economy'])}, best AS (SELECT * FROM scored ORDER BY round(score, 9) DESC, pk LIMIT 50) SELECT pk, round(score, 6) AS score, p_name AS title, p_type AS description FROM best JOIN part ON pk = 'part/' || p_partkey WHERE p_size % 2 = 0 ORDER BY score DESC, pk LIMIT 20", graph=False)
def find_reusable(spark, sf_dir):
    return tools.find_reusable(load(spark, sf_dir), "economy").withColumn("score", F.round("score", 6))


@query(
    f"WITH {_bm25(_TEXTS, _TERMS.split())}, ft AS (SELECT pk, row_number() OVER (ORDER BY round(score, 9) DESC, pk) AS r FROM scored QUALIFY r <= 50), "
    f"vs AS (SELECT pk, row_number() OVER (ORDER BY score DESC, pk) AS r FROM ({_NEAR}) QUALIFY r <= 50), "
    "legs AS (SELECT pk, 1.0 / (60 + r) AS s, r AS seen FROM vs UNION ALL SELECT pk, 1.0 / (60 + r), 1000000000 + r FROM ft) "
    "SELECT pk, round(sum(s), 6)::DOUBLE AS score FROM legs GROUP BY pk ORDER BY sum(s) DESC, min(seen) LIMIT 20",
    graph=False,
)
def rrf_hybrid(spark, sf_dir):
    found = search.hybrid_search(load(spark, sf_dir), _TERMS, embed=lambda _: _vector(spark, sf_dir), vectors=vectors(spark, sf_dir))
    return found.withColumn("score", F.round("score", 6))


@query(
    f"WITH s AS (SELECT a.vec_id AS a, b.vec_id AS b, (1 + list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / 2 AS v FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) SELECT a::BIGINT AS left_pk, b::BIGINT AS pk, round(v, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(v, 12) DESC, b) <= 5",
    graph=False,
)
def similar_pairs(spark, sf_dir):
    every = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pk"), "embedding")
    return search.similar_pairs(every.where("pk % 100 = 0"), every, 5).select("left_pk", "pk", F.round("score", 6).alias("score"))


_DEGREE = ", ends AS (SELECT src_label AS label, src_pk AS pk FROM edges UNION ALL SELECT dst_label, dst_pk FROM edges WHERE NOT (src_label = dst_label AND src_pk = dst_pk)), degree AS (SELECT label, pk, count(*) AS degree FROM ends GROUP BY 1, 2) "
_MINTED = "(" + ", ".join(f"'{x}'" for x in sorted(MINTABLE)) + ")"


@query(_DEGREE + f"SELECT label, pk, coalesce(degree, 0)::BIGINT AS degree FROM nodes LEFT JOIN degree USING (label, pk) WHERE label IN {_MINTED} QUALIFY row_number() OVER (PARTITION BY corpus, label ORDER BY coalesce(degree, 0) DESC, pk) <= 15")
def degree_rank(spark, sf_dir):
    return resolve.candidates(load(spark, sf_dir)).select("label", "pk", "degree")


@query(_DEGREE + f"SELECT label, count(*) AS n FROM nodes LEFT JOIN degree USING (label, pk) WHERE label IN {_MINTED} AND coalesce(degree, 0) <= 3 GROUP BY label")
def prune_candidates(spark, sf_dir):
    return load(spark, sf_dir).prune_entities(3)


# changes of the graph


@query("SELECT c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'seen ' || c_custkey ELSE NULL END AS description FROM customer UNION ALL SELECT 'New#' || n_nationkey, n_name FROM nation", graph=False)
def upsert_nodes(spark, sf_dir):
    store = load(spark, sf_dir)
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    store.upsert_nodes("Client", customer.where("c_custkey % 3 = 0").select(F.col("c_name").alias("name"), F.concat(F.lit("seen "), F.col("c_custkey").cast("string")).alias("description")))
    store.upsert_nodes("Client", nation.select(F.concat(F.lit("New#"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_name").alias("description")))
    return store.nodes("Client").select("name", "description")


@query("SELECT user_id, max_by(event_type, event_id) AS kind, max_by(value, event_id) FILTER (WHERE value > 20) AS value FROM events GROUP BY user_id", graph=False)
def upsert_last_writer(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind"), F.when(F.col("value") > 20, F.col("value")).alias("value"), "event_id")
    return merged(rows.drop("event_id").limit(0), rows, ["user_id"], "event_id")


@query("SELECT src_pk, dst_pk, confidence, reason FROM (SELECT 'order/' || o_orderkey AS src_pk, c_name AS dst_pk, CASE WHEN o_orderkey % 5 = 0 THEN 0.25 ELSE 1.0 END AS confidence, 'ordered by' AS reason FROM orders JOIN customer ON o_custkey = c_custkey)", graph=False)
def upsert_edges(spark, sf_dir):
    store = load(spark, sf_dir)
    again = store.edges("BELONGS_TO").where("substring_index(src_pk, '/', -1) % 5 = 0").select(*EDGE_KEY, "origin", F.lit(0.25).alias("confidence"))
    lost = again.limit(3).withColumn("dst_pk", F.lit("nobody"))
    store.upsert_edges(again.unionByName(lost))
    return store.edges("BELONGS_TO").select("src_pk", "dst_pk", "confidence", "reason")


@query("SELECT edge_type, count(*) AS n FROM edges WHERE NOT (origin = 'inferred' AND src_label = 'Ticket' AND src_pk IN (SELECT pk FROM nodes WHERE label = 'Ticket' AND status = 'O')) GROUP BY edge_type")
def delete_inferred(spark, sf_dir):
    store = load(spark, sf_dir)
    store.delete_edges(store.view(["Ticket"]).where("status = 'O'").select("label", "pk"), origin="inferred")
    return store.edges().groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query(", gone AS (SELECT label, pk FROM nodes WHERE label = 'Service' AND pk LIKE '%5') SELECT 'edges' AS what, count(*) AS n FROM edges WHERE NOT EXISTS (SELECT 1 FROM gone WHERE label = src_label AND pk = src_pk) AND NOT EXISTS (SELECT 1 FROM gone WHERE label = dst_label AND pk = dst_pk) UNION ALL SELECT 'services', count(*) FROM nodes WHERE label = 'Service' AND pk NOT LIKE '%5'")
def detach_delete(spark, sf_dir):
    store = load(spark, sf_dir)
    store.detach_delete(store.view(["Service"]).where("pk LIKE '%5'").select("label", "pk"))
    return store.edges().agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("what"), "n").unionByName(store.nodes("Service").agg(F.count(F.lit(1)).alias("n")).select(F.lit("services").alias("what"), "n"))


@query("SELECT edge_type, count(*) AS n FROM edges WHERE NOT (origin = 'inferred' AND EXISTS (SELECT 1 FROM nodes WHERE label = src_label AND pk = src_pk AND corpus = 'src2')) GROUP BY edge_type")
def wipe_scope(spark, sf_dir):
    store = load(spark, sf_dir)
    store.wipe("src2", "inferred")
    return store.edges().groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(corpus, '') AS corpus, label, count(*) AS n FROM nodes WHERE corpus IS DISTINCT FROM 'src3' GROUP BY 1, 2")
def delete_corpus(spark, sf_dir):
    store = load(spark, sf_dir)
    store.delete_corpus("src3")
    return store.view().groupBy(F.coalesce("corpus", F.lit("")).alias("corpus"), "label").agg(F.count(F.lit(1)).alias("n"))


@query("WITH e AS (SELECT user_id, event_type || ':' || (value::INT % 7) AS f, min(event_id) AS p FROM events GROUP BY 1, 2), r AS (SELECT user_id, f, row_number() OVER (PARTITION BY user_id ORDER BY p, f) AS k FROM e) SELECT 'Customer#' || lpad(user_id::VARCHAR, 9, '0') AS name, string_agg(f, ',' ORDER BY k) AS fragments FROM r JOIN customer ON c_custkey = user_id WHERE k <= 12 GROUP BY 1", graph=False)
def fragments_append(spark, sf_dir):
    store = load(spark, sf_dir)
    rows = table(spark, sf_dir, "events").join(table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey"))
    tag = F.concat("event_type", F.lit(":"), (F.bround("value").cast("int") % 7).cast("string"))
    store.append_fragments(rows.select(F.lit("Client").alias("label"), F.col("c_name").alias("pk"), tag.alias("fragment"), F.col("event_id").alias("pos")))
    return store.nodes("Client").where("description_fragments IS NOT NULL").select("name", F.array_join("description_fragments", ",").alias("fragments"))


@query("SELECT 'src1' AS name, (SELECT count(*) FROM files WHERE corpus = 'src1') AS node_count, (SELECT count(*) FROM edges) AS edge_count, (SELECT count(*) FROM edges JOIN nodes ON label = src_label AND pk = src_pk WHERE corpus = 'src1') AS corpus_edge_count")
def corpus_stats(spark, sf_dir):
    return load(spark, sf_dir).corpus_stats("src1")


@query("SELECT label, count(*) AS n FROM (SELECT DISTINCT label, pk FROM nodes JOIN edges ON label = src_label AND pk = src_pk AND origin = 'inferred' WHERE label IN ('File', 'Section')) GROUP BY label")
def backfill_inferred_at(spark, sf_dir):
    store = load(spark, sf_dir)
    store.backfill_inferred_at(F.lit("2024-06-01").cast("timestamp"))
    return store.view(["File", "Section"]).where("inferred_at IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'File' AS label, count(*) AS n FROM files WHERE hash IS NOT NULL UNION ALL SELECT 'Section', count(*) FROM sections UNION ALL SELECT 'edges', count(*) FROM edges WHERE src_pk NOT LIKE 'conv/%' OR src_label <> 'File'")
def purge_stubs(spark, sf_dir):
    store = load(spark, sf_dir)
    store.purge_stubs()
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("label"), "n")
    return count(store.nodes("File"), "File").unionByName(count(store.nodes("Section"), "Section")).unionByName(count(store.edges(), "edges"))


@query("SELECT label, pk, count(*) AS n FROM nodes GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return load(spark, sf_dir).duplicate_keys()


# sources and logs


@query("SELECT event_type AS provider, sum(event_id % 1000)::BIGINT AS input_tokens, sum(user_id)::BIGINT AS output_tokens FROM events WHERE ts >= TIMESTAMP '2024-01-02' GROUP BY 1", graph=False)
def usage_costs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), (F.col("event_id") % 1000).alias("input_tokens"), F.col("user_id").alias("output_tokens"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
    return corpus.costs(rows, "2024-01-02")


@query("SELECT count(*) AS files, (sum(length(text)) // 4)::BIGINT AS tokens FROM documents", graph=False)
def token_estimate(spark, sf_dir):
    return corpus.token_estimate(table(spark, sf_dir, "documents"))




@query("SELECT page_id, 'http://' || regexp_replace(url, '^https?://', '') AS path FROM pages WHERE regexp_matches(regexp_replace(url, '^https?://', ''), '(^|/).*[.]example[.]com/en/.*$|^(.*/)?fr/8.5.*$') AND url NOT LIKE '%ref=x%'", graph=False)
def path_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("http://"), F.regexp_replace("url", "^https?://", "")).alias("path"))
    config = corpus.CorpusConfig("web", "http:/", include=["**/*.example.com/en/*", "**/fr/8?5*"], exclude=["*ref=x*"])
    return rows.where(corpus.in_corpus(F.col("path"), config))


@query("SELECT 'doc-' || doc_id AS name, md5(text) AS hash, strlen(text)::BIGINT AS size, 'unknown' AS type FROM documents", graph=False)
def file_metadata(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/doc-"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return corpus.described(files).select("name", "hash", "size", "type")


# differences


_SNAP = "WITH was AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 7 <> 3), now AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN md5(text || '!') ELSE md5(text) END AS h FROM documents WHERE doc_id % 11 <> 2) "


def _snapshots(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    was = docs.where("doc_id % 7 <> 3").select("doc_id", F.md5("text").alias("h"))
    now = docs.where("doc_id % 11 <> 2").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text")).alias("h"))
    return was, now


@query(_SNAP + "SELECT coalesce(w.doc_id, n.doc_id) AS doc_id, CASE WHEN w.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN w.h = n.h THEN 'unchanged' ELSE 'changed' END AS action FROM was w FULL JOIN now n ON w.doc_id = n.doc_id", graph=False)
def file_triage(spark, sf_dir):
    return pipeline.triage(*_snapshots(spark, sf_dir), "doc_id", "h")


@query("WITH was AS (SELECT conv_id || '#' || turn AS id, md5(role || chr(10) || chr(10) || text) AS h FROM conversations), now AS (SELECT conv_id || '#' || turn AS id, md5(role || chr(10) || chr(10) || CASE WHEN turn % 4 = 1 THEN upper(text) ELSE text END) AS h FROM conversations WHERE turn < 5) SELECT coalesce(w.id, n.id) AS id, CASE WHEN w.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN w.h = n.h THEN 'unchanged' ELSE 'changed' END AS action FROM was w FULL JOIN now n ON w.id = n.id", graph=False)
def section_diff(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("id", F.concat(F.col("conv_id").cast("string"), F.lit("#"), F.col("turn").cast("string")))
    was = rows.select("id", T.section_hash(F.col("role"), F.col("text")).alias("h"))
    now = rows.where("turn < 5").select("id", T.section_hash(F.col("role"), F.when(F.col("turn") % 4 == 1, F.upper("text")).otherwise(F.col("text"))).alias("h"))
    return pipeline.triage(was, now, "id", "h")


@query("SELECT 'doc/' || doc_id AS path FROM documents WHERE doc_id % 7 = 3 AND doc_id % 11 <> 2", graph=False)
def reconcile_missing(spark, sf_dir):
    was, now = ((df.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"))) for df in _snapshots(spark, sf_dir))
    return changes.missing(now, was)


@query("SELECT 'conv/' || conv_id || '#' || turn AS id FROM conversations WHERE turn >= 5 AND conv_id % 3 <> 0", graph=False)
def gc_sections(spark, sf_dir):
    have = load(spark, sf_dir).nodes("Section")
    files = table(spark, sf_dir, "conversations").where("conv_id % 3 <> 0").select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("path")).distinct()
    return pipeline.stale_sections(have, files, have.where("ordinal < 5")).select("id")


@query("SELECT 'conv/' || conv_id || '#' || turn AS id, CASE WHEN turn % 5 = 2 THEN 'added' ELSE 'changed' END AS action FROM conversations WHERE (turn % 5 = 2 OR turn % 4 = 1 AND upper(text) <> text) AND turn < 9", graph=False)
def incremental_sections(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("id", F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("#"), F.col("turn").cast("string")))
    was = rows.where("turn % 5 <> 2").select("id", T.section_hash(F.col("role"), F.col("text")).alias("hash"))
    now = rows.where("turn < 9").select("id", T.section_hash(F.col("role"), F.when(F.col("turn") % 4 == 1, F.upper("text")).otherwise(F.col("text"))).alias("hash"))
    return pipeline.due_sections(was, now)


# text


@query(r"SELECT doc_id, CASE WHEN s = '' THEN 'section' ELSE s END AS slug FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s-]', '', 'g'), '\s+', '-', 'g'), '-') AS s FROM documents)", graph=False)
def slug(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"(/[^\"# ()]*)\"', 1))) AS target FROM pages", graph=False)
def lexical_links(spark, sf_dir):
    page = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".md"))
    linked = F.regexp_replace("html", 'href="([^"]*)"', "[a]($1)")
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(T.references(linked, page, F.lit(".md"))).alias("r"))
    return rows.where("r.rule = 'md-link' AND r.target_type = 'File'").select("page_id", "r.target_name").withColumnRenamed("target_name", "target")


@query(r"SELECT doc_id, '§' || unnest(list_distinct(regexp_extract_all('§ ' || regexp_replace(text, '[^0-9.]+', ' § ', 'g'), '§\s*(\d+(?:\.\d+)+)', 1))) AS target FROM documents", graph=False)
def section_refs(spark, sf_dir):
    marked = F.concat(F.lit("§ "), F.regexp_replace("text", "[^0-9.]+", " § "))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.references(marked, F.lit("d.md"), F.lit(".md"))).alias("r"))
    return rows.where("r.rule = 'md-anchor'").select("doc_id", "r.target_name").withColumnRenamed("target_name", "target")


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '(mail\d)\.example', 1)) AS target FROM documents", graph=False)
def custom_patterns(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.custom_references(F.col("text"), r"(mail\d)\.example", 1)).alias("target"))


@query(r"WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents) SELECT doc_id, unnest(CASE WHEN len(ws) <= 100 THEN [text] ELSE list_transform(range(0, greatest(0, ceil((len(ws) - 100) / 80.0))::INT + 1), lambda i: array_to_string(ws[i * 80 + 1 : i * 80 + 100], ' ')) END) AS chunk FROM w", graph=False)
def chunk_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.word_chunks(F.col("text"), 100, 20)).alias("chunk"))


@query("SELECT p_brand AS label, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS name_norm, CASE WHEN count(DISTINCT p_partkey) = 1 THEN min(p_partkey)::VARCHAR END AS pk FROM part GROUP BY 1, 2", graph=False)
def norm_exact_resolve(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.lit("c").alias("corpus"), F.col("p_brand").alias("label"), F.col("p_partkey").cast("string").alias("pk"), T.ascii_norm(F.col("p_name"), True).alias("name_norm"))
    return resolve.name_map(rows).drop("corpus")


@query("SELECT doc_id, CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS prose, md5(doc_id || chr(10) || chr(10) || text) AS hash, ceil(length(text) / 3)::BIGINT AS tokens FROM documents", graph=False)
def section_columns(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.own_prose(F.col("text")).alias("prose"), T.section_hash(F.col("doc_id").cast("string"), F.col("text")).alias("hash"), T.estimated_tokens(F.col("text")).alias("tokens"))


@query("SELECT event_id, coalesce(CASE WHEN kind = 0 THEN least(1, value / 100) WHEN kind = 1 THEN 0.9 WHEN kind = 2 THEN least(1, value / 50) END, 0.0) AS confidence FROM (SELECT event_id, value, event_id % 4 AS kind FROM events)", graph=False)
def confidence_coerce(spark, sf_dir):
    raw = F.when(F.col("event_id") % 4 == 0, (F.col("value") / 100).cast("string")).when(F.col("event_id") % 4 == 1, F.lit('"High"')).when(F.col("event_id") % 4 == 2, F.concat(F.lit('"'), (F.col("value") / 50).cast("string"), F.lit('"'))).otherwise(F.lit("true"))
    return table(spark, sf_dir, "events").select("event_id", resolve.confidence(raw).alias("confidence"))


# edges and ontology


_ALLOWED = "VALUES " + ", ".join(f"('{t}', [{', '.join(repr(x) for x in a.split())}]::VARCHAR[], [{', '.join(repr(x) for x in b.split())}]::VARCHAR[])" for t, (a, b) in sorted(EDGE_ENDS.items()))


@query(f"SELECT edge_type, src_label, dst_label, coalesce((len(s) = 0 OR list_contains(s, src_label)) AND (len(d) = 0 OR list_contains(d, dst_label)), false) AS allowed, count(*) AS n FROM (SELECT edge_type, src_label, dst_label FROM edges UNION ALL SELECT edge_type, dst_label, src_label FROM edges) e LEFT JOIN ({_ALLOWED}) c(t, s, d) ON t = edge_type GROUP BY 1, 2, 3, 4")
def validate_edges(spark, sf_dir):
    e = load(spark, sf_dir).edges().select("edge_type", "src_label", "dst_label")
    both = e.unionByName(e.select("edge_type", F.col("dst_label").alias("src_label"), F.col("src_label").alias("dst_label")))
    return Ontology().allowed(both).groupBy("edge_type", "src_label", "dst_label", "allowed").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT t AS edge_type, len(s)::INT AS n_src, len(d)::INT AS n_dst FROM ({_ALLOWED}) c(t, s, d)", graph=False)
def triple_constraint(spark, sf_dir):
    return Ontology().constraints(spark).select("edge_type", F.size("src").alias("n_src"), F.size("dst").alias("n_dst"))


@query(
    "SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view') THEN 'edge type cannot be written' WHEN user_id % 5 = 0 THEN 'target cannot be referred to' WHEN user_id % 7 = 0 THEN 'target has no name' WHEN value / 100 < 0.5 THEN 'low confidence' END AS drop_reason FROM events",
    graph=False,
)
def drop_reasons(spark, sf_dir):
    kinds = Ontology(edge_aliases={"click": "REFERENCES", "view": "RELATED_TO"})
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.lit("File").alias("src_label"), F.col("event_type").alias("edge_type"), F.when(F.col("user_id") % 5 == 0, "Corpus").otherwise("File").alias("target_type"), F.when(F.col("user_id") % 7 == 0, " ").otherwise("x").alias("target_name"), (F.col("value") / 100).alias("confidence")
    )
    return resolve.gated(resolve.validated(rows, kinds), kinds).select("event_id", "drop_reason")


@query(
    ", refs AS (SELECT doc_id AS ref, CASE doc_id % 3 WHEN 0 THEN 'doc/' || doc_id WHEN 1 THEN 'x\\doc-' || doc_id ELSE 'lost' END AS target FROM documents) SELECT ref, coalesce(a.path, b.path) AS pk, CASE WHEN a.path IS NOT NULL THEN 'exact' ELSE 'name' END AS rung FROM refs LEFT JOIN files a ON a.path = target LEFT JOIN files b ON a.path IS NULL AND b.name = string_split(replace(target, '\\', '/'), '/')[-1] WHERE coalesce(a.path, b.path) IS NOT NULL"
)
def target_ladder(spark, sf_dir):
    refs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("x\\doc-"), F.col("doc_id").cast("string"))).otherwise("lost").alias("target"))
    return resolve.resolve_files(refs, load(spark, sf_dir).nodes("File").select("path", "name", "hash"))


@query(
    "SELECT 'File' AS src_label, 'conv/' || conv_id AS src_pk, 'CONTAINS' AS edge_type, 'conv/' || conv_id || '#' || turn AS dst_pk FROM conversations UNION ALL SELECT 'Section', 'conv/' || conv_id || '#' || p, 'NEXT_SIBLING', 'conv/' || conv_id || '#' || turn FROM (SELECT *, lag(turn) OVER (PARTITION BY conv_id, role = 'user' ORDER BY turn) AS p FROM conversations) WHERE p IS NOT NULL "
    "UNION ALL SELECT 'Section', 'conv/' || conv_id || '#0', 'PARENT_OF', 'conv/' || conv_id || '#' || turn FROM conversations WHERE role <> 'user'",
    graph=False,
)
def structural_edges(spark, sf_dir):
    path = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"))
    parts = table(spark, sf_dir, "conversations").select(path.alias("path"), F.concat(path, F.lit("#"), F.col("turn").cast("string")).alias("id"), F.when(F.col("role") != "user", "0").alias("parent_anchor"), F.col("turn").alias("pos"))
    return pipeline.structural_edges(parts).select("src_label", "src_pk", "edge_type", "dst_pk")


def _family(spark, sf_dir):
    """The conversations' turns as sections: what is not said by the user lies under the first turn."""
    path = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"))
    parts = table(spark, sf_dir, "conversations").select(path.alias("path"), F.concat(path, F.lit("#"), F.col("turn").cast("string")).alias("id"), F.when((F.col("role") != "user") & (F.col("turn") > 0), "0").alias("parent_anchor"), F.col("turn").alias("pos"))
    return GraphStore(spark, {"Section": parts.select("id", "path")}, pipeline.structural_edges(parts))


@query("SELECT 'conv/' || conv_id || '#' || turn AS id FROM conversations WHERE role = 'user' OR turn = 0", graph=False)
def top_level_sections(spark, sf_dir):
    return pipeline.top_level(_family(spark, sf_dir)).select("id")


@query("SELECT 'conv/' || conv_id || '#' || turn AS id FROM conversations c WHERE turn > 0 OR NOT EXISTS (SELECT 1 FROM conversations o WHERE o.conv_id = c.conv_id AND o.role <> 'user' AND o.turn > 0)", graph=False)
def leaf_sections(spark, sf_dir):
    return pipeline.leaves(_family(spark, sf_dir)).select("id")


@query("SELECT 'conv/' || conv_id AS pk, md5(chr(0) || string_agg(text, chr(0) ORDER BY turn)) AS input_hash, count(*)::INT AS n FROM conversations GROUP BY conv_id", graph=False)
def rollup_inputs(spark, sf_dir):
    store = load(spark, sf_dir)
    rows = pipeline.rollup_inputs(store.nodes("Section"), store.edges("CONTAINS").select(F.col("src_pk").alias("pk"), F.col("dst_pk").alias("child")))
    return rows.select("pk", pipeline.input_hash(F.lit(""), F.col("summaries")).alias("input_hash"), F.size("summaries").alias("n"))


@query(None)
def entity_cascade_fuzzy(spark, sf_dir):
    known = load(spark, sf_dir).nodes("Technology").select(F.lit("c").alias("corpus"), F.lit("Technology").alias("label"), F.col("name").alias("pk"), "name", "embedding")
    names = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_brand")).when(F.col("p_partkey") % 3 == 1, F.concat("p_brand", F.lit("x"))).otherwise(F.col("p_name"))
    mentions = table(spark, sf_dir, "part").select(F.lit("c").alias("corpus"), F.lit("Technology").alias("label"), names.alias("name"), F.col("p_partkey").alias("seq"), F.lit(None).cast("array<float>").alias("embedding"))
    return resolve.cascade(mentions, known)


@query(None)
def heading_parse(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("source").alias("corpus"), F.concat(F.lit("# Title\n\n## "), F.regexp_replace("text", "\n", "\n## ")).alias("text"))
    return pipeline.parse_sections(docs).select("id", "level", "ordinal", "parent_anchor", "hash")


@query(None)
def candidate_context(spark, sf_dir):
    return resolve.rendered(resolve.candidates(load(spark, sf_dir)))


def _notes(spark, sf_dir):
    """Documents as files of one corpus, the brands that it knows, and what a model might have said of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("pk"))
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.lit("c").alias("corpus"), F.lit("known").alias("description")).distinct()
    files = docs.select(F.col("pk").alias("path"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.lit("h").alias("hash"), F.lit("c").alias("corpus"))
    store = GraphStore(spark, {"File": files, "Technology": brands})
    units = docs.select(F.lit("File").alias("label"), "pk", F.col("pk").alias("path"), F.lit(".md").alias("suffix"), F.lit("c").alias("corpus"), F.concat(F.lit("see TK-"), (F.col("doc_id") % 7).cast("string")).alias("text"))
    text = lambda x: F.lit(x).cast("string")

    def row(kind, label, target, confidence, **properties):
        pairs = [x for k, v in properties.items() for x in (F.lit(k), F.array(v))]
        given = F.create_map(*pairs) if pairs else F.create_map().cast("map<string, array<string>>")
        return F.struct(text(kind).alias("edge_type"), text(label).alias("target_type"), target.cast("string").alias("target_name"), text(confidence).alias("confidence"), text("said").alias("reason"), given.alias("properties"))

    n = F.col("doc_id")
    known = F.concat(F.lit(" BRAND#1"), (n % 5 + 1).cast("string"))
    minted = F.concat(F.when(n % 2 == 0, "Zz").otherwise("zZ"), (n % 3).cast("string"))
    said = F.array(
        row("USES", "Technology", known, '"high"', description=F.concat(F.lit("d"), (n % 4).cast("string")), name=F.lit("bad"), version=(n % 2).cast("string")),
        row("USES", "Technology", minted, "0.8", description=F.concat(F.lit("m"), n.cast("string"))),
        row("REFERENCES", "Ticket", F.concat(F.lit("TK-"), (n % 7).cast("string")), "0.9"),
        row("REFERENCES", "File", F.concat(F.lit("x/doc-"), (n - n % 2).cast("string")), "0.7"),
        row("REFERENCES", "File", F.lit("lost"), "0.7"),
        row("USES", "Technology", F.lit("weak"), '"none"'),
        row("CONTAINS", "File", F.lit("doc/0"), "1"),
    )
    inferred = docs.select(F.lit("File").alias("label"), "pk", said.alias("rows"), F.when(n % 10 == 9, "ValueError: no answer").alias("error"))
    patterns = [{"regex": r"TK-\d", "edge_type": "REFERENCES", "target_type": "Ticket"}]
    return store, lambda: pipeline.relate(store, units, Ontology(), inferred, None, patterns)


# brands that are known, unknown ones minted under the first spelling in the order of units, by document
_NOTES = r"""WITH d AS (SELECT doc_id AS n, 'doc/' || doc_id AS pk, 'Brand#1' || (doc_id % 5 + 1) AS brand, (CASE WHEN doc_id % 2 = 0 THEN 'Zz' ELSE 'zZ' END) || (doc_id % 3) AS minted FROM documents WHERE doc_id % 10 <> 9),
known AS (SELECT DISTINCT p_brand AS brand FROM part), heads AS (SELECT lower(minted) AS norm, arg_min(minted, pk) AS name, min(pk) AS first FROM d GROUP BY 1) """


@query(
    _NOTES + "SELECT pk AS src_pk, 'USES' AS edge_type, brand AS dst_pk, 'llm' AS method, 0.9 AS confidence FROM d UNION ALL SELECT pk, 'USES', name, 'llm', 0.8 FROM d JOIN heads ON norm = lower(minted) "
    "UNION ALL SELECT pk, 'REFERENCES', 'TK-' || n % 7, 'lexical', 1.0 FROM d UNION ALL SELECT pk, 'REFERENCES', 'doc/' || (n - n % 2), 'llm', 0.7 FROM d WHERE n % 2 = 1",
    graph=False,
)
def relate_edges(spark, sf_dir):
    store, job = _notes(spark, sf_dir)
    job()
    return store.edges().select("src_pk", "edge_type", "dst_pk", "method", "confidence")


@query(
    _NOTES + "SELECT brand AS name, NULL AS name_norm, 'known' AS description, v AS version, f AS fragments FROM known LEFT JOIN (SELECT brand, arg_max(n % 2, pk)::VARCHAR AS v FROM d GROUP BY 1) USING (brand) LEFT JOIN (SELECT brand, string_agg(x, '|' ORDER BY o) AS f FROM (SELECT brand, 'd' || n % 4 AS x, min(pk) AS o FROM d GROUP BY 1, 2) GROUP BY 1) USING (brand) "
    "UNION ALL SELECT h.name, h.norm, 'm' || substr(h.first, 5), NULL, f FROM heads h LEFT JOIN (SELECT norm, string_agg(x, '|' ORDER BY o) AS f FROM (SELECT lower(minted) AS norm, 'm' || n AS x, pk AS o FROM d JOIN heads ON norm = lower(minted) AND pk <> first QUALIFY row_number() OVER (PARTITION BY norm ORDER BY pk) <= 12) GROUP BY 1) f USING (norm)",
    graph=False,
)
def relate_entities(spark, sf_dir):
    store, job = _notes(spark, sf_dir)
    job()
    return store.nodes("Technology").select("name", "name_norm", "description", "version", F.array_join("description_fragments", "|").alias("fragments"))


@query(
    "SELECT 'doc/' || doc_id AS src_pk, unnest(CASE WHEN doc_id % 10 = 9 THEN [] WHEN doc_id % 2 = 0 THEN ['lexical edge is there', 'target is the source', 'target is unknown', 'low confidence', 'edge type cannot be written'] ELSE ['lexical edge is there', 'target is unknown', 'low confidence', 'edge type cannot be written'] END) AS drop_reason FROM documents",
    graph=False,
)
def relate_drops(spark, sf_dir):
    _, job = _notes(spark, sf_dir)
    return job().where("drop_reason IS NOT NULL").select("src_pk", "drop_reason")


@query("SELECT 'doc/' || doc_id AS path FROM documents WHERE doc_id % 10 <> 9", graph=False)
def relate_marks(spark, sf_dir):
    store, job = _notes(spark, sf_dir)
    job()
    return store.nodes("File").where("inferred_at IS NOT NULL").select("path")


@query("WITH t AS (SELECT user_id::VARCHAR AS u, string_agg('f' || event_id % 3, '; ' ORDER BY event_id) AS d, count(*) AS n FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 9) GROUP BY 1) SELECT 'Pattern' AS label, u AS pk, d AS description, d AS fragments FROM t WHERE n >= 6", graph=False)
def merged_descriptions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("r <= 9")
    pieces = rows.groupBy(F.col("user_id").cast("string").alias("name")).agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id"))), lambda x: F.concat(F.lit("f"), (x["event_id"] % 3).cast("string"))).alias("description_fragments"))
    return resolve.merge_due(GraphStore(spark, {"Pattern": pieces})).select("label", "pk", "description", F.array_join("description_fragments", "|").alias("fragments"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN repeat('b', 500) ELSE '' END AS reason FROM events", graph=False)
def reason_coerce(spark, sf_dir):
    n = F.col("event_id") % 3
    return table(spark, sf_dir, "events").select("event_id", resolve.reason(F.when(n == 0, "a").when(n == 1, F.repeat(F.lit("b"), 700))).alias("reason"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'description|version' ELSE '' END AS names FROM events", graph=False)
def property_whitelist(spark, sf_dir):
    n = F.col("event_id") % 3
    label = F.when(n == 0, "Ticket").when(n == 1, "Technology").otherwise("Nothing")
    given = F.create_map(*[x for k in ("created", "description", "hash", "name", "title", "version") for x in (F.lit(k), F.when((n == 0) & F.lit(k == "description"), F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))))])
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(resolve.whitelisted(given, label, Ontology()))), "|").alias("names"))


@query(
    "WITH w AS (SELECT p_partkey AS pk, unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) AS w FROM part), t AS (SELECT pk, w, count(*) AS c FROM w WHERE w <> '' GROUP BY 1, 2), l AS (SELECT pk, sum(c) AS n FROM t GROUP BY 1), s AS (SELECT count(*) AS docs, avg(n) AS mean FROM l), df AS (SELECT w, count(*) AS d FROM t GROUP BY 1), "
    "q AS (SELECT DISTINCT p_brand AS left_pk, lower(p_name) AS text FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1), qw AS (SELECT DISTINCT left_pk, unnest(regexp_split_to_array(text, '[^a-z0-9]+')) AS w FROM q), "
    "f AS (SELECT left_pk, pk, round(sum(ln(1 + (docs - d + 0.5) / (d + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM qw JOIN t USING (w) JOIN df USING (w) JOIN l USING (pk), s GROUP BY 1, 2) SELECT left_pk, rank, score FROM (SELECT left_pk, row_number() OVER (PARTITION BY left_pk ORDER BY score DESC) AS rank, score FROM f) WHERE rank <= 5",
    graph=False,
)
def bm25_each(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    queries = part.groupBy(F.col("p_brand").alias("left_pk")).agg(F.min_by("p_name", "p_partkey").alias("text"))
    found = search.matched_each(queries, part.select(F.col("p_partkey").alias("pk"), F.col("p_name").alias("text")), 5)
    return found.select("left_pk", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(
    ", files_of AS (SELECT 'conv/' || conv_id AS path, 'conv/' || conv_id || '#' || turn AS pk, turn FROM conversations), pairs AS (SELECT a.pk, b.pk AS target, b.turn FROM files_of a JOIN files_of b ON a.path = b.path AND a.pk <> b.pk) SELECT pk, place, target FROM (SELECT pk, target, row_number() OVER (PARTITION BY pk ORDER BY turn)::INT AS place FROM pairs) WHERE place <= 2"
)
def unit_neighbours(spark, sf_dir):
    store = load(spark, sf_dir)
    units = store.nodes("Section").select(F.lit("Section").alias("label"), F.col("id").alias("pk"), "path", "corpus", F.lit("-").alias("title"))
    return resolve.neighbours(store, units, section_cap=2).where("kind = 'section'").select("pk", "place", "target")


@query("SELECT 'conv/' || conv_id || '#' || turn AS id, CASE WHEN role <> 'user' AND turn > 0 THEN 'user' ELSE '' END AS chain FROM conversations", graph=False)
def parent_chain(spark, sf_dir):
    path = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"))
    parts = table(spark, sf_dir, "conversations").select(path.alias("path"), F.col("turn").cast("string").alias("anchor"), F.lit("user").alias("title"), F.when((F.col("role") != "user") & (F.col("turn") > 0), "0").alias("parent_anchor"), F.concat(path, F.lit("#"), F.col("turn").cast("string")).alias("id"))
    return pipeline.parent_chains(parts).select("id", F.array_join("chain", "|").alias("chain"))


# streams, in their batch form


def _changes(spark, sf_dir):
    return changes.as_changes(table(spark, sf_dir, "events"))


@query(
    "WITH b AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 14400 SECONDS THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR)), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) AS k FROM b) SELECT user_id::VARCHAR AS corpus, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(DISTINCT event_id) AS n_paths, count(*) AS n_events FROM g GROUP BY user_id, k",
    graph=False,
)
def debounce_sessions(spark, sf_dir):
    return changes.bursts(_changes(spark, sf_dir), 14400.0, 0).select("corpus", stamp("start").alias("start"), "n_paths", "n_events")


@query(
    "WITH b AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR epoch(ts) - epoch(lag(ts) OVER w) > 14400 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR)), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) AS k FROM b), a AS (SELECT *, floor((epoch(ts) - min(epoch(ts)) OVER (PARTITION BY user_id, k)) / 28800) AS p FROM g) SELECT user_id::VARCHAR AS corpus, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n_events FROM a GROUP BY user_id, k, p",
    graph=False,
)
def debounce_max_age(spark, sf_dir):
    return changes.bursts(_changes(spark, sf_dir), 14400.0, 28800.0).select("corpus", stamp("start").alias("start"), "n_events")


@query("WITH u AS (SELECT 'conv/' || conv_id AS path, count(*) AS n FROM conversations GROUP BY 1) SELECT path, n AS n_sections, 90.5 - coalesce(sum(greatest(1, n)) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 1 AS due FROM u", graph=False)
def sweep_budget(spark, sf_dir):
    units = load(spark, sf_dir).nodes("Section").groupBy("path").agg(F.count(F.lit(1)).alias("n_sections"))
    return changes.swept(units, 900.0, 0.1, 0.5)


@query("SELECT event_id::VARCHAR AS path, CASE WHEN event_id % 9 = 0 THEN 'reap' WHEN event_id % 2 = 0 THEN 'unchanged' ELSE 'index' END AS action FROM events", graph=False)
def stream_triage(spark, sf_dir):
    rows = _changes(spark, sf_dir).select("path")
    number = F.col("path").cast("long")
    here = rows.where(number % 9 != 0).withColumn("digest", F.lit("d"))
    known = rows.where(number % 2 == 0).withColumn("digest", F.lit("d"))
    return changes.triaged(rows, here, known).select("path", "action")


# compiled queries


def _cypher(name: str, text: str, sql: str, **parameters):
    def f(spark, sf_dir):
        return load(spark, sf_dir).exec_read(text, **parameters)

    f.__name__ = name
    query(sql)(f)


_cypher("cypher_top_services", "MATCH (t:Ticket)-[r:DEPENDS_ON]->(s:Service) WHERE t.status = $status RETURN s.name AS service, count(*) AS tickets, round(avg(r.confidence) * 1000) / 1000 AS confidence ORDER BY tickets DESC, service LIMIT 10", "SELECT dst_pk AS service, count(*) AS tickets, round(avg(confidence) * 1000) / 1000 AS confidence FROM edges JOIN nodes ON label = src_label AND pk = src_pk WHERE edge_type = 'DEPENDS_ON' AND status = 'F' GROUP BY 1 ORDER BY tickets DESC, service LIMIT 10", status="F")
_cypher("cypher_two_hops", f"MATCH (c:Client {{name: '{CLIENT}'}})<-[:BELONGS_TO]-(t:Ticket)-[:DEPENDS_ON]->(s:Service) RETURN DISTINCT t.id AS ticket, s.name AS service", f"SELECT DISTINCT b.src_pk AS ticket, d.dst_pk AS service FROM edges b JOIN edges d ON d.src_pk = b.src_pk AND d.edge_type = 'DEPENDS_ON' WHERE b.edge_type = 'BELONGS_TO' AND b.dst_pk = '{CLIENT}'")
_cypher("cypher_optional", "MATCH (f:File) WHERE f.corpus = 'conv' OPTIONAL MATCH (f)-[:CONTAINS]->(s:Section) WHERE s.title = 'user' RETURN f.path AS path, count(s) AS turns, min(s.ordinal) AS first", "SELECT path, count(n) AS turns, min(n)::INT AS first FROM files LEFT JOIN (SELECT 'conv/' || conv_id AS p, turn AS n FROM conversations WHERE role = 'user') ON p = path WHERE corpus = 'conv' GROUP BY path")
_cypher("cypher_chain", f"MATCH (t:Ticket {{id: '{ORDER}'}})-[:SUPERSEDES*1..3]->(o:Ticket) RETURN o.id AS older, o.status AS status", f", hop AS (SELECT src_pk AS a, dst_pk AS b FROM edges WHERE edge_type = 'SUPERSEDES'), p AS (SELECT b FROM hop WHERE a = '{ORDER}' UNION ALL SELECT y.b FROM hop x JOIN hop y ON y.a = x.b WHERE x.a = '{ORDER}' UNION ALL SELECT z.b FROM hop x JOIN hop y ON y.a = x.b JOIN hop z ON z.a = y.b WHERE x.a = '{ORDER}') SELECT pk AS older, status FROM p JOIN nodes ON label = 'Ticket' AND pk = b")
_cypher("cypher_anti", "MATCH (t:Ticket) WHERE NOT (t)-[:SUPERSEDES]->(:Ticket) AND t.status IN ['F', 'O'] RETURN t.status AS status, count(*) AS n ORDER BY status", "SELECT status, count(*) AS n FROM nodes WHERE label = 'Ticket' AND status IN ('F', 'O') AND pk NOT IN (SELECT src_pk FROM edges WHERE edge_type = 'SUPERSEDES') GROUP BY 1")
_cypher("cypher_with", "MATCH (s:Service)-[:USES]->(x:Technology) WITH s, count(x) AS n WHERE n >= 20 RETURN n AS brands, count(*) AS services ORDER BY brands", ", u AS (SELECT src_pk, count(*) AS n FROM edges WHERE edge_type = 'USES' GROUP BY 1 HAVING count(*) >= 20) SELECT n AS brands, count(*) AS services FROM u GROUP BY 1")
_cypher("cypher_degree", "MATCH (n:Service) RETURN n.name AS name, COUNT { (n)--() } AS degree ORDER BY degree DESC, name LIMIT 5", _DEGREE + "SELECT pk AS name, degree FROM degree WHERE label = 'Service' ORDER BY degree DESC, name LIMIT 5")
_cypher("cypher_case", "MATCH (a:Artifact) WHERE a.title STARTS WITH 'red' OR a.title CONTAINS 'ring' RETURN CASE WHEN a.reusable THEN 'yes' ELSE 'no' END AS reusable, toUpper(a.description) AS kind, count(DISTINCT a.title) AS titles", "SELECT CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE 'no' END AS reusable, upper(p_type) AS kind, count(DISTINCT p_name) AS titles FROM part WHERE starts_with(p_name, 'red') OR contains(p_name, 'ring') GROUP BY 1, 2")
_cypher("cypher_unwind", "UNWIND ['P', 'F'] AS s MATCH (t:Ticket) WHERE t.status = s RETURN s AS status, count(t) AS n", "SELECT status, count(*) AS n FROM nodes WHERE label = 'Ticket' AND status IN ('P', 'F') GROUP BY 1")


@query("SELECT 'Supplier' AS kind, s_name AS name, row_number() OVER (ORDER BY s_name) AS n FROM supplier QUALIFY n <= 3", graph=False)
def stored_query(spark, sf_dir):
    box = tools.Toolbox(load(spark, sf_dir), {"web.first": "MATCH (s:Service) RETURN $kind AS kind, s.name AS name ORDER BY name LIMIT 3"})
    return box.tools()["web.first"](kind="Supplier").withColumn("n", F.row_number().over(Window.orderBy("name")).cast("long"))

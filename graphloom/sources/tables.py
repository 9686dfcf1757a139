"""A property graph over the standard tables: documents, conversations, customers, suppliers, parts and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.store import GraphStore, dealt
from graphloom.schema import EDGE, conform, node_schema

#: The DuckDB SQL of the same graph; queries follow it.
SQL = """
WITH files AS (
  SELECT 'doc/' || doc_id AS path, 'doc-' || doc_id AS name, source AS corpus, md5(text) AS hash, n_chars AS size, text AS summary, TIMESTAMP '2024-01-01' + to_hours(doc_id::INT) AS updated FROM documents
  UNION ALL SELECT DISTINCT 'conv/' || conv_id, NULL, 'conv', NULL, NULL::BIGINT, NULL, NULL::TIMESTAMP FROM conversations
), sections AS (
  SELECT 'conv/' || conv_id || '#' || turn AS id, 'conv/' || conv_id AS path, turn::VARCHAR AS anchor, role AS title, turn::INT AS ordinal, 2 AS level, text AS summary FROM conversations
), nodes AS (
  SELECT 'File' AS label, path AS pk, corpus, path, NULL AS id, name, NULL AS title, summary, NULL AS description, NULL AS status, updated FROM files
  UNION ALL SELECT 'Section', id, 'conv', path, id, NULL, title, summary, NULL, NULL, NULL FROM sections
  UNION ALL SELECT 'Client', c_name, NULL, NULL, NULL, c_name, NULL, NULL, NULL, NULL, NULL FROM customer
  UNION ALL SELECT 'Service', s_name, NULL, NULL, NULL, s_name, NULL, NULL, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT DISTINCT 'Technology', p_brand, NULL, NULL, NULL, p_brand, NULL, NULL, NULL, NULL, NULL::TIMESTAMP FROM part
  UNION ALL SELECT 'Artifact', 'part/' || p_partkey, NULL, NULL, 'part/' || p_partkey, NULL, p_name, NULL, p_type, NULL, NULL FROM part
  UNION ALL SELECT 'Ticket', 'order/' || o_orderkey, NULL, NULL, 'order/' || o_orderkey, NULL, o_orderpriority, NULL, NULL, o_orderstatus, o_orderdate FROM orders
), followed AS (
  SELECT o_orderkey AS a, o_orderstatus AS sa, lag(o_orderkey) OVER w AS b, lag(o_orderstatus) OVER w AS sb FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
), copies AS (
  SELECT first.doc_id AS a, d.doc_id AS b, first.source AS sa, d.source AS sb FROM documents d JOIN (SELECT md5(text) AS h, min({'doc_id': doc_id, 'source': source}) AS first FROM documents GROUP BY 1) ON h = md5(d.text) AND first.doc_id < d.doc_id
), edges AS (
  SELECT 'File' AS src_label, 'conv/' || conv_id AS src_pk, 'CONTAINS' AS edge_type, 'Section' AS dst_label, 'conv/' || conv_id || '#' || turn AS dst_pk, 'structural' AS origin, NULL::DOUBLE AS confidence, NULL AS reason FROM conversations
  UNION ALL SELECT 'Section', 'conv/' || conv_id || '#' || p, 'NEXT_SIBLING', 'Section', 'conv/' || conv_id || '#' || turn, 'structural', NULL, NULL FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) WHERE p IS NOT NULL
  UNION ALL SELECT 'Ticket', 'order/' || o_orderkey, 'BELONGS_TO', 'Client', c_name, 'inferred', 1.0, 'ordered by' FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'Ticket', 'order/' || l_orderkey, 'DEPENDS_ON', 'Service', s_name, 'inferred', round(avg(l_discount) * 10, 6), NULL FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey, s_name
  UNION ALL SELECT DISTINCT 'Service', s_name, 'USES', 'Technology', p_brand, 'inferred', NULL::DOUBLE, NULL FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL SELECT 'Ticket', 'order/' || a, 'SUPERSEDES', 'Ticket', 'order/' || b, 'inferred', NULL, NULL FROM followed WHERE b IS NOT NULL
  UNION ALL SELECT 'Ticket', 'order/' || a, 'CONTRADICTS', 'Ticket', 'order/' || b, 'inferred', NULL, NULL FROM followed WHERE (sa = 'F' AND sb = 'O') OR (sa = 'O' AND sb = 'F')
  UNION ALL SELECT 'File', 'doc/' || a, 'SIMILAR_TO', 'File', 'doc/' || b, 'inferred', NULL, NULL FROM copies
  UNION ALL SELECT 'File', 'doc/' || b, 'NEEDS_UPDATE', 'File', 'doc/' || a, 'inferred', NULL, NULL FROM copies WHERE sa <> sb
)
"""


def load(spark: SparkSession, sf_dir: str) -> GraphStore:
    """The graph as a store; tables are read when a plan needs them, and labels or edge types it does not name are pruned."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    docs, talk, orders = t("documents"), t("conversations"), t("orders")
    files = docs.select(key("doc/", "doc_id").alias("path"), key("doc-", "doc_id").alias("name"), F.col("source").alias("corpus"), F.md5("text").alias("hash"), F.col("n_chars").alias("size"), F.col("text").alias("summary"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("updated"))
    talks = talk.select(key("conv/", "conv_id").alias("path"), F.lit("conv").alias("corpus")).distinct()
    turn = F.concat(key("conv/", "conv_id"), F.lit("#"), F.col("turn").cast("string"))
    sections = talk.select(turn.alias("id"), key("conv/", "conv_id").alias("path"), F.col("turn").cast("string").alias("anchor"), F.col("role").alias("title"), F.col("turn").alias("ordinal"), F.lit(2).alias("level"), F.col("text").alias("summary"), F.lit("conv").alias("corpus"))
    part, supplier, customer = t("part"), t("supplier"), t("customer")
    tables = {
        "File": conform(files, node_schema("File")).unionByName(conform(talks, node_schema("File"))),
        "Section": sections,
        "Client": customer.select(F.col("c_name").alias("name")),
        "Service": supplier.select(F.col("s_name").alias("name")),
        "Technology": part.select(F.col("p_brand").alias("name")).distinct(),
        "Artifact": part.select(key("part/", "p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("description"), (F.col("p_size") % 2 == 0).alias("reusable")),
        "Ticket": orders.select(key("order/", "o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").cast("timestamp").alias("updated")),
    }

    def edges(df: DataFrame, src, kind: str, dst, origin: str = "inferred", **more) -> DataFrame:
        columns = {"src_label": F.lit(src[0]), "src_pk": src[1], "edge_type": F.lit(kind), "dst_label": F.lit(dst[0]), "dst_pk": dst[1], "origin": F.lit(origin)} | more
        return conform(df.select(*[c.alias(n) for n, c in columns.items()]), EDGE)

    item = t("lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    supplied = dealt(item.select("l_orderkey", "s_name", "l_discount"), t("lineitem"), "l_orderkey")
    owned = dealt(orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name"), orders, "o_orderkey")
    before = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    followed = dealt(orders.select("o_orderkey", "o_orderstatus", "o_custkey", "o_orderdate"), orders, "o_custkey").select("o_orderkey", "o_orderstatus", F.lag("o_orderkey").over(before).alias("b"), F.lag("o_orderstatus").over(before).alias("sb")).where("b IS NOT NULL")
    hashed = docs.select("doc_id", "source", F.md5("text").alias("h"))
    # each copy is linked with its group's first alone: as many edges as copies
    first = hashed.groupBy("h").agg(F.min(F.struct("doc_id", "source")).alias("first"))
    copies = hashed.join(first, "h").where("first.doc_id < doc_id").select(F.col("first.doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("first.source").alias("sa"), F.col("source").alias("sb"))
    order, earlier = ("Ticket", key("order/", "o_orderkey")), ("Ticket", key("order/", "b"))
    turns = talk.withColumn("p", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))).where("p IS NOT NULL")
    every = [
        edges(talk, ("File", key("conv/", "conv_id")), "CONTAINS", ("Section", turn), "structural"),
        edges(turns, ("Section", F.concat(key("conv/", "conv_id"), F.lit("#"), F.col("p").cast("string"))), "NEXT_SIBLING", ("Section", turn), "structural"),
        edges(owned, order, "BELONGS_TO", ("Client", F.col("c_name")), confidence=F.lit(1.0), reason=F.lit("ordered by")),
        edges(supplied.groupBy("l_orderkey", "s_name").agg(F.round(F.avg("l_discount") * 10, 6).alias("c")), ("Ticket", key("order/", "l_orderkey")), "DEPENDS_ON", ("Service", F.col("s_name")), confidence=F.col("c")),
        edges(item.join(part, F.col("l_partkey") == F.col("p_partkey")).select("s_name", "p_brand").distinct(), ("Service", F.col("s_name")), "USES", ("Technology", F.col("p_brand"))),
        edges(followed, order, "SUPERSEDES", earlier),
        edges(followed.where("(o_orderstatus = 'F' AND sb = 'O') OR (o_orderstatus = 'O' AND sb = 'F')"), order, "CONTRADICTS", earlier),
        edges(copies, ("File", key("doc/", "a")), "SIMILAR_TO", ("File", key("doc/", "b"))),
        edges(copies.where("sa <> sb"), ("File", key("doc/", "b")), "NEEDS_UPDATE", ("File", key("doc/", "a"))),
    ]
    return GraphStore(spark, tables, reduce(DataFrame.unionByName, every))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pk (of a File) and embedding, kept apart from the nodes so that other queries never read it."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.concat(F.lit("doc/"), F.col("vec_id").cast("string")).alias("pk"), "embedding")

"""Columns of node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.ontology import MINTABLE, NODE_PROPERTIES, PRIMARY_KEY

# The types of properties that are not strings.
TYPES = {
    "size": "bigint", "updated": "timestamp", "created": "timestamp", "summary_generated_at": "timestamp", "inferred_at": "timestamp", "registered_at": "timestamp",
    "initialised_at": "timestamp", "start": "timestamp", "end": "timestamp", "level": "int", "ordinal": "int", "reusable": "boolean", "schema_version": "int", "node_count": "bigint",
    "edge_count": "bigint", "key_points": "array<string>", "entities_mentioned": "array<string>", "description_fragments": "array<string>", "examples": "array<string>",
    "embedding": "array<float>", "applied": "array<int>",
}
# Properties that phases write beside the declared ones.
EXTRA = {"File": ["inferred_at", "summary_input_hash"], "Section": ["hash", "inferred_at", "summary_input_hash"], "Corpus": ["node_count", "edge_count"], "Meta": ["applied"]}
_ELEMENTS = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def struct(fields: list[tuple[str, str]]) -> T.StructType:
    """A schema from names and types, also where no session runs to parse one."""
    kind = lambda t: T.ArrayType(kind(t[6:-1])) if t.startswith("array<") else _ELEMENTS[t]
    return T.StructType([T.StructField(name, kind(t)) for name, t in fields])


def fields(text: str) -> list[tuple[str, str]]:
    return [tuple(x.split()) for x in text.split(", ")]


ENTITY_EXTRA = ["name_norm", "embedding", "description_fragments", "corpus"]
EDGE = struct(fields("src_label string, src_pk string, edge_type string, dst_label string, dst_pk string, origin string, confidence double, reason string, method string"))
EDGE_KEY = ["src_label", "src_pk", "edge_type", "dst_label", "dst_pk"]
#: Columns of the view over all labels.
VIEW = struct(
    fields("label string, pk string, corpus string, path string, id string, name string, title string, summary string, description string, status string, updated timestamp, inferred_at timestamp")
)


def columns(label: str) -> list[str]:
    extra = EXTRA.get(label, []) + (ENTITY_EXTRA if label in MINTABLE else [])
    return NODE_PROPERTIES[label] + [c for c in extra if c not in NODE_PROPERTIES[label]]


def node_schema(label: str) -> T.StructType:
    return struct([(c, TYPES.get(c, "string")) for c in columns(label)])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the schema's columns; missing ones are null, and others are dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def as_view(df: DataFrame, label: str) -> DataFrame:
    """Rows of one label's table in the columns of VIEW, without its vectors."""
    have = df.withColumn("label", F.lit(label)).withColumn("pk", F.col(PRIMARY_KEY[label]).cast("string"))
    return conform(have, VIEW)


def shown(prefix: str = "") -> Column:
    """How results name a node: the path before the id before the name, so a section shows its file's path."""
    return F.coalesce(F.col(f"{prefix}path"), F.col(f"{prefix}id"), F.col(f"{prefix}name"))


def canonical_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")

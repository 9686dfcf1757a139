"""The fixed vocabulary of node labels, their keys and properties, and of edge types with their ends."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Node labels with their declared properties.
NODE_PROPERTIES = {
    "File": "path name type hash size updated embedding summary key_points entities_mentioned summary_generated_at corpus".split(),
    "Section": "id anchor title level path corpus file_id ordinal embedding summary key_points entities_mentioned summary_generated_at updated".split(),
    "Artifact": "id title description reusable created updated corpus".split(),
    "Ticket": "id title status description created updated corpus".split(),
    "Pattern": "name description when_to_use examples corpus".split(),
    "Technology": "name version description".split(),
    "Client": "name description".split(),
    "Repo": "name url description".split(),
    "Service": "name repo description".split(),
    "Integration": "name type description".split(),
    "Risk": "description severity corpus".split(),
    "WorkSession": "id start end focus_area description".split(),
    "Corpus": "name root registered_at content_profile".split(),
    "Meta": "schema_version engine_version backend_name initialised_at".split(),
}
# The property that identifies a node of each label.
PRIMARY_KEY = {
    "File": "path", "Section": "id", "Artifact": "id", "Ticket": "id", "Pattern": "name", "Technology": "name", "Client": "name", "Repo": "name",
    "Service": "name", "Integration": "name", "Risk": "description", "WorkSession": "id", "Corpus": "name", "Meta": "schema_version",
}
# Edge types with the labels allowed at their source and destination; none means any.
EDGE_ENDS = {
    "CONTAINS": ("File", "Section"),
    "PARENT_OF": ("Section", "Section"),
    "NEXT_SIBLING": ("Section", "Section"),
    "BELONGS_TO": ("File Section Artifact Ticket Pattern Service", "Client Service Repo Ticket"),
    "CREATED_BY": ("File Section Artifact Ticket Repo", "Client WorkSession"),
    "DOCUMENTS": ("File Section Artifact", ""),
    "DOCUMENTED_IN": ("", "File Section Artifact"),
    "APPLIES_TO": ("Pattern Risk Ticket Artifact", ""),
    "PART_OF": ("", "Artifact Service Repo File Section"),
    "SIMILAR_TO": ("", ""),
    "RELATED_TO": ("", ""),
    "REFERENCES": ("File Section Artifact", ""),
    "SUPERSEDES": ("File Section Ticket Artifact Pattern", "File Section Ticket Artifact Pattern"),
    "CONTRADICTS": ("File Section Ticket Artifact Pattern", "File Section Ticket Artifact Pattern"),
    "USES": ("File Section Service Pattern Artifact Repo", "Technology Pattern Service Integration Artifact"),
    "MODIFIES": ("File Section Ticket WorkSession", "File Section Artifact Service"),
    "DEPENDS_ON": ("File Section Service Artifact Ticket Pattern", "File Section Service Technology Artifact Pattern Integration"),
    "IDENTIFIES_RISK": ("File Section Ticket Pattern Artifact", "Risk"),
    "RECOMMENDS": ("File Section Ticket Artifact", "Pattern Technology Artifact"),
    "EDITED_DURING": ("File Section Artifact", "WorkSession"),
    "VERIFIED_ON": ("", "WorkSession Technology"),
    "NEEDS_UPDATE": ("File Section Artifact", ""),
}
ORIGINS = ("inferred", "structural", "manual")
STRUCTURAL = frozenset(("CONTAINS", "PARENT_OF", "NEXT_SIBLING"))
ENUMERATED = frozenset(("File", "Section"))
NOT_ENTITY = ENUMERATED | {"Corpus", "Meta"}
MINTABLE = frozenset(NODE_PROPERTIES) - NOT_ENTITY
TARGETS = MINTABLE | ENUMERATED
FRESHNESS = ("SUPERSEDES", "CONTRADICTS", "NEEDS_UPDATE")
#: Labels whose names are compared without case.
CASELESS = frozenset("Pattern Technology Client Risk Service Integration".split())
# Properties that the system writes and inference may not.
SYSTEM = frozenset(
    "path name id anchor level file_id ordinal corpus updated created registered_at root content_profile embedding name_norm description_fragments "
    "summary key_points summary_generated_at summary_confidence entities_mentioned hash size schema_version engine_version backend_name initialised_at start end".split()
)
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def identifier(name: str) -> str:
    """name, if it is safe as a label, type or property name."""
    if not _IDENTIFIER.fullmatch(name):
        raise ValueError(f"unsafe identifier: {name!r}")
    return name


@dataclass(frozen=True)
class Ontology:
    """The vocabulary with a corpus's own aliases of labels and edge types."""

    node_aliases: dict[str, str] = field(default_factory=dict)
    edge_aliases: dict[str, str] = field(default_factory=dict)
    nodes: dict[str, list[str]] = field(default_factory=lambda: dict(NODE_PROPERTIES))
    edges: dict[str, tuple[list[str], list[str]]] = field(default_factory=lambda: {k: (a.split(), b.split()) for k, (a, b) in EDGE_ENDS.items()})

    @classmethod
    def load(cls, raw: dict) -> Ontology:
        """From {node_types, edge_types, node_aliases, edge_aliases}; an edge type is {src, dst}, or a list of labels
        for both ends. Aliases replace earlier ones."""
        ends = {}
        for name, value in raw.get("edge_types", {}).items():
            src, dst = (value, value) if isinstance(value, list) else (value.get("src", []), value.get("dst", []))
            ends[identifier(name)] = (list(src), list(dst))
        nodes = {identifier(k): list(v) for k, v in raw.get("node_types", {}).items()}
        base = cls(raw.get("node_aliases", {}), raw.get("edge_aliases", {}))
        return cls(base.node_aliases, base.edge_aliases, nodes or base.nodes, ends or base.edges)

    def label(self, name: str) -> str:
        return self.node_aliases.get(name, name)

    def edge_type(self, name: str) -> str:
        return self.edge_aliases.get(name, name)

    @property
    def emittable(self) -> frozenset[str]:
        """Edge types that inference may write."""
        return frozenset(self.edges) - STRUCTURAL

    def validate_triple(self, src: str, edge_type: str, dst: str) -> bool:
        ends = self.edges.get(self.edge_type(edge_type))
        return ends is not None and all(not allowed or self.label(x) in allowed for x, allowed in zip((src, dst), ends, strict=True))

    def validate_node(self, label: str, properties: dict) -> None:
        declared = self.nodes.get(self.label(label))
        if declared is None:
            raise ValueError(f"unknown label {label!r}")
        if unknown := set(properties) - set(declared):
            raise ValueError(f"{label} has no property {', '.join(sorted(unknown))}")

    def validate_edge(self, src: str, edge_type: str, dst: str) -> None:
        if not self.validate_triple(src, edge_type, dst):
            raise ValueError(f"({src})-[{edge_type}]->({dst}) is not allowed")

    def content_properties(self, label: str) -> list[str]:
        """What inference may write on a node: its declared properties but the system's."""
        return [p for p in self.nodes.get(label, []) if p not in SYSTEM]

    def constraints(self, spark: SparkSession) -> DataFrame:
        """edge_type, src, dst (arrays of labels; empty means any): one row per edge type, 22 in the fixed vocabulary."""
        return spark.createDataFrame([(k, a, b) for k, (a, b) in sorted(self.edges.items())], "edge_type string, src array<string>, dst array<string>")

    def resolved(self, name: Column, edges: bool = False) -> Column:
        """A column of names with aliases resolved; other names stay."""
        aliases = self.edge_aliases if edges else self.node_aliases
        if not aliases:
            return name
        table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        return F.coalesce(F.try_element_at(table, name), name)

    def allowed(self, df: DataFrame, src: str = "src_label", edge_type: str = "edge_type", dst: str = "dst_label") -> DataFrame:
        """Adds allowed: whether the triple of each row keeps to the constraints, with aliases resolved."""
        ends = F.broadcast(self.constraints(df.sparkSession).select(F.col("edge_type").alias("_t"), F.col("src").alias("_s"), F.col("dst").alias("_d")))
        joined = df.join(ends, self.resolved(F.col(edge_type), edges=True) == F.col("_t"), "left")
        fits = lambda allowed, label: (F.size(allowed) == 0) | F.array_contains(allowed, self.resolved(F.col(label)))
        return joined.withColumn("allowed", F.coalesce(fits("_s", src) & fits("_d", dst), F.lit(False))).drop("_t", "_s", "_d")

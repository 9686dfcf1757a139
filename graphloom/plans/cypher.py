"""A read-only subset of Cypher compiled to DataFrames.

A text becomes tokens, clauses and expressions; each clause turns a table of bound variables into another. A variable's
columns are those that the query names, so scans read no others. Catalyst does the rest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.ontology import PRIMARY_KEY
from graphloom.schema import columns

WRITES = re.compile(r"(?<![.\w])(CREATE|MERGE|DELETE|SET|REMOVE|DROP|DETACH|FOREACH)\b", re.I)
#: The most steps of a path of variable length.
STEPS = 5
AGGREGATES = frozenset("count collect sum avg min max".split())
TOKEN = re.compile(r"\s+|//[^\n]*|/\*.*?\*/|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+\.\d+(?:[eE][-+]?\d+)?|\d+)|(?P<par>\$\w+)|(?P<name>`[^`]+`|[^\W\d]\w*)|(?P<op><>|<=|>=|=~|\.\.|->|<-|[-+*/%^=<>()\[\]{},.:;|])", re.S)
CLAUSES = frozenset("MATCH OPTIONAL WHERE WITH RETURN UNWIND ORDER SKIP LIMIT UNION".split())


class CypherError(ValueError):
    pass


def assert_read_only(query: str) -> None:
    """Refuse texts that name a writing clause, even inside a string."""
    if m := WRITES.search(query):
        raise CypherError(f"{m[1].upper()} is not allowed: queries only read")


def extract_query(text: str) -> str:
    """The query in a translator's answer: what a fence holds, or all from the first line that starts a clause."""
    if m := re.search(r"```[^\n]*\n(.*?)```", text, re.S):
        return m[1].strip()
    lines = text.strip().splitlines()
    start = next((i for i, x in enumerate(lines) if re.match(r"\s*(MATCH|OPTIONAL|WITH|UNWIND|RETURN|CALL)\b", x, re.I)), None)
    if start is None:
        raise CypherError("no query in the answer")
    return "\n".join(lines[start:]).strip()


def inject_corpus(query: str, corpus: str) -> str:
    """The query with its first labelled node held to one corpus."""
    if not re.fullmatch(r"[\w.-]+", corpus):
        raise CypherError(f"bad corpus name {corpus!r}")
    m = re.search(r"\(\s*\w*\s*:\s*\w+\s*(\{)?", query)
    if m is None:
        return query
    return f"{query[: m.end()]}corpus: '{corpus}', {query[m.end() :]}" if m[1] else f"{query[: m.end()].rstrip()} {{corpus: '{corpus}'}}{query[m.end() :]}"


@dataclass
class Node:
    var: str
    labels: list[str]
    props: dict


@dataclass
class Rel:
    var: str
    types: list[str]
    direction: str  # out, in, both
    low: int | None = None
    high: int | None = None
    props: dict = field(default_factory=dict)


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise CypherError(f"unexpected {text[at : at + 10]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0
        self.fresh = 0

    # tokens

    def peek(self, ahead: int = 0) -> str:
        kind, text = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        return text.upper() if kind == "name" else text

    def kind(self) -> str:
        return self.tokens[self.at][0]

    def take(self, *texts: str) -> bool:
        if self.kind() not in ("str", "end") and self.peek() in texts:
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise CypherError(f"expected {text}, found {self.tokens[self.at][1]!r}")

    def name(self) -> str:
        kind, text = self.tokens[self.at]
        if kind != "name":
            raise CypherError(f"expected a name, found {text!r}")
        self.at += 1
        return text.strip("`")

    # clauses

    def query(self) -> list[tuple]:
        out = []
        while self.kind() != "end":
            if self.take(";"):
                continue
            optional = self.take("OPTIONAL")
            if self.take("MATCH"):
                patterns = [self.pattern()]
                while self.take(","):
                    patterns.append(self.pattern())
                out.append(("match", optional, patterns, self.expression() if self.take("WHERE") else None))
            elif self.take("UNWIND"):
                value = self.expression()
                self.need("AS")
                out.append(("unwind", value, self.name()))
            elif self.peek() in ("WITH", "RETURN"):
                final = self.peek() == "RETURN"
                self.at += 1
                out.append(self.projection(final))
            else:
                raise CypherError(f"unexpected {self.tokens[self.at][1]!r}")
        if not out or out[-1][0] != "project" or not out[-1][1]:
            raise CypherError("a query ends in RETURN")
        return out

    def projection(self, final: bool) -> tuple:
        distinct, items, star = self.take("DISTINCT"), [], False
        while True:
            if self.take("*"):
                star = True
            else:
                begin = self.at
                value = self.expression()
                shown = "".join(t if i == 0 or t in ".)(" or self.tokens[begin + i - 1][1] in ".(" else f" {t}" for i, (_, t) in enumerate(self.tokens[begin : self.at]))
                items.append((value, self.name() if self.take("AS") else shown))
            if not self.take(","):
                break
        order, skip, limit, where = [], None, None, None
        if self.take("ORDER"):
            self.need("BY")
            while True:
                value = self.expression()
                down = self.take("DESC", "DESCENDING")
                if not down:
                    self.take("ASC", "ASCENDING")
                order.append((value, down))
                if not self.take(","):
                    break
        if self.take("SKIP"):
            skip = self.expression()
        if self.take("LIMIT"):
            limit = self.expression()
        if self.take("WHERE"):
            where = self.expression()
        return ("project", final, distinct, items, star, order, skip, limit, where)

    # patterns

    def pattern(self) -> list:
        out: list = [self.node()]
        while self.peek() in ("-", "<-", "<"):
            out.append(self.rel())
            out.append(self.node())
        return out

    def _var(self) -> str:
        if self.kind() == "name":
            return self.name()
        self.fresh += 1
        return f"_v{self.fresh}"

    def node(self) -> Node:
        self.need("(")
        var, labels = self._var(), []
        while self.take(":") or (labels and self.take("|")):
            labels.append(self.name())
        props = self.map() if self.peek() == "{" else {}
        self.need(")")
        return Node(var, labels, props)

    def map(self) -> dict:
        self.need("{")
        out = {}
        while not self.take("}"):
            key = self.name()
            self.need(":")
            out[key] = self.expression()
            self.take(",")
        return out

    def rel(self) -> Rel:
        left = self.take("<-")
        if not left:
            self.need("-")
        rel = Rel("", [], "both")
        if self.take("["):
            rel.var = self._var()
            while self.take(":", "|"):
                if self.kind() == "name":
                    rel.types.append(self.name())
            if self.take("*"):
                rel.low, rel.high = 1, STEPS
                if self.kind() == "num":
                    rel.low = rel.high = int(self._number())
                    if self.take(".."):
                        rel.high = int(self._number()) if self.kind() == "num" else STEPS
                elif self.take(".."):
                    rel.high = int(self._number())
                if rel.high > STEPS:
                    raise CypherError(f"paths have at most {STEPS} steps")
            if self.peek() == "{":
                rel.props = self.map()
            self.need("]")
        else:
            self.fresh += 1
            rel.var = f"_v{self.fresh}"
        right = self.take("->")
        if not right:
            self.need("-")
        rel.direction = "in" if left and not right else "out" if right and not left else "both"
        return rel

    def _number(self) -> str:
        text = self.tokens[self.at][1]
        self.at += 1
        return text

    # expressions

    def expression(self):
        left = self.conjunction()
        while self.peek() in ("OR", "XOR") and self.kind() == "name":
            op = self.peek()
            self.at += 1
            left = (op, left, self.conjunction())
        return left

    def conjunction(self):
        left = self.negation()
        while self.take("AND"):
            left = ("AND", left, self.negation())
        return left

    def negation(self):
        return ("NOT", self.negation()) if self.take("NOT") else self.comparison()

    def comparison(self):
        left = self.sum()
        while True:
            if self.kind() == "op" and self.peek() in ("=", "<>", "<", ">", "<=", ">=", "=~"):
                op = self.peek()
                self.at += 1
                left = (op, left, self.sum())
            elif self.take("IN"):
                left = ("IN", left, self.sum())
            elif self.take("CONTAINS"):
                left = ("CONTAINS", left, self.sum())
            elif self.peek() in ("STARTS", "ENDS") and self.kind() == "name":
                op = self.peek()
                self.at += 1
                self.need("WITH")
                left = (op, left, self.sum())
            elif self.take("IS"):
                no = self.take("NOT")
                self.need("NULL")
                left = ("NOT NULL" if no else "NULL", left)
            else:
                return left

    def sum(self):
        left = self.product()
        while self.kind() == "op" and self.peek() in ("+", "-"):
            op = self.peek()
            self.at += 1
            left = (op, left, self.product())
        return left

    def product(self):
        left = self.atom()
        while self.kind() == "op" and self.peek() in ("*", "/", "%"):
            op = self.peek()
            self.at += 1
            left = (op, left, self.atom())
        return left

    def _is_pattern(self) -> bool:
        """Whether a parenthesis opens a node of a pattern predicate."""
        depth, i = 0, self.at
        while i < len(self.tokens):
            text = self.tokens[i][1]
            depth += (text == "(") - (text == ")")
            i += 1
            if not depth:
                break
        after = [t for _, t in self.tokens[i : i + 2]]
        return after[:1] == ["<-"] or (after[:1] == ["-"] and after[1:2] in (["["], ["-"], ["->"], ["("]))

    def atom(self):
        kind, text = self.tokens[self.at]
        if kind == "str":
            self.at += 1
            return ("lit", re.sub(r"\\(.)", r"\1", text[1:-1]))
        if kind == "num":
            self.at += 1
            return ("lit", float(text) if "." in text else int(text))
        if kind == "par":
            self.at += 1
            return ("param", text[1:])
        if self.take("-"):
            return ("-", ("lit", 0), self.atom())
        if text == "(":
            if self._is_pattern():
                return ("pattern", self.pattern())
            self.at += 1
            inner = self.expression()
            self.need(")")
            return self.trailing(inner)
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.expression())
                self.take(",")
            return self.trailing(("list", items))
        word = self.peek()
        if word in ("TRUE", "FALSE", "NULL"):
            self.at += 1
            return ("lit", {"TRUE": True, "FALSE": False, "NULL": None}[word])
        if word == "CASE":
            return self.case()
        if word in ("COUNT", "EXISTS") and self.peek(1) == "{":
            self.at += 2
            self.take("MATCH")
            pattern = self.pattern()
            self.need("}")
            return ("COUNT{}", pattern) if word == "COUNT" else ("pattern", pattern)
        name = self.name()
        if self.take("("):
            if name.lower() in ("any", "all", "none") and self.peek(1) == "IN":
                var = self.name()
                self.need("IN")
                source = self.expression()
                self.need("WHERE")
                test = self.expression()
                self.need(")")
                return (name.lower(), var, source, test)
            distinct, args = self.take("DISTINCT"), []
            if self.take("*"):
                args.append(("lit", 1))
            while not self.take(")"):
                args.append(self.expression())
                self.take(",")
            return self.trailing(("call", name.lower(), distinct, args))
        return self.trailing(("var", name))

    def trailing(self, value):
        while True:
            if self.peek() == "." and self.kind() == "op":
                self.at += 1
                value = ("prop", value, self.name())
            elif self.peek() == "[" and self.kind() == "op":
                self.at += 1
                index = self.expression()
                self.need("]")
                value = ("item", value, index)
            else:
                return value

    def case(self):
        self.need("CASE")
        subject = None if self.peek() == "WHEN" else self.expression()
        branches, other = [], None
        while self.take("WHEN"):
            test = self.expression()
            self.need("THEN")
            branches.append((test if subject is None else ("=", subject, test), self.expression()))
        if self.take("ELSE"):
            other = self.expression()
        self.need("END")
        return ("case", branches, other)


def walk(tree):
    """Every tuple below and including tree."""
    if isinstance(tree, tuple):
        yield tree
        for x in tree:
            yield from walk(x)
    elif isinstance(tree, list):
        for x in tree:
            yield from walk(x)
    elif isinstance(tree, dict):
        for x in tree.values():
            yield from walk(x)
    elif isinstance(tree, Node | Rel):
        yield from walk(tree.props)


EDGE_FIELDS = ("src_label", "src_pk", "edge_type", "dst_label", "dst_pk", "origin", "confidence", "reason", "method")


class Compiler:
    def __init__(self, store, parameters: dict):
        self.store, self.parameters = store, parameters
        self.kinds: dict[str, str] = {}  # variable -> node, rel, value
        self.props: dict[str, set[str]] = {}

    def run(self, query: str) -> DataFrame:
        assert_read_only(query)
        clauses = Parser(query).query()
        self._uses(clauses)
        table: DataFrame | None = None
        for clause in clauses:
            table = getattr(self, clause[0])(table, *clause[1:])
        return table

    def _uses(self, clauses) -> None:
        """What each variable is asked for, so that its columns are those alone."""
        for tree in walk(clauses):
            if tree[0] == "prop" and tree[1][0] == "var":
                self.props.setdefault(tree[1][1], set()).add(tree[2])
            if tree[0] == "call" and tree[1] == "properties" or tree[0] == "project":
                whole = [a for a in (tree[3] if tree[0] == "call" else [v for v, _ in tree[3]]) if a[0] == "var"]
                for a in whole:
                    self.props.setdefault(a[1], set()).add("*")
        carried = True
        while carried:  # WITH n AS m asks n for what m is asked
            carried = False
            for tree in walk(clauses):
                if tree[0] == "project":
                    for value, name in tree[3]:
                        if value[0] == "var" and value[1] != name and not self.props.get(name, set()) <= self.props.setdefault(value[1], set()):
                            self.props[value[1]] |= self.props[name]
                            carried = True

    # tables of bindings

    def scan(self, node: Node) -> DataFrame:
        wanted = self.props.get(node.var, set()) | set(node.props)
        labels = node.labels or list(self.store._nodes)
        if "*" in wanted:
            wanted = {c for x in labels if x in PRIMARY_KEY for c in columns(x)} - {"embedding"} | wanted - {"*"}
        frames = []
        for label in labels:
            if label in self.store._nodes:
                df = self.store.nodes(label)
                have = set(df.columns)
                cols = [(F.col(p) if p in have else F.lit(None)).cast(self._type(p)).alias(f"{node.var}__{p}") for p in sorted(wanted)]
                frames.append(df.select(F.lit(label).alias(f"{node.var}__label"), F.col(PRIMARY_KEY[label]).cast("string").alias(f"{node.var}__pk"), *cols))
        if not frames:
            types = ", ".join(f"`{node.var}__{p}` {self._type(p)}" for p in sorted(wanted))
            return self.store.spark.createDataFrame([], f"`{node.var}__label` string, `{node.var}__pk` string" + (", " + types if types else ""))
        out = reduce(DataFrame.unionByName, frames)
        for key, value in node.props.items():
            out = out.where(F.col(f"{node.var}__{key}") == self.value(value, None))
        return out

    @staticmethod
    def _type(prop: str) -> str:
        from graphloom.schema import TYPES

        return TYPES.get(prop, "string")

    def hops(self, rel: Rel) -> DataFrame:
        """from_label, from_pk, to_label, to_pk and the relationship's columns, in the pattern's direction."""
        edges = self.store.edges(*rel.types)
        for key, value in rel.props.items():
            edges = edges.where(F.col(key) == self.value(value, None))
        v = rel.var
        cols = [F.col(c).alias(f"{v}__{c}") for c in EDGE_FIELDS]
        turn = lambda a, b: [F.col(f"{a}_label").alias("from_label"), F.col(f"{a}_pk").alias("from_pk"), F.col(f"{b}_label").alias("to_label"), F.col(f"{b}_pk").alias("to_pk")]
        if rel.direction == "out":
            return edges.select(*turn("src", "dst"), *cols)
        back = edges.select(*turn("dst", "src"), *cols)
        if rel.direction == "in":
            return back
        return edges.select(*turn("src", "dst"), *cols).unionByName(back.where("NOT (from_label = to_label AND from_pk = to_pk)"))

    @staticmethod
    def edge_key(prefix: str) -> Column:
        return F.concat_ws("\x01", *[F.col(f"{prefix}__{c}") for c in EDGE_FIELDS[:5]])

    def expand(self, table: DataFrame, a: Node, rel: Rel, b: Node) -> DataFrame:
        at = (F.col(f"{a.var}__label") == F.col("from_label")) & (F.col(f"{a.var}__pk") == F.col("from_pk"))
        if rel.low is None:
            table = table.join(self.hops(rel), at).drop("from_label", "from_pk")
            self.kinds[rel.var] = "rel"
        else:
            step = self.hops(Rel("_s", rel.types, rel.direction, props=rel.props)).select("from_label", "from_pk", "to_label", "to_pk", self.edge_key("_s").alias("_key"))
            path = table.join(step, at).drop("from_label", "from_pk").withColumn("_path", F.array("_key")).drop("_key")
            found = [path] if rel.low <= 1 else []
            for n in range(2, rel.high + 1):
                more = step.select(F.col("from_label").alias("_fl"), F.col("from_pk").alias("_fp"), F.col("to_label").alias("_tl"), F.col("to_pk").alias("_tp"), "_key")
                path = path.join(more, (F.col("to_label") == F.col("_fl")) & (F.col("to_pk") == F.col("_fp")) & ~F.array_contains("_path", F.col("_key")))
                path = path.drop("to_label", "to_pk", "_fl", "_fp").withColumnsRenamed({"_tl": "to_label", "_tp": "to_pk"}).withColumn("_path", F.concat("_path", F.array("_key"))).drop("_key")
                if n >= rel.low:
                    found.append(path)
            table = reduce(DataFrame.unionByName, found).withColumnRenamed("_path", f"{rel.var}__path")
            self.kinds[rel.var] = "path"
        if f"{b.var}__pk" in table.columns:
            table = table.where((F.col("to_label") == F.col(f"{b.var}__label")) & (F.col("to_pk") == F.col(f"{b.var}__pk")))
        else:
            there = self.scan(b)
            table = table.join(there, (F.col("to_label") == F.col(f"{b.var}__label")) & (F.col("to_pk") == F.col(f"{b.var}__pk")))
            self.kinds[b.var] = "node"
        return table.drop("to_label", "to_pk")

    def bound(self, table: DataFrame | None, node: Node) -> DataFrame:
        if table is not None and f"{node.var}__pk" in table.columns:
            for label in node.labels[:1]:
                table = table.where(F.col(f"{node.var}__label").isin(*node.labels) if len(node.labels) > 1 else F.col(f"{node.var}__label") == label)
            for key, value in node.props.items():
                table = table.where(F.col(f"{node.var}__{key}") == self.value(value, table))
            return table
        self.kinds[node.var] = "node"
        found = self.scan(node)
        return found if table is None else table.crossJoin(found)

    def patterns(self, table: DataFrame | None, patterns: list) -> DataFrame:
        rels: list[str] = []
        for pattern in patterns:
            if table is not None and f"{pattern[0].var}__pk" not in table.columns and f"{pattern[-1].var}__pk" in table.columns:
                flip = {"out": "in", "in": "out", "both": "both"}
                pattern = [Rel(x.var, x.types, flip[x.direction], x.low, x.high, x.props) if isinstance(x, Rel) else x for x in reversed(pattern)]
            table = self.bound(table, pattern[0])
            for a, rel, b in zip(pattern[::2], pattern[1::2], pattern[2::2], strict=False):
                table = self.expand(table, a, rel, b)
                if rel.low is None:
                    for other in rels:
                        table = table.where(self.edge_key(other) != self.edge_key(rel.var))
                    rels.append(rel.var)
        return table

    def match(self, table: DataFrame | None, optional: bool, patterns: list, where) -> DataFrame:
        if not optional or table is None:
            table = self.patterns(table, patterns)
            return table if where is None else self.filter(table, where)
        names = [x.var for p in patterns for x in p if isinstance(x, Node)]
        shared = [v for v in dict.fromkeys(names) if f"{v}__pk" in table.columns]
        found = self.patterns(None, patterns)
        same = F.lit(True)
        for v in shared:
            found = found.withColumnsRenamed({f"{v}__label": f"_o_{v}__label", f"{v}__pk": f"_o_{v}__pk"}).drop(*[c for c in found.columns if c.startswith(f"{v}__") and c in table.columns and not c.endswith(("__label", "__pk"))])
            same = same & (F.col(f"{v}__label") == F.col(f"_o_{v}__label")) & (F.col(f"{v}__pk") == F.col(f"_o_{v}__pk"))
        if where is not None:
            same = same & self.value(where, None)
        return table.join(found, same, "left").drop(*[c for c in found.columns if c.startswith("_o_")])

    def filter(self, table: DataFrame, where) -> DataFrame:
        """Keep rows; patterns among the conjuncts are semi or anti joins, counts of patterns a joined column."""
        if where[0] == "AND":
            return self.filter(self.filter(table, where[1]), where[2])
        if where[0] == "pattern" or (where[0] == "NOT" and where[1][0] == "pattern"):
            pattern = where[1] if where[0] == "pattern" else where[1][1]
            keys, found = self.keyed(table, pattern)
            return table.join(found.distinct(), keys, "left_semi" if where[0] == "pattern" else "left_anti")
        table, where = self.counted(table, where)
        return table.where(self.value(where, table)).drop(*[c for c in table.columns if c.startswith("_n_")])

    def keyed(self, table: DataFrame, pattern: list) -> tuple[list[str], DataFrame]:
        found = self.patterns(None, [pattern])
        shared = [x.var for x in pattern if isinstance(x, Node) and f"{x.var}__pk" in table.columns]
        if not shared:
            raise CypherError("a pattern predicate shares no variable with the query")
        keys = [f"{v}__{c}" for v in dict.fromkeys(shared) for c in ("label", "pk")]
        return keys, found.select(*keys)

    def counted(self, table: DataFrame, tree) -> tuple[DataFrame, object]:
        """table with a column for each count of a pattern in tree, and tree with those columns in their place."""
        if isinstance(tree, tuple) and tree and tree[0] == "COUNT{}":
            keys, found = self.keyed(table, tree[1])
            name = f"_n_{len([c for c in table.columns if c.startswith('_n_')])}"
            table = table.join(found.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))
            return table, ("column", name)
        if isinstance(tree, tuple | list):
            out = []
            for x in tree:
                table, y = self.counted(table, x) if isinstance(x, tuple | list) else (table, x)
                out.append(y)
            return table, type(tree)(out)
        return table, tree

    def unwind(self, table: DataFrame | None, value, name: str) -> DataFrame:
        table = table if table is not None else self.store.spark.range(1).drop("id")
        self.kinds[name] = "value"
        return table.withColumn(name, F.explode(self.value(value, table)))

    # expressions

    def value(self, tree, table: DataFrame | None) -> Column:
        op = tree[0]
        if op == "lit":
            return F.lit(tree[1])
        if op == "column":
            return F.col(tree[1])
        if op == "param":
            if tree[1] not in self.parameters:
                raise CypherError(f"missing parameter ${tree[1]}")
            given = self.parameters[tree[1]]
            return F.array(*map(F.lit, given)) if isinstance(given, list) else F.lit(given)
        if op == "local":
            return tree[1]
        if op == "var":
            return self.whole(tree[1])
        if op == "prop":
            if tree[1][0] != "var":
                return self.value(tree[1], table)[tree[2]]
            v, prop = tree[1][1], tree[2]
            if self.kinds.get(v) in ("node", "rel"):
                return F.col(f"{v}__{prop}")
            return F.col(v)[prop]
        if op == "list":
            return F.array(*[self.value(x, table) for x in tree[1]])
        if op == "item":
            return F.get(self.value(tree[1], table), self.value(tree[2], table))
        if op in ("AND", "OR"):
            a, b = self.value(tree[1], table), self.value(tree[2], table)
            return a & b if op == "AND" else a | b
        if op == "XOR":
            return self.value(tree[1], table) != self.value(tree[2], table)
        if op == "NOT":
            return ~self.value(tree[1], table)
        if op == "NULL":
            return self.value(tree[1], table).isNull()
        if op == "NOT NULL":
            return self.value(tree[1], table).isNotNull()
        if op == "case":
            out = None
            for test, then in tree[1]:
                out = F.when(self.value(test, table), self.value(then, table)) if out is None else out.when(self.value(test, table), self.value(then, table))
            return out if tree[2] is None else out.otherwise(self.value(tree[2], table))
        if op in ("any", "all", "none"):
            source = self.value(tree[2], table)
            test = lambda x: self.value(_with_local(tree[3], tree[1], x), table)
            return F.forall(source, test) if op == "all" else F.exists(source, test) if op == "any" else ~F.exists(source, test)
        if op == "call":
            return self.call(tree[1], tree[2], tree[3], table)
        if op == "pattern":
            raise CypherError("a pattern stands only as a condition of its own")
        if op in ("=", "<>") and any(x[0] == "call" and x[1] in ("startnode", "endnode") for x in tree[1:]):
            ends = [self.identity(x) for x in tree[1:]]
            same = (ends[0][0] == ends[1][0]) & (ends[0][1] == ends[1][1])
            return same if op == "=" else ~same
        if op in ("=", "<>") and all(x[0] == "var" and self.kinds.get(x[1]) == "node" for x in tree[1:]):
            ends = [self.identity(x) for x in tree[1:]]
            same = (ends[0][0] == ends[1][0]) & (ends[0][1] == ends[1][1])
            return same if op == "=" else ~same
        a, b = self.value(tree[1], table), self.value(tree[2], table)
        table_of = {
            "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b, "IN": lambda: F.array_contains(b, a),
            "CONTAINS": lambda: F.contains(a, b), "STARTS": lambda: F.startswith(a, b), "ENDS": lambda: F.endswith(a, b), "=~": lambda: F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$"))),
            "+": lambda: self.plus(tree, a, b), "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b,
        }
        return table_of[op]()

    def plus(self, tree, a: Column, b: Column) -> Column:
        """Lists and texts are joined, numbers added, by what the query shows of either side."""
        lists = [x[0] == "list" or (x[0] == "call" and x[1] in ("collect", "labels", "split")) for x in tree[1:]]
        if any(lists):
            return F.concat(a if lists[0] else F.array(a), b if lists[1] else F.array(b))
        texts = [(x[0] == "lit" and isinstance(x[1], str)) or (x[0] == "param" and isinstance(self.parameters.get(x[1]), str)) or (x[0] == "call" and x[1] in ("tostring", "tolower", "toupper", "replace")) or (x[0] == "+" and self._text(x)) for x in tree[1:]]
        return F.concat(a.cast("string"), b.cast("string")) if any(texts) else a + b

    def _text(self, tree) -> bool:
        return any(x[0] == "lit" and isinstance(x[1], str) for x in walk(tree))

    def identity(self, tree) -> tuple[Column, Column]:
        if tree[0] == "call" and tree[1] in ("startnode", "endnode"):
            end = "src" if tree[1] == "startnode" else "dst"
            return F.col(f"{tree[3][0][1]}__{end}_label"), F.col(f"{tree[3][0][1]}__{end}_pk")
        return F.col(f"{tree[1]}__label"), F.col(f"{tree[1]}__pk")

    def whole(self, var: str) -> Column:
        kind = self.kinds.get(var)
        if kind == "node":
            return F.to_json(F.struct(*[F.col(f"{var}__{p}").alias(p) for p in self._all(var)]))
        if kind == "rel":
            return F.to_json(F.struct(*[F.col(f"{var}__{c}").alias(c) for c in EDGE_FIELDS[5:]]))
        return F.col(f"{var}__path") if kind == "path" else F.col(var)

    def _all(self, var: str) -> list[str]:
        wanted = self.props.get(var, set()) - {"*"}
        if "*" in self.props.get(var, set()):
            wanted |= {c for x in PRIMARY_KEY for c in columns(x)} - {"embedding"}
        return sorted(p for p in wanted if f"{var}__{p}" in self.visible)

    visible: frozenset[str] = frozenset()

    def call(self, name: str, distinct: bool, args: list, table: DataFrame | None) -> Column:
        if name in AGGREGATES:
            arg = args[0]
            if name == "count":
                kind = self.kinds.get(arg[1]) if arg[0] == "var" else None
                value = F.lit(1) if arg[0] == "lit" else F.struct(F.col(f"{arg[1]}__label"), F.col(f"{arg[1]}__pk")) if kind == "node" and distinct else F.col(f"{arg[1]}__pk") if kind == "node" else self.edge_key(arg[1]) if kind == "rel" and distinct else F.col(f"{arg[1]}__src_pk") if kind == "rel" else self.value(arg, table)
                return F.count_distinct(value) if distinct else F.count(value)
            value = self.value(arg, table)
            if name == "collect":
                return F.sort_array(F.collect_set(value)) if distinct else F.collect_list(value)
            return {"sum": F.sum_distinct if distinct else F.sum, "avg": F.avg, "min": F.min, "max": F.max}[name](value)
        if name == "labels":
            return F.array(F.col(f"{args[0][1]}__label"))
        if name == "type":
            return F.col(f"{args[0][1]}__edge_type")
        if name == "properties":
            return self.whole(args[0][1])
        if name in ("length", "size") and args[0][0] == "var" and self.kinds.get(args[0][1]) == "path":
            return F.size(F.col(f"{args[0][1]}__path"))
        if name == "size":
            text = args[0][0] == "prop" and self._type(args[0][2]) == "string"
            return (F.length if text or args[0][0] == "lit" else F.size)(self.value(args[0], table))
        if name == "datetime":
            return F.current_timestamp() if not args else F.to_timestamp(self.value(args[0], table))
        a = [self.value(x, table) for x in args]
        known = {
            "coalesce": lambda: F.coalesce(*a), "tolower": lambda: F.lower(a[0]), "toupper": lambda: F.upper(a[0]), "trim": lambda: F.trim(a[0]), "replace": lambda: F.replace(*a),
            "tostring": lambda: a[0].cast("string"), "tointeger": lambda: a[0].try_cast("long"), "tofloat": lambda: a[0].try_cast("double"), "abs": lambda: F.abs(a[0]), "round": lambda: F.round(a[0]),
            "split": lambda: F.split(a[0], F.concat(F.lit("\\Q"), a[1], F.lit("\\E"))), "head": lambda: F.get(a[0], F.lit(0)), "last": lambda: F.get(a[0], F.size(a[0]) - 1),
            "substring": lambda: F.substring(a[0], a[1] + 1, a[2] if len(a) > 2 else F.length(a[0])), "exists": lambda: a[0].isNotNull(),
        }
        if name not in known:
            raise CypherError(f"unknown function {name}")
        return known[name]()

    # projections

    def project(self, table, final, distinct, items, star, order, skip, limit, where) -> DataFrame:
        table = table if table is not None else self.store.spark.range(1).drop("id")
        counted_items = []
        for value, name in items:
            table, value = self.counted(table, value)
            counted_items.append((value, name))
        counted_order = []
        for value, down in order:
            table, value = self.counted(table, value)
            counted_order.append((value, down))
        items, order = counted_items, counted_order
        self.visible = frozenset(table.columns)
        grouped = any(x[0] == "call" and x[1] in AGGREGATES for v, _ in items for x in walk(v))
        out: list[Column] = [F.col(f"`{c}`") for c in table.columns if not c.startswith("_")] if star else []
        kinds = dict(self.kinds) if star else {}
        keys: list[Column] = []
        for value, name in items:
            aggregate = any(x[0] == "call" and x[1] in AGGREGATES for x in walk(value))
            carried = value[0] == "var" and self.kinds.get(value[1]) in ("node", "rel", "path") and not final
            if carried:
                prefix = f"{value[1]}__"
                new = [F.col(f"`{c}`").alias(f"{name}__{c[len(prefix) :]}") for c in table.columns if c.startswith(prefix)]
                kinds[name] = self.kinds[value[1]]
                out += new
                keys += new
                continue
            column = self.value(value, table).alias(name)
            kinds[name] = "value"
            out.append(column)
            if not aggregate:
                keys.append(column)
        hidden: list[tuple[str, bool]] = []
        extra: list[Column] = []
        shown = {repr(v): n for v, n in items}
        for i, (value, down) in enumerate(order):
            if repr(value) in shown:
                hidden.append((shown[repr(value)], down))
            elif value[0] == "var" and value[1] in kinds:
                hidden.append((value[1], down))
            elif value[0] == "prop" and value[1][0] == "var" and kinds.get(value[1][1]) in ("node", "rel"):
                hidden.append((f"{value[1][1]}__{value[2]}", down))
            else:
                renamed = _renamed(value, {n: v for v, n in items})
                extra.append(self.value(renamed, table).alias(f"_o{i}"))
                hidden.append((f"_o{i}", down))
        if grouped:
            names = {n for v, n in items if any(x[0] == "call" and x[1] in AGGREGATES for x in walk(v))}
            aggregates = [self.value(v, table).alias(n) for v, n in items if n in names]
            result = table.groupBy(*keys).agg(*aggregates, *extra)
            if not any(kinds.get(n) in ("node", "rel", "path") for _, n in items):
                result = result.select(*[f"`{n}`" for _, n in items], *[f"_o{i}" for i in range(len(order)) if f"_o{i}" in result.columns])
        else:
            result = table.select(*out, *extra)
        if distinct:
            result = result.distinct()
        self.kinds = kinds
        if hidden:
            result = result.orderBy(*[F.col(f"`{c}`").desc_nulls_first() if down else F.col(f"`{c}`").asc_nulls_last() for c, down in hidden])
        if skip is not None:
            result = result.offset(self._count(skip))
        if limit is not None:
            result = result.limit(self._count(limit))
        result = result.drop(*[c for c in result.columns if re.fullmatch(r"_o\d+", c)])
        return result if where is None else self.filter(result, where)

    def _count(self, tree) -> int:
        found = self.parameters.get(tree[1]) if tree[0] == "param" else tree[1]
        if isinstance(found, bool) or not isinstance(found, int) or found < 0:
            raise CypherError("SKIP and LIMIT take a count")
        return found


def _with_local(tree, name: str, column: Column):
    if isinstance(tree, tuple):
        if tree[:1] == ("var",) and tree[1] == name:
            return ("local", column)
        return tuple(_with_local(x, name, column) for x in tree)
    return [_with_local(x, name, column) for x in tree] if isinstance(tree, list) else tree


def _renamed(tree, by: dict):
    """tree with names of projected values replaced by what they stand for."""
    if isinstance(tree, tuple):
        if tree[:1] == ("var",) and tree[1] in by:
            return by[tree[1]]
        return tuple(_renamed(x, by) for x in tree)
    return [_renamed(x, by) for x in tree] if isinstance(tree, list) else tree


def run(store, query: str, parameters: dict | None = None) -> DataFrame:
    """The rows that a query returns, as a DataFrame whose plan Catalyst optimises."""
    return Compiler(store, parameters or {}).run(query)

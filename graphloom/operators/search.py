"""Ranking and retrieval: exact vector search, BM25, reciprocal rank fusion and their combination."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.store import dealt

K1, B = 1.2, 0.75
#: Signs with a meaning in full-text queries.
SPECIAL = r"([+\-&|!(){}\[\]^\"~*?:\\/])"
VECTOR_LABELS = frozenset(("File", "Section"))
#: The property that full-text search reads, by label.
TEXT_OF = {"File": "summary", "Section": "summary", "Artifact": "description", "Ticket": "title", "Pattern": "description", "Risk": "description"}


@dataclass(frozen=True)
class SearchConfig:
    mode: str = "hybrid"
    rrf_k: int = 60
    fetch_k: int = 50
    vector_weight: float = 1.0
    fulltext_weight: float = 1.0

    def __post_init__(self):
        if self.mode not in ("hybrid", "vector", "fulltext"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.rrf_k < 1 or self.fetch_k < 1:
            raise ValueError("rrf_k and fetch_k are 1 or more")
        if min(self.vector_weight, self.fulltext_weight) < 0 or self.vector_weight + self.fulltext_weight == 0:
            raise ValueError("weights are not negative, and not both 0")


def checked_k(k) -> int:
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k is a positive integer")
    return k


def checked_threshold(t) -> float | None:
    if t is not None and (isinstance(t, bool) or not math.isfinite(t) or not 0 <= t <= 1):
        raise ValueError("a threshold lies in 0 to 1")
    return t


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers as double; null where a length is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_search(vectors: DataFrame, query: list[float], k: int, threshold: float | None = None) -> DataFrame:
    """pk, score = (1 + cosine) / 2 of the k nearest of vectors (pk, embedding), best first; ties by pk.

    The threshold holds after the k best are taken. Exact: one pass over all vectors and a top-k, no index.
    """
    k, threshold = checked_k(k), checked_threshold(threshold)
    rows = vectors.where(F.col("embedding").isNotNull()).select("pk", ((1 + cosine(F.col("embedding"), F.array(*map(F.lit, map(float, query))))) / 2).alias("score"))
    best = rows.where(F.col("score").isNotNull()).orderBy(F.desc("score"), "pk").limit(k)
    return best if threshold is None else best.where(F.col("score") >= threshold)


def similar_pairs(left: DataFrame, right: DataFrame, k: int, threshold: float | None = None, blocks: int = 32) -> DataFrame:
    """left_pk, pk, score, rank: the k nearest rows of right (pk, embedding) for every row of left (pk, embedding).

    right is dealt to blocks; every row of left meets each block, whose k best are merged: work per task is bounded by
    its block, and only k rows per query and block are shuffled.
    """
    import numpy as np
    import pandas as pd

    dealt = right.select(F.pmod(F.xxhash64("pk"), F.lit(blocks)).cast("int").alias("b"), F.col("pk").alias("pk"), "embedding")
    asked = left.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.col("pk").alias("left_pk"), F.col("embedding").alias("q"))

    def best(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(there):
            return pd.DataFrame()  # columns without rows fail on their way to Arrow
        a, b = (np.array(x.tolist(), dtype=np.float64) for x in (asked["q"], there["embedding"]))
        a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (a, b))
        keys, out = there["pk"].to_numpy(), []
        for at in range(0, len(a), 1024):
            s = (1 + a[at : at + 1024] @ b.T) / 2
            n = min(k, s.shape[1])
            top = np.argpartition(-s, n - 1, axis=1)[:, :n]
            out.append(pd.DataFrame({"left_pk": np.repeat(asked["left_pk"].to_numpy()[at : at + 1024], n), "pk": keys[top].ravel(), "score": np.take_along_axis(s, top, axis=1).ravel()}))
        return pd.concat(out)

    kind = dict(left.dtypes)["pk"]
    found = asked.groupBy("b").cogroup(dealt.groupBy("b")).applyInPandas(best, f"left_pk {kind}, pk {dict(right.dtypes)['pk']}, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("left_pk").orderBy(F.desc("score"), "pk"))).where(F.col("rank") <= k)
    return ranked if threshold is None else ranked.where(F.col("score") >= threshold)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def escape(query: str) -> str:
    return re.sub(SPECIAL, r"\\\1", query)


def parsed(query: str) -> tuple[list[str], list[str], list[str], list[str]]:
    """(terms, required, excluded, phrases) of a query: words, +word or AND, -word or NOT, and "quoted phrases"."""
    terms, required, excluded, phrases = [], [], [], []
    bare = re.sub(r"\\(.)", r" ", query)
    for phrase in re.findall(r'"([^"]*)"', bare):
        phrases.append(" ".join(re.findall(r"[^\W_]+", phrase.lower())))
    words = re.sub(r'"[^"]*"', " ", bare).split()
    for at, word in enumerate(words):
        if word in ("AND", "OR", "NOT", "&&", "||"):
            continue
        parts = re.findall(r"[^\W_]+", word.lower())
        if word[0] in "-!" or (at and words[at - 1] == "NOT"):
            excluded += parts
            continue
        terms += parts
        if word[0] == "+" or (at and words[at - 1] in ("AND", "&&")) or (at + 1 < len(words) and words[at + 1] in ("AND", "&&")):
            required += parts
    terms += [w for p in phrases for w in p.split()]
    return list(dict.fromkeys(terms)), required, excluded, [p for p in phrases if p]


def full_text_search(texts: DataFrame, query: str, k: int) -> DataFrame:
    """pk, score of the k best of texts (pk, text) by BM25 over any of the query's words; ties by pk.

    Counts of the query's words are taken in one pass of SQL functions, document frequencies and the mean length in an
    aggregate of one row. An empty query, or no match, gives no rows.
    """
    k = checked_k(k)
    terms, required, excluded, phrases = parsed(query)
    rows = texts.where(F.col("text").isNotNull()).select("pk", tokens(F.col("text")).alias("t"))
    if not terms:
        return rows.select("pk", F.lit(0.0).alias("score")).limit(0)
    wanted = F.array(*map(F.lit, terms))
    hit = F.filter("t", lambda x: F.array_contains(wanted, x))
    times = lambda w: F.size(F.filter("h", lambda x: x == w))
    counts = [times(w).alias(f"c{i}") for i, w in enumerate(terms)]
    rows = rows.select("pk", "t", F.size("t").alias("n"), hit.alias("h")).select("pk", "t", "n", *counts)
    stats = rows.agg(F.count(F.lit(1)).alias("_docs"), F.avg("n").alias("_mean"), *[F.sum((F.col(f"c{i}") > 0).cast("long")).alias(f"_d{i}") for i in range(len(terms))])
    found = rows.where(" OR ".join(f"c{i} > 0" for i in range(len(terms))))
    for w in required:
        found = found.where(F.array_contains("t", w))
    for w in excluded:
        found = found.where(~F.array_contains("t", w))
    for p in phrases:
        found = found.where(F.concat(F.lit(" "), F.array_join("t", " "), F.lit(" ")).contains(f" {p} "))
    # one row of corpus statistics beside each match
    joined = found.drop("t").crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("_docs") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5))
        score = score + idf * F.col(f"c{i}") * (K1 + 1) / (F.col(f"c{i}") + K1 * (1 - B + B * F.col("n") / F.col("_mean")))
    return joined.select("pk", score.alias("score")).orderBy(F.desc("score"), "pk").limit(k)


def ranked(found: DataFrame) -> DataFrame:
    """pk, score with rank, 1 for the best; for a result that a limit keeps short."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "pk")))


def fuse(vector: DataFrame, fulltext: DataFrame, limit: int, rrf_k: int = 60, vector_weight: float = 1.0, fulltext_weight: float = 1.0) -> DataFrame:
    """pk, score by reciprocal ranks of two rankings (pk, rank): the sum of weight / (rrf_k + rank), best first.

    Ties stand as first seen, vector rows before full-text ones. Rows without a pk count no score but keep their rank.
    """
    if rrf_k < 1:
        raise ValueError("rrf_k is 1 or more")
    legs = [df.select("pk", (F.lit(float(w)) / (rrf_k + F.col("rank"))).alias("s"), (F.col("rank") + at).cast("long").alias("seen")) for df, w, at in ((vector, vector_weight, 0), (fulltext, fulltext_weight, 1_000_000_000))]
    both = legs[0].unionByName(legs[1]).where(F.col("pk").isNotNull())
    found = both.groupBy("pk").agg(F.sum("s").alias("score"), F.min("seen").alias("seen"))
    return found.orderBy(F.desc("score"), "seen").limit(limit).select("pk", "score", "seen")


def matched_each(queries: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """left_pk, pk, score, rank: the k best of texts (pk, text) by BM25 over any word of each of queries (left_pk, text); ties by pk.

    All queries at once: texts are cut to rows of word, text and count for the words that some query has, and meet the
    queries by word.
    """
    asked = queries.select("left_pk", F.explode(F.array_distinct(tokens(F.col("text")))).alias("w"))
    cut = texts.where(F.col("text").isNotNull()).select("pk", tokens(F.col("text")).alias("t")).select("pk", F.size("t").alias("n"), "t")
    stats = cut.agg(F.count(F.lit(1)).alias("_docs"), F.avg("n").alias("_mean"))
    # words are counted in parts by pk, cut finely: a small file holds many rows, and each has many words
    met = cut.select("pk", "n", F.explode("t").alias("w")).join(asked.select("w").distinct(), "w", "left_semi")
    held = dealt(met, texts, "pk", 512 << 10, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))).groupBy("w", "pk", "n").agg(F.count(F.lit(1)).alias("c"))
    rare = held.groupBy("w").agg(F.count(F.lit(1)).alias("d"))
    weighed = held.join(rare, "w").crossJoin(F.broadcast(stats))  # one row of corpus statistics
    idf = F.log(1 + (F.col("_docs") - F.col("d") + 0.5) / (F.col("d") + 0.5))
    weighed = weighed.select("w", "pk", (idf * F.col("c") * (K1 + 1) / (F.col("c") + K1 * (1 - B + B * F.col("n") / F.col("_mean")))).alias("s"))
    found = asked.join(weighed, "w").groupBy("left_pk", "pk").agg(F.sum("s").alias("score"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("left_pk").orderBy(F.desc("score"), "pk"))).where(F.col("rank") <= k)


def fuse_each(vector: DataFrame, fulltext: DataFrame, limit: int, rrf_k: int = 60) -> DataFrame:
    """left_pk, pk, score, rank: fuse() of two rankings (left_pk, pk, rank) for each left_pk."""
    legs = [df.select("left_pk", "pk", (F.lit(1.0) / (rrf_k + F.col("rank"))).alias("s"), (F.col("rank") + at).cast("long").alias("seen")) for df, at in ((vector, 0), (fulltext, 1_000_000_000))]
    found = legs[0].unionByName(legs[1]).groupBy("left_pk", "pk").agg(F.sum("s").alias("score"), F.min("seen").alias("seen"))
    rank = F.row_number().over(Window.partitionBy("left_pk").orderBy(F.desc("score"), "seen"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit).select("left_pk", "pk", "score", "rank")


def hybrid_search(store, query: str, kind: str = "File", limit: int = 20, embed: Callable[[str], list[float]] | None = None, config: SearchConfig | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """pk, score of one label's nodes: both rankings fused, or one of them. Labels without a text property give nothing.

    Without an embedder, on labels without vectors, or if the embedder fails, hybrid falls back to full text; vector
    mode then gives nothing. Full-text scores are raw, all others are fused.
    """
    config = config or SearchConfig()
    empty = store.nodes(kind).select(F.lit("").alias("pk"), F.lit(0.0).alias("score")).limit(0)
    if kind not in TEXT_OF:
        return empty
    fetch = max(config.fetch_k, limit)
    query_vector = None
    if config.mode != "fulltext" and kind in VECTOR_LABELS and embed is not None:
        try:
            query_vector = embed(query)
        except Exception:  # noqa: BLE001  a provider's failure must not fail the search
            query_vector = None
    if config.mode == "vector" and query_vector is None:
        return empty
    if query_vector is None:
        return store.full_text_search(kind, TEXT_OF[kind], query, limit)
    near = ranked(store.vector_search(kind, query_vector, fetch, vectors=vectors))
    text = near.limit(0) if config.mode == "vector" else ranked(store.full_text_search(kind, TEXT_OF[kind], query, fetch))
    return fuse(near, text, limit, config.rrf_k, config.vector_weight, config.fulltext_weight).drop("seen")

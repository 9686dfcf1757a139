"""Exact token counts and length histograms (operator 5)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.tables import written
from graphloom.llm.text import batch_arrays
from graphloom.llm.tokens import default_path, encoder, vocabulary


def token_counts(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: n_tokens, its encoded length without added ids. A null text counts 0 tokens."""
    source = df.sparkSession.sparkContext.broadcast(vocabulary(path or default_path()))

    def count(batches):
        import pyarrow as pa

        for (texts,) in batch_arrays(batches, "text", part_bytes=8 << 20):
            offsets, _ = encoder(source.value, None).encode(texts)
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(offsets), pa.int64())], names=["n_tokens"])

    return df.select(F.col(text).alias("text")).mapInArrow(count, "n_tokens long")


def length_histogram(counts: DataFrame, length: str = "n_tokens", block: int = 1024) -> DataFrame:
    """One row per distinct length L, ascending: n_docs; docs_from and tokens_from (those of at least L tokens);
    docs_upto (at most L, so docs_upto / all is L's quantile); truncated_tokens, the sum of min(length, L) over all.

    For a context limit c between two rows, truncated_tokens is that of the row below plus (c - its L) * docs_from of
    the row above. Sums run inside blocks of lengths and then over block totals, so no task sees more than
    `block` lengths or one row per block. Null lengths are left out; an empty table gives no rows.
    """
    each = counts.where(F.col(length).isNotNull()).groupBy(F.col(length).alias("context_limit")).agg(F.count(F.lit(1)).alias("n_docs"))
    each = written(each)  # read twice below, and far smaller than the counts
    each = each.withColumn("_t", F.col("context_limit") * F.col("n_docs")).withColumn("_b", F.floor(F.col("context_limit") / block))
    blocks = each.groupBy("_b").agg(F.sum("n_docs").alias("_bd"), F.sum("_t").alias("_bt"))
    after = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("_b", F.coalesce(F.sum("_bd").over(after), F.lit(0)).alias("_ad"), F.coalesce(F.sum("_bt").over(after), F.lit(0)).alias("_at"), F.sum("_bd").over(whole).alias("_nd"), F.sum("_bt").over(whole).alias("_nt"))
    inside = Window.partitionBy("_b").orderBy(F.col("context_limit").desc())
    out = each.join(blocks, "_b").withColumn("docs_from", F.sum("n_docs").over(inside) + F.col("_ad")).withColumn("tokens_from", F.sum("_t").over(inside) + F.col("_at"))
    return out.select(
        "context_limit",
        "n_docs",
        "docs_from",
        "tokens_from",
        (F.col("_nd") - F.col("docs_from") + F.col("n_docs")).alias("docs_upto"),
        (F.col("_nt") - F.col("tokens_from") + F.col("context_limit") * F.col("docs_from")).alias("truncated_tokens"),
    )


def at_limits(histogram: DataFrame, limits: list[int], quantiles: list[float] = ()) -> DataFrame:
    """What length_histogram() answers for any context limit, one row each, and the length at any quantile.

    kind is "limit" or "quantile", at the limit or the share asked for, length the limit or the least length that so many
    documents do not exceed; docs_upto, tokens_upto (of documents of at most that length) and truncated_tokens follow. One
    pass over the histogram; limits need not be observed lengths. An empty histogram gives null lengths and zeros.
    """
    n, size = F.col("n_docs"), F.col("context_limit")
    whole = F.sum("n_docs")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")

    def upto(kind: str, at: float, length):
        return F.struct(F.lit(kind).alias("kind"), F.lit(float(at)).alias("at"), length.cast("long").alias("length"), zero(F.sum(F.when(size <= length, n))).alias("docs_upto"), zero(F.sum(F.when(size <= length, n * size))).alias("tokens_upto"), zero(F.sum(n * F.least(size, length))).alias("truncated_tokens"))

    if quantiles:
        total = int(histogram.agg(whole).first()[0] or 0)
        found = histogram.agg(*[F.min(F.when(F.col("docs_upto") >= q * total, size)) for q in quantiles]).first()
    asked = [("limit", c, F.lit(int(c))) for c in limits] + [("quantile", q, F.lit(found[k]).cast("long")) for k, q in enumerate(quantiles)]
    return histogram.agg(F.array(*[upto(*x) for x in asked]).alias("x")).select(F.explode("x").alias("x")).select("x.*")

"""Document quality rules whose failures are pooled by host (operator 2). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.tables import written
from graphloom.llm.text import bind, words

#: Signs that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _covered(hashes: Column, width: int) -> Column:
    """Words covered by the windows whose hash occurs at two or more starts: equal hashes are neighbours once sorted."""

    def spans(found: Column) -> Column:
        same = lambda e, other: F.coalesce(other["h"] == e["h"], F.lit(False))
        twice = F.filter(found, lambda e, k: same(e, F.get(found, k - 1)) | same(e, F.get(found, k + 1)))
        return bind(F.sort_array(F.transform(twice, lambda e: e["i"])), lambda at: F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - p, F.lit(width)))), F.lit(0), lambda a, x: a + x))

    return bind(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), spans)


def repeated_words(found: Column, width: int = 8) -> Column:
    """Words of an array that lie in a window of `width` words found at least twice, the first one included.

    Windows are compared by 64-bit hashes within one document.
    """
    hashes = F.when(F.size(found) > width, F.transform(F.sequence(F.lit(1), F.size(found) - (width - 1)), lambda i: F.xxhash64(F.slice(found, i, F.lit(width)))))
    return F.coalesce(bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h, width))), F.lit(0))


def features(text: Column) -> Column:
    """A struct of the five counts of one text; null and empty texts count 0 everywhere."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    return bind(
        words(whole),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


def host_rates(failures: DataFrame, host: str = "host", failed: str = "base_failed") -> DataFrame:
    """One row per host: n_docs, n_failed and rate, its failure rate shrunk to an empirical beta prior.

    The prior's mean is the corpus's rate; its strength comes from the variance between hosts beyond what binomial
    counts explain (method of moments over size-weighted hosts). Without such excess every host gets the corpus's rate.
    """
    hosts = failures.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    whole = hosts.agg(F.sum("n_docs").alias("n"), F.count(F.lit(1)).alias("h"), F.sum("n_failed").alias("f"), F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("q"))
    n, h, f, q = (float(x or 0) for x in whole.first())
    mean = f / n if n else 0.0
    spread = mean * (1 - mean)
    between = q / n - mean * mean - spread * h / n if n else 0.0
    strength = max(spread / between - 1, 1.0) if between > 1e-12 else 1e12
    rate = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    return hosts.select(host, "n_docs", "n_failed", rate.alias("rate"), F.lit(mean).alias("corpus_rate"))


def _counted(df: DataFrame) -> DataFrame:
    """df (host, text and others) with the five counts and base_failed in place of the text, written once."""
    rows = df.withColumn("f", features(F.col("text"))).select("*", "f.*").drop("f")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return written(rows.withColumn("base_failed", failed).drop("text"))


def _judged(counted: DataFrame, reject_host: float, suspect_host: float, symbol_share: float, dup_lines: float, most_hosts: int = 100_000) -> DataFrame:
    """counted with host_rate and kept. The hosts' rates are broadcast while they are few, and else joined by shuffle."""
    rates = written(host_rates(counted).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"), "corpus_rate"))
    rates = F.broadcast(rates) if rates.count() <= most_hosts else rates
    joined = counted.join(rates, F.col("host").eqNullSafe(F.col("_host")))
    soft = (F.col("n_symbols") > symbol_share * F.col("word_chars")) | (20 * F.col("n_dup_lines") > dup_lines * F.col("n_words"))
    suspect = (F.col("host_rate") > suspect_host) & (F.col("host_rate") > 2 * F.col("corpus_rate"))
    kept = ~F.col("base_failed") & (F.col("host_rate") <= reject_host) & ~(suspect & soft)
    verdict = F.when(F.col("host_rate") > reject_host, "rejected").when(suspect, "suspect").otherwise("kept")
    return joined.withColumn("kept", kept).withColumn("host_verdict", verdict).drop("_host", "corpus_rate")


def judge(df: DataFrame, text: str = "text", host: str = "source", reject_host: float = 0.8, suspect_host: float = 0.3, symbol_share: float = 0.1, dup_lines: float = 0.3) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, host, host_rate and host_verdict (kept, suspect or rejected) for each document.

    The host is whatever column is named, `source` unless told: a domain where the table has one.

    Base rules: under 20 words, or over 30 % of the words in repeated 8-word windows. A document that fails one goes.
    All documents of a host whose shrunk failure rate exceeds `reject_host` go. On a host above `suspect_host` and
    twice the corpus's rate, documents with over `symbol_share` symbols a character or over `dup_lines` repeated lines
    a 20 words go too. Elsewhere a document that passes the base rules stays.

    The counts are written once to the shared folder, without the texts. A null host is a host of its own; an empty
    table gives no rows; repeated rows are judged alike, each on its own row.
    """
    counted = _counted(df.select("doc_id", F.col(host).alias("host"), F.col(text).alias("text")))
    judged = _judged(counted, reject_host, suspect_host, symbol_share, dup_lines)
    return judged.select("doc_id", *RULES, "base_failed", "kept", "host", F.round("host_rate", 6).alias("host_rate"), "host_verdict")


def passing(df: DataFrame, text: str = "text", host: str = "source", reject_host: float = 0.8, suspect_host: float = 0.3, symbol_share: float = 0.1, dup_lines: float = 0.3) -> DataFrame:
    """The rows of df that judge() keeps, with df's columns, whatever their names. Rows without a text go, as they have no
    words; repeated rows stay or go together; an empty table gives no rows."""
    counted = _counted(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(host).alias("host"), F.col(text).alias("text")))
    return _judged(counted, reject_host, suspect_host, symbol_share, dup_lines).where("kept").select("_row.*")

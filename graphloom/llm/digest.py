"""Canonical exact digests of documents (operator 10). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.tables import written

#: Unicode white space.
BLANKS = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def canonical(text: Column) -> Column:
    """NFC, full case folding, NFC again, runs of Unicode white space as one space, trimmed. A null text is empty.

    Composition and folding come from the ICU library that Spark brings along, called by SQL's java_method, so that
    "STRASSE" meets "straße" and an inner sigma a final one; plain ASCII texts skip it.
    """
    whole = F.coalesce(text, F.lit(""))
    nfc = lambda x: F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(False))
    folded = F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfc(whole), F.lit(True))
    lower = F.when(F.length(whole) == F.octet_length(whole), F.lower(whole)).otherwise(nfc(folded))
    return F.trim(F.regexp_replace(lower, BLANKS, " "))


def digest(form: Column) -> Column:
    """128 bits in hex: two differently seeded 64-bit xxhashes."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(form)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(0x5EED), form)), 16, "0")))


def told_apart(forms: DataFrame, keys: DataFrame, few: int = 2_000_000, part_rows: int = 1000) -> DataFrame:
    """Rows of forms (row, form, digest) whose bytes differ from those of the least row with the same digest: row, tag.

    keys has digest and row of the same rows. Texts whose digest occurs once stay where they are: while at most `few`
    digests repeat, their 64-bit hashes are broadcast (16 MB a million), and else joined. The others are written, and exchanged once, by
    digest and part of some `part_rows` rows, and held against the text of their digest's least row, which each part gets:
    as many comparisons as rows, and no task with more than a few parts.
    """
    groups = keys.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).where("n > 1")
    groups = written(groups.select("digest", "first", (1 + F.floor(F.col("n") / part_rows)).cast("int").alias("parts")))
    # large groups alone: at most one for each `part_rows` rows
    large = groups.where("parts > 1").select("digest", "parts")
    hashes = lambda *c: groups.select(F.xxhash64(*c).alias("h")).distinct()
    if groups.count() <= few:
        members = written(forms.join(F.broadcast(hashes("digest")), F.xxhash64("digest") == F.col("h"), "left_semi"))
        heads = members.join(F.broadcast(hashes("digest", "first")), F.xxhash64("digest", "row") == F.col("h"), "left_semi")
    else:
        members = forms.join(groups.select("digest"), "digest", "left_semi")
        heads = members
    heads = heads.join(groups.withColumnRenamed("first", "row"), ["digest", "row"]).dropDuplicates(["digest"])
    heads = heads.select("digest", F.col("form").alias("head"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    large = F.broadcast(large) if large.count() <= few else large
    members = members.join(large, "digest", "left").withColumn("part", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).cast("int"))
    odd = members.join(heads, ["digest", "part"]).where("form <> head")
    return odd.select("row", F.concat(F.lit("-"), F.substring(F.sha2("form", 256), 1, 32)).alias("tag"))


def followed(df: DataFrame, block: int = 1024) -> DataFrame:
    """Adds next_id and next_text, of the document that follows in descending doc_id; the first follows the last.

    Rows with equal doc_id stand by their text. Documents are dealt to blocks of doc_id ranges, and each block's first
    document is copied to the block before it, so that no sort over all documents is needed. The blocks that have rows are
    range-sorted to learn which comes next, and a window over one row a range joins the ranges. Rows of one doc_id lie in
    one block. Rows without a doc_id follow each other. Takes doc_id and text; an empty table gives no rows.
    """
    rows = df.withColumn("_b", F.floor(F.col("doc_id") / block))
    blocks = rows.where("_b IS NOT NULL").groupBy("_b").agg(F.max("doc_id").alias("_head"))
    blocks = written(blocks.repartitionByRange("_b").withColumn("_s", F.spark_partition_id()))
    order = Window.orderBy("_first")  # one row a range
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = blocks.groupBy("_s").agg(F.min("_b").alias("_first"))
    ranges = ranges.select("_s", F.coalesce(F.lead("_first").over(order), F.min("_first").over(every)).alias("_next"))
    inside = Window.partitionBy("_s").orderBy("_b")
    heads = blocks.join(F.broadcast(ranges), "_s").select(F.col("_b").alias("_hb"), "_head", F.coalesce(F.lead("_b").over(inside), "_next").alias("_before"))
    rows = rows.join(heads, (F.col("_b") == F.col("_hb")) & (F.col("doc_id") == F.col("_head")), "left").drop("_hb", "_head")
    own = F.struct(F.col("_b").alias("b"), F.lit(False).alias("copied"))
    sent = F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("_before").alias("b"), F.lit(True).alias("copied"))))
    rows = rows.withColumn("_to", F.explode(sent)).select("doc_id", "text", "_to.*")
    after = Window.partitionBy("b").orderBy("copied", F.col("doc_id").desc(), "text")
    return rows.withColumn("next_id", F.lead("doc_id").over(after)).withColumn("next_text", F.lead("text").over(after)).where("NOT copied").drop("b", "copied")


def edit(text: Column, other: Column) -> Column:
    """text with its last third (rounded down) replaced by as many code points of the start of other, or all of it."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(other, F.lit(1), third))


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and fingerprint, equal exactly where the canonical texts are equal, byte by byte.

    A null text counts as empty. Rows of one doc_id with different texts get their own fingerprints.
    """
    forms = df.select("doc_id", canonical(F.col(text)).alias("form")).withColumn("digest", digest(F.col("form"))).withColumn("row", F.struct("doc_id", F.length("form").alias("n"), F.crc32("form").alias("c")))
    odd = told_apart(forms, forms.select("digest", "row"))
    return forms.drop("form").join(odd, "row", "left").select("doc_id", F.concat("digest", F.coalesce("tag", F.lit(""))).alias("fingerprint"))


def edited_fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """fingerprints() of each document and of its edited text, with their likeness: 1 where the canonical bytes are equal, else 0.

    Gives doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id. Canonical
    texts are compared themselves, not only their digests. The rows are written once without texts. An edited text equal to
    its document's has that one's fingerprint; others have their digest, which no bytes of third documents are held against.
    """
    rows = followed(df.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")))
    rows = rows.withColumn("edited", edit(F.col("text"), F.coalesce("next_text", F.lit(""))))
    rows = rows.select("doc_id", "next_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("text")).alias("form"), canonical(F.col("edited")).alias("edited_form"), canonical(F.col("next_text")).alias("next_form"))
    same = lambda other: (F.col("form") == F.col(other)).cast("double")
    key = F.struct("doc_id", F.length("form").alias("n"), F.crc32("form").alias("c"))
    made = written(rows.select("doc_id", "next_id", "n_chars", "edited_sha256", digest(F.col("form")).alias("digest"), digest(F.col("edited_form")).alias("edited_fingerprint"), same("edited_form").alias("near_edited"), same("next_form").alias("near_next"), key.alias("row")))
    forms = df.select("doc_id", canonical(F.col(text)).alias("form")).withColumn("digest", digest(F.col("form"))).select("digest", key.alias("row"), "form")
    odd = told_apart(forms, made.select("digest", "row"))
    own = F.concat("digest", F.coalesce("tag", F.lit("")))
    edited = F.when(F.col("near_edited") == 1, own).otherwise(F.col("edited_fingerprint"))
    return made.join(odd, "row", "left").select("doc_id", "n_chars", "edited_sha256", own.alias("fingerprint"), edited.alias("edited_fingerprint"), "near_edited", "near_next", "next_id")

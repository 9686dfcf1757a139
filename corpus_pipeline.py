"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and all rows that the one before it kept. All but the last return the columns of
documents; run() writes each result as Parquet to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import curriculum, hostrules, ngramjoin, packing, pii
from graphloom.llm.tables import written
from graphloom.llm.text import words

#: Stands for a secret that a deployment reads from its own store.
KEY = "a key kept outside the data"
CAPACITY = 2048


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule, or that their host's failure rate condemns, go."""
    return hostrules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles, the least doc_id stays."""
    return ngramjoin.one_of_each(docs, 5, 80, 100)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values are permuted within their format; n_chars follows the new text."""
    return pii.pseudonymise(docs, KEY).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 1, 2, 3, repeating, in order of their names; rows are whole documents, as often as the mix takes
    them, sorted by their position in training."""
    sized = docs.withColumn("size", F.size(words(F.col("text"))).cast("long"))
    return curriculum.in_order(curriculum.place(sized, lambda rank, _: rank % 3 + 1, whole=True)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, placed in sequences of at most CAPACITY. Executors hold memory of the stages
    before, so the Python workers keep less here."""
    return packing.pack_documents(docs, CAPACITY, cache_words=300_000, part_bytes=1 << 20, batch_rows=2000).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("pseudonyms", pseudonyms), ("mixture", mixture), ("packing", packed)]

#: SQL can express neither the keyed permutation nor the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

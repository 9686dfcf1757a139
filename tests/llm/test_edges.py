"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables, and columns with the operators' names."""

import pytest

from conftest import SF

pytest.importorskip("graphloom.llm.queries")
from pyspark.sql import functions as F  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} x{i}" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox. " * 8 + "a.b@c.example", "en", "s1", 1),
    (1, "The quick brown fox. " * 8 + "a.b@c.example", "en", "s1", 1),
    (2, None, None, None, None),
    (None, "no id but a text of its own with more than a few words in it so that it may pass the rules of quality here", "en", None, 5),
    (None, None, None, "s1", None),
    (3, "", "en", "", 0),
    (4, " \n\t ", "en", "s2", 4),
    (5, LONG, "en", "s2", len(LONG)),
    (6, "x" * 200_000, "en", "s2", 200_000),
]
#: Operators that keep the columns of df, but for those they name.
KEEPERS = {"pseudonyms": "text pseudonyms", "passing": "", "ring": "shard slot home_shard", "one of each": "", "whole mixture": "size source_size target taken copies", "in order": "size source_size target taken copies copy words position", "extraction": "html text n_chars"}
CLASH = "_at at arc tie part rank lo hi _part _n n _s s h i c base goal pieces parts old new parts_of _new _lp _x x html kept host base_failed f shard slot size n_words gram print taken copies position target fold pseudonyms n_tokens length piece next_text b form _row _found _rank row"


def jobs():
    from graphloom.llm import curriculum, digest, hostrules, html, lengths, lmscore, ngramjoin, packing, pii, ring

    empty_labels = lambda spark: spark.createDataFrame([], "doc_id long, quality int, toxic int")
    return {
        "pseudonyms": lambda s, d: pii.pseudonymise(d, "k"),
        "quality": lambda s, d: hostrules.judge(d),
        "passing": lambda s, d: hostrules.passing(d),
        "scores": lambda s, d: lmscore.cross_entropy_difference(d, empty_labels(s)),
        "ring": lambda s, d: ring.shard(d, F.col("doc_id"), 4),
        "counts": lambda s, d: lengths.token_counts(d),
        "packing": lambda s, d: packing.pack_documents(d, 64, with_ids=True),
        "mixture": lambda s, d: curriculum.place(curriculum.sized(d), lambda r, _: r + 1),
        "whole mixture": lambda s, d: curriculum.place(d.withColumn("size", F.length("text")), lambda r, _: r + 1, whole=True),
        "in order": lambda s, d: curriculum.in_order(curriculum.place(d.withColumn("size", F.length("text")), lambda r, _: r + 1)),
        "extraction": lambda s, d: html.extract(d.withColumnRenamed("html", "_html").withColumnRenamed("text", "html")),
        "histogram": lambda s, d: lengths.length_histogram(lengths.token_counts(d).unionByName(s.createDataFrame([(None,)], "n_tokens long"))),
        "join": lambda s, d: ngramjoin.join_classes(d),
        "one of each": lambda s, d: ngramjoin.one_of_each(d),
        "digest": lambda s, d: digest.edited_fingerprints(d),
        "fingerprints": lambda s, d: digest.fingerprints(d),
    }


#: Rows that an operator gives for ROWS.
EXPECTED = {"passing": 2, "packing": None, "one of each": 8, "in order": None, "histogram": None}


@pytest.mark.parametrize("name", list(jobs()))
def test_any_rows(spark, name):
    job = jobs()[name]
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASH.split():
        df = df.withColumn(c, F.lit("taken"))
    got = job(spark, df).collect()
    if EXPECTED.get(name, len(ROWS)):
        assert len(got) == EXPECTED.get(name, len(ROWS))
    if name in KEEPERS:
        kept = [c for c in df.columns if c not in KEEPERS[name].split()]
        assert set(kept) <= set(got[0].asDict()) and all(r[c] == "taken" for r in got for c in kept if c in CLASH.split())
        assert {(r["doc_id"], r["lang"], r["source"]) for r in got} <= {(r[0], r[2], r[3]) for r in ROWS}
    empty = job(spark, df.limit(0)).collect()
    assert empty == [] or (name == "histogram" and [r["context_limit"] for r in empty] == [])


def test_stages_on_any_rows(spark):
    import corpus_pipeline as P

    before = spark.createDataFrame(ROWS, SCHEMA)
    for rows in (before, before.limit(0)):
        df = rows
        for _, stage in P.STAGES[:-1]:
            df = stage(spark, df, SF)
            assert df.columns == before.columns
        out = P.STAGES[-1][1](spark, df, SF).collect()
        assert {r["doc_id"] for r in out} == ({None, 5} if rows is before else set())


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_defined_results(spark):
    j, df = jobs(), spark.createDataFrame(ROWS, SCHEMA)
    quality = j["quality"](spark, df).collect()
    assert [r["kept"] for r in quality if r["doc_id"] in (2, 3, 4)] == [False] * 3
    assert sorted(repr(r["doc_id"]) for r in j["one of each"](spark, df).collect()) == sorted(map(repr, [1, 2, 3, 4, 5, 6, None, None]))
    assert {r["doc_id"]: r["n_shingles"] for r in j["join"](spark, df).collect() if r["doc_id"] in (2, 3, 4, 6)} == {2: 0, 3: 0, 4: 0, 6: 1}
    assert [r["pseudonyms"] for r in j["pseudonyms"](spark, df).collect() if r["doc_id"] == 1] == [1, 1]
    assert [r["text"] for r in j["pseudonyms"](spark, df).collect() if r["doc_id"] == 2] == [None]
    lengths = {r["doc_id"]: r["length"] for r in j["packing"](spark, df).where("piece = 0").collect()}
    assert lengths[2] == lengths[3] == lengths[4] == 1 and lengths[5] == 64
    assert all(len(r["ids"]) == r["length"] for r in j["packing"](spark, df).collect())
    digests = {r["doc_id"]: r for r in j["digest"](spark, df).where("doc_id IS NOT NULL").collect()}
    assert digests[2]["fingerprint"] == digests[3]["fingerprint"] == digests[4]["fingerprint"] and digests[3]["near_next"] == 1.0
    assert sorted(r["taken"] for r in j["mixture"](spark, df).collect() if r["doc_id"] in (2, 3, 4)) == [0, 0, 0]


def test_hosts_shrink(spark):
    from graphloom.llm.hostrules import host_rates, judge

    rows = [(f"h{k}", i < bad) for k, (n, bad) in enumerate([(100, 5), (100, 90), (1, 1), (50, 2)]) for i in range(n)]
    got = {r["host"]: r["rate"] for r in host_rates(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()}
    assert got["h1"] > 0.8 and 0.05 <= got["h0"] < 0.12 and got["h2"] < 1.0
    good = " ".join(f"w{i}" for i in range(40))
    docs = [(i, "short", "spam") for i in range(60)] + [(100, good, "spam")] + [(200 + i, f"{good} {i}", "fine") for i in range(60)]
    kept = {r["doc_id"] for r in judge(spark.createDataFrame(docs, "doc_id long, text string, source string")).where("kept").collect()}
    assert kept == {200 + i for i in range(60)}


def test_checkpoint_folder_is_the_sessions(spark):
    from graphloom.llm.tables import shared_dir, written

    table = written(spark.range(3).withColumn("x", F.lit(None).cast("string")))
    assert table._graphloom_path.startswith(shared_dir(spark)) and table.count() == 3


def test_ids_are_laid_out_in_slices(monkeypatch):
    """What is built beside the ids of a part of texts is small: arrays as long as all its words are few."""
    import tracemalloc

    import pyarrow as pa

    from graphloom.llm import tokens

    source = tokens.vocabulary(tokens.default_path())
    n = 1_000_000
    texts = pa.array(["a b " * (n // 2)])
    e = tokens.WordEncoder(source)
    tracemalloc.start()
    try:
        _, ids = e.encode(texts)
        assert len(ids) == n + 1
        assert tracemalloc.get_traced_memory()[1] < 28 * n
    finally:
        tracemalloc.stop()
    odd = ["", None, "one two, three", " \n", "x" * 300 + " y.", None, "Ünïcode ﬁ <unk> z", ""]
    for end in (0, None):
        e = tokens.WordEncoder(source, end)
        each = [e.encode(pa.array([t], pa.string()))[1].tolist() for t in odd]
        for at_once in (1, 2, 1 << 16):
            monkeypatch.setattr(tokens, "AT_ONCE", at_once)
            offsets, ids = e.encode(pa.array(odd))
            assert [ids[b:k].tolist() for b, k in zip(offsets[:-1], offsets[1:], strict=True)] == each

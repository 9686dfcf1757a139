import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import similarity as S
from graphloom.functions import text as T

SAMPLE = "# Title\n\n## §1 First\n\nbody 1\n\n### §1.1 Sub\n\nbody 1.1\n\n## §2 Second\n\nbody 2\n"


def shape(text, *levels):
    return [(s["title"], s["level"], s["anchor"], s["ordinal"], s["parent_anchor"]) for s in T.sections(text, *levels)]


def test_sections_of_the_sample():
    assert shape(SAMPLE) == [("Title", 2, "title", 0, None), ("§1 First", 2, "1-first", 1, None), ("§1.1 Sub", 3, "11-sub", 0, "1-first"), ("§2 Second", 2, "2-second", 2, None)]
    assert "".join(s["body"] for s in T.sections(SAMPLE)) == SAMPLE


@pytest.mark.parametrize(
    ("text", "titles"),
    [
        ("", []),
        ("  \n\n", []),
        ("plain text", ["Preamble"]),
        ("## A\n```\n## not\n```\n## B", ["A", "B"]),
        ("Under\n-----\ntext", ["Under"]),
        ("Over\n====\n\n## A", ["Over", "A"]),
        ("## `code` and **bold** [link](x.md)", ["code and bold link"]),
        ("## closed ##\n##nospace\n    ## indented", ["closed"]),
        ("> ## quoted\n\n- ## listed", ["quoted", "listed"]),
        ("##### deep\n\n## A\n\n##### folded", ["Preamble", "A"]),
        ("## \\# escaped", ["# escaped"]),
        ("~~~\n## in\n~~~~\n## out", ["Preamble", "out"]),
        ("---\nkey: 1\n---\n## A", ["Preamble", "key: 1", "A"]),
    ],
)
def test_headings(text, titles):
    assert [s["title"] for s in T.sections(text)] == titles


def test_anchors_are_unique():
    assert [s["anchor"] for s in T.sections("## foo\n## foo-1\n## foo\n## foo\n## !!!\n## ???")] == ["foo", "foo-1", "foo-2", "foo-3", "section", "section-1"]
    with pytest.raises(ValueError, match="levels"):
        T.sections("", 3, 2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["## A", "### B", "# T", "text", "", "```", "#### C", "> q"]), max_size=12))
def test_sections_keep_every_line(lines):
    text = "\n".join(lines)
    found = T.sections(text)
    assert len({s["anchor"] for s in found}) == len(found)
    if text.strip():
        kept = "".join(s["body"] for s in found)
        assert kept == text or text.endswith(kept) and not text[: len(text) - len(kept)].strip()


def test_columns(spark):
    row = spark.createDataFrame([("Über-Größe: é!", "h\nprose", " ".join(map(str, range(10))))], "t string, b string, w string")
    got = row.select(T.slug(F.col("t")), T.own_prose(F.col("b")), T.word_chunks(F.col("w"), 4, 1), T.embeddable(F.lit("  ")), T.relative(F.lit("/r/a/b.md"), "/r/"), T.lua_modules(F.lit("local a = require('x.y') dofile(\"z.lua\")"))).first()
    assert tuple(got) == ("über-größe-é", "prose", ["0 1 2 3", "3 4 5 6", "6 7 8 9"], " ", "a/b.md", ["x/y.lua", "z.lua"])
    with pytest.raises(ValueError, match="overlap"):
        T.word_chunks(F.col("w"), 4, 4)


def referred(spark, text, path, suffix, scan=None):
    row = spark.createDataFrame([(text, path, suffix)], "t string, p string, s string")
    return [tuple(r) for r in row.select(T.references(F.col("t"), F.col("p"), F.col("s"), scan)).first()[0]]


def test_references(spark):
    text = "[a](b.md) [s](c.md#x) [t](#here) [e](#) [w](https://x.test/q.md) see §1.2 and d.lua, b.md, self.md"
    assert referred(spark, text, "/r/self.md", ".md") == [
        ("REFERENCES", "File", "/r/b.md", "md-link"),
        ("REFERENCES", "Section", "/r/c.md#x", "md-link"),
        ("REFERENCES", "Section", "/r/self.md#here", "md-link"),
        ("REFERENCES", "Section", "§1.2", "md-anchor"),
        ("REFERENCES", "File", "x.test/q.md", "md-basename"),
        ("REFERENCES", "File", "d.lua", "md-basename"),
    ]
    assert referred(spark, text, "/r/self.md", ".md", 9) == [("REFERENCES", "File", "/r/b.md", "md-link")]
    code = "require('x.y') require(\"z.lua\") dofile('w.lua') require('x.y')"
    assert [r[2:] for r in referred(spark, code, "m.lua", ".lua")] == [("x/y.lua", "lua-require"), ("z.lua", "lua-require"), ("w.lua", "lua-dofile")]
    assert referred(spark, text, "a.txt", ".txt") == referred(spark, None, "a.md", ".md") == []
    paths = {("/r/s", "../b.md"): "/r/b.md", ("/r", "../../x.md"): "/x.md", ("r", "../../x.md"): "../x.md", ("/r", "./a/./b.md"): "/r/a/b.md", ("/r", "/abs.md"): "/abs.md", ("/r", "C:\\d\\e.md"): "C:/d/e.md", ("", "q\\e.md"): "q/e.md", ("r", ".."): "."}
    df = spark.createDataFrame([(a, b, c) for (a, b), c in paths.items()], "a string, b string, c string")
    assert all(r[0] == r[1] for r in df.select(T.resolved_path(F.col("a"), F.col("b")), "c").collect())
    assert len(referred(spark, "a." * 300_000 + "md [x](y.md)", "p.md", ".md")) == 2  # a long run takes no long time


def test_json_and_templates():
    assert T.tolerant_json('noise {"a": [1, 2,], "b": ",]",} more') == {"a": [1, 2], "b": ",]"}
    for bad in ("none", "{", "}{", "{a}"):
        with pytest.raises(ValueError):
            T.tolerant_json(bad)
    assert T.summary_of('{"summary": "s", "key_points": ["a", ""]}') == {"summary": "s", "key_points": ["a"], "entities_mentioned": []}
    with pytest.raises(ValueError, match="summary"):
        T.summary_of("{}")
    assert T.filled("{{a}}-{{ b }}", {"a": "1", "b": "2", "c": "3"}) == "1-2"
    with pytest.raises(KeyError):
        T.filled("{{x}}", {})
    assert [len(b) for b in T.batches(["x" * 9] * 5, most=2)] == [2, 2, 1]
    assert [len(b) for b in T.batches(["x" * 3000, "y" * 30, "z"], budget=500)] == [1, 2]
    assert T.normalised("  Straße  X ", "Pattern") == "strasse x" and T.normalised("A  b", "Ticket") == "A b"
    assert T.route("docs/a.md", [("docs/*", "d")], None, "base") == "d" and T.route("x", [], "o", "base") == "o"


def test_similarity():
    assert S.ratio("abcd", "abxd") == 75.0
    assert S.partial_ratio("bc", "xxbcxx") == 100.0
    assert S.token_sort_ratio("new york mets", "mets york new") == 100.0
    assert S.token_set_ratio("alpha beta", "beta alpha alpha gamma") == 100.0
    assert S.wratio("", "x") == 0.0 and S.wratio("same", "same") == 100.0
    assert S.best_match("postgresql", ["mysql", "postgres"])[0] == "postgres"
    assert S.best_match("zzz", ["mysql"]) is None


def test_slugs_of_whole_texts(spark):
    from conftest import SF

    from graphloom import catalogue

    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", T.slug(F.col("text")).alias("s"))
    assert sorted(map(tuple, catalogue.QUERIES["slug"](spark, SF).collect()), key=repr) == sorted(map(tuple, texts.collect()), key=repr)


def test_sections_reach_python_in_small_batches(spark):
    from graphloom.plans import pipeline

    files = spark.range(300).selectExpr("concat('f', id) AS path", "'c' AS corpus", "CASE WHEN id % 3 > 0 THEN concat('## a\n', id, '\n### b') END AS text")
    found = pipeline.parse_sections(files)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan  # a hundred rows at most, however large the input
    assert [tuple(r) for r in found.where("path = 'f1'").orderBy("pos").select("id", "body", "parent_anchor", "ordinal").collect()] == [("f1#a", "## a\n1\n", None, 0), ("f1#b", "### b", "a", 0)]
    assert found.count() == 400

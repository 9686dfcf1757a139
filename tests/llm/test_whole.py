"""Operators do the whole job: no fixed sizes, no prefixes, no values left aside."""

from collections import Counter
from math import log

import pytest
from conftest import SF

pytest.importorskip("graphloom.llm.queries")
from pyspark.sql import functions as F  # noqa: E402


def plain_scores(docs, targets, folds):
    """doc_id -> (target loss, background loss) of texts by models of exact word and pair counts."""
    split = {i: t.lower().split() for i, t in docs.items()}
    groups = [[(Counter(), Counter(), Counter()) for _ in (0, 1)] for _ in (0, 1)]
    for i, ws in split.items():
        word, context, pair = groups[folds[i]][i in targets]
        before = [None, *ws[:-1]]
        word.update(ws), context.update(before[: len(ws)]), pair.update(zip(before, ws))
    vocabulary = len({w for ws in split.values() for w in ws})
    out = {}
    for i, ws in split.items():
        other, losses = groups[1 - folds[i]], []
        n, m = (sum(other[t][0].values()) for t in (1, 0))
        for t, scale in ((1, 1.0), (0, n / m if n and m else 1.0)):
            word, context, pair = other[t]
            loss = 0.0
            for p, w in zip([None, *ws[:-1]], ws):
                one = (word[w] * scale + 0.5) / (sum(word.values()) * scale + 0.5 * vocabulary)
                loss -= log(0.4 * pair[p, w] / context[p] + 0.6 * one) if context[p] else log(one)
            losses.append(loss / len(ws))
        out[i] = losses
    return out


def test_lm_scores_by_exact_counts(spark, monkeypatch):
    from graphloom.llm import lmscore

    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 20_000, raising=False)
    monkeypatch.setattr(lmscore, "BUCKET_BYTES", 20_000, raising=False)
    slots, clash = {}, None
    for k in range(10_000):  # two words that share a slot of 2^18
        slot = lmscore.xxhash.xxh3_64_intdigest(f"w{k}") & ((1 << 18) - 1)
        if slot in slots:
            clash = slots[slot], f"w{k}"
            break
        slots[slot] = f"w{k}"
    texts = {i: f"{clash[i % 2]} stands beside n{i} and v{i % 7} " + " ".join(f"x{i * 31 + k}" for k in range(300)) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int")
    folds = {r["doc_id"]: r["fold"] for r in lmscore.folded(df).collect()}
    want = plain_scores(texts, set(range(0, 60, 2)), folds)
    for r in lmscore.cross_entropy_difference(df, labels).collect():
        assert r["n_words"] == len(texts[r["doc_id"]].split())
        assert (r["target_loss"], r["background_loss"]) == pytest.approx(tuple(want[r["doc_id"]]), abs=2e-6)


def test_long_secrets_are_permuted_in_full(spark):
    from graphloom.llm.pii import pseudonymise

    tail = "".join("abcXYZ789-_."[(i * i + i // 7) % 12] for i in range(1400))
    texts = [f"token = {tail} end", f"token = {tail[:-1]}q end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = pseudonymise(df, "k")
    got = [r["text"] for r in new.orderBy("doc_id").collect()]
    for old, now in zip(texts, got):
        assert len(now) == len(old) and now.startswith("token = ") and now.endswith(" end")
        assert all(now[at : at + 40] != old[at : at + 40] for at in range(8, 1368, 40))
    assert got[0][8:48] != got[1][8:48]  # one prefix does not show
    assert [r["text"] for r in pseudonymise(new.drop("pseudonyms"), "k", inverse=True).orderBy("doc_id").collect()] == texts


def test_cards_and_ibans_beside_other_words(spark):
    from graphloom.llm.pii import pseudonymise

    card, iban = "4111111111111111", "DE89370400440532013000"
    beside = {
        f"{card} 123": card,
        "4111 1111 1111 1111 12": "4111 1111 1111 1111",
        f"12 {card}": card,
        f"{card} 5500000000000004": card,
        f"7 {card} 12 34 5500-0000-0000-0004 99": "5500-0000-0000-0004",
        "DE89 3704 0044 0532 0130 00 BIC COBADEFF": "DE89 3704 0044 0532 0130 00",
        f"{iban} OK": iban,
        f"XX12 3456 7890 12 {iban} OK": iban,
        "1234567890123456 " + "9" * 40: None,
    }
    texts = [*beside, *(f"{k} {card} {k}{k + 1}" for k in range(10, 40))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = pseudonymise(df, "k")
    got = [r["text"] for r in new.orderBy("doc_id").collect()]
    for old, now in zip(texts, got):
        value = beside.get(old, card)
        assert len(now) == len(old) and (now == old if value is None else value not in now)
    assert card not in got[3] and "5500000000000004" not in got[3] and card not in got[4]
    assert got[6].endswith(" OK") and got[5].endswith(" BIC COBADEFF") and got[0].endswith(" 123")
    assert [r["text"] for r in pseudonymise(new.drop("pseudonyms"), "k", inverse=True).orderBy("doc_id").collect()] == texts


def test_join_of_documents_on_the_filters_first_place(spark, monkeypatch):
    from graphloom.llm import ngramjoin

    monkeypatch.setattr(ngramjoin, "FILTER_BITS", 1 << 15)
    hashed = spark.range(300_000).select("id", F.pmod(F.xxhash64("id"), F.lit(1 << 15)).alias("h"))
    first, last = ([r["id"] for r in hashed.where(f"h = {h}").orderBy("id").limit(2).collect()] for h in (0, (1 << 15) - 1))
    words = [f"w{i}" for i in range(100)]
    texts = {first[0]: " ".join(words), last[0]: " ".join(words[:-1]), first[1]: "one of its own that is like no other", last[1]: " ".join(["x", *words[1:]])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.join_classes(df).collect()}
    linked = min(first[0], *last)
    assert got == {first[0]: linked, last[0]: linked, last[1]: linked, first[1]: first[1]}


HARD = {
    "a name of a host with many parts": "a@b" + ".c" * 100_000 + " end",
    "a long name": ".".join(["x"] * 100_000) + "@y.example end",
    "a long secret": "password=" + "abcDEF123-" * 30_000 + " end",
    "many cards": "4111111111111111 " * 1000,
    "many numbers": "1 " * 200_000,
    "many settings": "password " * 100_000,
    "many accounts": "DE89370400440532013000 " * 1000,
    "the mark": "\x01 a.b@c.de \x01 10.0.0.1",
    "a long text": "the quick brown fox " * 2_500_000 + "a.b@c.de end",
}


@pytest.mark.parametrize("name", list(HARD))
def test_pseudonyms_of_long_texts(spark, name):
    from graphloom.llm.pii import pseudonymise

    new = pseudonymise(spark.createDataFrame([(1, HARD[name])], "doc_id long, text string"), "k").collect()
    old, now = HARD[name], new[0]["text"]
    assert (now == old) == (name in ("many numbers", "many settings")) and (name == "the mark" or len(now) == len(old))
    if name.startswith("a "):  # a value stands at the start or, in the long text, at the end: no part of it is left
        end = old.rfind(" end")
        at = {"a long secret": 9, "a long text": end - 8}.get(name, 0)
        assert now[:at] == old[:at] and now[end:] == old[end:]
        assert all(now[k : k + 60] != old[k : k + 60] for k in range(at, end, 60))
    back = pseudonymise(spark.createDataFrame(new).drop("pseudonyms"), "k", inverse=True).collect()
    assert back[0]["text"] == old


def test_domains_are_hidden_and_linked(spark):
    from graphloom.llm.pii import pseudonymise

    texts = ["jane@jane-doe.example", "joe.b@jane-doe.example", "joe.b@other.example"]
    got = [r["text"] for r in pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    names, domains = zip(*(x.split("@") for x in got))
    assert domains[0] == domains[1] != domains[2] and names[1] == names[2] and all(d.endswith(".example") for d in domains)
    assert "doe" not in domains[0] and len(domains[0]) == len("jane-doe.example")


LONG = "Words of the article that go on for a while. " * 4
PAGES = {
    f"<article class='post has-share sidebar-right'><p>{LONG}</p><p>Short.</p></article><footer>end of page</footer>": f"{LONG.strip()}\nShort.",
    f"<nav><a href=x>Menu</a></nav><div class='content with-sidebar'><p>{LONG}</p></div>": LONG.strip(),
    f"<main><div class='legal'><p>{LONG}</p></div></main><footer>{LONG}</footer>": LONG.strip(),
    f"<form id=all><nav>Menu of the site</nav><div><h1>Title</h1><p>{LONG}</p></div></form>": f"Title\n{LONG.strip()}",
    f"<div><h1>Title</h1><p>By me</p><p>{LONG}</p><div class=ad>a</div><div class=ad>b</div><div class=ad>c</div><p>Last.</p></div>": f"Title\nBy me\n{LONG.strip()}\nLast.",
    f"<div><p>{LONG}</p><p><a href=x>All of this is a link</a></p><p>{LONG}</p></div>": f"{LONG.strip()}\nAll of this is a link\n{LONG.strip()}",
    f"<ul><li><a href=x>One</a><li><a href=y>Two</a></ul><p>{LONG}</p>": LONG.strip(),
    f"<div id=a><p>{LONG}</p></div><div class=comments><p>{LONG * 3}</p></div>": LONG.strip(),
    "<article><p>Tiny.</p></article><div id=comments><p>" + LONG * 9 + "</p></div>": "Tiny.",
    "a < b and <b>c</b> > d": "a < b and c > d",
    "<p onclick=\"if (a > b) x('<p>')\">One</p><p>Two": "One\nTwo",
    "<nav>only a menu</nav>": "",
}


@pytest.mark.parametrize("page", list(PAGES))
def test_lines_decide_with_and_without_article(page):
    from graphloom.llm.html import main_text

    assert main_text(page) == PAGES[page]


@pytest.mark.parametrize("change", [("<article>", "<div id=x>", "</article>", "</div>"), ("<article>", "", "</article>", ""), ("<article>", "<main><div class=legal>", "</article>", "</div></main>"), ("<body>", "<body><form>", "</body>", "</form></body>")])
def test_pages_marked_up_otherwise_give_the_same_text(spark, change):
    from graphloom.llm.html import main_text
    from graphloom.llm.tables import read

    a, b, c, d = change
    pages = [r["html"] for r in read(spark, SF, "pages").collect()]
    assert len(pages) > 20 and all(main_text(p.replace(a, b).replace(c, d)) == main_text(p) != "" for p in pages)


@pytest.mark.parametrize("unit", ["<a", '<a "', '<a b=">"', "<a '>", "<!", "<script></script", "<div>a", "<div class=ad>a", "<p>a", "<", "<table><tr><td>", "&amp", "<a x=\"'>", "<!--", "<article><p>abc</p>"])
def test_extraction_takes_time_in_proportion(unit):
    import time

    from graphloom.llm.html import main_text

    for page in (unit * 2000, unit * (1_000_000 // len(unit)), unit * (1_000_000 // len(unit)) + ">"):
        began = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - began < 10  # under a second where nothing else runs

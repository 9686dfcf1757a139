"""Functions on texts: headings, slugs, sections, chunks, references, tolerant JSON, templates."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from fnmatch import fnmatchcase

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types

from graphloom.ontology import CASELESS

_STRING, _INT = types.StringType(), types.IntegerType()
SECTION = types.StructType([types.StructField(n, t) for n, t in (("title", _STRING), ("level", _INT), ("anchor", _STRING), ("body", _STRING), ("ordinal", _INT), ("parent_anchor", _STRING), ("pos", _INT))])
REFERENCE = "array<struct<edge_type: string, target_type: string, target_name: string, rule: string>>"
# The signs by which texts refer to others.
LINK = r"\[[^\]]*+\]\(([^)\s]++)\)"
NUMBER = r"§\s*(\d++(?:\.\d++)++)"
RUN, FILE = r"(?U)\w[\w/.-]*+", r"(?U)^(.*\.(?:md|lua|toml))\b"
REQUIRE = r"""\brequire\s*\(?\s*['"]([\w./-]+)['"]"""
DOFILE = r"""\bdofile\s*\(\s*['"]([\w./-]+)['"]"""
ELSEWHERE = r"^(?:https?://|mailto:)"
WHOLE_PATH = r"^(?:/|[A-Za-z]:)"

# columns


def slug(title: Column) -> Column:
    """A heading's anchor: lower case, letters, digits, _ and -, blanks as dashes; never empty."""
    kept = F.regexp_replace(F.lower(title), r"(?U)[^\w\s-]", "")
    dashed = F.trim(F.regexp_replace(kept, r"(?U)\s+", "-"), F.lit("-"))
    return F.when(dashed == "", "section").otherwise(dashed)


def section_hash(title: Column, body: Column) -> Column:
    return F.md5(F.concat(title, F.lit("\n\n"), body))


def own_prose(body: Column) -> Column:
    """A section's text without its heading line."""
    return F.when(F.instr(body, "\n") > 0, F.substring(body, F.instr(body, "\n") + 1, F.length(body))).otherwise("")


def ascii_norm(name: Column, caseless: bool) -> Column:
    """A name to compare, for ASCII names: blanks squeezed, and without case where the label has none."""
    squeezed = F.trim(F.regexp_replace(name, r"\s+", " "))
    return F.lower(squeezed) if caseless else squeezed


def word_chunks(text: Column, size: int, overlap: int) -> Column:
    """Chunks of at most `size` words, each after the first starting `overlap` words back; a short text is one, as it is."""
    if overlap >= size:
        raise ValueError("overlap must be below the chunk size")
    words = F.array_remove(F.split(F.trim(text), r"\s+"), "")
    step = size - overlap
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(w) - size) / step).cast("int"))), lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(size)), " "))
    return F.when(F.size(words) <= size, F.array(text)).otherwise(cut(words))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 3)


def embeddable(text: Column) -> Column:
    return F.when(F.trim(text) == "", F.lit(" ")).otherwise(text)


def relative(path: Column, root: str) -> Column:
    return F.regexp_replace(path, f"^{re.escape(root.rstrip('/'))}/", "")


def section_numbers(text: Column) -> Column:
    """Numbered sections that a text names, as in a paragraph sign and 1.2."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), lambda x: F.concat(F.lit("§"), x))


def hrefs(page: Column) -> Column:
    return F.regexp_extract_all(page, F.lit(r'href="([^"]*)"'), F.lit(1))


def lua_modules(text: Column) -> Column:
    """Files that Lua code requires or runs: a module's dots are slashes."""
    required = F.transform(F.regexp_extract_all(text, F.lit(REQUIRE), F.lit(1)), lambda m: F.when(m.endswith(".lua"), m).otherwise(F.concat(F.translate(m, ".", "/"), F.lit(".lua"))))
    return F.concat(required, F.regexp_extract_all(text, F.lit(DOFILE), F.lit(1)))


def resolved_path(folder: Column, target: Column) -> Column:
    """A path seen from a folder, without . and .. where they can go; a whole path stays, with slashes."""
    slashed = F.translate(target, "\\", "/")
    steps = F.filter(F.split(F.concat_ws("/", folder, slashed), "/"), lambda x: ~x.isin("", "."))
    climbs = lambda done: (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("..")) != "..")
    walk = lambda done, x: F.when((x == "..") & climbs(done), F.slice(done, F.lit(1), F.size(done) - 1)).when((x == "..") & folder.startswith("/") & (F.size(done) == 0), done).otherwise(F.concat(done, F.array(x)))
    path = F.concat(F.when(folder.startswith("/"), "/").otherwise(""), F.array_join(F.aggregate(steps, F.array().cast("array<string>"), walk), "/"))
    return F.when(slashed.rlike(WHOLE_PATH), slashed).when(path == "", ".").otherwise(path)


def references(text: Column, path: Column, suffix: Column, scan: int | None = None) -> Column:
    """The typed references of a text by its format, each once: an array of edge_type, target_type, target_name and rule.

    Markdown refers to files and their sections by links, to numbered sections, and to files by bare names that no link
    has; Lua to what it requires or runs. `scan` bounds the characters that are read, where a corpus asks for it. A null
    text, or one of another format, has none.
    """
    body = F.coalesce(text if scan is None else F.substring(text, 1, scan), F.lit(""))
    folder, base = F.regexp_extract(path, "^(.*)/", 1), lambda x: F.substring_index(x, "/", -1)
    folder = F.when((folder == "") & path.startswith("/"), "/").otherwise(folder)

    def one(kind: str, label: str, rule: str):
        return lambda name: F.struct(F.lit(kind).alias("edge_type"), F.lit(label).alias("target_type"), name.alias("target_name"), F.lit(rule).alias("rule"))

    links = F.filter(F.regexp_extract_all(body, F.lit(LINK), F.lit(1)), lambda x: ~x.rlike(ELSEWHERE))
    file = lambda x: F.regexp_replace(x, "#[^#]*$", "")
    whole = lambda x: F.when(file(x) == "", path).otherwise(resolved_path(folder, file(x)))
    linked = F.transform(F.filter(links, lambda x: ~x.endswith("#")), lambda x: F.when(x.contains("#"), one("REFERENCES", "Section", "md-link")(F.concat(whole(x), F.lit("#"), F.substring_index(x, "#", -1)))).otherwise(one("REFERENCES", "File", "md-link")(resolved_path(folder, x))))
    known = F.array_append(F.transform(links, lambda x: base(file(x))), base(path))
    bare = F.transform(F.regexp_extract_all(body, F.lit(RUN), F.lit(0)), lambda x: F.regexp_extract(x, FILE, 1))
    bare = F.filter(bare, lambda x: (x != "") & ~F.array_contains(known, base(x)))
    markdown = F.concat(linked, F.transform(section_numbers(body), one("REFERENCES", "Section", "md-anchor")), F.transform(bare, one("REFERENCES", "File", "md-basename")))
    lua = F.transform(lua_modules(body), one("DEPENDS_ON", "File", "lua"))
    lua = F.transform(lua, lambda x: x.withField("rule", F.when(F.array_contains(F.regexp_extract_all(body, F.lit(DOFILE), F.lit(1)), x["target_name"]), "lua-dofile").otherwise("lua-require")))
    return F.array_distinct(F.when(suffix == ".md", markdown.cast(REFERENCE)).when(suffix == ".lua", lua.cast(REFERENCE)).otherwise(F.array().cast(REFERENCE)))


def custom_references(text: Column, regex: str, group: int) -> Column:
    """What one of a corpus's own patterns captures; a group that the pattern lacks gives nothing."""
    if group > re.compile(regex).groups:
        return F.array().cast("array<string>")
    return F.filter(F.regexp_extract_all(text, F.lit(regex), F.lit(group)), lambda x: x != "")


def routed(path: Column, routes: list[tuple[str, str]], default: str) -> Column:
    """The prompt of the first glob that a relative path matches."""
    from graphloom.sources.corpus import glob_regex

    out = F.lit(default)
    for glob, prompt in reversed(routes):
        out = F.when(path.rlike(glob_regex(glob)), F.lit(prompt)).otherwise(out)
    return out


# Python, for what columns cannot say


def anchor(title: str) -> str:
    kept = re.sub(r"[^\w\s-]", "", title.lower())
    return re.sub(r"\s+", "-", kept).strip("-") or "section"


_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_ITEM = re.compile(r" {0,3}(?:[-+*]|\d{1,9}[.)])(?:[ \t]+|$)")


def plain(inline: str) -> str:
    """What a heading shows: code, link and image texts without their marks."""
    text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: chr(0xE000 + ord(m[1])), inline)
    kept: list[str] = []
    text = re.sub(r"(`+)(.+?)(?<!`)\1(?!`)", lambda m: kept.append(m[2].strip() if m[2].strip() else m[2]) or f"\ue100{len(kept) - 1}\ue101", text)
    text = re.sub(r"!?\[([^\]]*)\](?:\([^)]*\)|\[[^\]]*\])", r"\1", text)
    text = re.sub(r"<(https?://[^>]*)>", r"\1", text)
    for mark in (r"\*\*\*", r"\*\*", r"\*", "___", "__", "_"):
        edge = r"(?<!\w)" if "_" in mark else ""
        after = r"(?!\w)" if "_" in mark else ""
        text = re.sub(rf"{edge}{mark}(?=\S)(.+?)(?<=\S){mark}{after}", r"\1", text)
    text = re.sub("\ue100(\\d+)\ue101", lambda m: kept[int(m[1])], text)
    return re.sub("[\ue000-\ue07f]", lambda m: chr(ord(m[0]) - 0xE000), text).strip()


def headings(lines: list[str]) -> list[tuple[int, str, int]]:
    """(level, title, line) of a Markdown text's headings, also in quotes and list items; not in code."""
    out: list[tuple[int, str, int]] = []
    fence, open_line, paragraph = "", -1, []
    for n, raw in enumerate(lines):
        line = raw.rstrip("\r\n").expandtabs(4)
        if not fence:
            while True:
                bare = re.sub(r"^ {0,3}> ?", "", line)
                if bare == line and (m := _ITEM.match(line)) and not _SETEXT.match(line) and line[m.end() :].lstrip().startswith("#"):
                    bare = line[m.end() :]
                if bare == line:
                    break
                line = bare
        if m := _FENCE.match(line):
            if not fence and not (m[1][0] == "`" and "`" in m[2]):
                fence, paragraph = m[1], []
                continue
            if fence and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
                continue
        if fence:
            continue
        if not line.strip():
            paragraph = []
            continue
        if line.startswith("    ") and not paragraph:
            continue
        if m := _ATX.match(line):
            out.append((len(m[1]), plain((m[2] or "").strip()), n))
            paragraph = []
            continue
        if paragraph and (m := _SETEXT.match(line)):
            out.append((1 if m[1][0] == "=" else 2, plain(" ".join(x.strip() for x in paragraph)), open_line))
            paragraph = []
            continue
        if _SETEXT.match(line) or re.match(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$", line):
            paragraph = []
            continue
        if not paragraph:
            open_line = n
        paragraph.append(line)
    return out


def sections(text: str, lowest: int = 2, highest: int = 4) -> list[dict]:
    """The sections of a Markdown text in order: what stands from a heading of a level in range up to the next one.

    What stands above the first is a section of its own, if not blank: named by a heading of a lower level in it.
    A section's parent is the nearest one before it of a lower level; ordinals count a parent's sections from 0.
    Anchors are made unique by a number.
    """
    if not 1 <= lowest <= highest <= 6:
        raise ValueError("levels go from 1 to 6, the lowest first")
    lines = text.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    every = headings(lines)
    heads = [h for h in every if lowest <= h[0] <= highest]
    taken: dict[str, int] = {}
    counts: dict[str | None, int] = {}
    out: list[dict] = []

    def unique(title: str) -> str:
        base = anchor(title)
        if base not in taken:
            taken[base] = 1
            return base
        n = taken[base]
        while f"{base}-{n}" in taken:
            n += 1
        taken[base], taken[f"{base}-{n}"] = n + 1, 1
        return f"{base}-{n}"

    def add(title: str, level: int, body: str, parent: str | None) -> dict:
        at = counts.get(parent, 0)
        counts[parent] = at + 1
        out.append({"title": title, "level": level, "anchor": unique(title), "body": body, "ordinal": at, "parent_anchor": parent, "pos": len(out)})
        return out[-1]

    bounds = [h[2] for h in heads] + [len(lines)]
    above = "".join(lines[: bounds[0]])
    if above.strip():
        add(next((t for level, t, n in every if n < bounds[0] and level < lowest), "Preamble"), lowest, above, None)
    open_sections: list[dict] = []
    for (level, title, line), end in zip(heads, bounds[1:], strict=True):
        while open_sections and open_sections[-1]["level"] >= level:
            open_sections.pop()
        parent = open_sections[-1]["anchor"] if open_sections else None
        open_sections.append(add(title, level, "".join(lines[line:end]), parent))
    return out


def sections_udf(lowest: int = 2, highest: int = 4):
    """sections() as a column. Rows go to Python a hundred at a time, and not as Arrow batches of ten thousand texts, whose
    sections would all be held at once."""

    @F.udf(types.ArrayType(SECTION), useArrow=False)
    def parse(text: str):
        return sections(text or "", lowest, highest)

    return parse


def normalised(name: str, label: str) -> str:
    text = re.sub(r"\s+", " ", unicodedata.normalize("NFC", name)).strip()
    return text.casefold() if label in CASELESS else text


@F.pandas_udf(types.StringType())
def norm(names: pd.Series, labels: pd.Series) -> pd.Series:
    return pd.Series([None if n is None else normalised(n, x) for n, x in zip(names, labels, strict=True)])


def tolerant_json(text: str) -> dict:
    """The object from the first { to the last }; trailing commas outside strings are forgiven."""
    begin, end = text.find("{"), text.rfind("}")
    if begin < 0 or end < begin:
        raise ValueError("no JSON object")
    body = text[begin : end + 1]
    try:
        found = json.loads(body)
    except ValueError:
        found = json.loads(re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", body))
    if not isinstance(found, dict):
        raise ValueError("not a JSON object")
    return found


@F.pandas_udf(types.StringType())
def json_body(texts: pd.Series) -> pd.Series:
    """The tolerant JSON of each text in strict form; null where there is none."""

    def one(text):
        try:
            return json.dumps(tolerant_json(text or ""))
        except ValueError:
            return None

    return texts.map(one)


def summary_of(text: str) -> dict:
    """summary (required, a string), key_points and entities_mentioned of a provider's answer."""
    found = tolerant_json(text)
    if not isinstance(found.get("summary"), str):
        raise ValueError("summary is missing")
    listed = lambda k: [str(x) for x in found.get(k) or [] if str(x).strip()]
    return {"summary": found["summary"], "key_points": listed("key_points"), "entities_mentioned": listed("entities_mentioned")}


def filled(template: str, values: dict[str, str]) -> str:
    """A template with each {{key}} replaced; a key without value raises KeyError."""
    return re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: str(values[m[1]]), template)


def batches(texts: list[str], most: int = 128, budget: int = 100_000) -> list[list[str]]:
    """Texts in order, in batches of at most `most` items and `budget` estimated tokens; an oversize text is alone."""
    out: list[list[str]] = []
    cost = 0
    for text in texts:
        n = -(-len(text) // 3)
        if not out or len(out[-1]) >= most or cost + n > budget:
            out.append([])
            cost = 0
        out[-1].append(text)
        cost += n
    return out


def route(path: str, routes: list[tuple[str, str]], override: str | None, default: str) -> str:
    return next((prompt for glob, prompt in routes if fnmatchcase(path, glob)), override or default)


def bag_vector(text: str, size: int = 64) -> list[float]:
    """A deterministic stand-in for an embedding: hashed words, of length 1; a blank text is its own word."""
    out = [0.0] * size
    for word in re.findall(r"\w+", text.lower()) or [" "]:
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
        out[h % size] += 1.0 if h >> 32 & 1 else -1.0
    norm = sum(x * x for x in out) ** 0.5
    return [x / norm for x in out] if norm else [1.0] + [0.0] * (size - 1)

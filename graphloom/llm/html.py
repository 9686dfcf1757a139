"""Main text of web pages by the distribution of text over lines (operator 7)."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import batch_arrays

# Element names of HTML and words that name the parts of a page.
RAW = frozenset("script style noscript template iframe textarea title svg math object video audio canvas select noframes xmp".split())
LEFT_OUT = frozenset("nav footer aside form button menu dialog label input fieldset head".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMES_OUT = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored promo promos promotion sidebar sidebars"
    " widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs masthead footer foot cookie cookies consent gdpr notice notices"
    " alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist respond reply replies discussion disqus"
    " social share sharing related recommended recommendations toolbar pagination pager copyright legal disclaimer hidden search form".split()
)
NAMES_MAIN = frozenset("article content main post entry story body text".split())
ROLES_OUT = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

#: Elements that hold the main text, and how much more than elsewhere a character weighs in them.
REGIONS = {"main": 4, "article": 32}
#: Elements that hold blocks; lists, tables and the like are seen through to the next of these.
CONTAINERS = frozenset("article body div html main section".split())
#: Elements, besides those with names, whose mark falls where they hold the page's text.
WRAPPERS = frozenset("form header fieldset".split())
#: What says of a name that the element has the thing beside or inside it, not that it is one.
MODIFIERS = frozenset("has with without no is show hide enable".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))|\b(hidden)\b")
WORD = re.compile(r"[a-z]+")
#: Names that run words together.
JOINED = re.compile(r"\w*(?:nav|menu|sidebar|footer|comments?|cookies?|banner)|(?:advert|comment|promo|newsletter|sponsor)\w*")


class Line(NamedTuple):
    """A block of a page: its text, characters of links in it, the element around it, and the innermost mark over it (0: none)."""

    text: str
    linked: int
    node: int
    mark: int


class Page(NamedTuple):
    """Lines in order. Elements are numbered as they open: parents, names and the last one inside each. Marks too: the mark
    around each, whether it falls where it covers the page's text, and whether it lies in a main element."""

    lines: list[Line]
    parent: list[int]
    name: list[str]
    last: list[int]
    marks: list[tuple[int, bool, bool]]


def _tokens(value: str) -> tuple[bool, bool]:
    """Whether a class or id names the main text, and whether it names something beside it."""
    main = out = False
    for token in value.split():
        parts = WORD.findall(token)
        if parts and all(w in NAMES_MAIN for w in parts):
            main = True
        elif parts and parts[0] not in MODIFIERS:
            out = out or any(w in NAMES_OUT or JOINED.fullmatch(w) for w in parts) or (parts[0] == "header" and len(parts) == 1)
    return main, out


def _mark(name: str, attributes: str, inside: bool) -> str:
    """How an element is marked as beside the main text: "" not at all, "soft" by what may be wrong, or "hard"."""
    if name in LEFT_OUT or (name == "header" and not inside):
        return "soft" if name in WRAPPERS else "hard"
    if "=" not in attributes and "hidden" not in attributes:
        return ""
    main = out = False
    for key, a, b, c, alone in ATTRIBUTE.findall(attributes):
        key, value = (key or alone).lower(), (a or b or c).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return "hard"
        if key == "role":
            out, main = out or value in ROLES_OUT, main or value in REGIONS
        elif key in ("class", "id"):
            m, o = _tokens(value)
            main, out = main or m, out or (o and not (inside and value.strip() == "header"))
    return "soft" if out and not main and name not in ("html", "body", *REGIONS) else ""


def _tag_end(page: str, at: int, failed: list[list[int]]) -> int:
    """Past the > that ends the tag at `at`, quoted ones aside; where that finds none, past the first > of any kind.

    A search that runs to the page's end leaves the quotes that it met in `failed`: one that starts outside of them would
    go the same way. There are three ways to be in or out of quotes, so few searches fail.
    """
    if not any(bisect_right(quotes, at) % 2 == 0 for quotes in failed if quotes[0] <= at):
        quotes, p = [at, at], at
        while found := STOP.search(page, p):
            if found[0] == ">":
                return found.end()
            shut = page.find(found[0], found.end())
            quotes += [found.start(), shut if shut >= 0 else len(page)]
            if shut < 0:
                break
            p = shut + 1
        failed.append(quotes)
    return page.find(">", at) + 1


def scan(page: str) -> Page:
    """The blocks of a page, its elements and marks, in one pass.

    Text is taken between tags, character references decoded, white space as one space. Comments, declarations,
    scripts, styles and the like give none. A < that no > follows is text. A tag that is never closed ends with the
    element around it.
    """
    out = Page([], [0], [""], [0], [(0, False, False)])
    stack: list[tuple[int, str, int, bool]] = [(0, "", 0, False)]  # element, name, mark, inside a main region
    depth: Counter[str] = Counter()
    buffer: list[str] = []
    failed: list[list[int]] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                out.lines.append(Line(text, min(linked, len(text)), stack[-1][0], stack[-1][2]))
            buffer.clear()
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        buffer.append(piece)
        if in_link:
            linked += len(piece.strip())

    def leave() -> None:
        node, name, _, _ = stack.pop()
        out.last[node] = len(out.parent) - 1
        depth[name] -= 1

    at, end, final = 0, len(page), page.rfind(">")
    while at < end:
        start = page.find("<", at)
        if start < 0 or start > final:
            text(page[at:])
            break
        if start > at:
            text(page[at:start])
        closing = page.startswith("/", start + 1)
        found = NAME.match(page, start + 1 + closing)
        if not found:
            if page.startswith("<!--", start):
                shut = page.find("-->", start + 4)
                at = shut + 3 if shut >= 0 else end
            elif page.startswith("<![CDATA[", start) and (shut := page.find("]]>", start)) >= 0:
                at = shut + 3
            elif page[start + 1 : start + 2] in ("!", "?", "/"):
                at = page.find(">", start) + 1
            else:
                text("<")
                at = start + 1
            continue
        name = found[0].lower()
        at = _tag_end(page, found.end(), failed)
        rest = page[found.end() : at - 1]
        if name in RAW:
            if not closing and not rest.endswith("/"):
                shut = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
                at = page.find(">", shut.end()) + 1 if shut and shut.end() <= final else end
            buffer.append(" ")
            continue
        if name == "a":
            in_link = not closing
        if name == "br":
            buffer.append(" ")
            continue
        block = name in BLOCKS
        if block:
            flush()
        if name in VOID:
            continue
        if closing:
            if depth[name]:
                if not block:
                    flush()
                while stack[-1][1] != name:
                    leave()
                leave()
            continue
        if block and stack[-1][1] == "p":
            leave()
        if name in ("li", "dt", "dd", "tr", "td", "th") and stack[-1][1] == name:
            leave()
        if block or "=" in rest or name in LEFT_OUT:
            _, _, above, inside = stack[-1]
            kind = _mark(name, rest, inside)
            if block or kind:
                if not block:
                    flush()
                if kind:
                    out.marks.append((above, kind == "soft", inside))
                    above = len(out.marks) - 1
                stack.append((len(out.parent), name, above, inside or name in REGIONS))
                out.parent.append(stack[-2][0])
                out.name.append(name)
                out.last.append(0)
                depth[name] += 1
    flush()
    while len(stack) > 1:
        leave()
    out.last[0] = len(out.parent) - 1
    return out


def _left_out(page: Page, plain: list[int], region: list[int]) -> list[bool]:
    """Whether each mark holds. Where no main element has text of its own and less than a tenth of the page's is left, marks
    fall that cover over half of it, or of that in main elements: no name can empty a page."""
    hard = [False]
    for above, soft, _ in page.marks[1:]:
        hard.append(hard[above] or not soft)
    totals, central = [0] * len(page.marks), [0] * len(page.marks)
    for line, n in zip(page.lines, plain, strict=True):
        if not hard[line.mark]:
            totals[line.mark] += n
            central[line.mark] += n if region[line.node] > 1 else 0
    whole, middle, free, inside = sum(totals), sum(central), totals[0], central[0]
    own, own_central = list(totals), list(central)
    for m in range(len(totals) - 1, 0, -1):
        totals[page.marks[m][0]] += totals[m]
        central[page.marks[m][0]] += central[m]
    sums, most = (central, middle) if middle else (totals, whole)
    held = [False]
    for m, (above, _, _) in enumerate(page.marks[1:], 1):  # a mark comes after those around it, and one alone at most covers over half
        falls = not hard[m] and not held[above] and 2 * sums[m] > most and not inside and 10 * free < whole
        held.append(not falls)
        if falls:
            free, inside = free + own[m], inside + own_central[m]
    for m, (above, _, _) in enumerate(page.marks[1:], 1):
        held[m] = held[m] or held[above]
    return held


def _runs(weights: list[int], window: int, surge: int) -> list[tuple[int, int]]:
    """Where the sum over `window` lines surges and dives: ranges of lines that begin and end with one that weighs something."""
    n = len(weights)
    upto = [0, *accumulate(weights)]
    sums = [upto[min(i + window, n)] - upto[i] for i in range(n)]
    least, out, i = max(1, min(surge, max(sums, default=0))), [], 0
    while i < n:
        if sums[i] < least:
            i += 1
            continue
        j = i
        while j < n and sums[j] > 0:
            j += 1
        begin = next(k for k in range(i, n) if weights[k])
        stop = next(k for k in range(j - 1, i - 1, -1) if weights[k])
        out.append((begin, stop + 1))
        i = j
    return out


def main_text(page: str | None, window: int = 3, surge: int = 86, density: float = 0.5) -> str:
    """The blocks between surge and dive of the line-block distribution, joined by newlines.

    A line weighs its characters outside links, and nothing where links are over `density` of it or where the markup
    marks it as beside the text: by its element (nav, footer, form and so on), or by a name, role or style. Names are no more
    than a weight: text in a main element counts 4 times, in an article 32 times, and a mark falls that covers the page's text.

    The sum over `window` lines surges where it passes `surge` (or the page's largest sum, if less), and dives where it
    comes to 0. The heaviest run of lines between the two says where the main text is: in the smallest container that
    holds that run, or the article around it, or the article or main element inside it that has most of its weight.
    All lines there that weigh something are kept, surge or not, and lines of links between those of a run. Other runs
    stay where they lie beside that container in the same one and no article or main element bounds it.
    """
    found = scan(page or "")
    lines = found.lines
    plain = [0 if x.linked > density * len(x.text) else len(x.text) - x.linked for x in lines]
    region = [1] * len(found.parent)
    for k in range(1, len(region)):
        region[k] = REGIONS.get(found.name[k], region[found.parent[k]])
    held = _left_out(found, plain, region)
    weights = [0 if held[x.mark] else n * region[x.node] for x, n in zip(lines, plain, strict=True)]
    runs = _runs(weights, window, surge)
    if not runs:
        return ""
    within = lambda node, k: k <= node <= found.last[k]  # noqa: E731  elements are numbered as they open
    first, stop = max(runs, key=lambda r: (sum(weights[r[0] : r[1]]), -r[0]))
    nodes = [lines[k].node for k in range(first, stop) if weights[k]]
    home, furthest = min(nodes), max(nodes)
    while home and not (found.name[home] in CONTAINERS and within(furthest, home)):
        home = found.parent[home]
    above, k = home, home
    while k:
        if found.name[k] == "article":
            above = k
        k = found.parent[k]
    home = above
    while True:  # down to the article or main element with most of the weight
        inner = {k for k in range(home + 1, found.last[home] + 1) if found.name[k] in REGIONS}
        share: Counter[int] = Counter()
        whole = 0
        for x, w in zip(lines, weights, strict=True):
            if w and within(x.node, home):
                whole += w
                k = x.node
                if inner and region[k] > 1:
                    while k != home and k not in inner:
                        k = found.parent[k]
                    if k != home:
                        share[k] += w
        best = max(share, key=share.__getitem__, default=0)
        if not best or 2 * share[best] < whole or found.name[home] == "article":
            break
        home = best
    beside = home
    if region[home] == 1 and home:
        beside = found.parent[home]
        while beside and found.name[beside] not in CONTAINERS:
            beside = found.parent[beside]
    keep = set()
    for a, b in runs:
        heavy = sum(weights[a:b]) >= surge and all(within(lines[k].node, beside) for k in range(a, b) if weights[k])
        around = beside if heavy else home
        keep.update(k for k in range(a, b) if not held[lines[k].mark] and within(lines[k].node, around))
    keep.update(k for k, x in enumerate(lines) if weights[k] and within(x.node, home))
    return "\n".join(lines[k].text for k in sorted(keep))


def extract(df: DataFrame, page: str = "html") -> DataFrame:
    """df with text and n_chars (code points) in place of the page and of columns of those two names; all others stay.

    The whole page is read, in time proportional to its length. A page without main text, an empty or a null one gives an
    empty text and 0; repeated rows are treated alike; an empty table gives no rows.
    """
    kept = [c for c in df.columns if c not in ("text", "n_chars", page)]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{page}`").alias("text"), F.lit(0).cast("long").alias("n_chars"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for columns in batch_arrays([batch.rename_columns([str(k) for k in range(batch.num_columns)])], *map(str, range(batch.num_columns))):
                texts = [main_text(x) for x in columns[-2].to_pylist()]
                yield pa.RecordBatch.from_arrays([*columns[:-2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    return rows.mapInArrow(run, rows.schema)

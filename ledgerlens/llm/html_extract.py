"""HTML main text by union-free wrapper inference.

A page is read as a tree of block elements. Runs of equal neighbours (one to three elements long) become repeated
groups, and pages of one host are aligned one after another: children are matched in order by tag and class, what only
one side has becomes optional, texts that differ become slots. The outcome is a union-free regular expression over
tags and texts, the host's wrapper. Alignment is a fold: every task folds its own pages of a host, and the partial
wrappers, as many as tasks at most, are folded again, so a host with a third of all pages is spread over all tasks.
The wrapper decides once per host which of its parts carry the main text; pages are then read through it: a page with
text in a main part by these parts, any other page of the host by what is neither menu nor fixed.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import written

# HTML element names and the words by which pages name their parts.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|iframe|select|object|canvas|noembed|noframes|xmp"
BLOCKS = frozenset(
    "html body head address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CHROME_TAGS = frozenset("head nav header footer aside form dialog menu search button label".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
CHROME_WORDS = frozenset(
    "ad ads advert advertisement advertising adsbygoogle sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation topbar breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notification alert popup modal overlay comment comments reply replies respond disqus share sharing social related recommended newsletter subscribe subscription signup login search widget toolbar pagination pager copyright disclaimer".split()
)
MAIN_WORDS = frozenset("article main".split())
WHOLE = frozenset("html body article main".split())  # never named as beside the text by class or id
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"html", "body", "head"}
#: What an opening tag ends, up to the nearest of the second set.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"})}

#: Elements whose content is no text, up to their end tag; svg and math close at once where they close themselves or have none.
_RAW = frozenset(RAW.split("|"))
_FOREIGN = frozenset(("svg", "math"))
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_QUOTE_OR_END = re.compile(r"[\"'>]")
#: Words that say nothing of a part beside a telling one: "cookie-box" names itself a notice, "cookie-recipes" does not.
NEUTRAL = frozenset("area bar block box button buttons container content items left link links list main panel posts right section slot thread top bottom unit wrap wrapper".split())
#: Depth of nesting up to which elements are told apart; deeper ones are read as neighbours there, so no depth can exhaust a stack.
DEEP = 100
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v\xa0]+")


def _label(tag: str, attributes: str) -> str:
    """Tag with its classes (numbers aside), and "!" if the element names itself as something beside the text. "?" and
    the words that say so if they may as well name what the text is about: among other words of a class or an id."""
    chrome, slug, classes, named, weak = tag in CHROME_TAGS, "", [], False, set()
    if attributes and "=" in attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            value, name = next((v for v in values if v), "").lower(), name.lower()
            if name == "role":
                chrome = chrome or value in CHROME_ROLES
                if value == "main":
                    classes.append("main")
                continue
            words = value.split()
            if name == "class":
                classes += [re.sub(r"\d+", "0", w) for w in words]
            elif tag in HEADINGS:
                continue
            for w in words:
                parts = {x for x in re.split(r"[-_\d]+", w) if x}
                if found := parts & CHROME_WORDS:
                    whole = parts <= CHROME_WORDS | NEUTRAL and (name == "class" or tag != "section" and "section" not in classes)
                    named = named or whole
                    weak |= found
        if tag not in WHOLE and weak:
            chrome = chrome or named
            slug = f"#{'-'.join(sorted(weak))}?"
    return ".".join([tag, *sorted(set(classes))]) + ("!" if chrome else slug)


def _tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """start, end, "/" of an end tag, name ("" for what is no element) and attributes, in one pass over the page.

    What is known to be missing ahead (a ">", a quote, the end of an element) is not looked for again, so the work is
    in proportion to the page, whatever it leaves open.
    """
    at, size = 0, len(page)
    last_end, last_quote = page.rfind(">"), {q: page.rfind(q) for q in "\"'"}
    quotes = True
    endless: set[str] = set()
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            yield start, at, "", "", ""
            continue
        if start > last_end:
            return  # cut-off tags are text
        m = _NAME.match(page, start)
        if not m:
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                at = page.find(">", start) + 1
                yield start, at, "", "", ""
            else:
                at = start + 1
            continue
        end = -1
        if quotes:
            i = m.end()
            while q := _QUOTE_OR_END.search(page, i):
                if q[0] == ">":
                    end = q.start()
                    break
                i = page.index(q[0], q.end()) + 1 if last_quote[q[0]] >= q.end() else q.end()
            quotes = end >= 0  # else no ">" outside quotes from here on
        if end < 0:
            end = page.find(">", m.end())
        name, attributes, at = m[2].lower(), page[m.end() : end], end + 1
        if not m[1] and (name in _RAW or name in _FOREIGN and not attributes.endswith("/")):
            close = None if name in endless else _end_of(name).search(page, at)
            if close:
                at = close.end()
            elif name in _RAW:
                at = size
            else:
                endless.add(name)
            yield start, at, "", "", ""
        else:
            yield start, at, m[1], name, attributes


@lru_cache(maxsize=None)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.I)


def walk(page: str, enter, leave, text) -> None:
    """Calls enter(label), leave() of block elements and text(chars, in_link) in page order, at most DEEP + 1 deep.

    A deeper element comes as a child of its ancestor at DEEP, open while it has the text; what is in one that names
    itself beside the text names itself so too.
    """
    stack: list[str] = []
    labels: list[str] = []
    count: Counter[str] = Counter()
    links, at, shown = 0, 0, False

    def close(upto: int) -> None:
        nonlocal shown
        while len(stack) > upto:
            if len(stack) <= DEEP:
                leave()
            elif shown:
                leave()
                shown = False
            count[stack.pop()] -= 1
            labels.pop()

    def chars(part: str, in_link: bool) -> None:
        nonlocal shown
        if len(stack) > DEEP and not shown:
            enter(labels[-1])
            shown = True
        text(part, in_link)

    def down(to: str) -> int:
        k = len(stack) - 1
        while stack[k] != to:
            k -= 1
        return k

    for start, end, closing, tag, attributes in _tokens(page):
        if start > at:
            chars(page[at:start], links > 0)
        at = end
        if not tag:
            continue
        if closing:
            if tag == "a":
                links = 0
            elif count[tag]:
                close(down(tag))
        elif tag == "a":
            links = 1
        elif tag == "br":
            chars(" ", False)
        elif tag in BLOCKS or tag in CHROME_TAGS:
            if tag in CLOSES_P and count["p"]:
                close(down("p"))
            if tag in IMPLIED and any(count[x] for x in IMPLIED[tag][0]):
                ended, fence = IMPLIED[tag]
                k, lowest = len(stack) - 1, len(stack)
                while k >= 0 and stack[k] not in fence:
                    if stack[k] in ended:
                        lowest = k
                    k -= 1
                close(lowest)
            label = _label(tag, attributes)
            if len(stack) >= DEEP and labels[-1][-1] == "!" and label[-1] != "!":
                label = label.rstrip("?") + "!"
            if shown:
                leave()
            stack.append(tag)
            labels.append(label)
            count[tag] += 1
            shown = len(stack) > DEEP
            enter(label)
            if tag in VOID:
                close(len(stack) - 1)
    if at < len(page):
        chars(page[at:], links > 0)
    close(0)


#: Page contents that a node holds at most, and over which a text must be constant to be fixed.
LEAST_PAGES = 4


# A wrapper node: label, children, repeated, optional, text ("" none, "=..." constant, "~..." length and hash of a long
# constant, "#" slot), chars, link chars, hashes of the first LEAST_PAGES different pages that have a text here.
def _node(label: str) -> dict:
    return {"l": label, "k": [], "r": False, "o": False, "t": "", "c": 0, "a": 0, "n": []}


def page_tree(page: str) -> dict:
    root = _node("")
    stack, texts = [root], [[]]
    this_page, content, beside = [0], xxhash.xxh3_64(), 0  # pages that differ beside the text only are copies

    def enter(label: str) -> None:
        nonlocal beside
        stack.append(_node(label))
        texts.append([])
        beside += label[-1] in "!?"

    def leave() -> None:
        nonlocal beside
        node, own = stack.pop(), texts.pop()
        chars = _SPACE.sub(" ", "".join(own)).strip()
        if chars:
            node["n"] = this_page
            node["t"] = f"={chars}" if len(chars) <= 120 else f"~{len(chars)}:{xxhash.xxh3_64_hexdigest(chars.encode('utf-8', 'surrogatepass'))}"
            if not beside:
                content.update(f"{len(chars)}:{chars}".encode("utf-8", "surrogatepass"))
        beside -= node["l"][-1] in "!?"
        node["c"] = len(chars)
        node["k"] = collapse(node["k"])
        stack[-1]["k"].append(node)

    def text(chars: str, in_link: bool) -> None:
        texts[-1].append(chars)
        if in_link:
            stack[-1]["a"] += len(chars)

    walk(page, enter, leave, text)
    root["k"] = collapse(root["k"])
    this_page[0] = content.intdigest()
    return root


def _pages(a: list[int], b: list[int]) -> list[int]:
    if not b or len(a) >= LEAST_PAGES or a == b:
        return a
    return sorted({*a, *b})[:LEAST_PAGES] if a else b


def collapse(kids: list[dict]) -> list[dict]:
    """Neighbouring runs of equal labels, up to three long, as repeated groups."""
    for size in (1, 2, 3):
        out: list[dict] = []
        i = 0
        while i < len(kids):
            run = kids[i : i + size]
            labels = [x["l"] for x in run]
            j = i + size
            while len(run) == size and [x["l"] for x in kids[j : j + size]] == labels:
                run = [merge(a, b) for a, b in zip(run, kids[j : j + size])]
                j += size
            if j == i + size:
                out.append(kids[i])
                i += 1
                continue
            if size == 1:
                out.append(run[0] | {"r": True})
            else:
                out.append(_node("*") | {"l": "*" + "+".join(labels), "k": run, "r": True, "n": reduce(_pages, (x["n"] for x in run))})
            i = j
        kids = out
    return kids


def merge(a: dict, b: dict) -> dict:
    """The least wrapper of two of one label."""
    text = a["t"] if a["t"] == b["t"] else b["t"] if not a["t"] else a["t"] if not b["t"] else "#"
    return {"l": a["l"], "k": align(a["k"], b["k"]), "r": a["r"] or b["r"], "o": a["o"] or b["o"], "t": text, "c": a["c"] + b["c"], "a": a["a"] + b["a"], "n": _pages(a["n"], b["n"])}


def align(x: list[dict], y: list[dict]) -> list[dict]:
    """Children matched in order by label; what is left over becomes optional."""
    lx, ly = [k["l"] for k in x], [k["l"] for k in y]
    if lx == ly:
        return [merge(a, b) for a, b in zip(x, y)]
    out, i, j = [], 0, 0
    for m, n in [*_matches(lx, ly), (len(x), len(y))]:
        out += [k | {"o": True} for k in (*x[i:m], *y[j:n])]
        if m < len(x):
            out.append(merge(x[m], y[n]))
        i, j = m + 1, n + 1
    return collapse(out)


#: Cells of a matching table; wider neighbourhoods are matched first come, first served.
TABLE = 1 << 18


def _matches(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of labels matched in order, as many as can be."""
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    u, v = x[head : len(x) - tail], y[head : len(y) - tail]
    middle: list[tuple[int, int]] = []
    if len(u) * len(v) <= TABLE:
        best = [[0] * (len(v) + 1) for _ in range(len(u) + 1)]
        for i in range(len(u) - 1, -1, -1):
            for j in range(len(v) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if u[i] == v[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(u) and j < len(v):
            if u[i] == v[j]:
                middle.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    else:
        places: dict[str, deque[int]] = {}
        for j, label in enumerate(v):
            places.setdefault(label, deque()).append(j)
        last = -1
        for i, label in enumerate(u):
            free = places.get(label, ())
            while free and free[0] <= last:
                free.popleft()
            if free:
                last = free.popleft()
                middle.append((i, last))
    return [*((k, k) for k in range(head)), *((head + i, head + j) for i, j in middle), *((len(x) - k, len(y) - k) for k in range(tail, 0, -1))]


def expression(node: dict) -> str:
    """The wrapper as a union-free regular expression."""
    inner = (node["t"] if node["t"][:1] in "#~" else node["t"][1:]) + "".join(map(expression, node["k"]))
    body = inner if node["l"][:1] in ("", "*") else f"<{node['l'].rstrip('!?')}>{inner}</>"
    if node["r"]:
        body = f"({body})+"
    return f"({body})?" if node["o"] else body


#: Of a path: its text is kept on pages that have text in an article or main part, and on pages that have none.
WITH_MAIN, WITHOUT_MAIN = 1, 2


def decide(wrapper: dict, least_pages: int = LEAST_PAGES) -> dict[str, int]:
    """Path -> on which pages its own text is kept. WITH_MAIN: it is inside an article or main part. WITHOUT_MAIN: all
    text, but for menus (repeated groups mostly of links) and texts constant over least_pages different pages (LEAST_PAGES
    at most) of a host whose other texts vary. Parts that name themselves as something beside the text never are; those that
    may as well name what the text is about are, unless they are mostly links, constant over as many pages, or not in a
    main part and repeated or on some pages only."""
    is_main = lambda label: bool(MAIN_WORDS & set(label.split("."))) and label[-1:] not in ("!", "?")
    constant = lambda node: node["t"][:1] in ("=", "~") and len(node["n"]) >= least_pages
    nodes: list[tuple[str, dict, bool, bool, bool]] = []

    sums = _sums(wrapper, {})

    def visit(node: dict, path: str, chrome: bool, main: bool, menu: bool) -> None:
        chars, links = sums[id(node)]
        if node["l"] and not node["l"].startswith("*"):
            path = f"{path}/{node['l']}"
            chrome = chrome or node["l"].endswith("!") or node["l"].endswith("?") and (links > 0.6 * chars or all(map(constant, _with_text(node))) or not main and (node["r"] or node["o"]))
            main = main or is_main(node["l"])
        menu = menu or (node["r"] or node["l"].split(".")[0] in ("ul", "ol")) and chars > 0 and links > 0.6 * chars
        nodes.append((path, node, chrome, main, menu))
        for kid in node["k"]:
            visit(kid, path, chrome, main, menu)

    visit(wrapper, "", False, False, False)
    varied = any(node["t"] == "#" and not chrome for _, node, chrome, _, _ in nodes)
    out: dict[str, int] = {}
    for path, node, chrome, main, menu in nodes:
        fixed = varied and constant(node) and not node["r"]
        keep = 0 if chrome else WITH_MAIN * main | WITHOUT_MAIN * (not menu and not fixed)
        out[path] = out.get(path, 0) | keep
    return out


def _with_text(node: dict) -> list[dict]:
    return [node] * bool(node["t"]) + [x for kid in node["k"] for x in _with_text(kid)]


def _sums(node: dict, out: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Characters, and those in links, of each node with all below it."""
    own = [(node["c"], node["a"])]
    for kid in node["k"]:
        own.append(_sums(kid, out)[id(kid)])
    out[id(node)] = (sum(c for c, _ in own), sum(a for _, a in own))
    return out


def main_text(page: str, keep: dict[str, int]) -> str:
    """Blocks of the kept paths, decoded, white space as one space, trimmed, joined by line breaks."""
    blocks: list[tuple[int, str]] = []
    paths, parts = [""], []

    def end() -> None:
        if parts:
            block = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            block = " ".join(block.split())
            if block:
                blocks.append((keep.get(paths[-1], 0), block))
            parts.clear()

    def enter(label: str) -> None:
        end()
        paths.append(f"{paths[-1]}/{label}")

    def leave() -> None:
        end()
        paths.pop()

    def text(chars: str, in_link: bool) -> None:
        if keep.get(paths[-1]):
            parts.append(chars)

    walk(page, enter, leave, text)
    end()
    kind = WITH_MAIN if any(k & WITH_MAIN for k, _ in blocks) else WITHOUT_MAIN
    return "\n".join([block for k, block in blocks if k & kind])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _fold(rows: Iterator[pa.RecordBatch], tree, most_hosts: int) -> Iterator[pa.RecordBatch]:
    """host, wrapper: of the rows met, folded per host; when one more host than most_hosts comes, those held are flushed."""
    held: dict[str, dict] = {}

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())], names=["host", "wrapper"])
        held.clear()
        return batch

    for batch in rows:
        for host, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if host not in held and len(held) >= most_hosts:
                yield out()
            own = tree(value or "")
            held[host] = merge(held[host], own) if host in held else own
    if held:
        yield out()


def wrappers(pages: DataFrame, most_hosts: int = 2_000) -> DataFrame:
    """host, wrapper (JSON) of every host; pages has url and html."""
    rows = pages.select(host_of(F.col("url")).alias("host"), "html")
    parts = written(rows.mapInArrow(lambda b: _fold(b, page_tree, most_hosts), "host string, wrapper string"), "wrapper-parts")
    whole = parts.repartition("host").sortWithinPartitions("host", "wrapper")
    return written(whole.mapInArrow(lambda b: _fold(b, json.loads, 1), "host string, wrapper string"), "wrappers")


def decided(found: DataFrame) -> DataFrame:
    """host, paths (those kept on some pages, see decide) of each wrapper."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, wrapper in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist()):
                keep = {path: k for path, k in decide(json.loads(wrapper)).items() if k}
                yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([json.dumps(keep)], pa.string())], names=["host", "paths"])

    return written(found.mapInArrow(run, "host string, paths string"), "wrapper-paths")


def extract(pages: DataFrame, max_broadcast_bytes: int = 16 << 20) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars (code points).

    A null page or one without main text gives the empty string; a null or odd url belongs to the host ''. Cut-off
    tags, comments and references are read as far as they go. Rows that repeat are pages of their own. Very long pages
    are read whole, and elements more than DEEP deep as neighbours. The paths to keep are broadcast if they have
    max_broadcast_bytes at most, else the join shuffles pages. Other columns are not read.
    """
    found = decided(wrappers(pages))
    size = found.agg(F.coalesce(F.sum(F.length("paths")), F.lit(0)).alias("n")).first()["n"]
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    rows = rows.join(F.broadcast(found) if size <= max_broadcast_bytes else found, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[str, int]] = {}
        for batch in batches:
            texts = []
            for page, host, paths in zip(batch.column("html"), batch.column("host").to_pylist(), batch.column("paths")):
                if host not in known:
                    if len(known) >= 2_000:
                        known.clear()
                    known[host] = json.loads(paths.as_py() or "{}")
                texts.append(main_text(page.as_py() or "", known[host]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    key = pages.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "html", "host", "paths").mapInArrow(run, f"page_id {key}, url string, text string, n_chars long")

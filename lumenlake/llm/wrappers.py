"""Main text of web pages by wrappers inferred per host.

A page becomes a stream of tags and text slots, folded where siblings repeat.  The streams of a host are
aligned one after the other into a union-free regular expression: a tag that only some pages have
becomes optional, one that pages repeat becomes a repeated group, and texts become slots.  Each page is
then matched against its host's expression.  Each slot of that gathers statistics over all pages of the
host, and those decide, per page layout, which slots hold the article.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import bound_batches, materialize

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|math|textarea|select|button|object|canvas|audio|video|title)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|$)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s>/]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<[a-zA-Z/!?][^>]*(?:>|$)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_TELLING = re.compile("class|id|role|hidden|style", re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.S)

# HTML element names, and the words that name page furniture in class, id and role; a name of
# several words tells only if its other words are of those that go with anything.
_BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = _BLOCK - {"li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "summary", "figcaption", "html", "body", "head"}
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "p": {"div", "article", "section", "td", "li", "body", "blockquote", "aside", "footer", "nav", "main", "header", "figure", "form"}}
_FURNITURE_TAGS = set("head nav aside footer form menu dialog fieldset".split())
_FURNITURE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent notice notices notification alert popup modal overlay newsletter subscribe signup share sharing social comment comments respond reply replies disqus login search widget skip hidden".split()
)
_AROUND = set("a area bar block body bottom box btn button buttons container content form group header holder icon inner item items left link links list main native outer page panel primary right row secondary section site slot space tag text title top unit wrap wrapper zone".split())
_FURNITURE_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_MAIN = ("article", "main")


def _words(value: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())


def _names_furniture(names: str) -> bool:
    """Whether one of the names of a class or id attribute is made of words of furniture alone."""
    for name in names.split():
        words = _words(name)
        if not _FURNITURE_WORDS.isdisjoint(words) and _FURNITURE_WORDS.union(_AROUND).issuperset(words):
            return True
    return False


@lru_cache(maxsize=4096)
def _signature(tag: str, attributes: str) -> tuple[str, bool]:
    """Tag and first class word of an element, and whether it is page furniture by itself."""
    if not _TELLING.search(attributes):
        return tag, tag in _FURNITURE_TAGS
    fields: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(attributes):
        fields.setdefault(name.lower(), value.strip("\"'"))
    classes = _words(fields.get("class", ""))
    role = fields.get("role", "").lower()
    is_main = tag in ("article", "main", "body", "html") or role in ("main", "article")
    marked = tag in _FURNITURE_TAGS or role in _FURNITURE_ROLES or "hidden" in fields or fields.get("aria-hidden", "") == "true"
    marked = marked or bool(re.search(r"display\s*:\s*none", fields.get("style", ""), re.I))
    marked = marked or _names_furniture(fields.get("class", "")) or _names_furniture(fields.get("id", ""))
    name = "main" if role == "main" else tag
    return f"{name}.{classes[0]}" if classes else name, marked and not is_main


#: Share of a page's text outside of links in a form or fieldset from which, with a paragraph in it, it is no furniture.
FORM_SHARE = 0.8


def _containers(source: str) -> set[int]:
    """The numbers of the start tags of forms and fieldsets that hold a page's article: a main element, or a
    paragraph and nearly all of the text that is not in links."""
    open_: list[list] = []  # tag, number, text before it, whether it has a main element, a paragraph
    ended: list[tuple[int, int, bool, bool]] = []
    number = text = links = 0

    def end(k: int) -> None:
        for _, n, before, main, paragraph in open_[k:]:
            ended.append((n, text - before, main, paragraph))
        del open_[k:]

    for token in _TOKEN.finditer(source):
        if token["text"] is not None:
            text += 0 if links else len(token["text"].strip())
            continue
        tag = (token["tag"] or "").lower()
        if tag == "a":
            links = 0 if token["close"] else 1
        elif tag in ("form", "fieldset") and token["close"]:
            k = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == tag), None)
            if k is not None:
                end(k)
        elif tag in ("form", "fieldset"):
            open_.append([tag, number, text, False, False])
            number += 1
        elif tag and not token["close"]:
            main = tag in _MAIN or _signature(tag, token["attributes"])[0].startswith("main")
            for one in open_ if main or tag == "p" else ():
                one[3], one[4] = one[3] or main, True
    end(0)
    return {n for n, held, main, paragraph in ended if main or (paragraph and held >= FORM_SHARE * text)}


#: Elements nested deeper belong to their ancestor of this depth, but for furniture, which still goes.
MOST_DEPTH = 150


class Page:
    """Blocks and the folded shape of one page.

    blocks: (path, text, characters inside links) in page order; a path names the elements from the
    root, those of page furniture with a "!" behind.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str, int]] = []
        self.tree: list = ["", []]
        self.places: list[tuple[list, int]] = []  # per block the node and the number of its text child
        stack: list[tuple[str, str, list]] = [("", "", self.tree)]  # tag, path, node
        quiet: list[str] = []  # open inline elements of furniture
        pieces: list[str] = []
        linked = links = 0
        opened: Counter[str] = Counter()
        containers = _containers(source) if re.search("<(?:form|fieldset)", source, re.I) else set()
        forms = 0

        def flush() -> None:
            nonlocal pieces, linked
            text = " ".join(_html.unescape("".join(pieces)).split())
            if text:
                _, path, node = stack[-1]
                self.blocks.append((path, text, min(linked, len(text))))
                if not node[1] or node[1][-1] != "#":
                    node[1].append("#")
                self.places.append((node, len(node[1]) - 1))
            pieces, linked = [], 0

        def close(tags: set[str], scope: set[str]) -> None:
            if not any(opened[t] for t in tags):
                return
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in tags:
                    flush()
                    opened.subtract(t for t, _, _ in stack[k:])
                    del stack[k:]
                    return
                if stack[k][0] in scope:
                    return

        for token in _TOKEN.finditer(source):
            if token["text"] is not None:
                if not quiet:
                    pieces.append(token["text"])
                    if links:
                        linked += len(token["text"])
                continue
            if not token["tag"]:
                continue
            tag = token["tag"].lower()
            if tag not in _BLOCK:
                if tag in ("br", "wbr"):
                    pieces.append(" " if tag == "br" else "")
                elif tag == "a":
                    links = 0 if token["close"] else 1
                if tag in _VOID:
                    continue
                if token["close"]:
                    if quiet and quiet[-1] == tag:
                        quiet.pop()
                elif quiet or (_TELLING.search(token["attributes"]) and _signature(tag, token["attributes"])[1]):
                    if not token["attributes"].rstrip().endswith("/"):
                        quiet.append(tag)
                continue
            quiet.clear()
            if token["close"]:
                close({tag}, set())
                continue
            if tag in _SIBLING:
                close(_SIBLING[tag] & {tag} if tag == "li" else _SIBLING[tag], _SCOPE[tag])
            if tag in _ENDS_P:
                close({"p"}, _SCOPE["p"])
            flush()
            if tag in _VOID:
                continue
            signature, marked = _signature(tag, token["attributes"])
            if tag in ("form", "fieldset"):
                marked, forms = marked and forms not in containers, forms + 1
            _, path, node = stack[-1]
            if len(stack) <= MOST_DEPTH or (marked and not node[0].endswith("!")):
                node = [signature + "!" * marked, []]
                stack[-1][2][1].append(node)
                path = f"{path}/{node[0]}"
            opened[tag] += 1
            stack.append((tag, path, node))
        flush()

    def shape(self) -> list:
        return fold(self.tree)


def fold(node: list) -> list:
    """[signature, quantifier, children] of a tree, like neighbours folded into one repeated child."""
    children: list = []
    for child in node[1]:
        one = child if child == "#" else fold(child)
        if children and one != "#" and children[-1] != "#" and children[-1][0] == one[0]:
            children[-1] = align(children[-1], one)
            children[-1][1] = "+"
        elif one != "#" or not children or children[-1] != "#":
            children.append(one)
    return [node[0], "1", children]



def _both(a: str, b: str) -> str:
    """The quantifier that allows what either of two allows."""
    many, none = a in "+*" or b in "+*", a in "?*" or b in "?*"
    return {(False, False): "1", (True, False): "+", (False, True): "?", (True, True): "*"}[many, none]


def _optional(node):
    return node if node == "#" else [node[0], _both(node[1], "?"), node[2]]


def align(a: list, b: list) -> list:
    """The union-free expression of two with the same signature.

    Children are matched by the longest common subsequence of their signatures; matched ones are
    aligned in turn, a text slot matches a text slot, and what has no partner becomes optional."""
    x, y = a[2], b[2]
    if x == y:
        return [a[0], _both(a[1], b[1]), x]

    def key(c):
        return c if c == "#" else c[0]

    size = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            size[i][j] = 1 + size[i + 1][j + 1] if key(x[i]) == key(y[j]) else max(size[i + 1][j], size[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and key(x[i]) == key(y[j]):
            out.append("#" if x[i] == "#" else align(x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or (i < len(x) and size[i + 1][j] >= size[i][j + 1]):
            out.append(_optional(x[i]))
            i += 1
        else:
            out.append(_optional(y[j]))
            j += 1
    merged: list = []
    for child in out:  # neighbours that became alike are one repeated group
        if merged and child != "#" and merged[-1] != "#" and merged[-1][0] == child[0]:
            one = align(merged[-1], child)
            one[1] = "*" if merged[-1][1] in "?*" and child[1] in "?*" else "+"
            merged[-1] = one
        elif child != "#" or not merged or merged[-1] != "#":
            merged.append(child)
    return [a[0], _both(a[1], b[1]), merged]


def expression(node) -> str:
    """A wrapper as text: <tag>...</tag> with ( )?, ( )+ and ( )* groups and # for text slots."""
    if node == "#":
        return "#"
    inner = "".join(map(expression, node[2]))
    own = f"<{node[0]}>{inner}</{node[0]}>" if node[0] else inner
    return own if node[1] == "1" else f"({own}){node[1]}"


def _host() -> Column:
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://([^/?#:]*)", 1), F.lit("")))


def _root(path: str) -> str | None:
    """The path of the innermost main element on a path."""
    parts = path.split("/")
    for k in range(len(parts), 0, -1):
        if parts[k - 1].split(".")[0].rstrip("!") in _MAIN:
            return "/".join(parts[:k])
    return None


def _names(children: list) -> list[str]:
    """A step per child of an expression: its signature, numbered from the second of the same on."""
    seen: dict[str, int] = {}
    out = []
    for child in children:
        key = child if child == "#" else child[0]
        seen[key] = seen.get(key, 0) + 1
        out.append(key if seen[key] == 1 else f"{key}~{seen[key]}")
    return out


class Wrapper:
    """An expression that pages are matched against.  A slot is named by the steps to it, "#" at the end."""

    def __init__(self, shape: list):
        self.shape = shape
        self.known: dict[tuple[int, tuple], tuple] = {}

    def order(self) -> dict[str, int]:
        """The slots in the order of the expression."""
        out: dict[str, int] = {}

        def walk(node: list, at: str) -> None:
            for child, name in zip(node[2], _names(node[2]), strict=True):
                if child == "#":
                    out[f"{at}/{name}"] = len(out)
                else:
                    walk(child, f"{at}/{name}")

        walk(self.shape, "")
        return out

    def _fit(self, node: list, keys: tuple) -> tuple:
        """Per child of a page's element the step and the child of the expression that it matches: like
        neighbours match one group, and as much as possible is matched, what is not optional first."""
        if (id(node), keys) in self.known:
            return self.known[id(node), keys]
        y, names = node[2], _names(node[2])
        x = [k for n, k in enumerate(keys) if not n or keys[n - 1] != k]
        own = [c if c == "#" else c[0] for c in y]
        worth = [2 + (c != "#" and c[1] in "1+") for c in y]
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                most = max(best[i + 1][j], best[i][j + 1])
                best[i][j] = max(most, worth[j] + best[i + 1][j + 1]) if x[i] == own[j] else most
        runs: list = []
        i = j = 0
        while i < len(x):
            if j < len(y) and x[i] == own[j] and best[i][j] == worth[j] + best[i + 1][j + 1]:
                runs.append((names[j], y[j]))
                i, j = i + 1, j + 1
            elif j < len(y) and best[i][j + 1] == best[i][j]:
                j += 1
            else:  # no page that the expression was made from gets here
                runs.append((f"{x[i]}~0", None))
                i += 1
        out, at = [], -1
        for n, k in enumerate(keys):
            at += not n or keys[n - 1] != k
            out.append(runs[at])
        if len(self.known) > 10_000:
            self.known.clear()
        self.known[id(node), keys] = tuple(out)
        return self.known[id(node), keys]

    def slots(self, page: Page) -> list[str]:
        """The slot of each block of a page."""
        steps: dict[int, list[str]] = {}
        todo: list = [(page.tree, self.shape, "")]
        while todo:
            node, match, at = todo.pop()
            keys = tuple(c if c == "#" else c[0] for c in node[1])
            fit = self._fit(match, keys) if match is not None else [(f"{k}~0", None) for k in keys]
            steps[id(node)] = [f"{at}/{name}" for name, _ in fit]
            for child, (name, to) in zip(node[1], fit, strict=True):
                if child != "#":
                    todo.append((child, to, f"{at}/{name}"))
        return [steps[id(node)][k] for node, k in page.places]


def _layout(page: Page) -> str:
    """"main" for a page with text in a main element, or else the containers below the body that have text."""
    paths = {p for p, _, _ in page.blocks if "!" not in p}
    if any(_root(p) is not None for p in paths):
        return "main"
    return " ".join(sorted({re.sub(r"^((?:/html)?(?:/body[^/]*)?/[^/]*).*$", r"\1", p) for p in paths}))


#: A slot is furniture if so many different pages, and this share of all of its host, have the same text in it.
SAME_PAGES, SAME_SHARE = 5, 0.9


def roles(stats: list[tuple[str, str | None, int, int, int, int, int]], order: dict[str, int]) -> dict[str, list[str]]:
    """Per layout of a host the slots that hold the article, given (layout, slot, different pages,
    characters, characters in links, least and greatest digest of the text); slot null counts the pages.

    In a main element a slot of equal text is kept unless it also has a class and ends the article: a
    heading or a passage that copies share is text.  Pages without one have a region: the smallest element
    with most of the changing, unlinked text; layouts without text in it have one of their own, and so on."""

    def place(slot: str) -> str:
        return slot[: slot.rindex("/")]

    def plain(slot: str) -> str:
        return re.sub(r"~\d+", "", place(slot))

    total = {True: 0, False: 0}
    seen: dict[str, list] = {}
    texts: dict[str, dict[str, tuple[int, int]]] = {}
    for layout, slot, pages, chars, links, low, high in stats:
        if slot is None:
            total[layout == "main"] += pages
            texts.setdefault(layout, {})
        elif "!" not in slot:
            texts.setdefault(layout, {})[slot] = (chars, links)
            one = seen.setdefault(slot, [0, low, high])
            one[0], one[1], one[2] = one[0] + pages, min(one[1], low), max(one[2], high)
    everywhere = sum(total.values())
    same = {s: low == high and n >= SAME_PAGES for s, (n, low, high) in seen.items()}
    fixed = {s: same[s] and seen[s][0] >= SAME_SHARE * everywhere for s in seen}
    out: dict[str, list[str]] = {layout: [] for layout in texts}

    if "main" in texts:
        inside = [s for s in texts["main"] if _root(plain(s)) is not None]
        changing = [order.get(s, -1) for s in inside if not same[s]]
        last = max(changing, default=None)
        ends = {s for s in inside if last is not None and same[s] and seen[s][0] >= SAME_SHARE * total[True] and order.get(s, -1) > last and "." in place(s).rsplit("/", 1)[-1]}
        out["main"] = [s for s in inside if s not in ends]
    left = set(texts) - {"main"}
    while left:
        sums: dict[str, list[int]] = {}
        for layout in left:
            for s, (chars, links) in texts[layout].items():
                one = sums.setdefault(s, [0, 0])
                one[0], one[1] = one[0] + chars, one[1] + links
        weight = {s: 0 if fixed[s] else max(0, c - 2 * n) for s, (c, n) in sums.items()}
        whole, region = sum(weight.values()), ""
        while whole:
            steps: dict[str, int] = {}
            for s, w in weight.items():
                if place(s).startswith(region + "/"):
                    step = region + "/" + s[len(region) + 1 :].split("/")[0]
                    steps[step] = steps.get(step, 0) + w
            best = max(steps, key=lambda s: (steps[s], s), default=None)
            if best is None or steps[best] < 0.8 * whole or not any(place(s).startswith(best + "/") for s in weight):
                break
            region = best
        inside = [s for s, (c, n) in sums.items() if place(s).startswith(region + "/") and (weight[s] > 0 or c > 2 * n)]
        changing = any(not same[s] for s in inside)
        inside = {s for s in inside if not (changing and fixed[s])}
        reached = {layout for layout in left if not inside.isdisjoint(texts[layout])}
        for layout in reached:
            out[layout] = sorted(inside & set(texts[layout]))
        if not reached:
            break
        left -= reached
    return out


_ARROW = {"long": pa.int64(), "string": pa.string()}
_SLOTS = "host string, layout string, content long, slot string, chars long, links long, mark long"


def _mark(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _shapes(pages: DataFrame) -> DataFrame:
    """The host and the folded shape of each page."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = [json.dumps(Page(source or "").shape(), ensure_ascii=False, separators=(",", ":")) for source in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shapes, pa.string())], ["host", "shape"])

    return pages.select(_host().alias("host"), "html").mapInArrow(seen, "host string, shape string").distinct()


def _meet(pages: DataFrame, known: DataFrame, value: str, broadcast_bytes: int, salts: int):
    """The rows of pages (with __host) and the function that gives a batch's hosts and their `value`.

    Values go to every task if they are few; if not, they join by host and salt, each there once per salt,
    so a large host spreads over the tasks."""
    columns = pages.columns
    at = columns.index("__host")
    total = known.agg(F.sum(F.octet_length(value) + F.octet_length("host"))).first()[0] or 0
    if total <= broadcast_bytes:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: r[value] for r in known.select("host", value).collect()})
        return pages, lambda batch: [(h, shared.value.get(h)) for h in batch.column(at).to_pylist()]
    salt = F.coalesce(F.pmod(F.xxhash64("html"), F.lit(salts)).cast("int"), F.lit(0))
    each = known.select(F.col("host").alias("__host"), F.col(value).alias("__value"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    rows = pages.withColumn("__salt", salt).join(each, ["__host", "__salt"], "left").select(*columns, "__value")
    return rows, lambda batch: list(zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True))


def _observe(pages: DataFrame, wrapper: DataFrame, broadcast_bytes: int, salts: int) -> DataFrame:
    """Per page and slot of its host's expression the text's statistics, and a row without slot per page."""
    rows, hosts = _meet(pages.select("html", _host().alias("__host")), wrapper, "shape", broadcast_bytes, salts)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers: dict[str, Wrapper] = {}
        names = [c.split()[0] for c in _SLOTS.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for (host, shape), source in zip(hosts(batch), batch.column(0).to_pylist(), strict=True):
                if host not in wrappers:
                    if len(wrappers) > 1_000:
                        wrappers.clear()
                    wrappers[host] = Wrapper(json.loads(shape))
                page = Page(source or "")
                layout, slots = _layout(page), {}
                for slot, (_, text, linked) in zip(wrappers[host].slots(page), page.blocks, strict=True):
                    one = slots.setdefault(slot, [0, 0, []])
                    one[0], one[1] = one[0] + len(text), one[1] + linked
                    one[2].append(text)
                content = _mark(json.dumps([(slot, one[2]) for slot, one in slots.items()]))
                out.append((host, layout, content, None, 0, 0, None))
                out += [(host, layout, content, slot, chars, linked, _mark("\n".join(texts))) for slot, (chars, linked, texts) in slots.items()]
            yield pa.RecordBatch.from_pydict(
                dict(zip(names, map(list, zip(*out, strict=True)), strict=True)) if out else {n: [] for n in names},
                schema=pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in _SLOTS.split(", ")]),
            )

    return rows.mapInArrow(seen, _SLOTS)


def _aligned(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """Align the shapes of each key; rows stream, one wrapper is held at a time."""
    at = len(keys)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, wrapper = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"host": [now[0]], "shape": [json.dumps(wrapper, ensure_ascii=False, separators=(",", ":"))]})

        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, shape = values[:at], json.loads(values[at])
                if key != now:
                    if now is not None:
                        yield row()
                    now, wrapper = key, shape
                else:
                    wrapper = align(wrapper, shape)
        if now is not None:
            yield row()

    return shapes.select(*keys, "shape").repartition(*keys).sortWithinPartitions(*keys, "shape").mapInArrow(merged, "host string, shape string")


#: Shapes of a host that one task aligns, about.
BUCKET_SHAPES = 256


def _folded(shapes: DataFrame) -> DataFrame:
    """One wrapper per host: its shapes are aligned in buckets, the buckets' wrappers in buckets again, and so on."""
    while True:
        buckets = shapes.groupBy("host").agg(F.ceil(F.count("*") / BUCKET_SHAPES).alias("buckets"))
        most = buckets.agg(F.max("buckets")).first()[0] or 1
        dealt = shapes.join(buckets, "host").withColumn("bucket", F.pmod(F.xxhash64("shape"), "buckets"))
        shapes = materialize(_aligned(dealt, ["host", "bucket"]).distinct(), "page-wrappers")
        if most == 1:
            return shapes


#: Wrappers of this many bytes in all are handed to every task; more are joined by host.
BROADCAST_BYTES = 16 << 20


def infer(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, salts: int = 16) -> DataFrame:
    """Per host of pages (url, html): `wrapper` (the expression), `shape` (the same as JSON), `slots` (layout
    -> slots that hold the article) and `rule` (JSON of both).

    Equal shapes of a host count once, and so do pages of equal texts.  Shapes are aligned in a tree of buckets, so that
    no task aligns more than about BUCKET_SHAPES of a host.  A null url belongs to the host ""."""
    bound_batches(pages.sparkSession, rows=2_000)
    wrapper = _folded(materialize(_shapes(pages), "page-shapes"))
    stats = (
        _observe(pages, wrapper, broadcast_bytes, salts)
        .groupBy("host", "layout", "content", "slot")
        .agg(F.max("chars").alias("chars"), F.max("links").alias("links"), F.max("mark").alias("mark"))
        .groupBy("host", "layout", "slot")
        .agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.min("mark").alias("low"), F.max("mark").alias("high"))
        .groupBy("host")
        .agg(F.sort_array(F.collect_list(F.struct("layout", "slot", "pages", "chars", "links", "low", "high"))).alias("stats"))
    )

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, shapes_, lists = (c.to_pylist() for c in batch.columns)
            parsed = [json.loads(s) for s in shapes_]
            found = [roles([tuple(s.values()) for s in x or []], Wrapper(shape).order()) for x, shape in zip(lists, parsed, strict=True)]
            yield pa.RecordBatch.from_pydict({
                "host": hosts,
                "wrapper": [expression(x) for x in parsed],
                "shape": shapes_,
                "slots": [json.dumps(f, ensure_ascii=False) for f in found],
                "rule": [json.dumps([x, f], ensure_ascii=False) for x, f in zip(parsed, found, strict=True)],
            })

    joined = wrapper.join(stats, "host", "left").select("host", "shape", "stats")
    return materialize(joined.mapInArrow(decided, "host string, wrapper string, shape string, slots string, rule string"), "wrappers")


def text_of(source: str, wrapper: Wrapper, slots: dict[str, set[str]]) -> str:
    """The article of a page, block by block, given its host's wrapper and the slots of each layout."""
    page = Page(source)
    kept = slots.get(_layout(page), ())
    return "\n".join(text for slot, (_, text, _) in zip(wrapper.slots(page), page.blocks, strict=True) if slot in kept) if kept else ""


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, salts: int = 16) -> DataFrame:
    """pages (page_id, url, html, ...) with `text`, the main text (empty for a null html or a page
    without an article), and `n_chars`, its code points, in place of columns of these names.

    A null url belongs to the host "".  Repeated rows get the same text and count once in what is inferred; an
    empty table gives none.  Pages are read whole in one pass, however long or deep they are."""
    known = infer(pages, broadcast_bytes, salts)
    bound_batches(pages.sparkSession, rows=2_000)
    columns = [c for c in pages.columns if c not in ("text", "n_chars")]
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "text string"])
    at = columns.index("html")
    rows, hosts = _meet(pages.select(*columns, _host().alias("__host")), known, "rule", broadcast_bytes, salts)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, tuple[Wrapper, dict[str, set[str]]]] = {}
        for batch in batches:
            texts = []
            for (host, rule), source in zip(hosts(batch), batch.column(at).to_pylist(), strict=True):
                if host not in parsed:
                    if len(parsed) > 1_000:
                        parsed.clear()
                    shape, slots = json.loads(rule)
                    parsed[host] = Wrapper(shape), {layout: set(x) for layout, x in slots.items()}
                texts.append(text_of(source, *parsed[host]) if source else "")
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(texts, pa.string())], [*columns, "text"])

    return rows.mapInArrow(read, schema).withColumn("n_chars", F.length("text").cast("long"))

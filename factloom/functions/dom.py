"""The one place where markup structure is read in Python: a page becomes a flat node array.

Nodes are in document order and carry their parent and the position behind their subtree, so Spark
expressions can select and read subtrees by slicing. The Markdown writer works on the same nodes.

Pages are read one by one and travel in small lots of rows. An Arrow batch holds up to 64 MB of them, several times that as strings, nodes and
results, in every task of an executor at once.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import udf

from factloom.functions import let

NODE_TYPE = T.ArrayType(T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("parent", T.IntegerType()),
    T.StructField("stop", T.IntegerType()), T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("text", T.StringType()),
]))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
                   "main nav ol p pre section table ul".split())
# An opening tag on the left ends an open element on the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select body html article section div".split())


class _Flattener(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open = [], []
        # Open elements by name, so that no tag looks for one in vain through a deep stack.
        self.names = Counter()

    def _add(self, tag, attrs, text):
        parent = self.open[-1] if self.open else -1
        self.nodes.append([len(self.nodes), parent, len(self.nodes) + 1, tag, attrs, text])

    def _close(self, depth):
        while len(self.open) > depth:
            node = self.nodes[self.open.pop()]
            node[2] = len(self.nodes)
            self.names[node[3]] -= 1

    def handle_starttag(self, tag, attrs):
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        for depth in range(len(self.open) - 1, -1, -1) if any(self.names[e] for e in ends) else ():
            name = self.nodes[self.open[depth]][3]
            if name in ends:
                self._close(depth)
            elif name in SCOPES and not (tag in ("td", "th", "tr") and name not in ("table",)):
                break
        self._add(tag, {k: v or "" for k, v in attrs}, None)
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)
            self.names[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self._add(tag, {k: v or "" for k, v in attrs}, None)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1) if self.names[tag] else ():
            if self.nodes[self.open[depth]][3] == tag:
                self._close(depth)
                return

    def handle_data(self, data):
        self._add("#text", None, data)


def flatten(html: str) -> list[list]:
    """Nodes [id, parent, stop, tag, attrs, text] of a page or fragment."""
    parser = _Flattener()
    parser.feed(html)
    parser.close()
    parser._close(0)
    return parser.nodes


@udf(NODE_TYPE, useArrow=False)
def dom_nodes(page: str) -> list | None:
    return None if page is None else [tuple(n) for n in flatten(page)]


SILENT = frozenset("script style noscript template iframe head title".split())
CHROME = frozenset("nav header footer aside form button".split())
CONTROLS = frozenset("dialog form button input select textarea".split())
MARKED = frozenset("h1 h2 h3 h4 h5 h6 a em i strong b ul ol li blockquote".split())
OVERLAY = re.compile(r"(?:^|[\s_-])(?:modal|popup|pop-up)(?:$|[\s_-])", re.I)
# The writer reads so many levels one inside the other; below, blocks and plain elements are written one after the other, and from the second level on all are.
NESTED, FLAT = 200, 300
ICON = re.compile(r"(?:check|close|cross|icon)(?:[._/-]|$)", re.I)


def _noise(node) -> bool:
    tag, attrs = node[3], node[4] or {}
    return (tag in CONTROLS or attrs.get("role") == "dialog" or attrs.get("aria-modal") == "true"
            or bool(OVERLAY.search(f"{attrs.get('class', '')} {attrs.get('id', '')}")))


def _escape(text: str) -> str:
    # The backslash first; plain replacements are several times as quick as a pattern.
    for mark in "\\`*_[]":
        text = text.replace(mark, "\\" + mark)
    return text


def _blanks(text: str) -> str:
    """White space runs as one blank, at the ends too."""
    words = " ".join(text.split())
    if not words:
        return " " if text else ""
    return (" " if text[0].isspace() else "") + words + (" " if text[-1].isspace() else "")


def _image(attrs, base) -> str:
    src, alt = attrs.get("src", ""), attrs.get("alt", "").strip()
    if src[:5].lower() == "data:":
        return alt
    if not src or (not alt and ICON.search(src)):
        return ""
    return f"![{_escape(alt)}]({urljoin(base, src)})"


def to_markdown(nodes, start, stop, base, drop=lambda node: False, depth=0, ordered=None, level=0) -> str:
    """Markdown of the nodes from start to stop; `drop` removes subtrees. No page can exhaust the stack, and no text is lost for that."""
    out, i, number, ends = [], start, 0, []
    while i < stop:
        while ends and ends[-1][0] <= i:
            out.append(ends.pop()[1])
        node = nodes[i]
        tag, attrs, after = node[3], node[4] or {}, node[2]
        inner = lambda **kw: to_markdown(nodes, i + 1, after, base, drop, **{"depth": depth, "level": level + 1, **kw})
        if tag == "#text":
            text = _blanks(node[5])
            out.append(text if ordered == "pre" else _escape(text))
        elif tag in SILENT or drop(node):
            pass
        elif after > i + 1 and tag not in ("pre", "code") and (level >= FLAT or level >= NESTED and tag not in MARKED):
            mark = "\n\n" if tag in BLOCKS or tag in ("li", "tr", "dt", "dd", "figcaption", "body", "html", "tbody", "thead") else " " if tag in ("td", "th") else ""
            out.append(mark)
            ends.append((after, mark))
            after = i + 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            text = inner().strip()
            out.append(f"\n\n{'#' * int(tag[1])} {text}\n\n" if text else "")
        elif tag == "a":
            text, href = inner().strip(), attrs.get("href", "")
            out.append(f"[{text}]({urljoin(base, href)})" if text and href and len(href) <= 512 else text)
        elif tag == "img":
            out.append(_image(attrs, base))
        elif tag in ("em", "i", "strong", "b"):
            text, mark = inner().strip(), "_" if tag in ("em", "i") else "**"
            out.append(f"{mark}{text}{mark}" if text else "")
        elif tag == "code" and ordered != "pre":
            out.append("`" + "".join(n[5] for n in nodes[i:after] if n[5]) + "`")
        elif tag == "pre":
            out.append("\n\n```\n" + "".join(n[5] for n in nodes[i:after] if n[5]).strip("\n") + "\n```\n\n")
        elif tag == "br":
            out.append("  \n")
        elif tag == "hr":
            out.append("\n\n* * *\n\n")
        elif tag in ("ul", "ol"):
            body = inner(ordered=tag, depth=depth + 1).strip("\n")
            out.append(f"\n{body}\n" if depth else f"\n\n{body}\n\n")
        elif tag == "li":
            number += 1
            mark = f"{number}. " if ordered == "ol" else "- "
            body = re.sub(r"\n+", "\n", inner().strip()).replace("\n", "\n    ")
            out.append(f"\n{mark}{body}" if body else "")
        elif tag == "blockquote":
            body = _tidy(inner())
            out.append("\n\n" + "\n".join("> " + line for line in body.split("\n")) + "\n\n" if body else "")
        elif tag in BLOCKS or tag in ("tr", "dt", "dd", "figcaption", "body", "html", "tbody", "thead"):
            out.append("\n\n" + inner().strip("\n ") + "\n\n")
        else:
            out.append(inner(ordered=ordered) if tag in ("span", "font") else inner() + (" " if tag in ("td", "th") else ""))
        i = after
    return "".join(out + [mark for _, mark in reversed(ends)])


def _tidy(markdown: str) -> str:
    # Most texts hold neither; looking for them is much quicker than the patterns.
    if " \n" in markdown or "\t\n" in markdown:
        markdown = re.sub(r"[ \t]+\n", "\n", markdown)
    return (re.sub(r"\n{3,}", "\n\n", markdown) if "\n\n\n" in markdown else markdown).strip()


@udf(T.StringType(), useArrow=False)
def fragment_markdown(fragment: str, base: str) -> str | None:
    """Markdown of a markup fragment; links are made absolute."""
    if fragment is None:
        return None
    nodes = flatten(fragment)
    return _tidy(to_markdown(nodes, 0, len(nodes), base or ""))


def _text(nodes, node) -> str:
    return " ".join(" ".join(n[5] for n in nodes[node[0]:node[2]] if n[5]).split())


def _best_block(nodes, banned):
    """Element whose paragraphs hold the most prose (length and commas), its links discounted."""
    scores: dict[int, float] = {}
    for node in nodes:
        if node[3] not in ("p", "pre", "td", "blockquote") or node[0] in banned:
            continue
        text = _text(nodes, node)
        if len(text) < 25:
            continue
        points = 1 + text.count(",") + min(len(text) // 100, 3)
        up, share = node[1], 1.0
        for _ in range(2):
            if up < 0:
                break
            scores[up] = scores.get(up, 0) + points * share
            up, share = nodes[up][1], 0.5
    best, top = None, 0.0
    for i, score in scores.items():
        size = len(_text(nodes, nodes[i])) or 1
        linked = sum(len(_text(nodes, n)) for n in nodes[i:nodes[i][2]] if n[3] == "a")
        if score * (1 - linked / size) > top:
            best, top = nodes[i], score * (1 - linked / size)
    return best


def _focus_root(nodes, focus):
    norm = lambda v: " ".join(re.sub(r"[^a-z0-9]+", " ", v.lower()).split())
    terms = [t for t in norm(focus).split() if len(t) >= 3]
    hit = lambda v: any(t in norm(v) for t in terms)
    for n in nodes:
        if n[4] and n[4].get("id", "__next") != "__next" and hit(n[4]["id"]):
            return n
    for n in nodes:
        if n[3] in ("h1", "h2", "h3", "h4", "h5", "h6") and hit(_text(nodes, n)):
            up = n[1]
            while up >= 0:
                if nodes[up][3] in ("section", "article", "main") or (nodes[up][4] or {}).get("id", "__next") != "__next":
                    return nodes[up]
                up = nodes[up][1]
            return nodes[n[1]] if n[1] >= 0 else n
    return None


def _banned(nodes, drop):
    out, i = set(), 0
    while i < len(nodes):
        if drop(nodes[i]):
            out.update(range(i, nodes[i][2]))
            i = nodes[i][2]
        else:
            i += 1
    return out


IMAGE_TYPE = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("src", "alt", "width", "height")],
    T.StructField("in_main", T.BooleanType()),
])
PAGE_TYPE = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("readable", "fallback", "focused")],
    T.StructField("links", T.IntegerType()), T.StructField("primary_text", T.StringType()),
    T.StructField("images", T.ArrayType(IMAGE_TYPE)),
])


def _read_page(html, base, focus):
    nodes = flatten(html)
    is_main = lambda n: n[3] in ("article", "main") or (n[4] or {}).get("role") == "main"
    hidden = lambda n: n[3] in SILENT or _noise(n)
    chrome = lambda n: hidden(n) or n[3] in CHROME
    banned = _banned(nodes, hidden)
    render = lambda n, drop: _tidy(to_markdown(nodes, n[0] + 1, n[2], base, drop)) if n else ""
    best = _best_block(nodes, banned | _banned(nodes, chrome))
    section = _focus_root(nodes, focus) if focus else None
    first = lambda test: next((n for n in nodes if test(n) and n[0] not in banned), None)
    primary = next((n for n in nodes if is_main(n)), None)
    inside = set()
    for n in nodes:
        if is_main(n):
            inside.update(range(n[0], n[2]))
    skipped = _banned(nodes, lambda n: n[3] in CHROME or n[3] in SILENT)
    words = "".join(n[5] for n in nodes[primary[0]:primary[2]] if n[5] and n[0] not in skipped) if primary else None
    images = [{"src": a.get("src") or a.get("data-src") or a.get("data-lazy-src"), "alt": a.get("alt"),
               "width": a.get("width"), "height": a.get("height"), "in_main": n[0] in inside}
              for n in nodes if n[3] == "img" for a in (n[4],)]
    return {
        "readable": render(best, chrome),
        "fallback": render(first(lambda n: is_main(n) or n[3] == "body"), chrome),
        "focused": render(section, lambda n: chrome(n) or n[3] == "svg"),
        "links": sum(1 for n in nodes if n[3] == "a" and n[4] and "href" in n[4]),
        "primary_text": words,
        "images": images[:150],
    }


@udf(PAGE_TYPE, useArrow=False)
def read_page(page: str, url: str, focus: str) -> dict:
    """Content candidates, link count and images of a page, from one parse."""
    return dict.fromkeys(PAGE_TYPE.names) if page is None else _read_page(page, url or "", focus)


def _walk(value, depth, limit, out):
    if depth > limit or len(out) >= 100:
        return
    if isinstance(value, dict):
        out.append(value)
        value = list(value.values())
    if isinstance(value, list):
        for item in value:
            _walk(item, depth + 1, limit, out)


def _flat_json(blocks, limit):
    out: list = []
    for block in blocks:
        try:
            _walk(json.loads(block), 0, limit, out)
        except ValueError:
            continue
    return [json.dumps(o, ensure_ascii=False) for o in out]


@udf(T.ArrayType(T.StringType()), useArrow=False)
def json_objects(blocks: list) -> list | None:
    """Every object in JSON blocks, outer before inner, at most 100 and 8 levels deep; broken blocks are skipped."""
    return None if blocks is None else _flat_json(blocks, 8)


@udf(T.ArrayType(T.StringType()), useArrow=False)
def shallow_json_objects(blocks: list) -> list | None:
    """The same down to 6 levels, as used for products."""
    return None if blocks is None else _flat_json(blocks, 6)


def subtree(nodes: Column, node: Column) -> Column:
    """Nodes below a node."""
    return let(node, lambda n: F.slice(nodes, n["id"] + 2, n["stop"] - n["id"] - 1))


def node_text(nodes: Column, node: Column) -> Column:
    """Collapsed text content of a node."""
    from factloom.functions.text import collapse

    texts = F.transform(F.filter(subtree(nodes, node), lambda n: n["tag"] == "#text"), lambda n: n["text"])
    return collapse(F.array_join(texts, ""))


def attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def has_class(node: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(F.split(attr(node, "class"), r"\s+"), name), F.lit(False))

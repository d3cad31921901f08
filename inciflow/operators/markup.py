"""The two steps that need a parser: JSON paths and the HTML tree.

Both are map-only passes over Arrow batches.  They only unfold structure; every
rule after that is a DataFrame expression.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from .ranking import first_per_key

# ------------------------------------------------------------------ JSON
PATH_SCHEMA = (
    "page_id bigint, block_ord int, block string, ord int, key string, path string, parent string, ancestors array<string>, "
    "scalar boolean, items array<string>, inner_name string"
)
_NAME_FIELDS = ("name", "ingredient", "inci", "value", "label")
_VALUE_FIELDS = ("value", "text", "name", "ingredients", "inci")


def _scalar(v) -> str | None:
    if isinstance(v, bool) or v is None:
        return None
    return v if isinstance(v, str) else json.dumps(v) if isinstance(v, (int, float)) else None


def _items(v) -> list[str]:
    """Texts a JSON value stands for: itself, list entries, or a named field."""
    while isinstance(v, dict):
        v = next((v[f] for f in _VALUE_FIELDS if v.get(f)), None)
    if not isinstance(v, list):
        one = _scalar(v)
        return [one] if one else []
    out = []
    for entry in v:
        if isinstance(entry, dict):
            entry = next((entry[f] for f in _NAME_FIELDS if entry.get(f)), None)
            entry = _scalar(entry)
        if isinstance(entry, str) and entry:
            out.append(entry)
    return out


def _document_rows(doc):
    """(number, path parts, value) of every object key in document order."""
    todo, n = [([], False, doc)], 0
    while todo:
        path, keyed, value = todo.pop()
        if keyed:
            yield n, path, value
            n += 1
        if isinstance(value, dict):
            todo.extend((path + [k], True, v) for k, v in reversed(list(value.items())))
        elif isinstance(value, list):
            todo.extend((path + [str(i)], False, v) for i, v in reversed(list(enumerate(value))))


#: Parts of an object literal that JSON writes otherwise: strings, bare keys, `undefined`, commas before an end.
_LITERAL = re.compile(r"""("(?:[^"\\]|\\.)*")|'((?:[^'\\]|\\.)*)'|([A-Za-z_$][\w$]*)(?=\s*:)|\b(undefined)\b|,(?=\s*[}\]])""", re.S)


def _as_json(found: re.Match) -> str:
    double, single, key, missing = found.groups()
    if double is not None:
        return double
    if single is not None:
        return json.dumps(re.sub(r"\\(['\"])", r"\1", single))
    return json.dumps(key) if key is not None else "null" if missing else ""


def _parsed(body: str):
    """The value of JSON, else of an object literal of plain values; ValueError for all else. Nothing is evaluated."""
    try:
        return json.loads(body)
    except ValueError:
        return json.loads(_LITERAL.sub(_as_json, body), strict=False)


#: Rows that become Python objects at a time, and rows or characters of one batch that goes back.
IN_ROWS, OUT_ROWS, OUT_CHARS = 64, 1024, 1 << 22


def _sent_back(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size, so that a worker never holds what thousands of pages unfold to."""
    held, chars = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        chars += size(row)
        if len(held) >= OUT_ROWS or chars >= OUT_CHARS:
            yield batch()
            held, chars = [], 0
    if held:
        yield batch()


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches, a few at a time as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, IN_ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, IN_ROWS).columns))


_TEXT, _TEXTS = pa.string(), pa.list_(pa.string())
_PATH_ARROW = pa.schema(
    [("page_id", pa.int64()), ("block_ord", pa.int32()), ("block", _TEXT), ("ord", pa.int32()), ("key", _TEXT), ("path", _TEXT), ("parent", _TEXT), ("ancestors", _TEXTS),
     ("scalar", pa.bool_()), ("items", _TEXTS), ("inner_name", _TEXT)]
)


def _json_rows(blocks: Iterator[tuple]) -> Iterator[tuple]:
    for page, block_ord, block, body in blocks:
        try:
            doc = _parsed(body)
        except ValueError:
            continue
        for n, names, value in _document_rows(doc):
            inner = value.get("name") if isinstance(value, dict) else None
            ups = [".".join(names[:i]) for i in range(len(names))]
            scalar = _scalar(value) is not None
            yield page, block_ord, block, n, names[-1], ".".join(names), ups[-1], ups, scalar, _items(value), _scalar(inner)


def _json_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _sent_back(_json_rows(_few(batches)), _PATH_ARROW, lambda row: sum(map(len, row[7])) + sum(map(len, row[9])))


def json_paths(blocks: DataFrame) -> DataFrame:
    """Every key of every JSON block with its path (page_id, block_ord, block, body in)."""
    return blocks.select("page_id", "block_ord", "block", "body").mapInArrow(_json_batches, PATH_SCHEMA)


# ------------------------------------------------------------------ HTML
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_DROPPED = {"script", "style", "noscript", "svg", "nav", "footer"}
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_BLOCKS = {"div", "section", "article", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "dl", "details", "form"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "strong", "b", "summary", "button", "dt", "th", "label"}
_REGION_CLASSES = {"accordion-item", "accordion__item", "product-accordion", "tab-pane"}


class _Node:
    __slots__ = ("tag", "attrs", "parent", "kids")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(k for k in reversed(n.kids) if isinstance(k, _Node))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def _close(self, tags, limit):
        n = self.at
        while n.parent is not None and n.tag not in limit:
            if n.tag in tags:
                self.at = n.parent
                return
            n = n.parent

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES:
            self._close(_CLOSES[tag], {"ul", "ol", "table", "dl", "div", "section"} if tag != "p" else {"div", "section", "li", "td"})
        elif tag in _BLOCKS:
            self._close({"p"}, {"div", "section", "li", "td", "button"})
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None:
            if n.tag == tag:
                self.at = n.parent
                return
            n = n.parent

    def handle_data(self, data):
        self.at.kids.append(data)


_SP = re.compile(r"\s+")
_SEP = re.compile(r"\s*([,;|•·])\s*")


def _clean(s: str) -> str:
    return _SP.sub(" ", _SEP.sub(r"\1 ", s.replace(" ", " "))).strip()


def _raw(node, skip=frozenset(), marks=False, omit=None) -> str:
    """Text below a node; with marks, list items and breaks end in separators."""
    out = []
    stack = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        if n is omit or n.tag in skip:
            continue
        if marks and n.tag == "br":
            out.append(", ")
        if marks and n is not node:
            tail = {"li": ", ", "p": " ", "dd": " ", "tr": " "}.get(n.tag)
            if tail:
                stack.append(tail)
        stack.extend(reversed(n.kids))
    return "".join(out)


_NO_TEXT = frozenset({"script", "style", "noscript", "svg", "button"})


def _marked(node, omit=None) -> str:
    x = _clean(_raw(node, _NO_TEXT, True, omit))
    return re.sub(r",\s*$", "", re.sub(r"(?:,\s*){2,}", ", ", x))


_HEAD, _PART, _STOP = (re.compile(p, re.I) for p in (K.HEADING_PATTERN, K.PARTIAL_PATTERN, K.STOP_PATTERN))
_ATTR = re.compile(r"(?:^|[-_:])(ingredients?|inci|composition)(?:$|[-_:])", re.I)
_COLUMN = re.compile(r"\bingredients?\b|\binci\b", re.I)


def _is_region(n) -> bool:
    return n.tag in ("section", "article", "div") or n.attrs.get("role") == "tabpanel" or bool(_REGION_CLASSES & set(n.attrs.get("class", "").split()))


def _heading_texts(tree, by_id, head, stop):
    for n in tree.walk():
        if n.tag not in _HEADINGS and n.attrs.get("role") not in ("tab", "button"):
            continue
        label = _clean(_raw(n))
        if not label or len(label) > 100 or not head.search(label) or _PART.search(label):
            continue
        href, target = n.attrs.get("href", ""), n.attrs.get("data-target", "")
        for ref in (n.attrs.get("aria-controls", ""), href[1:] if href.startswith("#") else "", target[1:] if target.startswith("#") else target):
            if ref in by_id:
                yield label, _marked(by_id[ref])
        siblings = [k for k in n.parent.kids if isinstance(k, _Node)]
        for s in siblings[siblings.index(n) + 1 :][:6]:
            text = _marked(s)
            if re.fullmatch(r"h[1-6]", s.tag) or (len(text) < 90 and stop.search(text)):
                break
            yield label, text
        up = n
        while up is not None and up.tag != "details":
            up = up.parent
        if up is not None:
            summary = next((k for k in up.walk() if k.tag == "summary"), None)
            yield label, _marked(up, summary)
        up = n
        while up is not None and not _is_region(up):
            up = up.parent
        if up is not None:
            first = next((k for k in up.walk() if k is not up and k.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "summary", "button")), None)
            yield label, _marked(up, first)


def _container(n) -> bool:
    a = n.attrs
    if any(x in a for x in ("data-ingredients", "data-inci", "data-composition", "data-full-ingredients")):
        return True
    if a.get("itemprop") in ("ingredients", "ingredient"):
        return True
    return any(w in a.get(x, "").lower() for x in ("class", "id") for w in ("ingredient", "inci", "composition"))


def _tables(tree):
    for t in tree.walk():
        if t.tag != "table":
            continue
        rows = [[c for c in r.walk() if c.tag in ("td", "th")] for r in t.walk() if r.tag == "tr"]
        column = next((i for i, c in enumerate(rows[0]) if _COLUMN.search(_clean(_raw(c)))), -1) if rows else -1
        if column < 0:
            continue
        names = [_clean(_raw(r[column])) for r in rows[1:] if len(r) > column]
        names = [x for x in names if x and not _HEAD.search(x)]
        if len(names) >= 3:
            yield "ingredient-table", ", ".join(names)


def _prune(node):
    for n in list(node.walk()):
        for k in n.kids:
            if isinstance(k, _Node) and k.tag in _DROPPED:
                _loosen(k)
        n.kids = [k for k in n.kids if isinstance(k, str) or k.tag not in _DROPPED]


def _loosen(node):
    """Without the ways up nothing refers in circles, so a tree goes as soon as its page is done."""
    for n in node.walk():
        n.parent = None


def dom_values(html: str, head=_HEAD, stop=_STOP):
    """(method, label, text) of every place a page may keep its list."""
    parser = _Tree()
    parser.feed(html)
    tree = parser.root
    _prune(tree)
    by_id = {}
    for n in tree.walk():
        if n.attrs.get("id"):
            by_id.setdefault(n.attrs["id"], n)
    for label, text in _heading_texts(tree, by_id, head, stop):
        yield "dom-heading", label, text
    for n in tree.walk():
        if n.attrs and _container(n):
            label = _clean(" ".join(n.attrs[x] for x in ("id", "class", "itemprop", "aria-label", "data-title") if n.attrs.get(x)))
            if not _PART.search(label):
                yield "dom-container", label or "ingredient-container", n.attrs.get("content") or _marked(n)
    for n in tree.walk():
        for name, value in n.attrs.items():
            if _ATTR.search(name):
                yield "dom-dataset", name, _clean(value)
    for n in tree.walk():
        if n.tag == "meta":
            label = _clean(" ".join(n.attrs.get(x, "") for x in ("name", "property", "itemprop")))
            if _HEAD.search(label) and not _PART.search(label):
                yield "dom-meta", label, _clean(n.attrs.get("content", ""))
    for label, text in _tables(tree):
        yield "dom-table", label, text
    _loosen(tree)


DOM_SCHEMA = "page_id bigint, ord int, method string, label string, value string"
_DOM_ARROW = pa.schema([("page_id", pa.int64()), ("ord", pa.int32()), ("method", _TEXT), ("label", _TEXT), ("value", _TEXT)])


def dom_candidates(pages: DataFrame, heading: str = K.HEADING_PATTERN, stop: str = K.STOP_PATTERN) -> DataFrame:
    """Candidate texts of the HTML tree, trimmed, tested and deduplicated in order.

    The heading and stop patterns are parameters.
    """

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, end = re.compile(heading, re.I), re.compile(stop, re.I)
        rows = ((page, i, *hit) for page, html in _few(frames) for i, hit in enumerate(dom_values(html, head, end)))
        return _sent_back(rows, _DOM_ARROW, lambda row: len(row[4]))

    from .pages import plausible_dom, plausible_dom_text

    # each step is a generated column: a filter on a computed one would repeat its patterns for every use
    def once(df: DataFrame, **columns) -> DataFrame:
        made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
        return df.withColumn("_made", made).select(*df.columns, *[f"_made.{n}" for n in columns])

    found = once(pages.select("page_id", "html").mapInArrow(batches, DOM_SCHEMA), _text=T.dom_text(F.col("value")))
    found = once(found.where(plausible_dom_text(F.col("_text"))), raw_text=T.dom_trimmed(F.col("_text")))
    found = once(found.where(plausible_dom(F.col("raw_text"))), _key=T.dom_key(F.col("raw_text"))).where("_key <> ''")
    return first_per_key(found, ["page_id", "_key"], [F.col("ord")]).select("page_id", "ord", "method", "label", "raw_text")

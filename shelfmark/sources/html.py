"""Fields of HTML pages by selectors: a small tree, selectors, pruning, and the scan of a directory."""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from fnmatch import translate
from functools import lru_cache, reduce
from html.parser import HTMLParser
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.errors import BuildError

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = "script, style, noscript, template"


@dataclass(eq=False)
class Element:
    tag: str
    attrs: dict[str, str]
    parent: "Element | None" = None
    items: list = field(default_factory=list)  # elements and texts

    def walk(self) -> Iterator["Element"]:
        """All elements below, in the order of the page; pages may be nested to any depth."""
        open_ = [iter(self.items)]
        while open_:
            for item in open_[-1]:
                if isinstance(item, Element):
                    yield item
                    open_.append(iter(item.items))
                    break
            else:
                open_.pop()

    def texts(self) -> Iterator[str]:
        left = self.items[::-1]
        while left:
            item = left.pop()
            if isinstance(item, Element):
                left += item.items[::-1]
            else:
                yield item

    def text(self) -> str:
        return " ".join(s for t in self.texts() if (s := t.strip()))

    def children(self) -> list["Element"]:
        return [x for x in self.items if isinstance(x, Element)]


class _Tree(HTMLParser):
    CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {})

    def handle_starttag(self, tag, attrs):
        if self.at.tag in self.CLOSES.get(tag, ()):
            self.at = self.at.parent
        node = Element(tag, {k: v if v is not None else "" for k, v in attrs}, self.at)
        self.at.items.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.at.tag == tag and tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.items.append(data)


def parse_html(html: str) -> Element:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


Test = Callable[[Element], bool]
Chain = list[tuple[str, list[Test]]]  # steps from the left, each with what ties it to the one before: " ", ">", "+" or "~"
NAMED = re.compile(r"[-\w -\U0010ffff]+")
ATTRIBUTE = re.compile(r"""\[\s*([-\w:]+)\s*(?:([~^$*|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\s\]"']+))\s*([iI])?\s*)?\]""")
NTH = re.compile(r"(odd|even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+)")
HOLDS = {"=": lambda have, v: have == v, "~=": lambda have, v: v in have.split(), "^=": lambda have, v: v != "" and have.startswith(v), "$=": lambda have, v: v != "" and have.endswith(v), "*=": lambda have, v: v != "" and v in have, "|=": lambda have, v: have == v or have.startswith(v + "-")}


def _among(node: Element, same_tag: bool) -> list[Element]:
    return [x for x in node.parent.children() if not same_tag or x.tag == node.tag] if node.parent else [node]


def _nth(text: str) -> tuple[int, int] | None:
    """a and b of the places a·n + b."""
    m = NTH.fullmatch(text.strip().lower())
    if not m:
        return None
    if m[1]:
        return 2, m[1] == "odd"
    if m[5]:
        return 0, int(m[5])
    return int(m[2] + "1") if m[2] in ("", "+", "-") else int(m[2]), int((m[3] or "+") + (m[4] or "0"))


class _Selector:
    """Reads a selector: tags, classes, ids, attributes, pseudo-classes, joined by the four combinators; alternatives between commas."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self):
        raise BuildError("CONFIG_INVALID", f"cannot read selector {self.text!r}")

    def space(self) -> bool:
        start = self.at
        while self.text[self.at : self.at + 1].isspace():
            self.at += 1
        return self.at > start

    def name(self) -> str:
        m = NAMED.match(self.text, self.at)
        if not m:
            self.fail()
        self.at = m.end()
        return m[0]

    def alternatives(self, end: str = "") -> list[Chain]:
        out = [self.chain()]
        while self.text[self.at : self.at + 1] == ",":
            self.at += 1
            out.append(self.chain())
        if self.text[self.at : self.at + 1] != end:
            self.fail()
        return out

    def chain(self) -> Chain:
        self.space()
        out, tie = [], " "
        while True:
            out.append((tie, self.step()))
            spaced, sign = self.space(), self.text[self.at : self.at + 1]
            if sign and sign in ">+~":
                tie, self.at = sign, self.at + 1
                self.space()
            elif spaced and sign not in ("", ",", ")"):
                tie = " "
            else:
                return out

    def step(self) -> list[Test]:
        tests: list[Test] = []
        while (sign := self.text[self.at : self.at + 1]) and sign not in " \t\n\r\f,>+~)":
            if sign == "*":
                self.at += 1
                tests.append(lambda n: True)
            elif sign in ".#":
                self.at += 1
                word = self.name()
                tests.append((lambda n, w=word: w in n.attrs.get("class", "").split()) if sign == "." else (lambda n, w=word: n.attrs.get("id") == w))
            elif sign == "[":
                tests.append(self.attribute())
            elif sign == ":":
                tests.append(self.pseudo())
            elif tests:
                self.fail()
            else:
                tests.append(lambda n, w=self.name().lower(): n.tag == w)
        return tests or self.fail()

    def attribute(self) -> Test:
        m = ATTRIBUTE.match(self.text, self.at)
        if not m:
            self.fail()
        self.at = m.end()
        name, op, value, fold = m[1].lower(), m[2], next((x for x in m.groups()[2:5] if x is not None), ""), bool(m[6])
        if op is None:
            return lambda n: name in n.attrs
        case = str.lower if fold else str
        return lambda n: name in n.attrs and HOLDS[op](case(n.attrs[name]), case(value))

    def pseudo(self) -> Test:
        self.at += 1
        name = self.name().lower()
        if self.text[self.at : self.at + 1] != "(":
            kind, _, of = name.partition("-")
            if kind in ("first", "last", "only") and of in ("child", "of-type"):
                typed = of == "of-type"
                return {"first": lambda n: _among(n, typed)[0] is n, "last": lambda n: _among(n, typed)[-1] is n, "only": lambda n: len(_among(n, typed)) == 1}[kind]
            if name == "empty":
                return lambda n: not n.items
            if name == "root":
                return lambda n: n.parent is not None and not n.parent.tag
            self.fail()
        self.at += 1
        if name in ("not", "is", "where", "has"):
            chains = self.alternatives(")")
            self.at += 1
            if name == "has":
                return lambda n: any(_fits(x, c) for x in n.walk() for c in chains)
            return lambda n: any(_fits(n, c) for c in chains) != (name == "not")
        end = self.text.find(")", self.at)
        places = _nth(self.text[self.at : end]) if end > 0 else None
        if places is None or name not in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
            self.fail()
        self.at = end + 1
        (a, b), typed, last = places, name.endswith("of-type"), "last" in name

        def test(n: Element) -> bool:
            row = _among(n, typed)
            at = next(i for i, x in enumerate(row[::-1] if last else row, 1) if x is n) - b
            return at == 0 if a == 0 else at % a == 0 and at // a >= 0

        return test


@lru_cache(maxsize=1024)
def parse_selector(text: str) -> list[Chain]:
    """Alternatives, each a chain of steps."""
    return _Selector(text.strip()).alternatives()


def _before(node: Element) -> list[Element]:
    row = _among(node, False)
    return row[: next((i for i, x in enumerate(row) if x is node), 0)][::-1]


def _fits(node: Element, chain: Chain) -> bool:
    """Whether an element ends a chain: each step is looked for among the relatives that its tie names, all of them if need be."""
    open_ = [(node, len(chain) - 1)]
    seen = set()
    while open_:
        at, k = open_.pop()
        if (id(at), k) in seen or not at.tag or not all(t(at) for t in chain[k][1]):
            continue
        seen.add((id(at), k))
        if k == 0:
            return True
        match chain[k][0]:
            case ">":
                near = [at.parent] if at.parent else []
            case "+":
                near = _before(at)[:1]
            case "~":
                near = _before(at)
            case _:
                near, above = [], at.parent
                while above:
                    near.append(above)
                    above = above.parent
        open_ += [(n, k - 1) for n in near]
    return False


def select(root: Element, selector: str) -> list[Element]:
    """Elements that fit a selector, in the order of the page."""
    chains = parse_selector(selector)
    return [n for n in root.walk() if any(_fits(n, c) for c in chains)]


@dataclass(frozen=True)
class Source:
    """Where a field stands: texts of a selector, or an attribute of it."""

    selector: str
    attribute: str | None = None

    @classmethod
    def read(cls, text: str) -> "Source":
        """``selector``, ``selector@attribute`` or a bare ``data-`` attribute."""
        if re.fullmatch(r"data-[\w-]+", text.strip()):
            return cls(f"[{text.strip()}]", text.strip())
        selector, _, attribute = text.rpartition("@")
        made = cls(selector.strip() or text.strip(), attribute.strip() if selector else None)
        parse_selector(made.selector)
        return made

    def values(self, root: Element) -> list[str]:
        found = select(root, self.selector)
        raw = [n.text() for n in found] if self.attribute is None else [n.attrs[self.attribute] for n in found if self.attribute in n.attrs]
        return [ud.normalize("NFC", v.strip()) for v in raw if v.strip()]


def prune(root: Element) -> None:
    """Takes out what no reader sees: scripts and styles, ignored and hidden elements."""
    for node in [*select(root, HIDDEN), *select(root, "[data-pagefind-ignore], [hidden], [aria-hidden='true']"), *(n for n in root.walk() if re.search("display:none|visibility:hidden", n.attrs.get("style", "").replace(" ", "").lower()))]:
        if node.parent and any(x is node for x in node.parent.items):
            node.parent.items = [x for x in node.parent.items if x is not node]


def extracted(pages: DataFrame, html: str, seen: dict[str, str], raw: dict[str, str]) -> DataFrame:
    """``pages`` with an array of strings for each field: ``raw`` fields are read from the page as it is, ``seen`` ones after pruning. Null pages give empty arrays."""
    before = {n: Source.read(s) for n, s in raw.items()}
    after = {n: Source.read(s) for n, s in seen.items()}
    schema = ", ".join(f"`{n}` array<string>" for n in [*before, *after])

    @F.pandas_udf(schema)
    def extract(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            root = parse_html(text or "")
            row = {n: s.values(root) for n, s in before.items()}
            prune(root)
            rows.append(row | {n: s.values(root) for n, s in after.items()})
        return pd.DataFrame(rows, columns=[*before, *after])

    return pages.withColumn("__x", extract(F.col(html))).select("*", "__x.*").drop("__x")


def canonical_path(path: Column) -> Column:
    """A page's address below the base: index pages stand for their directory."""
    return F.regexp_replace(path, r"(^|/)index\.html$", "$1")


def canonical_url(base: str, path: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), canonical_path(path))


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob; ``**/`` also stands for no directory."""
    return translate(glob).replace(r"(?s:", "(?s:", 1) if "**/" not in glob else "|".join(translate(g) for g in (glob, glob.replace("**/", "")))


def _chosen(rel: Column, include: list[str], exclude: list[str]) -> tuple[Column, Column]:
    """Whether a path is included, and whether it is excluded."""
    java = lambda g: glob_pattern(g).replace("\\Z", "$").replace("(?s:", "(?:").replace("\\z", "$")
    some = lambda globs: reduce(or_, [rel.rlike("^(?:" + java(g) + ")") for g in globs], F.lit(False))
    return some(include), some(exclude)


def _relative(root: str) -> Column:
    return F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + re.escape(root.rstrip("/")) + "/", "")


def skipped(spark: SparkSession, root: str, include: list[str] = ("**/*.html",), exclude: list[str] = ()) -> DataFrame:
    """(path, reason) of the files under a directory that ``discovered`` leaves out; no file is read."""
    rel = _relative(root)
    included, excluded = _chosen(rel, list(include), list(exclude))
    reason = F.when(~included, "not included").when(excluded, "excluded")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return files.select(rel.alias("path"), reason.alias("reason")).where("reason IS NOT NULL")


def discovered(spark: SparkSession, root: str, base: str, include: list[str] = ("**/*.html",), exclude: list[str] = ()) -> DataFrame:
    """(path, url, html) of the pages under a directory; two pages of one address are an error."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if all(g.endswith((".html", ".htm")) for g in include):
        reader = reader.option("pathGlobFilter", "*.htm*")
    files = reader.load(root)
    rel = _relative(root)
    included, excluded = _chosen(rel, list(include), list(exclude))
    pages = files.where(included & ~excluded).select(rel.alias("path"), canonical_url(base, rel).alias("url"), F.decode("content", "UTF-8").alias("html"))
    if twice := pages.groupBy("url").count().where("count > 1").limit(1).collect():
        raise BuildError("DISCOVERY_DUPLICATE_URL", f"several pages have the address {twice[0].url}")
    return pages

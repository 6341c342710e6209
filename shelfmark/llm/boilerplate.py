"""Page furniture and main content: suffix arrays over the token streams of a host's pages.

Pages of a host are cut into blocks of bounded size. In each block the token
streams of titles and lines are put together, with a mark after each line and
another after each page, and a suffix array brings equal beginnings together.
Two kinds of repeats are read off it: whole lines, and long substrings that
stand anywhere, inside lines or over several of them. A string is boilerplate
if enough distinct pages of the host hold it. What it covers is taken out, and
the runs of unique text remain.

A long repeat is the union of its windows of LONG tokens, and each window stands
on at least as many pages as the repeat. So windows are what is counted: those
that enough pages of a block hold are candidates, and since a string that a
share of the host's pages holds has that share in one of the blocks at least,
none is missed. Candidates are then counted over all blocks, so that page counts
are exact for a host of any size, and the windows that stand cover the text.

Two kinds of furniture repeat in part only; ``rules`` finds them. A pointer opens
with a repeated lead ("See also »", "Home >") and goes on with a name of its
own. A list of other records stands under a repeated heading; headings are
those boilerplate lines after which unique lines are nearly always names and
never sentences.
"""

from __future__ import annotations

import re
import unicodedata as ud

from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm.lookalikes import Rewriter
from shelfmark.plans.lineage import written

BLOCK, BLOCK_CHARS = 2_000, 8_000_000  # pages of one host in one suffix array, and their characters
LONG = 20  # tokens of a repeat that is boilerplate wherever it stands
TASKS = 10_000  # tasks among which blocks are spread at most
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
SEPARATORS = frozenset("»>/›«:|–-·")
POINTERS = frozenset("»>/›«:–")
BULLET = re.compile(r"^[-*+•–—›»·]\s+")
ENUMERATED = re.compile(r"^\(?(?:\d{1,3}|[a-z])[.)]\s")
ENDING = re.compile(r"[.!?。！？]['\"”’»)\]]*$")
ARROW = re.compile(" [»>/›«|] ")  # sites draw the same separator in several ways
NUMBER = re.compile(r"\d+")


def line_tokens(line: str, rewriter: Rewriter | None = None) -> list[str]:
    """Tokens of a line in a form that spelling tricks do not touch: compatibility forms folded, lower case, numbers as zeros."""
    if not line.isascii():
        if rewriter is not None:
            line, _ = rewriter.rewrite(line)
        line = ud.normalize("NFKC", line)
    return TOKEN.findall(ARROW.sub(" > ", NUMBER.sub("0", line.lower())))


def suffix_array(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of a sequence of small non-negative integers by their first ``depth`` elements, and their ranks (equal for equal beginnings), by prefix doubling."""
    _, rank = np.unique(codes, return_inverse=True)
    rank = rank.astype(np.int64)
    length = 1
    while length < depth:
        ahead = np.full(len(rank), -1, np.int64)
        ahead[:-length] = rank[length:]
        _, new = np.unique(rank * (len(rank) + 2) + ahead + 1, return_inverse=True)
        if (settled := new.max(initial=0) == len(rank) - 1) or length * 2 >= depth:
            rank = new.astype(np.int64)
            if settled:
                break
        rank, length = new.astype(np.int64), length * 2
    return np.argsort(rank, kind="stable"), rank


def common_prefix(codes: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix of ``order`` after the first, how many elements it shares with the one before, up to ``most``."""
    a, b = order[:-1], order[1:]
    shared, alive = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for k in range(most):
        alive &= (a + k < len(codes)) & (b + k < len(codes))
        if not alive.any():
            break
        live = np.flatnonzero(alive)
        same = codes[a[live] + k] == codes[b[live] + k]
        shared[live[same]] += 1
        alive[live[~same]] = False
    return shared


class Stream:
    """Token streams of the pages of one block, with a boundary token after each line and a token of its own after each page."""

    def __init__(self):
        self.words: dict[str, int] = {"\n": 0}
        self.codes: list[int] = [0]
        self.spans: list[tuple[int, int, int]] = []  # start, length with the closing boundary, page
        self._sorted = None

    def add(self, page: int, tokens: list[str]) -> None:
        start = len(self.codes)
        known = self.words
        if self.spans and self.spans[-1][2] != page:
            self.codes[-1:] = [0, -page - 1, 0]  # what stands on two pages cannot reach over their ends
            start += 2
        self.codes += [known.setdefault(t, len(known)) for t in tokens]
        self.codes.append(0)
        self.spans.append((start, len(tokens) + 1, page))

    def suffixes(self, depth: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, the order of their suffixes, and the ranks of these."""
        if self._sorted is None:
            codes = np.array(self.codes)
            self._sorted = (codes, *suffix_array(codes, depth))
        return self._sorted

    def pages(self, spans: list[tuple[int, int, int]], depth: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """For each span (start, length, page): on how many pages its tokens stand at such a place, and whether it is the first of its kind.

        Suffixes that begin at spans are taken in the order of the suffix array;
        neighbours of the same length that share a prefix of it form a class.
        Classes of spans longer than ``depth`` tokens are told apart by hash.
        """
        if not spans:
            return np.empty(0, np.int64), np.empty(0, bool)
        codes, _, rank = self.suffixes(depth)
        starts, lengths, pages = (np.array(c) for c in zip(*spans))
        tail = np.array([0 if n <= depth else xxhash.xxh3_64_intdigest(codes[s : s + n].tobytes()) >> 1 for s, n in zip(starts, lengths)], np.int64)
        order = np.lexsort((pages, rank[starts], tail, lengths))
        # spans of one length stand in the order of their suffixes
        shared = common_prefix(codes, starts[order], int(min(lengths.max(), depth)))
        same = (lengths[order][1:] == lengths[order][:-1]) & (tail[order][1:] == tail[order][:-1]) & (shared >= np.minimum(lengths[order][1:], depth))
        group = np.concatenate([[0], np.cumsum(~same)])
        fresh = np.concatenate([[True], ~same | (pages[order][1:] != pages[order][:-1])])
        count = np.bincount(group[fresh])
        out, first = np.empty(len(spans), np.int64), np.zeros(len(spans), bool)
        out[order] = count[group]
        first[order[np.concatenate([[True], ~same])]] = True
        return out, first

    def repeats(self, least: int, own: np.ndarray, long: int = LONG) -> list[str]:
        """The substrings of ``long`` tokens that at least ``least`` distinct pages hold and that lie in text marked by ``own``.

        They are the intervals of the suffix array in which neighbours share so
        many tokens, and which come from enough pages.
        """
        codes, order, _ = self.suffixes()
        if len(codes) <= long:
            return []
        shared = common_prefix(codes, order, long) >= long
        near = np.concatenate([[False], shared]) | np.concatenate([shared, [False]])  # all others stand alone
        if not near.any():
            return []
        interval = np.concatenate([[0], np.cumsum(~shared)])[near]
        at = order[near]
        starts = np.array([s for s, _, _ in self.spans])
        page = np.array([p for _, _, p in self.spans])[np.maximum(np.searchsorted(starts, at, side="right") - 1, 0)]
        pairs = np.unique(interval * (page.max() + 1) + page) // (page.max() + 1)
        held, pages = np.unique(pairs, return_counts=True)
        _, first = np.unique(interval, return_index=True)  # an interval's first suffix stands for it
        reach = np.concatenate([[0], np.cumsum(own)])
        words = list(self.words)
        found = at[first[np.isin(interval[first], held[pages >= least])]]
        return [" ".join(words[c] if c else "\n" for c in codes[s : s + long]) for s in found if reach[s + long] - reach[s] == long]


def _key(tokens: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(tokens)) - (1 << 63)


def _openings(tokens: list[str], signs: frozenset) -> list[int]:
    """Lengths of the beginnings of a line that hold a letter and end in a separating sign, but are not all of it; up to three."""
    out = []
    word = 1 if len(tokens) > 1 and tokens[0] in "([" else 0
    if tokens and tokens[word][0].isalpha():
        for i, t in enumerate(tokens[:12]):
            # a dash after one word stands within names as well
            if t in signs and i + 1 < len(tokens) and (signs is SEPARATORS or t != "–" or i > 1):
                out.append(i + 1)
                if len(out) == 3:
                    break
    return out


def _name_like(line: str) -> bool:
    """Whether a line may be the name of a record: short, no sentence."""
    text = BULLET.sub("", line.strip())
    return 0 < len(text) <= 110 and not ENDING.search(text) and len(text.split()) <= 14 and not ENUMERATED.match(text)


SPANS = "doc {kind}, line int, part int, key bigint, pages bigint, first boolean, name boolean, cut int, run string"
WINDOW = 4  # the part under which windows of long repeats stand


@lru_cache(maxsize=1)
def _rewriter() -> Rewriter:
    """One for each worker process, as it holds all classes of look-alikes."""
    return Rewriter()


def _page_lines(title, body) -> list[tuple[int, str]]:
    lines = [(0, title)] if isinstance(title, str) else []
    return lines + (list(enumerate(body.split("\n"), 1)) if isinstance(body, str) else [])


def _block_spans(share: float, least: int, long: int):
    def build(frame: pd.DataFrame, size: int) -> pd.DataFrame:
        stream, spans, rows = Stream(), [], []
        whole = []  # the rows of whole lines, and their places
        for page, (doc, title, body) in enumerate(zip(frame["doc"], frame["title"], frame["body"])):
            for number, line in _page_lines(title, body):
                tokens = line_tokens(line, _rewriter())
                if not tokens:
                    continue
                stream.add(page, tokens)
                at = stream.spans[-1][0]
                if number:
                    whole.append(len(rows))
                    spans.append((at, len(tokens) + 1, page))
                    rows.append((doc, number, 0, _key(tokens), _name_like(line), -1))
                    if _name_like(line):
                        for n in _openings(tokens, POINTERS):
                            spans.append((at, n, page))
                            rows.append((doc, number, 1, _key(tokens[:n]), True, -1))
                else:
                    # openings and ends of titles; an end is a suffix that runs into the boundary
                    raw = [m.span() for m in TOKEN.finditer(line)]
                    raw = raw if len(raw) == len(tokens) else None
                    for n in _openings(tokens, SEPARATORS):
                        spans.append((at, n, page))
                        rows.append((doc, 0, 2, _key(["^", *tokens[:n]]), True, raw[n - 1][1] if raw else -1))
                    for i in range(1, len(tokens) - 1):
                        if tokens[i] in SEPARATORS and len(tokens) - i <= 12:
                            spans.append((at + i, len(tokens) - i + 1, page))
                            rows.append((doc, 0, 3, _key([*tokens[i:], "$"]), True, raw[i][0] if raw else -1))
        pages, first = stream.pages(spans)
        out = pd.DataFrame(rows, columns=["doc", "line", "part", "key", "name", "cut"])
        out["pages"], out["first"], out["run"] = pages, first, None
        # of all pages of the host, this block holds the share that any of its strings must have in one block at least
        enough = max(2, -(-len(frame) * max(share, least / max(1, size)) // 1))
        own = np.zeros(len(stream.codes), bool)
        for k in whole:
            if pages[k] < enough:
                own[spans[k][0] : spans[k][0] + spans[k][1]] = True
        runs = stream.repeats(int(enough), own, long) if spans else []
        if runs:
            found = pd.DataFrame({"doc": [None] * len(runs), "line": 0, "part": WINDOW, "key": 0, "name": False, "cut": -1, "pages": 0, "first": False, "run": runs})
            out = pd.concat([out.astype({"doc": object}), found], ignore_index=True) if len(out) else found
        return out[["doc", "line", "part", "key", "pages", "first", "name", "cut", "run"]]

    return build


def _block_hits(key, pages: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
    """Where the windows of a host stand in the pages of a block: a row for each page that holds any, and one for each window with the number of its pages."""
    empty = pd.DataFrame(columns=["doc", "run", "n", "hits", "lines"], dtype=object)
    if not len(pages) or not len(runs):
        return empty
    letters: dict[str, str] = {}
    automaton = ahocorasick.Automaton()
    for place, run in zip(runs["place"], runs["run"]):
        tokens = run.split(" ")
        automaton.add_word("".join(letters.setdefault(t, chr(0x10000 + len(letters))) for t in tokens), (int(place), len(tokens)))
    automaton.make_automaton()
    # a page without odd characters holds a window only if it holds the window's longest plain word as it stands
    words = [max((t for t in run.split(" ") if t.isascii() and t.isalpha()), key=len, default=None) for run in runs["run"]]
    plain = ahocorasick.Automaton()
    for word in words:
        if word:
            plain.add_word(word, word)
    plain.make_automaton()
    rewriter = _rewriter()
    counts: dict[int, int] = {}
    out = []
    for doc, title, body in zip(pages["doc"], pages["title"], pages["body"]):
        if None not in words:
            whole = (title if isinstance(title, str) else "") + "\n" + (body if isinstance(body, str) else "")
            if rewriter.untouched(whole) and next(plain.iter(whole.lower()), None) is None:
                continue
        text, lines, size = ["\n"], [], 1
        for number, line in _page_lines(title, body):
            if tokens := line_tokens(line, _rewriter()):
                lines.append({"line": number, "start": size, "n": len(tokens)})
                text += [*tokens, "\n"]
                size += len(tokens) + 1
        hits = [{"run": place, "at": end - n + 1} for end, (place, n) in automaton.iter("".join(letters.get(t, " ") for t in text))]
        if hits:
            out.append((doc, None, None, hits, lines))
            for place in {h["run"] for h in hits}:
                counts[place] = counts.get(place, 0) + 1
    out += [(None, place, n, None, None) for place, n in counts.items()]
    return pd.DataFrame(out, columns=["doc", "run", "n", "hits", "lines"], dtype=object) if out else empty


def _covered(long: int):
    """From (doc, hits, lines, kept): each line that kept windows touch, whether they cover it, and the tokens left uncovered as (from, to)."""

    def cover(batches):
        for batch in batches:
            rows = []
            for doc, hits, lines, kept in zip(*(batch.column(c).to_pylist() for c in range(4))):
                kept, inside = set(kept), set()
                for h in hits:
                    if h["run"] in kept:
                        inside.update(range(h["at"], h["at"] + long))
                for line in lines:
                    start, n = line["start"], line["n"]
                    free = [k for k in range(n) if start + k not in inside]
                    if len(free) < n:
                        cuts = [k for i, k in enumerate(free) if not i or free[i - 1] != k - 1]
                        ends = [k + 1 for i, k in enumerate(free) if i + 1 == len(free) or free[i + 1] != k + 1]
                        rows.append((doc, line["line"], not free, n, [{"a": a, "b": b} for a, b in zip(cuts, ends)]))
            if rows:
                names = ["doc", "line", "whole", "n", "left"]
                types = [batch.schema.field(0).type, pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return cover


def _uncovered(text: str, n: int, left: list) -> str:
    """A line without the tokens that are covered, or as it is where its tokens cannot be told in its own spelling."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    if len(spans) != n:
        return text
    return " ".join(text[spans[x["a"]][0] : spans[x["b"] - 1][1]] for x in left)


def furniture(docs: DataFrame, key: str, source: str, title: str, body: str, share: float = 0.035, least: int = 4, long: int = LONG, rules: bool = True, **shares) -> DataFrame:
    """(key, line_no): lines of ``body`` that are not the page's own content, and line 0 where ``title`` carries the name of its site.

    A string is boilerplate if at least ``share`` of its host's pages (and
    ``least`` pages) hold it, be it a whole line or ``long`` tokens anywhere. A
    line that such strings cover is not the page's own. Lines count from 1;
    blank lines and null fields give no rows. Pages without source are one host.

    With ``rules`` a line is boilerplate, too, if ``spread_share`` of all pages
    on at least ``spread_hosts`` of the hosts hold it, and pointers open with a
    lead that is boilerplate in the same sense. What is boilerplate on two hosts
    is on every host, and for pages without source what is on any. Leads are
    rarer than lines and take an eighth of the pages on a fifth of the hosts.
    Unique names under a heading, up to the next sentence or boilerplate line,
    belong to it. A title carries its site's name if its opening or end, with
    the separating sign, stands in ``title_share`` of the host's titles and
    mostly on this host.
    """
    found, _ = _furniture(docs, key, source, title, body, share, least, long, rules, **shares)
    return found.select(F.col("doc").alias(key), F.col("line").cast("long").alias("line_no")).distinct()


def main_content(docs: DataFrame, key: str, source: str, title: str, body: str, share: float = 0.035, least: int = 4, long: int = LONG, rules: bool = True, **shares) -> DataFrame:
    """(key, title, body): every document with its own title and its own lines alone.

    Site names are cut off a title where they stand as written; lines of
    furniture go, long repeats inside other lines are cut out of them, blank
    lines stay. Null fields stay null. See ``furniture`` for what is meant.
    """
    found, partly = _furniture(docs, key, source, title, body, share, least, long, rules, **shares)
    gone = found.groupBy("doc").agg(F.collect_set(F.when(F.col("line") > 0, F.col("line"))).alias("lines"), F.max("opening").alias("opening"), F.min("ending").alias("ending"))
    rows = docs.select(F.col(key).alias("__key"), F.col(title).alias("title"), F.col(body).alias("body")).join(gone, F.col("__key") == F.col("doc"), "left").drop("doc")
    own_lines = F.split(F.col("body"), "\n")
    if partly is not None:
        cuts = partly.where("line > 0 AND NOT whole").groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("line", F.struct("n", "left")))).alias("cuts"))  # the lines of one document

        @F.pandas_udf("string")
        def trimmed(bodies: pd.Series, all_cuts: pd.Series) -> pd.Series:
            def one(text, cuts):
                if text is None or cuts is None:
                    return text
                lines = text.split("\n")
                for number, x in dict(cuts).items():
                    lines[number - 1] = _uncovered(lines[number - 1], x["n"], x["left"])
                return "\n".join(lines)

            return pd.Series([one(t, c) for t, c in zip(bodies, all_cuts)])

        rows = rows.join(cuts, F.col("__key") == F.col("doc"), "left").drop("doc")
        own_lines = F.split(F.when(F.col("cuts").isNotNull(), trimmed("body", "cuts")).otherwise(F.col("body")), "\n")
    kept = F.array_join(F.filter(own_lines, lambda line, i: ~F.coalesce(F.array_contains("lines", i + 1), F.lit(False))), "\n")
    start, end = F.coalesce("opening", F.lit(0)), F.coalesce("ending", F.length("title"))
    own = F.when(F.col("opening").isNull() & F.col("ending").isNull(), F.col("title")).when(end > start, F.btrim(F.substring(F.col("title"), start + 1, end - start))).otherwise(F.col("title"))
    return rows.select(F.col("__key").alias(key), own.alias("title"), kept.alias("body"))


def _furniture(docs: DataFrame, key: str, source: str, title: str, body: str, share: float, least: int, long: int, rules: bool, spread_share: float = 0.004, spread_hosts: float = 0.25, title_share: float = 0.03) -> tuple[DataFrame, DataFrame | None]:
    """(doc, line, opening, ending): the lines of ``furniture``, for line 0 with the places where the own title begins and ends, null if unknown; and what long repeats cover, None if there are none."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    pages = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(source), F.lit("")).alias("host"), F.col(title).alias("title"), F.col(body).alias("body")).where("title IS NOT NULL OR body IS NOT NULL")
    # a host of any size falls into blocks of bounded size, spread evenly; hosts are written, so that their size on disk decides on a broadcast
    chars = F.sum(F.coalesce(F.length("body"), F.lit(0)) + F.coalesce(F.length("title"), F.lit(0)))
    sizes = pages.groupBy("host").agg(F.count("*").alias("size"), chars.alias("chars"))
    sizes = written(sizes.withColumn("blocks", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("chars") / BLOCK_CHARS, F.lit(1.0)))), "hosts")
    total = sizes.agg(F.sum("size").alias("pages"), F.count("*").alias("hosts"), F.sum("blocks").alias("blocks")).first()  # one row
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(TASKS, 2 * (total.blocks or 0)))
    blocked = pages.join(sizes.select("host", "size", "blocks"), "host").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    build = _block_spans(share, least, long)
    spread_out = blocked.select("host", "block", "size", "doc", "title", "body").repartition(tasks, "host", "block", "size")
    found = spread_out.groupBy("host", "block", "size").applyInPandas(lambda k, f: build(f, k[2]).assign(host=k[0]), SPANS.format(kind=kind) + ", host string")
    spans = written(found, "spans")
    partly = _long_repeats(spans, blocked, sizes, kind, share, least, long)
    by_host = written(spans.where(F.col("part") < WINDOW).groupBy("host", "part", "key").agg(F.sum(F.when(F.col("first"), F.col("pages"))).alias("n")), "by-host")
    in_host = (F.col("n") >= least) & (F.col("n") >= F.when(F.col("part") < 2, share).otherwise(title_share) * F.col("size"))
    no_place = F.lit(None).cast("int")
    covered = None if partly is None else partly.where("whole AND line > 0").select("doc", "line", no_place.alias("opening"), no_place.alias("ending"))
    if not rules:
        whole = by_host.where("part = 0").join(sizes, "host").where(in_host).select("host", "key")
        out = spans.where("part = 0").join(whole, ["host", "key"], "left_semi").select("doc", "line", no_place.alias("opening"), no_place.alias("ending"))
        return (out if covered is None else out.unionByName(covered)), partly
    everywhere = by_host.groupBy("part", "key").agg(F.sum("n").alias("all"), F.count("*").alias("hosts"))
    counts = by_host.join(sizes, "host").join(everywhere, ["part", "key"])
    wide = lambda share, hosts: (F.col("all") >= max(least, share * (total.pages or 0))) & (F.col("hosts") >= max(2, hosts * (total.hosts or 0)))
    spread = (F.col("part") == 0) & wide(spread_share, spread_hosts) | (F.col("part") == 1) & wide(spread_share / 8, spread_hosts / 5)
    own_name = (F.col("part") < 2) | (F.col("n") >= 0.5 * F.col("all"))
    own = counts.where((in_host | spread) & own_name).select("host", "part", "key")
    # what several hosts repeat is known as furniture on all of them; a page of no host takes what any host repeats
    shared = own.groupBy("part", "key").agg(F.count("*").alias("k"))
    lent = by_host.select("host", "part", "key").join(shared, ["part", "key"]).where((F.col("part") < 2) & (F.col("k") >= 2) | (F.col("host") == "")).select("host", "part", "key")
    boiler = written(own.unionByName(lent).distinct(), "boilerplate")
    titles = spans.where("part IN (2, 3)").join(boiler, ["host", "part", "key"], "left_semi").groupBy("doc").agg(F.lit(0).alias("line"), F.max(F.when((F.col("part") == 2) & (F.col("cut") >= 0), F.col("cut"))).alias("opening"), F.min(F.when((F.col("part") == 3) & (F.col("cut") >= 0), F.col("cut"))).alias("ending"))
    leads = spans.where("part = 1").join(boiler, ["host", "part", "key"], "left_semi").select("doc", "line").distinct().withColumn("lead", F.lit(True))
    whole = boiler.where("part = 0").select("host", "key", F.lit(True).alias("repeated"))
    lines = spans.where("part = 0").select("doc", "line", "host", "key", "name").join(whole, ["host", "key"], "left").join(leads, ["doc", "line"], "left")
    order = Window.partitionBy("doc").orderBy("line")
    lines = lines.withColumn("known", F.coalesce("repeated", F.lit(False)))
    lines = lines.withColumn("next", F.lead(F.struct("known", "name", "lead")).over(order))
    own_next = F.col("next").isNotNull() & ~F.col("next.known") & F.col("next.lead").isNull()
    marked = written(lines.select("doc", "line", "key", "known", "name", F.col("lead").isNotNull().alias("lead"), F.when(own_next, F.col("next.name")).alias("next_name"), F.col("next").isNotNull().alias("inner")), "lines")
    heads = marked.where("known").groupBy("key").agg(F.count("next_name").alias("c"), F.sum(F.col("next_name").cast("int")).alias("m"), F.count("*").alias("n"))
    heads = heads.where((F.col("m") >= 2) & (F.col("m") >= 0.9 * F.col("c")) & (F.col("c") >= 0.6 * F.col("n"))).select("key", F.lit(True).alias("head"))
    states = marked.join(heads, "key", "left")
    state = F.when(F.col("known"), F.when(F.col("head"), "head").otherwise("other")).when(~F.col("name"), "other")
    before = F.last(state, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gone = F.col("known") | F.col("lead") | (F.col("name") & (before == "head"))
    out = states.withColumn("gone", gone).where("gone").select("doc", "line", no_place.alias("opening"), no_place.alias("ending")).unionByName(titles)
    return (out if covered is None else out.unionByName(covered)), partly


def _long_repeats(spans: DataFrame, blocked: DataFrame, sizes: DataFrame, kind: str, share: float, least: int, long: int) -> DataFrame | None:
    """(doc, line, whole, n, left): the lines that long repeats touch, whether these cover them, and which of their n tokens are left; None if nothing repeats so."""
    runs = spans.where(F.col("part") == WINDOW).select("host", "run").distinct()
    # a candidate stands on the share of a block's pages, so a block has few; they are numbered within their host
    runs = written(runs.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy("run"))), "windows")
    if runs.isEmpty():
        return None
    hosts = runs.select("host").distinct()
    there = blocked.select("host", "block", "doc", "title", "body").join(hosts, "host", "left_semi")
    everywhere = runs.join(sizes.select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")), "host")
    schema = f"doc {kind}, run int, n bigint, hits array<struct<run:int,at:int>>, lines array<struct<line:int,start:int,n:int>>, host string"
    hits = there.groupBy("host", "block").cogroup(everywhere.groupBy("host", "block")).applyInPandas(lambda k, a, b: _block_hits(k, a, b).assign(host=k[0]), schema)
    hits = written(hits, "hits")
    counted = hits.where("run IS NOT NULL").groupBy("host", "run").agg(F.sum("n").alias("n")).join(sizes, "host")
    kept = counted.where((F.col("n") >= least) & (F.col("n") >= share * F.col("size"))).groupBy("host").agg(F.collect_list("run").alias("kept"))  # few for a host, see above
    rows = hits.where("hits IS NOT NULL").join(kept, "host").select("doc", "hits", "lines", "kept")
    return written(rows.mapInArrow(_covered(long), f"doc {kind}, line int, whole boolean, n int, left array<struct<a:int,b:int>>"), "covered")

"""Text that looks the same brought to one form: transitive classes of look-alikes, rewritten by an automaton."""

from __future__ import annotations

import re
import unicodedata as ud
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts beside the Latin letters they look like, lower and upper case.
LATIN_LIKE = {
    "a": "аα", "b": "Ь", "c": "сϲ", "d": "ԁ", "e": "еє", "g": "ց", "h": "һհ", "i": "іι", "j": "јϳ", "k": "кκ", "l": "ӏ", "m": "м", "n": "пη", "o": "оοօ", "p": "рρ", "q": "ԛզ", "r": "г", "s": "ѕ",
    "t": "тτ", "u": "υս", "v": "νѵ", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ᴢ", "A": "АΑ", "B": "ВΒ", "C": "СϹ", "D": "Ꭰ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ",
    "L": "Ꮮ", "M": "МΜ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "R": "Ꭱ", "S": "Ѕ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
}
# Characters without a mark of their own; joiners and selectors are ordinary inside emoji.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\ufe0e\ufe0f\ufeff\ufff9\ufffa\ufffb"
JOINERS = "\u200d\ufe0e\ufe0f"
STYLED = {"<wide>", "<narrow>", "<font>", "<circle>", "<initial>", "<medial>", "<final>", "<isolated>"}
FUSED = {"<compat>", "<square>"}
# Alphabets in which a word is a run of letters; in the other scripts words stand without spaces beside words of these.
ALPHABETS = {"LATIN", "GREEK", "CYRILLIC", "COPTIC", "ARMENIAN", "GEORGIAN", "CHEROKEE", "GOTHIC", "GLAGOLITIC", "RUNIC", "OGHAM", "LISU", "HEBREW", "ARABIC"}
MAIN = {"LATIN", "GREEK", "CYRILLIC"}
# What a wrong decoding leaves before a space or hyphen that is half of a character.
MOJIBAKE = re.compile("[ÂÃÄÅÐÑâð€¢™Œœ]$")


class Classes:
    """Union-find over strings and code points that look alike."""

    def __init__(self):
        self.parent: dict[str, str] = {}
        self.kind: dict[str, str] = {}

    def find(self, x: str) -> str:
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def alike(self, odd: str, plain: str, kind: str) -> None:
        self.kind.setdefault(odd, kind)
        a, b = self.find(odd), self.find(plain)
        if a != b:
            self.parent[a] = b

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return out


@lru_cache(maxsize=1)
def classes() -> Classes:
    """The relations: styled and fused forms, letters with a mark, invisible characters, spaces, letters of other scripts."""
    known = Classes()
    for code in range(0x80, 0x30000):
        char = chr(code)
        parts = ud.decomposition(char).split()
        if parts and parts[0][0] == "<":
            plain = ud.normalize("NFKC", char)
            if plain and not any(ud.category(c) == "Zs" or c in INVISIBLE for c in plain):
                if parts[0] in STYLED:
                    known.alike(char, plain, "styled")
                elif parts[0] in FUSED and len(plain) > 1 and all(ud.category(c)[0] == "L" for c in plain):
                    known.alike(char, plain, "styled")
        elif len(parts) == 2 and ud.category(char)[0] == "L":
            pair = chr(int(parts[0], 16)) + chr(int(parts[1], 16))
            if ud.normalize("NFC", pair) == char:
                known.alike(pair, char, "unjoined")
        elif len(parts) == 1 and ud.category(char)[0] == "L" and len(plain := ud.normalize("NFC", char)) == 1 and code < 0x3000:
            known.alike(char, plain, "styled")
        if ud.category(char) == "Zs":
            known.alike(char, " ", "space")
    for char in INVISIBLE:
        known.alike(char, "", "invisible")
    for latin, others in LATIN_LIKE.items():
        for char in others:
            known.alike(char, latin, "script")
    return known


@lru_cache(maxsize=4096)
def script(char: str) -> str:
    return ud.name(char, "?").split()[0]


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """For each odd member of a class the member that replaces it wherever it stands: the most frequent ordinary one, the least of equals.

    Ordinary members are those that no relation calls odd; letters of other
    scripts are settled word by word instead (see ``Rewriter``).
    """
    known, out = classes(), {}
    for members in known.members().values():
        plain = [m for m in members if known.kind.get(m, "script") == "script"]
        for odd in members:
            if known.kind.get(odd, "script") != "script":
                # a styled Cyrillic letter becomes Cyrillic: only members that are its own plain form or of that form's script compete
                own = ud.normalize("NFKC", odd) if known.kind[odd] in ("styled", "unjoined") else None
                fit = [m for m in plain if own is None or m == own or (len(m) == len(own) == 1 and script(m) == script(own) and m.lower() == own.lower() and m.isupper() == own.isupper())] or plain
                out[odd] = max(fit, key=lambda m: (counts.get(m, 0), [-ord(c) for c in m])) if fit else (own or "")
    return out


# Letters beyond Latin, which alone can mix the scripts of a word; U+2000 to U+2BFF are signs.
BEYOND = re.compile("[\u0370-\u1dff\u1f00-\u1fff\u2c00-\U0010ffff]")


@lru_cache(maxsize=1)
def touched() -> re.Pattern:
    """Any character that may be part of an odd string, or that stands for ASCII letters in compatibility form."""
    odd = {c for m, kind in classes().kind.items() if kind != "script" for c in (m if len(m) == 1 else m[1:])}
    odd |= {chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000 and any(x.isascii() and x.isalpha() for x in ud.normalize("NFKC", chr(c)))}
    codes, ranges = sorted(map(ord, odd)), []
    for c in codes:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]")


class Rewriter:
    """Rewrites texts by the longest odd string at each place; letters of another script follow the rest of their word."""

    def __init__(self, counts: dict[str, int] | None = None):
        known = classes()
        self.automaton = ahocorasick.Automaton()
        for odd, plain in representatives(counts or {}).items():
            self.automaton.add_word(odd, (odd, plain, known.kind[odd]))
        self.automaton.make_automaton()
        self.alike: dict[tuple[str, str], str] = {}
        self.odd = touched()
        self.seen: dict[str, tuple[str, frozenset[str]]] = {}
        for members in known.members().values():
            letters = [m for m in members if len(m) == 1 and m.isalpha() and known.kind.get(m, "script") == "script"]
            for odd in letters:
                for to in sorted({script(x) for x in letters}):
                    fit = [m for m in letters if script(m) == to and m.isupper() == odd.isupper()]
                    if fit:
                        self.alike[(odd, to)] = max(fit, key=lambda m: ((counts or {}).get(m, 0), -ord(m)))
        self.words = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")

    def untouched(self, text: str) -> bool:
        """Whether nothing in a text can be odd: most texts beyond ASCII hold nothing but letters with marks and typographic signs."""
        return text.isascii() or not (self.odd.search(text) or BEYOND.search(text))

    def _word(self, word: str) -> tuple[str, frozenset[str]]:
        """A word in the script of most of its letters, and whether letters were replaced or stay; kept, as words come again."""
        known = self.seen.get(word)
        if known is None:
            scripts = [script(c) for c in word]
            mixed = {s for s in scripts if s in ALPHABETS}
            known = (word, frozenset())
            if len(mixed) > 1 and mixed & MAIN:
                to = max(sorted(mixed & MAIN), key=lambda s: (scripts.count(s), s == "LATIN"))
                plain = [self.alike.get((c, to), c) if s in mixed and s != to else c for c, s in zip(word, scripts)]
                # a letter of another script goes to its like, or has none and stays
                known = ("".join(plain), frozenset("script" if c != x else "mixed" for c, x, s in zip(word, plain, scripts) if s in mixed and s != to))
            if len(word) <= 40:
                if len(self.seen) >= 200_000:
                    self.seen.clear()
                self.seen[word] = known
        return known

    def rewrite(self, text: str) -> tuple[str, set[str]]:
        """The text in its one form, and the kinds of odd matter that stood in it."""
        if self.untouched(text):
            return text, set()
        out, kinds, done = [], set(), 0
        for end, (odd, plain, kind) in self.automaton.iter_long(text):
            start = end - len(odd) + 1
            if kind == "invisible" and odd in JOINERS and start and _emoji(text, start):
                continue
            if odd in "\u00a0\u00ad" and start and MOJIBAKE.match(text[start - 1]):
                continue
            out += [text[done:start], plain]
            done = end + 1
            kinds.add(kind)
        text = "".join(out) + text[done:]
        out, done = [], 0
        for word in self.words.finditer(text):
            if not word[0].isascii():
                plain, odd = self._word(word[0])
                if odd:
                    kinds |= odd
                    out += [text[done : word.start()], plain]
                    done = word.end()
        text = "".join(out) + text[done:]
        return ud.normalize("NFC", text) if kinds else text, kinds


def _emoji(text: str, at: int) -> bool:
    """Whether the joiner or selector at a place follows a pictograph (maybe with a modifier or selector between)."""
    before = text[at - 1]
    return ud.category(before) in ("So", "Sk") or before in JOINERS and at > 1 and ud.category(text[at - 2]) in ("So", "Sk") or before in "#*0123456789" and text[at] == "\ufe0f"


def _count(batches):
    known = classes()
    single = {m for m in known.parent if len(m) == 1}
    several = ahocorasick.Automaton()
    for m in known.parent:
        if len(m) > 1:
            several.add_word(m, m)
    several.make_automaton()
    points, strings = np.zeros(0x110000, np.int64), {}
    for batch in batches:
        for column in batch.columns:
            text = "\n".join(x for x in column.to_pylist() if x)
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            found = np.bincount(codes)
            points[: len(found)] += found
            for _, m in several.iter(text):
                strings[m] = strings.get(m, 0) + 1
    rows = [(m, int(points[ord(m)])) for m in single if points[ord(m)]] + list(strings.items())
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in rows]), pa.array([n for _, n in rows], pa.int64())], names=["m", "n"])


def member_counts(docs: DataFrame, fields: list[str]) -> dict[str, int]:
    """How often each member of a class of look-alikes stands in the texts of all rows; at most a row for each member of the fixed relations."""
    counted = docs.select(*fields).mapInArrow(_count, "m string, n bigint").groupBy("m").agg(F.sum("n").alias("n"))
    return {r.m: r.n for r in counted.collect()}


def rewritten(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, text, kinds): every non-null field in its one form, with the kinds of odd matter found in it.

    Kinds are ``styled`` (full-width, styled or fused forms), ``unjoined``
    (letter and mark with a composed form), ``invisible``, ``space``,
    ``script`` (letters of another script in a word, replaced by those they look
    like) and ``mixed`` (such letters that look like none of the word's script
    and stay); no kinds means that the text stands as it was. Null fields give no row; empty texts stay empty.
    Plain ASCII texts, which are in their form already, pass by Python.
    Representatives follow the frequencies of all texts in ``fields``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(member_counts(docs, fields))
    rows = docs.select(F.col(key).alias("__key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x")).select("__key", "x.field", "x.text").where("text IS NOT NULL")
    odd = F.col("text").rlike(r"[^\x00-\x7f]")
    kind = docs.schema[key].dataType.simpleString()

    def rewrite(batches):
        rewriter = Rewriter(sent.value)
        for batch in batches:
            done = [rewriter.rewrite(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in done], pa.string()), pa.array([sorted(k) for _, k in done], pa.list_(pa.string()))], names=["__key", "field", "text", "kinds"])

    through = rows.where(odd).mapInArrow(rewrite, f"__key {kind}, field string, text string, kinds array<string>")
    return through.unionByName(rows.where(~odd).withColumn("kinds", F.array().cast("array<string>"))).withColumnRenamed("__key", key)

"""Statistics of documents, and gradient-boosted trees that tell prose from lists, tables and junk."""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("prose", "list", "table", "junk")
MODEL = Path(__file__).with_name("quality_model.json")
# Articles, pronouns, prepositions, conjunctions, auxiliaries and particles of the grammars of English, German, French, Greek and Russian.
COMMON = frozenset(
    "the a an of in on at by to from with without for as into onto over under about after before between during through against among upon within along across behind beside near since until and or but nor if than then so because although while when where "
    "which who whom whose what how why that this these those it its he him his she her they them their we us our you your i me my is are was were be been being am has have had having do does did will would can could may might must shall should not no only also very "
    "der die das den dem des ein eine einen einem einer eines und oder aber denn sondern dass weil wenn als ob wie wo wer was nicht kein keine keinen ich du er sie es wir ihr man sich mich dich uns mein sein seine seinen ihre ihren ihrem dieser diese dieses diesem diesen "
    "in im ins an am auf aus bei beim bis durch für gegen hinter mit nach neben ohne seit über um unter von vom vor zu zum zur zwischen ist sind war waren wird werden wurde wurden hat haben hatte hatten kann können muss müssen soll sollen auch noch nur schon sehr so hier dort da dann "
    "le la les l un une des du de d et ou mais donc or ni car que qui quoi dont où si comme quand lorsque ne n pas plus jamais je tu il elle on nous vous ils elles me te se s lui leur y en ce c cet cette ces son sa ses mon ma mes notre votre leurs "
    "à au aux dans par pour sur sous avec sans entre vers chez contre depuis pendant avant après près derrière devant est sont était étaient été être a ont avait avaient avoir fait très aussi encore "
    "ο η το οι τα του της των τον την τους τις ένας μια μία ένα και κι ή ούτε αλλά όμως γιατί αν ότι πως που όταν όπως ενώ δεν δε μη μην να θα ας εγώ εσύ αυτός αυτή αυτό αυτοί αυτές μου σου μας σας τι ποιος ποια ποιο κανείς "
    "σε στο στη στην στον στα στις στους από με για ως προς κατά μετά πριν χωρίς μέχρι υπό πάνω κάτω δίπλα είναι ήταν έχει έχουν είχε είχαν πολύ πιο "
    "и а но или ни да если что чтобы как так когда где куда потому хотя не бы ли же я ты он она оно мы вы они его её ее их мой свой этот эта это эти тот та те кто который которая которое которые весь все всё "
    "в во на с со к ко у о об от до из за по под над при про без для через между перед после около против среди есть был была было были быть будет будут может уже ещё только очень там здесь".split()
)
MARK = re.compile(r"\s*(?:[-*+•–—›»▪◦‣·]\s+|\(?(?:\d{1,3}|[a-zA-Z]|[ivx]{2,4})[.)]\s+|\[\d{1,3}\]\s+)\S")
SENTENCE = re.compile(r"[.!?…。！？;:]['\"”’»)\]]*$")
CELLS = (re.compile(r"\|"), re.compile(r"\t"), re.compile(r";(?! )"), re.compile(r",(?! )"), re.compile(r"(?<=\S) {2,}(?=\S)"))
WORD = re.compile(r"\S+")
LETTERS = re.compile(r"[^\W\d_]+")
LATIN = re.compile(r"[a-z]+")
MARKUP = re.compile(r"</?\w[^<>]*>|\{\{[^{}]*\}\}|&\w{2,8};")
MOJIBAKE = re.compile("[ÃÂâïÅÐÑ][\u0080-¿€™ŒœŠš‘-•‚-‰]|�")
BLOB = re.compile(r"[A-Za-z0-9+/=]{25,}")
HEXES = re.compile(r"(?:0x)?(?=\d*[a-f]*\d)[0-9a-f]{2,16}|[a-f]{2}")
LEET = re.compile(r"[a-zA-Z]+[0-9@$#!|]+[a-zA-Z]|[0-9@$#!|]+[a-zA-Z]+[0-9@$#!|]|[0-9@$#!|]{2,}[a-zA-Z]|[@$#!|][a-zA-Z]")
DIGIT = re.compile(r"\d")
UPPER = re.compile(r"[A-ZÀ-ÖØ-ÞΑ-ΫА-Я]")
SIGN = re.compile(r"[^\w\s]|_")
WIDE = re.compile("[\u3000-\uffef]")
KANA = re.compile("[のはがをにでたらい]")
TAIL = ".,;:!?\"'”’“‘()[]«»…-–"
FIELDS = (
    "chars", "words", "mean_word", "symbols", "digits", "upper", "punctuated", "common", "marked", "celled", "aligned", "short_lines", "bare", "unique_words", "top_word", "compressed", "odd_words", "long_words", "markup", "mojibake", "hexes", "letters", "bigrams", "words_a_line", "line_spread", "sentences", "wide_script", "cells_alike", "inline",
)


def letter_pairs(texts) -> dict[str, float]:
    """Log probabilities of a Latin letter after another, from given texts, smoothed."""
    pairs, firsts = Counter(), Counter()
    for text in texts:
        for word in LATIN.findall(text.lower()):
            for a, b in zip("^" + word, word + "$"):
                pairs[a + b] += 1
                firsts[a] += 1
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    return {a + b: round(math.log((pairs[a + b] + 0.5) / (firsts[a] + 14)), 2) for a in "^" + alphabet for b in alphabet + "$"}


def statistics(text: str, pairs: dict[str, float], scores: dict[str, float]) -> list[float] | None:
    """The numbers of FIELDS for the lines of a text; None if it holds nothing but white space. ``scores`` keeps words' letter-pair sums between calls."""
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return None
    words = WORD.findall(text)
    bare = "".join(words)
    n, count = len(bare), len(words)
    share = dict.fromkeys(("punctuated", "marked", "celled", "aligned", "short", "bare", "sentences", "inline"), 0.0)
    widths, cells, punctuated, binding, latin = [], Counter(), 0, 0, []
    for line in lines:
        own = line.split()
        size = sum(map(len, own))
        stripped = line.strip()
        ends = bool(SENTENCE.search(stripped))
        punctuated += ends
        widths.append(len(stripped))
        marked = bool(MARK.match(line))
        kinds = [len(c.findall(stripped)) for c in CELLS]
        lettered = len(SIGN.findall(stripped)) < 0.6 * size or kinds[0] >= 2 and not stripped.strip("|-: \t")
        celled = lettered and (kinds[0] >= 2 or kinds[1] >= 1 or kinds[2] >= 1 and len(own) < 6 * (kinds[2] + 1) and not SENTENCE.search(stripped.rstrip(";")) or kinds[3] >= 1 and not ends)
        aligned = lettered and kinds[4] >= 1 and not ends
        plain = [w.strip(TAIL) for w in line.lower().split()]
        frequent = sum(map(COMMON.__contains__, plain))
        binding += frequent
        latin += [w for w in plain if w.isascii() and w.isalpha()]
        if not line.isascii():
            frequent += len(KANA.findall(stripped)) // 2
        commas = stripped.count(", ") + stripped.count("; ") + stripped.count(" · ") + stripped.count(" / ")
        share["inline"] += size * (commas >= 5 and commas * 5 >= len(own) and frequent * 8 <= len(own))
        if celled or aligned:
            cells[tuple(min(k, 9) for k in kinds)] += size
        share["marked"] += size * marked
        share["celled"] += size * celled
        share["aligned"] += size * aligned
        share["short"] += size * (len(own) <= 5)
        # what stands in a line alone, without a mark, a sign at its end or words that bind
        share["bare"] += size * (not (marked or celled or aligned or ends) and len(own) <= 7 and frequent <= (len(own) >= 3) and len(stripped) < 60)
        share["sentences"] += size * (ends and frequent >= 1 and not marked and not celled)
    scored, total = 0.0, 0
    for w, k in Counter(latin).items():
        score = scores.get(w)
        if score is None:
            if len(scores) > 200_000:
                scores.clear()
            score = scores[w] = sum([pairs.get(a + b, -6.0) for a, b in zip("^" + w, w)])
        scored += k * score
        total += k * len(w)
    odd = sum(len(w) for w in words if len(w) > 2 and not w.isalpha() and LEET.search(w))
    distinct = Counter(text.lower().split())
    raw = text.encode("utf-8", "surrogatepass")
    wide = 0 if text.isascii() else len(WIDE.findall(bare))
    mean = sum(widths) / len(widths)
    return [
        math.log1p(n), math.log1p(count), n / count, 1 - sum(map(str.isalnum, bare)) / n, len(DIGIT.findall(bare)) / n, len(UPPER.findall(bare)) / n, punctuated / len(lines),
        binding / count, share["marked"] / n, share["celled"] / n, share["aligned"] / n, share["short"] / n, share["bare"] / n, len(distinct) / count, max(len(w) * k for w, k in distinct.items()) / n,
        len(zlib.compress(raw, 1)) / len(raw), odd / n, sum(map(len, BLOB.findall(text))) / n, sum(map(len, MARKUP.findall(text))) / n, (0 if text.isascii() else 2 * len(MOJIBAKE.findall(text))) / n, sum(len(w) for w in words if len(w) < 19 and HEXES.fullmatch(w)) / n,
        sum(map(len, LETTERS.findall(bare))) / n, scored / total if total else -2.0, count / len(lines), (sum((w - mean) ** 2 for w in widths) / len(widths)) ** 0.5 / (mean + 1), share["sentences"] / n, wide / n, max(cells.values()) / n if cells else 0.0, share["inline"] / n,
    ]


class Trees:
    """Gradient-boosted regression trees on a logistic loss, one against the rest for each kind, with a calibrated slope and offset."""

    def __init__(self, kinds: list[dict]):
        self.kinds = kinds

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """A column of calibrated probabilities for each of KINDS, summing to 1."""
        out = []
        for kind in self.kinds:
            score = np.full(len(x), kind["base"])
            for feature, cut, left, right, value in kind["trees"]:
                feature, cut, left, right, value = map(np.asarray, (feature, cut, left, right, value))
                at = np.zeros(len(x), np.int64)
                for _ in range(kind["depth"]):
                    inner = feature[at] >= 0
                    below = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
                    at = np.where(inner, np.where(below, left[at], right[at]), at)
                score += value[at]
            out.append(1 / (1 + np.exp(-(kind["slope"] * score + kind["offset"]))))
        out = np.array(out).T + 1e-9
        return out / out.sum(axis=1, keepdims=True)


def fit_kind(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 8) -> dict:
    """Trees for one kind: Newton steps on the logistic loss, splits at quantiles."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.array([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]).T
    rate_of = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(rate_of / (1 - rate_of)))
    score, trees = np.full(len(x), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        tree: list[list] = [[], [], [], [], []]

        def grow(rows: np.ndarray, level: int) -> int:
            node = len(tree[0])
            for column, start in zip(tree, (-1, 0.0, 0, 0, 0.0)):
                column.append(start)
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-3, None)
            if level < depth and len(rows) >= 2 * least:
                for f, c in enumerate(cuts):
                    if len(c):
                        gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(c) + 1))[:-1]
                        nl = np.cumsum(np.bincount(binned[rows, f], minlength=len(c) + 1))[:-1]
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        gain[(nl < least) | (len(rows) - nl < least)] = 0
                        k = int(np.argmax(gain))
                        if gain[k] > best[0]:
                            best = (float(gain[k]), (f, k))
            if best[1]:
                f, k = best[1]
                below = binned[rows, f] <= k
                tree[0][node], tree[1][node] = f, round(float(cuts[f][k]), 6)
                tree[2][node] = grow(rows[below], level + 1)
                tree[3][node] = grow(rows[~below], level + 1)
            else:
                tree[2][node] = tree[3][node] = node
                tree[4][node] = round(float(rate * gs / (hs + 1)), 5)
            return node

        grow(np.arange(len(x)), 0)
        trees.append(tree)
        at = np.zeros(len(x), np.int64)
        f, c, left, right, v = map(np.asarray, tree)
        for _ in range(depth):
            at = np.where(f[at] >= 0, np.where(x[np.arange(len(x)), np.maximum(f[at], 0)] <= c[at], left[at], right[at]), at)
        score = score + v[at]
    return {"base": base, "depth": depth, "trees": trees, "slope": 1.0, "offset": 0.0}


def calibrate(kind: dict, x: np.ndarray, y: np.ndarray) -> dict:
    """Slope and offset of the scores by logistic regression on held-out cases, drawn towards the identity."""
    raw = Trees([kind | {"slope": 1.0, "offset": 0.0}])
    score = np.zeros(len(x))
    for i in range(len(x)):
        score[i] = _score(raw.kinds[0], x[i : i + 1])[0]
    a, b = 1.0, 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-(a * score + b)))
        a -= 0.02 * (((p - y) * score).mean() + 0.05 * (a - 1))
        b -= 0.02 * ((p - y).mean() + 0.05 * b)
    return kind | {"slope": round(a, 4), "offset": round(b, 4)}


def _score(kind: dict, x: np.ndarray) -> np.ndarray:
    score = np.full(len(x), kind["base"])
    for tree in kind["trees"]:
        f, c, left, right, v = map(np.asarray, tree)
        at = np.zeros(len(x), np.int64)
        for _ in range(kind["depth"]):
            at = np.where(f[at] >= 0, np.where(x[np.arange(len(x)), np.maximum(f[at], 0)] <= c[at], left[at], right[at]), at)
        score += v[at]
    return score


def text_quality(docs: DataFrame, key: str, text: str, title: str | None = None, model: str | None = None) -> DataFrame:
    """(key, statistics of FIELDS, kind, prose, list, table, junk): one row for each row of ``docs``.

    Statistics cover ``text`` without its title line, if ``title`` names a
    column with it. ``chars`` and ``words`` are counts, ``mean_word`` a length,
    ``symbols`` ... shares. ``kind`` is the most probable of prose, list, table
    and junk by boosted trees; the last columns are their probabilities. Texts
    that are null, empty, blank or only a title have null everywhere. Rows are
    judged alone: nothing is shuffled, and whole texts are read.
    """
    stored = json.loads(Path(model or MODEL).read_text())
    sent = docs.sparkSession.sparkContext.broadcast(stored)
    rest = F.col(text)
    if title:
        rest = F.when(F.col(title) == F.col(text), "").when(F.startswith(text, F.concat(title, F.lit("\n"))), F.substring(F.col(text), F.length(title) + 2, F.length(text))).otherwise(F.col(text))
    names = [*FIELDS, *(f"p_{k}" for k in KINDS)]
    schema = f"key {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names) + ", kind string"

    def judge(batches):
        pairs, trees, scores = sent.value["pairs"], Trees(sent.value["kinds"]), {}
        for batch in batches:
            rows = [statistics(t, pairs, scores) if t else None for t in batch.column(1).to_pylist()]
            held = [i for i, r in enumerate(rows) if r]
            table = np.full((len(rows), len(names)), np.nan)
            kinds: list[str | None] = [None] * len(rows)
            if held:
                x = np.array([rows[i] for i in held])
                p = trees.probabilities(x)
                counts = x.copy()
                counts[:, :2] = np.round(np.expm1(x[:, :2]))
                table[held] = np.hstack([counts, p])
                for i, k in zip(held, p.argmax(axis=1)):
                    kinds[i] = KINDS[k]
            columns = [pa.array(table[:, c], from_pandas=True) for c in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(kinds, pa.string())], names=["key", *names, "kind"])

    judged = docs.select(F.col(key), rest.alias("rest")).mapInArrow(judge, schema)
    return judged.withColumnsRenamed({"key": key} | {f"p_{k}": k for k in KINDS})

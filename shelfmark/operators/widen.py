"""Further forms of a reader's words: variants, corrections and fuzzy forms from the vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.distance import distance_to, near_words
from shelfmark.functions.text import fold_word
from shelfmark.plans.syntax import Node, Not, Term

# Fixed values of the ranking rules.
LEAST_DOCUMENTS = 2
DOMINANCE = 0.01
CORRECTIONS = 3
FUZZY = 50


def wideable(node: Node, excluded: bool = False) -> dict[str, bool]:
    """Folded wideable words, with whether one is the word being typed; the right side of an exclusion is left out unless asked for."""
    out: dict[str, bool] = {}
    if isinstance(node, Term) and node.wideable:
        out[fold_word(node.value)] = node.prefix
    for child in (node.left,) if isinstance(node, Not) and not excluded else node.children():
        for word, typing in wideable(child, excluded).items():
            out[word] = out.get(word, False) or typing
    return out


def variants_of(variants: DataFrame | None, node: Node) -> dict[str, list[str]]:
    """The other forms of the groups of a query's words."""
    words = list(wideable(node, excluded=True))
    if variants is None or not words:
        return {}
    return {r.term: list(r.variants) for r in variants.where(F.col("term").isin(words)).collect()}  # a row for each word typed


def candidates(vocabulary: DataFrame, word: str, most: int, least: int = LEAST_DOCUMENTS, stem: int = 0) -> DataFrame:
    """(term, doc, distance): words within ``most`` edits that at least ``least`` documents hold and that share the first ``stem`` letters.

    Length, frequency and beginning are filters of the scan; a plain edit
    distance inside the engine lets few words through to the exact one.
    """
    near = vocabulary.where(F.col("doc") >= least).where(near_words(word, F.col("term"), most)).where(F.col("term") != word)
    if stem:
        near = near.where(F.col("term").startswith(word[:stem]))
    return near.select("term", "doc", distance_to(word, most)(F.col("term")).alias("distance")).where(F.col("distance") <= most)


def correction_suggestions(vocabulary: DataFrame, word: str, limit: int = 10) -> DataFrame:
    """(term, doc, distance): the nearest words, those far rarer than the most frequent of them left out; nearest, then most frequent first."""
    most = 1 if len(word) <= 4 else 2
    found = candidates(vocabulary, word, most, stem=0 if len(word) >= 4 else 1)
    top = found.select(F.max("doc")).scalar()
    return found.where(F.col("doc") >= top * DOMINANCE).orderBy("distance", F.desc("doc"), "term").limit(limit)


def completion_suggestions(vocabulary: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """(term, doc, distance): words that begin with ``prefix`` and go on, most frequent first; distance is what they add."""
    found = vocabulary.where(F.col("term").startswith(prefix) & (F.col("term") != prefix))
    return found.select("term", "doc", (F.length("term") - len(prefix)).alias("distance")).orderBy(F.desc("doc"), "term").limit(limit)


def corrections_of(vocabulary: DataFrame, node: Node) -> dict[str, list[str]]:
    """Corrections of the words that the vocabulary does not hold, three at most each; a word being typed is held if any word begins with it."""
    out = {}
    for word, typing in wideable(node).items():
        known = F.col("term").startswith(word) if typing else F.col("term") == word
        if len(word) < 3 or not vocabulary.where(known).isEmpty():
            continue
        if forms := [r.term for r in correction_suggestions(vocabulary, word, CORRECTIONS).collect()]:
            out[word] = forms
    return out


def fuzzy_of(vocabulary: DataFrame, node: Node) -> dict[str, list[str]]:
    """Words of the vocabulary within the distance that a word's length allows and with its first two letters, known or not; fifty at most each."""
    out = {}
    for word in wideable(node):
        most = 0 if len(word) <= 2 else 1 if len(word) <= 5 else 2
        if most:
            found = candidates(vocabulary, word, most, least=1, stem=2).where("distance > 0").orderBy("distance", F.desc("doc"), "term").limit(FUZZY)
            if forms := [r.term for r in found.collect()]:
                out[word] = forms
    return out

"""Suggestions: corrections and completions, also within the rest of a query."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import fold_word
from shelfmark.operators.filters import conditions, together
from shelfmark.operators.search import Searcher
from shelfmark.operators.widen import completion_suggestions, correction_suggestions

SCHEMA = "term string, doc long, distance int"


def suggest(searcher: Searcher, text: str, kind: str = "completion", limit: int = 10, context: str = "", filters: Mapping | None = None) -> DataFrame:
    """(term, doc, distance): words to offer for ``text``, best first.

    With a ``context``, a wider pool is drawn and kept to the words that stand
    in a document that the context and its filters reach; ``doc`` is then the
    number of these documents. A blank text or a limit of 0 suggests nothing; a
    context without words is none, its filters included.
    """
    index = searcher.index
    word = fold_word(text.strip())
    if not word or limit <= 0:
        return index.spark.createDataFrame([], SCHEMA)
    plan = searcher.plan(context, typing=False) if context.strip() else None
    pool = limit if plan is None else min(50, 5 * limit)
    offered = (completion_suggestions if kind == "completion" else correction_suggestions)(index.vocabulary, word, pool)
    if plan is None:
        return offered
    reached = index.documents.where(together(conditions(searcher.fields, filters))).select("id").join(searcher.matches(plan, ranked=False).select("id"), "id", "left_semi")
    # all candidates are counted in one pass over their postings
    words = offered.select("term", "distance")
    held = index.postings.join(F.broadcast(words), "term").select("term", "distance", "id").join(reached, "id", "left_semi")  # at most 50 words
    counted = held.groupBy("term", "distance").agg(F.countDistinct("id").alias("doc")).select("term", "doc", "distance")
    first = ["distance"] if kind == "correction" else []
    return counted.orderBy(*first, F.desc("doc"), "term").limit(limit)

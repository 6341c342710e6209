"""Groups of words that stand for each other: equal stems and declared synonyms, less suppressed pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.errors import BuildError
from shelfmark.functions.stem import stem
from shelfmark.functions.text import fold_tokens


def declared_groups(groups: list[list[str]], what: str) -> list[list[str]]:
    """Declared words as the index holds them; each must be one word."""
    out = []
    for group in groups:
        folded = []
        for word in group:
            parts = fold_tokens(word)
            if len(parts) != 1:
                raise BuildError("CONFIG_INVALID", f"{what} {word!r} must be one word of the index")
            folded += parts
        out.append(list(dict.fromkeys(folded)))
    return out


def _pairs(spark: SparkSession, groups: list[list[str]]) -> DataFrame:
    rows = [(a, b) for g in groups for a in g for b in g if a != b]
    return spark.createDataFrame(rows, "term string, other string")


def term_variants(vocabulary: DataFrame, synonyms: list[list[str]] = (), suppressed: list[list[str]] = (), generated: bool = True) -> DataFrame:
    """(term, variants): for each word of the vocabulary its other forms, sorted; words without any have no row.

    Declared synonyms stand whether or not any document holds them: a word that
    no page uses still leads to those it stands for. Without ``generated`` they
    are the only forms. Only distinct words are stemmed. Words of one stem meet by a group-by on
    the stem, and each pair is a row before suppressed pairs are taken away.
    """
    spark = vocabulary.sparkSession

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(stem)

    words = vocabulary.select("term", stems("term").alias("stem"))
    groups = words.groupBy("stem").agg(F.collect_set("term").alias("terms")).where("size(terms) > 1")
    pairs = groups.select(F.explode("terms").alias("term"), "terms").select("term", F.explode("terms").alias("other")).where("term <> other")
    declared = _pairs(spark, declared_groups(list(synonyms), "synonym"))
    pairs = pairs.unionByName(declared).distinct() if generated else declared.distinct()
    gone = _pairs(spark, declared_groups(list(suppressed), "suppression"))
    return pairs.join(gone, ["term", "other"], "left_anti").groupBy("term").agg(F.array_sort(F.collect_set("other")).alias("variants"))

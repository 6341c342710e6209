"""Registered queries of the training-text operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.timestamps import published_instants
from shelfmark.llm.boilerplate import furniture, main_content
from shelfmark.llm.distinctive import distinctive_terms
from shelfmark.llm.encoding import encode_documents
from shelfmark.llm.frequency import count_values, marked_values
from shelfmark.llm.leaks import leaked_items
from shelfmark.llm.lines import excessive_lines, without_lines
from shelfmark.llm.lookalikes import rewritten
from shelfmark.llm.neardup import similar_groups, similar_pairs
from shelfmark.llm.quality import text_quality
from shelfmark.plans.ship import ship

TOKENIZERS = os.environ.get("SHELFMARK_TOKENIZERS", "/opt/tokenizers")
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _terms(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')"


_BOTH = "coalesce(title, '') || chr(10) || coalesce(body, '')"


def _runs(table: str, key: str, text: str, size: int) -> str:
    """(key, run): the distinct runs of so many terms of each row."""
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i + {size - 1}], ' ') AS run FROM (SELECT {key}, w, unnest(range(1, len(w) - {size} + 2)) AS i FROM (SELECT {key}, {_terms(text)} AS w FROM {table}))"


@query(f"""WITH t AS (SELECT doc_id, unnest({_terms(_BOTH)}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM c GROUP BY term)
SELECT doc_id, term FROM c JOIN d USING (term) WHERE tf >= 3 AND df <= 5 AND regexp_full_match(term, '\\p{{L}}{{5,}}')""")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return distinctive_terms(docs, "doc_id", ["title", "body"], min_tf=3, max_df=5, pattern=r"^\p{L}{5,}$").select("doc_id", "term")


def _dates(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """(doc_id, published_on) of documents whose page has a date."""
    stamps = published_instants(table(spark, sf_dir, "site_pages"), table(spark, sf_dir, "sites"))
    return docs.select("doc_id", "page_id").join(stamps, "page_id").select("doc_id", F.timestamp_micros("published_us").cast("date").alias("published_on"))


@query(r"""WITH l AS (SELECT doc_id, source, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS line_no FROM documents WHERE body IS NOT NULL AND source IS NOT NULL),
f AS (SELECT doc_id, source, line_no, regexp_replace(lower(trim(regexp_replace(line, '[\s\p{Z}\x0b\x1c-\x1f\x85]+', ' ', 'g'))), '\p{Nd}+', '0', 'g') AS form FROM l),
g AS (SELECT * FROM f WHERE length(regexp_replace(form, '\P{L}', '', 'g')) >= 3), k AS (SELECT source, form, count(DISTINCT doc_id) AS n FROM g GROUP BY ALL),
s AS (SELECT source, count(*) AS size FROM documents WHERE body IS NOT NULL AND source IS NOT NULL GROUP BY source)
SELECT doc_id, line_no::BIGINT AS line_no FROM g JOIN k USING (source, form) JOIN s USING (source) WHERE n >= 5 AND n >= 0.02 * size""")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By documents alone, as the case is defined: copies count each, and dates do not count."""
    return excessive_lines(table(spark, sf_dir, "documents"), "doc_id", "source", "body")


@query()
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewritten(table(spark, sf_dir, "documents"), "doc_id", ["title", "body"]).where("size(kinds) > 0").select("doc_id", "field")


def _offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, forms) of each query with at least one correction: the offered forms in lower case."""
    forms = F.transform(F.flatten(F.filter(F.map_values("corrections"), lambda v: v.isNotNull())), F.lower)
    rows = table(spark, sf_dir, "query_vectors").select("query_id", F.filter(forms, lambda f: f.isNotNull()).alias("forms"))
    return rows.where("size(forms) > 0").groupBy("query_id").agg(F.min("forms").alias("forms"))


@query(f"""WITH b AS (SELECT term, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest({_terms("body")}) AS term FROM documents) GROUP BY term),
o AS (SELECT DISTINCT query_id, lower(form) AS term FROM (SELECT query_id, unnest(flatten(map_values(corrections))) AS form FROM query_vectors WHERE corrections IS NOT NULL) WHERE form IS NOT NULL),
c AS (SELECT term, count(*) AS n FROM o GROUP BY term),
m AS (SELECT 'body' AS field, term, CASE WHEN n = 1 THEN 'rare' WHEN n > 0.3 * (SELECT count(*) FROM documents WHERE body IS NOT NULL) THEN 'common' END AS mark FROM b
 UNION ALL SELECT 'corrections', term, CASE WHEN n = 1 THEN 'rare' WHEN n > 0.01 * (SELECT count(DISTINCT query_id) FROM o) THEN 'common' END FROM c)
SELECT field, term, mark FROM m WHERE mark IS NOT NULL""")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = table(spark, sf_dir, "documents").select("body").where("body IS NOT NULL")
    offered = _offered(spark, sf_dir)
    body = marked_values(count_values(F.col("body"), bodies), bodies.count(), common_share=0.3).withColumn("field", F.lit("body"))
    forms = marked_values(count_values(F.col("forms"), offered), offered.count(), common_share=0.01).withColumn("field", F.lit("corrections"))
    return body.unionByName(forms).where("mark IS NOT NULL").select("field", "term", "mark")


@query()
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture(table(spark, sf_dir, "documents"), "doc_id", "source", "title", "body")


@query(f"""WITH r AS MATERIALIZED ({_runs("documents", "doc_id", _BOTH, 3)}), n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM r a JOIN r b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT x AS doc_id_a, y AS doc_id_b FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE shared >= 0.6 * (a.n + b.n - shared)""")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(table(spark, sf_dir, "documents"), "doc_id", ["title", "body"], width=3, threshold=0.6)


@query()
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


@query(f"WITH d AS ({_runs('documents', 'doc_id', 'text', 10)}), i AS ({_runs('eval_items', 'item_id', 'text', 10)}) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (run)")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "text", run=10)
    return found.where("run >= 10").select("doc_id", "item_id")


@query()
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = text_quality(table(spark, sf_dir, "documents"), "doc_id", "text", "title")
    return judged.where("kind <> 'prose'").select("doc_id", "kind")


# --- whole results beside the cases ----------------------------------------------


@query(f"""WITH t AS (SELECT doc_id, unnest({_terms(_BOTH)}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT term, count(*) AS df, sum(tf) AS n_t FROM c GROUP BY term),
r AS (SELECT doc_id, sum(tf) AS n_d FROM c GROUP BY doc_id), z AS (SELECT sum(pow(n_d, 0.75)) AS z FROM r)
SELECT doc_id, term, tf::BIGINT AS tf, df::BIGINT AS df, round(greatest(0.0, ln(tf * z / (n_t * pow(n_d, 0.75)))), 6) AS ppmi FROM c JOIN d USING (term) JOIN r USING (doc_id), z""")
def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive_terms(table(spark, sf_dir, "documents"), "doc_id", ["title", "body"]).withColumn("ppmi", F.round("ppmi", 6))


@query()
def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies without the lines that p3_found has, but for those that only copies of a few articles or pages of one day repeat."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "page_id", "source", "body")
    found = excessive_lines(docs, "doc_id", "source", "body", dates=_dates(spark, sf_dir, docs), min_clusters=5, min_dates=2)
    return without_lines(docs, "doc_id", "body", found).select("doc_id", "body")


@query()
def p4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewritten(table(spark, sf_dir, "documents"), "doc_id", ["title", "body"])


@query()
def p6_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_content(table(spark, sf_dir, "documents"), "doc_id", "source", "title", "body")


@query(f"""WITH RECURSIVE r AS MATERIALIZED ({_runs("documents", "doc_id", _BOTH, 5)}), n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM r a JOIN r b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY ALL),
s AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE shared >= 0.8 * (a.n + b.n - shared)), e AS (SELECT x, y FROM s UNION SELECT y, x FROM s),
w(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT w.a, e.y FROM w JOIN e ON w.b = e.x)
SELECT a AS doc_id, min(b) AS "group" FROM w GROUP BY a""")
def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), "doc_id", ["title", "body"])


@query()
def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "text")


@query()
def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(table(spark, sf_dir, "documents"), "doc_id", "text", "title")

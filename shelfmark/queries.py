"""Registered core queries and the SQL that the driver compares them with.

Search queries run over one corpus: documents with their tags and what their
pages say. Its index is written once for each session and data folder.
"""

from __future__ import annotations

from dataclasses import replace
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.coerce import array_of, canonical_json, coerce, invalid
from shelfmark.functions.text import composed, fold_map
from shelfmark.functions.timestamps import published_instants
from shelfmark.operators import profile
from shelfmark.operators.batch import ranked_pages
from shelfmark.operators.boosts import RecencyBoost, ValueBoost
from shelfmark.operators.facets import facet_counts
from shelfmark.operators.filters import Field, Fields, Range
from shelfmark.operators.index import Index, build, open_index, postings_of
from shelfmark.operators.marks import marked
from shelfmark.operators.match import Matcher, compile_tree
from shelfmark.operators.search import Request, Searcher
from shelfmark.operators.suggest import suggest
from shelfmark.operators.variants import term_variants
from shelfmark.plans.lineage import own_dir
from shelfmark.plans.ship import ship
from shelfmark.plans.syntax import emit, parse
from shelfmark.sources.html import canonical_url, extracted
from shelfmark.sources.records import checked_records
from shelfmark.sources.synthetic import dense_ids, synthetic_corpus

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


@query()
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published_instants(table(spark, sf_dir, "site_pages"), table(spark, sf_dir, "sites"))


# --- the corpus -----------------------------------------------------------------

TRUE_SQL = "('true','1','yes','y','on')"
FIELDS = Fields(
    lang=Field("facet"), source=Field("facet"), category=Field("facet"), year=Field("facet", "integer"), featured=Field("facet", "boolean"), crawled=Field("facet", "date"),
    n_chars=Field("facet", "integer"), tags=Field("facet", "string_array"), rating=Field("sort", "number"), image=Field("store"),
)
COLUMNS = {"title": 10.0, "body": 1.0}


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "site_pages").groupBy("page_id").agg(
        F.min("url").alias("url"), F.min("description").alias("description"), F.min(F.lower("category")).alias("category"), F.min("year").cast("long").alias("year"),
        F.max(coerce(F.col("featured"), "boolean")).alias("featured"), F.min("crawled_at").cast("date").alias("crawled"), F.min("rating").alias("rating"), F.min("image").alias("image"),
    )
    tags = table(spark, sf_dir, "facet_tags").where(F.btrim("value") != "").groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_set(F.lower(F.btrim("value")))).alias("tags"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "page_id", "title", "body", "lang", "source", "n_chars")
    return docs.join(pages, "page_id", "left").join(tags, "id", "left").drop("page_id")


K1_SQL = f"""pages AS (SELECT page_id, min(url) AS url, min(description) AS description, min(lower(category)) AS category, min(year)::BIGINT AS year,
 max(CASE WHEN lower(trim(featured)) IN {TRUE_SQL} THEN true WHEN featured IS NULL THEN NULL ELSE false END) AS featured, min(crawled_at)::DATE AS crawled, min(rating) AS rating, min(image) AS image FROM site_pages GROUP BY page_id),
tagged AS (SELECT document_id AS id, list_sort(list_distinct(list(lower(trim(value))))) AS tags FROM facet_tags WHERE trim(value) <> '' GROUP BY 1),
k1 AS (SELECT d.doc_id AS id, d.title, d.body, d.lang, d.source, d.n_chars, p.url, p.description, p.category, p.year, p.featured, p.crawled, p.rating, p.image, t.tags
 FROM documents d LEFT JOIN pages p ON d.page_id = p.page_id LEFT JOIN tagged t ON t.id = d.doc_id)"""


def _toks(text: str) -> str:
    odd, plain = fold_map()
    return f"regexp_extract_all(translate(lower(nfc_normalize({text})), '{odd}', '{plain}'), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"


TOK_SQL = f"""{K1_SQL}, words AS (SELECT id, 0 AS col, {_toks('title')} AS w FROM k1 UNION ALL SELECT id, 1 AS col, {_toks('body')} AS w FROM k1),
tok AS (SELECT id, col, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM words WHERE w IS NOT NULL),
lens AS (SELECT id, count(*)::BIGINT AS n FROM tok GROUP BY id),
size AS (SELECT (SELECT count(*) FROM k1) AS docs, (SELECT count(*) FROM tok) / (SELECT count(*) FROM k1)::DOUBLE AS mean)"""
_OPEN: dict[tuple[str, str], Index] = {}


def index_of(spark: SparkSession, sf_dir: str) -> Index:
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _OPEN:
        path = f"{own_dir(spark)}/index-{abs(hash(at))}"
        build(corpus(spark, sf_dir), COLUMNS, path)
        _OPEN[at] = open_index(spark, path)
    return _OPEN[at]


def searcher(spark: SparkSession, sf_dir: str, boosts=(), variants: DataFrame | None = None, **changes) -> Searcher:
    index = index_of(spark, sf_dir)
    index = replace(index, variants=variants, **changes)
    return Searcher(index, FIELDS, boosts)


# --- index ----------------------------------------------------------------------


@query(f"WITH {TOK_SQL} SELECT id, count(*)::BIGINT AS n_tokens, count(DISTINCT term)::BIGINT AS n_terms FROM tok GROUP BY id")
def tokenize_counts(spark, sf_dir):
    words = postings_of(composed(corpus(spark, sf_dir), list(COLUMNS)), list(COLUMNS))
    return words.groupBy("id").agg(F.sum(F.size("positions")).alias("n_tokens"), F.countDistinct("term").alias("n_terms"))


@query(f"WITH {TOK_SQL} SELECT term, count(DISTINCT id)::BIGINT AS doc, count(*)::BIGINT AS cnt FROM tok GROUP BY term")
def vocab_stats(spark, sf_dir):
    return index_of(spark, sf_dir).vocabulary.select("term", "doc", "cnt")


@query(f"WITH {TOK_SQL} SELECT col, count(DISTINCT term)::BIGINT AS terms, count(DISTINCT term || chr(1) || id::VARCHAR)::BIGINT AS postings, count(*)::BIGINT AS occurrences FROM tok GROUP BY col")
def column_stats(spark, sf_dir):
    return profile.index_columns(index_of(spark, sf_dir).postings)


@query(f"WITH {TOK_SQL} SELECT k1.id, coalesce(lens.n, 0)::BIGINT AS n FROM k1 LEFT JOIN lens USING (id)")
def document_lengths(spark, sf_dir):
    return index_of(spark, sf_dir).lengths.select("id", "n")


@query("SELECT document_id AS id, list_sort(list_distinct(list(lower(trim(value))))) AS tags FROM facet_tags WHERE trim(value) <> '' GROUP BY 1")
def facet_table(spark, sf_dir):
    return index_of(spark, sf_dir).documents.where("tags IS NOT NULL").select("id", "tags")


# --- matching -------------------------------------------------------------------


def _match(name: str, text: str, where: str, typing: bool = False):
    def run(spark, sf_dir):
        index = index_of(spark, sf_dir)
        tree = compile_tree(parse(text, tuple(index.columns), typing), list(index.columns))
        matcher = Matcher(index, [tree])
        return matcher.measured().where(matcher.flag(tree)).select("id")

    run.__name__ = name
    query(f"WITH {TOK_SQL} SELECT DISTINCT id FROM tok AS a WHERE {where}")(run)


def _has(term: str, extra: str = "") -> str:
    return f"EXISTS (SELECT 1 FROM tok b WHERE b.id = a.id AND b.term = '{term}'{extra})"


def _run(first: str, *rest: str) -> str:
    joins = " ".join(f"JOIN tok r{k} ON r{k}.id = r.id AND r{k}.col = r.col AND r{k}.pos = r.pos + {k} AND r{k}.term {t}" for k, t in enumerate(rest, 1))
    return f"a.id IN (SELECT r.id FROM tok r {joins} WHERE r.term {first})"


def _near(x: str, y: str, distance: int) -> str:
    return f"a.id IN (SELECT r.id FROM tok r JOIN tok s ON s.id = r.id AND s.col = r.col AND abs(s.pos - r.pos) <= {distance + 1} WHERE r.term = '{x}' AND s.term = '{y}')"


_match("match_term", "amber", "a.term = 'amber'")
_match("match_prefix", "lime", "starts_with(a.term, 'lime')", typing=True)
_match("match_and", "amber cellar", f"{_has('amber')} AND {_has('cellar')}")
_match("match_or", "amber OR cellar", f"{_has('amber')} OR {_has('cellar')}")
_match("match_not", "amber -cellar", f"{_has('amber')} AND NOT {_has('cellar')}")
_match("match_scoped", "title:amber", _has("amber", " AND b.col = 0"))
_match("match_group", "(amber OR jasper) cellar -granite", f"({_has('amber')} OR {_has('jasper')}) AND {_has('cellar')} AND NOT {_has('granite')}")
_match("match_phrase", '"lay beside the"', _run("= 'lay'", "= 'beside'", "= 'the'"))
_match("match_near", "near(amber cellar, 5)", _near("amber", "cellar", 5))
_match("match_identifier", "VH 5", f"starts_with(a.term, 'vh5') OR {_run('LIKE $$vh%$$', 'LIKE $$5%$$')}", typing=True)
_match("match_degraded", '"amber cellar', f"{_has('amber')} AND {_has('cellar')}")


@query("SELECT query_id, q, fts FROM query_vectors")
def query_emit(spark, sf_dir):
    """Every row in the table's own form: a word with a hyphen is one, a corrected word does not go on."""
    return expressions(table(spark, sf_dir, "query_vectors"), hyphenated=True, grow_corrected=False)


@query()
def query_emit_all(spark, sf_dir):
    """Every row in the form of the index, which the table does not have, so there is no SQL."""
    return expressions(table(spark, sf_dir, "query_vectors"))


def expressions(rows: DataFrame, hyphenated: bool = False, grow_corrected: bool = True) -> DataFrame:
    """(query_id, q, fts) of ``rows`` (query_id, q, corrections); forms offered for a word that is no term of its query are not used."""

    def read(batches):
        for batch in batches:
            texts, offered = batch.column("q").to_pylist(), batch.column("corrections").to_pylist()
            found = []
            for q, pairs in zip(texts, offered):
                tree = parse(q, hyphenated=hyphenated) if q is not None else None
                forms = {word: [f for f in given or [] if f is not None] for word, given in pairs or []}
                found.append(emit(tree, correct=forms.get, grow_corrected=grow_corrected) if tree else None)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("q"), pa.array(found, pa.string())], ["query_id", "q", "fts"])

    return rows.select("query_id", "q", "corrections").mapInArrow(read, "query_id long, q string, fts string")


# --- ranking --------------------------------------------------------------------


def _bm25(terms: dict[str, str], title: float = 10.0, body: float = 1.0) -> str:
    """CTEs ``per`` (id, f_<name>) and ``score`` for conditions on ``term``."""
    fs = ", ".join(f"sum(CASE WHEN {c} THEN CASE col WHEN 0 THEN {title} ELSE {body} END ELSE 0 END) AS f_{n}" for n, c in terms.items())
    idf = ", ".join(f"(SELECT CASE WHEN v > 0 THEN v ELSE 1e-6 END FROM (SELECT ln(((SELECT docs FROM size) - count(*) + 0.5) / (count(*) + 0.5)) AS v FROM per WHERE f_{n} > 0)) AS i_{n}" for n in terms)
    return f"per AS (SELECT id, {fs} FROM tok GROUP BY id), idf AS (SELECT {idf})"


def _part(n: str) -> str:
    return f"i_{n} * (f_{n} * 2.2) / (f_{n} + 1.2 * (0.25 + 0.75 * lens.n / size.mean))"


_AMBER = {"a": "term = 'amber'", "c": "term = 'cellar'"}
_PROX = f"CASE WHEN {_run('= $$amber$$', '= $$cellar$$')} THEN 0 WHEN {_near('amber', 'cellar', 8)} THEN 1 ELSE 2 END"


def _page(found: DataFrame, *more: str) -> DataFrame:
    return found.select("id", "band", "proximity", (F.round("score", 6) + 0.0).alias("score"), *more)


def _placed(select: str, order: str, limit: int, offset: int = 0) -> str:
    """``select`` with its rows numbered from 0 in an order, and one page of them; ``rank`` is not shown."""
    return f"SELECT * EXCLUDE (rank) FROM (SELECT *, (row_number() OVER (ORDER BY {order}) - 1)::INTEGER AS place FROM ({select})) WHERE place >= {offset} AND place < {offset + limit}"


_BOTH = f"SELECT a.id, 0 AS band, {_PROX} AS proximity, round(-({_part('a')} + {_part('c')}), 6) AS score, -({_part('a')} + {_part('c')}) AS rank FROM per a JOIN lens USING (id), idf, size WHERE f_a > 0 AND f_c > 0"


@query(f"WITH {TOK_SQL}, {_bm25(_AMBER)} " + _placed(_BOTH, "band, proximity, rank, id", 20))
def search_bm25_top(spark, sf_dir):
    return _page(searcher(spark, sf_dir).hits(Request("amber cellar", typing=False)), "place")


@query(f"WITH {TOK_SQL}, {_bm25(_AMBER, 2.0, 5.0)} " + _placed(_BOTH, "band, proximity, rank, id", 20))
def search_weighted_columns(spark, sf_dir):
    return _page(searcher(spark, sf_dir, columns={"title": 2.0, "body": 5.0}).hits(Request("amber cellar", typing=False)), "place")


@query(f"WITH {TOK_SQL}, {_bm25({'p': 'starts_with(term, $$lime$$)'})} SELECT id, round(-({_part('p')}), 6) AS score FROM per JOIN lens USING (id), idf, size WHERE f_p > 0")
def search_prefix_scores(spark, sf_dir):
    s = searcher(spark, sf_dir)
    return s.matches(s.plan("lime")).select("id", (F.round("score", 6) + 0.0).alias("score"))


@query(f"WITH {TOK_SQL}, {_bm25({'t': 'term = $$amber$$ AND col = 0', 'b': 'term = $$cellar$$ AND col = 1'})} SELECT id, round(-((CASE WHEN f_t > 0 THEN {_part('t')} ELSE 0 END) + (CASE WHEN f_b > 0 THEN {_part('b')} ELSE 0 END)), 6) AS score FROM per JOIN lens USING (id), idf, size WHERE f_t > 0 OR f_b > 0")
def search_scoped_scores(spark, sf_dir):
    s = searcher(spark, sf_dir)
    return s.matches(s.plan("title:amber OR body:cellar", typing=False)).select("id", (F.round("score", 6) + 0.0).alias("score"))


@query(f"WITH {TOK_SQL}, {_bm25({'a': 'term = $$amber$$', 'c': 'term = $$cellar$$', 'g': 'term = $$granite$$'})} SELECT id, round(-((CASE WHEN f_a > 0 AND f_c > 0 THEN {_part('a')} + {_part('c')} ELSE 0 END) + (CASE WHEN f_g > 0 THEN {_part('g')} ELSE 0 END)), 6) AS score FROM per JOIN lens USING (id), idf, size WHERE f_a > 0 AND f_c > 0 OR f_g > 0")
def search_gated_scores(spark, sf_dir):
    s = searcher(spark, sf_dir)
    return s.matches(s.plan("granite OR (amber cellar)", typing=False)).select("id", (F.round("score", 6) + 0.0).alias("score"))


_UNPLACED = " + ".join(f"(CASE WHEN max(CASE WHEN {c} AND col = {k} THEN 1 ELSE 0 END) = 1 THEN i_{n} * {w} ELSE 0 END)" for n, c in _AMBER.items() for k, w in ((0, 10.0), (1, 1.0)))


@query(f"WITH {TOK_SQL}, {_bm25(_AMBER)} SELECT id, round(-({_UNPLACED}), 6) AS score FROM tok, idf GROUP BY id, i_a, i_c HAVING bool_or(term = 'amber') AND bool_or(term = 'cellar')")
def search_positionless(spark, sf_dir):
    s = searcher(spark, sf_dir, positions=False)
    return s.matches(s.plan("amber cellar", typing=False)).select("id", (F.round("score", 6) + 0.0).alias("score"))


_WIDE = {"a": "term = 'amber'", "w": "term = 'beeswax'", "c": "term = 'cellar'"}
_OPT = lambda n: f"(CASE WHEN f_{n} > 0 THEN {_part(n)} ELSE 0 END)"


@query(f"WITH {TOK_SQL}, {_bm25(_WIDE)} SELECT a.id, CASE WHEN f_a > 0 THEN 0 ELSE 1 END AS band, {_PROX} AS proximity, round(-({_OPT('a')} + {_OPT('w')} + {_part('c')}), 6) AS score FROM per a JOIN lens USING (id), idf, size WHERE (f_a > 0 OR f_w > 0) AND f_c > 0")
def search_bands_variants(spark, sf_dir):
    variants = spark.createDataFrame([("amber", ["beeswax"]), ("beeswax", ["amber"])], "term string, variants array<string>")
    s = searcher(spark, sf_dir, variants=variants)
    return _page(s.matches(s.plan("amber cellar", typing=False)))


def _corrections(word: str, most: int, limit: int, least: int = 2, stem: str = "", dominance: float = 0.01) -> str:
    starts = f" AND starts_with(term, '{stem}')" if stem else ""
    return f"""voc AS (SELECT term, count(DISTINCT id)::BIGINT AS doc FROM tok GROUP BY term),
near AS (SELECT term, doc, damerau_levenshtein(term, '{word}')::INTEGER AS distance FROM voc WHERE doc >= {least} AND term <> '{word}'{starts} AND length(term) BETWEEN {len(word) - most} AND {len(word) + most}),
forms AS (SELECT term, doc, distance FROM near WHERE distance <= {most} AND doc >= {dominance} * (SELECT max(doc) FROM near WHERE distance <= {most}) ORDER BY distance, doc DESC, term LIMIT {limit})"""


@query(f"WITH {TOK_SQL}, {_corrections('limestome', 2, 3)} SELECT DISTINCT id, 2 AS band FROM tok WHERE term IN (SELECT term FROM forms)")
def search_bands_corrections(spark, sf_dir):
    s = searcher(spark, sf_dir)
    return s.matches(s.plan("limestome", typing=False)).select("id", "band")


@query(f"WITH {TOK_SQL}, {_corrections('amber', 1, 50, 1, 'am', 0)} SELECT id, min(CASE WHEN term = 'amber' THEN 0 ELSE 2 END) AS band FROM tok WHERE term = 'amber' OR term IN (SELECT term FROM forms) GROUP BY id")
def search_fuzzy(spark, sf_dir):
    s = searcher(spark, sf_dir)
    return s.matches(s.plan("amber", fuzzy=True, typing=False)).select("id", "band")


@query(f"WITH {TOK_SQL} SELECT DISTINCT a.id, {_PROX} AS proximity FROM tok a WHERE {_has('amber')} AND {_has('cellar')}")
def search_proximity(spark, sf_dir):
    s = searcher(spark, sf_dir)
    return s.matches(s.plan("amber cellar", typing=False)).select("id", "proximity")


def flagship(spark, sf_dir):
    """The best documents for any of three materials."""
    return _page(searcher(spark, sf_dir).hits(Request("amber OR copper OR limestone", typing=False)))


def _boosted(factor: str) -> str:
    rank = f"-({_part('a')}) * {factor}"
    return f"WITH {TOK_SQL}, {_bm25({'a': _AMBER['a']})} " + _placed(f"SELECT k1.id, round(-({_part('a')}), 6) AS score, {rank} AS rank FROM per JOIN lens USING (id) JOIN k1 USING (id), idf, size WHERE f_a > 0", "rank, id", 30)


@query(_boosted("(CASE lang WHEN 'de' THEN 8.0 WHEN 'fr' THEN 3.0 ELSE 1.0 END)"))
def search_boost_values(spark, sf_dir):
    s = searcher(spark, sf_dir, (ValueBoost("lang", (("de", 8.0), ("fr", 3.0))),))
    return _page(s.hits(Request("amber", typing=False, limit=30)), "place").select("id", "score", "place")


@query(_boosted("coalesce(1.0 + 2.0 * pow(2.0, -greatest(0, date_diff('day', crawled, DATE '2025-06-30')) / 90.0), 1.0)"))
def search_boost_recency(spark, sf_dir):
    s = searcher(spark, sf_dir, (RecencyBoost("crawled", "2025-06-30", 3.0, 90.0),))
    return _page(s.hits(Request("amber", typing=False, limit=30)), "place").select("id", "score", "place")


@query(f"WITH {TOK_SQL} SELECT count(DISTINCT id)::BIGINT AS total FROM tok JOIN k1 USING (id) WHERE term = 'amber' AND lang = 'en' AND n_chars >= 500")
def search_total(spark, sf_dir):
    return searcher(spark, sf_dir).total(Request("amber", {"lang": "en", "n_chars": Range(min=500)}, typing=False))


@query()
def search_marks(spark, sf_dir):
    s = searcher(spark, sf_dir)
    forms = s.mark_forms(s.plan("amber cellar"))
    return s.hits(Request("amber cellar")).select("id", marked(F.col("title"), forms).alias("title_marks"), marked(F.col("description"), forms).alias("description_marks"))


# --- facets and filters ---------------------------------------------------------


def _counts(ord_: int, facet: str, value: str, source: str, where: str = "true") -> str:
    return f"SELECT {ord_} AS ord, '{facet}' AS facet, {value} AS value, count(*)::BIGINT AS n FROM {source} WHERE {where} AND {value} IS NOT NULL GROUP BY 3"


@query(f"WITH {K1_SQL} " + " UNION ALL ".join([_counts(0, "lang", "lang", "k1"), _counts(1, "category", "category", "k1"), _counts(2, "year", "year::VARCHAR", "k1"), _counts(3, "featured", "featured::INTEGER::VARCHAR", "k1"), _counts(4, "crawled", "crawled::VARCHAR", "k1")]))
def facets_browse(spark, sf_dir):
    return searcher(spark, sf_dir).facets(Request(facets=["lang", "category", "year", "featured", "crawled"]))


@query(f"WITH {TOK_SQL}, hit AS (SELECT * FROM k1 WHERE id IN (SELECT id FROM tok WHERE term = 'amber')) " + " UNION ALL ".join([_counts(0, "lang", "lang", "hit"), _counts(1, "source", "source", "hit")]))
def facets_keyword(spark, sf_dir):
    return searcher(spark, sf_dir).facets(Request("amber", facets=["lang", "source"], typing=False))


_F = {"lang": "coalesce(lang IN ('en','de'), false)", "category": "coalesce(category = 'object', false)", "tags": "coalesce(list_has_any(tags, ['pottery','trade']), false)"}
_BUT = lambda n: " AND ".join(c for k, c in _F.items() if k != n)


@query(f"WITH {TOK_SQL}, hit AS (SELECT * FROM k1 WHERE id IN (SELECT id FROM tok WHERE term = 'amber')), flat AS (SELECT * EXCLUDE (tags), tags, unnest(tags) AS tag FROM hit) " + " UNION ALL ".join([_counts(0, "lang", "lang", "hit", _BUT("lang")), _counts(1, "category", "category", "hit", _BUT("category")), _counts(2, "source", "source", "hit", _BUT("")), _counts(3, "tags", "tag", "flat", _BUT("tags"))]))
def facets_disjunctive(spark, sf_dir):
    filters = {"lang": ["en", "de"], "category": "object", "tags": ["pottery", "trade"]}
    return searcher(spark, sf_dir).facets(Request("amber", filters, ["lang", "category", "source", "tags"], typing=False))


@query(f"WITH {K1_SQL}, flat AS (SELECT unnest(tags) AS tag FROM k1) {_counts(0, 'tags', 'tag', 'flat')}")
def facets_array(spark, sf_dir):
    return searcher(spark, sf_dir).facets(Request(facets=["tags"]))


@query(f"WITH {K1_SQL} " + _counts(0, "lang", "lang", "k1", "false") + " UNION ALL SELECT 0, 'lang', NULL, 0 UNION ALL SELECT 1, 'category', NULL, 0 UNION ALL " + _counts(1, "category", "category", "k1", "false"))
def facets_of_nothing(spark, sf_dir):
    """Facets without a value are named all the same."""
    rows = searcher(spark, sf_dir).found(Request(filters={"year": []}))
    return facet_counts(rows, FIELDS, ["lang", "category"], named=True)


def _filter(name: str, filters: dict, where: str):
    def run(spark, sf_dir):
        return searcher(spark, sf_dir).found(Request(filters=filters)).select("id")

    run.__name__ = name
    query(f"WITH {K1_SQL} SELECT id FROM k1 WHERE {where}")(run)


_filter("filter_eq", {"lang": "de"}, "lang = 'de'")
_filter("filter_in", {"category": ["site", "media"]}, "category IN ('site','media')")
_filter("filter_range", {"year": Range(1950, 2000), "n_chars": Range(min=200)}, "year BETWEEN 1950 AND 2000 AND n_chars >= 200")
_filter("filter_array", {"tags": ["pottery", "loan"]}, "list_has_any(tags, ['pottery','loan'])")
_filter("filter_boolean", {"featured": True}, "featured")
_filter("filter_empty", {"lang": []}, "false")


@query(f"WITH {K1_SQL} " + _placed("SELECT id, title, translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS rank FROM k1", "rank ASC NULLS FIRST, id", 200))
def sort_title_nocase(spark, sf_dir):
    return searcher(spark, sf_dir).hits(Request(sort="title", limit=200)).select("id", "title", "place")


@query(f"WITH {K1_SQL} " + _placed("SELECT id, rating, rating AS rank FROM k1", "rank DESC NULLS LAST, id", 100, 50))
def sort_desc_nulls(spark, sf_dir):
    return searcher(spark, sf_dir).hits(Request(sort="rating", descending=True, limit=100, offset=50)).select("id", "rating", "place")


@query(f"WITH {K1_SQL} " + _placed("SELECT id, title, url, id AS rank FROM k1", "rank", 20, 40))
def page_offset(spark, sf_dir):
    return searcher(spark, sf_dir).hits(Request(limit=20, offset=40)).select("id", "title", "url", "place")


@query("SELECT true AS buckets_sum_to_total, true AS filter_equals_bucket, true AS own_facet_unfiltered")
def facet_integrity(spark, sf_dir):
    s = searcher(spark, sf_dir)
    free = s.facets(Request("amber", facets=["lang"], typing=False))
    own = s.facets(Request("amber", {"lang": "en"}, ["lang"], typing=False))
    rows, _ = s.rows(Request("amber", typing=False))
    left = free.agg(F.sum("n").alias("s"), F.sum(F.when(F.col("value") == "en", F.col("n"))).alias("en"), F.bit_xor(F.xxhash64("value", "n")).alias("h")).withColumn("k", F.lit(1))
    right = own.agg(F.bit_xor(F.xxhash64("value", "n")).alias("h2")).withColumn("k", F.lit(1))
    total = rows.agg(F.count("lang").alias("t"), F.count_if(F.col("lang") == "en").alias("e")).withColumn("k", F.lit(1))
    return left.join(right, "k").join(total, "k").select((F.col("s") == F.col("t")).alias("buckets_sum_to_total"), (F.col("en") == F.col("e")).alias("filter_equals_bucket"), (F.col("h") == F.col("h2")).alias("own_facet_unfiltered"))


# --- many queries at once, probes -------------------------------------------------


@query(f"""WITH {TOK_SQL}, asked AS (SELECT DISTINCT query_id, unnest({_toks('q')}) AS term FROM query_vectors WHERE q IS NOT NULL), parts AS (SELECT query_id, count(*) AS k FROM asked GROUP BY 1),
df AS (SELECT term, ln(((SELECT docs FROM size) - count(DISTINCT id) + 0.5) / (count(DISTINCT id) + 0.5)) AS v FROM tok GROUP BY term),
f AS (SELECT query_id, id, term, sum(CASE col WHEN 0 THEN 10.0 ELSE 1.0 END) AS f FROM asked JOIN tok USING (term) GROUP BY ALL),
s AS (SELECT query_id, id, count(*) AS held, round(-sum(CASE WHEN v > 0 THEN v ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * lens.n / size.mean))), 9) AS score FROM f JOIN df USING (term) JOIN lens USING (id), size GROUP BY 1, 2)
SELECT query_id, id, (row_number() OVER (PARTITION BY query_id ORDER BY score, id) - 1)::INTEGER AS place, round(score, 6) AS score FROM s JOIN parts USING (query_id) WHERE held = k QUALIFY place < 10""")
def batch_pages(spark, sf_dir):
    """The best ten documents of every query of the table."""
    return ranked_pages(index_of(spark, sf_dir), table(spark, sf_dir, "query_vectors"), "query_id", "q").withColumn("score", F.round("score", 6) + 0.0)


_PROBES = {"point": "beeswax", "selective": "amethyst", "moderate": "cellar", "broad": "the"}


@query(f"WITH {TOK_SQL} SELECT 'empty' AS probe, count(*)::BIGINT AS n FROM k1 UNION ALL SELECT 'unknown', 0 UNION ALL " + " UNION ALL ".join(f"SELECT '{p}', count(DISTINCT id)::BIGINT FROM tok WHERE term = '{w}'" for p, w in _PROBES.items())
       + " UNION ALL SELECT 'filtered', count(DISTINCT id)::BIGINT FROM tok JOIN k1 USING (id) WHERE term = 'cellar' AND category = 'object' AND year BETWEEN 1950 AND 2024 UNION ALL SELECT 'facet', count(DISTINCT category)::BIGINT FROM k1 UNION ALL SELECT 'array', count(*)::BIGINT FROM k1 WHERE list_has_any(tags, ['pottery'])")
def probes(spark, sf_dir):
    """Nine shapes of request, each with the number of its hits."""
    s = searcher(spark, sf_dir)
    asked = {"empty": Request(), "unknown": Request("zzzzqx", typing=False)} | {p: Request(w, typing=False) for p, w in _PROBES.items()}
    asked |= {"filtered": Request("cellar", {"category": "object", "year": Range(1950, 2024)}, typing=False), "array": Request(filters={"tags": ["pottery"]})}
    parts = [s.total(r).select(F.lit(p).alias("probe"), F.col("total").alias("n")) for p, r in asked.items()]
    parts.append(s.facets(Request(facets=["category"])).agg(F.count("*").alias("n")).select(F.lit("facet").alias("probe"), "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


DIMENSIONS = {"benchmark_group": ("group", 8), "kind": ("kind", 4), "topic": ("topic", 12)}  # fixed values: names and sizes of the bench's facets


@query("WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS i FROM documents) " + " UNION ALL ".join(f"SELECT '{n}' AS dimension, '{p}' || ((i - 1) % {k})::VARCHAR AS value, count(*)::BIGINT AS n FROM d GROUP BY 2" for n, (p, k) in DIMENSIONS.items()))
def bench_dimensions(spark, sf_dir):
    """Documents numbered, with facets of known sizes by their numbers."""
    return bench_corpus(table(spark, sf_dir, "documents")).select(F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).alias("value")) for n in DIMENSIONS])).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def bench_corpus(docs: DataFrame) -> DataFrame:
    """(id, url, title, body, benchmark_group, kind, topic) of ``docs``, for a bench of facets of different sizes."""
    numbered = dense_ids(docs.select("doc_id", "title", "body"), ["doc_id"])
    dims = [F.concat(F.lit(p), ((F.col("id") - 1) % k).cast("string")).alias(n) for n, (p, k) in DIMENSIONS.items()]
    return numbered.select(F.format_string("doc-%06d", "id").alias("id"), F.concat(F.lit("/"), F.col("doc_id").cast("string"), F.lit("/")).alias("url"), "title", "body", *dims)


@query("SELECT 'amber' AS term, 'elektron' AS other UNION ALL SELECT 'elektron', 'amber' UNION ALL SELECT 'beeswax', 'cera' UNION ALL SELECT 'cera', 'beeswax'")
def variants_declared(spark, sf_dir):
    """Synonyms stand also for words that no document holds; a suppressed pair does not."""
    groups = term_variants(index_of(spark, sf_dir).vocabulary, [["amber", "elektron"], ["beeswax", "cera", "wax"]], [["beeswax", "wax"], ["wax", "cera"]], generated=False)
    return groups.select("term", F.explode("variants").alias("other"))


# --- suggestions ----------------------------------------------------------------


@query(f"WITH {TOK_SQL}, {_corrections('limestome', 2, 10)} SELECT term, doc, distance FROM forms")
def suggest_correction(spark, sf_dir):
    return suggest(searcher(spark, sf_dir), "limestome", "correction")


@query(f"WITH {TOK_SQL}, voc AS (SELECT term, count(DISTINCT id)::BIGINT AS doc FROM tok GROUP BY term) SELECT term, doc, (length(term) - 2)::INTEGER AS distance FROM voc WHERE starts_with(term, 'ca') AND term <> 'ca' ORDER BY doc DESC, term LIMIT 10")
def suggest_completion(spark, sf_dir):
    return suggest(searcher(spark, sf_dir), "ca")


@query(f"""WITH {TOK_SQL}, voc AS (SELECT term, count(DISTINCT id)::BIGINT AS doc FROM tok GROUP BY term), pool AS (SELECT term, doc FROM voc WHERE starts_with(term, 'ce') AND term <> 'ce' ORDER BY doc DESC, term LIMIT 50)
SELECT term, count(DISTINCT tok.id)::BIGINT AS doc, (length(term) - 2)::INTEGER AS distance FROM tok JOIN k1 USING (id) WHERE term IN (SELECT term FROM pool) AND lang = 'en' AND tok.id IN (SELECT id FROM tok WHERE term = 'amber') GROUP BY term ORDER BY 2 DESC, 1 LIMIT 10""")
def suggest_context(spark, sf_dir):
    return suggest(searcher(spark, sf_dir), "ce", context="amber", filters={"lang": "en"})


@query()
def variants_groups(spark, sf_dir):
    return term_variants(index_of(spark, sf_dir).vocabulary, [["amber", "jasper"]], [["statue", "statues"]])


# --- sources, typing, profiles --------------------------------------------------

_BOOL = "CASE WHEN lower(trim(featured)) IN ('true','1','yes','y','on') THEN true WHEN lower(trim(featured)) IN ('false','0','no','n','off') THEN false END"


@query(f"SELECT page_id, {_BOOL} AS featured, try_cast(CASE WHEN regexp_full_match(trim(published, ' ' || chr(9)), '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN trim(published, ' ' || chr(9)) END AS DATE) AS on_day, try_cast(CASE WHEN regexp_full_match(trim(published, ' ' || chr(9)), '[-+]?\\d+') THEN trim(published, ' ' || chr(9)) END AS BIGINT) AS whole FROM site_pages")
def coerce_types(spark, sf_dir):
    pages = table(spark, sf_dir, "site_pages")
    return pages.select("page_id", coerce(F.col("featured"), "boolean").alias("featured"), coerce(F.col("published"), "date").alias("on_day"), coerce(F.col("published"), "integer").alias("whole"))


@query("SELECT page_id, list_sort(list_distinct(list_filter(list_transform(string_split(tags, ','), lambda x: trim(x)), lambda x: x <> ''))) AS tags FROM site_pages")
def array_normalize(spark, sf_dir):
    return table(spark, sf_dir, "site_pages").select("page_id", array_of(F.col("tags")).alias("tags"))


@query("SELECT event_id, replace(props, ' ', '') AS props FROM events")
def json_store(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", canonical_json(F.col("props")).alias("props"))


@query("SELECT page_id, 'https://museum.example/' || source || '/' || page_id::VARCHAR || '/' AS url FROM site_pages")
def canonical_urls(spark, sf_dir):
    """Of every page; one without source has no address."""
    path = F.concat("source", F.lit("/"), F.col("page_id").cast("string"), F.lit("/index.html"))
    return table(spark, sf_dir, "site_pages").select("page_id", canonical_url("https://museum.example", path).alias("url"))


_SPACE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query(f"SELECT DISTINCT page_id, coalesce({_SPACE.format('description')}, '') AS description, coalesce(category, '') AS category, coalesce(url, '') AS link FROM site_pages")
def extract_pages(spark, sf_dir):
    """Pages made of the table's fields, read back by selectors."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    html = F.concat(F.lit('<html data-category="'), esc("category"), F.lit('"><head><title>x</title><script>var a;</script></head><body><nav hidden>Menu</nav><main><p class="lead">'), esc("description"), F.lit('<p>more</p></main><a rel="canonical" href="'), esc("url"), F.lit('">here</a></body></html>'))
    pages = table(spark, sf_dir, "site_pages").select("page_id", html.alias("html"))
    read = extracted(pages, "html", {"lead": "main p.lead", "link": "a[rel='canonical']@href"}, {"category": "data-category"})
    first = lambda c: F.coalesce(F.get(F.col(c), F.lit(0)), F.lit(""))
    return read.select("page_id", F.btrim(F.regexp_replace(first("lead"), r"\s+", " ")).alias("description"), first("category").alias("category"), first("link").alias("link")).distinct()


@query("SELECT count(*)::BIGINT AS n, 0::BIGINT AS bad FROM documents")
def records_checked(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.to_json(F.struct(F.col("doc_id").alias("id"), F.concat(F.lit("/d/"), F.col("doc_id")).alias("url"), F.struct("title", "body").alias("fields"), F.struct("lang").alias("facets"))).alias("raw"))
    return checked_records(lines, {"fields": ["title", "body"], "facets": ["lang"]}, Fields(lang=Field("facet"))).agg(F.count("*").alias("n"), F.count("problem").alias("bad"))


@query("""SELECT CASE doc_id % 5 WHEN 1 THEN 'record id must be a non-empty string or an integer' WHEN 2 THEN 'record fields.title must be a string' WHEN 3 THEN 'record url must be a non-empty string'
 WHEN 4 THEN 'record lang must be a single value' END AS problem, count(*)::BIGINT AS n FROM documents GROUP BY 1""")
def records_refused(spark, sf_dir):
    """Every document as a record, four of five with a fault of one kind."""
    docs = table(spark, sf_dir, "documents")

    def line(id_="doc_id", url=F.lit("/d/"), title="title", lang="lang"):
        fields, facets = F.struct(F.expr(title).alias("title"), "body"), F.struct(F.expr(lang).alias("lang"))
        return F.to_json(F.struct(F.expr(id_).alias("id"), url.alias("url"), fields.alias("fields"), facets.alias("facets")))

    fault = F.col("doc_id") % 5
    raw = F.when(fault == 1, line("doc_id + 0.5D")).when(fault == 2, line(title="doc_id")).when(fault == 3, line(url=F.lit(" "))).when(fault == 4, line(lang="array('en', lang)")).otherwise(line())
    checked = checked_records(docs.select(raw.alias("raw")), {"fields": ["title", "body"], "facets": ["lang"]}, Fields(lang=Field("facet")))
    return checked.groupBy("problem").agg(F.count("*").alias("n"))


@query("SELECT row_number() OVER (ORDER BY url, page_id, crawled_at, ingested_at) AS id, url FROM site_pages")
def dense_numbers(spark, sf_dir):
    return dense_ids(table(spark, sf_dir, "site_pages").select("url", "page_id", "crawled_at", "ingested_at"), ["url", "page_id", "crawled_at", "ingested_at"]).select("id", "url")


def _payload(columns) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS field, sum(strlen(coalesce({c}::VARCHAR, '')))::BIGINT AS bytes, round(sum(strlen(coalesce({c}::VARCHAR, ''))) / count(*)::DOUBLE, 6) AS mean, count(DISTINCT {c})::BIGINT AS distinct_values FROM site_pages" for c in columns)


@query(_payload(["url", "description", "category", "image", "tags"]))
def payload_columns(spark, sf_dir):
    found = profile.payload(table(spark, sf_dir, "site_pages"), ["url", "description", "category", "image", "tags"])
    return found.select("field", "bytes", F.round("mean", 6).alias("mean"), "distinct_values")


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count(DISTINCT {c})::BIGINT AS distinct_values FROM site_pages HAVING count(DISTINCT {c}) > 1000" for c in ("url", "description", "category", "catalog")))
def high_cardinality(spark, sf_dir):
    return profile.high_cardinality(table(spark, sf_dir, "site_pages"), ["url", "description", "category", "catalog"])


@query("SELECT 'category' AS a, 'shape' AS b, count(*)::BIGINT AS same, count(*)::BIGINT AS rows FROM site_pages")
def dup_columns(spark, sf_dir):
    pages = table(spark, sf_dir, "site_pages").select("category", F.col("category").alias("shape"), "source")
    return profile.alike_columns(pages, ["category", "shape", "source"])


# the same over the whole table

PAGE_COLUMNS = ["page_id", "source", "url", "description", "category", "year", "rating", "featured", "published", "tags", "image", "catalog", "crawled_at", "ingested_at"]
_TWINS = [*PAGE_COLUMNS, "shape"]


@query(_payload(PAGE_COLUMNS))
def payload_all_columns(spark, sf_dir):
    found = profile.payload(table(spark, sf_dir, "site_pages"), PAGE_COLUMNS)
    return found.select("field", "bytes", F.round("mean", 6).alias("mean"), "distinct_values")


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count(DISTINCT {c})::BIGINT AS distinct_values FROM site_pages HAVING count(DISTINCT {c}) > 1000" for c in PAGE_COLUMNS))
def high_cardinality_all_columns(spark, sf_dir):
    return profile.high_cardinality(table(spark, sf_dir, "site_pages"), PAGE_COLUMNS)


def _same(a: str, b: str) -> str:
    return f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a}::VARCHAR IS NOT DISTINCT FROM {b}::VARCHAR)::BIGINT AS same, count(*) FILTER ({a}::VARCHAR = {b}::VARCHAR) AS held, count(*)::BIGINT AS rows FROM p"


@query("WITH p AS (SELECT *, category AS shape FROM site_pages), x AS (" + " UNION ALL ".join(_same(a, b) for a, b in combinations(_TWINS, 2)) + ") SELECT a, b, same, rows FROM x WHERE same >= rows * 0.9 AND held > 0")
def dup_all_columns(spark, sf_dir):
    return profile.alike_columns(table(spark, sf_dir, "site_pages").withColumn("shape", F.col("category")), _TWINS)


@query(f"SELECT 'FIELD_TYPE' AS code, source, count(*)::BIGINT AS n, list(page_id::VARCHAR ORDER BY page_id, crawled_at)[1:3] AS paths FROM site_pages WHERE published IS NOT NULL AND trim(published, ' ' || chr(9)) <> '' AND NOT (regexp_full_match(trim(published, ' ' || chr(9)), '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND try_cast(trim(published, ' ' || chr(9)) AS DATE) IS NOT NULL) GROUP BY source")
def warnings_agg(spark, sf_dir):
    bad = table(spark, sf_dir, "site_pages").where(invalid(F.col("published"), "date")).withColumn("code", F.lit("FIELD_TYPE"))
    return profile.warnings(bad, ["code", "source"], F.col("page_id").cast("string"), F.struct("page_id", "crawled_at"))


@query(f"WITH w AS (SELECT doc_id AS id, {_toks('body')} AS w FROM documents WHERE body IS NOT NULL), t AS (SELECT id, unnest(w) AS a, generate_subscripts(w, 1) AS p FROM w), g AS (SELECT DISTINCT x.id, x.a || ' ' || y.a AS gram FROM t x JOIN t y ON x.id = y.id AND y.p = x.p + 1 WHERE regexp_full_match(x.a, '[a-z]{{3,}}') AND regexp_full_match(y.a, '[a-z]{{3,}}') AND x.a <> y.a) SELECT gram, count(*)::BIGINT AS df FROM g GROUP BY gram")
def ngram_df(spark, sf_dir):
    return profile.ngrams(composed(table(spark, sf_dir, "documents").where("body IS NOT NULL").select("doc_id", "body"), ["body"]), "doc_id", "body")


_STOP = ", ".join(f"'{w}'" for w in profile.STOP)


@query(f"""WITH d AS (SELECT doc_id AS id, {_toks("concat_ws(' ', title, body)")} AS w FROM documents),
n AS (SELECT id, unnest(w) AS a, generate_subscripts(w, 1) AS p FROM (SELECT id, list_filter(w, lambda x: length(x) >= 4) AS w FROM d)), v AS (SELECT * FROM n WHERE a NOT IN ({_STOP})),
g AS (SELECT x.id, x.a || ' ' || y.a AS gram FROM v x JOIN v y ON x.id = y.id AND y.p = x.p + 1 WHERE x.a <> y.a
 UNION SELECT x.id, x.a || ' ' || y.a || ' ' || z.a FROM v x JOIN v y ON x.id = y.id AND y.p = x.p + 1 JOIN v z ON x.id = z.id AND z.p = x.p + 2 WHERE x.a <> y.a AND y.a <> z.a AND x.a <> z.a)
SELECT gram, count(*)::BIGINT AS df FROM g GROUP BY gram""")
def phrase_df(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "title", "body")
    return profile.phrases(composed(docs, ["title", "body"]), "doc_id", ["title", "body"])


@query(f"WITH {TOK_SQL}, voc AS (SELECT term, count(DISTINCT id)::BIGINT AS doc FROM tok GROUP BY term), g AS (SELECT unnest([1, 10, 100]) AS target) SELECT target, arg_min(term, (abs(doc - target), term)) AS term, arg_min(doc, (abs(doc - target), term)) AS doc FROM voc, g GROUP BY target")
def band_pick(spark, sf_dir):
    return profile.nearest_frequency(index_of(spark, sf_dir).vocabulary, "term", "doc", [1, 10, 100])


@query(f"WITH {TOK_SQL}, voc AS (SELECT term, count(DISTINCT id)::BIGINT AS doc FROM tok GROUP BY term), g AS (SELECT unnest(['am', 'li', 'ca']) AS prefix) SELECT prefix, sum(doc)::BIGINT AS bound FROM voc JOIN g ON starts_with(term, prefix) GROUP BY prefix")
def prefix_expansion(spark, sf_dir):
    return profile.prefix_bound(index_of(spark, sf_dir).vocabulary, ["am", "li", "ca"])


@query("SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS share, unnest([quantile_disc(o_totalprice, 0.5), quantile_disc(o_totalprice, 0.95), quantile_disc(o_totalprice, 0.99)]) AS value FROM orders")
def nearest_rank(spark, sf_dir):
    return profile.nearest_rank(table(spark, sf_dir, "orders"), "o_totalprice", [0.5, 0.95, 0.99])


@query()
def synthetic_pages(spark, sf_dir):
    return synthetic_corpus(spark, 1000)


@query("SELECT i AS cohort, 20::BIGINT AS n FROM range(50) t(i)")
def synthetic_cohorts(spark, sf_dir):
    """How many documents of the synthetic corpus hold the word of each cohort."""
    cohort = F.regexp_extract("body", r"cohort(\d+)", 1).cast("long")
    return synthetic_corpus(spark, 1000).groupBy(cohort.alias("cohort")).agg(F.count("*").alias("n"))


# --- a second corpus: orders ----------------------------------------------------


@query("SELECT 0 AS ord, 'o_orderstatus' AS facet, o_orderstatus AS value, count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice >= 1000 GROUP BY 3 UNION ALL SELECT 1, 'c_mktsegment', c_mktsegment, count(*)::BIGINT FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= 1000 GROUP BY 3")
def facets_orders(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
    fields = Fields(o_orderstatus=Field("facet"), c_mktsegment=Field("facet"), o_totalprice=Field("facet", "number"))
    return facet_counts(rows, fields, ["o_orderstatus", "c_mktsegment"], {"c_mktsegment": "BUILDING", "o_totalprice": Range(min=1000)})

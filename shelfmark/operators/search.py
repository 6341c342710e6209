"""A search: total, page of hits, facet counts, marks, from one plan of matches."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.errors import QueryError
from shelfmark.operators.boosts import product
from shelfmark.operators.facets import facet_counts
from shelfmark.operators.filters import Fields, conditions, together
from shelfmark.operators.index import Index
from shelfmark.operators.match import COLUMN, Leaf, Matcher, Tree, compile_tree, idf_of
from shelfmark.operators.widen import corrections_of, fuzzy_of, variants_of
from shelfmark.plans.syntax import Identifier, Node, Not, Phrase, Term, leaves, parse, proximity, spellings

NOCASE = {"title", "description"}
FETCHED = 1_000  # hits of a page whose ids are sent to the scan of documents


@dataclass
class Request:
    query: str = ""
    filters: Mapping | None = None
    facets: bool | list[str] = False
    sort: str | None = None
    descending: bool = False
    limit: int = 20
    offset: int = 0
    fuzzy: bool = False
    typing: bool = True
    columns: list[str] | None = None  # stored columns of a page; all of them if none are named


@dataclass
class Plan:
    """A query at its three widths, and the forms by which it was widened."""

    node: Node
    exact: Tree
    variant: Tree
    wide: Tree
    nearby: tuple[Tree, Tree] | None
    variants: dict[str, list[str]] = field(default_factory=dict)
    corrections: dict[str, list[str]] = field(default_factory=dict)
    guesses: dict[str, list[str]] = field(default_factory=dict)


@dataclass
class Searcher:
    index: Index
    fields: Fields
    boosts: tuple = ()

    # --- planning ---------------------------------------------------------------

    def plan(self, query: str, fuzzy: bool = False, typing: bool = True) -> Plan | None:
        columns, index = list(self.index.columns), self.index
        node = parse(query.strip(), tuple(columns), typing)
        if node is None:
            return None
        variants = variants_of(index.variants, node)
        corrections = corrections_of(index.vocabulary, node)
        guesses = {w: list(f) for w, f in corrections.items()}
        if fuzzy:
            for word, forms in fuzzy_of(index.vocabulary, node).items():
                guesses[word] = list(dict.fromkeys([*guesses.get(word, []), *forms]))
        build = lambda n, *widen: compile_tree(n, columns, list(widen), index.positions)
        near = proximity(node) if index.positions else None
        return Plan(node, build(node), build(node, variants), build(node, variants, guesses), tuple(build(n) for n in near) if near else None, variants, corrections, guesses)

    def matches(self, plan: Plan, ranked: bool = True) -> DataFrame:
        """(id, band, proximity, score) of every matching document.

        Band 0 holds what the reader typed, 1 what variants reach, 2 guesses.
        Proximity 0 is the words as a phrase, 1 near each other, 2 elsewhere.
        Documents reached without a guess are scored by the query without guesses.
        """
        trees = [plan.exact, plan.variant, plan.wide, *(plan.nearby or ())]
        matcher = Matcher(self.index, trees)
        rows = matcher.measured()
        exact, variant, wide = (matcher.flag(t) for t in trees[:3])
        band = F.when(exact, 0).when(variant, 1).otherwise(2)
        near = F.when(matcher.flag(trees[3]), 0).when(matcher.flag(trees[4]), 1).otherwise(2) if plan.nearby else F.lit(0)
        if not ranked:
            return rows.where(wide).select("id", band.alias("band"), near.alias("proximity"), F.lit(0.0).alias("score"))
        if not self.index.positions:
            names = [f"s{matcher._name(i)}" for i in dict.fromkeys(_positive(plan.wide)) if isinstance(i, Leaf)]
            rows, held = self._holding(matcher, rows, names)
            return rows.where(wide).select("id", band.alias("band"), near.alias("proximity"), self._unplaced(names, held).alias("score"))
        names = sorted({n for t in (plan.variant, plan.wide) for _, n in matcher.phrases(t)})
        rows, held = self._holding(matcher, rows, names)
        docs, terms = self.index.totals()
        idf = {n: idf_of(docs, held[n]) for n in names}
        norm = F.lit(1.2) * (F.lit(0.25) + F.lit(0.75) * F.col("n") / F.lit(terms / docs if terms else 1.0))
        score = F.when(variant, matcher.score(plan.variant, idf, norm)).otherwise(matcher.score(plan.wide, idf, norm))
        return rows.where(wide).select("id", band.alias("band"), near.alias("proximity"), score.alias("score"))

    def _holding(self, matcher: Matcher, rows: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, int]]:
        """The measured rows, and how many documents hold each leaf.

        The vocabulary knows whole words. Other leaves are counted over the
        rows, which are then kept in executors' memory until ``release``, so
        that the postings are evaluated once.
        """
        plain = {n: w for n, w in matcher.plain().items() if n in names}
        docs = {r.term: r.doc for r in self.index.vocabulary.where(F.col("term").isin(list(plain.values()))).collect()} if plain else {}  # a row for each word
        held = {n: docs.get(w, 0) for n, w in plain.items()}
        if others := [n for n in names if n not in held]:
            rows = self._keep(rows)
            held |= rows.agg(*[F.count(F.when(F.size(n) > 0, 1)).alias(n) for n in others]).first().asDict()  # one row
        return rows, held

    def _unplaced(self, names: list[str], held: dict[str, int]):
        """Without positions: the idf of each word times the weights of the columns that hold it."""
        total, _ = self.index.totals()
        score = F.lit(0.0)
        for name in names:
            for k, weight in enumerate(self.index.columns.values()):
                if weight:
                    score = score + F.when(_in_column(name, k), idf_of(total, held[name]) * float(weight)).otherwise(0.0)
        return -score

    def _keep(self, rows: DataFrame) -> DataFrame:
        rows = rows.persist()
        self._held = [*getattr(self, "_held", []), rows]
        return rows

    # --- answers ----------------------------------------------------------------

    def rows(self, request: Request) -> tuple[DataFrame, Plan | None]:
        """Matching documents with their columns, unfiltered: all documents for a query without words."""
        plan = self.plan(request.query, request.fuzzy, request.typing)
        docs = self.index.documents
        if plan is None:
            return docs.withColumns({"band": F.lit(0), "proximity": F.lit(0), "score": F.lit(0.0)}), None
        found = self.matches(plan, ranked=request.sort is None)
        if request.sort is not None:
            found = found.select("id", F.lit(0).alias("band"), F.lit(0).alias("proximity"), F.lit(0.0).alias("score"))
        return docs.join(found, "id"), plan

    def found(self, request: Request) -> DataFrame:
        """All filtered matches in no order, with their columns."""
        rows, _ = self.rows(request)
        return rows.where(together(conditions(self.fields, request.filters)))

    def total(self, request: Request) -> DataFrame:
        return self.found(request).agg(F.count("*").alias("total"))

    def facets(self, request: Request) -> DataFrame:
        """(ord, facet, value, n) in the order asked for, most frequent values first."""
        rows, _ = self.rows(request)
        return facet_counts(rows, self.fields, request.facets, request.filters).orderBy("ord", F.desc("n"), "value")

    def page(self, request: Request) -> DataFrame:
        """(id, place, band, proximity, score) of a page of hits; ``place`` is the place in the whole order, from 0."""
        rows, plan = self.rows(request)
        rows = rows.where(together(conditions(self.fields, request.filters)))
        order = self._order(request, plan)
        limit, offset = max(0, request.limit), max(0, request.offset)
        # narrow columns decide, and only the first offset + limit of them are numbered
        keys = [c.alias(f"__k{i}") for i, (c, _) in enumerate(order)]
        by = [F.col(f"__k{i}").desc() if down else F.col(f"__k{i}").asc() for i, (_, down) in enumerate(order)]
        first = rows.select("id", "band", "proximity", "score", *keys).orderBy(*by).limit(offset + limit if limit else 0)
        placed = first.withColumn("place", F.row_number().over(Window.orderBy(*by)) - 1).where(F.col("place") >= offset)
        return placed.select("id", "place", "band", "proximity", "score")

    def hits(self, request: Request, ready: bool = True) -> DataFrame:
        """The page of hits with ``place``, in its order. Past the end the page is empty; negative limits and offsets are zero.

        A page of up to FETCHED hits is found first; its ids are then a filter
        of the scan of documents, which lie in ranges of ids. Larger pages, and
        those that are not to be found yet (``ready`` false), are joined.
        """
        page, docs = self.page(request), self.index.documents
        if request.columns is not None:
            if unknown := [c for c in request.columns if c not in docs.columns]:
                raise QueryError("QUERY_INVALID", f'Unknown result column "{unknown[0]}".')
            docs = docs.select("id", *[c for c in request.columns if c != "id"])
        if ready and 0 < request.limit <= FETCHED:
            found = page.toArrow()  # at most FETCHED narrow rows
            page = F.broadcast(docs.sparkSession.createDataFrame(found, page.schema))
            docs = docs.where(_one_of("id", found["id"].to_pylist()))
        # the limit lets the rows be ordered as they come in, without a look at them beforehand
        return docs.join(page.select("id", "band", "proximity", "score", "place"), "id").orderBy("place").limit(max(0, request.limit))

    def answer(self, request: Request) -> dict[str, DataFrame]:
        """Total, facets and hits of one request over one stored evaluation of its matches.

        The matches are kept in executors' memory until ``release`` is called on
        the answer; a lost part is computed again.
        """
        plan = self.plan(request.query, request.fuzzy, request.typing)
        matches = None if plan is None else self._keep(self.matches(plan, ranked=request.sort is None))
        once = Searcher(self.index, self.fields, self.boosts)
        once.plan = lambda *_, **__: plan
        once.matches = lambda *_, **__: matches
        parts = {"total": once.total(request), "hits": once.hits(request, ready=False)}
        if request.facets:
            parts["facets"] = once.facets(request)
        return parts

    def release(self) -> None:
        """Frees what answers have kept."""
        for frame in getattr(self, "_held", []):
            frame.unpersist()
        self._held = []

    def _order(self, request: Request, plan: Plan | None):
        if request.sort:
            builtin = {"id", "title", "url", "description"}
            if request.sort not in builtin or request.sort not in self.index.documents.columns:
                self.fields.use(request.sort, ("facet", "sort"), "QUERY_INVALID", "sort")
            column = F.col(request.sort)
            if request.sort in NOCASE:
                column = F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
            return [(column, request.descending), (F.col("id"), False)]
        if plan is None:
            return [(F.col("id"), False)]
        factor = product(self.boosts)
        rank = F.col("score") if factor is None else F.col("score") * factor
        return [(F.col("band"), False), (F.col("proximity"), False), (rank, False), (F.col("id"), False)]

    def resolved(self, request: Request) -> dict:
        """What the query was read as: terms with their forms, phrases, corrections."""
        plan = self.plan(request.query, request.fuzzy, request.typing)
        out: dict = {"terms": [], "phrases": [], "corrections": {}}
        if plan is None:
            return out
        from shelfmark.functions.text import fold_word

        terms: dict[tuple[str, bool], list[str]] = {}
        for leaf in _kept_leaves(plan.node):
            if isinstance(leaf, Term):
                word = fold_word(leaf.value)
                forms = [word, *(plan.variants.get(word, []) if leaf.wideable else []), *(plan.guesses.get(word, []) if leaf.wideable else [])]
                held = terms.setdefault((word, leaf.prefix), [])
                held += [f for f in forms if f not in held]
            elif isinstance(leaf, Phrase):
                out["phrases"].append([fold_word(t) for t in leaf.terms])
        out["terms"] = [{"term": w, "forms": f, "prefix": p} for (w, p), f in terms.items()]
        out["unverified"] = [] if self.index.positions else out["phrases"]
        out["corrections"] = plan.corrections
        return out

    def mark_forms(self, plan: Plan) -> list[tuple[tuple[str, ...], bool]]:
        """Runs of folded words to mark, with whether the last may go on."""
        from shelfmark.functions.text import fold_word

        forms = []
        for leaf in _kept_leaves(plan.node):
            if isinstance(leaf, Term):
                word = fold_word(leaf.value)
                extra = [*plan.variants.get(word, []), *plan.guesses.get(word, [])] if leaf.wideable else []
                forms += [((f,), leaf.prefix) for f in [word, *extra]]
            elif isinstance(leaf, Identifier):
                forms += [(tuple(map(fold_word, s)), leaf.prefix) for s in spellings(leaf)]
            elif isinstance(leaf, Phrase):
                forms.append((tuple(map(fold_word, leaf.terms)), False))
        return list(dict.fromkeys(forms))


def _one_of(name: str, values: list):
    """Whether a column is one of some values, as single comparisons: a scan gets these one by one, but of a longer list only its least and greatest value."""
    tests = [F.col(name) == v for v in values] or [F.lit(False)]
    while len(tests) > 1:  # pairs of pairs, so that no side is deep
        tests = [a | b for a, b in zip(tests[::2], tests[1::2])] + (tests[-1:] if len(tests) % 2 else [])
    return tests[0]


def _in_column(name: str, column: int):
    return F.exists(F.col(name), lambda p: F.floor(p / COLUMN) == column)


def _positive(tree: Tree):
    if tree.kind in ("leaf", "close"):
        yield tree.item
    for p in tree.parts[:1] if tree.kind == "not" else tree.parts:
        yield from _positive(p)


def _kept_leaves(node: Node):
    """Leaves outside the right sides of exclusions."""
    if isinstance(node, Not):
        yield from _kept_leaves(node.left)
    elif not node.children():
        yield from leaves(node)
    else:
        for child in node.children():
            yield from _kept_leaves(child)

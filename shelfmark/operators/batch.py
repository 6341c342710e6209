"""Many queries at once: each query's page of ranked hits, from one plan."""

from __future__ import annotations

import math
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shelfmark.functions.text import tokens
from shelfmark.operators.index import Index
from shelfmark.operators.match import K1, B
from shelfmark.plans.blocks import crossed
from shelfmark.plans.lineage import written

POSTINGS, SETS = 2_000_000, 20_000  # of a block of documents, and of a block of queries
SPREAD, HELD = 1_000, 64 << 20  # postings of a word whose scores are spread over the block's documents; bytes of such words that are kept


def _packed_postings(kind: pa.DataType, mean: float):
    """One row for a partition of (term, id, n, idf, f) in the order of terms and ids: each word's documents, by their place among the block's ids, with its part of their scores."""

    def pack(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        term, id_ = (table.column(c).chunk(0).dictionary_encode() for c in ("term", "id"))
        names = id_.dictionary
        order = pc.sort_indices(names).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        terms, ids = term.indices.to_numpy().astype(np.int64), place[id_.indices.to_numpy()]
        n, idf, f = (table.column(c).to_numpy() for c in ("n", "idf", "f"))
        # a word has a row for each column that holds it; words are numbered as they come
        first = np.flatnonzero(np.diff(terms, prepend=-1) | np.diff(ids, prepend=-1))
        f = np.add.reduceat(f, first)
        score = idf[first] * f * (K1 + 1) / (f + K1 * (1 - B + B * n[first] / mean))
        starts = np.searchsorted(terms[first], np.arange(len(term.dictionary) + 1))
        one = lambda values, t: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(t))
        row = [one(names.take(pa.array(order)), kind), one(term.dictionary, pa.string())]
        row += [pa.array([x.tobytes()], pa.binary()) for x in (starts.astype(np.int64), ids[first].astype(np.int32), score)]
        yield pa.RecordBatch.from_arrays(row, names=["ids", "terms", "starts", "docs", "scores"])

    return pack


def _packed_sets(kind: pa.DataType):
    def pack(batches):
        sets, words = [], []
        for batch in batches:
            sets += batch.column(0).to_pylist()
            words += batch.column(1).to_pylist()
        if sets:
            yield pa.RecordBatch.from_arrays([pa.array([sets], pa.list_(kind)), pa.array([words], pa.list_(pa.list_(pa.string())))], names=["sets", "words"])

    return pack


def _ranked(kind: pa.DataType, id_kind: pa.DataType, most: int, offset: int):
    """The pages of blocks of sets, each of which meets all blocks of documents in one task."""

    def pages(sets: list, best: list):
        rows = [(s, i, k, score) for s, b in zip(sets, best) for k, (score, i) in enumerate(b) if k >= offset]
        kinds = (kind, id_kind, pa.int32(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["set", "id", "place", "score"])

    def rank(batches):
        found: dict = {}  # by a block's first set
        for batch in batches:
            first = batch.column("sets")[0][0].as_py()
            if first not in found:
                sets = batch.column("sets")[0].as_py()
                found[first] = sets, batch.column("words")[0].as_py(), [[] for _ in sets]
            _, words, best = found[first]
            ids = batch.column("ids")[0].values
            number = {t: k for k, t in enumerate(batch.column("terms")[0].as_py())}
            starts, docs, scores = (np.frombuffer(batch.column(c)[0].as_buffer(), t) for c, t in (("starts", np.int64), ("docs", np.int32), ("scores", np.float64)))
            sizes = np.diff(starts).tolist()
            starts = starts.tolist()
            spread: OrderedDict[int, np.ndarray] = OrderedDict()
            room = max(1, HELD // (8 * len(ids)))

            def part(term: int, at: np.ndarray) -> np.ndarray:
                """The word's part of the scores of some documents; no number where it does not stand."""
                lo, hi = starts[term], starts[term + 1]
                if hi - lo < SPREAD:
                    k = np.minimum(np.searchsorted(docs[lo:hi], at), hi - lo - 1)
                    return np.where(docs[lo:hi][k] == at, scores[lo:hi][k], np.nan)
                if term not in spread:
                    if len(spread) >= room:
                        spread.popitem(last=False)
                    spread[term] = np.full(len(ids), np.nan)
                    spread[term][docs[lo:hi]] = scores[lo:hi]
                return spread[term][at]

            there = [(k, [number.get(w, -1) for w in ws]) for k, ws in enumerate(words)]
            there = [(max(sizes[t] for t in ts), max(ts, key=sizes.__getitem__), k, ts) for k, ts in there if min(ts) >= 0]
            there.sort()  # sets of one frequent word follow each other
            for _, _, k, ts in there:
                rarest = min(ts, key=sizes.__getitem__)
                at = docs[starts[rarest] : starts[rarest + 1]]
                total = 0.0
                for t in ts:
                    total = total + (scores[starts[t] : starts[t + 1]] if t == rarest else part(t, at))
                # the same rounding in every block; documents that lack a word have no number and pass no comparison
                total = -np.rint(total * 1e9) / 1e9
                own = best[k]
                fits = total <= (own[most - 1][0] if len(own) == most else np.inf)
                if not fits.all():
                    at, total = at[fits], total[fits]
                if len(total) > most:
                    near = total <= np.partition(total, most - 1)[most - 1]
                    at, total = at[near], total[near]
                    order = np.argsort(total, kind="stable")[:most]  # ids ascend, so equal scores stay in their order
                    at, total = at[order], total[order]
                if len(total):
                    best[k] = sorted(own + list(zip(total.tolist(), ids.take(pa.array(at)).to_pylist())))[:most]
        for sets, _, best in found.values():
            yield pages(sets, best)

    return rank


def ranked_pages(index: Index, queries: DataFrame, key: str, text: str, limit: int = 10, offset: int = 0) -> DataFrame:
    """(key, id, place, score): for each query the documents that hold all its words, best first; ``place`` counts from 0.

    Queries are plain words, taken whole and as they stand in the index; blank
    and null ones have no rows, repeated rows of a key count once. Queries with
    the same words are answered once. Postings of the asked words are packed in
    blocks of documents, and each block of queries meets all of them one after
    the other: of the documents that hold a query's rarest word those that hold
    the others are scored, and the best so far are kept. So neither the pairs of
    queries and documents nor the postings of each query are shuffled. Scores
    are ordered to nine digits, then by id.
    """
    docs, terms = index.totals()
    weights = F.array(*[F.lit(float(w)) for w in index.columns.values()])
    words = queries.select(F.col(key).alias("query"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).where("query IS NOT NULL")
    asked = words.groupBy("query").agg(F.array_sort(F.collect_set("term")).alias("words"))
    sets = written(asked.groupBy("words").agg(F.min("query").alias("set")), "sets")
    raw = F.log((F.lit(docs) - F.col("doc") + 0.5) / (F.col("doc") + 0.5))
    known = sets.select(F.explode("words").alias("term")).distinct().join(index.vocabulary.select("term", "doc", F.when(raw > 0, raw).otherwise(1e-6).alias("idf")), "term")
    known = written(known, "asked")
    size = known.agg(F.coalesce(F.sum("doc"), F.lit(0)).alias("postings")).crossJoin(sets.agg(F.count("*").alias("sets"))).first()  # one row
    parts = max(4 * queries.sparkSession.sparkContext.defaultParallelism, math.ceil(size.sets / SETS))
    id_type, key_type = index.postings.schema["id"].dataType, queries.schema[key].dataType
    id_name, key_name = id_type.simpleString(), key_type.simpleString()
    held = index.postings.join(known.select("term", "idf"), "term").select("term", "id", "n", "idf", (F.get(weights, F.col("col")) * F.size(F.coalesce("positions", F.array(F.lit(0))))).alias("f"))
    held = held.repartition(max(1, math.ceil(size.postings / POSTINGS)), "id").sortWithinPartitions("term", "id")
    blocks = written(held.mapInArrow(_packed_postings(to_arrow_type(id_type), terms / docs if terms else 1.0), f"ids array<{id_name}>, terms array<string>, starts binary, docs binary, scores binary"), "held")
    packed = written(sets.select("set", "words").repartition(parts, "set").mapInArrow(_packed_sets(to_arrow_type(key_type)), f"sets array<{key_name}>, words array<array<string>>"), "packed")
    # all blocks of documents in one partition: what a block of sets has found so far stays in its task
    best = crossed(blocks.coalesce(1), packed, _ranked(to_arrow_type(key_type), to_arrow_type(id_type), offset + limit, offset), f"set {key_name}, id {id_name}, place int, score double", "pages")
    return asked.join(sets, "words").join(best, "set").select(F.col("query").alias(key), "id", "place", "score")

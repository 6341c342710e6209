"""Frequencies of all distinct values: burst tries in the workers, matching subtrees merged across them."""

from __future__ import annotations

import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.terms import terms_of
from shelfmark.plans.lineage import written

CONTAINER = 1024  # suffixes that a container holds before it bursts
DEEPEST = 64  # letters of the longest prefix of a container; deeper ones do not burst
HELD, HELD_CHARS = 400_000, 64_000_000  # suffixes that a worker holds before it hands its trie on, and their characters
LEAST_ROUTE, ROUTES = 20_000, 4_096  # suffixes that a route holds before it is split further; prefixes on a level that are split
MERGED = 200_000  # suffixes that are merged at once
SUBTREE = "prefix string, suffixes array<string>, occurrences array<bigint>, records array<bigint>"
_BURST = None


class BurstTrie:
    """Counters of terms: containers of suffixes, reached by prefixes that grow where containers burst. A term that ends where a container has burst is kept beside them."""

    def __init__(self, limit: int = CONTAINER):
        self.limit, self.nodes, self.ends, self.size, self.chars = limit, {}, {}, 0, 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        nodes, depth, prefix = self.nodes, 1, term[:1]
        while (box := nodes.get(prefix, 0)) is _BURST and depth < len(term):
            depth += 1
            prefix = term[:depth]
        if box is _BURST:
            box, suffix = self.ends, term
        else:
            if box == 0:
                box = nodes[prefix] = {}
            suffix = term[depth:]
        counts = box.get(suffix)
        if counts is not None:
            counts[0] += occurrences
            counts[1] += records
            return
        box[suffix] = [occurrences, records]
        self.size += 1
        self.chars += len(suffix)
        if len(box) > self.limit and box is not self.ends and depth < DEEPEST:
            self._burst(prefix)

    def _burst(self, prefix: str) -> None:
        """Cuts a container by the next letter, and so on while one of its parts is too large."""
        full = [prefix]
        while full:
            prefix = full.pop()
            box, self.nodes[prefix] = self.nodes[prefix], _BURST
            for suffix, counts in box.items():
                if suffix:
                    self.nodes.setdefault(prefix + suffix[0], {})[suffix[1:]] = counts
                else:
                    self.ends[prefix] = counts
            if len(prefix) + 1 < DEEPEST:
                full += [p for p in {prefix + s[0] for s in box if s} if len(self.nodes[p]) > self.limit]

    def subtrees(self):
        """(prefix, suffixes, occurrences, records) of every container and of every term beside them."""
        for prefix, box in self.nodes.items():
            if box:
                yield prefix, list(box), [c[0] for c in box.values()], [c[1] for c in box.values()]
        for term, (o, r) in self.ends.items():
            yield term, [""], [o], [r]


def _rows(rows: list, names: list[str]) -> pa.RecordBatch:
    types = {"suffixes": pa.list_(pa.string()), "occurrences": pa.list_(pa.int64()), "records": pa.list_(pa.int64()), "salt": pa.int32(), "n": pa.int64(), "r": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(names, zip(*rows))], names=names)


def _chunks(rows, names: list[str], most: int = 20_000):
    """Batches of rows with arrays, by the number of array entries and their length."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1]) + sum(map(len, row[1])) // 64
        if size >= most:
            yield _rows(held, names)
            held, size = [], 0
    if held:
        yield _rows(held, names)


def _build(batches):
    names = ["prefix", "suffixes", "occurrences", "records"]
    trie = BurstTrie()
    for batch in batches:
        column = batch.column(0)
        listed = pa.types.is_list(column.type)
        for start in range(0, len(column), 500):
            occurrences, records = Counter(), Counter()
            for value in column.slice(start, 500).to_pylist():
                found = value if listed else terms_of(value)
                if found:
                    occurrences.update(found)
                    records.update(set(found))
            for term, n in occurrences.items():
                if term is not None:
                    trie.add(term, n, records[term])
            if trie.size > HELD or trie.chars > HELD_CHARS:
                yield from _chunks(trie.subtrees(), names)
                trie = BurstTrie()
    yield from _chunks(trie.subtrees(), names)


def count_values(values: Column, df: DataFrame) -> DataFrame:
    """(term, occurrences, records): how often each distinct term stands in ``values``, and in how many rows.

    ``values`` is a text, counted by its terms, or an array of strings, counted
    as they are. Null and empty texts, null arrays and null elements hold
    nothing; the empty string is a value if an array holds it.

    Each worker counts into a burst trie and hands on its containers, each a row
    with a prefix and packed suffixes. Routes are the shortest prefixes under
    which all workers together hold few enough suffixes; containers are cut
    along them, brought together by route, and merged one route at a time.
    The prefixes that are split, which all workers must know, are at most ROUTES
    on each level of the trie, whatever the size of the collection. Where routes
    then hold more suffixes than may be merged at once, they are cut again by a
    hash of the suffix, so that neither a worker nor a merging task holds more
    than a fixed number of them. A term that is frequent everywhere is one
    counter per trie.
    """
    spark = df.sparkSession
    tries = written(df.select(values.alias("v")).where("v IS NOT NULL").mapInArrow(_build, SUBTREE), "subtrees")
    # prefixes too full to be a route: they hold a share of all suffixes, so there are at most ROUTES on a level
    prefixes = tries.select(F.size("suffixes").alias("n"), F.explode(F.when(F.length("prefix") > 0, F.transform(F.sequence(F.lit(1), F.least(F.length("prefix"), F.lit(DEEPEST))), lambda k: F.substring("prefix", F.lit(1), k)))).alias("p"))
    total = tries.agg(F.sum(F.size("suffixes"))).first()[0] or 0
    most = max(LEAST_ROUTE, total // ROUTES)
    full = {r.p for r in prefixes.groupBy("p").agg(F.sum("n").alias("n")).where(F.col("n") > most).collect()}
    salts = -(-most // MERGED)
    sent = spark.sparkContext.broadcast(full)
    names = ["prefix", "suffixes", "occurrences", "records", "salt"]

    def route(batches):
        heavy = sent.value

        def of(prefix: str, suffix: str) -> str:
            term, depth = prefix + suffix, 1
            while depth < len(term) and term[:depth] in heavy:
                depth += 1
            return term[:depth]

        def salted(path: str, entries: list):
            by: dict[int, list] = {}
            for entry in entries:
                by.setdefault(zlib.crc32(entry[0].encode()) % salts if salts > 1 else 0, []).append(entry)
            for salt, held in by.items():
                yield path, *map(list, zip(*held)), salt

        def cut(batch):
            for k in range(batch.num_rows):
                prefix, suffixes, o, r = (batch.column(c)[k].as_py() for c in range(4))
                by: dict[str, list] = {}
                if not prefix or prefix in heavy:
                    for s, a, b in zip(suffixes, o, r):
                        path = of(prefix, s)
                        by.setdefault(path, []).append(((prefix + s)[len(path) :], a, b))
                else:
                    path = of(prefix, "")
                    by[path] = [(prefix[len(path) :] + s, a, b) for s, a, b in zip(suffixes, o, r)]
                for path, entries in by.items():
                    yield from salted(path, entries)

        for batch in batches:
            yield from _chunks(cut(batch), names)

    def merge(batches):
        def flush():
            held = []
            for s, counts in merged.items():
                held.append((at[0] + s, *counts))
                if len(held) == 10_000:
                    yield _rows(held, ["term", "n", "r"])
                    held = []
            if held:
                yield _rows(held, ["term", "n", "r"])

        at, merged = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                prefix, suffixes, o, r, salt = (batch.column(c)[k].as_py() for c in range(5))
                if (prefix, salt) != at:
                    yield from flush()
                    at, merged = (prefix, salt), {}
                for s, a, b in zip(suffixes, o, r):
                    counts = merged.get(s)
                    if counts is None:
                        merged[s] = [a, b]
                    else:
                        counts[0] += a
                        counts[1] += b
        yield from flush()

    routed = tries.mapInArrow(route, SUBTREE + ", salt int").repartition("prefix", "salt").sortWithinPartitions("prefix", "salt")
    return routed.mapInArrow(merge, "term string, n bigint, r bigint").select("term", F.col("n").alias("occurrences"), F.col("r").alias("records"))


def marked_values(counts: DataFrame, n_records: int, common_share: float, rare_records: int = 1) -> DataFrame:
    """``counts`` with ``mark``: ``rare`` up to ``rare_records`` records, ``common`` above that share of ``n_records``, else null. Rare wins where both hold."""
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > F.lit(common_share) * n_records, "common")
    return counts.withColumn("mark", mark)

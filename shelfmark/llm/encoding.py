"""Encoding of texts by a public byte-level tokenizer, inside Spark's expressions.

A text is cut into words by the tokenizer's pattern. A word that is a piece of
the vocabulary has its id at once. Every other distinct word is encoded once: a
higher-order function folds the ranked merges over its bytes. Ranks are a
literal, an array of small maps, in which the hash of a piece names the map.
Bytes are held as strings of the first 256 code points, one for each byte.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.plans.lineage import written

PATTERN = r"(?U)'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 96  # bytes; the fold takes time by the square of a word's length, so longer words are merged in Python
NONE = 1 << 30


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """A ``.tiktoken`` file: lines of a piece in base64 and its rank, which is its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word by ranked merges: a heap of pairs over a linked list."""
    import heapq

    parts = [word[i : i + 1] for i in range(len(word))]
    after, before, alive = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1)), [True] * len(parts)
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i] if alive[i] else len(parts)
        if j >= len(parts) or parts[i] + parts[j] != pair:
            continue
        parts[i], alive[j], after[i] = pair, False, after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(parts) and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a] + parts[b]))
    return [ranks[p] for p, on in zip(parts, alive) if on]


def _valid(piece: bytes) -> bool:
    try:
        return bool(piece.decode("utf-8"))
    except UnicodeDecodeError:
        return False


def _bytes(word: Column) -> Column:
    """A string whose code points are the bytes of ``word``."""
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


class ByteBpe:
    """A byte-level vocabulary as literals of a session. ``path`` names its ``.tiktoken`` file."""

    def __init__(self, path: str, buckets: int = 8192):
        self.path, self.ranks = path, read_ranks(path)
        self.buckets = buckets
        self.map = self._literal({p.decode("latin-1"): r for p, r in self.ranks.items()}, "int")
        # whole words, which are looked up most, as they stand in texts
        self.words = self._literal({p.decode("utf-8"): r for p, r in self.ranks.items() if _valid(p)}, "int")

    def _literal(self, values: dict, kind: str) -> Column:
        """A constant array of small maps, in which the checksum of a key names the map."""
        maps: list[dict] = [{} for _ in range(self.buckets)]
        for key, value in values.items():
            maps[zlib.crc32(key.encode()) % self.buckets][key] = value
        return F.from_json(F.lit(json.dumps(maps, ensure_ascii=False, separators=(",", ":"))), F.lit(f"array<map<string,{kind}>>"))

    def _bucket(self, word: Column) -> Column:
        return (F.crc32(word) % self.buckets).cast("int")

    def rank(self, word: Column) -> Column:
        return F.try_element_at(F.get(self.map, self._bucket(word)), word)

    def whole(self, word: Column) -> Column:
        """A word's id if it is a piece of the vocabulary, else null."""
        return F.try_element_at(F.get(self.words, self._bucket(word)), word)

    def fold(self, word: Column) -> Column:
        """The ids of a word's bytes: as many steps as it may take, each of which merges the first pair of the lowest rank."""
        parts = F.filter(F.split(word, ""), lambda c: c != "")

        def merge(parts: Column, _: Column) -> Column:
            ranks = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda a, i: F.coalesce(self.rank(F.concat(a, F.get(parts, i + 1))), F.lit(NONE)))

            def apply(ranks: Column) -> Column:
                at = F.array_position(ranks, F.array_min(ranks)).cast("int")
                pair = F.concat(F.get(parts, at - 1), F.get(parts, at))
                return F.when(F.array_min(ranks) < NONE, F.concat(F.slice(parts, F.lit(1), at - 1), F.array(pair), F.slice(parts, at + 2, F.size(parts)))).otherwise(parts)

            merged = F.element_at(F.transform(F.array(ranks), apply), 1)
            return F.when(F.size(parts) > 1, merged).otherwise(parts)

        steps = F.when(F.length(word) > 1, F.sequence(F.lit(2), F.length(word))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, parts, merge, lambda parts: F.transform(parts, self.rank))

    def encode(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """(key, ids): one row for each row of ``docs``; empty and null texts give an empty list.

        A text is cut and looked up once: its words of the vocabulary become
        ids, the others stay with their places. The others go to their
        encoding, which is made once for each distinct word, and back to their
        places. What moves is short words, short lists and rows of ids; no text
        is shuffled, of whatever length.
        """
        spark = docs.sparkSession
        sent = spark.sparkContext.broadcast(self.ranks)  # a vocabulary has a fixed size
        texts = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
        none = F.array().cast("array<int>")
        # Each step is columns of its own, so that no text is cut twice; a written table, so that each plan holds one literal once.
        cut = texts.where(F.length("__text") > 0).select(F.monotonically_increasing_id().alias("__row"), "__key", F.regexp_extract_all("__text", F.lit(PATTERN), F.lit(0)).alias("__words"))
        looked = cut.select("__row", "__key", "__words", F.transform("__words", self.whole).alias("ids"))
        other = F.filter(F.transform("__words", lambda w, i: F.when(F.get("ids", i).isNull(), F.struct(i.alias("at"), w.alias("word")))), lambda x: x.isNotNull())
        held = written(looked.select("__row", "__key", "ids", other.alias("others")), "looked-up")
        places = held.select("__row", F.explode("others").alias("x")).select("__row", "x.at", "x.word")
        # few bytes but much work: spread by number, as partitions sized by bytes would be one
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        distinct = places.select("word").distinct().repartition(tasks)

        def long(batches):
            known = sent.value
            for batch in batches:
                column = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_merged(w.encode("utf-8"), known) for w in column], pa.list_(pa.int32()))], names=["word", "pieces"])

        short = distinct.where(F.octet_length("word") <= LONG).select("word", self.fold(_bytes(F.col("word"))).alias("pieces"))
        encoded = written(short.unionByName(distinct.where(F.octet_length("word") > LONG).mapInArrow(long, "word string, pieces array<int>")), "encoded")
        # ids travel as digits, which take less room than arrays; a word of many texts is a hot key, which adaptive execution splits as it reads
        packed = encoded.select("word", F.array_join(F.col("pieces").cast("array<string>"), ",").alias("pieces"))
        own = places.join(packed, "word").groupBy("__row").agg(F.collect_list(F.struct("at", "pieces")).alias("own"))  # one text's words
        known = F.filter(F.transform("ids", lambda x, i: F.when(x.isNotNull(), F.struct(i.alias("at"), x.cast("string").alias("pieces")))), lambda x: x.isNotNull())
        whole = F.split(F.array_join(F.transform(F.array_sort(F.concat(known, "own")), lambda x: x["pieces"]), ","), ",").cast("array<int>")
        filled = held.select("__row", "__key", "ids").join(own, "__row", "left").select(F.col("__key").alias(key), F.when(F.col("own").isNull(), F.col("ids")).otherwise(whole).alias("ids"))
        empty = texts.where(F.coalesce(F.length("__text"), F.lit(0)) == 0).select(F.col("__key").alias(key), none.alias("ids"))
        return filled.unionByName(empty)

    def decode(self, ids: Column) -> Column:
        """The text of a list of ids: the pieces' bytes put together; null for null, and for an id outside the vocabulary."""
        pieces = sorted(self.ranks, key=self.ranks.get)
        literal = F.from_json(F.lit(json.dumps([p.decode("latin-1") for p in pieces])), F.lit("array<string>"))
        binary = F.encode(F.array_join(F.transform(ids, lambda i: F.get(literal, i)), ""), "ISO-8859-1")
        inside = F.forall(ids, lambda i: (i >= 0) & (i < len(pieces)))
        return F.when(inside, F.decode(binary, "UTF-8"))


def encode_documents(docs: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    return ByteBpe(vocabulary).encode(docs, key, text)

"""Evaluation texts that leaked into the corpus: pigeonhole pieces, then bit-parallel edit distance."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.terms import terms_of

BLOCK, BLOCK_CHARS = 100_000, 64_000_000  # items searched for in one pass, and their characters; more are searched for in further passes


def pieces_of(words: list[str], run: int) -> list[int]:
    """Starts of the pieces of an item: any ``run`` consecutive terms hold one piece of half that length whole."""
    return list(range(0, len(words) - run // 2 + 1, run // 2))


def myers(pattern: list, text: list) -> int:
    """The least number of term edits between ``pattern`` and any part of ``text``, bit-parallel over the pattern."""
    size = len(pattern)
    full, top = (1 << size) - 1, 1 << (size - 1)
    places: dict = defaultdict(int)
    for i, word in enumerate(pattern):
        places[word] |= 1 << i
    up, down, score, best = full, 0, size, size
    for word in text:
        same = places.get(word, 0)
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        rise, fall = (down | ~(diagonal | up)) & full, up & diagonal
        score += bool(rise & top) - bool(fall & top)
        best = min(best, score)
        rise, fall = (rise << 1) & full, (fall << 1) & full
        up, down = (fall | ~((same | down) | rise)) & full, rise & (same | down)
    return best


def longest_run(item: list, text: list, hits: list[tuple[int, int]], width: int) -> int:
    """The longest run of equal terms through any of the hits (start in the item, start in the text)."""
    best, seen = 0, {}
    for i, j in sorted(hits):
        if seen.get(j - i, -1) >= i:
            continue  # within a run that is measured already
        a, b = 0, width
        while a < i and a < j and item[i - a - 1] == text[j - a - 1]:
            a += 1
        while i + b < len(item) and j + b < len(text) and item[i + b] == text[j + b]:
            b += 1
        best, seen[j - i] = max(best, a + b), i + b
    return best


def allowed_errors(size: int, run: int, budget: float | None) -> tuple[int, int]:
    """The edits allowed to an item of ``size`` terms, and the length of its pieces, which are one more at least."""
    errors = len(range(0, size - run // 2 + 1, run // 2)) - 1
    if budget is not None:
        errors = int(size * budget)
    return errors, max(1, min(run // 2, size // (errors + 1)))


@dataclass
class Pieces:
    """The pieces of a block of items, made once and sent out: numbers of terms, and sorted codes of pieces for each length of piece."""

    keys: list
    items: list[list[int]]
    errors: list[int]
    widths: list[int]
    numbers: dict[str, int]
    codes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by width: codes, item, start

    @classmethod
    def of(cls, rows: list[tuple[object, list[str]]], run: int, budget: float | None) -> "Pieces":
        numbers: dict[str, int] = {}
        made = cls([], [], [], [], numbers, {})
        found = defaultdict(list)
        for key, words in rows:
            ids = [numbers.setdefault(w, len(numbers) + 1) for w in words]
            errors, width = allowed_errors(len(ids), run, budget)
            for start in range(0, len(ids) - width + 1, width):
                found[width].append((len(made.items), start, ids[start : start + width]))
            made.keys.append(key)
            made.items.append(ids)
            made.errors.append(errors)
            made.widths.append(width)
        for width, pieces in found.items():
            code = _codes(np.array([p for _, _, p in pieces], np.uint64).ravel(), width)[::width]
            order = np.argsort(code, kind="stable")
            made.codes[width] = (code[order], np.array([k for k, _, _ in pieces], np.int32)[order], np.array([a for _, a, _ in pieces], np.int32)[order])
        return made

    def hits(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each item that has a piece in a text, given by the numbers of its terms (0: in no item), where it stands in both."""
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for width, (codes, item, start) in self.codes.items():
            if len(ids) < width:
                continue
            known = np.concatenate([[0], np.cumsum(ids > 0)])
            at = np.flatnonzero(known[width:] - known[:-width] == width)  # a piece holds terms of items only
            if not len(at):
                continue
            own = _codes(ids, width)[at]
            low, high = np.searchsorted(codes, own, "left"), np.searchsorted(codes, own, "right")
            for k in np.flatnonzero(high > low):
                j = int(at[k])
                for p in range(low[k], high[k]):
                    i, number = int(start[p]), int(item[p])
                    if self.items[number][i : i + width] == ids[j : j + width].tolist():  # codes may be equal by chance
                        out[number].append((i, j))
        return out


def _codes(ids: np.ndarray, width: int) -> np.ndarray:
    """A number for each run of ``width`` terms."""
    n = len(ids) - width + 1
    ids = ids.astype(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed = (mixed ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def leaked_items(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, run: int = 10, budget: float | None = None) -> DataFrame:
    """(key, item_key, run, distance, errors): each document with every item that it gives away, fully or partly.

    An item of n terms is cut into pieces of run/2 terms, or into shorter ones
    if its error budget needs more pieces. Whatever differs from it in fewer
    edits than it has pieces, or shares ``run`` consecutive terms with it, holds
    one piece unchanged; all pieces are looked for in one pass over a text. A
    hit is then verified: ``run`` is the longest run of shared terms through a
    piece, ``distance`` the edit distance between the item and the nearest part
    of the text around its hits, ``errors`` the number of edits allowed: the
    share ``budget`` of the item's terms, by default one fewer than its pieces
    of run/2 terms. A pair stands if distance <= errors or the run is long
    enough. Null or empty texts and items of fewer than ``run`` terms give no
    rows; repeated items are reported each.

    Nothing is shuffled. The items are the stated query set: they go out in
    blocks bounded by number and characters, each a pass over the documents.
    """
    items = items.where(F.col(item_text).isNotNull()).select(F.col(item_key).alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars")).first()  # one row
    blocks = max(1, -(-size.n // BLOCK), -(-size.chars // BLOCK_CHARS))
    parts = [_search(docs, items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b), key, text, item_key, run, budget) for b in range(blocks)]
    found = parts[0]
    for other in parts[1:]:
        found = found.unionAll(other)
    return found


def _search(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, run: int, budget: float | None) -> DataFrame:
    kept = [(r.i, words) for r in items.collect() if len(words := terms_of(r.t)) >= run]  # one block
    sent = docs.sparkSession.sparkContext.broadcast(Pieces.of(kept, run, budget))  # as large as the block
    names = (key, item_key, "run", "distance", "errors")
    types = [docs.schema[key].dataType.simpleString(), items.schema["i"].dataType.simpleString(), "int", "int", "int"]
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, types))

    def search(batches):
        known = sent.value
        numbers = known.numbers
        for batch in batches:
            rows = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.fromiter((numbers.get(w, 0) for w in terms_of(body)), np.int64)
                hits = known.hits(ids) if known.codes and len(ids) else {}
                words = ids.tolist() if hits else []
                for k, where in hits.items():
                    item, errors = known.items[k], known.errors[k]
                    longest = longest_run(item, words, where, known.widths[k])
                    low, high = min(j - i for i, j in where) - errors, max(j - i for i, j in where) + len(item) + errors
                    distance = myers(item, words[max(0, low) : max(0, high)])
                    if longest >= run or distance <= errors:
                        rows.append((doc, known.keys[k], longest, distance, errors))
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1]), *[pa.array(c, pa.int32()) for c in columns[2:]]], names=list(names))

    return docs.select(key, text).where(F.col(text).isNotNull()).mapInArrow(search, schema)

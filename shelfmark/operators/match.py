"""A query tree as one plan: postings are read once, grouped by document, and the tree is a column over the groups."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import fold_word
from shelfmark.operators.index import Index
from shelfmark.plans.syntax import And, Identifier, Near, Node, Not, Or, Phrase, Scoped, Term, spellings

K1, B = 1.2, 0.75
COLUMN = 1 << 32  # positions of different columns lie this far apart

Atom = tuple[str, bool]  # a folded word, and whether it stands for all words it begins
Widening = dict[str, list[str]]


@dataclass(frozen=True)
class Leaf:
    """A run of atoms in one of some columns; ``columns`` None: in any."""

    atoms: tuple[Atom, ...]
    columns: tuple[int, ...] | None = None


@dataclass(frozen=True)
class Close:
    """Leaves that stand near each other in one column."""

    leaves: tuple[Leaf, ...]
    distance: int


@dataclass(frozen=True)
class Tree:
    kind: str  # leaf, close, and, or, not
    item: object = None
    parts: tuple["Tree", ...] = ()


def compile_tree(node: Node, columns: list[str], widen: list[Widening] = (), positions: bool = True) -> Tree:
    """The tree with every word folded and every wideable word as the choice of its forms.

    ``widen`` holds lookups from folded words to further forms. The right side
    of an exclusion is widened by the first lookup alone, since a guess must
    not take documents away.
    """

    def leaf(words, scope, prefix=False) -> Tree:
        atoms = tuple((fold_word(w), prefix) for w in words)
        if not positions and len(atoms) > 1:
            return Tree("and", parts=tuple(Tree("leaf", Leaf((a,), scope)) for a in atoms))
        return Tree("leaf", Leaf(atoms, scope))

    def one_of(parts: list[Tree]) -> Tree:
        parts = list(dict.fromkeys(parts))
        return parts[0] if len(parts) == 1 else Tree("or", parts=tuple(parts))

    def go(n: Node, scope, lookups) -> Tree:
        match n:
            case Term(value, prefix, wideable):
                forms = [fold_word(value)]
                if wideable:
                    forms += [f for known in lookups for f in known.get(forms[0], [])]
                return one_of([leaf([f], scope, prefix) for f in dict.fromkeys(forms)])
            case Identifier(_, prefix):
                return one_of([leaf(s, scope, prefix) for s in spellings(n)])
            case Phrase(terms):
                return leaf(terms, scope)
            case Near(operands, distance):
                parts = tuple(go(o, scope, ()) for o in operands)
                if not positions:
                    return Tree("and", parts=parts)
                return Tree("close", Close(tuple(p.item for p in parts), distance))
            case Scoped(column, child):
                own = columns.index(column)
                inner = (own,) if scope is None or own in scope else ()
                return go(child, inner, lookups)
            case And(operands):
                return Tree("and", parts=tuple(go(o, scope, lookups) for o in operands))
            case Or(operands):
                return Tree("or", parts=tuple(go(o, scope, lookups) for o in operands))
            case Not(left, right):
                return Tree("not", parts=(go(left, scope, lookups), go(right, scope, lookups[:1])))
        raise TypeError(n)

    return go(node, None, tuple(widen))


def _items(tree: Tree):
    if tree.kind in ("leaf", "close"):
        yield tree.item
    for p in tree.parts:
        yield from _items(p)


@dataclass
class Matcher:
    """Columns over the documents that hold any atom of the trees."""

    index: Index
    trees: list[Tree]
    atoms: dict[Atom, int] = field(default_factory=dict)

    def __post_init__(self):
        for tree in self.trees:
            for item in _items(tree):
                for leaf in item.leaves if isinstance(item, Close) else (item,):
                    for atom in leaf.atoms:
                        self.atoms.setdefault(atom, len(self.atoms))
        self.items = list(dict.fromkeys(i for t in self.trees for i in _items(t)))

    def documents(self) -> DataFrame:
        """(id, n, a0, a1, ...): the document's length and the places of each atom in it, sorted.

        One scan with the words and prefixes as pushed filters, one exchange on
        the id. A word held by a large share of all documents is aggregated where
        it is read, since a document's rows of one term lie together.
        """
        exact = sorted({w for w, p in self.atoms if not p})
        prefixes = sorted({w for w, p in self.atoms if p})
        wanted = F.col("term").isin(exact) if exact else F.lit(False)
        for p in prefixes:
            wanted = wanted | F.col("term").startswith(p)
        rows = self.index.postings.where(wanted)
        shift = F.col("col").cast("long") * COLUMN
        places = F.transform(F.coalesce("positions", F.array(F.lit(0))), lambda p: p + shift)
        holds = lambda a: F.col("term").startswith(a[0]) if a[1] else F.col("term") == a[0]
        gathered = [F.sort_array(F.flatten(F.collect_list(F.when(holds(a), places)))).alias(f"a{k}") for a, k in self.atoms.items()]
        return rows.groupBy("id").agg(F.max("n").alias("n"), *gathered)

    # --- places -----------------------------------------------------------------

    def _own(self, atom: Atom, leaf: Leaf) -> Column:
        places = F.col(f"a{self.atoms[atom]}")
        if leaf.columns is None:
            return places
        return F.filter(places, lambda p: F.floor(p / COLUMN).isin(list(leaf.columns)) if leaf.columns else F.lit(False))

    def starts(self, leaf: Leaf) -> Column:
        """Where the leaf begins."""
        first, *rest = [self._own(a, leaf) for a in leaf.atoms]
        for k, places in enumerate(rest, 1):
            first = F.array_intersect(first, _back(places, k))
        return first

    def _clumps(self, close: Close) -> list[Column]:
        """The places of each operand that take part in a clump: all operands begin within reach before some place, in one column."""
        each = [(f"s{self._name(leaf)}", len(leaf.atoms)) for leaf in close.leaves]
        reach = lambda name, size, m: F.exists(F.col(name), lambda s: (s <= m) & (s >= m - size - close.distance) & (F.floor(s / COLUMN) == F.floor(m / COLUMN)))
        everywhere = F.array_distinct(F.concat(*[F.col(n) for n, _ in each]))
        heads = F.filter(everywhere, lambda m: _all([reach(n, size, m) for n, size in each]))

        def taking_part(name: str, size: int) -> Column:
            return F.filter(F.col(name), lambda s: F.exists(heads, lambda m: (s <= m) & (s >= m - size - close.distance) & (F.floor(s / COLUMN) == F.floor(m / COLUMN))))

        return [taking_part(n, size) for n, size in each]

    def _name(self, leaf: Leaf) -> int:
        return self.leaves.index(leaf)

    @property
    def leaves(self) -> list[Leaf]:
        return list(dict.fromkeys(x for i in self.items for x in (i.leaves if isinstance(i, Close) else (i,))))

    def measured(self) -> DataFrame:
        """(id, n, s*, c*_*): places of every leaf, and those of leaves within clumps."""
        rows = self.documents()
        rows = rows.select("id", "n", *[self.starts(leaf).alias(f"s{k}") for k, leaf in enumerate(self.leaves)])
        for c, close in enumerate(self.closes):
            for k, places in enumerate(self._clumps(close)):
                rows = rows.withColumn(f"c{c}_{k}", places)
        return rows

    @property
    def closes(self) -> list[Close]:
        return [i for i in self.items if isinstance(i, Close)]

    # --- trees ------------------------------------------------------------------

    def flag(self, tree: Tree) -> Column:
        if tree.kind == "leaf":
            return F.size(f"s{self._name(tree.item)}") > 0
        if tree.kind == "close":
            return F.size(f"c{self.closes.index(tree.item)}_0") > 0
        flags = [self.flag(p) for p in tree.parts]
        if tree.kind == "not":
            return flags[0] & ~flags[1]
        return _all(flags) if tree.kind == "and" else _any(flags)

    def phrases(self, tree: Tree) -> list[tuple[str, str]]:
        """(places that count, places on which the document frequency rests) of every phrase of a tree, excluded ones left out."""
        if tree.kind == "leaf":
            name = f"s{self._name(tree.item)}"
            return [(name, name)]
        if tree.kind == "close":
            c = self.closes.index(tree.item)
            return [(f"c{c}_{k}", f"s{self._name(leaf)}") for k, leaf in enumerate(tree.item.leaves)]
        parts = tree.parts[:1] if tree.kind == "not" else tree.parts
        return [x for p in parts for x in self.phrases(p)]

    def plain(self) -> dict[str, str]:
        """The leaves that are one whole word in any column, by the names of their places: the vocabulary knows how many documents hold them."""
        return {f"s{self._name(leaf)}": leaf.atoms[0][0] for leaf in self.leaves if len(leaf.atoms) == 1 and not leaf.atoms[0][1] and leaf.columns is None}

    def weighted(self, places: Column) -> Column:
        weights = list(self.index.columns.values())
        if len(set(weights)) == 1:
            return F.size(places) * F.lit(float(weights[0]))
        weight = lambda p: F.get(F.array(*[F.lit(float(w)) for w in weights]), F.floor(p / COLUMN).cast("int"))
        return F.aggregate(places, F.lit(0.0), lambda total, p: total + weight(p))

    def score(self, tree: Tree, idf: dict[str, float], norm: Column) -> Column:
        """Relevance, lower is better: phrases count only where the branch that holds them matched."""

        def of(name: tuple[str, str]) -> Column:
            f = self.weighted(F.col(name[0]))
            return F.lit(idf[name[1]]) * (f * (K1 + 1)) / (f + norm)

        def go(t: Tree) -> list[Column]:
            if t.kind in ("leaf", "close"):
                terms = [of(n) for n in self.phrases(t)]
            else:
                terms = [x for p in (t.parts[:1] if t.kind == "not" else t.parts) for x in go(p)]
            if t.kind in ("and", "or", "not"):
                return [F.when(self.flag(t), _sum(terms)).otherwise(0.0)]
            return [F.when(self.flag(t), _sum(terms)).otherwise(0.0)]

        return -go(tree)[0]


def _back(places: Column, steps: int) -> Column:
    return F.transform(places, lambda p: p - steps)


def _all(flags: list[Column]) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out & f
    return out


def _any(flags: list[Column]) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


def _sum(values: list[Column]) -> Column:
    out = values[0]
    for v in values[1:]:
        out = out + v
    return out


def idf_of(total: int, holding: int) -> float:
    """Inverse document frequency; one that would not be positive is a millionth instead."""
    import math

    value = math.log((total - holding + 0.5) / (holding + 0.5))
    return value if value > 0 else 1e-6

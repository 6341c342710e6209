"""The reader's query language: text to a tree, and the tree as a match expression.

A query is read by one pattern into items, and the items by descent:
alternatives hold conjunctions, a conjunction holds operands and exclusions.
What cannot be read so is taken as plain words, all of which must match.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import chain, groupby

WORD = re.compile(r"[^\W_]+")
HYPHENATED = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
ITEM = re.compile(r'(?P<open>\()|(?P<close>\))|(?P<comma>,)|"(?P<quoted>[^"]*)"|(?P<broken>")|(?P<minus>(?<![^\s(])-)|(?P<word>[^\s(),"]+)')
SCOPE = re.compile(r"([A-Za-z_]\w*):", re.ASCII)
DISTANCE = 10
WINDOW = 10


class Unreadable(Exception):
    """The query does not follow the grammar; never leaves this module."""


@dataclass(frozen=True)
class Node:
    def children(self) -> tuple["Node", ...]:
        return ()


@dataclass(frozen=True)
class Term(Node):
    value: str
    prefix: bool = False
    wideable: bool = True


@dataclass(frozen=True)
class Identifier(Node):
    parts: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Phrase(Node):
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Near(Node):
    operands: tuple[Node, ...]
    distance: int = DISTANCE

    def children(self):
        return self.operands


@dataclass(frozen=True)
class Scoped(Node):
    column: str
    child: Node

    def children(self):
        return (self.child,)


@dataclass(frozen=True)
class And(Node):
    operands: tuple[Node, ...]

    def children(self):
        return self.operands


@dataclass(frozen=True)
class Or(Node):
    operands: tuple[Node, ...]

    def children(self):
        return self.operands


@dataclass(frozen=True)
class Not(Node):
    left: Node
    right: Node

    def children(self):
        return (self.left, self.right)


LEAVES = (Term, Identifier, Phrase)


def leaves(node: Node) -> Iterator[Node]:
    """Leaves in the order in which they were typed, those under an exclusion last of their conjunction."""
    if isinstance(node, LEAVES):
        yield node
    for child in node.children():
        yield from leaves(child)


# --- catalogue numbers --------------------------------------------------------


# Classes of typed words, one letter each: x holds letters and digits, d is a number, s a short or capital word, o such a word
# beyond ASCII, X a joined word of letters and digits, w any other. A number may follow its letters after a space: "G 7510".
CATALOGUE = re.compile(r"[so](?=s*[dx])[sdx]+|[xX]")


def _class_of(parts: tuple[str, ...]) -> str:
    joined = "".join(parts)
    letters, digits = bool(re.search("[A-Za-z]", joined)), bool(re.search("[0-9]", joined))
    plain = len(parts) == 1 and joined.isascii()
    if letters and digits:
        return "x" if plain else "X"
    if len(parts) == 1 and letters and (joined.isupper() or len(joined) < 4):
        return "s" if plain else "o"
    return "d" if plain and digits else "w"


def runs(parts: tuple[str, ...]) -> tuple[str, ...]:
    """Runs of letters and runs of numbers, apart."""
    return tuple("".join(g) for p in parts for _, g in groupby(p, str.isalpha))


def read_words(words: list[str], word: re.Pattern = WORD) -> list[Node]:
    """Bare words as terms, with catalogue numbers recognised in one word (``G7510``) or across several (``G 7510``)."""
    held = [parts for w in words if (parts := tuple(word.findall(w)))]
    classes, out, done = "".join(map(_class_of, held)), [], 0
    for found in CATALOGUE.finditer(classes):
        out += [Term(p) for parts in held[done : found.start()] for p in parts]
        out.append(Identifier(tuple(chain(*held[found.start() : found.end()]))))
        done = found.end()
    return out + [Term(p) for parts in held[done:] for p in parts]


# --- reading ------------------------------------------------------------------


@dataclass
class Reader:
    items: list[tuple[str, str]]
    columns: tuple[str, ...]
    word: re.Pattern = WORD
    at: int = 0
    typed: list[Node] = field(default_factory=list)

    @property
    def kind(self) -> str:
        return self.items[self.at][0] if self.at < len(self.items) else "end"

    def take(self, kind: str | None = None) -> str:
        if self.kind == "end" or kind and self.kind != kind:
            raise Unreadable(kind or "something")
        self.at += 1
        return self.items[self.at - 1][1]

    def keep(self, nodes: list[Node]) -> list[Node]:
        self.typed += nodes
        return nodes

    def one(self, nodes: list[Node]) -> Node:
        if len(nodes) != 1:
            raise Unreadable("one term")
        return nodes[0]

    def alternatives(self) -> Node | None:
        options = [self.conjunction()]
        while self.kind == "or":
            self.take()
            options.append(self.conjunction())
        if len(options) > 1 and None in options[1:]:
            raise Unreadable("an alternative")
        options = [o for o in options if o is not None]
        return None if not options else options[0] if len(options) == 1 else Or(tuple(options))

    def conjunction(self) -> Node | None:
        wanted: list[Node] = []
        unwanted: list[Node] = []
        words: list[str] = []
        while self.kind not in ("end", "or", "close", "comma"):
            if self.kind == "word" and not self.operator():
                words.append(self.take())
                continue
            wanted += self.keep(read_words(words, self.word))
            words = []
            if self.kind == "minus":
                self.take()
                unwanted.append(self.operand())
            else:
                wanted.append(self.operand())
        wanted += self.keep(read_words(words, self.word))
        if not wanted:
            if unwanted:
                raise Unreadable("a term to exclude from")
            return None
        node = wanted[0] if len(wanted) == 1 else And(tuple(wanted))
        for u in unwanted:
            node = Not(node, u)
        return node

    def operator(self) -> bool:
        text = self.items[self.at][1]
        opened = self.at + 1 < len(self.items) and self.items[self.at + 1][0] == "open"
        return bool(SCOPE.match(text)) or opened and text.lower() == "near"

    def operand(self) -> Node:
        kind = self.kind
        if kind == "quoted":
            return self.phrase()
        if kind == "open":
            self.take()
            node = self.alternatives()
            self.take("close")
            if node is None:
                raise Unreadable("a group")
            return node
        text = self.take("word")
        if text.lower() == "near" and self.kind == "open":
            return self.near()
        if scope := SCOPE.match(text):
            if scope[1] not in self.columns:
                raise Unreadable("a column")
            rest = text[scope.end() :]
            return Scoped(scope[1], self.one(self.keep(read_words([rest], self.word))) if rest else self.operand())
        return self.one(self.keep(read_words([text], self.word)))

    def phrase(self) -> Node:
        terms = tuple(self.word.findall(self.take("quoted")))
        if not terms:
            raise Unreadable("words in quotes")
        return self.keep([Phrase(terms)])[0]

    def near(self) -> Node:
        self.take("open")
        operands: list[Node] = []
        while self.kind in ("word", "quoted"):
            if self.kind == "quoted":
                operands.append(self.phrase())
                continue
            parts = tuple(self.word.findall(self.take()))
            if not parts:
                raise Unreadable("a word")
            operands += self.keep([Term(parts[0], wideable=False) if len(parts) == 1 else Phrase(parts)])
        distance = DISTANCE
        if self.kind == "comma":
            self.take()
            if not re.fullmatch(r"[0-9]+", number := self.take("word")):
                raise Unreadable("a number")
            distance = int(number)
        self.take("close")
        if len(operands) < 2:
            raise Unreadable("two operands")
        return Near(tuple(operands), distance)


def _narrow(node: Node) -> Node:
    """The tree with nothing wideable beneath a scope."""
    match node:
        case Scoped(column, child):
            return Scoped(column, _plain(child))
        case And(operands) | Or(operands):
            return type(node)(tuple(map(_narrow, operands)))
        case Not(left, right):
            return Not(_narrow(left), _narrow(right))
    return node


def _plain(node: Node) -> Node:
    match node:
        case Term():
            return replace(node, wideable=False)
        case Scoped(column, child):
            return Scoped(column, _plain(child))
        case And(operands) | Or(operands):
            return type(node)(tuple(map(_plain, operands)))
        case Not(left, right):
            return Not(_plain(left), _plain(right))
    return node


def _open_end(node: Node, last: Node) -> Node:
    """The tree in which the leaf typed last stands for all words it begins."""
    if node is last:
        if isinstance(node, Identifier) or isinstance(node, Term) and len(node.value) > 1:
            return replace(node, prefix=True)
        return node
    match node:
        case Near(operands, distance):
            return Near(tuple(_open_end(o, last) for o in operands), distance)
        case And(operands) | Or(operands):
            return type(node)(tuple(_open_end(o, last) for o in operands))
        case Scoped(column, child):
            return Scoped(column, _open_end(child, last))
        case Not(left, right):
            return Not(_open_end(left, last), _open_end(right, last))
    return node


def parse(text: str, columns: tuple[str, ...] = ("title", "body"), typing: bool = True, hyphenated: bool = False) -> Node | None:
    """The tree of a query; None if it holds no word. ``typing``: the last word may still be growing. ``hyphenated``: words joined by hyphens are one."""
    word = HYPHENATED if hyphenated else WORD
    text = ud.normalize("NFC", text)
    items = [("or" if m.lastgroup == "word" and m[0] == "OR" else m.lastgroup or "quoted", m[m.lastgroup] if m.lastgroup else "") for m in ITEM.finditer(text)]
    reader = Reader(items, tuple(columns), word)
    try:
        if any(k == "broken" for k, _ in items):
            raise Unreadable("a closing quote")
        node = reader.alternatives()
        if reader.kind != "end":
            raise Unreadable("the end")
        typed = reader.typed
    except Unreadable:
        typed = read_words(text.split(), word)
        node = None if not typed else typed[0] if len(typed) == 1 else And(tuple(typed))
    if node is None:
        return None
    return _narrow(_open_end(node, typed[-1]) if typing else node)


# --- match expressions --------------------------------------------------------

Lookup = Callable[[str], "list[str] | None"]


def spellings(node: Identifier) -> list[tuple[str, ...]]:
    """The ways in which a catalogue number may be written: in one, as typed, in runs of letters and digits."""
    return list(dict.fromkeys([("".join(node.parts),), node.parts, runs(node.parts)]))


def _quoted(word: str, prefix: bool = False) -> str:
    return '"' + word.replace('"', '""') + '"' + "*" * prefix


def emit(node: Node, widen: Lookup | None = None, correct: Lookup | None = None, positions: bool = True, grow_corrected: bool = True) -> str:
    """The tree as a match expression; without ``positions`` adjacency becomes conjunction. A word with corrections goes on as one without does, unless ``grow_corrected`` is false."""

    def adjacent(words: tuple[str, ...], prefix: bool = False) -> str:
        each = [_quoted(w, prefix) for w in words]
        if positions or len(each) == 1:
            return " + ".join(each)
        return "(" + " AND ".join(each) + ")"

    def choice(options: list[str]) -> str:
        return options[0] if len(options) == 1 else "(" + " OR ".join(options) + ")"

    def inner(child: Node, loose: tuple, guess: Lookup | None) -> str:
        text = show(child, guess)
        return f"({text})" if isinstance(child, loose) or isinstance(child, Near) and not positions else text

    def show(n: Node, guess: Lookup | None) -> str:
        match n:
            case Term(value, prefix, wideable):
                guessed = (guess and guess(value)) or [] if wideable else []
                forms = [value, *((widen and widen(value)) or [] if wideable else []), *guessed]
                return choice([_quoted(f, prefix and (grow_corrected or not guessed)) for f in forms])
            case Identifier(_, prefix):
                return choice([adjacent(s, prefix) for s in spellings(n)])
            case Phrase(terms):
                return adjacent(terms)
            case Near(operands, distance):
                each = [emit(o, positions=positions) for o in operands]
                return f"NEAR({' '.join(each)}, {distance})" if positions else " AND ".join(each)
            case Scoped(column, child):
                return f"{{{column}}}:{inner(child, (Or, And, Not), guess)}"
            case And(operands):
                return " AND ".join(inner(o, (Or,), guess) for o in operands)
            case Or(operands):
                return " OR ".join(show(o, guess) for o in operands)
            case Not(left, right):
                return f"{inner(left, (Or, And, Not), guess)} NOT {inner(right, (Or, And, Not), None)}"
        raise TypeError(n)

    return show(node, correct)


def _bare(node: Node) -> tuple[Term, ...]:
    """The words that a part of a conjunction puts in a row: a term, or the parts of a catalogue number, of which the last may go on."""
    match node:
        case Term(value, prefix):
            return (Term(value, prefix, False),)
        case Identifier((*first, last), prefix):
            return (*(Term(p, False, False) for p in first), Term(last, prefix, False))
    return ()


def proximity(node: Node) -> tuple[Phrase, Near] | None:
    """The bare words of a conjunction as a phrase, and near each other; None for fewer than two or another root. Exclusions do not count."""
    match node:
        case Not(left, _):
            return proximity(left)
        case And(operands) if len(words := tuple(chain.from_iterable(map(_bare, operands)))) > 1:
            return Phrase(tuple(w.value for w in words)), Near(words, max(WINDOW, 2 * len(words)) - 2)
    return None

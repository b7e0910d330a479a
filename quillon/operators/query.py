"""Query language: text to a small tree, and the tree to predicates.

``a b`` (OR), AND, OR, NOT, ``+a -b``, grouping, ``field:value``, phrases, ``ab*``, ``a?c``, ``a~1``,
``[a TO b]`` and ``{a TO b}``.  NOT binds tightest, then AND, then OR; ``+`` and ``-`` work inside a
group as must and must-not, where plain neighbours are then optional.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import analysis


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Term:
    text: str
    field: str | None = None
    kind: str = "term"  # term, phrase, prefix, wildcard, fuzzy
    edits: int = 2


@dataclass(frozen=True)
class Range:
    low: str
    high: str
    inclusive: tuple[bool, bool]
    field: str | None = None


@dataclass(frozen=True)
class Every:
    pass


@dataclass(frozen=True)
class Bool:
    must: tuple = ()
    should: tuple = ()
    none: tuple = ()


@dataclass
class Fields:
    """Where a field's text is: name -> (column, analyzer); ``longs`` are numeric."""

    analyzers: dict[str, str]
    longs: set[str] = field(default_factory=set)
    default: tuple[str, ...] = ("content",)
    restricted: tuple[str, ...] = ("access",)
    leading_wildcards: bool = False


_TOKEN = re.compile(r"""\s*(?:(?P<op>\(|\)|&&|\|\||[+!-](?=\S))|(?P<range>[\[{].+?\sTO\s.+?[\]}])|(?P<phrase>"(?:[^"\\]|\\.)*")|(?P<word>(?:\\.|[^\s()"\[\]{}])+))""")


def _tokens(text: str) -> list[tuple[str, str]]:
    out, i = [], 0
    while i < len(text.rstrip()):
        m = _TOKEN.match(text, i)
        if not m:
            raise QueryError(f"can't read the query from {text[i:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        i = m.end()
        # field:(...), field:"..." and field:[...] come as a word that ends with a colon
    return out


class _Parser:
    def __init__(self, text: str, fields: Fields):
        self.tokens, self.at, self.fields = _tokens(text), 0, fields

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def group(self, name: str | None):
        clauses = [self.both(name)]
        while self.peek()[0] and self.peek()[1] != ")":
            if self.peek()[1] in ("OR", "||"):
                self.at += 1
            clauses.append(self.both(name))
        must = tuple(c for s, c in clauses if s == "+")
        none = tuple(c for s, c in clauses if s == "-")
        should = tuple(c for s, c in clauses if s == "")
        if len(should) == 1 and not must and not none:
            return should[0]
        return Bool(must, should, none)

    def both(self, name):
        parts = [self.unary(name)]
        while self.peek()[1] in ("AND", "&&"):
            self.at += 1
            parts.append(self.unary(name))
        if len(parts) == 1:
            return parts[0]
        return "", Bool(tuple(c for s, c in parts if s != "-"), (), tuple(c for s, c in parts if s == "-"))

    def unary(self, name):
        kind, text = self.peek()
        if text in ("NOT", "!", "-", "+"):
            self.at += 1
            return "+" if text == "+" else "-", self.unary(name)[1]
        return "", self.primary(name)

    def primary(self, name):
        kind, text = self.peek()
        if kind is None or text in (")", "AND", "OR", "&&", "||"):
            raise QueryError("a clause is missing")
        self.at += 1
        if text == "(":
            inner = self.group(name)
            if self.peek()[1] != ")":
                raise QueryError("an open group")
            self.at += 1
            return inner
        if kind == "range":
            m = re.fullmatch(r"([\[{])\s*(.+?)\s+TO\s+(.+?)\s*([\]}])", text)
            return Range(m[2].strip('"'), m[3].strip('"'), (m[1] == "[", m[4] == "]"), name)
        if kind == "phrase":
            return Term(re.sub(r"\\(.)", r"\1", text[1:-1]), name, "phrase")
        if m := re.fullmatch(r"((?:\\.|[^:\\])+):(.*)", text):
            own = re.sub(r"\\(.)", r"\1", m[1])
            if own in self.fields.restricted:
                raise QueryError(f"{own} can't be searched")
            if own == "*" and m[2] == "*":
                return Every()
            if m[2]:
                return self.word(m[2], own)
            return self.primary(own)
        return self.word(text, name)

    def word(self, text: str, name: str | None):
        if m := re.fullmatch(r"(.+)~(\d(?:\.\d+)?)?", text):
            return Term(m[1], name, "fuzzy", min(2, int(float(m[2]))) if m[2] else 2)
        bare = re.sub(r"\\.", "", text)
        if "*" in bare or "?" in bare:
            if bare[0] in "*?" and len(text) > 1 and not self.fields.leading_wildcards:
                raise QueryError("a wildcard can't come first")
            return Term(text[:-1], name, "prefix") if re.fullmatch(r"[^*?\\]+\*", text) else Term(text, name, "wildcard")
        return Term(re.sub(r"\\(.)", r"\1", text), name)


def parse(text: str | None, fields: Fields):
    """A blank query is every row."""
    if not (text or "").strip() or text.strip() in ("*", "*:*"):
        return Every()
    p = _Parser(text, fields)
    tree = p.group(None)
    if p.at < len(p.tokens):
        raise QueryError(f"can't read {p.tokens[p.at][1]!r}")
    return tree


def terms_of(tree, expanding: bool = False) -> list[str]:
    """Positive terms, for ranking and snippets."""
    if isinstance(tree, Term):
        return [tree.text] if tree.kind in ("term", "phrase", "fuzzy") else []
    if isinstance(tree, Bool):
        return [t for c in (*tree.must, *tree.should) for t in terms_of(c)]
    return []


def expand(tree, rows: dict[str, tuple[set[str], set[str]]], limit: int = 1000, fields: tuple[str, ...] = (None, "content")):
    """(tree, synonyms, descendants, too many): terms of expanded fields get their synonyms and descendants beside them.

    ``rows``: term -> (synonyms, descendants).  Prefix and wildcard terms stay; a query that would
    get more than ``limit`` terms stays as it is.
    """
    synonyms, below = set(), set()

    def walk(t):
        if isinstance(t, Bool):
            return replace(t, must=tuple(map(walk, t.must)), should=tuple(map(walk, t.should)), none=tuple(map(walk, t.none)))
        if not isinstance(t, Term) or t.kind in ("prefix", "wildcard") or t.field not in fields or t.text.lower() not in rows:
            return t
        same, under = rows[t.text.lower()]
        own = {s for s in same if s.lower() != t.text.lower()}
        synonyms.update(own)
        below.update(under)
        return Bool(should=(t, *(Term(s, t.field, "phrase" if " " in s else "term") for s in sorted(own | under))))

    new = walk(tree)
    if len(synonyms) + len(below) > limit:
        return tree, set(), set(), True
    return new, synonyms, below, False


def predicate(tree, fields: Fields) -> Column:
    """A boolean column over the rows; null fields don't match."""
    if isinstance(tree, Every):
        return F.lit(True)
    if isinstance(tree, Bool):
        parts = [predicate(c, fields) for c in tree.must]
        if tree.should and not tree.must:
            parts.append(_any([predicate(c, fields) for c in tree.should]))
        parts += [~predicate(c, fields) for c in tree.none]
        out = parts[0] if parts else F.lit(False)
        for p in parts[1:]:
            out = out & p
        return out if tree.must or tree.should else F.lit(False)  # a query of exclusions alone finds nothing
    names = (tree.field,) if tree.field else fields.default
    return _any([F.coalesce(_leaf(tree, n, fields), F.lit(False)) for n in names])


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def _number(text: str, name: str) -> int | None:
    if text == "*":
        return None
    try:
        return int(text)
    except ValueError:
        raise QueryError(f"{name} is a number") from None


def _leaf(t, name: str, fields: Fields) -> Column:
    column = F.col(f"`{name}`")
    if isinstance(t, Range):
        if name in fields.longs:
            low, high = _number(t.low, name), _number(t.high, name)
            out = column.isNotNull()
            if low is not None:
                out = out & (column >= low if t.inclusive[0] else column > low)
            if high is not None:
                out = out & (column <= high if t.inclusive[1] else column < high)
            return out
        low, high = t.low.lower(), t.high.lower()

        def inside(x: Column) -> Column:
            out = F.lit(True)
            if low != "*":
                out = out & (x >= low if t.inclusive[0] else x > low)
            if high != "*":
                out = out & (x <= high if t.inclusive[1] else x < high)
            return out

        return F.exists(token_column(name, fields), inside)
    if name in fields.longs:
        return column == _number(t.text, name)
    own = token_column(name, fields)
    if t.kind == "prefix":
        return F.exists(own, lambda x: x.startswith(analysis.folded(t.text).lower()))
    if t.kind == "wildcard":
        return F.exists(own, lambda x: x.rlike(analysis.pattern(analysis.folded(t.text))))
    words = analyzed(t.text, fields.analyzers.get(name, "attribute"))
    if t.kind == "fuzzy":
        return F.exists(own, lambda x: F.levenshtein(x, F.lit(analysis.folded(t.text).lower()), t.edits) >= 0)
    if not words:
        return F.lit(False)
    if len(words) == 1:
        return F.array_contains(own, words[0])
    # a phrase: its tokens stand consecutively
    return F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" ")).contains(" " + " ".join(words) + " ")


def token_column(name: str, fields: Fields) -> Column:
    kind = fields.analyzers.get(name, "attribute")
    return analysis.tokens(F.col(f"`{name}`"), kind) if kind != "tokens" else F.col(f"`{name}`")


def analyzed(text: str, analyzer: str) -> list[str]:
    """What the column expressions make of a query's text, on the driver: the same folding and the same token pattern."""
    import regex

    if analyzer == "keyword":
        return [text]
    pattern = analysis.TOKENS["experiment" if analyzer == "tokens" else analyzer]
    text = text if analyzer == "letters" else analysis.folded(text)
    return [w for w in regex.findall(pattern, text.lower()) if analyzer == "letters" or w not in analysis.STOP_WORDS]

"""Analyzers: text columns to arrays of tokens, in built-in functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that indexing ignores.
STOP_WORDS = "a,an,and,are,as,at,be,but,by,for,if,in,into,is,it,no,not,of,on,or,such,that,the,their,then,there,these,they,this,to,was,will,with".split(",")


def _bare(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))


#: Latin letters (to U+024F, and U+1E00 to U+1EFF) that are one ASCII letter with marks, those letters, and the
#: combining marks (U+0300 to U+036F), which go.  Queries and columns fold by the same tables.
_PLAIN = "".join(c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(_bare(c)) == 1 and _bare(c).isascii())
_FOLDED = "".join(map(_bare, _PLAIN))
_MARKS = "".join(map(chr, range(0x300, 0x370)))
#: Letters that aren't a letter with marks.
_DOUBLE = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "TH", "ħ": "h", "Ħ": "H", "ı": "i"}
TOKENS = {
    "experiment": r"[\p{L}\p{Nd}-]+",
    "attribute": r"[^\s,;()]+",
    "access": r"[\p{L}\p{Nd}@.~#_-]+",
    "letters": r"\p{L}+",
}


def fold(c: Column, extended: bool = True) -> Column:
    """Accented Latin letters without their accents; ``extended`` also spells out ligatures and sharp s.  ASCII alone stays as it is."""
    single = {a: b for a, b in _DOUBLE.items() if len(b) == 1} if extended else {}
    out = F.translate(c, _PLAIN + "".join(single) + _MARKS, _FOLDED + "".join(single.values()))
    for a, b in _DOUBLE.items() if extended else ():
        if a not in single:
            out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(out)


def folded(text: str) -> str:
    """``fold`` of a query's text, on the driver."""
    return text.translate({**{ord(a): b for a, b in zip(_PLAIN, _FOLDED, strict=True)}, **{ord(m): None for m in _MARKS}, **{ord(a): b for a, b in _DOUBLE.items()}})


def tokens(c: Column, analyzer: str = "experiment", folded: bool = True, stops: list[str] | None = None) -> Column:
    """array<string> of a column's tokens; null for null.  ``keyword`` is the whole value."""
    if analyzer == "keyword":
        return F.when(c.isNotNull(), F.array(c))
    if analyzer == "letters":
        return F.regexp_extract_all(F.lower(c), F.lit(TOKENS["letters"]), F.lit(0))
    found = F.regexp_extract_all(F.lower(fold(c) if folded else c), F.lit(TOKENS[analyzer]), F.lit(0))
    stops = STOP_WORDS if stops is None else stops
    return F.filter(found, lambda t: ~t.isin(stops)) if stops else found


def pattern(term: str) -> str:
    """A wildcard term (``*``, ``?``, backslash escapes) as a regular expression over whole lower-case tokens."""
    import re

    out, i, term = "^", 0, term.lower()
    while i < len(term):
        if term[i] == "\\" and i + 1 < len(term):
            i += 1
            out += re.escape(term[i])
        else:
            out += {"*": ".*", "?": "."}.get(term[i], re.escape(term[i]))
        i += 1
    return out + "$"


def normalise(text: str | None) -> str:
    """For matching with an ontology: compatibility forms without marks, lower case, single spaces for all but letters and digits."""
    text = unicodedata.normalize("NFKD", text or "")
    kept = "".join(" " if not (c.isalnum()) else c for c in "".join(c for c in text if not unicodedata.category(c).startswith("M")).lower())
    return " ".join(kept.split())


def cleaned(c: Column) -> Column:
    """Expansion keys: lower case, everything but digits, word characters and hyphens a space."""
    return F.lower(F.regexp_replace(c, r"[^\d\w-]", " "))

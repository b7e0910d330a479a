"""The declarative schema: collections of typed properties with their extractors, loaded from JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from quillon.functions.jsonpath import compile_path

TYPES = ("tokenized_string", "untokenized_string", "long", "facet")
ANALYZERS = {"AttributeFieldAnalyzer": "attribute", "ExperimentTextAnalyzer": "experiment", "AccessFieldAnalyzer": "access"}


@dataclass(frozen=True)
class Property:
    name: str
    type: str
    title: str = ""
    analyzer: str = "attribute"
    paths: tuple[str, ...] = ()
    sortable: bool = False
    multi_valued: bool = True
    facet_type: str = ""
    na_visible: bool = False
    parser: str = ""
    retrieved: bool = False
    expanded: bool = False
    lower: bool = False
    default: str | None = None
    private: bool = False
    match: str = ""


@dataclass
class Registry:
    collections: dict[str, dict[str, Property]] = field(default_factory=dict)

    def properties(self, names: list[str] = ()) -> dict[str, Property]:
        """Public properties, then those of the named collections (any case; unknown names are skipped)."""
        own = {k.lower(): v for k, v in self.collections.items()}
        out = dict(own.get("public", {}))
        for n in names:
            out |= own.get(n.lower(), {})
        return out

    def find(self, name: str) -> Property | None:
        return next((p[name] for p in self.collections.values() if name in p), None)


def _truth(x, default: bool = False) -> bool:
    return default if x is None else str(x).lower() == "true"


def _property(x: dict) -> Property:
    from quillon.operators.ingest import PARSERS

    name, kind = (x.get("name") or "").strip(), str(x.get("fieldType") or "").lower()
    if not name or not kind:
        raise ValueError("a property needs a name and a fieldType")
    if kind not in TYPES:
        raise ValueError(f"{name}: no such fieldType: {kind}")
    analyzer = {k.lower(): v for k, v in ANALYZERS.items()}.get(str(x.get("analyzer") or "AttributeFieldAnalyzer").lower())
    if not analyzer:
        raise ValueError(f"{name}: no such analyzer: {x['analyzer']}")
    parser = x.get("parser") or ("JPathListParser" if x.get("jsonPaths") else "SimpleAttributeParser")
    if parser not in PARSERS:
        raise ValueError(f"{name}: no such parser: {parser}")
    for p in x.get("jsonPaths") or ():
        compile_path(p)
    return Property(
        name, kind, x.get("title") or "", analyzer, tuple(x.get("jsonPaths") or ()), _truth(x.get("sortable")), _truth(x.get("multiValued"), True), str(x.get("facetType") or "").lower(),
        _truth(x.get("naVisible")), parser, _truth(x.get("retrieved")), _truth(x.get("expanded")), _truth(x.get("toLowerCase")), x.get("defaultValue"), _truth(x.get("private")), x.get("match") or "",
    )


def parse(text: str | None) -> Registry:
    """Validates on load; property names are unique across collections (within one, the last wins)."""
    if not (text or "").strip():
        raise ValueError("an empty registry")
    data = json.loads(text)
    if not data:
        raise ValueError("a registry without collections")
    out, seen = Registry(), {}
    for c in data:
        own = {p.name: p for p in map(_property, c.get("properties") or ())}
        for n in own:
            if n in seen:
                raise ValueError(f"{n} is in {seen[n]} and {c['collectionName']}")
            seen[n] = c["collectionName"]
        out.collections[c["collectionName"]] = own
    return out


def load(path: str) -> Registry:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())

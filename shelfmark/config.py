"""The declaration of a site: sources, search columns, fields, boosts, synonyms. Closed: whatever is not known is an error."""

from __future__ import annotations

import hashlib
import json
import math
import re
from dataclasses import dataclass, field

from shelfmark.errors import BuildError
from shelfmark.operators.boosts import RecencyBoost, ValueBoost
from shelfmark.operators.filters import Field, Fields
from shelfmark.operators.variants import declared_groups
from shelfmark.sources.html import Source

NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")
RESERVED = {"title", "body", "rowid", "rank"}
TYPES = {"facets": {"string", "string_array", "integer", "number", "boolean", "date"}, "store": {"string", "integer", "number", "boolean", "date", "json"}, "sort": {"string", "integer", "number", "date"}}
KEYS = {"base_url", "input", "include", "exclude", "selectors", "search_fields", "weights", "facets", "store_fields", "sort_fields", "boosts", "synonyms", "suppressions", "composite_indices", "positions", "result_fields", "variant_generation", "allow_output_in_source"}
WEIGHTS = {"title": 10.0, "body": 1.0}
SELECTORS = {"title": "title, h1", "description": "meta[name='description']@content", "body": "body"}


def _fail(message: str) -> None:
    raise BuildError("CONFIG_INVALID", message)


@dataclass
class Config:
    base_url: str = "/"
    input: str = "html"
    include: tuple[str, ...] = ("**/*.html",)
    exclude: tuple[str, ...] = ()
    selectors: dict[str, str] = field(default_factory=dict)
    columns: dict[str, float] = field(default_factory=dict)
    column_sources: dict[str, str] = field(default_factory=dict)
    body_extra: tuple[str, ...] = ()
    fields: Fields = field(default_factory=Fields)
    sources: dict[str, str] = field(default_factory=dict)
    required: frozenset[str] = frozenset()
    boosts: tuple = ()
    synonyms: list[list[str]] = field(default_factory=list)
    suppressions: list[list[str]] = field(default_factory=list)
    composite: list[list[str]] = field(default_factory=list)
    positions: bool = True
    variant_generation: bool = True
    result_fields: tuple[str, ...] = ()
    output_in_source: bool = False

    def described(self) -> dict:
        """What a reader of the index must know: types and roles of fields, boosts, synonyms, and the declaration's fingerprint."""
        fields = {n: {"role": f.role, "type": f.type, "required": n in self.required} for n, f in self.fields.items()}
        return {"fields": fields, "boosts": [repr(b) for b in self.boosts], "synonyms": self.synonyms, "suppressions": self.suppressions, "fingerprint": self.fingerprint}

    @property
    def fingerprint(self) -> str:
        shown = {k: v for k, v in vars(self).items() if k not in ("boosts", "fields", "required")}
        shown |= {"fields": {n: [f.role, f.type] for n, f in sorted(self.fields.items())}, "boosts": [repr(b) for b in self.boosts], "required": sorted(self.required)}
        return hashlib.sha256(json.dumps(shown, sort_keys=True, default=list).encode()).hexdigest()


def load(raw: dict, as_of: str = "2025-01-01") -> Config:
    """A checked declaration. ``as_of`` is the day from which recency boosts count."""
    if unknown := set(raw) - KEYS:
        _fail(f"unknown key {sorted(unknown)[0]!r}")
    kind = raw.get("input", "html")
    if kind not in ("html", "records"):
        _fail(f"input must be html or records, not {kind!r}")
    selectors = raw.get("selectors", {})
    if unknown := set(selectors) - set(SELECTORS):
        _fail(f"unknown selector {sorted(unknown)[0]!r}")
    selectors = SELECTORS | selectors
    for s in selectors.values():
        Source.read(s)
    columns, column_sources, extra = dict(WEIGHTS), {}, []
    for entry in raw.get("search_fields", []):
        if isinstance(entry, str) and kind == "html":
            extra.append(entry)
            continue
        name, source = (entry, "") if isinstance(entry, str) else (entry.get("name"), entry.get("source", ""))
        if not isinstance(name, str) or not NAME.fullmatch(name) or name in RESERVED or name in columns:
            _fail(f"bad search field {name!r}")
        if kind == "html":
            Source.read(source)
        columns[name], column_sources[name] = 1.0, source
    for name, weight in raw.get("weights", {}).items():
        if name not in columns:
            _fail(f"weight of unknown column {name!r}")
        if isinstance(weight, bool) or not isinstance(weight, (int, float)) or not math.isfinite(weight) or weight < 0:
            _fail(f"weight of {name!r} must be a finite number of at least 0")
        columns[name] = float(weight)
    fields, sources, required = Fields(), {}, set()
    for section, role in (("facets", "facet"), ("store_fields", "store"), ("sort_fields", "sort")):
        if role == "sort" and raw.get(section) and kind != "records":
            _fail("sort fields need records")
        for name in sorted(raw.get(section, {})):
            spec = raw[section][name]
            spec = {"source": spec} if isinstance(spec, str) else dict(spec)
            if unknown := set(spec) - {"source", "type", "required"}:
                _fail(f"unknown key {sorted(unknown)[0]!r} of {name!r}")
            if not NAME.fullmatch(name) or name in fields or name in {"id", "url", "title", "description"}:
                _fail(f"bad field name {name!r}")
            type_ = spec.get("type", "string")
            if type_ not in TYPES[{"facet": "facets", "store": "store", "sort": "sort"}[role]]:
                _fail(f"{name!r} cannot be a {role} field of type {type_!r}")
            if kind == "html":
                Source.read(spec.get("source", ""))
            fields[name], sources[name] = Field(role, type_), spec.get("source", "")
            if spec.get("required"):
                required.add(name)
    boosts = []
    for name in sorted(raw.get("boosts", {})):
        spec = raw["boosts"][name]
        facet = fields.get(name)
        if facet is None or facet.role != "facet" or facet.type == "string_array":
            _fail(f"boost of {name!r}, which is no scalar facet")
        if set(spec) not in ({"values"}, {"recency"}):
            _fail(f"boost of {name!r} needs either values or recency")
        if "values" in spec:
            if not spec["values"] or any(isinstance(m, bool) or not isinstance(m, (int, float)) or not math.isfinite(m) or m <= 0 for m in spec["values"].values()):
                _fail(f"multipliers of {name!r} must be finite and positive")
            cast = {"integer": int, "number": float, "boolean": lambda v: str(v).lower() in ("true", "1", "yes", "y", "on")}.get(facet.type, str)
            boosts.append(ValueBoost(name, tuple((cast(v), float(m)) for v, m in spec["values"].items())))
        else:
            most, half = spec["recency"].get("max", 2.0), spec["recency"].get("half_life_days", 730.0)
            if facet.type != "date" or most < 1 or half <= 0:
                _fail(f"recency of {name!r} needs a date, a maximum of at least 1 and a positive half-life")
            boosts.append(RecencyBoost(name, as_of, float(most), float(half)))
    composite = raw.get("composite_indices", [])
    for group in composite:
        if len(group) < 2 or any(n not in fields or fields[n].role != "facet" or fields[n].type == "string_array" for n in group):
            _fail(f"a composite index needs two or more scalar facets, not {group!r}")
    known = {"id", "url", "title", "description", *fields}
    if bad := [n for n in raw.get("result_fields", []) if n not in known]:
        _fail(f"unknown result field {bad[0]!r}")
    synonyms, suppressions = list(raw.get("synonyms", [])), list(raw.get("suppressions", []))
    declared_groups(synonyms, "synonym")
    declared_groups(suppressions, "suppression")
    return Config(raw.get("base_url", "/"), kind, tuple(raw.get("include", ("**/*.html",))), tuple(raw.get("exclude", ())), selectors, columns, column_sources, tuple(extra), fields, sources, frozenset(required), tuple(boosts), synonyms, suppressions, composite, bool(raw.get("positions", True)), bool(raw.get("variant_generation", True)), tuple(raw.get("result_fields", ())), bool(raw.get("allow_output_in_source", False)))

"""Query primitives: a small, JSON-serialisable language of retrieval plans."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from typing import Any

#: Kinds of primitives with their fields; a trailing ``?`` marks an optional one. Fixed values.
KINDS: dict[str, tuple[str, ...]] = {
    "TERM": ("value",), "PHRASE": ("value",), "OR_GROUP": ("primitives",), "SET_TERM_MODE": ("mode",), "EXCLUDE_TERM": ("value",), "EXCLUDE_PHRASE": ("value",),
    "WITHIN_RESULT_SET": ("result_set_id",), "EXCLUDE_RESULT_SET": ("result_set_id",), "FILTER_COLLECTION": ("slug",), "FILTER_DOCUMENT": ("document_id",),
    "FILTER_DATE_RANGE": ("start?", "end?"), "INTERSECT_DATE_WINDOWS": ("entity_a", "entity_b"), "FILTER_COUNTRY": ("country",), "WITHIN_COUNTRY": ("country",), "FILTER_CITY": ("city", "country?"), "FILTER_REGION": ("region", "country?"), "FILTER_COORDINATES": ("lat", "lng", "radius_km"),
    "ENTITY": ("entity_id",), "EXCEPT_ENTITIES": ("entity_ids",), "NOT_ENTITY": ("entity_id",), "ENTITY_ROLE": ("role", "entity_id?"), "CO_OCCURS_WITH": ("entity_a", "entity_b", "window?"), "CO_LOCATED": ("entity_a", "entity_b", "scope?"), "RELATION_EVIDENCE": ("entity_a", "entity_b"),
    "MENTIONS": ("entity_id", "after_rank?", "limit?"), "FIRST_MENTION": ("entity_id",), "FIRST_CO_MENTION": ("entity_ids",), "DATE_RANGE_FILTER": ("start?", "end?", "time_basis?"), "DATE_MENTIONS": ("start?", "end?"), "FIRST_DATE_MENTION": ("entity_id",), "PLACE_MENTIONS": ("entity_id",), "RELATED_PLACES": ("entity_id", "window?"), "RELATED_ENTITIES": ("entity_id", "window?"),
    "COUNT": ("group_by?",), "GROUP_BY": ("field",), "REQUIRE_EVIDENCE": ("in_lexical?", "in_vector?"), "TOGGLE_CONCORDANCE_EXPANSION": ("enabled",), "SPEAKER_FILTER": ("speakers", "mode?"), "SPEAKER_BOOST": ("speakers", "weight"), "QUOTE_ATTRIBUTION_MODE": ("enabled",),
    "SET_TOP_K": ("k",), "SET_SEARCH_TYPE": ("search_type",), "SET_QUERY_MODE": ("mode",), "SET_RETRIEVAL_MODE": ("mode",), "SET_SIMILARITY_THRESHOLD": ("threshold",),
}
#: Where a kind stands in the canonical order: what is searched, then scope, then control.
_ORDER = {kind: i for i, kind in enumerate(KINDS)}


@dataclass(frozen=True)
class Primitive:
    """One primitive; its arguments are checked against its kind."""

    kind: str
    args: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown primitive {self.kind!r}")
        fields = KINDS[self.kind]
        needed = {f for f in fields if not f.endswith("?")}
        if missing := needed - self.args.keys():
            raise ValueError(f"{self.kind} needs {sorted(missing)}")
        if extra := self.args.keys() - {f.rstrip("?") for f in fields}:
            raise ValueError(f"{self.kind} has no {sorted(extra)}")
        ids = [v for k, v in self.args.items() if k in ("entity_id", "entity_a", "entity_b") and v is not None] + list(self.args.get("entity_ids") or [])
        if any(not isinstance(v, int) or v <= 0 for v in ids):
            raise ValueError(f"{self.kind}: entity ids are positive integers")
        if self.kind in ("CO_OCCURS_WITH", "CO_LOCATED", "RELATION_EVIDENCE") and self.args["entity_a"] == self.args["entity_b"]:
            raise ValueError(f"{self.kind} needs two different entities")
        if self.kind == "FIRST_CO_MENTION" and len(set(self.args["entity_ids"])) < 2:
            raise ValueError("FIRST_CO_MENTION needs two different entities")

    def __getattr__(self, name: str) -> Any:
        if name in (f.rstrip("?") for f in KINDS[object.__getattribute__(self, "kind")]):
            return self.args.get(name)
        raise AttributeError(name)

    def to_json(self) -> dict[str, Any]:
        plain = lambda v: [x.to_json() if isinstance(x, Primitive) else x for x in v] if isinstance(v, (list, tuple)) else v
        return {"type": self.kind} | {k: plain(v) for k, v in sorted(self.args.items()) if v is not None}

    @classmethod
    def from_json(cls, data: dict[str, Any]) -> Primitive:
        args = {k: v for k, v in data.items() if k != "type"}
        if data["type"] == "CO_OCCURS_WITH" and "other_entity_id" in args:  # the earlier form
            args["entity_a"], args["entity_b"] = args.pop("entity_id"), args.pop("other_entity_id")
        if "primitives" in args:
            args["primitives"] = [cls.from_json(x) for x in args["primitives"]]
        return cls(data["type"], args)


def primitive(kind: str, **args: Any) -> Primitive:
    return Primitive(kind, args)


def canonical(plan: list[Primitive]) -> list[Primitive]:
    """The plan in an order that doesn't depend on how it was written; repeats drop out."""
    own = {json.dumps(p.to_json(), sort_keys=True): p for p in plan}
    return [p for _, p in sorted(own.items(), key=lambda kv: (_ORDER[kv[1].kind], kv[0]))]


def dumps(plan: list[Primitive]) -> str:
    return json.dumps([p.to_json() for p in plan], sort_keys=True)


def loads(text: str) -> list[Primitive]:
    return [Primitive.from_json(x) for x in json.loads(text)]


def plan_hash(plan: list[Primitive]) -> str:
    """sha256 of the canonical plan: equal plans, however written, have one hash."""
    return hashlib.sha256(dumps(canonical(plan)).encode()).hexdigest()


def patch(plan: list[Primitive], remove: dict[str, Any] | None = None, add: list[Primitive] = (), replace: list[tuple[dict[str, Any], Primitive]] = ()) -> list[Primitive]:
    """A plan with primitives removed, replaced and added; a pattern is a kind and some arguments."""
    fits = lambda p, pattern: all((p.kind if k == "type" else p.args.get(k)) == v for k, v in pattern.items())
    kept = [p for p in plan if not (remove and fits(p, remove))]
    return [next((new for pattern, new in replace if fits(p, pattern)), p) for p in kept] + list(add)


@dataclass(frozen=True)
class Query:
    """A parsed ``find``: words joined by ``and``, ``or`` or ``near`` with a window."""

    op: str
    terms: tuple[str, ...]
    window: int = 5


def parse_query(text: str, window: int = 5) -> Query:
    """``find("X AND Y")``, ``find("X NEAR Y", window=N)``, or words alone."""
    m = re.fullmatch(r"""\s*find\(\s*"(.*)"\s*(?:,\s*window\s*=\s*(\d+)\s*)?\)\s*""", text, re.S)
    body = m[1] if m else text
    window = int(m[2]) if m and m[2] else window
    if not body.strip():
        raise ValueError("the query is empty")
    for op in ("NEAR", "AND", "OR"):
        parts = [p.strip().strip("'\"") for p in re.split(rf"\s+{op}\s+", body)]
        if len(parts) > 1:
            if op == "NEAR" and len(parts) != 2:
                raise ValueError("NEAR joins two terms")
            return Query(op.lower(), tuple(parts), window)
    return Query("and", (body.strip(),), window)


def websearch(text: str) -> list[list[tuple[str, str]]]:
    """Groups joined by OR of terms and phrases joined by blanks: [[("term", x), ("phrase", y)], ...]."""
    groups: list[list[tuple[str, str]]] = [[]]
    for quoted, word in re.findall(r'"([^"]*)"|(\S+)', text):
        if word == "OR":
            groups.append([])
        elif quoted.strip():
            groups[-1].append(("phrase", quoted.strip().lower()))
        elif word:
            groups[-1].append(("term", word.lower()))
    return [g for g in groups if g]

"""Query trees and the JSON query language."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass
from typing import Any

MATCH, TERM, KEYWORD, PREFIX, PHRASE, RANGE, BOOL = "match", "term", "keyword", "prefix", "phrase", "range", "bool"
ALL_FIELDS = "_all"
#: Results that a search may reach into.
WINDOW = 10_000
DEFAULT_SIZE = 10


class QueryError(ValueError):
    """A query that can't be parsed."""


@dataclass
class Node:
    type: str
    field: str = ""
    value: str = ""
    terms: list[str] = dataclasses.field(default_factory=list)
    gte: int | None = None
    lte: int | None = None
    gt: int | None = None
    lt: int | None = None
    must: list[Node] = dataclasses.field(default_factory=list)
    should: list[Node] = dataclasses.field(default_factory=list)
    must_not: list[Node] = dataclasses.field(default_factory=list)
    filter: list[Node] = dataclasses.field(default_factory=list)


def match(field: str, value: str) -> Node:
    return Node(MATCH, field, value)


def term(field: str, value: str) -> Node:
    return Node(TERM, field, value)


def prefix(field: str, value: str) -> Node:
    return Node(PREFIX, field, value)


def phrase(field: str, *terms: str) -> Node:
    return Node(PHRASE, field, terms=list(terms))


def between(field: str, **bounds: int) -> Node:
    return Node(RANGE, field, **bounds)


def boolean(must=(), should=(), must_not=(), filter=()) -> Node:
    return Node(BOOL, must=list(must), should=list(should), must_not=list(must_not), filter=list(filter))


def match_all() -> Node:
    return Node(BOOL)


@dataclass
class Request:
    query: Node
    size: int = DEFAULT_SIZE
    start: int = 0


def page(size: int | None, start: int | None) -> tuple[int, int]:
    """(size, start) as served: sizes below 1 are 10, negative starts 0, and pages that reach beyond WINDOW become its first WINDOW results."""
    size, start = size or 0, start or 0
    size = DEFAULT_SIZE if size <= 0 else min(size, WINDOW)
    start = max(start, 0)
    return (WINDOW, 0) if start + size > WINDOW else (size, start)


def _whole(value: Any) -> int | None:
    fine = isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63
    return value if fine else None


def parse_node(raw: Any) -> Node:
    """Tree of a JSON query object."""
    if not isinstance(raw, dict):
        raise QueryError("a query must be an object")
    kind = raw.get("type") or ""
    name, value = raw.get("field") or "", raw.get("value") or ""
    if not isinstance(name, str) or not isinstance(value, str):
        raise QueryError("field and value must be strings")
    if kind in (MATCH, TERM, KEYWORD, PREFIX):
        if not name or not value:
            raise QueryError(f"a {kind} query needs a field and a value")
        return Node(kind, name, value)
    if kind == RANGE:
        if not name:
            raise QueryError("a range query needs a field")
        return Node(kind, name, **{b: _whole(raw.get(b)) for b in ("gte", "lte", "gt", "lt")})
    if kind == PHRASE:
        terms = raw.get("terms") or []
        if not name or not terms or not all(isinstance(t, str) for t in terms):
            raise QueryError("a phrase query needs a field and terms")
        return Node(kind, name, terms=list(terms))
    if kind == BOOL:
        return Node(kind, **{c: [parse_node(x) for x in raw.get(c) or []] for c in ("must", "should", "must_not", "filter")})
    raise QueryError(f"there is no query type {kind!r}")


def parse_request(body: str | bytes | dict) -> Request:
    """A search request: {"query": string, object or null, "size": n, "from": n}."""
    from .query_string import parse_query_string

    try:
        raw = body if isinstance(body, dict) else json.loads(body)
    except ValueError as e:
        raise QueryError(str(e)) from e
    if not isinstance(raw, dict):
        raise QueryError("a request must be an object")
    query = raw.get("query")
    if query is None:
        node = match_all()
    elif isinstance(query, str):
        node = parse_query_string(query)
    else:
        node = parse_node(query)
    size, start = page(raw.get("size"), raw.get("from"))
    return Request(node, size, start)

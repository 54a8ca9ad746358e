"""Ranked search: top k by score, paged, sources fetched last, and exact counts."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compile import Options, compile_query
from ..plans.nodes import Node, Request, page, parse_node, parse_request
from ..plans.query_string import parse_query_string
from ..plans.views import IndexView


def parsed(query: Node | Request | str | dict | bytes | None, size: int | None = None, start: int | None = None) -> Request:
    """A request from a tree, a query string, a JSON query node, or a whole JSON request ({"query": ...})."""
    if isinstance(query, Request):
        return query
    if isinstance(query, bytes) or (isinstance(query, dict) and "type" not in query):
        return parse_request(query)
    if isinstance(query, Node):
        node = query
    elif isinstance(query, dict):
        node = parse_node(query)
    elif query is None:
        node = Node("bool")
    else:
        node = parse_query_string(query)
    return Request(node, *page(size, start))


@dataclass(frozen=True)
class Results:
    view: IndexView
    request: Request
    options: Options
    places: int | None

    @cached_property
    def matched(self) -> DataFrame:
        """(segment_id, doc_id, score) of all results, in no order."""
        hits = compile_query(self.view, self.request.query, self.options)
        return hits if self.places is None else hits.withColumn("score", F.round("score", self.places))

    @property
    def ranked(self) -> DataFrame:
        """The page's (segment_id, doc_id, score): best first, ties by segment and document. Each task keeps the best only."""
        r = self.request
        ordered = self.matched.orderBy(F.desc("score"), "segment_id", "doc_id")
        return (ordered.offset(r.start) if r.start else ordered).limit(r.size)

    @property
    def hits(self) -> DataFrame:
        """The page with its documents' sources, in order. Sources are read for the page alone."""
        top = self.ranked  # at most WINDOW rows, whatever the index holds
        docs = self.view.docs().select("segment_id", "doc_id", "source")
        return docs.join(F.broadcast(top), ["segment_id", "doc_id"]).select("segment_id", "doc_id", "score", "source").orderBy(F.desc("score"), "segment_id", "doc_id")

    @property
    def total(self) -> DataFrame:
        """One row, total_hits: how many documents match, on all pages."""
        return self.matched.agg(F.count("*").alias("total_hits"))

    def response(self) -> str:
        """JSON response; size is the number of hits returned, and hits is null without any."""
        total = self.total.first()[0]
        rows = [{"doc_id": r.doc_id, "segment_id": r.segment_id, "score": r.score, "source": json.loads(r.source)} for r in self.hits.collect()]
        return json.dumps({"total_hits": total, "from": self.request.start, "size": len(rows), "hits": rows or None}, ensure_ascii=False)


def search(view: IndexView, query: Node | Request | str | dict | bytes | None, size: int | None = None, start: int | None = None, options: Options = Options(), places: int | None = None) -> Results:
    """Results of a query; nothing runs before one of the result's DataFrames does. places: decimal places that scores are compared to."""
    return Results(view, parsed(query, size, start), options, places)

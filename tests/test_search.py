"""Searches against a plain evaluator of the same tree over sets and dictionaries."""

import math
import struct

import pytest

from skein.functions.analysis import analyse
from skein.operators.search import search
from skein.plans.compile import Options
from skein.plans.nodes import Node, between, boolean, match, match_all, phrase, prefix, term
from skein.plans.query_string import parse_query_string
from skein.plans.views import TableView
from skein.schema import IndexSchema

SCHEMA = IndexSchema.of(text="text", title="text", level="keyword", n="i64")
DOCS = [
    ("red apple and green apple", None, "ERROR", 5), ("green pear", "The Pear", "info", None), (None, "apple", None, 7), ("", "", "", 0),
    ("Über café red-green_apple", "red", "eu-west", -3), ("apple red green", "x", "Error", 9), ("pear apple pear apple pear", None, "INFO", 5), ("applesauce", "red green", "error", 12),
    ("green", None, "Crème", 1), (None, None, "warn", None),
]


def single(x):
    return struct.unpack("f", struct.pack("f", x))[0]


class Plain:
    def __init__(self, docs):
        self.n = len(docs)
        self.tokens = {}
        for i, (text, title, level, _) in enumerate(docs):
            for f, v in (("text", text), ("title", title)):
                if v is not None:
                    self.tokens[f, i] = analyse(v)
            if level is not None:
                self.tokens["level", i] = [level.lower()]

    def having(self, field, t):
        return {i for (f, i), ts in self.tokens.items() if f == field and t in ts}

    def avgdl(self, field):
        lens = {i: len(ts) for (f, i), ts in self.tokens.items() if f == field}
        return single(single(sum(lens.values())) / single(max(lens) + 1))

    def bm25(self, tf, dl, avgdl, df):
        return math.log(1 + (self.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))

    def term(self, field, t):
        out = {}
        for f in ("text", "title", "level") if field == "_all" else (field,):
            have = self.having(f, t)
            for i in have:
                out[i] = max(out.get(i, 0), self.bm25(1, len(self.tokens[f, i]), self.avgdl(f), len(have)))
        return out

    def run(self, q, scores):
        """Documents of a tree; scores grow on the way, whether a conjunction holds or not."""
        def add(found, best=False):
            for i, s in found.items():
                scores[i] = scores.get(i, 0) + s

        if q.type in ("match", "term", "keyword"):
            sets = []
            for t in analyse(q.value) if q.type == "match" else [q.value]:
                found = self.term(q.field, t)
                add(found)
                sets.append(set(found))
            return set.intersection(*sets) if sets else set()
        if q.type == "prefix":
            out = {}
            if q.field != "_all":
                for t in {t for (f, _), ts in self.tokens.items() if f == q.field for t in ts if t.startswith(q.value)}:
                    have = self.having(q.field, t)
                    for i in have:
                        out[i] = max(out.get(i, 0), self.bm25(1, 1, self.avgdl(q.field), len(have)))
            add(out)
            return set(out)
        if q.type == "phrase":
            have = set.intersection(*[self.having(q.field, t) for t in q.terms])
            k = len(q.terms)
            hit = {i for i in have if any(self.tokens[q.field, i][p : p + k] == q.terms for p in range(len(self.tokens[q.field, i])))}
            add({i: self.bm25(k, 1, self.avgdl(q.field), len(have)) for i in hit})
            return hit
        if q.type == "range":
            return set()
        base = None
        for x in q.must:
            got = self.run(x, scores)
            base = got if base is None else base & got
        for x in q.filter:
            got = self.run(x, {})
            base = got if base is None else base & got
        if q.should:
            any_ = set().union(*[self.run(x, scores) for x in q.should])
            if base is None:
                base = any_
            else:
                for i in base & any_:
                    scores[i] = scores.get(i, 0) * 1.1
        if base is None:
            base = set(range(self.n))
        for x in q.must_not:
            base = base - self.run(x, {})
        return base


RED, GREEN, APPLE, PEAR = (match("text", w) for w in ("red", "green", "apple", "pear"))
QUERIES = [
    RED, match("text", "Red, APPLE!"), match("text", "apple apple"), match("text", "cafe uber"), match("text", "Café"), match("text", "?"), match("nope", "red"), match("_all", "red green"), match("_all", "apple"),
    term("level", "error"), term("level", "ERROR"), Node("keyword", "level", "eu-west"), match("level", "eu-west"), match("level", "ERROR"), match("level", "Crème"), term("level", "crème"), term("_all", "red"), term("level", ""),
    prefix("text", "appl"), prefix("text", "Appl"), prefix("text", ""), prefix("_all", "a"), prefix("level", "e"),
    phrase("text", "green", "apple"), phrase("text", "apple", "pear"), phrase("text", "pear", "apple", "pear"), phrase("text", "Green", "apple"), phrase("text", "red"), phrase("text", "red", "nope"), phrase("text", "apple", "apple"), phrase("_all", "green", "apple"),
    between("n", gte=1), match_all(),
    boolean(must=[RED, APPLE]), boolean(should=[RED, PEAR]), boolean(must=[RED], should=[GREEN, PEAR]), boolean(filter=[RED]), boolean(filter=[RED], should=[APPLE]), boolean(must=[APPLE], filter=[GREEN]), boolean(must=[APPLE], must_not=[RED]), boolean(must_not=[APPLE]),
    boolean(should=[boolean(must=[RED, PEAR]), GREEN]), boolean(must=[boolean(should=[RED, PEAR]), APPLE], should=[term("level", "error")], must_not=[match("title", "x")]),
    boolean(must=[boolean(must_not=[RED])]), boolean(should=[boolean(must_not=[RED]), RED]), boolean(must=[between("n", gte=0)]), boolean(should=[between("n", gte=0), RED]), boolean(must_not=[between("n", gte=0)]),
    parse_query_string("(red AND nope) OR green"), parse_query_string("red NOT apple"), parse_query_string("level:error pear OR title:red*"),
]


@pytest.fixture(scope="module")
def view(spark):
    rows = [(i, *d) for i, d in enumerate(DOCS)]
    return TableView(spark.createDataFrame(rows, "id long, text string, title string, level string, n long").cache(), SCHEMA, "id")


@pytest.mark.parametrize("query", QUERIES, ids=str)
def test_equals_plain_evaluation(view, query):
    plain = Plain(DOCS)
    scores = {}
    want = {i: round(scores.get(i, 0), 6) for i in plain.run(query, scores)}
    assert {r.doc_id: r.score for r in search(view, query, places=6).matched.collect()} == want


def test_extensions(view):
    ids = lambda q, **o: sorted(r.doc_id for r in search(view, q, options=Options(**o)).matched.collect())
    assert ids(between("n", gte=5, lt=9), real_range=True) == [0, 2, 6]
    assert ids(between("n", gt=5, lte=12), real_range=True) == [2, 5, 7]
    assert ids(between("text", gt=5), real_range=True) == []
    assert ids(phrase("text", "Green", "APPLE"), analyse_phrases=True) == [0, 4]
    one = {r.doc_id: r.score for r in search(view, APPLE).matched.collect()}
    many = {r.doc_id: r.score for r in search(view, APPLE, options=Options(term_frequency=True)).matched.collect()}
    assert many[6] > one[6] and many[5] == pytest.approx(one[5])


def test_order_pages_and_sources(view):
    import json

    every = search(view, match_all(), size=100).ranked.collect()
    assert [r.doc_id for r in every] == list(range(len(DOCS)))
    assert [r.doc_id for r in search(view, match_all(), 3, 4).ranked.collect()] == [4, 5, 6]
    best = search(view, "text:apple", 2, places=6)
    assert [r.score for r in best.ranked.collect()] == sorted((r.score for r in best.matched.collect()), reverse=True)[:2]
    out = json.loads(best.response())
    assert (out["total_hits"], out["from"], out["size"]) == (4, 0, 2) and "apple" in out["hits"][0]["source"]["text"]
    assert json.loads(search(view, "nope").response()) == {"total_hits": 0, "from": 0, "size": 0, "hits": None}


def test_top_k_is_taken_in_each_task(view):
    plan = search(view, "text:apple").ranked._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan

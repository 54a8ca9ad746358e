import pytest

from skein.plans.nodes import Node, QueryError, between, boolean, match, match_all, page, parse_node, parse_request, phrase, prefix
from skein.plans.query_string import parse_query_string

A = "_all"
a, b, c = match(A, "a"), match(A, "b"), match(A, "c")
STRINGS = {
    "hello": match(A, "hello"),
    "level:ERROR": match("level", "ERROR"),
    "a AND b": boolean(must=[a, b]),
    "a and b AND c": boolean(must=[a, b, c]),
    "a b c": boolean(must=[a, b, c]),
    "a OR b OR c": boolean(should=[boolean(should=[a, b]), c]),
    "a OR b AND c": boolean(should=[a, boolean(must=[b, c])]),
    "NOT a": boolean(must_not=[a]),
    "a AND NOT b": boolean(must=[a, boolean(must_not=[b])]),
    "NOT a b": boolean(must=[boolean(must_not=[a]), b]),
    # an adjacent NOT, and what follows a complete expression, is dropped
    "a NOT b": a,
    "a) OR b": a,
    "(a OR b) c": boolean(must=[boolean(should=[a, b]), c]),
    "a (b c)": boolean(must=[a, boolean(must=[b, c])]),
    # a left operand without should and must_not takes the right one in
    "(a b) AND c": boolean(must=[a, b, c]),
    "f:a:b": match("f", "a:b"),
    ":a": match(A, ":a"),
    "f:x*": prefix("f", "x"),
    "*": prefix(A, ""),
    "f:*": prefix("f", ""),
    '"a b"': phrase(A, "a", "b"),
    '"f:a b"': phrase("f", "a", "b"),
    'f:"a b"': boolean(must=[match("f", '"a'), match(A, 'b"')]),
    # operators end at what is no letter, digit or underscore
    "not-found": boolean(must_not=[match(A, "-found")]),
    "nothing": match(A, "nothing"),
    "or_x": match(A, "or_x"),
    "a OR:b": boolean(should=[a, match(A, ":b")]),
    "été": match(A, "été"),
    '"open': match(A, "open"),
}


@pytest.mark.parametrize("text", STRINGS)
def test_query_strings(text):
    assert parse_query_string(text) == STRINGS[text]


@pytest.mark.parametrize("text", ["", "  ", "(a", "a AND", "f:", "f:(x)", "()", "AND a", "a OR OR b", '""'])
def test_refused_query_strings(text):
    with pytest.raises(QueryError):
        parse_query_string(text)


def test_json_nodes():
    assert parse_node({"type": "match", "field": "f", "value": "v"}) == match("f", "v")
    assert parse_node({"type": "keyword", "field": "f", "value": "v"}) == Node("keyword", "f", "v")
    assert parse_node({"type": "phrase", "field": "f", "terms": ["x", "y"]}) == phrase("f", "x", "y")
    assert parse_node({"type": "range", "field": "f", "gte": 1, "lt": 2.5, "gt": "3", "lte": True}) == between("f", gte=1)
    assert parse_node({"type": "bool"}) == match_all()
    assert parse_node({"type": "bool", "must": [{"type": "bool", "must_not": [{"type": "term", "field": "f", "value": "v"}]}]}) == boolean(must=[boolean(must_not=[Node("term", "f", "v")])])


@pytest.mark.parametrize("raw", [{}, [], {"type": "fuzzy"}, {"type": "match", "field": "f"}, {"type": "prefix", "field": "f", "value": ""}, {"type": "phrase", "field": "f"}, {"type": "range"}, {"type": "bool", "must": [{}]}, {"type": "match", "field": 1, "value": "x"}])
def test_refused_nodes(raw):
    with pytest.raises(QueryError):
        parse_node(raw)


def test_requests():
    r = parse_request('{"query": "a b", "size": 3, "from": 2}')
    assert (r.query, r.size, r.start) == (boolean(must=[a, b]), 3, 2)
    assert parse_request("{}").query == parse_request('{"query": null}').query == match_all()
    assert parse_request({"query": {"type": "match", "field": "f", "value": "v"}}).query == match("f", "v")
    for bad in ("[]", "x", '{"query": 3}'):
        with pytest.raises(QueryError):
            parse_request(bad)


@pytest.mark.parametrize(("given", "served"), [((None, None), (10, 0)), ((0, -5), (10, 0)), ((-1, 3), (10, 3)), ((20_000, 0), (10_000, 0)), ((10, 9_990), (10, 9_990)), ((10, 9_991), (10_000, 0)), ((5, 2), (5, 2))])
def test_pages(given, served):
    assert page(*given) == served

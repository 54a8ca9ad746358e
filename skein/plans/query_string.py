"""The query-string language: field:value, AND, OR, NOT, parentheses and quotes.

NOT binds tighter than AND, AND tighter than OR, and terms side by side are joined by AND. Known oddities
are kept on purpose: "a NOT b" ends at NOT, whatever follows a complete expression is ignored, a quoted text with
a space is a phrase of raw words, and operators in any case end at anything but a letter, digit or underscore.
"""

from __future__ import annotations

from .nodes import ALL_FIELDS, BOOL, Node, QueryError, boolean, match, phrase, prefix

OPERATORS = ("AND", "OR", "NOT")
#: White space among single bytes.
BLANK = frozenset("\t\n\v\f\r \x85\xa0")
STOP = frozenset(" \t()")


def parse_query_string(text: str) -> Node:
    return _Parser(text).either()


class _Parser:
    def __init__(self, text: str):
        # one character per UTF-8 byte: the language is defined on bytes
        self.text = text.strip().encode().decode("latin-1")
        self.at = 0

    def rest(self) -> str:
        while self.at < len(self.text) and self.text[self.at] in BLANK:
            self.at += 1
        return self.text[self.at :]

    def operator(self) -> str:
        """The operator that comes next, or ""."""
        rest = self.rest()
        for op in OPERATORS:
            n = len(op)
            if rest[:n].upper() == op and not (len(rest) > n and (rest[n].isalpha() or rest[n].isdecimal() or rest[n] == "_")):
                return op
        return ""

    def skip(self, op: str) -> bool:
        if self.operator() != op:
            return False
        self.at += len(op)
        return True

    def either(self) -> Node:
        left = self.both()
        while self.skip("OR"):
            left = boolean(should=[left, self.both()])
        return left

    def both(self) -> Node:
        left = self.negated()
        while self.skip("AND") or (self.operator() == "" and self.rest()[:1] not in ("", ")")):
            right = self.negated()
            if left.type == BOOL and not left.should and not left.must_not:
                left.must.append(right)
            else:
                left = boolean(must=[left, right])
        return left

    def negated(self) -> Node:
        if self.skip("NOT"):
            return boolean(must_not=[self.primary()])
        return self.primary()

    def primary(self) -> Node:
        rest = self.rest()
        if not rest:
            raise QueryError("the query ends too early")
        if rest[0] != "(":
            return self.leaf()
        self.at += 1
        inner = self.either()
        if self.rest()[:1] != ")":
            raise QueryError("a closing parenthesis is missing")
        self.at += 1
        return inner

    def token(self) -> str:
        rest = self.rest()
        if rest[:1] == '"':
            body, quote, _ = rest[1:].partition('"')
            self.at += 1 + len(body) + len(quote)
            return body
        n = next((i for i, c in enumerate(rest) if c in STOP), len(rest))
        if rest[:n].upper() in OPERATORS:
            return ""
        self.at += n
        return rest[:n]

    def leaf(self) -> Node:
        raw = self.token()
        if not raw:
            raise QueryError(f"a term is expected at byte {self.at}")
        text = raw.encode("latin-1").decode(errors="replace")
        name, colon, value = text.partition(":")
        if not (colon and name):
            name, value = ALL_FIELDS, text
        elif not value:
            raise QueryError(f"the field {name!r} has no value")
        if " " in value:
            return phrase(name, *value.split())
        return prefix(name, value[:-1]) if value.endswith("*") else match(name, value)

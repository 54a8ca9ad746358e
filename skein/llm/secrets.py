"""Secrets in assignments, by lexing source and configuration text."""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least score that is reported.
LEAST = 0.6

#: Words of names that say that a value is to be kept secret, and how surely.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.95, "pass": 0.8, "secret": 1.0, "secrets": 0.9, "token": 0.95, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "auth": 0.7, "authorization": 0.8, "bearer": 0.85, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "signature": 0.65, "salt": 0.6, "jwt": 0.8, "pin": 0.5, "cookie": 0.6, "session": 0.5, "key": 0.5,
}
#: Pairs of words that say so together.
PAIRS = {("api", "key"), ("access", "key"), ("private", "key"), ("secret", "key"), ("encryption", "key"), ("signing", "key"), ("client", "secret"), ("connection", "string"), ("account", "key"), ("master", "key")}
#: Literals that show by their own shape that they are keys.
SHAPES = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9])|-----BEGIN [A-Z ]*PRIVATE KEY-----"
)
EMPTY = {"", "null", "none", "nil", "true", "false", "undefined", "changeme", "change_me", "example", "placeholder", "todo", "string", "str", "int", "xxx", "redacted", "password", "secret", "token", "test", "your_password", "yourpassword"}

TOKEN = re.compile(
    r'''(?P<space>[^\S\n]+)|(?P<line>\n)
    |(?P<element><(?:key|name)>[^<>"']*</(?:key|name)>\s*<(?:string|value)>[^<>]*</(?:string|value)>|<(?P<opened>[\w:.-]+)>[^<>]*</(?P=opened)\s*>)
    |(?P<string>"""(?:[^\\]|\\[\s\S])*?"""|(?<!\w)\'{3}(?:[^\\]|\\[\s\S])*?\'{3}
      |"(?:[^"\\\n]|\\.)*"|(?<!\w)'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`)
    |(?P<dash>(?<![^\s"'`,;(\[{])--?(?=[^\W\d]))
    |(?P<name>[^\W\d][\w\-]*(?:\.[^\W\d][\w\-]*)*)
    |(?P<op>===?|!==?|<=|>=|=>|:=|::|[=:+,;\[\](){}])
    |(?P<other>[^\s"'`=:+,;\[\](){}<]+|.)''',
    re.X,
)
#: Two elements side by side, of a name and its value, or one element of its name.
ELEMENT = re.compile(r"<(?:key|name)>\s*(?P<key>[^<>]*?)\s*</(?:key|name)>\s*<(?:string|value)>\s*(?P<own>[^<>]*?)\s*</|<(?P<tag>[^<>]+)>\s*(?P<body>[^<>]*?)\s*</")
#: Credentials in a URL.
USERINFO = re.compile(r"(?<![\w+.-])[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@\"'`<>]*:(?P<password>[^\s/@\"'`<>]+)@")
#: Attributes that name the one that follows.
NAMING = {"key", "name", "id"}
#: An unquoted value goes on to the next white space or separator.
BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]+")
REFERENCE = re.compile(r"\$\{(\w+)\}|\$(\w+)|\{\{\s*(\w+)\s*\}\}")
#: Words that stand before the credentials in a header.
SCHEMES = {"basic", "bearer", "token", "apikey", "api-key", "negotiate", "ntlm", "digest"}
SCHEME = re.compile(rf"\s*(?:{'|'.join(sorted(SCHEMES))})\s+(?=\S+\s*$)", re.I)
#: name=value, as in digest credentials; not the padding of base64.
PARAMETER = re.compile(r"[\w\-]+=[^=]")
#: A quotation mark or backslash that is escaped.
ESCAPE = re.compile(r"\\[\"'`\\]")
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_score(name: str) -> float:
    words = [w.lower() for w in CAMEL.findall(name)]
    best = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    if any(p in PAIRS for p in zip(words, words[1:])):
        best = 1.0
    return max(best, SENSITIVE.get("".join(words), 0.0))


def literal_score(value: str, quoted: bool) -> float:
    """How much a literal looks like a key: its length, kinds of characters and entropy."""
    low = value.strip().lower()
    if low in EMPTY or len(value) < 4 or len(set(low)) < 3 or (low[0] in "<$" and low[-1] in ">})"):
        return 0.0
    if SHAPES.search(value):
        return 1.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    spread = entropy / math.log2(n) if n > 1 else 0
    score = 0.35 * min(1, n / 12) + 0.35 * spread * min(1, entropy / 3) + 0.15 * min(kinds - 1, 2)
    if value.isalpha() and not quoted:
        score *= 0.4  # a word of prose
    if " " in value.strip():
        score *= 0.7
    return min(1.0, score)


def _lex(text: str) -> list[tuple[str, str, int]]:
    return [(m.lastgroup, m.group(), m.start()) for m in TOKEN.finditer(text) if m.lastgroup != "space"]


def _quotes(s: str) -> int:
    return 3 if len(s) >= 6 and s[:3] == s[-3:] in ('"""', "'''") else 1


def _unquote(s: str) -> str:
    body = s[_quotes(s) : -_quotes(s)]
    return re.sub(r"\\(.)", r"\1", body) if "\\" in body else body


class Inner:
    """Text of a quoted string, a level of its escaped quotes being undone, and where its characters are in the whole text."""

    def __init__(self, quoted: str, at: int, outer: Inner | None):
        q = _quotes(quoted)
        body = quoted[q:-q]
        self.text, self.at, self.outer, self.shift = body, at + q, outer, None
        if "\\" in body:
            parts, shift, last = [], [], 0
            for m in ESCAPE.finditer(body):
                parts.append(body[last : m.start()])
                last = m.end() - 1
                shift.append(m.start() - len(shift))  # place, in the new text, of the character that was escaped
            self.text, self.shift = "".join([*parts, body[last:]]), shift

    def place(self, i: int) -> int:
        i += self.at + (bisect.bisect_right(self.shift, i) if self.shift else 0)
        return self.outer.place(i) if self.outer else i


def pairs(text: str, known: dict[str, str] | None = None, inside: Inner | None = None) -> Iterator[tuple[str, str, int, bool, bool]]:
    """(name, literal, place, quoted, propagated) of the text's assignments.

    name = value, name := value, name: value, name => value, name: type = value, "name": value and table["name"] = value; what looks like a type may
    be the name, after a word of a log, and has the value if it's the more sensitive. Of a header's scheme and credentials, the latter are the value. Values are
    quoted or bare literals, sums of them, or names assigned before, whose literals are propagated, also into ${name}.
    <name>value</name>, <key>name</key><string>value</string> and key="name" value="value" are assignments too, and so is the password of a URL.
    Quoted strings that hold assignments are read too, and what is quoted in them, escaped or not, to any depth: each level has fewer characters than the one around it.
    """
    known = {} if known is None else known
    t = _lex(text)
    n = len(t)
    i = 0
    place_of = inside.place if inside else lambda x: x
    nested = lambda s, at: pairs((x := Inner(s, at, inside)).text, known, x)
    named = ""
    for m in USERINFO.finditer(text) if inside is None and "://" in text else ():
        yield "url.password", m["password"], m.start("password"), True, False
    while i < n:
        kind, s, at = t[i]
        if kind == "element":
            m = ELEMENT.match(s)
            key = "key" if m["key"] is not None else "tag"
            value = "own" if key == "key" else "body"
            known[m[key]] = m[value]
            yield m[key], m[value], place_of(at + m.start(value)), True, False
            i += 1
            continue
        if kind == "string" and ("=" in s or ":" in s):
            yield from nested(s, at)
        name, j = None, i + 1
        if kind == "name":
            name = s
            if j + 2 < n and t[j][1] == "[" and t[j + 1][0] == "string" and t[j + 2][1] == "]":
                name, j = f"{s}.{_unquote(t[j + 1][1])}", j + 3
        elif kind == "string":
            name = _unquote(s)
        if name is None or j >= n or t[j][1] not in ("=", ":=", ":", "=>"):
            i += 1
            continue
        if t[j][1] == ":" and j + 2 < n and t[j + 1][0] == "name" and t[j + 2][1] == "=":
            if name_score(t[j + 1][1]) > name_score(name):
                name = t[j + 1][1]
            j += 2  # an annotation
        j += 1
        scheme = j + 1 < n and t[j][1].lower() in SCHEMES and t[j + 1][0] in ("name", "other") and name_score(name) > 0 and (m := BARE.match(text, t[j + 1][2])) is not None and not PARAMETER.match(m.group())
        if scheme:
            j += 1
        parts: list[str] = []
        place, quoted, moved = -1, False, False
        while j < n and t[j][0] != "line":
            vk, v, va = t[j]
            if vk == "string":
                body, q = _unquote(v), _quotes(v)
                skip = m.end() if not parts and name_score(name) > 0 and (m := SCHEME.match(body)) else 0
                parts.append(REFERENCE.sub(lambda m: known.get(next(filter(None, m.groups())), m.group()), body[skip:]))
                place, quoted = (va + q + skip if place < 0 else place), True
                if "=" in v or ":" in v:
                    yield from nested(v, va)
                j += 1
            elif v[0] in "${" and (m := REFERENCE.match(text, va)) and (ref := next(filter(None, m.groups()))) in known:
                parts.append(known[ref])
                place, moved = (va if place < 0 else place), True
                while j < n and t[j][2] < m.end():
                    j += 1
            elif vk == "name" and v in known and (j + 1 >= n or t[j + 1][1] in ("+", ",", ";", ")", "}", "]") or t[j + 1][0] in ("line", "name")):
                parts.append(known[v])
                place, moved = (va if place < 0 else place), True
                j += 1
            elif vk in ("name", "other", "dash") and (m := BARE.match(text, va)):
                if j + 1 < n and t[j + 1][1] in ("(", "[", ".") and t[j + 1][2] == va + len(v):
                    parts = []  # a call or an index is no literal
                    break
                if j + 1 < n and t[j + 1][1] in (":", "=>") and vk == "name" and m.group() in (v, v + ":", v + "=") and name_score(v) > 0:
                    break  # a word of a log before the name
                if not scheme and j + 1 < n and t[j + 1][1] in ("=", ":=") and t[j + 1][2] == va + len(v) and vk == "name" and "=" not in m.group()[len(v) + 1 :] and t[j - 1][1] != "=":
                    break  # the next assignment begins
                bare = m.group().rstrip(".:!?")
                parts.append(bare)
                place = va if place < 0 else place
                end = m.end()
                while j < n and t[j][2] < end:
                    j += 1
            else:
                break
            if j + 1 < n and t[j][1] == "+":
                j += 1
                continue
            break
        if parts:
            value = "".join(parts)
            known[name] = value
            known[name.rsplit(".", 1)[-1]] = value
            yield name, value, place_of(place), quoted, moved
            if name.lower() in NAMING and quoted:
                named = value
            elif name.lower() == "value" and quoted and named:
                yield named, value, place_of(place), True, moved
                named = ""
        i = max(j, i + 1)


def secrets_of(text: str, least: float = LEAST) -> list[tuple[str | None, str, int, float, str]]:
    """(name, literal, place, score, kind) of a text, by place; kind is assigned, propagated or shape.

    The score is the name's times a share that the literal decides. A literal of a known key's shape counts without any name, once.
    """
    out = {}
    spans = []
    for name, value, at, quoted, moved in pairs(text):
        lit = literal_score(value, quoted)
        by_name = name_score(name)
        score = by_name * (0.3 + 0.7 * lit) if lit else 0.0
        if SHAPES.search(value):
            score = max(score, 0.95)
        if score >= least:
            out[name, value, at] = (name, value, at, round(score, 6), "propagated" if moved else "assigned")
            spans.append((at, at + len(value)))
    spans.sort()
    for m in SHAPES.finditer(text):
        if not any(a <= m.start() < b for a, b in spans):
            out[None, m.group(), m.start()] = (None, m.group(), m.start(), 0.9, "shape")
    return sorted(out.values(), key=lambda r: (r[2], r[0] or "", r[1]))


def secrets(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Likely secrets: (doc_id, name, literal, start, score, kind), a row for each; start counts characters from 0.

    Whole texts are lexed, however long; those without an operator of assignment or the beginning of a known key's shape
    can't have any and are left out before Python. NULL and empty texts have no rows; rows that repeat are
    scanned each; a NULL doc_id stays. Other columns are not looked at. No shuffle.
    """

    def run(batches):
        for batch in batches:
            rows = [(d, *r) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in secrets_of(t, least)]
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "name", "literal", "start", "score", "kind"])

    some = F.lit(False)
    for x in ("=", ":", "AKIA", "ASIA", "_", "xox", "AIza", "-----BEGIN"):
        some = some | F.contains("text", F.lit(x))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").where(some)
    return docs.mapInArrow(run, "doc_id long, name string, literal string, start long, score double, kind string")

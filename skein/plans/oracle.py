"""SQL for the catalogue's queries: the index and the scores spelled out as common table expressions.

Written for DuckDB, straight from the definitions and not from the compiler's plans.
"""

from __future__ import annotations

FOLD = "nfc_normalize(strip_accents(lower(x)))"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def index(segment: str = "'0'", keywords: tuple[str, ...] = ("lang", "source"), text: str = "text", table: str = "documents", doc_id: str = "doc_id", where: str = "true") -> str:
    """CTEs docs, lens, tok (positions), post (terms), df and st (statistics)."""
    kw = "".join(f" UNION ALL SELECT seg, doc_id, {lit(k)}, [lower({k})] FROM docs WHERE {k} IS NOT NULL" for k in keywords)
    cols = "".join(f", {k}" for k in keywords)
    return f"""docs AS (SELECT CAST({segment} AS VARCHAR) AS seg, {doc_id} AS doc_id, {text} AS body{cols} FROM {table} WHERE {where}),
lens AS (
  SELECT seg, doc_id, 'text' AS field, list_transform(regexp_extract_all(body, '[\\p{{L}}\\p{{Nd}}]+'), lambda x: {FOLD}) AS ts FROM docs WHERE body IS NOT NULL{kw}),
tok AS (SELECT seg, doc_id, field, len(ts) AS dl, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM lens),
post AS (SELECT seg, doc_id, field, term, any_value(dl) AS dl FROM tok GROUP BY seg, doc_id, field, term),
df AS (SELECT seg, field, term, count(*) AS df FROM post GROUP BY seg, field, term),
n AS (SELECT seg, count(*) AS n FROM docs GROUP BY seg),
st AS (
  SELECT seg, field, n, CAST(sum(len(ts)) AS BIGINT) AS sum_dl, max(doc_id) + 1 AS n_dl,
    CAST(CAST(CAST(sum(len(ts)) AS BIGINT) AS FLOAT) / CAST(max(doc_id) + 1 AS FLOAT) AS FLOAT)::DOUBLE AS avgdl
  FROM lens JOIN n USING (seg) GROUP BY seg, field, n)"""


def bm25(tf: str, dl: str, avgdl: str = "avgdl", df: str = "df", n: str = "n") -> str:
    return f"ln(1 + ({n} - {df} + 0.5) / ({df} + 0.5)) * ({tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * {dl} / {avgdl})))"


def term(name: str, field: str | None, value: str) -> str:
    """CTE name(seg, doc_id, s) of one term; any field, the best of them, if field is None."""
    here = "" if field is None else f" AND field = {lit(field)}"
    return f"{name} AS (SELECT seg, doc_id, max({bm25('1', 'dl')}) AS s FROM post JOIN df USING (seg, field, term) JOIN st USING (seg, field) WHERE term = {lit(value)}{here} GROUP BY seg, doc_id)"


def prefix(name: str, field: str, value: str) -> str:
    return f"{name} AS (SELECT seg, doc_id, max({bm25('1', '1.0')}) AS s FROM post JOIN df USING (seg, field, term) JOIN st USING (seg, field) WHERE starts_with(term, {lit(value)}) AND field = {lit(field)} GROUP BY seg, doc_id)"


def phrase(name: str, field: str, *terms: str) -> str:
    k = len(terms)
    joins = " ".join(f"JOIN tok t{i} ON t{i}.seg = t0.seg AND t{i}.doc_id = t0.doc_id AND t{i}.field = t0.field AND t{i}.pos = t0.pos + {i} AND t{i}.term = {lit(t)}" for i, t in enumerate(terms) if i)
    values = ", ".join(lit(t) for t in dict.fromkeys(terms))
    return f"""{name}_all AS (SELECT seg, count(*) AS df FROM (SELECT seg, doc_id FROM post WHERE field = {lit(field)} AND term IN ({values}) GROUP BY seg, doc_id HAVING count(*) = {len(set(terms))}) GROUP BY seg),
{name} AS (
  SELECT x.seg, x.doc_id, {bm25(f"{k}.0", "1.0")} AS s
  FROM (SELECT DISTINCT t0.seg, t0.doc_id FROM tok t0 {joins} WHERE t0.field = {lit(field)} AND t0.term = {lit(terms[0])}) x
  JOIN {name}_all USING (seg) JOIN st ON st.seg = x.seg AND st.field = {lit(field)})"""


def query(leaves: list[str], names: list[str], where: str, score: str, base: str = "", tail: str = "", gone: str = "", pick: str = "segment_id, doc_id, score") -> str:
    """The documents for which ``where`` holds, over flags names (has(a)) and scores (a), with ties in order."""
    for a in sorted(names, key=len, reverse=True):
        where, score = where.replace(f"has({a})", f"({a}.s IS NOT NULL)"), score.replace(f"has({a})", f"({a}.s IS NOT NULL)").replace(f"sc({a})", f"coalesce({a}.s, 0)")
    joins = " ".join(f"LEFT JOIN {a} ON {a}.seg = d.seg AND {a}.doc_id = d.doc_id" for a in names)
    minus = f" AND NOT ({gone})" if gone else ""
    for a in names:
        minus = minus.replace(f"has({a})", f"({a}.s IS NOT NULL)")
    with_ = ",\n".join([base or index(), *leaves])
    return f"""WITH {with_},
result AS (SELECT d.seg AS segment_id, d.doc_id, round({score}, 6) AS score FROM docs d {joins} WHERE ({where}){minus})
SELECT {pick} FROM result {tail}"""


TOP = "ORDER BY score DESC, segment_id, doc_id LIMIT 10"

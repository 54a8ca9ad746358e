"""Named queries over the tables of a folder: every operator of the search engine, with equivalent SQL where there is any.

The main index is documents: text is a text field, lang and source are keywords, n_chars is an i64.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.analysis import analyse, is_json, json_string, token_offsets, tokens
from ..operators import build
from ..operators.search import Results, search
from ..operators.store import Index
from ..schema import IndexSchema
from ..sources import generate, ingest
from . import oracle as o
from .compile import Options
from .nodes import Node, between, boolean, match, match_all, phrase, prefix, term
from .views import TableView

SCHEMA = IndexSchema.of(text="text", lang="keyword", source="keyword", n_chars="i64")
Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, segments: int = 1) -> TableView:
    """documents as an index of segments by doc_id; numbers in a segment stay dense."""
    docs = table(spark, sf_dir, "documents")
    if segments == 1:
        return TableView(docs, SCHEMA, "doc_id")
    split = docs.withColumns({"seg": (F.col("doc_id") % segments).cast("string"), "no": F.floor(F.col("doc_id") / segments)})
    return TableView(split, SCHEMA, "no", segment=F.col("seg"))


def found(view: TableView, query: Node | str, size: int | None = 10, start: int | None = 0, options: Options = Options()) -> Results:
    return search(view, query, size, start, options, places=6)


def every(query: Node | str, options: Options = Options(), segments: int = 1) -> Query:
    """All matches of a query with their scores."""
    return lambda spark, d: found(documents(spark, d, segments), query, options=options).matched


def top(query: Node | str, size: int = 10, start: int = 0, segments: int = 1) -> Query:
    return lambda spark, d: found(documents(spark, d, segments), query, size, start).ranked


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for "the in", with their sources."""
    return found(documents(spark, sf_dir), match("text", "the in")).hits


def _catalogue() -> dict[str, Entry]:
    """name: query and SQL."""
    out: dict[str, Entry] = {}
    EMPTY = "SELECT '' AS segment_id, CAST(0 AS BIGINT) AS doc_id, CAST(0 AS DOUBLE) AS score WHERE false"
    a, b, c = o.term("a", "text", "the"), o.term("b", "text", "in"), o.term("c", "text", "ha")
    de = o.term("k", "lang", "de")

    # analysis and index build
    def view_rows(make: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, d: make(documents(spark, d).docs())

    out["tokens_terms"] = Entry(view_rows(lambda docs: docs.select(F.explode(tokens(F.col("f_text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))), f"WITH {o.index()} SELECT term, count(*) AS n FROM tok WHERE field = 'text' GROUP BY term")
    out["token_offsets"] = Entry(
        view_rows(lambda docs: docs.select("doc_id", F.explode(token_offsets(F.col("f_text"))).alias("t")).select("doc_id", "t.*").groupBy("term").agg(F.sum("position").alias("positions"), F.sum(F.col("end") - F.col("start")).alias("bytes"))),
        r"""WITH w AS (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{Nd}]+')) AS x, unnest(range(len(regexp_extract_all(text, '[\p{L}\p{Nd}]+')))) AS p FROM documents)
SELECT nfc_normalize(strip_accents(lower(x))) AS term, CAST(sum(p) AS BIGINT) AS positions, CAST(sum(octet_length(encode(x))) AS BIGINT) AS bytes FROM w GROUP BY 1""",
    )
    out["postings_positions"] = Entry(
        lambda spark, d: build.postings(documents(spark, d).docs(), SCHEMA).select("segment_id", "field", "term", "doc_id", F.concat_ws(",", F.col("positions").cast("array<string>")).alias("positions"), "doclen"),
        f"WITH {o.index()} SELECT seg AS segment_id, field, term, doc_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions, CAST(any_value(dl) AS INTEGER) AS doclen FROM tok GROUP BY ALL",
    )
    out["doclens"] = Entry(lambda spark, d: build.lengths(documents(spark, d).docs(), SCHEMA.indexed()).select("segment_id", "field", "doc_id", "doclen"), f"WITH {o.index()} SELECT seg AS segment_id, field, doc_id, CAST(len(ts) AS INTEGER) AS doclen FROM lens")
    out["field_stats"] = Entry(lambda spark, d: build.field_stats(documents(spark, d).docs(), SCHEMA), f"WITH {o.index()} SELECT seg AS segment_id, field, n AS n_docs, sum_dl AS sum_doclen, n_dl AS n_doclen, avgdl FROM st")
    out["term_df"] = Entry(lambda spark, d: documents(spark, d).term_df(), f"WITH {o.index()} SELECT seg AS segment_id, field, term, df FROM df")

    # leaves
    out["match_single"] = Entry(every(match("text", "the")), o.query([a], ["a"], "has(a)", "sc(a)"))
    out["match_multi"] = Entry(every(match("text", "The, IN!")), o.query([a, b], ["a", "b"], "has(a) AND has(b)", "sc(a) + sc(b)"))
    out["match_dup_token"] = Entry(every(match("text", "the the")), o.query([a], ["a"], "has(a)", "sc(a) + sc(a)"))
    out["match_fold"] = Entry(every(match("text", "ÉÉ ñ")), o.query([o.term("x", "text", "ee"), o.term("y", "text", "n")], ["x", "y"], "has(x) AND has(y)", "sc(x) + sc(y)"))
    out["match_no_tokens"] = Entry(every(match("text", "?!")), EMPTY)
    out["match_all_fields"] = Entry(every(match("_all", "en de")), o.query([o.term("x", None, "en"), o.term("y", None, "de")], ["x", "y"], "has(x) AND has(y)", "sc(x) + sc(y)"))
    out["term_exact"] = Entry(every(term("lang", "de")), o.query([de], ["k"], "has(k)", "sc(k)"))
    out["term_upper_miss"] = Entry(every(term("lang", "DE")), EMPTY)
    out["keyword_node"] = Entry(every(Node("keyword", "source", "src3")), o.query([o.term("x", "source", "src3")], ["x"], "has(x)", "sc(x)"))
    out["keyword_match"] = Entry(every("lang:DE"), o.query([de], ["k"], "has(k)", "sc(k)"))
    out["term_all_fields"] = Entry(every(term("_all", "de")), o.query([o.term("x", None, "de")], ["x"], "has(x)", "sc(x)"))
    parts = IndexSchema.of(p_name="text", p_brand="keyword", p_size="i64")

    def part(query: Node | str) -> Query:
        return lambda spark, d: search(TableView(table(spark, d, "part").withColumn("no", F.col("p_partkey") - 1), parts, "no"), query, places=6).matched

    out["keyword_symbol_term"] = Entry(part(term("p_brand", "brand#2")), o.query([o.term("x", "p_brand", "brand#2")], ["x"], "has(x)", "sc(x)", base=o.index(keywords=("p_brand",), text="p_name", table="part", doc_id="p_partkey - 1")))
    out["keyword_symbol_match_miss"] = Entry(part(match("p_brand", "brand#2")), EMPTY)
    out["prefix"] = Entry(every(prefix("text", "thin")), o.query([o.prefix("x", "text", "thin")], ["x"], "has(x)", "sc(x)"))
    out["prefix_upper_miss"] = Entry(every("text:Thin*"), EMPTY)
    out["prefix_exists"] = Entry(every("text:*"), o.query([o.prefix("x", "text", "")], ["x"], "has(x)", "sc(x)"))
    out["prefix_all_empty"] = Entry(every("*"), EMPTY)
    out["phrase2"] = Entry(every(phrase("text", "in", "the")), o.query([o.phrase("x", "text", "in", "the")], ["x"], "has(x)", "sc(x)"))
    out["phrase3"] = Entry(every(phrase("text", "of", "the", "in")), o.query([o.phrase("x", "text", "of", "the", "in")], ["x"], "has(x)", "sc(x)"))
    out["phrase_repeated"] = Entry(every(phrase("text", "the", "the")), o.query([o.phrase("x", "text", "the", "the")], ["x"], "has(x)", "sc(x)"))
    out["phrase_unknown_term"] = Entry(every(phrase("text", "the", "qqqq")), EMPTY)
    out["phrase_all_empty"] = Entry(every('"in the"'), EMPTY)
    out["phrase_analysed_ext"] = Entry(every(phrase("text", "In", "THE"), Options(analyse_phrases=True)), o.query([o.phrase("x", "text", "in", "the")], ["x"], "has(x)", "sc(x)"))
    out["range_reference_empty"] = Entry(every(between("n_chars", gte=100, lt=1000)), EMPTY)
    out["range_i64_ext"] = Entry(every(between("n_chars", gte=100, lt=1000), Options(real_range=True)), "SELECT '0' AS segment_id, doc_id, CAST(0 AS DOUBLE) AS score FROM documents WHERE n_chars >= 100 AND n_chars < 1000")
    out["match_all"] = Entry(every(match_all()), "SELECT '0' AS segment_id, doc_id, CAST(0 AS DOUBLE) AS score FROM documents")

    # boolean combinations
    A, B, C, DE = match("text", "the"), match("text", "in"), match("text", "ha"), term("lang", "de")
    out["bool_must"] = Entry(every(boolean(must=[A, B])), o.query([a, b], ["a", "b"], "has(a) AND has(b)", "sc(a) + sc(b)"))
    out["bool_should"] = Entry(every(boolean(should=[A, DE])), o.query([a, de], ["a", "k"], "has(a) OR has(k)", "sc(a) + sc(k)"))
    out["bool_must_should_boost"] = Entry(every(boolean(must=[A], should=[B, C])), o.query([a, b, c], ["a", "b", "c"], "has(a)", "CASE WHEN has(b) OR has(c) THEN (sc(a) + sc(b) + sc(c)) * 1.1 ELSE sc(a) + sc(b) + sc(c) END"))
    out["bool_filter_zero"] = Entry(every(boolean(filter=[DE])), o.query([de], ["k"], "has(k)", "0.0::DOUBLE"))
    out["bool_filter_should"] = Entry(every(boolean(filter=[DE], should=[A])), o.query([de, a], ["k", "a"], "has(k)", "CASE WHEN has(a) THEN sc(a) * 1.1 ELSE sc(a) END"))
    out["bool_must_not"] = Entry(every(boolean(must=[A], must_not=[B])), o.query([a, b], ["a", "b"], "has(a) AND NOT has(b)", "sc(a)"))
    out["not_only"] = Entry(every(boolean(must_not=[A])), o.query([a], ["a"], "NOT has(a)", "0.0::DOUBLE"))
    out["nested_leak"] = Entry(every(boolean(should=[boolean(must=[A, C]), B])), o.query([a, b, c], ["a", "b", "c"], "(has(a) AND has(c)) OR has(b)", "sc(a) + sc(c) + sc(b)"))

    # query strings
    out["qs_implicit_and"] = Entry(every("text:the text:in"), out["match_multi"].sql)
    out["qs_not_dropped"] = Entry(every("text:the NOT text:in"), out["match_single"].sql)
    out["qs_and_not"] = Entry(every("text:the AND NOT text:in"), out["bool_must_not"].sql)
    out["qs_parentheses"] = Entry(every("(text:the AND text:ha) OR text:in"), out["nested_leak"].sql)
    out["qs_quoted_field_phrase"] = Entry(every('"text:in the"'), out["phrase2"].sql)
    out["qs_quote_after_field"] = Entry(every('text:"the in"'), o.query([o.term("x", "text", "the"), o.term("y", None, "in")], ["x", "y"], "has(x) AND has(y)", "sc(x) + sc(y)"))
    out["qs_or_chain"] = Entry(every("text:the or text:in OR lang:de"), o.query([a, b, de], ["a", "b", "k"], "has(a) OR has(b) OR has(k)", "sc(a) + sc(b) + sc(k)"))
    out["qs_bare_term"] = Entry(every("En"), o.query([o.term("x", None, "en")], ["x"], "has(x)", "sc(x)"))
    out["qs_json_request"] = Entry(lambda spark, d: search(documents(spark, d), b'{"query": {"type": "bool", "must": [{"type": "match", "field": "text", "value": "the"}, {"type": "match", "field": "text", "value": "in"}]}, "size": 5}', places=6).ranked, out["match_multi"].sql + " ORDER BY score DESC, segment_id, doc_id LIMIT 5")

    # ranking and paging
    out["top_10"] = Entry(top(match("text", "the in")), o.query([a, b], ["a", "b"], "has(a) AND has(b)", "sc(a) + sc(b)", tail=o.TOP))
    out["page_2"] = Entry(top(match("text", "the in"), 10, 10), o.query([a, b], ["a", "b"], "has(a) AND has(b)", "sc(a) + sc(b)", tail=o.TOP + " OFFSET 10"))
    out["deep_page_clamp"] = Entry(top(match("text", "the"), 10, 9_995), o.query([a], ["a"], "has(a)", "sc(a)", tail="ORDER BY score DESC, segment_id, doc_id LIMIT 10000"))
    out["total_hits"] = Entry(lambda spark, d: found(documents(spark, d), match("text", "the in")).total, o.query([a, b], ["a", "b"], "has(a) AND has(b)", "sc(a) + sc(b)", pick="count(*) AS total_hits"))
    out["hits_with_sources"] = Entry(
        lambda spark, d: found(documents(spark, d), match("text", "the in")).hits.select("doc_id", "score", F.get_json_object("source", "$.text").alias("text"), F.get_json_object("source", "$.lang").alias("lang")),
        f"SELECT r.doc_id, r.score, text, lang FROM ({out['top_10'].sql}) r JOIN documents d ON d.doc_id = r.doc_id",
    )

    # segments and deletes
    four = o.index(segment="doc_id % 4", doc_id="doc_id // 4")
    out["multi_segment_search"] = Entry(every(match("text", "the in"), segments=4), o.query([a, b], ["a", "b"], "has(a) AND has(b)", "sc(a) + sc(b)", base=four))
    out["multi_segment_top"] = Entry(top(match("text", "the in"), segments=4), o.query([a, b], ["a", "b"], "has(a) AND has(b)", "sc(a) + sc(b)", base=four, tail=o.TOP))
    tf = "tf AS (SELECT seg, doc_id, field, term, count(*)::DOUBLE AS tf FROM tok WHERE term = 'the' AND field = 'text' GROUP BY ALL)"
    out["term_frequency_ext"] = Entry(every(A, Options(term_frequency=True)), o.query([tf, f"x AS (SELECT seg, doc_id, {o.bm25('tf', 'dl')} AS s FROM tf JOIN post USING (seg, doc_id, field, term) JOIN df USING (seg, field, term) JOIN st USING (seg, field))"], ["x"], "has(x)", "sc(x)"))
    whole = "gs AS (SELECT field, sum(n) AS n, CAST(CAST(CAST(sum(sum_dl) AS BIGINT) AS FLOAT) / CAST(CAST(sum(n_dl) AS BIGINT) AS FLOAT) AS FLOAT)::DOUBLE AS avgdl FROM st GROUP BY field), gd AS (SELECT field, term, sum(df) AS df FROM df GROUP BY field, term)"
    out["global_stats_ext"] = Entry(every(A, Options(global_stats=True), segments=4), o.query([whole, f"x AS (SELECT seg, doc_id, {o.bm25('1', 'dl')} AS s FROM post JOIN gd USING (field, term) JOIN gs USING (field) WHERE term = 'the' AND field = 'text')"], ["x"], "has(x)", "sc(x)", base=four))

    def after_delete(spark: SparkSession, d: str) -> DataFrame:
        view = documents(spark, d)
        gone = search(view, term("lang", "de")).matched.select("segment_id", "doc_id")
        return found(TableView(table(spark, d, "documents"), SCHEMA, "doc_id", deletes=gone), A).matched

    out["search_after_delete"] = Entry(after_delete, o.query([a, de], ["a", "k"], "has(a)", "sc(a)", gone="has(k)"))
    out["delete_by_query_count"] = Entry(_deletes, "SELECT count(*) FILTER (lang = 'de') AS first, CAST(0 AS BIGINT) AS again, count(*) FILTER (lang <> 'de') AS left_over FROM documents")
    out["store_search"] = Entry(_stored_search, "WITH t AS (SELECT doc_id FROM documents WHERE list_contains(list_transform(regexp_extract_all(text, '[\\p{L}\\p{Nd}]+'), lambda x: nfc_normalize(strip_accents(lower(x)))), 'the')) SELECT doc_id FROM t")
    out["compact_hits"] = Entry(_compacted, "SELECT lang, count(*) AS n FROM documents WHERE lang <> 'de' GROUP BY lang")
    out["id_dedup_newest"] = Entry(
        _deduplicated,
        "WITH x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 4 DESC, turn) AS r FROM conversations) SELECT CAST(conv_id AS VARCHAR) AS id, turn FROM x WHERE r = 1",
    )

    # sources
    out["split_blank_line"] = Entry(
        lambda spark, d: _turns(spark, d).select("conv_id", F.explode(ingest.split_blank_lines(F.col("body"))).alias("part")),
        r"WITH x AS (SELECT conv_id, string_agg(text, chr(10) || '  ' || chr(10) ORDER BY turn, text) AS body FROM conversations GROUP BY conv_id), p AS (SELECT conv_id, regexp_replace(unnest(regexp_split_to_array(body, '\n[ \t\n\r\f\v]*\n')), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS part FROM x) SELECT conv_id, part FROM p WHERE part <> ''",
    )
    out["split_interchange"] = Entry(
        lambda spark, d: _interchanges(spark, d).select("conv_id", F.size(ingest.split_interchanges(F.col("body"))).cast("long").alias("parts")),
        "SELECT conv_id, count(*) AS parts FROM conversations GROUP BY conv_id",
    )
    out["ndjson_roundtrip"] = Entry(
        lambda spark, d: ingest.extracted(ingest.from_table(table(spark, d, "documents"), SCHEMA), SCHEMA).select(F.col("f_text").alias("text"), F.col("f_lang").alias("lang"), F.col("f_n_chars").alias("n_chars")),
        "SELECT text, lang, n_chars FROM documents",
    )
    out["json_extract_strict"] = Entry(
        lambda spark, d: table(spark, d, "events").select("event_id", is_json(F.col("props")).alias("valid"), json_string(F.to_json(F.struct("event_type")), "event_type").alias("type"), json_string(F.to_json(F.struct("value")), "value").alias("number")),
        "SELECT event_id, CASE WHEN props IS NULL THEN false ELSE json_valid(props) END AS valid, event_type AS type, CAST(NULL AS VARCHAR) AS number FROM events",
    )
    out["events_search"] = Entry(
        lambda spark, d: search(TableView(table(spark, d, "events").withColumn("no", F.col("event_id") - F.lit(0)), IndexSchema.of(event_type="keyword", props="text"), "no"), "event_type:error OR event_type:view", places=6).matched,
        o.query([o.term("x", "event_type", "error"), o.term("y", "event_type", "view")], ["x", "y"], "has(x) OR has(y)", "sc(x) + sc(y)", base=o.index(keywords=("event_type",), text="props", table="events", doc_id="event_id")),
    )
    out["generated_messages"] = Entry(lambda spark, d: generate.messages(spark, 1000).groupBy("message_type").agg(F.count("*").alias("n"), F.count("location").alias("with_location")))
    out["stream_ingest"] = Entry(_streamed)
    return out


def _shared(spark: SparkSession) -> str:
    """A new folder for an index, in the folder that the session shares."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="skein-")
    return f"{shared}/index-{uuid.uuid4().hex}"


def _kept(df: DataFrame) -> DataFrame:
    """df, made now: what it was read from goes away."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="skein-"))
    return df.checkpoint(eager=True)


def with_index(f: Callable[[Index, DataFrame], DataFrame], schema: IndexSchema = SCHEMA) -> Query:
    """Query on a stored index, made in the session's shared folder and removed again."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = Index.create(spark, _shared(spark), schema)
        try:
            return _kept(f(index, sf_dir))
        finally:
            index.files.delete("")

    return run


def _load(index: Index, sf_dir: str, parts: int = 4) -> None:
    docs = table(index.spark, sf_dir, "documents")
    for i in range(parts):
        index.add(ingest.from_table(docs.where(F.col("doc_id") % parts == i), SCHEMA), batch=f"b{i}")


@with_index
def _deletes(index: Index, sf_dir: str) -> DataFrame:
    _load(index, sf_dir)
    first, again = index.delete("lang:de"), index.delete("lang:DE")
    left = index.search(None).total.first()[0]
    return index.spark.createDataFrame([(first, again, left)], "first long, again long, left_over long")


_WITH_ID = IndexSchema.of(text="text", id="i64")


@functools.partial(with_index, schema=_WITH_ID)
def _stored_search(index: Index, sf_dir: str) -> DataFrame:
    docs = table(index.spark, sf_dir, "documents")
    index.add(docs.select(F.to_json(F.struct("text", F.col("doc_id").alias("id"))).alias("source")))
    v = index.view()
    hits = index.search("text:the").matched
    return hits.join(v.docs(), ["segment_id", "doc_id"]).select(F.col("f_id").alias("doc_id"))


@with_index
def _compacted(index: Index, sf_dir: str) -> DataFrame:
    _load(index, sf_dir)
    index.delete("lang:de")
    while index.compact():
        pass
    index.gc(grace_s=0)
    v = index.view()
    return index.search(None).matched.join(v.docs(), ["segment_id", "doc_id"]).groupBy(F.col("f_lang").alias("lang")).agg(F.count("*").alias("n"))


_CONV = IndexSchema.of(id_field="id", id="keyword", text="text", turn="i64")


@functools.partial(with_index, schema=_CONV)
def _deduplicated(index: Index, sf_dir: str) -> DataFrame:
    conv = table(index.spark, sf_dir, "conversations")
    for i in range(4):
        rows = conv.where(F.col("turn") % 4 == i).orderBy("turn", "conv_id")
        index.add(rows.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), "text", "turn")).alias("source")), batch=f"b{i}", single_segment=True)
    index.compact()
    return index.documents().select(json_string(F.col("source"), "id").alias("id"), F.get_json_object("source", "$.turn").cast("long").alias("turn"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["text"]), "\n  \n").alias("body"))


def _interchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("UNB+"), F.regexp_replace("text", r"\s+", " "), F.lit("'\nUNZ+1+"), F.col("turn").cast("string"), F.lit("'\n"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat_ws("", F.collect_list(line)).alias("body"))


@with_index
def _streamed(index: Index, sf_dir: str) -> DataFrame:
    from ..streaming.ingest import stream_ndjson

    docs = table(index.spark, sf_dir, "documents")
    ingest.from_table(docs, SCHEMA).write.text(index.files.url("incoming"))
    for _ in range(2):  # the second run finds nothing new
        stream_ndjson(index, index.files.url("incoming"), index.files.url("checkpoint"), interval=None).awaitTermination()
    v = index.view()
    return index.search(None).matched.join(v.docs(), ["segment_id", "doc_id"]).groupBy(F.col("f_lang").alias("lang")).agg(F.count("*").alias("n"))


@functools.cache
def catalogue() -> dict[str, Entry]:
    return _catalogue()


def queries() -> dict[str, Query]:
    return {n: e.run for n, e in catalogue().items()}


def oracle_sql() -> dict[str, str]:
    return {n: e.sql for n, e in catalogue().items() if e.sql is not None}

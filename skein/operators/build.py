"""Inverted index of documents: postings, term and field statistics, all as DataFrames.

``docs`` has segment_id, doc_id (0-based in its segment), source, and a column for each field of the schema.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import keyword, tokens, words
from ..functions.bm25 import average_length
from ..schema import TEXT, Field, IndexSchema

FIELD_PREFIX = "f_"


def column(f: Field) -> Column:
    return F.col(FIELD_PREFIX + f.name)


def analysed(docs: DataFrame, fields: Iterable[Field]) -> DataFrame:
    """(segment_id, doc_id, field, tokens): a row for each document and field that it has."""
    fields = list(fields)
    each = [F.struct(F.lit(f.name).alias("field"), (tokens(column(f)) if f.type == TEXT else F.when(column(f).isNotNull(), F.array(keyword(column(f))))).alias("tokens")) for f in fields]
    if not each:
        return docs.select("segment_id", "doc_id", F.lit("").alias("field"), F.array().cast("array<string>").alias("tokens")).where(F.lit(False))
    if len(each) == 1:  # a filter on the tokens would make them once more
        (only,) = fields
        return docs.where(column(only).isNotNull()).select("segment_id", "doc_id", each[0].alias("x")).select("segment_id", "doc_id", "x.field", "x.tokens")
    return docs.select("segment_id", "doc_id", F.explode(F.array(*each)).alias("x")).select("segment_id", "doc_id", "x.field", "x.tokens").where("tokens is not null")


def grouped(placed: Column) -> Column:
    """Array of (term, positions), by term, of an array of (term, position): sorted, and cut where the term changes, so that a
    document's tokens meet without an exchange."""
    term = lambda x, i: F.get(x, i)["term"]

    def cut(x: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (term(x, i) != term(x, i - 1)))
        both = F.array(F.struct(x["position"].alias("position"), starts.alias("starts")))
        return F.element_at(F.transform(both, lambda b: F.transform(b["starts"], lambda i, k: F.struct(term(x, i).alias("term"), F.slice(b["position"], i + 1, F.coalesce(F.get(b["starts"], k + 1), F.size(x)) - i).alias("positions")))), 1)

    none = F.array().cast("array<struct<term:string,positions:array<int>>>")
    return F.element_at(F.transform(F.array(F.sort_array(placed)), lambda x: F.when(F.size(x) > 0, cut(x)).otherwise(none)), 1)


def postings(docs: DataFrame, schema: IndexSchema) -> DataFrame:
    """(segment_id, field, term, doc_id, positions, doclen): a row for each term of each document."""
    placed = F.transform("tokens", lambda t, i: F.struct(t.alias("term"), i.alias("position")))
    rows = analysed(docs, schema.indexed()).select("segment_id", "doc_id", "field", F.size("tokens").alias("doclen"), F.explode(grouped(placed)).alias("t"))
    return rows.select("segment_id", "field", "t.term", "doc_id", "t.positions", "doclen")


def term_stats(posted: DataFrame) -> DataFrame:
    """(segment_id, field, term, df): documents of a segment that have the term."""
    return posted.groupBy("segment_id", "field", "term").agg(F.count("*").alias("df"))


def lengths(docs: DataFrame, fields: Iterable[Field]) -> DataFrame:
    """(segment_id, doc_id, field, doclen): how many tokens a document has in each field that it has; they needn't be made for that."""
    each = [F.struct(F.lit(f.name).alias("field"), (F.size(words(column(f))) if f.type == TEXT else F.when(column(f).isNotNull(), F.lit(1))).alias("doclen")) for f in fields]
    if not each:
        return docs.select("segment_id", "doc_id", F.lit("").alias("field"), F.lit(0).alias("doclen")).where(F.lit(False))
    rows = docs.select("segment_id", "doc_id", F.explode(F.array(*each)).alias("x"))
    return rows.select("segment_id", "doc_id", "x.field", "x.doclen").where("doclen is not null")


def field_stats(docs: DataFrame, schema: IndexSchema) -> DataFrame:
    """(segment_id, field, n_docs, sum_doclen, n_doclen, avgdl).

    n_docs counts all documents of the segment; n_doclen those up to the last that has the field, others before it
    having length 0. Deleted documents count as long as their segment lasts.
    """
    per = lengths(docs, schema.indexed()).groupBy("segment_id", "field").agg(F.sum("doclen").alias("sum_doclen"), (F.max("doc_id") + 1).cast("long").alias("n_doclen"))
    return with_sizes(per, docs)


def with_sizes(per: DataFrame, docs: DataFrame) -> DataFrame:
    """Field statistics of the sums of each segment and field."""
    size = docs.groupBy("segment_id").agg(F.count("*").alias("n_docs"))
    return per.join(size, "segment_id").select("segment_id", "field", "n_docs", "sum_doclen", "n_doclen", average_length(F.col("sum_doclen"), F.col("n_doclen")).alias("avgdl"))

"""Lines that recur across documents, by a log-template tree."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import BASE, bounds, cut, fresh, mix, runs, slices, sliced, words

#: Documents that a template must recur in.
MIN_DOCS = 10
#: Leading tokens that the tree branches on, after the number of tokens.
LEADING = 4
#: Share of tokens that a line must have in common with a template's first line.
SIMILAR = 0.5


#: Buckets of keys that are broadcast to leave out rows whose key can't be wanted, 16 bytes each at most.
BUCKETS = 1 << 17


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\f\x0b"))


@dataclass
class Lines:
    """Lines of a slice of documents that aren't blank, in order; line i has the tokens first[i]:first[i + 1], 0 where variable.

    leaf: number of tokens and the leading ones. kind: all tokens. line: xxhash64 of the trimmed line, as Spark has it.
    """

    doc: np.ndarray
    first: np.ndarray
    token: np.ndarray
    leaf: np.ndarray
    kind: np.ndarray
    line: np.ndarray


def lines_of(column: pa.Array, leading: int = LEADING) -> Lines:
    w = words(column, lower=False)
    digit = np.concatenate([[0], np.cumsum((w.buf >= 48) & (w.buf <= 57))])
    token = np.where(digit[w.end] > digit[w.start], np.uint64(0), w.hash)
    doc = w.doc()
    first = bounds(np.searchsorted(np.flatnonzero(w.buf == 10), w.start) + doc)
    at, n = first[:-1], np.diff(first)
    leaf = mix(n.astype(np.uint64) * np.uint64(BASE))
    for j in range(leading):
        i = np.flatnonzero(n > j)
        leaf[i] = mix(leaf[i] * np.uint64(BASE) + token[at[i] + j])
    place = np.arange(len(token)) - np.repeat(at, n)
    number = mix(np.arange(1, int(n.max(initial=0)) + 1, dtype=np.uint64) * np.uint64(BASE))
    kind = mix(np.add.reduceat(mix(token ^ number[place]), at) + leaf) if len(at) else leaf
    body = w.buf.tobytes()
    line = np.array([xxhash.xxh64_intdigest(body[a:b], 42) for a, b in zip(w.start[at].tolist(), w.end[first[1:] - 1].tolist())], np.uint64)
    return Lines(doc[at], first, token, leaf, kind, line)


def _lines(leading: int):
    """(doc_id, leaf, kind, line) of each document's distinct lines that aren't blank."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = lines_of(batch.column(1), leading)
        order = np.lexsort((x.line, x.doc))
        new = np.ones(len(order), bool)
        new[1:] = (x.doc[order[1:]] != x.doc[order[:-1]]) | (x.line[order[1:]] != x.line[order[:-1]])
        i = order[new]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0).take(pa.array(x.doc[i])), **{c: getattr(x, c)[i].view(np.int64) for c in ("leaf", "kind", "line")}})

    return sliced(run)


def _tokens(leading: int):
    """Rows (text, list of (leaf, kind, df)) to a row for each of the list, with its tokens."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = lines_of(batch.column(0), leading)
        want = {(i, w["kind"]): w for i, ws in enumerate(batch.column(1).to_pylist()) for w in ws}
        out = []
        kind = x.kind.view(np.int64)
        for i in np.flatnonzero(np.isin(kind, [k for _, k in want])).tolist():
            w = want.pop((int(x.doc[i]), int(kind[i])), None)
            if w is not None:
                out.append((w["leaf"], w["kind"], w["df"], x.token[x.first[i] : x.first[i + 1]].tobytes()))
        cols = list(zip(*out)) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["leaf", "kind", "df", "tokens"])

    return sliced(run)


def _maybe(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """rows without most of those whose key isn't one of wanted's: buckets of keys are broadcast, BUCKETS at most whatever the data."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    return rows.join(F.broadcast(wanted.select(bucket(F.col(key)).alias("__bucket")).distinct()), bucket(rows[key]) == F.col("__bucket"), "left_semi")


def templates(lines: list[np.ndarray], similar: float = SIMILAR) -> np.ndarray:
    """Template of each line of a leaf, by number. Lines are arrays of equally many token hashes, with 0 for variable tokens.

    In order, a line joins the first template whose first line has the same token in at least the share
    ``similar`` of the places, or else begins one.
    """
    t = np.stack(lines)
    out = np.full(len(t), -1)
    left = np.arange(len(t))
    number = 0
    while len(left):
        near = (t[left] == t[left[0]]).mean(axis=1) >= similar
        near[0] = True
        out[left[near]] = number
        left = left[~near]
        number += 1
    return out


def _clustered(similar: float):
    def run(batches):
        # rows: leaf, kind, tokens, sorted by leaf in the order of the kinds
        for t in runs(batches, "leaf"):
            leaf, kind = t.column(0).to_numpy(), t.column(1).to_numpy()
            tokens = [np.frombuffer(x, np.uint64) for batch in t.to_batches() for x in batch.column(2).to_pylist()]
            out = np.zeros(len(leaf), np.int64)
            at = bounds(leaf)
            for a, b in zip(at, at[1:]):
                size = np.array([len(x) for x in tokens[a:b]])
                # two leaves may share a hash: lines of other lengths are templates of their own
                base = 0
                for n in np.unique(size):
                    i = a + np.flatnonzero(size == n)
                    out[i] = base + templates([tokens[j] for j in i], similar)
                    base = out[i].max() + 1
            yield pa.RecordBatch.from_pydict({"leaf": leaf, "kind": kind, "template": out})

    return run


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, leading: int = LEADING, similar: float = SIMILAR) -> DataFrame:
    """Lines to drop: (doc_id, line), line being xxhash64 of the trimmed line, of templates that min_docs documents or more have.

    The document of the least doc_id that has a template keeps its lines, so each is left once.

    One pass over the texts makes a few numbers of each document's lines, all that is kept of most. Leaves with fewer lines than min_docs
    can't hold a recurring template and go. Lines that agree in all tokens but variable ones are of one kind and count once in the tree: of each
    kind in a leaf of several, one document's tokens are fetched and clustered; then templates' documents are counted. Counts are made by keys that hold the document or
    with a partial aggregation in each task, so a line that all documents have is no task of its own.

    NULL, empty and blank texts have no lines, nor do rows with a NULL doc_id; rows that repeat a doc_id count as one document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    lines = cut(docs.mapInArrow(_lines(leading), "doc_id long, leaf long, kind long, line long"))
    leaves = cut(lines.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf"))
    have = cut(_maybe(lines, "leaf", leaves).join(leaves, "leaf", "left_semi"))
    kinds = cut(have.groupBy("leaf", "kind").agg(F.count("*").alias("df"), F.min("doc_id").alias("doc_id")))
    several = kinds.join(kinds.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1"), "leaf", "left_semi")
    want = cut(several.groupBy("doc_id").agg(F.collect_list(F.struct("leaf", "kind", "df")).alias("want")))
    tokens = _maybe(docs, "doc_id", want).join(want, "doc_id").select("text", "want").mapInArrow(_tokens(leading), "leaf long, kind long, df long, tokens binary")
    tokens = tokens.groupBy("leaf", "kind").agg(F.first("df").alias("df"), F.first("tokens").alias("tokens"))  # a doc_id may have several rows
    found = tokens.repartition("leaf").sortWithinPartitions("leaf", F.desc("df"), "kind").select("leaf", "kind", "tokens").mapInArrow(_clustered(similar), "leaf long, kind long, template long")
    found = cut(kinds.select("leaf", "kind").join(found, ["leaf", "kind"], "left").select("leaf", "kind", F.coalesce("template", F.lit(0)).alias("template")))
    have = have.join(found, ["leaf", "kind"]).select("doc_id", "line", "leaf", "template")
    often = have.select("leaf", "template", "doc_id").distinct().groupBy("leaf", "template").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first")).where(F.col("docs") >= min_docs)
    return have.join(often, ["leaf", "template"]).where("doc_id <> first").select("doc_id", "line")


def without_recurring_lines(docs: DataFrame, count: str | None = None, **options) -> DataFrame:
    """docs with the lines that recur across documents dropped from their texts. All rows and columns stay.

    A line is a stretch of text between line feeds, trimmed. Lines of equally many tokens whose leading tokens
    agree, but for tokens that hold digits, are in one leaf of the tree. Lines of a leaf that agree in all tokens but such are of one kind; in the order of
    the kinds, those of most lines first, then by hash, a kind joins the first template with whose first kind it agrees in half of the tokens. A template
    that min_docs documents have is dropped from all of them but the one with the least doc_id.

    Blank lines stay. A NULL text stays NULL, and rows with a NULL doc_id stay as they are; a text whose lines all go becomes
    empty. Rows that repeat a doc_id count as one document. With ``count``, a column of that name has the number of lines dropped, in place of one of
    the name that docs may have.
    """
    key, gone = fresh(docs, "__id"), fresh(docs, "__drop")
    drop = recurring_lines(docs, **options).groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("line").alias(gone))
    text = F.col("text").cast("string")
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x: (_trimmed(x) == "") | ~F.array_contains(F.col(gone), F.xxhash64(_trimmed(x))))
    out = {"text": F.when(F.col(gone).isNull(), text).otherwise(F.array_join(kept, "\n"))}
    if count:
        out[count] = F.when(F.col(gone).isNull() | text.isNull(), 0).otherwise(F.size(lines) - F.size(kept))
    return docs.join(drop, docs["doc_id"].cast("long") == F.col(key), "left").withColumns(out).drop(key, gone)

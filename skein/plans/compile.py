"""Query trees to DataFrame plans.

All leaves of a tree are looked up in one scan of the postings (one more for phrases), one groupBy on the
document pivots them to a flag and a score each, and the tree becomes two Column expressions over those: whether the document
matches, and its score. The two are independent: a leaf adds its score wherever the score expression has it,
even if a conjunction that it stands in fails.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import analyse
from ..functions.bm25 import average_length, bm25
from ..schema import I64
from .nodes import ALL_FIELDS, BOOL, KEYWORD, MATCH, PHRASE, PREFIX, RANGE, TERM, Node
from .views import Found, IndexView

#: What a should clause beside must or filter multiplies the whole score by.
BOOST = 1.1
KEYS = ["segment_id", "field", "term"]
#: Of a prefix's terms, those of more than one document in so many of the whole index are often.
OFTEN = 1000


@dataclass(frozen=True)
class Options:
    """real_range: ranges over i64 fields match instead of giving nothing. term_frequency: scores use it instead of 1.
    global_stats: statistics of all segments together. analyse_phrases: phrases' terms are analysed like documents."""

    real_range: bool = False
    term_frequency: bool = False
    global_stats: bool = False
    analyse_phrases: bool = False


@dataclass
class Leaves:
    """Distinct leaves of a tree by kind, in order; numbers are their places."""

    number: dict[tuple, int] = field(default_factory=dict)

    def add(self, key: tuple) -> int:
        return self.number.setdefault(key, len(self.number))

    def of(self, kind: str) -> list[tuple[int, tuple]]:
        return [(i, k) for k, i in self.number.items() if k[0] == kind]


class Compiler:
    def __init__(self, view: IndexView, options: Options = Options()):
        self.view = view
        self.options = options
        self.leaves = Leaves()

    # leaves

    def keys(self, node: Node) -> list[tuple]:
        """Leaves that a leaf node consists of; all must match, and repeated ones score again."""
        if node.type == MATCH:
            return [("term", node.field, t) for t in analyse(node.value)]
        if node.type in (TERM, KEYWORD):
            return [("term", node.field, node.value)]
        if node.type == PREFIX:
            return [("prefix", node.field, node.value)]
        if node.type == PHRASE:
            terms = [t for x in node.terms for t in analyse(x)] if self.options.analyse_phrases else node.terms
            return [("phrase", node.field, tuple(terms))] if terms else []
        if node.type == RANGE and self.options.real_range:
            return [("range", node.field, node.gte, node.lte, node.gt, node.lt)]
        return []

    def collect(self, node: Node) -> None:
        for key in self.keys(node):
            self.leaves.add(key)
        for child in (*node.must, *node.should, *node.must_not, *node.filter):
            self.collect(child)

    # the tree as expressions; the same walk decides what holds for a document without any leaf

    def matches(self, node: Node, flag, every, some, true):
        """Whether a document matches, over any algebra: flag(leaf number), every(list), some(list), true."""
        again = lambda n: self.matches(n, flag, every, some, true)
        if node.type != BOOL:
            keys = self.keys(node)
            return every([flag(self.leaves.number[k]) for k in keys]) if keys else some([])
        base = [again(n) for n in (*node.must, *node.filter)]
        if base:
            held = every(base)
        elif node.should:
            held = some([again(n) for n in node.should])
        else:
            held = true
        if not node.must_not:
            return held
        banned = some([again(n) for n in node.must_not])
        return every([held, ~banned if isinstance(banned, Column) else not banned])

    def column(self, node: Node) -> Column:
        return self.matches(node, lambda i: F.col(f"f{i}"), lambda xs: functools.reduce(Column.__and__, xs, F.lit(True)), lambda xs: functools.reduce(Column.__or__, xs, F.lit(False)), F.lit(True))

    def without_hits(self, node: Node) -> bool:
        """Whether a document that no leaf matches is a result."""
        return bool(self.matches(node, lambda i: False, all, any, True))

    def score(self, node: Node) -> Column:
        if node.type != BOOL:
            return functools.reduce(Column.__add__, [F.col(f"s{self.leaves.number[k]}") for k in self.keys(node)], F.lit(0.0))
        parts = [self.score(n) for n in (*node.must, *node.should)]
        total = functools.reduce(Column.__add__, parts) if parts else F.lit(0.0)
        if node.should and (node.must or node.filter):
            lucky = functools.reduce(Column.__or__, [self.column(n) for n in node.should])
            total = F.when(lucky, total * BOOST).otherwise(total)
        return total

    # plans

    def stats(self, found: Found) -> DataFrame:
        s = found.stats
        if self.options.global_stats:
            whole = s.groupBy("field").agg(F.sum("n_docs").alias("n_docs"), F.sum("sum_doclen").alias("sd"), F.sum("n_doclen").alias("nd"))
            s = s.select("segment_id", "field").join(whole.withColumn("avgdl", average_length(F.col("sd"), F.col("nd"))), "field")
        return s.select("segment_id", "field", "n_docs", "avgdl")

    def frequencies(self, found: Found) -> DataFrame:
        df = found.df
        if self.options.global_stats:
            df = df.select(*KEYS).join(df.groupBy("field", "term").agg(F.sum("df").alias("df")), ["field", "term"])
        return df.select(*KEYS, "df")

    def term_hits(self) -> list[DataFrame]:
        """(segment_id, doc_id, leaf, score) of terms and prefixes."""
        terms, prefixes = self.leaves.of("term"), [(i, k) for i, k in self.leaves.of("prefix") if k[1] != ALL_FIELDS]
        by_field: dict[str, list[str]] = {}
        for _, (_, f, t) in terms:
            by_field.setdefault(f, []).append(t)
        any_of = lambda tests: functools.reduce(Column.__or__, tests)
        inside = lambda name, field: F.lit(True) if name == ALL_FIELDS else field == name
        of_terms = lambda field, term: [inside(f, field) & term.isin(ts) for f, ts in by_field.items()]
        of_prefix = lambda k: lambda field, term: (field == k[1]) & term.startswith(k[2])
        if not terms and not prefixes:
            return []
        names = None if ALL_FIELDS in by_field else {*by_field, *(k[1] for _, k in prefixes)}
        tf = self.options.term_frequency
        found = self.view.lookup(lambda field, term: any_of([*of_terms(field, term), *(of_prefix(k)(field, term) for _, k in prefixes)]), names, tf)
        stats, freq = self.stats(found), F.size("positions").cast("double") if tf else 1.0
        field, term, out = F.col("field"), F.col("term"), []
        if terms:
            here = any_of(of_terms(field, term))
            # the statistics are a row for each segment, field and term of the query
            hits = found.postings.where(here).join(F.broadcast(self.frequencies(found).where(here)), KEYS).join(F.broadcast(stats), ["segment_id", "field"])
            # an avgdl of 0 counts as 1
            score = bm25(freq, F.col("doclen"), F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl")), F.col("df"), F.col("n_docs"))
            leaves = [F.when(inside(f, field) & (term == t), F.lit(i)) for i, (_, f, t) in terms]
            out.append(hits.select("segment_id", "doc_id", F.explode(F.array_compact(F.array(*leaves))).alias("leaf"), score.alias("score")))
        for i, k in prefixes:
            here = of_prefix(k)(field, term)
            rows, df = found.postings.where(here), self.frequencies(found).where(here)
            best = rows.join(df, KEYS) if tf else self.rarest(rows, df.crossJoin(F.broadcast(stats.where(field == k[1]).agg(F.sum("n_docs").alias("all_docs")))))
            score = bm25(freq, 1.0, F.col("avgdl"), F.col("df"), F.col("n_docs"))
            out.append(best.join(F.broadcast(stats), ["segment_id", "field"]).select("segment_id", "doc_id", F.lit(i).alias("leaf"), score.alias("score")))
        return out

    def rarest(self, rows: DataFrame, df: DataFrame) -> DataFrame:
        """(segment_id, field, doc_id, df) of each document's rarest term, whose score is the best.

        Terms that a segment has in more than one document in OFTEN of all segments' are at most OFTEN times as many as a document
        has on average, and are broadcast; only postings of the others, which are few, meet their frequencies in an exchange.
        """
        often = F.col("df") * OFTEN > F.col("all_docs")
        known = rows.join(F.broadcast(df.where(often).select(*KEYS, F.col("df").alias("known"))), KEYS, "left")
        each = known.groupBy("segment_id", "field", "doc_id", F.when(F.col("known").isNull(), F.col("term")).alias("term")).agg(F.min("known").alias("known"))
        # rows without a rare term are spread over the tasks
        each = each.withColumn("apart", F.when(F.col("term").isNull(), F.col("doc_id")).otherwise(0))
        met = each.join(df.where(~often).select(*KEYS, "df", F.lit(0).cast("long").alias("apart")), [*KEYS, "apart"], "left")
        return met.groupBy("segment_id", "field", "doc_id").agg(F.min(F.coalesce("df", "known")).alias("df"))

    def phrase_hits(self) -> list[DataFrame]:
        out = []
        for i, (_, f, terms) in self.leaves.of("phrase"):
            if f == ALL_FIELDS:
                continue  # there is no such field to hold positions
            distinct = list(dict.fromkeys(terms))
            found = self.view.lookup(lambda field, term: (field == f) & term.isin(distinct), {f}, positions=True)  # noqa: B023
            place = {t: f"p{j}" for j, t in enumerate(distinct)}
            docs = found.postings.groupBy("segment_id", "doc_id").agg(*[F.max(F.when(F.col("term") == t, F.col("positions"))).alias(p) for t, p in place.items()])
            have = functools.reduce(Column.__and__, [F.col(p).isNotNull() for p in place.values()])
            docs = docs.where(have)
            # documents that hold all terms count, next to each other or not
            both = docs.groupBy("segment_id").agg(F.count("*").alias("df"))
            if self.options.global_stats:
                both = both.select("segment_id").crossJoin(both.agg(F.sum("df").alias("df")))
            first = F.col(place[terms[0]])
            rest = [(n, F.col(place[t])) for n, t in enumerate(terms)][1:]
            adjacent = F.exists(first, lambda s: functools.reduce(Column.__and__, [F.array_contains(p, s + n) for n, p in rest], F.lit(True)))
            stats = self.stats(found).where(F.col("field") == f)
            hits = docs.where(adjacent).join(both, "segment_id").join(stats, "segment_id")
            out.append(hits.select("segment_id", "doc_id", F.lit(i).alias("leaf"), bm25(float(len(terms)), 1.0, F.col("avgdl"), F.col("df"), F.col("n_docs")).alias("score")))
        return out

    def range_hits(self) -> list[DataFrame]:
        out = []
        for i, (_, f, gte, lte, gt, lt) in self.leaves.of("range"):
            kind = self.view.schema.get(f)
            if kind is None or kind.type != I64:
                continue
            v = F.col("f_" + f)
            tests = [v.isNotNull()]
            for op, b in (("__ge__", gte), ("__le__", lte), ("__gt__", gt), ("__lt__", lt)):
                if b is not None:
                    tests.append(getattr(v, op)(F.lit(b)))
            out.append(self.view.docs().where(functools.reduce(Column.__and__, tests)).select("segment_id", "doc_id", F.lit(i).alias("leaf"), F.lit(0.0).alias("score")))
        return out

    def hits(self, node: Node) -> DataFrame:
        """(segment_id, doc_id, score) of the documents that match, deleted ones too."""
        self.collect(node)
        parts = [*self.term_hits(), *self.phrase_hits(), *self.range_hits()]
        every = self.view.docs().select("segment_id", "doc_id")
        numbers = list(self.leaves.number.values())
        if parts:
            found = functools.reduce(DataFrame.unionByName, parts)
            flags = [F.max(F.col("leaf") == i).alias(f"f{i}") for i in numbers]
            # the best field or expanded term counts
            scores = [F.max(F.when(F.col("leaf") == i, F.col("score"))).alias(f"s{i}") for i in numbers]
            table = found.groupBy("segment_id", "doc_id").agg(*flags, *scores)
            if self.without_hits(node):
                table = every.join(table, ["segment_id", "doc_id"], "left")
            table = table.select("segment_id", "doc_id", *[F.coalesce(f"f{i}", F.lit(False)).alias(f"f{i}") for i in numbers], *[F.coalesce(f"s{i}", F.lit(0.0)).alias(f"s{i}") for i in numbers])
        elif self.without_hits(node):
            table = every.select("*", *[F.lit(False).alias(f"f{i}") for i in numbers], *[F.lit(0.0).alias(f"s{i}") for i in numbers])
        else:
            return every.where(F.lit(False)).withColumn("score", F.lit(0.0))
        return table.where(self.column(node)).select("segment_id", "doc_id", self.score(node).alias("score"))


def compile_query(view: IndexView, node: Node, options: Options = Options()) -> DataFrame:
    """(segment_id, doc_id, score) of the documents that match and aren't deleted; statistics count deleted ones."""
    hits = Compiler(view, options).hits(node)
    gone = view.deletes()
    return hits if gone is None else hits.join(gone.select("segment_id", "doc_id"), ["segment_id", "doc_id"], "left_anti")

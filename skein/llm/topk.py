"""Exact nearest neighbours by inner product: a ball tree per shard, searched by branch and bound."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import cut, ranges

K = 10
#: Vectors of a shard, about; the number of shards grows with the table.
SHARD = 8192
#: Pivots that vectors gather at, at most. Beyond, groups are split into shards of one ball.
MOST_PIVOTS = 4096
#: Shards that a query visits in each round, the best first; the last round has all that are left. The k-th score is taken along.
ROUNDS = (1, 3)
LEAF = 128
#: Places that scores are compared to; equal scores go by vec_id.
PLACES = 9
#: What bounds are raised by against rounding, in parts of 1 and of themselves.
SLACK = 2e-9
#: The greatest score.
MOST = np.finfo(np.float64).max
#: Queries that search a tree together.
BLOCK = 512


@dataclass
class Tree:
    """Ball tree in arrays: node i has the points begin[i]:end[i] of order, a centre, a radius, and children left[i] and left[i] + 1 (0: a leaf)."""

    points: np.ndarray
    ids: np.ndarray
    begin: list[int]
    end: list[int]
    left: list[int]
    centre: np.ndarray
    radius: np.ndarray


def build(points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Tree:
    """Nodes are halved between two far points until a leaf is small or its points are alike."""
    points = points.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        return _built(points, ids, leaf)


def _built(points: np.ndarray, ids: np.ndarray, leaf: int) -> Tree:
    order = np.arange(len(points))
    begin, end, left, centre, radius = [0], [len(points)], [0], [], []
    i = 0
    while i < len(begin):
        a, b = begin[i], end[i]
        own = points[order[a:b]]
        c = np.nan_to_num(own.mean(0), nan=0.0, posinf=MOST, neginf=-MOST)
        far = np.nan_to_num(np.linalg.norm(own - c, axis=1), nan=np.inf)
        centre.append(c)
        radius.append(float(far.max()))
        if b - a > leaf and far.max() > 0:
            p = own[far.argmax()]
            q = own[np.linalg.norm(own - p, axis=1).argmax()]
            side = own @ (q - p)
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(side, half)]
            left[i] = len(begin)
            begin += [a, a + half]
            end += [a + half, b]
            left += [0, 0]
        i += 1
    return Tree(points[order], ids[order], begin, end, left, np.array(centre), np.array(radius))


@dataclass
class Best:
    """The k best of each query so far: scores, rounded to PLACES, and ids, in order."""

    score: np.ndarray
    id: np.ndarray

    @classmethod
    def none(cls, n: int, k: int) -> Best:
        return cls(np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max))

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Adds a leaf's scores; only queries whose k-th score they reach are sorted anew, and of the leaf only as many as k, with ties."""
        k = self.score.shape[1]
        better = score >= self.score[rows, -1][:, None]
        some = better.any(1)
        if not some.any():
            return
        rows, score = rows[some], np.where(better[some], score[some], -np.inf)
        if score.shape[1] > k:
            kth = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
            most = int((score >= kth).sum(1).max())
            if most < score.shape[1]:
                # the best and all ties with the k-th, of which the least ids count
                pick = np.argpartition(-score, most - 1, axis=1)[:, :most]
                score, ids = np.take_along_axis(score, pick, axis=1), ids[pick]
        s = np.concatenate([self.score[rows], score], axis=1)
        i = np.concatenate([self.id[rows], np.broadcast_to(ids, score.shape)], axis=1)
        top = np.lexsort((i, -s), axis=1)[:, :k]
        self.score[rows] = np.take_along_axis(s, top, axis=1)
        self.id[rows] = np.take_along_axis(i, top, axis=1)


def _leaf(tree: Tree, q: np.ndarray, qid: np.ndarray, best: Best, node: int, rows: np.ndarray) -> int:
    a, b = tree.begin[node], tree.end[node]
    score = np.round(q[rows] @ tree.points[a:b].T, PLACES)
    ids = tree.ids[a:b]
    # scores that overflow count as the greatest or least numbers there are
    score = np.where(ids[None, :] == qid[rows, None], -np.inf, np.clip(np.nan_to_num(score, nan=0.0), -MOST, MOST))
    best.add(rows, score, ids)
    return score.size


@np.errstate(over="ignore", invalid="ignore")
def search(tree: Tree, q: np.ndarray, qid: np.ndarray, best: Best, floor: np.ndarray) -> int:
    """Adds to best what the tree has for the queries; returns how many scores were computed.

    floor: scores that each query's k-th is known to reach from other shards. Each query first goes down to the leaf of its greatest bounds, alone, for a k-th
    score to begin with. Then the queries of a block go down the tree together, the nodes with the
    greatest upper bounds q·centre + |q|·radius first: a node is left out for a query whose k-th score, of all nodes and shards so far, its bound doesn't reach.
    """
    q = q.astype(np.float64)
    norm = np.linalg.norm(q, axis=1)

    def bound(rows: np.ndarray, node: int) -> np.ndarray:
        upper = q[rows] @ tree.centre[node] + norm[rows] * tree.radius[node]
        return np.where(np.isfinite(upper), upper + SLACK * (1 + np.abs(upper)), np.inf)

    done = 0
    every = np.arange(len(q))
    seen = np.full(len(q), -1)
    stack = [(0, every)]
    while stack:
        node, rows = stack.pop()
        child = tree.left[node]
        if child:
            right = bound(rows, child + 1) > bound(rows, child)
            stack += [(c, part) for c, part in ((child, rows[~right]), (child + 1, rows[right])) if len(part)]
            continue
        done += _leaf(tree, q, qid, best, node, rows)
        seen[rows] = node
    stack = [(0, every, bound(every, 0))]
    while stack:
        node, rows, upper = stack.pop()
        rows = rows[upper >= np.maximum(best.score[rows, -1], floor[rows])]
        if not len(rows):
            continue
        child = tree.left[node]
        if child:
            both = [(c, rows, bound(rows, c)) for c in (child, child + 1)]
            stack += sorted(both, key=lambda x: x[2].mean())  # the greatest is popped first
            continue
        rows = rows[seen[rows] != node]
        if len(rows):
            done += _leaf(tree, q, qid, best, node, rows)
    return done


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _assigned(pivots: np.ndarray):
    def run(batches):
        for b in batches:
            v = _vectors(b.column(1), pivots.shape[1]).astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                far = (v * v).sum(1)[:, None] - 2 * v @ pivots.T + (pivots * pivots).sum(1)
                at = np.nan_to_num(far, nan=np.inf).argmin(1) if len(v) else np.zeros(0, np.int64)
                r = np.nan_to_num(np.linalg.norm(v - pivots[at], axis=1), nan=np.inf)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at.astype(np.int64)), pa.array(r)], ["vec_id", "embedding", "pivot", "far"])

    return run


def _searched(d: int, k: int):
    """Rows (shard, visitor, vec_id, embedding, floor), sorted by shard and visitor: a shard's vectors, then queries to it, streamed."""

    def run(batches):
        held: list = []
        tree, shard = None, None
        for b in batches:
            s, vis = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            ids, v, floor = b.column(2).to_numpy(), _vectors(b.column(3), d), b.column(4).to_numpy()
            cuts = [0, *(np.flatnonzero((s[1:] != s[:-1]) | (vis[1:] != vis[:-1])) + 1).tolist(), len(s)] if len(s) else []
            for x, y in zip(cuts, cuts[1:]):
                if s[x] != shard:
                    held, tree, shard = [], None, s[x]
                if not vis[x]:
                    held.append((ids[x:y], v[x:y]))
                    continue
                if tree is None:
                    tree = build(np.concatenate([w for _, w in held]), np.concatenate([i for i, _ in held]))
                    held = []
                for a in range(x, y, BLOCK):
                    part = slice(a, min(a + BLOCK, y))
                    best = Best.none(part.stop - a, k)
                    search(tree, v[part], ids[part], best, floor[part])
                    some = best.score > -np.inf
                    row = np.nonzero(some)[0]
                    yield pa.RecordBatch.from_pydict({"query_id": ids[part][row], "neighbor_id": best.id[some], "score": best.score[some]})

    return run


def _ranked(pivots: np.ndarray, radius: np.ndarray, shards: list[int], since: int, most: int | None):
    """Rows (vec_id, embedding, least) to a row for each shard that may hold one of the query's k best, those ``since`` to ``since + most`` in the order of their bounds."""
    first = np.cumsum([0, *shards])

    def rank(b: pa.RecordBatch) -> pa.RecordBatch:
        v = _vectors(b.column(1), pivots.shape[1]).astype(np.float64)
        upper = v @ pivots.T + np.linalg.norm(v, axis=1)[:, None] * radius
        upper = np.where(np.isfinite(upper), upper + SLACK * (1 + np.abs(upper)), np.inf)
        order = np.argsort(-upper, axis=1, kind="stable")  # pivots, not shards
        size = np.diff(first)[order]
        upto = np.cumsum(size, axis=1)
        lo = np.clip(since - (upto - size), 0, size)
        hi = size if most is None else np.clip(since + most - (upto - size), 0, size)
        go = np.take_along_axis(upper, order, axis=1) >= b.column(2).to_numpy()[:, None]
        row, place = np.nonzero(go & (hi > lo))
        n = (hi - lo)[row, place]
        to = ranges(first[order[row, place]] + lo[row, place], n)
        i = pa.array(np.repeat(row, n))
        return pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.ones(len(to), bool)), b.column(0).take(i), b.column(1).take(i), b.column(2).take(i)], ["shard", "visitor", "vec_id", "embedding", "floor"])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                with np.errstate(over="ignore", invalid="ignore"):
                    ranked = rank(whole.slice(at, 256))
                yield ranked

    return run


ROWS = "shard long, visitor boolean, vec_id long, embedding array<double>, floor double"
ANSWER = "query_id long, neighbor_id long, score double"


def _fine(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where("vec_id is not null and embedding is not null and size(embedding) > 0")
    fine = fine.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return fine.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, t): the k best of each query's rows so far, as a sorted array of (s, i), s being the negative score."""
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("neighbor_id").alias("i")))), 1, k)
    return found.groupBy("query_id").agg(top.alias("t"))


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, shard: int = SHARD, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """The k other vectors with the greatest inner products for every query: (query_id, neighbor_id, score, rank).

    queries (vec_id, embedding) are vectors of their own or rows of the table, all of it by default; a query and a vector of the same vec_id are the same
    and not neighbours. Exact: scores are computed in double precision and rounded to PLACES; equal ones are ranked by neighbor_id. Scores beyond the range
    of doubles count as the greatest, or least, number, undefined ones as 0.

    Vectors go to the nearest of some pivots, and large groups are split, so that a shard has about ``shard`` vectors and makes one ball tree. Queries visit shards in
    rounds, those of the greatest bounds first: the k-th score of all rounds so far is taken along, prunes the trees, and leaves out the shards of later rounds
    whose balls can't reach it. Pivots steer the search and don't change its result; the driver holds most_pivots of them at most, and two numbers of each.

    Vectors of another length than a query are no neighbours of it: each length is searched by itself. Left out are vectors that are NULL, empty, or hold a NULL, NaN or
    infinity, and rows with a NULL vec_id. Of rows that repeat a vec_id the least vector counts. With fewer than k others
    all are returned. Other columns are not looked at.
    """
    fine = cut(_fine(vectors))
    asked = fine if queries is None else cut(_fine(queries))
    out = vectors.sparkSession.createDataFrame([], "query_id long, neighbor_id long, score double, rank int")
    if k < 1:
        return out
    sizes = fine.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("c")).collect()  # a row for each length that vectors have
    for d, n in sorted((r.d, r.c) for r in sizes):
        some = F.size("embedding") == d
        out = out.union(_top_k(fine.where(some), asked.where(some), d, n, k, shard, most_pivots))
    return out


def _top_k(fine: DataFrame, asked: DataFrame, d: int, n: int, k: int, shard: int, most_pivots: int) -> DataFrame:
    want = max(1, -(-n // shard))
    pivots = np.array([r.embedding for r in fine.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(2 * want, most_pivots)).collect()])
    given = cut(fine.mapInArrow(_assigned(pivots), "vec_id long, embedding array<double>, pivot long, far double"))
    stats = {r.pivot: r for r in given.groupBy("pivot").agg(F.count("*").alias("c"), F.max("far").alias("r")).collect()}  # a row for each pivot
    parts = {p: -(-r.c // shard) for p, r in stats.items()}
    base, at = {}, 0
    for p in sorted(parts):
        base[p] = at
        at += parts[p]
    radius = np.array([stats[p].r if p in stats else -np.inf for p in range(len(pivots))])
    shards = [parts.get(p, 0) for p in range(len(pivots))]
    table = fine.sparkSession.createDataFrame([(p, base[p], parts[p]) for p in parts], "pivot long, base long, parts long")
    homes = given.join(table, "pivot").select((F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("shard"), F.lit(False).alias("visitor"), "vec_id", "embedding", F.lit(0.0).alias("floor"))
    found = None
    since = 0
    for most in (*(x for x in ROUNDS if at > x), None):
        best = None if found is None else _best(found, k)
        if best is None:
            asking = asked.withColumn("least", F.lit(float("-inf")))
        else:
            kth = best.select("query_id", F.when(F.size("t") >= k, -F.element_at("t", -1)["s"]).alias("s"))
            asking = asked.join(kth, asked.vec_id == kth.query_id, "left").select("vec_id", "embedding", F.coalesce("s", F.lit(float("-inf"))).alias("least"))
        visits = cut(asking.mapInArrow(_ranked(pivots, radius, shards, since, most), ROWS))
        # shards that nobody visits are left alone
        busy = homes.join(visits.select("shard").distinct(), "shard", "left_semi").select(*homes.columns)
        now = busy.union(visits).repartition("shard").sortWithinPartitions("shard", "visitor", "vec_id").mapInArrow(_searched(d, k), ANSWER)
        found = cut(now if found is None else found.union(now))
        since += most or 0
    return _best(found, k).select("query_id", F.posexplode("t").alias("p", "x")).select("query_id", F.col("x.i").alias("neighbor_id"), (-F.col("x.s")).alias("score"), (F.col("p") + 1).cast("int").alias("rank"))


ORACLE = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, round(list_inner_product(a.e, b.e), 9) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbor_id) AS rank FROM s)
SELECT query_id, neighbor_id, score, rank::INTEGER AS rank FROM r WHERE rank <= 10
"""

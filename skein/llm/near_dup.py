"""Near-duplicate documents by HyperMinHash."""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import BASE, BASE2, RUN_BYTES, bounds, cut, mix, ngrams, normal, ranges, raw, runs, slices, sliced, without, words

SHINGLE = 3
THRESHOLD = 0.5
BANDS = 48
ROWS = 4
#: Bits of the mantissa that a register keeps after the leading zeros' count (6 bits).
MANTISSA = 10
#: Candidate edges may be estimated so far below the threshold; exact verification follows. Those estimated lower are lost.
MARGIN = 0.12


def registers(doc: np.ndarray, h: np.ndarray, n_docs: int, k: int, mantissa: int = MANTISSA) -> np.ndarray:
    """k registers of each document: 1 + (leading zeros << mantissa | mantissa bits) of the bucket's least hash; 0 if empty."""
    bucket = ((h >> np.uint64(40)) * np.uint64(k) >> np.uint64(24)).astype(np.int64)
    rest = mix(h + np.uint64(BASE2)) >> np.uint64(4)  # 60 bits
    none = np.uint64(1) << np.uint64(60)
    least = np.full(n_docs * k, none, np.uint64)
    np.minimum.at(least, doc * k + bucket, rest)
    full = least < none
    v = np.maximum(least, np.uint64(1))
    # frexp would round; two halves of 30 bits are exact
    hi, lo = (v >> np.uint64(30)).astype(np.int64), (v & np.uint64((1 << 30) - 1)).astype(np.int64)
    bits = np.where(hi > 0, 30 + np.frexp(hi.astype(float))[1], np.frexp(lo.astype(float))[1])
    zeros = np.minimum(60 - bits, 62)
    below = np.maximum(bits - 1, 0).astype(np.uint64)
    tail = v ^ (np.uint64(1) << below)
    up = np.maximum(mantissa - below.astype(np.int64), 0).astype(np.uint64)
    down = np.maximum(below.astype(np.int64) - mantissa, 0).astype(np.uint64)
    tail = (tail << up) >> down
    out = 1 + (zeros << mantissa | tail.astype(np.int64))
    return np.where(full, out, 0).astype(np.uint16).reshape(n_docs, k)


def densified(r: np.ndarray) -> np.ndarray:
    """Empty registers take the value of the next full one, going round, mixed with the distance."""
    k = r.shape[1]
    twice = np.concatenate([r, r], axis=1)
    at = np.where(twice > 0, np.arange(2 * k), 4 * k)
    nxt = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :k]
    gap = np.minimum(nxt - np.arange(k), 2 * k)
    value = np.take_along_axis(twice, np.minimum(nxt, 2 * k - 1), axis=1)
    return value.astype(np.uint64) | gap.astype(np.uint64) << np.uint64(16)


def band_keys(r: np.ndarray, bands: int, rows: int) -> np.ndarray:
    d = densified(r)[:, : bands * rows].reshape(len(r), bands, rows)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(r), 1))
    for i in range(rows):
        key = mix(key * np.uint64(BASE) + d[:, :, i])
    return key


@functools.cache
def chance(mantissa: int) -> np.ndarray:
    """Probability that registers of unrelated sets agree, by log2 of each set's load per register from -8 to 31."""
    zeros = np.arange(0, 61)
    edge = (1 + np.arange(1 << mantissa) / (1 << mantissa)) / 2
    lo = (edge[None, :] * 2.0 ** -zeros[:, None]).ravel()
    hi = lo + (2.0 ** -zeros[:, None] * np.full(1 << mantissa, 0.5 / (1 << mantissa))[None, :]).ravel()
    load = 2.0 ** np.arange(-8, 32)[:, None]
    p = np.exp(-load * lo) - np.exp(-load * hi)
    p /= np.maximum(1 - np.exp(-load), 1e-12)
    return p @ p.T


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, mantissa: int = MANTISSA) -> np.ndarray:
    """Jaccard similarity of the sets behind rows of registers, corrected for registers that agree by chance."""
    used = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1)
    both = ((a > 0) & (b > 0)).sum(1)
    level = lambda n: np.clip(np.rint(np.log2(np.maximum(n, 1) / a.shape[1])), -8, 31).astype(int) + 8
    p = chance(mantissa)[level(na), level(nb)]
    same = np.maximum(same - p * (both - same), 0)
    return same / np.maximum(used, 1)


def _signatures(k: int, n: int):
    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = words(batch.column(1))
        doc, h = ngrams(w, n)
        reg = registers(doc, h, w.n_docs, k)
        flat, begin, _ = normal(w)
        body = memoryview(flat)
        some = np.flatnonzero(np.diff(w.first))
        digest = b"".join(hashlib.blake2b(body[begin[i] : begin[i + 1]], digest_size=16).digest() for i in some)
        same = np.frombuffer(digest, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column(0).take(pa.array(some)), "h1": same[:, 0], "h2": same[:, 1],
            "n": np.bincount(doc, minlength=w.n_docs)[some],
            "reg": pa.array([r.tobytes() for r in reg[some]], pa.binary()),
        })

    return sliced(sign)


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(raw(column)[0].tobytes(), np.uint16).reshape(len(column), k)


def _banded(bands: int, rows: int):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                keys = band_keys(_matrix(batch.column(1), bands * rows), bands, rows)
                yield pa.RecordBatch.from_pydict({"key": keys.ravel().view(np.int64), "doc_id": batch.column(0).take(pa.array(np.repeat(np.arange(len(keys)), bands)))})

    return run


def _estimated(k: int, least: float):
    def run(batches):
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            est = estimate(_matrix(c["ra"], k), _matrix(c["rb"], k), c["na"].to_numpy(), c["nb"].to_numpy())
            keep = pa.array(est >= least)
            yield pa.RecordBatch.from_pydict({"a": c["a"].filter(keep), "b": c["b"].filter(keep)})

    return run


def crossing(label: np.ndarray, n: np.ndarray, reg: np.ndarray, least: float, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with different labels whose estimate reaches ``least``: as many as connect all labels that such pairs connect.

    Each row is compared with all later ones that no pair has connected with it yet.
    """
    _, label, size = np.unique(label, return_inverse=True, return_counts=True)
    order = np.lexsort((label, size[label]))  # the label of most rows comes last: it is compared from the others' side alone
    label, n, reg = label[order], n[order], reg[order]
    a, b = [], []
    for i in range(len(order) - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        for at in range(0, len(rest), block):
            part = rest[at : at + block]
            near = part[estimate(reg[i : i + 1], reg[part], n[i : i + 1], n[part]) >= least]
            joins, one = np.unique(label[near], return_index=True)
            one = near[one][joins != label[i]]
            a += [i] * len(one)
            b += one.tolist()
            label[np.isin(label, joins)] = label[i]
    return order[np.array(a, np.int64)], order[np.array(b, np.int64)]


def _crossed(k: int, least: float):
    def run(batches):
        # rows: key, doc_id, root, n, reg, sorted by key
        for t in runs(batches, "key"):
            key, ids, root, n = (t.column(i).to_numpy() for i in range(4))
            reg = np.concatenate([_matrix(c, k) for c in t.column(4).chunks])
            at = bounds(key)
            for lo, hi in zip(at, at[1:]):
                a, b = crossing(root[lo:hi], n[lo:hi], reg[lo:hi], least)
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": ids[lo:hi][a], "b": ids[lo:hi][b]})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that undirected edges (a, b) connect each node with.

    Alternating large and small stars; every step is two shuffles of edges, cut by a checkpoint, and
    the number of steps grows with the logarithm of a component's size.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        w = Window.partitionBy("a")
        large = both.select("a", "b", F.least(F.min("b").over(w), F.col("a")).alias("m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.select("a", "b", F.min("b").over(w).alias("m"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(small.select("a", F.col("m").alias("b"))).distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


@dataclass
class Shingles:
    """Distinct shingles of a text: their hashes, sorted, and the bytes of each, flat[start:end]."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    flat: np.ndarray

    def same(self, other: Shingles, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        """Whether shingles, by place in self and in other, have the same bytes."""
        a, b = self.start[mine], other.start[theirs]
        size = self.end[mine] - a
        ok = size == other.end[theirs] - b
        i = np.flatnonzero(ok)
        if len(i):
            eq = self.flat[ranges(a[i], size[i])] == other.flat[ranges(b[i], size[i])]
            ok[i] = np.logical_and.reduceat(eq, np.cumsum(size[i]) - size[i])
        return ok


def shingles_of(column: pa.Array, n: int) -> list[Shingles]:
    """Shingles of each row of a slice."""
    w = words(column)
    flat, _, at = normal(w)
    doc, h = ngrams(w, n)
    count = np.bincount(doc, minlength=w.n_docs)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + w.first[:-1][doc]
    last = np.minimum(place + n, w.first[1:][doc]) - 1
    start, end = at[place], at[last] + (w.end - w.start)[last]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h, start, end = doc[keep], h[keep], start[order][keep], end[order][keep]
    ends = np.searchsorted(doc, np.arange(w.n_docs + 1))
    return [Shingles(h[a:b], start[a:b], end[a:b], flat) for a, b in zip(ends, ends[1:])]


def joined(sets: list[Shingles], threshold: float) -> np.ndarray:
    """Number of each set's component, where sets whose Jaccard similarity reaches the threshold are connected.

    A search that compares each set it visits with all that no component has yet: by hashes of shingles first, and where
    those suffice by the shingles' bytes.
    """
    n = len(sets)
    out = np.full(n, -1)
    size = np.array([len(s.hash) for s in sets])
    flat, start = np.concatenate([s.hash for s in sets]), np.cumsum(size) - size
    left = np.arange(n)
    number = 0
    while len(left):
        queue, left = [left[0]], left[1:]
        out[queue[0]] = number
        while queue and len(left):
            x = queue.pop()
            # a set of another size altogether can't be near
            fit = np.minimum(size[left], size[x]) >= threshold * np.maximum(size[left], size[x]) - 1e-9
            some = left[fit]
            near = np.zeros(len(left), bool)
            if len(some):
                theirs = flat[ranges(start[some], size[some])]
                at = np.minimum(np.searchsorted(sets[x].hash, theirs), size[x] - 1)
                hit = sets[x].hash[at] == theirs
                first = np.cumsum(size[some]) - size[some]
                enough = np.add.reduceat(hit.astype(np.int64), first) >= threshold * (size[some] + size[x]) / (1 + threshold) - 1e-9
                for i in np.flatnonzero(enough):
                    y = some[i]
                    b = np.flatnonzero(hit[first[i] : first[i] + size[y]])
                    k = int(sets[x].same(sets[y], at[first[i] + b], b).sum())
                    enough[i] = k >= threshold * (size[y] + size[x] - k) - 1e-9
                near[fit] = enough
            out[left[near]] = number
            queue += left[near].tolist()
            left = left[~near]
        number += 1
    return out


def _verified(n: int, threshold: float):
    def run(batches):
        # rows: root, doc_id, text, sorted by root
        for t in runs(batches, "root", most=RUN_BYTES // 4):
            roots = t.column(0).to_numpy()
            ids = t.column(1).to_numpy()
            sets = [s for batch in t.to_batches() for p in slices(batch) for s in shingles_of(p.column(2), n)]
            nodes, groups = [], []
            at = bounds(roots)
            for a, b in zip(at, at[1:]):
                if b - a < 2:
                    continue
                label = joined(sets[a:b], threshold)
                least = np.full(label.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, label, ids[a:b])
                nodes.append(ids[a:b])
                groups.append(least[label])
            if nodes:
                yield pa.RecordBatch.from_pydict({"node": np.concatenate(nodes), "grp": np.concatenate(groups)})

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Groups of documents that chains of near copies connect: (doc_id, group_id, n), for groups of 2 or more.

    Near copies have a Jaccard similarity of at least ``threshold`` over sets of word ``shingle``-grams.
    group_id is the least doc_id of the group, n its number of documents.

    Steps: (1) one pass makes each document's HyperMinHash registers and a cryptographic digest (128 bits) of its words;
    (2) documents with the same digest collapse to the least doc_id; (3) bands of registers are keys, and
    in each bucket every document is tied to the bucket's first and to the one before it; (4) the registers'
    collision-corrected estimate drops ties that are clearly below the threshold; (5) connected components of
    ties; where a bucket's documents are in several, all of its pairs across components are estimated as well and ties
    found there join components; (6) each component's texts meet once and all pairs in it that matter are compared by exact
    similarity, equal hashes of shingles being confirmed by their bytes; (7) the exact copies come back. There is no cap on a bucket, a component or its partners: documents
    that share a bucket are compared, directly or in their component.

    NULL, empty and blank texts belong to no group, nor do rows with a NULL doc_id. A text of fewer words
    than a shingle has one shingle, all its words. Rows that repeat a doc_id with the same words count as one
    document; with other words, doc_id has a row for each group that one of its texts is in. The
    result is the same for any order of rows. Other columns are not looked at.
    """
    k = bands * rows
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    sig = docs.mapInArrow(_signatures(k, shingle), "doc_id long, h1 long, h2 long, n long, reg binary")
    # a map-side combine keeps one row of each hot text per task
    reps = cut(sig.groupBy("h1", "h2").agg(F.min_by(F.struct("n", "reg"), "doc_id").alias("s"), F.min("doc_id").alias("rep")).select("h1", "h2", "rep", "s.n", "s.reg"))
    bucket = Window.partitionBy("key")
    w = bucket.orderBy("doc_id")
    keys = reps.select("rep", "reg").mapInArrow(_banded(bands, rows), "key long, doc_id long")
    keys = keys.select("key", "doc_id", F.lag("doc_id").over(w).alias("prev"), F.min("doc_id").over(bucket).alias("first"), F.count("*").over(bucket).alias("size"))
    keys = cut(keys.where("size > 1"))
    ties = keys.where("prev is not null and prev <> doc_id").select(F.explode(F.array_distinct(F.array("first", "prev"))).alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct()
    one = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("reg").alias("ra"))
    two = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("reg").alias("rb"))
    near = ties.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_estimated(k, threshold - MARGIN), "a long, b long")
    comp = components(near)
    # of up to three documents, the ties above are all pairs
    crowd = keys.where("size > 3").select("key", "doc_id").distinct().join(comp, F.col("doc_id") == comp.node, "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    crowd = crowd.select("*", F.min("root").over(bucket).alias("x"), F.max("root").over(bucket).alias("y")).where("x <> y")
    crowd = crowd.join(reps, crowd.doc_id == reps.rep).select("key", "doc_id", "root", "n", "reg")
    more = cut(crowd.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(_crossed(k, threshold - MARGIN), "a long, b long"))
    if not more.isEmpty():
        comp = components(comp.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    texts = comp.join(docs, comp.node == docs.doc_id).select("root", "doc_id", "text")
    same = texts.repartition("root").sortWithinPartitions("root", "doc_id").mapInArrow(_verified(shingle, threshold), "node long, grp long")
    same = cut(same.groupBy("node").agg(F.min("grp").alias("grp")))
    ids = sig.select("doc_id", "h1", "h2").join(reps.select("h1", "h2", "rep"), ["h1", "h2"])
    out = ids.join(same, ids.rep == same.node, "left").select("doc_id", F.coalesce("grp", "rep").alias("group_id")).distinct()
    sized = out.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1")
    return out.join(sized, "group_id").select("doc_id", "group_id", "n")


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs but those of a near-duplicate group's documents other than its least doc_id. Columns stay."""
    return without(docs, near_duplicates(docs, **options).where("doc_id <> group_id").select("doc_id"))


#: All pairs are compared, so candidates that the bands miss would show as differences.
ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
same AS (SELECT min(doc_id) AS rep, array_to_string(w, ' ') AS body FROM t WHERE len(w) > 0 GROUP BY body),
r AS (SELECT rep, string_split(body, ' ') AS w FROM same),
g AS (SELECT DISTINCT rep, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT rep, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM r)),
n AS (SELECT rep, count(*) AS n FROM g GROUP BY rep),
pair AS (SELECT a.rep AS a, b.rep AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep),
edge AS (SELECT a, b FROM pair JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE k >= 0.5 * (x.n + y.n - k)),
sym AS (SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge),
reach AS (SELECT a AS node, a AS root FROM sym UNION SELECT sym.b, reach.root FROM reach JOIN sym ON sym.a = reach.node),
grp AS (SELECT node, min(root) AS grp FROM reach GROUP BY node),
d AS (SELECT DISTINCT t.doc_id, coalesce(grp, rep) AS group_id FROM t JOIN same ON body = array_to_string(w, ' ') AND len(w) > 0 LEFT JOIN grp ON node = rep)
SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS n FROM d QUALIFY n > 1
"""

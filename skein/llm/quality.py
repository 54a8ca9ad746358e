"""Quality classifier: a convolutional network over bytes, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import cut, raw, slices

#: Labelled documents that the classifier is fitted on, at most, of each class: bad (toxic or poor), and good.
MAX_TRAIN_ROWS = 2000
#: Bytes of their texts, at most, of each class. A document that would exceed them is passed over, whole.
MAX_TRAIN_BYTES = 16 << 20
#: Fewest labelled documents of either class to fit on.
MIN_TRAIN_ROWS = 10
THRESHOLD = 0.5

WIDTH = 8
#: Lengths of the byte grams that filters may begin with, 7 at most.
GRAMS = (5, 7)
DIM = 8
FILTERS = 48
HIDDEN = 16
CHUNK = 512
#: Bytes that neighbouring chunks share, at least a filter's width less one.
OVERLAP = 32
STEPS = 500
BATCH = 48


@dataclass
class Net:
    """byte codes -> filters of WIDTH bytes -> maximum over a chunk -> hidden layer -> logit of the chunk; a document's
    logit of being bad is the greatest of its chunks'."""

    code: np.ndarray
    conv: np.ndarray
    b0: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @property
    def params(self) -> list[np.ndarray]:
        return [self.code, self.conv, self.b0, self.w1, self.b1, self.w2, self.b2]


def chunked(body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes by place in the chunk and chunk, share of each chunk that is filled, first chunk of each document).

    Chunks overlap and cover the whole document; the last is moved back to end with it. Only a document
    shorter than a chunk has an unfilled one, padded with byte 0. Empty documents have no chunk.
    """
    size = np.diff(off)
    step = CHUNK - OVERLAP
    n = np.where(size > 0, 1 + np.maximum(0, -(-(size - CHUNK) // step)), 0)
    first = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(doc)) - first[:-1][doc]
    start = off[:-1][doc] + np.minimum(k * step, np.maximum(size[doc] - CHUNK, 0))
    have = np.minimum(size[doc], CHUNK)
    at = np.arange(CHUNK)[:, None]
    index = np.minimum(start[None, :] + at, max(len(body) - 1, 0))
    m = np.where(at < have[None, :], body[index], 0) if len(body) else np.zeros((CHUNK, 0), np.uint8)
    return m.astype(np.uint8), have / CHUNK, first


def pooled(net: Net, m: np.ndarray, block: int = 32, group: int = 64) -> np.ndarray:
    """Greatest response of each filter in each chunk: (chunks, filters)."""
    code = net.code.astype(np.float32)
    conv = net.conv.astype(np.float32)
    out = np.empty((m.shape[1], conv.shape[1]), np.float32)
    for c in range(0, m.shape[1], group):
        part = code[m[:, c : c + group]]
        k = part.shape[1]
        best = None
        last = CHUNK - WIDTH + 1
        for p in range(0, last, block):
            p = min(p, last - block)
            win = np.concatenate([part[p + j : p + j + block] for j in range(WIDTH)], axis=2)
            r = (win.reshape(block * k, -1) @ conv).reshape(block, k, -1)
            h = block
            while h > 1:
                h //= 2
                r = np.maximum(r[:h], r[h : 2 * h])
            best = r[0] if best is None else np.maximum(best, r[0])
        out[c : c + k] = best
    return out


def chunk_logits(net: Net, pool: np.ndarray, fill: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.concatenate([np.maximum(pool + net.b0, 0), fill[:, None]], axis=1)
    hidden = np.maximum(x @ net.w1 + net.b1, 0)
    return hidden @ net.w2 + net.b2, hidden


def bad_logits(net: Net, body: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Logit of each document's being bad; -inf of an empty one."""
    m, fill, first = chunked(body, off)
    logit = chunk_logits(net, pooled(net, m), fill)[0] if m.shape[1] else np.zeros(0)
    out = np.full(len(off) - 1, -np.inf)
    some = np.diff(first) > 0
    if some.any():
        out[some] = np.maximum.reduceat(logit, first[:-1][some])
    return out


def _grams(text: bytes, widths: tuple[int, ...]) -> np.ndarray:
    """Distinct byte grams of a text as numbers, sorted, each with its width in the lowest bits."""
    a = np.frombuffer(text, np.uint8).astype(np.int64)
    own = []
    for width in widths:
        g = a[: max(0, len(a) - width + 1)].copy()
        for j in range(1, width if len(g) else 0):
            g = g << 8 | a[j : len(a) - width + 1 + j]
        own.append(np.unique(g) << 3 | width)
    return np.sort(np.concatenate(own))


def _telling_grams(texts: list[bytes], bad: np.ndarray, most: int, widths: tuple[int, ...] = GRAMS) -> list[bytes]:
    """Byte grams to begin filters with: each next one covers the most bad texts that none has, with few good ones."""
    held = [_grams(t, widths) for t, b in zip(texts, bad) if b]
    parts = []
    for part in range(16):  # a part of all grams at a time is sorted
        ids, count = np.unique(np.concatenate([g[(g >> 3) % 16 == part] for g in held]), return_counts=True)
        parts.append(ids[count > 1])  # others can't be chosen
    ids = np.sort(np.concatenate(parts))
    if not len(ids):
        return []

    def known(g: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(ids, g), len(ids) - 1)
        return at[ids[at] == g].astype(np.int32)

    held = [known(g) for g in held]
    inv, doc = np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.int32), [len(g) for g in held])
    good = np.zeros(len(ids), np.int64)
    for t, b in zip(texts, bad):
        if not b:
            good[known(_grams(t, widths))] += 1
    usable = good <= 0.004 * max(1, (~bad).sum())
    times = np.zeros(len(held))
    out = []
    while len(out) < most:
        score = np.bincount(inv, weights=(0.25**times)[doc], minlength=len(ids)) - 2.0 * good
        score[~usable] = -1
        g = int(score.argmax())
        if score[g] <= 1:
            break
        out.append((int(ids[g]) >> 3).to_bytes(int(ids[g]) & 7, "big"))
        usable[g] = False
        times[doc[inv == g]] += 1
    return out


def _codes(rng: np.random.Generator, counts: np.ndarray) -> np.ndarray:
    """Unit vectors for the bytes; those of frequent bytes are far apart."""
    code = rng.normal(size=(256, DIM))
    code /= np.linalg.norm(code, axis=1, keepdims=True)
    pool = rng.normal(size=(4000, DIM))
    pool /= np.linalg.norm(pool, axis=1, keepdims=True)
    near = np.full(len(pool), -1.0)
    for b in np.argsort(-counts)[:96]:
        i = int(near.argmin())
        code[b] = pool[i]
        near = np.maximum(near, pool @ pool[i])
    code[0] = 0
    return code


def fit(texts: list[bytes], bad: np.ndarray, seed: int = 7, steps: int = STEPS) -> Net:
    """Fit by Adam on a fixed number of balanced batches of whole chunks; the gradient goes through both maxima."""
    rng = np.random.default_rng(seed)
    bad = np.asarray(bad, bool)
    counts = np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256)
    code = _codes(rng, counts)
    telling = _telling_grams(texts, bad, FILTERS * 3 // 4)
    conv = np.zeros((WIDTH * DIM, FILTERS))
    plain = [t for t, b in zip(texts, bad) if not b and len(t) > 64]
    for f in range(FILTERS):
        if f < len(telling):
            g = telling[f]
        else:
            t = plain[int(rng.integers(len(plain)))] if plain else b"the of"
            at = int(rng.integers(max(1, len(t) - WIDTH)))
            g = t[at : at + WIDTH]
        for j, b in enumerate(g):
            conv[j * DIM : (j + 1) * DIM, f] = code[b] / len(g)
    net = Net(code, conv, np.zeros(FILTERS), rng.normal(scale=0.2, size=(FILTERS + 1, HIDDEN)), np.zeros(HIDDEN), rng.normal(scale=0.2, size=HIDDEN), np.zeros(1))
    # filters of telling grams respond near an exact match only, and begin with a say of their own
    n = len(telling)
    net.b0[:n] = -0.75
    net.w1[:n] *= 0.1
    net.w1[n:, : HIDDEN // 2] *= 0.1
    net.w1[np.arange(n), np.arange(n) % (HIDDEN // 2)] += 8.0
    net.w2[: HIDDEN // 2] += 1.5
    net.b1[: HIDDEN // 2] = -0.4
    net.b2[:] = -1.0
    groups = [np.flatnonzero(bad), np.flatnonzero(~bad)]
    m = [np.zeros_like(p) for p in net.params]
    v = [np.zeros_like(p) for p in net.params]
    data = [chunked(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts]
    for step in range(steps):
        pick = np.concatenate([rng.choice(g, BATCH // 2) for g in groups])
        mats = np.concatenate([data[i][0] for i in pick], axis=1)
        fill = np.concatenate([data[i][1] for i in pick])
        owner = np.repeat(np.arange(len(pick)), [len(data[i][1]) for i in pick])
        pool = pooled(net, mats)
        logit, hidden = chunk_logits(net, pool, fill)
        # the chunk that speaks for each document
        order = np.lexsort((-logit, owner))
        top = order[bounds_of(owner[order])]
        y = bad[pick].astype(float)
        p = 1 / (1 + np.exp(-np.clip(logit[top], -30, 30)))
        g = (p - y) / len(pick)
        x = np.concatenate([np.maximum(pool[top] + net.b0, 0), fill[top, None]], axis=1)
        dh = g[:, None] * net.w2[None, :] * (hidden[top] > 0)
        dpool = (dh @ net.w1.T)[:, :FILTERS] * (pool[top] + net.b0 > 0)
        # places of the maxima, in the speaking chunks alone
        part = net.code.astype(np.float32)[mats[:, top]]
        last = CHUNK - WIDTH + 1
        win = np.concatenate([part[j : j + last] for j in range(WIDTH)], axis=2)
        at = (win.reshape(last * len(top), -1) @ net.conv.astype(np.float32)).reshape(last, len(top), FILTERS).argmax(0)
        d = np.arange(len(top))[:, None]
        best = win[at, d]  # documents, filters, WIDTH * DIM
        dconv = np.einsum("df,dfk->kf", dpool, best)
        dbyte = dpool[:, :, None] * net.conv.T[None]
        dcode = np.zeros_like(net.code)
        for j in range(WIDTH):
            np.add.at(dcode, mats[at + j, top[:, None]].ravel(), dbyte[:, :, j * DIM : (j + 1) * DIM].reshape(-1, DIM))
        dcode[0] = 0
        grads = [dcode, dconv, dpool.sum(0), x.T @ dh, dh.sum(0), hidden[top].T @ g, np.array([g.sum()])]
        rate = 0.01 * min(1, (steps - step) / (0.5 * steps))
        for i, (q, gr) in enumerate(zip(net.params, grads)):
            m[i] = 0.9 * m[i] + 0.1 * gr
            v[i] = 0.999 * v[i] + 0.001 * gr * gr
            q -= (rate if i > 2 else 0.3 * rate) * (m[i] / (1 - 0.9 ** (step + 1))) / (np.sqrt(v[i] / (1 - 0.999 ** (step + 1))) + 1e-8)
    return net


def bounds_of(owner: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(doc_id, bad, text) of documents with up to ``most`` labels of each kind, toxic, poor and good: those with the least hashes of doc_id. A row for each doc_id,
    with the least of its texts.

    bad: the labels' quality is below 1 or toxic above 0. Labels that repeat a doc_id are joined to the worse; labels that are NULL count as good in
    that respect, and documents without any are not used.
    """
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    known = known.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.coalesce(F.min("quality"), F.lit(1)).alias("q"), F.coalesce(F.max("toxic"), F.lit(0)).alias("t"))
    kinds = [known.where("t > 0"), known.where("t <= 0 and q < 1"), known.where("t <= 0 and q >= 1")]
    some = None
    for bad, kind in zip((True, True, False), kinds):
        part = kind.select("__id", F.lit(bad).alias("bad")).orderBy(F.xxhash64("__id"), "__id").limit(most)
        some = part if some is None else some.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    # at most 3 * most rows of two numbers: bounded by a parameter whatever the data
    found = texts.join(F.broadcast(some), F.col("doc_id") == F.col("__id"))
    return found.groupBy("doc_id", "bad").agg(F.min("text").alias("text"))


def _chosen(rows: list, most: int, most_bytes: int) -> list[int]:
    """doc_ids of (doc_id, bytes) in the order of their hashes: as many as the bounds allow."""
    out, held = [], 0
    order = pd.util.hash_array(np.array([i for i, _ in rows], np.int64))
    for k in np.lexsort((np.array([i for i, _ in rows]), order)) if rows else ():
        i, size = rows[k]
        if len(out) < most and held + size <= most_bytes:
            out.append(i)
            held += size
    return out


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN_ROWS, most_bytes: int = MAX_TRAIN_BYTES) -> Net | None:
    """Network fitted on a sample of labelled documents, of most documents and most_bytes bytes of each class at most; None if either class has too few."""
    rows = cut(training_rows(docs, labels, most))
    sizes = rows.select("doc_id", "bad", F.octet_length("text").alias("size")).collect()  # 3 * most rows of numbers at most
    classes = [_chosen([(r.doc_id, r.size) for r in sizes if r.bad == bad], most, most_bytes) for bad in (True, False)]
    if min(map(len, classes)) < MIN_TRAIN_ROWS:
        return None
    chosen = docs.sparkSession.createDataFrame([(i,) for c in classes for i in c], "id long")  # 2 * most rows at most
    texts = {r.doc_id: r.text.encode() for r in rows.join(F.broadcast(chosen), rows.doc_id == chosen.id, "left_semi").select("doc_id", "text").toLocalIterator()}
    return fit([texts.pop(i) for c in classes for i in c], np.repeat([True, False], [len(c) for c in classes]))


def score(docs: DataFrame, net: Net | None, threshold: float = THRESHOLD) -> DataFrame:
    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                body, off = raw(batch.column(1))
                bad = bad_logits(net, body, off)
                p = np.where(np.isfinite(bad), 1 / (1 + np.exp(np.clip(bad, -60, 60))), 0.0)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "p_good": p, "keep": p >= threshold})

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if net is None:
        some = F.length(F.coalesce("text", F.lit(""))) > 0
        return docs.select("doc_id", F.when(some, 1.0).otherwise(0.0).alias("p_good"), some.alias("keep"))
    return docs.mapInArrow(run, "doc_id long, p_good double, keep boolean")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Probability that each document is good, of good quality and not toxic: (doc_id, p_good, keep).

    Every document is scored, over all of its text: filters of a few bytes slide over overlapping chunks, each
    filter's greatest response in a chunk feeds a hidden layer, and the chunk that looks worst decides. The
    network is fitted here on a bounded sample (max_train_rows documents of either class at most, whole, and MAX_TRAIN_BYTES of their texts) with a fixed seed, so the same tables give the same result.

    NULL and empty texts have p_good 0 and are not kept. Where either class has fewer than MIN_TRAIN_ROWS
    labelled documents nothing can be learned: p_good is 1 for all but those. Repeated rows are scored alike, each.
    Other columns are not looked at.
    """
    return score(docs, train(docs, labels, max_train_rows), threshold)


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The rows of docs that ``quality`` keeps. Columns stay."""
    net = train(docs, labels, max_train_rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    if net is None:
        return docs.where(F.length(text) > 0)

    @F.pandas_udf("boolean")
    def kept(s: pd.Series) -> pd.Series:
        parts = []
        whole = pa.RecordBatch.from_arrays([pa.array(s, pa.large_string())], ["text"])
        for batch in slices(whole):
            parts.append(-bad_logits(net, *raw(batch.column(0))))
        logit = np.concatenate(parts) if parts else np.zeros(0)
        return pd.Series(np.isfinite(logit) & (logit >= np.log(threshold / (1 - threshold))))

    return docs.where(kept(text))

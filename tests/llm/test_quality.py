import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import quality as Q

from .conftest import got

SF = "/root/testdata/sf0.01"


def texts(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = [rng.choice(["lorem", "ipsum", "dolor", "amet", "elit"]) for _ in range(rng.randrange(20, 300))]
        bad = i % 3 == 0
        if bad:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["scumbag", "vermin"]))
        out.append((" ".join(w), bad))
    return out


@pytest.fixture(scope="module")
def net():
    data = texts(1, 150)
    return Q.fit([t.encode() for t, _ in data], np.array([b for _, b in data]), steps=120)


def logits(net, ts):
    body = [t.encode() for t in ts]
    return Q.bad_logits(net, np.frombuffer(b"".join(body), np.uint8), np.cumsum([0, *map(len, body)]))


def test_held_out_accuracy(net):
    data = texts(2, 150)
    said = logits(net, [t for t, _ in data]) > 0
    assert (said == np.array([b for _, b in data])).mean() >= 0.95


def test_whole_text_counts(net):
    """What is bad at the very end of a long text is seen."""
    clean = "lorem ipsum dolor " * 5000
    a, b = logits(net, [clean, clean + "scumbag vermin scumbag vermin"])
    assert a < 0 < b


def test_chunks_cover_every_byte():
    rng = np.random.default_rng(1)
    for n in [0, 1, 7, 511, 512, 513, 992, 993, 5000]:
        body = rng.integers(1, 255, n).astype(np.uint8)
        m, fill, first = Q.chunked(body, np.array([0, n]))
        assert m.shape[1] == first[-1] == len(fill)
        if n:
            step = Q.CHUNK - Q.OVERLAP
            have = set()
            for k in range(m.shape[1]):
                at = min(k * step, max(n - Q.CHUNK, 0))
                assert (m[: min(n, Q.CHUNK), k] == body[at : at + Q.CHUNK]).all()
                have |= set(range(at, min(n, at + Q.CHUNK)))
            assert have == set(range(n))


def test_pooling_equals_plain_convolution(net):
    rng = np.random.default_rng(2)
    m = rng.integers(0, 256, (Q.CHUNK, 3)).astype(np.uint8)
    code = net.code.astype(np.float32)
    want = np.full((3, Q.FILTERS), -np.inf)
    for c in range(3):
        for p in range(Q.CHUNK - Q.WIDTH + 1):
            want[c] = np.maximum(want[c], code[m[p : p + Q.WIDTH, c]].ravel() @ net.conv.astype(np.float32))
    assert np.allclose(Q.pooled(net, m), want, atol=1e-4)


def test_scores_do_not_depend_on_neighbours(net):
    ts = [t for t, _ in texts(3, 40)] + [""]
    alone = np.concatenate([logits(net, [t]) for t in ts])
    assert np.allclose(logits(net, ts), alone, atol=1e-3) and alone[-1] == -np.inf


def test_odd_rows(make, spark):
    data = texts(4, 90)
    rows = [(i, t) for i, (t, _) in enumerate(data)] + [(900, None), (901, ""), (None, data[1][0]), (902, data[0][0] * 50), (1, data[1][0])]
    labels = spark.createDataFrame([(i, 1, int(b)) for i, (_, b) in enumerate(data)] + [(None, 0, 0), (3, None, None), (5000, 0, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    docs = make(rows, wide=True)
    out = Q.quality(docs, labels)
    have = out.collect()
    assert len(have) == len(rows) and out.columns == ["doc_id", "p_good", "keep"]
    keep = {r.doc_id: r.keep for r in have}
    assert not keep[900] and not keep[901] and keep[None] and keep[1] and not keep[902] and not keep[0]
    kept = Q.good_documents(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in have if r.keep)
    assert got(Q.quality(make([]), labels)) == []
    assert [r.keep for r in Q.quality(make(["x", "", None]), labels.where("false")).collect()] == [True, False, False]
    assert Q.good_documents(make(["x", "", None]), labels.where("false")).count() == 1


def test_sample_is_bounded(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    n = {r.bad: r.n for r in Q.training_rows(docs, labels, 10).groupBy("bad").agg(F.count("*").alias("n")).collect()}
    assert n[False] == 10 and 10 <= n[True] <= 20


def test_repeated_labelled_documents_count_once(make, spark):
    """A labelled doc_id that very many rows repeat is one row of the sample; bytes are bounded too."""
    data = texts(5, 60)
    docs = make([(i, t) for i, (t, _) in enumerate(data)] + [(0, data[0][0])] * 3000 + [(0, "zzz")] * 50 + [(1, "x " * 500_000)])
    labels = spark.createDataFrame([(i, 1, int(b)) for i, (_, b) in enumerate(data)], "doc_id long, quality int, toxic int")
    rows = Q.training_rows(docs, labels).collect()
    assert len(rows) == 60 and {r.doc_id: r.text for r in rows}[0] == min(data[0][0], "zzz")
    assert Q._chosen([(i, 10) for i in range(50)], 20, 95) == Q._chosen([(i, 10) for i in range(50)], 9, 1000) and len(Q._chosen([(1, 99), (2, 5)], 5, 50)) == 1
    assert Q.train(docs, labels, most_bytes=100) is None and Q.train(docs, labels, most=30) is not None


def test_logits_equal_a_plain_network(net):
    """Chunk after chunk, place after place, filter after filter."""
    docs = [t for t, _ in texts(6, 4)] + ["é", "lorem " * 150 + "scumbag", ""]
    code, conv = net.code.astype(np.float32), net.conv.astype(np.float32)
    want = []
    for d in map(str.encode, docs):
        best = -np.inf
        starts = [0] if len(d) <= Q.CHUNK else [min(s, len(d) - Q.CHUNK) for s in range(0, len(d) - Q.OVERLAP, Q.CHUNK - Q.OVERLAP)]
        for s in starts if d else ():
            c = np.frombuffer(d[s : s + Q.CHUNK].ljust(Q.CHUNK, b"\0"), np.uint8)
            x = [max(0.0, max(float(code[c[p : p + Q.WIDTH]].ravel() @ conv[:, f]) for p in range(0, Q.CHUNK - Q.WIDTH + 1)) + net.b0[f]) for f in range(Q.FILTERS)]
            x.append(min(1, (len(d) - s) / Q.CHUNK))
            hidden = [max(0.0, sum(x[i] * net.w1[i, j] for i in range(len(x))) + net.b1[j]) for j in range(Q.HIDDEN)]
            best = max(best, float(sum(h * w for h, w in zip(hidden, net.w2)) + net.b2[0]))
        want.append(best)
    assert np.allclose(logits(net, docs), want, atol=1e-3)

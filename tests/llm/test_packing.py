import random

import pytest

from skein.llm import packing as P
from skein.llm.tokens import VOCABULARY, Codes, encoding, ids_of

from .conftest import got


def brute(lengths, capacity):
    """Remaining capacities after best-fit decreasing of single pieces."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            best = min(fit)
            rooms.remove(best)
            rooms.append(best - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 100])
    lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 400))]
    plan = P.best_fit_decreasing({n: lengths.count(n) for n in set(lengths)}, capacity)
    import numpy as np

    ordered = np.array(sorted(lengths, reverse=True))
    rank = np.array([list(ordered[:i]).count(n) for i, n in enumerate(ordered)])
    window, at = P.place(plan, ordered, rank)
    used = {}
    for w, a, n in zip(window.tolist(), at.tolist(), ordered.tolist()):
        used.setdefault(w, []).append((a, n))
    for pieces in used.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:]))
    assert sorted(capacity - sum(n for _, n in p) for p in used.values()) == brute(lengths, capacity)
    assert sorted(used) == list(range(plan.windows))


def check(rows, out, capacity):
    windows, docs = {}, {}
    for w, at, d, start, n in out:
        windows.setdefault(w, []).append((at, n))
        docs.setdefault(d, []).append((start, n))
    assert sorted(windows) == list(range(len(windows)))
    for pieces in windows.values():
        pieces.sort()
        assert pieces[0][0] == 0 and pieces[-1][0] + pieces[-1][1] <= capacity
        assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:]))
    want = {}
    for d, n in rows:
        if n:
            want[d] = want.get(d, 0) + n
    assert {d: sum(n for _, n in p) for d, p in docs.items()} == want
    return windows


def pieces(spark, rows, capacity):
    out = [(i, a, min(capacity, n - a), bytes([a % 256])) for i, n in rows for a in range(0, n or 0, capacity)] + [(i, 0, n, b"") for i, n in rows if not n]
    return spark.createDataFrame(out, "doc_id long, start long, n_tokens long, codes binary")


def test_pieces_are_packed_whole(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 1, 5, 32, 33, 64, rng.randrange(200)])) for i in range(300)] + [(7, 40), (None, 3), (400, None)] + [(500, 17)] * 200
    out = got(P.packed(pieces(spark, rows, 32), capacity=32))
    assert all(c == bytes([start % 256]) for *_, start, _, c in out)
    windows = check(rows, [r[:-1] for r in out], 32)
    tails = [n % 32 for _, n in rows if n and n % 32]
    assert len(windows) == len(brute(tails, 32)) + sum(n // 32 for _, n in rows if n)
    assert sorted(32 - sum(n for _, n in p) for p in windows.values()) == brute([min(32, n - a) for _, n in rows for a in range(0, n or 0, 32)], 32)


def test_no_task_takes_all_pieces_of_a_length(spark):
    """A third of all rows are alike: they are numbered by partition."""
    out = P.packed(pieces(spark, [(1, 7)] * 300 + [(2, 9)] * 600, 32).repartition(8), 32)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(n_tokens" in plan and "__part" in plan.split("Window", 1)[1].split("\n", 1)[0]


def test_empty_and_texts(make, spark):
    assert got(P.packed(pieces(spark, [], 9))) == []
    assert got(P.packed_documents(make([]))) == []
    with pytest.raises(ValueError):
        P.packed(pieces(spark, [(1, 10)], 10), 9)
    rows = [(1, "a b c"), (2, ""), (3, None), (4, "word " * 5000), (1, "a b c"), (None, "x"), (5, " " * 2_000_000 + "end")]
    enc = encoding(VOCABULARY)
    out = got(P.packed_documents(make(rows, wide=True)))
    check([(i, len(ids_of(enc, t)) + 1 if t else 0) for i, t in rows], [r[:-1] for r in out], P.CAPACITY)


def decoded(out, capacity=P.CAPACITY):
    """Documents and windows from the codes alone."""
    enc = encoding(VOCABULARY)
    docs, windows = {}, {}
    for w, at, d, start, n, codes in out:
        ids = Codes(codes).all().tolist()
        assert len(ids) == n
        docs.setdefault(d, []).append((start, ids))
        windows.setdefault(w, []).append((at, ids))
    texts = {}
    for d, parts in docs.items():
        ids = [x for _, part in sorted(parts) for x in part]
        assert ids[-1] == enc.n_vocab and enc.n_vocab not in ids[:-1]
        texts[d] = enc.decode(ids[:-1])
    for parts in windows.values():
        assert sum(len(p) for _, p in parts) <= capacity
    return texts


def test_windows_hold_the_documents_tokens(make, spark):
    from skein.llm.queries import op10_packing

    rows = [(i, "wörd " * n + "end") for i, n in enumerate([1, 3, 500, 2047, 2048, 5000, 9])]
    assert decoded(P.packed_documents(make(rows)).collect()) == dict(rows)
    sf = "/root/testdata/sf0.001"
    assert decoded(op10_packing(spark, sf).collect()) == {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text}

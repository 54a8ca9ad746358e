import random

import pytest

from skein.llm import suffix_dedup as S

from .conftest import got


def brute(rows, length=51):
    rows = [(i, t.encode().lower().split()) for i, t in rows if i is not None and t is not None]
    seen = {}
    for i, w in rows:
        for s in range(len(w) - length + 1):
            seen.setdefault(tuple(w[s : s + length]), set()).add(i)
    out = set()
    for i, w in rows:
        spans = []
        for s in range(len(w) - length + 1):
            ids = seen[tuple(w[s : s + length])]
            if len(ids) < 2:
                continue
            if spans and s <= spans[-1][1]:
                spans[-1][1], spans[-1][2] = s + length, min(spans[-1][2], min(ids))
            else:
                spans.append([s, s + length, min(ids)])
        out |= {(i, *x) for x in spans}
    return sorted(out, key=repr)


def corpus(seed, n_docs=30, vocabulary=50):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passages = [[word() for _ in range(rng.randrange(40, 150))] for _ in range(6)]
    rows = []
    for i in range(n_docs):
        w = []
        for _ in range(rng.randrange(4)):
            w += [word() for _ in range(rng.randrange(90))]
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            w += p[a:] if rng.random() < 0.5 else p
        rows.append((i, ("\n" if i % 3 else "  ").join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(make, seed):
    rows = corpus(seed)
    assert got(S.repeated_passages(make(rows))) == brute(rows)


def test_few_words_and_ties(make):
    rows = [(0, "a " * 200), (1, "A " * 70), (2, "a b " * 60), (3, "b a " * 40)]
    assert got(S.repeated_passages(make(rows))) == brute(rows)


def test_boundary_of_50_and_51_words(make):
    p = [f"p{i}" for i in range(51)]
    rows = [(0, "x " + " ".join(p[:50]) + " y"), (1, "z " + " ".join(p[:50]) + " v"), (2, " ".join(p)), (3, "q " + " ".join(p) + " r")]
    assert got(S.repeated_passages(make(rows))) == [(2, 0, 51, 2), (3, 1, 52, 2)] == brute(rows)


def test_many_copies_with_different_surroundings(make):
    rng = random.Random(9)
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{rng.randrange(999)}" for _ in range(30)) + " " + p + " " + " ".join(f"w{rng.randrange(999)}" for _ in range(30))) for i in range(400)]
    assert got(S.repeated_passages(make(rows))) == brute(rows)


def test_odd_rows(make):
    long = " ".join(f"t{i % 9000}" for i in range(50_000))
    rows = [(1, None), (2, ""), (3, "short"), (None, long), (5, long), (5, long), (6, "x " + long)]
    assert got(S.repeated_passages(make(rows, wide=True))) == [(5, 0, 50_000, 5), (6, 1, 50_001, 5)]
    assert got(S.repeated_passages(make([]))) == []


def test_collisions_are_verified(monkeypatch, make):
    """With a hash of few bits everything still comes out right, as words are compared."""
    import numpy as np

    from skein.llm._text import Words, words

    w = words(__import__("pyarrow").array(["aa bb cc dd aa bb", "cc dd"]))
    weak = Words(w.buf, w.start, w.end, w.first, w.hash & np.uint64(1))
    s = S.Suffixes(weak, 2)
    assert len(set(s.word.tolist())) == 4
    assert s.word[0] == s.word[4] and s.word[1] == s.word[5] and s.word[2] == s.word[6]


def peak(rows, length=51):
    """Peak MB of Python's memory while contexts of one anchor are sorted, and the windows that come out. rows: (doc_id, text); the anchor is each text's word 27."""
    import itertools
    import tracemalloc

    import pyarrow as pa

    found = pa.struct({"h": pa.int64(), "at": pa.int32(), "lo": pa.int32(), "hi": pa.int32()})
    docs = [
        pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array([t for _, t in part]), pa.array([[{"h": 7, "at": 27, "lo": 0, "hi": len(t.split()) - length}] for _, t in part], pa.list_(found))], ["doc_id", "text", "found"])
        for part in itertools.batched(rows, 2_000)
    ]
    table = pa.Table.from_batches(S._contexts(length)(docs))
    table = table.sort_by([(c, "ascending") for c in ("h", "off", "ctx") if c in table.column_names]).combine_chunks()
    tracemalloc.start()
    n = sum(int((b.column(2).to_numpy() - b.column(1).to_numpy() - length + 1).sum()) for b in S._sorted(length)(table.to_batches(max_chunksize=10_000)))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most, n


def test_memory_does_not_grow_with_alike_contexts():
    """one anchor in very many documents with the same words around it."""
    text = " ".join(f"w{i}" for i in range(60))
    most, n = peak([(i, text) for i in range(20_000)])
    assert n == 200_000
    assert most < 60


def test_memory_does_not_grow_with_different_contexts():
    """one anchor in very many documents with other words around it in each."""
    middle = " ".join(f"w{i}" for i in range(24))
    most, n = peak([(i, " ".join(f"x{i + j}" for j in range(27)) + f" {middle} " + " ".join(f"y{i - j}" for j in range(9))) for i in range(20_000)])
    assert n == 200_000  # all windows go on
    assert most < 100


def test_anchors_with_many_different_contexts(make):
    """windows that go on one by one give the same passages."""
    rng = random.Random(4)
    p = " ".join(f"passage{i}" for i in range(60))
    word = lambda: f"w{rng.randrange(999)}"
    texts = [" ".join([word() for _ in range(30)] + [p] + [word() for _ in range(30)]) for _ in range(2_000)]
    texts += [t.replace(" ", "\n") + " end" for t in texts[::90]] + [t for _, t in corpus(5)] + ["the " * 90, "The\t" * 70]
    rows = [*enumerate(texts), *enumerate(texts[:3])]
    df = S.repeated_passages(make(rows).repartition(1), most_kinds=50)
    assert got(df) == brute(rows)

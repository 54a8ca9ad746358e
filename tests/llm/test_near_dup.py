import random

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import near_dup as N

from .conftest import Wide, got, thue_morse


def prose(rng, n, words=400):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def shingles(text, n=3):
    w = text.encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold=0.5):
    """Groups by comparing all pairs."""
    rows = [(i, t) for i, t in rows if i is not None and t is not None and shingles(t)]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if len(s & t) >= threshold * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    groups = {}
    for i in root:
        groups.setdefault(find(i), []).append(i)
    return sorted(((i, g, len(m)) for g, m in groups.items() if len(m) > 1 for i in m), key=repr)


def test_groups_equal_brute_force(make):
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        base = prose(rng, rng.randrange(5, 300))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = [w if rng.random() > 0.04 else "x" + w for w in base]
            texts.append("  ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want, have = set(brute(rows)), set(got(N.near_duplicates(make(rows))))
    assert len(want & have) >= 0.95 * len(want)  # candidates are found by chance
    assert {r[0] for r in have} <= {r[0] for r in want}


def test_large_group_of_copies_and_a_chain(make):
    rng = random.Random(4)
    base = prose(rng, 120)
    rows = [(i, " ".join(base)) for i in range(300)]
    for i in range(300, 330):
        base = [w if rng.random() > 0.02 else "y" + w for w in base]
        rows.append((i, " ".join(base)))
    assert got(N.near_duplicates(make(rows))) == brute(rows)


def test_odd_rows(make, spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b c"), (5, "one"), (6, "ONE "), (7, "one two"), (8, long), (9, long + " more"), (8, long)]
    assert got(N.near_duplicates(make(rows))) == [(5, 5, 2), (6, 5, 2), (8, 8, 2), (9, 8, 2)]
    assert got(N.near_duplicates(make([]))) == []
    left = N.without_near_duplicates(make(rows, wide=True))
    assert left.columns == make([], wide=True).columns
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == ["1", "2", "3", "5", "7", "8", "8", "None"]


def test_texts_of_equal_polynomial_hashes(make):
    one, two = thue_morse(2048)
    kinds = thue_morse(1024)
    rows = [(1, one), (2, two), (3, " ".join("yes" if c == "a" else "no" for c in kinds[0])), (4, " ".join("yes" if c == "a" else "no" for c in kinds[1])), (5, one + " x y z"), (6, two.upper())]
    assert got(N.near_duplicates(make(rows))) == brute(rows)
    assert {i for i, g, _ in brute(rows) if g == 2} == {2, 6}


def test_equal_hashes_are_confirmed_by_bytes(monkeypatch):
    """With hashes that are all alike, components are still those of the shingles themselves."""
    texts = ["a b c d e", "a b c d e f", "p q r s t", "p q r s t u", "x y"]
    real = N.ngrams
    monkeypatch.setattr(N, "ngrams", lambda w, n: (real(w, n)[0], np.arange(len(real(w, n)[1]), dtype=np.uint64) - np.repeat(np.searchsorted(real(w, n)[0], np.arange(w.n_docs)), np.bincount(real(w, n)[0], minlength=w.n_docs)).astype(np.uint64)))
    sets = N.shingles_of(pa.array(texts), 3)
    assert N.joined(sets, 0.5).tolist() == [0, 0, 1, 1, 2]


def test_same_doc_id_with_two_texts(make):
    rows = [(1, "a b c d"), (2, "e f g h"), (3, "a b c d"), (3, "e f g h")]
    assert got(N.near_duplicates(make(rows)).select("doc_id", "group_id")) == [(1, 1), (2, 2), (3, 1), (3, 2)]


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_estimate_is_close(share):
    rng = np.random.default_rng(1)
    n, k = 4000, 192
    both = rng.integers(0, 2**63, int(2 * n * share / (1 + share)), dtype=np.uint64)
    one, two = (np.concatenate([both, rng.integers(0, 2**63, n - len(both), dtype=np.uint64)]) for _ in range(2))
    reg = [N.registers(np.zeros(n, int), x, 1, k) for x in (one, two)]
    est = N.estimate(reg[0], reg[1], np.array([n]), np.array([n]))[0]
    assert abs(est - share) < 0.12


def test_registers_keep_zeros_and_mantissa():
    h = np.array([5], np.uint64)
    r = N.registers(np.zeros(1, int), h, 1, 4)
    assert (r > 0).sum() == 1
    rest = int(N.mix(h + np.uint64(N.BASE2))[0]) >> 4
    bits = rest.bit_length()
    tail = (rest - (1 << bits - 1)) >> bits - 1 - N.MANTISSA
    assert r.max() == 1 + ((60 - bits) << N.MANTISSA | tail)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)]
    root = {}
    for a, b in edges:
        if a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got(N.components(spark.createDataFrame(edges, "a long, b long"))) == sorted(root.items(), key=repr)


def test_a_component_of_several_chunks_is_compared_whole(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"root": [1] * 4, "doc_id": [1, 2, 3, 4], "text": ["a b c d", "e f g h", "a b c d", "e f g h"]})
    monkeypatch.setattr(N, "runs", lambda batches, key, **most: [Wide(batch.slice(0, 2), batch.slice(2))])
    out = pa.Table.from_batches(N._verified(3, 0.5)([])).to_pydict()
    assert out == {"node": [1, 2, 3, 4], "grp": [1, 2, 1, 2]}


def test_near_copies_with_unlike_documents_between_them(make, monkeypatch):
    def one_bucket(bands, rows):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"key": [1] * b.num_rows, "doc_id": b.column(0)})

        return run

    rng = random.Random(6)
    base = [prose(rng, 200) for _ in range(6)]
    rows = [(i, " ".join(w if rng.random() > 0.06 * (i > 5) else "x" + w for w in base[i % 6])) for i in range(12)]
    monkeypatch.setattr(N, "_banded", one_bucket)
    assert got(N.near_duplicates(make(rows))) == brute(rows) and len(brute(rows)) == 12


def test_crossing_connects_what_all_pairs_connect():
    rng = np.random.default_rng(2)
    base = rng.integers(1, 2000, (12, 192)).astype(np.uint16)
    reg = base[rng.integers(0, 12, 90)]
    reg = np.where(rng.random(reg.shape) < 0.35, rng.integers(1, 2000, reg.shape).astype(np.uint16), reg)
    n, label = np.full(90, 400), rng.integers(0, 60, 90)

    def connected(pairs):
        to = label.copy()
        for a, b in pairs:
            to[to == to[a]] = to[b]
        return {(i, j) for i in range(90) for j in range(90) if to[i] == to[j]}

    pairs = [(i, j) for i in range(90) for j in range(i) if N.estimate(reg[i : i + 1], reg[j : j + 1], n[:1], n[:1])[0] >= 0.38]
    have = list(zip(*N.crossing(label, n, reg, 0.38, block=7)))
    assert set(have) <= set(pairs) | {(b, a) for a, b in pairs} and connected(have) == connected(pairs)

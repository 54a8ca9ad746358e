import random

import numpy as np
import pytest

from skein.llm import decontaminate as D

from .conftest import got


def brute(docs, items, passage=13, least=1):
    out = {}
    for item, text in items:
        w = text.encode().lower().split() if text is not None else []
        if item is None or len(w) < least:
            continue
        wanted = {tuple(w[i : i + passage]) for i in range(max(1, len(w) - passage + 1))}
        for d, t in docs:
            if d is None or t is None:
                continue
            v = t.encode().lower().split()
            n = min(passage, len(w))
            hit = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} & wanted
            if hit:
                out.setdefault((d, item), set()).update(hit)
    return sorted(((d, i, len(x)) for (d, i), x in out.items()), key=repr)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_equals_brute_force(make, spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["a", "an", "the", "of", "été", "xylophone", "q"])
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 5, 8, 13, 14, 40])))) for i in range(40)]
    docs = []
    for i in range(80):
        w = [word() for _ in range(rng.randrange(60))]
        if rng.random() < 0.5:
            p = rng.choice(items)[1].split()
            a = rng.randrange(len(p))
            w += p[a // 2 :] + [word() for _ in range(9)]
        docs.append((i, ("\n " if i % 2 else " ").join(w).upper() if i % 5 == 0 else " ".join(w)))
    assert got(D.contaminated(make(docs), bench(spark, items))) == brute(docs, items)


@pytest.mark.parametrize("sizes", [(5, 6, 7), (1, 2, 3, 20), (1,), (40, 41)])
def test_search_finds_every_occurrence(sizes, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(D, "PAIRS", 50)
    items = [(i, " ".join(rng.choice("abcde") for _ in range(rng.choice(sizes)))) for i in range(30)]
    flat = (" " + " ".join([*(rng.choice("abcde") for _ in range(4000)), *(t for _, t in items)]) + " ").encode()
    have, want = [], set()
    for p in D.compile_patterns(items):
        pos, pat = D.search(p, np.frombuffer(flat, np.uint8), lane=64)
        strings = [p.body[a : a + n].tobytes() for a, n in zip(p.off, p.size)]
        have += [(i, int(p.item[j]), strings[j]) for i, j in zip(pos.tolist(), pat.tolist())]
        want |= {(i, int(p.item[j]), s) for j, s in enumerate(strings) for i in range(len(flat)) if flat.startswith(s, i)}
    assert set(have) == want and len(have) == len(want)
    assert {s for _, _, s in want} == {b" " + b" ".join(t.encode().split()[k : k + 13]) + b" " for _, t in items for k in range(max(1, len(t.split()) - 12))}


def test_items_of_few_words(make, spark):
    items = [(1, "a"), (2, "is it"), (3, "É"), (4, "one two three four"), (5, "no such"), (6, ".")]
    docs = [(1, "a"), (2, "ba ab"), (3, "Is  IT?"), (4, "so is\nit"), (5, "É é"), (6, "zero one two three four five"), (7, "it is"), (8, " . ")]
    want = [(1, 1, 1), (4, 2, 1), (5, 3, 1), (6, 4, 1), (8, 6, 1)]
    assert got(D.contaminated(make(docs), bench(spark, items))) == want == brute(docs, items)
    assert got(D.contaminated(make(docs), bench(spark, items), least=4)) == [(6, 4, 1)]


def test_tables_are_small():
    """Passages are places in one text, not copies of it."""
    rng = random.Random(3)
    words = [f"w{i}x" * (1 + i % 2) for i in range(20_000)]
    items = [(i, " ".join(rng.choices(words, k=500))) for i in range(600)]
    size = sum(len(t) for _, t in items)
    tables = D.compile_patterns(items)
    table = sum(a.nbytes for p in tables for a in (p.off, p.size, p.item, p.keys, p.member)) + tables[-1].body.nbytes
    assert size > 2 << 20 and table < 5.5 * size


def test_words_must_be_whole(make, spark):
    items = [(1, "one two three four five")]
    docs = ["xone two three four five", "one two three four fives", "one two three four five", "ONE\ttwo  three\nfour five."]
    assert got(D.contaminated(make(docs), bench(spark, items))) == [(2, 1, 1)]


def test_several_passes_give_the_same(make, spark, monkeypatch):
    items = [(i, f"alpha{i} beta gamma delta epsilon{i} zeta") for i in range(20)]
    docs = [(i, " ".join(t for _, t in items[i : i + 3])) for i in range(20)]
    want = got(D.contaminated(make(docs), bench(spark, items)))
    monkeypatch.setattr(D, "MOST_BYTES", 100)
    assert got(D.contaminated(make(docs), bench(spark, items))) == want == brute(docs, items)


def test_odd_rows(make, spark):
    q = "one two three four five six"
    items = [(1, q), (1, q), (2, None), (None, q), (3, ""), (4, "too short"), (5, q)]
    docs = [(1, None), (2, ""), (3, "pad " * 100_000 + q), (None, q), (5, q), (5, q + " " + q)]
    assert got(D.contaminated(make(docs, wide=True), bench(spark, items))) == [(3, 1, 1), (3, 5, 1), (5, 1, 1), (5, 5, 1)] == brute(docs, items)
    left = D.decontaminated(make(docs, wide=True), bench(spark, items))
    assert left.columns == make([], wide=True).columns and sorted(map(str, (r.doc_id for r in left.collect()))) == ["1", "2", "None"]
    assert got(D.contaminated(make([]), bench(spark, items))) == []
    assert got(D.contaminated(make(docs), bench(spark, []))) == []
    with pytest.raises(ValueError):
        D.compile_patterns([(1, q)], passage=0)

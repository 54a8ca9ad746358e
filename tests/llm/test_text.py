import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from skein.llm import _text as X

from .conftest import thue_morse


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t ß"))))
def test_words_are_those_of_split(ts):
    w = X.words(pa.array(ts, pa.string()))
    have = [[w.buf[a:b].tobytes() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.first, w.first[1:])]
    assert have == [(t or "").encode().lower().split() for t in ts]
    two = X.words_sliced(pa.array(ts, pa.string()), most=7)
    assert all((getattr(w, n) == getattr(two, n)).all() for n in ("buf", "start", "end", "first", "hash"))


@given(st.lists(st.text(alphabet="ab ", max_size=30)), st.integers(1, 4))
def test_ngrams(ts, n):
    w = X.words(pa.array(ts, pa.string()))
    doc, h = X.ngrams(w, n)
    want = []
    for i, t in enumerate(ts):
        v = t.split()
        want += [(i, tuple(v[k : k + n])) for k in range(max(1, len(v) - n + 1))] if v else []
    assert [d for d, _ in want] == doc.tolist()
    assert len(set(h.tolist())) == len({g for _, g in want})


def test_slices_and_runs_lose_nothing():
    batch = pa.RecordBatch.from_pydict({"k": [1, 1, 2, 3, 3, 3, 4], "text": ["a" * 10, None, "", "b" * 99, "c", "d", "e"]})
    assert sum((b.column(1).to_pylist() for b in X.slices(batch, most=16)), []) == batch.column(1).to_pylist()
    got = list(X.runs([batch.slice(0, 2), batch.slice(2, 2), batch.slice(4)], "k", least=2))
    assert [t.column("k").to_pylist() for t in got] == [[1, 1], [2, 3, 3, 3], [4]] and list(X.runs([], "k")) == []


def test_runs_end_by_bytes_too():
    batch = pa.RecordBatch.from_pydict({"k": [1, 1, 2, 3, 4, 4], "text": ["a" * 5, "b" * 5, "c", "d" * 9, None, "e"]})
    got = list(X.runs([batch.slice(0, 1), batch.slice(1)], "k", most=10))
    assert [t.column("k").to_pylist() for t in got] == [[1, 1], [2, 3], [4, 4]]
    assert [x for t in got for x in t.column("text").to_pylist()] == batch.column(1).to_pylist()


def test_hashes_tell_apart_what_powers_of_two_do_not():
    one, two = thue_morse(4096)
    w = X.words(pa.array([one + " " + two]))
    assert w.hash[0] != w.hash[1]
    values = np.array([ord(c) for c in one + two], np.uint64)
    h = X.Rolling(values).of(np.array([0, 4096]), np.array([4096, 8192]))
    assert h[0] != h[1]


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40), st.data())
def test_rolling_hashes_are_those_of_the_parts(values, data):
    n = len(values)
    i = data.draw(st.integers(0, n))
    j = data.draw(st.integers(i, n))
    part = np.array(values[i:j], np.uint64)
    whole = X.Rolling(np.array(values, np.uint64)).of(np.array([i]), np.array([j]))
    assert whole == X.Rolling(part).of(np.array([0]), np.array([j - i]))
    want = [sum(v % p * pow(X.BASE % p, k, p) for k, v in enumerate(part.tolist())) % p for p in X.PRIMES]
    assert whole[0] == want[0] << 32 | want[1]


@given(st.lists(st.binary(min_size=1, max_size=30), min_size=1))
def test_span_hashes_do_not_depend_on_the_place(parts):
    flat = np.frombuffer(b"".join(parts), np.uint8)
    end = np.cumsum([len(p) for p in parts])
    h = X.spans_hash(flat, end - [len(p) for p in parts], end).tolist()
    assert h == [int(X.spans_hash(np.frombuffer(p, np.uint8), np.array([0]), np.array([len(p)]))[0]) for p in parts]
    assert len(set(h)) == len(set(parts))


@given(st.lists(st.text(alphabet="aB é\n\t")))
def test_normal_texts(ts):
    flat, begin, at = X.normal(X.words(pa.array(ts, pa.string())))
    want = [t.encode().lower().split() for t in ts]
    assert [flat[a:b].tobytes() for a, b in zip(begin, begin[1:])] == [b" " + b"".join(x + b" " for x in w) for w in want]
    flat = flat.tobytes()
    assert [flat[a : a + len(x)] for a, x in zip(at, (x for w in want for x in w))] == [x for w in want for x in w]

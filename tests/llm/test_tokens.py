import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from skein.llm import tokens as T


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**20), st.integers(0, 2**63))), st.integers(1, 16))
def test_round_trip_and_random_access(ids, bits):
    codes = T.Codes(T.encode(np.array(ids, np.uint64), bits))
    assert codes.all().tolist() == ids and len(codes) == len(ids)
    assert [codes[i] for i in range(len(ids))] == ids


def test_access_over_many_rank_entries():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 20_000).astype(np.uint64)
    codes = T.Codes(T.encode(ids))
    at = rng.integers(0, len(ids), 500)
    assert [codes[int(i)] for i in at] == ids[at].tolist()
    with pytest.raises(IndexError):
        codes[len(ids)]
    with pytest.raises(ValueError):
        T.Codes(b"nothing of the kind")


def test_documents_decode_to_their_bytes(make, spark):
    enc = T.encoding(T.VOCABULARY)
    rows = [(1, "Hello, wörld <|endoftext|>\n\t  x"), (2, ""), (3, None), (None, "a"), (5, "z é " * 50_000), (1, "Hello"), (6, "a" + " " * 300_000 + "\n" * 300_000 + "b")]
    out = T.token_codes(make(rows, wide=True)).collect()
    assert len(out) == len(rows)
    have = sorted((str(r.doc_id), r.n_tokens, None if r.codes is None else enc.decode(T.Codes(r.codes).all().tolist())) for r in out if r.codes is not None)
    assert have == sorted((str(i), len(T.ids_of(enc, t)), t) for i, t in rows if t is not None)
    assert [(r.doc_id, r.n_tokens) for r in out if r.codes is None] == [(3, None)]
    assert T.token_codes(make([])).count() == 0


SPACES = " \n\t\r\x0b\x85\xa0\u1680\u2003\u2028\u3000\x1c"


@given(st.lists(st.tuples(st.text(alphabet="aZé,.'s1_ ", max_size=8), st.text(alphabet=SPACES, max_size=30))), st.integers(2, 12))
def test_ids_are_those_of_the_whole_text(parts, long):
    text = "".join(a + b for a, b in parts)
    enc = T.encoding(T.VOCABULARY)
    kept, T.SPACE = T.SPACE, re.compile(T.SPACE.pattern.rsplit("{", 1)[0] + "{%d,}" % long)
    try:
        assert T.ids_of(enc, text) == enc.encode_ordinary(text)
    finally:
        T.SPACE = kept


@pytest.mark.parametrize("space", [" ", "\n", "\t", " \n", "\u3000 "])
def test_long_white_space(space):
    enc = T.encoding(T.VOCABULARY)
    for text in ("a" + space * 40_000 + "b", space * 40_000, "a " + space * 40_000):
        assert T.ids_of(enc, text) == enc.encode_ordinary(text)
    huge = "x y" + space * (5_000_000 // len(space)) + "z" + space * 5000
    assert enc.decode(T.ids_of(enc, huge)) == huge


def plain(blob):
    """Ids of codes, by the layout alone: chunk after chunk, with bitmaps read bit by bit and ranks counted anew."""
    assert blob[:4] == b"DAC1"
    bits, n_levels, at, levels = blob[4], blob[5], 14, []
    wide = 1 if bits <= 8 else 2
    for _ in range(n_levels):
        n = int.from_bytes(blob[at : at + 8], "little")
        at += 8
        chunks = [int.from_bytes(blob[at + wide * i : at + wide * (i + 1)], "little") for i in range(n)]
        at += wide * n
        more = [blob[at + i // 8] >> i % 8 & 1 for i in range(n)]
        at += -(-n // 8)
        ranks = [int.from_bytes(blob[at + 8 * i : at + 8 * (i + 1)], "little") for i in range(-(-n // 512))]
        at += 8 * len(ranks)
        assert ranks == [sum(more[: 512 * i]) for i in range(len(ranks))]
        levels.append((chunks, more))
    assert at == len(blob) and int.from_bytes(blob[6:14], "little") == (len(levels[0][0]) if levels else 0)
    out, nexts = [], [0] * n_levels
    for _ in range(int.from_bytes(blob[6:14], "little")):
        k, value = 0, 0
        while True:
            i = nexts[k]
            nexts[k] += 1
            value |= levels[k][0][i] << k * bits
            if not levels[k][1][i]:
                break
            k += 1
        out.append(value)
    return out


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**20), st.integers(0, 2**63)), max_size=40), st.integers(1, 16))
def test_an_independent_decoder_reads_the_codes(ids, bits):
    assert plain(T.encode(np.array(ids, np.uint64), bits)) == ids


def test_the_query_equals_a_plain_encoder(spark):
    from skein.llm.queries import op4_token_codes

    enc = T.encoding(T.VOCABULARY)
    sf = "/root/testdata/sf0.001"
    want = sorted((r.doc_id, enc.encode_ordinary(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted((r.doc_id, plain(r.codes)) for r in op4_token_codes(spark, sf).collect()) == want

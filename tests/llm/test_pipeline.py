import numpy as np
import pytest

import corpus_pipeline as P

from skein.llm import packing, tokens
from skein.llm._text import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage makes of what the one before left."""
    docs, out = table(spark, SF, "documents"), []
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF).cache()
        docs.count()
        out.append(docs)
    yield out
    for d in out:
        d.unpersist()


def test_stages():
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]


def test_columns_stay_and_rows_only_go(spark, steps):
    docs = table(spark, SF, "documents")
    before = {r.doc_id for r in docs.collect()}
    for d in steps[:-1]:
        assert d.columns == docs.columns and [f.dataType for f in d.schema] == [f.dataType for f in docs.schema]
        now = [r.doc_id for r in d.collect()]
        assert len(now) == len(set(now)) and set(now) <= before
        before = set(now)


def test_each_stage_equals_its_brute_force(spark, steps):
    from .test_decontaminate import brute as leaks
    from .test_line_dedup import brute as lines
    from .test_near_dup import brute as groups

    rows = [[(r.doc_id, r.text) for r in d.collect()] for d in steps[:-1]]
    assert sorted(rows[1], key=repr) == lines(rows[0])
    gone = {i for i, g, _ in groups(rows[1]) if i != g}
    assert {i for i, _ in rows[2]} == {i for i, _ in rows[1]} - gone
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert {i for i, _ in rows[3]} == {i for i, _ in rows[2]} - {d for d, _, _ in leaks(rows[2], items)}
    enc = tokens.encoding(tokens.VOCABULARY)
    from .test_packing import check, decoded

    assert decoded(steps[4].collect()) == {i: t for i, t in rows[3] if t}

    packed = [tuple(r)[:-1] for r in steps[4].collect()]
    check([(i, len(enc.encode_ordinary(t)) + 1 if t else 0) for i, t in rows[3]], packed, packing.CAPACITY)


def test_length_follows_the_text(steps):
    assert all(r.n_chars == len(r.text) for r in steps[1].collect())


def test_run_gives_the_last_stage(spark, steps):
    """Which of the pieces of one length goes where depends on the order of the rows; all else is equal."""
    one, two = P.run(spark, SF).collect(), steps[4].collect()
    for pick in (lambda r: (r.window_id, r.at, r.n_tokens), lambda r: (r.doc_id, r.start, r.n_tokens, bytes(r.codes))):
        assert sorted(map(pick, one)) == sorted(map(pick, two))


def test_toxic_go_and_clean_stay(spark, steps):
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in steps[0].collect()}
    good = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    bad = [i for i, r in labels.items() if r.toxic == 1]
    assert np.mean([i in kept for i in good]) >= 0.9
    assert np.mean([i not in kept for i in bad]) >= 0.7

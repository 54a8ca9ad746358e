"""Work that would grow faster than the input, or be done more than once."""

import pytest

from skein.operators.search import search
from skein.plans import catalogue, compile
from skein.plans.nodes import prefix
from skein.plans.views import TableView
from skein.schema import IndexSchema

SF = "/root/testdata/sf0.001"


def ran(df):
    """The lines of the plan that ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()


def analyses(lines):
    return sum("Project" in x and "regexp_extract_all" in x or "Generate" in x and "regexp_extract_all" in x for x in lines)


def test_a_prefix_reads_texts_once(spark):
    assert analyses(ran(catalogue.queries()["prefix_exists"](spark, SF))) == 1


@pytest.mark.parametrize("often", [1, 2, 1000])
def test_the_rarest_term_of_a_prefix_counts(spark, monkeypatch, often):
    """Whether its terms are often (broadcast) or rare (met in an exchange), with documents of only the one or the other."""
    monkeypatch.setattr(compile, "OFTEN", often)
    docs = ["a a b", "a", "a b c", "a b", "x", "d a", None, "c c"]
    view = TableView(spark.createDataFrame(list(enumerate(docs)), "id long, text string"), IndexSchema.of(text="text"), "id")
    got = {r.doc_id: r.score for r in search(view, prefix("text", "")).matched.collect()}
    df = {w: sum(w in (d or "").split() for d in docs) for w in "abcdx"}
    rarest = {i: min(df[w] for w in d.split()) for i, d in enumerate(docs) if d}
    one = {n: search(view, prefix("text", next(w for w in df if df[w] == n))).matched.first().score for n in set(rarest.values())}
    assert got == pytest.approx({i: one[n] for i, n in rarest.items()})


def test_postings_are_made_without_an_exchange(spark):
    lines = ran(catalogue.queries()["postings_positions"](spark, SF))
    assert not any("Exchange" in x for x in lines) and analyses(lines) == 1


def test_positions_meet_in_any_order_of_terms(spark):
    from skein.operators import build

    docs = ["b a b a a", "", "é e É", None, "x", "w " * 3000 + "v " + "w"]
    rows = spark.createDataFrame([("0", i, d) for i, d in enumerate(docs)], "segment_id string, doc_id long, f_text string")
    got = {(r.doc_id, r.term): (r.positions, r.doclen) for r in build.postings(rows, IndexSchema.of(text="text")).collect()}
    want = {}
    for i, d in enumerate(docs):
        ws = (d or "").replace("é", "e").replace("É", "e").split()
        for w in ws:
            want[i, w] = ([p for p, x in enumerate(ws) if x == w], len(ws))
    assert got == want


def shuffled(spark):
    """Bytes written for exchanges so far."""
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


@pytest.fixture
def noise(spark, tmp_path):
    """An index of eight segments and the bytes of its texts, which don't compress."""
    import json
    import random

    from skein.operators.store import Index

    draw = random.Random(1)
    texts = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz0123456789 ") for _ in range(20_000)) for _ in range(40)]
    index = Index.create(spark, str(tmp_path / "noise"), IndexSchema.of(text="text", n="i64"))
    before = shuffled(spark)
    for i in range(4):
        mine = [(json.dumps({"text": t, "n": n}),) for n, t in enumerate(texts) if n % 4 == i]
        index.add(spark.createDataFrame(mine, "source string").repartition(2), batch=f"b{i}")
    return index, sum(map(len, texts)), shuffled(spark) - before


def test_an_ingest_moves_no_postings(noise):
    """Beside the rows that the test deals out and the documents, dealt out again to few files' tasks, only frequencies move."""
    _, size, moved = noise
    assert moved < 4 * size


def test_a_merge_moves_texts_once(spark, noise):
    index, size, _ = noise
    index.delete("text:a")
    gone, before = index.search(None).total.first()[0], shuffled(spark)
    assert index.compact()
    assert shuffled(spark) - before < 3 * size and index.search(None).total.first()[0] == gone
    (merged,) = index.manifest().active()
    assert sorted(r.doc_id for r in index.view().docs().collect()) == list(range(merged.doc_count))


def test_numbers_of_a_merge_are_dense_over_blocks(spark, tmp_path, monkeypatch):
    import json

    from skein.operators import store

    monkeypatch.setattr(store, "BLOCK", 3)
    index = store.Index.create(spark, str(tmp_path / "blocks"), IndexSchema.of(text="text", n="i64"))
    for i in range(4):
        index.add(spark.createDataFrame([(json.dumps({"text": f"w{n % 2}", "n": 10 * i + n}),) for n in range(10)], "source string").coalesce(1), batch=f"b{i}")
    index.delete("w1")
    assert index.compact()
    got = [r.f_n for r in index.view().docs().orderBy("doc_id").collect()]
    assert len(got) == 20 and all(got[k : k + 5] == sorted(got[k : k + 5]) and len({n // 10 for n in got[k : k + 5]}) == 1 for k in range(0, 20, 5))
    assert [r.doc_id for r in index.view().docs().orderBy("doc_id").collect()] == list(range(20))


@pytest.mark.parametrize("levels", [0, 1, 2, 6])
def test_sums_are_exact_at_every_level(spark, levels):
    from itertools import accumulate

    from pyspark.sql import functions as F

    from skein.functions import analysis

    lists = [[(i * 7) % 11 for i in range(n)] for n in (0, 1, 7, 8, 9, 63, 64, 65, 512, 513, 5000)] + [None]
    df = spark.createDataFrame([(x,) for x in lists], "xs array<int>")
    got = [r[0] for r in df.select(F.when(F.col("xs").isNotNull(), analysis._sums(F.col("xs"), levels))).collect()]
    assert got == [None if x is None else list(accumulate(x, initial=0))[:-1] for x in lists]


def test_offsets_of_any_length_copy_no_tokens(spark):
    """No array of tokens is appended to: of the plan's arrays that are, there is the one of the last level's numbers."""
    from pyspark.sql import functions as F

    from skein.functions.analysis import token_offsets

    plan = spark.createDataFrame([("a b",)], "t string").select(token_offsets(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert "concat(" not in plan or all("term" not in x[:200] for x in plan.split("concat(")[1:])


def test_one_segment_keeps_the_order_over_tasks(spark, tmp_path):
    """Sorted rows of several partitions become one segment, written by several tasks, in their order."""
    import json

    from skein.operators.store import Index

    index = Index.create(spark, str(tmp_path / "one"), IndexSchema.of(n="i64"))
    rows = spark.createDataFrame([(json.dumps({"n": n}), n) for n in range(200)], "source string, n long").repartition(7).repartitionByRange(5, "n").sortWithinPartitions("n")
    assert index.add(rows, batch="b", single_segment=True) == 200
    docs = index.view().docs()
    assert len(index.manifest().active()) == 1 and [r.f_n for r in docs.orderBy("doc_id").collect()] == list(range(200))
    assert [r.doc_id for r in docs.orderBy("doc_id").collect()] == list(range(200)) and len(docs.inputFiles()) > 1
    assert index.files.names("staging") == []
    with pytest.raises(ValueError):
        index.add(spark.createDataFrame([("{broken",)], "source string"), single_segment=True)
    assert index.files.names("staging") == [] and len(index.files.names("docs")) == 1


SEARCHES = ["match_single", "match_fold", "qs_json_request", "match_all_fields", "total_hits", "qs_implicit_and", "top_10", "bool_should", "match_multi", "term_frequency_ext", "phrase2", "multi_segment_search"]


@pytest.mark.parametrize("name", SEARCHES)
def test_a_search_reads_texts_once(spark, name):
    assert analyses(ran(catalogue.queries()[name](spark, SF))) == 1


@pytest.mark.parametrize("name", ["keyword_node", "keyword_match"])
def test_a_keyword_search_reads_no_texts(spark, name):
    lines = ran(catalogue.queries()[name](spark, SF))
    assert analyses(lines) == 0 and not any("FileScan" in x and "text#" in x for x in lines)


def test_small_segments_make_no_term_often(spark, monkeypatch):
    """Terms are often by the documents of all segments, so that many small segments don't send all their terms to every task."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(compile, "OFTEN", 10)
    docs = [(i, str(i % 20), i // 20, f"a w{i}") for i in range(100)]
    view = TableView(spark.createDataFrame(docs, "id long, seg string, no long, text string"), IndexSchema.of(text="text"), "no", segment=F.col("seg"))
    sent = []
    monkeypatch.setattr(F, "broadcast", lambda df: (sent.append(df), df)[1])
    rows = search(view, prefix("text", "")).matched.collect()
    assert len(rows) == 100 and len({r.score for r in rows}) == 1
    assert max(df.count() for df in sent if "known" in df.columns) == 0

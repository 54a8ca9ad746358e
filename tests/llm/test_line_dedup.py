import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skein.llm import line_dedup as L

from .conftest import Wide, got

WHITE = " \t\r\f\x0b"


def brute(rows, min_docs=10, leading=4, similar=0.5):
    leaves = {}
    docs = [(i, t) for i, t in rows if i is not None and t is not None]
    mask = lambda t: "<*>" if re.search("[0-9]", t) else t
    for i, t in docs:
        for line in t.split("\n"):
            line = line.strip(WHITE)
            if line:
                w = tuple(map(mask, re.split(r"[ \t\n\x0b\f\r]+", line)))
                leaves.setdefault((len(w), w[:leading]), {}).setdefault(w, {}).setdefault(line, set()).add(i)
    drop = {}
    for leaf in leaves.values():
        found = []
        # the order among kinds of equally many lines is that of their hashes
        order = lambda x: (-sum(map(len, x[1].values())), int(L.lines_of(pa.array([next(iter(x[1]))])).kind.view(np.int64)[0]))
        for w, lines in sorted(leaf.items(), key=order):
            for first, ids, members in found:
                if sum(a == b for a, b in zip(first, w)) >= similar * len(w):
                    break
            else:
                first, ids, members = w, set(), []
                found.append((first, ids, members))
            for line, own in lines.items():
                ids |= own
                members.append(line)
        for _, ids, members in found:
            if len(ids) >= min_docs:
                for m in members:
                    drop[m] = min(ids)
    out = []
    for i, t in rows:
        if i is None or t is None:
            out.append((i, t))
            continue
        out.append((i, "\n".join(x for x in t.split("\n") if drop.get(x.strip(WHITE), i) == i)))
    return sorted(out, key=repr)


def test_lines_are_hashed_as_spark_does(make, spark):
    texts = ["x" * n + "é" for n in range(100)] + ["  a  b\t", "c d\r"]
    want = [r[0] for r in make(texts).orderBy("doc_id").select(F.xxhash64(F.trim("text", F.lit(WHITE)))).collect()]
    assert L.lines_of(pa.array(texts)).line.view(np.int64).tolist() == want
    x = L.lines_of(pa.array(["a 1\n\n b 2\n", None, "", "\n", "a 7"]))
    assert x.doc.tolist() == [0, 0, 4] and x.first.tolist() == [0, 2, 4, 6] and x.kind[0] == x.kind[2] != x.kind[1] and x.leaf[0] == x.leaf[2]


def test_a_line_of_all_documents_is_no_task_of_its_own(make):
    """Nothing is windowed by leaf or template, and counts are aggregated partially."""
    rows = [(i, f"same here\nown{i} word\npage {i}") for i in range(40)]
    drop = L.recurring_lines(make(rows))
    plan = drop._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_count" in plan
    assert drop.count() == 3 * 39


def test_equals_brute_force(make):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 12)):
            kind = rng.randrange(6)
            lines.append([
                f"user u{rng.randrange(99)} logged in from {rng.randrange(255)}.1.2.3", "All rights reserved.", f"  page {rng.randrange(30)} of 7\t",
                " ".join(rng.choice(["aa", "bb", "cc"]) for _ in range(6)), "", f"line that {i} alone has",
            ][kind])
        rows.append((i, "\n".join(lines)))
    want = brute(rows)
    assert got(L.without_recurring_lines(make(rows))) == want
    assert want != sorted(rows, key=repr)


def test_threshold_and_first_keeper(make):
    nine, ten = [(i, f"same here\nown{i} word") for i in range(9)], [(i, f"same here\nown{i}x word y{'z' * i}") for i in range(10, 20)]
    assert got(L.without_recurring_lines(make(nine))) == brute(nine)
    out = dict(got(L.without_recurring_lines(make(ten))))
    assert out[10].startswith("same here\n") and all("same here" not in out[i] for i in range(11, 20))


def test_odd_rows(make):
    rows = [(i, "footer 1\n\nbody") for i in range(12)] + [(50, None), (51, ""), (None, "footer 1"), (3, "footer 2"), (60, "x" * 300_000 + "\nfooter 9"), (61, "\n\n")]
    out = L.without_recurring_lines(make(rows, wide=True), count="count")
    assert out.columns == make([], wide=True).columns
    have = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    assert have == brute(rows)
    n = {r["doc_id"]: r["count"] for r in out.collect()}
    assert n[0] == 0 and n[5] == 2 and n[50] == 0 and n[None] == 0 and n[60] == 1
    assert got(L.without_recurring_lines(make([]))) == []


def test_a_leaf_of_several_chunks_is_clustered_whole(monkeypatch):
    tokens = [np.array(x, np.uint64).tobytes() for x in ([1, 2, 3, 4], [1, 2, 3, 5], [6, 7, 8, 9], [6, 7, 8, 5])]
    batch = pa.RecordBatch.from_pydict({"leaf": [7] * 4, "kind": [1, 2, 3, 4], "tokens": pa.array(tokens, pa.binary())})
    monkeypatch.setattr(L, "runs", lambda batches, key: [Wide(batch.slice(0, 1), batch.slice(1))])
    out = pa.Table.from_batches(L._clustered(0.5)([])).to_pydict()
    assert out == {"leaf": [7] * 4, "kind": [1, 2, 3, 4], "template": [0, 0, 1, 1]}


def test_the_query_equals_brute_force(spark):
    from skein.llm.queries import op9_line_dedup

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(((r.doc_id, r.text) for r in op9_line_dedup(spark, sf).collect()), key=repr) == brute(rows)

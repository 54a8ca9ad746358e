import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as E
from skein.plans import catalogue

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = Path(SF, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def same(a, b):
    return len(a) == len(b) and all(x == y or isinstance(x, float) and abs(x - y) < 1e-6 for r, s in zip(a, b) for x, y in zip(r, s))


@pytest.mark.parametrize("name", ["field_stats", "token_offsets", "match_multi", "match_all_fields", "phrase3", "prefix", "nested_leak", "bool_must_should_boost", "multi_segment_top", "global_stats_ext", "search_after_delete", "split_interchange"])
def test_equals_sql(spark, duck, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = duck.execute(E.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())
    assert same(sorted(tuple(r[c] for c in cols) for r in df.collect()), want)


def test_entry(spark):
    assert E.entry(spark).count() == 10


def test_every_statement_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries()) and set(catalogue.queries()) <= set(E.queries())


def test_works_without_the_optional_part(tmp_path):
    """The entry and the rest of the library need neither the subpackage nor the pipeline."""
    import shutil

    shutil.copytree(ROOT / "skein", tmp_path / "skein", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'match_multi' in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_nothing_outside_imports_the_optional_part():
    for p in (ROOT / "skein").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text())

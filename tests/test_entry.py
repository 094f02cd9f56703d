"""The contract's functions, with and without the optional subpackage."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_names():
    import __spark_entry__ as e

    assert len(e.queries()) >= 70 and set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_corpus_operators(tmp_path):
    """A copy without the optional folders still imports and keeps its own queries."""
    for item in ("helixspark", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / item), str(tmp_path)], check=True)
    (tmp_path / "helixspark" / "llm").rename(tmp_path / "elsewhere") if (tmp_path / "helixspark" / "llm").exists() else None
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def test_small_results_against_duckdb(spark):
    """A few queries against their SQL on the smallest tables, where these are there."""
    import duckdb
    import pytest

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    import __spark_entry__ as e

    for name in ("gc_content", "kmer3_step3", "codon_usage_by_lang", "translate_f", "list_sp_tree", "peaks_islands"):
        con = duckdb.connect()
        for f in Path(d).iterdir():
            con.sql(f"create view {f.stem} as select * from '{f}'")
        df = e.queries()[name](spark, d)
        cur = con.execute(f"SELECT {', '.join(df.columns)} FROM ({e.oracle_sql()[name]})")
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, cur.fetchall())), name

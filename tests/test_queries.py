"""Every query with SQL gives what DuckDB gives, at the smallest scale."""

import os

import duckdb
import pytest

from tabulon import queries as registry

SF = "/root/testdata/sf0.001"
registry.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
HEAVY: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if value is None or value != value:
        return None
    value = value.item() if hasattr(value, "item") else value
    return float(value) + 0.0 if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) - HEAVY))
def test_against_sql(spark, duck, name):
    got = rows(registry.QUERIES[name](spark, SF).toPandas())
    want = rows(duck.sql(registry.ORACLES[name]).df())
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_data_subpackage(tmp_path):
    """The library and its entry point stand without the subpackage and the pipeline."""
    import shutil
    import subprocess
    import sys

    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{home}/tabulon", tmp_path / "tabulon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{home}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op') for n in q) and len(q) > 100; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True, timeout=60)

"""Every registered query with SQL against that SQL; the driver's entry; the guard around the optional part."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from wavelath.plans import catalog


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, sf_dir, tables, name):
    found = catalog.queries()[name](spark, sf_dir).toPandas()
    expected = tables.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    assert [str(found[c].dtype) for c in columns] == [str(expected[c].dtype) for c in columns]
    rows = [sorted(map(tuple, df[columns].itertuples(index=False))) for df in (found, expected)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_without_sql(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["user_id", "frame", "bin", "power"] and found.count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_part(tmp_path):
    """The entry imports where the optional modules are not there, and fails where one of them is broken."""
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    (tmp_path / "wavelath").mkdir()
    for name in os.listdir(f"{root}/wavelath"):
        if name != "llm":
            os.symlink(f"{root}/wavelath/{name}", tmp_path / "wavelath" / name)
    os.symlink(f"{root}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    ask = [sys.executable, "-c", "import __spark_entry__ as e; print(sorted(q for q in e.queries() if q.startswith('op') or q == 'pipeline'))"]
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    said = subprocess.run(ask, cwd=tmp_path, env=env, capture_output=True, text=True)
    assert said.stdout.strip() == "[]", said.stderr
    (tmp_path / "wavelath" / "llm").mkdir()
    (tmp_path / "wavelath" / "llm" / "registry.py").write_text("import a_module_that_is_not_there")
    assert subprocess.run(ask, cwd=tmp_path, env=env, capture_output=True).returncode != 0

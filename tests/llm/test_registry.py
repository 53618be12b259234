"""What SQL can compute of the operators, against that SQL."""

import os

import duckdb
import pytest

from wavelath.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{table}'")
    found = registry.queries()[name](spark, sf_dir).toPandas()
    expected = con.sql(registry.oracle_sql()[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    assert [str(found[c].dtype) for c in columns] == [str(expected[c].dtype) for c in columns]
    rows = [sorted(map(tuple, df[columns].itertuples(index=False))) for df in (found, expected)]
    assert rows[0] == rows[1]


def test_pieces_are_bounded_in_rows_and_bytes(monkeypatch):
    import pyarrow as pa

    from wavelath.llm import common

    monkeypatch.setattr(common, "PIECE", 1000)
    texts = ["x" * (k % 7 * 200) for k in range(100)]
    got = list(common.pieces([pa.RecordBatch.from_pydict({"text": texts}), pa.RecordBatch.from_pydict({"text": []}), pa.RecordBatch.from_pydict({"text": ["y" * 5000, "z"]})], 30))
    assert [t for b in got for t in b.column("text").to_pylist()] == [*texts, "y" * 5000, "z"]
    assert all(b.num_rows <= 30 and (b.num_rows == 1 or b.nbytes <= 1000) for b in got)

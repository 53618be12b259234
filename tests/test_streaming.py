"""Streams in several triggers give what the whole table gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelath.operators import filters, sequences
from wavelath.streaming import ahead, causal

B, A = [1.0, 0.5], [1.0, -0.9, 0.5]


def drained(spark, stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_filter_keeps_its_state_between_triggers(spark, tmp_path):
    rows = spark.range(120).select((F.col("id") % 2).alias("seq"), F.floor(F.col("id") / 2).alias("n"), F.sin(F.col("id") * 0.7).alias("x"))
    for k in range(3):
        rows.filter(f"n >= {20 * k} AND n < {20 * (k + 1)}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq long, n long, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = {(r["seq"], r["n"]): r["x"] for r in drained(spark, causal.dfs(stream, B, A), "filtered").collect()}
    whole = {(r["seq"], r["n"]): r["x"] for r in filters.dfs(rows, B, A).collect()}
    assert found.keys() == whole.keys()
    np.testing.assert_allclose([found[k] for k in sorted(found)], [whole[k] for k in sorted(whole)])


def test_levels_by_event_time(spark, tmp_path):
    spark.sql("SELECT 1L AS seq, timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, id) AS ts, 3.0D AS x FROM range(60)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq long, ts timestamp, x double").parquet(str(tmp_path / "in"))
    rows = drained(spark, causal.levels(stream, "20 minutes", "10 minutes", "5 minutes"), "levels", "complete").collect()
    assert {r["level"] for r in rows} == {3.0} and sorted(r["n"] for r in rows) == [10, 10, 20, 20, 20, 20, 20]


def late_rows(spark, folder, count=90, size=3):
    """Two sequences a second a place, rows out of order within 5 s, in files of different size; then a row of another one, an hour later."""
    rng = np.random.default_rng(3)
    rows = [(s, n, float(np.sin(n * 0.7 + s)), n) for s in (0, 1) for n in range(count) if n != 40]
    rows = [r for _, r in sorted((r[3] + rng.uniform(0, 4), r) for r in rows)]
    cuts = [0, *sorted(rng.choice(range(1, len(rows)), size - 1, replace=False).tolist()), len(rows)]
    schema = "seq long, n long, x double, second long"
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        write_one(spark.createDataFrame(rows[a:b], schema), folder, k)
    for k in range(2):
        write_one(spark.createDataFrame([(9, k, 0.0, 3600 + k)], schema), folder, size + k)
    return spark.createDataFrame(rows, schema).select("seq", "n", "x")


def write_one(rows, folder, k):
    import time

    rows.withColumn("ts", F.timestamp_seconds(F.col("second") + 1000)).drop("second").coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.05)  # files are taken in order of their times


@pytest.mark.parametrize("name", ["median", "filter", "delta"])
@pytest.mark.parametrize("size", [2, 7])
def test_looking_ahead_gives_what_the_table_gives(spark, tmp_path, name, size):
    rows = late_rows(spark, str(tmp_path / "in"), size=size)
    stream = spark.readStream.schema("seq long, n long, x double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    taps = [0.2, 0.5, -0.3, 0.1, 0.7]
    on_stream, on_table = {
        "median": (lambda s: ahead.medfilt(s, 7, "5 seconds", 60_000), lambda t: sequences.medfilt(t, 7)),
        "filter": (lambda s: ahead.fir(s, taps, 2, "5 seconds", 60_000), lambda t: sequences.fir(t, taps, 2)),
        "delta": (lambda s: ahead.delta(s, "5 seconds", 60_000), lambda t: sequences.delta(t)),
    }[name]
    found = {(r["seq"], r["n"]): r["x"] for r in drained(spark, on_stream(stream), f"{name}{size}").collect() if r["seq"] < 9}
    whole = {(r["seq"], r["n"]): r["x"] for r in on_table(rows).collect()}
    # the table's delta has no row where there is no sample, and reads it as missing from its neighbours
    assert whole.keys() <= found.keys() and len(found) == 180
    np.testing.assert_allclose([found[k] for k in sorted(whole)], [whole[k] for k in sorted(whole)], atol=1e-12)

"""WAV files by parts."""

import io
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelath.sources import wav


def file_bytes(x, rate, width):
    """PCM of samples (frames, channels) between -1 and 1."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(x.shape[1])
        f.setsampwidth(width)
        f.setframerate(rate)
        v = np.round(x * (2 ** (8 * width - 1) - 1)).astype(np.int64)
        raw = (v + 128).astype(np.uint8).tobytes() if width == 1 else b"".join(int(k).to_bytes(width, "little", signed=True) for k in v.reshape(-1))
        f.writeframes(raw)
    return out.getvalue()


@pytest.fixture(scope="module")
def reader(spark):
    spark.dataSource.register(wav.Wav)
    return lambda path, **options: spark.read.format("wav").options(**options).load(str(path))


def table_of(df):
    return {(r["seq"], r["channel"], r["n"]): r["x"] for r in df.collect()}


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_a_file_is_read_in_parts(reader, tmp_path, width):
    x = np.random.default_rng(width).uniform(-1, 1, (1000, 2))
    (tmp_path / "a.wav").write_bytes(file_bytes(x, 8000, width))
    df = reader(tmp_path / "a.wav", split=130)
    assert df.rdd.getNumPartitions() == 8
    found = table_of(df)
    assert len(found) == 2000 and {r["rate"] for r in df.select("rate").distinct().collect()} == {8000}
    np.testing.assert_allclose([[found[str(tmp_path / "a.wav"), c, n] for c in (0, 1)] for n in range(1000)], x, atol=1.6 / 2 ** (8 * width - 1))


def test_a_stretch_is_read_alone(reader, tmp_path):
    x = np.linspace(-1, 1, 500)[:, None]
    (tmp_path / "a.wav").write_bytes(file_bytes(x, 8000, 2))
    (tmp_path / "b.wav").write_bytes(file_bytes(x[:150], 8000, 2))
    df = reader(tmp_path / "*.wav", start=100, frames=120, split=50)
    assert df.rdd.getNumPartitions() == 4
    found = table_of(df)
    assert sorted(n for s, _, n in found if s.endswith("a.wav")) == list(range(100, 220)) and sorted(n for s, _, n in found if s.endswith("b.wav")) == list(range(100, 150))


def test_floats_odd_chunks_and_what_is_no_wav(reader, tmp_path):
    x = np.array([0.25, -0.5, 1.0], "<f4")
    form = struct.pack("<HHIIHH", 3, 1, 100, 400, 4, 32)
    body = b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", 12) + x.tobytes()
    (tmp_path / "f.wav").write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)
    assert sorted(table_of(reader(tmp_path / "f.wav")).values()) == [-0.5, 0.25, 1.0]
    (tmp_path / "g.wav").write_bytes(b"no sound at all, but some bytes")
    with pytest.raises(Exception, match="not a WAV file"):
        reader(tmp_path / "g.wav").collect()


def test_there_and_back_in_parts(spark, reader, tmp_path):
    """Sequences of several parts, one with places missing and nulls, and a name that no path bears."""
    rows = [(s, n, float(np.sin(n / 9)) / 2) for s, size in (("a/b c", 2500), ("d", 10)) for n in range(size)]
    rows = [(s, n, None if n == 7 else x) for s, n, x in rows if not 30 <= n < 60]
    wav.write(spark.createDataFrame(rows, "seq string, n long, x double"), str(tmp_path / "out"), 8000, part=1000)
    files = sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file())
    assert files == ["a%2Fb%20c/part-000000x1000.wav", "a%2Fb%20c/part-000001x1000.wav", "a%2Fb%20c/part-000002x1000.wav", "d/part-000000x1000.wav"]
    found = table_of(reader(tmp_path / "out", split=300))
    given = {(s, n): x or 0.0 for s, n, x in rows}
    assert len(found) == 2510
    np.testing.assert_allclose([x for _, x in sorted(found.items())], [given.get((s, n), 0.0) for s, _, n in sorted(found)], atol=1 / 32768)
    late = reader(tmp_path / "out", start=1990, frames=20)
    assert sorted((r["seq"], r["n"]) for r in late.collect()) == [("a/b c", n) for n in range(1990, 2010)]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    broken = spark.range(10).select(F.lit("s").alias("seq"), F.col("id").alias("n"), F.expr("if(id = 5, raise_error('broken'), 0.1D)").alias("x"))
    with pytest.raises(Exception, match="broken"):
        wav.write(broken, str(tmp_path / "out"), 8000)
    assert not [p for p in tmp_path.rglob("*.wav")]

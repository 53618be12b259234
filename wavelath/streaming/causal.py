"""Operators on streams of samples.

Pointwise operators are column functions and work on a stream as they are. Here
are those that need memory: filters, whose state is a few numbers for each
sequence, and levels over windows of event time, with a watermark for late rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import coefficients, recurrence


def dfs(stream: DataFrame, b=None, a=None) -> DataFrame:
    """(seq, n, x) of a stream of samples through the filter b / a.

    The state of a sequence is its last inputs and outputs. Rows of one trigger are put in order of n; a row that comes
    after a later one was given out is filtered at the time of its coming.
    """
    num, den = coefficients(b, a)
    start, step = recurrence(num, den)

    def run(key, frames, state):
        before, last = start()
        if state.exists:
            kept = state.get
            before, last = np.array(kept[0], float), np.array(kept[1], float)
        rows = pd.concat(list(frames)).sort_values("n", kind="stable")
        y, (before, last) = step((before, last), rows["x"].fillna(0.0).to_numpy(float))
        state.update(([float(v) for v in before], [float(v) for v in last]))
        yield pd.DataFrame({"seq": key[0], "n": rows["n"].to_numpy(), "x": y})

    kind = stream.schema["seq"].dataType.simpleString()
    return stream.select("seq", F.col("n").cast("long").alias("n"), F.col("x").cast("double").alias("x")).groupBy("seq").applyInPandasWithState(
        run, f"seq {kind}, n long, x double", "inputs array<double>, outputs array<double>", "append", "NoTimeout"
    )


def levels(stream: DataFrame, length: str, period: str, late: str, time: str = "ts") -> DataFrame:
    """(seq, begin, level, n): root mean square and count of every sequence in sliding windows; rows later than late are left out."""
    rows = stream.withWatermark(time, late).groupBy("seq", F.window(time, length, period).alias("w"))
    return rows.agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("level"), F.count("x").alias("n")).select("seq", F.col("w.start").alias("begin"), "level", "n")

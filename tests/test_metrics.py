"""Time warping against a plain recursion, cell by cell."""

import numpy as np
import pytest

from wavelath.operators import metrics


def plain(d, p, softness):
    moves, in_turn = metrics.DTW_STEPS[p]
    m, n = d.shape
    cost, both, steps = {(0, 0): d[0, 0]}, {}, {}

    def soft(options):
        options = [o for o in options if np.isfinite(o)]
        return -softness * np.log(np.sum(np.exp(-(np.array(options) - min(options)) / softness))) + min(options) if options else np.inf

    for i in range(m):
        for j in range(n):
            if i == j == 0:
                continue
            reach = [((both if in_turn and not (s and t) else cost).get((i - s, j - t), np.inf) + (s + t) * d[i, j]) for s, t in moves]
            cost[i, j] = soft(reach)
            both[i, j] = soft([r for r, (s, t) in zip(reach, moves) if s and t])
            steps[i, j] = int(np.argmin(reach)) if np.isfinite(min(reach)) else -1
    path, at = [(m - 1, n - 1)], (m - 1, n - 1)
    while steps.get(at, -1) >= 0:
        s, t = moves[steps[at]]
        at = (at[0] - s, at[1] - t)
        path.append(at)
    return cost[m - 1, n - 1], path[::-1]


@pytest.mark.parametrize("p", metrics.DTW_STEPS)
@pytest.mark.parametrize("metric", metrics.DTW_METRICS)
def test_against_a_plain_recursion(spark, p, metric, monkeypatch):
    monkeypatch.setattr(metrics, "DTW_SLICE", 100)
    rng = np.random.default_rng(p)
    x, y = rng.random((6, 12)) + 0.1, rng.random((6, 10)) + 0.1
    df = spark.createDataFrame([(k, x[k].tolist(), y[k].tolist()) for k in range(6)], "id long, x array<double>, y array<double>")
    rows = df.select("id", metrics.dtw("x", "y", 2, metric, p).alias("d"), metrics.dtw_path("x", "y", 2, metric, p).alias("path")).collect()
    for r in rows:
        a, b = x[r["id"]].reshape(6, 2)[:, None], y[r["id"]].reshape(5, 2)[None]
        d = {
            "manhattan": np.abs(a - b).sum(-1), "euclidean": np.sqrt(((a - b) ** 2).sum(-1)), "squared-euclidean": ((a - b) ** 2).sum(-1),
            "symmetric-kl": (a * np.log(np.maximum(a / b, 1e-10)) + b * np.log(np.maximum(b / a, 1e-10))).sum(-1),
        }[metric]
        cost, path = plain(d, p, 1e-3)
        assert r["d"] == pytest.approx(cost / 11, rel=1e-9) or not np.isfinite(cost) and not np.isfinite(r["d"])
        own = np.array(r["path"]).reshape(-1, 2)
        assert [tuple(q) for q in own[own[:, 0] >= 0].astype(int).tolist()] == path

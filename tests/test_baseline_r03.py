"""The baseline's probabilities against a weighted logistic fit by Newton's method."""

import numpy as np

from gaitline.operators import bouts as B


def test_baseline_equals_a_plain_fit(spark):
    rng = np.random.default_rng(8)
    rows = [(f"v{s}", f, float(p), int(rng.random() < 1 / (1 + np.exp(3 - 5 * p)))) for s in range(6) for f, p in enumerate(rng.random(60))]
    df = spark.createDataFrame(rows, "stem string, frame int, prob double, truth int")
    reach, alpha = 2, 0.7
    got = {(r.stem, r.frame): r.prob for r in B.fit_baseline(df, reach=reach, alpha=alpha)(df).collect()}
    x, y, keys = [], [], []
    for s in range(6):
        own = [(f, p, t) for stem, f, p, t in rows if stem == f"v{s}"]
        values = [p for _, p, _ in own]
        for f, p, t in own:
            x.append([1.0, *[values[f - k] if 0 <= f - k < len(values) else p for k in range(-reach, reach + 1)]])
            y.append(t)
            keys.append((f"v{s}", f))
    x, y = np.array(x), np.array(y)
    weight, beta = np.where(y == 1, alpha, 1 - alpha), np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x, x.T @ (weight * (y - p)))
    want = 1 / (1 + np.exp(-x @ beta))
    assert len(got) == len(keys) and np.allclose([got[k] for k in keys], want, atol=2e-3)

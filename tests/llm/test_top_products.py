import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm.top_products import SearchOptions, top_products

SCHEMA = "vec_id long, embedding array<double>, query_id int"


def brute(rows, k=20):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i is None or i % 20:
            continue
        found = sorted(((-sum(x * y for x, y in zip(q, c, strict=True)), j is None, j or 0, j) for b, (j, c) in enumerate(ok) if a != b and len(c) == len(q)), key=lambda t: t[:3])
        out += [(i, n + 1, t[3], -t[0]) for n, t in enumerate(found[:k])]
    return sorted(out, key=repr)


def run(spark, rows, **o):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in top_products(df, F.col("vec_id") % 20 == 0, SearchOptions(**o)).collect()), key=repr)


@pytest.mark.parametrize("shape", ["unit", "long", "short_blocks", "ties"])
def test_against_brute_force(spark, shape):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 8))
    if shape == "unit":
        x /= np.linalg.norm(x, axis=1)[:, None]
    if shape in ("long", "short_blocks"):
        x *= np.exp(rng.normal(size=(700, 1)) * 1.5)
    if shape == "ties":
        x = np.repeat(x[:35], 20, 0)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    o = {"candidates": 60, "queries": 7, "bucket": 16, "longest": 40, "steep": 0.4} if shape != "unit" else {}
    assert run(spark, rows, **o) == brute(rows)


def test_defined_results(spark):
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (20, None, 1), (40, [float("nan"), 1.0], 1), (60, [None, 1.0], 1), (None, [1.0, 0.5], 1), (3, [-1.0, 0.1], 1), (80, [1e4, -1e4], 1), (100, [1.0, 2.0, 3.0], 1), (5, [float("inf"), 1.0], 1)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []

import math

import numpy as np
import pytest

from loomspan.llm.near_vectors import NearVectorOptions, near_vectors

SCHEMA = "vec_id long, embedding array<double>, label int, node int"


def brute(rows):
    ok = [v is not None and lab is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab, _ in rows]
    links = [[] for _ in rows]
    for i, (_, v, lab, _) in enumerate(rows):
        for j in range(i):
            w = rows[j][1]
            if ok[i] and ok[j] and lab == rows[j][2] and len(v) == len(w):
                v1, w1 = np.array(v), np.array(w)
                if v1 @ w1 / np.linalg.norm(v1) / np.linalg.norm(w1) >= 0.93:
                    links[i].append(j)
                    links[j].append(i)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            at = todo.pop()
            for k in links[at] + [k for k, other in enumerate(rows) if rows[at][0] is not None and other[0] == rows[at][0]]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        low = min(ids, default=None)
        out.append((r[0], len(links[i]), low, low is not None and low == r[0]))
    return sorted(out, key=repr)


def run(spark, rows, **o):
    return sorted((tuple(r) for r in near_vectors(spark.createDataFrame(rows, SCHEMA), NearVectorOptions(**o)).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"bucket": 8, "partners": 3, "tile": 20}])
def test_against_brute_force(spark, options):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    spread = np.concatenate([base[rng.integers(0, 60, 400)] + rng.normal(size=(400, 16)) * rng.uniform(0.02, 0.5, size=(400, 1)), np.repeat(base[:5], 6, 0)])
    rows = [(i, v.tolist(), int(rng.integers(0, 2)), 1) for i, v in enumerate(spread)]
    assert run(spark, rows, **options) == brute(rows)


def test_one_vec_id_with_several_vectors_is_one_node(spark):
    rows = [(3, [1.0, 0.0], 1, 1), (5, [1.0, 0.0], 1, 1), (5, [0.0, 1.0], 1, 1), (7, [0.0, 1.0], 1, 1), (7, None, 1, 1), (8, None, 1, 1), (2, [0.0, 0.0], 1, 1), (2, [-1.0, 0.0], 2, 1), (9, [-0.0, -1.0], 2, 1), (9, [0.0, -1.0], 2, 1)]
    assert run(spark, rows) == brute(rows)


def test_pairs_at_the_threshold_are_decided_alike(spark):
    """Dense groups and single pairs take the same side, whichever way rounding goes."""
    y = math.sqrt(1 - 0.93**2)
    for s in (1.0, 1.0 - 2**-53, 1.0 + 2**-52):
        rows = [(i, [1.0, 1e-3 * i], i // 2, 1) for i in range(2)] + [(10, [1.0, 0.0], 9, 1), (11, [0.93, y * s], 9, 1)]
        got = [r[1] for r in run(spark, rows, partners=0) if r[0] >= 10], [r[1] for r in run(spark, rows, partners=32) if r[0] >= 10]
        assert got[0] == got[1]


def test_defined_results(spark):
    rows = [(1, [1.0, 0.0], 1, 1), (2, [1.0, 0.01], 1, 1), (3, None, 1, 1), (4, [0.0, 0.0], 1, 1), (5, [1.0, None], 1, 1), (6, [float("nan"), 1.0], 1, 1), (7, [1.0, 0.0], None, 1), (8, [1.0, 0.0, 0.0], 1, 1), (9, [2.0], 1, 1), (10, [3.0], 1, 1), (11, [], 1, 1), (12, [1.0, 0.0], 1, 1), (None, [1.0, 0.0], 1, 1)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []

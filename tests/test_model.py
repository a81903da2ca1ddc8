import random
import time

import numpy as np

from loomspan.operators.sync import RATIOS, Model


def plain(x, y, scale, span=60.0, tie=0.05):
    free = len(x) >= 3 and np.ptp(x) >= span
    scales = np.array([scale, *(r for r in RATIOS if free and r != scale)])
    rest = np.array(y) - scales[:, None] * np.array(x)
    offsets = np.median(rest, axis=1)
    errors = np.median(np.abs(rest - offsets[:, None]), axis=1)
    best = 0
    for i in range(1, len(scales)):
        best = i if errors[i] < errors[best] - tie else best
    return float(scales[best]), float(offsets[best]), float(errors[best])


def test_the_model_of_pairs_as_they_come_is_that_of_all(spark):
    draw = random.Random(3)
    for trial in range(60):
        drift, scale = draw.choice(RATIOS), draw.choice([1.0, 25 / 24, 1.1])
        x, y, model = [], [], Model(scale)
        assert model.best() == (scale, 0.0, 0.0)
        for _ in range(draw.choice([4, 25])):
            x.append(draw.choice([draw.uniform(0, 7000), float(draw.randrange(5))]))
            y.append(drift * x[-1] + 3 + draw.choice([0.0, 0.5, draw.uniform(-1, 1), 400.0]))
            model.add(x[-1], y[-1])
            assert model.best() == plain(x, y, scale), (trial, len(x))


def test_many_pairs_of_one_candidate_cost_little_each():
    def took(n):
        model, t = Model(), time.process_time()
        for i in range(n):
            model.add(float(i), 1.001 * i + i * 7919 % 13 / 10)
            model.best()
        return time.process_time() - t

    took(500)
    assert took(16000) < 40 * took(1000)  # 16 times the pairs; each was fitted to all before it

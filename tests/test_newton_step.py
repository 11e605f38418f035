"""One Newton step against its plain formulas."""

import numpy as np
import pytest

from formline.operators import folded


def test_curvature_from_pairs_of_classes():
    rng = np.random.default_rng(3)
    z, y, w = np.column_stack([np.ones(50), rng.normal(size=(50, 4))]), rng.integers(0, 3, 50), rng.uniform(0.5, 1, 50)
    family, beta = folded.Multinomial(), rng.normal(size=15)
    loss, _, curve = family.step(z, y, w, beta)
    p = folded.softmax(z @ beta.reshape(3, -1).T)
    for a in range(3):
        for b in range(3):
            block = (z * (w * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ z
            assert curve[5 * a:5 * a + 5, 5 * b:5 * b + 5] == pytest.approx(block, abs=1e-12)
    assert loss == pytest.approx(family.loss(z, y, w, beta))

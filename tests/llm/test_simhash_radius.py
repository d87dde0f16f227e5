"""Cells that the ball of a wide radius touches."""

import numpy as np
import pytest

from pixelloom.llm.simhash import visits


@pytest.mark.parametrize("radius", [2, 3, 4, 5, 6])
def test_every_pair_within_the_radius_meets(radius):
    r = np.random.default_rng(radius)
    a = r.integers(0, 2**64, 600, dtype=np.uint64)
    b = a.copy()
    for i in range(len(a)):
        # Differing bits fall on one byte or on any.
        for bit in r.choice(8 if i % 2 else 64, r.integers(1, radius + 1), replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    cells = []
    for fp in (a, b):
        rows, cell, home = visits(fp, radius)
        of = [{} for _ in fp]
        for x, c, h in zip(rows.tolist(), cell.tolist(), home.tolist()):
            of[x][c] = h
        cells.append(of)
    for x, y in zip(*cells):
        assert any(x[c] or y[c] for c in x.keys() & y.keys())

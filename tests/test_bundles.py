import numpy as np
import pytest

from cinequarry.operators import similarity
from test_nearest import frame, nearest


@pytest.mark.parametrize("blocks", [1, 8])
def test_cells_in_bundles(spark, monkeypatch, blocks):
    """Cells that share a bundle, bundles in several parts on both sides, ties across cells."""
    monkeypatch.setattr(similarity, "BLOCKS", blocks)
    rng = np.random.default_rng(11)
    a, b = rng.normal(size=(90, 12)), rng.normal(size=(160, 12))
    b[100:110] = b[20:30]
    got = similarity.best_anchors(frame(spark, a), frame(spark, b), 20, 10).collect()
    assert sorted((r.id, r.anchor) for r in got) == nearest(a, b)
    assert all(r.seen <= 160 for r in got)

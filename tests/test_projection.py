"""The random projection of many documents together."""

import numpy as np

from primrose.operators import models


def test_a_block_is_made_once_for_all_documents(monkeypatch):
    rng = np.random.default_rng(5)
    sizes = np.array([0, 40, 3, 0, 700, 25, 0])
    index = rng.integers(0, 5_000, sizes.sum())
    weight = rng.integers(1, 4, len(index)).astype(np.float32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    made, good = [], models._projection

    def counted(seed, block, dim):
        made.append(block)
        return good(seed, block, dim)

    monkeypatch.setattr(models, "_projection", counted)
    monkeypatch.setattr(models, "_CELLS", 8)
    got = models._projected(7, 6, row, index, weight, len(sizes))
    assert sorted(made) == sorted({int(i) // 256 for i in index})
    rows = np.concatenate([good(7, b, 6) for b in range(20)])
    for d in range(len(sizes)):
        want = (rows[index[row == d]] * weight[row == d, None]).sum(axis=0, dtype=np.float64)
        assert np.allclose(got[d], want, rtol=0, atol=1e-5)
    none = np.zeros(0, np.int64)
    assert not models._projected(7, 6, none, none, none.astype(np.float32), 2).any()

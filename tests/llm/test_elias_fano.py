import numpy as np
import pytest

from harvestry.llm import elias_fano as EF


@pytest.mark.parametrize(("n", "universe", "dense"), [(0, 10, False), (1, 1, False), (1, 1 << 50, False), (500, 600, False), (3000, 1 << 44, False), (3000, 1 << 40, True), (64, 64, False)])
def test_rank_find_get_are_those_of_the_plain_sequence(n, universe, dense):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, universe, n)) if n else np.zeros(0, np.int64)
    if dense:  # one bucket holds most values
        values = np.unique(np.concatenate([values, universe // 2 + np.arange(2000)]))
    s = EF.Sequence(EF.encode(values, universe))
    targets = np.unique(np.concatenate([rng.integers(0, universe, 400), values[::3], np.minimum(values[::5] + 1, universe - 1), [0, universe - 1]]))
    assert np.array_equal(s.rank(targets), np.searchsorted(values, targets))
    want = np.where(np.isin(targets, values), np.searchsorted(values, targets), -1)
    assert np.array_equal(s.find(targets), want)
    assert np.array_equal(s.get(np.arange(len(values))), values)


def test_repeated_values_are_kept():
    values = np.array([0, 0, 3, 3, 3, 9])
    s = EF.Sequence(EF.encode(values, 10))
    assert s.get(np.arange(6)).tolist() == values.tolist()
    assert s.rank(np.array([0, 1, 3, 4, 9])).tolist() == [0, 2, 2, 5, 5]

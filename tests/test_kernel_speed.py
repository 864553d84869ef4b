"""The kernel sorts only what can be among the k best, and columns travel in forms that give back every bit."""

import numpy as np
import pytest

from trolley.functions import blockdot as B


def plain_top_k(owner, other, sim, k):
    best = {}
    for o, n, s in zip(owner.tolist(), other.tolist(), sim.tolist()):
        best.setdefault(o, []).append((-s, n))
    return {(o, n, -s) for o, x in best.items() for s, n in sorted(x)[:k]}


@pytest.mark.parametrize("runs", [True, False])
def test_top_k_sorts_few_entries(monkeypatch, runs):
    rng = np.random.default_rng(4)
    owner = rng.integers(0, 20, 20_000)
    owner = np.sort(owner) if runs else owner
    other, sim = np.arange(owner.size), rng.integers(1, 400, owner.size) / 7
    lexsort, sorted_ = np.lexsort, []
    monkeypatch.setattr(B.np, "lexsort", lambda keys: sorted_.append(keys[0].size) or lexsort(keys))
    sel = B.topk_per_owner(owner, other, sim, 30)
    assert set(zip(owner[sel].tolist(), other[sel].tolist(), sim[sel].tolist())) == plain_top_k(owner, other, sim, 30)
    assert not runs or sum(sorted_) < 1_000      # of 20,000


@pytest.mark.parametrize("far", [1, 1 << 40])
def test_users_are_numbered_in_order(far):
    users = np.random.default_rng(5).integers(-50, 50, 500) * far
    ids, local = B._numbered(users)
    assert np.array_equal(ids[local], users) and np.array_equal(ids, np.unique(users))


@pytest.mark.parametrize("x", [
    [1.0] * 9, [3.0, 5.0, -7.0], [0.5, 1.0], [-0.0, 0.0], [0.0, float("nan"), float("inf")], [2.0 ** 40, 1.0], [float("nan")] * 3, [],
    [1 << 62, -(1 << 63), 0], [5, -5, 1 << 30], [7] * 4])
def test_columns_come_back_bit_by_bit(x):
    x = np.array(x, np.int64 if x and isinstance(x[0], int) else np.float64)
    data = np.frombuffer(B._encoded(x) + b"rest", np.uint8)
    got, taken = B._decoded(data, x.size, x.dtype)
    assert got.tobytes() == x.tobytes() and data[taken:].tobytes() == b"rest"
    assert x.size < 3 or x.dtype != np.float64 or not np.all(x == x[0]) or taken == 9      # 8 bytes a value before


def test_weights_that_are_not_one_are_summed():
    keys, got = B._summed(np.array([4, 2, 4, 9]), np.array([0.5, 1.0, 0.25, 1.0]))
    assert keys.tolist() == [2, 4, 9] and got.tolist() == [1.0, 0.75, 1.0]
    keys, got = B._summed(np.array([4, 2, 4]), np.ones(3))
    assert keys.tolist() == [2, 4] and got.tolist() == [1.0, 2.0] and got.dtype == np.float64

"""Dense kernels against direct definitions."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from polyad.functions import kernels as K
from polyad.plans.als import Model, Params, fit_array
from polyad.plans.buffer import ColumnBuffer
from polyad.plans.planner import choose, lookup, mttkrp_flops

RNG = np.random.default_rng(0)


def _model(i, modes, rank):
    lam, factors = K.random_model(modes, rank, i)
    return Model(i, factors, lam)


def _full(m):
    return K.reconstruct(m.lam, m.factors)


@pytest.mark.parametrize("modes", [(5, 4, 3), (2, 3, 4, 2)])
def test_mttkrp_methods_agree(modes):
    x, factors = RNG.random(modes), [RNG.random((i, 3)) for i in modes]
    for n in range(len(modes)):
        want = K.unfold(x, n) @ K.khatri_rao_but(factors, n)
        letters = "abcd"[: len(modes)]
        direct = np.einsum(letters + "," + ",".join(letters[m] + "r" for m in range(len(modes)) if m != n) + f"->{letters[n]}r", x, *[factors[m] for m in range(len(modes)) if m != n])
        assert np.allclose(want, direct)
        for method in ("mttkrp", "twostep0", "twostep1", "auto"):
            assert np.allclose(K.mttkrp(x, factors, n, method), want)


def test_unfold_order():
    x = np.arange(24.0).reshape(2, 3, 4)
    assert K.unfold(x, 1)[2, 1 + 2 * 3] == x[1, 2, 3]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 6), st.integers(0, 10**6))
def test_assignment_is_best(n, m, seed):
    cost = np.random.default_rng(seed).integers(-4, 5, (n, m)).astype(float)
    found = K.assign(cost)
    pairs = [(i, j) for i, j in enumerate(found) if j >= 0]
    assert len(pairs) == min(n, m) == len({j for _, j in pairs})
    small = cost if n <= m else cost.T
    best = max(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(small.shape[1]), len(small)))
    assert sum(cost[i, j] for i, j in pairs) == best


def test_assignment_rejects_nan():
    with pytest.raises(ValueError):
        K.assign(np.array([[np.nan, 1.0], [0.0, 1.0]]))
    assert list(K.assign(np.ones((4, 4)))) == [0, 1, 2, 3]


@pytest.mark.parametrize("order", [[1, 2, 0], [1, 0, 2], [2, 0, 1]])
def test_alignment_undoes_permutations(order):
    reference = [RNG.standard_normal((6, 3)) for _ in range(3)]
    lam, moved = K.align(reference, np.arange(3.0)[order], [f[:, order] for f in reference])
    assert all(np.array_equal(a, b) for a, b in zip(moved, reference)) and list(lam) == [0, 1, 2]


def test_nnls_meets_the_conditions():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        a = rng.standard_normal((8, 4))
        h, g = a.T @ a, rng.standard_normal((5, 8)) @ a
        d, regular = K.nnls(g, h, np.ones(g.shape, bool))
        assert regular
        w = g - d @ h
        assert (d >= 0).all() and (w[d == 0] <= 1e-8).all() and np.abs(w[d > 0]).max(initial=0) < 1e-8


def test_nnls_is_the_best_of_all_patterns():
    for seed in range(40):
        rng = np.random.default_rng(seed)
        r = 1 + seed % 4
        a = rng.standard_normal((9, r))
        h, g = a.T @ a, rng.standard_normal((30, 9)) @ a
        d, _ = K.nnls(g, h, rng.random(g.shape) < 0.5)
        for row, found in zip(g, d):
            best = np.inf
            for free in itertools.product([False, True], repeat=r):
                free, x = np.array(free), np.zeros(r)
                if free.any():
                    x[free] = np.linalg.solve(h[np.ix_(free, free)], row[free])
                if (x >= 0).all():
                    best = min(best, x @ h @ x / 2 - row @ x)
            assert found @ h @ found / 2 - row @ found == pytest.approx(best, abs=1e-9)


def test_nnls_of_singular_systems_ends():
    h = np.ones((3, 3))
    d, regular = K.nnls(np.array([[1.0, 1.0, 1.0], [-1.0, 2.0, 0.0]]), h, np.ones((2, 3), bool))
    assert not regular and (d >= 0).all() and np.isfinite(d).all() and d[0].sum() == pytest.approx(1, abs=1e-6)


def test_buffer():
    b = ColumnBuffer((3, 2), 7)
    f = lambda n, v: [np.full((3, n), float(v)), np.full((2, n), float(v))]
    assert b.add(1, f(2, 1)) and b.add(2, f(3, 2)) and b.add(3, f(1, 3)) and not b.add(4, f(2, 4)) and b.width == 6
    assert b.leftmost() == 1
    b.remove(2)
    assert b.first_fit(3) == 2 and b.first_fit(4) is None and b.width == 6 and not b.active()[0][:, 2:5].any()
    assert b.add(5, f(2, 5)) and b.columns(5) == slice(2, 4)
    b.remove(1)
    b.compress()
    assert b.columns(5) == slice(0, 2) and b.columns(3) == slice(2, 3) and b.width == 3 and b.leftmost() == 5
    assert [list(x[0]) for x in b.active()] == [[5, 5, 3]] * 2
    b.write(3, 0, np.full((3, 1), 9.0))
    assert list(b.active()[0][1]) == [5, 5, 9]
    assert b.add(6, f(4, 6)) and b.width == 7 and not b.add(7, f(1, 7))


def test_first_is_evicted_first():
    lam, factors = K.random_model((5, 4, 3), 2, 0)
    x = K.reconstruct(lam, factors)
    done, report = fit_array(x, [_model(i, x.shape, 2) for i in (7, 3, 5)], Params(max_iterations=50, force_max_iter=True, always_evict_first=True, buffer_size=4))
    assert {m.id: m.iters for m in done} == {7: 1, 3: 2, 5: 2} and [r["models"] for r in report] == [2, 2, 1]


def test_singular_systems_fall_back():
    u, regular = K.solve_spd(np.ones((2, 2)), np.zeros((2, 2)))
    assert not regular and np.isfinite(u).all()


def test_zero_columns_stay():
    lam, factors = K.normalize([np.array([[0.0, 3.0]]), np.array([[1.0, 4.0]])])
    assert list(lam) == [0.0, 12.0] and np.isfinite(factors[0]).all()
    lam, f = K.normalize_mode(np.array([[1.0, 0.0], [-2.0, 0.0], [2.0, 0.0]]), 2)
    assert list(lam) == [-2.0, 0.0] and f[1, 0] == 1.0


@pytest.mark.parametrize("options", [{}, {"update_method": "nnls", "max_iterations": 20}, {"line_search": True, "ls_interval": 10}, {"line_search": True, "ls_interval": 10, "ls_method": "error_checking"}])
def test_fused_equals_single(options):
    lam, factors = K.random_model((13, 12, 11), 10, 0)
    x = K.reconstruct(lam, factors)
    params = Params(**{"max_iterations": 100, "tol": 1e-5, "buffer_size": 30, **options})
    ranks = [1 + i % 12 for i in range(24)]
    together, report = fit_array(x, [_model(i, x.shape, r) for i, r in enumerate(ranks)], params)
    alone = [fit_array(x, [_model(i, x.shape, r)], params)[0][0] for i, r in enumerate(ranks)]
    assert max(np.abs(_full(a) - _full(b)).max() for a, b in zip(together, alone)) < 1e-11
    assert all(row["cols"] <= 30 for row in report)
    if options.get("update_method") == "nnls":
        assert min(f.min() for m in together for f in m.factors) >= 0


def test_fast_error_is_the_residual():
    lam, factors = K.random_model((9, 3, 2), 5, 1)
    x = K.reconstruct(lam, factors)
    m = fit_array(x, [_model(2, x.shape, 5)], Params(max_iterations=3))[0][0]
    assert m.error == pytest.approx(np.linalg.norm(x - _full(m)), abs=1e-9)


def test_four_modes_fit():
    lam, factors = K.random_model((3, 3, 3, 3), 5, 3)
    x = K.reconstruct(lam, factors)
    done = fit_array(x, [_model(i, x.shape, 7) for i in range(20)], Params(max_iterations=100))[0]
    assert min(np.linalg.norm(x - _full(m)) for m in done) < 1e-1


def test_masked_equals_deleted():
    lam, factors = K.random_model((20, 9, 12), 5, 4)
    x = K.reconstruct(lam, factors) + 0.01 * RNG.standard_normal((20, 9, 12))
    params = Params(max_iterations=60, force_max_iter=True, buffer_size=18)
    starts = [_model(i, x.shape, 5) for i in range(4)]
    masked = [Model(m.id, [f.copy() for f in m.factors], m.lam, 0, 3 + m.id) for m in starts]
    masked, _ = fit_array(x, masked, params)
    for m, start in zip(masked, starts):
        fiber = 3 + m.id
        deleted = fit_array(np.delete(x, fiber, 0), [Model(0, [np.delete(start.factors[0], fiber, 0), *start.factors[1:]], start.lam)], params)[0][0]
        assert np.abs(np.delete(_full(m), fiber, 0) - _full(deleted)).max() < 1e-9
        assert m.error == pytest.approx(deleted.error, abs=1e-9)


def test_options():
    p = Params.from_options("update-method", "nnls", "maxiters", "7", "tol", "1e-9", "ls", "ls-interval", 3, "no-cuda")
    assert (p.update_method, p.max_iterations, p.tol, p.line_search, p.ls_interval) == ("nnls", 7, 1e-9, True, 3)
    for bad in (("tol", "-1"), ("ls-interval", "1"), ("update-method", "x"), ("nothing",), ("maxiters", "0")):
        with pytest.raises(ValueError):
            Params.from_options(*bad)
    with pytest.warns(UserWarning):
        Params.from_options("cuda")
    with pytest.raises(ValueError):
        fit_array(np.ones((2, 2, 2)), [_model(0, (2, 2, 2), 5)], Params(buffer_size=4))


def test_planner():
    assert lookup({}, 3) is None and lookup({1: 2, 4: 0}, 2) == "mttkrp" and lookup({1: 2, 4: 0}, 9) == "mttkrp"
    assert choose((3, 3, 3, 3), 0, "twostep0") == "auto" and choose((3, 3, 3, 3), 0, "mttkrp") == "mttkrp" and choose((9, 9, 9), 0, "auto", {1: 1}, 1) == "twostep0"
    assert mttkrp_flops((2, 3, 4), 0, 5, "mttkrp") == 2 * 24 * 5 + 12 * 5
    with pytest.raises(ValueError):
        choose((2, 2, 2), 0, "magic")

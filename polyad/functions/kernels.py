"""Dense kernels that run inside one task or on the driver; arrays are numpy, the first index fastest."""

from __future__ import annotations

import numpy as np


def unfold(x: np.ndarray, n: int) -> np.ndarray:
    """Mode-n matricisation; of the other indices the lowest is fastest."""
    return np.moveaxis(x, n, 0).reshape(x.shape[n], -1, order="F")


def khatri_rao(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Column-wise Kronecker product; the rows of b are fastest."""
    return (a[:, None, :] * b[None, :, :]).reshape(-1, a.shape[1])


def khatri_rao_but(factors: list[np.ndarray], n: int) -> np.ndarray:
    out = None
    for f in (factors[m] for m in range(len(factors)) if m != n):
        out = f if out is None else khatri_rao(f, out)
    return out


def mttkrp(x: np.ndarray, factors: list[np.ndarray], n: int, method: str = "auto") -> np.ndarray:
    """Tensor times all factors but n. `mttkrp` writes the Khatri-Rao product out; the two-step methods contract one
    factor of a tensor of three modes first; `auto` contracts the longest of the other modes first, then one after another."""
    if method == "mttkrp":
        return unfold(x, n) @ khatri_rao_but(factors, n)
    if x.ndim == 3 and method != "auto":
        first, second = contraction(n, 0 if method == "twostep0" else 1)
        order = [first, second]
    else:
        order = sorted((m for m in range(x.ndim) if m != n), key=lambda m: -x.shape[m])
    kept = [m for m in range(x.ndim) if m != order[0]]
    part = np.tensordot(x, factors[order[0]], (order[0], 0))  # axes: kept modes, component
    for m in order[1:]:
        at = kept.index(m)
        part = np.einsum("aibr,ir->abr", part.reshape(int(np.prod(part.shape[:at], dtype=int)), part.shape[at], -1, part.shape[-1]), factors[m])
        kept.pop(at)
        part = part.reshape(*[x.shape[k] for k in kept], part.shape[-1])
    return part


def contraction(n: int, which: int) -> tuple[int, int]:
    """Modes in the order in which the two-step methods 0 and 1 contract them."""
    order = {0: ((2, 1), (1, 2)), 1: ((2, 0), (0, 2)), 2: ((0, 1), (1, 0))}
    return order[n][which]


def gramian(f: np.ndarray) -> np.ndarray:
    return f.T @ f


def hadamard(grams: list[np.ndarray], but: int | None = None) -> np.ndarray:
    out = np.ones_like(grams[0])
    for m, g in enumerate(grams):
        if m != but:
            out = out * g
    return out


def solve_spd(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, bool]:
    """U with U h = g, and whether h was positive definite; if not, by the pseudo-inverse."""
    try:
        low = np.linalg.cholesky(h)
        return np.linalg.solve(low.T, np.linalg.solve(low, g.T)).T, True
    except np.linalg.LinAlgError:
        return g @ np.linalg.pinv(h, hermitian=True), False


def nnls(g: np.ndarray, h: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, bool]:
    """Least squares with d >= 0 on normal equations d h = g, all rows together, by block principal pivoting.

    `active` (True: held at 0) is the warm start and is updated. In each round every row with an infeasible entry,
    one that is free and negative or held with a gradient upwards, exchanges all of them; a row whose number of
    infeasible entries has not fallen for three rounds exchanges only the last, which ends for any positive definite h.
    Rows with one pattern share one solve. Also returned: whether h was positive definite; if not, it is
    regularised by a share of its trace.
    """
    n, r = g.shape
    try:
        np.linalg.cholesky(h)
        regular = True
    except np.linalg.LinAlgError:
        regular, h = False, h + np.eye(r) * (np.trace(h) * 1e-12 + np.finfo(float).tiny)
    tol = 10 * np.finfo(float).eps * r * np.maximum(np.abs(g).max(axis=1, initial=0), np.abs(h).sum(axis=0).max())
    free = ~active | (g > 0)
    d, best, chances = np.zeros((n, r)), np.full(n, r + 1), np.full(n, 3)
    open_rows = np.arange(n)
    while len(open_rows):
        pattern, which = np.unique(free[open_rows], axis=0, return_inverse=True)
        which = which.ravel()
        for i, mask in enumerate(pattern):
            rows = open_rows[which == i]
            d[rows] = 0.0
            if mask.any():
                d[np.ix_(rows, mask)] = np.linalg.solve(h[np.ix_(mask, mask)], g[np.ix_(rows, mask)].T).T
        up = g[open_rows] - d[open_rows] @ h
        edge = tol[open_rows, None]
        bad = np.where(free[open_rows], d[open_rows] * np.diag(h) < -edge, up > edge)
        count = bad.sum(axis=1)
        open_rows, bad, count = open_rows[count > 0], bad[count > 0], count[count > 0]
        if not len(open_rows):
            break
        fell = count < best[open_rows]
        best[open_rows] = np.where(fell, count, best[open_rows])
        chances[open_rows] = np.where(fell, 3, chances[open_rows] - 1)
        single = chances[open_rows] < 0
        last = r - 1 - np.argmax(bad[:, ::-1], axis=1)
        only = np.zeros_like(bad)
        only[np.arange(len(last)), last] = True
        free[open_rows] ^= np.where(single[:, None], only, bad)
    active[:] = ~free
    return np.maximum(d, 0.0), regular


def normalize_mode(f: np.ndarray, sweep: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and columns: 2-norms in the first sweep, later the signed entries of largest size (first of equals)."""
    lam = np.linalg.norm(f, axis=0) if sweep == 1 else f[np.argmax(np.abs(f), axis=0), np.arange(f.shape[1])]
    return lam, f / np.where(lam == 0, 1.0, lam)


def normalize(factors: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Unit columns in every mode; weights are the products of the norms. A zero column stays and has weight 0."""
    norms = [np.linalg.norm(f, axis=0) for f in factors]
    return np.prod(norms, axis=0), [f / np.where(c == 0, 1.0, c) for f, c in zip(factors, norms, strict=True)]


def denormalize(lam: np.ndarray, factors: list[np.ndarray]) -> list[np.ndarray]:
    return [factors[0] * lam, *factors[1:]]


def reconstruct(lam: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    n = len(factors)
    letters = "abcdefghijklmnop"[:n]
    return np.einsum(",".join(f"{c}z" for c in letters) + ",z->" + letters, *factors, lam, optimize=True)


def fast_error(x_norm: float, lam: np.ndarray, last: np.ndarray, g_last: np.ndarray, h_all: np.ndarray) -> float:
    square = x_norm**2 + lam @ h_all @ lam - 2 * np.sum(last * g_last * lam)
    return float(np.sqrt(max(square, 0.0)))


def random_model(modes: tuple[int, ...], rank: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    rng = np.random.default_rng(seed)
    return normalize([rng.uniform(-1, 1, (i, rank)) for i in modes])


def sine_model(modes: tuple[int, ...], rank: int, start: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
    """A closed-form start that SQL can repeat."""
    return normalize([0.5 + 0.5 * np.sin(np.outer(np.arange(1, i + 1) + start, np.arange(1, rank + 1)) * (m + 1)) for m, i in enumerate(modes)])


def assign(score: np.ndarray, maximize: bool = True) -> np.ndarray:
    """Column of each row in an assignment of largest (least) sum, by shortest augmenting paths; rows <= columns, else -1 for rows left out."""
    cost = -score.astype(float) if maximize else score.astype(float)
    if np.isnan(cost).any() or np.isneginf(cost).any():
        raise ValueError("scores must not be NaN or infinitely good")
    if cost.shape[0] > cost.shape[1]:
        back = assign(cost.T, maximize=False)
        out = np.full(cost.shape[0], -1)
        out[back] = np.arange(len(back))
        return out
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m + 1)  # column m is where each search starts
    row_of = np.full(m + 1, -1)
    for i in range(n):
        row_of[m] = i
        dist, via, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        at = m
        while row_of[at] >= 0:
            done[at] = True
            row = row_of[at]
            slack = cost[row] - u[row] - v[:m]
            better = ~done[:m] & (slack < dist)
            dist[better], via[better] = slack[better], at
            left = np.where(done[:m], np.inf, dist)
            to = int(np.argmin(left))
            step = left[to]
            if not np.isfinite(step):
                raise ValueError("no assignment is possible")
            u[row_of[done]] += step
            v[done] -= step
            dist[~done[:m]] -= step
            at = to
        while at != m:
            row_of[at] = row_of[via[at]]
            at = via[at]
    out = np.empty(n, int)
    for j in range(m):
        if row_of[j] >= 0:
            out[row_of[j]] = j
    return out


def align(reference: list[np.ndarray], lam: np.ndarray, factors: list[np.ndarray], skip: int = 0, literal: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """Components in the order of the reference's, by the sum of inner products over all modes but `skip`.

    `literal` applies the assignment instead of its inverse and leaves the weights alone, as a published
    implementation does; the two agree unless a permutation has a cycle of three or more.
    """
    score = sum(reference[m].T @ factors[m] for m in range(len(factors)) if m != skip)
    order = assign(score)  # order[r]: the component that matches reference component r
    if literal:
        inverse = np.argsort(order)
        return lam, [f[:, inverse] for f in factors]
    return lam[order], [f[:, order] for f in factors]

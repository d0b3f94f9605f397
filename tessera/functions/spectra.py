"""Spectral kernels on one window: eigenpairs, subspace distances and closed-form random-matrix nulls.

Kernels take and return numpy arrays and run inside grouped functions, one window to a group. Vectors are
defined up to sign and rotation, so what leaves a kernel is invariant: eigenvalues, cosines, distances.
"""

from __future__ import annotations

import numpy as np

TINY = np.finfo(float).tiny


def eigenpairs(matrix, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in descending order and their vectors, the leading k if asked for."""
    m = np.asarray(matrix, float)
    if m.ndim != 2 or m.shape[0] != m.shape[1]:
        raise ValueError("a square matrix is needed")
    values, vectors = np.linalg.eigh(0.5 * (m + m.T))
    return values[::-1][:k].copy(), vectors[:, ::-1][:, :k].copy()


def covariance(x, demean: bool = True) -> np.ndarray:
    """Second moments over columns, divisor T, of an N x T window."""
    x = np.asarray(x, float)
    if x.ndim != 2:
        raise ValueError("a window is names by days")
    if demean:
        x = x - x.mean(axis=1, keepdims=True)
    return x @ x.T / x.shape[1]


def correlation(cov, bad_diagonal: str = "floor") -> np.ndarray:
    """Unit-diagonal form. A diagonal that is not positive is floored at 1e-12 of the largest, or refused ("error")."""
    c = np.asarray(cov, float)
    c = 0.5 * (c + c.T)
    d = np.diag(c).copy()
    if bad_diagonal == "error":
        if not (np.isfinite(d).all() and (d > 0).all()):
            raise ValueError("the diagonal must be finite and positive")
    else:
        d = np.maximum(d, max(np.abs(d).max() * 1e-12, TINY))
    root = np.sqrt(d)
    out = c / root[:, None] / root[None, :]
    np.fill_diagonal(out, 1.0)
    return out


def cosines(u, v) -> np.ndarray:
    """Principal cosines between the spans of u (N x P) and v (N x Q), P <= Q."""
    u, v = np.asarray(u, float), np.asarray(v, float)
    if u.shape[0] != v.shape[0] or u.shape[1] > v.shape[1]:
        raise ValueError("equal N and P <= Q are needed")
    return np.linalg.svd(v.T @ u, compute_uv=False).clip(0, 1)


def angles(u, v) -> np.ndarray:
    return np.arccos(cosines(u, v))


def distance(u, v) -> float:
    """Minus the mean log principal cosine."""
    return float(-np.log(cosines(u, v).clip(1e-300)).mean())


def distance_null(values, p: int, q: int, t: int) -> float:
    """Expected distance of a sample's top p from the true top q: sum of li lj / (li - lj)^2 over i <= p < q < j, over 2 t p."""
    lam = np.asarray(values, float)
    if not 0 < p <= q < lam.size or (np.diff(lam) > 1e-12).any():
        raise ValueError("descending eigenvalues and 0 < p <= q < N are needed")
    top, rest = np.meshgrid(lam[:p], lam[q:], indexing="ij")
    if np.isclose(top, rest, rtol=0, atol=1e-12).any():
        raise ValueError("eigenvalues meet across the border")
    return float((top * rest / np.square(top - rest)).sum() / (2 * t * p))


def distance_null_pair(first, second, p: int, q: int, t: int) -> float:
    """The same between two samples: both deviate."""
    return sum(distance_null(v, p, q, t) for v in (first, second))


def variogram_null(values, t: int) -> np.ndarray:
    """Expected squared difference of an eigenvalue between two windows of a static world: 4 lambda^2 / t."""
    return 4 * np.square(np.asarray(values, float)) / t


def bulk_edge(variance: float, n: int, t: int) -> float:
    """Upper edge of the random bulk."""
    if min(variance, n, t) <= 0:
        raise ValueError("variance, n and t must be positive")
    return float(variance * (1 + np.sqrt(n / t)) ** 2)


def count_above_bulk(values, t: int, tolerance: float = 1e-13, rounds: int = 100) -> tuple[int, float, float]:
    """(eigenvalues above the edge, edge, bulk variance), the variance being the mean of what lies under its own edge."""
    lam = np.asarray(values, float)
    if lam.ndim != 1 or not lam.size or (lam < 0).any():
        raise ValueError("eigenvalues of a covariance are needed")
    variance = lam.mean()
    for _ in range(rounds):
        under = lam[lam <= bulk_edge(variance, lam.size, t)]
        if not under.size:
            break
        before, variance = variance, under.mean()
        if abs(variance - before) < tolerance:
            break
    edge = bulk_edge(variance, lam.size, t)
    return int((lam > edge).sum()), edge, float(variance)


def _cosine_density(p: int, q: int, n: int, convention: str, points: int):
    """Nodes s, the density of a principal cosine of two random subspaces, and the quadrature weights."""
    a, b = p / n, q / n
    centre, half = a + b - 2 * a * b, 2 * np.sqrt(a * b * (1 - a) * (1 - b))
    low, high = np.sqrt(max(centre - half, 0.0)), np.sqrt(centre + half)
    if high >= 1:
        raise ValueError("p + q is too large for n")
    t = np.linspace(0, np.pi / 2, points)
    s = low + (high - low) * np.sin(t) ** 2
    slope = (high - low) * np.sin(2 * t)
    inner = np.clip(s**2 - (centre - half), 0, None) * np.clip(centre + half - s**2, 0, None)
    share = {"normalised": a, "paper": b}[convention]
    return t, s, np.sqrt(inner) / (share * np.pi * s * (1 - s**2)) * slope


def random_distance(p: int, q: int, n: int, convention: str = "normalised", points: int = 200_001) -> float:
    """Expected distance of two independent random subspaces."""
    t, s, mass = _cosine_density(p, q, n, convention, points)
    return float(np.trapezoid(-np.log(s) * mass, t))


def random_mass(p: int, q: int, n: int, convention: str = "normalised", points: int = 200_001) -> float:
    """Mass of that density: 1 when p = rank of the continuous part."""
    t, _, mass = _cosine_density(p, q, n, convention, points)
    return float(np.trapezoid(mass, t))


def flatten_days(x) -> np.ndarray:
    """Each day over the root of its mean square relative to the mean positive one; zero days stay."""
    x = np.asarray(x, float)
    level = np.square(x).mean(axis=0)
    up = level > 0
    scale = np.where(up, level / level[up].mean() if up.any() else 1.0, 1.0)
    return x / np.sqrt(scale)


def unit_variance(x) -> np.ndarray:
    x = np.asarray(x, float)
    sd = x.std(axis=1, ddof=1)
    if (sd == 0).any():
        raise ValueError("a name has zero variance")
    return x / sd[:, None]


def adjusted(x) -> np.ndarray:
    """Days of equal level, then names of unit variance: the window as correlations see it."""
    return unit_variance(flatten_days(x))


def scaling(estimation) -> tuple[float, np.ndarray]:
    """(reference level, each name's deviation once days are flat) of an estimation window."""
    x = np.asarray(estimation, float)
    level = np.square(x).mean(axis=0)
    reference = float(level[level > 0].mean()) if (level > 0).any() else 1.0
    sigma = (x / np.sqrt(np.where(level > 0, level / reference, 1.0))).std(axis=1, ddof=1)
    if (sigma <= 0).any():
        raise ValueError("a name has zero estimation variance")
    return reference, sigma


def scaled(block, reference: float, sigma, flat: bool = False) -> np.ndarray:
    """A block in units of the estimation window: over sigma, days flattened towards its reference if asked for."""
    y = np.asarray(block, float)
    if flat:
        level = np.square(y).mean(axis=0)
        y = y / np.sqrt(np.where(level > 0, level / reference, 1.0))
    return y / np.asarray(sigma, float)[:, None]


def frozen_frame(estimation, rank: int = 6) -> np.ndarray:
    """The estimation window's leading vectors, held still. Days are not flattened; names have unit variance."""
    return eigenpairs(covariance(unit_variance(scaled(estimation, *scaling(estimation)))), rank)[1]


def market_residual(x) -> np.ndarray:
    """Residuals of each name on the equal-weight return, with intercept."""
    x = np.asarray(x, float)
    if x.ndim != 2 or x.shape[1] < 2 or not np.isfinite(x).all():
        raise ValueError("a finite window of two days at least is needed")
    y = x - x.mean(axis=1, keepdims=True)
    m = y.mean(axis=0)
    power = m @ m
    return y if power <= np.finfo(float).eps else y - np.outer(y @ m / power, m)

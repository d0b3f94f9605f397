"""Inference for dependent data: block bootstrap, permutations, surrogates, p-values; and synthetic worlds.

Every draw comes from a generator seeded by (seed, tag, replicate), so results do not depend on how the
work is partitioned."""

from __future__ import annotations

import zlib

import numpy as np

from tessera.functions import spectra


def generator(seed: int, tag: str, replicate: int = 0) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(tag.encode()), replicate])


def upper_p(observed: float, null) -> float:
    """(1 + draws at least as large) / (draws + 1); NaN draws are left out."""
    draws = np.asarray(null, float)
    draws = draws[~np.isnan(draws)]
    return float((1 + (draws >= observed).sum()) / (1 + draws.size))


def iaaft_panel(panel, rng: np.random.Generator, rounds: int = 200) -> np.ndarray:
    """Surrogates of all rows at once, after Schreiber and Schmitz: each row takes its own amplitudes with the
    phases that it has now, then its own values in the order that gives. Ends when no order changes any more."""
    x = np.asarray(panel, float)
    if x.ndim != 2 or x.shape[1] < 4 or not np.isfinite(x).all():
        raise ValueError("rows of four finite values at least are needed")
    n = x.shape[1]
    values, amplitude = np.sort(x, axis=1), np.abs(np.fft.rfft(x, axis=1))
    rank = rng.permuted(np.tile(np.arange(n), (len(x), 1)), axis=1)
    for _ in range(rounds):
        angle = np.angle(np.fft.rfft(np.take_along_axis(values, rank, axis=1), axis=1))
        shaped = np.fft.irfft(amplitude * np.exp(1j * angle), n, axis=1)
        after = shaped.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
        if np.array_equal(after, rank):
            break
        rank = after
    return np.take_along_axis(values, rank, axis=1)


def iaaft(series, rng: np.random.Generator, rounds: int = 200) -> np.ndarray:
    """A series with exactly the same values and nearly the same amplitude spectrum."""
    return iaaft_panel(np.asarray(series, float)[None], rng, rounds)[0]


def surrogate_errors(panel, surrogate) -> dict[str, float]:
    """How well surrogates keep spectra and lag-1 correlations, and how far they undo cross-correlation."""
    x, y = np.asarray(panel, float), np.asarray(surrogate, float)
    above = np.triu(np.ones((len(x), len(x)), bool), 1)
    a, b = (np.abs(np.fft.rfft(z, axis=1))[:, 1:] for z in (x, y))
    lag = lambda z: np.array([np.corrcoef(r[:-1], r[1:])[0, 1] for r in z])
    told = {name: float(np.abs(np.corrcoef(z)[above]).mean()) for name, z in (("cross_correlation", y), ("original_cross_correlation", x))}
    return told | {"spectrum_error": float(np.median(np.linalg.norm(b - a, axis=1) / np.linalg.norm(a, axis=1).clip(1e-15))), "lag1_error": float(np.nanmedian(np.abs(lag(x) - lag(y))))}


def slope(lags, values) -> tuple[float, float, float]:
    """(intercept, slope, correlation) of a line through the finite points; NaN under three."""
    x, y = np.asarray(lags, float), np.asarray(values, float)
    good = np.isfinite(x) & np.isfinite(y)
    if good.sum() < 3:
        return (float("nan"),) * 3
    b, a = np.polyfit(x[good], y[good], 1)
    return float(a), float(b), float(np.corrcoef(x[good], y[good])[0, 1])


def excess_angle(excess: float, p: int) -> float:
    """The rotation in degrees that an excess distance stands for; NaN without excess."""
    return float(np.degrees(np.arccos(np.exp(-p * excess)))) if excess > 0 else float("nan")


# -- synthetic worlds -----------------------------------------------------------------------------------


def spectrum(n: int, top, high: float = 1.3, low: float = 0.4) -> np.ndarray:
    """A few leading values above a linear bulk."""
    top = np.asarray(top, float)
    if (np.diff(top) > 0).any() or top[-1] <= high:
        raise ValueError("descending leading values above the bulk are needed")
    return np.r_[top, np.linspace(high, low, n - top.size)]


def random_basis(n: int, rng: np.random.Generator) -> np.ndarray:
    """A basis drawn evenly from all rotations."""
    q, r = np.linalg.qr(rng.standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def assemble(basis, values) -> np.ndarray:
    lam = np.asarray(values, float)
    if np.shape(basis) != (lam.size, lam.size) or (lam <= 0).any() or (np.diff(lam) > 1e-12).any():
        raise ValueError("positive descending values, one a column, are needed")
    return (basis * lam) @ np.transpose(basis)


def jitter(values, k: int, sigma: float, rng: np.random.Generator) -> np.ndarray:
    """The first k values times unit-mean lognormal noise; refused when the order changes."""
    lam = np.array(values, float)
    if not 0 < k < lam.size or sigma < 0:
        raise ValueError("0 < k < N and sigma >= 0 are needed")
    if sigma:
        lam[:k] *= np.exp(sigma * rng.standard_normal(k) - sigma**2 / 2)
        if (np.diff(lam) > -1e-12).any():
            raise ValueError("the noise reorders the spectrum")
    return lam


def rotate(basis, i: int, j: int, theta: float) -> np.ndarray:
    """Columns i and j turned by theta in their plane."""
    q = np.array(basis, float)
    if i == j or not (0 <= min(i, j) and max(i, j) < q.shape[1]):
        raise ValueError("two different columns are needed")
    c, s = np.cos(theta), np.sin(theta)
    q[:, [i, j]] = q[:, [i, j]] @ np.array([[c, -s], [s, c]])
    return q


def injected_distance(theta: float, p: int) -> float:
    return float(-np.log(np.cos(theta)) / p)


def gaussian_window(cov, t: int, rng: np.random.Generator) -> np.ndarray:
    return np.linalg.cholesky(cov) @ rng.standard_normal((len(cov), t))


def student_window(cov, t: int, nu: float, rng: np.random.Generator) -> np.ndarray:
    """Heavy tails by one chi-square scale a day; the covariance is exactly cov."""
    student_factor(nu)
    return gaussian_window(cov, t, rng) * np.sqrt((nu - 2) / rng.chisquare(nu, t))


def student_factor(nu: float) -> float:
    if nu <= 4:
        raise ValueError("nu must exceed 4")
    return (nu - 2) / (nu - 4)


def window_on_basis(basis, path, t: int, rng: np.random.Generator) -> np.ndarray:
    """A fixed basis with values that may change by day (N, or N x t)."""
    lam = np.asarray(path, float)
    lam = lam[:, None] if lam.ndim == 1 else lam
    if len(lam) != len(basis) or lam.shape[1] not in (1, t) or (lam <= 0).any():
        raise ValueError("positive values, one a column and day, are needed")
    return np.asarray(basis) @ (np.sqrt(lam) * rng.standard_normal((len(basis), t)))


def ramp(start, end, t: int) -> np.ndarray:
    return np.linspace(np.asarray(start, float), np.asarray(end, float), t, axis=1)


def rotating_panel(n: int, days: int, omega: float, rng: np.random.Generator, top=(25.0, 10.0, 6.0, 4.0, 3.0, 2.2), planes: int = 6) -> np.ndarray:
    """Gaussian returns of a world whose k-th leading axis and k-th last one turn into each other by omega a day: a pair of
    coordinates is one complex number, and all pairs turn at once."""
    planes, lam = min(planes, n // 2), spectrum(n, top)
    axes = random_basis(n, rng)
    z = rng.standard_normal((n, days)) * np.sqrt(lam)[:, None]
    turned = (z[:planes] + 1j * z[::-1][:planes]) * np.exp(1j * omega * np.arange(days))
    return axes @ np.concatenate([turned.real, z[planes : n - planes], turned.imag[::-1]])


def histories(panel, t_in: int, horizon: int, step: int, market: bool = True) -> tuple[list, list, list]:
    """(frames, frames without the oldest horizon days, eigenvalues) of rolling windows; each window is
    adjusted by itself. market False takes the equal-weight return out of each window first."""
    x = np.asarray(panel, float)
    if not 0 < horizon < t_in - 1 or step < 1 or horizon % step:
        raise ValueError("a horizon of whole steps that leaves two days is needed")
    frames, kept, values = [], [], []
    for s in range(0, x.shape[1] - t_in + 1, step):
        window = x[:, s : s + t_in] if market else spectra.market_residual(x[:, s : s + t_in])
        lam, u = spectra.eigenpairs(spectra.covariance(spectra.adjusted(window)), 7)
        frames.append(u[:, :6])
        kept.append(spectra.eigenpairs(spectra.covariance(spectra.adjusted(window[:, horizon:])), 6)[1])
        values.append(lam)
    return frames, kept, values


def motion_rows(panel, t_in: int, horizon: int, step: int, market: bool = True) -> list[dict]:
    """(origin, component, cosine, incoming_speed, outgoing_speed) of successive motions a horizon apart."""
    from tessera.functions import flags

    frames, _, _ = histories(panel, t_in, horizon, step, market)
    k = horizon // step
    return [{"origin": i, **row} for i in range(k, len(frames) - k) for row in flags.motion(frames[i - k], frames[i], frames[i + k])]


def deletion_rows(panel, t_in: int, horizon: int, step: int) -> list[dict]:
    """(origin, component, ...) of flags.deletion at every triple of windows a horizon apart."""
    from tessera.functions import flags

    frames, kept, _ = histories(panel, t_in, horizon, step)
    k = horizon // step
    return [{"origin": i, **row} for i in range(k, len(frames) - k) for row in flags.deletion(frames[i - k], frames[i], frames[i + k], kept[i - k], kept[i])]


def persistence(panel, t_in: int, horizon: int, step: int) -> float:
    """Mean cosine of successive flag motions over triples of windows a horizon apart."""
    cos = [row["cosine"] for row in motion_rows(panel, t_in, horizon, step) if row["component"] == "flag_nested"]
    return float(np.nanmean(cos)) if cos else float("nan")


def least_angle(null, p: int) -> float:
    """The rotation in degrees that stands out of null distances: their 95th less their 20th percentile."""
    high, low = np.quantile(np.asarray(null, float), [0.95, 0.2])
    return excess_angle(float(high - low), p)

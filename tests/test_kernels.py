"""Kernels against closed forms, invariances and independent computations."""

import numpy as np
import pytest

from tessera.functions import coupling, estimators, flags, inference, spectra

RNG = np.random.default_rng(3)


def frame(n=14, k=6, seed=0):
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((n, k)))[0]


def test_covariance_is_the_textbook_one():
    x = RNG.standard_normal((5, 40))
    assert np.allclose(spectra.covariance(x), np.cov(x, bias=True))
    assert np.allclose(estimators.ewma(x, half_life=np.inf), np.cov(x, bias=True))


def test_distance_is_zero_inside_and_invariant_to_bases():
    u = frame()
    q = np.linalg.qr(RNG.standard_normal((3, 3)))[0]
    assert spectra.distance(u[:, :3], u) == pytest.approx(0, abs=1e-12)
    assert spectra.distance(u[:, :3] @ q, frame(seed=1)) == pytest.approx(spectra.distance(u[:, :3], frame(seed=1)))


def test_static_world_meets_its_closed_form():
    lam = inference.spectrum(30, [25, 10, 6, 4, 3, 2.2])
    rng = np.random.default_rng(20)
    basis = inference.random_basis(30, rng)
    cov = inference.assemble(basis, lam)
    got = [spectra.distance(spectra.eigenpairs(spectra.covariance(inference.gaussian_window(cov, 1500, rng), False), 3)[1], basis[:, :6]) for _ in range(80)]
    assert np.mean(got) == pytest.approx(spectra.distance_null(lam, 3, 6, 1500), rel=0.15)


def test_injected_rotation_has_its_distance():
    q = inference.random_basis(12, np.random.default_rng(1))
    turned = inference.rotate(q, 0, 8, 0.3)
    assert spectra.distance(q[:, :3], turned[:, :6]) == pytest.approx(inference.injected_distance(0.3, 3))


def test_random_density_has_unit_mass():
    assert spectra.random_mass(3, 6, 40) == pytest.approx(1, abs=1e-4)


def test_bulk_edge_counts_planted_factors():
    count, edge, variance = spectra.count_above_bulk(np.r_[30.0, 12.0, np.ones(38)], 4000)
    assert count == 2 and variance == pytest.approx(1) and edge == pytest.approx(1.1**2)


def test_log_and_exp_are_inverse():
    a, b = frame(seed=1), frame(seed=2)
    h = flags.log(a, b)
    assert np.abs(a.T @ h).max() < 1e-10
    assert spectra.distance(flags.exp(a, h), b) == pytest.approx(0, abs=1e-9)


def test_losses_ignore_signs_and_turns_inside_blocks():
    a, b = frame(seed=3), frame(seed=4)
    c = b.copy()
    c[:, 0] *= -1
    c[:, 1:3] = c[:, 1:3] @ np.array([[0.6, -0.8], [0.8, 0.6]])
    assert flags.losses(a, b) == pytest.approx(flags.losses(a, c))
    assert max(flags.losses(a, a).values()) < 1e-12


def test_transport_reaches_its_target_and_constant_velocity_goes_on():
    start = np.eye(12)[:, :6]
    end = start.copy()
    end[:, 0] = np.cos(0.2) * start[:, 0] + np.sin(0.2) * np.eye(12)[:, 8]
    assert np.allclose(flags.transport(start, end, [start])[0], end)
    ahead = start.copy()
    ahead[:, 0] = np.cos(0.4) * start[:, 0] + np.sin(0.4) * np.eye(12)[:, 8]
    assert np.allclose(np.abs(np.diag(flags.constant_velocity(start, end).T @ ahead)), 1)
    assert np.allclose(np.abs(np.diag(flags.damped_velocity(start, end, 0.0).T @ end)), 1)


def test_opposite_vectors_turn_half_round():
    start = np.eye(8)[:, :6]
    end = start.copy()
    end[:, 2] *= -1
    assert np.allclose(flags.transport(start, end, [start])[0], end, atol=1e-9)
    with pytest.raises(ValueError):
        flags.plane_steps(start, end)


def test_capture_grows_with_dimension_up_to_the_ceiling():
    r = RNG.standard_normal((20, 42))
    c, top = flags.captured(frame(20), r), flags.captured(flags.ceiling_frame(r), r)
    assert c["capture_1"] <= c["capture_3"] <= c["capture_6"] <= top["capture_6"]
    assert np.isnan(flags.skill(0.5, 0.5, 0.5)) and flags.skill(0.6, 0.5, 0.7) == pytest.approx(0.5)


def test_residual_takes_the_direction_out():
    h = tuple(RNG.standard_normal((9, d)) for d in flags.DIMS)
    e = tuple(RNG.standard_normal((9, d)) for d in flags.DIMS)
    rest, share, left = flags.residual(h, e)
    assert flags.inner(rest, e) == pytest.approx(0, abs=1e-12) and share + left == pytest.approx(1)
    assert flags.residual(tuple(0 * x for x in h), e)[1] is None


def test_shrinkages_keep_the_trace_and_the_vectors():
    x = RNG.standard_normal((12, 60)) * np.linspace(1, 3, 12)[:, None]
    s = spectra.covariance(x)
    for f in (estimators.ledoit_wolf, estimators.oas):
        assert np.trace(f(x)) == pytest.approx(np.trace(s))
        assert coupling.invisible(s, f(x))
    for wide in (x, RNG.standard_normal((30, 20))):
        q = estimators.quadratic_inverse(wide)
        t = wide.shape[1]
        assert np.trace(q) == pytest.approx(np.trace(spectra.covariance(wide)) * t / (t - 1))
        assert np.linalg.eigvalsh(q).min() > 0


def test_decreasing_fit():
    assert np.allclose(estimators.decreasing_fit([5, 1, 3, 2]), [5, 2, 2, 2])
    assert np.allclose(estimators.decreasing_fit([1, 2, 3]), [2, 2, 2])


def test_cross_validated_values_fall():
    x = RNG.standard_normal((8, 50))
    lam = spectra.eigenpairs(estimators.cross_validated(x))[0]
    assert (lam > 0).all()


def test_average_linkage_on_two_clusters():
    c = np.array([[1, 0.9, 0.1, 0.2], [0.9, 1, 0.3, 0.4], [0.1, 0.3, 1, 0.8], [0.2, 0.4, 0.8, 1]])
    out = estimators.average_linkage(c)
    assert out[0, 1] == pytest.approx(0.9) and out[2, 3] == pytest.approx(0.8) and np.allclose(out[:2, 2:], 0.25)


def test_rotation_lifts_every_squared_sum():
    q = np.linalg.qr(RNG.standard_normal((16, 16)))[0]
    out, done = estimators.spread_signal(q, 0.25)
    assert estimators.deviation(out).min() > 0.25 - 1e-6 and len(done) < 16
    assert estimators.deviation(out).sum() == pytest.approx(16)


def test_long_only_weights_meet_the_optimality_conditions():
    a = RNG.standard_normal((10, 10))
    c = a @ a.T + 0.1 * np.eye(10)
    w = estimators.long_only_minimum_variance(c)
    g = c @ w
    assert w.min() >= 0 and w.sum() == pytest.approx(1)
    assert np.allclose(g[w > 1e-9], g[w > 1e-9].mean()) and (g[w <= 1e-9] >= g[w > 1e-9].mean() - 1e-8).all()


def test_gradient_matches_a_finite_difference():
    a = RNG.standard_normal((12, 40))
    lam, v = spectra.eigenpairs(spectra.covariance(a))
    r = RNG.standard_normal((12, 9))
    block = coupling.unit(RNG.standard_normal((6, 6)))
    f = lambda e: flags.captured(coupling.corrected(lam, v, block, e), r)["capture_6"]
    assert coupling.gradient(block, coupling.gaps(lam)[0], coupling.label(r, v)) == pytest.approx((f(1e-5) - f(-1e-5)) / 2e-5, rel=1e-3, abs=1e-6)


def test_fits_recover_a_planted_direction():
    rng = np.random.default_rng(8)
    truth = np.array([0.6, -0.7, 0.4])
    truth /= np.linalg.norm(truth)
    designs = [rng.standard_normal((3, 14, 6)) for _ in range(40)]
    ones = [np.ones((14, 6))] * 40
    targets = [coupling.combine(d, truth) + 0.1 * rng.standard_normal((14, 6)) for d in designs]
    for beta in (coupling.ridge_beta(designs, targets, ones), coupling.gradient_beta(designs, targets, ones)):
        assert beta @ truth > 0.98
    assert np.allclose(np.diag(coupling.collinearity(designs, ones)), 1)


def test_surrogates_keep_the_values():
    rng = np.random.default_rng(0)
    x = RNG.standard_normal(200).cumsum()
    y = inference.iaaft(x, rng)
    assert np.allclose(np.sort(y), np.sort(x)) and not np.allclose(x, y)
    panel = RNG.standard_normal((4, 256)).cumsum(axis=1) + np.sin(np.arange(256) / 3)
    told = inference.surrogate_errors(panel, inference.iaaft_panel(panel, rng))
    assert told["spectrum_error"] < 0.05 and told["lag1_error"] < 0.02


def test_deletion_is_invariant_to_signs_and_sees_pure_additions():
    """Signs of vectors and turns inside blocks change nothing; kept frames that do not move leave the deletion alone."""
    rng = np.random.default_rng(9)
    frames = [inference.random_basis(12, rng)[:, :6] for _ in range(5)]
    want = flags.deletion(*frames)
    turned = []
    for f in frames:
        turn = np.zeros((6, 6))
        for a, b in ((0, 1), (1, 3), (3, 6)):
            turn[a:b, a:b] = inference.random_basis(b - a, rng)
        turned.append(f @ turn)
    for a, b in zip(want, flags.deletion(*turned)):
        assert a["component"] == b["component"] and all(a[k] == pytest.approx(b[k], abs=1e-7) for k in a if k != "component" and k not in ("addition_cosine",))
    past, now, future = frames[:3]
    still = {r["component"]: r for r in flags.deletion(past, now, future, now, now)}
    assert still["top_6"]["previous_speed"] == pytest.approx(0, abs=1e-6) and still["top_6"]["attributed"] == 0
    whole = {r["component"]: r for r in flags.motion(past, now, future)}
    assert all(still[c]["full_cosine"] == pytest.approx(whole[c]["cosine"], abs=1e-9) for c in whole)
    assert [r["component"] for r in want] == list(flags.COMPONENTS)


def test_histories_can_take_the_market_out():
    x = RNG.standard_normal((10, 80)) + 3 * RNG.standard_normal(80)
    with_market, _, values = inference.histories(x, 40, 10, 10)
    without = inference.histories(x, 40, 10, 10, market=False)[0]
    even = np.full(10, 10**-0.5)
    assert abs(even @ with_market[0][:, 0]) > 0.9 > abs(even @ without[0][:, 0]) and len(values[0]) == 7
    with pytest.raises(ValueError):
        inference.histories(x, 40, 15, 10)


def test_p_values():
    assert inference.upper_p(2.0, [1, 2, 3, np.nan]) == pytest.approx(3 / 4)


def test_student_tails_and_ramp():
    x = inference.student_window(np.eye(3), 20000, 8, np.random.default_rng(4))
    assert np.allclose(np.cov(x), np.eye(3), atol=0.06)
    assert inference.ramp([1.0], [3.0], 3).tolist() == [[1, 2, 3]]
    with pytest.raises(ValueError):
        inference.student_factor(4)


def test_market_residual_has_no_market():
    m = RNG.standard_normal(50)
    x = np.outer(np.linspace(0.5, 1.8, 12), m) + 0.1 * RNG.standard_normal((12, 50))
    assert np.abs(spectra.market_residual(x).mean(axis=0)).max() < 1e-10


def test_foresight_and_combination_run():
    x = RNG.standard_normal((14, 90))
    out = estimators.foresight(x[:, :60], x[:, 12:72], x[:, 60:72], 21)
    assert len(out) == 5 and all(np.linalg.eigvalsh(c).min() > 0 for c in out.values())
    assert estimators.factor_combination_frame(x, rank=8).shape == (14, 6)


def test_desynchronised_motions_stay_horizontal_at_speed():
    rng = np.random.default_rng(6)
    moves, starts = flags.motions([frame(12, 3, k) for k in range(9)], 2)
    moved = flags.desynchronise(moves, starts, rng)
    assert max(np.abs(u.T @ h).max() for u, h in zip(starts, moved)) < 1e-9
    assert np.allclose(np.linalg.norm(moved, axis=(1, 2)), np.linalg.norm(moves, axis=(1, 2)))
    assert 0 < flags.coherence(moved)["leading_share"] <= 1


def test_change_across_the_border():
    u = np.eye(8)[:, :3]
    inside, across = np.zeros((8, 8)), np.zeros((8, 8))
    inside[0, 0], across[0, 7], across[7, 0] = 1, 1, 1
    assert flags.cross_share(u, np.eye(8), np.eye(8) + inside) == pytest.approx(0)
    assert flags.cross_share(u, np.eye(8), np.eye(8) + across) == pytest.approx(1)
    assert np.isnan(flags.cross_share(u, np.eye(8), np.eye(8)))
    assert inference.least_angle(np.linspace(0, 0.01, 50), 3) > 0


def test_expert_weights_are_optimal():
    rng = np.random.default_rng(3)
    for n, k, t in ((6, 3, 10), (12, 3, 10), (5, 2, 4), (7, 4, 3)):
        factors = [np.linalg.cholesky(np.linalg.inv(np.cov(rng.standard_normal((n, 40)) * rng.uniform(0.3, 3, (n, 1))))) for _ in range(k)]
        recent = rng.standard_normal((n, t))
        w, gap = estimators.combine_experts(factors, recent)
        assert w.min() >= 0 and w.sum() == pytest.approx(1) and gap <= 1e-6

        def value(v):
            whole = sum(a * f for a, f in zip(v, factors))
            return np.log(np.diag(whole)).sum() - np.square(whole.T @ recent).sum() / (2 * t)

        best = value(w)
        assert all(value(v) <= best + 1e-9 for v in rng.dirichlet(np.full(k, 0.5), 3000))
    one = [factors[0], factors[0] * 1e-3]  # a corner is the best point
    assert estimators.combine_experts(one, 1e-3 * recent)[0].tolist() == [1.0, 0.0]


def test_hierarchical_resamples_are_hashed():
    import hashlib

    days = estimators.drawn_days(7, 3, 5)
    assert days.tolist() == [[int(hashlib.md5(f"5|{b}|{k}".encode()).hexdigest()[:8], 16) % 7 for k in range(7)] for b in (1, 2, 3)]
    x = np.random.default_rng(1).standard_normal((6, 7))
    plain = np.mean([estimators.hierarchical(x[:, d]) for d in days], axis=0)
    lam = np.linalg.eigvalsh(plain)
    told = estimators.bootstrap_hierarchical(x, 3, 5)
    assert np.allclose(told, plain) if lam[0] >= 0 else np.linalg.eigvalsh(told).min() > -1e-12


def test_batched_captures_equal_single_ones():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((12, 40))
    lam, v = spectra.eigenpairs(spectra.covariance(x))
    r = rng.standard_normal((12, 9))
    blocks = rng.standard_normal((5, 6, 6)) * 0.1
    told = coupling.captures(lam, blocks, coupling.spread(r, v))
    assert np.allclose(told, [flags.captured(coupling.corrected(lam, v, b, 1.0), r)["capture_6"] for b in blocks])
    assert np.allclose(coupling.spread(r, v)[6:, :6], coupling.label(r, v))

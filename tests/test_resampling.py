"""Hash-drawn bootstrap and permutations against the same draws by hand."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import resampling as R


def drawn(*key):
    return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:8], 16)


def test_draws_are_even(spark):
    got = np.array([r.x for r in spark.range(4000).select(R.draw(5, "a", F.col("id")).alias("x")).collect()])
    assert got.tolist() == [drawn(5, "a", k) for k in range(4000)]
    assert abs(got.mean() / 2**32 - 0.5) < 0.02 and len(set(got.tolist())) > 3990


@pytest.mark.parametrize("block", [1, 3, 5, 40])
def test_block_intervals_equal_the_definition(spark, block):
    rng = np.random.default_rng(block)
    series = {("p", "a"): rng.standard_normal(13), ("p", "b"): rng.standard_normal(13) + 5e6, ("q", "a"): rng.standard_normal(4), ("q", "b"): np.array([2.0])}
    rows = [(label, name, 10 * k, float(v)) for (label, name), x in series.items() for k, v in enumerate(x)] + [("p", "a", 5, None), ("q", "c", 1, float("nan"))]
    frame = spark.createDataFrame(rows, "label string, name string, origin int, gain double").repartition(5)
    got = {(r.label, r.name): r for r in R.block_intervals(frame, "gain", "origin", block, ["label", "name"], 60, 3).collect()}
    assert set(got) == set(series)
    for (label, name), x in series.items():
        n, b = len(x), min(block, len(x))
        means = []
        for rep in range(1, 61):
            at = [(drawn(3, label, rep, j) % n + k) % n for j in range(-(-n // b)) for k in range(b)][:n]
            means.append(x[at].mean())
        r = got[label, name]
        assert (r.n, r.block_length_origins, r.blocks_effective) == (n, b, n / b)
        assert [r.mean, r.ci_low, r.ci_high] == pytest.approx([x.mean(), *np.quantile(means, [0.025, 0.975])], rel=1e-12, abs=1e-9)
        assert r.excludes_zero == (n / b >= 2 and (r.ci_low > 0 or r.ci_high < 0))


@pytest.mark.parametrize("bins, tail", [(1, "fixed"), (1, "free"), (3, "fixed")])
def test_exchanged_days_equal_the_definition(spark, bins, tail):
    rng = np.random.default_rng(1)
    levels = {"p": rng.random(23), "q": np.round(rng.random(40), 1), "r": rng.random(3)}
    frame = spark.createDataFrame([(label, t, float(v)) for label, x in levels.items() for t, v in enumerate(x)], "label string, t int, level double").repartition(4)
    reps = spark.createDataFrame([(label, k) for label in levels for k in range(4)], "label string, replicate int")
    got = {}
    for r in R.exchanged_days(frame, reps, 5, bins, tail, 9).collect():
        got.setdefault((r.label, r.replicate), {})[r.t] = r.source
    assert len(got) == 12
    for label, x in levels.items():
        n = len(x)
        blocks = [list(range(s, min(s + 5, n))) for s in range(0, n, 5)]
        for k in range(4):
            order = list(range(len(blocks)))
            if k:
                whole = [b for b in order if tail == "free" or len(blocks[b]) == 5]
                ranked = sorted(whole, key=lambda b: (round(x[blocks[b]].mean(), 12), b))
                for part in np.array_split(np.array(ranked, int), bins) if bins > 1 else [np.array(whole, int)]:
                    for slot, b in zip(sorted(part.tolist()), sorted(part.tolist(), key=lambda b: (drawn(9, label, k, b), b))):
                        order[slot] = b
            want = [d for b in order for d in blocks[b]]
            assert [got[label, k][t] for t in range(n)] == want
    with pytest.raises(ValueError):
        R.exchanged_days(frame, reps, 5, 2, "free")

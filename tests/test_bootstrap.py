"""Resamples: all have n draws, leaves agree, intervals are those of plain resampling."""

import math
import random

import numpy as np
import pytest

from quarry.operators import stats as S

DELTAS = "topic string, qkey string, delta double"


@pytest.mark.parametrize("n,size", [(2, 4), (10, 4), (1000, 64), (4097, 4096)])
def test_every_resample_has_n_draws(n, size):
    leaves = -(-n // size)
    parts = [S.shares(n, k, 500, 13, size) for k in range(leaves)]
    assert (sum(parts) == n).all() and all((p >= 0).all() for p in parts)
    for k, p in enumerate(parts):
        rows = min(size, n - k * size)
        assert abs(p.mean() - rows) < 6 * math.sqrt(n * (rows / n) * (1 - rows / n) / 500) + 1e-9


def test_leaves_add_up_in_spark(spark):
    """Deltas of 1 have a mean of 1 in every resample only if no draw is lost or made twice."""
    d = spark.createDataFrame([("a" if i % 3 else None, f"q{i:03}", 1.0) for i in range(100)], DELTAS)
    for r in S.bootstrap(d, ["topic"], resamples=200, leaf=7).collect():
        assert r["low"] == r["high"] == 1.0


@pytest.mark.parametrize("leaf", [25, 4096])
def test_intervals_are_those_of_plain_resampling(spark, leaf):
    rng = random.Random(3)
    x = [rng.gauss(0.1, 1.0) for _ in range(200)]
    d = spark.createDataFrame([("a", f"q{i:03}", v) for i, v in enumerate(x)], DELTAS)
    got = S.bootstrap(d, ["topic"], leaf=leaf).collect()[0]
    means = sorted(sum(rng.choices(x, k=200)) / 200 for _ in range(5000))
    assert abs(got["low"] - means[125]) < 0.03 and abs(got["high"] - means[4875]) < 0.03


def test_one_value_is_an_error(spark):
    d = spark.createDataFrame([("a", "q1", 1.0), ("b", "q1", 1.0), ("b", "q2", 1.0)], DELTAS)
    with pytest.raises(Exception, match="needs 2 values"):
        S.bootstrap(d, ["topic"], resamples=10).collect()


def test_draws_are_spread(spark):
    """Over all resamples each row is drawn about equally often."""
    x = np.eye(50)
    n = np.array([S.drawn_sums(x[k], np.full(2000, 50), 0, 13).sum() for k in range(50)])
    assert n.sum() == 2000 * 50 and abs(n - 2000).max() < 6 * math.sqrt(2000)

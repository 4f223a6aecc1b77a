"""Blocked k-means against a plain one over Python numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tapeworks.llm import centroids as c

SCHEMA = "vec_id long, embedding array<double>, cluster string, v int"


def plain(rows, k, rounds):
    kept = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    heads = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    at = [v for _, v in heads]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(at))
    for _ in range(rounds):
        sums = {}
        for _, v in kept:
            sums.setdefault(near(v)[1], []).append(v)
        at = [[sum(x) // len(sums[j]) for x in zip(*sums[j])] if j in sums else m for j, m in enumerate(at)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    of = {}
    for _, j, d in found:
        of[j] = of.get(j, 0) + d
    return sorted(((i, j, d, of[j], sum(of.values()), tuple(at[j])) for i, j, d in found), key=repr)


def rows(n, spread=3.0, scale=1.0, seed=1):
    draw = random.Random(seed)
    homes = [[draw.gauss(0, spread) for _ in range(64)] for _ in range(6)]
    out = [(i, [scale * (x + draw.gauss(0, 0.4)) for x in draw.choice(homes)]) for i in range(n)]
    out += [(n + i, out[0][1]) for i in range(60)] + [out[1], out[1]]  # equal vectors, repeated rows
    odd = [None, [], [1.0] * 63, [1.0] * 65, [*[1.0] * 63, None], [*[1.0] * 63, math.nan], [*[1.0] * 63, math.inf], [0.0] * 64, [-0.001] * 64]
    return out + [(5000 + i, e) for i, e in enumerate(odd)] + [(None, [0.5] * 64)]


@pytest.mark.parametrize(("n", "k", "scale"), [(400, 40, 1.0), (5, 40, 1.0), (200, 7, 30000.0)])
def test_equals_plain(spark, n, k, scale):
    data = rows(n, scale=scale)
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in data], SCHEMA)
    got = sorted(((*r[:5], tuple(r[5])) for r in c.cluster(df, k=k).collect()), key=repr)
    assert got == plain(data, k, 5)


def test_nothing_and_too_large(spark):
    assert c.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    assert c.cluster(spark.createDataFrame([(1, None, "", 1)], SCHEMA)).count() == 0
    with pytest.raises(Exception, match="components must stay"):
        c.cluster(spark.createDataFrame([(1, [1e9] * 64, "", 1)], SCHEMA)).collect()


def test_curve_visits_every_cell_by_steps_of_one():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = c.hilbert_keys(cells, bits)
        path = cells[np.argsort(keys)]
        assert sorted(keys) == list(range(len(cells))) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_boxes_keep_every_nearest_centroid_and_rule_some_out():
    draw = np.random.default_rng(3)
    homes = draw.integers(-2000, 2000, (40, 64))
    for home in homes[:10]:
        data = home + draw.integers(-60, 60, (100, 64))
        some = c.candidates(data.min(axis=0), data.max(axis=0), homes)
        assert set(c.nearest(data, homes)[0]) <= set(some) and len(some) < 10


def test_narrow_and_wide_comparison_agree():
    draw = np.random.default_rng(4)
    data, homes = draw.integers(-500, 500, (300, 64)), draw.integers(-500, 500, (9, 64))
    wide = c.nearest(data * 2**14, homes * 2**14)
    best, distance = c.nearest(data, homes)
    assert (wide[0] == best).all() and (wide[1] == distance * 2**28).all()

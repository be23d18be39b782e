import math
import random

import numpy as np
import pytest

from quillmesh.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank long, score string, anchor int, place int"


def table(spark, rows):
    """(vec_id, vector, label), with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, v, la, 1, "2", 3, 4) for i, v, la in rows], SCHEMA)


def by_hand(rows, every=10, positives=5, negatives=10):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v], la) for i, v, la in rows if None not in (i, v, la) and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v, la in good:
        if i % every == 0:
            first[i] = min(first.get(i, (str(la), v, la)), (str(la), v, la))
    out = []
    for a, (_, v, la) in first.items():
        score = [(-sum(x * y for x, y in zip(v, w)), i, lb) for i, w, lb in good if i != a and len(w) == len(v)]
        for s, i, _ in sorted(r for r in score if r[2] == la)[:positives]:
            fit = sorted(r for r in score if r[2] != la and 30 * -s <= 100 * -r[0] <= 90 * -s)[:negatives]
            out += [(a, i, n, j, -s, -t) for n, (t, j, _) in enumerate(fit, 1)]
    return out


def vectors(seed, n, dim=8, groups=6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    x = centres[rng.integers(0, groups, n)] + 0.5 * rng.standard_normal((n, dim))
    return [(i, [float(v) for v in np.float32(x[i] / np.linalg.norm(x[i]))], int(rng.integers(0, 4))) for i in range(n)]


SMALL = hard_negatives.Params(leaf_anchors=3, leaf_rows=5, slice_rows=100, task_rows=64, chunk_bytes=800)


@pytest.mark.parametrize("params", [hard_negatives.Params(), SMALL])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, params, seed):
    rows = vectors(seed, 400)
    copy = rows[10][1]
    rows += [(1000 + i, copy, i % 3) for i in range(150)]  # a group of copies, some of them anchors, ties by id
    rows += [(7, rows[3][1], 1), (20, rows[5][1], 0), (20, rows[6][1], 0), (30, *rows[30][1:]), (41, *rows[41][1:]), (41, *rows[41][1:])]  # repeated ids
    random.Random(seed).shuffle(rows)
    got = hard_negatives.hard_negatives(table(spark, rows).repartition(7), "vec_id % 10 = 0", params=params).collect()
    assert sorted(map(tuple, got)) == sorted(by_hand(rows))


def test_odd_rows(spark):
    unit = [0.6, 0.8]
    rows = [(0, unit, 1), (1, unit, 1), (2, [0.3, 0.4], 2), (3, None, 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 2), (6, [float("inf"), 0.0], 2), (7, unit, None), (None, unit, 1)]
    rows += [(8, [], 1), (10, [], 2), (11, [], 2), (12, [0.5], 1), (20, [-0.5], 1), (21, [0.25], 2), (30, [0.0, 0.0], 1), (31, [1e30, 1.0], 1), (-10, unit, 2)]
    got = hard_negatives.hard_negatives(table(spark, rows), "vec_id % 10 = 0").collect()
    want = by_hand([r for r in rows if r[0] != 31])  # its scores might pass 64 bits
    assert sorted(map(tuple, got)) == sorted(want) and any(r[0] == 10 for r in want)
    assert hard_negatives.hard_negatives(table(spark, [])).count() == 0 and hard_negatives.hard_negatives(table(spark, rows), "vec_id = 77").count() == 0


def test_large_components_are_exact(spark):
    rows = [(0, [100_000.25, -3.0, 1e5], 1), (1, [1e5, 7.0, 1e5 + 0.0078125], 1), (2, [5e4, 1.0, 6e4], 2), (3, [5e4, 1.0, 6e4 + 0.00390625], 2)]
    assert sorted(map(tuple, hard_negatives.hard_negatives(table(spark, rows)).collect())) == sorted(by_hand(rows, 100))


def test_intervals_hold_and_prune():
    rng = np.random.default_rng(4)
    x, y = (np.floor(256 * (rng.integers(0, 5, (n, 1)) * 2.0 + rng.standard_normal((n, 6)) * 0.1)) for n in (200, 900))
    one, other = hard_negatives.Tree(x, 8), hard_negatives.Tree(y, 16)
    a, c = (g.ravel() for g in np.meshgrid(np.arange(len(one.spans)), np.arange(len(other.spans))))
    low, high = hard_negatives._bounds(one, a, other, c)
    for i, j, lo, hi in zip(a.tolist(), c.tolist(), low.tolist(), high.tolist()):
        s = one.rows[slice(*one.spans[i])] @ other.rows[slice(*other.spans[j])].T
        assert lo <= s.min() and s.max() <= hi
    found = hard_negatives._leaf_pairs(one, other, np.zeros(1, int), np.zeros(1, int), lambda a, lo, hi: hi >= 20_000_000)
    leaves = (one.left < 0).sum() * (other.left < 0).sum()
    assert 0 < len(found[0]) < leaves / 2  # whole nodes fall away
    assert sorted(one.order) == list(range(200)) and (one.rows == x[one.order]).all()

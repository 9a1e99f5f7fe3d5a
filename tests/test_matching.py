"""Assignments, structures in any order of atoms, and two communities of a map, against brute force."""

from __future__ import annotations

from itertools import combinations, permutations

import numpy as np
import pytest

from chartwork.operators import communities, matching

PAIRS = "i long, j long, xi array<double>, xj array<double>"


@pytest.mark.parametrize("n", [1, 2, 4, 7])
def test_auctions_find_the_least_cost(n):
    rng = np.random.default_rng(n)
    cost = np.concatenate([rng.random((40, n, n)) * 1e3, rng.integers(0, 3, (40, n, n)).astype(float), np.zeros((2, n, n)), rng.random((5, n, n)) * 1e-9])
    got = matching.assigned(cost)
    orders = np.array(list(permutations(range(n))))
    for c, columns in zip(cost, got, strict=True):
        assert sorted(columns) == list(range(n))
        assert c[np.arange(n), columns].sum() == pytest.approx(c[np.arange(n), orders].sum(axis=1).min(), rel=1e-9, abs=1e-15)


def test_auctions_of_large_matrices():
    rng = np.random.default_rng(9)
    p = rng.normal(size=(3, 120, 3))
    q = p[:, rng.permutation(120)]
    assert matching._mean_gap(p, matching._matched(q, matching.assigned(matching._gaps(p, q)))) == pytest.approx(0)


def brute(p, q, improper):
    n = len(p)
    p, q = p - p.mean(axis=0), q - q.mean(axis=0)
    h = np.stack([q[list(o)].T @ p for o in permutations(range(n))])
    s = np.linalg.svd(h, compute_uv=False)
    if not improper:
        s[:, 2] *= np.sign(np.linalg.det(h))
    return np.sqrt(max(0.0, ((p * p).sum() + (q * q).sum() - 2 * s.sum(axis=1).max()) / n))


@pytest.mark.parametrize("improper", [True, False])
def test_permuted_rmsd(spark, improper):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for k in range(36):
        n = 2 + k % 6
        p = rng.normal(size=(n, 3))
        r, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        r *= np.sign(np.linalg.det(r)) * (-1.0 if improper and k % 2 else 1.0)
        q = p[rng.permutation(n)] @ r + 7 + (0.0 if k < 12 else 0.2 * rng.normal(size=(n, 3))) if k < 24 else rng.normal(size=(n, 3))
        rows.append((k, -k, p.ravel().tolist(), q.ravel().tolist()))
        want[k] = 0.0 if k < 12 else brute(p, q, improper)
    line = [[float(v), 0.0, 0.0] for v in range(4)]
    rows += [(50, 0, np.ravel(line).tolist(), np.ravel(line[::-1]).tolist()), (51, 0, [1.0] * 3, [2.0] * 3), (52, 0, [0.0] * 9, [5.0] * 9)]
    rows += [(60, 0, [1.0] * 3, [1.0] * 6), (61, 0, None, [1.0] * 3), (62, 0, [], []), (63, 0, [float("nan")] * 3, [1.0] * 3)]
    got = {r["i"]: r["rmsd"] for r in matching.permuted_rmsd(spark.createDataFrame(rows, PAIRS), improper).collect()}
    assert all(got[k] == pytest.approx(0, abs=1e-7) for k in (50, 51, 52)) and all(got[k] is None for k in (60, 61, 62, 63))
    assert {k: got[k] for k in want} == pytest.approx(want, abs=1e-6)
    d = matching.assignment_distance(spark.createDataFrame(rows, PAIRS))
    assert {r["i"] for r in d.where("d is null").collect()} == {60, 61, 62, 63}
    assert d.where("i = 50").first()["d"] == pytest.approx(0, abs=1e-9) and d.where("i = 51").first()["d"] == pytest.approx(3**0.5)


def test_an_order_is_turned_once_and_pairs_are_spread(spark, monkeypatch):
    rng = np.random.default_rng(8)
    p, q = rng.normal(size=(2, 20, 3, 3))
    turned, plain = [], matching._turned
    monkeypatch.setattr(matching, "_turned", lambda p, q, by: turned.append(len(p)) or plain(p, q, by))
    centred = [x - x.mean(axis=1, keepdims=True) for x in (p, q)]
    got = matching.least_rmsd(*centred, True, 64)
    assert sum(turned) <= 20 * 2 * 6  # three atoms have six orders, each also mirrored
    assert got == pytest.approx([brute(a, b, True) for a, b in zip(p, q, strict=True)], abs=1e-9)
    one = spark.createDataFrame([(1, 0, [0.0] * 3, [1.0] * 3)], PAIRS).coalesce(1)
    assert matching.permuted_rmsd(one).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def sequential(x, family):
    i, j = max(combinations(range(len(x)), 2), key=lambda p: (round(float(((x[p[0]] - x[p[1]]) ** 2).sum()), 12), -p[0], -p[1]))
    a, b = x[i], x[j]
    for _ in range(16):
        left = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
        a, b = x[left].mean(axis=0), x[~left].mean(axis=0)
    major = [max(dict.fromkeys(family[s]), key=lambda f, s=s: (family[s] == f).sum()) for s in (left, ~left)]
    radii = [np.linalg.norm(x[s] - c, axis=1).max() for s, c in ((left, a), (~left, b))]
    gap = np.linalg.norm(a - b)
    return (2 if major[0] != major[1] and gap > sum(radii) else 1, int(left.sum()), int((~left).sum()), *major, gap, *radii), (i, j)


def test_two_communities(spark):
    rng = np.random.default_rng(4)

    def floor(x, family):
        rows = [(i, [float(v) for v in p] if p is not None else None, f) for i, (p, f) in enumerate(zip(x, family, strict=True))]
        df = spark.createDataFrame(rows, "id long, x array<double>, family string").repartition(3)
        return df, communities.family_floor(df).first()

    apart = np.concatenate([rng.random((20, 2)), rng.random((25, 2)) + 5])
    labels = np.array(["a"] * 20 + ["b"] * 25)
    mixed = rng.permutation(labels)
    for x, family in ((apart, labels), (apart, mixed), (rng.random((60, 2)), np.array(["a", "b", "c"] * 20)), (np.round(apart), labels)):
        df, got = floor(x, family)
        want, (i, j) = sequential(x, family)
        assert list(got) == pytest.approx(list(want))
        assert communities.farthest_pair(df)[:2] == (i, j)
    assert floor(apart, labels)[1]["floor"] == 2
    at = np.array([[np.cos(t), np.sin(t)] for t in np.arange(24) * np.pi / 12])
    far = communities.farthest_pair(floor(at, ["a"] * 24)[0])
    assert np.linalg.norm(np.array(far[2]) - far[3]) == pytest.approx(2)
    for x, family in (([], []), ([[0, 0]], ["a"]), ([[0, 0], [1, 1]], ["a", "a"]), ([[0, 0], [0, 0]], ["a", "b"]), ([[0, 0], None], ["a", "b"]), ([[0, 0], [float("nan"), 1]], ["a", "b"])):
        assert list(floor(x, family)[1]) == [1] + [None] * 7
    assert floor([[0, 0], [1, 1]], ["a", None])[1]["floor"] == 2

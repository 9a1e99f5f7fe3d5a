"""Sums and order statistics over all pairs by blocks, against brute force and the relations of pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartwork.functions.transfers import Transfer
from chartwork.operators import blocks, joins, mapped, mapping, pairs, stats
from chartwork.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
# Queries over all pairs whose result is not as large as the pairs
SUMMED = ["alpha_grid", "alpha_plugin", "chi_gap_weight", "chi_gradient", "chi_gradient_weighted", "chi_midscale", "chi_of_points", "chi_value", "diameter_pins", "dist_dot", "dist_euclid", "dist_fisher", "dist_gram", "dist_l1", "dist_periodic", "dist_sphere", "dist_stretch", "dist_wasserstein", "flagship", "joint_histogram", "joint_histogram_weighted", "joint_outliers", "map_correlations", "median_targets", "neighbour_overlap", "pair_histogram", "phate_potential", "scale_quantiles", "smacof_stress", "stress_ratio"]


@pytest.mark.parametrize("name", SUMMED)
def test_pairs_do_not_become_rows(spark, monkeypatch, name):
    def no(*_, **__):
        raise AssertionError("all pairs as rows")

    monkeypatch.setattr(pairs, "all_pairs", no)
    monkeypatch.setattr(pairs, "gram_pairs", no)
    assert QUERIES[name](spark, SF) is not None


@pytest.fixture(scope="module")
def cloud(spark):
    """300 points, some of them in one place: five blocks."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    x[7], x[250] = x[200], x[3]
    rows = [(int(3 * k), [float(v) for v in r], float(r[0]), float(r[1]), float(1 + k % 3)) for k, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x array<double>, u double, v double, w double").repartition(3), x


def distances(x):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    return d[np.tril_indices(len(x), -1)], d


def test_sums_by_point(cloud):
    df, x = cloud
    _, d = distances(x)
    got = {r["i"]: r for r in blocks.by_point(df, blocks.euclid_product).collect()}
    assert len(got) == 299
    for k in range(1, 300):
        r = got[3 * k]
        assert (r["n"], r["sum_d"], r["min_d"], r["max_d"]) == (k, pytest.approx(d[k, :k].sum()), pytest.approx(d[k, :k].min(), abs=1e-12), pytest.approx(d[k, :k].max()))


def test_pairs_without_a_distance(cloud):
    df, x = cloud
    s = x @ x.T
    got = {r["i"]: r for r in blocks.by_point(df, blocks.dot_logs).collect()}
    for k in range(1, 300):
        good = s[k, :k][s[k, :k] > 0]
        assert got[3 * k]["n"] == len(good)
        assert got[3 * k]["sum_d"] == (pytest.approx(-np.log(good).sum(), abs=1e-9) if len(good) else None)


def test_order_statistics_and_knee(cloud):
    df, x = cloud
    flat, _ = distances(x)
    d = np.sort(flat[flat > 0])
    n, got = blocks.order_statistics(df, lambda t: blocks.positive(blocks.euclid_steps(t.i.x, t.j.x)), lambda n: [0, n // 3, n - 1])
    assert n == len(d) and got == pytest.approx([d[0], d[n // 3], d[-1]], rel=1e-14)
    signed = np.sort((x[:, None, 0] - x[None, :, 0])[np.tril_indices(300, -1)])
    n, got = blocks.order_statistics(df, lambda t: np.subtract.outer(t.i.x[:, 0], t.j.x[:, 0]), lambda n: [0, n // 2, n - 1])
    assert got == [signed[0], signed[n // 2], signed[-1]]
    row = blocks.suggest_scale(df).first()
    gap = np.abs((np.arange(len(d)) + 1) / len(d) - (d - d[0]) / (d[-1] - d[0]))
    assert list(row) == pytest.approx([d[len(d) // 4], d[len(d) // 2], d[len(d) * 75 // 100], d[gap.argmax()]], rel=1e-12)


def test_stress_and_histograms_as_of_pairs(cloud):
    df, _ = cloud
    p = pairs.all_pairs(df, more=("u", "v", "w"))
    dl = F.sqrt(F.pow(F.col("u_i") - F.col("u_j"), 2) + F.pow(F.col("v_i") - F.col("v_j"), 2))
    p = p.select("i", "j", F.col("d").alias("dh"), dl.alias("dl"), F.col("u_i").alias("xi"), F.col("v_i").alias("yi"), F.col("u_j").alias("xj"), F.col("v_j").alias("yj"), (F.col("w_i") * F.col("w_j")).alias("w")).cache()
    f, g = Transfer("sigmoid", (1.4,)), Transfer("asinh", (0.7,))
    assert mapped.chi(df, f, g, 0.1).first()[0] == pytest.approx(stats.chi(p, f, g, 0.1).first()[0])
    want = {r["id"]: (r["gx"], r["gy"]) for r in stats.chi_gradient(p, 0.1, f, g, "w").collect()}
    assert {r["id"]: pytest.approx((r["gx"], r["gy"]), abs=1e-12) for r in mapped.chi_gradient(df, 0.1, f, g, "w").collect()} == want
    want = {(r["ih"], r["il"]): r["count"] for r in stats.joint_histogram(p, 10, 4.0, 3.0, "w").collect()}
    assert {(r["ih"], r["il"]): r["count"] for r in mapped.joint_histogram(df, 10, 4.0, 3.0, "w").collect()} == want
    got, want = mapped.correlations(df).first(), stats.correlations(p).first()
    assert list(got) == pytest.approx(list(want))
    far = [tuple(r) for r in p.orderBy(F.desc("dh"), "i", "j").limit(7).select("i", "j").collect()]
    assert [(r["i"], r["j"]) for r in blocks.farthest_pairs(df, 7).collect()] == far


def test_majorised_map_as_of_pairs(cloud):
    df, _ = cloud
    _, want = mapping.majorised(pairs.all_pairs(df).withColumnRenamed("d", "t"), df.select("id", F.array("u", "v").alias("x")), sweeps=2, tolerance=0.0)
    assert mapped.majorised(df, 2)[1] == pytest.approx(want)


def test_neighbours_by_blocks(cloud, monkeypatch):
    df, x = cloud
    monkeypatch.setattr(joins, "ASKED", 1 << 40)  # blocks, whatever the cells say
    got = sorted((r["i"], r["rank"], r["j"]) for r in joins.nearest_join(df, df, 3, same=True).collect())
    _, d = distances(x)
    want = [(3 * k, r + 1, int(3 * j)) for k in range(300) for r, j in enumerate([j for j in np.lexsort((np.arange(300), d[k])) if j != k][:3])]
    assert got == want


@pytest.mark.parametrize("name", ["identity", "sigmoid", "compress", "asinh", "imq"])
def test_transfers_of_arrays(spark, name):
    t = Transfer(name, () if name == "identity" else (1.3,))
    x = np.array([0.1, 0.5, 2.0])
    rows = spark.createDataFrame([(float(v),) for v in x], "x double")
    assert t.values(x) == pytest.approx([r[0] for r in rows.select(t.column("x")).collect()])
    if name != "imq":
        assert t.slopes(x) == pytest.approx([r[0] for r in rows.select(t.slope("x")).collect()])


def test_farthest_points_ahead_as_one_by_one(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(k, [float(v) for v in np.round(r, 1)]) for k, r in enumerate(rng.normal(size=(60, 2)))], "id long, x array<double>")
    monkeypatch.setattr(pairs, "AHEAD", 5)
    one = pairs.farthest_points(df, 12, 3, dist=lambda a, b: pairs.euclid(a, b, 2))
    assert pairs.farthest_points(df, 12, 3).orderBy("step").collect() == one.orderBy("step").collect()


def test_kernel_and_ranks_make_no_rows_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.round(rng.random((70, 3)), 1)  # many distances are equal
    x = x[np.unique(x, axis=0, return_index=True)[1]]
    n = len(x)
    df = spark.createDataFrame([(3 * i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, x array<double>")
    d = np.sqrt(((x[:, None] - x) ** 2).cumsum(axis=2)[:, :, -1])
    np.fill_diagonal(d, np.inf)
    order = d.argsort(axis=1, kind="stable")
    monkeypatch.setattr(blocks, "SPREAD", 4)
    got = blocks.at_ranks(df, lambda m: np.array([1, 7, m]))
    assert {tuple(r) for r in got.collect()} == {(3 * i, 3 * int(order[i, r - 1]), r) for i in range(n) for r in (1, 7, n - 1)}
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert blocks.at_ranks(df.limit(2), lambda m: np.arange(1, min(m, 1) + 1)).count() == 2
    band = spark.createDataFrame([(3 * i, float(np.sort(d[i])[1])) for i in range(n)], "id long, b double")
    kernel = mapped.phate_kernel(df, band, 10.0)
    plain = stats.phate_kernel(pairs.all_pairs(df), 2, 10.0)
    assert {(r["i"], r["j"]): r["w"] for r in kernel.collect()} == pytest.approx({(r["i"], r["j"]): r["w"] for r in plain.collect()}, abs=1e-12)


@pytest.mark.parametrize("name", ["two_scale_targets", "stitched_network", "distance_scaling"])
def test_pairs_do_not_become_rows_here_either(spark, monkeypatch, name):
    def no(*_, **__):
        raise AssertionError("all pairs as rows")

    monkeypatch.setattr(pairs, "all_pairs", no)
    assert QUERIES[name](spark, SF) is not None


def test_many_farthest_points_take_few_jobs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.round(rng.random((400, 3)), 2)
    df = spark.createDataFrame([(2 * k, [float(v) for v in r]) for k, r in enumerate(x)], "id long, x array<double>")
    made, keep = [], pairs.kept
    monkeypatch.setattr(pairs, "kept", lambda t: made.append(t) or keep(t))
    got = [(r["step"], r["id"]) for r in pairs.farthest_points(df, 60, 10).orderBy("step").collect()]
    want, m = [5], np.full(400, np.inf)
    while len(want) < 60:
        m = np.minimum(m, np.sqrt(((x - x[want[-1]]) ** 2).cumsum(axis=1)[:, -1]))
        m[want] = -1
        want.append(int(m.argmax()))
    assert got == [(n, 2 * k) for n, k in enumerate(want)]
    assert len(made) < 8


def test_degrees_at_the_cutoff(spark):
    x = np.array([(a, b) for a in range(9) for b in range(9)], dtype=float) * 0.1
    x = np.concatenate([x, x[:5]])
    df = spark.createDataFrame([(k, [float(v) for v in p]) for k, p in enumerate(x)], "id long, x array<double>").repartition(3)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    got = {r["id"]: r["degree"] for r in blocks.degrees(df, 0.3).collect()}
    assert got == {k: int((d[k] < 0.3).sum()) for k in range(len(x))}
    assert got == {r["id"]: r["degree"] for r in pairs.radius_degree(joins.radius_join(df, 0.3), 0.3, df).collect()}


@pytest.mark.parametrize("dist", [blocks.euclid_steps, blocks.dot_logs, blocks.periodic_steps([1.0, 1.0])])
def test_points_at_few_places(spark, monkeypatch, dist):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(130, 2)), 1)[np.minimum(rng.integers(0, 130, size=900), np.arange(900) // 4)]
    df = spark.createDataFrame([(5 * k, [float(v) for v in p]) for k, p in enumerate(x)], "id long, x array<double>").repartition(3)
    monkeypatch.setattr(blocks, "RUN", 50)
    monkeypatch.setattr(blocks, "fold_pairs", None)  # points don't meet one by one
    got = {r["i"]: r for r in blocks.by_point(df, dist).collect()}
    d = dist(x, x)
    assert len(got) == 899
    for k in range(1, 900):
        own = d[k, :k][~np.isnan(d[k, :k])]
        assert got[5 * k]["n"] == len(own)
        if len(own):
            assert tuple(got[5 * k])[2:] == (pytest.approx(own.sum(), abs=1e-9), pytest.approx(own.min(), abs=1e-12), pytest.approx(own.max(), abs=1e-12))


def test_arcs_of_one_place_as_an_expression_has_them():
    x = np.random.default_rng(2).random((300, 2))
    want = []
    for u, v in (2 * math.pi * x).tolist():
        cu, su, cv, sv = math.cos(u), math.sin(u), math.cos(v), math.sin(v)
        want.append(math.acos(max(-1, min(1, cu * cu + su * su * cv * cv + su * su * sv * sv))))
    assert max(want) > 0
    assert blocks.sphere_arcs([1.0, 1.0])(x, x).diagonal().tolist() == pytest.approx(want, abs=1e-12)


def test_correlations_by_bins_as_of_rows(spark, cloud, monkeypatch):
    df, _ = cloud
    want = list(mapped.correlations(df).first())
    monkeypatch.setattr(mapped, "RANKED", 0)
    monkeypatch.setattr(blocks, "listed", None)  # no pair is a row
    assert list(mapped.correlations(df).first()) == pytest.approx(want, abs=1e-5)  # 11212 far pairs: a bin holds up to some 1e-4 of them
    far = df.withColumn("u", F.when(F.col("id") == 0, 1e6).otherwise(F.col("u")))  # one place far off: nearly all pairs in one wide bin
    got = list(mapped.correlations(far).first())
    monkeypatch.undo()
    assert got == pytest.approx(list(mapped.correlations(far).first()), rel=1e-4)

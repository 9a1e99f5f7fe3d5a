"""Slopes, gradients, landmarks, grids and bond order on small hand-made tables."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartwork.functions import metrics
from chartwork.functions.transfers import parse_transfer
from chartwork.operators import graph, pairs, projection, stats, structures
from chartwork.operators.tables import numbered

# A transfer, a distance and its slope
SLOPES = [
    ("1", 5.0, 1.47928994082840264e-02),
    ("5,8,1", 2.0, 7.02241522041729543e-02),
    ("5,8,1", 20.0, 6.25305806100099996e-03),
    ("5,8,1,2,2", 5.0, 9.96093750000000000e-01),
    ("5,8,1,2,2", 20.0, 3.77885214596382468e-01),
]


@pytest.mark.parametrize(("spec", "x", "want"), SLOPES)
def test_slope_values(spark, spec, x, want):
    assert spark.range(1).select(parse_transfer(spec).slope(F.lit(x)).alias("f")).first()["f"] == pytest.approx(want, rel=1e-11)


@pytest.mark.parametrize("spec", ["identity", "2", "compress,2", "5,8,1", "3,4", "3,3", "imq,2", "asinh,2", "ts,5,8,1,3", "ms,1,4", "5,8,1,2,2"])
def test_slopes_are_derivatives(spark, spec):
    t, h = parse_transfer(spec), 1e-5
    rows = spark.createDataFrame([(v,) for v in (0.3, 1.0, 4.9, 7.5)], "x double")
    for r in rows.select(t.slope("x").alias("s"), ((t.column(F.col("x") + h) - t.column(F.col("x") - h)) / (2 * h)).alias("d")).collect():
        assert r["s"] == pytest.approx(r["d"], rel=1e-5, abs=1e-6)


def test_checked_transfers(spark):
    one = spark.range(1)
    assert one.select(parse_transfer("1").checked(F.lit(1.0)).alias("c")).first()["c"]["f"] == 0.5
    with pytest.raises(Exception, match="no transfer of"):
        one.select(parse_transfer("1").checked(F.lit(-1.0)).alias("c")).collect()


def cloud(spark, rows, w=None):
    return spark.createDataFrame([(i, [float(v) for v in x], float((w or [1] * len(rows))[i])) for i, x in enumerate(rows)], "id long, x array<double>, w double")


def test_query_chi_has_the_known_value(spark):
    high = [[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]]
    low = [[0, 0], [1, 0], [0, 1], [1, 1]]
    marks = spark.createDataFrame([(i, [float(v) for v in x], float(p), float(q), 1.0) for i, (x, (p, q)) in enumerate(zip(high, low, strict=True))], "id long, x array<double>, px double, py double, w double")
    row = spark.createDataFrame([(9, [0.2, 0.1, 0.1], 0.3, 0.2)], "id long, x array<double>, px double, py double")
    r = stats.query_chi(row, marks, lambda a, b: metrics.euclid(a, b, 3), parse_transfer("identity"), parse_transfer("identity")).first()
    assert r["chi"] == pytest.approx(1.10529941311684997e-02, rel=1e-11)
    # the gradient is that of the value
    def at(x, y):
        moved = row.withColumn("px", F.lit(x)).withColumn("py", F.lit(y))
        return stats.query_chi(moved, marks, lambda a, b: metrics.euclid(a, b, 3), parse_transfer("identity"), parse_transfer("identity")).first()["chi"]

    assert r["gx"] == pytest.approx((at(0.3 + 1e-6, 0.2) - at(0.3 - 1e-6, 0.2)) / 2e-6, rel=1e-4)
    assert r["gy"] == pytest.approx((at(0.3, 0.2 + 1e-6) - at(0.3, 0.2 - 1e-6)) / 2e-6, rel=1e-4)


def test_general_gradient(spark):
    places = {0: (0.0, 0.0), 1: (0.8, 0.1), 2: (-0.2, 0.7)}
    far = {(1, 0): 1.0, (2, 0): 2.0, (2, 1): 1.5}
    high, low = parse_transfer("1,4,3"), parse_transfer("1,4,3")

    def table(p):
        rows = [(i, j, d, math.dist(p[i], p[j]), *p[i], *p[j], 1.0 + i) for (i, j), d in far.items()]
        return spark.createDataFrame(rows, "i long, j long, dh double, dl double, xi double, yi double, xj double, yj double, w double")

    assert stats.chi(table(places), high, low, 0.1).first()["chi"] == pytest.approx(0.215874284664418881, rel=1e-12)
    got = {r["id"]: (r["gx"], r["gy"]) for r in stats.chi_gradient(table(places), 0.1, high, low, "w").collect()}
    for i in places:
        for axis in (0, 1):
            step = []
            for h in (1e-6, -1e-6):
                moved = {**places, i: tuple(v + h * (k == axis) for k, v in enumerate(places[i]))}
                step.append(stats.chi(table(moved), high, low, 0.1, F.col("w")).first()["chi"])
            assert got[i][axis] == pytest.approx((step[0] - step[1]) / 2e-6, rel=1e-4, abs=1e-7)


def test_gram_pairs(spark):
    d = {(r["i"], r["j"]): r["d"] for r in pairs.gram_pairs(cloud(spark, [[1e16, 0], [1e16 + 2, 0], [1e200, 0], [0, 0]])).collect()}
    assert d[1, 0] == 2 and d[3, 2] == 1e200
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 5))
    got = pairs.gram_pairs(cloud(spark, x.tolist()), block=7).collect()
    assert len(got) == 40 * 39 // 2
    assert all(r["i"] > r["j"] and r["d"] == pytest.approx(np.linalg.norm(x[r["i"]] - x[r["j"]]), rel=1e-12) for r in got)


def test_landmarks(spark):
    line = cloud(spark, [[0.0], [0.1], [10.0]], [1, 1000, 1])
    ids = lambda df: [r["id"] for r in df.orderBy("step").collect()]
    assert ids(pairs.farthest_points(line, 2, 0, weight="w")) == [0, 1]
    assert ids(pairs.farthest_points(line, 2, 0)) == [0, 2]
    assert ids(pairs.farthest_points(line, 9, pinned=(2, 1))) == [2, 1, 0]
    assert ids(pairs.farthest_points(line, 1, weight="w")) == [1]
    assert pairs.farthest_points(cloud(spark, []), 3).count() == 0
    with pytest.raises(ValueError, match="no such points"):
        pairs.farthest_points(line, 2, 77)
    rng = np.random.default_rng(3)
    df = cloud(spark, rng.normal(size=(60, 2)).tolist())
    drawn = [r["id"] for r in pairs.random_points(df, 10, 5).collect()]
    assert len(set(drawn)) == 10 and drawn == [r["id"] for r in pairs.random_points(df.repartition(3), 10, 5).collect()]
    staged = [r["id"] for r in pairs.staged_points(df, 6, 0).collect()]
    assert len(set(staged)) == 6
    packed = pairs.packed(df, pairs.farthest_points(df, 5, 0)).collect()
    assert sum(r["w"] for r in packed) == 60 and len(packed) == 5


def test_ranks(spark):
    rng = random.Random(4)
    rows = [(i, float(rng.choice([1, 1, 1, 2, 3, 9]))) for i in range(200)]
    got = {r["id"]: r["nr"] for r in numbered(spark.createDataFrame(rows, "id long, v double"), "v", "nr", ("id",)).collect()}
    assert [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))] == sorted(got, key=got.get)
    assert sorted(got.values()) == list(range(200))
    assert numbered(spark.createDataFrame([], "id long"), "id").count() == 0


def test_holes_and_surfaces(spark):
    ring = [(1, 1), (1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2), (3, 3), (5, 5)]
    cells = spark.createDataFrame(ring, "iy int, ix int")
    assert [(r["iy"], r["ix"]) for r in graph.filled_holes(cells, 7, 7).where("hole").collect()] == [(2, 2)]
    surface = spark.range(49).select((F.col("id") / 7).cast("int").alias("iy"), (F.col("id") % 7).cast("int").alias("ix"))
    surface = surface.join(cells.withColumn("rho", F.lit(1.0)), ["iy", "ix"], "left").select("iy", "ix", F.coalesce("rho", F.lit(0.0)).alias("rho"), F.when(F.col("rho") > 0, 0.5).alias("f"))
    body = {(r["iy"], r["ix"]): r["f"] for r in graph.connected_surface(surface, 7, 7, 0.1).collect()}
    assert len(body) == 9 and body[2, 2] == 0 and body[1, 1] == 0.5
    joint = stats.joint_histogram(spark.createDataFrame([(0.5, 0.5, 2.0), (9.0, 0.1, 1.0)], "dh double, dl double, w double"), 2, 1.0, 1.0, "w")
    assert stats.outlier_fraction(joint).first()["fraction"] == pytest.approx(1 / 3)


def test_bond_order_of_an_octahedron(spark):
    around = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    rows = [(0, k, *map(float, p)) for k, p in enumerate([(0, 0, 0), *around])]
    atoms = spark.createDataFrame(rows, "frame long, atom long, x double, y double, z double")
    r = structures.bond_order(atoms, 1.2, ("frame", "atom")).where("atom = 0").first()
    assert r["n"] == 6 and r["q4"] == pytest.approx(0.76376, abs=1e-4) and r["q6"] == pytest.approx(0.35355, abs=1e-4)


def test_structures(spark):
    atoms = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 2.0, 0.0, 0.0), (1, 0, 1.0, 1.0, 1.0), (1, 1, 1.0, 1.0, 1.0), (2, 0, 0.0, 0.0, 0.0)], "frame long, atom long, x double, y double, z double")
    c = {r["frame"]: r["x"] for r in structures.coulomb_spectrum(atoms).collect()}
    assert c[0] == pytest.approx([0.5, -0.5]) and c[1] is None and c[2] == [0.0]
    s = {r["frame"]: r["x"] for r in structures.squared_distance_spectrum(atoms).collect()}
    assert s[0] == pytest.approx([4, -4]) and s[1] == pytest.approx([0, 0])
    at = spark.createDataFrame([(v,) for v in (1.0, 1.25, 1.375, 1.5, 2.0)], "d double")
    assert [r[0] for r in at.select(structures.switching(F.col("d"))).collect()] == [1.0, 1.0, 0.5, 0.0, 0.0]
    rng = np.random.default_rng(5)
    p = rng.normal(size=(6, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    row = spark.createDataFrame([(0, 1, p.ravel().tolist(), (p @ q.T + 3).ravel().tolist())], "i long, j long, xi array<double>, xj array<double>")
    assert np.array(structures.best_rotation(row).first()["r"]).reshape(3, 3) == pytest.approx(q, abs=1e-9)
    good = spark.createDataFrame([(1, ["A"], [[0.0, 0.0, 0.0]])], "frame long, sym array<string>, pos array<array<double>>")
    assert structures.check_frames(good).count() == 1
    for bad in [(None, ["A"], [[0.0, 0.0, 0.0]]), (1, ["A", "B"], [[0.0, 0.0, 0.0]]), (1, ["A"], [[0.0, float("nan"), 0.0]]), (1, [], [])]:
        with pytest.raises(Exception, match="not a whole frame"):
            structures.check_frames(spark.createDataFrame([bad], good.schema)).collect()


def test_placing_by_brute_force():
    rng = np.random.default_rng(8)
    marks, places, w = rng.normal(size=(7, 4)), rng.normal(size=(7, 2)), rng.random(7) + 0.5
    rows = np.vstack([rng.normal(size=(20, 4)), marks[3]])
    f = lambda d: np.arcsinh(d / 0.7)
    fit = projection.Placing(places, w, f, f, 2.0, 9, 5, 0.0, 0.0)
    d = np.linalg.norm(rows[:, None] - marks, axis=2)
    at, chi, near = fit.place(projection._between(rows, marks))
    stress = lambda spot, r: float(((f(np.linalg.norm(places - spot, axis=1)) - f(d[r])) ** 2 * w).sum() / w.sum())
    line, step = np.linspace(-2, 2, 9), np.linspace(-0.5, 0.5, 5)
    for r in range(20):
        first = min([*places, *[np.array([a, b]) for a in line for b in line]], key=lambda s, r=r: stress(s, r))
        best = min([first, *[first + (a, b) for a in step for b in step]], key=lambda s, r=r: stress(s, r))
        assert chi[r] == pytest.approx(stress(best, r), rel=1e-9) and at[r] == pytest.approx(best)
        assert near[r] == d[r].argmin()
    assert at[20] == pytest.approx(places[3]) and near[20] == 3
    mean, zero, _ = projection.Placing(places, w, f, f, 2.0, 9, 5, 0.0, 0.3).place(d)
    u = np.exp(-d[0] / 0.3) * w
    assert mean[0] == pytest.approx(u @ places / u.sum()) and not zero.any()
    warm, _, _ = projection.Placing(places, w, f, f, 2.0, 9, 1, 0.05, 0.0).place(d)
    grid = [np.array([a, b]) for a in line for b in line]
    u = np.array([math.exp(-stress(s, 0) / 0.05) for s in grid])
    assert warm[0] == pytest.approx((u[:, None] * grid).sum(axis=0) / u.sum())
    one, _, _ = projection.Placing(places[:, :1], w, f, f, 2.0, 9, 5, 0.0, 0.0).place(d)
    assert one.shape == (21, 1)


def test_placing_options(spark):
    marks = spark.createDataFrame([(i, [float(v)], float(v), 1.0) for i, v in enumerate((0, 1, 3))], "id long, x array<double>, px double, w double")
    f = lambda d: d
    rows = spark.createDataFrame([(0, [2.0]), (1, [3.0])], "id long, x array<double>")
    got = {r["id"]: r for r in projection.place_on_map(rows, marks, f, f, 4.0, axes=("px",)).collect()}
    assert got[0]["x"] == pytest.approx(2, abs=0.02) and got[0]["y"] is None and (got[1]["x"], got[1]["nearest"]) == (3, 2)
    far = spark.createDataFrame([(0, [2.0, 1.0, 1.0])], "id long, x array<double>")
    assert projection.place_on_map(far, marks, f, f, 4.0, axes=("px",), distances=True).first()["x"] == pytest.approx(2, abs=0.02)
    assert projection.place_on_map(rows.limit(0), marks, f, f, 4.0, axes=("px",)).count() == 0


def test_joint_and_digests(spark, tmp_path):
    from chartwork.sources import text

    rows = spark.createDataFrame([(0, 0, 2), (0, 1, 3), (1, 0, 4), (None, None, 5)], "ih int, il int, count long")
    text.write_joint(rows, f"{tmp_path}/joint")
    written = "".join(p.read_text() for p in sorted((tmp_path / "joint").glob("part-*")))
    assert written == "0 0 2\n0 1 3\n\n1 0 4\n\n# outside 5\n"
    (tmp_path / "one.txt").write_bytes(b"abc")
    r = text.file_digests(spark, f"{tmp_path}/one.txt").first()
    assert r["length"] == 3 and r["digest"] == "sha256:ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_maps_from_distances(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 3))
    rows = cloud(spark, x.tolist())
    y = {r["id"]: np.array(r["y"]) for r in projection.landmark_scaling(rows, rows.where("id < 8"), lambda a, b: metrics.euclid(a, b, 3), 3).collect()}
    assert all(np.linalg.norm(y[i] - y[j]) == pytest.approx(np.linalg.norm(x[i] - x[j]), abs=1e-8) for i in range(30) for j in range(i))
    turned = x[:, :2] @ np.array([[0.6, -0.8], [0.8, 0.6]]) * 2.5 + 7
    both = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(x[:, :2], turned, strict=True)], "a double, b double, c double, d double")
    r = projection.procrustes(both, ("a", "b"), ("c", "d")).first()
    assert r["scale"] == pytest.approx(0.4) and r["residual"] == pytest.approx(0, abs=1e-9)


def test_correlations_don_t_depend_on_the_partitioning(spark):
    rng = random.Random(2)
    rows = [(i, j, float(rng.randrange(1, 5)), float(rng.randrange(1, 4))) for i in range(14) for j in range(i)]
    df = spark.createDataFrame(rows, "i long, j long, dh double, dl double")
    got = [tuple(stats.correlations(df.repartition(k, c)).first()) for k, c in ((1, "i"), (3, "j"), (7, "dh"))]
    assert got[0] == pytest.approx(got[1], rel=1e-12) and got[0] == pytest.approx(got[2], rel=1e-12)


def test_landmarks_refuse_what_isn_t_a_point(spark):
    marks = spark.createDataFrame([(0, [0.0, 0.0]), (1, [2.0, 0.0])], "id long, x array<double>")
    rows = spark.createDataFrame([(5, [1.0, 0.0]), (6, [3.0, 4.0])], "id long, x array<double>")
    assert {r["id"]: (r["nearest"], r["d"]) for r in pairs.nearest_landmark(rows, marks).collect()} == {5: (0, 1.0), 6: (1, 17 ** 0.5)}
    for bad in ([float("nan"), 0.0], [1.0], None, [None, 1.0]):
        broken = rows.unionByName(spark.createDataFrame([(7, bad)], "id long, x array<double>"))
        with pytest.raises(Exception, match="points must be finite"):
            pairs.nearest_landmark(broken, marks).collect()
    assert pairs.nearest_landmark(rows.limit(0), marks).count() == 0
    plan = pairs.nearest_landmark(rows, marks)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_frames_of_one_atom_have_rows(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 0.0), (2, 1, 1.0, 0.0, 0.0), (3, 0, 0.0, 0.0, 0.0), (3, 1, 9.0, 0.0, 0.0)]
    atoms = spark.createDataFrame(rows, "frame long, atom long, x double, y double, z double")
    assert {r["frame"]: r["e"] for r in structures.lennard_jones(atoms).collect()}[1] == 0.0
    assert {r["frame"]: r["x"] for r in structures.sorted_distances(atoms).collect()} == {1: [], 2: [1.0], 3: [9.0]}
    order = {r["frame"]: (r["n"], r["q6"]) for r in structures.bond_order(atoms, 1.5).collect()}
    assert order[1] == (0, None) == order[3] and order[2][0] == 2
    assert {(r["frame"], r["atom"]): r["x"] for r in structures.radial_density(atoms, [1.0], 0.5).collect()}[(1, 0)] == [0.0]


def test_box_of_no_points(spark):
    assert stats.padded_box(spark.createDataFrame([], "x double, y double"), "x", "y") == pytest.approx((-0.05, 0.05, -0.05, 0.05))


def test_staged_draw_takes_cells_by_mass(spark):
    rows = [(i, [float(i % 2) * 100 + i * 1e-3]) for i in range(40)] + [(100, [500.0])]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    first = [r["id"] for r in pairs.staged_points(df, 10, 0, 3).orderBy("ord").collect()]
    assert first == [r["id"] for r in pairs.staged_points(df.repartition(5), 10, 0, 3).orderBy("ord").collect()]
    assert len(set(first)) == 10
    # a large power of the inverse mass: the lone point's cell comes first
    lone = [100 in [r["id"] for r in pairs.staged_points(df, 3, 0, s, gamma=-6.0).collect()] for s in range(2)]
    assert all(lone)


def test_landmarks_by_mode(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(3, 12)], "id long, x array<double>")
    for mode in ("farthest", "staged", "stride", "random"):
        got = [r["id"] for r in pairs.select_points(df, mode, 3, seed=1).orderBy("ord").collect()]
        assert len(set(got)) == 3, mode
        assert pairs.select_points(df, mode, 99).count() == 9, mode
        assert pairs.select_points(df.limit(0), mode, 3).count() == 0
    assert [r["id"] for r in pairs.select_points(df, "farthest", 2).orderBy("ord").collect()] == [3, 11]
    with pytest.raises(ValueError, match="not a mode"):
        pairs.select_points(df, "other", 3)

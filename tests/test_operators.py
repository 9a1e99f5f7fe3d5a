"""Operators on small hand-made tables: known values, invariants, round trips."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartwork.functions import metrics
from chartwork.functions.transfers import lower_gamma, parse_transfer
from chartwork.operators import graph, pairs, projection, solvers, stats, structures
from chartwork.sources import text
from chartwork.streaming.maps import windowed_histogram

# A transfer, a distance and its value
TRANSFERS = [
    ("1", 0.1, 9.90099009900990978e-03),
    ("compress,1", 8.0, 8.88888888888888840e-01),
    ("5,8,1", 5.0, 0.5),
    ("5,8,1", 2.0, 1.91316755317568754e-02),
    ("6,8,8", 8.0, 9.08997600454942600e-01),
    ("5,8,1,2,2", 5.0, 5.0),
    ("5,8,1,2,2", 10.0, 8.65744070797482),
    ("asinh,1", 1.0, 0.5),
    ("imq,3", 0.0, 0.0),
    ("ts,5,8,1", 5.0, 0.5),
]


@pytest.mark.parametrize(("spec", "x", "want"), TRANSFERS)
def test_transfer_values(spark, spec, x, want):
    got = spark.range(1).select(parse_transfer(spec).column(F.lit(x)).alias("f")).first()["f"]
    assert got == pytest.approx(want, rel=1e-13, abs=1e-14)


def test_gamma(spark):
    x = np.array([0.0, 0.3, 1.0, 4.0, 9.0])
    assert lower_gamma(1.0, x) == pytest.approx(1 - np.exp(-x), abs=1e-12)
    assert lower_gamma(0.5, x) == pytest.approx([math.erf(math.sqrt(v)) for v in x], abs=1e-12)
    rows = spark.createDataFrame([(float(v),) for v in x], "x double")
    odd = [r["f"] for r in rows.select(parse_transfer("2,1").column("x").alias("f")).collect()]
    assert odd == pytest.approx([math.erf(v / 2 / math.sqrt(2)) for v in x], abs=1e-12)


@pytest.mark.parametrize("spec", ["nothing", "1,2,3,4", "asinh,-1", "ms,1", "5,0.5,1"])
def test_bad_transfers(spec):
    with pytest.raises(ValueError):
        parse_transfer(spec)


def one(spark, a, b, f):
    return spark.createDataFrame([([float(v) for v in a], [float(v) for v in b])], "a array<double>, b array<double>").select(f("a", "b").alias("d")).first()["d"]


def test_metric_values(spark):
    assert one(spark, [0.0, 0, 0], [3.0, 4, 0], lambda a, b: metrics.euclid(a, b, 3)) == 5
    assert one(spark, [0.05], [0.95], lambda a, b: metrics.periodic(a, b, [1.0])) == pytest.approx(0.1)
    assert one(spark, [0.5, 0.5], [1.0], metrics.manhattan) == 1
    assert one(spark, [0.0, 1, 0], [1.0, 1, 0], lambda a, b: metrics.stretch(a, b, [1, 0, 0], 3)) == 2
    assert one(spark, [0.0, 0], [0.0, 1], lambda a, b: metrics.stretch(a, b, [1, 0], 3)) == 1
    assert one(spark, [1.0, 0], [-1.0, 0], lambda a, b: metrics.dot_distance(a, b, 2)) is None
    row = spark.createDataFrame([([1.0, 0.0, 0.0], [0.0, 0.0, 1.0])], "a array<double>, b array<double>")
    row = row.select(metrics.cumulative("a").alias("a"), metrics.cumulative("b").alias("b"))
    assert row.select(metrics.wasserstein("a", "b").alias("d")).first()["d"] == 2
    assert one(spark, [0.0], [0.25], lambda a, b: metrics.sphere(a, b, [1.0])) == pytest.approx(math.pi / 2)


def cloud(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(rows)], "id long, x array<double>")


def test_pairs_are_complete(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    for block in (5, 1000):
        got = pairs.all_pairs(cloud(spark, x), block=block).collect()
        assert len(got) == 60 * 59 // 2 == len({(r["i"], r["j"]) for r in got}) and all(r["j"] < r["i"] for r in got)
        assert all(r["d"] == pytest.approx(np.linalg.norm(x[r["i"]] - x[r["j"]])) for r in got)
    assert pairs.all_pairs(cloud(spark, [])).count() == 0
    with pytest.raises(ValueError):
        pairs.all_pairs(cloud(spark, [[1, 2], [1]]))
    with pytest.raises(ValueError):
        pairs.all_pairs(cloud(spark, [[1], [math.nan]]))


def test_farthest_and_voronoi(spark):
    square = cloud(spark, [(0, 0), (1, 0), (0, 1), (1, 1), (0.5, 0.5)])
    assert [r["id"] for r in pairs.farthest_points(square, 3, 0).orderBy("step").collect()] == [0, 3, 1]
    assert pairs.farthest_points(cloud(spark, [(0,), (0,)]), 5, 0, every=1).count() == 2
    line = cloud(spark, [(0,), (0.1,), (0.2,), (10,)]).withColumn("w", F.lit(1.0))
    cells = pairs.voronoi(line, line.where("id in (0, 3)"))
    assert {r["id"]: r["weight"] for r in cells.collect()} == {0: 0.75, 3: 0.25}
    assert sorted(r["id"] for r in pairs.stride_points(cloud(spark, [(i,) for i in range(6)]), 3).collect()) == [0, 2, 4]


def test_free_energy(spark, tmp_path):
    rows = spark.createDataFrame([(0.5, 0.5), (0.5, 0.5), (1.5, 1.5), (7.0, 0.0)], "x double, y double")
    fes = stats.free_energy(stats.histogram2d(rows, "x", "y", (0, 2, 0, 2), 2, 2), (0.0, 2.0, 0.0, 2.0), 2, 2)
    text.write_free_energy(fes, str(tmp_path / "fes"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "fes")).collect()]
    assert [x for x in lines if x] == ["0.50000000 0.50000000 0.00000000 6.66666667e-01", "1.50000000 0.50000000 nan 0.00000000e+00", "0.50000000 1.50000000 nan 0.00000000e+00", "1.50000000 1.50000000 0.69314718 3.33333333e-01"]
    h = stats.histogram(rows, "x", 0.0, 2.0, 2)
    assert {r["bin"]: r["count"] for r in h.collect()} == {-1: 0, 0: 2, 1: 1, 2: 1}
    flat = stats.blurred(stats.histogram2d(rows, "x", "y", (0, 2, 0, 2), 2, 2), 0.5)
    assert flat.agg(F.sum("count")).first()[0] < 3


def test_dimer(spark):
    atoms = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 0.0), (0, 2, 10.0, 0.0, 0.0)], "frame long, atom long, x double, y double, z double")
    assert sorted(r["cn"] for r in stats.coordination(atoms, 1.5).collect()) == [0, 1, 1]
    assert structures.lennard_jones(atoms.where("atom < 2")).first()["e"] == 0
    assert structures.sorted_distances(atoms).first()["x"] == [1, 9, 10]
    assert structures.unflattened(structures.positions(atoms)).orderBy("atom").collect() == atoms.orderBy("atom").collect()
    assert sum(structures.coulomb_spectrum(atoms).first()["x"]) == pytest.approx(0)


def test_rmsd_is_invariant(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(size=(8, 3))
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    moved, other = p @ turn + 5, rng.normal(size=(8, 3))
    rows = [(0, 1, p.ravel().tolist(), moved.ravel().tolist()), (0, 2, p.ravel().tolist(), other.ravel().tolist())]
    got = {r["j"]: r["rmsd"] for r in structures.aligned_rmsd(spark.createDataFrame(rows, "i long, j long, xi array<double>, xj array<double>")).collect()}
    assert got[1] == pytest.approx(0, abs=1e-6) and got[2] > 0.1


def test_projection(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 4)) * [3, 2, 0.1, 0.1]
    got = projection.principal(cloud(spark, x), 4, 2)
    want = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:2]
    assert got.variance == pytest.approx(want)
    a, b = [0.0, 0, 0, 0], [1.0, 0, 0, 0]
    s = projection.axis_coordinates(cloud(spark, np.vstack([x, a, b])), a, b).orderBy("id").collect()
    assert s[200]["s1"] == pytest.approx(0) and s[201]["s1"] == pytest.approx(1)
    marks = spark.createDataFrame([(i, v, 1.0, *map(float, v)) for i, v in enumerate([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]])], "id long, x array<double>, w double, px double, py double")
    rows = cloud(spark, [(0, 1), (1, 1), (0.2, 0.2)])
    f = lambda d: d
    spots = {r["id"]: r for r in projection.place_on_map(rows, marks, f, f, 1.5).collect()}
    assert (spots[0]["x"], spots[0]["y"], spots[0]["nearest"]) == (0, 1, 2)
    assert spots[1]["x"] == pytest.approx(1, abs=0.05) and spots[1]["y"] == pytest.approx(1, abs=0.05)
    dist = lambda a, b: metrics.euclid(a, b, 2)
    near = {r["id"]: r for r in projection.knn_average(rows, marks, 1, ("px", "py")).collect()}
    assert near[0]["py"] == pytest.approx(1)


def test_graph(spark):
    nodes = spark.range(8)
    edges = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (5, 4), (6, 5)], "i long, j long").withColumn("d", F.lit(1.0))
    comp = {r["id"]: r["component"] for r in graph.components(nodes, edges).collect()}
    assert comp == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 4, 7: 7}
    energy = spark.createDataFrame(list(enumerate([0.0, 2.0, 1.5, 0.5, 1.0, 3.0, 0.1, 9.0])), "id long, e double")
    costs = graph.edge_costs(edges, energy)
    assert {r["id"]: r["basin"] for r in graph.basins(costs, energy).collect()} == {0: 0, 1: 0, 2: 3, 3: 3, 4: 4, 5: 6, 6: 6, 7: 7}
    even = edges.where("i < 4").select("i", "j", F.lit(1.0).alias("w"))
    q = {r["id"]: r["q"] for r in solvers.committor(even, [0], [3]).collect()}
    assert [q[i] for i in range(4)] == pytest.approx([0, 1 / 3, 2 / 3, 1], abs=1e-6)


def test_suggestions(spark):
    assert stats.suggest_tau(spark.createDataFrame([(0.0,), (2.0,)], "x double"), "x").first()["tau"] == pytest.approx(0.7)
    loss = spark.createDataFrame([(float(a), (a - 5) ** 2.0) for a in range(11)], "alpha double, loss double")
    got = stats.suggest_alpha(loss).first()
    assert got["alpha"] == 5 and got["alpha_lo"] <= 5 <= got["alpha_hi"]
    with pytest.raises(ValueError):
        stats.suggest_scale(pairs.all_pairs(cloud(spark, [(0,), (1,)])))


def test_point_files(spark, tmp_path):
    rows = spark.createDataFrame([(0, [0.1, 1e-17], 2.0), (1, [3.0, -4.5], 0.5)], "id long, x array<double>, w double")
    text.write_points(rows, str(tmp_path / "p"), weighted=True)
    got = text.read_points(spark, str(tmp_path / "p"), 2, weighted=True)
    assert [(r["x"], r["w"]) for r in got.orderBy("id").collect()] == [([0.1, 1e-17], 2.0), ([3.0, -4.5], 0.5)]
    (tmp_path / "q.txt").write_text("# note\n\n 1 2\n3\t4 \n")
    assert [r["x"] for r in text.read_points(spark, str(tmp_path / "q.txt"), 2).orderBy("id").collect()] == [[1, 2], [3, 4]]
    for bad in ("1 2 3\n", "1 nan\n", "1 x\n"):
        (tmp_path / "bad.txt").write_text(bad)
        with pytest.raises(Exception, match="not a point"):
            text.read_points(spark, str(tmp_path / "bad.txt"), 2).collect()


def test_other_files(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("2\nenergy -1.5\nAr 0 0 0\nAr 1.5 0 2\n")
    got = text.read_xyz(spark, str(tmp_path / "a.xyz")).orderBy("atom").collect()
    assert [(r["symbol"], r["x"], r["z"]) for r in got] == [("Ar", 0, 0), ("Ar", 1.5, 2)] and got[0]["comment"] == "energy -1.5"
    (tmp_path / "b.min").write_text("-1.5 0 0 0 1 1 1\n")
    assert text.read_minima(spark, str(tmp_path / "b.min")).first()["xyz"] == [0, 0, 0, 1, 1, 1]
    (tmp_path / "c.hist").write_text("# family wells min_e h0 h1\n3 46 -1.7e2 0.5 0.5\n")
    assert text.read_families(spark, str(tmp_path / "c.hist")).first()["h"] == [0.5, 0.5]
    marks = spark.createDataFrame([(0, [1.0], [2.0, 3.0], 1.0)], "id long, x array<double>, place array<double>, w double")
    text.write_plumed(marks, str(tmp_path / "d"), 1)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "d")).collect()] == ["REMARK WEIGHT=1.0 MAP.1=2.0 MAP.2=3.0", "REMARK ARG=d.1", "REMARK d.1=1.0", "END"]


def test_provenance(spark):
    good = ("r", "sha256:" + "a" * 64, "e", "p", None, 1, 1, 1, 1)
    rows = [good, ("", *good[1:]), (good[0], "md5:1", *good[2:]), (*good[:4], "zz", 1, 1, 1, 1), (*good[:8], 0)]
    df = spark.createDataFrame(rows, "run_id string, input_digest string, engine_id string, protocol_family string, revision string, protocol_major int, abi_major int, abi_layout_revision int, dlpack_major int")
    assert [r["valid"] for r in text.valid_provenance(df).collect()] == [True, False, False, False, False]


def test_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    out = windowed_histogram(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts", "value", 0.0, 100.0, 4)
    run = out.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination()
    batch = windowed_histogram(spark.read.parquet(str(tmp_path / "in")), "ts", "value", 0.0, 100.0, 4)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, batch.collect()))


def test_bodies(spark):
    cells = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (3, 3), (3, 2)], "iy int, ix int")
    assert {(r["iy"], r["ix"]): r["body"] for r in graph.bodies(cells, 4).collect()} == {(0, 0): 0, (0, 1): 0, (1, 1): 0, (3, 3): 14, (3, 2): 14}
    assert sorted(map(tuple, graph.largest_body(cells, 4).collect())) == [(0, 0), (0, 1), (1, 1)]


def test_committor_of_a_long_chain(spark):
    """Chains of inner nodes are eliminated block by block: two rounds are enough where one block's width a round is not."""
    rng = np.random.default_rng(5)
    w = np.exp(rng.normal(size=3000) * 2)
    rows = [(k, k + 1, float(v)) for k, v in enumerate(w)] + [(9000, 9001, 1.0)]
    got = {r["id"]: r["q"] for r in solvers.committor(spark.createDataFrame(rows, "i long, j long, w double"), [0], [3000], rounds=2, block=60).collect()}
    want = np.concatenate([[0.0], np.cumsum(1 / w)]) / (1 / w).sum()
    assert len(got) == 3003 and got[9000] is None
    assert [got[k] for k in range(3001)] == pytest.approx(want.tolist(), abs=1e-9)


def test_distance_fill_takes_the_nearest_without_meeting_all_sites(spark):
    rng = np.random.default_rng(12)
    sites = [(i, float(x), float(y), float(v)) for i, (x, y, v) in enumerate(np.round(rng.random((300, 3)) * 10, 0))]
    grid = [(iy, ix, ix * 1.5, iy * 1.5) for iy in range(-2, 5) for ix in range(-2, 5)]
    df = spark.createDataFrame([*sites, (900, None, 1.0, 5.0), (901, float("nan"), 1.0, 5.0)], "id long, x double, y double, v double")
    got = graph.inverse_distance_fill(spark.createDataFrame(grid, "iy int, ix int, x double, y double"), df, 5, 3.0)
    want = {}
    for iy, ix, x, y in grid:
        near = [(d, i, v) for d, i, v in sorted((((x - a) ** 2 + (y - b) ** 2) ** 0.5, i, v) for i, a, b, v in sites)[:5] if d <= 3.0]
        w = [1 / (d + 1e-9) ** 2 for d, _, _ in near]
        want[iy, ix] = sum(a * v for a, (_, _, v) in zip(w, near, strict=True)) / sum(w) if w else None
    assert {(r["iy"], r["ix"]): r["f"] for r in got.collect()} == {k: v if v is None else pytest.approx(v) for k, v in want.items()}
    assert "FLOOR" not in got._jdf.queryExecution().executedPlan().toString().upper()  # no bins that a cell meets whole


def test_z_scores_of_many_rows_keep_their_digits(spark):
    df = spark.range(100_000).coalesce(1).select("id", (F.lit(1e9) + F.col("id") % 7 / 10).alias("v"))
    x = np.array([r["v"] for r in df.limit(100_000).collect()])
    off = x - 1e9
    mean = math.fsum(off) / len(off)
    want = (off - mean) / math.sqrt(math.fsum((off - mean) ** 2) / len(off))
    got = np.array([r["v"] for r in stats.z_scores(df, ("v",)).orderBy("id").collect()])
    assert np.abs(got - want).max() < 1e-9


def test_squared_distance_spectrum_is_linear_in_atoms(spark):
    """Eigenvalues as of the dense matrix, of frames of any size; of 3000 atoms all but five are 0 exactly, as no matrix is made."""
    rng = np.random.default_rng(3)
    sizes = [1, 2, 3, 4, 5, 6, 17, 17, 60]
    frames = [rng.normal(size=(n, 3)) * [10, 3, 1] + 1000 for n in sizes] + [np.zeros((7, 3)), np.arange(9.0)[:, None] * [1, 0, 0]]
    rows = [(f, a, *map(float, p)) for f, x in enumerate(frames) for a, p in enumerate(x)]
    rows += [(99, 0, 0.0, 0.0, 0.0), (99, 1, 1e200, 0.0, 0.0)]
    got = {r["frame"]: r["x"] for r in structures.squared_distance_spectrum(spark.createDataFrame(rows, "frame long, atom long, x double, y double, z double")).collect()}
    assert got[99] is None
    for f, x in enumerate(frames):
        want = np.linalg.eigvalsh(((x[:, None] - x[None]) ** 2).sum(axis=2))[::-1]
        assert len(got[f]) == len(x)
        assert np.abs(np.array(got[f]) - want).max() <= 1e-10 * max(1.0, want[0])
    large = spark.range(3000).selectExpr("1L as frame", "id as atom", "sin(id) as x", "cos(id * 2) as y", "id / 3000 as z")
    values = np.array(structures.squared_distance_spectrum(large).first()["x"])
    x = np.array([[math.sin(i), math.cos(2 * i), i / 3000] for i in range(3000)])
    squares = ((x[:, None] - x[None]) ** 2).sum(axis=2) ** 2
    assert np.count_nonzero(values) == 5
    assert (values**2).sum() == pytest.approx(squares.sum(), rel=1e-12)

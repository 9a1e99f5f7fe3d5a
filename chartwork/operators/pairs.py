"""Pairs of points as a relation: all pairs in blocks, neighbours, graphs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartwork.functions.metrics import euclid
from chartwork.operators.joins import Distances, euclid_block
from chartwork.operators.tables import kept, numbered

#: Points of one block; each pair of blocks is one group of a join.
BLOCK = 256
#: Rows a landmark table may have to be broadcast.
LANDMARKS = 5000
#: Rows of largest gain that a job of farthest points brings to the driver.
AHEAD = 1024

Metric = Callable[[str | Column, str | Column], Column]


def points(df: DataFrame, key: str, x: str) -> DataFrame:
    """(id, x) with x as doubles."""
    return df.select(F.col(key).cast("long").alias("id"), F.col(x).cast("array<double>").alias("x"))


def dimension(df: DataFrame, x: str = "x") -> int:
    """Length of the arrays; an error if they differ or hold what is not finite."""
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    low, high, wrong = df.agg(F.min(F.size(x)), F.max(F.size(x)), F.count_if(bad)).first()
    if low is None:
        return 0
    if low != high or wrong:
        raise ValueError("points must be finite and of equal length")
    return low


def all_pairs(df: DataFrame, dist: Metric | None = None, block: int = BLOCK, more: tuple[str, ...] = ()) -> DataFrame:
    """(i, j, d) of all pairs j < i.

    Points are dealt to blocks by a hash of their id; a pair of blocks is one key of an equi-join, so nothing is
    broadcast and no task holds more than two blocks. The output is quadratic by definition: for large tables take
    landmarks first. ``more`` names columns carried along as ``<name>_i`` and ``<name>_j``.
    """
    n = df.count()
    dim = dimension(df)
    if dist is None:
        dist = lambda a, b: euclid(a, b, dim)
    blocks = max(4, math.ceil(n / block))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    also = [c for c in more if c != "x"]
    side = df.select("id", "x", *also).withColumn("_b", own).withColumn("_c", F.explode(every))
    names = ["id", "x", *also]
    # of two blocks p <= q, rows of p meet rows of q
    left = side.where("_b <= _c").select(F.col("_b").alias("_p"), F.col("_c").alias("_q"), *[F.col(c).alias(f"{c}_a") for c in names])
    right = side.where("_c <= _b").select(F.col("_c").alias("_p"), F.col("_b").alias("_q"), *[F.col(c).alias(f"{c}_b") for c in names])
    met = left.join(right, ["_p", "_q"]).where((F.col("_p") < F.col("_q")) & (F.col("id_a") != F.col("id_b")) | (F.col("_p") == F.col("_q")) & (F.col("id_b") < F.col("id_a")))
    swap = F.col("id_a") < F.col("id_b")
    pick = lambda c, i: F.when(swap, F.col(f"{c}_b" if i else f"{c}_a")).otherwise(F.col(f"{c}_a" if i else f"{c}_b"))
    extra = [pick(c, s).alias(f"{c}_{'i' if s else 'j'}") for c in more for s in (True, False)]
    return met.withColumn("d", dist("x_a", "x_b")).select(pick("id", True).alias("i"), pick("id", False).alias("j"), "d", *extra)


def gram_pairs(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """(i, j, d) of all pairs j < i by Euclidean distance, as matrix products of blocks in Arrow batches.

    Like ``all_pairs``, but a block travels as one row. Squared distances from a product cancel where points are near
    to each other: below 1e-4 of the squared lengths they are worked out from differences. Each pair of blocks is
    scaled by a power of two near its largest entry, so that neither squares nor sums overflow.
    """
    n = df.count()
    dimension(df)
    blocks = max(4, math.ceil(n / block))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    packs = df.groupBy(own.alias("b")).agg(F.collect_list(F.struct("id", "x")).alias("rows"))  # about ``block`` rows
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    side = packs.withColumn("c", F.explode(every))
    left = side.where("b <= c").select(F.col("b").alias("p"), F.col("c").alias("q"), F.col("rows").alias("left"))
    right = side.where("c <= b").select(F.col("c").alias("p"), F.col("b").alias("q"), F.col("rows").alias("right"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, q, a, b in zip(batch["p"], batch["q"], batch["left"], batch["right"], strict=True):
                ia, ib = (np.array([r["id"] for r in rows]) for rows in (a, b))
                x, y = (np.array([r["x"] for r in rows], dtype=float) for rows in (a, b))
                scale = 2.0 ** np.floor(np.log2(max(np.abs(x).max(initial=0), np.abs(y).max(initial=0), 1e-300)))
                u, v = x / scale, y / scale
                length = (u * u).sum(axis=1)[:, None] + (v * v).sum(axis=1)
                squared = length - 2 * (u @ v.T)
                near = np.nonzero((squared <= 1e-4 * length) | (length < 1e-200))
                d = np.sqrt(np.maximum(squared, 0)) * scale
                gap = np.abs(x[near[0]] - y[near[1]])
                most = np.maximum(gap.max(axis=1, initial=0), 1e-300)
                d[near] = most * np.sqrt(((gap / most[:, None]) ** 2).sum(axis=1))
                u, v = np.nonzero(ia[:, None] > ib if p == q else ia[:, None] != ib)
                yield pd.DataFrame({"i": np.maximum(ia[u], ib[v]), "j": np.minimum(ia[u], ib[v]), "d": d[u, v]})

    return left.join(right, ["p", "q"]).mapInPandas(run, "i long, j long, d double")


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("i", "j", "d").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))


def nearest_neighbours(pairs: DataFrame, k: int) -> DataFrame:
    """(i, j, d, rank) of the k nearest of each point, by (d, j)."""
    rank = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    return both_ways(pairs).withColumn("rank", rank).where(F.col("rank") <= k)


def undirected(graph: DataFrame) -> DataFrame:
    """Edges that either end picked, once each, as (i > j)."""
    return graph.select(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"), "d").dropDuplicates(["i", "j"])


def sound(x: str | Column, dim: int) -> Column:
    """The array, or an error on reading a row whose array isn't ``dim`` finite numbers."""
    x = F.col(x) if isinstance(x, str) else x
    bad = x.isNull() | (F.size(x) != dim) | F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(bad, F.raise_error(F.lit("points must be finite and as long as the landmarks"))).otherwise(x)


def _bounded(landmarks: DataFrame) -> int:
    """The landmarks' dimension; an error if there are too many to be broadcast, or if they aren't sound."""
    if landmarks.limit(LANDMARKS + 1).count() > LANDMARKS:
        raise ValueError(f"more than {LANDMARKS} landmarks")
    return dimension(landmarks)


def with_landmarks(rows: DataFrame, landmarks: DataFrame, dist: Metric) -> DataFrame:
    """Every row with every landmark and their distance, as rows. (``by_landmarks`` has them inside the row.)

    Landmarks are a fitted sample of bounded size: up to LANDMARKS they are broadcast, more are refused.
    """
    dim = _bounded(landmarks)
    marks = landmarks.select(*[F.col(c).alias(f"l_{c}") for c in landmarks.columns])
    return rows.withColumn("x", sound("x", dim)).join(F.broadcast(marks)).withColumn("d", dist("x", "l_x"))


#: Distances of rows to landmarks that a task holds at a time.
_HELD = 1 << 21


def by_landmarks(rows: DataFrame, landmarks: DataFrame, dist: Distances, found: Callable[[np.ndarray, dict[str, np.ndarray]], list[np.ndarray]], schema: str, values: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carry, schema) of what ``found`` makes of each row's distances to all landmarks, in Arrow batches.

    ``found`` gets a matrix of distances, a column a landmark in the order of ids, and the landmarks' ``values`` and
    ids. No row is copied, sorted or shuffled: the landmarks (LANDMARKS at most, more are refused) travel with the
    task. A row that isn't finite, or has another dimension than the landmarks, is an error.
    """
    dim = _bounded(landmarks)
    held = sorted(landmarks.select("id", "x", *values).collect(), key=lambda r: r["id"])
    marks = np.array([r["x"] for r in held], dtype=float).reshape(len(held), dim)
    known = {c: np.array([r[c] for r in held], dtype=np.int64 if c == "id" else float) for c in ("id", *values)}
    out = rows.select("id", *carry, F.col("x").cast("array<double>").alias("x"))
    kinds = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in out.schema if f.name != "x"] + [schema])
    names = ["id", *carry, *(f.split()[0] for f in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            at, n = x.offsets.to_numpy(), len(x)
            flat = x.values.slice(at[0], at[-1] - at[0])
            if x.null_count or flat.null_count or (np.diff(at) != dim).any() or not np.isfinite(flat.to_numpy(zero_copy_only=False)).all():
                raise ValueError("points must be finite and as long as the landmarks")
            points_ = flat.to_numpy().reshape(n, dim)
            step = max(1, _HELD // max(1, len(marks)))
            parts = [found(dist(points_[lo : lo + step], marks), known) for lo in range(0, n, step)]
            made = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", *carry)] + made, names=names)

    if not held:
        return rows.sparkSession.createDataFrame([], kinds)
    return out.mapInArrow(run, kinds)


def nearest_landmark(rows: DataFrame, landmarks: DataFrame, dist: Distances = euclid_block, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row with its nearest landmark's id and distance; ties go to the lower id. ``carry`` names columns to keep."""

    def found(d: np.ndarray, known: dict[str, np.ndarray]) -> list[np.ndarray]:
        best = d.argmin(axis=1)
        return [known["id"][best], d[np.arange(len(d)), best]]

    return by_landmarks(rows, landmarks, dist, found, "nearest long, d double", carry=carry)


def voronoi(rows: DataFrame, landmarks: DataFrame, dist: Distances = euclid_block, gamma: float = 1.0) -> DataFrame:
    """Mass of each landmark's cell: the weights (column w) of its rows, to the power gamma, normalised; empty cells have 0."""
    mass = nearest_landmark(rows, landmarks, dist, ("w",)).groupBy("nearest").agg(F.sum("w").alias("m"))
    cells = landmarks.select("id").join(mass.withColumnRenamed("nearest", "id"), "id", "left").withColumn("m", F.pow(F.coalesce("m", F.lit(0.0)), gamma))
    total = cells.agg(F.sum("m").alias("total"))
    return cells.join(F.broadcast(total)).select("id", (F.col("m") / F.col("total")).alias("weight"))


def radius_degree(pairs: DataFrame, cutoff: float, ids: DataFrame) -> DataFrame:
    """Neighbours nearer than ``cutoff`` of every id, 0 where there are none."""
    near = both_ways(pairs.where(F.col("d") < cutoff)).groupBy("i").agg(F.count("*").alias("degree"))
    return ids.select(F.col("id").alias("i")).join(near, "i", "left").select(F.col("i").alias("id"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def farthest_points(df: DataFrame, k: int, start: int | None = None, dist: Metric | None = None, every: int = 4, weight: str | None = None, pinned: tuple[int, ...] = ()) -> DataFrame:
    """(step, id) of k points, each the farthest from those before it; ties go to the lower id.

    ``pinned`` ids are taken first, in their order. ``start`` is the first point otherwise; without both it is the
    point of largest weight. With ``weight``, a column of df, a pick has the largest weight times distance. An empty
    table gives an empty one; fewer rows than k are all taken.

    The least distance so far is a column, cut by ``kept`` each ``every`` picks. Gains only fall, so of Euclidean distances
    the AHEAD rows of largest gain give several picks a job: as long as the best of them is above all rows beyond. These
    meet the rows at once, inside Arrow batches.
    """
    steady = dist is None and weight is None  # a negative weight's gain would rise
    dim = dimension(df)
    dist = dist or (lambda a, b: euclid(a, b, dim))
    spark = df.sparkSession
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    now = df.select("id", "x", w.alias("w"), F.lit(float("inf")).alias("m"), F.lit(False).alias("taken"))
    first = list(pinned) or ([start] if start is not None else [])
    where = {r["id"]: r for r in df.where(F.col("id").isin(first)).collect()} if first else {}
    if missing := [i for i in first if i not in where]:
        raise ValueError(f"no such points: {missing}")
    picks: list[tuple[int, int]] = []

    def take(row) -> None:
        nonlocal now
        picks.append((len(picks), row["id"]))
        # a table of one row, not literals: the generated code is the same for all picks
        at = F.broadcast(spark.createDataFrame([([float(v) for v in row["x"]],)], "_l array<double>"))
        now = now.crossJoin(at).withColumn("m", F.least("m", dist("x", "_l"))).withColumn("taken", F.col("taken") | (F.col("id") == row["id"])).drop("_l")
        if len(picks) % every == 0:
            now = kept(now)

    def take_all(rows: list) -> None:
        nonlocal now
        picks.extend([(len(picks) + n, row["id"]) for n, row in enumerate(rows)])
        now = kept(_nearer(now, [[float(v) for v in row["x"]] for row in rows], [row["id"] for row in rows], dim))

    if steady and first:
        take_all([where[i] for i in first[:k]])
    for i in [] if steady else first[:k]:
        take(where[i])
    while len(picks) < k:
        gain = F.col("w") * F.least("m", F.lit(1e300))  # before any pick all distances are equal
        if steady:
            rows = now.where("not taken").select("id", "x", "w", F.least("m", F.lit(1e300)).alias("m"), gain.alias("g")).orderBy(F.desc("g"), "id").limit(AHEAD + 1).collect()
            if not rows:
                break
            take_all(_ahead(rows, k - len(picks), dim))
            continue
        best = now.where("not taken").agg(F.max_by(F.struct("id", "x"), F.struct(gain, -F.col("id"))).alias("b")).first()["b"]
        if best is None:
            break
        take(best)
    return spark.createDataFrame(picks, "step int, id long")


def _nearer(now: DataFrame, at: list[list[float]], ids: list[int], dim: int) -> DataFrame:
    """(id, x, w, m, taken) with m lowered to the Euclidean distance of the nearest of ``at``, which are the rows ``ids``."""
    places, own = np.array(at, dtype=float).reshape(len(at), dim), np.array(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = batch.column("x")
            off = xs.offsets.to_numpy()
            x = np.asfortranarray(xs.values.to_numpy()[off[0] : off[-1]].reshape(len(xs), dim))
            m = np.array(batch.column("m").to_numpy())
            for p in places:
                total = np.zeros(len(m))
                for c in range(dim):  # one after the other, as the column adds them up
                    total += (x[:, c] - p[c]) ** 2
                np.minimum(m, np.sqrt(total), out=m)
            taken = batch.column("taken").to_numpy(zero_copy_only=False) | np.isin(batch.column("id").to_numpy(), own)
            yield pa.RecordBatch.from_arrays([batch.column("id"), xs, batch.column("w"), pa.array(m), pa.array(taken)], names=["id", "x", "w", "m", "taken"])

    kinds = now.select("id", F.col("x").cast("array<double>").alias("x"), "w", "m", "taken")
    return kinds.mapInArrow(run, kinds.schema)


def _ahead(rows: list, most: int, dim: int) -> list:
    """The picks that follow from the rows of largest gain (falling, then by id); the last of more than AHEAD is the bar."""
    bar = rows[AHEAD]["g"] if len(rows) > AHEAD else -math.inf
    rows = rows[:AHEAD]
    x, w, m = np.array([r["x"] for r in rows], dtype=float).reshape(len(rows), dim), np.array([r["w"] for r in rows]), np.array([r["m"] for r in rows])
    ids, free, picks = np.array([r["id"] for r in rows]), np.ones(len(rows), bool), []
    while len(picks) < most and free.any():
        g = np.where(free, w * m, -np.inf)
        top = np.flatnonzero(g == g.max())
        best = top[ids[top].argmin()]
        if picks and not g[best] > bar:
            break
        picks.append(rows[best])
        free[best] = False
        total = np.zeros(len(rows))
        for c in range(dim):  # one after the other, as the column adds them up
            total += (x[:, c] - x[best, c]) ** 2
        m = np.minimum(m, np.sqrt(total))
    return picks


def random_points(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(ord, id) of k rows drawn by a hash of seed and id, the least hashes first: the same rows at any partitioning."""
    mark = F.xxhash64(F.lit(seed), "id")
    drawn = df.select("id", mark.alias("_h")).orderBy("_h", "id").limit(k)  # the k is the feature
    rank = F.row_number().over(Window.orderBy("_h", "id")) - 1  # over k rows
    return drawn.select(rank.cast("int").alias("ord"), "id")


def staged_points(df: DataFrame, k: int, start: int, seed: int = 0, gamma: float = 1.0) -> DataFrame:
    """(ord, id) of k rows drawn in two stages: a cell of a cover, then a row of the cell.

    The cover is ceil(sqrt(k n)) farthest points from ``start``, between k and LANDMARKS. A cell is drawn with the
    probability of its Voronoi mass to the power ``gamma`` (1: as the rows lie, 0: evenly over space), a row evenly in
    it; without replacement, as the least of exponential marks: each row has mark -ln(u) / p, p its probability,
    with u a hash of seed and id. So the draw is the same at any partitioning, and fewer rows than k are all taken.
    """
    n = df.count()
    cover = max(min(k, n), min(LANDMARKS, n, math.isqrt(max(k * n - 1, 0)) + 1))
    rows = kept(df.select("id", "x"))
    picks = kept(rows.join(F.broadcast(farthest_points(rows, cover, start).select("id")), "id", "left_semi"))
    cells = kept(nearest_landmark(rows, picks))
    size = cells.groupBy("nearest").agg(F.count("*").alias("_n"))  # a row a landmark
    chance = F.pow(F.col("_n"), gamma) / F.col("_n")
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) + 0.5) / float(1 << 53)
    drawn = cells.join(F.broadcast(size), "nearest").select("id", (-F.ln(unit) / chance).alias("_m")).orderBy("_m", "id").limit(k)  # the k is the feature
    rank = F.row_number().over(Window.orderBy("_m", "id")) - 1  # over k rows
    return drawn.select(rank.cast("int").alias("ord"), "id")


def packed(df: DataFrame, picks: DataFrame, dist: Distances = euclid_block) -> DataFrame:
    """(ord, id, x, w) of picked landmarks in their order, with the number of rows nearest to each as w."""
    rows = picks.select(F.col(picks.columns[0]).alias("ord"), "id")
    marks = kept(df.select("id", "x").join(F.broadcast(rows), "id"))
    cells = nearest_landmark(df.select("id", "x"), marks.select("id", "x"), dist).groupBy("nearest").agg(F.count("*").cast("double").alias("w"))
    return marks.join(cells.withColumnRenamed("nearest", "id"), "id", "left").select("ord", "id", "x", F.coalesce("w", F.lit(0.0)).alias("w"))


def to_all_rows(rows: DataFrame, nearest: DataFrame, values: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(id, names): values of landmarks given back to all rows by their nearest landmark (id, nearest)."""
    own = values.select(F.col("id").alias("nearest"), *names)
    return rows.select("id").join(nearest.select("id", "nearest"), "id").join(own, "nearest", "left").select("id", *names)


def stride_points(df: DataFrame, k: int) -> DataFrame:
    """k points at even steps in the order of id."""
    n = df.count()
    step = max(n // max(k, 1), 1)
    # numbers by range: no window over the whole table
    return numbered(df.select("id")).where((F.col("nr") % step == 0) & (F.col("nr") < step * k)).select((F.col("nr") / step).cast("int").alias("ord"), "id")


def select_points(df: DataFrame, mode: str, k: int, start: int | None = None, seed: int = 0, gamma: float = 1.0) -> DataFrame:
    """(ord, id) of k landmarks by ``mode``: ``farthest`` and ``staged`` (from ``start``, else the least id), ``stride`` or ``random``.

    An empty table gives no landmark, fewer rows than k all of them.
    """
    if mode not in ("farthest", "staged", "stride", "random"):
        raise ValueError(f"not a mode: {mode!r}")
    least = df.agg(F.min("id")).first()[0]
    if least is None:
        return df.sparkSession.createDataFrame([], "ord int, id long")
    start = least if start is None else start
    if mode == "farthest":
        return farthest_points(df, k, start).select(F.col("step").alias("ord"), "id")
    if mode == "staged":
        return staged_points(df, k, start, seed, gamma)
    return stride_points(df, k) if mode == "stride" else random_points(df, k, seed)

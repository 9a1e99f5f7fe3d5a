"""Fits that are sums over rows, and the placement of new rows on a fitted map."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartwork.operators.joins import Distances, euclid_block
from chartwork.operators.pairs import LANDMARKS, Metric, by_landmarks, with_landmarks
from chartwork.operators.tables import kept


@dataclass(frozen=True)
class Linear:
    """A centre and unit axes: a projection is a row of dot products."""

    centre: tuple[float, ...]
    axes: tuple[tuple[float, ...], ...]
    variance: tuple[float, ...]

    def columns(self, x: str = "x") -> list[Column]:
        return [sum(((F.get(x, F.lit(k)) - c) * a for k, (c, a) in enumerate(zip(self.centre, axis, strict=True))), F.lit(0.0)) for axis in self.axes]


def covariance(df: DataFrame, dim: int, x: str = "x") -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance of array rows: dim * (dim + 1) / 2 sums, of one row a batch and entry before the shuffle."""
    n, *mean = df.agg(F.count("*"), *[F.avg(F.get(x, F.lit(k))) for k in range(dim)]).first()
    mean = np.array(mean, dtype=float)
    low = np.tril_indices(dim)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                # about the mean, so that large offsets cancel before squaring
                rows = np.stack(batch[x].to_numpy()) - mean
                yield pd.DataFrame({"i": low[0], "j": low[1], "v": (rows.T @ rows)[low]})

    sums = df.select(x).mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    cov = np.zeros((dim, dim))
    for r in sums:
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["v"] / n
    return n, mean, cov


def principal(df: DataFrame, dim: int, k: int, x: str = "x", without: np.ndarray | None = None) -> Linear:
    """Top k axes of the covariance. For Euclidean distances the coordinates are those of classical scaling.

    ``without`` is a unit axis taken out first. Signs: the first component above 1e-12 is positive.
    """
    _, mean, cov = covariance(df, dim, x)
    if without is not None:
        rest = np.eye(dim) - np.outer(without, without)
        cov = rest @ cov @ rest
    values, vectors = np.linalg.eigh(cov)
    axes, var = [], []
    for i in np.argsort(-values)[:k]:
        v = vectors[:, i] if values[i] > 1e-14 else np.zeros(dim)
        first = np.flatnonzero(np.abs(v) > 1e-12)
        axes.append(tuple((v * (np.sign(v[first[0]]) if len(first) else 1)).tolist()))
        var.append(max(float(values[i]), 0.0))
    return Linear(tuple(mean.tolist()), tuple(axes), tuple(var))


def whitened(df: DataFrame, a: list[float], b: list[float], ridge: float = 0.0) -> DataFrame:
    """Rows turned so that Euclidean distance is the pooled within-class Mahalanobis distance.

    A row's class is its nearer reference, a on ties; a class of one row, or of none, has no spread. The pooled
    covariance, divided by the rows less two, comes from one pass of sums a class; only its D x D inverse is
    worked out on the driver.
    """
    dim = len(a)
    to = lambda r: sum((F.pow(F.get("x", F.lit(k)) - float(v), 2) for k, v in enumerate(r)), F.lit(0.0))
    marked = df.withColumn("_a", to(a) <= to(b))
    total, n = np.zeros((dim, dim)), 0
    for side in (True, False):
        k, _, cov = covariance(marked.where(F.col("_a") == side), dim)
        if k:
            total, n = total + cov * k, n + k
    if n < 3:
        raise ValueError("three rows are needed")
    root = np.linalg.cholesky(np.linalg.inv(total / (n - 2) + ridge * np.eye(dim)))
    turned = [sum((F.get("x", F.lit(i)) * float(root[i, k]) for i in range(dim)), F.lit(0.0)) for k in range(dim)]
    return df.select("id", F.array(*turned).alias("x"))


def nearest_rows(df: DataFrame, named: list[float], axes: tuple[str, ...], k: int = 20) -> DataFrame:
    """One row: the mean place of the k rows nearest (L1, then id) to a named vector."""
    d = sum((F.abs(F.get("x", F.lit(i)) - float(v)) for i, v in enumerate(named)), F.lit(0.0))
    best = df.withColumn("_d", d).orderBy("_d", "id").limit(k)  # the k is the feature
    return best.agg(*[F.avg(c).alias(c) for c in axes], F.count("*").alias("n"))


def axis_coordinates(df: DataFrame, a: list[float], b: list[float], k: int = 1) -> DataFrame:
    """s1 = (x - a).u / |b - a| along the axis of two references, then k residual principal coordinates."""
    u = np.array(b, dtype=float) - np.array(a, dtype=float)
    gap = float(np.linalg.norm(u))
    if gap <= 0:
        raise ValueError("the references are the same")
    unit = u / gap
    along = sum(((F.get("x", F.lit(i)) - float(a[i])) * float(v) for i, v in enumerate(unit)), F.lit(0.0)) / gap
    rest = principal(df, len(a), k, without=unit)
    return df.select("id", along.alias("s1"), *[c.alias(f"r{i + 1}") for i, c in enumerate(rest.columns())])


def basin_coordinate(df: DataFrame, a: list[float], b: list[float]) -> DataFrame:
    """(id, xi, well): xi = da / (da + db) from two references, and xi (1 - xi)."""
    da, db = (F.sqrt(sum((F.pow(F.get("x", F.lit(i)) - float(v), 2) for i, v in enumerate(r)), F.lit(0.0))) for r in (a, b))
    xi = F.when(da + db > 0, da / (da + db)).otherwise(0.5)
    return df.select("id", xi.alias("xi")).withColumn("well", F.col("xi") * (1 - F.col("xi")))


def centred(df: DataFrame, axes: tuple[str, ...], weight: str | None = None) -> DataFrame:
    """Coordinates less their weighted mean."""
    w = F.col(weight) if weight else F.lit(1.0)
    mean = df.agg(*[(F.sum(F.col(c) * w) / F.sum(w)).alias(f"_{c}") for c in axes])
    return df.crossJoin(F.broadcast(mean)).select(*[(F.col(c) - F.col(f"_{c}")).alias(c) if c in axes else c for c in df.columns])


def _means(weights: np.ndarray, known: dict[str, np.ndarray], axes: tuple[str, ...]) -> list[np.ndarray]:
    """Weighted means of the landmarks' places, a row each; NaN where all weights are 0."""
    total = weights.sum(axis=1)
    with np.errstate(invalid="ignore"):
        return [weights @ known[c] / total for c in axes]


def _places(rows: DataFrame, landmarks: DataFrame, dist: Distances, weigh: Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray], axes: tuple[str, ...], more: tuple[str, ...] = ()) -> DataFrame:
    return by_landmarks(rows, landmarks, dist, lambda d, known: _means(weigh(d, known), known, axes), ", ".join(f"{c} double" for c in axes), (*axes, *more))


def path_average(rows: DataFrame, landmarks: DataFrame, scale: float, axes: tuple[str, ...], dist: Distances = euclid_block) -> DataFrame:
    """Each row at the mean of its landmarks' places, weighted by exp(-d / scale) times their weight w."""
    # relative to the nearest landmark, so that far rows don't underflow
    weigh = lambda d, known: np.exp(-(d - d.min(axis=1, keepdims=True)) / scale) * known["w"]
    return _places(rows, landmarks, dist, weigh, axes, ("w",))


def knn_average(rows: DataFrame, landmarks: DataFrame, k: int, axes: tuple[str, ...], floor: float = 1e-8, dist: Distances = euclid_block) -> DataFrame:
    """Each row at the mean of its k nearest landmarks' places (ties: the lower ids), weighted by 1 / (d + floor)."""

    def weigh(d: np.ndarray, known: dict[str, np.ndarray]) -> np.ndarray:
        w = np.zeros_like(d)
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        at = np.arange(len(d))[:, None]
        w[at, near] = 1 / (d[at, near] + floor)
        return w

    return _places(rows, landmarks, dist, weigh, axes)


def affinity_average(rows: DataFrame, landmarks: DataFrame, k: int, decay: float, axes: tuple[str, ...], dist: Distances = euclid_block) -> DataFrame:
    """Each row at the mean of all landmarks' places, weighted by exp(-(d / eps)^decay) with eps the k-th distance."""

    def weigh(d: np.ndarray, known: dict[str, np.ndarray]) -> np.ndarray:
        eps = np.maximum(np.partition(d, k - 1, axis=1)[:, k - 1 : k], 1e-12)
        bend = (d / eps) ** decay
        return np.where(bend >= 60, 0.0, np.exp(-bend))

    return _places(rows, landmarks, dist, weigh, axes)


def trilateration(df: DataFrame, da: str, db: str, gap: float) -> DataFrame:
    """Places from distances to two references ``gap`` apart: x along them, y at least 0."""
    x = (F.pow(da, 2) - F.pow(db, 2) + gap * gap) / (2 * gap)
    return df.select("id", x.alias("x"), F.sqrt(F.greatest(F.pow(F.col(da), 2) - x * x, F.lit(0.0))).alias("y"))


#: Candidates whose distances to all landmarks a task holds at a time, and numbers of a piece of rows.
CANDIDATES, NUMBERS = 256, 1 << 21


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a and b, from a matrix product; near pairs from differences."""
    length = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)
    squared = np.maximum(length - 2 * (a @ b.T), 0)
    i, j = np.nonzero(squared <= 1e-4 * length)
    squared[i, j] = ((a[i] - b[j]) ** 2).sum(axis=1)
    return np.sqrt(squared)


@dataclass(frozen=True)
class Placing:
    """A fitted map: places of landmarks, their weights, transfers of either distance, and the grids that are searched."""

    places: np.ndarray
    weights: np.ndarray
    high: Callable[[np.ndarray], np.ndarray]
    low: Callable[[np.ndarray], np.ndarray]
    width: float
    coarse: int
    fine: int
    temperature: float
    path: float

    def grid(self, half: float, n: int) -> np.ndarray:
        line = np.linspace(-half, half, n)
        return np.stack(np.meshgrid(*[line] * self.places.shape[1], indexing="ij"), axis=-1).reshape(-1, self.places.shape[1])

    def costs(self, spots: np.ndarray, f: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Stress of each row (transferred distances f) at blocks of candidate spots, as matrix products."""
        w = self.weights / self.weights.sum()
        own, pull = (f * f * w).sum(axis=1), f * w
        for lo in range(0, len(spots), CANDIDATES):
            known = self.low(_between(spots[lo : lo + CANDIDATES], self.places))
            yield lo, np.maximum(own[:, None] - 2 * (pull @ known.T) + (known * known * w).sum(axis=1), 0)

    def least(self, spots: np.ndarray, f: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        """Moves rows to the first spot of least stress, if it is less than the best so far; both are updated in place."""
        noise = 1e-12 * (f * f).max(axis=1, initial=0)
        for lo, cost in self.costs(spots, f):
            least = cost.min(axis=1)
            first = (cost <= (least + noise)[:, None]).argmax(axis=1)
            better = least < best - noise
            best[better], at[better] = least[better], spots[lo + first[better]]

    def place(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spots, stress and nearest landmark (by index) of rows with distances d to the landmarks."""
        near = d.argmin(axis=1)
        gap = d[np.arange(len(d)), near]
        if self.path > 0:
            w = np.exp(-(d - gap[:, None]) / self.path) * self.weights
            return (w @ self.places) / w.sum(axis=1)[:, None], np.zeros(len(d)), near
        f = self.high(d)
        best, at = np.full(len(d), np.inf), self.places[near].copy()
        self.least(self.places, f, best, at)
        if self.coarse >= 2:
            grid = self.grid(self.width, self.coarse)
            self.least(grid, f, best, at)
            if self.fine >= 2:
                around = self.grid(2 * self.width / (self.coarse - 1), self.fine)
                spots, group = np.unique(at, axis=0, return_inverse=True)
                for g, spot in enumerate(spots):  # rows of one spot search the same cells
                    rows = np.flatnonzero(group.ravel() == g)
                    own, to = best[rows], at[rows]
                    self.least(spot + around, f[rows], own, to)
                    best[rows], at[rows] = own, to
            if self.temperature > 0 and self.places.shape[1] == 2:
                total, moved = np.zeros(len(d)), np.zeros_like(at)
                for lo, cost in self.costs(grid, f):
                    w = np.exp((best[:, None] - cost) / self.temperature)
                    total += w.sum(axis=1)
                    moved += w @ grid[lo : lo + CANDIDATES]
                at = np.where(total[:, None] > 0, moved / np.maximum(total, 1e-300)[:, None], at)
        same = gap <= 1e-14  # the landmark itself
        at[same] = self.places[near[same]]
        w = self.weights / self.weights.sum()
        apart = np.sqrt(((at[:, None, :] - self.places) ** 2).sum(axis=2))
        return at, ((self.low(apart) - f) ** 2 * w).sum(axis=1), near


def place_on_map(
    rows: DataFrame,
    landmarks: DataFrame,
    high,
    low,
    width: float,
    coarse: int = 21,
    fine: int = 41,
    temperature: float = 0.0,
    path: float = 0.0,
    axes: tuple[str, ...] = ("px", "py"),
    distances: bool = False,
) -> DataFrame:
    """(id, x, y, chi, nearest): each row where the stress to the landmarks is least.

    Candidates are the landmarks' own places, then a coarse grid over [-width, width]^2, then a fine one around the best
    so far; ``coarse`` under 2 leaves the grids out. With ``temperature``, the place is the mean of the coarse grid
    weighted by exp(-stress / temperature); with ``path``, that of the landmarks weighted by exp(-d / path), with chi 0.
    A row on a landmark takes its place. On a map of one axis y is null. ``high`` and ``low`` map arrays of distances.

    With ``distances``, a row's x already is its distances to the landmarks by ascending id. Landmarks (id, x array, px,
    py, w) are at most LANDMARKS; rows are placed in Arrow batches, a bounded piece at a time. The first of equal
    candidates is taken. An empty table gives an empty one.
    """
    got = landmarks.orderBy("id").limit(LANDMARKS + 1).toPandas()
    if not 0 < len(got) <= LANDMARKS:
        raise ValueError(f"{len(got)} landmarks; from 1 to {LANDMARKS} can be placed on")
    tables = (got["id"].to_numpy(), None if distances else np.stack(got["x"].to_numpy()), got[list(axes)].to_numpy(dtype=float), got["w"].to_numpy(dtype=float))
    shared = rows.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, marks, places, weights = shared.value
        placing = Placing(places, weights, high, low, width, coarse, fine, temperature, path)
        step = max(1, NUMBERS // (len(ids) * placing.places.shape[1] + CANDIDATES))
        for batch in batches:
            for lo in range(0, len(batch), step):
                part = batch.iloc[lo : lo + step]
                x = np.stack(part["x"].to_numpy()).astype(float)
                at, chi, near = placing.place(x if marks is None else _between(x, marks))
                yield pd.DataFrame({"id": part["id"].to_numpy(), "x": at[:, 0], "y": at[:, 1] if at.shape[1] > 1 else None, "chi": chi, "nearest": ids[near]})

    return rows.select("id", "x").mapInPandas(run, "id long, x double, y double, chi double, nearest long")


def landmark_scaling(rows: DataFrame, landmarks: DataFrame, dist: Metric, k: int) -> DataFrame:
    """(id, y): rows on the classical-scaling map of a bounded landmark table, from their squared distances to it.

    The landmarks' doubly centred squared distances are solved on the driver; a row's place is linear in its squared
    distances less the landmarks' means (Gower's formula). Axes without variance give 0.
    """
    met = kept(with_landmarks(landmarks.select("id", "x"), landmarks.select("id", "x"), dist).select("id", "l_id", (F.col("d") * F.col("d")).alias("s")))
    table = met.toPandas().pivot(index="id", columns="l_id", values="s").sort_index().sort_index(axis=1)  # at most LANDMARKS^2
    s = table.to_numpy()
    mean = s.mean(axis=1)
    values, vectors = np.linalg.eigh(-0.5 * (s - mean[:, None] - mean + s.mean()))
    order = np.argsort(-values)[:k]
    axes = np.where(values[order] > 1e-12, vectors[:, order] / np.sqrt(np.maximum(values[order], 1e-300)), 0.0)
    pull = [(int(i), float(m), [float(v) for v in a]) for i, m, a in zip(table.index, mean, axes, strict=True)]
    known = rows.sparkSession.createDataFrame(pull, "l_id long, m double, a array<double>")
    near = with_landmarks(rows.select("id", "x"), landmarks.select("id", "x"), dist).join(F.broadcast(known), "l_id")
    term = [F.sum(-0.5 * (F.col("d") * F.col("d") - F.col("m")) * F.get("a", F.lit(c))).alias(f"y{c}") for c in range(len(order))]
    return near.groupBy("id").agg(*term).select("id", F.array(*[f"y{c}" for c in range(len(order))]).alias("y"))


def procrustes(df: DataFrame, a: tuple[str, ...], b: tuple[str, ...]) -> DataFrame:
    """One row: scale and residual of the best similarity that takes the places ``b`` to the places ``a``.

    From one pass of sums; the residual is the part of a's spread that is left. No spread in either gives residual 1.
    """
    names = [*a, *b]
    moments = [F.covar_pop(p, q).alias(f"c_{i}_{j}") for i, p in enumerate(a) for j, q in enumerate(b)]
    sums = df.agg(*[F.var_pop(c).alias(f"v_{i}") for i, c in enumerate(names)], *moments).first()
    va, vb = (sum(sums[f"v_{i + off}"] or 0.0 for i in range(len(a))) for off in (0, len(a)))
    cross = np.array([[sums[f"c_{i}_{j}"] or 0.0 for j in range(len(b))] for i in range(len(a))])
    fit = float(np.linalg.svd(cross, compute_uv=False).sum())
    got = (fit / vb, 1 - fit * fit / (va * vb)) if va > 0 and vb > 0 else (0.0, 1.0)
    return df.sparkSession.createDataFrame([got], "scale double, residual double")

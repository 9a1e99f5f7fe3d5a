"""Fingerprints and distances of structures, each a frame of atoms (frame, atom, x, y, z)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartwork.operators.joins import near_in_space


def frame_pairs(atoms: DataFrame) -> DataFrame:
    """(frame, a, b, d) of the atom pairs b < a of each frame: an equi-join on the frame."""
    a = atoms.select("frame", F.col("atom").alias("a"), *[F.col(c).alias(f"{c}1") for c in "xyz"])
    b = atoms.select("frame", F.col("atom").alias("b"), *[F.col(c).alias(f"{c}2") for c in "xyz"])
    d = F.sqrt(sum((F.pow(F.col(f"{c}1") - F.col(f"{c}2"), 2) for c in "xyz"), F.lit(0.0)))
    return a.join(b, "frame").where("b < a").select("frame", "a", "b", d.alias("d"))


def switching(d: Column, far: float = 1.5, near: float = 1.25) -> Column:
    """1 up to ``near``, 0 from ``far`` on, and the cubic step of flat ends between."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (d - near) / (far - near)))
    return 1 - t * t * (3 - 2 * t)


def smooth_coordination(atoms: DataFrame, far: float = 1.5, near: float = 1.25) -> DataFrame:
    """(frame, atom, cn): sums of the switching function over the other atoms."""
    pairs = near_in_space(atoms, far, by=("frame",), name="atom").select("frame", F.col("a").alias("atom"), switching(F.col("d"), far, near).alias("s"))
    sums = pairs.groupBy("frame", "atom").agg(F.sum("s").alias("cn"))
    return atoms.select("frame", "atom").join(sums, ["frame", "atom"], "left").select("frame", "atom", F.coalesce("cn", F.lit(0.0)).alias("cn"))


def coordination_vector(atoms: DataFrame, low: int = 4, high: int = 13, sigma: float = 0.5, far: float = 1.5, near: float = 1.25) -> DataFrame:
    """(frame, n<low> ... n<high>): Gaussian counts of atoms by smooth coordination."""
    cn = smooth_coordination(atoms, far, near)
    return cn.groupBy("frame").agg(*[F.sum(F.exp(-0.5 * F.pow((F.col("cn") - c) / sigma, 2))).alias(f"n{c}") for c in range(low, high + 1)])


def sorted_distances(atoms: DataFrame) -> DataFrame:
    """(frame, x): the ascending distances of a frame's atom pairs, none for a single atom."""
    got = frame_pairs(atoms).groupBy("frame").agg(F.array_sort(F.collect_list("d")).alias("x"))
    return _every_frame(atoms, got).select("frame", F.coalesce("x", F.array().cast("array<double>")).alias("x"))


def _every_frame(atoms: DataFrame, got: DataFrame) -> DataFrame:
    """``got`` with a row of nulls for each frame that it lacks."""
    return atoms.select("frame").distinct().join(got, "frame", "left")


def lennard_jones(atoms: DataFrame) -> DataFrame:
    """(frame, e): 4 * sum(d^-12 - d^-6) in reduced units; pairs at distance 0 are an error of the input and give null, a single atom 0."""
    r6 = F.when(F.col("d") > 0, F.pow(F.col("d"), -6))
    got = frame_pairs(atoms).groupBy("frame").agg((F.count_if(F.col("d") <= 0) == 0).alias("_ok"), F.sum(4 * (r6 * r6 - r6)).alias("e"))
    return _every_frame(atoms, got).select("frame", F.when(F.col("_ok").isNull(), 0.0).when(F.col("_ok"), F.col("e")).alias("e"))


def positions(atoms: DataFrame) -> DataFrame:
    """(frame, xyz): flat coordinates in the order of atoms."""
    rows = atoms.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("atom", "x", "y", "z"))).alias("p"))
    return rows.select("frame", F.flatten(F.transform("p", lambda v: F.array(v["x"], v["y"], v["z"]))).alias("xyz"))


def unflattened(frames: DataFrame) -> DataFrame:
    """Atoms of flat coordinates, numbered from 0."""
    part = lambda k, c: F.element_at("xyz", (3 * F.col("atom") + k).cast("int")).alias(c)
    rows = frames.select("frame", "xyz", F.explode(F.sequence(F.lit(0), (F.size("xyz") / 3 - 1).cast("int"))).alias("atom"))
    return rows.select("frame", F.col("atom").cast("long").alias("atom"), part(1, "x"), part(2, "y"), part(3, "z"))


#: Numbers of the frames that one task works on at a time.
_ENTRIES = 1 << 19


def _spectra(atoms: DataFrame, spectrum: Callable[[np.ndarray], np.ndarray], numbers: Callable[[int], int]) -> DataFrame:
    """(frame, x): what ``spectrum`` makes of the positions (frames, n, 3) of frames of equally many atoms, by frame (frames, n).

    So many frames are taken together that they come to _ENTRIES numbers, one at least: ``numbers`` tells those of a
    frame of n atoms. A frame whose spectrum isn't finite has none: null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = batch.column("xyz").offsets.to_numpy(), batch.column("xyz").values.to_numpy(zero_copy_only=False)
            size = np.diff(at) // 3
            for n in np.unique(size).tolist():
                rows = np.flatnonzero(size == n)
                step = max(1, _ENTRIES // max(1, numbers(n)))
                for lo in range(0, len(rows), step):
                    part = rows[lo : lo + step]
                    found = spectrum(values[at[part][:, None] + np.arange(3 * n)].reshape(len(part), n, 3).astype(float, copy=False))
                    good = np.isfinite(found).all(axis=1)
                    x = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(good * n)).astype(np.int32)), pa.array(found[good].ravel()), mask=pa.array(~good))
                    yield pa.RecordBatch.from_arrays([batch.column("frame").take(pa.array(part)), x], names=["frame", "x"])

    return positions(atoms).mapInArrow(run, "frame long, x array<double>")


def coulomb_spectrum(atoms: DataFrame, diagonal: float = 0.0) -> DataFrame:
    """(frame, x): descending eigenvalues of the matrix of inverse distances; null where two atoms are in one place."""

    def inverse(p: np.ndarray) -> np.ndarray:
        squares = (p * p).sum(axis=2)
        lengths = squares[:, :, None] + squares[:, None, :]
        gaps = np.maximum(lengths - 2 * p @ p.transpose(0, 2, 1), 0)
        # the product cancels for near atoms: those are worked out from differences
        f, i, j = np.nonzero(gaps <= 1e-4 * lengths)
        gaps[f, i, j] = ((p[f, i] - p[f, j]) ** 2).sum(axis=1)
        own = np.eye(p.shape[1], dtype=bool)
        with np.errstate(divide="ignore"):
            m = np.where(own, diagonal, gaps ** -0.5)
        good = np.isfinite(m).all(axis=(1, 2))
        found = np.full(squares.shape, np.nan)
        found[good] = np.linalg.eigvalsh(m[good])[:, ::-1]
        return found

    return _spectra(atoms, inverse, lambda n: n * n)


def squared_distance_spectrum(atoms: DataFrame) -> DataFrame:
    """(frame, x): descending eigenvalues of the matrix of squared distances.

    The matrix is U C U^T of the five columns U = (1, squared length, x, y, z) of the centred atoms, so with U = Q R those of
    R C R^T are its eigenvalues, and all others are 0: work and memory are linear in the atoms.
    """
    c = np.zeros((5, 5))
    c[0, 1] = c[1, 0] = 1.0
    c[2, 2] = c[3, 3] = c[4, 4] = -2.0

    def small(p: np.ndarray) -> np.ndarray:
        n = p.shape[1]
        found = np.zeros((len(p), n))
        with np.errstate(over="ignore", invalid="ignore"):
            p = p - p.mean(axis=1, keepdims=True)
            scale = np.maximum(np.abs(p).max(axis=(1, 2)), 1e-300)
            good = np.isfinite(12 * scale * scale)
        found[~good] = np.nan
        if good.any():
            u = np.ones((int(good.sum()), n, 5))
            u[:, :, 2:] = p[good] / scale[good, None, None]
            u[:, :, 1] = (u[:, :, 2:] ** 2).sum(axis=2)
            r = np.linalg.qr(u, mode="r")
            m = r @ c @ r.transpose(0, 2, 1)
            values = np.linalg.eigvalsh((m + m.transpose(0, 2, 1)) / 2) * (scale[good] ** 2)[:, None]
            found[good, : values.shape[1]] = values
        return -np.sort(-found, axis=1)

    return _spectra(atoms, small, lambda n: 8 * n)


def _covariances(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of equally many atoms together: rows, both sets of centred positions, and their 3 x 3 covariances."""
    for n, rows in batch.groupby(batch["xi"].map(len) // 3):
        step = max(1, _ENTRIES // max(1, 6 * n))
        for lo in range(0, len(rows), step):
            part = rows.iloc[lo : lo + step]
            p, q = (np.stack(part[c].to_numpy()).astype(float).reshape(len(part), n, 3) for c in ("xi", "xj"))
            p, q = p - p.mean(axis=1, keepdims=True), q - q.mean(axis=1, keepdims=True)
            yield part, p, q, p.transpose(0, 2, 1) @ q


def aligned_rmsd(pairs: DataFrame) -> DataFrame:
    """(i, j, rmsd) of pairs of flat coordinates xi and xj of equally many atoms, after centring and the best proper rotation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, p, q, m in _covariances(batch):
                s = np.linalg.svd(m, compute_uv=False)
                s[:, 2] *= np.where(np.linalg.det(m) < 0, -1.0, 1.0)
                left = (p * p).sum(axis=(1, 2)) + (q * q).sum(axis=(1, 2)) - 2 * s.sum(axis=1)
                yield pd.DataFrame({"i": part["i"], "j": part["j"], "rmsd": np.sqrt(np.maximum(left, 0) / p.shape[1])})

    return pairs.select("i", "j", "xi", "xj").mapInPandas(run, "i long, j long, rmsd double")


def unique_rows(df: DataFrame, x: str, digits: int, value: str) -> DataFrame:
    """(site, id, value, members): rows whose rounded arrays agree, each by the row of lowest value (then id)."""
    site = F.transform(x, lambda v: F.round(v, digits) + 0.0)
    return df.groupBy(site.alias("site")).agg(F.min(F.struct(F.col(value).alias("v"), F.col("id").alias("id"))).alias("m"), F.count("*").alias("members")).select("site", F.col("m.id").alias("id"), F.col("m.v").alias("value"), "members")


def _tensor_norm(k: int) -> Column:
    """Sum over all pairs of bonds of (u . v)^k, from the moments of the bonds: those of x^a y^b z^c with a + b + c = k."""
    parts = []
    for a in range(k + 1):
        for b in range(k + 1 - a):
            c = k - a - b
            times = math.factorial(k) // (math.factorial(a) * math.factorial(b) * math.factorial(c))
            parts.append(times * F.pow(F.sum(F.pow("ux", a) * F.pow("uy", b) * F.pow("uz", c)), 2))
    return sum(parts[1:], parts[0])


def bonds(atoms: DataFrame, cutoff: float) -> DataFrame:
    """(frame, atom, ux, uy, uz): unit vectors from each atom to its neighbours nearer than ``cutoff``, not in its own place."""
    met = near_in_space(atoms, cutoff, by=("frame",), name="atom").where("d > 0")
    return met.select("frame", F.col("a").alias("atom"), *[(F.get("step", F.lit(k)) / F.col("d")).alias(f"u{c}") for k, c in enumerate("xyz")])


def bond_order(atoms: DataFrame, cutoff: float, by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """(by, n, q4, q6): bond-orientation order of a frame, or of an atom with by = (frame, atom).

    A frame or atom without bonds has n = 0 and nulls. By the addition theorem, q_l^2 is the mean of the Legendre polynomial P_l over all pairs of bonds; its powers are
    sums of squared moments, so the work is linear in bonds.
    """
    n = F.count("*").cast("double")
    m2, m4, m6 = (_tensor_norm(k) for k in (2, 4, 6))
    sums = bonds(atoms, cutoff).groupBy(*by).agg(F.count("*").alias("n"), ((35 * m4 - 30 * m2 + 3 * n * n) / 8 / (n * n)).alias("s4"), ((231 * m6 - 315 * m4 + 105 * m2 - 5 * n * n) / 16 / (n * n)).alias("s6"))
    every = atoms.select(*by).distinct().join(sums, list(by), "left")
    root = lambda k: F.when(F.col(f"s{k}").isNotNull(), F.sqrt(F.greatest(F.col(f"s{k}"), F.lit(0.0)))).alias(f"q{k}")
    return every.select(*by, F.coalesce("n", F.lit(0)).cast("long").alias("n"), root(4), root(6))


def radial_density(atoms: DataFrame, centres: list[float], sigma: float) -> DataFrame:
    """(frame, atom, x): for each atom the Gaussian counts of the others by distance, at the given centres; 0 for a single atom."""
    both = frame_pairs(atoms).select("frame", F.explode(F.array("a", "b")).alias("atom"), "d")
    at = [F.sum(F.exp(-0.5 * F.pow((F.col("d") - c) / sigma, 2))).alias(f"r{k}") for k, c in enumerate(centres)]
    got = both.groupBy("frame", "atom").agg(*at)
    every = atoms.select("frame", "atom").join(got, ["frame", "atom"], "left")
    return every.select("frame", "atom", F.array(*[F.coalesce(f"r{k}", F.lit(0.0)) for k in range(len(centres))]).alias("x"))


def mean_and_spread(parts: DataFrame, dim: int) -> DataFrame:
    """(frame, x): means and then population spreads, over a frame's atoms, of the arrays x."""
    items = [F.get("x", F.lit(k)) for k in range(dim)]
    got = parts.groupBy("frame").agg(*[F.avg(v).alias(f"m{k}") for k, v in enumerate(items)], *[F.stddev_pop(v).alias(f"s{k}") for k, v in enumerate(items)])
    return got.select("frame", F.array(*[f"m{k}" for k in range(dim)], *[f"s{k}" for k in range(dim)]).alias("x"))


def best_rotation(pairs: DataFrame) -> DataFrame:
    """(i, j, r): the proper rotation, row by row, that takes the centred xi nearest to the centred xj."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, _, _, m in _covariances(batch):
                u, _, v = np.linalg.svd(m)
                flip = np.tile(np.eye(3), (len(part), 1, 1))
                flip[:, 2, 2] = np.where(np.linalg.det(u @ v) < 0, -1.0, 1.0)
                r = v.transpose(0, 2, 1) @ flip @ u.transpose(0, 2, 1)
                yield pd.DataFrame({"i": part["i"], "j": part["j"], "r": list(r.reshape(len(part), 9))})

    return pairs.select("i", "j", "xi", "xj").mapInPandas(run, "i long, j long, r array<double>")


def committor_plane(distances: DataFrame, da: str, db: str) -> DataFrame:
    """(id, q, r): da / (da + db), 1/2 where both are 0, and da + db."""
    total = F.col(da) + F.col(db)
    return distances.select("id", F.when(total > 0, F.col(da) / total).otherwise(0.5).alias("q"), total.alias("r"))


def check_frames(frames: DataFrame) -> DataFrame:
    """``frames`` (frame, sym, pos), an error on reading a row if it isn't whole.

    A frame needs an id, as many positions as symbols, at least one, each of three finite numbers.
    """
    whole = F.coalesce(
        F.col("frame").isNotNull() & (F.size("sym") > 0) & (F.size("sym") == F.size("pos")) & F.forall("pos", lambda p: (F.size(p) == 3) & F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))),
        F.lit(False),
    )
    return frames.withColumn("frame", F.when(whole, F.col("frame")).otherwise(F.raise_error(F.concat(F.lit("not a whole frame: "), F.coalesce(F.col("frame").cast("string"), F.lit("null"))))))

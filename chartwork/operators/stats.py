"""Scales, stress and histograms over pairs and points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartwork.functions.transfers import Transfer
from chartwork.operators.joins import near_in_space
from chartwork.operators.pairs import both_ways, nearest_neighbours, with_landmarks
from chartwork.operators.tables import kept, numbered


# ---------------------------------------------------------------- scales


def ranked(pairs: DataFrame) -> DataFrame:
    """Positive finite distances with their rank ``r`` from 0 and their number ``n``."""
    good = pairs.where((F.col("d") > 0) & (F.col("d") < float("inf")))
    r = numbered(good.select("d"), "d", "r")
    n = r.count()
    if n < 3:
        raise ValueError("at least three positive distances are needed")
    return r.withColumn("n", F.lit(n).cast("long"))


def suggest_scale(pairs: DataFrame) -> DataFrame:
    """One row: q25, q50, q75 as order statistics floor(n q) from 0, and the knee of the distribution."""
    r = ranked(pairs)
    at = lambda num, den: F.max(F.when(F.col("r") == F.floor(F.col("n") * num / den), F.col("d")))
    q = r.agg(at(25, 100).alias("q25"), at(1, 2).alias("q50"), at(75, 100).alias("q75"))
    return q.crossJoin(F.broadcast(cdf_knee(r)))  # one row each


def cdf_knee(r: DataFrame) -> DataFrame:
    """The distance at which the distribution is farthest from the line between its ends; the first of equals."""
    ends = r.agg(F.min("d").alias("d0"), F.max("d").alias("d1"))
    gone = F.abs((F.col("r") + 1) / F.col("n") - (F.col("d") - F.col("d0")) / (F.col("d1") - F.col("d0")))
    return r.crossJoin(F.broadcast(ends)).agg(F.max_by("d", F.struct(gone, -F.col("r"))).alias("knee"))


# ---------------------------------------------------------------- stress


def chi(pairs: DataFrame, high: Transfer, low: Transfer, mix: float = 0.0, weight: Column | None = None) -> DataFrame:
    """One row: the weighted mean of (1 - mix) (F(D) - f(d))^2 + mix (D - d)^2; ``pairs`` has dh and dl."""
    w = weight if weight is not None else F.lit(1.0)
    miss = F.pow(high.column("dh") - low.column("dl"), 2) * (1 - mix) + F.pow(F.col("dh") - F.col("dl"), 2) * mix
    total = F.sum(w)
    return pairs.agg((F.sum(w * miss) / F.when(total > 0, total).otherwise(1.0)).alias("chi"))


def midscale_weight(high: Transfer) -> Column:
    f = high.column("dh")
    return F.greatest(f * (1 - f), F.lit(0.0))


def gap_weight(a: str, b: str, tau: float) -> Column:
    return F.when(F.abs(F.col(a) - F.col(b)) <= tau, 1.0).otherwise(0.0)


def _push(high: Transfer, low: Transfer, mix: float) -> Column:
    """Derivative of a pair's stress by its low distance, over that distance."""
    bent = (high.column("dh") - low.column("dl")) * low.slope("dl") * (1 - mix)
    return -2 * (bent + (F.col("dh") - F.col("dl")) * mix) / F.greatest("dl", F.lit(1e-100))


def point_weights(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """``pairs`` with w = the product of the weights (id, w) of both ends."""
    wi, wj = (weights.select(F.col("id").alias(x), F.col("w").cast("double").alias(f"_{x}")) for x in "ij")
    return pairs.join(wi, "i").join(wj, "j").withColumn("w", F.col("_i") * F.col("_j")).drop("_i", "_j")


def chi_by_point(pairs: DataFrame, high: Transfer, low: Transfer, mix: float = 0.0) -> DataFrame:
    """(id, chi): the stress of each point against all others."""
    miss = F.pow(high.column("dh") - low.column("dl"), 2) * (1 - mix) + F.pow(F.col("dh") - F.col("dl"), 2) * mix
    ends = pairs.select(F.explode(F.array("i", "j")).alias("id"), miss.alias("m"))
    return ends.groupBy("id").agg(F.avg("m").alias("chi"))


def query_chi(rows: DataFrame, landmarks: DataFrame, dist, high: Transfer, low: Transfer, mix: float = 0.0) -> DataFrame:
    """(id, chi, gx, gy) of rows (id, x, px, py) against landmarks (id, x, px, py, w), a bounded table.

    A landmark in the row's own place counts in the value and the weight but gives no gradient.
    """
    met = with_landmarks(rows, landmarks, dist).withColumnRenamed("d", "dh")
    dx, dy = F.col("px") - F.col("l_px"), F.col("py") - F.col("l_py")
    met = met.withColumn("dl", F.sqrt(dx * dx + dy * dy))
    miss = F.pow(high.column("dh") - low.column("dl"), 2) * (1 - mix) + F.pow(F.col("dh") - F.col("dl"), 2) * mix
    push = F.when(F.col("dl") > 0, _push(high, low, mix)).otherwise(0.0)
    total = F.when(F.sum("l_w") > 0, F.sum("l_w")).otherwise(1.0)
    return met.groupBy("id").agg(*[(F.sum(F.col("l_w") * v) / total).alias(n) for n, v in (("chi", miss), ("gx", push * dx), ("gy", push * dy))])


def stress_ratio(pairs: DataFrame, transfer: Transfer) -> DataFrame:
    """One row: the sum of (F(dh) - F(dl))^2 over the sum of F(dh)^2; null if the latter is 0."""
    f = transfer.column("dh")
    total = F.sum(f * f)
    return pairs.agg((F.sum(F.pow(f - transfer.column("dl"), 2)) / F.when(total > 0, total)).alias("ratio"))


def median_scaled(pairs: DataFrame) -> DataFrame:
    """``pairs`` with t = asinh(d / median of the positive d)."""
    middle = pairs.where("d > 0").agg(F.percentile("d", F.lit(0.5)).alias("_m"))
    return pairs.crossJoin(F.broadcast(middle)).withColumn("t", F.asinh(F.col("d") / F.col("_m"))).drop("_m")  # one row


def two_scale_targets(pairs: DataFrame, k: int) -> DataFrame:
    """(i, j, d, near, t) with sigma the median of the positive d: t is d / sigma for pairs of which either end has the
    other among its k nearest, asinh(d / sigma) for the others."""
    pairs = kept(pairs.select("i", "j", "d"))
    near = nearest_neighbours(pairs, k).select(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"), F.lit(True).alias("near")).distinct()
    middle = pairs.where("d > 0").agg(F.greatest(F.coalesce(F.percentile("d", F.lit(0.5)), F.lit(1.0)), F.lit(1e-12)).alias("_m"))
    both = pairs.join(near, ["i", "j"], "left").crossJoin(F.broadcast(middle))  # one row
    unit = F.col("d") / F.col("_m")
    return both.select("i", "j", "d", F.coalesce("near", F.lit(False)).alias("near"), F.when(F.col("near"), unit).otherwise(F.asinh(unit)).alias("t"))


def chi_gradient(pairs: DataFrame, mix: float = 0.0, high: Transfer | None = None, low: Transfer | None = None, weight: str | None = None) -> DataFrame:
    """(id, gx, gy) of the stress: each pair pushes its two ends apart; ``pairs`` has i, j, dh, dl, xi, yi, xj, yj.

    Identity transfers are the default; ``weight`` names a column of pair weights.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    push = _push(high or Transfer("identity"), low or Transfer("identity"), mix) * w
    dx, dy = F.col("xi") - F.col("xj"), F.col("yi") - F.col("yj")
    ends = F.array(F.struct(F.col("i").alias("id"), (push * dx).alias("gx"), (push * dy).alias("gy")), F.struct(F.col("j").alias("id"), (-push * dx).alias("gx"), (-push * dy).alias("gy")))
    n = pairs.agg(F.when(F.sum(w) > 0, F.sum(w)).otherwise(1.0).alias("n"))
    sums = pairs.select(F.explode(ends).alias("e")).groupBy("e.id").agg(F.sum("e.gx").alias("gx"), F.sum("e.gy").alias("gy"))
    return sums.crossJoin(F.broadcast(n)).select("id", (F.col("gx") / F.col("n")).alias("gx"), (F.col("gy") / F.col("n")).alias("gy"))


# ---------------------------------------------------------------- histograms and free energy


def bin_of(x: str, lo: float, hi: float, n: int) -> Column:
    """Bin of a value in [lo, hi), half open; null outside."""
    return F.when((F.col(x) >= lo) & (F.col(x) < hi), F.least(F.floor((F.col(x) - lo) / (hi - lo) * n), F.lit(n - 1)).cast("int"))


def histogram(df: DataFrame, x: str, lo: float, hi: float, n: int, weight: str | None = None) -> DataFrame:
    """(bin, count) of all bins, with -1 for what is below and n for what is above: samples are the sum of all rows."""
    w = F.col(weight) if weight else F.lit(1.0)
    slot = F.when(F.col(x) < lo, -1).when(F.col(x) >= hi, n).otherwise(bin_of(x, lo, hi, n))
    got = df.groupBy(slot.cast("int").alias("bin")).agg(F.sum(w).alias("count"))
    every = df.sparkSession.range(-1, n + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").select("bin", F.coalesce("count", F.lit(0.0)).cast("double").alias("count"))


def histogram2d(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float], nx: int, ny: int, weight: str | None = None) -> DataFrame:
    """(iy, ix, count) of all cells of the box (x0, x1, y0, y1); rows outside are left out."""
    w = F.col(weight) if weight else F.lit(1.0)
    x0, x1, y0, y1 = box
    cells = df.select(bin_of(y, y0, y1, ny).alias("iy"), bin_of(x, x0, x1, nx).alias("ix"), w.alias("_w")).where("iy is not null and ix is not null")
    got = cells.groupBy("iy", "ix").agg(F.sum("_w").alias("count"))
    every = df.sparkSession.range(nx * ny).select((F.col("id") / nx).cast("int").alias("iy"), (F.col("id") % nx).cast("int").alias("ix"))
    return every.join(got, ["iy", "ix"], "left").select("iy", "ix", F.coalesce("count", F.lit(0.0)).cast("double").alias("count"))


def free_energy(hist: DataFrame, box: tuple[float, float, float, float], nx: int, ny: int, kt: float = 1.0, samples: float | None = None) -> DataFrame:
    """(iy, ix, x, y, f, rho) of a 2-D histogram: f = -kT ln(rho / max rho), null in empty cells.

    ``samples`` is the mass before any blur, the histogram's own if not given.
    """
    x0, x1, y0, y1 = box
    area = (x1 - x0) / nx * (y1 - y0) / ny
    tops = hist.agg(F.max("count").alias("top"), F.sum("count").alias("all"))
    mass = F.lit(samples) if samples is not None else F.col("all")
    rho = F.when(mass > 0, F.col("count") / (mass * area)).otherwise(0.0)
    f = F.when(F.col("count") > 0, -kt * F.ln(F.col("count") / F.col("top")) + 0.0)
    centre = lambda i, lo, hi, n: F.lit(lo) + (F.col(i) + 0.5) * ((hi - lo) / n)
    return hist.crossJoin(F.broadcast(tops)).select("iy", "ix", centre("ix", x0, x1, nx).alias("x"), centre("iy", y0, y1, ny).alias("y"), f.alias("f"), rho.alias("rho"))


def padded_box(df: DataFrame, x: str, y: str, pad: float = 0.05) -> tuple[float, float, float, float]:
    """Bounds of the points, wider by ``pad`` of their span; a span of zero counts as one, no points as one at 0."""
    x0, x1, y0, y1 = (v or 0.0 for v in df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first())
    sx, sy = (x1 - x0) or 1.0, (y1 - y0) or 1.0
    return x0 - pad * sx, x1 + pad * sx, y0 - pad * sy, y1 + pad * sy


def joint_histogram(pairs: DataFrame, n: int, top_high: float, top_low: float, weight: str | None = None) -> DataFrame:
    """(ih, il, count) of pairs by both distances; pairs at or beyond either ceiling are in the row of nulls.

    With ``weight``, a column of pair weights, counts are sums of it.
    """
    slot = lambda c, top: F.floor(F.col(c) / top * n).cast("int")
    inside = (F.col("dh") < top_high) & (F.col("dl") < top_low)
    return pairs.groupBy(F.when(inside, slot("dh", top_high)).alias("ih"), F.when(inside, slot("dl", top_low)).alias("il")).agg((F.sum(weight) if weight else F.count("*")).alias("count"))


def outlier_fraction(joint: DataFrame) -> DataFrame:
    """One row: the part of a joint histogram's mass that lies beyond its ceilings; 0 of an empty one."""
    out = F.coalesce(F.sum(F.when(F.col("ih").isNull(), F.col("count"))), F.lit(0)) / F.sum("count")
    return joint.agg(F.coalesce(out, F.lit(0.0)).alias("fraction"))


def clipped(surface: DataFrame, top: float, value: str = "f") -> DataFrame:
    """Free energies kept inside [0, top]; empty cells stay null."""
    return surface.withColumn(value, F.when(F.col(value).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(top), F.col(value)))))


def boltzmann_surface(df: DataFrame, x: str, y: str, energy: str, box: tuple[float, float, float, float], nx: int, ny: int, kt: float, sigma: float = 0.0) -> DataFrame:
    """Free energy of a histogram in which a row counts exp(-(E - least E) / kT), blurred by ``sigma`` cells if positive."""
    least = df.agg(F.min(energy).alias("_e0"))
    weighed = df.crossJoin(F.broadcast(least)).withColumn("_w", F.exp(-(F.col(energy) - F.col("_e0")) / kt))  # one row
    hist = histogram2d(weighed, x, y, box, nx, ny, "_w")
    return free_energy(blurred(hist, sigma) if sigma > 0 else hist, box, nx, ny, kt)


def mean_field(df: DataFrame, x: str, y: str, value: str, box: tuple[float, float, float, float], nx: int, ny: int, sigma: float, floor: float = 1e-12) -> DataFrame:
    """(iy, ix, mean): the blurred sum of a value over the blurred count, clipped to [0, 1]; null where the count is below ``floor``."""
    sums = blurred(histogram2d(df, x, y, box, nx, ny, value), sigma).withColumnRenamed("count", "s")
    both = sums.join(blurred(histogram2d(df, x, y, box, nx, ny), sigma), ["iy", "ix"])
    mean = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s") / F.col("count")))
    return both.select("iy", "ix", F.when(F.col("count") >= floor, mean).alias("mean"))


def sampled(points: DataFrame, field: DataFrame, x: str, y: str, box: tuple[float, float, float, float], nx: int, ny: int, value: str = "f") -> DataFrame:
    """``points`` with the field's value in the cell of each; null outside of the box."""
    x0, x1, y0, y1 = box
    placed = points.withColumn("iy", bin_of(y, y0, y1, ny)).withColumn("ix", bin_of(x, x0, x1, nx))
    return placed.join(field.select("iy", "ix", value), ["iy", "ix"], "left").drop("iy", "ix")


def z_scores(df: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """Columns less their mean over their population spread; a column without spread becomes 0.

    A plain sum over many rows is off in the digits that are rounded, so means are taken twice, of what the first leaves.
    """
    first = df.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"_m{k}") for k, c in enumerate(axes)])
    near = df.crossJoin(F.broadcast(first))  # one row
    left = {c: F.col(c) - F.col(f"_m{k}") for k, c in enumerate(axes)}
    known = near.agg(*[F.avg(v).alias(f"_l{k}") for k, v in enumerate(left.values())], *[F.stddev_pop(v).alias(f"_s{k}") for k, v in enumerate(left.values())])
    scaled = {c: F.when(F.col(f"_s{k}") > 0, (left[c] - F.col(f"_l{k}")) / F.col(f"_s{k}")).otherwise(F.when(F.col(c).isNotNull(), 0.0)) for k, c in enumerate(axes)}
    return near.crossJoin(F.broadcast(known)).select(*[scaled[c].alias(c) if c in scaled else c for c in df.columns])  # one row


def block_scaled(df: DataFrame, blocks: tuple[tuple[str, ...], ...]) -> DataFrame:
    """(id, x): blocks of columns as z-scores over the root of their number, joined to one array: each block weighs the same."""
    scored = z_scores(df, tuple(c for b in blocks for c in b))
    return scored.select("id", F.array(*[F.col(c) / math.sqrt(len(b)) for b in blocks for c in b]).alias("x"))


def separation_over_diameter(df: DataFrame, axes: tuple[str, ...], label: str, far: DataFrame) -> DataFrame:
    """(a, b, sep_norm): the gap of two labels' centroids over ``far``, one row with the column diameter."""
    return separation(df, axes, label).crossJoin(F.broadcast(far)).select("a", "b", (F.col("gap") / F.col("diameter")).alias("sep_norm"))


def transitions(kernel: DataFrame) -> DataFrame:
    """(i, j, p) of both directions of a symmetric kernel (i, j, w) and its unit diagonal: each row sums to 1."""
    both = kernel.select("i", "j", "w").unionByName(kernel.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    degree = both.groupBy("i").agg((F.sum("w") + 1).alias("deg"))
    own = degree.select("i", F.col("i").alias("j"), F.lit(1.0).alias("w"))
    return both.unionByName(own).join(degree, "i").select("i", "j", (F.col("w") / F.col("deg")).alias("p"))


def potential(p: Column, gamma: float = 1.0, floor: float = 1e-12) -> Column:
    """The potential of a transition probability: -ln p at gamma 1, the root of p at gamma -1, else a power between."""
    p = F.greatest(p, F.lit(floor))
    if gamma == 1:
        return -F.ln(p)
    return 2 / (1 - gamma) * F.pow(p, (1 - gamma) / 2)

def blurred(hist: DataFrame, sigma: float, value: str = "count") -> DataFrame:
    """A separable Gaussian blur of (iy, ix, value): cells meet a small table of offsets, first along x, then along y.

    The radius is ceil(3 sigma); what falls off the grid is lost.
    """
    reach = math.ceil(3 * sigma)
    raw = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    rows = [(k, v / sum(raw)) for k, v in zip(range(-reach, reach + 1), raw, strict=True)]
    kernel = F.broadcast(hist.sparkSession.createDataFrame(rows, "_o int, _k double"))
    out = hist.select("iy", "ix", F.col(value).alias("_v"))
    for axis, other in (("ix", "iy"), ("iy", "ix")):
        moved = out.crossJoin(kernel).select(other, (F.col(axis) + F.col("_o")).alias(axis), (F.col("_v") * F.col("_k")).alias("_v"))
        out = moved.groupBy(other, axis).agg(F.sum("_v").alias("_v"))
    return hist.select("iy", "ix").join(out, ["iy", "ix"], "left").select("iy", "ix", F.coalesce("_v", F.lit(0.0)).alias(value))


def cell_summary(df: DataFrame, x: str, y: str, value: str, box: tuple[float, float, float, float], nx: int, ny: int) -> DataFrame:
    """(iy, ix, least, mean, n) of a value over the cells that have rows: the lower envelope and the conditional mean."""
    x0, x1, y0, y1 = box
    cells = df.select(bin_of(y, y0, y1, ny).alias("iy"), bin_of(x, x0, x1, nx).alias("ix"), F.col(value).alias("_v")).where("iy is not null and ix is not null")
    return cells.groupBy("iy", "ix").agg(F.min("_v").alias("least"), F.avg("_v").alias("mean"), F.count("*").alias("n"))


def coordination_histogram(numbers: DataFrame) -> DataFrame:
    """(cn, count) of coordination numbers from 0 to the largest, with 0 where there are none."""
    got = numbers.groupBy("cn").agg(F.count("*").alias("count"))
    top = got.agg(F.max("cn").alias("top"))  # one row; the range below it is that of a bounded count
    every = top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("cn"))
    return every.join(got, "cn", "left").select("cn", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def coordination(atoms: DataFrame, cutoff: float) -> DataFrame:
    """(frame, atom, cn): neighbours nearer than ``cutoff`` in the same frame; ``atoms`` has frame, atom, x, y, z."""
    near = near_in_space(atoms, cutoff, by=("frame",), name="atom")
    met = near.groupBy("frame", F.col("a").alias("atom")).agg(F.count("*").alias("cn"))
    return atoms.select("frame", "atom").join(met, ["frame", "atom"], "left").select("frame", "atom", F.coalesce("cn", F.lit(0)).cast("long").alias("cn"))


# ---------------------------------------------------------------- scores of a map


def correlations(pairs: DataFrame) -> DataFrame:
    """One row: Pearson and Spearman of far pairs (dh at or above its upper quartile), RMS of dh - dl of near ones.

    Equal distances have ranks of their own, in the order of (i, j), so that the partitioning changes nothing.
    """
    pairs = kept(pairs)
    q = pairs.agg(F.percentile("dh", F.lit(0.25)).alias("q25"), F.percentile("dh", F.lit(0.75)).alias("q75"))
    both = pairs.crossJoin(F.broadcast(q))
    far = both.where("dh >= q75").select("i", "j", "dh", "dl")
    by = {c: numbered(far.withColumn("_k", F.col(c)), "_k", f"r_{c}", ("i", "j")).select("i", "j", f"r_{c}") for c in ("dh", "dl")}
    ranks = by["dh"].join(by["dl"], ["i", "j"])
    pearson = far.agg(F.corr("dh", "dl").alias("far_pearson"))
    spearman = ranks.agg(F.corr("r_dh", "r_dl").alias("far_spearman"))
    near = both.where("dh <= q25").agg(F.sqrt(F.avg(F.pow(F.col("dh") - F.col("dl"), 2))).alias("near_rms"))
    return pearson.crossJoin(spearman).crossJoin(near)  # one row each


def neighbour_overlap(high: DataFrame, low: DataFrame, k: int) -> DataFrame:
    """One row: the mean part of the k nearest neighbours that two pair tables share."""
    a, b = (nearest_neighbours(p, k).select("i", "j") for p in (high, low))
    shared = a.join(b, ["i", "j"]).groupBy("i").agg(F.count("*").alias("c"))
    every = both_ways(high).select("i").distinct()
    return every.join(shared, "i", "left").agg((F.avg(F.coalesce("c", F.lit(0))) / k).alias("overlap"))


def shared_neighbours(points: DataFrame, high: DataFrame, low: DataFrame, k: int) -> DataFrame:
    """``neighbour_overlap`` of neighbours that are known: (i, j) of the k nearest of each of ``points`` (id), by two distances."""
    shared = high.select("i", "j").join(low.select("i", "j"), ["i", "j"]).groupBy("i").agg(F.count("*").alias("c"))
    every = points.select(F.col("id").alias("i"))
    return every.join(shared, "i", "left").agg((F.avg(F.coalesce("c", F.lit(0))) / k).alias("overlap"))


def rank_uniform(df: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """Each axis as its rank by (value, id) over n - 1: ties get ranks of their own."""
    n = df.count()
    out = df.select("id")
    for c in axes:
        spread = numbered(df.select("id", c), c, "_r", ("id",))
        out = out.join(spread.select("id", (F.col("_r") / max(n - 1, 1)).alias(c)), "id")
    return out


def separation(df: DataFrame, axes: tuple[str, ...], label: str) -> DataFrame:
    """(a, b, gap, spread, ratio) of each two labels: distance of centroids over the mean distance to the own centroid."""
    centre = df.groupBy(label).agg(*[F.avg(c).alias(f"m_{c}") for c in axes], F.count("*").alias("n"))
    norm = lambda p, q: F.sqrt(sum((F.pow(F.col(x) - F.col(y), 2) for x, y in zip(p, q, strict=True)), F.lit(0.0)))
    spread = df.join(F.broadcast(centre), label).groupBy(label).agg(F.avg(norm(axes, [f"m_{c}" for c in axes])).alias("s"))
    known = centre.join(spread, label)
    a = known.select(F.col(label).alias("a"), *[F.col(f"m_{c}").alias(f"a_{c}") for c in axes], F.col("s").alias("sa"))
    b = known.select(F.col(label).alias("b"), *[F.col(f"m_{c}").alias(f"b_{c}") for c in axes], F.col("s").alias("sb"))
    gap = norm([f"a_{c}" for c in axes], [f"b_{c}" for c in axes])
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", gap.alias("gap"), ((F.col("sa") + F.col("sb")) / 2).alias("spread")).withColumn("ratio", F.col("gap") / F.col("spread"))


def suggest_tau(df: DataFrame, x: str, part: float = 0.35) -> DataFrame:
    return df.agg((part * (F.max(x) - F.min(x))).alias("tau"))


def labelled_pairs(pairs: DataFrame, a: list[float], b: list[float]) -> DataFrame:
    """(d2, along2, same) of pairs with x_i and x_j: squared distance, squared part along b - a, and whether the nearer
    reference (a on ties) is the same."""
    norm = math.sqrt(sum((p - q) ** 2 for p, q in zip(a, b, strict=True)))
    if not norm:
        raise ValueError("the references are the same")
    at = lambda c, k: F.get(c, F.lit(k))
    to = lambda c, r: sum((F.pow(at(c, k) - v, 2) for k, v in enumerate(r)), F.lit(0.0))
    side = lambda c: to(c, a) <= to(c, b)
    d2 = sum((F.pow(at("x_i", k) - at("x_j", k), 2) for k in range(len(a))), F.lit(0.0))
    along = sum(((at("x_i", k) - at("x_j", k)) * ((p - q) / norm) for k, (p, q) in enumerate(zip(a, b, strict=True))), F.lit(0.0))
    return pairs.select(d2.alias("d2"), (along * along).alias("along2"), (side("x_i") == side("x_j")).alias("same"))


def alpha_losses(pairs: DataFrame, transfer: Transfer, steps: int = 200, top: float = 20.0) -> DataFrame:
    """(alpha, loss) of a stretch weight on a grid: Bernoulli loss of the labels, with F(d) the chance that they differ.

    Pairs of ``labelled_pairs`` meet a grid of fixed size and are summed where they are.
    """
    grid = F.broadcast(pairs.sparkSession.range(steps + 1).select((F.col("id") * (top / steps)).alias("alpha")))
    apart = transfer.column(F.sqrt(F.col("d2") + F.col("alpha") * F.col("along2")))
    apart = F.greatest(F.lit(1e-12), F.least(apart, F.lit(1 - 1e-12)))
    loss = F.when(F.col("same"), -F.ln(1 - apart)).otherwise(-F.ln(apart))
    return pairs.where("along2 > 0").crossJoin(grid).groupBy("alpha").agg(F.sum(loss).alias("loss"))


def suggest_alpha(losses: DataFrame) -> DataFrame:
    """One row: the alpha of least loss and the 16 % and 84 % points of the posterior exp(-loss) over the grid."""
    best = losses.agg(F.min("loss").alias("least"), F.min_by("alpha", F.struct("loss", "alpha")).alias("best"))
    mass = losses.crossJoin(F.broadcast(best)).withColumn("p", F.exp(F.col("least") - F.col("loss")))
    run = Window.orderBy("alpha").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as the grid has
    part = mass.withColumn("c", F.sum("p").over(run) / F.sum("p").over(Window.partitionBy()))
    at = lambda q: F.min(F.when(F.col("c") >= q, F.col("alpha")))
    return part.agg(at(0.16).alias("alpha_lo"), at(0.84).alias("alpha_hi")).crossJoin(best).select(F.col("best").alias("alpha"), "alpha_lo", "alpha_hi")


def plugin_alpha(pairs: DataFrame, sigma: float) -> DataFrame:
    """One row: the upper median of the weights that bring each pair of differing labels to distance sigma; 0 if there are none."""
    want = pairs.where(~F.col("same") & (F.col("along2") > 0) & (F.col("d2") < sigma * sigma)).select(((sigma * sigma - F.col("d2")) / F.col("along2")).alias("v"))
    ranks = numbered(want, "v", "r")
    n = ranks.count()
    if not n:
        return pairs.sparkSession.createDataFrame([(0.0, 0)], "alpha double, n_used long")
    return ranks.where(F.col("r") == n // 2).select(F.col("v").alias("alpha"), F.lit(n).cast("long").alias("n_used"))


def phate_kernel(pairs: DataFrame, k: int, decay: float) -> DataFrame:
    """(i, j, w) of j < i: exp(-(d / bandwidth)^decay), averaged over the k-th-neighbour bandwidths of both ends.

    0 beyond an exponent of 60; pairs of which both sides are 0 are left out.
    """
    pairs = kept(pairs)
    band = nearest_neighbours(pairs, k).where(F.col("rank") == k).select("i", F.col("d").alias("b"))
    if not band.where("b <= 0").isEmpty():
        raise ValueError("a bandwidth is not positive: drop repeated points first")
    both = pairs.join(band.toDF("i", "bi"), "i").join(band.toDF("j", "bj"), "j")
    side = lambda b: F.when(F.pow(F.col("d") / F.col(b), decay) >= 60, 0.0).otherwise(F.exp(-F.pow(F.col("d") / F.col(b), decay)))
    return both.select("i", "j", ((side("bi") + side("bj")) / 2).alias("w")).where("w > 0")

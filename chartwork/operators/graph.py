"""Graphs of neighbours and grids of cells: components, basins, walks, fills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwork.operators.joins import nearest_join
from chartwork.operators.tables import kept


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable.

    Each round a label spreads over edges, the label that a node gave up takes the least one that its nodes met, and all
    jump along labels. Without the second step a lower label that meets a long chain with one label of its own would go
    on by one node a round. Labels only fall, so the rounds end.
    """
    ways = kept(edges.select(F.col("i").alias("a"), F.col("j").alias("b")).unionByName(edges.select(F.col("j").alias("a"), F.col("i").alias("b"))).distinct())
    now = kept(nodes.select("id", F.col("id").alias("c")))
    while True:
        seen = ways.join(now.select(F.col("id").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
        met = kept(now.join(seen, now["id"] == seen["a"], "left").select("id", "c", F.least("c", "m").alias("m")))
        hook = met.where("m < c").groupBy(F.col("c").alias("r")).agg(F.min("m").alias("h"))
        step = kept(met.join(hook, F.col("id") == F.col("r"), "left").select("id", F.least("m", "h").alias("c"), F.col("c").alias("was")))
        jump = step.select(F.col("id").alias("p"), F.col("c").alias("pc"))
        new = kept(step.join(jump, F.col("c") == F.col("p")).select("id", F.least("c", "pc").alias("c"), "was"))
        if new.where("c <> was").isEmpty():
            return new.select("id", F.col("c").alias("component"))
        now = new.select("id", "c")


def edge_costs(graph: DataFrame, energy: DataFrame, scale: float = 1.0) -> DataFrame:
    """(i, j, d, cost, height): cost = |dE| + scale * d, height = max E + scale * d; ``energy`` has id and e."""
    e = energy.select("id", "e")
    both = graph.join(e.toDF("i", "ei"), "i").join(e.toDF("j", "ej"), "j")
    return both.select("i", "j", "d", "ei", "ej", (F.abs(F.col("ei") - F.col("ej")) + scale * F.col("d")).alias("cost"), (F.greatest("ei", "ej") + scale * F.col("d")).alias("height"))


def boltzmann(costs: DataFrame, temperature: float) -> DataFrame:
    return costs.select("i", "j", F.exp(-F.col("cost") / temperature).alias("w"))


def basins(costs: DataFrame, energy: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, basin): steepest descent over edges to a local minimum of the energy.

    Each point goes to its neighbour of lower energy over the edge of least (height, energy, id); pointers are then
    doubled until none moves.
    """
    ways = costs.select(F.col("i").alias("a"), F.col("j").alias("b"), "ei", "ej", "height").unionByName(costs.select(F.col("j").alias("a"), F.col("i").alias("b"), F.col("ej").alias("ei"), F.col("ei").alias("ej"), "height"))
    down = ways.where("ej < ei").groupBy("a").agg(F.min(F.struct("height", "ej", "b")).alias("m")).select(F.col("a").alias("id"), F.col("m.b").alias("p"))
    now = kept(energy.select("id").join(down, "id", "left").select("id", F.coalesce("p", "id").alias("p")))
    for _ in range(rounds):
        up = now.select(F.col("id").alias("k"), F.col("p").alias("q"))
        new = kept(now.join(up, F.col("p") == F.col("k")).select("id", F.col("q").alias("p"), F.col("p").alias("was")))
        if new.where("p <> was").isEmpty():
            return new.select("id", F.col("p").alias("basin"))
        now = new.select("id", "p")
    raise RuntimeError(f"basins did not settle in {rounds} rounds")


# ---------------------------------------------------------------- cells of a grid


def local_minima(cells: DataFrame, value: str = "f") -> DataFrame:
    """Cells whose value none of their eight neighbours undercuts; ties go to the lower (iy, ix)."""
    around = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    known = cells.where(F.col(value).isNotNull()).select("iy", "ix", F.col(value).alias("v"))
    sent = known.select("iy", "ix", "v", F.explode(around).alias("o")).select((F.col("iy") + F.col("o.dy")).alias("iy"), (F.col("ix") + F.col("o.dx")).alias("ix"), F.struct("v", "iy", "ix").alias("n"))
    least = sent.groupBy("iy", "ix").agg(F.min("n").alias("n"))
    return known.join(least, ["iy", "ix"], "left").where(F.col("n").isNull() | (F.struct("v", "iy", "ix") < F.col("n"))).select("iy", "ix", F.col("v").alias(value))


def bodies(cells: DataFrame, nx: int) -> DataFrame:
    """(iy, ix, body) of the 4-connected bodies of the given cells: body is the least iy * nx + ix."""
    own = cells.select((F.col("iy") * nx + F.col("ix")).cast("long").alias("id"), "iy", "ix")
    right = own.select(F.col("id").alias("i"), "iy", (F.col("ix") + 1).alias("ix"))
    down = own.select(F.col("id").alias("i"), (F.col("iy") + 1).alias("iy"), "ix")
    edges = right.unionByName(down).join(own.withColumnRenamed("id", "j"), ["iy", "ix"]).select("i", "j")
    return own.join(components(own, edges), "id").select("iy", "ix", F.col("component").alias("body"))


def largest_body(cells: DataFrame, nx: int) -> DataFrame:
    """The cells of the largest body; of equals the one of least label."""
    found = bodies(cells, nx)
    best = found.groupBy("body").agg(F.count("*").alias("n")).agg(F.max_by("body", F.struct("n", -F.col("body"))).alias("body"))
    return found.join(F.broadcast(best), "body").select("iy", "ix")


def inverse_distance_fill(grid: DataFrame, sites: DataFrame, k: int, cut: float, power: float = 2.0) -> DataFrame:
    """(iy, ix, f): the mean of a cell's k nearest sites' values by inverse distance, null beyond ``cut`` of any site.

    ``grid`` has iy, ix, x, y; ``sites`` id, x, y, v, each id once. The sites come from the exact join by distance, which
    sends on k of a block at most, so no task holds all sites near to a cell.
    """
    cell = F.shiftleft(F.col("iy").cast("long"), 32).bitwiseOR(F.col("ix").cast("long").bitwiseAND(0xFFFFFFFF))
    placed = " and ".join(f"abs({c}) < double('inf')" for c in "xy")  # neither null nor NaN, which is the largest
    at = F.array(F.col("x").cast("double"), F.col("y").cast("double")).alias("x")
    near = nearest_join(grid.where(placed).select(cell.alias("id"), at), sites.where(placed).select("id", at), k).where(F.col("d") <= cut)
    w = 1 / F.pow(F.col("d") + 1e-9, power)
    got = near.join(sites.select(F.col("id").alias("j"), "v"), "j").groupBy(F.col("i").alias("_cell")).agg((F.sum(w * F.col("v")) / F.sum(w)).alias("f"))
    return grid.select("iy", "ix", cell.alias("_cell")).join(got, "_cell", "left").select("iy", "ix", "f")


def components_at(nodes: DataFrame, costs: DataFrame, level: float) -> DataFrame:
    """Components of the graph whose edges have a height of at most ``level``."""
    return components(nodes, costs.where(F.col("height") <= level))


def metropolis(costs: DataFrame, temperature: float) -> DataFrame:
    """(i, j, w) of directed edges: 1 downhill, exp(-(E_j - E_i) / T) uphill, at least 1e-300."""
    ways = costs.select("i", "j", "ei", "ej").unionByName(costs.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("ej").alias("ei"), F.col("ei").alias("ej")))
    rise = F.greatest(F.col("ej") - F.col("ei"), F.lit(0.0))
    return ways.select("i", "j", F.greatest(F.exp(-rise / temperature), F.lit(1e-300)).alias("w"))


def adjacency(costs: DataFrame, temperature: float, mode: str = "height") -> DataFrame:
    """(i, j, w) of undirected edges: exp(-(height - least energy) / T), exp(-cost / T) or 1 / d, by ``mode``.

    ``mode`` is ``height``, ``cost`` or ``inverse``; distances count as 1e-6 at least, weights as 1e-300.
    """
    if mode == "inverse":
        w = 1 / F.greatest("d", F.lit(1e-6))
    elif mode == "cost":
        w = F.exp(-F.col("cost") / temperature)
    elif mode == "height":
        least = costs.agg(F.min(F.least("ei", "ej")).alias("_e0"))
        costs = costs.crossJoin(F.broadcast(least))  # one row
        w = F.exp(-(F.col("height") - F.col("_e0")) / temperature)
    else:
        raise ValueError(f"not a mode: {mode!r}")
    return costs.select("i", "j", F.greatest(w, F.lit(1e-300)).alias("w"))


def relative_energy(q: DataFrame, energy: DataFrame) -> DataFrame:
    """(id, q, e): a coordinate with the energy scaled to [0, 1]; 0 where all energies are equal."""
    span = energy.agg(F.min("e").alias("_lo"), F.max("e").alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col("e") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return q.join(energy, "id").crossJoin(F.broadcast(span)).select("id", "q", scaled.alias("e"))  # one row


def filled_holes(cells: DataFrame, nx: int, ny: int) -> DataFrame:
    """(iy, ix, hole): the given cells and the empty ones of an nx x ny grid that no 4-connected way joins to its border."""
    every = cells.sparkSession.range(nx * ny).select((F.col("id") / nx).cast("int").alias("iy"), (F.col("id") % nx).cast("int").alias("ix"))
    empty = every.join(cells.select("iy", "ix"), ["iy", "ix"], "left_anti")
    found = kept(bodies(empty, nx))
    border = (F.col("iy") == 0) | (F.col("ix") == 0) | (F.col("iy") == ny - 1) | (F.col("ix") == nx - 1)
    open_ = found.where(border).select("body").distinct()
    holes = found.join(open_, "body", "left_anti").select("iy", "ix", F.lit(True).alias("hole"))
    return cells.select("iy", "ix", F.lit(False).alias("hole")).unionByName(holes)


def connected_surface(surface: DataFrame, nx: int, ny: int, floor: float) -> DataFrame:
    """(iy, ix, f) of a surface with rho: the largest body of the cells above ``floor`` of the top, its holes filled with 0."""
    top = surface.agg(F.max("rho").alias("_top"))
    mask = kept(surface.crossJoin(F.broadcast(top)).where(F.col("rho") > floor * F.col("_top")).select("iy", "ix"))  # one row
    body = largest_body(filled_holes(mask, nx, ny), nx)
    return body.join(surface.select("iy", "ix", F.coalesce("f", F.lit(0.0)).alias("_f")), ["iy", "ix"]).join(mask.withColumn("_own", F.lit(True)), ["iy", "ix"], "left").select("iy", "ix", F.when(F.col("_own"), F.col("_f")).otherwise(0.0).alias("f"))


#: Cells that a grid may have to be broadcast.
CELLS = 1 << 18


def _on_grid(grid: DataFrame, sites: DataFrame) -> DataFrame:
    """Every site with every cell of a grid (iy, ix, x, y) of bounded size; d2 is their squared distance."""
    if grid.limit(CELLS + 1).count() > CELLS:
        raise ValueError(f"more than {CELLS} cells")
    met = sites.select(F.col("x").alias("sx"), F.col("y").alias("sy"), "v").crossJoin(F.broadcast(grid.select("iy", "ix", "x", "y")))
    return met.withColumn("d2", F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2))


def paraboloid_envelope(grid: DataFrame, sites: DataFrame, stiffness: float) -> DataFrame:
    """(iy, ix, f): the least of value + stiffness * squared distance over all sites (x, y, v)."""
    return _on_grid(grid, sites).groupBy("iy", "ix").agg(F.min(F.col("v") + stiffness * F.col("d2")).alias("f"))


def kernel_fill(grid: DataFrame, sites: DataFrame, length: float) -> DataFrame:
    """(iy, ix, f): the mean of all sites' values by the inverse multiquadric kernel 1 / sqrt(1 + d^2 / length^2)."""
    w = 1 / F.sqrt(1 + F.col("d2") / (length * length))
    return _on_grid(grid, sites).groupBy("iy", "ix").agg((F.sum(w * F.col("v")) / F.sum(w)).alias("f"))


def kernel_density(grid: DataFrame, sites: DataFrame, width: float) -> DataFrame:
    """(iy, ix, rho): Gaussian kernel density of the sites, weighted by v."""
    w = F.exp(-F.col("d2") / (2 * width * width)) * F.col("v")
    return _on_grid(grid, sites).groupBy("iy", "ix").agg((F.sum(w) / F.sum("v") / (2 * 3.141592653589793 * width * width)).alias("rho"))


def kernel_predict(grid: DataFrame, inducing: DataFrame, length: float, variance: float = 1.0) -> DataFrame:
    """(iy, ix, f): the sum over inducing points (x, y, v = alpha) of alpha times the kernel: the mean of a fitted map."""
    k = variance / F.sqrt(1 + F.col("d2") / (length * length))
    return _on_grid(grid, inducing).groupBy("iy", "ix").agg(F.sum(k * F.col("v")).alias("f"))


def support(grid: DataFrame, sites: DataFrame, cut: float) -> DataFrame:
    """(iy, ix) of the cells that have a site within ``cut``: sites are binned, a cell meets those of nine bins."""
    bin_ = lambda c: F.floor(F.col(c) / cut)
    around = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    cells = grid.withColumn("o", F.explode(around)).withColumn("by", bin_("y") + F.col("o.dy")).withColumn("bx", bin_("x") + F.col("o.dx"))
    known = sites.select(F.col("x").alias("sx"), F.col("y").alias("sy"), bin_("y").alias("by"), bin_("x").alias("bx"))
    near = F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2) <= cut * cut
    return cells.join(known, ["by", "bx"]).where(near).select("iy", "ix").distinct()

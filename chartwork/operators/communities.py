"""Whether a map falls into two labelled communities: a farthest pair without all pairs, and two means from it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartwork.operators.pairs import all_pairs
from chartwork.operators.tables import kept

#: Rounds of the two means, a fixed value.
ROUNDS = 16


def _corners(p: np.ndarray) -> np.ndarray:
    """The corners of the hull of plane points, as row numbers; of points at one place the first row."""
    order = np.lexsort((np.arange(len(p)), p[:, 1], p[:, 0]))
    order = order[np.append(True, (np.diff(p[order], axis=0) != 0).any(axis=1))]
    if len(order) < 3:
        return order
    found: set[int] = set()
    for side in (order, order[::-1]):
        chain: list[int] = []
        for k in side.tolist():
            # a point within rounding of a line stays
            while len(chain) > 1:
                a, b = p[chain[-1]] - p[chain[-2]], p[k] - p[chain[-2]]
                if a[0] * b[1] - a[1] * b[0] > -1e-12 * (abs(a[0] * b[1]) + abs(a[1] * b[0])):
                    break
                chain.pop()
            chain.append(k)
        found.update(chain)
    return np.array(sorted(found))


def hull(points: DataFrame) -> DataFrame:
    """Of plane points (id, x) those that may be corners of their hull: each task keeps the corners of what it has read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for batch in batches:
            now = batch if now is None else pd.concat([now, batch], ignore_index=True)
            now = now.sort_values("id", kind="stable", ignore_index=True)
            if len(now):
                now = now.iloc[_corners(np.stack(now["x"].to_numpy()).astype(float))].reset_index(drop=True)
        if now is not None and len(now):
            yield now

    return points.select("id", "x").mapInPandas(run, "id long, x array<double>")


def _gap(a: str | Column, b: list[float]) -> Column:
    at = F.col(a) if isinstance(a, str) else a
    return sum((F.pow(F.get(at, F.lit(k)) - v, 2) for k, v in enumerate(b)), F.lit(0.0))


def farthest_pair(points: DataFrame) -> tuple[int, int, list[float], list[float]] | None:
    """(i, j, xi, xj) of the farthest pair of plane points (id, x), i < j; of equally far ones the first; None below two points.

    Only corners of the hull can be ends. Each task's corners are taken, then those of a 64th as many tasks, and of
    these the ones that are farther from the centre than the length of some pair less the largest such distance. The
    rest meet as pairs of blocks: they are many only where the points lie on a circle.
    """
    parts = points.rdd.getNumPartitions()
    few = kept(hull(hull(points).repartition(max(1, parts // 64))))
    centre = few.agg(*[F.avg(F.get("x", F.lit(k))) for k in (0, 1)]).first()
    if centre[0] is None:
        return None
    rows = few.withColumn("_r", F.sqrt(_gap("x", list(centre))))
    rim = rows.agg(F.max(F.struct("_r", "x")).alias("m")).first()["m"]
    across = rows.agg(F.max(F.sqrt(_gap("x", list(rim["x"])))).alias("d")).first()["d"]
    ends = rows.where(F.col("_r") >= (across - rim["_r"]) - 1e-9 * across).select("id", "x")
    far = all_pairs(ends, more=("x",)).select("d", "i", "j", "x_i", "x_j").orderBy(F.desc("d"), "j", "i").first()  # j < i
    if far is None:  # all points at one place: the first two rows
        two = points.orderBy("id").select("id", "x").take(2)
        return (two[0]["id"], two[1]["id"], list(two[0]["x"]), list(two[1]["x"])) if len(two) == 2 else None
    return far["j"], far["i"], list(far["x_j"]), list(far["x_i"])


def two_sides(points: DataFrame) -> DataFrame | None:
    """``points`` (id, x) with ``side`` 0 or 1 by two means, from their farthest pair; None where a side is empty.

    A point as near to both centres is of side 0. Each round is one aggregation; the rounds end early when the centres stay.
    """
    far = farthest_pair(points)
    if far is None:
        return None
    centres, n = [far[2], far[3]], 0
    for _ in range(ROUNDS):
        sided = points.withColumn("side", F.when(_gap("x", centres[0]) <= _gap("x", centres[1]), 0).otherwise(1))
        means = sided.groupBy("side").agg(*[F.avg(F.get("x", F.lit(k))).alias(f"c{k}") for k in (0, 1)]).orderBy("side").collect()
        if len(means) < 2:
            return None
        new = [[m["c0"], m["c1"]] for m in means]
        if new == centres:
            break
        centres, n = new, n + 1
    return sided


def family_floor(points: DataFrame) -> DataFrame:
    """One row of plane points (id, x, family): ``floor`` 2 where two means part two families, else 1, and what decides it.

    It is 2 if the most frequent families of the sides differ (of equally frequent ones the one that comes first by id)
    and the centres are farther apart than the sum of the sides' radii. It is 1, with nulls beside it, for fewer than
    two points, one family, an empty side, or a coordinate that is null or not finite. A null family is one of its own.
    """
    spark = points.sparkSession
    schema = "floor int, n_0 long, n_1 long, family_0 string, family_1 string, gap double, radius_0 double, radius_1 double"
    none = spark.createDataFrame([(1, *[None] * 7)], schema)
    rows = kept(points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"), F.col("family").cast("string").alias("family")))
    fine = F.coalesce((F.size("x") == 2) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    seen = rows.agg(F.count("*").alias("n"), F.count_if(~fine).alias("bad"), F.min("family").alias("lo"), F.max("family").alias("hi"), F.count_if(F.col("family").isNull()).alias("nulls")).first()
    if seen["n"] < 2 or seen["bad"] or seen["nulls"] == seen["n"] or (seen["lo"] == seen["hi"] and not seen["nulls"]):
        return none
    sided = two_sides(rows)
    if sided is None:
        return none
    families = sided.groupBy("side", "family").agg(F.count("*").alias("k"), F.min("id").alias("first"))
    top = families.groupBy("side").agg(F.max_by("family", F.struct("k", -F.col("first"))).alias("family"), F.sum("k").alias("n"))
    means = {r["side"]: r for r in sided.groupBy("side").agg(*[F.avg(F.get("x", F.lit(k))).alias(f"c{k}") for k in (0, 1)]).collect()}
    centres = [[means[s]["c0"], means[s]["c1"]] for s in (0, 1)]
    radius = sided.groupBy("side").agg(F.max(F.sqrt(F.when(F.col("side") == 0, _gap("x", centres[0])).otherwise(_gap("x", centres[1])))).alias("radius"))
    both = top.join(radius, "side")
    pick = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}")
    gap = float(np.hypot(centres[0][0] - centres[1][0], centres[0][1] - centres[1][1]))
    row = both.agg(*[pick(c, s) for c in ("n", "family", "radius") for s in (0, 1)]).withColumn("gap", F.lit(gap))
    two = ~F.col("family_0").eqNullSafe(F.col("family_1")) & (F.col("gap") > F.col("radius_0") + F.col("radius_1"))
    return row.select(F.when(two, 2).otherwise(1).cast("int").alias("floor"), "n_0", "n_1", "family_0", "family_1", "gap", "radius_0", "radius_1")

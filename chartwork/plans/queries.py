"""Queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartwork.functions import metrics
from chartwork.functions.transfers import Transfer, parse_transfer
from chartwork.operators import blocks, graph, joins, mapped, pairs, projection, solvers, stats, structures, trees
from chartwork.operators.tables import kept, numbered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- point tables

_E = "e as materialized (select vec_id as id, embedding::double[] as x, label from embeddings)"
_P = _E + ", p as materialized (select a.id as i, b.id as j, list_distance(a.x, b.x) as d, sqrt(pow(a.x[1] - b.x[1], 2) + pow(a.x[2] - b.x[2], 2)) as dl from e a join e b on b.id < a.id)"
_BOTH = ", g as (select i, j, d from p union all select j, i, d from p), k as materialized (select i, j, d, row_number() over (partition by i order by d, j) as rank from g)"
_ID = "(((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 64 + cast(l_quantity as bigint)"
_ATOM = "(l_linenumber::bigint * 1000000000 + l_partkey * 10000 + l_suppkey) * 64 + cast(l_quantity as bigint)"
_L = f"l as materialized (select {_ID} as id, l_quantity / 50 as q, l_extendedprice / 100000 as p, l_discount * 10 as s, l_tax * 10 as t, l_returnflag as flag, l_linestatus as status from lineitem)"
_M = ", m as (select s_suppkey as lid, s_acctbal / 10000 as lq, (s_suppkey % 7) / 7.0::double as lp, 1.0::double + s_nationkey as lw, s_acctbal / 1000 as px, s_nationkey::double as py from (select *, row_number() over (order by s_suppkey) - 1 as nr, greatest(count(*) over () // 50, 1) as step from supplier) where nr % step = 0 and nr < 50 * step)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


def bandwidths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, b): distance of every vector to its fifth neighbour."""
    v = vectors(spark, sf_dir)
    return joins.nearest_join(v, v, 5, same=True).where("rank = 5").select(F.col("i").alias("id"), F.col("d").alias("b"))


def placed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors with their first two numbers as place (u, v) and 1 + label as weight."""
    return vectors(spark, sf_dir).select("id", "x", F.get("x", F.lit(0)).alias("u"), F.get("x", F.lit(1)).alias("v"), (1 + F.col("label")).alias("w"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four scaled numbers of each line item."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.expr(_ID).alias("id"), (F.col("l_quantity") / 50).alias("q"), (F.col("l_extendedprice") / 100000).alias("p"), (F.col("l_discount") * 10).alias("s"), (F.col("l_tax") * 10).alias("t"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("id", F.array("q", "p").alias("x"), "q", "p")


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty landmarks, at even steps of the suppliers, with two coordinates, a weight and a place."""
    s = table(spark, sf_dir, "supplier")
    picked = pairs.stride_points(s.select(F.col("s_suppkey").alias("id")), 50).select(F.col("id").alias("s_suppkey"))
    s = s.join(F.broadcast(picked), "s_suppkey")
    return s.select(F.col("s_suppkey").alias("id"), F.array(F.col("s_acctbal") / 10000, (F.col("s_suppkey") % 7) / F.lit(7.0)).alias("x"), (F.lit(1.0) + F.col("s_nationkey")).alias("w"), (F.col("s_acctbal") / 1000).alias("px"), F.col("s_nationkey").cast("double").alias("py"))


def plane(a: str, b: str):
    return metrics.euclid(a, b, 2)


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as atoms of a frame."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("frame"), F.expr(_ATOM).alias("atom"), (F.col("l_quantity") / 15).alias("x"), (F.col("l_discount") * 20).alias("y"), (F.col("l_linenumber") / F.lit(2.0)).alias("z"))


_A = f"a as materialized (select l_orderkey as frame, {_ATOM} as atom, l_quantity / 15 as x, l_discount * 20 as y, l_linenumber / 2.0::double as z from lineitem)"
_AP = _A + ", ap as materialized (select a.frame, a.atom as a, b.atom as b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) as d from a join a b on a.frame = b.frame and b.atom < a.atom)"

R6 = lambda c: F.round(c, 6)

# ---------------------------------------------------------------- transfers

# Transfers that are run, with the same formula in SQL over x
_TRANSFERS = {
    "identity": ("identity", "x"),
    "sigmoid": ("2", "1 - 1 / (1 + pow(x / 2, 2))"),
    "compress": ("compress,2", "1 - 1 / (1 + x / 2)"),
    "xsigmoid": ("5,8,1", "1 - pow(1 + 255 * pow(x / 5, 8), -0.125)"),
    "gamma": ("3,4", "1 - exp(-x * x / 18) * (1 + x * x / 18)"),
    "imq": ("imq,2", "1 - (2 / sqrt(3)) / sqrt(4.0 / 3 + x * x)"),
    "asinh": ("asinh,2", "asinh(x / 2) / (2 * asinh(1))"),
    "twoscale": ("ts,5,8,1,3", "case when x <= 5 then 1 - pow(1 + 255 * pow(x / 5, 8), -0.125) else (asinh(x / 3) - asinh(5.0::double / 3)) / (2 * asinh(1)) + 0.5 end"),
    "multiscale": ("ms,1,4", "(1 - (1 / sqrt(3)) / sqrt(1.0 / 3 + x * x) + 1 - (4 / sqrt(3)) / sqrt(16.0 / 3 + x * x)) / 2"),
    "warp": ("5,8,1,2,2", "case when x = 0 then 0 else 5 * sqrt(pow(1 - (1 - pow(1 + 255 * pow(x / 5, 8), -0.125)), -1) - 1) end"),
}


def _transfer_query(name: str, spec: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        li = table(spark, sf_dir, "lineitem").select("l_linenumber", parse_transfer(spec).column(F.col("l_quantity") / 5).alias("f"))
        return li.groupBy("l_linenumber").agg(F.count("*").alias("n"), R6(F.avg("f")).alias("mean_f"), R6(F.min("f")).alias("min_f"), R6(F.max("f")).alias("max_f"))

    run.__name__ = f"transfer_{name}"
    return run


for _name, (_spec, _sql) in _TRANSFERS.items():
    query(f"with f as (select l_linenumber, {_sql} as f from (select l_linenumber, l_quantity / 5 as x from lineitem)) select l_linenumber, count(*) as n, round(avg(f), 6) as mean_f, round(min(f), 6) as min_f, round(max(f), 6) as max_f from f group by 1")(_transfer_query(_name, _spec))

# ---------------------------------------------------------------- metrics


def _by_point(df: DataFrame, dist) -> DataFrame:
    return blocks.by_point(df, dist).select("i", "n", *[R6(F.col(c)).alias(c) for c in ("sum_d", "min_d", "max_d")])


_BY = " select i, count(d) as n, round(sum(d), 6) as sum_d, round(min(d), 6) as min_d, round(max(d), 6) as max_d from p group by i"
_UNIT = [0.6, 0.8]


@query(f"with {_P}{_BY}")
def dist_euclid(spark, sf_dir):
    return _by_point(vectors(spark, sf_dir), blocks.euclid_product)


@query(f"with {_E}, p as (select i, case when s > 0 then -ln(s) end as d from (select a.id as i, list_dot_product(a.x, b.x) as s from e a join e b on b.id < a.id)){_BY}")
def dist_dot(spark, sf_dir):
    return _by_point(vectors(spark, sf_dir), blocks.dot_logs)


def _histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the five event types by user, as one array."""
    ev = table(spark, sf_dir, "events")
    kinds = ["click", "error", "purchase", "signup", "view"]
    return ev.groupBy(F.col("user_id").alias("id")).agg(F.array(*[F.count_if(F.col("event_type") == k).cast("double") for k in kinds]).alias("x"))


_H = "h as materialized (select user_id as id, [count(*) filter (event_type = 'click'), count(*) filter (event_type = 'error'), count(*) filter (event_type = 'purchase'), count(*) filter (event_type = 'signup'), count(*) filter (event_type = 'view')]::double[] as x from events group by 1)"


@query(f"with {_H}, p as (select a.id as i, list_sum(list_transform(range(1, 6), lambda k: abs(a.x[k] - b.x[k]))) as d from h a join h b on b.id < a.id){_BY}")
def dist_l1(spark, sf_dir):
    return _by_point(_histories(spark, sf_dir), blocks.l1_steps)


@query(f"with {_H}, c as materialized (select id, list_transform(range(1, 6), lambda k: list_sum(x[1:k]) / list_sum(x)) as c from h), p as (select a.id as i, list_sum(list_transform(range(1, 6), lambda k: abs(a.c[k] - b.c[k]))) as d from c a join c b on b.id < a.id){_BY}")
def dist_wasserstein(spark, sf_dir):
    h = _histories(spark, sf_dir)
    return _by_point(h.select("id", metrics.cumulative("x").alias("x")), blocks.l1_steps)


_PART = "select p_partkey as id, [p_size / 50.0::double, p_retailprice / 1000] as x from part"


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size") / F.lit(50.0), F.col("p_retailprice") / 1000).alias("x"))


_WRAP = "(case when ({0} % 1.0 + 1.0) % 1.0 > 0.5 then ({0} % 1.0 + 1.0) % 1.0 - 1.0 else ({0} % 1.0 + 1.0) % 1.0 end)"


@query(f"with c as materialized ({_PART}), p as (select a.id as i, sqrt(pow({_WRAP.format('(a.x[1] - b.x[1])')}, 2) + pow({_WRAP.format('(a.x[2] - b.x[2])')}, 2)) as d from c a join c b on b.id < a.id){_BY}")
def dist_periodic(spark, sf_dir):
    return _by_point(_parts(spark, sf_dir), blocks.periodic_steps([1.0, 1.0]))


@query(f"with c as materialized (select id, 2 * pi() * (x[1] % 1.0) as u, 2 * pi() * (x[2] % 1.0) as v from ({_PART})), p as (select a.id as i, acos(greatest(-1, least(1, cos(a.u) * cos(b.u) + sin(a.u) * sin(b.u) * cos(a.v) * cos(b.v) + sin(a.u) * sin(b.u) * sin(a.v) * sin(b.v)))) as d from c a join c b on b.id < a.id) select i, count(d) as n, round(sum(d), 4) as sum_d from p group by i")
def dist_sphere(spark, sf_dir):
    p = blocks.by_point(_parts(spark, sf_dir), blocks.sphere_arcs([1.0, 1.0]))
    return p.select("i", "n", F.round("sum_d", 4).alias("sum_d"))


@query(f"with c as materialized ({_PART}), p as (select a.id as i, sqrt(pow(a.x[1] - b.x[1], 2) + pow(a.x[2] - b.x[2], 2) + 3 * pow(0.6 * (a.x[1] - b.x[1]) + 0.8 * (a.x[2] - b.x[2]), 2)) as d from c a join c b on b.id < a.id){_BY}")
def dist_stretch(spark, sf_dir):
    return _by_point(_parts(spark, sf_dir), blocks.stretch_steps(_UNIT, 3.0))


@query(f"""with c as materialized ({_PART}), k as (select *, pow(x[1] - 0.1, 2) + pow(x[2] - 0.95, 2) <= pow(x[1] - 0.9, 2) + pow(x[2] - 1.85, 2) as side from c),
s as (select sum(a * n) / (sum(n) - 2) as a, sum(b * n) / (sum(n) - 2) as b, sum(c * n) / (sum(n) - 2) as c from (select side, count(*) as n, covar_pop(x[1], x[1]) as a, covar_pop(x[1], x[2]) as b, covar_pop(x[2], x[2]) as c from k group by 1)),
p as (select i.id as i, sqrt((s.c * pow(i.x[1] - j.x[1], 2) - 2 * s.b * (i.x[1] - j.x[1]) * (i.x[2] - j.x[2]) + s.a * pow(i.x[2] - j.x[2], 2)) / (s.a * s.c - s.b * s.b)) as d from c i join c j on j.id < i.id, s) select i, count(d) as n, round(sum(d), 5) as sum_d, round(max(d), 5) as max_d from p group by i""")
def dist_fisher(spark, sf_dir):
    p = blocks.by_point(projection.whitened(_parts(spark, sf_dir), [0.1, 0.95], [0.9, 1.85]), blocks.euclid_steps)
    return p.select("i", "n", F.round("sum_d", 5).alias("sum_d"), F.round("max_d", 5).alias("max_d"))


# ---------------------------------------------------------------- pairs, neighbours, landmarks


@query(f"with {_P} select floor(d / 1.9 * 50)::int as bin, count(*) as n from p group by 1")
def pair_histogram(spark, sf_dir):
    got = blocks.binned(vectors(spark, sf_dir), lambda t: np.floor(mapped.high(t) / 1.9 * 50), 64)
    return got.select(F.col("bin").cast("int").alias("bin"), F.col("count").alias("n"))


@query(f"with {_P}{_BOTH} select i, j, round(d, 6) as d, rank::int as rank from k where rank <= 6")
def knn_graph(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return joins.nearest_join(v, v, 6, same=True).select("i", "j", R6(F.col("d")).alias("d"), "rank")


@query(f"with {_P}{_BOTH} select distinct greatest(i, j) as i, least(i, j) as j, round(d, 6) as d from k where rank <= 6")
def knn_graph_undirected(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return pairs.undirected(joins.nearest_join(v, v, 6, same=True)).select("i", "j", R6(F.col("d")).alias("d"))


@query(f"with {_P}{_BOTH} select i as id, round(d, 6) as bandwidth from k where rank = 5")
def knn_bandwidth(spark, sf_dir):
    v = vectors(spark, sf_dir)
    near = joins.nearest_join(v, v, 5, same=True)
    return near.where("rank = 5").select(F.col("i").alias("id"), R6(F.col("d")).alias("bandwidth"))


@query(f"with {_P}{_BOTH} select i, j, rank::int as rank from k where (rank between 11 and 50 and (rank - 11) % 8 = 0) or (rank > 250 and (rank - 251) % 50 = 0)")
def strided_neighbours(spark, sf_dir):
    """Mid and far partners at fixed steps of rank."""
    return blocks.at_ranks(vectors(spark, sf_dir), lambda n: np.append(np.arange(11, min(n, 50) + 1, 8), np.arange(251, n + 1, 50)))


@query(f"with {_P} select i, j, round(d, 6) as d from p order by p.d desc, i, j limit 40")
def diameter_pins(spark, sf_dir):
    return blocks.farthest_pairs(vectors(spark, sf_dir), 40).select("i", "j", R6(F.col("d")).alias("d"))


@query(f"with {_P}, g as (select i from p where d < 1.2 union all select j from p where d < 1.2) select e.id, count(g.i) as degree from e left join g on g.i = e.id group by 1")
def radius_degree(spark, sf_dir):
    return blocks.degrees(vectors(spark, sf_dir), 1.2)


@query(f"with {_L}{_M}, b as (select id, min(struct_pack(d := sqrt(pow(q - lq, 2) + pow(p - lp, 2)), lid := lid)) as b from l, m group by 1) select id, b.lid as nearest, round(b.d, 6) as d from b")
def nearest_landmark(spark, sf_dir):
    got = pairs.nearest_landmark(line_points(spark, sf_dir), marks(spark, sf_dir))
    return got.select("id", "nearest", R6(F.col("d")).alias("d"))


@query(f"with {_L}{_M}, b as (select id, q, min(struct_pack(d := sqrt(pow(q - lq, 2) + pow(p - lp, 2)), lid := lid)) as b from l, m group by 1, 2), c as (select b.lid as lid, sum(q) as w from b group by 1), f as (select m.lid, sqrt(coalesce(w, 0)) as w from m left join c on c.lid = m.lid) select lid as id, round(w / sum(w) over (), 6) as weight from f")
def voronoi_mass(spark, sf_dir):
    rows = line_points(spark, sf_dir).withColumn("w", F.col("q"))
    return pairs.voronoi(rows, marks(spark, sf_dir), gamma=0.5).select("id", R6(F.col("weight")).alias("weight"))


_FPS = """with recursive e as materialized (select vec_id, embedding::double[] x from embeddings),
fps(step, pick, md) as (
  select 0, 0::bigint, (select list(list_distance(a.x, b.x) order by b.vec_id) from e a, e b where a.vec_id = 0)
  union all
  select step + 1, list_position(md, list_max(md)) - 1,
    (select list(least(f.md[b.vec_id + 1], list_distance(a.x, b.x)) order by b.vec_id)
       from e a, e b where a.vec_id = list_position(f.md, list_max(f.md)) - 1)
  from fps f where step < 9)
select step, pick::bigint as id from fps"""


@query(_FPS)
def farthest_point(spark, sf_dir):
    return pairs.farthest_points(vectors(spark, sf_dir), 10, 0)


@query("with r as (select vec_id as id, row_number() over (order by vec_id) - 1 as nr, count(*) over () as n from embeddings) select (nr / (n // 20))::int as ord, id from r where nr % (n // 20) = 0 and nr < (n // 20) * 20")
def stride_landmarks(spark, sf_dir):
    return pairs.stride_points(vectors(spark, sf_dir), 20)


# ---------------------------------------------------------------- scales and stress


@query(f"with {_P}, r as (select d, row_number() over (order by d) - 1 as r, count(*) over () as n, min(d) over () as d0, max(d) over () as d1 from p where d > 0) select round(max(d) filter (r = n * 25 // 100), 6) as q25, round(max(d) filter (r = n // 2), 6) as q50, round(max(d) filter (r = n * 75 // 100), 6) as q75, round(arg_max(d, abs((r + 1) / n - (d - d0) / (d1 - d0))), 6) as knee from r")
def scale_quantiles(spark, sf_dir):
    s = blocks.suggest_scale(vectors(spark, sf_dir))
    return s.select(*[R6(F.col(c)).alias(c) for c in ("q25", "q50", "q75", "knee")])


@query(f"with {_P} select round(avg(0.9 * pow(asinh(d / 1.4) / (2 * asinh(1)) - asinh(dl / 0.2) / (2 * asinh(1)), 2) + 0.1 * pow(d - dl, 2)), 6) as chi from p")
def chi_value(spark, sf_dir):
    return mapped.chi(placed_vectors(spark, sf_dir), Transfer("asinh", (1.4,)), Transfer("asinh", (0.2,)), 0.1).select(R6(F.col("chi")).alias("chi"))


@query(f"with {_P}, f as (select 1 - 1 / (1 + pow(d / 1.4, 2)) as fh, 1 - 1 / (1 + pow(dl / 0.2, 2)) as fl from p) select round(sum(fh * (1 - fh) * pow(fh - fl, 2)) / sum(fh * (1 - fh)), 6) as chi from f")
def chi_midscale(spark, sf_dir):
    high = Transfer("sigmoid", (1.4,))
    return mapped.chi(placed_vectors(spark, sf_dir), high, Transfer("sigmoid", (0.2,)), 0.0, mapped.midscale_weight(high)).select(R6(F.col("chi")).alias("chi"))


_XY = ", q as (select p.*, a.x[1] as xi, a.x[2] as yi, b.x[1] as xj, b.x[2] as yj from p join e a on a.id = i join e b on b.id = j)"


@query(f"with {_P}{_XY}, g as (select i as id, -2 * (d - dl) / greatest(dl, 1e-100) * (xi - xj) as gx, -2 * (d - dl) / greatest(dl, 1e-100) * (yi - yj) as gy from q union all select j, 2 * (d - dl) / greatest(dl, 1e-100) * (xi - xj), 2 * (d - dl) / greatest(dl, 1e-100) * (yi - yj) from q) select id, round(sum(gx) / (select count(*) from p), 6) as gx, round(sum(gy) / (select count(*) from p), 6) as gy from g group by 1")
def chi_gradient(spark, sf_dir):
    got = mapped.chi_gradient(placed_vectors(spark, sf_dir))
    return got.select("id", R6(F.col("gx")).alias("gx"), R6(F.col("gy")).alias("gy"))


@query(f"with {_P}{_XY} select round(sum(case when abs(xi - xj) <= 0.05 then pow(d - dl, 2) else 0 end) / sum(case when abs(xi - xj) <= 0.05 then 1 else 0 end), 6) as chi from q")
def chi_gap_weight(spark, sf_dir):
    got = mapped.chi(placed_vectors(spark, sf_dir), Transfer("identity"), Transfer("identity"), 0.0, mapped.gap_weight("u", 0.05))
    return got.select(R6(F.col("chi")).alias("chi"))


@query("select round(0.35 * (max(s_acctbal) - min(s_acctbal)), 6) as tau from supplier")
def gap_tau(spark, sf_dir):
    return stats.suggest_tau(table(spark, sf_dir, "supplier"), "s_acctbal").select(R6(F.col("tau")).alias("tau"))


_ALPHA = f"""with c as materialized ({_PART}), k as (select *, pow(x[1] - 0.1, 2) + pow(x[2] - 0.95, 2) <= pow(x[1] - 0.9, 2) + pow(x[2] - 1.85, 2) as side from c),
u as (select (0.1 - 0.9) / sqrt(pow(0.1 - 0.9, 2) + pow(0.95 - 1.85, 2)) as u, (0.95 - 1.85) / sqrt(pow(0.1 - 0.9, 2) + pow(0.95 - 1.85, 2)) as v),
p as materialized (select pow(a.x[1] - b.x[1], 2) + pow(a.x[2] - b.x[2], 2) as d2, pow((a.x[1] - b.x[1]) * u.u + (a.x[2] - b.x[2]) * u.v, 2) as along2, a.side = b.side as same from k a join k b on b.id < a.id, u)"""


@query(_ALPHA + ", g as (select n * 20 / 40::double as alpha from range(41) t(n)), f as (select alpha, same, greatest(1e-12, least(1 - 1e-12, 1 - 1 / (1 + pow(sqrt(d2 + alpha * along2) / 0.8, 2)))) as f from p, g where along2 > 0) select alpha, round(sum(case when same then -ln(1 - f) else -ln(f) end), 4) as loss from f group by 1")
def alpha_grid(spark, sf_dir):
    return mapped.alpha_losses(_parts(spark, sf_dir), [0.1, 0.95], [0.9, 1.85], Transfer("sigmoid", (0.8,)), 40).select("alpha", F.round("loss", 4).alias("loss"))


@query(_ALPHA + ", v as (select (0.64 - d2) / along2 as v, row_number() over (order by (0.64 - d2) / along2) - 1 as r, count(*) over () as n from p where not same and along2 > 0 and d2 < 0.64) select coalesce(round(max(v) filter (r = n // 2), 6), 0)::double as alpha, count(*) as n_used from v")
def alpha_plugin(spark, sf_dir):
    return mapped.plugin_alpha(_parts(spark, sf_dir), [0.1, 0.95], [0.9, 1.85], 0.8).select(R6(F.col("alpha")).alias("alpha"), "n_used")


@query(f"with {_P}{_BOTH}, b as materialized (select i, d as b from k where rank = 5), w as (select p.i, p.j, ((case when pow(d / x.b, 10) >= 60 then 0 else exp(-pow(d / x.b, 10)) end) + (case when pow(d / y.b, 10) >= 60 then 0 else exp(-pow(d / y.b, 10)) end)) / 2 as w from p join b x on x.i = p.i join b y on y.i = p.j) select i, j, round(w, 6) as w from w where w > 0")
def phate_kernel(spark, sf_dir):
    return mapped.phate_kernel(vectors(spark, sf_dir), bandwidths(spark, sf_dir), 10.0).select("i", "j", R6(F.col("w")).alias("w"))


# ---------------------------------------------------------------- histograms and free energy


@query("with b as (select case when o_totalprice < 20000 then -1 when o_totalprice >= 300000 then 40 else least(floor((o_totalprice - 20000) / 280000 * 40), 39) end::int as bin from orders), g as (select bin, count(*)::double as count from b group by 1) select n::int as bin, coalesce(count, 0)::double as count from range(-1, 41) t(n) left join g on g.bin = n")
def histogram_1d(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 20000.0, 300000.0, 40)


_HIST = f"{_L}, c as (select floor((p - 0.1) / 0.8 * 16)::int as iy, floor((q - 0.1) / 0.8 * 16)::int as ix from l where q >= 0.1 and q < 0.9 and p >= 0.1 and p < 0.9), h as materialized (select n // 16 as iy, n % 16 as ix, (select count(*) from c where c.iy = n // 16 and c.ix = n % 16)::double as count from range(256) t(n))"
_BOX = (0.1, 0.9, 0.1, 0.9)


@query(f"with {_HIST} select iy::int as iy, ix::int as ix, count from h")
def histogram_2d(spark, sf_dir):
    return stats.histogram2d(lines(spark, sf_dir), "q", "p", _BOX, 16, 16)


@query(f"with {_HIST} select iy::int as iy, ix::int as ix, round(0.1 + (ix + 0.5) * (0.9 - 0.1) / 16, 6) as x, round(0.1 + (iy + 0.5) * (0.9 - 0.1) / 16, 6) as y, case when count > 0 then round(-0.6 * ln(count / (select max(count) from h)) + 0.0, 6) end as f, round(count / ((select sum(count) from h) * 0.0025), 6) as rho from h")
def free_energy_grid(spark, sf_dir):
    h = stats.histogram2d(lines(spark, sf_dir), "q", "p", _BOX, 16, 16)
    return stats.free_energy(h, _BOX, 16, 16, 0.6).select("iy", "ix", *[(R6(F.col(c)) + 0.0).alias(c) for c in ("x", "y", "f", "rho")])


@query(f"with {_HIST}, w as (select o, exp(-o * o / 2.0::double) as r from range(-3, 4) t(o)), k as (select o, r / (select sum(r) from w) as k from w) select a.iy::int as iy, a.ix::int as ix, round(sum(b.count * kx.k * ky.k), 6) as count from h a join k kx on true join k ky on true join h b on b.ix = a.ix - kx.o and b.iy = a.iy - ky.o group by 1, 2")
def blurred_histogram(spark, sf_dir):
    h = stats.histogram2d(lines(spark, sf_dir), "q", "p", _BOX, 16, 16)
    return stats.blurred(h, 1.0).select("iy", "ix", R6(F.col("count")).alias("count"))


@query(f"with {_P} select case when d < 1.63 and dl < 0.61 then floor(d / 1.63 * 30)::int end as ih, case when d < 1.63 and dl < 0.61 then floor(dl / 0.61 * 30)::int end as il, count(*) as count from p group by 1, 2")
def joint_histogram(spark, sf_dir):
    return mapped.joint_histogram(placed_vectors(spark, sf_dir), 30, 1.63, 0.61)


@query(f"with {_A} select a.frame, a.atom, count(b.atom) as cn from a left join a b on a.frame = b.frame and a.atom <> b.atom and pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) < 2.25 group by 1, 2")
def coordination_numbers(spark, sf_dir):
    return stats.coordination(atoms(spark, sf_dir), 1.5)


@query(f"with {_A}, n as (select a.frame, a.atom, count(b.atom) as cn from a left join a b on a.frame = b.frame and a.atom <> b.atom and pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) < 2.25 group by 1, 2) select r.cn::bigint as cn, count(n.cn) as count from range((select max(cn) + 1 from n)) r(cn) left join n on n.cn = r.cn group by 1")
def coordination_histogram(spark, sf_dir):
    return stats.coordination_histogram(stats.coordination(atoms(spark, sf_dir), 1.5))


@query(f"with {_L}, c as (select floor((p - 0.1) / 0.8 * 16)::int as iy, floor((q - 0.1) / 0.8 * 16)::int as ix, s from l where q >= 0.1 and q < 0.9 and p >= 0.1 and p < 0.9) select iy, ix, round(min(s), 6) as least, round(avg(s), 6) as mean, count(*) as n from c group by 1, 2")
def cell_summary(spark, sf_dir):
    got = stats.cell_summary(lines(spark, sf_dir), "q", "p", "s", _BOX, 16, 16)
    return got.select("iy", "ix", R6(F.col("least")).alias("least"), R6(F.col("mean")).alias("mean"), "n")


# ---------------------------------------------------------------- scores of a map


@query(f"with {_P}, q as (select quantile_cont(d, 0.25) as q25, quantile_cont(d, 0.75) as q75 from p), f as (select d, dl, row_number() over (order by d) as rd, row_number() over (order by dl) as rl from p, q where d >= q75) select (select round(corr(d, dl), 6) from f) as far_pearson, (select round(corr(rd, rl), 6) from f) as far_spearman, (select round(sqrt(avg(pow(d - dl, 2))), 6) from p, q where d <= q25) as near_rms")
def map_correlations(spark, sf_dir):
    return mapped.correlations(placed_vectors(spark, sf_dir)).select(*[R6(F.col(c)).alias(c) for c in ("far_pearson", "far_spearman", "near_rms")])


@query(f"with {_P}, g as (select i, j, d, dl from p union all select j, i, d, dl from p), k as (select i, j, row_number() over (partition by i order by d, j) as a, row_number() over (partition by i order by dl, j) as b from g) select round(count(*) filter (a <= 10 and b <= 10) / (10 * count(distinct i)), 6) as overlap from k")
def neighbour_overlap(spark, sf_dir):
    v = placed_vectors(spark, sf_dir)
    flat = v.select("id", F.array("u", "v").alias("x"))
    return stats.shared_neighbours(v, joins.nearest_join(v, v, 10, same=True), joins.nearest_join(flat, flat, 10, same=True), 10).select(R6(F.col("overlap")).alias("overlap"))


@query("select s_suppkey as id, round((row_number() over (order by s_acctbal, s_suppkey) - 1) / (count(*) over () - 1), 6) as acct, round((row_number() over (order by s_nationkey, s_suppkey) - 1) / (count(*) over () - 1), 6) as nation from supplier")
def rank_uniform(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("acct"), F.col("s_nationkey").cast("double").alias("nation"))
    return stats.rank_uniform(s, ("acct", "nation")).select("id", R6(F.col("acct")).alias("acct"), R6(F.col("nation")).alias("nation"))


@query(f"with {_L}, c as (select flag, avg(q) as mq, avg(p) as mp from l group by 1), s as (select l.flag, avg(sqrt(pow(q - mq, 2) + pow(p - mp, 2))) as s from l join c on c.flag = l.flag group by 1) select a.flag as a, b.flag as b, round(sqrt(pow(a.mq - b.mq, 2) + pow(a.mp - b.mp, 2)), 6) as gap, round((x.s + y.s) / 2, 6) as spread, round(sqrt(pow(a.mq - b.mq, 2) + pow(a.mp - b.mp, 2)) / ((x.s + y.s) / 2), 6) as ratio from c a join c b on a.flag < b.flag join s x on x.flag = a.flag join s y on y.flag = b.flag")
def label_separation(spark, sf_dir):
    return stats.separation(lines(spark, sf_dir), ("q", "p"), "flag").select("a", "b", R6(F.col("gap")).alias("gap"), R6(F.col("spread")).alias("spread"), R6(F.col("ratio")).alias("ratio"))


# ---------------------------------------------------------------- placement


@query(f"with {_L}, d as (select id, sqrt(pow(q - 0.1137, 2) + pow(p - 0.0971, 2)) as da, sqrt(pow(q - 0.8951, 2) + pow(p - 0.7313, 2)) as db from l) select id, round(da / (da + db), 6) as xi, round(da / (da + db) * (1 - da / (da + db)), 6) as well from d")
def basin_coordinate(spark, sf_dir):
    return projection.basin_coordinate(line_points(spark, sf_dir), [0.1137, 0.0971], [0.8951, 0.7313]).select("id", R6(F.col("xi")).alias("xi"), R6(F.col("well")).alias("well"))


@query(f"with {_L} select id, round(((q - 0.1137) * 0.7814 + (p - 0.0971) * 0.6342) / (pow(0.7814, 2) + pow(0.6342, 2)), 6) as s1, round(abs((q - avg(q) over ()) * 0.6342 - (p - avg(p) over ()) * 0.7814) / sqrt(pow(0.7814, 2) + pow(0.6342, 2)), 6) as r1 from l")
def axis_projection(spark, sf_dir):
    got = projection.axis_coordinates(line_points(spark, sf_dir), [0.1137, 0.0971], [0.8951, 0.7313], 1)
    return got.select("id", R6(F.col("s1")).alias("s1"), R6(F.abs("r1")).alias("r1"))


@query(f"with {_L}{_M} select id, round(sum(exp(-sqrt(pow(q - lq, 2) + pow(p - lp, 2)) / 0.1) * lw * px) / sum(exp(-sqrt(pow(q - lq, 2) + pow(p - lp, 2)) / 0.1) * lw), 6) as px, round(sum(exp(-sqrt(pow(q - lq, 2) + pow(p - lp, 2)) / 0.1) * lw * py) / sum(exp(-sqrt(pow(q - lq, 2) + pow(p - lp, 2)) / 0.1) * lw), 6) as py from l, m group by id")
def path_projection(spark, sf_dir):
    got = projection.path_average(line_points(spark, sf_dir), marks(spark, sf_dir), 0.1, ("px", "py"))
    return got.select("id", R6(F.col("px")).alias("px"), R6(F.col("py")).alias("py"))


_NEAR = f"with {_L}{_M}, n as (select id, lid, px, py, sqrt(pow(q - lq, 2) + pow(p - lp, 2)) as d, row_number() over (partition by id order by sqrt(pow(q - lq, 2) + pow(p - lp, 2)), lid) as r from l, m)"


@query(_NEAR + " select id, round(sum(px / (d + 1e-8)) / sum(1 / (d + 1e-8)), 6) as px, round(sum(py / (d + 1e-8)) / sum(1 / (d + 1e-8)), 6) as py from n where r <= 5 group by id")
def knn_projection(spark, sf_dir):
    got = projection.knn_average(line_points(spark, sf_dir), marks(spark, sf_dir), 5, ("px", "py"))
    return got.select("id", R6(F.col("px")).alias("px"), R6(F.col("py")).alias("py"))


@query(_NEAR + ", w as (select *, max(case when r = 5 then d end) over (partition by id) as eps from n), v as (select *, case when pow(d / greatest(eps, 1e-12), 4) >= 60 then 0 else exp(-pow(d / greatest(eps, 1e-12), 4)) end as w from w) select id, round(sum(w * px) / sum(w), 6) as px, round(sum(w * py) / sum(w), 6) as py from v group by id")
def affinity_projection(spark, sf_dir):
    got = projection.affinity_average(line_points(spark, sf_dir), marks(spark, sf_dir), 5, 4.0, ("px", "py"))
    return got.select("id", R6(F.col("px")).alias("px"), R6(F.col("py")).alias("py"))


@query(f"with {_L}, d as (select id, sqrt(pow(q - 0.1137, 2) + pow(p - 0.0971, 2)) as da, sqrt(pow(q - 0.8951, 2) + pow(p - 0.7313, 2)) as db from l) select id, round((da * da - db * db + 1.0) / 2, 6) as x, round(sqrt(greatest(da * da - pow((da * da - db * db + 1.0) / 2, 2), 0)), 5) as y from d")
def trilateration(spark, sf_dir):
    d = line_points(spark, sf_dir).withColumn("a", F.array(F.lit(0.1137), F.lit(0.0971))).withColumn("b", F.array(F.lit(0.8951), F.lit(0.7313)))
    d = d.select("id", metrics.euclid("x", "a", 2).alias("da"), metrics.euclid("x", "b", 2).alias("db"))
    return projection.trilateration(d, "da", "db", 1.0).select("id", R6(F.col("x")).alias("x"), F.round("y", 5).alias("y"))


@query(f"with {_L}, m as (select sum(q * s) / sum(s) as mq, sum(p * s) / sum(s) as mp from l) select id, round(q - mq, 6) as q, round(p - mp, 6) as p from l, m")
def weighted_centring(spark, sf_dir):
    got = projection.centred(lines(spark, sf_dir), ("q", "p"), "s")
    return got.select("id", R6(F.col("q")).alias("q"), R6(F.col("p")).alias("p"))


@query(f"with {_L}, c as (select covar_pop(q, q) as a, covar_pop(q, p) as b, covar_pop(p, p) as c from l) select round((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b), 6) as v1, round((a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b), 6) as v2 from c")
def principal_variances(spark, sf_dir):
    """Variances of classical scaling in two dimensions, from the sums of one pass."""
    got = projection.principal(line_points(spark, sf_dir), 2, 2)
    return spark.createDataFrame([got.variance], "v1 double, v2 double").select(R6(F.col("v1")).alias("v1"), R6(F.col("v2")).alias("v2"))


def _leading_axis(name: str, squares: int = 13) -> str:
    """SQL of the leading unit vector <name>v of a symmetric matrix <name>0 (i, row), by squaring it again and again."""
    steps = ", ".join(
        f"{name}{k + 1} as materialized (select x.i, list(list_dot_product(x.row, y.row) / t.t order by y.i) as row from {name}{k} x cross join {name}{k} y cross join (select sum(list_dot_product(row, row)) as t from {name}{k}) t group by x.i)" for k in range(squares)
    )
    unit = "list_transform(row, lambda t: t / sqrt(list_dot_product(row, row)))"
    return steps + f", {name}v as materialized (select list_transform(u, lambda t: t * sign(list_filter(u, lambda f: abs(f) > 1e-12)[1])) as v from (select {unit} as u from {name}{squares} order by row[i] desc limit 1))"


_MAP = (
    f"with {_P}, u as (select id, unnest(x) as v, generate_subscripts(x, 1) as k from e), mu as (select k, avg(v) as m from u group by k), z as materialized (select u.id, u.k, v - m as v from u join mu on mu.k = u.k), c0 as materialized (select i, list(c order by j) as row from (select a.k as i, b.k as j, sum(a.v * b.v) as c from z a join z b on a.id = b.id group by 1, 2) group by i), "
    + _leading_axis("c")
    + ", top as (select sum(v[i] * list_dot_product(row, v)) as l from c0, cv), d0 as materialized (select i, list_transform(row, lambda t, k: t - l * v[i] * v[k]) as row from c0, cv, top), "
    + _leading_axis("d")
    + ", y as materialized (select id, sum(z.v * cv.v[k]) as a, sum(z.v * dv.v[k]) as b from z, cv, dv group by id)"
)


@query(_MAP + " select id, round(a, 6) as x, round(b, 6) as y from y")
def classical_scaling(spark, sf_dir):
    """Coordinates of all vectors on the two axes of largest variance."""
    v = vectors(spark, sf_dir)
    x, y = projection.principal(v, 64, 2).columns()
    return v.select("id", R6(x).alias("x"), R6(y).alias("y"))


@query()
def map_placement(spark, sf_dir):
    """Line items placed on the map of the landmarks by least stress."""
    s = Transfer("asinh", (0.3,))
    f = lambda d: np.arcsinh(d / s.params[0]) / (2 * np.arcsinh(1))
    m = marks(spark, sf_dir).withColumn("px", F.get("x", F.lit(0))).withColumn("py", F.get("x", F.lit(1)))
    return projection.place_on_map(line_points(spark, sf_dir), m, f, f, 1.2)


@query(f"with {_L}, n as (select q, p from l order by abs(q - 0.5137) + abs(p - 0.4971), id limit 20) select round(avg(q), 6) as q, round(avg(p), 6) as p, count(*) as n from n")
def reference_match(spark, sf_dir):
    got = projection.nearest_rows(line_points(spark, sf_dir), [0.5137, 0.4971], ("q", "p"))
    return got.select(R6(F.col("q")).alias("q"), R6(F.col("p")).alias("p"), "n")


# ---------------------------------------------------------------- graphs, grids, fields


def _network(spark, sf_dir):
    v = vectors(spark, sf_dir)
    edges = kept(pairs.undirected(joins.nearest_join(v, v, 3, same=True)))
    energy = v.select("id", F.get("x", F.lit(0)).alias("e"))
    return v, edges, energy


_NET = f"with {_P}{_BOTH}, u as (select distinct greatest(i, j) as i, least(i, j) as j, d from k where rank <= 3), c as (select u.i, u.j, u.d, a.x[1] as ei, b.x[1] as ej from u join e a on a.id = i join e b on b.id = j)"


@query(_NET + " select i, j, round(abs(ei - ej) + 2 * d, 6) as cost, round(greatest(ei, ej) + 2 * d, 6) as height, round(exp(-(abs(ei - ej) + 2 * d) / 0.7), 6) as w from c")
def edge_costs(spark, sf_dir):
    _, edges, energy = _network(spark, sf_dir)
    c = graph.edge_costs(edges, energy, 2.0)
    w = graph.boltzmann(c, 0.7)
    return c.join(w, ["i", "j"]).select("i", "j", *[R6(F.col(x)).alias(x) for x in ("cost", "height", "w")])


@query(_NET.replace("with ", "with recursive ", 1) + ", w as (select i as a, j as b from u union select j, i from u), r(id, c) as (select id, id from e union select w.b, r.c from r join w on w.a = r.id where r.c < w.b) select id, min(c) as component from r group by id")
def graph_components(spark, sf_dir):
    v, edges, _ = _network(spark, sf_dir)
    return graph.components(v, edges)


@query(_NET.replace("with ", "with recursive ", 1) + ", w as (select i as a, j as b, ei, ej, greatest(ei, ej) + 2 * d as height from c union all select j, i, ej, ei, greatest(ei, ej) + 2 * d from c), t as (select a, min(struct_pack(h := height, e := ej, b := b)).b as p from w where ej < ei group by a), s as materialized (select id, coalesce(p, id) as p from e left join t on t.a = e.id), r(id, p) as (select id, p from s union select r.id, s.p from r join s on s.id = r.p) select r.id, r.p as basin from r join s on s.id = r.p where s.p = s.id")
def energy_basins(spark, sf_dir):
    _, edges, energy = _network(spark, sf_dir)
    return graph.basins(graph.edge_costs(edges, energy, 2.0), energy)


@query()
def graph_committor(spark, sf_dir):
    """Committor of the Metropolis walk from vector 0 to vector 1."""
    _, edges, energy = _network(spark, sf_dir)
    q = solvers.committor(solvers.metropolis_conductance(graph.edge_costs(edges, energy, 2.0), 0.7), [0], [1])
    return q.select("id", R6(F.col("q")).alias("q"))


@query("with e as (select vec_id as id, embedding[1]::double as e from embeddings), r as (select id, sum(exp((greatest(e, p) - (select min(e) from e)) / 0.7)) over (order by id) as r from (select id, e, lag(e) over (order by id) as p from e) where p is not null) select e.id, round(coalesce(r, 0) / (select max(r) from r), 6) as q from e left join r on r.id = e.id")
def chain_committor(spark, sf_dir):
    """Committor along the chain of all vectors in the order of their ids: resistances of edges in series."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("e"))
    ends = e.agg(F.min("id"), F.max("id")).first()
    ranks = kept(numbered(e))
    after = ranks.select((F.col("nr") - 1).alias("nr"), F.col("id").alias("j"), F.col("e").alias("ej"))
    costs = ranks.select("nr", F.col("id").alias("i"), F.col("e").alias("ei")).join(after, "nr")
    q = solvers.committor(solvers.metropolis_conductance(costs, 0.7), [ends[0]], [ends[1]])
    return q.select("id", R6(F.col("q")).alias("q"))


def _forest(spark, sf_dir):
    v, edges, energy = _network(spark, sf_dir)
    heights = kept(graph.edge_costs(edges, energy, 2.0))
    return v.select("id"), heights, energy, trees.spanning_forest(v.select("id"), heights, "height")


_RANKED = _NET.replace("with ", "with recursive ", 1) + ", h as materialized (select i, j, greatest(ei, ej) + 2 * d as w, row_number() over (order by greatest(ei, ej) + 2 * d, i, j) as nr from c), w as materialized (select i as a, j as b, nr, w from h union all select j, i, nr, w from h)"
_MST = _RANKED + ", r(nr, i, j, node) as (select nr, i, j, i from h union select r.nr, r.i, r.j, w.b from r join w on w.a = r.node and w.nr < r.nr), t as materialized (select i, j, w from h where nr not in (select nr from r where node = j))"


@query(_MST + " select i, j, round(w, 6) as w from t")
def spanning_forest(spark, sf_dir):
    """The edges by which the network's pieces merge as the level rises."""
    return _forest(spark, sf_dir)[3].select("i", "j", R6(F.col("w")).alias("w"))


_LEVELS = [0.8, 1.6, 2.0, 2.4]


@query(_RANKED + f", v as (select unnest({_LEVELS})::double as level), r(level, id, c) as (select level, id, id from v, e union select r.level, w.b, r.c from r join w on w.a = r.id and w.w <= r.level where r.c < w.b) select level, id, min(c) as basin from r group by 1, 2")
def superbasins(spark, sf_dir):
    nodes, _, _, forest = _forest(spark, sf_dir)
    return trees.superbasins(nodes, forest, _LEVELS)


@query(_RANKED + f", v as (select unnest({_LEVELS})::double as level), r(level, id, node) as (select level, id, id from v, e union select r.level, r.id, w.b from r join w on w.a = r.node and w.w <= r.level), f as (select r.id, min(r.level) as level from r join e a on a.id = r.id join e b on b.id = r.node where (b.x[1], b.id) < (a.x[1], a.id) group by 1) select e.id, f.level from e left join f on f.id = e.id")
def escape_levels(spark, sf_dir):
    """The first level at which each vector's basin has one of lower energy."""
    nodes, _, energy, forest = _forest(spark, sf_dir)
    return trees.escape_levels(nodes, trees.superbasins(nodes, forest, _LEVELS), energy)


_PATHS = _RANKED + ", r(source, id, cost) using key (source, id) as (select id, id, {zero}::double from e where id in (0, 7, 19) union select n.source, n.id, n.cost from (select r.source, w.b as id, min({step}) as cost from r join w on w.a = r.id group by 1, 2) n left join recurring.r o on o.source = n.source and o.id = n.id where o.id is null or n.cost < o.cost) select source, id, round(cost, 6) as {name} from r where id <> source"


@query(_PATHS.format(zero="-1e308", step="greatest(r.cost, w.w)", name="saddle"))
def saddle_heights(spark, sf_dir):
    """The lowest pass from three vectors to all others, along the spanning forest."""
    forest = _forest(spark, sf_dir)[3]
    got = trees.path_costs(forest, spark.createDataFrame([(0,), (7,), (19,)], "id long"), combine="max")
    return got.where("source <> id").select("source", "id", R6(F.col("cost")).alias("saddle"))


@query(_PATHS.replace("greatest(ei, ej) + 2 * d as w", "d as w").format(zero="0", step="r.cost + w.w", name="geodesic"))
def graph_geodesics(spark, sf_dir):
    """Distances from three landmarks to all vectors along the network."""
    _, edges, _ = _network(spark, sf_dir)
    got = trees.path_costs(edges, spark.createDataFrame([(0,), (7,), (19,)], "id long"), "d")
    return got.where("source <> id").select("source", "id", R6(F.col("cost")).alias("geodesic"))


_STITCH = "with recursive {p}{both}, k3 as materialized (select distinct greatest(i, j) as i, least(i, j) as j, d from k where rank <= 2), o as materialized (select i as a, j as b from k3 union all select j, i from k3), l(id, c) as (select id, id from e union select o.b, l.c from l join o on o.a = l.id where l.c < o.b), c as materialized (select id, min(c) as c from l group by id), h as materialized (select i, j, d, a.c as ci, b.c as cj, row_number() over (order by d, i, j) as nr from p join c a on a.id = i join c b on b.id = j where a.c <> b.c qualify row_number() over (partition by least(a.c, b.c), greatest(a.c, b.c) order by d, i, j) = 1), w as materialized (select ci as a, cj as b, nr from h union all select cj, ci, nr from h), r(nr, cj, node) as (select nr, cj, ci from h union select r.nr, r.cj, w.b from r join w on w.a = r.node and w.nr < r.nr)"


@query(_STITCH.format(p=_P, both=_BOTH) + " select i, j, round(d, 6) as d, false as added from k3 union all select i, j, round(d, 6), true from h where nr not in (select nr from r where node = cj)")
def stitched_network(spark, sf_dir):
    """The graph of two neighbours each, its pieces joined by the shortest pairs between them."""
    v = vectors(spark, sf_dir)
    own = kept(pairs.undirected(joins.nearest_join(v, v, 2, same=True)))
    return trees.stitched_by_distance(v, own).select("i", "j", R6(F.col("d")).alias("d"), "added")


@query(f"with {_HIST}, f as (select iy, ix, -ln(count) as v from h where count > 0) select a.iy::int as iy, a.ix::int as ix, round(a.v, 6) as f from f a where not exists (select 1 from f b where abs(a.iy - b.iy) <= 1 and abs(a.ix - b.ix) <= 1 and (a.iy <> b.iy or a.ix <> b.ix) and (b.v < a.v or b.v = a.v and (b.iy < a.iy or b.iy = a.iy and b.ix < a.ix)))")
def grid_minima(spark, sf_dir):
    h = stats.histogram2d(lines(spark, sf_dir), "q", "p", _BOX, 16, 16)
    f = h.select("iy", "ix", F.when(F.col("count") > 0, -F.ln("count")).alias("f"))
    return graph.local_minima(f).select("iy", "ix", R6(F.col("f")).alias("f"))


_BODY = f"with recursive {_HIST}, t as (select max(count) as top from h), g as materialized (select iy, ix, iy * 16 + ix as id from h, t where count > 0.2 * top), r(id, c) as (select id, id from g union select b.id, r.c from r join g a on a.id = r.id join g b on abs(a.iy - b.iy) + abs(a.ix - b.ix) = 1 where r.c < b.id)"


@query(_BODY + " select g.iy::int as iy, g.ix::int as ix, min(c)::bigint as body from r join g on g.id = r.id group by 1, 2")
def grid_bodies(spark, sf_dir):
    h = stats.histogram2d(lines(spark, sf_dir), "q", "p", _BOX, 16, 16)
    top = h.agg(F.max("count").alias("top"))
    return graph.bodies(h.crossJoin(F.broadcast(top)).where("count > 0.2 * top").select("iy", "ix"), 16)


@query(f"with g as (select n // 20 as iy, n % 20 as ix, (n % 20) * 2.5::double as x, 900 + (n // 20) * 50.0::double as y from range(400) t(n)), s as (select p_partkey as id, p_size::double as x, p_retailprice as y, p_partkey % 97 / 97.0::double as v from part), m as (select iy, ix, id, v, sqrt(pow(g.x - s.x, 2) + pow(g.y - s.y, 2)) as d from g, s), k as (select *, row_number() over (partition by iy, ix order by d, id) as r from m where d <= 30), f as (select iy, ix, sum(v / pow(d + 1e-9, 2)) / sum(1 / pow(d + 1e-9, 2)) as f from k where r <= 6 group by 1, 2) select g.iy::int as iy, g.ix::int as ix, round(f, 6) as f from g left join f on f.iy = g.iy and f.ix = g.ix")
def distance_fill(spark, sf_dir):
    g = spark.range(400).select((F.col("id") / 20).cast("int").alias("iy"), (F.col("id") % 20).cast("int").alias("ix"))
    g = g.select("iy", "ix", (F.col("ix") * 2.5).cast("double").alias("x"), (900 + F.col("iy") * 50.0).cast("double").alias("y"))
    s = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 97 / F.lit(97.0)).alias("v"))
    return graph.inverse_distance_fill(g, s, 6, 30.0).select("iy", "ix", R6(F.col("f")).alias("f"))


# ---------------------------------------------------------------- structures


@query(f"with {_AP} select a.frame, round(coalesce(sum(d), 0), 6) as total, round(min(d), 6) as least, round(max(d), 6) as most, count(d) as n from (select distinct frame from a) a left join ap on ap.frame = a.frame group by 1")
def frame_distances(spark, sf_dir):
    x = structures.sorted_distances(atoms(spark, sf_dir))
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    return x.select("frame", R6(total).alias("total"), R6(F.try_element_at("x", F.lit(1))).alias("least"), R6(F.try_element_at("x", F.lit(-1))).alias("most"), F.size("x").cast("long").alias("n"))


@query(f"with {_AP} select a.frame, round(case when count(*) filter (d <= 0) = 0 then coalesce(sum(4 * (pow(d, -12) - pow(d, -6))), 0) end, 6) as e from (select distinct frame from a) a left join ap on ap.frame = a.frame group by 1")
def frame_energy(spark, sf_dir):
    return structures.lennard_jones(atoms(spark, sf_dir)).select("frame", R6(F.col("e")).alias("e"))


_SW = "case when d <= 1.25 then 1 when d < 1.5 then pow((d - 1.25) / 0.25 - 1, 2) * (2 * (d - 1.25) / 0.25 + 1) else 0 end"


_CN = ", ".join(f"round(sum(exp(-0.5 * pow((cn - {k}) / 0.5, 2))), 6) as n{k}" for k in range(4, 14))


@query(f"with {_AP}, s as (select frame, a as atom, {_SW} as s from ap union all select frame, b, {_SW} from ap), c as (select a.frame, a.atom, coalesce(sum(s.s), 0) as cn from a left join s on s.frame = a.frame and s.atom = a.atom group by 1, 2) select frame, {_CN} from c group by 1")
def coordination_vector(spark, sf_dir):
    got = structures.coordination_vector(atoms(spark, sf_dir))
    return got.select("frame", *[R6(F.col(c)).alias(c) for c in got.columns if c != "frame"])


@query(f"select [round(l_quantity / 10, 0) + 0.0, round(l_discount * 10, 0) + 0.0]::double[] as site, min(struct_pack(v := l_extendedprice, id := {_ID})).id as id, round(min(l_extendedprice), 6) as value, count(*) as members from lineitem group by 1")
def unique_sites(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.expr(_ID).alias("id"), F.array(F.col("l_quantity") / 10, F.col("l_discount") * 10).alias("x"), "l_extendedprice")
    got = structures.unique_rows(li, "x", 0, "l_extendedprice")
    return got.select("site", "id", R6(F.col("value")).alias("value"), "members")


@query(f"with {_A} select frame, atom, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z from (select frame, row_number() over (partition by frame order by atom) - 1 as atom, x, y, z from a)")
def frame_round_trip(spark, sf_dir):
    """Atoms flattened to one array a frame and unflattened again."""
    got = structures.unflattened(structures.positions(atoms(spark, sf_dir)))
    return got.select("frame", "atom", *[R6(F.col(c)).alias(c) for c in "xyz"])


@query()
def coulomb_spectrum(spark, sf_dir):
    return structures.coulomb_spectrum(atoms(spark, sf_dir)).select("frame", F.transform("x", lambda v: F.round(v, 6)).alias("x"))


def _moments(x: str) -> list:
    """Number, sum and sum of squares of a spectrum: those of the matrix."""
    power = lambda p: F.round(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.pow(v, p)), 4) + 0.0
    return [F.size(x).cast("long").alias("n"), power(1).alias("m1"), power(2).alias("m2")]


@query(f"with {_AP}, n as (select frame, count(*) as n from a group by 1), m as (select frame, min(d) as least, 2 * sum(case when d > 0 then pow(d, -2) end) as m2 from ap group by 1) select n.frame, case when least = 0 then null else n end as n, case when least = 0 then null else 0.0::double end as m1, case when least = 0 then null else coalesce(round(m2, 4), 0) end as m2 from n left join m on m.frame = n.frame")
def coulomb_moments(spark, sf_dir):
    """The sums that a matrix of inverse distances fixes, from its eigenvalues."""
    return structures.coulomb_spectrum(atoms(spark, sf_dir)).select("frame", *[F.when(F.col("x").isNotNull(), c).alias(n) for c, n in zip(_moments("x"), ("n", "m1", "m2"), strict=True)])


@query(f"with {_AP}, n as (select frame, count(*) as n from a group by 1), m as (select frame, 2 * sum(pow(d, 4)) as m2 from ap group by 1) select n.frame, n, 0.0::double as m1, coalesce(round(m2, 4), 0) as m2 from n left join m on m.frame = n.frame")
def squared_distance_moments(spark, sf_dir):
    return structures.squared_distance_spectrum(atoms(spark, sf_dir)).select("frame", *_moments("x"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joint histogram of distances before and after classical scaling to two dimensions."""
    v = vectors(spark, sf_dir)
    x, y = projection.principal(v, 64, 2).columns()
    return mapped.joint_histogram(v.select("id", "x", x.alias("u"), y.alias("v")), 40, 2.0, 1.5)


query(_MAP + ", q as (select d as dh, sqrt(pow(s.a - t.a, 2) + pow(s.b - t.b, 2)) as dl from p join y s on s.id = p.i join y t on t.id = p.j) select case when dh < 2.0 and dl < 1.5 then floor(dh / 2.0 * 40)::int end as ih, case when dh < 2.0 and dl < 1.5 then floor(dl / 1.5 * 40)::int end as il, count(*) as count from q group by 1, 2")(flagship)

# registers its own queries; at the end, as it uses the tables above
from chartwork.plans import maps  # noqa: E402, F401

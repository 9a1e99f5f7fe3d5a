"""Readers and writers of the text formats, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names of the stored free-energy and histogram tables
FES_HEADER, CN_HEADER = "# x y F rho", "# cn count"


def _fields(value: str = "value") -> Column:
    return F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), " ")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither blank nor comments; ids follow the order of files and lines."""
    raw = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("id"))
    return raw.where(~F.col("value").rlike(r"^\s*(#|$)"))


def _finite(x: Column) -> Column:
    return F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def read_points(spark: SparkSession, path: str, dim: int, weighted: bool = False) -> DataFrame:
    """(id, x, w) of a table of ``dim`` numbers a line, then a weight if ``weighted``.

    A line with other than that many numbers, a number that isn't finite or a negative weight fails the job.
    """
    need = dim + weighted
    rows = _lines(spark, path).select("id", F.transform(_fields(), lambda v: v.try_cast("double")).alias("v"))
    fine = (F.size("v") == need) & _finite(F.col("v"))
    if weighted:
        fine = fine & (F.element_at("v", need) >= 0)
    checked = rows.withColumn("v", F.when(fine, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("not a point: "), F.to_json(F.struct("id", "v"))))))
    return checked.select("id", F.slice("v", 1, dim).alias("x"), (F.element_at("v", need) if weighted else F.lit(None).cast("double")).alias("w"))


def write_points(df: DataFrame, path: str, weighted: bool = False) -> None:
    """Lines in the order of id, numbers in their shortest exact form."""
    text = F.array_join(F.transform("x", lambda v: v.cast("string")), " ")
    line = F.concat(text, F.lit(" "), F.coalesce("w", F.lit(1.0)).cast("string")) if weighted else text
    df.orderBy("id").select(line.alias("value")).write.text(path)


def write_plumed(landmarks: DataFrame, path: str, dim: int, low: int = 2, name: str = "MAP") -> None:
    """Landmarks (id, x, place array, w) as blocks of weight and place, names, numbers and END."""
    named = lambda pre, c, n: F.array_join(F.array(*[F.concat(F.lit(f"{pre}{k + 1}="), F.get(c, F.lit(k)).cast("string")) for k in range(n)]), " ")
    block = F.array(
        F.concat(F.lit("REMARK WEIGHT="), F.coalesce("w", F.lit(1.0)).cast("string"), F.lit(" "), named(f"{name}.", "place", low)),
        F.lit("REMARK ARG=" + ",".join(f"d.{k + 1}" for k in range(dim))),
        F.concat(F.lit("REMARK "), named("d.", "x", dim)),
        F.lit("END"),
    )
    landmarks.orderBy("id").select(F.array_join(block, "\n").alias("value")).write.text(path)


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """(frame, comment, atom, symbol, x, y, z) of XYZ files, one frame a file; a frame's id is a hash of its path."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r?\n").alias("l"))
    numbered = whole.withColumn("frame", F.xxhash64("file"))
    rows = numbered.select("frame", F.element_at("l", 2).alias("comment"), F.posexplode(F.slice("l", F.lit(3), F.trim(F.element_at("l", 1)).cast("int"))).alias("atom", "value"))
    part = lambda k: F.element_at(_fields(), k)
    return rows.select("frame", "comment", F.col("atom").cast("long").alias("atom"), part(1).alias("symbol"), *[part(k + 2).cast("double").alias(c) for k, c in enumerate("xyz")])


def read_minima(spark: SparkSession, path: str) -> DataFrame:
    """(id, e, xyz): an energy, then flat coordinates."""
    v = F.transform(_fields(), lambda s: s.cast("double"))
    return _lines(spark, path).select("id", v.alias("v")).select("id", F.get("v", F.lit(0)).alias("e"), F.slice("v", F.lit(2), F.size("v") - 1).alias("xyz"))


def read_families(spark: SparkSession, path: str) -> DataFrame:
    """(family, wells, min_e, h) of a book of histograms."""
    f = _fields()
    return _lines(spark, path).select(F.element_at(f, 1).cast("int").alias("family"), F.element_at(f, 2).cast("double").alias("wells"), F.element_at(f, 3).cast("double").alias("min_e"), F.transform(F.slice(f, F.lit(4), F.size(f) - 3), lambda s: s.cast("double")).alias("h"))


def write_free_energy(fes: DataFrame, path: str) -> None:
    """``x y F rho`` with a blank line after each row of cells and ``nan`` for empty ones."""
    f = F.when(F.col("f").isNull(), "nan").otherwise(F.format_string("%.8f", F.col("f") + 0.0))
    line = F.concat_ws(" ", F.format_string("%.8f", "x"), F.format_string("%.8f", "y"), f, F.format_string("%.8e", "rho"))
    rows = fes.groupBy("iy").agg(F.array_sort(F.collect_list(F.struct("ix", line.alias("t")))).alias("l"))  # a row of the grid
    text = F.concat(F.array_join(F.transform("l", lambda v: v["t"]), "\n"), F.lit("\n"))
    rows.orderBy("iy").select(text.alias("value")).write.text(path)


def write_histogram(hist: DataFrame, path: str) -> None:
    hist.orderBy("bin").select(F.concat_ws(" ", F.col("bin").cast("string"), F.format_string("%.0f", "count")).alias("value")).write.text(path)


def write_joint(joint: DataFrame, path: str) -> None:
    """``ih il count`` of a joint histogram, a blank line after each row of cells; the mass beyond the ceilings goes last, as a comment."""
    inside = joint.where("ih is not null").groupBy("ih").agg(F.array_sort(F.collect_list(F.struct("il", "count"))).alias("l"))  # a row of cells
    line = F.transform("l", lambda v: F.concat_ws(" ", F.col("ih").cast("string"), v["il"].cast("string"), v["count"].cast("string")))
    rows = inside.select("ih", F.concat(F.array_join(line, "\n"), F.lit("\n")).alias("value"))
    out = joint.where("ih is null").select(F.lit(None).cast("int").alias("ih"), F.concat(F.lit("# outside "), F.col("count").cast("string")).alias("value"))
    rows.unionByName(out).orderBy(F.col("ih").asc_nulls_last()).select("value").write.text(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, digest) of files, the digest as ``sha256:`` and 64 hex digits."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("digest"))


def valid_provenance(df: DataFrame) -> DataFrame:
    """``df`` with ``valid``: ids that aren't blank, a sha256 digest, a 40-digit revision or none, and positive versions."""
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    good = filled("run_id") & filled("engine_id") & filled("protocol_family") & F.coalesce(F.col("input_digest").rlike("^sha256:[0-9a-fA-F]{64}$"), F.lit(False))
    good = good & (F.col("revision").isNull() | F.col("revision").rlike("^[0-9a-fA-F]{40}$"))
    for c in ("protocol_major", "abi_major", "abi_layout_revision", "dlpack_major"):
        good = good & (F.coalesce(F.col(c), F.lit(0)) > 0)
    return df.withColumn("valid", good)

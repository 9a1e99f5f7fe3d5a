"""Tables that are kept: written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROWS_BITS = 33  # of monotonically_increasing_id(): the row inside its partition
_written: list[tuple[SparkSession, str]] = []


def _drop_all() -> None:
    for spark, path in _written:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001, S110  the JVM may have gone first
            pass


atexit.register(_drop_all)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this machine where that is unset and all of Spark runs on it, else an error."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="chartwork-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, until Python ends: its lineage is cut, executors may be lost.

    A table read from files has the size of its files, so that Spark can choose joins by it. (A checkpoint keeps the
    estimate of its plan, which multiplies with each join of an iteration until it can't be worked out.)
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/chartwork-kept-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, key: str = "id", name: str = "nr", ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with its rank by (key, ties), from 0, without one task that holds all rows.

    Rows are dealt to ranges of the key and sorted there; a row's rank is its place in its range plus the rows of the
    ranges before, one number a range. Equal keys that ``ties`` tell apart may be in several ranges.
    """
    rows = kept(df)  # the ranges are found by a sample of it
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [key, *ties]
    ranged = kept(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", _ROWS_BITS)
    before, total = [], 0
    for r in sorted(ranged.groupBy(part.alias("p")).count().collect()):  # one row a range
        before.append((r["p"], total))
        total += r["count"]
    base = df.sparkSession.createDataFrame(before, "_p long, _before long")
    place = F.col("_m").bitwiseAND((1 << _ROWS_BITS) - 1) + F.col("_before")
    return ranged.withColumn("_p", part).join(F.broadcast(base), "_p").withColumn(name, place).drop("_p", "_m", "_before")

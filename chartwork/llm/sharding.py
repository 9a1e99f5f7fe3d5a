"""Sharding over fixed virtual slots with a versioned, edited slot-to-shard map."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartwork.llm.common import small, written

SLOTS = 8192


@dataclass(frozen=True)
class SlotMap:
    """Shard of each virtual slot. Its size is the number of slots, whatever the data; editing gives the next version."""

    version: int
    n_shards: int
    shard: tuple[int, ...]

    @staticmethod
    def initial(n_shards: int, n_slots: int = SLOTS) -> SlotMap:
        return SlotMap(1, n_shards, tuple(i % n_shards for i in range(n_slots)))

    def rebalanced(self, load: np.ndarray) -> SlotMap:
        """Moves or swaps slots between the fullest and the emptiest shard while that brings the two closer."""
        load = np.asarray(load, dtype=np.int64)
        shard = np.array(self.shard)
        total = np.bincount(shard, weights=load, minlength=self.n_shards).astype(np.int64)
        own = [list(np.flatnonzero((shard == s) & (load > 0))) for s in range(self.n_shards)]
        for _ in range(64 * len(shard)):
            a, b = int(total.argmax()), int(total.argmin())
            gap = int(total[a] - total[b])
            give = np.array(own[a], dtype=np.int64)
            if gap <= 1 or not len(give):
                break
            take = np.append(-1, own[b]).astype(np.int64)  # -1: nothing comes back
            take = take[np.argsort(np.where(take < 0, 0, load[take]), kind="stable")]
            back = np.where(take < 0, 0, load[take])
            want = load[give] - gap / 2
            near = np.clip(np.searchsorted(back, want), 1, max(1, len(back) - 1))
            near = np.where((near < len(back)) & (np.abs(back[np.minimum(near, len(back) - 1)] - want) < np.abs(back[near - 1] - want)), np.minimum(near, len(back) - 1), near - 1)
            moved = load[give] - back[near]
            off = np.abs(moved - gap / 2)
            best = int(off.argmin())
            if not 0 < moved[best] < gap:
                break
            x, y = int(give[best]), int(take[near[best]])
            own[a].remove(x)
            own[b].append(x)
            shard[x] = b
            if y >= 0:
                own[b].remove(y)
                own[a].append(y)
                shard[y] = a
            total[a] -= moved[best]
            total[b] += moved[best]
        return SlotMap(self.version + 1, self.n_shards, tuple(int(s) for s in shard))

    def grown(self) -> SlotMap:
        """One more shard, which takes an equal share of slots from each of the others; no other slot moves."""
        shard, new = list(self.shard), self.n_shards
        want = len(shard) // (new + 1)
        held = [[i for i, s in enumerate(shard) if s == k] for k in range(new)]
        for _ in range(want):
            k = max(range(new), key=lambda k: (len(held[k]), -k))
            shard[held[k].pop()] = new
        return SlotMap(self.version + 1, new + 1, tuple(shard))

    def table(self, spark: SparkSession, load: np.ndarray | None = None) -> DataFrame:
        rows = [(self.version, i, s, int(load[i]) if load is not None else None) for i, s in enumerate(self.shard)]
        return spark.createDataFrame(rows, "version int, virtual_slot int, shard int, bytes long")

    @staticmethod
    def kept(spark: SparkSession, path: str) -> bool:
        """Whether there are maps at ``path``."""
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def save(self, spark: SparkSession, path: str, load: np.ndarray | None = None) -> None:
        """Appends this version to the maps kept at ``path``."""
        self.table(spark, load).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A kept version, the latest by default."""
        maps = spark.read.parquet(path)
        version = version if version is not None else maps.agg(F.max("version")).first()[0]
        rows = maps.where(F.col("version") == version).orderBy("virtual_slot").collect()  # as many as slots
        return SlotMap(int(version), 1 + max(r["shard"] for r in rows), tuple(r["shard"] for r in rows))


def record_bytes(text: str = "text") -> F.Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def virtual_slot(key: str = "doc_id", text: str = "text", n_slots: int = SLOTS) -> F.Column:
    """The slot that a record keeps for good; rows without a key spread by their text."""
    return F.pmod(F.when(F.col(key).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key)), F.lit(n_slots)).cast("int")


def slot_totals(docs: DataFrame, key: str = "doc_id", text: str = "text", n_slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of each slot: an aggregation with at most ``n_slots`` groups, so what is collected is bounded."""
    load, rows = np.zeros(n_slots, dtype=np.int64), np.zeros(n_slots, dtype=np.int64)
    sums = docs.groupBy(virtual_slot(key, text, n_slots).alias("s")).agg(F.sum(record_bytes(text)).alias("b"), F.count("*").alias("n"))
    for r in sums.collect():
        load[r["s"]], rows[r["s"]] = r["b"], r["n"]
    return load, rows


def assign_shards(docs: DataFrame, slot_map: SlotMap, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``virtual_slot`` and ``shard``: the map travels as one literal array, no join or shuffle."""
    n = len(slot_map.shard)
    lookup = F.from_json(F.lit(str(list(slot_map.shard))), "array<int>")
    return docs.withColumn("virtual_slot", virtual_slot(key, text, n)).withColumn("shard", F.get(lookup, F.col("virtual_slot")))


def _placed(light: DataFrame, slot: Column, slot_map: SlotMap) -> DataFrame:
    return light.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(slot_map.version).alias("map_version"),
    )


def shard_documents(docs: DataFrame, n_shards: int = 40, key: str = "doc_id", text: str = "text", n_slots: int = SLOTS, maps_path: str | None = None, order: tuple[str, str] | None = None) -> DataFrame:
    """Every row's shard under the ``bytes`` law: sizes of shards are near equal.

    Records hash into ``n_slots`` virtual slots; the first map deals slots in turn, and its edited next version levels
    the bytes. Where ``maps_path`` has maps already, of as many shards and slots, the latest is edited instead. ``slot`` numbers the rows of a shard from 0 without gaps: a row number inside each virtual slot
    plus the rows of the shard's earlier slots, so that no task holds a whole shard. New versions are kept at
    ``maps_path`` if that is given.

    ``order`` names two columns that order all rows: a run of rows, and the place in it. Then ``slot`` follows that order
    in each shard, by row numbers inside each run's part of a shard plus the shard's rows in earlier runs.

    A null or empty text has size 16 and crc 0. Rows of one key share a slot and are numbered in the order of size and
    crc; rows equal in all are interchangeable. An empty table gives an empty result. Other columns are left out.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(n) for c, n in zip(order or (), ("_run", "_at"), strict=False)])
    stored = maps_path is not None and SlotMap.kept(spark, maps_path)
    first = SlotMap.load(spark, maps_path) if stored else SlotMap.initial(n_shards, n_slots)
    if (first.n_shards, len(first.shard)) != (n_shards, n_slots):
        raise ValueError(f"the kept map has {first.n_shards} shards and {len(first.shard)} slots")
    load, rows = slot_totals(docs, n_slots=n_slots)
    second = first.rebalanced(load)
    if maps_path:
        if not stored:
            first.save(spark, maps_path)
        second.save(spark, maps_path, load)
    light = assign_shards(docs, second).select(
        "doc_id",
        record_bytes().alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        "shard",
        "virtual_slot",
        *(["_run", "_at"] if order else []),
    )
    if order:
        runs = light.groupBy("shard", "_run").agg(F.count("*").alias("_n"))
        earlier = F.sum("_n").over(Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
        runs = written(runs.select("shard", "_run", F.coalesce(earlier, F.lit(0)).alias("_before")), "runs")
        inside = F.row_number().over(Window.partitionBy("shard", "_run").orderBy("_at"))
        light = light.withColumn("_in", inside).join(small(runs), ["shard", "_run"])
        return _placed(light, F.col("_before") + F.col("_in") - 1, second)
    # the rows of the earlier slots of each slot's shard
    before, seen = np.zeros(n_slots, dtype=np.int64), np.zeros(n_shards, dtype=np.int64)
    for i, s in enumerate(second.shard):
        before[i] = seen[s]
        seen[s] += rows[i]
    base = F.get(F.from_json(F.lit(str(before.tolist())), "array<bigint>"), F.col("virtual_slot"))
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32"))
    return _placed(light, base + inside - 1, second)


def write_shards(docs: DataFrame, slot_map: SlotMap, path: str, key: str = "doc_id", text: str = "text") -> None:
    """The rows as Parquet, one folder a shard; a hot shard's rows spread over files by slot."""
    out = assign_shards(docs, slot_map, key, text)
    out.repartition("shard", "virtual_slot").write.partitionBy("shard").parquet(path)

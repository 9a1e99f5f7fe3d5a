"""Mixing sources to target weights by Pfair scheduling, with DataFrame operations only."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartwork.llm.common import new_folder, small, written

#: Rows of one block.
BLOCK_ROWS = 8
#: Integer weights sum to about this many; the schedule repeats after their sum.
RESOLUTION = 1000
#: The schedule needs one number a source; more sources than this are refused.
MAX_SOURCES = 1000
#: Slots that the driver works out before it writes them, and blocks of a source whose slots are kept in one array.
PIECE_SLOTS, CHUNK_BLOCKS = 500_000, 1024
#: Rows that one window task numbers, about.
ROWS_A_BUCKET = 50_000


def exact_weights(target: dict[str, float]) -> dict[str, int]:
    """Integers in exactly the proportion of the target weights."""
    if not target or min(target.values()) <= 0:
        raise ValueError("target weights must be positive")
    parts = {s: Fraction(w) for s, w in target.items()}
    common = math.lcm(*[x.denominator for x in parts.values()])
    whole = {s: int(x * common) for s, x in parts.items()}
    g = math.gcd(*whole.values())
    return {s: w // g for s, w in whole.items()}


def served(weights: dict[str, int]) -> Iterator[str]:
    """Which source runs in each slot, without end.

    Block j of a source of share w has release floor(j / w) and deadline ceil((j + 1) / w). Each slot goes to the
    released block of earliest deadline; on one processor that meets all deadlines, so at any time a source has run
    less than one block more or less than its share.
    """
    total, now = sum(weights.values()), 0
    released: list[tuple[int, int, str, int]] = []
    waiting = [(0, s, 0) for s in sorted(weights)]
    heapq.heapify(waiting)
    while True:
        while waiting and waiting[0][0] <= now:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(released, (-(-(j + 1) * total // weights[s]), -weights[s], s, j))
        _, _, s, j = heapq.heappop(released)
        yield s
        now += 1
        heapq.heappush(waiting, ((j + 1) * total // weights[s], s, j + 1))


def schedule(weights: dict[str, int]) -> list[str]:
    """Which source runs in each slot of one period, whose length is the sum of the weights."""
    return list(islice(served(weights), sum(weights.values())))


def pieces(blocks: dict[str, int], weights: dict[str, int], most: int = PIECE_SLOTS) -> Iterator[dict[str, tuple[int, list[int]]]]:
    """The slots of all blocks, ``most`` at a time: by source its first block in the piece and the slots from that on.

    When a source runs out, the others start anew in the same proportion to each other.
    """
    left, slot = {s: n for s, n in blocks.items() if n > 0}, 0
    done: dict[str, int] = dict.fromkeys(left, 0)
    own: dict[str, list[int]] = {}
    while left:
        for s in served({s: weights[s] for s in left}):
            own.setdefault(s, []).append(slot)
            slot += 1
            left[s] -= 1
            if slot % most == 0 or not left[s]:
                yield {x: (done[x], v) for x, v in own.items()}
                for x, v in own.items():
                    done[x] += len(v)
                own = {}
            if not left[s]:
                del left[s]
                break


def slot_table(spark: SparkSession, plan: Iterator[dict[str, tuple[int, list[int]]]]) -> DataFrame:
    """(source, _chunk, _slots): the slots of each source's blocks, CHUNK_BLOCKS to an array.

    The driver walks through the slots once and writes each piece, so what it holds doesn't grow with the blocks.
    """
    path, kinds = new_folder(spark, "schedule"), [pa.string(), pa.int64(), pa.list_(pa.int64())]

    def put(rows: list[tuple[str, int, list[int]]]) -> None:
        cols = list(zip(*rows, strict=True)) if rows else [()] * 3
        part = pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["source", "_chunk", "slots"])
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(path)

    rows, held = [], 0
    for piece in plan:
        for s, (first, own) in piece.items():
            cuts = [0, *range(-first % CHUNK_BLOCKS or CHUNK_BLOCKS, len(own), CHUNK_BLOCKS)]
            rows += [(s, (first + lo) // CHUNK_BLOCKS, own[lo:hi]) for lo, hi in zip(cuts, [*cuts[1:], len(own)], strict=True)]
            held += len(own)
        if held >= PIECE_SLOTS:
            put(rows)
            rows, held = [], 0
    put(rows)
    # slots rise with blocks, so the parts of a chunk are sorted together
    parts = spark.read.schema("source string, _chunk long, slots array<long>").parquet(path)
    return written(parts.groupBy("source", "_chunk").agg(F.sort_array(F.flatten(F.collect_list("slots"))).alias("_slots")), "slots")


def integer_weights(target: dict[str, float], resolution: int = RESOLUTION) -> dict[str, int]:
    """Target weights as integers of at least 1 with a sum of about ``resolution``, divided by their common divisor."""
    total = sum(target.values())
    if not target or total <= 0 or min(target.values()) <= 0:
        raise ValueError("target weights must be positive")
    whole = {s: max(1, round(resolution * w / total)) for s, w in target.items()}
    g = math.gcd(*whole.values())
    return {s: w // g for s, w in whole.items()}


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[tuple[int, int, dict[str, int], list[str]]]:
    """(first slot, period, blocks used before it by source, pattern) of each stretch in which the same sources have blocks left.

    When a source runs out, the others go on in the same proportion to each other.
    """
    left, at, out = {s: n for s, n in blocks.items() if n > 0}, 0, []
    used = dict.fromkeys(left, 0)
    while left:
        w = {s: weights[s] for s in left}
        pattern = schedule(w)
        where: dict[str, list[int]] = {s: [] for s in w}
        for slot, s in enumerate(pattern):
            where[s].append(slot)
        period = len(pattern)
        out.append((at, period, dict(used), pattern))
        end = min((n - 1) // w[s] * period + where[s][(n - 1) % w[s]] + 1 for s, n in left.items())
        for s in list(left):
            run = end // period * w[s] + bisect_left(where[s], end % period)
            used[s] += run
            left[s] -= run
            if not left[s]:
                del left[s], used[s]
        at += end
    return out


def mix_sources(
    docs: DataFrame,
    target: dict[str, float] | None = None,
    temperature: float = 0.5,
    block_rows: int = BLOCK_ROWS,
    key: str = "doc_id",
    source: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Every row's place in one interleaved order of all sources.

    Columns: ``doc_id``, ``source``, ``block`` (of its source, from 0), ``slot`` (of the block among all blocks, gapless
    from 0) and ``place`` (inside the block), then those named in ``keep``. Reading by (slot, place), each source has
    had less than one block more or less than its exact target share, counted anew from each slot at which a source ran out.
    No row is dropped or repeated.

    ``target`` maps sources to positive weights and must name every source; without it, weights are row counts to the
    power ``temperature``. A null source is a source of its own, named by the empty string. The order inside a source
    is by a hash of the key; rows of equal key lie next to each other and rows without a key are dealt by their
    source. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")
    total = docs.count()
    n_buckets = max(64, -(-total // ROWS_A_BUCKET))
    rows = docs.select(F.col(key).alias("doc_id"), name, F.xxhash64(key).alias("_hash"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)])
    rows = rows.withColumn("_bucket", F.pmod("_hash", F.lit(n_buckets)))
    sizes = rows.groupBy("source", "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("source", "_bucket", F.coalesce(before, F.lit(0)).alias("_base"))
    counts = {r["source"]: r["n"] for r in docs.groupBy(name).agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; name fewer, or merge them before mixing")
    if target is None:
        target = {s: n**temperature for s, n in counts.items()}
    if missing := sorted(set(counts) - {k or "" for k in target}):
        raise ValueError(f"no target weight for sources {missing[:5]}")
    weights = exact_weights({s: target[s] for s in counts}) if counts else {}
    filled = slot_table(spark, pieces({s: -(-n // block_rows) for s, n in counts.items()}, weights))

    rank = F.row_number().over(Window.partitionBy("source", "_bucket").orderBy("_hash", "doc_id")) - 1
    ranked = rows.withColumn("_in", rank).join(base, ["source", "_bucket"]).withColumn("_rank", F.col("_in") + F.col("_base"))
    blocks = (
        ranked.withColumn("block", F.expr(f"_rank div {block_rows}"))
        .withColumn("place", (F.col("_rank") % block_rows).cast("int"))
        .withColumn("_chunk", F.expr(f"block div {CHUNK_BLOCKS}"))
    )
    out = blocks.join(small(filled, 2000), ["source", "_chunk"])  # at most 16 MB are broadcast
    slot = F.get("_slots", (F.col("block") % CHUNK_BLOCKS).cast("int"))
    return out.select("doc_id", "source", "block", slot.alias("slot"), "place", *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)])


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """``docs`` with their own columns, sorted into the mixed order: written files follow each other in it."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, source = (f"c{names.index(options.pop(k, d))}" for k, d in (("key", "doc_id"), ("source", "source")))
    out = mix_sources(inner, key=key, source=source, keep=tuple(inner.columns), **options)
    out = out.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])

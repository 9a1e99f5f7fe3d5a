"""Line dedup over levelled, sorted runs of line hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartwork.llm.common import drop, new_folder, small, written

#: Lines are keyed without this white space at their ends.
_BLANK = " \t\n\x0b\x0c\r"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 3


def line_key(line: str) -> str:
    line = line.strip(_BLANK)
    return line.lower() if line.isascii() else line.translate(_LOWER)


def line_hash(key: str) -> tuple[int, int]:
    """128 bits as two signed longs."""
    x = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"))
    hi, lo = x >> 64, x & 0xFFFFFFFFFFFFFFFF
    return hi - (hi >> 63 << 64), lo - (lo >> 63 << 64)


def _hashes(min_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, his, los = [], [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if not text or len(text) < min_chars:
                    continue
                keys = {k for x in text.split("\n") if len(x) >= min_chars and len(k := line_key(x)) >= min_chars}
                for hi, lo in map(line_hash, keys):
                    ids.append(doc_id)
                    his.append(hi)
                    los.append(lo)
            yield pd.DataFrame({"h": pd.Series(his, dtype="int64"), "l": pd.Series(los, dtype="int64"), "doc_id": pd.array(ids, dtype="Int64")})

    return run


class LineRuns:
    """Sorted runs of lines seen so far, in levels. A key (h, l) is in one run only, with the document that holds it.

    A run is a Parquet folder dealt by key over ``parts`` files, each sorted. ``fanout`` runs of a level are compacted
    to one of the next, so that n batches leave O(log n) runs to merge with. State lives in the shared folder alone.
    """

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT) -> None:
        self.spark, self.path, self.fanout = spark, path, fanout
        self.levels: list[list[str]] = [[]]
        self.made = 0
        self.again: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        at = f"{self.path}/run-{self.made}"
        self.made += 1
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows.repartition(parts, "h", "l").sortWithinPartitions("h", "l").write.parquet(at)
        return at

    def runs(self) -> DataFrame | None:
        paths = [p for level in self.levels for p in level]
        return self.spark.read.schema("h long, l long, n_docs long, holder long").parquet(*paths) if paths else None

    def add(self, batch: DataFrame) -> None:
        """Merge-joins a batch (h, l, n_docs, holder) with the runs.

        Keys that no run has become a run of their own; for the others only the batch's counts are kept.
        """
        runs = self.runs()
        if runs is not None:
            seen = runs.select("h", "l").hint("merge")
            self.again.append(f"{self.path}/again-{self.made}")
            batch.join(seen, ["h", "l"], "left_semi").select("h", "l", "n_docs").write.parquet(self.again[-1])
            batch = batch.join(seen, ["h", "l"], "left_anti")
        self.levels[0].append(self._write(batch))
        self._compact()

    def counts(self) -> DataFrame:
        """(h, l, holder, n_docs) of every key, with n_docs over all batches."""
        runs = self.runs()
        if not self.again:
            return runs
        more = self.spark.read.schema("h long, l long, n_docs long").parquet(*self.again).groupBy("h", "l").agg(F.sum("n_docs").alias("more"))
        return runs.join(more, ["h", "l"], "left").select("h", "l", "holder", (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"))

    def _compact(self) -> None:
        for i, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = self._write(self.spark.read.schema("h long, l long, n_docs long, holder long").parquet(*level))
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(merged)
                self.levels[i] = []
                for p in level:
                    drop(self.spark, p)
                break


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h, l, doc_id) of each document's distinct line keys, written: they are read to count them and to drop lines."""
    return written(docs.mapInPandas(_hashes(min_chars), "h long, l long, doc_id long"), "lines")


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, hashed: DataFrame | None = None) -> DataFrame:
    """(h, l, holder) of the line keys found in at least ``min_docs`` documents; holder is the largest doc_id.

    ``docs`` has doc_id and text, ``hashed`` its hashed lines if they are known. Batches go by falling doc_id, so a key's holder is in the first batch that has it:
    what the runs know already is a repeat, and only counts are added for it.
    """
    spark = docs.sparkSession
    path = new_folder(spark, "line-runs")
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    least, most = (least or 0, most or 0)
    width = (most - least) // batches + 1
    hashed = hashed_lines(docs, min_chars) if hashed is None else hashed
    number = F.coalesce(F.lit(batches - 1) - F.floor((F.col("doc_id") - least) / width), F.lit(batches - 1)).cast("int")
    keyed = hashed.withColumn("batch", number).groupBy("batch", "h", "l")
    keyed = keyed.agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("holder")).where("holder is not null")
    keyed.write.partitionBy("batch").parquet(f"{path}/batches")
    store = LineRuns(spark, path)
    for b in range(batches):
        store.add(spark.read.schema("h long, l long, n_docs long, holder long, batch int").parquet(f"{path}/batches").where(F.col("batch") == b).drop("batch"))
    return store.counts().where(F.col("n_docs") >= min_docs).select("h", "l", "holder")


def _keep(min_chars: int, with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, dropped in zip(batch["doc_id"], batch["text"], batch["dropped"], strict=True):
                text = text or ""
                lines = text.split("\n")
                kept = lines
                if dropped is not None and len(dropped):
                    gone = {(x["h"], x["l"]) for x in dropped}
                    kept = [x for x in lines if len(x) < min_chars or len(k := line_key(x)) < min_chars or line_hash(k) not in gone]
                    text = "\n".join(kept)
                row = (doc_id, len(lines), len(lines) - len(kept), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
                out.append((*row, text) if with_text else row)
            frame = pd.DataFrame(out, columns=["doc_id", "n_lines", "n_dropped", "kept_sha256", *["kept"] * with_text])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return run


def dedup_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    key: str = "doc_id",
    text: str = "text",
    with_text: bool = False,
) -> DataFrame:
    """Drops lines of at least ``min_chars`` characters that ``min_docs`` documents have, but for the largest doc_id's.

    Lines are split at \\n and compared without white space at their ends and with A-Z in lower case. A null or empty
    text is one empty line. Rows of one doc_id count as one document, and each of them keeps or loses a line alike; a
    row without doc_id counts for nothing and loses all repeated lines. ``with_text`` adds the kept text as ``kept``.
    Other columns are left out.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    hashed = hashed_lines(rows, min_chars)
    lines = small(written(repeated_lines(rows, min_chars, min_docs, batches, hashed), "repeated-lines"))
    cut = hashed.join(lines, ["h", "l"]).where("doc_id is null or doc_id <> holder")
    # a document's repeated lines are no more than its lines
    dropped = cut.groupBy("doc_id").agg(F.collect_set(F.struct("h", "l")).alias("dropped"))
    joined = rows.alias("r").join(dropped.withColumnRenamed("doc_id", "_id"), F.col("r.doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "dropped")
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept string" * with_text
    return joined.mapInPandas(_keep(min_chars, with_text), schema)

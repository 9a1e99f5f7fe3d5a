"""Canonical exact digests of documents, grouped by wide hash and checked byte by byte."""

from __future__ import annotations

import hashlib
import math
import unicodedata
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chartwork.llm.common import small, written

#: Rows of one equal bucket that one task compares.
BUCKET_ROWS = 256


def canonical(text: str | None) -> str:
    """NFKC, case folding, NFKC again (folding may undo it), white space to single spaces, trimmed; null is empty."""
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.lower().split())
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def digest(canon: str) -> str:
    """128-bit xxh3 as 32 hex digits."""
    return xxhash.xxh3_128_hexdigest(canon.encode("utf-8", "surrogatepass"))


@F.pandas_udf(StringType())
def canonical_udf(text: pd.Series) -> pd.Series:
    return text.map(canonical)


@F.pandas_udf(StringType())
def fingerprint_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: digest(canonical(t)))


def edited_text(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of the following text (or all of that)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come in order; each waits for the next one. A row with ``last`` only ends its range."""
    waiting = None
    for batch in batches:
        out = []
        for range_no, last, doc_id, text in zip(batch["_range"], batch["_last"], batch["doc_id"], batch["text"], strict=True):
            text = text or ""
            print_of = "" if last and waiting is None else digest(canonical(text))
            if waiting is not None and waiting[0] == range_no:
                _, own_id, own, own_print = waiting
                edit = edited_text(own, text)
                edit_print = digest(canonical(edit))
                sha = hashlib.sha256(edit.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((own_id, len(own), sha, own_print, edit_print, float(own_print == edit_print), float(own_print == print_of)))
            waiting = None if last else (range_no, doc_id, text, print_of)
        frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        yield frame


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and the likeness (1 or 0: digests are exact) of the two.

    Documents are ordered by (doc_id, text), nulls first; the last is followed by the first, a single one by itself.
    They are dealt to ranges of ids; each range also gets a copy of the first document of the next, so that one
    shuffle of the texts suffices and no task sees more than its range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted({int(x) for x in rows.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)})
    # the range is looked for among each step-th bound and then inside of a step: about 2 * sqrt(n) comparisons a row
    step = max(1, math.isqrt(len(bounds)))
    fine, coarse = (F.from_json(F.lit(str(x)), "array<bigint>") for x in (bounds, bounds[step - 1 :: step]))
    below = lambda a: F.size(F.filter(a, lambda b: b <= F.col("doc_id")))
    steps = below(coarse) * step
    number = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(steps + below(F.slice(fine, steps + 1, step)))
    ranged = rows.withColumn("_range", number.cast("int"))
    firsts = sorted((r["_range"], r["least"], r["nulls"]) for r in ranged.groupBy("_range").agg(F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).collect())
    if not firsts:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    before = [firsts[i - 1][0] for i in range(len(firsts))]  # of each range, the one before it; the last before the first
    return _edited(ranged, firsts, before)


def _edited(ranged: DataFrame, firsts: list, before: list) -> DataFrame:
    spark = ranged.sparkSession
    # at most as many rows as ranges
    links = spark.createDataFrame([(r, None if nulls else least, b) for (r, least, nulls), b in zip(firsts, before, strict=True)], "_range int, _first long, _before int")
    joined = ranged.join(F.broadcast(links), "_range")
    copies = F.when(
        F.col("doc_id").eqNullSafe(F.col("_first")),
        F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("last")), F.struct(F.col("_before").alias("r"), F.lit(True).alias("last"))),
    ).otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("last"))))
    dealt = joined.select("doc_id", "text", F.explode(copies).alias("_to")).select(F.col("_to.r").alias("_range"), F.col("_to.last").alias("_last"), "doc_id", "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "_range").sortWithinPartitions("_range", "_last", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return dealt.mapInPandas(_walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def equal_groups(docs: DataFrame, prints: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, group_id, group_size) of the documents that share a fingerprint with others, checked byte by byte.

    ``prints`` has doc_id and fingerprint. A bucket's least doc_id represents it; documents whose canonical bytes
    differ from the representative's (a collision of 128 bits) form groups by a second digest. Large buckets are
    compared in pieces, each with its own copy of the representative's text.
    """
    sizes = prints.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size")).where("group_size > 1")
    members = written(prints.join(sizes, "fingerprint").select("doc_id", "fingerprint", "group_id", "group_size").distinct(), "members")
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(small(members), "doc_id").withColumn("canon", canonical_udf("text")).drop("text")
    pieces = F.ceil(F.col("group_size") / BUCKET_ROWS).cast("int")
    heads = texts.where("doc_id = group_id").dropDuplicates(["fingerprint"]).select("fingerprint", F.col("canon").alias("head"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    parts = texts.withColumn("piece", F.pmod(F.xxhash64("doc_id"), pieces).cast("int"))
    same = F.col("canon") == F.col("head")
    compared = parts.join(heads, ["fingerprint", "piece"]).select("doc_id", "fingerprint", "group_id", same.alias("same"), F.when(~same, F.sha2("canon", 256)).alias("other"))
    odd = compared.where("not same").groupBy("fingerprint", "other").agg(F.min("doc_id").alias("_least"))
    groups = compared.join(small(written(odd, "collisions")), ["fingerprint", "other"], "left").withColumn("group_id", F.when(F.col("same"), F.col("group_id")).otherwise(F.col("_least")))
    return groups.groupBy("doc_id").agg(F.min("group_id").alias("group_id"))


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all documents with their groups of equal canonical text.

    ``group_id`` is the least doc_id of equal canonical bytes, the own id where there is none, null for a null id.
    A null text counts as empty. Repeated rows give repeated results. Other columns are left out.
    """
    prints = written(edited_fingerprints(docs, key, text), "prints")
    groups = equal_groups(docs, prints, key, text)
    return prints.join(groups, "doc_id", "left").withColumn("group_id", F.coalesce("group_id", "doc_id"))

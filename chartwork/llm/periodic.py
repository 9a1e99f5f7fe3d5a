"""Maximal runs of periodic words: every lag of every document is scanned, documents and lag ranges as Spark's rows."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwork.llm.common import slices

MIN_WORDS = 24
MIN_EXP = 3
#: Comparisons of words (lags times words) of one piece of a document, at most about.
PIECE = 100_000_000
#: Bytes of a text, about, for each of its words.
_WORD_BYTES = 6
_CHUNK = 1 << 20
_GRAM = 8

Rewrite = Callable[[int, int], np.ndarray | None]


def word_ids(text: str | None) -> tuple[np.ndarray, list[bytes]]:
    """The words ``[^\\x20\\x09-\\x0D]+`` as numbers of the distinct words, which come second."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    known: dict[bytes, int] = {}
    found, at = [], 0
    while at < len(raw):
        to = at + _CHUNK
        while to < len(raw) and raw[to] not in b" \t\n\x0b\x0c\r":
            to += 1
        # split() of bytes cuts at just these six
        found.append(np.fromiter((known.setdefault(w, len(known)) for w in raw[at:to].split()), dtype=np.int32))
        at = to
    return (np.concatenate(found) if found else np.zeros(0, np.int32)), list(known)


def needed(lag: int, min_words: int, min_exp: int) -> int:
    """Words that must equal the one ``lag`` further on, one after another, in a run of that period."""
    return max(min_words, min_exp * lag) - lag


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + ([n] if n > 1 else [])


def _least_period(ids: np.ndarray, start: int, lag: int) -> bool:
    """Whether no proper divisor of ``lag`` is a period too; the stretch is known to hold two periods or more."""
    for p in _primes(lag):
        d = lag // p
        if np.array_equal(ids[start : start + 64], ids[start + d : start + d + 64]) or lag < 64:
            if np.array_equal(ids[start : start + lag], ids[start + d : start + d + lag]):
                return False
    return True


def runs_of(ids: np.ndarray, lo: int = 1, hi: int | None = None, min_words: int = MIN_WORDS, min_exp: int = MIN_EXP) -> np.ndarray:
    """(start, length, period) of all maximal runs whose smallest period is in [lo, hi), as rows of longs.

    The array is compared with each shift of itself. A stretch of equal words is so long that it covers a known
    number of neighbouring places, so each shift is first compared at every such place only, by a hash of the words
    that follow; shifts with an equal place are then compared whole, and the true stretches' lengths are taken.
    """
    n = len(ids)
    last = n // min_exp
    hi = last + 1 if hi is None else min(hi, last + 1)
    if hi <= lo or n < min_words:
        return np.zeros((0, 3), np.int64)
    turn = max(min_words // min_exp, 1)
    gram = max(1, min(_GRAM, *(needed(q, min_words, min_exp) for q in (1, turn, turn + 1))))
    wide = n - gram + 1
    g = np.zeros(wide, np.uint64)
    for k in range(gram):
        g *= np.uint64(0x9E3779B97F4A7C15)
        g += ids[k : k + wide].astype(np.uint64) + np.uint64(1)
    found = []
    for q in range(lo, hi):
        need = needed(q, min_words, min_exp)
        step = need - gram + 1
        if not (g[q::step] == g[: wide - q : step]).any():
            continue
        same = np.zeros(n - q + 2, np.int8)
        np.equal(ids[q:], ids[: n - q], out=same[1:-1].view(bool))
        edge = np.flatnonzero(np.diff(same))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= need and _least_period(ids, a, q):
                found.append((a, b - a + q, q))
    return np.array(found, np.int64).reshape(-1, 3)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """A mask of the words that no run holds after its first period."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(cover[:n]) == 0


def periodic_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a tenth of the ids, which of the n words stands at each place once the tail is made periodic; else None."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def _summary(runs: np.ndarray, ids: np.ndarray, words: list[bytes], with_text: bool) -> tuple:
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    listed = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs.tolist()).encode())
    best = None
    for s, m, q in runs.tolist():  # in the order of ties
        if best is None or m * best[2] > best[1] * q:
            best = (s, m, q)
    kept = ids[kept_words(len(ids), runs)]
    sha, out = hashlib.sha256(), []
    for at in range(0, len(kept), _CHUNK):
        piece = b" ".join([words[i] for i in kept[at : at + _CHUNK].tolist()])
        piece = b" " + piece if at else piece
        sha.update(piece)
        if with_text:
            out.append(piece.decode("utf-8", "surrogatepass"))
    row = (len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], listed.hexdigest(), sha.hexdigest())
    return (*row, "".join(out), runs.tolist()) if with_text else row


_FIELDS = [("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]
_FIELDS += [("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
_TEXT_FIELDS = [("collapsed", pa.string()), ("runs", pa.list_(pa.list_(pa.int64())))]
_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _rewritten(doc_id: int | None, text: str | None, rewrite: Rewrite | None) -> tuple[np.ndarray, list[bytes]]:
    ids, words = word_ids(text)
    place = rewrite(doc_id, len(ids)) if rewrite else None
    return (ids if place is None else ids[place]), words


def periodic_runs(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    min_exp: int = MIN_EXP,
    piece: int = PIECE,
    key: str = "doc_id",
    text: str = "text",
    rewrite: Rewrite | None = None,
    with_text: bool = False,
) -> DataFrame:
    """Every document's maximal runs and its text with each run cut to its first period.

    A run is a stretch of at least ``min_words`` words and ``min_exp`` (2 or more) times its smallest period that
    can't be extended. The row has their number, the run of greatest exponent (ties: least start, then period; nulls
    if there is none) and digests; ``with_text`` adds the collapsed text and the runs as (start, length, period).
    ``rewrite`` gives for (doc_id, number of words) which word stands at each place, or None for all in their places.

    Documents of more than about ``piece`` comparisons are cut into ranges of lags, each a row of its own with the
    text; their runs meet again by (doc_id, digest of the text), at most a third of the words each. A null or empty
    text has no words; rows of a null doc_id are worked like others; repeated rows give repeated results. Other
    columns are left out.
    """
    if min_exp < 2:
        raise ValueError("min_exp must be 2 or more")
    schema = _SCHEMA + ", collapsed string, runs array<array<long>>" * with_text
    arrow = pa.schema(_FIELDS + _TEXT_FIELDS * with_text)
    n = F.octet_length("text") / _WORD_BYTES
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("pieces", F.coalesce(F.ceil(n * n / min_exp / piece), F.lit(1)).cast("long"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc_id, said in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids, words = _rewritten(doc_id, said, rewrite)
                out.append((doc_id, *_summary(runs_of(ids, min_words=min_words, min_exp=min_exp), ids, words, with_text)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    def lags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for doc_id, sha, said, k, of in zip(*(batch[c].to_pylist() for c in ("doc_id", "sha", "text", "piece", "pieces")), strict=True):
                ids, _ = _rewritten(doc_id, said, rewrite)
                most = len(ids) // min_exp
                found = runs_of(ids, 1 + most * k // of, 1 + most * (k + 1) // of, min_words, min_exp)
                out += [(doc_id, sha, *r) for r in found.tolist()]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "sha", "start", "length", "period"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc_id, said, own in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "found")), strict=True):
                ids, words = _rewritten(doc_id, said, rewrite)
                runs = np.array([(r["start"], r["length"], r["period"]) for r in own or []], np.int64).reshape(-1, 3)
                out.append((doc_id, *_summary(runs, ids, words, with_text)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    short = rows.where("pieces <= 1").select("doc_id", "text").mapInArrow(whole, schema)
    long = rows.where("pieces > 1").withColumn("sha", F.sha2("text", 256))
    cut = long.dropDuplicates(["doc_id", "sha"]).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    cut = cut.repartition("sha", "piece")
    runs = cut.mapInArrow(lags, "doc_id long, sha string, start long, length long, period long")
    by_doc = runs.groupBy(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha")).agg(F.collect_list(F.struct("start", "length", "period")).alias("found"))
    met = long.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left").select("doc_id", "text", "found")
    return short.unionByName(met.mapInArrow(gathered, schema))

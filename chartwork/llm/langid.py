"""Language identification with bit-sliced Bloom filters over n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwork.llm.common import mix, slices, text_bytes

#: Labelled rows of a language to learn from, about: a sample by hash of this expected size; all rows of a rarer language.
TRAIN_ROWS = 5_000
#: Bytes of text worked on at a time, and n-grams of them.
PIECE, BLOCK = 1 << 20, 1 << 19
#: Bit positions of the filters, and positions set by one n-gram.
POSITIONS, HASHES = 1 << 20, 3
#: Bytes of one n-gram.
GRAM = 4
#: An n-gram belongs to a language if at least this share of the language's n-grams are it: a language has at most 1 / SHARE of them.
SHARE = 2.0**-16
#: ... and its share is at least this part of its largest share in any language.
PART = 0.5
#: Most languages that one filter tells apart: bits of a mask.
MOST_LANGUAGES = 64

# ASCII letters and all bytes of longer UTF-8 sequences
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
# marks the ends of a row, so that a single letter has an n-gram
_END = "\x01"
_LETTER[1] = True


def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each row that n-grams are made of, and where each row's begin, with the end last.

    Text is lower-cased; each run of other bytes than letters counts as one space.
    """
    ends = pa.scalar(_END, column.type)
    raw, at = text_bytes(pc.binary_join_element_wise(ends, pc.utf8_lower(column.fill_null("")), ends, ends, pa.scalar("", column.type)))
    letter = _LETTER[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[at[:-1]] = True
    seq = np.where(letter, raw, np.uint8(32))[keep]
    return seq, np.append(0, np.cumsum(np.add.reduceat(keep, at[:-1], dtype=np.int64))) if len(at) > 1 else at


def gram_blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of the n-grams of the rows (uint32) and the row of each, at most BLOCK at a time, however long a row is."""
    seq, edge = _sequences(column)
    last = len(seq) - GRAM + 1
    for lo in range(0, last, BLOCK):
        n = min(BLOCK, last - lo)
        code = seq[lo : lo + n].astype(np.uint32)
        for i in range(1, GRAM):
            code = (code << np.uint32(8)) | seq[lo + i : lo + i + n]
        row = np.searchsorted(edge, np.arange(lo, lo + n), side="right") - 1
        whole = np.arange(lo, lo + n) + GRAM <= edge[row + 1]  # not over the end of a row
        yield code[whole], row[whole]


@dataclass(frozen=True)
class LanguageFilters:
    """One mask of languages for each bit position: row l of the bit matrix is the Bloom filter of language l."""

    languages: tuple[str, ...]
    masks: np.ndarray

    @staticmethod
    def build(languages: tuple[str, ...], grams: np.ndarray, member: np.ndarray, positions: int = POSITIONS) -> LanguageFilters:
        """``member`` has for each n-gram the mask of the languages it belongs to."""
        masks = np.zeros(positions, dtype=np.uint64)
        for at in _positions(grams, positions):
            np.bitwise_or.at(masks, at, member)
        return LanguageFilters(languages, masks)

    def false_positive(self) -> np.ndarray:
        """Chance, by language, that an n-gram outside of its filter is found in it."""
        bits = np.array([np.count_nonzero(self.masks >> np.uint64(i) & np.uint64(1)) for i in range(len(self.languages))])
        return (bits / len(self.masks)) ** HASHES

    def shares(self, column: pa.Array, wrong: np.ndarray | None = None) -> np.ndarray:
        """Rows x languages: share of a text's n-grams in each language's filter, corrected for false positives (``wrong``, if known)."""
        rows = len(column)
        count, seen = np.zeros(rows), np.zeros((rows, len(self.languages)))
        for grams, row in gram_blocks(column):
            found = np.full(len(grams), ~np.uint64(0))
            for at in _positions(grams, len(self.masks)):
                found &= self.masks[at]
            count += np.bincount(row, minlength=rows)
            for i in range(len(self.languages)):
                seen[:, i] += np.bincount(row[(found >> np.uint64(i) & np.uint64(1)) == 1], minlength=rows)
        wrong = self.false_positive() if wrong is None else wrong
        return np.clip((seen / np.maximum(count, 1)[:, None] - wrong) / np.maximum(1e-9, 1 - wrong), 0, 1)


def _positions(grams: np.ndarray, positions: int) -> Iterator[np.ndarray]:
    h = mix(grams.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for _ in range(HASHES):
        yield (h % np.uint64(positions)).astype(np.int64)
        h = h >> np.uint64(20)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=PIECE):
        lang = np.array(batch.column(0).to_pylist(), dtype=object)
        for grams, row in gram_blocks(batch.column(1)):
            for name in sorted(set(lang[np.unique(row)])):
                code, n = np.unique(grams[(lang == name)[row]], return_counts=True)
                yield pa.record_batch([pa.array([name] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def is_held_out(key: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text leaves no remainder by 5; a row without id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", train_rows: int = TRAIN_ROWS) -> LanguageFilters:
    """Filters learned from text and language of a hash sample of labelled rows not held out, ``train_rows`` a language.

    Only n-grams above SHARE come to the driver: at most 1 / SHARE a language.
    """
    spark = docs.sparkSession
    fold = docs.where(F.col(lang).isNotNull() & ~is_held_out(key))
    sample = fold.where(F.col(text).isNotNull())
    sizes = dict(sample.groupBy(lang).count().limit(MOST_LANGUAGES + 1).collect())
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; one filter tells no more apart")
    for name, n in sorted(sizes.items()):
        if n > train_rows:
            sample = sample.where((F.col(lang) != name) | (F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 20)) < int((1 << 20) * train_rows / n)))
    counts = sample.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(_count, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = tuple(sorted(totals))
    if not languages:
        return LanguageFilters((), np.zeros(POSITIONS, dtype=np.uint64))
    table = spark.createDataFrame([(x, i, float(totals[x])) for i, x in enumerate(languages)], "lang string, i int, total double")
    shares = counts.join(F.broadcast(table), "lang").select("gram", "i", (F.col("n") / F.col("total")).alias("p"))
    by_gram = shares.groupBy("gram").agg(F.max("p").alias("most"), F.collect_list(F.struct("i", "p")).alias("own"))  # a row a language
    bits = F.expr(f"aggregate(filter(own, x -> x.p >= {SHARE!r}D and x.p >= {PART!r}D * most), 0L, (a, x) -> a | shiftleft(1L, x.i))")
    chosen = by_gram.where(F.col("most") >= SHARE).select("gram", bits.alias("bits")).where("bits <> 0").toArrow()
    return LanguageFilters.build(languages, chosen.column("gram").to_numpy().astype(np.uint64), chosen.column("bits").to_numpy().view(np.uint64))


def identify(docs: DataFrame, filters: LanguageFilters, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) added.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned; ties go to the first
    language by name. An empty table gives an empty one; the columns of ``docs`` stay, but for any of these two names.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((filters.languages, filters.masks))  # 8 MB, whatever the data
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    column = f"c{names.index(text)}"
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageFilters(*shared.value)
        wrong = model.false_positive()
        for batch in slices(batches, column, PIECE >> 2):
            texts = batch.column(batch.schema.get_field_index(column))
            # also for scripts whose letters the n-grams don't separate: any Unicode letter counts
            letters = pc.match_substring_regex(texts.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
            if model.languages:
                shares = model.shares(texts, wrong)
                best = shares.argmax(axis=1)
                pred = np.where(letters, np.array(model.languages, dtype=object)[best], "und")
                score = np.where(letters, shares[np.arange(len(best)), best], 0.0)
            else:
                pred, score = np.full(batch.num_rows, "und", dtype=object), np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*batch.schema.names, "_pred", "_score"])

    out = inner.mapInArrow(run, schema + ", _pred string, _score double")
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n not in ("lang_pred", "score")], F.col("_pred").alias("lang_pred"), F.col("_score").alias("score"))


def predict_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; held-out rows are not learned from.

    Repeated rows give repeated results; a table without labelled rows gives ``und``; other columns are left out.
    """
    filters = fit_languages(docs, key, text, lang, train_rows)
    rows = docs.select(F.col(key).alias("doc_id"), is_held_out(key).alias("held_out"), F.col(text).alias("text"))
    return identify(rows, filters).drop("text")

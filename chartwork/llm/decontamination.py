"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwork.llm.common import Words, _gram, mix, slices

#: Least similarity, 1 - edits / words of the item, and least words of an item for which ``drop_leaks`` drops a text:
#: fewer words are no evidence by themselves. ``find_leaks`` finds items of any number of words.
SIMILARITY, MIN_WORDS = 0.8, 5
#: Repetitions of the embedding and bits sampled in each.
REPEATS, BITS = 24, 2
#: Words of benchmark items that go to executors at once (8 bytes each and their indexes); more go in blocks.
BLOCK_WORDS = 1_000_000
#: Bytes of text worked on at a time.
PIECE = 1 << 20
_PAD = np.uint64(0x5BD1E995)
_STEP = 1 << 20


def _allowed(n: int, similarity: float) -> int:
    return int((1 - similarity) * n + 1e-9)


@dataclass
class Items:
    """A block of benchmark items: their words, q-gram seeds and LSH buckets."""

    ids: list
    words: list[np.ndarray]
    similarity: float
    seed: int = 20240229

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.longest = max((len(w) for w in self.words), default=0)
        #: multiply-shift functions: one bit for each repetition, step and word
        self.walk = rng.integers(0, 1 << 63, (3 * self.longest, REPEATS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.sample = np.sort(rng.random((REPEATS, BITS)), axis=1)
        self.n = np.array([len(w) for w in self.words], dtype=np.int64)
        found: dict[int, list] = {}
        exact: dict[int, list] = {}
        for i, w in enumerate(self.words):
            k = _allowed(len(w), self.similarity)
            if not k:  # no edit is allowed: the whole item is one run
                exact.setdefault(len(w), []).append((_gram(w, np.zeros(1, np.int64), len(w))[0], i))
                continue
            # k edits leave a run of q words unedited
            q = -(-(len(w) - k) // (k + 1))
            at = np.arange(len(w) - q + 1)
            found.setdefault(q, []).append((_gram(w, at, q), at, np.full(len(at), len(w))))
        #: for each number of words, hashes of the items that must occur as they are, and which these are
        self.exact = {}
        for q, items in exact.items():
            items.sort()
            self.exact[q] = (np.array([h for h, _ in items], dtype=np.uint64), np.array([i for _, i in items], dtype=np.int64))
        self.seeds = {}
        for q, parts in found.items():
            h, off, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            use = np.unique(np.stack([h.view(np.int64), off, n], axis=1), axis=0)
            key = np.ascontiguousarray(use[:, 0]).view(np.uint64)
            order = np.argsort(key, kind="stable")
            bitmap = np.zeros(1 << 20, dtype=bool)
            bitmap[(key & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.seeds[q] = (key[order], use[order, 1], use[order, 2], bitmap)
        if self.words:
            padded = np.full((len(self.words), self.longest), _PAD, dtype=np.uint64)
            for i, w in enumerate(self.words):
                padded[i, : len(w)] = w
            self.buckets = []
            for r, codes in enumerate(self.codes(padded, self.n)):
                order = np.argsort(codes, kind="stable")
                self.buckets.append((codes[order], order))

    def codes(self, windows: np.ndarray, n: np.ndarray) -> np.ndarray:
        """REPEATS x windows: the sampled symbols of each random walk over a window, hashed with its size.

        The walk writes the word it stands on, for three times the window's words, and moves on by a bit that depends
        on the step and the word: equal windows walk alike, and after an edit walks fall into step again.
        """
        m = len(windows)
        at = np.zeros((REPEATS, m), dtype=np.int64)
        rows = np.arange(m)
        want = (self.sample[:, :, None] * (3 * n)[None, None, :]).astype(np.int64)
        out = np.broadcast_to(mix(n.astype(np.uint64)), (REPEATS, m)).copy()
        last = windows.shape[1] - 1
        for j in range(3 * int(n.max(initial=0))):
            word = windows[rows, np.minimum(at, last)]
            word = np.where(at >= n, _PAD, word)
            for b in range(BITS):
                hit = want[:, b, :] == j
                out = np.where(hit, mix(out ^ word), out)
            at += (word * self.walk[j] >> np.uint64(63)).astype(np.int64)
        return out

    def windows(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, size) of the item-sized windows that hold a seed where an item has it."""
        row_of = words.rows()
        rows, starts, sizes = [], [], []
        for q, (key, off, n, bitmap) in self.seeds.items():
            h, at = words.grams(q)
            maybe = np.flatnonzero(bitmap[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(key, h[maybe], "left"), np.searchsorted(key, h[maybe], "right")
            hits = np.flatnonzero(hi > lo)
            if not len(hits):
                continue
            times = (hi - lo)[hits]
            which = np.repeat(lo[hits], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            place = np.repeat(at[maybe[hits]], times)
            row = row_of[place]
            rows.append(row)
            starts.append(np.clip(place - off[which], words.first[row], None))
            sizes.append(n[which])
        if not rows:
            return (np.zeros(0, np.int64),) * 3
        row, start, size = (np.concatenate(x) for x in (rows, starts, sizes))
        code = np.unique(start * (self.longest + 1) + size)
        start, size = code // (self.longest + 1), code % (self.longest + 1)
        return row_of[start], start, size

    def exactly(self, words: Words) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(edits, first word, words) of the first occurrence in each text of each item that allows no edit."""
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        row_of = words.rows()
        for q, (key, item) in self.exact.items():
            h, at = words.grams(q)
            lo, hi = np.searchsorted(key, h, "left"), np.searchsorted(key, h, "right")
            hit = np.flatnonzero(hi > lo)
            # each text and hash once, at its first place
            _, first = np.unique(np.stack([row_of[at[hit]], lo[hit]]), axis=1, return_index=True)
            for x in hit[np.sort(first)].tolist():
                for i in item[lo[x] : hi[x]].tolist():
                    if np.array_equal(words.hash[at[x] : at[x] + q], self.words[i]):
                        row = int(row_of[at[x]])
                        found[row, i] = (0, int(at[x] - words.first[row]), q)
        return found

    def matches(self, column: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first word, words, edits) of the best match of each item in each text."""
        words = Words(column)
        if not self.words or not len(words.hash):
            return []
        row, start, size = self.windows(words)
        best = self.exactly(words)
        padded = np.append(words.hash, np.full(self.longest + 1, _PAD, np.uint64))
        for lo in range(0, len(start), 4096):
            r, s, n = row[lo : lo + 4096], start[lo : lo + 4096], size[lo : lo + 4096]
            span = np.arange(int(n.max()))
            index = s[:, None] + span
            window = np.where((span < n[:, None]) & (index < words.first[r + 1][:, None]), padded[np.minimum(index, len(padded) - 1)], _PAD)
            codes = self.codes(window, n)
            pairs = set()
            for rep, (known, order) in enumerate(self.buckets):
                a, b = np.searchsorted(known, codes[rep], "left"), np.searchsorted(known, codes[rep], "right")
                for w in np.flatnonzero(b > a):
                    for i in order[a[w] : b[w]]:
                        pairs.add((int(w), int(i)))
            for w, i in pairs:
                k = _allowed(len(self.words[i]), self.similarity)
                first = max(int(words.first[r[w]]), int(s[w]) - 2 * k)
                end = min(int(words.first[r[w] + 1]), int(s[w]) + len(self.words[i]) + 2 * k)
                edits, a, length = best_edit(self.words[i], words.hash[first:end])
                if edits <= k:
                    own = (edits, first + a - int(words.first[r[w]]), length)
                    best[int(r[w]), i] = min(own, best.get((int(r[w]), i), own))
        return [(r, i, a, length, edits) for (r, i), (edits, a, length) in sorted(best.items())]


def best_edit(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance (by words) of the item to any run of the text; where that begins, and its words.

    One row of the table at a time; the place where a run began travels in the low digits of its cost.
    """
    m = len(text)
    step = _STEP * np.arange(m + 1)
    now = np.arange(m + 1)
    for word in item:
        up = now + _STEP
        up[1:] = np.minimum(up[1:], now[:-1] + np.where(text == word, 0, _STEP))
        now = np.minimum.accumulate(up - step) + step
    end = int((now // _STEP).argmin())
    return int(now[end]) // _STEP, int(now[end]) % _STEP, end - int(now[end]) % _STEP


def item_blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text", similarity: float = SIMILARITY, min_words: int = 1) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, one at a time; items of fewer than ``min_words`` words are left out."""
    rows = benchmark.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null").dropDuplicates(["id", "text"])
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // (2 * BLOCK_WORDS)))
    for b in range(n):  # a stated query set, one bounded block at a time
        own = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b)
        got = own.orderBy("id", "text").toArrow().combine_chunks()
        words = Words(got.column("text").chunk(0) if got.num_rows else pa.array([], pa.string()))
        ids, lists = [], []
        for i, item in enumerate(got.column("id").to_pylist()):
            w = words.hash[words.first[i] : words.first[i + 1]]
            if len(w) >= max(min_words, 1):
                ids.append(item)
                lists.append(w)
        yield Items(ids, lists, similarity)


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, min_words: int = 1) -> DataFrame:
    """doc_id, item_id, first_word, n_words, edits, similarity: the best match of each item in each text that has it.

    A text has an item if some run of its words is within (1 - similarity) * words edits of the item's words; words are
    runs without white space, A-Z in lower case. Windows are those of an item's size around a run of words that the
    allowed number of edits must leave whole somewhere; they are hashed by the sampled walks, and only windows that
    share a bucket with an item are verified. An equal window always shares all buckets.

    An item so short that it allows no edit must occur as it is. A null text or item has no words and matches nothing,
    as does an item of fewer than ``min_words`` words. Repeated rows give repeated results, an empty table none; other
    columns are left out. No shuffle: texts meet the broadcast blocks of items where they are.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = None
    for items in item_blocks(benchmark, item_key, item_text, similarity, min_words):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in slices(batches, most=PIECE):
                got = items.matches(batch.column(1))
                row, item, first, n, edits = (list(x) for x in zip(*got, strict=True)) if got else ([],) * 5
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row, pa.int64())),
                        pa.array([items.ids[i] for i in item], pa.int64()),
                        pa.array(first, pa.int32()),
                        pa.array(n, pa.int32()),
                        pa.array(edits, pa.int32()),
                        pa.array([1 - e / len(items.words[i]) for e, i in zip(edits, item, strict=True)], pa.float64()),
                    ],
                    names=["doc_id", "item_id", "first_word", "n_words", "edits", "similarity"],
                )

        part = rows.mapInArrow(run, "doc_id long, item_id long, first_word int, n_words int, edits int, similarity double")
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the rows whose text has an item of at least ``min_words`` words; columns, nulls and repeated rows stay."""
    spark = docs.sparkSession
    names = docs.columns
    out = docs.toDF(*[f"c{i}" for i in range(len(names))])
    column, schema = f"c{names.index(text)}", out.schema
    for items in item_blocks(benchmark, item_key, item_text, similarity, min_words):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, column, PIECE):
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[r for r, *_ in shared.value.matches(batch.column(batch.schema.get_field_index(column)))]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, schema)
    return out.toDF(*names)

"""Spelling variants: words one edit apart, found by walking trie shards with each word's automaton."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartwork.llm.common import new_folder, small, written

#: Letters of a word.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
MIN_CHARS = 6
MIN_COUNT = 5
#: How many times as often as a word its form must occur.
TIMES = 5
#: Words of a shard, and of a block of queries.
SHARD_WORDS = 25_000
#: Bytes of packed shards that are broadcast together.
ROUND_BYTES = 32 << 20
_CHUNK = 1 << 20
_FLUSH = 200_000


def _pieces(text: str) -> Iterator[str]:
    """A long text cut where no word is cut."""
    at = 0
    while at < len(text):
        to = at + _CHUNK
        while to < len(text) and RUN.match(text, to):
            to += 1
        yield text[at:to]
        at = to


def runs_of(text: str | None) -> Counter:
    """How often a text has each maximal run of letters, A-Z in lower case."""
    if not text:
        return Counter()
    # lower() of bytes changes A-Z alone
    text = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    found: Counter = Counter()
    for piece in _pieces(text):
        found.update(RUN.findall(piece))
    return found


def _word_counts(min_chars: int, misspelt: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                base = zlib.crc32(f"{doc_id}:".encode()) if doc_id is not pd.NA else None
                for word, n in runs_of(text).items():
                    if len(word) < min_chars:
                        continue
                    if misspelt and base is not None:
                        h = zlib.crc32(word.encode(), base)
                        if h % misspelt == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_chars:
                                continue
                    total[word] += n
                if len(total) > _FLUSH:
                    yield pd.DataFrame({"word": list(total.keys()), "n": list(total.values())})
                    total.clear()
        yield pd.DataFrame({"word": pd.Series(list(total.keys()), dtype="object"), "n": pd.Series(list(total.values()), dtype="int64")})

    return run


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, misspelt: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words of at least ``min_chars`` letters that occur ``min_count`` times in all texts.

    Given ``misspelt``, a run of letters loses one of them in one of so many documents, chosen by a CRC of document and
    run (never in a row without id). Counts are added up in the tasks before they are shuffled.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = rows.mapInPandas(_word_counts(min_chars, misspelt), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---------------------------------------------------------------- tries


def pack(words: list[str], counts: list[int]) -> bytes:
    """Sorted words front-coded: a trie in depth-first order, each word as the letters shared with the one before and the rest."""
    out, before = [], ""
    for word, n in zip(words, counts, strict=True):
        k = _shared(before, word)
        out.append(f"{k},{n},{word[k:]}")
        before = word
    return zlib.compress("\n".join(out).encode(), 6)


def _shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def unpack(data: bytes) -> tuple[dict, int]:
    """The trie of packed words: a node maps a letter to a node, or to (rest of the only word below, its count).

    The key "" of a node has the count of the word that ends there.
    """
    words, shared, counts = [], [], []
    text = zlib.decompress(data).decode()
    for line in text.split("\n") if text else []:
        k, n, rest = line.split(",")
        words.append(words[-1][: int(k)] + rest if words else rest)
        shared.append(int(k))
        counts.append(int(n))
    root: dict = {}
    for i, word in enumerate(words):
        deep = max(shared[i], shared[i + 1] if i + 1 < len(words) else 0)  # letters that another word has too
        node = root
        for c in word[:deep]:
            node = node.setdefault(c, {})
        if deep < len(word):
            node[word[deep]] = (word[deep + 1 :], counts[i])
        else:
            node[""] = counts[i]
    return root, len(words)


def _rest(node: dict | tuple, word: str) -> int:
    """The count of the word that goes from a node by just these letters, 0 if there is none."""
    for i, c in enumerate(word):
        if type(node) is tuple:
            return node[1] if node[0] == word[i:] else 0
        node = node.get(c)
        if node is None:
            return 0
    if type(node) is tuple:
        return node[1] if not node[0] else 0
    return node.get("", 0)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter makes a into b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = _shared(a, b)
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :]
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def neighbours(word: str, root: dict) -> Iterator[tuple[str, int]]:
    """The words of a trie that the automaton of distance one accepts, once each, with their counts.

    The automaton goes down with the word; at each of its states the one edit may come, after which only the rest of
    the word is accepted: a walk over the trie's branches, depth first, that leaves each dead one at once.
    """
    node: dict | tuple | None = root
    for i, c in enumerate(word):
        if type(node) is tuple:
            if one_edit(node[0], word[i:]):
                yield word[:i] + node[0], node[1]
            return
        rest, here = word[i + 1 :], word[i:]
        if (not i or word[i - 1] != c) and (n := _rest(node, rest)):  # of equal letters in a row, the first goes
            yield word[:i] + rest, n
        for x, child in node.items():
            if x == c or not x:
                continue
            if n := _rest(child, rest):
                yield word[:i] + x + rest, n
            if n := _rest(child, here):  # a letter equal to the next is put after it instead
                yield word[:i] + x + here, n
        node = node.get(c)
        if node is None:
            return
    if type(node) is tuple:
        if len(node[0]) == 1:
            yield word + node[0], node[1]
        return
    for x, child in node.items():
        if x and (n := _rest(child, "")):
            yield word + x, n


# ---------------------------------------------------------------- Spark


def trie_shards(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(shard, n_words, data): ranges of the sorted words, each packed as a trie of at most ``shard_words`` words."""
    n = max(1, -(-words.count() // shard_words))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, counts = [], []
        for batch in batches:
            held += batch["word"].tolist()
            counts += batch["n"].tolist()
            while len(held) >= shard_words:
                yield pd.DataFrame({"first": [held[0]], "n_words": [shard_words], "data": [pack(held[:shard_words], counts[:shard_words])]})
                held, counts = held[shard_words:], counts[shard_words:]
        if held:
            yield pd.DataFrame({"first": [held[0]], "n_words": [len(held)], "data": [pack(held, counts)]})

    return words.repartitionByRange(n, "word").sortWithinPartitions("word").mapInPandas(run, "first string, n_words long, data binary")


def _against(shards):
    """Each block of words against all broadcast shards: only one shard's trie is held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: list[str] = []
        for batch in batches:
            words += batch["word"].tolist()
            if len(words) >= SHARD_WORDS:
                yield _block(words, shards.value)
                words = []
        if words:
            yield _block(words, shards.value)

    return run


def _block(words: list[str], shards: list[bytes]) -> pd.DataFrame:
    near, form, form_n = [0] * len(words), [None] * len(words), [0] * len(words)
    for data in shards:
        root, _ = unpack(data)
        for i, word in enumerate(words):
            for other, n in neighbours(word, root):
                near[i] += 1
                if n > form_n[i] or n == form_n[i] and other < form[i]:
                    form[i], form_n[i] = other, n
    frame = pd.DataFrame({"word": words, "n_near": near, "form": form, "form_n": form_n})
    return frame[frame["n_near"] > 0]


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, n_near, form, form_n): how many words are one edit away, and the most frequent of them (ties: the least).

    Packed shards are broadcast in rounds of at most ``round_bytes``, so that neither driver nor executors hold more,
    however many words there are; each round's accepted neighbours are reduced by word in the tasks and written.
    """
    spark = words.sparkSession
    words = words.select("word", "n")
    shards = written(trie_shards(words, shard_words), "shards")
    sizes = sorted((r["first"], r["size"]) for r in shards.select("first", F.octet_length("data").alias("size")).collect())  # one row a shard
    rounds: list[list[str]] = []
    room = 0
    for first, size in sizes:
        if not rounds or size > room:
            rounds.append([])
            room = round_bytes
        rounds[-1].append(first)
        room -= size
    at = new_folder(spark, "near")
    schema = "word string, n_near long, form string, form_n long"
    spark.createDataFrame([], schema).write.parquet(at)
    blocks = words.select("word").repartitionByRange(max(len(sizes), 1), "word")
    for own in rounds:
        held = shards.where((F.col("first") >= own[0]) & (F.col("first") <= own[-1])).select("data").collect()
        sent = spark.sparkContext.broadcast([bytes(r["data"]) for r in held])
        blocks.mapInPandas(_against(sent), schema).write.mode("append").parquet(at)
        sent.unpersist()
    found = spark.read.schema(schema).parquet(at)
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.m")).alias("form_n"))


def roots(forms: DataFrame, rounds: int = 40) -> DataFrame:
    """(word, root) of the rows of (word, form): forms followed to the last. Pointers double each round.

    A form is more frequent than its word, so there is no circle.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        up = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        step = now.join(small(up), F.col("root") == F.col("_w"), "left")
        new = written(step.select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        now = new.select("word", "root")
    raise RuntimeError(f"roots did not settle in {rounds} rounds")


def group_variants(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
    times: int = TIMES,
    misspelt: int = 0,
    key: str = "doc_id",
    text: str = "text",
    shard_words: int = SHARD_WORDS,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    ``n_near`` counts the words one edit away; ``form`` is the most frequent of them (ties: the least in code-point
    order) if it occurs ``times`` times as often as the word, else null; ``root`` is where forms end, the word itself
    without one. Null and empty texts have no words; repeated rows count each; an empty table gives no row. Other
    columns are left out.
    """
    words = written(vocabulary(docs, min_chars, min_count, misspelt, key, text), "vocabulary")
    near = near_words(words, shard_words, round_bytes)
    keep = F.col("form_n") >= times * F.col("n")
    joined = words.join(near, "word", "left").withColumns({"n_near": F.coalesce("n_near", F.lit(0)), "form": F.when(keep, F.col("form")), "form_n": F.when(keep, F.col("form_n"))})
    joined = written(joined, "forms")
    ends = roots(joined.where("form is not null"))
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

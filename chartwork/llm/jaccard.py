"""N-gram Jaccard self-join as a blocked sparse product of the document by shingle incidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartwork.llm.common import BROADCAST_ROWS, Words, components, mix, shingle_sets, slices, small, written

WORDS = 5
#: A pair links when BELOW * intersection >= ABOVE * union.
ABOVE, BELOW = 80, 100
#: A shingle that a block of text has in so many rows is counted there; with so many in all, it goes last in the order.
LOCAL, FREQUENT = 3, 64
#: Columns of the incidence with more rows than this are multiplied with pivots first.
LARGE = 8
#: Bytes of text whose shingles are worked out at a time.
PIECE = 1 << 20
#: Least and most bits of a set's parity map.
LEAST_BITS, MOST_BITS = 256, 1 << 16


def _hashed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, shingle sets and where each row's set begins, of pieces small enough for NumPy's working memory."""
    for batch in slices(batches, most=PIECE):
        sets, edge = shingle_sets(Words(batch.column(1)), words)
        yield batch.column(0), sets, edge


def parity_maps(sets: np.ndarray, edge: np.ndarray) -> pa.ListArray:
    """For each set the parity of its members at each of some hashed bits, about as many bits as members.

    Maps of two sets differ in no more bits than the sets in members; a map of twice the bits, folded, is one of half.
    """
    n = np.diff(edge)
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)
    start = np.append(0, np.cumsum(bits))
    row = np.repeat(np.arange(len(n)), n)
    at = (mix(sets.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(start[row] + at, minlength=start[-1]) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array((start // 64).astype(np.int32)), pa.array(np.packbits(odd, bitorder="little").view(np.int64)))


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in slices(batches):
            seen = []
            for ids, sets, edge in _hashed(iter([block]), words):
                n = np.diff(edge)
                code, some = sets.view(np.uint64), edge[:-1][n > 0]
                s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if len(some):
                    s1[n > 0] = np.add.reduceat(mix(code), some)
                    s2[n > 0] = np.add.reduceat(mix(code ^ np.uint64(0xA5A5A5A5DEADBEEF)), some)
                seen.append((n.astype(np.int64), s1.view(np.int64), s2.view(np.int64), sets, ids, parity_maps(sets, edge)))
            n, s1, s2, sets = (np.concatenate([x[i] for x in seen]) for i in range(4))
            ids, maps = (pa.concat_arrays([x[i] for x in seen]) for i in (4, 5))
            seen.clear()
            sets.sort()
            first = np.flatnonzero(np.append(True, sets[1:] != sets[:-1])[: len(sets)])
            times = np.diff(np.append(first, len(sets)))
            often = times >= LOCAL
            lists = np.full(len(n) + 1, often.sum(), dtype=np.int32)
            lists[0] = 0
            of = [pa.ListArray.from_arrays(lists, pa.array(x.astype(np.int64))) for x in (sets[first[often]], times[often])]
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (n, s1, s2)), maps, *of], names=["id", "n", "s1", "s2", "bits", "often", "times"])

    return run


def _prefixes(words: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, level = frequent.value
        for column, sets, edge in _hashed(batches, words):
            n = np.diff(edge)
            row = np.repeat(np.arange(len(n)), n)
            if len(last) and len(sets):
                at = np.minimum(np.searchsorted(last, sets), len(last) - 1)
                order = np.argsort(row * 64 + np.where(last[at] == sets, level[at], 0), kind="stable")
                sets = sets[order]
            length = n - (ABOVE * n + BELOW - 1) // BELOW + 1
            take = np.arange(len(sets)) - np.repeat(edge[:-1], n) < length[row]
            ids = column.take(pa.array(row[take]))
            yield pa.RecordBatch.from_arrays([pa.array(sets[take]), ids, pa.array(n[row[take]])], names=["token", "id", "n"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets, edge in _hashed(batches, words):
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(sets))], names=["id", "tokens"])

    return run


def _fits(a: str = "na", b: str = "nb") -> Column:
    """Sizes that allow the similarity at all."""
    return F.least(a, b) * BELOW >= F.greatest(a, b) * ABOVE


def _need(a: str = "na", b: str = "nb") -> Column:
    """Least overlap of linked sets of these sizes: ABOVE / (ABOVE + BELOW) of both sizes together, rounded up."""
    return F.ceil((F.col(a) + F.col(b)) * ABOVE / (ABOVE + BELOW) - 1e-9)


def _possible() -> Column:
    """Whether the parity maps ``ba`` and ``bb`` differ in no more bits than linked sets of these sizes may."""
    fold = "CASE WHEN size({0}) > size({1}) THEN zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (p, q) -> p ^ q) ELSE {0} END"
    differ = F.expr(f"aggregate(zip_with({fold.format('ba', 'bb')}, {fold.format('bb', 'ba')}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)")
    return differ <= F.col("na") + F.col("nb") - 2 * _need()


class _Join:
    def __init__(self, docs: DataFrame, known: DataFrame, words: int) -> None:
        self.spark, self.docs, self.known, self.words = docs.sparkSession, docs, known, words

    def with_maps(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, ...) whose sizes and parity maps allow a link."""
        for side in "ab":
            own = self.known.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("bits").alias(f"b{side}"))
            pairs = pairs.drop(f"n{side}").join(own, side)
        return pairs.where(_fits() & _possible()).drop("ba", "bb")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that link, by the exact overlap of their whole sets; pairs must be few, and likely."""
        pairs = written(pairs.select("a", "b").distinct(), "pairs")
        ids = written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "pair-ids")
        rows = self.docs.join(small(ids), "id", "left_semi").select("id", "text").mapInArrow(_sets(self.words), "id long, tokens array<long>")
        sets = written(rows, "sets")
        left, right = (sets.select(F.col("id").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
        full = pairs.join(right, "b").join(left, "a")
        overlap = F.size(F.array_intersect("ta", "tb"))
        counted = full.select("a", "b", overlap.alias("o"), (F.size("ta") + F.size("tb")).alias("total"))
        return written(counted.where(F.col("o") * BELOW >= (F.col("total") - F.col("o")) * ABOVE).select("a", "b").distinct(), "links")

    def postings(self, frequent: dict[int, int]) -> DataFrame:
        """The incidence restricted to prefixes: (token, id, n, held) of the columns that at least two rows hold.

        Two sets over the threshold share a token of their prefixes in any one order of all tokens. The order is:
        tokens not known as frequent, then by how frequent they are. Where frequent tokens that only the prefixes show
        would make more pairs than there are rows, they are put last in a second pass; the links are the same.
        """
        for again in (True, False):
            token = np.array(sorted(frequent), dtype=np.int64)
            level = np.array([int(frequent[t]).bit_length() for t in token.tolist()], dtype=np.int64)
            shared = self.spark.sparkContext.broadcast((token, level))  # at most BROADCAST_ROWS tokens
            rows = written(self.docs.select("id", "text").mapInArrow(_prefixes(self.words, shared), "token long, id long, n long"), "prefixes")
            held = written(rows.groupBy("token").agg(F.count("*").alias("held")).where("held > 1"), "held")
            new = {t: c for t, c in _most(held, "token", "held") if t not in frequent} if again else {}
            if sum(c * (c - 1) // 2 for c in new.values()) <= rows.count():
                break
            frequent = dict(sorted((frequent | new).items(), key=lambda x: (-x[1], x[0]))[:BROADCAST_ROWS])
        # both sides are read from files, so that Spark splits the partition of a token that very many rows hold
        return written(rows.join(held, "token"), "postings")

    def pivots(self, large: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        """Links found by multiplying crowded columns with one pivot each, and the components these make.

        A column whose rows are all in one component needs no more pairs, so a group of near copies costs one pair a
        row. Columns of several components get further pivots from the rows outside of their largest component, as
        long as some link is found: each such round leaves fewer components.
        """
        links = comp = None
        while True:
            rows = large if comp is None else self.with_component(large, comp)
            if comp is None:
                rows = rows.withColumn("comp", F.col("id"))
                others = rows
            else:
                others = self.others(rows)
                many = others.groupBy("token").agg(F.count("*").alias("rest")).where(F.col("rest") > LARGE).select("token")
                others = others.join(many, "token")
            pivot = others.groupBy("token").agg(F.min(F.struct("id", "n", "comp")).alias("p"))
            star = others.join(pivot, "token").select(F.col("p.id").alias("a"), F.col("id").alias("b"), F.col("p.n").alias("na"), F.col("n").alias("nb"), F.col("p.comp").alias("ca"), "comp")
            star = star.where("a <> b and ca <> comp").where(_fits())
            star = self.with_maps(star.groupBy("b", "a").agg(F.count("*").alias("c")))
            best = star.groupBy("b").agg(F.max(F.struct("c", (-F.col("a")).alias("minus"))).alias("m"))
            found = self.linked(best.select((-F.col("m")["minus"]).alias("a"), "b"))
            if found.isEmpty():
                return links, comp
            links = found if links is None else links.unionByName(found)
            comp = written(components(links), "components")

    def with_component(self, rows: DataFrame, comp: DataFrame) -> DataFrame:
        known = rows.join(comp.withColumnRenamed("component", "_c"), "id", "left")
        return known.withColumn("comp", F.coalesce("_c", "id")).drop("_c")

    def others(self, rows: DataFrame) -> DataFrame:
        """The rows of each column outside of its largest component."""
        largest = rows.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "comp")).alias("m"))
        return rows.join(largest, "token").where(F.col("m")["comp"] != F.col("comp")).drop("m")

    def rest(self, postings: DataFrame, comp: DataFrame | None) -> DataFrame:
        """Pairs of different components whose overlap within the prefixes lets them reach the threshold.

        Beyond the prefix that ends first, a pair shares at most the rest of that set. In crowded columns, parity maps
        keep pairs from being made at all.
        """
        rows = postings.withColumn("comp", F.col("id")) if comp is None else self.with_component(postings, comp)
        fine, crowded = rows.where(F.col("held") <= LARGE), rows.where(F.col("held") > LARGE)

        def sides(x: DataFrame, y: DataFrame, *more: str) -> DataFrame:
            x = x.select("token", F.col("id").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), *[F.col(c).alias("ba") for c in more])
            y = y.select("token", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), *[F.col(c).alias("bb") for c in more])
            return x.join(y, "token").where(_fits() & (F.col("ca") != F.col("cb")))

        both = sides(fine, fine).where("a < b").select("a", "b", "na", "nb", "token")
        # a pair of different components has a row outside of the largest
        crowded = crowded.join(self.known.select("id", "bits"), "id")
        more = sides(self.others(crowded), crowded, "bits").where(_possible())
        swap = F.col("a") > F.col("b")
        more = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb"), "token").distinct()
        counted = both.unionByName(more).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
        after = F.greatest(*[F.ceil(F.col(n) * ABOVE / BELOW - 1e-9) - 1 for n in ("na", "nb")])
        return self.with_maps(counted.where(F.col("c") + after >= _need()).select("a", "b"))


def _most(counts: DataFrame, token: str, count: str) -> list[tuple[int, int]]:
    """The most frequent tokens with their counts, from FREQUENT on, at most BROADCAST_ROWS: an order needs no more."""
    got = counts.where(F.col(count) >= FREQUENT).orderBy(F.desc(count), token).limit(BROADCAST_ROWS).select(token, count).toArrow()
    return list(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the least doc_id reachable over links.

    Words are runs of other characters than \\x20 and \\x09-\\x0D, with A-Z in lower case. A document's set are its
    distinct shingles of ``words`` words, or its whole sequence as one if it has fewer; without words it is empty and
    links with nothing. Two documents link when 100 * intersection >= 80 * union. No link between different sets is
    lost, but pairs known to be in one component already are not formed.

    Equal sets are one row of the incidence, named by the least doc_id. Shingles are 64-bit hashes. Rows of one doc_id
    count as one document; a row with a null id has a null component. Other columns are left out. An empty table gives
    an empty one.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    signed = written(rows.mapInArrow(_signatures(words), "id long, n long, s1 long, s2 long, bits array<long>, often array<long>, times array<long>"), "signatures")
    counted = signed.where(F.size("often") > 0).select(F.explode(F.arrays_zip("often", "times")).alias("x")).groupBy("x.often").agg(F.sum("x.times").alias("c"))
    frequent = dict(_most(counted, "often", "c"))
    classes = signed.where("n > 0 and id is not null").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"))
    member = written(signed.select("id", "n", "s1", "s2", "bits").join(classes, ["n", "s1", "s2"], "left").select("id", "n", "rep", F.when(F.col("id") == F.col("rep"), F.col("bits")).alias("bits")), "members")

    copies = member.where("id <> rep or rep is null").select("id").where("id is not null").distinct()
    unique = rows.where("id is not null").join(small(written(copies, "copies")), "id", "left_anti")
    known = member.where("id = rep").dropDuplicates(["id"]).select("id", "n", "bits")
    join = _Join(unique, known, words)
    postings = join.postings(frequent)
    links, comp = join.pivots(postings.where(F.col("held") > LARGE))
    more = join.linked(join.rest(postings, comp))
    links = more if links is None else links.unionByName(more)
    member = member.drop("bits")
    if not links.isEmpty():
        comp = components(links).withColumnRenamed("id", "rep")
        member = member.join(comp, "rep", "left")
    else:
        member = member.withColumn("component", F.lit(None).cast("long"))
    nearest = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return member.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), nearest.alias("component_id"))


def near_duplicates_dropped(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` with one document of each component left, the one of least doc_id; rows without an id stay.

    A document without words is its own component and stays. Of repeated rows of a kept doc_id, all stay.
    """
    found = jaccard_components(docs, key, text, words)
    gone = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct(), "near-copies")
    return docs.join(small(gone), key, "left_anti")

"""Fuzzy substring dedup: shared k-mer seeds, chained with a Fenwick tree, aligned to passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwork.llm.common import Words, _gram, slices, small, written

#: Words of a seed, and seeds of a run of which the least is taken: a shared run of K + WINDOW - 1 words has a shared seed.
K, WINDOW = 6, 12
#: The same for long seeds, whose first occurrence shares far more: a shared run of 50 words has one, wherever else its parts occur.
LONG, LONG_WINDOW = 30, 21
#: Longest period of a text that goes round in circles; there, seeds are as long as a passage.
PERIOD = 16
#: Least words of a passage, and least part of an alignment that matches.
MIN_WORDS, SIMILARITY = 50, 0.8
#: Cost of a word of gap between seeds, and least seeds of a chain.
GAP, MIN_SEEDS = 0.2, 2
#: Words looked at beyond the ends of a chain at first, and how far an alignment may leave the chain's diagonals at
#: first. An alignment that comes within SLACK words of the ends of what it saw is worked out again on eight times as
#: many, and one that touches the border of its band on twice the band: neither is a limit.
MARGIN, BAND, SLACK = 64, 12, 16
#: An alignment goes on beyond its chain until its score has fallen by this much, ten changed words.
DROP = 40.0
#: Words that must match after an edit for an alignment to go on there without a table, and the edits that are tried.
RESYNC = 8
STEPS = sorted(((i, j) for i in range(4) for j in range(4) if i or j), key=lambda p: (max(p), abs(p[0] - p[1])))
#: Bytes of text worked on at a time.
PIECE = 2 << 20
#: Spans of one document that travel with one copy of its text, and chains whose spans are broadcast at most.
TOGETHER, BROADCAST_CHAINS = 256, 250_000


SEED = "seed long, doc long, at int, reach int"
PASSAGE = "doc_id long, first_word long, end_word long, ref_doc_id long, ref_first long, ref_end long, similarity double"


def minimisers(words: Words, k: int, window: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of the runs of ``k`` words that are least in some ``window`` of them, ascending.

    A text of fewer runs than a window gives its least one if ``short``. Of neighbouring equal runs, as in a run of
    one word, the first and the last stay: a chain uses no other.
    """
    h, at = words.grams(k)
    if not len(h):
        return h, at
    row = words.rows()[at]
    pick = np.zeros(0, np.int64)
    if len(h) >= window:
        low = np.lib.stride_tricks.sliding_window_view(h, window).argmin(axis=1) + np.arange(len(h) - window + 1)
        pick = np.unique(low[row[: len(low)] == row[window - 1 :]])
    if short:
        edge = np.searchsorted(row, np.arange(len(words.first)))
        few = np.flatnonzero((np.diff(edge) > 0) & (np.diff(edge) < window))
        if len(few):
            pick = np.unique(np.concatenate([pick, *[[edge[i] + h[edge[i] : edge[i + 1]].argmin()] for i in few]]).astype(np.int64))
    if len(pick):
        same = np.append(False, (h[pick[1:]] == h[pick[:-1]]) & (np.diff(pick) == 1))
        pick = pick[~same | ~np.append(same[1:], False)]
        pick = pick[~_amid(h, at, k, pick)[pick]]
    return h[pick], at[pick]


def _amid(h: np.ndarray, at: np.ndarray, k: int, pick: np.ndarray) -> np.ndarray:
    """Which runs of ``k`` words lie amid a long stretch that repeats with a period of 2 to PERIOD, and say nothing new there.

    Those of one period in each MIN_WORDS words stay, with those of the first one and of the last passage: a document
    that has a passage of the stretch meets all of it, by a chain a passage in place of one a period.
    """
    amid, seen = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
    for p in range(2, PERIOD + 1):
        if not (h[pick] == h[np.minimum(pick + p, len(h) - 1)]).any():  # picks are in every stretch
            continue
        same = (h[p:] == h[:-p]) & (at[p:] - at[:-p] == p)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
        wide = p if p <= WINDOW else 2 * p
        step = p * max(1, (MIN_WORDS - p) // p)
        for lo, hi in zip(edge[::2].tolist(), (edge[1::2] + p).tolist(), strict=True):
            last = hi - 1 + k - MIN_WORDS - wide - lo  # where the last passage begins, about
            if last > step and not seen[(lo + hi) // 2]:  # of the multiples of a period the least
                seen[lo:hi] = True
                place = np.arange(hi - lo)
                gone = (place % step >= wide) & (place < hi - lo - wide) & ((place < last) | (place > last + wide))
                amid[lo:hi] |= gone
    return amid


def periodic(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of runs of ``n`` words in stretches that repeat with a period of at most PERIOD.

    All runs of such a stretch are those that begin in its first period. Texts share its other seeds with many that
    have a shorter stretch, these only with those that have ``n`` words of it.
    """
    h, at = words.grams(K)
    row = words.rows()
    picks = [np.zeros(0, np.int64)]
    for p in range(1, PERIOD + 1):
        same = (h[p:] == h[:-p]) & (at[p:] - at[:-p] == p)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
        begin, size = edge[::2], edge[1::2] - edge[::2] + K - 1 + p
        for i in range(p):
            long = size >= n + i
            picks.append(at[begin[long]] + i)
    first = np.unique(np.concatenate(picks))
    first = first[row[first] == row[np.minimum(first + n - 1, len(row) - 1)]] if len(first) else first
    return _gram(words.hash, first, n), first


def _seeds(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=PIECE):
            words = Words(batch.column(1))
            parts = [(K, minimisers(words, K, WINDOW, True)), (LONG, minimisers(words, LONG, LONG_WINDOW, False)), (min_words, periodic(words, min_words))]
            h, at = (np.concatenate([x[i] for _, x in parts]) for i in (0, 1))
            row = words.rows()[at] if len(at) else at
            reach = np.repeat([k - K for k, _ in parts], [len(x[0]) for _, x in parts])
            place = (at - words.first[row]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(place), pa.array(reach.astype(np.int32))], names=["seed", "doc", "at", "reach"])

    return run


def chain(pa_: np.ndarray, pb: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Chains of anchors in order on both sides: (first a, end a, first b, end b) of each with MIN_SEEDS anchors."""
    return [c[:4] for c in banded_chains(pa_, pb)]


def banded_chains(pa_: np.ndarray, pb: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """The chains, with the least and the largest b - a of their anchors.

    An anchor is worth its words; each word between two anchors costs GAP, half for either side. With linear gaps the
    best anchor before a given one has the largest score plus cost already gone, which a Fenwick tree over the places
    in ``a`` gives in log n. One chain for each start, up to its best end, and one
    for each seed that ``b`` repeats.
    """
    pa_, pb = np.unique(np.stack([pa_, pb], axis=1), axis=0).T  # a long seed may begin where a short one does
    order = np.lexsort((-pa_, pb))
    rank = np.searchsorted(np.unique(pa_), pa_) + 1
    size = int(rank.max()) + 1
    tree: list[tuple[float, int]] = [(-1e18, -1)] * size
    n = len(pa_)
    score, start, count = [0.0] * n, list(range(n)), [1] * n
    best: dict[int, int] = {}
    a, b, rk = pa_.tolist(), pb.tolist(), rank.tolist()
    low, high = (pb - pa_).tolist(), (pb - pa_).tolist()
    for i in order.tolist():
        top, r = (-1e18, -1), rk[i] - 1
        while r:
            top = max(top, tree[r])
            r -= r & -r
        gone = GAP * (a[i] + b[i]) / 2
        j = top[1]
        gain = top[0] - gone if j >= 0 else -1.0
        # words shared with the seed before count once; the steps onto a new word cost nothing
        worth = min(K, a[i] - a[j], b[i] - b[j]) if j >= 0 and gain + GAP * K > 0 else K
        if j >= 0 and gain + GAP * K > 0:
            score[i], start[i], count[i] = gain + worth + GAP * worth, start[j], count[j] + 1
            low[i], high[i] = min(low[i], low[j]), max(high[i], high[j])
        else:
            score[i] = float(K)
        s = start[i]
        if s not in best or score[i] > score[best[s]]:
            best[s] = i
        value, r = (score[i] + gone, i), rk[i]
        while r < size:
            if value > tree[r]:
                tree[r] = value
            r += r & -r
    found = [(a[s], a[e] + K, b[s], b[e] + K, low[e], high[e]) for s, e in best.items() if count[e] >= MIN_SEEDS]
    # a seed again and again, as in a run of one word: the alignment starts from its first place, if no chain has that
    seen, times = np.unique(pa_, return_counts=True)
    repeated = set(seen[times >= MIN_SEEDS].tolist())
    for i in order.tolist() if repeated else ():  # by rising b
        if a[i] in repeated:
            repeated.discard(a[i])
            e = best[start[i]]
            if count[e] < MIN_SEEDS or b[i] > b[e] or a[i] > a[e]:
                found.append((a[i], a[i] + K, b[i], b[i] + K, b[i] - a[i], b[i] - a[i]))
    return found


def _by_diagonal(chains: list[tuple[int, int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """The chains of two documents, those on one and the same diagonal as one: an alignment looks at its whole span."""
    out, one = [], {}
    for c in chains:
        if c[4] != c[5]:
            out.append(c)
        elif c[4] in one:
            o = one[c[4]]
            one[c[4]] = (min(o[0], c[0]), max(o[1], c[1]), min(o[2], c[2]), max(o[3], c[3]), c[4], c[4])
        else:
            one[c[4]] = c
    return out + list(one.values())


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (a, b); a pair may go on in the next batch."""
    rest = None
    names = ["a", "b", "pa", "pb"]

    def run(cols: list[np.ndarray]) -> pa.RecordBatch:
        a, b, x, y = cols
        edge = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True]]))
        out = []
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if hi - lo >= MIN_SEEDS:
                out += [(int(a[lo]), int(b[lo]), *c) for c in _by_diagonal(banded_chains(x[lo:hi], y[lo:hi]))]
        cols = list(zip(*out, strict=True)) if out else [()] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "a0", "a1", "b0", "b1", "d0", "d1"])

    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        other = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        rest = [c[cut:] for c in cols]
        if cut:
            yield run([c[:cut] for c in cols])
    if rest is not None and len(rest[0]):
        yield run(rest)


def _runs_about(min_words: int):
    """The runs of ``min_words`` words about long seeds, as seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=PIECE):
            words = Words(batch.column(1))
            rows, firsts = [], []
            for row, asked in enumerate(batch.column(2).to_pylist()):
                begin, end = int(words.first[row]), int(words.first[row + 1])
                at = np.unique(np.add.outer(np.array(asked, np.int64), np.arange(LONG - min_words, 1)))
                at = at[(at >= 0) & (at <= end - begin - min_words)]
                rows.append(np.full(len(at), row))
                firsts.append(begin + at)
            row, first = (np.concatenate(x).astype(np.int64) for x in (rows, firsts))
            h = _gram(words.hash, first, min_words).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), batch.column(0).take(pa.array(row)), pa.array((first - words.first[row]).astype(np.int32)), pa.array(np.full(len(h), min_words - K, np.int32))], names=["seed", "doc", "at", "reach"])

    return run


def _spans(margin: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words (as 32-bit hashes) of the asked spans of each text, wider by ``margin``, and the text's words in all."""
        for batch in slices(batches, most=PIECE):
            words = Words(batch.column(batch.schema.get_field_index("text")))
            chains, sides, firsts, totals, spans = [], [], [], [], []
            for row, asked in enumerate(batch.column(batch.schema.get_field_index("asked")).to_pylist()):
                own = words.hash[words.first[row] : words.first[row + 1]]
                for x in asked:
                    lo = max(0, x["lo"] - margin)
                    chains.append(x["chain"])
                    sides.append(x["side"])
                    firsts.append(lo)
                    totals.append(len(own))
                    spans.append((own[lo : x["hi"] + margin] >> np.uint64(32)).astype(np.int64).astype(np.uint32).view(np.int32))
            edge = np.append(0, np.cumsum([len(x) for x in spans])).astype(np.int32)
            flat = np.concatenate(spans) if spans else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(chains, pa.int64()), pa.array(sides, pa.int32()), pa.array(firsts, pa.int64()), pa.array(totals, pa.int64()), pa.ListArray.from_arrays(pa.array(edge), pa.array(flat))], names=["chain", "side", "first", "total", "words"])

    return run


def align(x: np.ndarray, y: np.ndarray, d0: int, d1: int, band: int = BAND) -> tuple[int, int, int, int, float] | None:
    """The best local alignment of x and y about the diagonals y - x in [d0, d1]: (x0, x1, y0, y1, part that matches).

    A match is worth 1, a changed, added or left-out word costs SIMILARITY / (1 - SIMILARITY): a positive score means
    that more than SIMILARITY of the alignment matches.
    """
    cost = SIMILARITY / (1 - SIMILARITY)
    if d0 == d1:  # one diagonal: no gaps, the best run of a sum
        lo = max(0, -d0)
        n = min(len(x) - lo, len(y) - lo - d0)
        same = x[lo : lo + n] == y[lo + d0 : lo + d0 + n]
        total = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -cost))])
        rise = total - np.minimum.accumulate(total)
        end = int(rise.argmax())
        if rise[end] <= 0:
            return None
        begin = int(np.flatnonzero(total[: end + 1] == total[: end + 1].min())[-1])
        return lo + begin, lo + end, lo + d0 + begin, lo + d0 + end, float(same[begin:end].mean())
    near0, near1 = d0, d1
    d0, d1 = max(d0 - band, -len(x)), min(d1 + band, len(y))
    width = d1 - d0 + 1
    if width <= 0:
        return None
    score, begin = np.zeros(width), np.zeros((width, 4), dtype=np.int64)  # where from (x, y), matches, whether the border was touched
    step = cost * np.arange(width)
    best, found = 0.0, None
    col = np.arange(width)
    for i in range(len(x)):
        j = i + d0 + col
        inside = (j >= 0) & (j < len(y))
        same = np.zeros(width, dtype=bool)
        same[inside] = y[j[inside]] == x[i]
        across = score + np.where(same, 1.0, -cost)  # same diagonal: same column
        across[~inside] = -1e9
        down = np.append(score[1:], -1e9) - cost  # x[i] left out
        fresh = begin.copy()
        fresh[score <= 0] = 0
        fresh[score <= 0, 0] = i
        fresh[score <= 0, 1] = j[score <= 0]
        fresh[:, 2] += same
        new, take = across, down > across
        new = np.where(take, down, across)
        origin = np.where(take[:, None], np.vstack([begin[1:], begin[-1:]]), fresh)
        # words of y left out: carried along the row
        lifted = np.maximum.accumulate(new + step)
        source = np.maximum.accumulate(np.where(new + step >= lifted, col, 0))
        flat = lifted - step
        gap = flat > new
        score = np.maximum(np.where(gap, flat, new), 0)
        begin = np.where(gap[:, None], origin[source], origin)
        begin[0, 3] |= d0 > -len(x)
        begin[-1, 3] |= d1 < len(y)
        top = int(score.argmax())
        if score[top] > best:
            best = float(score[top])
            found = (int(begin[top, 0]), i + 1, int(begin[top, 1]), int(j[top]) + 1, int(begin[top, 2]), int(begin[top, 3]))
    if found is None:
        return None
    x0, x1, y0, y1, matches, touched = found
    if touched:  # the path may go on outside
        return align(x, y, near0, near1, 2 * band)
    return x0, x1, y0, y1, matches / max(x1 - x0, y1 - y0)


def _equal(x: np.ndarray, y: np.ndarray) -> int:
    """Words of x and y that are equal from their start on."""
    n, size = 0, 64
    while True:
        a, b = x[n : n + size], y[n : n + size]
        most = min(len(a), len(b))
        same = a[:most] == b[:most]
        if not same.all():
            return n + int(same.argmin())
        n += most
        if most < size:
            return n
        size *= 4


def _resumes(x: np.ndarray, i: int, y: np.ndarray, j: int) -> bool:
    """Whether RESYNC words from x[i] and y[j] on are equal: most are told apart by the first or the last."""
    if i + RESYNC > len(x) or j + RESYNC > len(y) or x[i] != y[j] or x[i + RESYNC - 1] != y[j + RESYNC - 1]:
        return False
    return bool((x[i : i + RESYNC] == y[j : j + RESYNC]).all())


def _hopeless(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether a table of x and y, which differ in their first words, is sure to end where it begins.

    A word of x that y doesn't have near its start costs at least as much as a changed one, any other is worth 1 at
    most: if the sum falls by DROP before it rises, no alignment does better. Not told where words may go on to match
    or a path may come to the border of the band.
    """
    cost = SIMILARITY / (1 - SIMILARITY)
    rows = x[:64].tolist()
    there = set(y[: len(rows) + BAND + RESYNC].tolist())
    bound, run, matched = 0.0, 0, 0
    for r, v in enumerate(rows):
        if v in there:
            bound, run, matched = bound + 1, run + 1, matched + 1
        else:
            bound, run = bound - cost, 0
        if run >= RESYNC or matched > 7 or (bound - cost if matched == r + 1 else bound) > 0:
            return False
        if bound < -DROP:
            ahead = rows[r + 1 : r + 1 + RESYNC]
            return not (len(ahead) == RESYNC and all(w in there for w in ahead))
    return len(rows) < 64


def _table(x: np.ndarray, y: np.ndarray, band: int = BAND) -> tuple[int, int, int, float, bool]:
    """Words of x and y that the best alignment of their starts takes in, matches and score; whether RESYNC words go on to match there.

    It ends where its best cell is followed by such words, or where the score has fallen by DROP.
    """
    cost = SIMILARITY / (1 - SIMILARITY)
    col = np.arange(2 * band + 1)
    step = cost * col
    score = np.where(col >= band, -cost * (col - band), -1e9)
    matches = np.zeros(len(col), dtype=np.int64)
    best, at = 0.0, (0, 0, 0)
    for i in range(len(x)):
        j = i - band + col
        inside = (j >= 0) & (j < len(y))
        same = inside & (y[np.clip(j, 0, len(y) - 1)] == x[i])
        across = np.where(inside, score + np.where(same, 1.0, -cost), -1e9)
        down = np.append(score[1:], -1e9) - cost
        new = np.maximum(across, down)
        got = np.where(down > across, np.append(matches[1:], 0), matches + same)
        lifted = np.maximum.accumulate(new + step)
        source = np.maximum.accumulate(np.where(new + step >= lifted, col, 0))
        score = np.where((j >= -1) & (j < len(y)), lifted - step, -1e9)
        matches = got[source]
        top = int(score.argmax())
        to = int(j[top]) + 1
        if score[top] > best:
            best, at = float(score[top]), (i + 1, to, int(matches[top]))
        if _resumes(x, i + 1, y, to):
            return i + 1, to, int(matches[top]), float(score[top]), True
        if max(score[0], score[-1]) > best - DROP and band < max(len(x), len(y)):  # a path may go on outside
            return _table(x, y, 2 * band)
        if score[top] < best - DROP:
            break
    return *at, best, False


def extended(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """How many words of x and of y, both from their start, an alignment takes in, and how many of them match.

    Equal words are taken as they are; after a few edits the alignment goes on where RESYNC words match, and a table
    decides elsewhere. It ends where its score was largest before it fell by DROP.
    """
    cost = SIMILARITY / (1 - SIMILARITY)
    i = j = matches = 0
    score, best, at = 0.0, 0.0, (0, 0, 0)
    while True:
        n = _equal(x[i:], y[j:])
        i, j, matches, score = i + n, j + n, matches + n, score + n
        if score > best:
            best, at = score, (i, j, matches)
        if i >= len(x) or j >= len(y):
            return at
        for di, dj in STEPS:
            if _resumes(x, i + di, y, j + dj):
                i, j, score = i + di, j + dj, score - cost * max(di, dj)
                break
        else:
            if _hopeless(x[i:], y[j:]):
                return at
            di, dj, more, gain, on = _table(x[i:], y[j:])
            if not on:
                return (i + di, j + dj, matches + more) if score + gain > best else at
            i, j, matches, score = i + di, j + dj, matches + more, score + gain
        if score < best - DROP:
            return at


def _cut_short(start: int, end: int, size: int, first: int, total: int) -> tuple[bool, bool]:
    """Whether an alignment comes near to either end of the words that were seen, where the text has more."""
    return start < SLACK and first > 0, end > size - SLACK and first + size < total


def alignments(x: np.ndarray, y: np.ndarray, d0: int, d1: int, span: tuple[int, int], start: int, min_words: int) -> list[tuple[int, int, int, int, float]]:
    """The alignments along a chain, which spans x[span] and begins at y[start]; its anchors lie on diagonals from d0 to d1.

    The first goes out from the chain's start if its anchors are on several diagonals, and is the best run of the one
    diagonal otherwise; the parts of the span that are left are searched for further ones. Each goes on beyond the
    chain as long as it can.
    """
    found, work = [], [(*span, 0, len(y))]
    if d0 != d1:
        nx, ny, more = extended(x[span[0] :], y[start:])
        px, py, less = extended(x[: span[0]][::-1], y[:start][::-1])
        found.append((span[0] - px, span[0] + nx, start - py, start + ny, (more + less) / max(px + nx, py + ny, 1)))
        work = [(span[0] + nx, span[1], start + ny, len(y))] if span[1] - span[0] - nx >= K else []
    while work:
        xa, xb, ya, yb = work.pop()
        got = align(x[xa:xb], y[ya:yb], d0 + xa - ya, d1 + xa - ya)
        if not got:
            continue
        x0, x1, y0, y1 = got[0] + xa, got[1] + xa, got[2] + ya, got[3] + ya
        same = got[4] * max(x1 - x0, y1 - y0)
        # a part at an end of the span may go on outside
        if x0 - xa >= (K if xa == span[0] else min_words) and y0 - ya >= (K if xa == span[0] else min_words):
            work.append((xa, x0, ya, y0))
        if xb - x1 >= (K if xb == span[1] else min_words) and yb - y1 >= (K if xb == span[1] else min_words):
            work.append((x1, xb, y1, yb))
        nx, ny, more = extended(x[x1:], y[y1:])
        px, py, less = extended(x[:x0][::-1], y[:y0][::-1])
        x0, x1, y0, y1 = x0 - px, x1 + nx, y0 - py, y1 + ny
        if not found or min(x1 - x0, y1 - y0) >= min_words:
            found.append((x0, x1, y0, y1, min(1.0, (same + more + less) / max(x1 - x0, y1 - y0))))
    return found


def _align_all(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            whole = {n: v.to_pylist() for n, v in get.items() if not n.startswith("words")}
            out = []
            for i in range(batch.num_rows):
                x, y = (get[n][i].values.to_numpy(zero_copy_only=False) for n in ("words_a", "words_b"))
                fa, fb, ta, tb = (whole[n][i] for n in ("first_a", "first_b", "total_a", "total_b"))
                if min(ta, tb) < min_words:
                    continue
                shift = fa - fb
                for x0, x1, y0, y1, same in alignments(x, y, whole["d0"][i] + shift, whole["d1"][i] + shift, (whole["a0"][i] - fa, whole["a1"][i] - fa), whole["b0"][i] - fb, min_words):
                    (al, ar), (bl, br) = _cut_short(x0, x1, len(x), fa, ta), _cut_short(y0, y1, len(y), fb, tb)
                    # where one of the texts ends, the other's further words don't matter
                    more = (al or bl) and x0 + fa > 0 and y0 + fb > 0 or (ar or br) and x1 + fa < ta and y1 + fb < tb
                    if more or min(x1 - x0, y1 - y0) >= min_words and same >= SIMILARITY:
                        out.append((whole["b"][i], fb + y0, fb + y1, whole["a"][i], fa + x0, fa + x1, same, whole["chain"][i], more))
            cols = list(zip(*out, strict=True)) if out else [()] * 9
            types = [pa.int64()] * 6 + [pa.float64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "first_word", "end_word", "ref_doc_id", "ref_first", "ref_end", "similarity", "chain", "more"])

    return run


def _aligned(unique: DataFrame, chains: DataFrame, margin: int, min_words: int) -> DataFrame:
    """The alignments of chains of which ``margin`` words beyond either end are seen."""
    few = chains.limit(BROADCAST_CHAINS + 1).count() <= BROADCAST_CHAINS

    def asked(side: int, doc: str, lo: str, hi: str) -> DataFrame:
        return chains.select(F.col(doc).alias("doc"), F.struct(F.col("chain"), F.lit(side).alias("side"), F.col(lo).alias("lo"), F.col(hi).alias("hi")).alias("x"))

    wanted = asked(0, "a", "a0", "a1").unionByName(asked(1, "b", "b0", "b1"))
    # a document that many others share passages with is asked in as many pieces as it takes, each dealt by itself
    pieces = written(wanted.groupBy("doc").agg(F.ceil(F.count("*") / TOGETHER).alias("pieces")).where("pieces > 1"), "pieces")
    piece = F.coalesce(F.pmod(F.xxhash64("x.chain"), F.col("pieces")), F.lit(0))
    parts = int(unique.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = wanted.join(small(pieces), "doc", "left").withColumn("piece", piece).repartition(parts, "doc", "piece")
    lists = written(dealt.groupBy("doc", "piece").agg(F.collect_list("x").alias("asked")), "asked")
    spans = unique.join(F.broadcast(lists) if few else lists, "doc").select("text", "asked").mapInArrow(_spans(margin), "chain long, side int, first long, total long, words array<int>")
    spans = written(spans, "spans")
    left, right = (spans.where(F.col("side") == s).select("chain", *[F.col(c).alias(f"{c}_{n}") for c in ("first", "total", "words")]) for s, n in ((0, "a"), (1, "b")))
    return written(chains.join(left, "chain").join(right, "chain").mapInArrow(_align_all(min_words), PASSAGE + ", chain long, more boolean"), "aligned")


def _met(seeds: DataFrame) -> DataFrame:
    """(seed, a, b, pa, pb, reach, times): each occurrence of a seed with the seed's first one, by document."""
    head = seeds.groupBy("seed").agg(F.min(F.struct("doc", "at")).alias("head"), F.count("*").alias("times")).where("times > 1")
    # written, so that both sides of the join are shuffles whose large partitions Spark splits
    head = written(head, "heads")
    return written(seeds.join(head, "seed").where("doc <> head.doc").select("seed", F.col("head.doc").alias("a"), F.col("doc").alias("b"), F.col("head.at").alias("pa"), F.col("at").alias("pb"), "reach", "times"), "met")


def _passages(unique: DataFrame, met: DataFrame, min_words: int) -> DataFrame:
    """The passages along the chains of the anchors that seeds make."""
    # a long seed has two anchors, one at either end
    ends = F.when(F.col("reach") > 0, F.array(F.lit(0), F.col("reach"))).otherwise(F.array(F.lit(0)))
    anchors = met.withColumn("o", F.explode(ends)).select("a", "b", (F.col("pa") + F.col("o")).alias("pa"), (F.col("pb") + F.col("o")).alias("pb"))
    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chains = anchors.repartition(parts, "a", "b").sortWithinPartitions("a", "b").mapInArrow(_chains, "a long, b long, a0 long, a1 long, b0 long, b1 long, d0 long, d1 long")
    return _extended(unique, written(chains.withColumn("chain", F.monotonically_increasing_id()), "chains"), min_words)


def _extended(unique: DataFrame, chains: DataFrame, min_words: int) -> DataFrame:
    """The alignments of chains, worked out again on more words where those seen at first don't do."""
    passages, margin, left = None, MARGIN, chains
    while True:
        got = _aligned(unique, left, margin, min_words)
        done = got.where("not more").drop("chain", "more")
        passages = done if passages is None else passages.unionByName(done)
        again = got.where("more").select("chain").distinct()
        if again.isEmpty():
            return passages
        left, margin = written(left.join(again, "chain"), "longer"), 8 * margin


def _open_seeds(met: DataFrame, passages: DataFrame) -> DataFrame:
    """(seed) of the long seeds of three occurrences or more, one of which is in no passage with the first one.

    Nor in any passage by which its document and the first one's are known to be in one class.
    """
    own = met.where((F.col("reach") == LONG - K) & (F.col("times") > 2)).select("seed", "a", "b", "pb")
    p = passages.select("doc_id", "ref_doc_id", "first_word", "end_word").distinct()
    inside = (F.col("b") == p["doc_id"]) & (p["first_word"] <= F.col("pb")) & (F.col("pb") + LONG <= p["end_word"])
    loose = written(own.join(p, inside & (F.col("a") == p["ref_doc_id"]), "left_anti"), "loose")
    bare = loose.join(p, inside, "left_anti").select("seed")
    least = written(p.groupBy("doc_id").agg(F.min("ref_doc_id").alias("ref")), "least")
    label = lambda side, name: small(least.select(F.col("doc_id").alias(side), F.col("ref").alias(name)))
    known = loose.join(label("a", "ra"), "a", "left").join(label("b", "rb"), "b", "left")
    apart = known.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("seed")
    return written(bare.unionByName(apart).distinct(), "open-seeds")


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Passages of at least ``min_words`` words that a text shares, but for a few words, with another document's.

    Columns: doc_id, first_word, end_word (not included), ref_doc_id, ref_first, ref_end, similarity, and ``kind``:
    ``copy`` for a text equal to that of a lower doc_id (its whole text is the passage), else ``passage``. Every
    occurrence of a seed is paired with the seed's first one, by doc_id, so a passage that n documents share gives
    n - 1 rows or a few more, not all pairs; where parts of it point to different documents, alignments go on beyond
    the seeds. Words are runs without white space, A-Z in lower case.

    An alignment is extended as long as it reaches the ends of the words that were looked at. Two documents that share
    a run of ``min_words`` words as it is are in one class, whatever earlier documents hold of it: long seeds whose
    occurrences are not all joined with the first one are replaced by the runs of ``min_words`` words about them.

    An empty table gives an empty one. Null and empty texts have no passages. Rows of one doc_id count as one document and are not compared with each
    other; rows without doc_id are left out, as are other columns.
    """
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    print_of = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), F.length("text").alias("n")]
    prints = rows.select("doc", *print_of)
    first = prints.groupBy("h1", "h2", "n").agg(F.min("doc").alias("ref"), F.count("*").alias("times")).where("times > 1")
    copies = written(prints.join(first, ["h1", "h2", "n"]).where("doc <> ref and n > 0").select("doc", "ref").distinct(), "copies")
    unique = rows.join(small(copies.select("doc").distinct()), "doc", "left_anti").select("doc", "text")

    # written: read once for the heads and once for what meets them
    seeds = written(unique.mapInArrow(_seeds(max(min_words, K)), SEED), "seeds")
    met = _met(seeds)
    passages = _passages(unique, met, min_words)
    open_ = _open_seeds(met, passages)
    if min_words > LONG and not open_.isEmpty():
        asked = seeds.where(F.col("reach") == LONG - K).join(small(open_), "seed", "left_semi").groupBy("doc").agg(F.collect_set("at").alias("asked"))
        runs = written(unique.join(small(written(asked, "asked-runs")), "doc").select("doc", "text", "asked").mapInArrow(_runs_about(min_words), SEED), "runs")
        passages = passages.unionByName(_passages(unique, _met(runs), min_words))
    passages = passages.distinct().withColumn("kind", F.lit("passage"))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = Words(batch.column(2)).counts()
            whole = pa.array(n.astype(np.int64))
            zero = pa.array(np.zeros(len(n), np.int64))
            out = pa.RecordBatch.from_arrays([batch.column(0), zero, whole, batch.column(1), zero, whole, pa.array(np.ones(len(n)))], names=["doc_id", "first_word", "end_word", "ref_doc_id", "ref_first", "ref_end", "similarity"])
            yield out.filter(pa.array(n >= min_words))

    same = rows.join(small(copies), "doc").select("doc", "ref", "text").mapInArrow(sized, PASSAGE).distinct().withColumn("kind", F.lit("copy"))
    return passages.unionByName(same)

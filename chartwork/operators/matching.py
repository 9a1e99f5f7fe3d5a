"""Distances of structures over all orders of their atoms: auctions of many cost matrices at once, and rotations in turn."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Matrix entries that one task holds at a time.
_ENTRIES = 1 << 20
#: Bids of the last phase, in parts of a matrix's range of costs: a matching costs at most this times n more than the least.
_LAST_BID = 1e-12
#: Rows of a matrix up to which its least assignment is worked out over sets of columns, and matrices at a time there.
_SETS, _TOGETHER = 8, 2048


def _by_sets(cost: np.ndarray) -> np.ndarray:
    """``assigned`` of small matrices: the least cost of the first rows over each set of as many columns, n 2^n / 2 steps for the whole batch."""
    m, n, _ = cost.shape
    cell = np.ascontiguousarray(cost.transpose(1, 2, 0))
    least, other = np.full((1 << n, m), np.inf), np.empty(m)
    least[0] = 0.0
    for mask in range(1, 1 << n):
        row = mask.bit_count() - 1
        for c in range(n):
            if mask >> c & 1:
                np.add(least[mask ^ 1 << c], cell[row, c], out=other)
                np.minimum(least[mask], other, out=least[mask])
    mine, left, at = np.empty((m, n), dtype=np.int64), np.full(m, (1 << n) - 1), np.arange(m)
    for row in range(n - 1, -1, -1):
        ways = [np.where(left >> c & 1, least[left & ~(1 << c), at] + cell[row, c], np.inf) for c in range(n)]
        mine[:, row] = np.argmin(ways, axis=0)
        left ^= 1 << mine[:, row]
    return mine


def assigned(cost: np.ndarray) -> np.ndarray:
    """For each matrix of a batch (m, n, n) the column of each row, all different, of least total cost.

    An auction: every row without a column bids for its best one what this is worth more to it than the second best,
    and a little; the highest bid takes a column from its owner. The little falls from phase to phase, prices stay.
    """
    m, n, _ = cost.shape
    mine = np.zeros((m, n), dtype=np.int64)
    if n < 2 or not m:
        return mine
    if n <= _SETS:
        return np.concatenate([_by_sets(cost[lo : lo + _TOGETHER]) for lo in range(0, m, _TOGETHER)])
    low = cost.min(axis=(1, 2), keepdims=True)
    span = cost.max(axis=(1, 2), keepdims=True) - low
    worth = (low - cost) / np.where(span > 0, span, 1.0)
    price, little, last = np.zeros((m, n)), 0.25, max(_LAST_BID, 1e-10 / n)
    while True:
        mine[:] = -1
        owner = np.full((m, n), -1, dtype=np.int64)
        f, r = np.nonzero(mine < 0)
        while len(f):
            at = np.arange(len(f))
            gain = worth[f, r] - price[f]
            best = gain.argmax(axis=1)
            first = gain[at, best]
            gain[at, best] = -np.inf
            bid = price[f, best] + first - gain.max(axis=1) + little
            column = f * n + best
            order = np.lexsort((bid, column))
            won = order[np.append(column[order][1:] != column[order][:-1], True)]
            wf, wr, wc = f[won], r[won], best[won]
            out = owner[wf, wc]
            mine[wf[out >= 0], out[out >= 0]] = -1
            owner[wf, wc], mine[wf, wr], price[wf, wc] = wr, wc, bid[won]
            f, r = np.nonzero(mine < 0)
        if little <= last:
            return mine
        little = max(little / 6, last)


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return ((p[:, :, None, :] - q[:, None, :, :]) ** 2).sum(axis=3)


def _matched(q: np.ndarray, column: np.ndarray) -> np.ndarray:
    return np.take_along_axis(q, column[:, :, None], axis=1)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Costs that order matchings as ``_gaps`` does: without the squares, of which each matching has all."""
    return -(p @ q.transpose(0, 2, 1))


def _mean_gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((p - q) ** 2).sum(axis=2).mean(axis=1))


def _turned(p: np.ndarray, q: np.ndarray, by: np.ndarray) -> np.ndarray:
    """``by`` after the proper rotation that takes q nearest to p."""
    u, _, v = np.linalg.svd(q.transpose(0, 2, 1) @ p)
    u[:, :, 2] *= np.where(np.linalg.det(u @ v) < 0, -1.0, 1.0)[:, None]
    return by @ (u @ v)


def _axes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Orthonormal axes (rows) of pairs of vectors: along a, then towards b; some perpendicular where b lies along a."""
    e1 = a / np.maximum(np.linalg.norm(a, axis=-1, keepdims=True), 1e-300)
    e1 = np.where(np.linalg.norm(e1, axis=-1, keepdims=True) > 0.5, e1, np.array([1.0, 0, 0]))
    e2 = b - (b * e1).sum(axis=-1, keepdims=True) * e1
    other = np.eye(3)[np.abs(e1).argmin(axis=-1)]
    other = other - (other * e1).sum(axis=-1, keepdims=True) * e1
    size = np.linalg.norm(e2, axis=-1, keepdims=True)
    e2 = np.where(size > 1e-9 * np.maximum(np.linalg.norm(b, axis=-1, keepdims=True), 1e-300), e2, other)
    e2 = e2 / np.linalg.norm(e2, axis=-1, keepdims=True)
    return np.stack([e1, e2, np.cross(e1, e2)], axis=-2)


def _starts(p: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
    """(m, starts, n, 3): q as it is, and turned so that one of its ordered pairs of atoms takes the place of a pair of p.

    Of p the pair spans the largest triangle with the centre. Of q all pairs are tried, or the ``most`` whose
    lengths and angle are nearest to those of p's pair.
    """
    m, n, _ = p.shape
    area = np.linalg.norm(np.cross(p[:, :, None, :], p[:, None, :, :]), axis=3).reshape(m, -1)
    a, b = np.divmod(area.argmax(axis=1), n)
    own = np.arange(m)
    pa, pb = p[own, a], p[own, b]
    i, j = np.nonzero(~np.eye(n, dtype=bool))
    if not len(i):
        return q[:, None]
    off = ((q * q).sum(axis=2)[:, i] - (pa * pa).sum(axis=1)[:, None]) ** 2 + ((q * q).sum(axis=2)[:, j] - (pb * pb).sum(axis=1)[:, None]) ** 2
    off += 2 * ((q[:, i] * q[:, j]).sum(axis=2) - (pa * pb).sum(axis=1)[:, None]) ** 2
    near = np.argsort(off, axis=1, kind="stable")[:, :most]
    r = _axes(q[own[:, None], i[near]], q[own[:, None], j[near]]).transpose(0, 1, 3, 2) @ _axes(pa, pb)[:, None]
    return np.concatenate([q[:, None], q[:, None] @ r], axis=1)


def _unlike(orders: np.ndarray, seen: int) -> np.ndarray:
    """The rows (row, columns), once each, that aren't among the first ``seen`` of them."""
    width = orders.shape[1] - 1
    if (int(orders[:, 0].max(initial=0)) + 1) * width**width < 1 << 62:
        _, first = np.unique(orders @ np.append(width**width, [width**k for k in range(width)]), return_index=True)
    else:
        _, first = np.unique(orders, axis=0, return_index=True)
    return orders[first[first >= seen]]


def least_rmsd(p: np.ndarray, q: np.ndarray, improper: bool, most: int) -> np.ndarray:
    """The least root mean square gap found for each pair of centred structures, over orders of atoms and rotations.

    An order fixes the rotation and that the next order, so starts that come to one order go on as one.
    """
    m, n, _ = p.shape
    best = np.full(m, np.inf)
    for sign in (1.0, -1.0) if improper else (1.0,):
        t = _starts(p, sign * q, most)
        row = np.repeat(np.arange(m), t.shape[1])
        column = assigned(_apart(p[row], t.reshape(-1, n, 3)))
        # and by the order in which the atoms' sorted distances to the others agree best
        sides = [np.sort(np.sqrt(_gaps(x, x)), axis=2) for x in (p, q)]
        live = np.concatenate([np.column_stack([row, column]), np.column_stack([np.arange(m), assigned(_gaps(*sides))])])
        live = seen = _unlike(live, 0)
        while len(live):  # both steps lower the gap, and orders are finitely many
            row, column = live[:, 0], live[:, 1:]
            own = sign * q[row]
            at = _turned(p[row], _matched(own, column), own)
            np.minimum.at(best, row, _mean_gap(p[row], _matched(at, column)))
            both = np.concatenate([seen, np.column_stack([row, assigned(_apart(p[row], at))])])
            live = _unlike(both, len(seen))
            seen = np.concatenate([seen, live])
    return best


def _by_size(pairs: DataFrame, entries: Callable[[int], int], work: Callable[[np.ndarray, np.ndarray], np.ndarray], name: str) -> DataFrame:
    def whole(x: np.ndarray | None) -> bool:
        return x is not None and len(x) > 0 and len(x) % 3 == 0 and bool(np.isfinite(np.asarray(x, dtype=float)).all())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = np.array([whole(a) and whole(b) and len(a) == len(b) for a, b in zip(batch["xi"], batch["xj"], strict=True)], dtype=bool)
            bad = batch[~good]
            if len(bad):
                yield pd.DataFrame({"i": bad["i"], "j": bad["j"], name: [None] * len(bad)})
            fine = batch[good]
            for n, rows in fine.groupby(fine["xi"].map(len) // 3):
                step = max(1, _ENTRIES // entries(n))
                for lo in range(0, len(rows), step):
                    part = rows.iloc[lo : lo + step]
                    p, q = (np.stack(part[c].to_numpy()).astype(float).reshape(len(part), n, 3) for c in ("xi", "xj"))
                    yield pd.DataFrame({"i": part["i"], "j": part["j"], name: work(p, q)})

    # small rows of much work: their bytes don't tell how many tasks they need
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.select("i", "j", "xi", "xj").repartition(parts, "i", "j").mapInPandas(run, f"i long, j long, {name} double")


def assignment_distance(pairs: DataFrame) -> DataFrame:
    """(i, j, d) of pairs of flat coordinates xi and xj: the root mean square gap of atoms in the order that makes it least.

    Null where the structures differ in size, are empty or null, or have a coordinate that is not finite.
    """
    return _by_size(pairs, lambda n: 3 * n * n, lambda p, q: _mean_gap(p, _matched(q, assigned(_gaps(p, q)))), "d")


def permuted_rmsd(pairs: DataFrame, improper: bool = True, starts: int = 64) -> DataFrame:
    """(i, j, rmsd): the like after centring, over orders of atoms and rotations, with ``improper`` reflections too.

    Assignment and rotation alternate until the gap stays, from each start: ``starts`` pairs of atoms laid onto a pair
    of the other structure (all of them up to eight atoms) and the order of agreeing distances. It is an upper bound of
    the least gap; 0 for copies in any order and place. Null as in ``assignment_distance``.
    """

    def work(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return least_rmsd(p - p.mean(axis=1, keepdims=True), q - q.mean(axis=1, keepdims=True), improper, starts)

    return _by_size(pairs, lambda n: 3 * n * n * (min(n * (n - 1), starts) + 2), work, "rmsd")

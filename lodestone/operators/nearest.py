"""What the tasks of vector_index.knn_join run: the nearest rows of many vectors at once.

A product of matrices gives a lower bound of every distance, less than its own rounding error below it. Only rows
whose bound does not exceed a query's k-th distance so far have their distance computed, term after term as the
expressions of functions.scalar do, so that distances and ties are theirs to the last bit."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Queries and rows that one product meets, and pairs whose distance is computed at once.
QUERIES, ROWS, PAIRS = 512, 2048, 16384
#: Distances as whole numbers in the order of `asc_nulls_last`; EMPTY stands behind all.
NAN, NULL, EMPTY = 0x7FF8000000000000, 2**63 - 2, 2**63 - 1
FLIP = 2**63 - 1
TINY = 1e-300


def codes(distance, null):
    c = (distance + 0.0).view(np.int64)
    c = np.where(c < 0, c ^ FLIP, c)
    c[np.isnan(distance)] = NAN
    c[null] = NULL
    return c


def decoded(c):
    """The distances of codes; infinite where a code is no number."""
    d = np.where(c < 0, c ^ FLIP, c).view(np.float64)
    return np.where(c < NAN, d, np.inf)


def total(terms):
    """Sums of rows, added one term after the other."""
    return np.cumsum(terms, axis=1)[:, -1] + 0.0 if terms.shape[1] else np.zeros(len(terms))


def distances(q, x, metric):
    """The distance of each row of q to the same row of x, and where it is null."""
    if metric == "l2":
        return np.sqrt(total((x - q) ** 2)), np.zeros(len(q), bool)
    if metric == "ip":
        return -total(x * q), np.zeros(len(q), bool)
    length = np.sqrt(total(x * x) * total(q * q))
    return 1.0 - total(x * q) / length, length == 0


def plain(squares, metric):
    """Of which vectors the bounds hold: no overflow, and for the cosine no underflow, no length of 0."""
    return (squares <= 1e140) & (squares >= (1e-140 if metric == "cosine" else 0))


def error(width, metric):
    return (16 if metric == "cosine" else 8) * (width + 8) * np.finfo(float).eps


class Queries:
    """Queries of one length with the codes of their k nearest rows so far."""

    def __init__(self, keys, x, k, metric):
        self.keys, self.x, self.k, self.metric = keys, x, k, metric
        self.best = np.full((len(x), k), EMPTY)
        squares, c = (x * x).sum(1), error(x.shape[1], metric)
        self.plain = plain(squares, metric)
        self.squares = np.where(self.plain, squares, 1.0)
        norm, last, self.less = np.sqrt(self.squares), np.zeros(len(x)), np.zeros(len(x))
        if metric == "l2":
            last, self.less = last + 1.0, self.squares * (1 - c)
        elif metric == "ip":
            last = c * norm
        else:
            x, self.less = x / norm[:, None], self.less + 1 - c
        self.left = np.where(self.plain[:, None], np.column_stack([x, last]), 0.0)

    def meet(self, x):
        """Positions of queries and rows (x, in the order of their keys), codes and distances: all that can be among
        the k nearest."""
        width, k = x.shape[1], self.k
        x, kept = self.distinct(x)
        squares, c = (x * x).sum(1), error(width, self.metric)
        fine = plain(squares, self.metric)
        squares = np.where(fine, squares, 1.0)
        norm = np.sqrt(squares)
        if self.metric == "l2":
            right = np.column_stack([-2 * x, squares * (1 - c)])
        elif self.metric == "ip":
            right = np.column_stack([-x, -norm])
        else:
            right = np.column_stack([-x / norm[:, None], np.zeros(len(x))])
        right = np.where(fine[:, None], right, 0.0).T
        longest = squares.max()
        for a in range(0, len(self.x), QUERIES):
            at = slice(a, a + QUERIES)
            low = self.left[at] @ right
            far = decoded(self.best[at, -1])
            far = (far * far if self.metric == "l2" else far) + np.abs(far) * 1e-15 + TINY - self.less[at]
            new = np.flatnonzero(np.isinf(far) & self.plain[at])
            some = np.flatnonzero(fine)[: max(512, k)]
            if len(new) and len(some) >= k:
                # k rows are no farther than the k-th bound and what bounds may lack.
                lack = {"l2": self.squares[at][new] + longest, "ip": np.sqrt(self.squares[at][new] * longest)}.get(self.metric, 1.0)
                far[new] = np.partition(low[np.ix_(new, some)], k - 1, axis=1)[:, k - 1] + 4 * c * lack + TINY
            far[~self.plain[at]] = np.inf
            low[:, ~fine] = -np.inf
            q, r = np.divmod(np.flatnonzero(low <= far[:, None]), len(x))
            for p in range(0, len(q), PAIRS):
                yield from self.take(q[p : p + PAIRS] + a, r[p : p + PAIRS], x, kept)

    def take(self, q, r, x, kept):
        d, null = distances(self.x[q], x[r], self.metric)
        yield from self.add(q, kept[r], codes(d, null), d)

    def without(self, rows, last):
        """The same for rows (in the order of their keys) that have no distance. last: the codes of the k-th nearest
        before the rows that came with these, whose keys may be behind these rows' keys."""
        q = np.flatnonzero(last > NULL)
        q, r = np.repeat(q, len(rows[: self.k])), np.tile(rows[: self.k], len(q))
        yield from self.add(q, r, np.full(len(q), NULL), np.zeros(len(q)), last)

    def add(self, q, r, c, d, last=None):
        # Rows come in the order of their keys: one that ties with the k-th does not replace it.
        near = np.flatnonzero(c < (self.best[:, -1] if last is None else last)[q])
        near = near[np.lexsort((r[near], c[near], q[near]))]
        q = q[near]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else near
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        q, near, place = q[place < self.k], near[place < self.k], place[place < self.k]
        if not len(q):
            return
        who, line = np.unique(q, return_inverse=True)
        met = np.full((len(who), self.k), EMPTY)
        met[line, place] = c[near]
        self.best[who] = np.sort(np.concatenate([self.best[who], met], axis=1), axis=1)[:, : self.k]
        still = c[near] <= self.best[q, -1]
        q, near = q[still], near[still]
        yield q, r[near], c[near], d[near]

    def distinct(self, x):
        """The first k rows of every vector, and their positions: others of it cannot be among the k nearest."""
        odd = np.random.default_rng(1).integers(1, 2**63, x.shape[1], dtype=np.uint64) | np.uint64(1)
        h = np.ascontiguousarray(x).view(np.uint64) @ odd if x.shape[1] else np.zeros(len(x), np.uint64)
        order = np.argsort(h, kind="stable")
        same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
        same = same[(x[order[same]] == x[order[same + 1]]).all(1)]
        if not len(same):
            return x, np.arange(len(x))
        new = np.ones(len(x), bool)
        new[same + 1] = False
        first = np.flatnonzero(new)
        place = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)]))
        kept = np.sort(order[place < self.k])
        return x[kept], kept


def lengths(v):
    """Each vector's length, -1 where it or one of its elements is null; all elements, and where vectors begin."""
    at, null = v.offsets.to_numpy(), v.values.is_null().to_numpy(zero_copy_only=False)
    nulls = np.r_[0, np.cumsum(null)]
    bad = v.is_null().to_numpy(zero_copy_only=False) | (nulls[at[1:]] > nulls[at[:-1]])
    return np.where(bad, -1, np.diff(at)), v.values.to_numpy(zero_copy_only=False), at


def vectors(values, at, rows, length):
    return values[at[rows][:, None] + np.arange(length)].astype(np.float64)


class Cell:
    """A group of queries that meets a block of rows."""

    def __init__(self, k, metric):
        self.k, self.metric, self.waiting, self.by_length = k, metric, [], None

    def queries(self, keys, v):
        self.waiting.append((keys, v))

    def rows(self, keys, v):
        if self.by_length is None:
            self.gather()
        length, values, at = lengths(v)
        for n, queries in self.by_length.items():
            same, last = np.flatnonzero((length == n) & (n >= 0)), queries.best[:, -1].copy()
            found = list(queries.meet(vectors(values, at, same, n))) if len(same) else []
            found = [(q, same[r], c, d) for q, r, c, d in found] + list(queries.without(np.flatnonzero((length != n) | (n < 0)), last))
            if found:
                q, r, c, d = (np.concatenate(x) for x in zip(*found))
                yield queries.keys.take(pa.array(q)), keys.take(pa.array(r)), pa.array(d, mask=c == NULL)

    def gather(self):
        parts: dict[int, list] = {}
        for keys, v in self.waiting:
            length, values, at = lengths(v)
            for n in np.unique(length).tolist():
                which = np.flatnonzero(length == n)
                parts.setdefault(n, []).append((keys.take(pa.array(which)), vectors(values, at, which, max(n, 0))))
        self.waiting = []
        self.by_length = {n: Queries(pa.concat_arrays([k for k, _ in p]), np.concatenate([x for _, x in p]), self.k, self.metric) for n, p in parts.items()}


def search(batches, k, metric):
    """Columns _qk, _k and distance of all pairs that can be among the k nearest, from batches with columns _cell, _side
    (0: a query, 1: a row), _qk, _k, _v that are sorted by _cell, _side, _k."""
    now = cell = None
    with np.errstate(all="ignore"):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sides, qk, ks, v = (batch.column(n) for n in ("_cell", "_side", "_qk", "_k", "_v"))
            ids, sides = ids.to_numpy(), sides.to_numpy()
            turns = np.flatnonzero((ids[1:] != ids[:-1]) | (sides[1:] != sides[:-1])) + 1
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(ids)]):
                if ids[a] != now:
                    now, cell = ids[a], Cell(k, metric)
                for p in range(a, b, ROWS):
                    n = min(ROWS, b - p)
                    if not sides[a]:
                        cell.queries(qk.slice(p, n), v.slice(p, n))
                    else:
                        for found in cell.rows(ks.slice(p, n), v.slice(p, n)):
                            yield pa.RecordBatch.from_arrays(list(found), names=["_qk", "_k", "distance"])

"""Sparse symmetric systems of one machine's size: entries, products, and a direct factor.

``Entries`` is a matrix as sorted (row, col, value) arrays. ``SparseFactor`` is a
Cholesky factor by nested dissection: a separator splits the graph of the matrix
in two, and so on down to small leaves; the unknowns of a separator come after
those of its parts and form one dense front each. A front holds its own unknowns
and the later ones they touch, so the work is a few thousand small dense products
instead of millions of scalar steps, and the same fronts give, from the last
unknown to the first, the entries of the inverse on the factor's pattern.

The size of the fronts is known before any number is computed; beyond
``MOST_ENTRIES`` a factor is refused (conjugate gradients over tables remain).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

LEAF = 64
MOST_ENTRIES = 250_000_000  # doubles of all fronts: 2 GB


@dataclass(frozen=True)
class Entries:
    """A square matrix of ``size`` rows: entries sorted by row and column, each place once."""

    size: int
    row: np.ndarray
    col: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, size: int, row, col, value) -> Entries:
        """Entries at one place are added up."""
        row, col, value = np.asarray(row, np.int64), np.asarray(col, np.int64), np.asarray(value, float)
        place, inverse = np.unique(row * size + col, return_inverse=True)
        return cls(size, place // size, place % size, np.bincount(inverse, weights=value, minlength=len(place)))

    @classmethod
    def collected(cls, matrix: DataFrame, size: int) -> Entries:
        """From a table (row, col, value) of a model's parameters; its size is the model's, not the data's."""
        rows = matrix.select(*[matrix[c].cast(k) for c, k in zip(matrix.columns[:2], ("bigint", "bigint"), strict=True)], matrix["value"].cast("double")).toPandas()
        return cls.of(size, *(rows.iloc[:, k].to_numpy() for k in range(3)))

    @classmethod
    def diagonal(cls, values) -> Entries:
        values = np.asarray(values, float)
        at = np.arange(len(values))
        return cls(len(values), at, at, values)

    def starts(self) -> np.ndarray:
        """Where each row's entries begin, and the end of the last."""
        return np.searchsorted(self.row, np.arange(self.size + 1))

    def dense(self) -> np.ndarray:
        out = np.zeros((self.size, self.size))
        out[self.row, self.col] = self.value
        return out

    def __add__(self, other: Entries) -> Entries:
        return Entries.of(self.size, *(np.concatenate(x) for x in ((self.row, other.row), (self.col, other.col), (self.value, other.value))))

    def scaled(self, left=1.0, right=1.0) -> Entries:
        """Rows times ``left``, columns times ``right`` (numbers or vectors)."""
        left, right = np.broadcast_to(left, self.size), np.broadcast_to(right, self.size)
        return Entries(self.size, self.row, self.col, self.value * left[self.row] * right[self.col])

    def __matmul__(self, other):
        if isinstance(other, np.ndarray):
            return np.bincount(self.row, weights=self.value * other[self.col], minlength=self.size)
        begin = other.starts()
        count = begin[self.col + 1] - begin[self.col]
        at = np.repeat(begin[self.col] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
        return Entries.of(self.size, np.repeat(self.row, count), other.col[at], np.repeat(self.value, count) * other.value[at])


def _levels(begin: np.ndarray, to: np.ndarray, start: int) -> np.ndarray:
    """Steps from ``start`` to each vertex, -1 where there is no path."""
    level = np.full(len(begin) - 1, -1)
    level[start] = 0
    front, k = np.array([start]), 0
    while len(front):
        k += 1
        count = begin[front + 1] - begin[front]
        at = np.repeat(begin[front] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
        near = np.unique(to[at])
        front = near[level[near] < 0]
        level[front] = k
    return level


def dissection(pattern: Entries, leaf: int = LEAF) -> list[np.ndarray]:
    """The unknowns in groups, parts before the separators between them."""
    off = pattern.row != pattern.col
    todo = [(np.arange(pattern.size), pattern.row[off], pattern.col[off], False)]
    out: list[np.ndarray] = []
    while todo:
        own, row, col, done = todo.pop()
        if not len(own):
            continue
        if done or len(own) <= leaf:
            out.append(own)
            continue
        begin = np.searchsorted(row, np.arange(len(own) + 1))
        level = _levels(begin, col, 0)
        if (level >= 0).all():
            level = _levels(begin, col, int(level.argmax()))  # from far out, so that levels are thin
            size = np.bincount(level)
            if len(size) < 3:
                out.append(own)
                continue
            middle = 1 + int(np.abs(np.cumsum(size)[:-2] + size[1:-1] / 2 - len(own) / 2).argmin())
            part = np.sign(level - middle)
        else:
            part = np.where(level >= 0, -1, 1)
        # the stack gives the parts first and the separator after them; ``out`` is in order of elimination
        todo.append((own[part == 0], row[:0], col[:0], True))
        for side in (1, -1):
            mine = part == side
            number = np.cumsum(mine) - 1
            inside = mine[row] & mine[col]
            todo.append((own[mine], number[row[inside]], number[col[inside]], False))
    return out


class SparseFactor:
    """Cholesky factor of a symmetric positive definite ``Entries``."""

    def __init__(self, matrix: Entries, leaf: int = LEAF, most_entries: int = MOST_ENTRIES):
        self.size = n = matrix.size
        groups = dissection(matrix, leaf)
        self.step = np.empty(n, dtype=np.int64)  # the group of each unknown
        for k, g in enumerate(groups):
            self.step[g] = k
        begin = matrix.starts()
        children: list[list[int]] = [[] for _ in groups]
        self.fronts: list[tuple[np.ndarray, np.ndarray]] = []
        entries = 0
        for k, own in enumerate(groups):
            count = begin[own + 1] - begin[own]
            at = np.repeat(begin[own] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
            near = np.concatenate([matrix.col[at], *(self.fronts[c][1] for c in children[k])])
            later = np.unique(near[self.step[near] > k])
            later = later[np.argsort(self.step[later], kind="stable")]
            if len(later):
                children[int(self.step[later[0]])].append(k)
            self.fronts.append((own, later))
            entries += len(own) * (len(own) + len(later))
        if entries > most_entries:
            raise MemoryError(f"the factor has {entries} entries, {most_entries} are allowed")
        self.children, self.entries = children, entries
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []
        updates: dict[int, np.ndarray] = {}
        place = np.full(n, -1)
        for k, (own, later) in enumerate(self.fronts):
            both = np.concatenate((own, later))
            place[both] = np.arange(len(both))
            front = np.zeros((len(both), len(both)))
            count = begin[own + 1] - begin[own]
            at = np.repeat(begin[own] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
            some = at[self.step[matrix.col[at]] >= k]
            front[place[matrix.col[some]], place[matrix.row[some]]] = matrix.value[some]
            for c in children[k]:
                where = place[self.fronts[c][1]]
                front[np.ix_(where, where)] += updates.pop(c)
            m = len(own)
            lower = np.linalg.cholesky(front[:m, :m])
            below = np.linalg.solve(lower, front[m:, :m].T).T
            self.blocks.append((lower, below))
            if len(later):
                updates[k] = front[m:, m:] - below @ below.T

    def solve(self, b: np.ndarray) -> np.ndarray:
        """x with matrix x = b, for a vector or for columns."""
        y = np.array(b, dtype=float)
        for (own, later), (lower, below) in zip(self.fronts, self.blocks, strict=True):
            y[own] = np.linalg.solve(lower, y[own])
            y[later] -= below @ y[own]
        return self._back(y)

    def _back(self, y: np.ndarray) -> np.ndarray:
        for (own, later), (lower, below) in zip(reversed(self.fronts), reversed(self.blocks), strict=True):
            y[own] = np.linalg.solve(lower.T, y[own] - below.T @ y[later])
        return y

    def logdet(self) -> float:
        return 2 * float(sum(np.log(np.diag(lower)).sum() for lower, _ in self.blocks))

    def samples(self, count: int, seed: int, mean: np.ndarray | None = None) -> np.ndarray:
        """(size, count) draws with this precision."""
        s = self._back(np.random.default_rng(seed).normal(size=(self.size, count)))
        return s if mean is None else s + mean[:, None]

    def inverse_at(self, row, col) -> np.ndarray:
        """Entries of the inverse at places of the factor's pattern, without the rest of it."""
        row, col = np.asarray(row, np.int64), np.asarray(col, np.int64)
        first = np.minimum(self.step[row], self.step[col])
        order = np.argsort(first, kind="stable")
        bounds = np.searchsorted(first[order], np.arange(len(self.fronts) + 1))
        out = np.empty(len(row))
        place, held, parent = np.full(self.size, -1), {}, {c: k for k, cs in enumerate(self.children) for c in cs}
        left = [len(c) for c in self.children]
        for k in range(len(self.fronts) - 1, -1, -1):
            (own, later), (lower, below) = self.fronts[k], self.blocks[k]
            m = len(own)
            both = np.concatenate((own, later))
            z = np.empty((len(both), len(both)))
            inverse = np.linalg.inv(lower)
            z[:m, :m] = inverse.T @ inverse
            if len(later):
                up = parent[k]
                above, zp = held[up]
                place[above] = np.arange(len(above))
                where = place[later]
                z[m:, m:] = zp[np.ix_(where, where)]
                reach = below @ inverse  # how later unknowns weigh on own ones
                z[m:, :m] = -z[m:, m:] @ reach
                z[:m, m:] = z[m:, :m].T
                z[:m, :m] -= reach.T @ z[m:, :m]
                left[up] -= 1
                if not left[up]:
                    del held[up]
            if self.children[k]:
                held[k] = (both, z)
            mine = order[bounds[k] : bounds[k + 1]]
            if len(mine):
                place[both] = np.arange(len(both))
                out[mine] = z[place[row[mine]], place[col[mine]]]
        return out

    def deviations(self) -> np.ndarray:
        """Exact marginal standard deviations."""
        at = np.arange(self.size)
        return np.sqrt(self.inverse_at(at, at))

    def trace_with(self, other: Entries) -> float:
        """trace(inverse * other) for another matrix on the pattern of this one."""
        return float((self.inverse_at(other.row, other.col) * other.value).sum())

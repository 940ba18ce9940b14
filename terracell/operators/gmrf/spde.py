"""Prior precision matrices from stochastic partial differential equations, on spheres and lattices.

On a sphere, Q = T (K C K + G) C^-1 (K C K + G) T for smoothness 2: C is the lumped
mass and G the stiffness of linear elements, K and T hold kappa and tau at each
vertex, equal everywhere (stationary) or not. A view is a part of the mesh with
its own boundary: a coarse triangle, or one with its neighbours. Matrices are
sparse entries; ``assembled`` and ``precision_table`` give the same as tables, made
by joins and sums of the mesh's tables.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.operators.gmrf import coo
from terracell.operators.gmrf.mesh import Mesh
from terracell.operators.gmrf.sparse import Entries, SparseFactor

DENSE_MOST = 5000  # rows of a matrix that is returned dense


@dataclass(frozen=True)
class View:
    """Triangles of a mesh, and the vertices they have (sorted point numbers)."""

    mesh: Mesh
    active: np.ndarray

    @functools.cached_property
    def vertices(self) -> np.ndarray:
        return np.unique(self.mesh.triangles[self.active])

    @functools.cached_property
    def parts(self) -> tuple[np.ndarray, Entries]:
        """(lumped mass, stiffness) of linear elements over the view's vertices."""
        n = len(self.vertices)
        corner = np.searchsorted(self.vertices, self.mesh.triangles[self.active])
        p = self.mesh.points[self.mesh.triangles[self.active]]
        edges = np.stack([p[:, 2] - p[:, 1], p[:, 0] - p[:, 2], p[:, 1] - p[:, 0]], axis=1)  # opposite to each corner
        area = np.linalg.norm(np.cross(edges[:, 0], edges[:, 1]), axis=1) / 2
        mass = np.bincount(corner.reshape(-1), weights=np.repeat(area / 3, 3), minlength=n)
        value = np.einsum("tik,tjk->tij", edges, edges) / (4 * area[:, None, None])
        return mass, Entries.of(n, np.repeat(corner, 3, axis=1).reshape(-1), np.tile(corner, (1, 3)).reshape(-1), value.reshape(-1))


def whole(mesh: Mesh) -> View:
    return View(mesh, np.arange(len(mesh.triangles)))


def super_triangle(mesh: Mesh, level: int, index: int) -> View:
    """The triangles inside one triangle of a coarser level."""
    step = 4 ** (mesh.level - level)
    return View(mesh, np.arange(index * step, (index + 1) * step))


def neighbourhood(mesh: Mesh, level: int, index: int) -> View:
    """The triangles inside one triangle of a coarser level and those that touch it."""
    coarse = Mesh.build(level)
    near = np.flatnonzero(np.isin(coarse.triangles, coarse.triangles[index]).any(axis=1))
    step = 4 ** (mesh.level - level)
    return View(mesh, (near[:, None] * step + np.arange(step)).reshape(-1))


def precision(view: View, log_sigma, log_rho, alpha: int = 2) -> Entries:
    """The precision of a Matern field on a view; sigma and rho are numbers, or one for each vertex."""
    return _powers(view, log_sigma, log_rho, alpha)[0]


def precision_derivative(view: View, log_sigma, log_rho, d_sigma, d_rho, alpha: int = 2) -> Entries:
    """The precision's change as log sigma and log rho change along d_sigma and d_rho (numbers or vectors)."""
    return _powers(view, log_sigma, log_rho, alpha, d_sigma, d_rho)[1]


def _powers(view: View, log_sigma, log_rho, alpha: int, d_sigma=0.0, d_rho=0.0) -> tuple[Entries, Entries]:
    if alpha < 2:
        raise ValueError("smoothness is 2 or more on a sphere")
    mass, stiff = view.parts
    n, nu = len(mass), alpha - 1
    log_kappa = 0.5 * math.log(8 * nu) - np.broadcast_to(log_rho, n)
    kappa = np.exp(log_kappa)
    tau = np.exp(0.5 * math.log(math.gamma(nu) / (math.gamma(alpha) * 4 * math.pi)) - np.broadcast_to(log_sigma, n) - nu * log_kappa)
    dkappa, dtau = -np.broadcast_to(d_rho, n) * kappa, (nu * np.broadcast_to(d_rho, n) - np.broadcast_to(d_sigma, n)) * tau
    k = Entries.diagonal(kappa * mass * kappa) + stiff
    dk = Entries.diagonal(2 * kappa * mass * dkappa)
    step, q, dq = 1 / mass, k, dk
    if alpha % 2 == 0:
        q, dq = k @ k.scaled(step), dk @ k.scaled(step) + k @ dk.scaled(step)
    for _ in range(2 - alpha % 2, alpha, 2):
        inner, dinner = q.scaled(step, step), dq.scaled(step, step)
        q, dq = k @ inner @ k, dk @ inner @ k + k @ dinner @ k + k @ inner @ dk
    return q.scaled(tau, tau), q.scaled(dtau, tau) + dq.scaled(tau, tau) + q.scaled(tau, dtau)


def merged_parameters(size: int, views: list[tuple[View, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """(log sigma, log rho) at each vertex: the mean of sigma and of rho over the views that have it (NaN: none)."""
    mean = lambda k: np.log(region_average([(v[0].vertices, np.full(len(v[0].vertices), math.exp(v[k]))) for v in views], size))
    return mean(1), mean(2)


def assembled(points: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mass (row, value), stiffness (row, col, value)) as tables from mesh tables (point_id, x, y, z) and (triangle_id, a, b, c)."""
    rows = triangles
    for c in "abc":
        at = points.select(F.col("point_id").alias(c), F.array("x", "y", "z").alias(f"_{c}"))
        rows = rows.join(at, c)
    minus = lambda u, v: F.zip_with(u, v, lambda x, y: x - y)
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    edges = {"a": minus("_c", "_b"), "b": minus("_a", "_c"), "c": minus("_b", "_a")}
    rows = rows.select("a", "b", "c", *[e.alias(f"e{c}") for c, e in edges.items()])
    twice = F.sqrt(dot("ea", "ea") * dot("eb", "eb") - F.pow(dot("ea", "eb"), F.lit(2)))
    rows = rows.withColumn("area", twice / 2)
    mass = rows.select(F.explode(F.array("a", "b", "c")).alias("row"), "area").groupBy("row").agg((F.sum("area") / 3).alias("value"))
    entries = F.array(*[F.struct(F.col(i).alias("row"), F.col(j).alias("col"), (dot(f"e{i}", f"e{j}") / (4 * F.col("area"))).alias("value")) for i in "abc" for j in "abc"])
    return mass, rows.select(F.explode(entries).alias("e")).groupBy("e.row", "e.col").agg(F.sum("e.value").alias("value"))


def precision_table(points: DataFrame, triangles: DataFrame, log_sigma: float, log_rho: float) -> DataFrame:
    """(row, col, value) of the stationary precision of smoothness 2, never collected."""
    kappa, tau = scales(log_sigma, log_rho)
    mass, stiff = assembled(points, triangles)
    diagonal = mass.select("row", F.col("row").alias("col"), (kappa * kappa * F.col("value")).alias("value"))
    k = coo.add(diagonal, stiff)
    over = k.join(mass.select("row", F.col("value").alias("_m")), "row").select("row", "col", (F.col("value") / F.col("_m")).alias("value"))
    return coo.matmul(k, over).select("row", "col", (tau * tau * F.col("value")).alias("value"))


def mass_and_stiffness(mesh: Mesh) -> tuple[np.ndarray, np.ndarray]:
    """(lumped mass diagonal, dense stiffness matrix) of a small mesh."""
    mass, stiff = whole(mesh).parts
    return mass, _dense(stiff)


def _dense(q: Entries) -> np.ndarray:
    if q.size > DENSE_MOST:
        raise ValueError(f"{q.size} rows are too many for a dense matrix")
    return q.dense()


def scales(log_sigma: float, log_rho: float, alpha: int = 2) -> tuple[float, float]:
    """(kappa, tau) of a Matern field in two dimensions with this deviation and range."""
    nu = alpha - 1
    kappa = math.sqrt(8 * nu) / math.exp(log_rho)
    tau = math.sqrt(math.gamma(nu) / (math.gamma(alpha) * 4 * math.pi)) / (math.exp(log_sigma) * kappa**nu)
    return kappa, tau


def sphere_precision(mesh: Mesh, log_sigma: float, log_rho: float) -> np.ndarray:
    """The stationary precision of a small mesh as a dense matrix."""
    return _dense(precision(whole(mesh), log_sigma, log_rho))


def _lattice(nodes: int, log_rho: float, alpha: int, wrap: bool) -> tuple[Entries, Entries]:
    """(neighbour Laplacian plus a diagonal to the power alpha, its change with log rho)."""
    if alpha not in (1, 2):
        raise ValueError("alpha is 1 or 2")
    square, at = math.exp(-2 * log_rho), np.arange(nodes - 1)
    m = Entries.diagonal(np.full(nodes, 2 + square)) + Entries.of(nodes, np.append(at, at + 1), np.append(at + 1, at), np.full(2 * nodes - 2, -1.0))
    if wrap and nodes > 2:
        m = m + Entries.of(nodes, [0, nodes - 1], [nodes - 1, 0], [-1.0, -1.0])
    d = Entries.diagonal(np.full(nodes, -2 * square))
    return (m, d) if alpha == 1 else (m @ m, m.scaled(-4 * square))


def lattice_entries(nodes: int, log_sigma: float, log_rho: float, alpha: int = 2, wrap: bool = False) -> Entries:
    """Neighbour Laplacian plus a diagonal, to the power alpha (1 or 2), scaled to the deviation at the middle node."""
    return lattice_derivatives(nodes, log_sigma, log_rho, alpha, wrap)[0]


def lattice_derivatives(nodes: int, log_sigma: float, log_rho: float, alpha: int = 2, wrap: bool = False) -> tuple[Entries, Entries, Entries]:
    """(precision, its change with log sigma, its change with log rho)."""
    q, dq = _lattice(nodes, log_rho, alpha, wrap)
    middle = np.zeros(nodes)
    middle[nodes // 2] = 1
    column = SparseFactor(q).solve(middle)  # of the inverse
    centre, change = column[nodes // 2], -column @ (dq @ column)
    scale = math.exp(-2 * log_sigma)
    out = q.scaled(centre * scale)
    return out, out.scaled(-2.0), dq.scaled(centre * scale) + q.scaled(change * scale)


def lattice_precision(nodes: int, log_sigma: float, log_rho: float, alpha: int = 2, wrap: bool = False) -> np.ndarray:
    """The lattice precision of few nodes as a dense matrix."""
    return _dense(lattice_entries(nodes, log_sigma, log_rho, alpha, wrap))


def covariate_precision(log_amplitudes: list[float]) -> np.ndarray:
    """Diagonal of exp(-2 h)."""
    return np.diag(np.exp(-2 * np.asarray(log_amplitudes, dtype=float)))


def derivative(build: Callable, theta: np.ndarray, k: int, step: float = 1e-5) -> np.ndarray:
    """dQ/d(theta_k) of a precision builder by central differences."""
    e = np.zeros_like(theta)
    e[k] = step
    return (build(theta + e) - build(theta - e)) / (2 * step)


def region_average(values: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """Per vertex the mean of overlapping regions' estimates, given (vertices, values) of each; NaN where none."""
    total, count = np.zeros(size), np.zeros(size)
    for at, v in values:
        np.add.at(total, at, v)
        np.add.at(count, at, 1)
    return np.divide(total, count, out=np.full(size, np.nan), where=count > 0)

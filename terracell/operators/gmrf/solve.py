"""Solving, sampling and optimising Gaussian models.

A system whose factor fits one machine is collected (its size is the model's, not
the data's) and solved by the sparse factor of ``sparse``: solutions, deviations,
samples and traces. Larger systems are solved where they are by preconditioned
conjugate gradients, a sparse product per step; state vectors of a few doubles per
parameter are the only thing iterated. Many small systems (regions, times) are
solved each in its own group.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.operators.gmrf import spde
from terracell.operators.gmrf.mesh import Mesh
from terracell.operators.gmrf.sparse import Entries, SparseFactor

DENSE_MOST = 5000  # parameters of a dense matrix; larger systems are ``Entries``


def dense(matrix: DataFrame, size: int) -> np.ndarray:
    if size > DENSE_MOST:
        raise ValueError(f"{size} parameters are too many for a dense solve")
    rows = matrix.toPandas()
    out = np.zeros((size, size))
    np.add.at(out, (rows.iloc[:, 0].to_numpy(dtype=int), rows.iloc[:, 1].to_numpy(dtype=int)), rows["value"].to_numpy())
    return out


def dense_vector(vector: DataFrame, size: int) -> np.ndarray:
    rows = vector.toPandas()
    out = np.zeros(size)
    np.add.at(out, rows.iloc[:, 0].to_numpy(dtype=int), rows["value"].to_numpy())
    return out


@dataclass
class Factor:
    """Cholesky factor of a posterior precision and what follows from it."""

    lower: np.ndarray

    @classmethod
    def of(cls, q: np.ndarray) -> Factor:
        return cls(np.linalg.cholesky(q))

    def solve(self, b: np.ndarray) -> np.ndarray:
        return np.linalg.solve(self.lower.T, np.linalg.solve(self.lower, b))

    def logdet(self) -> float:
        return 2 * float(np.log(np.diag(self.lower)).sum())

    def samples(self, count: int, seed: int, mean: np.ndarray | None = None) -> np.ndarray:
        """(size, count) draws with this precision."""
        e = np.random.default_rng(seed).normal(size=(len(self.lower), count))
        s = np.linalg.solve(self.lower.T, e)
        return s if mean is None else s + mean[:, None]

    def deviations(self, block: int = 512) -> np.ndarray:
        """Exact marginal standard deviations, a block of columns at a time."""
        n = len(self.lower)
        out = np.empty(n)
        for lo in range(0, n, block):
            e = np.zeros((n, min(block, n - lo)))
            e[np.arange(lo, lo + e.shape[1]), np.arange(e.shape[1])] = 1
            out[lo : lo + e.shape[1]] = np.sqrt((np.linalg.solve(self.lower, e) ** 2).sum(axis=0))
        return out

    def sampled_deviations(self, seed: int, count: int = 100) -> np.ndarray:
        return self.samples(count, seed).std(axis=1)


def partial_inverse(q: np.ndarray) -> np.ndarray:
    """Entries of the inverse on the pattern of the Cholesky factor, by the Takahashi recursion (0 elsewhere)."""
    lower = np.linalg.cholesky(q)
    n = len(q)
    unit, d = lower / np.diag(lower), np.diag(lower) ** 2
    pattern = np.abs(lower) > 1e-14
    z = np.zeros_like(q)
    for j in range(n - 1, -1, -1):
        below = np.flatnonzero(pattern[j + 1 :, j]) + j + 1
        for i in below[::-1]:
            z[i, j] = z[j, i] = -(unit[below, j] * z[below, i]).sum()
        z[j, j] = 1 / d[j] - (unit[below, j] * z[below, j]).sum()
    return z


def trace_of_inverse_product(q: np.ndarray, dq: np.ndarray) -> float:
    """trace(Q^-1 dQ) from the partial inverse; dq's pattern must fit into the factor's."""
    return float((partial_inverse(q) * dq).sum())


def map_solution(posterior: DataFrame, information: DataFrame, size: int) -> np.ndarray:
    return SparseFactor(Entries.collected(posterior, size)).solve(dense_vector(information, size))


def conjugate_gradients(matrix: DataFrame, b: DataFrame, tolerance: float = 1e-6, most: int | None = None) -> DataFrame:
    """(col, value) solving matrix x = b with a Jacobi preconditioner.

    ``matrix`` should be written or cached by the caller. Each step is one sparse
    product and two sums; state is cut to disk every step through a checkpoint.
    Rounding may cost more steps than the system has unknowns; ``most`` is ten times
    as many by default, 200 at least. A solve that has not reached the tolerance by
    then raises ArithmeticError.
    """
    diag = matrix.where("row = col").select(F.col("row").alias("k"), (1 / F.col("value")).alias("m"))
    s = b.select(F.col(b.columns[0]).alias("k"), F.col("value").alias("r"))
    s = diag.join(s, "k", "left").select("k", "m", F.lit(0.0).alias("x"), F.coalesce("r", F.lit(0.0)).alias("r"))
    s = s.withColumn("p", F.col("m") * F.col("r"))
    scale = s.agg(F.sum(F.col("r") * F.col("r")), F.sum(F.col("r") * F.col("m") * F.col("r")), F.count(F.lit(1))).first()
    norm, rz = scale[0] or 0.0, scale[1] or 0.0
    start, limit = norm, tolerance * tolerance * norm
    for _ in range(max(200, 10 * scale[2]) if most is None else most):
        if norm <= limit or rz == 0 or not np.isfinite(norm):
            break
        ap = matrix.join(s.select(F.col("k").alias("col"), "p"), "col").groupBy(F.col("row").alias("k")).agg(F.sum(F.col("value") * F.col("p")).alias("ap"))
        t = _keep(s.join(ap, "k", "left").withColumn("ap", F.coalesce("ap", F.lit(0.0))))
        curve = t.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        if not curve > 0:
            raise ArithmeticError("conjugate gradients: the matrix is not positive definite")
        alpha = rz / curve
        t = t.select("k", "m", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("ap")).alias("r"), "p")
        norm, new = t.agg(F.sum(F.col("r") * F.col("r")), F.sum(F.col("r") * F.col("m") * F.col("r"))).first()
        s = t.withColumn("p", F.col("m") * F.col("r") + (new / rz) * F.col("p"))
        rz = new
    if not norm <= limit:
        raise ArithmeticError(f"conjugate gradients: residual {(norm / start) ** 0.5:.3g} of the right side, {tolerance:.3g} wanted")
    return s.select(F.col("k").alias("col"), F.col("x").alias("value"))


def _keep(df: DataFrame) -> DataFrame:
    """Cut the lineage in the checkpoint folder of the session, if it has one."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master != "local" and not sc.master.startswith("local["):  # local-cluster has executors of its own
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = "file://" + tempfile.mkdtemp(prefix="terracell-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def fit_components(designs: list[np.ndarray], priors: list[np.ndarray], precision: np.ndarray, y: np.ndarray, sweeps: int = 20) -> list[np.ndarray]:
    """Block coordinate descent: each component is solved on what the others leave."""
    states = [np.zeros(d.shape[1]) for d in designs]
    for _ in range(sweeps):
        for c, (j, q) in enumerate(zip(designs, priors, strict=True)):
            rest = y - sum((designs[k] @ states[k] for k in range(len(designs)) if k != c), np.zeros(len(y)))
            states[c] = np.linalg.solve(q + j.T @ (precision[:, None] * j), j.T @ (precision * rest))
    return states


def negative_log_likelihood(theta: np.ndarray, prior, design: np.ndarray, precision: np.ndarray, y: np.ndarray) -> float:
    """Marginal likelihood cost of hyperparameters; ``prior(theta)`` gives the prior precision."""
    q = prior(theta)
    posterior = q + design.T @ (precision[:, None] * design)
    b = design.T @ (precision * y)
    f = Factor.of(posterior)
    fit = float((precision * y * y).sum() - b @ f.solve(b))
    return 0.5 * (fit + f.logdet() - Factor.of(q).logdet() - float(np.log(precision).sum()))


def marginal_likelihood(theta: np.ndarray, prior: Callable, information: Entries, vector: np.ndarray, moment: float = 0.0, logdet: float = 0.0) -> tuple[float, np.ndarray]:
    """(cost, gradient) of hyperparameters, from a model's sums: J'WJ, J'Wy, y'Wy and log|W|.

    ``prior(theta)`` gives the prior precision and its derivatives. Traces come from
    the factors' entries of the inverse, so no dense matrix is made.
    """
    q, changes = prior(theta)
    one, both = SparseFactor(q), SparseFactor(q + information)
    x = both.solve(vector)
    cost = 0.5 * (moment - float(vector @ x) + both.logdet() - one.logdet() - logdet)
    return cost, np.array([0.5 * (both.trace_with(d) - one.trace_with(d) + float(x @ (d @ x))) for d in changes])


def minimise(cost: Callable, start: np.ndarray, most: int = 20, step: float = 1e-4, gradient: Callable | None = None) -> tuple[np.ndarray, float]:
    """BFGS with a halving line search; steps are at most 1 long. Without ``gradient``, central differences."""
    x = np.asarray(start, dtype=float)
    given = cost

    def cost(at):  # where the prior is not positive definite, the cost is infinite
        try:
            return given(at)
        except np.linalg.LinAlgError:
            return np.inf

    if gradient is None:

        def gradient(at):
            return np.array([(cost(at + step * e) - cost(at - step * e)) / (2 * step) for e in np.eye(len(at))])

    h, value, g = np.eye(len(x)), cost(x), gradient(x)
    for _ in range(most):
        if np.linalg.norm(g) < 1e-5:
            break
        d, t = -h @ g, 1.0
        d /= max(1.0, float(np.linalg.norm(d)))
        while t > 1e-6 and cost(x + t * d) > value + 1e-4 * t * (g @ d):
            t /= 2
        if t <= 1e-6:
            break
        new = x + t * d
        g2 = gradient(new)
        s, u = new - x, g2 - g
        if s @ u > 1e-12:
            i = np.eye(len(x)) - np.outer(s, u) / (s @ u)
            h = i @ h @ i.T + np.outer(s, s) / (s @ u)
        x, value, g = new, cost(new), g2
    return x, float(value)


@functools.lru_cache(maxsize=2)
def _mesh(level: int) -> Mesh:
    """A worker keeps the meshes it has made."""
    return Mesh.build(level)


def region_view(level: int, region_level: int, region: int, neighbours: bool = False) -> spde.View:
    """The view of a coarse triangle, by its id (see ``mesh.parent``)."""
    index = int(np.searchsorted(_mesh(region_level).ids, region))
    return (spde.neighbourhood if neighbours else spde.super_triangle)(_mesh(level), region_level, index)


def solve_regions(designs: DataFrame, observations: DataFrame, prior: float | Callable) -> DataFrame:
    """(region, col, value): each region's own posterior mean, solved where its rows are.

    designs: (region, row, col, value); observations: (row, q, r). ``prior`` is a
    number (times the identity over the columns that occur), or gives for a region
    its columns and their prior precision. A region's system is bounded by the mesh
    levels, not by the data: only sums per vertex pair enter the group.
    """
    import pandas as pd

    rows = designs.groupBy("region", "row").agg(F.collect_list(F.struct("col", "value")).alias("e")).join(observations, "row")
    one = rows.select("region", "q", "r", F.explode("e").alias("a"), "e")
    vector = one.groupBy("region", F.col("a.col").alias("i")).agg(F.sum(F.col("a.value") * F.col("q") * F.col("r")).alias("value")).withColumn("j", F.lit(-1).cast("bigint"))
    matrix = one.select("region", "q", "a", F.explode("e").alias("b")).groupBy("region", F.col("a.col").alias("i"), F.col("b.col").alias("j")).agg(F.sum(F.col("a.value") * F.col("q") * F.col("b.value")).alias("value"))

    def one_region(frame: pd.DataFrame) -> pd.DataFrame:
        region = int(frame["region"].iloc[0])
        if callable(prior):
            names, q = prior(region)
        else:
            names = np.unique(frame["i"])
            q = Entries.diagonal(np.full(len(names), float(prior)))
        i, j, v = (frame[c].to_numpy() for c in ("i", "j", "value"))
        right = j < 0
        at = np.searchsorted(names, i)
        b = np.bincount(at[right], weights=v[right], minlength=len(names))
        q = q + Entries.of(len(names), at[~right], np.searchsorted(names, j[~right]), v[~right])
        return pd.DataFrame({"region": region, "col": names, "value": SparseFactor(q).solve(b)})

    both = matrix.unionByName(vector.select("region", "i", "j", "value"))
    return both.groupBy("region").applyInPandas(one_region, "region bigint, col bigint, value double")


def matern_regions(level: int, region_level: int, log_sigma: float, log_rho: float) -> Callable:
    """A prior for ``solve_regions``: a Matern field on each coarse triangle's own view."""

    def prior(region: int) -> tuple[np.ndarray, Entries]:
        view = region_view(level, region_level, region)
        return view.vertices, spde.precision(view, log_sigma, log_rho)

    return prior

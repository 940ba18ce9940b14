"""A spatial field that is a new draw at each time, observed first and solved later.

The observations of each time become sums once (``updates``), which are written and
used again for every set of hyperparameters; then every time's own system is
solved in its own group (``solve_each``), and the likelihood of hyperparameters is a
sum over the times (``fit``). A time's sums are bounded by the mesh, whatever the
number of its observations.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.operators.gmrf.solve import marginal_likelihood, minimise
from terracell.operators.gmrf.sparse import Entries, SparseFactor


def updates(design: DataFrame, observations: DataFrame) -> DataFrame:
    """(time, i, j, value): J'WJ per pair of columns; j = -1: J'Wy; i = j = -1: y'Wy; i = -1, j = -2: log|W|.

    design: (row, col, value); observations: (row, time, q, r).
    """
    rows = design.groupBy("row").agg(F.collect_list(F.struct("col", "value")).alias("e")).join(observations, "row")
    one = rows.select("time", "q", "r", F.explode("e").alias("a"), "e")
    key = lambda c: F.col(c).cast("bigint")
    matrix = one.select("time", "q", "a", F.explode("e").alias("b")).groupBy("time", key("a.col").alias("i"), key("b.col").alias("j")).agg(F.sum(F.col("a.value") * F.col("q") * F.col("b.value")).alias("value"))
    minus = F.lit(-1).cast("bigint")
    vector = one.groupBy("time", key("a.col").alias("i")).agg(F.sum(F.col("a.value") * F.col("q") * F.col("r")).alias("value")).select("time", "i", minus.alias("j"), "value")
    both = F.array(F.struct(minus.alias("j"), (F.col("q") * F.col("r") * F.col("r")).alias("v")), F.struct((minus - 1).alias("j"), F.log("q").alias("v")))
    moments = observations.select("time", F.explode(both).alias("e")).groupBy("time", F.col("e.j").alias("j")).agg(F.sum("e.v").alias("value")).select("time", minus.alias("i"), "j", "value")
    return matrix.unionByName(vector).unionByName(moments)


def _system(frame: pd.DataFrame, size: int) -> tuple[Entries, np.ndarray, float, float]:
    i, j, v = (frame[c].to_numpy() for c in ("i", "j", "value"))
    pair, right = (i >= 0) & (j >= 0), (i >= 0) & (j < 0)
    number = lambda k: float(v[(i < 0) & (j == k)].sum())
    return Entries.of(size, i[pair], j[pair], v[pair]), np.bincount(i[right], weights=v[right], minlength=size), number(-1), number(-2)


def solve_each(sums: DataFrame, prior: Entries, samples: int = 0, seed: int = 0) -> DataFrame:
    """(time, col, value, std, samples): each time's posterior mean, its deviation and draws."""
    shared = sums.sparkSession.sparkContext.broadcast(prior)  # a few doubles per vertex and neighbour

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        q = shared.value
        matrix, vector, _, _ = _system(frame, q.size)
        factor = SparseFactor(q + matrix)
        time, mean = int(frame["time"].iloc[0]), factor.solve(vector)
        draws = factor.samples(samples, seed + time, mean) if samples else np.zeros((q.size, 0))
        return pd.DataFrame({"time": time, "col": np.arange(q.size), "value": mean, "std": factor.deviations(), "samples": list(draws)})

    return sums.groupBy("time").applyInPandas(one, "time bigint, col bigint, value double, std double, samples array<double>")


def cost(sums: DataFrame, prior: Callable, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """(cost, gradient) of hyperparameters over all times: one pass over the sums."""
    at = np.asarray(theta, float)
    shared = sums.sparkSession.sparkContext.broadcast(prior(at))  # a few doubles per vertex and neighbour
    names = [f"g{k}" for k in range(len(theta))]

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        q, changes = shared.value
        matrix, vector, moment, logdet = _system(frame, q.size)
        value, gradient = marginal_likelihood(at, lambda _: (q, changes), matrix, vector, moment, logdet)
        return pd.DataFrame([[value, *gradient]], columns=["cost", *names])

    each = sums.groupBy("time").applyInPandas(one, ", ".join(f"{n} double" for n in ["cost", *names]))
    row = each.agg(*[F.sum(n).alias(n) for n in ["cost", *names]]).first()
    return float(row["cost"]), np.array([row[n] for n in names])


def fit(sums: DataFrame, prior: Callable, start: np.ndarray, most: int = 20) -> tuple[np.ndarray, float]:
    """Hyperparameters of least cost. ``prior(theta)`` gives the precision and its derivatives."""
    known: dict[bytes, tuple[float, np.ndarray]] = {}

    def at(theta):
        key = np.asarray(theta, float).tobytes()
        if key not in known:
            known[key] = cost(sums, prior, theta)
        return known[key]

    return minimise(lambda t: at(t)[0], start, most, gradient=lambda t: at(t)[1])


def predicted(design: DataFrame, observations: DataFrame, states: DataFrame, column: str = "value") -> DataFrame:
    """(row, value) of a design at the state of each observation's time; 0 where that time has none.

    With the column ``std`` entries add in absolute value, a bound that no sign change hides.
    """
    entry = F.abs(F.col("_v") * F.col("_s")) if column == "std" else F.col("_v") * F.col("_s")
    rows = design.select("row", "col", F.col("value").alias("_v")).join(observations.select("row", "time"), "row")
    met = rows.join(states.select("time", "col", F.col(column).alias("_s")), ["time", "col"], "left")
    return met.groupBy("row").agg(F.coalesce(F.sum(entry), F.lit(0.0)).alias("value"))

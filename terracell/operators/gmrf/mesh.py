"""Icosahedral meshes and point location.

A mesh of level L has 20 * 4**L triangles and is made once on the driver with
numpy (level 7: 327,680 triangles). Points are located on the executors: a
triangle's four children are tried level by level, vectorised over an Arrow
batch, so no join with triangles is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_SHIFT = 58  # a triangle's id: base face in the top bits, then two bits a level
_EDGE = 1e-12


def _icosahedron() -> tuple[np.ndarray, np.ndarray]:
    """Vertices and outward faces, from the golden ratio's rectangles."""
    g = (1 + 5**0.5) / 2
    v = np.array([p for s in (-1, 1) for t in (-g, g) for p in ((0, s, t), (s, t, 0), (t, 0, s))], dtype=float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = np.isclose(v @ v.T, 1 / 5**0.5)
    faces = []
    for a in range(12):
        for b in range(a + 1, 12):
            for c in range(b + 1, 12):
                if near[a, b] and near[b, c] and near[a, c]:
                    faces.append((a, b, c) if np.dot(np.cross(v[b] - v[a], v[c] - v[a]), v[a]) > 0 else (a, c, b))
    return v, np.array(faces)


@dataclass(frozen=True)
class Mesh:
    """points (n, 3), triangles (m, 3) of point numbers, ids (m,) of triangles."""

    level: int
    points: np.ndarray
    triangles: np.ndarray
    ids: np.ndarray

    @classmethod
    def build(cls, level: int) -> Mesh:
        points, triangles = _icosahedron()
        ids = np.arange(20, dtype=np.int64) << BASE_SHIFT
        for depth in range(level):
            edges = np.sort(np.concatenate([triangles[:, [1, 2]], triangles[:, [2, 0]], triangles[:, [0, 1]]]), axis=1)
            unique, inverse = np.unique(edges, axis=0, return_inverse=True)
            middle = points[unique[:, 0]] + points[unique[:, 1]]
            middle /= np.linalg.norm(middle, axis=1, keepdims=True)
            m = (inverse.reshape(-1) + len(points)).reshape(3, -1)  # opposite to corners 0, 1, 2
            points = np.concatenate([points, middle])
            a, b, c = triangles.T
            children = np.stack([np.stack(t, axis=1) for t in ((m[0], m[1], m[2]), (a, m[2], m[1]), (m[2], b, m[0]), (m[1], m[0], c))], axis=1)
            triangles = children.reshape(-1, 3)
            ids = (ids[:, None] | (np.arange(4, dtype=np.int64) << (BASE_SHIFT - 2 * (depth + 1)))).reshape(-1)
        return cls(level, points, triangles, ids)

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Tables mesh_point(point_id, x, y, z) and mesh_triangle(triangle_id, a, b, c)."""
        p = pa.table({"point_id": np.arange(len(self.points)), "x": self.points[:, 0], "y": self.points[:, 1], "z": self.points[:, 2]})
        t = pa.table({"triangle_id": self.ids, **{n: self.triangles[:, k].astype(np.int64) for k, n in enumerate("abc")}})
        return spark.createDataFrame(p), spark.createDataFrame(t)


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=1)


def weights(p: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """Barycentric weights (n, 3) of rays p in triangles (n, 3 corners, 3)."""
    a, b, c = corners[:, 0], corners[:, 1], corners[:, 2]
    w = np.stack([np.einsum("ij,ij->i", p, np.cross(x, y)) for x, y in ((b, c), (c, a), (a, b))], axis=1)
    return w / w.sum(axis=1, keepdims=True)


def locate_arrays(mesh: Mesh, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the finest triangle, weights) for each unit vector."""
    base, faces = _icosahedron()
    best = np.full(len(p), -1)
    score = np.full(len(p), -np.inf)
    for f in range(20):  # first face whose three planes all have the point inside; rounding aside, the largest smallest weight
        corners = base[faces[f]]
        sides = np.stack([p @ np.cross(corners[(k + 1) % 3], corners[(k + 2) % 3]) for k in range(3)], axis=1)
        low = sides.min(axis=1)
        better = low > score + _EDGE
        best[better], score[better] = f, low[better]
    row = best
    for depth in range(1, mesh.level + 1):
        step = 4 ** (mesh.level - depth)
        children = row[:, None] * 4 + np.arange(4)
        low = np.stack([_smallest(p, _corners(mesh, children[:, k], step)) for k in range(4)], axis=1)
        row = children[np.arange(len(p)), low.round(12).argmax(axis=1)]  # on an edge, the first child
    return row, weights(p, mesh.points[mesh.triangles[row]])


def _corners(mesh: Mesh, triangle: np.ndarray, step: int) -> np.ndarray:
    """Corners of coarser triangles: a triangle's outer descendants 1, 2, 3 keep its corners."""
    if step == 1:
        return mesh.points[mesh.triangles[triangle]]
    out = np.empty((len(triangle), 3, 3))
    for k in range(3):
        at, s = triangle * step, step
        while s > 1:
            s //= 4
            at = at + (k + 1) * s
        out[:, k] = mesh.points[mesh.triangles[at, k]]
    return out


def _smallest(p: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """Smallest of the three plane distances, positive inside."""
    out = None
    for k in range(3):
        n = np.cross(corners[:, (k + 1) % 3], corners[:, (k + 2) % 3])
        n /= np.linalg.norm(n, axis=1, keepdims=True)
        d = np.einsum("ij,ij->i", p, n)
        out = d if out is None else np.minimum(out, d)
    return out


def locate(df: DataFrame, level: int, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df with triangle_id, vertices (three point numbers) and their weights.

    The mesh is rebuilt once per task from its level: cheaper than a broadcast up
    to level 7, and nothing large travels.
    """
    names = df.columns

    def run(batches):
        mesh = Mesh.build(level)
        for batch in batches:
            p = unit_vectors(batch.column(names.index(lat)).to_numpy(zero_copy_only=False), batch.column(names.index(lon)).to_numpy(zero_copy_only=False))
            row, w = locate_arrays(mesh, p) if len(p) else (np.zeros(0, np.int64), np.zeros((0, 3)))
            ends = pa.array(np.arange(0, 3 * len(p) + 1, 3, dtype=np.int32))
            vertices = pa.ListArray.from_arrays(ends, pa.array(mesh.triangles[row].reshape(-1).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mesh.ids[row]), vertices, pa.ListArray.from_arrays(ends, pa.array(w.reshape(-1)))], names=[*names, "triangle_id", "vertices", "weights"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{ddl}, triangle_id bigint, vertices array<bigint>, weights array<double>")


def exhaustive(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df with the first of the twenty base faces that holds the point, by plane tests on columns."""
    base, faces = _icosahedron()
    a, b = F.radians(F.col(lat)), F.radians(F.col(lon))
    x, y, z = F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)
    out = F.lit(None).cast("int")
    for f in reversed(range(20)):
        c = base[faces[f]]
        inside = F.lit(True)
        for k in range(3):
            n = np.cross(c[(k + 1) % 3], c[(k + 2) % 3])
            inside = inside & (x * float(n[0]) + y * float(n[1]) + z * float(n[2]) >= -_EDGE)
        out = F.when(inside, F.lit(f)).otherwise(out)
    return df.withColumn("face", out)


def write(mesh: Mesh, spark: SparkSession, path: str) -> None:
    """The mesh's tables as Parquet: points and triangles."""
    for name, frame in zip(("point", "triangle"), mesh.frames(spark), strict=True):
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str) -> Mesh:
    """A mesh from its tables."""
    points = spark.read.parquet(f"{path}/point").orderBy("point_id").toPandas()
    triangles = spark.read.parquet(f"{path}/triangle").orderBy("triangle_id").toPandas()
    level = round(np.log2(len(triangles) / 20) / 2)
    return Mesh(level, points[["x", "y", "z"]].to_numpy(), triangles[["a", "b", "c"]].to_numpy(), triangles["triangle_id"].to_numpy())


def within(df: DataFrame, active: DataFrame) -> DataFrame:
    """Rows located in active triangles (of any one level)."""
    return df.join(active.select("triangle_id").distinct(), "triangle_id", "left_semi")


def parent(triangle_id, level: int):
    """Column: id of the ancestor at a coarser level."""
    return F.shiftleft(F.shiftright(triangle_id, BASE_SHIFT - 2 * level), BASE_SHIFT - 2 * level)

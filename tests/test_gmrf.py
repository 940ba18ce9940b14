"""Meshes, sparse algebra and solvers by identities and against dense numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.operators.gmrf import coo, elements, mesh, solve, spde


@pytest.mark.parametrize(("level", "points"), [(0, 12), (1, 42), (2, 162), (3, 642)])
def test_mesh_sizes(level, points):
    m = mesh.Mesh.build(level)
    assert len(m.points) == points and len(m.triangles) == 20 * 4**level and len(set(m.ids.tolist())) == len(m.ids)
    assert np.allclose(np.linalg.norm(m.points, axis=1), 1) and m.ids.min() >= 0


def test_location_gives_the_triangle_that_holds_the_point(spark):
    g = np.random.default_rng(1)
    lat, lon = np.degrees(np.arcsin(g.uniform(-1, 1, 200))), g.uniform(-180, 180, 200)
    m = mesh.Mesh.build(3)
    p = mesh.unit_vectors(lat, lon)
    row, w = mesh.locate_arrays(m, p)
    assert np.allclose(w.sum(axis=1), 1) and w.min() > -1e-9
    back = np.einsum("ij,ijk->ik", w, m.points[m.triangles[row]])
    back /= np.linalg.norm(back, axis=1, keepdims=True)
    assert np.allclose(back, p, atol=1e-9)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon, strict=True))], "row int, lat double, lon double")
    got = mesh.locate(df, 3).orderBy("row").collect()
    assert [r.triangle_id for r in got] == m.ids[row].tolist()
    coarse = mesh.locate(df, 1).orderBy("row").select("triangle_id").collect()
    up = mesh.locate(df, 3).orderBy("row").select(mesh.parent(F.col("triangle_id"), 1).alias("t")).collect()
    assert [r[0] for r in coarse] == [r[0] for r in up]


def test_base_faces_agree(spark):
    g = np.random.default_rng(2)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(g.uniform(-89, 89, 100), g.uniform(-180, 180, 100), strict=True))], "row int, lat double, lon double")
    one = [r.face for r in mesh.exhaustive(df).orderBy("row").collect()]
    two = [r.triangle_id >> mesh.BASE_SHIFT for r in mesh.locate(df, 0).orderBy("row").collect()]
    assert one == two


def frame(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "row bigint, col bigint, value double")


def test_sparse_algebra_equals_dense(spark):
    g = np.random.default_rng(3)
    a, b = g.normal(size=(7, 5)) * (g.random((7, 5)) < 0.6), g.normal(size=(5, 4))
    got = solve.dense(coo.matmul(frame(spark, a), frame(spark, b)), 10)[:7, :4]
    assert np.allclose(got, a @ b)
    q, r = g.uniform(1, 2, 7), g.normal(size=7)
    precision = spark.createDataFrame([(i, float(x)) for i, x in enumerate(q)], "row bigint, q double")
    residual = spark.createDataFrame([(i, float(x)) for i, x in enumerate(r)], "row bigint, r double")
    assert np.allclose(solve.dense(coo.information_matrix(frame(spark, a), precision), 5), a.T @ (q[:, None] * a))
    assert np.allclose(solve.dense_vector(coo.information_vector(frame(spark, a), precision, residual), 5), a.T @ (q * r))
    assert coo.same_pattern(frame(spark, a), frame(spark, np.ones((7, 5)))).count() == 0
    two = solve.dense(coo.block_diagonal([(frame(spark, b.T @ b), 4), (frame(spark, np.eye(2)), 2)]), 6)
    assert np.allclose(two[:4, :4], b.T @ b) and np.allclose(two[4:, 4:], np.eye(2)) and not two[:4, 4:].any()


def test_conjugate_gradients_equal_cholesky(spark):
    g = np.random.default_rng(4)
    m = g.normal(size=(12, 12))
    q, b = m @ m.T + 12 * np.eye(12), g.normal(size=12)
    rhs = spark.createDataFrame([(i, float(x)) for i, x in enumerate(b)], "col bigint, value double")
    x = solve.dense_vector(solve.conjugate_gradients(frame(spark, q).cache(), rhs, 1e-10), 12)
    assert np.allclose(x, solve.Factor.of(q).solve(b), atol=1e-6)


def test_conjugate_gradients_raise_when_not_converged(spark):
    n = 12
    hilbert = [(i, j, 1.0 / (i + j + 1)) for i in range(n) for j in range(n)]
    matrix = spark.createDataFrame(hilbert, "row bigint, col bigint, value double").cache()
    rhs = spark.createDataFrame([(i, float(i % 3)) for i in range(n)], "col bigint, value double")
    with pytest.raises(ArithmeticError, match="residual"):
        solve.conjugate_gradients(matrix, rhs, 1e-10, most=3)


def test_factor_identities():
    g = np.random.default_rng(5)
    m = g.normal(size=(20, 20))
    q = m @ m.T + 20 * np.eye(20)
    f = solve.Factor.of(q)
    assert np.allclose(f.deviations(7), np.sqrt(np.diag(np.linalg.inv(q))))
    assert f.logdet() == pytest.approx(np.linalg.slogdet(q)[1])
    assert np.allclose(f.samples(40000, 1).std(axis=1), f.deviations(), rtol=0.05)
    band = np.where(np.abs(np.subtract.outer(range(20), range(20))) <= 2, q, 0) + 40 * np.eye(20)
    z, inverse = solve.partial_inverse(band), np.linalg.inv(band)
    assert np.allclose(z[np.abs(band) > 0], inverse[np.abs(band) > 0])
    d = np.where(np.abs(np.subtract.outer(range(20), range(20))) <= 1, 1.0, 0)
    assert solve.trace_of_inverse_product(band, d) == pytest.approx(np.trace(inverse @ d))


def test_precisions_are_positive_and_scaled():
    q = spde.sphere_precision(mesh.Mesh.build(2), 0.0, np.log(0.6))
    assert np.allclose(q, q.T) and np.linalg.eigvalsh(q).min() > 0
    assert 0.5 < np.sqrt(np.diag(np.linalg.inv(q))).mean() < 1.6
    for wrap in (False, True):
        for alpha in (1, 2):
            p = spde.lattice_precision(15, np.log(2.0), np.log(3.0), alpha, wrap)
            assert np.linalg.eigvalsh(p).min() > 0 and np.linalg.inv(p)[7, 7] == pytest.approx(4.0)
    mass, stiff = spde.mass_and_stiffness(mesh.Mesh.build(2))
    assert np.allclose(stiff.sum(axis=1), 0) and 11 < mass.sum() < 4 * np.pi


def test_fit_recovers_a_simulated_field():
    g = np.random.default_rng(6)
    x, y = g.normal(size=(200, 3)), g.normal(size=(200, 2))
    truth = np.array([1.0, -2.0, 0.5]), np.array([3.0, 0.25])
    obs = x @ truth[0] + y @ truth[1] + g.normal(size=200) * 0.01
    got = solve.fit_components([x, y], [np.eye(3) * 1e-6, np.eye(2) * 1e-6], np.full(200, 1e4), obs)
    assert np.allclose(got[0], truth[0], atol=0.01) and np.allclose(got[1], truth[1], atol=0.01)


def test_likelihood_optimum():
    g = np.random.default_rng(7)
    design = np.eye(300)
    y = g.normal(scale=2.0, size=300) + g.normal(scale=0.1, size=300)
    cost = lambda t: solve.negative_log_likelihood(t, lambda a: np.eye(300) * np.exp(-2 * a[0]), design, np.full(300, 100.0), y)
    theta, _ = solve.minimise(cost, np.array([0.0]))
    assert np.exp(theta[0]) == pytest.approx(2.0, rel=0.15)


def test_elements_by_description(spark):
    model = elements.load([{"element": "grand_mean"}, {"element": "covariate", "column": "dem", "scale": 2.0}])
    df = spark.createDataFrame([(1, 3.0), (2, None)], "row bigint, dem double")
    assert sorted((r.row, r.col, r.value) for r in model.design(df).collect()) == [(1, 0, 1.0), (1, 1, 6.0), (2, 0, 1.0)]
    with pytest.raises(ValueError):
        elements.load([{"element": "os.system"}])


def test_wrapped_time_nodes(spark):
    df = spark.createDataFrame([(1, 11.5), (2, 0.0)], "row bigint, time double")
    got = sorted((r.row, r.col, r.value) for r in elements.time_nodes(0.0, 1.0, 12, wrapped=True).design(df).collect())
    assert got == [(1, 0, 0.5), (1, 11, 0.5), (2, 0, 1.0)]


def test_regions_equal_one_solve_per_region(spark):
    g = np.random.default_rng(9)
    lat, lon = np.degrees(np.arcsin(g.uniform(-1, 1, 120))), g.uniform(-180, 180, 120)
    rows = [(i, float(a), float(b), 2.0, float(r)) for i, (a, b, r) in enumerate(zip(lat, lon, g.normal(size=120), strict=True))]
    obs = spark.createDataFrame(rows, "row bigint, lat double, lon double, q double, r double")
    designs = elements.region_designs(obs, 1, 0)
    got = {(r.region, r.col): r.value for r in solve.solve_regions(designs, obs.select("row", "q", "r"), 0.5).collect()}
    entries = designs.collect()
    for region in {e.region for e in entries}:
        cols = sorted({e.col for e in entries if e.region == region})
        mine = sorted({e.row for e in entries if e.region == region})
        j = np.zeros((len(mine), len(cols)))
        for e in entries:
            if e.region == region:
                j[mine.index(e.row), cols.index(e.col)] += e.value
        r = np.array([rows[k][4] for k in mine])
        x = np.linalg.solve(0.5 * np.eye(len(cols)) + 2 * j.T @ j, 2 * j.T @ r)
        assert np.allclose([got[region, c] for c in cols], x)

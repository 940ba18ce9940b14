"""Sparse factors, priors on views, likelihoods and delayed fields, against dense numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.operators.gmrf import delayed, elements, mesh, solve, spde
from terracell.operators.gmrf.sparse import Entries, SparseFactor
from terracell.plans import queries as observations

DATA = "/root/testdata/sf0.001"


def entries(a):
    row, col = np.nonzero(a)
    return Entries.of(len(a), row, col, a[row, col])


def random_system(seed, n, density):
    g = np.random.default_rng(seed)
    a = g.normal(size=(n, n)) * (g.random((n, n)) < density)
    return a @ a.T + np.diag(g.uniform(1, 2, n))


@pytest.mark.parametrize(("n", "density", "leaf"), [(1, 1.0, 8), (30, 0.0, 4), (40, 0.05, 4), (90, 0.02, 8), (25, 1.0, 4)])
def test_factor_equals_dense(n, density, leaf):
    q = random_system(n, n, density)
    f, inverse = SparseFactor(entries(q), leaf=leaf), np.linalg.inv(q)
    b = np.random.default_rng(1).normal(size=(n, 3))
    row, col = np.nonzero(q)
    assert np.allclose(f.solve(b), inverse @ b) and f.logdet() == pytest.approx(np.linalg.slogdet(q)[1])
    assert np.allclose(f.inverse_at(row, col), inverse[row, col]) and np.allclose(f.deviations(), np.sqrt(np.diag(inverse)))
    assert f.trace_with(entries(q)) == pytest.approx(n)


def test_products_equal_dense():
    g = np.random.default_rng(2)
    a, b = (g.normal(size=(20, 20)) * (g.random((20, 20)) < 0.2) for _ in range(2))
    assert np.allclose((entries(a) @ entries(b)).dense(), a @ b) and np.allclose((entries(a) + entries(b)).dense(), a + b)
    left, right = g.normal(size=20), g.normal(size=20)
    assert np.allclose(entries(a).scaled(left, right).dense(), left[:, None] * a * right) and np.allclose(entries(a) @ left, a @ left)


def test_a_large_mesh_has_a_small_factor():
    q = spde.precision(spde.whole(mesh.Mesh.build(5)), 0.0, -1.0)
    f = SparseFactor(q)
    assert q.size == 10_242 and f.entries < 0.05 * q.size**2
    b = np.random.default_rng(3).normal(size=q.size)
    assert np.allclose(q @ f.solve(b), b, atol=1e-6)
    draws = f.samples(200, 4)
    assert np.median(draws.std(axis=1) / f.deviations()) == pytest.approx(1.0, abs=0.05)
    with pytest.raises(MemoryError):
        SparseFactor(q, most_entries=1000)


def dense_precision(view, log_sigma, log_rho, alpha):
    mass, stiff = view.parts
    c, g, nu = np.diag(mass), stiff.dense(), alpha - 1
    kappa = np.sqrt(8 * nu) / np.exp(log_rho) * np.ones(len(mass))
    gamma = {1: 1.0, 2: 1.0, 3: 2.0, 4: 6.0}
    tau = np.sqrt(gamma[nu] / (gamma[alpha] * 4 * np.pi)) / (np.exp(log_sigma) * kappa**nu)
    k = np.diag(kappa) @ c @ np.diag(kappa) + g
    i = np.linalg.inv(c)
    q = {2: k @ i @ k, 3: k @ i @ k @ i @ k, 4: k @ i @ k @ i @ k @ i @ k}[alpha]
    return np.diag(tau) @ q @ np.diag(tau)


@pytest.mark.parametrize("alpha", [2, 3, 4])
@pytest.mark.parametrize("view", [lambda m: spde.whole(m), lambda m: spde.super_triangle(m, 0, 7), lambda m: spde.neighbourhood(m, 1, 5)])
def test_precision_and_its_derivatives(view, alpha):
    v = view(mesh.Mesh.build(2))
    g = np.random.default_rng(alpha)
    n = len(v.vertices)
    for sigma, rho in ((0.3, -0.5), (g.normal(size=n) * 0.2, g.normal(size=n) * 0.2 - 0.5)):  # stationary or not
        assert np.allclose(spde.precision(v, sigma, rho, alpha).dense(), dense_precision(v, sigma, rho, alpha))
        for ds, dr in ((1.0, 0.0), (0.0, 1.0), (g.normal(size=n), g.normal(size=n))):
            h = 1e-6
            numeric = (dense_precision(v, sigma + h * ds, rho + h * dr, alpha) - dense_precision(v, sigma - h * ds, rho - h * dr, alpha)) / (2 * h)
            got = spde.precision_derivative(v, sigma, rho, ds, dr, alpha).dense()
            assert np.allclose(got, numeric, rtol=1e-4, atol=1e-5 * np.abs(numeric).max())


def test_views_and_merged_parameters():
    m = mesh.Mesh.build(3)
    views = [spde.super_triangle(m, 0, k) for k in range(20)]
    assert sorted(np.concatenate([v.active for v in views]).tolist()) == list(range(len(m.triangles)))
    near = spde.neighbourhood(m, 0, 0)
    assert set(views[0].active) < set(near.active) and len(near.active) == 10 * 64  # three triangles share an edge, six a corner
    sigma, rho = spde.merged_parameters(len(m.points), [(views[0], 0.0, 1.0), (near, np.log(3.0), 1.0)])
    inside = np.isin(np.arange(len(m.points)), views[0].vertices)
    assert np.allclose(sigma[inside], np.log(2.0)) and np.allclose(rho[inside], 1.0)
    assert np.isnan(sigma[~np.isin(np.arange(len(m.points)), near.vertices)]).all()


@pytest.mark.parametrize(("alpha", "wrap"), [(1, False), (2, False), (1, True), (2, True)])
def test_lattice_derivatives(alpha, wrap):
    h = 1e-6
    q, ds, dr = (x.dense() for x in spde.lattice_derivatives(21, 0.2, 0.7, alpha, wrap))
    at = lambda s, r: spde.lattice_precision(21, s, r, alpha, wrap)
    assert np.allclose(q, at(0.2, 0.7)) and np.allclose(ds, (at(0.2 + h, 0.7) - at(0.2 - h, 0.7)) / (2 * h), atol=1e-6)
    assert np.allclose(dr, (at(0.2, 0.7 + h) - at(0.2, 0.7 - h)) / (2 * h), atol=1e-6)


def matern(v):
    return lambda t: (spde.precision(v, t[0], t[1]), [spde.precision_derivative(v, t[0], t[1], 1, 0), spde.precision_derivative(v, t[0], t[1], 0, 1)])


def test_likelihood_and_its_gradient():
    v = spde.whole(mesh.Mesh.build(2))
    g = np.random.default_rng(8)
    truth = SparseFactor(spde.precision(v, 0.5, -0.3)).samples(1, 9)[:, 0]
    design = np.eye(len(truth))[g.integers(0, len(truth), 400)]
    y, w = design @ truth + g.normal(scale=0.1, size=400), np.full(400, 100.0)
    sums = entries(design.T @ (w[:, None] * design)), design.T @ (w * y), float((w * y * y).sum()), float(np.log(w).sum())
    prior = matern(v)
    for t in (np.array([0.5, -0.3]), np.array([-0.2, 0.1])):
        value, gradient = solve.marginal_likelihood(t, prior, *sums)
        dense = lambda a: solve.negative_log_likelihood(a, lambda b: prior(b)[0].dense(), design, w, y)
        assert value == pytest.approx(dense(t))
        assert np.allclose(gradient, [(dense(t + e) - dense(t - e)) / 2e-5 for e in 1e-5 * np.eye(2)], rtol=1e-4, atol=1e-4)
    both = lambda t: solve.marginal_likelihood(t, prior, *sums)
    theta, best = solve.minimise(lambda t: both(t)[0], np.array([0.0, 0.0]), gradient=lambda t: both(t)[1])
    assert best <= both(np.array([0.5, -0.3]))[0] and abs(theta[0] - 0.5) < 0.6


def field_observations(spark, n=300):
    g = np.random.default_rng(10)
    rows = [(i, int(g.integers(2000, 2004)), float(np.degrees(np.arcsin(a))), float(b), float(q), float(r)) for i, (a, b, q, r) in enumerate(zip(g.uniform(-1, 1, n), g.uniform(-180, 180, n), g.uniform(1, 4, n), g.normal(size=n), strict=True))]
    return spark.createDataFrame(rows, "row bigint, time bigint, lat double, lon double, q double, r double")


def dense_times(obs, design, n):
    o, d = obs.toPandas(), design.toPandas()
    for time, part in o.groupby("time"):
        at = {r: k for k, r in enumerate(part["row"])}
        j = np.zeros((len(part), n))
        mine = d[d["row"].isin(at)]
        np.add.at(j, ([at[r] for r in mine["row"]], mine["col"].to_numpy()), mine["value"].to_numpy())
        yield int(time), j, part["q"].to_numpy(), part["r"].to_numpy()


def test_delayed_fields_equal_a_dense_solve_for_each_time(spark):
    obs, v = field_observations(spark), spde.whole(mesh.Mesh.build(1))
    design, prior = elements.local(1).design(obs).cache(), matern(v)
    n, theta = len(v.vertices), np.array([0.1, -0.4])
    sums = delayed.updates(design, obs.select("row", "time", "q", "r")).cache()
    got = delayed.solve_each(sums, prior(theta)[0], samples=3).toPandas()
    cost, gradient = delayed.cost(sums, prior, theta)
    total = 0.0
    for time, j, q, r in dense_times(obs, design, n):
        p = prior(theta)[0].dense() + j.T @ (q[:, None] * j)
        mine = got[got["time"] == time].sort_values("col")
        assert np.allclose(mine["value"], np.linalg.solve(p, j.T @ (q * r))) and np.allclose(mine["std"], np.sqrt(np.diag(np.linalg.inv(p))))
        assert all(len(s) == 3 for s in mine["samples"])
        total += solve.negative_log_likelihood(theta, lambda t: prior(t)[0].dense(), j, q, r)
    assert cost == pytest.approx(total)
    h = 1e-4
    assert np.allclose(gradient, [(delayed.cost(sums, prior, theta + e)[0] - delayed.cost(sums, prior, theta - e)[0]) / (2 * h) for e in h * np.eye(2)], rtol=1e-3, atol=1e-3)
    states = spark.createDataFrame(got[["time", "col", "value", "std"]])
    mean = {r.row: r.value for r in delayed.predicted(design, obs, states.where("time <> 2001")).collect()}
    first = next(dense_times(obs, design, n))
    state = got[got["time"] == first[0]].sort_values("col")["value"].to_numpy()
    rows = [r.row for r in obs.where(F.col("time") == first[0]).collect()]
    assert np.allclose([mean[k] for k in rows], first[1] @ state)
    assert all(mean[r.row] == 0 for r in obs.where("time = 2001").collect())


def test_delayed_fit_lowers_the_cost(spark):
    obs, v = field_observations(spark, 120), spde.whole(mesh.Mesh.build(0))
    sums = delayed.updates(elements.local(0).design(obs), obs.select("row", "time", "q", "r")).cache()
    prior, start = matern(v), np.array([0.5, 0.0])
    theta, cost = delayed.fit(sums, prior, start, most=4)
    assert cost < delayed.cost(sums, prior, start)[0] and np.isfinite(theta).all()


def test_regions_under_a_matern_prior(spark):
    obs = field_observations(spark)
    designs = elements.region_designs(obs, 2, 0).cache()
    got = solve.solve_regions(designs, obs.select("row", "q", "r"), solve.matern_regions(2, 0, 0.2, -0.4)).toPandas()
    o, d = obs.toPandas().set_index("row"), designs.toPandas()
    for region, part in d.groupby("region"):
        view = solve.region_view(2, 0, int(region))
        rows = sorted(set(part["row"]))
        j = np.zeros((len(rows), len(view.vertices)))
        np.add.at(j, (np.searchsorted(rows, part["row"]), np.searchsorted(view.vertices, part["col"])), part["value"].to_numpy())
        q, r = o.loc[rows, "q"].to_numpy(), o.loc[rows, "r"].to_numpy()
        x = np.linalg.solve(spde.precision(view, 0.2, -0.4).dense() + j.T @ (q[:, None] * j), j.T @ (q * r))
        mine = got[got["region"] == region].sort_values("col")
        assert mine["col"].tolist() == view.vertices.tolist() and np.allclose(mine["value"], x)


def test_precision_table_feeds_both_solvers(spark):
    """Prior and information as tables: conjugate gradients and the sparse factor agree."""
    obs, m = field_observations(spark, 80), mesh.Mesh.build(1)
    from terracell.operators.gmrf import coo

    design = elements.local(1).design(obs)
    information = coo.information_matrix(design, obs.select("row", "q")).withColumnsRenamed({"i": "row", "j": "col"})
    posterior = coo.add(spde.precision_table(*m.frames(spark), 0.0, -0.3), information).cache()
    b = coo.information_vector(design, obs.select("row", "q"), obs.select("row", "r")).cache()
    one = solve.map_solution(posterior, b, len(m.points))
    two = solve.dense_vector(solve.conjugate_gradients(posterior, b, 1e-8), len(m.points))
    assert np.allclose(one, two, atol=1e-5)
    assert np.allclose(spde.precision(spde.whole(m), 0.0, -0.3).dense(), solve.dense(spde.precision_table(*m.frames(spark), 0.0, -0.3), 50)[:42, :42])


def test_mesh_tables_read_back(spark, tmp_path):
    m = mesh.Mesh.build(2)
    mesh.write(m, spark, str(tmp_path))
    back = mesh.read(spark, str(tmp_path))
    assert back.level == 2 and np.array_equal(back.points, m.points) and np.array_equal(back.triangles, m.triangles) and np.array_equal(back.ids, m.ids)


@pytest.mark.parametrize("name", ["gmrf_small_solve", "gmrf_conjugate_gradients"])
def test_small_model_equals_normal_equations(spark, name):
    obs, design = observations._design(spark, DATA)
    o, d = obs.toPandas().set_index("row"), design.toPandas()
    at = {r: k for k, r in enumerate(o.index)}
    j = np.zeros((len(o), 6))
    np.add.at(j, ([at[r] for r in d["row"]], d["col"].to_numpy()), d["value"].to_numpy())
    q, r = 1 / o["unc_ran"].to_numpy() ** 2, o["measurement"].to_numpy() - 250
    x = np.linalg.solve(np.eye(6) + j.T @ (q[:, None] * j), j.T @ (q * r))
    got = observations.QUERIES[name](spark, DATA).orderBy("param_id").toPandas()
    assert np.allclose(got["value"], x, rtol=1e-5, atol=1e-5)

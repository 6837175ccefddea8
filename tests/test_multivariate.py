import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveyloom.operators import dbscan, diagnostics, impute, kmeans, neighbors, pca, projection, sample, wide_grid


def _frame(spark, x, parts=3, **extra):
    pdf = pd.DataFrame(x, columns=[f"v{i}" for i in range(x.shape[1])])
    for name, values in extra.items():
        pdf[name] = values
    pdf["id"] = np.arange(len(pdf))
    return spark.createDataFrame(pdf).replace(float("nan"), None).repartition(parts), [f"v{i}" for i in range(x.shape[1])]


def _expected_clusters(x, eps, min_samples):
    """Straight from the definition, all pairs in memory."""
    near = sum((x[:, None, j] - x[None, :, j]) ** 2 for j in range(x.shape[1])) <= eps * eps
    core = near.sum(axis=1) >= min_samples
    number, clusters = [-1] * len(x), 0
    for i in range(len(x)):
        if core[i] and number[i] < 0:
            number[i], todo = clusters, [i]
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core):
                    if number[j] < 0:
                        number[j] = clusters
                        todo.append(j)
            clusters += 1
    beside = [min((number[j] for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(len(x))]
    final = [number[i] if core[i] else beside[i] for i in range(len(x))]
    return ["Noise" if c < 0 else f"Cluster {c}" for c in final]


def _layouts():
    rng = np.random.default_rng(1)
    blobs = np.vstack([rng.normal(0, 1, (150, 2)), rng.normal(5, 0.05, (150, 2)), np.full((100, 2), 2.5), rng.uniform(-10, 10, (80, 2))])
    slabs = np.vstack([np.c_[rng.uniform(0, 0.7, 300), rng.uniform(0, 0.7, 300)], np.c_[rng.uniform(1.69, 2.2, 300), rng.uniform(0, 0.7, 300)]])
    lattice = np.round(rng.uniform(0, 10, (250, 2)))
    return {
        "blobs": (blobs, 0.4, 5), "slabs": (slabs, 1.0, 5), "lattice": (lattice, 1.0, 3),
        "solid": (rng.uniform(0, 4, (300, 3)), 0.5, 4), "line": (rng.uniform(0, 40, (200, 1)), 0.1, 3),
        "all core": (rng.uniform(0, 4, (40, 2)), 0.5, 1), "all noise": (rng.uniform(0, 400, (40, 2)), 0.5, 3),
    }


@pytest.mark.parametrize("layout", sorted(_layouts()))
def test_dbscan_follows_the_definition(spark, layout):
    x, eps, min_samples = _layouts()[layout]
    x = np.random.default_rng(2).permutation(x)
    df, axes = _frame(spark, x)
    got = dbscan.dbscan(df, axes, eps, min_samples, "id").orderBy("id").collect()
    assert [r["Cluster"] for r in got] == _expected_clusters(x, eps, min_samples)


def test_dbscan_with_hot_cells_split(spark, tiny_hot):
    x, eps, min_samples = _layouts()["blobs"]
    df, axes = _frame(spark, x, parts=5)
    got = dbscan.dbscan(df, axes, eps, min_samples, "id").orderBy("id").collect()
    assert [r["Cluster"] for r in got] == _expected_clusters(x, eps, min_samples)


def test_dbscan_touching_dense_cells_at_exactly_eps(spark):
    for gap, clusters in ((1.0, 1), (1.0000001, 2)):
        x = np.vstack([np.full((90, 2), 0.0), np.c_[np.full(90, gap), np.zeros(90)], np.c_[np.linspace(-0.3, 0, 90), np.zeros(90)]])
        df, axes = _frame(spark, x)
        assert dbscan.dbscan(df, axes, 1.0, 5, "id").select("Cluster").distinct().count() == clusters


def test_dbscan_fills_gaps_and_checks_input(spark):
    x = np.array([[0.0, 0.0], [0.1, np.nan], [0.2, 0.0], [9.0, 0.0]])
    df, axes = _frame(spark, x)
    assert [r["Cluster"] for r in dbscan.dbscan(df, axes, 0.5, 3, "id").orderBy("id").collect()] == ["Cluster 0"] * 3 + ["Noise"]
    with pytest.raises(ValueError):
        dbscan.dbscan(df, axes, 0.0, 3, "id")
    with pytest.raises(ValueError):
        dbscan.dbscan(df.withColumn("t", F.lit("x")), ["t"], 1.0, 3, "id")


def _lloyd_best(x, k):
    best = np.inf
    for seed in range(10):
        rng = np.random.default_rng(seed)
        centers = x[rng.choice(len(x), k, replace=False)]
        for _ in range(200):
            label, squared = kmeans.nearest(x, centers)
            centers = np.array([x[label == c].mean(axis=0) if (label == c).any() else centers[c] for c in range(k)])
        best = min(best, kmeans.nearest(x, centers)[1].sum())
    return best


@pytest.mark.parametrize("parts", [1, 7])
def test_kmeans_is_stable_and_as_good_as_plain_restarts(spark, parts):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.6, (60, 2)) for c in ((0, 0), (4, 0), (0, 4), (5, 5))])
    df, axes = _frame(spark, x, parts=parts)
    made = kmeans.kmeans(df, axes, 4, "id")
    assert made.inertia <= 1.01 * _lloyd_best(x, 4)
    labels = [r["Cluster"] for r in made.table.orderBy("id").collect()]
    assert labels[:60].count(labels[0]) > 55 and len(set(labels)) == 4
    assert (made.centers[:-1, 0] <= made.centers[1:, 0]).all()


def test_kmeans_keeps_k_clusters_among_copies(spark):
    x = np.vstack([np.zeros((500, 2)), np.eye(2) * 3, [[9.0, 9.0]]])
    df, axes = _frame(spark, x)
    assert kmeans.kmeans(df, axes, 4, "id").table.select("Cluster").distinct().count() == 4
    with pytest.raises(ValueError):
        kmeans.kmeans(df, axes, 5, "id")


def test_kmeans_restarts_an_empty_cluster(spark, monkeypatch):
    x = np.vstack([np.random.default_rng(0).normal(c, 0.1, (30, 1)) for c in (0, 5, 10)])
    df, axes = _frame(spark, x)
    monkeypatch.setattr(kmeans, "_plus_plus", lambda points, weights, k, seed: np.array([[0.0], [5.0], [500.0]]))
    assert kmeans.kmeans(df, axes, 3, "id").inertia < 5


def test_nearest_in_blocks_is_exact(monkeypatch):
    rng = np.random.default_rng(9)
    monkeypatch.setattr(kmeans, "_BLOCK_CELLS", 64)
    for x, centers in (
        (rng.normal(size=(200, 6)), rng.normal(size=(40, 6))),
        (rng.normal(size=(200, 3)) * 1e-4 + 1e6, rng.normal(size=(30, 3)) * 1e-4 + 1e6),  # a product alone cannot tell these
        (np.round(rng.uniform(0, 4, (200, 2))), np.repeat(np.round(rng.uniform(0, 4, (9, 2))), 2, axis=0)),  # ties
        (np.zeros((5, 2)), np.zeros((1, 2))), (np.zeros((0, 2)), np.ones((3, 2))),
    ):
        squared = ((x[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)
        label, own = kmeans.nearest(x, centers)
        assert (label == squared.argmin(axis=1)).all()
        np.testing.assert_array_equal(own, squared.min(axis=1))


def test_kmeans_by_bounds_finds_the_same_centers(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = np.vstack([rng.normal(c, 0.5, (40, 3)) for c in rng.uniform(-6, 6, (12, 3))])
    df, axes = _frame(spark, x)
    points, names = kmeans.narrow_points(df, [F.col(a) for a in axes], "id")
    configs = [(8, 42), (12, 43), (12, 44)]
    plain = kmeans.fit_all(points, names, configs)
    seen, real = [], kmeans._with_bounds
    monkeypatch.setattr(kmeans, "_BOUND_CENTERS", 10)
    monkeypatch.setattr(kmeans, "_with_bounds", lambda *args: seen.append(sorted(args[2])) or real(*args))
    bounded = kmeans.fit_all(points, names, configs)
    assert seen and all(set(s) <= {1, 2} for s in seen)
    for a, b in zip(plain, bounded):
        assert a.iterations == b.iterations and a.converged == b.converged
        np.testing.assert_allclose(a.centers, b.centers, atol=1e-9)


def test_wide_assignment_matches_the_expression(spark):
    x = np.random.default_rng(1).normal(size=(40, 3))
    df, axes = _frame(spark, x)
    centers = np.random.default_rng(2).normal(size=(5, 3))
    views = [F.col(a) for a in axes]
    small = df.select("id", kmeans.nearest_center(views, centers).alias("c")).orderBy("id").collect()
    assert [r["c"] for r in small] == list(kmeans.nearest(x, centers)[0])
    old, kmeans._EXPRESSION_TERMS = kmeans._EXPRESSION_TERMS, 1
    try:
        assert df.select("id", kmeans.assign(df, views, centers).alias("c")).orderBy("id").collect() == small
    finally:
        kmeans._EXPRESSION_TERMS = old


def test_pca_two_variables(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=200)
    x = np.c_[a, a * 0.6 + rng.normal(size=200) * 0.8]
    df, axes = _frame(spark, x)
    run = pca.run_pca(df, axes, k=5)
    r = np.corrcoef(x.T)[0, 1]
    assert run.k == 2
    assert [s["eigenvalue"] for s in run.spectrum.orderBy("component").collect()] == pytest.approx([1 + r, 1 - r])
    assert [l["loading"] for l in run.loadings.orderBy("number", "position").collect()] == pytest.approx([0.707, 0.707, 0.707, -0.707])


@pytest.mark.parametrize("p, standardize", [(5, True), (5, False), (15, True)])
def test_pca_matches_numpy(spark, p, standardize):
    rng = np.random.default_rng(p)
    x = rng.normal(size=(120, p)) @ rng.normal(size=(p, p)) * np.arange(1, p + 1) + 1e4
    df, axes = _frame(spark, x)
    run = pca.run_pca(df, axes, k=3, standardize=standardize)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) if standardize else 1)
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    assert [s["eigenvalue"] for s in run.spectrum.orderBy("component").collect()] == pytest.approx(list(values[::-1]), rel=1e-6, abs=1e-8)
    scores = run.table.orderBy("id").select(*run.columns).toPandas().to_numpy()
    for c in range(3):
        v = vectors[:, ::-1][:, c]
        v = v * np.sign(v[np.abs(v).argmax()])
        np.testing.assert_allclose(scores[:, c], z @ v, atol=1e-6 * np.abs(z @ v).max())


def test_pca_strategies_and_labels(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 3))
    x[:5, 0] = np.nan
    df, axes = _frame(spark, x)
    whole = pca.run_pca(df, axes, k=1, label="my run", missing="complete")
    assert whole.columns == ["COMP_my_run"] and whole.rows_dropped == 5 and whole.imputed_cells == 0
    assert whole.table.filter("COMP_my_run is null").count() == 5
    again = pca.run_pca(whole.table, axes, k=2, label="my run")
    assert again.replaced == ["COMP_my_run"] and again.columns == ["PC1_my_run", "PC2_my_run"] and again.imputed_cells == 5
    bare = pca.run_pca(again.table, axes, k=2)
    assert {"PC1", "PC2", "PC1_my_run"} <= set(bare.table.columns)
    filled = pca.run_pca(df, axes, k=2, missing="iterative")
    assert filled.table.columns == [*df.columns, "PC1", "PC2"] and filled.table.filter("v0 is null").count() == 5
    assert filled.table.filter("PC1 is null").count() == 0 and filled.converged
    records = pca.run_record(whole).unionByName(pca.run_record(again))
    assert [r["k"] for r in pca.latest_runs(records).collect()] == [2]


def test_pca_refusals(spark):
    df, axes = _frame(spark, np.c_[np.arange(5.0), np.ones(5)])
    for bad in (dict(variables=axes[:1]), dict(variables=axes), dict(variables=axes, missing="other")):
        with pytest.raises(ValueError):
            pca.run_pca(df, **bad)
    assert pca.run_pca(df, axes, standardize=False).k == 2


@pytest.mark.parametrize("share", [0.05, 0.2, 0.35])
def test_iterative_imputation_beats_the_median(spark, share):
    rng = np.random.default_rng(20)
    base = rng.normal(size=(150, 2))
    x = base @ rng.normal(size=(2, 4)) + rng.normal(size=(150, 4)) * 0.2
    holes = rng.random(x.shape) < share
    holes[holes.all(axis=1)] = False
    gapped = np.where(holes, np.nan, x)
    df, axes = _frame(spark, gapped)
    fit = impute.fit_iterative(df, axes, rank=2, max_iter=25)
    got = fit.fill(df).orderBy("id").select(*axes).toPandas().to_numpy()
    assert fit.filled == holes.sum() and np.array_equal(got[~holes], x[~holes])
    median = np.where(holes, np.nanmedian(gapped, axis=0), x)
    assert np.abs(got - x)[holes].mean() < 0.7 * np.abs(median - x)[holes].mean()


@pytest.mark.parametrize("carry", [1, 3])
def test_iterative_imputation_from_stored_rows(spark, monkeypatch, carry):
    """Steps replayed from rows stored on the way give what replaying all of them gives."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(120, 2)) @ rng.normal(size=(2, 5)) + rng.normal(size=(120, 5)) * 0.3
    df, axes = _frame(spark, np.where(rng.random(x.shape) < 0.15, np.nan, x))
    monkeypatch.setattr(impute, "_CARRY", 10**6)
    whole = impute.fit_iterative(df, axes, max_iter=20, tol=0.0)
    monkeypatch.setattr(impute, "_CARRY", carry)
    made = impute.fit_iterative(df, axes, max_iter=20, tol=0.0)
    assert made.iterations == whole.iterations == 20
    for a, b in zip(whole.steps, made.steps):
        np.testing.assert_allclose(a.mean, b.mean, atol=1e-12)
        np.testing.assert_allclose(a.shrink, b.shrink, atol=1e-12)
    x0 = np.array([list(r) for r in whole.fill(df).orderBy("id").select(*axes).collect()])
    x1 = np.array([list(r) for r in made.fill(df).orderBy("id").select(*axes).collect()])
    np.testing.assert_allclose(x0, x1, atol=1e-10)


def test_iterative_imputation_without_gaps(spark):
    df, axes = _frame(spark, np.random.default_rng(0).normal(size=(20, 3)))
    fit = impute.fit_iterative(df, axes)
    assert (fit.iterations, fit.converged, fit.filled) == (0, True, 0)


def test_projection(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(3, 2, (50, 3))
    x[4, 1] = np.nan
    pdf = pd.DataFrame(x, columns=["Open", "close", "flat"]).assign(flat=1.0, id=range(50), PC1=0.0)
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    parts = spark.createDataFrame([("Open", 0.5, "0.25"), (" CLOSE", -0.5, "bad"), ("gone", 1.0, "1"), ("flat", 1.0, "0")],
                                  "name string, a double, b string")
    made = projection.project(df, parts)
    assert (made.matched, made.listed, made.fuzzy, made.unreadable, made.columns) == (3, 4, 1, 1, ["PC1", "PC2"])
    filled = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    z = (filled - filled.mean(axis=0)) / filled.std(axis=0)
    got = made.table.orderBy("id").select("PC1", "PC2").toPandas().to_numpy()
    np.testing.assert_allclose(got, np.c_[0.5 * z[:, 0] - 0.5 * z[:, 1], 0.25 * z[:, 0]], atol=1e-9)
    assert len(made.warnings) == 4
    with pytest.raises(ValueError):
        projection.project(df, parts.filter("name = 'gone'"))
    with pytest.raises(ValueError):
        projection.project(df, parts.select("a", "b"))


def test_sample_follows_the_hash_order(spark):
    import hashlib

    df = spark.createDataFrame(pd.DataFrame({"k": range(3000), "v": [None if i % 7 == 0 else 1.0 for i in range(3000)]})).repartition(4)
    order = sorted((hashlib.md5(f"{i}-{sample.SAMPLE_SEED}".encode()).hexdigest(), i) for i in range(3000) if i % 7)
    got = sorted(r["k"] for r in sample.seeded_sample(df, ["v"], "k", 400).collect())
    assert got == sorted(i for _, i in order[:400])


def test_sample_sees_every_stratum(spark):
    df = spark.range(4800).withColumn("wave", F.col("id") % 4).withColumn("v", F.col("id") * 1.0)
    counts = sample.seeded_sample(df, ["v"], "id", 1200).groupBy("wave").count().collect()
    assert len(counts) == 4 and all(200 < r["count"] < 400 for r in counts)


def test_silhouette_rules(spark):
    x = np.array([[0.0], [0.1], [5.0], [5.1], [20.0]])
    df, axes = _frame(spark, x, g=["a", "a", "b", "b", "c"])
    got = diagnostics.silhouette_of(df, axes, "g", "id", sample_rows=1200).first()["silhouette"]
    def s(i, own, other):
        a, b = abs(x[i] - x[own])[0], np.mean([abs(x[i] - x[o])[0] for o in other])
        return (b - a) / max(a, b)
    assert got == pytest.approx((s(0, 1, [2, 3]) + s(1, 0, [2, 3]) + s(2, 3, [0, 1]) + s(3, 2, [0, 1]) + 0) / 5)
    one, axes = _frame(spark, np.zeros((6, 1)), g=["a"] * 3 + ["b"] * 3)
    assert diagnostics.silhouette_of(one, axes, "g", "id", sample_rows=1200).first()["silhouette"] == 0
    assert diagnostics.silhouette_of(one, axes, "g", "id").first()["squared_silhouette"] == 0
    squared = (x - x.T) ** 2
    own = [np.array(o) for o in ([1], [0], [3], [2])]
    ab = [(squared[i, own[i]].mean(), min(squared[i, o].mean() for o in ([0, 1], [2, 3], [4]) if i not in o)) for i in range(4)]
    got = diagnostics.silhouette_of(df, axes, "g", "id").first()
    assert got["squared_silhouette"] == pytest.approx(sum((b - a) / max(a, b) for a, b in ab) / 5) and got["n"] == 5


def _plain_silhouette(x, labels, power):
    away = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) ** power
    values = []
    for i, own in enumerate(labels):
        mine = labels == own
        if mine.sum() == 1 or mine.all():
            values.append(0.0)
            continue
        a = away[i, mine].sum() / (mine.sum() - 1)
        b = min(away[i, labels == o].mean() for o in set(labels) - {own})
        values.append(0.0 if max(a, b) == 0 else (b - a) / max(a, b))
    return np.mean(values)


@pytest.mark.parametrize("block, gathered", [(2048, 1024), (7, 1024), (7, 3)])
def test_silhouettes_of_all_rows(spark, monkeypatch, block, gathered):
    monkeypatch.setattr(diagnostics, "_BLOCK_ROWS", block)
    monkeypatch.setattr(diagnostics, "GATHERED_LABELS", gathered)
    rng = np.random.default_rng(5)
    labels = np.array([f"c{i}" for i in rng.integers(0, 6, 120)] + ["alone", "twins", "twins"])
    x = np.vstack([rng.normal(0, 2, (121, 3)), np.ones((2, 3))])
    df, axes = _frame(spark, x, g=[str(v) for v in labels])
    df = df.repartition(4)
    got = diagnostics.silhouette_of(df, axes, "g", "id").first()
    assert got["squared_silhouette"] == pytest.approx(_plain_silhouette(x, labels, 2)) and got["n"] == 123
    if gathered < 10:
        with pytest.raises(ValueError):
            diagnostics.silhouette_of(df, axes, "g", "id", euclidean=True)
        return
    got = diagnostics.silhouette_of(df, axes, "g", "id", euclidean=True).first()
    assert got["silhouette"] == pytest.approx(_plain_silhouette(x, labels, 1)) and got["n"] == 123
    one = diagnostics.silhouette_of(df.withColumn("one", F.lit("x")), axes, "one", "id", euclidean=True).first()
    assert one["silhouette"] == 0 and one["n"] == 123
    monkeypatch.setattr(diagnostics, "EXACT_ROWS", 122)
    with pytest.raises(ValueError):
        diagnostics.silhouette_of(df, axes, "g", "id", euclidean=True)


@pytest.mark.parametrize("d", [1, 2])
def test_euclidean_silhouettes_of_blocks_far_apart(spark, monkeypatch, d):
    """Blocks far apart meet in the nodes of their boxes, to the digits of the sums over all pairs."""
    monkeypatch.setattr(diagnostics, "_BLOCK_ROWS", 32)
    monkeypatch.setattr(diagnostics, "_BLOCKS_AT_ONCE", 4)
    rng = np.random.default_rng(d)
    x = np.vstack([rng.normal(c, 1.0, (150, d)) for c in (0.0, 30.0, 1e5)] + [np.full((50, d), 7.0), rng.uniform(-1e3, 1e3, (20, d))])
    labels = np.array([f"c{i}" for i in rng.integers(0, 4, len(x) - 3)] + ["alone", "twins", "twins"])
    df, axes = _frame(spark, x, g=[str(v) for v in labels])
    got = diagnostics.silhouette_of(df.repartition(3), axes, "g", "id", euclidean=True).first()
    assert got["silhouette"] == pytest.approx(_plain_silhouette(x, labels, 1), rel=1e-10) and got["n"] == len(x)
    one, other = (diagnostics._Block(m, np.zeros((len(m), 1), int), 1) for m in (x[:150], x[300:450]))
    one.add(other)
    direct = np.sqrt(((x[:150, None] - x[None, 300:450]) ** 2).sum(axis=2)).sum(axis=1)
    assert one.beyond(other) and not one.sums.any() and np.allclose(one.total()[:, 0], direct, rtol=1e-12)


def test_labels_as_many_as_rows(spark, monkeypatch):
    monkeypatch.setattr(diagnostics, "GATHERED_LABELS", 10)
    df, axes = _frame(spark, np.arange(40.0).reshape(-1, 1), g=[str(i) for i in range(40)])
    got = diagnostics.silhouette_of(df, axes, "g", "id").first()
    assert got["squared_silhouette"] == 0 and got["n"] == 40


def test_iterations_by_pattern_equal_those_by_rows(spark, monkeypatch):
    """Few patterns of gaps need no pass over the rows for an iteration; many go on row by row, to the same fill."""
    rng = np.random.default_rng(17)
    x = rng.normal(size=(400, 2)) @ rng.normal(size=(2, 4)) * 10 + 1000 + rng.normal(size=(400, 4))
    cells = [[None if g else float(v) for v, g in zip(row, gap)] for row, gap in zip(x, rng.random((400, 4)) < 0.15)]
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(cells)], "id long, a double, b double, c double, d double").repartition(3)
    passes, whole = [], impute.tree_sum
    monkeypatch.setattr(impute, "tree_sum", lambda *a, **k: passes.append(1) or whole(*a, **k))
    found = []
    for numbers in (impute._PATTERN_NUMBERS, 21):
        monkeypatch.setattr(impute, "_PATTERN_NUMBERS", numbers)
        fit = impute.fit_iterative(df, ["a", "b", "c", "d"])
        found.append((fit, len(passes), np.array([r[1:] for r in fit.fill(df).orderBy("id").collect()])))
    (few, one, filled), (many, _, by_row) = found
    assert one == 1 and few.iterations == many.iterations > 3 and few.converged and many.converged
    assert np.allclose(filled, by_row, rtol=1e-9) and not np.isnan(filled).any()


@pytest.mark.parametrize("d", [1, 2, 5])
def test_many_labels_meet_near_clusters_only(spark, monkeypatch, d):
    monkeypatch.setattr(diagnostics, "GATHERED_LABELS", 10)
    monkeypatch.setattr(diagnostics, "_ROWS_AT_ONCE", 64)
    monkeypatch.setattr(diagnostics, "_CLUSTERS_AT_ONCE", 16)
    rng = np.random.default_rng(8)
    middles = rng.uniform(0, 100, (400, d))
    labels = np.concatenate([np.arange(400), rng.integers(0, 400, 1600)])
    x = middles[labels] + rng.normal(0, 3, (2000, d))
    x[7] = 1e5  # one row far away from all others
    df, axes = _frame(spark, x, g=[str(v) for v in labels])
    met, whole = [], diagnostics._reachable

    def counted(left, right, d):
        pairs = whole(left, right, d)
        met.append((pairs.count(), left.stored_rows * right.stored_rows))
        return pairs

    monkeypatch.setattr(diagnostics, "_reachable", counted)
    got = diagnostics.silhouette_of(df.repartition(3), axes, "g", "id").first()
    assert got["squared_silhouette"] == pytest.approx(_plain_silhouette(x, labels, 2)) and got["n"] == 2000
    if d == 1:
        assert met[0][0] < met[0][1] / 2


def test_suggest_k_finds_the_blobs(spark):
    rng = np.random.default_rng(3)
    df, axes = _frame(spark, np.vstack([rng.normal(c, 0.3, (40, 2)) for c in ((0, 0), (6, 0), (0, 6))]))
    by_k = diagnostics.silhouette_by_k(df, axes, 5, "id")
    assert [r["k"] for r in by_k.collect()] == [2, 3, 4, 5] and diagnostics.suggest_k(by_k) == 3
    small, axes = _frame(spark, rng.normal(size=(9, 2)))
    assert diagnostics.silhouette_by_k(small, axes, 5, "id").count() == 0


def test_k_distance_agrees_with_dbscan(spark):
    x = np.random.default_rng(5).normal(size=(80, 2))
    df, axes = _frame(spark, x)
    row = diagnostics.k_distance(df, axes, 4, "id").first()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    kth = np.sort(np.sort(d, axis=1)[:, 3])
    assert (row["n"], row["kth_neighbor"]) == (80, 3) and row["p50"] == pytest.approx(kth[40]) and row["max"] == pytest.approx(kth[-1])
    assert dbscan.core_points(df, axes, row["max"] * (1 + 1e-12), 4, "id").count() == 80
    assert diagnostics.k_distance(df, axes, 1, "id").count() == 0


@pytest.mark.parametrize("d", [1, 2, 6])
def test_k_distance_sees_all_rows_of_uneven_tables(spark, monkeypatch, d):
    monkeypatch.setattr(neighbors, "_CROWD", 8)
    monkeypatch.setattr(neighbors, "_PACK", 16)
    rng = np.random.default_rng(d)
    x = np.concatenate([rng.normal(size=(200, d)), np.zeros((60, d)), rng.normal(50, 0.01, (150, d)), rng.uniform(-900, 900, (20, d))])
    df, axes = _frame(spark, x)
    distance = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), axis=1)
    for m in (2, 5, 70):
        row, kth = diagnostics.k_distance(df, axes, m, "id").first(), np.sort(distance[:, m - 1])
        assert row["n"] == len(x)
        assert [row[f"p{p}"] for p in (50, 75, 90, 95)] == pytest.approx([kth[int(p / 100 * len(x))] for p in (50, 75, 90, 95)], abs=1e-9)
        assert row["max"] == pytest.approx(kth[-1])


@pytest.mark.parametrize("d", [6, 9])
def test_dbscan_on_many_axes(spark, d):
    rng = np.random.default_rng(d)
    x = np.concatenate([rng.normal(c, 0.4, (60, d)) for c in (0, 3)] + [rng.uniform(-4, 7, (25, d)), np.full((9, d), -8.0)])
    df, axes = _frame(spark, x)
    for eps, m in ((1.0, 4), (1.6, 6)):
        near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= eps * eps
        core = np.flatnonzero(near.sum(axis=1) >= m)
        assert sorted(r["row_id"] for r in dbscan.core_points(df, axes, eps, m, "id").collect()) == core.tolist()
        got = {r["row_id"]: r["label"] for r in dbscan.dbscan_labels(df, axes, eps, m, "id").collect()}
        assert [got[i] for i in range(len(x))] == _expected_clusters(x, eps, m)


def _crowds(d):
    """Dense balls: one crowd, one that touches it, one on its own; a thin bridge, border rows and noise; repeated places."""
    rng = np.random.default_rng(d)
    balls = [rng.normal(c, 0.05, (n, d)) for c, n in ((0.0, 150), (0.25, 60), (2.0, 80))]
    bridge = np.linspace(2.0, 2.6, 12)[:, None] * np.ones(d)
    return np.concatenate([*balls, bridge, rng.uniform(-1, 3, (40, d)), np.full((9, d), 1.0), np.full((3, d), -1.0)])


@pytest.mark.parametrize(("d", "pack", "eps", "m"), [(6, 1024, 0.4, 5), (8, 40, 0.62, 30)])
def test_dbscan_on_many_axes_where_rows_crowd(spark, tiny_hot, monkeypatch, d, pack, eps, m):
    monkeypatch.setattr(wide_grid, "_PACK", pack)
    x = np.random.default_rng(1).permutation(_crowds(d))
    df, axes = _frame(spark, x, parts=3)
    got = {r["row_id"]: r["label"] for r in dbscan.dbscan_labels(df, axes, eps, m, "id").collect()}
    assert [got[i] for i in range(len(x))] == _expected_clusters(x, eps, m)


def test_dbscan_on_many_axes_asks_in_rounds(spark, monkeypatch):
    """Crowds wider than a cell: few rows are left to meet all others, and those of one large cluster do not meet again."""
    for name, value in (("_FIRST", 150), ("_EACH", 1), ("_MORE", 3), ("_PACK", 32), ("_FILLED", 8)):
        monkeypatch.setattr(wide_grid, name, value)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.5, (700, 6)), rng.normal(1.8, 0.4, (500, 6)), np.full((7, 6), -3.0), rng.uniform(-3, 4, (30, 6))])
    x = rng.permutation(x)
    df, axes = _frame(spark, x, parts=3)
    compared, pairs = [], wide_grid.WideGrid._pairs

    def counted(self, *args, **more):
        made = pairs(self, *args, **more)
        compared.append(made.agg(F.sum(F.size("a").cast("long") * F.size("b"))).first()[0] or 0)
        return made

    monkeypatch.setattr(wide_grid.WideGrid, "_pairs", counted)
    got = {r["row_id"]: r["label"] for r in dbscan.dbscan_labels(df, axes, 1.0, 4, "id").collect()}
    assert [got[i] for i in range(len(x))] == _expected_clusters(x, 1.0, 4)
    assert len(compared) >= 4 and sum(compared) < len(x) ** 2, compared


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_rows_within_reach_are_told_by_the_plain_sum(offset):
    x = np.random.default_rng(2).integers(-6, 7, (300, 6)) * 0.1 + offset
    total = np.zeros((len(x), len(x)))
    for j in range(6):
        total += (x[:, j, None] - x[None, :, j]) ** 2
    for eps in (0.2, 0.3, 0.7, float(np.sqrt(total[0, 1]))):
        assert np.array_equal(wide_grid.within(x, x, eps * eps), total <= eps * eps)
    assert np.array_equal(wide_grid.within(x, x[:1], total[5, 0]), total[:, :1] <= total[5, 0])


def test_run_takes_its_label_from_the_variables(spark):
    x = np.random.default_rng(1).normal(size=(40, 2))
    df = spark.createDataFrame(pd.DataFrame({"mood_1": x[:, 0], "mood_2": x[:, 1]}))
    assert pca.run_pca(df, ["mood_1", "mood_2"], k=1, label=None).columns == ["COMP_mood"]


def test_kmeans_can_form_nearly_as_many_clusters_as_points(spark):
    df, axes = _frame(spark, np.random.default_rng(0).normal(size=(600, 2)))
    points, names = kmeans.narrow_points(df, [F.col(a) for a in axes], "id")
    fits = kmeans.fit_all(points, names, [(560, 42)])
    assert fits[0].converged and len(np.unique(fits[0].centers, axis=0)) == 560
    with pytest.raises(ValueError, match="only 600 distinct"):
        kmeans.fit_all(points, names, [(601, 42)])

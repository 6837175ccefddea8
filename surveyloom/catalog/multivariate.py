"""PCA, imputation, projection, clustering, diagnostics, samples."""

from __future__ import annotations



from pyspark.sql import functions as F

from surveyloom.catalog.common import rounded, sql_round, table
from surveyloom.functions.numeric import as_number, round_half_up
from surveyloom.operators import dbscan as grid
from surveyloom.operators import diagnostics, impute, kmeans, missing, pca, projection, sample

QUERIES = {}
CHECKS = {}

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(check=None):
    def add(f):
        QUERIES[f.__name__] = f
        if check is not None:
            CHECKS[f.__name__] = check
        return f
    return add


_TWO = "SELECT abs(corr(c_acctbal, c_nationkey)) AS r FROM customer"


@query(f"""SELECT CAST(component AS INTEGER) AS component, {sql_round('eigenvalue')} AS eigenvalue, {sql_round('eigenvalue / 2')} AS share,
    {sql_round("CASE component WHEN 1 THEN eigenvalue / 2 ELSE 1 END")} AS cumulative
    FROM (SELECT 1 AS component, 1 + r AS eigenvalue FROM ({_TWO}) UNION ALL SELECT 2, 1 - r FROM ({_TWO}))""")
def pca_two_spectrum(spark, folder):
    run = pca.run_pca(table(spark, folder, "customer"), ["c_acctbal", "c_nationkey"])
    return run.spectrum.select("component", rounded("eigenvalue"), rounded("share"), rounded("cumulative"))


@query(f"""WITH m AS (SELECT avg(c_acctbal) AS ma, stddev_pop(c_acctbal) AS sa, avg(c_nationkey) AS mb, stddev_pop(c_nationkey) AS sb,
      CASE WHEN corr(c_acctbal, c_nationkey) < 0 THEN -1 ELSE 1 END AS s FROM customer),
    z AS (SELECT c_custkey, (c_acctbal - ma) / sa / sqrt(2) AS a, s * (c_nationkey - mb) / sb / sqrt(2) AS b FROM customer, m)
    SELECT c_custkey, {sql_round('a + b', 4)} AS PC1_wealth, {sql_round('a - b', 4)} AS PC2_wealth FROM z""")
def pca_two_scores(spark, folder):
    run = pca.run_pca(table(spark, folder, "customer"), ["c_acctbal", "c_nationkey"], k=2, label="wealth")
    return run.table.select("c_custkey", rounded("PC1_wealth", 4), rounded("PC2_wealth", 4))


def _correlations() -> str:
    cells = ", ".join(f"corr({a}, {b}) AS c{i}{j}" for i, a in enumerate(MEASURES) for j, b in enumerate(MEASURES))
    return f"SELECT {cells} FROM lineitem"


def _trace(power: int) -> str:
    """Trace of the matrix power, written out over all closed walks."""
    walks = [[i] for i in range(4)]
    for _ in range(power - 1):
        walks = [w + [j] for w in walks for j in range(4)]
    return " + ".join("*".join(f"c{a}{b}" for a, b in zip(w, w[1:] + w[:1])) for w in walks)


@query(f"SELECT {', '.join(f'{sql_round(_trace(k))} AS s{k}' for k in (1, 2, 3, 4))} FROM ({_correlations()})")
def pca_power_sums(spark, folder):
    """Power sums of the eigenvalues equal the traces of the matrix powers, which fixes all four."""
    run = pca.run_pca(table(spark, folder, "lineitem"), MEASURES, k=4)
    powers = [round_half_up(F.sum(F.pow("eigenvalue", F.lit(float(k)))), 6).alias(f"s{k}") for k in (1, 2, 3, 4)]
    return run.spectrum.agg(*powers)


@query("SELECT count(*) AS n, 0 AS off_variance, 0 AS correlated, 0 AS off_center FROM lineitem")
def pca_score_invariants(spark, folder):
    """Scores are centred, uncorrelated, and their variances are the eigenvalues."""
    run = pca.run_pca(table(spark, folder, "lineitem"), MEASURES, k=4)
    values = [r["eigenvalue"] for r in run.spectrum.orderBy("component").collect()]
    scores = run.columns
    pairs = [(a, b) for i, a in enumerate(scores) for b in scores[i + 1:]]
    one = lambda tests: sum((t.cast("int") for t in tests), F.lit(0))
    return run.table.agg(
        F.count(F.lit(1)).alias("n"),
        one([F.abs(F.var_pop(s) - F.lit(v)) > 1e-9 for s, v in zip(scores, values)]).alias("off_variance"),
        one([F.abs(F.covar_pop(a, b)) > 1e-9 for a, b in pairs]).alias("correlated"),
        one([F.abs(F.avg(s)) > 1e-9 for s in scores]).alias("off_center"),
    )


# orders with gaps written by formula; identical text on both sides
_GAPPED = ("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 4 THEN NULL ELSE o_totalprice END AS price, "
           "CASE WHEN o_orderkey % 13 = 5 THEN NULL ELSE o_totalprice * 0.5 + o_custkey END AS mixed, "
           "o_custkey * 1.0 AS cust, o_totalprice - 3 * o_custkey AS blend FROM orders")


def _gapped(spark, folder):
    return spark.sql(_GAPPED.replace("FROM orders", "FROM {o}"), o=table(spark, folder, "orders"))


@query(f"""WITH g AS ({_GAPPED}) SELECT count(*) AS n, count(*) FILTER (WHERE price IS NOT NULL AND mixed IS NOT NULL) AS scored,
    count(*) - count(price) + count(*) - count(mixed) AS missing_cells, 0 AS imputed_cells FROM g""")
def pca_complete_cases(spark, folder):
    run = pca.run_pca(_gapped(spark, folder), ["price", "mixed", "cust"], k=1, label="value", missing="complete")
    counts = run.table.agg(F.count(F.lit(1)).alias("n"), F.count("COMP_value").alias("scored")).withColumn(
        "missing_cells", run.missing.agg(F.sum("missing")).scalar())
    return counts.withColumn("imputed_cells", F.lit(run.imputed_cells))


@query(f"""WITH g AS ({_GAPPED}) SELECT count(*) AS n, count(*) - count(price) + count(*) - count(mixed) AS filled,
    0 AS observed_changed, 0 AS still_missing, TRUE AS converged FROM g""")
def impute_iterative(spark, folder):
    columns = ["price", "mixed", "cust", "blend"]
    gapped = _gapped(spark, folder)
    fit = impute.fit_iterative(gapped, columns, rank=2)
    copies = {c: f"f_{c}" for c in columns}
    both = fit.renamed(copies).fill(gapped.withColumns({f: as_number(gapped, c) for c, f in copies.items()}))
    changed = [(F.col(c).isNotNull() & (F.col(c).cast("double") != F.col(f))).cast("int") for c, f in copies.items()]
    missing = [F.col(f).isNull().cast("int") for f in copies.values()]
    filled = [(F.col(c).isNull() & F.col(f).isNotNull()).cast("int") for c, f in copies.items()]
    total = lambda parts: F.sum(sum(parts, F.lit(0)))
    return both.agg(
        F.count(F.lit(1)).alias("n"), total(filled).alias("filled"), total(changed).cast("int").alias("observed_changed"),
        total(missing).cast("int").alias("still_missing")).withColumn("converged", F.lit(fit.converged))


# Two columns leave one component, whose fill of a cell has a closed form: with correlation r, its sign s and
# q = |r| / (1 + |r|), the standardized fill is q (a + s b). The recursion carries the whole table, step by step.
_PAIR_START = f"""g AS ({_GAPPED}), start AS (SELECT o_orderkey, price IS NULL AS ga, mixed IS NULL AS gb,
      coalesce(CAST(price AS DOUBLE), avg(price) OVER ()) AS a, coalesce(CAST(mixed AS DOUBLE), avg(mixed) OVER ()) AS b FROM g)"""
_PAIR_STEP = """SELECT o_orderkey, ga, gb, a, b, it + 1 AS it,
      CASE WHEN ga THEN ma + sa * q * ((a - ma) / sa + s * (b - mb) / sb) ELSE a END AS na,
      CASE WHEN gb THEN mb + sb * q * (s * (a - ma) / sa + (b - mb) / sb) ELSE b END AS nb
    FROM (SELECT *, abs(r) / (1 + abs(r)) AS q, CASE WHEN r < 0 THEN -1 ELSE 1 END AS s FROM (
      SELECT *, avg(a) OVER () AS ma, avg(b) OVER () AS mb, stddev_pop(a) OVER () AS sa, stddev_pop(b) OVER () AS sb, corr(a, b) OVER () AS r
      FROM fill WHERE open))"""
_PAIR = f"""{_PAIR_START}, fill AS (SELECT *, 0 AS it, TRUE AS open FROM start UNION ALL
    SELECT o_orderkey, ga, gb, na AS a, nb AS b, it,
      it < 200 AND sum(CASE WHEN ga THEN (na - a) * (na - a) ELSE 0 END + CASE WHEN gb THEN (nb - b) * (nb - b) ELSE 0 END) OVER ()
      > 1e-8::DOUBLE * sum(CASE WHEN ga THEN na * na ELSE 0 END + CASE WHEN gb THEN nb * nb ELSE 0 END) OVER () AS open
    FROM ({_PAIR_STEP})), last AS (SELECT * FROM fill WHERE NOT open)"""


@query(f"""WITH RECURSIVE {_PAIR} SELECT o_orderkey, {sql_round('a', 3)} AS price, {sql_round('b', 3)} AS mixed FROM last""")
def impute_values(spark, folder):
    """The numbers the iterative fill leaves in two columns, gaps and all."""
    pair = _gapped(spark, folder).select("o_orderkey", "price", "mixed")
    fit = impute.fit_iterative(pair, ["price", "mixed"])
    return fit.fill(pair).select("o_orderkey", rounded("price", 3), rounded("mixed", 3))


_PAIR_VALUES = "SELECT corr(a, b) AS r, max(it) AS it FROM last"


@query(f"""WITH RECURSIVE {_PAIR} SELECT CAST(c AS INTEGER) AS component, {sql_round('CASE c WHEN 1 THEN 1 + abs(r) ELSE 1 - abs(r) END')} AS eigenvalue,
    {sql_round('CASE c WHEN 1 THEN 1 + abs(r) ELSE 1 - abs(r) END / 2')} AS share, CAST(it AS INTEGER) AS iterations
    FROM ({_PAIR_VALUES}), (SELECT unnest([1, 2]) AS c)""")
def pca_iterative_pair(spark, folder):
    """The spectrum of two columns after the iterative fill, and the steps it took."""
    run = pca.run_pca(_gapped(spark, folder), ["price", "mixed"], k=1, missing="iterative")
    return run.spectrum.select("component", rounded("eigenvalue"), rounded("share"), F.lit(run.iterations).alias("iterations"))


@query()
def pca_iterative(spark, folder):
    run = pca.run_pca(_gapped(spark, folder), ["price", "mixed", "cust", "blend"], k=2, missing="iterative")
    return run.spectrum


@query("SELECT 'openness' AS label, CAST(1 AS INTEGER) AS k, count(*) AS rows_used FROM lineitem")
def pca_run_registry(spark, folder):
    """A re-run of a label replaces its record."""
    lineitem = table(spark, folder, "lineitem")
    first = pca.run_pca(lineitem, MEASURES[:2], k=2, label="openness")
    again = pca.run_pca(first.table, MEASURES, k=1, label="openness")
    records = pca.run_record(first).unionByName(pca.run_record(again))
    return pca.latest_runs(records).select("label", "k", "rows_used")


@query("SELECT 'trust' AS label, 'PC1_trust,PC2_trust' AS columns, CAST(2 AS INTEGER) AS k, count(*) AS rows_used, "
       "CAST(0 AS BIGINT) AS unscored FROM lineitem")
def pca_derived_label(spark, folder):
    """A run without a label is named after what its variables' names share."""
    items = table(spark, folder, "lineitem").select(*[F.col(c).alias(f"trust_{i}") for i, c in enumerate(MEASURES, 1)])
    run = pca.run_pca(items, items.columns, k=2, label=None)
    unscored = run.table.filter(" or ".join(f"{c} is null" for c in run.columns)).count()
    return pca.run_record(run).select("label", F.lit(",".join(run.columns)).alias("columns"), "k", "rows_used",
                                      F.lit(unscored).cast("bigint").alias("unscored"))


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\" FROM (SELECT {v} AS v FROM orders) HAVING count(TRY_CAST(trim(v) AS DOUBLE)) = 0" for c, v in [
        ("status", "o_orderstatus"), ("priority", "o_orderpriority"), ("rare", "CASE WHEN o_orderkey % 50 = 7 THEN ' 12 ' ELSE 'n/a' END"),
        ("day", "strftime(o_orderdate, '%Y-%m-%d')"), ("never", "'n/a'"), ("total", "CAST(o_totalprice AS VARCHAR)")]))
def unusable_axes(spark, folder):
    """Columns without a single number; one number in fifty rows is enough."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.when(F.col("o_orderkey") % 50 == 7, " 12 ").otherwise("n/a").alias("rare"), F.col("o_orderdate").alias("day"),
        F.lit("n/a").alias("never"), F.col("o_totalprice").alias("total"))
    return spark.createDataFrame([(c,) for c in missing.unusable_columns(orders, orders.columns)], "column string")


# a components table as another tool would write it: one name in other case, one
# variable the dataset lacks, one unreadable loading
COMPONENTS = [("l_quantity", "0.8", 0.1), (" L_ExtendedPrice", "0.5", -0.4), ("l_discount", "n/a", 0.7), ("l_weight", "0.3", 0.3)]
_Z = {c: f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()" for c in MEASURES}


def _components(spark):
    return spark.createDataFrame(COMPONENTS, "Variable string, PC1 string, PC2 double")


@query(f"""SELECT l_returnflag, count(*) AS n, {sql_round('avg(a)')} AS mean1, {sql_round('stddev_pop(a)')} AS sd1,
    {sql_round('avg(b)')} AS mean2, {sql_round('stddev_pop(b)')} AS sd2 FROM (SELECT l_returnflag,
    0.8::DOUBLE * {_Z['l_quantity']} + 0.5::DOUBLE * {_Z['l_extendedprice']} AS a,
    0.1::DOUBLE * {_Z['l_quantity']} - 0.4::DOUBLE * {_Z['l_extendedprice']} + 0.7::DOUBLE * {_Z['l_discount']} AS b FROM lineitem) GROUP BY 1""")
def projection_scores(spark, folder):
    made = projection.project(table(spark, folder, "lineitem"), _components(spark))
    return made.table.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.avg("PC1").alias("mean1"), F.stddev_pop("PC1").alias("sd1"),
        F.avg("PC2").alias("mean2"), F.stddev_pop("PC2").alias("sd2"),
    ).select("l_returnflag", "n", rounded("mean1"), rounded("sd1"), rounded("mean2"), rounded("sd2"))


_Z_CUSTOMER = """SELECT c_custkey AS id, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS x,
    (c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER () AS y FROM customer"""
EPS, MIN_SAMPLES = 0.08, 4
_NEAR = f"""z AS ({_Z_CUSTOMER}), near AS (SELECT a.id AS p, b.id AS q FROM z a, z b
    WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EPS * EPS!r}::DOUBLE),
    core AS (SELECT p AS id FROM near GROUP BY p HAVING count(*) >= {MIN_SAMPLES})"""


@query(f"WITH {_NEAR} SELECT id AS row_id FROM core")
def dbscan_core_points(spark, folder):
    return grid.core_points(table(spark, folder, "customer"), ["c_acctbal", "c_nationkey"], EPS, MIN_SAMPLES, "c_custkey", True)


@query(f"""WITH RECURSIVE {_NEAR}, links AS (SELECT p, q FROM near WHERE p IN (SELECT id FROM core) AND q IN (SELECT id FROM core)),
    reach AS (SELECT id, id AS root FROM core UNION SELECT l.q, r.root FROM reach r JOIN links l ON l.p = r.id WHERE r.root < l.q),
    rooted AS (SELECT id, min(root) AS root FROM reach GROUP BY 1),
    numbered AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM rooted),
    border AS (SELECT n.p AS id, min(c.cluster) AS cluster FROM near n JOIN numbered c ON n.q = c.id GROUP BY 1)
    SELECT z.id AS row_id, coalesce('Cluster ' || CAST(coalesce(c.cluster, b.cluster) AS VARCHAR), 'Noise') AS label
    FROM z LEFT JOIN numbered c ON z.id = c.id LEFT JOIN border b ON z.id = b.id""")
def dbscan(spark, folder):
    return grid.dbscan_labels(table(spark, folder, "customer"), ["c_acctbal", "c_nationkey"], EPS, MIN_SAMPLES, "c_custkey", True)


WIDE, WIDE_EPS = 6, 0.14
_WIDE = f"""z AS (SELECT vec_id AS id, {", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(WIDE))} FROM embeddings),
    near AS (SELECT a.id AS p, b.id AS q FROM z a, z b
        WHERE {" + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(WIDE))} <= {WIDE_EPS * WIDE_EPS!r}::DOUBLE),
    core AS (SELECT p AS id FROM near GROUP BY p HAVING count(*) >= {MIN_SAMPLES})"""


@query(f"""WITH RECURSIVE {_WIDE}, links AS (SELECT p, q FROM near WHERE p IN (SELECT id FROM core) AND q IN (SELECT id FROM core)),
    reach AS (SELECT id, id AS root FROM core UNION SELECT l.q, r.root FROM reach r JOIN links l ON l.p = r.id WHERE r.root < l.q),
    rooted AS (SELECT id, min(root) AS root FROM reach GROUP BY 1),
    numbered AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM rooted),
    border AS (SELECT n.p AS id, min(c.cluster) AS cluster FROM near n JOIN numbered c ON n.q = c.id GROUP BY 1)
    SELECT z.id AS row_id, coalesce('Cluster ' || CAST(coalesce(c.cluster, b.cluster) AS VARCHAR), 'Noise') AS label
    FROM z LEFT JOIN numbered c ON z.id = c.id LEFT JOIN border b ON z.id = b.id""")
def dbscan_many_axes(spark, folder):
    """Clusters on the first six components of the embeddings."""
    axes = [f"x{i}" for i in range(WIDE)]
    rows = table(spark, folder, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(x) for i, x in enumerate(axes)])
    return grid.dbscan_labels(rows, axes, WIDE_EPS, MIN_SAMPLES, "vec_id")


@query()
def kmeans_labels(spark, folder):
    customers = table(spark, folder, "customer")
    return kmeans.kmeans(customers, ["c_acctbal", "c_nationkey"], 4, "c_custkey", standardize=True).table


def _spread_embeddings(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return vectors.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])


@query("SELECT count(*) AS n, CAST(10 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS misplaced FROM embeddings")
def kmeans_fixed_point(spark, folder):
    """Every vector sits with the nearest of the cluster means, and no cluster is empty."""
    spread = _spread_embeddings(spark, folder)
    axes = [f"e{i}" for i in range(64)]
    made = kmeans.kmeans(spread, axes, 10, "vec_id")
    means = made.table.groupBy("Cluster").agg(*[F.avg(a).alias(a) for a in axes]).collect()
    # one row per cluster: ten by construction
    import numpy as np

    names = [r["Cluster"] for r in means]
    centers = np.array([[r[a] for a in axes] for r in means])
    nearest = F.element_at(F.array(*map(F.lit, names)), kmeans.assign(made.table, [F.col(a) for a in axes], centers) + 1)
    return made.table.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("Cluster").alias("clusters"),
        F.count_if(nearest != F.col("Cluster")).alias("misplaced"))


_CENTERS = [(-1.0, -1.0), (0.0, 0.5), (1.0, 1.0)]


@query(f"""SELECT id AS c_custkey, CAST(list_position(d, list_min(d)) - 1 AS INTEGER) AS center FROM (SELECT id, [
    {', '.join(f'(x - {a}) * (x - {a}) + (y - {b}) * (y - {b})' for a, b in _CENTERS)}] AS d FROM ({_Z_CUSTOMER}))""")
def nearest_centers(spark, folder):
    import numpy as np

    from surveyloom.operators.missing import distance_views

    customers = table(spark, folder, "customer")
    views = distance_views(customers, ["c_acctbal", "c_nationkey"], standardize=True)
    return customers.select("c_custkey", kmeans.nearest_center(views, np.array(_CENTERS)).alias("center"))


_SQUARED = """s AS (SELECT *, max(CASE WHEN own = other THEN total / nullif(n - 1, 0) END) OVER (PARTITION BY p) AS a,
        min(CASE WHEN own <> other THEN total / n END) OVER (PARTITION BY p) AS b FROM d),
    o AS (SELECT p, any_value(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS s FROM s GROUP BY p)"""


@query(f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    x AS (SELECT vec_id, label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
    c AS (SELECT label, max(m) AS n, sum(q) AS q, list(s ORDER BY i) AS s
          FROM (SELECT label, i, sum(x) AS s, sum(x * x) AS q, count(*) AS m FROM x GROUP BY label, i) GROUP BY label),
    d AS (SELECT vec_id AS p, v.label AS own, c.label AS other, c.n AS n,
          c.n * list_inner_product(e, e) - 2 * list_inner_product(e, c.s) + c.q AS total FROM v, c),
    {_SQUARED} SELECT {sql_round('avg(s)')} AS squared_silhouette, count(*) AS n FROM o""")
def silhouette_given_labels(spark, folder):
    spread = _spread_embeddings(spark, folder)
    return diagnostics.silhouette_of(spread, [f"e{i}" for i in range(64)], "label", "vec_id").select(rounded("squared_silhouette"), "n")


# Two groups of balances far apart: the best two clusters are the best cut of the sorted values.
_TWO_GROUPS = "SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN c_acctbal / 10 ELSE c_acctbal / 10 + 5000 END AS x FROM customer"
_BEST_CUT = f"""g AS ({_TWO_GROUPS}), v AS (SELECT x, count(*) AS w FROM g GROUP BY x),
    r AS (SELECT x, sum(w) OVER up AS n, sum(w * x) OVER up AS s, sum(w * x * x) OVER up AS q, sum(w) OVER () AS m, sum(w * x) OVER () AS t,
          sum(w * x * x) OVER () AS z FROM v WINDOW up AS (ORDER BY x ROWS UNBOUNDED PRECEDING)),
    cut AS (SELECT x AS edge FROM r WHERE n < m ORDER BY q - s * s / n + (z - q) - (t - s) * (t - s) / (m - n), x LIMIT 1)"""


def _two_groups(spark, folder):
    return spark.sql(_TWO_GROUPS.replace("FROM customer", "FROM {c}"), c=table(spark, folder, "customer"))


@query(f"WITH {_BEST_CUT} SELECT c_custkey, CASE WHEN x <= edge THEN 'Cluster 0' ELSE 'Cluster 1' END AS \"Cluster\" FROM g, cut")
def kmeans_best_cut(spark, folder):
    """Labels of the two best clusters of one column, which SQL finds by prefix sums."""
    made = kmeans.kmeans(_two_groups(spark, folder), ["x"], 2, "c_custkey")
    return made.table.select("c_custkey", "Cluster")


@query(f"""WITH {_BEST_CUT}, y AS (SELECT c_custkey AS p, x, CASE WHEN x <= edge THEN 0 ELSE 1 END AS own FROM g, cut),
    c AS (SELECT own AS other, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM y GROUP BY own),
    d AS (SELECT p, own, other, n, n * x * x - 2 * x * s + q AS total FROM y, c),
    {_SQUARED} SELECT CAST(2 AS INTEGER) AS k, {sql_round('avg(s)')} AS squared_silhouette, count(*) AS n FROM o""")
def silhouette_by_k(spark, folder):
    by_k = diagnostics.silhouette_by_k(_two_groups(spark, folder), ["x"], 2, "c_custkey")
    return by_k.select("k", rounded("squared_silhouette"), "n")


# Six groups of customers, each ten times as far out as the one before: the best k clusters are the k - 1 outermost
# groups and the rest together, for every k up to six.
_SIX_GROUPS = """SELECT c_custkey, c_nationkey % 6 AS g, c_acctbal / 20000 + CASE c_nationkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 10
    WHEN 2 THEN 100 WHEN 3 THEN 1000 WHEN 4 THEN 10000 ELSE 100000 END AS x FROM customer"""


@query(f"""WITH y AS (SELECT k, c_custkey AS p, x, greatest(g, 6 - k) AS own FROM ({_SIX_GROUPS}), (SELECT unnest([2, 3, 4, 5, 6]) AS k)),
    c AS (SELECT k, own AS other, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM y GROUP BY k, own),
    d AS (SELECT k, p, own, other, n, n * x * x - 2 * x * s + q AS total FROM y JOIN c USING (k)),
    s AS (SELECT *, max(CASE WHEN own = other THEN total / nullif(n - 1, 0) END) OVER (PARTITION BY k, p) AS a,
        min(CASE WHEN own <> other THEN total / n END) OVER (PARTITION BY k, p) AS b FROM d),
    o AS (SELECT k, p, any_value(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS s FROM s GROUP BY k, p)
    SELECT CAST(k AS INTEGER) AS k, {sql_round('avg(s)')} AS squared_silhouette, count(*) AS n FROM o GROUP BY k""")
def silhouette_by_several_k(spark, folder):
    """Silhouettes of two to six clusters over all customers."""
    groups = spark.sql(_SIX_GROUPS.replace("FROM customer", "FROM {c}"), c=table(spark, folder, "customer"))
    by_k = diagnostics.silhouette_by_k(groups.select("c_custkey", "x"), ["x"], 6, "c_custkey")
    return by_k.select("k", rounded("squared_silhouette"), "n")


@query(f"""WITH y AS (SELECT c_custkey AS p, g, x, CAST(c_custkey % 10 AS DOUBLE) / 10 AS z FROM ({_SIX_GROUPS})),
    e AS (SELECT a.p, a.g, b.g AS h, sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z))) AS total, count(*) AS n
          FROM y a, y b GROUP BY a.p, a.g, b.g),
    t AS (SELECT k, p, greatest(g, 6 - k) AS own, greatest(h, 6 - k) AS other, sum(total) AS total, sum(n) AS n
          FROM e, (SELECT unnest([2, 3, 4, 5, 6]) AS k) GROUP BY 1, 2, 3, 4),
    s AS (SELECT k, p, max(CASE WHEN own = other THEN total / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> other THEN total / n END) AS b
          FROM t GROUP BY k, p)
    SELECT CAST(k AS INTEGER) AS k, {sql_round('avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END)')}
        AS silhouette, count(*) AS n FROM s GROUP BY k""")
def silhouette_euclidean_by_k(spark, folder):
    """Euclidean silhouettes of two to six clusters, over every pair of customers."""
    groups = spark.sql(_SIX_GROUPS.replace("FROM customer", "FROM {c}"), c=table(spark, folder, "customer"))
    groups = groups.withColumn("z", (F.col("c_custkey") % 10).cast("double") / 10)
    by_k = diagnostics.silhouette_by_k(groups.select("c_custkey", "x", "z"), ["x", "z"], 6, "c_custkey", euclidean=True)
    return by_k.select("k", rounded("silhouette"), "n")


@query(f"""WITH y AS (SELECT o_orderkey AS p, o_custkey AS own, o_totalprice / 1000 AS x, CAST(o_orderkey % 100 AS DOUBLE) AS z FROM orders),
    c AS (SELECT own AS other, count(*) AS n, sum(x) AS sx, sum(z) AS sz, sum(x * x + z * z) AS q FROM y GROUP BY own),
    s AS (SELECT p, max(CASE WHEN own = other THEN (n * (x * x + z * z) - 2 * (x * sx + z * sz) + q) / nullif(n - 1, 0) END) AS a,
        min(CASE WHEN own <> other THEN (n * (x * x + z * z) - 2 * (x * sx + z * sz) + q) / n END) AS b FROM y, c GROUP BY p)
    SELECT {sql_round('avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END)')}
        AS squared_silhouette, count(*) AS n FROM s""")
def silhouette_many_labels(spark, folder):
    """Orders labelled by customer: as many labels as there are customers."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", (F.col("o_totalprice") / 1000).alias("x"), (F.col("o_orderkey") % 100).cast("double").alias("z"))
    return diagnostics.silhouette_of(orders, ["x", "z"], "o_custkey", "o_orderkey").select(rounded("squared_silhouette"), "n")


@query(f"WITH {_BEST_CUT}, y AS (SELECT count(DISTINCT x <= edge) AS k FROM g, cut) SELECT CAST(k AS INTEGER) AS k FROM y")
def suggested_k(spark, folder):
    """Two groups far apart suggest two clusters."""
    by_k = diagnostics.silhouette_by_k(_two_groups(spark, folder), ["x"], 5, "c_custkey")
    return spark.createDataFrame([(diagnostics.suggest_k(by_k),)], "k int")


def _kdistance_sql(kth: int) -> str:
    at = lambda p: f"max(CASE WHEN rn = least(n - 1, CAST(floor({p} / 100::DOUBLE * n) AS BIGINT)) THEN d END)"
    shown = ", ".join(f"{sql_round(at(p))} AS p{p}" for p in diagnostics.PERCENTILES)
    return f"""WITH z AS ({_Z_CUSTOMER}), k AS (SELECT p, d FROM (SELECT a.id AS p, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d,
        row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS r
        FROM z a JOIN z b ON a.id <> b.id) WHERE r = {kth}),
    o AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS rn, count(*) OVER () AS n FROM k)
    SELECT count(*) AS n, CAST({kth} AS INTEGER) AS kth_neighbor, {shown}, {sql_round('max(d)')} AS max FROM o"""


@query(_kdistance_sql(4))
def k_distance(spark, folder):
    found = diagnostics.k_distance(table(spark, folder, "customer"), ["c_acctbal", "c_nationkey"], 5, "c_custkey", True)
    return found.select("n", "kth_neighbor", *[rounded(f"p{p}") for p in diagnostics.PERCENTILES], rounded("max"))


@query(f"SELECT * FROM orders WHERE o_totalprice IS NOT NULL ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-{sample.SAMPLE_SEED}'), o_orderkey LIMIT 2000")
def seeded_sample(spark, folder):
    return sample.seeded_sample(table(spark, folder, "orders"), ["o_totalprice"], "o_orderkey", 2000)


@query("SELECT event_id, user_id FROM events WHERE event_id % CAST(ceil((SELECT count(*) FROM events) / 4000) AS BIGINT) = 0")
def decimated(spark, folder):
    return sample.decimate(table(spark, folder, "events"), "event_id").select("event_id", "user_id")


@query(f"""SELECT component, variable, loading, CAST(rank AS INTEGER) AS rank FROM (
    SELECT component, variable, loading, row_number() OVER (PARTITION BY component ORDER BY abs(loading) DESC, variable) AS rank FROM (
      SELECT 'PC' || CAST(c AS VARCHAR) AS component, v AS variable, {sql_round("CASE WHEN c = 1 THEN 1 / sqrt(2) WHEN v = 'c_acctbal' THEN 1 / sqrt(2) ELSE -1 / sqrt(2) END * CASE WHEN v = 'c_nationkey' AND r < 0 THEN -1 ELSE 1 END", 3)} AS loading
      FROM (SELECT unnest([1, 2]) AS c), (SELECT unnest(['c_acctbal', 'c_nationkey']) AS v), (SELECT corr(c_acctbal, c_nationkey) AS r FROM customer)))""")
def top_loadings(spark, folder):
    run = pca.run_pca(table(spark, folder, "customer"), ["c_acctbal", "c_nationkey"], k=2)
    return pca.top_loadings(run.loadings).select("component", "variable", "loading", "rank")



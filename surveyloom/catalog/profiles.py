"""Profiles, defaults, number rule, missing cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.catalog.common import rounded, spread_table, sql_round, table
from surveyloom.functions.numeric import as_number
from surveyloom.operators import missing, profile
from surveyloom.operators.crosstab import category_index
from surveyloom.plans.ranking import midranks
from surveyloom.sources.cells import clean_cells, with_row_id

QUERIES = {}
CHECKS = {}


def query(check=None):
    def add(f):
        QUERIES[f.__name__] = f
        if check is not None:
            CHECKS[f.__name__] = check
        return f
    return add


def _scan_sql(source: str, columns: list[tuple[str, str]]) -> str:
    """One SELECT per column; the type is n (number), t (text) or d (date)."""
    parts = []
    for position, (name, kind) in enumerate(columns):
        number = f"CAST({name} AS DOUBLE)" if kind == "n" else (
            f"CASE WHEN regexp_matches(trim({name}), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') "
            f"THEN TRY_CAST(trim({name}) AS DOUBLE) END" if kind == "t" else "CAST(NULL AS DOUBLE)")
        cell = f"nullif(trim({name}), '')" if kind == "t" else name
        flag = {"n": f"bool_and({name} IN (0, 1))", "t": f"bool_and({cell} IN ('true', 'false'))",
                "d": "CAST(FALSE AS BOOLEAN)"}[kind]
        if kind == "n":
            label = f"CASE WHEN count(DISTINCT {cell}) > 20 THEN 'continuous' ELSE 'categorical' END"
        else:
            label = f"CASE WHEN count(DISTINCT {cell}) > 50 THEN 'too-many' ELSE 'categorical' END"
        parts.append(
            f"SELECT '{name}' AS \"column\", CAST({position} AS INTEGER) AS position, "
            f"count(*) - count({cell}) AS missing, min({number}) IS NOT NULL AS is_numeric, "
            f"min({number}) AS \"min\", max({number}) AS \"max\", count(DISTINCT {cell}) AS n_unique, "
            f"{label} AS kind, coalesce({flag}, FALSE) AS boolean_like FROM {source}")
    return " UNION ALL ".join(parts)


LINEITEM = [("l_orderkey", "n"), ("l_partkey", "n"), ("l_suppkey", "n"), ("l_linenumber", "n"), ("l_quantity", "n"),
            ("l_extendedprice", "n"), ("l_discount", "n"), ("l_tax", "n"), ("l_returnflag", "t"),
            ("l_linestatus", "t"), ("l_shipdate", "d")]
RATED = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def _rated(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.join(table(spark, folder, "labels"), "doc_id", "left")


@query(_scan_sql("lineitem", LINEITEM))
def column_scan(spark, folder):
    return profile.scan_columns(spread_table(spark, folder, "lineitem"))


@query(_scan_sql(RATED, [("doc_id", "n"), ("lang", "t"), ("source", "t"), ("n_chars", "n"), ("quality", "n"), ("toxic", "n")]))
def column_scan_gaps(spark, folder):
    return profile.scan_columns(_rated(spark, folder))


@query(
    "SELECT \"column\", kind, is_numeric FROM (" + _scan_sql("orders", [
        ("o_orderkey", "n"), ("o_custkey", "n"), ("o_orderstatus", "t"), ("o_totalprice", "n"), ("o_orderdate", "d"),
        ("o_orderpriority", "t")]) + ")")
def column_kinds(spark, folder):
    """Kinds from the sketch-first scan, exact wherever a limit is near."""
    return profile.scan_columns(table(spark, folder, "orders"), exact_distinct=False).select("column", "kind", "is_numeric")


def _profile_sql(source, columns):
    parts = []
    for i, c in enumerate(columns):
        at = lambda share: f"max(CASE WHEN pos = least(n - 1, CAST(floor({share} * n) AS BIGINT)) THEN v END)"
        shown = {"min": "min(v)", "max": "max(v)", "mean": "avg(v)", "sd": "stddev_pop(v)",
                 "q1": at(0.25), "median": at(0.5), "q3": at(0.75)}
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST({i} AS INTEGER) AS position, (SELECT count(*) - count({c}) FROM {source}) AS missing, "
            "count(*) AS n, " + ", ".join(f'{sql_round(e, 4)} AS "{k}"' for k, e in shown.items())
            + f" FROM (SELECT CAST({c} AS DOUBLE) AS v, row_number() OVER (ORDER BY {c}) - 1 AS pos, count(*) OVER () AS n "
            f"FROM {source} WHERE {c} IS NOT NULL)")
    return " UNION ALL ".join(parts)


@query(_profile_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def numeric_profile(spark, folder):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return profile.numeric_profile(table(spark, folder, "lineitem"), columns)


@query(_profile_sql(RATED, ["n_chars", "quality", "toxic"]))
def numeric_profile_gaps(spark, folder):
    return profile.numeric_profile(_rated(spark, folder), ["n_chars", "quality", "toxic"])


def _categorical_sql(source, columns):
    parts = []
    for c, identifier in columns:
        safe = "FALSE" if identifier else "n >= 5"
        parts.append(f"""
        SELECT '{c}' AS "column", s.missing, s.n_unique, s.withheld, t.rank, t.value, t.count FROM
        (SELECT (SELECT count(*) - count({c}) FROM {source}) AS missing, count(*) AS n_unique,
                count(*) FILTER (WHERE NOT ({safe})) AS withheld
         FROM (SELECT {c} AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1)) s
        LEFT JOIN (SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY n DESC, v) AS INTEGER) AS rank, v AS value, n AS count
                   FROM (SELECT {c} AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1) WHERE {safe})
                   WHERE rank <= 8) t ON TRUE""")
    return " UNION ALL ".join(parts)


@query(_categorical_sql("part", [("p_name", False), ("p_brand", False), ("p_type", False)]))
def categorical_profile(spark, folder):
    return profile.categorical_profile(table(spark, folder, "part"), ["p_name", "p_brand", "p_type"])


@query(_categorical_sql("(SELECT c_name, c_name AS customer_id, c_mktsegment AS segment_id FROM customer)",
                        [("c_name", False), ("customer_id", True), ("segment_id", True)]))
def categorical_profile_withheld(spark, folder):
    customers = table(spark, folder, "customer").select(
        "c_name", F.col("c_name").alias("customer_id"), F.col("c_mktsegment").alias("segment_id"))
    return profile.categorical_profile(customers, customers.columns)


_NUMBERS = "(SELECT CAST(o_custkey % 5 AS DOUBLE) / 2 AS half FROM orders)"


@query(_categorical_sql("(SELECT CASE WHEN half = floor(half) THEN CAST(CAST(half AS INTEGER) AS VARCHAR) ELSE CAST(half AS VARCHAR) END AS half "
                        f"FROM {_NUMBERS})", [("half", False)]))
def categorical_profile_numbers(spark, folder):
    """Numbers as category values are written plainly."""
    halves = table(spark, folder, "orders").select(((F.col("o_custkey") % 5).cast("double") / 2).alias("half"))
    return profile.categorical_profile(halves, ["half"])


def _histogram_sql(c):
    return f"""
    SELECT '{c}' AS "column", CAST(b.bin AS INTEGER) AS bin, coalesce(h.n, 0) AS n,
           coalesce(h.n, 0) / max(CAST(coalesce(h.n, 0) AS DOUBLE)) OVER () AS height
    FROM (SELECT range AS bin FROM range(14)) b LEFT JOIN (
      SELECT least(13, CAST(floor(({c} - lo) * (14 / (hi - lo))) AS INTEGER)) AS bin, count(*) AS n
      FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem) GROUP BY 1) h ON b.bin = h.bin"""


@query(" UNION ALL ".join(_histogram_sql(c) for c in ("l_extendedprice", "l_quantity", "l_tax")))
def histogram(spark, folder):
    return profile.histogram(table(spark, folder, "lineitem"), ["l_extendedprice", "l_quantity", "l_tax"])


@query("SELECT p_name AS value, count(*) AS n, count(*) / (SELECT count(*) FROM part) AS share FROM part "
       "GROUP BY 1 ORDER BY n DESC, value LIMIT 6")
def proportions(spark, folder):
    return profile.proportions(table(spark, folder, "part"), "p_name")


@query("SELECT DISTINCT o_orderpriority AS level FROM orders")
def shape_levels(spark, folder):
    return profile.shape_levels(table(spark, folder, "orders"), "o_orderpriority")


@query("""SELECT min(l_quantity) AS x_min, max(l_quantity) AS x_max, min(l_discount) AS y_min, max(l_discount) AS y_max,
    min(l_extendedprice) AS z_min, max(l_extendedprice) AS z_max,
    min(l_extendedprice) - (max(l_extendedprice) - min(l_extendedprice)) * 0.08::DOUBLE AS floor
    FROM lineitem WHERE l_returnflag NOT IN ('R')""")
def bounds(spark, folder):
    axes = ["l_quantity", "l_discount", "l_extendedprice"]
    return profile.bounds(table(spark, folder, "lineitem"), axes, color="l_returnflag", hidden=["R"])


@query("""SELECT top AS eps_max, greatest(0.001::DOUBLE, floor(top / 100 * 1000 + 0.5) / 1000) AS eps_step FROM (
    SELECT greatest(1.0::DOUBLE, floor(greatest(max(c_acctbal) - min(c_acctbal), max(c_nationkey) - min(c_nationkey)) / 2 + 0.5)) AS top
    FROM customer)""")
def eps_range(spark, folder):
    top, step = profile.eps_range(table(spark, folder, "customer"), ["c_acctbal", "c_nationkey"], standardize=False)
    return spark.createDataFrame([(top, step)], "eps_max double, eps_step double")


@query("""SELECT 'o_orderkey' AS x, 'o_custkey' AS y, 'o_totalprice' AS z,
    (SELECT name FROM (SELECT 'o_orderstatus' AS name, count(DISTINCT o_orderstatus) AS n, 2 AS pos FROM orders
       UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), 5 FROM orders
       UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice), 3 FROM orders)
     WHERE n BETWEEN 2 AND 20 ORDER BY n, pos LIMIT 1) AS color,
    (SELECT greatest(max(o_custkey) - min(o_custkey), max(o_totalprice) - min(o_totalprice))
          / least(max(o_custkey) - min(o_custkey), max(o_totalprice) - min(o_totalprice)) > 3 FROM orders) AS standardize""")
def view_defaults(spark, folder):
    orders = table(spark, folder, "orders")
    x, y, z = profile.default_axes(orders)
    row = (x, y, z, profile.default_color(orders), profile.suggest_standardize(orders, ["o_custkey", "o_totalprice"]))
    return spark.createDataFrame([row], "x string, y string, z string, color string, standardize boolean")


_FORMS = """
SELECT l_linenumber AS form, CASE l_linenumber
    WHEN 1 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR(20))
    WHEN 2 THEN concat(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR(20)), 'd')
    WHEN 3 THEN concat('  ', CAST(CAST(l_quantity AS INTEGER) AS VARCHAR(20)), ' ')
    WHEN 4 THEN concat('-.', CAST(CAST(l_quantity AS INTEGER) AS VARCHAR(20)))
    WHEN 5 THEN concat(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR(20)), '.e2')
    WHEN 6 THEN CASE WHEN l_returnflag = 'A' THEN 'inf' WHEN l_returnflag = 'N' THEN 'NaN' ELSE '1e999' END
    ELSE concat('1,', CAST(CAST(l_quantity AS INTEGER) AS VARCHAR(20))) END AS cell
FROM lineitem"""


@query(f"""SELECT form, count(*) AS n, count(v) AS numbers, {sql_round('sum(v)', 4)} AS total FROM (
    SELECT form, CASE WHEN regexp_matches(trim(cell), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')
      THEN CASE WHEN isinf(CAST(trim(cell) AS DOUBLE)) THEN NULL ELSE CAST(trim(cell) AS DOUBLE) END END AS v
    FROM ({_FORMS.replace("'1e999'", "'x1e9'")})) GROUP BY form""")
def number_rule(spark, folder):
    cells = spark.sql(_FORMS.replace("FROM lineitem", "FROM {l}"), l=table(spark, folder, "lineitem"))
    return cells.groupBy("form").agg(
        F.count(F.lit(1)).alias("n"), F.count(as_number(cells, "cell")).alias("numbers"),
        F.sum(as_number(cells, "cell")).alias("total")).select("form", "n", "numbers", rounded("total", 4))


@query("""SELECT CAST(event_id AS DOUBLE) AS event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS ts,
    CAST(user_id AS DOUBLE) AS user_id, nullif(trim(event_type), '') AS event_type, value, nullif(trim(props), '') AS props
    FROM events""")
def clean_cells_events(spark, folder):
    return clean_cells(table(spark, folder, "events"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_id FROM events")
def row_ids(spark, folder):
    events = table(spark, folder, "events").select("event_id", F.struct("ts", "event_id").alias("place"))
    return with_row_id(events, order="place").select("event_id", "row_id")


@query("SELECT l_extendedprice AS v, avg(rn) AS rank FROM (SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) AS rn "
       "FROM lineitem) GROUP BY 1")
def midrank(spark, folder):
    prices = table(spark, folder, "lineitem").select(F.col("l_extendedprice").alias("v"), F.lit(1).alias("n"))
    return midranks(prices, "v", "n")


@query("SELECT p_brand AS label, row_number() OVER (ORDER BY CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER)) - 1 AS index "
       "FROM (SELECT DISTINCT p_brand FROM part)")
def natural_category_index(spark, folder):
    return category_index(table(spark, folder, "part"), "p_brand")


def _missing_sql(source, columns):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({i} AS INTEGER) AS position, count(*) - count({e}) AS missing, count(*) AS rows, "
        f"(count(*) - count({e})) * 100.0::DOUBLE / count(*) AS percent, "
        f"(count(*) - count({e})) * 100.0::DOUBLE / count(*) > 50 AS mostly_missing FROM {source}"
        for i, (c, e) in enumerate(columns))


@query(_missing_sql(RATED, [("quality", "quality"), ("toxic", "toxic"), ("n_chars", "n_chars"), ("lang", "CAST(NULL AS DOUBLE)")]))
def missing_report(spark, folder):
    return missing.missing_report(_rated(spark, folder), ["quality", "toxic", "n_chars", "lang"])


@query(f"SELECT CAST(sum((quality IS NULL)::INT + (toxic IS NULL)::INT + (n_chars IS NULL)::INT) AS BIGINT) AS cells, "
       f"count(*) * 3 AS total FROM {RATED}")
def imputed_cells(spark, folder):
    return missing.imputed_cells(_rated(spark, folder), ["quality", "toxic", "n_chars"])


@query(f"SELECT lang, count(*) AS n FROM {RATED} WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1")
def complete_cases(spark, folder):
    return missing.complete_cases(_rated(spark, folder), ["quality", "toxic"]).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"))


# gaps written into the orders by formula; identical text on both sides
_GAPPED = ("SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, "
           "CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_custkey END AS cust FROM orders")


@query(f"""WITH g AS ({_GAPPED}) SELECT o_orderkey, coalesce(price, (SELECT median(price) FROM g)) AS price,
    coalesce(CAST(cust AS DOUBLE), (SELECT median(cust) FROM g)) AS cust FROM g""")
def median_impute(spark, folder):
    gapped = spark.sql(_GAPPED.replace("FROM orders", "FROM {o}"), o=table(spark, folder, "orders"))
    return missing.impute_median(gapped, ["price", "cust"])


@query(f"""WITH g AS ({_GAPPED}), m AS (SELECT avg(price) AS a, stddev_pop(price) AS s FROM g)
    SELECT o_orderkey, {sql_round('(price - a) / s')} AS price_z, CASE WHEN price IS NULL THEN NULL ELSE 0.0::DOUBLE END AS flat_z FROM g, m""")
def zscores(spark, folder):
    gapped = spark.sql(_GAPPED.replace("FROM orders", "FROM {o}"), o=table(spark, folder, "orders"))
    gapped = gapped.withColumn("flat", F.when(F.col("price").isNotNull(), F.lit(3.25)))
    return missing.zscore(gapped, ["price", "flat"]).select("o_orderkey", rounded("price_z"), "flat_z")

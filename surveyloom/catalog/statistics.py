"""Group comparison, correlation, codes, crosstabs, transfers."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.catalog.common import SURVEY, SURVEY_NUMBERS, rounded, sql_round, survey, table
from surveyloom.operators import codes, correlation, crosstab, groups, transfer
from surveyloom.operators.codes import CODE_CANDIDATES

QUERIES = {}
CHECKS = {}


def query(check=None):
    def add(f):
        QUERIES[f.__name__] = f
        if check is not None:
            CHECKS[f.__name__] = check
        return f
    return add


def _groups_sql(source, measure, group):
    return (f"SELECT {group} AS \"group\", count(*) AS n, {sql_round(f'avg({measure})')} AS mean, "
            f"{sql_round(f'CASE WHEN count(*) > 1 THEN stddev_samp({measure}) END')} AS sd FROM {source} "
            f"WHERE {measure} IS NOT NULL AND {group} IS NOT NULL GROUP BY 1")


def _effects_sql(source, measure, group):
    return f"""
    WITH v AS (SELECT CAST({measure} AS DOUBLE) AS v, {group} AS g FROM {source} WHERE {measure} IS NOT NULL AND {group} IS NOT NULL),
    o AS (SELECT count(*) AS n, avg(v) AS m, stddev_samp(v) AS sd, var_pop(v) * count(*) AS sst FROM v),
    s AS (SELECT g, count(*) AS n, avg(v) AS m FROM v GROUP BY g),
    b AS (SELECT sum(s.n * (s.m - o.m) * (s.m - o.m)) AS ssb, count(*) AS k, min(s.n) AS least,
                 count(*) FILTER (WHERE s.n = 1) AS single FROM s, o),
    e AS (SELECT *, CASE WHEN n > k THEN (sst - ssb) / (n - k) END AS msw FROM o, b)
    SELECT n, {sql_round('m')} AS mean, {sql_round('sd')} AS sd, {sql_round('ssb / sst')} AS eta_squared,
           {sql_round('(ssb - (k - 1) * msw) / (sst + msw)')} AS omega_squared, k AS n_groups, least AS min_group_n,
           single AS singleton_groups,
           CASE WHEN k >= n THEN 'identifier' WHEN k > n / 2 THEN 'too-fine' ELSE 'ok' END AS status FROM e"""


def _effects(comparison):
    return comparison.effects.select(
        "n", rounded("mean"), rounded("sd"), rounded("eta_squared"), rounded("omega_squared"),
        "n_groups", "min_group_n", "singleton_groups", "status")


@query(_groups_sql("orders", "o_totalprice", "o_orderpriority"))
def group_compare(spark, folder):
    stats = groups.compare_groups(table(spark, folder, "orders"), "o_totalprice", "o_orderpriority").groups
    return stats.select("group", "n", rounded("mean"), rounded("sd"))


@query(_effects_sql("orders", "o_totalprice", "o_orderpriority"))
def group_effects(spark, folder):
    return _effects(groups.compare_groups(table(spark, folder, "orders"), "o_totalprice", "o_orderpriority"))


@query(_effects_sql("supplier", "s_acctbal", "s_nationkey"))
def group_effects_small(spark, folder):
    return _effects(groups.compare_groups(table(spark, folder, "supplier"), "s_acctbal", "s_nationkey"))


@query(_effects_sql("customer", "c_acctbal", "c_name"))
def group_effects_identifier(spark, folder):
    return _effects(groups.compare_groups(table(spark, folder, "customer"), "c_acctbal", "c_name"))


def _spearman_sql(source, a, b):
    mid = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"
    return (f"SELECT count(*) AS n, {sql_round(f'corr(x, y)')} AS pearson, {sql_round('corr(rx, ry)')} AS spearman FROM ("
            f"SELECT x, y, {mid('x')} AS rx, {mid('y')} AS ry FROM (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y "
            f"FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL))")


@query(_spearman_sql("lineitem", "l_quantity", "l_extendedprice"))
def correlate(spark, folder):
    found = correlation.correlate(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice")
    return found.select("n", rounded("pearson"), rounded("spearman"))


@query(_spearman_sql("(SELECT d.n_chars, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)", "n_chars", "quality"))
def correlate_ties(spark, folder):
    rated = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return correlation.correlate(rated, "n_chars", "quality").select("n", rounded("pearson"), rounded("spearman"))


@query("SELECT count(*) AS n, CAST(NULL AS DOUBLE) AS pearson, CAST(NULL AS DOUBLE) AS spearman FROM customer")
def correlate_constant(spark, folder):
    customers = table(spark, folder, "customer").withColumn("one", F.lit(1.5))
    return correlation.correlate(customers, "c_acctbal", "one")


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {sql_round(f'corr({a}, {b})')} AS r FROM lineitem" for a in _MEASURES for b in _MEASURES))
def correlation_matrix(spark, folder):
    found = correlation.correlation_matrix(table(spark, folder, "lineitem"), _MEASURES)
    return found.select("a", "b", rounded("r"))


_UNPIVOT = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {i} AS position, p_partkey AS id, {e} AS x FROM survey" for i, (c, e) in enumerate(SURVEY_NUMBERS.items()))
_CANDIDATES = ", ".join(str(v) for v in CODE_CANDIDATES)
_DECLARED = (9.0, 50.0)


def _codes_sql() -> str:
    declared = ", ".join(str(v) for v in _DECLARED)
    return f"""
    WITH survey AS ({SURVEY}), cells AS (SELECT * FROM ({_UNPIVOT}) WHERE x IS NOT NULL),
    tally AS (SELECT "column", position, x, count(*) AS n, x IN ({_CANDIDATES}) AS candidate FROM cells GROUP BY 1, 2, 3),
    shape AS (SELECT "column", sum(n) AS numbers, sum(n) FILTER (WHERE NOT candidate) AS core_rows,
                     min(x) FILTER (WHERE NOT candidate) AS lo, max(x) FILTER (WHERE NOT candidate) AS hi,
                     bool_and(x = floor(x)) FILTER (WHERE NOT candidate) AS whole, count(*) FILTER (WHERE NOT candidate) AS levels
              FROM tally GROUP BY 1),
    judged AS (SELECT t.*, s.numbers, s.core_rows, hi - lo AS spread, greatest(lo - x, x - hi, 0) AS gap,
                      x < 0 AND lo >= 0 AS sign, whole AND levels <= 20 AND greatest(lo - x, x - hi, 0) >= 2 AS hole,
                      greatest(lo - x, x - hi, 0) > (hi - lo) * 0.5 AS far
               FROM tally t JOIN shape s USING ("column") WHERE candidate),
    findings AS (SELECT "column", position, x, n, sign, far, hole,
                        CASE WHEN sign OR (spread > 0 AND gap / spread >= 3) THEN 0 WHEN n / numbers >= 0.05 THEN 1 ELSE 2 END AS tier
                 FROM judged WHERE numbers >= 8 AND core_rows >= 2 AND (sign OR far OR hole)),
    interesting AS (SELECT DISTINCT x FROM findings UNION SELECT unnest([{declared}]::DOUBLE[])),
    held AS (SELECT c.*, count(*) OVER (PARTITION BY c.id, c.x) AS k FROM cells c JOIN interesting USING (x)),
    per AS (SELECT "column", x, count(*) AS n, CAST(sum(k - 1) AS BIGINT) AS observed FROM held GROUP BY 1, 2),
    totals AS (SELECT x, sum(n) AS total, count(*) AS held_by FROM per GROUP BY 1),
    evidence AS (SELECT *, observed >= 3 AND lift >= 3 AS supports FROM (
        SELECT p."column", x, held_by - 1 AS peers, observed, p.n * (total - p.n) / (SELECT count(*) FROM survey)::DOUBLE AS expected,
               CASE WHEN p.n * (total - p.n) > 0 THEN observed / (p.n * (total - p.n) / (SELECT count(*) FROM survey)::DOUBLE) ELSE 0 END AS lift
        FROM per p JOIN totals USING (x) WHERE held_by >= 2)),
    listed AS (SELECT "column", position, x, n, tier, sign, far, hole FROM findings
        UNION ALL SELECT "column", position, x, n, 3, FALSE, FALSE, FALSE FROM tally t
        WHERE x IN ({declared}) AND NOT EXISTS (SELECT 1 FROM findings f WHERE f."column" = t."column" AND f.x = t.x)),
    raised AS (SELECT l.*, e.peers, e.observed, e.expected, e.lift, e.supports,
                      CASE WHEN coalesce(supports, FALSE) AND tier < 3 THEN greatest(tier - 1, 0) ELSE tier END AS final
               FROM listed l LEFT JOIN evidence e ON l."column" = e."column" AND l.x = e.x)
    SELECT "column", CAST(position AS INTEGER) AS position, x AS value, n AS count,
           CASE final WHEN 0 THEN 'certain' WHEN 1 THEN 'likely' WHEN 2 THEN 'possible' END AS confidence,
           concat_ws(',', CASE WHEN sign THEN 'impossible-sign' END, CASE WHEN far THEN 'far-outside' END,
                     CASE WHEN hole THEN 'scale-hole' END, CASE WHEN coalesce(supports, FALSE) AND tier < 3 THEN 'co-occurs' END) AS reasons,
           peers, observed, {sql_round('expected')} AS expected, {sql_round('lift')} AS lift, supports,
           CASE WHEN final < 2 THEN TRUE WHEN final = 2 THEN FALSE ELSE coalesce(supports, FALSE) END AS suggested,
           CAST(row_number() OVER (ORDER BY best, position, x) AS INTEGER) AS place
    FROM (SELECT *, min(final) OVER (PARTITION BY "column") AS best FROM raised)"""


@query(_codes_sql())
def code_scan(spark, folder):
    scan = codes.scan_codes(survey(spark, folder), declared=_DECLARED)
    return scan.select("column", "position", "value", "count", "confidence", F.array_join("reasons", ",").alias("reasons"),
                       "peers", "observed", rounded("expected"), rounded("lift"), "supports", "suggested", "place")


@query(f"""WITH survey AS ({SURVEY}), cells AS (SELECT * FROM ({_UNPIVOT}) WHERE x IS NOT NULL) SELECT "column", x AS value, count(*) AS count FROM cells
    WHERE list_contains(list_transform(regexp_split_to_array('3, 9 -1', '[,\\s]+'), lambda c: CAST(c AS DOUBLE)), x) GROUP BY 1, 2""")
def declared_codes(spark, folder):
    """Codes typed as text are listed wherever they occur."""
    declared = codes.parse_codes("3, 9 -1, x")
    scan = codes.scan_codes(survey(spark, folder), declared=declared)
    return scan.filter(F.col("value").isin(declared)).select("column", "value", "count")


_PLAN = {"item_a": [9], "item_b": [9], "item_c": [99], "price": [-99], "item_text": [77], "absent": [1], "p_size": []}


def _effects_row(c, code):
    e, keep = SURVEY_NUMBERS[c], f"CASE WHEN {SURVEY_NUMBERS[c]} = {code} THEN NULL ELSE {SURVEY_NUMBERS[c]} END"
    return (f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {e} = {code}) AS replaced, count({e}) AS n_before, "
            f"count({keep}) AS n_after, {sql_round(f'avg({e})')} AS mean_before, {sql_round(f'avg({keep})')} AS mean_after, "
            f"{sql_round(f'stddev_samp({e})')} AS sd_before, {sql_round(f'stddev_samp({keep})')} AS sd_after, "
            f"TRUE AS untouched_identical FROM survey")


@query(f"WITH survey AS ({SURVEY}) " + " UNION ALL ".join(
    _effects_row(c, v[0]) for c, v in _PLAN.items() if v and c in SURVEY_NUMBERS))
def recode_effects(spark, folder):
    effects = codes.recode_effects(survey(spark, folder), _PLAN)
    return effects.select("column", "replaced", "n_before", "n_after", rounded("mean_before"), rounded("mean_after"),
                          rounded("sd_before"), rounded("sd_after"), "untouched_identical")


@query(f"""WITH survey AS ({SURVEY}) SELECT p_partkey, nullif(item_a, 9) AS item_a, nullif(item_b, 9) AS item_b,
    nullif(item_c, 99) AS item_c, item_d, CASE WHEN price = -99 THEN NULL ELSE CAST(price AS DOUBLE) END AS price,
    CASE WHEN trim(item_text) = '77' THEN NULL ELSE item_text END AS item_text, p_size, p_brand FROM survey""")
def recode_apply(spark, folder):
    return codes.apply_recode(survey(spark, folder), _PLAN)


_HOURS = "(SELECT event_type, CASE WHEN hour(ts) < 6 THEN 'Noise' ELSE 'Cluster ' || CAST(hour(ts) // 6 AS VARCHAR) END AS cluster, user_id FROM events)"


def _clustered_events(spark, folder):
    hour = F.hour("ts")
    part = F.floor(hour / 6).cast("string")
    return table(spark, folder, "events").select(
        "event_type", "user_id", F.when(hour < 6, "Noise").otherwise(F.concat(F.lit("Cluster "), part)).alias("cluster"))


@query(f"""SELECT cluster, event_type AS "group", count(*) AS n,
    CASE WHEN grouping(cluster) = 0 AND grouping(event_type) = 0 THEN 'cell' WHEN grouping(event_type) = 1 THEN 'cluster' ELSE 'group' END AS level
    FROM {_HOURS} GROUP BY GROUPING SETS ((cluster, event_type), (cluster), (event_type))""")
def cluster_crosstab(spark, folder):
    return crosstab.crosstab(_clustered_events(spark, folder), "cluster", "event_type")


def _composition_sql(row, column):
    return f"""WITH e AS {_HOURS}, c AS (SELECT {row} AS r, {column} AS c, count(*) AS n FROM e GROUP BY 1, 2),
    grid AS (SELECT r, c FROM (SELECT DISTINCT r FROM c), (SELECT DISTINCT c FROM c)),
    t AS (SELECT r, sum(n) AS total FROM c GROUP BY 1)
    SELECT r AS "row", c AS "column", coalesce(n, 0) AS n, coalesce(n, 0) * 100.0::DOUBLE / total AS percent
    FROM grid LEFT JOIN c USING (r, c) JOIN t USING (r)"""


@query(_composition_sql("cluster", "user_id"))
def composition_by_cluster(spark, folder):
    return crosstab.composition(_clustered_events(spark, folder), "cluster", "user_id").withColumn(
        "column", F.col("column").cast("bigint"))


@query(_composition_sql("event_type", "cluster"))
def composition_by_group(spark, folder):
    return crosstab.composition(_clustered_events(spark, folder), "cluster", "event_type", "group")


@query(f"SELECT cluster, count(*) AS n FROM {_HOURS} GROUP BY 1")
def cluster_sizes(spark, folder):
    return crosstab.cluster_sizes(_clustered_events(spark, folder), "cluster")


@query(f"""WITH c AS (SELECT cluster, CAST(user_id AS VARCHAR) AS g, count(*) AS n FROM {_HOURS} GROUP BY 1, 2),
    t AS (SELECT cluster, CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (WHERE n < 5) AS withheld FROM c GROUP BY 1),
    top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY n DESC, g) AS INTEGER) AS rank FROM c WHERE n >= 5) WHERE rank <= 6)
    SELECT t.cluster, total, withheld, rank, g AS "group", n, CAST(floor(n * 100.0::DOUBLE / total + 0.5) AS INTEGER) AS percent
    FROM t LEFT JOIN top USING (cluster)""")
def safe_breakdown(spark, folder):
    rated = _clustered_events(spark, folder).withColumnRenamed("user_id", "rater")
    return crosstab.safe_breakdown(rated, "cluster", "rater")


@query("SELECT c.c_custkey, c.c_nationkey, n.n_name AS nation FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_nationkey < 20")
def transfer_by_key(spark, folder):
    nations = table(spark, folder, "nation").filter("n_nationkey < 20").select(
        F.concat(F.lit(" "), F.col("n_nationkey").cast("string")).alias("c_nationkey"), "n_name")
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").cast("double"))
    moved = transfer.transfer_by_key(customers, nations, "n_name", "c_nationkey", "nation")
    return moved.withColumn("c_nationkey", F.col("c_nationkey").cast("int"))


@query("""SELECT c_custkey, arg_max(o_totalprice, o_orderkey) AS last_price FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def transfer_latest_duplicate(spark, folder):
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customers = table(spark, folder, "customer").select("c_custkey")
    return transfer.transfer_by_key(customers, orders, "o_totalprice", "c_custkey", "last_price", order="o_orderkey")


@query("SELECT o_orderkey, o_custkey, o_totalprice * 2 AS doubled FROM orders")
def transfer_by_order(spark, folder):
    orders = table(spark, folder, "orders")
    source = orders.select("o_orderkey", (F.col("o_totalprice") * 2).alias("twice"))
    return transfer.transfer_by_order(orders.select("o_orderkey", "o_custkey"), source, "twice", "o_orderkey", "doubled")


@query("""SELECT 'c_name' AS "column", count(*) FILTER (WHERE c_custkey % 12 <> 0) AS agree, count(*) AS total,
    CAST(floor(count(*) FILTER (WHERE c_custkey % 12 <> 0) * 100.0::DOUBLE / count(*) + 0.5) AS INTEGER) AS percent,
    floor(count(*) FILTER (WHERE c_custkey % 12 <> 0) * 100.0::DOUBLE / count(*) + 0.5) >= 90 AS accepted FROM customer""")
def alignment(spark, folder):
    customers = table(spark, folder, "customer")
    other = customers.withColumn("c_name", F.when(F.col("c_custkey") % 12 == 0, F.upper("c_name")).otherwise(F.col("c_name")))
    return transfer.alignment(other, customers, "c_custkey")


@query("""SELECT (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS matched,
    (SELECT count(*) FROM customer) AS total, (SELECT count(*) = count(DISTINCT o_custkey) FROM orders) AS source_unique""")
def match_stats(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return transfer.match_stats(table(spark, folder, "customer"), orders, "c_custkey")

"""CSV load and export, snapshots, search, views, event upkeep, streaming append."""

from __future__ import annotations


from pyspark.sql import functions as F

from surveyloom.catalog.common import spread_table, table
from surveyloom.operators import feedback, search, search_index, view
from surveyloom.plans.scratch import scratch_path
from surveyloom.sources import csv_export, csv_table, parquet_table, snapshots
from surveyloom.streaming.feedback import AppendSink, start_append

QUERIES = {}
CHECKS = {}


def query(check=None):
    def add(f):
        QUERIES[f.__name__] = f
        if check is not None:
            CHECKS[f.__name__] = check
        return f
    return add


@query("""SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name, CAST(c_nationkey AS DOUBLE) AS c_nationkey, c_acctbal,
    c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || ', "' || c_name || '"' END AS note FROM customer""")
def csv_round_trip(spark, folder):
    """Export and load again: quotes, delimiters and blanks survive, numbers are typed."""
    note = F.concat("c_mktsegment", F.lit(', "'), "c_name", F.lit('"'))
    customers = table(spark, folder, "customer").withColumn("note", F.when(F.col("c_custkey") % 3 == 0, note))
    path = scratch_path(spark, "export")
    csv_export.write_csv(customers, path)
    return csv_table.read_csv(spark, path).table


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '''=' || event_type WHEN 1 THEN '-' || CAST(CAST(floor(value) AS INTEGER) AS VARCHAR)
    WHEN 2 THEN '''+' || event_type WHEN 3 THEN '''@x' WHEN 4 THEN event_type ELSE '''-' || event_type END AS cell FROM events""")
def csv_formula_guard(spark, folder):
    kind = F.col("event_id") % 6
    cell = (
        F.when(kind == 0, F.concat(F.lit("="), "event_type")).when(kind == 1, F.concat(F.lit("-"), F.floor("value").cast("string")))
        .when(kind == 2, F.concat(F.lit("+"), "event_type")).when(kind == 3, "@x").when(kind == 4, F.col("event_type"))
        .otherwise(F.concat(F.lit("-"), "event_type"))
    )
    cells = table(spark, folder, "events").select("event_id", cell.alias("cell"))
    return csv_export.export_view(cells).select(F.col("event_id").cast("bigint").alias("event_id"), "cell")


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+\\-@\\t\\r]') AND NOT regexp_matches(trim(text), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')
    THEN '''' || text ELSE text END AS text FROM documents""")
def csv_guard_documents(spark, folder):
    guarded = csv_export.guarded(F.col("text")).alias("text")
    return table(spark, folder, "documents").select("doc_id", guarded)


_FILES = 4


def _text_files(lines, head, tag):
    """Lines (o_orderkey, value) written in order as several files, each beginning with ``head``."""
    spark = lines.sparkSession
    rows = lines.select((F.col("o_orderkey") % _FILES).cast("int").alias("part"), "o_orderkey", "value")
    heads = spark.createDataFrame([(i, -1, head) for i in range(_FILES)], "part int, o_orderkey bigint, value string")
    path = scratch_path(spark, tag)
    heads.unionByName(rows).repartition("part").sortWithinPartitions("part", "o_orderkey").drop("o_orderkey").write.partitionBy("part").text(path)
    return path


_NUMBERED = "SELECT *, row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) + 1 AS number FROM orders"


@query(f"""SELECT kind, count(*) AS n, list(number ORDER BY o_orderkey % 4, number)[1:3] AS sample_lines
    FROM (SELECT *, CASE WHEN o_orderkey % 50 = 7 THEN 'too-many-cells' WHEN o_orderkey % 70 = 9 THEN 'too-few-cells' END AS kind FROM ({_NUMBERED}))
    WHERE kind IS NOT NULL GROUP BY kind UNION ALL SELECT 'repeated-header', 1, NULL FROM region HAVING count(*) > 0""")
def csv_audit(spark, folder):
    """Ragged lines of written files are counted and located."""
    cells = [F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus")]
    line = (
        F.when(F.col("o_orderkey") % 50 == 7, F.concat_ws(",", *cells, F.lit("extra")))
        .when(F.col("o_orderkey") % 70 == 9, F.concat_ws(",", *cells[:2])).otherwise(F.concat_ws(",", *cells))
    )
    path = _text_files(table(spark, folder, "orders").select("o_orderkey", line.alias("value")), "key,cust,cust", "ragged")
    return csv_table.read_csv(spark, path).audit.select("kind", "n", "sample_lines")


@query(f"""SELECT 'blank-header' AS kind, CAST(1 AS BIGINT) AS n, CAST(NULL AS BIGINT[]) AS sample_lines, NULL AS columns FROM region HAVING count(*) > 0
    UNION ALL SELECT 'repeated-header', 2, NULL, 'cust_1,cust_2' FROM region HAVING count(*) > 0
    UNION ALL SELECT 'open-quote', count(*), list(number ORDER BY o_orderkey % 4, number)[1:3], NULL
      FROM ({_NUMBERED}) WHERE o_orderkey % 45 = 1 HAVING count(*) > 0""")
def csv_header_audit(spark, folder):
    """A blank header, repeated headers, and lines that leave a quotation mark open."""
    key = F.col("o_orderkey").cast("string")
    status = F.when(F.col("o_orderkey") % 45 == 1, F.concat(F.lit('"'), "o_orderstatus")).otherwise(F.col("o_orderstatus"))
    lines = table(spark, folder, "orders").select("o_orderkey", F.concat_ws(",", key, status, key, key).alias("value"))
    path = _text_files(lines, "cust,,cust,cust", "headers")
    found = csv_table.read_csv(spark, path, delimiter=",").audit.filter("kind in ('blank-header', 'repeated-header', 'open-quote')")
    return found.select("kind", "n", "sample_lines", F.array_join("columns", ",").alias("columns"))


@query("""SELECT 'plain' AS file, 'no-delimiter' AS kind, CAST(1 AS BIGINT) AS n, 'entry' AS columns, count(*) AS records FROM orders HAVING count(*) > 0
    UNION ALL SELECT 'numbers', 'headerless', 3, '1,2.5,-3', count(*) FROM orders HAVING count(*) > 0
    UNION ALL SELECT 'binary', 'unreadable-header', 1, 'cu' || chr(1) || 'st', count(*) FROM orders HAVING count(*) > 0""")
def csv_odd_headers(spark, folder):
    """Files without a delimiter, with numbers where names belong, and with a control character in a name; their rows load."""
    orders = table(spark, folder, "orders")
    key, cust, status = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    files = {"plain": ("entry", F.concat(status, key)), "numbers": ("1,2.5,-3", F.concat_ws(",", key, cust, status)),
             "binary": ("key,cu\x01st,status", F.concat_ws(",", key, cust, status))}
    found = None
    for tag, (head, line) in files.items():
        loaded = csv_table.read_csv(spark, _text_files(orders.select("o_orderkey", line.alias("value")), head, tag))
        heads = loaded.audit.filter("kind in ('no-delimiter', 'headerless', 'unreadable-header')")
        part = heads.select(F.lit(tag).alias("file"), "kind", "n", F.array_join("columns", ",").alias("columns"),
                            F.lit(loaded.table.count()).cast("bigint").alias("records"))
        found = part if found is None else found.unionByName(part)
    return found


_BROKEN = """SELECT *, row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) + 1 AS number,
    CASE WHEN o_orderkey % 50 = 7 THEN 'too-few-cells' WHEN o_orderkey % 70 = 9 THEN 'too-many-cells' END AS kind FROM orders"""


def _broken_lines(spark, folder):
    """Orders written as text files with a header each, with line breaks, marks and delimiters in quoted cells."""
    key = F.col("o_orderkey").cast("string")
    cell = F.concat(F.lit('"'), "o_orderstatus", F.lit('\n""second"", line"'))
    line = (F.when(F.col("o_orderkey") % 50 == 7, F.concat_ws(",", key, cell))
            .when(F.col("o_orderkey") % 70 == 9, F.concat_ws(",", key, cell, "o_orderpriority", F.lit("extra")))
            .otherwise(F.concat_ws(",", key, cell, "o_orderpriority")))
    return _text_files(table(spark, folder, "orders").select("o_orderkey", line.alias("value")), "key,status,priority", "breaks")


@query(f"""SELECT kind, count(*) AS n, list(number ORDER BY o_orderkey % 4, number)[1:3] AS sample_lines
    FROM ({_BROKEN}) WHERE kind IS NOT NULL GROUP BY kind""")
def csv_multi_line_audit(spark, folder):
    """Quoted line breaks are sound when records are read whole; short and long records are still found."""
    audit = csv_table.read_csv(spark, _broken_lines(spark, folder), delimiter=",", multi_line=True).audit
    return audit.select("kind", "n", "sample_lines")


@query(f"""SELECT CAST(o_orderkey AS DOUBLE) AS "key", o_orderstatus || chr(10) || '"second", line' AS status,
    CASE WHEN kind = 'too-few-cells' THEN NULL ELSE o_orderpriority END AS priority FROM ({_BROKEN})""")
def csv_multi_line_rows(spark, folder):
    """Cells with line breaks, marks and delimiters as they were written."""
    return csv_table.read_csv(spark, _broken_lines(spark, folder), delimiter=",", multi_line=True).table


@query("SELECT 'dates-as-text' AS kind, 1::BIGINT AS n, 'o_orderdate' AS columns FROM orders HAVING count(*) > 0 "
       "UNION ALL SELECT 'no-rows', 0::BIGINT, NULL FROM orders HAVING count(*) = 0")
def parquet_audit(spark, folder):
    _, audit = parquet_table.read_parquet(spark, f"{folder}/orders.parquet")
    return audit.select("kind", "n", F.array_join("columns", ",").alias("columns"))


@query("""SELECT 'grouped' AS "column", 'thousands separators' AS format, 1.0::DOUBLE AS share FROM lineitem HAVING count(*) > 0
    UNION ALL SELECT 'comma', 'decimal commas', 1.0::DOUBLE FROM lineitem HAVING count(*) > 0
    UNION ALL SELECT 'percent', 'percent signs', avg(CASE WHEN l_linenumber = 7 THEN 0.0 ELSE 1.0 END::DOUBLE) FROM lineitem""")
def numeric_text(spark, folder):
    lineitem = spread_table(spark, folder, "lineitem")
    texts = lineitem.select(
        F.concat((F.col("l_linenumber")).cast("string"), F.lit(","), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0")).alias("grouped"),
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(",5")).alias("comma"),
        F.when(F.col("l_linenumber") == 7, "none").otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" %"))).alias("percent"),
        F.col("l_quantity").cast("string").alias("plain"), "l_returnflag",
    )
    return csv_table.numeric_text(texts)


@query("""SELECT l_linenumber, CAST(sum(l_linenumber * 1000 + l_partkey % 1000) AS DOUBLE) AS total FROM lineitem GROUP BY 1""")
def parsed_numeric_text(spark, folder):
    lineitem = spread_table(spark, folder, "lineitem").select(
        "l_linenumber",
        F.concat((F.col("l_linenumber")).cast("string"), F.lit(","), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0")).alias("grouped"))
    parsed = csv_table.parse_numeric_text(lineitem, "grouped", "thousands separators")
    return parsed.groupBy("l_linenumber").agg(F.sum("grouped").alias("total"))


@query("SELECT 'first' AS dataset, c_custkey, c_acctbal FROM customer UNION ALL SELECT 'second', c_custkey, c_acctbal FROM customer")
def snapshot_round_trip(spark, folder):
    customers = table(spark, folder, "customer")
    root = scratch_path(spark, "snapshots")
    snapshots.save_snapshot(spark, root, "survey", {"first": customers, "second": customers}, settings={"color": "c_mktsegment"})
    datasets, _, _ = snapshots.load_snapshot(spark, root, "survey")
    picked = [d.select(F.lit(n).alias("dataset"), "c_custkey", "c_acctbal") for n, d in datasets.items()]
    return picked[0].unionByName(picked[1])


@query("SELECT 'newer' AS name, CAST(1 AS INTEGER) AS n_tables, count(*) AS total_rows FROM orders UNION ALL "
       "SELECT 'older', CAST(2 AS INTEGER), (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer)")
def snapshot_list(spark, folder):
    root = scratch_path(spark, "snapshots")
    nation, customers, orders = (table(spark, folder, n) for n in ("nation", "customer", "orders"))
    snapshots.save_snapshot(spark, root, "older", {"a": nation, "b": customers}, views={"pin": nation})
    snapshots.save_snapshot(spark, root, "newer", {"a": orders})
    return snapshots.list_snapshots(spark, root).select("name", "n_tables", "total_rows")


@query("SELECT o_orderkey, o_totalprice, o_orderdate, CAST(1 AS INTEGER) AS n_stored FROM orders")
def snapshot_shared_tables(spark, folder):
    """The same orders, dealt out otherwise, saved under two names: stored once, and kept when one name goes."""
    orders, root = table(spark, folder, "orders"), scratch_path(spark, "snapshots")
    snapshots.save_snapshot(spark, root, "first", {"orders": orders})
    snapshots.save_snapshot(spark, root, "second", {"mixed": orders.repartition(7, "o_custkey")})
    parts = {snapshots.read_manifest(spark, root, n)["tables"]["t0"]["part"] for n in ("first", "second")}
    snapshots.delete_snapshot(spark, root, "first")
    kept = snapshots.load_snapshot(spark, root, "second")[0]["mixed"]
    return kept.select("o_orderkey", "o_totalprice", "o_orderdate", F.lit(len(parts)).alias("n_stored"))


def _search_sql(source, text, order, query_text):
    score = " + ".join(f"CAST(contains(lower({text}), '{t}') AS INTEGER)" for t in search.search_terms(query_text))
    return f"SELECT {order}, score FROM (SELECT {order}, {score} AS score FROM {source}) WHERE score > 0 ORDER BY score DESC, {order} LIMIT 3"


@query(_search_sql("documents", "lang || ' ' || source || ' ' || text", "doc_id", "Eauouon, rest and the of onnthe!"))
def search_documents(spark, folder):
    hits = search.search(table(spark, folder, "documents"), "Eauouon, rest and the of onnthe!", ["lang", "source", "text"], "doc_id")
    return hits.select("doc_id", "score")


@query(_search_sql("documents", "lang || ' ' || source || ' ' || text", "doc_id", "Eauouon, rest and the of onnthe!"))
def search_documents_indexed(spark, folder):
    """The same three hits by way of a stored trigram index."""
    index = search_index.build_index(
        table(spark, folder, "documents"), scratch_path(spark, "search-index"), ["lang", "source", "text"], "doc_id", buckets=16)
    return index.search("Eauouon, rest and the of onnthe!").select("doc_id", "score")


@query(_search_sql("benchmark", "text", "item_id", "eroundth onen whou lytion"))
def search_benchmark(spark, folder):
    return search.search(table(spark, folder, "benchmark"), "eroundth onen whou lytion", ["text"], "item_id").select("item_id", "score")


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error', 'view')")
def visible_rows(spark, folder):
    return view.visible_rows(table(spark, folder, "events"), "event_type", ["error", "view"]).select("event_id", "event_type")


_X, _Y = (0.0, 200.0), (0.0, 100.0)


@query("SELECT event_id FROM events WHERE value BETWEEN 100.0 AND 200.0 AND user_id BETWEEN 25 AND 75")
def viewport(spark, folder):
    x, y = view.zoomed(_X, 2.0), view.zoomed(_Y, 2.0)
    x, y = view.panned(x, y, "right", 0.5)
    return view.viewport(table(spark, folder, "events"), "value", "user_id", x, y).select("event_id")


@query("""WITH c AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS i FROM (SELECT DISTINCT event_type FROM events))
    SELECT event_id, value AS x, CAST(user_id AS DOUBLE) AS y, 0.0::DOUBLE AS z, e.event_type AS color, i AS color_index, i % 10 AS palette
    FROM events e JOIN c USING (event_type)""")
def view_rows(spark, folder):
    rows = view.view_rows(table(spark, folder, "events"), ["value", "user_id"], "event_type", keep=["event_id"])
    return rows.select("event_id", "x", "y", "z", "color", "color_index", "palette")


@query("""WITH c AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS i FROM (SELECT DISTINCT o_orderpriority FROM orders)),
    s AS (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) - 1 AS j FROM (SELECT DISTINCT o_orderstatus FROM orders))
    SELECT i AS color_index, j AS shape_index, o_orderpriority AS color, o_orderstatus AS shape, count(*) AS n
    FROM orders JOIN c USING (o_orderpriority) JOIN s USING (o_orderstatus) GROUP BY ALL""")
def view_traces(spark, folder):
    orders = table(spark, folder, "orders")
    return view.traces(view.view_rows(orders, ["o_totalprice", "o_custkey"], "o_orderpriority", shape="o_orderstatus"))


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def latest_per_event(spark, folder):
    return feedback.latest_per_event(table(spark, folder, "conversations"), "conv_id", "turn")


# events as feedback records: users rate, some rows predate the client key
_RECORDS = """SELECT event_id AS row_id, CASE WHEN user_id % 37 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR(20)) END AS event_id,
    event_type AS rating, CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'slow' END AS reason,
    CASE WHEN event_id % 3 = 0 THEN 'hello' END AS user_message,
    CASE WHEN event_id % 5 = 0 THEN concat('k', CAST(event_id % 400 AS VARCHAR(20))) END AS client_key, ts AS created_at FROM events"""


def _records(spark, folder):
    return spark.sql(_RECORDS.replace("FROM events", "FROM {e}"), e=table(spark, folder, "events"))


@query(f"""SELECT DISTINCT event_id, rating, why AS reason, copies, first_seen, last_seen FROM (
    SELECT event_id, rating, why, count(*) OVER same AS copies, min(created_at) OVER same AS first_seen, max(created_at) OVER same AS last_seen
    FROM (SELECT *, coalesce(reason, '') AS why FROM ({_RECORDS})) WINDOW same AS (PARTITION BY event_id, rating, why)) WHERE copies > 1""")
def feedback_copies(spark, folder):
    return feedback.copies(_records(spark, folder))


@query(f"""SELECT * EXCLUDE (place) FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id, rating, coalesce(reason, ''), coalesce(user_message, '') ORDER BY row_id) AS place
    FROM ({_RECORDS})) WHERE client_key IS NOT NULL OR event_id IS NULL OR rating IS NULL OR place = 1""")
def feedback_without_copies(spark, folder):
    return feedback.without_copies(_records(spark, folder), "row_id")


def _appended(spark, folder):
    """Deliver the records twice, the second time late, through the streaming append."""
    records = _records(spark, folder)
    inbox, base = scratch_path(spark, "inbox"), scratch_path(spark, "append")
    records.write.parquet(inbox)
    sink = AppendSink(f"{base}/table", f"{base}/quarantine", f"{base}/checkpoint", source_app="survey")
    valid = F.col("event_id").isNotNull() & (F.col("rating") != "error")

    def deliver():
        stream = spark.readStream.schema(records.schema).parquet(inbox)
        start_append(stream, sink, valid).awaitTermination()

    deliver()
    records.filter("client_key is not null").write.mode("append").parquet(inbox)
    deliver()
    return sink


_VALID = f"(SELECT * FROM ({_RECORDS}) WHERE event_id IS NOT NULL AND rating <> 'error')"


@query(f"""SELECT client_key, 1 AS rows, 'survey' AS source_app FROM {_VALID} WHERE client_key IS NOT NULL GROUP BY 1
    UNION ALL SELECT NULL, count(*), 'survey' FROM {_VALID} WHERE client_key IS NULL""")
def stream_append(spark, folder):
    sink = _appended(spark, folder)
    return spark.read.parquet(sink.table).groupBy("client_key").agg(
        F.count(F.lit(1)).alias("rows"), F.min("source_app").alias("source_app"))


@query(f"""SELECT client_key, count(*) * 2 AS attempts, count(*) * 2 >= 5 AS dropped FROM ({_RECORDS})
    WHERE (event_id IS NULL OR rating = 'error') AND client_key IS NOT NULL GROUP BY 1
    UNION ALL SELECT NULL, 1, FALSE FROM ({_RECORDS}) WHERE (event_id IS NULL OR rating = 'error') AND client_key IS NULL HAVING count(*) > 0""")
def stream_quarantine(spark, folder):
    sink = _appended(spark, folder)
    return spark.read.parquet(sink.quarantine).groupBy("client_key").agg(
        F.max("attempts").alias("attempts"), F.bool_or("dropped").alias("dropped"))



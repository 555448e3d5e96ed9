"""Queries over the test tables, each with the same thing in SQL."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice import catalog, ingest, keys, pipes, policy, settings
from sluice.engine import Engine
from sluice.functions import canonical, render, timestamps
from sluice.operators import filters
from sluice.operators.aggregates import col
from sluice.plans import ast
from sluice.sources import eventlog, readers
from sluice.streaming import fanout
from sluice.types import parse

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
NOW = datetime(2024, 1, 31, tzinfo=UTC)
CATALOGS: dict[tuple, catalog.Catalog] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

POLICY = policy.Policy(
    {
        "events": {
            "viewer": {"select": policy.Select(deny=("props",), filter={"user_id": {"_in": "{{ jwt.users }}"}}, deny_aggregations=("quantile", "median"), caps={"max_rows": 1000})},
            "narrow": {"select": policy.Select(allow=("event_id", "event_type"), caps={"max_rows": 7})},
            "eq": {"select": policy.Select(filter={"event_type": {"_eq": "{{ jwt.type }}"}})},
            "neq": {"select": policy.Select(filter={"event_type": {"_neq": "click"}})},
            "gt": {"select": policy.Select(filter={"value": {"_gt": "100.5"}})},
            "lt": {"select": policy.Select(filter={"user_id": {"_lt": "{{ jwt.top }}"}})},
            "stamper": {"insert": policy.Insert(check={"source": {"_eq": "{{ jwt.type }}"}})},
            "writer": {"insert": policy.Insert(allow=("event_id", "ts", "user_id", "event_type", "value"), check={"user_id": {"_eq": "{{ jwt.user }}"}, "event_type": {"_in": ["click", "view", "purchase"]}})},
        }
    }
)
CLAIMS = {"users": [1, 2, 3, 50], "type": "purchase", "top": 20, "user": 7}
PIPES = {
    p.name: p
    for p in (
        pipes.Pipe("by_type", "SELECT event_id, value FROM events WHERE event_type = {{type}} AND value > {{least:100}}", (pipes.Parameter("type", required=True),), allowed_roles=("viewer",)),
        pipes.Pipe("types", "SELECT event_type, count() AS n FROM events WHERE event_type IN {{types}} GROUP BY event_type", (pipes.Parameter("types", "array"),), allowed_roles=("viewer",)),
        pipes.Pipe("mine", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN {{ jwt.users }} GROUP BY o_custkey", allowed_roles=("viewer",)),
        pipes.Pipe("above", "SELECT event_id FROM events WHERE value * 10000 > {{least}}", (pipes.Parameter("least", "number"),), allowed_roles=("viewer",)),
        pipes.Pipe("dialect", "SELECT event_id, has(array('click', 'view'), event_type) AS seen, cast(toDate(ts) AS string) AS day, timezone() AS zone FROM events WHERE ts < now64(3)", allowed_roles=("viewer",)),
        pipes.Pipe("days", "SELECT cast(to_date(ts) AS string) AS day, count(*) AS n, uniqExact(user_id) AS users FROM events WHERE value >= {{least:0}} GROUP BY to_date(ts)", allowed_roles=("viewer",)),
    )
}


def engine(spark: SparkSession, sf: str) -> Engine:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    key = (spark.sparkContext.applicationId, sf)
    if key not in CATALOGS:
        CATALOGS[key] = catalog.parquet_catalog(spark, sf, TABLES)
    return Engine(spark, CATALOGS[key], settings.Settings(POLICY, PIPES, {"query": {"default_max_rows": 10_000_000}}), clock=lambda: NOW)


def add(name: str, oracle: str | None, run: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(col(f.name), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else col(f.name) for f in df.schema))


def asked(name: str, table: str, query: dict, oracle: str | None, role: str = "admin", claims: dict | None = None) -> None:
    """A structured query."""
    add(name, oracle, lambda spark, sf: rounded(engine(spark, sf).plan(table, query, role, CLAIMS if claims is None else claims)))


def said(name: str, spark_sql: str, oracle: str | None = None) -> None:
    """Raw SQL."""
    add(name, oracle or spark_sql, lambda spark, sf: rounded(engine(spark, sf).raw_sql(spark_sql, "admin")))


# --- scans, projection, rendering ---
asked("scan_select", "nation", {"columns": ["n_name", "n_regionkey"]}, "SELECT n_name, n_regionkey FROM nation")
asked("scan_one_column", "region", {"columns": "r_name"}, "SELECT r_name FROM region")
asked("select_all", "customer", {"select_all": True}, "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 4) AS c_acctbal, c_mktsegment FROM customer")
add("select_star_named", "SELECT n_nationkey AS \"*\", n_name AS \"a.b\" FROM nation", lambda spark, sf: _odd_names(spark, sf))
add("render_rfc3339", "SELECT event_id, regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z' AS ts FROM events", lambda spark, sf: render.rendered(engine(spark, sf).plan("events", {"columns": ["event_id", "ts"]}, "admin")))


def _odd_names(spark: SparkSession, sf: str) -> DataFrame:
    load = lambda: spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("*"), F.col("n_name").alias("a.b"))
    return Engine(spark, catalog.Catalog(lambda: [catalog.discovered("odd", load)]), settings.Settings(POLICY)).plan("odd", {"columns": ["*", "a.b"]}, "admin")


# --- filters ---
for op, sql, value, shown in (("eq", "=", 60, "60"), ("neq", "<>", 60, "60"), ("gt", ">", 100, "100"), ("gte", ">=", "100", "100"), ("lt", "<", 12, "12"), ("lte", "<=", 12, "12")):
    asked(f"filter_{op}", "events", {"columns": ["event_id"], "filters": [{"column": "user_id", "op": op, "value": value}]}, f"SELECT event_id FROM events WHERE user_id {sql} {shown}")
asked("filter_like", "customer", {"columns": ["c_custkey"], "filters": [{"column": "c_name", "op": "LIKE", "value": "%00%1_"}]}, "SELECT c_custkey FROM customer WHERE c_name LIKE '%00%1_'")
asked("filter_in", "events", {"columns": ["event_id"], "filters": [{"column": "event_type", "op": "in", "value": ["click", "error"]}]}, "SELECT event_id FROM events WHERE event_type IN ('click', 'error')")
asked("filter_conj", "events", {"columns": ["event_id", "value"], "filters": [{"column": "event_type", "op": "neq", "value": "view"}, {"column": "value", "op": "gt", "value": 50.5}, {"column": "user_id", "op": "lte", "value": 99}]}, "SELECT event_id, round(value, 4) AS value FROM events WHERE event_type <> 'view' AND value > 50.5 AND user_id <= 99")
asked("filter_rfc3339", "events", {"columns": ["event_id"], "filters": [{"column": "ts", "op": "gte", "value": "2024-01-15T02:00:00+02:00"}]}, "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
add("filter_client", "SELECT event_id FROM events WHERE lower(event_type) LIKE '%ick' AND value > 20", lambda spark, sf: spark.read.parquet(f"{sf}/events.parquet").filter(filters.client_filter("event_type", "like", "%ICK") & filters.client_filter("value", "gt", 20)).select("event_id"))
asked("time_range_since", "events", {"columns": ["event_id"], "time_range": {"column": "ts", "since": "2024-01-20T00:00:00Z"}}, "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
asked("time_range_until", "events", {"columns": ["event_id"], "time_range": {"column": "ts", "since": "2024-01-10T00:00:00Z", "until": "2024-01-12T12:00:00Z"}}, "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12 12:00:00'")
asked("time_range_relative", "events", {"columns": ["event_id"], "time_range": {"column": "ts", "since": "1w1d12h", "until": "1.5d"}}, "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-22 12:00:00' AND ts <= TIMESTAMP '2024-01-29 12:00:00'")
add("time_range_bucketed", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 10:00:00' AND ts <= TIMESTAMP '2024-01-16 10:05:00'", lambda spark, sf: _bucketed(spark, sf))


def _bucketed(spark: SparkSession, sf: str) -> DataFrame:
    e = engine(spark, sf)
    e.settings.config["query"]["timestamp_bucket_seconds"] = 300
    return e.plan("events", {"columns": ["event_id"], "time_range": {"column": "ts", "since": "2024-01-15T10:02:11Z", "until": "2024-01-16T10:09:59Z"}}, "admin")


# --- aggregates ---
AGGREGATES = {
    "count": ({"column": "*"}, "count(*)"), "sum": ({}, "sum(value)"), "avg": ({}, "avg(value)"), "min": ({}, "min(value)"), "max": ({}, "max(value)"),
    "countDistinct": ({"column": "user_id"}, "count(DISTINCT user_id)"), "uniqExact": ({"column": "user_id"}, "count(DISTINCT user_id)"),
    "any": ({"column": "event_type"}, "min(event_type)"), "anyLast": ({"column": "event_type"}, "max(event_type)"),
    "argMin": ({"column": "event_id", "by": "ts"}, "arg_min(event_id, ts)"), "argMax": ({"column": "event_id", "by": "ts"}, "arg_max(event_id, ts)"),
    "median": ({}, "median(value)"), "quantile": ({"level": 0.9}, "quantile_cont(value, 0.9)"),
    "stddevPop": ({}, "stddev_pop(value)"), "stddevSamp": ({}, "stddev_samp(value)"), "varPop": ({}, "var_pop(value)"), "varSamp": ({}, "var_samp(value)"),
}
for fn, (more, sql) in AGGREGATES.items():
    shown = f"round({sql}, 4)" if not more or "level" in more else sql
    asked(f"agg_{fn}", "events", {"columns": ["event_type"], "aggregations": [{"function": fn, "column": "value", "alias": "x"} | more], "group_by": ["event_type"]}, f"SELECT event_type, {shown} AS x FROM events GROUP BY event_type")
asked("agg_uniq_approx", "events", {"columns": ["event_type"], "aggregations": [{"function": "uniq", "column": "user_id", "alias": "x"}], "group_by": ["event_type"]}, None)
add("agg_groupArray", "SELECT user_id, list_sort(list(event_id)) AS x FROM events GROUP BY user_id", lambda spark, sf: engine(spark, sf).plan("events", {"columns": ["user_id"], "aggregations": [{"function": "groupArray", "column": "event_id", "alias": "x"}], "group_by": ["user_id"]}, "admin").withColumn("x", F.array_sort("x")))
asked("agg_global", "lineitem", {"aggregations": [{"function": "COUNT", "alias": "n"}, {"function": "sum", "column": "l_quantity", "alias": "q"}, {"function": "max", "column": "l_discount", "alias": "d"}]}, "SELECT count(*) AS n, round(sum(l_quantity), 4) AS q, round(max(l_discount), 4) AS d FROM lineitem")
asked("agg_int_sum", "events", {"aggregations": [{"function": "sum", "column": "user_id", "alias": "s"}]}, "SELECT cast(sum(user_id) AS BIGINT) AS s FROM events")
asked("agg_pricing", "lineitem", {"columns": ["l_returnflag", "l_linestatus"], "aggregations": [{"function": "sum", "column": "l_quantity", "alias": "sum_qty"}, {"function": "avg", "column": "l_extendedprice", "alias": "avg_price"}, {"function": "count", "alias": "n"}], "group_by": ["l_returnflag", "l_linestatus"]}, "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n FROM lineitem GROUP BY ALL")
asked("agg_default_name", "events", {"aggregations": [{"function": "sum", "column": "user_id"}]}, 'SELECT cast(sum(user_id) AS BIGINT) AS "sum(`user_id`)" FROM events')
asked("group_hidden_key", "events", {"aggregations": [{"function": "count", "alias": "n"}], "group_by": ["user_id"]}, "SELECT count(*) AS n FROM events GROUP BY user_id")
asked("group_distinct", "events", {"columns": ["event_type", "user_id"], "group_by": ["event_type", "user_id"]}, "SELECT DISTINCT event_type, user_id FROM events")

# --- order, limit, pages ---
asked("order_alias", "events", {"columns": ["user_id"], "aggregations": [{"function": "count", "alias": "n"}], "group_by": ["user_id"], "order_by": [{"column": "n", "dir": "DESC"}, {"column": "user_id"}], "limit": 10}, "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
asked("topk", "orders", {"columns": ["o_orderkey"], "order_by": [{"column": "o_totalprice", "dir": "desc"}, {"column": "o_orderkey", "dir": "asc"}], "limit": 25}, "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
asked("limit_clamp", "events", {"columns": ["event_id"], "order_by": [{"column": "event_id"}], "limit": 5000}, "SELECT event_id FROM events ORDER BY event_id LIMIT 7", role="narrow")
PAGE = {"columns": ["event_id", "event_type"], "order_by": [{"column": "event_id", "dir": "desc"}], "limit": 50}
asked("keyset_page_1", "events", PAGE, "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50")
add("keyset_page_2", "SELECT event_id, event_type FROM events WHERE event_id < (SELECT max(event_id) - 49 FROM events) ORDER BY event_id DESC LIMIT 50", lambda spark, sf: _page_two(spark, sf))


def _page_two(spark: SparkSession, sf: str) -> DataFrame:
    e, q = engine(spark, sf), ast.decode(PAGE)
    rows = e.query("events", q, "admin")[0]
    return e.plan("events", ast.next_page(q, rows[-1]), "admin")


# --- policies ---
COUNTED = {"columns": ["event_type"], "aggregations": [{"function": "count", "alias": "n"}], "group_by": ["event_type"]}
for role, where in (("viewer", "user_id IN (1, 2, 3, 50)"), ("eq", "event_type = 'purchase'"), ("neq", "event_type <> 'click'"), ("gt", "value > 100.5"), ("lt", "user_id < 20")):
    asked(f"rls_{role}", "events", COUNTED, f"SELECT event_type, count(*) AS n FROM events WHERE {where} GROUP BY event_type", role=role)
asked("rls_unresolved", "events", COUNTED, "SELECT event_type, count(*) AS n FROM events WHERE false GROUP BY event_type", role="viewer", claims={})
asked("policy_expand", "events", {"select_all": True, "order_by": [{"column": "event_id"}]}, "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 7", role="narrow")
asked("policy_and_user_filter", "events", {"columns": ["event_id"], "filters": [{"column": "value", "op": "lt", "value": 5}]}, "SELECT event_id FROM events WHERE user_id IN (1, 2, 3, 50) AND value < 5", role="viewer")

# --- pipes ---
def piped(name: str, pipe: str, supplied: dict, oracle: str, claims: dict = CLAIMS) -> None:
    add(name, oracle, lambda spark, sf: rounded(engine(spark, sf).pipe(pipe, supplied, "viewer", claims)))


piped("pipe_scalar", "by_type", {"type": "click", "least": 250}, "SELECT event_id, round(value, 4) AS value FROM events WHERE event_type = 'click' AND value > 250")
piped("pipe_default", "by_type", {"type": "error"}, "SELECT event_id, round(value, 4) AS value FROM events WHERE event_type = 'error' AND value > 100")
piped("pipe_array_in", "types", {"types": ["click", "view"]}, "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type")
piped("pipe_claim_set", "mine", {}, "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (1, 2, 3, 50) GROUP BY o_custkey")
piped("pipe_date_totals", "days", {"least": "10"}, "SELECT cast(cast(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE value >= 10 GROUP BY ALL")

piped("pipe_float", "above", {"least": 1234567.5}, "SELECT event_id FROM events WHERE value * 10000 > 1234567.5")
piped("pipe_dialect", "dialect", {}, "SELECT event_id, event_type IN ('click', 'view') AS seen, strftime(ts, '%Y-%m-%d') AS day, 'UTC' AS zone FROM events")

# --- the result cache: a second caller whose values differ late in a long list ---
def cached(name: str, user: int) -> None:
    def run(spark, sf):
        # the list's other values may be users too: the caller's filter, the same for both, leaves the last
        e, q = engine(spark, sf), {"aggregations": [{"function": "count", "alias": "n"}], "filters": [{"column": "user_id", "op": "lt", "value": 1000}]}
        for last in (3 - user, user):
            rows, _ = e.query("events", q, "viewer", {"users": [*range(1000, 1040), last]})
        return spark.createDataFrame(rows, "n long")

    add(name, f"SELECT count(*) AS n FROM events WHERE user_id = {user}", run)


cached("cache_claims_a", 1)
cached("cache_claims_b", 2)

# --- SQL ---
said("sql_join_inner", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
said("sql_join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
said("sql_join_right", "SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
said("sql_join_full", "SELECT coalesce(c_custkey, user_id) AS k, count(event_id) AS n FROM customer FULL JOIN events ON c_custkey = user_id GROUP BY coalesce(c_custkey, user_id)")
said("sql_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
said("sql_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
said("sql_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
said("sql_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey > b.n_regionkey AND a.n_nationkey < b.n_nationkey")
said("sql_asof", "SELECT event_id, prev FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM events) WHERE event_type = 'click'", "SELECT event_id, prev FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM events) WHERE event_type = 'click'")
said("sql_interval_join", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR AND a.event_type = 'click' AND b.event_type = 'purchase'")
said("sql_window_rank", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER w AS q, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER w AS q, round(round(percent_rank() OVER w, 6), 4) AS p, round(round(cume_dist() OVER w, 6), 4) AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)")
said("sql_window_lag", "SELECT event_id, lag(event_id) OVER w AS a, lead(event_id, 2) OVER w AS b, first_value(event_id) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
said("sql_window_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS n, max(event_id) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS m FROM events")
said("sql_union", "SELECT n_name AS x FROM nation UNION SELECT r_name FROM region")
said("sql_union_all", "SELECT s_nationkey AS x FROM supplier UNION ALL SELECT c_nationkey FROM customer")
said("sql_intersect", "SELECT user_id AS x FROM events INTERSECT SELECT c_custkey FROM customer")
said("sql_except", "SELECT c_custkey AS x FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000")
said("sql_cte", "WITH t AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), m AS (SELECT max(n) AS m FROM t) SELECT user_id, n FROM t JOIN m ON n = m")
said("sql_recursive", "WITH RECURSIVE t(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM t WHERE x < 40) SELECT count(*) AS n FROM t JOIN events ON user_id = x")
said("sql_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
said("sql_cube", "SELECT event_type, user_id % 3 AS k, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 3)")
said("sql_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
said("sql_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")

# --- ingest ---
def event_table(spark: SparkSession, sf: str) -> catalog.Table:
    return catalog.declared("events", [("event_id", "Int64"), ("ts", "DateTime64(6)"), ("user_id", "UInt32"), ("event_type", "String"), ("value", "Float64"), ("props", "Nullable(String)"), ("source", "String", "DEFAULT", "'web'"), ("doubled", "Float64", "MATERIALIZED", "value * 2"), ("shown", "String", "ALIAS", "concat(event_type, '!')")], lambda: spark.read.parquet(f"{sf}/events.parquet"))


def faulty(spark: SparkSession, sf: str) -> DataFrame:
    """Events as JSON lines with a fault in some: which one depends on the id."""
    k = F.col("event_id") % 10
    user, value = F.col("user_id").cast("string"), F.to_json(F.struct("value"))
    value = F.regexp_extract(value, r"\{\"value\":(.*)\}", 1)
    obj = F.concat(F.lit('{"event_id":'), F.col("event_id"), F.when(k == 1, F.lit('')).otherwise(F.concat(F.lit(',"user_id":'), F.when(k == 2, F.lit("null")).when(k == 3, F.lit("true")).otherwise(user))), F.lit(',"ts":"2024-01-05 10:00:00.500"'), F.lit(',"event_type":"'), F.col("event_type"), F.lit('","value":'), value, F.when(k == 4, F.lit(',"nosuch":1')).when(k == 5, F.lit(',"doubled":1')).when(k == 6, F.lit(',"props":"p"')).otherwise(F.lit("")), F.lit("}"))
    line = F.when(k == 7, F.lit("{broken")).when(k == 8, F.concat(F.lit("["), obj, F.lit("]"))).otherwise(obj)
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("i"), line.alias("value"))


def prepared(spark: SparkSession, sf: str, role: str = "admin", dedupe: ingest.Dedupe = ingest.Dedupe()) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return ingest.prepare(readers.ndjson(faulty(spark, sf), "value", "i"), event_table(spark, sf), policy.grant(POLICY, "events", role, "insert", CLAIMS), dedupe)


REASON = "CASE event_id % 10 WHEN 7 THEN 'invalid json' WHEN 8 THEN 'invalid json' WHEN 4 THEN 'unknown column nosuch' WHEN 1 THEN 'missing required column user_id' WHEN 2 THEN 'null in column user_id' WHEN 3 THEN 'wrong type for column user_id' WHEN 5 THEN 'computed column doubled' END"
add("ingest_outcomes", f"SELECT event_id AS index, CASE WHEN {REASON} IS NULL THEN 'ok' ELSE 'error' END AS status, {REASON} AS reason FROM events", lambda spark, sf: ingest.outcomes(prepared(spark, sf)))
add("ingest_totals", f"SELECT CASE WHEN {REASON} IS NULL THEN 'ok' ELSE 'error' END AS status, count(*) AS n FROM events GROUP BY 1", lambda spark, sf: ingest.totals(prepared(spark, sf)))
CHECKED = f"CASE WHEN event_id % 10 IN (7, 8, 4, 1, 2, 3, 5) THEN {REASON} WHEN event_id % 10 = 6 THEN 'column not allowed props' WHEN user_id <> 7 THEN 'check failed for column user_id' WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'check failed for column event_type' END"
add("ingest_checks", f"SELECT event_id AS index, {CHECKED} AS reason FROM events", lambda spark, sf: prepared(spark, sf, "writer").select("index", "reason"))
add("ingest_auto_inject", f"SELECT event_id AS index, 'purchase' AS source FROM events WHERE {REASON} IS NULL", lambda spark, sf: prepared(spark, sf, "stamper").filter("reason IS NULL").select("index", "source"))
add("ingest_ts_canonical", f"SELECT event_id AS index, '2024-01-05T10:00:00.5Z' AS ts FROM events WHERE {REASON} IS NULL", lambda spark, sf: prepared(spark, sf).filter("reason IS NULL").select("index", "ts"))
add("ingest_dedupe", f"SELECT index, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY index) > 1 THEN 'duplicate' ELSE 'ok' END AS status FROM (SELECT event_id AS index, user_id FROM events WHERE {REASON} IS NULL)", lambda spark, sf: prepared(spark, sf, dedupe=ingest.Dedupe("user_id")).filter("reason IS NULL").select("index", "status"))
add("ingest_dedupe_missing_id", f"SELECT event_id AS index, CASE WHEN {REASON} IS NOT NULL THEN {REASON} WHEN event_id % 10 <> 6 THEN 'missing id props' END AS reason FROM events", lambda spark, sf: prepared(spark, sf, dedupe=ingest.Dedupe("props", True)).select("index", "reason"))
add("ingest_seen", f"SELECT event_id AS index, CASE WHEN {REASON} IS NOT NULL THEN 'error' WHEN user_id < 30 THEN 'duplicate' WHEN row_number() OVER (PARTITION BY {REASON} IS NULL, user_id ORDER BY event_id) > 1 THEN 'duplicate' ELSE 'ok' END AS status FROM events", lambda spark, sf: ingest.against_seen(prepared(spark, sf, dedupe=ingest.Dedupe("user_id")), spark.range(60).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 15, F.lit(None)).when(F.col("id") < 30, F.lit("2030-01-01")).otherwise(F.lit("2020-01-01")).cast("timestamp").alias("expires_at")), F.lit("2024-01-31").cast("timestamp")).select("index", "status"))
add("ingest_ticks", "SELECT event_id AS index, strftime(TIMESTAMP '2024-01-05 10:00:00' + to_seconds(event_id), '%Y-%m-%dT%H:%M:%SZ') AS ts FROM events", lambda spark, sf: _lines(spark, sf, F.format_string('{"event_id":%d,"user_id":1,"ts":%d,"event_type":"a","value":1}', "event_id", F.col("event_id") * 1_000_000 + 1704448800000000)).select("index", "ts"))
add("ingest_twin_keys", "SELECT event_id AS index, 'ok' AS status, event_type FROM events", lambda spark, sf: _lines(spark, sf, F.format_string('{"event_type":"first","event_id":%d,"user_id":1,"ts":"2024-01-05","value":1,"event_type":"%s"}', "event_id", "event_type")).select("index", "status", "event_type"))
add("ingest_array_index", "SELECT x AS index, CASE WHEN x = 2 THEN 'record must be a JSON object' END AS error FROM (VALUES (1), (2), (3)) t(x)", lambda spark, sf: readers.body(spark, '[{"a":1}, 5, {"b":[1,2]}]').select(F.col("index").cast("int").alias("index"), "error"))
add("ingest_computed_columns", f"SELECT event_id, user_id, round(value * 2, 4) AS doubled, 'web' AS source, event_type || '!' AS shown FROM events WHERE {REASON} IS NULL", lambda spark, sf: _stored(spark, sf))


def _lines(spark: SparkSession, sf: str, line) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    lines = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("i"), line.alias("value"))
    return ingest.prepare(readers.ndjson(lines, "value", "i"), event_table(spark, sf), policy.grant(POLICY, "events", "admin", "insert", CLAIMS))


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    t = event_table(spark, sf)
    good, _ = ingest.typed(prepared(spark, sf).filter("status = 'ok'"), t)
    return rounded(ingest.with_aliases(good, t).select("event_id", F.col("user_id"), "doubled", "source", "shown"))


# --- log and streams ---
def log(spark: SparkSession, sf: str) -> DataFrame:
    """The events as an event log; every 50th envelope is broken."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = eventlog.envelopes(df.withColumn("source", F.lit("web")), event_table(spark, sf), "0", F.col("ts"), F.col("event_id"))
    k = F.col("seq") % 200
    return out.withColumn("format", F.when(k == 50, "csv").otherwise(F.col("format"))).withColumn("row", F.when(k == 100, "[1,2]").when(k == 150, "oops").otherwise(F.col("row")))


CLEAN = "event_id % 200 NOT IN (50, 100, 150)"
add("log_poison", "SELECT CASE event_id % 200 WHEN 50 THEN 'unknown_format' WHEN 100 THEN 'unpairable' ELSE 'malformed' END AS reason, count(*) AS n FROM events WHERE event_id % 200 IN (50, 100, 150) GROUP BY 1", lambda spark, sf: (lambda e: e.withColumn("reason", eventlog.poison()).filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")))(log(spark, sf)))
add("log_replay_since", "SELECT event_id AS seq FROM events WHERE ts >= TIMESTAMP '2024-01-25 06:00:00'", lambda spark, sf: eventlog.replay(spark, _published(spark, sf), "0", "events", datetime(2024, 1, 25, 6, tzinfo=UTC)).select("seq"))
add("log_retention", "SELECT event_id AS seq FROM events WHERE event_id >= least(401, (SELECT min(event_id) FROM events WHERE ts >= TIMESTAMP '2024-01-20'))", lambda spark, sf: eventlog.retained(log(spark, sf), 400, F.lit("2024-01-20").cast("timestamp")).select("seq"))
add("log_dlq_counts", f"SELECT 'events' AS \"table\", count(*) AS n FROM events WHERE {CLEAN} AND event_id % 9 = 0", lambda spark, sf: _dead(spark, sf))


def _published(spark: SparkSession, sf: str) -> str:
    """The log written to a folder that all executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    eventlog.publish(log(spark, sf), path := f"{shared.rstrip('/')}/sluice-log-{uuid.uuid4().hex}")
    return path


def _dead(spark: SparkSession, sf: str) -> DataFrame:
    t = event_table(spark, sf)
    rows = eventlog.decode(log(spark, sf), t).withColumn("value", F.when(F.col("event_id").cast("long") % 9 == 0, "not a number").otherwise(F.col("value")))
    return eventlog.dead_letter_counts(eventlog.dead_letters(ingest.typed(rows, t)[1], "events", F.current_timestamp()))


def seen_by(spark: SparkSession, sf: str, role: str) -> DataFrame:
    t = event_table(spark, sf)
    return fanout.visible(eventlog.decode(log(spark, sf), t), t, policy.grant(POLICY, "events", role, "select", CLAIMS))


add("stream_project", f"SELECT event_id AS seq, cast(event_id AS VARCHAR) AS event_id, event_type FROM events WHERE {CLEAN}", lambda spark, sf: seen_by(spark, sf, "narrow").select("seq", "event_id", "event_type"))
for role, where in (("viewer", "user_id IN (1, 2, 3, 50)"), ("eq", "event_type = 'purchase'"), ("neq", "event_type <> 'click'"), ("gt", "value > 100.5"), ("lt", "user_id < 20")):
    add(f"stream_rowfilter_{role}", f"SELECT event_id AS seq FROM events WHERE {CLEAN} AND {where}", lambda spark, sf, role=role: seen_by(spark, sf, role).select("seq"))
add("stream_withheld", f"SELECT count(*) AS withheld FROM events WHERE {CLEAN} AND event_type = 'click'", lambda spark, sf: (lambda t: fanout.withheld(eventlog.decode(log(spark, sf), t), t, policy.grant(POLICY, "events", "neq", "select", CLAIMS)))(event_table(spark, sf)))
add("stream_schema_frames", f"SELECT min(event_id) AS seq FROM events WHERE {CLEAN}", lambda spark, sf: (lambda t: fanout.schema_frames(eventlog.decode(log(spark, sf), t), policy.grant(POLICY, "events", "narrow", "select", CLAIMS)).select("seq"))(event_table(spark, sf)))
def _batches(spark: SparkSession, sf: str, *parts: str) -> list:
    """What one subscriber gets of several batches."""
    got, s = [], fanout.Subscriber(policy.grant(POLICY, "events", "lt", "select", CLAIMS), 10_000)
    for part in parts:
        fanout.broadcast(log(spark, sf).filter(part), event_table(spark, sf), [s])
        got += s.queue
        s.queue.clear()
    return got


add("stream_two_batches", f"SELECT 'schema' AS event, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'message', count(*) FROM events WHERE {CLEAN} AND user_id < 20 AND event_id <= 9000", lambda spark, sf: spark.createDataFrame(sorted(Counter(f.event for f in _batches(spark, sf, "seq <= 4000", "seq > 4000 AND seq <= 9000")).items()), "event string, n long"))
add("stream_resume", f"SELECT event_id AS seq FROM events WHERE {CLEAN} AND user_id < 20 AND event_id > 2000 AND event_id <= 9000", lambda spark, sf: spark.createDataFrame([(f.seq,) for f in _batches(spark, sf, "seq > 2000 AND seq <= 6000", "seq > 3000 AND seq <= 9000") if f.event == "message"], "seq long"))
add("stream_live_query", f"SELECT event_id AS seq FROM events WHERE {CLEAN}", lambda spark, sf: (lambda r: fanout.live_query(r.filter("received_timestamp < timestamp'2024-01-15'"), r.filter("received_timestamp > timestamp'2024-01-10'")).select("seq"))(eventlog.decode(log(spark, sf), event_table(spark, sf))))

# --- keys ---
ESCAPED = "replace(replace(url_encode({0}), '.', '%2E'), '~', '%7E')"
RECORD_KEY = f"'0/documents/' || CASE WHEN length({ESCAPED.format('text')}) <= 1024 THEN {ESCAPED.format('text')} ELSE '#' || sha256(text) END"
add("key_escaped", f"SELECT doc_id, {ESCAPED.format('source')} AS escaped FROM documents", lambda spark, sf: spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", keys.escape_column(F.col("source")).alias("escaped")))
add("key_idempotency", f"SELECT doc_id, substr(sha256({RECORD_KEY}), 1, 32) AS key FROM documents", lambda spark, sf: spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", keys.idempotency_column("0", "documents", F.col("text")).alias("key")))

# --- kernels ---
add("kernel_canonical_decimal", "SELECT * FROM (VALUES ('1.0', '1'), ('2.50', '2.5'), ('1e3', '1000'), ('25e-4', '0.0025'), ('-0', '0'), ('007', NULL), ('+5', NULL), ('100', '100')) t(raw, out)", lambda spark, sf: spark.createDataFrame([(x,) for x in ("1.0", "2.50", "1e3", "25e-4", "-0", "007", "+5", "100")], "raw string").select("raw", canonical.numeric_column(F.col("raw")).alias("out")))
add("kernel_decimal_truncation", "SELECT o_orderkey, CAST(trunc(o_totalprice * 10) / 10 AS DECIMAL(12,1)) AS x FROM orders", lambda spark, sf: spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", canonical.truncate(F.col("o_totalprice").cast("string").cast("decimal(38,18)"), 12, 1).alias("x")))
add("kernel_timestamps", "SELECT * FROM (VALUES ('2024-01-05T10:00:00.120+02:00', '2024-01-05T08:00:00.12Z'), ('2024-01-05', '2024-01-05T00:00:00Z'), ('1704448800', '2024-01-05T10:00:00Z'), ('2024', '2024'), ('soon', 'soon')) t(raw, out)", lambda spark, sf: spark.createDataFrame([(x,) for x in ("2024-01-05T10:00:00.120+02:00", "2024-01-05", "1704448800", "2024", "soon")], "raw string").select("raw", timestamps.canonical_column(F.col("raw"), parse("DateTime64(3)")).alias("out")))

import json
from datetime import UTC, datetime
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice import cache, catalog, claims, ingest, keys, pipes, policy, retry, settings, sqlscan, types
from sluice.engine import Engine
from sluice.errors import Forbidden, InFlight, Invalid, LimitExceeded, NotFound, QueueFull, Rejected, Unavailable, UnsupportedFormat, from_spark
from sluice.functions import canonical, timestamps
from sluice.plans import ast
from sluice.queries import CLAIMS, POLICY, engine, event_table, log
from sluice.sources import eventlog, files, readers
from sluice.streaming import fanout, writer

SF = "/root/testdata/sf0.001"


@given(st.decimals(allow_nan=False, allow_infinity=False, min_value=-(10**20), max_value=10**20, places=6))
def test_canonical_decimals_keep_their_value(d):
    text = canonical.decimal_text(str(d))
    assert Decimal(text) == d and not text.endswith(".") and ("." not in text or not text.endswith("0"))


def test_scalars():
    assert canonical.scalar(True) == "true" and canonical.scalar(7) == "7" and canonical.scalar(1.50) == "1.5"
    assert canonical.scalar(None) is None and canonical.scalar([1]) is None and canonical.scalar(2.0**53) is None and canonical.scalar(10**101) is None


def test_durations_and_buckets():
    now = datetime(2024, 1, 31, tzinfo=UTC)
    assert timestamps.bound("1d12h", now) == datetime(2024, 1, 29, 12, tzinfo=UTC)
    assert timestamps.bound("1.5w", now) == datetime(2024, 1, 20, 12, tzinfo=UTC)
    assert timestamps.bound("2024-01-02T03:04:05.9+01:00", now, 60) == datetime(2024, 1, 2, 2, 4, tzinfo=UTC)
    for bad in ("yesterday", "2024-01-02", "5 d", ""):
        with pytest.raises(Invalid):
            timestamps.bound(bad, now)


def statements():
    """Statements made by the grammar, with what is known of each: a verb behind blanks, comments or a WITH list of opaque parts."""
    opaque = ("'a ) b'", '"x ( y"', "`drop`", "$t$ insert ) $t$", "'it\\'s ('", "’".replace("’", "‘)(’"))
    ahead = ("", " \t\n", "-- update\n", "# drop\n", "// set\n", "/* delete /* nested */ still */ ", "\ufeff")
    reads, writes = ("SELECT", "select", "SHOW", "DESCRIBE", "EXPLAIN"), sorted(sqlscan.WRITES)
    for lead in ahead:
        for verb in reads:
            yield f"{lead}{verb} 1", False
        for k, verb in enumerate(writes):
            yield f"{lead}{verb.upper() if k % 2 else verb} things", True
    for inner in opaque:
        yield f"WITH one AS (SELECT {inner} AS v), two AS (SELECT 2) SELECT * FROM one, two", False
        yield f"WITH one AS (SELECT {inner} AS v), two AS (SELECT 2) INSERT INTO things SELECT * FROM one", True
        yield f"SELECT {inner}", False
    yield "/* never closed DROP TABLE things", False
    yield "dropped", False
    yield "", False


def test_write_classifier():
    wrong = [sql for sql, writes in statements() if sqlscan.is_write(sql) is not writes]
    assert not wrong


def test_pipe_binding():
    p = pipes.Pipe("p", "SELECT {{a}}, {{b:7}}, {{ jwt.org.ids }}", (pipes.Parameter("a", required=True),))
    assert pipes.bind(p, {"a": "it's"}, {"org": {"ids": [1, "x"]}}) == "SELECT 'it\\'s', 7, ('1', 'x')"
    assert pipes.bind(p, {"a": -5, "b": True}, {"org": {"ids": "z"}}) == "SELECT  -5, 1, 'z'"
    assert pipes.bind(p, {"a": "{{b}}", "b": None}, {"org": {"ids": "z"}}).startswith("SELECT '{{b}}', NULL")
    with pytest.raises(pipes.UnresolvedClaim):
        pipes.bind(p, {}, {})
    for bad in ({}, {"a": []}, {"a": {}}):
        with pytest.raises(Invalid):
            pipes.bind(p, bad, {"org": {"ids": 1}})
    assert pipes.check(pipes.Pipe("q", "SELECT '{{a}}' -- {{b}}")) and pipes.check(pipes.Pipe("q", "SELECT {{ a }}")) and pipes.check(pipes.Pipe("q", "SELECT {{jwt}}"))
    assert not pipes.check(p)


@given(st.text())
def test_literals_come_back(text):
    body = pipes.quote(text)
    assert body[0] == body[-1] == "'" and "*" not in body and "$" not in body and "\n" not in body


def test_literals_in_spark(spark):
    for text in ("a'b\\c\n*/$x$ --", "\\", "''", "ü*"):
        assert spark.sql(f"SELECT {pipes.quote(text)} AS x").first().x == text


def test_policies():
    assert not policy.validate(POLICY)
    bad = policy.Policy({"t": {"": {"select": policy.Select(filter={"a": {"_like": "x"}}, caps={"max_rows": -1})}, "w": {"insert": policy.Insert(check={"a": {"_gt": "1"}})}}})
    assert len(policy.validate(bad)) == 4
    for role in (None, "nobody", "*", ""):
        with pytest.raises(Forbidden):
            policy.grant(POLICY, "events", role, "select", {})
    assert policy.grant(POLICY, "anything", "admin", "select", {}).column("x")
    assert policy.predicates({"a": {"_in": "{{ jwt.x }}"}}, {"x": [1, None]})[0].values is None
    assert policy.predicates({"a": {"_eq": "u-{{ jwt.x.y }}"}}, {"x": {"y": 3}})[0].values == ("u-3",)


def test_every_clause_is_authorized(spark):
    e = engine(spark, SF)
    for q in ({"columns": ["props"]}, {"columns": ["event_id"], "filters": [{"column": "props", "op": "eq", "value": "x"}]}, {"aggregations": [{"function": "max", "column": "props"}]}, {"columns": ["event_id"], "order_by": [{"column": "props"}]}, {"columns": ["props"], "group_by": ["props"]}, {"aggregations": [{"function": "MEDIAN", "column": "value"}]}):
        with pytest.raises(Forbidden):
            e.plan("events", q, "viewer", CLAIMS)
    for q in ({"aggregations": [{"function": "count", "alias": "props"}], "order_by": [{"column": "props"}]}, {"columns": ["event_id"], "time_range": {"column": "props"}}):
        with pytest.raises(Forbidden):
            e.plan("events", q, "viewer", CLAIMS)
    with pytest.raises(Rejected):
        e.plan("events", {"columns": ["event_id"], "order_by": [{"column": "nothing"}]}, "admin")
    for q in ({"columns": ["event_id"], "time_range": {"column": "nothing"}}, {"columns": ["nope"]}, {"columns": ["value"], "select_all": True}, {"columns": ["value"], "filters": [{"column": "value", "op": "between", "value": 1}]}, {"columns": ["value"], "filters": [{"column": "value", "op": "in", "value": []}]}, {"columns": [""]}, {"nope": 1}):
        with pytest.raises(Invalid):
            e.plan("events", q, "admin")
    with pytest.raises(Rejected):
        e.plan("events", {"columns": ["value"], "filters": [{"column": "user_id", "op": "eq", "value": "abc"}]}, "admin")
    with pytest.raises(NotFound):
        e.plan("none", {"columns": ["x"]}, "admin")
    assert e.query("events", {}, "admin")[0] == []
    with pytest.raises(Forbidden):
        e.raw_sql("SELECT 1", "viewer")
    with pytest.raises(Rejected):
        e.raw_sql("SELECT 1; SELECT 2", "admin")


def test_cap_on_rows_to_read(spark):
    e = engine(spark, SF)
    e.settings = settings.Settings(policy.Policy({"events": {"r": {"select": policy.Select(caps={"max_rows_to_read": 10})}}}))
    with pytest.raises(LimitExceeded):
        e.plan("events", {"columns": ["event_id"]}, "r")


def test_row_filter_reaches_the_scan(spark):
    plan = engine(spark, SF).plan("events", {"columns": ["event_id"], "filters": [{"column": "value", "op": "gt", "value": 5}]}, "viewer", CLAIMS)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in text and "GreaterThan(value" in text and "In(user_id" in text and "props" not in text.split("ReadSchema")[1]


@pytest.mark.parametrize(
    ("type_", "op", "constant", "payload", "seen"),
    [
        ("UInt8", "eq", "5", "5.0", True), ("UInt8", "eq", "5.0", "5", False), ("UInt8", "gt", "300", "5", False), ("UInt8", "eq", "5", "1e400", False), ("UInt8", "neq", "5", "6", True),
        ("Int64", "lt", "10", "9", True), ("Int64", "eq", "007", "7", False), ("Float32", "eq", "16777217", "16777216", True), ("Float64", "eq", "16777217", "16777216", False),
        ("Decimal(10,2)", "eq", "1.009", "1.00", True), ("Decimal(10,2)", "gt", "1.00", "1.005", False), ("String", "gt", "a", "b", True), ("String", "neq", "a", None, False),
        ("UUID", "eq", "x", "x", True), ("UUID", "neq", "x", "y", False), ("Bool", "gt", "a", "b", False), ("DateTime64(3)", "gt", "2024-01-01T00:00:00Z", "2024-01-02", True),
    ],
)
def test_stream_predicates(spark, type_, op, constant, payload, seen):
    t = catalog.declared("t", [("v", type_)], lambda: None)
    df = spark.createDataFrame([(payload,)], "v string")
    assert df.filter(policy.Predicate("v", op, (constant,)).stream(t)).count() == int(seen)


def test_readers(spark):
    assert readers.resolve_format("application/json; charset=utf-8") == "json" and readers.resolve_format("application/x-ndjson", "application/ndjson") == "ndjson"
    for bad in (("text/csv",), ("application/json", "application/ndjson"), ()):
        with pytest.raises(UnsupportedFormat):
            readers.resolve_format(*bad)
    got = readers.body(spark, '{"a":1}\n\n{bad\n{"a":2}', "ndjson").orderBy("index").collect()
    assert [(r["index"], r.error) for r in got] == [(1, None), (2, "invalid json"), (3, None)]
    with pytest.raises(Invalid):
        readers.body(spark, '[{"a":1}, ').count()


def test_request_ingest(spark):
    t = event_table(spark, SF)
    e = Engine(spark, catalog.Catalog(lambda: [t]), settings.Settings(POLICY, {}, {"dedupe": {"id_field": "event_id"}}))
    body = '[{"event_id":1,"ts":"2024-01-01","event_type":"click","value":1.50,"user_id":9},{"event_id":1,"ts":"2024-01-01","event_type":"view","value":2,"user_id":9},{"event_id":3,"ts":1,"event_type":"error","value":2,"user_id":9},{"event_id":4,"ts":1,"event_type":"click","value":2}]'
    rows = e.ingest("events", body, role="writer", claims={"user": 9}).orderBy("index").collect()
    assert [r.status for r in rows] == ["ok", "duplicate", "error", "error"] and rows[3].reason == "missing required column user_id" and rows[0].user_id == "9" and rows[0].ts == "2024-01-01T00:00:00Z" and rows[0].value == "1.50"


def test_writer_stream_and_dead_letters(spark, tmp_path):
    t, path = event_table(spark, SF), str(tmp_path / "log")
    eventlog.publish(log(spark, SF), path)
    writer.start(spark, path, t, str(tmp_path / "t"), str(tmp_path / "dlq"), str(tmp_path / "cp")).awaitTermination()
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    stored, dead = spark.read.parquet(str(tmp_path / "t")).count(), spark.read.parquet(str(tmp_path / "dlq")).count()
    assert stored + dead == n and dead == sum(1 for i in range(n) if i % 200 in (50, 100, 150))
    assert eventlog.replay(spark, path, "0", "events", datetime(2024, 1, 20)).count() < n
    s = [fanout.Subscriber(policy.grant(POLICY, "events", "narrow", "select", {}), size=5), fanout.Subscriber(policy.grant(POLICY, "events", "viewer", "select", CLAIMS), size=9)]
    fanout.broadcast(spark.read.schema(eventlog.ENVELOPE).parquet(path), t, s)
    assert [len(x.queue) for x in s] == [5, 9] and s[0].dropped and s[0].queue[0].event == "schema"


def test_storage_rejects_single_rows(spark):
    t = catalog.declared("t", [("a", "UInt8"), ("b", "Decimal(10,2)"), ("c", "String", "DEFAULT", "'x'")], lambda: None)
    good, bad = ingest.typed(spark.createDataFrame([("1", "1.999", None), ("300", "1", "y"), ("z", "1", "y")], "a string, b string, c string"), t)
    assert [tuple(r) for r in good.collect()] == [(1, Decimal("1.99"), "x")] and bad.count() == 2


def test_cache_and_versions():
    now = [0.0]
    c, v = cache.Cache(clock=lambda: now[0]), cache.Versions()
    ran = []
    run = lambda: ran.append(1) or [1]
    assert c.through("k", v.snapshot("0", [("t", "")]), run)[1] == "MISS" and c.through("k", v.snapshot("0", [("t", "")]), run)[1] == "HIT"
    v.bump("0", "other")
    assert c.through("k", v.snapshot("0", [("t", "")]), run)[1] == "HIT"
    for args in (("0", "t"), ("0",), ("0", "t", "s")):
        v.bump(*args)
        assert c.through("k", v.snapshot("0", [("t", "")]), run)[1] == "MISS"
    now[0] = 11
    assert c.through("k", v.snapshot("0", [("t", "")]), run)[1] == "MISS" and cache.ttl(0.001) == 10 and cache.ttl(1) == 1000 and cache.ttl(99) == 3600


def test_cached_results_are_the_callers_own(spark):
    """Other claims late in a long list, another table, another alias, another column: each has its own rows."""
    make = lambda name, value: catalog.declared(name, [("x", "Int64"), ("user_id", "Int64")], lambda: spark.createDataFrame([(value, 1), (value, 2), (value, 2)], "x long, user_id long"))
    roles = {"v": {"select": policy.Select(filter={"user_id": {"_in": "{{ jwt.users }}"}})}}
    e = Engine(spark, catalog.Catalog(lambda: [make("a", 10), make("b", 20)]), settings.Settings(policy.Policy({"a": roles, "b": roles}), {}, {}))
    count = {"aggregations": [{"function": "count", "alias": "n"}]}
    many = [*range(1000, 1040)]
    assert e.query("a", count, "v", {"users": [*many, 1]}) == ([{"n": 1}], "MISS") and e.query("a", count, "v", {"users": [*many, 2]}) == ([{"n": 2}], "MISS")
    assert e.query("a", count, "v", {"users": [*many, 1]}) == ([{"n": 1}], "HIT")
    top = lambda alias: {"aggregations": [{"function": "max", "column": "x", "alias": alias}]}
    assert [e.query(t, top(alias), "admin") for t, alias in (("a", "m"), ("b", "m"), ("a", "k"))] == [([{"m": 10}], "MISS"), ([{"m": 20}], "MISS"), ([{"k": 10}], "MISS")]
    e.inserted("a")
    assert e.query("a", top("m"), "admin")[1] == "MISS" and e.query("b", top("m"), "admin")[1] == "HIT"


def test_pipes_are_cached_and_writes_run(spark):
    ran = []
    t = catalog.declared("t", [("x", "Int64")], lambda: spark.range(3).withColumnRenamed("id", "x"))
    own = {"read": pipes.Pipe("read", "SELECT count(*) AS n FROM t WHERE x < {{top}}"), "write": pipes.Pipe("write", "INSERT INTO t VALUES ({{x}})")}
    e = Engine(spark, catalog.Catalog(lambda: [t]), settings.Settings(policy.Policy({}), own, {}))
    assert [e.pipe_rows("read", {"top": n}, "admin") for n in (2, 2, 3)] == [([{"n": 2}], "MISS"), ([{"n": 2}], "HIT"), ([{"n": 3}], "MISS")]
    e.sql = lambda text: ran.append(text) or spark.createDataFrame([], "x long")
    for _ in range(2):
        assert e.pipe_rows("write", {"x": 5}, "admin") == ([], "MISS")
    assert ran == ["INSERT INTO t VALUES (5)"] * 2
    assert e.pipe_rows("read", {"top": 2}, "admin")[1] == "MISS"  # its table was written
    assert pipes.parameters({"a": "1", "b": "2"}, {"b": 3}) == {"a": "1", "b": 3}


def test_tenants_share_no_views(spark):
    make = lambda name, n: Engine(spark, catalog.Catalog(lambda: [catalog.declared(name, [("x", "Int64")], lambda: spark.range(n).withColumnRenamed("id", "x"))]), settings.Settings(policy.Policy({}), {}, {}))
    a, b, c = make("t", 2), make("t", 5), make("u", 1)
    first, second = (e.raw_sql("SELECT count(*) AS n FROM t", "admin") for e in (a, b))
    assert (first.first().n, second.first().n) == (2, 5)
    with pytest.raises(Rejected):
        c.raw_sql("SELECT * FROM t", "admin")


def test_line_numbers_without_an_order(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text("".join(f'{{"a":{i}}}\n\n' for i in range(500)))
    got = readers.ndjson(readers.files(spark, str(tmp_path)))
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert [(r["index"], r.raw) for r in got.orderBy("index").collect()] == [(i + 1, f'{{"a":{i}}}') for i in range(500)]


def test_members_given_twice(spark):
    got = readers.body(spark, '[{"a":1,"b":[1,{"c":2}],"a":"x"},{"a":1}]').orderBy("index").collect()
    assert [r.error for r in got] == [None, None] and json.loads(got[0].raw) == {"a": "x", "b": [1, {"c": 2}]}


def test_numbers_as_times(spark):
    types_ = {"DateTime": "2025-06-21T04:00:00Z", "DateTime64(0)": "2025-06-21T04:00:00Z", "DateTime64(3)": "1970-01-21T06:14:38.4Z", "DateTime64(9)": "1970-01-01T00:00:01.7504784Z"}
    for name, want in types_.items():
        of = types.parse(name)
        row = spark.createDataFrame([("1750478400", True), ("1750478400", False), ("-5", True), ("1.5", True)], "t string, n boolean").select(timestamps.canonical_column(F.col("t"), of, F.col("n")).alias("x")).collect()
        assert [r.x for r in row] == [want.replace("1.7504784", "1.750478") if "9" in name else want, "2025-06-21T04:00:00Z", "-5", "1.5"]


def test_seen_ids(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ok", "a"), (2, "error", "b"), (3, "ok", None), (4, "ok", "c")], "index long, status string, id string")
    path = str(tmp_path / "seen")
    ingest.remember(rows, path, 3600)
    ingest.remember(rows.filter("id = 'c'"), path)
    seen = spark.read.parquet(path)
    assert {r.id: r.expires_at is None for r in ingest.purge_seen(seen, F.current_timestamp()).collect()} == {"a": False, "c": True}
    assert {r.id for r in ingest.purge_seen(seen, F.current_timestamp() + F.expr("interval 2 hours")).collect()} == {"c"}
    again = ingest.against_seen(rows, seen, F.current_timestamp())
    assert {r["index"]: r.status for r in again.collect()} == {1: "duplicate", 2: "error", 3: "ok", 4: "duplicate"}


def test_a_running_stream_serves_subscribers(spark, tmp_path):
    """Replay, then live events once each; the policy is read at each batch."""
    t, path, events = event_table(spark, SF), str(tmp_path / "log"), log(spark, SF)
    eventlog.publish(events.filter("seq <= 100"), path)
    e = engine(spark, SF)
    e.catalog = catalog.Catalog(lambda: [t])
    e.catalog.refresh()
    e.tenant = "0"
    s = e.subscribe("events", "eq", CLAIMS, 1000, path)
    had = [f.seq for f in s.queue if f.event == "message"]
    eventlog.publish(events.filter("seq > 100 AND seq <= 300"), path)
    fanout.serve(spark, path, t, [s], str(tmp_path / "cp")).awaitTermination()
    got = [f.seq for f in s.queue if f.event == "message"]
    want = sorted(r.event_id for r in spark.read.parquet(f"{SF}/events.parquet").filter("event_type = 'purchase' AND event_id <= 300 AND event_id % 200 NOT IN (50, 100, 150)").collect())
    assert had and got == want and [f.event for f in s.queue].count("schema") == 1
    e.settings = settings.Settings(policy.Policy({}), {}, {})
    n = len(s.queue)
    fanout.broadcast(events.filter("seq > 300"), t, [s])
    assert len(s.queue) == n
    with pytest.raises(NotFound):
        e.subscribe("nothing", "eq", CLAIMS)


def test_purge(spark, tmp_path):
    path, events = str(tmp_path / "log"), log(spark, SF)
    for a in (0, 30, 60):
        eventlog.publish(events.filter(f"seq > {a} AND seq <= {a + 30}").coalesce(1), path)
    assert eventlog.purge(spark, path, 40, F.lit("2030-01-01").cast("timestamp")) == 1
    assert sorted(r.seq for r in spark.read.schema(eventlog.ENVELOPE).parquet(path).collect()) == list(range(31, 91))


def test_rows_without_a_dead_letter_table(spark, tmp_path):
    """Nothing is written of a batch that must come again; one that the target refuses is parked whole."""
    t, target = event_table(spark, SF), tmp_path / "t"
    bad = log(spark, SF).filter("seq <= 10").withColumn("row", F.regexp_replace("row", r'^\["', '["not a number'))
    with pytest.raises(ValueError):
        writer.write_batch(bad, 0, t, str(target), None)
    assert not target.exists()


def test_settings(tmp_path):
    (tmp_path / "roles.json").write_text('{"roles": ["viewer"], "default_role": "viewer"}')
    (tmp_path / "policies.json").write_text('{"tables": {"t": {"viewer": {"select": {"columns": {"deny": ["x"]}, "filter": {"a": {"_eq": "{{ jwt.a }}"}}, "limits": {"max_execution_time": "5s", "max_memory_usage": "4GiB"}}}}}}')
    (tmp_path / "pipes.json").write_text('{"pipes": [{"name": "p", "sql": "SELECT {{a}}", "allowed_roles": ["viewer"]}]}')
    r = settings.Registry(str(tmp_path))
    assert r["0"].policy.tables["t"]["viewer"]["select"].caps == {"max_execution_time": 5000, "max_memory_usage": 4 << 30}
    (tmp_path / "pipes.json").write_text('{"pipes": [{"name": "p", "sql": "SELECT {{ a }}", "allowed_roles": ["who"]}]}')
    with pytest.raises(Invalid):
        r.reload()
    assert r["0"].pipes["p"].sql == "SELECT {{a}}"
    for bad in ("1.5ms", "x", None):
        with pytest.raises(Invalid):
            settings.millis(bad)
    assert settings.byte_size("4GB") == 4 * 10**9 and settings.millis("1h") == 3_600_000


def test_types_and_catalog(spark):
    assert types.parse("LowCardinality(Nullable(String))").nullable and types.parse("UInt64").spark.simpleString() == "decimal(20,0)"
    assert types.parse("DateTime64(3, 'Asia/Tokyo')").zone == "Asia/Tokyo" and types.parse("Decimal(77,2)").kind == "opaque" and types.parse("Whatever(x)").json == frozenset()
    tables = [catalog.declared("a", [("x", "Int8")], lambda: None)]
    c = catalog.Catalog(lambda: tables)
    c.refresh()
    tables[:] = [catalog.declared("a", [("x", "Int16")], lambda: None), catalog.declared(".hidden", [], lambda: None), catalog.declared("b", [], lambda: None)]
    assert c.refresh() == {"added": ["b"], "removed": [], "changed": ["a"]}
    for bad in ("a b", "x" * 65):
        with pytest.raises(Invalid):
            catalog.tenant_id(bad)


def test_keyset_pages():
    q = ast.decode({"columns": "a", "order_by": [{"column": "a", "dir": "DESC"}], "limit": 5})
    assert ast.has_more(q, 5) and not ast.has_more(q, 4)
    assert ast.next_page(q, {"a": 3}).filters[-1] == ast.Filter("a", "lt", 3) and ast.next_page(ast.decode({"columns": "a"}), {}) is None


def test_dropped_frames_are_all_counted(spark):
    t, grant = event_table(spark, SF), policy.grant(POLICY, "events", "narrow", "select", {})
    total = fanout.frames(eventlog.decode(log(spark, SF), t), t, grant).count()
    s = [fanout.Subscriber(grant, size=5), fanout.Subscriber(grant, size=9)]
    fanout.broadcast(log(spark, SF), t, s)
    assert total > 100 and [len(x.queue) + x.dropped for x in s] == [total] * 2


@given(st.lists(st.text(st.characters(exclude_categories=["Cs"])), min_size=1))
def test_keys_come_apart_again(fields):
    key = keys.join("/", *fields)
    assert keys.split(key, "/") == fields and key.isascii() and not set(key) & set(".~* \n#")


def test_key_columns(spark):
    ids = ["evt-123", "a b+c*d.e~f%", "é/#\n", "", "x" * 1024, "x" * 1025, "ü" * 200]
    got = spark.createDataFrame([(x,) for x in [*ids, None]], "id string").select(keys.escape_column(F.col("id")), keys.record_key_column("acme", "my table", F.col("id")), keys.idempotency_column("acme", "my table", F.col("id"))).collect()
    assert [tuple(r) for r in got] == [(keys.escape(x), keys.record_key("acme", "my table", x), keys.idempotency("acme", "my table", x)) for x in ids] + [(None, None, None)]
    assert keys.record_key("acme", "clicks", "evt-123") == "acme/clicks/evt-123" and "#" in keys.record_key("a", "t", "ü" * 200)
    for bad in ("a", "%", "é", ""):
        with pytest.raises(ValueError):
            keys.join(bad, "x")
    with pytest.raises(Invalid):
        keys.split("a/%4", "/")


@given(st.integers(0, keys.WORD), st.integers(1, 300))
def test_one_bucket_more_takes_keys_only_into_itself(h, n):
    assert 0 <= keys.jump(h, n) < n and keys.jump(h, n + 1) in (keys.jump(h, n), n)


def test_routes():
    assert keys.fnv(b"") == 0xCBF29CE484222325 and keys.fnv(b"a") == 0xAF63DC4C8601EC8C  # published test values
    spread = [keys.route("acme", f"t{i}", 4, 4) for i in range(4000)]
    assert min(spread.count((p, s)) for p in range(4) for s in range(4)) > 180


def test_pauses():
    now = [0.0]
    b = retry.Backoff(clock=lambda: now[0], chance=lambda: 0.5)
    down, own = Unavailable("down"), from_spark(type("AnalysisException", (Exception,), {})("[PATH_NOT_FOUND] x"))
    assert own.table_scoped and b.ask("t", 60) == 0
    pauses = []
    for _ in range(8):
        pauses.append(b.failed(down, "t", 10))
        assert b.ask("u", 10) > 0
        now[0] += pauses[-1]
        assert b.ask("t", 10) == 0 and b.ask("u", 10) > 0  # one probe, the others wait for it
    assert pauses == [0.75, 1.5, 3.0, 6.0, 7.5, 7.5, 7.5, 7.5]
    assert b.worked("t") == now[0] and b.ask("u", 10) == 0
    b.failed(own, "t", 60)
    assert b.ask("t", 60) > 0 and b.ask("u", 60) == 0
    ran, slept = [], []

    def flaky():
        ran.append(1)
        if len(ran) < 4:
            raise down
        return "done"

    clock = [0.0]
    b = retry.Backoff(clock=lambda: clock[0])
    assert retry.insist(flaky, b, sleep=lambda s: slept.append(s) or clock.__setitem__(0, clock[0] + s)) == "done" and len(ran) == 4 and slept
    with pytest.raises(Rejected):
        retry.insist(lambda: (_ for _ in ()).throw(Rejected("no")), b)
    with pytest.raises(Unavailable):
        retry.insist(lambda: (_ for _ in ()).throw(down), b, attempts=2, sleep=lambda s: clock.__setitem__(0, clock[0] + s))


def test_held_ids(spark, tmp_path):
    """A full log frees the ids at once; any other failure holds them until the lease ends; published ids are duplicates until they expire."""
    now = [1_700_000_000.0]
    c = claims.Claims(spark, str(tmp_path / "ids"), retention=3600, clock=lambda: now[0])
    rows = lambda *ids: spark.createDataFrame([(i + 1, "ok", None, x) for i, x in enumerate(ids)], "index long, status string, reason string, id string")
    sent = []
    send = lambda ok: sent.append(sorted(r.id or "" for r in ok.collect()))

    def fails(error):
        def run(ok):
            raise error

        return run

    with pytest.raises(QueueFull):
        c.settle(rows("a", "b"), fails(QueueFull()))
    with pytest.raises(Unavailable):
        c.settle(rows("a", "b"), fails(OSError("gone")))
    with pytest.raises(InFlight) as e:
        c.settle(rows("b", "c"), send)
    assert e.value.detail["retry_after"] == claims.LEASE and not sent
    c.settle(rows("c", None), send)
    now[0] += 31
    assert {r.id: r.status for r in c.settle(rows("a", "c"), send).collect()} == {"a": "ok", "c": "duplicate"} and sent == [["", "c"], ["a"]]
    now[0] += 3601
    c.settle(rows("a", "c"), send)
    assert sent[-1] == ["a", "c"] and not files.names(spark, f"{tmp_path}/ids/held")


def test_publishing_a_request(spark, tmp_path):
    t, log_, ids = event_table(spark, SF), str(tmp_path / "log"), str(tmp_path / "ids")
    e = Engine(spark, catalog.Catalog(lambda: [t]), settings.Settings(POLICY, {}, {"dedupe": {"id_field": "event_id", "retention": "1h"}}))
    record = lambda *n: json.dumps([{"event_id": k, "ts": "2024-01-01", "event_type": "click", "value": 1, "user_id": 9} for k in n])
    assert [r.status for r in e.publish("events", record(1, 2, 2), log_, ids, role="admin").orderBy("index").collect()] == ["ok", "ok", "duplicate"]
    assert [r.status for r in e.publish("events", record(2, 3), log_, ids, role="admin").orderBy("index").collect()] == ["duplicate", "ok"]
    got = eventlog.replay(spark, log_, e.tenant, "events").collect()
    assert [r.seq for r in got] == [1, 2, 4] and got[0].key == keys.idempotency(e.tenant, "events", "1")
    again = spark.read.schema(eventlog.ENVELOPE).parquet(log_)
    assert eventlog.unsent(again, log_).count() == 0 and eventlog.unsent(again, log_, F.lit("2100-01-01").cast("timestamp")).count() == 3


def test_stretches_of_a_log_share_their_schema_frames(spark, monkeypatch):
    t, grant = event_table(spark, SF), policy.grant(POLICY, "events", "narrow", "select", {})
    events = log(spark, SF).filter("seq <= 300").withColumn("columns", F.when(F.col("seq").between(120, 210), F.slice("columns", 2, 20)).otherwise(F.col("columns")))
    events = events.withColumn("row", F.when(F.col("seq").between(120, 210), F.regexp_replace("row", r'^\[("[^"]*"|null),', "[")).otherwise(F.col("row")))
    whole = [r.seq for r in fanout.schema_frames(eventlog.decode(events, t), grant).orderBy("seq").collect()]
    monkeypatch.setattr(fanout, "STRETCH", 16)
    assert whole == [r.seq for r in fanout.schema_frames(eventlog.decode(events, t), grant).orderBy("seq").collect()] and whole == [0, 120, 211]


def test_dead_letters_are_trimmed(spark, tmp_path):
    for n in (2, 10, 9):
        spark.range(1000).write.parquet(f"{tmp_path}/batch={n}")
    one = files.size(spark, f"{tmp_path}/batch=2")
    assert eventlog.trim_dead_letters(spark, str(tmp_path), 25 * one) == 1 and files.names(spark, str(tmp_path)) == ["batch=10", "batch=9"]
    assert eventlog.trim_dead_letters(spark, str(tmp_path), 1) == 1 and files.names(spark, str(tmp_path)) == ["batch=10"]


def test_config_is_strict():
    assert not settings.config_faults({"dedupe": {"enabled": True, "retention": "720h", "tables": {"t": {"retention": "0"}}}, "query": {"default_max_rows": 5}})
    for bad in ({"nope": {}}, {"query": {"nope": 1}}, {"query": {"default_max_rows": 0}}, {"query": {"default_max_rows": True}}, {"stream": {"subscriber_queue": 10_001}}, {"dedupe": {"retention": "90s"}}, {"dedupe": {"tables": {"t": {"retention": "x"}}}}, {"dlq": {"tables": {"t": {"on": True}}}}, {"mq": 5}):
        assert len(settings.config_faults(bad)) == 1
    s = settings.Settings(policy.Policy({}), {}, {"dedupe": {"id_field": "a", "tables": {"t": {"id_field": "b", "retention": "1h"}}}, "dlq": {"enabled": False, "tables": {"t": {"enabled": True}}}, "mq": {"max_bytes_gb": 2}})
    assert s.dedupe("t")["id_field"] == "b" and s.dedupe("u") == {"id_field": "a"} and s.retention("t") == 3600 and s.dead_letters("t") and not s.dead_letters("u") and s.log_bytes() == 2 * 10**9
    assert settings.Settings(policy.Policy({}), {}, {"dedupe": {"enabled": False, "id_field": "a"}}).dedupe("t") == {}

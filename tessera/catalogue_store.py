"""Named queries on the engine's own store: writes, accumulation, partitions, scopes and evolution, and the same in SQL.

Each query makes a store in the shared folder, loads test tables into it as a whole, changes it and returns what it holds
then. What fails by intention is returned as rows (step, kind, message or count).
"""

from __future__ import annotations

import datetime as dt
import warnings
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import catalogue as c
from tessera import schema as s
from tessera.functions import count, histogram, inc, max_, min_, percentile, set_on_insert, sum_
from tessera.functions.filters import condition
from tessera.ir import diff, ensure_ids, to_ir
from tessera.migrate import Catalog, drift, topological
from tessera.naming import key_column
from tessera.operators.writer import Writer, table_schemas
from tessera.plans.scopes import Scoped, ScopedClient, define_scope, scope_rule
from tessera.sources.catalog import columns, statistics
from tessera.sources.scratch import scratch
from tessera.sources.store import Conflict

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

area = s.define_entity("area", {"name": s.text().not_null().unique(), "note": s.text(), "lands": s.owned(s.array({"name": s.text(), "code": s.int4()})), "flag": s.owned({"color": s.text()})})
land = s.define_entity("land", {"name": s.text().not_null().unique(), "code": s.int4()})
client = s.define_entity("client", {"name": s.text().not_null(), "balance": s.float8(), "segment": s.text(), "land": s.reference(land)})
deal = s.define_entity("deal", {"status": s.text(), "total": s.float8(), "items": s.owned(s.array({"line": s.int4(), "quantity": s.float8()})), "lands": s.reference(s.array(land))})
tally = s.define_entity("tally", {"user": s.int8(), "kind": s.text(), "n": s.int8(), "high": s.float8(), "low": s.float8(), "first": s.int8()}, unique=[["user", "kind"]])
hour = s.define_entity("hour", {"ts": s.timestamptz().not_null(), "kind": s.text().not_null(), "n": s.int8(), "high": s.float8()}, unique=[["ts", "kind"]], partition_by=s.time_bucket("ts", "1d"))
reading = s.define_entity("reading", {"ts": s.timestamptz().not_null(), "user": s.int8(), "type": s.text(), "value": s.float8()}, partition_by=s.time_bucket("ts", "1d"), retention="20d")
NOW = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)


def query(name: str, sql: str) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable]:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return put


def values(rows: list[tuple], names: str) -> str:
    """Rows as SQL; names: a name and a type for each column."""
    show = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    cols = [x.split() for x in names.split(", ")]
    cast = ", ".join(f"CAST({n} AS {'BIGINT' if k == 'long' else 'DOUBLE' if k == 'double' else 'VARCHAR'}) AS {n}" for n, k in cols)
    return f"SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({', '.join(n for n, _ in cols)})"


def fixed(name: str, names: str, rows: list[tuple]) -> Callable:
    """A query whose rows, a few of them, don't depend on the tables; the decorated function gives them as a list."""

    def put(f: Callable[[SparkSession, str], list[tuple]]) -> None:
        QUERIES[name] = lambda spark, sf_dir: spark.createDataFrame(f(spark, sf_dir), names)
        ORACLE_SQL[name] = values(rows, names)

    return put


def failure(call: Callable[[], Any]) -> tuple[str, str]:
    """Kind and message of the error that a call ends in; ("", "") if it ends well."""
    try:
        call()
    except (ValueError, PermissionError, LookupError, RuntimeError) as e:
        return type(e).__name__, str(e)
    return "", ""


def writer(spark: SparkSession, *entities: s.Entity, now: list[dt.datetime] | None = None) -> Writer:
    clock = now or [NOW]
    return Writer(spark, scratch(spark, "store"), clock=lambda: clock[0]).define(*entities)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("code"))


def clients(spark: SparkSession, sf_dir: str, now: list[dt.datetime] | None = None) -> Writer:
    """A store of all nations and customers."""
    db = writer(spark, land, client, now=now)
    db.load(land, lands(spark, sf_dir))
    rows = table(spark, sf_dir, "customer")
    db.load(client, rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("landId")))
    return db


def deals(spark: SparkSession, sf_dir: str) -> Writer:
    """A store of all orders with their items, each linked to two nations."""
    db = writer(spark, land, deal)
    db.load(land, lands(spark, sf_dir))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"))).alias("items"))
    rows = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    two = F.array((F.col("o_orderkey") % 25).cast("string"), ((F.col("o_orderkey") + 1) % 25).cast("string"))
    db.load(deal, rows.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), "items", two.alias("landsIds")))
    return db


def _id() -> Expr:
    return F.col("id").cast("long").alias("id")


# writes ------------------------------------------------------------------------------------------------------------

_AREA = """SELECT CAST(r_regionkey AS BIGINT) AS id, CASE WHEN r_regionkey % 2 = 1 THEN r_name || '!' ELSE r_name END AS name, 'old' AS note,
CAST(CASE WHEN r_regionkey % 2 = 1 THEN 1 ELSE count(n_nationkey) END AS BIGINT) AS lands, CAST(CASE WHEN r_regionkey % 2 = 1 THEN -1 ELSE sum(n_nationkey) END AS BIGINT) AS codes,
CASE WHEN r_regionkey % 2 = 0 THEN 'red' END AS color FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name"""


def _areas(spark: SparkSession, sf_dir: str) -> tuple[Writer, list[dict]]:
    """All regions, created with their nations as parts; a region and a nation for each continent and country there is."""
    db = writer(spark, area)
    own = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("code"))).alias("lands"))
    found = table(spark, sf_dir, "region").join(own, F.col("n_regionkey") == F.col("r_regionkey"), "left").orderBy("r_regionkey").collect()
    inputs = [{"id": str(r.r_regionkey), "name": r.r_name, "note": "old", "lands": [x.asDict() for x in r.lands or []], "flag": {"color": "red"}} for r in found]
    return db, db.create_many(area, inputs)


def _area_rows(db: Writer) -> DataFrame:
    codes = F.aggregate("lands", F.lit(0).cast("long"), lambda a, x: a + x["code"])
    return db.find(area).select(_id(), "name", "note", F.size("lands").cast("long").alias("lands"), codes.alias("codes"), F.col("flag.color").alias("color"))


@query("d01_save", _AREA)
def d01_save(spark, sf_dir):
    db, made = _areas(spark, sf_dir)
    with db.transaction():
        for x in made:
            if int(x["id"]) % 2:  # a part or list that isn't given is cleared
                db.save(area, {"id": x["id"], "name": x["name"] + "!", "lands": [{"name": "only", "code": -1}]})
    return _area_rows(db)


@query("d02_partial", "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, CASE WHEN r_regionkey = 2 THEN 'new' ELSE 'old' END AS note, count(n_nationkey) AS lands FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
def d02_partial(spark, sf_dir):
    db, _ = _areas(spark, sf_dir)
    db.update_one(area, {"id": "2"}, {"note": "new"})
    return _area_rows(db).select("id", "name", "note", "lands")


@query("d03_create_many", "SELECT CAST(row_number() OVER (ORDER BY n_name DESC) - 1 AS BIGINT) AS at, n_name AS name, CAST(n_regionkey AS BIGINT) AS code FROM nation")
def d03_create_many(spark, sf_dir):
    db = writer(spark, land)
    made = db.create_many(land, [{"name": r["name"], "code": r["code"]} for r in lands(spark, sf_dir).orderBy(F.desc("name")).collect()])
    return spark.createDataFrame([(i, x["name"], x["code"]) for i, x in enumerate(made)], "at long, name string, code long")


@fixed("d04_cap", "kind string, message string, n long", [("QueryError", "100001 inputs; the most is 100000", 0)])
def d04_cap(spark, sf_dir):
    db = writer(spark, land)
    return [(*failure(lambda: db.create_many(land, [{"name": "x"}] * 100_001)), db.count(land))]


@query("d05_update_one", "SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN row_number() OVER (ORDER BY c_mktsegment <> 'BUILDING', c_acctbal DESC, CAST(c_custkey AS VARCHAR)) = 1 THEN 'first' ELSE c_name END AS name, c_acctbal AS balance FROM customer")
def d05_update_one(spark, sf_dir):
    db = clients(spark, sf_dir)
    db.update_one(client, {"segment": "BUILDING"}, {"name": "first"}, order_by={"balance": "desc"})
    return db.find(client).select(_id(), "name", "balance")


@query("d06_update_many", "SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS segment, CAST((SELECT count(*) FROM customer WHERE c_acctbal < 0) AS BIGINT) AS changed FROM customer")
def d06_update_many(spark, sf_dir):
    db = clients(spark, sf_dir)
    n = db.update_many(client, {"balance": {"lt": 0}}, {"segment": "DEBT"})
    return db.find(client).select(_id(), "segment", F.lit(n).cast("long").alias("changed"))


_LEFT = "SELECT CAST(l_orderkey AS BIGINT) AS id, count(*) AS items FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT ({}) GROUP BY 1"


def _items(db: Writer) -> DataFrame:
    """What the tables of items and links hold, by owner."""
    key = key_column("deal")
    items = db.store.frame("deal__items").groupBy(F.col(key).cast("long").alias("id")).agg(F.count("*").alias("items"))
    links = db.store.frame("deal__lands").groupBy(F.col("owner_id").cast("long").alias("owner")).agg(F.count("*").alias("links"))
    return items.join(links, F.col("id") == F.col("owner")).where("links = 2").select("id", "items")


@query("d07_delete_many", _LEFT.format("o_orderstatus = 'P' AND o_totalprice < 150000"))
def d07_delete_many(spark, sf_dir):
    db = deals(spark, sf_dir)
    db.delete_many(deal, {"status": "P", "total": {"lt": 150000}})
    return _items(db)


@query("d07_delete_one", _LEFT.format("o_orderkey = (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 1)"))
def d07_delete_one(spark, sf_dir):
    db = deals(spark, sf_dir)
    db.delete_one(deal, {"status": {"isNull": False}}, order_by={"total": "desc"})
    return _items(db)


@query("d07_referenced", "SELECT 'Referenced' AS kind, 'client.land refers to rows of land that would go' AS message, count(*) AS n FROM nation")
def d07_referenced(spark, sf_dir):
    db = clients(spark, sf_dir)
    kind, message = failure(lambda: db.delete_many(land, {"code": 1}))
    return db.count_rows(land).select(F.lit(kind).alias("kind"), F.lit(message).alias("message"), F.col("count").alias("n"))


@query("d08_delete_all", "SELECT 'client' AS name, (SELECT count(*) FROM customer) AS gone, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'land', 0, (SELECT count(*) FROM nation)")
def d08_delete_all(spark, sf_dir):
    db = clients(spark, sf_dir)
    return spark.createDataFrame([("client", db.delete_all(client), db.count(client)), ("land", 0, db.count(land))], "name string, gone long, n long")


@fixed("d09_where", "step string, kind string, message string", [(x, "QueryError", "a condition is needed") for x in ("update empty", "update none", "delete empty", "delete none")])
def d09_where(spark, sf_dir):
    db = writer(spark, land)
    calls = {"update empty": lambda: db.update_many(land, {}, {"code": 1}), "update none": lambda: db.update_one(land, None, {"code": 1}), "delete empty": lambda: db.delete_one(land, {}), "delete none": lambda: db.delete_many(land, None)}
    return [(step, *failure(call)) for step, call in calls.items()]


@query("d10_references", "SELECT 'object' AS name, min(n_name) FILTER (WHERE n_nationkey = 3) AS land FROM nation UNION ALL SELECT 'both', min(n_name) FILTER (WHERE n_nationkey = 4) FROM nation UNION ALL SELECT 'none', NULL")
def d10_references(spark, sf_dir):
    db = writer(spark, land, client)
    db.load(land, lands(spark, sf_dir))
    whole = db.find_one(land, {"id": "3"})
    db.create_many(client, [{"name": "object", "land": whole}, {"name": "both", "land": whole, "landId": "4"}, {"name": "none"}])
    return db.find(client, expand={"land": True}).select("name", F.col("land.name").alias("land"))


_EVENTS = "SELECT user_id, event_type, value, event_id, event_id % 3 = 0 AS early FROM events"


@query("d11_accumulate", f'SELECT user_id AS "user", event_type AS kind, count(*) AS n, max(value) AS high, min(value) AS low, coalesce(min(event_id) FILTER (WHERE early), min(event_id)) AS first FROM ({_EVENTS}) GROUP BY 1, 2')
def d11_accumulate(spark, sf_dir):
    db, rows = writer(spark, tally), table(spark, sf_dir, "events")
    deltas = rows.select(F.col("user_id").alias("user"), F.col("event_type").alias("kind"), F.lit(1).cast("long").alias("n"), F.col("value").alias("high"), F.col("value").alias("low"), F.col("event_id").alias("first"))
    for early in (True, False):
        db.accumulate_rows(tally, ["user", "kind"], {"n": "inc", "high": "max", "low": "min", "first": "setOnInsert"}, deltas.where((F.col("first") % 3 == 0) == early))
    return db.find(tally).select("user", "kind", "n", "high", "low", "first")


@query("d11_time_keys", "SELECT date_trunc('hour', ts) AS ts, event_type AS kind, count(*) AS n, max(value) AS high FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1, 2")
def d11_time_keys(spark, sf_dir):
    db, rows = writer(spark, hour), table(spark, sf_dir, "events")
    deltas = rows.select(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type").alias("kind"), F.lit(1).cast("long").alias("n"), F.col("value").alias("high"), "event_id")
    for part in (0, 1):
        db.accumulate_rows(hour, ["ts", "kind"], {"n": "inc", "high": "max"}, deltas.where(F.col("event_id") % 2 == part).drop("event_id"))
    return db.find(hour, {"ts": {"gte": "2024-01-10T00:00:00Z"}}).select(F.col("ts").cast("timestamp_ntz").alias("ts"), "kind", "n", "high")


@query("d11_returned", "SELECT CAST(n_regionkey AS BIGINT) AS \"user\", 'x' AS kind, count(*) AS n, 'createdAt first high id kind low n updatedAt user' AS keys FROM nation GROUP BY 1")
def d11_returned(spark, sf_dir):
    db = writer(spark, tally)
    codes = [r.code for r in lands(spark, sf_dir).collect()]
    db.accumulate_many(tally, [({"user": x, "kind": "x"}, {"n": inc()}) for x in codes])
    last = [db.accumulate(tally, {"kind": "x", "user": x}, {"n": inc(0)}) for x in sorted(set(codes))]
    return spark.createDataFrame([(x["user"], x["kind"], x["n"], " ".join(sorted(x))) for x in last], "user long, kind string, n long, keys string")


@fixed("d12_operations", "user long, n long, high double, low double, first long", [(1, 7, 3.0, 1.0, 5), (2, None, 2.0, None, None), (3, None, None, None, 9)])
def d12_operations(spark, sf_dir):
    """inc with a step, and on null; max and min, and on null; setOnInsert on a row that is there; an operation on a key."""
    db, key = writer(spark, tally), lambda x: {"user": x, "kind": "k"}
    db.accumulate_many(tally, [(key(1), {"n": inc(3), "high": max_(3.0), "low": min_(3.0), "first": set_on_insert(5)}), (key(3), {"first": set_on_insert(9)})])
    db.accumulate_many(tally, [(key(1), {"n": inc(4), "high": max_(1.0), "low": min_(1.0), "first": set_on_insert(6), "kind": inc()})])
    db.accumulate(tally, key(2), {"high": max_(2.0)})
    db.accumulate(tally, key(2), {"n": inc(1)})
    return [(r["user"], r["n"], r["high"], r["low"], r["first"]) for r in db.find(tally).collect()]


@fixed("d15_keys", "step string, kind string, message string", [("undeclared", "QueryError", "tally: ['user'] is not declared as unique"), ("null", "QueryError", "tally: every key has the fields ['kind', 'user']"), ("operation", "QueryError", "unknown operation avg"), ("field", "QueryError", "tally.what can't be accumulated"), ("late", "QueryError", "beyond the retention of 20d")])
def d15_keys(spark, sf_dir):
    late = s.define_entity("late", {"ts": s.timestamptz().not_null().unique(), "n": s.int8()}, partition_by=s.time_bucket("ts", "1d"), retention="20d")
    db, key = writer(spark, tally, late), {"user": 1, "kind": "k"}
    calls = {"undeclared": lambda: db.accumulate(tally, {"user": 1}, {"n": inc()}), "null": lambda: db.accumulate(tally, {"user": None, "kind": "k"}, {"n": inc()}), "operation": lambda: db.accumulate(tally, key, {"n": {"op": "avg", "value": 1}}), "field": lambda: db.accumulate(tally, key, {"what": inc()}), "late": lambda: db.accumulate(late, {"ts": "2023-12-01T00:00:00Z"}, {"n": inc()})}
    return [(step, *(lambda k, m: (k, m[m.index("beyond") :] if step == "late" else m))(*failure(call))) for step, call in calls.items()]


@query("d16_transaction", "SELECT 'inside' AS step, count(*) AS n FROM customer UNION ALL SELECT 'rolled back', 0 UNION ALL SELECT 'committed', count(*) FROM customer")
def d16_transaction(spark, sf_dir):
    db, out = writer(spark, land, client), []
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))

    def inside(fail: bool) -> None:
        with db.transaction():
            db.load(client, rows)
            if fail:
                out.append(("inside", db.count(client)))
                raise RuntimeError

    failure(lambda: inside(True))
    out.append(("rolled back", db.count(client)))
    inside(False)
    return spark.createDataFrame([*out, ("committed", db.count(client))], "step string, n long")


@query("d17_check", "SELECT step, 'Forbidden' AS kind, (SELECT count(*) FROM customer WHERE c_acctbal >= 0) AS n FROM (VALUES ('create'), ('create many'), ('load'), ('update'), ('accumulate')) AS t(step)")
def d17_check(spark, sf_dir):
    db = clients(spark, sf_dir).define(tally)
    inside = {"balance": {"gte": 0}}
    some = {"name": "x", "balance": 1.0}
    calls = {
        "create": lambda: db.create(client, some | {"balance": -1.0}, check=inside),
        "create many": lambda: db.create_many(client, [some, some | {"balance": None}], check=inside),
        "load": lambda: db.load(client, table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")), check=inside),
        "update": lambda: db.update_one(client, {"balance": {"gte": 0}}, {"balance": -5.0}, check=inside),
        "accumulate": lambda: db.accumulate(tally, {"user": 1, "kind": "k"}, {"n": inc()}, check={"n": {"gt": 1}}),
    }
    kinds = {step: failure(call)[0] for step, call in calls.items()}
    n = db.count(client, inside) + db.count(tally)
    return spark.createDataFrame([(step, kind, n) for step, kind in kinds.items()], "step string, kind string, n long")


@query("sc10_upsert", "SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 5 = 0 THEN lower(n_name) ELSE n_name END AS name, CAST(n_regionkey AS BIGINT) AS code FROM nation UNION ALL SELECT 100, 'new', 7")
def sc10_upsert(spark, sf_dir):
    db = writer(spark, land)
    db.load(land, lands(spark, sf_dir))
    with db.transaction():
        for r in lands(spark, sf_dir).where("id % 5 = 0").collect():
            db.save(land, {"id": str(r.id), "name": r["name"].lower()})
        db.save(land, {"id": "100", "name": "new", "code": 7})
    return db.find(land).select(_id(), "name", F.col("code").cast("long").alias("code"))


@query("sc09_load", "SELECT CAST(o_orderkey AS BIGINT) AS id, count(l_orderkey) AS items, round(coalesce(sum(l_quantity), 0), 2) AS quantity, o_totalprice AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice")
def sc09_load(spark, sf_dir):
    quantity = F.aggregate("items", F.lit(0.0), lambda a, x: a + x["quantity"])
    return deals(spark, sf_dir).find(deal).select(_id(), F.size("items").cast("long").alias("items"), F.round(quantity, 2).alias("quantity"), "total")


@query("sc04_links", "SELECT CAST(n_nationkey AS BIGINT) AS id, count(*) AS deals FROM nation JOIN orders ON o_orderkey % 25 = n_nationkey OR (o_orderkey + 1) % 25 = n_nationkey WHERE o_orderstatus = 'F' GROUP BY 1")
def sc04_links(spark, sf_dir):
    found = deals(spark, sf_dir).find(deal, {"status": "F"}, expand={"lands": True})
    return found.select(F.explode("lands.id").alias("id")).groupBy(_id()).agg(F.count("*").alias("deals"))


# partitions --------------------------------------------------------------------------------------------------------


def readings(spark: SparkSession, sf_dir: str, now: list[dt.datetime], where: str = "true") -> Writer:
    db = writer(spark, reading, now=now)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        db.load(reading, _readings(spark, sf_dir).where(where))
    return db


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("user"), F.col("event_type").alias("type"), "value")


@query("t01_pruned", "SELECT CAST(event_id AS BIGINT) AS id, value FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-25 12:00:00'")
def t01_pruned(spark, sf_dir):
    db = readings(spark, sf_dir, [NOW])
    return db.find(reading, {"ts": {"gte": "2024-01-20T00:00:00Z", "lt": "2024-01-25T12:00:00Z"}}).select(_id(), "value")


@fixed("t02_definitions", "step string, kind string, message string", [("field", "QueryError", "x: it can only be partitioned by a timestamptz that isn't null"), ("retention", "QueryError", "x: retention needs partitions"), ("span", "QueryError", "'1w' is no span such as 30s, 5min, 1h or 7d")])
def t02_definitions(spark, sf_dir):
    calls = {
        "field": lambda: s.define_entity("x", {"a": s.text()}, partition_by=s.time_bucket("a", "1d")),
        "retention": lambda: s.define_entity("x", {"a": s.text()}, retention="1d"),
        "span": lambda: s.time_bucket("a", "1w"),
    }
    return [(step, *failure(call)) for step, call in calls.items()]


@query("t03_buckets", "SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400 AS bucket, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-11' GROUP BY 1")
def t03_buckets(spark, sf_dir):
    db = readings(spark, sf_dir, [NOW])
    return db.store.frame("reading").groupBy(F.col("_bucket").alias("bucket")).agg(F.count("*").alias("n"))


@query("t04_lazy", "SELECT 'before' AS step, CAST(0 AS BIGINT) AS buckets UNION ALL SELECT 'after', count(DISTINCT CAST(ts AS DATE)) FROM events WHERE ts >= TIMESTAMP '2024-01-11'")
def t04_lazy(spark, sf_dir):
    seen = lambda db: len({p.split("/")[0] for p in db.store.segments().get("reading", [])})
    return spark.createDataFrame([("before", seen(writer(spark, reading))), ("after", seen(readings(spark, sf_dir, [NOW])))], "step string, buckets long")


@query("t05_expiry", "SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-11' GROUP BY 1")
def t05_expiry(spark, sf_dir):
    """The days up to the 25th are kept on the 26th; what comes on the 31st opens new buckets and drops the old ones."""
    now = [dt.datetime(2024, 1, 26, tzinfo=dt.timezone.utc)]
    db = readings(spark, sf_dir, now, "ts < '2024-01-26'")
    now[0] = NOW
    db.load(reading, _readings(spark, sf_dir).where("ts >= '2024-01-26'"))
    return db.find(reading).groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"))


@query("t06_late", "SELECT 'load' AS step, 'UserWarning' AS kind, count(*) || ' rows of reading are beyond the retention and left out' AS message FROM events WHERE ts < TIMESTAMP '2024-01-11' UNION ALL SELECT 'create', 'QueryError', 'reading.ts: 2024-01-01T00:00:00Z is beyond the retention of 20d' UNION ALL SELECT 'create many', 'UserWarning', '1 rows of reading are beyond the retention and left out' UNION ALL SELECT 'rows', '', '1'")
def t06_late(spark, sf_dir):
    def warned(call: Callable[[], Any]) -> tuple[str, str]:
        with warnings.catch_warnings(record=True) as seen:
            warnings.simplefilter("always")
            call()
        found = [w for w in seen if "retention" in str(w.message)]
        return found[0].category.__name__, str(found[0].message)

    db, other = writer(spark, reading), writer(spark, reading)
    rows = [("load", *warned(lambda: other.load(reading, _readings(spark, sf_dir)))), ("create", *failure(lambda: db.create(reading, {"ts": "2024-01-01T00:00:00Z"})))]
    rows.append(("create many", *warned(lambda: db.create_many(reading, [{"ts": "2024-01-01T00:00:00Z"}, {"ts": "2024-01-30T00:00:00Z"}]))))
    return spark.createDataFrame([*rows, ("rows", "", str(db.count(reading)))], "step string, kind string, message string")


@fixed("t07_times", "step string, kind string, message string", [("text", "QueryError", "'never' is no time"), ("none", "QueryError", "None is no time"), ("number", "QueryError", "5 is no time")])
def t07_times(spark, sf_dir):
    db = writer(spark, reading)
    return [(step, *failure(lambda: db.create(reading, {"ts": x}))) for step, x in (("text", "never"), ("none", None), ("number", 5))]


# scopes ------------------------------------------------------------------------------------------------------------


@fixed("x01_verbs", "step string, kind string, message string", [("read", "", ""), ("no rule", "Forbidden", "the scope some can't read region"), ("no verb", "Forbidden", "the scope some can't delete order"), ("no scope", "", "")])
def x01_verbs(spark, sf_dir):
    e = c.engine(spark, sf_dir)
    scoped = Scoped(e, define_scope("some", [scope_rule(c.order)]))
    calls = {"read": lambda: scoped.count(c.order), "no rule": lambda: scoped.find(c.region), "no verb": lambda: scoped.delete_many(c.order, {"status": "F"}), "no scope": lambda: Scoped(e, None).count(c.region)}
    return [(step, *failure(call)) for step, call in calls.items()]


_FINISHED = define_scope("finished", [scope_rule(c.order, where={"status": "F"})])


@query("x02_rows", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice > 200000 OR o_orderstatus = 'O')")
def x02_rows(spark, sf_dir):
    return Scoped(c.engine(spark, sf_dir), _FINISHED).find(c.order, {"or": [{"total": {"gt": 200000}}, {"status": "O"}]}).select("id")


@query("x02_aggregate", "SELECT 'priority' AS facet, o_orderpriority AS name, CAST(count(*) AS DOUBLE) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 2 UNION ALL SELECT 'status', o_orderstatus, CAST(count(*) AS DOUBLE) FROM orders WHERE o_orderstatus = 'F' GROUP BY 2")
def x02_aggregate(spark, sf_dir):
    facets = {"priority": {"groupBy": {"name": "priority"}, "select": {"n": count()}}, "status": {"groupBy": {"name": "status"}, "select": {"n": count()}}}
    found = Scoped(c.engine(spark, sf_dir), _FINISHED).aggregate(c.order, select={"n": count()}, facets=facets).facets
    return found["priority"].select(F.lit("priority").alias("facet"), "name", "n").union(found["status"].select(F.lit("status"), "name", "n"))


@query("x02_writes", "SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 1000 THEN 'poor' ELSE c_name END AS name FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_acctbal >= 9000)")
def x02_writes(spark, sf_dir):
    db = clients(spark, sf_dir)
    scoped = Scoped(db, define_scope("own", [scope_rule(client, ("read", "update", "delete"), {"segment": {"param": "mine"}})]), {"mine": "BUILDING"})
    scoped.update_many(client, {"balance": {"lt": 1000}}, {"name": "poor"})
    scoped.delete_many(client, {"balance": {"gte": 9000}})
    return db.find(client).select(_id(), "name")


@query("x03_params", "SELECT o_orderkey AS id, '' AS message FROM orders WHERE o_custkey = 42 UNION ALL SELECT NULL, 'MissingParam: the scope needs the parameter me'")
def x03_params(spark, sf_dir):
    e, scope = c.engine(spark, sf_dir), define_scope("own", [scope_rule(c.order, where={"customerId": {"param": "me"}})])
    missing = ": ".join(failure(lambda: Scoped(e, scope).find(c.order)))
    rows = Scoped(e, scope, {"me": 42}).find(c.order).select("id", F.lit("").alias("message"))
    return rows.union(spark.createDataFrame([(None, missing)], "id long, message string"))


@query("x04_exclude", "SELECT c_custkey AS id, c_name AS name, c_nationkey AS \"nationId\", 'id name nationId createdAt updatedAt' AS fields FROM customer")
def x04_exclude(spark, sf_dir):
    found = Scoped(c.engine(spark, sf_dir), define_scope("some", [scope_rule(c.customer, fields={"exclude": ["acctbal", "segment"]})])).find(c.customer)
    return found.select("id", "name", "nationId", F.lit(" ".join(found.columns)).alias("fields"))


@query("x04_include", "SELECT o_orderkey AS id, o_totalprice AS total, count(l_orderkey) AS items, round(coalesce(sum(l_quantity), 0), 2) AS quantity, 'id total items: id quantity' AS fields FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice")
def x04_include(spark, sf_dir):
    found = Scoped(c.engine(spark, sf_dir), define_scope("some", [scope_rule(c.order, fields={"include": ["total", "items.quantity"]})])).find(c.order)
    inner = found.schema["items"].dataType.elementType.names
    quantity = F.aggregate("items", F.lit(0.0), lambda a, x: a + x["quantity"])
    return found.select("id", "total", F.size("items").cast("long").alias("items"), F.round(quantity, 2).alias("quantity"), F.lit(f"{' '.join(found.columns)}: {' '.join(inner)}").alias("fields"))


@query("x05_reached", "SELECT c_custkey AS id, n_name AS nation, 'id name' AS fields FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def x05_reached(spark, sf_dir):
    """A reached entity's fields are cut, its row filter does not hold."""
    scope = define_scope("some", [scope_rule(c.customer), scope_rule(c.nation, where={"name": "none"}, fields={"include": ["name"]})])
    found = Scoped(c.engine(spark, sf_dir), scope).find(c.customer, expand={"nation": True})
    return found.select("id", F.col("nation.name").alias("nation"), F.lit(" ".join(found.schema["nation"].dataType.names)).alias("fields"))


@fixed("x05_unreached", "step string, kind string, message string", [("expand", "Forbidden", "the scope some can't read nation"), ("select", "Forbidden", "the scope some can't read nation"), ("auto", "", "acctbal createdAt id name nationId segment updatedAt")])
def x05_unreached(spark, sf_dir):
    scoped = Scoped(c.engine(spark, sf_dir), define_scope("some", [scope_rule(c.customer)]))
    auto = " ".join(sorted(scoped.find(c.customer, expand="auto").columns))
    return [("expand", *failure(lambda: scoped.find(c.customer, expand={"nation": True}))), ("select", *failure(lambda: scoped.find(c.customer, select={"nation": {"name": True}}))), ("auto", "", auto)]


@query("x06_check", "SELECT step, 'Forbidden' AS kind, (SELECT count(*) FROM customer) AS n FROM (VALUES ('create'), ('update')) AS t(step)")
def x06_check(spark, sf_dir):
    db = clients(spark, sf_dir)
    scoped = Scoped(db, define_scope("own", [scope_rule(client, ("read", "create", "update"), {"segment": {"in": ["BUILDING", "MACHINERY"]}})]))
    calls = {"create": lambda: scoped.create(client, {"name": "x", "segment": "OTHER"}), "update": lambda: scoped.update_one(client, {"segment": "BUILDING"}, {"segment": "OTHER"})}
    kinds = [(step, failure(call)[0]) for step, call in calls.items()]
    return spark.createDataFrame([(*x, db.count(client)) for x in kinds], "step string, kind string, n long")


@query("x07_stored", "SELECT CAST(c_custkey AS BIGINT) AS id, c_mktsegment AS sector FROM customer WHERE c_mktsegment = 'BUILDING'")
def x07_stored(spark, sf_dir):
    """A scope that was kept before a field got another name."""
    db = clients(spark, sf_dir)
    catalog = Catalog(db)
    catalog.push([land, client])
    made = catalog.entities()["client"]
    catalog.save_scope(define_scope("own", [scope_rule(made, where={"segment": {"param": "mine"}, "createdAt": {"isNull": False}}, fields={"exclude": ["balance"]})]))
    catalog.apply(s.define_entity("client", {("sector" if f == "segment" else f): n for f, n in made.shape.items()}))
    found = Scoped(catalog.writer, Catalog(Writer(spark, db.store.folder)).scope("own"), {"mine": "BUILDING"}).find("client")
    return found.select(_id(), "sector", *[x for x in found.columns if x == "balance"])


@query("x08_paths", "SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND n_name >= 'NATION_2' AND o_custkey < 1000")
def x08_paths(spark, sf_dir):
    rule = scope_rule(c.order, where={"customer.segment": "BUILDING", "customer.nation.name": {"gte": "NATION_2"}, "customerId": {"lt": 1000}})
    return Scoped(c.engine(spark, sf_dir), define_scope("paths", [rule])).find(c.order).select("id")


@query("x09_ambient", "SELECT step, kind, n FROM (VALUES ('outside', 'Forbidden', NULL), ('guest', 'Forbidden', NULL)) AS t(step, kind, n) UNION ALL SELECT 'run as', '', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'first rule', '', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'all', '', count(*) FROM orders")
def x09_ambient(spark, sf_dir):
    e, every = c.engine(spark, sf_dir), define_scope("all", [scope_rule(c.order)])
    ambient = ScopedClient(e, [(lambda who: who == "clerk", _FINISHED), (lambda who: who in ("clerk", "boss"), every)])
    rows = [("outside", failure(lambda: ambient.count(c.order))[0], None), ("guest", failure(lambda: ambient.dispatch("guest"))[0], None)]
    with ambient.run_as(_FINISHED):
        rows.append(("run as", "", ambient.count(c.order)))
    with ambient.dispatch("clerk"):
        rows.append(("first rule", "", ambient.count(c.order)))
    with ambient.dispatch("boss"):
        rows.append(("all", "", ambient.count(c.order)))
    return spark.createDataFrame(rows, "step string, kind string, n long")


@query("x10_not", "SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 100000)")
def x10_not(spark, sf_dir):
    rule = scope_rule(c.order, where={"not": {"or": [{"status": "F"}, {"total": {"gt": 100000}}]}})
    return Scoped(c.engine(spark, sf_dir), define_scope("rest", [rule])).find(c.order).select("id")


# errors ------------------------------------------------------------------------------------------------------------


@fixed(
    "e_reads",
    "step string, kind string, message string",
    [
        ("F13 operator", "QueryError", "order.status: unknown operator equals"),
        ("F13 empty", "QueryError", "order.status: {} has no operator"),
        ("F19 operator", "QueryError", "sentence.words: unknown operator like"),
        ("F20 list", "QueryError", "sentence.words: a list is asked by"),
        ("F29 quantifier", "QueryError", "order.items: unknown quantifier all"),
        ("F30 value", "QueryError", "order.customer: a relationship is asked by an object"),
        ("F34 field", "QueryError", "order has no field what"),
        ("F36 word", "QueryError", "ts: contains doesn't go with timestamp"),
        ("O10 list", "QueryError", "order.items: an order goes through single references and parts only"),
        ("O10 branches", "QueryError", "order.customer: an order has one branch"),
        ("P3 field", "QueryError", "order has no field what to select"),
        ("P2 scalar", "QueryError", "order.status can't be expanded"),
        ("A8 share", "QueryError", "percentile: p is between 0 and 1"),
        ("A9 bounds", "QueryError", "histogram: bounds are finite and ascend"),
        ("A19 list", "QueryError", "items is a list"),
        ("A31 alias", "QueryError", "type is both a group and a result"),
        ("A32 select", "QueryError", "select is empty"),
        ("A2 field", "QueryError", "sum: type is no number"),
    ],
)
def e_reads(spark, sf_dir):
    """What reads and aggregates don't accept, by the number of the operator."""
    e = c.engine(spark, sf_dir)
    calls = {
        "F13 operator": lambda: e.find(c.order, {"status": {"equals": "F"}}),
        "F13 empty": lambda: e.find(c.order, {"status": {}}),
        "F19 operator": lambda: e.find(c.sentence, {"words": {"like": "a"}}),
        "F20 list": lambda: e.find(c.sentence, {"words": ["a"]}),
        "F29 quantifier": lambda: e.find(c.order, {"items": {"all": {}}}),
        "F30 value": lambda: e.find(c.order, {"customer": 5}),
        "F34 field": lambda: e.find(c.order, {"what": 1}),
        "F36 word": lambda: condition("ts", s.timestamp(), "contains", "x"),
        "O10 list": lambda: e.find(c.order, order_by={"items": {"line": "asc"}}),
        "O10 branches": lambda: e.find(c.order, order_by={"customer": {"name": "asc", "segment": "asc"}}),
        "P3 field": lambda: e.find(c.order, select={"what": True}),
        "P2 scalar": lambda: e.find(c.order, expand={"status": True}),
        "A8 share": lambda: e.aggregate(c.event, select={"p": percentile("value", 1.5)}).rows,
        "A9 bounds": lambda: e.aggregate(c.event, select={"h": histogram("value", [5, 1])}).rows,
        "A19 list": lambda: e.aggregate(c.order, groupBy=["items.flag"], select={"n": count()}).rows,
        "A31 alias": lambda: e.aggregate(c.event, groupBy=["type"], select={"type": count()}).rows,
        "A32 select": lambda: e.aggregate(c.event, groupBy=["type"], select={}).rows,
        "A2 field": lambda: e.aggregate(c.event, select={"x": sum_("type")}).rows,
    }
    cut = lambda kind, message: (kind, message.split("; ")[0].split(" [")[0])  # without the lists of what there is
    return [(step, *cut(*failure(call))) for step, call in calls.items()]


# evolution ---------------------------------------------------------------------------------------------------------


@fixed("s01_tables", "name string, columns string", [("deal", "created_at id status total updated_at"), ("deal__items", "created_at deal_id id line quantity updated_at"), ("deal__lands", "owner_id target_id")])
def s01_tables(spark, sf_dir):
    return [(name, " ".join(sorted(schema.names))) for name, schema in table_schemas("deal", s.resolve(deal.shape)).items()]


@fixed("s02_empty", "name string, n long, columns string", [("area", 0, "id name note lands flag createdAt updatedAt"), ("land", 0, "id name code createdAt updatedAt")])
def s02_empty(spark, sf_dir):
    db = writer(spark, area, land)
    return [(e.name, db.count(e), " ".join(db.find(e).columns)) for e in (area, land)]


@fixed("s03_drift", "message string", [("land.code is missing",), ("land.name is int, not string",), ("land.other is unknown",)])
def s03_drift(spark, sf_dir):
    db = writer(spark, land)
    db.load(land, lands(spark, sf_dir))
    assert drift(db, land) == []
    found = db.store.frame("land").select("id", "created_at", "updated_at", F.col("code").alias("name"), F.col("name").alias("other"))
    found.write.parquet(f"{db.store.folder}/tables/land/foreign")
    with db.transaction():
        db.store._stage("land", ["foreign"])
    return [(x,) for x in drift(db, land)]


@fixed("s04_commits", "step string, kind string, n long", [("first", "", 1), ("second", "Conflict", 1)])
def s04_commits(spark, sf_dir):
    """Two writers of one store: the second one to commit learns of it, and nothing of it counts."""
    one = writer(spark, land)
    two = Writer(spark, one.store.folder, clock=one.clock).define(land)
    out = []

    def late() -> None:
        with two.transaction():
            two.create(land, {"name": "b"})
            out.append(("first", *failure(lambda: one.create(land, {"name": "a"}))[:1], one.count(land)))

    kind = failure(late)[0]
    assert issubclass(Conflict, RuntimeError)
    return [*out, ("second", kind, two.count(land))]


def _changed() -> tuple[dict, dict]:
    """A definition and a later one that shares its field ids."""
    old = ensure_ids(to_ir(s.define_entity("x", {"a": s.text(), "b": s.int4(), "c": s.text().unique(), "d": s.owned({"x": s.text()}), "e": s.text(), "g": s.text()}, unique=[["a", "b"]])))
    new = {**old, "fields": {k: dict(v) for k, v in old["fields"].items()}, "unique": [], "index": [["a2", "c"]]}
    new["fields"]["a2"] = new["fields"].pop("a") | {"notNull": True}
    new["fields"]["b"] |= {"type": "text", "index": True, "default": "z"}
    new["fields"]["c"] = {k: v for k, v in new["fields"]["c"].items() if k != "unique"}
    new["fields"]["d"] |= {"array": True}
    new["fields"]["g"] |= {"unique": True}
    del new["fields"]["e"]
    new["fields"]["f"] = {"kind": "column", "type": "text", "notNull": True, "id": "f"}
    new["fields"]["h"] = {"kind": "column", "type": "text", "id": "h"}
    return old, new


@fixed(
    "s05_diff",
    "op string, path string, risk string",
    [("removeField", "e", "confirm"), ("renameField", "a2", "auto"), ("makeRequired", "a2", "needsValue"), ("retypeField", "b", "blocked"), ("addIndex", "b", "auto"), ("changeDefault", "b", "auto"), ("dropUnique", "c", "auto"), ("reshape", "d", "blocked"), ("addUnique", "g", "blocked"), ("addField", "f", "needsValue"), ("addField", "h", "auto"), ("dropCompositeUnique", "a,b", "auto"), ("addCompositeIndex", "a2,c", "auto")],
)
def s05_diff(spark, sf_dir):
    return [(x.op, x.path, x.risk) for x in diff(*_changed()).changes]


@fixed("s06_probes", "op string, path string, risk string", [("addUnique", "name", "auto"), ("addUnique", "segment", "blocked"), ("makeRequired", "balance", "auto"), ("makeRequired", "note", "needsValue"), ("addField", "fresh", "needsValue")])
def s06_probes(spark, sf_dir):
    """What the data says: names are unique and segments aren't; balances are all there and notes aren't."""
    person = {"name": s.text(), "segment": s.text(), "balance": s.float8(), "note": s.text()}
    catalog = Catalog(writer(spark))
    catalog.push([s.define_entity("person", person)])
    made = catalog.entities()["person"]
    catalog.writer.load(made, table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")))
    shape = dict(made.shape)
    shape |= {"name": shape["name"].unique(), "segment": shape["segment"].unique(), "balance": shape["balance"].not_null(), "note": shape["note"].not_null(), "fresh": s.int4().not_null()}
    return [(x.op, x.path, x.risk) for x in catalog.plan(s.define_entity("person", shape)).changes]


def _people(spark: SparkSession, sf_dir: str) -> Catalog:
    catalog = Catalog(writer(spark))
    catalog.push([s.define_entity("person", {"name": s.text(), "segment": s.text(), "balance": s.float8(), "note": s.text()})])
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    catalog.writer.load(catalog.entities()["person"], rows)
    return catalog


@query("s07_apply", "SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS title, greatest(c_acctbal, 0) AS balance, 'new' AS state, 'id title balance state createdAt updatedAt' AS fields FROM customer")
def s07_apply(spark, sf_dir):
    """A new name, a field that gets required and filled, one that goes, and one that comes with a default."""
    catalog = _people(spark, sf_dir)
    shape = catalog.entities()["person"].shape
    later = {"title": shape["name"], "balance": shape["balance"].not_null(), "state": s.text().default("new")}
    catalog.apply(s.define_entity("person", later), confirm=["segment", "note"], fill={"balance": 0.0})
    found = Catalog(Writer(spark, catalog.store.folder)).writer.find("person")
    return found.select(_id(), "title", "balance", "state", F.lit(" ".join(found.columns)).alias("fields"))


@query("s07_swap", "SELECT CAST(c_custkey AS BIGINT) AS id, c_mktsegment AS name, c_name AS segment FROM customer")
def s07_swap(spark, sf_dir):
    catalog = _people(spark, sf_dir)
    shape = catalog.entities()["person"].shape
    catalog.apply(s.define_entity("person", {{"name": "segment", "segment": "name"}.get(f, f): n for f, n in shape.items()}))
    return catalog.writer.find("person").select(_id(), "name", "segment")


@query("s07_swap_parts", "SELECT CAST(o_orderkey AS BIGINT) AS id, count(l_orderkey) AS b, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS a FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def s07_swap_parts(spark, sf_dir):
    """Two lists of parts change names: the items are in b then, and one part of every second order in a."""
    catalog = Catalog(writer(spark))
    catalog.push([s.define_entity("basket", {"a": s.owned(s.array({"n": s.int4()})), "b": s.owned(s.array({"n": s.int4()}))})])
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("n"))).alias("a"))
    rows = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    one = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.struct(F.lit(7).alias("n"))))
    catalog.writer.load(catalog.entities()["basket"], rows.select(F.col("o_orderkey").alias("id"), "a", one.alias("b")))
    shape = catalog.entities()["basket"].shape
    catalog.apply(s.define_entity("basket", {"a": shape["b"], "b": shape["a"]}))
    return catalog.writer.find("basket").select(_id(), F.size("b").cast("long").alias("b"), F.size("a").cast("long").alias("a"))


@fixed("s08_gate", "step string, done string, held string", [("loss", "false", "removeField segment"), ("value", "false", "makeRequired balance"), ("blocked", "false", "retypeField name"), ("dry", "false", ""), ("confirmed", "true", "")])
def s08_gate(spark, sf_dir):
    catalog = _people(spark, sf_dir)
    shape, out = dict(catalog.entities()["person"].shape), []
    without = {f: n for f, n in shape.items() if f != "segment"}

    def step(name: str, later: dict, **how: Any) -> None:
        done = catalog.apply(s.define_entity("person", later), **how)
        held = [f"{x.op} {x.path}" for x in done.plan.changes if x.risk != "auto"] if name not in ("dry", "confirmed") else []
        out.append((name, str(done.done).lower(), " ".join(held)))

    step("loss", without)
    step("value", shape | {"balance": shape["balance"].not_null()})
    step("blocked", shape | {"name": s.int4().with_id(shape["name"].key)})
    step("dry", without, confirm=True, dry=True)
    step("confirmed", without, confirm=["segment"])
    return out


@fixed("s08_pending", "step string, pending string", [("held", "cli: person removeField segment"), ("resolved", "")])
def s08_pending(spark, sf_dir):
    catalog = _people(spark, sf_dir)
    later = s.define_entity("person", {f: n for f, n in catalog.entities()["person"].shape.items() if f != "segment"})
    show = lambda p: f"{p['source']}: " + " ".join(f"{e['name']} {x['op']} {x['path']}" for e in p["entries"] for x in e["changes"]) if p else ""
    catalog.push([later], source="cli")
    held = show(Catalog(Writer(spark, catalog.store.folder)).pending())
    catalog.push([later], confirm={"person": ["segment"]})
    return [("held", held), ("resolved", show(catalog.pending()))]


@query("s09_push", "SELECT CAST(c_custkey AS BIGINT) AS id, c_mktsegment AS sector, 'land client' AS pushed, 'own' AS scopes FROM customer WHERE c_mktsegment = 'BUILDING'")
def s09_push(spark, sf_dir):
    """Entities in the order of their references, a rename by name, and a scope once all went through."""
    db = clients(spark, sf_dir)
    catalog = Catalog(db)
    first = catalog.push([client, land])
    later = s.define_entity("client", {"name": s.text().not_null(), "balance": s.float8(), "sector": s.text(), "land": s.reference(land)})
    _, saved = catalog.push_all([later, land], [define_scope("own", [scope_rule(later, where={"sector": "BUILDING"})])], renames={"client": {"segment": "sector"}})
    found = Scoped(catalog.writer, catalog.scope("own")).find("client")
    return found.select(_id(), "sector", F.lit(" ".join(first)).alias("pushed"), F.lit(" ".join(saved)).alias("scopes"))


# the store itself --------------------------------------------------------------------------------------------------


@fixed("sc06_kept", "name string, fields string", [("client", "balance land name segment"), ("land", "code name")])
def sc06_kept(spark, sf_dir):
    catalog = Catalog(writer(spark))
    catalog.push([client, land])
    again = Catalog(Writer(spark, catalog.store.folder)).entities()
    assert [e.name for e in topological(list(again.values()))] == ["land", "client"]
    return [(name, " ".join(sorted(e.shape))) for name, e in again.items()]


@fixed("sc07_columns", "name string, type string", [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")])
def sc07_columns(spark, sf_dir):
    return [(name, kind.simpleString()) for name, kind in columns(c.engine(spark, sf_dir), "customer").items()]


@query("sc08_statistics", "SELECT 'client' AS name, count(*) AS objects, CAST(4 AS BIGINT) AS fields FROM customer UNION ALL SELECT 'land', count(*), 2 FROM nation")
def sc08_statistics(spark, sf_dir):
    return spark.createDataFrame([(x.name, x.objects, x.fields) for x in statistics(clients(spark, sf_dir))], "name string, objects long, fields long")


@query("sc11_formats", "SELECT format, CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) AS t(format)")
def sc11_formats(spark, sf_dir):
    from tessera.engine import Engine
    from tessera.sources.binding import Binding, files

    folder, rows, out = scratch(spark, "formats"), lands(spark, sf_dir), []
    for form in ("csv", "json", "orc", "parquet"):
        options = {"header": "true"} if form == "csv" else {}
        rows.write.format(form).options(**options).save(f"{folder}/{form}")
        e = Engine(spark).bind(land, Binding(files(spark, f"{folder}/{form}", form, "id long, name string, code int" if form in ("csv", "json") else None, **options)))
        out.append(e.find(land).select(F.lit(form).alias("format"), F.col("id").cast("long").alias("id"), "name"))
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("w_updated_at", "SELECT CAST(n_nationkey AS BIGINT) AS id, TIMESTAMP '2024-01-31' AS created, CASE WHEN n_regionkey = 1 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-31' END AS updated FROM nation")
def w_updated_at(spark, sf_dir):
    now = [NOW]
    db = writer(spark, land, now=now)
    db.load(land, lands(spark, sf_dir))
    now[0] = NOW + dt.timedelta(days=1)
    db.update_many(land, {"code": 1}, {"code": 9})
    return db.find(land).select(_id(), F.col("createdAt").cast("timestamp_ntz").alias("created"), F.col("updatedAt").cast("timestamp_ntz").alias("updated"))


@query("t_aggregate", "SELECT event_type AS type, CAST(count(*) AS DOUBLE) AS n, round(sum(value), 6) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1")
def t_aggregate(spark, sf_dir):
    db = readings(spark, sf_dir, [NOW])
    rows = db.aggregate(reading, where={"ts": {"gte": "2024-01-15T00:00:00Z"}}, groupBy=["type"], select={"n": count(), "total": sum_("value")}).rows
    return rows.withColumn("total", F.round("total", 6))

"""Named queries over the test tables, one or more for each operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema as s
from tessera.engine import Engine
from tessera.functions import add, avg, count, distinct, div, first, histogram, max_, min_, mul, percentile, sub, sum_, time_bucket
from tessera.functions.filters import condition
from tessera.plans.predicates import UNSET
from tessera.sources.binding import Binding, files

region = s.define_entity("region", {"name": s.text().not_null()})
nation = s.define_entity("nation", {"name": s.text(), "region": s.reference(region)})
customer = s.define_entity("customer", {"name": s.text(), "acctbal": s.float8(), "segment": s.text(), "nation": s.reference(nation)})
supplier = s.define_entity("supplier", {"name": s.text(), "acctbal": s.float8(), "nation": s.reference(nation)})
part = s.define_entity("part", {"name": s.text(), "brand": s.text(), "kind": s.text(), "size": s.int4(), "price": s.float8(), "suppliers": s.reference(s.array(supplier))})
ITEM = {
    "line": s.int4(),
    "quantity": s.float8(),
    "price": s.float8(),
    "discount": s.float8(),
    "tax": s.float8(),
    "flag": s.text(),
    "status": s.text(),
    "part": s.reference(part),
    "supplier": s.reference(supplier),
}
order = s.define_entity("order", {"status": s.text(), "total": s.float8(), "date": s.timestamp(), "priority": s.text(), "customer": s.reference(customer), "items": s.owned(s.array(ITEM))})
event = s.define_entity("event", {"ts": s.timestamp(), "user": s.int8(), "type": s.text(), "value": s.float8(), "props": s.jsonb()})
document = s.define_entity("document", {"text": s.text(), "lang": s.text(), "source": s.text(), "chars": s.int8(), "label": s.owned({"quality": s.int4(), "toxic": s.int4()})})
embedding = s.define_entity("embedding", {"vector": s.array(s.float4()), "label": s.int4()})
sentence = s.define_entity("sentence", {"words": s.array(s.text()), "numbers": s.array(s.text()), "source": s.text()})
person = s.define_entity("person", {"name": s.text(), "sponsor": s.reference(s.self_ref())})
message = s.define_entity("message", {"conv": s.int8(), "turn": s.int4(), "role": s.text(), "text": s.text()})


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """All entities, bound to the tables of a folder."""
    at = lambda name: files(spark, f"{sf_dir}/{name}.parquet")
    date = F.col("o_orderdate").cast("timestamp_ntz")
    items = Binding(at("lineitem"), parent="l_orderkey", columns={"id": None, "createdAt": "l_shipdate", "line": "l_linenumber", "quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "flag": "l_returnflag", "status": "l_linestatus", "partId": "l_partkey", "supplierId": "l_suppkey"})
    return (
        Engine(spark)
        .bind(region, Binding(at("region"), {"id": "r_regionkey", "name": "r_name"}))
        .bind(nation, Binding(at("nation"), {"id": "n_nationkey", "name": "n_name", "regionId": "n_regionkey"}))
        .bind(customer, Binding(at("customer"), {"id": "c_custkey", "name": "c_name", "acctbal": "c_acctbal", "segment": "c_mktsegment", "nationId": "c_nationkey"}))
        .bind(supplier, Binding(at("supplier"), {"id": "s_suppkey", "name": "s_name", "acctbal": "s_acctbal", "nationId": "s_nationkey"}))
        .bind(part, Binding(at("part"), {"id": "p_partkey", "name": "p_name", "brand": "p_brand", "kind": "p_type", "size": "p_size", "price": "p_retailprice"}, links={"suppliers": (at("lineitem"), "l_partkey", "l_suppkey")}))
        .bind(order, Binding(at("orders"), {"id": "o_orderkey", "createdAt": date, "date": date, "status": "o_orderstatus", "total": "o_totalprice", "priority": "o_orderpriority", "customerId": "o_custkey"}, parts={"items": items}))
        .bind(event, Binding(at("events"), {"id": "event_id", "createdAt": "ts", "user": "user_id", "type": "event_type"}))
        .bind(document, Binding(at("documents"), {"id": "doc_id", "chars": "n_chars"}, parts={"label": Binding(at("labels"), {"id": None}, parent="doc_id")}))
        .bind(embedding, Binding(at("embeddings"), {"id": "vec_id", "vector": "embedding"}))
        .bind(sentence, Binding(at("documents"), {"id": "doc_id", "words": F.split("text", " "), "numbers": F.expr("regexp_extract_all(text, '[0-9]+', 0)")}))
        .bind(person, Binding(at("customer"), {"id": "c_custkey", "name": "c_name", "sponsorId": F.expr("CASE WHEN c_custkey > 0 THEN c_custkey DIV 2 END")}))
        .bind(message, Binding(at("conversations"), {"id": None, "conv": "conv_id"}))
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Callable[[Engine], DataFrame]], None]:
    def put(f: Callable[[Engine], DataFrame]) -> None:
        QUERIES[name] = lambda spark, sf_dir: f(engine(spark, sf_dir))
        ORACLE_SQL[name] = sql

    return put


def _find(name: str, what: Any, where: Any, sql: str, select: str = "id", **how: Any) -> None:
    """A find of which the named columns are compared with SQL."""
    query(name, sql)(lambda e: e.find(what, where, **how).select(*select.split()))


# filters -----------------------------------------------------------------------------------------------------------

_O = "SELECT o_orderkey AS id FROM orders WHERE "
for _name, _where, _sql in (
    ("f01_eq", {"status": "F"}, "o_orderstatus = 'F'"),
    ("f01_eq_operator", {"status": {"eq": "F"}}, "o_orderstatus = 'F'"),
    ("f01_eq_null", {"status": None}, "o_orderstatus IS NULL"),
    ("f02_ne", {"status": {"ne": "F"}}, "o_orderstatus <> 'F'"),
    ("f02_ne_null", {"status": {"ne": None}}, "o_orderstatus IS NOT NULL"),
    ("f03_gt", {"total": {"gt": 200000}}, "o_totalprice > 200000"),
    ("f04_gte", {"total": {"gte": 200000}}, "o_totalprice >= 200000"),
    ("f05_lt", {"total": {"lt": 50000}}, "o_totalprice < 50000"),
    ("f06_lte", {"total": {"lte": 50000}}, "o_totalprice <= 50000"),
    ("f07_in", {"priority": {"in": ["1-URGENT", "2-HIGH"]}}, "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    ("f07_in_empty", {"priority": {"in": []}}, "false"),
    ("f08_not_in", {"priority": {"notIn": ["1-URGENT", "2-HIGH"]}}, "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"),
    ("f08_not_in_empty", {"priority": {"notIn": []}}, "true"),
    ("f11_is_null", {"status": {"isNull": False}}, "o_orderstatus IS NOT NULL"),
    ("f12_several", {"total": {"gte": 100000, "lt": 150000}}, "o_totalprice >= 100000 AND o_totalprice < 150000"),
    ("f21_and", {"and": [{"status": "O"}, {"total": {"gt": 150000}}, {}]}, "o_orderstatus = 'O' AND o_totalprice > 150000"),
    ("f21_or", {"or": [{"status": "P"}, {"total": {"gt": 300000}}]}, "o_orderstatus = 'P' OR o_totalprice > 300000"),
    ("f21_or_empty", {"or": []}, "true"),
    ("f22_not", {"not": {"status": "F", "total": {"gt": 100000}}}, "NOT (o_orderstatus = 'F' AND o_totalprice > 100000)"),
    ("f24_managed", {"createdAt": {"gte": "1997-01-01"}, "id": {"lt": 5000}}, "o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderkey < 5000"),
    ("f26_some", {"items": {"some": {"quantity": {"gt": 45}}}}, "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)"),
    ("f26_some_any", {"items": {"some": {}}}, "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    ("f26_or_exists", {"or": [{"status": "F"}, {"items": {"some": {"quantity": {"gt": 49}}}}]}, "o_orderstatus = 'F' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)"),
    ("f27_none", {"items": {"none": {"flag": "R"}}}, "NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"),
    ("f28_every", {"items": {"every": {"quantity": {"lt": 40}}}}, "NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT l_quantity < 40)"),
    ("f29_quantifiers", {"items": {"some": {"flag": "R"}, "none": {"flag": "A"}}}, "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')"),
    ("f30_reference", {"customer": {"segment": "BUILDING"}}, "EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')"),
    ("f30_not_reference", {"not": {"customer": {"segment": "BUILDING"}}}, "NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')"),
    ("f31_reference_id", {"customerId": {"lt": 100}}, "o_custkey < 100"),
    ("f33_deep", {"customer": {"nation": {"region": {"name": "ASIA"}}}}, "EXISTS (SELECT 1 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey = o_custkey AND r_name = 'ASIA')"),
    ("f33_part_reference", {"items": {"some": {"supplier": {"acctbal": {"lt": 0}}}}}, "EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey = o_orderkey AND s_acctbal < 0)"),
):
    _find(_name, order, _where, _O + _sql)

_find("f09_like", part, {"name": {"like": "%a%e%"}}, "SELECT p_partkey AS id FROM part WHERE p_name LIKE '%a%e%'")
_find("f10_ilike", part, {"name": {"ilike": "%A%E%"}}, "SELECT p_partkey AS id FROM part WHERE p_name ILIKE '%A%E%'")
_find("f14_json", event, {"props": {"k": 9}}, "SELECT event_id AS id FROM events WHERE CAST(props->>'k' AS INT) = 9 AND len(json_keys(props)) = 1")
_find("f14_json_in", event, {"props": {"in": [{"k": 1}, {"k": 58}]}}, "SELECT event_id AS id FROM events WHERE CAST(props->>'k' AS INT) IN (1, 58) AND len(json_keys(props)) = 1")
_find("f14_json_ne", event, {"props": {"ne": {"k": 9}}}, "SELECT event_id AS id FROM events WHERE NOT (CAST(props->>'k' AS INT) = 9 AND len(json_keys(props)) = 1)")
_WORDS = "SELECT doc_id AS id FROM documents, (SELECT string_split(text, ' ')) AS t(w) WHERE "
_find("f15_has", sentence, {"words": {"has": "the"}}, _WORDS + "list_contains(w, 'the')")
_find("f15_not_has", embedding, {"not": {"vector": {"has": 0.5}}}, "SELECT vec_id AS id FROM embeddings WHERE NOT list_contains(embedding, 0.5::FLOAT)")
_find("f16_has_some", sentence, {"words": {"hasSome": ["der", "les", "nowhere"]}}, _WORDS + "list_has_any(w, ['der', 'les', 'nowhere'])")
_find("f16_has_some_empty", embedding, {"vector": {"hasSome": []}}, "SELECT vec_id AS id FROM embeddings WHERE false")
_find("f17_has_every", sentence, {"words": {"hasEvery": ["the", "of"]}}, _WORDS + "list_has_all(w, ['the', 'of'])")
_find("f17_has_every_empty", embedding, {"vector": {"hasEvery": []}}, "SELECT vec_id AS id FROM embeddings WHERE true")
_find("f18_is_empty_true", sentence, {"numbers": {"isEmpty": True}}, "SELECT doc_id AS id FROM documents WHERE len(regexp_extract_all(text, '[0-9]+')) = 0")
_find("f18_is_empty_false", sentence, {"numbers": {"isEmpty": False}}, "SELECT doc_id AS id FROM documents WHERE len(regexp_extract_all(text, '[0-9]+')) > 0")
_find("f19_some_like", sentence, {"words": {"some": {"like": "un%", "ne": "un"}}}, _WORDS + "len(list_filter(w, lambda x: x LIKE 'un%' AND x <> 'un')) > 0")
_find("f19_some_any", sentence, {"numbers": {"some": {}}}, "SELECT doc_id AS id FROM documents WHERE len(regexp_extract_all(text, '[0-9]+')) > 0")
_find("f20_list_null", sentence, {"words": None}, "SELECT doc_id AS id FROM documents WHERE text IS NULL")
_find("f23_unset", order, {"status": UNSET, "total": {"gt": 200000, "lt": UNSET}, "items": {"some": UNSET}}, _O + "o_totalprice > 200000")
_find("f35_bound", customer, {"name": {"in": ["Customer#000000001", "x' OR true --", 'y") OR (1=1']}}, "SELECT c_custkey AS id FROM customer WHERE c_name = 'Customer#000000001'")
_find("f18_is_empty_vectors", embedding, {"vector": {"isEmpty": False}}, "SELECT vec_id AS id FROM embeddings WHERE len(embedding) > 0")
_find("f19_some", embedding, {"vector": {"some": {"gt": 0.3}}}, "SELECT vec_id AS id FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.3::FLOAT)) > 0")
_find("f25_part", document, {"label": {"toxic": 1}}, "SELECT doc_id AS id FROM documents WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND toxic = 1)")
_find("f25_not_part", document, {"not": {"label": {}}}, "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
_find("f36_contains", customer, condition("name", s.text(), "contains", "r#00000001"), "SELECT c_custkey AS id FROM customer WHERE contains(lower(c_name), 'r#00000001')")
_find("f36_escaped", customer, {"or": [condition("name", s.text(), "contains", "_"), condition("name", s.text(), "startsWith", "CUSTOMER#0000000")]}, "SELECT c_custkey AS id FROM customer WHERE contains(c_name, '_') OR starts_with(lower(c_name), 'customer#0000000')")
_find("f36_on", event, condition("ts", s.timestamp(), "on", "2024-01-12T10:00:00Z"), "SELECT event_id AS id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-12'")
_find("f36_before_after", event, {"or": [condition("ts", s.timestamp(), "before", "2024-01-03"), condition("ts", s.timestamp(), "after", "2024-01-28")]}, "SELECT event_id AS id FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-03' OR CAST(ts AS DATE) > DATE '2024-01-28'")
_S = "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem"
for _q, _sql in (
    ("some", "EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = p_partkey AND s_acctbal > 9000)"),
    ("none", "NOT EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = p_partkey AND s_acctbal > 9000)"),
    ("every", "NOT EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = p_partkey AND NOT s_acctbal > 9000)"),
):
    _find(f"f32_links_{_q}", part, {"suppliers": {_q: {"acctbal": {"gt": 9000}}}}, "SELECT p_partkey AS id FROM part WHERE " + _sql)

_find("f32_links_every_rows", part, {"suppliers": {"every": {"acctbal": {"gt": -500}}}}, "SELECT p_partkey AS id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = p_partkey AND NOT s_acctbal > -500)")
_find("f32_links_or", part, {"or": [{"size": 1}, {"not": {"suppliers": {"none": {"acctbal": {"gt": 9500}}}}}]}, "SELECT p_partkey AS id FROM part WHERE p_size = 1 OR EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = p_partkey AND s_acctbal > 9500)")
_find("f33_deep_or", order, {"or": [{"total": {"gt": 400000}}, {"items": {"some": {"or": [{"quantity": {"gt": 49.5}}, {"supplier": {"nation": {"region": {"name": "ASIA"}}}}], "not": {"part": {"size": {"lt": 40}}}}}}]}, "SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 400000 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND (l_quantity > 49.5 OR EXISTS (SELECT 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey = l_suppkey AND r_name = 'ASIA')) AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 40))")

# reading -----------------------------------------------------------------------------------------------------------

query("p01_shape", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment, c_nationkey AS \"nationId\" FROM customer")(lambda e: e.find(customer).drop("createdAt", "updatedAt"))
query("p02_expand", "SELECT c_custkey AS id, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")(
    lambda e: e.find(customer, expand={"nation": {"region": True}}).select("id", F.col("nation.name").alias("nation"), F.col("nation.region.name").alias("region"))
)
query("p03_select", "SELECT o_orderkey AS id, o_totalprice AS total FROM orders")(lambda e: e.find(order, select={"total": True}))
query("p03_select_nested", "SELECT o_orderkey AS id, c_name AS customer, n_name AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")(
    lambda e: e.find(order, select={"customer": {"name": True, "nation": {"name": True}}}).select("id", F.col("customer.name").alias("customer"), F.col("customer.nation.name").alias("nation"))
)
query("p05_parts", "SELECT o_orderkey AS id, count(l_orderkey) AS items, coalesce(round(sum(l_quantity), 2), 0) AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")(
    lambda e: e.find(order, select={"items": {"quantity": True}}).select("id", F.size("items").cast("long").alias("items"), F.round(F.aggregate("items", F.lit(0.0), lambda a, x: a + x["quantity"]), 2).alias("quantity"))
)
query("p05_parts_order", "SELECT o_orderkey AS id, l_orderkey IS NOT NULL AS has, l_shipdate AS first FROM orders LEFT JOIN (SELECT l_orderkey, min(CAST(l_shipdate AS TIMESTAMP)) AS l_shipdate FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")(
    lambda e: e.find(order, select={"items": {"createdAt": True}}).select("id", (F.size("items") > 0).alias("has"), F.get("items", F.lit(0))["createdAt"].cast("timestamp_ntz").alias("first"))
)
query("p06_part", "SELECT d.doc_id AS id, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")(lambda e: e.find(document, select={"label": True}).select("id", "label.quality", "label.toxic"))
query("p07_links", f"SELECT p_partkey AS id, count(s_suppkey) AS suppliers, coalesce(min(s_name), '') AS first FROM part LEFT JOIN ({_S}) ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY p_partkey")(
    lambda e: e.find(part, expand={"suppliers": True}).select("id", F.size("suppliers").cast("long").alias("suppliers"), F.coalesce(F.array_min(F.transform("suppliers", lambda x: x["name"])), F.lit("")).alias("first"))
)
query("p04_select_child", "SELECT d.doc_id AS id, quality, toxic, CASE WHEN l.doc_id IS NOT NULL THEN 'id quality toxic createdAt updatedAt' END AS fields FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")(
    lambda e: (lambda found: found.select("id", "label.quality", "label.toxic", F.when(F.col("label").isNotNull(), F.lit(" ".join(found.schema["label"].dataType.names))).alias("fields")))(e.find(document, select={"label": True}))
)
query("p08_self_reference", "SELECT a.c_custkey AS id, b.c_name AS sponsor, c.c_name AS above FROM customer a LEFT JOIN customer b ON a.c_custkey > 0 AND b.c_custkey = a.c_custkey // 2 LEFT JOIN customer c ON b.c_custkey > 0 AND c.c_custkey = b.c_custkey // 2")(
    lambda e: e.find(person, expand={"sponsor": {"sponsor": True}}).select("id", F.col("sponsor.name").alias("sponsor"), F.col("sponsor.sponsor.name").alias("above"))
)
query("p08_self_filter", "SELECT a.c_custkey AS id FROM customer a JOIN customer b ON a.c_custkey > 0 AND b.c_custkey = a.c_custkey // 2 JOIN customer c ON b.c_custkey > 0 AND c.c_custkey = b.c_custkey // 2 WHERE c.c_name < 'Customer#000000100'")(
    lambda e: e.find(person, {"sponsor": {"sponsor": {"name": {"lt": "Customer#000000100"}}}}).select("id")
)
query("p05_page", "SELECT o.id, count(l_orderkey) AS items, round(coalesce(sum(l_quantity), 0), 2) AS quantity FROM (SELECT o_orderkey AS id FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 25) o LEFT JOIN lineitem ON l_orderkey = id GROUP BY 1")(
    lambda e: e.find(order, order_by={"total": "desc"}, limit=25).select("id", F.size("items").cast("long").alias("items"), F.round(F.aggregate("items", F.lit(0.0), lambda a, x: a + x["quantity"]), 2).alias("quantity"))
)
query("p11_auto", "SELECT n_nationkey AS id, r_name AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")(lambda e: e.find(nation, expand="auto").select("id", F.col("region.name").alias("region")))
query("p09_projection", "SELECT p_partkey AS id, p_brand AS brand FROM part WHERE p_size > 40")(lambda e: e.find(s.projection(part, {"brand": True}), {"size": {"gt": 40}}))

_find("o01_orders", order, None, "SELECT o_orderkey AS id, o_priority AS priority, total FROM (SELECT o_orderkey, o_orderpriority AS o_priority, o_totalprice AS total FROM orders ORDER BY o_orderpriority DESC NULLS FIRST, o_totalprice ASC NULLS LAST, o_orderkey LIMIT 50)", "id priority total", order_by={"priority": "desc", "total": "asc"}, limit=50)
_find("o02_default", event, None, "SELECT event_id AS id FROM events ORDER BY ts NULLS LAST, event_id LIMIT 100", limit=100)
_find("o03_nested", order, None, "SELECT o_orderkey AS id FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey ORDER BY n_name DESC NULLS FIRST, o_orderkey LIMIT 40", order_by={"customer": {"nation": {"name": "desc"}}}, limit=40)
_find("o05_offset", order, {"status": "F"}, "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 20 OFFSET 40", order_by={"total": "desc"}, limit=20, offset=40)
query("o06_find_one", "SELECT o_orderkey AS id FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 1")(lambda e: e.find(order, order_by={"total": "desc"}, limit=1).select("id"))
query("o07_find_many", "SELECT event_id AS id FROM events WHERE event_type = 'click' ORDER BY ts NULLS LAST, event_id LIMIT 10000")(lambda e: e.find_many(event, {"type": "click"}).select("id"))
query("o08_paginate", "SELECT o_orderkey AS id, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS docs FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate NULLS LAST, o_orderkey LIMIT 25 OFFSET 50")(
    lambda e: (lambda p: p.docs.select("id", F.lit(p.docs_quantity).cast("long").alias("docs")))(e.paginate(order, {"status": "O"}, page=3, per_page=25))
)
query("o09_count", "SELECT count(*) AS count FROM orders WHERE o_totalprice > 100000")(lambda e: e.count_rows(order, {"total": {"gt": 100000}}))
_W = "SELECT event_id AS id, user_id AS user FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS FIRST, event_id) = 1"
_find("w01_latest", event, None, _W, "id user", latest_per=["user"], order_by={"ts": "desc"})
_find("w01_latest_two", event, {"value": {"gt": 1}}, "SELECT event_id AS id FROM events WHERE value > 1 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC NULLS FIRST, event_id) = 1", latest_per=["user", "type"], order_by={"value": "desc"})
query("w02_count_latest", "SELECT count(DISTINCT user_id) AS count FROM events")(lambda e: e.count_rows(event, latest_per="user"))
query("w02_count_latest_two", "SELECT count(*) AS count FROM (SELECT DISTINCT user_id, event_type FROM events)")(lambda e: e.count_rows(event, latest_per=["user", "type"]))

# aggregates --------------------------------------------------------------------------------------------------------


def _agg(name: str, what: Any, sql: str, rounded: str = "", **parts: Any) -> None:
    def run(e: Engine) -> DataFrame:
        rows = e.aggregate(what, parts).rows
        return rows.withColumns({c: F.round(F.col(f"`{c}`"), 6) for c in rounded.split()}) if rounded else rows

    query(name, sql)(run)


_agg("a01_count", event, "SELECT event_type AS type, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1", groupBy=["type"], select={"n": count()})
_agg("a02_sum", event, "SELECT event_type AS type, round(sum(value), 6) AS total FROM events GROUP BY 1", "total", groupBy=["type"], select={"total": sum_("value")})
_agg("a03_avg", event, "SELECT event_type AS type, round(avg(value), 6) AS mean FROM events GROUP BY 1", "mean", groupBy=["type"], select={"mean": avg("value")})
_agg("a04_min", event, "SELECT user_id AS user, min(value) AS low, min(ts) AS first FROM events GROUP BY 1", groupBy=["user"], select={"low": min_("value"), "first": min_("ts")})
_agg("a05_max", event, "SELECT user_id AS user, max(value) AS high, max(event_type) AS last FROM events GROUP BY 1", groupBy=["user"], select={"high": max_("value"), "last": max_("type")})
_agg("a06_distinct", event, "SELECT event_type AS type, CAST(count(DISTINCT user_id) AS DOUBLE) AS users FROM events GROUP BY 1", groupBy=["type"], select={"users": distinct("user")})
_agg("a07_first", event, "SELECT user_id AS user, arg_min(value, struct_pack(a := ts, b := event_id)) AS first FROM events GROUP BY 1", groupBy=["user"], select={"first": first("value")})
_agg("a08_percentile", event, "SELECT event_type AS type, round(quantile_cont(value, 0.95), 6) AS p FROM events GROUP BY 1", "p", groupBy=["type"], select={"p": percentile("value", 0.95)})
query("a09_histogram", "SELECT type, b AS bucket, n FROM (SELECT event_type AS type, unnest([0, 1, 2, 3]) AS b, unnest([count(*) FILTER (WHERE value < 5), count(*) FILTER (WHERE value >= 5 AND value < 10), count(*) FILTER (WHERE value >= 10 AND value < 50), count(*) FILTER (WHERE value >= 50)]) AS n FROM events GROUP BY 1)")(
    lambda e: e.aggregate(event, groupBy=["type"], select={"h": histogram("value", [5, 10, 50])}).rows.select("type", F.posexplode("h").alias("bucket", "n"))
)
_agg("a10_filter", event, "SELECT user_id AS user, CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) AS clicks, round(sum(value) FILTER (WHERE value > 10 OR event_type = 'view'), 6) AS much FROM events GROUP BY 1", "much", groupBy=["user"], select={"clicks": count({"type": "click"}), "much": sum_("value", {"or": [{"value": {"gt": 10}}, {"type": "view"}]})})
query("a11_histogram_filter", "SELECT unnest([0, 1]) AS bucket, unnest([count(*) FILTER (WHERE value < 10 AND event_type = 'click'), count(*) FILTER (WHERE value >= 10 AND event_type = 'click')]) AS n FROM events")(
    lambda e: e.aggregate(event, select={"h": histogram("value", [10], {"type": "click"})}).rows.select(F.posexplode("h").alias("bucket", "n"))
)
_agg("a13_group_map", event, "SELECT event_type AS kind, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1", groupBy={"kind": "type"}, select={"n": count()})
_agg("a14_group_reference", order, 'SELECT o_custkey AS customer, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1', groupBy=["customer"], select={"n": count()})
_agg("a15_path_group", order, 'SELECT n_name AS "customer.nation.name", CAST(count(*) AS DOUBLE) AS n, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1', "total", groupBy=["customer.nation.name"], select={"n": count(), "total": sum_("total")})
_agg("a15_part_path", document, "SELECT toxic, CAST(count(*) AS DOUBLE) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1", groupBy={"toxic": "label.toxic"}, select={"n": count()})
for _span, _sql in (("5min", "5 minutes"), ("1h", "1 hour"), ("1d", "1 day")):
    _agg(f"a16_bucket_{_span}", event, f"SELECT time_bucket(INTERVAL '{_sql}', ts) AS at, CAST(count(*) AS DOUBLE) AS requests FROM events GROUP BY 1", groupBy={"at": time_bucket("ts", _span)}, select={"requests": count()}, orderBy={"at": "asc"})
_agg("a17_whole", event, "SELECT CAST(count(*) AS DOUBLE) AS n, max(value) AS high FROM events", select={"n": count(), "high": max_("value")})
_agg("a17_whole_empty", event, "SELECT CAST(count(*) AS DOUBLE) AS n, sum(value) AS total FROM events WHERE event_type = 'none'", where={"type": "none"}, select={"n": count(), "total": sum_("value")})
_agg("a18_unnest", order, "SELECT l_returnflag AS flag, CAST(count(*) AS DOUBLE) AS n, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1", "quantity", where={"status": "F"}, unnest="items", groupBy={"flag": "items.flag"}, select={"n": count(), "quantity": sum_("items.quantity")})
_agg("a18_unnest_path", order, "SELECT p_brand AS brand, o_orderpriority AS priority, round(avg(l_price), 6) AS price FROM (SELECT *, l_extendedprice AS l_price FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2", "price", unnest="items", groupBy={"brand": "items.part.brand", "priority": "priority"}, select={"price": avg("items.price")})
_agg("a18_unnest_filter", order, "SELECT o_orderstatus AS status, CAST(count(*) FILTER (WHERE l_quantity > 40) AS DOUBLE) AS large FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1", unnest="items", groupBy=["status"], select={"large": count({"items.quantity": {"gt": 40}})})
_agg("a20_div", event, "SELECT user_id AS user, round(count(*) FILTER (WHERE event_type = 'click')::DOUBLE / nullif(count(*) FILTER (WHERE event_type = 'purchase'), 0), 6) AS rate FROM events GROUP BY 1", "rate", groupBy=["user"], select={"rate": div(count({"type": "click"}), count({"type": "purchase"}))})
_agg("a21_mul", event, "SELECT event_type AS type, CAST(count(*) AS DOUBLE) AS n, count(*) * 2.0::DOUBLE AS twice FROM events GROUP BY 1", groupBy=["type"], select={"n": count(), "twice": mul("n", 2)})
_agg("a22_add", event, "SELECT event_type AS type, CAST(count(*) AS DOUBLE) AS n, round(count(*) + max(value), 6) AS more FROM events GROUP BY 1", "more", groupBy=["type"], select={"n": count(), "more": add("n", max_("value"))})
_agg("a23_sub", event, "SELECT event_type AS type, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1", "spread", groupBy=["type"], select={"spread": sub(max_("value"), min_("value"))})
_agg("a25_chain", event, "SELECT event_type AS type, round((max(value) - min(value)) / nullif(count(*), 0), 6) AS each, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1", "each spread", groupBy=["type"], select={"spread": sub(max_("value"), min_("value")), "each": div("spread", count())})
_agg("a26_having", event, "SELECT user_id AS user, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1 HAVING count(*) >= 70", groupBy=["user"], select={"n": count()}, having={"n": {"gte": 70}})
_agg("a28_page", order, "SELECT o_custkey AS customer, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1 ORDER BY n DESC NULLS FIRST, 1 NULLS LAST LIMIT 10 OFFSET 10", groupBy=["customer"], select={"n": count()}, orderBy={"n": "desc", "customer": "asc"}, page=2, perPage=10)
_agg("a28_page_default", order, "SELECT o_custkey AS customer, max(o_totalprice) AS high FROM orders GROUP BY 1 ORDER BY high DESC NULLS FIRST, 1 NULLS LAST LIMIT 20", groupBy=["customer"], select={"high": max_("total")}, orderBy={"high": "desc", "customer": "asc"}, page=1)
query("a29_facets", "SELECT 'priority' AS facet, o_orderpriority AS name, CAST(count(*) AS DOUBLE) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 2 UNION ALL SELECT 'nation', n_name, n FROM (SELECT n_name, CAST(count(*) AS DOUBLE) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 100000 GROUP BY 1 ORDER BY n DESC NULLS FIRST, 1 LIMIT 5)")(
    lambda e: (lambda f: f["priority"].select(F.lit("priority").alias("facet"), "name", "n").union(f["nation"].select(F.lit("nation"), "name", "n")))(
        e.aggregate(order, where={"total": {"gt": 100000}}, select={"n": count()}, facets={"priority": {"groupBy": {"name": "priority"}, "select": {"n": count()}}, "nation": {"groupBy": {"name": "customer.nation.name"}, "select": {"n": count()}, "orderBy": {"n": "desc", "name": "asc"}, "limit": 5}}).facets
    )
)

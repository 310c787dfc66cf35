"""Registered queries over the stand-in tables, each with its SQL.

Stand-ins: customers are users (market segment: plan), suppliers are suppliers (nation:
owner), parts are products, orders are products with an owner and a status, events are
the usage log and import rows, regions and nations are types and their templates.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendora.functions import columns as C
from vendora.operators import analytics, enrich, ingest, lifecycle, reading, templates, writes
from vendora.plans.checkpoints import scratch
from vendora.sources import catalogue, workbook
from vendora.sources import pages as P
from vendora.sources.tables import read

AS_OF = "2024-01-31"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def _users(s, d):
    return read(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("plan"))


def _usage(s, d):
    return read(s, d, "events").select("event_id", "user_id", F.col("event_type").alias("action"), "ts", "value", "props")


#: Fixed values of the stand-ins: plan limits.
LIMITS = (("AUTOMOBILE", 5), ("BUILDING", 0), ("FURNITURE", 20), ("HOUSEHOLD", 60), ("MACHINERY", None))
_LIMITS_SQL = "(values ('AUTOMOBILE', 5), ('BUILDING', 0), ('FURNITURE', 20), ('HOUSEHOLD', 60), ('MACHINERY', null)) l(plan, plan_limit)"
_MONTH = "ts >= date_trunc('month', timestamp '2024-01-31')"


def _limits(s):
    return s.createDataFrame(LIMITS, "plan string, plan_limit int")


# Analytics


@query(f"""
    select p.plan, coalesce(n.n, 0)::bigint as n_uses from (select distinct c_mktsegment as plan from customer order by 1 limit 1000) p
    left join (select c_mktsegment as plan, count(*) n from events join customer on user_id = c_custkey where {_MONTH} group by 1) n using (plan)""")
def usage_by_plan(s, d):
    users = _users(s, d)
    return analytics.usage_by_plan(users.select("plan").where("plan is not null").distinct(), users, _usage(s, d), AS_OF)


@query(f"""
    select (select count(*) from customer)::bigint as users, (select count(*) from orders)::bigint as products, (select count(*) from supplier)::bigint as suppliers,
           (select count(*) from events where {_MONTH})::bigint as uses_of_month, (select count(*) from events where {_MONTH} and lower(event_type) like '%l_ck%')::bigint as matching_of_month""")
def total_counts(s, d):
    month = _usage(s, d).where(C.since_month_start(F.col("ts"), AS_OF))
    used = month.agg(F.count("*").alias("uses_of_month"), F.count_if(F.lower("action").like("%l_ck%")).alias("matching_of_month"))
    count = lambda t, name: read(s, d, t).agg(F.count("*").alias(name))
    # One-row frames.
    return count("customer", "users").join(F.broadcast(count("orders", "products"))).join(F.broadcast(count("supplier", "suppliers"))).join(F.broadcast(used))


@query(f"select event_type as action, count(*)::bigint as n_uses from events where {_MONTH} group by 1")
def usage_by_action(s, d):
    return analytics.usage_by_action(_usage(s, d), AS_OF)


@query(f"""
    select u.user_id, u.name, coalesce(p.n, 0)::bigint as n_products, coalesce(e.n, 0)::bigint as n_uses
    from (select c_custkey as user_id, c_name as name from customer order by c_custkey limit 100 offset 20) u
    left join (select o_custkey k, count(*) n from orders group by 1) p on p.k = u.user_id
    left join (select user_id k, count(*) n from events where {_MONTH} group by 1) e on e.k = u.user_id""")
def user_activity_page(s, d):
    users = reading.held_page(_users(s, d).select("user_id", "name"), [F.asc("user_id")], 20, 100)
    return analytics.user_activity(users, read(s, d, "orders").select(F.col("o_custkey").alias("user_id")), _usage(s, d), AS_OF)


@query("select o_orderstatus as status, count(*)::bigint as total from orders group by 1")
def status_counts(s, d):
    return analytics.status_counts(read(s, d, "orders"), "o_orderstatus")


@query("""
    with c as (select o_orderstatus as status, count(*)::bigint as total from orders group by 1)
    select status, total, round(total / (select greatest(max(total), 1) from c) * 100)::bigint as percent from c""")
def status_bar_scaled(s, d):
    return analytics.scaled(analytics.status_counts(read(s, d, "orders"), "o_orderstatus"))


@query("""
    select e.event_id, c.c_name as name, e.event_type as action, strftime(e.ts, '%Y-%m-%d %H:%M:%S') as at
    from (select * from events order by ts desc, event_id desc limit 10) e left join customer c on c.c_custkey = e.user_id""")
def recent_activity(s, d):
    top = reading.held_page(_usage(s, d).select("event_id", "user_id", "action", "ts"), [F.desc("ts"), F.desc("event_id")], 0, 10, 50)
    ids = [r.user_id for r in top.select("user_id").collect()]
    users = read(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name")).where(F.col("user_id").isin(ids))
    return top.join(users, "user_id", "left").select("event_id", "name", "action", C.stamp(F.col("ts")).alias("at"))


@query(f"""
    select c_custkey as user_id, (case when plan_limit is null or plan_limit <= 0 then -1 else plan_limit - coalesce(n, 0) end)::bigint as remaining,
           (plan_limit is null or plan_limit <= 0 or plan_limit - coalesce(n, 0) > 0) as allowed
    from customer left join {_LIMITS_SQL} on l.plan = c_mktsegment left join (select user_id k, count(*) n from events where {_MONTH} group by 1) e on e.k = c_custkey""")
def quota_remaining(s, d):
    return analytics.quota_remaining(_users(s, d), _limits(s), _usage(s, d), AS_OF)


@query(f"""
    select c_custkey as user_id, lim::bigint as effective_limit, coalesce(n, 0)::bigint as used, (lim is null or lim <= 0 or coalesce(n, 0) + 3 <= lim) as enough
    from (select c_custkey, coalesce(nullif(c_custkey % 4 * 20, 0), plan_limit) lim from customer left join {_LIMITS_SQL} on l.plan = c_mktsegment) u
    left join (select user_id k, count(*) n from events where {_MONTH} group by 1) e on e.k = c_custkey""")
def credit_check(s, d):
    users = _users(s, d).withColumn("user_limit", (F.col("user_id") % 4 * 20).cast("int"))
    return analytics.credit_check(users, _limits(s), _usage(s, d), 3, AS_OF)


@query(f"select user_id, count(*)::bigint as n_uses from events where {_MONTH} and lower(event_type) like 'p%' group by 1")
def usage_by_user_and_prefix(s, d):
    return analytics.usage_by_user(_usage(s, d), AS_OF, "p")


# Reading

_PART_SEARCH = "(lower(p_name) like '%a%' or lower(p_brand) like '%a%' or lower(p_type) like '%a%')"


def _found_parts(s, d):
    return reading.matching(reading.search(read(s, d, "part"), ["p_name", "p_brand", "p_type"], "a"), at_least={"p_size": 10}, contains={"p_type": "e"})


@query(f"""
    select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from part where {_PART_SEARCH} and p_size >= 10 and lower(p_type) like '%e%'
    order by p_retailprice desc nulls last, p_partkey limit 10 offset 5""")
def product_search_page(s, d):
    return reading.page(_found_parts(s, d), reading.order_of(read(s, d, "part"), "p_retailprice", True, "p_partkey"), 5, 10)


@query(f"select count(*)::bigint as total, 1 as page, greatest(ceil(count(*) / 10.0), 1)::bigint as pages from part where {_PART_SEARCH} and p_size >= 10 and lower(p_type) like '%e%'")
def product_search_count(s, d):
    total = F.count("*")
    return _found_parts(s, d).agg(total.alias("total"), F.lit(reading.page_number(5, 10)).alias("page"), F.greatest(F.ceil(total / 10), F.lit(1)).cast("bigint").alias("pages"))


@query("""
    select s_suppkey, s_name from supplier left join nation on n_nationkey = s_nationkey
    where lower(s_name) like '%11%' or lower('s' || s_suppkey || '@x.org') like '%11%' or lower(n_name) like '%11%' order by s_name, s_suppkey limit 10 offset 2""")
def supplier_search_page(s, d):
    named = read(s, d, "supplier").join(read(s, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    rows = named.select("s_suppkey", F.col("s_name").alias("nome"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("@x.org")).alias("email_contato"), F.col("n_name").alias("contato_principal"))
    found = reading.search(rows, reading.SUPPLIER_SEARCH, "11").select("s_suppkey", F.col("nome").alias("s_name"))
    return reading.page(found, [F.asc("s_name"), F.asc("s_suppkey")], 2, 10)


@query("select s_suppkey, s_name from supplier where lower(s_name) like '%7%' order by s_name, s_suppkey limit 10")
def admin_supplier_search(s, d):
    found = reading.matching(read(s, d, "supplier").select("s_suppkey", "s_name"), contains={"s_name": "7"})
    return reading.page(found, [F.asc("s_name"), F.asc("s_suppkey")], 0, 10)


@query("select n_nationkey, n_name from nation left join region on r_regionkey = n_regionkey where lower('t' || n_nationkey) like '%a%' or lower(n_name) like '%a%' or lower(r_name) like '%a%' order by n_name, n_nationkey limit 200")
def type_search_page(s, d):
    named = read(s, d, "nation").join(read(s, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    rows = named.select("n_nationkey", F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("key_name"), F.col("n_name").alias("friendly_name"), F.col("r_name").alias("description"))
    found = reading.search(rows, reading.TYPE_SEARCH, "A").select("n_nationkey", F.col("friendly_name").alias("n_name"))
    return reading.page(found, [F.asc("n_name"), F.asc("n_nationkey")], 0, 200)


@query("""
    select p_partkey, p_name from part where lower(p_name) like '%re%' or lower('chat ' || p_type) like '%re%' or lower('d' || p_partkey) like '%re%' or lower(p_brand || p_type) like '%re%'
        or lower('s' || p_partkey) like '%re%' or lower((p_partkey * 7)::varchar) like '%re%' or lower(p_brand) like '%re%' or lower('m' || p_size) like '%re%'
    order by p_partkey desc limit 50 offset 5""")
def product_search_all_columns(s, d):
    k = F.col("p_partkey").cast("string")
    rows = read(s, d, "part").select(
        "p_partkey", F.col("p_name").alias("nome_base"), F.concat(F.lit("chat "), F.col("p_type")).alias("nome_chat_api"), F.concat(F.lit("d"), k).alias("descricao_original"), F.concat("p_brand", "p_type").alias("descricao_chat_api"),
        F.concat(F.lit("s"), k).alias("sku"), (F.col("p_partkey") * 7).cast("string").alias("ean"), F.col("p_brand").alias("marca"), F.concat(F.lit("m"), F.col("p_size").cast("string")).alias("modelo"),
    )
    found = reading.search(rows, reading.PRODUCT_SEARCH, "RE").select("p_partkey", F.col("nome_base").alias("p_name"))
    return reading.page(found, [F.desc("p_partkey")], 5, 50)


@query("select s_suppkey, s_name, s_nationkey from supplier where s_nationkey = 3")
def tenant_suppliers(s, d):
    return reading.tenant(read(s, d, "supplier"), "s_nationkey", 3).select("s_suppkey", "s_name", "s_nationkey")


@query("select n_nationkey, n_name, nullif(n_regionkey, 0) as owner from nation where n_regionkey in (0, 1) order by nullif(n_regionkey, 0) nulls last, n_name limit 10")
def own_or_global_types(s, d):
    types = read(s, d, "nation").select("n_nationkey", "n_name", F.nullif("n_regionkey", F.lit(0)).alias("owner"))
    return reading.page(reading.own_or_global(types, "owner", 1), [F.asc_nulls_last("owner"), F.asc("n_name")], 0, 10)


@query("""
    select event_id, event_type as action, strftime(ts, '%Y-%m-%d %H:%M:%S') as at, value from events
    where user_id = 7 and event_type = 'view' and ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-25' order by ts desc, event_id desc limit 20 offset 3""")
def usage_range_page(s, d):
    rows = reading.matching(_usage(s, d), {"user_id": 7, "action": "view"}, {"ts": "2024-01-05 00:00:00"}, {"ts": "2024-01-25 00:00:00"})
    return reading.page(rows, [F.desc("ts"), F.desc("event_id")], 3, 20).select("event_id", "action", C.stamp(F.col("ts")).alias("at"), "value")


@query("""
    with a as (
        (select 'product' as kind, p_partkey::bigint as id, p_name as name, p_partkey::bigint as created from part where lower(p_name) like '%a%' order by 4 desc, 2 desc limit 10) union all
        (select 'supplier', s_suppkey::bigint, s_name, s_suppkey::bigint from supplier where lower(s_name) like '%a%' order by 4 desc, 2 desc limit 10) union all
        (select 'user', c_custkey::bigint, c_name, c_custkey::bigint from customer where lower(c_name) like '%a%' order by 4 desc, 2 desc limit 10))
    select * from a order by created desc, id desc, kind limit 10""")
def federated_search(s, d):
    branch = lambda kind, t, key, name: (kind, reading.search(read(s, d, t), [name], "a"), key, name, F.col(key).cast("bigint"))
    return reading.federated([branch("product", "part", "p_partkey", "p_name"), branch("supplier", "supplier", "s_suppkey", "s_name"), branch("user", "customer", "c_custkey", "c_name")], 10)


@query("""
    select p_partkey, p_name from part join (select lower(p_name) n, p_size z from part group by 1, 2 having count(*) > 1) on n = lower(p_name) and z = p_size""")
def same_name_products(s, d):
    return reading.same_name_elsewhere(read(s, d, "part"), "p_partkey", "p_name", "p_size").select("p_partkey", "p_name")


@query("""
    select 'id' as by, c_custkey, c_name from customer where c_custkey = 42
    union all select 'name', c_custkey, c_name from customer where c_name = (select max(c_name) from customer)""")
def point_lookups(s, d):
    users = read(s, d, "customer").select("c_custkey", "c_name")
    last = users.agg(F.max("c_name")).first()[0]
    found = lambda by, **equals: reading.lookup(users, **equals).select(F.lit(by).alias("by"), "c_custkey", "c_name")
    return found("id", c_custkey=42).unionByName(found("name", c_name=last)).unionByName(found("none", c_name=None))


@query("select s_suppkey, case when s_suppkey = 7 then 'cod=sku_original;nome=nome_base' when s_suppkey % 2 = 0 then 'a=marca' end as mapping from supplier")
def mapping_replaced(s, d):
    old = F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.lit("a"), F.lit("marca")))
    suppliers = read(s, d, "supplier").select("s_suppkey", old.alias("mapping"))
    patch = s.createDataFrame([(7, {"nome": "nome_base", "cod": "sku_original"}, True)], "s_suppkey bigint, mapping map<string,string>, set_mapping boolean")
    rows = ingest.patched(suppliers, patch, "s_suppkey", ["mapping"])
    return rows.select("s_suppkey", F.array_join(F.array_sort(F.transform(F.map_entries("mapping"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("mapping"))


@query("""
    select p_partkey, p_type as nome_base, p_name as sku_original, concat_ws(';', 'marca=' || p_brand) as leftovers from part""")
def default_mapping_import(s, d):
    """A supplier's own mapping is used where the import brings none."""
    suppliers = read(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.create_map(F.lit("cod"), F.lit("sku_original"), F.lit(" MARCA"), F.lit("nome_base")).alias("default_column_mapping"))
    rows = read(s, d, "part").select("p_partkey", F.col("p_name").alias("Cod"), F.col("p_type").alias("Marca "), F.col("p_brand").alias("marca_2"))
    out = ingest.standardise(rows, ["Cod", "Marca ", "marca_2"], ingest.mapping_or_default(None, suppliers, 3), ("p_partkey",))
    pairs = F.transform(F.map_entries("leftovers"), lambda e: F.concat(F.replace(e["key"], F.lit("_2"), F.lit("")), F.lit("="), e["value"]))
    return out.select("p_partkey", "nome_base", "sku_original", F.array_join(pairs, ";").alias("leftovers"))


@query("""
    select n_nationkey, n_name from nation
    where (n_nationkey = 7 or n_name = '7') and (n_regionkey = 3 or n_regionkey is null or n_nationkey % 2 = 1)
    order by case when n_nationkey = 7 then 0 when n_regionkey = 3 and n_nationkey % 2 = 0 then 1 else 2 end, n_nationkey limit 1""")
def type_resolution(s, d):
    # Types of odd number are global.
    types = read(s, d, "nation").withColumn("owner", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")))
    return reading.resolve(types, "7", "n_nationkey", "n_name", "owner", 3).select("n_nationkey", "n_name")


@query("""
    with t as (select n_nationkey, n_name, case when n_nationkey % 3 > 0 then n_regionkey end as owner from nation),
    f as (select *, row_number() over (partition by n_name order by (owner is null), n_nationkey) r from t where owner = 2 or owner is null)
    select n_nationkey, n_name from f where r = 1 and n_name = (select max(n_name) from f)""")
def type_resolution_by_key(s, d):
    types = read(s, d, "nation").withColumn("owner", F.when(F.col("n_nationkey") % 3 > 0, F.col("n_regionkey")))
    last = reading.own_or_global(types, "owner", 2).agg(F.max("n_name")).first()[0]
    return reading.resolve(types, last, "n_nationkey", "n_name", "owner", 2).select("n_nationkey", "n_name")


@query(f"""
    select coalesce(k.action, e.action) as action, k.action is not null as known, coalesce(n, 0)::bigint as n_uses
    from (select unnest(['{"', '".join(reading.USAGE_ACTIONS)}']) as action) k full join (select event_type as action, count(*) n from events group by 1) e on e.action = k.action""")
def action_listing(s, d):
    """All kinds of usage, with their uses, and those in the log that aren't among them."""
    known = s.createDataFrame([(a,) for a in reading.USAGE_ACTIONS], "action string").withColumn("known", F.lit(True))
    seen = _usage(s, d).groupBy("action").agg(F.count("*").alias("n_uses"))
    listed = known.join(seen, "action", "full")
    return listed.select("action", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("n_uses", F.lit(0)).alias("n_uses"))


# Keep-latest, siblings, references


@query("""
    select o_orderkey, o_custkey, o_orderstatus from orders where o_orderstatus = 'P' or o_custkey is null or o_orderkey in (
        select max(o_orderkey) from orders where o_orderstatus <> 'P' and o_custkey is not null group by o_custkey, o_orderpriority)""")
def dedup_keep_latest(s, d):
    rows = read(s, d, "orders").withColumn("k", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")))
    return lifecycle.keep_latest(rows, "o_orderkey", ["o_custkey", "k"]).select("o_orderkey", "o_custkey", "o_orderstatus")


def _siblings(s, d):
    return lifecycle.renumbered(read(s, d, "nation"), "n_regionkey", [F.desc("n_name"), F.asc("n_nationkey")])


_SIBLINGS = "select *, (row_number() over (partition by n_regionkey order by n_name desc, n_nationkey) - 1)::int as position from nation"


@query(f"select n_nationkey, n_regionkey, position from ({_SIBLINGS})")
def sibling_renumber(s, d):
    return _siblings(s, d).select("n_nationkey", "n_regionkey", "position")


_TEMPLATES = "(select n_nationkey, n_regionkey, case when n_regionkey = 1 and n_nationkey % 2 = 0 then null else (25 - n_nationkey) // 2 end as position from nation)"


def _moved_sql(chosen: int, step: int) -> str:
    return f"""
    with a as (select *, row_number() over (partition by n_regionkey order by position nulls last, n_nationkey) - 1 as plc, max((position is null)::int) over (partition by n_regionkey) as gap from {_TEMPLATES}),
    o as (select n_nationkey, n_regionkey, plc, case when gap = 1 then plc else position end as num from a),
    m as (select n_regionkey k, plc p, num v from o where n_nationkey = {chosen}),
    t as (select m.k, m.p, m.v, o.plc tp, o.num tv from m join o on o.n_regionkey = m.k and o.plc = m.p + {step}),
    w as (select o.n_nationkey, o.n_regionkey, case when o.plc = t.p then t.tv when o.plc = t.tp then t.v else o.num end as num from o left join t on t.k = o.n_regionkey)
    select n_nationkey, n_regionkey, (row_number() over (partition by n_regionkey order by num, n_nationkey) - 1)::int as position from w"""


def _templates(s, d):
    place = F.when((F.col("n_regionkey") == 1) & (F.col("n_nationkey") % 2 == 0), F.lit(None)).otherwise(F.floor((25 - F.col("n_nationkey")) / 2))
    return read(s, d, "nation").select("n_nationkey", "n_regionkey", place.cast("int").alias("position"))


@query(_moved_sql(12, -1))
def sibling_move_up(s, d):
    return lifecycle.moved(_templates(s, d), "n_regionkey", "n_nationkey", 12, True)


@query(_moved_sql(7, 1))
def sibling_move_down(s, d):
    return lifecycle.moved(_templates(s, d), "n_regionkey", "n_nationkey", 7, False)


@query(_moved_sql(1, 1))
def sibling_first_numbering(s, d):
    """A type whose attributes have no numbers yet gets them when one is moved."""
    return lifecycle.moved(_templates(s, d), "n_regionkey", "n_nationkey", 1, False)


@query("""
    select p_partkey, s_name as supplier_name, r_name as type_name, coalesce(string_agg(n_name, '|' order by n_nationkey), '') as templates
    from part left join supplier on s_suppkey = p_partkey % 120 left join region on r_regionkey = p_size % 7 left join nation on n_regionkey = r_regionkey group by 1, 2, 3""")
def product_details(s, d):
    products = read(s, d, "part").select("p_partkey", (F.col("p_partkey") % 120).alias("supplier_id"), (F.col("p_size") % 7).alias("type_id"))
    suppliers = read(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    types = read(s, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    templates = read(s, d, "nation").select(F.col("n_regionkey").alias("type_id"), F.col("n_nationkey").alias("display_order"), F.col("n_name").alias("attribute_key"))
    rows = lifecycle.product_details(products, suppliers, types, templates)
    return rows.select("p_partkey", "supplier_name", "type_name", F.array_join(F.transform("templates", lambda t: t["attribute_key"]), "|").alias("templates"))


@query("select n_nationkey from nation a where exists (select 1 from nation b where b.n_regionkey = a.n_regionkey and left(b.n_name, 8) = left(a.n_name, 8) and b.n_nationkey <> a.n_nationkey)")
def attribute_key_conflicts(s, d):
    rows = read(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("type_id"), F.substring("n_name", 1, 8).alias("attribute_key"))
    return reading.attribute_conflicts(rows, rows).select(F.col("id").alias("n_nationkey"))


@query("select event_id, user_id from events where user_id not in (select c_custkey from customer where c_mktsegment = 'BUILDING') or user_id is null")
def delete_cascade_usage(s, d):
    gone = _users(s, d).where("plan = 'BUILDING'").select(F.col("user_id").alias("id"))
    return lifecycle.without_children(_usage(s, d), "user_id", gone).select("event_id", "user_id")


@query("select l_orderkey, l_linenumber, l_partkey, case when s.k is null then l_suppkey end as l_suppkey from lineitem left join (select s_suppkey k from supplier where s_acctbal < 0) s on s.k = l_suppkey")
def delete_supplier_set_null(s, d):
    gone = read(s, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("id"))
    return lifecycle.parent_set_null(read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_suppkey", gone)


@query("""
    select i.id, case when o.o_orderkey is null then 'not_found' when o.o_custkey = 10 then 'deleted' else 'not_authorized' end as outcome
    from (select unnest(range(-5, 1000)) as id union select o_orderkey from orders where o_custkey = 10) i left join orders o on o.o_orderkey = i.id""")
def batch_delete_classify(s, d):
    orders = read(s, d, "orders")
    ids = s.range(-5, 1000).union(orders.where("o_custkey = 10").select("o_orderkey")).distinct()
    return lifecycle.classify_batch(ids, orders, "o_orderkey", "o_custkey", 10)


@query("select n_nationkey, n_nationkey in (select c_nationkey from customer where c_acctbal > 9000) as in_use from nation")
def type_in_use(s, d):
    return lifecycle.in_use(read(s, d, "nation"), "n_nationkey", read(s, d, "customer").where("c_acctbal > 9000"), "c_nationkey").select("n_nationkey", "in_use")


@query("select event_id, user_id from events where user_id is not null and user_id not in (select c_custkey from customer where c_acctbal > 0)")
def fk_rejects(s, d):
    return lifecycle.orphans(_usage(s, d), "user_id", read(s, d, "customer").where("c_acctbal > 0"), "c_custkey").select("event_id", "user_id")


@query("select r_regionkey, coalesce(string_agg(n_name, '|' order by n_nationkey), '') as names from region left join nation on n_regionkey = r_regionkey group by 1")
def type_templates(s, d):
    rows = lifecycle.nested(read(s, d, "region"), "r_regionkey", read(s, d, "nation"), "n_regionkey", ["n_name"], "n_nationkey", "templates")
    return rows.select("r_regionkey", F.array_join(F.transform("templates", lambda t: t["n_name"]), "|").alias("names"))


# Import

_WRAPPED = "case p_partkey % 8 when 0 then ' NaN ' when 1 then ' #n/a' when 2 then chr(9) || 'None' when 3 then '  ' || p_type || chr(160) else p_type end"
_CLEANED = "regexp_replace({0}, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g')"


def _wrapped():
    k = F.col("p_partkey") % 8
    return F.when(k == 0, F.lit(" NaN ")).when(k == 1, F.lit(" #n/a")).when(k == 2, F.lit("\tNone")).when(k == 3, F.concat(F.lit("  "), F.col("p_type"), F.lit(" "))).otherwise(F.col("p_type"))


@query(f"""
    with c as (select p_partkey, {_CLEANED.format(f'({_WRAPPED})')} v from part)
    select p_partkey, case when lower(v) not in ('', 'nan', 'none', '#n/a', 'na', '<na>') then v end as cell from c""")
def clean_tokens(s, d):
    return read(s, d, "part").select("p_partkey", C.clean(_wrapped()).alias("cell"))


def _raw_parts(s, d):
    """Parts as a supplier's file: every cell a string, some empty, headers as people write them."""
    k = F.col("p_partkey")
    return read(s, d, "part").select(
        k, F.when(k % 5 != 0, F.col("p_name")).alias(" Nome "), F.when(k % 10 != 0, (k % 700).cast("string")).alias("SKU"), F.when(k % 3 == 0, F.col("p_brand")).alias("Marca"),
        F.col("p_brand").alias("fabricante"), F.when(k % 20 != 0, F.col("p_type")).alias("Obs "), F.when(k % 7 == 0, F.lit("n/a")).otherwise(F.col("p_size").cast("string")).alias("Tam"),
    )


_HEADERS = [" Nome ", "SKU", "Marca", "fabricante", "Obs ", "Tam"]


@query("""
    with r as (select p_partkey k, case when p_partkey % 5 <> 0 then p_name end nome, case when p_partkey % 10 <> 0 then (p_partkey % 700)::varchar end sku, p_brand b,
                      case when p_partkey % 20 <> 0 then p_type end obs, case when p_partkey % 7 = 0 then 'n/a' else p_size::varchar end tam from part)
    select k as p_partkey, case when nome is null and sku is null then coalesce(obs, tam) else nome end as nome_base, sku as sku_original, b as marca,
           concat_ws(';', 'Obs=' || obs, 'Tam=' || tam) as leftovers, case when nome is null and sku is null and obs is null and tam is null then 'no name and no SKU' end as reason from r""")
def header_normalize(s, d):
    out = ingest.standardise(_raw_parts(s, d), _HEADERS, None, ("p_partkey",))
    pairs = F.transform(F.map_entries("leftovers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("p_partkey", "nome_base", "sku_original", "marca", F.array_join(pairs, ";").alias("leftovers"), "reason")


@query("""
    select p_partkey, concat_ws('; ', case when length(repeat(p_name, (p_partkey % 25)::int)) > 255 then 'nome_base: longer than 255' end,
        case when length(repeat('9', (p_partkey % 16)::int)) > 13 then 'ean: longer than 13' end, case when p_retailprice - 1000 < 0 then 'preco_venda: negative' end,
        case when trim(repeat(p_name, (p_partkey % 25)::int)) = '' then 'nome_base: missing' end) as failed
    from part where length(repeat(p_name, (p_partkey % 25)::int)) > 255 or p_partkey % 16 > 13 or p_retailprice < 1000 or p_partkey % 25 = 0""")
def validation_rejects(s, d):
    k = F.col("p_partkey")
    rules = ingest.failed_rules({"nome_base": F.repeat(F.col("p_name"), (k % 25).cast("int")), "ean": F.repeat(F.lit("9"), (k % 16).cast("int")), "preco_venda": F.col("p_retailprice") - 1000})
    return read(s, d, "part").select("p_partkey", rules.alias("f")).where(F.size("f") > 0).select("p_partkey", F.array_join("f", "; ").alias("failed"))


def _import_rows(s, d):
    return _usage(s, d).select("user_id", "event_id", F.get_json_object("props", "$.k").alias("sku"), F.floor("value").cast("string").alias("ean"))


_GREEDY = """
    rows as (select user_id, event_id, json_extract_string(props, '$.k') sku, floor(value)::bigint::varchar ean, row_number() over (partition by user_id order by event_id) rn from events),
    g as (
        select user_id, event_id, rn, sku, ean, true as accepted, [sku] skus, [ean] eans from rows where rn = 1
        union all
        select r.user_id, r.event_id, r.rn, r.sku, r.ean, not (coalesce(list_contains(g.skus, r.sku), false) or coalesce(list_contains(g.eans, r.ean), false)),
               case when coalesce(list_contains(g.skus, r.sku), false) or coalesce(list_contains(g.eans, r.ean), false) then g.skus else list_append(g.skus, r.sku) end,
               case when coalesce(list_contains(g.skus, r.sku), false) or coalesce(list_contains(g.eans, r.ean), false) then g.eans else list_append(g.eans, r.ean) end
        from g join rows r on r.user_id = g.user_id and r.rn = g.rn + 1)"""


def _deduped(s, d):
    return ingest.greedy_dedup(_import_rows(s, d), "user_id", "event_id", ["sku", "ean"])


@query(f"with recursive {_GREEDY} select user_id, event_id, sku, ean, accepted from g")
def greedy_import_dedup(s, d):
    return _deduped(s, d).select("user_id", "event_id", "sku", "ean", "accepted")


def _existing(s, d):
    """Products before the import: for each user some SKUs and EANs."""
    return _users(s, d).where("user_id % 2 = 0").select(F.col("user_id").alias("tenant"), (F.col("user_id") * 2).alias("id"), (F.col("user_id") % 97).cast("string").alias("sku"), (F.col("user_id") % 31).cast("string").alias("ean"), F.col("name").alias("label"))


_UPSERT = f"""{_GREEDY},
    p as (select c_custkey tenant, c_custkey * 2 id, (c_custkey % 97)::varchar sku, (c_custkey % 31)::varchar ean, c_name label from customer where c_custkey % 2 = 0),
    a as (select user_id tenant, event_id, sku, ean, 'e' || event_id label from g where accepted),
    m as (select a.*, coalesce(x.id, y.id) hit from a left join p x on x.tenant = a.tenant and x.sku = a.sku left join p y on y.tenant = a.tenant and y.ean = a.ean),
    l as (select * from m where hit is not null qualify row_number() over (partition by tenant, hit order by event_id desc) = 1),
    st as (
        select p.tenant, p.id, case when l.hit is null then p.sku else l.sku end sku, case when l.hit is null then p.ean else l.ean end ean,
               case when l.hit is null then p.label else l.label end as label, case when l.hit is null then 'unchanged' else 'updated' end as change from p left join l on l.tenant = p.tenant and l.hit = p.id
        union all
        select tenant, (select max(id) from p) + row_number() over (order by tenant, event_id), sku, ean, label, 'created' from m where hit is null)"""


def _state(s, d):
    good = _deduped(s, d).where("accepted").select(F.col("user_id").alias("tenant"), F.col("event_id").alias("row_no"), "sku", "ean", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("label"))
    return ingest.upsert(_existing(s, d), good, ["label"])


@query(f"with recursive {_UPSERT} select tenant, id::bigint as id, sku, ean, label, change from st")
def import_upsert_state(s, d):
    return _state(s, d).select("tenant", F.col("id").cast("bigint").alias("id"), "sku", "ean", "label", "change")


@query(f"""
    with recursive {_UPSERT}
    select tenant as user_id, id::bigint as product_id, log, action, credits from st join (values ('usage', 'CRIACAO_PRODUTO', 0), ('history', 'CRIACAO', null)) v(log, action, credits) on change = 'created'""")
def import_audit_rows(s, d):
    return ingest.audit(_state(s, d).where("change = 'created'"), "tenant", "id").withColumn("product_id", F.col("product_id").cast("bigint"))


@query("""
    select p_partkey, case when p_partkey % 6 = 0 then null when p_partkey % 6 = 1 then upper(p_name) else p_name end as p_name,
           case when p_partkey % 4 = 0 then 1.0 else p_retailprice end as p_retailprice from part""")
def partial_update(s, d):
    part = read(s, d, "part").select("p_partkey", "p_name", "p_retailprice")
    k = F.col("p_partkey")
    patch = part.select(k, F.when(k % 6 == 1, F.upper("p_name")).alias("p_name"), F.lit(1.0).alias("p_retailprice"), (k % 6 <= 1).alias("set_p_name"), (k % 4 == 0).alias("set_p_retailprice"))
    return ingest.patched(part, patch, "p_partkey", ["p_name", "p_retailprice"])


@query("""
    select c_custkey as user_id, coalesce(p.a, 50)::int as limite_produtos, (case when p.plan is null then 10 else p.b end)::int as limite_enriquecimento_web, coalesce(p.c, 20)::int as limite_geracao_ia
    from customer left join (values ('AUTOMOBILE', 5, 6, 7), ('BUILDING', 0, null, 9), ('MACHINERY', 1000, 500, 2000)) p(plan, a, b, c) on p.plan = c_mktsegment""")
def quota_copies(s, d):
    plans = s.createDataFrame([("AUTOMOBILE", 5, 6, 7), ("BUILDING", 0, None, 9), ("MACHINERY", 1000, 500, 2000)], "plan string, " + ", ".join(f"{c} int" for c in ingest.DEFAULT_LIMITS))
    return ingest.with_quotas(_users(s, d), plans).select("user_id", *ingest.DEFAULT_LIMITS)


@query("""
    with u as (select c_custkey k, 'u' || c_custkey || '@x.org' email, case when c_custkey % 3 = 0 then '' else c_name end as name, case when c_custkey % 2 = 0 then 'google' end as provider, c_custkey % 5 > 0 as is_active from customer),
    l as (select 'u' || (s_suppkey * 3 - 20) || '@x.org' email, case when s_suppkey % 4 > 0 then s_name end as name from supplier)
    select u.email, case when u.name = '' and is_active then coalesce(l.name, u.name) else u.name end as name, case when is_active and l.email is not null then coalesce(provider, 'facebook') else provider end as provider, false as is_new
    from u left join l using (email)
    union all select email, coalesce(name, string_split(email, '@')[1]), 'facebook', true from l where email not in (select email from u)""")
def social_login_merge(s, d):
    email = lambda k: F.concat(F.lit("u"), k.cast("string"), F.lit("@x.org"))
    k = F.col("user_id")
    users = _users(s, d).select(email(k).alias("email"), F.when(k % 3 == 0, F.lit("")).otherwise(F.col("name")).alias("name"), F.when(k % 2 == 0, F.lit("google")).alias("provider"), F.lit(None).cast("string").alias("provider_user_id"), (k % 5 > 0).alias("is_active"), F.lit(False).alias("is_new"))
    n = F.col("s_suppkey")
    logins = read(s, d, "supplier").select(email(n * 3 - 20).alias("email"), F.when(n % 4 > 0, F.col("s_name")).alias("name"), F.lit("facebook").alias("provider"), n.cast("string").alias("provider_user_id"))
    after, _ = ingest.social_logins(users, logins)
    return after.select("email", "name", "provider", F.coalesce("is_new", F.lit(True)).alias("is_new"))


@query("select r_name as name from region union select unnest(['AFRICA', 'eletronicos', 'vestuario'])")
def seed_types(s, d):
    return ingest.seeded(read(s, d, "region").select(F.col("r_name").alias("name")), s.createDataFrame([("AFRICA",), ("eletronicos",), ("vestuario",)], "name string"), "name")


# A whole file

_FILE_HEADERS = ["Nome", "SKU", "EAN", "fabricante", "Categoria", "Descricao", "Obs", "erro_processamento_csv"]


def _file(s, d):
    """Parts as one supplier's file: names, keys, categories, descriptions, leftovers, and lines that a reader couldn't read."""
    k = F.col("p_partkey")
    n = k.cast("string")
    return read(s, d, "part").select(
        k, F.when(k % 5 != 0, F.col("p_name")).alias("Nome"), F.when(k % 4 != 0, F.concat(F.lit("S"), (k % 900).cast("string"))).alias("SKU"),
        F.when(k % 97 == 0, F.repeat(F.lit("9"), F.lit(20))).when(k % 3 != 0, (k % 1300).cast("string")).alias("EAN"), F.col("p_brand").alias("fabricante"), F.col("p_type").alias("Categoria"),
        F.when(k % 6 != 0, F.concat(F.lit("D"), n)).alias("Descricao"), F.when(k % 2 == 0, F.col("p_type")).otherwise(F.lit(" NA ")).alias("Obs"), F.when(k % 211 == 0, F.concat(F.lit("bad line "), n)).alias("erro_processamento_csv"),
    )


def _catalogue(s, d):
    """Suppliers as products of two tenants before the import."""
    k = F.col("s_suppkey")
    return read(s, d, "supplier").select(
        (k % 4 == 3).cast("bigint").alias("tenant"), k.alias("id"), F.concat(F.lit("S"), (k * 5).cast("string")).alias("sku"), (k * 7).cast("string").alias("ean"),
        F.col("s_name").alias("nome_base"), F.lit("old").alias("descricao_original"), F.lit(None).cast("string").alias("marca"), F.lit("c").alias("categoria_original"), F.lit(1).alias("fornecedor_id"), F.lit(9).alias("product_type_id"), F.col("s_acctbal").alias("preco_venda"),
    )


def _imported(s, d):
    return ingest.import_rows(_file(s, d), _FILE_HEADERS, _catalogue(s, d), 0, "p_partkey", {"obs": "observacao"}, supplier=77, product_type=4)


_WHOLE = """
    f as (
        select p_partkey k, case when p_partkey % 5 <> 0 then p_name end nome, case when p_partkey % 4 <> 0 then 'S' || (p_partkey % 900) end sku,
               case when p_partkey % 97 = 0 then repeat('9', 20) when p_partkey % 3 <> 0 then (p_partkey % 1300)::varchar end ean, p_brand marca, p_type cat,
               case when p_partkey % 6 <> 0 then 'D' || p_partkey end descr, case when p_partkey % 2 = 0 then p_type end obs, case when p_partkey % 211 = 0 then 'bad line ' || p_partkey end bad from part),
    c as (select *, coalesce(bad, case when nome is null and sku is null and obs is null then 'no name and no SKU' end) reason, case when nome is null and sku is null then obs else nome end base from f),
    v as (select *, coalesce(reason, case when length(ean) > 13 then 'ean: longer than 13' end) error from c),
    rows as (select *, row_number() over (order by k) rn from v where error is null),
    g as (
        select k, rn, true as accepted, [sku] skus, [ean] eans from rows where rn = 1
        union all
        select r.k, r.rn, not (coalesce(list_contains(g.skus, r.sku), false) or coalesce(list_contains(g.eans, r.ean), false)),
               case when coalesce(list_contains(g.skus, r.sku), false) or coalesce(list_contains(g.eans, r.ean), false) or r.sku is null then g.skus else list_append(g.skus, r.sku) end,
               case when coalesce(list_contains(g.skus, r.sku), false) or coalesce(list_contains(g.eans, r.ean), false) or r.ean is null then g.eans else list_append(g.eans, r.ean) end
        from g join rows r on r.rn = g.rn + 1),
    p as (select (s_suppkey % 4 = 3)::bigint tenant, s_suppkey id, 'S' || (s_suppkey * 5) sku, (s_suppkey * 7)::varchar ean, s_name, s_acctbal from supplier),
    a as (select r.*, coalesce(base, sku, 'Produto Importado') as named from g join rows r using (k) where accepted),
    m as (select a.*, coalesce(x.id, y.id) hit from a left join p x on x.tenant = 0 and x.sku = a.sku left join p y on y.tenant = 0 and y.ean = a.ean),
    l as (select * from m where hit is not null qualify row_number() over (partition by hit order by k desc) = 1),
    st as (
        select p.tenant, p.id, case when l.hit is null then p.sku else l.sku end sku, case when l.hit is null then p.ean else l.ean end ean, case when l.hit is null then p.s_name else l.named end nome_base,
               case when l.hit is null then 'old' else l.descr end descricao_original, l.marca, case when l.hit is null then 'c' else l.cat end categoria_original, case when l.hit is null then 1 else 77 end fornecedor_id,
               case when l.hit is null then 9 else 4 end product_type_id, p.s_acctbal preco_venda, case when l.hit is null then 'unchanged' else 'updated' end as change, p.s_name old_name, p.sku old_sku from p left join l on p.tenant = 0 and l.hit = p.id
        union all
        select 0, (select max(id) from p) + row_number() over (order by k), sku, ean, named, descr, marca, cat, 77, 4, null, 'created', null, null from m where hit is null)"""


@query(f"with recursive {_WHOLE} select tenant, id::bigint as id, sku, ean, nome_base, descricao_original, marca, categoria_original, fornecedor_id::int as fornecedor_id, product_type_id::int as product_type_id, preco_venda, change from st")
def whole_import_state(s, d):
    return _imported(s, d).state.drop("before")


@query(f"""
    with recursive {_WHOLE}
    select k as p_partkey, error, false as duplicado, 4 as product_type_id, case when reason is null then base else nome end as name, sku, coalesce(ean, '') as ean, coalesce(bad, '') as bad from v where error is not null
    union all select r.k, 'duplicate SKU or EAN', true, 4, base, sku, coalesce(ean, ''), '' from g join rows r using (k) where not accepted""")
def whole_import_errors(s, d):
    errors = _imported(s, d).errors
    cell = lambda *names: F.coalesce(*(F.try_element_at("linha_original", F.lit(n)) for n in names))
    blank = F.lit("")
    return errors.select("p_partkey", "error", "duplicado", "product_type_id", cell("Nome", "nome_base").alias("name"), cell("SKU", "sku_original").alias("sku"), F.coalesce(cell("EAN", "ean_original"), blank).alias("ean"), F.coalesce(cell("erro_processamento_csv"), blank).alias("bad"))


@query(f"with recursive {_WHOLE} select id::bigint as id, old_name, nome_base as new_name, old_sku, sku as new_sku from st where change = 'updated'")
def whole_import_updates(s, d):
    return _imported(s, d).updates().select("id", F.col("before.nome_base").alias("old_name"), F.col("after.nome_base").alias("new_name"), F.col("before.sku").alias("old_sku"), F.col("after.sku").alias("new_sku"))


@query(f"""
    with recursive {_WHOLE}
    select r_regionkey as id, case r_regionkey when 1 then 'IMPORTED' when 2 then 'FAILED' when 3 then 'PROCESSING' else 'UPLOADED' end as status, (case when r_regionkey = 3 then 4 when r_regionkey in (1, 2) then 1 end)::int as total_pages,
        (case r_regionkey when 1 then 1 when 3 then 1 else 0 end)::int as pages_processed, (case r_regionkey when 1 then 77 when 2 then 78 when 3 then 79 end)::int as fornecedor_id,
        case when r_regionkey = 1 then '{{"created":' || (select count(*) from st where change = 'created') || ',"updated":' || (select count(*) from st where change = 'updated') || ',"errors":' || ((select count(*) from v where error is not null) + (select count(*) from g where not accepted)) || '}}' end as result_summary
    from region""")
def import_job_status(s, d):
    none = lambda kind: F.lit(None).cast(kind)
    files = read(s, d, "region").select(F.col("r_regionkey").alias("id"), F.lit("UPLOADED").alias("status"), none("int").alias("total_pages"), F.lit(0).alias("pages_processed"), none("int").alias("fornecedor_id"), none("string").alias("result_summary"))
    files = ingest.finished_import(ingest.started_import(files, 1, 77), 1, _imported(s, d))
    files = ingest.finished_import(ingest.started_import(files, 2, 78), 2, None)
    return ingest.page_done(ingest.started_import(files, 3, 79, 4), 3)


_ONE_BY_ONE = """
    r as (
        select user_id tenant, event_id rn, case when event_id % 11 > 0 and event_id % 2 = 0 then json_extract_string(props, '$.k') end sku,
               case when event_id % 11 > 0 and event_id % 2 = 1 then floor(value)::bigint::varchar end ean, 'e' || event_id as label from events),
    p as (select c_custkey tenant, c_custkey * 2 id, (c_custkey % 97)::varchar sku, (c_custkey % 31)::varchar ean, c_name as label from customer where c_custkey % 2 = 0),
    m as (select r.*, coalesce(x.id, y.id) hit from r left join p x on x.tenant = r.tenant and x.sku = r.sku left join p y on r.sku is null and y.tenant = r.tenant and y.ean = r.ean),
    t as (select *, case when hit is not null then 'p' || hit when sku is not null then 's' || sku when ean is not null then 'e' || ean else 'n' || rn end target from m),
    n as (select tenant, target, any_value(hit) hit, min(rn) first, any_value(sku) sku, any_value(ean) ean, arg_max(label, rn) as label from t group by 1, 2)"""


@query(f"""
    with {_ONE_BY_ONE}
    select p.tenant, p.id::bigint as id, p.sku, p.ean, coalesce(n.label, p.label) as label, case when n.hit is null then 'unchanged' else 'updated' end as change from p left join n on n.tenant = p.tenant and n.hit = p.id
    union all select tenant, ((select max(id) from p) + row_number() over (order by tenant, first))::bigint, sku, ean, label, 'created' from n where hit is null""")
def get_or_create_state(s, d):
    i = F.col("event_id")
    keyed = i % 11 > 0
    rows = _usage(s, d).select(
        F.col("user_id").alias("tenant"), i.alias("row_no"), F.when(keyed & (i % 2 == 0), F.get_json_object("props", "$.k")).alias("sku"), F.when(keyed & (i % 2 == 1), F.floor("value").cast("string")).alias("ean"), F.concat(F.lit("e"), i.cast("string")).alias("label"),
        F.when(keyed & (i % 2 == 0), F.array(F.lit("sku"), F.lit("label"))).otherwise(F.array(F.lit("ean"), F.lit("label"))).alias("given"),
    )
    return ingest.get_or_create(_existing(s, d), rows, ["label"])


@query("""
    with r as (select p_partkey rn, case when p_partkey % 3 > 0 then 'S' || p_partkey % 700 end sku, case when p_partkey % 3 = 0 then repeat('7', (p_partkey % 15)::int) || p_partkey % 50 end ean, p_name as nome from part),
    v as (select * from r where coalesce(length(ean), 0) <= 13),
    p as (select s_suppkey id, 'S' || s_suppkey as sku, s_name as nome from supplier),
    t as (select v.*, p.id hit, case when v.sku is not null then 's' || v.sku else 'e' || v.ean end target from v left join p using (sku)),
    n as (select target, any_value(hit) hit, min(rn) first, any_value(sku) sku, any_value(ean) ean, arg_max(nome, rn) as nome from t group by 1)
    select p.id::bigint as id, p.sku, null::varchar as ean, coalesce(n.nome, p.nome) as nome_base, case when n.hit is null then 'unchanged' else 'updated' end as change, 'COMPLETED' as status from p left join n on n.hit = p.id
    union all select ((select max(id) from p) + row_number() over (order by first))::bigint, sku, ean, nome, 'created', 'COMPLETED' from n where hit is null""")
def staged_commit_state(s, d):
    """A supplier's file staged as the JSON of one job, and committed."""
    k = F.col("p_partkey")
    one = F.struct(F.when(k % 3 > 0, F.concat(F.lit("S"), (k % 700).cast("string"))).alias("sku"), F.when(k % 3 == 0, F.concat(F.repeat(F.lit("7"), (k % 15).cast("int")), (k % 50).cast("string"))).alias("ean"), F.col("p_name").alias("nome_base"))
    staged = read(s, d, "part").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct(k, one.alias("x")))), lambda r: r["x"])).alias("result_summary"))
    jobs = staged.select(F.lit(5).alias("id"), F.lit(1).alias("user_id"), F.lit("REVIEW").alias("status"), "result_summary")
    products = read(s, d, "supplier").select(F.lit(1).cast("bigint").alias("tenant"), F.col("s_suppkey").alias("id"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("sku"), F.lit(None).cast("string").alias("ean"), F.col("s_name").alias("nome_base"))
    state, after = ingest.commit_job(jobs, 5, 1, products, "sku string, ean string, nome_base string", ["nome_base"])
    return state.join(F.broadcast(after.select("status"))).select("id", "sku", "ean", "nome_base", "change", "status")  # one job


@query("""
    select event_id, user_id, event_type as action, value, 'e' || event_id as note from events
    union all select 1000000 + c_custkey, c_custkey, case when c_custkey % 2 = 0 then c_mktsegment else 'outro' end, 0.0, null from customer""")
def insert_with_defaults(s, d):
    log = _usage(s, d).select("event_id", "user_id", "action", "value", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("note"))
    k = F.col("user_id")
    rows = _users(s, d).select((k + 1000000).alias("event_id"), "user_id", F.when(k % 2 == 0, F.col("plan")).alias("action"))
    return ingest.inserted(log, rows, {"action": "outro", "value": 0.0})


@query("select c_custkey as user_id from customer where c_custkey % 7 > 0 and c_custkey % 5 > 0")
def login_filter(s, d):
    k = F.col("user_id")
    users = _users(s, d).select("user_id", (k % 7 > 0).alias("is_active"), F.when(k % 5 > 0, F.lit("h")).alias("hashed_password"))
    return reading.can_log_in(users).select("user_id")


@query("select c_custkey as user_id from customer where c_custkey % 100 = 42 and c_custkey % 3 > 0")
def reset_token_filter(s, d):
    k = F.col("user_id")
    users = _users(s, d).select("user_id", F.sha2((k % 100).cast("string"), 256).alias("reset_password_token"), F.when(k % 3 > 0, F.lit("2024-02-01 00:00:00")).otherwise(F.lit("2024-01-01 00:00:00")).cast("timestamp").alias("reset_password_token_expires_at"))
    return reading.valid_reset(users, "42", "2024-01-31 00:00:00").select("user_id")


@query("""
    select c_custkey as user_id, case when c_custkey % 2 = 0 then c_name || '|' else '' end || 'ana|bia' as actors, (case when c_custkey % 2 = 0 then 3 else 2 end)::int as n from customer""")
def log_append(s, d):
    kind = "array<struct<timestamp:string,actor:string,action:string>>"
    old = F.when(F.col("user_id") % 2 == 0, F.array(F.struct(F.lit("t").alias("timestamp"), F.col("name").alias("actor"), F.lit("x").alias("action"))).cast(kind))
    rows = lifecycle.with_log_entry(lifecycle.with_log_entry(_users(s, d).withColumn("log", old), "log", "ana", "a", "t0"), "log", "bia", "b", "t1")
    return rows.select("user_id", F.array_join(F.transform("log", lambda e: e["actor"]), "|").alias("actors"), F.size("log").alias("n"))


@query("""
    select event_id, case when event_id % 2 = 0 then 'a=1;' else '' end || 'b=' || case when event_id % 3 = 0 then '2' else event_type end || case when event_id % 5 = 0 then '' else ';c=x' end as merged, case when event_id % 4 = 0 then null else event_type end as first_text from events""")
def merged_attributes(s, d):
    i = F.col("event_id")
    some = lambda on, k, v: F.when(on, F.create_map(F.lit(k), v)).otherwise(F.create_map().cast("map<string,string>"))
    old = F.map_concat(some(i % 2 == 0, "a", F.lit("1")), F.create_map(F.lit("b"), F.lit("2")))
    new = F.map_concat(F.create_map(F.lit("b"), F.when(i % 3 > 0, F.col("action"))), some(i % 5 > 0, "c", F.lit("x")))
    merged = F.array_sort(F.map_entries(enrich.merged_maps(old, new)))
    first = C.first_text(F.array(F.lit(None).cast("string"), F.lit(" "), F.when(i % 4 > 0, F.col("action"))))
    return _usage(s, d).select("event_id", F.array_join(F.transform(merged, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("merged"), first.alias("first_text"))


@query("select p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ', ,' || p_type, ','), lambda x: trim(x)), lambda x: x <> ''), '|') as parts from part")
def split_lists(s, d):
    return read(s, d, "part").select("p_partkey", F.array_join(C.split_list(F.concat("p_name", F.lit(", ,"), "p_type")), "|").alias("parts"))


# Pages and text


@query("""
    select page_id, lower(string_split(string_split(url, '//')[-1], '/')[1]) as host,
           nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '') as title from pages""")
def page_host_title(s, d):
    return read(s, d, "pages").select("page_id", C.host(F.col("url")).alias("host"), C.title(F.col("html")).alias("title"))


@query("""
    with u as (select page_id % 50 as grp, page_id, url, 'example.' || (case page_id % 50 % 3 when 0 then 'com' when 1 then 'net' else 'org' end) as dom from pages)
    select grp, page_id, (row_number() over (partition by grp order by contains(lower(url), dom) desc, case when contains(lower(url), dom) then -page_id else page_id end))::int as place from u""")
def url_priority(s, d):
    grp = F.col("page_id") % 50
    dom = F.concat(F.lit("example."), F.when(grp % 3 == 0, "com").when(grp % 3 == 1, "net").otherwise("org"))
    urls = read(s, d, "pages").select(grp.alias("grp"), "page_id", "url", dom.alias("dom"))
    return lifecycle.domain_first(urls, "grp", "page_id", "url", "dom").select("grp", "page_id", "place")


@query("""
    with f as (select event_id, event_id % 2 = 0 c, event_id % 3 = 0 l, event_id % 5 > 0 t, event_id % 7 > 0 a, event_id % 11 = 0 e, event_id % 13 = 0 stuck from events)
    select event_id, case when stuck then 'FALHOU' when e and not c then 'FALHA_API_EXTERNA' when c and l then 'CONCLUIDO_SUCESSO' when c then 'CONCLUIDO_COM_DADOS_PARCIAIS'
        when t or (l and not a) then 'NENHUMA_FONTE_ENCONTRADA' when not a then 'FALHA_CONFIGURACAO_API_EXTERNA' else 'FALHOU' end as status from f""")
def enrichment_status(s, d):
    i = F.col("event_id")
    return _usage(s, d).select("event_id", enrich.status(i % 2 == 0, i % 3 == 0, i % 5 > 0, i % 7 > 0, i % 11 == 0, i % 13 == 0).alias("status"))


def _marked_pages(s, d):
    """pages with metadata of five kinds put in front of their html, by number."""
    i, n = F.col("page_id") % 5, F.col("page_id").cast("string")
    text = lambda *parts: F.concat(*(n if p is None else F.lit(p) for p in parts))
    head = (
        F.when(i == 0, text('<script type="application/ld+json">{"@type":"Product","name":" A  ', None, ' ","sku":"S', None, '","brand":{"name":"X"},"offers":{"price":"9.5","priceCurrency":"BRL","availability":"https://schema.org/InStock"}}</script><meta property="og:title" content="og">'))
        .when(i == 1, text('<script type="application/ld+json">[{"@type":"Org"},{"@type":["Thing","Product"],"mpn":"M', None, '","image":["u1","u2"],"offers":[{"lowPrice":3}]}]</script><meta content="T', None, '" property="og:title"><meta property="og:description" content="it\'s">'))
        .when(i == 2, text('<div itemscope><span itemprop="name">Micro ', None, '</span><meta itemprop="price" content="7"></div><meta property="og:type" content="product"><meta content=\'B3\' property=\'og:brand\'>'))
        .when(i == 3, text('<meta property="og:title" content="only ', None, '"><meta property="og:brand" content="no product">'))
        .otherwise(F.lit(""))
    )
    return read(s, d, "pages").select("page_id", F.concat(head, F.col("html")).alias("html"))


@query("""
    select page_id, case page_id % 5 when 0 then 'A ' || page_id when 1 then 'T' || page_id when 2 then 'Micro ' || page_id when 3 then 'only ' || page_id end as name, case when page_id % 5 = 1 then 'it''s' end as short_description,
        case when page_id % 5 = 1 then 'u1' end as image, case page_id % 5 when 0 then 'X' when 2 then 'B3' end as brand, case page_id % 5 when 0 then 'S' || page_id when 1 then 'M' || page_id end as sku,
        case page_id % 5 when 0 then '9.5' when 1 then '3' when 2 then '7' end as price, case when page_id % 5 = 0 then 'BRL' end as currency, case when page_id % 5 = 0 then 'InStock' end as availability from pages""")
def metadata_priority_merge(s, d):
    return enrich.metadata(_marked_pages(s, d)).drop("html")


def _product_pages(s, d):
    """pages whose article is marked up as a Product with a nested Brand and Offer (those of a part), its heading and paragraphs being properties."""
    pages = read(s, d, "pages").join(read(s, d, "part"), F.col("page_id") + 1 == F.col("p_partkey"))
    brand = F.concat(F.lit('<div itemprop="brand" itemscope itemtype="https://schema.org/Brand"><span itemprop="name">'), "p_brand", F.lit("</span><p itemprop=slogan>of "), "p_type", F.lit("</div>"))
    offer = F.concat(F.lit("<div itemprop='offers' itemscope itemtype=Offer><meta itemprop=price content="), F.col("p_retailprice").cast("string"), F.lit('><link itemprop="availability" href="https://schema.org/InStock"></div></article>'))
    html = F.regexp_replace("html", "<article>", '<article itemscope itemtype="https://schema.org/Product">')
    html = F.replace(F.replace(html, F.lit("<h1>"), F.concat(brand, F.lit('<h1 itemprop="name">'))), F.lit("</article>"), offer)
    return pages.select("page_id", F.replace(html, F.lit("<p>"), F.lit("<p itemprop=description>")).alias("html"))


_UNESCAPED = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&')"
_SQUEEZED = r"nullif(trim(regexp_replace({}, '\s+', ' ', 'g')), '')"
_H1 = r"regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"
_P1 = r"regexp_replace(regexp_extract(html, '(?s)<p>(.*?)<(?:/?p|/article)>', 1), '</?b>|<br>', ' ', 'g')"


@query(f"""
    select page_id, {_SQUEEZED.format(_UNESCAPED.format(_H1))} as name, {_SQUEEZED.format(_UNESCAPED.format(_P1))} as short_description, p_brand as brand, p_retailprice as price, 'InStock' as availability
    from pages join part on p_partkey = page_id + 1""")
def microdata_products(s, d):
    """Items of real pages, in which paragraphs and bold runs are left open."""
    found = enrich.metadata(_product_pages(s, d))
    return found.select("page_id", "name", "short_description", "brand", F.col("price").cast("double").alias("price"), "availability")


@query("""
    select page_id, 0 as item, 'description' as name, (len(string_split(html, '<p>')) - 1)::bigint as n from pages join part on p_partkey = page_id + 1 where contains(html, '<p>')
    union all select page_id, 0, unnest(['brand', 'name', 'offers']), 1 from pages join part on p_partkey = page_id + 1
    union all select page_id, 1, unnest(['name', 'slogan']), 1 from pages join part on p_partkey = page_id + 1
    union all select page_id, 2, unnest(['price', 'availability']), 1 from pages join part on p_partkey = page_id + 1""")
def microdata_properties(s, d):
    return enrich.items(_product_pages(s, d), "page_id").groupBy("page_id", "item", "name").agg(F.count("*").alias("n"))


@query("select event_id, json_extract_string(props, '$.k') as k, try_cast(json_extract_string(props, '$.k') as int) as k_number, json_extract_string(props, '$.missing') as missing from events")
def json_props_extract(s, d):
    k = F.get_json_object("props", "$.k")
    return _usage(s, d).select("event_id", k.alias("k"), k.try_cast("int").alias("k_number"), F.get_json_object("props", "$.missing").alias("missing"))


@query("""
    with p as (select page_id // 4 as product, page_id % 4 as place, case when page_id % 3 <> 0 then 'n' || page_id end as name, case when page_id % 2 = 0 then 'd' || page_id end as descr, case when page_id % 5 <> 0 then 't' || page_id end as txt from pages),
    o as (select *, row_number() over w n, coalesce(max((name is not null and descr is not null)::int) over (partition by product order by place rows between unbounded preceding and 1 preceding), 0) stop from p window w as (partition by product order by place)),
    u as (select * from o where n <= 2 and stop = 0)
    select product, arg_max(name, n) filter (name is not null) as name, arg_max(descr, n) filter (descr is not null) as short_description, arg_min(txt, n) filter (txt is not null) as text, count(*)::bigint as n_pages from u group by product""")
def cross_page_fold(s, d):
    i = F.col("page_id")
    tag = lambda t: F.concat(F.lit(t), i.cast("string"))
    pages = read(s, d, "pages").select(F.floor(i / 4).cast("bigint").alias("product"), (i % 4).alias("place"), F.when(i % 3 != 0, tag("n")).alias("name"), F.when(i % 2 == 0, tag("d")).alias("short_description"), F.when(i % 5 != 0, tag("t")).alias("text"))
    return enrich.folded(pages, "product", "place", ["name", "short_description"], "text")


@query(r"""
    select doc_id, coalesce(len(list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), 1, 3)), 0)::int as n_titles,
           list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] as first_title from documents""")
def title_lines(s, d):
    found = C.lines(F.col("text"), 3)
    return read(s, d, "documents").select("doc_id", F.coalesce(F.size(found), F.lit(0)).alias("n_titles"), F.try_element_at(found, F.lit(1)).alias("first_title"))


@query("select doc_id, case when length(text) > 200 then left(text, 200) || '...' else text end as short from documents")
def shortened_texts(s, d):
    return read(s, d, "documents").select("doc_id", C.shorten(F.col("text")).alias("short"))


@query("select event_id, case event_id % 3 when 0 then 'note ' || props when 1 then props else '{ broken' end as said, case when event_id % 3 = 2 then '{ broken' else props end as found from events")
def json_in_text(s, d):
    i, p = F.col("event_id") % 3, F.col("props")
    said = F.when(i == 0, F.concat(F.lit("note "), p)).when(i == 1, p).otherwise(F.lit("{ broken"))
    return _usage(s, d).select("event_id", said.alias("said"), C.json_object_in(said).alias("found"))


@query("""
    select p_partkey, concat_ws(' ', p_name, p_brand, case when p_size > 25 then 'C' || p_size end, 'especificações técnicas detalhadas') as phrase,
        concat_ws(chr(10), 'Nome: ' || left(p_name, 200), 'Marca: ' || left(p_brand, 200), p_type) as context, concat_ws(chr(10), 'Marca: ' || left(repeat(p_brand, 40), 200), left(repeat(p_type, 90), 1000)) as short_context from part""")
def search_phrases(s, d):
    code = F.when(F.col("p_size") > 25, F.concat(F.lit("C"), F.col("p_size").cast("string")))
    phrase = enrich.search_phrase(F.col("p_name"), F.col("p_brand"), code, F.lit(None).cast("string"))
    context = enrich.prompt_context({"Nome": F.col("p_name"), "Código": F.lit(None).cast("string"), "Marca": F.col("p_brand")}, F.col("p_type"))
    short = enrich.prompt_context({"Marca": F.repeat("p_brand", F.lit(40))}, F.repeat("p_type", F.lit(90)), enrich.SHORT_PROMPT_TEXT)
    return read(s, d, "part").select("p_partkey", phrase.alias("phrase"), context.alias("context"), short.alias("short_context"))


@query("select p_partkey, 'cor' as k, p_name as v from part where p_partkey % 3 > 0 union all select p_partkey, 'peso', p_size::varchar || ' kg' from part where p_partkey % 4 > 1")
def kept_suggestions(s, d):
    k = F.col("p_partkey")
    one = lambda key, value: F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))
    got = F.array(one("cor", F.when(k % 3 > 0, F.col("p_name")).otherwise(F.lit(" "))), one("x", F.col("p_type")), one("peso", F.when(k % 4 > 1, F.concat(F.col("p_size").cast("string"), F.lit(" kg")))))
    rows = read(s, d, "part").select("p_partkey", F.explode(enrich.kept_suggestions(got, F.array(F.lit("cor"), F.lit("peso")))).alias("g"))
    return rows.select("p_partkey", F.col("g.key").alias("k"), F.col("g.value").alias("v"))


@query("""
    select p_partkey as page, case when p_partkey % 3 = 2 then coalesce(nullif(p_name, ''), p_brand) else p_name end as nome_base, case when p_partkey % 3 < 2 then p_brand || ': x' end as marca,
        case when p_partkey % 3 = 2 then 2 when p_partkey % 3 = 1 then 1 else 0 end as n_leftovers from part""")
def region_key_values(s, d):
    """Regions of pages as text to pairs, and these to standard fields."""
    kind = F.col("p_partkey") % 3
    text = F.when(kind == 0, F.concat(F.lit("Nome: "), "p_name", F.lit("\nMarca :  "), "p_brand", F.lit(": x\nno pair"))).when(kind == 1, F.concat(F.lit(" nome:"), "p_name", F.lit("\n\nMarca: "), "p_brand", F.lit(": x\nCor: azul"))).otherwise(F.concat("p_name", F.lit("\n \n"), "p_brand"))
    pairs = P.region_pairs(read(s, d, "part").select(F.col("p_partkey").alias("page"), text.alias("text")))
    headers = ["nome", "Nome", "Marca", "Cor", "col_0", "col_1"]
    cells = pairs.select("page", *(F.try_element_at("pairs", F.lit(h)).alias(f"h{i}") for i, h in enumerate(headers)))
    named = ingest.standardise(cells.toDF("page", "nome", "Nome ", *headers[2:]), ["nome", "Nome ", *headers[2:]], None, ("page",))
    return named.select("page", "nome_base", "marca", F.size("leftovers").alias("n_leftovers"))


_GONE_TAGS = "|".join(rf"<{t}\b.*?</{t}\s*>" for t in ("script", "style", "nav", "header", "footer", "noscript", "head"))


@query(rf"""
    with t as (select page_id, regexp_replace(regexp_replace(html, '(?is){_GONE_TAGS}|<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') as t from pages),
    e as (select page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') as t from t)
    select page_id, nullif(trim(regexp_replace(t, '\s+', ' ', 'g')), '') as text from e""")
def page_main_text(s, d):
    return read(s, d, "pages").select("page_id", C.visible_text(F.col("html")).alias("text"))


@query(rf"""
    with h as (select page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<title\b.*?</title>|<footer\b.*?</footer>|<!--.*?-->|<!doctype[^>]*>', '', 'g'), '<h1>', '<p>' || chr(1), 'g') as h from pages),
    b as (select page_id, unnest(parts) as b, generate_subscripts(parts, 1) as i from (select page_id, string_split_regex(h, '(?i)</?(?:p|div|ul|li|h1|article|body|html|head|nav|meta)\b[^>]*>') parts from h)),
    t as (select page_id, i, contains(b, chr(1)) as heading, {_SQUEEZED.format(_UNESCAPED.format("regexp_replace(regexp_replace(replace(b, chr(1), ''), '<br>', ' ', 'g'), '<[^>]+>', '', 'g')"))} as t,
                 len(regexp_extract_all(array_to_string(regexp_extract_all(b, '(?is)<a\b[^>]*>(.*?)</a>', 1), ' '), '\S+')) as linked from b),
    w as (select page_id, i, heading, t, len(regexp_extract_all(t, '\S+')) as words, linked from t where t is not null),
    n as (select *, linked / words as d, coalesce(lag(words) over p, 0) as w0, coalesce(lag(linked / words) over p, 0) as d0, coalesce(lead(words) over p, 0) as w1 from w window p as (partition by page_id order by i)),
    g as (select *, d <= 1 / 3 and case when d0 <= 5 / 9 then not (words <= 16 and w1 <= 15 and w0 <= 4) else not (words <= 40 and w1 <= 17) end as good from n),
    k as (select *, good or (heading and coalesce(lead(good) over (partition by page_id order by i), false)) as kept from g)
    select page_id, string_agg(t, chr(10) order by i) filter (kept) as text from k group by 1""")
def page_article_text(s, d):
    """Main text by density of words and links, of pages whose menus are no nav elements."""
    pages = read(s, d, "pages").select("page_id", F.regexp_replace("html", r"(</?)nav\b", "$1div").alias("html"))
    return enrich.main_text(pages).select("page_id", F.col("main_text").alias("text"))


@query("select n_nationkey, n_name from nation where n_nationkey < 5 and (n_regionkey in (select n_regionkey from nation where n_nationkey >= 5))")
def type_key_conflicts(s, d):
    types = read(s, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").cast("string").alias("key"), F.lit(None).cast("int").alias("owner"))
    rows = types.where("n_nationkey < 5")
    return reading.key_conflicts(rows, types.where("n_nationkey >= 5"), "key", "owner", "n_nationkey").select("n_nationkey", "n_name")


@query("""
    select event_id, case when event_id % 4 = 1 then 'b' when event_id % 4 = 2 then 'b' end as json_error from events""")
def json_coercion(s, d):
    i = F.col("event_id") % 4
    rows = _usage(s, d).select("event_id", F.col("props").alias("a"), F.when(i == 1, F.lit("{ broken")).when(i == 2, F.lit("[1]")).when(i == 3, F.col("props")).alias("b"))
    return ingest.coerced_json(rows, ["a", "b"]).select("event_id", "json_error")


@query("""
    select event_id, case when event_id % 5 in (0, 3) then case when event_id % 5 = 0 then event_type || '|b' else '' end end as options, event_id % 5 in (0, 2, 3) as valid from events""")
def options_coercion(s, d):
    i = F.col("event_id") % 5
    text = F.when(i == 0, F.concat(F.lit('["'), "action", F.lit('","b"]'))).when(i == 1, F.col("props")).when(i == 3, F.lit("[]")).when(i == 4, F.concat("action", F.lit(",y")))
    made = _usage(s, d).select("event_id", ingest.coerced_options(text).alias("o"))
    return made.select("event_id", F.array_join("o.options", "|").alias("options"), F.col("o.valid").alias("valid"))


@query("select r_regionkey as id, unnest(range(2, (r_regionkey + 3)::bigint))::int as page from region")
def import_page_plan(s, d):
    files = read(s, d, "region").select(F.col("r_regionkey").alias("id"), (F.col("r_regionkey") + 2).alias("total_pages"))
    return ingest.page_plan(files, 2)


@query(r"""
    select doc_id as page, 'Conteúdo da Página ' || doc_id as nome_base, 'texto_completo_pagina_' || doc_id as k, left(regexp_replace(text, '^\s+|\s+$', '', 'g'), 20000) as v
    from documents where trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def page_text_fallback(s, d):
    pages = read(s, d, "documents").select(F.col("doc_id").alias("page"), "text")
    return P.page_texts(pages).select("page", "nome_base", F.explode("leftovers").alias("k", "v"))


def _grids(s, d):
    """Suppliers' documents of pages with text, and with tables on some: a part is a page, ten parts a document."""
    k = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    table = F.array(F.array(F.lit(" Nome "), F.lit("nan"), F.lit("SKU")), F.array(F.col("p_name"), F.col("p_brand"), size), F.array(F.col("p_type"), size))
    more = F.array(F.array(F.lit("SKU"), F.lit(None).cast("string")), F.array(size, F.lit(" ")), F.array(F.lit(""), F.col("p_name")))
    none = F.array().cast("array<array<array<string>>>")
    tables = F.when(k % 30 < 10, none).when(k % 3 == 0, F.array(table)).when(k % 3 == 1, F.array(table, more)).otherwise(F.array(F.slice(table, 1, 1)))
    text = F.when(k % 4 > 0, F.concat(F.lit(" "), F.col("p_name"), F.lit("  x \n\n"), F.col("p_brand"), F.lit("  "), F.col("p_type"), F.lit("\nlast\n4th")))
    return read(s, d, "part").select(F.floor(k / 10).cast("bigint").alias("document"), k.alias("page"), text.alias("text"), tables.alias("tables"))


_GRID_ROWS = """
    select p_partkey as page, 0 as tab, 0 as rw, 'Nome=' || p_name || ';coluna_vazia_1=' || p_brand || ';SKU=' || p_size as cells from part where p_partkey % 30 >= 10 and p_partkey % 3 < 2
    union all select p_partkey, 1, 0, 'SKU=' || p_size || ';coluna_vazia_1= ' from part where p_partkey % 30 >= 10 and p_partkey % 3 = 1
    union all select p_partkey, 1, 1, 'SKU=;coluna_vazia_1=' || p_name from part where p_partkey % 30 >= 10 and p_partkey % 3 = 1"""
_PAGE_TEXT = "p_name || '  x ' || chr(10) || chr(10) || p_brand || '  ' || p_type || chr(10) || 'last' || chr(10) || '4th'"


def _cells_text(cells):
    return F.array_join(F.transform(F.map_entries(cells), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";")


@query(f"select page, tab::int as tab, rw::int as rw, cells from ({_GRID_ROWS})")
def page_table_rows(s, d):
    return P.table_rows(_grids(s, d)).select("page", F.col("table").alias("tab"), F.col("row").alias("rw"), _cells_text("cells").alias("cells"))


@query(f"""
    with g as ({_GRID_ROWS})
    select page // 10 as document, page, cells from g
    union all select p_partkey // 10, p_partkey, 'texto_completo_pagina_' || p_partkey || '=' || {_PAGE_TEXT} from part where p_partkey % 4 > 0 and p_partkey // 10 not in (select page // 10 from g)""")
def document_rows(s, d):
    return P.document_rows(_grids(s, d), "document").select("document", "page", _cells_text("cells").alias("cells"))


@query(f"""
    select p_partkey as page, case when p_partkey % 30 >= 10 and p_partkey % 3 < 2 then 'Nome|nan|SKU' when p_partkey % 4 > 0 then regexp_replace(p_name || ' x', '\\s+', '|', 'g') else '' end as headers,
        case when p_partkey % 30 >= 10 and p_partkey % 3 < 2 then p_name || '|' || p_brand || '|' || p_size || ';' || p_type || '|' || p_size
             when p_partkey % 4 > 0 then regexp_replace(p_brand || ' ' || p_type, '\\s+', '|', 'g') || ';last;4th' else '' end as rows from part""")
def single_page_rows(s, d):
    joined = lambda rows: F.array_join(F.transform(rows, lambda r: F.array_join(r, "|")), ";")
    return P.single_page(_grids(s, d)).select("page", F.array_join("headers", "|").alias("headers"), joined(F.col("rows")).alias("rows"))


_REGION = """
    select p_partkey as page, case when p_partkey % 30 >= 10 then ' Nome |nan|SKU' when p_partkey % 4 > 0 then p_name || '|x' else '' end as headers,
        case when p_partkey % 30 >= 10 and p_partkey % 3 < 2 then p_name || '|' || p_brand || '|' || p_size || ';' || p_type || '|' || p_size || case when p_partkey % 3 = 1 then ';SKU|;' || p_size || '| ;|' || p_name else '' end
             when p_partkey % 30 >= 10 then '' when p_partkey % 4 > 0 then ';' || p_brand || '|' || p_type || ';last;4th' else '' end as rows from part"""


@query(_REGION)
def region_table_rows(s, d):
    joined = lambda rows: F.array_join(F.transform(rows, lambda r: F.array_join(r, "|", "")), ";")
    return P.region_rows(_grids(s, d)).select("page", F.array_join("headers", "|").alias("headers"), joined(F.col("rows")).alias("rows"))


@query(f"select page, case when p_partkey % 4 > 0 then ' ' || {_PAGE_TEXT} else '' end as text, nullif(rows, '') as tab from ({_REGION}) join part on p_partkey = page")
def full_page(s, d):
    joined = lambda rows: F.array_join(F.transform(rows, lambda r: F.array_join(r, "|", "")), ";")
    return P.full_page(_grids(s, d)).select("page", "text", joined(F.col("table")).alias("tab"))


@query("""
    select p_partkey as page, p_partkey % 30 >= 10 as has_table, case when p_partkey % 4 > 0 then ' ' || p_name || '  x ' || chr(10) || chr(10) || p_brand || '  ' || p_type else '' end as snippet
    from part where p_partkey between 5 and 904""")
def page_preview(s, d):
    return P.preview(_grids(s, d), 5, 900)


@query(f"with recursive {_UPSERT} select (count(*) filter (change = 'created'))::bigint as created, (count(*) filter (change = 'updated'))::bigint as updated, (select count(*) from g where not accepted)::bigint as errors from st")
def import_result_summary(s, d):
    return lifecycle.result_summary(_state(s, d), _deduped(s, d).where("not accepted"))


@query("""
    select c_custkey, case when c_custkey % 5 = 0 then 'CONCLUIDO_SUCESSO' when c_custkey % 2 = 0 then 'CONCLUIDO_COM_DADOS_PARCIAIS' when c_custkey % 3 = 0 then 'CONCLUIDO_SUCESSO' else 'NENHUMA_FONTE_ENCONTRADA' end as status,
        case when c_custkey % 2 = 0 then left(repeat(c_name, c_custkey::int), 15000) end as text from customer""")
def status_by_parts(s, d):
    """Texts are made to the characters kept, as further repeats can't change those; the rows are dealt over tasks first, as a few MB of names become GB of texts."""
    k = F.col("c_custkey")
    meta = (k % 5 == 0) | ((k % 2 != 0) & (k % 3 == 0))
    enough = F.ceil(enrich.TEXT_KEPT / F.greatest(F.length("c_name"), F.lit(1)))
    made = F.when(k % 2 == 0, F.repeat("c_name", F.least(k, enough).cast("int")))
    rows = read(s, d, "customer").select("c_custkey", "c_name").repartition(s.sparkContext.defaultParallelism).select("c_custkey", made.alias("text"))
    text = F.col("text")
    return rows.select("c_custkey", enrich.status_by_parts(text.isNotNull(), meta).alias("status"), enrich.kept_text(text).alias("text"))


# Files written from tables and read again


def _written(df, suffix: str, **options) -> str:
    path = scratch(df.sparkSession, suffix)
    df.write.options(header=True, escape='"', **options).csv(path)
    return path


def _file_of_parts(s, d):
    """Parts as a supplier's file; names hold delimiters, quotes and line feeds, brands are empty at times."""
    name = F.concat("p_name", F.lit('\n"'), "p_type", F.lit('"; x'))
    return read(s, d, "part").select(name.alias("nome"), F.col("p_partkey").alias("sku"), F.nullif("p_brand", F.lit("Brand#11")).alias("marca"))


_FILE_OF_PARTS = """select p_name || chr(10) || '"' || p_type || '"; x' as nome, p_partkey::varchar as sku, nullif(p_brand, 'Brand#11') as marca from part"""


@query(_FILE_OF_PARTS)
def delimited_rows(s, d):
    """A semicolon file whose cells go on over lines, by the dispatch on its extension."""
    path = _written(_file_of_parts(s, d), ".csv", sep=";", nullValue="")
    return catalogue.read_file(s, path).select("nome", "sku", "marca")


@query("select s_name || ' é' as nome, s_suppkey::varchar as sku from supplier")
def utf16_rows(s, d):
    rows = read(s, d, "supplier").select(F.concat("s_name", F.lit(" é")).alias("nome"), F.col("s_suppkey").alias("sku"))
    return catalogue.read_file(s, _written(rows, ".csv", sep="\t", encoding="UTF-16LE")).select("nome", "sku")


@query(f"select * from ({_FILE_OF_PARTS} order by p_partkey limit 7)")
def delimited_preview(s, d):
    rows = _file_of_parts(s, d).orderBy(F.col("sku")).coalesce(1)
    return catalogue.preview_file(s, _written(rows, ".csv", sep=";", nullValue=""), 7)[1]


def _books(rows, key: str, names: list[str]):
    """path, content: a workbook for each value of key, with a sheet of all rows and one of every row's first two columns, headed alike."""
    import pyarrow as pa

    def sheet(cells: list[list]) -> str:
        text = lambda v: f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>' if isinstance(v, str) else "<c/>" if v is None else f"<c><v>{v}</v></c>"
        return '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join("<row>" + "".join(map(text, r)) + "</row>" for r in cells) + "</sheetData></worksheet>"

    def book(table: pa.Table) -> pa.Table:
        body = [list(r) for r in zip(*(table.column(n).to_pylist() for n in names), strict=True)]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="A" r:id="a"/><sheet name="B" r:id="b"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/a.xml"/><Relationship Id="b" Target="worksheets/b.xml"/></Relationships>')
            z.writestr("xl/worksheets/a.xml", sheet([names, *body]))
            z.writestr("xl/worksheets/b.xml", sheet([[names[0], names[0]], *(r[:2] for r in body)]))
        return pa.table({"path": [str(table.column(key)[0].as_py())], "content": pa.array([out.getvalue()], pa.binary())})

    return rows.groupBy(key).applyInArrow(book, "path string, content binary")


@query("""
    with p as (select p_partkey // 200 as path, p_name, p_brand, p_size from part)
    select path::varchar as path, 'A' as sheet, p_name as nome, p_brand as other, p_size::varchar as size from p union all select path::varchar, 'B', p_name, p_brand, null from p""")
def workbook_rows(s, d):
    """Both sheets of workbooks one after another; the second has one header twice."""
    parts = read(s, d, "part").select(F.floor(F.col("p_partkey") / 200).cast("bigint").alias("file"), F.col("p_name").alias("nome"), F.col("p_brand").alias("marca"), F.col("p_size").alias("tamanho"))
    cell = lambda n: F.try_element_at("cells", F.lit(n))
    rows = workbook.rows_of(_books(parts, "file", ["nome", "marca", "tamanho"]))
    return rows.select("path", "sheet", cell("nome").alias("nome"), F.coalesce(cell("marca"), cell("nome.1")).alias("other"), cell("tamanho").alias("size"))


@query("select event_id, contains(said, 'k\\v') as found from (select event_id, case when props like '%1%' then lower(props) || 'k\\v' else props end as said from events) where contains(lower(said), 'k\\v')")
def backslash_search(s, d):
    said = F.when(F.col("props").contains("1"), F.concat(F.lower("props"), F.lit("k\\v"))).otherwise(F.col("props"))
    return reading.search(_usage(s, d).select("event_id", said.alias("said")), ["said"], "K\\V").select("event_id", F.col("said").contains("k\\v").alias("found"))


# Deep pages, searches by postings, written products


@query("select o_orderkey, o_orderpriority, o_totalprice from orders order by o_orderpriority desc, o_totalprice, o_orderkey limit 50 offset (select count(*) // 2 from orders)")
def deep_order_page(s, d):
    """A page in the middle of all orders, whose first sort column has five values."""
    orders = read(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return reading.deep_page(orders, [("o_orderpriority", True), ("o_totalprice", False), ("o_orderkey", False)], orders.count() // 2, 50, enough=500)


@query("select event_id, ts, val from (select event_id, ts, case when event_id % 3 > 0 then value end as val from events) order by val desc nulls last, event_id limit 20 offset (select count(*) * 2 // 3 - 7 from events)")
def deep_page_into_nulls(s, d):
    events = _usage(s, d).select("event_id", "ts", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("val"))
    return reading.deep_page(events, [("val", True), ("event_id", False)], events.count() * 2 // 3 - 7, 20, enough=100)


def _indexed(df, key: str, columns: list[str]):
    """Postings of a table, written and read again as a partitioned index."""
    path = scratch(df.sparkSession)
    reading.trigram_index(df, key, columns).write.partitionBy("gram_bucket").parquet(path)
    return df.sparkSession.read.parquet(path)


@query("select doc_id, source from documents where lower(text) like '%ing%the_o%' or lower(source) like '%ing%the_o%'")
def indexed_document_search(s, d):
    docs = read(s, d, "documents").select("doc_id", "source", "text")
    return reading.search_indexed(docs, _indexed(docs, "doc_id", ["text", "source"]), "doc_id", ["text", "source"], "Ing%the_o").select("doc_id", "source")


@query("select p_partkey, p_name from part where lower(p_name) like '%ring%' or lower(p_type) like '%al%'")
def indexed_and_short_search(s, d):
    """A term of three letters and more by postings, and a shorter one by a scan."""
    part = read(s, d, "part").select("p_partkey", "p_name", "p_type")
    index = _indexed(part, "p_partkey", ["p_name"])
    long = reading.search_indexed(part, index, "p_partkey", ["p_name"], "RING")
    return long.union(reading.search_indexed(part, index, "p_partkey", ["p_type"], "AL")).select("p_partkey", "p_name").distinct()


def _stored(s, d):
    """Products written as a table, after the import's changes are put in place."""
    path = scratch(s)
    writes.create(_existing(s, d), path, ["tenant", "id"], 16)
    writes.apply_upsert(s, path, _state(s, d), ["tenant", "id"])
    return path


@query(f"with recursive {_UPSERT} select tenant, id::bigint as id, sku, ean, label from st")
def stored_upsert(s, d):
    return writes.read(s, _stored(s, d)).select("tenant", F.col("id").cast("bigint").alias("id"), "sku", "ean", "label")


@query(f"with recursive {_UPSERT} select tenant, id::bigint as id, label from st where change <> 'updated' or sku is null or length(sku) <> 1")
def stored_deletes(s, d):
    """Updated products with an SKU of one character are deleted from the written table."""
    path = _stored(s, d)
    gone = _state(s, d).where("change = 'updated' and length(sku) = 1").select("tenant", "id")
    writes.delete_rows(s, path, gone, ["tenant", "id"])
    return writes.read(s, path).select("tenant", F.col("id").cast("bigint").alias("id"), "label")


@query(f"select event_type as action, count(*)::bigint as n_uses from events where {_MONTH} group by 1")
def usage_by_action_rolled(s, d):
    """From a roll-up of the first events, extended twice, the last time by a few."""
    usage = _usage(s, d)
    most = usage.agg(F.max("event_id")).first()[0] or 0
    first = analytics.month_counts(usage.where(F.col("event_id") <= most // 2))
    then = analytics.extended(first, usage.where(F.col("event_id") <= most - 10))
    return analytics.rolled_usage_by_action(analytics.compacted(analytics.extended(then, usage)), AS_OF)


@query(SQL["usage_by_plan"])
def usage_by_plan_rolled(s, d):
    roll_up = analytics.month_counts(_usage(s, d))
    return analytics.rolled_usage_by_plan(_users(s, d).select("plan").distinct(), _users(s, d), roll_up, AS_OF)


def _attribute_rows(s, d):
    """Parts as products of the type that their brand has, with attributes from their columns; templates by brand from the same table."""
    text = lambda c: F.col(c).cast("string")
    some = F.map_filter(F.create_map(F.lit("tipo"), text("p_type"), F.lit("tamanho"), text("p_size"), F.lit("preco"), text("p_retailprice"), F.lit("cor"), F.split("p_name", " ")[0]), lambda k, v: ~((k == "cor") & v.like("s%")) & ~((k == "tamanho") & (v == "7")))
    products = read(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("type_id"), some.alias("attributes"))
    types = read(s, d, "part").groupBy(F.col("p_brand").alias("type_id")).agg(F.min("p_type").alias("low"), F.max("p_type").alias("high"), F.min(F.split("p_name", " ")[0]).alias("colour"))
    row = lambda key, kind, options, need, default: F.struct(F.lit(key).alias("attribute_key"), F.lit(kind).alias("field_type"), options.cast("array<string>").alias("options"), F.lit(need).alias("is_required"), F.lit(default).cast("string").alias("default_value"))
    some_rows = F.array(row("tipo", "select", F.array("low", "high"), True, None), row("tamanho", "number", F.lit(None), True, None), row("preco", "boolean", F.lit(None), False, None), row("cor", "multiselect", F.array("colour"), False, "azul"))
    return products, types.select("type_id", F.explode(F.when(F.col("type_id").endswith("1"), F.slice(some_rows, 1, 2)).otherwise(some_rows)).alias("t")).select("type_id", "t.*")


@query("""
    with t as (select p_brand, min(p_type) low, max(p_type) high, min(string_split(p_name, ' ')[1]) colour from part group by 1),
    p as (select p_partkey as id, p_brand like '%1' as few, p_type not in (low, high) as bad_type, p_size = 7 as no_size, string_split(p_name, ' ')[1] as cor, colour from part join t using (p_brand)),
    r as (select id, case when bad_type then 'tipo: not an option' end a, case when no_size then 'tamanho: missing' end b, case when few then 'preco: unknown' else 'preco: not a boolean' end c,
                 case when few then case when cor not like 's%' then 'cor: unknown' end when cor like 's%' then case when colour <> 'azul' then 'cor: not an option' end when cor <> colour then 'cor: not an option' end e from p)
    select id, array_to_string(list_sort(list_filter([a, b, c, e], lambda x: x is not null)), '; ') as reasons from r""")
def attribute_rejects(s, d):
    checked = templates.checked_attributes(*_attribute_rows(s, d))
    return templates.rejected(checked).select("id", F.array_join("reasons", "; ").alias("reasons"))


def _some_blank(s, d):
    """Import rows of which short SKUs and EANs are empty or missing."""
    short = lambda c, n, instead: F.when(F.length(c) <= n, F.lit(instead).cast("string")).otherwise(F.col(c)).alias(c)
    return _import_rows(s, d).select("user_id", "event_id", short("sku", 1, ""), short("ean", 2, None))


_BLANKS = _GREEDY.replace("json_extract_string(props, '$.k') sku", "case when length(json_extract_string(props, '$.k')) > 1 then json_extract_string(props, '$.k') end sku").replace("floor(value)::bigint::varchar ean", "case when length(floor(value)::bigint::varchar) > 2 then floor(value)::bigint::varchar end ean")


@query(f"with recursive {_BLANKS} select user_id, event_id, accepted from g")
def blank_key_dedup(s, d):
    """Empty and missing keys clash with nothing."""
    return ingest.greedy_dedup(_some_blank(s, d), "user_id", "event_id", ["sku", "ean"]).select("user_id", "event_id", "accepted")


@query(f"with recursive {_BLANKS} select user_id, event_id, accepted from g")
def blank_key_dedup_in_rounds(s, d):
    """The same, with all users decided in rounds."""
    rows = _some_blank(s, d)
    return ingest.greedy_dedup(rows, "user_id", "event_id", ["sku", "ean"], most=1).select("user_id", "event_id", "accepted")


@query("""
    select p_partkey, p_name as nome_base, coalesce(case when p_size > 25 then p_type end, nullif(p_brand, 'Brand#7')) as obs, 1 + (p_size % 2) as n_leftovers
    from part where p_size > 25 or p_brand <> 'Brand#7'
    union all select p_partkey, p_name, null, p_size % 2 from part where p_size <= 25 and p_brand = 'Brand#7'""")
def repeated_headers(s, d):
    """Two columns whose headers differ in white space are one leftover: the last one with a value counts."""
    part = read(s, d, "part")
    rows = part.select("p_partkey", F.col("p_name").alias("nome"), F.nullif("p_brand", F.lit("Brand#7")).alias("Obs"), F.when(F.col("p_size") % 2 == 1, F.col("p_brand")).alias("Cor"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("Obs "))
    found = ingest.standardise(rows, ["nome", "Obs", "Cor", "Obs "], None, ("p_partkey",))
    return found.select("p_partkey", "nome_base", F.try_element_at("leftovers", F.lit("Obs")).alias("obs"), F.size("leftovers").alias("n_leftovers"))

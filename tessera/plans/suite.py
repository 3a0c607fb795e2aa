"""The registered queries of the engine's own operators, each with the same question in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as S

from tessera.functions import vectors as V
from tessera.functions.fields import F, typed
from tessera.operators import aggregates, joins, sets, traverse
from tessera.operators.aggregates import Spec
from tessera.operators.parallel import clustered, flat_scan, parallel_scan
from tessera.operators.sets import Mapping, Multimap, Multiset, PositionalList
from tessera.operators.vector_index import ExactIndex, IvfIndex
from tessera.plans.query import Query, from_collection
from tessera.plans.tokens import compile_predicate
from tessera.sources import stage
from tessera.sources.io import arrow_to_parquet, from_rows, parquet_rows, scan_parquet, to_arrow, to_parquet, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """t.orders is the table orders of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def q(self, name: str) -> Query:
        return from_collection(getattr(self, name))


def query(sql: str | None = None) -> Callable:
    def add(fn: Callable[[Tables], DataFrame | Query]) -> Callable:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = fn(Tables(spark, folder))
            return out.df if isinstance(out, Query) else out

        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


# predicates


def _tokens(name: str, table: str, tokens: list, columns: str, where: str) -> None:
    def run(t: Tables) -> Query:
        q = t.q(table).where(tokens)
        return q.select({c: c for c in columns.split(", ")})

    run.__name__ = name
    query(f"select {columns} from {table} where {where}")(run)


ORDER = "o_orderkey, o_orderstatus, o_totalprice"
_tokens("where_eq", "orders", ["o_orderstatus", "==", "P"], ORDER, "o_orderstatus is not distinct from 'P'")
_tokens("where_ne", "orders", ["o_orderstatus", "!=", "O"], ORDER, "o_orderstatus is distinct from 'O'")
_tokens("where_gt", "orders", ["o_totalprice", ">", 200000.0], ORDER, "o_totalprice > 200000")
_tokens("where_ge", "orders", ["o_orderkey", ">=", 9000], ORDER, "o_orderkey >= 9000")
_tokens("where_lt", "orders", ["o_totalprice", "<", 50000.0], ORDER, "o_totalprice < 50000")
_tokens("where_le", "orders", ["o_orderkey", "<=", 100], ORDER, "o_orderkey <= 100")
_tokens("where_in", "customer", ["c_mktsegment", "in", ["BUILDING", "MACHINERY", None]], "c_custkey, c_mktsegment", "c_mktsegment in ('BUILDING','MACHINERY') or c_mktsegment is null")
_tokens("where_contains_str", "part", ["p_name", "contains", "1"], "p_partkey, p_name", "contains(p_name, '1')")
_tokens("where_is_true", "labels", ["toxic", "?T"], "doc_id, quality", "coalesce(toxic <> 0, false)")
_tokens("where_not_true", "labels", ["toxic", "?!T"], "doc_id, quality", "not coalesce(toxic <> 0, false)")
_tokens("between_closed", "part", ["p_size", "between[]", 10, 20], "p_partkey, p_size", "p_size >= 10 and p_size <= 20")
_tokens("between_open", "part", ["p_size", "between()", 10, 20], "p_partkey, p_size", "p_size > 10 and p_size < 20")
_tokens("between_left_open", "part", ["p_size", "between(]", 10, 20], "p_partkey, p_size", "p_size > 10 and p_size <= 20")
_tokens("between_right_open", "part", ["p_size", "between[)", 10, 20], "p_partkey, p_size", "p_size >= 10 and p_size < 20")
_tokens("where_and", "orders", [["o_orderstatus", "==", "F"], ["o_totalprice", ">", 100000.0]], ORDER, "o_orderstatus = 'F' and o_totalprice > 100000")
_tokens("where_or", "orders", ["|", ["o_orderstatus", "==", "P"], ["o_totalprice", ">", 300000.0]], ORDER, "o_orderstatus = 'P' or o_totalprice > 300000")
_tokens("where_not", "orders", ["!", ["o_totalprice", ">", 100000.0]], ORDER, "not coalesce(o_totalprice > 100000, false)")
_tokens("where_nested", "orders", ["&", ["|", ["o_orderstatus", "==", "F"], ["o_orderstatus", "==", "P"]], ["!", ["o_orderkey", "between[]", 100, 9000]]], ORDER, "(o_orderstatus = 'F' or o_orderstatus = 'P') and not (o_orderkey between 100 and 9000)")
_tokens("where_true", "region", [], "r_regionkey, r_name", "true")
_tokens("index_pk_lookup", "orders", ["o_orderkey", "==", 42], ORDER, "o_orderkey = 42")
_tokens("index_and_range", "lineitem", [["l_returnflag", "==", "R"], ["l_linestatus", "==", "F"], ["l_quantity", "between()", 10.0, 14.0]], "l_orderkey, l_partkey, l_quantity", "l_returnflag = 'R' and l_linestatus = 'F' and l_quantity > 10 and l_quantity < 14")
_tokens("index_or", "lineitem", ["|", ["l_partkey", "==", 7], ["l_suppkey", "==", 3]], "l_orderkey, l_partkey, l_suppkey", "l_partkey = 7 or l_suppkey = 3")


LABELLED = "(select d.doc_id, d.lang, l.quality from documents d left join labels l using (doc_id))"


def _labelled(t: Tables) -> Query:
    return from_collection(t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left"))


@query(f"select doc_id, lang from {LABELLED} where quality is null")
def where_is_null(t):
    return _labelled(t).where(["quality", "?N"]).select({"doc_id": "doc_id", "lang": "lang"})


@query(f"select doc_id, quality from {LABELLED} where quality is not null")
def where_not_null(t):
    return _labelled(t).where(["quality", "?!N"]).select({"doc_id": "doc_id", "quality": "quality"})


@query(f"select doc_id, quality from {LABELLED} where not coalesce(quality > 0, false)")
def where_not_null_semantics(t):
    return _labelled(t).where(~(F.quality > 0)).select({"doc_id": "doc_id", "quality": "quality"})


@query("select c_custkey from customer where list_contains(string_split(c_name, '#'), 'Customer')")
def where_contains_array(t):
    q = t.q("customer").with_field("parts", S.split("c_name", "#"))
    return q.where(["parts", "contains", "Customer"]).select({"c_custkey": "c_custkey"})


@query("select p_partkey from part where p_size >= 5 and p_size < 9")
def lambda_between(t):
    return t.q("part").on_unsupported("error").where(lambda x: 5 <= x.p_size < 9).select({"p_partkey": "p_partkey"})


@query("select event_id from events where event_id % 7 = 3")
def udf_predicate(t):
    return t.q("events").where(lambda r: int(str(r.event_id)) % 7 == 3).select({"event_id": "event_id"})


# projections and functions


@query("select p_partkey as id, p_name as name from part")
def select_rename(t):
    return t.q("part").select({"id": "p_partkey", "name": F.p_name})


@query("select p_partkey as id, p_size * 2 + 1 as twice, cast(null as varchar) as absent from part")
def select_computed(t):
    return t.q("part").select({"id": "p_partkey", "twice": lambda r: r.p_size * 2 + 1, "absent": "no_such"})


@query("select p_partkey, round(p_retailprice + p_size, 4) as a, round(p_retailprice - p_size, 4) as s, p_size * 3 as m, round(p_retailprice / p_size, 6) as d, case when p_size = 0 then 1.0 else round(p_retailprice / p_size, 6) end as d1 from part")
def fn_arith(t):
    return t.q("part").select({"p_partkey": "p_partkey", "a": _round(F.p_retailprice + F.p_size, 4), "s": _round(F.p_retailprice - F.p_size, 4), "m": F.p_size * 3, "d": _round(F.p_retailprice / F.p_size, 6), "d1": _round(F.p_retailprice.divide_or_one(F.p_size), 6)})


def _round(e, n: int):
    return e.apply(lambda c: S.round(c, n))


@query("select lower(c_name) as l, upper(c_mktsegment) as u, c_custkey from customer")
def fn_lower_upper(t):
    return t.q("customer").select({"l": F.c_name.lower(), "u": F.c_mktsegment.upper(), "c_custkey": "c_custkey"})


@query("select c_custkey, cast(length(c_name) as bigint) as n, abs(c_acctbal) as a from customer")
def fn_length_abs(t):
    return t.q("customer").select({"c_custkey": "c_custkey", "n": F.c_name.length().apply(lambda c: c.cast("long")), "a": F.c_acctbal.abs()})


@query("select p_partkey, p_brand from part where starts_with(p_brand, 'Brand#1') or ends_with(p_brand, '3')")
def fn_startswith_endswith(t):
    return t.q("part").where(F.p_brand.startswith("Brand#1") | F.p_brand.endswith("3")).select({"p_partkey": "p_partkey", "p_brand": "p_brand"})


@query("select n_nationkey, n_name || '/' as tagged from nation")
def fn_concat(t):
    return t.q("nation").select({"n_nationkey": "n_nationkey", "tagged": F.n_name + "/"})


# order, paging, distinct


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey limit 25")
def order_take(t):
    return t.q("orders").order_by("o_totalprice", ascending=False).then_by("o_orderkey").take(25).select({"o_orderkey": "o_orderkey", "o_totalprice": "o_totalprice"})


@query("select p_partkey, p_size from part order by p_size, p_partkey desc limit 40")
def order_then_by(t):
    return t.q("part").order_by("p_size").then_by(F.p_partkey, ascending=False).take(40).select({"p_partkey": "p_partkey", "p_size": "p_size"})


@query("select o_orderkey from orders order by o_orderkey limit 20 offset 100")
def skip_take(t):
    return t.q("orders").order_by("o_orderkey").skip(100).take(20).select({"o_orderkey": "o_orderkey"})


@query(f"select doc_id, quality from {LABELLED} order by quality desc nulls last, doc_id limit 450")
def order_nulls_last(t):
    return _labelled(t).order_by("quality", ascending=False).then_by("doc_id").take(450).select({"doc_id": "doc_id", "quality": "quality"})


@query("select distinct c_mktsegment as value from customer")
def distinct_rows(t):
    return t.q("customer").select(F.c_mktsegment).distinct()


@query("select c_mktsegment, c_custkey from customer qualify row_number() over (partition by c_mktsegment order by c_custkey) = 1")
def distinct_by_key(t):
    return t.q("customer").distinct("c_mktsegment", order=["c_custkey"]).select({"c_mktsegment": "c_mktsegment", "c_custkey": "c_custkey"})


# aggregation


@query("select l_returnflag, cast(sum(l_quantity) as double) as qty from lineitem group by 1")
def group_single(t):
    return aggregates.group(t.lineitem, ["l_returnflag"], [Spec("sum", "l_quantity", "qty")])


@query("select l_returnflag, l_linestatus, count(*) as n, max(l_shipdate) as latest from lineitem group by 1, 2")
def group_multi(t):
    return aggregates.group(t.lineitem, ["l_returnflag", "l_linestatus"], [Spec("count", "l_quantity", "n"), Spec("max", "l_shipdate", "latest")])


@query("select o_orderstatus, round(sum(o_totalprice), 2) as s, round(avg(o_totalprice), 2) as a, count(*) as n, min(o_totalprice) as lo, max(o_totalprice) as hi from orders group by 1")
def group_all_aggs(t):
    g = aggregates.group(t.orders, ["o_orderstatus"], [Spec(k, "o_totalprice", n) for k, n in (("sum", "s"), ("avg", "a"), ("count", "n"), ("min", "lo"), ("max", "hi"))])
    return g.withColumns({c: S.round(c, 2) for c in ("s", "a")})


@query(f"select quality, count(*) as n from {LABELLED} group by 1")
def group_null_key(t):
    return aggregates.group(_labelled(t).df, ["quality"], [Spec("count", "doc_id", "n")])


@query(f"select lang, round(avg(coalesce(quality, 0)), 6) as a, cast(sum(coalesce(quality, 0)) as double) as s from {LABELLED} group by 1")
def group_avg_missing_zero(t):
    g = aggregates.group(_labelled(t).df, ["lang"], [Spec("avg", "quality", "a"), Spec("sum", "quality", "s")])
    return g.withColumn("a", S.round("a", 6))


@query("select n_regionkey, string_agg(n_nationkey, ',' order by n_nationkey) as keys from nation group by 1")
def group_array_agg(t):
    g = aggregates.group(t.nation, ["n_regionkey"], [Spec("array", "n_nationkey", "keys")])
    return g.withColumn("keys", S.array_join(S.array_sort("keys"), ","))


@query("select max(p_size) - min(p_size) + 0.0 as spread, p_brand from part group by p_brand")
def group_user_function(t):
    return aggregates.group(t.part, ["p_brand"], [Spec(lambda v: float(max(v) - min(v)), "p_size", "spread")])


@query("select count(*) as n, cast(sum(l_linenumber) as bigint) as s from lineitem")
def group_keyless(t):
    g = aggregates.group(t.lineitem, [], [Spec("count", "l_linenumber", "n"), Spec("sum", "l_linenumber", "s")])
    return g.withColumn("s", S.col("s").cast("long"))


@query("select c_nationkey as nation, count(*) as n, round(sum(c_acctbal), 2) as total, round(avg(c_acctbal), 2) as mean from customer where c_acctbal > 0 group by 1")
def group_linq(t):
    q = t.q("customer").where(F.c_acctbal > 0).group_by(F.c_nationkey).select({"nation": F.key(), "n": F.count(), "total": F.sum(F.c_acctbal), "mean": F.average(F.c_acctbal)})
    return q.df.withColumns({c: S.round(c, 2) for c in ("total", "mean")})


@query("select o_custkey, n from (select o_custkey, count(*) as n from orders group by 1) where n > 15")
def having(t):
    return t.q("orders").group_by("o_custkey").select({"o_custkey": F.key(), "n": F.count()}).where(["n", ">", 15])


@query('select count(*) as count from lineitem where l_quantity > 25')
def count_plan(t):
    return t.q("lineitem").where(["l_quantity", ">", 25.0]).count_plan()


@query("select cast(sum(l_linenumber) as bigint) as s, min(l_quantity) as lo, max(l_quantity) as hi, round(avg(l_discount), 6) as a from lineitem")
def terminals(t):
    q = t.q("lineitem").group_by(S.lit(1)).select({"s": F.sum(F.l_linenumber), "lo": F.min(F.l_quantity), "hi": F.max(F.l_quantity), "a": F.average(F.l_discount)})
    return q.df.withColumn("a", S.round("a", 6))


@query("select exists (select 1 from lineitem where l_quantity > 49) as some, not exists (select 1 from lineitem where not (l_quantity > 0)) as every")
def any_all(t):
    q = t.q("lineitem")
    return t.spark.createDataFrame([(q.any(["l_quantity", ">", 49.0]), q.all(F.l_quantity > 0))], "some boolean, every boolean")


@query("select event_type, count(*) as n, round(sum(value), 4) as v from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20' group by 1")
def events_filter_group(t):
    import datetime as dt

    q = t.q("events").where(F.ts.between_right_open(dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20)))
    return q.group_by("event_type").select({"event_type": F.key(), "n": F.count(), "v": F.sum(F.value)}).df.withColumn("v", S.round("v", 4))


@query("select c_mktsegment, count(*) as orders, round(sum(o_totalprice), 2) as revenue from customer join orders on c_custkey = o_custkey where o_orderstatus = 'O' group by 1 order by revenue desc, 1 limit 5")
def revenue_by_segment(t):
    q = t.q("orders").where(["o_orderstatus", "==", "O"]).join(t.q("customer"), on=[("o_custkey", "c_custkey")], left="o", right="c")
    g = q.group_by(F.c.c_mktsegment).select({"c_mktsegment": F.key(), "orders": F.count(), "revenue": F.sum(F.o.o_totalprice)})
    return g.select({"c_mktsegment": "c_mktsegment", "orders": "orders", "revenue": _round(F.revenue, 2)}).order_by("revenue", ascending=False).then_by("c_mktsegment").take(5)


# joins


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    nation = t.nation.select(S.col("n_nationkey").alias("id"), S.col("n_name").alias("name"), (S.col("n_regionkey") + 1).alias("region_id"))
    return nation, t.region.select(S.col("r_regionkey").alias("id"), S.col("r_name").alias("name"))


def _flat(df: DataFrame, *columns: str) -> DataFrame:
    have = set(df.columns)
    return df.select(*(S.col(c).alias(c.replace(".", "_")) if c.split(".")[0] in have else S.lit(None).alias(c.replace(".", "_")) for c in columns))


N, R = "(select n_nationkey as id, n_name as name, n_regionkey + 1 as region_id from nation) n", "(select r_regionkey as id, r_name as name from region) r"
PAIR = "n.id as nation_id, n.name as nation_name, r.id as region_id, r.name as region_name"
CROSS, LONE_N, LONE_R = f"select {PAIR} from {N} cross join {R}", f"select n.id as nation_id, n.name as nation_name, cast(null as int) as region_id, cast(null as varchar) as region_name from {N}", f"select cast(null as int) as nation_id, cast(null as varchar) as nation_name, r.id as region_id, r.name as region_name from {R}"
for _name, _how, _sql in (
    ("join_inner", "inner", f"select {PAIR} from {N} join {R} on n.region_id = r.id"),
    ("join_left", "left", f"select {PAIR} from {N} left join {R} on n.region_id = r.id"),
    ("join_right", "right", f"select {PAIR} from {N} right join {R} on n.region_id = r.id"),
    ("join_full", "full", f"select {PAIR} from {N} full join {R} on n.region_id = r.id"),
    ("join_external", "external", f"{CROSS} union all {LONE_N} union all {LONE_R}"),
    ("join_external_left", "external_left", f"{CROSS} union all {LONE_N}"),
    ("join_external_right", "external_right", f"{CROSS} union all {LONE_R}"),
    ("join_outer_sides", "outer", f"{LONE_N} union all {LONE_R}"),
):

    def _run(t: Tables, how: str = _how) -> DataFrame:
        a, b = _sides(t)
        return _flat(joins.join(a, b, how, None, "nation", "region"), "nation.id", "nation.name", "region.id", "region.name")

    _run.__name__ = _name
    query(_sql)(_run)


@query("select o_orderkey, l_linenumber, l_partkey, l_extendedprice from orders join lineitem on o_orderkey = l_orderkey where o_totalprice > 200000")
def join_on(t):
    j = joins.join(t.orders.where("o_totalprice > 200000"), t.lineitem, "inner", [("o_orderkey", "l_orderkey")], "o", "l")
    return j.select("o.o_orderkey", "l.l_linenumber", "l.l_partkey", "l.l_extendedprice")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 250000)")
def join_semi(t):
    return joins.join(t.customer, t.orders.where("o_totalprice > 250000"), "semi", [("c_custkey", "o_custkey")], "c", "o").select("c.c_custkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def join_anti(t):
    return joins.join(t.customer, t.orders, "anti", [("c_custkey", "o_custkey")], "c", "o").select("c.c_custkey")


# sets and collections


def _keys(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.customer.where("c_acctbal > 9000").select(S.col("c_nationkey").alias("k")), t.supplier.select(S.col("s_nationkey").alias("k"))


CK, SK = "select c_nationkey as k from customer where c_acctbal > 9000", "select s_nationkey as k from supplier"


@query(f"{CK} union {SK}")
def set_union(t):
    return sets.union(*_keys(t))


@query(f"{CK} intersect {SK}")
def set_intersect(t):
    return sets.intersection(*_keys(t))


@query(f"{CK} except {SK}")
def set_difference(t):
    return sets.difference(*_keys(t))


@query(f"{CK} union all {SK}")
def or_merge(t):
    return sets.or_merge(_keys(t))


@query(f"select count(*) as count from ({CK} union {SK})")
def or_merge_count(t):
    return sets.or_merge_count(_keys(t))


@query("select distinct o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_totalprice > 150000")
def and_merge(t):
    return sets.and_merge([t.orders.where("o_orderstatus = 'F'").select("o_custkey"), t.orders.where("o_totalprice > 150000").select("o_custkey")])


@query("select c_nationkey as element, count(*) as n from customer group by 1")
def multiset_counts(t):
    return Multiset.of(t.customer, "c_nationkey").df


@query("select n_name as value from nation where n_regionkey = 2")
def multimap_lookup(t):
    return Multimap(t.nation.select(S.col("n_regionkey").alias("key"), S.col("n_name").alias("value"))).get(2)


@query("select n_nationkey as key, case when n_nationkey < 5 then lower(n_name) else n_name end as value from nation")
def map_merge(t):
    m = Mapping(t.nation.select(S.col("n_nationkey").alias("key"), S.col("n_name").alias("value")))
    return m.merge(Mapping(m.df.where("key < 5").withColumn("value", S.lower("value")))).df


@query("select (row_number() over (order by n_nationkey) - 1) as _pos, n_name from (select * from nation order by n_nationkey limit 7 offset 3)")
def list_slice(t):
    w = Window.orderBy("n_nationkey")
    rows = t.nation.select((S.row_number().over(w) - 1).cast("long").alias("_pos"), "n_name")
    return PositionalList(rows).slice(3, 10).df


# nested data and traversal


@query("select doc_id, w from (select doc_id, unnest(string_split(text, ' ')) as w from documents) where w <> ''")
def unnest_path(t):
    q = t.q("documents").with_field("words", S.split("text", " ")).unnest("words", "w")
    return q.where(["w", "!=", ""]).select({"doc_id": "doc_id", "w": "w"})


@query("select c_custkey, coalesce((select string_agg(o_orderkey, ',' order by o_orderkey) from orders where o_custkey = c_custkey), '') as keys from customer")
def collection_field(t):
    q = t.q("customer").collection_field("orders", t.orders, [("c_custkey", "o_custkey")], ["o_orderkey"], order=["o_orderkey"])
    return q.df.select("c_custkey", S.array_join(S.transform("orders", lambda x: x.o_orderkey.cast("string")), ",").alias("keys"))


@query("select doc_id, unnest(string_split(lang || ',' || source, ',')) as value from documents")
def select_many_unnest(t):
    q = t.q("documents").with_field("both", S.array("lang", "source"))
    return q.unnest("both", "value").select({"doc_id": "doc_id", "value": "value"})


@query("select c_custkey, o_orderkey, o_totalprice from (select c_custkey, o_orderkey, o_totalprice, row_number() over (partition by c_custkey order by o_totalprice desc, o_orderkey) as rn from customer join orders on c_custkey = o_custkey) where rn <= 2")
def select_many_top_n(t):
    q = t.q("customer").select_many(t.orders, on=[("c_custkey", "o_custkey")], order=[S.desc("o_totalprice"), S.asc("o_orderkey")], n=2)
    return q.select({c: c for c in ("c_custkey", "o_orderkey", "o_totalprice")})


def _edges(t: Tables) -> DataFrame:
    return t.part.where("p_partkey > 1").select(S.floor(S.col("p_partkey") / 2).alias("src"), S.col("p_partkey").alias("dst"))


TREE = "e as (select p_partkey // 2 as src, p_partkey as dst from part where p_partkey > 1)"


def _walk(name: str, sql: str, start: int, **options) -> None:
    def run(t: Tables) -> DataFrame:
        return traverse.traverse(t.part.where(S.col("p_partkey") == start).select(S.col("p_partkey").alias("node")), _edges(t), **options)

    run.__name__ = name
    query(f"with recursive {TREE}, w as (select cast({start} as bigint) as node, 0 as depth union {sql}) select node, depth from w")(run)


_walk("traverse_up", "select src, depth + 1 from w join e on e.dst = node) , x as (select * from w where depth > 0", 150, direction="up")
SQL["traverse_up"] = SQL["traverse_up"].replace("select node, depth from w", "select node, depth from x")
_walk("traverse_down", "select dst, depth + 1 from w join e on e.src = node) , x as (select * from w where depth > 0", 5)
SQL["traverse_down"] = SQL["traverse_down"].replace("select node, depth from w", "select node, depth from x")
_walk("traverse_depth", "select dst, depth + 1 from w join e on e.src = node where depth < 3", 1, max_depth=3, include_start=True)
_walk("traverse_include_start", "select src, depth + 1 from w join e on e.dst = node", 99, direction="up", include_start=True)


@query("with recursive e as (select distinct p_partkey % 11 as src, (p_partkey * 7) % 11 as dst from part), w as (select cast(1 as bigint) as node union select dst from w join e on e.src = node) select node from w where node <> 1")
def traverse_cycle(t):
    k = S.col("p_partkey")
    return traverse.traverse(t.spark.createDataFrame([(1,)], "node long"), t.part.select((k % 11).alias("src"), (k * 7 % 11).alias("dst"))).select("node")


# vectors

Q0 = "(select cast(embedding as double[]) as q from embeddings where vec_id = 0)"
VEC = f"select vec_id, cast(embedding as double[]) as v, q from embeddings, {Q0}"


def _q0(t: Tables) -> list[float]:
    return t.embeddings.where("vec_id = 0").first().embedding


def _scores(df: DataFrame) -> DataFrame:
    return df.select("vec_id", S.round("score", 6).alias("score"))


@query(f"select vec_id, round(list_cosine_similarity(v, q), 6) as score from ({VEC}) order by list_cosine_similarity(v, q) desc, vec_id limit 10")
def vec_cosine_topk(t):
    return _scores(ExactIndex(t.embeddings, "vec_id", "embedding").search(_q0(t), 10))


@query(f"select vec_id, round(0 - list_distance(v, q), 6) as score from ({VEC}) order by list_distance(v, q), vec_id limit 10")
def vec_l2_topk(t):
    return _scores(ExactIndex(t.embeddings, "vec_id", "embedding", "l2").search(_q0(t), 10))


@query(f"select vec_id, round(list_cosine_similarity(v, q), 6) as score from ({VEC}) where list_cosine_similarity(v, q) >= 0.2")
def vec_range(t):
    return _scores(ExactIndex(t.embeddings, "vec_id", "embedding").range_search(_q0(t), 0.2))


@query(f"select vec_id from ({VEC}) where list_cosine_similarity(v, q) >= 0.15")
def vec_near_threshold(t):
    df = t.embeddings
    return df.where(compile_predicate(["embedding", "near[]", _q0(t), 0.15]).column(df)).select("vec_id")


@query("select query_id, id, rank from (select a.vec_id as query_id, b.vec_id as id, cast(row_number() over (partition by a.vec_id order by list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) desc, b.vec_id) as int) as rank from embeddings a, embeddings b where a.vec_id % 50 = 0) where rank <= 5")
def vec_batch_knn(t):
    e = t.embeddings
    return ExactIndex(e, "vec_id", "embedding").search_batch(e.where("vec_id % 50 = 0"), 5, "vec_id", "embedding").select("query_id", "id", "rank")


@query(f"select vec_id, round(list_cosine_similarity(v, q), 6) as score from ({VEC}) order by list_cosine_similarity(v, q) desc, vec_id limit 10")
def vec_ivf_topk(t):
    index = IvfIndex.build(t.embeddings, "vec_id", "embedding", nlist=8, nprobe=8)
    return _scores(index.search(_q0(t), 10))


@query("select vec_id, round(sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))), 6) as n from embeddings")
def vec_norm(t):
    return t.embeddings.select("vec_id", S.round(V.norm(S.col("embedding")), 6).alias("n"))


# sources, sinks, user functions


@query("select r_regionkey, r_name from region where r_regionkey >= 2")
def parquet_scan(t):
    return scan_parquet(t.spark, f"{t.folder}/region.parquet", ["r_regionkey", "r_name"], ["r_regionkey", ">=", 2])


@query("select n_nationkey, n_name from nation")
def parquet_roundtrip(t):
    return stage.staged(t.nation.select("n_nationkey", "n_name"), "nation")


@query("select r_regionkey, r_name from region")
def arrow_roundtrip(t):
    return t.spark.createDataFrame(to_arrow(t.region, ["r_regionkey", "r_name"]))


@query("select * from (values (1, 'a'), (2, cast(null as varchar)), (3, 'c')) x(id, name)")
def rows_source(t):
    return from_rows(t.spark, [{"id": 1, "name": "a"}, {"id": 2}, {"id": 3, "name": "c"}]).select(S.col("id").cast("int").alias("id"), "name")


@query("select p_partkey * 2 as twice from part where p_partkey % 2 = 0")
def parallel_map_filter(t):
    return parallel_scan(t.part.select("p_partkey"), lambda r: {"twice": r["p_partkey"] * 2} if r["p_partkey"] % 2 == 0 else None, "twice long")


# prefix streams, and predicates whose first queries find nothing in small tables

PART = "p_partkey, p_size"
_tokens("where_prefix_stream", "part", ["|", "p_size", "==", 1, "p_size", "==", 2, "p_partkey", ">", 300], PART, "(p_size = 1 or p_size = 2) and p_partkey > 300")
_tokens("where_prefix_of_prefix", "part", ["&", "|", ["p_size", "==", 1], ["p_size", "==", 2], ["p_partkey", ">", 300]], PART, "(p_size = 1 or p_size = 2) and p_partkey > 300")
_tokens("where_prefix_then_and", "part", ["&", ["p_size", ">", 10], ["p_size", "<", 30], ["p_partkey", "<", 900]], PART, "p_size > 10 and p_size < 30 and p_partkey < 900")
_tokens("where_prefix_not", "part", ["!", "p_size", ">", 10, "p_partkey", "<", 900], PART, "not (p_size > 10) and p_partkey < 900")
_tokens("where_contains_word", "part", ["p_name", "contains", "ring"], "p_partkey, p_name", "contains(p_name, 'ring')")
_tokens("where_in_string", "customer", ["c_mktsegment", "in", "BUILDING and MACHINERY"], "c_custkey, c_mktsegment", "contains('BUILDING and MACHINERY', c_mktsegment)")


@query("select p_partkey, p_size from part where p_size in (3, 5) or p_size between 10 and 12 or (p_size > 40 and p_size <= 43) or contains(p_brand, '#25')")
def fn_fluent_predicates(t):
    return t.q("part").where(F.p_size.in_([3, 5]) | F.p_size.between(10, 12) | F.p_size.range(40, 43, "(]") | F.p_brand.contains("#25")).select({"p_partkey": "p_partkey", "p_size": "p_size"})


@query("select p_partkey, 100 - p_size as a, 2 * p_size as b, 10 + p_size as c from part")
def fn_reflected(t):
    return t.q("part").select({"p_partkey": "p_partkey", "a": 100 - F.p_size, "b": 2 * F.p_size, "c": 10 + F.p_size})


@query("select c_custkey from customer where c_nationkey in (select o.id from (select 3 as id union all select null) o) or c_nationkey is null")
def where_in_null(t):
    return t.q("customer").where(["c_nationkey", "in", [3, None]]).select({"c_custkey": "c_custkey"})


@query(f"select vec_id from ({VEC}) where list_distance(v, q) <= 11")
def vec_near_l2(t):
    return t.q("embeddings").where(F.embedding.near(_q0(t), 11.0, "l2")).select({"vec_id": "vec_id"})


@query(f"select vec_id, label, round(list_cosine_similarity(v, q), 6) as score from (select *, cast(embedding as double[]) as v from embeddings), {Q0} order by list_cosine_similarity(v, q) desc, vec_id limit 7")
def vec_search_rows(t):
    return ExactIndex(t.embeddings, "vec_id", "embedding").search_rows(_q0(t), 7).select("vec_id", "label", S.round("score", 6).alias("score"))


@query(f"select vec_id from ({VEC}) where list_cosine_similarity(v, q) >= 0.2")
def vec_near_by_index(t):
    index = IvfIndex.build(t.embeddings, "vec_id", "embedding", nlist=8)
    return t.q("embeddings").near(index, _q0(t), 0.2).select({"vec_id": "vec_id"})


# user functions


def _weight(r) -> float:
    return float(len(str(r.p_name))) + float(str(r.p_size))


@query("select p_partkey, length(p_name) + p_size + 0.0 as w from part order by w desc, p_partkey limit 30")
def udf_order_typed(t):
    q = t.q("part").order_by(_weight, ascending=False).then_by("p_partkey").take(30)
    return q.select({"p_partkey": "p_partkey", "w": _weight})


@query("select p_partkey, 'v' || p_size as tag, length(p_name) as n from part")
def udf_select_typed(t):
    return t.q("part").select({"p_partkey": "p_partkey", "tag": typed(lambda r: f"v{r.p_size}", "string"), "n": typed(lambda r: len(r.p_name), "long")})


@query("select p_size // 10 as decade, count(*) as n from part group by 1")
def udf_group_key(t):
    return t.q("part").group_by(typed(lambda r: int(r.p_size) // 10, "long")).select({"decade": F.key(), "n": F.count()})


# terminals


def _said(t: Tables, schema: str, *values) -> DataFrame:
    return t.spark.createDataFrame([values], schema)


@query("select cast(sum(l_linenumber) as bigint) as value from lineitem")
def term_sum(t):
    return _said(t, "value long", t.q("lineitem").sum(F.l_linenumber))


@query("select min(l_quantity) as value from lineitem where l_quantity > 7")
def term_min(t):
    return _said(t, "value double", t.q("lineitem").where(F.l_quantity > 7).min(F.l_quantity))


@query("select max(l_extendedprice) as value from lineitem")
def term_max(t):
    return _said(t, "value double", t.q("lineitem").max("l_extendedprice"))


@query("select round(avg(l_discount), 9) as value from lineitem")
def term_average(t):
    return _said(t, "value double", round(t.q("lineitem").average(F.l_discount), 9))


@query("select count(*) as n, count(*) filter (where l_quantity > 25) as some from lineitem")
def term_count(t):
    q = t.q("lineitem")
    return _said(t, "n long, some long", q.count(), q.count(F.l_quantity > 25))


@query("select (select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 1) as first, (select o_orderkey from orders where o_totalprice < 60000 order by o_totalprice desc, o_orderkey limit 1) as below, -1 as none")
def term_first(t):
    q = t.q("orders").order_by("o_totalprice", ascending=False).then_by("o_orderkey").select(F.o_orderkey)
    below = t.q("orders").where(F.o_totalprice < 60000).order_by("o_totalprice", ascending=False).then_by("o_orderkey").select(F.o_orderkey)
    return _said(t, "first long, below long, none long", q.first(), below.first(), q.first_or_default(-1, F.value < 0))


@query("select r_regionkey as k, r_name as v from region")
def term_to_dict(t):
    return t.spark.createDataFrame(sorted(t.q("region").to_dict(F.r_regionkey, F.r_name).items()), "k int, v string")


@query("select distinct n_regionkey as value from nation")
def term_to_set(t):
    return t.spark.createDataFrame([(v,) for v in sorted(t.q("nation").select(F.n_regionkey).to_set())], "value int")


# joins, from, correlated collections


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def join_anti_dear(t):
    return joins.join(t.customer, t.orders.where("o_totalprice > 300000"), "anti", [("c_custkey", "o_custkey")], "c", "o").select("c.c_custkey")


@query("with a as (select case when n_nationkey % 5 > 0 then n_nationkey end as k, n_name from nation), b as (select case when r_regionkey > 0 then r_regionkey end as k, r_name from region) select n_name, r_name from a left join b on a.k = b.k")
def join_on_null_keys(t):
    a = t.nation.select(S.when(S.col("n_nationkey") % 5 > 0, S.col("n_nationkey")).alias("k"), "n_name")
    b = t.region.select(S.when(S.col("r_regionkey") > 0, S.col("r_regionkey")).alias("k"), "r_name")
    return joins.join(a, b, "left", "k", "a", "b").select("a.n_name", "b.r_name")


@query("with a as (select case when n_nationkey % 5 > 0 then n_nationkey end as k, n_name from nation), b as (select case when r_regionkey > 0 then r_regionkey end as k, r_name from region) select n_name, r_name from a join b on a.k is not distinct from b.k")
def join_null_safe(t):
    a = t.nation.select(S.when(S.col("n_nationkey") % 5 > 0, S.col("n_nationkey")).alias("k"), "n_name")
    b = t.region.select(S.when(S.col("r_regionkey") > 0, S.col("r_regionkey")).alias("k"), "r_name")
    return joins.join(a, b, "inner", "k", "a", "b", null_safe=True).select("a.n_name", "b.r_name")


@query("select n_name from nation where n_regionkey = 3")
def from_alias(t):
    return t.q("nation").alias("n").where(["n.n_regionkey", "==", 3]).select({"n_name": F.n.n_name})


@query("select c_custkey, o_orderkey from (select c_custkey, o_orderkey, row_number() over (partition by c_custkey order by o_totalprice desc, o_orderkey) as rn from customer join orders on c_custkey = o_custkey where c_nationkey = 4) where rn <= 2")
def select_many_lateral(t):
    orders = t.q("orders")
    q = t.q("customer").where(F.c_nationkey == 4).select_many(
        lambda c: orders.where(F.o_custkey == c.c_custkey).order_by(F.o_totalprice, ascending=False).then_by(F.o_orderkey).take(2),
        result=lambda c, o: {"c_custkey": c.c_custkey, "o_orderkey": o.o_orderkey},
    )
    return q


@query("select doc_id, unnest([lang, source]) as value from documents")
def select_many_callable(t):
    q = t.q("documents").select({"doc_id": "doc_id", "both": S.array("lang", "source")})
    return q.select_many(lambda d: d.both, result=lambda d, x: {"doc_id": d.doc_id, "value": x})


@query("select p_partkey, unnest(string_split(p_name, ' ')) as word from part")
def select_many_python(t):
    return t.q("part").select_many(typed(lambda p: p.p_name.split(" "), "array<string>"), result=lambda p, w: {"p_partkey": p.p_partkey, "word": w})


@query("select c_custkey, o_orderkey from (select c_custkey, o_orderkey, row_number() over (partition by c_custkey order by o_orderkey) as rn from customer join orders on c_custkey = o_custkey) where rn <= 3")
def select_many_default_order(t):
    return t.q("customer").select_many(t.orders.select("o_orderkey", "o_custkey"), on=[("c_custkey", "o_custkey")], n=3).select({"c_custkey": "c_custkey", "o_orderkey": "o_orderkey"})


@query("select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by 1")
def group_array_strings(t):
    g = aggregates.group(t.nation, ["n_regionkey"], [Spec("array", "n_name", "names")])
    return g.withColumn("names", S.array_join(S.array_sort("names"), ","))


@query(f"with recursive {TREE}, w as (select cast(7 as bigint) as node, 0 as depth union select dst, depth + 1 from w join e on e.src = node where depth < 4) select node, depth from w where depth > 0")
def traverse_query(t):
    return t.q("part").where(["p_partkey", "==", 7]).traverse(_edges(t), "p_partkey", max_depth=4)


# collections and their edits


def _list(t: Tables) -> PositionalList:
    return PositionalList.of(t.nation.select("n_nationkey", "n_name"), "n_nationkey")


NUMBERED = "(select row_number() over (order by n_nationkey) - 1 as _pos, n_nationkey, n_name from nation)"


@query(f"select * from {NUMBERED}")
def list_of_order(t):
    return _list(t).df


@query(f"select _pos - 5 as _pos, n_nationkey, n_name from {NUMBERED} where _pos >= 5 and _pos < 9")
def list_head_tail(t):
    return _list(t).head(9).tail(5).df


@query(f"select _pos - 20 as _pos, n_nationkey, n_name from {NUMBERED} where _pos >= 20 and _pos < 24")
def list_negative_slice(t):
    return _list(t).slice(-5, -1).df


@query(f"""with a as (select * from {NUMBERED} where _pos <> 3),
b as (select case when _pos > 3 then _pos - 1 else _pos end as _pos, n_nationkey, n_name from a),
c as (select case when _pos >= 2 then _pos + 1 else _pos end as _pos, n_nationkey, n_name from b union all select 2, 77, 'inserted'),
d as (select _pos, case when _pos = 0 then 88 else n_nationkey end as n_nationkey, case when _pos = 0 then 'set' else n_name end as n_name from c)
select * from d union all select 25, 99, 'last'""")
def list_edits(t):
    return _list(t).remove(3).insert(2, 77, "inserted").set(0, 88, "set").append_last(99, "last").df


@query(f"select _pos, n_nationkey from {NUMBERED} where _pos < 3 union all select _pos + 3, n_nationkey from {NUMBERED} where _pos < 2")
def list_extend(t):
    p = _list(t)
    return p.head(3).extend(p.head(2)).df.select("_pos", "n_nationkey")


@query(f"select n_name from {NUMBERED} where _pos = 24")
def list_get_last(t):
    return _said(t, "n_name string", _list(t).get(-1).n_name)


@query("select element, n from (select c_nationkey as element, count(*) + (c_nationkey = 3)::int * 2 - (c_nationkey = 4)::int as n from customer group by 1) union all select 99, 1")
def multiset_edits(t):
    return Multiset.of(t.customer, "c_nationkey").add(3, 2).remove(4).add(99).df


@query("select count(*) as total, count(distinct c_nationkey) as different from customer")
def multiset_totals(t):
    m = Multiset.of(t.customer, "c_nationkey")
    return _said(t, "total long, different long", m.total_count(), m.count())


@query("select n_nationkey as key, case when n_nationkey = 2 then 'two' else n_name end as value from nation where n_nationkey <> 5 union all select 50, 'fifty'")
def map_edits(t):
    return Mapping(t.nation.select(S.col("n_nationkey").alias("key"), S.col("n_name").alias("value"))).set(2, "two").set(50, "fifty").remove(5).df


@query("select key, value from (values (1, 12), (2, 20), (3, 31), (5, 50), (6, 60)) x(key, value)")
def map_rebase(t):
    m = lambda **kv: Mapping(t.spark.createDataFrame([(int(k[1:]), v) for k, v in kv.items()], "key int, value int"))
    # both changed 1, only the other side 2, only this side 3; 4 is removed here; 5 is new here, 6 there
    return m(_1=15, _2=10, _3=31, _5=50).rebase(m(_1=10, _2=10, _3=30, _4=40), m(_1=11, _2=20, _3=30, _4=41, _6=60)).df


@query("select n_regionkey as key, n_name as value from nation where n_name <> 'NATION_7' union all select 2, 'NEW'")
def multimap_edits(t):
    m = Multimap(t.nation.select(S.col("n_regionkey").alias("key"), S.col("n_name").alias("value")))
    return m.put(2, "NEW").remove(2, "NATION_7").df


@query("select p_size as element, count(*) as n from part where p_size < 5 group by 1")
def collection_as_query(t):
    return Multiset.of(t.part, "p_size").as_query().where(["element", "<", 5])


@query("select k from (select distinct p_size as k from part) where k not in (select s_nationkey from supplier)")
def set_difference_sizes(t):
    return sets.difference(t.part.select(S.col("p_size").alias("k")), t.supplier.select(S.col("s_nationkey").alias("k")))


@query("select k from (select distinct n_nationkey as k from nation where n_nationkey <> 4) union all select 77")
def set_edits(t):
    return sets.remove(sets.add(t.nation.select(S.col("n_nationkey").alias("k")), 77), 4)


# sinks


def _new(t: Tables, name: str) -> str:
    return f"{stage.shared_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("select n_nationkey, n_name, n_regionkey from nation")
def sink_parquet(t):
    to_parquet(t.nation, path := _new(t, "sink"), row_group_bytes=1 << 20, partition_by=["n_regionkey"])
    return t.spark.read.parquet(path)


@query("select r_regionkey, r_name from region")
def sink_arrow_parquet(t):
    arrow_to_parquet(t.spark, to_arrow(t.region, ["r_regionkey", "r_name"]), path := _new(t, "sink"), compression="snappy")
    return t.spark.read.parquet(path)


@query("select r_regionkey, r_name from region where r_regionkey < 3")
def parquet_to_rows(t):
    return from_rows(t.spark, parquet_rows(t.spark, f"{t.folder}/region.parquet", ["r_regionkey", "r_name"], ["r_regionkey", "<", 3]), "r_regionkey int, r_name string")


@query("select vec_id, len(embedding) as dim from embeddings")
def sink_vectors(t):
    dim = len(_q0(t))
    to_parquet(vectors(t.embeddings, "embedding", dim), path := _new(t, "vectors"))
    return t.spark.read.parquet(path).select("vec_id", S.size("embedding").alias("dim"))


@query(f"with recursive {TREE}, w as (select cast(3 as bigint) as node, 0 as depth, '3' as path union select dst, depth + 1, path || '>' || dst from w join e on e.src = node where depth < 5) select node, depth, path from w where depth > 0")
def traverse_paths(t):
    found = traverse.traverse(t.part.where("p_partkey = 3").select(S.col("p_partkey").alias("node")), _edges(t), max_depth=5, path=True)
    return found.withColumn("path", S.array_join(S.transform("path", lambda x: x.cast("string")), ">"))


@query("select l_orderkey, l_partkey, l_quantity from lineitem where l_partkey >= 100 and l_partkey < 120")
def index_clustered(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity")
    to_parquet(clustered(rows, "l_partkey", 8), path := _new(t, "clustered"), row_group_bytes=1 << 20)
    return from_collection(t.spark.read.parquet(path)).where(["l_partkey", "between[)", 100, 120])


@query("select p_partkey, unnest(range(cast(p_size % 4 as bigint))) as i from part")
def flat_map_rows(t):
    return flat_scan(t.part.select("p_partkey", "p_size"), lambda r: [{"p_partkey": r["p_partkey"], "i": i} for i in range(r["p_size"] % 4)], "p_partkey long, i long")


@query("select c_custkey, o_orderkey from customer join orders on o_custkey = c_custkey and o_totalprice > c_acctbal * 45 where c_acctbal > 0 and o_orderkey % 10 = 0")
def lateral_inequality(t):
    orders = t.q("orders").where(S.col("o_orderkey") % 10 == 0)
    dear = lambda c: orders.where((F.o_custkey == c.c_custkey) & (F.o_totalprice > 0))
    q = t.q("customer").where(F.c_acctbal > 0).select_many(dear, result=lambda c, o: {"c_custkey": c.c_custkey, "o_orderkey": o.o_orderkey, "p": o.o_totalprice, "b": c.c_acctbal})
    return q.where(F.p > F.b * 45).select({"c_custkey": "c_custkey", "o_orderkey": "o_orderkey"})

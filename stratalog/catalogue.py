"""Queries over the driver's tables, each with the SQL that DuckDB answers the same way.

Nearly all go through the engine's own query text; a few use the library's DataFrame side.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .engine import Engine
from .proofs import PROOFS, over_files

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def engine(spark: SparkSession, sf_dir: str, text: str) -> Engine:
    """An engine that knows the tables named in text."""
    out = Engine(spark)
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            out.table(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return out


def asking(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir, text).sql(text)

    return run


HOURLY = """select t, event_type, count(*) as n, percentile_disc(0.9) within group (order by value asc) as p90
from events group by time_bucket("1 hour", ts) as t, event_type order by t asc, event_type asc"""
HOURLY_SQL = """select time_bucket(interval '1 hour', ts) as t, event_type, count(*) as n,
list_sort(list(value))[least(cast(floor(count(value) * 0.9) as int), cast(count(value) as int) - 1) + 1] as p90
from events group by 1, 2"""

#: name: (query text, DuckDB SQL; None where the same text will do)
PLAIN: dict[str, tuple[str, str | None]] = {
    "hourly_events": (HOURLY, HOURLY_SQL),
    # project, filter, predicates
    "scan_project": ("select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as net from lineitem", None),
    "star_order_limit": ("select * from orders order by o_totalprice desc, o_orderkey asc limit 100", None),
    "filter_compare": ("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity >= 45 and l_discount < 0.05 and l_tax != 0.02", None),
    "filter_kleene": ("select o_orderkey from orders where not (o_orderstatus = 'F' or o_totalprice > 200000) and (null or o_orderpriority = '1-URGENT')", None),
    "like": ("select p_partkey, p_name from part where p_name like '%1%' and p_type like '_%E%'", None),
    "not_like": ("select p_partkey from part where p_brand not like 'Brand#1%'", None),
    "in_list": ("select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_nationkey in (1, 2, 3)", None),
    "not_in_null": ("select c_custkey from customer where c_nationkey not in (1, 2, null) or c_nationkey not in (3, 4)", None),
    "between": ("select l_orderkey, l_linenumber from lineitem where l_quantity between 10 and 12 and l_extendedprice between 1000.0 and 20000.0", None),
    "not_between": ("select l_orderkey, l_linenumber from lineitem where l_quantity not between 2 and 49", None),
    "is_null": ("select documents.doc_id as doc_id, quality is null as unlabelled from documents left join labels on documents.doc_id = labels.doc_id where quality is null or quality is not null", "select d.doc_id as doc_id, quality is null as unlabelled from documents d left join labels l on d.doc_id = l.doc_id"),
    "is_missing": ("select o_orderkey, o_custkey is missing as m, o_custkey is not missing as n from orders", "select o_orderkey, false as m, true as n from orders"),
    "bool_context": ("select c_custkey from customer where upper(c_mktsegment) and c_acctbal > 0", "select c_custkey from customer where c_mktsegment is not null and c_acctbal > 0"),
    # expressions
    "case_when": ("select o_orderkey, case when o_totalprice > 200000 then 'high' when o_totalprice > 100000 then 'mid' else 'low' end as band, case when o_orderstatus = 'F' then 1 end as f from orders", "select o_orderkey, case when o_totalprice > 200000 then 'high' when o_totalprice > 100000 then 'mid' else 'low' end as band, cast(case when o_orderstatus = 'F' then 1 end as bigint) as f from orders"),
    "coalesce_nullif": ("select c_custkey, coalesce(null, nullif(c_mktsegment, 'BUILDING'), 'none') as seg, nullif(c_nationkey, 5) as nk from customer", None),
    "cast_matrix": ("select p_partkey, cast(p_retailprice as int) as a, cast(p_size as float) as b, cast(p_size as varchar) as c, cast('12' as integer) as d, cast(p_size as boolean) as e, cast('true' as bool) as f from part", "select p_partkey, cast(trunc(p_retailprice) as bigint) as a, cast(p_size as double) as b, cast(p_size as varchar) as c, cast(12 as bigint) as d, cast(p_size as boolean) as e, true as f from part"),
    "concat_op": ("select p_partkey, p_brand || '-' || p_type as label from part", None),
    "arith_mixed": ("select l_orderkey, l_linenumber, l_linenumber + 1 as a, l_quantity - l_linenumber as b, l_linenumber * 2.5 as c, l_quantity / 4 as d, -l_linenumber as e, 2 + 3 * 4 as f from lineitem", "select l_orderkey, l_linenumber, cast(l_linenumber + 1 as bigint) as a, l_quantity - l_linenumber as b, cast(l_linenumber as double) * 2.5e0 as c, l_quantity / 4 as d, -l_linenumber as e, cast(14 as bigint) as f from lineitem"),
    "int_div_zero_null": ("select p_partkey, p_partkey / 7 as q, p_partkey / (p_size - p_size) as z, -7 / 2 as n from part", "select p_partkey, p_partkey // 7 as q, cast(null as bigint) as z, cast(-3 as bigint) as n from part"),
    # SELECT VALUE
    "value_expr": ("select value o_totalprice * 2 from orders", "select o_totalprice * 2 as _value from orders"),
    "value_path": ("select value o_custkey from orders", "select o_custkey from orders"),
    "value_tuple": ("select value {'k': o_orderkey, 'total': o_totalprice} from orders", "select o_orderkey as k, o_totalprice as total from orders"),
    "value_array": ("select value [o_orderkey, o_totalprice + 1] from orders", "select o_orderkey, o_totalprice + 1 as _1 from orders"),
    # grouping
    "group_count": ("select l_returnflag, l_linestatus, count(*) as n from lineitem group by l_returnflag, l_linestatus", None),
    "group_multi_agg": ("select l_returnflag, count(*) as n, sum(l_quantity) as s, round(avg(l_quantity), 6) as a, min(l_shipdate) as lo, max(l_extendedprice) as hi, COUNT(l_tax) as c from lineitem group by l_returnflag", None),
    "group_expr_alias": ("select y, count(*) as n, sum(o_custkey) as s from orders group by year(o_orderdate) as y", "select year(o_orderdate) as y, count(*) as n, cast(sum(o_custkey) as double) as s from orders group by 1"),
    "group_computed_output": ("select o_orderstatus, sum(o_custkey) / count(*) as per, upper(o_orderstatus) as u from orders group by o_orderstatus", "select o_orderstatus, cast(sum(o_custkey) as double) / count(*) as per, upper(o_orderstatus) as u from orders group by 1"),
    "having_alias": ("select c_nationkey, count(*) as n from customer group by c_nationkey having n > 50", "select c_nationkey, count(*) as n from customer group by c_nationkey having count(*) > 50"),
    "having_agg": ("select c_nationkey from customer group by c_nationkey having count(*) > 50 and max(c_acctbal) > 9000", None),
    "global_agg": ("select count(*) as n, min(p_size) as lo, max(p_name) as hi, count(distinct p_brand) as brands from part", None),
    "global_agg_empty": ("select count(*) as n, sum(p_size) as s, avg(p_size) as a, max(p_name) as hi from part where p_partkey < 0", "select count(*) as n, cast(sum(p_size) as double) as s, avg(p_size) as a, max(p_name) as hi from part where p_partkey < 0"),
    "count_col_vs_star": ("select count(*) as a, count(quality) as b from documents left join labels on documents.doc_id = labels.doc_id", "select count(*) as a, count(quality) as b from documents d left join labels l on d.doc_id = l.doc_id"),
    "group_as": ("select n_regionkey, cardinality(g) as n, array_join(array_sort(g[*].n_name), ',') as names from nation group by n_regionkey group as g", "select n_regionkey, count(*) as n, string_agg(n_name, ',' order by n_name) as names from nation group by 1"),
    "group_null_key": ("select quality, count(*) as n from documents left join labels on documents.doc_id = labels.doc_id group by quality", "select quality, count(*) as n from documents d left join labels l on d.doc_id = l.doc_id group by 1"),
    # ordered and sketch aggregates
    "first_last": ("select event_type, first(value) as a, last(value) as b from events group by event_type", "select event_type, arg_min(value, event_id) as a, arg_max(value, event_id) as b from events group by 1"),
    "percentile_disc_floor": ("select event_type, percentile_disc(0.5) within group (order by value asc) as p50, percentile_disc(0.25) within group (order by value desc) as q from events group by event_type", "select event_type, list_sort(list(value))[cast(floor(count(value) * 0.5) as int) + 1] as p50, list_reverse_sort(list(value))[cast(floor(count(value) * 0.25) as int) + 1] as q from events group by 1"),
    "percentile_disc_text": ("select percentile_disc(0.5) within group (order by p_name asc) as p, percentile_disc(1.0) within group (order by p_size asc) as q from part", "select list_sort(list(p_name))[cast(floor(count(*) * 0.5) as int) + 1] as p, max(p_size) as q from part"),
    "percentile_disc_time": ("select event_type, percentile_disc(0.75) within group (order by ts asc) as p from events group by event_type", "select event_type, list_sort(list(ts))[cast(floor(count(*) * 0.75) as int) + 1] as p from events group by 1"),
    "approx_percentile": ("select event_type, max(value) as m, approx_percentile(0.5) within group (order by value asc) between percentile_disc(0.49) within group (order by value asc) and percentile_disc(0.51) within group (order by value asc) as near from events group by event_type", "select event_type, max(value) as m, true as near from events group by event_type"),
    "approx_count_distinct": ("select event_type, count(distinct user_id) as n, abs(approx_count_distinct(user_id) - count(distinct user_id)) <= count(distinct user_id) * 0.15 as near from events group by event_type", "select event_type, count(distinct user_id) as n, true as near from events group by event_type"),
    # joins
    "cross_join": ("select r_name, s_suppkey from region cross join supplier", "select r_name, s_suppkey from region, supplier"),
    "cross_comma": ("select n_name, r_name from nation, region", None),
    "inner_equi": ("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey", None),
    "inner_residual": ("select o.o_orderkey as k, c.c_name as name from orders as o inner join customer as c on o.o_custkey = c.c_custkey and c.c_acctbal > 5000 and o.o_totalprice > 100000", None),
    "inner_theta": ("select a.n_name as x, b.r_name as y from nation as a join region as b on a.n_regionkey < b.r_regionkey", None),
    "left_equi": ("select d.doc_id as doc_id, l.quality as quality from documents as d left join labels as l on d.doc_id = l.doc_id", None),
    "left_theta": ("select r_name, n_name from region left outer join nation on r_regionkey > n_regionkey and n_nationkey < 6", None),
    "right_equi": ("select l.quality as quality, d.doc_id as doc_id from labels as l right join documents as d on l.doc_id = d.doc_id", None),
    "right_theta": ("select n_name, r_name from nation right join region on n_regionkey > r_regionkey", None),
    "comma_where": ("select s_name, n_name from supplier, nation where s_nationkey = n_nationkey and s_acctbal > 0", None),
    "three_way": ("select r_name, count(*) as n, round(sum(s_acctbal), 2) as bal from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name", "select r_name, count(*) as n, round(sum(s_acctbal), 2) as bal from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1"),
    "self_join": ("select a.n_name as x, b.n_name as y from nation as a, nation as b where a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey", None),
    "join_star_overwrite": ("select * from labels as a join labels as b on a.doc_id = b.doc_id", "select b.* from labels a join labels b on a.doc_id = b.doc_id"),
    "null_keys": ("select a.doc_id as x, b.doc_id as y from labels as a join labels as b on nullif(a.quality, 1) = nullif(b.quality, 1) and a.doc_id = b.doc_id + 3", None),
    # subqueries
    "scalar_where": ("select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) from orders)", None),
    "scalar_select": ("select r_name, (select count(*) from nation) as nations from region", None),
    "scalar_empty_null": ("select r_name, (select n_name from nation where n_nationkey < 0) as none from region", None),
    "scalar_first_row": ("select r_name, (select n_name from nation order by n_name desc) as last_name from region", "select r_name, (select max(n_name) from nation) as last_name from region"),
    "scalar_correlated": ("select c.c_custkey as k, (select max(o.o_totalprice) from orders as o where o.o_custkey = c.c_custkey) as best from customer as c", None),
    "scalar_correlated_where": ("select o.o_orderkey as k from orders as o where o.o_totalprice >= (select max(p.o_totalprice) from orders as p where p.o_custkey = o.o_custkey)", None),
    # set operations
    "union": ("select c_nationkey as k from customer union select s_nationkey as k from supplier", None),
    "union_all": ("select c_nationkey as k from customer union all select s_nationkey as k from supplier", None),
    "intersect": ("select c_nationkey as k from customer intersect select s_nationkey as k from supplier", None),
    "intersect_all": ("select c_nationkey as k from customer intersect all select s_nationkey as k from supplier", None),
    "except": ("select n_nationkey as k from nation except select s_nationkey as k from supplier where s_nationkey > 10", None),
    "except_all": ("select c_nationkey as k from customer except all select s_nationkey as k from supplier", None),
    "chain_left_assoc": ("select n_nationkey as k from nation union all select r_regionkey as k from region except select 3 as k from region intersect select n_nationkey as k from nation", "((select n_nationkey as k from nation union all select r_regionkey as k from region) except select 3 as k from region) intersect select n_nationkey as k from nation"),
    # sort, limit, distinct
    "order_nulls_asc": ("select documents.doc_id as doc_id, quality from documents left join labels on documents.doc_id = labels.doc_id order by quality asc, doc_id asc limit 500", "select d.doc_id as doc_id, quality from documents d left join labels l on d.doc_id = l.doc_id order by quality asc nulls last, d.doc_id limit 500"),
    "order_nulls_desc": ("select documents.doc_id as doc_id, quality from documents left join labels on documents.doc_id = labels.doc_id order by quality desc, doc_id desc limit 500", "select d.doc_id as doc_id, quality from documents d left join labels l on d.doc_id = l.doc_id order by quality desc nulls first, d.doc_id desc limit 500"),
    "order_multi": ("select o_orderkey, o_orderpriority from orders order by o_orderpriority asc, o_totalprice desc, o_orderkey limit 200", None),
    "order_by_hidden": ("select o_orderkey from orders order by o_totalprice asc, o_orderkey asc limit 10", None),
    "limit": ("select p_partkey from part order by p_partkey limit 7", None),
    "distinct": ("select distinct o_orderstatus, o_orderpriority from orders", None),
    "distinct_order": ("select distinct o_orderpriority from orders order by o_orderpriority desc limit 3", None),
    # nested values
    "path_index": ("select vec_id, embedding[0] as a, embedding[63] as b, embedding[9999] as c from embeddings", "select vec_id, embedding[1] as a, embedding[64] as b, embedding[10000] as c from embeddings"),
    "wildcard_array": ("select vec_id, cardinality(embedding[*]) as n from embeddings", "select vec_id, cast(len(embedding) as bigint) as n from embeddings"),
    "unnest_at": ("select x, i from embeddings.embedding as x at i", "select unnest(embedding) as x, cast(generate_subscripts(embedding, 1) - 1 as bigint) as i from embeddings"),
    "unnest_aggregate": ("select i, round(avg(x), 4) as mean from embeddings.embedding as x at i group by i", "select i, round(avg(x), 4) as mean from (select cast(unnest(embedding) as double) as x, cast(generate_subscripts(embedding, 1) - 1 as bigint) as i from embeddings) group by 1"),
    "unnest_scalar": ("select x, i from nation.n_name as x at i", "select n_name as x, cast(null as bigint) as i from nation"),
    # time
    "time_bucket_second": ('select t, count(*) as n from events group by time_bucket("30 seconds", ts) as t', "select time_bucket(interval '30 seconds', ts) as t, count(*) as n from events group by 1"),
    "time_bucket_minute": ('select t, count(*) as n from events group by time_bucket("5 minutes", ts) as t', "select time_bucket(interval '5 minutes', ts) as t, count(*) as n from events group by 1"),
    "time_bucket_hour": ('select t, round(sum(value), 3) as s from events group by time_bucket("6 hours", ts) as t', "select time_bucket(interval '6 hours', ts) as t, round(sum(value), 3) as s from events group by 1"),
}

#: function: (table, key, query expression, DuckDB expression; None where the same will do)
FUNCTIONS: dict[str, tuple[str, str, str, str | None]] = {
    "abs": ("customer", "c_custkey", "abs(c_acctbal)", None),
    "ceil": ("customer", "c_custkey", "ceil(c_acctbal)", "cast(ceil(c_acctbal) as bigint)"),
    "ceiling": ("customer", "c_custkey", "ceiling(c_acctbal)", "cast(ceil(c_acctbal) as bigint)"),
    "floor": ("customer", "c_custkey", "floor(c_acctbal)", "cast(floor(c_acctbal) as bigint)"),
    "round": ("customer", "c_custkey", "round(c_acctbal) + round(c_acctbal, 1)", "cast(round(c_acctbal) as bigint) + round(c_acctbal, 1)"),
    "sqrt": ("part", "p_partkey", "round(sqrt(p_retailprice), 6)", None),
    "sign": ("customer", "c_custkey", "sign(c_acctbal)", "cast(sign(c_acctbal) as double)"),
    "truncate": ("customer", "c_custkey", "truncate(c_acctbal)", "cast(trunc(c_acctbal) as bigint)"),
    "trunc": ("customer", "c_custkey", "trunc(c_acctbal)", "cast(trunc(c_acctbal) as bigint)"),
    "ln": ("part", "p_partkey", "round(ln(p_retailprice), 6)", None),
    "log2": ("part", "p_partkey", "round(log2(p_retailprice), 6)", None),
    "log10": ("part", "p_partkey", "round(log10(p_retailprice), 6)", None),
    "exp": ("part", "p_partkey", "round(exp(p_size / 50.0), 6)", None),
    "power": ("part", "p_partkey", "power(p_size, 2)", "cast(p_size as double) * p_size"),
    "pow": ("part", "p_partkey", "pow(p_size, 3)", "cast(p_size as double) * p_size * p_size"),
    "mod": ("part", "p_partkey", "mod(p_partkey, 7)", "p_partkey % 7"),
    "modulus": ("part", "p_partkey", "modulus(p_partkey, mod(p_size, 5))", "case when p_size % 5 <> 0 then p_partkey % (p_size % 5) end"),
    "atan2": ("part", "p_partkey", "round(atan2(p_size, p_retailprice), 6)", None),
    "pi": ("region", "r_regionkey", "round(pi() * r_regionkey, 6)", None),
    "e": ("region", "r_regionkey", "round(e() * r_regionkey, 6)", "round(exp(1) * r_regionkey, 6)"),
    "infinity": ("customer", "c_custkey", "is_infinite(infinity() * c_acctbal) and infinity() * c_acctbal > c_acctbal", "c_acctbal > 0"),
    "nan": ("customer", "c_custkey", "is_nan(case when c_acctbal > 0 then c_acctbal + nan() else c_acctbal end)", "c_acctbal > 0"),
    "is_nan": ("customer", "c_custkey", "is_nan(c_acctbal)", "isnan(c_acctbal)"),
    "is_finite": ("customer", "c_custkey", "is_finite(c_acctbal)", "isfinite(c_acctbal)"),
    "is_infinite": ("customer", "c_custkey", "is_infinite(c_acctbal / 0.0)", "c_acctbal <> 0"),
    **{n: ("part", "p_partkey", f"round({n}(p_size / 10.0), 6)", None) for n in ("radians", "degrees", "sin", "cos", "tan", "atan", "cosh", "tanh")},
    **{n: ("part", "p_partkey", f"round({n}(p_size / 100.0), 6)", None) for n in ("asin", "acos")},
    "array_sort": ("part", "p_partkey", "array_join(array_sort(split(p_name, ' ')), ' ')", "array_to_string(list_sort(string_split(p_name, ' ')), ' ')"),
    "array_distinct": ("part", "p_partkey", "cardinality(array_distinct(split(p_type, 'A')))", "cast(len(list_distinct(string_split(p_type, 'A'))) as bigint)"),
    "array_contains": ("part", "p_partkey", "array_contains(split(p_name, ' '), 'part')", "list_contains(string_split(p_name, ' '), 'part')"),
    "array_join": ("part", "p_partkey", "array_join([p_brand, null, p_type], '/') || array_join([p_brand, null], '/', '?')", "p_brand || '/' || p_type || p_brand || '/?'"),
    "array_min": ("embeddings", "vec_id", "array_min(embedding)", "list_min(embedding)"),
    "array_max": ("embeddings", "vec_id", "array_max(embedding)", "list_max(embedding)"),
    "array_position": ("part", "p_partkey", "array_position([1, 5, 9], p_size)", "cast(case p_size when 1 then 1 when 5 then 2 when 9 then 3 else 0 end as bigint)"),
    "cardinality": ("part", "p_partkey", "cardinality(split(p_name, ' '))", "cast(len(string_split(p_name, ' ')) as bigint)"),
    "flatten": ("part", "p_partkey", "array_join(flatten([[p_brand], [p_type, 'x']]), ',')", "p_brand || ',' || p_type || ',x'"),
    "array_intersect": ("part", "p_partkey", "cardinality(array_intersect([p_size, 3], [3, 4, 5]))", "cast(case when p_size in (4, 5) then 2 else 1 end as bigint)"),
    "array_union": ("part", "p_partkey", "cardinality(array_union([p_size], [3, 4]))", "cast(case when p_size in (3, 4) then 2 else 3 end as bigint)"),
    "array_except": ("part", "p_partkey", "cardinality(array_except([p_size, 3], [3]))", "cast(case when p_size = 3 then 0 else 1 end as bigint)"),
    "array_remove": ("part", "p_partkey", "cardinality(array_remove([p_size, 3, 3], 3))", "cast(case when p_size = 3 then 0 else 1 end as bigint)"),
    "slice": ("part", "p_partkey", "array_join(slice([p_brand, p_type, p_name, 'x'], 2, 2), '|') || array_join(slice([p_brand, p_type, p_name], 3, 9), '|') || array_join(slice([p_brand, p_type], -2, 1), '|') || cast(cardinality(slice([p_brand], 0, 2)) as varchar)", "p_type || '|' || p_name || p_name || '0'"),
    "shuffle": ("part", "p_partkey", "array_join(shuffle(split(p_name, ' ')), ' ')", "array_to_string(list_reverse(string_split(p_name, ' ')), ' ')"),
    "bitwise_and": ("part", "p_partkey", "bitwise_and(p_partkey, 12)", "p_partkey & 12"),
    "bitwise_or": ("part", "p_partkey", "bitwise_or(p_partkey, 12)", "p_partkey | 12"),
    "bitwise_xor": ("part", "p_partkey", "bitwise_xor(p_partkey, 12)", "xor(p_partkey, 12)"),
    "bitwise_not": ("part", "p_partkey", "bitwise_not(p_partkey)", "~p_partkey"),
    "bit_count": ("part", "p_partkey", "bit_count(p_size) + bit_count(-p_size)", "cast(bit_count(p_size) as bigint) + cast(bit_count(-p_size) as bigint)"),
    "bitwise_shift_left": ("part", "p_partkey", "bitwise_shift_left(p_partkey, 3)", "p_partkey * 8"),
    "bitwise_shift_right": ("part", "p_partkey", "bitwise_shift_right(p_partkey, 2)", "p_partkey >> 2"),
    "upper": ("customer", "c_custkey", "upper(c_name)", None),
    "lower": ("customer", "c_custkey", "lower(c_name)", None),
    "char_length": ("documents", "doc_id", "char_length(text)", "length(text)"),
    "character_length": ("documents", "doc_id", "character_length(lang)", "length(lang)"),
    "substring": ("customer", "c_custkey", "substring(c_name, 3, 4) || '|' || substring(c_name, -5, 2) || substring(c_name, 12)", "substring(c_name, 3, 4) || '|' || substring(c_name, 1, 2) || substring(c_name, 12)"),
    "trim": ("customer", "c_custkey", "trim('  ' || c_name || ' ')", "c_name"),
    "ltrim": ("customer", "c_custkey", "ltrim('  ' || c_name || ' ')", "c_name || ' '"),
    "rtrim": ("customer", "c_custkey", "rtrim('  ' || c_name || ' ')", "'  ' || c_name"),
    "replace": ("customer", "c_custkey", "replace(c_name, 'Customer', 'C')", None),
    "reverse": ("customer", "c_custkey", "reverse(c_name)", None),
    "repeat": ("part", "p_partkey", "repeat('ab', p_size) || repeat('x', -1)", "repeat('ab', p_size)"),
    "lpad": ("part", "p_partkey", "lpad(p_brand, 12, '*+') || lpad(p_brand, 3)", "lpad(p_brand, 12, '*+') || lpad(p_brand, 3, ' ')"),
    "rpad": ("part", "p_partkey", "rpad(p_brand, 12, '*+') || rpad(p_brand, 20)", "rpad(p_brand, 12, '*+') || rpad(p_brand, 20, ' ')"),
    "position": ("part", "p_partkey", "position(p_type, 'A')", "instr(p_type, 'A')"),
    "strpos": ("part", "p_partkey", "strpos(p_brand, '#')", "instr(p_brand, '#')"),
    "starts_with": ("part", "p_partkey", "starts_with(p_brand, 'Brand#1')", None),
    "ends_with": ("part", "p_partkey", "ends_with(p_brand, '3')", None),
    "split": ("customer", "c_custkey", "array_join(split(c_name, '#0'), '~')", "array_to_string(string_split(c_name, '#0'), '~')"),
    "split_part": ("customer", "c_custkey", "split_part(c_name, '#', 2) || split_part(c_name, '#', 0) || split_part(c_name, '#', 9)", "split_part(c_name, '#', 2)"),
    "concat_ws": ("part", "p_partkey", "concat_ws('-', p_brand, null, p_type)", None),
    "chr": ("part", "p_partkey", "chr(p_size + 8360)", "chr(cast(p_size + 8360 as int))"),
    "codepoint": ("part", "p_partkey", "codepoint(chr(p_size + 8360))", "cast(p_size + 8360 as bigint)"),
    "levenshtein_distance": ("part", "p_partkey", "levenshtein_distance(p_brand, p_type)", "levenshtein(p_brand, p_type)"),
    "hamming_distance": ("part", "p_partkey", "hamming_distance(p_brand, 'Brand#11')", "case when length(p_brand) = 8 then cast(hamming(p_brand, 'Brand#11') as bigint) end"),
    "url_host": ("pages", "page_id", "url_host(url)", "regexp_extract(url, '://([^/?#]*)', 1)"),
    "url_port": ("pages", "page_id", "url_port(replace(url, '.com/', '.com:8080/'))", "cast(case when contains(url, '.com/') then 8080 end as bigint)"),
    "url_path": ("pages", "page_id", "url_path(url)", "regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"),
    "url_fragment": ("pages", "page_id", "url_fragment(url)", "nullif(regexp_extract(url, '#(.*)$', 1), '')"),
    "url_query": ("pages", "page_id", "url_query(url)", r"nullif(regexp_extract(url, '\?([^#]*)', 1), '')"),
    "url_path_segments": ("pages", "page_id", "url_path_segments(url, 1)", "string_split(regexp_extract(url, '://[^/?#]*/([^?#]*)', 1), '/')[2]"),
    "url_path_bucket": ("pages", "page_id", "url_path_bucket(url, 0, '_')", "'/_' || regexp_extract(url, '://[^/?#]*/[^/?#]*([^?#]*)', 1)"),
    "host_name": ("supplier", "s_suppkey", "host_name(s_name || ':80')", "s_name"),
    "host_port": ("supplier", "s_suppkey", "host_port(s_name || ':8080')", "cast(8080 as bigint)"),
    "date_part": ("events", "event_id", 'date_part("minute", ts) * 100 + date_part("year", ts)', "cast(minute(ts) * 100 + year(ts) as double)"),
    "time_bucket": ("events", "event_id", 'time_bucket("15 minutes", ts)', "time_bucket(interval '15 minutes', ts)"),
    **{n: ("events", "event_id", f"{n}(ts)", f"cast({n}(ts) as bigint)") for n in ("year", "month", "day", "hour", "minute", "second", "quarter")},
    "week": ("events", "event_id", "week(ts)", "cast(weekofyear(ts) as bigint)"),
    "millisecond": ("events", "event_id", "millisecond(ts)", "cast(millisecond(ts) % 1000 as bigint)"),
    "day_of_week": ("events", "event_id", "day_of_week(ts)", "cast(isodow(ts) as bigint)"),
    "day_of_year": ("events", "event_id", "day_of_year(ts)", "cast(dayofyear(ts) as bigint)"),
    "date_add": ("events", "event_id", 'date_add("hour", 30, ts)', "ts + interval '30 hours'"),
    "date_diff": ("events", "event_id", 'date_diff("minute", ts, from_unixtime(1800000000))', "cast((1800000000000000 - epoch_us(ts)) // 60000000 as bigint)"),
    "date_trunc": ("events", "event_id", 'date_trunc("day", ts)', "cast(date_trunc('day', ts) as timestamp)"),
    "from_unixtime": ("part", "p_partkey", "from_unixtime(p_partkey * 10000)", "make_timestamp(p_partkey * 10000000000)"),
    "to_unixtime": ("events", "event_id", "to_unixtime(ts)", "cast(floor(epoch(ts)) as bigint)"),
    "now": ("region", "r_regionkey", "(year(now()) * 100 + month(now())) * r_regionkey", "cast((year(now()) * 100 + month(now())) * r_regionkey as bigint)"),
    "regexp_like": ("part", "p_partkey", "regexp_like(p_name, '[0-4]$')", "regexp_matches(p_name, '[0-4]$')"),
    "regexp_extract": ("part", "p_partkey", "coalesce(regexp_extract(p_brand, '#(\\d)(\\d)', 2), 'none')", "coalesce(nullif(regexp_extract(p_brand, '#(\\d)(\\d)', 2), ''), 'none')"),
    "regexp_extract_all": ("customer", "c_custkey", "array_join(regexp_extract_all(c_name, '[1-9]+'), ',')", "array_to_string(regexp_extract_all(c_name, '[1-9]+'), ',')"),
    "regexp_replace": ("customer", "c_custkey", "regexp_replace(c_name, '0+', '0')", "regexp_replace(c_name, '0+', '0', 'g')"),
    "regexp_split": ("customer", "c_custkey", "cardinality(regexp_split(c_name, '[#0]'))", "cast(len(regexp_split_to_array(c_name, '[#0]')) as bigint)"),
    "regexp_count": ("customer", "c_custkey", "regexp_count(c_name, '0')", "cast(len(regexp_extract_all(c_name, '0')) as bigint)"),
    "json_extract": ("events", "event_id", "json_extract(props, '$.k')", "cast(json_extract(props, '$.k') as varchar)"),
    "json_extract_scalar": ("events", "event_id", "json_extract_scalar(props, '$.k')", "json_extract_string(props, '$.k')"),
    "json_array_length": ("events", "event_id", "json_array_length('[' || repeat('7, ', mod(event_id, 9)) || props || ']')", "event_id % 9 + 1"),
    "json_array_contains": ("events", "event_id", "json_array_contains('[5, 17, true]', event_id)", "event_id in (5, 17)"),
    "json_size": ("events", "event_id", "json_size(props, '$') + json_size(props, '$.k')", "cast(1 as bigint)"),
    "json_format": ("events", "event_id", "json_format(user_id)", "cast(user_id as varchar)"),
    "json_parse": ("events", "event_id", "json_extract_scalar(json_parse('[0, ' || props || ']'), '$[1].k')", "json_extract_string(props, '$.k')"),
    "is_json_scalar": ("events", "event_id", "is_json_scalar(case when mod(event_id, 4) = 0 then props when mod(event_id, 4) = 1 then '[1]' when mod(event_id, 4) = 2 then cast(event_id as varchar) else 'true' end)", "event_id % 4 > 1"),
    "map_keys": ("part", "p_partkey", "array_join(array_sort(map_keys(map_from_entries([[p_brand, 'a'], [p_type, 'b']]))), ',')", "least(p_brand, p_type) || ',' || greatest(p_brand, p_type)"),
    "map_values": ("part", "p_partkey", "array_join(map_values(map_from_entries([['a', p_brand], ['b', p_type]])), ',')", "p_brand || ',' || p_type"),
    "map_entries": ("part", "p_partkey", "array_join(map_entries(map_from_entries([['a', p_brand], ['b', p_type]])), ';')", "'{a, ' || p_brand || '};{b, ' || p_type || '}'"),
    "element_at": ("part", "p_partkey", "coalesce(element_at(split(p_name, ' '), 1), '') || coalesce(element_at(split(p_name, ' '), 99), '')", "string_split(p_name, ' ')[1]"),
    "map_concat": ("part", "p_partkey", "element_at(map_concat(map_from_entries([['a', p_brand]]), map_from_entries([['a', p_type]])), 'a')", "p_type"),
    "map_from_entries": ("part", "p_partkey", "element_at(map_from_entries([['a', p_brand], ['a', p_type]]), 'a')", "p_type"),
    "typeof": ("part", "p_partkey", "typeof(p_size) || typeof(p_name) || typeof(p_retailprice) || typeof([1]) || typeof(null)", "'integerstringfloatarraynull'"),
    "try_cast": ("part", "p_partkey", "try_cast(split_part(p_brand, '#', 2), 'int') + coalesce(try_cast(p_brand, 'int'), 0)", "cast(split_part(p_brand, '#', 2) as bigint)"),
    "to_base": ("part", "p_partkey", "to_base(p_partkey, 16)", "lower(printf('%x', p_partkey))"),
    "from_base": ("part", "p_partkey", "from_base(to_base(p_partkey, 7), 7)", "p_partkey"),
    "format_number": ("customer", "c_custkey", "format_number(c_acctbal, 2)", "printf('%.2f', c_acctbal)"),
}


def function_query(name: str) -> tuple[str, str]:
    table, key, text, sql = FUNCTIONS[name]
    return f"select {key} as k, {text} as v from {table}", f"select {key} as k, {sql or text} as v from {table}"


# -- log formats: rows of the tables as log lines, and back ---------------------------------------


def _tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log_rows(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    """Orders dressed as rows of a log format."""
    from .sources import logs

    o = _tables(spark, sf_dir, "orders").repartition(8)  # so that several files are written
    host = F.struct(F.concat(F.lit("10.0.0."), F.col("o_custkey") % 200).alias("hostname"), (F.col("o_custkey") % 60000).cast("int").alias("port"))
    url = F.concat(F.lit("http://www.example.com/"), F.lower("o_orderstatus"), F.lit("/"), F.col("o_orderkey").cast("string"))
    raw = F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1"))
    request = F.struct(F.lit("GET").alias("http_method"), url.alias("url"), F.lit("HTTP/1.1").alias("http_version"), raw.alias("raw"))
    values = {"host": host, "request": request, "datetime": F.col("o_orderdate").cast("timestamp"), "int": F.col("o_orderkey"), "float": F.col("o_totalprice")}
    texts = {"elb_status_code": F.when(F.col("o_orderstatus") == "F", "500").otherwise("200"), "user_agent": F.concat(F.lit("agent "), F.col("o_orderpriority")), "request_uri": raw, "key": F.col("o_orderkey").cast("string"), "bytes": F.col("o_custkey").cast("string"), "url": url}
    columns = [values[kind] if kind else texts.get(name, F.lit("x")) for name, kind in logs.fields(fmt)]
    return logs.rendered(o.select(*(c.alias(n) for c, (n, _) in zip(columns, logs.fields(fmt)))), fmt)


def log_query(fmt: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    return over_files(lambda spark, sf_dir: _log_rows(spark, sf_dir, fmt), fmt, text)


_ELB = "select elb_status_code, url_path_segments(request, 0) as s, count(*) as n, sum(received_bytes) as b, max(host_port(client_and_port)) as p, max(timestamp) as t, min(user_agent) as a from it group by elb_status_code, url_path_segments(request, 0)"
_ELB_SQL = "select case when o_orderstatus = 'F' then '500' else '200' end as elb_status_code, lower(o_orderstatus) as s, count(*) as n, cast(sum(o_orderkey) as double) as b, cast(max(o_custkey % 60000) as bigint) as p, max(o_orderdate) as t, min('agent ' || o_orderpriority) as a from orders group by 1, 2"
LOGS = {
    "elb_roundtrip": (log_query("elb", _ELB), _ELB_SQL),
    "alb_roundtrip": (log_query("alb", _ELB), _ELB_SQL),
    "s3_roundtrip": (log_query("s3", "select request_uri, key from it"), "select 'GET http://www.example.com/' || lower(o_orderstatus) || '/' || o_orderkey || ' HTTP/1.1' as request_uri, cast(o_orderkey as varchar) as key from orders"),
    "squid_roundtrip": (log_query("squid", "select url_host(url) as h, count(*) as n, sum(cast(bytes as int)) as b from it group by url_host(url)"), "select 'www.example.com' as h, count(*) as n, cast(sum(o_custkey) as double) as b from orders"),
}


def _json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, in which `a` is absent, null or a number."""
    e = _tables(spark, sf_dir, "events").repartition(8)
    a = F.when(F.col("event_id") % 3 == 0, F.lit("")).when(F.col("event_id") % 3 == 1, F.lit(', "a": null')).otherwise(F.concat(F.lit(', "a": '), F.col("user_id").cast("string")))
    line = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), a, F.lit(', "p": '), F.col("props"), F.lit(', "d": [{"x": 1}, {"x": '), F.col("event_id").cast("string"), F.lit("}]}"))
    return e.select(line.alias("value"))


def json_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return over_files(_json_lines, "jsonl", text)


JSON = {
    "missing_vs_null": (json_query("select id, a is missing as m, a is null as n, a as a, coalesce(a, -1) as c from it"), "select event_id as id, event_id % 3 = 0 as m, event_id % 3 = 1 as n, case when event_id % 3 = 2 then user_id end as a, case when event_id % 3 = 2 then user_id else -1 end as c from events"),
    "json_paths": (json_query("select id, p.k as k, d[1].x as x, cardinality(d[*].x) as n, nothing.here is missing as m from it where d[0].x = 1"), "select event_id as id, cast(json_extract_string(props, '$.k') as bigint) as k, event_id as x, cast(2 as bigint) as n, true as m from events"),
    "json_unnest": (json_query("select e.x as x, i from it.d as e at i"), "select 1 as x, cast(0 as bigint) as i from events union all select event_id, 1 from events"),
    "json_group": (json_query("select a, count(*) as n, approx_count_distinct(id) > 0 as some from it group by a"), "select case when event_id % 3 = 2 then user_id end as a, count(*) as n, true as some from events group by 1"),
}


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.buckets import replayed

    return replayed(_tables(spark, sf_dir, "events"), "ts", "1 hour", "event_type", "value")


#: Functions of chance, by what holds of many values: spread over [0, 1), and hardly one twice.
CHANCE = {
    f"fn_{name}": (
        f"select l_linenumber as k, count(*) as n, min({name}()) >= 0.0 and max({name}()) < 1.0 as inside, avg({name}()) between 0.4 and 0.6 as even, max({name}()) - min({name}()) > 0.9 as wide from lineitem group by l_linenumber",
        "select l_linenumber as k, count(*) as n, true as inside, true as even, true as wide from lineitem group by l_linenumber",
    )
    for name in ("rand", "random")
}


def _custom_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "select p_partkey as k, double_it(p_size) as v from part"
    return engine(spark, sf_dir, text).function("double_it", lambda c: c * 2, 1).sql(text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: asking(text) for name, (text, _) in PLAIN.items()}
    out |= {name: run for name, (run, _) in (LOGS | JSON).items()}
    out |= {f"fn_{name}": asking(function_query(name)[0]) for name in FUNCTIONS}
    out |= {name: asking(text) for name, (text, _) in CHANCE.items()}
    out |= {"custom_function": _custom_function, "stream_time_bucket": _streamed}
    return out | {name: run for name, (run, _) in PROOFS.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: text if sql is None else sql for name, (text, sql) in PLAIN.items() if sql != ""}
    out |= {name: sql for name, (_, sql) in (LOGS | JSON).items()}
    out |= {f"fn_{name}": function_query(name)[1] for name in FUNCTIONS}
    out |= {name: sql for name, (_, sql) in CHANCE.items()}
    out |= {name: sql for name, (_, sql) in PROOFS.items()}
    out["custom_function"] = "select p_partkey as k, p_size * 2 as v from part"
    out["stream_time_bucket"] = "select time_bucket(interval '1 hour', ts) as bucket, event_type, count(*) as n, round(sum(value), 3) as total from events group by 1, 2"
    return out

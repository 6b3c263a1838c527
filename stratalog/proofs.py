"""Queries of the catalogue beyond query text over tables: files, output, the command line's
answers, and what all functions promise of their arguments."""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .engine import Engine
from .functions import builtin
from .session import shared_folder
from .sources import logs, sinks

Query = Callable[[SparkSession, str], DataFrame]


def tables(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    out = Engine(spark)
    for name in names:
        out.table(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return out


def folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


#: Formats whose files the catalogue compresses.
COMPRESSED = ("alb", "squid")


def filed(lines: DataFrame, fmt: str) -> str:
    """Lines, a column `value`, written by the executors as a file for each partition, of some
    formats compressed; the `format=path` that reads them."""
    path = folder(lines.sparkSession, fmt)
    lines.write.option("compression", "gzip" if fmt in COMPRESSED else "none").text(path)
    return f"{fmt}={path}/*"


def over_files(lines: Callable[[SparkSession, str], DataFrame], fmt: str, text: str) -> Query:
    """A query over files of a format, by the text that registers them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(spark).source(f"it:{filed(lines(spark, sf_dir), fmt)}").sql(text)

    return run


# -- output ------------------------------------------------------------------------------------

_OUTPUT = "select r_regionkey as k, r_name as n, nullif(r_regionkey, 2) as z, r_regionkey / 4.0 as f, r_regionkey > 1 as b, [r_regionkey, 7] as a from region order by k asc"


def written(fmt: str) -> Query:
    """The lines of a result that the executors wrote."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        items = _OUTPUT if fmt == "json" else _OUTPUT.replace(", [r_regionkey, 7] as a", "")
        path = folder(spark, fmt)
        sinks.write(tables(spark, sf_dir, "region").sql(items), fmt, path)
        return spark.read.text(path).select(F.col("value").alias("line"))

    return run


def shown(mode: str) -> Query:
    """The lines that a result of a few rows is shown as, numbered."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = io.StringIO()
        sinks.show(tables(spark, sf_dir, "region").sql(_OUTPUT), mode, out)
        return spark.createDataFrame(list(enumerate(out.getvalue().splitlines())), "at long, line string")

    return run


_WRITTEN_CSV = "select r_regionkey || ',' || r_name || ',' || coalesce(cast(nullif(r_regionkey, 2) as varchar), '<null>') || ',' || (r_regionkey / 4.0) || ',' || (r_regionkey > 1) as line from region"
_WRITTEN_JSON = """select '{"k":' || r_regionkey || ',"n":"' || r_name || '"' || coalesce(',"z":' || nullif(r_regionkey, 2), '') || ',"f":' || (r_regionkey / 4.0) || ',"b":' || (r_regionkey > 1) || ',"a":[' || r_regionkey || ',7]}' as line from region"""
_CELLS = """cells as (select r_regionkey as pos, cast(r_regionkey as varchar) as k, r_name as n, coalesce(cast(nullif(r_regionkey, 2) as varchar), '<null>') as z,
    case when r_regionkey % 4 = 0 then cast(r_regionkey // 4 as varchar) else cast(r_regionkey / 4.0 as varchar) end as f, cast(r_regionkey > 1 as varchar) as b, '[...]' as a from region)"""
_SHOWN_CSV = f"""with {_CELLS} select cast(pos as bigint) as "at", concat_ws(',', k, n, z, f, b, a) as line from cells"""
_SHOWN_TABLE = f"""with {_CELLS},
wide as (select max(length(k)) as k, max(length(n)) as n, max(length(z)) as z, max(length(f)) as f, max(length(b)) as b, max(length(a)) as a, count(*) as n_rows from cells),
rules as (select unnest(range(n_rows + 1)) * 2 as pos, '+' || repeat('-', k + 2) || '+' || repeat('-', n + 2) || '+' || repeat('-', z + 2) || '+' || repeat('-', f + 2) || '+' || repeat('-', b + 2) || '+' || repeat('-', a + 2) || '+' as line from wide)
select cast(pos as bigint) as "at", line from rules union all
select cast(2 * c.pos + 1 as bigint), '| ' || rpad(c.k, cast(w.k as int), ' ') || ' | ' || rpad(c.n, cast(w.n as int), ' ') || ' | ' || rpad(c.z, cast(w.z as int), ' ') || ' | ' || rpad(c.f, cast(w.f as int), ' ') || ' | ' || rpad(c.b, cast(w.b as int), ' ') || ' | ' || rpad(c.a, cast(w.a as int), ' ') || ' |' from cells c, wide w"""
_SHOWN_JSON = """select cast(0 as bigint) as "at", '[' || string_agg('{"k": ' || r_regionkey || ', "n": "' || r_name || '", "z": ' || coalesce(cast(nullif(r_regionkey, 2) as varchar), 'null') || ', "f": ' || (r_regionkey / 4.0) || ', "b": ' || (r_regionkey > 1) || ', "a": [' || r_regionkey || ', 7]}', ',' order by r_regionkey) || ']' as line from region"""


# -- the command line's answers ---------------------------------------------------------------


def _stdin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a proxy's log through standard input."""
    lines = [f"{r.r_regionkey}.5 {r.r_regionkey * 7} host{r.r_regionkey} TCP_HIT/200 99 GET http://x.test/{r.r_name} - NONE/- text/html" for r in spark.read.parquet(f"{sf_dir}/region.parquet").collect()]
    engine = Engine(spark)
    engine.tables.add_spec("it:squid=stdin", stdin=io.StringIO("\n".join(lines)))
    return engine.sql("select cast(elapsed as int) as e, remote_host as h, url_path(url) as p from it where cast(elapsed as int) > 7")


def _explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a plan says of its scan and joins."""
    engine = tables(spark, sf_dir, "orders", "customer")
    plan = engine.explain("select c.c_name as n, count(*) as k from orders as o join customer as c on o.o_custkey = c.c_custkey where o.o_totalprice > 1000 group by c.c_name")
    read = sorted(x for found in re.findall(r"ReadSchema: struct<(.*?)>", plan) for x in found.split(","))
    rows = [(" ".join(read), "GreaterThan(o_totalprice,1000.0)" in plan or "GreaterThan(o_totalprice,1000)" in plan, "Cartesian" in plan)]
    return spark.createDataFrame(rows, "columns string, pushed boolean, cartesian boolean")


def _schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(fmt, at, *field) for fmt in logs.FIELDS for at, field in enumerate(logs.describe(fmt))]
    return spark.createDataFrame(rows, "format string, at long, field string, kind string")


# The fields of each format in order, and those that aren't text.
_FIELDS = {
    "elb": "timestamp elbname client_and_port backend_and_port request_processing_time backend_processing_time response_processing_time elb_status_code backend_status_code received_bytes sent_bytes request user_agent ssl_cipher ssl_protocol target_group_arn trace_id",
    "alb": "type timestamp elb client_and_port target_and_port request_processing_time target_processing_time response_processing_time elb_status_code target_status_code received_bytes sent_bytes request user_agent ssl_cipher ssl_protocol target_group_arn trace_id domain_name chosen_cert_arn matched_rule_priority request_creation_time action_executed redirect_url error_reason",
    "s3": "bucket_owner bucket time remote_ip requester request_id operation key request_uri http_status error_code bytes_sent object_size total_time turn_around_time refererr user_agent version_id host_id signature_version cipher_suite authentication_type host_header tls_version",
    "squid": "timestamp elapsed remote_host code_and_status bytes method url rfc931 peer_status_and_peer_host type",
}
_SCHEMAS = f"""with f as (select * from (values {", ".join(f"('{k}', '{v}')" for k, v in _FIELDS.items())}) v(format, names)),
each as (select format, unnest(string_split(names, ' ')) as field, unnest(range(len(string_split(names, ' ')))) as pos from f)
select format, cast(pos as bigint) as "at", field, case when format not in ('elb', 'alb') then 'String' when field = 'timestamp' then 'DateTime' when ends_with(field, '_and_port') then 'Host'
    when ends_with(field, '_processing_time') then 'Float' when field in ('received_bytes', 'sent_bytes') then 'Integral' when field = 'request' then 'HttpRequest' else 'String' end as kind from each"""


# -- arguments ------------------------------------------------------------------------------------

# How many arguments functions take.
ARITIES = {
    (0, 0): "pi e infinity nan rand random now",
    (1, 1): """abs ceil ceiling floor sqrt sign truncate trunc ln log2 log10 exp is_nan is_finite is_infinite radians degrees sin cos tan asin acos
        atan cosh tanh array_sort array_distinct array_min array_max cardinality flatten shuffle bitwise_not bit_count upper lower char_length
        character_length reverse chr codepoint url_host url_port url_path url_fragment url_query host_name host_port year month day hour minute second
        millisecond quarter week day_of_week day_of_year from_unixtime to_unixtime json_array_length json_format json_parse is_json_scalar map_keys
        map_values map_entries map_from_entries typeof""",
    (1, 2): "round trim ltrim rtrim",
    (2, 2): """plus minus times divide power pow mod modulus atan2 array_contains array_position array_intersect array_union array_except array_remove
        bitwise_and bitwise_or bitwise_xor bitwise_shift_left bitwise_shift_right concat repeat position strpos starts_with ends_with split
        levenshtein_distance hamming_distance url_path_segments date_part time_bucket date_trunc regexp_like regexp_extract_all regexp_split
        regexp_count json_extract json_extract_scalar json_array_contains json_size element_at map_concat try_cast to_base from_base format_number""",
    (2, 99): "concat_ws",
    (2, 3): "array_join substring lpad rpad regexp_extract",
    (3, 3): "slice replace split_part url_path_bucket date_add date_diff regexp_replace",
}


def _arities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least and most arguments, of up to 99, that each function accepts."""
    counts = {name: [n for n in range(100) if f.accepts(n)] for name, f in builtin().functions.items()}
    return spark.createDataFrame([(name, min(x), max(x)) for name, x in counts.items()], "name string, least long, most long")


_ARITIES = "select * from (values " + ", ".join(f"('{name}', cast({least} as bigint), cast({most} as bigint))" for (least, most), names in ARITIES.items() for name in names.split()) + ") v(name, least, most)"

#: Calls with a null where a value is due, by the null column they take: i, x, s, t, a, n (nested)
#: and m. All give null but those of KEPT.
NULL_CALLS = {
    "x": """abs(x) ceil(x) ceiling(x) floor(x) round(x) sqrt(x) sign(x) truncate(x) trunc(x) ln(x) log2(x) log10(x) exp(x) is_nan(x) is_finite(x)
        is_infinite(x) radians(x) degrees(x) sin(x) cos(x) tan(x) asin(x) acos(x) atan(x) cosh(x) tanh(x) power(x,2) pow(2,x) atan2(x,1) format_number(x,2)
        x+1 1-x x*2 x/2""",
    "i": "mod(i,3) modulus(7,i) bitwise_and(i,1) bitwise_or(1,i) bitwise_xor(i,1) bitwise_not(i) bit_count(i) bitwise_shift_left(i,1) bitwise_shift_right(i,1) chr(i) from_unixtime(i) to_base(i,16) json_format(i) typeof(i)",
    "s": """upper(s) lower(s) char_length(s) character_length(s) trim(s) ltrim(s) rtrim(s) reverse(s) codepoint(s) substring(s,1,2) replace(s,'a','b')
        repeat(s,2) lpad(s,3) rpad(s,3,'x') position(s,'a') strpos(s,'a') starts_with(s,'a') ends_with('a',s) split(s,',') split_part(s,',',1)
        levenshtein_distance(s,'a') hamming_distance('a',s) s||'a' concat_ws('-',s,'a') url_host(s) url_port(s) url_path(s) url_fragment(s) url_query(s)
        url_path_segments(s,0) url_path_bucket(s,0,'_') host_name(s) host_port(s) regexp_like(s,'a') regexp_extract(s,'a') regexp_extract_all(s,'a')
        regexp_replace(s,'a','b') regexp_split(s,'a') regexp_count(s,'a') json_extract(s,'$.a') json_extract_scalar(s,'$.a') json_array_length(s)
        json_array_contains(s,1) json_size(s,'$') json_parse(s) is_json_scalar(s) try_cast(s,'int') from_base(s,10)""",
    "t": "date_part('year',t) time_bucket('2hours',t) year(t) month(t) day(t) hour(t) minute(t) second(t) millisecond(t) quarter(t) week(t) day_of_week(t) day_of_year(t) date_add('day',1,t) date_diff('day',t,t) date_trunc('day',t) to_unixtime(t)",
    "a": """array_sort(a) array_distinct(a) array_min(a) array_max(a) array_contains(a,'x') array_join(a,',') array_position(a,'x') cardinality(a)
        array_intersect(a,a) array_union(a,['x']) array_except(a,['x']) array_remove(a,'x') slice(a,1,2) shuffle(a) element_at(a,1)""",
    "n": "flatten(n) map_from_entries(n)",
    "m": "map_keys(m) map_values(m) map_entries(m) map_concat(m,m)",
}
#: Calls that a null doesn't make null.
KEPT = ("concat_ws('-',s,'a')", "typeof(i)")


def _nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = [call for calls in NULL_CALLS.values() for call in calls.split()]
    kinds = {"i": "bigint", "x": "double", "s": "string", "t": "timestamp", "a": "array<string>", "n": "array<array<string>>", "m": "map<string,string>"}
    one = spark.range(1).select(*(F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()))
    items = ", ".join(f"({call.replace('2hours', '2 hours')}) is null as v{k}" for k, call in enumerate(calls))
    found = Engine(spark).table("it", one).sql(f"select {items} from it")
    each = F.explode(F.array(*(F.struct(F.lit(call).alias("call"), F.col(f"v{k}").alias("is_null")) for k, call in enumerate(calls))))
    return found.select(each.alias("e")).select("e.*")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NULLS = "select * from (values " + ", ".join(f"({_quoted(call)}, {'false' if call in KEPT else 'true'})" for calls in NULL_CALLS.values() for call in calls.split()) + ") v(call, is_null)"

#: name: (query, DuckDB SQL)
PROOFS: dict[str, tuple[Query, str]] = {
    "sink_csv": (written("csv"), _WRITTEN_CSV),
    "sink_json": (written("json"), _WRITTEN_JSON),
    "show_csv": (shown("csv"), _SHOWN_CSV),
    "show_table": (shown("table"), _SHOWN_TABLE),
    "show_json": (shown("json"), _SHOWN_JSON),
    "stdin_scan": (_stdin, "select cast(r_regionkey * 7 as bigint) as e, 'host' || r_regionkey as h, '/' || string_split(r_name, ' ')[1] as p from region where r_regionkey > 1"),
    "explain_plan": (_explain, "select 'c_custkey:bigint c_name:string o_custkey:bigint o_totalprice:double' as columns, true as pushed, false as cartesian"),
    "log_schemas": (_schemas, _SCHEMAS),
    "function_arities": (_arities, _ARITIES),
    "function_nulls": (_nulls, _NULLS),
}

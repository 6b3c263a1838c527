import datetime
import io
import json

import pytest

from stratalog.cli import main
from stratalog.engine import Engine
from stratalog.errors import AnalysisError, EngineError, SourceError
from stratalog.functions import builtin
from stratalog.session import shared_folder
from stratalog.sources import json_lines, logs, sinks


@pytest.fixture
def engine(spark):
    return Engine(spark)


def lines(spark, *texts):
    return spark.createDataFrame([(x,) for x in texts], "value string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def orchard(spark, engine):
    trees = ["apple", "quince", "medlar", "cherry"]
    engine.table("trees", json_lines.parse(lines(spark, *(json.dumps({"no": 10 * k, "kind": kind}) for k, kind in enumerate(trees)))))
    return engine.table("picked", json_lines.parse(lines(spark, '{"tree": 10, "kilos": 4.5}', '{"tree": 30, "kilos": 12}', '{"tree": 30, "kilos": 1.5}')))


def test_all_functions_are_there():
    assert len(builtin().functions) == 141


def test_joins(orchard):
    assert rows(orchard.sql("select t.kind as k, p.kilos as w from trees t join picked p on t.no = p.tree")) == [("cherry", 1.5), ("cherry", 12.0), ("quince", 4.5)]
    assert rows(orchard.sql("select kind, kilos from trees left join picked on trees.no = picked.tree and kilos > 2")) == [("apple", None), ("cherry", 12.0), ("medlar", None), ("quince", 4.5)]
    assert rows(orchard.sql("select kind, count(kilos) as n from picked right join trees on trees.no = picked.tree group by kind")) == [("apple", 0), ("cherry", 2), ("medlar", 0), ("quince", 1)]
    assert rows(orchard.sql("select count(*) as n from trees, picked")) == [(12,)]
    assert rows(orchard.sql("select t.no as i, p.kilos as w from trees t join picked p on t.no > p.tree")) == [(20, 4.5), (30, 4.5)]


def test_absent_keys_never_match(spark, engine):
    engine.table("l", json_lines.parse(lines(spark, '{"v": "absent"}', '{"key": null, "v": "null"}', '{"key": "k", "v": "there"}')))
    engine.table("r", json_lines.parse(lines(spark, '{"key": null, "w": 8}', '{"w": 9}', '{"key": "k", "w": 7}')))
    assert rows(engine.sql("select v, w from l join r on l.key = r.key")) == [("there", 7)]


def test_null_and_missing(spark, engine):
    engine.table("t", json_lines.parse(lines(spark, '{"i": 1, "a": null}', '{"i": 2}', '{"i": 3, "a": {"b": [7, null]}}')))
    found = rows(engine.sql("select i, a is null as n, a is missing as m, a.b[0] as v, a.b[1] is null as w, a.b[9] is missing as x, nope is missing as y from t"))
    assert found == [(1, True, False, None, False, True, True), (2, False, True, None, False, True, True), (3, False, False, 7, True, True, True)]
    assert rows(engine.sql("select i from t where nope = 1 or not (nope = 1)")) == []
    assert rows(engine.sql("select coalesce(missing, null, i) as c from t")) == [(1,), (2,), (3,)]


def test_names_differ_by_case(spark, engine):
    engine.table("t", json_lines.parse(lines(spark, '{"a": 1, "A": 2}', '{"a": 3}')))
    assert rows(engine.sql("select a + 1 as x, A as y, A is missing as m from t")) == [(2, 2, False), (4, None, True)]


def test_literals_of_different_types(spark, engine):
    engine.table("t", spark.createDataFrame([(1, True), (0, False)], "i int, b boolean"))
    assert rows(engine.sql("select i = 1 as x, count(*) as n from t group by i = 1")) == [(False, 1), (True, 1)]
    assert rows(engine.sql("select b = true as x, 1 as y, 1.0 as z, true as w from t where i = 1")) == [(True, 1, 1.0, True)]


def test_padding_is_null_not_missing(orchard):
    assert rows(orchard.sql("select kind, kilos is null as n, kilos is missing as m from trees left join picked on trees.no = picked.tree where no = 20")) == [("medlar", True, False)]


def test_wildcards_and_unnest(spark, engine):
    engine.table("t", json_lines.parse(lines(spark, '{"d": [{"k": 1}, {"k": 2}], "e": {"p": 5, "q": 6}}', '{"d": [], "e": {"p": 7, "q": 8}}')))
    assert rows(engine.sql("select d[*].k as ks, e.* as vs from t")) == [([1, 2], [5, 6]), ([], [7, 8])]
    assert rows(engine.sql("select x.k as k, i from t.d as x at i")) == [(1, 0), (2, 1)]
    assert rows(engine.sql("select v, i from t.e.p as v at i")) == [(5, None), (7, None)]
    with pytest.raises(AnalysisError):
        engine.sql("select 1 from t.d")


def test_three_valued_logic(spark, engine):
    engine.table("t", spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, b boolean"))
    assert rows(engine.sql("select i, b and true as x, b or true as y, not b as z from t")) == [(1, True, True, False), (2, False, True, True), (3, None, True, None)]
    assert rows(engine.sql("select i from t where i in (1, null)")) == [(1,)]
    assert rows(engine.sql("select i from t where i not in (1, null)")) == []


def test_names(spark, engine):
    engine.table("t", spark.createDataFrame([(1, 2)], "a int, b int"))
    assert engine.sql("select a + b, a, b as c, a as a from t").columns == ["_0", "a", "c"]
    assert engine.sql("select a, count(*), sum(b) as s from t group by a").columns == ["a", "_2", "s"]
    assert engine.sql("select value a + 1 from t").columns == ["_value"]
    assert engine.sql("select value [a, b + 1] from t").columns == ["a", "_1"]
    assert engine.sql("select *, a + 1 as d from t").columns == ["a", "b", "d"]


def test_arithmetic(spark, engine):
    engine.table("t", spark.createDataFrame([(7, 2, 0, 1.5)], "a int, b int, z int, f double"))
    found = engine.sql("select a / b as q, a / z as n, mod(a, z) as m, f / z as i, -a / b as s, round(-2.5) as r, bit_count(-1 * b) as k from t").first()
    assert tuple(found) == (3, None, None, float("inf"), -3, -3, 63)


def test_strings(spark, engine):
    engine.table("t", spark.createDataFrame([("a.b.c", "x_y%z\\")], "s string, p string"))
    found = engine.sql("""select split(s, '.') as a, substring(s, -3, 2) as b, split_part(s, '.', -1) as c, chr(8364) as d, codepoint('€') as e,
        p like 'x\\_y%' as f, p like '%\\' as g, hamming_distance('abc', 'abd') as h, regexp_extract(s, 'q') as i, trim("\t x \n") as j from t""").first()
    assert tuple(found) == (["a", "b", "c"], "a.", "", "€", 8364, False, True, 1, None, "x")


def test_urls(spark, engine):
    engine.table("t", spark.createDataFrame([("https://u:p@WWW.Ex.com:8443/a/b?q=1#f",), ("http://x.org:80",), ("nope",), (None,)], "u string"))
    found = [tuple(r) for r in engine.sql("select url_host(u) as h, url_port(u) as p, url_path(u) as q, url_query(u) as r, url_fragment(u) as f, url_path_bucket(u, 1, '*') as b from t").collect()]
    assert found == [("www.ex.com", 8443, "/a/b", "q=1", "f", "/a/*"), ("x.org", None, "/", None, None, "/"), (None,) * 6, (None,) * 6]


def test_percentiles_and_sequence(spark, engine):
    engine.table("t", spark.createDataFrame([(i, "b" if i % 2 else "a") for i in range(1, 11)], "v int, g string").coalesce(1))
    found = engine.sql("""select percentile_disc(0.5) within group (order by v asc) as a, percentile_disc(0.9) within group (order by v desc) as b,
        percentile_disc(1.0) within group (order by v asc) as c, percentile_disc(0.0) within group (order by v asc) as d, first(v) as e, last(v) as f from t""").first()
    assert tuple(found) == (6, 1, 10, 1, 1, 10)


def test_percentiles_of_texts(spark, engine):
    """By group, null keys and all-null groups included, upward and downward, beside other aggregates; none gathers a group."""
    words = ["pear", "fig", "fig", "lime", None, "yam", "leek", "kale", "fig", "beet"]
    data = [(g, words[(7 * i + j) % 10]) for i, g in enumerate(["a", None, "b"]) for j in range(3 + 4 * i)] + [("none", None), ("none", None)]
    engine.table("t", spark.createDataFrame(data, "g string, w string"))
    for share in (0.0, 0.3, 0.5, 0.9, 1.0):
        for order in ("asc", "desc"):
            want = {}
            for g in {x for x, _ in data}:
                own = sorted((w for x, w in data if x == g and w is not None), reverse=order == "desc")
                want[g] = own[min(int(len(own) * share), len(own) - 1)] if own else None
            text = f"select g, percentile_disc({share}) within group (order by w {order}) as p, count(*) as n from t group by g"
            assert {r.g: r.p for r in engine.sql(text).collect()} == want
    every = sorted(w for _, w in data if w)
    found = engine.sql("select percentile_disc(0.5) within group (order by w asc) as p, percentile_disc(0.25) within group (order by w desc) as q from t")
    assert tuple(found.first()) == (every[len(every) // 2], every[::-1][len(every) // 4])
    assert rows(engine.sql("select percentile_disc(0.5) within group (order by w asc) as p from t where w = 'no'")) == [(None,)]
    middle = {g: sorted(w for x, w in data if x == g and w) for g in ("a", None, "b")}
    assert rows(engine.sql("select g from t group by g having percentile_disc(0.5) within group (order by w asc) = 'fig'")) == sorted(((g,) for g, own in middle.items() if own[len(own) // 2] == "fig"), key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_percentiles_of_large_groups(spark):
    """Sorting gives what counting gives, for numbers and times, nulls and repeats among them."""
    df = spark.range(300).selectExpr("id % 4 as g", "if(id % 7 = 0, null, cast(id * 37 % 50 as double) / 4) as x", "id * 13 % 40 as i", "timestamp_seconds(id * 17 % 60) as t")
    calls = ", ".join(f"percentile_disc({share}) within group (order by {c} {order}) as {c}{k}{order}" for c in "xit" for k, share in enumerate((0, 0.25, 0.9, 1)) for order in ("asc", "desc"))
    for text in (f"select g, count(*) as n, {calls} from t group by g", f"select {calls} from t"):
        few, many = (Engine(spark, large_groups=large).table("t", df).sql(text) for large in (False, True))
        assert rows(few) == rows(many) and few.dtypes == many.dtypes
        assert "percentile_disc" not in many._jdf.queryExecution().optimizedPlan().toString()


def test_first_and_last_follow_files_and_joins(spark, engine, tmp_path):
    """Files in order of their names, rows in theirs, through shuffles and joins."""
    for k in range(4):
        spark.range(k * 25_000, (k + 1) * 25_000).selectExpr("id", "id % 3 as g").coalesce(1).write.parquet(f"{tmp_path}/all/part={k}")
        (tmp_path / f"{k}.jsonl").write_text("\n".join(json.dumps({"n": 10 * k + i, "h": [k, i]}) for i in range(9 - 2 * k)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        engine.table("names", spark.createDataFrame([(g, x) for g in range(3) for x in "ba"], "g long, x string").coalesce(1))
        engine.source(f"rows:parquet={tmp_path}/all").source(f"it:jsonl={tmp_path}/*.jsonl")
        assert rows(engine.sql("select g, first(id) as f, last(id) as l from rows group by g")) == [(0, 0, 99_999), (1, 1, 99_997), (2, 2, 99_998)]
        assert rows(engine.sql("select r.g as g, first(id) as f, last(id) as l, first(n.x) as a, last(n.x) as z from rows r join names n on r.g = n.g group by r.g")) == [(0, 0, 99_999, "b", "a"), (1, 1, 99_997, "b", "a"), (2, 2, 99_998, "b", "a")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows(engine.sql("select first(n) as f, last(n) as l, count(*) as c from it where n > 0")) == [(1, 32, 23)]
    assert rows(engine.sql("select first(x) as f, last(x) as l from it.h as x")) == [(0, 2)]


def test_grouping(spark, engine):
    engine.table("t", spark.createDataFrame([("a", 1), ("a", None), ("b", 5), (None, 7)], "g string, v int"))
    assert rows(engine.sql("select g, count(*) as n, count(v) as c, sum(v) as s from t group by g")) == [("a", 2, 1, 1.0), ("b", 1, 1, 5.0), (None, 1, 1, 7.0)]
    assert rows(engine.sql("select upper(g) as u, max(v) + 1 as m from t group by g having sum(v) > 3 order by m desc")) == [("B", 6), (None, 8)]
    assert rows(engine.sql("select u from t group by upper(g) as u")) == [("A",), ("B",), (None,)]
    assert engine.sql("select g, rows from t where g = 'b' group by g group as rows").first()["rows"][0].asDict() == {"g": "b", "v": 5}
    with pytest.raises(EngineError):
        engine.sql("select sum(g) as s from t")
    with pytest.raises(EngineError):
        engine.sql("select g from t having g = 'a'")


def test_null_order(spark, engine):
    engine.table("t", spark.createDataFrame([(2,), (None,), (1,)], "v int"))
    assert [r[0] for r in engine.sql("select v from t order by v asc").collect()] == [1, 2, None]
    assert [r[0] for r in engine.sql("select v from t order by v desc").collect()] == [None, 2, 1]


def test_set_operations(spark, engine):
    engine.table("a", spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int"))
    engine.table("b", spark.createDataFrame([(1,), (None,)], "k int"))
    assert rows(engine.sql("select k from a intersect select k from b")) == [(1,), (None,)]
    assert rows(engine.sql("select k from a except select k from b")) == [(2,)]
    assert rows(engine.sql("select k from a except all select k from b")) == [(1,), (2,)]
    assert rows(engine.sql("select k from a union select k as j from b")) == [(1,), (2,), (None,)]
    assert engine.sql("select k from a union all select k, 1 as z from b").columns == ["k", "z"]


def test_subqueries(spark, engine):
    engine.table("a", spark.createDataFrame([(1, 5), (2, 6)], "k int, v int"))
    engine.table("b", spark.createDataFrame([(1, 10), (1, 30)], "k int, w int"))
    assert rows(engine.sql("select k, (select max(w) from b where b.k = a.k) as m from a")) == [(1, 30), (2, None)]
    assert rows(engine.sql("select k from a where v > (select min(w) - 5 from b)")) == [(2,)]
    assert rows(engine.sql("select (select w from b order by w desc) as m from a where k = 1")) == [(30,)]


def test_errors(spark, engine):
    engine.table("t", spark.createDataFrame([(1,)], "a int"))
    for text in ("select b from t", "select nofun(a) from t", "select upper(a, a) from t", "select time_bucket('7 seconds', a) from t", "select percentile_disc(2.0) within group (order by a) from t", "select upper(*) from t"):
        with pytest.raises(AnalysisError):
            engine.sql(text)
    with pytest.raises(SourceError):
        engine.sql("select a from nowhere")
    with pytest.raises(SourceError):
        engine.table("t", spark.range(1))
    assert Engine(spark, strict=False).table("t", spark.createDataFrame([(1,)], "a int")).sql("select b is missing as m from t").first()[0] is True


def test_custom_functions(spark, engine):
    import pandas as pd
    from pyspark.sql import functions as F

    @F.pandas_udf("long")
    def plus_one(s: pd.Series) -> pd.Series:
        return s + 1

    engine.table("t", spark.createDataFrame([(1,)], "a long")).function("PlusOne", plus_one, 1)
    assert engine.sql("select plusone(a) as b from t").first()[0] == 2
    with pytest.raises(AnalysisError):
        engine.function("UPPER", lambda c: c, 1)


def test_elb_lines(spark):
    line = '2033-01-09T22:10:31.000420Z front 198.51.100.4:40400 - 0.5 0.75 slow 302 200 81 92 "HEAD https://lake.test/boats?row=2 HTTP/1.0" "oar 3" - -'
    found = logs.parse(lines(spark, line, "", "junk"), "elb").collect()
    assert len(found) == 2
    r = found[0]
    assert r.timestamp == datetime.datetime(2033, 1, 9, 22, 10, 31, 420)
    assert r.client_and_port.asDict() == {"hostname": "198.51.100.4", "port": 40400} and r.backend_and_port is None
    assert (r.backend_processing_time, r.response_processing_time, r.sent_bytes, r.user_agent, r.ssl_cipher, r.trace_id) == (0.75, None, 92, "oar 3", "-", None)
    assert r.request.asDict() == {"http_method": "HEAD", "url": "https://lake.test/boats?row=2", "http_version": "HTTP/1.0", "raw": "HEAD https://lake.test/boats?row=2 HTTP/1.0"}
    with pytest.raises(Exception, match="response_processing_time"):
        logs.parse(lines(spark, line), "elb", mode="FAILFAST").collect()
    assert [len(logs.fields(f)) for f in ("elb", "alb", "s3", "squid")] == [17, 25, 24, 10]


def test_tokens_of_lines(spark):
    """Marks go, one at either end; open marks reach to the line's end; hosts and requests that
    are none are null; what lies beyond the last field is left out."""
    found = logs.parse(lines(spark, """ 'a b'  "c d" [e f] "" x"y 1.5 '2' [3] q "r s""", "a\tb", "1 2 3 4 5 6 7 8 9 10 11 12", '"open', "[]"), "squid").collect()
    assert tuple(found[0]) == ("a b", "c d", "e f", "", 'x"y', "1.5", "2", "3", "q", "r s")
    assert tuple(found[1])[:3] == ("a", "b", None) and found[2].type == "10" and found[3].timestamp == "open" and found[4].timestamp == ""
    odd = ["1.2.3.4:", ":80", "h:70000", "h:-1", "h", "a:b:9", "h:12x", "-"]
    hosts = [r.c for r in logs.parse(lines(spark, *(f"2033-01-09T22:10:31Z f {x} - 1 1 1 200 200 1 1 - -" for x in odd)), "elb").selectExpr("client_and_port as c").collect()]
    assert [h and tuple(h) for h in hosts] == [None, ("", 80), None, None, None, ("a:b", 9), None, None]
    odd = ["GET /a HTTP/1.1", "GET  /a HTTP/1.1", "get /a HTTP/1.1", "GET /a", "GET /a HTTP/3", "POST /a b HTTP/1.1", "PATCH x HTTP/2.0", "-"]
    urls = [r.request and r.request.url for r in logs.parse(lines(spark, *(f'2033-01-09T22:10:31Z f - - 1 1 1 200 200 1 1 "{x}" -' for x in odd)), "elb").collect()]
    assert urls == ["/a", None, None, None, None, None, "x", None]


def test_s3_and_squid_lines(spark):
    s3 = 'keeper shelf [09/Jan/2033:22:10:31 +0000] 198.51.100.4 someone 77AA REST.PUT.OBJECT box/1 "PUT /shelf/box HTTP/1.1" 204 - 5 6 7 8 "-" "hand/2" - abc= SigV4 ECDHE Q shelf.test TLSv1.3'
    r = logs.parse(lines(spark, s3), "s3").first()
    assert (r.time, r.request_uri, r.key, r.tls_version) == ("09/Jan/2033:22:10:31 +0000", "PUT /shelf/box HTTP/1.1", "box/1", "TLSv1.3")
    r = logs.parse(lines(spark, "1988888888.001    250 198.51.100.7 TCP_REFRESH/304 77 POST lake.test:8080 - DIRECT/192.0.2.9 -"), "squid").first()
    assert (r.elapsed, r.url, r.type) == ("250", "lake.test:8080", "-")


def test_sources_and_cli(spark, tmp_path, capsys):
    (tmp_path / "t.jsonl").write_text('{"a": 1, "b": [1], "c": null}\n{"a": 2, "e": {"f": 1}}\n')
    out = io.StringIO()
    assert main(["query", "select a, b, c, e from it order by a", "--table", f"it:jsonl={tmp_path}/t.jsonl", "--output", "json"], out) == 0
    assert json.loads(out.getvalue()) == [{"a": 1, "b": [1], "c": None, "e": None}, {"a": 2, "b": None, "c": None, "e": {"f": 1}}]
    out = io.StringIO()
    assert main(["query", "select a, b, e from it order by a", "--table", f"it:jsonl={tmp_path}/t.jsonl", "--output", "csv"], out) == 0
    assert out.getvalue() == "1,[...],<null>\n2,<null>,{...}\n"
    assert main(["query", "select a from", "--table", f"it:jsonl={tmp_path}/t.jsonl"], out) == 1
    assert main(["query", "select a from it", "--table", "it:what=x"], out) == 1
    out = io.StringIO()
    assert main(["schema", "squid"], out) == 0 and "code_and_status" in out.getvalue()
    assert main(["schema", "nope"], out) == 1
    out = io.StringIO()
    assert main(["explain", "select a from it where a > 1", "--table", f"it:jsonl={tmp_path}/t.jsonl"], out) == 0 and "Physical Plan" in out.getvalue()


def test_json_schema(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"a": 1, "b": "x"}\n{"b": null}\n')
    engine = Engine(spark).source(f"t:jsonl={tmp_path}/t.jsonl", schema="a long, b string, c double")
    assert rows(engine.sql("select a, a is missing as m, b is null as n, c is missing as k from t")) == [(1, False, False, True), (None, True, True, True)]


def test_stdin(spark, engine):
    engine.tables.add_spec("it:squid=stdin", stdin=io.StringIO("1 2 h c 5 GET u - p t\n"))
    assert engine.sql("select bytes from it").first()[0] == "5"


def test_grid():
    assert list(sinks.grid(iter([["a", "long\ntwo"], ["bcd", "é"]]))) == ["+-----+------+", "| a   | long |", "|     | two  |", "+-----+------+", "| bcd | é    |", "+-----+------+"]
    assert list(sinks.grid([])) == []


def test_shared_folder_off_one_machine(spark):
    class Elsewhere:
        conf = type("", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("", (), {"master": "spark://somewhere:7077"})

    with pytest.raises(EngineError):
        shared_folder(Elsewhere)
    Elsewhere.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(EngineError):
        shared_folder(Elsewhere)
    assert shared_folder(spark) == shared_folder(spark)


def test_write(spark, tmp_path):
    sinks.write(spark.createDataFrame([(1, None)], "a int, b string"), "csv", f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ["1,<null>"]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id as a", "id * 2 as b", "id as c").write.parquet(f"{tmp_path}/p")
    plan = Engine(spark).source(f"t:parquet={tmp_path}/p").explain("select a from t where b > 3")
    assert "GreaterThan(b,3)" in plan and "struct<a:bigint,b:bigint>" in plan

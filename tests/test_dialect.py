"""The dialect clause by clause, over JSON lines of a harbour and its gate's access logs."""

import pytest

from stratalog.engine import Engine
from stratalog.sources import json_lines, logs

SHIPS = [
    '{"ship": "Petrel", "flag": "NO", "tons": 900, "crew": 7, "pilot": null, "holds": [40, 60], "berth": {"pier": {"no": 3}, "depth": 5.5}}',
    '{"ship": "Heron", "flag": "IS", "tons": 1200, "crew": 9, "pilot": "Una", "holds": [40], "berth": {"pier": {"no": 1}, "depth": 7.25}}',
    '{"ship": "Gannet", "flag": "NO", "tons": 300, "crew": 3, "holds": [], "berth": {"pier": {"no": 3}, "depth": 4.0}}',
    '{"ship": "Dunlin", "flag": "FO", "tons": 640, "crew": 5, "pilot": "Tor", "holds": [10, 20, 30]}',
]
CALLS = ['{"ship": "Heron", "port": "Vik"}', '{"ship": "Heron", "port": "Hofn"}', '{"ship": "Petrel", "port": "Vik"}', '{"ship": "Skua", "port": "Tvor"}', '{"port": "Runa"}']


def gate(k):
    """A load balancer's line of minute k."""
    took, code, path = k / 4, 503 if k % 3 == 0 else 204, ("quay/list" if k % 2 else "tide/now/full")
    return f'2031-11-02T03:{k:02}:09.250000Z gate 192.0.2.{k}:{41000 + k} 203.0.113.9:9090 0.001 {took} 0.002 {code} {code} {k * 10} {k * 100} "PUT https://harbour.test:8443/{path}?day={k}#top HTTP/2.0" "buoy/{k % 2}" - TLSv1.3'


def proxied(k):
    """A proxy's line."""
    return f"1950000{k}.250 {k} deck{k % 3} TCP_{'HIT' if k % 4 else 'MISS'}/200 {k * 7} {'PUT' if k > 5 else 'HEAD'} https://tide.test/{k} - DIRECT/192.0.2.1 image/webp"


@pytest.fixture(scope="module")
def engine(spark):
    lines = lambda texts: spark.createDataFrame([(x,) for x in texts], "value string").coalesce(1)
    out = Engine(spark)
    out.table("ships", json_lines.parse(lines(SHIPS))).table("calls", json_lines.parse(lines(CALLS)))
    out.table("gate", logs.parse(lines(map(gate, range(1, 13))), "elb")).table("proxy", logs.parse(lines(map(proxied, range(8))), "squid"))
    return out


def found(engine, text):
    plain = lambda v: v.strftime("%H:%M") if hasattr(v, "strftime") else v
    return [tuple(map(plain, r)) for r in engine.sql(text).collect()]


@pytest.mark.parametrize(
    "clause,want",
    [
        ("tons >= 640 and crew < 9", ["Dunlin", "Petrel"]),
        ("flag = 'IS' or tons < 500", ["Gannet", "Heron"]),
        ("not (flag = 'NO')", ["Dunlin", "Heron"]),
        ("ship like 'G_nn%'", ["Gannet"]),
        ("ship not like '%n%'", ["Petrel"]),
        ("tons between 300 and 900", ["Dunlin", "Gannet", "Petrel"]),
        ("crew not between 4 and 8", ["Gannet", "Heron"]),
        ("flag in ('FO', 'IS')", ["Dunlin", "Heron"]),
        ("crew not in (3, 5, 7)", ["Heron"]),
        ("pilot is null", ["Petrel"]),
        ("pilot is missing", ["Gannet"]),
        ("pilot is not null and pilot is not missing", ["Dunlin", "Heron"]),
        ("berth.pier.no = 3", ["Gannet", "Petrel"]),
        ("holds[1] > 15", ["Dunlin", "Petrel"]),
        ("cardinality(holds) = 0", ["Gannet"]),
        ("tons = (select max(tons) from ships)", ["Heron"]),
        ("crew * 100 > tons", []),
        ("pilot || '!' = 'Tor!'", ["Dunlin"]),
    ],
)
def test_where(engine, clause, want):
    assert found(engine, f"select ship from ships where {clause} order by ship asc") == [(x,) for x in want]


@pytest.mark.parametrize(
    "item,want",
    [
        ("holds[0]", {"Petrel": 40, "Heron": 40, "Gannet": None, "Dunlin": 10}),
        ("holds[*]", {"Petrel": [40, 60], "Heron": [40], "Gannet": [], "Dunlin": [10, 20, 30]}),
        ("berth.pier.*", {"Petrel": [3], "Heron": [1], "Gannet": [3], "Dunlin": None}),
        ("coalesce(pilot, 'none aboard')", {"Petrel": "none aboard", "Heron": "Una", "Gannet": "none aboard", "Dunlin": "Tor"}),
        ("nullif(flag, 'NO')", {"Petrel": None, "Heron": "IS", "Gannet": None, "Dunlin": "FO"}),
        ("case when tons > 1000 then 'large' when tons > 500 then 'middling' else 'small' end", {"Petrel": "middling", "Heron": "large", "Gannet": "small", "Dunlin": "middling"}),
        ("case when crew = 9 then 'full' end", {"Petrel": None, "Heron": "full", "Gannet": None, "Dunlin": None}),
        ("cast(crew as varchar) || '/' || flag", {"Petrel": "7/NO", "Heron": "9/IS", "Gannet": "3/NO", "Dunlin": "5/FO"}),
        ("tons / 7 - crew", {"Petrel": 121, "Heron": 162, "Gannet": 39, "Dunlin": 86}),
        ("substring(ship from 2 for 3)", {"Petrel": "etr", "Heron": "ero", "Gannet": "ann", "Dunlin": "unl"}),
        ("trim(leading 'P' from ship) || trim(both 'n' from ship)", {"Petrel": "etrelPetrel", "Heron": "HeronHero", "Gannet": "GannetGannet", "Dunlin": "DunlinDunli"}),
        ("(select count(*) from calls)", dict.fromkeys(("Petrel", "Heron", "Gannet", "Dunlin"), 5)),
        ("(select count(*) from calls where calls.ship = ships.ship)", {"Petrel": 1, "Heron": 2, "Gannet": 0, "Dunlin": 0}),
    ],
)
def test_items(engine, item, want):
    assert dict(found(engine, f"select ship, {item} as x from ships")) == want


@pytest.mark.parametrize(
    "text,want",
    [
        # keys, aggregates, HAVING
        ("select flag, count(*) as n, sum(tons) as t, max(crew) as c from ships group by flag order by flag asc", [("FO", 1, 640.0, 5), ("IS", 1, 1200.0, 9), ("NO", 2, 1200.0, 7)]),
        ("select count(pilot) as p, count(*) as n, avg(crew) as a, min(ship) as m from ships", [(2, 4, 6.0, "Dunlin")]),
        ("select deep, count(*) as n from ships group by berth.depth > 5 as deep order by n desc, deep asc", [(True, 2), (False, 1), (None, 1)]),
        ("select flag from ships group by flag having sum(crew) > 8 order by flag asc", [("IS",), ("NO",)]),
        ("select first(ship) as f, last(ship) as l from ships", [("Petrel", "Dunlin")]),
        ("select percentile_disc(0.5) within group (order by tons asc) as a, percentile_disc(0.5) within group (order by tons desc) as d from ships", [(900, 640)]),
        # DISTINCT, order, LIMIT
        ("select distinct flag from ships order by flag desc", [("NO",), ("IS",), ("FO",)]),
        ("SELECT ship FROM ships ORDER BY flag ASC, tons DESC LIMIT 3", [("Dunlin",), ("Heron",), ("Petrel",)]),
        ("select pilot from ships order by pilot asc limit 2", [("Tor",), ("Una",)]),
        # joins
        ("select s.ship as s, c.port as p from ships as s, calls as c where s.ship = c.ship order by p asc, s asc", [("Heron", "Hofn"), ("Heron", "Vik"), ("Petrel", "Vik")]),
        ("select s.ship as s, c.port as p from ships as s left join calls as c on s.ship = c.ship and c.port != 'Vik' order by s asc", [("Dunlin", None), ("Gannet", None), ("Heron", "Hofn"), ("Petrel", None)]),
        ("select s.tons as t, c.port as p from ships as s right outer join calls as c on s.ship = c.ship where s.tons is null order by p asc", [(None, "Runa"), (None, "Tvor")]),
        ("select a.ship as x, b.ship as y from ships as a inner join ships as b on a.flag = b.flag and a.tons < b.tons", [("Gannet", "Petrel")]),
        ("select count(*) as n from ships cross join calls", [(20,)]),
        # arrays as tables
        ("select h, i from ships.holds as h at i where h > 25 order by h asc, i asc", [(30, 2), (40, 0), (40, 0), (60, 1)]),
        ("select sum(h) as t from ships.holds as h", [(200.0,)]),
        # set operations, from left to right
        ("select ship from ships intersect select ship from calls order by ship asc", [("Heron",), ("Petrel",)]),
        ("select ship from calls where ship is not missing except select ship from ships", [("Skua",)]),
        ("select flag from ships where tons > 600 union all select flag from ships where crew > 8 except all select flag from ships where flag = 'NO'", [("FO",), ("IS",), ("IS",)]),
        # values
        ("select value crew + 1 from ships where ship = 'Heron'", [(10,)]),
        ("select value {'s': ship, 'heavy': tons > 800} from ships where flag = 'NO' order by s asc", [("Gannet", False), ("Petrel", True)]),
        ("select value [crew, tons] from ships where flag = 'IS'", [(9, 1200)]),
        # load balancer's log
        ("select t, count(*) as n, max(backend_processing_time) as m from gate group by time_bucket('5 minutes', timestamp) as t order by t asc", [("03:00", 4, 1.0), ("03:05", 5, 2.25), ("03:10", 3, 3.0)]),
        ("select elb_status_code as c, sum(sent_bytes) as s, count(*) as n from gate group by elb_status_code having count(*) > 4", [("204", 4800.0, 8)]),
        ("select url_path_bucket(request, 1, '*') as b, url_port(request) as p, url_fragment(request) as f, count(*) as n from gate group by url_path_bucket(request, 1, '*'), url_port(request), url_fragment(request) order by b asc", [("/quay/*", 8443, "top", 6), ("/tide/*/full", 8443, "top", 6)]),
        ("select host_name(client_and_port) as h, host_port(backend_and_port) as p, url_query(request) as q from gate where received_bytes = 70", [("192.0.2.7", 9090, "day=7")]),
        ("select typeof(request) as r, typeof(client_and_port) as c, typeof(timestamp) as t, typeof(received_bytes) as b, typeof(trace_id) as i from gate limit 1", [("http_request", "host", "datetime", "integer", "null")]),
        ("select approx_percentile(0.5) within group (order by backend_processing_time asc) between 1.25 and 1.75 as near from gate where user_agent like 'buoy%'", [(True,)]),
        # proxy's log
        ("select method, count(*) as n from proxy where code_and_status like 'TCP_HIT%' group by method order by method asc", [("HEAD", 4), ("PUT", 2)]),
        ("select approx_count_distinct(remote_host) as h, first(bytes) as f, last(bytes) as l from proxy where url like '%tide%'", [(3, "0", "49")]),
    ],
)
def test_query(engine, text, want):
    order = (lambda x: x) if "order by" in text.lower() or len(want) == 1 else lambda x: sorted(x, key=str)
    assert order(found(engine, text)) == order(want)

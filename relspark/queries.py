"""Queries over the driver's tables: a program each, and the same in DuckDB's SQL. All run over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from relspark.datalog.planner import run as run_datalog
from relspark.session import Session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def named(name: str, sql: str):
    """Register a query written in Python."""

    def keep(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return keep


def scratch(spark: SparkSession, name: str) -> str:
    """A path that no other run uses, in the folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def script(name: str, program: str, sql: str | None = None, out: str = "out") -> None:
    """Register a program whose variable ``out`` is the result."""
    QUERIES[name] = lambda spark, sf_dir: Session(spark, root=sf_dir, seed=1).query(program, out)
    if sql:
        ORACLE_SQL[name] = sql


def datalog(name: str, program: str, head: str, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run_datalog(Session(spark, root=sf_dir), program)[head]
    if sql:
        ORACLE_SQL[name] = sql


script("scan_project", "o = scan(orders); out = [from o emit o_orderkey, o_totalprice * 1.1 as gross, o_orderstatus];",
       "SELECT o_orderkey, o_totalprice * 1.1::DOUBLE AS gross, o_orderstatus FROM orders")
script("project_set", "l = scan(lineitem); out = distinct([from l emit l_returnflag, l_linestatus]);",
       "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
script("filter_pred", "l = scan(lineitem); out = [from l where l_quantity >= 10 and l_quantity < 20.5 and not (l_returnflag = 'R' or l_linestatus <> 'O') emit l_orderkey, l_linenumber];",
       "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20.5 AND NOT (l_returnflag = 'R' OR l_linestatus <> 'O')")
script("filter_like", "p = scan(part); out = [from p where p_name like '%l_e %o%' emit p_partkey, p_name];",
       "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%l_e %o%'")
script("join_equi", """c = scan(customer); o = scan(orders); l = scan(lineitem);
    out = [from c, o, l where c.c_custkey = o.o_custkey and o.o_orderkey = l.l_orderkey emit c_mktsegment, sum(l_quantity) as qty, count(*) as n];""",
       "SELECT c_mktsegment, sum(l_quantity) AS qty, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_mktsegment")
script("join_function", "o = scan(orders); c = scan(customer); j = join(o, o_custkey, c, c_custkey); out = [from j emit o_orderkey, c_name, $1];",
       "SELECT o_orderkey, c_name, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey")
script("join_multiway", """r = scan(region); n = scan(nation); s = scan(supplier); l = scan(lineitem);
    out = [from r, n, s, l where r_regionkey = n_regionkey and n_nationkey = s_nationkey and s_suppkey = l_suppkey emit r_name, n_name, count(*) as n_items];""",
       "SELECT r_name, n_name, count(*) AS n_items FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON n_nationkey = s_nationkey JOIN lineitem ON s_suppkey = l_suppkey GROUP BY ALL")
script("join_theta", "n = scan(nation); r = scan(region); out = [from n, r where n_nationkey > r_regionkey * 4 emit n_name, r_name];",
       "SELECT n_name, r_name FROM nation, region WHERE n_nationkey > r_regionkey * 4")
script("join_self", "s = scan(supplier); out = [from s as a, s as b where a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey emit a.s_suppkey as x, b.s_suppkey as y];",
       "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
script("cross_small", "n = scan(nation); r = scan(region); x = cross(n, r); out = [from x emit n_name, r_name];", "SELECT n_name, r_name FROM nation, region")
script("grid_match", """def cell(v): int(floor(v / 500)); s = scan(supplier); c = scan(customer);
    a = [from s emit s_suppkey, s_acctbal, cell(s_acctbal) as g]; b = [from c emit c_custkey, c_acctbal, cell(c_acctbal) as g];
    near = [from b emit c_custkey, c_acctbal, g - 1 as g] + [from b emit c_custkey, c_acctbal, g as g] + [from b emit c_custkey, c_acctbal, g + 1 as g];
    out = [from a, near where a.g = near.g and abs(s_acctbal - c_acctbal) < 50 emit s_suppkey, count(*) as n];""",
       "SELECT s_suppkey, count(*) AS n FROM supplier JOIN customer ON abs(s_acctbal - c_acctbal) < 50 GROUP BY s_suppkey")
script("agg_builtin", "l = scan(lineitem); out = [from l emit l_returnflag, count(*) as n, count(l_tax) as m, sum(l_linenumber) as s, min(l_quantity) as lo, max(l_quantity) as hi, avg(l_discount) as av];",
       "SELECT l_returnflag, count(*) AS n, count(l_tax) AS m, sum(l_linenumber)::BIGINT AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, avg(l_discount) AS av FROM lineitem GROUP BY l_returnflag")
script("agg_stdev", "c = scan(customer); out = [from c emit c_mktsegment, floor(stdev(c_acctbal) * 1000) as sd];",
       "SELECT c_mktsegment, floor(stddev_pop(c_acctbal) * 1000) AS sd FROM customer GROUP BY c_mktsegment")
script("agg_expr_hoist", "o = scan(orders); out = [from o emit o_orderstatus, max(o_totalprice) - min(o_totalprice) as spread, count(*) * 2 + 1 as k];",
       "SELECT o_orderstatus, max(o_totalprice) - min(o_totalprice) AS spread, count(*) * 2 + 1 AS k FROM orders GROUP BY o_orderstatus")
script("agg_empty", "o = scan(orders); e = [from o where o_orderkey < 0 emit *]; out = [from e emit count(o_custkey) as n, sum(o_custkey) as s];", "SELECT 0::BIGINT AS n, 0::BIGINT AS s")
script("agg_global", "l = scan(lineitem); out = [from l emit count(*) as n, sum(l_partkey) as s];", "SELECT count(*) AS n, sum(l_partkey)::BIGINT AS s FROM lineitem")
script("countall", "l = scan(lineitem); c = countall(l); out = [from c emit $0 as n];", "SELECT count(*) AS n FROM lineitem")
script("distinct", "o = scan(orders); out = select distinct o_custkey, o_orderstatus from o;", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
script("count_distinct", "o = scan(orders); d = distinct([from o emit o_custkey]); out = [from d emit count(*) as n];", "SELECT count(DISTINCT o_custkey) AS n FROM orders")
script("topk", "o = scan(orders); out = [from o emit o_orderkey, o_totalprice order by o_totalprice desc, o_orderkey asc limit 10];",
       "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
script("unionall", "s = scan(supplier); c = scan(customer); out = [from s emit s_nationkey as k] + [from c emit c_nationkey as k];",
       "SELECT s_nationkey::BIGINT AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer")
script("union_set", "s = scan(supplier); c = scan(customer); out = union([from s emit s_nationkey as k], [from c emit c_nationkey as k]);",
       "SELECT s_nationkey::BIGINT AS k FROM supplier UNION SELECT c_nationkey FROM customer")
script("intersect", "l = scan(lineitem); p = scan(part); out = intersect([from l emit l_partkey as k], [from p where p_size < 10 emit p_partkey as k]);",
       "SELECT l_partkey AS k FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size < 10")
script("diff", "p = scan(part); l = scan(lineitem); out = diff([from p emit p_partkey as k], [from l where l_quantity > 49 emit l_partkey as k]);",
       "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
script("math_fns", "c = scan(customer); out = [from c emit c_custkey, floor(c_acctbal) as f, ceil(c_acctbal) as g, abs(c_acctbal) as a, floor(1000 * sqrt(abs(c_acctbal))) as q, floor(100 * log(abs(c_acctbal) + 1)) as l, pow(c_nationkey, 2) as p, floor(1000 * (sin(c_custkey) + cos(c_custkey) + tan(c_nationkey))) as t];",
       "SELECT c_custkey, floor(c_acctbal) AS f, ceil(c_acctbal) AS g, abs(c_acctbal) AS a, floor(1000 * sqrt(abs(c_acctbal))) AS q, floor(100 * ln(abs(c_acctbal) + 1)) AS l, pow(c_nationkey, 2)::DOUBLE AS p, floor(1000 * (sin(c_custkey) + cos(c_custkey) + tan(c_nationkey))) AS t FROM customer")
script("int_div_mod", "l = scan(lineitem); out = [from l emit l_orderkey, l_linenumber, (l_partkey - 1000) // 7 as q, (l_partkey - 1000) % 7 as r, (1000 - l_partkey) // -7 as q2, (l_partkey - 1000) % -7 as r2];",
       "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, floor((l_partkey - 1000) / 7)::BIGINT AS q, (((l_partkey - 1000) % 7 + 7) % 7)::BIGINT AS r, floor((1000 - l_partkey) / -7)::BIGINT AS q2, (((l_partkey - 1000) % -7 - 7) % -7)::BIGINT AS r2 FROM lineitem")
script("string_fns", "p = scan(part); out = [from p emit p_partkey, len(p_name) as n, substr(p_name, 1, 4) as s, head(p_name, 3) as h, tail(p_name, 3) as t, concat(p_brand, p_type) as c];",
       "SELECT p_partkey, length(p_name) AS n, substring(p_name, 2, 3) AS s, left(p_name, 3) AS h, right(p_name, 3) AS t, p_brand || p_type AS c FROM part")
script("md5_long", "p = scan(part); out = [from p emit p_partkey, md5(p_name) as m];",
       "SELECT p_partkey, CASE WHEN u >= 9223372036854775808 THEN (u - 18446744073709551616)::BIGINT ELSE u::BIGINT END AS m FROM (SELECT p_partkey, ('0x' || substr(md5(p_name), 1, 16))::UBIGINT::HUGEINT AS u FROM part)")
script("date_parts", "o = scan(orders); out = [from o emit o_orderkey, year(string(o_orderdate)) as y, month(string(o_orderdate)) as m, day(string(o_orderdate)) as d];",
       "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders")
script("case_expr", "c = scan(customer); out = [from c emit c_custkey, case when c_acctbal < 0 then 'debt' when c_acctbal < 5000 then 'mid' else 'rich' end as k];",
       "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'rich' END AS k FROM customer")
script("casts", "c = scan(customer); out = [from c emit c_custkey, int(c_acctbal) as i, float(c_nationkey) as f, string(c_nationkey) as s, boolean(c_nationkey) as b];",
       "SELECT c_custkey, trunc(c_acctbal)::BIGINT AS i, c_nationkey::DOUBLE AS f, c_nationkey::VARCHAR AS s, c_nationkey <> 0 AS b FROM customer")
script("safe_div", "c = scan(customer); out = [from c emit c_custkey, safediv(c_acctbal, c_nationkey) as a, safediv(c_acctbal, c_nationkey, -1) as b];",
       "SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN 0.0 ELSE c_acctbal / c_nationkey END::DOUBLE AS a, CASE WHEN c_nationkey = 0 THEN -1.0 ELSE c_acctbal / c_nationkey END::DOUBLE AS b FROM customer")
script("least_greatest", "l = scan(lineitem); out = [from l emit l_orderkey, l_linenumber, least(l_partkey, l_suppkey, 100) as a, greatest(l_partkey, l_suppkey) as b, lesser(l_tax, l_discount) as c];",
       "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, least(l_partkey, l_suppkey, 100) AS a, greatest(l_partkey, l_suppkey) AS b, least(l_tax, l_discount) AS c FROM lineitem")
script("unbox", "o = scan(orders); m = [from o emit avg(o_totalprice) as a]; out = [from o where o_totalprice * 2 > *m * 3 emit o_orderkey, o_totalprice > *m.a as above];",
       "SELECT o_orderkey, true AS above FROM orders WHERE o_totalprice * 2 > (SELECT avg(o_totalprice) FROM orders) * 3")
script("table_literal", "out = [1 as a, 'x' as b, 2.5 as c, true as d];", "SELECT 1::BIGINT AS a, 'x' AS b, 2.5::DOUBLE AS c, true AS d")
script("empty_relation", "out = empty(a:int, b:string);", "SELECT 1::BIGINT AS a, 'x' AS b WHERE false")
script("udf_inline", "const rate: 0.9; def net(p, d): p * (1 - d); def both(p, d): [net(p, d), net(p, d) * rate]; l = scan(lineitem); out = [from l emit l_orderkey, l_linenumber, both(l_extendedprice, l_discount) as [n, r]];",
       "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice * (1 - l_discount) AS n, l_extendedprice * (1 - l_discount) * 0.9::DOUBLE AS r FROM lineitem")
script("uda_argmax", """uda argmax(id, v) {[-1 as best, -1000000.0 as top]; [case when v > top then id else best end, case when v > top then v else top end]; [best, top];};
    o = scan(orders); out = [from o emit o_custkey, argmax(o_orderkey, o_totalprice) as [k, p]];""",
       "SELECT o_custkey, k, p FROM (SELECT o_custkey, o_orderkey AS k, o_totalprice AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
script("uda_native", "uda stats(x) {[0 as s, 0 as c, 0 as hi]; [s + x, c + 1, greatest(hi, x)]; [s, c, hi];}; l = scan(lineitem); out = [from l emit l_suppkey, stats(l_linenumber) as [s, c, hi]];",
       "SELECT l_suppkey, sum(l_linenumber)::BIGINT AS s, count(*) AS c, max(l_linenumber)::BIGINT AS hi FROM lineitem GROUP BY l_suppkey")
script("uda_decomposable", """uda whole(x) {[0 as s, 0 as c]; [s + x, c + 1]; [s, c];}; uda part_(x) {[0 as s, 0 as c]; [case when x > 0 then s + x else s + x end, c + 1]; [s, c];};
    uda all_(s, c) {[0 as ss, 0 as cc]; [ss + s, cc + c]; [ss, cc];}; uda* whole {part_, all_}; l = scan(lineitem); out = [from l emit l_returnflag, whole(l_linenumber) as [s, c]];""",
       "SELECT l_returnflag, sum(l_linenumber)::BIGINT AS s, count(*) AS c FROM lineitem GROUP BY l_returnflag")
script("running_sum", "apply run(x) {[0 as s, 0 as c]; [s + x, c + 1]; [s, c];}; o = scan(orders); p = [from o emit o_orderkey, o_custkey]; out = [from p emit o_orderkey, run(o_custkey) as [s, c]];",
       "SELECT o_orderkey, (sum(o_custkey) OVER w)::BIGINT AS s, count(*) OVER w AS c FROM orders WINDOW w AS (ORDER BY o_orderkey, o_custkey ROWS UNBOUNDED PRECEDING)")
script("flatmap_split", "p = scan(part); out = [from p emit p_partkey, split(p_type, ' ') as w];", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w FROM part")
script("flatmap_ngram", "n = scan(nation); out = [from n emit n_nationkey, ngram(n_name, 2) as g];",
       "SELECT n_nationkey::BIGINT AS n_nationkey, substring(n_name, i::INT, 2) AS g FROM (SELECT n_nationkey, n_name, unnest(range(1, length(n_name))) AS i FROM nation)")
script("flatmap_sequence", "n = scan(nation); out = [from n emit n_nationkey, sequence(n_regionkey) as i];",
       "SELECT n_nationkey::BIGINT AS n_nationkey, unnest(range(n_regionkey)) AS i FROM nation")
script("dowhile_pow2", "x = [1 as val, 0 as exp]; do x = [from x emit val * 2 as val, exp + 1 as exp]; while [from x emit max(val) < 32]; out = [from x emit val, exp];", "SELECT 32::BIGINT AS val, 5::BIGINT AS exp")

# Who buys from whom, over all orders and lines; a supplier's key may be a customer's, too.
_TRADE = "l = scan(lineitem); o = scan(orders); Trade = distinct([from o, l where o_orderkey = l_orderkey emit o_custkey as buyer, l_suppkey as seller]);"
_TRADE_SQL = "trade AS (SELECT DISTINCT o_custkey AS buyer, l_suppkey AS seller FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
script("reachable", _TRADE + " do Met = [who] <- [1 as who] + [from Met, Trade where Met.who = Trade.buyer emit Trade.seller as who]; until convergence; out = Met;",
       f"WITH RECURSIVE {_TRADE_SQL}, met(who) AS (SELECT 1::BIGINT UNION SELECT seller FROM met JOIN trade ON who = buyer) SELECT who FROM met")
# Level by level, with the level at which each was met.
script("reachable_levels", _TRADE + """ Met = [1 as who, 0 as level]; Edge = Met;
    do Next = distinct([from Edge, Trade where Trade.buyer = Edge.who emit Trade.seller as who, Edge.level + 1 as level]); Seen = [from Met emit who];
       Known = [from Next, Seen where Next.who = Seen.who emit Next.who as who, Next.level as level]; Edge = diff(Next, Known); Met = Met + Edge; while [from Edge emit count(*) > 0]; out = Met;""",
       f"WITH RECURSIVE {_TRADE_SQL}, w(who, level) AS (SELECT 1::BIGINT, 0::BIGINT UNION SELECT seller, level + 1 FROM w JOIN trade ON who = buyer WHERE level < 60) SELECT who, min(level) AS level FROM w GROUP BY who")
# Components of the graph of buyers (even numbers) and sellers (odd ones). The SQL hands the least number on as often as the longest way asks, and then some.
_STEP_SQL = "c{i} AS (SELECT v, min(c) AS c FROM (SELECT v, c FROM c{h} UNION ALL SELECT y, c FROM c{h} JOIN both_ ON v = x) GROUP BY v)"
script("connected_components", _TRADE + """ Out = [from Trade emit buyer * 2 as x, seller * 2 + 1 as y]; Both = Out + [from Out emit y as x, x as y];
    do C = [v, min(c) as c] <- [from Both emit x as v, x as c] + [from C, Both where C.v = Both.x emit Both.y as v, C.c as c]; until convergence sync; out = C;""",
       f"WITH {_TRADE_SQL}, out_ AS (SELECT buyer * 2 AS x, seller * 2 + 1 AS y FROM trade), both_ AS (SELECT x, y FROM out_ UNION ALL SELECT y, x FROM out_), c0 AS (SELECT x AS v, min(x) AS c FROM both_ GROUP BY x), " + ", ".join(_STEP_SQL.format(i=i, h=i - 1) for i in range(1, 25)) + " SELECT v, c FROM c24")
# Chains of suppliers seven apart, to their ends.
_LINKS = "s = scan(supplier); Link = [from s as a, s as b where b.s_suppkey = a.s_suppkey + 7 emit a.s_suppkey as x, b.s_suppkey as y];"
_LINKS_SQL = "links AS (SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 7)"
script("transitive_closure", _LINKS + " do P = [x, y] <- Link + [from P, Link where P.y = Link.x emit P.x as x, Link.y as y]; until convergence; out = P;",
       f"WITH RECURSIVE {_LINKS_SQL}, r(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, links.y FROM r JOIN links ON r.y = links.x) SELECT x, y FROM r")
script("recursive_count", _LINKS + " do Seen = [v, count(*) as n] <- [from Link emit x as v] + [from Seen, Link where Seen.n >= 1 and Seen.v = Link.x emit Link.y as v]; until convergence; out = Seen;",
       f"WITH RECURSIVE {_LINKS_SQL}, t AS (SELECT v FROM (SELECT x AS v FROM links UNION SELECT y FROM links)) SELECT v, (coalesce(a.n, 0) + coalesce(b.n, 0))::BIGINT AS n FROM t LEFT JOIN (SELECT x AS v, count(*) AS n FROM links GROUP BY x) a USING (v) LEFT JOIN (SELECT y AS v, count(*) AS n FROM links GROUP BY y) b USING (v)")
_RANK = """E = [from s as a, s as b where b.s_suppkey = a.s_suppkey + 1 emit a.s_suppkey as src, b.s_suppkey as dst] + [from s where s_suppkey > 1 emit s_suppkey as src, 1 as dst] + [from s where s_suppkey = 1 emit s_suppkey as src, s_suppkey as dst];"""
script("pagerank_fixed", "s = scan(supplier); " + _RANK + """ N = [from s emit count(*) as n]; D = [from E emit src, count(dst) as d]; P = [from s emit s_suppkey as id, 1.0 / *N as rank, 0 as i];
    do Share = [from P, D, E where P.id = D.src and E.src = P.id emit E.dst as id, P.rank / D.d as r, P.i as i]; P = [from Share emit id, 0.15 / *N + 0.85 * sum(r) as rank, max(i) + 1 as i]; while [from P emit max(i) < 3];
    out = [from P emit id, floor(rank * 1000000) as rank];""",
       """WITH e AS (SELECT a.s_suppkey AS src, b.s_suppkey AS dst FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 UNION ALL SELECT s_suppkey, 1 FROM supplier WHERE s_suppkey > 1 UNION ALL SELECT s_suppkey, s_suppkey FROM supplier WHERE s_suppkey = 1),
    n AS (SELECT count(*)::DOUBLE AS n FROM supplier), d AS (SELECT src, count(*) AS d FROM e GROUP BY src), p0 AS (SELECT s_suppkey AS id, 1.0 / (SELECT n FROM n) AS rank FROM supplier),
    p1 AS (SELECT dst AS id, 0.15 / (SELECT n FROM n) + 0.85 * sum(rank / d) AS rank FROM p0 JOIN e ON id = e.src JOIN d ON d.src = id GROUP BY dst), p2 AS (SELECT dst AS id, 0.15 / (SELECT n FROM n) + 0.85 * sum(rank / d) AS rank FROM p1 JOIN e ON id = e.src JOIN d ON d.src = id GROUP BY dst),
    p3 AS (SELECT dst AS id, 0.15 / (SELECT n FROM n) + 0.85 * sum(rank / d) AS rank FROM p2 JOIN e ON id = e.src JOIN d ON d.src = id GROUP BY dst) SELECT id, floor(rank * 1000000)::DOUBLE AS rank FROM p3""")  # fmt: skip
# Event values within three standard deviations of the mean, again and again until nothing falls out. Moments are kept as sums, so each round is one pass.
script("sigma_clip", """e = scan(events); Kept = [from e emit event_id as id, floor(value * 100) as worth];
    do Sums = [from Kept emit count(*) as n, sum(worth) as s, sum(worth * worth) as q];
       Span = [from Sums emit s / n as mid, 3 * sqrt(q / n - (s / n) * (s / n)) as reach];
       Before = [from Kept emit count(*) as n]; Kept = [from Kept where worth >= *Span.mid - *Span.reach and worth <= *Span.mid + *Span.reach emit *];
    while [from Kept emit count(*) < *Before]; out = [from Kept emit id];""",
       "WITH k0 AS (SELECT event_id AS id, floor(value * 100) AS worth FROM events), " + ", ".join(f"m{i} AS (SELECT sum(worth) / count(*) AS mid, 3 * sqrt(sum(worth * worth) / count(*) - (sum(worth) / count(*)) * (sum(worth) / count(*))) AS reach FROM k{i}), k{i + 1} AS (SELECT id, worth FROM k{i}, m{i} WHERE worth >= mid - reach AND worth <= mid + reach)" for i in range(24)) + " SELECT id FROM k24")
# Three bands of balances: the borders lie halfway between the bands' means and move four times. No distances are paired.
script("kmeans", """def band(x, lo, hi): case when x < lo then 1 when x < hi then 2 else 3 end; s = scan(supplier); Pts = [from s emit s_suppkey as id, s_acctbal as x]; Cut = [2000.0 as lo, 6000.0 as hi, 0 as turn];
    do Part = [from Pts, Cut emit band(Pts.x, Cut.lo, Cut.hi) as b, Pts.x as x]; Mean = [from Part emit b, avg(x) as m];
       Cut = [from Mean as p, Mean as q, Mean as r, Cut where p.b = 1 and q.b = 2 and r.b = 3 emit (p.m + q.m) / 2 as lo, (q.m + r.m) / 2 as hi, Cut.turn + 1 as turn]; while [from Cut emit max(turn) < 4];
    out = [from Pts, Cut emit Pts.id as id, band(Pts.x, Cut.lo, Cut.hi) as k];""",
       "WITH p AS (SELECT s_suppkey AS id, s_acctbal AS x FROM supplier), c0 AS (SELECT 2000.0::DOUBLE AS lo, 6000.0::DOUBLE AS hi), " + ", ".join(f"c{i} AS (SELECT (avg(x) FILTER (x < lo) + avg(x) FILTER (x >= lo AND x < hi)) / 2 AS lo, (avg(x) FILTER (x >= lo AND x < hi) + avg(x) FILTER (x >= hi)) / 2 AS hi FROM p, c{i - 1})" for i in range(1, 5)) + " SELECT id, (CASE WHEN x < lo THEN 1 WHEN x < hi THEN 2 ELSE 3 END)::BIGINT AS k FROM p, c4")
# A sample's rows are drawn; its size, that its rows are the table's, and how often they come are not.
_CHECK = "o = scan(orders); d = distinct([from s emit *]); k = intersect(d, o); n = [from s emit count(*) as n]; i = [from k emit count(*) as own]; u = [from d emit count(*) as different]; out = [from n, i, u emit n.n as n, {b} as own];"
script("sample_wor", "s = samplescan(orders, 100, WoR); " + _CHECK.format(b="i.own"), "SELECT 100::BIGINT AS n, 100::BIGINT AS own")
script("sample_wor_percent", "s = samplescan(orders, 30%, WoR); " + _CHECK.format(b="i.own"), "SELECT round(count(*) * 0.3)::BIGINT AS n, round(count(*) * 0.3)::BIGINT AS own FROM orders")
script("sample_wr", "s = samplescan(orders, 50%, WR); " + _CHECK.format(b="u.different - i.own"), "SELECT round(count(*) * 0.5)::BIGINT AS n, 0::BIGINT AS own FROM orders")
script("limit_rel", "o = scan(orders); s = limit(o, 250); " + _CHECK.format(b="i.own"), "SELECT 250::BIGINT AS n, 250::BIGINT AS own")
script("flatmap_inside", "p = scan(part); out = [from p emit p_brand, sum(len(split(p_name, ' '))) as letters, count(*) as words];",
       "SELECT p_brand, sum(length(w))::BIGINT AS letters, count(*) AS words FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY p_brand")
script("substr_bounds", "p = scan(part); out = [from p emit p_partkey, substr(p_name, -4, -1) as a, substr(p_name, 2, 99) as b, substr(p_name, -99, 3) as c];",
       "SELECT p_partkey, left(right(p_name, 4), greatest(least(length(p_name), 4) - 1, 0)) AS a, substring(p_name, 3) AS b, left(p_name, 3) AS c FROM part")
script("dateadd_days", "o = scan(orders); out = [from o emit o_orderkey, dateadd(string(o_orderdate), o_custkey % 400 - 200) as d];",
       "SELECT o_orderkey, strftime(o_orderdate::DATE + (((o_custkey % 400 + 400) % 400) - 200)::INT, '%Y-%m-%d') AS d FROM orders")
script("lexmin_nearest", _TRADE + """ do Way = [who, lexmin(steps, via)] <- [1 as who, 0 as steps, 0 as via] + [from Way, Trade where Way.who = Trade.buyer and Way.steps < 3 emit Trade.seller as who, Way.steps + 1 as steps, Way.who as via]; until convergence;
    out = [from Way emit who, steps, via];""",
       f"WITH {_TRADE_SQL}, w0 AS (SELECT 1::BIGINT AS who, 0::BIGINT AS steps, 0::BIGINT AS via), " + ", ".join(f"w{i} AS (SELECT * FROM w{i - 1} UNION ALL SELECT seller, {i}, min(buyer) FROM trade JOIN w{i - 1} ON buyer = who WHERE steps = {i - 1} AND seller NOT IN (SELECT who FROM w{i - 1}) GROUP BY seller)" for i in range(1, 4)) + " SELECT who, steps, via FROM w3")


def _blobs(spark: SparkSession, sf_dir: str) -> Session:
    session = Session(spark, root=sf_dir)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    session.catalog.register("raw", part.select("p_partkey", F.col("p_name").cast("binary").alias("b")))
    return session


@named("byte_range", "SELECT p_partkey, substring(p_name, 2, 3) AS s FROM part")
def _byte_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes 1 to 3 of ASCII names."""
    return _blobs(spark, sf_dir).query("r = scan(raw); out = [from r emit p_partkey, byterange(b, 1, 4) as s];", "out").withColumn("s", F.col("s").cast("string"))


@named("bit_set", "SELECT p_partkey, sum(bit_count(ascii(substring(p_name, i::INT, 1))::INT))::BIGINT AS n, (count(*) * 8)::BIGINT AS bits FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS i FROM part) GROUP BY p_partkey")
def _bit_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ones among the bits of ASCII names."""
    return _blobs(spark, sf_dir).query("r = scan(raw); x = [from r emit p_partkey, bitset(b) as bit]; out = [from x emit p_partkey, sum(case when bit then 1 else 0 end) as n, count(*) as bits];", "out")


@named("load_csv", "SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal FROM supplier WHERE s_acctbal > 100")
def _load_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table, written as delimited text, loaded with a schema."""
    path = scratch(spark, "csv")
    spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", "s_acctbal").write.option("sep", "|").csv(path)
    return Session(spark).query(f'x = load("{path}", csv(schema(k:int, name:string, bal:float), delimiter="|")); out = [from x where bal > 100 emit *];', "out")


@named("store_and_scan", "SELECT o_custkey AS k, count(*) AS n, sum(o_orderkey)::BIGINT AS s FROM orders GROUP BY o_custkey")
def _store_and_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation that is stored, dealt out by a column, overwritten by what is made of it, and read by another program."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey")
    root = scratch(spark, "store")
    first = Session(spark, {"orders": orders}, root=root)
    first.run("o = scan(orders); store(o, my:own:sums, [o_custkey]);")
    Session(spark, root=root).run("o = scan(my:own:sums); s = [from o emit o_custkey as k, count(*) as n, sum(o_orderkey) as s]; store(s, my:own:sums);")
    return Session(spark, root=root).query("s = scan(my:own:sums); out = [from s emit *];", "out")


@named("scan_sql", "SELECT n_name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_acctbal > 0 GROUP BY n_name")
def _scan_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation that is a SQL query."""
    session = Session(spark, root=sf_dir)
    session.catalog.register_sql("rich", f"SELECT c_nationkey AS k FROM parquet.`{sf_dir}/customer.parquet` WHERE c_acctbal > 0")
    return session.query("r = scan(rich); n = scan(nation); out = [from r, n where r.k = n.n_nationkey emit n_name, count(*) as n];", "out")


datalog("datalog_path", "Two(n, r) :- nation(n, name, k), region(k, r).", "Two", "SELECT n_nationkey::BIGINT AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
datalog("datalog_agg", "Seg(s, count(k), max(b)) :- customer(k, nm, nk, b, s), b > 0. ", "Seg", 'SELECT c_mktsegment AS s, count(*) AS "_COLUMN1_", max(c_acctbal) AS "_COLUMN2_" FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment')
datalog("datalog_theta", "Near(a, b) :- region(a, x), region(b, y), a < b.", "Near", "SELECT a.r_regionkey::BIGINT AS a, b.r_regionkey::BIGINT AS b FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
datalog("datalog_negative_terms", "Odd(c, k + 1, b * 2) :- customer(c, nm, k, b, 'BUILDING'), b < 0, k != 3.", "Odd", "SELECT c_custkey AS c, c_nationkey + 1 AS \"_COLUMN1_\", c_acctbal * 2 AS \"_COLUMN2_\" FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0 AND c_nationkey <> 3")
datalog("datalog_triangle", "E(a, b) :- supplier(a, n1, k, b1), supplier(b, n2, k, b2), a < b. Tri(a, b, c) :- E(a, b), E(b, c), E(a, c).", "Tri",
        "WITH e AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey) SELECT x.a, x.b, y.b AS c FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b")
datalog("datalog_recursive", "Link(x, y) :- supplier(x, n1, k, b1), supplier(y, n2, k, b2), x < y. Path(x, y) :- Link(x, y). Path(x, z) :- Path(x, y), Link(y, z).", "Path",
        "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")


def _python_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relspark.pyexpr import column, where

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    big = where(orders, lambda t: t.o_totalprice > 1000 and t.o_orderstatus == "O")
    return big.select(F.col("o_orderkey"), column(big, lambda t: t.o_totalprice // 100).col.alias("h"), column(big, lambda t: t.o_orderpriority[0:1]).col.alias("p"))


QUERIES["python_lambda"] = _python_lambda
ORACLE_SQL["python_lambda"] = "SELECT o_orderkey, trunc(o_totalprice / 100)::BIGINT AS h, left(o_orderpriority, 1) AS p FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'O'"


def _count_vowels(s):
    return s.str.count("[AEIOU]").astype("int64")


_count_vowels.__annotations__ = {"s": pd.Series, "return": pd.Series}


def _python_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = Session(spark, root=sf_dir)
    session.register_function("vowels", F.pandas_udf(_count_vowels, "long"), "LONG")
    return session.query("n = scan(nation); out = [from n emit n_name, vowels(n_name) as v];", "out")


QUERIES["python_udf"] = _python_udf
ORACLE_SQL["python_udf"] = "SELECT n_name, length(regexp_replace(n_name, '[^AEIOU]', '', 'g')) AS v FROM nation"

"""Queries in the two query languages, each with its SQL for the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.model import DAY, HOUR, Measurement, events, measurement, orders, sales
from tidewell.plans.catalog import GRID, T0, T1, E, query, r
from tidewell.functions.scalar import FUNCTIONS
from tidewell.operators.aggregates import merged_partials
from tidewell.operators.geofence import in_fences
from tidewell.plans.logs import search
from tidewell.plans.promql import run_promql
from tidewell.plans.sql import run_sql
from tidewell.sources.line_protocol import lines_of, number, parse_lines
from tidewell.streaming.rollup import downsample, downsampled_again


def sources(spark, sf_dir) -> dict[str, Measurement]:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    people = Measurement(customer.select(F.lit(0).cast("long").alias("time"), "c_mktsegment", "c_custkey", "c_nationkey", "c_acctbal", "c_name"), ("c_mktsegment",), ("c_custkey", "c_nationkey", "c_acctbal", "c_name"))
    return {"events": events(spark, sf_dir), "sales": sales(spark, sf_dir), "orders": orders(spark, sf_dir), "customer": people}


def _rounded(df, digits: int = 6):
    return df.select(*(r(f"`{f.name}`", digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema))


def language(name: str, text: str, sql: str | None, digits: int = 6, **settings) -> None:
    def f(spark, sf_dir):
        return _rounded(run_sql(text, sources(spark, sf_dir), **settings), digits)

    f.__name__, f.__doc__ = f"sql_{name}", text
    query(sql)(f)


_MEAN = f"select event_type, time - time % {HOUR * 6} as time, avg(value) as v from {E} group by 1, 2"
_DAILY = f"(select event_type, user_id, time - time % {DAY} as time, sum(value) as v from {E} group by 1, 2, 3)"

language("expressions", "SELECT value * 2 + 1 AS a, -value AS b, abs(value - 50) AS c, floor(value) AS d, pow(value, 2) / 7 AS e FROM events WHERE sqrt(value) > 5 AND (value < 150 OR value >= 200)",
         f"select time, round(value * 2 + 1, 6) as a, -value as b, round(abs(value - 50), 6) as c, floor(value) as d, round(value * value / 7, 6) as e from {E} where sqrt(value) > 5 and (value < 150 or value >= 200)")
language("integer_operators", "SELECT user_id / 4 AS d, user_id % 4 AS m, user_id / (user_id % 2) AS z, user_id & 6 AS a, user_id | 3 AS o, user_id ^ 5 AS x FROM events WHERE value > 100",
         f"select time, user_id // 4 as d, user_id % 4 as m, case when user_id % 2 = 0 then 0 else user_id // (user_id % 2) end as z, user_id & 6 as a, user_id | 3 as o, xor(user_id, 5) as x from {E} where value > 100")
language("case", "SELECT CASE WHEN value > 100 THEN 'high' WHEN value > 50 THEN 'middle' ELSE 'low' END AS level, if(value > 50, 1, 0) AS big FROM events",
         f"select time, case when value > 100 then 'high' when value > 50 then 'middle' else 'low' end as level, case when value > 50 then 1 else 0 end as big from {E}")
language("cast", "SELECT CAST(value AS int) AS i, CAST(user_id AS float) AS f, CAST(user_id AS bool) AS b, CAST(user_id AS string) AS s, typeof(value) AS t FROM events",
         f"select time, trunc(value)::bigint as i, user_id::double as f, user_id <> 0 as b, user_id::varchar as s, 'float64' as t from {E}")
language("star", "SELECT * FROM events WHERE value > 100", f"select time, value, event_type, user_id from {E} where value > 100")
language("star_of_tags", "SELECT *::tag, /^val/ FROM events WHERE value > 100", f"select time, value, event_type, user_id from {E} where value > 100")
language("aggregates_of_star", "SELECT mean(*), max(/^l_(tax|quantity)$/) FROM sales GROUP BY l_returnflag",
         "select l_returnflag, round(avg(l_quantity), 6) as mean_l_quantity, round(avg(l_extendedprice), 6) as mean_l_extendedprice, round(avg(l_discount), 6) as mean_l_discount, round(avg(l_tax), 6) as mean_l_tax, max(l_quantity) as max_l_quantity, max(l_tax) as max_l_tax from lineitem group by 1", 6)
language("arithmetic_of_aggregates", "SELECT sum(value) / count(value) AS m, max(value) - min(value) AS range, count(distinct(user_id)) AS users FROM events GROUP BY event_type",
         "select event_type, round(avg(value), 6) as m, round(max(value) - min(value), 6) as range, count(distinct user_id) as users from events group by 1")
language("aggregate_of_expression", "SELECT sum(l_extendedprice * (1 - l_discount)) AS revenue FROM sales GROUP BY l_returnflag, l_linestatus",
         "select l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem group by 1, 2", 2)
language("subquery", "SELECT max(m) AS top, mean(m) AS middle FROM (SELECT mean(value) AS m FROM events GROUP BY event_type, user_id) GROUP BY event_type",
         "select event_type, round(max(m), 6) as top, round(avg(m), 6) as middle from (select event_type, user_id, avg(value) as m from events group by 1, 2) group by 1")
language("nested_derivative", f"SELECT derivative(mean(value), 1h) AS d FROM events GROUP BY time(6h), event_type fill(none)",
         f"with b as ({_MEAN}) select event_type, time, round(d, 6) as d from (select event_type, time, (v - lag(v) over w) / ((time - lag(time) over w) / 3600000000.0) as d from b window w as (partition by event_type order by time)) where d is not null")
language("nested_moving_average", "SELECT moving_average(mean(value), 3) AS m FROM events GROUP BY time(6h), event_type fill(none)",
         f"with b as ({_MEAN}) select event_type, time, round(m, 6) as m from (select event_type, time, avg(v) over w as m, count(*) over w as n from b window w as (partition by event_type order by time rows 2 preceding)) where n = 3")
language("nested_cumulative_sum", "SELECT cumulative_sum(count(value)) AS n FROM events GROUP BY time(1d), event_type fill(none)",
         f"with b as (select event_type, time - time % {DAY} as time, count(*) as v from {E} group by 1, 2) select event_type, time, (sum(v) over (partition by event_type order by time))::bigint as n from b")
language("raw_difference", "SELECT difference(value) AS d, elapsed(value, 1s) AS s FROM events GROUP BY event_type",
         f"select event_type, time, round(d, 6) as d, s from (select event_type, time, value - lag(value) over w as d, (time - lag(time) over w) // 1000000 as s from {E} window w as (partition by event_type order by time)) where d is not null")
language("join", "SELECT x.v AS clicks, y.v AS views FROM (SELECT sum(value) AS v FROM events WHERE event_type = 'click' GROUP BY time(1d), user_id fill(none)) AS x JOIN (SELECT sum(value) AS v FROM events WHERE event_type = 'view' GROUP BY time(1d), user_id fill(none)) AS y ON x.user_id = y.user_id AND x.time = y.time",
         f"select x.time, round(x.v, 6) as clicks, round(y.v, 6) as views from {_DAILY} x join {_DAILY} y using (user_id, time) where x.event_type = 'click' and y.event_type = 'view'")
for _how in ("left", "right", "outer", "full"):
    language(f"join_{_how}", f"SELECT x.user_id AS a, y.user_id AS b, x.v AS clicks, y.v AS views FROM (SELECT sum(value) AS v FROM events WHERE event_type = 'click' GROUP BY time(1d), user_id fill(none)) AS x {_how.upper()} JOIN (SELECT sum(value) AS v FROM events WHERE event_type = 'view' GROUP BY time(1d), user_id fill(none)) AS y ON x.user_id = y.user_id AND x.time = y.time",
             f"with c as (select * from {_DAILY} where event_type = 'click'), w as (select * from {_DAILY} where event_type = 'view') select coalesce(x.time, y.time) as time, x.user_id as a, y.user_id as b, round(x.v, 6) as clicks, round(y.v, 6) as views from c x {'full' if _how == 'outer' else _how} join w y on x.user_id = y.user_id and x.time = y.time")
language("in_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_totalprice > 1000",
         "select epoch_us(o_orderdate) as time, o_orderkey, o_totalprice from orders where o_totalprice > 1000 and o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
language("not_in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
         "select epoch_us(o_orderdate) as time, o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)")
language("in_and_not_in", "SELECT value FROM events WHERE event_type IN ('click', 'view') AND user_id NOT IN (1, 2, 3)", f"select time, value from {E} where event_type in ('click', 'view') and user_id not in (1, 2, 3)")
language("union", "SELECT event_type FROM events WHERE value > 100 UNION SELECT event_type FROM events WHERE value < 5", f"select time, event_type from {E} where value > 100 union select time, event_type from {E} where value < 5")
language("union_all", "SELECT count(value) AS n FROM events GROUP BY event_type UNION ALL SELECT count(l_tax) AS n FROM sales GROUP BY l_returnflag",
         "select event_type, count(*) as n from events group by 1 union all select l_returnflag, count(*) from lineitem group by 1")
language("union_by_name", "SELECT max(value) AS a, min(value) AS b FROM events UNION BY NAME SELECT min(value) AS b, max(value) AS a FROM events",
         "select max(value) as a, min(value) as b from events")
language("union_all_by_name", "SELECT max(value) AS a, min(value) AS b FROM events UNION ALL BY NAME SELECT count(value) AS n, max(value) AS a FROM events",
         "select max(value) as a, min(value) as b, null::bigint as n from events union all select max(value), null, count(*) from events")
language("with", "WITH daily AS (SELECT sum(value) AS s FROM events GROUP BY time(1d), event_type fill(none)), top AS (SELECT max(s) AS s FROM daily GROUP BY event_type) SELECT daily.s AS s, daily.event_type AS event_type FROM daily JOIN top ON daily.event_type = top.event_type AND daily.s = top.s",
         f"with d as (select event_type, time - time % {DAY} as time, sum(value) as s from {E} group by 1, 2) select event_type, time, round(s, 4) as s from d qualify s = max(s) over (partition by event_type)", 4)
language("group_by_star_except", "SELECT count(value) AS n FROM events GROUP BY * EXCEPT user_id", "select event_type, count(*) as n from events group by 1")
language("group_by_pattern", "SELECT sum(l_quantity) AS q FROM sales GROUP BY /^l_line/", "select l_linestatus, round(sum(l_quantity), 6) as q from lineitem group by 1")
language("selector_with_columns", "SELECT max(value) AS v, user_id FROM events GROUP BY event_type", f"select event_type, arg_max(time, (value, -time)) as time, max(value) as v, arg_max(user_id, (value, -time)) as user_id from {E} group by 1")
language("first_with_columns", "SELECT first(value) AS v, user_id FROM events GROUP BY time(1d), event_type", f"select event_type, time - time % {DAY} as time, arg_min(value, e.time) as v, arg_min(user_id, e.time) as user_id from {E} e group by 1, 2")
language("top_with_columns", "SELECT top(value, 3) AS v, user_id FROM events GROUP BY event_type", f"select event_type, time, value as v, user_id from {E} qualify row_number() over (partition by event_type order by value desc, time) <= 3")
language("bottom_by_tag", "SELECT bottom(value, user_id, 2) AS v FROM events GROUP BY event_type",
         f"with b as (select * from {E} qualify row_number() over (partition by event_type, user_id order by value, time) = 1) select event_type, time, user_id, value as v from b qualify row_number() over (partition by event_type order by value, time) <= 2")
language("distinct", "SELECT distinct(user_id) AS user FROM events GROUP BY event_type", "select distinct event_type, user_id as user from events")
language("ranked", "SELECT percentile(value, 75) AS p, mode(user_id) AS m, integral(value, 1h) AS i FROM events GROUP BY event_type",
         f"""with k as (select *, row_number() over (partition by event_type order by value) as rn, count(*) over (partition by event_type) as n, lag(value) over (partition by event_type order by time) as pv, lag(time) over (partition by event_type order by time) as pt from {E}),
u as (select event_type, user_id, count(*) as n, min(time) as t from {E} group by 1, 2 qualify row_number() over (partition by event_type order by n desc, t) = 1)
select k.event_type, max(value) filter (rn = greatest(1, least(k.n, floor(k.n * 0.75 + 0.5)))) as p, any_value(u.user_id) as m, round(sum((value + pv) / 2 * ((time - pt) / 3600000000.0)), 4) as i from k join u using (event_type) group by 1""", 4)  # fmt: skip
language("percentile_by_day", "SELECT percentile(value, 50) AS p FROM events GROUP BY time(1d), event_type fill(none)",
         f"with k as (select event_type, time - time % {DAY} as day, value, row_number() over (partition by event_type, time - time % {DAY} order by value) as rn, count(*) over (partition by event_type, time - time % {DAY}) as n from {E}) select event_type, day as time, value as p from k where rn = greatest(1, least(n, floor(n * 0.5 + 0.5)))")
language("limit_by_series", "SELECT value FROM events GROUP BY event_type LIMIT 4 OFFSET 2", f"select event_type, time, value from {E} qualify row_number() over (partition by event_type order by time) between 3 and 6")
language("series_limit", "SELECT count(value) AS n FROM events GROUP BY event_type SLIMIT 2 SOFFSET 1", "select event_type, count(*) as n from events group by 1 order by 1 limit 2 offset 1")
language("order_by", "SELECT value, user_id FROM events ORDER BY value DESC, time LIMIT 20", f"select time, value, user_id from {E} order by value desc, time limit 20")
language("now", "SELECT count(value) AS n FROM events WHERE time > now() - 7d AND time <= now() GROUP BY event_type", f"select event_type, count(*) as n from {E} where time > {T1 - 7 * DAY} and time <= {T1} group by 1", now=T1)
language("time_zone", "SELECT count(value) AS n, mean(value) AS m FROM events GROUP BY time(1d) fill(none) tz('Asia/Shanghai')", f"select time - (time + {8 * HOUR}) % {DAY} as time, count(*) as n, round(avg(value), 6) as m from {E} group by 1")
language("several_sources", "SELECT count(value) AS n, count(l_tax) AS t FROM events, sales", "select (select count(*) from events) as n, (select count(*) from lineitem) as t")
language("sources_by_pattern", "SELECT count(value) AS n FROM /^ev/", "select count(*) as n from events")
language("match", "SELECT c_custkey FROM customer WHERE MATCH(c_name, 'Customer') AND c_name LIKE '%1' OR MATCHPHRASE(c_mktsegment, 'BUILDING')",
         "select 0::bigint as time, c_custkey from customer where (c_name ilike 'customer#%' and regexp_matches(c_name, '(^|[^0-9a-zA-Z_])1([^0-9a-zA-Z_]|$)')) or c_mktsegment = 'BUILDING'")
language("like", "SELECT value FROM events WHERE event_type LIKE 'c%k' OR event_type LIKE 'vie_'", f"select time, value from {E} where event_type in ('click', 'view')")
language("pattern_condition", "SELECT value FROM events WHERE event_type =~ /^(click|v.*)$/ AND event_type !~ /ick/", f"select time, value from {E} where regexp_matches(event_type, '^(click|v.*)$') and not regexp_matches(event_type, 'ick')")
language("fill_previous_of_two", "SELECT mean(value) AS m, max(value) AS t FROM events WHERE time >= '2024-01-01' AND time < '2024-01-31' GROUP BY time(1h), event_type fill(previous)",
         f"""with b as (select event_type, time - time % {HOUR} as time, avg(value) as m, max(value) as t from {E} group by 1, 2), g as (select event_type, x.time from (select distinct event_type from b), (select unnest(range({T0}, {T1}, {HOUR})) as time) x)
select g.event_type, g.time, round(last_value(m ignore nulls) over w, 6) as m, last_value(t ignore nulls) over w as t from g left join b using (event_type, time) window w as (partition by g.event_type order by g.time rows unbounded preceding)""")  # fmt: skip
language("count_fills_zero", "SELECT count(value) FROM events WHERE time >= '2024-01-01' AND time < '2024-01-31' AND value > 150 GROUP BY time(1h)",
         f"select x.time, coalesce(n, 0) as count from (select unnest(range({T0}, {T1}, {HOUR})) as time) x left join (select time - time % {HOUR} as time, count(*) as n from {E} where value > 150 group by 1) using (time)")
language("sliding_window", "SELECT sliding_window(sum(value), 3) AS s FROM events GROUP BY time(1d), event_type",
         f"with b as (select event_type, time - time % {DAY} as time, sum(value) as v from {E} group by 1, 2) select event_type, time, round(s, 4) as s from (select event_type, time, sum(v) over (partition by event_type order by time range between current row and {2 * DAY} following) as s, max(time) over (partition by event_type) as e from b) where time + {2 * DAY} <= e", 4)
language("compare", "SELECT compare(count(value), 86400) AS c FROM events GROUP BY time(1d), event_type",
         f"with b as (select event_type, time - time % {DAY} as time, count(*) as v from {E} group by 1, 2) select a.event_type, a.time, a.v as c_0, b.v as c_1 from b a left join b on a.event_type = b.event_type and a.time = b.time + {DAY}")
language("heavy_hitters", "SELECT topn_ddcm(user_id, 0.0001, 5, 'count') AS n FROM events GROUP BY event_type, user_id", "select event_type, user_id, count(*) as n from events group by 1, 2 having count(*) >= 0.0001 * (select count(*) from events) order by 3 desc, 1, 2 limit 5")
language("heavy_sums", "SELECT topn_nagt2(value, 0.01, 3, 'sum') AS s FROM events GROUP BY event_type", "select event_type, round(sum(value), 4) as s from events group by 1 having sum(value) >= 0.01 * (select sum(value) from events) order by 2 desc, 1 limit 3", 4)
language("into", "SELECT sum(s) AS total FROM (SELECT sum(value) AS s INTO daily FROM events GROUP BY time(1d) fill(none))", "select round(sum(value), 2) as total from events", 2)
language("percentile_sketch", "SELECT percentile_approx(value, 50) AS a, percentile_ogsketch(value, 90, 100) AS b, histogram(value, 5) AS h FROM events GROUP BY event_type", None)
language("forecast", "SELECT holt_winters(mean(value), 5, 0) AS f FROM events GROUP BY time(1d), event_type", None)
language("forecast_with_fit", "SELECT holt_winters_with_fit(mean(value), 5, 7) AS f FROM events GROUP BY time(1d), event_type", None)


def metrics(spark, sf_dir) -> dict[str, Measurement]:
    bounds = [5.0, 10.0, 25.0, 50.0, 100.0, float("inf")]
    m = events(spark, sf_dir)
    le = F.explode(F.array(*(F.lit(b) for b in bounds)))
    buckets = m.frame.select("event_type", "time", "value", le.alias("_le"))
    counted = buckets.groupBy("event_type", (F.col("time") - F.pmod("time", F.lit(DAY))).alias("time"), "_le").agg(F.count_if(F.col("value") <= F.col("_le")).cast("double").alias("value"))
    histogram = counted.select("time", "event_type", F.when(F.col("_le") == float("inf"), "+Inf").otherwise(F.col("_le").cast("string")).alias("le"), "value")
    return {"events": m, "by_type": measurement(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", ["event_type"], ["value"]), "bucket": Measurement(histogram, ("event_type", "le"), ("value",))}


def metric(name: str, text: str, sql: str | None, digits: int = 5) -> None:
    """A query over all of the events, at each sixth hour."""

    def f(spark, sf_dir):
        return _rounded(run_promql(spark, text, metrics(spark, sf_dir), T0 + DAY, T1, 6 * HOUR), digits)

    f.__name__, f.__doc__ = f"promql_{name}", text
    query(sql)(f)


def _window(value: str, labels: str = "event_type, user_id::varchar as user_id", span: int = DAY, shift: int = 0, where: str = "true") -> str:
    return f"(select {labels}, g.tick as time, {value} as value from {GRID} g join {E} e on e.time >= g.tick - {span + shift} and e.time <= g.tick - {shift} where {where} group by all)"


_SUMS = _window("sum(value)")
_TYPES = _window("sum(value)", "event_type")
metric("sum_by", "sum by (event_type) (sum_over_time(events[1d]))", f"select event_type, time, round(value, 5) as value from {_TYPES}")
metric("max_without", "max without (user_id) (sum_over_time(events[1d]))", f"select event_type, time, round(max(value), 5) as value from {_SUMS} group by 1, 2")
metric("matchers", "count_over_time(events{event_type=~\"cl.*|view\", user_id!=\"3\"}[1d])", f"select event_type, user_id, time, value from {_window('count(*)::double', where=chr(39).join(['event_type in (', 'click', ', ', 'view', ') and user_id <> 3']))}")
metric("offset", "sum_over_time(by_type[1d] offset 1d)", f"select event_type, time, round(value, 5) as value from {_window('sum(value)', 'event_type', shift=DAY)}")
metric("at", "sum_over_time(by_type[1d] @ end())", f"select event_type, g.tick as time, round(v, 5) as value from {GRID} g, (select event_type, sum(value) as v from {E} where time >= {T1 - DAY} and time <= {T1} group by 1)")
metric("subquery", "max_over_time(sum by (event_type) (count_over_time(events[6h]))[1d:6h])",
       f"with t as (select unnest(range({T0}, {T1 + 1}, {6 * HOUR})) as tick), c as (select event_type, tick, count(*)::double as n from t join {E} e on e.time >= tick - {6 * HOUR} and e.time <= tick group by 1, 2) select event_type, g.tick as time, max(n) as value from {GRID} g join c on c.tick >= g.tick - {DAY} and c.tick <= g.tick group by 1, 2")
metric("group_left", "sum_over_time(events[1d]) / on (event_type) group_left () sum by (event_type) (sum_over_time(events[1d]))", f"select s.event_type, s.user_id, s.time, round(s.value / t.value, 5) as value from {_SUMS} s join {_TYPES} t using (event_type, time)")
metric("group_right", "sum by (event_type) (sum_over_time(events[1d])) - ignoring (user_id) group_right sum_over_time(events[1d])", f"select s.event_type, s.user_id, s.time, round(t.value - s.value, 5) as value from {_SUMS} s join {_TYPES} t using (event_type, time)")
metric("ignoring", "sum_over_time(events{event_type=\"click\"}[1d]) > ignoring (event_type) sum_over_time(events{event_type=\"view\"}[1d])", f"select a.user_id, a.time, round(a.value, 5) as value from {_SUMS} a join {_SUMS} b using (user_id, time) where a.event_type = 'click' and b.event_type = 'view' and a.value > b.value")
metric("bool", "sum_over_time(events[1d]) > bool 60", f"select event_type, user_id, time, (value > 60)::int::double as value from {_SUMS}")
metric("scalar_arithmetic", "-sum_over_time(by_type[1d]) ^ 2 / 1000 + 1", f"select event_type, time, round(-(value * value) / 1000 + 1, 3) as value from {_TYPES}", 3)
metric("equal", "count_over_time(by_type[1d]) == 5", f"select event_type, time, value from {_window('count(*)::double', 'event_type')} where value = 5")
metric("equal_vectors", "count_over_time(by_type[1d]) == count_over_time(by_type[25h])", f"select event_type, a.time, a.value from {_window('count(*)::double', 'event_type')} a join {_window('count(*)::double', 'event_type', span=25 * HOUR)} b using (event_type, time) where a.value = b.value")
metric("power_of_vectors", "count_over_time(by_type[6h]) ^ on (event_type) sum by (event_type) (vector(1) * 0 + 2)", f"select event_type, time, value from {_TYPES} where false")
metric("and_or_unless", "(sum_over_time(events[1d]) > 100 and on (user_id) sum_over_time(events{event_type=\"view\"}[1d])) or (sum_over_time(events{event_type=\"click\"}[1d]) unless sum_over_time(events[1d]) > 20)",
       f"with s as {_SUMS}, x as (select * from s where value > 100 and exists (select 1 from s v where v.event_type = 'view' and v.user_id = s.user_id and v.time = s.time)), y as (select * from s where event_type = 'click' and not value > 20) select event_type, user_id, time, round(value, 5) as value from x union all select event_type, user_id, time, round(value, 5) from y where not exists (select 1 from x where x.event_type = y.event_type and x.user_id = y.user_id and x.time = y.time)")
metric("count_values", "count_values by (event_type) (\"n\", count_over_time(events[1d]))", f"select event_type, value::bigint::varchar as n, time, count(*)::double as value from {_window('count(*)')} group by 1, 2, 3")
metric("scalar", "scalar(sum(sum_over_time(events[1d]))) * 2", f"select time, round(sum(value) * 2, 4) as value from {_TYPES} group by 1", 4)
metric("absent", "absent(sum_over_time(by_type{event_type=\"click\"}[1h]))", f"select g.tick as time, 1.0::double as value from {GRID} g where not exists (select 1 from {E} e where e.event_type = 'click' and e.time >= g.tick - {HOUR} and e.time <= g.tick)")
metric("absent_over_time", "absent_over_time(by_type{event_type=\"click\"}[1h])", f"select 'click' as event_type, g.tick as time, 1.0::double as value from {GRID} g where not exists (select 1 from {E} e where e.event_type = 'click' and e.time >= g.tick - {HOUR} and e.time <= g.tick)")
metric("mad_over_time", "mad_over_time(by_type[1d])", f"with w as (select event_type, g.tick, value from {GRID} g join {E} e on e.time >= g.tick - {DAY} and e.time <= g.tick), m as (select event_type, tick, median(value) as m from w group by 1, 2) select event_type, tick as time, round(median(abs(value - m)), 5) as value from w join m using (event_type, tick) group by 1, 2")
metric("holt_winters", "holt_winters(by_type[1d], 0.3, 0.6)", None)
metric("quantile_beyond", "quantile_over_time(1.5, by_type[1d]) or quantile(-1, sum_over_time(by_type[1d]))", f"select event_type, time, 'inf'::double as value from {_TYPES} union all select '', time, '-inf'::double from {_TYPES} group by 2")
metric("label_replace", "label_replace(sum_over_time(by_type[1d]), \"kind\", \"$1-x\", \"event_type\", \"(..).*\")", f"select event_type, left(event_type, 2) || '-x' as kind, time, round(value, 5) as value from {_TYPES}")
metric("label_join", "label_join(sum_over_time(events[1d]), \"both\", \"/\", \"event_type\", \"user_id\")", f"select event_type, user_id, event_type || '/' || user_id as both, time, round(value, 5) as value from {_SUMS}")
metric("times", "hour() + 100 * day_of_month() + 10000 * month() + day_of_week()", f"select g.tick as time, (hour(t) + 100 * day(t) + 10000 * month(t) + dayofweek(t))::double as value from (select tick, make_timestamp(tick) as t from {GRID}) g")
metric("clamp_round", "clamp(round(sum_over_time(by_type[1d]), 10), 100, 5000)", f"select event_type, time, greatest(100.0, least(5000.0, floor(value / 10 + 0.5) * 10))::double as value from {_TYPES}", 3)
metric("sort", "sort_desc(sum_over_time(by_type[1d]))", f"select event_type, time, round(value, 5) as value from {_TYPES}")
metric("sort_by_label", "sort_by_label_desc(sum_over_time(by_type[1d]), \"event_type\")", f"select event_type, time, round(value, 5) as value from {_TYPES}")
metric("topk", "topk by (event_type) (2, sum_over_time(events[1d]))", f"select event_type, user_id, time, round(value, 5) as value from {_SUMS} qualify row_number() over (partition by event_type, time order by value desc, event_type, user_id) <= 2")
metric("histogram_quantile", "histogram_quantile(0.9, sum by (le) (sum_over_time(bucket[1d])))",
       f"""with b as (select tick as time, le, count(*) filter (value <= le)::double as c from (select unnest([5.0, 10.0, 25.0, 50.0, 100.0, 'inf'::double]) as le), (select g.tick, e.value from {GRID} g join {E} e on e.time - e.time % {DAY} >= g.tick - {DAY} and e.time - e.time % {DAY} <= g.tick) group by 1, 2),
x as (select *, lag(c) over (partition by time order by le) as c0, lag(le) over (partition by time order by le) as l0, max(c) over (partition by time) as n from b)
select time, round(case when le = 'inf' then l0 else coalesce(l0, 0) + (le - coalesce(l0, 0)) * ((0.9 * n - coalesce(c0, 0)) / (c - coalesce(c0, 0))) end, 5) as value from x where c >= 0.9 * n and coalesce(c0, -1) < 0.9 * n""")  # fmt: skip
metric("histogram_quantile_beyond", "histogram_quantile(2, sum by (le) (sum_over_time(bucket[1d])))", f"select g.tick as time, 'inf'::double as value from {GRID} g where exists (select 1 from {E} e where e.time - e.time % {DAY} >= g.tick - {DAY} and e.time - e.time % {DAY} <= g.tick)")


@query("select doc_id, regexp_extract(text, '([A-Z][a-z]+) ([a-z]+)', 1) as first, regexp_extract(text, '([A-Z][a-z]+) ([a-z]+)', 2) as second from documents where lang = 'en' and n_chars > 200 and n_chars <= 5000 and regexp_matches(text, '([A-Z][a-z]+) ([a-z]+)')")
def log_pipe(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search(docs, 'lang = en n_chars IN (200 5000] | EXTRACT(text: "([A-Z][a-z]+) ([a-z]+)") AS (first, second)', "text").where("first is not null").select("doc_id", "first", "second")


@query("select doc_id from documents where (source in (select distinct source from documents order by 1 limit 2) or lang = 'de') and n_chars < 300")
def log_conditions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    two = [row[0] for row in docs.select("source").distinct().orderBy("source").limit(2).collect()]
    return search(docs, f'(source IN ("{two[0]}", "{two[1]}") OR lang: de) AND n_chars < 300', "text").select("doc_id")


_POINTS = "(select c_custkey, 40 + (c_custkey * 37 % 2000) / 100.0 as lat, (c_custkey * 91 % 36000) / 100.0 - 180 as lon from customer)"
_FENCES = "(select s_suppkey as fence_id, 40 + (s_suppkey * 53 % 2000) / 100.0 as flat, (s_suppkey * 77 % 36000) / 100.0 - 180 as flon, 20000.0 + s_suppkey % 7 * 40000 as radius from supplier)"


@query(f"select c_custkey, fence_id from {_POINTS} p, {_FENCES} f where 2 * 6371000 * asin(least(1, sqrt(pow(sin((radians(flat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(flat)) * pow(sin((radians(flon) - radians(lon)) / 2), 2)))) <= radius")
def geofence(spark, sf_dir):
    people, places = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "supplier"))
    lat = lambda k, a: 40 + (F.col(k) * a % 2000) / 100.0
    lon = lambda k, a: (F.col(k) * a % 36000) / 100.0 - 180
    points = people.select("c_custkey", lat("c_custkey", 37).alias("lat"), lon("c_custkey", 91).alias("lon"))
    fences = places.select(F.col("s_suppkey").alias("fence_id"), lat("s_suppkey", 53).alias("lat"), lon("s_suppkey", 77).alias("lon"), (20000.0 + F.col("s_suppkey") % 7 * 40000).alias("radius"))
    return in_fences(points, fences, cell=1.0).select("c_custkey", "fence_id")


@query("""with edges as (select distinct c_nationkey as src, c_custkey % 25 as dst from customer where c_nationkey <> c_custkey % 25), own as (select n_nationkey as node, (n_nationkey % 5)::double as own from nation where n_nationkey % 5 > 0),
live as (select src, dst from edges where src in (select node from own) and dst in (select node from own)), h1 as (select dst as node, sum(own) * 0.5 as part from live join own on own.node = src group by 1), h2 as (select dst as node, sum(part) * 0.5 as part from live join h1 on h1.node = src group by 1)
select node, own, round(own + coalesce(h1.part, 0) + coalesce(h2.part, 0), 6) as score, round(coalesce(h1.part, 0) + coalesce(h2.part, 0), 6) as explained from own left join h1 using (node) left join h2 using (node)""")
def rca(spark, sf_dir):
    customer, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    edges = customer.select(F.col("c_nationkey").alias("src"), (F.col("c_custkey") % 25).alias("dst")).distinct()
    found = nation.select(F.col("n_nationkey").alias("node"), (F.col("n_nationkey") % 5).alias("severity"))
    measured = {"alarms": Measurement(found, ("node",), ("severity",)), "topology": Measurement(edges, (), ("src", "dst"))}
    out = run_sql("SELECT node, own, score, explained FROM rca(alarms, topology, '{\"hops\": 2}')", measured)
    return out.select("node", "own", r("score").alias("score"), r("explained").alias("explained"))


@query(f"select event_type, user_id, time, value, case when value > 120 then 'inf'::double else 0 end as score, value > 120 as anomaly from {E}")
def castor_threshold(spark, sf_dir):
    return run_sql("SELECT value, score, anomaly FROM castor(events, value, threshold, fit_detect, '{\"high\": 120}') GROUP BY event_type, user_id", sources(spark, sf_dir))


@query(f"select event_type, user_id, avg(value) as mean, stddev_pop(value) as sd from {E} group by 1, 2")
def castor_fit(spark, sf_dir):
    out = run_sql("SELECT model FROM castor(events, value, deviation, fit) GROUP BY event_type, user_id", sources(spark, sf_dir))
    return out.select("event_type", "user_id", F.get_json_object("model", "$.mean").cast("double").alias("mean"), F.get_json_object("model", "$.sd").cast("double").alias("sd"))


@query()
def castor_local_median(spark, sf_dir):
    return run_sql("SELECT value, score, anomaly FROM castor(events, value, local_median) WHERE anomaly = true GROUP BY event_type, user_id", sources(spark, sf_dir))


@query("select event_type, user_id, epoch_us(ts) as time, value from events")
def line_protocol_round_trip(spark, sf_dir):
    lines = lines_of(events(spark, sf_dir).frame, "events", ["event_type", "user_id"], ["value"])
    back = parse_lines(lines)
    return back.select(F.col("tags")["event_type"].alias("event_type"), F.col("tags")["user_id"].cast("long").alias("user_id"), F.expr("(time_ns - pmod(time_ns, 1000)) div 1000").alias("time"), number(F.col("fields")["value"]).alias("value"))


@query(f"with p as (select event_type, count(*) as n, sum(value) as s, max(value) as m from {E} group by 1) select event_type, n, round(s, 4) as s, m from p")
def incremental_aggregate(spark, sf_dir):
    """Partial results of three runs over a third of the days each, merged."""
    m, days = events(spark, sf_dir), 10 * DAY
    parts = [m.between(T0 + i * days, T0 + (i + 1) * days).frame.groupBy("event_type").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.max("value").alias("m")) for i in range(3)]
    return merged_partials(parts, ["event_type"], {"n": "count", "s": "sum", "m": "max"}).withColumn("s", r("s", 4))


@query(f"select event_type, user_id, time - time % {DAY} as time, count(*) as count_value, min(value) as min_value, arg_min(value, time) as first_value from {E} e group by event_type, user_id, e.time - e.time % {DAY}".replace("arg_min(value, time)", "arg_min(value, e.time)"))
def downsample_twice(spark, sf_dir):
    m = events(spark, sf_dir)
    hours = downsample(m, {"value": ["count", "min", "first"]}, HOUR)
    return downsampled_again(hours, m.tags, DAY)


@query("""select user_id, '10.' || user_id % 256 || '.' || user_id % 7 || '.3/20' as cidr, '10.' || user_id % 256 || '.0.0' as low, '10.' || user_id % 256 || '.0.255' as high, '["10.' || user_id % 256 || '.0.0", "10.' || user_id % 256 || '.0.255"]' as both, '中国移动' as carrier, '未知运营商' as unknown, '{"a":[1,2]}' as doc, '2' as inside from (select distinct user_id from events)""")
def network_functions(spark, sf_dir):
    u, fn = F.col("user_id").cast("string"), FUNCTIONS
    block = (F.col("user_id") % 256).cast("string")
    cidr = F.concat(F.lit("10."), block, F.lit("."), (F.col("user_id") % 7).cast("string"), F.lit(".3/20"))
    doc = F.lit('{"a":[1,2]}')
    found = events(spark, sf_dir).frame.select("user_id").distinct()
    return found.select("user_id", cidr.alias("cidr"), fn["ip_subnet_min"](cidr).alias("low"), fn["ip_subnet_max"](cidr).alias("high"), fn["ip_subnet_range"](cidr).alias("both"), fn["mobile_carrier"](F.concat(F.lit("138"), u)).alias("carrier"), fn["mobile_carrier"](F.concat(F.lit("111"), u)).alias("unknown"), doc.alias("doc"), fn["json_extract"](doc, "$.a[1]").alias("inside"))


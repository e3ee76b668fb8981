"""The query languages, statements and streams, by hand and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import vectors as V
from tidewell.functions.scalar import FUNCTIONS
from tidewell.model import Measurement, measurement
from tidewell.operators import aggregates as A
from tidewell.operators.causes import root_causes
from tidewell.operators.forecast import DETECTORS, Detector, Deviation, _whole_series, detected, fitted, register_detector, residual_scores, residual_scores_of_many
from tidewell.operators.graph import run_graph
from tidewell.plans.database import Database
from tidewell.plans.logs import LogError, search
from tidewell.plans.promql import Parser, PromError, run_promql
from tidewell.plans.sql import Planner, SqlError, parse, run_sql
from tidewell.sources.line_protocol import lines_of, number, parse_lines, text_value
from tidewell.streaming import rollup

MIN = 60_000_000


@pytest.fixture(scope="module")
def points(spark):
    rows = [("a", "x", 0, 1.0, 1), ("a", "x", 10, 2.0, 0), ("a", "y", 20, 3.0, 5), ("b", "x", 5, 7.0, 2), ("b", "y", 15, None, None)]
    return {"m": Measurement(spark.createDataFrame(rows, "t string, u string, time long, v double, n long"), ("t", "u"), ("v", "n"))}


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_precedence_and_integers(points):
    got = values(run_sql("SELECT 1 + 2 * 3 - 4 AS a, -n % 3 AS b, n / 0 AS c, v / 0 AS d, (n + 1) * 2 AS e FROM m WHERE t = 'a' AND NOT u = 'y' AND v < 2", points))
    assert got == [(0, 3, -1, 0, math.inf, 4)]


@pytest.mark.parametrize("text", ["SELECT mean(v), u FROM m", "SELECT v FROM m WHERE mean(v) > 1", "SELECT top(v, 1), bottom(v, 1) FROM m", "SELECT v FROM m ORDER BY v, v", "SELECT w FROM m", "SELECT v FROM m GROUP BY time(1u)", "SELECT derivative(mean(v)) FROM m", "SELECT CASE v WHEN 1 THEN 2 END FROM m", "SELECT nothing(v) FROM m", "SELECT v FROM m WHERE v NOT 3", "SELECT v FROM m UNION SELECT v, u FROM m", "SELECT v FROM m fill(linear)", "SELECT holt_winters(v, 3, 0) FROM m", "SELECT v FROM other", "SELECT x.v FROM m AS x JOIN m AS y ON x.v > y.v", "SELECT CAST(v AS date) FROM m", "SELECT v FROM m SLIMIT 1"])
def test_errors(points, text):
    with pytest.raises(SqlError):
        run_sql(text, points)


def test_nested_queries_and_hints(points):
    assert values(run_sql("SELECT sum(s) AS s FROM (SELECT sum(v) AS s FROM m GROUP BY t, u) WHERE s > 2.5 GROUP BY t", points)) == [("a", 6.0), ("b", 7.0)]
    kept = run_sql("SELECT /*+ filter_null_column */ v, n FROM m WHERE u = 'y' AND t = 'b'", points)
    assert kept.columns == ["time"]
    assert values(run_sql("SELECT v FROM m WHERE time >= now() - 10u AND time < now()", points, now=20)) == [(10, 2.0), (15, None)]


def test_null_and_duplicate_names(points):
    frame = run_sql("SELECT max(v), max(n), count(v) + count(n) AS c FROM m GROUP BY t", points)
    assert frame.columns == ["t", "max", "max_1", "c"] and values(frame) == [("a", 3.0, 5, 6), ("b", 7.0, 2, 2)]


def test_full_join_takes_one_partner(spark):
    rows = lambda n: Measurement(spark.createDataFrame([("k", 1, float(i)) for i in range(n)], "t string, time long, v double"), ("t",), ("v",))
    text = "SELECT x.v AS a, y.v AS b FROM l AS x {} JOIN r AS y ON x.t = y.t AND x.time = y.time"
    assert values(run_sql(text.format("FULL"), {"l": rows(2), "r": rows(3)})) == [(1, 0.0, 0.0), (1, 1.0, 1.0), (1, None, 2.0)]
    assert run_sql(text.format(""), {"l": rows(2), "r": rows(3)}).count() == 6


def test_select_into_and_tables(points):
    planner = Planner(points)
    planner.run(parse("SELECT sum(v) AS s INTO sums FROM m GROUP BY t"))
    assert values(planner.run(parse("SELECT max(s) AS s FROM sums")).frame) == [(7.0,)]
    planner.tables["double"] = lambda p, name: Measurement(p.sources[name].frame.withColumn("v", F.col("v") * 2), ("t", "u"), ("v",))
    assert values(planner.run(parse("SELECT max(v) AS v FROM double(m)")).frame) == [(14.0,)]


def test_time_range_reaches_the_scan(spark):
    m = measurement(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "ts", ["event_type"], ["value"])
    frame = run_sql("SELECT mean(value) AS v FROM events WHERE time >= '2024-01-02' AND time < '2024-01-03' GROUP BY time(1h), event_type", {"events": m})
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-02T00:00)" in plan and "LessThan(ts,2024-01-03T00:00)" in plan and plan.count("FileScan") == 1


def test_sample_takes_rows_of_the_input(points):
    got = A.sample(points["m"], "v", 2, ("t",))
    rows = {tuple(r) for r in points["m"].frame.collect()}
    assert all(tuple(r) in rows for r in got.collect()) and values(got.groupBy("t").count()) == [("a", 2), ("b", 1)]


def test_clamp_keeps_nan(spark):
    nan = F.lit(float("nan"))
    row = spark.range(1).select(FUNCTIONS["clamp_max"](nan, 5), FUNCTIONS["clamp_min"](nan, 5), FUNCTIONS["clamp_max"](F.lit(7.0), 5), FUNCTIONS["ip_subnet_min"](F.lit("1.2.3.4")), FUNCTIONS["ip_subnet_max"](F.lit("1.2.3.4/33")), FUNCTIONS["json_extract"](F.lit("[1,[2]]"), "$.1"), FUNCTIONS["json_extract"](F.lit("{}"), "a")).first()
    assert math.isnan(row[0]) and math.isnan(row[1]) and tuple(row)[2:] == (5.0, "invalid ip", "invalid ip", "[2]", None)


def test_casts(spark):
    m = {"m": Measurement(spark.createDataFrame([(0, -2.7, "x7", True), (1, 1e20, "7", False)], "time long, v double, s string, b boolean"), (), ("v", "s", "b"))}
    got = values(run_sql("SELECT CAST(v AS int) AS i, CAST(s AS int) AS j, CAST(b AS float) AS f, CAST(s AS bool) AS c, CAST(v AS string) AS w FROM m", m))
    assert got[0] == (0, -2, None, 1.0, True, "-2.7") and got[1][2:] == (7, 0.0, True, "100000000000000000000")


def metric(spark, rows):
    return {"m": Measurement(spark.createDataFrame(rows, "job string, inst string, time long, v double"), ("job", "inst"), ("v",))}


def test_metrics_parser():
    for text in ("m[5m", "sum(", "m{a=1}", "m offset", "1 +", "{a=\"b\"}", "m[5m] offset x", "rate(m)x"):
        with pytest.raises(PromError):
            Parser(text).parse()
    assert Parser("-a ^ 2").parse()[0] == "neg" and Parser("a + b * c").parse()[1] == "+"
    assert Parser("a ^ b ^ c").parse()[3][1] == "^" and Parser("a or b and c").parse()[1] == "or"


def test_vector_matching(spark):
    m = metric(spark, [("a", "1", 0, 2.0), ("a", "2", 0, 4.0), ("b", "1", 0, 8.0)])
    at = lambda text: values(run_promql(spark, text, m, 0))
    assert at("m / on (job) group_left sum by (job) (m)") == [("a", "1", 0, 1 / 3), ("a", "2", 0, 2 / 3), ("b", "1", 0, 1.0)]
    assert at('m{inst="1"} > bool ignoring (inst) m{inst="2"}') == [("a", 0, 0.0)]
    assert at("sum by (job) (m) == 6") == [("a", 0, 6.0)] and at("2 < bool 1") == [(0, 0.0)]
    for text in ("m / on (job) m", "m + on (job) group_left m", "sum by (job) (m) * on (job) m"):
        with pytest.raises(Exception, match="many-to-many"):
            at(text)


def test_label_functions_and_missing(spark):
    m = metric(spark, [("a", "h1:80", 0, 2.0)])
    at = lambda text: values(run_promql(spark, text, m, 0))
    assert at('label_replace(m, "host", "$1", "inst", "(.*):.*")') == [("a", "h1:80", "h1", 0, 2.0)]
    assert at('label_replace(m, "host", "$1", "inst", "nothing")') == [("a", "h1:80", "", 0, 2.0)]
    assert at('absent(m{job="zzz", inst=~"x"})') == [("zzz", 0, 1.0)] and at("absent(m)") == []
    assert math.isnan(at('scalar(m{job="zzz"})')[0][1]) and at("count_values(\"c\", m)") == [("2", 0, 1.0)]
    assert at("timestamp(m)") == [("a", "h1:80", 0, 0.0)] and at("days_in_month(vector(951782400))") == [(0, 29.0)]


def test_double_smoothing_and_median_deviation(spark):
    xs, sf, tf = [1.0, 4.0, 2.0, 8.0, 5.0], 0.4, 0.3
    m = metric(spark, [("a", "1", i * 1_000_000, x) for i, x in enumerate(xs)])
    level, before, trend = xs[0], 0.0, xs[1] - xs[0]
    for i in range(1, len(xs)):
        if i > 1:
            trend = tf * (level - before) + (1 - tf) * trend
        before, level = level, sf * xs[i] + (1 - sf) * (level + trend)
    assert values(run_promql(spark, f"holt_winters(m[10s], {sf}, {tf})", m, 4_000_000))[0][3] == pytest.approx(level)
    assert values(run_promql(spark, "mad_over_time(m[10s])", m, 4_000_000))[0][3] == np.median(np.abs(np.array(xs) - np.median(xs)))
    assert run_promql(spark, "holt_winters(m[500ms], 0.5, 0.5)", m, 4_000_000).count() == 0
    assert V.over_time(m["m"].frame.withColumnRenamed("v", "value"), ["job"], 0, 0, 1, 1, "quantile", -1.0).first()["value"] == -math.inf


def test_subquery_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [("a", "1", int(t) * 1_000_000, float(v)) for t, v in enumerate(rng.normal(size=300)) if t % 7]
    got = {r["time"]: r["value"] for r in run_promql(spark, "max_over_time(avg_over_time(m[20s])[1m:15s])", metric(spark, rows), 100 * 1_000_000, 280 * 1_000_000, 30 * 1_000_000).collect()}
    known = {t // 1_000_000: v for _, _, t, v in rows}
    mean = lambda at: np.mean([v for t, v in known.items() if at - 20 <= t <= at])
    for at in range(100, 281, 30):
        assert got[at * 1_000_000] == pytest.approx(max(mean(s) for s in range(0, at + 1, 15) if at - 60 <= s))


def test_forecast_of_a_line_and_a_season():
    line = fitted(np.arange(30.0) * 2 + 5, 5)
    assert np.allclose(line[30:], np.arange(30, 35) * 2 + 5, rtol=0.05)
    season = np.tile([10.0, 20.0, 30.0, 20.0], 8)
    assert np.allclose(fitted(season, 4, 4)[32:], season[:4], rtol=0.1)
    assert np.isnan(fitted(np.array([]), 2)).all() and (fitted(np.array([3.0]), 2) == 3).all()


def test_detectors(spark, points):
    rows = [("a", i, 1000.0 if i == 20 else float(i % 3)) for i in range(50)]
    df = spark.createDataFrame(rows, "t string, time long, v double")
    assert [r["time"] for r in detected(df, ("t",), "v", "local_median").where("anomaly").collect()] == [20]
    model = detected(df, ("t",), "v", "deviation", task="fit").first()["model"]
    import json

    assert [r["time"] for r in detected(df, ("t",), "v", "deviation", task="detect", model=json.loads(model)).where("anomaly").collect()] == [20]

    class Odd(Detector):
        def scores(self, values, model):
            return np.where(values % 2 == 1, 9.0, 0.0)

    register_detector("odd", Odd)
    assert detected(df, ("t",), "v", "odd").where("anomaly").count() == sum(v % 2 == 1 for _, _, v in rows)
    DETECTORS.pop("odd")
    with pytest.raises(ValueError):
        detected(df, ("t",), "v", "odd")


def test_root_causes_follow_dependencies(spark):
    events = spark.createDataFrame([("web", 1.0), ("api", 2.0), ("db", 1.0), ("fine", 0.0)], "node string, severity double")
    edges = spark.createDataFrame([("web", "api"), ("api", "db"), ("web", "fine")], "src string, dst string")
    got = {r["node"]: r["score"] for r in root_causes(events, edges).collect()}
    assert got == {"web": 1.0, "api": 2.5, "db": 1.0 + 1.0 + 0.25}


def test_graph_language(spark):
    nodes = spark.createDataFrame([("a", "app"), ("b", "app"), ("c", "db"), ("d", "app")], "node string, kind string")
    edges = spark.createDataFrame([("a", "b", 1), ("c", "a", 5), ("b", "d", 9)], "src string, dst string, w int")
    names = lambda text: sorted(r["node"] for r in run_graph(text, nodes, edges)[0].collect())
    assert names("GRAPH 1 'a'") == ["a", "b", "c"] and names("GRAPH 2 'a' NODE kind = 'app' EDGE w < 9") == ["a", "b"]
    found = run_graph("MATCH p=(n{uid:'a'})-[e*..3]-() WHERE ALL(x IN nodes(p) WHERE x.kind = 'app') AND ALL(y IN edges(p) WHERE y.w < 10) RETURN p", nodes, edges)
    assert sorted(r["node"] for r in found[0].collect()) == ["a", "b", "d"] and found[1].count() == 2
    with pytest.raises(ValueError):
        run_graph("MATCH p", nodes, edges)


def test_log_search(spark):
    logs = spark.createDataFrame([(1, "error", "disk full on h1 id=7"), (2, "info", "disk ok id=8"), (3, "error", None)], "n int, level string, content string")
    ids = lambda text: sorted(r["n"] for r in search(logs, text).collect())
    assert ids("") == [1, 2, 3] and ids("disk") == [1, 2] and ids('"disk full"') == [1] and ids("disk NOT full") == [2]
    assert ids("level: error OR n IN [2 2]") == [1, 2, 3] and ids("n IN (1 3]") == [2, 3] and ids("n IN (1, 3)") == [1, 3] and ids("(disk OR n = 3) AND level != info") == [1, 3]
    got = {r["n"]: (r["id"], r["host"]) for r in search(logs, 'disk | EXTRACT(content: "on (h\\\\d+) id=(\\\\d+)") AS (host, id)'.replace("\\\\", "\\")).collect()}
    assert got == {1: ("7", "h1"), 2: (None, None)}
    with pytest.raises(LogError):
        search(logs, "(disk")


def test_line_protocol_both_ways(spark):
    frame = spark.createDataFrame([("a b,c", 1, 1.5, 'say "x"\\', 3, True), (None, 2, None, None, 4, None)], "host string, time long, v double, s string, n long, ok boolean")
    back = parse_lines(lines_of(frame, "cpu", ["host"], ["v", "s", "n", "ok"]))
    got = back.select("time_ns", F.col("tags")["host"].alias("host"), number(F.col("fields")["v"]).alias("v"), text_value(F.col("fields")["s"]).alias("s"), number(F.col("fields")["n"]).alias("n"))
    assert values(got) == [(1000, "a b,c", 1.5, 'say "x"\\', 3.0), (2000, None, None, None, 4.0)]


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"), now=10 * 86_400_000_000)


def test_statements(spark, db):
    db.execute("CREATE MEASUREMENT disk (host tag, used int64, note string)")
    lines = ["cpu,host=a v=1,n=2i 1000000", "cpu,host=a v=2 2000000", "cpu,host=b v=5 1000000", 'mem,host=a free=7,note="x y" 1000000']
    db.insert(spark.createDataFrame([(x,) for x in lines], "value string"))
    db.execute("INSERT cpu,host=a v=9 1000000")
    assert db.names() == ["cpu", "disk", "mem"]
    assert values(db.execute("SELECT v, n FROM cpu GROUP BY host")) == [(1000, "a", 9.0, 2.0), (1000, "b", 5.0, None), (2000, "a", 2.0, None)]
    assert values(db.execute("SHOW MEASUREMENTS")) == [("cpu",), ("disk",), ("mem",)]
    assert values(db.execute("SHOW TAG KEYS FROM cpu")) == [("cpu", "host")] and values(db.execute("SHOW FIELD KEYS FROM disk")) == [("disk", "note", "string"), ("disk", "used", "bigint")]
    assert values(db.execute("SHOW TAG VALUES FROM cpu WITH KEY = host")) == [("cpu", "a"), ("cpu", "b")]
    assert values(db.execute("SHOW SERIES FROM cpu")) == [("cpu", "cpu,host=a"), ("cpu", "cpu,host=b")] and values(db.execute("SHOW SERIES CARDINALITY FROM cpu")) == [("cpu", 2)]
    db.execute("SELECT sum(v) AS s INTO totals FROM cpu GROUP BY host")
    assert values(db.execute("SELECT s FROM totals")) == [(0, 11.0), (0, 5.0)]
    db.execute("DELETE FROM cpu WHERE host = 'a' AND time < 1500")
    assert values(db.execute("SELECT v FROM cpu")) == [(1000, 5.0), (2000, 2.0)]
    assert "Scan" in "".join(r[0] for r in db.execute("EXPLAIN SELECT v FROM cpu").collect())
    db.execute("DROP MEASUREMENT cpu")
    with pytest.raises(SqlError):
        db.execute("SHOW TAG KEYS FROM cpu")
    for text in ("GRANT x", "CREATE USER x", "SHOW nothing", "DROP DATABASE x", "CREATE STREAM s INTO t ON SELECT mean(v) FROM mem GROUP BY time(1m)", "CREATE STREAM s INTO t ON SELECT sum(free) FROM mem GROUP BY time(1m) DELAY 10m"):
        with pytest.raises(SqlError):
            db.execute(text)


def test_streams_and_scheduled_queries(spark, db, tmp_path):
    day = 86_400_000_000
    point = lambda t, v, host="a": Measurement(spark.createDataFrame([(t, host, v)], "time long, host string, v double"), ("host",), ("v",))
    for i, v in enumerate((1.0, 2.0, 4.0)):
        db.write("cpu", point(9 * day + i * 10 * MIN, v))
    db.execute("CREATE STREAM s INTO rolled ON SELECT sum(v) AS s, count(v) AS n FROM cpu GROUP BY time(1h), host DELAY 5m")
    db.execute("CREATE STREAM f INTO big ON SELECT v FROM cpu WHERE v > 1.5")
    db.run_stream("s")
    db.run_stream("f")
    assert values(db.execute("SELECT s, n FROM rolled")) == [(9 * day, 7.0, 3)] and db.execute("SELECT v FROM big").count() == 2
    db.write("cpu", point(9 * day + 5 * 60 * MIN, 8.0))
    db.run_stream("s")
    db.write("cpu", point(9 * day + 1, 100.0))  # its window has been left behind
    db.run_stream("s")
    assert values(db.execute("SELECT s, n FROM rolled")) == [(9 * day, 7.0, 3), (9 * day + 5 * 60 * MIN, 8.0, 1)]
    db.execute("CREATE CONTINUOUS QUERY q RESAMPLE EVERY 1d FOR 1d BEGIN SELECT max(v) AS m INTO daily FROM cpu GROUP BY time(1d), host fill(none) END")
    db.run_continuous("q")
    assert values(db.execute("SELECT m FROM daily")) == [(9 * day, 100.0)] and values(db.execute("SHOW STREAMS")) == [("f", "big"), ("s", "rolled")]
    db.downsample("cpu", ["min", "max"], day, "coarse")
    assert values(db.execute("SELECT min_v, max_v FROM coarse")) == [(9 * day, 1.0, 100.0)]
    db.write("cpu", point(day, 3.0))
    db.execute("CREATE RETENTION POLICY r ON d DURATION 3d REPLICATION 1")
    db.retain()
    assert db.execute("SELECT v FROM cpu WHERE time < 200000000000").count() == 0
    db.export("cpu", str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_late_rows_are_dropped(spark, tmp_path):
    rows = lambda *ts: spark.createDataFrame([("k", t, 1.0) for t in ts], "k string, t string, v double").select("k", F.col("t").cast("timestamp_ntz").alias("t"), "v").coalesce(1)
    source, sink = str(tmp_path / "in"), str(tmp_path / "sink")
    schema = rows("2024-01-01 00:00:00").schema

    def run(*ts):
        rows(*ts).write.mode("append").parquet(source)
        stream = rollup.stream_rollup(spark.readStream.schema(schema).parquet(source), "t", ["k"], {"n": ("count", "v")}, "1 hour", "10 minutes")
        rollup.start(stream, sink).awaitTermination()
        return {r["time"] // 3_600_000_000 % 24: r["n"] for r in rollup.current(spark, sink, ["k", "time"]).collect()}

    assert run("2024-01-01 01:00:00", "2024-01-01 01:30:00") == {1: 2}
    assert run("2024-01-01 05:00:00") == {1: 2, 5: 1}
    assert run("2024-01-01 01:45:00", "2024-01-01 04:55:00", "2024-01-01 05:10:00") == {1: 2, 4: 1, 5: 2}
    assert rollup.filtered(rows("2024-01-01 01:00:00"), "v > 1").count() == 0
    with pytest.raises(ValueError):
        rollup.stream_rollup(rows("2024-01-01 01:00:00"), "t", [], {"n": ("mean", "v")}, "1 hour", "1 minute")


def test_levels_scheduled_runs_and_retention(spark, tmp_path):
    hour = 3_600_000_000
    m = Measurement(spark.createDataFrame([("a", i * 10 * MIN, float(i)) for i in range(30)], "k string, time long, v double"), ("k",), ("v",))
    paths = rollup.write_levels(m, {"v": ["min", "max", "sum", "count", "first", "last"]}, [hour, 5 * hour], str(tmp_path))
    assert values(spark.read.parquet(paths[1]).select("count_v", "first_v", "last_v", "sum_v")) == [(30, 0.0, 29.0, 435.0)]
    ran = rollup.run_scheduled(m, lambda x: x.frame.groupBy("k").agg(F.count("*").alias("n")), 2 * hour + 5, hour)
    assert values(ran) == [("a", 6)]
    stored = m.frame.select(F.timestamp_micros("time").cast("timestamp_ntz").alias("t"))
    assert rollup.expired(stored, "t", 5 * hour, 2 * hour).count() == 12
    assert values(rollup.tiers(stored, "t", 5 * hour, hour, 3 * hour).groupBy("tier").count()) == [("cold", 13), ("hot", 5), ("warm", 12)]


def test_detectors_take_many_series_at_a_time(spark):
    class Together(Detector):
        def scores_each(self, values, starts, ends, models):
            assert len(starts) == len(ends) == len(models)
            return np.full(len(values), float(len(starts)))

    rows = [(None if k == 7 else f"s{k}", float("nan") if k % 3 else -0.0 if i else 0.0, 2 - i, None if k == 5 else float(k + i)) for k in range(90) for i in range(3)]
    df = spark.createDataFrame(rows, "t string, u double, time long, v double").coalesce(1)
    register_detector("together", Together)
    got = detected(df, ("t", "u"), "v", "together").toPandas()
    DETECTORS.pop("together")
    assert len(got) == 89 * 3 and got["score"].max() > 1
    fits = detected(df, ("t", "u"), "v", "deviation", task="fit").collect()
    assert len(fits) == 89 and len({r["t"] for r in fits}) == 89


def test_local_medians_of_many_series_are_those_of_each():
    g = np.random.default_rng(3)
    ends = np.cumsum([*g.integers(1, 40, 200), 3000])
    starts = np.concatenate([[0], ends[:-1]])
    values = np.round(g.exponential(50, ends[-1]), 1)
    values[starts[4] : ends[4]], values[starts[9]] = 5.0, np.inf
    for width in (1, 4, 11, 1500):
        each = np.concatenate([residual_scores(values[a:b], width) for a, b in zip(starts, ends)])
        assert np.array_equal(residual_scores_of_many(values, starts, ends, width), each, equal_nan=True)


def test_series_go_on_in_the_next_batch():
    import pyarrow as pa

    keys = [None] * 3 + ["a"] * 11 + ["b", "c"] + ["d"] * 4
    table = pa.table({"t": pa.array(keys), "n": list(range(len(keys)))})
    got = [(rows.column("t")[int(i)].as_py(), n) for rows, starts in _whole_series(table.to_batches(max_chunksize=2), ("t",), 3) for i, n in zip(starts, np.diff([*starts, len(rows)]))]
    assert got == [(None, 3), ("a", 11), ("b", 1), ("c", 1), ("d", 4)]


def test_deviations_of_many_series_are_those_of_each():
    g = np.random.default_rng(4)
    ends = np.cumsum(g.integers(1, 300, 200))
    starts, values = np.concatenate([[0], ends[:-1]]), g.exponential(50, ends[-1])
    one = Deviation()
    assert one.fit_each(values, starts, ends) == [one.fit(values[a:b]) for a, b in zip(starts, ends)]

    class Alone(Deviation):
        def fit(self, values):
            return {"mean": 0.0, "sd": 1.0}

    assert Alone().fit_each(values, starts, ends) == [{"mean": 0.0, "sd": 1.0}] * 200
    counted = []
    one.fit = lambda values: counted.append(len(values))
    one.fit_each(values, starts, ends)
    assert counted == []

"""The engine's queries against SQL, and edge cases by hand."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.oracle import compare
from tidewell.functions import vectors as V
from tidewell.functions.scalar import FUNCTIONS, int_divide, int_modulo
from tidewell.model import Measurement
from tidewell.operators import aggregates as A
from tidewell.operators import geofence as fence
from tidewell.operators import joins as J
from tidewell.operators.fill import fill
from tidewell.plans import catalog
from tidewell.plans.sql import SqlError, parse, run_sql
from tidewell.sources.line_protocol import number, parse_lines

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.ORACLE))
def test_query_agrees_with_sql(spark, name):
    assert compare(spark, catalog.QUERIES[name], catalog.ORACLE[name], SF) == ""


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.fixture(scope="module")
def points(spark):
    frame = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 3.0), ("a", 10, 2.0), ("a", 30, None), ("b", 5, 7.0)], "tag string, time long, v double")
    return Measurement(frame, ("tag",), ("v",))


def by_tag(df):
    return {r["tag"]: r for r in df.collect()}


def test_ties_and_single_points(points):
    got = by_tag(points.frame.groupBy("tag").agg(A.first("v").alias("first"), A.last("v").alias("last"), A.stddev("v").alias("sd"), A.rate("v", 1).alias("rate")))
    assert (got["a"]["first"], got["a"]["last"]) == (3.0, 2.0)
    assert got["b"]["sd"] == 0.0 and got["b"]["rate"] is None


def test_nearest_rank_and_mode(points):
    assert by_tag(A.percentile(points, "v", 50, ("tag",)))["a"]["percentile"] == 2.0
    assert by_tag(A.mode(points, "v", ("tag",)))["a"]["mode"] in (1.0, 3.0)


def test_fill(spark):
    buckets = spark.createDataFrame([("a", 0, 1.0), ("a", 20, 3.0)], "tag string, time long, v double")
    got = lambda how: [r["v"] for r in fill(buckets, ("tag",), "v", 0, 40, 10, how).orderBy("time").collect()]
    assert got("null") == [1.0, None, 3.0, None]
    assert got(9.0) == [1.0, 9.0, 3.0, 9.0]
    assert got("previous") == [1.0, 1.0, 3.0, 3.0]
    assert got("linear") == [1.0, 2.0, 3.0, None]


def test_integer_division_by_zero(spark):
    row = spark.range(1).select(int_divide(F.lit(-7), F.lit(2)).alias("d"), int_divide(F.lit(1), F.lit(0)).alias("z"), int_modulo(F.lit(1), F.lit(0)).alias("m")).first()
    assert tuple(row) == (-3, 0, 0)


def test_scalar_edges(spark):
    f = FUNCTIONS
    row = spark.range(1).select(f["ln"](F.lit(0.0)), F.isnan(f["ln"](F.lit(-1.0))), f["round_to"](F.lit(2.5)), f["truncate"](F.lit(-2.7)), f["regexp_extract"](F.lit("abc"), "x"), f["split_part"](F.lit("a.b"), ".", -1), f["split"](F.lit("a.b"), "."), f["split_to_map"](F.lit("a=1,b,a=2"), ",", "="), f["strlen"](F.lit("é")), f["substr"](F.lit("abc"), 5), f["ip_to_domain"](F.lit("8.8.8.8")), f["ip_to_domain"](F.lit("x")), f["ip_mask"](F.lit("10.1.2.3"), 0)).first()
    assert tuple(row) == (float("-inf"), True, 3.0, -2.0, None, "", '["a","b"]', '{"a":"1","b":"","a":"2"}', 2, "", "internet", "invalid ip", "0.0.0.0")


def test_rate_with_reset(spark):
    samples = spark.createDataFrame([("a", t * 15_000_000, float(v)) for t, v in enumerate([0, 10, 20, 5, 15])], "l string, time long, value double")
    row = V.extrapolated(samples, ["l"], 60_000_000, 60_000_000, 60_000_000, 60_000_000, "increase").first()
    assert row["value"] == pytest.approx(35.0)


def test_min_over_time_skips_nan(spark):
    samples = spark.createDataFrame([("a", 0, float("nan")), ("a", 1, 2.0), ("b", 0, float("nan"))], "l string, time long, value double")
    got = {r["l"]: r["value"] for r in V.over_time(samples, ["l"], 10, 10, 10, 10, "max").collect()}
    assert got["a"] == 2.0 and got["b"] != got["b"]


def test_vector_division_by_zero(spark):
    a = spark.createDataFrame([("x", 0, 1.0), ("y", 0, 0.0)], "l string, time long, value double")
    b = spark.createDataFrame([("x", 0, 0.0), ("y", 0, 0.0)], "l string, time long, value double")
    got = {r["l"]: r["value"] for r in J.matched(a, b, ["l"], "/").collect()}
    assert got["x"] == float("inf") and got["y"] != got["y"]


def test_sql_errors():
    for text in ("SELECT", "SELECT mean(v) FROM m WHERE", "SELECT v FROM m LIMIT x ;;", "SELECT v FROM m GROUP BY time(1h) extra"):
        with pytest.raises(SqlError):
            parse(text)


def test_sql_offset_alone_is_limit_one(spark, points):
    assert run_sql("SELECT v FROM m ORDER BY time, v OFFSET 1", {"m": points}).count() == 1
    with pytest.raises(SqlError):
        run_sql("SELECT v FROM m GROUP BY time(1h)", {"m": points})
    got = run_sql("SELECT count(v) AS n FROM m WHERE tag =~ /^a/ AND time >= 0 AND time < 40 GROUP BY time(10u), tag", {"m": points})
    assert sorted((r["time"], r["n"]) for r in got.collect()) == [(0, 2), (10, 1), (20, 0), (30, 0)]


def test_line_protocol(spark):
    lines = spark.createDataFrame([('cpu,host=a\\ b,az=1 v=1.5,n=3i,s="x, y=z",ok=t 1000',), ("# note",), ("",), ("mem free=2",)], "value string")
    got = {r["measurement"]: r for r in parse_lines(lines).select("*", number(F.col("fields")["n"]).alias("n")).collect()}
    assert got["cpu"]["tags"] == {"host": "a b", "az": "1"} and got["cpu"]["time_ns"] == 1000 and got["cpu"]["n"] == 3.0
    assert got["cpu"]["fields"]["s"] == '"x, y=z"' and got["mem"]["tags"] == {} and got["mem"]["time_ns"] is None


@pytest.fixture(scope="module")
def doubled(spark, tmp_path_factory):
    """The events twice, with other keys at the same times."""
    folder = str(tmp_path_factory.mktemp("doubled"))
    once = spark.read.parquet(f"{SF}/events.parquet")
    once.unionByName(once.withColumn("event_id", F.col("event_id") + 1000).withColumn("user_id", F.col("user_id") + 15)).write.parquet(f"{folder}/events.parquet")
    for table in os.listdir(SF):
        if table != "events.parquet":
            os.symlink(f"{SF}/{table}", f"{folder}/{table}")
    return folder


def compare_events(spark, query, sql, folder):
    import duckdb

    from tests.oracle import rows_of

    db = duckdb.connect()
    db.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    df, found = query(spark, folder), db.execute(sql)
    ours, theirs = rows_of(df.columns, df.collect()), rows_of([d[0] for d in found.description], found.fetchall())
    return [*(ours - theirs).items(), *(theirs - ours).items()][:3]


@pytest.mark.parametrize("name", ["derivative", "non_negative_derivative"])
def test_derivative_of_equal_times_is_that_of_sql(spark, doubled, name):
    assert compare_events(spark, catalog.QUERIES[name], catalog.ORACLE[name], doubled) == []


def test_transforms_side_by_side_with_equal_times(spark, doubled):
    assert compare_events(spark, catalog.QUERIES["sql_raw_difference"], catalog.ORACLE["sql_raw_difference"], doubled) == []


def test_transforms_of_fields_with_nulls_side_by_side(spark):
    rows = [("a", 0, 1.0, 10.0), ("a", 1, None, 20.0), ("a", 2, 4.0, 50.0), ("a", 2, 4.0, 50.0), ("a", 3, 5.0, None), ("b", 0, 7.0, 1.0)]
    m = Measurement(spark.createDataFrame(rows, "t string, time long, v double, w double"), ("t",), ("v", "w"))
    got = run_sql("SELECT difference(v) AS d, elapsed(v) AS e, moving_average(w, 2) AS a, cumulative_sum(v) AS s FROM m GROUP BY t", {"m": m})
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([("a", 0, None, None, None, 1.0), ("a", 1, None, None, 15.0, None), ("a", 2, 3.0, 2, 35.0, 5.0), ("a", 2, 0.0, 0, 50.0, 9.0), ("a", 3, 1.0, 1, None, 14.0), ("b", 0, None, None, None, 7.0)], key=str)


def test_fences_are_measured_in_tasks_by_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(fence, "TASK_PAIRS", 500)
    monkeypatch.setattr(fence, "CELL_PAIRS", 300)
    at = lambda k: (F.lit(50.0) + F.col("id") * k % 97 / 40.0, F.lit(-180.5) + F.col("id") * k % 89 / 30.0)
    points = spark.range(400).select("id", at(37)[0].alias("lat"), at(11)[1].alias("lon"))
    radii = F.element_at(F.array(*(F.lit(float(r)) for r in (0, 1, 20_000, 90_000, 250_000, -5, 2e7, 3e7))), (F.col("id") % 8 + 1).cast("int"))
    fences = spark.range(80).select(F.col("id").alias("fence_id"), at(37)[0].alias("lat"), at(11)[1].alias("lon"), radii.alias("radius"))
    got = fence.in_fences(points, fences, cell=1.0)
    pair = points.crossJoin(fences.select("fence_id", F.col("lat").alias("flat"), F.col("lon").alias("flon"), "radius"))
    want = pair.where(fence.distance(F.col("lat"), F.col("lon"), F.col("flat"), F.col("flon")) <= F.col("radius")).select("id", "lat", "lon", "fence_id")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
    sizes = [n for n in got.rdd.glom().map(len).collect() if n]
    assert len(sizes) > 20 and max(sizes) < 0.2 * sum(sizes)

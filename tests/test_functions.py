import datetime as dt
import uuid

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slate.functions import calendar as cal
from slate.functions.keys import content_key, uuid5_from_text
from slate.functions.scoring import blended_score, empty_array_to_null, empty_to_null, rising_predicate, stat_lookup


def test_clock_to_24h(spark):
    data = [("7:30p",), ("12:00p",), ("12:15a",), ("1:05a",), ("19:00",), ("Start (ET)",), (None,), ("11:59p",)]
    df = spark.createDataFrame(data, "t string").select("t", cal.clock_to_24h("t").alias("h"))
    got = {r.t: r.h for r in df.collect()}
    assert got == {"7:30p": "19:30", "12:00p": "12:00", "12:15a": "00:15", "1:05a": "01:05", "19:00": "19:00",
                   "Start (ET)": "Start (ET)", None: None, "11:59p": "23:59"}


def test_clock_12h_round_trip(spark):
    df = spark.range(24 * 60).select((F.col("id") / 60).cast("int").alias("h"), (F.col("id") % 60).alias("m"))
    df = df.select("h", "m", cal.clock_to_24h(cal.clock_to_12h("h", "m")).alias("t"))
    for r in df.collect():
        assert r.t == f"{r.h:02d}:{r.m:02d}"


def test_parse_page_date(spark):
    df = spark.createDataFrame([("Tue, Oct 24, 2023",), ("Date",), (None,), ("Mon, Jan 1, 2024",)], "t string")
    got = {r.t: r.d for r in df.select("t", cal.parse_page_date("t").alias("d")).collect()}
    assert got == {"Tue, Oct 24, 2023": dt.date(2023, 10, 24), "Date": None, None: None,
                   "Mon, Jan 1, 2024": dt.date(2024, 1, 1)}


def test_calendar_edges(spark):
    df = spark.createDataFrame([(dt.date(2023, 10, 23),), (dt.date(2023, 10, 29),), (dt.date(2023, 12, 31),),
                                (dt.date(2024, 1, 1),), (dt.date(2024, 12, 31),)], "d date")
    out = {r.d: r for r in df.select("d", *[c.alias(n) for n, c in cal.calendar_columns("d").items()],
                                      cal.weekday_name(cal.day_of_week("d")).alias("name")).collect()}
    assert out[dt.date(2023, 10, 23)].day_of_week == 0 and out[dt.date(2023, 10, 23)].name == "Monday"
    assert out[dt.date(2023, 10, 29)].day_of_week == 6 and out[dt.date(2023, 10, 29)].name == "Sunday"
    assert out[dt.date(2023, 12, 31)].week == 52
    assert out[dt.date(2024, 1, 1)].week == 1
    assert out[dt.date(2024, 12, 31)].day_of_year == 366


def test_combine_date_time(spark):
    df = spark.createDataFrame([(dt.date(2023, 10, 24), "19:30"), (None, "19:30"), (dt.date(2023, 10, 24), "x")],
                               "d date, t string")
    got = [r.ts for r in df.select(cal.combine_date_time("d", "t").alias("ts")).collect()]
    assert got == [dt.datetime(2023, 10, 24, 19, 30), None, None]


def test_to_eastern(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 15, 12, 0),), (dt.datetime(2024, 7, 15, 12, 0),)],
                               "ts timestamp_ntz")
    got = [r.e for r in df.select(cal.to_eastern("ts").alias("e")).collect()]
    assert got == [dt.datetime(2024, 1, 15, 7, 0), dt.datetime(2024, 7, 15, 8, 0)]


def test_blended_score(spark):
    df = spark.createDataFrame([(10.0, 20.0, 30.0, 40.0), (10.0, None, 30.0, 40.0), (None, None, None, None)],
                               "avg_points double, avg_last_7 double, avg_last_15 double, avg_last_30 double")
    got = [round(r.s, 9) for r in df.select(blended_score().alias("s")).collect()]
    assert got == [20.0, 14.0, 0.0]


def test_rising_predicate(spark):
    df = spark.createDataFrame([(25.0, 19.0), (26.0, 20.0), (27.0, 20.0), (30.0, None)],
                               "avg_last_7 double, avg_last_30 double")
    got = [r.x for r in df.select(rising_predicate().alias("x")).collect()]
    assert got == [False, False, True, None]


def test_stat_lookup_and_empty_lists(spark):
    df = spark.createDataFrame(
        [({"2024_last_7": {"applied_avg": 3.5}}, ["OUT"], "[]"), ({}, [], "ACTIVE")],
        "stats map<string, struct<applied_avg: double>>, inj array<string>, txt string")
    got = df.select(stat_lookup("stats", 2024, "_last_7").alias("a"), stat_lookup("stats", 2024, "_last_30").alias("b"),
                    empty_array_to_null("inj").alias("i"), empty_to_null("txt").alias("t")).collect()
    assert [tuple(r) for r in got] == [(3.5, None, "OUT", None), (None, None, None, "ACTIVE")]


def test_uuid5_matches_python(spark):
    texts = ["abc1.5None", "", "Atlanta Hawks2024", "ümlaut-ß", "x" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.u for r in df.select("t", uuid5_from_text(F.col("t")).alias("u")).collect()}
    for t in texts:
        assert got[t] == str(uuid.uuid5(uuid.NAMESPACE_DNS, t))
    assert got["abc1.5None"] == "b354b742-30c0-53f5-99a8-c2eb7cf69dc5"


def test_content_key_renders_values_like_python(spark):
    df = spark.createDataFrame([("abc", 1.5, None, 7, True, dt.date(2024, 1, 2))],
                               "a string, b double, c string, d long, e boolean, f date")
    got = df.select(content_key(df, ignore_cols=["d"]).alias("k")).first().k
    expected = str(uuid.uuid5(uuid.NAMESPACE_DNS, "abc1.5NoneTrue2024-01-02"))
    assert got == expected


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=40), min_size=1,
                      max_size=20))
def test_uuid5_matches_python_on_any_text(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.u for r in df.select("i", uuid5_from_text(F.col("t")).alias("u")).collect()}
    assert got == {i: str(uuid.uuid5(uuid.NAMESPACE_DNS, t)) for i, t in enumerate(texts)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(dates=st.lists(st.dates(min_value=dt.date(1950, 1, 1), max_value=dt.date(2050, 12, 31)), min_size=1,
                      max_size=30))
def test_calendar_columns_equal_python_datetime(spark, dates):
    """ISO week, day of year and Monday=0 weekday, as Python's datetime computes them."""
    df = spark.createDataFrame([(d,) for d in dates], "d date")
    got = {r.d: (r.week, r.day_of_year, r.day_of_week)
           for r in df.select("d", *[c.alias(n) for n, c in cal.calendar_columns("d").items()]).collect()}
    assert got == {d: (d.isocalendar()[1], d.timetuple().tm_yday, d.weekday()) for d in dates}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(dates=st.lists(st.dates(min_value=dt.date(1990, 1, 1), max_value=dt.date(2040, 12, 31)), min_size=1,
                      max_size=20),
       junk=st.lists(st.text(max_size=12), max_size=5))
def test_parse_page_date_round_trips_and_nulls_junk(spark, dates, junk):
    """'Tue, Oct 24, 2023' text parses back to its date; anything else becomes NULL, never an error."""
    texts = [(f"{d:%a}, {d:%b} {d.day}, {d.year}", d) for d in dates]
    texts += [(j, None) for j in junk if not any(j == t for t, _ in texts)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string")
    got = {r.i: r.d for r in df.select("i", cal.parse_page_date("t").alias("d")).collect()}
    assert got == {i: d for i, (_, d) in enumerate(texts)}


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.floats(), st.floats(-1e-3, 1e-3), st.floats(-1e18, 1e18), st.integers(-10**17, 10**17).map(float),
                                 st.decimals(-10**6, 10**6, places=2).map(float)), min_size=1, max_size=40))
def test_content_key_of_doubles_matches_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r.i: r.k for r in df.select("i", content_key(df, ignore_cols=["i"]).alias("k")).collect()}
    assert got == {i: str(uuid.uuid5(uuid.NAMESPACE_DNS, str(v))) for i, v in enumerate(values)}


def test_content_key_of_known_doubles_and_timestamps(spark):
    doubles = [1e7, 12345678.5, 0.0001, 0.00001, 1e16, 9999999999999998.0, 1.5e-7, 2e23, 5e-324, -0.0, 0.0, 100.0, 1e22, 123456789012345680.0]
    times = [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 60), dt.datetime(1999, 12, 31)]
    df = spark.createDataFrame([(v, t) for v in doubles for t in times], "v double, t timestamp_ntz")
    got = [r.k for r in df.select(content_key(df).alias("k")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_DNS, f"{v}{t}")) for v in doubles for t in times]

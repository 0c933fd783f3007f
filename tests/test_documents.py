"""Hand-made rows for the odd cases of the table builders."""

from pyspark.sql import functions as F

from railweave.functions import text as tx
from railweave.operators import documents as doc
from railweave.operators import quality as ql
from railweave.operators import stations as st
from railweave.sources import tables as src


def one(df, c):
    return [r[c] for r in df.collect()]


def test_clean_and_helpers(spark):
    rows = spark.createDataFrame([(" x ",), ("nan",), ("",), (None,), ("NaT",)], "v string")
    assert one(rows.select(tx.clean("v").alias("v")), "v") == ["x", None, None, None, None]
    clock = spark.createDataFrame([("19.33",), ("First",), ("Last",), ("",)], "v string")
    assert one(clock.select(tx.format_clock("v").alias("v")), "v") == ["19:33", "First", "Last", None]
    assert one(spark.range(1).select(tx.seconds_to_hhmm(F.lit(86460)).alias("v")), "v") == ["00:01"]


def test_running_days(spark):
    days = ["1,1,1,1,1,1,1", "0,1,1,1,1,1,0", "1,0,0,0,0,0,1", "1,0,1,0,0,0,0", ""]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d string").orderBy("i")
    assert one(df.select(tx.running_days("d").alias("v")), "v") == ["Daily", "Weekdays", "Weekends", "Mon, Wed", "Unknown"]


def test_code_array(spark):
    df = spark.createDataFrame([(0, '["A","B"]'), (1, "[A,B]"), (2, '[A, "B"'), (3, "")], "i int, v string").orderBy("i")
    assert one(df.select(tx.code_array("v").alias("v")), "v") == [["A", "B"], ["A", "B"], ["A", "B"], []]


def test_delay_forms(spark):
    forms = {"12": 12, "-3": 0, "on time": 0, "01:20 late 5": 1, "about 7 min": 7, "": 0, "5.9": 5, "none": 0}
    df = spark.createDataFrame(list(forms.items()), "v string, want int").withColumn("got", tx.delay_minutes("v"))
    assert all(r.got == r.want for r in df.collect())


def test_station_dim(spark):
    info = spark.createDataFrame([(0, "AA", "", "X", "1"), (1, "BB", "Beta", "Y", "0"), (2, "BB", "Beta New", "Y", "0")],
                                 "row_id long, station_code string, title string, city string, wifi_station string")
    zones = spark.createDataFrame([(0, "AA", "Z", None, "Alpha"), (1, "CC", "Z", None, "Gone")],
                                  "row_id long, station_code string, zone string, zone_name string, station_name string")
    aka = spark.createDataFrame([(0, "AA", "Al"), (1, "AA", "Al"), (2, "AA", "Alpha"), (3, "DD", "Delta"), (4, "DD", "Del")],
                                "row_id long, station_code string, title string")
    got = {r.code: (r.name, r.zone, r.wifi, r.aka, r.in_info) for r in st.station_dim(info, zones, aka).collect()}
    assert got == {"AA": ("Alpha", "Z", True, ["Al"], True), "BB": ("Beta New", None, False, [], True), "DD": ("Delta", None, False, ["Del"], False)}


def test_route_documents_need_two_stops(spark):
    stop = '{"station_code":"%s","arrival":"First","departure":"10:00","halt_minutes":0,"distance_km":0.0,"day":1%s}'
    two = "[" + stop % ("AA", "") + "," + stop % ("BB", ',"is_stopping":false') + "]"
    routes = spark.createDataFrame([(0, "1", two), (1, "2", "[" + stop % ("AA", "") + "]"), (2, "3", "not json"), (3, "4", None), (4, None, two)],
                                   "row_id long, train_number string, stops string").withColumn("total_stops", F.lit(None).cast("string"))
    dim = spark.createDataFrame([("AA", "Alpha")], "code string, name string")
    info = spark.createDataFrame([(0, "1", "Daily"), (1, "1", "Mon")], "row_id long, train_number string, running_days_text string")
    rows = doc.route_documents(routes, dim, info).collect()
    assert [r.content for r in rows] == ["Train 1 route from Alpha (AA) to BB. Runs on: Mon. Station sequence: Alpha (AA). Schedule: Alpha (AA), dep 10:00, day 1."]
    assert rows[0].total_stops == 2


def test_missing_parts_leave_no_trace(spark):
    rules = spark.createDataFrame([("Fares", None, "T", "nan")], "category string, sub_category string, rule_title string, rule_description string")
    assert one(doc.rule_documents(rules), "content") == ["[Railway Rule - Fares] T."]
    trains = spark.createDataFrame([("1", "A", None), ("2", "A", "B")], "train_number string, src_station_code string, dest_station_code string")
    assert one(doc.train_documents(trains), "train_no") == ["2"]


def test_log_without_live_calls(spark):
    log = spark.createDataFrame([("q", 1.0, None, False, False, [])],
                                "question string, response_time_ms double, error string, live_api_used boolean, live_api_success boolean, validation_warnings array<string>")
    row = ql.query_stats(log).first()
    assert row.live_api_success_rate_pct == 0.0 and row.total_queries == 1


def test_answer_with_leading_zero(spark):
    df = spark.createDataFrame([("Take 07201", "Train 7201", None), ("Take 07202", "Train 7201", None), ("Take 12345", "", "12345")], "answer string, context string, train_no string")
    assert [len(w) for w in one(ql.validate_answers(df), "warnings")] == [0, 1, 0]


def test_missing_path_gives_empty_table(spark, tmp_path):
    assert src.read_table(spark, str(tmp_path / "nothing"), "a string, b int").count() == 0


def test_csv_keeps_leading_zeros(spark, tmp_path):
    (tmp_path / "t.csv").write_text('no,stops\n00123,"[""A"",""B""]"\nnan,\n')
    rows = src.read_table(spark, str(tmp_path / "t.csv"), "no string, stops string").collect()
    assert [(r.no, r.stops) for r in rows] == [("00123", '["A","B"]'), (None, None)]

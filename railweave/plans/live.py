"""Queries over live-status and booking payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from railweave import fixed_values as fv
from railweave.functions import text as tx
from railweave.operators import live as lv
from railweave.plans.registry import query

_STATUS = dict(
    last_departed="""
    SELECT order_key, arg_max(departure_delay_minutes, seq) AS d FROM {status_stops} WHERE status = 'departed' GROUP BY order_key""",
    normal="""
    SELECT s.*, delay AS eff, upper(substr(train_name, 1, 1)) || lower(substr(train_name, 2)) AS nice_name, CASE WHEN current_station IS NULL THEN '' ELSE src_name END AS at_station,
           CASE WHEN position <> '' THEN position WHEN delay = 0 THEN 'Running on time' ELSE delay || ' min late' END AS status_text
    FROM (SELECT r.*, src_name, CASE WHEN delay_minutes = 0 AND d IS NOT NULL THEN d ELSE delay_minutes END AS delay
          FROM {status_rows} r LEFT JOIN {last_departed} l ON l.order_key = r.order_key JOIN {ends} e ON e.order_key = r.order_key) s""",
    timeline="""
    SELECT order_key, seq, station_name AS name, platform, CASE WHEN arrival = 'First' THEN 'origin' ELSE arrival END AS scheduled_time,
           CASE WHEN departure = 'Last' THEN 'terminus' ELSE departure END AS actual_time,
           CASE WHEN departure_delay_minutes > 0 THEN departure_delay_minutes || ' min late' WHEN arrival_delay_minutes > 0 THEN arrival_delay_minutes || ' min late' ELSE 'On Time' END AS delay,
           status FROM {status_stops}""")


@query("live01_normalise_status", """
    SELECT train_no, nice_name AS train_name, at_station AS current_station, eff AS delay_minutes, status_text AS status, progress_percent, n AS stops
    FROM {normal} s JOIN (SELECT order_key, count(*) AS n FROM {timeline} GROUP BY order_key) t ON t.order_key = s.order_key""", **_STATUS)
def _(r):
    out = lv.normalise_status(r.status_payloads())
    return out.select("train_no", "train_name", "current_station", "delay_minutes", "status", "progress_percent", F.size("stations_timeline").alias("stops"))


@query("live02_effective_delay", "SELECT train_no, eff AS delay_minutes FROM {normal}", **_STATUS)
def _(r):
    p = r.status_payloads().withColumn("p", F.from_json("payload", lv.STATUS_PAYLOAD))
    return p.select("train_no", lv.effective_delay(tx.delay_minutes("p.delay_minutes"), F.col("p.stations")).alias("delay_minutes"))


@query("live03_stop_timeline", """
    SELECT cast(10000 + order_key as varchar) AS train_no, seq, name, platform, scheduled_time, actual_time, delay, status FROM {timeline}""", **_STATUS)
def _(r):
    out = lv.normalise_status(r.status_payloads()).select("train_no", F.posexplode("stations_timeline").alias("seq", "stop"))
    return out.select("train_no", (F.col("seq") + 1).alias("seq"), *[f"stop.{c}" for c in ("name", "platform", "scheduled_time", "actual_time", "delay", "status")])


@query("live04_parse_status_page", """
    SELECT r.train_no, train_name, CASE WHEN o_orderstatus = 'P' THEN 'Station Info Loaded' ELSE src_name END AS current_station,
           CASE o_orderstatus WHEN 'F' THEN 60 + total_stops WHEN 'O' THEN total_stops ELSE 0 END AS delay_minutes,
           CASE o_orderstatus WHEN 'F' THEN 'Departed from ' || src_name || ' (' || src_code || ') Delay: 01:' || lpad(cast(total_stops as varchar), 2, '0')
                WHEN 'O' THEN 'Arrived at ' || src_name || ' (X) Delay: ' || total_stops || ' Min' ELSE 'Running status parsed successfully.' END AS status
    FROM {status_rows} r JOIN {ends} e ON e.order_key = r.order_key""")
def _(r):
    return lv.parse_status_page(r.status_pages()).select("train_no", "train_name", "current_station", "delay_minutes", "status")


@query("live04_parse_status_page_stops", """
    SELECT train_no, seq, station_name AS name, station_code AS code, platform, replace(arr, '.', ':') AS scheduled_time, replace(dep, '.', ':') AS actual_time,
           CASE WHEN day > 1 THEN day || ' Min late' ELSE 'On Time' END AS delay FROM {stops}""")
def _(r):
    out = lv.parse_status_page(r.status_pages()).select("train_no", F.posexplode("stations_timeline").alias("seq", "stop"))
    return out.select("train_no", (F.col("seq") + 1).alias("seq"), *[f"stop.{c}" for c in ("name", "code", "platform", "scheduled_time", "actual_time", "delay")])


@query("live04_page_lines", """
    SELECT page_id, len(list_filter(list_transform(regexp_split_to_array(plain, '\\r\\n|\\n|\\r'), lambda x: trim(x)), lambda x: x <> '')) AS lines, length(plain) AS chars
    FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b.*?</(?:script|style)\\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]*>', '', 'g') AS plain FROM {pages})""")
def _(r):
    """Text lines of the raw web pages; the length is taken before entities are decoded."""
    raw = lv.strip_tags(F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</(?:script|style)\s*>", ""), r"(?s)<!--.*?-->", ""))
    return r.pages.select("page_id", F.size(lv.page_lines("html")).alias("lines"), F.length(raw).alias("chars"))


_DELAY_TEXT = """CASE event_type WHEN 'click' THEN cast(value as varchar) WHEN 'view' THEN 'about ' || k || ' min late' WHEN 'error' THEN 'Right Time' WHEN 'signup' THEN '-' || k END"""


@query("live05_parse_delay", """
    SELECT event_id, CASE event_type WHEN 'click' THEN cast(floor(value) as int) WHEN 'view' THEN cast(k as int) ELSE 0 END AS delay
    FROM (SELECT *, regexp_extract(props, '(\\d+)', 1) AS k FROM {events})""")
def _(r):
    k = F.regexp_extract("props", r"(\d+)", 1)
    e = F.col("event_type")
    text = (F.when(e == "click", F.col("value").cast("string")).when(e == "view", F.concat(F.lit("about "), k, F.lit(" min late")))
            .when(e == "error", "Right Time").when(e == "signup", F.concat(F.lit("-"), k)))
    return r.events.select("event_id", tx.delay_minutes(text).alias("delay"))


@query("live06_first_success", """
    SELECT user_id, event_id, value, event_id IS NOT NULL AS success, CASE WHEN event_id IS NULL THEN 'all sources failed' END AS error
    FROM (SELECT user_id, arg_min(event_id, event_id) FILTER (WHERE event_type = 'purchase' AND value > 10) AS event_id,
                 arg_min(value, event_id) FILTER (WHERE event_type = 'purchase' AND value > 10) AS value FROM {events} GROUP BY user_id)""")
def _(r):
    tries = r.events.select("user_id", "event_id", "value", F.col("event_id").alias("priority"), ((F.col("event_type") == "purchase") & (F.col("value") > 10)).alias("success"))
    return lv.first_success(tries, "user_id").select("user_id", "event_id", "value", "success", "error")


@query("live07_latest_within_ttl", """
    SELECT client, request_id, CASE WHEN fresh THEN v END AS value, coalesce(fresh, false) AS from_cache, CASE WHEN fresh THEN age // 1000000 END AS age_seconds
    FROM (SELECT *, age < 21600000000 AS fresh FROM (
        SELECT r.client, r.request_id, o.value AS v, epoch_us(r.ts) - epoch_us(o.ts) AS age
        FROM (SELECT * FROM {requests} WHERE event_type = 'view') r ASOF LEFT JOIN (SELECT * FROM {requests} WHERE event_type IN ('click', 'purchase')) o
        ON r.client = o.client AND r.ts >= o.ts))""")
def _(r):
    req = r.requests
    asked = req.where(F.col("event_type") == "view").select("client", "request_id", "ts")
    seen = req.where(F.col("event_type").isin("click", "purchase")).select("client", "ts", "value")
    return lv.latest_within_ttl(asked, seen, 21600, key="client").drop("ts")


@query("live08_status_summary", """
    SELECT train_no, '=== LIVE TRAIN STATUS (Source: RapidAPI | Fetched: ' || replace(substr(cast(fetched_at as varchar), 1, 16), ' ', 'T') || ' IST) ===' || chr(10)
           || 'Train: ' || train_no || ' - ' || nice_name || chr(10)
           || CASE WHEN at_station = '' THEN 'Running Status: REAL-TIME LOCATION UNAVAILABLE' || chr(10) || 'Note: Only schedule data returned - no live GPS tracking.'
                   ELSE 'Current Location: ' || at_station || chr(10) || 'Journey Progress: ' || progress_percent || '% of route completed' || chr(10) || 'Position Detail: ' || status_text || chr(10)
                        || CASE WHEN eff = 0 THEN 'Delay: ON TIME' ELSE 'Delay: ' || eff || ' MINUTES LATE' END END
           || coalesce(chr(10) || chr(10) || 'Recently Passed Stations (last 3):' || chr(10) || passed, '')
           || coalesce(chr(10) || chr(10) || 'Upcoming Stations (next 5):' || chr(10) || ahead, '') || chr(10) || repeat('=', 50) AS summary
    FROM {normal} s LEFT JOIN (
        SELECT order_key, string_agg('  [PASSED] ' || name || ' | Platform ' || platform || ' | Departed: ' || actual_time || ' | ' || delay, chr(10) ORDER BY seq) FILTER (WHERE status = 'departed' AND back <= 3) AS passed,
               string_agg('  [NEXT] ' || name || ' | Platform ' || platform || ' | Scheduled Arrival: ' || scheduled_time
                          || CASE WHEN delay <> 'On Time' THEN ' | Expected delay: ' || delay ELSE ' | On time' END, chr(10) ORDER BY seq) FILTER (WHERE status <> 'departed' AND fwd <= 5) AS ahead
        FROM (SELECT *, row_number() OVER (PARTITION BY order_key, status = 'departed' ORDER BY seq DESC) AS back,
                     row_number() OVER (PARTITION BY order_key, status = 'departed' ORDER BY seq) AS fwd FROM {timeline}) GROUP BY order_key) t ON t.order_key = s.order_key""", **_STATUS)
def _(r):
    return lv.status_summary(lv.normalise_status(r.status_payloads())).select("train_no", "summary")


@query("live09_station_board", """
    SELECT station_code, 'ARR' AS board_type, row_number() OVER (PARTITION BY station_code ORDER BY minutes, train_no, seq) - 1 AS board_position, train_no, seq, time
    FROM (SELECT station_code, train_no, seq, replace(arrival, '.', ':') AS time, cast(substr(arrival, 1, 2) as int) * 60 + cast(substr(arrival, 4, 2) as int) AS minutes
          FROM {stops} WHERE arrival <> 'First')""")
def _(r):
    return lv.station_board(r.stops, "ARR")


_BOOKINGS = dict(bookings="""
    SELECT o_orderkey, lpad(cast(o_orderkey as string), 10, '8') AS pnr, o_orderstatus, o_orderpriority, cast(10000 + o_orderkey as varchar) AS train_no, c_name, c_mktsegment, src_name, dst_name, pax,
           cast(o_orderdate as timestamp) AS fetched_at
    FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {ends} ON order_key = o_orderkey
    JOIN (SELECT order_key AS k, string_agg(seq || ':CNF:' || CASE WHEN is_stopping THEN 'CNF' ELSE 'RAC' END || ':S' || day || ':' || halt_min, '|' ORDER BY seq) AS pax FROM {stops} GROUP BY order_key) p ON p.k = o_orderkey""")


def _passengers(name):
    """Passenger list of a booking, with the key names of one shape."""
    b, c, coach, berth = name
    return F.transform("people", lambda p: F.struct(
        p["seq"].alias("seq"), F.lit("CNF").alias(b), F.when(p["is_stopping"], "CNF").otherwise("RAC").alias(c),
        F.concat(F.lit("S"), p["day"].cast("string")).alias(coach), p["halt_min"].alias(berth)))


def _booking_base(r):
    shapes = {"a": ("bookingStatus", "currentStatus", "coachId", "seatNo"), "b": ("BookingStatus", "CurrentStatus", "Coach", "Berth"),
              "c": ("bookingStatusDetails", "currentStatusDetails", "coachId", "seatNo")}
    o = r.orders.join(r.customer, F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed("o_orderkey", "order_key")
    # each shape lists the same people, who are gathered once
    return (o.join(r.trains(people=["is_stopping", "day", "halt_min"]), "order_key")
            .withColumns({f"pax_{k}": _passengers(n) for k, n in shapes.items()}).drop("people")
            .withColumn("pnr", F.lpad(F.col("order_key").cast("string"), 10, "8")).withColumn("train_no", (F.col("order_key") + 10000).cast("string"))
            .withColumn("fetched_at", F.col("o_orderdate").cast("timestamp")).withColumn("source", F.lit("api")))


def _booking_payloads(r):
    b = _booking_base(r)
    ok = F.col("o_orderpriority") != "5-LOW"
    shape_a = F.to_json(F.struct(ok.alias("success"), F.struct(
        F.col("train_no").alias("trainNumber"), F.col("c_name").alias("trainName"), F.lit("01-01-2026").alias("dateOfJourney"), F.col("c_mktsegment").alias("journeyClass"),
        F.col("src_name").alias("from"), F.col("dst_name").alias("to"), F.lit(True).alias("chartPrepared"), F.col("pax_a").alias("passengerList")).alias("data")))
    shape_b = F.to_json(F.struct(F.col("pnr").alias("Pnr"), F.col("train_no").alias("TrainNo"), F.col("c_name").alias("TrainName"), F.lit("01-01-2026").alias("Doj"),
                                 F.col("c_mktsegment").alias("Class"), F.col("src_name").alias("From"), F.col("dst_name").alias("To"), F.col("src_name").alias("BoardingPoint"),
                                 F.lit(False).alias("ChartPrepared"), F.col("pax_b").alias("PassengerList")))
    shape_c = F.to_json(F.struct(F.col("pnr").alias("pnrNumber"), F.col("train_no").alias("trainNumber"), F.col("c_name").alias("trainName"), F.lit("01-01-2026").alias("dateOfJourney"),
                                 F.col("c_mktsegment").alias("ticketClass"), F.col("src_name").alias("boardingStationName"), F.col("dst_name").alias("reservedUptoName"),
                                 F.lit(False).alias("chartPrepared"), F.col("pax_c").alias("passengerList")))
    payload = F.when(F.col("o_orderstatus") == "F", shape_a).when(F.col("o_orderstatus") == "O", shape_b).otherwise(shape_c)
    return b.select("pnr", "source", "fetched_at", payload.alias("payload"))


def _pax_text():
    return F.array_join(F.transform("passengers", lambda p: F.concat_ws(":", p["passenger_no"].cast("string"), p["booking_status"], p["current_status"], p["coach"], p["berth"].cast("string"))), "|")


@query("live10_normalise_booking", """
    SELECT pnr, train_no, c_name AS train_name, '01-01-2026' AS date_of_journey, c_mktsegment AS booking_class, src_name AS from_station, dst_name AS to_station,
           src_name AS boarding_station, o_orderstatus = 'F' AS chart_prepared, pax AS passengers FROM {bookings} WHERE o_orderstatus <> 'F' OR o_orderpriority <> '5-LOW'""", **_BOOKINGS)
def _(r):
    out = lv.normalise_booking(_booking_payloads(r)).withColumn("passengers", _pax_text())
    return out.drop("success", "source", "fetched_at")


@query("live11_parse_piped_booking", """
    SELECT pnr, train_no, c_name AS train_name, '2026-01-01' AS date_of_journey, c_mktsegment AS booking_class, src_name AS from_station, dst_name AS to_station
    FROM {bookings} WHERE o_orderstatus = 'F'""", **_BOOKINGS)
def _(r):
    b = _booking_base(r)
    piped = F.concat_ws("|", F.when(F.col("o_orderstatus") == "P", "none").otherwise(F.concat(F.lit(" "), "train_no")), F.concat("c_name", F.lit(" ")), F.lit("2026-01-01"), "src_name", "dst_name",
                        F.when(F.col("o_orderstatus") != "O", F.concat(F.col("c_mktsegment"), F.lit("|x"))))
    return (lv.parse_piped_booking(b.select("pnr", "fetched_at", piped.alias("payload")))
            .select("pnr", "train_no", "train_name", "date_of_journey", "booking_class", "from_station", "to_station"))


def _booking_pages(r):
    b = _booking_base(r)
    item = lambda p: F.concat(
        F.lit('<li class="x PNRPasList"><span class="paxListCount">'), p["seq"].cast("string"), F.lit('.</span><p class="statusType"> '), p["bookingStatus"],
        F.lit(' </p><p class="statusType">'), p["currentStatus"], F.lit('</p><p class="statusType">'), p["coachId"], F.lit("/"), p["seatNo"].cast("string"), F.lit("</p></li>\n"))
    row = lambda p: F.concat(F.lit("<tr><td>Passenger "), p["seq"].cast("string"), F.lit("</td><td>CNF</td><td>"), p["currentStatus"], F.lit(" "), p["coachId"], F.lit(" "),
                             p["seatNo"].cast("string"), F.lit("</td></tr>\n"))
    modern = F.concat(F.lit('<html><div class="train-info"><p>TRAIN NAME : '), "train_no", F.lit(" – "), "c_name", F.lit('</p></div>\n<div class="train-route"><span class="pnr-bold-txt">'), "src_name",
                      F.lit('</span><span class="pnr-bold-txt">'), "dst_name", F.lit('</span></div>\n<div class="boarding-detls"><span class="pnr-bold-txt">01-Jan-2026</span><span class="pnr-bold-txt">'),
                      "c_mktsegment", F.lit('</span></div>\n<p class="chart-status-txt">Chart prepared</p>\n<ul>'), F.array_join(F.transform("pax_a", item), ""), F.lit("</ul></html>"))
    plain = F.concat(F.lit("<html><p>Train No: "), "train_no", F.lit(" - "), "c_name", F.lit("\n</p><p>Date of Journey: 1-Jan-2026</p><p>Chart not prepared</p>\n<table>"),
                     F.array_join(F.transform("pax_a", row), ""), F.lit("</table></html>"))
    page = F.when(F.col("o_orderstatus") == "F", modern).when(F.col("o_orderstatus") == "O", plain).otherwise("<html>try later</html>")
    return b.select("pnr", "fetched_at", page.alias("payload"))


@query("live12_parse_booking_page", """
    SELECT pnr, train_no, c_name AS train_name, CASE WHEN o_orderstatus = 'F' THEN '01-Jan-2026' ELSE '1-Jan-2026' END AS date_of_journey,
           CASE WHEN o_orderstatus = 'F' THEN c_mktsegment ELSE '' END AS booking_class, CASE WHEN o_orderstatus = 'F' THEN src_name ELSE '' END AS from_station,
           CASE WHEN o_orderstatus = 'F' THEN dst_name ELSE '' END AS to_station, o_orderstatus = 'F' AS chart_prepared,
           CASE WHEN o_orderstatus = 'F' THEN pax ELSE regexp_replace(pax, ':(CNF|RAC):S(\\d+):(\\d+)', ':\\1 S\\2 \\3:S\\2:\\3', 'g') END AS passengers
    FROM {bookings} WHERE o_orderstatus <> 'P'""", **_BOOKINGS)
def _(r):
    out = lv.parse_booking_page(_booking_pages(r)).withColumn("passengers", _pax_text())
    return out.select("pnr", "train_no", "train_name", "date_of_journey", "booking_class", "from_station", "to_station", "chart_prepared", "passengers")


@query("live13_booking_summary", """
    SELECT pnr, '=== LIVE PNR STATUS (Source: api | Fetched: ' || replace(substr(cast(fetched_at as varchar), 1, 16), ' ', 'T') || ' IST) ===' || chr(10) || 'PNR: ' || pnr || chr(10)
           || 'Train: ' || train_no || ' - ' || c_name || chr(10) || 'Date of Journey: 01-01-2026' || chr(10) || 'Booking Class: ' || c_mktsegment || chr(10)
           || 'Route: ' || src_name || ' -> ' || dst_name || ' (Boarding: ' || src_name || ')' || chr(10) || 'Chart Status: ' || CASE WHEN o_orderstatus = 'F' THEN 'PREPARED ✅' ELSE 'NOT PREPARED ⚠️' END || chr(10)
           || chr(10) || 'Passenger Details:' || chr(10) || regexp_replace(replace(pax, '|', chr(10)), '(\\d+):CNF:(CNF|RAC):(S\\d+):(\\d+)',
              '  - Passenger \\1: Booking Status: CNF | Current Status: \\2 (Coach: \\3, Berth: \\4)', 'g') || chr(10) || repeat('=', 50) AS summary
    FROM {bookings} WHERE o_orderstatus <> 'F' OR o_orderpriority <> '5-LOW'""", **_BOOKINGS)
def _(r):
    return lv.booking_summary(lv.normalise_booking(_booking_payloads(r))).select("pnr", "summary")


@query("live14_parse_schedule_text", """
    SELECT conv_id || '-' || turn AS train_no, 'Schedule data only (no live position from erail.in)' AS status, substr(text, 1, 300) AS raw_schedule
    FROM {conversations} WHERE trim(text) <> '' AND role <> 'system'""")
def _(r):
    texts = r.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("train_no"), F.when(F.col("role") != "system", F.col("text")).otherwise("  ").alias("payload"),
                                   F.lit(None).cast("timestamp").alias("fetched_at"))
    return lv.parse_schedule_text(texts, chars=fv.PREVIEW_CHARS).select("train_no", "status", "raw_schedule")


@query("live14_schedule_whole_text", "SELECT conv_id || '-' || turn AS train_no, text AS raw_schedule FROM {conversations} WHERE trim(text) <> ''")
def _(r):
    texts = r.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("train_no"), F.col("text").alias("payload"), F.lit(None).cast("timestamp").alias("fetched_at"))
    return lv.parse_schedule_text(texts).select("train_no", "raw_schedule")


@query("live15_valid_key", """
    SELECT o_orderkey, regexp_matches(pnr, '^[0-9]{10}$') AS valid, CASE WHEN NOT regexp_matches(pnr, '^[0-9]{10}$') THEN 'Invalid PNR format. Must be a 10-digit number.' END AS error
    FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN cast(o_orderkey as varchar) ELSE lpad(cast(o_orderkey as varchar), 10, '8') END AS pnr FROM {orders})""")
def _(r):
    key = F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey").cast("string")).otherwise(F.lpad(F.col("o_orderkey").cast("string"), 10, "8"))
    return lv.check_booking_keys(r.orders.withColumn("pnr", key)).select("o_orderkey", "valid", "error")

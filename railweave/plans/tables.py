"""Queries over sources, sinks and document builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from railweave import fixed_values as fv
from railweave.functions import text as tx
from railweave.functions.runtime import scratch_path
from railweave.operators import documents as doc
from railweave.operators import quality as ql
from railweave.operators import stations as st
from railweave.plans.registry import query
from railweave.sources import tables as src

# ------------------------------------------------------------------ sources, sinks


@query("src01_read_table", """
    SELECT cast(c_custkey as varchar) AS c_custkey, c_name, c_mktsegment, c_acctbal FROM {customer}""")
def _(r):
    """Customer written as CSV and read back with a fixed schema."""
    path = scratch_path(r.spark, "customer-csv")
    r.customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal").write.option("header", True).csv(path)
    schema = "c_custkey string, c_name string, c_mktsegment string, c_acctbal double"
    return src.read_table(r.spark, path, schema)


_LOG_CHECK = """
    SELECT question, intent, response_time_ms, coalesce(error, '') AS error, live_api_used, live_api_success,
           CASE WHEN flagged THEN 1 ELSE 0 END AS warnings FROM {query_log}"""


def _log(r):
    warnings = F.when(F.col("flagged"), F.array(F.lit("check numbers")))
    return r.query_log.withColumn("ts", F.col("ts").cast("string")).withColumn("validation_warnings", warnings)


def _written_log(r):
    path = scratch_path(r.spark, "query-log")
    src.append_query_log(_log(r), path)
    return src.read_query_log(r.spark, path)


@query("src02_read_query_log", _LOG_CHECK)
def _(r):
    return _written_log(r).select("question", "intent", "response_time_ms", F.coalesce("error", F.lit("")).alias("error"),
                                  "live_api_used", "live_api_success", F.size("validation_warnings").alias("warnings"))


@query("src03_append_query_log", """
    SELECT substr(text, 1, 200) AS question, 'unknown' AS source, false AS live_api_used, 0 AS warnings, 2 AS copies
    FROM {documents}""")
def _(r):
    """Long questions are cut as published; two appends leave both in the log."""
    path = scratch_path(r.spark, "append-log")
    records = r.documents.select(F.col("doc_id").cast("string").alias("train_no"), F.col("text").alias("question"))
    src.append_query_log(records, path, chars=fv.LOG_QUESTION_CHARS)
    src.append_query_log(records, path, chars=fv.LOG_QUESTION_CHARS)
    return (src.read_query_log(r.spark, path).groupBy("train_no", "question", "source", "live_api_used", F.size("validation_warnings").alias("warnings"))
            .agg(F.count(F.lit(1)).cast("int").alias("copies")).drop("train_no"))


def _collections(r):
    return r.documents.select(F.col("lang").alias("collection"), "doc_id", F.col("text").alias("content"), "source")


@query("src04_read_collection", "SELECT doc_id, lang AS collection, source FROM {documents} WHERE lang = 'en'")
def _(r):
    path = scratch_path(r.spark, "collections")
    src.write_collection(_collections(r), path)
    return src.read_collection(r.spark, path, "en").select("doc_id", "collection", "source")


@query("src05_write_collection", """
    SELECT lang AS collection, count(*) AS documents, cast(sum(length(text)) as bigint) AS chars FROM {documents} GROUP BY lang""")
def _(r):
    """All collections are written; one of them is then replaced by itself, the others stay."""
    path = scratch_path(r.spark, "collections")
    df = _collections(r)
    src.write_collection(df, path)
    src.write_collection(df.where(F.col("collection") == "fr"), path)
    return (src.read_collection(r.spark, path).groupBy("collection")
            .agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("content")).alias("chars")))


@query("src06_append_missing", """
    SELECT lang AS collection, count(*) AS documents, count(DISTINCT doc_id) AS ids FROM {documents} GROUP BY lang""")
def _(r):
    """The labelled documents are stored, then all are appended twice."""
    path = scratch_path(r.spark, "collections")
    df = _collections(r)
    src.write_collection(df.join(r.labels, "doc_id", "left_semi"), path)
    src.append_missing(df, path)
    src.append_missing(df, path)
    return (src.read_collection(r.spark, path).groupBy("collection")
            .agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("doc_id").alias("ids")))


@query("src07_page_table", """
    SELECT p_partkey, p_name, (SELECT count(*) FROM {part}) AS total FROM {part} ORDER BY p_partkey LIMIT 100 OFFSET 50""")
def _(r):
    return src.page_table(r.part, "p_partkey", limit=100, offset=50).select("p_partkey", "p_name", "total")


@query("src07_deep_page", """
    SELECT l_orderkey, l_linenumber, l_partkey, (SELECT count(*) FROM {lineitem}) AS total FROM {lineitem}
    ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 100 OFFSET (SELECT count(*) * 5 // 6 FROM {lineitem})""")
def _(r):
    """A page behind five sixths of the order lines."""
    n = r.lineitem.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return src.page_table(r.lineitem, ["l_orderkey", "l_linenumber", "l_partkey"], 100, n * 5 // 6).select("l_orderkey", "l_linenumber", "l_partkey", "total")


@query("src08_point_lookup", "SELECT * FROM (SELECT station_code, title, city FROM {station_info} WHERE upper(station_code) = 'AABC' ORDER BY row_id LIMIT 1)")
def _(r):
    return src.point_lookup(r.station_info, "station_code", "aabc", first_by="row_id").select("station_code", "title", "city")


@query("src09_list_all", "SELECT item_id, text, (SELECT count(*) FROM {benchmark}) AS total FROM {benchmark}")
def _(r):
    return src.list_all(r.benchmark)


@query("src10_read_eval_set", """
    SELECT text AS question, len(string_split(text, ' ')) AS keywords, 'benchmark' AS category, 'STATIC' AS intent FROM {benchmark}""")
def _(r):
    """Cases written as JSON arrays, one per file, and read back."""
    path = scratch_path(r.spark, "eval-set")
    case = F.struct(F.col("text").alias("question"), F.split("text", " ").alias("expected_keywords"),
                    F.lit("benchmark").alias("category"), F.lit("STATIC").alias("intent"))
    arrays = r.benchmark.groupBy(F.floor(F.col("item_id") / 64).alias("part")).agg(F.to_json(F.collect_list(case)).alias("value"))
    arrays.repartition("part").write.partitionBy("part").text(path)
    return src.read_eval_set(r.spark, path).select("question", F.size("expected_keywords").alias("keywords"), "category", "intent")


@query("src11_write_eval_report", """
    SELECT round(avg(CASE WHEN quality = 1 - toxic THEN 1.0 ELSE 0.0 END), 4) AS accuracy,
           cast(sum(CASE WHEN quality = 1 - toxic THEN 1 ELSE 0 END) as bigint) AS correct, count(*) AS total FROM {labels}""")
def _(r):
    path = scratch_path(r.spark, "eval-report")
    cases = r.labels.select(F.col("quality").cast("string").alias("expected"), (1 - F.col("toxic")).cast("string").alias("actual"))
    src.write_eval_report(ql.intent_accuracy(cases), path)
    return r.spark.read.schema("accuracy double, correct bigint, total bigint").json(path)


@query("src12_slice_rows", "SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS n FROM {customer}) WHERE n > 735 AND n <= 775")
def _(r):
    return src.slice_rows(r.customer, "c_custkey", 735, 775).select("c_custkey", "c_name")


# --------------------------------------------------------------- document builders


@query("doc01_clean_nulls", """
    SELECT train_number, nullif(train_name, 'nan') AS train_name, nullif(running_days_text, 'nan') AS running_days_text, classes, speed_type FROM {train_info}""")
def _(r):
    return tx.clean_nulls(r.train_info).select("train_number", "train_name", "running_days_text", "classes", "speed_type")


@query("doc02_rule_documents", """
    SELECT '[Railway Rule - ' || coalesce(category, 'General') || ']' || coalesce(' Topic: ' || sub || '.', '') || ' ' || title || '.' || ' ' || detail AS content,
           coalesce(category, 'General') AS category, sub AS sub_category, title AS rule_title
    FROM (SELECT CASE WHEN lang = 'es' THEN NULL ELSE lang END AS category, CASE WHEN n_chars > 2000 THEN NULL ELSE source END AS sub,
                 'Rule ' || doc_id AS title, trim(text) AS detail FROM {documents})""")
def _(r):
    rules = r.documents.select(F.when(F.col("lang") == "es", "").otherwise(F.col("lang")).alias("category"),
                               F.when(F.col("n_chars") > 2000, "NaN").otherwise(F.col("source")).alias("sub_category"),
                               F.concat(F.lit("Rule "), F.col("doc_id").cast("string")).alias("rule_title"),
                               F.col("text").alias("rule_description"))
    return doc.rule_documents(rules).select("content", "category", "sub_category", "rule_title")


@query("doc03_train_documents", "SELECT * FROM {train_docs}")
def _(r):
    return doc.train_documents(r.train_info).select("train_no", "train_name", "source_station", "destination_station", "train_type", "content")


@query("doc04_station_documents", "SELECT station_code, station_name, city, zone, content FROM {station_docs}")
def _(r):
    return doc.station_documents(r.station_dim()).select("station_code", "station_name", "city", "zone", "content")


@query("doc05_route_documents", """
    SELECT i.train_number AS train_no, 'Train ' || i.train_number || coalesce(' (' || nullif(i.train_name, 'nan') || ')', '') || ' route from '
           || a.src_label || ' to ' || a.dst_label || '.' || coalesce(' Runs on: ' || nullif(running_days_text, 'nan') || '.', '')
           || ' Total stops: ' || i.total_stops || '. Total distance: ' || i.distance_km || ' km. Station sequence: ' || coalesce(seqs, '') || '.'
           || coalesce(' Schedule: ' || lines || '.', '') AS content,
           a.src_code AS source_station, a.dst_code AS destination_station, cast(i.total_stops as int) AS total_stops, nullif(running_days_text, 'nan') AS runs_on
    FROM {train_info} i JOIN {per_train} a ON a.order_key = i.row_id""",
       labelled="""
    SELECT s.*, CASE WHEN d.name IS NOT NULL THEN d.name || ' (' || s.station_code || ')' ELSE s.station_code END AS label
    FROM {stops} s LEFT JOIN {dim} d ON d.code = s.station_code""",
       per_train="""
    SELECT order_key, max(CASE WHEN seq = 1 THEN label END) AS src_label, max(CASE WHEN seq = n_stops THEN label END) AS dst_label,
           max(CASE WHEN seq = 1 THEN station_code END) AS src_code, max(CASE WHEN seq = n_stops THEN station_code END) AS dst_code,
           string_agg(label, ' > ' ORDER BY seq) FILTER (WHERE is_stopping) AS seqs,
           string_agg(label || CASE WHEN arrival IN ('First', 'Last') THEN '' ELSE ', arr ' || arrival END
                      || CASE WHEN departure IN ('First', 'Last') THEN '' ELSE ', dep ' || departure END || ', day ' || day
                      || CASE WHEN halt_min = 0 THEN '' ELSE ', halt ' || halt_min || ' min' END || ', ' || distance_km || ' km', ' | ' ORDER BY seq)
             FILTER (WHERE is_stopping) AS lines
    FROM {labelled} GROUP BY order_key HAVING count(*) >= 2""")
def _(r):
    return (doc.route_documents(r.decoded_routes(), r.station_dim(), r.train_info)
            .select("train_no", "content", "source_station", "destination_station", "total_stops", "runs_on"))


@query("doc06_reference_documents", """
    SELECT 'Ticket Class Info - r_regionkey: ' || r_regionkey || '. r_name: ' || r_name || '.' AS content, 'ticket_class' AS ref_type FROM {region}
    UNION ALL SELECT 'Service Tax Info - p_partkey: ' || p_partkey || '. p_name: ' || p_name || '. p_brand: ' || p_brand || '. p_type: ' || p_type || '. p_size: ' || p_size
                     || '. p_retailprice: ' || p_retailprice || '.', 'service_tax' FROM {part}""")
def _(r):
    return doc.reference_documents({"Ticket Class": r.region, "Service Tax": r.part}).select("content", "ref_type")


@query("doc07_compact_route_documents", """
    SELECT train_no, 'Train ' || train_no || ' from ' || src || ' to ' || dst || '. Stops' || coalesce(' (' || total || ')', '') || ': ' || codes || '. Distance: ' || km || ' km.' AS content,
           src AS source_station, dst AS destination_station, n AS total_stops, km AS total_distance_km FROM {route_meta}""")
def _(r):
    return doc.compact_route_documents(r.train_routes()).drop("doc_id", "collection", "source_type")


@query("doc08_enriched_route_documents", "SELECT * FROM {enriched_docs}")
def _(r):
    calls = r.calls()
    return doc.enriched_route_documents(r.train_routes(calls), doc.train_documents(r.train_info)).drop("doc_id", "collection", "source_type")


_STOP_DOC = """
    SELECT train_no, 'Train ' || train_no || ' stop ' || seq || '/' || n_stops || ' at ' || station_name || ' (' || station_code || ')'
           || CASE WHEN arrival = 'First' THEN ': origin/source station' WHEN departure = 'Last' THEN ': destination/terminus station'
                   ELSE ': arrives ' || replace(arrival, '.', ':') || ', departs ' || replace(departure, '.', ':') END
           || CASE WHEN halt_min = 0 THEN '' ELSE ', halt ' || halt_min || ' min' END || ', platform ' || platform
           || ', ' || distance_km || ' km from origin' || CASE WHEN day = 1 THEN '' ELSE ', day ' || day END
           || '. Zone: ' || zone || ', Division: ' || division || '.' AS content, station_code, seq,
           CASE WHEN arrival = 'First' THEN NULL ELSE cast(substr(arrival, 1, 2) as int) * 60 + cast(substr(arrival, 4, 2) as int) END AS arrival_minutes
    FROM {stops}"""


@query("doc09_stop_documents", _STOP_DOC)
def _(r):
    return doc.stop_documents(r.train_routes()).select("train_no", "content", "station_code", "seq", "arrival_minutes")


def _coaches(r):
    brand = F.col("p_brand")
    return r.part.select(
        F.col("p_partkey").cast("string").alias("train_number"), F.when(F.col("p_type") == "SMALL", "nan").otherwise(F.col("p_type")).alias("rake_type"),
        F.col("p_size").cast("string").alias("total_coaches"), F.when(F.col("p_size") > 25, "True").otherwise("False").alias("has_layout"),
        F.when(brand.endswith("1"), F.concat(F.lit('["ENG", "S1", "'), brand, F.lit('"]'))).otherwise(F.concat(F.lit("[ENG, "), brand, F.lit(", GEN]"))).alias("coaches"),
        F.when(F.col("p_size") > 40, F.concat(F.lit('["'), "p_name", F.lit('", "XY"]'))).otherwise("").alias("reversal_stations"))


@query("doc10_coach_documents", """
    SELECT cast(p_partkey as varchar) AS train_no, 'Train ' || p_partkey || CASE WHEN p_type = 'SMALL' THEN '' ELSE ' — ' || p_type END || ', ' || p_size || ' coaches: '
           || CASE WHEN p_brand LIKE '%1' THEN 'ENG > S1 > ' || p_brand ELSE 'ENG > ' || p_brand || ' > GEN' END || '.'
           || CASE WHEN p_size > 40 THEN ' Reversal station(s): ' || p_name || ', XY.' ELSE '' END
           || CASE WHEN p_size > 25 THEN ' Coach layout available.' ELSE '' END AS content,
           p_size AS total_coaches, p_size > 25 AS has_layout, CASE WHEN p_size > 40 THEN p_name || ',XY' ELSE '' END AS reversal_stations FROM {part}""")
def _(r):
    return doc.coach_documents(_coaches(r)).select("train_no", "content", "total_coaches", "has_layout", "reversal_stations")


def _star(r):
    trips = r.orders.join(r.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), (F.col("c_nationkey") + F.when(F.col("o_orderstatus") == "P", 100).otherwise(0)).alias("line_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("calendar_id"), F.col("o_orderkey").alias("stop_times_id"),
        F.floor("o_totalprice").cast("int").alias("start_time"))
    lines = r.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    bits = F.col("c")
    calendar = r.orders.select(F.substring("o_orderpriority", 1, 1).alias("c")).distinct().select(
        bits.cast("int").alias("id"), F.when(bits == "1", "1,1,1,1,1,1,1").when(bits == "2", "0,1,1,1,1,1,0").when(bits == "3", "1,0,0,0,0,0,1")
        .when(bits == "4", "1,0,1,0,0,0,0").otherwise("").alias("running_days_array"))
    stop_times = r.stops.select(F.col("order_key").alias("id"), F.col("seq").alias("stop_seq"), "stn_id")
    stations = r.station_rows.select(F.col("stn_id").alias("id"), F.col("station_code").alias("code"))
    name = lambda lang, c: r.station_rows.select(F.col("stn_id").alias("station_id"), F.lit(lang).alias("lang"), F.col(c).alias("name"))
    return doc.trip_star_join(trips, lines, calendar, stop_times, stations, name(0, "full_name").unionByName(name(1, "s_name")))


_TRIPS = dict(trips="""
    SELECT cast(o_orderkey as varchar) AS trip_id, CASE WHEN o_orderstatus = 'P' THEN 'Line ' || (c_nationkey + 100) ELSE n_name END AS line_name,
           CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Daily' WHEN '2' THEN 'Weekdays' WHEN '3' THEN 'Weekends' WHEN '4' THEN 'Mon, Wed' ELSE 'Unknown' END AS running_days,
           lpad(cast((cast(floor(o_totalprice) as bigint) // 3600) % 24 as varchar), 2, '0') || ':' || lpad(cast((cast(floor(o_totalprice) as bigint) % 3600) // 60 as varchar), 2, '0') AS departure,
           labels, src_label, dst_label, n_stops
    FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
    JOIN (SELECT order_key, string_agg(station_name || ' (' || station_code || ')', ' > ' ORDER BY seq) AS labels, max(n_stops) AS n_stops,
                 max(CASE WHEN seq = 1 THEN station_name || ' (' || station_code || ')' END) AS src_label,
                 max(CASE WHEN seq = n_stops THEN station_name || ' (' || station_code || ')' END) AS dst_label
          FROM {stops} GROUP BY order_key) ON order_key = o_orderkey""")


@query("jn05_trip_star_join", "SELECT trip_id, line_name, running_days, departure, labels AS stops FROM {trips}", **_TRIPS)
def _(r):
    return _star(r).select("trip_id", "line_name", "running_days", "departure", F.array_join("stop_labels", " > ").alias("stops"))


@query("doc11_trip_documents", """
    SELECT trip_id, line_name || ' trip from ' || src_label || ' to ' || dst_label || '. Departs ' || departure || ', runs ' || running_days
           || '. Stops (' || n_stops || '): ' || labels || '.' AS content, line_name, departure, running_days, cast(n_stops as int) AS total_stops FROM {trips}""", **_TRIPS)
def _(r):
    return doc.trip_documents(_star(r)).drop("doc_id", "collection", "source_type")


@query("doc12_platform_documents", """
    SELECT station_code, 'Station ' || station_code || ' platform information: ' || string_agg('Platform ' || o_orderkey || ' (' || o_orderstatus || ' direction)'
           || ' coming from ' || o_orderpriority || CASE WHEN o_totalprice > 250000 THEN ' going towards ' || o_custkey ELSE '' END, '. ' ORDER BY o_orderkey) || '.' AS content,
           cast(count(*) as int) AS num_platforms FROM (SELECT 'C' || o_custkey AS station_code, * FROM {orders}) GROUP BY station_code""")
def _(r):
    rows = r.orders.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("station_code"), "o_orderkey",
                           F.col("o_orderkey").cast("string").alias("platform_number"), F.col("o_orderstatus").alias("direction"),
                           F.col("o_orderpriority").alias("prev_station"),
                           F.when(F.col("o_totalprice") > 250000, F.col("o_custkey").cast("string")).otherwise("nan").alias("next_station"))
    return doc.platform_documents(rows, "o_orderkey").select("station_code", "content", "num_platforms")


@query("doc13_parse_code_array", """
    SELECT cast(p_partkey as varchar) AS train_number, 3 AS n, CASE WHEN p_brand LIKE '%1' THEN 'ENG|S1|' || p_brand ELSE 'ENG|' || p_brand || '|GEN' END AS cars FROM {part}""")
def _(r):
    return _coaches(r).select("train_number", F.size(tx.code_array("coaches")).alias("n"), F.array_join(tx.code_array("coaches"), "|").alias("cars"))


@query("doc14_format_clock", """
    SELECT train_no, seq, CASE WHEN arrival = 'First' THEN arrival ELSE replace(arrival, '.', ':') END AS arrival,
           CASE WHEN departure = 'Last' THEN departure ELSE replace(departure, '.', ':') END AS departure FROM {stops}""")
def _(r):
    return r.stops.select("train_no", "seq", tx.format_clock("arrival").alias("arrival"), tx.format_clock("departure").alias("departure"))


@query("doc15_seconds_to_hhmm", """
    SELECT o_orderkey, lpad(cast((cast(floor(o_totalprice) as bigint) // 3600) % 24 as varchar), 2, '0') || ':'
           || lpad(cast((cast(floor(o_totalprice) as bigint) % 3600) // 60 as varchar), 2, '0') AS hhmm FROM {orders}""")
def _(r):
    return r.orders.select("o_orderkey", tx.seconds_to_hhmm(F.floor("o_totalprice")).alias("hhmm"))


@query("doc16_running_days", """
    SELECT event_id, CASE WHEN bits = '1,1,1,1,1,1,1' THEN 'Daily' WHEN bits = '0,1,1,1,1,1,0' THEN 'Weekdays' WHEN bits = '1,0,0,0,0,0,1' THEN 'Weekends'
           ELSE CASE event_type WHEN 'click' THEN 'Mon, Wed' ELSE 'Unknown' END END AS days
    FROM (SELECT event_id, event_type, CASE event_type WHEN 'signup' THEN '1,1,1,1,1,1,1' WHEN 'error' THEN '0,1,1,1,1,1,0' WHEN 'view' THEN '1,0,0,0,0,0,1'
                 WHEN 'click' THEN '1,0, 1,x,0,0' ELSE '' END AS bits FROM {events})""")
def _(r):
    e = F.col("event_type")
    bits = (F.when(e == "signup", "1,1,1,1,1,1,1").when(e == "error", "0,1,1,1,1,1,0").when(e == "view", "1,0,0,0,0,0,1")
            .when(e == "click", "1,0, 1,x,0,0").otherwise(""))
    return r.events.select("event_id", tx.running_days(bits).alias("days"))


@query("doc17_document_stats", """
    SELECT count(*) AS documents, cast(floor(avg(length(content))) as bigint) AS avg_chars, max(length(content)) AS max_chars FROM {stop_docs}""", stop_docs=_STOP_DOC)
def _(r):
    return doc.document_stats(doc.stop_documents(r.train_routes()))


@query("set01_load_all_documents", "SELECT collection, source_type, content, train_no, station_code FROM {docs}")
def _(r):
    return r.search_docs().select("collection", "source_type", "content", "train_no", "station_code")


# ------------------------------------------------------- station dimension and joins


@query("jn01_station_dim", """
    SELECT code, name, city, zone, zone_name, lat, lng, wifi, array_to_string(aka, '|') AS aka, in_info FROM {dim}""")
def _(r):
    return r.station_dim().withColumn("aka", F.array_join("aka", "|")).drop("ord")


@query("jn02_running_days_join", """
    SELECT train_number, nullif(running_days_text, 'nan') AS runs_on FROM {train_info}""")
def _(r):
    return doc.running_days_join(r.train_info.select("train_number"), r.train_info, "row_id").select("train_number", "runs_on")


@query("jn03_label_stops", """
    SELECT train_no, seq, CASE WHEN d.name IS NOT NULL THEN d.name || ' (' || station_code || ')' ELSE station_code END AS station_label
    FROM {stops} LEFT JOIN {dim} d ON d.code = station_code""")
def _(r):
    return doc.label_stops(r.stops, r.station_dim()).select("train_no", "seq", "station_label")


@query("jn04_train_name_map", "SELECT train_no, train_name, runs_on FROM {name_map}")
def _(r):
    return doc.train_name_map(doc.train_documents(r.train_info))


@query("jn06_missing_rows", "SELECT d.doc_id, d.lang FROM {documents} d ANTI JOIN {labels} l ON d.doc_id = l.doc_id")
def _(r):
    return src.missing_rows(r.documents, r.labels, "doc_id").select("doc_id", "lang")


@query("agg05_ordered_stops", """
    SELECT order_key, string_agg(seq || ':' || station_code, ',' ORDER BY seq) AS stop_list FROM {stops} GROUP BY order_key""")
def _(r):
    lists = doc.ordered_stops(r.stops, "order_key", "seq", "station_code")
    return lists.select("order_key", F.array_join(F.transform("stop_list", lambda s: F.concat(s["seq"].cast("string"), F.lit(":"), s["station_code"])), ",").alias("stop_list"))


@query("agg06_alias_list", """
    SELECT station_code AS code, min(o) AS aka_ord, string_agg(title, '|' ORDER BY o) AS aka
    FROM (SELECT station_code, title, min(row_id) AS o FROM {station_aka} GROUP BY ALL) GROUP BY station_code""")
def _(r):
    return st.alias_list(r.station_aka).select("code", "aka_ord", F.array_join("aka_all", "|").alias("aka"))


@query("agg09_station_vocabulary", """
    SELECT DISTINCT * FROM (
        SELECT lower(code) AS token, 'code' AS kind FROM {dim}
        UNION ALL SELECT unnest(regexp_extract_all(lower(coalesce(name, '') || ' | ' || array_to_string(aka, ' | ')), '\\b[a-zA-Z]{3,}\\b')), 'name' FROM {dim})
    WHERE kind = 'code' OR token NOT IN ('junction','jn','junctions','cabin','road','halt','crossing','station','town','city','north','south','east','west',
          'central','new','old','and','the','via','pass','under','over','bridge')""")
def _(r):
    return st.station_vocabulary(r.station_dim())


@query("agg12_alias_index", "SELECT alias, name, code, is_name FROM {alias_all}")
def _(r):
    return r.aliases()

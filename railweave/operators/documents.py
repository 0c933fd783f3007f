"""Tables to text documents.

Every builder returns ``doc_id, collection, source_type, content`` and the
metadata columns of its source type. Text is put together from column
expressions; nothing is evaluated row by row in Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railweave import fixed_values as fv
from railweave.functions import text as tx
from railweave.sources.tables import document_id

DECODED_STOPS = ("array<struct<station_code:string,arrival:string,departure:string,halt_minutes:string,"
                 "distance_km:string,day:string,is_stopping:boolean>>")
STOPS = ("array<struct<seq:string,station_code:string,station_name:string,arrival:string,departure:string,"
         "halt_min:string,platform:string,distance_km:string,day:string,zone:string,division:string>>")


def _optional(df: DataFrame, *names: str) -> Column:
    """First of the alternative column names that the table has, cleaned; NULL if it has none."""
    found = [tx.clean(n) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _document(df: DataFrame, collection: str, source_type: str, content: Column, key: list, **metadata: Column) -> DataFrame:
    return df.select(document_id(F.lit(collection), *key).alias("doc_id"),
                     F.lit(collection).alias("collection"),
                     F.lit(source_type).alias("source_type"),
                     content.alias("content"),
                     *[c.alias(n) for n, c in metadata.items()])


def rule_documents(rules: DataFrame) -> DataFrame:
    category = F.coalesce(_optional(rules, "category"), F.lit("General"))
    sub = _optional(rules, "sub_category")
    title = F.coalesce(_optional(rules, "rule_title"), F.lit("Rule"))
    detail = _optional(rules, "rule_description")
    content = F.concat_ws(" ", F.concat(F.lit("[Railway Rule - "), category, F.lit("]")),
                          F.concat(F.lit("Topic: "), sub, F.lit(".")), F.concat(title, F.lit(".")), detail)
    return _document(rules, "railway_rules", "rule", content, [content],
                     category=category, sub_category=sub, rule_title=title)


def train_documents(trains: DataFrame) -> DataFrame:
    """One sentence per train; trains without a number or an end station are left out."""
    o = lambda *names: _optional(trains, *names)
    number, name = o("train_number"), o("train_name")
    src, dst = o("src_station_code"), o("dest_station_code")
    kind = F.coalesce(o("train_type", "train_category"), F.lit("Express"))
    dep, arr, classes = o("departure_time"), o("arrival_time"), o("classes")
    na = F.lit("N/A")
    content = F.concat(
        F.lit("Train "), number, tx.if_present(name, " (", ")"), F.lit(" is a "), kind, F.lit(" train running from "),
        tx.label(o("src_station_name"), src), F.lit(" to "), tx.label(o("dest_station_name"), dst), F.lit("."),
        tx.if_present(o("running_days_text"), " Runs on: ", "."),
        tx.part(dep.isNotNull() | arr.isNotNull(), " Departure: ", F.coalesce(dep, na), ", Arrival: ",
                F.coalesce(arr, na), "."),
        tx.if_present(o("distance_km"), " Distance: ", " km."),
        tx.if_present(o("duration"), " Duration: ", "."),
        tx.if_present(o("total_stops"), " Total stops: ", "."),
        tx.part(classes.isNotNull() & ~classes.rlike(r"^[+-]?\d+$"), " Classes: ", classes, "."),
        tx.if_present(o("speed_type"), " Speed type: ", "."),
        tx.if_present(o("zone_erail"), " Zone: ", "."),
    )
    kept = trains.where(number.isNotNull() & src.isNotNull() & dst.isNotNull())
    return _document(kept, "trains", "train", content, [number], train_no=number, train_name=name,
                     source_station=src, destination_station=dst, train_type=kind)


def station_documents(stations: DataFrame) -> DataFrame:
    """From ``station_dim``; stations known only through an alternate name have no document."""
    c = F.col
    zone = F.when(c("zone").isNotNull(), F.concat(
        F.lit(" Railway zone: "), c("zone"),
        tx.part(c("zone_name").isNotNull() & (c("zone_name") != c("zone")), " (", c("zone_name"), ")"), F.lit(".")))
    content = F.concat(
        F.lit("Station "), c("code"), F.lit(" — "), c("name"),
        F.coalesce(F.concat(F.lit(", located in "), c("city"), F.lit(".")), F.lit(".")),
        F.coalesce(zone, F.lit("")),
        tx.part(c("lat").isNotNull() & c("lng").isNotNull(), " Coordinates: ", c("lat"), "N, ", c("lng"), "E."),
        tx.part(c("wifi"), " WiFi available at this station."),
        tx.part(F.size("aka") > 0, " Also known as: ", F.array_join("aka", ", "), "."),
    )
    kept = stations.where(c("in_info") & c("name").isNotNull())
    return _document(kept, "stations", "station", content, [c("code")], station_code=c("code"),
                     station_name=c("name"), city=c("city"), zone=c("zone"))


def running_days_join(routes: DataFrame, trains: DataFrame, order: str) -> DataFrame:
    """Adds ``runs_on``; the last non-null entry of a train wins."""
    days = tx.clean("running_days_text")
    last = (trains.where(days.isNotNull()).groupBy(tx.clean("train_number").alias("train_number"))
            .agg(F.max_by(days, F.col(order)).alias("runs_on")))
    return routes.join(last, "train_number", "left")


def label_stops(stops: DataFrame, stations: DataFrame) -> DataFrame:
    """Adds ``station_label``: name (code), or the code alone where no name is known."""
    names = stations.select(F.col("code").alias("station_code"), F.col("name").alias("_name"))
    return (stops.join(names, "station_code", "left")
            .withColumn("station_label", tx.label(F.col("_name"), F.col("station_code"))).drop("_name"))


def parse_stops(df: DataFrame, schema: str, column: str = "stops") -> DataFrame:
    """Replaces the JSON text by an array; malformed or empty text gives NULL."""
    return df.withColumn(column, F.from_json(tx.clean(column), schema))


def route_documents(routes: DataFrame, stations: DataFrame, trains: DataFrame, order: str = "row_id",
                    max_trains: int | None = None) -> DataFrame:
    """Per route row: ends, station sequence and per-stop schedule. Trains need two stops or more.

    Rows that share a train number stay apart, also equal ones; the id takes in the row.
    ``max_trains`` keeps the first rows by ``order``, for callers that want a bounded load.
    """
    if max_trains:
        routes = routes.orderBy(order).limit(max_trains)
    routes = routes.withColumn("_row", F.concat_ws("-", F.xxhash64(*routes.columns), F.xxhash64(F.lit(1), *routes.columns)))
    parsed = parse_stops(routes, DECODED_STOPS).where(tx.clean("train_number").isNotNull() & (F.size("stops") >= 2))
    stops = parsed.select("_row", F.posexplode("stops").alias("pos", "_stop")).select("_row", "pos", "_stop.*")
    stops = label_stops(stops.withColumn("station_code", F.coalesce("station_code", F.lit("?"))), stations)
    clock = lambda c: tx.clean(c, tokens=fv.NULL_TOKENS + ("N/A", "First", "Last"))
    value = lambda c, zero: tx.clean(c, tokens=fv.NULL_TOKENS + ("N/A", zero))
    line = F.concat_ws(
        ", ", "station_label",
        F.concat(F.lit("arr "), clock("arrival")), F.concat(F.lit("dep "), clock("departure")),
        F.concat(F.lit("day "), tx.clean("day", tokens=fv.NULL_TOKENS + ("N/A",))),
        F.concat(F.lit("halt "), value("halt_minutes", "0"), F.lit(" min")),
        F.concat(value("distance_km", "0.0"), F.lit(" km")))
    shown = F.coalesce("is_stopping", F.lit(True))
    rows = stops.select("_row", F.struct("pos", "station_code", "station_label", shown.alias("shown"), line.alias("line")).alias("s"))
    # equal rows have equal stops, which count once
    per_row = rows.groupBy("_row").agg(F.array_sort(F.collect_set("s")).alias("all_stops"))
    joined = running_days_join(parsed, trains, order).join(per_row, "_row")
    stopping = F.filter("all_stops", lambda s: s["shown"])
    first, last = F.element_at("all_stops", 1), F.element_at("all_stops", -1)
    name = _optional(routes, "train_name", "title")
    lines = F.transform(stopping, lambda s: s["line"])
    total = _optional(routes, "total_stops")
    content = F.concat(
        F.lit("Train "), F.col("train_number"), tx.if_present(name, " (", ")"),
        F.lit(" route from "), first["station_label"], F.lit(" to "), last["station_label"], F.lit("."),
        tx.if_present(F.col("runs_on"), " Runs on: ", "."),
        tx.if_present(total, " Total stops: ", "."),
        tx.if_present(_optional(routes, "total_distance_km"), " Total distance: ", " km."),
        F.lit(" Station sequence: "), F.array_join(F.transform(stopping, lambda s: s["station_label"]), " > "),
        F.lit("."), tx.part(F.size(lines) > 0, " Schedule: ", F.array_join(lines, " | "), "."))
    return _document(joined, "train_routes", "train_route", content, [F.col("train_number"), F.col("_row")],
                     train_no=F.col("train_number"), train_name=name, source_station=first["station_code"],
                     destination_station=last["station_code"],
                     total_stops=F.coalesce(F.when(total.rlike(r"^\d+$"), total.cast("int")), F.size("all_stops")),
                     runs_on=F.col("runs_on"))


def reference_documents(tables: dict[str, DataFrame]) -> DataFrame:
    """``label Info - column: value. …`` over all columns of each table that is passed in."""
    parts = []
    for name, df in tables.items():
        pairs = F.concat_ws(". ", *[F.concat(F.lit(f"{c}: "), tx.clean(c)) for c in df.columns])
        content = F.concat(F.lit(f"{name} Info - "), pairs, F.lit("."))
        ref_type = F.lit(name.lower().replace(" ", "_"))
        parts.append(_document(df.where(pairs != ""), "references", "reference", content, [content], ref_type=ref_type))
    return reduce(DataFrame.unionByName, parts)


def compact_route_documents(routes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``Train n from A to B. Stops (k): A > … Distance: d km.`` from the stop codes.

    With ``names`` (train_no, train_name, runs_on) the head becomes
    ``Train n — name (days). From A to B.``
    """
    df = (routes.withColumn("train_no", tx.clean("train_number")).where(F.col("train_no").isNotNull())
          .withColumn("codes", tx.code_array(F.coalesce(tx.clean("stop_codes"), F.lit(""))))
          .where(F.size("codes") > 0))
    if names is not None:
        df = df.drop("train_name", "runs_on").join(names, "train_no", "left")
    src = F.coalesce(tx.clean("source_station"), F.element_at("codes", 1))
    dst = F.coalesce(tx.clean("dest_station"), F.element_at("codes", -1))
    total = tx.clean("total_stops", tokens=fv.NULL_TOKENS + ("N/A",))
    distance = tx.clean("total_distance_km", tokens=fv.NULL_TOKENS + ("N/A",))
    if names is None:
        head = F.concat(F.lit("Train "), F.col("train_no"), F.lit(" from "), src, F.lit(" to "), dst, F.lit("."))
    else:
        head = F.concat(F.lit("Train "), F.col("train_no"), tx.if_present(tx.clean("train_name"), " — "),
                        tx.if_present(tx.clean("runs_on"), " (", ")"), F.lit(". From "), src, F.lit(" to "), dst, F.lit("."))
    content = F.concat(head, F.lit(" Stops"), tx.if_present(total, " (", ")"), F.lit(": "),
                       F.array_join("codes", " > "), F.lit("."), tx.if_present(distance, " Distance: ", " km."))
    return _document(df, "train_routes", "train_route", content, [F.col("train_no")],
                     train_no=F.col("train_no"), source_station=src, destination_station=dst,
                     total_stops=F.coalesce(F.when(total.rlike(r"^\d+$"), total.cast("int")), F.size("codes")),
                     total_distance_km=distance)


def train_name_map(documents: DataFrame) -> DataFrame:
    """Name and running days read back out of train documents."""
    return (documents.where(F.col("train_no").isNotNull())
            .select("train_no",
                    F.trim(F.regexp_extract("content", r"\(([^)]+)\)", 1)).alias("train_name"),
                    F.trim(F.regexp_extract("content", r"Runs on:\s*([^.]+)", 1)).alias("runs_on"), "doc_id")
            .groupBy("train_no")
            .agg(F.max_by(F.struct("train_name", "runs_on"), "doc_id").alias("m"))
            .select("train_no", "m.train_name", "m.runs_on"))


def enriched_route_documents(routes: DataFrame, train_docs: DataFrame) -> DataFrame:
    return compact_route_documents(routes, train_name_map(train_docs))


def stop_documents(routes: DataFrame) -> DataFrame:
    """One document per (train, stop); no shuffle, the stop list is in the row."""
    parsed = parse_stops(routes, STOPS).withColumn("train_no", tx.clean("train_number")).where(F.col("train_no").isNotNull())
    s = (parsed.select("train_no", F.size("stops").alias("total"), F.explode("stops").alias("_stop"))
         .select("train_no", "total", "_stop.*").where(tx.clean("station_code").isNotNull() & (F.col("station_code") != "?")))
    code, name = tx.clean("station_code"), tx.clean("station_name")
    arrival, departure = tx.format_clock("arrival"), tx.format_clock("departure")
    sentinels = ("First", "Last")
    timing = F.concat_ws(", ",
                         F.when(~arrival.isin(*sentinels), F.concat(F.lit("arrives "), arrival)),
                         F.when(~departure.isin(*sentinels), F.concat(F.lit("departs "), departure)))
    when = (F.when(arrival == "First", ": origin/source station")
            .when(departure == "Last", ": destination/terminus station")
            .when(timing != "", F.concat(F.lit(": "), timing)).otherwise(""))
    with_zero = lambda c, *zero: tx.clean(c, tokens=fv.NULL_TOKENS + zero)
    zone, division = tx.clean("zone"), tx.clean("division")
    content = F.concat(
        F.lit("Train "), F.col("train_no"), F.lit(" stop "), F.coalesce(F.col("seq"), F.lit("?")), F.lit("/"),
        F.col("total").cast("string"), F.lit(" at "), tx.label(name, code), when,
        tx.if_present(with_zero("halt_min", "0"), ", halt ", " min"),
        tx.if_present(tx.clean("platform"), ", platform "),
        tx.if_present(with_zero("distance_km", "0"), ", ", " km from origin"),
        tx.if_present(with_zero("day", "1"), ", day "),
        tx.part(zone.isNotNull(), ". Zone: ", zone, tx.if_present(division, ", Division: ")), F.lit("."))
    return _document(s, "train_schedules", "train_schedule", content, [F.col("train_no"), F.col("seq"), code],
                     train_no=F.col("train_no"), station_code=code, station_name=name,
                     seq=F.when(F.col("seq").rlike(r"^\d+$"), F.col("seq").cast("int")).otherwise(0),
                     arrival=arrival, departure=departure, arrival_minutes=tx.clock_minutes(arrival),
                     halt_min=F.col("halt_min"), platform=F.col("platform"),
                     distance_km=F.col("distance_km"), day=F.col("day"), zone=zone, division=division)


def coach_documents(coaches: DataFrame) -> DataFrame:
    df = (coaches.withColumn("train_no", tx.clean("train_number")).where(F.col("train_no").isNotNull())
          .withColumn("cars", tx.code_array(F.coalesce(tx.clean("coaches"), F.lit("")))).where(F.size("cars") > 0)
          .withColumn("reversal", F.coalesce(F.from_json(tx.clean("reversal_stations"), "array<string>"),
                                             F.array().cast("array<string>"))))
    rake, total = tx.clean("rake_type"), tx.clean("total_coaches")
    layout = F.lower(F.col("has_layout").cast("string")) == "true"
    content = F.concat(
        F.lit("Train "), F.col("train_no"), tx.if_present(rake, " — "), tx.if_present(total, ", ", " coaches"),
        F.lit(": "), F.array_join("cars", " > "), F.lit("."),
        tx.part(F.size("reversal") > 0, " Reversal station(s): ", F.array_join("reversal", ", "), "."),
        tx.part(F.coalesce(layout, F.lit(False)), " Coach layout available."))
    return _document(df, "coach_positions", "coach_position", content, [F.col("train_no")],
                     train_no=F.col("train_no"), rake_type=rake,
                     total_coaches=F.coalesce(F.when(total.rlike(r"^\d+(\.\d*)?$"), total.cast("double").cast("int")), F.lit(0)),
                     has_layout=F.coalesce(layout, F.lit(False)), reversal_stations=F.array_join("reversal", ","))


def ordered_stops(stop_times: DataFrame, key: str = "id", seq: str = "stop_seq", *columns: str) -> DataFrame:
    """Stop rows of a list in sequence order, as one array per list."""
    return (stop_times.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct(seq, *columns))).alias("stop_list")))


def trip_star_join(trips: DataFrame, lines: DataFrame, calendar: DataFrame, stop_times: DataFrame,
                   stations: DataFrame, station_names: DataFrame) -> DataFrame:
    """Trips with line name, running days and ordered stop labels; trips without stops drop out."""
    names = station_names.where(F.col("lang") == 0).select(F.col("station_id").alias("stn_id"), F.col("name").alias("_name"))
    codes = stations.select(F.col("id").alias("stn_id"), F.col("code").alias("_code"))
    labelled = (stop_times.join(codes, "stn_id", "left").join(names, "stn_id", "left")
                .withColumn("stn_label", tx.label(F.when(F.col("_code").isNotNull(), tx.clean("_name")),
                                                  F.coalesce("_code", F.lit("?")))))
    lists = (ordered_stops(labelled, "id", "stop_seq", "stn_label")
             .select(F.col("id").alias("stop_times_id"), F.transform("stop_list", lambda s: s["stn_label"]).alias("stop_labels")))
    line = lines.select(F.col("id").alias("line_id"), F.col("name").alias("_line"))
    days = calendar.select(F.col("id").alias("calendar_id"), tx.running_days("running_days_array").alias("_days"))
    return (trips.join(lists, "stop_times_id").join(line, "line_id", "left").join(days, "calendar_id", "left")
            .select(F.col("id").cast("string").alias("trip_id"),
                    F.coalesce("_line", F.concat(F.lit("Line "), F.col("line_id").cast("string"))).alias("line_name"),
                    F.coalesce("_days", F.lit("Daily")).alias("running_days"),
                    tx.seconds_to_hhmm("start_time").alias("departure"), "stop_labels"))


def trip_documents(star: DataFrame) -> DataFrame:
    c = F.col
    content = F.concat(c("line_name"), F.lit(" trip from "), F.element_at("stop_labels", 1), F.lit(" to "),
                       F.element_at("stop_labels", -1), F.lit(". Departs "), c("departure"), F.lit(", runs "),
                       c("running_days"), F.lit(". Stops ("), F.size("stop_labels").cast("string"), F.lit("): "),
                       F.array_join("stop_labels", " > "), F.lit("."))
    return _document(star, "local_schedules", "local_schedule", content, [c("trip_id")], trip_id=c("trip_id"),
                     line_name=c("line_name"), departure=c("departure"), running_days=c("running_days"),
                     total_stops=F.size("stop_labels"))


def platform_documents(platforms: DataFrame, order: str) -> DataFrame:
    text = F.concat(F.lit("Platform "), tx.clean("platform_number", ""), F.lit(" ("), tx.clean("direction", ""),
                    F.lit(" direction)"), tx.if_present(tx.clean("prev_station"), " coming from "),
                    tx.if_present(tx.clean("next_station"), " going towards "))
    per = (platforms.where(F.col("station_code").isNotNull()).groupBy("station_code")
           .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))).alias("p")))
    content = F.concat(F.lit("Station "), F.col("station_code"), F.lit(" platform information: "),
                       F.array_join(F.transform("p", lambda x: x["t"]), ". "), F.lit("."))
    return _document(per, "platforms", "platform_info", content, [F.col("station_code")],
                     station_code=F.col("station_code"), num_platforms=F.size("p"))


def document_stats(documents: DataFrame, text: str = "content") -> DataFrame:
    n = F.length(text)
    return documents.agg(F.count(F.lit(1)).alias("documents"), F.floor(F.avg(n)).alias("avg_chars"),
                         F.max(n).alias("max_chars"))


def load_all_documents(parts: list[DataFrame]) -> DataFrame:
    """All collections in one table; metadata columns a collection lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

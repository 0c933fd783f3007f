"""The driver tables cast as stations, trains, stops, questions and log records.

A role is one SELECT that Spark and DuckDB both run: ``{name}`` is a driver table
or an earlier role. Spark gets DataFrames for the names; the check SQL gets the
same roles as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railweave.functions import text as tx
from railweave.functions.runtime import materialise
from railweave.operators import documents as doc
from railweave.operators import stations as st
from railweave.operators import vectors as vc

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

_SYLLABLES = ["ba", "ke", "li", "mo", "nu", "pa", "re", "si", "to", "vu"]


def _spoken(digits: str) -> str:
    for d, syllable in enumerate(_SYLLABLES):
        digits = f"replace({digits}, '{d}', '{syllable}')"
    return digits


_PAD = "lpad(cast({k} as string), cast(greatest(4, length(cast({k} as string))) as int), '0')"

ROLES: dict[str, str] = {
    # supplier = station, nation = city and zone, region = zone name
    "station_rows": f"""
        SELECT s_suppkey AS row_id, s_suppkey AS stn_id, s_name,
               translate({_PAD.format(k="s_suppkey")}, '0123456789', 'ABCDEFGHJK') AS station_code,
               upper(substr({_spoken(_PAD.format(k="s_suppkey"))}, 1, 1)) || substr({_spoken(_PAD.format(k="s_suppkey"))}, 2)
                 || CASE n_regionkey WHEN 0 THEN ' Junction' WHEN 1 THEN ' Road' WHEN 2 THEN ' Town' WHEN 3 THEN '' ELSE ' Halt' END AS full_name,
               n_name AS city, n_name AS zone, r_name AS zone_name, cast(s_acctbal as string) AS lat,
               cast(s_suppkey as string) AS lng, CASE WHEN s_acctbal > 5000 THEN '1' ELSE '0' END AS wifi_station, s_acctbal
        FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey""",
    "station_info": """
        SELECT row_id, station_code, CASE WHEN s_acctbal < 0 THEN 'nan' ELSE full_name END AS title, city, lat, lng, wifi_station
        FROM {station_rows}""",
    "station_zones": """
        SELECT row_id, station_code, zone, zone_name, full_name AS station_name FROM {station_rows}""",
    # alternates: the raw name twice, the official name once, and nations as stations known by an alternate only
    "station_aka": """
        SELECT row_id * 4 AS row_id, station_code, s_name AS title FROM {station_rows}
        UNION ALL SELECT row_id * 4 + 1, station_code, full_name FROM {station_rows}
        UNION ALL SELECT row_id * 4 + 2, station_code, s_name FROM {station_rows}
        UNION ALL SELECT row_id * 4 + 3, station_code, zone_name || ' ' || s_name FROM {station_rows} WHERE s_acctbal > 5000
        UNION ALL SELECT cast(n_nationkey as bigint), 'N' || translate(lpad(cast(n_nationkey as string), 2, '0'), '0123456789', 'ABCDEFGHJK'), n_name || ' stop' FROM {nation}""",
    # order = train or trip, lineitem = stop
    "stop_rows": """
        SELECT l_orderkey AS order_key, cast(10000 + l_orderkey as string) AS train_no,
               cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int) AS seq,
               count(*) OVER (PARTITION BY l_orderkey) AS n_stops, l_suppkey AS stn_id, station_code, full_name AS station_name, zone, zone_name AS division, l_quantity, l_discount, l_tax,
               lpad(cast(l_linenumber + 8 as string), 2, '0') || '.' || lpad(cast(cast(floor(l_quantity) as int) as string), 2, '0') AS arr,
               lpad(cast(l_linenumber + 8 as string), 2, '0') || '.' || lpad(cast(cast(floor(l_quantity) as int) + 5 as string), 2, '0') AS dep,
               cast(floor(l_tax * 100) as int) AS halt_min, cast(l_quantity as string) AS distance_km,
               cast(floor(l_discount * 10) as int) + 1 AS day, l_linestatus AS platform, l_returnflag <> 'R' AS is_stopping
        FROM {lineitem} JOIN {station_rows} ON l_suppkey = stn_id""",
    "stops": """
        SELECT *, CASE WHEN seq = 1 THEN 'First' ELSE arr END AS arrival, CASE WHEN seq = n_stops THEN 'Last' ELSE dep END AS departure
        FROM {stop_rows}""",
    "ends": """
        SELECT order_key, cast(max(n_stops) as int) AS total_stops, sum(l_quantity) AS km,
               max(CASE WHEN seq = 1 THEN station_code END) AS src_code, max(CASE WHEN seq = 1 THEN station_name END) AS src_name,
               max(CASE WHEN seq = n_stops THEN station_code END) AS dst_code, max(CASE WHEN seq = n_stops THEN station_name END) AS dst_name,
               max(CASE WHEN seq = 1 THEN dep END) AS dep_time, max(CASE WHEN seq = n_stops THEN arr END) AS arr_time
        FROM {stops} GROUP BY order_key""",
    "train_info": """
        SELECT o_orderkey AS row_id, cast(10000 + o_orderkey as string) AS train_number,
               CASE WHEN c_acctbal < 0 THEN 'nan' ELSE c_name END AS train_name, o_orderpriority AS train_type,
               src_code AS src_station_code, src_name AS src_station_name, dst_code AS dest_station_code, dst_name AS dest_station_name,
               dep_time AS departure_time, arr_time AS arrival_time, cast(km as string) AS distance_km,
               cast(total_stops as string) || ' h' AS duration, cast(total_stops as string) AS total_stops,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Daily' WHEN '2' THEN 'Mon, Wed' WHEN '4' THEN 'nan' WHEN '5' THEN 'Sat, Sun' END AS running_days_text,
               CASE WHEN o_orderstatus = 'P' THEN '1' ELSE c_mktsegment END AS classes,
               CASE WHEN o_orderstatus = 'F' THEN 'Superfast' END AS speed_type, n_name AS zone_erail
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
        LEFT JOIN {ends} ON o_orderkey = order_key""",
    # questions about trains and stations, the template follows status and priority
    "questions": """
        SELECT o_orderkey AS question_id, o_custkey AS session_id, cast(o_orderdate as timestamp) AS ts,
               CASE o_orderstatus || substr(o_orderpriority, 1, 1)
                 WHEN 'F1' THEN 'Where is train ' || n || ' now?'
                 WHEN 'F2' THEN 'Trains from ' || a || ' to ' || b
                 WHEN 'F3' THEN 'What time does ' || n || ' arrive at ' || ca || '?'
                 WHEN 'F4' THEN 'What is the luggage limit in train ' || n || ' for SL class near ' || substr(a, 1, 3) || 'h' || substr(a, 4)
                 WHEN 'F5' THEN 'Is ' || n || ' running late today'
                 WHEN 'O1' THEN 'Check PNR ' || lpad(cast(o_orderkey as string), 10, '8')
                 WHEN 'O2' THEN 'which trains go from ' || lower(ca) || ' to ' || cb
                 WHEN 'O3' THEN 'Tell me about ' || a || ' station'
                 WHEN 'O4' THEN 'penalty and refund for 3a ticket wl at ' || a
                 WHEN 'O5' THEN a || ' express late schedule'
                 WHEN 'P1' THEN 'How do I cook pasta'
                 WHEN 'P2' THEN 'route between ' || a || ' and ' || lower(b) || ' via express'
                 WHEN 'P3' THEN 'train ' || n
                 WHEN 'P4' THEN 'Platform number for ' || n || ' at ' || a
                 ELSE 'tatkal fine and delay status stops' END AS question
        FROM (SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus, o_orderpriority, cast(10000 + o_orderkey as string) AS n,
                     coalesce(src_name, 'the depot') AS a, coalesce(dst_name, 'the yard') AS b,
                     coalesce(src_code, 'XY') AS ca, coalesce(dst_code, 'YZ') AS cb
              FROM {orders} LEFT JOIN {ends} ON o_orderkey = order_key) q""",
    # one search question per station, about the newest train that calls there
    "search_questions": """
        SELECT stn_id AS question_id,
               CASE zone_name WHEN 'AFRICA' THEN 'Trains from ' || src_name || ' to ' || dst_name
                              WHEN 'AMERICA' THEN 'Stops of train ' || n
                              WHEN 'ASIA' THEN 'route via ' || full_name
                              WHEN 'EUROPE' THEN 'luggage rules at ' || lower(full_name) || ' for SL'
                              ELSE 'which trains go from ' || src_code || ' to ' || lower(dst_code) END AS question
        FROM (SELECT r.stn_id, r.zone_name, r.full_name, e.src_name, e.dst_name, e.src_code, e.dst_code, cast(10000 + t.k as string) AS n
              FROM {station_rows} r JOIN (SELECT stn_id, max(order_key) AS k FROM {stop_rows} GROUP BY stn_id) t ON r.stn_id = t.stn_id
              JOIN {ends} e ON e.order_key = t.k) x""",
    # events = question log
    "query_log": """
        SELECT event_id, cast(ts as timestamp) AS ts, user_id, event_type || ' ' || props AS question, event_type AS intent, value AS response_time_ms,
               CASE WHEN event_type = 'error' THEN 'failed' END AS error,
               event_type IN ('click', 'purchase') AS live_api_used, event_type = 'click' AS live_api_success,
               event_type = 'view' AND value > 15 AS flagged
        FROM {events}""",
    # question-answer pairs: a user turn and the assistant turn after it
    "turn_pairs": """
        SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
        FROM {conversations} u JOIN {conversations} a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'""",
    "status_rows": """
        SELECT o_orderkey AS order_key, cast(10000 + o_orderkey as string) AS train_no, upper(c_name) AS train_name,
               CASE WHEN o_orderstatus = 'F' THEN 'Departed from ' || src_name || ' at ' || dep_time ELSE '' END AS position,
               CASE WHEN o_orderstatus = 'P' THEN NULL ELSE lower(src_name) END AS current_station,
               CASE WHEN o_orderstatus = 'O' THEN total_stops ELSE 0 END AS delay_minutes, total_stops AS progress_percent, o_orderstatus,
               cast(o_orderdate as timestamp) AS fetched_at
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {ends} ON order_key = o_orderkey""",
    "status_stops": """
        SELECT order_key, seq, station_name, platform, arrival, departure, is_stopping,
               CASE WHEN is_stopping THEN halt_min ELSE 0 END AS arrival_delay_minutes, CASE WHEN day > 1 THEN day ELSE 0 END AS departure_delay_minutes,
               CASE WHEN seq * 2 <= n_stops THEN 'departed' WHEN seq = n_stops THEN '' ELSE 'upcoming' END AS status
        FROM {stops}""",
    "requests": """
        SELECT event_id AS request_id, user_id AS client, cast(ts as timestamp) AS ts, event_type || props AS question,
               CASE WHEN event_type IN ('click', 'view') THEN 'STATIC' ELSE 'LIVE' END AS intent, value, event_type
        FROM {events}""",
}


_STORED: dict[tuple[str, str, str], DataFrame] = {}
#: Roles that are stored, so that Spark knows their size: it takes a join for as large as the product of its sides.
_DIMENSIONS = {"station_rows"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def role(spark: SparkSession, sf: str, name: str, _memo: dict | None = None) -> DataFrame:
    """A role, or a driver table, as a DataFrame."""
    memo = {} if _memo is None else _memo
    if name not in memo:
        if name in TABLES:
            memo[name] = table(spark, sf, name)
        else:
            found = _filled(spark, sf, _with(ROLES[name], "l_orderkey") if name == "stop_rows" else ROLES[name], memo)
            if name == "stop_rows":
                # named behind the windows, so that grouping by train finds the rows where the windows left them
                found = found.withColumn("order_key", F.col("l_orderkey")).drop("l_orderkey")
            memo[name] = stored(spark, sf, name, lambda: found) if name in _DIMENSIONS else found
    return memo[name]


def _with(sql: str, *columns: str) -> str:
    return re.sub(r"(?=\s+FROM \{)", "".join(f", {c}" for c in columns), sql, count=1)


def _filled(spark: SparkSession, sf: str, sql: str, memo: dict) -> DataFrame:
    return spark.sql(sql, **{n: role(spark, sf, n, memo) for n in set(re.findall(r"\{(\w+)\}", sql))})


def stored(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """A stored table (dimension, index) that many queries read: built by the first one
    that needs it and kept in the shared folder for the rest of the session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        _STORED[key] = materialise(build(), name)
    return _STORED[key]


class Roles:
    """Roles of one scale-factor folder; each is built once per query."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf, self._memo = spark, sf, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return role(self.spark, self.sf, name, self._memo)

    # --------------------------------------------------------- nested inputs
    def _wider(self, name: str, *columns: str, **given: DataFrame) -> DataFrame:
        """A role with more columns of the tables it reads; ``given`` replaces some of these."""
        return _filled(self.spark, self.sf, _with(ROLES[name], *columns), {**self._memo, **given})

    def trains(self, stops: DataFrame | None = None, **lists) -> DataFrame:
        """Ends of each train and lists of fields of its stops, in stop order, from one pass over the stops.

        A stop number occurs once in a train, so it alone settles the order; lists that
        nobody reads are not gathered.
        """
        stops = self.stops if stops is None else stops
        stops = stops.withColumns({f"_{name}": F.struct("seq", *fields) for name, fields in lists.items()})
        return self._wider("ends", *[f"sort_array(collect_list(_{name})) AS {name}" for name in lists], stops=stops)

    def calls(self) -> DataFrame:
        """Ends and stop codes of each train, stored for queries that read the ends several times;
        roles that are asked for after this read them from here."""
        found = self._once("calls", lambda: self.trains(codes=["station_code"]).withColumn("codes", F.transform("codes", lambda x: x["station_code"])))
        self._memo["ends"] = found.drop("codes")
        return found

    def train_routes(self, trains: DataFrame | None = None) -> DataFrame:
        """Routes with stop codes and, unless ``trains`` come without, full stops as JSON text; some code lists are not valid JSON."""
        if trains is None:
            text = [F.col(c).cast("string").alias(c) for c in ("station_code", "station_name", "arrival", "departure", "halt_min", "platform",
                                                               "distance_km", "day", "zone", "division")]
            trains = (self.trains(codes=["station_code"], stop_list=text).withColumn("codes", F.transform("codes", lambda x: x["station_code"]))
                      .withColumn("stops", F.to_json("stop_list")))
        coded = F.to_json("codes")
        loose = F.replace(coded, F.lit('"'), F.lit(""))
        return (trains.join(self.orders.select(F.col("o_orderkey").alias("order_key"), "o_orderstatus"), "order_key")
                .select((F.col("order_key") + 10000).cast("string").alias("train_number"),
                        F.when(F.col("o_orderstatus") != "P", F.col("src_code")).alias("source_station"),
                        F.when(F.col("o_orderstatus") != "F", F.col("dst_code")).otherwise("nan").alias("dest_station"),
                        F.col("km").cast("string").alias("total_distance_km"),
                        F.when(F.col("o_orderstatus") != "P", F.col("total_stops").cast("string")).alias("total_stops"),
                        F.when(F.col("o_orderstatus") == "P", loose).otherwise(coded).alias("stop_codes"), *[c for c in trains.columns if c == "stops"]))

    def decoded_routes(self) -> DataFrame:
        trains = self.trains(stop_list=["station_code", "arrival", "departure", F.col("halt_min").alias("halt_minutes"), "distance_km", "day", "is_stopping"])
        info = self._wider("train_info", "stop_list", ends=trains).where(F.col("stop_list").isNotNull())
        return info.select("row_id", "train_number", "train_name", F.col("src_station_code").alias("source_station"), F.col("dest_station_code").alias("dest_station"),
                           F.col("distance_km").alias("total_distance_km"), "total_stops", F.to_json("stop_list").alias("stops"))

    def _once(self, name: str, build) -> DataFrame:
        return stored(self.spark, self.sf, name, build)

    def station_dim(self) -> DataFrame:
        return self._once("station-dim", lambda: st.station_dim(self.station_info, self.station_zones, self.station_aka))

    def aliases(self) -> DataFrame:
        return self._once("aliases", lambda: st.alias_index(self.station_dim()))

    def kept_questions(self) -> DataFrame:
        """The questions, stored for queries that read them several times."""
        return self._once("questions", lambda: self.questions)

    def asked(self) -> DataFrame:
        """The search questions, stored in as many files as there are tasks, as they are small beside what is made of them."""
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return self._once("search-questions", lambda: self.search_questions.repartition(tasks))

    def search_docs(self) -> DataFrame:
        """All documents. Train documents are stored apart, as the routes' names are read out of them."""
        self.calls()
        trains = self._once("train-docs", lambda: doc.train_documents(self.train_info).withColumn("doc_id", F.lit(1) * 10**12 + F.col("train_no").cast("bigint")))
        others = self._once("search-docs", lambda: self._other_docs(trains))
        return doc.load_all_documents([trains, others])

    def embedded_docs(self) -> DataFrame:
        """The search documents with their vectors: the index that searches read."""
        return self._once("embedded-docs", lambda: vc.hashed_embedding(self.search_docs()))

    def _other_docs(self, trains: DataFrame) -> DataFrame:
        """Station, route, rule and reference documents with ids that both engines can compute."""
        stations = (doc.station_documents(self.station_dim()).join(self.station_rows.select("station_code", "row_id"), "station_code")
                    .withColumn("doc_id", F.lit(2) * 10**12 + F.col("row_id")).drop("row_id"))
        routes = doc.enriched_route_documents(self.train_routes(self.calls()), trains).withColumn("doc_id", F.lit(3) * 10**12 + F.col("train_no").cast("bigint"))
        plain = lambda df, base, key, collection, kind: df.select(
            (F.lit(base) * 10**12 + F.col(key)).alias("doc_id"), F.lit(collection).alias("collection"), F.lit(kind).alias("source_type"),
            F.col("text").alias("content"))
        rules = plain(self.documents, 4, "doc_id", "railway_rules", "rule")
        references = plain(self.benchmark, 5, "item_id", "references", "reference")
        return doc.load_all_documents([stations, routes, rules, references])

    def status_payloads(self) -> DataFrame:
        stops = self._wider("status_stops", "n_stops", "l_quantity", "station_code", "dep", "arr")
        trains = self.trains(stops, stations=["station_name", "platform", "arrival", "arrival_delay_minutes", "departure", "departure_delay_minutes", "status"])
        fields = ["train_no", "train_name", "position", "current_station", "delay_minutes", "progress_percent", "stations"]
        return (self._wider("status_rows", "stations", ends=trains)
                .select("order_key", "train_no", "fetched_at", F.lit("RapidAPI").alias("source"), F.to_json(F.struct(*fields)).alias("payload")))

    def status_pages(self) -> DataFrame:
        """HTML status pages with one block per stop."""
        c = F.concat
        block = c(F.lit('<div style="display:flex;gap:4px"><div style="float:left"><b>'), "station_name", F.lit("</b>\n<div>"), "station_code",
                  F.lit(' PF <span class="w3-tag w3-orange">'), "platform", F.lit("</span></div></div><div style=\"float:right\"><span>"),
                  F.replace(F.col("arr"), F.lit("."), F.lit(":")), F.lit("</span>\n<span>"), F.replace(F.col("dep"), F.lit("."), F.lit(":")),
                  tx.part(F.col("day") > 1, '<span class="w3-round">', F.col("day").cast("string"), " Min late</span>"),
                  F.lit("</span></div></div>\n"))
        trains = self.trains(blocks=[block.alias("b")]).withColumn("blocks", F.array_join(F.transform("blocks", lambda x: x["b"]), ""))
        phrase = (F.when(F.col("o_orderstatus") == "F", c(F.lit("Departed from <b>"), "src_name", F.lit("</b> ("), "src_code", F.lit(") Delay: 01:"),
                                                          F.lpad(F.col("total_stops").cast("string"), 2, "0")))
                  .when(F.col("o_orderstatus") == "O", c(F.lit("Arrived at "), "src_name", F.lit(" (X) Delay: "), F.col("total_stops").cast("string"), F.lit(" Min")))
                  .otherwise("No news"))
        s = self._wider("status_rows", "src_name", "src_code", "total_stops", "blocks", ends=trains)
        page = c(F.lit("<html><head><style>p{x:y}</style>\n<script>var delay = 1;</script></head><body>\n<h3>"), "train_no", F.lit(" - "), "train_name",
                 F.lit("</h3>\n<p>"), phrase, F.lit("</p>\n"), "blocks", F.lit("</body></html>"))
        return s.select("order_key", "train_no", "fetched_at", page.alias("payload"))


# ------------------------------------------------------------- check-side SQL
# Roles that only the check SQL needs: the document texts, written out in SQL.
CHECK_ROLES: dict[str, str] = {
    "dim": """
        SELECT coalesce(i.station_code, a.station_code) AS code,
               CASE WHEN i.station_code IS NOT NULL THEN coalesce(nullif(i.title, 'nan'), z.station_name) ELSE a.first_aka END AS name,
               i.city, z.zone, z.zone_name, i.lat, i.lng, coalesce(i.wifi_station = '1', false) AS wifi,
               list_filter(coalesce(a.akas, []), lambda x: x <> CASE WHEN i.station_code IS NOT NULL THEN coalesce(nullif(i.title, 'nan'), z.station_name) ELSE a.first_aka END) AS aka,
               i.station_code IS NOT NULL AS in_info, i.row_id AS row_id, a.o AS aka_ord
        FROM {station_info} i LEFT JOIN {station_zones} z ON i.station_code = z.station_code
        FULL JOIN (SELECT station_code, min(o) AS o, list(title ORDER BY o) AS akas, arg_min(title, o) AS first_aka
                   FROM (SELECT station_code, title, min(row_id) AS o FROM {station_aka} GROUP BY ALL) GROUP BY station_code) a ON i.station_code = a.station_code""",
    "alias_entries": """
        SELECT lower(code) AS alias, coalesce(name, code) AS name, code, 0 AS kind, 0 AS pos, in_info, coalesce(row_id, aka_ord) AS o FROM {dim}
        UNION ALL SELECT lower(name), name, code, 1, 0, in_info, coalesce(row_id, aka_ord) FROM {dim} WHERE name IS NOT NULL
        UNION ALL SELECT lower(aka[i]), coalesce(name, aka[i]), code, 2, i, in_info, coalesce(row_id, aka_ord)
                  FROM (SELECT *, unnest(generate_series(1, len(aka))) AS i FROM {dim})""",
    "alias_main": """
        SELECT alias, arg_max(name, (CASE WHEN in_info THEN 0 ELSE 1 END, o, kind, pos)) AS name,
               arg_max(code, (CASE WHEN in_info THEN 0 ELSE 1 END, o, kind, pos)) AS code, bool_or(kind > 0) AS is_name
        FROM {alias_entries} GROUP BY alias""",
    "alias_all": """
        SELECT alias, name, code, is_name FROM {alias_main}
        UNION ALL
        SELECT alias, arg_min(name, k), arg_min(code, k), true FROM (
            SELECT lower(string_split(name, ' ')[1]) AS alias, name, code, (CASE WHEN in_info THEN 0 ELSE 1 END, coalesce(row_id, aka_ord)) AS k
            FROM {dim} WHERE name LIKE '% %')
        WHERE length(alias) >= 4 AND alias NOT IN ('new','old','north','south','east','west','central','junction','road','halt','cabin','town','city')
          AND alias NOT IN (SELECT alias FROM {alias_main}) GROUP BY alias""",
    "route_meta": """
        SELECT e.order_key, cast(10000 + e.order_key as varchar) AS train_no,
               CASE WHEN o_orderstatus <> 'P' THEN src_code ELSE src_code END AS src, dst_code AS dst,
               CASE WHEN o_orderstatus <> 'P' THEN cast(total_stops as varchar) END AS total, cast(km as varchar) AS km, total_stops AS n, codes
        FROM {ends} e JOIN {orders} ON e.order_key = o_orderkey
        JOIN (SELECT order_key AS k, string_agg(station_code, ' > ' ORDER BY seq) AS codes FROM {stops} GROUP BY order_key) c ON e.order_key = c.k""",
    "train_docs": """
        SELECT train_number AS train_no, nullif(train_name, 'nan') AS train_name, src_station_code AS source_station, dest_station_code AS destination_station, train_type,
               'Train ' || train_number || coalesce(' (' || nullif(train_name, 'nan') || ')', '') || ' is a ' || train_type || ' train running from '
               || src_station_name || ' (' || src_station_code || ') to ' || dest_station_name || ' (' || dest_station_code || ').'
               || coalesce(' Runs on: ' || nullif(running_days_text, 'nan') || '.', '')
               || ' Departure: ' || departure_time || ', Arrival: ' || arrival_time || '. Distance: ' || distance_km || ' km. Duration: ' || duration
               || '. Total stops: ' || total_stops || '.' || CASE WHEN classes = '1' THEN '' ELSE ' Classes: ' || classes || '.' END
               || coalesce(' Speed type: ' || speed_type || '.', '') || ' Zone: ' || zone_erail || '.' AS content
        FROM {train_info} WHERE src_station_code IS NOT NULL""",
    "station_docs": """
        SELECT code AS station_code, name AS station_name, city, zone,
               'Station ' || code || ' — ' || name || ', located in ' || city || '. Railway zone: ' || zone || ' (' || zone_name || '). Coordinates: '
               || lat || 'N, ' || lng || 'E.' || CASE WHEN wifi THEN ' WiFi available at this station.' ELSE '' END
               || CASE WHEN len(aka) > 0 THEN ' Also known as: ' || array_to_string(aka, ', ') || '.' ELSE '' END AS content, row_id
        FROM {dim} WHERE in_info AND name IS NOT NULL""",
    "name_map": """
        SELECT train_no, trim(regexp_extract(content, '\\(([^)]+)\\)', 1)) AS train_name, trim(regexp_extract(content, 'Runs on:\\s*([^.]+)', 1)) AS runs_on
        FROM {train_docs}""",
    "enriched_docs": """
        SELECT r.train_no, src AS source_station, dst AS destination_station, n AS total_stops, km AS total_distance_km,
               'Train ' || r.train_no || coalesce(' — ' || nullif(train_name, ''), '') || coalesce(' (' || nullif(runs_on, '') || ')', '') || '. From ' || src || ' to ' || dst
               || '. Stops' || coalesce(' (' || total || ')', '') || ': ' || codes || '. Distance: ' || km || ' km.' AS content
        FROM {route_meta} r LEFT JOIN {name_map} m ON r.train_no = m.train_no""",
    "docs": """
        SELECT 1000000000000 + cast(train_no as bigint) AS doc_id, 'trains' AS collection, 'train' AS source_type, content, train_no, NULL AS station_code FROM {train_docs}
        UNION ALL SELECT 2000000000000 + row_id, 'stations', 'station', content, NULL, station_code FROM {station_docs}
        UNION ALL SELECT 3000000000000 + cast(train_no as bigint), 'train_routes', 'train_route', content, train_no, NULL FROM {enriched_docs}
        UNION ALL SELECT 4000000000000 + doc_id, 'railway_rules', 'rule', text, NULL, NULL FROM {documents}
        UNION ALL SELECT 5000000000000 + item_id, 'references', 'reference', text, NULL, NULL FROM {benchmark}""",
}


def check_sql(body: str, recursive: bool = False, **extra: str) -> str:
    """Check SQL: the body with every role it names put in front as a CTE.

    ``extra`` adds CTEs of the one query; they may name roles and each other.
    """
    known = {**ROLES, **CHECK_ROLES, **extra}
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\{(\w+)\}", text):
            if name in known and name not in ordered:
                if name in _open:
                    continue
                _open.add(name)
                need(known[name])
                ordered.append(name)

    _open: set[str] = set()
    need(body)
    names = set(known) | set(TABLES)
    plain = lambda t: re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in names else m[0], t)
    if not ordered:
        return plain(body)
    # names as CTEs; the driver tables keep their own names
    ctes = ",\n".join(f"{n} AS ({plain(known[n])})" for n in ordered)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{plain(body)}"

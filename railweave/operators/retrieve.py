"""Finding, ranking, checking and trimming documents for many questions at once.

Documents carry ``doc_id, collection, source_type, content`` and the metadata
columns ``train_no, station_code``. A ranked list is a set of rows
``(question_id, source, rank, doc_id, score)`` with ranks from zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from railweave import fixed_values as fv
from railweave.functions import text as tx
from railweave.functions.runtime import materialise
from railweave.functions.segmented import dense_position

STATION = "struct<name:string,code:string>"


# ------------------------------------------------------------ question preparation
def expand_synonyms(df: DataFrame, text: str = "question", out: str = "expanded") -> DataFrame:
    return df.withColumn(out, tx.expand_synonyms(text))


def rewrite_query(df: DataFrame, text: str = "expanded", stations: str = "stations", out: str = "search_text") -> DataFrame:
    """Appends the code and the name of each station that the text does not contain."""
    low = F.lower(text)
    extras = F.flatten(F.transform(stations, lambda s: F.array_compact(F.array(
        F.when(~F.contains(low, F.lower(s["code"])), s["code"]),
        F.when(~F.contains(low, F.lower(s["name"])), s["name"])))))
    return df.withColumn(out, F.when(F.size(extras) > 0, F.concat_ws(" ", F.col(text), F.array_join(extras, " "))).otherwise(F.col(text)))


def route_collections(text: str | Column) -> Column:
    """Collections to search: transit words first, then rule words, else all. Substring tests."""
    low = F.lower(tx.col(text))
    names = lambda values: F.array(*[F.lit(v) for v in values])
    return (F.when(tx.contains_any(low, fv.TRANSIT_WORDS), names(fv.TRANSIT_COLLECTIONS))
            .when(tx.contains_any(low, fv.RULE_WORDS), names(fv.RULE_COLLECTIONS)).otherwise(names(fv.COLLECTIONS)))


# ------------------------------------------------------------------- exact lookup
def exact_lookup(questions: DataFrame, documents: DataFrame, text: str = "question", per_number: int | None = None,
                 collections=("trains", "train_routes"), pattern: str = r"\b(\d{5})\b") -> DataFrame:
    """Documents of every train number in a question, score 1; ``per_number`` limits them per number and collection.

    Only documents of asked numbers are ordered. A limit is applied to them before
    the join, so a train with many documents is cut where they are stored.
    """
    numbers = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
    # read twice, and small beside the questions it is taken from
    asked = materialise(questions.select("question_id", F.posexplode(numbers).alias("pos", "train_no")), "numbers")
    wanted = asked.select("train_no").distinct()
    w = W.partitionBy("collection", "train_no").orderBy("doc_id")
    docs = (documents.where(F.col("collection").isin(*collections)).select("collection", "train_no", "doc_id")
            .join(wanted, "train_no", "left_semi").withColumn("n", F.row_number().over(w)))
    if per_number is not None:
        docs = docs.where(F.col("n") <= per_number)
    order = F.array_position(F.array(*[F.lit(c) for c in collections]), F.col("collection"))
    rank = F.row_number().over(W.partitionBy("question_id").orderBy("c", "pos", "n")) - 1
    return (asked.join(docs, "train_no").withColumn("c", order).withColumn("rank", rank)
            .select("question_id", F.lit("exact").alias("source"), "rank", "doc_id", F.lit(1.0).alias("score"), "train_no", "collection"))


# ----------------------------------------------------------------- keyword search
def station_terms(stations: DataFrame) -> DataFrame:
    """Search terms of a station: its name, then its code; terms under two characters are skipped."""
    name = F.coalesce("name", "code")
    terms = F.array_distinct(F.array(name, F.col("code")))
    return (stations.select("code", name.alias("name"), F.posexplode(terms).alias("term_no", "term"))
            .where(F.length("term") >= 2))


def _leading_words(documents: DataFrame, terms: DataFrame, text: str = "content") -> DataFrame:
    """(word, term): the lower-cased words of the texts that contain the word that stands for a term.

    Every word of a term must lie inside one word of the text. The distinct words of
    all documents are matched to the terms' words on equal substrings; that also tells
    how many words of the texts each leads to, and the one that leads to the fewest
    stands for the term. Words under three letters stand only where there is none longer.
    """
    postings = documents.select(F.explode(F.split(F.lower(text), r"\s+")).alias("word")).where(F.col("word") != "")
    words = postings.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    split = F.array_distinct(F.filter(F.split(F.lower("term"), r"\s+"), lambda w: w != ""))
    parts = (terms.select("term").distinct().withColumn("parts", split).withColumn("most", F.array_max(F.transform("parts", F.length)))
             .select("term", "most", F.explode("parts").alias("part")).where(F.length("part") >= F.least(F.lit(3), F.col("most"))).drop("most"))
    lengths = parts.agg(F.collect_set(F.length("part"))).scalar()
    pieces = (words.withColumn("len", F.explode(lengths)).where(F.length("word") >= F.col("len"))
              .withColumn("at", F.explode(F.sequence(F.lit(1), F.length("word") - F.col("len") + 1)))
              .select("word", "n", F.substring("word", F.col("at"), F.col("len")).alias("part")))
    leads = pieces.join(parts.select("part").distinct(), "part").distinct()
    cost = leads.groupBy("part").agg(F.sum("n").alias("cost"))
    rarest = (parts.join(cost, "part", "left").groupBy("term")
              .agg(F.min(F.struct(F.coalesce("cost", F.lit(0)).alias("cost"), (-F.length("part")).alias("short"), "part")).alias("r"))
              .where(F.col("r.cost") > 0).select("term", F.col("r.part").alias("part")))
    return materialise(rarest.join(leads.select("part", "word"), "part").select("word", "term").distinct(), "leading-words")


def contains_candidates(documents: DataFrame, terms: DataFrame, text: str = "content") -> DataFrame:
    """Pairs (doc_id, term) where a word of the text contains the term's rarest word."""
    found = _leading_words(documents, terms, text)
    words = documents.select("doc_id", F.explode(F.array_distinct(F.split(F.lower(text), r"\s+"))).alias("word"))
    return words.join(found, "word").select("doc_id", "term").distinct()


def _checked(documents: DataFrame, found: DataFrame, text: str, keep) -> DataFrame:
    """Documents with each term of ``found`` (word, term, columns of the term) that their text contains, and ``same_case``.

    The terms of a document come to it as one list, so its text is shuffled once
    and lower-cased once, not for every term.
    """
    words = documents.select("doc_id", F.explode(F.array_distinct(F.split(F.lower(text), r"\s+"))).alias("word"))
    carried = [c for c in found.columns if c != "word"]
    lists = words.join(found, "word").groupBy("doc_id").agg(F.collect_set(F.struct(*carried)).alias("_terms"))
    rows = (documents.select("doc_id", text, *keep).join(lists, "doc_id").withColumn("_low", F.lower(text))
            .select("doc_id", text, *keep, "_low", F.explode("_terms").alias("_t")).select("doc_id", text, *keep, "_low", "_t.*"))
    return (rows.where(F.contains("_low", F.lower("term"))).drop("_low")
            .withColumn("same_case", F.contains(F.col(text), F.col("term"))))


def contains_join(documents: DataFrame, terms: DataFrame, text: str = "content", keep=("collection",)) -> DataFrame:
    """Pairs (term, document) where the text contains the term as a substring, case ignored.

    Candidates come from the term's rarest word (``contains_candidates``), so a word
    that many terms share, such as "junction", does not bring them to each other's
    documents. A term without spaces lies inside a word of the text, so the words tell
    where it occurs and whether as written; a longer term is checked in the text. Nothing
    is left out.

    ``terms`` has a column ``term``; the result has one row per (term, document), its
    columns are doc_id, those of ``keep``, term and ``same_case``, which tells whether the
    term occurs as written.
    """
    found = _leading_words(documents, terms, text)
    one = ~F.col("term").rlike(r"\s")
    columns = ["doc_id", *keep, "term", "same_case"]
    # rows are told apart by a number of their own, as ids may repeat
    words = (documents.where(F.col("doc_id").isNotNull()).withColumn("_row", F.monotonically_increasing_id()).select("_row", "doc_id", *keep, F.explode(F.array_distinct(F.split(text, r"\s+"))).alias("_as_written"))
             .withColumn("word", F.lower("_as_written")))
    short = (words.join(found.where(one), "word").groupBy("_row", "doc_id", *keep, "term")
             .agg(F.bool_or(F.contains("_as_written", F.col("term"))).alias("same_case")).select(*columns))
    return short.unionByName(_checked(documents, found.where(~one), text, keep).select(*columns))


def keyword_score(hits: DataFrame, text: str = "content") -> DataFrame:
    """Adds ``tf, both_terms, score`` and applies the cut-off of the collection.

    Expects ``term``, the station's ``name`` and ``code``, and ``collection``.
    """
    low = F.lower(text)
    route = F.col("collection") == "train_routes"
    tf = tx.occurrences(low, F.lower("term"))
    both = F.contains(low, F.lower("name")) & F.contains(low, F.lower("code"))
    raw = (F.lit(fv.KEYWORD_BASE) + F.lit(fv.KEYWORD_TF_WEIGHT) * F.least(tf / F.lit(fv.KEYWORD_TF_CAP), F.lit(1.0))
           + F.when(both, fv.KEYWORD_BOTH_BONUS).otherwise(0.0))
    score = F.round(raw * F.when(route, fv.ROUTE_WEIGHT).otherwise(fv.OTHER_WEIGHT), 4)
    return (hits.withColumn("tf", tf).withColumn("both_terms", both).withColumn("score", score)
            .where(F.col("score") >= F.when(route, fv.ROUTE_CUTOFF).otherwise(fv.OTHER_CUTOFF)))


def keyword_join(documents: DataFrame, stations: DataFrame, collections=("train_routes", "stations"), any_case: bool = False) -> DataFrame:
    """Scored documents per station and search term. Independent of any question, so
    the work is done once per station however many questions name it.

    A term counts as written; ``any_case`` also keeps the other hits, marked by ``same_case``.
    """
    docs = documents.where(F.col("collection").isin(*collections))
    terms = station_terms(stations)
    found = _leading_words(docs, terms).join(terms, "term")
    hits = _checked(docs, found, "content", ("collection",))
    hits = hits if any_case else hits.where("same_case")
    return keyword_score(hits).select("code", "term_no", "term", "collection", "doc_id", "tf", "both_terms", "score", "same_case")


#: Slices of the ids that are ranked apart.
SLICES = 64


def slice_bounds(ids: DataFrame, column: str = "doc_id", slices: int = SLICES) -> list[int]:
    """Ids at which slices of about equal numbers of rows begin, however the ids are spread."""
    cuts = [F.lit(i / slices) for i in range(1, slices)]
    found = ids.agg(F.percentile_approx(column, F.array(*cuts), F.lit(100 * slices)).alias("p")).first()["p"]
    return sorted(set(found or []))


def rank_postings(scored: DataFrame, slices: int = SLICES) -> DataFrame:
    """Rank of a document in the list of its (station, term, collection), and the list sizes.

    The ids are cut where the data say, into slices that hold about equally many rows
    and are ranked apart, so a very common station is not ranked in one piece.
    """
    keys = ["code", "collection", "term_no"]
    bounds = slice_bounds(scored, slices=slices)
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    return dense_position(scored.withColumn("_slice", place.cast("int")), keys, "doc_id", "_slice", "pos").drop("_slice")


# ------------------------------------------------------------------------- fusion
def union_ranked(*lists: DataFrame) -> DataFrame:
    """Ranked lists one after the other; ``list_no`` keeps their order."""
    columns = ["question_id", "source", "rank", "doc_id", "score"]
    tagged = [df.select(*columns).withColumn("list_no", F.lit(i)) for i, df in enumerate(lists)]
    return reduce(DataFrame.unionByName, tagged)


def rrf_scores(ranked: DataFrame, keys=("question_id", "prefix"), k: int = fv.RRF_K) -> DataFrame:
    """Reciprocal-rank sums per key; every occurrence counts, also repeats in one list.

    Keeps the document with the highest own score, the earlier one on equal scores.
    """
    first = F.struct("list_no", "rank", "doc_id")
    best = F.max_by("doc_id", F.struct("score", (-F.col("list_no")).alias("a"), (-F.col("rank")).alias("b")))
    return (ranked.groupBy(*keys)
            .agg(F.round(F.sum(1.0 / (F.lit(k + 1) + F.col("rank"))), 12).alias("rrf"), best.alias("doc_id"),
                 F.max("score").alias("score"), F.min(first).alias("first_seen")))


def _same_text(text: str, prefix_len: int | None) -> Column:
    """What texts that count as one have in common."""
    return F.sha2(text, 256) if prefix_len is None else F.substring(text, 1, prefix_len)


def rrf_fuse(ranked: DataFrame, documents: DataFrame, k: int = fv.RRF_K, prefix_len: int | None = None) -> DataFrame:
    """Fused order per question over ranked lists (see ``union_ranked``).

    Documents of equal content count as one; with ``prefix_len``, those that share
    so many first characters.
    """
    prefix = documents.select("doc_id", _same_text("content", prefix_len).alias("prefix"))
    fused = rrf_scores(ranked.join(prefix, "doc_id"), k=k)
    w = W.partitionBy("question_id").orderBy(F.desc("rrf"), "first_seen")
    return (fused.withColumn("rank", F.row_number().over(w) - 1)
            .select("question_id", "rank", "doc_id", "score", F.round("rrf", 6).alias("rrf_score")))


def dedupe_prefix(df: DataFrame, key: str = "question_id", order: str = "rank", text: str = "content",
                  prefix_len: int | None = None) -> DataFrame:
    """First row per text, or per text prefix. ``min_by`` keeps one row of each before the shuffle."""
    row = F.struct(*df.columns)
    return (df.groupBy(key, _same_text(text, prefix_len).alias("_p")).agg(F.min_by(row, order).alias("r"))
            .select("r.*"))


# --------------------------------------------------------------------- validation
def _mentions(text: Column, station: Column, match: str) -> Column:
    """Whether the lower-cased text holds the station's name or code."""
    name, code = F.lower(station["name"]), F.lower(station["code"])
    if match == "token":
        padded = F.concat(F.lit(" "), F.regexp_replace(text, r"\W+", " "), F.lit(" "))
        wrap = lambda t: F.concat(F.lit(" "), F.regexp_replace(t, r"\W+", " "), F.lit(" "))
        return F.contains(padded, wrap(name)) | F.contains(padded, wrap(code))
    return F.contains(text, name) | F.contains(text, code)


def route_is_valid(content: Column, origin: Column, target: Column, match: str = "substring") -> Column:
    """Both stations occur, and the first place of the origin comes before that of the target."""
    def ordered(stops: Column) -> Column:
        place = lambda st: F.array_position(F.transform(stops, lambda x: _mentions(x, st, match)), F.lit(True))
        both = F.struct(place(origin).alias("a"), place(target).alias("b"))
        return tx.bind(both, lambda p: (p["a"] == 0) | (p["b"] == 0) | (p["a"] < p["b"]))

    low = F.lower(content)
    in_order = tx.bind(F.split(F.lower(F.get(F.split(content, "Stops"), F.lit(1))), ">"), ordered)
    return (_mentions(low, origin, match) & _mentions(low, target, match)
            & F.when(content.contains("Stops"), F.coalesce(in_order, F.lit(True))).otherwise(True))


def validate_route(candidates: DataFrame, stations: str = "stations", match: str = "substring") -> DataFrame:
    """Drops route documents that do not serve the first two stations in order; adds ``valid_route``.

    Questions with fewer than two stations pass unchanged.
    """
    s = F.col(stations)
    two = F.size(s) >= 2
    is_route = F.col("source_type") == "train_route"
    ok = route_is_valid(F.col("content"), F.get(s, F.lit(0)), F.get(s, F.lit(1)), match)
    return (candidates.withColumn("valid_route", two & is_route & F.coalesce(ok, F.lit(False)))
            .where(~two | ~is_route | F.col("valid_route")))


def drop_wrong_trains(candidates: DataFrame) -> DataFrame:
    """Where a question has a valid route, train documents of other trains are dropped.

    The candidates of a question are dealt once, and read once.
    """
    valid = F.col("valid_route") & F.col("question_id").isNotNull()
    among = lambda c, *keys: F.coalesce(F.max(c).over(W.partitionBy(*keys)), F.lit(False))
    marked = candidates.withColumn("_any", among(valid, "question_id")).withColumn("_own", among(valid & F.col("train_no").isNotNull(), "question_id", "train_no"))
    return marked.where((F.col("collection") != "trains") | ~F.col("_any") | F.col("_own")).drop("_any", "_own")


def drop_wrong_stations(candidates: DataFrame, stations: str = "stations") -> DataFrame:
    """Station documents of stations that the question does not name are dropped."""
    s = F.col(stations)
    named = F.exists(s, lambda x: F.upper(x["code"]) == F.upper("station_code"))
    return candidates.where((F.size(s) == 0) | (F.col("source_type") != "station") | F.col("station_code").isNull()
                            | (F.col("station_code") == "") | named)


#: Trains with at most so many asked stations form all their ordered pairs.
SHORT_TRAIN = 64


def between_stations(stops: DataFrame, pairs: DataFrame, short: int = SHORT_TRAIN) -> DataFrame:
    """Trains that serve ``origin`` before ``target``.

    A train counts by the first place of each station. Trains of up to ``short`` asked
    stations form their ordered pairs, which are then looked up among the asked ones. For
    longer trains a pair starts at that of its ends where fewer of them stop and looks up
    the other end by train and station, so neither a long train nor a busy station forms
    all its pairs.
    """
    asked = pairs.select("origin", "target").distinct()
    named = asked.select(F.col("origin").alias("station_code")).unionByName(asked.select(F.col("target").alias("station_code"))).distinct()
    # rows are dealt by train once: first places, sizes and lists are formed where they lie
    first = (stops.join(named, "station_code", "left_semi").select("train_no", "station_code", "seq").groupBy("train_no", "station_code").agg(F.min("seq").alias("seq"))
             .withColumn("n", F.count(F.lit(1)).over(W.partitionBy("train_no"))).where(F.col("train_no").isNotNull()))
    few = first.where(F.col("n") <= short).groupBy("train_no").agg(F.sort_array(F.collect_list(F.struct("seq", "station_code"))).alias("at"))
    later = lambda x, i: F.transform(F.filter("at", lambda y: y["seq"] > x["seq"]), lambda y: F.struct(
        x["station_code"].alias("origin"), y["station_code"].alias("target"), x["seq"].alias("from_seq"), y["seq"].alias("to_seq")))
    formed = few.select("train_no", F.explode(F.flatten(F.transform("at", later))).alias("p")).select("p.origin", "p.target", "train_no", "p.from_seq", "p.to_seq")
    # a station asked about with itself is no pair of a train
    return formed.join(asked, ["origin", "target"], "left_semi").unionByName(_long_trains(first.where(F.col("n") > short).drop("n"), asked))


def _long_trains(first: DataFrame, asked: DataFrame) -> DataFrame:
    trains = first.groupBy("station_code").agg(F.count(F.lit(1)).alias("n"))
    ends = (asked.join(trains.select(F.col("station_code").alias("origin"), F.col("n").alias("n_from")), "origin")
            .join(trains.select(F.col("station_code").alias("target"), F.col("n").alias("n_to")), "target"))
    rare = F.when(F.col("n_from") <= F.col("n_to"), F.col("origin")).otherwise(F.col("target"))
    begun = ends.select("origin", "target", rare.alias("station_code"), F.when(rare == F.col("origin"), F.col("target")).otherwise(F.col("origin")).alias("other"))
    begun = begun.join(first, "station_code").select("origin", "target", "train_no", F.col("seq").alias("seq_rare"), F.col("station_code").alias("rare"), F.col("other").alias("station_code"))
    met = begun.join(first, ["train_no", "station_code"])
    from_rare = F.col("rare") == F.col("origin")
    return (met.select("origin", "target", "train_no", F.when(from_rare, F.col("seq_rare")).otherwise(F.col("seq")).alias("from_seq"),
                       F.when(from_rare, F.col("seq")).otherwise(F.col("seq_rare")).alias("to_seq"))
            .where(F.col("from_seq") < F.col("to_seq")))


def enrich_route_names(candidates: DataFrame, documents: DataFrame, score: float = 0.95) -> DataFrame:
    """Puts each valid route's own train document in front and stamps the running days on the route."""
    train_docs = (documents.where(F.col("collection") == "trains").groupBy("train_no")
                  .agg(F.min_by(F.struct("doc_id", "content"), "doc_id").alias("t")).select("train_no", "t.*"))
    infos = train_docs.select("train_no", F.col("doc_id").alias("_id"), F.col("content").alias("_text"),
                              F.trim(F.regexp_extract("content", r"Runs on:([^.]*)", 1)).alias("_runs"))
    joined = candidates.join(infos, "train_no", "left")
    stamped = joined.withColumn("content", F.when(
        (F.col("source_type") == "train_route") & F.col("valid_route") & (F.col("_runs") != ""),
        F.concat("content", F.lit(" | Runs on: "), "_runs")).otherwise(F.col("content")))
    injected = (joined.where(F.col("valid_route") & F.col("_id").isNotNull())
                .withColumn("doc_id", F.col("_id")).withColumn("content", F.col("_text"))
                .withColumn("collection", F.lit("trains")).withColumn("source_type", F.lit("train"))
                .withColumn("score", F.lit(score)).withColumn("rank", -1 - F.col("rank"))
                .withColumn("valid_route", F.lit(False)))
    return stamped.unionByName(injected).drop("_id", "_text", "_runs")


def trim_route(content: Column, stations: Column, above: int = fv.TRIM_ABOVE_STOPS) -> Column:
    """Keeps the first, the last and the asked stops of a route text with more than four stops."""
    at = F.instr(content, "Stops")
    section = F.substring(content, at, F.length(content))
    colon = F.instr(section, ":")
    raw = F.trim(F.substring(section, colon + 1, F.length(section)))
    stops = F.filter(F.transform(F.split(raw, ">"), lambda s: F.trim(s)), lambda s: s != "")
    n = F.size(stops)
    kept = F.filter(stops, lambda s, i: (i == 0) | (i == n - 1) | F.exists(
        stations, lambda x: F.contains(F.lower(s), F.lower(x["name"])) | F.contains(F.lower(s), F.lower(x["code"]))))
    short = F.concat(F.substring(content, F.lit(1), at - 1), F.lit("Stops ("), n.cast("string"),
                     F.lit(" total, key stops shown): "), F.array_join(kept, " > "))
    return F.when((at > 0) & (colon > 0) & (n > above), short).otherwise(content)


def trim_routes(candidates: DataFrame, stations: str = "stations", number_found: str = "number_found") -> DataFrame:
    """``trim_route`` over route documents of questions that name stations but no train number."""
    applies = (F.col("source_type") == "train_route") & (F.size(stations) > 0) & ~F.col(number_found)
    return candidates.withColumn("content", F.when(applies, trim_route(F.col("content"), F.col(stations))).otherwise(F.col("content")))


def limit_results(candidates: DataFrame, entity: str = "has_entity", order=("rank",), k: int = fv.TOP_K,
                  wide: int | None = fv.RESULT_LIMIT_WITH_ENTITY) -> DataFrame:
    """``wide`` documents (all, if None) where a station or train number was found, else ``k``.

    The constant upper bound lets Spark cut each group before the shuffle.
    """
    placed = candidates.withColumn("position", F.row_number().over(W.partitionBy("question_id").orderBy(*order)))
    if wide is None:
        return placed.where(F.col(entity) | (F.col("position") <= k))
    return (placed.where(F.col("position") <= max(wide, k))
            .where(F.col("position") <= F.when(F.col(entity), wide).otherwise(k)))


# ---------------------------------------------------------------- answer material
def context_or_none(questions: DataFrame, results: DataFrame, order: str = "position", budget: int = fv.CONTEXT_BUDGET) -> DataFrame:
    """``context_budget`` for every question; one without documents is told so."""
    found = context_budget(results, order, budget)
    return (questions.select("question_id").join(found, "question_id", "left")
            .select("question_id", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("context", F.lit(fv.NO_DOCUMENTS)).alias("context")))


def context_budget(results: DataFrame, order: str = "position", budget: int = fv.CONTEXT_BUDGET) -> DataFrame:
    """Context text per question: documents in order while they fit, the first one always.

    A question holds the limited result list, so its group is small.
    """
    w = W.partitionBy("question_id").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    kept = (results.withColumn("_sum", F.sum(F.length("content")).over(w)).withColumn("_i", F.count(F.lit(1)).over(w))
            .where((F.col("_sum") <= budget) | (F.col("_i") == 1)))
    block = F.concat(F.lit("[Doc "), F.col("_i").cast("string"), F.lit(" | "), F.coalesce("collection", F.lit("unknown")),
                     F.lit(" | relevance: "), F.coalesce(F.col("score").cast("string"), F.lit("N/A")), F.lit("]\n"), F.col("content"))
    return (kept.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("documents"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", block.alias("b")))), lambda x: x["b"]), fv.DOC_SEPARATOR).alias("context")))


def project_sources(df: DataFrame) -> DataFrame:
    """Adds ``src``: type, score and the fields that identify a document of its type."""
    t = F.col("source_type")
    pick = lambda name, *types: F.when(t.isin(*types), F.coalesce(F.col(name), F.lit(""))).alias(name)
    return df.withColumn("src", F.struct(
        F.coalesce(t, F.lit("unknown")).alias("type"), F.coalesce("score", F.lit(0.0)).alias("relevance_score"),
        pick("train_no", "train", "train_route"), pick("train_name", "train", "train_route"),
        pick("station_code", "station"), pick("station_name", "station"),
        pick("category", "rule"), pick("rule_title", "rule"), pick("ref_type", "reference")))


def no_route_answer(questions: DataFrame, results: DataFrame, stations: str = "stations") -> DataFrame:
    """Fixed answer for questions with two stations and no route document, NULL for the others."""
    routes = (results.where(F.col("source_type") == "train_route").select("question_id").distinct()
              .withColumn("_route", F.lit(True)))
    s = lambda i, f: F.get(F.col(stations), F.lit(i))[f]
    text = F.concat(F.lit("No direct trains were found from **"), s(0, "name"), F.lit(" ("), s(0, "code"), F.lit(")** to **"),
                    s(1, "name"), F.lit(" ("), s(1, "code"), F.lit(")**"), F.lit(fv.NO_ROUTE_TAIL))
    return (questions.join(routes, "question_id", "left")
            .withColumn("answer", F.when((F.size(stations) >= 2) & F.col("_route").isNull(), text)).drop("_route"))


def merge_context(history: Column, live: Column, static: Column) -> Column:
    """History, live and static context, empty parts skipped."""
    some = lambda c: F.when(c != "", c)
    return F.concat_ws("\n\n", some(history), some(live), F.concat(F.lit(fv.STATIC_HEADER), some(static)))


def sources_by_type(sources: DataFrame, type_col: str = "source_type") -> DataFrame:
    """Retrieved sources of a question per type, with counts."""
    return (sources.groupBy("question_id", F.coalesce(type_col, F.lit("reference")).alias("type"))
            .agg(F.count(F.lit(1)).alias("sources"), F.array_sort(F.collect_list("doc_id")).alias("items")))


def avg_relevance(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """Mean score per question, four digits, 0 where it has no source."""
    mean = sources.groupBy("question_id").agg(F.round(F.avg("score"), 4).alias("avg_relevance"))
    return (questions.select("question_id").join(mean, "question_id", "left")
            .withColumn("avg_relevance", F.coalesce("avg_relevance", F.lit(0.0))))

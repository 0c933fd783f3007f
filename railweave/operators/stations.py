"""Station dimension, alias index and the mentions of stations in questions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from railweave import fixed_values as fv
from railweave.functions import text as tx
from railweave.functions.similarity import sequence_ratio

_WORD_EDGE = r"(?<=\w)(?=\W)|(?<=\W)(?=\w)"


def _pick(df: DataFrame, *names: str):
    found = [tx.clean(n) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def alias_list(aka: DataFrame, order: str = "row_id") -> DataFrame:
    """Distinct alternate names per station in first-seen order.

    Equal names are merged before the list is built, so a station with many
    repeated rows sends one row per distinct name.
    """
    named = aka.select(tx.clean("station_code").alias("code"), _pick(aka, "title", "aka_name").alias("alias"),
                       F.col(order).alias("ord")).where(F.col("code").isNotNull() & F.col("alias").isNotNull())
    distinct = named.groupBy("code", "alias").agg(F.min("ord").alias("ord"))
    return (distinct.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("ord", "alias"))).alias("a"))
            .select("code", F.col("a")[0]["ord"].alias("aka_ord"),
                    F.transform("a", lambda x: x["alias"]).alias("aka_all")))


def station_dim(info: DataFrame, zones: DataFrame, aka: DataFrame, order: str = "row_id") -> DataFrame:
    """One row per station code: name, city, zone, coordinates, wifi, alternate names.

    The last row of a repeated code wins; a missing name is taken from the zones;
    codes seen only among the alternate names become stations of their own.
    """
    base = (info.select(tx.clean("station_code").alias("code"), F.col(order).alias("ord"),
                        F.struct(_pick(info, "title", "station_name").alias("name"), _pick(info, "city").alias("city"),
                                 _pick(info, "lat", "latitude").alias("lat"), _pick(info, "lng", "longitude").alias("lng"),
                                 F.coalesce(_pick(info, "wifi_station").isin("1", "True", "true"), F.lit(False)).alias("wifi")
                                 ).alias("_s"))
            .where(F.col("code").isNotNull()).groupBy("code")
            .agg(F.max_by("_s", "ord").alias("_s"), F.min("ord").alias("info_ord"))
            .select("code", "info_ord", "_s.*"))
    fill_name = tx.clean("station_name")
    z = (zones.select(tx.clean("station_code").alias("code"), F.col(order).alias("ord"),
                      F.struct(F.coalesce(_pick(zones, "zone"), _pick(zones, "zone_name")).alias("zone"),
                               F.coalesce(_pick(zones, "zone_name"), _pick(zones, "zone_mapping_name")).alias("zone_name")
                               ).alias("_s"), fill_name.alias("fill"))
         .where(F.col("code").isNotNull()).groupBy("code")
         .agg(F.max_by("_s", "ord").alias("_s"),
              F.min_by("fill", F.when(F.col("fill").isNotNull(), F.col("ord"))).alias("fill"))
         .select("code", "_s.*", "fill"))
    joined = base.join(z, "code", "left").join(alias_list(aka, order), "code", "full")
    known = F.col("info_ord").isNotNull()
    name = F.when(known, F.coalesce("name", "fill")).otherwise(F.get("aka_all", F.lit(0)))
    out = joined.withColumn("name", name)
    others = F.filter(F.coalesce("aka_all", F.array().cast("array<string>")),
                      lambda a: F.col("name").isNull() | (a != F.col("name")))
    return out.select("code", "name", "city", "zone", "zone_name", "lat", "lng",
                      F.coalesce("wifi", F.lit(False)).alias("wifi"), others.alias("aka"), known.alias("in_info"),
                      F.struct(F.when(known, 0).otherwise(1).alias("g"), F.coalesce("info_ord", "aka_ord").alias("o")).alias("ord"))


def alias_index(stations: DataFrame, noise=fv.FIRST_WORD_NOISE) -> DataFrame:
    """Everything a station can be called, lower-cased, each alias with one owner.

    Codes, names and alternates: the later entry wins. First words of multi-word
    names (4 letters or more, no noise word): only where the alias is free, the
    earliest station wins. ``is_name`` marks aliases that are more than a code.
    """
    code, name = F.col("code"), F.col("name")
    entries = F.concat(
        F.array(F.struct(F.lower(code).alias("alias"), F.coalesce(name, code).alias("name"), F.lit(0).alias("kind"), F.lit(0).alias("pos"))),
        F.when(name.isNotNull(), F.array(F.struct(F.lower(name).alias("alias"), name.alias("name"), F.lit(1).alias("kind"), F.lit(0).alias("pos"))))
         .otherwise(F.array()),
        F.transform("aka", lambda a, i: F.struct(F.lower(a).alias("alias"), F.coalesce(name, a).alias("name"), F.lit(2).alias("kind"), i.alias("pos"))))
    main = (stations.select("code", "ord", F.explode(entries).alias("e")).select("code", "ord", "e.*")
            .groupBy("alias")
            .agg(F.max_by(F.struct("name", "code"), F.struct("ord", "kind", "pos")).alias("m"),
                 F.bool_or(F.col("kind") > 0).alias("is_name"))
            .select("alias", "m.name", "m.code", "is_name"))
    words = F.split(name, r"\s+")
    first = F.lower(words[0])
    heads = (stations.where(name.isNotNull() & (F.size(words) > 1) & (F.length(first) >= 4) & ~first.isin(*noise))
             .groupBy(first.alias("alias")).agg(F.min_by(F.struct(name.alias("name"), "code"), "ord").alias("m"))
             .join(main.select("alias"), "alias", "left_anti")
             .select("alias", "m.name", "m.code", F.lit(True).alias("is_name")))
    return main.unionByName(heads)


def station_vocabulary(stations: DataFrame, ignore=fv.VOCABULARY_IGNORE) -> DataFrame:
    """Distinct lower-cased codes and name words (3 letters or more) that hint at a station."""
    words = F.flatten(F.transform(
        F.concat(F.array(F.coalesce("name", F.lit(""))), "aka"),
        lambda n: F.regexp_extract_all(F.lower(n), F.lit(r"\b([a-zA-Z]{3,})\b"), F.lit(1))))
    kept = F.filter(words, lambda t: ~t.isin(*ignore))
    tokens = F.concat(F.array(F.struct(F.lower("code").alias("token"), F.lit("code").alias("kind"))),
                      F.transform(kept, lambda t: F.struct(t.alias("token"), F.lit("name").alias("kind"))))
    return stations.select(F.explode(F.array_distinct(tokens)).alias("t")).select("t.*").distinct()


@F.arrow_udf(ArrayType(IntegerType()))
def _offsets(pieces: pa.Array) -> pa.Array:
    """Characters before each piece of its text, for a whole Arrow batch at once."""
    sizes = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False)
    lengths = pc.utf8_length(pieces.flatten()).to_numpy(zero_copy_only=False)
    ends, before = np.cumsum(sizes), np.concatenate([[0], np.cumsum(lengths)])
    places = before[:-1] - np.repeat(before[ends - sizes], sizes)
    bounds = pa.array(np.concatenate([[0], ends]), pa.int32(), mask=np.append(pieces.is_null().to_numpy(zero_copy_only=False), False))
    return pa.ListArray.from_arrays(bounds, pa.array(places, pa.int32()))


def _placed_words(questions: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Words of a text that match a pattern as a whole, with their character position."""
    pieces = questions.select(key, F.split(text, _WORD_EDGE).alias("word")).withColumn("pos", _offsets("word"))
    return pieces.select(key, F.explode(F.arrays_zip("word", "pos")).alias("p")).select(key, "p.word", "p.pos").where(F.col("word").rlike(pattern))


def _mention_hits(questions: DataFrame, aliases: DataFrame, key: str, text: str, stop_words) -> DataFrame:
    """First place of every alias in every text. Word sequences of the text are
    matched to the alias table by equality, so no text meets every alias; a row holds
    no more of a text than the longest alias, so the work is linear in its length."""
    usable = aliases.where((F.length("alias") > 2) & ~F.col("alias").isin(*stop_words)).select(
        "alias", "name", "code", F.size(F.split("alias", _WORD_EDGE)).alias("pieces"))
    longest = usable.agg(F.coalesce(F.max("pieces"), F.lit(1))).scalar()
    pieces = questions.select(key, F.split(F.lower(text), _WORD_EDGE).alias("pieces")).withColumn("at", _offsets("pieces")).withColumn("longest", longest)
    starts = pieces.select(key, F.explode(F.transform("pieces", lambda _, i: F.struct(
        F.get("at", i).alias("start"), F.slice("pieces", i + 1, F.col("longest")).alias("next")))).alias("s")).where(F.col("s.next")[0].rlike(r"^\w"))
    phrases = starts.select(key, F.col("s.start").alias("start"), F.explode(F.transform(
        F.sequence(F.lit(1), F.size("s.next"), F.lit(2)), lambda n: F.array_join(F.slice("s.next", F.lit(1), n), ""))).alias("alias"))
    return (phrases.join(usable.drop("pieces"), "alias")
            .groupBy(key, "alias", "name", "code").agg(F.min("start").alias("start")))


def resolve_station(questions: DataFrame, aliases: DataFrame, key: str = "question_id", text: str = "question",
                    stop_words=fv.MENTION_STOP_WORDS) -> DataFrame:
    """The one station with the longest alias in the text."""
    hits = _mention_hits(questions, aliases, key, text, stop_words)
    best = F.min_by(F.struct("alias", "name", "code"), F.struct(-F.length("alias"), "start"))
    return hits.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def resolve_station_or_similar(questions: DataFrame, aliases: DataFrame, cutoff: float = fv.FUZZY_CUTOFF_SINGLE, key: str = "question_id",
                               text: str = "question", stop_words=fv.MENTION_STOP_WORDS) -> DataFrame:
    """``resolve_station``, and for texts that name none the station most like the first word that is like any."""
    exact = resolve_station(questions, aliases, key, text, stop_words).select(key, "alias", "name", "code")
    rest = questions.join(exact.select(key), key, "left_anti")
    near = fuzzy_resolve(rest, aliases, cutoff, key, text, ignore=tuple(fv.FUZZY_IGNORE))
    first = near.groupBy(key).agg(F.min(F.struct("pos", "alias", "name", "code")).alias("m"))
    return exact.unionByName(first.select(key, "m.alias", "m.name", "m.code"))


def resolve_mentions(questions: DataFrame, aliases: DataFrame, key: str = "question_id", text: str = "question",
                     stop_words=fv.MENTION_STOP_WORDS) -> DataFrame:
    """Stations named in a text: longest alias first, whole words, no overlapping spans.

    Returns ``key`` and ``mentions``, an array of (start, end, name, code) in text order.
    """
    hits = _mention_hits(questions, aliases, key, text, stop_words)
    span = F.struct((-F.length("alias")).alias("rank"), "start", (F.col("start") + F.length("alias")).alias("end"), "name", "code")
    sorted_spans = F.array_sort(F.collect_list(span))
    empty = F.array().cast("array<struct<rank:int,start:int,end:int,name:string,code:string>>")
    grouped = hits.groupBy(key).agg(sorted_spans.alias("spans"))
    free = F.aggregate("spans", empty, lambda acc, s: F.when(
        F.exists(acc, lambda a: (s["start"] < a["end"]) & (s["end"] > a["start"])), acc).otherwise(F.array_append(acc, s)))
    plain = F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                 s["name"].alias("name"), s["code"].alias("code")))
    none = F.array().cast("array<struct<start:int,end:int,name:string,code:string>>")
    distinct = F.aggregate(F.array_sort(plain), none, lambda acc, s: F.when(
        F.exists(acc, lambda a: (a["name"] == s["name"]) & (a["code"] == s["code"])), acc).otherwise(F.array_append(acc, s)))
    return grouped.select(key, distinct.alias("mentions"))


def _piece_start(length, pieces, i):
    return F.floor(i * length / pieces).cast("int")


def _letters(word: str):
    """Bit for a first and a bit for a second occurrence of each letter; a letter more or less changes one bit at most."""
    times = lambda c: F.length(word) - F.length(F.replace(F.col(word), F.lit(c), F.lit("")))
    bits = [F.when(times(c) > n, F.lit(1 << (2 * i + n))).otherwise(F.lit(0)).cast("bigint") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz") for n in (0, 1)]
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def similar_pairs(words: DataFrame, names: DataFrame, cutoff: float) -> DataFrame:
    """All (word, alias) pairs with a sequence ratio of at least ``cutoff``.

    Ratio >= c leaves at most ``d = floor((1-c)(la+lb))`` unmatched characters, and as many
    more in the longer text as it is longer, so ``d`` is even where ``la+lb`` is. An
    alias cut in ``d+1`` pieces then keeps one piece whole, moved by no more than the
    unmatched characters of either side, so pairs are found by equality on (lengths, piece
    number, piece): exact, and without comparing every word with every alias. Pairs whose
    letters differ too much go before their distance is computed. Both sides are
    made longer by pieces, which Spark's size estimates do not see, so neither is broadcast.
    """
    low, high = cutoff / (2 - cutoff), (2 - cutoff) / cutoff
    band = lambda n: F.sequence(F.greatest(F.lit(1), F.ceil(n * low - 1e-9).cast("int")), F.floor(n * high + 1e-9).cast("int"))
    la, lb = F.col("la"), F.col("lb")
    most = F.floor((1 - cutoff) * (la + lb) + 1e-9).cast("int")
    edits = most - F.pmod(la + lb - most, F.lit(2))
    m, i = F.col("d") + 1, F.col("i")
    start, size = _piece_start(lb, m, i), _piece_start(lb, m, i + 1) - _piece_start(lb, m, i)
    possible = F.col("d") >= F.abs(la - lb)
    # texts are small beside their pieces, so they are dealt over all tasks before those are formed
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = (names.select("alias", F.length("alias").alias("lb")).distinct().repartition(tasks, "alias").withColumn("alias_letters", _letters("alias"))
             .withColumn("la", F.explode(band(F.col("lb")))).withColumn("d", edits).where(possible)
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
             .select("alias", "alias_letters", "la", "lb", "i", F.substring("alias", start + 1, size).alias("piece")))
    # lengths that no alias has are not probed, so a very long word makes no rows
    lengths = names.select(F.length("alias").alias("lb")).distinct()
    probe = (words.select("word", F.length("word").alias("la")).distinct().repartition(tasks, "word").withColumn("word_letters", _letters("word"))
             .withColumn("lb", F.explode(band(F.col("la")))).join(lengths, "lb", "left_semi").withColumn("d", edits).where(possible)
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
             # unmatched characters of the alias move a piece to the left, those of the word to the right
             .withColumn("from", F.greatest(F.lit(0), start - ((F.col("d") + lb - la) / 2).cast("int")))
             .withColumn("to", F.least(la - size, start + ((F.col("d") + la - lb) / 2).cast("int")))
             .where(F.col("from") <= F.col("to"))
             .withColumn("at", F.explode(F.sequence("from", "to")))
             .select("word", "word_letters", "la", "lb", "i", F.substring("word", F.col("at") + 1, size).alias("piece")))
    # the edit distance is never above the unmatched characters; it is far cheaper than the ratio
    pairs = (probe.withColumn("d", edits).hint("merge").join(index.hint("merge"), ["la", "lb", "i", "piece"])
             .where(F.bit_count(F.col("word_letters").bitwiseXOR(F.col("alias_letters"))) <= F.col("d"))
             .where(F.expr("levenshtein(word, alias, d) >= 0")).select("word", "alias").distinct())
    return pairs.withColumn("ratio", sequence_ratio("word", "alias")).where(F.col("ratio") >= cutoff)


def fuzzy_resolve(questions: DataFrame, aliases: DataFrame, cutoff: float = fv.FUZZY_CUTOFF_ALL,
                  key: str = "question_id", text: str = "question", ignore=tuple(fv.FUZZY_IGNORE + fv.MENTION_STOP_WORDS)) -> DataFrame:
    """Best station per word of 4 letters or more, by similarity; both sides lower-cased.

    Works on the distinct words, so a word that many questions share is compared once. A
    word that is an alias has itself as the best one and is compared with no other.
    """
    words = (_placed_words(questions, key, text, "^[a-zA-Z]{4,}$").withColumn("word", F.lower("word"))
             .where(~F.col("word").isin(*ignore)))
    distinct = words.select("word").distinct()
    names = aliases.where(F.col("is_name"))
    known = names.select(F.col("alias").alias("word")).distinct()
    same = distinct.join(known, "word", "left_semi").where(F.lit(cutoff) <= 1).select("word", F.lit(1.0).alias("ratio"), F.col("word").alias("alias"))
    near = (similar_pairs(distinct.join(known, "word", "left_anti"), names, cutoff).groupBy("word")
            .agg(F.max(F.struct("ratio", "alias")).alias("b")).select("word", "b.ratio", "b.alias"))
    owner = same.unionByName(near).join(aliases.select("alias", "name", "code"), "alias")
    return words.join(owner, "word").select(key, "pos", "word", "alias", "ratio", "name", "code")


def code_lookup(questions: DataFrame, stations: DataFrame, found: DataFrame | None = None, key: str = "question_id",
                text: str = "question", noise=fv.CODE_NOISE) -> DataFrame:
    """Stations named by a bare code of 2-5 letters, unless already found in the question."""
    rows = (_placed_words(questions, key, text, "^[a-zA-Z]{2,5}$").withColumn("code", F.upper("word"))
            .where(~F.col("code").isin(*noise)).groupBy(key, "code").agg(F.min("pos").alias("pos")))
    hits = rows.join(stations.select("code", F.coalesce("name", "code").alias("name")), "code")
    if found is not None:
        hits = hits.join(found.select(key, "code").distinct(), [key, "code"], "left_anti")
    return hits.select(key, "pos", "name", "code")

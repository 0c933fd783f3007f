"""Question classification as columns: pattern ladder, keyword counts, scores, decision."""

from __future__ import annotations

import re
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railweave import fixed_values as fv
from railweave.functions import text as tx
from railweave.functions.runtime import materialise

#: Text that stands for itself in a pattern, what a word of it may hold besides, gaps between its parts, and the part that is a number.
_PLAIN, _LOOSE, _GAP, _NUMBER = r"[A-Za-z0-9 ']+", r"\\s\+|\\d\??|.\?|\.", r"\.\{\d+,\d+\}", r"\b\d{4,5}\b"


def _needed(pattern: str) -> tuple[bool, list[list[str]]]:
    """Whether a text must hold four digits, and words, lower-cased and one of each list, where ``pattern`` matches it.

    Parts of a pattern between gaps such as ``.{0,25}`` all match where the pattern does.
    Only numbers, words and choices of words tell anything; patterns whose gaps lie
    inside a group or a choice tell nothing.
    """
    parts = re.split(_GAP, pattern)
    outside = re.sub(r"\([^()]*\)", "", pattern)
    if "|" in outside or any(p.count("(") != p.count(")") or p[:1] in ("?", "+", "*", ")") or "[" in p or r"\(" in p or r"\)" in p for p in parts):
        return False, []
    units = [re.sub(r"^\\b|\\b$", "", u) for p in parts for u in re.split(r"\\s\+(?![^()]*\))", p)]
    choices = [u.removeprefix("(").removesuffix(")").split("|") for u in units if re.fullmatch(r"[^()]*|\([^()]*\)", u)]
    words = [[max(re.split(_LOOSE, alternative), key=len).lower() for alternative in choice] for choice in choices]
    return _NUMBER in parts, [some for some in words if all(re.fullmatch(_PLAIN, w) for w in some)]


def match_patterns(df: DataFrame, text: str = "question", patterns=fv.QUESTION_PATTERNS) -> DataFrame:
    """Category and confidence of the first pattern that matches, NULL if none does.

    A pattern is tried only on texts that hold the words it cannot do without; looking
    for words costs little beside a pattern.
    """
    def ladder(row: Column) -> Column:
        def matches(pattern: str) -> Column:
            number, words = _needed(pattern)
            tests = [row["digits"]] * number + [tx.contains_any(row["low"], some) for some in words]
            return reduce(lambda a, b: a & b, [*tests, row["text"].rlike(f"(?i){pattern}")])

        return F.coalesce(*[F.when(matches(p), F.struct(F.lit(c).alias("category"), F.lit(float(s)).alias("confidence"))) for p, c, s in patterns])

    # bound to a row, as generated code for the whole ladder is too long for the JVM to compile
    row = F.struct(F.col(text).alias("text"), F.lower(text).alias("low"), F.col(text).rlike(r"\d{4}").alias("digits"))
    return (df.withColumn("_m", tx.bind(row, ladder)).withColumn("pattern_category", F.col("_m.category"))
            .withColumn("pattern_confidence", F.col("_m.confidence")).drop("_m"))


def _whole_words(lowered: Column, tokens: Column, keywords) -> Column:
    """The keywords that occur as whole words, in list order. Single words are compared
    with the tokens; only phrases that the text contains need a pattern."""
    runs = [(phrase, list(words)) for phrase, words in groupby(keywords, key=lambda k: " " in k)]
    none = F.array().cast("array<string>")
    whole = lambda p: lowered.contains(p) & lowered.rlike(rf"\b{p}\b") if re.fullmatch(_PLAIN, p) else lowered.rlike(rf"\b{p}\b")
    found = [F.concat(*[F.when(whole(p), F.array(F.lit(p))).otherwise(none) for p in words]) if phrase
             else F.array_intersect(F.array(*[F.lit(k) for k in words]), tokens) for phrase, words in runs]
    return F.concat(*found)


def count_keywords(df: DataFrame, text: str = "question") -> DataFrame:
    """Whole-word hits of the five keyword sets."""
    lowered = F.trim(F.lower(text))
    out = df.withColumn("_low", lowered).withColumn("_tok", F.regexp_extract_all(lowered, F.lit(r"(\w+)"), F.lit(1)))
    low, tok = F.col("_low"), F.col("_tok")
    return (out.withColumn("live_hits", _whole_words(low, tok, fv.LIVE_KEYWORDS))
            .withColumn("schedule_hits", _whole_words(low, tok, fv.SCHEDULE_KEYWORDS))
            .withColumn("static_hits", _whole_words(low, tok, fv.STATIC_KEYWORDS))
            .withColumn("routing_hits", _whole_words(low, tok, fv.ROUTING_KEYWORDS))
            .withColumn("general_hit", F.size(_whole_words(low, tok, fv.GENERAL_KEYWORDS)) > 0)
            .drop("_low", "_tok"))


def has_station(questions: DataFrame, vocabulary: DataFrame, key: str = "question_id", text: str = "question",
                stop_words=fv.STATION_STOP_WORDS) -> DataFrame:
    """Adds ``station_word``: whether a token is a station code or a word of a station name."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b([a-zA-Z]{2,})\b"), F.lit(1)))
    words = questions.select(key, F.explode(tokens).alias("token")).where(~F.col("token").isin(*stop_words))
    hits = (words.join(vocabulary.select("token").distinct(), "token", "left_semi").select(key).distinct()
            .withColumn("station_word", F.lit(True)))
    return questions.join(hits, key, "left").withColumn("station_word", F.coalesce("station_word", F.lit(False)))


def extract_entities(df: DataFrame, text: str = "question") -> DataFrame:
    return (df.withColumn("train_no", tx.train_number(text)).withColumn("pnr", tx.booking_number(text))
            .withColumn("station_code", tx.station_code_token(text)))


def coarse_intent(category: Column, mapping=fv.COARSE_INTENT) -> Column:
    return reduce(lambda chain, item: chain.when(category == item[0], item[1]), mapping.items(), F).otherwise(None)


def score_intent(df: DataFrame, text: str = "question") -> DataFrame:
    """Decision over the counted signals, used where no pattern matched.

    Expects the columns of ``extract_entities``, ``count_keywords`` and
    ``has_station``. Adds category, confidence and reasons.
    """
    n = lambda c: F.size(c)
    cap = lambda x: F.least(F.lit(1.0), x)
    lowered = F.trim(F.lower(text))
    live_n, schedule_n, static_n, routing_n = n("live_hits"), n("schedule_hits"), n("static_hits"), n("routing_hits")
    has_train = F.col("train_no").isNotNull()
    station = F.col("station_code").isNotNull() | F.col("station_word")
    off_domain = ~(has_train | F.col("pnr").isNotNull() | station | (live_n > 0) | (static_n > 0) | (schedule_n > 0)
                   | (routing_n > 0) | F.col("general_hit"))
    bare_train = has_train & (live_n == 0) & (schedule_n == 0) & (static_n == 0)
    class_word = tx.contains_any(lowered, fv.TRAIN_CLASS_WORDS)

    scored = (df.withColumn("_live", cap(F.lit(0.35) * live_n)).withColumn("_sched", cap(F.lit(0.30) * schedule_n))
              .withColumn("_static", cap(F.lit(0.30) * static_n + F.lit(0.20) * routing_n)
                          + F.when(bare_train, 0.4).otherwise(0.0) + F.when(station, 0.3).otherwise(0.0)
                          + F.when(class_word, 0.2).otherwise(0.0)))
    live, sched, static = F.col("_live"), F.col("_sched"), F.col("_static")
    branch = (F.when(off_domain, "off")
              .when((sched > live) & (sched > 0.2), "schedule")
              .when((live > 0.05) & ((static > 0.05) | (sched > 0.05)), "both")
              .when(live > static, "live")
              .when((static > 0) | F.col("general_hit"), "general").otherwise("unsure"))
    scored = scored.withColumn("_branch", branch)
    b = F.col("_branch")
    category = (F.when(b == "off", "OUT_OF_DOMAIN").when(b == "schedule", "SCHEDULE_QUERY").when(b == "live", "LIVE_STATUS")
                .when(b == "general", "GENERAL_INFO").otherwise("HYBRID"))
    confidence = (F.when(b == "off", 1.0).when(b == "schedule", cap(sched + 0.1))
                  .when(b == "both", cap((live + F.greatest(static, sched)) / 2.0)).when(b == "live", cap(live))
                  .when(b == "general", cap(F.greatest(F.lit(0.5), static))).otherwise(0.45))
    listed = lambda head, c: F.when(F.size(c) > 0, F.concat(
        F.lit(f"{head} keywords: ["), F.array_join(F.transform(c, lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", "), F.lit("]")))
    reasons = F.array_compact(F.array(
        listed("Live", "live_hits"), listed("Schedule", "schedule_hits"), listed("Static", "static_hits"),
        F.when(bare_train, "Train number with no other signals → default to STATIC train info"),
        F.when(station, "Station name/code detected → boost STATIC score"),
        F.when(class_word, "Train classification name detected → boost STATIC"),
        F.when(b == "both", "Both live and static/schedule signals → HYBRID"),
        F.when((b == "live") & ~has_train, "LIVE detected but no train number in query"),
        F.when(b == "unsure", "Low confidence → fallback to HYBRID")))
    return (scored.withColumn("category", category).withColumn("confidence", F.round(confidence, 2))
            .withColumn("reasons", F.when(b == "off", F.array(F.lit("No railway signals found in query"))).otherwise(reasons))
            .drop("_live", "_sched", "_static", "_branch"))


def classify_questions(questions: DataFrame, vocabulary: DataFrame, key: str = "question_id", text: str = "question") -> DataFrame:
    """Intent, category, confidence, entities and reasons per question.

    Classification depends on the text alone, so it runs once per distinct text.
    A text that many questions share is merged before it is shuffled. A question
    without a text is classified as an empty one. Texts and their classes are stored, as
    several steps, here and behind this one, read them.
    """
    texts = questions.select(F.coalesce(F.col(text), F.lit("")).alias(text)).distinct()
    # short texts are much work, so they are dealt to all tasks whatever their size
    texts = materialise(texts.repartition(int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions")), text), "texts")
    prepared = score_intent(count_keywords(match_patterns(extract_entities(has_station(texts, vocabulary, text, text), text), text), text), text)
    matched = F.col("pattern_category").isNotNull()
    category = F.coalesce("pattern_category", "category")
    off = ~matched & (F.col("category") == "OUT_OF_DOMAIN")
    is_pnr = category == "PNR_STATUS"
    result = prepared.select(
        text, coarse_intent(category).alias("intent"), category.alias("intent_category"),
        F.coalesce("pattern_confidence", "confidence").alias("confidence"),
        F.when(~off, F.col("train_no")).alias("train_no"),
        F.when(~off, F.col("station_code")).alias("station_code"),
        F.when(is_pnr, F.col("pnr")).alias("pnr"), is_pnr.alias("is_pnr"),
        F.when(matched, F.array(F.concat(F.lit("Pattern match → "), category))).otherwise(F.col("reasons")).alias("reasons"))
    same = F.coalesce(questions[text], F.lit("")) == F.col("_text")
    return questions.join(materialise(result.withColumnRenamed(text, "_text"), "classes"), same).drop("_text")


def session_upgrade(df: DataFrame, text: str = "question", own: str = "train_no", carried: str = "session_train") -> DataFrame:
    """Fills the train number from the session and upgrades vague STATIC questions to HYBRID."""
    from_session = F.col(own).isNull() & F.col(carried).isNotNull()
    vague = ((F.col("intent") == "STATIC") & ~F.col("intent_category").isin(*fv.UPGRADE_EXEMPT)
             & tx.contains_any(F.lower(text), fv.UPGRADE_WORDS))
    return (df.withColumn("intent", F.when(from_session & vague, "HYBRID").otherwise(F.col("intent")))
            .withColumn(own, F.coalesce(own, carried)))


def data_needs(df: DataFrame, text: str = "question") -> DataFrame:
    """Which sources a question needs, and the text to search with."""
    booking = F.col("is_pnr") & F.col("pnr").isNotNull()
    train = F.col("train_no")
    return (df.withColumn("needs_booking", booking)
            .withColumn("needs_static", ~booking & F.col("intent").isin("STATIC", "HYBRID"))
            .withColumn("needs_live", ~booking & F.col("intent").isin("LIVE", "HYBRID") & train.isNotNull())
            .withColumn("search_text", F.when(train.isNotNull() & ~F.col(text).contains(train),
                                              F.concat(F.col(text), F.lit(" train "), train)).otherwise(F.col(text))))

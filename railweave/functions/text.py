"""Column helpers. Each returns one Column and stays inside JVM expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railweave import fixed_values as fv


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: str | Column, default: str | None = None, tokens=fv.NULL_TOKENS) -> Column:
    """Trimmed text, with the null tokens turned into NULL (or ``default``)."""
    t = F.trim(col(c).cast("string"))
    t = F.when(~t.isin(*tokens), t)
    return t if default is None else F.coalesce(t, F.lit(default))


def clean_nulls(df: DataFrame, tokens=fv.NULL_TOKENS) -> DataFrame:
    """``clean`` over every string column of a table."""
    return df.select(
        *[clean(f.name, tokens=tokens).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name)
          for f in df.schema.fields]
    )


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, for expressions that read it several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def part(condition: Column, *pieces) -> Column:
    """Concatenated pieces where the condition holds, else empty text."""
    return F.when(condition, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in pieces])).otherwise("")


def if_present(c: Column, before: str = "", after: str = "") -> Column:
    return part(c.isNotNull(), before, c, after)


def label(name: Column, code: Column) -> Column:
    """``name (code)``, or the code where the name is unknown or equal to it."""
    return F.when(name.isNotNull() & (name != code), F.concat(name, F.lit(" ("), code, F.lit(")"))).otherwise(code)


def code_array(c: str | Column) -> Column:
    """JSON array of strings; text such as ``[A, B]`` that is not JSON is split on commas.

    Blank text gives an empty array.
    """
    raw = F.trim(col(c))
    loose = F.filter(
        F.transform(F.split(F.regexp_replace(raw, r"^[\[\]]+|[\[\]]+$", ""), ","),
                    lambda x: F.regexp_replace(F.trim(x), r'^"+|"+$', "")),
        lambda x: x != "",
    )
    return F.coalesce(F.from_json(raw, "array<string>"), loose)


def format_clock(c: str | Column) -> Column:
    """``19.33`` to ``19:33``; the sentinels First and Last pass through."""
    t = clean(c)
    return F.when(t.isin("First", "Last"), t).otherwise(F.replace(t, F.lit("."), F.lit(":")))


def clock_minutes(c: Column) -> Column:
    """HH:MM text to minutes since midnight, NULL for anything else."""
    ok = c.rlike(r"^\d{1,2}:\d{2}$")
    return F.when(ok, F.split_part(c, F.lit(":"), F.lit(1)).cast("int") * 60
                  + F.split_part(c, F.lit(":"), F.lit(2)).cast("int"))


def seconds_to_hhmm(c: str | Column) -> Column:
    s = col(c).cast("bigint")
    hours = F.pmod(F.floor(s / 3600), F.lit(24)).cast("string")
    minutes = F.floor(F.pmod(s, F.lit(3600)) / 60).cast("string")
    return F.concat(F.lpad(hours, 2, "0"), F.lit(":"), F.lpad(minutes, 2, "0"))


def running_days(c: str | Column, day_names=fv.DAY_NAMES) -> Column:
    """Bit list to Daily / Weekdays / Weekends / day names.

    The two array constants start the week on Sunday while the day names start
    on Monday; that mismatch is published behaviour and is kept.
    """
    bits = F.transform(
        F.filter(F.split(F.coalesce(col(c), F.lit("")), ","), lambda x: F.trim(x).rlike(r"^\d+$")),
        lambda x: F.trim(x).cast("int"))
    names = F.array(*[F.lit(d) for d in day_names])
    as_array = lambda values: F.array(*[F.lit(v) for v in values])
    picked = F.filter(F.transform(bits, lambda b, i: F.when(b == 1, F.get(names, i))), lambda d: d.isNotNull())
    return (F.when(F.size(bits) == 0, "Unknown")
            .when(F.forall(bits, lambda b: b == 1), "Daily")
            .when(bits == as_array(fv.WEEKDAY_BITS), "Weekdays")
            .when(bits == as_array(fv.WEEKEND_BITS), "Weekends")
            .otherwise(F.array_join(picked, ", ")))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, NULL where the pattern does not match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def train_number(c: str | Column) -> Column:
    """First 5-digit number, else 4 digits after train / no / number / #."""
    q = col(c)
    return F.coalesce(first_group(q, r"\b(\d{5})\b"),
                      first_group(q, r"(?i)(?:train|no\.?|number|#)\s*(\d{4})\b"))


def booking_number(c: str | Column) -> Column:
    return first_group(col(c), r"\b(\d{10})\b")


def station_code_token(c: str | Column, exclude=fv.STATION_CODE_EXCLUDE) -> Column:
    """First token of 2-4 capitals that is not in the exclude list."""
    tokens = F.regexp_extract_all(col(c), F.lit(r"\b([A-Z]{2,4})\b"), F.lit(1))
    return F.get(F.filter(tokens, lambda t: ~t.isin(*exclude)), F.lit(0))


def question_key(c: str | Column) -> Column:
    return F.md5(F.trim(F.lower(col(c))).cast("binary"))


def labelled_field(c: str | Column, name: str) -> Column:
    """Value of a ``NAME: value`` line, empty text where there is none."""
    return F.trim(F.regexp_extract(col(c), rf"(?im)^{name}:\s*(.+)$", 1))


def preview(c: str | Column, chars: int = fv.PREVIEW_CHARS) -> Column:
    t = col(c)
    return F.when(F.length(t) > chars, F.concat(F.substring(t, 1, chars), F.lit("..."))).otherwise(t)


def delay_minutes(c: str | Column) -> Column:
    """Delay in any written form to minutes, never negative."""
    t = F.trim(col(c).cast("string"))
    number = F.regexp_extract(t, r"(\d+)", 1).try_cast("bigint")
    signed = t.rlike(r"^-\d+(\.\d+)?$")
    return (F.when(t.isNull() | (t == "") | F.lower(t).isin("on time", "right time") | signed, F.lit(0))
            .otherwise(F.coalesce(number, F.lit(0))))


def valid_booking_key(c: str | Column) -> Column:
    return F.trim(col(c)).rlike(r"^\d{10}$")


def expand_synonyms(c: str | Column, synonyms=fv.SYNONYMS) -> Column:
    """Whole-word, case-insensitive replacements, applied one after the other."""
    return reduce(lambda text, rule: F.regexp_replace(text, f"(?i){rule[0]}", rule[1]), synonyms, col(c))


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a term in a text."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int")


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def entity_numbers(c: str | Column) -> Column:
    """Distinct 4-5 digit numbers (one leading zero allowed), zeros stripped, zero itself left out."""
    found = F.regexp_extract_all(col(c), F.lit(r"\b(0?\d{4,5})\b"), F.lit(1))
    return F.filter(F.array_distinct(F.transform(found, lambda t: t.cast("int").cast("string"))), lambda t: t != "0")


def title_case(c: str | Column) -> Column:
    """Lower case with a capital after every character that is not a letter."""
    words = F.split(F.lower(col(c)), r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")

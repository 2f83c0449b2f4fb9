"""Time expressions of a text, resolved into intervals of days against the time of the review. All are native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for numbers, months in order, units that an interval can have.
NUMBERS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
]
UNITS = ["day", "week", "month", "year"]

_NUMBER = "(?:[0-9]{1,4}|an?|" + "|".join(NUMBERS) + ")"
_UNIT = "(?:" + "|".join(UNITS) + ")s?"
_MONTH = "(?:" + "|".join(MONTHS) + ")"
AGO = f"{_NUMBER} {_UNIT} ago"
DURATION = f"(?:after|within|for|past|last) {_NUMBER} {_UNIT}"
CALENDAR = "(?:last|this) (?:week|month|year)"
NEAR = "(?:yesterday|today)"
MONTH = f"(?:since|in) {_MONTH}(?: (?:19|20)[0-9]{{2}})?"
YEAR = "(?:since|in) (?:19|20)[0-9]{2}"
ISO = "(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}"
# Without letters, digits and signs that join words on either side.
PATTERN = rf"(?U)(?<![\w-])(?:{AGO}|{DURATION}|{CALENDAR}|{NEAR}|{MONTH}|{YEAR}|{ISO})(?![\w-])"
INTERVAL = "struct<phrase:string,first:date,last:date>"


def _number(phrase: Column) -> Column:
    word = F.regexp_extract(phrase, rf"({_NUMBER}) {_UNIT}", 1)
    listed = F.array_position(F.array(*map(F.lit, NUMBERS)), word).cast("int")
    return F.when(word.isin("a", "an"), 1).when(listed > 0, listed).otherwise(word.try_cast("int"))


def _moved(day: Column, unit: Column, count: Column) -> Column:
    """``day`` moved by ``count`` units; at the end of a month to its last day."""
    return (
        F.when(unit == "day", F.date_add(day, count))
        .when(unit == "week", F.date_add(day, count * 7))
        .when(unit == "month", F.add_months(day, count))
        .otherwise(F.add_months(day, count * 12))
    )


def interval(phrase: Column, at: Column) -> Column:
    """``struct<phrase, first, last>`` of one phrase that ``PATTERN`` finds, for a review of the day ``at``.

    "n units ago" is the unit that lies so far back, "after n units" (within, for, past, last) the time from then on, "last
    month" the calendar month before, "in march" the latest march that has begun, "since" lasts until the review. Weeks begin
    on Mondays. A date that does not exist, or a review without a time, has no days.
    """
    count = _number(phrase)
    unit = F.regexp_extract(phrase, f"({'|'.join(UNITS)})", 1)
    since = F.startswith(phrase, F.lit("since"))
    number = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(phrase, f"({_MONTH})", 1)).cast("int")
    stated = F.regexp_extract(phrase, "([0-9]{4})", 1)
    year = stated.try_cast("int")
    month_year = F.coalesce(year, F.year(at) - F.when(number > F.month(at), 1).otherwise(0))
    month_start = F.make_date(month_year, F.when(number > 0, number), F.lit(1))
    year_start = F.make_date(year, F.lit(1), F.lit(1))
    back = F.trunc(at, "week")
    calendar = F.when(unit == "week", back).when(unit == "month", F.trunc(at, "month")).otherwise(F.trunc(at, "year"))
    calendar = F.when(F.startswith(phrase, F.lit("last")), _moved(calendar, unit, F.lit(-1))).otherwise(calendar)
    exact = F.try_to_date(F.regexp_extract(phrase, f"({ISO})", 1), "yyyy-MM-dd")
    ago, span, named_unit = (phrase.rlike(f"^{p}$") for p in (AGO, DURATION, CALENDAR))
    first = (
        F.when(ago | span, _moved(at, unit, -count))
        .when(named_unit, calendar)
        .when(phrase == "yesterday", F.date_sub(at, 1))
        .when(phrase == "today", at)
        .when(number > 0, month_start)
        .when(phrase.rlike(f"^{ISO}$"), exact)
        .otherwise(year_start)
    )
    last = (
        F.when(span, at)
        .when(ago, F.date_sub(_moved(first, unit, F.lit(1)), 1))
        .when(named_unit, F.date_sub(_moved(first, unit, F.lit(1)), 1))
        .when(phrase.isin("yesterday", "today") | phrase.rlike(f"^{ISO}$"), first)
        .when(since, F.greatest(at, first))
        .when(number > 0, F.last_day(first))
        .otherwise(F.date_sub(F.add_months(first, 12), 1))
    )
    known = at.isNotNull()
    return F.struct(phrase.alias("phrase"), F.when(known, first).alias("first"), F.when(known, last).alias("last"))


def time_intervals(text: Column, at: Column) -> Column:
    """``array<struct<phrase, first, last>>`` of the time expressions in the order of the text, repeats included; null text
    gives an empty array."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({PATTERN})"), F.lit(1))
    return F.transform(found, lambda phrase: interval(phrase, at.cast("date")))

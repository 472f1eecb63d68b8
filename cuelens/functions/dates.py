"""Dates in texts, and their age. Clocks are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuelens.functions.text import bind, spans

# Forms of a date in order, and words beside a date that make it a dateline.
FULL = r"((?:19|20)\d{2})\s*年\s*(1[0-2]|0?[1-9])\s*月\s*(3[01]|[12]?\d)\s*日"
MONTH = r"((?:19|20)\d{2})\s*年\s*(1[0-2]|0?[1-9])\s*月(?!\s*(?:3[01]|[12]?\d)\s*日)"
ISO = r"\b((?:19|20)\d{2})-([01]?\d)-([0-3]?\d)\b"
WIRE = "电|讯|报道|记者"


def calendar_day(y: Column, mo: Column, d: Column) -> Column:
    """The date, null where the calendar of 1990 to 2100 has none; tested by numbers, since a date that fails to be read costs an exception."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = F.when(mo == 2, F.when(leap, 29).otherwise(28)).when(mo.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.when(y.between(1990, 2100) & mo.between(1, 12) & (d >= 1) & (d <= last), F.make_date(y, mo, d))


def absolute_dates(text: Column) -> Column:
    """array<struct<start,end,date,precision>> of dates of 1990 to 2100 that the calendar has: full ones, months, ISO ones, each day and each month once."""

    def read(pattern: str, precision: str) -> Column:
        def one(m: Column) -> Column:
            def dated(parts: Column) -> Column:
                y, mo, d = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.coalesce(F.get(parts, F.lit(2)), F.lit(1))
                return F.struct(m["start"].alias("start"), m["end"].alias("end"), calendar_day(y, mo, d).alias("date"), F.lit(precision).alias("precision"))

            return bind(F.transform(F.regexp_extract_all(m["value"], F.lit(r"\d+"), F.lit(0)), lambda d: d.try_cast("int")), dated)

        return F.transform(spans(text, pattern), one)

    every = F.filter(F.concat(read(FULL, "day"), read(MONTH, "month"), read(ISO, "day")), lambda x: x["date"].isNotNull())
    empty = F.array().cast("array<struct<start:int,end:int,date:date,precision:string>>")
    seen = lambda done, x: F.exists(done, lambda k: (k["date"] == x["date"]) & (k["precision"] == x["precision"]))
    once = lambda found: F.aggregate(found, empty, lambda done, x: F.when(seen(done, x), done).otherwise(F.concat(done, F.array(x))))
    return bind(every, lambda found: F.when(F.size(found) > 1, once(found)).otherwise(found))


def as_of(text: Column, relative: tuple[tuple[str, int], ...], now: Column, provided: Column | None = None) -> Column:
    """struct<date,method,precision>: provided date, else the first date within the first 120 characters or of the text, else a relative cue that starts in the first 160.

    A date of the text is ``wire`` if a dateline's words stand within 12 characters before or 8 behind it, else ``absolute``.
    Each form of a date is matched once. Keep the column (``text.held``) before several of its fields are taken.
    """
    kind = "struct<date:date,method:string,precision:string>"

    def made(date: Column, method: str | Column, precision: str | Column) -> Column:
        return F.struct(date.alias("date"), (F.lit(method) if isinstance(method, str) else method).alias("method"), (F.lit(precision) if isinstance(precision, str) else precision).alias("precision")).cast(kind)

    def told(first: Column) -> Column:
        beside = F.substring(text, F.greatest(F.lit(1), first["start"] - 11), first["end"] - F.greatest(F.lit(0), first["start"] - 12) + 8)
        return F.when(first.isNotNull(), made(first["date"], F.when(beside.rlike(WIRE), "wire").otherwise("absolute"), first["precision"]))

    def first_of(dates: Column) -> Column:
        early = F.try_element_at(F.filter(dates, lambda x: x["end"] <= 120), F.lit(1))
        return bind(F.coalesce(early, F.try_element_at(dates, F.lit(1))), told)

    given = [F.when(provided.isNotNull(), made(provided, "provided", "day"))] if provided is not None else []
    cues = [F.when(F.contains(F.substring(text, 1, 159 + len(cue)), F.lit(cue)), made(F.date_sub(now, days), "relative", "relative")) for cue, days in relative]
    return F.coalesce(*given, bind(absolute_dates(text), first_of), *cues, made(F.lit(None).cast("date"), "none", "none"))

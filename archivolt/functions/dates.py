"""Dates named in texts, and relative dates of questions."""

from __future__ import annotations

import re
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_M = "|".join(MONTHS)
_ABBR = "Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec"
_NAME = rf"(?:{_M}|(?:{_ABBR})\.?)"
_ORD = "(?:st|nd|rd|th)?"
_YEAR = r"(?:1[5-9]\d\d|20\d\d)"
#: Forms of dates, tried in this order at each place, with how precise and how sure they are.
FORMS = (
    (rf"{_YEAR} ?[-–] ?{_YEAR}", "range", 0.8),
    (r"\d{4}-\d{2}-\d{2}", "iso", 0.95),
    (rf"\d{{1,2}}{_ORD} {_NAME},? {_YEAR}", "day first", 0.95),
    (rf"{_NAME} \d{{1,2}}{_ORD},? {_YEAR}", "month first", 0.95),
    (r"\d{1,2}/\d{1,2}/(?:\d{4}|\d{2})", "slashes", 0.7),
    (r"\d{1,2}\.\d{1,2}\.(?:\d{4}|\d{2})", "dots", 0.7),
    (rf"{_NAME} {_YEAR}", "month", 0.8),
    (rf"(?:[Ii]n|[Ss]ince|[Dd]uring|[Uu]ntil|[Bb]efore|[Aa]fter) {_YEAR}", "year", 0.6),
)
#: One pattern for a single pass; a digit or letter before or after makes it no date.
ANY = r"(?:^|[^\w.,/-])(" + "|".join(p for p, _, _ in FORMS) + r")(?:[^\w/-]|$)"
#: Three letters of the months in order, to read names and abbreviations alike.
SHORT = "janfebmaraprmayjunjulaugsepoctnovdec"


def _date(y: Column, m: Column, d: Column) -> Column:
    """A date, or null for one that doesn't exist."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")


def date_mentions(df: DataFrame, key: str, text: str, century: int = 1900) -> DataFrame:
    """key, surface, date_start, date_end, precision and confidence of the dates in each text.

    All forms are found in one pass over the text, the first that fits at a place
    (FORMS), and told apart afterwards. Days span themselves, months, years and
    ranges of years all their days; a year of two digits is of ``century``, and
    slashes hold the month first. Impossible dates drop out; repeats in one text
    stay one row; null texts give nothing.
    """
    each = df.select(F.col(key), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(1)))).alias("surface"))
    s = F.col("surface")
    form = reduce(lambda c, f: c.when(s.rlike(f"^(?:{f[0]})$"), f[1]), FORMS[1:], F.when(s.rlike(f"^(?:{FORMS[0][0]})$"), FORMS[0][1]))
    number = lambda n: F.try_element_at(F.regexp_extract_all(s, F.lit(r"(\d+)"), F.lit(1)), F.lit(n)).cast("int")
    name = F.lower(F.left(F.regexp_extract(s, r"([A-Z][a-z]+)", 1), F.lit(3)))
    month = ((F.instr(F.lit(SHORT), name) + 2) / 3).cast("int")
    full = lambda y: F.when(y < 100, y + century).otherwise(y)
    told = each.withColumn("form", form).withColumns({"n1": number(1), "n2": number(2), "n3": number(3), "m": month})
    is_ = lambda *names: F.col("form").isin(*names)
    n1, n2, n3, m, one = F.col("n1"), F.col("n2"), F.col("n3"), F.col("m"), F.lit(1)
    start = (
        F.when(is_("range", "year"), _date(n1, one, one)).when(is_("iso"), _date(n1, n2, n3)).when(is_("day first"), _date(n2, m, n1)).when(is_("month first"), _date(n2, m, n1))
        .when(is_("slashes"), _date(full(n3), n1, n2)).when(is_("dots"), _date(full(n3), n2, n1)).otherwise(_date(n1, m, one))
    )
    end = F.when(is_("range"), _date(n2, F.lit(12), F.lit(31))).when(is_("year"), _date(n1, F.lit(12), F.lit(31))).when(is_("month"), F.last_day("date_start")).otherwise(F.col("date_start"))
    precision = F.when(is_("range", "year", "month"), F.col("form")).otherwise("day")
    sure = reduce(lambda c, f: c.when(F.col("form") == f[1], f[2]), FORMS[1:], F.when(F.col("form") == FORMS[0][1], FORMS[0][2]))
    dated = told.withColumn("date_start", start).withColumn("date_end", end).where("date_start is not null and date_end >= date_start")
    return dated.select(key, "surface", "date_start", "date_end", precision.alias("precision"), sure.alias("confidence"))


def relative_range(text: str, today: date) -> tuple[date | None, date | None] | None:
    """The range of a phrase such as ``last month``, ``3 years ago``, ``before 1944``, ``the 1940s`` or ``May 1944``; None where it is none."""
    t = text.strip().lower()
    first = lambda y, m: date(y, m, 1)
    end = lambda y, m: (first(y + m // 12, m % 12 + 1)) - timedelta(days=1)
    if m := re.fullmatch(r"(last|this) (day|week|month|year)", t):
        back = m[1] == "last"
        if m[2] == "day":
            d = today - timedelta(days=int(back))
            return d, d
        if m[2] == "week":
            start = today - timedelta(days=today.weekday() + 7 * back)
            return start, start + timedelta(days=6)
        if m[2] == "month":
            y, mo = (today.year, today.month - 1) if back else (today.year, today.month)
            y, mo = (y - 1, 12) if mo == 0 else (y, mo)
            return first(y, mo), end(y, mo)
        return date(today.year - back, 1, 1), date(today.year - back, 12, 31)
    if m := re.fullmatch(r"(\d+) (day|week|month|year)s? ago", t):
        n = int(m[1])
        if m[2] in ("day", "week"):
            d = today - timedelta(days=n * (7 if m[2] == "week" else 1))
            return d, d
        months = today.year * 12 + today.month - 1 - n * (12 if m[2] == "year" else 1)
        return first(months // 12, months % 12 + 1), end(months // 12, months % 12 + 1)
    if m := re.fullmatch(r"(before|after|since|until) (\d{4})", t):
        y = int(m[2])
        return {"before": (None, date(y - 1, 12, 31)), "until": (None, date(y, 12, 31)), "after": (date(y + 1, 1, 1), None), "since": (date(y, 1, 1), None)}[m[1]]
    if m := re.fullmatch(r"(?:the )?(\d{3})0s", t):
        return date(int(m[1]) * 10, 1, 1), date(int(m[1]) * 10 + 9, 12, 31)
    if m := re.fullmatch(r"(?:in )?(\w+) (\d{4})", t):
        names = [n.lower() for n in MONTHS]
        if m[1] in names:
            k = names.index(m[1]) + 1
            return first(int(m[2]), k), end(int(m[2]), k)
    if m := re.fullmatch(r"(?:in )?(\d{4})", t):
        return date(int(m[1]), 1, 1), date(int(m[1]), 12, 31)
    return None

"""Date parsing and month arithmetic.

Dates are recognised by shape and rewritten as ISO text, so bad input is null and no formatter is
tried (and no exception thrown) per row and format.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.functions.text import bound, trimmed

_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august",
           "september", "october", "november", "december")


def _month_number(name: Column, abbreviated_only: bool = False) -> Column:
    entries: dict[str, int] = {m[:3]: i for i, m in enumerate(_MONTHS, 1)}
    if not abbreviated_only:
        entries.update({m: i for i, m in enumerate(_MONTHS, 1)})
    table = F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])
    return F.try_element_at(table, F.lower(name))


def _rewritten(text: Column, pattern: str, iso: str) -> Column:
    return F.regexp_replace(text, pattern, iso).try_cast("date")


def _named(text: Column, pattern: str, order: str, year: Column | None = None,
           abbreviated_only: bool = False) -> Column:
    """Date of a pattern with a month name; `order` names its groups: b, d and maybe y."""
    group = {key: F.regexp_extract(text, pattern, i) for i, key in enumerate(order, 1)}
    month = _month_number(group["b"], abbreviated_only).cast("string")
    iso = F.concat(group.get("y", year), F.lit("-"), month, F.lit("-"), group["d"])
    return iso.try_cast("date")


# Shapes of dates; Spark's own cast reads 'y-m-d' with or without leading zeros.
_YEAR_FIRST = r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})$"
_YEAR_LAST = r"^(\d{1,2})([-/])(\d{1,2})\2(\d{4})$"
_COMPACT = r"^(\d{4})(1[0-2]|0[1-9]|[1-9])(3[01]|[12]\d|0[1-9]|[1-9])$"
_NAME_DAY_COMMA_YEAR = r"(?U)^([A-Za-z]+)\s+(\d{1,2}),\s+(\d{4})$"
_NAME_DAY_YEAR = r"(?U)^([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})$"
_DAY_NAME_YEAR = r"(?U)^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})$"
_NAME_DAY = r"(?U)^([A-Za-z]{3})\s*(\d{1,2})$"
_DAY_NAME = r"(?U)^(\d{1,2})(?:\s+|-)([A-Za-z]{3})$"
_MONTH_SLASH_DAY = r"^(\d{1,2})/(\d{1,2})$"
_PACKED = r"^([A-Za-z]{3})(\d{1,2})(\d{4})$"


def _with_full_year(text: Column) -> Column:
    """Numeric shapes with a separator; month before day where both fit."""
    return (F.when(text.rlike(_YEAR_FIRST), F.translate(text, "/", "-").try_cast("date"))
            .when(text.rlike(_YEAR_LAST), F.coalesce(
                _rewritten(text, _YEAR_LAST, "$4-$1-$3"),
                _rewritten(text, _YEAR_LAST, "$4-$3-$1"))))


def read_date(text: Column) -> Column:
    """Date of a trimmed CSV cell in any of the eleven accepted shapes; null if none fits."""
    return (_with_full_year(text)
            .when(text.rlike(_COMPACT), _rewritten(text, _COMPACT, "$1-$2-$3"))
            .when(text.rlike(_NAME_DAY_COMMA_YEAR), _named(text, _NAME_DAY_COMMA_YEAR, "bdy"))
            .when(text.rlike(_DAY_NAME_YEAR), _named(text, _DAY_NAME_YEAR, "dby")))


def read_statement_date(text: Column, year: Column) -> Column:
    """Date of a trimmed statement cell; shapes without a year take `year`."""
    # the kinds of the first and the last character say which shapes are left to try; a shape
    # that only fits by digits beyond ASCII is no date, so such texts need no try
    given = year.cast("string")
    first, last = F.substring(text, 1, 1), F.substring(text, -1, 1)
    digit_first, digit_last = first.between("0", "9"), last.between("0", "9")
    letter_first = first.between("A", "Z") | first.between("a", "z")
    numeric = (_with_full_year(text)
               .when(text.rlike(_DAY_NAME_YEAR), _named(text, _DAY_NAME_YEAR, "dby"))
               .when(text.rlike(_MONTH_SLASH_DAY), F.concat(
                   given, F.lit("-"), F.translate(text, "/", "-")).try_cast("date")))
    named = (F.when(text.rlike(_NAME_DAY_YEAR), _named(text, _NAME_DAY_YEAR, "bdy"))
             .when(text.rlike(_NAME_DAY), _named(text, _NAME_DAY, "bd", given, True))
             .when(text.rlike(_PACKED), _named(text, _PACKED, "bdy", None, True)))
    return (F.when(F.contains(text, F.lit(".")), F.lit(None).cast("date"))
            .when(digit_first & digit_last, numeric)
            .when(letter_first & digit_last, named)
            .when(digit_first & text.rlike(_DAY_NAME), _named(text, _DAY_NAME, "db", given, True)))


def parse_date(raw: Column) -> Column:
    return bound(trimmed(raw), read_date)


def first_line(text: Column) -> Column:
    """The first line of a trimmed text, trimmed."""
    return F.when(F.contains(text, F.lit("\n")), trimmed(F.substring_index(text, "\n", 1))) \
        .otherwise(text)


def parse_statement_date(raw: Column, year: Column) -> Column:
    """As read_statement_date, of the first line of an untrimmed cell."""
    first_line = F.substring_index(trimmed(raw), "\n", 1)
    return bound(trimmed(first_line), lambda text: read_statement_date(text, year))


def month_text(day: Column) -> Column:
    """'2001-08' of a date."""
    return F.date_format(day, "yyyy-MM")


def month_label(day: Column) -> Column:
    """'Aug 2001' of a date."""
    return F.date_format(day, "MMM yyyy")


def month_floor(day: Column) -> Column:
    return F.trunc(day, "MM")


def shift_month(day: date, months: int) -> date:
    """First day of the month `months` away from `day` (driver-side scalar)."""
    index = day.year * 12 + day.month - 1 + months
    return date(index // 12, index % 12 + 1, 1)


def parse_month(text: str | None) -> date | None:
    """'2001-08' (longer text is cut) as its first day; None if it is no month."""
    try:
        return date(int(text[:4]), int(text[5:7]), 1) if text else None
    except ValueError:
        return None


def parse_months(text: str | None) -> list[date]:
    """Months of a comma list, in the order given; parts that are no month are left out."""
    months = []
    for part in (text or "").split(","):
        pieces = part.strip().split("-")
        try:
            year, month = (int(p) for p in pieces)
            months.append(date(year, month, 1))
        except ValueError:
            continue
    return months


def month_ranges(months: list[date]) -> list[tuple[date, date]]:
    """Months merged into half-open date ranges, so a scan can prune on the date column."""
    ranges: list[tuple[date, date]] = []
    for start in sorted(set(months)):
        end = shift_month(start, 1)
        if ranges and ranges[-1][1] == start:
            ranges[-1] = (ranges[-1][0], end)
        else:
            ranges.append((start, end))
    return ranges

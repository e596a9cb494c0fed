"""Money as integer cents: sums stay exact and both halves of a comparison round alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.functions.text import WHITE_SPACE, bound, trimmed


def to_cents(amount: Column) -> Column:
    """Whole cents of a double amount."""
    return F.round(amount * 100).cast("long")


def to_ten_thousandths(amount: Column) -> Column:
    """Amount at four decimals, as an integer; the grain of duplicate keys."""
    return F.round(amount * 10000).cast("long")


def from_cents(cents: Column) -> Column:
    return cents / F.lit(100.0)


def _whole_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def average_cents(total: Column, months: int) -> Column:
    """Half-up integer average of a non-negative cent total."""
    return _whole_div(total * 2 + months, F.lit(2 * months).cast("long"))


def tenths_of_percent(part: Column, whole: Column) -> Column:
    """part / whole as percent with one decimal (0 when whole is 0), half-up on integers."""
    share = _whole_div(part * 2000 + whole, F.nullif(whole * 2, F.lit(0).cast("long")))
    return F.coalesce(share, F.lit(0).cast("long")) / F.lit(10.0)


def cents_text(cents: Column) -> Column:
    """'1234.50' for 123450; never scientific notation."""
    unsigned = F.abs(cents)
    return F.concat(
        F.when(cents < 0, F.lit("-")).otherwise(F.lit("")),
        _whole_div(unsigned, F.lit(100).cast("long")).cast("string"),
        F.lit("."),
        F.lpad((unsigned % 100).cast("string"), 2, "0"),
    )


# Python's float() syntax without inf/nan; keeps Java-only forms such as '5d' out.
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _number(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def _parenthesised_negative(text: Column) -> Column:
    return F.when(
        text.startswith("(") & text.endswith(")"),
        F.concat(F.lit("-"), F.substring(text, F.lit(2), F.length(text) - 2)),
    ).otherwise(text)


def _cleaned(text: Column) -> Column:
    return F.regexp_replace(_parenthesised_negative(text), r"(?U)[,$\s]", "")


# what `_cleaned` drops, as single characters; white space of (?U)\s has no separators 1c to 1f
_DROPPED = ",$" + "".join(c for c in WHITE_SPACE if not "\x1c" <= c <= "\x1f")


def clean_amount(text: Column) -> Column:
    """A trimmed CSV amount without ',', '$' and white space, '(x)' as '-x'."""
    return F.translate(_parenthesised_negative(text), _DROPPED, "")


def read_clean_amount(text: Column, clean: Column) -> Column:
    """Value of a trimmed cell and its `clean_amount`. The two steps of read_amount, for use with
    computed_once: unlike `bound` that stays in generated code."""
    return F.when(text == "", F.lit(0.0)).otherwise(_number(clean))


def read_amount(text: Column) -> Column:
    """Amount of a trimmed CSV cell: blank is 0, '(x)' is -x, ',', '$' and spaces are dropped,
    bad text is null."""
    return F.when(text == "", F.lit(0.0)).otherwise(bound(_cleaned(text), _number))


def parse_amount(raw: Column) -> Column:
    return bound(trimmed(raw), read_amount)


def parse_statement_amount(raw: Column) -> Column:
    """Statement amount: as read_amount, but blank is null and '$(x)' is -x too."""
    return bound(bare_amount(trimmed(raw)), read_bare_amount)


def bare_amount(text: Column) -> Column:
    """A trimmed statement amount without ',', '$' and blanks."""
    return F.translate(text, ",$ ", "")


def read_bare_amount(text: Column) -> Column:
    """Value of a `bare_amount`. The two steps of parse_statement_amount, for use with
    computed_once: unlike `bound` that stays in generated code."""
    return _number(_parenthesised_negative(text))


def split_amount(debit_raw: Column, credit_raw: Column) -> Column:
    """Signed amount of separate debit/credit columns: debit unless zero, else minus credit."""
    sides = F.struct(parse_amount(F.coalesce(debit_raw, F.lit(""))).alias("debit"),
                     parse_amount(F.coalesce(credit_raw, F.lit(""))).alias("credit"))
    # both cells must be readable, as a bad cell rejects the row
    return bound(sides, lambda s: F.when(
        s["debit"].isNotNull() & s["credit"].isNotNull(),
        F.when(s["debit"] != 0, s["debit"]).otherwise(-s["credit"])))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)

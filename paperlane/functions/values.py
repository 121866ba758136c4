"""Amounts, dates and the format tests of single field values, as SQL expressions."""

from __future__ import annotations

from . import fixed
from .sql import any_of, case, first_value, lit
from .text import strip


def _digits(value: str) -> str:
    return f"regexp_replace({value}, {lit(r'[^\d.]')}, '')"


def numeric_amount(value: str) -> str:
    """Digits and dots of a string read as a number; 0 when that is not a number."""
    return f"coalesce(try_cast({_digits(value)} AS double), 0D)"


MONEY = "decimal(38,8)"


def money(value: str) -> str:
    """The same number as an exact decimal, for sums and comparisons within a cent; what is no number is 0.

    Thirty digits before the point and eight behind it are exact. A longer number has to be told apart by `money_too_large`.
    """
    return f"coalesce(try_cast({_digits(value)} AS {MONEY}), cast(0 AS {MONEY}))"


def money_too_large(value: str) -> str:
    """Whether a number has more than thirty digits before the point, so that its cents cannot be compared."""
    number = f"try_cast({_digits(value)} AS double)"
    return f"(length({value}) > 30 AND {number} IS NOT NULL AND try_cast({_digits(value)} AS {MONEY}) IS NULL)"


def money_or_null(value: str) -> str:
    """`money`, but NULL for a number that is too large."""
    return f"IF({money_too_large(value)}, NULL, {money(value)})"


def plain_number(value: str) -> str:
    """A number's text without an exponent: mantissa and exponent written out as digits; other text as it is.

    An exponent beyond 400 counts as 400, more than any amount that can be told from another.
    """
    part = lambda i: f"regexp_extract({value}, {lit(r'^(-?\d+)\.?(\d*)[eE]([+-]?\d+)$')}, {i})"
    whole, sign = "ltrim('-', n.whole)", "IF(startswith(n.whole, '-'), '-', '')"
    shift = "greatest(-400, least(400, coalesce(try_cast(n.shift AS int), IF(startswith(n.shift, '-'), -400, 400))))"
    digits, point = f"concat({whole}, n.rest)", f"(length({whole}) + {shift})"
    written = case(
        [
            (f"{point} <= 0", f"concat({sign}, '0.', repeat('0', -{point}), {digits})"),
            (f"{point} >= length({digits})", f"concat({sign}, rpad({digits}, {point}, '0'))"),
        ],
        f"concat({sign}, substring({digits}, 1, {point}), '.', substring({digits}, {point} + 1))",
    )
    parts = f"named_struct('whole', {part(1)}, 'rest', {part(2)}, 'shift', {part(3)})"
    return f"IF({value} RLIKE '[eE]', {first_value(parts, 'n', f"IF(n.shift = '', {value}, {written})")}, {value})"


def parse_date(value: str) -> str:
    """First layout that reads the stripped string as a real date, else NULL.

    A string is rewritten to year-month-day in each order its shape allows;
    the cast then rejects impossible days without raising.
    """

    def day(shape: str, order: str) -> str:
        return f"try_cast(regexp_replace(s, {lit(shape)}, {lit(order)}) AS date)"

    branches = []
    for shape, orders in fixed.DATE_SHAPES:
        days = [day(shape, order) for order in orders]
        branches.append((f"s RLIKE {lit(shape)}", f"coalesce({', '.join(days)})"))

    # Two-digit years: month and day first, then day and month, then the year in front.
    def short_day(year: str, month: str, dom: str) -> str:
        full = f"concat(IF({year} >= '{fixed.PIVOT_YEAR}', '19', '20'), {year}, '-', {month}, '-', {dom})"
        return f"IF(length({year}) = 2, try_cast({full} AS date), NULL)"

    first, second, third = "p[0]", "p[1]", "p[2]"
    days = [short_day(third, first, second), short_day(third, second, first), short_day(first, second, third)]
    short = first_value("split(s, '/')", "p", f"coalesce({', '.join(days)})")
    branches.append((f"s RLIKE {lit(fixed.SHORT_DATE_SHAPE)}", short))
    return first_value(strip(value), "s", case(branches))


def _matches(value: str, rule: str) -> str:
    return any_of(f"{value} RLIKE {lit(pattern)}" for pattern in fixed.FIELD_FORMATS[rule])


def valid_email(value: str) -> str:
    return _matches(value, "email")


def valid_phone(value: str) -> str:
    return _matches(f"regexp_replace({value}, {lit(fixed.PHONE_PUNCTUATION)}, '')", "phone")


def valid_date_format(value: str) -> str:
    return _matches(value, "date")


def valid_amount_format(value: str) -> str:
    return _matches(value, "amount")


def valid_invoice_number(value: str) -> str:
    return _matches(f"upper({value})", "invoice_number")


def valid_tax_id(value: str) -> str:
    return _matches(value, "tax_id")


FORMAT_TESTS = {
    "email": valid_email,
    "phone": valid_phone,
    "date": valid_date_format,
    "amount": valid_amount_format,
    "invoice_number": valid_invoice_number,
    "tax_id": valid_tax_id,
}

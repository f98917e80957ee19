"""Column expressions shared by the operators. All stay on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def tolerant_double(value) -> Column:
    """Text to double; anything unparsable becomes null."""
    return _c(value).try_cast("double")


def tolerant_date(value) -> Column:
    return _c(value).try_cast("date")


def half_even_long(value) -> Column:
    """Banker's rounding to a nullable bigint."""
    return F.bround(_c(value)).cast("bigint")


def ratio(numerator, denominator) -> Column:
    """Quotient that is null when the denominator is zero or null."""
    if isinstance(numerator, str) and isinstance(denominator, str):
        return F.expr(f"CAST(`{numerator}` AS DOUBLE) / nullif(CAST(`{denominator}` AS DOUBLE), 0D)")
    return _c(numerator).cast("double") / F.nullif(_c(denominator).cast("double"), F.lit(0.0))


def or_zero(value) -> Column:
    return F.coalesce(_c(value), F.lit(0))


def captured(value, pattern: str) -> Column:
    """First capture group of the pattern, null when nothing matches."""
    return F.nullif(F.regexp_extract(_c(value), pattern, 1), F.lit(""))


def event_id(name, fallback) -> Column:
    """Hashtag number anywhere, else a leading number, else the fallback id."""
    return F.coalesce(
        captured(name, r"#(\d{2,})"), captured(name, r"^\s*(\d{2,})\b"), _c(fallback)
    )


def hour_of_range(value) -> Column:
    """'07:00:00 - 07:59:59' -> 7."""
    return F.substring(_c(value), 1, 2).try_cast("int")


def creative_format(name) -> Column:
    # The formats recognised in ad names.
    found = F.regexp_extract(F.lower(_c(name)), "(reel|post|story|carousel|video)", 1)
    return F.when(F.coalesce(found, F.lit("")) == "", "other").otherwise(found)


def name_has(name, word: str) -> Column:
    """1 when the word occurs in the name, ignoring case; null names count as 0."""
    return F.coalesce(F.lower(_c(name)).contains(word.lower()), F.lit(False)).cast("int")


def type_is(value, expected: str) -> Column:
    return F.coalesce(_c(value) == expected, F.lit(False)).cast("int")


def segment_label(dims) -> Column:
    """Dimension values joined for display; a null value shows as 'nan'."""
    return F.concat_ws(
        " / ", *[F.coalesce(_c(d).cast("string"), F.lit("nan")) for d in dims]
    )


def first_usable(*values) -> Column:
    """First value that is not null and not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(_c(v)), F.lit("")) for v in values])


def yes_or_blank(flag) -> Column:
    return F.when(_c(flag), "oui").otherwise("")

"""Normalised forms of matched values, as Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that Python's str.strip takes away, as far as texts hold it.
BLANK = " \t\n\r\x0b\x0c "


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def email(c: Column) -> Column:
    return F.lower(stripped(c))


def upper_alnum(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def date_context(c: Column) -> Column:
    return F.regexp_replace(stripped(c), r"(?iu)^(?:ur\.?|data urodzenia[: ]|dob[: ])\s*", "")


def case_identifier(c: Column) -> Column:
    return F.upper(stripped(c))


def swift_bic(c: Column) -> Column:
    return F.regexp_extract(F.upper(c), r"(?U)\b([A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b", 1)


def identity(c: Column) -> Column:
    return c


NORMALIZERS: dict[str, Callable[[Column], Column]] = {
    "digits": digits, "email": email, "upper_alnum": upper_alnum, "date_context": date_context, "case_identifier": case_identifier,
    "swift_bic": swift_bic, "identity": identity,
}

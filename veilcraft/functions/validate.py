"""Validators of matched values, as Column functions that are true or false for every non-null value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.spans import let
from .gazetteer import BLOCKED, SUFFIXES, SURNAMES, given_name_forms
from .normalize import case_identifier, date_context, digits, stripped, swift_bic, upper_alnum

# Weights of check digits.
PESEL_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)
NIP_WEIGHTS = (6, 5, 7, 2, 3, 4, 5, 6, 7)
REGON_WEIGHTS = (8, 9, 2, 3, 4, 5, 6, 7)
REGON_LONG_WEIGHTS = (2, 4, 8, 5, 0, 9, 7, 3, 6, 1, 2, 4, 8)
#: What PESEL adds to the month in each century.
PESEL_CENTURIES = ((0, 1900), (20, 2000), (40, 2100), (60, 2200), (80, 1800))

UPPER = "A-ZŁŚŻŹĆŃÓ"
LOWER = "a-ząćęłńóśźż"


def _full(c: Column, pattern: str, flags: str = "") -> Column:
    return c.rlike(f"{flags}\\A(?:{pattern})\\z")


# Validators of check digits take the digits once, by ``let``: within arrays Spark computes an expression anew wherever it stands, once for each weight.


def _number(c: Column, start: int, length: int = 1) -> Column:
    return F.expr("0") + F.substring(c, start, length).try_cast("int")


def _weighted(c: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights, 1):
        total = total + F.lit(w) * _number(c, i)
    return total


def _all_equal(c: Column) -> Column:
    return c.rlike(r"\A(.)\1*\z")


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def always_true(c: Column) -> Column:
    return F.lit(True)


def email(c: Column) -> Column:
    return _full(c, r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", "(?iu)")


def phone(c: Column) -> Column:
    d, n = digits(c), F.length(digits(c))
    return (n == 9) | ((n == 11) & d.startswith("48")) | ((n == 13) & d.startswith("0048"))


def phone_fragment(c: Column) -> Column:
    d, n = digits(c), F.length(digits(c))
    return F.when(d.startswith("0048"), n.between(10, 13)).when(d.startswith("48"), n.between(8, 11)).otherwise(n.between(6, 9))


def pesel(c: Column) -> Column:
    def dated(d: Column, month: Column) -> Column:
        date = F.lit(None).cast("timestamp")
        for offset, century in PESEL_CENTURIES:
            made = F.try_make_timestamp(_number(d, 1, 2) + century, month - offset, _number(d, 5, 2), F.lit(0), F.lit(0), F.lit(0))
            date = F.when((month > offset) & (month <= offset + 12), made).otherwise(date)
        return date.isNotNull()

    def of_digits(d: Column) -> Column:
        check = (10 - _weighted(d, PESEL_WEIGHTS) % 10) % 10
        return _sure((F.length(d) == 11) & ~_all_equal(d) & (check == _number(d, 11)) & let(_number(d, 3, 2), lambda month: dated(d, month)))

    return let(digits(c), of_digits)


def nip(c: Column) -> Column:
    right = lambda d: let(_weighted(d, NIP_WEIGHTS) % 11, lambda check: (check != 10) & (check == _number(d, 10)))
    return let(digits(c), lambda d: _sure((F.length(d) == 10) & right(d)))


def regon(c: Column) -> Column:
    ends = lambda d, weights: _weighted(d, weights) % 11 % 10 == _number(d, len(weights) + 1)
    return let(digits(c), lambda d: _sure(F.when(F.length(d) == 9, ends(d, REGON_WEIGHTS)).when(F.length(d) == 14, ends(d, REGON_LONG_WEIGHTS)).otherwise(False)))


def krs(c: Column) -> Column:
    return F.length(digits(c)) == 10


def iban(c: Column) -> Column:
    v = upper_alnum(c)
    turned = F.concat(F.substr(v, F.lit(5)), F.substring(v, 1, 4))
    # a letter counts as two digits; the remainder is carried from character to character
    value = lambda x: F.when(x.rlike("[0-9]"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, x: F.when(x == "", acc).otherwise((acc * F.when(value(x) > 9, 100).otherwise(10) + value(x)) % 97))
    return F.length(v).between(15, 34) & (rest == 1)


def bank_account(c: Column) -> Column:
    v, d = upper_alnum(c), digits(c)
    return F.when(v.startswith("PL") & (F.length(v) == 28), iban(v)).when(F.length(d) == 26, iban(F.concat(F.lit("PL"), d))).otherwise(iban(c))


def labeled_bank_account(c: Column) -> Column:
    d = digits(c)
    return (F.length(d) == 26) & ~_all_equal(d)


def labeled_bank_account_fragment(c: Column) -> Column:
    d = digits(c)
    return F.length(d).between(20, 26) & ~_all_equal(d)


def ip_address(c: Column) -> Column:
    parts = F.split(c, r"\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike(r"\A[0-9]+\z") & _sure(p.try_cast("decimal(38,0)") <= 255))


def vehicle_registration(c: Column) -> Column:
    v = upper_alnum(c)
    return _full(v, "[A-Z]{1,3}[A-Z0-9]{4,6}") & v.rlike("[0-9]")


def device_identifier(c: Column) -> Column:
    v = stripped(c)
    return F.length(v).between(3, 64) & _full(v, "[A-Za-z0-9][A-Za-z0-9._-]*") & v.rlike("[A-Za-z]")


def card_number(c: Column) -> Column:
    d = digits(c)
    doubled = lambda x: F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)
    # every second digit from the right but one
    total = F.aggregate(
        F.reverse(F.split(d, "")),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("at")),
        lambda acc, x: F.when(x == "", acc).otherwise(
            F.struct((acc["sum"] + F.when(acc["at"] % 2 == 1, doubled(x.try_cast("int"))).otherwise(x.try_cast("int"))).alias("sum"), (acc["at"] + 1).alias("at"))
        ),
        lambda acc: acc["sum"],
    )
    return F.length(d).between(13, 19) & _sure(total % 10 == 0)


def postal_code(c: Column) -> Column:
    return _full(c, r"\d{2}-\d{3}", "(?U)")


def date_of_birth(c: Column) -> Column:
    v = date_context(c)
    day_first = r"\A(\d{1,2})([./-])(\d{1,2})\2(\d{4})\z"
    year_first = r"\A(\d{4})-(\d{1,2})-(\d{1,2})\z"
    part = lambda pattern, i: F.regexp_extract(v, pattern, i).try_cast("int")
    exists = lambda y, m, d: F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)).isNotNull() & (y > 0)
    return _sure(
        F.when(v.rlike(day_first), exists(part(day_first, 4), part(day_first, 3), part(day_first, 1)))
        .when(v.rlike(year_first), exists(part(year_first, 1), part(year_first, 2), part(year_first, 3)))
        .otherwise(False)
    )


def document_number(c: Column) -> Column:
    v = upper_alnum(c)
    return F.length(v).between(6, 24) & v.rlike("[0-9]")


def case_number(c: Column) -> Column:
    return F.upper(c).rlike(r"(?U)\b[A-Z]{1,6}\s*[A-Z]?\s*\d+/\d{2,4}\b")


def contract_number(c: Column) -> Column:
    return case_identifier(c).rlike(r"(?U)\b(?:CONTRACT|UMOWA|AGR|CNT)(?:\s+(?:NUMBER|NO|NR))?[-/_ :]*[A-Z0-9/_-]*\d[A-Z0-9/_-]{2,}\b")


def swift_code(c: Column) -> Column:
    v = F.when(swift_bic(c) != "", swift_bic(c)).otherwise(upper_alnum(c))
    return _full(v, "[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?")


def generic_reference(c: Column) -> Column:
    v = upper_alnum(c)
    return F.length(v).between(4, 32) & v.rlike("[0-9]")


def _tax_number(c: Column, pattern: str, otherwise: Callable[[Column], Column]) -> Column:
    v = F.regexp_extract(upper_alnum(c), pattern, 1)
    return (
        F.when(v == "", False)
        .when(v.startswith("PL") & (F.length(v) == 12), nip(F.substr(v, F.lit(3))))
        .when(v.rlike(r"\A[0-9]+\z"), F.length(v).between(10, 14))
        .otherwise(otherwise(v))
    )


def vat_id(c: Column) -> Column:
    pattern = r"(?:VATUE|VATID|UEVAT|EUVAT|VAT)[A-Z0-9]*?([A-Z]{2}[A-Z0-9]{6,14}|\d{10,14})\b"
    return _tax_number(c, pattern, lambda v: F.length(v) >= 8)


def tax_id(c: Column) -> Column:
    pattern = r"(?:TAXID|TIN|IDENTYFIKATORPODATKOWY)[A-Z0-9]*?([A-Z]{2}[A-Z0-9]{6,14}|\d{10,14}|[A-Z0-9]{6,18})\b"
    return _tax_number(c, pattern, lambda v: F.length(v).between(6, 18) & v.rlike("[0-9]"))


def address(c: Column) -> Column:
    v = stripped(c)
    street = F.lower(v).rlike(r"ul\.|al\.|pl\.|os\.|ulica|aleja")
    number = v.rlike(r"(?iU)\b\d+[A-Z]?(?:/\d+[A-Z]?)?\b")
    postal = v.rlike(r"(?U)\b\d{2}-\d{3}\b")
    city = v.rlike(r"(?U)\b\d{2}-\d{3}\s+[A-ZĄĆĘŁŃÓŚŹŻ][A-Za-zĄĆĘŁŃÓŚŹŻąćęłńóśźż -]+")
    return (street & number) | city | (postal & number)


def _one_of(words: tuple[str, ...]) -> str:
    return r"\A(?:" + "|".join(words) + r")\z"


def surname_like(word: Column) -> Column:
    """A frequent surname, or one with a surname's ending; of a compound, all parts."""
    ends = "(?:" + "|".join(SUFFIXES) + r")\z"
    one = lambda w: w.rlike(_one_of(SURNAMES)) | F.lower(w).rlike(ends)
    bare = F.regexp_replace(word, r"\.+\z", "")
    return one(bare) | (bare.contains("-") & F.forall(F.split(bare, "-"), one))


def person_full_name(c: Column, names: tuple[str, ...] | None = None) -> Column:
    given = names or given_name_forms()
    spaced = stripped(F.regexp_replace(c, r"(?U)\s+", " "))
    honorific = r"(?iu)^(?:pan|pani|pana|panią|panem|z\s+panem|z\s+panią|dr\.?|mgr\.?|mec\.?|adw\.?|radca\s+prawny)\s+"
    candidate = F.regexp_replace(spaced, honorific, "")
    words = F.filter(F.split(F.regexp_replace(candidate, "-", " "), r"(?U)\s+"), lambda w: w != "")
    initial, word = rf"\A[{UPPER}]\.\z", rf"\A[{UPPER}][{LOWER}]+\z"
    plain = F.filter(words, lambda w: ~w.rlike(initial))
    known = F.exists(plain, lambda w: w.rlike(_one_of(given)) | surname_like(w))
    return (
        (candidate != "")
        & (F.length(candidate) <= 96)
        & (F.size(words) > 0)
        & ~F.exists(words, lambda w: w.rlike(_one_of(BLOCKED)))
        & F.forall(words, lambda w: w.rlike(word) | w.rlike(initial))
        & (F.size(plain) <= 4)
        & known
    )


VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "always_true": always_true, "email": email, "phone": phone, "phone_fragment": phone_fragment, "pesel": pesel, "nip": nip, "regon": regon,
    "krs": krs, "iban": iban, "bank_account": bank_account, "labeled_bank_account": labeled_bank_account,
    "labeled_bank_account_fragment": labeled_bank_account_fragment, "card_number": card_number, "ip_address": ip_address,
    "vehicle_registration": vehicle_registration, "device_identifier": device_identifier, "postal_code": postal_code,
    "date_of_birth": date_of_birth, "document_number": document_number, "case_number": case_number, "contract_number": contract_number,
    "swift_bic": swift_code, "generic_reference": generic_reference, "vat_id": vat_id, "tax_id": tax_id, "address": address,
    "person_full_name": person_full_name,
}

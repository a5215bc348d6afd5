"""Detection rules: what a span of each entity type looks like, and how it is normalised and validated.

Patterns are Java regular expressions, used with the flags ``(?iUd)`` (no case, Unicode classes, line feeds only). A group
named ``entity`` is the span where there is one, else the whole match. Rules apply in order of priority, then as listed; of
equal spans of a type the first rule's stays.

``needs`` and ``digits`` only save time: every match holds one of the literals (in lower case) and at least so many digits, so
texts without them are not searched.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

from .gazetteer import given_name_forms

FLAGS = "(?iUd)"


class Rule(NamedTuple):
    entity_type: str
    pattern: str
    normalizer: str
    validator: str
    confidence: float
    context: bool = False
    priority: int = 100
    description: str = ""
    needs: tuple[str, ...] = ()
    digits: int = 0


_ENTITY = "(?<entity>"


def marked(pattern: str) -> str:
    """``pattern`` with groups ``lead``, ``entity`` and ``rest`` that make up the match, so that the span's place is known.

    The group ``entity`` must stand by itself: not inside another group, an alternative or a repetition. Other patterns, and those
    that refer to groups by number, raise ValueError.
    """
    flags = re.match(r"(?:\(\?[a-zA-Z]+\))*", pattern)[0]
    body = pattern[len(flags) :]
    at = begin = end = None
    depth = inside = 0
    bars = []
    i = 0
    while i < len(body):
        c = body[i]
        if c == "\\":
            if body[i + 1 : i + 2] in tuple("123456789Qk"):
                raise ValueError("the place of the span can't be told: quoting or a reference to a group")
            i += 2
            continue
        if c == "[":
            inside += 1
        elif c == "]" and inside:
            inside -= 1
        elif not inside:
            if body.startswith(_ENTITY, i):
                if begin is not None or depth:
                    raise ValueError("the place of the span can't be told: entity lies inside a group, or twice")
                begin, at = i, depth
            if c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
                if begin is not None and end is None and depth == at:
                    end = i + 1
            elif c == "|" and not depth:
                bars.append(i)
        i += 1
    if depth or inside:
        raise ValueError("brackets don't match")
    if begin is None:
        return f"{flags}(?<lead>)(?<entity>{body})(?<rest>)"
    if bars or body[end : end + 1] in tuple("?*+{"):
        raise ValueError("the place of the span can't be told: entity lies in an alternative or is repeated")
    return f"{flags}(?<lead>{body[:begin]}){body[begin:end]}(?<rest>{body[end:]})"


# Parts of patterns that several rules share.
_PHONE_PREFIX = r"(?:(?:\(\+?48\)|\+?48|0048)[\s-]*)?"
_NIP = r"\d{3}[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{2}"
_LABELLED = r"[:\s#/-]*"
_BROKEN = r"[\s:;,.#/-]{0,16}"
_DOCUMENT = r"(?:[:\s#/-]+nr)?[:\s#/-]*[A-Z0-9-]*\d[A-Z0-9-]{4,23}\b"
_NUMBER = r"(?:number|no\.?|nr)"
_CODE_24 = r"[:\s#/-]*[A-Z0-9/_-]*\d[A-Z0-9/_-]{2,24}\b"
_CODE_32 = r"[:\s#/-]*[A-Z0-9/_-]*\d[A-Z0-9/_-]{2,32}\b"
_ACCOUNT_LABEL = r"\b(?:rachu(?:n(?:ek|ku|e)?)?|konto|nr\s+konta|numer\s+rachunku)\b"
_BIG = "[A-ZĄĆĘŁŃÓŚŹŻ]"
_ANY = "A-Za-zĄĆĘŁŃÓŚŹŻąćęłńóśźż"
_ANY_BIG_FIRST = "A-ZĄĆĘŁŃÓŚŹŻa-ząćęłńóśźż"
_STREET_END = r"(?=\s+\d|\s*,|\.|\n|$)"
_NAME_LETTER = "[A-ZŁŚŻŹĆŃÓ]"
_NAME_REST = "[a-ząćęłńóśźż]"
_STREETS = ("ul.", "al.", "pl.", "os.", "ulica", "aleja")
_ROLES = (
    "imi", "nazwisk", "klient", "pacjent", "pracowni", "wnioskodawc", "ubezpieczon", "pełnomocnik", "reprezent", "kontakt", "opiekun", "adresat",
    "nadawca", "odbiorca", "podpis", "przekazane", "odebrane", "wystawione", "sporządzone", "prowadząc",
)
_PLACE = "[A-ZŁŚŻŹĆŃÓ][A-Za-zŁŚŻŹĆŃÓąćęłńóśźż.\\-]+"

# The rules of the catalogue.
CATALOGUE: tuple[Rule, ...] = (
    Rule("EMAIL", r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "email", "email", 0.99, False, 10, "e-mail address", needs=("@",)),
    Rule("PHONE", rf"(?:(?<!\d){_PHONE_PREFIX}(?:\d[\s-]*){{8}}\d(?!\d))", "digits", "phone", 0.96, False, 10, "phone number", digits=9),
    Rule("PHONE", rf"\b(?:tel\.?|telefon|numer\s+telefonu)\b{_BROKEN}(?<entity>{_PHONE_PREFIX}(?:\d[\s-]*){{5,8}}\d)\b", "digits", "phone_fragment", 0.9, True, 9, "labelled phone number, perhaps cut", needs=("tel",), digits=6),
    Rule("PESEL", r"\b\d{11}\b", "digits", "pesel", 0.995, False, 10, "PESEL", digits=11),
    Rule("NIP", rf"\b{_NIP}\b", "digits", "nip", 0.99, False, 10, "NIP", digits=10),
    Rule("REGON", r"\b\d{9}(?:\d{5})?\b", "digits", "regon", 0.98, False, 10, "REGON", digits=9),
    Rule("KRS", rf"\b(?:KRS|nr\s*KRS){_LABELLED}(?:\d[\s-]*){{9}}\d\b", "digits", "krs", 0.97, True, 10, "labelled KRS", needs=("krs",), digits=10),
    Rule("REGON", rf"\b(?:REGON|nr\s*REGON){_LABELLED}\d{{9}}(?:\d{{5}})?\b", "digits", "regon", 0.985, True, 9, "labelled REGON", needs=("regon",), digits=9),
    Rule("NIP", rf"\b(?:NIP|Tax\s*ID|Identyfikator\s*podatkowy){_LABELLED}{_NIP}\b", "digits", "nip", 0.992, True, 9, "labelled NIP", needs=("nip", "tax", "identyfikator"), digits=10),
    Rule("IBAN", r"\b[A-Z]{2}\d{2}(?:[\s-]?[A-Z0-9]{4}){3,7}\b", "upper_alnum", "iban", 0.99, False, 10, "IBAN", digits=2),
    Rule("BANK_ACCOUNT", r"(?:(?<![A-Z0-9])(?:PL[\s-]*)?(?:\d[\s-]*){25}\d(?!\d))", "upper_alnum", "bank_account", 0.98, False, 15, "bank account", digits=26),
    Rule("BANK_ACCOUNT", rf"\b(?:rachunek(?:\s+bankowy)?|konto|nr\s+konta|numer\s+rachunku)\b{_LABELLED}(?<entity>(?:PL[\s-]*)?(?:\d[\s-]*){{25}}\d)\b", "upper_alnum", "labeled_bank_account", 0.985, True, 20, "labelled bank account", needs=("rachun", "kont"), digits=26),
    Rule("BANK_ACCOUNT", rf"{_ACCOUNT_LABEL}{_BROKEN}(?<entity>(?:PL[\s-]*)?(?:\d[\s-]*){{25}}\d)\b", "upper_alnum", "labeled_bank_account", 0.985, True, 19, "bank account with a broken label", needs=("rachu", "kont"), digits=26),
    Rule("BANK_ACCOUNT", rf"{_ACCOUNT_LABEL}{_BROKEN}(?<entity>(?:\d[\s-]*){{19,25}}\d)\b", "upper_alnum", "labeled_bank_account_fragment", 0.97, True, 18, "labelled bank account, perhaps cut", needs=("rachu", "kont"), digits=20),
    Rule("VAT_ID", rf"\b(?:VAT(?:\s*ID|\s*UE)?|UE\s*VAT|EU\s*VAT){_LABELLED}(?:[A-Z]{{2}}\s*)?[A-Z0-9-]{{8,16}}\b", "upper_alnum", "vat_id", 0.95, True, 12, "labelled VAT number", needs=("vat",)),
    Rule("TAX_ID", rf"\b(?:TIN|Tax\s*ID|Identyfikator\s*podatkowy){_LABELLED}(?:[A-Z]{{2}}\s*)?[A-Z0-9-]{{6,18}}\b", "upper_alnum", "tax_id", 0.94, True, 12, "labelled tax number", needs=("tin", "tax", "identyfikator")),
    Rule("IP_ADDRESS", r"\b(?<entity>(?:\d{1,3}\.){3}\d{1,3})\b", "identity", "ip_address", 0.97, False, 20, "IPv4 address", digits=4),
    Rule("VEHICLE_REGISTRATION", rf"\b(?:pojazd|nr\s+rej\.?|numer\s+rejestracyjny|tablica(?:\s+rejestracyjna)?)\b{_LABELLED}(?<entity>[A-Z]{{1,3}}\s?[A-Z0-9]{{4,6}})\b", "upper_alnum", "vehicle_registration", 0.93, True, 20, "labelled vehicle registration", needs=("pojazd", "rej", "tablica")),
    Rule("DEVICE_ID", rf"\b(?:identyfikator|device|host|urządzenie)\b{_LABELLED}(?<entity>[A-Za-z][A-Za-z0-9._-]{{2,63}})\b", "identity", "device_identifier", 0.9, True, 25, "labelled device", needs=("identyfikator", "device", "host", "urządzenie")),
    Rule("SWIFT_BIC", r"\b(?:SWIFT|BIC)(?:[:\s/-]+)(?:[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b", "swift_bic", "swift_bic", 0.96, True, 20, "labelled SWIFT or BIC code", needs=("swift", "bic")),
    Rule("CARD", r"\b(?:\d[ -]?){13,19}\b", "digits", "card_number", 0.97, False, 10, "card number", digits=13),
    Rule("POSTAL_CODE", r"\b\d{2}-\d{3}\b", "identity", "postal_code", 0.95, False, 10, "postal code", digits=5),
    Rule("DATE_OF_BIRTH", r"\b(?:ur\.?|data urodzenia[: ]|dob[: ])\s*(?:\d{2}[./-]\d{2}[./-]\d{4}|\d{4}-\d{2}-\d{2})\b", "date_context", "date_of_birth", 0.94, True, 10, "labelled date of birth", needs=("ur", "dob"), digits=8),
    Rule("DATE_OF_BIRTH", r"\b\d{2}[./-]\d{2}[./-]\d{4}\b", "identity", "date_of_birth", 0.88, False, 20, "date that may be one of birth", digits=8),
    Rule("DOCUMENT_NUMBER", rf"\b(?:dow[oó]d(?:\s+osobisty)?|passport|paszport|nr dokumentu){_DOCUMENT}", "upper_alnum", "document_number", 0.92, True, 10, "labelled document number", needs=("dow", "passport", "paszport", "dokumentu"), digits=1),
    Rule("PASSPORT_NUMBER", rf"\b(?:passport|paszport){_DOCUMENT}", "upper_alnum", "document_number", 0.93, True, 12, "labelled passport", needs=("passport", "paszport"), digits=1),
    Rule("ID_CARD_NUMBER", rf"\b(?:dow[oó]d(?:\s+osobisty)?|id card|nr dowodu){_DOCUMENT}", "upper_alnum", "document_number", 0.93, True, 12, "labelled identity card", needs=("dow", "id card"), digits=1),
    Rule("DRIVER_LICENSE_NUMBER", rf"\b(?:prawo jazdy|driver'?s license){_DOCUMENT}", "upper_alnum", "document_number", 0.92, True, 12, "labelled driving licence", needs=("prawo jazdy", "license"), digits=1),
    Rule("CASE_NUMBER", r"\b(?:sygn\.?\s*akt|case\s*no\.?|sprawa)[:\s]*[A-Z]{1,6}\s*[A-Z]?\s*\d+/\d{2,4}\b", "case_identifier", "case_number", 0.94, True, 10, "court case", needs=("sygn", "case", "sprawa"), digits=3),
    Rule("CONTRACT_NUMBER", rf"\b(?:umowa\s*nr|contract\s*{_NUMBER}|agreement\s*{_NUMBER}){_CODE_24}", "case_identifier", "contract_number", 0.92, True, 10, "contract", needs=("umowa", "contract", "agreement"), digits=1),
    Rule("INVOICE_NUMBER", rf"\b(?:faktura\s*nr|invoice\s*{_NUMBER}|fv){_CODE_32}", "case_identifier", "generic_reference", 0.93, True, 10, "invoice", needs=("faktura", "invoice", "fv"), digits=1),
    Rule("ORDER_NUMBER", rf"\b(?:zam[oó]wienie\s*nr|order\s*{_NUMBER}){_CODE_32}", "case_identifier", "generic_reference", 0.92, True, 10, "order", needs=("zam", "order"), digits=1),
    Rule("POLICY_NUMBER", rf"\b(?:polisa\s*nr|policy\s*{_NUMBER}){_CODE_32}", "case_identifier", "generic_reference", 0.92, True, 10, "insurance policy", needs=("polisa", "policy"), digits=1),
    Rule("CLAIM_NUMBER", rf"\b(?:szkoda\s*nr|claim\s*{_NUMBER}){_CODE_32}", "case_identifier", "generic_reference", 0.91, True, 10, "insurance claim", needs=("szkoda", "claim"), digits=1),
    Rule("CLIENT_ID", rf"\b(?:client|klient)[:\s#/-]+(?:id|nr){_CODE_24}", "case_identifier", "generic_reference", 0.9, True, 15, "client", needs=("client", "klient"), digits=1),
    Rule("EMPLOYEE_ID", rf"\b(?:employee|pracownik)[:\s#/-]+(?:id|nr){_CODE_24}", "case_identifier", "generic_reference", 0.9, True, 15, "employee", needs=("employee", "pracownik"), digits=1),
    Rule("ADDRESS", rf"\b(?:ul\.|al\.|pl\.|os\.|ulica|aleja)\s+[A-ZĄĆĘŁŃÓŚŹŻ0-9][A-ZĄĆĘŁŃÓŚŹŻ0-9 .-]{{1,40}}\s+\d+[A-Z]?(?:/\d+[A-Z]?)?(?:,\s*\d{{2}}-\d{{3}}\s+[{_ANY_BIG_FIRST} -]+)?\b", "identity", "address", 0.93, True, 10, "street and house number", needs=_STREETS, digits=1),
    Rule("ADDRESS", rf"\b\d{{2}}-\d{{3}}\s+[{_ANY_BIG_FIRST} -]+(?:,\s*(?:ul\.|al\.|pl\.|os\.)\s+[{_ANY_BIG_FIRST}0-9 .-]+\s+\d+[A-Z]?(?:/\d+[A-Z]?)?)?\b", "identity", "address", 0.9, True, 20, "postal code and city", digits=5),
    Rule("CITY", rf"\b(?:korespondencj[ęe]\s+z|przekazania\s+kluczy\s+w|kluczy\s+w|miejscowość|miasto|lokal\s+w|lokalu\s+w)\s+(?<entity>{_BIG}[{_ANY}.-]{{2,40}})\b", "identity", "always_true", 0.9, True, 25, "city in a telling context", needs=("korespondencj", "kluczy", "miejscowość", "miasto", "lokal")),
    Rule("STREET", rf"\b(?:ul\.|ulica|al\.|aleja|pl\.|os\.)\s+(?<entity>{_BIG}[{_ANY}0-9 .-]{{2,60}}){_STREET_END}", "identity", "always_true", 0.88, True, 30, "street after its marker", needs=_STREETS),
    Rule("STREET", rf"\b(?:lokalu\s+przy|adres\s+przy|kluczy\s+w\s+{_BIG}[{_ANY}.-]{{2,40}}\s+przy|przy)\s+(?<entity>{_BIG}[{_ANY}.-]{{2,40}}){_STREET_END}", "identity", "always_true", 0.87, True, 31, "street in a place's context", needs=("przy",)),
)


def heuristics(names: Iterable[str] | None = None) -> tuple[Rule, ...]:
    """Rules for persons, organisations, cities and labelled identifiers; ``names`` are the known forms of given names."""
    token = rf"(?-i:{_NAME_LETTER}{_NAME_REST}+(?:-{_NAME_LETTER}{_NAME_REST}+)?)"
    initial = rf"(?-i:{_NAME_LETTER}\.)"
    known = tuple(names or given_name_forms())
    # a look at the first letter spares most words the whole list
    given = f"(?-i:(?=[{''.join(sorted({n[0] for n in known}))}])(?:" + "|".join(known) + "))"
    either = f"(?:{given}|{initial})"
    given_first = rf"{given}(?:\s+{either}){{0,2}}\s+{token}"
    full = rf"(?:{given_first}|{token}\s+{either}(?:\s+{either}){{0,2}}|{initial}\s+{token})"
    reference = f"(?:{full}|{token})"
    # Roles that a person's name follows, and titles.
    role = (
        r"(?:imi[eę](?:\s+i\s+nazwisko)?|nazwisko\s+i\s+imi[eę]|nazwisko|klient(?:ka)?|pacjent(?:ka)?|pracownik|pracownica|wnioskodawca|"
        r"wnioskodawczyni|ubezpieczon[ya]|pełnomocnik(?:a)?|reprezentant(?:ka)?|reprezentowan[ay]\s+przez|osoba\s+kontaktowa|kontakt(?:\s+do)?|"
        r"opiekun(?:ka)?|adresat(?:ka)?|nadawca|odbiorca|podpisane\s+przez|podpisał[ao]?|przekazane\s+przez|odebrane\s+przez|wystawione\s+przez|"
        r"sporządzone\s+przez|prowadząc[ay])"
    )
    title = r"(?:(?:pan|pani|pana|panią|panem|dr\.?|mgr\.?|mec\.?|adw\.?|radca\s+prawny)\s+)?"
    person = ("identity", "person_full_name")
    open_ = ("identity", "always_true")
    return (
        Rule("PERSON", rf"\b{role}\b\s*[:,-]?\s*{title}(?<entity>{reference})\b", *person, 0.93, True, description="person after a role", needs=_ROLES),
        Rule("PERSON", rf"\b(?:z\s+)?(?:panem|panią|pan|pani|pana)\s+(?<entity>{reference})\b", *person, 0.9, True, description="person after a title", needs=("pan",)),
        Rule("PERSON", rf"\b{given_first}\b", *person, 0.88, description="known given name and surname"),
        Rule("PERSON", rf"\b(?<entity>{full})\b(?=,\s+dalej\s+jako\s+(?!sekcja\b)[^,.]{{3,80}})", *person, 0.91, True, description="party of a contract", needs=("dalej",)),
        Rule("PERSON", rf"(?m)^(?<entity>{full})$(?=\n{token}\n(?:ul\.|al\.|pl\.|os\.|ulica|aleja)\s)", *person, 0.92, True, description="addressee", needs=_STREETS),
        Rule("PERSON", rf"\b{initial}\s+{token}\b", *person, 0.87, description="initial and surname", needs=(".",)),
        Rule("ORG", rf"\b{_NAME_LETTER}[\w&.\-]+(?:\s+{_NAME_LETTER}[\w&.\-]+){{0,6}}\s+(?:S\.A\.|Spółka\s+Akcyjna|sp\.\s*z\s*o\.o\.)", *open_, 0.92, True, description="company by its form", needs=("s.a.", "akcyjna", "o.o.")),
        Rule("ORG", rf"[„\"“](?<entity>(?-i:{_NAME_LETTER}{_NAME_REST}+{_NAME_LETTER}[A-Za-ząćęłńóśźż0-9]*))[”\"“]", *open_, 0.85, description="quoted brand", needs=("„", '"', "“")),
        Rule("CITY", rf"\b(?:registered\s+office\s+in|z\s+siedzibą\s+we?|z\s+siedzibą\s+w)\s+(?:{_PLACE})", *open_, 0.9, True, description="seat of a company", needs=("registered", "siedzib")),
        Rule("CITY", rf"\b(?:{_PLACE})\s+\(\d{{2}}-\d{{3}}\)\s+at\s+\d+\s+{_PLACE}\s+Street\b", *open_, 0.9, True, description="city with an English address", needs=("street",), digits=6),
        Rule("PESEL", r"\bPESEL[:\s-]*\d{11}\b", *open_, 0.99, True, description="labelled PESEL, whatever its check digit", needs=("pesel",), digits=11),
        Rule("NIP", rf"\bNIP[:\s-]*{_NIP}\b", *open_, 0.99, True, description="labelled NIP, whatever its check digit", needs=("nip",), digits=10),
        Rule("REGON", r"\bREGON[:\s-]*\d{9}(?:\d{5})?\b", *open_, 0.985, True, description="labelled REGON, whatever its check digit", needs=("regon",), digits=9),
        Rule("ID_CARD_NUMBER", r"\bseria[:\s-]*(?<entity>(?-i:[A-Z]{3})\s*(?:nr\.?|numer)?\s*\d{6})\b", *open_, 0.93, True, description="identity card by series and number", needs=("seria",), digits=6),
    )


def ordered(types: Iterable[str] | None = None, catalogue: Iterable[Rule] = CATALOGUE, names: Iterable[str] | None = None) -> list[Rule]:
    """Rules in the order in which they apply, of the given entity types only."""
    rules = [*sorted(catalogue, key=lambda r: r.priority), *heuristics(names)]
    kept = None if types is None else set(types)
    return [r for r in rules if kept is None or r.entity_type in kept]

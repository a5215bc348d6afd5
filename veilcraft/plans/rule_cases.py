"""Texts that show each rule at work: hits and near misses by hand, made from the keys of orders by SQL that both engines read.

A case is (what stands before the span, the span, what stands after it, whether it is found). Braces name columns of NUMBERS or CHECKED. Cases
are dealt out by the order's key.
"""

from __future__ import annotations

import re

_STRING = "CAST({} AS VARCHAR(20))"


def _padded(expr: str, n: int) -> str:
    return f"lpad({_STRING.format(expr)}, {n}, '0')"


NUMBERS = {
    "k": _STRING.format("o_orderkey"), "c1": _STRING.format("o_orderkey % 10"), "d3": _padded("o_orderkey % 1000", 3), "d4": _STRING.format("o_orderkey % 9000 + 1000"),
    "d6": _STRING.format("o_orderkey % 900000 + 100000"), "o1": _STRING.format("o_orderkey % 256"), "dd": _padded("o_orderkey % 28 + 1", 2), "mm": _padded("o_orderkey % 12 + 1", 2),
    "yy": _padded("o_orderkey % 100", 2), "nl": "chr(10)",
    "pesel_base": f"CONCAT({_padded('o_orderkey % 100', 2)}, {_padded('o_orderkey % 12 + 1', 2)}, {_padded('o_orderkey % 28 + 1', 2)}, {_padded('o_orderkey % 9999', 4)})",
    "nip_base": _STRING.format("521000000 + o_orderkey * 37"), "regon_base": _STRING.format("12300000 + o_orderkey * 41"),
    "regon14_base": _STRING.format("1234500000000 + o_orderkey * 7919"), "card_base": _STRING.format("411111110000000 + o_orderkey * 7919"),
    "account_base": f"CONCAT('109010140000', {_padded('o_orderkey * 31', 12)})",
}


def _weighted(base: str, weights: tuple[int, ...]) -> str:
    return " + ".join(f"{w} * CAST(substr({base}, {i}, 1) AS INT)" for i, w in enumerate(weights, 1))


def _luhn(base: str) -> str:
    """Of 15 digits that a check digit follows: every second one from the first on counts double, and its digits are summed."""
    twice = lambda i: f"2 * CAST(substr({base}, {i}, 1) AS INT)"
    return " + ".join(f"(CASE WHEN {twice(i)} > 9 THEN {twice(i)} - 9 ELSE {twice(i)} END)" if i % 2 else f"CAST(substr({base}, {i}, 1) AS INT)" for i in range(1, 16))


#: Check digits of the bases.
CHECKS = {
    "pesel": f"(10 - ({_weighted('pesel_base', (1, 3, 7, 9, 1, 3, 7, 9, 1, 3))}) % 10) % 10", "nip": f"({_weighted('nip_base', (6, 5, 7, 2, 3, 4, 5, 6, 7))}) % 11",
    "regon": f"({_weighted('regon_base', (8, 9, 2, 3, 4, 5, 6, 7))}) % 11 % 10", "regon14": f"({_weighted('regon14_base', (2, 4, 8, 5, 0, 9, 7, 3, 6, 1, 2, 4, 8))}) % 11 % 10",
    "card": f"(10 - ({_luhn('card_base')}) % 10) % 10", "account": "98 - CAST(CAST(CONCAT(account_base, '252100') AS DECIMAL(38, 0)) % 97 AS INT)",
}
#: Numbers with right check digits, and with wrong ones (_x).
CHECKED = {
    **{n: f"CONCAT({n}_base, {_STRING.format(f'{n}_check % 10')})" for n in ("pesel", "nip", "regon", "regon14", "card")},
    **{f"{n}_x": f"CONCAT({n}_base, {_STRING.format(f'({n}_check + 1) % 10')})" for n in ("pesel", "nip", "regon", "card")},
    "nip_parts": f"CONCAT(substr(nip_base, 1, 3), '-', substr(nip_base, 4, 3), '-', substr(nip_base, 7, 2), '-', substr(nip_base, 9, 1), {_STRING.format('nip_check % 10')})",
    "account": f"CONCAT({_padded('account_check', 2)}, account_base)", "account_x": f"CONCAT({_padded('(account_check + 1) % 97', 2)}, account_base)",
    "iban_parts": f"CONCAT('PL', {_padded('account_check', 2)}, ' ', " + ", ' ', ".join(f"substr(account_base, {i}, 4)" for i in range(1, 25, 4)) + ")",
}
#: A check digit of ten makes no number.
NIP_OK = "nip_check <> 10"

CASES: dict[str, list[tuple[str, str, str, str]]] = {
    "d01_email": [("pisz: ", "jan.k{k}@poczta-{d3}.com.pl", "!", "true"), ("<", "A+{k}@X.PL", ">", "true"), ("adres ", "jan{k}@poczta", " koniec", "false"), ("", "@{k}.pl", "", "false")],
    "d02_phone": [
        ("zadzwoń ", "600 {d3} {d3}", ".", "true"), ("nr ", "+48 600-{d3}-{d3}", ", dziś", "true"), ("nr ", "12345{d3}", "", "false"), ("REGON ", "600{d6}", "", "false"),
        ("x ", "60{d4}{d4}", " y", "false"),
    ],
    "d03_phone_labelled": [("tel. ", "600{d3}", " x", "true"), ("Telefon: ", "+48 600 {d3} 12", "", "true"), ("tel. ", "12{d3}", "", "false"), ("telefax ", "600{d6}", "", "false")],
    "d04_pesel": [("", "{pesel}", "", "true"), ("nr ", "{pesel}", ".", "true"), ("", "{pesel_x}", "", "false"), ("a", "{pesel}", "", "false")],
    "d05_nip": [("NR ", "{nip}", "", NIP_OK), ("x ", "{nip_parts}", ".", NIP_OK), ("", "{nip_x}", "", "false"), ("a ", "{nip}1", " b", "false")],
    "d06_regon": [("", "{regon}", " koniec", "true"), ("kod ", "{regon14}", "", "true"), ("", "{regon_x}", "", "false"), ("a", "{regon}", "", "false")],
    "d07_krs": [("wpis ", "KRS: {d4}{d6}", "", "true"), ("", "nr KRS 00{d4}{d4}", ";", "true"), ("", "KRS {d6}", "", "false"), ("", "KRZ {d4}{d6}", "", "false")],
    "d08_regon_labelled": [("", "REGON {regon}", "", "true"), ("", "nr REGON: {regon14}", ".", "true"), ("", "REGON {regon_x}", "", "false"), ("", "REGOM {regon}", "", "false")],
    "d09_nip_labelled": [("", "NIP: {nip_parts}", "", NIP_OK), ("", "Tax ID {nip}", ".", NIP_OK), ("", "NIP {nip_x}", "", "false"), ("", "NUP {nip}", "", "false")],
    "d10_iban": [("konto ", "PL{account}", ".", "true"), ("", "{iban_parts}", ";", "true"), ("", "PL{account_x}", "", "false"), ("", "PL{d6}", "", "false")],
    "d11_bank_account": [("na ", "{account}", ".", "true"), ("na ", "PL {account}", "", "true"), ("", "{account_x}", "", "false"), ("", "{account}7", "", "false")],
    "d12_bank_account_labelled": [("rachunek bankowy: ", "{account}", "", "true"), ("konto ", "PL{account_x}", ".", "true"), ("konto ", "{card}", "", "false"), ("kont ", "{account}", "", "false")],
    "d13_bank_account_broken": [("rachun; ", "{account}", "", "true"), ("numer rachunku., ", "{account_x}", " x", "true"), ("rachunki ", "{account}", "", "false"), ("konto ", "{regon}", "", "false")],
    "d14_bank_account_fragment": [("konto: ", "{card}{d4}", "", "true"), ("rachunku ", "{account}", ".", "true"), ("konto ", "{card}", "", "false"), ("konto ", "11111111111111111111", "", "false")],
    "d15_vat_id": [("", "VAT ID: PL{nip}", "", NIP_OK), ("", "VAT DE{regon}", ".", "true"), ("", "VAT ID: PL{nip_x}", "", "false"), ("", "VAT {d4}", "", "false")],
    "d16_tax_id": [("", "TIN: DE{regon}", "", "true"), ("", "Tax ID {nip}", ".", "true"), ("", "TIN PL{nip_x}", "", "false"), ("", "TIN abc", "", "false")],
    "d17_ip_address": [("ip ", "10.{o1}.0.7", " ok", "true"), ("(", "{o1}.1.2.{o1}", ")", "true"), ("", "10.{d3}.999.1", "", "false"), ("", "1.2.{o1}", "", "false")],
    "d18_vehicle_registration": [("pojazd ", "WX {d4}A", ".", "true"), ("nr rej ", "kr{d4}x", "", "true"), ("pojazd ", "ABCDEF", "", "false"), ("pojazdy ", "WX {d4}A", "", "false")],
    "d19_device_id": [("host: ", "srv-{k}.lan", " ok", "true"), ("urządzenie ", "X{d4}", "", "true"), ("host ", "{k}ab", "", "false"), ("hosts ", "srv{k}", "", "false")],
    "d20_swift_bic": [("", "SWIFT: BPKOPLP{c1}", ".", "true"), ("{k} ", "BIC BPKOPLPWXXX", "", "true"), ("", "SWIFT BPKO{d4}", "", "false"), ("{k} ", "SWIT BPKOPLPW", "", "false")],
    "d21_card": [("karta ", "{card}", ".", "true"), ("nr: ", "{card}", "", "true"), ("", "{card_x}", "", "false"), ("12-- ", "{card}", ".", "false")],
    "d22_postal_code": [("kod ", "{dd}-{d3}", " Łódź", "true"), ("", "{mm}-{d3}", "", "true"), ("", "{dd}-{k}1234", "", "false"), ("", "x{dd}-{d3}", "", "false")],
    "d23_date_of_birth_labelled": [
        ("", "ur. {dd}.{mm}.19{yy}", "", "true"), ("", "data urodzenia: 20{yy}-{mm}-{dd}", ".", "true"), ("", "ur. 31.02.19{yy}", "", "false"), ("", "urz. {dd}.{mm}.19{yy}", "", "false"),
    ],
    "d24_date_of_birth": [("dnia ", "{dd}/{mm}/19{yy}", ".", "true"), ("", "{dd}-{mm}-20{yy}", "", "true"), ("", "{dd}.13.19{yy}", "", "false"), ("", "{dd}.{mm}-19{yy}", "", "false")],
    "d25_document_number": [("", "dowód osobisty nr ABC{d6}", "", "true"), ("", "nr dokumentu: AB{d6}", ".", "true"), ("", "paszport AB{d6}", "", "false"), ("{k} ", "dowód ABC", "", "false")],
    "d26_passport_number": [("", "paszport AB{d6}", "", "true"), ("", "Passport: nr {d6}{d3}", ".", "true"), ("{k} ", "paszport AB", "", "false"), ("", "pasport AB{d6}", "", "false")],
    "d27_id_card_number": [("", "id card {d6}{d4}", "", "true"), ("", "dowód nr ABC{d6}", ".", "true"), ("", "dowody ABC{d6}", "", "false"), ("", "id kart {d6}{d4}", "", "false")],
    "d28_driver_license_number": [("", "prawo jazdy nr {d6}A", "", "true"), ("", "drivers license: X{d6}", ".", "true"), ("{k} ", "prawo jazdy B", "", "false"), ("", "prawo jazda {d6}A", "", "false")],
    "d29_case_number": [("", "sygn. akt II C {k}/24", "", "true"), ("", "case no. KM {k}/2023", ".", "true"), ("", "sprawa I C {k}-24", "", "false"), ("", "spraw I C {k}/24", "", "false")],
    "d30_contract_number": [("", "umowa nr U/{d4}/24", "", "true"), ("", "contract no {d6}", ".", "true"), ("", "contract no. {d6}", "", "false"), ("{k} ", "umowa nr A", "", "false")],
    "d31_invoice_number": [("", "faktura nr FV/{k}00/24", "", "true"), ("", "invoice no {d4}", ".", "true"), ("{k} ", "faktura nr AB", "", "false"), ("", "faktury nr {d6}", "", "false")],
    "d32_order_number": [("", "zamówienie nr {d6}", "", "true"), ("", "order number A-{d4}", ".", "true"), ("", "zamówienie {d6}", "", "false"), ("{k} ", "order no X", "", "false")],
    "d33_policy_number": [("", "polisa nr {d6}", "", "true"), ("", "policy no {d4}X", ".", "true"), ("", "polisy nr {d6}", "", "false"), ("{k} ", "policy no AB", "", "false")],
    "d34_claim_number": [("", "szkoda nr {d6}", "", "true"), ("", "claim nr C{d4}", ".", "true"), ("", "szkody nr {d6}", "", "false"), ("{k} ", "claim no AB", "", "false")],
    "d35_client_id": [("", "klient nr {d4}", "", "true"), ("", "Client-ID: C{d6}", ".", "true"), ("", "klient {d4}", "", "false"), ("", "klienci nr {d4}", "", "false")],
    "d36_employee_id": [("", "pracownik id {d4}", "", "true"), ("", "Employee: nr E-{d4}", ".", "true"), ("", "pracownik {d4}", "", "false"), ("", "pracownica nr {d4}", "", "false")],
    "d37_address": [("mieszka ", "ul. Długa {k}/7", ", dziś", "true"), ("", "aleja Jana Pawła {d3}A, 00-{d3} Warszawa", ".", "true"), ("{k} ", "ul. Długa bez numeru", "", "false"), ("", "ula. Długa {k}", "", "false")],
    "d38_address_postal": [("", "00-{d3} Stary Sącz", ".", "true"), ("adres: ", "31-{d3} Kraków, ul. Długa {k}", "", "true"), ("", "00-{d3}, Kraków", "", "false"), ("", "0-{d3} Kraków", "", "false")],
    "d39_city": [("{k} miasto ", "Kraków", " leży", "true"), ("{k} lokal w ", "Nowym-Targu", "; x", "true"), ("{k} miastko ", "Kraków", "", "false"), ("{k} miasto ", "{d4}", "", "false")],
    "d40_street": [("{k} ul. ", "Długa", ", koło", "true"), ("{k} ulica ", "Nowy Świat 7x", "", "true"), ("{k} ul. ", "Długa", "; nic", "false"), ("{k} u. ", "Długa", ", koło", "false")],
    "d41_street_przy": [("{k} lokalu przy ", "Długiej", " {d3}", "true"), ("{k} adres przy ", "Rynku", ", obok", "true"), ("{k} przy ", "Rynku", " obok", "false"), ("{k} przya ", "Rynku", ", x", "false")],
    "h01_person_role": [
        ("{k} Klient: ", "Jan Kowalski", ", dalej", "true"), ("{k} odebrane przez panią ", "Annę Nowak", ".", "true"), ("{k} Klient: ", "jan kowalski", "", "false"), ("{k} Klient: ", "Umowa Jan", "", "false"),
    ],
    "h02_person_honorific": [("{k} z panem ", "Piotrem Lewandowskim", ".", "true"), ("{k} pani ", "Nowak", ", x", "true"), ("{k} pan ", "Xyz", "", "false"), ("{k} panna ", "Anna Nowak", "", "false")],
    "h03_person_given_name": [("{k} oraz ", "Anna Maria Nowak", ".", "true"), ("{k} był ", "Janem Lis", ", x", "true"), ("{k} oraz ", "Anna", " i", "false"), ("{k} oraz ", "Xyz Nowak", "", "false")],
    "h04_person_party": [
        ("{k} a ", "Jan Kowalski", ", dalej jako najemca", "true"), ("{k} a ", "A. Nowak", ", dalej jako strona umowy", "true"), ("{k} a ", "Jan Kowalski", ", dalej jako sekcja A", "false"),
        ("{k} a ", "Jan Kowalski", ", dalej najemca", "false"),
    ],
    "h05_person_addressee": [
        ("{k}{nl}", "Jan Kowalski", "{nl}Kraków{nl}ul. Długa 5", "true"), ("{k}{nl}", "Anna Lis", "{nl}Warszawa{nl}aleja Róż 1", "true"), ("{k}{nl}", "Jan Kowalski", "{nl}Kraków{nl}Długa 5", "false"),
        ("{k} ", "Jan Kowalski", "{nl}Kraków{nl}ul. Długa 5", "false"),
    ],
    "h06_person_initial": [("{k} i ", "J. Kowalski", ".", "true"), ("{k} i ", "A. Nowak-Lis", ", x", "true"), ("{k} i ", "J. Xyz", "", "false"), ("{k} i ", "j. Kowalski", "", "false")],
    "h07_org_form": [("{k}, ", "Firma Test S.A.", " w", "true"), ("{k}: ", "Alfa-{k} sp. z o.o.", ", x", "true"), ("{k}, ", "Firma Test SA", "", "false"), ("{k}, ", "S.A.", " x", "false")],
    "h08_org_quoted": [("{k} firma „", "TechNova{d3}", "” i", "true"), ("{k} „", "BioLab", "“", "true"), ("{k} „", "Technova", "”", "false"), ("{k} (", "TechNova", ")", "false")],
    "h09_city_seat": [("{k} ", "z siedzibą w Krakowie", " przy", "true"), ("{k} ", "registered office in Gdynia", ", x", "true"), ("{k} ", "z siedziba w Krakowie", "", "false"), ("{k} ", "z siedzibą przy Krakowie", "", "false")],
    "h10_city_english": [
        ("in ", "Warszawa (00-{d3}) at {k} Marszałkowska Street", ".", "true"), ("in ", "Gdynia (81-{d3}) at 7 Morska Street", "", "true"), ("in ", "Warszawa (00-{d3}) at Marszałkowska Street", "", "false"),
        ("in ", "Warszawa 00-{d3} at {k} Morska Street", "", "false"),
    ],
    "h11_pesel_labelled": [("", "PESEL {pesel_x}", "", "true"), ("", "PESEL: {pesel}", ".", "true"), ("", "PESEL {nip}", "", "false"), ("", "PESSEL {pesel}", "", "false")],
    "h12_nip_labelled": [("", "NIP-{nip_parts}", "", "true"), ("", "NIP: {nip_x}", ".", "true"), ("", "NIP {regon}", "", "false"), ("", "NUP {nip}", "", "false")],
    "h13_regon_labelled": [("", "REGON: {regon_x}", "", "true"), ("", "REGON {regon14}", ".", "true"), ("", "REGON {nip}", "", "false"), ("", "REGION {regon}", "", "false")],
    "h14_id_card_series": [("seria ", "ABC {d6}", ".", "true"), ("seria: ", "XYZ nr {d6}", "", "true"), ("seria ", "abc {d6}", "", "false"), ("seria ", "AB {d6}", "", "false")],
}


def text_sql(template: str) -> str:
    """A template as an SQL expression."""
    parts = [p if i % 2 else f"'{p}'" for i, p in enumerate(re.split(r"\{(\w+)\}", template)) if p]
    return f"CONCAT({', '.join(parts)})" if parts else "''"


def by_case(values: list[str]) -> str:
    """The SQL expression of the order's case."""
    return f"CASE o_orderkey % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def levels() -> list[list[str]]:
    """Select lists that follow one another: numbers, check digits, numbers with check digits."""
    named = lambda table, ending="": [f"{v} AS {k}{ending}" for k, v in table.items()]
    return [["o_orderkey", *named(NUMBERS)], ["*", *named(CHECKS, "_check")], ["*", *named(CHECKED)]]


def numbers_sql() -> str:
    sql = "orders"
    for columns in levels():
        sql = f"(SELECT {', '.join(columns)} FROM {sql})"
    return sql


def columns(cases: list[tuple[str, str, str, str]]) -> dict[str, str]:
    """before, span and after as SQL expressions, and whether the span is found."""
    each = lambda i: by_case([text_sql(c[i]) for c in cases])
    return {"before": each(0), "span": each(1), "after": each(2), "found": by_case([c[3] for c in cases])}

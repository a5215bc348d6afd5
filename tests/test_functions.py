import pytest
from pyspark.sql import functions as F

from veilcraft.functions.gazetteer import given_name_forms
from veilcraft.functions.normalize import NORMALIZERS
from veilcraft.functions.rules import CATALOGUE, heuristics, ordered
from veilcraft.functions.validate import VALIDATORS

TRUE = [
    ("pesel", "44051401359"), ("nip", "856-734-62-15"), ("regon", "123456785"), ("regon", "12345678512347"), ("krs", "KRS 0000123456"),
    ("iban", "PL61 1090 1014 0000 0712 1981 2874"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("bank_account", "61109010140000071219812874"),
    ("labeled_bank_account", "11109010140000071219812874"), ("labeled_bank_account_fragment", "10901014000007121981"), ("phone", "+48 600 700 800"),
    ("phone", "0048600700800"), ("phone_fragment", "600 700"), ("card_number", "4111 1111 1111 1111"), ("ip_address", "192.168.1.255"), ("ip_address", "010.0.0.1"),
    ("vehicle_registration", "wx 12345"), ("device_identifier", "srv-01.local"), ("postal_code", "00-123"), ("date_of_birth", "ur. 29.02.2000"),
    ("date_of_birth", "1999-12-31"), ("document_number", "dowód ABC123456"), ("case_number", "sygn. akt II K 12/24"), ("contract_number", "umowa nr UMOWA-2024-12"),
    ("swift_bic", "BIC: BPKOPLPWXXX"), ("generic_reference", "fv/12"), ("vat_id", "VAT: PL8567346215"), ("vat_id", "VAT: DE123456789"), ("tax_id", "TIN: 1234567890"),
    ("email", "a.b@example.com"), ("address", "ul. Długa 5/7"), ("address", "00-123 Łódź"), ("person_full_name", "Jan Kowalski"), ("person_full_name", "J. Malewicz"),
    ("person_full_name", "pan Jan Nowak-Kowalski"), ("person_full_name", "Nowak"), ("always_true", ""),
]
FALSE = [
    ("pesel", "44051401358"), ("pesel", "11111111111"), ("pesel", "44131401357"), ("nip", "856-734-62-16"), ("nip", "12"), ("regon", "123456780"), ("iban", "PL61109010140000071219812875"), ("iban", "PL61"),
    ("labeled_bank_account", "1" * 26), ("phone", "12345"), ("phone_fragment", "12345"), ("card_number", "4111 1111 1111 1112"), ("ip_address", "256.1.1.1"), ("ip_address", "1.1.1"),
    ("vehicle_registration", "ABCDEFG"), ("device_identifier", "-x1"), ("postal_code", "00-1234"), ("date_of_birth", "31.02.2000"), ("date_of_birth", "12.05.80"),
    ("document_number", "dowód"), ("contract_number", "contract no. 123"), ("swift_bic", "BPKO"), ("vat_id", "VAT: PL8567346216"), ("email", "a b@example.com"),
    ("email", "a@b.com\n"), ("address", "Długa"), ("person_full_name", "Umowa Nowak"), ("person_full_name", "jan kowalski"), ("person_full_name", "Dom Stół"), ("person_full_name", ""),
]


def test_validators(spark):
    rows = [(n, v, True) for n, v in TRUE] + [(n, v, False) for n, v in FALSE]
    df = spark.createDataFrame(rows, "name string, value string, want boolean")
    for name, check in VALIDATORS.items():
        bad = df.filter(F.col("name") == name).filter(~check(F.col("value")).eqNullSafe(F.col("want"))).collect()
        assert not bad, bad
    assert {n for n, *_ in rows} == set(VALIDATORS)


@pytest.mark.parametrize(
    ("name", "value", "want"),
    [
        ("digits", "a1 2-3ż", "123"), ("email", " A@B.C\n", "a@b.c"), ("upper_alnum", "pl 1ż-2", "PL12"), ("date_context", " ur. 1.2.1990", "1.2.1990"),
        ("case_identifier", " a/1 ", "A/1"), ("swift_bic", "swift: bpkoplpw", "BPKOPLPW"), ("swift_bic", "none", ""), ("identity", " x", " x"),
    ],
)
def test_normalizers(spark, name, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(NORMALIZERS[name](F.col("v"))).first()[0] == want


def test_rules():
    assert (len(CATALOGUE), len(heuristics()), len(ordered())) == (41, 14, 55)
    assert {r.entity_type for r in ordered({"NIP", "PERSON"})} == {"NIP", "PERSON"}
    assert [r.priority for r in ordered()[:41]] == sorted(r.priority for r in CATALOGUE)
    assert {"Anną", "Pawłem", "Jana", "Urszuli"} <= set(given_name_forms())


def test_check_digits_take_the_digits_once(spark):
    for name in ("pesel", "nip", "regon"):
        assert VALIDATORS[name](F.col("x"))._jc.toString().count("regexp_replace") == 1

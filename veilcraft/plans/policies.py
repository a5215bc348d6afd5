"""Named policies: which types they are about, how replacements look, and how sure spans must be."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

# Groups of entity types.
GROUPS = {
    "core_identity": ("PERSON", "ORG", "EMAIL", "PHONE", "PESEL", "NIP"),
    "financial_identifiers": ("IBAN", "BANK_ACCOUNT", "SWIFT_BIC", "CARD", "REGON", "KRS", "VAT_ID", "TAX_ID"),
    "addressing": ("ADDRESS", "POSTAL_CODE", "CITY", "STREET", "HOUSE_NUMBER", "APARTMENT_NUMBER", "COUNTRY", "PLACE_OF_BIRTH"),
    "document_identity": ("DOCUMENT_NUMBER", "PASSPORT_NUMBER", "ID_CARD_NUMBER", "DRIVER_LICENSE_NUMBER", "DATE_OF_BIRTH"),
    "case_and_contract_refs": ("CASE_NUMBER", "CONTRACT_NUMBER", "INVOICE_NUMBER", "ORDER_NUMBER", "POLICY_NUMBER", "CLAIM_NUMBER"),
    "workforce_refs": ("CLIENT_ID", "EMPLOYEE_ID"),
    "technical_identifiers": ("IP_ADDRESS", "VEHICLE_REGISTRATION", "DEVICE_ID"),
}


class Policy(NamedTuple):
    name: str
    groups: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    style: str = "category_placeholder"
    accept: float = 0.85
    review: float = 0.6

    def entity_types(self) -> tuple[str, ...]:
        """Types of the policy's groups and its own, each once."""
        return expand_groups(self.groups, self.types)


def expand_groups(groups: Iterable[str], types: Iterable[str] = ()) -> tuple[str, ...]:
    return tuple(dict.fromkeys([*(t for g in groups for t in GROUPS[g]), *types]))


# The named policies.
POLICIES = {
    p.name: p
    for p in (
        Policy("external_irreversible", tuple(GROUPS)),
        Policy("legal_review", ("core_identity",), ("CASE_NUMBER", "CONTRACT_NUMBER"), "format_preserving", 0.8, 0.55),
        Policy("hr_documents", ("core_identity", "addressing", "document_identity"), ("EMPLOYEE_ID",)),
        Policy("finance_documents", ("core_identity", "financial_identifiers", "case_and_contract_refs"), ("CLIENT_ID",), "mask"),
        Policy("custom"),
    )
}

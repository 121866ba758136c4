"""Entities found by pattern in free text, as SQL expressions."""

from __future__ import annotations

from . import fixed
from .sql import lit

KINDS = ["people", "organizations", "locations", "dates", "amounts", "emails", "phone_numbers", "urls"]
KINDS_SHORT = ["people", "organizations", "dates", "amounts", "emails", "phone_numbers"]


def find_all(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {lit(pattern)}, 0)"


def emails(text: str) -> str:
    return find_all(text, fixed.EMAIL_IN_TEXT)


def amounts(text: str) -> str:
    return find_all(text, fixed.AMOUNT_IN_TEXT)


def dates(text: str) -> str:
    return find_all(text, fixed.DATE_IN_TEXT)


def extract_entities(text: str, kinds: list[str] = KINDS) -> str:
    """Map of kind to found strings; kinds no pattern covers stay empty."""
    found = {"emails": emails, "amounts": amounts, "dates": dates}
    nothing = "cast(array() AS array<string>)"
    entries = [f"'{kind}', {found[kind](text) if kind in found else nothing}" for kind in kinds]
    return f"map({', '.join(entries)})"

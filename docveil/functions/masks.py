"""Court-style partial masks and the policy that picks one for a value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from docveil.functions.validators import only_digits

# Which entity types each rule governs.
TAXPAYER = ("US_SSN", "US_ITIN")
FINANCIAL = ("CREDIT_CARD", "IBAN_CODE", "US_BANK_NUMBER")
BIRTH = ("US_DOB",)
ADDRESS = ("LOCATION", "GPE")
MINORS = ("PERSON_MINOR",)


def _last4(v: Column, head: str, short: str) -> Column:
    d = only_digits(v)
    return F.when(F.length(d) < 4, F.lit(short)).otherwise(F.concat(F.lit(head), F.right(d, F.lit(4))))


def mask_ssn(v: Column) -> Column:
    return _last4(v, "XXX-XX-", "XXX-XX-XXXX")


def mask_account(v: Column) -> Column:
    return _last4(v, "****", "****")


def birth_year(v: Column) -> Column:
    """The first free-standing run of four digits, or null."""
    return F.nullif(F.regexp_extract(v, r"\b(\d{4})\b", 1), F.lit(""))


def initials(v: Column) -> Column:
    """``Mary Beth Chen`` to ``M.B.C.``; null if no word starts with a letter."""
    words = F.filter(F.split(F.trim(v), r"\s+"), lambda w: w.rlike(r"^\p{L}"))
    return F.when(F.size(words) > 0, F.concat(F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "."), F.lit(".")))


@dataclass(frozen=True)
class Policy:
    """Each rule masks, or leaves its types to numbered placeholders."""

    ssn: str = "last4"
    financial: str = "last4"
    dob: str = "year"
    address: str = "redact"
    minors: str = "initials"

    def render(self, entity_type: Column, value: Column) -> Column:
        """The mask of a value, or null where a placeholder is due.

        A minor's name without a letter at a word's start gets a placeholder, not itself.
        """
        rules = (
            (self.ssn == "last4", TAXPAYER, mask_ssn(value)),
            (self.financial == "last4", FINANCIAL, mask_account(value)),
            (self.dob == "year", BIRTH, birth_year(value)),
            (self.address == "redact", ADDRESS, F.lit("[ADDRESS_REDACTED]")),
            (self.minors == "initials", MINORS, initials(value)),
        )
        out = None
        for on, types, mask in rules:
            if on:
                out = F.when(entity_type.isin(*types), mask) if out is None else out.when(entity_type.isin(*types), mask)
        return F.lit(None).cast("string") if out is None else out


COURT = Policy()
PLACEHOLDERS = Policy("placeholder", "placeholder", "placeholder", "placeholder", "placeholder")

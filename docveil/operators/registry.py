"""Detectors: what each entity type looks like, how it is validated, and what is near it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from docveil.functions import validators as V


@dataclass(frozen=True)
class Detector:
    """A pattern with its base score. ``valid`` gives true (score 1), false (dropped) or, where
    null or absent, leaves the base score. ``likely`` is a cheap test most lines fail."""

    entity: str
    pattern: str
    score: float
    valid: Callable[[Column], Column] | None = None
    context: tuple[str, ...] = ()
    likely: str = "[0-9]"
    deterministic: bool = True


# Context words.
SSN_CONTEXT = ("ssn", "ssn#", "social security", "social security number", "soc sec")
EIN_CONTEXT = ("ein", "e.i.n", "employer identification", "employer id", "federal tax id", "fein", "tax id", "taxpayer id", "tin")
ROUTING_CONTEXT = ("routing", "aba", "rtn", "routing number", "aba number")
DOCKET_CONTEXT = ("case", "docket", "civil action", "criminal action", "no.", "index no", "case no")
BAR_CONTEXT = ("bar", "bar no", "bar number", "registration", "reg. no", "attorney registration", "registration number", "nys bar", "ny bar", "admitted")
DOB_CONTEXT = ("dob", "d.o.b", "date of birth", "born", "birth date", "birthdate", "birthday")
# Month names and docket case types.
MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
CASE_TYPES = "cv|cr|mc|mj|md|bk|cm|po|gd|mdl"

SEPARATED_SSN = r"\b\d{3}[- ]\d{2}[- ]\d{4}\b"
NINE = r"\b\d{9}\b"

# Patterns and base scores.
CUSTOM = (
    Detector("US_SSN", SEPARATED_SSN, 0.6, V.ssn_valid, SSN_CONTEXT),
    Detector("US_SSN", NINE, 0.3, None, SSN_CONTEXT),
    Detector("US_EIN", r"\b\d{2}-\d{7}\b", 0.6, V.ein_valid, EIN_CONTEXT),
    Detector("US_EIN", NINE, 0.2, None, EIN_CONTEXT),
    Detector("US_BANK_ROUTING", NINE, 0.2, V.aba_valid, ROUTING_CONTEXT),
    Detector("US_COURT_DOCKET", rf"(?i)\b\d:\d{{2}}-(?:{CASE_TYPES})-\d{{4,6}}(?:-[A-Za-z]{{1,4}}){{0,2}}\b", 0.85, None, DOCKET_CONTEXT),
    Detector("US_BAR_NUMBER", r"\b\d{7}\b", 0.3, None, BAR_CONTEXT),
    Detector("US_DOB", r"\b\d{1,4}[/-]\d{1,2}[/-]\d{1,4}\b", 0.3, None, DOB_CONTEXT),
    Detector("US_DOB", rf"(?i)\b{MONTH}\.?\s+\d{{1,2}},?\s+\d{{4}}\b", 0.3, None, DOB_CONTEXT),
    Detector("US_DOB", rf"(?i)\b\d{{1,2}}\s+{MONTH}\.?\s+\d{{4}}\b", 0.3, None, DOB_CONTEXT),
)
#: Own patterns for types that a third-party library gives the reference; results differ from its.
COMMON = (
    Detector("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 1.0, None, ("email", "mail"), "@"),
    Detector("PHONE_NUMBER", r"(?:\+1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\+?\b\d{3}[.-]\d{3}[.-]\d{4}", 0.6, None, ("phone", "call", "tel", "fax", "mobile")),
    Detector("IP_ADDRESS", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 0.6, V.ip_valid, ("ip", "host", "server")),
    Detector("CREDIT_CARD", r"\b\d(?:[ -]?\d){11,18}\b", 0.3, V.luhn_valid, ("card", "credit", "visa", "mastercard")),
    Detector("IBAN_CODE", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", 0.5, V.iban_valid, ("iban", "account")),
    Detector("US_ITIN", r"\b9\d{2}[- ](?:5\d|6[0-5]|7\d|8[0-8]|9[0-24-9])[- ]\d{4}\b", 0.5, None, ("itin", "taxpayer", "tax")),
    Detector("US_BANK_NUMBER", r"\b\d{8,17}\b", 0.05, None, ("account", "acct", "bank", "checking", "savings")),
    Detector("US_PASSPORT", r"\b[A-Z]?\d{8,9}\b", 0.05, None, ("passport", "travel document")),
    Detector("US_DRIVER_LICENSE", r"\b[A-Z]\d{7,12}\b", 0.3, None, ("driver", "license", "licence", "dl")),
    Detector("URL", r"\bhttps?://[^\s<>\"']+", 0.6, None, ("url", "website", "link"), "://"),
    Detector("CRYPTO", r"\b(?:bc1[a-z0-9]{25,59}|[13][1-9A-HJ-NP-Za-km-z]{25,34})\b", 0.3, None, ("wallet", "bitcoin", "btc", "crypto")),
)
DETECTORS = CUSTOM + COMMON

# Prefixes of numbered placeholders; other types use their own name.
PREFIX = {
    "PERSON": "NAME", "US_SSN": "SSN", "US_ITIN": "ITIN", "US_EIN": "EIN", "US_BANK_ROUTING": "ROUTING",
    "US_BANK_NUMBER": "ACCOUNT", "CREDIT_CARD": "CARD", "IBAN_CODE": "IBAN", "US_COURT_DOCKET": "DOCKET",
    "US_BAR_NUMBER": "BAR", "US_DRIVER_LICENSE": "DL", "US_PASSPORT": "PASSPORT", "EMAIL_ADDRESS": "EMAIL",
    "PHONE_NUMBER": "PHONE", "LOCATION": "LOCATION", "GPE": "LOCATION", "ORG": "ORG", "ORGANIZATION": "ORG",
    "NRP": "NRP", "DATE_TIME": "DATE", "IP_ADDRESS": "IP", "URL": "URL", "CRYPTO": "CRYPTO",
}
DETERMINISTIC = frozenset(d.entity for d in DETECTORS)


def prefix_of(entity_type: Column, overrides: dict[str, str] | None = None) -> Column:
    """The override, else the prefix, else the type itself."""
    known = PREFIX | (overrides or {})
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    return F.coalesce(F.try_element_at(table, entity_type), entity_type)


def select(entities: list[str] | None = None) -> tuple[Detector, ...]:
    """The detectors of some types, or all."""
    return tuple(d for d in DETECTORS if entities is None or d.entity in entities)

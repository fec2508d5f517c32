"""The small labelled set: three documents' lines and their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The labelled documents.
CONTRACT = (
    "CONSULTING SERVICES AGREEMENT",
    "This Agreement is entered into by Sarah Chen and Acme Holdings LLC.",
    "The Consultant's email is sarah.chen@example.com and phone (212) 555-0182.",
    "Consultant SSN: 536-90-4788. Employer EIN: 13-1234567.",
    "Payment to bank routing number 021000021, account 000123456789.",
    "Company card on file: 4111 1111 1111 1111.",
    "Consultant DOB: 03/14/1985. Address: 123 Main Street, New York, NY.",
)
# Fixed values.
PLEADING = (
    "UNITED STATES DISTRICT COURT",
    "SOUTHERN DISTRICT OF NEW YORK",
    "SARAH CHEN, Plaintiff,",
    "v.                              Case No. 1:21-cv-01234",
    "ACME HOLDINGS LLC, Defendant.",
    "Before the Honorable Alison Nathan.",
    "Counsel: Robert Alvarez, Bar No. 4567890.",
    "Plaintiff email: sarah.chen@example.com.",
)
# Fixed values.
COLUMNS = ("Name", "SSN", "DOB", "Phone", "Routing")
# Fixed values.
PARTIES = (
    ("Sarah Chen", "536-90-4788", "03/14/1985", "(212) 555-0182", "021000021"),
    ("Robert Alvarez", "457-55-1462", "11/02/1979", "(718) 555-0147", "011000015"),
    ("Maria Gomez", "212-09-9997", "07/23/1990", "(917) 555-0193", "121000248"),
    ("James O'Brien", "504-22-3311", "01/09/1968", "(646) 555-0110", "026009593"),
)
# Fixed values.
CONTRACT_LABELS = (
    ("PERSON", "Sarah Chen"), ("ORG", "Acme Holdings LLC"), ("EMAIL_ADDRESS", "sarah.chen@example.com"), ("PHONE_NUMBER", "(212) 555-0182"), ("US_SSN", "536-90-4788"),
    ("US_EIN", "13-1234567"), ("US_BANK_ROUTING", "021000021"), ("CREDIT_CARD", "4111 1111 1111 1111"), ("US_DOB", "03/14/1985"), ("LOCATION", "123 Main Street"),
)
# Fixed values.
PLEADING_LABELS = (("US_COURT_DOCKET", "1:21-cv-01234"), ("PERSON", "Alison Nathan"), ("PERSON", "Robert Alvarez"), ("US_BAR_NUMBER", "4567890"), ("EMAIL_ADDRESS", "sarah.chen@example.com"))
# Fixed values.
PARTY_TYPES = ("PERSON", "US_SSN", "US_DOB", "PHONE_NUMBER", "US_BANK_ROUTING")


def line_rows() -> list[tuple[str, int, str, str]]:
    rows = [("contract.docx", i, t, f"para{i}") for i, t in enumerate(CONTRACT)]
    rows += [("pleading.pdf", i, t, "p1") for i, t in enumerate(PLEADING)]
    cells = [(f"Parties!{'ABCDE'[c]}{r + 1}", v) for r, row in enumerate((COLUMNS, *PARTIES)) for c, v in enumerate(row)]
    return rows + [("parties.xlsx", i, v, s) for i, (s, v) in enumerate(cells)]


def label_rows() -> list[tuple[str, str, str]]:
    parties = [(t, v) for row in PARTIES for t, v in zip(PARTY_TYPES, row, strict=True)]
    docs = (("contract.docx", CONTRACT_LABELS), ("pleading.pdf", PLEADING_LABELS), ("parties.xlsx", parties))
    return [(doc, t, v) for doc, labels in docs for t, v in labels]


def labelled_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(line_rows(), "doc_id string, line_no int, text string, source string")


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(label_rows(), "doc_id string, entity_type string, value string")

"""A query per operator, on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.functions import masks, validators
from docveil.functions import spans as S
from docveil.operators import anonymize, measure, runs
from docveil.operators.detect import analyze, dictionary as find_terms, entities, with_entities, with_offsets
from docveil.operators.registry import select
from docveil.sinks import tables
from docveil.sinks.html import highlighted_lines, rendered
from docveil.sources.text import lines_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(_table(spark, sf_dir, "documents"))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze(_documents(spark, sf_dir))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' lines with their entities and tokens."""
    return anonymize.with_tokens(with_entities(with_offsets(_documents(spark, sf_dir))))


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, d): nine digits made from each order's key."""
    n = F.pmod(F.col("o_orderkey").cast("long") * 7919 * 101, F.lit(1000000000))
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.lpad(n.cast("string"), 9, "0").alias("d"))


def _ssn(d: Column) -> Column:
    return F.concat(F.substring(d, 1, 3), F.lit("-"), F.substring(d, 4, 2), F.lit("-"), F.substring(d, 6, 4))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with court and identity data made from orders: 3 lines a customer's document."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("doc_id"), F.col("o_orderkey").cast("long").alias("k"), F.to_date("o_orderdate").alias("day"))
    d = F.lpad(F.pmod(F.col("k") * 7919 * 101, F.lit(1000000000)).cast("string"), 9, "0")
    texts = F.array(
        F.concat(F.lit("Plaintiff SSN "), _ssn(d), F.lit(", DOB "), F.date_format("day", "MM/dd/yyyy"), F.lit(".")),
        F.concat(F.lit("Case No. 1:"), F.date_format("day", "yy"), F.lit("-cv-"), F.lpad(F.pmod("k", F.lit(100000)).cast("string"), 5, "0"), F.lit("; routing "), d),
        F.concat(F.lit("Employer EIN "), F.substring(d, 1, 2), F.lit("-"), F.substring(d, 3, 7), F.lit(", Bar No. "), F.substring(d, 1, 7)),
    )
    rows = o.select("doc_id", "k", F.posexplode(texts).alias("i", "text"))
    return rows.select("doc_id", (F.col("k") * 3 + F.col("i")).cast("int").alias("line_no"), "text", F.lit("built").alias("source"))


CASES = ("US_SSN", "US_DOB", "US_COURT_DOCKET", "US_BANK_ROUTING", "US_EIN", "US_BAR_NUMBER")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", "line_no", "text")


def global_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_offsets(_documents(spark, sf_dir)).select("doc_id", "line_no", "offset")


def _detect(entity: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = with_entities(_documents(spark, sf_dir).withColumn("offset", F.lit(0)), select([entity]))
        return entities(found).select("doc_id", "line_no", F.col("line_start").cast("long").alias("start"), F.col("line_end").cast("long").alias("end"), "score", F.col("text").alias("value"))

    return query


def _validate(valid: Callable[[Column], Column], shape: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = shape(F.col("d"))
        return _numbers(spark, sf_dir).select("id", value.alias("value"), valid(value).alias("ok"))

    return query


def validate_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit("4111 11"), F.substring("d", 1, 2), F.lit(" "), F.substring("d", 3, 4), F.lit(" "), F.lit("111"), F.substring("d", 9, 1))
    return _numbers(spark, sf_dir).select("id", value.alias("value"), validators.luhn_valid(value).alias("ok"))


def validate_iban(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit("GB33BUKB2020155555"), F.substring("d", 1, 4))
    known = F.when(F.col("id") % 50 == 1, F.lit("GB33BUKB20201555555555")).otherwise(value)
    return _numbers(spark, sf_dir).select("id", known.alias("value"), validators.iban_valid(known).alias("ok"))


def detect_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_entities(_cases(spark, sf_dir).withColumn("offset", F.lit(0)), select(list(CASES)))
    return entities(found).select("doc_id", "line_no", "entity_type", F.col("line_start").cast("long").alias("start"), F.col("line_end").cast("long").alias("end"), "score", F.col("text").alias("value"))


def trim_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracketed, quoted names as a detector would give them."""
    raw = F.concat(F.lit(" (\""), F.col("c_name"), F.lit("."), F.col("c_mktsegment"), F.lit(".\"), "))
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), raw.alias("raw"))
    value = S.trimmed(F.col("raw"))
    return c.select("id", S.trimmed_start(F.col("raw"), F.lit(0)).cast("long").alias("start"), value.alias("value"))


def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans made from order lines: per order, the greedy choice by class, score, length and place."""
    x = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("id"), F.col("l_linenumber").cast("int").alias("ordinal"), F.pmod("l_partkey", F.lit(40)).cast("int").alias("start"), (F.pmod("l_suppkey", F.lit(9)) + 1).cast("int").alias("n"), F.pmod("l_partkey", F.lit(2)).cast("int").alias("det"), F.pmod("l_suppkey", F.lit(5)).cast("int").alias("s"))
    kind = "array<struct<det:int,nscore:int,nlen:int,start:int,ordinal:int,end:int>>"
    span = F.struct("det", (-F.col("s")).alias("nscore"), (-F.col("n")).alias("nlen"), "start", "ordinal", (F.col("start") + F.col("n")).alias("end"))
    chosen = x.groupBy("id").agg(F.collect_list(span).alias("spans")).select("id", F.explode(S.resolve(F.col("spans"), kind)).alias("e"))
    return chosen.select("id", F.col("e.start").cast("long").alias("start"), F.col("e.end").cast("long").alias("end"), F.col("e.ordinal").cast("long").alias("ordinal"))


def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).select("doc_id", "line_no", "entity_type", F.col("start").cast("long"), F.col("end").cast("long"), "score", F.col("text").alias("value"))


def placeholder_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize.key_table(_entities(spark, sf_dir)).select("doc_id", "placeholder", "entity_type", "original_value", "occurrences", F.col("first_start").cast("long"))


def anonymized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize.joined_text(anonymize.anonymized_lines(_tokens(spark, sf_dir)))


def anonymized_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymized_text(spark, sf_dir).select("doc_id", rendered(F.col("text")).alias("html"))


def counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize.counts_by_type(anonymize.key_table(_entities(spark, sf_dir)))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize.totals(anonymize.key_table(_entities(spark, sf_dir)))


def chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize.chips(anonymize.key_table(_entities(spark, sf_dir)))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names, and names of four words, in lines about them."""
    c = _table(spark, sf_dir, "customer")
    long = F.concat(F.lit("Bank of the "), F.col("c_name"))
    text = F.concat(F.lit("Buyer "), F.col("c_name"), F.lit(", of "), F.col("c_mktsegment"), F.lit("; pays by "), long, F.lit("."))
    rows = c.select(F.col("c_custkey").cast("long").alias("doc_id"), F.lit(0).alias("line_no"), text.alias("text"))
    found = find_terms(rows, c.select(F.explode(F.array(F.col("c_name"), long)).alias("term")), "PERSON")
    return found.select("doc_id", "entity_type", F.col("line_start").cast("long").alias("start"), F.col("line_end").cast("long").alias("end"), F.col("text").alias("value"))


def redaction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize.redaction_pairs(anonymize.key_table(_entities(spark, sf_dir))).select("doc_id", "original_value", "token", F.col("first_start").cast("long"))


def key_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's key file."""
    return tables.key_text(anonymize.key_table(_entities(spark, sf_dir)))


def reidentify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rewritten and put back: the text of the lines that were kept."""
    tokens = _tokens(spark, sf_dir)
    text = anonymize.joined_text(anonymize.anonymized_lines(tokens))
    return anonymize.reidentify(text, anonymize.key_of(tokens)).select("doc_id", "text")


def _identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with births in words, accounts, papers and links, made from customers."""
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("doc_id"))
    d = F.lpad(F.pmod(F.col("doc_id") * 7919 * 101, F.lit(1000000000)).cast("string"), 9, "0")
    day = F.date_add(F.lit("1950-01-01").cast("date"), F.col("doc_id").cast("int") % 20000)
    texts = F.array(
        F.concat(F.lit("Born "), F.date_format(day, "MMMM d, yyyy")),
        F.concat(F.lit("Date of birth: "), F.date_format(day, "d MMM yyyy"), F.lit(".")),
        F.concat(F.lit("IBAN "), F.when(F.col("doc_id") % 3 == 1, F.lit("GB33BUKB20201555555555")).otherwise(F.concat(F.lit("GB33BUKB2020155555"), F.substring(d, 1, 4)))),
        F.concat(F.lit("Account "), d, F.lit("; passport no. A"), F.substring(d, 1, 8)),
        F.concat(F.lit("ITIN 9"), F.substring(d, 1, 2), F.lit("-7"), F.substring(d, 3, 1), F.lit("-"), F.substring(d, 4, 4)),
        F.concat(F.lit("Driver license K"), d, F.lit(" at https://x.example/"), d),
        F.concat(F.lit("Bitcoin wallet 1"), F.translate(F.concat(d, d, d), "0", "x")),
        F.concat(F.lit("Call 212-555-"), F.substring(d, 1, 4), F.lit(" or (212) 555-"), F.substring(d, 5, 4)),
    )
    rows = c.select("doc_id", F.posexplode(texts).alias("line_no", "text"))
    return rows.withColumn("source", F.lit("built"))


def detect_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All types on the built lines; each line's entities are a choice among all detectors'."""
    found = with_entities(_identities(spark, sf_dir).withColumn("offset", F.lit(0)))
    return entities(found).select("doc_id", "line_no", "entity_type", F.col("line_start").cast("long").alias("start"), F.col("line_end").cast("long").alias("end"), "score", F.col("text").alias("value"))


def placeholder_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of the built cases with placeholders for all types and two prefixes of one's own."""
    own = {"US_SSN": "TAXPAYER", "US_DOB": "BIRTH"}
    key = anonymize.key_table(analyze(_cases(spark, sf_dir), select(list(CASES))), masks.PLACEHOLDERS, own)
    return key.select("doc_id", "placeholder", "entity_type", "original_value", "occurrences")


def policy_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of every type that the court's rules govern, and of one that they leave alone."""
    c = _table(spark, sf_dir, "customer")
    d = F.lpad(F.pmod(F.col("c_custkey").cast("long") * 7919, F.lit(100000000)).cast("string"), 8, "0")
    value = {
        "US_SSN": d, "US_ITIN": F.concat(F.lit("9"), d), "CREDIT_CARD": F.concat(F.lit("4111 1111 "), d), "IBAN_CODE": F.concat(F.lit("GB33BUKB"), d), "US_BANK_NUMBER": F.substring(d, 1, 3), "LOCATION": F.col("c_mktsegment"),
        "GPE": F.col("c_name"), "PERSON_MINOR": F.concat(F.col("c_name"), F.lit(" "), F.col("c_mktsegment")), "US_DOB": F.concat(F.lit("1/2/"), F.substring(d, 1, 4)), "ORG": F.col("c_name"),
    }
    rows = c.select(F.col("c_custkey").cast("long").alias("id"), F.explode(F.array(*(F.struct(F.lit(k).alias("entity_type"), v.alias("value")) for k, v in value.items()))).alias("x"))
    return rows.select("id", "x.entity_type", "x.value", masks.COURT.render(F.col("x.entity_type"), F.col("x.value")).alias("mask"))


def splice_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans made from order lines, put into a text though some overlap."""
    x = _table(spark, sf_dir, "lineitem")
    start = F.pmod("l_partkey", F.lit(50)).cast("int")
    span = F.struct(start.alias("start"), (start + F.pmod("l_suppkey", F.lit(9)).cast("int") + 1).alias("end"), F.concat(F.lit("["), F.col("l_linenumber").cast("string"), F.lit("]")).alias("token"))
    text = F.rpad(F.col("id").cast("string"), 60, "abcdefghij")
    return x.groupBy(F.col("l_orderkey").cast("long").alias("id")).agg(F.collect_list(span).alias("spans")).select("id", S.splice(text, F.col("spans")).alias("text"))


def court_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of the built cases under the court's masks; several values may share a mask."""
    key = anonymize.key_table(analyze(_cases(spark, sf_dir), select(list(CASES))), masks.COURT)
    return key.select("doc_id", "placeholder", "entity_type", "original_value", "occurrences", "is_ambiguous")


def _mask(f: Callable[[Column], Column], shape: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = shape(F.col("d"))
        return _numbers(spark, sf_dir).select("id", value.alias("value"), f(value).alias("mask"))

    return query


def mask_birth_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "M-d-yy")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    return o.select(F.col("o_orderkey").cast("long").alias("id"), value.alias("value"), masks.birth_year(value).alias("mask"))


def mask_initials(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    value = F.concat(F.col("c_name"), F.lit("  "), F.lower("c_mktsegment"), F.lit(" 9x"))
    return c.select(F.col("c_custkey").cast("long").alias("id"), value.alias("value"), masks.initials(value).alias("mask"))


def _page(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A page's line for each order, with its number as three words and as one, and the values to find."""
    n = _numbers(spark, sf_dir)
    texts = F.array(F.lit("SSN"), F.substring("d", 1, 3), F.substring("d", 4, 2), F.substring("d", 6, 4), F.lit("seen"), F.substring("d", 6, 4), F.concat(F.substring("d", 1, 3), F.lit("-"), F.substring("d", 4, 2), F.lit("-"), F.substring("d", 6, 4)))
    w = n.select(F.col("id").alias("doc_id"), F.posexplode(texts).alias("word_no", "text"))
    x0 = F.col("word_no") * 10.0
    w = w.select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("block"), F.lit(0).alias("line"), "word_no", x0.alias("x0"), F.lit(72.0).alias("y0"), (x0 + 9.0).alias("x1"), F.lit(84.0).alias("y1"), "text")
    return w, n.select(F.col("id").alias("doc_id"), F.explode(F.array(_ssn(F.col("d")), F.lit("seen"), F.lit("unseen"))).alias("value"))


def find_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's number and a word, found as runs of words, with their boxes."""
    hit = runs.find_runs(*_page(spark, sf_dir))
    return hit.select("doc_id", "value", F.col("first_word").cast("long"), F.col("last_word").cast("long"), *(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")))


def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, values = _page(spark, sf_dir)
    return runs.match_counts(values, runs.find_runs(words, values))


def _labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels of nations and orders' numbers against what was "detected": two in three numbers are
    another number, and every other nation is said in another way."""
    nation, numbers = _table(spark, sf_dir, "nation"), _numbers(spark, sf_dir)
    expected = nation.select(F.lit("LOCATION").alias("entity_type"), F.col("n_name").alias("value")).unionByName(numbers.select(F.lit("US_SSN").alias("entity_type"), _ssn(F.col("d")).alias("value")))
    said = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("  "), F.lower("n_name"), F.lit(" state "))).otherwise(F.reverse("n_name"))
    number = F.when(F.col("id") % 3 == 0, F.col("d")).otherwise(F.concat(F.col("d"), F.lit("0")))
    detected = nation.select(F.lit("GPE").alias("entity_type"), said.alias("value"))
    return expected, detected.unionByName(numbers.select(F.when(F.col("id") % 2 == 0, "US_SSN").otherwise("US_EIN").alias("entity_type"), number.alias("value")))


def recall_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.recall_by_type(measure.hits(*_labels(spark, sf_dir)))


def precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.precision(*_labels(spark, sf_dir))


def missed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.missed_labels(measure.hits(*_labels(spark, sf_dir)))


def recall_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's rows, with ratios of two digits."""
    return tables.recall_rows(recall_by_type(spark, sf_dir))


def evaluate_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of what is detected in the built cases, each document by itself, against the orders' numbers."""
    cases = _cases(spark, sf_dir)
    found = analyze(cases, select(list(CASES)))
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("doc_id"), F.lpad(F.pmod(F.col("o_orderkey").cast("long") * 7919 * 101, F.lit(1000000000)).cast("string"), 9, "0").alias("d"))
    kinds = {"US_SSN": _ssn(F.col("d")), "US_EIN": F.concat(F.substring("d", 1, 2), F.lit("-"), F.substring("d", 3, 7)), "US_BANK_NUMBER": F.reverse("d")}
    labels = o.select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("entity_type"), v.alias("value")) for k, v in kinds.items()))).alias("x")).select("doc_id", "x.*")
    return measure.evaluate(found, labels, per_document=True)[0]


def highlighted_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return highlighted_lines(with_entities(_documents(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries by name."""
    dashed = lambda d: F.concat(F.substring(d, 1, 2), F.lit("-"), F.substring(d, 3, 7))
    same = lambda d: d
    plain = (
        lines, global_offsets, validate_luhn, validate_iban, detect_cases, trim_spans, resolve_overlaps, document_entities, placeholder_key, anonymized_text, counts_by_type, totals, chips, dictionary,
        redaction_pairs, reidentify, court_key, mask_birth_year, mask_initials, find_runs, recall_by_type, precision, missed_labels, highlighted_html,
        anonymized_html, key_csv, detect_identities, placeholder_cases, policy_masks, splice_overlaps, run_counts, recall_report, evaluate_cases,
    )
    return {f.__name__: f for f in plain} | {
        "detect_email": _detect("EMAIL_ADDRESS"), "detect_phone": _detect("PHONE_NUMBER"), "detect_ip": _detect("IP_ADDRESS"), "detect_card_luhn": _detect("CREDIT_CARD"),
        "validate_ssn": _validate(validators.ssn_valid, _ssn), "validate_ein": _validate(validators.ein_valid, dashed), "validate_aba": _validate(validators.aba_valid, same),
        "mask_ssn": _mask(masks.mask_ssn, _ssn), "mask_account": _mask(masks.mask_account, lambda d: F.when(F.substring(d, 9, 1) == "0", F.lit("A12")).otherwise(F.concat(F.lit("DE 44 "), d))),
    }

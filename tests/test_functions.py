import random

import pytest
from pyspark.sql import functions as F

from docveil.functions import masks, spans, validators


def one(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v")).alias("x")).collect()]


@pytest.mark.parametrize(
    ("f", "good", "bad"),
    [
        (validators.luhn_valid, ["4111 1111 1111 1111"], ["4111 1111 1111 1112", "0", ""]),
        (validators.aba_valid, ["021000021", "011000015"], ["021000022", "999999999", "1"]),
        (validators.ssn_valid, ["536-90-4788"], ["000-12-3456", "666-12-3456", "900-12-3456", "536-00-4788", "536-90-0000"]),
        (validators.ein_valid, ["13-1234567"], ["07-1234567", "13"]),
        (validators.iban_valid, ["GB33BUKB20201555555555", "gb33 BUKB 2020 1555 5555 55"], ["GB33BUKB20201555555556", "X"]),
        (validators.ip_valid, ["1.2.3.4", "255.0.0.01"], ["256.1.1.1", "1.2.3"]),
    ],
)
def test_validators(spark, f, good, bad):
    assert one(spark, f, *good, *bad) == [True] * len(good) + [False] * len(bad)


def test_masks(spark):
    assert one(spark, masks.mask_ssn, "536-90-4788", "536904788", "12") == ["XXX-XX-4788", "XXX-XX-4788", "XXX-XX-XXXX"]
    assert one(spark, masks.mask_account, "4111 1111 1111 1111", "GB33BUKB20201555555555", "a1") == ["****1111", "****5555", "****"]
    assert one(spark, masks.birth_year, "03/14/1985", "March 14, 1985", "3-14-85") == ["1985", "1985", None]
    assert one(spark, masks.initials, "Mary Beth Chen", "  42 ") == ["M.B.C.", None]


def test_policy(spark):
    rows = spark.createDataFrame([("US_SSN", "536-90-4788"), ("US_EIN", "13-1234567"), ("GPE", "Rome"), ("PERSON_MINOR", "Ann Lee"), ("US_DOB", "3-14-85")], "t string, v string")
    said = lambda p: [r[0] for r in rows.select(p.render(F.col("t"), F.col("v"))).collect()]
    assert said(masks.COURT) == ["XXX-XX-4788", None, "[ADDRESS_REDACTED]", "A.L.", None]
    assert said(masks.PLACEHOLDERS) == [None] * 5


def test_matches_slice_back(spark):
    texts = ["12 a 34", "no", "", "\U0001f600 7 é 88", "9"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", spans.matches(F.col("t"), "[0-9]+").alias("m")).collect()
    for r in rows:
        assert all(r.t[m.start : m.end] == m.value for m in r.m)
    assert [len(r.m) for r in rows] == [2, 0, 0, 2, 1]


def test_resolve_equals_greedy(spark):
    rng = random.Random(3)
    cases = []
    for i in range(150):
        rows = []
        for k in range(rng.randint(0, 8)):
            start, n = rng.randint(0, 20), rng.randint(1, 6)
            rows.append((rng.randint(0, 1), -rng.choice([0.3, 0.5, 1.0]), -n, start, k, start + n))
        cases.append((i, rows))
    kind = "array<struct<det:int,nscore:double,nlen:int,start:int,ordinal:int,end:int>>"
    got = spark.createDataFrame(cases, f"i int, s {kind}").select("i", spans.resolve(F.col("s"), kind).alias("r")).collect()
    for r in got:
        want = []
        for s in sorted(cases[r.i][1]):
            if not any(s[3] < c[5] and c[3] < s[5] for c in want):
                want.append(s)
        assert [tuple(x) for x in r.r] == sorted(want, key=lambda s: s[3])


def test_splice(spark):
    kind = "array<struct<start:int,end:int,token:string>>"
    rows = [("A=Alice B=Bob C=Carol", [(2, 7, "[NAME_1]"), (16, 21, "[NAME_3]"), (10, 13, "[NAME_2]")]), ("abcdef", [(0, 4, "X"), (2, 6, "Y")]), ("abc", [])]
    got = [r[0] for r in spark.createDataFrame(rows, f"t string, s {kind}").select(spans.splice(F.col("t"), F.col("s"))).collect()]
    assert got == ["A=[NAME_1] B=[NAME_2] C=[NAME_3]", "abY", "abc"]

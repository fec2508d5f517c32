import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from docveil.functions import masks
from docveil.operators import anonymize, measure, runs
from docveil.operators.detect import analyze, dictionary, entities, with_entities, with_offsets
from docveil.operators.external import recognized, with_listed
from docveil.operators.registry import select
from docveil.pipeline import process_files, process_lines
from docveil.sinks import html, tables
from docveil.sinks.files import write_files
from docveil.sources import office, samples
from docveil.sources.text import lines_of
from docveil.streaming.detect import stream_entities

LINE = "doc_id string, line_no int, text string, source string"


def lines(spark, *texts):
    return spark.createDataFrame([("d", i, t, f"line{i}") for i, t in enumerate(texts)], LINE)


WANTED = [
    ("SSN 536-90-4788.", ("US_SSN", "536-90-4788", 1.0)),
    ("ssn 536904788", ("US_SSN", "536904788", 0.65)),
    ("EIN: 13-1234567", ("US_EIN", "13-1234567", 1.0)),
    ("wire to 021000021", ("US_BANK_ROUTING", "021000021", 1.0)),
    ("SSN 021000021", ("US_BANK_ROUTING", "021000021", 1.0)),
    ("2:22-CV-00987-JGK-RML", ("US_COURT_DOCKET", "2:22-CV-00987-JGK-RML", 0.85)),
    ("Bar No. 4567890", ("US_BAR_NUMBER", "4567890", 0.65)),
    ("born March 14, 1985", ("US_DOB", "March 14, 1985", 0.65)),
    ("DOB 03/14/1985", ("US_DOB", "03/14/1985", 0.65)),
    ("card 4111 1111 1111 1111", ("CREDIT_CARD", "4111 1111 1111 1111", 1.0)),
    ("x GB33BUKB20201555555555", ("IBAN_CODE", "GB33BUKB20201555555555", 1.0)),
    ("  (john.doe@example.com).  ", ("EMAIL_ADDRESS", "john.doe@example.com", 1.0)),
    ("see https://a.example/b?c now", ("URL", "https://a.example/b?c", 0.6)),
]
CLEAN = ["000-12-3456", "07-1234567", "999999999", "4111 1111 1111 1112", "12/31/1999", "1234567", ""]


def test_detects(spark):
    rows = analyze(lines(spark, *(t for t, _ in WANTED))).collect()
    got = {(r.line_no, r.entity_type, r.text, round(r.score, 2)) for r in rows}
    assert {(i, *want) for i, (_, want) in enumerate(WANTED)} <= got


def test_leaves_alone(spark):
    types = ["US_SSN", "US_EIN", "US_BANK_ROUTING", "CREDIT_CARD", "US_DOB", "US_BAR_NUMBER"]
    assert analyze(lines(spark, *CLEAN), select(types)).collect() == []


def test_offsets_slice_the_joined_text(spark):
    rows = lines(spark, "Mail a@b.example", "x", "IP 10.0.0.1 and a@b.example")
    whole = "\n".join(r.text for r in rows.orderBy("line_no").collect())
    got = analyze(rows, select(["EMAIL_ADDRESS", "IP_ADDRESS"])).collect()
    assert len(got) == 3 and all(whole[r.start : r.end] == r.text for r in got)


def test_lines_of_drops_blanks_and_nulls(spark):
    t = spark.createDataFrame([(1, "a\n \n\nb"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.line_no, r.text) for r in lines_of(t).orderBy("doc_id", "line_no").collect()] == [(1, 0, "a"), (1, 3, "b")]
    assert [r.offset for r in with_offsets(lines_of(t)).orderBy("line_no").collect()] == [0, 2]


def test_key_numbers_and_counts(spark):
    done = process_lines(lines(spark, "a@b.example c@d.example", "a@b.example SSN 536-90-4788"), masks.COURT)
    key = {r.original_value: (r.placeholder, r.occurrences) for r in done.key.collect()}
    assert key == {"a@b.example": ("[EMAIL_1]", 2), "c@d.example": ("[EMAIL_2]", 1), "536-90-4788": ("XXX-XX-4788", 1)}
    text = anonymize.joined_text(done.rewritten).first().text
    assert text == "[EMAIL_1] [EMAIL_2]\n[EMAIL_1] SSN XXX-XX-4788"
    assert {(r.entity_type, r.n_values) for r in anonymize.counts_by_type(done.key).collect()} == {("EMAIL_ADDRESS", 2), ("US_SSN", 1)}
    assert {r.token for r in anonymize.redaction_pairs(done.key).collect()} == {"[EMAIL_1]", "[EMAIL_2]", "XXX-XX-4788"}
    back = anonymize.reidentify(anonymize.joined_text(done.rewritten), done.key).first()
    assert back.text == "a@b.example c@d.example\na@b.example SSN 536-90-4788"


def test_tokens_equal_the_key(spark):
    """Tokens from windows and the key from aggregates number alike, masked values and line order too."""
    texts = ["b@b.example SSN 536-90-4788 a@b.example", "", "a@b.example DOB 03/14/1985 (212) 555-0182", "SSN 212-09-4788 b@b.example"]
    placed = with_entities(with_offsets(lines(spark, *texts)))
    for policy in (None, masks.COURT, masks.PLACEHOLDERS):
        cols = ["doc_id", "placeholder", "entity_type", "original_value", "occurrences", "first_start", "first_end", "is_ambiguous"]
        tokens = anonymize.with_tokens(placed, policy)
        rows = lambda df: sorted(map(tuple, df.select(cols).collect()), key=str)
        assert rows(anonymize.key_of(tokens)) == rows(anonymize.key_table(entities(placed), policy)) and tokens.count() == 4


def test_kept_result_detects_once(spark):
    done = process_lines(lines(spark, "a@b.example", "x"))
    try:
        done.keep()
        assert done.key.count() == 1 and "InMemoryRelation" in done.rewritten._jdf.queryExecution().optimizedPlan().toString()
    finally:
        done.drop()


def test_many_matches_in_a_line(spark):
    """More matches than a fold's, in time; places are those of the text."""
    text = "".join(f"x{i}@y.example, 10.0.0.{i % 256} é " for i in range(2000))
    got = analyze(lines(spark, text), select(["EMAIL_ADDRESS", "IP_ADDRESS"])).collect()
    assert len(got) == 4000 and all(text[r.start : r.end] == r.text for r in got)


def test_round_trip_and_ambiguity(spark):
    texts = ["SSN 536-90-4788 and SSN 212-09-4788", "call (212) 555-0182"]
    whole = "\n".join(texts)
    done = process_lines(lines(spark, *texts))
    assert anonymize.reidentify(anonymize.joined_text(done.rewritten), done.key).first().text == whole
    masked = process_lines(lines(spark, *texts), masks.COURT)
    back = anonymize.reidentify(anonymize.joined_text(masked.rewritten), masked.key).first()
    assert back.n_refused == 2 and "XXX-XX-4788 and SSN XXX-XX-4788" in back.text


def test_overrides_and_unmapped_prefix(spark):
    done = process_lines(lines(spark, "DOB 03/14/1985, a@b.example"), overrides={"EMAIL_ADDRESS": "MAIL"})
    assert {r.placeholder for r in done.key.collect()} == {"[US_DOB_1]", "[MAIL_1]"}


def test_dictionary(spark):
    terms = spark.createDataFrame([("Sarah Chen",), ("Rome",), ("First Bank of the North",), (None,)], "term string")
    rows = dictionary(lines(spark, "By Sarah Chen, of Rome.", "sarah chen", "The First Bank of the North, Inc"), terms, "PERSON").collect()
    assert {(r.text, r.line_start, r.line_end) for r in rows} == {("Sarah Chen", 3, 13), ("Rome", 18, 22), ("First Bank of the North", 4, 27)}
    assert dictionary(lines(spark, "By Sarah"), terms.limit(0), "PERSON").count() == 0


def test_long_dictionary(spark, tmp_path):
    """A list that is small only as compressed files is not broadcast; a short one is."""
    spark.range(60_000).selectExpr("concat('Buyer Number ', id) AS term").write.parquet(f"file://{tmp_path}/terms")
    terms = spark.read.parquet(f"file://{tmp_path}/terms")
    rows = lines(spark, "By Buyer Number 59999, and Buyer Number 60000.", "Buyer Number 7")
    for listed, broadcast in ((terms, False), (terms.where("term like '%9999' or term like '% 7'"), True)):
        found = dictionary(rows, listed, "PERSON")
        assert sorted((r.line_no, r.text, r.line_start) for r in found.collect()) == [(0, "Buyer Number 59999", 3), (1, "Buyer Number 7", 0)]
        assert ("BroadcastHashJoin" in found._jdf.queryExecution().toString()) == broadcast


def words(spark, *texts):
    rows = [("d", 1, 0, 0, i, 1.0 * i, 0.0, i + 0.9, 1.0, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id string, page int, block int, line int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")


@pytest.mark.parametrize(
    ("texts", "value", "want"),
    [
        (["SSN", "536", "90", "4788"], "536-90-4788", [(1, 3)]),
        (["536-90-4788"], "4788", []),
        (["By", "Sarah", "Chen,", "and", "Sarah", "Chen"], "Sarah Chen", [(1, 2), (4, 5)]),
        (["a", "a", "a"], "a a", [(0, 1)]),
    ],
)
def test_runs(spark, texts, value, want):
    values = spark.createDataFrame([("d", value)], "doc_id string, value string")
    r = runs.find_runs(words(spark, *texts), values)
    assert sorted((x.first_word, x.last_word) for x in r.collect()) == want
    assert runs.unlocated(values, r).count() == (0 if want else 1)
    assert [x.n_runs for x in runs.match_counts(values, r).collect()] == [len(want)]


def test_recall_and_precision(spark):
    pair = "entity_type string, value string"
    expected = spark.createDataFrame([("US_SSN", "536-90-4788"), ("US_SSN", "457-55-1462"), ("PERSON", "Sarah Chen"), ("US_DOB", "03/14/1985"), ("US_SSN", "212-09-9997")], pair)
    detected = spark.createDataFrame([("US_SSN", "536904788"), ("PERSON", "sarah  chen"), ("DATE_TIME", "03/14/1985"), ("US_BANK_ROUTING", "457551462"), ("URL", "zz")], pair)
    hit = measure.hits(expected, detected)
    by = {r.entity_type: r for r in measure.recall_by_type(hit).collect()}
    assert (by["US_SSN"].value_hits, by["US_SSN"].typed_hits) == (2, 1)
    assert (by["US_DOB"].typed_hits, by["PERSON"].typed_hits, by["ALL"].expected, by["ALL"].value_hits) == (1, 1, 5, 4)
    assert [r.value for r in measure.missed_labels(hit).collect()] == ["212-09-9997"]
    p = measure.precision(expected, detected).first()
    assert (p.detected, p.true_hits, p.precision) == (5, 4, 0.8)
    none = measure.recall_by_type(measure.hits(expected.limit(0), detected)).collect()
    assert all(r.value_recall == 0.0 for r in none)


def test_labelled_set(spark):
    detected = analyze(samples.labelled_lines(spark)).select("doc_id", "entity_type", F.col("text").alias("value"))
    by = {r.entity_type: r for r in measure.recall_by_type(measure.hits(samples.labels(spark), detected)).collect()}
    assert by["ALL"].expected == 35
    for kind in ("US_EIN", "EMAIL_ADDRESS", "CREDIT_CARD", "US_COURT_DOCKET", "US_BAR_NUMBER", "US_SSN", "US_BANK_ROUTING"):
        assert by[kind].value_recall == 1.0, kind
    assert "ALL" in tables.report(measure.recall_by_type(measure.hits(samples.labels(spark), detected)))


def test_html(spark):
    rows = spark.createDataFrame([("a <b> x@y.example", [(6, 17, "EMAIL_ADDRESS", 1.0)])], "t string, s array<struct<start:int,end:int,entity_type:string,score:double>>")
    got = rows.select(html.highlighted(F.col("t"), F.col("s"))).first()[0]
    assert got == 'a &lt;b&gt; <mark style="background:#a0c4ff" title="Email Address 1.00">x@y.example</mark>'
    assert spark.range(1).select(html.rendered(F.lit("<[EMAIL_1] XXX-XX-4788>"))).first()[0] == "&lt;<mark>[EMAIL_1]</mark> <mark>XXX-XX-4788</mark>&gt;"


def _zip(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), data)
    return out.getvalue()


def make_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda *runs: "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('Name')}{cell('SSN')}</w:tr><w:tr>{cell('Robert')}{cell('536-90-4788')}</w:tr></w:tbl>"
    body = p("Caption") + p("") + p("Mail: a@b", ".example now") + table
    return _zip(word__document_dot_xml=f"<w:document {w}><w:body>{body}</w:body></w:document>")


def make_xlsx():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cells = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>42</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2" t="inlineStr"><is><t>021000021</t></is></c></row>'
    return _zip(
        xl__workbook_dot_xml=f'<workbook {s} {r}><sheets><sheet name="Parties" sheetId="1" r:id="rId1"/></sheets></workbook>',
        xl___rels__workbook_dot_xml_dot_rels='<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>'.replace("<Relationships>", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'),
        xl__worksheets__sheet1_dot_xml=f"<worksheet {s}><sheetData>{cells}</sheetData></worksheet>",
        xl__sharedStrings_dot_xml=f"<sst {s}><si><t>SSN</t></si><si><t>536-90-4788</t></si></sst>",
    )


def test_office_round_trip(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(make_docx())
    (tmp_path / "b.xlsx").write_bytes(make_xlsx())
    done, files = process_files(spark, str(tmp_path / "a.docx"), str(tmp_path / "b.xlsx"), policy=masks.COURT)
    assert all(r.error is None and r.unlocated == [] and r.n_found > 0 for r in files.collect())
    got = {(r.doc_id.rsplit("/", 1)[1], r.source): r.text for r in done.lines.collect()}
    assert got["a.docx", "para2"] == "Mail: a@b.example now" and got["a.docx", "table0:r1c1"] == "536-90-4788" and got["b.xlsx", "Parties!C2"] == "021000021"
    new = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in files.collect()}
    word, excel = dict(office.docx_lines(new["a.docx"])), dict(office.xlsx_lines(new["b.xlsx"]))
    assert word["para2"] == "Mail: [EMAIL_1] now" and word["table0:r1c1"] == "XXX-XX-4788" and word["para0"] == "Caption"
    assert excel == {"Parties!A1": "SSN", "Parties!B1": "42", "Parties!A2": "XXX-XX-4788", "Parties!C2": "[ROUTING_1]"}
    for data in new.values():
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert not any(b"536-90-4788" in z.read(n) or b"a@b" in z.read(n) for n in z.namelist())


def test_unsupported_before_missing(spark):
    with pytest.raises(ValueError, match="unsupported"):
        office.read_files(spark, "/nowhere/x.txt")


def test_csv(spark, tmp_path):
    done = process_lines(lines(spark, 'x a@b.example, "q" SSN 536-90-4788'))
    tables.write_key_csv(done.key, str(tmp_path / "key"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "key"))
    assert {r.original_value for r in back.collect()} == {"a@b.example", "536-90-4788"} and back.columns[0] == "doc_id"
    odd = spark.createDataFrame([("d", "[X_1]", "X", 'a,"b"', 2, 0)], "doc_id string, placeholder string, entity_type string, original_value string, occurrences long, first_start long")
    assert tables.key_text(odd).first().csv == 'placeholder,entity_type,original_value,occurrences\r\n[X_1],X,"a,""b""",2\r\n'
    hit = measure.hits(samples.labels(spark), samples.labels(spark))
    tables.write_recall_csv(measure.recall_by_type(hit), measure.precision(samples.labels(spark), samples.labels(spark)), str(tmp_path / "r"))
    assert {r.value_recall for r in spark.read.option("header", True).csv(str(tmp_path / "r" / "by_type")).collect()} == {"1.00"}


def test_streaming(spark, tmp_path):
    spark.createDataFrame([(1, "SSN 536-90-4788\nx a@b.example")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = stream_entities(spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.entity_type, r.text) for r in spark.sql("select * from seen").collect()} == {("US_SSN", "536-90-4788"), ("EMAIL_ADDRESS", "a@b.example")}


def test_recognizer_from_outside(spark):
    def load():
        import re

        return lambda text: [("PERSON", m.start(), m.end(), 0.85) for m in re.finditer(r"\(?[A-Z]\w+ [A-Z]\w+,?", text)] + [("ORG", 0, 99, 0.9), ("ORG", 0, 3, 0.1)]

    rows = recognized(lines(spark, "By (Sarah Chen, a@b.example", "none 1").withColumn("offset", F.lit(0)), load)
    got = [(r.entity_type, r.text, r.start) for r in entities(with_entities(rows, select(["EMAIL_ADDRESS"]))).orderBy("start").collect()]
    assert got == [("PERSON", "Sarah Chen", 4), ("EMAIL_ADDRESS", "a@b.example", 16)]


def test_listed_terms_join_the_choice(spark):
    terms = spark.createDataFrame([("Rome",), ("a@b.example",)], "term string")
    rows = lines(spark, "In Rome a@b.example").withColumn("offset", F.lit(0))
    both = with_listed(rows, dictionary(rows, terms, "LOCATION"))
    got = [(r.entity_type, r.text) for r in entities(with_entities(both, select(["EMAIL_ADDRESS"]))).orderBy("start").collect()]
    assert got == [("LOCATION", "Rome"), ("EMAIL_ADDRESS", "a@b.example")]


def test_evaluate_per_document(spark):
    labels = spark.createDataFrame([("x", "EMAIL_ADDRESS", "a@b.example"), ("y", "EMAIL_ADDRESS", "a@b.example")], "doc_id string, entity_type string, value string")
    seen = spark.createDataFrame([("x", "EMAIL_ADDRESS", "a@b.example")], "doc_id string, entity_type string, text string")
    recall = lambda per: {r.entity_type: r.value_recall for r in measure.evaluate(seen, labels, per)[0].collect()}["ALL"]
    assert (recall(False), recall(True)) == (1.0, 0.5)


def test_measures_send_no_table_through_the_driver(spark):
    """Tables that Spark guesses small, such as these, are not broadcast: a value's runs are many."""
    rows = spark.range(20_000).selectExpr("id AS doc_id", "'ORG' AS entity_type", "concat('Firm of the House ', id) AS text")
    labels = rows.select("doc_id", "entity_type", F.expr("lower(text)").alias("value"))
    for recall, rate in (measure.evaluate(rows, labels, True), measure.evaluate(rows.limit(50), labels.limit(50))):
        assert {(r.entity_type, r.value_recall) for r in recall.collect()} == {("ORG", 1.0), ("ALL", 1.0)} and rate.first().precision == 1.0
        assert not any("BroadcastExchange" in df._jdf.queryExecution().toString() for df in (recall, rate))


def test_write_files(spark, tmp_path):
    """Files of one name keep their folders; one without content is not written."""
    schema = "path string, content binary"
    rows = spark.createDataFrame([("/in/a/x.docx", bytearray(b"one")), ("/in/b/x.docx", bytearray(b"two")), ("/in/b/y.pdf", None)], schema)
    got = {r.path: r.written for r in write_files(rows, f"file://{tmp_path}/out").collect()}
    assert got == {"/in/a/x.docx": f"file://{tmp_path}/out/a/x.docx", "/in/b/x.docx": f"file://{tmp_path}/out/b/x.docx", "/in/b/y.pdf": None}
    assert (tmp_path / "out/a/x.docx").read_bytes() == b"one" and (tmp_path / "out/b/x.docx").read_bytes() == b"two"
    assert len([f for f in (tmp_path / "out").rglob("*") if f.is_file()]) == 2
    assert write_files(rows.limit(0), f"file://{tmp_path}/none").count() == 0
    assert write_files(rows.limit(1), f"file://{tmp_path}/one").first().written == f"file://{tmp_path}/one/x.docx"


def test_matching_of_common_words(spark):
    """Values that share words: only those of which one holds the other are pairs."""
    rng = random.Random(4)
    some = lambda n: [" ".join(rng.choice(["john", "smith", "inc", "of", "the", "north", "x"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    left, right = some(120), some(120)
    as_rows = lambda vs: spark.createDataFrame([(v,) for v in vs], "value string")
    want = {(a, b) for a in left for b in right if a == b or (min(len(a), len(b)) >= 4 and (a in b or b in a))}
    assert {(r.l, r.r) for r in measure.matching(as_rows(left), as_rows(right)).collect()} == want

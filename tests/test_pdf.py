import base64
import zlib

import pytest

from docveil.functions.masks import COURT
from docveil.operators import runs
from docveil.pipeline import process_files
from docveil.sources import office, pdf

TEXT = b"BT /F1 11 Tf 72 720 Td (Caption \\(one\\)) Tj 0 -16 Td (Mail ) Tj [(sarah.chen) -10 (@example.com) 20 (. End)] TJ 0 -16 TD (SSN 536-90-4788 seen) Tj T* <53> Tj ET"
MORE = b"q 1 0 0 1 72 600 cm BT /F1 10 Tf 1 0 0 1 0 0 Tm (Sarah) Tj 40 0 Td (Chen, here) Tj ET Q"


def make_pdf(how="plain", contents=(TEXT, MORE)):
    def stream(data):
        if how == "plain":
            return b"<< /Length %d >>\nstream\n%s\nendstream" % (len(data), data)
        packed = zlib.compress(data)
        if how == "flate":
            return b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(packed), packed)
        packed = base64.a85encode(packed) + b"~>"
        return b"<< /Filter [/ASCII85Decode /FlateDecode] /Length %d >>\nstream\n%s\nendstream" % (len(packed), packed)

    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 4 0 R >> >> >>",
        b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents [%s] >>" % b" ".join(b"%d 0 R" % (6 + i) for i in range(len(contents))),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
        b"<< /Title (sarah.chen@example.com) >>",
        *map(stream, contents),
    ]
    body = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1))
    return body + b"trailer\n<< /Root 1 0 R /Info 5 0 R /Size %d >>\n%%%%EOF" % (len(objects) + 1)


LINES = ["Caption (one)", "Mail sarah.chen@example.com. End", "SSN 536-90-4788 seen", "S", "Sarah Chen, here"]


@pytest.mark.parametrize("how", ["plain", "flate", "ascii"])
def test_lines(how):
    assert pdf.pdf_lines(make_pdf(how)) == [("p1", t) for t in LINES]


@pytest.mark.parametrize("how", ["plain", "flate", "ascii"])
def test_redaction_removes_text(how):
    pairs = [("sarah.chen@example.com", "[EMAIL_1]"), ("536-90-4788", "XXX-XX-4788"), ("Sarah Chen", "[NAME_1]"), ("4788", "no")]
    new, n, missing = pdf.redact_pdf(make_pdf(how), [*pairs, ("Nobody", "[NAME_2]")])
    assert missing == ["4788", "Nobody"]
    text = "\n".join(t for _, t in pdf.pdf_lines(new)).replace(" .", ".")
    assert n == 3 and "[EMAIL_1]. End" in text and "SSN XXX-XX-4788 seen" in text and "[NAME_1]" in text and "here" in text
    raw = new + b"".join(pdf.File(new).stream(k) for k in pdf.File(new).streams)
    for gone in (b"chen", b"536", b"Sarah"):
        assert gone not in raw and gone.hex().encode() not in raw
    again, n, missing = pdf.redact_pdf(new, pairs[:3])
    assert n == 0 and missing == [v for v, _ in pairs[:3]] and pdf.pdf_lines(again) == pdf.pdf_lines(new)


def test_words_keep_their_places():
    before = {w[-1]: w[4:8] for w in pdf.pdf_words(make_pdf())}
    after = {w[-1]: w[4:8] for w in pdf.pdf_words(pdf.redact_pdf(make_pdf(), [("536-90-4788", "X")])[0])}
    assert all(abs(a - b) < 0.05 for a, b in zip(before["seen"], after["seen"], strict=True)) and "X" in after


def test_refuses():
    with pytest.raises(ValueError, match="not a PDF"):
        pdf.pdf_lines(b"hello")
    with pytest.raises(ValueError, match="encrypted"):
        pdf.pdf_lines(make_pdf().replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R"))
    assert pdf.pdf_lines(make_pdf(contents=())) == []


def test_fit_font_size():
    assert pdf.fit_font_size(2.0, 100, 20) == 11 and pdf.fit_font_size(20.0, 100, 20) == 5 and pdf.fit_font_size(90.0, 100, 20) == 4


def test_files(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(make_pdf("ascii"))
    done, files = process_files(spark, str(tmp_path / "a.PDF"), policy=COURT)
    assert [r.text for r in done.lines.orderBy("line_no").collect()] == LINES
    said = [t.replace(" .", ".") for _, t in pdf.pdf_lines(bytes(files.first().content))]
    assert said[1:3] == ["Mail [EMAIL_1]. End", "SSN XXX-XX-4788 seen"]
    report = files.select("n_found", "unlocated", "error").first()
    assert (report.n_found, report.unlocated, report.error) == (2, [], None)
    words = office.read_words(spark, str(tmp_path / "a.PDF"))
    values = words.selectExpr("doc_id", "'Sarah Chen' AS value").distinct()
    assert [(r.first_word, r.last_word) for r in runs.find_runs(words, values).collect()] == [(0, 1)]


def test_a_bad_file_is_reported(spark, tmp_path):
    """A broken and an encrypted file leave the others done; a value that is nowhere is named."""
    (tmp_path / "a.pdf").write_bytes(make_pdf())
    (tmp_path / "b.pdf").write_bytes(b"junk")
    (tmp_path / "c.pdf").write_bytes(make_pdf().replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R"))
    load = lambda: lambda text: [("PERSON", 0, 5, 0.9)] if text.startswith("Sarah") else [("ORG", 1, 4, 0.9)] if text.startswith("Caption") else []
    done, files = process_files(spark, str(tmp_path / "*.pdf"), load=load, entities=["EMAIL_ADDRESS"], overrides={"EMAIL_ADDRESS": "MAIL"})
    got = {r.path.rsplit("/", 1)[1]: r for r in files.collect()}
    assert got["b.pdf"].content is None and "not a PDF" in got["b.pdf"].error and got["c.pdf"].content is None and "encrypted" in got["c.pdf"].error
    text = "\n".join(t for _, t in pdf.pdf_lines(bytes(got["a.pdf"].content)))
    assert got["a.pdf"].error is None and "[MAIL_1]" in text and "[NAME_1]" in text and "536-90-4788" in text
    assert (got["a.pdf"].n_found, got["a.pdf"].unlocated) == (2, ["apt"])
    assert {r.doc_id.rsplit("/", 1)[1] for r in done.lines.collect()} == {"a.pdf"}

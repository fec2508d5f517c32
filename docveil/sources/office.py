"""Word, Excel and PDF files as lines, and rewritten with new text, by the standard library."""

from __future__ import annotations

import io
import os
import zipfile
from xml.etree import ElementTree as X

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docveil.sources.pdf import pdf_lines, pdf_words, redact_pdf

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SUPPORTED = (".pdf", ".docx", ".xlsx")
SCHEMA = "doc_id string, line_no int, text string, source string"


def _said(p: X.Element) -> str:
    """A paragraph's text: runs, also within hyperlinks, with tabs and breaks."""
    out = []
    for e in p.iter():
        if e.tag == W + "t":
            out.append(e.text or "")
        elif e.tag == W + "tab":
            out.append("\t")
        elif e.tag in (W + "br", W + "cr"):
            out.append("\n")
    return "".join(out)


def _places(body: X.Element):
    """(source, paragraphs) of the body's paragraphs and table cells in document order."""
    paragraph = table = 0
    for e in body:
        if e.tag == W + "p":
            yield f"para{paragraph}", [e]
            paragraph += 1
        elif e.tag == W + "tbl":
            for r, row in enumerate(e.findall(W + "tr")):
                for c, cell in enumerate(row.findall(W + "tc")):
                    yield f"table{table}:r{r}c{c}", cell.findall(W + "p")
            table += 1


def _part(data: bytes, name: str) -> X.Element:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return X.fromstring(z.read(name))


def docx_lines(data: bytes) -> list[tuple[str, str]]:
    """(source, text) of a Word file's paragraphs and cells that are not blank."""
    body = _part(data, "word/document.xml").find(W + "body")
    said = ((source, "\n".join(_said(p) for p in ps).strip()) for source, ps in _places(body))
    return [(source, text) for source, text in said if text]


def _sheets(z: zipfile.ZipFile):
    """(sheet name, part name) of a workbook."""
    rels = {e.get("Id"): e.get("Target") for e in X.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for e in X.fromstring(z.read("xl/workbook.xml")).iter(S + "sheet"):
        target = rels[e.get(R + "id")]
        yield e.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return ["".join(t.text or "" for t in e.iter(S + "t")) for e in X.fromstring(z.read("xl/sharedStrings.xml")).findall(S + "si")]


def _value(cell: X.Element, strings: list[str]) -> str:
    kind, v = cell.get("t"), cell.find(S + "v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(S + "t"))
    if v is None or v.text is None:
        return ""
    if kind == "s":
        return strings[int(v.text)]
    if kind == "b":
        return "True" if v.text == "1" else "False"
    return v.text


def xlsx_lines(data: bytes) -> list[tuple[str, str]]:
    """(source, text) of a workbook's cells that are not empty, sheet by sheet and row by row."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        strings = _strings(z)
        for sheet, part in _sheets(z):
            for cell in X.fromstring(z.read(part)).iter(S + "c"):
                if text := _value(cell, strings).strip():
                    out.append((f"{sheet}!{cell.get('r')}", text))
    return out


def _rezip(data: bytes, changed: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as o:
        for item in z.infolist():
            o.writestr(item, changed.get(item.filename, z.read(item.filename)))
    return out.getvalue()


def rewrite_docx(data: bytes, texts: dict[str, str]) -> bytes:
    """The file with the paragraphs and cells whose text changed rewritten.

    A changed paragraph keeps its style and gets one run; a changed cell keeps its first
    paragraph. Everything else in such a paragraph, hyperlinks too, goes, so that no original
    text stays behind.
    """
    root = _part(data, "word/document.xml")
    for source, ps in _places(root.find(W + "body")):
        old = "\n".join(_said(p) for p in ps).strip()
        if source not in texts or texts[source] == old or not ps:
            continue
        for k, p in enumerate(ps):
            for e in list(p):
                if e.tag != W + "pPr":
                    p.remove(e)
            if k == 0:
                run = X.SubElement(p, W + "r")
                for n, line in enumerate(texts[source].split("\n")):
                    if n:
                        X.SubElement(run, W + "br")
                    t = X.SubElement(run, W + "t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"})
                    t.text = line
    return _rezip(data, {"word/document.xml": X.tostring(root, encoding="UTF-8", xml_declaration=True)})


def rewrite_xlsx(data: bytes, texts: dict[str, str]) -> bytes:
    """The workbook with changed cells as text; others keep their numbers, dates and formulas.

    Shared strings that only rewritten cells used are blanked.
    """
    changed, used = {}, set()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        strings = _strings(z)
        for sheet, part in _sheets(z):
            root = X.fromstring(z.read(part))
            for cell in root.iter(S + "c"):
                old, new = _value(cell, strings).strip(), texts.get(f"{sheet}!{cell.get('r')}")
                if new is None or new == old:
                    if cell.get("t") == "s":
                        used.add(int(cell.find(S + "v").text))
                    continue
                for e in list(cell):
                    cell.remove(e)
                cell.set("t", "inlineStr")
                t = X.SubElement(X.SubElement(cell, S + "is"), S + "t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"})
                t.text = new
            changed[part] = X.tostring(root, encoding="UTF-8", xml_declaration=True)
        if strings:
            root = X.fromstring(z.read("xl/sharedStrings.xml"))
            for i, e in enumerate(root.findall(S + "si")):
                if i not in used:
                    for c in list(e):
                        e.remove(c)
                    X.SubElement(e, S + "t").text = ""
            changed["xl/sharedStrings.xml"] = X.tostring(root, encoding="UTF-8", xml_declaration=True)
    return _rezip(data, changed)


READ = {".pdf": pdf_lines, ".docx": docx_lines, ".xlsx": xlsx_lines}
REWRITE = {".docx": rewrite_docx, ".xlsx": rewrite_xlsx}
WORDS = "doc_id string, page int, block int, line int, word_no int, x0 double, y0 double, x1 double, y1 double, text string"


def kind_of(path: str) -> str:
    """The lower-cased extension; ValueError if it isn't supported."""
    kind = os.path.splitext(path)[1].lower()
    if kind not in SUPPORTED:
        raise ValueError(f"unsupported file type {kind or path!r}; supported: {', '.join(SUPPORTED)}")
    return kind


def read_files(spark: SparkSession, *paths: str, errors: bool = False) -> DataFrame:
    """Lines (doc_id, line_no, text, source) of files, a task's row each; doc_id is the path.

    An unsupported extension is a ValueError before anything is looked for; a missing file fails
    as Spark's readers do, on its path. A file that can't be read fails the job, or with
    ``errors`` has a row of its own with the reason in a column ``error``, null in other rows.
    """
    for p in paths:
        kind_of(p)

    def rows_of(path: str, content: bytes) -> pd.DataFrame:
        rows = READ[kind_of(path)](content)
        return pd.DataFrame({"doc_id": path, "line_no": range(len(rows)), "text": [t for _, t in rows], "source": [s for s, _ in rows]})

    def run(it):
        for b in it:
            for path, content in zip(b["path"], b["content"], strict=True):
                if not errors:
                    yield rows_of(path, bytes(content))
                    continue
                try:
                    yield rows_of(path, bytes(content)).assign(error=None)
                except Exception as e:  # noqa: BLE001
                    yield pd.DataFrame({"doc_id": [path], "line_no": [None], "text": [None], "source": [None], "error": [f"{type(e).__name__}: {e}"]})

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInPandas(run, SCHEMA + ", error string" * errors)


def read_words(spark: SparkSession, *paths: str) -> DataFrame:
    """The words of PDF files with their places, for ``operators.runs.find_runs``."""

    def run(it):
        for b in it:
            for path, content in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame([(path, *w) for w in pdf_words(bytes(content))], columns=[c.split()[0] for c in WORDS.split(", ")])

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInPandas(run, WORDS)


def rewritten_files(files: DataFrame, lines: DataFrame, pairs: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    """(path, content, n_found, unlocated, error): ``files`` (path, content) rewritten.

    Word and Excel files get the text of ``lines`` (doc_id, source, text), PDF files have the
    values of ``pairs`` (doc_id, original_value, token, first_start) replaced. ``n_found`` counts
    the places in a PDF file, or the paragraphs and cells given; ``unlocated`` has the values that
    are nowhere in a PDF file's words. Files that are ``bad`` (doc_id, error) or can't be
    rewritten have no content, and an error.
    """
    texts = lines.where(~F.lower("doc_id").endswith(".pdf")).groupBy(F.col("doc_id").alias("path")).agg(F.map_from_entries(F.collect_list(F.struct("source", "text"))).alias("texts"))
    pair = F.struct("first_start", "original_value", "token")
    found = pairs.groupBy(F.col("doc_id").alias("path")).agg(F.array_sort(F.collect_list(pair)).alias("pairs"))

    def rewrite(path: str, content: bytes, texts, pairs, error) -> tuple[bytes | None, int, list[str], str | None]:
        if error is not None:
            return None, 0, [], error
        try:
            if kind_of(path) == ".pdf":
                return *redact_pdf(content, [(p["original_value"], p["token"]) for p in pairs] if pairs is not None else []), None
            changed = dict(texts) if texts is not None else {}
            return REWRITE[kind_of(path)](content, changed), len(changed), [], None
        except Exception as e:  # noqa: BLE001
            return None, 0, [], f"{type(e).__name__}: {e}"

    def run(it):
        for b in it:
            rows = [rewrite(p, bytes(c), t, v, e) for p, c, t, v, e in zip(b["path"], b["content"], b["texts"], b["pairs"], b["error"], strict=True)]
            yield pd.DataFrame([(p, *r) for p, r in zip(b["path"], rows, strict=True)], columns=["path", "content", "n_found", "unlocated", "error"])

    both = files.join(texts, "path", "left").join(found, "path", "left")
    if bad is None:
        both = both.withColumn("error", F.lit(None).cast("string"))
    else:
        both = both.join(bad.select(F.col("doc_id").alias("path"), "error").distinct(), "path", "left")
    return both.select("path", "content", "texts", "pairs", "error").mapInPandas(run, "path string, content binary, n_found long, unlocated array<string>, error string")

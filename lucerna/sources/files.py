"""File sources: content checks as column predicates, parsers for each format.

files: path STRING, content BINARY (what Spark's binaryFile gives). Text and HTML are columns, and
so is the layout of CSV rows; reading CSV cells, HTML entities, JSON layout and DOCX go through Arrow UDFs over a row's own content. PDF and OCR need engines that
a caller registers.
"""

from __future__ import annotations

import csv
import html
import io
import json
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as n
from ..functions.text import strip

# First bytes by extension, and how far a format may expand.
MAGIC = {
    ".pdf": [b"%PDF"], ".docx": [b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08"], ".zip": [b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08"],
    ".png": [b"\x89PNG\r\n\x1a\n"], ".jpg": [b"\xff\xd8\xff"], ".jpeg": [b"\xff\xd8\xff"], ".gif": [b"GIF87a", b"GIF89a"], ".bmp": [b"BM"],
    ".tiff": [b"II*\x00", b"MM\x00*"],
}
MAX_RATIO = {".pdf": 50, ".docx": 100, ".zip": 100, ".png": 10, ".jpg": 10, ".jpeg": 10, ".gif": 10, ".bmp": 2, ".tiff": 10}
DEFAULT_RATIO, MAX_DECOMPRESSED, MAX_PDF_PAGES, MAX_UPLOAD = 100, 256 << 20, 500, 20 << 20
TEXT_EXTENSIONS, ALLOWED = [".txt", ".md"], [".txt", ".md", ".csv", ".json", ".html", ".htm", ".docx", ".pdf"]
# The test string of malware scanners, in two parts so that scanners leave this file alone.
TEST_STRING = "X5O!P%@AP[4\\PZX54(P^)7CC)7}$" + "EICAR-STANDARD-ANTIVIRUS-TEST-FILE!$H+H*"

Parser = Callable[[bytes], str]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """SRC-17."""
    schema = "id string, query string, query_class string, gold_evidence array<struct<document string, snippet string>>, gold_answer_keywords array<string>, expected_outcome string, notes string"
    return spark.read.schema(schema).json(path)


def extension(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(name.contains("."), F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1)))).otherwise("")


def magic_ok(ext: Column, content: Column) -> Column:
    """SRC-10: whether the first bytes fit; extensions without a signature pass."""
    out = F.lit(True)
    for name, marks in MAGIC.items():
        hit = F.lit(False)
        for mark in marks:
            hit = hit | (F.substring(content, 1, len(mark)) == F.lit(mark))
        out = F.when(ext == name, hit).otherwise(out)
    return out


def bomb(ext: Column, compressed: Column, decompressed: Column) -> Column:
    """SRC-11: whether the size beyond all bounds or the ratio beyond the format's rules a file out."""
    table = F.create_map(*[F.lit(x) for pair in MAX_RATIO.items() for x in pair])
    ratio = F.coalesce(F.try_element_at(table, ext), F.lit(DEFAULT_RATIO))
    return (decompressed > MAX_DECOMPRESSED) | ((compressed > 0) & (decompressed / F.nullif(compressed, F.lit(0)) > ratio))


def has_test_string(content: Column) -> Column:
    """SRC-12."""
    return F.contains(content, F.lit(TEST_STRING.encode()))


def decoded(content: Column) -> Column:
    """SRC-09: UTF-8 where it is valid, else Latin-1, of which any byte is part."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def plain_text(content: Column) -> Column:
    """SRC-02."""
    return strip(decoded(content))


def csv_cells(text: Column) -> Column:
    """Struct of cells (array of a row's values, an entry a row) and error of a CSV's text."""

    @F.pandas_udf("struct<cells:array<array<string>>,error:string>")
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_tried(lambda t: list(csv.reader(io.StringIO(t))), t or "") for t in texts], columns=["cells", "error"])

    return read(text)


def _said(row: Column, names: Column, bare: Callable[[Column], Column]) -> Column:
    """A row's values behind their names; columns without one count from 1."""
    name = lambda i: F.coalesce(F.get(names, i), F.concat(F.lit("Col"), (i + 1).cast("string")))
    return F.array_join(F.transform(row, lambda v, i: F.concat(name(i), F.lit(": "), bare(F.coalesce(v, F.lit(""))))), " | ")


def _holds_values(row: Column, bare: Callable[[Column], Column]) -> Column:
    return F.exists(row, lambda v: bare(F.coalesce(v, F.lit(""))) != "")


def csv_document(cells: Column) -> Column:
    """SRC-03: the text of a whole CSV, from a column of its table (csv_cells itself can't stand inside). No rows: empty; a header alone: its names; rows without values are left out."""
    names = F.transform(F.get(cells, F.lit(0)), strip)
    body = F.filter(F.slice(cells, F.lit(2), F.size(cells)), lambda row: _holds_values(row, strip))
    lines = F.transform(body, lambda row: _said(row, names, strip))
    return strip(F.when(cells.isNull(), None).when(F.size(cells) < 1, "").when(F.size(lines) < 1, F.array_join(names, " | ")).otherwise(F.array_join(lines, "\n")))


def csv_lines(rows: DataFrame, header: list[str]) -> DataFrame:
    """SRC-03 at scale: rows (array `values`, `position`) of a CSV that Spark reads, as text lines."""
    names = F.array(*[F.lit(h.strip()) for h in header])
    full = rows.where(_holds_values(F.col("values"), F.trim))
    return full.select("position", _said(F.col("values"), names, F.trim).alias("line"))


def json_text(content: bytes | None) -> str:
    """SRC-04: indented by two, characters as they are."""
    text = _text(content)
    return json.dumps(json.loads(text), indent=2, ensure_ascii=False).strip() if text.strip() else ""


def html_columns(page: Column, entities: bool = False) -> Column:
    """SRC-05: hidden parts out, a line break for each block's start, then text nodes with one space between.

    A hidden part without an end runs to the page's end; a less-than sign that no letter follows is text. All in the JVM,
    but for entities: these need `entities`, which sends what holds an ampersand through a small Arrow UDF. A null page is null.
    """
    seen = F.regexp_replace(page, r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)", "\u0001")
    seen = F.regexp_replace(seen, r"(?s)<!--.*?-->|<![^>]*>|<\?[^>]*>", "\u0001")
    seen = F.regexp_replace(seen, r"(?i)<(?:p|br|div|h1|h2|h3|h4|li|tr)(?=[\s/>])[^>]*>", "\u0001\u0002\u0001")
    seen = F.regexp_replace(seen, r"</?[A-Za-z][^>]*>", "\u0001")
    if entities:

        @F.pandas_udf("string")
        def decode(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: html.unescape(t) if t and "&" in t else t)

        seen = decode(seen)
    bare = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    nodes = F.filter(F.transform(F.split(seen, "\u0001"), bare if entities else strip), lambda x: x != "")
    return strip(F.regexp_replace(F.replace(F.array_join(nodes, " "), F.lit("\u0002"), F.lit("\n")), r"\n\s*\n+", "\n\n"))


def docx_text(content: bytes | None) -> str:
    """SRC-06: the paragraphs' runs of text; entity declarations are refused."""
    if not content:
        return ""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        info = archive.getinfo("word/document.xml")
        if info.file_size > MAX_DECOMPRESSED:
            raise ValueError("document.xml exceeds the bound on decompressed size")
        xml = archive.read(info)
    if b"<!DOCTYPE" in xml or b"<!ENTITY" in xml:
        raise ValueError("document types and entities are not accepted")
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    said = ["".join(t.text for t in p.iter(space + "t") if t.text) for p in ElementTree.fromstring(xml).iter(space + "p")]
    return "\n\n".join(x for x in said if x).strip()


def _text(content: bytes | None) -> str:
    try:
        return (content or b"").decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def _tried(parse: Callable, value) -> tuple:
    """(result, None), or (None, what went wrong): a broken file is a row's result, not the job's end."""
    try:
        return parse(value), None
    except Exception as error:
        return None, str(error) or type(error).__name__


def _missing(name: str) -> Parser:
    def parse(content: bytes) -> str:
        raise NotImplementedError(f"no {name} engine is registered; see register_parser")

    return parse


PARSERS: dict[str, Parser] = {".json": json_text, ".docx": docx_text, ".pdf": _missing("PDF")}


def register_parser(ext: str, parser: Parser) -> None:
    """SRC-07: a parser for an extension; page texts of a PDF are to be joined by form feeds."""
    PARSERS[ext] = parser


def parse_files(files: DataFrame) -> DataFrame:
    """SRC-01: path, ext, status, page, text, effective_from and effective_until for each page of each file.

    Scan, signature, parser, dates, in that order; what fails a check has its reason as status and no text.
    """

    @F.pandas_udf("struct<text:string,error:string>")
    def parse(ext: pd.Series, content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_tried(PARSERS[e], c) for e, c in zip(ext, content, strict=True)], columns=["text", "error"])

    rows = files.withColumn("ext", extension(F.col("path")))
    status = (
        F.when(~F.col("ext").isin(ALLOWED), "unsupported").when(F.length("content") > MAX_UPLOAD, "too_large")
        .when(has_test_string(F.col("content")), "malware").when(~magic_ok(F.col("ext"), F.col("content")), "bad_signature").otherwise("ok")
    )
    rows = rows.withColumn("status", status)
    good = rows.where("status = 'ok'")
    own = list(PARSERS)
    plain, table, page = (F.col("ext").isin(x) & ~F.col("ext").isin(own) for x in (TEXT_EXTENSIONS, [".csv"], [".html", ".htm"]))
    said = decoded(F.col("content"))
    column = lambda which, text: good.where(which).select("path", "ext", "status", text.alias("text"))
    outcome = lambda error: F.when(error.isNull(), "ok").otherwise(F.concat(F.lit("failed: "), error)).alias("status")
    tables = good.where(table).withColumn("_p", csv_cells(said)).select("path", "ext", outcome(F.col("_p.error")), csv_document(F.col("_p.cells")).alias("text"))
    other = good.where(F.col("ext").isin(own)).withColumn("_p", parse("ext", "content")).select("path", "ext", outcome(F.col("_p.error")), F.col("_p.text").alias("text"))
    text = column(plain, strip(said)).unionByName(column(page, html_columns(said, entities=True))).unionByName(tables)
    refused = rows.where("status <> 'ok'").select("path", "ext", "status", F.lit(None).cast("string").alias("text"))
    whole = text.unionByName(other).unionByName(refused)
    dated = whole.select("*", n.effective_date(F.col("text"), "from").alias("effective_from"), n.effective_date(F.col("text"), "until").alias("effective_until"))
    return dated.select(
        "path", "ext", "status", F.posexplode_outer(F.slice(F.split("text", "\f"), 1, MAX_PDF_PAGES)).alias("_at", "text"), "effective_from", "effective_until"
    ).withColumn("page", F.col("_at") + 1).drop("_at")


def upload(files: DataFrame, kb_id: str, user_id: str) -> DataFrame:
    """SRC-13: accepted files as document rows with their content's hash."""
    ext = extension(F.col("path"))
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"[^\w.\- ]", "_")
    good = files.where(ext.isin(ALLOWED) & (F.length("content") <= MAX_UPLOAD) & (F.length("content") > 0))
    return good.select(
        F.lit(kb_id).alias("kb_id"), F.lit(user_id).alias("user_id"), name.alias("filename"), F.sha2("content", 256).alias("content_hash"),
        F.length("content").cast("long").alias("file_size"),
    )


def needs_ocr(native: Column, least: int = 50) -> Column:
    """SRC-08's gate."""
    return F.length(strip(F.coalesce(native, F.lit("")))) < least


def ocr_result(lines: Column, least: float = 0.5) -> Column:
    """SRC-08: struct of text, confidence and ocr_used of recognised lines (array of text, confidence).

    Mean confidence of the lines; without it, or below `least`, the text is dropped.
    """
    known = F.filter(lines, lambda x: x["confidence"].isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x["confidence"]) / F.size(known))
    text = F.when(mean >= least, F.array_join(F.transform(lines, lambda x: x["text"]), "\n")).otherwise("")
    return F.struct(text.alias("text"), mean.alias("confidence"), F.lit(True).alias("ocr_used"))

"""From bytes to text: format dispatch and sniffing in SQL, parsers of the standard library in Arrow batches, and the envelope.

Formats whose parsers need other libraries (PDF, old Excel, OCR) go through ``PROVIDERS``, empty by default.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.functions.text import normalize_space

MOST_BYTES, MOST_CHARS, OCR_BELOW = 15_000_000, 120_000, 400
#: Other parsers by method: bytes to text or None.
PROVIDERS: dict[str, Callable[[bytes], str | None]] = {}


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def method(content_type, name, content) -> Column:
    """The parser's name, by content type or file name; what claims to be PDF but starts as HTML is HTML."""
    kind, file = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in (content_type, name))
    ends = lambda *e: file.rlike(r"\.(?:" + "|".join(e) + r")$")
    start = F.lower(F.decode(F.substring(F.col(content), 1, 2048), "iso-8859-1"))
    is_html = F.contains(start, F.lit("<html")) | F.contains(start, F.lit("<!doctype html"))
    is_pdf = start.rlike(r"^\s*%pdf-")
    return (
        F.when(F.contains(kind, F.lit("html")) | ends("html", "htm"), "html")
        .when(F.contains(kind, F.lit("pdf")) | ends("pdf"), F.when(is_pdf, "pdf").when(is_html, "html").otherwise("invalid_pdf"))
        .when(F.contains(kind, F.lit("wordprocessingml")) | ends("docx"), "docx")
        .when(F.contains(kind, F.lit("csv")) | ends("csv", "tsv"), "csv")
        .when(F.contains(kind, F.lit("spreadsheetml")) | F.contains(kind, F.lit("ms-excel")) | ends("xlsx", "xls"), "xlsx")
        .when(F.contains(kind, F.lit("rtf")) | ends("rtf"), "rtf")
        .when(ends("doc"), "unsupported_file_type")
        .when(kind.startswith("text/") | ends("txt", "md"), "text")
        .when(kind.startswith("image/") | ends("png", "jpg", "jpeg", "tif", "tiff"), "image")
        .otherwise("text")
    )


class _Text(HTMLParser):
    def __init__(self, breaks: bool):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.breaks = [], 0, breaks

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "template")
        if tag == "br" and self.breaks:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "template") and self.skip > 0

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.out.append(data)


def html_text(page: str) -> str:
    """All text but scripts, styles and templates, parts trimmed and joined by one blank."""
    p = _Text(False)
    p.feed(page)
    p.close()
    return " ".join(x.strip() for x in p.out if x.strip())


def html_lines(page: str) -> str:
    """The same with a line a part, a line break at each br, and no blank lines."""
    p = _Text(True)
    p.feed(page)
    p.close()
    return "\n".join(x.strip() for x in "\n".join(p.out).split("\n") if x.strip())


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_text(data: bytes) -> str:
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    lines = [said(p) for p in body.findall(f"{_W}p")]
    lines += [" | ".join(said(c) for c in r.findall(f"{_W}tc")) for t in body.findall(f"{_W}tbl") for r in t.findall(f"{_W}tr")]
    return "\n".join(x for x in lines if x.strip())


def xlsx_text(data: bytes) -> str:
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = [("".join(t.text or "" for t in s.iter(f"{_S}t"))) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
    out = []
    for i, name in enumerate(names, 1):
        rows = []
        for r in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{_S}row"):
            cells = [(shared[int(c.findtext(f"{_S}v") or 0)] if c.get("t") == "s" else c.findtext(f"{_S}v") or "".join(t.text or "" for t in c.iter(f"{_S}t"))) for c in r.iter(f"{_S}c")]
            if any(cells):
                rows.append(" | ".join(cells))
        out += ([f"--- {name} ---"] if len(names) > 1 else []) + rows
    return "\n".join(out)


def csv_text(data: bytes) -> str:
    text = data.decode("utf-8", "replace").replace("\x00", "")
    try:
        dialect = csv.Sniffer().sniff(text[:8192], ",\t;|")
    except csv.Error:
        dialect = csv.excel
    return "\n".join(" | ".join(c.strip() for c in r) for r in csv.reader(io.StringIO(text), dialect) if any(c.strip() for c in r))


_RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\u(-?[0-9]+) ?|\\([a-zA-Z]+)(-?[0-9]+)? ?|\\(.)|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.S)
#: Groups of an RTF file that hold no text of the document.
_RTF_UNSEEN = frozenset("fonttbl colortbl stylesheet info pict header footer generator themedata listtable listoverridetable".split())


def rtf_text(data: str) -> str:
    """The text of an RTF file: a line a paragraph; groups of fonts, styles, pictures and the like have none."""
    out, unseen, stack, skip = [], False, [], 0
    for m in _RTF.finditer(data):
        code, letter, word, _, mark, brace, said = m.groups()
        if brace == "{":
            stack.append(unseen)
        elif brace == "}":
            unseen = stack.pop() if stack else False
        elif word in _RTF_UNSEEN or mark == "*":
            unseen = True
        elif unseen:
            continue
        elif letter:
            out.append(chr(int(letter) % 65536))
            skip = 1  # what old readers show instead
        elif word in ("par", "line", "row"):
            out.append("\n")
        elif word in ("tab", "cell"):
            out.append("\t")
        elif code:
            out.append("" if skip else bytes.fromhex(code).decode("cp1252", "replace"))
            skip = 0
        elif mark and mark in "\\~{}":
            out.append({"~": " "}.get(mark, mark))
        elif said:
            out.append(said[skip:])
            skip = 0
    return "\n".join(x.strip() for x in "".join(out).split("\n") if x.strip())


def parse(kind: str, data: bytes | None) -> str | None:
    data = data or b""
    if kind in PROVIDERS:
        return PROVIDERS[kind](data)
    try:
        if kind == "html":
            return html_text(data.decode("utf-8", "replace"))
        if kind in ("docx", "xlsx", "csv"):
            return {"docx": docx_text, "xlsx": xlsx_text, "csv": csv_text}[kind](data)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError):
        return None
    if kind == "rtf" and data.lstrip().startswith(b"{\\rtf"):
        return rtf_text(data.decode("latin-1"))
    return data.decode("utf-8", "replace").strip() if kind in ("text", "rtf") else None


def parsed(kind, data) -> Column:
    @F.pandas_udf("string")
    def run(k: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([parse(x, y) for x, y in zip(k, d, strict=True)])

    return run(kind, data)


def lines(page) -> Column:
    @F.pandas_udf("string")
    def run(p: pd.Series) -> pd.Series:
        return p.map(lambda x: None if x is None else html_lines(x))

    return run(page)


def envelope(rows: DataFrame, most_bytes: int = MOST_BYTES, most_chars: int = MOST_CHARS, strict: bool = False) -> DataFrame:
    """Adds status, error_code, text, sha256, warnings to rows with ``method``, ``size`` and ``raw`` text."""
    whole = normalize_space(F.coalesce("raw", F.lit("")), drop_nul=True)
    rows = rows.withColumn("whole", whole)
    large, empty = F.col("size") > most_bytes, F.col("whole") == ""
    kept = F.when(~large & ~empty, F.left("whole", F.lit(most_chars)))
    code = F.when(large, "payload_too_large").when(F.col("method").isin("unsupported_file_type", "invalid_pdf"), F.col("method")).when(empty & F.lit(strict), "empty_text")
    needs = F.when((F.length("whole") < OCR_BELOW) & F.col("method").isin("pdf", "image"), F.array(F.lit("ocr_needed"))).otherwise(F.array().cast("array<string>"))
    cut = F.when(F.length("whole") > most_chars, F.array(F.lit("text_truncated"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({"text": kept, "error_code": code}).withColumns({"status": F.when(F.col("error_code").isNull(), "ok").otherwise("error"), "sha256": F.sha2("text", 256), "warnings": F.concat(needs, cut)}).drop("whole", "raw")


def extract(rows: DataFrame, **limits) -> DataFrame:
    """``rows``: content_type, name, content."""
    found = rows.withColumn("method", method("content_type", "name", "content")).withColumn("size", F.length("content"))
    return envelope(found.withColumn("raw", F.when(F.col("size") <= limits.get("most_bytes", MOST_BYTES), parsed("method", "content"))).drop("content"), **limits)


def harvest(c, keys: tuple[str, ...] = ("text", "content", "result", "ocr_text", "extracted_text")) -> Column:
    """The text in a provider's JSON answer: named keys first, then any other value; lists by line."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        import json

        def walk(v) -> str:
            if isinstance(v, str):
                return v.strip()
            if isinstance(v, list):
                return "\n".join(t for t in map(walk, v) if t)
            if isinstance(v, dict):
                return next((t for k in (*[k for k in keys if k in v], *[k for k in v if k not in keys]) if (t := walk(v[k]))), "")
            return ""

        def one(t):
            try:
                return walk(json.loads(t)) if t else ""
            except ValueError:
                return ""

        return x.map(one)

    return run(c)


def allowed_url(c, hosts: tuple[str, ...]) -> Column:
    """https, and a host that is one of ``hosts`` or below one; addresses in private ranges never."""
    x = F.col(c)
    host = F.lower(F.try_parse_url(x, F.lit("HOST")))
    inside = host.rlike(r"^(?:localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|0\.|22[4-9]\.|23[0-9]\.|\[)")
    among = host.rlike(r"(?:^|\.)(?:" + "|".join(re.escape(h) for h in hosts) + ")$")
    return F.coalesce((F.try_parse_url(x, F.lit("PROTOCOL")) == "https") & among & ~inside, F.lit(False))

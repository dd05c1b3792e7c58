"""Text of PDF, DOCX, EPUB and legacy DOC files, sizes of images: whole files in Arrow batches, no outside library."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pages of a PDF that are looked at, spread evenly, to tell whether it needs reading from its images; and the letters a page then has.
SAMPLE_PAGES, LEAST_LETTERS = 12, 20
_TAG, _BLOCK = re.compile(r"<[^>]+>"), re.compile(r"</(?:w:p|p|div|h[1-6]|li|tr)>|<br ?/?>|<w:br ?/?>", re.I)
_SKIPPED = re.compile(r"<(script|style)\b.*?</\1>", re.I | re.S)
_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]+>|\bT(?:\*|[jJdD]\b)|'|\"|\bET\b", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def markup_text(data: str) -> str:
    """Text of XML or HTML: blocks end lines, scripts and styles are left out."""
    t = _TAG.sub("", _BLOCK.sub("\n", _SKIPPED.sub("", data)))
    return "\n".join(x for line in unescape(t).split("\n") if (x := " ".join(line.split())))


def docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return markup_text(z.read("word/document.xml").decode("utf-8", "replace"))


def epub_text(data: bytes) -> str:
    """Chapters in the order of the package's spine, else of their names."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm"))]
        package = next((n for n in z.namelist() if n.endswith(".opf")), None)
        if package:
            opf, base = z.read(package).decode("utf-8", "replace"), package.rpartition("/")[0]
            hrefs = {m[2]: m[1] for m in re.finditer(r"<item\b[^>]*?href=\"([^\"]+)\"[^>]*?id=\"([^\"]+)\"", opf)} | {m[1]: m[2] for m in re.finditer(r"<item\b[^>]*?id=\"([^\"]+)\"[^>]*?href=\"([^\"]+)\"", opf)}
            spine = [f"{base}/{hrefs[i]}".lstrip("/") for i in re.findall(r"<itemref\b[^>]*idref=\"([^\"]+)\"", opf) if i in hrefs]
            names = [n for n in spine if n in names] or sorted(names)
        return "\n".join(markup_text(z.read(n).decode("utf-8", "replace")) for n in names)


def doc_text(data: bytes) -> str:
    """Runs of readable characters of a legacy DOC, in two-byte or one-byte letters."""
    wide = [m.decode("utf-16-le") for m in re.findall(rb"(?:[\x20-\x7e\xa0-\xff\r\t]\x00){8,}", data)]
    return "\n".join(wide or [m.decode("cp1252", "replace") for m in re.findall(rb"[\x20-\x7e\xa0-\xff\r\t]{16,}", data)]).replace("\r", "\n")


def _pdf_string(raw: bytes) -> str:
    if raw[:1] == b"<":
        data = bytes.fromhex(re.sub(rb"\s", b"", raw[1:-1]).decode() + ("0" if len(re.sub(rb"\s", b"", raw[1:-1])) % 2 else ""))
    else:
        data = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1][-1:] == b"\n" else _ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")


def pdf_pages(data: bytes) -> list[str]:
    """What the content streams show, in their order; one stream is taken for a page. Encrypted files show nothing."""
    pages = []
    for head, body in _STREAM.findall(data) if b"/Encrypt" not in data else []:
        if b"/Image" in head or b"/FontFile" in head or b"/XRef" in head:
            continue
        if b"/FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        if b"BT" in body:
            out: list[str] = []
            for m in _SHOWN.findall(body):
                out.append(_pdf_string(m) if m[:1] in b"(<" else "\n" if m in (b"T*", b"'", b'"', b"Td", b"TD", b"ET") else "")
            pages.append("\n".join(x for line in "".join(out).split("\n") if (x := line.strip())))
    return pages


def sampled(pages: list[str], most: int = SAMPLE_PAGES) -> list[str]:
    """Pages spread evenly over all, `most` at most: the look at a file that tells whether it has text at all."""
    return pages if len(pages) <= most else [pages[k * len(pages) // most] for k in range(most)]


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG, GIF, JPEG or BMP."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", data[16:24])
    if data[:3] == b"GIF":
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM":
        return struct.unpack("<ii", data[18:26])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                return struct.unpack(">HH", data[at + 5 : at + 9])[::-1]
            at += 2 + size
    return None


def extracted(name: str, data: bytes) -> tuple[str, str | None, int | None, str | None]:
    """status, text, pages and detail of a file: OK, NEEDS_OCR, IMAGE, UNSUPPORTED or BROKEN."""
    ext = name.rpartition(".")[2].lower()
    try:
        if ext == "pdf":
            whole = data.count(b"/Type /Page") + data.count(b"/Type/Page") - data.count(b"/Type /Pages") - data.count(b"/Type/Pages")
            pages = pdf_pages(data)
            few = sampled(pages)
            if sum(sum(map(str.isalpha, p)) for p in few) < LEAST_LETTERS * max(1, len(few)):
                return "NEEDS_OCR", None, whole, None
            return "OK", "\n".join(pages), whole, None
        if ext in ("docx", "epub", "doc"):
            return "OK", {"docx": docx_text, "epub": epub_text, "doc": doc_text}[ext](data), None, None
        if (size := image_size(data)) is not None:
            return "IMAGE", None, None, f"{size[0]}x{size[1]}"
        if ext in ("html", "htm", "xml", "xhtml"):
            return "OK", markup_text(data.decode("utf-8", "replace")), None, None
        return "UNSUPPORTED", None, None, ext
    except (KeyError, ValueError, struct.error, zipfile.BadZipFile) as e:
        return "BROKEN", None, None, type(e).__name__


def read_papers(spark: SparkSession, folder: str) -> DataFrame:
    """path, status, text, pages, detail of all files under a folder; whole texts, one file at a time in each task."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")

    def run(batches):
        for b in batches:
            rows = [extracted(n, c) for n, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["path", "status", "text", "pages", "detail"])

    return raw.mapInArrow(run, "path string, status string, text string, pages int, detail string")

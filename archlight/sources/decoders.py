"""Text of file formats, by the standard library; others take a function of bytes."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import workbooks
from .shared import bound_batches

MIN_RUN = 4
OCR_BELOW = 100
#: Files that are decoded before their texts are handed on.
ROWS = 200


def plain(data: bytes) -> str:
    """UTF-8, then Western encodings; what still fails as runs of printable signs."""
    for name in ("utf-8", "utf-8-sig", "cp1252", "latin-1"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return "\n".join(m.decode("ascii") for m in re.findall(rb"[ -~]{%d,}" % MIN_RUN, data))


def docx(data: bytes) -> str:
    """Paragraphs, one to a line."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))


def xlsx(data: bytes) -> str:
    """Sheets with a heading, their columns and their rows; nulls are left out of a row."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in si.iter(f"{main}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{main}si")]
        titles = [s.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet")]
        for k, title in enumerate(titles, 1):
            rows = []
            for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iter(f"{main}row"):
                cells = []
                for c in row.iter(f"{main}c"):
                    value = c.find(f"{main}v")
                    inline = "".join(t.text or "" for t in c.iter(f"{main}t"))
                    text = inline if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text or ""
                    if text:
                        cells.append(text)
                rows.append(cells)
            out.append((title, rows))
    return shown_sheets(out)


def shown_sheets(found: list[tuple[str, list[list[str]]]]) -> str:
    """Sheets with a heading, their columns and their rows, blank lines between."""
    body = lambda rows: [f"Columns: {' | '.join(rows[0])}", *map(" | ".join, rows[1:])] if rows else ["(Empty sheet)"]
    return "\n\n".join("\n".join([f"=== SHEET: {title} ===", *body(rows)]) for title, rows in found)


def xls(data: bytes) -> str:
    """The same for workbooks of the older format."""
    return shown_sheets(workbooks.sheets(data))


def rtf(data: bytes) -> str:
    """Text without control words and hidden groups."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    out, stack, hidden = [], [], False
    for m in re.finditer(r"\\([a-z]{1,32})(-?\d+)? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", text, re.I | re.S):
        word, _, code, sign, brace, char = m.groups()
        if brace == "{":
            stack.append(hidden)
        elif brace == "}":
            hidden = stack.pop() if stack else False
        elif sign == "*" or word in ("fonttbl", "colortbl", "stylesheet", "info", "pict"):
            hidden = True
        elif hidden:
            continue
        elif word:
            out.append({"par": "\n", "line": "\n", "tab": "\t"}.get(word, ""))
        elif code:
            out.append(bytes.fromhex(code).decode("cp1252", "replace"))
        elif sign in ("\\", "{", "}"):
            out.append(sign)
        elif char:
            out.append(char)
    return "".join(out)


def svg(data: bytes) -> str:
    """All element texts, one to a line; the raw file if it does not parse."""
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError:
        return plain(data)
    return "\n".join(t.strip() for e in root.iter() for t in (e.text or "",) if t.strip())


PDF_PART = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)")
#: What escapes in a PDF string stand for.
PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_string(raw: bytes) -> str:
    """A literal or hexadecimal string of a page's content, in the standard Western encoding or UTF-16."""
    if raw[:1] == b"<":
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        data = PDF_PART.sub(lambda m: PDF_ESCAPES.get(m[1]) or (bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1][-1:] == b"\n" else m[1]), raw[1:-1])
    return data.decode("utf-16", "replace") if data[:2] in (b"\xfe\xff", b"\xff\xfe") else data.decode("cp1252", "replace")


PDF_TOKEN = re.compile(rb"\((?:[^()\\]|\\[\s\S]|\((?:[^()\\]|\\[\s\S])*\))*\)|<[0-9A-Fa-f\s]*>|T[*dDmJj]|['\"]|BT|ET|-?[\d.]+|\]|\[")


def page_content(data: bytes) -> str:
    """Text that a content stream shows; a new line where the text moves."""
    out, strings, inside = [], [], False
    for token in PDF_TOKEN.findall(data):
        if token in (b"BT", b"ET"):
            inside = token == b"BT"
            out.append("\n")
        elif not inside:
            continue
        elif token[:1] in b"(<":
            strings.append(pdf_string(token))
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            out.append(("\n" if token in (b"'", b'"') else "") + "".join(strings))
            strings = []
        elif token in (b"T*", b"Td", b"TD", b"Tm"):
            out.append("\n")
    return "\n".join(x.strip() for x in "".join(out).split("\n") if x.strip())


def pdf(data: bytes, ocr: Callable[[bytes, int], str] | None = None) -> str:
    """Text of pages with simple fonts, a content stream a page; short pages by recognition, if there is any; bad pages are left out."""
    if not data.lstrip()[:5] == b"%PDF-":
        raise ValueError("no PDF")
    pages = []
    for m in re.finditer(rb"<<((?:[^<>]|<[^<>]*>|<<[^<>]*>>)*)>>\s*stream\r?\n", data):
        end = data.find(b"endstream", m.end())
        raw = data[m.end() : end if end >= 0 else len(data)]
        if re.search(rb"/(?:Type|Subtype)\s*/(?:XObject|Image|ObjStm|XRef|Metadata)|/Length1", m[1]):
            continue
        try:
            content = zlib.decompressobj().decompress(raw) if b"/FlateDecode" in m[1] else raw
        except zlib.error:
            continue
        if b"BT" in content or ocr:
            number = len(pages)
            pages.append(pdf_page(page_content(content), (lambda n=number: ocr(data, n)) if ocr else None))
    return "\n".join(pages)


def binarized(grey: np.ndarray) -> np.ndarray:
    """A grey image in black and white, at the threshold that parts its two classes best (Otsu's)."""
    counts = np.bincount(grey.reshape(-1), minlength=256).astype(float)
    below = np.cumsum(counts)
    mass = np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return np.where(grey > int(np.nanargmax(apart)) if np.isfinite(apart).any() else grey > 127, 255, 0).astype(np.uint8)


def image_text(data: bytes, grey: Callable[[bytes], np.ndarray] | None, ocr: Callable[[np.ndarray], str] | None) -> str:
    """What recognition reads in an image made black and white; an empty text without a tool."""
    return ocr(binarized(grey(data))) if grey and ocr else ""


def video_frames(count: int, fps: float, grab: Callable[[int], bytes], every: int = 10) -> list[tuple[int, bytes]]:
    """Frames of a film, one every so many seconds."""
    if fps <= 0:
        raise ValueError("the film cannot be opened")
    return [(i, grab(i)) for i in range(0, count, max(int(fps * every), 1))]


def tables_of(reader: object) -> dict[str, pd.DataFrame]:
    """Tables of a database file, from whichever form its reader has: a mapping, ``tables`` or ``catalog`` with ``table(name)``; system tables are left out."""
    listed = reader if isinstance(reader, dict) else getattr(reader, "tables", None) or getattr(reader, "catalog", None)
    names = [n for n in (listed or {}) if not str(n).lower().startswith("msys")]
    if not names:
        raise ValueError("no tables")
    one = (lambda n: listed[n]) if isinstance(listed, dict) and not hasattr(reader, "table") else reader.table
    return {str(n): t if isinstance(t, pd.DataFrame) else pd.DataFrame(t) for n, t in ((n, one(n)) for n in names)}


def uploaded(given: bytes | io.IOBase | str) -> bytes:
    """Bytes of an upload: given as they are, as a file whose position is left as found, or by path; an empty one is an error."""
    if isinstance(given, str):
        with open(given, "rb") as f:
            data = f.read()
    elif isinstance(given, (bytes, bytearray)):
        data = bytes(given)
    else:
        at = given.tell()
        given.seek(0)
        data = given.read()
        given.seek(at)
    if not data:
        raise ValueError("the upload is empty")
    return data


#: Decoder of each kind; callers may add those left out (Access, images, video).
DECODERS: dict[str, Callable[[bytes], str]] = {
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": docx,
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": xlsx,
    "application/vnd.ms-excel": xls,
    "application/pdf": pdf,
    "application/rtf": rtf,
    "text/rtf": rtf,
    "image/svg+xml": svg,
}


def pdf_page(digital: str, ocr: Callable[[], str] | None) -> str:
    """A page's own text, or what optical recognition finds if it is short; its own if recognition fails."""
    if len(digital.strip()) >= OCR_BELOW or ocr is None:
        return digital
    try:
        return ocr()
    except Exception:  # noqa: BLE001  any failure of the optional tool
        return digital


def extract(files: DataFrame, more: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """``path, mime_type, content`` to ``path, text, error``: by the type's decoder, ``text/*`` as plain text; a failure and a type without a decoder are told, not raised."""
    known = DECODERS | (more or {})

    def one(kind: str | None, data: bytes | None) -> tuple[str | None, str | None]:
        decoder = known.get(kind or "") or (plain if (kind or "").startswith("text/") else None)
        if data is None:
            return None, None
        if decoder is None:
            return None, f"no decoder for {kind or 'an unknown type'}"
        try:
            return decoder(bytes(data)), None
        except Exception as e:  # noqa: BLE001  broken files must not end the job
            return None, f"{type(e).__name__}: {e}"

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (whole[at : at + ROWS] for whole in parts for at in range(0, len(whole), ROWS)):
            found = [one(k, c) for k, c in zip(part["mime_type"], part["content"])]
            yield pd.DataFrame({"path": part["path"], "text": [f[0] for f in found], "error": [f[1] for f in found]})

    bound_batches(files.sparkSession)
    return files.select("path", "mime_type", "content").mapInPandas(work, "path string, text string, error string")

"""Workbooks through the standard library: a zip of XML."""

from __future__ import annotations

import datetime
import io
import re
import xml.etree.ElementTree as ET
import zipfile

SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Largest uncompressed part that is read.
MOST_BYTES = 1 << 30
DATE_FORMATS = frozenset([*range(14, 23), 45, 46, 47])


def part(book: zipfile.ZipFile, name: str) -> ET.Element | None:
    if name not in book.namelist():
        return None
    if book.getinfo(name).file_size > MOST_BYTES:
        raise ValueError(f"{name} is larger than {MOST_BYTES} bytes")
    return ET.fromstring(book.read(name))


def sheets(content: bytes) -> dict[str, str]:
    """Visible sheets first: name and part."""
    book = zipfile.ZipFile(io.BytesIO(content))
    targets = {r.get("Id"): r.get("Target").lstrip("/") for r in part(book, "xl/_rels/workbook.xml.rels")}
    found = [(s.get("state", "visible") != "visible", s.get("name"), targets[s.get(REL + "id")]) for s in part(book, "xl/workbook.xml").iter(SHEET + "sheet")]
    return {n: t if t.startswith("xl/") else "xl/" + t for _, n, t in sorted(found, key=lambda x: x[0])}


def sheet_rows(content: bytes, sheet: str | None = None) -> list[list]:
    """Typed cells of a sheet (the first visible one by default), in rows; gaps are None."""
    book = zipfile.ZipFile(io.BytesIO(content))
    known = sheets(content)
    root = part(book, known[sheet or next(iter(known))])
    strings = part(book, "xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in s.iter(SHEET + "t")) for s in strings.iter(SHEET + "si")] if strings is not None else []
    styles = part(book, "xl/styles.xml")
    formats = [int(x.get("numFmtId", 0)) for x in styles.find(SHEET + "cellXfs")] if styles is not None and styles.find(SHEET + "cellXfs") is not None else []
    rows: list[list] = []
    for r in root.iter(SHEET + "row"):
        while len(rows) < int(r.get("r", len(rows) + 1)) - 1:
            rows.append([])
        row: list = []
        for c in r.iter(SHEET + "c"):
            at = 0
            for letter in re.match("[A-Z]+", c.get("r", "A"))[0]:
                at = at * 26 + ord(letter) - 64
            row += [None] * (at - len(row))
            v, kind = c.find(SHEET + "v"), c.get("t", "n")
            text = v.text if v is not None else "".join(t.text or "" for t in c.iter(SHEET + "t")) or None
            if text is not None and kind == "s":
                text = shared[int(text)]
            elif text is not None and kind == "b":
                text = text == "1"
            elif text is not None and kind == "n":
                number = float(text)
                style = int(c.get("s", 0))
                if style < len(formats) and formats[style] in DATE_FORMATS:
                    text = (datetime.datetime(1899, 12, 30) + datetime.timedelta(days=number)).isoformat(sep=" ")
                else:
                    text = int(number) if number == int(number) and abs(number) <= 1 << 53 else number
            row[at - 1] = text
        rows.append(row)
    return rows


def header_of(rows: list[list], within: int = 50) -> int:
    """The first of the leading rows that is all text, without repeats, and as wide as any."""
    head = rows[:within]
    width = max((sum(x is not None for x in r) for r in head), default=0)
    for i, r in enumerate(head):
        own = [x for x in r if x is not None]
        if own and len(own) == width and all(isinstance(x, str) for x in own) and len(set(own)) == len(own):
            return i
    return next((i for i, r in enumerate(head) if any(x is not None for x in r)), 0)

"""Readers of zipped office XML, called per file inside tasks."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def docx_plain_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        xml = archive.read("word/document.xml").decode("utf-8", errors="ignore")
    return " ".join(re.sub(r"<[^>]+>", " ", xml).split())


def _paragraph_text(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{WORD}t")).strip()


def docx_markdown(name: str, content: bytes) -> str:
    """Headings become ``#`` levels one deeper than their style, tables become grids."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ET.fromstring(archive.read("word/document.xml")).find(f"{WORD}body")
    blocks = [f"# {name}"]
    tables = 0
    for node in body if body is not None else []:
        if node.tag == f"{WORD}p":
            text = _paragraph_text(node)
            style = node.find(f"{WORD}pPr/{WORD}pStyle")
            label = (style.get(f"{WORD}val") or "").lower() if style is not None else ""
            if text and ("heading" in label or "заголов" in label):
                digits = re.sub(r"\D", "", label)
                text = "#" * (min(int(digits) + 1, 6) if digits else 2) + " " + text
            if text:
                blocks.append(text)
        elif node.tag == f"{WORD}tbl":
            tables += 1
            rows = [[_paragraph_text(c) for c in row.findall(f"{WORD}tc")] for row in node.findall(f"{WORD}tr")]
            lines = ["| " + " | ".join(cells) + " |" for cells in rows]
            if len(lines) > 1:
                lines.insert(1, "|" + "---|" * len(rows[0]))
            blocks.append("\n".join([f"## Таблица {tables}", "", *lines]))
    return "\n\n".join([*blocks, f"*Источник: {name}*"]) + "\n"


def _column_index(reference: str) -> int:
    letters = re.match(r"[A-Z]+", reference).group(0)
    index = 0
    for letter in letters:
        index = index * 26 + ord(letter) - 64
    return index - 1


def xlsx_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells) of every row that is present in a workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = set(archive.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for item in ET.fromstring(archive.read("xl/sharedStrings.xml")).findall(f"{SHEET}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{SHEET}t")))
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(archive.read("xl/workbook.xml")).iter(f"{SHEET}sheet"):
            target = targets[sheet.get(RELATION)].lstrip("/")
            root = ET.fromstring(archive.read(target if target.startswith("xl/") else f"xl/{target}"))
            for position, row in enumerate(root.iter(f"{SHEET}row"), 1):
                cells: dict[int, str | None] = {}
                for i, cell in enumerate(row.findall(f"{SHEET}c")):
                    column = _column_index(cell.get("r")) if cell.get("r") else i
                    value = cell.find(f"{SHEET}v")
                    if cell.get("t") == "inlineStr":
                        cells[column] = "".join(t.text or "" for t in cell.iter(f"{SHEET}t"))
                    elif value is not None:
                        cells[column] = shared[int(value.text)] if cell.get("t") == "s" else value.text
                width = max(cells, default=-1) + 1
                yield sheet.get("name"), int(row.get("r") or position), [cells.get(i) for i in range(width)]

"""DOCX files as blocks, by the standard library."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"


def docx_blocks(content: bytes | None) -> list[tuple[str, int, str]]:
    """Type, level and text of paragraphs, headings, tables (as Markdown) and formulas, in order; a file that isn't a DOCX
    has none."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content or b"")).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    body, out = root.find(f"{W}body"), []

    def text(e) -> str:
        return "".join(t.text or "" if t.tag in (f"{W}t", f"{M}t") else "\t" if t.tag == f"{W}tab" else "\n" if t.tag == f"{W}br" else "" for t in e.iter()).strip()

    for e in body if body is not None else []:
        if e.tag == f"{W}p":
            style = e.find(f"{W}pPr/{W}pStyle")
            name = (style.get(f"{W}val") or "").lower() if style is not None else ""
            if not text(e):
                continue
            if name.startswith("heading") or name == "title":
                out.append(("heading", int(name[7:]) if name[7:].isdigit() else 1, text(e)))
            else:
                out.append(("formula" if e.find(f".//{M}oMath") is not None else "paragraph", 0, text(e)))
        elif e.tag == f"{W}tbl":
            rows = [[text(c) for c in r.findall(f"{W}tc")] for r in e.findall(f"{W}tr")]
            lines = ["| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in r) + " |" for r in rows]
            out.append(("table", 0, "\n".join([*lines[:1], "|" + "---|" * (len(rows[0]) if rows else 0), *lines[1:]])))
    return out

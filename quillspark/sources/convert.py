"""Format sniffing and conversion of files to markdown, in Arrow batches over the bytes Spark reads.

Each converter takes one file's bytes and gives (markdown, title, modified_at or None). Only the standard library is used;
readers of PDF and of text in images need packages or models that may be absent, and plug in by ``register``.
"""

from __future__ import annotations

import base64
import csv
import email
import email.policy
import email.utils
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources import ddl, mailthread

#: Extensions that a folder scan takes.
EXTENSIONS = ("md", "markdown", "doc", "docx", "pdf", "xlsx", "csv", "html", "htm", "mht", "mhtml", "png", "jpg", "jpeg", "drawio", "xml", "sql", "eml", "mbox", "dbsource")
_FROM, _TO, _MORE = (re.compile(p, re.I | re.M) for p in (rb"^From:[ \t]*\S", rb"^(?:To|Cc):[ \t]*\S", rb"^(?:Subject|Date|Message-ID):[ \t]*\S"))
_BY_EXTENSION = {"md": "Markdown", "markdown": "Markdown", "csv": "Csv", "html": "Html", "htm": "Html", "drawio": "Drawio", "sql": "Sql", "dbsource": "Database"}
Converted = tuple[str, str | None, datetime | None]


def stem(path: str) -> str:
    name = re.split(r"[/\\]", path)[-1]
    return name.rsplit(".", 1)[0] if "." in name else name


def extension(path: str) -> str:
    name = re.split(r"[/\\]", path)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name else ""


def sniff(path: str, content: bytes) -> str:
    """The format by content, and by extension only where the content doesn't tell."""
    head, peek, ext = content[:512], content[:8192], extension(path)
    for magic, fmt in ((b"%PDF", "Pdf"), (b"\x89PNG", "Image"), (b"\xff\xd8\xff", "Image")):
        if head.startswith(magic):
            return fmt
    if head.startswith(b"PK\x03\x04"):
        try:
            names = [n.lower() for n in zipfile.ZipFile(io.BytesIO(content)).namelist()]
        except zipfile.BadZipFile:
            return "Docx"
        marks = [n.split("/")[0] for n in names if n.startswith(("xl/", "word/"))]
        return "Xlsx" if marks[:1] == ["xl"] else "Docx"
    if ext in ("eml", "mbox") or peek.startswith(b"From ") or all(r.search(peek) for r in (_FROM, _TO, _MORE)):
        return "Email"
    low = head.lower()
    if b"mime-version:" in low or b"multipart/related" in low:
        return "Mhtml"
    if b"<mxfile" in low:
        return "Drawio"
    if b"<!doctype html" in low or b"<html" in low:
        return "Html"
    return _BY_EXTENSION.get(ext, "Unknown")


def _text(content: bytes) -> str:
    for bom, enc in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(bom):
            return content.decode(enc, errors="replace")
    return content.decode("utf-8", errors="replace")


def _utc(t: datetime | None) -> datetime | None:
    return None if t is None else (t if t.tzinfo else t.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)


def _iso(s: str | None) -> datetime | None:
    try:
        return _utc(datetime.fromisoformat((s or "").strip().replace("Z", "+00:00")))
    except ValueError:
        return None


# -- markdown and HTML ------------------------------------------------------------------------------------------

def markdown(path: str, content: bytes) -> Converted:
    md = re.sub(r"\n{3,}", "\n\n", _text(content).replace("\r\n", "\n")).strip()
    m = re.search(r"^#{1,6}\s+(.+?)\s*#*\s*$", md, re.M)
    return md, m[1] if m else None, None


class _Markdown(HTMLParser):
    """HTML to markdown as a stack of open elements, each with the text it has gathered."""

    VOID = {"br", "hr", "img", "meta", "link", "input", "col", "area", "base", "wbr", "source"}
    GONE = {"script", "style", "head", "noscript", "img"}
    CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "dt": {"dd", "dt"}, "dd": {"dd", "dt"}}
    BLOCK = {"p", "div", "section", "article", "main", "header", "footer", "body", "html", "form", "figure", "address", "dl"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = [self._node("", {})]
        self.h1: str | None = None
        self.title: str | None = None

    @staticmethod
    def _node(tag: str, attrs: dict) -> dict:
        return {"tag": tag, "attrs": attrs, "out": [], "rows": [], "cells": [], "items": 0}

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in self.VOID:
            if tag == "br" and not self._gone():
                self.stack[-1]["out"].append("<br>" if self._in("td", "th") else "  \n")
            elif tag == "hr" and not self._gone():
                self.stack[-1]["out"].append("\n\n* * *\n\n")
            return
        while self.stack[-1]["tag"] in self.CLOSES.get(tag, ()):
            self._close()
        self.stack.append(self._node(tag, a))

    def handle_endtag(self, tag):
        if any(n["tag"] == tag for n in self.stack[1:]):
            while self.stack[-1]["tag"] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if self.stack[-1]["tag"] == "title" and self.title is None and data.strip():
            self.title = data.strip()
        if not self._gone():
            self.stack[-1]["out"].append(data if self._in("pre") else re.sub(r"\s+", " ", data.replace("\xa0", " ")))

    def _in(self, *tags: str) -> bool:
        return any(n["tag"] in tags for n in self.stack)

    def _gone(self) -> bool:
        return any(n["tag"] in self.GONE or n["attrs"].get("id") == "footer" or {"footer", "page-metadata"} & set(n["attrs"].get("class", "").split()) for n in self.stack)

    def _close(self):
        gone = self._gone()
        n = self.stack.pop()
        if gone:
            return
        up, tag, text = self.stack[-1], n["tag"], "".join(n["out"])
        flat = re.sub(r"\s+", " ", text).strip()
        if re.fullmatch(r"h[1-6]", tag):
            self.h1 = self.h1 or (flat if tag == "h1" and flat else None)
            up["out"].append(f"\n\n{'#' * int(tag[1])} {flat}\n\n" if flat else "")
        elif tag in ("strong", "b", "em", "i", "del", "s", "code") and not self._in("pre"):
            mark = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "code": "`"}[tag]
            lead, tail = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
            up["out"].append(f"{lead}{mark}{text.strip()}{mark}{tail}" if text.strip() else text)
        elif tag == "a":
            href = n["attrs"].get("href", "")
            up["out"].append(f"[{flat}]({href})" if flat and href and href != flat else flat or "")
        elif tag == "pre":
            up["out"].append(f"\n\n```\n{text.strip(chr(10))}\n```\n\n")
        elif tag == "blockquote":
            up["out"].append("\n\n" + "\n".join(f"> {x}".rstrip() for x in tidy(text).split("\n")) + "\n\n")
        elif tag == "li":
            up["items"] += 1
            first = int(up["attrs"].get("start") or 1) if str(up["attrs"].get("start") or 1).isdigit() else 1
            mark = f"{first + up['items'] - 1}." if up["tag"] == "ol" else "-"
            up["out"].append(f"{mark} " + tidy(text).replace("\n", "\n" + " " * (len(mark) + 1)) + "\n")
        elif tag in ("ul", "ol"):
            body = text.rstrip("\n")
            up["out"].append(f"\n{body}\n" if up["tag"] == "li" else f"\n\n{body}\n\n")
        elif tag in ("td", "th"):
            cell = re.sub(r"\s*\n\s*", "<br>", tidy(text)).replace("|", "\\|")
            span = n["attrs"].get("colspan", "1")
            up["cells"] += [cell, *[""] * ((int(span) if span.isdigit() else 1) - 1)]
        elif tag == "tr":
            up["rows"].append(n["cells"])
        elif tag in ("thead", "tbody", "tfoot"):
            up["rows"] += n["rows"]
        elif tag == "table":
            up["out"].append("\n\n" + pipe_table(n["rows"]) + "\n\n")
        elif tag in self.BLOCK:
            up["out"].append(f"\n\n{text}\n\n")
        elif tag != "title":
            up["out"].append(text)  # unknown tags keep their text
        if tag not in ("td", "th", "tr"):
            up["rows"] += n["rows"] if tag not in ("thead", "tbody", "tfoot", "table") else []

    def result(self) -> str:
        while len(self.stack) > 1:
            self._close()
        return tidy("".join(self.stack[0]["out"]))


def tidy(md: str) -> str:
    md = re.sub(r"(?:<br>\s*){2,}", "<br>", md.replace("\xa0", " "))
    md = "\n".join(x.rstrip() if x.strip() else "" for x in md.split("\n"))
    return re.sub(r"^(#{1,6}) {2,}", r"\1 ", re.sub(r"\n{3,}", "\n\n", md), flags=re.M).strip()


def pipe_table(rows: list[list[str]]) -> str:
    """A table whose first row is the head; short rows are filled, long ones cut to the head's width."""
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = len(rows[0])
    line = lambda r: "| " + " | ".join([*r, *[""] * width][:width]) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])])


def html_to_markdown(text: str) -> tuple[str, str | None]:
    """(markdown, title): the first h1, else the document's title."""
    p = _Markdown()
    p.feed(text)
    p.close()
    md = p.result()
    return md, p.h1 or p.title


def html(path: str, content: bytes) -> Converted:
    text = _text(content)
    md, title = html_to_markdown(text)
    m = re.search(r"Updated:\s*(\d{4})/(\d{2})/(\d{2})", re.sub(r"<[^>]+>", "", text))
    try:
        at = datetime(int(m[1]), int(m[2]), int(m[3]), tzinfo=timezone.utc) if m else None
    except ValueError:
        at = None
    return md, title, at


def _message_time(m) -> datetime | None:
    try:
        return _utc(email.utils.parsedate_to_datetime(m["Date"])) if m["Date"] else None
    except (ValueError, TypeError):
        return None


def _part_text(m, kinds: tuple[str, ...]) -> tuple[str, str] | None:
    for kind in kinds:
        for part in m.walk():
            if part.get_content_type() == kind and part.get_content_disposition() != "attachment":
                raw = part.get_payload(decode=True) or b""
                try:
                    return kind, raw.decode(part.get_content_charset() or "utf-8", errors="replace")
                except LookupError:
                    return kind, raw.decode("utf-8", errors="replace")
    return None


def mhtml(path: str, content: bytes) -> Converted:
    m = email.message_from_bytes(content, policy=email.policy.compat32)
    got = _part_text(m, ("text/html",))
    if got is None:
        raise ValueError("no HTML part")
    md, title = html_to_markdown(got[1])
    return md, title, _message_time(m)


# -- tables -----------------------------------------------------------------------------------------------------

def csv_delimiter(first_line: str) -> str:
    """Tab, semicolon or comma, by which the first line has most of outside of quotes; a comma in doubt."""
    bare = re.sub(r'"(?:[^"]|"")*"?', "", first_line)
    comma, semi, tab = (bare.count(c) for c in ",;\t")
    return "\t" if tab > max(comma, semi) else ";" if semi > comma else ","


def _cell(v: str) -> str:
    return re.sub(r"\r\n|\r|\n", " ", v.replace("|", "\\|")).strip()


def csv_table(path: str, content: bytes) -> Converted:
    text = _text(content)
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=csv_delimiter(text.split("\n", 1)[0])) if len(r) > 1 or (r and r[0].strip())]
    body = pipe_table([[_cell(v) for v in r] for r in rows])
    return f"# {stem(path)}\n\n{body}".rstrip(), stem(path), None


def _zip_xml(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    try:
        return ET.fromstring(z.read(name))
    except KeyError:
        return None


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _property(z: zipfile.ZipFile, name: str) -> str | None:
    core = _zip_xml(z, "docProps/core.xml")
    found = [e.text for e in core.iter() if _local(e.tag) == name] if core is not None else []
    return found[0].strip() if found and found[0] and found[0].strip() else None


def xlsx(path: str, content: bytes) -> Converted:
    """Visible sheets that hold something, as tables of the values that a reader sees (of formulas the stored result)."""
    z = zipfile.ZipFile(io.BytesIO(content))
    shared = _zip_xml(z, "xl/sharedStrings.xml")
    strings = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in shared] if shared is not None else []
    links = _zip_xml(z, "xl/_rels/workbook.xml.rels")
    rels = {r.get("Id"): r.get("Target", "") for r in (links if links is not None else ())}
    title = _property(z, "title") or stem(path)
    out = [f"# {title}"]
    for sheet in (e for e in _zip_xml(z, "xl/workbook.xml").iter() if _local(e.tag) == "sheet"):
        if sheet.get("state", "visible") != "visible":
            continue
        target = next((rels.get(v, "") for k, v in sheet.attrib.items() if _local(k) == "id"), "")
        root = _zip_xml(z, target.lstrip("/") if target.startswith("/") else f"xl/{target}")
        cells: dict[tuple[int, int], str] = {}
        for c in (e for e in root.iter() if _local(e.tag) == "c") if root is not None else ():
            m = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r", ""))
            col = 0
            for ch in m[1]:
                col = col * 26 + ord(ch) - 64
            kind, value = c.get("t"), next((e.text or "" for e in c if _local(e.tag) == "v"), "")
            if kind == "s":
                value = strings[int(value)] if value else ""
            elif kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
            elif kind == "b":
                value = {"1": "TRUE", "0": "FALSE"}.get(value, value)
            if value.strip():
                cells[int(m[2]), col] = value
        if cells:
            (r0, r1), (c0, c1) = ((min(k[i] for k in cells), max(k[i] for k in cells)) for i in (0, 1))
            table = [[_cell(cells.get((r, c), "")) for c in range(c0, c1 + 1)] for r in range(r0, r1 + 1)]
            out.append(f"## {sheet.get('name')}\n\n{pipe_table(table)}")
    return "\n\n".join(out), title, _iso(_property(z, "modified"))


def docx(path: str, content: bytes) -> Converted:
    """Paragraph styles to headings and lists, tables to pipe tables, bold and italic runs."""
    z = zipfile.ZipFile(io.BytesIO(content))
    body = next(e for e in _zip_xml(z, "word/document.xml") if _local(e.tag) == "body")

    def one(e: ET.Element, name: str) -> ET.Element | None:
        return next((x for x in e.iter() if _local(x.tag) == name), None)

    def val(e: ET.Element | None) -> str:
        return next((v for k, v in e.attrib.items() if _local(k) == "val"), "") if e is not None else ""

    def words(p: ET.Element) -> str:
        out = []
        for r in (x for x in p.iter() if _local(x.tag) == "r"):
            t = "".join((x.text or "") if _local(x.tag) == "t" else "\t" if _local(x.tag) == "tab" else "\n" if _local(x.tag) == "br" else "" for x in r)
            mark = "**" if one(r, "b") is not None and val(one(r, "b")) not in ("0", "false") else "*" if one(r, "i") is not None and val(one(r, "i")) not in ("0", "false") else ""
            out.append(f"{mark}{t}{mark}" if t.strip() else t)
        return "".join(out).replace("****", "")

    title, parts = None, []
    for e in body:
        if _local(e.tag) == "p":
            style, text = val(one(e, "pStyle")), words(e).strip()
            level = re.fullmatch(r"(?i)heading\s*(\d)", style)
            if not text:
                continue
            if level or style.lower() == "title":
                text = text.replace("**", "")
                n = min(6, int(level[1])) if level else 1
                title = title or (text if n == 1 else None)
                parts.append(f"{'#' * n} {text}")
            elif one(e, "numPr") is not None:
                parts.append(f"- {text}")
            else:
                parts.append(text)
        elif _local(e.tag) == "tbl":
            parts.append(pipe_table([[" ".join(words(p).strip() for p in c.iter() if _local(p.tag) == "p").replace("|", "\\|").strip() for c in r if _local(c.tag) == "tc"] for r in e if _local(r.tag) == "tr"]))
    md = "\n\n".join(parts)
    return re.sub(r"(?m)^(- .*)\n\n(?=- )", r"\1\n", md), title, _iso(_property(z, "modified"))


# -- diagrams ---------------------------------------------------------------------------------------------------

def inflate_page(payload: str) -> str:
    """A page's XML from Base64, raw deflate and percent encoding."""
    return unquote(zlib.decompress(base64.b64decode(payload), -15).decode("utf-8"))


def clean_label(value: str | None) -> str:
    import html as h

    return " ".join(re.sub(r"<[^>]*>", " ", h.unescape(value or "")).replace("\xa0", " ").split())


def diagram_cells(content: bytes) -> list[dict]:
    """The cells of all pages: page, id, label, parent, vertex, edge, source, target. Unreadable pages are left out."""
    root = ET.fromstring(content)
    out = []
    pages = [root] if root.tag == "diagram" else root.iter("diagram")
    for k, page in enumerate(pages, 1):
        model = page.find("mxGraphModel")
        if model is None and (page.text or "").strip():
            try:
                model = ET.fromstring(inflate_page(page.text.strip()))
            except (ValueError, zlib.error, ET.ParseError):
                model = None
        if model is None:
            continue
        owner = {id(c): w for w in model.iter() if w.tag in ("UserObject", "object") for c in w}
        name = page.get("name") or f"Page {k}"
        for c in model.iter("mxCell"):
            w = owner.get(id(c))
            cid = c.get("id") or (w.get("id") if w is not None else None)
            if cid:
                label = c.get("value") if c.get("value") is not None else w.get("label") if w is not None else None
                out.append({"page": k, "page_name": name, "id": cid, "label": clean_label(label), "parent": c.get("parent"), "vertex": c.get("vertex") == "1", "edge": c.get("edge") == "1", "source": c.get("source"), "target": c.get("target")})
    return out


def drawio(path: str, content: bytes) -> Converted:
    """Per page its shapes, a container with what it holds, and its connections between the nearest labelled ancestors."""
    title = stem(path)
    out = [f"# {title}"]
    cells = diagram_cells(content)
    for page in dict.fromkeys(c["page"] for c in cells):
        own = [c for c in cells if c["page"] == page]
        by_id = {c["id"]: c for c in own}
        kids: dict[str, list[dict]] = {}
        for c in own:
            kids.setdefault(c["parent"] or "", []).append(c)

        def inside(i: str, depth: int = 0) -> list[str]:
            found = [" ".join([*([k["label"]] if k["label"] else []), *inside(k["id"], depth + 1)]) for k in kids.get(i, ()) if k["vertex"]] if depth < 64 else []
            return [f for f in found if f]

        def end(i: str | None) -> str:
            for _ in range(5):
                if i is None or i not in by_id:
                    break
                if by_id[i]["label"]:
                    return by_id[i]["label"]
                i = by_id[i]["parent"]
            return "?"

        shapes = []
        for c in own:
            if c["vertex"] and not (c["parent"] in by_id and by_id[c["parent"]]["vertex"]):
                held = "; ".join(inside(c["id"]))
                shapes.append(f"**{c['label']}** — {held}" if c["label"] and held else c["label"] or held)
        shapes = [f"- {s}" for s in shapes if s]
        links = [f"- {end(c['source'])} → {end(c['target'])}" + (f": {c['label']}" if c["label"] else "") for c in own if c["edge"]]
        out.append(f"## {own[0]['page_name']}")
        out += ["### Shapes\n\n" + "\n".join(shapes)] if shapes else []
        out += ["### Connections\n\n" + "\n".join(links)] if links else []
    return "\n\n".join(out), title, _iso(ET.fromstring(content).get("modified"))


# -- the rest ---------------------------------------------------------------------------------------------------

def sql(path: str, content: bytes) -> Converted:
    text = _text(content)
    schema = ddl.parse(text)
    body = ddl.render(schema) if schema["tables"] or schema["others"] or schema["foreign_keys"] else f"```sql\n{text.strip()}\n```"
    return f"# {stem(path)}\n\n{body}".rstrip(), stem(path), None


def mail(path: str, content: bytes) -> Converted:
    return mailthread.convert(path, content, html_to_markdown)


_CONVERTERS: dict[str, Callable[[str, bytes], Converted]] = {"Markdown": markdown, "Html": html, "Mhtml": mhtml, "Csv": csv_table, "Xlsx": xlsx, "Docx": docx, "Drawio": drawio, "Sql": sql, "Email": mail}


def register(fmt: str, converter: Callable[[str, bytes], Converted]) -> None:
    """Plugs in a converter: for ``Pdf`` and ``Image``, or in place of one above."""
    _CONVERTERS[fmt] = converter


def convert(path: str, content: bytes) -> tuple[str, Converted]:
    """(format, result); an error for unknown formats and for those without a converter here."""
    fmt = sniff(path, content)
    if fmt not in _CONVERTERS:
        raise ValueError(f"no converter for {fmt}")
    return fmt, _CONVERTERS[fmt](path, content)


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length, content) of supported files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*EXTENSIONS))


def convert_files(files: DataFrame) -> DataFrame:
    """(source_path, format, markdown, title, source_modified_at, error) of binary files. A file that fails has an error and no markdown; the others go on.

    The date is the document's own, else the file's.
    """

    converters = dict(_CONVERTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _CONVERTERS.update(converters)
        for b in batches:
            rows: list[tuple] = []
            for path, at, data in zip(*(b.column(c).to_pylist() for c in ("path", "modificationTime", "content"))):
                try:
                    fmt, (md, title, own) = convert(path, data or b"")
                    rows.append((path, fmt, md, title, own or at, None))
                except Exception as e:  # noqa: BLE001  one broken file must not end the job
                    rows.append((path, sniff(path, data or b""), None, None, at, f"{type(e).__name__}: {e}"))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.timestamp("us", tz="UTC"), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["source_path", "format", "markdown", "title", "source_modified_at", "error"])

    return files.select("path", "modificationTime", "content").mapInArrow(run, "source_path string, format string, markdown string, title string, source_modified_at timestamp, error string")

import base64
import io
import zipfile
import zlib
from urllib.parse import quote

import pytest

from quillspark.sources import convert as cv
from quillspark.sources import ddl, mailthread

def cell(i, **attrs):
    return f'<mxCell id="{i}" ' + " ".join(f'{k}="{v}"' for k, v in attrs.items()) + "/>"


# a box with two rows of cells, a box with marked-up text, a link between rows, and one whose start is missing
GRAPH = "<mxGraphModel><root>" + "".join([
    cell(0), cell(1, parent=0),
    cell("shelf", value="shelves", vertex=1, parent=1), cell("shelf-a", vertex=1, parent="shelf"), cell("k1", value="key", vertex=1, parent="shelf-a"), cell("k2", value="code", vertex=1, parent="shelf-a"),
    cell("shelf-b", vertex=1, parent="shelf"), cell("k3", value="floor", vertex=1, parent="shelf-b"),
    cell("loan", value="&lt;i&gt;loans&lt;/i&gt;", vertex=1, parent=1), cell("loan-a", vertex=1, parent="loan"), cell("k4", value="shelf_code", vertex=1, parent="loan-a"),
    cell("l1", value="many", edge=1, parent=1, source="k4", target="k2"), cell("l2", edge=1, parent=1, source="lost", target="shelf"),
]) + "</root></mxGraphModel>"


def zipped(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return b.getvalue()


@pytest.mark.parametrize(
    "path,content,want",
    [
        ("a.txt", b"%PDF-1.7", "Pdf"), ("a.md", b"\x89PNG\r\n", "Image"), ("a", b"\xff\xd8\xff\xe0", "Image"), ("a.docx", zipped({"xl/workbook.xml": ""}), "Xlsx"), ("a.bin", zipped({"word/document.xml": ""}), "Docx"), ("a", zipped({"x": ""}), "Docx"),
        ("a.doc", b"From: a@x\nTo: b@x\nSubject: hi\n\nbody", "Email"), ("a.mbox", b"", "Email"), ("a.doc", b"MIME-Version: 1.0\nContent-Type: multipart/related", "Mhtml"), ("x.xml", b'<mxfile host="h">', "Drawio"), ("a.doc", b"<!DOCTYPE html><p>", "Html"),
        ("a.MD", b"# x", "Markdown"), ("a.csv", b"a,b", "Csv"), ("a.sql", b"select", "Sql"), ("a.zzz", b"??", "Unknown"), ("a.doc", b"x" * 1500 + b"\nFrom: a\nTo: b\nDate: now", "Email"),
    ],
)
def test_sniff(path, content, want):
    assert cv.sniff(path, content) == want


def test_html():
    html = b"""<html><head><title>Page title</title><style>x{}</style></head><body><h1>Head  <b>line</b></h1><p>One &amp; <a href="http://x.example">link</a><br>two</p><div id="footer">gone</div>
    <ul><li>a<ul><li>b</li></ul></li><li>c</li></ul><ol start="3"><li>x</li></ol><table><tr><th>A</th><th>B|b</th></tr><tr><td>1<br><br>2</td></tr></table><script>no</script><p>Updated: 2026/07/08</p><blink>kept</blink></body></html>"""
    md, title, at = cv.html("a.html", html)
    assert title == "Head **line**" or title.startswith("Head") and str(at) == "2026-07-08 00:00:00+00:00"
    for part in ("# Head", "One & [link](http://x.example)", "- a\n  - b", "- c", "3. x", "| A | B\\|b |\n| --- | --- |\n| 1<br>2 |  |", "kept"):
        assert part in md, part
    assert "gone" not in md and "no\n" not in md and "x{}" not in md
    assert cv.html("a.html", b"<title>T</title><p>x")[1] == "T"


def test_markdown_and_csv():
    assert cv.markdown("a.md", b"\n# T #\r\n\r\n\r\n\r\nx\n") == ("# T #\n\nx", "T", None)
    md, title, _ = cv.csv_table("/x/data.csv", b'name;note\n"a;b";"say ""hi""\nthere"\nonly|one\n\n;;\n')
    assert title == "data" and md.split("\n")[2:] == ["| name | note |", "| --- | --- |", '| a;b | say "hi" there |', "| only\\|one |  |", "|  |  |"]
    for line, want in (("a,b;c", ","), ("a;b;c,d", ";"), ("a\tb\tc;d", "\t"), ('"a;b;c",d', ","), ("x", ",")):
        assert cv.csv_delimiter(line) == want


def test_xlsx():
    wb = '<workbook xmlns:r="R"><sheets><sheet name="First" r:id="a"/><sheet name="Empty" r:id="b"/><sheet name="Hidden" state="hidden" r:id="c"/></sheets></workbook>'
    one = '<worksheet><sheetData><row><c r="B2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>n|x</t></is></c></row><row><c r="B3"><f>1+1</f><v>2</v></c><c r="C3" t="b"><v>1</v></c></row></sheetData></worksheet>'
    files = {"xl/workbook.xml": wb, "xl/_rels/workbook.xml.rels": '<R><r Id="a" Target="worksheets/s1.xml"/><r Id="b" Target="worksheets/s2.xml"/><r Id="c" Target="worksheets/s1.xml"/></R>', "xl/worksheets/s1.xml": one, "xl/worksheets/s2.xml": "<worksheet/>", "xl/sharedStrings.xml": "<sst><si><t>key</t></si></sst>", "docProps/core.xml": "<c><title>Book</title><modified>2026-01-02T03:04:05Z</modified></c>"}
    md, title, at = cv.xlsx("b.xlsx", zipped(files))
    assert title == "Book" and at.isoformat() == "2026-01-02T03:04:05+00:00"
    assert md == "# Book\n\n## First\n\n| key | n\\|x |\n| --- | --- |\n| 2 | TRUE |"


def test_docx():
    w = 'xmlns:w="W"'
    p = lambda t, style="", extra="": f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{style}{chr(34)}/>" if style else ""}{extra}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    body = p("Title", "Heading1") + p("Text") + p("one", extra="<w:numPr/>") + p("two", extra="<w:numPr/>") + "<w:tbl><w:tr><w:tc>" + p("A") + "</w:tc><w:tc>" + p("B") + "</w:tc></w:tr></w:tbl>"
    md, title, _ = cv.docx("d.docx", zipped({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>"}))
    assert title == "Title" and md == "# Title\n\nText\n\n- one\n- two\n\n| A | B |\n| --- | --- |"


def test_diagrams():
    md, title, at = cv.drawio("library.drawio", f'<mxfile modified="2025-11-03T08:30:00Z"><diagram name="Books">{GRAPH}</diagram></mxfile>'.encode())
    assert title == "library" and at.isoformat() == "2025-11-03T08:30:00+00:00"
    for part in ("## Books", "**shelves** — key code; floor", "**loans** — shelf_code", "shelf_code → code: many", "? → shelves"):
        assert part in md
    c = zlib.compressobj(wbits=-15)
    packed = base64.b64encode(c.compress(quote(GRAPH).encode()) + c.flush()).decode()
    md, _, at = cv.drawio("x.drawio", f"<mxfile><diagram>{packed}</diagram><diagram name='bad'>!!!</diagram></mxfile>".encode())
    assert "## Page 1" in md and "**shelves** — key code; floor" in md and at is None


DUMP = """/* lending; a library */
CREATE SCHEMA IF NOT EXISTS lend;
CREATE TABLE IF NOT EXISTS lend."Shelf" (code char(4) NOT NULL, floor smallint DEFAULT coalesce(1, 2), tags text[], width decimal(6,2) CHECK (width > 0), CONSTRAINT pk PRIMARY KEY (code));
CREATE TABLE `book` (isbn bigint PRIMARY KEY AUTO_INCREMENT, shelf char(4) NOT NULL REFERENCES lend."Shelf" (code) ON DELETE CASCADE, title varchar(90) UNIQUE COMMENT 'as printed', state shelf_state DEFAULT 'in; stock');
CREATE TABLE [loan] ([no] int IDENTITY, isbn bigint, due date, FOREIGN KEY (isbn) REFERENCES book (isbn));
COMMENT ON TABLE "Shelf" IS 'A reader''s shelf.'; -- with ; inside
COMMENT ON COLUMN lend.Shelf.floor IS 'Counted from the ground.';
ALTER TABLE IF EXISTS loan ADD CONSTRAINT c1 FOREIGN KEY (no, isbn) REFERENCES lend.copy (no, isbn);
CREATE TYPE shelf_state AS ENUM ('in; stock', 'out');
CREATE UNIQUE INDEX CONCURRENTLY by_title ON book (title, isbn);
CREATE OR REPLACE VIEW due_now AS SELECT no
  FROM loan;
CREATE FUNCTION tick() RETURNS void AS $f$ BEGIN a; b; END $f$ LANGUAGE plpgsql;
INSERT INTO book VALUES (1, 'x;y'); DELETE FROM loan;
VACUUM loan; go;
SELECT 'left open"""


def test_ddl():
    s = ddl.parse(DUMP)
    assert [t["name"] for t in s["tables"]] == ["lend.Shelf", "book", "loan"] and (s["data_statements"], s["unrecognized"]) == (2, 2)
    assert [(k["from_table"], k["from_columns"], k["to_table"], k["to_columns"]) for k in s["foreign_keys"]] == [("book", "shelf", "lend.Shelf", "code"), ("loan", "isbn", "book", "isbn"), ("loan", "no, isbn", "lend.copy", "no, isbn")]
    assert [c["type"] for c in s["tables"][0]["columns"]] == ["char(4)", "smallint", "text[]", "decimal(6,2)"]
    assert [c["flags"] for t in s["tables"] for c in t["columns"]] == [["PK", "NOT NULL"], ["DEFAULT coalesce(1, 2)"], [], [], ["PK", "auto"], ["NOT NULL"], ["UNIQUE"], ["DEFAULT 'in; stock'"], ["auto"], [], []]
    assert s["tables"][1]["columns"][2]["comment"] == "as printed"
    assert s["others"] == ["SCHEMA lend", "TYPE shelf_state AS ENUM (in; stock, out)", "INDEX by_title on book (title, isbn)", "VIEW due_now AS SELECT no FROM loan", "FUNCTION tick"]
    md = cv.sql("lend.sql", DUMP.encode())[0]
    for part in ("## Table: lend.Shelf\n\nA reader's shelf.", "- code char(4) — PK, NOT NULL\n", "- floor smallint — DEFAULT coalesce(1, 2) — Counted from the ground.", "- shelf char(4) — NOT NULL, FK → lend.Shelf(code)", "Referenced by: loan (isbn)", "2 data statements, 2 other statements"):
        assert part in md, part
    assert "```sql" in cv.sql("q.sql", b"SELECT 1;")[0]
    assert ddl.parse("") == {"tables": [], "foreign_keys": [], "others": [], "data_statements": 0, "unrecognized": 0}
    assert len(ddl.parse("CREATE TABLE t (a int, b (")["tables"][0]["columns"]) == 2


def test_mail():
    eml = b"From: Ann Lee <a@x.example>\nTo: b@x.example\nSubject: Re: FW: Bundle pricing\nDate: Wed, 15 Jul 2026 12:00:00 +0200\n\nNew words.\n# not a heading\n\n-- \nAnn\n\nFrom: Bob Moor\nSent: Tuesday, July 14, 2026 9:30 AM\nTo: Ann Lee\nSubject: Bundle pricing\n\nEarlier words.\n"
    md, title, at = cv.mail("m.eml", eml)
    assert title == "Bundle pricing" and at.isoformat() == "2026-07-15T10:00:00+00:00"
    assert md.index("## 2026-07-14 Bob Moor\n\nEarlier words.") < md.index("## 2026-07-15 Ann Lee\n\nNew words.\n\\# not a heading") and "-- \nAnn" not in md
    box = b"From x\nFrom: B <b@x>\nDate: Wed, 15 Jul 2026 12:00:00 +0000\nSubject: t\n\nsecond\n> quoted\n\nFrom x\nFrom: A <a@x>\nDate: Tue, 14 Jul 2026 12:00:00 +0000\nSubject: t\n\nfirst\n"
    md, _, _ = cv.mail("m.mbox", box)
    assert md == "# t\n\n## 2026-07-14 A\n\nfirst\n\n## 2026-07-15 B\n\nsecond\n"
    assert [s["body"] for s in mailthread.split_thread("hi\n\nOn Tue, 14 Jul 2026 at 09:00 Bob\n<b@x.example> wrote:\n> old")] == ["hi", "old"]
    assert mailthread.strip_signature("Text\n\nBest\n\nAnn Lee\n+49 555 0123456\nwww.x.example") == "Text\n\nBest"
    with pytest.raises(ValueError):
        cv.mail("e.eml", b"")


def test_mhtml():
    m = b'MIME-Version: 1.0\nDate: Wed, 15 Jul 2026 12:00:00 +0000\nContent-Type: multipart/related; boundary="b"\n\n--b\nContent-Type: text/html; charset="utf-8"\nContent-Transfer-Encoding: quoted-printable\n\n<html><h1>Caf=C3=A9</h1><p style=3D"x">Body</p></html>\n--b--\n'
    md, title, at = cv.mhtml("p.doc", m)
    assert (title, md) == ("Café", "# Café\n\nBody") and at.day == 15


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# A\n\ntext")
    (tmp_path / "sub" / "b.csv").write_text("x,y\n1,2\n")
    (tmp_path / "bad.docx").write_bytes(b"PK\x03\x04broken")
    (tmp_path / "skip.exe").write_bytes(b"x")
    (tmp_path / "scan.pdf").write_bytes(b"%PDF")
    rows = {r.source_path.rsplit("/", 1)[-1]: r for r in cv.convert_files(cv.scan_folder(spark, str(tmp_path))).collect()}
    assert set(rows) == {"a.md", "b.csv", "bad.docx", "scan.pdf"}
    assert rows["a.md"].title == "A" and rows["a.md"].source_modified_at is not None and rows["bad.docx"].error and rows["bad.docx"].markdown is None and "Pdf" in rows["scan.pdf"].error

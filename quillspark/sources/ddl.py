"""A tolerant reader of SQL schema dumps: a cursor walks the tokens of each statement, and what it can't read is counted.

A dump is cut into tokens once (strings, dollar-quoted bodies, quoted names, words, marks; comments and white space are only gaps). A
statement is the tokens up to a semicolon. Its first keyword says how to go on; brackets are taken as token groups, so nothing is
searched for in a statement's text. Unknown statements are never an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

_TOKENS = re.compile(
    r"(?P<gap>\s+|--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<body>\$(?P<tag>\w*)\$.*?(?:\$(?P=tag)\$|\Z))|(?P<string>'(?:[^']|'')*(?:'|\Z))"
    r"|(?P<quoted>\"[^\"]*\"|`[^`]*`|\[[^\]\n]*\])|(?P<word>\w+)|(?P<mark>.)",
    re.S,
)
# The SQL keywords this reader gives a meaning.
_DATA_VERBS = {"COPY", "DELETE", "INSERT", "MERGE", "TRUNCATE", "UPDATE"}
_OBJECTS = {"DOMAIN", "EXTENSION", "FUNCTION", "INDEX", "PROCEDURE", "SCHEMA", "SEQUENCE", "TRIGGER", "TYPE", "VIEW"}
_NOT_A_COLUMN = {"CHECK", "CONSTRAINT", "EXCLUDE", "FOREIGN", "INDEX", "KEY", "LIKE", "PRIMARY", "UNIQUE"}
_COUNTERS = {"AUTO_INCREMENT", "GENERATED", "IDENTITY"}
_END_OF_TYPE = {"CHECK", "COLLATE", "CONSTRAINT", "DEFAULT", "NOT", "NULL", "PRIMARY", "REFERENCES", "UNIQUE"} | _COUNTERS
#: The order in which a column's flags are shown; a default comes last.
_FLAG_ORDER = ("PK", "NOT NULL", "UNIQUE", "auto")
#: Characters of a view's definition that are shown; the longest leftover that isn't worth counting.
VIEW_CHARS, SCRAP = 240, 3


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    apart: bool  # whether something that is no token came before

    @property
    def key(self) -> str:
        return self.text.upper() if self.kind == "word" else ""

    @property
    def plain(self) -> str:
        """A name without its quotes; a string's content."""
        if self.kind == "string":
            return self.text[1:].removesuffix("'").replace("''", "'")
        return self.text.strip('"`[] ') if self.kind == "quoted" else self.text


def tokens(sql: str) -> Iterator[Token]:
    apart = False
    for m in _TOKENS.finditer(sql):
        if m.lastgroup != "gap" and not m["gap"]:
            kind = "body" if m["body"] else m.lastgroup
            yield Token(kind, m[0], apart)
        apart = bool(m["gap"])


def written(part: list[Token]) -> str:
    """Tokens as text, every gap as one space."""
    return "".join((" " if t.apart and i else "") + " ".join(t.text.split()) for i, t in enumerate(part))


class Cursor:
    """A place in a statement's tokens."""

    def __init__(self, part: list[Token]):
        self.part, self.at = part, 0

    def __bool__(self) -> bool:
        return self.at < len(self.part)

    def here(self) -> Token:
        return self.part[self.at] if self else Token("end", "", True)

    def next(self) -> Token:
        t = self.here()
        self.at += 1
        return t

    def take(self, *keys: str) -> bool:
        """Steps over these keywords if they come next, all of them."""
        if [t.key for t in self.part[self.at : self.at + len(keys)]] != list(keys):
            return False
        self.at += len(keys)
        return True

    def skip(self, keys: set[str]) -> None:
        while self and self.here().key in keys:
            self.at += 1

    def seek(self, *keys: str) -> bool:
        """Goes on to just behind these keywords; to the end where they don't come."""
        while self:
            if self.take(*keys):
                return True
            self.at += 1
        return False

    def name(self) -> str:
        """A name of one or more parts with dots between; empty where none comes next."""
        parts = []
        while self.here().kind in ("word", "quoted"):
            parts.append(self.next().plain)
            if self.here().text != ".":
                break
            self.at += 1
        return ".".join(parts)

    def group(self) -> list[Token]:
        """The tokens within the bracket that opens here, none where no bracket does; an open one ends with the statement."""
        if self.here().text != "(":
            return []
        depth, first = 0, self.at + 1
        while self:
            t = self.next()
            depth += {"(": 1, ")": -1}.get(t.text, 0) if t.kind == "mark" else 0
            if not depth:
                return self.part[first : self.at - 1]
        return self.part[first:]


def items(part: list[Token]) -> list[list[Token]]:
    """The parts between commas outside of brackets."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in part:
        if t.kind == "mark":
            depth += {"(": 1, ")": -1}.get(t.text, 0)
            if t.text == "," and not depth:
                out.append([])
                continue
        out[-1].append(t)
    return [x for x in out if x]


def _names(part: list[Token]) -> str:
    return ", ".join(n for n in (Cursor(x).name() for x in items(part)) if n)


def same_table(a: str, b: str) -> bool:
    return a.rsplit(".", 1)[-1].lower() == b.rsplit(".", 1)[-1].lower()


@dataclass
class Schema:
    """What a dump declares."""

    tables: list[dict] = field(default_factory=list)
    foreign_keys: list[dict] = field(default_factory=list)
    others: list[str] = field(default_factory=list)
    data_statements: int = 0
    unrecognized: int = 0

    def link(self, table: str, own: str, c: Cursor) -> None:
        """The foreign key whose target the cursor stands at."""
        self.foreign_keys.append({"from_table": table, "from_columns": own, "to_table": c.name(), "to_columns": _names(c.group())})

    def read(self, statement: list[Token]) -> None:
        c = Cursor(statement)
        verb = c.next().key
        if verb in _DATA_VERBS:
            self.data_statements += 1
        elif not {"CREATE": self.create, "ALTER": self.alter, "COMMENT": self.remark}.get(verb, lambda _: False)(c) and len(written(statement)) > SCRAP:
            self.unrecognized += 1

    def create(self, c: Cursor) -> bool:
        while c and c.here().key not in _OBJECTS | {"TABLE"}:
            if c.next().kind != "word":
                return False
        kind = c.next().key
        c.take("CONCURRENTLY")
        c.take("IF", "NOT", "EXISTS")
        name = c.name()
        if not name:
            return False
        if kind == "TABLE":
            return self.table(name, c)
        line = f"{kind} {name}"
        if kind == "VIEW" and c.seek("AS"):
            body = written(c.part[c.at :])
            line += " AS " + (body[:VIEW_CHARS] + "…" if len(body) > VIEW_CHARS else body)
        elif kind == "TYPE" and c.seek("AS", "ENUM"):
            line += " AS ENUM (" + ", ".join(x[0].plain for x in items(c.group())) + ")"
        elif kind == "INDEX" and c.seek("ON"):
            line += f" on {c.name()} ({_names(c.group())})"
        self.others.append(line)
        return True

    def table(self, name: str, c: Cursor) -> bool:
        if c.here().text != "(":
            return False
        columns, primary = [], set()
        for item in items(c.group()):
            i = Cursor(item)
            if i.here().key not in _NOT_A_COLUMN:
                columns.append(self.column(name, i))
                continue
            while i:
                if i.take("PRIMARY", "KEY"):
                    primary |= set(_names(i.group()).lower().split(", "))
                elif i.take("FOREIGN", "KEY"):
                    own = _names(i.group())
                    if i.seek("REFERENCES"):
                        self.link(name, own, i)
                else:
                    i.at += 1
        for x in columns:
            if x["name"].lower() in primary and "PK" not in x["flags"]:
                x["flags"].insert(0, "PK")
        self.tables.append({"name": name, "columns": columns, "comment": None})
        return True

    def column(self, table: str, c: Cursor) -> dict:
        name, start = c.next().plain, c.at
        while c and c.here().key not in _END_OF_TYPE:
            c.group() or c.next()
        kind, flags, default, note = written(c.part[start : c.at]), set(), None, None
        while c:
            if c.take("PRIMARY", "KEY"):
                flags.add("PK")
            elif c.take("NOT", "NULL"):
                flags.add("NOT NULL")
            elif c.take("UNIQUE"):
                flags.add("UNIQUE")
            elif c.take("REFERENCES"):
                self.link(table, name, c)
            elif c.take("DEFAULT"):  # up to the next gap outside of brackets
                at = c.at
                c.group() or c.next()
                while c and not c.here().apart:
                    c.group() or c.next()
                default = written(c.part[at : c.at])
            elif c.take("COMMENT"):
                note = c.next().plain
            else:
                if c.here().key in _COUNTERS:
                    flags.add("auto")
                c.group() or c.next()
        shown = [f for f in _FLAG_ORDER if f in flags] + ([f"DEFAULT {default}"] if default else [])
        return {"name": name, "type": kind, "flags": shown, "comment": note}

    def alter(self, c: Cursor) -> bool:
        if not c.take("TABLE"):
            return False
        c.skip({"ONLY", "IF", "EXISTS"})
        name, found = c.name(), False
        while c.seek("FOREIGN", "KEY"):
            own = _names(c.group())
            if c.seek("REFERENCES"):
                self.link(name, own, c)
                found = True
        return found

    def remark(self, c: Cursor) -> bool:
        if not c.take("ON") or c.here().key not in ("TABLE", "COLUMN"):
            return False
        on_table, target = c.next().key == "TABLE", c.name()
        if not c.take("IS") or c.here().kind != "string":
            return False
        owner, column = (target, None) if on_table else target.rpartition(".")[::2]
        for t in self.tables:
            if same_table(t["name"], owner):
                for x in [t] if on_table else t["columns"]:
                    if on_table or x["name"].lower() == column.lower():
                        x["comment"] = x["comment"] or c.here().plain
                break
        return True


def parse(sql: str) -> dict:
    """{tables, foreign_keys, others, data_statements, unrecognized}."""
    schema, statement = Schema(), []
    for t in tokens(sql + ";"):
        if t.kind == "mark" and t.text == ";":
            if statement:
                schema.read(statement)
            statement = []
        else:
            statement.append(t)
    if statement:  # a string or comment was left open
        schema.read(statement)
    return vars(schema)


def render(schema: dict) -> str:
    """A section per table, with foreign keys at their columns and where the table is referenced; then relationships and other objects."""
    out = []
    for t in schema["tables"]:
        keys = [k for k in schema["foreign_keys"] if same_table(k["from_table"], t["name"])]
        part = [f"## Table: {t['name']}", *([t["comment"]] if t["comment"] else [])]
        rows = []
        for c in t["columns"]:
            ends = [k["to_table"] + (f"({k['to_columns']})" if k["to_columns"] else "") for k in keys if c["name"].lower() in [x.strip().lower() for x in k["from_columns"].split(",")]]
            notes = [*c["flags"], *(f"FK → {e}" for e in ends)]
            rows.append(f"- {c['name']} {c['type']}" + (f" — {', '.join(notes)}" if notes else "") + (f" — {c['comment']}" if c["comment"] else ""))
        part += ["\n".join(rows)] if rows else []
        back = list(dict.fromkeys(f"{k['from_table']} ({k['from_columns']})" for k in schema["foreign_keys"] if same_table(k["to_table"], t["name"]) and not same_table(k["from_table"], t["name"])))
        part += ["Referenced by: " + ", ".join(back)] if back else []
        out.append("\n\n".join(part))
    if schema["foreign_keys"]:
        out.append("## Relationships\n\n" + "\n".join(f"- {k['from_table']} ({k['from_columns']}) → {k['to_table']}" + (f" ({k['to_columns']})" if k["to_columns"] else "") for k in schema["foreign_keys"]))
    if schema["others"]:
        out.append("## Other objects\n\n" + "\n".join(f"- {o}" for o in schema["others"]))
    counts = [f"{n} {what} statement{'' if n == 1 else 's'}" for n, what in ((schema["data_statements"], "data"), (schema["unrecognized"], "other")) if n]
    return "\n\n".join([*out, *(["Also contains: " + ", ".join(counts) + "."] if counts else [])])

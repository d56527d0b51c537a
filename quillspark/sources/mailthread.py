"""Mail files: one section per message, oldest first, without signatures and repeated history."""

from __future__ import annotations

import email
import email.policy
import email.utils
import re
from datetime import datetime, timezone

from quillspark.functions.text import REPLY_PREFIX

# The header fields and introductions that mail programs set before an earlier message.
_HEADER = re.compile(r"^\*?(From|Sent|Date|To|Cc|Subject|Von|Gesendet|An|Betreff|De|Envoyé|À|Objet)\*?\s*:\*?\s*(.*)$", re.I)
_WROTE = re.compile(r"^(?:On|Am|Le|El)\s.{4,200}?(?:wrote|schrieb.*|a écrit|escribió)\s*:\s*$", re.I | re.S)
_DELIMITER = re.compile(r"^(?:--\s?|_{5,}|—)$")
_NOTICE = re.compile(r"\b(?:confidential|intended (?:only|solely) for|privileged|disclaimer|vertraulich|confidentiel)\b", re.I)
_CONTACT = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+|https?://|www\.|\+?\d[\d ()./-]{6,}\d|^\s*(?:tel|phone|mobile|mob|fax|t|m)\b[.:]", re.I)


def parse_time(s: str | None) -> datetime | None:
    """A mail's or a header block's date, with `` at `` between day and time allowed; null where it can't be read."""
    s = re.sub(r"\s+at\s+", " ", (s or "").strip())
    for f in ("%A, %B %d, %Y %I:%M %p", "%A, %B %d, %Y %I:%M:%S %p", "%B %d, %Y %I:%M %p", "%d %B %Y %H:%M", "%a, %b %d, %Y %I:%M %p", "%Y-%m-%d %H:%M", "%m/%d/%Y %I:%M %p"):
        try:
            return datetime.strptime(s, f).replace(tzinfo=timezone.utc)
        except ValueError:
            pass
    try:
        t = email.utils.parsedate_to_datetime(s)
        return (t if t.tzinfo else t.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)
    except (ValueError, TypeError):
        return None


def _boundary(lines: list[str], i: int) -> tuple[int, str | None, datetime | None] | None:
    """(lines taken, sender, date) where an earlier message is introduced at line i."""
    m = _HEADER.match(lines[i].strip())
    if m and m[1].lower() in ("from", "von", "de"):
        fields = {}
        n = 0
        while i + n < len(lines) and n < 8 and (f := _HEADER.match(lines[i + n].strip())):
            fields.setdefault(f[1].lower(), f[2].strip())
            n += 1
        when = next((fields[k] for k in ("sent", "date", "gesendet", "envoyé") if k in fields), None)
        if when is not None:
            return n, _name(m[2]), parse_time(when)
    for n in (1, 2, 3):
        text = " ".join(x.strip() for x in lines[i : i + n])
        if _WROTE.match(text):
            named = re.search(r"([^,<>]+?)\s*(?:<[^>]*>)?\s*(?:wrote|schrieb|a écrit|escribió)", text)
            when = re.search(r"(?:On|Am|Le|El)\s+(.*?\d{4}(?:.{0,4}?\d{1,2}:\d{2}(?:\s?[AP]M)?)?)", text)
            return n, _name(named[1]) if named else None, parse_time(when[1]) if when else None
    return None


def _name(s: str) -> str | None:
    if "@" not in s:
        return s.strip().strip('"') or None
    n, a = email.utils.parseaddr(s)
    return (n or a or s).strip().strip('"') or None


def strip_signature(text: str) -> str:
    """The text without what follows a signature delimiter, a closing notice, or a block of short lines that are mostly contact data."""
    lines = text.split("\n")
    for i, x in enumerate(lines):
        if _DELIMITER.match(x.rstrip()) and i:
            lines = lines[:i]
            break
    blocks = re.split(r"\n\s*\n", "\n".join(lines).strip())
    while len(blocks) > 1:
        rows = [r for r in blocks[-1].split("\n") if r.strip()]
        contact = sum(bool(_CONTACT.search(r)) for r in rows)
        card = len(rows) <= 8 and all(len(r) <= 60 for r in rows) and contact * 2 >= len(rows) and contact
        if not (_NOTICE.search(blocks[-1]) or card):
            break
        blocks.pop()
    return "\n\n".join(blocks).strip()


def split_thread(text: str) -> list[dict]:
    """The messages of a body, newest first: {sender, date, body}; the first has neither sender nor date of its own."""
    lines = [re.sub(r"^\s*(?:>\s?)+", "", x) for x in text.replace("\r\n", "\n").split("\n")]
    out = [{"sender": None, "date": None, "lines": []}]
    i = 0
    while i < len(lines):
        got = _boundary(lines, i) if lines[i].strip() else None
        if got:
            out.append({"sender": got[1], "date": got[2], "lines": []})
            i += got[0]
        else:
            out[-1]["lines"].append(lines[i])
            i += 1
    return [{"sender": s["sender"], "date": s["date"], "body": strip_signature("\n".join(s["lines"]).strip())} for s in out]


def without_history(text: str) -> str:
    """What stands above the first introduction of an earlier message, without quoted lines."""
    lines = text.replace("\r\n", "\n").split("\n")
    for i, x in enumerate(lines):
        if x.strip() and not x.lstrip().startswith(">") and _boundary(lines, i):
            lines = lines[:i]
            break
    return "\n".join(x for x in lines if not x.lstrip().startswith(">")).strip()


def subject_title(subject: str | None) -> str:
    return re.sub(REPLY_PREFIX, "", (subject or "").strip(), flags=re.I)


def _messages(content: bytes) -> list:
    if content.startswith(b"From "):
        parts = re.split(rb"(?m)^From [^\n]*\n", content)[1:]
        return [email.message_from_bytes(re.sub(rb"(?m)^>(>*From )", rb"\1", p), policy=email.policy.default) for p in parts]
    return [email.message_from_bytes(content, policy=email.policy.default)]


def _body(m, to_markdown) -> str:
    part = m.get_body(preferencelist=("plain", "html"))
    if part is None:
        return ""
    try:
        text = part.get_content()
    except (LookupError, KeyError):
        text = (part.get_payload(decode=True) or b"").decode("utf-8", errors="replace")
    return (to_markdown(text)[0] if part.get_content_type() == "text/html" else text).strip()


def convert(path: str, content: bytes, to_markdown) -> tuple[str, str, datetime | None]:
    """A single mail is cut into its thread; of a mailbox each message keeps its own words."""
    box = content.startswith(b"From ") or path.lower().endswith(".mbox")
    found = [m for m in _messages(content) if m.keys()]
    if not found:
        raise ValueError("no messages")
    low = datetime.min.replace(tzinfo=timezone.utc)
    found.sort(key=lambda m: parse_time(m["Date"]) or low)
    name = re.split(r"[/\\]", path)[-1].rsplit(".", 1)[0]
    title = subject_title(str(found[0]["Subject"] or "")) or name
    out = [f"# {title}"]
    for m in found:
        at = parse_time(m["Date"])
        top = f"{at:%Y-%m-%d} {_name(str(m['From'] or '')) or 'unknown sender'}" if at else f"undated {_name(str(m['From'] or '')) or 'unknown sender'}"
        raw = _body(m, to_markdown)
        parts = [(None, None, strip_signature(without_history(raw)))] if box else [(s["sender"], s["date"], s["body"]) for s in reversed(split_thread(raw))]
        for sender, date, body in parts:
            head = top if sender is None else f"{date:%Y-%m-%d} {sender}" if date else f"undated {sender}"
            safe = re.sub(r"(?m)^(#{1,6}\s)", r"\\\1", body)
            out.append(f"## {head}" + (f"\n\n{safe}" if safe else ""))
    return "\n\n".join(out) + "\n", title, parse_time(found[-1]["Date"])

"""Reducing each e-mail to what its sender newly wrote.

A body is cut into blocks: paragraphs, cut again where the quoting changes and around lines of their own kind
(introductions of quoted mail, header fields, separators, signature delimiters). Boosted trees classify the blocks by
contact density, quote depth, in how many threads the sender and others use the same lines, what share of the words the
thread's earlier messages hold, and the block's surroundings. No labels come with the data, so the trees are trained
on labels that follow from blocks where the evidence is plain (marked as quoted, found in an ancestor, below a delimiter;
or unique running text above all of these), in a sample of at most SAMPLE blocks, drawn by a hash; all statistics
are taken over all mails.

Skew: what an earlier message holds is one least position per (thread, word run), aggregated before the shuffle and
joined back by both, so no thread or sender is ever gathered. Only one mail's own lines meet in one row.

Defined results: null and empty bodies have no lines; blank lines are never listed. A null thread is a thread of its own.
Repeated messages (same sender, subject and body in a thread) are one message: a copy isn't its own ancestor. A message without
a date takes its place after its parent or before its replies, and without either counts as the latest of its thread. ``\\r\\n`` is read as ``\\n``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.boosting import Boosted
from quillspark.session import materialize

SAMPLE, RUN = 20_000, 6

# How mail programs of the four languages introduce earlier messages, name header fields, and mark devices.
_WROTE = r"(?:wrote|writes|said|schrieb|schreibt|sagte|a écrit|écrit|a dit|escribió|escribe|dijo)"
_FIELDS = r"(?:From|Sent|To|Cc|Bcc|Date|Subject|Reply-To|Von|Gesendet|An|Kopie|Datum|Betreff|De|Enviado|Enviado el|Para|CC|Fecha|Asunto|À|A|Envoyé|Objet)"
_FIELD = re.compile(rf"^\*?{_FIELDS}\s?\*?\s?:\*?\s")
_INTRO = re.compile(rf"(?:\b{_WROTE}\b[^.!?]{{0,60}}:\s*$)|(?:^(?:On|Am|Le|El)\b.{{0,90}}\d.{{0,60}}:\s*$)|(?:^.{{0,90}}\b{_WROTE}\b.{{0,40}}\d.{{0,20}}:\s*$)", re.I)
_INTRO_START = re.compile(rf"^(?:On|Am|Le|El)\b.{{0,60}}\d{{1,4}}|\b{_WROTE}\b(?:\s+(?:on|am|le|el)\b)?[^.!?]{{0,40}}$", re.I)
_FORWARD = re.compile(r"^[-=_*]{2,}\s*[^\n]{0,20}\b(?:original|forwarded|ursprüngliche|weitergeleitete|origine|transféré|réexpédié|reenviado)\b[^\n]{0,20}[-=_*]{2,}$|^(?:Begin forwarded message|Anfang der weitergeleiteten Nachricht|Début du message (?:transféré|réexpédié)|Inicio del mensaje reenviado)\s*:\s*$", re.I)
_DELIMITER = re.compile(r"^\s*(?:--|—|-{2,}|_{2,}|={3,}|\*{3,}|~{3,})\s*$")
_CONTACT = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|https?://\S+|www\.\S+|\+?\(?\d[\d ()./–-]{6,}\d")
_MARK = re.compile(r"^\s{0,3}(?:[>|:]|[A-Z]{1,3}>)(?:\s?(?:[>|:]|[A-Z]{1,3}>))*\s?")
_SURE_MARK = re.compile(r"^\s{0,3}(?:>|[A-Z]{1,3}>)")
_WORD = re.compile(r"[^\W_]+")
_NAME = re.compile(r"^[\W_]*([^\W\d_][\w'’.-]*)[\W_]*$")

_CLOSING = re.compile(r"\b(?:regards|thanks|cheers|soon|wishes|sincerely|best|grüße|grüßen|gruß|dank|danke|saludos?|gracias|abrazo|atentamente|pronto|cordialement|merci|bientôt|amicalement|vous)\b", re.I)
_DEVICE = re.compile(r"\b(?:sent from|get the|gesendet|gesendet von|envoyé de|envoyé depuis|rédigé sur|enviado desde|escrito desde|mobil\w*|móvil|tablets?|tableta|phone|téléphone|keyboard)\b", re.I)

_NOTICE = re.compile(
    r"\b(?:confidential\w*|vertraulich\w*|confidenti\w+|confidencial\w*|privileged|disclaimer|registered office|sitz der gesellschaft|siège social|domicilio social|HRB|GmbH|S\.?A\.?R\.?L|views (?:above|expressed)|no warranty|"
    r"intended (?:only|solely)|received (?:it|this) (?:by|in) (?:mistake|error)|irrtümlich|par erreur|por error|before printing|avant d'imprimer|antes de imprimir|ausdrucken)\b|\bLtd\.",
    re.I,
)

KINDS = ("text", "intro", "field", "forward", "delimiter")
FEATURES = (
    "depth", "intro", "field", "forward", "delimiter", "contacts", "ancestor", "words", "sender_share", "threads", "has_last_name", "is_first_name",
    "first_block", "after_closing", "after_delimiter", "after_history", "prev_quoted", "prev_open", "lower_start", "next_quoted", "ends_sentence", "words_a_line", "closing", "any_ancestor", "followed_by_quote", "delimiter_above_close", "closing_words", "device_words", "region_ancestor", "name_block", "notice",
)


def sender_key(sender: str | None) -> str:
    """Initial and last name, the same for ``Name Last``, ``n.last@host`` and both together; empty without a sender."""
    if not sender:
        return ""
    name = re.sub(r"<[^>]*>", " ", sender).replace('"', " ").strip()
    if not name or "@" in name:
        m = re.search(r"([\w.+-]+)@", sender)
        parts = [p for p in re.split(r"[._+-]", m.group(1)) if p] if m else []
    else:
        parts = name.split()
    parts = [p.lower() for p in parts]
    return f"{parts[0][0]}.{parts[-1]}" if len(parts) > 1 else parts[0] if parts else ""


def _hash(s: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s) - 2**63


def quoting(lines: list[str]) -> list[tuple[int, str]]:
    """(depth, text without marks) of each line. Bars and colons are marks only where at least two lines in a row have them and they are no table."""
    soft = [bool(_MARK.match(x)) and not _SURE_MARK.match(x) for x in lines]
    ok = [False] * len(lines)
    i = 0
    while i < len(lines):
        if soft[i]:
            j = i
            while j < len(lines) and soft[j] and lines[j].lstrip()[:1] == lines[i].lstrip()[:1]:
                j += 1
            rows = lines[i:j]
            table = lines[i].lstrip()[:1] == "|" and all(r.rstrip().endswith("|") and r.count("|") > 2 for r in rows)
            if j - i > 1 and not table or (i and ok[i - 1]):
                ok[i:j] = [True] * (j - i)
            i = j
        else:
            i += 1
    out = []
    for x, s, o in zip(lines, soft, ok):
        m = _MARK.match(x) if (o or not s) else None
        if not m:
            out.append((0, x))
            continue
        mark = m.group(0) if o or not s else ""
        if not o:  # a sure mark: stop before a bar or colon that belongs to the text
            mark = re.match(r"^\s{0,3}(?:>|[A-Z]{1,3}>)(?:\s?(?:>|[A-Z]{1,3}>))*\s?", x).group(0)
        out.append((max(1, len(re.findall(r"[>|:]", mark))), x[len(mark) :]))
    return out


def kinds(texts: list[tuple[int, str]]) -> list[str]:
    """The kind of each line; an introduction may take two or three lines."""
    out = []
    for d, t in texts:
        s = t.strip()
        out.append("delimiter" if _DELIMITER.match(s) else "forward" if _FORWARD.match(s) else "field" if _FIELD.match(s) else "intro" if len(s) < 140 and _INTRO.search(s) else "text")
    for i, (d, t) in enumerate(texts):
        if out[i] == "text" and len(t) < 100 and _INTRO_START.search(t.strip()):
            for j in (i + 1, i + 2):
                if j < len(texts) and texts[j][0] == d and texts[j][1].strip():
                    joined = " ".join(x.strip() for _, x in texts[i : j + 1])
                    if len(joined) < 160 and _INTRO.search(joined) and joined.endswith(":"):
                        out[i : j + 1] = ["intro"] * (j + 1 - i)
                        break
                else:
                    break
    return out


def blocks(body: str) -> list[dict]:
    """The blocks of a body: numbers and texts of their lines, quote depth and kind."""
    lines = body.replace("\r\n", "\n").split("\n")
    texts = quoting(lines)
    kind = kinds(texts)
    # a lone field line is running text; header fields come in runs
    for i, k in enumerate(kind):
        if k == "field" and not any(0 <= j < len(kind) and kind[j] == "field" for j in (i - 1, i + 1)):
            kind[i] = "text"
    out: list[dict] = []
    cur, gap = None, True
    for i, ((d, t), k) in enumerate(zip(texts, kind)):
        if not t.strip():
            if d and lines[i].strip():  # a bare mark belongs to the quoted text
                out.append({"lines": [i], "texts": [""], "depth": d, "kind": "text", "gap": True})
            cur, gap = None, True
            continue
        short_name = cur is not None and len(cur["lines"]) > 1 and len(cur["texts"][-1].split()) == 1 and _NAME.match(cur["texts"][-1].strip()) and len(cur["texts"][-2].split()) <= 6
        if cur is None or cur["depth"] != d or cur["kind"] != k or short_name:
            cur = {"lines": [], "texts": [], "depth": d, "kind": k, "gap": gap}
            out.append(cur)
        cur["lines"].append(i)
        cur["texts"].append(t)
        gap = False
    return out


def _line_form(t: str) -> str:
    return re.sub(r"\d+", "0", " ".join(t.lower().split()))


def _runs(words: list[str]) -> list[int]:
    return [_hash(" ".join(words[i : i + RUN])) for i in range(len(words) - RUN + 1)]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block with the hashes of its lines and word runs."""
    for b in batches:
        src, no, forms, runs, same = [], [], [], [], []
        for i, (body, sender, subject) in enumerate(zip(*(b.column(c).to_pylist() for c in ("body", "sender", "subject")))):
            key = sender_key(sender)
            whole = _hash(f"{key}\0{subject}\0{body}")
            for k, bl in enumerate(blocks(body or "")):
                src.append(i)
                no.append(k)
                same.append((_hash(key), whole))
                forms.append([_hash(_line_form(t)) for t in bl["texts"] if t.strip()])
                runs.append(list(dict.fromkeys(_runs(_WORD.findall(" ".join(bl["texts"]).lower())))))
        take = pa.array(src, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column("email_id").take(take), b.column("thread").take(take), b.column("at").take(take), pa.array([s for s, _ in same], pa.int64()), pa.array([w for _, w in same], pa.int64()), pa.array(no, pa.int32()), pa.array(forms, pa.list_(pa.int64())), pa.array(runs, pa.list_(pa.int64()))],
            ["email_id", "thread", "at", "sender", "message", "block", "forms", "runs"],
        )


def _block_statistics(emails: DataFrame) -> DataFrame:
    """(email_id, block, ancestor, sender_share, threads) over the whole table."""
    t = F.coalesce(F.col("thread_id").cast("string"), F.concat(F.lit("mail "), F.col("email_id").cast("string")))
    parents = emails.filter("sent_at IS NOT NULL").groupBy(F.col("email_id").alias("in_reply_to")).agg(F.max("sent_at").alias("_parent"))
    children = emails.filter("in_reply_to IS NOT NULL AND sent_at IS NOT NULL").groupBy(F.col("in_reply_to").alias("email_id")).agg(F.min("sent_at").alias("_child"))
    late = F.lit(2**62)
    src = emails.join(parents, "in_reply_to", "left").join(children, "email_id", "left").select(
        F.col("email_id").cast("long").alias("email_id"), F.xxhash64(t).alias("thread"), F.coalesce(F.unix_micros("sent_at"), F.unix_micros("_parent") + 1, F.unix_micros("_child") - 1, late).alias("at"), "sender", "subject", "body"
    )
    made = materialize(src.mapInArrow(_parse, "email_id long, thread long, at long, sender long, message long, block int, forms array<long>, runs array<long>"), "mail-blocks")
    # copies of a message take the position of the earliest one
    when = made.groupBy("thread", "message").agg(F.min("at").alias("first_at"))
    placed = made.join(when, ["thread", "message"])
    own = placed.select("email_id", "block", "thread", "first_at", F.explode("runs").alias("run"))
    first = own.groupBy("thread", "run").agg(F.min("first_at").alias("seen"))
    ancestor = own.join(first, ["thread", "run"]).groupBy("email_id", "block").agg(F.avg((F.col("seen") < F.col("first_at")).cast("double")).alias("ancestor"))
    # counted by threads: within one, a line recurs because it is quoted
    form = made.select("email_id", "block", "sender", "thread", F.explode("forms").alias("form"))
    uses = form.groupBy("form", "sender", "thread").agg(F.lit(1).alias("one")).groupBy("form", "sender").agg(F.count("one").alias("uses"))
    of_sender = made.groupBy("sender", "thread").agg(F.lit(1).alias("one")).groupBy("sender").agg(F.count("one").alias("all"))
    spread = form.groupBy("form", "thread").agg(F.lit(1).alias("one")).groupBy("form").agg(F.count("one").alias("threads"))
    lines = form.select("email_id", "block", "form", "sender").join(uses, ["form", "sender"]).join(of_sender, "sender").join(spread, "form")
    freq = lines.groupBy("email_id", "block").agg(F.avg(F.when(F.col("uses") > 1, F.col("uses") / F.col("all")).otherwise(0.0)).alias("sender_share"), F.avg(F.log1p("threads")).alias("threads"))
    return made.select("email_id", "block").join(ancestor, ["email_id", "block"], "left").join(freq, ["email_id", "block"], "left").fillna(0.0, ["ancestor", "sender_share", "threads"])


def features(body: str, sender: str | None, stats: dict[int, tuple[float, float, float]]) -> tuple[list[dict], np.ndarray, np.ndarray]:
    """(blocks, features, plain labels): label 1 is not newly written, 0 newly written, -1 undecided."""
    bl = blocks(body)
    key = sender_key(sender)
    last, initial = key.rpartition(".")[2] if "." in key else "", key[:1]
    n = len(bl)
    x = np.zeros((n, len(FEATURES)))
    label = np.full(n, -1)
    closing = delimiter = history = False
    # what share of the running text below an unmarked header the thread holds: low where the ancestor is lost
    marks = [i for i, b in enumerate(bl) if not b["depth"] and b["kind"] in ("field", "forward")]
    below = [stats.get(i, (0.0,))[0] for i in range(marks[0], n) if len(" ".join(bl[i]["texts"]).split()) >= 8 and bl[i]["kind"] == "text"] if marks else []
    region = float(np.mean(below)) if below else 0.0
    at = {f: i for i, f in enumerate(FEATURES)}
    for i, b in enumerate(bl):
        text = " ".join(b["texts"])
        words = _WORD.findall(text)
        ancestor, share, threads = stats.get(i, (0.0, 0.0, 0.0))
        prev, nxt = (bl[i - 1] if i else None), (bl[i + 1] if i + 1 < n else None)
        contacts = sum(len(m) for m in _CONTACT.findall(text)) / max(1, len(text))
        names = [w.lower() for w in words]
        lines = [t.strip() for t in b["texts"]]
        tail = _NAME.match(lines[-1]) if lines[-1] else None
        first_name = bool(tail and tail.group(1)[:1].isupper() and (not initial or tail.group(1)[:1].lower() == initial) and tail.group(1).lower() != last)
        short = len(lines) <= 3 and len(words) <= 9 and not contacts
        device = bool(len(words) <= 9 and _DEVICE.search(text) and not _CLOSING.search(lines[0]))
        closing_words = bool(len(lines[0].split()) <= 7 and _CLOSING.search(lines[0]))
        is_closing = bool(b["depth"] == 0 and b["kind"] == "text" and i and short and closing_words and not device and not (last and last in names))
        name_block = bool(b["kind"] == "text" and len(words) / len(lines) <= 6 and len(words) <= 24 and (last and last in [w.lower() for w in _WORD.findall(lines[0])]) and (len(lines) > 1 or contacts or len(words) <= 3))
        notice = bool(i and b["kind"] == "text" and len(words) <= 45 and _NOTICE.search(text))
        quoted_after = any(y["depth"] for y in bl[i + 1 :])
        v = {
            "depth": b["depth"], "intro": b["kind"] == "intro", "field": b["kind"] == "field", "forward": b["kind"] == "forward", "delimiter": b["kind"] == "delimiter",
            "contacts": contacts, "ancestor": ancestor, "words": len(words), "sender_share": share, "threads": threads,
            "has_last_name": bool(last and last in names), "is_first_name": first_name, "first_block": i == 0,
            "after_closing": closing, "after_delimiter": delimiter, "after_history": history,
            "prev_quoted": bool(prev and prev["depth"] and not b["gap"]), "prev_open": bool(prev and prev["texts"][-1].strip() and not prev["texts"][-1].rstrip().endswith((".", "!", "?", ":", ",", ";"))),
            "lower_start": text[:1].islower(), "next_quoted": bool(nxt and nxt["depth"]), "ends_sentence": text.rstrip().endswith((".", "!", "?", ":", ",")), "words_a_line": len(words) / len(lines),
            "closing": is_closing, "any_ancestor": ancestor > 0.3, "followed_by_quote": quoted_after, "delimiter_above_close": bool(prev and prev["kind"] == "delimiter"),
            "closing_words": closing_words, "device_words": device, "region_ancestor": region if history else 0.0, "name_block": name_block, "notice": notice,
        }
        for f, val in v.items():
            x[i, at[f]] = float(val)
        # plain evidence only; the rest is left to the trees
        if b["depth"] or b["kind"] in ("intro", "field", "forward"):
            label[i] = 1
        elif b["kind"] == "delimiter":
            label[i] = 1
        elif prev and prev["depth"] and not b["gap"] and (text[:1].islower() or v["prev_open"]):
            label[i] = 1
        elif history and (ancestor >= 0.3 or len(words) < 8 or region < 0.3):
            label[i] = 1
        elif i == 0 and ancestor < 0.5:
            label[i] = 0
        elif device or name_block or (notice and (closing or delimiter or i == n - 1 or bl[i + 1]["kind"] != "text" or bl[i + 1]["depth"])):
            label[i] = 1
        elif len(words) >= 8 and ancestor >= 0.5:
            label[i] = 1
        elif delimiter and (last and last in names or contacts > 0.15 or share > 0.4):
            label[i] = 1
        elif contacts > 0.25 and len(words) < 25 and (share > 0.3 or last and last in names):
            label[i] = 1
        elif len(words) >= 7 and threads > np.log1p(4) and ancestor < 0.7:
            label[i] = 1
        elif (closing or delimiter) and len(words) <= 8 and threads > np.log1p(4) and not is_closing and not first_name:
            label[i] = 1
        elif i == 0 and len(words) <= 8 and b["kind"] == "text":
            label[i] = 0
        elif prev and prev["depth"] and b["gap"] and not history and len(words) <= 5 and lines[-1].endswith((",", ":", "-")) and len(lines) == 1:
            label[i] = 0
        elif is_closing and not delimiter:
            label[i] = 0
        elif closing and first_name and len(words) == 1 and not delimiter:
            label[i] = 0
        elif len(words) >= 8 and ancestor <= 0.3 and threads <= np.log1p(1.5) and share == 0 and not contacts > 0.1 and not delimiter and not closing and not history:
            label[i] = 0
        elif len(words) >= 8 and ancestor <= 0.2 and threads <= np.log1p(1.5) and share == 0 and contacts < 0.1 and prev and prev["depth"] and b["gap"]:
            label[i] = 0
        if b["depth"] == 0:
            if b["kind"] == "delimiter":
                delimiter = True
            elif b["kind"] in ("forward", "field"):
                history, closing, delimiter = True, False, False
            elif b["kind"] == "intro":
                closing = delimiter = False
            elif is_closing:
                closing = True
            elif len(words) >= 8 and threads <= np.log1p(1.5) and contacts < 0.1:
                closing = delimiter = False
        else:
            closing = delimiter = False
    return bl, x, label


def _feature_table(emails: DataFrame) -> DataFrame:
    """(email_id, lines, x, y): of each mail's blocks the line numbers, the features and the plain labels, written once."""
    s = _block_statistics(emails).groupBy("email_id").agg(F.collect_list(F.struct("block", "ancestor", "sender_share", "threads")).alias("stats"))
    mails = emails.select(F.col("email_id").cast("long").alias("email_id"), "sender", "body").join(s, "email_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, xs, ys = [], [], []
            for sender, body, stats in zip(*(b.column(c).to_pylist() for c in ("sender", "body", "stats"))):
                bl, x, y = features(body or "", sender, {s["block"]: (s["ancestor"], s["sender_share"], s["threads"]) for s in stats})
                lines.append([block["lines"] for block in bl])
                xs.append(x.ravel())
                ys.append(y)
            flat = lambda parts, kind: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(np.concatenate(parts) if parts else np.empty(0), kind))
            yield pa.RecordBatch.from_arrays([b.column("email_id"), pa.array(lines, pa.list_(pa.list_(pa.int32()))), flat(xs, pa.float64()), flat(ys, pa.int32())], ["email_id", "lines", "x", "y"])

    return materialize(mails.mapInArrow(run, "email_id long, lines array<array<int>>, x array<double>, y array<int>"), "mail-features")


def _train(table: DataFrame) -> Boosted:
    # whole mails by a hash: about five blocks each, so this share of them holds the sample; the limit only bounds the excess
    n = max(1, table.count())
    share = F.pmod(F.xxhash64("email_id"), F.lit(1_000_000)) < max(1, int(1_000_000 * min(1.0, SAMPLE / 5 / n)))
    mails = table.filter(share).select("x", "y").limit(SAMPLE).collect()
    x = np.concatenate([np.reshape(r.x, (-1, len(FEATURES))) for r in mails]) if mails else np.empty((0, len(FEATURES)))
    y = np.concatenate([np.asarray(r.y, dtype=float) for r in mails]) if mails else np.empty(0)
    x, y = x[y >= 0][:SAMPLE], y[y >= 0][:SAMPLE]
    if len(set(y)) < 2:  # nothing to learn from: what is marked as quoted decides
        x = np.vstack([x, np.zeros((1, len(FEATURES))), np.eye(1, len(FEATURES))])
        y = np.append(y, [0.0, 1.0])
    return Boosted().fit(x, y)


def not_new_lines(emails: DataFrame) -> DataFrame:
    """(email_id, line_no) of every non-blank line that isn't newly written."""
    table = _feature_table(emails)
    model = _train(table)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column("x").flatten()).reshape(-1, len(FEATURES))
            gone = (model.score(x) > 0.5) if len(x) else np.empty(0, dtype=bool)
            ids, nos, k = [], [], 0
            for e, blocks_ in zip(b.column("email_id").to_pylist(), b.column("lines").to_pylist()):
                for lines in blocks_:
                    if gone[k]:
                        ids += [e] * len(lines)
                        nos += lines
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32())], ["email_id", "line_no"])

    return table.mapInArrow(classify, "email_id long, line_no int")


def newly_written(emails: DataFrame) -> DataFrame:
    """(email_id, body): each body reduced to its newly written lines, runs of blank lines as one; a null body stays null."""
    gone = not_new_lines(emails).groupBy("email_id").agg(F.collect_set("line_no").alias("_gone"))
    lines = F.split(F.replace("body", F.lit("\r\n"), F.lit("\n")), "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.array_contains(F.coalesce("_gone", F.array().cast("array<int>")), i))
    text = F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\n(?:[ \t]*\n){2,}", "\n\n"))
    return emails.select(F.col("email_id").cast("long").alias("email_id"), "body").join(gone, "email_id", "left").select("email_id", F.regexp_replace(text, r"^\s+|\s+$", "").alias("body"))

import datetime as dt
import random

import numpy as np
import pytest

from quillspark.llm import mail_parts as mp
from quillspark.llm.boosting import Boosted

SCHEMA = "email_id long, thread_id long, in_reply_to long, sender string, sent_at timestamp, subject string, body string"


def test_boosting_learns():
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = Boosted().fit(x[:1500], y[:1500])
    assert ((m.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95 and len(m.score(x[:0])) == 0


@pytest.mark.parametrize("s,key", [("Torul Calfi <t.calfi@x.example>", "t.calfi"), ("t.calfi@x.example", "t.calfi"), ("Torul Calfi", "t.calfi"), (None, ""), ("", "")])
def test_sender_key(s, key):
    assert mp.sender_key(s) == key


def test_kinds_of_lines():
    lines = ["On 04/29/2025, Ann Lee", "<a.lee@x.example> wrote:", "From: Ann Lee", "Sent: Monday", "----- Ursprüngliche Nachricht -----", "--", "----- nothing special here -----", "On Tuesday Ann wrote a note about it and asked us to wait.", "Ann Lee said:", "Am 12. August 2025 um 07:23 schrieb Ann Lee:"]
    assert mp.kinds([(0, x) for x in lines]) == ["intro", "intro", "field", "field", "forward", "delimiter", "text", "text", "intro", "intro"]


def test_marks():
    assert [d for d, _ in mp.quoting(["> a", "> > b", "AB> c", "| x", "| y", "plain", "| a | b |", "| 1 | 2 |", ": q", ": r", "a: b"])] == [1, 2, 1, 1, 1, 0, 0, 0, 1, 1, 0]


def mails(seed=1, threads=120):
    """Threads with known new lines: (rows, {(email_id, line_no)} of what isn't new)."""
    r = random.Random(seed)
    firsts, lasts = "Ann Bob Cora Dan Eve Finn Gus Hana".split(), "Lee Moor Nash Orr Pike Quinn Reed Shaw".split()
    nouns = "report ticket queue policy window owner session access record table branch release".split()
    rows, gone = [], set()
    for t in range(threads):
        people = [(f, x) for f, x in zip(r.sample(firsts, 2), r.sample(lasts, 2))]
        prev = None
        for k in range(r.randint(1, 4)):
            f, x = people[k % 2]
            text = [f"The {r.choice(nouns)} of {r.choice(nouns)}{r.randint(0, 999)} changed after {r.choice(nouns)} {r.randint(0, 9999)} was moved to {r.choice(nouns)}{r.randint(0, 999)} by us." for _ in range(r.randint(1, 3))]
            lines = [(f"Hello {people[(k + 1) % 2][0]},", 0), ("", 0), *((s, 0) for s in text), ("", 0), ("Best regards,", 0), (f, 0)]
            if r.random() < 0.7:
                lines += [("", 0), ("--", 1), (f"{f} {x} | Works", 1), (f"{f[0].lower()}.{x.lower()}@works.example", 1)]
            if prev and r.random() < 0.9:
                pf, px = people[(k + 1) % 2]
                lines += [("", 0), (f"On 2025-01-0{k + 1} 10:00, {pf} {px} wrote:", 1), *((f"> {s}", 1) for s in prev)]
            prev = [s for s, _ in lines]
            i = len(rows) + 1
            gone |= {(i, n) for n, (s, g) in enumerate(lines) if g and s.strip()}
            rows.append((i, t, i - 1 if k else None, r.choice([f"{f} {x}", f"{f[0].lower()}.{x.lower()}@works.example"]), dt.datetime(2025, 1, k + 1), "Re: x", r.choice(["\n", "\r\n"]).join(s for s, _ in lines)))
    return rows, gone


def test_found_lines(spark, wide):
    rows, gone = mails()
    extra = [(9001, None, None, None, None, "s", None), (9002, 5, None, None, None, "s", ""), (9003, 9999, None, None, None, "s", "> only quoted")]
    got = {tuple(x) for x in mp.not_new_lines(wide(spark.createDataFrame(rows + extra, SCHEMA))).collect()}
    assert (9003, 0) in got
    got = {g for g in got if g[0] < 9000}
    assert len(got & gone) / len(gone) > 0.97 and len(got & gone) / len(got) > 0.97


def test_new_text(spark):
    rows, gone = mails()
    new = {r.email_id: r.body for r in mp.newly_written(spark.createDataFrame(rows + [(9001, 1, None, None, None, "s", None)], SCHEMA)).collect()}
    assert new[9001] is None and len(new) == len(rows) + 1
    assert sum("wrote:" in (b or "") for b in new.values()) <= 0.03 * len(rows) and all(b for i, b in new.items() if i < 9000)


def test_empty(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert mp.not_new_lines(d).count() == 0

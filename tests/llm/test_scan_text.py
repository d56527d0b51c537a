import random

from quillspark.llm import scan_text as sc

SCHEMA = "line_id long, source_path string, project string, page_no int, line_no int, text string, font_size double, bold boolean, word_count int, baseline double"
SENTENCE = "the session owner checks every record before the nightly export moves the access table into the release queue and writes a short report for the read-only viewer".split()


def pages(seed=1, n=60):
    """Scanned pages with known defects."""
    r = random.Random(seed)
    rows, want, i = [], set(), 0
    for p in range(n):
        words = [r.choice(SENTENCE) for _ in range(220)]
        y, no = 790.0, 0

        def add(text, size, defects=()):
            nonlocal i, y, no
            i += 1
            rows.append((i, f"/f{p // 6}.pdf", "p", p % 6 + 1, no, text, size, False, len(text.split()), y))
            want.update((i, d) for d in defects)
            y, no = y - 14, no + 1

        add("Handbook of records", 8.3 if r.random() < 0.9 else None, ["furniture"])
        carry = ""
        while len(words) > 10:
            line, words = words[:9], words[9:]
            defects = set()
            text = " ".join(line)
            if carry:
                text, carry = f"{carry} {text}", ""
            k = r.random()
            if k < 0.08:
                j = r.randrange(1, 8)
                w = line[j]
                bad = w.replace("e", "c", 1) if "e" in w and len(w) > 4 else None
                if bad:
                    text = text.replace(f" {w} ", f" {bad} ", 1)
                    if f" {bad} " in text:
                        defects.add("ocr")
            elif k < 0.12:
                text = text.replace(" the ", " th·e ", 1) if " the " in text else text
                if "th·e" in text:
                    defects.add("ocr")
            elif k < 0.2 and len(words[0]) > 6 and "-" not in words[0]:
                cut = r.randint(3, 4)
                text += " " + words[0][:cut] + r.choice("-¬­")
                carry = words.pop(0)[cut:]
                defects.add("hyphen")
            elif k < 0.24:
                text += " read-"
                carry = "only"
            add(text, round(10 + r.random() * 0.3, 2) if r.random() < 0.97 else None, defects)
        if carry:
            add(carry, 10.0)
        add(f"Page {p % 6 + 1} of 6", 8.0, ["furniture"])
    return rows, want


def test_defects(spark, wide):
    rows, want = pages()
    d = wide(spark.createDataFrame(rows + [(9001, "/x.pdf", "p", 1, 0, None, None, None, None, None), (9002, None, None, 1, 0, "", 10.0, None, 0, 1.0)], SCHEMA))
    got = {tuple(x) for x in sc.defects(d).collect()}
    for kind, least in (("furniture", 0.98), ("hyphen", 0.95), ("ocr", 0.9)):
        g, w = ({x for x in s if x[1] == kind} for s in (got, want))
        assert len(g & w) / len(w) >= least and len(g & w) / len(g) >= least, kind


def test_paragraphs(spark):
    rows, _ = pages()
    ps = sc.paragraphs(spark.createDataFrame(rows, SCHEMA)).collect()
    text = " ".join(p.text for p in ps)
    assert "Handbook" not in text and "­" not in text and "th·e" not in text and "read-only" in text and "Page 1 of" not in text


def test_markdown(spark):
    rows, _ = pages()
    conv = spark.createDataFrame([("/f0.pdf", "Pdf", "raw"), ("/f0.pdf", "Pdf", "raw"), ("/none.pdf", "Pdf", "as it is"), ("/a.md", "Markdown", "x"), (None, "Pdf", None)], "source_path string, format string, markdown string")
    got = {r.source_path: r.markdown for r in sc.repaired_markdown(conv, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {"/f0.pdf", "/none.pdf", ""} and got["/none.pdf"] == "as it is" and got[""] is None and "session" in got["/f0.pdf"]


def test_confusions_are_undone():
    assert "record" in dict(sc.confusions("rccord")) and "modifier" in dict(sc.confusions("moclifier")) and "import" in dict(sc.confusions("irnport")) and "took" in dict(sc.confusions("t0ok"))


def test_paragraph_cuts():
    line = lambda t, y, s=10.0: {"text": t, "baseline": y, "size": s}
    page = [line("A first line of the text that goes on", 700), line("and ends here.", 686), line("Heading", 650, 13.0), line("Another paragraph starts after a gap", 620), line("and goes on to the end.", 606)]
    assert sc.cut_paragraphs(page) == [0, 2, 3]


def test_empty(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert sc.defects(d).count() == 0 and sc.paragraphs(d).count() == 0


def test_confusions_of_long_words_are_those_spelled_out():
    assert all(sc.form(printed) == sc.form(read) for printed, read in sc.CONFUSIONS)
    r = random.Random(4)
    tri = {}
    for w in SENTENCE:
        for i in range(len(w)):
            for k in (f"^^{w}$"[i : i + 3], f"^^{w}$"[i : i + 2]):
                tri[k] = tri.get(k, 0.0) + 1
    letters = sc.Letters(tri)
    for _ in range(300):
        w = "".join(r.choice(("r", "i", "n", "c", "l", "v", "u", "1", "e", "x", "m")) for _ in range(r.randint(1, 12)))
        all_of = dict(sc.confusions(w))
        known = r.sample(sorted(all_of), len(all_of) // 3) + [w, "other"]
        others = {}
        for v in known:
            others.setdefault(sc._hash(v), []).append(v)
        hits, best = sc.long_confusions(w, others, letters)
        assert {v: deep for v, (_, deep) in hits.items()} == {v: all_of[v] for v in known if v in all_of}
        lead = lambda v: letters.score(v) - letters.score(w)
        assert all(abs(x - lead(v)) < 1e-9 for v, (x, _) in hits.items())
        rest = [lead(v) for v in all_of if v not in known]
        assert (best is None) == (not rest) and (not rest or abs(best[0] - max(rest)) < 1e-9 and best[1] in all_of)
        assert all(sc.form(v) == sc.form(w) for v in all_of)


def lines_of(spark, texts):
    return spark.createDataFrame([(i, f"/l{i // 40}.pdf", "p", i // 20 % 2 + 1, i % 20, t, 10.0, False, 3, 790.0 - 14 * (i % 20)) for i, t in enumerate(texts)], SCHEMA)


def test_long_words_are_repaired_like_short_ones(spark):
    r = random.Random(8)
    long = "donaudampfschiffahrtselektrizitaetenhauptbetriebswerkbauunterbeamtengesellschaft"
    huge = "".join(r.choice("abdfghklmnoprstuvw") for _ in range(6_000))
    common = ["seven", "report", *SENTENCE]
    texts = [" ".join(r.choices(common, k=6)) for _ in range(400)]
    for i in range(0, 400, 20):
        texts[i + 2] += f" {long} report"
        texts[i + 3] += f" {huge} seven"
    bad = {i: texts[i] for i in (5, 45, 85, 125)}
    texts[5] += " " + long.replace("schiff", "schlff")
    texts[45] += f" {long}report"
    texts[85] += " " + huge.replace("e", "c")[:3_000] + huge[3_000:].replace("m", "rn", 1)
    texts[125] += f" {huge}seven"
    assert all(texts[i] != t for i, t in bad.items())
    got = {x.line_id for x in sc.defects(lines_of(spark, texts)).filter("defect = 'ocr'").collect()}
    assert got == set(bad)


def test_letters_are_counted_whole(spark):
    words = [chr(0x20000 + i) + chr(0x20000 + 7 * i % 5000) + chr(0x20000 + 11 * i % 5000) for i in range(70_000)] + ["\U00031400en"]
    letters = sc._letters(spark.createDataFrame([(w, 2 if w.endswith("en") else 9) for w in words], "word string, n long"))
    # the rarest trigrams are there, those that no confusion touches are not, and the contexts of all are
    assert letters.tri.get("\U00031400en") == 1 and letters.bi["\U00031400e"] == 1 and words[9] not in letters.tri and letters.bi[words[9][:2]] >= 1

import random

import pytest

from quillspark.llm.pieces import oversized_blocks, split_oversized

CH = "chunk_id long, project string, heading_path string, text string"
OP = "project string, max_chars int, overlap_chars int"


def frames(spark, texts, most=40, back=10):
    return spark.createDataFrame([(i, "p", "H", t) for i, t in enumerate(texts)], CH), spark.createDataFrame([("p", most, back)], OP)


def pieces_of(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.chunk_id, r.piece_no)):
        out.setdefault(r.chunk_id, []).append(r)
    return out


@pytest.mark.parametrize("most,back", [(40, 10), (7, 3), (1, 0), (100, 99), (30, 500), (25, 0)])
def test_pieces_cover_the_text(spark, wide, most, back):
    r = random.Random(most)
    texts = ["".join(r.choice(["word ", "a", "Satz. ", "\n", "\n\n", "é", "😀", "```\n", "| x |\n", "\r\n"]) for _ in range(r.randint(0, 80))) for _ in range(60)] + ["", "x" * 5000, None]
    c, o = frames(spark, texts, most, back)
    got = pieces_of(split_oversized(wide(c), wide(o)).collect())
    for i, t in enumerate(texts):
        if t is None:
            assert i not in got
            continue
        t = t.replace("\r\n", "\n")
        ps = got[i]
        assert [p.piece_no for p in ps] == list(range(len(ps)))
        assert "".join(p.text[p.overlap :] for p in ps) == t
        assert all(len(p.text) <= max(1, most) and p.overlap <= back for p in ps)
        assert all(t[p.start - p.overlap : p.start] == p.text[: p.overlap] for p in ps)


def test_cuts_at_pauses(spark):
    c, o = frames(spark, ["First sentence here. Second sentence here.\n\nNext paragraph has words."], 30, 0)
    assert [p.text for p in pieces_of(split_oversized(c, o).collect())[0]] == ["First sentence here. ", "Second sentence here.\n\n", "Next paragraph has words."]


def reference_blocks(text):
    out, cur, fenced = [], [], False
    for line in text.replace("\r\n", "\n").split("\n"):
        fence = line.lstrip().startswith(("```", "~~~"))
        if fenced:
            cur.append(line)
            if fence:
                out.append(cur)
                cur, fenced = [], False
        elif fence or not line.strip():
            if cur:
                out.append(cur)
            cur, fenced = ([line], True) if fence else ([], False)
        else:
            cur.append(line)
    return ["\n".join(b) for b in out + [cur] if b]


def test_oversized_blocks_against_a_scan(spark, wide):
    r = random.Random(3)
    texts = ["".join(r.choice(["word word\n", "  ```\n", "~~~\n", "\n", " \n", "tail", "x\r\n", " \n", "a b\n"]) for _ in range(r.randint(0, 40))) for _ in range(300)] + [None, ""]
    c, o = frames(spark, texts, 25, 5)
    want = {(i, k) for i, t in enumerate(texts) if t for k, b in enumerate(reference_blocks(t)) if len(b) > 25}
    assert {tuple(x) for x in oversized_blocks(wide(c), o).collect()} == want and want


def test_long_fences_do_not_overflow(spark):
    c, o = frames(spark, ["```\n" + "line of code\n" * 20_000, "para\n" * 50_000])
    assert oversized_blocks(c, o).count() == 2


def test_many_pieces_take_linear_time(spark):
    import time

    c, o = frames(spark, ["word " * 800_000], 100, 20)
    t0 = time.time()
    rows = split_oversized(c, o).selectExpr("count(*) AS n", "max(start) AS last", "sum(length(text) - overlap) AS total").first()
    assert rows.n >= 40_000 and rows.last > 3_999_000 and rows.total == 4_000_000 and time.time() - t0 < 60


def test_headings_are_the_strongest_pause(spark):
    c, o = frames(spark, ["Some text here.\n\nMore.\n## Next part\nbody of it, which goes on"], 40, 0)
    assert [p.text for p in pieces_of(split_oversized(c, o).collect())[0]] == ["Some text here.\n\nMore.\n", "## Next part\nbody of it, which goes on"]


def test_defaults_and_empty_tables(spark):
    c = spark.createDataFrame([(1, None, "", "x" * 2000), (2, "q", "", "y" * 1600)], CH)
    o = spark.createDataFrame([("p", None, None)], OP)
    got = pieces_of(split_oversized(c, o).collect())
    assert len(got[1]) == 2 and len(got[2]) == 1
    assert split_oversized(c.limit(0), o).count() == 0 and oversized_blocks(c.limit(0), o.limit(0)).count() == 0

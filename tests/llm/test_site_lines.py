import random

from quillspark.llm.site_lines import normal_form, repeated_lines, without_repeated_lines

SCHEMA = "chunk_id long, project string, source_path string, text string"


def rows(seed=1, n=150):
    r = random.Random(seed)
    shared = [f"Read the {w} policy of release {{}} before use." for w in ("privacy", "cookie", "travel")] + ["© Works. All rights reserved.", "short 1"]
    out = []
    for i in range(n):
        lines = [" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randint(0, 99)) for _ in range(6)) + chr(97 + r.randint(0, 25)) * 9 for _ in range(3)]
        for s in shared:
            if r.random() < 0.2:
                lines.insert(r.randint(0, len(lines)), s.format(r.randint(0, 99)).upper() if r.random() < 0.3 else f"  {s.format(i)}  ")
        out.append((i, f"p{i % 4}", f"/d{i % 60}", r.choice(["\n", "\r\n"]).join(lines)))
    return out + [(9001, "p0", "/d", None), (9002, None, None, "Read the privacy policy of release 5 before use."), (9003, "p1", "/d", ""), (9004, "p1", "/x", "y" * 200_000)]


def brute(data, least):
    docs, lines = {}, []
    for i, p, s, t in data:
        for k, line in enumerate((t or "").replace("\r\n", "\n").split("\n")):
            f = normal_form(line)
            if len(f) >= 12:
                docs.setdefault((p, f), set()).add(s)
                lines.append((i, k, p, f))
    return {(i, k) for i, k, p, f in lines if len(docs[p, f]) >= least}


def test_against_brute_force(spark, wide):
    data = rows()
    d = wide(spark.createDataFrame(data, SCHEMA))
    for least in (5, 2):
        want = brute(data, least)
        got = [tuple(r) for r in repeated_lines(d, least).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_cut_texts(spark):
    data = rows()
    want = brute(data, 5)
    for r in without_repeated_lines(spark.createDataFrame(data, SCHEMA)).collect():
        t = dict((i, t) for i, _, _, t in data)[r.chunk_id]
        gone = {k for i, k in want if i == r.chunk_id}
        assert r.lines_cut == len(gone)
        if t is None or not gone:
            assert r.text == t
        else:
            assert r.text == "\n".join(x for k, x in enumerate(t.replace("\r\n", "\n").split("\n")) if k not in gone)


def test_copies_of_one_document_do_not_count(spark):
    d = spark.createDataFrame([(i, "p", "/same", "This line is in one document only.") for i in range(20)], SCHEMA)
    assert repeated_lines(d).count() == 0 and repeated_lines(d.limit(0)).count() == 0


def test_normal_form():
    assert normal_form("  *** Page 12 of  345! ***") == "page 0 of 0"
    assert normal_form("---") == ""


def test_the_first_whole_chunk_follows_from_the_line():
    import numpy as np

    from quillspark.llm import site_lines as sl

    r = random.Random(8)
    word = lambda n: "".join(r.choice("abc é") for _ in range(n))
    for line in ["a" * 80, "ab" * 50, *(word(90).strip("  ") + "é" for _ in range(200))]:
        raw, probes = line.encode(), set()
        for _ in range(6):
            before, after = word(r.randint(0, 70)).encode(), word(r.randint(0, 70)).encode()
            data = np.frombuffer(before + raw + after, dtype=np.uint8)
            rows = np.array([0]) if r.random() < 0.5 or not before else np.array([0, len(before)])
            probes.add(int(sl.fingerprints(data, rows, np.array([len(before)]), np.array([len(before) + len(raw)]))[4][0]))
        assert len(raw) < sl.ENOUGH or len(probes) == 1 and 0 not in probes, line

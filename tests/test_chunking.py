from pyspark.sql import functions as F

from quillspark.operators.chunking import chunk_documents, chunk_markdown, reassemble


def heads(md, title=None, **kw):
    return [h for h, _ in chunk_markdown(md, title, **kw)]


def test_breadcrumbs():
    md = "# Doc Title\n\nintro\n\n## Section A\n\na\n\n### Sub A1\n\na1\n\n## Section B\n\nb"
    assert heads(md) == ["Doc Title", "Doc Title > Section A", "Doc Title > Section A > Sub A1", "Doc Title > Section B"]


def test_container_headings_are_left_out_and_empty_leaves_kept():
    assert heads("# T\n## Parent\n### Child\nbody") == ["T > Parent > Child"]
    assert chunk_markdown("# T\nintro\n\n## Empty Leaf\n", None)[1] == ("T > Empty Leaf", "")


def test_preamble_has_the_title():
    assert chunk_markdown("just text", "My title") == [("My title", "just text")]
    assert chunk_markdown(None, "x") == [] and chunk_markdown("", "x") == []


def test_long_bodies_are_packed_with_overlap():
    paras = [f"paragraph {i}" for i in range(5)]
    got = chunk_markdown("# Big\n\n" + "\n\n".join(paras), None, 30, 15)
    assert len(got) > 1
    sets = [set(t.split("\n\n")) for _, t in got]
    assert set().union(*sets) == set(paras)
    assert any(a & b for a, b in zip(sets, sets[1:]))


def test_tables_repeat_their_head():
    table = "| name | value |\n| --- | --- |\n" + "\n".join(f"| row {i} | {i} |" for i in range(20))
    got = [t for _, t in chunk_markdown("# T\n\n" + table, None, 120, 20)]
    assert len(got) > 1 and all(t.count("| name | value |") >= 1 for t in got)
    assert all(any(f"| row {i} |" in t for t in got) for i in range(20)) and max(map(len, got)) <= 200


def test_fences_hide_headings():
    assert heads("# T\n\n```\n# not a heading\n```") == ["T"]


def test_documents_and_back(spark):
    docs = spark.createDataFrame([("p", "/a.md", "Doc", None, "# Doc\n\nintro\n\n## Setup\n\none\n\ntwo\n\n## Usage\n"), ("p", "/n.md", None, None, None), ("p", "/e.md", "E", None, "")], "project string, source_path string, title string, source_modified_at timestamp, markdown string")
    c = chunk_documents(docs)
    rows = c.orderBy("source_path", "ordinal").collect()
    assert [(r.source_path, r.ordinal, r.heading_path) for r in rows] == [("/a.md", 0, "Doc"), ("/a.md", 1, "Doc > Setup"), ("/a.md", 2, "Doc > Usage")]
    md = reassemble(c).filter(F.col("source_path") == "/a.md").first().markdown
    assert md == "# Doc\n\nintro\n\n## Doc > Setup\n\none\n\ntwo\n\n## Doc > Usage\n"

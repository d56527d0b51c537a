import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspark.engine import Engine
from quillspark.operators import layout
from quillspark.operators import retrieval as rt

T0 = dt.datetime(2026, 6, 1)


def test_sizes():
    assert [rt.knn_size(rt.fetch_size(k, False)) for k in (1, 10, 40)] == [25, 50, 100] and [rt.fetch_size(k, True) for k in (1, 5, 25)] == [12, 15, 20]


def test_bm25_prefers_rare_terms_and_short_fields(spark):
    d = spark.createDataFrame([(1, "audit audit policy"), (2, "policy policy policy words words"), (3, None), (4, ""), (5, "nothing here")], "id long, t string")
    s = {r.id: r.score for r in rt.bm25(d, "id", "t", "audit policy").collect()}
    assert set(s) == {1, 2} and s[1] > s[2] and rt.bm25(d, "id", "t", "absent").count() == 0


def test_minmax_and_fusion(spark):
    s = lambda rows: spark.createDataFrame(rows, "id long, score double")
    assert {r.id: r.score for r in rt.minmax(s([(1, 5.0), (2, 5.0)])).collect()} == {1: 1.0, 2: 1.0}
    assert {r.id: r.score for r in rt.fuse(s([(1, 2.0), (2, 1.0)]), s([(2, 9.0), (3, 1.0)])).collect()} == {1: 0.5, 2: 0.5, 3: 0.0}


def test_rerank(spark):
    body = "x" * 1790
    hits = spark.createDataFrame([("a", 1, "Doc > Section", "short"), ("b", 2, "Doc > Section", "Doc > Section\n\n" + body), ("c", 3, "", "")], "id string, position int, heading_path string, content string")
    w = rt.rerank_windows(hits).orderBy("id", "window_no").collect()
    assert [(r.id, r.window_no) for r in w] == [("a", 0), ("b", 0), ("b", 1), ("c", 0)] and w[1].passage.startswith("Doc > Section\n\n") and w[2].passage.endswith(body[-990:])
    logits = F.lit(None).cast("double")
    got = rt.rerank(hits, lambda p: F.coalesce(logits, F.when(p == "short", -2.0).when(p == "", 4.0).otherwise(0.0)), 2).collect()
    assert [(r.id, r.score) for r in got] == [("c", 0.982), ("b", 0.5)]


def test_centroid_and_blocks(spark):
    d = spark.createDataFrame([("d", [1.0, 0.0]), ("d", [0.0, 1.0]), ("e", [0.0, 0.0]), ("e", None)], "source_path string, content_vector array<double>")
    c = rt.centroids(d).collect()
    assert len(c) == 1 and c[0].centroid == pytest.approx([2**-0.5] * 2)
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "id long, v array<double>")
    got = rt.nearest_blocks(v, v.filter("id < 3"), 4, block=16).collect()
    assert {(r.query_id, r.rank) for r in got} == {(q, k) for q in range(3) for k in range(1, 5)} and all(r.id != r.query_id for r in got)
    assert next(r.id for r in got if (r.query_id, r.rank) == (0, 1)) == 35


def docs(spark, rows):
    return spark.createDataFrame([(f"/{n}.md", md, n.title(), T0 + dt.timedelta(days=i), p) for i, (n, md, p) in enumerate(rows)], "source_path string, markdown string, title string, source_modified_at timestamp, project string")


def test_engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store", embed=rt.hashed_embedding)
    n = e.index(docs(spark, [("roles", "# Roles\n\nThe default role is admin.\n\n## Other\n\nNothing", "p"), ("policy", "# Policy\n\nRetention of the audit trail is one year.", "p"), ("else", "# Else\n\nUnrelated words", "q")]))
    assert n == 4 and e.status().count() == 2 and e.sources("p").count() == 2
    hits = e.search("retention audit trail", k=2).collect()
    assert hits[0].path == "/policy.md" and len(hits) == 2
    e.add_note("Retention is now two years.", "p", "/policy.md", "ann")
    hits = e.search("retention audit trail", k=3, project="p").collect()
    assert any(len(h.annotations) == 1 for h in hits if h.path == "/policy.md")
    reranked = e.search("retention audit trail", k=2, scorer=rt.overlap_logit("retention audit trail")).collect()
    assert reranked[0].path == "/policy.md" and len(reranked) == 2
    assert e.search("retention", k=1, project="q").count() <= 1
    assert "## Roles > Other" in e.document("roles.md").first().markdown and e.document("/roles.md", around=0, radius=0).first().partial
    assert e.similar("/policy.md", 2).count() == 2
    assert e.index(docs(spark, [("roles", "# Roles\n\nThe default role is super-admin.", "p")])) == 1
    assert e.chunks.read().filter("source_path = '/roles.md'").count() == 1
    e.gateway.register("chunks", e.chunks.read())
    assert e.query("SELECT count(*) AS n FROM chunks").rows == [["3"]]
    e.index(docs(spark, [("copy", "# Roles\n\nThe default role is super admin now.", "p")]))
    open_pairs = e.detect()
    if open_pairs:
        pair = e.pairs.read().first().pair_id
        e.resolve(pair, "The newer one holds.", "ann")
        assert e.detect() == open_pairs - 1
    assert set(e.describe("p")) == {"kinds", "status", "contradictions", "top", "more"} and e.unscoped().first().project == "p"
    assert e.contradictions(99, include_closed=True).count() >= open_pairs and e.list_notes("p").count() >= 1
    assert e.search("retention audit trail", k=2, scorer=lambda c: F.assert_true(F.lit(False)).cast("double")).count() == 2 and e.rerank_failed  # the order of before
    assert e.remove("/else.md") == 1
    assert e.purge("p")["chunks"] == 3 and e.chunks.read().count() == 0


def test_engine_without_vectors_and_folder(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "A.md").write_text("# Audit\n\nThe audit trail.")
    (tmp_path / "docs" / "b.pdf").write_bytes(b"%PDF")
    e = Engine(spark, f"file://{tmp_path}/store")
    s = {r.format: (r.ok, r.failed, r.chunks) for r in e.index_folder(str(tmp_path / "docs"), "p").collect()}
    assert s == {"Markdown": (1, 0, 1), "Pdf": (0, 1, 0)}
    assert e.search("audit").first().heading_path == "Audit" and e.similar(e.chunks.read().first().source_path) is None
    assert e.index_folder(str(tmp_path / "docs"), "p").filter("format = 'Markdown'").count() == 0 and e.ping()["chunks"] == 1  # nothing has changed, nothing is written
    (tmp_path / "docs" / "A.md").unlink()
    summary = e.index_folder(str(tmp_path / "docs"), "p")
    assert e.chunks.read().count() == 0 and e.exit_code(summary) == 1
    (tmp_path / "docs" / "A.md").write_text("# Audit\n\nThe audit trail.")
    e.index_folder(str(tmp_path / "docs"), "p")
    assert [r.project for r in e.projects().collect()] == ["p"]
    path = e.save_document(str(tmp_path / "gen"), "A title", "words", "p", "me")
    assert path.endswith("p/a-title.md") and e.chunks.read().count() == 2


def test_layout(spark):
    rows = [(1, 1, 0, "Big title", 18.0, True, 2, 790.0), (2, 1, 1, "Body one", 10.0, False, 2, 770.0), (3, 1, 2, "goes on", 10.0, False, 2, 756.0), (4, 1, 3, "after a gap", 10.0, False, 3, 720.0), (5, 1, 4, "Sub", 13.0, False, 1, 706.0), (6, 1, 5, "Bold head", 10.0, True, 2, 692.0), (7, 1, 6, "Bold sentence.", 10.0, True, 2, 678.0), (8, 2, 0, "next page", 10.0, None, 2, 790.0)]
    d = spark.createDataFrame([("/f", *r) for r in rows], "source_path string, line_id long, page_no int, line_no int, text string, font_size double, bold boolean, word_count int, baseline double")
    assert layout.statistics(d).first().body_size == 10.0
    assert {r.line_id: r.level for r in layout.headings(d).collect()} == {1: 1, 5: 2, 6: 3}
    assert layout.markdown(d).first().markdown == "# Big title\n\nBody one goes on\n\nafter a gap\n\n## Sub\n\n### Bold head\n\nBold sentence.\n\nnext page"
    assert layout.statistics(d.limit(0)).count() == 0

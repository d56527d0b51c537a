import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspark.operators import catalog, contradictions, notes, store

T0 = dt.datetime(2026, 1, 1)


def chunk_rows(spark, rows):
    d = spark.createDataFrame(rows, "chunk_id long, project string, source_path string, ordinal int, text string")
    return d.withColumns({"title": F.lit(None).cast("string"), "heading_path": F.lit(""), "source_modified_at": F.lit(T0), "indexed_at": F.lit(T0), "content_vector": F.lit(None).cast("array<float>")})


def test_replace_update_delete(spark, tmp_path):
    t = store.Table(spark, f"file://{tmp_path}/chunks", store.CHUNKS)
    assert t.read().count() == 0
    t.replace(chunk_rows(spark, [(1, "p", "/a", 0, "x"), (2, "p", "/a", 1, "y"), (3, "q", "/b", 0, "z")]))
    t.replace(chunk_rows(spark, [(4, "q", "/a", 0, "new")]))
    assert sorted((r.project, r.source_path, r.text) for r in t.read().collect()) == [("q", "/a", "new"), ("q", "/b", "z")]
    assert t.update(F.col("source_path") == "/b", {"text": F.lit("zz")}) == 1
    with pytest.raises(KeyError):
        t.update(F.col("source_path") == "/none", {"text": F.lit("")})
    assert t.delete(F.col("project") == "nobody") == 0
    assert store.purge({"chunks": t}, "q") == {"chunks": 2} and t.read().count() == 0


def test_missing_fields_have_defaults(spark):
    p = store.conform(spark.createDataFrame([("x", None)], "pair_id string, status string"), store.PAIRS).first()
    assert (p.status, p.kind) == ("open", "contradiction")


def test_status_and_summary(spark):
    c = chunk_rows(spark, [(i, "pam", f"/d{i % 5}", i // 5, "t") for i in range(111)])
    s = catalog.project_status(c).first()
    assert (s.chunks, s.documents, s.embedded, s.vector_coverage) == (111, 5, 0, 0.0)
    rows = [("p", "open", "contradiction")] * 4 + [("p", None, None)] + [("p", "open", "likely-supersession")] * 2 + [("p", "dismissed", None)] * 3 + [("p", "resolved", None)]
    r = catalog.summary(spark.createDataFrame(rows, "project string, status string, kind string")).first()
    assert (r.open, r.open_supersessions, r.dismissed, r.resolved, r.total) == (7, 2, 3, 1, 11)


def test_find_document_by_name_and_window(spark):
    c = chunk_rows(spark, [(i, "p", p, i, "t") for i, p in enumerate(["/z/rbaca.doc", "/b/a.doc", "/c/a.doc"])])
    assert {r.source_path for r in catalog.find_document(c, "/C/A.doc").collect()} == {"/c/a.doc"}
    assert {r.source_path for r in catalog.find_document(c, "x\\a.doc").collect()} == {"/b/a.doc"}
    assert {r.source_path for r in catalog.find_document(c, "aca.doc").collect()} == {"/z/rbaca.doc"}
    assert catalog.find_document(c, "aca.doc", strict=True).count() == 0
    d = chunk_rows(spark, [(i, "p", "/a", i, "t") for i in range(9)])
    assert [r.ordinal for r in catalog.document_window(d, 1, 2).orderBy("ordinal").collect()] == [0, 1, 2, 3]


def test_latest(spark):
    d = spark.createDataFrame([(1, "/a", 0, T0), (2, "/a", 0, T0), (3, "/a", 0, None), (4, "/a", 1, T0), (5, None, 0, T0), (6, None, 0, T0)], "chunk_id long, source_path string, ordinal int, indexed_at timestamp")
    assert {r.chunk_id for r in catalog.latest(d).collect()} == {2, 4, 5, 6}


def test_stale(spark):
    c = chunk_rows(spark, [(1, "p", "/old", 0, "t")])
    r = catalog.stale(c, F.to_timestamp(F.lit("2026-02-01 12:00:00")), 30).first()
    assert r.age_days == 31 and catalog.stale(c, F.to_timestamp(F.lit("2026-01-20")), 30).count() == 0


def test_scope(spark):
    c = chunk_rows(spark, [(1, "p", "/a", 0, "t"), (2, "q", "/b", 0, "t")])
    assert [catalog.scoped(c, s).count() for s in ("p", "*", "ALL", " ", None)] == [1, 2, 2, 2, 2]


def test_labels(spark):
    d = spark.createDataFrame([("/x/a/n.md",), ("/x/b/n.md",), ("/x/b/m.md",), ("jira://A-1",)], "path string")
    assert {r.path: r.label for r in catalog.shortest_labels(d).collect()} == {"/x/a/n.md": "a/n.md", "/x/b/n.md": "b/n.md", "/x/b/m.md": "m.md", "jira://A-1": "jira://A-1"}


def test_notes(spark, tmp_path):
    t = store.Table(spark, f"file://{tmp_path}/notes", store.NOTES)
    n = spark.createDataFrame([("p", "use B", "C:\\A.md", "me"), ("p", "use B", "c:/a.md", "me"), ("q", "other", "jira://X-1", "me")], "project string, text string, target_path string, author string").withColumn("created_at", F.lit(T0))
    notes.add(t, n)
    assert t.read().count() == 2 and {r.target_path for r in t.read().collect()} == {"c:/a.md", "jira://X-1"}
    hits = spark.createDataFrame([("c:/a.md", "p"), ("c:/a.md", "q"), ("/z", "p")], "path string, project string")
    assert {(r.path, r.project): len(r.annotations) for r in notes.annotate(hits, t.read()).collect()} == {("c:/a.md", "p"): 1, ("c:/a.md", "q"): 0, ("/z", "p"): 0}


def nominees(spark, rows):
    d = spark.createDataFrame(rows, "chunk_id long, project string, source_path string, ordinal int, heading_path string, text string, source_modified_at timestamp, content_vector array<float>")
    return contradictions.nominate(d).collect()


V1, V2, V3 = [1.0, 0.0], [0.99, 0.14], [0.0, 1.0]


def test_nomination(spark):
    old, new = dt.datetime(2026, 6, 1), dt.datetime(2026, 6, 20)
    got = nominees(spark, [(1, "p", "/a", 0, "", "The default role is admin.", old, V1), (2, "p", "/b", 0, "", "The default role is super-admin.", new, V2), (3, "p", "/c", 0, "", "Something else", new, V3), (4, "q", "/d", 0, "", "The default role is nobody.", new, V1)])
    assert [(r.a_path, r.b_path, r.kind, r.status) for r in got] == [("/b", "/a", "contradiction", "open")] and 0.75 <= got[0].similarity <= 1
    late = nominees(spark, [(1, "p", "/a", 0, "", "The default role is admin.", dt.datetime(2026, 1, 10), V1), (2, "p", "/b", 0, "", "The default role is super-admin.", new, V2)])
    assert late[0].kind == "likely-supersession"


@pytest.mark.parametrize("text,when", [("THE default  role is admin.", dt.datetime(2026, 6, 20)), ("The role is none.", dt.datetime(2026, 6, 1)), ("The role is none.", None)])
def test_no_nomination(spark, text, when):
    assert nominees(spark, [(1, "p", "/a", 0, "", "The default role is admin.", dt.datetime(2026, 6, 1), V1), (2, "p", "/b", 0, "", text, when, V2)]) == []


def test_templates_are_suppressed(spark):
    rows = [(i, "p", f"/t{i}", 0, "", "This page intentionally left blank for now", dt.datetime(2026, 1, i), V1) for i in range(1, 4)]
    rows += [(9, "p", "/x", 0, "", "This page is about something", dt.datetime(2026, 2, 1), V2)]
    assert nominees(spark, rows) == []


def test_lifecycle(spark, tmp_path):
    t = store.Table(spark, f"file://{tmp_path}/pairs", store.PAIRS)
    t.write(spark.createDataFrame([("1", "/a", "/b"), ("2", "/a", "/c"), ("3", "/x", "/y")], "pair_id string, a_path string, b_path string"))
    contradictions.set_status(t, "2", "dismissed")
    assert {r.pair_id for r in contradictions.listed(t.read()).collect()} == {"1", "3"}
    assert contradictions.remove_for_path(t, "/a", only_open=True) == 1
    assert {r.pair_id for r in t.read().collect()} == {"2", "3"}
    assert contradictions.remove_for_path(t, "/a", only_open=False) == 1


def test_neighbours_recall_and_nulls(spark):
    import numpy as np

    from quillspark.operators import neighbours

    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 16))
    x = (centre[rng.integers(0, 40, 3000)] + 0.25 * rng.normal(size=(3000, 16))).astype(float)
    rows = [(i, "p", str(i % 50), [float(v) for v in x[i]]) for i in range(3000)] + [(9001, "p", "z", None), (9002, None, "z", [1.0] * 16), (9003, "p", "z", [0.0] * 16), (9004, "p", "z", [float("nan")] * 16)]
    d = spark.createDataFrame(rows, "id long, g string, a string, v array<double>")
    neighbours.CELL, was = 400, neighbours.CELL
    try:
        got = {(r.id, r.other_id) for r in neighbours.top_neighbours(d, "id", "v", "g", "a", 3, 0.8).collect()}
    finally:
        neighbours.CELL = was
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    s[np.equal.outer(np.arange(3000) % 50, np.arange(3000) % 50)] = -1
    want = {(i, int(j)) for i in range(3000) for j in np.argsort(-s[i])[:3] if s[i, j] >= 0.8}
    assert len(got & want) / len(want) > 0.95 and not {i for p in got for i in p} & {9001, 9002, 9003, 9004}


def test_neighbours_in_a_dense_region(spark, monkeypatch):
    import numpy as np

    from quillspark.operators import neighbours

    rng = np.random.default_rng(2)
    middle = rng.normal(size=48)
    x = middle / np.linalg.norm(middle) + 0.045 * rng.normal(size=(2000, 48))
    d = spark.createDataFrame([(i, "p", str(i), [float(v) for v in x[i]]) for i in range(2000)], "id long, g string, a string, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T - 9 * np.eye(2000)
    want = {(i, int(j)) for i in range(2000) for j in np.argsort(-s[i])[:3] if s[i, j] >= 0.8}
    monkeypatch.setattr(neighbours, "CELL", 100)
    found = lambda: {(r.id, r.other_id) for r in neighbours.top_neighbours(d, "id", "v", "g", "a", 3, 0.8).collect()}
    assert len(want) > 5000 and found() == want
    monkeypatch.setattr(neighbours, "WHOLE", 0)
    assert len(found() & want) / len(want) > 0.95


def test_equal_vectors_go_by_id(spark, monkeypatch):
    from quillspark.operators import neighbours
    from quillspark.operators import retrieval as rt

    d = spark.createDataFrame([(i, "p", str(i), [0.3, 0.7, 0.1]) for i in range(300)], "id long, g string, a string, v array<double>").repartition(3, "id")
    monkeypatch.setattr(neighbours, "SLICE", 100)
    got = neighbours.top_neighbours(d, "id", "v", "g", "a", 3, 0.8).filter("id = 150").collect()
    assert sorted(r.other_id for r in got) == [0, 1, 2]
    got = rt.nearest_blocks(d, d.filter("id = 150"), 5, block=64).collect()
    assert sorted(r.id for r in got) == [0, 1, 2, 3, 4]

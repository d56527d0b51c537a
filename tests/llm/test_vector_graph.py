import numpy as np
import pytest

from quillspark.llm import vector_graph as vg

SCHEMA = "chunk_id long, content_vector array<float>, rep string, shard string, v string, k1 string"


def brute(ids, x, k, least):
    x = x.astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return {(ids[i], ids[j]) for i in range(len(ids)) for j in sorted(range(len(ids)), key=lambda j: (-round(s[i, j], 12), ids[j]))[:k] if s[i, j] >= least}


def clustered(n, seed, width=24):
    r = np.random.default_rng(seed)
    c = r.normal(size=(n // 12, width))
    return (c[r.integers(0, len(c), n)] + 0.2 * r.normal(size=(n, width))).astype(np.float32)


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vg, "SHARD", 400)
    x = clustered(2500, 1)
    d = spark.createDataFrame([(i, [float(v) for v in x[i]], "", "", "", "") for i in range(len(x))], SCHEMA)
    got = {(r.chunk_id, r.neighbor_id) for r in vg.nearest(d, 5, 0.85).collect()}
    want = brute(list(range(len(x))), x, 5, 0.85)
    assert len(got & want) / len(want) > 0.95
    top = {(r.chunk_id, r.neighbor_id) for r in vg.nearest(d, 5).collect()}
    assert len(top & brute(list(range(len(x))), x, 5, -1)) / (5 * len(x)) > 0.9


def test_copies_ties_and_dirt(spark):
    a, b = [1.0, 0.0, 0.0], [0.99, 0.1, 0.0]
    rows = [(i, a) for i in range(1, 10)] + [(20, b), (21, b), (30, None), (31, [0.0, 0.0, 0.0]), (32, [float("nan"), 1.0, 0.0]), (33, [1.0]), (34, []), (40, [0.0, 0.0, -2.0])]
    d = spark.createDataFrame([(i, v, "", "", "", "") for i, v in rows], SCHEMA)
    got = {}
    for r in vg.nearest(d, 5, 0.85).orderBy("chunk_id", "neighbor_id").collect():
        got.setdefault(r.chunk_id, []).append(r.neighbor_id)
    assert got[1] == [2, 3, 4, 5, 6] and got[9] == [1, 2, 3, 4, 5] and got[3] == [1, 2, 4, 5, 6]
    assert got[20] == [1, 2, 3, 4, 21] and set(got) == {*range(1, 10), 20, 21}


def test_a_dense_region_is_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(vg, "SHARD_MAX", 100)
    r = np.random.default_rng(5)
    x = (np.ones((450, 8)) + 0.3 * r.normal(size=(450, 8))).astype(np.float32)
    d = spark.createDataFrame([(i, [float(v) for v in x[i]], "", "", "", "") for i in range(450)], SCHEMA)
    got = {(r.chunk_id, r.neighbor_id) for r in vg.nearest(d, 5, 0.85).collect()}
    want = brute(list(range(450)), x, 5, 0.85)
    assert len(got & want) / len(want) > 0.95


def test_a_dense_region_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(vg, "SHARD", 75)
    monkeypatch.setattr(vg, "SHARD_MAX", 900)
    monkeypatch.setattr(vg, "SLICE", 700, raising=False)
    r = np.random.default_rng(6)
    middle = r.normal(size=48)
    x = np.concatenate([clustered(3200, 3, 48), middle / np.linalg.norm(middle) + 0.045 * r.normal(size=(1600, 48))]).astype(np.float32)
    d = spark.createDataFrame([(i, [float(v) for v in x[i]], "", "", "", "") for i in range(len(x))], SCHEMA)
    got = {(r.chunk_id, r.neighbor_id) for r in vg.nearest(d, 5, 0.85).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    sims = u @ u.T - 9 * np.eye(len(u))
    best = np.argpartition(-sims, 5, axis=1)[:, :5]
    want = {(i, int(j)) for i in range(len(u)) for j in best[i] if sims[i, j] >= 0.85}
    dense = {p for p in want if p[0] >= 3200}
    assert len(dense) > 5000 and len(got & dense) / len(dense) > 0.97 and len(got & want) / len(want) > 0.97


def test_a_second_level_of_centroids(spark, monkeypatch):
    for name, value in (("SHARD", 20), ("SHARD_MAX", 60), ("SAMPLE", 320), ("SLICE", 100), ("NEAR", 0.0)):  # twenty first-level shards at most
        monkeypatch.setattr(vg, name, value)
    x = np.concatenate([clustered(1600, 9, 48), np.ones(48) + 0.4 * clustered(800, 10, 48)]).astype(np.float32)  # a third lies close together
    d = spark.createDataFrame([(i, [float(v) for v in x[i]], "", "", "", "") for i in range(len(x))], SCHEMA)
    routed, sizes, total = vg._shards(d.select(d.chunk_id.alias("id"), d.content_vector.alias("v")))
    assert sizes.filter("sub > 0").count() > 3 and routed.filter("home").select("id").distinct().count() == routed.filter("home").count() == len(x) and total >= len(x)
    want = brute(list(range(len(x))), x, 5, 0.85)
    one = {(r.chunk_id, r.neighbor_id) for r in vg.nearest(d, 5, 0.85).collect()}
    assert len(one & want) / len(want) > 0.95
    assert one == {(r.chunk_id, r.neighbor_id) for r in vg.nearest(d.repartition(7), 5, 0.85).collect()}


def test_empty_and_single(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0], "", "", "", "")], SCHEMA)
    assert vg.nearest(d, 5).count() == 0 and vg.nearest(d.limit(0), 5).count() == 0


@pytest.mark.parametrize("n", [1, 2, 9, 300])
def test_graph_is_searchable(n):
    x = vg._unit(clustered(max(n, 12), 2)[:n])
    graph, entry, _, _ = vg.build_graph(x)
    assert graph.shape == (n + 1, vg.DEGREE) and graph.max() <= n
    ids, sims = vg.beam_search(x, graph, entry, x, vg.BEAM)
    assert (ids[:, 0] == np.arange(n)).mean() > 0.95 and (np.diff(sims, axis=1) <= 1e-6).all()


def test_shards_are_searched_once(spark):
    x = clustered(300, 4)
    d = spark.createDataFrame([(i, [float(v) for v in x[i]], "", "", "", "") for i in range(len(x))], SCHEMA)
    near = vg.nearest(d, 5, 0.85)
    assert near._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInArrow") == 1
    want = brute(list(range(len(x))), x, 5, 0.85)
    assert len({(r.chunk_id, r.neighbor_id) for r in near.collect()} & want) / len(want) > 0.95

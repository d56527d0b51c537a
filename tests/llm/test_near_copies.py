import random
import re

from pyspark.sql import functions as F

from quillspark.llm import near_copies as nc

SCHEMA = "rec string, id long, text string"


def shingle_set(t, k):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= 20 else None


def brute(rows, threshold, k):
    s = [(r, i, shingle_set(t, k)) for r, i, t in rows]
    s = [x for x in s if x[2]]
    return {(a[0], min(a[1], b[1]), max(a[1], b[1])) for n, a in enumerate(s) for b in s[:n] if a[0] == b[0] and len(a[2] & b[2]) / len(a[2] | b[2]) >= threshold}


def corpus(seed, n=120):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocab) for _ in range(r.randint(22, 60))] for _ in range(n)]
    rows = []
    for i, b in enumerate(base):
        rows.append(("chunk" if i % 3 else "side", len(rows), " ".join(b)))
        for _ in range(r.randint(0, 3)):
            c = list(b)
            for _ in range(r.randint(0, 5)):
                c[r.randrange(len(c))] = r.choice(vocab)
            rows.append(("chunk" if i % 3 else "side", len(rows), " ".join(c).title()))
    return rows


def test_pairs_against_brute_force(spark, wide):
    rows = corpus(1) + [("chunk", 9001, None), ("chunk", 9002, ""), ("chunk", 9003, "too few words"), ("chunk", 9004, "a b " * 5000), ("chunk", 9005, "A  b " * 5000)]
    d = wide(spark.createDataFrame(rows, SCHEMA))
    for t, k in ((0.6, 3), (0.8, 5)):
        got = [tuple(x) for x in nc.pairs_of_records(d, t, k).collect()]
        want = brute(rows, t, k)
        assert len(got) == len(set(got)) and set(got) <= want and len(want & set(got)) >= 0.99 * len(want)


def test_groups(spark):
    rows = corpus(2)
    d = spark.createDataFrame(rows, SCHEMA)
    pairs = brute(rows, 0.6, 3)
    parent = {(r, i): (r, i) for r, i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r, a, b in pairs:
        a, b = find((r, a)), find((r, b))
        parent[max(a, b)] = min(a, b)
    got = nc.groups(d, 0.6, 3).collect()
    assert len(got) == len(rows)
    assert sum(find((r.rec, r.id))[1] != r.group_id for r in got) <= 0.01 * len(rows)


def test_many_copies_stay_one_class(spark):
    text = " ".join(f"word{i}" for i in range(30))
    d = spark.range(3000).select(F.lit("chunk").alias("rec"), F.col("id"), F.lit(text).alias("text"))
    g = nc.groups(d, 0.8, 5).agg(F.countDistinct("class_id").alias("c"), F.sum("links").alias("l")).first()
    assert (g.c, g.l) == (1, 0)


def test_components_of_a_path(spark):
    e = spark.createDataFrame([("x", i, i + 1) for i in range(40)] + [("y", 0, 1)], "rec string, a long, b long")
    got = {(r.rec, r.id): r.group_id for r in nc.components(e).collect()}
    assert len(got) == 43 and set(got.values()) == {0}


def test_empty(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert nc.pairs_of_records(d, 0.6, 3).count() == 0 and nc.groups(d, 0.6, 3).count() == 0


def test_estimate_follows_similarity(spark):
    import numpy as np

    r = np.random.default_rng(0)
    u = np.unique(r.integers(0, 2**32, 600, dtype=np.uint32))
    sets = [np.sort(u[:400]), np.sort(u[100:500])]
    p, _ = nc.signatures(sets)
    cols = [F.lit(int(v)) for v in p.view(np.int64).T.ravel()]
    est = spark.range(1).select(nc.estimate(*cols).alias("e")).first().e
    assert abs(est - 0.6) < 0.25

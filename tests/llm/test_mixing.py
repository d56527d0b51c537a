import math

import pytest

from quillspark.llm import mixing


def test_weights_between_targets_and_shares():
    t, n = {"a": 0.7, "b": 0.3}, {"a": 100.0, "b": 900.0}
    assert mixing.weights(t, n, 0.0) == pytest.approx(t) and mixing.weights(t, n, 1.0) == pytest.approx({"a": 0.1, "b": 0.9})


def test_exponent_is_the_least_that_keeps_the_limits():
    t, n, r = {"a": 1.0, "b": 1.0}, {"a": 100.0, "b": 1000.0}, {"a": 2, "b": 1}
    a, size, w = mixing.solve(t, n, r)
    assert a == 0 and size == pytest.approx(400) and w == pytest.approx({"a": 0.5, "b": 0.5})
    a, size, w = mixing.solve(t, n, r, total=600)
    assert 0 < a < 1 and size == pytest.approx(600) and w["a"] * 600 == pytest.approx(200, rel=1e-6)
    goal = 0.5
    a, _, w = mixing.solve(t, n, r, target_entropy=goal)
    assert mixing.entropy(w) == pytest.approx(goal, rel=1e-6)
    assert mixing.solve({"a": None, "c": 1.0}, n, r) == (0.0, 0.0, {})


def frames(spark):
    docs = [(i, s, "word " * (5 + i * 7 % 40)) for i, s in enumerate(["big"] * 400 + ["small"] * 30 + ["other"] * 100)] + [(1000, "big", None), (1001, "big", ""), (1002, None, "no source"), (1003, "untargeted", "text")]
    return spark.createDataFrame(docs, "doc_id long, source string, text string"), spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("other", 0.2, 2), ("absent", 0.1, 2), ("none", None, None), (None, 0.5, 1)], "source string, target_share double, max_repeats int")


def test_shares_are_reached(spark, wide):
    docs, targets = frames(spark)
    got = {r.source: r for r in mixing.shares(wide(docs), wide(targets)).collect()}
    for s, share in (("big", 0.5), ("small", 0.3), ("other", 0.2)):
        assert math.isclose(got[s].actual_share, share, abs_tol=0.02) and got[s].most_times <= got[s].max_repeats
    assert got["absent"].actual_share == 0 and got["none"].drawn == 0
    m = mixing.mix(docs, targets).collect()
    assert {r.source for r in m} == {"big", "small", "other"} and len({r.doc_id for r in m}) == len(m) and min(r.times for r in m) >= 1
    assert sorted(map(tuple, m)) == sorted(map(tuple, mixing.mix(docs.repartition(7), targets).collect()))


def test_blocks_do_not_change_the_budget(spark):
    docs, targets = frames(spark)
    sized = mixing.token_table(docs)
    rows, repeats, (_, size, w) = mixing.plan_mix(sized, targets)
    for blocks in (1, 3, 1000):
        drawn = sum(r.tokens * r.times for r in mixing.draw(sized, rows, repeats, size, w, blocks=blocks).collect())
        assert math.isclose(drawn, size, rel_tol=0.02)


def test_empty(spark):
    docs, targets = frames(spark)
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0


def test_fill_and_leaning_move_the_exponent(spark):
    docs = spark.createDataFrame([(i, "word " * (5 + i % 7), "a" if i < 40 else "b") for i in range(400)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in mixing.shares(docs, targets, fill=1.0).collect()}
    total = sum(r.tokens for r in got.values())
    assert 0 < got["a"].exponent < 1 and got["a"].most_times == 2 and abs(sum(r.drawn for r in got.values()) - total) < 0.02 * total
    half = {r.source: r for r in mixing.shares(docs, targets, leaning=0.5).collect()}
    assert 0 < half["a"].exponent < 1 and half["a"].weight < 0.5 and abs(half["a"].actual_share - half["a"].weight) < 0.03

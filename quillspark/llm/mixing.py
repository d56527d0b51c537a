"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Weights are w_i ~ target_i^(1-a) * share_i^a, where share_i is the source's share of all tokens. At a = 0 they are the
targets, at a = 1 the natural shares. ``a`` is bisected: it is the least exponent at which the wanted total size
breaks no source's repetition limit (and, where asked, at which the entropy of the weights reaches a target). Without a
wanted total, the total is the largest at which the targets hold exactly, so a = 0.

A source's budget of tokens is met by whole passes over it and one partial pass: a permutation of its documents, in
blocks by a hash of the id, as many as the root of their number. Whole blocks are taken while they fit; only in the block where the budget ends are
documents ordered and summed one by one. Token sums per block are all that is ever gathered per source, so a source
that holds a third of the corpus is never in one task.

Defined results: documents without tokens (null and empty texts) and sources without a target or without documents are
not drawn; a target without documents is reported with an actual share of zero, and the other targets are
renormalised. Null or non-positive targets count as none, null limits as one use. Repeated targets of one source are
summed and the larger limit holds. The draw depends only on ids and the seed, not on the order of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.token_ids import encode_corpus
from quillspark.session import materialize

SEED, MAX_SOURCES = 17, 100_000


def weights(targets: dict[str, float], tokens: dict[str, float], exponent: float) -> dict[str, float]:
    """The normalised weights at an exponent between target shares (0) and natural shares (1)."""
    total = sum(tokens.values())
    logs = {s: (1 - exponent) * math.log(targets[s]) + exponent * math.log(tokens[s] / total) for s in targets}
    top = max(logs.values())
    raw = {s: math.exp(v - top) for s, v in logs.items()}
    norm = math.fsum(raw.values())
    return {s: v / norm for s, v in raw.items()}


def entropy(w: dict[str, float]) -> float:
    return -math.fsum(x * math.log(x) for x in w.values() if x > 0)


def solve(targets: dict[str, float], tokens: dict[str, float], repeats: dict[str, int], total: float | None = None, target_entropy: float | None = None) -> tuple[float, float, dict[str, float]]:
    """(exponent, total size, weights). Sources are those with a target and with tokens."""
    own = {s: t for s, t in targets.items() if t and t > 0 and tokens.get(s, 0) > 0}
    if not own:
        return 0.0, 0.0, {}
    norm = math.fsum(own.values())
    own = {s: t / norm for s, t in own.items()}
    have = {s: tokens[s] for s in own}
    cap = {s: have[s] * max(1, repeats.get(s) or 1) for s in own}
    reach = lambda w: min(cap[s] / w[s] for s in w)  # noqa: E731  the largest total at these weights

    def least(holds) -> float:
        if holds(0.0):
            return 0.0
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if holds(mid) else (mid, hi)
        return hi

    a = 0.0
    if target_entropy is not None:
        end = entropy(weights(own, have, 1.0)) >= entropy(own)
        a = least(lambda x: (entropy(weights(own, have, x)) >= target_entropy) == end)
    if total is not None:
        a = max(a, least(lambda x: reach(weights(own, have, x)) >= total))
    w = weights(own, have, a)
    return a, min(reach(w), total if total is not None else math.inf), w


def token_table(docs: DataFrame) -> DataFrame:
    """(doc_id, source, tokens), written once: the only pass over the texts."""
    return materialize(encode_corpus(docs, count_only=True, keep=("source",)).withColumnRenamed("n_tokens", "tokens"), "mix-tokens")


def plan_mix(sized: DataFrame, mix_targets: DataFrame, total: float | None = None, target_entropy: float | None = None, fill: float | None = None, leaning: float | None = None):
    """The solved plan. Only one row per source reaches the driver, and their number is checked.

    ``fill`` asks for a total of so many times the tokens of all sources with a target; ``leaning`` for an entropy between that of the target
    shares (0) and that of the natural shares (1).
    """
    t = mix_targets.filter("source IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    sums = sized.filter("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    rows = t.join(sums, "source", "left").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError("too many sources in the targets")
    targets, tokens = {r.source: r.target_share for r in rows}, {r.source: float(r.tokens or 0) for r in rows}
    repeats = {r.source: max(1, r.max_repeats or 1) for r in rows}
    own = {s: t for s, t in targets.items() if t and t > 0 and tokens[s] > 0}
    if fill is not None:
        total = fill * math.fsum(tokens[s] for s in own)
    if leaning is not None and own:
        norm = math.fsum(own.values())
        ends = [entropy(weights({s: t / norm for s, t in own.items()}, {s: tokens[s] for s in own}, x)) for x in (0.0, 1.0)]
        target_entropy = ends[0] + leaning * (ends[1] - ends[0])
    return rows, repeats, solve(targets, tokens, repeats, total, target_entropy)


def draw(sized: DataFrame, rows: list, repeats: dict[str, int], size: float, w: dict[str, float], seed: int = SEED, blocks: int | None = None) -> DataFrame:
    """(doc_id, source, tokens, times): how often each document is used; those with none are left out."""
    spark = sized.sparkSession
    have = {r.source: int(r.tokens or 0) for r in rows}
    budget = {s: min(int(round(size * x)), have[s] * repeats[s]) for s, x in w.items()}
    docs = {r.source: int(r.docs or 0) for r in rows}
    plan = spark.createDataFrame([(s, b // have[s], b % have[s], blocks or math.isqrt(docs[s]) + 1) for s, b in budget.items()], "source string, passes long, rest long, _blocks long")
    d = sized.filter("tokens > 0").join(plan, "source").withColumn("_h", F.xxhash64(F.col("doc_id"), F.lit(seed))).withColumn("_block", F.pmod("_h", "_blocks"))
    per_block = d.groupBy("source", "_block").agg(F.sum("tokens").alias("_block_tokens"))  # the root of a source's documents at most
    before = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    placed = per_block.withColumn("_before", F.coalesce(F.sum("_block_tokens").over(before), F.lit(0)))
    d = d.join(placed, ["source", "_block"])
    inside = (F.col("_before") < F.col("rest")) & (F.col("_before") + F.col("_block_tokens") > F.col("rest"))
    whole = d.filter(~inside).withColumn("_more", (F.col("_before") + F.col("_block_tokens") <= F.col("rest")).cast("long"))
    within = Window.partitionBy("source", "_block").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    # in the block where the budget ends, a document is used while its middle lies below the budget
    part = d.filter(inside).withColumn("_more", (F.col("_before") + F.sum("tokens").over(within) - F.col("tokens") / 2 < F.col("rest")).cast("long"))
    times = F.col("passes") + F.col("_more")
    cols = ["doc_id", "source", "tokens", times.alias("times")]
    return whole.select(cols).unionByName(part.select(cols)).filter("times > 0")


def mix(docs: DataFrame, mix_targets: DataFrame, **wanted: float) -> DataFrame:
    """(doc_id, source, tokens, times): the draw; ``wanted`` as for plan_mix."""
    sized = token_table(docs)
    rows, repeats, (_, size, w) = plan_mix(sized, mix_targets, **wanted)
    return draw(sized, rows, repeats, size, w)


def shares(docs: DataFrame, mix_targets: DataFrame, **wanted: float) -> DataFrame:
    """The report: per target its share, weight, exponent, tokens at hand and drawn, the share reached, and the most uses of a document."""
    sized = token_table(docs)
    rows, repeats, (a, size, w) = plan_mix(sized, mix_targets, **wanted)
    got = draw(sized, rows, repeats, size, w).groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("drawn"), F.max("times").alias("most_times"))
    plan = sized.sparkSession.createDataFrame([(r.source, float(r.target_share or 0), int(repeats[r.source]), int(r.tokens or 0), float(w.get(r.source, 0.0)), a) for r in rows], "source string, target_share double, max_repeats int, tokens long, weight double, exponent double")
    out = plan.join(got, "source", "left").fillna(0, ["drawn", "most_times"])
    return out.withColumn("actual_share", F.coalesce(F.col("drawn") / F.nullif(F.sum("drawn").over(Window.partitionBy(F.lit(0))), F.lit(0)), F.lit(0.0)))

"""Near-duplicate records by b-bit MinHash.

A record is the set of its word shingles. Records with equal sets form a class and only its representative (the
least id) goes on. Of a representative's minima the low ``BITS`` bits are kept, packed into two longs; bands of three
minima give candidates. The band join itself evaluates the collision-corrected estimate by bit counts and lets only
pairs through that can reach the threshold (a margin of 3.3 standard deviations), so no bucket's pairs are ever
written out as such. What is left is decided by the exact Jaccard similarity of the shingle sets.

All of it after fingerprinting runs on the JVM. The band join is a sort-merge join on a 64-bit key that adaptive
execution splits where a bucket is hot. Nothing is capped. Loss: a pair of similarity s shares no band
with probability (1 - s^3)^24, which is 0.3 % at 0.6 and 0.005 % at 0.7. Shingles are compared by 32-bit hashes.

Defined results: null texts and texts with fewer than ``min_words`` words take part in no pair and are their own
class. Equal texts and repeated rows are pairs with similarity 1. Ids are unique per kind of record; kinds are never mixed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import materialize

BANDS, ROWS, BITS, PACKED = 24, 3, 2, 64
MINIMA = BANDS * ROWS
_WORD = re.compile(r"[^\W_]+")
_RNG = np.random.default_rng(4242)
_A = _RNG.integers(1, 2**32, size=MINIMA, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 2**32, size=MINIMA, dtype=np.uint32)
_BAND_MUL = _RNG.integers(1, 2**63, size=(BANDS, ROWS + 1), dtype=np.uint64) | np.uint64(1)
_PLACE = [np.uint64(x) for x in _RNG.integers(1, 2**63, size=16, dtype=np.uint64) | np.uint64(1)]


class _Hashes(dict):
    """Word hashes, remembered; emptied where a corpus has unusually many words."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 2_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(words: list[str], k: int, hashes: dict) -> np.ndarray:
    """The set of runs of ``k`` words, as sorted 32-bit hashes."""
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(h) - k + 1
    s = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        s += _mix(h[i : i + n] * _PLACE[i])
    s = np.sort((_mix(s) >> np.uint64(32)).astype(np.uint32))
    return s[np.append(True, s[1:] != s[:-1])]


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(packed low bits as two uint64 per set, band keys) of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    minima = np.empty((MINIMA, len(sets)), dtype=np.uint32)
    for i in range(MINIMA):
        minima[i] = np.minimum.reduceat(flat * _A[i] + _B[i], starts)
    low = minima[:PACKED]
    low = (low ^ (low >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    low = ((low ^ (low >> np.uint32(13))) & np.uint32(2**BITS - 1)).astype(np.uint64)
    half = 64 // BITS
    packed = np.stack([np.bitwise_or.reduce(low[j * half : (j + 1) * half] << (np.arange(half, dtype=np.uint64) * np.uint64(BITS))[:, None], axis=0) for j in range(PACKED // half)], axis=1)
    wide = minima.astype(np.uint64)
    keys = np.empty((len(sets), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        k = np.full(len(sets), _BAND_MUL[b, ROWS])
        for r in range(ROWS):
            k = _mix(k + wide[b * ROWS + r] * _BAND_MUL[b, r])
        keys[:, b] = k
    return packed, keys


def _fingerprints(k: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            for at in range(0, b.num_rows, 1024):  # bounds what a task holds
                part = b.slice(at, 1024)
                take, sets = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    if text and len(words := _WORD.findall(text.lower())) >= min_words:
                        take.append(i)
                        sets.append(shingles(words, k, hashes))
                if not sets:
                    continue
                packed, keys = signatures(sets)
                flat, ends = np.concatenate(sets), np.cumsum([0, *map(len, sets)]).astype(np.int32)
                wide = flat.astype(np.uint64)
                h1 = np.add.reduceat(_mix(wide * _PLACE[7]), ends[:-1])
                h2 = np.add.reduceat(_mix(wide * _PLACE[9] + _PLACE[11]), ends[:-1])
                rows = np.arange(len(sets) + 1, dtype=np.int32) * BANDS
                yield pa.RecordBatch.from_arrays(
                    [part.column("rec").take(pa.array(take)), part.column("id").take(pa.array(take)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *(pa.array(np.ascontiguousarray(packed[:, j]).view(np.int64)) for j in range(2)),
                     pa.ListArray.from_arrays(pa.array(rows), pa.array(keys.ravel().view(np.int64))), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int32)))],
                    ["rec", "id", "h1", "h2", "s1", "s2", "bands", "shingles"],
                )

    return run


def estimate(a1, b1, a2, b2):
    """Similarity from two packed signatures: the share of equal b-bit values, corrected for chance collisions."""
    ones = int("".join(["0" * (BITS - 1) + "1"] * (64 // BITS)), 2)
    ones = ones - 2**64 if ones >= 2**63 else ones

    def differing(a, b):
        x = a.bitwiseXOR(b)
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(ones)))

    chance = 2.0**-BITS
    return (1 - (differing(a1, b1) + differing(a2, b2)) / PACKED - chance) / (1 - chance)


class NearCopies:
    """Classes of equal shingle sets and the pairs of their representatives.

    ``records`` has (rec, id, text). ``classes``: (rec, rep, id) for every record that takes part. ``pairs``: (rec, rep_a, rep_b, similarity).
    """

    def __init__(self, records: DataFrame, threshold: float, k: int, min_words: int):
        src = records.select(F.col("rec").cast("string").alias("rec"), F.col("id").cast("long").alias("id"), "text")
        made = src.mapInArrow(_fingerprints(k, min_words), "rec string, id long, h1 long, h2 long, s1 long, s2 long, bands array<long>, shingles array<int>")
        self.table = materialize(made, "near-copies")
        of = ["rec", "h1", "h2"]
        reps = self.table.groupBy(of).agg(F.min("id").alias("rep"))
        self.classes = materialize(self.table.select(*of, "id").join(reps, of).select("rec", "rep", "id"), "near-classes")
        alone = self.classes.filter("rep = id").select("rec", "id")
        chosen = self.table.join(alone, ["rec", "id"], "left_semi")
        banded = chosen.select("rec", "id", "s1", "s2", F.explode("bands").alias("band"))
        a, b = banded.alias("a"), banded.alias("b")
        spread = (0.75 * threshold + 0.25) * (0.75 - 0.75 * threshold) / PACKED
        least = threshold - 3.3 * spread**0.5 / 0.75
        near = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.rec") == F.col("b.rec")) & (F.col("a.id") < F.col("b.id")) & (estimate(F.col("a.s1"), F.col("b.s1"), F.col("a.s2"), F.col("b.s2")) >= least))
        candidates = near.select(F.col("a.rec").alias("rec"), F.col("a.id").alias("rep_a"), F.col("b.id").alias("rep_b")).distinct()
        sets = self.table.select("rec", "id", "shingles")
        both = candidates.join(sets.toDF("rec", "rep_a", "_a"), ["rec", "rep_a"]).join(sets.toDF("rec", "rep_b", "_b"), ["rec", "rep_b"])
        common = F.size(F.array_intersect("_a", "_b"))
        self.pairs = both.select("rec", "rep_a", "rep_b", (common / (F.size("_a") + F.size("_b") - common)).alias("similarity")).filter(F.col("similarity") >= threshold)


def pairs_of_records(records: DataFrame, threshold: float = 0.8, k: int = 5, min_words: int = 20) -> DataFrame:
    """(rec, id_a, id_b), id_a < id_b: all pairs of records, those within a class of equal sets included."""
    n = NearCopies(records, threshold, k, min_words)
    c = n.classes
    same = c.alias("a").join(c.alias("b"), (F.col("a.rec") == F.col("b.rec")) & (F.col("a.rep") == F.col("b.rep")) & (F.col("a.id") < F.col("b.id"))).select("a.rec", F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
    left, right = c.toDF("rec", "rep_a", "_x"), c.toDF("rec", "rep_b", "_y")
    other = n.pairs.select("rec", "rep_a", "rep_b").join(left, ["rec", "rep_a"]).join(right, ["rec", "rep_b"]).select("rec", F.least("_x", "_y").alias("id_a"), F.greatest("_x", "_y").alias("id_b"))
    return same.unionByName(other)


def components(edges: DataFrame) -> DataFrame:
    """(rec, id, group_id): each node of the edges (rec, a, b) with the least id it is connected to.

    Alternates large-star and small-star steps; each is an aggregation and a join, no neighbourhood is ever
    gathered, and each round is written to the shared folder. Rounds grow with the logarithm of the longest path.
    """
    e = materialize(edges.filter("a <> b").select("rec", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    last = None
    while True:
        both = e.unionByName(e.select("rec", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("rec", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, ["rec", "u"]).select("rec", F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("rec", "u").agg(F.min("v").alias("m"))
        small = large.join(low, ["rec", "u"]).select("rec", F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("rec", "u", F.col("m").alias("v")))
        e = materialize(small.filter("u <> v").distinct(), "links")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("rec", "u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            return e.select("rec", F.col("u").alias("id"), F.col("v").alias("group_id")).unionByName(e.select("rec", F.col("v").alias("id"), F.col("v").alias("group_id")).distinct())
        last = now


def groups(records: DataFrame, threshold: float = 0.8, k: int = 5, min_words: int = 20) -> DataFrame:
    """One row per record: (rec, id, class_id, group_id, links).

    ``class_id`` is the least id with the same shingle set, ``group_id`` the least of all it is linked to directly or
    through others, ``links`` the number of other classes it is similar to. Copies aren't expanded into pairs.
    """
    n = NearCopies(records, threshold, k, min_words)
    pairs = materialize(n.pairs, "near-pairs")
    group = components(pairs.select("rec", F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    ends = pairs.select("rec", F.explode(F.array("rep_a", "rep_b")).alias("id")).groupBy("rec", "id").agg(F.count("*").alias("links"))
    per_class = group.join(ends, ["rec", "id"], "left").withColumnRenamed("id", "rep")
    member = n.classes.join(per_class, ["rec", "rep"], "left")
    ids = records.select(F.col("rec").cast("string").alias("rec"), F.col("id").cast("long").alias("id"))
    out = ids.join(member, ["rec", "id"], "left")
    return out.select("rec", "id", F.coalesce("rep", "id").alias("class_id"), F.coalesce("group_id", "rep", "id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))

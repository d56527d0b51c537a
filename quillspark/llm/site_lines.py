"""Lines repeated across one site's documents, found by content-defined chunking.

A text is one stream of bytes in normal form, in which a line end is a space like any other. It is cut where the rolling hash of GRAM bytes is the
least of its neighbourhood (of SPAN places in a row, the first of equal ones), so that a chunk depends on its own content and is the
same wherever the passage recurs, whatever its lines. Distinct documents are counted per chunk and source; chunks in ``min_docs``
documents are repeated.

The required result is told by line, so repeated chunks are mapped to lines: within a line of ENOUGH bytes the first cut and the one after
it follow from the line alone (at most SPAN places lie between neighbouring cuts, and no window from outside can cut between them), so its first
whole chunk recurs wherever the line does, and a line whose chunk is not repeated isn't either. Shorter lines may hold no whole chunk: for
them, and to tell a line that shares a chunk with others from a repeated one, documents are counted per 128-bit hash of the line. Nothing is
capped and no line is lost on the way.

Skew: pairs of (source and chunk, document) are made distinct first and then counted, with map-side partial
aggregation at both steps; the joins are sort-merge joins on (source, hash) that adaptive execution splits.

Defined results: null and empty texts have no lines; a null source or path counts as the empty string; repeated
rows of a document count once and all of them are cut; lines with a short normal form are never cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.pieces import lines_as_lf
from quillspark.session import materialize

MIN_CHARS = 12
#: Bytes of the rolling hash, places of which the least is a cut (a power of two), and bytes in which a whole chunk must lie.
GRAM, SPAN = 8, 32
ENOUGH = 2 * SPAN + GRAM - 1
#: Bytes of text handled at once; a place takes as many bits of a key.
PLACE_BITS = 30
_DIGITS = re.compile(r"\d+")


def _plain(line: str) -> str:
    """Lower case, white space as one space, digit runs as 0."""
    return _DIGITS.sub("0", " ".join(line.lower().split()))


def _inner(s: str) -> tuple[int, int]:
    """Where the first letter or digit stands, and behind the last."""
    i, j = 0, len(s)
    while i < j and not s[i].isalnum():
        i += 1
    while j > i and not s[j - 1].isalnum():
        j -= 1
    return i, j


def normal_form(line: str) -> str:
    s = _plain(line)
    i, j = _inner(s)
    return s[i:j]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_RNG = np.random.default_rng(20240607)
_TABLES = _RNG.integers(1, 2**63, size=(3, 256), dtype=np.uint64)
_BASES = [int(x) | 1 for x in _RNG.integers(2**40, 2**63, size=3)]
_INVERSES = [pow(b, -1, 2**64) for b in _BASES]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """A polynomial hash of each byte range, independent of where the range lies."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLES[k][data] * _powers(_BASES[k], len(data)), out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * _powers(_INVERSES[k], len(data) + 1)[starts])


def least_places(data: np.ndarray) -> np.ndarray:
    """For each place the one, of the SPAN places from it on, whose gram has the least hash; of equal ones the first."""
    n = len(data) - GRAM + 1
    if n < SPAN:
        return np.empty(0, dtype=np.int64)
    t = _TABLES[2][data]
    h = np.zeros(n, dtype=np.uint64)
    for i in range(GRAM):
        h += t[i : n + i] << np.uint64(5 * (GRAM - 1 - i))
    low = np.uint64(2**PLACE_BITS - 1)
    key = (_mix(h) & ~low) | np.arange(n, dtype=np.uint64)
    step = 1
    while step < SPAN:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    return (key & low).astype(np.int64)


def fingerprints(data: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that begin at ``rows`` of the bytes: the row and hash of each chunk; and of the lines two hashes each and the hash of their first whole chunk, 0 where none must lie in them."""
    least = least_places(data)
    cuts = np.union1d(least, rows)
    chunk = _range_hashes(data, cuts, np.append(cuts[1:], len(data)), 2).view(np.int64)
    probe = np.zeros(len(starts), dtype=np.int64)
    long = np.flatnonzero(ends - starts >= ENOUGH)
    probe[long] = chunk[np.searchsorted(cuts, least[starts[long]])]
    h1, h2 = (_range_hashes(data, starts, ends, k).view(np.int64) for k in (0, 1))
    return np.searchsorted(rows, cuts, side="right") - 1, chunk, h1, h2, probe


_LINE = pa.struct([("line_no", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("probe", pa.int64())])


def _lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):  # bounds what a task holds
                part = b.slice(at, 512)
                take, rows, owner, no, starts, ends, stream, size = [], [], [], [], [], [], [], 0
                for i, text in enumerate(part.column("text").to_pylist()):
                    if not text:
                        continue
                    rows.append(size)
                    take.append(i)
                    for k, line in enumerate(text.replace("\r\n", "\n").split("\n")):
                        s = _plain(line)
                        x, y = _inner(s)
                        raw = s.encode()
                        if y - x >= min_chars:
                            lead = len(s[:x].encode())
                            owner.append(len(rows) - 1)
                            no.append(k)
                            starts.append(size + lead)
                            ends.append(size + lead + len(s[x:y].encode()))
                        stream.append(raw)
                        size += len(raw) + 1
                if not owner:
                    continue
                data = np.frombuffer(b" ".join(stream) + b" ", dtype=np.uint8)
                row, chunk, *hashes = fingerprints(data, *(np.asarray(v, dtype=np.int64) for v in (rows, starts, ends)))
                rows_at = lambda x: pa.array(np.searchsorted(x, np.arange(len(rows) + 1)).astype(np.int32))
                lines = pa.StructArray.from_arrays([pa.array(no, pa.int32()), *map(pa.array, hashes)], fields=list(_LINE))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(pa.array(take)) for c in ("chunk_id", "site", "doc")), pa.ListArray.from_arrays(rows_at(row), pa.array(chunk)), pa.ListArray.from_arrays(rows_at(np.asarray(owner)), lines)],
                    ["chunk_id", "site", "doc", "segments", "lines"],
                )

    return run


def line_table(chunks: DataFrame, id_col: str = "chunk_id", site_col: str = "project", doc_col: str = "source_path", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per text with a line that can count: the hashes of its chunks, and its lines with their hashes and probes. Site and document are 64-bit hashes."""
    hashed = lambda c: F.xxhash64(F.coalesce(F.col(c), F.lit("")))
    src = chunks.select(F.col(id_col).cast("long").alias("chunk_id"), hashed(site_col).alias("site"), hashed(doc_col).alias("doc"), F.col("text").alias("text"))
    return src.mapInArrow(_lines(min_chars), "chunk_id long, site long, doc long, segments array<long>, lines array<struct<line_no:int,h1:long,h2:long,probe:long>>")


def repeated_lines(chunks: DataFrame, min_docs: int = 5, **cols) -> DataFrame:
    """(chunk_id, line_no) of every line whose normal form lies in at least ``min_docs`` documents of its source."""
    texts = materialize(line_table(chunks, **cols), "site-lines")
    frequent = lambda df, *keys: df.groupBy("site", *keys, "doc").agg(F.lit(1).alias("one")).groupBy("site", *keys).agg(F.count("one").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs")
    repeated = frequent(texts.select("site", "doc", F.explode(F.array_distinct("segments")).alias("probe")), "probe")
    lines = texts.select("chunk_id", "site", "doc", F.explode("lines").alias("l")).select("chunk_id", "site", "doc", "l.*")
    candidates = lines.filter("probe <> 0").join(repeated, ["site", "probe"], "left_semi").select(lines.columns).unionByName(lines.filter("probe = 0"))
    exact = frequent(candidates.select("site", "h1", "h2", "doc"), "h1", "h2")
    return candidates.join(exact, ["site", "h1", "h2"], "left_semi").select("chunk_id", "line_no")


def without_repeated_lines(chunks: DataFrame, min_docs: int = 5) -> DataFrame:
    """(chunk_id, text, lines_cut): every chunk, its repeated lines taken out; a null text stays null."""
    cut = repeated_lines(chunks, min_docs).groupBy("chunk_id").agg(F.collect_set("line_no").alias("_cut"))
    t = F.split(lines_as_lf(F.col("text")), "\n", -1)
    joined = chunks.select("chunk_id", "text").join(cut, "chunk_id", "left")
    kept = F.array_join(F.filter(t, lambda _, i: ~F.array_contains(F.col("_cut"), i)), "\n")
    return joined.select("chunk_id", F.when(F.col("_cut").isNull(), F.col("text")).otherwise(kept).alias("text"), F.coalesce(F.size("_cut"), F.lit(0)).alias("lines_cut"))

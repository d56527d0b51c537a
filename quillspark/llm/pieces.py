"""Splitting oversized texts at natural boundaries, with bounded-quantifier regular expressions.

All of it is SQL array functions on the JVM. A regular expression whose quantifiers are bounded by the limit
consumes the text piece by piece: its alternatives are ordered by the strength of the boundary they end at
(a heading, a blank line, a line end, a sentence end, white space) and the last one takes whole characters up to the limit. Each
piece then repeats the end of the one before, found by looking back ``overlap_chars`` from its start.

Defined results: ``\\r\\n`` is read as ``\\n`` first. A text within its limit, an empty one included, is one piece.
A null text has no piece. A limit of null is ``default_max`` and an overlap of null ``default_overlap``; a limit
under 1 counts as 1, and an overlap over half the limit as that half, so that a piece always has room for new text. The new parts of
the pieces joined in order are the text. The work is linear in a text's length. Repeated rows are split each. Lengths count Unicode characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths summed in one array.
ROW = 256
#: A fenced block (to the closing fence or the end of the text), or a maximal run of non-blank lines outside of fences.
_FENCE = r"[^\S\n]*(?:```|~~~)"
BLOCK = rf"(?mdU)(?:^{_FENCE}[^\n]*+(?:\n(?!{_FENCE})[^\n]*+)*+(?:\n{_FENCE}[^\n]*+)?)|(?:^(?!{_FENCE})(?=[^\S\n]*\S)[^\n]*+(?:\n(?!{_FENCE})(?=[^\S\n]*\S)[^\n]*+)*+)"


def lines_as_lf(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def blocks(text: Column) -> Column:
    """The blocks of a text in order, as ARRAY<STRING>."""
    return F.regexp_extract_all(lines_as_lf(text), F.lit(BLOCK), F.lit(0))


def _pattern(limit: Column) -> Column:
    """Consumes up to ``limit`` characters; a boundary of any strength counts only where the piece is at least a quarter full."""
    n, least = limit.cast("string"), F.greatest(F.lit(1), F.floor(limit / 4)).cast("string")
    some = lambda end: F.concat(F.lit("|.{"), least, F.lit(","), n, F.lit("}(?<=" + end + ")"))
    return F.concat(
        F.lit("(?s).{1,"), n, F.lit("}\\z"),
        F.lit("|.{"), least, F.lit(","), n, F.lit("}(?<=\\n)(?=#{1,6}[ \\t])"),
        some(r"\n[ \t]{0,8}\n"),
        some(r"\n"),
        some(r"[.!?…:;][\"'”’»)\]]{0,2}\s"),
        some(r"\s"),
        F.lit("|.{1,"), n, F.lit("}"),
    )


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def _sums_before(lengths: Column) -> Column:
    """For each length the sum of those before it. In blocks of ROW, since an array that grows one by one is copied each time."""

    def run(a: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("sum"))
        return F.aggregate(a, start, lambda acc, x: F.struct(F.concat(acc["out"], F.array(acc["sum"])).alias("out"), (acc["sum"] + x).alias("sum")), lambda acc: acc["out"])

    block_nos = F.sequence(F.lit(0), F.floor((F.greatest(F.size(lengths), F.lit(1)) - 1) / ROW).cast("int"))
    blocks = F.transform(block_nos, lambda j: F.slice(lengths, j * ROW + 1, F.lit(ROW)))
    sums = lambda bs: F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x))
    return _let(blocks, lambda bs: F.flatten(F.zip_with(bs, run(sums(bs)), lambda b, before: F.transform(run(b), lambda y: y + before))))


def split_text(text: Column, max_chars: Column, overlap_chars: Column) -> Column:
    """ARRAY<STRUCT<text, start, overlap>>: the pieces, the place where the new part starts, and how many characters before it are repeated."""
    t = lines_as_lf(text)
    limit = F.greatest(max_chars, F.lit(1))
    back = F.least(F.greatest(overlap_chars, F.lit(0)), F.floor(limit / 2)).cast("int")

    def piece(p: Column, before: Column) -> Column:
        prev, start = before["prev"], before["start"]
        tail = F.substr(prev, F.greatest(F.length(prev) - back, F.lit(0)) + 1, F.greatest(back, F.lit(1)))
        # look back to the first pause within the overlap; without one the overlap starts at a character
        paused = F.when(F.length(prev) <= back, tail).otherwise(F.regexp_replace(tail, r"^\S+\s+(?=\S)", ""))
        kept = F.when((prev == "") | (back == 0), F.lit("")).otherwise(paused)
        return _let(kept, lambda k: F.struct(F.concat(k, p).alias("text"), start.alias("start"), F.length(k).alias("overlap")))

    def pieces(parts: Column) -> Column:
        prevs = F.concat(F.array(F.lit("")), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
        starts = _let(F.transform(parts, lambda p: F.length(p)), _sums_before)
        return F.zip_with(parts, F.zip_with(prevs, starts, lambda a, b: F.struct(a.alias("prev"), b.alias("start"))), piece)

    return F.when(t.isNotNull(), _let(new_parts(t, limit, back), pieces))


def new_parts(t: Column, limit: Column, back: Column) -> Column:
    """The parts whose sum is the text: one where it is within the limit, else such that with ``back`` characters more none exceeds it."""
    return F.when(F.length(t) <= limit, F.array(t)).otherwise(F.regexp_extract_all(t, _pattern(limit - back), F.lit(0)))


def with_limits(chunks: DataFrame, options: DataFrame, default_max: int = 1600, default_overlap: int = 200) -> DataFrame:
    """Chunks with their project's limits. The options are one row per project; the join leaves their distribution to the optimizer's size check."""
    o = options.groupBy("project").agg(F.max("max_chars").alias("_max"), F.max("overlap_chars").alias("_overlap"))
    return chunks.join(o, "project", "left").withColumns({"_max": F.coalesce("_max", F.lit(default_max)), "_overlap": F.coalesce("_overlap", F.lit(default_overlap))})


def split_oversized(chunks: DataFrame, options: DataFrame) -> DataFrame:
    """(chunk_id, piece_no, heading_path, text, start, overlap): the pieces of every chunk; those within their limit pass as they are."""
    c = with_limits(chunks.select("chunk_id", "project", "heading_path", "text"), options)
    return c.select("chunk_id", "heading_path", F.posexplode(split_text(F.col("text"), F.col("_max"), F.col("_overlap"))).alias("piece_no", "_p")).select(
        "chunk_id", "piece_no", "heading_path", "_p.text", "_p.start", "_p.overlap"
    )


def oversized_blocks(chunks: DataFrame, options: DataFrame) -> DataFrame:
    """(chunk_id, block_no): blocks that the splitter, given them alone, has to cut within.

    Only a text over the limit can hold such a block, so the others are passed over before any expression runs.
    """
    c = with_limits(chunks.select("chunk_id", "project", "text"), options).filter(F.length(lines_as_lf(F.col("text"))) > F.col("_max"))
    cut = F.size(new_parts(F.col("_b"), F.greatest(F.col("_max"), F.lit(1)), F.lit(0))) > 1
    return c.select("chunk_id", "_max", F.posexplode(blocks(F.col("text"))).alias("block_no", "_b")).filter(cut).select("chunk_id", "block_no")

"""Structure of typeset pages from their lines: body size, headings, paragraphs, markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADING_WORDS, HEADING_FACTOR, GAP_FACTOR, TIERS = 15, 1.15, 1.6, 3


def statistics(lines: DataFrame) -> DataFrame:
    """(source_path, body_size, typical_gap, lines, pages): the upper median of sizes (half points) weighted by words, and of line gaps.

    The weighted median is a running sum over the distinct sizes of a file, not over its lines.
    """
    d = lines.withColumn("size", F.round(F.col("font_size") * 2) / 2)
    sizes = d.filter("size IS NOT NULL AND word_count > 0").groupBy("source_path", "size").agg(F.sum("word_count").alias("w"))
    run = Window.partitionBy("source_path").orderBy("size")
    total = Window.partitionBy("source_path")
    body = sizes.withColumns({"_c": F.sum("w").over(run), "_t": F.sum("w").over(total)}).filter(F.col("_c") > F.floor(F.col("_t") / 2)).groupBy("source_path").agg(F.min("size").alias("body_size"))
    page = Window.partitionBy("source_path", "page_no").orderBy("line_no", "line_id")
    gaps = d.withColumn("gap", F.round(F.lag("baseline").over(page) - F.col("baseline"), 1)).filter("gap > 0").groupBy("source_path", "gap").agg(F.count("*").alias("n"))
    run = Window.partitionBy("source_path").orderBy("gap")
    gap = gaps.withColumns({"_c": F.sum("n").over(run), "_t": F.sum("n").over(total)}).filter(F.col("_c") > F.floor(F.col("_t") / 2)).groupBy("source_path").agg(F.min("gap").alias("typical_gap"))
    counts = d.groupBy("source_path").agg(F.count("*").alias("lines"), F.countDistinct("page_no").alias("pages"))
    return counts.join(body, "source_path", "left").join(gap, "source_path", "left").select("source_path", "body_size", "typical_gap", "lines", "pages")


def headings(lines: DataFrame) -> DataFrame:
    """(line_id, source_path, text, level): short lines set larger than the body by HEADING_FACTOR, in tiers by size, then bold lines of body size."""
    d = lines.join(statistics(lines).select("source_path", "body_size"), "source_path").withColumn("size", F.round(F.col("font_size") * 2) / 2)
    large = (F.col("word_count") <= HEADING_WORDS) & (F.col("size") >= F.col("body_size") * HEADING_FACTOR)
    bold = (F.col("word_count") <= HEADING_WORDS) & F.coalesce("bold", F.lit(False)) & (F.col("size") >= F.col("body_size")) & ~F.rtrim("text").endswith(".")
    tiers = d.filter(large).select("source_path", "size").distinct()
    ranked = tiers.withColumn("_r", F.row_number().over(Window.partitionBy("source_path").orderBy(F.desc("size"))))
    count = ranked.groupBy("source_path").agg(F.max("_r").alias("_n"))
    d = d.filter(large | bold).join(ranked, ["source_path", "size"], "left").join(count, "source_path", "left")
    level = F.when(F.col("_r").isNotNull(), F.least(F.col("_r"), F.lit(TIERS))).otherwise(F.least(F.coalesce("_n", F.lit(0)) + 1, F.lit(TIERS + 1)))
    return d.select("line_id", "source_path", "text", level.cast("int").alias("level"))


def markdown(lines: DataFrame) -> DataFrame:
    """(source_path, markdown): headings by tier, other lines as paragraphs that end at a page's end, a heading or a wide gap."""
    h = headings(lines).select("line_id", "level")
    s = statistics(lines).select("source_path", "typical_gap")
    page = Window.partitionBy("source_path", "page_no").orderBy("line_no", "line_id")
    d = lines.join(h, "line_id", "left").join(s, "source_path", "left")
    d = d.withColumns({"_gap": F.lag("baseline").over(page) - F.col("baseline"), "_after": F.lag("level").over(page)})
    wide = F.coalesce(F.col("_gap") > F.col("typical_gap") * GAP_FACTOR, F.lit(False))
    start = F.col("level").isNotNull() | F.col("_after").isNotNull() | wide | (F.row_number().over(page) == 1)
    d = d.withColumn("_block", F.sum(start.cast("int")).over(page))
    blocks = d.groupBy("source_path", "page_no", "_block").agg(F.max("level").alias("level"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line_id", "text"))), lambda x: x["text"]), " ").alias("t"))
    text = F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "t")).otherwise(F.col("t"))
    return blocks.withColumn("t", text).groupBy("source_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "_block", "t"))), lambda x: x["t"]), "\n\n").alias("markdown"))

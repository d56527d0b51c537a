"""Nominating passages of different documents that disagree, suppressing templates, and the pairs' lifecycle.

The batch contract: every chunk is considered, so the result doesn't depend on the order of indexing. Per chunk the
nearest ``k`` chunks of other documents of its project at FLOOR or more are candidates; the first that qualifies is nominated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions import vectors as vx
from quillspark.operators.neighbours import top_neighbours
from quillspark.operators.store import Table

FLOOR, NEIGHBOURS, SUPERSEDED_DAYS, TEMPLATE_DOCS, TEMPLATE_LINES = 0.75, 3, 30, 3, 3
#: The cosine at which the score of two unit vectors is FLOOR.
FLOOR_COSINE = (3 - 1 / FLOOR) / 2
CLOSED = ("dismissed", "resolved")


def qualifies(text_a: Column, at_a: Column, text_b: Column, at_b: Column) -> Column:
    """Both dates known and different, and texts that differ in more than case and white space."""
    return at_a.isNotNull() & at_b.isNotNull() & (at_a != at_b) & (tx.normalize(text_a) != tx.normalize(text_b))


def kind_of(at_a: Column, at_b: Column) -> Column:
    return F.when(tx.days_between(at_a, at_b) >= SUPERSEDED_DAYS, "likely-supersession").otherwise("contradiction")


def templates(chunks: DataFrame, least: int = TEMPLATE_DOCS) -> DataFrame:
    """(project, content_hash) of texts that at least ``least`` documents of a project share."""
    return chunks.groupBy("project", "content_hash").agg(F.countDistinct("source_path").alias("documents")).filter(F.col("documents") >= least)


def template_lines(chunks: DataFrame, least: int = TEMPLATE_DOCS) -> DataFrame:
    d = chunks.select("project", "source_path", F.explode(tx.line_hashes("text")).alias("line_hash"))
    return d.groupBy("project", "line_hash").agg(F.countDistinct("source_path").alias("documents")).filter(F.col("documents") >= least)


def nominate(chunks: DataFrame, closed: DataFrame | None = None, k: int = NEIGHBOURS) -> DataFrame:
    """Pairs in the shape of the stored ones. ``chunks`` has one row per (source_path, ordinal) and a unique chunk_id."""
    c = chunks.withColumn("content_hash", tx.content_hash("text"))
    near = top_neighbours(c, "chunk_id", "content_vector", "project", "source_path", k, FLOOR_COSINE)
    near = near.withColumn("score", vx.score_of_cosine(F.col("cosine"))).filter(F.col("score") >= FLOOR)
    side = lambda p: c.select(F.col("chunk_id").alias(f"{p}_id"), F.col("project").alias(f"{p}_project"), F.col("source_path").alias(f"{p}_path"), F.col("ordinal").alias(f"{p}_ordinal"), F.col("heading_path").alias(f"{p}_heading"), F.col("text").alias(f"{p}_text"), F.col("source_modified_at").alias(f"{p}_at"), F.col("content_hash").alias(f"{p}_hash"))
    d = near.withColumnsRenamed({"id": "m_id", "other_id": "o_id"}).join(side("m"), "m_id").join(side("o"), "o_id")
    d = d.filter(qualifies(F.col("m_text"), F.col("m_at"), F.col("o_text"), F.col("o_at")))
    first = Window.partitionBy("m_id").orderBy(F.desc("score"), "o_id")
    d = d.withColumn("_n", F.row_number().over(first)).filter("_n = 1").withColumnRenamed("m_project", "project")

    t = templates(c).select("project", "content_hash")
    d = d.join(t.withColumnRenamed("content_hash", "m_hash"), ["project", "m_hash"], "left_anti").join(t.withColumnRenamed("content_hash", "o_hash"), ["project", "o_hash"], "left_anti")
    shared = F.array_intersect(tx.line_hashes("m_text"), tx.line_hashes("o_text"))
    d = d.withColumn("_shared", shared)
    lines = template_lines(c).select("project", "line_hash")
    hits = d.select("m_id", "project", F.explode("_shared").alias("line_hash")).join(lines, ["project", "line_hash"]).groupBy("m_id").agg(F.count("*").alias("_templ"))
    d = d.join(hits, "m_id", "left")
    drowned = (F.coalesce("_templ", F.lit(0)) >= TEMPLATE_LINES) & (2 * F.coalesce("_templ", F.lit(0)) >= F.size("_shared"))
    d = d.filter(~drowned)

    newer = F.col("m_at") > F.col("o_at")
    pick = lambda f: (F.when(newer, F.col(f"m_{f}")).otherwise(F.col(f"o_{f}")), F.when(newer, F.col(f"o_{f}")).otherwise(F.col(f"m_{f}")))
    cols = {}
    for f, name in (("path", "path"), ("ordinal", "ordinal"), ("heading", "heading"), ("at", "modified_at"), ("text", "excerpt")):
        a, b = pick(f)
        cols[f"a_{name}"], cols[f"b_{name}"] = (tx.excerpt(a), tx.excerpt(b)) if f == "text" else (a, b)
    d = d.select(tx.pair_id("m_path", "m_ordinal", "o_path", "o_ordinal").alias("pair_id"), "project", F.bround("score", 4).alias("similarity"), kind_of(F.col("m_at"), F.col("o_at")).alias("kind"), F.lit("open").alias("status"), *(v.alias(k2) for k2, v in cols.items()))
    d = d.dropDuplicates(["pair_id"])
    return d if closed is None else d.join(closed.select("pair_id"), "pair_id", "left_anti")


def closed_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.coalesce("status", F.lit("open")).isin(*CLOSED)).select("pair_id").distinct()


def listed(pairs: DataFrame, include_closed: bool = False, project: str | None = None) -> DataFrame:
    """Open pairs (and closed ones on request), newest detection first, then the more similar."""
    p = pairs if project is None else pairs.filter(F.col("project") == project)
    p = p if include_closed else p.filter(~F.coalesce("status", F.lit("open")).isin(*CLOSED))
    return p.orderBy(F.desc("detected_at"), F.desc("similarity"), "pair_id")


def set_status(table: Table, pair_id: str, status: str, note_id: str | None = None) -> int:
    """Dismisses or resolves a pair; an error where the id is unknown."""
    if status not in CLOSED:
        raise ValueError(status)
    return table.update(F.col("pair_id") == pair_id, {"status": F.lit(status), "resolved_note_id": F.lit(note_id), "status_changed_at": F.current_timestamp()})


def remove_for_path(table: Table, path: str, only_open: bool) -> int:
    """Deletes pairs with a side in a document: before it is indexed again the open ones only, with the document all."""
    touches = (F.col("a_path") == path) | (F.col("b_path") == path)
    return table.delete(touches & ~F.coalesce("status", F.lit("open")).isin(*CLOSED) if only_open else touches)

"""Override notes: upsert, removal, search with a floor, merging with hits, and annotation of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import retrieval
from quillspark.operators.store import Table

FLOOR, POOL = 0.45, 5


def with_ids(notes: DataFrame) -> DataFrame:
    """Notes with their deterministic ids; a file target is normalised, a key with a scheme is not."""
    target = tx.normalize_path("target_path")
    return notes.withColumn("target_path", target).withColumn("note_id", tx.note_id("project", F.col("target_path"), "text"))


def add(table: Table, notes: DataFrame) -> int:
    """Upsert by id: the same project, target and text is one note."""
    last = Window.partitionBy("note_id").orderBy(F.desc("created_at"))
    return table.replace(with_ids(notes).withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n"))


def remove(table: Table, note_id: str) -> int:
    return table.delete(F.col("note_id") == note_id)


def listed(notes: DataFrame, project: str | None = None) -> DataFrame:
    n = notes if project is None else notes.filter(F.col("project") == project)
    return n.orderBy(F.desc("created_at"), "note_id")


def search(notes: DataFrame, query: str, vector: list[float] | None = None, k: int = POOL) -> DataFrame:
    """(note_id, score): by vector with a floor where there is one, else by words."""
    if vector is not None:
        return retrieval.knn(notes, "note_id", "content_vector", vector, k).filter(F.col("score") >= FLOOR).withColumnRenamed("id", "note_id")
    return retrieval.top(retrieval.bm25(notes, "note_id", "text", query), k).withColumnRenamed("id", "note_id")


def as_hits(notes: DataFrame, scores: DataFrame) -> DataFrame:
    return notes.join(scores, "note_id").select(
        F.lit("note").alias("origin"), F.concat(F.lit("note://"), "note_id").alias("path"), F.lit("Override note").alias("heading_path"), F.col("text").alias("content"), "project", F.col("created_at").alias("modified_at"), "score"
    )


def merge(doc_hits: DataFrame, note_hits: DataFrame, k: int) -> DataFrame:
    """Notes first, then documents, each by score, cut at k."""
    return doc_hits.unionByName(note_hits).orderBy(F.when(F.col("origin") == "note", 0).otherwise(1), F.desc("score"), "path").limit(k)


def annotate(hits: DataFrame, notes: DataFrame) -> DataFrame:
    """Hits with the notes on their (path, project), newest first, as ``annotations``; hits without one have an empty array."""
    note = F.struct((-F.unix_micros("created_at")).alias("_at"), "note_id", "text", "author", "created_at")
    per_target = notes.filter("target_path IS NOT NULL").groupBy(F.col("target_path").alias("path"), "project").agg(F.array_sort(F.collect_list(note)).alias("_notes"))
    plain = F.transform(F.coalesce("_notes", F.array()), lambda n: F.struct(n["note_id"].alias("id"), n["text"].alias("text"), n["author"].alias("author"), n["created_at"].alias("created_at")))
    joined = hits.join(per_target, ["path", "project"], "left")
    return joined.withColumn("annotations", F.when(F.col("_notes").isNull(), F.array().cast("array<struct<id:string,text:string,author:string,created_at:timestamp>>")).otherwise(plain)).drop("_notes")

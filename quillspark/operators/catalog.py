"""Catalog and observability: roll-ups over the chunk table, document reads, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.session import materialize


def scoped(df: DataFrame, project: str | None) -> DataFrame:
    """Rows of a project; null, blank, ``*`` and ``all`` mean every one."""
    p = (project or "").strip()
    return df if p in ("", "*") or p.lower() == "all" else df.filter(F.col("project") == p)


def latest(chunks: DataFrame) -> DataFrame:
    """The last indexed row of each (source_path, ordinal), of equally late ones that with the larger chunk_id.

    Only keys and ids are grouped; the superseded ids, few as a rule, are then taken out, so that texts and vectors needn't be shuffled.
    Rows with a null key are all kept.
    """
    key = ["source_path", "ordinal"]
    narrow = chunks.select(*key, "chunk_id", "indexed_at")
    many = narrow.groupBy(key).agg(F.max(F.struct("indexed_at", "chunk_id")).alias("_last"), F.count("*").alias("_n")).filter("_n > 1")
    older = narrow.join(many, key).filter(F.col("chunk_id") != F.col("_last.chunk_id")).select("chunk_id")
    return chunks.join(older, "chunk_id", "left_anti").select(*chunks.columns)


def list_sources(chunks: DataFrame, project: str | None = None) -> DataFrame:
    """Documents with their chunk count and the facts of their first chunk, in the order of their paths."""
    first = F.min_by(F.struct("title", "project", "source_modified_at"), F.struct("ordinal", "chunk_id"))
    d = scoped(chunks, project).groupBy("source_path").agg(F.count("*").alias("chunks"), first.alias("_f"))
    return d.select("source_path", "chunks", F.col("_f.title").alias("title"), F.col("_f.project").alias("project"), F.col("_f.source_modified_at").alias("source_modified_at"))


def project_status(chunks: DataFrame, approximate: bool = False) -> DataFrame:
    """Per project: chunks, documents, the span of dates, last indexing, and the share of chunks with a vector."""
    docs = F.approx_count_distinct("source_path") if approximate else F.countDistinct("source_path")
    return (
        chunks.groupBy("project")
        .agg(F.count("*").alias("chunks"), docs.alias("documents"), F.min("source_modified_at").alias("oldest"), F.max("source_modified_at").alias("newest"), F.max("indexed_at").alias("last_indexed"), F.count("content_vector").alias("embedded"))
        .withColumn("vector_coverage", F.when(F.col("chunks") == 0, 0.0).otherwise(F.col("embedded") / F.col("chunks")))
    )


def project_counts(chunks: DataFrame, project: str) -> DataFrame:
    return chunks.filter(F.col("project") == project).agg(F.count("*").alias("chunks"), F.countDistinct("source_path").alias("documents"))


def source_kinds(chunks: DataFrame) -> DataFrame:
    """Documents and chunks per kind of source, in two levels so that a document counts once."""
    per_doc = chunks.groupBy("source_path").agg(F.count("*").alias("n"))
    return per_doc.groupBy(tx.kind("source_path").alias("kind")).agg(F.count("*").alias("documents"), F.sum("n").alias("chunks"))


def stale(chunks: DataFrame, now: Column, days: int) -> DataFrame:
    """Documents last modified over ``days`` ago with their age in whole days."""
    d = chunks.groupBy("source_path").agg(F.max("source_modified_at").alias("modified_at"))
    age = F.floor((F.unix_micros(now) - F.unix_micros("modified_at")) / 86_400_000_000)
    return d.filter(F.col("modified_at") < now - F.make_dt_interval(F.lit(days))).select("source_path", "modified_at", age.cast("long").alias("age_days"))


def top_documents(chunks: DataFrame, k: int = 20) -> DataFrame:
    return chunks.groupBy("source_path").agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), "source_path").limit(k)


def remaining_documents(chunks: DataFrame, k: int = 20) -> DataFrame:
    """(documents, more): how many there are, and how many are beyond the first ``k``."""
    return chunks.agg(F.countDistinct("source_path").alias("documents")).select("documents", F.greatest(F.col("documents") - k, F.lit(0)).cast("long").alias("more"))


def known_projects(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Projects that are indexed or have a manifest, in order."""
    return chunks.select("project").union(manifest.select("project")).filter("project IS NOT NULL").distinct().orderBy("project")


def find_document(chunks: DataFrame, path: str, strict: bool = False) -> DataFrame:
    """Chunks of one document: by its path, else by a file name its path ends with (``strict``: after a slash).

    Of several that match by name, the first path in order is taken.
    """
    p = path.strip().replace("\\", "/")
    p = p if "://" in p else p.lower()
    name = p.rsplit("/", 1)[-1]
    suffix = F.col("source_path").endswith(("/" if strict else "") + name)
    chosen = chunks.filter((F.col("source_path") == p) | suffix).agg(F.coalesce(F.max(F.when(F.col("source_path") == p, F.col("source_path"))), F.min("source_path")).alias("source_path"))
    return chunks.join(F.broadcast(chosen), "source_path", "left_semi")  # one row


def document_window(doc: DataFrame, around: int, radius: int = 2) -> DataFrame:
    """Chunks from ``radius`` before to ``radius`` after one; the radius is at least 0 and at most 10."""
    r = min(10, max(0, radius))
    return doc.filter(F.col("ordinal").between(max(0, around - r), around + r))


def summary(pairs: DataFrame) -> DataFrame:
    """Pair counts per project by status, and of the open ones by kind; a missing status is open, a missing kind contradiction."""
    s, k = F.lower(F.coalesce("status", F.lit("open"))), F.lower(F.coalesce("kind", F.lit("contradiction")))
    closed = s.isin("dismissed", "resolved")
    n = lambda c: F.count_if(c)
    return pairs.groupBy("project").agg(
        n(~closed).alias("open"), n(~closed & (k == "likely-supersession")).alias("open_supersessions"), n(~closed & (k != "likely-supersession")).alias("open_contradictions"),
        n(s == "dismissed").alias("dismissed"), n(s == "resolved").alias("resolved"), F.count("*").alias("total"),
    )


def shortest_labels(paths: DataFrame) -> DataFrame:
    """(path, label): of each path the fewest last segments that no other path shares; keys with a scheme stay whole.

    Each round lengthens the labels that still collide by one segment, until none does.
    """
    segments = F.split("path", "/")
    d = paths.select("path").distinct().withColumn("depth", F.when(F.col("path").contains("://"), F.lit(1000)).otherwise(1))
    while True:
        label = F.when(F.col("depth") >= F.size(segments), F.col("path")).otherwise(F.array_join(F.slice(segments, F.size(segments) - F.col("depth") + 1, F.col("depth")), "/"))
        d = d.withColumn("label", label)
        shared = d.groupBy(F.lower("label").alias("_l")).agg(F.count("*").alias("_n")).filter("_n > 1")
        marked = d.join(shared, F.lower("label") == F.col("_l"), "left")
        more = F.col("_n").isNotNull() & (F.col("depth") < F.size(segments))
        d = marked.select("path", "label", F.when(more, F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"), more.alias("_more"))
        d = materialize(d, "labels")
        if d.filter("_more").isEmpty():
            return d.select("path", "label")
        d = d.select("path", "depth")

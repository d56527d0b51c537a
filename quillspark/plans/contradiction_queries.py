"""Nominations, templates, lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import catalog, contradictions
from quillspark.operators.neighbours import top_neighbours
from quillspark.plans.catalogue import query
from quillspark.plans.retrieval_queries import OK_VECTOR, cosine_sql
from quillspark.plans.text_queries import NORM
from quillspark.tables import table


def _newest(spark, d):
    """The stored pairs, one row each: the latest detection."""
    p = table(spark, d, "contradiction_pairs")
    return p.groupBy("pair_id").agg(F.max_by(F.struct("project", "similarity", "detected_at", "kind", "status"), F.struct("detected_at", F.coalesce("status", F.lit("")))).alias("r")).select("pair_id", "r.*")


NEWEST_SQL = "(SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY detected_at DESC, coalesce(status,'') DESC) AS n FROM contradiction_pairs) WHERE n=1)"


LATEST_SQL = "(SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY source_path, ordinal ORDER BY indexed_at DESC, chunk_id DESC) AS n FROM chunks) WHERE n=1)"


@query("nominate_candidates", f"""WITH c AS (SELECT * FROM {LATEST_SQL} WHERE {OK_VECTOR('content_vector')}), p AS (SELECT a.chunk_id AS id, b.chunk_id AS other_id, round({cosine_sql('a.content_vector', 'b.content_vector')},12) AS cosine FROM c a JOIN c b ON a.project=b.project AND a.source_path<>b.source_path AND len(a.content_vector)=len(b.content_vector)),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other_id) AS n FROM p WHERE cosine>={contradictions.FLOOR_COSINE}) SELECT id, other_id, round(cosine,6) AS cosine FROM r WHERE n<={contradictions.NEIGHBOURS}""")
def nominate_candidates(spark, d):
    c = catalog.latest(table(spark, d, "chunks"))
    near = top_neighbours(c, "chunk_id", "content_vector", "project", "source_path", contradictions.NEIGHBOURS, contradictions.FLOOR_COSINE)
    return near.select("id", "other_id", F.round("cosine", 6).alias("cosine"))


@query("nominate_pairs")
def nominate_pairs(spark, d):
    c = catalog.latest(table(spark, d, "chunks"))
    return contradictions.nominate(c, contradictions.closed_pairs(table(spark, d, "contradiction_pairs")))


@query("list_open_pairs", f"SELECT pair_id, project, round(similarity,4) AS similarity, epoch_us(detected_at) AS detected_us FROM {NEWEST_SQL} WHERE coalesce(status,'open') NOT IN ('dismissed','resolved')")
def list_open_pairs(spark, d):
    return contradictions.listed(_newest(spark, d)).select("pair_id", "project", F.round("similarity", 4).alias("similarity"), F.unix_micros("detected_at").alias("detected_us"))


@query("closed_suppression", "SELECT pair_id, count(*) AS detections FROM contradiction_pairs WHERE pair_id NOT IN (SELECT pair_id FROM contradiction_pairs WHERE status IN ('dismissed','resolved')) GROUP BY pair_id")
def closed_suppression(spark, d):
    p = table(spark, d, "contradiction_pairs")
    return p.join(contradictions.closed_pairs(p), "pair_id", "left_anti").groupBy("pair_id").agg(F.count("*").alias("detections"))


SIDES_SQL = """(SELECT a.pair_id, a.x AS a_at, b.x AS b_at, a.t AS a_text, b.t AS b_text FROM (SELECT pair_id, arg_min(modified_at, side_id) AS x, arg_min(excerpt, side_id) AS t FROM contradiction_sides WHERE side='a' GROUP BY pair_id) a
 JOIN (SELECT pair_id, arg_min(modified_at, side_id) AS x, arg_min(excerpt, side_id) AS t FROM contradiction_sides WHERE side='b' GROUP BY pair_id) b USING (pair_id))"""


def _sides(spark, d):
    s = table(spark, d, "contradiction_sides")
    end = lambda x: s.filter(F.col("side") == x).groupBy("pair_id").agg(F.min_by("modified_at", "side_id").alias(f"{x}_at"), F.min_by("excerpt", "side_id").alias(f"{x}_text"))
    return end("a").join(end("b"), "pair_id")


@query("supersession_kinds", f"SELECT pair_id, CASE WHEN abs(epoch_us(a_at)-epoch_us(b_at))/86400000000.0>=30 THEN 'likely-supersession' ELSE 'contradiction' END AS kind FROM {SIDES_SQL}")
def supersession_kinds(spark, d):
    return _sides(spark, d).select("pair_id", contradictions.kind_of(F.col("a_at"), F.col("b_at")).alias("kind"))


@query("nomination_predicate", f"SELECT pair_id, a_at IS NOT NULL AND b_at IS NOT NULL AND a_at<>b_at AND {NORM('a_text')}<>{NORM('b_text')} AS qualifies FROM {SIDES_SQL}")
def nomination_predicate(spark, d):
    return _sides(spark, d).select("pair_id", contradictions.qualifies(F.col("a_text"), F.col("a_at"), F.col("b_text"), F.col("b_at")).alias("qualifies"))


@query("template_suppression", f"""WITH h AS (SELECT chunk_id, project, source_path, substr(sha256({NORM('text')}),1,16) AS hash FROM chunks), t AS (SELECT project, hash FROM h GROUP BY ALL HAVING count(DISTINCT source_path)>=3)
 SELECT h.project, count(*) AS chunks, count(t.hash) AS template_chunks FROM h LEFT JOIN t ON t.project=h.project AND t.hash IS NOT DISTINCT FROM h.hash GROUP BY h.project""")
def template_suppression(spark, d):
    c = table(spark, d, "chunks").withColumn("content_hash", tx.content_hash("text"))
    t = contradictions.templates(c).withColumn("t", F.lit(1)).withColumnsRenamed({"project": "p", "content_hash": "h"})
    j = c.join(t, (F.col("project") == F.col("p")) & F.col("content_hash").eqNullSafe(F.col("h")), "left")
    return j.groupBy("project").agg(F.count("*").alias("chunks"), F.count("t").alias("template_chunks"))


@query("pairs_of_document", f"SELECT pair_id, count(*) AS sides FROM contradiction_sides WHERE source_path=(SELECT source_path FROM contradiction_sides GROUP BY source_path ORDER BY count(*) DESC, source_path LIMIT 1) GROUP BY pair_id")
def pairs_of_document(spark, d):
    s = table(spark, d, "contradiction_sides")
    most = s.groupBy("source_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_path").limit(1)
    return s.join(F.broadcast(most.select("source_path")), "source_path", "left_semi").groupBy("pair_id").agg(F.count("*").alias("sides"))

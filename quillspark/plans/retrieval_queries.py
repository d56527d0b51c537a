"""Searches: lexical, by vector, fused, reranked, with notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions import vectors as vx
from quillspark.functions.analyzer import query_terms
from quillspark.operators import notes as nt
from quillspark.operators import retrieval as rt
from quillspark.plans.catalogue import query
from quillspark.plans.text_queries import PART, TOKENS
from quillspark.tables import table

QUERY = "retention policy for the audit trail"
TERMS = "[" + ",".join(f"'{t}'" for t in query_terms(QUERY)) + "]"


def content(df):
    return df.withColumn("content", tx.with_breadcrumb("heading_path", "text"))


CONTENT_SQL = "CASE WHEN coalesce(text,'')='' THEN coalesce(heading_path,'') WHEN coalesce(heading_path,'')='' THEN text ELSE heading_path||chr(10)||chr(10)||text END"


def bm25_sql(source: str, key: str, col: str) -> str:
    """SQL for (id, score), the engine's contract of BM25 over one field."""
    return f"""(WITH tk AS (SELECT {key} AS id, flatten(list_transform({TOKENS(col)}, lambda w: list_distinct(list_transform(list_concat([w],regexp_extract_all(w,'{PART}')), lambda x: lower(replace(x,'İ','i'||chr(775))))))) AS t FROM {source}),
 n AS (SELECT id, t, len(t) AS dl FROM tk WHERE len(t)>0), s AS (SELECT count(*) AS docs, avg(dl) AS avgdl FROM n),
 tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, dl, unnest(t) AS term FROM n) WHERE list_contains({TERMS}, term) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
 SELECT id, sum(ln(1+(docs-df+0.5)/(df+0.5))*tf*2.2/(tf+1.2*(0.25+0.75*dl/avgdl))) AS score FROM tf JOIN df USING (term) CROSS JOIN s GROUP BY id)"""


CHUNK_SRC = f"(SELECT chunk_id, title, heading_path, {CONTENT_SQL} AS content FROM chunks)"
LEXICAL_SQL = f"(SELECT id, max(score) AS score FROM (SELECT * FROM {bm25_sql(CHUNK_SRC, 'chunk_id', 'content')} UNION ALL SELECT id, 2*score FROM {bm25_sql(CHUNK_SRC, 'chunk_id', 'heading_path')} UNION ALL SELECT id, 2*score FROM {bm25_sql(CHUNK_SRC, 'chunk_id', 'title')}) GROUP BY id)"
DV = lambda c: f"CAST({c} AS DOUBLE[])"
OK_VECTOR = lambda c: f"{c} IS NOT NULL AND len({c})>0 AND list_dot_product({DV(c)},{DV(c)})>0 AND isfinite(list_dot_product({DV(c)},{DV(c)}))"
EXAMPLE_SQL = f"(SELECT content_vector FROM chunks WHERE {OK_VECTOR('content_vector')} ORDER BY chunk_id LIMIT 1)"


def cosine_sql(a: str, b: str) -> str:
    return f"list_dot_product({DV(a)},{DV(b)})/sqrt(list_dot_product({DV(a)},{DV(a)}))/sqrt(list_dot_product({DV(b)},{DV(b)}))"


KNN_SQL = lambda k: f"(SELECT chunk_id AS id, 1/(3-2*{cosine_sql('content_vector', EXAMPLE_SQL)}) AS score FROM chunks WHERE {OK_VECTOR('content_vector')} ORDER BY score DESC, id LIMIT {k})"
FUSED_SQL = f"""(WITH l AS (SELECT * FROM {LEXICAL_SQL} ORDER BY score DESC, id LIMIT 100), s AS (SELECT * FROM {KNN_SQL(100)}),
 ln AS (SELECT id, CASE WHEN max(score) OVER ()=min(score) OVER () THEN 1.0 ELSE (score-min(score) OVER ())/(max(score) OVER ()-min(score) OVER ()) END AS x FROM l),
 sn AS (SELECT id, CASE WHEN max(score) OVER ()=min(score) OVER () THEN 1.0 ELSE (score-min(score) OVER ())/(max(score) OVER ()-min(score) OVER ()) END AS y FROM s)
 SELECT id, 0.5*coalesce(x,0)+0.5*coalesce(y,0) AS score FROM ln FULL JOIN sn USING (id))"""


def example_vector(chunks) -> list[float] | None:
    """The vector of the first chunk that has a usable one: the query by example."""
    r = chunks.filter(vx.usable(F.col("content_vector"))).orderBy("chunk_id").select("content_vector").limit(1).collect()
    return list(r[0][0]) if r else None


@query("bm25_topk", f"SELECT id AS doc_id, round(score,4) AS score FROM {bm25_sql('documents', 'doc_id', 'text')} ORDER BY round(score,9) DESC, id LIMIT 50")
def bm25_topk(spark, d):
    s = rt.bm25(table(spark, d, "documents"), "doc_id", "text", QUERY).withColumn("r", F.round("score", 9))
    return rt.top(s, 50, score="r").select(F.col("id").alias("doc_id"), F.round("score", 4).alias("score"))


@query("bm25_multifield", f"SELECT id AS chunk_id, round(score,4) AS score FROM {LEXICAL_SQL} ORDER BY round(score,9) DESC, id LIMIT 50")
def bm25_multifield(spark, d):
    s = rt.lexical(content(table(spark, d, "chunks")), "chunk_id", QUERY).withColumn("r", F.round("score", 9))
    return rt.top(s, 50, score="r").select(F.col("id").alias("chunk_id"), F.round("score", 4).alias("score"))


@query("knn_topk", f"SELECT query_id, id, round(score,6) AS score, rank FROM (SELECT q.vec_id AS query_id, b.vec_id AS id, 1/(3-2*{cosine_sql('q.embedding', 'b.embedding')}) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY 1/(3-2*{cosine_sql('q.embedding', 'b.embedding')}) DESC, b.vec_id) AS rank FROM embeddings q JOIN embeddings b ON q.vec_id<>b.vec_id WHERE q.vec_id%50=0) WHERE rank<=10")
def knn_topk(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    n = rt.nearest_blocks(e, e.filter("id % 50 = 0"), 10)
    return n.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("knn_by_project", f"SELECT chunk_id, round(1/(3-2*{cosine_sql('content_vector', EXAMPLE_SQL)}),6) AS score FROM chunks WHERE project='kopajen' AND {OK_VECTOR('content_vector')} ORDER BY 1/(3-2*{cosine_sql('content_vector', EXAMPLE_SQL)}) DESC, chunk_id LIMIT 25")
def knn_by_project(spark, d):
    c = table(spark, d, "chunks")
    return rt.knn(c.filter("project = 'kopajen'"), "chunk_id", "content_vector", example_vector(c) or [1.0], 25).select(F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"))


@query("vector_norms", f"SELECT vec_id, round(sqrt(list_dot_product({DV('embedding')},{DV('embedding')})),6) AS norm FROM embeddings")
def vector_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(vx.norm(F.col("embedding")), 6).alias("norm"))


@query("label_centroids", """WITH p AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1,65) r(i) GROUP BY ALL), n AS (SELECT label, sqrt(sum(m*m)) AS n FROM p GROUP BY label)
 SELECT label, CAST(i-1 AS INTEGER) AS dim, round(m/n,5) AS value FROM p JOIN n USING (label)""")
def label_centroids(spark, d):
    c = rt.centroids(table(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("dim", "v")).select("label", "dim", F.round("v", 5).alias("value"))


SIMILAR_PATH = f"(SELECT source_path FROM chunks WHERE {OK_VECTOR('content_vector')} ORDER BY chunk_id LIMIT 1)"


@query("find_similar", f"""WITH p AS (SELECT i, avg(CAST(content_vector[i] AS DOUBLE)) AS m FROM chunks, range(1,65) r(i) WHERE source_path={SIMILAR_PATH} AND {OK_VECTOR('content_vector')} GROUP BY i), c AS (SELECT list(m ORDER BY i) AS v FROM p),
 s AS (SELECT source_path, chunk_id, 1/(3-2*{cosine_sql('content_vector', 'c.v')}) AS score FROM chunks, c WHERE source_path<>{SIMILAR_PATH} AND {OK_VECTOR('content_vector')} ORDER BY score DESC, chunk_id LIMIT 50),
 b AS (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY score DESC, chunk_id) AS n FROM s) SELECT source_path, chunk_id, round(score,6) AS score FROM b WHERE n=1 ORDER BY b.score DESC, source_path LIMIT 10""")
def find_similar(spark, d):
    c = table(spark, d, "chunks")
    r = c.filter(vx.usable(F.col("content_vector"))).orderBy("chunk_id").select("source_path").limit(1).collect()
    return rt.find_similar(c, r[0][0] if r else "", 10).withColumn("score", F.round("score", 6))


@query("minmax_fusion", f"SELECT id AS chunk_id, round(score,4) AS score FROM {FUSED_SQL} WHERE score>0")
def minmax_fusion(spark, d):
    c = content(table(spark, d, "chunks"))
    lex = rt.top(rt.lexical(c, "chunk_id", QUERY), 100)
    sem = rt.knn(c, "chunk_id", "content_vector", example_vector(c) or [1.0], 100)
    return rt.fuse(lex, sem).filter("score > 0").select(F.col("id").alias("chunk_id"), F.round("score", 4).alias("score"))


@query("hybrid_search", f"SELECT f.id AS chunk_id, c.source_path, coalesce(c.heading_path,'') AS heading_path, round(f.score,4) AS score FROM (SELECT * FROM {FUSED_SQL} ORDER BY round(score,9) DESC, id LIMIT 20) f JOIN chunks c ON c.chunk_id=f.id")
def hybrid_search(spark, d):
    c = content(table(spark, d, "chunks"))
    lex = rt.top(rt.lexical(c, "chunk_id", QUERY), rt.knn_size(20))
    sem = rt.knn(c, "chunk_id", "content_vector", example_vector(c) or [1.0], rt.knn_size(20))
    hits = rt.top(rt.fuse(lex, sem).withColumn("r", F.round("score", 9)), 20, score="r")
    return hits.join(c.select(F.col("chunk_id").alias("id"), "source_path", "heading_path"), "id").select(F.col("id").alias("chunk_id"), "source_path", F.coalesce("heading_path", F.lit("")).alias("heading_path"), F.round("score", 4).alias("score"))


BODY_SQL = "CASE WHEN content=coalesce(heading_path,'') THEN '' WHEN starts_with(content,coalesce(heading_path,'')||chr(10)||chr(10)) THEN substr(content,length(coalesce(heading_path,''))+3) ELSE content END"
WINDOWS_SQL = f"""(WITH c AS (SELECT chunk_id AS id, coalesce(heading_path,'') AS h, content, {BODY_SQL} AS body FROM {CHUNK_SRC})
 SELECT id, 0 AS window_no, content AS passage FROM c WHERE length(content)<=1000 UNION ALL
 SELECT id, CAST(i AS INTEGER), h||chr(10)||chr(10)||substr(body,i*800+1,1000) FROM c, LATERAL (SELECT unnest(range(CAST(greatest(0,ceil((length(body)-1000)/800.0)) AS BIGINT)+1)) AS i) WHERE length(content)>1000)"""


@query("rerank_windows", f"SELECT id, CAST(window_no AS INTEGER) AS window_no, length(passage) AS chars, substr(sha256(passage),1,16) AS hash FROM {WINDOWS_SQL}")
def rerank_windows(spark, d):
    c = content(table(spark, d, "chunks")).select(F.col("chunk_id").alias("id"), "heading_path", "content")
    return rt.rerank_windows(c).select("id", "window_no", F.length("passage").cast("long").alias("chars"), tx.short_hash("passage").alias("hash"))


LOGIT_SQL = lambda p: f"""len(list_intersect({TERMS}, flatten(list_transform({TOKENS(p)}, lambda w: list_transform(list_concat([w],regexp_extract_all(w,'{PART}')), lambda x: lower(x))))))*8.0/len({TERMS})-4.0"""


@query("best_windows", f"SELECT id, round(max({LOGIT_SQL('passage')}),6) AS logit FROM {WINDOWS_SQL} GROUP BY id")
def best_windows(spark, d):
    c = content(table(spark, d, "chunks")).select(F.col("chunk_id").alias("id"), "heading_path", "content")
    score = rt.overlap_logit(QUERY)
    return rt.rerank_windows(c).groupBy("id").agg(F.round(F.max(score(F.col("passage"))), 6).alias("logit"))


@query("reranked_search", f"""WITH h AS (SELECT id, row_number() OVER (ORDER BY round(score,9) DESC, id) AS position FROM {FUSED_SQL} ORDER BY position LIMIT 20), b AS (SELECT w.id, max({LOGIT_SQL('passage')}) AS logit FROM {WINDOWS_SQL} w WHERE w.id IN (SELECT id FROM h) GROUP BY w.id)
 SELECT id AS chunk_id, round_even(1/(1+exp(-logit)),4) AS score FROM h JOIN b USING (id) ORDER BY score DESC, position LIMIT 10""")
def reranked_search(spark, d):
    from pyspark.sql import Window

    c = content(table(spark, d, "chunks"))
    lex = rt.top(rt.lexical(c, "chunk_id", QUERY), rt.knn_size(20))
    fused = rt.fuse(lex, rt.knn(c, "chunk_id", "content_vector", example_vector(c) or [1.0], rt.knn_size(20)))
    hits = rt.top(fused.withColumn("r", F.round("score", 9)), 20, score="r").withColumn("position", F.row_number().over(Window.orderBy(F.desc("r"), "id")))  # 20 rows
    hits = hits.join(c.select(F.col("chunk_id").alias("id"), "heading_path", "content"), "id")
    return rt.rerank(hits, rt.overlap_logit(QUERY), 10).select(F.col("id").alias("chunk_id"), "score")


#: Notes for the queries: the excerpts of resolved pairs' newer sides, on the older sides' documents.
def _notes(spark, d):
    p = table(spark, d, "contradiction_pairs").filter("status = 'resolved'").groupBy("pair_id").agg(F.min("project").alias("project"), F.max("detected_at").alias("created_at"))
    s = table(spark, d, "contradiction_sides")
    a = s.filter("side = 'a'").groupBy("pair_id").agg(F.min_by("excerpt", "side_id").alias("text"))
    b = s.filter("side = 'b'").groupBy("pair_id").agg(F.min_by("source_path", "side_id").alias("target_path"))
    n = p.join(a, "pair_id").join(b, "pair_id").withColumn("author", F.lit("reviewer"))
    return nt.with_ids(n).drop("pair_id").dropDuplicates(["note_id"])


NOTES_SQL = """(WITH p AS (SELECT pair_id, min(project) AS project, max(detected_at) AS created_at FROM contradiction_pairs WHERE status='resolved' GROUP BY pair_id),
 a AS (SELECT pair_id, arg_min(excerpt, side_id) AS text FROM contradiction_sides WHERE side='a' GROUP BY pair_id), b AS (SELECT pair_id, arg_min(source_path, side_id) AS target_path FROM contradiction_sides WHERE side='b' GROUP BY pair_id),
 n AS (SELECT project, text, CASE WHEN contains(target_path,'://') THEN target_path ELSE lower(target_path) END AS target_path, created_at FROM p JOIN a USING (pair_id) JOIN b USING (pair_id))
 SELECT DISTINCT substr(sha256(project||'|'||target_path||'|'||text),1,16) AS note_id, project, text, target_path FROM n)"""


@query("notes", f"SELECT note_id, project, target_path, length(text) AS chars FROM {NOTES_SQL}")
def notes(spark, d):
    return _notes(spark, d).select("note_id", "project", "target_path", F.length("text").cast("long").alias("chars"))


@query("note_search", f"SELECT id AS note_id, round(score,4) AS score FROM {bm25_sql(NOTES_SQL, 'note_id', 'text')} ORDER BY round(score,9) DESC, id LIMIT 5")
def note_search(spark, d):
    s = rt.bm25(_notes(spark, d), "note_id", "text", QUERY).withColumn("r", F.round("score", 9))
    return rt.top(s, 5, score="r").select(F.col("id").alias("note_id"), F.round("score", 4).alias("score"))


@query("note_merge", f"""WITH n AS (SELECT 'note' AS origin, 'note://'||id AS path, round(score,9) AS r, score FROM {bm25_sql(NOTES_SQL, 'note_id', 'text')} ORDER BY r DESC, id LIMIT 5),
 d AS (SELECT 'document' AS origin, c.source_path||'#'||c.ordinal||'#'||c.chunk_id AS path, round(l.score,9) AS r, l.score FROM (SELECT * FROM {LEXICAL_SQL} ORDER BY round(score,9) DESC, id LIMIT 20) l JOIN chunks c ON c.chunk_id=l.id)
 SELECT origin, path, round(score,4) AS score FROM (SELECT * FROM n UNION ALL SELECT * FROM d) ORDER BY CASE WHEN origin='note' THEN 0 ELSE 1 END, r DESC, path LIMIT 10""")
def note_merge(spark, d):
    n = _notes(spark, d)
    ns = rt.top(rt.bm25(n, "note_id", "text", QUERY).withColumn("r", F.round("score", 9)), 5, score="r").select(F.lit("note").alias("origin"), F.concat(F.lit("note://"), "id").alias("path"), F.col("score").alias("raw"), F.col("r").alias("score"))
    c = content(table(spark, d, "chunks"))
    top = rt.top(rt.lexical(c, "chunk_id", QUERY).withColumn("r", F.round("score", 9)), 20, score="r")
    ds = top.join(c.select(F.col("chunk_id").alias("id"), "source_path", "ordinal"), "id").select(F.lit("document").alias("origin"), F.concat_ws("#", "source_path", "ordinal", "id").alias("path"), F.col("score").alias("raw"), F.col("r").alias("score"))
    return nt.merge(ds, ns, 10).select("origin", "path", F.round("raw", 4).alias("score"))


@query("annotated_chunks", f"SELECT chunk_id, count(note_id) AS notes, coalesce(string_agg(note_id, ',' ORDER BY note_id),'') AS ids FROM chunks c LEFT JOIN {NOTES_SQL} n ON n.target_path=c.source_path AND n.project=c.project GROUP BY chunk_id")
def annotated_chunks(spark, d):
    hits = table(spark, d, "chunks").select("chunk_id", F.col("source_path").alias("path"), "project")
    a = nt.annotate(hits, _notes(spark, d))
    return a.select("chunk_id", F.size("annotations").cast("long").alias("notes"), F.array_join(F.array_sort(F.transform("annotations", lambda x: x["id"])), ",").alias("ids"))


@query("embedded_notes")
def embedded_notes(spark, d):
    return rt.embed(_notes(spark, d), "text").select("note_id", F.round(vx.norm(F.col("content_vector")), 4).alias("norm"))

"""Catalog and observability over the chunk table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import catalog, chunking, layout
from quillspark.plans.catalogue import query
from quillspark.tables import table

#: "Now" of the freshness queries, fixed so that they give the same on every run.
NOW = "2026-06-30 00:00:00"
KIND_SQL = "CASE WHEN starts_with(source_path,'jira://') THEN 'jira' WHEN starts_with(source_path,'confluence://') THEN 'confluence' WHEN regexp_extract(lower(source_path),'\\.([^./]+)$',1)<>'' THEN regexp_extract(lower(source_path),'\\.([^./]+)$',1) ELSE '(no extension)' END"


@query("list_sources", """SELECT source_path, count(*) AS chunks, arg_min(coalesce(title,'-'), ordinal*1000000000000+chunk_id) AS title, arg_min(project, ordinal*1000000000000+chunk_id) AS project,
 arg_min(coalesce(epoch_us(source_modified_at),-1), ordinal*1000000000000+chunk_id) AS modified_us FROM chunks GROUP BY source_path""")
def list_sources(spark, d):
    s = catalog.list_sources(table(spark, d, "chunks"))
    return s.select("source_path", "chunks", F.coalesce("title", F.lit("-")).alias("title"), "project", F.coalesce(F.unix_micros("source_modified_at"), F.lit(-1)).alias("modified_us"))


@query("project_status", """SELECT project, count(*) AS chunks, count(DISTINCT source_path) AS documents, epoch_us(min(source_modified_at)) AS oldest_us, epoch_us(max(source_modified_at)) AS newest_us,
 epoch_us(max(indexed_at)) AS last_indexed_us, count(content_vector) AS embedded, round(count(content_vector)*1.0/count(*),6) AS vector_coverage FROM chunks GROUP BY project""")
def project_status(spark, d):
    s = catalog.project_status(table(spark, d, "chunks"))
    us = lambda c: F.unix_micros(c).alias(f"{c}_us")
    return s.select("project", "chunks", "documents", us("oldest"), us("newest"), us("last_indexed"), "embedded", F.round("vector_coverage", 6).alias("vector_coverage"))


@query("purge_count", "SELECT count(*) AS chunks, count(DISTINCT source_path) AS documents FROM chunks WHERE project='kopajen'")
def purge_count(spark, d):
    return catalog.project_counts(table(spark, d, "chunks"), "kopajen")


@query("kind_rollup", f"SELECT kind, count(*) AS documents, CAST(sum(n) AS BIGINT) AS chunks FROM (SELECT source_path, {KIND_SQL} AS kind, count(*) AS n FROM chunks GROUP BY ALL) GROUP BY kind")
def kind_rollup(spark, d):
    return catalog.source_kinds(table(spark, d, "chunks"))


@query("project_kind_rollup", f"SELECT coalesce(project,'(all)') AS project, coalesce(kind,'(all)') AS kind, count(*) AS documents FROM (SELECT DISTINCT project, source_path, {KIND_SQL} AS kind FROM chunks) GROUP BY ROLLUP(project, kind)")
def project_kind_rollup(spark, d):
    docs = table(spark, d, "chunks").select("project", "source_path").distinct().withColumn("kind", tx.kind("source_path"))
    return docs.rollup("project", "kind").agg(F.count("*").alias("documents")).fillna("(all)", ["project", "kind"])


@query("stale_documents", f"""SELECT source_path, epoch_us(m) AS modified_us, CAST(floor((epoch_us(TIMESTAMPTZ '{NOW}+00')-epoch_us(m))/86400000000) AS BIGINT) AS age_days FROM
 (SELECT source_path, max(source_modified_at) AS m FROM chunks GROUP BY source_path) WHERE m < TIMESTAMPTZ '{NOW}+00' - INTERVAL 365 DAY""")
def stale_documents(spark, d):
    s = catalog.stale(table(spark, d, "chunks"), F.to_timestamp(F.lit(NOW)), 365)
    return s.select("source_path", F.unix_micros("modified_at").alias("modified_us"), "age_days")


@query("top_documents", "SELECT source_path, count(*) AS chunks FROM chunks GROUP BY source_path ORDER BY chunks DESC, source_path LIMIT 20")
def top_documents(spark, d):
    return catalog.top_documents(table(spark, d, "chunks"), 20)


@query("document_window", """SELECT source_path, ordinal, chunk_id, coalesce(length(text),0) AS chars FROM chunks WHERE source_path=(SELECT source_path FROM chunks GROUP BY source_path ORDER BY count(*) DESC, source_path LIMIT 1)
 AND ordinal BETWEEN 1 AND 5""")
def document_window(spark, d):
    c = table(spark, d, "chunks")
    longest = catalog.top_documents(c, 1).first()
    doc = catalog.find_document(c, longest.source_path if longest else "")
    return catalog.document_window(doc, around=3, radius=2).select("source_path", "ordinal", "chunk_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))


@query("path_suffix_lookup", "SELECT chunk_id, source_path FROM chunks WHERE source_path=(SELECT min(source_path) FROM chunks WHERE ends_with(source_path,'-1.docx'))")
def path_suffix_lookup(spark, d):
    return catalog.find_document(table(spark, d, "chunks"), "elsewhere\\-1.docx").select("chunk_id", "source_path")


@query("latest_chunks", "SELECT source_path, ordinal, max_by(chunk_id, epoch_us(indexed_at)::DECIMAL(38,0)*1000000000000+chunk_id) AS chunk_id FROM chunks GROUP BY source_path, ordinal")
def latest_chunks(spark, d):
    return catalog.latest(table(spark, d, "chunks")).select("source_path", "ordinal", "chunk_id")


@query("reassemble_documents", r"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY source_path, ordinal ORDER BY indexed_at DESC, chunk_id DESC) AS n FROM chunks),
 p AS (SELECT source_path, ordinal, coalesce(heading_path,'') AS h, coalesce(text,'') AS t, first_value(title) OVER (PARTITION BY source_path ORDER BY ordinal) AS title FROM c WHERE n=1),
 l AS (SELECT *, lag(CASE WHEN h<>'' THEN h END IGNORE NULLS) OVER (PARTITION BY source_path ORDER BY ordinal) AS last FROM p),
 m AS (SELECT source_path, any_value(title) AS title, count(*) AS chunks, string_agg(CASE WHEN h<>'' AND h IS DISTINCT FROM last AND h IS DISTINCT FROM title THEN '## '||h||chr(10)||chr(10) ELSE '' END ||
 CASE WHEN t<>'' THEN regexp_replace(t,'[\s\x0B]+$','')||chr(10)||chr(10) ELSE '' END, '' ORDER BY ordinal) AS body FROM l GROUP BY source_path)
 SELECT source_path, chunks, sha256(regexp_replace(CASE WHEN coalesce(title,'')<>'' THEN '# '||title||chr(10)||chr(10) ELSE '' END || body,'[\s\x0B]+$','')||chr(10)) AS markdown_sha FROM m""")
def reassemble_documents(spark, d):
    r = chunking.reassemble(catalog.latest(table(spark, d, "chunks")))
    return r.select("source_path", "chunks", F.sha2("markdown", 256).alias("markdown_sha"))


@query("contradiction_summary", """SELECT project, count(*) FILTER (NOT closed) AS open, count(*) FILTER (NOT closed AND k='likely-supersession') AS open_supersessions, count(*) FILTER (NOT closed AND k<>'likely-supersession') AS open_contradictions,
 count(*) FILTER (s='dismissed') AS dismissed, count(*) FILTER (s='resolved') AS resolved, count(*) AS total FROM
 (SELECT project, lower(coalesce(status,'open')) AS s, lower(coalesce(kind,'contradiction')) AS k, lower(coalesce(status,'open')) IN ('dismissed','resolved') AS closed FROM contradiction_pairs) GROUP BY project""")
def contradiction_summary(spark, d):
    return catalog.summary(table(spark, d, "contradiction_pairs"))


@query("shortest_labels", """WITH p AS (SELECT DISTINCT source_path AS path, string_split(source_path,'/') AS s FROM chunks), k AS (SELECT path, s, unnest(range(1,len(s)+1)) AS k FROM p WHERE NOT contains(path,'://')),
 l AS (SELECT path, k, array_to_string(list_slice(s,-k,-1),'/') AS label FROM k), u AS (SELECT *, count(*) OVER (PARTITION BY lower(label)) AS n, max(k) OVER (PARTITION BY path) AS most FROM l)
 SELECT path, arg_min(CASE WHEN n=1 THEN label ELSE path END, CASE WHEN n=1 THEN k ELSE most END) AS label FROM u WHERE n=1 OR k=most GROUP BY path UNION ALL SELECT path, path FROM p WHERE contains(path,'://')""")
def shortest_labels(spark, d):
    return catalog.shortest_labels(table(spark, d, "chunks").select(F.col("source_path").alias("path")))


@query("scan_statistics", """WITH d AS (SELECT *, round(font_size*2)/2 AS size FROM pdf_lines), s AS (SELECT source_path, size, sum(word_count) AS w FROM d WHERE size IS NOT NULL AND word_count>0 GROUP BY ALL),
 b AS (SELECT source_path, min(size) AS body_size FROM (SELECT *, sum(w) OVER (PARTITION BY source_path ORDER BY size) AS c, sum(w) OVER (PARTITION BY source_path) AS t FROM s) WHERE c>t//2 GROUP BY source_path),
 l AS (SELECT source_path, round(lag(baseline) OVER (PARTITION BY source_path, page_no ORDER BY line_no, line_id)-baseline,1) AS gap FROM d), n AS (SELECT source_path, gap, count(*) AS w FROM l WHERE gap>0 GROUP BY ALL),
 g AS (SELECT source_path, min(gap) AS typical_gap FROM (SELECT *, sum(w) OVER (PARTITION BY source_path ORDER BY gap) AS c, sum(w) OVER (PARTITION BY source_path) AS t FROM n) WHERE c>t//2 GROUP BY source_path)
 SELECT c.source_path, body_size, typical_gap, lines, pages FROM (SELECT source_path, count(*) AS lines, count(DISTINCT page_no) AS pages FROM d GROUP BY source_path) c LEFT JOIN b ON b.source_path=c.source_path LEFT JOIN g ON g.source_path=c.source_path""")
def scan_statistics(spark, d):
    return layout.statistics(table(spark, d, "pdf_lines"))


HEADINGS_SQL = """(WITH d AS (SELECT *, round(font_size*2)/2 AS size FROM pdf_lines), s AS (SELECT source_path, size, sum(word_count) AS w FROM d WHERE size IS NOT NULL AND word_count>0 GROUP BY ALL),
 b AS (SELECT source_path, min(size) AS body FROM (SELECT *, sum(w) OVER (PARTITION BY source_path ORDER BY size) AS c, sum(w) OVER (PARTITION BY source_path) AS t FROM s) WHERE c>t//2 GROUP BY source_path),
 e AS (SELECT d.*, size>=body*1.15 AS large FROM d JOIN b USING (source_path) WHERE word_count<=15 AND (size>=body*1.15 OR (coalesce(bold,false) AND size>=body AND NOT ends_with(rtrim(text),'.')))),
 r AS (SELECT source_path, size, row_number() OVER (PARTITION BY source_path ORDER BY size DESC) AS r, count(*) OVER (PARTITION BY source_path) AS n FROM (SELECT DISTINCT source_path, size FROM e WHERE large)), n AS (SELECT DISTINCT source_path, n FROM r)
 SELECT line_id, e.source_path, text, CAST(CASE WHEN r.r IS NOT NULL THEN least(r.r,3) ELSE least(coalesce(n.n,0)+1,4) END AS INTEGER) AS level FROM e LEFT JOIN r ON r.source_path=e.source_path AND r.size=e.size LEFT JOIN n ON n.source_path=e.source_path)"""


@query("scan_headings", f"SELECT * FROM {HEADINGS_SQL}")
def scan_headings(spark, d):
    return layout.headings(table(spark, d, "pdf_lines"))


@query("scan_markdown", f"""WITH g AS (SELECT source_path, round(lag(baseline) OVER (PARTITION BY source_path, page_no ORDER BY line_no, line_id)-baseline,1) AS gap FROM pdf_lines), n AS (SELECT source_path, gap, count(*) AS w FROM g WHERE gap>0 GROUP BY ALL),
 t AS (SELECT source_path, min(gap) AS typical FROM (SELECT *, sum(w) OVER (PARTITION BY source_path ORDER BY gap) AS c, sum(w) OVER (PARTITION BY source_path) AS t FROM n) WHERE c>t//2 GROUP BY source_path),
 l AS (SELECT p.*, h.level, typical, lag(baseline) OVER w-baseline AS gap, lag(h.level) OVER w AS after, row_number() OVER w AS nr FROM pdf_lines p LEFT JOIN {HEADINGS_SQL} h USING (line_id) LEFT JOIN t ON t.source_path=p.source_path WINDOW w AS (PARTITION BY p.source_path, p.page_no ORDER BY p.line_no, p.line_id)),
 b AS (SELECT *, sum(CASE WHEN level IS NOT NULL OR after IS NOT NULL OR coalesce(gap>typical*1.6,false) OR nr=1 THEN 1 ELSE 0 END) OVER (PARTITION BY source_path, page_no ORDER BY line_no, line_id) AS k FROM l),
 x AS (SELECT source_path, page_no, k, CASE WHEN max(level) IS NOT NULL THEN repeat('#',max(level))||' ' ELSE '' END||string_agg(text,' ' ORDER BY line_no, line_id) AS t FROM b GROUP BY ALL)
 SELECT source_path, string_agg(t, chr(10)||chr(10) ORDER BY page_no, k) AS markdown FROM x GROUP BY source_path""")
def scan_markdown(spark, d):
    return layout.markdown(table(spark, d, "pdf_lines"))


@query("chunk_conversions")
def chunk_conversions(spark, d):
    return chunking.chunk_documents(table(spark, d, "conversions").dropDuplicates(["source_path"]))


@query("index_summary", "SELECT format, count(*) FILTER (markdown IS NOT NULL AND markdown<>'') AS ok, count(*) FILTER (coalesce(markdown,'')='') AS failed, CAST(sum(length(coalesce(markdown,''))) AS BIGINT) AS chars FROM conversions GROUP BY format")
def index_summary(spark, d):
    c = table(spark, d, "conversions")
    good = F.coalesce("markdown", F.lit("")) != ""
    return c.groupBy("format").agg(F.count_if(good).alias("ok"), F.count_if(~good).alias("failed"), F.sum(F.length(F.coalesce("markdown", F.lit("")))).alias("chars"))


@query("thread_dates", "SELECT thread_id, count(*) AS messages, epoch_us(max(sent_at)) AS newest_us FROM emails GROUP BY thread_id")
def thread_dates(spark, d):
    return table(spark, d, "emails").groupBy("thread_id").agg(F.count("*").alias("messages"), F.unix_micros(F.max("sent_at")).alias("newest_us"))

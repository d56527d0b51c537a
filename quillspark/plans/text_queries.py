"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions.analyzer import tokens
from quillspark.operators import contradictions, retrieval
from quillspark.plans.catalogue import query
from quillspark.tables import table

#: Unicode white space for RE2, whose \s is ASCII.
WS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
NORM = lambda c: f"trim(regexp_replace(lower({c}),'{WS}',' ','g'))"
HASH = lambda c: f"substr(sha256({NORM(c)}),1,16)"
LINES = r"string_split(replace(text,chr(13)||chr(10),chr(10)),chr(10))"


@query("content_hashes", f"SELECT chunk_id, {HASH('text')} AS content_hash FROM chunks")
def content_hashes(spark, d):
    return table(spark, d, "chunks").select("chunk_id", tx.content_hash("text").alias("content_hash"))


@query("line_hashes", f"SELECT DISTINCT chunk_id, substr(sha256(n),1,16) AS line_hash FROM (SELECT chunk_id, {NORM('l')} AS n FROM (SELECT chunk_id, unnest({LINES}) AS l FROM chunks)) WHERE length(n)>=16")
def line_hashes(spark, d):
    return table(spark, d, "chunks").select("chunk_id", F.explode(tx.line_hashes("text")).alias("line_hash"))


@query("template_hashes", f"SELECT project, {HASH('text')} AS content_hash, count(DISTINCT source_path) AS documents FROM chunks GROUP BY ALL HAVING count(DISTINCT source_path)>=3")
def template_hashes(spark, d):
    return contradictions.templates(table(spark, d, "chunks").withColumn("content_hash", tx.content_hash("text")))


@query("template_lines", f"""SELECT project, substr(sha256(n),1,16) AS line_hash, count(DISTINCT source_path) AS documents FROM (SELECT project, source_path, {NORM('l')} AS n FROM
 (SELECT project, source_path, unnest({LINES}) AS l FROM chunks)) WHERE length(n)>=16 GROUP BY ALL HAVING count(DISTINCT source_path)>=3""")
def template_lines(spark, d):
    return contradictions.template_lines(table(spark, d, "chunks"))


@query("excerpts", r"SELECT chunk_id, CASE WHEN length(e)>240 THEN substr(e,1,240)||'…' ELSE e END AS excerpt FROM (SELECT chunk_id, trim(regexp_replace(text,'\r?\n',' ','g')) AS e FROM chunks)")
def excerpts(spark, d):
    return table(spark, d, "chunks").select("chunk_id", tx.excerpt("text").alias("excerpt"))


@query("slugs", r"SELECT chunk_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(title),'[^\p{L}\p{Nd}]+','-','g'),'^-+',''),1,80),'-+$','') AS slug FROM chunks WHERE title IS NOT NULL")
def slugs(spark, d):
    return table(spark, d, "chunks").filter("title IS NOT NULL").select("chunk_id", tx.slug("title").alias("slug"))


@query("escaped_cells", r"SELECT chunk_id, trim(regexp_replace(replace(replace(text,'\','\\'),'|','\|'),'\r\n|\r|\n',' ','g')) AS cell FROM chunks")
def escaped_cells(spark, d):
    return table(spark, d, "chunks").select("chunk_id", tx.escape_cell("text", backslash=True).alias("cell"))


@query("thread_subjects", f"SELECT email_id, regexp_replace(subject,'(?i){tx.REPLY_PREFIX}','') AS subject FROM emails")
def thread_subjects(spark, d):
    return table(spark, d, "emails").select("email_id", tx.without_reply_prefix("subject").alias("subject"))


@query("ticket_mentions", r"SELECT key, count(DISTINCT chunk_id) AS chunks FROM (SELECT chunk_id, upper(unnest(regexp_extract_all(text,'(?i)\b[A-Z][A-Z0-9]+-\d+\b'))) AS key FROM chunks) GROUP BY key")
def ticket_mentions(spark, d):
    m = table(spark, d, "chunks").select(F.explode(tx.mentions("text")).alias("key"))
    return m.groupBy("key").agg(F.count("*").alias("chunks"))


@query("mentioned_projects", r"""SELECT p AS project_key, count(*) AS mentions FROM (SELECT split_part(k,'-',1) AS p FROM (SELECT DISTINCT chunk_id, upper(unnest(regexp_extract_all(text,'(?i)\b[A-Z][A-Z0-9]+-\d+\b'))) AS k FROM chunks))
 WHERE p IN (SELECT DISTINCT split_part(substr(source_path,8),'-',1) FROM chunks WHERE starts_with(source_path,'jira://')) GROUP BY p""")
def mentioned_projects(spark, d):
    c = table(spark, d, "chunks")
    keys = c.filter(F.col("source_path").startswith("jira://")).select(tx.key_project(F.substring("source_path", 8, 1000)).alias("project_key")).distinct()
    m = c.select(F.explode(tx.mentions("text")).alias("k")).select(tx.key_project("k").alias("project_key"))
    return m.join(keys, "project_key", "left_semi").groupBy("project_key").agg(F.count("*").alias("mentions"))


@query("pair_ids", """WITH s AS (SELECT pair_id, min(side_id) FILTER (side='a') AS a, min(side_id) FILTER (side='b') AS b FROM contradiction_sides GROUP BY pair_id HAVING a IS NOT NULL AND b IS NOT NULL),
 k AS (SELECT s.pair_id, x.source_path||'#'||x.ordinal AS p, y.source_path||'#'||y.ordinal AS q FROM s JOIN contradiction_sides x ON x.side_id=s.a JOIN contradiction_sides y ON y.side_id=s.b)
 SELECT pair_id, substr(sha256(least(p,q)||'|'||greatest(p,q)),1,16) AS computed FROM k""")
def pair_ids(spark, d):
    s = table(spark, d, "contradiction_sides")
    end = lambda side: s.filter(F.col("side") == side).groupBy("pair_id").agg(F.min_by(F.struct("source_path", "ordinal"), "side_id").alias(side))
    return end("a").join(end("b"), "pair_id").select("pair_id", tx.pair_id("a.source_path", "a.ordinal", "b.source_path", "b.ordinal").alias("computed"))


@query("note_ids", "SELECT side_id, substr(sha256(p.project||'|'||s.source_path||'|'||s.excerpt),1,16) AS note_id FROM contradiction_sides s JOIN (SELECT pair_id, min(project) AS project FROM contradiction_pairs GROUP BY pair_id) p USING (pair_id)")
def note_ids(spark, d):
    p = table(spark, d, "contradiction_pairs").groupBy("pair_id").agg(F.min("project").alias("project"))
    return table(spark, d, "contradiction_sides").join(p, "pair_id").select("side_id", tx.note_id("project", "source_path", "excerpt").alias("note_id"))


@query("normalized_paths", "SELECT DISTINCT source_path, CASE WHEN regexp_matches(trim(source_path),'^[a-z]+://') THEN trim(source_path) ELSE lower(replace(trim(source_path),'\\','/')) END AS path, split_part(source_path,'/',-1) AS name FROM chunks")
def normalized_paths(spark, d):
    return table(spark, d, "chunks").select("source_path", tx.normalize_path("source_path").alias("path"), tx.file_name("source_path").alias("name")).distinct()


@query("markdown_titles", r"SELECT source_path, count(*) AS copies, min(CASE WHEN t<>'' THEN t END) AS heading FROM (SELECT source_path, regexp_extract(markdown,'(?m)^#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$',1) AS t FROM conversions) GROUP BY source_path")
def markdown_titles(spark, d):
    return table(spark, d, "conversions").select("source_path", tx.markdown_title("markdown").alias("t")).groupBy("source_path").agg(F.count("*").alias("copies"), F.min("t").alias("heading"))


@query("natural_order", r"""WITH p AS (SELECT DISTINCT source_path FROM chunks) SELECT source_path, array_to_string(list_transform(regexp_extract_all(lower(source_path),'\d+|\D+'),
 lambda x: CASE WHEN regexp_matches(x,'^\d') THEN lpad(CAST(length(regexp_replace(x,'^0+(.)','\1')) AS VARCHAR),10,'0')||regexp_replace(x,'^0+(.)','\1') ELSE x END),'') AS sort_key FROM p""")
def natural_order(spark, d):
    return table(spark, d, "chunks").select("source_path").distinct().withColumn("sort_key", tx.natural_key("source_path"))


PART = r"\p{Lu}+\p{Ll}*|\p{Ll}+|[\p{Lo}\p{Lm}\p{Lt}]+|\p{Nd}+"
TOKENS = lambda c: rf"list_filter(string_split_regex(coalesce({c},''),'[\s\x0B]+'), lambda w: w<>'')"
POSTINGS = lambda tbl, key, c: rf"""SELECT id, unnest(list_distinct(list_transform(list_concat([w],regexp_extract_all(w,'{PART}')), lambda x: lower(replace(x,'İ','i'||chr(775)))))) AS term FROM (SELECT {key} AS id, unnest({TOKENS(c)}) AS w FROM {tbl})"""


@query("token_counts", f"SELECT id AS doc_id, count(*) AS tokens, count(DISTINCT term) AS terms FROM ({POSTINGS('documents', 'doc_id', 'text')}) GROUP BY id")
def token_counts(spark, d):
    t = table(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("t")).filter("size(t) > 0")
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("terms"))


@query("document_frequency", f"SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM ({POSTINGS('documents', 'doc_id', 'text')}) GROUP BY term")
def document_frequency(spark, d):
    return retrieval.document_frequency(table(spark, d, "documents"), "doc_id", "text")

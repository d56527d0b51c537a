"""Change data, graphs, conversion and streaming."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import crawl
from quillspark.plans.catalogue import query
from quillspark.session import scratch_path
from quillspark.streaming import watch
from quillspark.tables import table

#: The manifest of the queries: what was on disk before 2026, with every seventh file since vanished and some lengths out of date.
DISK_SQL = "(SELECT source_path, max(source_modified_at) AS mtime, CAST(sum(length(coalesce(text,''))) AS BIGINT) AS length FROM chunks GROUP BY source_path)"
MANIFEST_SQL = f"(SELECT source_path||CASE WHEN length%7=0 THEN '.old' ELSE '' END AS source_path, mtime, CASE WHEN length%5=0 THEN length+1 ELSE length END AS length FROM {DISK_SQL} WHERE mtime < TIMESTAMPTZ '2026-01-01 00:00:00+00')"


def _disk(spark, d):
    return table(spark, d, "chunks").groupBy("source_path").agg(F.max("source_modified_at").alias("mtime"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("length"))


@query("reconcile_actions", f"SELECT coalesce(a.source_path,b.source_path) AS source_path, CASE WHEN a.source_path IS NULL THEN 'delete' WHEN b.source_path IS NULL OR a.mtime IS DISTINCT FROM b.mtime OR a.length IS DISTINCT FROM b.length THEN 'upsert' ELSE 'skip' END AS action FROM {DISK_SQL} a FULL JOIN {MANIFEST_SQL} b ON a.source_path=b.source_path")
def reconcile_actions(spark, d):
    disk = _disk(spark, d)
    old = disk.filter(F.col("mtime") < F.to_timestamp(F.lit("2026-01-01 00:00:00")))
    gone = F.when(F.col("length") % 7 == 0, ".old").otherwise("")
    manifest = old.select(F.concat("source_path", gone).alias("source_path"), "mtime", F.when(F.col("length") % 5 == 0, F.col("length") + 1).otherwise(F.col("length")).alias("length"))
    return crawl.reconcile(disk, manifest)


STORED_SQL = "(SELECT user_id AS key, max(ts) FILTER (ts < TIMESTAMP '2024-01-20 00:00:00') AS stamp FROM events GROUP BY user_id)"
LIVE_SQL = "(SELECT user_id AS key, max(ts) FILTER (event_type<>'error') AS stamp FROM events GROUP BY user_id)"


def _monitor(spark, d):
    e = table(spark, d, "events")
    ts = F.col("ts").cast("timestamp_ntz")
    stored = e.groupBy(F.col("user_id").alias("key")).agg(F.max(F.when(ts < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), ts)).alias("stamp"))
    return stored, e.groupBy(F.col("user_id").alias("key")).agg(F.max(F.when(F.col("event_type") != "error", ts)).alias("stamp"))


@query("changed_keys", f"SELECT l.key, CAST(epoch_us(l.stamp) AS BIGINT) AS stamp_us FROM {STORED_SQL} s JOIN {LIVE_SQL} l ON s.key=l.key WHERE l.stamp IS NOT NULL AND (s.stamp IS NULL OR l.stamp>s.stamp)")
def changed_keys(spark, d):
    c = crawl.changed_stamps(*_monitor(spark, d))
    return c.select("key", F.unix_micros(F.col("stamp").cast("timestamp")).alias("stamp_us"))


@query("changed_versions", "SELECT s.key, l.version FROM (SELECT user_id AS key, count(*) FILTER (event_id%3<>0) AS version FROM events GROUP BY user_id) s JOIN (SELECT user_id AS key, count(*) AS version FROM events GROUP BY user_id) l ON s.key=l.key WHERE l.version>s.version")
def changed_versions(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("key"))
    return crawl.changed_versions(e.agg(F.count_if(F.col("event_id") % 3 != 0).alias("version")), e.agg(F.count("*").alias("version")))


@query("merge_upsert", f"SELECT s.key, CAST(epoch_us(coalesce(CASE WHEN l.stamp IS NOT NULL AND (s.stamp IS NULL OR l.stamp>s.stamp) THEN l.stamp END, s.stamp)) AS BIGINT) AS stamp_us FROM {STORED_SQL} s LEFT JOIN {LIVE_SQL} l ON s.key=l.key")
def merge_upsert(spark, d):
    stored, live = _monitor(spark, d)
    m = crawl.merged(stored, crawl.changed_stamps(stored, live))
    return m.select("key", F.unix_micros(F.col("stamp").cast("timestamp")).alias("stamp_us"))


BURST_SQL = """(WITH g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS s FROM events),
 i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g) SELECT user_id, burst, arg_max(event_type, ts) AS kind, min(ts) AS a, max(ts) AS b, count(*) AS events FROM i GROUP BY user_id, burst)"""


@query("debounce_last_wins", f"SELECT user_id, kind, CAST(epoch_us(a) AS BIGINT) AS first_us, CAST(epoch_us(b) AS BIGINT) AS last_us, events FROM {BURST_SQL}")
def debounce_last_wins(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    b = watch.debounced(e, key="user_id", quiet="30 minutes")
    return b.select("user_id", "kind", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "events")


@query("sessionized_events", f"SELECT user_id, count(*) AS sessions, max(events) AS longest FROM {BURST_SQL} GROUP BY user_id")
def sessionized_events(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    return watch.debounced(e, key="user_id", quiet="30 minutes").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("longest"))


@query("hourly_events", "SELECT CAST(epoch_us(date_trunc('hour',ts)) AS BIGINT) AS window_us, event_type, count(*) AS events, round(sum(value),2) AS total FROM events GROUP BY ALL")
def hourly_events(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return watch.windowed_counts(e).select(F.unix_micros("window_start").alias("window_us"), "event_type", "events", "total")


#: The reply graph of the mails.
EDGES_SQL = "(SELECT DISTINCT in_reply_to AS src, email_id AS dst FROM emails WHERE in_reply_to IS NOT NULL)"
SEEDS_SQL = "(SELECT email_id AS id FROM emails WHERE in_reply_to IS NULL)"


def _replies(spark, d):
    m = table(spark, d, "emails")
    return m.filter("in_reply_to IS NOT NULL").select(F.col("in_reply_to").alias("src"), F.col("email_id").alias("dst")).distinct(), m.filter("in_reply_to IS NULL").select(F.col("email_id").alias("id"))


@query("bfs_depth", f"WITH RECURSIVE w AS (SELECT id, 0 AS depth FROM {SEEDS_SQL} UNION SELECT e.dst, w.depth+1 FROM w JOIN {EDGES_SQL} e ON e.src=w.id WHERE w.depth<6) SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY id")
def bfs_depth(spark, d):
    edges, seeds = _replies(spark, d)
    return crawl.bfs(edges, seeds, max_depth=6)[0].select("id", "depth")


@query("bfs_budget", f"""WITH RECURSIVE w AS (SELECT id, 0 AS depth FROM {SEEDS_SQL} UNION SELECT e.dst, w.depth+1 FROM w JOIN {EDGES_SQL} e ON e.src=w.id WHERE w.depth<2), m AS (SELECT id, min(depth) AS depth FROM w GROUP BY id),
 p AS (SELECT m.id, m.depth, min(e.src) AS via FROM m LEFT JOIN {EDGES_SQL} e ON e.dst=m.id GROUP BY ALL), z AS (SELECT id, row_number() OVER (ORDER BY id) AS pos FROM p WHERE depth=0),
 o AS (SELECT id, pos FROM (SELECT p.id, row_number() OVER (ORDER BY z.pos, p.id) AS pos FROM p JOIN z ON z.id=p.via WHERE depth=1)),
 q AS (SELECT p.id, row_number() OVER (ORDER BY o.pos, p.id) AS pos FROM p JOIN o ON o.id=p.via WHERE depth=2),
 a AS (SELECT id, 0 AS depth, pos FROM z UNION ALL SELECT id, 1, pos FROM o UNION ALL SELECT id, 2, pos FROM q)
 SELECT id, CAST(depth AS INTEGER) AS depth FROM (SELECT *, row_number() OVER (ORDER BY depth, pos) AS n FROM a) WHERE n<=200""")
def bfs_budget(spark, d):
    edges, seeds = _replies(spark, d)
    return crawl.bfs(edges, seeds, max_depth=2, budget=200)[0].select("id", "depth")


@query("tree_roots", "SELECT email_id AS id, CASE WHEN in_reply_to IN (SELECT email_id FROM emails) AND in_reply_to<>email_id THEN in_reply_to END AS parent_id, NOT coalesce(in_reply_to IN (SELECT email_id FROM emails) AND in_reply_to<>email_id, false) AS is_root FROM emails")
def tree_roots(spark, d):
    return crawl.tree(table(spark, d, "emails").select(F.col("email_id").alias("id"), F.col("in_reply_to").alias("parent_id")))


@query("scope_closure", """WITH RECURSIVE a AS (SELECT email_id AS id, in_reply_to AS up FROM emails WHERE in_reply_to IS NOT NULL UNION SELECT a.id, e.in_reply_to FROM a JOIN emails e ON e.email_id=a.up WHERE e.in_reply_to IS NOT NULL)
 SELECT up AS page_id, count(DISTINCT id) AS below FROM a GROUP BY up""")
def scope_closure(spark, d):
    """Per mail the number of mails below it: the closure of the reply links."""
    m = table(spark, d, "emails").filter("in_reply_to IS NOT NULL").select(F.col("email_id").alias("id"), F.col("in_reply_to").alias("up"))
    return crawl.closure(m).groupBy(F.col("up").alias("page_id")).agg(F.countDistinct("id").alias("below"))


@query("neighbour_edges", r"""WITH c AS (SELECT upper(substr(source_path,8)) AS k, text FROM chunks WHERE starts_with(source_path,'jira://')), i AS (SELECT DISTINCT k, regexp_extract(k,'^([A-Z][A-Z0-9]*)-\d+$',1) AS p, TRY_CAST(regexp_extract(k,'-(\d+)$',1) AS INTEGER) AS n FROM c),
 e AS (SELECT k AS src, p||'-'||(n+1) AS dst, 'link' AS rel, 0 AS pos FROM i WHERE p<>'' UNION ALL SELECT k, p||'-1', 'parent', 10000 FROM i WHERE n>1 AND p<>'' UNION ALL SELECT p||'-1', k, 'child', 30000 FROM i WHERE n>1 AND p<>''
  UNION ALL SELECT k, m, 'mention', 40000 FROM (SELECT DISTINCT k, upper(unnest(regexp_extract_all(text,'(?i)\b[A-Z][A-Z0-9]+-\d+\b'))) AS m FROM c) WHERE regexp_extract(m,'^([A-Z][A-Z0-9]*)-\d+$',1) IN (SELECT p FROM i WHERE p<>''))
 SELECT src, dst, arg_min(rel,pos) AS rel FROM e WHERE dst<>'' AND src<>dst GROUP BY src, dst""")
def neighbour_edges(spark, d):
    """Edges of the ticket documents: the tickets that a ticket's text mentions, and the next number of its project as a link."""
    c = table(spark, d, "chunks").filter(F.col("source_path").startswith("jira://"))
    key = F.substring("source_path", 8, 1000)
    issues = c.groupBy(key.alias("key")).agg(F.concat_ws("\n", F.array_sort(F.collect_set("text"))).alias("text"))
    number = F.regexp_extract("key", r"-(\d+)$", 1).cast("int")
    nxt = F.concat(tx.key_project("key"), F.lit("-"), (number + 1).cast("string"))
    issues = issues.withColumns({"parent": F.when(number > 1, F.concat(tx.key_project("key"), F.lit("-1"))), "links": F.array(nxt), "subtasks": F.array().cast("array<string>")})
    projects = issues.select(tx.key_project("key").alias("project_key")).distinct()
    return crawl.neighbour_edges(issues, projects, issues.select("key")).drop("pos")


@query("html_roundtrip")
def html_roundtrip(spark, d):
    """Conversions' markdown headings and paragraphs as HTML, through the HTML converter again."""
    from quillspark.sources.convert import html_to_markdown

    run = F.udf(lambda h: html_to_markdown(h or "")[0], "string", useArrow=True)
    c = table(spark, d, "conversions").filter("format = 'Markdown'")
    esc = F.replace(F.replace(F.replace("markdown", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.regexp_replace(F.regexp_replace(esc, r"(?m)^## (.+)$", "<h2>$1</h2>"), r"(?m)^# (.+)$", "<h1>$1</h1>")
    return c.select("source_path", run(F.concat(F.lit("<html><body>"), body, F.lit("</body></html>"))).alias("markdown"))


@query("watch_stream")
def watch_stream(spark, d):
    """The change stream of the events table through file events, debounce and a checkpointed sink; what a stream gave is read back."""
    src, out, cp = (scratch_path(spark, n) for n in ("watch-in", "watch-out", "watch-cp"))
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    change = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "signup", "renamed").otherwise("changed")
    path = F.format_string("/docs/%s.md", F.col("user_id"))
    changes = e.select(path.alias("path"), F.format_string("/docs/%s.csv", F.col("user_id")).alias("old_path"), change.alias("change"), "ts")
    end = changes.agg((F.max("ts") + F.expr("INTERVAL 60 DAYS")).alias("ts")).select(F.lit("/docs/end.md").alias("path"), F.lit(None).cast("string").alias("old_path"), F.lit("changed").alias("change"), "ts")
    changes.write.parquet(f"{src}/n=1")
    end.write.parquet(f"{src}/n=2")  # a later event moves the watermark past every burst
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    q = watch.debounced(watch.file_events(stream), quiet="30 minutes", late="40 days").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
    q.awaitTermination()
    done = spark.read.schema("path string, kind string, first_ts timestamp, last_ts timestamp, events long").parquet(out)
    rank = F.row_number().over(Window.partitionBy("path").orderBy("first_ts"))
    return done.filter("path <> '/docs/end.md'").withColumn("burst", rank)

"""API-shaped sources: a paged reader as a Python data source, and tickets, development panels and wiki pages from their JSON.

Payloads are read as text, one row per response, and taken apart by ``from_json`` with explicit schemas, so that nested fields are
pruned and missing or mistyped ones are null. The transport, a function from a path to (status, body), is a parameter: the reader
itself knows no host, and tests give it a dictionary.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspark.functions import text as tx
from quillspark.sources.convert import html_to_markdown

Transport = Callable[[str], tuple[int, str]]
BATCH, COMMITS = 100, 20


class _Batch(InputPartition):
    def __init__(self, keys: list[str]):
        self.keys = keys


def source(name: str, transport: Transport) -> type[DataSource]:
    """A data source ``name`` with (key, status, payload), one row per key of option ``keys`` (a JSON list), read in partitions of BATCH keys.

    The path of a key is option ``path`` with ``{key}`` in it. A failed request is a row with its status and no payload.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.keys = json.loads(options.get("keys", "[]"))
            self.path = options.get("path", "{key}")

        def partitions(self) -> list[InputPartition]:
            return [_Batch(self.keys[i : i + BATCH]) for i in range(0, len(self.keys), BATCH)] or [_Batch([])]

        def read(self, partition: _Batch) -> Iterator[tuple]:
            for k in partition.keys:
                try:
                    status, body = transport(self.path.format(key=k))
                except OSError as e:
                    status, body = 0, str(e)
                yield (k, status, body if status == 200 else None)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "key string, status int, payload string"

        def reader(self, schema) -> DataSourceReader:
            return Reader(dict(self.options))

    return Source


def fetch(spark: SparkSession, name: str, keys: list[str], path: str = "{key}") -> DataFrame:
    return spark.read.format(name).option("keys", json.dumps(keys)).option("path", path).load()


def paged(transport: Transport, path: str, items: str, cursor: Callable[[dict], str | None], most: int, requests: int = 500) -> list[dict]:
    """Items of a listing that continues by a cursor: at most ``most``. A cursor seen before ends it; a listing that goes on after ``requests`` calls ends there with a warning."""
    out: list[dict] = []
    seen: set[str] = set()
    nxt: str | None = path
    while nxt and nxt not in seen and len(seen) < requests and len(out) < most:
        seen.add(nxt)
        status, body = transport(nxt)
        if status != 200:
            raise OSError(f"HTTP {status} for {nxt}")
        page = json.loads(body)
        out += page.get(items) or []
        nxt = cursor(page)
    if nxt and nxt not in seen and len(out) < most:
        warnings.warn(f"{path}: the listing goes on after {requests} calls", stacklevel=2)
    return out[:most]


def _markdown(html: Column | str) -> Column:
    return F.udf(lambda h: html_to_markdown(h)[0] if h else "", "string", useArrow=True)(html)


_PERSON, _NAMED, _KEYED = "struct<displayName:string>", "struct<name:string>", "struct<key:string>"
TICKET = (
    f"id string, key string, fields struct<summary:string, status:{_NAMED}, issuetype:{_NAMED}, priority:{_NAMED}, reporter:{_PERSON}, assignee:{_PERSON}, labels:array<string>, created:string, updated:string, parent:{_KEYED}, "
    f"subtasks:array<{_KEYED}>, issuelinks:array<struct<type:struct<inward:string,outward:string>, inwardIssue:{_KEYED}, outwardIssue:{_KEYED}>>, comment:struct<comments:array<struct<id:string, author:{_PERSON}, created:string>>>>, "
    "renderedFields struct<description:string, comment:struct<comments:array<struct<id:string, body:string>>>>"
)
PANEL = (
    "detail array<struct<pullRequests:array<struct<id:string, name:string, status:string, url:string, author:struct<name:string>, source:struct<branch:string>, destination:struct<branch:string>, repositoryName:string, lastUpdate:string, "
    "reviewers:array<struct<name:string, approved:boolean>>>>, branches:array<struct<name:string, url:string, repository:struct<name:string>>>, "
    "repositories:array<struct<name:string, commits:array<struct<id:string, displayId:string, author:struct<name:string>, authorTimestamp:string, message:string, url:string, merge:boolean>>>>>>"
)
PAGE = (
    "id string, type string, title string, space struct<key:string>, ancestors array<struct<id:string, title:string>>, version struct<number:int, `when`:string, by:struct<displayName:string>>, body struct<view:struct<value:string>>, "
    "children struct<page:struct<results:array<struct<id:string>>>>"
)


def tickets(raw: DataFrame) -> DataFrame:
    """Tickets of (key, payload): comments with their rendered bodies joined by id, links in their direction."""
    t = raw.filter("payload IS NOT NULL").withColumn("j", F.from_json("payload", TICKET))
    bodies = F.map_from_entries(F.filter(F.transform(F.coalesce("j.renderedFields.comment.comments", F.array()), lambda c: F.struct(c["id"], c["body"])), lambda e: e["id"].isNotNull()))
    comments = F.transform(F.coalesce("j.fields.comment.comments", F.array()), lambda c: F.struct(F.coalesce(c["author"]["displayName"], F.lit("Unknown")).alias("author"), tx.api_timestamp(c["created"]).alias("created"), F.coalesce(F.try_element_at(bodies, c["id"]), F.lit("")).alias("html")))
    link = lambda x: F.when(x["outwardIssue"]["key"].isNotNull(), F.struct(F.coalesce(x["type"]["outward"], F.lit("relates to")).alias("relation"), x["outwardIssue"]["key"].alias("key"))).when(x["inwardIssue"]["key"].isNotNull(), F.struct(F.coalesce(x["type"]["inward"], F.lit("relates to")).alias("relation"), x["inwardIssue"]["key"].alias("key")))
    f = "j.fields."
    return t.select(
        F.coalesce("j.key", "key").alias("key"), F.coalesce(f + "summary", "key").alias("summary"), F.col(f + "status.name").alias("status"), F.col(f + "issuetype.name").alias("type"), F.col(f + "priority.name").alias("priority"),
        F.col(f + "reporter.displayName").alias("reporter"), F.col(f + "assignee.displayName").alias("assignee"), F.coalesce(f + "labels", F.array()).alias("labels"), tx.api_timestamp(f + "created").alias("created"), tx.api_timestamp(f + "updated").alias("updated"),
        F.col(f + "parent.key").alias("parent"), F.filter(F.transform(F.coalesce(f + "subtasks", F.array()), lambda s: s["key"]), lambda k: k.isNotNull()).alias("subtasks"), F.filter(F.transform(F.coalesce(f + "issuelinks", F.array()), link), lambda x: x.isNotNull()).alias("links"),
        F.col("j.renderedFields.description").alias("description_html"), comments.alias("comments"),
    )


def panel_plan(summaries: DataFrame) -> DataFrame:
    """(key, instance, data_type) to fetch: only categories whose summary counts anything; each once."""
    overall = "struct<overall:struct<count:int>, byInstanceType:map<string,struct<count:int>>>"
    s = summaries.filter("payload IS NOT NULL").select("key", F.from_json("payload", f"summary struct<pullrequest:{overall}, branch:{overall}, repository:{overall}>").alias("j"))
    parts = [s.filter(F.col(f"j.summary.{c}.overall.count") > 0).select("key", F.explode(F.map_keys(f"j.summary.{c}.byInstanceType")).alias("instance"), F.lit(t).alias("data_type")) for c, t in (("pullrequest", "pullrequest"), ("branch", "pullrequest"), ("repository", "repository"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def panel_verdict(status: Column) -> Column:
    """What a failed panel request means: no panel anywhere (a bad credential or a withdrawn endpoint), none for this project, or none for this ticket."""
    return F.when(status == 200, "ok").when(status.isin(401, 404, 410), "off").when(status == 403, "project").otherwise("ticket")


def panels(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pull requests, branches, commits) of (key, payload) details, without the repeats that several instances give."""
    d = raw.filter("payload IS NOT NULL").select("key", F.explode(F.from_json("payload", PANEL)["detail"]).alias("d"))
    p = d.select("key", F.explode("d.pullRequests").alias("p"))
    pulls = p.select("key", F.coalesce("p.name", "p.id", F.lit("(untitled pull request)")).alias("name"), F.col("p.status").alias("status"), F.col("p.author.name").alias("author"), F.col("p.source.branch").alias("source"), F.col("p.destination.branch").alias("destination"), F.col("p.repositoryName").alias("repository"), F.col("p.url").alias("url"), tx.api_timestamp("p.lastUpdate").alias("updated"), F.filter(F.coalesce("p.reviewers", F.array()), lambda r: r["name"].isNotNull()).alias("reviewers")).dropDuplicates(["key", "url", "name"])
    b = d.select("key", F.explode("d.branches").alias("b")).filter("b.name IS NOT NULL")
    branches = b.select("key", F.col("b.name").alias("name"), F.col("b.repository.name").alias("repository"), F.col("b.url").alias("url")).dropDuplicates(["key", "name", "repository"])
    r = d.select("key", F.explode("d.repositories").alias("r")).select("key", F.col("r.name").alias("repository"), F.explode("r.commits").alias("c")).filter("c.id IS NOT NULL")
    commits = r.select("key", F.col("c.id").alias("id"), F.coalesce("c.displayId", F.substring("c.id", 1, 7)).alias("display_id"), F.col("c.author.name").alias("author"), tx.api_timestamp("c.authorTimestamp").alias("authored"), F.col("c.message").alias("message"), F.col("c.url").alias("url"), "repository", F.coalesce("c.merge", F.lit(False)).alias("merge")).dropDuplicates(["key", "id"])
    return pulls, branches, commits


def _when(c: Column, fmt: str, other: str) -> Column:
    return F.coalesce(F.date_format(c, fmt), F.lit(other))


def _section(title: str, body: Column) -> Column:
    return F.when(body != "", F.concat(F.lit(f"{title}\n\n"), body))


def panel_markdown(pulls: DataFrame, branches: DataFrame, commits: DataFrame) -> DataFrame:
    """(key, panel): the development section of each ticket; of the commits the first COMMITS with a line that counts the rest."""
    field = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"- {name}: "), tx.inline(c)))
    who = F.array_join(F.transform("reviewers", lambda r: F.when(r["approved"], F.concat(r["name"], F.lit(" (approved)"))).otherwise(r["name"])), ", ")
    branch = F.when(F.col("source").isNotNull(), F.concat(F.lit("- Branch: `"), tx.inline("source"), F.lit("`"), F.coalesce(F.concat(F.lit(" → `"), tx.inline("destination"), F.lit("`")), F.lit(""))))
    head = F.concat(F.lit("**"), tx.inline("name"), F.lit("**"), F.coalesce(F.concat(F.lit(" — "), tx.inline("status")), F.lit("")))
    body = F.concat_ws("\n", branch, field("Repository", F.col("repository")), field("Author", F.col("author")), field("Reviewers", who), field("Updated", F.concat(F.date_format("updated", "yyyy-MM-dd HH:mm"), F.lit(" UTC"))), field("URL", F.col("url")))
    p = pulls.select("key", F.struct("url", "name", F.concat_ws("\n\n", head, F.when(body != "", body)).alias("t")).alias("x")).groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n\n").alias("_p"))
    b = branches.select("key", F.struct("name", "repository", F.concat(F.lit("- `"), tx.inline("name"), F.lit("`"), F.coalesce(F.concat(F.lit(" — "), tx.inline("repository")), F.lit(""))).alias("t")).alias("x")).groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias("_b"))
    meta = F.concat_ws(" · ", tx.inline("author"), F.date_format("authored", "yyyy-MM-dd"), tx.inline("repository"))
    text = F.concat(F.lit("**`"), tx.inline("display_id"), F.lit("`**"), F.when(meta != "", F.concat(F.lit(" — "), meta)).otherwise(""), F.when(F.trim(F.coalesce("message", F.lit(""))) != "", F.concat(F.lit("\n\n"), tx.escape_headings(F.trim("message")))).otherwise(""))
    c = commits.select("key", F.struct((-F.unix_micros("authored")).alias("a"), "id", text.alias("t")).alias("x")).groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    rest = F.when(F.size("xs") > COMMITS, F.format_string("_… %d more commit(s) on this ticket, not shown._", F.size("xs") - COMMITS))
    c = c.select("key", F.concat_ws("\n\n", F.array_join(F.transform(F.slice("xs", 1, COMMITS), lambda x: x["t"]), "\n\n"), rest).alias("_c"))
    d = p.join(b, "key", "full_outer").join(c, "key", "full_outer")
    part = lambda t, col: _section(t, F.coalesce(col, F.lit("")))
    return d.select("key", F.concat_ws("\n\n", F.lit("## Development"), part("### Pull requests", "_p"), part("### Branches", "_b"), part("### Commits", "_c")).alias("panel"))


def ticket_documents(tickets_: DataFrame, site: str, pulled_at: Column, panel: DataFrame | None = None, project: str = "default") -> DataFrame:
    """(source_path, title, markdown, source_modified_at, project, format): a ticket with its facts, description, links, panel and a section per comment."""
    t = tickets_ if panel is None else tickets_.join(panel, "key", "left")
    t = t if panel is not None else t.withColumn("panel", F.lit(None).cast("string"))
    title = F.concat("key", F.lit(": "), "summary")
    fact = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), tx.inline(c)))
    facts = F.concat_ws(" · ", fact("Type", F.col("type")), fact("Status", F.col("status")), fact("Priority", F.col("priority")), fact("Reporter", F.col("reporter")), fact("Assignee", F.col("assignee")), fact("Updated", F.date_format("updated", "yyyy-MM-dd")))
    quote = F.concat_ws("\n", F.when(facts != "", F.concat(F.lit("> "), facts)), F.when(F.size("labels") > 0, F.concat(F.lit("> Labels: "), tx.inline(F.array_join("labels", ", ")))), F.concat(F.lit("> Parent: "), "parent"), F.concat(F.lit(f"> Pulled from {site} on "), F.date_format(pulled_at, "yyyy-MM-dd HH:mm"), F.lit(" UTC.")))
    links = F.array_join(F.transform("links", lambda x: F.concat(F.lit("- "), tx.inline(x["relation"]), F.lit(" "), x["key"])), "\n")
    said = t.select("key", F.posexplode("comments").alias("n", "c")).select("key", "n", F.concat(F.lit("## Comment by "), tx.inline("c.author"), F.lit(", "), _when(F.col("c.created"), "yyyy-MM-dd HH:mm", "unknown date"), F.lit("\n\n"), F.coalesce(F.nullif(tx.escape_headings(F.trim(_markdown("c.html"))), F.lit("")), F.lit("_(no text)_"))).alias("s"))
    said = said.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]), "\n\n").alias("_comments"))
    md = F.concat_ws("\n\n", F.concat(F.lit("# "), tx.inline(title)), quote, _section("## Description", tx.escape_headings(F.trim(_markdown("description_html")))), _section("## Linked issues", links), "panel", "_comments")
    return t.join(said, "key", "left").select(tx.ticket_key("key").alias("source_path"), title.alias("title"), md.alias("markdown"), F.coalesce("updated", "created", pulled_at).alias("source_modified_at"), F.lit(project).alias("project"), F.lit("Jira").alias("format"))


def pages(raw: DataFrame) -> DataFrame:
    """Wiki pages of (key, payload), with ancestors root first, children, and the other pages that the body links to."""
    p = raw.filter("payload IS NOT NULL").withColumn("j", F.from_json("payload", PAGE))
    pid = F.coalesce("j.id", "key")
    ids = lambda c: F.filter(F.transform(F.coalesce(c, F.array()), lambda x: x["id"]), lambda x: x.isNotNull())
    html = F.coalesce("j.body.view.value", F.lit(""))
    return p.select(
        pid.alias("page_id"), F.coalesce("j.title", "key").alias("title"), F.coalesce("j.type", F.lit("page")).alias("type"), F.col("j.space.key").alias("space"), F.filter(F.transform(F.coalesce("j.ancestors", F.array()), lambda x: x["title"]), lambda x: x.isNotNull()).alias("ancestors"), ids("j.ancestors").alias("ancestor_ids"),
        F.coalesce("j.version.number", F.lit(0)).alias("version"), tx.api_timestamp("j.version.when").alias("updated"), F.col("j.version.by.displayName").alias("updated_by"), html.alias("html"), ids("j.children.page.results").alias("child_ids"), F.filter(tx.page_ids(html), lambda x: x != pid).alias("linked_ids"),
    )


def page_documents(pages_: DataFrame, site: str, pulled_at: Column, comments: DataFrame | None = None, project: str = "default") -> DataFrame:
    """A page with its facts and body, and its comments, oldest first. ``comments``: page_id, author, created, html, inline, resolution, anchor."""
    facts = F.concat_ws(" · ", F.concat(F.lit("Space: "), tx.inline("space")), F.when(F.size("ancestors") > 0, F.concat(F.lit("Path: "), tx.inline(F.array_join("ancestors", " > ")))), F.concat(F.lit("Version "), F.col("version").cast("string")), F.concat(F.lit("by "), tx.inline("updated_by")), F.concat(F.lit("Updated "), F.date_format("updated", "yyyy-MM-dd")))
    url = F.when(F.coalesce("space", F.lit("")) == "", F.concat(F.lit(f"{site}/wiki/pages/viewpage.action?pageId="), "page_id")).otherwise(F.concat(F.lit(f"{site}/wiki/spaces/"), "space", F.lit("/pages/"), "page_id"))
    quote = F.concat_ws("\n", F.concat(F.lit("> "), facts), F.concat(F.lit("> Pulled from "), url, F.lit(" on "), F.date_format(pulled_at, "yyyy-MM-dd HH:mm"), F.lit(" UTC.")))
    body = F.coalesce(F.nullif(F.trim(_markdown("html")), F.lit("")), F.lit("_(no content)_"))
    p = pages_.filter("type = 'page'")
    if comments is None:
        p = p.withColumn("_comments", F.lit(None).cast("string"))
    else:
        anchor = tx.inline(F.replace("anchor", F.lit('"'), F.lit("'")))
        short = F.when(F.length(anchor) > 160, F.concat(F.substring(anchor, 1, 157), F.lit("…"))).otherwise(anchor)
        head = F.concat(F.when(F.col("inline"), "## Inline comment by ").otherwise("## Comment by "), tx.inline(F.coalesce("author", F.lit("Unknown"))), F.lit(", "), _when(F.col("created"), "yyyy-MM-dd", "unknown date"), F.when(F.col("inline") & (F.lower("resolution") == "resolved"), " (resolved)").otherwise(""))
        text = F.concat_ws("\n\n", head, F.when(F.col("inline") & (anchor != ""), F.concat(F.lit('> On: "'), short, F.lit('"'))), F.coalesce(F.nullif(tx.escape_headings(F.trim(_markdown("html"))), F.lit("")), F.lit("_(no text)_")))
        c = comments.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created", text.alias("t")))), lambda x: x["t"]), "\n\n").alias("_comments"))
        p = p.join(c, "page_id", "left")
    md = F.concat_ws("\n\n", F.concat(F.lit("# "), tx.inline("title")), quote, body, "_comments")
    return p.select(tx.page_key("page_id").alias("source_path"), "title", md.alias("markdown"), F.coalesce("updated", pulled_at).alias("source_modified_at"), F.lit(project).alias("project"), F.lit("Confluence").alias("format"))


def parse_seed(text: str, space: str | None = None) -> tuple[str, str] | None:
    """(kind, id) of what a crawl starts from: a page, a folder or a whole space; a space given apart wins."""
    import re

    if (space or "").strip():
        return "space", space.strip()
    s = (text or "").strip()
    if s.isdigit():
        return "page", s
    for kind, pattern in (("page", r"/pages/(\d+)"), ("folder", r"/folder/(\d+)"), ("space", r"/spaces/([^/?#]+)")):
        if m := re.search(pattern, s):
            return kind, m[1]
    return None

"""Bounded crawls of link graphs, change detection of monitored sets, and reconciliation of files.

A crawl is a breadth-first walk over edges: each level is a join of the frontier with the edges, an anti-join with what was
visited, and a table written for the next level. The walk's order is kept as (depth, position), so a budget cuts the same
nodes on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.session import materialize


#: Rows that one task may order.
ONE_TASK = 100_000


def neighbour_edges(issues: DataFrame, known_projects: DataFrame, seeds: DataFrame) -> DataFrame:
    """(src, dst, rel, pos) of tickets: links, parent, subtasks, children, and, of seeds only, mentions of real projects' keys.

    ``issues``: (key, parent, links ARRAY, subtasks ARRAY, text).
    """
    k = F.upper("key").alias("src")
    links = issues.select(k, F.posexplode("links").alias("pos", "dst")).withColumn("rel", F.lit("link"))
    parent = issues.filter("parent IS NOT NULL").select(k, F.lit(10_000).alias("pos"), F.col("parent").alias("dst"), F.lit("parent").alias("rel"))
    subs = issues.select(k, F.posexplode("subtasks").alias("pos", "dst")).withColumn("rel", F.lit("subtask")).withColumn("pos", F.col("pos") + 20_000)
    kids = issues.filter("parent IS NOT NULL").select(F.upper("parent").alias("src"), F.lit(30_000).alias("pos"), F.col("key").alias("dst"), F.lit("child").alias("rel"))
    said = issues.join(seeds.select(F.upper("key").alias("_s")).distinct(), F.upper("key") == F.col("_s"), "left_semi").select(k, F.posexplode(tx.mentions("text")).alias("pos", "dst")).withColumn("rel", F.lit("mention")).withColumn("pos", F.col("pos") + 40_000)
    said = said.withColumn("_p", tx.key_project("dst")).join(known_projects.select(F.upper("project_key").alias("_p")).distinct(), "_p", "left_semi").drop("_p")
    cols = ["src", F.upper("dst").alias("dst"), "rel", "pos"]
    every = links.select(cols).unionByName(parent.select(cols)).unionByName(subs.select(cols)).unionByName(kids.select(cols)).unionByName(said.select(cols))
    return every.filter("dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.min_by("rel", "pos").alias("rel"), F.min("pos").alias("pos"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows numbered from 1 in an order: sorted by ranges, counted per range, and numbered within each; up to ONE_TASK rows by one window."""
    df = materialize(df, "to-number")
    if df.count() <= ONE_TASK:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    parts = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    place = F.shiftright("_at", 33)
    d = parts.withColumns({"_part": place, "_in": F.col("_at") - F.shiftleft(place, 33)})
    counts = {r._part: r.n for r in d.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one row per range
    before, rows = 0, []
    for p in sorted(counts):
        rows.append((p, before))
        before += counts[p]
    offsets = df.sparkSession.createDataFrame(rows or [(0, 0)], "_part long, _before long")
    return d.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_in") + 1).select(*df.columns, name)


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int, budget: int | None = None, existing: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """((id, depth, position, via, skipped) in order of discovery, accounting).

    ``edges``: (src, dst) and optionally pos; ``seeds``: (id) and optionally pos. Ids in ``existing`` can be fetched; others are skipped
    and don't count against the budget. Nodes at ``max_depth`` are kept but not expanded. Null ids take no part.
    """
    spark = edges.sparkSession
    e = edges.filter("src IS NOT NULL AND dst IS NOT NULL")
    e = e.select("src", "dst", *(["pos"] if "pos" in edges.columns else [F.lit(0).alias("pos")]))
    first = seeds.filter("id IS NOT NULL").groupBy("id").agg(F.min("pos" if "pos" in seeds.columns else "id").alias("_o"))
    real = None if existing is None else existing.select("id").distinct().withColumn("_real", F.lit(True))

    def placed(df: DataFrame, depth: int) -> DataFrame:
        d = df.withColumn("depth", F.lit(depth))
        d = d.withColumn("skipped", F.lit(False)) if real is None else d.join(real, "id", "left").withColumn("skipped", F.col("_real").isNull()).drop("_real")
        return numbered(d, ["_o", "id"], "position").select("id", "depth", "position", "via", "skipped")

    level = materialize(placed(first.withColumn("via", F.lit(None).cast(first.schema["id"].dataType)), 0), "crawl")
    seen, used = level, level.filter("NOT skipped").count()
    for depth in range(1, max_depth + 1):
        if budget is not None and used >= budget:
            break
        out = level.filter("NOT skipped").select(F.col("id").alias("src"), F.col("position").alias("_p"))
        found = e.join(out, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("_p", "pos")).alias("_o"), F.min_by("src", F.struct("_p", "pos")).alias("via"))
        fresh = found.join(seen.select("id"), "id", "left_anti")
        level = materialize(placed(fresh, depth), "crawl")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
        used += level.filter("NOT skipped").count()
    counts = seen.agg(F.count("*").alias("discovered"), F.count_if("skipped").alias("skipped")).first()
    ranked = seen
    if budget is not None:  # whole levels while they fit; of the level where the budget ends, its first nodes
        per = {r.depth: r.n for r in seen.filter("NOT skipped").groupBy("depth").agg(F.count("*").alias("n")).collect()}  # one row per level
        left, limits = budget, []
        for depth in sorted(per):
            limits.append((depth, max(0, left)))
            left -= per[depth]
        room = spark.createDataFrame(limits or [(0, budget)], "depth int, _room long")
        cut = [x for x, r in limits if r < per[x]][:1]
        fits = seen.join(F.broadcast(room), "depth", "left")
        whole = fits.filter(F.col("skipped") | (F.col("depth") < (cut[0] if cut else 2**31 - 1)))
        part = numbered(fits.filter(~F.col("skipped") & (F.col("depth") == (cut[0] if cut else -1))), ["position"], "_n").filter(F.col("_n") <= F.col("_room"))
        ranked = whole.select(seen.columns).unionByName(part.select(seen.columns))
    kept = min(used, budget) if budget is not None else used
    return ranked, {"discovered": counts.discovered, "skipped": counts.skipped, "nodes": kept, "dropped": max(0, counts.discovered - kept - counts.skipped), "budget_hit": budget is not None and used >= budget}


def scope(pages: DataFrame, seed: Column) -> DataFrame:
    """Pages that are the seed or lie below it: (page_id, ancestor_ids)."""
    return pages.filter((F.col("page_id") == seed) | F.array_contains("ancestor_ids", seed))


def closure(links: DataFrame) -> DataFrame:
    """(id, up): of links (id, up) all pairs of a node and what lies above it, through any number of links. Cycles end where no pair is new.

    Each round doubles the length of the ways that are known, and is written for the next.
    """
    key = ["id", "up"]
    known = fresh = materialize(links.select(key).filter("id IS NOT NULL AND up IS NOT NULL").distinct(), "closure")
    while not fresh.isEmpty():
        step = fresh.join(known.select(F.col("id").alias("up"), F.col("up").alias("_up")), "up").select("id", F.col("_up").alias("up"))
        back = known.join(fresh.select(F.col("id").alias("up"), F.col("up").alias("_up")), "up").select("id", F.col("_up").alias("up"))
        fresh = materialize(step.unionByName(back).distinct().join(known, key, "left_anti"), "closure")
        known = known.unionByName(fresh)
    return known


def tree(nodes: DataFrame) -> DataFrame:
    """(id, parent_id, is_root): a parent outside of the run, or the node itself, makes a root."""
    have = nodes.select(F.col("id").alias("parent_id")).distinct().withColumn("_in", F.lit(True))
    d = nodes.join(have, "parent_id", "left")
    root = F.col("_in").isNull() | F.col("parent_id").eqNullSafe(F.col("id"))
    return d.select("id", F.when(~root, F.col("parent_id")).alias("parent_id"), root.alias("is_root"))


def changed_stamps(stored: DataFrame, live: DataFrame) -> DataFrame:
    """(key, stamp): monitored keys whose live stamp is known and later than the stored one, or newly known. Absent keys are unchanged."""
    s = stored.select("key", F.col("stamp").alias("_old"))
    return live.filter("stamp IS NOT NULL").join(s, "key").filter(F.col("_old").isNull() | (F.col("stamp") > F.col("_old"))).select("key", "stamp")


def changed_versions(stored: DataFrame, live: DataFrame) -> DataFrame:
    s = stored.select("key", F.col("version").alias("_old"))
    return live.join(s, "key").filter(F.col("version") > F.col("_old")).select("key", "version")


def merged(stored: DataFrame, changed: DataFrame, key: str = "key") -> DataFrame:
    """The stored set with the changed rows in place of theirs, and new ones added."""
    return stored.join(changed.select(key), key, "left_anti").unionByName(changed.select(*stored.columns))


def reconcile(disk: DataFrame, manifest: DataFrame) -> DataFrame:
    """(source_path, action): upsert for new or changed files, delete for vanished ones, skip for the rest. Both sides: (source_path, mtime, length)."""
    d = disk.select("source_path", F.col("mtime").alias("_m"), F.col("length").alias("_l"), F.lit(True).alias("_d"))
    m = manifest.select("source_path", F.col("mtime").alias("_mm"), F.col("length").alias("_ml"), F.lit(True).alias("_k"))
    same = F.col("_m").eqNullSafe(F.col("_mm")) & F.col("_l").eqNullSafe(F.col("_ml"))
    action = F.when(F.col("_d").isNull(), "delete").when(F.col("_k").isNull() | ~same, "upsert").otherwise("skip")
    return d.join(m, "source_path", "full_outer").select("source_path", action.alias("action"))

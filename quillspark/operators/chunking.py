"""Heading-aware chunking of markdown, and reassembly of documents from chunks.

A document's structure (fences, headings, breadcrumbs, sizes) is a scan in which each step depends on the one before,
so it runs as an Arrow batch function over whole texts: one narrow stage, no shuffle. Lengths are in UTF-16 units.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as tx

MAX_CHARS, OVERLAP_CHARS = 1600, 200
_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
_RULE = re.compile(r"^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$")


def units(s: str) -> int:
    """Length in UTF-16 code units."""
    return len(s) if s.isascii() else len(s.encode("utf-16-le")) // 2


def sections(markdown: str, title: str | None) -> Iterator[tuple[str, str]]:
    """(breadcrumb, body) of every section that stays: a heading over deeper ones only, and an empty preamble, are left out."""
    found: list[tuple[int, str, list[str]]] = [(0, "", [])]
    fenced = False
    for line in markdown.replace("\r\n", "\n").split("\n"):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        m = None if fenced else _HEADING.match(line)
        if m:
            found.append((len(m[1]), m[2], []))
        else:
            found[-1][2].append(line)
    trail: list[tuple[int, str]] = []
    for k, (level, heading, lines) in enumerate(found):
        if level:
            trail = [t for t in trail if t[0] < level] + [(level, heading)]
        body = "\n".join(lines).strip()
        deeper_next = k + 1 < len(found) and found[k + 1][0] > level
        if body or (level and not deeper_next):
            yield (" > ".join(h for _, h in trail) if level else title or ""), body


def _pack(parts: list[str], most: int) -> list[str]:
    """Lines joined into blocks of at most ``most`` units; a longer single line stays whole."""
    out: list[str] = []
    for p in parts:
        if out and units(out[-1]) + 1 + units(p) <= most:
            out[-1] += "\n" + p
        else:
            out.append(p)
    return out


def _cut_block(block: str, most: int) -> list[str]:
    """A block over the limit: a pipe table by rows under its repeated head, anything else by lines."""
    lines = block.split("\n")
    if len(lines) > 1 and lines[0].lstrip().startswith("|") and _RULE.match(lines[1]):
        head = "\n".join(lines[:2])
        rows = [r for r in lines[2:] if r.strip()]
        room = most - units(head) - 1
        return [f"{head}\n{p}" for p in _pack(rows, room)] or [head]
    return _pack(lines, most)


def windows(body: str, most: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
    """A body within the limit is one window; else paragraphs are packed, and short last ones are repeated in the next window."""
    if units(body) <= most:
        return [body]
    paragraphs = [p for p in map(str.strip, re.split(r"\n{2,}", body)) if p]
    parts = [x for p in paragraphs for x in (_cut_block(p, most) if units(p) > most else [p])]
    out: list[list[str]] = []
    cur: list[str] = []
    size = 0
    for p in parts:
        if size and size + units(p) > most:
            out.append(cur)
            keep = 0
            carried = 0
            for q in reversed(cur):
                if units(q) > overlap or (keep and carried + units(q) > overlap):
                    break
                keep += 1
                carried += units(q)
            cur = cur[len(cur) - keep :]
            size = sum(units(q) + 2 for q in cur)
        cur.append(p)
        size += units(p) + 2
    return ["\n\n".join(w) for w in [*out, cur] if w]


def chunk_markdown(markdown: str | None, title: str | None, most: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> list[tuple[str, str]]:
    """(heading_path, text) of a document's chunks in order. Null gives none."""
    return [(crumb, w) for crumb, body in sections(markdown or "", title) for w in windows(body, most, overlap)]


def chunk_documents(docs: DataFrame, most: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Documents (source_path, markdown, title, source_modified_at, project) to chunk rows with fingerprints; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, no, head, text = [], [], [], []
            for i, (md, title) in enumerate(zip(b.column("markdown").to_pylist(), b.column("title").to_pylist())):
                for k, (h, t) in enumerate(chunk_markdown(md, title, most, overlap)):
                    at.append(i)
                    no.append(k)
                    head.append(h)
                    text.append(t)
            take = pa.array(at, pa.int64())
            names = ["project", "source_path", "title", "source_modified_at"]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in names), pa.array(no, pa.int32()), pa.array(head, pa.string()), pa.array(text, pa.string())], [*names, "ordinal", "heading_path", "text"])

    src = docs.select("project", "source_path", "title", "source_modified_at", "markdown")
    schema = "project string, source_path string, title string, source_modified_at timestamp, ordinal int, heading_path string, text string"
    return src.mapInArrow(run, schema).withColumns({"content": tx.with_breadcrumb("heading_path", "text"), "content_hash": tx.content_hash("text"), "line_hashes": tx.line_hashes("text")})


def reassembled(parts: Column, title: Column) -> Column:
    """Markdown of ordered ARRAY<STRUCT<heading_path, text>>: the title once, a heading where it changes, and the texts."""
    blank = F.lit("")
    # the pieces are listed and joined once at the end, so that no text is copied for each piece after it
    step = lambda acc, x: F.struct(
        F.concat(
            acc["md"],
            F.array(
                F.when((x["heading_path"] != "") & ~x["heading_path"].eqNullSafe(acc["last"]) & ~x["heading_path"].eqNullSafe(title), F.concat(F.lit("## "), x["heading_path"], F.lit("\n\n"))).otherwise(blank),
                F.when(x["text"] != "", F.concat(F.regexp_replace(x["text"], r"\s+$", ""), F.lit("\n\n"))).otherwise(blank),
            ),
        ).alias("md"),
        F.when(x["heading_path"] != "", x["heading_path"]).otherwise(acc["last"]).alias("last"),
    )
    start = F.struct(F.array(F.when(title.isNotNull() & (title != ""), F.concat(F.lit("# "), title, F.lit("\n\n"))).otherwise(blank)).alias("md"), F.lit(None).cast("string").alias("last"))
    return F.concat(F.regexp_replace(F.array_join(F.aggregate(parts, start, step)["md"], ""), r"\s+$", ""), F.lit("\n"))


def reassemble(chunks: DataFrame) -> DataFrame:
    """(source_path, title, project, chunks, markdown): one row per document, from its chunks in order."""
    part = F.struct("ordinal", F.coalesce("heading_path", F.lit("")).alias("heading_path"), F.coalesce("text", F.lit("")).alias("text"))
    d = chunks.groupBy("source_path").agg(F.min_by("title", "ordinal").alias("title"), F.min_by("project", "ordinal").alias("project"), F.count("*").alias("chunks"), F.array_sort(F.collect_list(part)).alias("_parts"))
    return d.select("source_path", "title", "project", "chunks", reassembled(F.col("_parts"), F.col("title")).alias("markdown"))

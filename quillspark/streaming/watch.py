"""Following changes with Structured Streaming: debounced events, reconciliation, ingestion per batch, polling of monitored sets."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.operators.crawl import changed_stamps, changed_versions, merged
from quillspark.operators.store import Table
from quillspark.session import materialize
from quillspark.sources.convert import EXTENSIONS
from quillspark.sources.state import normalized_folder

QUIET, QUIET_MS, TICK, LATE = "500 milliseconds", 500, "250 milliseconds", "10 minutes"
#: Held while a watch writes to the store.
GATE = threading.Lock()
#: Verbs of the log lines of a watch.
EVENTS = ("started", "indexed", "removed", "skipped", "failed", "reconciled", "retrying", "stopped")


def file_events(changes: DataFrame) -> DataFrame:
    """(path, kind, ts) of raw changes (path, old_path, change, ts): a rename is a delete and an upsert; other file types are left out."""
    kind = F.when(F.col("change") == "deleted", "delete").otherwise("upsert")
    events = F.when(F.col("change") == "renamed", F.array(F.struct(F.col("old_path").alias("path"), F.lit("delete").alias("kind")), F.struct(F.col("path").alias("path"), F.lit("upsert").alias("kind")))).otherwise(F.array(F.struct(F.col("path").alias("path"), kind.alias("kind"))))
    e = changes.select(F.explode(events).alias("e"), "ts").select("e.path", "e.kind", "ts")
    return e.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*EXTENSIONS))


def debounced(events: DataFrame, key: str = "path", quiet: str = QUIET, late: str = LATE) -> DataFrame:
    """(key, kind, first_ts, last_ts, events): per key the last event of each burst that a quiet time ends, by the events' own time.

    Works on a table, and on a recorded stream: there a watermark bounds the state, events later than ``late`` are dropped, and a burst is given out
    when the watermark has passed its end. A live stream goes through ``settled``, whose clock runs without further events.
    """
    e = events.withWatermark("ts", late) if events.isStreaming else events
    burst = e.groupBy(F.session_window("ts", quiet), key)
    return burst.agg(F.max_by("kind", "ts").alias("kind"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events")).drop("session_window")


_SETTLED = "path string, kind string, first_ts timestamp, last_ts timestamp, events long"


def _settle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, quiet_ms: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        kind, first, last, n = state.get
        state.remove()
        utc = lambda us: pd.Timestamp(us, unit="us", tz="UTC")
        yield pd.DataFrame({"path": [key[0]], "kind": [kind], "first_ts": [utc(first)], "last_ts": [utc(last)], "events": [n]})
        return
    kind, first, last, n = state.get if state.exists else (None, 2**62, -(2**62), 0)
    for f in frames:
        if len(f):
            at = f["us"].to_numpy()
            newest = len(at) - 1 - int(at[::-1].argmax())  # of equal times the one that came last
            if at[newest] >= last:
                kind, last = f["kind"].iloc[newest], int(at[newest])
            first, n = min(first, int(at.min())), n + len(f)
    state.update((kind, first, last, n))
    state.setTimeoutDuration(quiet_ms)  # every event starts the quiet time again


def settled(events: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """(path, kind, first_ts, last_ts, events) of a live stream: a path's last event once the path has been quiet for so long by the clock.

    The state is one small row for each path that isn't quiet yet. Event times only order the events of a path.
    """
    def run(key, frames, state):
        yield from _settle(key, frames, state, quiet_ms)

    e = events.select("path", "kind", F.unix_micros("ts").alias("us"))
    return e.groupBy("path").applyInPandasWithState(run, _SETTLED, "kind string, first long, last long, events long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def watch(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, tick: str = TICK, quiet_ms: int = QUIET_MS) -> DataStreamWriter:
    """A writer that hands each tick's settled events to ``apply``; one batch at a time, and one writer at a time (GATE), so nothing is ingested twice at once."""

    def gated(batch: DataFrame, batch_id: int) -> None:
        with GATE:
            apply(batch, batch_id)

    return settled(file_events(changes), quiet_ms).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=tick).foreachBatch(gated)


def stop(query: StreamingQuery, most_seconds: float = 60) -> bool:
    """The final flush: stops a watch once its last events have settled and been applied; whether they were in time."""
    end, quiet = time.monotonic() + most_seconds, 0
    last = -1
    while time.monotonic() < end and query.isActive and quiet < 2:
        time.sleep(0.1)
        p = query.lastProgress
        if p and p["batchId"] != last:
            last = p["batchId"]
            left = sum(o["numRowsTotal"] for o in p["stateOperators"])
            quiet = quiet + 1 if p["numInputRows"] == 0 and left == 0 else 0
    query.stop()
    return quiet >= 2


def targets(named: list[tuple[str, str]], manifests: list[dict]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(watched, missing) as (folder, project): the folders that are named, else those of all manifests; each once, in any case of its name."""
    wanted = named or [(m["folder"], m["project"]) for m in manifests]
    once = list({(normalized_folder(f), p): (f, p) for f, p in reversed(wanted)}.values())[::-1]
    return [t for t in once if os.path.isdir(t[0])], [t for t in once if not os.path.isdir(t[0])]


class Watcher:
    """Follows folders by looking at them every tick: the first look reconciles with the manifest, later ones apply what has settled.

    ``index`` (folder, project) brings the store up to what lies in a folder and advances the manifest for what went well; it is called under GATE.
    A folder is indexed when its listing has changed and then stayed the same for the quiet time; ``stop`` looks once more without waiting.
    """

    def __init__(self, index: Callable[[str, str], object], watched: list[tuple[str, str]], quiet: float = QUIET_MS / 1000, log: Callable[[str, str], None] = lambda kind, path: None):
        self.index, self.watched, self.quiet, self.log = index, watched, quiet, log
        self.done: dict[tuple[str, str], dict] = {}
        self.seen: dict[tuple[str, str], tuple[dict, float]] = {}

    def _listing(self, folder: str) -> dict:
        out = {}
        for at, _, names in os.walk(folder):
            for n in names:
                if n.rsplit(".", 1)[-1].lower() in EXTENSIONS:
                    try:
                        st = os.stat(os.path.join(at, n))
                        out[os.path.join(at, n)] = (st.st_mtime_ns, st.st_size)
                    except FileNotFoundError:
                        continue
        return out

    def _bring(self, t: tuple[str, str], listing: dict, kind: str) -> None:
        try:
            with GATE:
                if retried(lambda: self.index(*t)):
                    self.done[t] = listing
                    self.log(kind, t[0])
        except Exception:  # noqa: BLE001  a folder that fails is tried again when it changes; the others go on
            self.done[t] = listing
            self.log("failed", t[0])

    def start(self) -> None:
        for t in self.watched:
            self.log("started", t[0])
            self._bring(t, self._listing(t[0]), "reconciled")

    def tick(self, flush: bool = False) -> int:
        """Looks at every folder; the number of folders that were indexed."""
        n, now = 0, time.monotonic()
        for t in self.watched:
            listing = self._listing(t[0])
            if listing == self.done.get(t):
                self.seen.pop(t, None)
                continue
            if t not in self.seen or self.seen[t][0] != listing:
                self.seen[t] = (listing, now)
            if flush or now - self.seen[t][1] >= self.quiet:
                self._bring(t, listing, "indexed")
                n += 1
        return n

    def run(self, until: Callable[[], bool], tick: float = 0.25) -> None:
        self.start()
        while not until():
            self.tick()
            time.sleep(tick)
        self.stop()

    def stop(self) -> None:
        self.tick(flush=True)
        for t in self.watched:
            self.log("stopped", t[0])


def ingest_batch(chunks: Table, convert: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """An ``apply`` that converts and replaces upserted documents and deletes removed ones, then makes both visible at once.

    A file that has vanished by then counts as deleted; one that can't be converted keeps its old rows.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        b = materialize(batch, "watch-batch")
        if b.isEmpty():
            return
        new = materialize(convert(b.filter("kind = 'upsert'").select("path")), "watch-documents")
        gone = b.filter("kind = 'delete'").select(F.col("path").alias("source_path")).join(new.select("source_path"), "source_path", "left_anti")
        retried(lambda: chunks.replace(new.select(*chunks.schema.names), also_gone=gone))

    return apply


def retried(action: Callable[[], None], attempts: int = 4, pause: float = 0.15) -> bool:
    """Runs an action again where a file is locked, waiting longer each time; False where it has vanished."""
    for n in range(1, attempts + 1):
        try:
            action()
            return True
        except FileNotFoundError:
            return False
        except PermissionError:
            if n == attempts:
                raise
            time.sleep(pause * n)
    return False


def poll(monitored: DataFrame, live: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(changed, the monitored set after it) by ``stamp`` or ``version``."""
    changed = (changed_stamps if by == "stamp" else changed_versions)(monitored, live)
    cols = [c for c in monitored.columns if c not in changed.columns]
    rest = monitored.select("key", *cols)
    return changed, merged(monitored, changed.join(rest, "key").select(*monitored.columns))


def poll_interval(seconds: int | None) -> int:
    return max(30, 300 if seconds is None else seconds)


def log_line(at: Column, kind: Column, path: Column) -> Column:
    return F.format_string("%s  %-10s %s", F.date_format(at, "HH:mm:ss"), kind, path)


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Event-time counts per window and type; an extension of the engine."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "events", "total")

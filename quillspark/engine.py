"""The public surface: one object over a session and a folder, with the engine's verbs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import catalog, chunking, contradictions, crawl, gateway, notes, retrieval, store
from quillspark.session import materialize, tune
from quillspark.sources import convert, state
from quillspark.streaming import watch


class Engine:
    """Ingest, search, catalog, contradictions, notes, and SQL over one store."""

    def __init__(self, spark: SparkSession, root: str, embed=None, state_root: str | None = None):
        self.spark, self.root, self.embed, self.state_root = tune(spark), root.rstrip("/"), embed, state_root
        make = lambda name, schema: store.Table(spark, f"{self.root}/{name}", schema)
        self.chunks, self.notes, self.pairs, self.manifest = (make(n, s) for n, s in (("chunks", store.CHUNKS), ("notes", store.NOTES), ("pairs", store.PAIRS), ("manifest", store.MANIFEST)))
        self.gateway = gateway.Gateway(spark)
        self.rerank_failed = False

    # -- writing

    def prepare(self, documents: DataFrame) -> DataFrame:
        """Chunk rows, ready to store, of documents (source_path, markdown, title, source_modified_at, project)."""
        c = chunking.chunk_documents(documents.withColumn("source_path", tx.normalize_path("source_path"))).withColumn("indexed_at", F.current_timestamp())
        return retrieval.embed(c, "content", embedder=self.embed) if self.embed else c.withColumn("content_vector", F.lit(None).cast("array<float>"))

    def index(self, documents: DataFrame) -> int:
        """Replaces documents by their paths; the number of chunks written. A document without chunks is removed; open pairs of either go."""
        rows = materialize(self.prepare(documents), "index-chunks")
        paths = materialize(documents.select(tx.normalize_path("source_path").alias("source_path")).distinct(), "index-paths")
        self.chunks.replace(rows, also_gone=paths)
        self._drop_pairs(paths, only_open=True)
        return rows.count()

    def _drop_pairs(self, paths: DataFrame, only_open: bool) -> None:
        """Removes the pairs with a side in one of the documents."""
        sides = self.pairs.read().select("pair_id", "status", F.explode(F.array("a_path", "b_path")).alias("source_path")).join(paths, "source_path", "left_semi")
        gone = sides.filter(~F.coalesce("status", F.lit("open")).isin(*contradictions.CLOSED)) if only_open else sides
        ids = gone.select("pair_id").distinct()
        if not ids.isEmpty():
            self.pairs.replace(self.pairs.read().limit(0), also_gone=ids)

    def index_folder(self, folder: str, project: str = "default") -> DataFrame:
        """Brings the store up to a folder; a summary by format: files that went well, failed, and chunks.

        Files with the manifest's date and size are passed over, and their content isn't read. Vanished files are removed with their pairs. The
        manifest only advances for what went well.
        """
        home = folder.strip().replace("\\", "/").rstrip("/")
        here = (F.col("project") == project) & (F.lower("folder") == state.normalized_folder(folder))
        files = convert.scan_folder(self.spark, folder)
        disk = files.select(tx.normalize_path("path").alias("source_path"), F.col("modificationTime").alias("mtime"), "length")
        known = self.manifest.read().filter(here)
        actions = materialize(crawl.reconcile(disk, known).join(disk, "source_path", "left"), "folder-actions")
        todo, gone = actions.filter("action = 'upsert'"), actions.filter("action = 'delete'").select("source_path")
        new = files.join(todo.select(F.col("source_path").alias("_p")), tx.normalize_path("path") == F.col("_p"), "left_semi")
        made = materialize(convert.convert_files(new), "folder-documents")
        good = made.filter("error IS NULL").withColumn("project", F.lit(project))
        if not good.isEmpty():
            self.index(good)
        if not gone.isEmpty():
            self.chunks.replace(self.chunks.read().limit(0), also_gone=gone)
            self._drop_pairs(gone, only_open=False)
        done = todo.join(good.select(tx.normalize_path("source_path").alias("source_path")), "source_path", "left_semi")
        if not actions.filter("action <> 'skip'").isEmpty():
            row = done.select(F.lit(project).alias("project"), F.lit(home).alias("folder"), "source_path", "mtime", "length")
            left = self.manifest.read().filter(~here).unionByName(known.join(actions.filter("action <> 'skip'").select("source_path"), "source_path", "left_anti").select(*row.columns))
            self.manifest.write(materialize(left.unionByName(row), "folder-manifest"))
        chunks = self.chunks.read().groupBy("source_path").agg(F.count("*").alias("n"))
        return made.withColumn("source_path", tx.normalize_path("source_path")).join(chunks, "source_path", "left").groupBy("format").agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.sum(F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0))).otherwise(0)).alias("chunks"))

    @staticmethod
    def exit_code(summary: DataFrame) -> int:
        """1 where files failed and none went well, else 0."""
        n = summary.agg(F.coalesce(F.sum("ok"), F.lit(0)), F.coalesce(F.sum("failed"), F.lit(0))).first()
        return int(n[0] == 0 and n[1] > 0)

    def watcher(self, folders: list[tuple[str, str]] | None = None, **options) -> watch.Watcher:
        """A watch of (folder, project), or of every folder that was indexed before."""
        known = [r.asDict() for r in self.manifest.read().select("folder", "project").distinct().collect()]  # one row per folder
        return watch.Watcher(self.index_folder, watch.targets(folders or [], known)[0], **options)

    def remove(self, path: str) -> int:
        key = self._key(path)
        contradictions.remove_for_path(self.pairs, key, only_open=False)
        return self.chunks.delete(F.col("source_path") == key)

    def _key(self, path: str) -> str:
        return self.spark.range(1).select(tx.normalize_path(F.lit(path))).first()[0]

    def purge(self, project: str) -> dict[str, int]:
        """Deletes a project's rows of every table, and its manifests, monitored sets and connector settings; how many of each there were."""
        n = store.purge({"chunks": self.chunks, "notes": self.notes, "pairs": self.pairs, "manifest": self.manifest}, project)
        if self.state_root:
            n["manifest files"] = state.Manifests(self.state_root).delete(project)
            n["settings"] = sum(state.Settings(self.state_root, kind).delete(project) for kind in ("monitor", "connector"))
        return n

    def detect(self) -> int:
        """Nominates pairs over all chunks; those closed stay closed, open ones are replaced. The number of open pairs."""
        have = self.pairs.read()
        ids = self.chunks.read().withColumn("chunk_id", F.xxhash64("source_path", "ordinal"))
        new = contradictions.nominate(ids, contradictions.closed_pairs(have)).withColumn("detected_at", F.current_timestamp())
        self.pairs.write(store.conform(new, store.PAIRS).unionByName(have.filter(F.col("status").isin(*contradictions.CLOSED))))
        return self.pairs.read().filter("status = 'open'").count()

    # -- reading

    def search(self, query: str, k: int = 5, project: str | None = None, scorer=None) -> DataFrame:
        """Hits and notes with annotations: fused where there is an embedder, by words without; reranked where there is a scorer."""
        k = min(25, max(1, k))
        c = catalog.scoped(self.chunks.read(), project).withColumn("id", F.concat_ws("#", "source_path", "ordinal"))
        fetch = retrieval.fetch_size(k, scorer is not None)
        vector = self._vector(query)
        try:  # the few hits are made here, so that a failure shows here
            found = materialize(retrieval.hybrid(c, "id", query, vector, fetch), "hits")
        except Exception:  # noqa: BLE001  a search by vector that fails falls back to words, for this query
            found = retrieval.top(retrieval.lexical(c, "id", query), fetch)
        docs = found.join(c, "id").select(F.lit("document").alias("origin"), F.col("source_path").alias("path"), "heading_path", "content", "project", F.col("source_modified_at").alias("modified_at"), "score")
        n = catalog.scoped(self.notes.read(), project)
        try:
            pool = materialize(notes.as_hits(n, notes.search(n, query, vector)), "note-hits")
        except Exception:  # noqa: BLE001  without its notes a search still answers
            pool = docs.limit(0)
        merged = notes.merge(docs, pool, k)
        if scorer is not None and not self.rerank_failed:
            both = docs.unionByName(pool)
            order = both.withColumn("id", F.concat_ws("#", "origin", "path", "heading_path", F.xxhash64("content"))).withColumn("position", -F.col("score"))
            try:
                merged = order.drop("score", "position").join(materialize(retrieval.rerank(order, scorer, k), "reranked"), "id").drop("id")
            except Exception:  # noqa: BLE001  a reranker that fails once stays off
                self.rerank_failed = True
        return notes.annotate(merged, n)

    def _vector(self, query: str) -> list[float] | None:
        if self.embed is None:
            return None
        try:
            return list(self.embed(query))
        except Exception:  # noqa: BLE001  a model that fails once stays off
            self.embed = None
            return None

    def sources(self, project: str | None = None) -> DataFrame:
        return catalog.list_sources(self.chunks.read().withColumn("chunk_id", F.col("ordinal")), project)

    def unscoped(self) -> DataFrame:
        """(project, documents): what a list over all projects shows in place of every source."""
        return self.chunks.read().groupBy("project").agg(F.countDistinct("source_path").alias("documents")).orderBy("project")

    def projects(self) -> DataFrame:
        return catalog.known_projects(self.chunks.read(), self.manifest.read())

    def ping(self) -> dict[str, int]:
        """The versions of the tables, without reading rows: that the store answers."""
        return {n: getattr(self, n).version() for n in ("chunks", "notes", "pairs", "manifest")}

    def databases(self) -> list[tuple[str, str]]:
        return self.gateway.listed()

    def connectors(self) -> dict[str, list[str]]:
        """Projects with stored monitored sets and connector settings."""
        return {k: state.Settings(self.state_root, k).listed() if self.state_root else [] for k in ("monitor", "connector")}

    def contradictions(self, limit: int = 20, project: str | None = None, include_closed: bool = False) -> DataFrame:
        """Pairs, newest detection first: from 1 to 50 of them."""
        return contradictions.listed(self.pairs.read(), include_closed, project).limit(min(50, max(1, limit)))

    def dismiss(self, pair_id: str) -> None:
        contradictions.set_status(self.pairs, pair_id, "dismissed")

    def list_notes(self, project: str | None = None) -> DataFrame:
        return notes.listed(self.notes.read(), project)

    def remove_note(self, note_id: str) -> int:
        return notes.remove(self.notes, note_id)

    def status(self) -> DataFrame:
        return catalog.project_status(self.chunks.read())

    def describe(self, project: str) -> dict[str, DataFrame]:
        c = catalog.scoped(self.chunks.read(), project)
        return {"kinds": catalog.source_kinds(c), "status": catalog.project_status(c), "contradictions": catalog.summary(catalog.scoped(self.pairs.read(), project)), "top": catalog.top_documents(c), "more": catalog.remaining_documents(c)}

    def document(self, path: str, around: int | None = None, radius: int = 2) -> DataFrame:
        d = catalog.find_document(self.chunks.read(), path)
        d = d if around is None else catalog.document_window(d, around, radius)
        return chunking.reassemble(d).withColumn("partial", F.lit(around is not None))

    def similar(self, path: str, k: int = 5) -> DataFrame | None:
        """Documents like one; null where it has no vectors, which is not the same as none being alike."""
        c = self.chunks.read().withColumn("chunk_id", F.xxhash64("source_path", "ordinal"))
        path = self._key(path)
        if c.filter((F.col("source_path") == path) & F.col("content_vector").isNotNull()).isEmpty():
            return None
        return retrieval.find_similar(c, path, min(25, max(1, k)))

    def add_note(self, text: str, project: str = "default", target: str | None = None, author: str = "") -> None:
        row = self.spark.createDataFrame([(project, text, target, author)], "project string, text string, target_path string, author string").withColumn("created_at", F.current_timestamp())
        notes.add(self.notes, retrieval.embed(row, "text", embedder=self.embed) if self.embed else row)

    def resolve(self, pair_id: str, note: str, author: str = "") -> None:
        """Resolves a pair with a note on its older side."""
        p = self.pairs.read().filter(F.col("pair_id") == pair_id).select("project", "b_path").first()
        if p is None:
            raise KeyError(pair_id)
        self.add_note(note, p.project, p.b_path, author)
        nid = self.notes.read().filter((F.col("project") == p.project) & (F.col("text") == note) & (F.col("target_path") == p.b_path)).select("note_id").first()
        contradictions.set_status(self.pairs, pair_id, "resolved", nid.note_id if nid else None)

    def save_document(self, folder: str, title: str, markdown: str, project: str, author: str) -> str:
        path, _ = state.save_document(folder, title, markdown, project, author)
        self.index(convert.convert_files(convert.scan_folder(self.spark, path)).filter("error IS NULL").withColumn("project", F.lit(project)))
        return path

    def query(self, sql: str, max_rows: int | None = None, source: str | None = None) -> gateway.Result:
        return self.gateway.query(sql, max_rows, source)

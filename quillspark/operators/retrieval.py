"""Lexical, vector and fused retrieval over the chunk table, with note merging, reranking and annotation.

Scoring is plans all the way: an inverted index is an explode and an aggregation, a query's terms are a filter that
comes before it, and top-k is a sort with a limit. One search has one query, so nothing here is a join of all with all;
``nearest_blocks`` answers a stated set of queries in blocks of matrix products.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions import vectors as vx
from quillspark.functions.analyzer import query_terms, tokens
from quillspark.session import materialize

K1, B = 1.2, 0.75
#: Fields of a search with their boosts; a row's score is that of its best field.
FIELDS = {"content": 1.0, "heading_path": 2.0, "title": 2.0}
WINDOW, STRIDE = 1000, 800


def term_counts(df: DataFrame, id_col: str, field: str) -> DataFrame:
    """(id, term, tf, dl): a posting per distinct term of a row. Rows without tokens have none."""
    d = df.select(F.col(id_col).alias("id"), tokens(F.col(field)).alias("_t"))
    return d.select("id", F.size("_t").alias("dl"), F.explode("_t").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").cast("long").alias("dl"))


def document_frequency(df: DataFrame, id_col: str, field: str) -> DataFrame:
    """(term, df, cf): rows and occurrences of each term. Rows and uses are summed before the shuffle, and no row's id is shuffled."""
    d = df.select(tokens(F.col(field)).alias("_t"))
    entry = lambda n: lambda t: F.struct(t.alias("term"), F.lit(n).alias("row"), F.lit(1 - n).alias("use"))
    each = d.select(F.explode(F.concat(F.transform(F.array_distinct("_t"), entry(1)), F.transform("_t", entry(0)))).alias("e"))
    return each.groupBy("e.term").agg(F.sum("e.row").alias("df"), F.sum("e.use").alias("cf"))


def postings(df: DataFrame, id_col: str, fields: list[str], query: str) -> DataFrame:
    """(field, id, term, tf, dl_sum, whole): the query's postings in each field, and per field one ``whole`` row with its number of rows and tokens.

    The one pass over the texts of a search: every field is tokenised once, the entries without an id fold into one row per field
    before the shuffle, and what remains, a few postings per row, is written once and read by the steps that need it.
    """
    terms = query_terms(query)
    d = df.select(F.col(id_col).alias("id"), *(tokens(F.col(f)).alias(f"_t{i}") for i, f in enumerate(fields)))
    none = F.lit(None).cast(d.schema["id"].dataType)

    def entries(i: int, f: str) -> Column:
        t = f"_t{i}"
        one = lambda key, term: F.struct(F.lit(f).alias("field"), key.alias("id"), term.alias("term"), F.size(t).alias("dl"))
        found = F.transform(F.filter(t, lambda x: x.isin(terms)), lambda x: one(F.col("id"), x))
        return F.when(F.size(t) > 0, F.concat(found, F.array(one(none, F.lit(""))))).otherwise(F.slice(found, 1, 0))

    every = F.concat(*(entries(i, f) for i, f in enumerate(fields)))
    counted = d.select(F.explode(every).alias("e")).groupBy("e.field", "e.id", "e.term").agg(F.count("*").alias("tf"), F.sum("e.dl").alias("dl_sum"))
    return materialize(counted.withColumn("whole", F.col("id").isNull() & (F.col("term") == "")), "postings")


def score(p: DataFrame) -> DataFrame:
    """(field, id, score) by BM25; the statistics of a field are over all rows that have tokens in it."""
    tf = p.filter("NOT whole").select("field", "id", "term", "tf", (F.col("dl_sum") / F.col("tf")).alias("dl"))
    sizes = p.filter("whole").select("field", F.col("tf").alias("docs"), (F.col("dl_sum") / F.col("tf")).alias("avgdl"))  # a row per field
    per_term = tf.groupBy("field", "term").agg(F.count("*").alias("df"))  # at most a row per field and query term
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return tf.join(F.broadcast(per_term), ["field", "term"]).join(F.broadcast(sizes), "field").groupBy("field", "id").agg(F.sum(weight).alias("score"))


def bm25(df: DataFrame, id_col: str, field: str, query: str) -> DataFrame:
    """(id, score) of the rows that hold a term of the query in a field."""
    return score(postings(df, id_col, [field], query)).select("id", "score")


def lexical(df: DataFrame, id_col: str, query: str, fields: dict[str, float] | None = None) -> DataFrame:
    """(id, score): the best field's boosted score."""
    boosts = fields or FIELDS
    boost = F.create_map(*(F.lit(x) for f, b in boosts.items() for x in (f, float(b))))
    return score(postings(df, id_col, list(boosts), query)).groupBy("id").agg(F.max(F.col("score") * F.try_element_at(boost, "field")).alias("score"))


def top(scored: DataFrame, k: int, score: str = "score", key: str = "id") -> DataFrame:
    return scored.orderBy(F.desc(score), key).limit(k)


def knn(df: DataFrame, id_col: str, vector_col: str, query: list[float], k: int) -> DataFrame:
    """(id, score): the k nearest rows by 1 / (1 + squared distance) of unit vectors. Filter by project before."""
    q = np.asarray(query, dtype=np.float64)
    q = q / max(1e-300, float(np.linalg.norm(q)))
    v = F.col(vector_col)
    lit = F.array(*[F.lit(float(x)) for x in q])
    cos = vx.dot(v, lit) / vx.norm(v)
    scored = df.filter(vx.usable(v) & (F.size(v) == len(q))).select(F.col(id_col).alias("id"), vx.score_of_cosine(cos).alias("score"))
    return top(scored, k)


def nearest_blocks(base: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "v", block: int = 2048) -> DataFrame:
    """(query_id, id, score): the k nearest other rows of every query row, by matrix products of blocks of rows.

    Both sides are gathered into blocks of a fixed number of rows; each task multiplies pairs of blocks and keeps k per
    query and block, so what is shuffled grows with the queries, not with the pairs compared.
    """

    def blocks(df: DataFrame, name: str) -> DataFrame:
        d = df.filter(vx.usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids: list[np.ndarray] = []
            rows: list[np.ndarray] = []
            have = 0

            def out(i: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([i], pa.list_(pa.int64())), pa.array([vx.unit_rows(x).astype(np.float64).tobytes()], pa.binary())], [f"{name}_ids", f"{name}_v"])

            for b in batches:
                if b.num_rows:
                    ids.append(np.asarray(b.column("id")))
                    rows.append(vx.matrix(b.column("v")))
                    have += b.num_rows
                while have >= block:
                    i, x = np.concatenate(ids), np.concatenate(rows)
                    yield out(i[:block], x[:block])
                    ids, rows, have = [i[block:]], [x[block:]], have - block
            if have:
                yield out(np.concatenate(ids), np.concatenate(rows))

        return d.mapInArrow(pack, f"{name}_ids array<long>, {name}_v binary")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                qi, bi = np.asarray(b.column("q_ids")[r].as_py()), np.asarray(b.column("b_ids")[r].as_py())
                q = np.frombuffer(b.column("q_v")[r].as_py()).reshape(len(qi), -1)
                x = np.frombuffer(b.column("b_v")[r].as_py()).reshape(len(bi), -1)
                s = q @ x.T
                s[qi[:, None] == bi[None, :]] = -np.inf
                order = np.argsort(bi, kind="stable")  # of equal scores the smaller ids stay
                at, c = vx.best_by_id(s[:, order], k)
                c = order[c]
                yield pa.RecordBatch.from_arrays([pa.array(qi[at]), pa.array(bi[c]), pa.array(1 / (3 - 2 * np.round(s[at, c], 12)))], ["query_id", "id", "score"])

    pairs = blocks(queries, "q").crossJoin(blocks(base, "b"))  # blocks of rows against blocks of rows
    found = pairs.mapInArrow(multiply, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def displayed(hits: DataFrame) -> DataFrame:
    """Hits as they are shown: the score to two places and, as ``source``, the file name of the path."""
    return hits.withColumns({"score": F.bround("score", 2), "source": F.element_at(F.split("path", r"[/\\\\]"), -1)})


def fetch_size(k: int, reranks: bool) -> int:
    """Hits to fetch: three times as many for a reranker, from 12 to 20."""
    return min(20, max(12, 3 * k)) if reranks else k


def knn_size(fetch: int) -> int:
    return min(100, max(25, 5 * fetch))


def minmax(scored: DataFrame, by: str | None = None) -> DataFrame:
    """Scores scaled to 0..1 within the result (or each group of it); where all are equal they are 1.0."""
    w = Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return scored.withColumn("score", F.when(hi == lo, 1.0).otherwise((F.col("score") - lo) / (hi - lo)))


def fuse(lex: DataFrame, sem: DataFrame, weight: float = 0.5) -> DataFrame:
    """(id, score): weighted mean of both results' scaled scores; a row that one result lacks has 0 there."""
    a, b = minmax(lex).withColumnRenamed("score", "_l"), minmax(sem).withColumnRenamed("score", "_s")
    return a.join(b, "id", "full_outer").select("id", (weight * F.coalesce("_l", F.lit(0.0)) + (1 - weight) * F.coalesce("_s", F.lit(0.0))).alias("score"))


def hybrid(df: DataFrame, id_col: str, query: str, vector: list[float] | None, fetch: int, vector_col: str = "content_vector") -> DataFrame:
    """(id, score) of a fused search; lexical alone without a query vector. Filter ``df`` by project before, so both halves see the filter."""
    lex = top(lexical(df, id_col, query), knn_size(fetch))
    if vector is None:
        return top(lex, fetch)
    return top(fuse(lex, knn(df, id_col, vector_col, vector, knn_size(fetch))), fetch)


def rerank_windows(hits: DataFrame) -> DataFrame:
    """(id, window_no, passage): a hit's content within WINDOW characters whole; else slices of its body under the repeated heading."""
    heading, content = F.coalesce("heading_path", F.lit("")), F.col("content")
    body = tx.strip_breadcrumb(content, heading)
    length = F.length(body)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((length - WINDOW) / STRIDE) * STRIDE).cast("int"), F.lit(STRIDE))
    slices = F.transform(starts, lambda p: F.concat(heading, F.lit("\n\n"), F.substr(body, p + 1, F.lit(WINDOW))))
    return hits.select("id", F.posexplode(F.when(F.length(content) <= WINDOW, F.array(content)).otherwise(slices)).alias("window_no", "passage"))


def overlap_logit(query: str) -> Callable[[Column], Column]:
    """A stand-in for a cross encoder: from the share of the query's terms that a passage holds, between -4 and 4."""
    terms = query_terms(query)
    lit = F.array(*[F.lit(t) for t in terms])
    return lambda passage: F.size(F.array_intersect(lit, tokens(passage))) / max(1, len(terms)) * 8.0 - 4.0


def rerank(hits: DataFrame, scorer: Callable[[Column], Column], k: int) -> DataFrame:
    """(id, score): the best window's score through a sigmoid, to four places, then the order of before."""
    best = rerank_windows(hits).groupBy("id").agg(F.max(scorer(F.col("passage"))).alias("logit"))
    scored = hits.select("id", "position").join(best, "id").select("id", "position", F.bround(vx.sigmoid(F.col("logit")), 4).alias("score"))
    return scored.orderBy(F.desc("score"), "position").limit(k)


def centroids(chunks: DataFrame, key: str = "source_path", vector_col: str = "content_vector") -> DataFrame:
    """(key, centroid): the normalised mean of a document's vectors, element by element; no vector is gathered."""
    v = F.col(vector_col)
    per_dim = chunks.filter(vx.usable(v)).select(key, F.posexplode(v).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = per_dim.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("_c"))  # one entry per dimension
    mean = F.transform("_c", lambda s: s["m"])
    return rows.select(key, vx.unit(mean).alias("centroid"))


def find_similar(chunks: DataFrame, path: str, k: int = 5, candidates: int = 50, project: str | None = None) -> DataFrame:
    """(source_path, chunk_id, score): documents nearest to a document's centroid, each by its best chunk."""
    own = centroids(chunks.filter(F.col("source_path") == path)).select("centroid").collect()  # at most one row
    if not own:
        return chunks.sparkSession.createDataFrame([], "source_path string, chunk_id long, score double")
    centroid = F.array(*[F.lit(float(x)) for x in own[0].centroid])
    others = chunks.filter(F.col("source_path") != path)
    others = others.filter(F.col("project") == project) if project else others
    v = F.col("content_vector")
    usable = others.filter(vx.usable(v) & (F.size(v) == len(own[0].centroid)))
    scored = usable.select("source_path", "chunk_id", vx.score_of_cosine(vx.dot(v, centroid) / vx.norm(v)).alias("score"))
    near = scored.orderBy(F.desc("score"), "chunk_id").limit(candidates)
    w = Window.partitionBy("source_path").orderBy(F.desc("score"), "chunk_id")
    return near.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").orderBy(F.desc("score"), "source_path").limit(k)


def hashed_embedding(text: str, width: int = 64) -> list[float]:
    """A deterministic embedder that needs no model: signed feature hashing of the analyzer's terms, of length one."""
    import zlib

    v = [0.0] * width
    for t in query_terms(text or ""):
        h = zlib.crc32(t.encode())
        v[h % width] += 1.0 if h & 0x80000000 else -1.0
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def embed(df: DataFrame, text_col: str, out: str = "content_vector", embedder: Callable[[str], list[float]] = hashed_embedding) -> DataFrame:
    """Adds a vector per row, in Arrow batches; a real model goes in as ``embedder``, loaded once per worker."""
    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else embedder(t))

    return df.withColumn(out, run(F.col(text_col)))

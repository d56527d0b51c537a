"""Most similar vectors for every vector, with robust-pruned directed graphs.

Equal vectors form a class and only one of them is indexed; a class keeps the ids that can matter for a list of k.
Class vectors are routed to shards by centroids (fitted on a bounded sample; every vector is assigned). In each shard
a directed graph is built in rounds that double the number of points: a greedy beam search over the graph so far
proposes neighbours, and robust pruning keeps an edge only if no kept neighbour is much nearer to its end (relaxed by
ALPHA); reverse edges are added and pruned alike. Then every class vector queries, by beam search in the finished graphs, its own shard, its
PROBES nearest ones and all that are hardly farther than the nearest (MARGIN). What it finds, and what the build's searches proposed, is compared again by
the exact cosine in double precision, and counts for both vectors of the pair.

Shards come from centroids of two levels: of the sample of all, and within each first-level shard over SHARD_MAX of a sample of that shard, so that their
number grows with the data; the second level is fitted and applied by tasks, never on the driver. Cells whose centroids lie nearer to each other than their own
vectors do (NEAR) don't separate neighbours: they are one shard. What is still over SHARD_MAX then (a dense region) is cut into parts by a hash, each
with its own graph, and its queries search all of them. A task's group holds at most SLICE visitors, and the number of partitions follows the rows. Each graph
is tried on TRIED of its own vectors: where it misses more than 1 - TRUST of their exact neighbours (vectors about evenly spread in a dense region), the whole part
is searched by matrix products instead. Copies never enter one task: lists of ids are limited before the shuffle.

Defined results: null vectors and vectors that are empty, of another length than most, zero or not finite take no part. Repeated rows do:
each row of a class is a neighbour of the others. Of equal similarities the smaller id comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import materialize

#: Edges of a node, width of a beam while the graph grows and of a query's, nodes a beam expands at once, relaxation of pruning (on squared distances).
DEGREE, BEAM, ASK, EXPAND, ALPHA = 20, 40, 28, 4, 1.2
#: Vectors a shard should hold, at most holds, the sample each level's centroids are fitted on, and the shards a query searches.
SHARD, SHARD_MAX, SAMPLE, PROBES = 5000, 40_000, 20_000, 1
#: Cells are one shard where their centroids' distance is at most this share of the smaller radius; shards up to so much farther than the nearest are visited.
NEAR, MARGIN = 0.75, 0.1
#: Visitors of a group, routed rows of a partition, and shard sizes that may be sent to every task.
SLICE, ROWS, FEW = 100_000, 20_000, 100_000
#: Vectors a graph is tried on, and the share of their neighbours it must find.
TRIED, TRUST = 128, 0.98
_BATCH = 256


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def beam_search(x: np.ndarray, graph: np.ndarray, entry: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities), best first, of each query's beam; -1 where it found less. Vectors are of length one."""
    n, m = len(x), len(q)
    span = EXPAND * graph.shape[1]
    seen = np.zeros(m * (n + 1), dtype=bool)  # one row a query; the last place of each stands for "no node"
    row0 = np.arange(m) * (n + 1)
    seen[row0 + n] = True
    e = entry[:beam]
    out_i, out_s = np.full((m, beam), -1), np.full((m, beam), -2.0, dtype=np.float32)
    ids = np.full((m, beam), n)
    sims = np.full((m, beam), -2.0, dtype=np.float32)
    done = np.ones((m, beam), dtype=bool)
    first = (q @ x[e].T).astype(np.float32)
    order = np.argsort(-first, axis=1)
    ids[:, : len(e)] = e[order]
    sims[:, : len(e)] = np.take_along_axis(first, order, 1)
    done[:, : len(e)] = False
    seen[(row0[:, None] + e).ravel()] = True
    live = np.arange(m)
    while len(live):
        k = len(live)
        at0 = (np.arange(k) * beam)[:, None]
        pick = np.argsort(done, axis=1, kind="stable")[:, :EXPAND] + at0  # the best ones not yet expanded
        nodes = np.where(done.ravel()[pick], n, ids.ravel()[pick])
        done.ravel()[pick] = True
        cand = graph[nodes.ravel()].reshape(k, span)
        cand.sort(axis=1)
        flat = (row0[live][:, None] + cand).ravel()
        fresh = ~seen.take(flat)
        fresh.reshape(k, span)[:, 1:] &= cand[:, 1:] != cand[:, :-1]
        at = np.flatnonzero(fresh)
        seen[flat[at]] = True
        new = cand.ravel()[at]
        s = np.full(k * span, -2.0, dtype=np.float32)
        s[at] = np.einsum("ij,ij->i", x[new], q[live[at // span]])
        all_s = np.concatenate([sims, s.reshape(k, span)], axis=1)
        wide = beam + span
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam] + (np.arange(k) * wide)[:, None]
        picked = all_s.ravel()[top]
        order = np.argsort(-picked, axis=1, kind="stable") + at0
        top = top.ravel()[order]
        sims = picked.ravel()[order]
        ids = np.concatenate([ids, cand], axis=1).ravel()[top]
        done = np.concatenate([done, ~fresh.reshape(k, span)], axis=1).ravel()[top]
        ended = done.all(axis=1)
        if ended.any():
            out_i[live[ended]], out_s[live[ended]] = ids[ended], sims[ended]
            stay = ~ended
            live, ids, sims, done = live[stay], ids[stay], sims[stay], done[stay]
    return np.where(out_s > -2.0, out_i, -1), out_s


def robust_prune(x: np.ndarray, p: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For points ``p`` the neighbours kept of ``cand`` (len(x) marks none): nearest first, dropping those that a kept one is alpha times nearer to."""
    n = len(x)
    m, c = cand.shape
    none = cand == n
    pts = x[np.where(none, 0, cand)]
    far = 2 - 2 * np.einsum("mcd,md->mc", pts, x[p])
    between = 2 - 2 * np.matmul(pts, pts.transpose(0, 2, 1))
    left = np.where(none, np.float32(np.inf), far)  # of those still in question
    out = np.full((m, degree), n)
    rows = np.arange(m)
    for k in range(degree):
        best = left.argmin(axis=1)
        any_ = np.isfinite(left[rows, best])
        if not any_.any():
            break
        out[any_, k] = cand[rows, best][any_]
        left[alpha * between[rows, best] <= far] = np.inf  # a repeated candidate is at distance zero of itself
        left[rows, best] = np.inf
    return out


def _reverse(graph: np.ndarray, p: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the edges of points ``p``: the points they lead to, and the sources of each as a padded table."""
    src, dst = np.repeat(p, graph.shape[1]), graph[p].ravel()
    src, dst = src[dst != n], dst[dst != n]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    to, start, count = np.unique(dst, return_index=True, return_counts=True)
    table = np.full((len(to), count.max(initial=0)), n)
    table[np.repeat(np.arange(len(to)), count), np.arange(len(dst)) - np.repeat(start, count)] = src
    return to, table


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(edges as an (n + 1, degree) table padded with n, entry points, and the proposals as two arrays of points).

    A point's search proposes its nearest among the points that came before; those of its own round it is compared with.
    """
    n = len(x)
    order = np.random.default_rng(seed).permutation(n)
    graph = np.full((n + 1, degree), n)
    entry = order[: min(8, n)]
    at = min(len(entry), n)
    seeds = np.sort(entry)
    graph[seeds] = robust_prune(x, seeds, np.tile(seeds, (len(seeds), 1)) * (1 - np.eye(len(seeds), dtype=int)) + n * np.eye(len(seeds), dtype=int), degree, alpha)
    one, other = [np.repeat(seeds, len(seeds))], [np.tile(seeds, len(seeds))]
    while at < n:
        p = np.sort(order[at : at + min(at, _BATCH)])  # a round adds as many points as the graph has, up to a batch
        at += len(p)
        found, _ = beam_search(x, graph, entry, x[p], beam)
        own = x[p] @ x[p].T
        np.fill_diagonal(own, -3.0)
        near = min(beam // 2, len(p))
        mates = p[np.argpartition(-own, near - 1, axis=1)[:, :near]]
        r, c = np.nonzero(found >= 0)
        one += [p[r], np.repeat(p, near)]
        other += [found[r, c], mates.ravel()]
        graph[p] = robust_prune(x, p, np.where(found < 0, n, found), degree, alpha)
        to, sources = _reverse(graph, p, n)
        for i in range(0, len(to), _BATCH):
            t = to[i : i + _BATCH]
            near = np.concatenate([graph[t], sources[i : i + _BATCH]], axis=1)
            if near.shape[1] > 4 * degree:  # many points chose one hub: prune to the nearest first, in slices
                for j in range(degree, near.shape[1], 2 * degree):
                    graph[t] = robust_prune(x, t, np.concatenate([graph[t], near[:, j : j + 2 * degree]], axis=1), degree, alpha)
            else:
                graph[t] = robust_prune(x, t, near, degree, alpha)
    return graph, entry, np.concatenate(one), np.concatenate(other)


def search_whole(x: np.ndarray, q: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, place in ``x``): the ``k`` nearest of each query among all of ``x``, those of ``least`` or more."""
    s = q @ x.T
    m = min(k, len(x))
    best = np.argpartition(-s, m - 1, axis=1)[:, :m]
    r, c = np.nonzero(np.take_along_axis(s, best, 1) >= least)
    return r, best[r, c]


def search_shard(ids: np.ndarray, vectors: np.ndarray, is_base: np.ndarray, is_query: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, neighbour ids, cosines) within one shard: up to ``k`` for each query, at ``least`` or more."""
    base = np.flatnonzero(is_base)
    base = base[np.argsort(ids[base], kind="stable")]
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    if not len(base) or not is_query.any():
        return none
    unit = _unit(vectors)
    x = unit[base]
    graph, entry, one, other = build_graph(x)
    exact = vectors.astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", exact, exact))
    out = [none]

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        cos = np.einsum("ij,ij->i", exact[a], exact[b]) / (norms[a] * norms[b])
        keep = (a != b) & (cos >= least)
        out.append((ids[a[keep]], ids[b[keep]], cos[keep]))

    close = (one != other) & (np.einsum("ij,ij->i", x[one], x[other]) >= least - 1e-4)
    pairs = np.unique(np.minimum(one, other)[close].astype(np.int64) * len(base) + np.maximum(one, other)[close])
    pairs = np.stack([pairs // len(base), pairs % len(base)], axis=1)
    queries = np.flatnonzero(is_query)
    if _finds(x, graph, entry, pairs, k, least):
        for i in range(0, len(pairs), 1 << 18):
            a, b = base[pairs[i : i + (1 << 18)].T]
            compare(a, b)
            compare(b, a)
        for i in range(0, len(queries), _BATCH):
            q = queries[i : i + _BATCH]
            found, sims = beam_search(x, graph, entry, unit[q], max(ASK, k))
            r, c = np.nonzero((found >= 0) & (sims >= least - 1e-4))
            compare(q[r], base[found[r, c]])
    else:
        for i in range(0, len(queries), _BATCH):
            q = queries[i : i + _BATCH]
            r, c = search_whole(x, unit[q], k + 4, least - 1e-4)  # one more for the query itself, some more for rounding
            compare(q[r], base[c])
    a, b, cos = (np.concatenate(z) for z in zip(*out))
    order = np.lexsort((b, -cos, a))
    a, b, cos = a[order], b[order], cos[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, cos = a[new], b[new], cos[new]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    return a[rank < k], b[rank < k], cos[rank < k]


def _finds(x: np.ndarray, graph: np.ndarray, entry: np.ndarray, pairs: np.ndarray, k: int, least: float) -> bool:
    """Whether the graph finds, or its build proposed, TRUST of the exact neighbours of some of its points."""
    n = len(x)
    tried = np.unique(np.linspace(0, n - 1, min(TRIED, n)).astype(np.int64))
    r, c = search_whole(x, x[tried], k + 1, least)
    a, b = tried[r[tried[r] != c]], c[tried[r] != c]
    if not len(a):
        return True
    found, _ = beam_search(x, graph, entry, x[tried], max(ASK, k))
    r, c = np.nonzero(found >= 0)
    p, q = tried[r], found[r, c]
    key = lambda u, v: np.minimum(u, v) * n + np.maximum(u, v)
    known = np.union1d(key(p, q), key(pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64)))
    return bool(np.isin(key(a, b), known).mean() >= TRUST)


def fit_centroids(sample: np.ndarray, k: int, steps: int = 8) -> np.ndarray:
    """``k`` centroids of length one; they depend on the order of the sample, so give it in an order of its own."""
    x = _unit(sample)
    c = x[:: max(1, len(x) // k)][:k].copy()
    for _ in range(steps):
        a = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, a, x)
        size = np.linalg.norm(total, axis=1)
        c[size > 0] = total[size > 0] / size[size > 0][:, None]
    return c


def merge_cells(sample: np.ndarray, centroids: np.ndarray, near: float = NEAR) -> np.ndarray:
    """The shard of each centroid: cells are joined, also through others, where their centroids are near for the cells' mean radius."""
    s = _unit(sample) @ centroids.T
    own = s.argmax(1)
    size = np.bincount(own, minlength=len(centroids))
    radius = np.bincount(own, np.sqrt(np.maximum(0, 2 - 2 * s.max(1))), len(centroids)) / np.maximum(size, 1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centroids @ centroids.T)))
    linked = (apart <= near * np.minimum(radius[:, None], radius[None, :])) | np.eye(len(centroids), dtype=bool)
    shard = np.arange(len(centroids))
    while True:
        least = np.where(linked, shard[None, :], len(centroids)).min(axis=1)
        if (least == shard).all():
            return np.unique(shard, return_inverse=True)[1]
        shard = least


def visits(x: np.ndarray, centroids: np.ndarray, shard: np.ndarray, probes: int = PROBES, margin: float = MARGIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home) of all shards the vectors of length one visit: the nearest ones, and all not much farther than the nearest."""
    order = np.argsort(shard, kind="stable")
    s = np.maximum.reduceat(x @ centroids[order].T, np.searchsorted(shard[order], np.arange(shard.max() + 1)), axis=1)
    far = np.sqrt(np.maximum(0, 2 - 2 * s))
    to = far <= (1 + margin) * far.min(axis=1, keepdims=True)
    np.put_along_axis(to, np.argsort(far, axis=1, kind="stable")[:, :probes], True, axis=1)
    row, at = np.nonzero(to)
    return row, at, far.argmin(axis=1)[row] == at


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        return np.concatenate([_matrix(c) for c in col.chunks]) if col.num_chunks else np.empty((0, 1), np.float32)
    flat = col.flatten()
    return np.asarray(flat, dtype=np.float32).reshape(len(col), -1) if len(col) else np.empty((0, 1), np.float32)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows whose vector has the usual length, finite values and a norm above zero."""
    v = F.col(vector_col).cast("array<float>")
    sizes = df.select(F.size(v).alias("n")).filter("n > 0").groupBy("n").count().orderBy(F.desc("count"), "n").limit(1).collect()  # one row
    d = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") == (sizes[0].n if sizes else 0)))
    norm = F.aggregate("v", F.lit(0.0), lambda a, y: a + F.coalesce(y.cast("double"), F.lit(float("nan"))) * y.cast("double"))
    return d.filter((norm > 0) & (norm < float("inf")) & ~F.isnan(norm))


def _share(rows: Column, of: Column | int) -> Column:
    """Whether a row is in the sample of about SAMPLE rows, by a hash of its id."""
    return F.pmod(F.xxhash64(rows), F.lit(1_000_000)) < F.greatest(F.lit(1), F.floor(F.lit(1_000_000) * F.least(F.lit(1.0), F.lit(float(SAMPLE)) / of)))


def _fit(sample: np.ndarray, n: int, size: int, most: int, near: float) -> tuple[np.ndarray, np.ndarray]:
    """Centroids for ``n`` vectors, one for ``size`` of them but at most one for 16 rows of a full sample (``most``), and the shard of each."""
    k = max(1, min(-(-n // size), most // 16, len(sample)))
    centroids = fit_centroids(sample, k)
    return centroids, merge_cells(sample, centroids, near)


def _visit(b: pa.RecordBatch | pa.Table, centroids: np.ndarray, shard: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    row, to, home = visits(_unit(_matrix(b.column("v"))), centroids, shard, min(PROBES, int(shard.max()) + 1))
    return pa.array(row), to.astype(np.int32), home


def _shards(reps: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The vectors in the shards they visit (shard, sub, home, id, v), the sizes of the shards (shard, sub, parts, slices), and the number of visits."""
    spark = reps.sparkSession
    sizes = (SHARD, SAMPLE, NEAR)  # as they are here, for the tasks
    n = reps.count()
    picked = sorted(reps.filter(_share(F.col("id"), F.lit(max(1, n)))).collect())  # about SAMPLE rows
    centroids, shard = _fit(np.array([r.v for r in picked], dtype=np.float32), n, *sizes) if picked else (np.ones((1, 1), np.float32), np.zeros(1, int))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, to, home = _visit(b, centroids, shard)
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(home), b.column("id").take(at), b.column("v").take(at)], ["shard", "home", "id", "v"])

    first = materialize(reps.mapInArrow(route, "shard int, home boolean, id long, v array<float>"), "vector-routes")
    own = first.groupBy("shard").agg(F.count_if("home").alias("own"), F.count("*").alias("visitors")).collect()  # at most SAMPLE / 16 rows
    large = [r for r in own if r.own > SHARD_MAX]
    routed = first.withColumn("sub", F.lit(0))
    if large:
        few = F.broadcast(spark.createDataFrame([(r.shard, r.own, -(-r.visitors // SLICE)) for r in large], "shard int, own long, salts int"))
        inside = first.join(few, "shard")
        sample = inside.filter(F.col("home") & _share(F.col("id"), F.col("own"))).select("shard", "own", "id", "v")

        def fit(t: pa.Table) -> pa.Table:
            t = t.sort_by("id")
            c, sub = _fit(_matrix(t["v"]), t["own"][0].as_py(), *sizes)
            return pa.table({"shard": pa.array([t["shard"][0].as_py()] * len(c), pa.int32()), "sub": pa.array(sub, pa.int32()), "centroid": pa.array(list(c), pa.list_(pa.float32()))})

        fitted = materialize(sample.groupBy("shard").applyInArrow(fit, "shard int, sub int, centroid array<float>"), "vector-centroids")
        salted = fitted.join(few, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "sub", "centroid")
        visitors = inside.select("shard", F.pmod(F.xxhash64("id", F.lit(5)), F.col("salts")).cast("int").alias("salt"), "home", "id", "v")

        def place(rows: pa.Table, cells: pa.Table) -> pa.Table:
            if rows.num_rows and cells.num_rows:
                at, to, home = _visit(rows, _matrix(cells["centroid"]), np.asarray(cells["sub"]))
                rows = rows.take(at)
                return pa.table({"shard": rows["shard"], "home": pa.array(home & np.asarray(rows["home"])), "id": rows["id"], "v": rows["v"], "sub": pa.array(to)})
            return pa.table({"shard": pa.array([], pa.int32()), "home": pa.array([], pa.bool_()), "id": pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.float32())), "sub": pa.array([], pa.int32())})

        second = visitors.groupBy("shard", "salt").cogroup(salted.groupBy("shard", "salt")).applyInArrow(place, "shard int, home boolean, id long, v array<float>, sub int")
        rest = routed.join(few.select("shard"), "shard", "left_anti")
        routed = rest.unionByName(materialize(second, "vector-routes"))
    sizes = materialize(routed.groupBy("shard", "sub").agg(F.ceil(F.count_if("home") / SHARD_MAX).cast("int").alias("parts"), F.ceil(F.count("*") / SLICE).cast("int").alias("slices"), F.count("*").alias("rows")).filter("parts > 0"), "vector-sizes")
    shards, total = sizes.agg(F.count("*"), F.coalesce(F.sum(F.col("rows") * F.col("parts")), F.lit(0))).first()
    return routed, F.broadcast(sizes) if shards <= FEW else sizes, total


def nearest(df: DataFrame, k: int = 5, least: float = -1.0, id_col: str = "chunk_id", vector_col: str = "content_vector") -> DataFrame:
    """(id, neighbor_id, similarity): up to ``k`` nearest others of every row, those of similarity ``least`` or more."""
    spark = df.sparkSession
    rows = materialize(usable(df, id_col, vector_col).withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")}), "vectors")
    key = ["k1", "k2"]
    least_ids = rows.select(*key, "id").withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("id"))).filter(F.col("_n") <= k + 1)
    classes = materialize(least_ids.groupBy(key).agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0]), "vector-classes")
    reps = materialize(rows.select("id", "v").join(classes.select(F.col("rep").alias("id")), "id", "left_semi"), "vector-reps")

    routed, sizes, total = _shards(reps)
    placed = routed.join(sizes, ["shard", "sub"]).withColumn("_own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    placed = placed.select("shard", "sub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "home", "id", "v", "_own", "slices").withColumn("base", F.col("home") & (F.col("part") == F.col("_own")))
    # a part's own vectors are in all of its slices and ask in one of them; so does a visitor
    placed = placed.withColumn("_of", F.pmod(F.xxhash64("id", F.lit(3)), F.col("slices")).cast("int"))
    placed = placed.withColumn("slice", F.explode(F.when(F.col("base"), F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(F.array("_of")))).withColumn("asks", F.col("slice") == F.col("_of"))
    group = ["shard", "sub", "part", "slice"]
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-total // ROWS))

    def search(table: pa.Table) -> pa.Table:
        t = table
        a, b, cos = search_shard(np.asarray(t["id"]), _matrix(t["v"]), np.asarray(t["base"]), np.asarray(t["asks"]), 2 * k, least)
        return pa.table({"rep": pa.array(a, pa.int64()), "other": pa.array(b, pa.int64()), "similarity": pa.array(cos, pa.float64())})

    found = placed.select(*group, "base", "asks", "id", "v").repartition(tasks, *group).groupBy(group).applyInArrow(search, "rep long, other long, similarity double")
    # what one side's search found counts for the other side too, so that a pair has two chances; a union would search twice
    sides = F.array(F.struct("rep", "other"), F.struct(F.col("other").alias("rep"), F.col("rep").alias("other")))
    found = found.select(F.explode(sides).alias("x"), "similarity").select("x.rep", "x.other", "similarity").distinct()
    best = Window.partitionBy("rep").orderBy(F.desc("similarity"), "other")
    found = found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k)

    # lists of a class: its own least ids, and those of its nearest classes; k + 1 of them hold every member's k others
    ids_of = classes.select(F.col("rep").alias("other"), F.col("ids").alias("other_ids"))
    others = found.join(ids_of, "other").select("rep", "similarity", F.explode("other_ids").alias("neighbor_id"))
    own = classes.select("rep", F.lit(1.0).alias("similarity"), F.explode("ids").alias("neighbor_id")).filter(F.lit(least <= 1.0))
    both = others.unionByName(own).withColumn("_n", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("similarity"), "neighbor_id"))).filter(F.col("_n") <= k + 1)
    lists = both.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "neighbor_id"))).alias("list")).join(classes.select("rep", *key), "rep").filter(F.size("list") > 1)
    member = rows.select("id", *key).join(lists.select(*key, "list"), key)
    of_row = F.slice(F.filter("list", lambda x: x["neighbor_id"] != F.col("id")), 1, k)
    return member.select("id", F.explode(of_row).alias("x")).select(F.col("id").alias(id_col), F.col("x.neighbor_id").alias("neighbor_id"), (-F.col("x.s")).alias("similarity"))

"""Top neighbours of every row among the rows of its group, by cosine.

A row of a group of at most WHOLE rows is compared, exactly and in blocks of matrix products, with all rows of the group.
Rows of larger groups go through an inverted file of cells, whose centroids are fitted on a bounded sample of such rows; every
row is assigned. A row is compared with all rows of its group in the PROBES cells nearest to it and in all cells hardly
farther than the nearest (MARGIN), and what it finds counts for both rows. A cell, or a whole group, that holds more than MOST
rows of one group is cut by a hash and its queries visit every part, at most SLICE of them in a task.

The routed rows are written once; what follows reads them and shuffles them once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import vectors as vx
from quillspark.session import materialize

CELL, MOST, SAMPLE, PROBES, SLICE = 2000, 20_000, 20_000, 4, 8192
#: Cells and parts whose sizes may be sent to every task.
FEW = 100_000
#: Rows of a group compared whole; how much farther than the nearest a visited cell may be.
WHOLE, MARGIN = 40_000, 0.2


def _centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    x = vx.unit_rows(sample)
    c = x[:k].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(axis=0)
        c = vx.unit_rows(c)
    return c


def _routed(rows: DataFrame, n: int) -> DataFrame:
    """(cell, home, id, g, a, v): the rows in the cells they visit."""
    part = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < max(1, int(1_000_000 * min(1.0, SAMPLE / n)))
    picked = sorted(rows.filter(part).select("id", "v").collect()) or rows.orderBy("id").select("id", "v").limit(1).collect()  # about SAMPLE rows, in an order of their own
    sample = np.array([r.v for r in picked], dtype=np.float64)
    centroids = _centroids(sample, max(1, min(-(-n // CELL), len(sample), SAMPLE // 16))).astype(np.float32)
    probes = min(PROBES, len(centroids))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = vx.unit_rows(vx.matrix(b.column("v"))).astype(np.float32) @ centroids.T
                far = np.sqrt(np.maximum(0, 2 - 2 * s))
                to = far <= (1 + MARGIN) * far.min(axis=1, keepdims=True)
                np.put_along_axis(to, np.argsort(far, axis=1, kind="stable")[:, :probes], True, axis=1)
                row, cell = np.nonzero(to)
                take, home = pa.array(row), far.argmin(axis=1)[row] == cell
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(home), *(b.column(c).take(take) for c in ("id", "g", "a", "v"))], ["cell", "home", "id", "g", "a", "v"])

    return rows.mapInArrow(route, "cell int, home boolean, id long, g long, a long, v array<float>")


def _small(sizes: DataFrame) -> DataFrame:
    """Sizes, for every task where they are at most FEW; beyond that the join shuffles."""
    s = materialize(sizes, "neighbour-sizes")
    return F.broadcast(s) if s.count() <= FEW else s


def top_neighbours(df: DataFrame, id_col: str, vector_col: str, group: str, apart: str, k: int, least_cosine: float) -> DataFrame:
    """(id, other_id, cosine): up to k nearest rows of the same ``group`` with another value of ``apart``, at ``least_cosine`` or more.

    Rows without a usable vector or group take no part. Of equal cosines the smaller id comes first.
    """
    spark = df.sparkSession
    rows = df.filter(vx.usable(F.col(vector_col)) & F.col(group).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(group).alias("g"), F.xxhash64(apart).alias("a"), F.col(vector_col).cast("array<float>").alias("v"))
    n = rows.count()
    schema = "id long, other_id long, cosine double"
    if n == 0:
        return spark.createDataFrame([], schema)
    rows = materialize(rows, "neighbour-rows")
    sized = rows.join(_small(rows.groupBy("g").agg(F.count("*").alias("_rows"))), "g")
    small, large = (sized.filter(c).select("id", "g", "a", "v") for c in (F.col("_rows") <= WHOLE, F.col("_rows") > WHOLE))
    routed = small.select(F.lit(-1).alias("cell"), F.lit(True).alias("home"), "id", "g", "a", "v")
    n_large = large.count()
    if n_large:
        routed = routed.unionByName(materialize(_routed(large, n_large), "neighbour-routes"))
    sizes = routed.groupBy("g", "cell").agg(F.ceil(F.count_if("home") / MOST).cast("int").alias("parts"), F.ceil(F.count("*") / SLICE).cast("int").alias("slices")).filter("parts > 0")
    placed = routed.join(_small(sizes), ["g", "cell"])  # a cell without rows of the group has nothing to find
    placed = placed.withColumn("_own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select("g", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "home", "id", "a", "v", "_own", "slices")
    placed = placed.withColumns({"base": F.col("home") & (F.col("part") == F.col("_own")), "_of": F.pmod(F.xxhash64("id", F.lit(5)), F.col("slices")).cast("int")})
    # the rows compared with are in all slices of a part, each query is in one
    placed = placed.withColumn("slice", F.explode(F.when(F.col("base"), F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(F.array("_of"))))
    placed = placed.select("g", "cell", "part", "slice", (F.col("slice") == F.col("_of")).alias("query"), "base", "id", "a", "v")

    def compare(table: pa.Table) -> pa.Table:
        ids, a, base, query = (np.asarray(table[c]) for c in ("id", "a", "base", "query"))
        v = vx.unit_rows(vx.matrix(table["v"]))
        at, ask = np.flatnonzero(base), np.flatnonzero(query)
        at = at[np.argsort(ids[at], kind="stable")]
        out = []
        for i in range(0, len(ask) if len(at) else 0, 512):
            q = ask[i : i + 512]
            s = v[q] @ v[at].T
            s[a[q, None] == a[at][None, :]] = -np.inf
            r, c = vx.best_by_id(s, k)
            near = s[r, c] >= least_cosine
            out.append((ids[q[r[near]]], ids[at[c[near]]], s[r, c][near]))
        x, y, z = (np.concatenate(p) for p in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"id": pa.array(x, pa.int64()), "other_id": pa.array(y, pa.int64()), "cosine": pa.array(np.round(z, 12), pa.float64())})

    found = placed.groupBy("g", "cell", "part", "slice").applyInArrow(compare, schema)
    # what one side found counts for the other side too
    found = found.unionByName(found.select(F.col("other_id").alias("id"), F.col("id").alias("other_id"), "cosine")).groupBy("id", "other_id").agg(F.max("cosine").alias("cosine"))
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "other_id")
    return found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")

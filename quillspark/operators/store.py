"""The chunk table and its sinks: replace by key, delete by predicate, partial update, purge, schema evolution.

A table is a folder whose rows lie in buckets by a hash of their key: ``<path>/v=<n>/_b=<bucket>``. A write makes new files for the buckets it
touches only, and then a pointer that names the version of each bucket; a reader never sees half of it and nothing is overwritten
while it is read. Replacing documents is an anti-join on their keys and a union, within their buckets.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()), "array<float>": T.ArrayType(T.FloatType())}


def _schema(fields: str) -> T.StructType:
    """A schema from ``name type`` pairs, without a session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(","))])


CHUNKS = _schema(
    "project string, source_path string, ordinal int, title string, heading_path string, content string, text string, content_hash string, "
    "line_hashes array<string>, source_modified_at timestamp, indexed_at timestamp, content_vector array<float>"
)
NOTES = _schema("note_id string, project string, text string, target_path string, author string, created_at timestamp, content_vector array<float>")
PAIRS = _schema(
    "pair_id string, project string, similarity double, detected_at timestamp, kind string, status string, resolved_note_id string, status_changed_at timestamp, "
    "a_path string, a_ordinal int, a_heading string, a_modified_at timestamp, a_excerpt string, b_path string, b_ordinal int, b_heading string, b_modified_at timestamp, b_excerpt string"
)
MANIFEST = _schema("project string, folder string, source_path string, mtime timestamp, length long")
#: Values of fields that older rows lack.
DEFAULTS = {"status": "open", "kind": "contradiction"}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in order: absent ones as null, absent or null fields of DEFAULTS by their default; others are left out."""
    have = set(df.columns)
    cols = []
    for f in schema:
        c = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        cols.append((F.coalesce(c, F.lit(DEFAULTS[f.name])) if f.name in DEFAULTS else c).alias(f.name))
    return df.select(cols)


class Table:
    """A versioned table in a folder; with one writer at a time. ``buckets`` stays as it was at the first write."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keep: int = 2, key: str | None = None, buckets: int = 64):
        self.spark, self.path, self.schema, self.keep, self.buckets = spark, path.rstrip("/"), schema, keep, buckets
        self.key = key or next(k for k in ("source_path", "note_id", "pair_id") if k in schema.names)
        self._hpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        return max(self._versions(), default=0)

    def _versions(self) -> list[int]:
        p = self._hpath(f"{self.path}/_current")
        names = [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _pointer(self, n: int) -> dict:
        """{buckets, at: version of each bucket that has rows} of a version."""
        if not n:
            return {"buckets": self.buckets, "at": {}}
        f = self._fs.open(self._hpath(f"{self.path}/_current/{n}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8"))
        finally:
            f.close()

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The current rows (of some buckets); an empty frame before the first write. Missing fields have their defaults."""
        at = self._pointer(self.version())["at"]
        paths = [f"{self.path}/v={v}/_b={b}" for b, v in at.items() if only is None or int(b) in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return conform(self.spark.read.option("mergeSchema", "true").parquet(*paths), self.schema)

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(n)).cast("int")

    def write(self, df: DataFrame, only: list[int] | None = None) -> int:
        """Makes these rows the table's, or the rows of some of its buckets."""
        was = self.version()
        n, old = was + 1, self._pointer(was)
        rows = conform(df, self.schema).withColumn("_b", self._bucket(old["buckets"])).hint("rebalance", "_b")
        rows.write.mode("overwrite").partitionBy("_b").parquet(f"{self.path}/v={n}")
        made = [s.getPath().getName() for s in self._fs.listStatus(self._hpath(f"{self.path}/v={n}"))]
        kept = {} if only is None else {b: v for b, v in old["at"].items() if int(b) not in only}
        pointer = {"buckets": old["buckets"], "at": kept | {m[3:]: n for m in made if m.startswith("_b=")}}
        self._fs.mkdirs(self._hpath(f"{self.path}/_current"))
        hidden = self._hpath(f"{self.path}/_next-{n}")
        out = self._fs.create(hidden, True)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        self._fs.rename(hidden, self._hpath(f"{self.path}/_current/{n}"))  # the swap: a reader takes the highest
        self._drop_old()
        return n

    def _drop_old(self) -> None:
        """Removes pointers beyond the last ``keep`` and the files that no pointer names any more."""
        versions = self._versions()
        for v in versions[: -self.keep]:
            self._fs.delete(self._hpath(f"{self.path}/_current/{v}"), True)
        used = {(v, b) for n in versions[-self.keep :] for b, v in self._pointer(n)["at"].items()}
        for s in self._fs.listStatus(self._hpath(self.path)):
            name = s.getPath().getName()
            if name.startswith("v=") and int(name[2:]) <= versions[-1]:
                parts = [x.getPath() for x in self._fs.listStatus(s.getPath()) if x.getPath().getName().startswith("_b=")]
                gone = [x for x in parts if (int(name[2:]), x.getName()[3:]) not in used]
                for x in [s.getPath()] if len(gone) == len(parts) else gone:
                    self._fs.delete(x, True)

    def _touched(self, keys: DataFrame) -> list[int]:
        """The buckets of rows that have the key column; at most one number for each bucket reaches the driver."""
        n = self._pointer(self.version())["buckets"]
        return [r[0] for r in keys.select(self._bucket(n)).distinct().collect()]

    def replace(self, new: DataFrame, also_gone: DataFrame | None = None) -> int:
        """Upsert: all rows of the new rows' keys are replaced by them, and those of ``also_gone`` are removed; without any nothing changes."""
        keys = new.select(self.key) if also_gone is None else new.select(self.key).unionByName(also_gone.select(self.key))
        keys = keys.distinct()
        only = self._touched(keys)
        return self.write(self.read(only).join(keys, self.key, "left_anti").unionByName(conform(new, self.schema)), only) if only else self.version()

    def delete(self, condition: Column) -> int:
        """Deletes rows for which the condition is true (not null), and returns their number."""
        hits = self.read().filter(condition)
        only = self._touched(hits)
        if not only:
            return 0
        here = self.read(only)
        gone = here.filter(condition).count()
        self.write(here.filter(~F.coalesce(condition, F.lit(False))), only)
        return gone

    def update(self, condition: Column, values: dict[str, Column]) -> int:
        """Sets fields, but not the key, of the rows that meet the condition; an error where none does."""
        only = self._touched(self.read().filter(condition))
        if not only:
            raise KeyError("no row to update")
        t = self.read(only)
        hit = F.coalesce(condition, F.lit(False))
        n = t.filter(hit).count()
        self.write(t.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in values.items()}), only)
        return n


def purge(tables: dict[str, Table], project: str) -> dict[str, int]:
    """Deletes a project's rows from every table and reports how many each had."""
    return {name: t.delete(F.col("project") == project) for name, t in tables.items()}


def purge_connector(chunks: Table, project: str, scheme: str, key: str | None = None) -> int:
    """Deletes one document of a connector, or all of its scheme, within a project."""
    which = F.col("source_path") == key if key else F.col("source_path").startswith(f"{scheme}://")
    return chunks.delete(which & (F.col("project") == project))


def check_vectors(df: DataFrame, width: int) -> DataFrame:
    """Fails where a row's vector hasn't the table's width; null vectors pass."""
    ok = F.col("content_vector").isNull() | (F.size("content_vector") == width)
    return df.filter(F.assert_true(ok, F.lit("a vector of the wrong width")).isNull())

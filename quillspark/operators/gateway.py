"""Capped, read-only SQL over registered tables or in the database a descriptor names; the catalog of such databases."""

from __future__ import annotations

import json
import os
import re
import threading
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as tx

DEFAULT_ROWS, MOST_ROWS, DEFAULT_TIMEOUT = 500, 5000, 10
#: Plan nodes that only read, as the parser makes them; a statement is a read if all of its nodes are here, those of subqueries and of named queries included.
_READS = {
    "Aggregate", "Deduplicate", "Distinct", "Except", "Expand", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "NamedParametersQuery", "Offset", "OneRowRelation", "Pivot",
    "Project", "Range", "Sample", "Sort", "SubqueryAlias", "Union", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedOrdinal", "UnresolvedQualify", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases",
    "UnresolvedTVFAliases", "UnresolvedTableValuedFunction", "UnresolvedWith", "Unpivot", "WithCTE", "WithWindowDefinition", "RepartitionByExpression", "UnionLoop", "AsOfJoin",
}
_WRITES = {"AppendData", "CreateTable", "CreateTableAsSelect", "InsertIntoStatement", "OverwriteByExpression"}
#: Functions that run code of the caller's choice.
_UNSAFE = {"java_method", "reflect", "try_reflect"}
#: Databases a descriptor can name, with the driver's class where Spark needs it.
PROVIDERS = {"derby": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "mysql": None, "postgres": None, "sqlserver": None}


def expand(value: str, env: dict[str, str] | None = None) -> str:
    """``${NAME}`` from the environment; an error names what is missing."""
    e = os.environ if env is None else env

    def one(m: re.Match) -> str:
        if m[1] not in e:
            raise KeyError(m[1])
        return e[m[1]]

    return re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", one, value)


@dataclass
class Descriptor:
    """A data source: its connection, and whether and how it may be queried."""

    name: str
    provider: str
    connection: str
    schemas: list[str] = field(default_factory=list)
    queryable: bool = False
    allow_writes: bool = False
    max_rows: int = DEFAULT_ROWS
    timeout: int = DEFAULT_TIMEOUT
    query_connection: str | None = None

    @staticmethod
    def parse(text: str, name: str) -> Descriptor:
        """From JSON with comments and trailing commas; keys in any case. Provider and connection are required."""
        bare = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
        raw = json.loads(re.sub(r",\s*([}\]])", r"\1", bare))
        low = lambda d: {k.lower(): v for k, v in d.items()}
        d = low(raw)
        if not d.get("provider") or not d.get("connectionstring"):
            raise ValueError("provider and connectionString are required")
        q = low(d["query"]) if isinstance(d.get("query"), dict) else None
        return Descriptor(
            d.get("name") or name, str(d["provider"]).lower(), d["connectionstring"], list(d.get("schemas") or []), q is not None, bool(q and q.get("allowwrites")),
            int((q or {}).get("maxrows") or DEFAULT_ROWS), int((q or {}).get("timeoutseconds") or DEFAULT_TIMEOUT), (q or {}).get("connectionstring"),
        )

    def jdbc_options(self, env: dict[str, str] | None = None) -> dict[str, str]:
        return {"url": expand(self.query_connection or self.connection, env), "queryTimeout": str(self.timeout)}


@dataclass
class Result:
    """What a query gave: rows, or why it was refused or failed. Nothing expected is raised."""

    status: str
    message: str = ""
    columns: list[str] = field(default_factory=list)
    rows: list[list[str | None]] = field(default_factory=list)
    truncated: bool = False
    rows_affected: int | None = None

    def markdown(self) -> str:
        if not self.columns:
            return "(no columns)"
        cell = lambda v: re.sub(r"[\r\n]+", " ", (v or "").replace("\\", "\\\\").replace("|", "\\|"))
        line = lambda r: "| " + " | ".join(map(cell, r)) + " |"
        return "\n".join([line(self.columns), "|" + " --- |" * len(self.columns), *map(line, self.rows)])


def row_cap(limit: int, override: int | None = None) -> int:
    return min(MOST_ROWS, max(1, override if override and override > 0 else limit))


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def _nodes(plan) -> tuple[set[str], set[str]]:
    """(plan nodes, functions) of a parsed statement: children, bodies of named queries, and subqueries in expressions."""
    names, functions = set(), set()
    todo = [(plan, True)]
    while todo:
        node, is_plan = todo.pop()
        kind = node.getClass().getSimpleName()
        if is_plan:
            names.add(kind)
            todo += [(e, False) for e in _seq(node.expressions())]
        if kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
            functions.add(str(_seq(node.nameParts() if kind == "UnresolvedFunction" else node.name())[-1]).lower())
        todo += [(c, is_plan) for c in _seq(node.children())]
        todo += [(c, True) for c in _seq(node.innerChildren())]  # whole plans, of plans and of expressions
    return names, functions


def statement_kind(spark: SparkSession, sql: str) -> str:
    """``read``, ``write``, or the name of what keeps the statement that Spark's own parser sees from being either."""
    names, functions = _nodes(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql))
    if bad := functions & _UNSAFE:
        return min(bad)
    other = names - _READS
    return "read" if not other else "write" if other <= _WRITES else min(other - _WRITES)


def judge_read(has_columns: bool, affected: int) -> tuple[bool, str]:
    """Of a statement that ran in a transaction to be rolled back: whether it was a read, else why not."""
    if affected > 0:
        return False, f"the statement changed {affected} rows and was rolled back"
    return (True, "") if has_columns else (False, "the statement gave no result and was rolled back")


class Gateway:
    """Named tables and sources; every answer is capped and every value a string."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.sources: dict[str, Descriptor] = {}

    def register(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)

    def register_source(self, d: Descriptor) -> None:
        self.sources.setdefault(d.name.lower(), d)  # the first of a name wins

    def listed(self) -> list[tuple[str, str]]:
        """Names with their access: none, read-only or read-write."""
        return sorted((d.name, "read-write" if d.allow_writes and d.queryable else "read-only" if d.queryable else "not queryable") for d in self.sources.values())

    def register_jdbc(self, d: Descriptor, table: str, env: dict[str, str] | None = None) -> None:
        self.register(table.rsplit(".", 1)[-1], self.spark.read.format("jdbc").options(**d.jdbc_options(env), dbtable=table).load())

    def query(self, sql: str, max_rows: int | None = None, source: str | None = None, env: dict[str, str] | None = None) -> Result:
        """One statement, over the registered tables or, where a source is named, in that source's database.

        Only reads run, unless the source is opened for writing. In a database a read runs in a read-only transaction that is rolled back,
        so what it did to get its rows is undone; what changes rows or gives none is refused by its outcome.
        """
        d = self.sources.get((source or "").lower())
        if source and d is None:
            return Result("refused", f"unknown source {source}")
        if d and not d.queryable:
            return Result("refused", f"{d.name} is not queryable")
        if not sql or not sql.strip():
            return Result("refused", "no statement")
        if d and d.provider not in PROVIDERS:
            return Result("refused", f"{d.provider} can't be queried")
        cap = row_cap(d.max_rows if d else DEFAULT_ROWS, max_rows)
        try:
            return self._in_database(d, sql, cap, env) if d else self._in_session(sql, cap)
        except KeyError as e:
            return Result("refused", f"the environment has no {e.args[0]}")
        except Exception as e:  # noqa: BLE001  the engine's message is the answer
            cause = getattr(e, "java_exception", None)
            return Result("failed", str(cause.getMessage() if cause is not None else e).split("\n")[0])

    def _in_session(self, sql: str, cap: int) -> Result:
        kind = statement_kind(self.spark, sql)
        if kind != "read":
            return Result("refused", f"only reads are allowed, this is {kind}")
        df = self.spark.sql(sql)
        names = df.columns
        text = df.toDF(*(f"c{i}" for i in range(len(names)))).select([F.col(f"c{i}").cast("string") for i in range(len(names))])
        with _limited(self.spark, DEFAULT_TIMEOUT):
            rows = [list(r) for r in text.limit(cap + 1).collect()]  # at most MOST_ROWS and one more
        return Result("ok", columns=names, rows=rows[:cap], truncated=len(rows) > cap)

    def _in_database(self, d: Descriptor, sql: str, cap: int, env: dict[str, str] | None) -> Result:
        url = d.jdbc_options(env)["url"]
        jvm = self.spark._jvm
        if PROVIDERS[d.provider]:
            jvm.org.apache.spark.util.Utils.classForName(PROVIDERS[d.provider], True, False)
        c = jvm.java.sql.DriverManager.getConnection(url)
        try:
            c.setAutoCommit(False)
            if not d.allow_writes:
                c.setReadOnly(d.provider == "postgres")  # others judge by the outcome
            st = c.createStatement()
            st.setQueryTimeout(d.timeout)
            st.setMaxRows(cap + 1)
            has_rows = st.execute(sql)
            affected = -1 if has_rows else st.getUpdateCount()
            if not d.allow_writes:
                fine, why = judge_read(has_rows, affected)
                if not fine:
                    return Result("refused", why)
            columns, rows = [], []
            if has_rows:
                rs, meta = st.getResultSet(), st.getResultSet().getMetaData()
                columns = [meta.getColumnLabel(i + 1) for i in range(meta.getColumnCount())]
                while rs.next():
                    rows.append([rs.getString(i + 1) for i in range(len(columns))])
            if d.allow_writes:
                c.commit()
            return Result("ok", columns=columns, rows=rows[:cap], truncated=len(rows) > cap, rows_affected=None if has_rows else max(0, affected))
        finally:
            c.rollback()
            c.close()

    def write(self, sql: str) -> Result:
        """A write among the registered tables (the session's catalog), for a caller who may: the number of rows it wrote."""
        try:
            kind = statement_kind(self.spark, sql)
            if kind != "write":
                return Result("refused", f"not a write but {kind}")
            plan = self.spark.sql(sql)._jdf.queryExecution().executedPlan()
            counted = [m.get().value() for m in (p.metrics().get("numOutputRows") for p in _commands(plan)) if m.isDefined()]
            return Result("ok", rows_affected=sum(counted))
        except Exception as e:  # noqa: BLE001
            return Result("failed", str(e).split("\n")[0])


def _commands(plan) -> list:
    """The commands a statement ran, below what shows their result."""
    inner = plan.commandPhysicalPlan() if plan.getClass().getSimpleName() == "CommandResultExec" else plan
    return [inner] if inner.metrics().contains("numOutputRows") else [x for c in _seq(inner.children()) for x in _commands(c)]


@contextmanager
def _limited(spark: SparkSession, seconds: int):
    """Cancels the jobs started within it after so many seconds."""
    sc, tag = spark.sparkContext, f"gateway-{uuid.uuid4().hex}"
    sc.addJobTag(tag)
    timer = threading.Timer(seconds, sc.cancelJobsWithTag, [tag])
    timer.start()
    try:
        yield
    finally:
        timer.cancel()
        sc.removeJobTag(tag)


def catalog_frames(spark: SparkSession, d: Descriptor, env: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The catalog of a database over JDBC, by INFORMATION_SCHEMA: ``columns`` (of tables and views), ``keys``, ``foreign``, ``views`` and, of Postgres, ``comments``."""
    on = "x.constraint_schema = k.constraint_schema AND x.constraint_name = k.constraint_name"
    asked = {
        "columns": "SELECT table_schema, table_name, column_name, ordinal_position, data_type, is_nullable FROM information_schema.columns",
        "keys": f"SELECT k.table_schema, k.table_name, k.column_name FROM information_schema.table_constraints x JOIN information_schema.key_column_usage k ON {on} WHERE x.constraint_type = 'PRIMARY KEY'",
        "foreign": "SELECT k.table_schema, k.table_name, k.column_name, k.constraint_name, k.ordinal_position, r.table_schema AS ref_schema, r.table_name AS ref_table, r.column_name AS ref_column FROM information_schema.referential_constraints x "
        f"JOIN information_schema.key_column_usage k ON {on} JOIN information_schema.key_column_usage r ON r.constraint_schema = x.unique_constraint_schema AND r.constraint_name = x.unique_constraint_name AND r.ordinal_position = k.ordinal_position",
        "views": "SELECT table_schema, table_name, view_definition FROM information_schema.views",
    }
    if d.provider == "postgres":
        asked["comments"] = "SELECT n.nspname AS table_schema, c.relname AS table_name, a.attname AS column_name, d.description AS remark FROM pg_description d JOIN pg_class c ON c.oid = d.objoid JOIN pg_namespace n ON n.oid = c.relnamespace LEFT JOIN pg_attribute a ON a.attrelid = c.oid AND a.attnum = d.objsubid AND d.objsubid > 0"
    read = spark.read.format("jdbc").options(**d.jdbc_options(env))
    return {k: read.option("query", q).load() for k, q in asked.items()}


_SYSTEM = ("information_schema", "pg_catalog", "sys")


def schema_tables(columns: DataFrame, keys: DataFrame, foreign: DataFrame, allow: list[str] | None = None) -> DataFrame:
    """Columns of a catalog with primary-key flags and foreign-key targets: INFORMATION_SCHEMA-shaped frames joined by (schema, table, column).

    ``columns``: table_schema, table_name, column_name, ordinal_position, data_type, is_nullable; ``keys``: schema, table, column;
    ``foreign``: schema, table, column, ref_schema, ref_table, ref_column, each pair of columns at one place of its key. System schemas are left out.
    """
    own = columns.filter(~F.lower("table_schema").isin(*_SYSTEM))
    own = own.filter(F.lower("table_schema").isin([a.lower() for a in allow])) if allow else own
    on = ["table_schema", "table_name", "column_name"]
    k = keys.select(*on).distinct().withColumn("is_key", F.lit(True))
    f = foreign.groupBy(on).agg(F.array_sort(F.collect_set(F.concat_ws(".", "ref_table", "ref_column"))).alias("references"))
    return own.join(k, on, "left").join(f, on, "left").withColumn("is_key", F.coalesce("is_key", F.lit(False)))


def composite_keys(foreign: DataFrame) -> DataFrame:
    """(from_table, from_columns, to_table, to_columns): each foreign key once, its columns in the key's order."""
    paired = foreign.groupBy("table_schema", "table_name", "constraint_name", "ref_schema", "ref_table").agg(F.array_sort(F.collect_set(F.struct("ordinal_position", "column_name", "ref_column"))).alias("c"))
    listed = lambda name: F.array_join(F.transform("c", lambda x: x[name]), ", ")
    full = lambda a, b: F.concat_ws(".", a, b)
    return paired.select(full("table_schema", "table_name").alias("from_table"), listed("column_name").alias("from_columns"), full("ref_schema", "ref_table").alias("to_table"), listed("ref_column").alias("to_columns"))


def live_schema(frames: dict[str, DataFrame], allow: list[str] | None = None) -> DataFrame:
    """(table_name, markdown): a section per table or view of a catalog, in the form schema dumps have. System schemas are left out.

    A row holds one table's own columns; keys and comments come by joins.
    """
    cols = schema_tables(frames["columns"], frames["keys"], frames["foreign"], allow)
    remarks = frames.get("comments")
    on = ["table_schema", "table_name"]
    table_of = F.concat_ws(".", *on)
    if remarks is None:
        cols = cols.withColumn("remark", F.lit(None).cast("string"))
        heads = cols.select(*on, F.lit(None).cast("string").alias("head")).limit(0)
    else:
        cols = cols.join(remarks.filter("column_name IS NOT NULL").groupBy(*on, "column_name").agg(F.min("remark").alias("remark")), [*on, "column_name"], "left")
        heads = remarks.filter("column_name IS NULL").groupBy(on).agg(F.min("remark").alias("head"))
    fk = F.transform(F.coalesce("references", F.array().cast("array<string>")), lambda r: F.concat(F.lit("FK → "), F.regexp_replace(r, r"\.([^.]*)$", "($1)")))
    notes = F.concat(F.when(F.col("is_key"), F.array(F.lit("PK"))).otherwise(F.array().cast("array<string>")), F.when(F.upper("is_nullable").isin("NO", "N"), F.array(F.lit("NOT NULL"))).otherwise(F.array().cast("array<string>")), fk)
    line = F.concat(F.lit("- "), "column_name", F.lit(" "), "data_type", F.when(F.size(notes) > 0, F.concat(F.lit(" — "), F.array_join(notes, ", "))).otherwise(""), F.coalesce(F.concat(F.lit(" — "), "remark"), F.lit("")))
    body = cols.groupBy(on).agg(F.array_sort(F.collect_list(F.struct("ordinal_position", line.alias("line")))).alias("lines"))
    back = referenced_by(composite_keys(frames["foreign"])).withColumnRenamed("table", "_key")
    views = frames["views"].select(*on, F.col("view_definition"))
    out = body.join(heads, on, "left").join(views, on, "left").withColumn("_key", tx.table_key(F.col("table_name"))).join(back, "_key", "left")
    parts = F.array(
        F.concat(F.when(F.col("view_definition").isNull(), "## Table: ").otherwise("## View: "), table_of), F.col("head"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"),
        F.concat(F.lit("Referenced by: "), F.array_join("referenced_by", ", ")), F.concat(F.lit("```sql\n"), F.trim("view_definition"), F.lit("\n```")),
    )
    return out.select(table_of.alias("table_name"), F.array_join(F.array_compact(parts), "\n\n").alias("markdown"))


def referenced_by(foreign_keys: DataFrame) -> DataFrame:
    """(table, referenced_by): per table the others whose keys lead to it. ``foreign_keys``: from_table, from_columns, to_table."""
    d = foreign_keys.filter(tx.table_key("from_table") != tx.table_key("to_table"))
    return d.groupBy(tx.table_key("to_table").alias("table")).agg(F.array_sort(F.collect_set(F.format_string("%s (%s)", "from_table", "from_columns"))).alias("referenced_by"))

"""JDBC and document-store connectors, DDL and schema inference, snapshots and sync files."""

from __future__ import annotations

import json
import os
import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_$]{0,63}\Z")


def identifier(name: str) -> str:
    """``name`` quoted; anything but letters, digits, ``_`` and ``$`` is refused."""
    if not IDENTIFIER.match(name):
        raise ValueError(f"not an identifier: {name!r}")
    return f"`{name}`"


def column_type(kind: T.DataType) -> str:
    """The DDL type of a Spark type."""
    names = {T.StringType: "TEXT", T.BooleanType: "BOOLEAN", T.ByteType: "TINYINT", T.ShortType: "SMALLINT", T.IntegerType: "INT", T.LongType: "BIGINT", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.BinaryType: "LONGBLOB", T.DateType: "DATE", T.TimestampType: "DATETIME(6)", T.TimestampNTZType: "DATETIME(6)"}
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    return names.get(type(kind), "JSON")


def default_clause(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f" DEFAULT {int(value)}"
    if isinstance(value, int | float):
        return f" DEFAULT {value}"
    text = str(value)
    return f" DEFAULT {text}" if text.upper() in ("CURRENT_TIMESTAMP", "NULL") else " DEFAULT '" + text.replace("\\", "\\\\").replace("'", "''") + "'"


def create_table(name: str, schema: T.StructType, keys: list[str] = (), defaults: dict | None = None) -> str:
    """A CREATE TABLE statement for ``schema``."""
    columns = [f"  {identifier(f.name)} {column_type(f.dataType)}{'' if f.nullable and f.name not in keys else ' NOT NULL'}{default_clause((defaults or {}).get(f.name))}" for f in schema]
    if keys:
        columns.append("  PRIMARY KEY (" + ", ".join(map(identifier, keys)) + ")")
    return f"CREATE TABLE IF NOT EXISTS {identifier(name)} (\n" + ",\n".join(columns) + "\n)"


@dataclass
class JdbcConnector:
    """A JDBC source and sink; the driver's jar must be on the class path."""

    url: str
    user: str = ""
    password: str = field(default="", repr=False)
    driver: str = ""
    options: dict = field(default_factory=dict)

    def settings(self) -> dict:
        own = {"url": self.url, "user": self.user, "password": self.password, "driver": self.driver}
        return {k: v for k, v in own.items() if v} | self.options

    def read(self, spark: SparkSession, table: str, partition: str | None = None, low=None, high=None, parts: int = 32, fetch: int = 1000) -> DataFrame:
        """A scan whose filters and columns go to the source; with ``partition`` (a numeric or time column and
        its bounds) ``parts`` ranges are read side by side, so pages need no order."""
        identifier(table.split(".")[-1])
        r = spark.read.format("jdbc").options(**self.settings(), dbtable=table, fetchsize=fetch, pushDownPredicate="true")
        if partition:
            r = r.options(partitionColumn=partition, lowerBound=str(low), upperBound=str(high), numPartitions=parts)
        return r.load()

    def write(self, df: DataFrame, table: str, mode: str = "append", batch: int = 500) -> None:
        identifier(table.split(".")[-1])
        df.write.format("jdbc").options(**self.settings(), dbtable=table, batchsize=batch).mode(mode).save()

    def catalog(self, spark: SparkSession, schema: str) -> dict[str, DataFrame]:
        """Columns, keys, indexes, checks and triggers of a schema, from its information schema."""
        safe = schema.replace("'", "''")
        q = lambda view, where: spark.read.format("jdbc").options(**self.settings(), query=f"SELECT * FROM INFORMATION_SCHEMA.{view} WHERE {where} = '{safe}'").load()
        views = {"columns": ("COLUMNS", "TABLE_SCHEMA"), "keys": ("KEY_COLUMN_USAGE", "TABLE_SCHEMA"), "indexes": ("STATISTICS", "TABLE_SCHEMA"), "constraints": ("TABLE_CONSTRAINTS", "TABLE_SCHEMA"), "checks": ("CHECK_CONSTRAINTS", "CONSTRAINT_SCHEMA"), "triggers": ("TRIGGERS", "TRIGGER_SCHEMA")}
        return {k: q(*v) for k, v in views.items()}


@dataclass
class DocumentConnector:
    """A document store as JSON lines, or through a connector format if one is installed."""

    path: str
    format: str = "json"
    options: dict = field(default_factory=dict)

    def read(self, spark: SparkSession, schema: T.StructType | None = None, equals: dict | None = None) -> DataFrame:
        """Documents, filtered by equality; operators in a filter are refused."""
        for k, v in (equals or {}).items():
            if k.startswith("$") or isinstance(v, dict):
                raise ValueError(f"only equality filters: {k}")
        r = spark.read.format(self.format).options(**self.options)
        df = (r.schema(schema) if schema else r).load(self.path)
        for k, v in (equals or {}).items():
            df = df.where(F.col(k) == F.lit(v))
        return df

    def write(self, df: DataFrame, mode: str = "append") -> None:
        df.write.format(self.format).options(**self.options).mode(mode).save(self.path)


def inferred_schema(documents: DataFrame, column: str = "value") -> DataFrame:
    """(field, types, n, required): kinds of the top-level fields of JSON documents, ``|`` between them, over all documents."""
    v = documents.select(F.try_parse_json(column).alias("v")).where("v IS NOT NULL")
    n = v.count()
    pairs = v.select(F.explode(F.from_json(F.to_json("v"), "map<string,string>")).alias("field", "x"), "v")
    kind = F.when(F.col("x").isNull(), "null").when(F.col("x").rlike(r"^\{"), "object").when(F.col("x").rlike(r"^\["), "array").when(F.col("x").rlike("^(true|false)$"), "boolean").when(F.col("x").rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), "number").otherwise("string")
    return pairs.groupBy("field").agg(F.array_join(F.array_sort(F.collect_set(kind)), "|").alias("types"), F.count("*").alias("n")).withColumn("required", F.col("n") == n)


CONNECTORS = {"mysql": JdbcConnector, "mariadb": JdbcConnector, "jdbc": JdbcConnector, "mongodb": DocumentConnector, "json": DocumentConnector}


def create_connector(driver: str, **kw):
    if driver not in CONNECTORS:
        raise ValueError(f"unknown driver {driver!r}; known: {', '.join(sorted(CONNECTORS))}")
    return CONNECTORS[driver](**kw)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole UTF-8 files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


class SnapshotStore:
    """Named table snapshots with a manifest: save, load, list, delete, backup and restore."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _manifest(self) -> str:
        return os.path.join(self.root, "_manifest")

    def save(self, name: str, df: DataFrame) -> str:
        """Writes a new version; readers of older ones aren't disturbed. The manifest gets a row after the data."""
        path = os.path.join(self.root, name, f"v{time.time_ns()}")
        df.write.parquet(path)
        self.spark.createDataFrame([(name, path, time.time(), False)], "name string, path string, saved_at double, dropped boolean").coalesce(1).write.mode("append").parquet(self._manifest())
        return path

    def entries(self) -> DataFrame:
        """(name, path, saved_at), the newest version of each name, newest first."""
        try:
            m = self.spark.read.parquet(self._manifest())
        except Exception as e:  # no manifest yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "name string, path string, saved_at double")
        last = m.groupBy("name").agg(F.max(F.struct("saved_at", "path", "dropped")).alias("x")).where("NOT x.dropped")
        return last.select("name", "x.path", "x.saved_at").orderBy(F.desc("saved_at"), "name")

    def load(self, name: str) -> DataFrame | None:
        row = self.entries().where(F.col("name") == name).first()
        return self.spark.read.parquet(row["path"]) if row else None

    def exists(self, name: str) -> bool:
        return self.entries().where(F.col("name") == name).limit(1).count() > 0

    def delete(self, name: str) -> None:
        self.spark.createDataFrame([(name, "", time.time(), True)], "name string, path string, saved_at double, dropped boolean").coalesce(1).write.mode("append").parquet(self._manifest())

    def backup(self, name: str, path: str) -> None:
        df = self.load(name)
        if df is None:
            raise KeyError(name)
        df.write.parquet(path)

    def restore(self, name: str, path: str) -> str:
        return self.save(name, self.spark.read.parquet(path))


CHANGE_SCHEMA = "sequence long, entity_type string, operation string, entity_id string, payload string, vector_clock map<string,long>, changed_at timestamp_ntz, node_id string"


_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def export_sync(journal: DataFrame, path: str, version: str = "1") -> None:
    """Changes as JSON lines in ``path``/changes, and a small header beside them."""
    columns = [c.split()[0] for c in CHANGE_SCHEMA.split(", ")]
    journal.select(*columns).write.mode("overwrite").option("timestampNTZFormat", _MICROS).json(os.path.join(path, "changes"))
    spark = journal.sparkSession
    spark.createDataFrame([(json.dumps({"version": version}),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "header"))


def import_sync(spark: SparkSession, path: str) -> DataFrame:
    """The changes of an export; a header without version is refused."""
    head = spark.read.text(os.path.join(path, "header")).first()
    if not head or not json.loads(head["value"]).get("version"):
        raise ValueError("not a sync export: version is missing")
    return spark.read.schema(CHANGE_SCHEMA).option("timestampNTZFormat", _MICROS).json(os.path.join(path, "changes"))

"""Stores beside plain tables: SQLite files, vector collections, diagrams as text."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators import retrieval

#: Rows of a SQLite table that one task reads.
ROWS = 100_000
_KINDS = {"INTEGER": "bigint", "REAL": "double", "TEXT": "string", "BLOB": "binary"}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


class SqliteSource(DataSource):
    """A table of a SQLite file as a Spark source and sink: options path and table.

    Reading goes by ranges of rowid, one task each; the file must lie where all executors
    see it.  Writing appends in one transaction a task, as SQLite has one writer at a time."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with sqlite3.connect(_local(self.options["path"])) as db:
            columns = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        return ", ".join(f"`{c[1]}` {_KINDS.get(c[2].upper(), 'string')}" for c in columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(_local(self.options["path"]), self.options["table"], [f.name for f in schema])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        kinds = {"long": "INTEGER", "integer": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
        columns = [(f.name, kinds.get(f.dataType.typeName(), "TEXT")) for f in schema]
        path, name = _local(self.options["path"]), self.options["table"]
        with sqlite3.connect(path) as db:
            if overwrite:
                db.execute(f"DROP TABLE IF EXISTS {_quoted(name)}")
            db.execute(f"CREATE TABLE IF NOT EXISTS {_quoted(name)} ({', '.join(f'{_quoted(c)} {k}' for c, k in columns)})")
        return _SqliteWriter(path, name, len(columns))


class _Range(InputPartition):
    def __init__(self, first: int, stop: int):
        self.first, self.stop = first, stop


class _SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str]):
        self.path, self.table, self.columns = path, table, columns

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        return [] if low is None else [_Range(a, min(a + ROWS, high + 1)) for a in range(low, high + 1, ROWS)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with sqlite3.connect(self.path) as db:
            yield from db.execute(f"SELECT {', '.join(map(_quoted, self.columns))} FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.first, partition.stop))


class _SqliteWriter(DataSourceWriter):
    def __init__(self, path: str, table: str, width: int):
        self.path, self.table, self.width = path, table, width

    def write(self, rows) -> WriterCommitMessage:
        with sqlite3.connect(self.path, timeout=600) as db:
            db.executemany(f"INSERT INTO {_quoted(self.table)} VALUES ({', '.join('?' * self.width)})", (tuple(r) for r in rows))
        return WriterCommitMessage()


def use_sqlite(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)


class VectorStore:
    """Collections of (doc_id, embedding, text, payload, seq), a folder each below ``path``.

    The interface of a vector store: create, upsert, search, delete by payload, drop."""

    SCHEMA = "doc_id bigint, embedding array<float>, text string, payload map<string,string>, seq bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.sizes, self.now = spark, path, {}, {}

    def create(self, name: str, size: int) -> None:
        self.sizes.setdefault(name, size)
        self.now.setdefault(name, 0)

    def _folder(self, name: str) -> str:
        return f"{self.path}/collection={name}/version={self.now[name]}"

    def rows(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self._folder(name)) if self.now[name] else self.spark.createDataFrame([], self.SCHEMA)

    def _replace(self, name: str, rows: DataFrame) -> None:
        self.now[name] += 1  # a new version beside the one being read
        rows.write.parquet(self._folder(name))

    def upsert(self, name: str, documents: DataFrame) -> None:
        """Documents (doc_id, embedding, text, payload): the last of each id stays; vectors of another size are refused."""
        new = retrieval.collection(documents, self.sizes[name]).select("*", F.lit(self.now[name] + 1).cast("long").alias("seq"))
        self._replace(name, retrieval.upsert(self.rows(name), new.select(*[c.split()[0] for c in self.SCHEMA.split(", ")])))

    def search(self, name: str, query: list[float], k: int, wanted: dict[str, str] | None = None) -> DataFrame:
        return retrieval.top_k(self.rows(name), query, k, wanted)

    def delete(self, name: str, wanted: dict[str, str]) -> None:
        self._replace(name, retrieval.delete(self.rows(name), wanted))

    def drop(self, name: str) -> None:
        retrieval.delete_collection(self.spark, self.path, name)
        self.sizes.pop(name, None)
        self.now.pop(name, None)


def mermaid_diagrams(edges: DataFrame, by: str) -> DataFrame:
    """(by, body): the edges (src, dst) of each value of ``by`` as a Mermaid graph, in order."""
    line = F.concat(F.lit("  "), F.regexp_replace("src", "[^A-Za-z0-9]", "_"), F.lit(" --> "), F.regexp_replace("dst", "[^A-Za-z0-9]", "_"))
    rows = edges.groupBy(by).agg(F.array_sort(F.collect_set(line)).alias("lines"))
    return rows.select(by, F.concat(F.lit("graph TD\n"), F.array_join("lines", "\n")).alias("body"))


def diagram_page(title: Column, body: Column) -> Column:
    """A diagram as one HTML page that renders it in the browser."""
    return F.concat(F.lit("<!DOCTYPE html>\n<html><head><title>"), title, F.lit('</title></head>\n<body><pre class="mermaid">\n'), body, F.lit("\n</pre></body></html>"))


def write_files(rows: DataFrame, path: str, by: str, body: str, extension: str, most: int = 1000) -> None:
    """Text files of the rows of each value of ``by``, in a folder named after it, with that extension.

    Rows that share the value share files of ``most`` rows at most, in no order; a value that many
    rows have is written by many tasks."""
    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = rows.select(by, F.col(body).alias("value")).repartition(n, F.col(by), F.pmod(F.xxhash64("value"), F.lit(n)))
    spread.write.partitionBy(by).option("maxRecordsPerFile", most).option("lineSep", "\n").text(path)
    fs = spark._jvm.org.apache.hadoop.fs
    top = fs.Path(path)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.globStatus(fs.Path(f"{path}/*/part-*.txt")) or []:  # one name a value
        old = status.getPath()
        system.rename(old, fs.Path(old.getParent(), old.getName()[: -len(".txt")] + extension))

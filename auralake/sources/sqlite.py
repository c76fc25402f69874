"""SQLite tables as a Spark data source: ``spark.read.format("sqlite")``.

Options: ``path`` of a file that every executor can open, ``dbtable``, ``rows`` per
partition, and ``columns``, comma-separated, where not all are wanted. Partitions
are ranges of rowids that hold about ``rows`` rows each, however sparse the ids
are, and each is read by its own read-only connection in bounded batches. Types
follow SQLite's affinity rules by the declared type: a value that doesn't fit its
column's is null, as SQLite lets any column hold any value. Filters run in Spark:
a reader that takes them over keeps them for later scans of the same DataFrame.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

def affinity(declared: str | None) -> T.DataType:
    """The Spark type of a declared type, by the first rule that fits."""
    name = (declared or "").upper()
    for marks, kind in ((("INT", "BOOL"), T.LongType()), (("CHAR", "CLOB", "TEXT"), T.StringType()), (("BLOB",), T.BinaryType()), (("REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL"), T.DoubleType())):
        if any(m in name for m in marks):
            return kind
    return T.StringType()


def fitted(value, kind: T.DataType):
    """A stored value as its column's type, or null."""
    try:
        if value is None or isinstance(kind, T.BinaryType):
            return value if value is None or isinstance(value, bytes) else str(value).encode()
        if isinstance(kind, T.StringType):
            return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
        if isinstance(kind, T.DoubleType):
            return float(value)
        return value if isinstance(value, int) else int(value) if float(value).is_integer() else None
    except (TypeError, ValueError, OverflowError):
        return None


def _name(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


class Span(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{quote(self.options['path'])}?mode=ro", uri=True, timeout=30)

    def schema(self) -> T.StructType:
        with self._open() as connection:
            columns = connection.execute(f"PRAGMA table_info({_name(self.options['dbtable'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['dbtable']}")
        wanted = {c.strip() for c in self.options["columns"].split(",")} if "columns" in self.options else None
        return T.StructType([T.StructField(c[1], affinity(c[2])) for c in columns if wanted is None or c[1] in wanted])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(self, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, source: SqliteSource, schema: T.StructType):
        self.source, self.schema = source, schema

    def partitions(self) -> list[InputPartition]:
        table, each = _name(self.source.options["dbtable"]), int(self.source.options.get("rows", 1_000_000))
        with self.source._open() as connection:
            try:
                cuts, low = [], connection.execute(f"SELECT min(rowid) FROM {table}").fetchone()[0]
                while low is not None:
                    cuts.append(low)
                    after = connection.execute(f"SELECT rowid FROM {table} WHERE rowid >= ? ORDER BY rowid LIMIT 1 OFFSET ?", [low, each]).fetchone()
                    low = after[0] if after else None
            except sqlite3.OperationalError:  # a table without rowids is read as one
                return [Span(None, None)]
        return [Span(a, b) for a, b in zip(cuts, [*cuts[1:], None], strict=False)] or [Span(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        names = ", ".join(_name(f.name) for f in self.schema.fields)
        sql, values = f"SELECT {names} FROM {_name(self.source.options['dbtable'])}", []
        for bound, sign in ((partition.low, ">="), (partition.high, "<")):
            if bound is not None:
                sql, values = sql + (" AND" if values else " WHERE") + f" rowid {sign} ?", [*values, bound]
        kinds = [{T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.BinaryType(): pa.binary()}.get(f.dataType, pa.string()) for f in self.schema.fields]
        with self.source._open() as connection:
            cursor = connection.execute(sql, values)
            while rows := cursor.fetchmany(10_000):
                columns = [[fitted(v, f.dataType) for v in c] for c, f in zip(zip(*rows, strict=True), self.schema.fields, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=self.schema.fieldNames())


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(SqliteSource)

"""Table maintenance: counts, integrity, resets, rewrites, merges, publishing.

Tables are Parquet folders under one root, and a commit is a small file that
says which folder is which table. A change writes new folders, of any number of
tables, and then moves one commit file into its place, so readers see all the
old rows or all the new ones, whenever the writer stops. Paths are Hadoop paths:
nothing here opens a local file.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralake.operators.relational import overwrite_columns

# Tables that can be computed again, and those that a reset must keep.
REBUILDABLE = ["fingerprints", "track_embeddings", "track_features", "melody_contours", "recording_fingerprints", "recording_sub_hashes", "albums", "artists", "shelves"]
PRESERVED = ["tracks", "history", "local_playlists", "recording_splits", "canonical_metadata", "drops", "friends", "track_lyrics"]
# Columns of a track that belong to its user, and tables that are taken over whole.
USER_COLUMNS = ["isLiked", "isDownloaded", "isCached", "localFilePath", "playCount", "lastPlayedTimestamp", "addedTimestamp", "isLibrary", "contentHash"]
USER_TABLES = ["history", "local_playlists", "recording_splits", "canonical_metadata", "drops"]


class Store:
    """Tables under a root that any executor can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _commits(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("_commits") if not n.startswith(".") and n.endswith(".json")]

    def _state(self, commit: int | None = None) -> dict[str, str]:
        """The folder of each table, by the newest commit or the one named."""
        known = self._commits()
        if not known:
            return {}
        file = self._fs.open(self._path(f"{self.root}/_commits/{known[-1] if commit is None else commit:020}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        finally:
            file.close()

    def path(self, name: str) -> str:
        """Where the rows of a table are now."""
        return f"{self.root}/{self._state()[name]}"

    def exists(self, name: str) -> bool:
        return name in self._state()

    def tables(self) -> list[str]:
        return sorted(self._state())

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """A table; one that doesn't exist is empty if its schema is given."""
        if schema is not None and not self.exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(self.path(name))

    def ensure(self, name: str, schema: str) -> bool:
        """Create an empty table where there is none; whether that was so."""
        if self.exists(name):
            return False
        self.publish(name, self.spark.createDataFrame([], schema))
        return True

    def write(self, name: str, df: DataFrame) -> tuple[str, int]:
        """Rows in a folder of their own, which no commit names yet, and their number as written."""
        folder = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return folder, self.spark.read.parquet(f"{self.root}/{folder}").count()

    def commit(self, folders: dict[str, str | None]) -> None:
        """Point tables at new folders, all in one step; a table without a folder goes.

        Raises if another writer was faster. The rows of the commit before stay for its readers.
        """
        known = self._commits()
        state = {n: f for n, f in {**self._state(), **folders}.items() if f is not None}
        fresh, number = self._path(f"{self.root}/_commits/.{uuid.uuid4().hex}"), known[-1] + 1 if known else 0
        file = self._fs.create(fresh)
        file.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        file.close()
        at = self._path(f"{self.root}/_commits/{number:020}.json")
        if self._fs.exists(at) or not self._fs.rename(fresh, at):
            raise RuntimeError(f"commit {number} of {self.root} was taken by another writer")
        self._sweep([*known, number])

    def _sweep(self, commits: list[int]) -> None:
        """Delete what only commits before the last two name; a stop in between leaves it for the next."""
        kept = {f for c in commits[-2:] for f in self._state(c).values()}
        for old in commits[:-2]:
            for folder in set(self._state(old).values()) - kept:
                self._fs.delete(self._path(f"{self.root}/{folder}"), True)
            self._fs.delete(self._path(f"{self.root}/_commits/{old:020}.json"), False)

    def publish(self, name: str, df: DataFrame) -> int:
        """Replace a table by rows that may come from itself; returns their number as written."""
        folder, n = self.write(name, df)
        self.commit({name: folder})
        return n

    def drop(self, name: str) -> bool:
        there = self.exists(name)
        if there:
            self.commit({name: None})
        return there


def counts(tables: dict[str, DataFrame | None]) -> DataFrame:
    """(table, rows) in one job; a table that is missing counts as null."""
    out = None
    for name, df in tables.items():
        if df is None:
            continue
        part = df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        out = part if out is None else out.unionByName(part)
    gone = [name for name, df in tables.items() if df is None]
    if gone:
        spark = next(df for df in tables.values() if df is not None).sparkSession
        out = out.unionByName(spark.createDataFrame([(n, None) for n in gone], "table string, rows long"))
    return out


def integrity(df: DataFrame, name: str, key: list[str], required: list[str], parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """(table, problem, rows): repeated keys, nulls in required columns, references to nothing; sound checks have 0 rows."""
    label = lambda p, n: (F.lit(name).alias("table"), F.lit(p).alias("problem"), n.cast("long").alias("rows"))
    out = df.groupBy(*key).count().where("count > 1").agg(*label("repeated key", F.count("*")))
    out = out.unionByName(df.agg(*label("null in a required column", F.count_if(F.greatest(*[F.col(c).isNull() for c in required], F.lit(False))))))
    for column, parent in (parents or {}).items():
        lost = df.where(F.col(column).isNotNull()).join(parent.select(F.col(parent.columns[0]).alias(column)), column, "left_anti")
        out = out.unionByName(lost.agg(*label(f"{column} refers to nothing", F.count("*"))))
    return out


def rewrite(df: DataFrame, clustered_by: list[str], unique: list[str]) -> DataFrame:
    """Rows clustered by range and sorted, as an index-organised table keeps them; equal keys become one."""
    return df.dropDuplicates(unique).repartitionByRange(*clustered_by).sortWithinPartitions(*clustered_by)


def merge_user_data(store: Store, phone: Store, key: str = "id") -> DataFrame:
    """The phone's user columns and tables win; (what, rows) tells what was done.

    Every matched track takes the phone's values, nulls included. Tables that the phone lacks stay.
    """
    tracks, theirs = store.read("tracks"), phone.read("tracks")
    columns = [c for c in USER_COLUMNS if c in tracks.columns and c in theirs.columns]
    told = [("tracks_only_on_phone", theirs.join(tracks.select(key), key, "left_anti").count()), ("tracks_matched", theirs.join(tracks.select(key), key, "left_semi").count())]
    store.publish("tracks", overwrite_columns(tracks, theirs, key, columns))
    for name in USER_TABLES:
        if phone.exists(name):
            told.append((name, store.publish(name, phone.read(name))))
    return store.spark.createDataFrame(told, "what string, rows long")


def reset_derived(store: Store, keep: list[str] | None = None) -> DataFrame:
    """Empty every table that can be rebuilt; (table, rows) that went."""
    told = []
    for name in REBUILDABLE:
        if name in (keep or []) or not store.exists(name):
            continue
        df = store.read(name)
        told.append((name, df.count()))
        store.publish(name, df.where("false"))
    return store.spark.createDataFrame(told, "table string, rows long")


def recover(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """Every row that can still be read, files that are damaged or gone left out, equal keys once."""
    return spark.read.schema(schema).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(path).dropDuplicates(keys)


def repair(store: Store, name: str, schema: str, keys: list[str]) -> DataFrame:
    """Rewrite a table from what can be read of it; (table, files, unreadable, recovered).

    ``recovered`` are rows as written; ``unreadable`` are files whose rows, of a number unknown, are lost.
    """
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    spark, path = store.spark, store.path(name)
    names = [f for f in store._names(path.removeprefix(store.root + "/")) if f.endswith(".parquet")]

    def sound(file: str) -> bool:
        try:
            spark.read.schema(schema).parquet(f"{path}/{file}").write.format("noop").mode("overwrite").save()
            return True
        except (PySparkException, Py4JJavaError):
            return False

    lost = [f for f in names if not sound(f)]
    n = store.publish(name, recover(spark, path, schema, keys))
    return spark.createDataFrame([(name, len(names), len(lost), n)], "table string, files long, unreadable long, recovered long")


def rewrite_table(store: Store, name: str, clustered_by: list[str], unique: list[str]) -> int:
    """``rewrite`` a table in place; raises, and leaves the old rows, unless every key is still there."""
    old = store.read(name)
    folder, n = store.write(name, rewrite(old, clustered_by, unique))
    wanted = old.select(*unique).distinct().count()
    if n != wanted:
        raise RuntimeError(f"{name}: {n} rows written for {wanted} keys")
    store.commit({name: folder})
    return n

"""Tables that change by whole snapshots: folders per commit, and a manifest written last.

A store is a folder. `data/<commit>/<table>/bucket=<n>` holds the rows a commit wrote, and
`manifest/<version>.json` names, for every table and bucket, the commits whose rows count. A
commit writes new folders only and becomes visible by one rename of its manifest, which
fails where another writer came first. So readers see all tables of a version or none of it, a writer that
fails leaves the old version as it was, and older versions stay readable until `vacuum`.

Rows are dealt to buckets by a hash of their key; how many, is chosen from the size of the table
when it is created, kept in the manifest, and raised by `rebucket`. Each bucket is a folder to write, to list and to name in
every manifest, so no more than `MAX_BUCKETS` are chosen; beyond that they hold more rows, in several files. A replacement rewrites the
buckets of its scope, and a read of some keys scans their buckets alone. A bucket that one large
key fills is split into several files. Keys may be null; a null is a key like others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 256
BUCKET = "bucket"


class Conflict(RuntimeError):
    """Another writer has committed since this one began."""


@dataclass(frozen=True)
class Layout:
    """A table in a manifest: its key, number of buckets, schema, and the commits of each bucket."""

    key: str
    buckets: int
    schema: str
    folders: dict[int, tuple[str, ...]]

    def to_json(self) -> dict:
        return {"key": self.key, "buckets": self.buckets, "schema": json.loads(self.schema), "folders": {str(b): list(f) for b, f in self.folders.items()}}

    @staticmethod
    def from_json(found: dict) -> Layout:
        folders = {int(b): tuple(f) for b, f in found["folders"].items()}
        return Layout(found["key"], found["buckets"], json.dumps(found["schema"]), folders)


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    where, fs = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    return [int(n[:-5]) for n in _names(spark, f"{root}/manifest") if n.endswith(".json") and n[:-5].isdigit()]


def manifest(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict[str, Layout]]:
    """The tables of a version, the newest by default; version 0 is the empty store."""
    known = versions(spark, root)
    version = max(known, default=0) if version is None else version
    if version == 0:
        return 0, {}
    where, fs = _files(spark, f"{root}/manifest/{version:012d}.json")
    stream = fs.open(where)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return version, {name: Layout.from_json(table) for name, table in json.loads(text).items()}


def bucket_of(key: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, root: str, name: str, table: Layout, wanted: set[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(table.schema))
    chosen = [(b, f) for b, commits in table.folders.items() if wanted is None or b in wanted for f in commits]
    if not chosen:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/data/{f}/{name}/{BUCKET}={b}" for b, f in chosen])


def read(spark: SparkSession, root: str, name: str, keys: Sequence | None = None, version: int | None = None) -> DataFrame:
    """A table, or its rows of a few keys, for which their buckets alone are listed and scanned."""
    table = manifest(spark, root, version)[1][name]
    if keys is None:
        return _read(spark, root, name, table)
    schema = T.StructType.fromJson(json.loads(table.schema))
    key = schema[table.key]
    asked = spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(table.key, key.dataType)]))
    wanted = {r[0] for r in asked.select(bucket_of(table.key, table.buckets)).distinct().collect()}
    match = F.col(table.key).isin([k for k in keys if k is not None])
    return _read(spark, root, name, table, wanted).where(match | F.col(table.key).isNull() if None in keys else match)


def read_scope(spark: SparkSession, root: str, name: str, scope: DataFrame, version: int | None = None) -> DataFrame:
    """The rows of a table whose key is in `scope`, from the buckets of these keys alone."""
    table = manifest(spark, root, version)[1][name]
    named = scope.select(F.col(table.key).alias("_wanted")).distinct()
    touched = {r[0] for r in named.select(bucket_of("_wanted", table.buckets)).distinct().collect()}
    rows = _read(spark, root, name, table, touched)
    return rows.join(named, rows[table.key].eqNullSafe(named["_wanted"]), "left_semi")


@dataclass
class Commit:
    """Changes to the tables of a store that become visible together, by `finish`."""

    spark: SparkSession
    root: str
    base: int
    tables: dict[str, Layout]
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def _written(self, name: str, rows: DataFrame, key: str, buckets: int) -> list[int]:
        """Write rows under this commit; returns the buckets that have any."""
        self.part = getattr(self, "part", 0) + 1
        folder = f"{self.root}/data/{self.name}-{self.part}/{name}"
        rows.withColumn(BUCKET, bucket_of(key, buckets)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(folder)
        return [int(n.split("=")[1]) for n in _names(self.spark, folder) if n.startswith(f"{BUCKET}=")]

    @property
    def _folder(self) -> str:
        return f"{self.name}-{self.part}"

    def create(self, name: str, rows: DataFrame, key: str, buckets: int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
        buckets = buckets or min(MAX_BUCKETS, max(1, -(-rows.count() // rows_per_bucket)))
        found = self._written(name, rows, key, buckets)
        self.tables[name] = Layout(key, buckets, rows.schema.json(), {b: (self._folder,) for b in found})

    def append(self, name: str, rows: DataFrame) -> None:
        table = self.tables[name]
        found = self._written(name, self._fitted(rows, table), table.key, table.buckets)
        folders = table.folders | {b: (*table.folders.get(b, ()), self._folder) for b in found}
        self.tables[name] = Layout(table.key, table.buckets, table.schema, folders)

    def replace(self, name: str, new: DataFrame, scope: DataFrame) -> None:
        """Exchange all rows whose key is in `scope` for the new ones; keys without new rows lose theirs."""
        table = self.tables[name]
        named = scope.select(table.key).distinct()
        touched = {r[0] for r in named.select(bucket_of(table.key, table.buckets)).distinct().collect()}  # at most `buckets` numbers
        old = _read(self.spark, self.root, name, table, touched)
        wanted = named.select(F.col(table.key).alias("_wanted"))
        kept = old.join(wanted, old[table.key].eqNullSafe(wanted["_wanted"]), "left_anti")
        found = self._written(name, kept.unionByName(self._fitted(new, table)), table.key, table.buckets)
        folders = {b: f for b, f in table.folders.items() if b not in touched}
        folders |= {b: (*folders.get(b, ()), self._folder) for b in found}
        self.tables[name] = Layout(table.key, table.buckets, table.schema, folders)

    def rebucket(self, name: str, buckets: int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
        """Deal a table anew, to a number of buckets that fits its size now; appended pieces become one."""
        table = self.tables[name]
        self.create(name, _read(self.spark, self.root, name, table), table.key, buckets, rows_per_bucket)

    def _fitted(self, rows: DataFrame, table: Layout) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(table.schema))
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])

    def finish(self) -> int:
        """Make the commit visible and return its version."""
        version = self.base + 1
        text = json.dumps({name: table.to_json() for name, table in self.tables.items()})
        draft, fs = _files(self.spark, f"{self.root}/manifest/.{self.name}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        target, _ = _files(self.spark, f"{self.root}/manifest/{version:012d}.json")
        gateway = self.spark.sparkContext._gateway
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs.Options, "Rename"), 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(target), options)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(target):
                raise Conflict(f"version {version} of {self.root} is there already") from e
            raise
        return version


def begin(spark: SparkSession, root: str) -> Commit:
    base, tables = manifest(spark, root)
    return Commit(spark, root, base, dict(tables))


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove manifests older than the last `keep`, and folders no kept manifest names. No writer may be at work."""
    known = versions(spark, root)
    kept = known[-keep:]
    named = {f for v in kept for table in manifest(spark, root, v)[1].values() for commits in table.folders.values() for f in commits}
    gone = [f"manifest/{v:012d}.json" for v in known[:-keep]] + [f"data/{n}" for n in _names(spark, f"{root}/data") if n not in named]
    for name in gone:
        where, fs = _files(spark, f"{root}/{name}")
        fs.delete(where, True)
    return gone

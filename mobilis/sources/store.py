"""Several tables that change together, bucket by bucket.

A store is a folder below which every commit writes new files and nothing is changed in
place.  ``pointers/<n>`` names, for each table, the commits whose files are current; it is
created only after all files are there, and creating a file that exists fails.  So a reader
sees all tables of a commit or none, a writer that dies leaves files that no pointer names,
and of two writers on one state the second is told.

Keyed tables are cut into buckets by a hash of their key: a commit rewrites the buckets
that its rows touch, and a lookup opens the buckets of its keys.  Logs only grow.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Commits whose files stay for readers that still hold them.
KEPT = 2


class Conflict(Exception):
    """Another writer has committed on the same state."""


@dataclass
class State:
    """What a pointer names: of each keyed table the commit of each bucket, of each log its commits in order."""

    version: int = 0
    buckets: int = 16
    keyed: dict[str, dict[str, str]] = field(default_factory=dict)
    logs: dict[str, list[str]] = field(default_factory=dict)
    facts: dict[str, str] = field(default_factory=dict)


class Store:
    """``tables`` gives each table its schema and its key columns; a table without a key is a log."""

    def __init__(self, spark: SparkSession, folder: str, tables: Mapping[str, tuple[str | StructType, list[str]]], buckets: int = 16, bloom: Mapping[str, str] | None = None, row_group: int = 1 << 22):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.schemas = {name: ddl if isinstance(ddl, StructType) else StructType.fromDDL(ddl) for name, (ddl, _) in tables.items()}
        self.keys = {name: key for name, (_, key) in tables.items()}
        #: A column a table whose values the files keep as a bloom filter.
        self.bloom, self.row_group = dict(bloom or {}), row_group

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        files, at = self._files(), self._path(*parts)
        return [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []

    def _pointer(self, n: int) -> State | None:
        stream = self._files().open(self._path("pointers", str(n)))
        try:
            raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return State(**json.loads(raw))
        except ValueError:  # still being written: not there yet
            return None

    def state(self) -> State:
        """The newest state; a reader that holds it sees it whole while two more commits come."""
        for n in sorted((int(x) for x in self._names("pointers") if x.isdigit()), reverse=True):
            if found := self._pointer(n):
                return found
        return State(buckets=self.buckets)

    def bucket(self, key: list[str], state: State) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(state.buckets)).cast("int")

    def touched(self, name: str, rows: DataFrame, state: State, key: list[str] | None = None) -> list[int]:
        """The buckets that hold the keys of ``rows``: at most as many numbers as there are buckets."""
        found = rows.select(self.bucket(key or self.keys[name], state).alias("b")).distinct().collect()
        return sorted(r.b for r in found)

    def paths(self, name: str, state: State, buckets: list[int] | None = None) -> list[str]:
        if not self.keys[name]:
            return [f"{self.folder}/data/{commit}/{name}" for commit in state.logs.get(name, [])]
        own = state.keyed.get(name, {})
        wanted = own if buckets is None else [str(b) for b in buckets if str(b) in own]
        return [f"{self.folder}/data/{own[b]}/{name}/_bucket={b}" for b in wanted]

    def read(self, name: str, state: State | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table as it was in a state, or some of its buckets."""
        paths = self.paths(name, state or self.state(), buckets)
        if not paths:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*paths)

    def lookup(self, name: str, keys: DataFrame, state: State | None = None) -> DataFrame:
        """Rows of the keys, from their buckets only."""
        state = state or self.state()
        return self.read(name, state, self.touched(name, keys, state)).join(keys.distinct(), self.keys[name], "left_semi")

    def find(self, name: str, keys: list[tuple], state: State | None = None) -> DataFrame:
        """Rows of a few keys that the caller names: the files of their buckets are opened, and row groups whose filter knows a key are read."""
        state = state or self.state()
        first, schema = self.keys[name][0], StructType([f for f in self.schemas[name].fields if f.name in self.keys[name]])
        wanted = self.spark.createDataFrame(keys, schema)
        rows = self.read(name, state, self.touched(name, wanted, state)).where(F.col(first).isin([k[0] for k in keys]))
        return rows if len(self.keys[name]) == 1 else rows.join(F.broadcast(wanted.distinct()), self.keys[name], "left_semi")

    def _written(self, commit: str, name: str, rows: DataFrame, state: State) -> list[str]:
        where = f"{self.folder}/data/{commit}/{name}"
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schemas[name].fields])
        if not self.keys[name]:
            rows.write.parquet(where)
            return []
        # a bucket is a file; one that is too large for a task becomes several
        dealt = rows.withColumn("_bucket", self.bucket(self.keys[name], state)).hint("rebalance", F.col("_bucket"))
        writer = dealt.sortWithinPartitions("_bucket", *self.keys[name]).write.partitionBy("_bucket")
        if column := self.bloom.get(name):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option("parquet.block.size", str(self.row_group))
        writer.parquet(where)
        return [x.removeprefix("_bucket=") for x in self._names("data", commit, name) if x.startswith("_bucket=")]

    def commit(self, base: State, keyed: Mapping[str, tuple[DataFrame, list[int]]] | None = None, logs: Mapping[str, DataFrame] | None = None, facts: Mapping[str, str] | None = None) -> State:
        """Publish new content of whole buckets and new rows of logs, all or nothing.

        ``keyed`` gives the rows of the listed buckets, which replace them; ``facts`` are
        words of the state that change with it.  Raises ``Conflict`` if ``base`` is not the
        newest state any more; the caller reads again and repeats.
        """
        name = uuid.uuid4().hex
        new = State(base.version + 1, base.buckets, {t: dict(b) for t, b in base.keyed.items()}, {t: list(c) for t, c in base.logs.items()}, {**base.facts, **(facts or {})})
        for table, (rows, buckets) in (keyed or {}).items():
            own = new.keyed.setdefault(table, {})
            for b in buckets:
                own.pop(str(b), None)
            own.update(dict.fromkeys(self._written(name, table, rows, base), name))
        for table, rows in (logs or {}).items():
            self._written(name, table, rows, base)
            new.logs.setdefault(table, []).append(name)
        return self._done(new, name)

    def compact(self, table: str) -> State:
        """The files of a log as those of one commit."""
        base, name = self.state(), uuid.uuid4().hex
        self._written(name, table, self.read(table, base), base)
        new = State(base.version + 1, base.buckets, base.keyed, {**base.logs, table: [name]}, base.facts)
        return self._done(new, name)

    def _done(self, state: State, commit: str) -> State:
        try:
            self._publish(state)
        except Conflict:
            self._files().delete(self._path("data", commit), True)
            raise
        self._forget(state)
        return state

    def _publish(self, state: State) -> None:
        at = self._path("pointers", str(state.version))
        raw = json.dumps(state.__dict__).encode()
        try:
            out = self._files().create(at, False)
        except Exception as error:  # noqa: BLE001 - told apart by what is there
            if self._files().exists(at):
                raise Conflict(f"version {state.version} of {self.folder} is there") from error
            raise
        out.write(raw)
        out.close()

    def _named(self, n: int) -> set[str]:
        """The folders that a pointer names."""
        if str(n) not in self._names("pointers") or not (state := self._pointer(n)):
            return set()
        return {f"data/{c}/{t}/_bucket={b}" for t, own in state.keyed.items() for b, c in own.items()} | {f"data/{c}/{t}" for t, commits in state.logs.items() for c in commits}

    def _forget(self, state: State) -> None:
        """Remove what only states older than the ``KEPT`` last ones name."""
        old = state.version - KEPT
        if old < 1:
            return
        kept = set().union(*(self._named(n) for n in range(old + 1, state.version + 1)))
        for folder in self._named(old) - kept:
            self._files().delete(self._path(*folder.split("/")), True)
        self._files().delete(self._path("pointers", str(old)), False)


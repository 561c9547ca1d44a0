"""A versioned table with a change marker: puts, scans, reading since a version, and readers that keep the last good one."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

#: Seconds after which a reader reads anew although the marker stands still, between two looks at the marker, and after
#: a failure.
REREAD, LOOK, RETRY = 60.0, 2.0, 10.0
#: Rows of the future that a table with a bound takes.
MOST = 500


class Full(Exception):
    """There is no room for another new row; rows that are there can still be corrected."""


class Versioned:
    """Rows by key, last write wins, in a folder that driver and executors share.

    A put writes its rows as Parquet files under a name of its own, and then a commit: a small file named by the next
    version, which is created only if no such file is there. So a put is seen as a whole or not at all, a put that fails
    on the way is never seen, and of two that commit at once one takes the next version. The marker is the largest
    version: asking for it lists commits and reads no data. A scan reads the files of the commits since the last
    snapshot, and takes the last row of each key.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: list[str]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        self._jvm = spark.sparkContext._jvm
        self._folder = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        self._fs = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._folder)

    def versions(self) -> list[int]:
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(self._folder) if f.getPath().getName().isdigit())

    def marker(self) -> int:
        """The version of the last commit; 0 before the first."""
        return max(self.versions(), default=0)

    def _commit(self, what: dict) -> int:
        while True:
            version = self.marker() + 1
            try:
                out = self._fs.create(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{version}"), False)
            except Exception as e:  # another writer was first
                if version in self.versions():
                    continue
                raise e
            out.write(bytearray(json.dumps(what).encode()))
            out.close()
            return version

    def commits(self, after: int = 0, upto: int | None = None) -> list[dict]:
        own = [v for v in self.versions() if after < v and (upto is None or v <= upto)]
        if not own:
            return []
        rows = self.spark.read.text([f"{self.path}/commits/{v}" for v in own], wholetext=True).select(F.input_file_name(), "value").collect()
        return sorted(({"version": int(r[0].rsplit("/", 1)[1]), **json.loads(r[1])} for r in rows), key=lambda c: c["version"])

    def _write(self, rows: DataFrame, gone: Column, **what: object) -> int:
        name = uuid.uuid4().hex
        rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema), gone.alias("_gone")).write.parquet(f"{self.path}/data/{name}")
        return self._commit({"data": name, **what})

    def put(self, rows: DataFrame, once: str | None = None, future: Column | None = None, most: int = MOST) -> int:
        """Writes rows, the last of each key's should be the only one, and returns their version.

        once: a name under which this put is made one time only, such as a stream's batch; again, it returns the version
        that it had. future: rows of the future; if a put would bring more than `most` of them by new keys, it is refused
        as Full as a whole, while rows whose keys are there are always taken."""
        if once is not None and (had := next((c["version"] for c in self.commits() if c.get("once") == once), None)):
            return had
        if future is not None:
            now = self.scan()
            new = rows.join(now.select(*self.key), self.key, "left_anti").where(future).count()
            if new and now.where(future).join(rows.select(*self.key), self.key, "left_anti").count() + rows.where(future).count() > most:
                raise Full(f"the table holds {most} rows of the future at most")
        return self._write(rows, F.lit(False), once=once)

    def put_some(self, rows: DataFrame, future: Column, order: list[str], once: str | None = None, most: int = MOST) -> int:
        """put(), but of new rows of the future only as many as there is room for, the first ones by order, are taken."""
        now = self.scan()
        known = rows.join(now.select(*self.key), self.key, "left_semi")
        new = rows.join(now.select(*self.key), self.key, "left_anti")
        room = max(0, most - now.where(future).count())
        taken = new.where(future).orderBy(*order, *self.key).limit(room)
        return self.put(known.unionByName(taken).unionByName(new.where(~F.coalesce(future, F.lit(False)))), once)

    def delete(self, keys: DataFrame) -> int:
        rows = keys.select(*(F.col(f.name).alias(f.name) if f.name in self.key else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema))
        return self._write(rows, F.lit(True))

    def snapshot(self) -> int:
        """The table as it is, written as one commit that later scans begin with; a commit made meanwhile stays after it."""
        at = self.marker()
        return self._write(self.scan(at), F.lit(False), base=at)

    def _rows(self, commits: list[dict]) -> DataFrame:
        """The last row of each key that these commits wrote, with _gone and the version of its commit."""
        kind = StructType([*self.schema.fields, StructField("_gone", BooleanType())])
        if not commits:
            return self.spark.createDataFrame([], kind).withColumn("_version", F.lit(0))
        at = F.create_map(*(F.lit(x) for c in commits for x in (c["data"], c["base"] if "base" in c else c["version"])))
        rows = self.spark.read.schema(kind).parquet(*(f"{self.path}/data/{c['data']}" for c in commits))
        rows = rows.withColumn("_version", at[F.element_at(F.split(F.input_file_name(), "/"), -2)])
        last = Window.partitionBy(*self.key).orderBy(F.desc("_version"))
        return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")

    def scan(self, version: int | None = None) -> DataFrame:
        """The table at a version, the last one unless given."""
        commits = self.commits(0, version)
        base = max((c for c in commits if "base" in c), key=lambda c: c["base"], default=None)
        if base:
            commits = [base, *(c for c in commits if c["version"] > base["base"] and "base" not in c)]
        return self._rows(commits).where("NOT _gone").select(*self.schema.names)

    def since(self, version: int) -> DataFrame:
        """What was put or deleted after a version: the last row of each key, _gone true where it was deleted."""
        return self._rows([c for c in self.commits(version) if "base" not in c]).drop("_version")

    def follow(self, stream: DataFrame, state: str) -> None:
        """Puts each batch of a stream once, however often it is run after a restart."""

        def write(batch: DataFrame, k: int) -> None:
            self.put(batch.dropDuplicates(self.key), once=f"{state}:{k}")

        stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


class Reader:
    """The last good version of a table, for whoever asks often.

    At most every `look` seconds the marker is asked for, and the table read anew if it moved; every `reread` seconds it
    is read all the same, as what is deleted by hand moves no marker. If asking or reading fails, what was read last is
    answered, and the next try waits `retry` seconds. A clock that was set back is taken for time that has passed.
    """

    def __init__(self, table: Versioned, reread: float = REREAD, look: float = LOOK, retry: float = RETRY, clock: Callable[[], float] = time.time):
        self.table, self.reread, self.look, self.retry, self.clock = table, reread, look, retry, clock
        self.version, self.rows = 0, table.spark.createDataFrame([], table.schema)
        self._read_at: float | None = None
        self._looked, self._wait, self._pause = 0.0, reread, look

    def _due(self, since: float, wait: float) -> bool:
        gone = self.clock() - since
        return gone < 0 or gone >= wait

    def current(self) -> tuple[int, DataFrame]:
        """(version, rows) of the last good reading."""
        due = self._read_at is None or self._due(self._read_at, self._wait)
        if not due and self._due(self._looked, self._pause):
            self._looked = self.clock()
            try:
                due, self._pause = self.table.marker() != self.version, self.look
            except Exception:  # the marker can't be had: what was read holds
                self._pause = self.retry
        if due:
            self._read()
        return self.version, self.rows

    def _read(self) -> None:
        try:
            version = self.table.marker()
            rows = self.table.scan(version)
            rows.limit(1).count()
        except (PySparkException, OSError, RuntimeError):
            self._wait = self._pause = min(self.retry, self.reread)
        else:
            self.version, self.rows, self._wait, self._pause = version, rows, self.reread, self.look
        self._read_at = self._looked = self.clock()

"""Versioned tables: each commit is a new folder, made visible by one small file written last.

What belongs to one run is written under one version, so a reader sees all of it
or none.  A commit names the tables it replaces; the others stay as they were and
are not copied.  Logs (events, runs, attempts) only grow: a commit writes its new
rows, whatever the size of the log.  A bucketed table is cut by a hash of its key,
and a commit writes the buckets it changes; the others stay where they are.  There
is one writer at a time.  Folders of a commit that failed half way are never
pointed to, and the next commit replaces them.  Pointers are folded into one file
now and then, and ``forget`` removes what no reader of the present can reach.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "version long, batch_key string, tables array<string>, buckets map<string,array<int>>, takes_over map<string,long>"
FOLD = 64  # pointer files that are read one by one, at most
BUCKETS = 256


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket of a key: the same at every time."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class VersionedTables:
    """A group of parquet tables and logs under ``root`` that are committed together."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _files(self):
        """The file system of ``root`` and a function that makes its paths."""
        jvm = self.spark.sparkContext._jvm
        path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        files, path = self._files()
        return sorted(s.getPath().getName() for s in files.listStatus(path(folder))) if files.exists(path(folder)) else []

    def _pointers(self) -> DataFrame | None:
        folded = [n for n in self._names("_folded") if n.startswith("upto=") and "_SUCCESS" in self._names(f"_folded/{n}")]
        last = max((int(n.split("=")[1]) for n in folded), default=0)
        rows = None
        try:
            rows = self.spark.read.schema(_POINTER).json(f"{self.root}/_commits").where(F.col("version") > last)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":  # anything else must not look like an empty store
                raise
        if not last:
            return rows
        old = self.spark.read.schema(_POINTER).parquet(f"{self.root}/_folded/upto={last}")
        return old if rows is None else old.union(rows)

    def current(self, table: str | None = None) -> int | None:
        """Latest committed version, or the latest that holds a table."""
        pointers = self._pointers()
        if pointers is None:
            return None
        if table is not None:
            pointers = pointers.where(F.array_contains("tables", table))
        return pointers.agg(F.max("version")).first()[0]

    def has_batch(self, batch_key: str) -> bool:
        """Whether a batch was committed before, which makes repeated delivery harmless."""
        pointers = self._pointers()
        return pointers is not None and not pointers.where(F.col("batch_key") == batch_key).isEmpty()

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """A table as of its latest version, or as written by one version."""
        places = self.bucket_versions(table, version)
        if places:
            return self._buckets(table, places)
        version = self.current(table) if version is None else version
        return None if version is None else self.spark.read.parquet(f"{self.root}/v{version}/{table}")

    def bucket_versions(self, table: str, version: int | None = None) -> dict[int, int]:
        """The version that each bucket of a table was last written by, as of ``version``; one entry for each bucket in use."""
        pointers = self._pointers()
        if pointers is None:
            return {}
        upto = pointers if version is None else pointers.where(F.col("version") <= version)
        rows = upto.select("version", F.explode(F.try_element_at("buckets", F.lit(table))).alias("bucket"))
        return {r["bucket"]: r["version"] for r in rows.groupBy("bucket").agg(F.max("version").alias("version")).collect()}

    def _buckets(self, table: str, places: dict[int, int]) -> DataFrame:
        paths = [f"{self.root}/{table}/written={v}/bucket={b}" for b, v in sorted(places.items())]
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*paths).drop("written", "bucket")

    def read_buckets(self, table: str, buckets: list[int]) -> DataFrame | None:
        """The rows of some buckets of a table; null if none of them was ever written."""
        places = {b: v for b, v in self.bucket_versions(table).items() if b in set(buckets)}
        return self._buckets(table, places) if places else None

    def differences(self, table: str, older: int, newer: int, key: str) -> DataFrame:
        """Rows of a bucketed table that were inserted, changed or removed between two versions: key, change, old_hash, new_hash.

        Buckets that neither version has written anew are the same files and are not read; rows of the others meet on
        the key and are compared by a hash of all their columns.
        """
        old, new = self.bucket_versions(table, older), self.bucket_versions(table, newer)
        moved = [b for b in {*old, *new} if old.get(b) != new.get(b)]
        sides = []
        for places in (old, new):
            own = {b: v for b, v in places.items() if b in moved}
            rows = self._buckets(table, own) if own else self.read(table, newer).limit(0)
            sides.append(rows.select(key, F.xxhash64(*sorted(rows.columns)).alias("hash")))
        both = sides[0].withColumnRenamed("hash", "old_hash").join(sides[1].withColumnRenamed("hash", "new_hash"), key, "full_outer")
        change = F.when(F.col("old_hash").isNull(), "inserted").when(F.col("new_hash").isNull(), "removed").otherwise("changed")
        return both.where(~F.col("old_hash").eqNullSafe(F.col("new_hash"))).select(key, change.alias("change"), "old_hash", "new_hash")

    def log_parts(self, log: str) -> list[int]:
        """The versions that a log's rows lie in; one that has taken over earlier ones stands for them."""
        pointers = self._pointers()
        if pointers is None:
            return []
        upto = F.max(F.try_element_at("takes_over", F.lit(log)))
        own = pointers.where(F.array_contains("tables", log))
        row = own.agg(F.collect_set("version").alias("versions"), F.coalesce(upto, F.lit(0)).alias("upto")).first()
        return sorted(v for v in row["versions"] if v > row["upto"])

    def read_log(self, log: str, *, parts: list[int] | None = None, with_version: bool = False) -> DataFrame | None:
        """All committed rows of a log, or those of some of its parts; nothing of a failed commit is among them."""
        own = self.log_parts(log)
        if not own:
            return None
        paths = [f"{self.root}/{log}/version={v}" for v in (own if parts is None else parts)]
        rows = self.spark.read.option("basePath", f"{self.root}/{log}").parquet(*(paths or [f"{self.root}/{log}/version={own[-1]}"]))
        rows = rows if paths else rows.limit(0)
        return rows if with_version else rows.drop("version")

    def commit(
        self, tables: dict[str, DataFrame] | None = None, *, logs: dict[str, DataFrame] | None = None,
        buckets: dict[str, DataFrame] | None = None, batch_key: str = "", takes_over: dict[str, int] | None = None,
    ) -> int:
        """Write the tables, the changed buckets and the new rows of the logs, then the pointer; returns the version.

        ``buckets`` has, by table, whole buckets: their rows with a column ``bucket`` (see ``changed_buckets``).
        ``takes_over`` names logs whose new part stands for all parts up to a version.
        """
        tables, logs, buckets = tables or {}, logs or {}, buckets or {}
        version = (self.current() or 0) + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/v{version}/{name}")
        for name, df in logs.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/version={version}")
        changed = {}
        for name, df in buckets.items():
            df.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{name}/written={version}")
            changed[name] = [int(n.split("=")[1]) for n in self._names(f"{name}/written={version}") if n.startswith("bucket=")]
        pointer = self.spark.createDataFrame([(version, batch_key, [*tables, *logs, *buckets], changed, takes_over or {})], _POINTER)
        pointer.coalesce(1).write.mode("append").json(f"{self.root}/_commits")
        self._fold(version)
        return version

    def _fold(self, version: int) -> None:
        """Fold the pointers into one file where there are many; the single files go once that one is complete."""
        names = [n for n in self._names("_commits") if n.endswith(".json")]
        if len(names) < FOLD:
            return
        self._pointers().coalesce(1).write.mode("overwrite").parquet(f"{self.root}/_folded/upto={version}")
        files, path = self._files()
        for name in names:
            files.delete(path(f"_commits/{name}"), False)
        for name in self._names("_folded"):
            if name != f"upto={version}":
                files.delete(path(f"_folded/{name}"), True)

    def forget(self, keep: int = 2) -> list[str]:
        """Remove tables and buckets that neither the present nor the ``keep`` - 1 commits before it refer to; logs stay.

        Only folders of versions up to the present are looked at, so a writer at work loses nothing.  Returns what went.
        """
        pointers, now = self._pointers(), self.current()
        if now is None:
            return []
        alive: set[str] = set()
        seen = [r.version for r in pointers.select("version").where(F.col("version") > now - keep).collect()]
        holders = pointers.select("version", F.explode("tables").alias("name"), "buckets")
        names = {r.name for r in holders.select("name").distinct().collect()}
        cut = {r.name for r in pointers.select(F.explode(F.map_keys("buckets")).alias("name")).distinct().collect()}
        for at in seen:
            for name in names - cut:
                found = holders.where((F.col("name") == name) & (F.col("version") <= at)).agg(F.max("version")).first()[0]
                alive.add(f"v{found}/{name}")
            for name in cut:
                alive |= {f"{name}/written={v}/bucket={b}" for b, v in self.bucket_versions(name, at).items()}
        files, path = self._files()
        written = [f"v{v}/{name}" for v in range(1, now + 1) for name in self._names(f"v{v}")]
        written += [f"{name}/{w}/{b}" for name in cut for w in self._names(name) if w.startswith("written=") and int(w[8:]) <= now for b in self._names(f"{name}/{w}") if b.startswith("bucket=")]
        gone = [w for w in written if w not in alive]
        for folder in gone:
            files.delete(path(folder), True)
        return gone

    def remove(self, folder: str) -> None:
        """Remove a folder of work that is done, if it is there."""
        files, path = self._files()
        files.delete(path(folder), True)


def changed_buckets(rows: DataFrame, key: str, changed: Column, buckets: int = BUCKETS) -> DataFrame:
    """All rows of the buckets in which ``changed`` holds for a row, with the column ``bucket``.

    ``rows`` is a stored or checkpointed table.  The list of buckets is no longer than their number.
    """
    placed = rows.withColumn("bucket", bucket_of(F.col(key), buckets))
    touched = [r["bucket"] for r in placed.where(changed).select("bucket").distinct().collect()]
    return placed.where(F.col("bucket").isin(touched))

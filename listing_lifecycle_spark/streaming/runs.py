"""Runs in a stream: absence is judged only when a run says that it is complete.

The stream carries observations (``kind`` = ``listing``) and, per run, one
control row (``kind`` = ``complete``) with the scope it searched.  Observations
are staged; a control row applies its run.  Silence never marks anything
missing: a run that breaks off has no control row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from listing_lifecycle_spark.operators import lifecycle
from listing_lifecycle_spark.plans.persist import commit_run, run_once
from listing_lifecycle_spark.sources.eventlog import EventLog
from listing_lifecycle_spark.sources.versions import BUCKETS, VersionedTables


class RunSink:
    """Micro-batch writer that stages observations and applies completed runs in order.

    ``scope_of`` turns a control row into a ``RunScope``.  Staged rows go to a
    folder of their run and batch, so that a repeated batch replaces itself and a
    run reads its own rows only; the folder goes when the run is committed.  Each
    run is committed under its own key, so that it is applied once.
    Events are deduplicated against the whole log, not within a time window; only
    the parts of it are read that may hold an event of a matched listing, and after
    ``fold_after`` parts they are folded into one.
    """

    def __init__(
        self,
        tables: VersionedTables,
        empty: dict[str, DataFrame],
        *,
        rules: DataFrame,
        locations: DataFrame,
        scope_of: Callable[[dict], lifecycle.RunScope],
        listing_columns: list[str],
        buckets: int = BUCKETS,
        fold_after: int = 64,
    ):
        self.tables = tables
        self.empty = empty
        self.rules = rules
        self.locations = locations
        self.scope_of = scope_of
        self.listing_columns = listing_columns
        self.buckets = buckets
        self.fold_after = fold_after

    def _table(self, name: str) -> DataFrame:
        found = self.tables.read(name)
        return self.empty[name] if found is None else found

    def _apply(self, control: dict, schema: StructType) -> None:
        key = f"run-{control['run_id']}"
        folder = f"staging/run_id={control['run_id']}"
        if self.tables.has_batch(key):
            self.tables.remove(folder)
            return
        # The schema is given: a run without rows has no folder.
        read = self.tables.spark.read.schema(schema)
        try:
            rows = read.parquet(f"{self.tables.root}/{folder}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.tables.spark.createDataFrame([], schema)
        rows = rows.select(*self.listing_columns, "observed_at")
        # Of two rows of one instant the greater as text counts, whatever their order of arrival.
        rows = rows.withColumn("_text", F.to_json(F.struct(*self.listing_columns)))
        scopes = self._table("scopes")
        result = run_once(
            self._table("state"), lifecycle.last_per_key(rows, ["observed_at", "_text"]).drop("_text"), self.scope_of(control),
            rules=self.rules, locations=self.locations, event_log=EventLog(self.tables),
            run_id=control["run_id"], now=control["completed_at"], today=control["completed_at"],
        )
        commit_run(self.tables, result, scopes=scopes, batch_key=key, buckets=self.buckets)
        self.tables.remove(folder)
        log = EventLog(self.tables)
        if len(log.parts()) >= self.fold_after:
            log.fold()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        # Both kinds of rows are taken from what was staged, so the source is read once.
        listings = batch.where("kind = 'listing'").withColumn("batch", F.lit(batch_id))
        staging = listings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "batch")
        staging.parquet(f"{self.tables.root}/staging")
        controls = batch.where("kind = 'complete'").select("run_id", "scope_name", "completed_at").distinct()
        # One control row per run: a handful, whatever the number of observations.
        for control in controls.orderBy("completed_at", "run_id").toLocalIterator():
            self._apply(control.asDict(), batch.schema)


def apply_runs(stream: DataFrame, sink: RunSink, *, checkpoint: str) -> StreamingQuery:
    """Start applying the runs that are available; resumes from ``checkpoint`` after a stop."""
    return (
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )

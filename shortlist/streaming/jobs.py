"""Structured Streaming jobs: incremental judging, arriving items, live ledger, bounded sample.

Each job takes a streaming DataFrame and either returns one or starts a query
whose output is a table.  A job with a ``folder`` keeps output and checkpoint there and
goes on where it stopped: file sinks commit through the checkpoint, and ``foreachBatch``
writes one folder per batch id.  Without one it starts afresh in a folder of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.hashing import order_key
from ..session import is_complete, shared_dir


def _folders(spark: SparkSession, name: str, folder: str | None) -> tuple[str, str]:
    """Where output and checkpoint lie."""
    base = folder or f"{shared_dir(spark)}/shortlist-stream-{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/state"


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, on disk and keyed; a checkpoint
    remembers its store, so the session's own setting comes back afterwards."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def run_to_end(stream: DataFrame, name: str, folder: str | None = None, **options) -> DataFrame:
    """Process everything available through a parquet sink and return the table."""
    spark = stream.sparkSession
    out, state = _folders(spark, name, folder)
    with rocksdb_state(spark):
        query = (
            stream.writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", state)
            .options(**options)
            .trigger(availableNow=True)
            .outputMode("append")
            .start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


class _JudgingState(StatefulProcessor):
    """First draws and filled slots of one query, in keyed state.

    ``raws`` and ``items`` are map states: a draw looks up its own string and item, whatever else
    the query has drawn.  Only a query's draws of one trigger are held at once.
    """

    def __init__(self, k: int, cap: int, strings: bool, idle_ms: int):
        self.k, self.cap, self.strings, self.idle_ms = k, cap, strings, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "drawn long, filled long")
        self.raws = handle.getMapState("raws", "raw string", "draw long")
        self.items = handle.getMapState("items", "canonical string", "draw long")

    def _new_to(self, known, names, draws):
        """Which rows come first under their name, here and in ``known``; those are added to it."""
        first = ~names.duplicated().to_numpy()
        for i in first.nonzero()[0]:
            # a null string is a name of its own
            name = (f"={names.iloc[i]}" if isinstance(names.iloc[i], str) else "",)
            first[i] = not known.containsKey(name)
            if first[i]:
                known.updateValue(name, (int(draws.iloc[i]),))
        return first

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        rows = pd.concat(list(rows)).sort_values("draw")
        drawn, filled = self.counts.get() if self.counts.exists() else (0, 0)
        rows["drawn"] = drawn + 1 + pd.RangeIndex(len(rows)).to_numpy()
        fresh = rows[self._new_to(self.raws, rows["raw"], rows["draw"])].reset_index(drop=True)
        valid = fresh["canonical"].notna()
        once = valid.copy()
        some = fresh[valid]
        once[valid] = self._new_to(self.items, some["canonical"], some["draw"])
        fills = once | ~valid if self.strings else once
        n_filled = filled + fills.cumsum()
        wants = (n_filled < self.k) & (fresh["drawn"] < self.cap)
        self.counts.update((drawn + len(rows), filled + int(fills.sum())))
        latest = max(int(rows["at"].max().timestamp() * 1000), timerValues.getCurrentWatermarkInMs())
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(latest + self.idle_ms)
        yield pd.DataFrame(
            {
                "run": key[0], "query_id": key[1], "draw": fresh["draw"], "raw": fresh["raw"],
                "canonical": fresh["canonical"].where(valid, None), "duplicate": valid & ~once,
                "n_filled": n_filled.astype("int32"), "wants_more": wants,
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        for state in (self.counts, self.raws, self.items):
            state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def incremental_judging(
    draws: DataFrame,
    k: int,
    cap: int,
    *,
    event_time: str = "ts",
    lateness: str = "1 hour",
    idle_minutes: int = 60,
    budget: str = "molecules",
) -> DataFrame:
    """Candidates arriving in rounds, each query's repeats dropped or flagged as they come.

    ``draws`` holds ``run, query_id, draw, raw, canonical`` and an event time.
    The output adds
    ``duplicate``, the running ``n_filled`` and ``wants_more``, which turns false
    when k slots are filled or ``cap`` draws are spent.  A query's distinct strings and items are
    map state in the RocksDB store, looked up by key, so they may outgrow memory; state idle in
    event time expires by a timer.  Judging comes after this, on the rows that are left.
    """
    schema = (
        "run string, query_id long, draw long, raw string, canonical string, "
        "duplicate boolean, n_filled int, wants_more boolean"
    )
    rows = draws.withColumn("at", F.col(event_time)).withWatermark(event_time, lateness)
    return rows.groupBy("run", "query_id").transformWithStateInPandas(
        _JudgingState(k, cap, budget == "strings", idle_minutes * 60_000), schema, "Append", "EventTime"
    )


def arriving_items(
    items: DataFrame, train_keys: DataFrame, *, key: str = "key", identity: str = "digest",
    event_time: str = "ts", lateness: str = "1 hour",
) -> DataFrame:
    """First arrival of every item within the watermark, flagged unseen against a snapshot."""
    keys = train_keys.select(F.col(key).alias("__k")).distinct()
    firsts = items.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark([identity])
    return (
        firsts.join(keys, F.col(key) == F.col("__k"), "left")
        .withColumn("fp_unseen", F.col("__k").isNull())
        .drop("__k")
    )


def live_ledger(records: DataFrame) -> DataFrame:
    """Best and last record per run, for ``update`` or ``complete`` output."""
    return records.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("primary_metric").alias("best"),
        F.max("row").alias("last_row"),
        F.max_by("n_parameters", "row").alias("last_parameters"),
    )


def run_ledger(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Run the live ledger over everything available; each batch replaces the table."""
    spark = records.sparkSession
    out, state = _folders(spark, "ledger", folder)

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        live_ledger(records)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .foreachBatch(replace)
        .start()
    )
    query.awaitTermination()
    table = spark.read.parquet(out)
    latest = table.agg(F.max("batch").alias("b")).scalar()
    return table.filter(F.col("batch") == latest).drop("batch")


def bounded_sample(items: DataFrame, n: int, seed: str, item: str, folder: str | None = None) -> DataFrame:
    """Uniform sample of ``n`` rows of a stream: the n smallest hashes seen so far.

    The same rows come out whatever the batches were, and a batch that is run
    again replaces its own folder.  A batch whose predecessor is missing is an error.
    """
    spark = items.sparkSession
    out, state = _folders(spark, "sample", folder)
    fields = items.schema

    def merge(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.withColumn("__h", order_key(seed, F.col(item)))
        merged = keyed.select("*", F.lit(1).cast("long").alias("__seen"))
        if batch_id:
            earlier = f"{out}/batch={batch_id - 1}"
            if not is_complete(batch.sparkSession, earlier):
                raise RuntimeError(f"the sample before batch {batch_id} is missing: {earlier}")
            merged = merged.unionByName(batch.sparkSession.read.parquet(earlier))
        total = merged.agg(F.sum("__seen").alias("s")).scalar()
        first = merged.orderBy("__h", item).limit(n).withColumn("__total", total)
        # The rows read so far ride on one row of the sample.
        lead = F.row_number().over(_lead(item)) == 1
        first.withColumn("__seen", F.when(lead, F.col("__total")).otherwise(F.lit(0))).drop(
            "__total"
        ).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        items.writeStream.option("checkpointLocation", state)
        .trigger(availableNow=True)
        .foreachBatch(merge)
        .start()
    )
    query.awaitTermination()
    last = spark.read.parquet(out).agg(F.max("batch")).scalar()
    table = spark.read.parquet(out).filter(F.col("batch") == last).drop("batch")
    seen = table.agg(F.sum("__seen").alias("s")).scalar()
    return table.withColumn("stream_length", seen).select(
        *[f.name for f in fields], "stream_length"
    )


def _lead(item: str):
    from pyspark.sql import Window

    # The sample holds at most n rows by now.
    return Window.partitionBy(F.lit(1)).orderBy("__h", item)

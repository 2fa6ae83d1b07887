"""Streams: candles, run statistics, and ingestion against a mark that is frozen during a run."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.common import sized
from ..sources.tables import upsert_partitions


def candle_stream(ticks: DataFrame, minutes: int, late: str = "1 hour") -> DataFrame:
    """Bars of a stream of ticks (ticker, ts, price, volume, event_id): in append mode closed ones, in update mode those that a batch changed."""
    at = F.struct("ts", "event_id")
    out = ticks.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "ticker").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"),
        F.sum(F.col("price") * F.col("volume")).alias("amount"), F.max("ts").alias("end_ts"),
    )
    return out.select("ticker", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "amount", "end_ts")


def save_bars(bars: DataFrame, batch: int, path: str, run: int = 0) -> None:
    """Bring a batch's bars into the table at path, partitioned by day: of a bar's versions the one of the last (run, batch) stays.

    A batch that comes again replaces itself, and no older one replaces a newer.
    """
    rows = bars.withColumns({"run": F.lit(run).cast("long"), "batch": F.lit(batch).cast("long"), "day": F.to_date("ts")})
    upsert_partitions(path, rows, ["ticker", "ts"], "run", "batch", "day")


def candles_to_table(ticks: DataFrame, folder: str, minutes: int, late: str = "1 hour", run: int = 0) -> None:
    """Run a stream of ticks to its end: bars as they change go to folder/bars, ticks later than `late` are dropped."""
    changed = candle_stream(ticks, minutes, late).writeStream.outputMode("update").foreachBatch(lambda batch, n: save_bars(batch, n, f"{folder}/bars", run))
    changed.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def closed_bars(bars: DataFrame, minutes: int, late: str = "1 hour") -> DataFrame:
    """Stored bars that end at least `late` before the newest tick of all."""
    newest = F.broadcast(bars.agg(F.max("end_ts").alias("newest")))
    x = bars.join(newest, F.col("ts") + F.make_interval(mins=F.lit(minutes)) <= F.col("newest") - F.expr(f"interval {late}"))
    return x.drop("newest", "run", "batch", "day")


#: Counts of a run that its statistics sum.
RUN_COUNTS = ("fetched", "selected", "saved", "duplicates", "skipped")


def run_stats_stream(runs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Closed half hours of a stream of runs (ts, source, RUN_COUNTS, error): runs, sums, errors and the last run of each source."""
    out = runs.withWatermark("ts", late).groupBy(F.window("ts", "30 minutes").alias("w"), "source").agg(
        F.count("*").alias("runs"), *[F.sum(c).cast("long").alias(c) for c in RUN_COUNTS], F.count("error").alias("errors"), F.max("ts").alias("last_run")
    )
    return out.select(F.col("w.start").alias("ts"), "source", "runs", *RUN_COUNTS, "errors", "last_run")


def late_items(items: DataFrame, marks: DataFrame) -> DataFrame:
    """items with late: the mark's own id, or published before the mark; a null time passes."""
    x = items.join(marks.select("source", "mark_id", "mark_at"), "source", "left")
    late = F.coalesce((F.col("external_id") == F.col("mark_id")) | (F.col("published_at") < F.col("mark_at")), F.lit(False))
    return x.withColumn("late", late).drop("mark_id", "mark_at")


#: Feed positions that are searched together for items newer than all before them.
FEED_PART = 4096


def _new_highs(items: DataFrame) -> DataFrame:
    """items (source, pos, published_at) with high: published after all earlier items of the source.

    A source may hold any share of the items: its positions are searched in parts,
    each of which starts from the newest time of the parts before it.
    """
    x = items.withColumn("part", F.floor(F.col("pos") / FEED_PART))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = x.groupBy("source", "part").agg(F.max("published_at").alias("top")).withColumn("start", F.max("top").over(before)).drop("top")
    own = F.max("published_at").over(Window.partitionBy("source", "part").orderBy("pos", "external_id").rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("own", own).join(parts, ["source", "part"])
    seen = F.greatest("own", "start")
    return x.withColumn("high", F.col("published_at").isNotNull() & F.coalesce(F.col("published_at") > seen, F.lit(True))).drop("part", "own", "start")


def advance_marks(marks: DataFrame, items: DataFrame) -> DataFrame:
    """Marks (source, mark_id, mark_at) after a run over items (source, pos, external_id, published_at) in feed order.

    The time moves to the newest item's if that isn't older. The id moves to that
    of the last item that was newer than all before it and had an id; without such
    an item, to the first id in the feed. No id leaves the mark's.
    """
    has_id = F.coalesce(F.col("external_id") != "", F.lit(False))
    at = F.struct("pos", "external_id")
    high = F.max_by("external_id", F.when(has_id & F.col("high"), at))
    new = _new_highs(items).groupBy("source").agg(F.max("published_at").alias("p"), F.coalesce(high, F.min_by("external_id", F.when(has_id, at))).alias("e"))
    x = marks.join(new, "source", "full")
    newer = F.col("p").isNotNull() & (F.col("mark_at").isNull() | (F.col("p") >= F.col("mark_at")))
    return x.select("source", F.coalesce("e", "mark_id").alias("mark_id"), F.when(newer, F.col("p")).otherwise(F.col("mark_at")).alias("mark_at"))


def bootstrap_select(items: DataFrame, since: str, k: int) -> DataFrame:
    """Recent items of each source; if it has none, its first k in feed order."""
    w = Window.partitionBy("source")
    recent = F.coalesce(F.col("published_at") >= F.lit(since).cast("timestamp_ntz"), F.lit(False))
    x = items.withColumns({"recent": recent, "rn": F.row_number().over(w.orderBy("pos"))}).withColumn("any", F.max("recent").over(w))
    return x.filter(F.when(F.col("any"), F.col("recent")).otherwise(F.col("rn") <= k)).drop("recent", "rn", "any")


def run_to_table(stream: DataFrame, folder: str, mode: str = "append", by: list[str] | None = None):
    """Run a stream over what is there and stop; results and state lie in the folder. The ended query tells its progress."""
    out = stream.writeStream.format("parquet").option("path", f"{folder}/data").option("checkpointLocation", f"{folder}/state").outputMode(mode)
    query = (out.partitionBy(*by) if by else out).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


@contextmanager
def _states_on_disk(session: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their states in RocksDB: what an executor holds in memory doesn't grow with the keys.

    Nor do they run batches without rows, which a time to live would ask for again
    and again, so that a run over what is there would never end.
    """
    own = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {k: session.conf.get(k) for k in own}
    for k, v in own.items():
        session.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            session.conf.set(k, v)


class _FirstOfKey(StatefulProcessor):
    """Of a key's rows the first by `order`, once; the key's state is that it came."""

    def __init__(self, order: str, keep_ms: int | None) -> None:
        self.order, self.keep_ms = order, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.came = handle.getValueState("came", "yes boolean", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        if not self.came.exists():
            self.came.update((True,))
            yield min(rows, key=lambda r: (r[self.order] is None, r[self.order]))

    def close(self) -> None: ...


class _Judge(_FirstOfKey):
    """Every row with its status: late by its flag, saved if it is the first of its key that isn't, else duplicate."""

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        came = self.came.exists()
        for r in sorted(rows, key=lambda r: (r["late"], r[self.order] is None, r[self.order])):
            saved = not r["late"] and not came
            if saved:
                self.came.update((True,))
                came = True
            status = "late" if r["late"] else "saved" if saved else "duplicate"
            yield Row(source=r["source"], external_id=r["external_id"], published_at=r["published_at"], pos=r["pos"], status=status, run=r["run"])

    def close(self) -> None: ...


def _by_key(stream: DataFrame, key: list[str], processor: _FirstOfKey, schema: str | StructType) -> DataFrame:
    return stream.groupBy(*key).transformWithState(processor, schema, "append", "none" if processor.keep_ms is None else "processingTime")


def dedupe_stream(stream: DataFrame, folder: str, key: list[str], order: str, keep_ms: int | None = None) -> DataFrame:
    """The first row of each key over the whole stream, by `order` within a batch.

    A state by key tells which came before: a batch reads the states of its own
    keys, and never what was written. With keep_ms a key is forgotten, and may come
    again, so long after it came; without, it is known for good.
    """
    session = stream.sparkSession
    with _states_on_disk(session):
        run_to_table(_by_key(stream, key, _FirstOfKey(order, keep_ms), stream.schema), folder)
    return session.read.schema(stream.schema).parquet(f"{folder}/data")


INGESTED = "source string, external_id string, published_at timestamp_ntz, pos long, status string, run long"


def ingest(stream: DataFrame, folder: str, marks: DataFrame, run: int = 0, keep_ms: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Items (source, external_id, published_at, pos) of one run with status late, duplicate or saved, and the marks after it.

    All batches of a run are judged by the marks as they were when it began: the
    run's number names a copy, which a run that starts again after a failure finds.
    The first item of an id is saved, in feed order within a batch; ids that earlier
    runs saved are states of the stream (see dedupe_stream()), not rows to be read.
    An item without an id counts as new.
    """
    session = stream.sparkSession
    frozen = f"{folder}/marks/run={run}"
    marks.select("source", "mark_id", "mark_at").write.mode("ignore").parquet(frozen)
    marks = session.read.parquet(frozen)
    x = stream.select(F.col("source").cast("string").alias("source"), F.col("external_id").cast("string").alias("external_id"), F.col("published_at").cast("timestamp_ntz").alias("published_at"), F.col("pos").cast("long").alias("pos"))
    x = late_items(x, sized(marks)).withColumns({"run": F.lit(run).cast("long"), "key": F.when(F.coalesce("external_id", F.lit("")) == "", F.concat(F.lit("pos "), F.col("run"), F.lit(" "), F.col("pos"))).otherwise(F.concat(F.lit("id "), "external_id"))})
    with _states_on_disk(session):
        run_to_table(_by_key(x, ["source", "key"], _Judge("pos", keep_ms), INGESTED), folder, by=["run"])
    items = session.read.schema(INGESTED).parquet(f"{folder}/data").filter(F.col("run") == run).drop("run")
    return items, advance_marks(marks, items.filter("status <> 'late'"))

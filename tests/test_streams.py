"""Streams in several batches and runs: keyed states, upserts that rewrite only what they touch, marks."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from tickloom.sources import tables
from tickloom.streaming import jobs

T = dt.datetime(2024, 1, 1)
ITEM = "source string, external_id string, published_at timestamp_ntz, pos long"


def files_of(path):
    return {f"{d}/{f}" for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def feed(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))


def test_upsert_leaves_untouched_days_alone(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "day date, key string, at long, seq long, v string"
    day = lambda k: (T + dt.timedelta(days=k)).date()
    put = lambda rows: tables.upsert_partitions(path, spark.createDataFrame(rows, schema), ["day", "key"], "at", "seq", "day")
    rows = lambda: {(r.day, r.key): r.v for r in spark.read.schema(schema).parquet(path).collect()}
    put([(day(k), f"k{i}", 1, i, "old") for k in range(5) for i in range(3)] + [(None, "n", 1, 1, "old")])
    before = files_of(path)
    batch = [(day(1), "k0", 2, 0, "new"), (day(1), "k0", 2, 1, "newest"), (day(1), "k1", 0, 9, "stale"), (day(7), "k9", 1, 1, "new")]
    put(batch)
    after = files_of(path)
    kept = {f for f in before if "day=2024-01-02" not in f}
    assert len(kept) == 5 and kept <= after and not (before - kept) & after
    want = {(day(k), f"k{i}"): "old" for k in range(5) for i in range(3)} | {(None, "n"): "old", (day(1), "k0"): "newest", (day(7), "k9"): "new"}
    assert rows() == want
    put(batch)
    assert rows() == want
    put([])
    assert rows() == want
    put([(None, "n", 2, 1, "new")])
    assert rows() == want | {(None, "n"): "new"}


def test_only_touched_days_are_read(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "day string, key long, at long, v long"
    wide = spark.range(20_000).selectExpr("cast(id % 20 as string) day", "id key", "1l at", "0l v")
    tables.upsert_partitions(path, wide, ["day", "key"], "at", "v", "day")
    before = files_of(path)
    stored = spark.read.schema(schema).parquet(path).filter(F.col("day").isin(["3"]))
    scan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in scan and "day#" in scan.split("PartitionFilters: ")[1].split("]")[0]
    tables.upsert_partitions(path, spark.createDataFrame([("3", 3, 2, 7)], schema), ["day", "key"], "at", "v", "day")
    assert {f for f in before if "/day=3/" not in f} <= files_of(path)
    assert spark.read.schema(schema).parquet(path).agg(F.sum("v"), F.count("*")).first() == (7, 20_000)


def test_bars_of_repeated_and_late_batches(spark, tmp_path):
    """A batch that comes twice changes nothing, an older one replaces nothing, late ticks within the limit correct their bar."""
    path, schema = str(tmp_path / "bars"), "ticker string, ts timestamp, open double, high double, low double, close double, volume double, amount double, end_ts timestamp"
    bar = lambda close, at=0: spark.createDataFrame([("A", T + dt.timedelta(minutes=at), 1.0, 2.0, 0.5, close, 1.0, 1.0, T + dt.timedelta(minutes=at + 29))], schema)
    for close, batch in ((1.0, 0), (2.0, 1), (2.0, 1), (1.0, 0)):
        jobs.save_bars(bar(close), batch, path)
    assert [r.close for r in spark.read.parquet(path).collect()] == [2.0]
    jobs.save_bars(bar(5.0), 0, path, run=1)
    assert [r.close for r in spark.read.parquet(path).collect()] == [5.0]


def test_candle_table_over_batches_and_runs(spark, tmp_path):
    rng = random.Random(1)
    schema = "event_id long, ticker string, ts timestamp, price double, volume double"
    ticks = [(i, rng.choice("AB"), T + dt.timedelta(minutes=3 * i), float(rng.randrange(50)), float(i % 4)) for i in range(600)]
    moved = sorted(ticks, key=lambda r: r[2] + dt.timedelta(minutes=rng.randrange(50)))  # up to 50 minutes late
    parts = [moved[:200], moved[200:400], moved[400:]]
    for run, some in enumerate((parts[:2], parts[2:])):
        for k, part in enumerate(some):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{run}{k}"))
        jobs.candles_to_table(feed(spark, tmp_path / "in", schema), str(tmp_path / "out"), 30)
    got = jobs.closed_bars(spark.read.parquet(str(tmp_path / "out/bars")), 30)
    newest = max(r[2] for r in ticks)
    want = {}
    for r in sorted(ticks, key=lambda r: (r[2], r[0])):
        start = T + (r[2] - T) // dt.timedelta(minutes=30) * dt.timedelta(minutes=30)
        if start + dt.timedelta(minutes=90) <= newest:
            want.setdefault((r[1], start), []).append(r)
    assert {(r.ticker, r.ts): (r.open, r.high, r.low, r.close, r.volume, r.amount, r.end_ts) for r in got.collect()} == {
        k: (v[0][3], max(x[3] for x in v), min(x[3] for x in v), v[-1][3], sum(x[4] for x in v), sum(x[3] * x[4] for x in v), v[-1][2]) for k, v in want.items()
    }


def progress_of(spark, run):
    """The end of a run's stream, from the listener."""
    from pyspark.sql.streaming.listener import StreamingQueryListener

    seen = []

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event): ...
        def onQueryProgress(self, event):
            seen.append(event.progress)
        def onQueryIdle(self, event): ...
        def onQueryTerminated(self, event): ...

    listener = Listener()
    spark.streams.addListener(listener)
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(listener)
    return out, seen


def test_second_run_reads_its_own_rows_only(spark, tmp_path):
    """After 5,000 stored keys a run of 20 rows reads 20 rows and touches the states of its keys, no more."""
    schema = "key long, at long, note string"
    spark.range(5000).selectExpr("id key", "id at", "'a' note").coalesce(1).write.parquet(str(tmp_path / "in/0"))
    dedupe = lambda: jobs.dedupe_stream(feed(spark, tmp_path / "in", schema), str(tmp_path / "out"), ["key"], "at")
    first, _ = progress_of(spark, dedupe)
    assert first.count() == 5000
    spark.range(20).selectExpr("4990 + id key", "9000 - id at", "'b' note").coalesce(1).write.parquet(str(tmp_path / "in/1"))
    again, seen = progress_of(spark, dedupe)
    own = [p for p in seen if p.numInputRows]
    assert sum(p.numInputRows for p in own) == 20 and len(own) == 1
    (state,) = own[0].stateOperators
    assert state.numRowsUpdated == 10 and state.numRowsTotal == 5010
    assert again.count() == 5010 and {r.note for r in again.filter("key < 5000").collect()} == {"a"}


def test_first_row_of_a_batch_by_order_and_nulls(spark, tmp_path):
    rows = [(1, 5, "x"), (1, 3, "y"), (1, None, "z"), (None, 2, "n"), (None, 1, "m"), (2, None, "only")]
    spark.createDataFrame(rows, "key long, at long, note string").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, at long, note string").parquet(str(tmp_path / "in"))
    got = jobs.dedupe_stream(stream, str(tmp_path / "out"), ["key"], "at").collect()
    assert sorted(r.note for r in got) == ["m", "only", "y"]


def test_ingest_in_two_runs(spark, tmp_path):
    """What an earlier run saved is known in the next one, by state; marks move between runs; a run that starts again finds its own marks."""
    t = [T + dt.timedelta(hours=h) for h in range(12)]
    marks = spark.createDataFrame([("a", "m", t[2])], "source string, mark_id string, mark_at timestamp_ntz")
    runs = [[("a", "x", t[5], 1), ("a", "y", t[4], 2), ("a", "x", t[5], 3), ("b", None, None, 4), ("b", None, None, 5)], [("a", "y", t[6], 1), ("a", "z", t[4], 2), ("a", "x", t[9], 3), ("b", "q", t[1], 4), ("a", "w", t[9], 5)]]
    found = []
    for n, rows in enumerate(runs):
        spark.createDataFrame(rows, ITEM).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        items, after = jobs.ingest(feed(spark, tmp_path / "in", ITEM), str(tmp_path / "out"), marks, run=n)
        found.append({r.pos: r.status for r in items.collect()})
        marks = spark.createDataFrame(after.collect(), after.schema)
        assert spark.read.parquet(str(tmp_path / f"out/data/run={n}")).count() == len(rows)
    assert found == [{1: "saved", 2: "saved", 3: "duplicate", 4: "saved", 5: "saved"}, {1: "duplicate", 2: "late", 3: "late", 4: "saved", 5: "saved"}]
    assert {r.source: (r.mark_id, r.mark_at) for r in marks.collect()} == {"a": ("w", t[9]), "b": ("q", t[1])}


def replay(mark, items):
    """The mark after items in feed order, one by one."""
    ext = pub = None
    for external_id, published in items:
        if published is not None and (pub is None or published > pub):
            pub, ext = published, external_id or ext
        elif ext is None and external_id:
            ext = external_id
    mark_id, mark_at = mark
    if pub is not None and (mark_at is None or pub >= mark_at):
        return ext or mark_id, pub
    return ext or mark_id, mark_at


def test_marks_follow_a_replay(spark):
    rng = random.Random(2)
    for part in (3, 4096):
        items, marks = [], []
        for k in range(40):
            feed_rows = [(rng.choice([None, "", f"i{j}", f"j{j}"]), None if rng.random() < 0.3 else T + dt.timedelta(hours=rng.randrange(12))) for j in range(rng.randrange(12))]
            items += [(f"s{k}", e, p, j) for j, (e, p) in enumerate(feed_rows)]
            marks.append((f"s{k}", rng.choice([None, "m"]), rng.choice([None, T + dt.timedelta(hours=5)]), feed_rows))
        jobs.FEED_PART, kept = part, jobs.FEED_PART
        got = jobs.advance_marks(spark.createDataFrame([m[:3] for m in marks], "source string, mark_id string, mark_at timestamp_ntz"), spark.createDataFrame(items, ITEM).repartition(5))
        assert {r.source: (r.mark_id, r.mark_at) for r in got.collect()} == {s: replay((i, a), rows) for s, i, a, rows in marks}
        jobs.FEED_PART = kept


def test_run_stats_count_every_field(spark, tmp_path):
    schema = "ts timestamp, source string, fetched long, selected long, saved long, duplicates long, skipped long, error string"
    rows = [(T + dt.timedelta(minutes=m), s, 3, 2, 1, 1, 1, e) for m, s, e in ((1, "a", None), (20, "a", "bad"), (25, "b", None), (31, "a", "bad"), (200, "a", None))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    jobs.run_to_table(jobs.run_stats_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out/data")).select("source", "runs", "fetched", "selected", "saved", "duplicates", "skipped", "errors").collect())
    assert got == [("a", 1, 3, 2, 1, 1, 1, 1), ("a", 2, 6, 4, 2, 2, 2, 1), ("b", 1, 3, 2, 1, 1, 1, 0)]


def test_keys_are_forgotten_after_their_time(spark, tmp_path):
    """With keep_ms a key that comes again later than that is new; without, it never is."""
    import time

    schema = "key long, at long"
    for keep, want in ((1, [1, 1]), (None, [1])):
        place = tmp_path / f"k{keep}"
        for n in range(2):
            spark.range(1).selectExpr("1l key", f"{n}l at").coalesce(1).write.parquet(str(place / f"in/{n}"))
            got = jobs.dedupe_stream(feed(spark, place / "in", schema), str(place / "out"), ["key"], "at", keep)
            time.sleep(0.1)
        assert [r.key for r in got.collect()] == want

"""Reading blocks, logs and feeds; writing with keys."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_block_lines(lines: DataFrame, block: str) -> DataFrame:
    """Cells (block, row, name, value) of that block in lines (value), one JSON document each; block numbers the documents."""
    kind = "map<string, struct<columns: array<string>, data: array<array<string>>>>"
    blocks = lines.select(F.from_json("value", kind)[block].alias("b"), F.monotonically_increasing_id().alias("block")).filter("b is not null")
    rows = blocks.select("block", "b.columns", F.posexplode("b.data").alias("row", "cells"))
    return rows.select("block", "row", F.inline(F.arrays_zip(F.col("columns").alias("name"), F.col("cells").alias("value"))))


def read_candles(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Candles (ticker, ts, end_ts, open, high, low, close, volume, amount) of files; a missing column is an error.

    Files name the start `begin` and the amount `value`, or as here.
    """
    x = spark.read.option("header", True).format(kind).load(path)
    old = {"begin": "ts", "end": "end_ts", "value": "amount"}
    x = x.withColumnsRenamed({k: v for k, v in old.items() if k in x.columns and v not in x.columns})
    needed = ["ticker", "ts", "end_ts", "open", "high", "low", "close", "volume", "amount"]
    if missing := [c for c in needed if c not in x.columns]:
        raise ValueError(f"missing candle columns {missing}; got {x.columns}")
    number = lambda c: F.expr(f"try_cast(`{c}` as double)").alias(c)
    return x.select("ticker", F.col("ts").cast("timestamp_ntz"), F.col("end_ts").cast("timestamp_ntz"), *map(number, needed[3:]))


def read_jsonl_cache(lines: DataFrame, schema: str, key: str) -> DataFrame:
    """Last line of each key in lines (n, value); broken lines and those without the key are skipped."""
    x = lines.withColumn("j", F.from_json("value", schema)).filter(F.col(f"j.{key}").isNotNull())
    return x.groupBy(F.col(f"j.{key}").alias(key)).agg(F.max_by("j", "n").alias("j")).select("j.*")


def append_ignore(table: DataFrame, rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows to append: the first of each key in the batch, without keys of the table."""
    first = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn").join(table.select(*key), key, "left_anti")


def created(table: DataFrame, rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """All rows of the batch with created: whether append_ignore() appends it."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(order)) == 1
    known = table.select(*key, F.lit(True).alias("_known")).distinct()
    x = rows.withColumn("_first", first).join(known, key, "left")
    return x.withColumn("created", F.col("_first") & F.col("_known").isNull()).drop("_first", "_known")


def upsert_replace(table: DataFrame, rows: DataFrame, key: list[str], updated: str, seq: str) -> DataFrame:
    newest = Window.partitionBy(*key).orderBy(F.col(updated).desc(), F.col(seq).desc())
    return table.unionByName(rows).withColumn("rn", F.row_number().over(newest)).filter("rn = 1").drop("rn")


def exists(session: SparkSession, path: str) -> bool:
    """Whether a folder with rows is at path."""
    place = session._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).exists(place)


def upsert_partitions(path: str, rows: DataFrame, key: list[str], updated: str, seq: str, by: str) -> None:
    """Bring rows into the table at path: the newest row of each key by (updated, seq) stays, rows of no touched partition are neither read nor written.

    The table is partitioned by `by`, which the key determines. A batch's distinct
    values of it, no more than the folders it writes, go to the driver, so that the
    scan prunes the rest; a dynamic overwrite replaces their folders once all new
    files are written. The same batch again gives the same table.
    """
    session = rows.sparkSession
    touched = [r[0] for r in rows.select(by).distinct().collect()]
    new = rows
    if exists(session, path) and touched:
        stored = session.read.schema(rows.schema).parquet(path)
        here = F.col(by).isin([v for v in touched if v is not None])
        new = stored.filter(here | F.col(by).isNull() if None in touched else here)
        new = upsert_replace(new, rows, key, updated, seq)
    else:
        new = upsert_replace(rows.limit(0), rows, key, updated, seq)
    new.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def replace_children(table: DataFrame, parents: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return table.join(parents.select(*key).distinct(), key, "left_anti").unionByName(rows)


#: The outputs of a backtest; model_errors is written only if there are any.
OUTPUTS = ("predictions", "summary_by_model", "summary_by_ticker", "summary_by_timestamp", "selected_universe", "target_timestamps", "model_errors")


def write_backtest(predictions: DataFrame, summary: DataFrame, universe: DataFrame, targets: DataFrame, errors: DataFrame, folder: str) -> list[str]:
    """Write the seven outputs of a backtest and tell which ones; no predictions are an error.

    summary has the rows of backtest_summary(): by model, by (model, ticker) and by
    (model, ts). Predictions are written by model and ticker. targets are the times
    of each ticker.
    """
    if predictions.isEmpty():
        raise ValueError("no predictions were made")
    none = lambda *c: reduce(and_, [F.col(x).isNull() for x in c])
    frames = {
        "predictions": predictions, "summary_by_model": summary.filter(none("ticker", "ts")).drop("ticker", "ts"), "summary_by_ticker": summary.filter("ticker is not null").drop("ts"),
        "summary_by_timestamp": summary.filter("ts is not null").drop("ticker"), "selected_universe": universe, "target_timestamps": targets,
    }
    if not errors.isEmpty():
        frames["model_errors"] = errors
    write_results(frames, folder, {"predictions": ["model", "ticker"]})
    return list(frames)


def write_results(frames: dict[str, DataFrame], folder: str, by: dict[str, list[str]] | None = None) -> None:
    for name, df in frames.items():
        df.write.mode("overwrite").partitionBy(*(by or {}).get(name, [])).parquet(f"{folder}/{name}")

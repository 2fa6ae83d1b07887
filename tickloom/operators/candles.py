"""Candles: resampling, cleaning, and reading them as of a decision time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized

PRICES = ("open", "high", "low", "close")


def micros(ts: str | Column) -> Column:
    """Microseconds of a naive timestamp; range frames need a number."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def resample_candles(ticks: DataFrame, minutes: int, tie: str = "event_id") -> DataFrame:
    """Bars of ticks (ticker, ts, price, volume, tie): epoch-aligned buckets, empty ones absent."""
    bar = F.window("ts", f"{minutes} minutes")
    at = F.struct("ts", tie)
    out = ticks.groupBy("ticker", bar.alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("volume").alias("volume"), F.sum(F.col("price") * F.col("volume")).alias("amount"), F.max("ts").alias("end_ts"),
    )
    return out.select("ticker", F.col("w.start").alias("ts"), *PRICES, "volume", "amount", "end_ts")


def clean_candles(raw: DataFrame, order: str) -> DataFrame:
    """Text that is no number becomes null; rows without times or prices go; first row per (ticker, ts) stays."""
    typed = raw.withColumns({c: F.col(c).try_cast("double") for c in (*PRICES, "volume", "amount")})
    whole = typed.na.drop(subset=["ts", "end_ts", *PRICES]).na.fill(0.0, ["volume", "amount"])
    first = Window.partitionBy("ticker", "ts").orderBy(order)
    return whole.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")


def drop_incomplete_last(bars: DataFrame, minutes: int) -> DataFrame:
    """Without the last bar of a ticker whose end is over a minute short of its full length less a second."""
    last = Window.partitionBy("ticker").orderBy(F.col("ts").desc())
    full = F.col("ts") + F.make_interval(mins=F.lit(minutes)) - F.make_interval(mins=F.lit(1), secs=F.lit(1))
    return bars.withColumn("rn", F.row_number().over(last)).filter((F.col("rn") > 1) | (F.col("end_ts") >= full)).drop("rn")


def latest_candle(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close"))


def timestamp_count(bars: DataFrame, before: str) -> DataFrame:
    return bars.filter(F.col("ts") < F.lit(before).cast("timestamp_ntz")).agg(F.countDistinct("ts").alias("n"))


def recent_timestamps(bars: DataFrame, n: int) -> DataFrame:
    """The newest n + 1 distinct times over all tickers."""
    return bars.select("ts").distinct().orderBy(F.col("ts").desc()).limit(n + 1)


def bars_as_of(bars: DataFrame, decisions: DataFrame, limit: int) -> DataFrame:
    """The last `limit` bars of each ticker strictly before each as_of, numbered from the newest.

    Bars get, per ticker, the number of bars before them; each as_of finds that
    count by one window over bars and decisions together, so the join is on
    (ticker, number) and brings `limit` rows a decision, not a ticker's history.
    """
    by_time = Window.partitionBy("ticker").orderBy("ts")
    seq = bars.withColumn("seq", F.row_number().over(by_time))
    asked = bars.select("ticker").distinct().join(sized(decisions.select("as_of")), how="cross") if "ticker" not in decisions.columns else decisions
    marks = seq.select("ticker", "ts", "seq").unionByName(asked.select("ticker", F.col("as_of").alias("ts"), F.lit(None).cast("int").alias("seq")))
    known = F.max("seq").over(Window.partitionBy("ticker").orderBy(micros("ts")).rangeBetween(Window.unboundedPreceding, -1))
    at = marks.withColumn("upto", known).filter("seq is null and upto is not null").select("ticker", F.col("ts").alias("as_of"), "upto")
    wanted = at.withColumn("back", F.explode(F.sequence(F.lit(1), F.least(F.lit(limit), F.col("upto"))))).withColumn("seq", F.col("upto") - F.col("back") + 1)
    return wanted.select("ticker", "as_of", "back", "seq").join(seq, ["ticker", "seq"]).drop("seq")

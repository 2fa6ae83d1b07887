"""The library's tables as Spark derives them from the given ones, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.candles import resample_candles

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str, ticker: str = "event_type") -> DataFrame:
    e = table(spark, sf_dir, "events")
    t = F.col("event_type") if ticker == "event_type" else F.concat(F.lit("u"), (F.col("user_id") % 8).cast("string"))
    return e.select("event_id", t.alias("ticker"), "ts", F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume"))


def bars(spark: SparkSession, sf_dir: str, minutes: int = 30, ticker: str = "event_type") -> DataFrame:
    return resample_candles(ticks(spark, sf_dir, ticker), minutes)


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour closes of eight tickers: (as_of, ticker, price)."""
    return bars(spark, sf_dir, 360, "user").select(F.col("ts").alias("as_of"), "ticker", F.col("close").alias("price"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news: the title is the first line, times follow the id."""
    d = table(spark, sf_dir, "documents")
    title = F.substring_index("text", "\n", 1)
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(secs=(F.col("doc_id") * 180).cast("decimal(18,6)"))
    return d.select(F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("news_id"), "doc_id", "source", at.alias("ts"), title.alias("title"), "text")


def bars_sql(minutes: int = 30, ticker: str = "event_type") -> str:
    t = "event_type" if ticker == "event_type" else "'u' || CAST(user_id % 8 AS VARCHAR)"
    return f"""ticks AS (SELECT event_id, {t} AS ticker, ts AS tick_at, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events),
        bars AS (SELECT ticker, time_bucket(INTERVAL {minutes} MINUTES, tick_at) AS ts, first(price ORDER BY tick_at, event_id) AS open, max(price) AS high, min(price) AS low,
            last(price ORDER BY tick_at, event_id) AS close, sum(volume) AS volume, sum(price * volume) AS amount, max(tick_at) AS end_ts FROM ticks GROUP BY 1, 2)"""


PRICES_SQL = f"{bars_sql(360, 'user')}, prices AS (SELECT ts AS as_of, ticker, close AS price FROM bars)"
NEWS_SQL = """news AS (SELECT source || ':' || CAST(doc_id AS VARCHAR) AS news_id, doc_id, source, TIMESTAMP '2024-01-01' + to_seconds(doc_id * 180) AS ts,
            string_split(text, chr(10))[1] AS title, text FROM documents)"""

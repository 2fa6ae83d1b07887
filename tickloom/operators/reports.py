"""Reports over stories, runs, the news store and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Errors that a half hour reports.
ERRORS = 20


def story_stats(clusters: DataFrame, news_items: int) -> DataFrame:
    """Counts of stories (story_id, items): stories, items in them, items saved by them; unique_stories are all items less the saved ones."""
    total = clusters.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("items"), F.lit(0)).alias("clustered"), F.coalesce(F.sum(F.col("items") - 1), F.lit(0)).alias("deduplicated"))
    return total.withColumn("unique_stories", F.lit(news_items) - F.col("deduplicated"))


def story_report(clusters: DataFrame, items: DataFrame, limit: int) -> DataFrame:
    """The largest stories with their items, in order of time, source and id."""
    top = clusters.orderBy(F.col("items").desc(), "first_at", "story_id").limit(limit).select("story_id", F.col("items").alias("story_items"))
    place = F.row_number().over(Window.partitionBy("story_id").orderBy("ts", "source", "news_id"))
    return items.join(F.broadcast(top), "story_id").withColumn("place", place)


def rebuild_stories(new: DataFrame, old: DataFrame, now: str) -> DataFrame:
    """New stories; those whose id was there before keep their created_at."""
    return new.join(old.select("story_id", "created_at"), "story_id", "left").withColumn("created_at", F.coalesce("created_at", F.lit(now).cast("timestamp_ntz")))


def source_run_stats(log: DataFrame) -> DataFrame:
    """Totals of each half hour and source, and of each half hour (source null), with its first 20 errors.

    log: ts, source, fetched, selected, saved, duplicates, skipped, error (text or null).
    """
    x = log.withColumn("window_start", F.window("ts", "30 minutes")["start"])
    counts = ("fetched", "selected", "saved", "duplicates", "skipped")
    out = x.rollup("window_start", "source").agg(
        F.count("*").alias("runs"), *[F.sum(c).cast("long").alias(c) for c in counts], F.count("error").alias("errors"), F.max("ts").alias("last_run"),
    ).filter("window_start is not null")
    first = F.row_number().over(Window.partitionBy("window_start").orderBy("ts", "source", "error"))
    errors = x.filter("error is not null").withColumn("rn", first).filter(F.col("rn") <= ERRORS)
    item = F.struct("rn", "source", F.substring("error", 1, 500).alias("error"))
    sample = errors.groupBy("window_start").agg(F.transform(F.array_sort(F.collect_list(item)), lambda e: F.struct(e["source"].alias("source"), e["error"].alias("error"))).alias("errors_sample"))
    empty = F.array().cast("array<struct<source: string, error: string>>")
    return out.join(sample, "window_start", "left").withColumn("errors_sample", F.when(F.col("source").isNull(), F.coalesce("errors_sample", empty)))


def news_store_summary(news: DataFrame, tags: DataFrame) -> DataFrame:
    newest = F.struct("received_at", "news_id")
    a = news.agg(F.count("*").alias("items"), F.countDistinct("source").alias("sources"), F.max("received_at").alias("newest_at"), F.max_by("news_id", newest).alias("newest_id"))
    return a.join(tags.agg(F.count("*").alias("tags"), F.countDistinct("news_id").alias("tagged")), how="cross")


def decision_summary(positions: DataFrame, top: int = 3) -> DataFrame:
    """Of positions (as_of, selector, ticker, weight): counts, gross weight and the largest longs and shorts."""
    def names(side):
        heaviest = F.array_sort(F.collect_list(F.when(side, F.struct((-F.abs("weight")).alias("w"), "ticker"))))
        return F.array_join(F.transform(F.slice(heaviest, 1, top), lambda x: x["ticker"]), ",")

    long, short = F.col("weight") > 0, F.col("weight") < 0
    return positions.groupBy("as_of", "selector").agg(
        F.count("*").alias("n"), F.count(F.when(long, 1)).alias("longs"), F.count(F.when(short, 1)).alias("shorts"), F.sum(F.abs("weight")).alias("gross"),
        names(long).alias("top_longs"), names(short).alias("top_shorts"),
    )


def score_summary(scores: DataFrame, top: int = 3) -> DataFrame:
    """Of scores (as_of, ticker, score): count, least and greatest, and the top and bottom tickers with their scores; equal ones by ticker."""
    item = lambda k: F.struct(k.alias("k"), F.col("ticker").alias("ticker"), F.col("score").alias("score"))
    best = lambda k: F.transform(F.slice(F.array_sort(F.collect_list(item(k))), 1, top), lambda x: F.struct(x["ticker"].alias("ticker"), x["score"].alias("score")))
    return scores.groupBy("as_of").agg(F.count("*").alias("count"), F.min("score").alias("min"), F.max("score").alias("max"), best(-F.col("score")).alias("top"), best(F.col("score")).alias("bottom"))


def status_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, status) counted by status; a null one is unknown."""
    return rows.groupBy(*keys, F.coalesce(F.col("status").cast("string"), F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def liquidity_cap(orders: DataFrame, share: float = 0.2) -> DataFrame:
    """allowed and reason of orders (requested, depth_lots, degraded, risk_increasing, equity, lot_value): book depth first, else a share of equity."""
    book = F.col("depth_lots").isNotNull()
    thin = ~book & F.col("degraded") & F.col("risk_increasing")
    most = F.when(F.col("lot_value") > 0, F.floor(F.greatest("equity", F.lit(0.0)) * share / F.col("lot_value"))).otherwise(0)
    room = F.when(book, F.col("depth_lots")).when(thin, most)
    capped = F.coalesce(room < F.col("requested"), F.lit(False))
    some = F.when(book, "depth_cap").otherwise("degraded_liquidity_cap")
    none = F.when(book, "depth_shortfall").otherwise("degraded_liquidity_skip")
    return orders.withColumns({"allowed": F.when(capped, F.greatest(room, F.lit(0))).otherwise(F.col("requested")).cast("long"), "reason": F.when(capped, F.when(room > 0, some).otherwise(none)).otherwise("")})

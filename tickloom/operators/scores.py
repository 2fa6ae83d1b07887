"""Cross-sectional scores, rank weights and interval features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized


def percentile_scores(values: DataFrame, tie: str = "ticker") -> DataFrame:
    """(as_of, ticker, value) with score: place in rising order / count; a missing value scores 0.5."""
    good = F.col("value").isNotNull() & ~F.isnan("value")
    w = Window.partitionBy("as_of", "good")
    ranked = values.withColumn("good", good)
    score = F.row_number().over(w.orderBy("value", tie)) / F.count("*").over(w)
    return ranked.withColumn("score", F.when(F.col("good"), score).otherwise(F.lit(0.5))).drop("good")


def rank_weights(scores: DataFrame, keys: list[str], score: str, tie: str, power: float) -> DataFrame:
    """weight = rank^-power, of one for each group of keys; ranks by score falling, ties by `tie`."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(F.col(score).desc(), tie))
    raw = scores.withColumn("rank", rank).withColumn("raw", F.pow("rank", F.lit(-float(power))))
    return raw.withColumn("weight", F.col("raw") / F.sum("raw").over(w)).drop("raw")


def rolling_rank_weights(returns: DataFrame, lookback: int = 24, power: float = 2.0) -> DataFrame:
    """Weights of selectors at each ts from their sums over the `lookback` intervals strictly before it.

    returns (ts, selector, ord, ret) is made dense over the grid of times; with
    under max(6, lookback // 4) earlier times the default order ranks.
    """
    times, names = returns.select("ts").distinct(), returns.select("selector", "ord").distinct()
    dense = times.join(F.broadcast(names), how="cross").join(returns.select("ts", "selector", "ret"), ["ts", "selector"], "left").na.fill(0.0, ["ret"])
    before = Window.partitionBy("selector").orderBy("ts").rowsBetween(-lookback, -1)
    sums = dense.withColumn("n", F.count("ret").over(before)).withColumn("total", F.coalesce(F.sum("ret").over(before), F.lit(0.0)))
    known = sums.withColumn("score", F.when(F.col("n") >= max(6, lookback // 4), F.round("total", 12)).otherwise(F.lit(0.0)))
    return rank_weights(known, ["ts"], "score", "ord", power).select("ts", "selector", "rank", "weight", "ret")


def rolling_rank_weights_at(returns: DataFrame, decisions: DataFrame, names: DataFrame, lookback: int = 24, power: float = 2.0) -> DataFrame:
    """(as_of, selector, rank, weight) of any decision times from the sums of the `lookback` intervals strictly before each.

    returns (ts, selector, ret) may lack selectors, whose returns are 0; names
    (selector, ord) are all of them. Each time gets the sums up to and with it, and
    each decision those of the last time before it; with under max(6, lookback // 4)
    times before it the default order ranks.
    """
    small = F.broadcast(names.select("selector", "ord"))
    times = returns.select("ts").distinct()
    dense = times.join(small, how="cross").join(returns.select("ts", "selector", "ret"), ["ts", "selector"], "left").na.fill(0.0, ["ret"])
    w = Window.partitionBy("selector").orderBy("ts").rowsBetween(-lookback + 1, 0)
    sums = dense.select("ts", "selector", F.count("ret").over(w).alias("n"), F.sum("ret").over(w).alias("total"))
    marks = times.select(F.col("ts").alias("t"), F.col("ts").alias("known")).unionByName(decisions.select(F.col("as_of").alias("t"), F.lit(None).cast("timestamp_ntz").alias("known")))
    before = F.last("known", ignorenulls=True).over(Window.orderBy("t", F.col("known").isNotNull()).rowsBetween(Window.unboundedPreceding, -1))
    at = marks.withColumn("ts", before).filter("known is null").select(F.col("t").alias("as_of"), "ts")
    x = at.join(small, how="cross").join(sums, ["ts", "selector"], "left")
    x = x.withColumn("score", F.when(F.col("n") >= max(6, lookback // 4), F.round("total", 12)).otherwise(F.lit(0.0)))
    return rank_weights(x, ["as_of"], "score", "ord", power).select("as_of", "selector", "rank", "weight")


def combine_returns(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy("ts").agg(F.sum(F.col("ret") * F.col("weight")).alias("ret"))


def clipped(x: Column, default: float) -> Column:
    """A score in [0, 1]; null and NaN become the default."""
    return F.when(x.isNull() | F.isnan(x), F.lit(default)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def interval_features(inputs: DataFrame, market: DataFrame | None = None) -> DataFrame:
    """Features of a time over all its (as_of, ticker) rows; absent values take the defaults of a ticker without data.

    inputs: forecast, news_score, confidence, priced_risk, cost, spread, tradable,
    degraded, depth_unknown, missing_bbo, news_count; market: (as_of,
    marketwide_news_count).
    """
    f, s = clipped(F.col("forecast"), 0.5), clipped(F.col("news_score"), 0.5)
    number = lambda c: F.when(F.col(c).isNull() | F.isnan(F.col(c)), 0.0).otherwise(F.col(c))
    x = inputs.withColumns({"f": f, "s": s, "d": F.abs(f - s), "c": clipped(F.col("confidence"), 0.0), "r": clipped(F.col("priced_risk"), 0.5), "cost": number("cost"), "spread": number("spread")})
    aggs = [g(c).alias(f"{name}_{n}") for c, name in (("f", "forecast"), ("s", "news")) for n, g in (("mean", F.avg), ("std", F.stddev_pop), ("top", F.max), ("bottom", F.min))]
    aggs += [g(c).alias(f"{name}_{n}") for c, name in (("d", "disagreement"), ("c", "confidence"), ("r", "priced_risk"), ("cost", "cost"), ("spread", "bbo_spread")) for n, g in (("mean", F.avg), ("max", F.max))]
    flag = lambda c, default: F.sum(F.coalesce(c, F.lit(default)).cast("double"))
    news = F.coalesce("news_count", F.lit(0)).cast("double")
    out = x.groupBy("as_of").agg(
        *aggs, flag("tradable", True).alias("tradable_count"), flag("degraded", False).alias("degraded_count"), flag("depth_unknown", False).alias("depth_unknown_count"), flag("missing_bbo", False).alias("missing_bbo_count"),
        F.sum(news).alias("ticker_news_total"), F.max(news).alias("ticker_news_max"), F.sum((news > 0).cast("double")).alias("ticker_news_coverage"),
    )
    out = out.withColumn("marketwide_news_count", F.lit(0.0)) if market is None else out.join(market.select("as_of", "marketwide_news_count"), "as_of", "left")
    t = F.col("as_of")
    wide = F.coalesce("marketwide_news_count", F.lit(0.0)).cast("double")
    return out.withColumns(
        {
            "forecast_spread": F.col("forecast_top") - F.col("forecast_bottom"), "news_spread": F.col("news_top") - F.col("news_bottom"), "marketwide_news_count": wide, "total_news_count": F.col("ticker_news_total") + wide,
            "hour": F.hour(t).cast("double"), "minute": F.minute(t).cast("double"), "day_of_week": F.weekday(t).cast("double"), "is_weekend": (F.weekday(t) >= 5).cast("double"),
        }
    )


def carried_scores(decisions: DataFrame, scores: DataFrame, universe: DataFrame) -> DataFrame:
    """(as_of, ticker, score) of every decision: its own set of scores, else the last whole set before it, else 0.5 for the universe."""
    has = decisions.join(scores.select("as_of", F.lit(True).alias("has_scores")).distinct(), "as_of", "left").select("as_of", F.coalesce("has_scores", F.lit(False)).alias("has_scores"))
    at = carry_forward(has).select("as_of", "source_as_of")
    known = at.join(scores.withColumnRenamed("as_of", "source_as_of"), "source_as_of").select("as_of", "ticker", "score")
    none = at.filter("source_as_of is null").join(sized(universe.select("ticker").distinct()), how="cross").select("as_of", "ticker", F.lit(0.5).alias("score"))
    return known.union(none)


def carry_forward(decisions: DataFrame) -> DataFrame:
    """(as_of, has_scores) with source_as_of: the last time that had scores; null before the first."""
    known = F.last(F.when(F.col("has_scores"), F.col("as_of")), ignorenulls=True)
    return decisions.withColumn("source_as_of", known.over(Window.orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0)))

"""Target weights of many selectors at once, blending, conflicts and paper returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sized
from .scores import clipped

EPS = 1e-12


def target_weights(scores: DataFrame, params: DataFrame) -> DataFrame:
    """Long and short weights for each (as_of, selector) from scores (as_of, ticker, ord, forecast, news, tradable).

    params: selector, forecast_weight, news_weight, threshold, rank_power,
    max_gross, allow_short; a few rows, met with every score by broadcast.
    """
    x = scores.filter(F.col("forecast").isNotNull() & F.coalesce("tradable", F.lit(True))).join(sized(params), how="cross")
    f, n, total = clipped(F.col("forecast"), 0.5), clipped(F.col("news"), 0.5), F.col("forecast_weight") + F.col("news_weight")
    bull = (F.col("forecast_weight") * f + F.col("news_weight") * n) / total
    bear = (F.col("forecast_weight") * (1 - f) + F.col("news_weight") * (1 - n)) / total
    x = x.withColumns({"bull": F.round(bull, 12), "bear": F.round(bear, 12)})
    long = (F.col("bull") >= F.col("threshold")) & (~F.col("allow_short") | (F.col("bull") > F.col("bear")))
    short = F.col("allow_short") & (F.col("bear") >= F.col("threshold")) & (F.col("bear") > F.col("bull"))
    x = x.withColumn("side", F.when(long, "long").when(short, "short")).filter("side is not null").withColumn("score", F.when(F.col("side") == "long", F.col("bull")).otherwise(F.col("bear")))
    w = Window.partitionBy("as_of", "selector")
    raw = F.pow(F.row_number().over(w.orderBy(F.col("score").desc(), "ord")), -F.col("rank_power"))
    gross = F.col("max_gross") * F.col("raw") / F.sum("raw").over(w)
    return x.withColumn("raw", raw).withColumn("weight", F.when(F.col("side") == "long", gross).otherwise(-gross)).select("as_of", "selector", "ticker", "side", "score", "weight")


def normalize_gross(weights: DataFrame, max_gross: float = 1.0) -> DataFrame:
    """Weights (as_of, ticker, weight) scaled down where their gross is above the limit; tiny ones go."""
    gross = F.sum(F.abs("weight")).over(Window.partitionBy("as_of"))
    scale = F.when(gross > max_gross, F.lit(max_gross) / gross).otherwise(F.lit(1.0))
    return weights.withColumn("weight", F.col("weight") * scale).filter(F.abs("weight") >= EPS)


def blend_weights(selector_weights: DataFrame, targets: DataFrame) -> DataFrame:
    joined = targets.join(selector_weights.withColumnRenamed("weight", "sw"), ["as_of", "selector"])
    return joined.groupBy("as_of", "ticker").agg(F.sum(F.col("sw") * F.col("weight")).alias("weight"))


def conflict_metrics(selector_weights: DataFrame, targets: DataFrame) -> DataFrame:
    """Per (as_of, ticker): long and short sums of contributions, net, and what cancels out."""
    c = targets.join(selector_weights.withColumnRenamed("weight", "sw"), ["as_of", "selector"]).withColumn("c", F.col("sw") * F.col("weight")).filter(F.abs("c") >= EPS)
    up, down = F.sum(F.greatest("c", F.lit(0.0))), F.sum(F.greatest(-F.col("c"), F.lit(0.0)))
    return c.groupBy("as_of", "ticker").agg(up.alias("long_sum"), down.alias("short_sum"), F.sum("c").alias("net"), (F.least(up, down) * 2).alias("cancelled"))


def conflict_report(selector_weights: DataFrame, targets: DataFrame, top: int = 10) -> DataFrame:
    """Per as_of: gross before and after blending, conflicts and what they cancel; one row for each of the `top` conflicts, or one of zeros and ticker ''."""
    per = conflict_metrics(selector_weights, targets).withColumn("conflict", F.col("cancelled") > 0)
    total = per.groupBy("as_of").agg(
        F.sum(F.col("long_sum") + F.col("short_sum")).alias("gross_before"), F.sum(F.abs("net")).alias("gross_after"), F.count(F.when(F.col("conflict"), 1)).alias("conflicts"), F.sum("cancelled").alias("cancelled_total")
    )
    place = F.row_number().over(Window.partitionBy("as_of").orderBy(F.round("cancelled", 9).desc(), "ticker"))
    worst = per.filter("conflict").withColumn("place", place).filter(F.col("place") <= top).drop("conflict")
    return total.join(worst, "as_of", "left").na.fill(0).na.fill("", ["ticker"])


def paper_returns(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Sum of weight * (next price / price - 1) where both are above 0, for each (as_of, selector)."""
    ret = F.when((F.col("price") > 0) & (F.col("next_price") > 0), F.col("weight") * (F.col("next_price") / F.col("price") - 1)).otherwise(F.lit(0.0))
    return positions.join(prices, ["as_of", "ticker"], "left").groupBy("as_of", "selector").agg(F.sum(F.coalesce(ret, F.lit(0.0))).alias("ret"))


def price_pairs(prices: DataFrame) -> DataFrame:
    """(as_of, ticker, price) with the prices at the grid's time before and after, not at the ticker's own."""
    w = Window.orderBy("as_of")
    grid = prices.select("as_of").distinct().withColumns({"prev_ts": F.lag("as_of").over(w), "next_ts": F.lead("as_of").over(w)})
    at = lambda t, name: prices.select(F.col("as_of").alias(t), "ticker", F.col("price").alias(name))
    out = prices.join(grid, "as_of")
    return out.join(at("prev_ts", "prev_price"), ["prev_ts", "ticker"], "left").join(at("next_ts", "next_price"), ["next_ts", "ticker"], "left").select("as_of", "ticker", "price", "prev_price", "next_price")


def held_times(schedule: DataFrame) -> DataFrame:
    """(selector, ts, due) with computed_at: the last time that was due; the first always is."""
    w = Window.partitionBy("selector").orderBy("ts")
    due = F.col("due") | (F.row_number().over(w) == 1)
    return schedule.withColumn("computed_at", F.last(F.when(due, F.col("ts")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def held_weights(schedule: DataFrame, targets: DataFrame) -> DataFrame:
    """(selector, as_of, ticker, weight, held) at each time of the schedule (selector, ts, due): the targets computed when it was last due."""
    at = held_times(schedule).select("selector", F.col("ts").alias("as_of"), "computed_at")
    t = targets.select("selector", F.col("as_of").alias("computed_at"), "ticker", "weight")
    return at.join(t, ["selector", "computed_at"]).select("selector", "as_of", "ticker", "weight", (F.col("as_of") != F.col("computed_at")).alias("held"))

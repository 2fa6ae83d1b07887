"""Market hours and decision times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Minutes of the day, both ends open for trading.
WEEKDAY_OPEN, WEEKDAY_CLOSE, WEEKEND_OPEN, WEEKEND_CLOSE, MIDDAY = 420, 1430, 600, 1140, 720


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def market_open(ts: Column) -> Column:
    seconds = minute_of_day(ts) * 60 + F.second(ts)
    weekend = F.weekday(ts) >= 5
    return F.when(weekend, seconds.between(WEEKEND_OPEN * 60, WEEKEND_CLOSE * 60)).otherwise(seconds.between(WEEKDAY_OPEN * 60, WEEKDAY_CLOSE * 60))


def selector_due(ts: Column, rebalance_minutes: Column) -> Column:
    """Selectors of half an hour or less always; others from midday at multiples of their period."""
    m = minute_of_day(ts)
    return (rebalance_minutes <= 30) | ((m >= MIDDAY) & (F.pmod(m - MIDDAY, F.greatest(rebalance_minutes, F.lit(1))) == 0))


def next_decision(ts: Column, minutes: int = 30, delay_seconds: int = 90) -> Column:
    """The first decision time after ts: slots of an hour's `minutes`, delay_seconds later, at which the market is open.

    Within the delay after a slot that slot's own time is still ahead. A closed
    stretch lasts 15 hours at most, so the slots up to it, or of eight days where
    they may miss a whole session, hold the next open one; they are only listed
    for a closed candidate.
    """
    hour = F.date_trunc("HOUR", ts).cast("timestamp_ntz")
    later = lambda t, k: t + F.make_interval(mins=k)
    slot = later(hour, (F.floor(F.minute(ts) / minutes) * minutes).cast("int"))
    first = slot + F.make_interval(secs=F.lit(delay_seconds).cast("decimal(18,6)"))
    first = F.when(first <= ts, later(first, F.lit(minutes))).otherwise(first)
    reach = 15 * 60 + minutes if minutes <= 60 else 8 * 24 * 60
    more = F.transform(F.sequence(F.lit(1), F.lit(reach // minutes + 1)), lambda k: later(first, (k * minutes).cast("int")))
    return F.when(market_open(first), first).otherwise(F.get(F.filter(more, market_open), F.lit(0)))


def decision_grid(spark: SparkSession, start: str, end: str, minutes: int, delay_seconds: int = 0) -> DataFrame:
    """Times delay_seconds after every slot of `minutes` between two days, at which the market is open."""
    t = spark.sql(f"SELECT explode(sequence(timestamp_ntz'{start}', timestamp_ntz'{end}', interval {minutes} minutes)) AS slot")
    x = t.select((F.col("slot") + F.make_interval(secs=F.lit(delay_seconds).cast("decimal(18,6)"))).alias("as_of"))
    return x.filter(market_open(F.col("as_of")))

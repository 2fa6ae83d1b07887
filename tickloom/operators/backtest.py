"""Rolling backtests: valid targets, consensus of samples, summaries, context matrices."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .candles import micros
from .common import sized
from .scores import percentile_scores


def valid_targets(bars: DataFrame, context_minutes: int, min_bars: int, last: int) -> DataFrame:
    """The last bars of a ticker with min_bars or more in [ts - context, ts), with rolling_step from 1."""
    w = Window.partitionBy("ticker").orderBy(micros("ts")).rangeBetween(-context_minutes * 60_000_000, -1)
    x = bars.withColumn("n_context", F.count("*").over(w)).filter(F.col("n_context") >= min_bars)
    x = x.withColumn("back", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("ts").desc()))).filter(F.col("back") <= last)
    return x.withColumn("rolling_step", F.row_number().over(Window.partitionBy("ticker").orderBy("ts"))).drop("back")


def common_targets(targets: DataFrame, reference: str) -> DataFrame:
    return targets.join(targets.filter(F.col("ticker") == reference).select("ts"), "ts", "left_semi")


def eval_windows(bars: DataFrame, lookback: int, pred_len: int, k: int) -> DataFrame:
    """End places lookback, lookback + pred_len, ... of each ticker's bars; the last k."""
    w = Window.partitionBy("ticker")
    x = bars.withColumn("i", F.row_number().over(w.orderBy("ts")) - 1).withColumn("n", F.count("*").over(w))
    x = x.filter((F.col("i") >= lookback) & (F.pmod(F.col("i") - lookback, F.lit(pred_len)) == 0) & (F.col("i") + pred_len <= F.col("n")))
    return x.withColumn("back", F.row_number().over(w.orderBy(F.col("i").desc()))).filter(F.col("back") <= k).select("ticker", "ts", "i")


def sample_consensus(samples: Column, last_close: Column, actual: Column, threshold: float) -> Column:
    """Mean of samples, majority sign against the last close (ties to the smallest), its share, and hit."""
    signs = F.transform(samples, lambda s: F.signum(s - last_close).cast("int"))
    count = lambda v: F.size(F.filter(signs, lambda s: s == v))
    best = F.greatest(count(-1), count(0), count(1))
    vote = F.when(count(-1) == best, -1).when(count(0) == best, 0).otherwise(1)
    mean = F.aggregate(samples, F.lit(0.0), lambda a, s: a + s) / F.size(samples)
    share = best / F.size(samples)
    return F.struct(mean.alias("prediction"), vote.alias("vote"), share.alias("confidence"), (share >= threshold).alias("confident"), (vote == F.signum(actual - last_close).cast("int")).alias("hit"))


def backtest_summary(pred: DataFrame) -> DataFrame:
    """Errors, accuracies, mean seconds and bars by model, by (model, ticker) and by (model, ts), in one pass of grouping sets.

    pred may have columns seconds and bars (of a prediction); without them both are null.
    """
    err = F.col("prediction") - F.col("actual")
    x = pred.withColumns({"err": err, "pct": F.when(F.col("actual") != 0, F.abs(err / F.col("actual")))})
    x = x.withColumns({c: F.lit(None).cast("double") for c in ("seconds", "bars") if c not in pred.columns})
    sets = [[F.col("model")], [F.col("model"), F.col("ticker")], [F.col("model"), F.col("ts")]]
    return x.groupingSets(sets, "model", "ticker", "ts").agg(
        F.avg(F.abs("err")).alias("mae"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"), F.avg("pct").alias("mape"), F.avg(F.col("hit").cast("double")).alias("accuracy"),
        F.avg("confidence").alias("confidence"), F.avg(F.col("confident").cast("double")).alias("coverage"), F.avg(F.when(F.col("confident"), F.col("hit").cast("double"))).alias("strict_accuracy"),
        F.avg(F.col("seconds").cast("double")).alias("seconds"), F.avg(F.col("bars").cast("double")).alias("bars"), F.count("*").alias("n"),
    )


PRICE_COLUMNS = ("open", "high", "low", "close")


def context_matrix(bars: DataFrame, length: int, clip: float = 5.0) -> DataFrame:
    """Per (ticker, ts) with `length` bars up to it: z, the clipped z-scores of the six columns of each bar, and stamps, its calendar parts.

    An absent volume makes volume and amount 0; an absent amount is volume times
    the mean of the four prices.
    """
    x = bars
    if "volume" not in x.columns:
        x = x.withColumns({"volume": F.lit(0.0), "amount": F.lit(0.0)})
    if "amount" not in x.columns:
        x = x.withColumn("amount", F.col("volume") * sum((F.col(c) for c in PRICE_COLUMNS), F.lit(0.0)) / len(PRICE_COLUMNS))
    names = (*PRICE_COLUMNS, "volume", "amount")
    w = Window.partitionBy("ticker").orderBy("ts").rowsBetween(-length + 1, 0)
    bar = F.struct("ts", *[F.col(c).cast("double").alias(c) for c in names])
    x = x.withColumns({"ctx": F.collect_list(bar).over(w)} | {f"{f}_{c}": g(c).over(w) for c in names for f, g in (("mean", F.avg), ("std", F.stddev_pop))}).filter(F.size("ctx") == length)
    score = lambda b, c: F.greatest(F.lit(-clip), F.least(F.lit(clip), (b[c] - F.col(f"mean_{c}")) / (F.col(f"std_{c}") + 1e-5)))
    z = F.transform("ctx", lambda b: F.array(*[score(b, c) for c in names]))
    stamps = F.transform("ctx", lambda b: F.array(*[p(b["ts"]) for p in (F.minute, F.hour, F.weekday, F.dayofmonth, F.month)]))
    return x.select("ticker", "ts", z.alias("z"), stamps.alias("stamps"))


#: From the bars known (in order of ts) and the times to come: samples of the close at each of those times.
Predictor = Callable[[pd.DataFrame, list], Sequence[Sequence[float]]]


def rolling_backtest(bars: DataFrame, targets: DataFrame, predictor: Predictor, context: int) -> DataFrame:
    """Samples of a pluggable predictor for each target from the bars before it.

    Bars and targets of a ticker and month meet in one group, with one context
    of bars from the month before; contexts aren't joined row by row.
    """
    month = F.date_trunc("month", F.col("ts"))
    at = bars.withColumn("seq", F.row_number().over(Window.partitionBy("ticker").orderBy("ts")))
    first = at.groupBy("ticker", month.alias("m")).agg(F.min("seq").alias("first_seq"))
    own = at.withColumn("m", month).select("ticker", "m", "ts", "close", "seq")
    lead = at.join(first, "ticker").filter((F.col("seq") < F.col("first_seq")) & (F.col("seq") >= F.col("first_seq") - context)).select("ticker", "m", "ts", "close", "seq")
    wanted = targets.select("ticker", "ts", F.lit(True).alias("wanted"))
    rows = own.union(lead).join(wanted, ["ticker", "ts"], "left").withColumn("own", F.date_trunc("month", F.col("ts")) == F.col("m"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("seq").reset_index(drop=True)
        out = [(r.ticker, r.ts, list(predictor(g.iloc[max(0, i - context) : i], [r.ts])[0]), g["close"].iloc[i - 1], r.close) for i, r in enumerate(g.itertuples()) if r.wanted is True and r.own and i > 0]
        return pd.DataFrame(out, columns=["ticker", "ts", "samples", "last_close", "actual"])

    return rows.groupBy("ticker", "m").applyInPandas(run, "ticker string, ts timestamp_ntz, samples array<double>, last_close double, actual double")


def business_days(last: Column, n: int) -> Column:
    """The n days after last's that are no Saturday or Sunday, at midnight."""
    day = F.to_date(last)
    days = F.sequence(F.date_add(day, 1), F.date_add(day, n + 2 * (n // 5) + 4))
    return F.transform(F.slice(F.filter(days, lambda d: F.weekday(d) < 5), 1, n), lambda d: d.cast("timestamp_ntz"))


def coming_hours(last: Column, n: int) -> Column:
    """The n times an hour apart after last."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: last + F.make_interval(hours=k))


def forecast(context: DataFrame, predictor: Predictor, stamps: Callable[[Column], Column], least: int = 30) -> DataFrame:
    """(as_of, ticker, step, ts, samples, last_close, bars): samples of a predictor for coming times, from the bars that an as_of knows.

    context: (as_of, ticker, ts, close, ...) with a bounded number of bars for each
    as_of and ticker, as bars_as_of() gives; under `least` there is no forecast.
    stamps gives the coming times from the last bar's, see business_days() and
    coming_hours().
    """
    w = Window.partitionBy("as_of", "ticker")
    x = context.withColumns({"_n": F.count("*").over(w), "_last": F.max("ts").over(w)}).filter(F.col("_n") >= least).withColumn("_stamps", stamps(F.col("_last"))).drop("_last")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts")
        first = g.iloc[0]
        times = [pd.Timestamp(t) for t in first["_stamps"]]
        found = predictor(g.drop(columns=["_n", "_stamps"]).reset_index(drop=True), times)
        rows = [(first["as_of"], first["ticker"], k, t, [float(v) for v in s], float(g["close"].iloc[-1]), len(g)) for k, (t, s) in enumerate(zip(times, found, strict=True), 1)]
        return pd.DataFrame(rows, columns=["as_of", "ticker", "step", "ts", "samples", "last_close", "bars"])

    return x.groupBy("as_of", "ticker").applyInPandas(run, "as_of timestamp_ntz, ticker string, step int, ts timestamp_ntz, samples array<double>, last_close double, bars int")


def forecast_scores(forecasts: DataFrame, decisions: DataFrame, universe: DataFrame) -> DataFrame:
    """(as_of, ticker, value, score) of the whole universe: the mean sample of the first step as a return, ranked among the tickers; without a forecast 0.5."""
    mean = F.aggregate("samples", F.lit(0.0), lambda a, s: a + s) / F.size("samples")
    first = forecasts.filter("step = 1").select("as_of", "ticker", F.when(F.col("last_close") > 0, mean / F.col("last_close") - 1).otherwise(0.0).alias("value"))
    every = decisions.select("as_of").distinct().join(sized(universe.select("ticker").distinct()), how="cross")
    return percentile_scores(every.join(first, ["as_of", "ticker"], "left")).select("as_of", "ticker", "value", "score")

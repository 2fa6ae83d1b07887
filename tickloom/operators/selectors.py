"""Training rows and matrices of selectors, metrics of windows, and universes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scores import interval_features


def returns_map(raw: Column, legacy: dict[str, Column]) -> Column:
    """A JSON map of returns; legacy columns stand in for absent keys, and a null is 0."""
    got = F.coalesce(F.from_json(raw, "map<string, double>"), F.create_map().cast("map<string, double>"))
    got = F.transform_values(got, lambda k, v: F.coalesce(v, F.lit(0.0)))
    old = F.map_filter(F.create_map(*[x for k, c in legacy.items() for x in (F.lit(k), F.coalesce(c.cast("double"), F.lit(0.0)))]), lambda k, v: ~F.map_contains_key(got, k))
    return F.map_concat(got, old)


def training_rows(features: DataFrame, returns: DataFrame, limit: int, required: list[str]) -> DataFrame:
    """features (ts, ...) with returns (ts, returns map) of the newest times, of those whose map has all required selectors."""
    newest = features.join(returns, "ts").orderBy(F.col("ts").desc()).limit(limit)
    return newest.filter(F.size(F.array_except(F.array(*map(F.lit, required)), F.map_keys("returns"))) == 0)


def selector_matrix(rows: DataFrame, features: list[str], selectors: list[str]) -> DataFrame:
    """One row for each time and selector: features in sorted order (not finite: 0), index and one-hot of the selector, label (an absent return: 0)."""
    value = [F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c)).alias(c) for c in sorted(features)]
    label = lambda s: F.coalesce(F.when(~F.isnan(F.col("returns")[s]) & (F.abs(F.col("returns")[s]) != float("inf")), F.col("returns")[s]), F.lit(0.0))
    each = F.array(*[F.struct(F.lit(s).alias("selector"), F.lit(i).cast("long").alias("selector_index"), label(s).alias("label")) for i, s in enumerate(selectors)])
    x = rows.select("ts", *value, F.inline(each))
    return x.withColumns({f"is_{s}": (F.col("selector") == s).cast("double") for s in selectors})


def bootstrap_rows(inputs: DataFrame, paper: DataFrame) -> DataFrame:
    """Training rows of past times: features of inputs (as_of, ticker, forecast), all else at its default, with the paper returns (as_of, selector, ret) as a map."""
    absent = {c: F.lit(None).cast("double") for c in ("news_score", "confidence", "priced_risk", "cost", "spread", "news_count")} | {c: F.lit(None).cast("boolean") for c in ("tradable", "degraded", "depth_unknown", "missing_bbo")}
    returns = paper.groupBy("as_of").agg(F.map_from_entries(F.collect_list(F.struct("selector", "ret"))).alias("returns"))
    return interval_features(inputs.withColumns(absent)).join(returns, "as_of")


def window_metrics(pred: DataFrame) -> DataFrame:
    """Errors and direction accuracy of (model, ticker, window) from rows with actual, prediction and last_close."""
    err = F.col("prediction") - F.col("actual")
    right = F.signum(F.col("prediction") - F.col("last_close")) == F.signum(F.col("actual") - F.col("last_close"))
    return pred.groupBy("model", "ticker", "window").agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.when(F.col("actual") != 0, F.abs(err / F.col("actual")))).alias("mape"),
        F.avg(right.cast("double")).alias("accuracy"), F.count("*").alias("n"),
    )


def select_universe(candidates: DataFrame, targets: DataFrame, reference: int, top_n: int, coverage: float) -> DataFrame:
    """The first top_n candidates (ticker, cap) by cap that have coverage * reference targets or more, with their first and last; an error if there are fewer."""
    have = targets.groupBy("ticker").agg(F.count("*").alias("n_targets"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    x = candidates.join(have, "ticker").withColumn("coverage", F.col("n_targets") / reference).filter(F.col("n_targets") >= F.ceil(F.lit(reference * coverage)))
    out = x.orderBy(F.col("cap").desc(), "ticker").limit(top_n)
    if (found := out.count()) < top_n:
        raise ValueError(f"{found} of {top_n} candidates have enough targets")
    return out


def drop_incomplete_daily(bars: DataFrame, today: str) -> DataFrame:
    """Daily bars without a ticker's last one if it begins today or later and ends before 23:59."""
    last = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("ts").desc())) == 1
    cut = (F.col("ts") >= F.lit(today).cast("timestamp_ntz")) & (F.date_format("end_ts", "HH:mm:ss") < "23:59:00")
    return bars.withColumn("_last", last).filter(~(F.col("_last") & cut)).drop("_last")

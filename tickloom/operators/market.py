"""Quotes: cost snapshots, book levels, quality of a set of quotes; universe by capitalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Floors of the estimated cost.
COST_FLOOR, HALF_SPREAD_FLOOR = 0.0015, 0.0005


def first_positive(*columns: str) -> Column:
    return F.coalesce(*[F.when((F.col(c) > 0) & ~F.isnan(c) & (F.col(c) < float("inf")), F.col(c)) for c in columns])


def _levels_value(levels: str) -> Column:
    part = F.transform(levels, lambda x: F.greatest(x["price"], F.lit(0.0)) * F.greatest(x["quantity"], F.lit(0.0)))
    return F.coalesce(F.aggregate(part, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))), F.lit(0.0))


def cost_snapshot(quotes: DataFrame) -> DataFrame:
    """Costs, depth and flags of quotes (last_price, prev_price, bid, ask; also bid_levels, ask_levels and source_quality).

    A side without a price takes its best level's. A book counts as present if
    both sides are above 0 and don't cross; else mid is the last price, the
    spread 0 and the cost unknown, so at its floor.
    """
    level = "array<struct<price: double, quantity: double>>"
    absent = {c: F.lit(None).cast(t) for c, t in (("bid_levels", level), ("ask_levels", level), ("source_quality", "string")) if c not in quotes.columns}
    x = quotes.withColumns({"last": F.coalesce(first_positive("last_price", "prev_price"), F.lit(0.0)), **absent})
    x = x.withColumns({c: F.coalesce(F.nullif(c, F.lit(0.0)), F.get(f"{c}_levels", 0)["price"], F.lit(0.0)) for c in ("bid", "ask")})
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    deep = some("bid_levels") & some("ask_levels")
    quality = F.when(deep, "depth").when((F.col("bid") != 0) & (F.col("ask") != 0), "bbo").otherwise("missing_bbo")
    bbo = (F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("ask") >= F.col("bid"))
    x = x.withColumns({"mid": F.when(bbo, (F.col("bid") + F.col("ask")) / 2).otherwise(F.col("last")), "missing_bbo": ~bbo, "source_quality": F.coalesce("source_quality", quality)})
    x = x.withColumn("spread", F.when(bbo, F.greatest((F.col("ask") - F.col("bid")) / F.col("mid"), F.lit(0.0))).otherwise(0.0))
    x = x.withColumn("unknown_cost", F.col("missing_bbo") | F.col("source_quality").isin("missing", "missing_bbo"))
    return x.withColumns({
        "last": F.coalesce(F.nullif("last", F.lit(0.0)), "mid"),
        "tradable": F.coalesce(F.nullif("last", F.lit(0.0)), "mid") > 0,
        "cost": F.when(F.col("unknown_cost"), COST_FLOOR).otherwise(F.greatest(F.col("spread") / 2, F.lit(HALF_SPREAD_FLOOR))),
        "depth_unknown": ~deep,
        "liquidity_degraded": (F.col("source_quality") != "depth") | F.col("missing_bbo"),
        "depth_shortfall": F.lit(False),
        "bid_depth_value": _levels_value("bid_levels"),
        "ask_depth_value": _levels_value("ask_levels"),
    })


#: What a ticker without a quote has.
ABSENT = {
    "tradable": False, "last": 0.0, "bid": 0.0, "ask": 0.0, "mid": 0.0, "cost": COST_FLOOR, "spread": 0.0, "source_quality": "missing", "missing_bbo": True, "unknown_cost": True,
    "depth_unknown": True, "liquidity_degraded": True, "depth_shortfall": True, "bid_depth_value": 0.0, "ask_depth_value": 0.0,
}


def fill_missing(snapshots: DataFrame, universe: DataFrame) -> DataFrame:
    """Snapshots of every ticker of the universe; one without a quote has the values of ABSENT in the columns that there are."""
    x = universe.join(snapshots.withColumn("_seen", F.lit(True)), "ticker", "left")
    return x.withColumns({c: F.when(F.col("_seen"), F.col(c)).otherwise(F.lit(v)) for c, v in ABSENT.items() if c in snapshots.columns}).drop("_seen")


def orderbook_levels(records: DataFrame, depth: int = 10) -> DataFrame:
    """Best levels of each side for each ticker from rows (ticker, side, price, quantity): bids falling, asks rising."""
    side = F.when(F.lower("side").contains("b"), "bid").otherwise("ask")
    x = records.filter("price > 0").withColumn("s", side)
    order = F.when(F.col("s") == "bid", -F.col("price")).otherwise(F.col("price"))
    top = x.withColumn("level", F.row_number().over(Window.partitionBy("ticker", "s").orderBy(order, "quantity"))).filter(F.col("level") <= depth)
    return top.select("ticker", F.col("s").alias("side"), "level", "price", "quantity")


def quote_quality(quotes: DataFrame) -> DataFrame:
    """Counts of snapshots (as_of, ...) with each flag, of each quality as a map, and the largest cost."""
    flag = lambda c: F.count(F.when(F.col(c), 1))
    per = quotes.groupBy("as_of", "source_quality").agg(
        F.count("*").alias("n"), flag("tradable").alias("tradable"), F.count(F.when(F.col("last") > 0, 1)).alias("priced"), flag("missing_bbo").alias("missing"),
        flag("liquidity_degraded").alias("degraded"), flag("depth_unknown").alias("depth_unknown"), F.max("cost").alias("max_cost"),
    )
    sums = [F.sum(c).alias(c) for c in ("n", "tradable", "priced", "missing", "degraded", "depth_unknown")]
    return per.groupBy("as_of").agg(*sums, F.max("max_cost").alias("max_cost"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_quality", "n")))).alias("qualities"))


def universe_candidates(securities: DataFrame, market: DataFrame, n: int) -> DataFrame:
    """Inner join of ordinary shares (sectype 1) on (secid, board), cap above 0, the best cap of a secid, the first n."""
    x = securities.filter("sectype = '1'").join(market, ["secid", "board"]).filter("cap > 0")
    best = x.withColumn("rn", F.row_number().over(Window.partitionBy("secid").orderBy(F.col("cap").desc(), "board"))).filter("rn = 1").drop("rn")
    return best.orderBy(F.col("cap").desc(), "secid").limit(n)

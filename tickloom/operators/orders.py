"""Order plans: candidates, depth and cash limits, admission to the ledger. Folds run as aggregate() over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_ORDER_VALUE = 100.0
_LEVELS = "array<struct<price:double,quantity:double>>"


def shares_to_lots(shares: Column, lot: Column) -> Column:
    finite = F.coalesce(F.abs(shares) < float("inf"), F.lit(False))  # NaN sorts above infinity
    return F.when(finite, (F.signum(shares) * F.floor(F.abs(shares) / lot)).cast("long")).otherwise(F.lit(0).cast("long"))


def position_targets(held: DataFrame, targets: DataFrame) -> DataFrame:
    """Full outer join of held lots and target weights on (as_of, ticker); a missing side is 0."""
    return held.join(targets, ["as_of", "ticker"], "full").na.fill(0, ["lots"]).na.fill(0.0, ["target_weight"])


def equity(positions: DataFrame, cash: Column, default: float = 100_000.0) -> DataFrame:
    """max(cash, 0) + sum of |lots| * lot * price for each as_of; the default when both are 0."""
    held = F.sum(F.abs("lots") * F.col("lot_size") * F.col("price"))
    out = positions.groupBy("as_of").agg(held.alias("held"), F.max(F.greatest(cash, F.lit(0.0))).alias("cash"))
    return out.withColumn("equity", F.when((F.col("held") == 0) & (F.col("cash") == 0), F.lit(default)).otherwise(F.col("held") + F.col("cash")))


def order_candidates(x: DataFrame) -> DataFrame:
    """Rows (as_of, ticker, lots, target_weight, price, lot_size, equity) that need an order of 100 or more."""
    target = shares_to_lots(F.col("equity") * F.col("target_weight") / F.col("price"), F.col("lot_size"))
    out = x.filter("price > 0").withColumn("target_lots", target).withColumn("delta", F.col("target_lots") - F.col("lots")).filter("delta <> 0")
    out = out.withColumns({"direction": F.when(F.col("delta") > 0, "B").otherwise("S"), "requested": F.abs("delta"), "lot_value": F.col("lot_size") * F.col("price")})
    out = out.filter(F.col("requested") * F.col("lot_value") >= MIN_ORDER_VALUE)
    first = Window.partitionBy("as_of").orderBy((F.col("direction") == "B").cast("int"), F.abs("target_weight").desc(), "ticker", "requested", "lot_value")
    return out.withColumn("priority", F.row_number().over(first))


def risk_increasing(current: Column, target: Column) -> Column:
    """Whether a move from the current to the target position opens, enlarges or turns it."""
    same_side = F.signum(current) * F.signum(target) > 0
    return (current != target) & F.when(same_side, F.abs(target) > F.abs(current)).otherwise(target != 0)


def _positive(x: Column) -> Column:
    """x is a number above 0; NaN, which sorts above all, is none."""
    return F.coalesce((x > 0) & (x < float("inf")), F.lit(False))


def depth_cost(levels: Column, side: Column, lots: Column, lot_size: Column, mid: Column, fallback: Column) -> Column:
    """Walk levels array<struct<price, quantity>> from the best for lots of an order on that side ("ask": a buy).

    cost is what the average price is worse than mid (than the fallback, if mid
    isn't above 0), at least 0; max_lots is what the levels hold that were visited
    before the order was filled, the last one whole. Levels without a price or
    quantity above 0 are skipped; null levels are as an empty book.
    """
    zero = F.struct(F.lit(0.0).alias("filled"), F.lit(0.0).alias("value"), F.lit(0.0).alias("available"))
    shares = (F.greatest(lots, F.lit(0)) * F.greatest(lot_size, F.lit(1))).cast("double")

    def step(s: Column, level: Column) -> Column:
        take = F.least(level["quantity"], shares - s["filled"])
        more = F.struct((s["filled"] + take).alias("filled"), (s["value"] + take * level["price"]).alias("value"), (s["available"] + level["quantity"]).alias("available"))
        return F.when(s["filled"] < shares, more).otherwise(s)

    book = F.transform(levels, lambda x: F.struct(x["price"].cast("double").alias("price"), x["quantity"].cast("double").alias("quantity")))
    book = F.coalesce(book, F.array().cast(_LEVELS))
    end = F.aggregate(F.filter(book, lambda x: _positive(x["price"]) & _positive(x["quantity"])), zero, step)
    reference = F.when(_positive(mid), mid).otherwise(fallback)
    move = (end["value"] / end["filled"] - reference) / reference
    cost = F.when((end["filled"] > 0) & (reference > 0), F.greatest(F.when(side == "ask", move).otherwise(-move), F.lit(0.0))).otherwise(0.0)
    most = F.floor(end["available"] / F.greatest(lot_size, F.lit(1))).cast("long")
    found = F.struct(end["filled"].alias("filled"), cost.alias("cost"), most.alias("max_lots"), (end["filled"] < shares).alias("shortfall"))
    none = F.struct(F.lit(0.0).alias("filled"), F.lit(0.0).alias("cost"), F.lit(0).cast("long").alias("max_lots"), F.lit(False).alias("shortfall"))
    return F.when(shares > 0, found).otherwise(none)


#: Share of equity that a risk-increasing order may be worth where its liquidity is in doubt.
DEGRADED_SHARE = 0.20


def with_liquidity(x: DataFrame) -> DataFrame:
    """Candidates with what their own side of the book allows: liquidity_quantity, liquidity_cap_reason, expected_cost_pct, depth_shortfall.

    x: a candidate of order_candidates() with bid_levels, ask_levels, mid_price,
    estimated_cost_pct, liquidity_degraded, missing_bbo, unknown_cost. A side with
    levels, even useless ones, is walked; without, an order that increases risk
    under doubtful liquidity may be worth a share of equity.
    """
    buy = F.col("direction") == "B"
    levels = F.when(buy, F.col("ask_levels").cast(_LEVELS)).otherwise(F.col("bid_levels").cast(_LEVELS))
    mid = F.when(F.col("mid_price").isNull() | F.isnan("mid_price"), F.col("price")).otherwise(F.col("mid_price"))
    walked = depth_cost(F.col("levels"), F.when(buy, "ask").otherwise("bid"), F.col("requested"), F.col("lot_size"), mid, F.col("price"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    y = x.withColumn("levels", levels).withColumn("book", walked)
    deep = F.coalesce(F.size("levels"), F.lit(0)) > 0
    thin = ~deep & risk_increasing(F.col("lots"), F.col("target_lots")) & (flag("liquidity_degraded") | flag("missing_bbo") | flag("unknown_cost"))
    room = F.when(deep, F.col("book.max_lots")).when(thin, F.when(F.col("lot_value") > 0, F.floor(F.greatest("equity", F.lit(0.0)) * DEGRADED_SHARE / F.col("lot_value"))).otherwise(0))
    capped = F.coalesce(room < F.col("requested"), F.lit(False))
    some, none = (F.when(deep, a).otherwise(b) for a, b in (("depth_cap", "degraded_liquidity_cap"), ("depth_shortfall", "degraded_liquidity_skip")))
    known = F.when(F.col("estimated_cost_pct").isNull() | F.isnan("estimated_cost_pct"), 0.0).otherwise(F.col("estimated_cost_pct"))
    return y.withColumns(
        {
            "liquidity_quantity": F.when(capped, F.greatest(room, F.lit(0))).otherwise(F.col("requested")).cast("long"), "liquidity_cap_reason": F.when(capped, F.when(room > 0, some).otherwise(none)).otherwise(""),
            "expected_cost_pct": F.when(deep, F.greatest(F.col("book.cost"), known)).otherwise(known), "depth_shortfall": F.when(deep, F.col("book.shortfall")).otherwise(flag("depth_shortfall") if "depth_shortfall" in x.columns else F.lit(False)),
        }
    ).drop("levels", "book")


#: What a planned order carries besides its own numbers.
_CARRIED = ("price", "target_weight", "lot_size", "liquidity_cap_reason", "expected_cost_pct", "bbo_spread_pct", "source", "source_quality", "liquidity_degraded", "depth_shortfall", "depth_unknown")


def plan_orders(x: DataFrame) -> DataFrame:
    """Orders of each as_of from candidates with their quotes (see with_liquidity()) and the decision's cash, by one fold in order of priority.

    An order is cut by the liquidity of its side, then, if it buys, by the cash
    that earlier buys left, which affords less than was asked for; both reasons
    are joined in cap_reason. Sells don't fund buys. An order that gets too small
    is dropped, yet what a buy had taken of the cash stays taken. A decision has a
    row a ticker, so the fold's array is as long as the universe.
    """
    y = with_liquidity(x)
    own = F.struct("priority", "ticker", "direction", "requested", "lots", "target_lots", "lot_value", "liquidity_quantity", F.struct(*_CARRIED).alias("more"))
    lists = y.groupBy("as_of").agg(F.array_sort(F.collect_list(own)).alias("o"), F.max("cash").alias("cash"))
    step_kind = "struct<left:double,i:int,out:array<struct<i:int,quantity:bigint,order_value:double,before:double,after:double,cap_reason:string>>>"
    zero = F.struct(F.greatest("cash", F.lit(0.0)).alias("left"), F.lit(0).alias("i"), F.expr("cast(array() as array<struct<i:int,quantity:bigint,order_value:double,before:double,after:double,cap_reason:string>>)").alias("out"))

    def step(s: Column, o: Column) -> Column:
        buy = o["direction"] == "B"
        afford = F.when(o["lot_value"] > 0, F.floor(s["left"] / o["lot_value"])).otherwise(0)
        short = buy & (afford < o["requested"])
        q = F.least(o["requested"], o["liquidity_quantity"])
        q = F.when(short, F.least(q, F.greatest(afford, F.lit(0)))).otherwise(q).cast("long")
        value = q * o["lot_value"]
        after = F.when(buy, F.greatest(s["left"] - value, F.lit(0.0))).otherwise(s["left"])
        reason = F.concat_ws("+", F.nullif(F.when(o["liquidity_quantity"] < o["requested"], o["more"]["liquidity_cap_reason"]), F.lit("")), F.when(short, "cash_cap"))
        new = F.struct(s["i"].alias("i"), q.alias("quantity"), value.alias("order_value"), F.when(buy, s["left"]).alias("before"), F.when(buy, after).alias("after"), reason.alias("cap_reason"))
        out = F.when((q > 0) & (value >= MIN_ORDER_VALUE), F.concat(s["out"], F.array(new))).otherwise(s["out"])
        return F.struct(after.alias("left"), (s["i"] + 1).alias("i"), out.alias("out")).cast(step_kind)

    done = lists.withColumn("done", F.aggregate("o", zero.cast(step_kind), step)["out"]).select("as_of", "o", F.explode("done").alias("d"))
    z = done.select("as_of", F.get("o", F.col("d.i")).alias("o"), "d")
    signed = F.when(F.col("o.direction") == "B", F.col("d.quantity")).otherwise(-F.col("d.quantity"))
    return z.select(
        "as_of", "o.priority", "o.ticker", "o.direction", "d.quantity", F.col("o.requested").alias("requested_quantity"), F.col("o.lots").alias("current_position"), (F.col("o.lots") + signed).alias("target_position"),
        F.col("o.target_lots").alias("requested_target_position"), "d.order_value", F.col("d.before").alias("cash_before_order"), F.col("d.after").alias("cash_after_order"), "d.cap_reason",
        *[F.col(f"o.more.{c}").alias("liquidity_source" if c == "source" else c) for c in _CARRIED],
    )


def cash_cap(orders: DataFrame) -> DataFrame:
    """Quantities that the cash of each as_of affords, in order of priority; sells don't fund buys.

    A buy that gets too small is dropped, yet its cash stays spent. A decision
    has one row a ticker, so the fold's array is as long as the universe.
    orders: as_of, priority, ticker, direction, requested, quantity, lot_value, cash.
    """
    row = F.struct("priority", "ticker", "direction", "requested", "quantity", "lot_value")
    lists = orders.groupBy("as_of").agg(F.array_sort(F.collect_list(row)).alias("o"), F.max("cash").alias("cash"))
    blank = F.expr("cast(array() as array<struct<ticker:string,direction:string,requested:bigint,quantity:bigint,order_value:double,cash_after:double,capped:boolean>>)")
    zero = F.struct(F.greatest("cash", F.lit(0.0)).alias("left"), blank.alias("out"))

    def step(s: Column, o: Column) -> Column:
        buy = o["direction"] == "B"
        afford = F.floor(s["left"] / o["lot_value"])
        capped = buy & (afford < o["requested"])
        q = F.when(capped, F.least(o["quantity"], F.greatest(afford, F.lit(0)))).otherwise(o["quantity"]).cast("long")
        value = q * o["lot_value"]
        left = F.when(buy, F.greatest(s["left"] - value, F.lit(0.0))).otherwise(s["left"])
        new = F.struct(o["ticker"].alias("ticker"), o["direction"].alias("direction"), o["requested"].alias("requested"), q.alias("quantity"), value.alias("order_value"), F.when(buy, left).alias("cash_after"), capped.alias("capped"))
        return F.struct(left.alias("left"), F.when((q > 0) & (value >= MIN_ORDER_VALUE), F.concat(s["out"], F.array(new))).otherwise(s["out"]).alias("out"))

    return lists.select("as_of", F.inline(F.aggregate("o", zero, step)["out"]))


#: Attempts of the ledger that count against a day's cap.
COUNTED = ("submitted", "dry_run")


def ledger_admit(orders: DataFrame, ledger: DataFrame, max_daily: int) -> DataFrame:
    """status of orders (order_key, day, seq), a day's in order of seq, against ledger (order_key, day, status).

    Once a day has max_daily counted attempts every later order is
    blocked_daily_trade_limit, also one whose key is known. Before that a key that
    the ledger has, with any status, or an earlier order of the day, is
    duplicate_skipped; others are dry_run and count.
    """
    known = ledger.select("order_key", F.lit(True).alias("known")).distinct()
    used = ledger.filter(F.col("status").isin(*COUNTED)).groupBy("day").agg(F.count("*").alias("used"))
    x = orders.join(known, "order_key", "left").join(used, "day", "left").na.fill(0, ["used"])
    again = F.row_number().over(Window.partitionBy("day", "order_key").orderBy("seq")) > 1
    x = x.withColumn("dup", F.col("known").isNotNull() | again)
    before = F.coalesce(F.sum((~F.col("dup")).cast("int")).over(Window.partitionBy("day").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    status = F.when(F.col("used") + before >= max_daily, "blocked_daily_trade_limit").when(F.col("dup"), "duplicate_skipped").otherwise("dry_run")
    return x.withColumn("status", status).drop("dup", "known", "used")

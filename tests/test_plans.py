"""Order plans, ledgers, decision times, tagging and redaction against small loops."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import calendar, text
from tickloom.operators import backtest, news, orders

T0 = dt.datetime(2024, 1, 1)
LEVELS = "array<struct<price: double, quantity: double>>"
CANDIDATE = f"as_of int, ticker string, lots long, target_weight double, price double, lot_size int, equity double, cash double, bid_levels {LEVELS}, ask_levels {LEVELS}, mid_price double, estimated_cost_pct double, bbo_spread_pct double, liquidity_degraded boolean, missing_bbo boolean, unknown_cost boolean, source string, source_quality string, depth_unknown boolean"


def walked(levels, side, lots, lot, fallback, mid):
    shares = max(lots, 0) * max(lot, 1)
    left, notional, filled, seen = shares, 0.0, 0.0, 0.0
    for p, q in levels:
        if not (p and q and p > 0 and q > 0 and math.isfinite(p) and math.isfinite(q)):
            continue
        seen += q
        take = min(q, left)
        notional, filled, left = notional + take * p, filled + take, left - take
        if left <= 0:
            break
    most = math.floor(seen / max(lot, 1))
    if filled <= 0:
        return 0.0, most, True
    ref = mid if mid > 0 else fallback
    move = (notional / filled - ref) / ref
    return max(move if side == "ask" else -move, 0.0), most, left > 0


def planned(rows):
    """A decision's orders, one after the other."""
    found = []
    for r in rows:
        if r["price"] <= 0:
            continue
        raw = r["equity"] * r["target_weight"] / r["price"]
        target = int(math.copysign(math.floor(abs(raw) / r["lot_size"]), raw))
        delta = target - r["lots"]
        if delta and abs(delta) * r["lot_size"] * r["price"] >= 100:
            found.append(r | {"target": target, "buy": delta > 0, "asked": abs(delta)})
    found.sort(key=lambda r: (r["buy"], -abs(r["target_weight"]), r["ticker"]))
    cash, out = max(found[0]["cash"], 0.0) if found else 0.0, []
    for r in found:
        q, reasons, value = r["asked"], [], r["price"] * r["lot_size"]
        levels = r["ask_levels" if r["buy"] else "bid_levels"] or []
        cost, short = r["estimated_cost_pct"] or 0.0, False
        if levels:
            walk, most, short = walked(levels, "ask" if r["buy"] else "bid", q, r["lot_size"], r["price"], r["mid_price"] if r["mid_price"] is not None else r["price"])
            cost = max(cost, walk)
            if most < q:
                q, reasons = max(most, 0), ["depth_cap" if most > 0 else "depth_shortfall"]
        elif (r["liquidity_degraded"] or r["missing_bbo"] or r["unknown_cost"]) and r["target"] != r["lots"] and (abs(r["target"]) > abs(r["lots"]) if r["target"] * r["lots"] > 0 else r["target"] != 0):
            most = math.floor(max(r["equity"], 0.0) * 0.2 / value)
            if most < q:
                q, reasons = most, ["degraded_liquidity_cap" if most > 0 else "degraded_liquidity_skip"]
        own, before, after = "+".join(reasons), None, None
        if r["buy"]:
            room, before = math.floor(cash / value), cash
            if room < r["asked"]:
                q = min(q, max(room, 0))
                reasons.append("cash_cap")
            after = cash = max(cash - q * value, 0.0)
        if q > 0 and q * value >= 100:
            out.append((r["ticker"], q, r["lots"] + (q if r["buy"] else -q), r["target"], round(q * value, 6), before, after, "+".join(reasons), own, round(cost, 9), short))
    return out


def test_order_plans_follow_a_loop(spark):
    rng = random.Random(1)
    book = lambda p, up: rng.choice([None, [], [(p, 0.0)], [(None, 5.0), (float("nan"), 3.0), (p, float("inf"))], [(p * (1 + up * 0.001 * k), float(rng.randrange(0, 400))) for k in range(rng.randrange(1, 5))]])
    rows = []
    for as_of in range(60):
        for t in range(rng.randrange(1, 7)):
            p = rng.choice([0.0, 12.5, 100.0, 3.7])
            rows.append((as_of, f"t{t}", rng.randrange(-20, 30), rng.choice([-0.4, 0.0, 0.1, 0.3, 0.9]), p, rng.choice([1, 10]), rng.choice([9000.0, 40_000.0]), [-5.0, 3000.0, 25_000.0][as_of % 3], book(p, -1), book(p, 1), rng.choice([None, 0.0, p * 1.01]), rng.choice([None, 0.002]), 0.001, rng.random() < 0.5, rng.choice([None, False, True]), False, "s", "depth", None))
    names = [c.split()[0] for c in re.split(r", (?![^<]*>)", CANDIDATE)]
    frame = orders.order_candidates(spark.createDataFrame(rows, CANDIDATE)).repartition(5)
    got = orders.plan_orders(frame).orderBy("as_of", "priority").collect()
    want = [(a, *o) for a in range(60) for o in planned([dict(zip(names, r, strict=True)) for r in rows if r[0] == a])]
    seen = [(r.as_of, r.ticker, r.quantity, r.target_position, r.requested_target_position, round(r.order_value, 6), r.cash_before_order, r.cash_after_order, r.cap_reason, r.liquidity_cap_reason, round(r.expected_cost_pct, 9), r.depth_shortfall) for r in got]
    assert seen == want and {"depth_cap+cash_cap", "degraded_liquidity_cap", "cash_cap", ""} <= {r.cap_reason for r in got}


@pytest.mark.parametrize(
    ("row", "expected"),
    [
        # the whole of a thin level, without quotes a share of equity, and cash that sells don't bring
        ((1, "A", 0, 1.0, 100.0, 1, 10_000.0, 10_000.0, None, [(100.2, 30.0)], 100.0, None, 0.0, False, False, False, "", "", False), (100, 30, "depth_cap")),
        ((1, "A", 0, 1.0, 100.0, 1, 10_000.0, 10_000.0, None, None, 100.0, None, 0.0, True, True, True, "", "", True), (100, 20, "degraded_liquidity_cap")),
        ((1, "A", 0, 1.0, 25.0, 10, 1_000_000.0, 500_000.0, None, None, 25.0, None, 0.0, False, False, False, "", "", True), (4000, 2000, "cash_cap")),
    ],
)
def test_golden_caps(spark, row, expected):
    (r,) = orders.plan_orders(orders.order_candidates(spark.createDataFrame([row], CANDIDATE))).collect()
    assert (r.requested_quantity, r.quantity, r.cap_reason) == expected


def test_levels_after_the_fill_do_not_count(spark):
    x = spark.createDataFrame([([(100.0, 40.0), (101.0, 50.0), (102.0, 900.0)],), (None,), ([],)], f"l {LEVELS}")
    got = [tuple(r.r) for r in x.select(orders.depth_cost(F.col("l"), F.lit("ask"), F.lit(6), F.lit(10), F.lit(100.0), F.lit(99.0)).alias("r")).collect()]
    assert got == [(60.0, pytest.approx((4000 + 2020) / 6000 - 1), 9, False), (0.0, 0.0, 0, True), (0.0, 0.0, 0, True)]


def test_ledger_counts_before_it_looks_for_keys(spark):
    def loop(rows, ledger, most):
        keys, used, out = {k for k, _, _ in ledger}, {}, []
        for _, d, s in ledger:
            used[d] = used.get(d, 0) + (s in ("submitted", "dry_run"))
        for key, day, seq in sorted(rows, key=lambda r: (r[1], r[2])):
            if used.get(day, 0) >= most:
                out.append((seq, "blocked_daily_trade_limit"))
            elif key in keys:
                out.append((seq, "duplicate_skipped"))
            else:
                keys.add(key)
                used[day] = used.get(day, 0) + 1
                out.append((seq, "dry_run"))
        return sorted(out)

    rng = random.Random(2)
    for most in (0, 3, 8):
        rows = [(f"d{d}k{rng.randrange(12)}", d, s) for s, d in enumerate(rng.choices(range(6), k=80))]
        ledger = [(f"d{d}k{k}", d, rng.choice(["submitted", "dry_run", "error", None])) for d in range(6) for k in rng.sample(range(14), 3)]
        got = orders.ledger_admit(spark.createDataFrame(rows, "order_key string, day int, seq int"), spark.createDataFrame(ledger, "order_key string, day int, status string"), most).select("seq", "status").collect()
        assert sorted(map(tuple, got)) == loop(rows, ledger, most)


def test_next_decisions_follow_a_loop(spark):
    def is_open(t):
        a, b = ((7, 0), (23, 50)) if t.weekday() < 5 else ((10, 0), (19, 0))
        return dt.time(*a) <= t.time() <= dt.time(*b)

    def following(t, minutes, delay):
        base = t.replace(minute=t.minute // minutes * minutes, second=0, microsecond=0)
        c = base + dt.timedelta(seconds=delay)
        if c <= t:
            c = base + dt.timedelta(minutes=minutes, seconds=delay)
        while not is_open(c):
            c += dt.timedelta(minutes=minutes)
        return c

    rng = random.Random(3)
    times = [T0 + dt.timedelta(seconds=rng.randrange(14 * 86_400), microseconds=rng.randrange(10**6)) for _ in range(600)]
    times += [T0 + dt.timedelta(minutes=30 * k, seconds=s) for k in range(0, 14 * 48, 5) for s in (0, 40, 89, 90, 91)]
    x = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    for minutes, delay in ((30, 90), (30, 0), (15, 60), (60, 3600), (7, 5)):
        got = {r.t: r.n for r in x.withColumn("n", calendar.next_decision(F.col("t"), minutes, delay)).collect()}
        assert got == {t: following(t, minutes, delay) for t in times}


def test_tags_follow_one_pattern_a_term(spark):
    rng = random.Random(4)
    words = ["the", "over", "over the", "the end", "a.b", "c++", "ещё", "Ещё один", "один", "end"]
    terms = {f"T{k}": rng.sample(words, rng.randrange(1, 5)) for k in range(7)} | {"NONE": ["nowhere"], "EMPTY": []}
    parts = ["over", "the", "END", "a.b", "aXb", "c++", "c+", "еще", "ЕЩЁ", "один", "1", "overthe", "—", ",", "\n", "  "]
    rows = [(str(i), rng.choice(["", None, "Over\tthe end"]), "".join(rng.choice(parts) + rng.choice([" ", "", " \n "]) for _ in range(rng.randrange(0, 14))), f"s{i % 5}") for i in range(300)]
    rows += [("n", None, None, None)]
    own = {"s0": ["T0", "ALL", "ZZ"], "s1": ["NONE"], "s2": None, "s3": ["T1", "T1"]}
    got = news.tag_entities(spark.createDataFrame(rows, "news_id string, title string, text string, source string"), terms, spark.createDataFrame(list(own.items()), "source string, tickers array<string>")).collect()
    char = news.WORD_CHARS

    def pattern(term):
        return re.compile(f"(?<![{char}])" + "".join(r"\s+" if c == " " else "[её]" if c in "еёЕЁ" else re.escape(c) for c in term) + f"(?![{char}])", re.IGNORECASE)

    want = {}
    for i, title, body, source in rows:
        both = f"{title or ''}\n{body or ''}"
        for t, ws in terms.items():
            hit = sorted({w for w in ws if pattern(w).search(both)})
            mine = [f"source:{source}"] if t in (own.get(source) or []) else []
            if hit or mine:
                want[i, t] = (",".join((["regex"] if hit else []) + (["source"] if mine else [])), sorted(hit + mine))
    assert {(r.news_id, r.ticker): (r.matched_by, r.terms) for r in got} == want and len(got) == len(want)


def test_one_pattern_grows_with_terms_but_not_its_work(spark):
    """Sharing beginnings keeps the ways at each place few: a pattern of 2,000 terms scans about as fast as one of 20."""
    import time

    rows = spark.range(400).select(F.col("id").cast("string").alias("news_id"), F.lit("").alias("title"), F.repeat(F.lit("some words of a text that name1234x none has "), F.lit(120)).alias("text"))
    took = {}
    for n in (20, 2000, 20, 2000):
        terms = {f"T{k}": [f"name{k}", f"firm {k} group"] for k in range(n)}
        start = time.time()
        assert news.tag_entities(rows, terms).count() == 0
        took[n] = min(took.get(n, 99), time.time() - start)
    assert took[2000] < 6 * took[20] + 2


def test_retagging_rewrites_all_items(spark):
    x = spark.createDataFrame([("1", "the end", "", ["OLD"]), ("2", "", "nothing", ["OLD"])], "news_id string, title string, text string, tickers array<string>")
    items, tags = news.retag_all(x, {"B": ["end"], "A": ["the"]})
    assert {r.news_id: r.tickers for r in items.collect()} == {"1": ["A", "B"], "2": []} and tags.count() == 2
    assert {r.ticker: r.n for r in news.ticker_counts(tags).collect()} == {"A": 1, "B": 1}


def test_nested_redaction(spark):
    kind = T.StructType.fromDDL("a struct<b: array<struct<c: map<string, string>, token: bigint, plain: string, n: int>>, d: map<string, struct<text: string, n: int>>>, Authorization: string, note: string, ids: array<string>")
    row = (([({"api-key": "x", "note": "Bearer abc.def", "k": "v", "none": None}, 7, "pza_abcdefgh1", 3), (None, None, None, None), None], {"my_password": ("p", 1), "other": ("sk-or-12345678", 2)}), None, "z" * 96, ["ok", "eyJ" + "a" * 20 + "." + "b" * 20 + "." + "c" * 20])
    r = text.redact_rows(spark.createDataFrame([row, (None, "x", "y", None)], kind)).collect()
    hidden = "[REDACTED]"
    one, two, three = r[0].a.b
    assert one.c == {"api-key": hidden, "note": hidden, "k": "v", "none": None} and (one.token, one.plain, one.n) == (hidden, hidden, 3)
    assert two.c is None and (two.token, two.plain, two.n) == (hidden, None, None) and three is None
    assert {k: tuple(v) for k, v in r[0].a.d.items()} == {"my_password": (hidden, None), "other": (hidden, 2)}
    assert (r[0].Authorization, r[0].note, r[0].ids) == (hidden, hidden, ["ok", hidden])
    assert (r[1].a, r[1].Authorization, r[1].note, r[1].ids) == (None, hidden, "y", None)


def test_forecasts_of_coming_days_and_hours(spark):
    """The predictor gets the bars in order and the times to come; too few bars give no row, and no score but 0.5."""
    days = [T0 + dt.timedelta(days=k) for k in range(4)]  # Monday to Thursday
    rows = [(T0, t, d, 10.0 * k + len(t)) for t in ("A", "BB") for k, d in enumerate(days, 1)] + [(T0, "C", days[0], 5.0)]
    known = spark.createDataFrame(rows, "as_of timestamp_ntz, ticker string, ts timestamp_ntz, close double").repartition(3)

    def predictor(context, stamps):
        assert list(context["ts"]) == sorted(context["ts"])
        return [[context["close"].iloc[-1] * 1.1, context["close"].iloc[0] + s.day] for s in stamps]

    got = backtest.forecast(known, predictor, lambda t: backtest.business_days(t, 4), least=2).orderBy("ticker", "step").collect()
    assert [(r.ticker, r.step, r.ts.day, r.bars) for r in got if r.ticker == "A"] == [("A", 1, 5, 4), ("A", 2, 8, 4), ("A", 3, 9, 4), ("A", 4, 10, 4)]
    assert {r.ticker for r in got} == {"A", "BB"} and got[0].samples == [pytest.approx(45.1), 16.0]
    hours = backtest.forecast(known, predictor, lambda t: backtest.coming_hours(t, 2), least=2).filter("ticker = 'A'").orderBy("step").collect()
    assert [r.ts for r in hours] == [days[3] + dt.timedelta(hours=k) for k in (1, 2)]
    scores = backtest.forecast_scores(backtest.forecast(known, predictor, lambda t: backtest.coming_hours(t, 1), least=2), known, known).collect()
    assert {r.ticker: r.score for r in scores} == {"A": 0.5, "BB": 1.0, "C": 0.5}
    for last, n in ((days[3], 1), (days[3] + dt.timedelta(days=2), 11), (days[0], 30)):
        x = spark.createDataFrame([(last,)], "t timestamp_ntz").select(backtest.business_days(F.col("t"), n).alias("d")).first().d
        want = [d for d in (last.replace(hour=0) + dt.timedelta(days=k) for k in range(1, 60)) if d.weekday() < 5][:n]
        assert x == want

"""Golden cases of the operators, and small oracles for folds, stories and streams."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import text
from tickloom.operators import backtest, candles, market, news, orders, portfolio, scores, selectors, stories
from tickloom.sources import tables
from tickloom.streaming import jobs

T = dt.datetime(2026, 5, 21, 12)


def test_rank_weights(spark):
    rows = [(T + dt.timedelta(minutes=i), s, o, r) for i in range(25) for s, o, r in (("family", 0, 0.001), ("aware", 1, 0.003), ("wide", 2, -0.001))]
    out = scores.rolling_rank_weights(spark.createDataFrame(rows, "ts timestamp_ntz, selector string, ord int, ret double"))
    last = {r.selector: r.weight for r in out.filter(F.col("ts") == F.lit(rows[-1][0])).collect()}
    assert last["aware"] == pytest.approx(36 / 49) and last["family"] == pytest.approx(9 / 49) and last["wide"] == pytest.approx(4 / 49)
    first = {r.selector: r["rank"] for r in out.filter(F.col("ts") == F.lit(T)).collect()}
    assert first == {"family": 1, "aware": 2, "wide": 3}


def test_long_and_short(spark):
    x = spark.createDataFrame([(T, "SBER", 0, 0.9, 0.8, True), (T, "LKOH", 1, 0.1, 0.2, True), (T, "GAZP", 2, 0.5, 0.5, True), (T, "ROSN", 3, 0.9, 0.9, False)], "as_of timestamp_ntz, ticker string, ord int, forecast double, news double, tradable boolean")
    p = spark.createDataFrame([("s", 1.0, 1.0, 0.65, 2.0, 1.0, True)], "selector string, forecast_weight double, news_weight double, threshold double, rank_power double, max_gross double, allow_short boolean")
    w = {r.ticker: r.weight for r in portfolio.target_weights(x, p).collect()}
    assert w["SBER"] > 0 > w["LKOH"] and set(w) == {"SBER", "LKOH"} and sum(map(abs, w.values())) <= 1 + 1e-9


def test_conflicts(spark):
    sw = spark.createDataFrame([(T, "a", 0.5), (T, "b", 0.25), (T, "c", 0.25)], "as_of timestamp_ntz, selector string, weight double")
    t = spark.createDataFrame([(T, "a", "SBER", 1.0), (T, "b", "SBER", -1.0), (T, "c", "LKOH", 1.0)], "as_of timestamp_ntz, selector string, ticker string, weight double")
    got = {r.ticker: r.cancelled for r in portfolio.conflict_metrics(sw, t).collect()}
    assert got == {"SBER": 0.5, "LKOH": 0.0}


def _plan(spark, rows):
    """rows: ticker, lots, target_weight, price, lot_size; equity and cash given."""
    x = spark.createDataFrame([(1, *r) for r in rows], "as_of long, ticker string, lots long, target_weight double, price double, lot_size long, equity double, cash double")
    c = orders.order_candidates(x).withColumn("quantity", F.col("requested"))
    return {r.ticker: r for r in orders.cash_cap(c).collect()}


def test_lots_not_shares(spark):
    got = _plan(spark, [("ALRS", 0, 0.5, 25.0, 10, 1e5, 1e5), ("SBER", 0, 0.1, 300.0, 1, 1e5, 1e5)])
    assert got["ALRS"].quantity == 200 and got["SBER"].quantity == 33


def test_cash_cap(spark):
    got = _plan(spark, [("ALRS", 0, 1.0, 25.0, 10, 1e6, 5e5)])["ALRS"]
    assert (got.requested, got.quantity, got.cash_after, got.capped) == (4000, 2000, 0.0, True)


def test_sells_do_not_fund_buys(spark):
    got = _plan(spark, [("ALRS", 0, 1.0, 10.0, 10, 2000.0, 1000.0), ("SBER", 10, 0.0, 100.0, 1, 2000.0, 1000.0)])
    assert got["SBER"].direction == "S" and got["SBER"].quantity == 10 and got["ALRS"].quantity == 10 and got["ALRS"].capped


def test_cash_fold_against_a_loop(spark):
    rng = random.Random(4)
    rows = [(f"T{i:02}", rng.randrange(20), rng.uniform(-0.3, 0.3), rng.uniform(5, 400), rng.choice([1, 10]), 1e5, 30000.0) for i in range(20)]
    got = {k: (r.quantity, r.direction) for k, r in _plan(spark, rows).items()}
    cand = []
    for t, lots, w, p, lot, eq, _ in rows:
        raw = eq * w / p
        target = int(abs(raw) // lot) * (1 if raw > 0 else -1)
        d = target - lots
        if d and abs(d) * lot * p >= 100:
            cand.append((d > 0, -abs(w), t, abs(d), lot * p))
    left, want = 30000.0, {}
    for buy, _, t, q, v in sorted(cand):
        if buy:
            q = min(q, int(left // v))
            left = max(left - q * v, 0)
        if q > 0 and q * v >= 100:
            want[t] = (q, "B" if buy else "S")
    assert got == want


def test_equity(spark):
    x = spark.createDataFrame([(1, 100, 10, 25.0, 5e4), (1, -10, 10, 300.0, 5e4)], "as_of long, lots long, lot_size long, price double, cash double")
    assert orders.equity(x, F.col("cash")).first().equity == 50000 + 25000 + 30000


def test_cost_floor(spark):
    q = spark.createDataFrame([("SBER", 300.0, None, 0.0, 0.0)], "ticker string, last_price double, prev_price double, bid double, ask double")
    r = market.cost_snapshot(q).first()
    assert r.missing_bbo and r.cost == 0.0015


def test_upsert_newest_wins(spark):
    schema = "ticker string, ts timestamp_ntz, close double, updated_at timestamp_ntz, seq int"
    a, b = spark.createDataFrame([("SBER", T, 100.0, T, 0)], schema), spark.createDataFrame([("SBER", T, 101.0, T, 1)], schema)
    assert [r.close for r in tables.upsert_replace(a, b, ["ticker", "ts"], "updated_at", "seq").collect()] == [101.0]


def test_context_uses_received_time(spark):
    n = spark.createDataFrame([("n1", T + dt.timedelta(minutes=5))], "news_id string, received_at timestamp_ntz")
    tags = spark.createDataFrame([("n1", "SBER", "direct", 1.0)], "news_id string, ticker string, relation string, strength double")
    none = spark.createDataFrame([], "news_id string, story_id string")
    d = spark.createDataFrame([(T + dt.timedelta(seconds=90),), (T + dt.timedelta(minutes=6),)], "as_of timestamp_ntz")
    got = news.context_dedupe(news.news_context(n, tags, none, d)).collect()
    assert [r.as_of for r in got] == [T + dt.timedelta(minutes=6)]


def test_cluster_strength_is_capped(spark):
    c = spark.createDataFrame([("a", "LKOH", "cluster", 0.9), ("b", "MARKET", "marketwide", 0.8), ("c", "XXX", "direct", 0.8)], "news_id string, ticker string, relation string, strength double")
    got = {r.news_id: (r.route, r.strength) for r in news.context_route(c, ["LKOH"]).collect()}
    assert got == {"a": ("ticker", 0.6), "b": ("market", 0.8)}


def test_redaction(spark):
    x = spark.createDataFrame([({"api_key": "pza_testSecretToken", "note": "uses Bearer verysecretvalue", "plain": "abc"},)], "m map<string,string>")
    assert x.select(text.redact_map(F.col("m"))).first()[0] == {"api_key": "[REDACTED]", "note": "[REDACTED]", "plain": "abc"}


def test_tokens_are_stemmed(spark):
    x = spark.createDataFrame([("Сбербанк объявил новыми ценами и ещё 25 акций",)], "t string")
    assert x.select(text.title_tokens(F.col("t"))).first()[0] == ["сбербанк", "объявил", "новым", "ценам", "акций"]


def test_past_only(spark):
    rows = [("A", T + dt.timedelta(minutes=30 * i), float(i), T + dt.timedelta(minutes=30 * i + 29)) for i in range(40)]
    schema = "ticker string, ts timestamp_ntz, close double, end_ts timestamp_ntz"
    d = spark.createDataFrame([(T + dt.timedelta(hours=8),)], "as_of timestamp_ntz")
    some = candles.bars_as_of(spark.createDataFrame(rows[:16], schema), d, 4).collect()
    every = candles.bars_as_of(spark.createDataFrame(rows, schema), d, 4).collect()
    assert sorted(map(str, some)) == sorted(map(str, every)) and len(some) == 4


def test_consensus_ties_to_the_smallest_sign(spark):
    x = spark.createDataFrame([([1.0, 3.0], 2.0)], "v array<double>, c double")
    r = x.select(backtest.sample_consensus(F.col("v"), F.col("c"), F.lit(1.0), 0.6).alias("r")).first().r
    assert (r.vote, r.confidence, r.confident, r.hit) == (-1, 0.5, False, True)


def test_candle_stream_equals_batch(spark, tmp_path):
    rows = [(i, "A", T + dt.timedelta(minutes=7 * i), float(i % 11), 1.0) for i in range(80)]
    df = spark.createDataFrame(rows, "event_id long, ticker string, ts timestamp_ntz, price double, volume double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    jobs.run_to_table(jobs.candle_stream(stream, 30), str(tmp_path / "out"))
    got = {r.ts: r.close for r in spark.read.parquet(str(tmp_path / "out/data")).collect()}
    want = {r.ts: r.close for r in candles.resample_candles(df, 30).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= len(want) - 4


def test_marks_are_frozen_during_a_run(spark, tmp_path):
    """Batches of a stream are judged by the marks at its start; an older newest item and one without a time move the id only."""
    import datetime as dt

    from pyspark.sql import functions as F

    t = [dt.datetime(2024, 1, 1, h) for h in range(12)]
    schema = "source string, external_id string, published_at timestamp_ntz, pos long"
    marks = spark.createDataFrame([("a", "m", t[5]), ("b", "n", t[6]), ("c", None, None)], "source string, mark_id string, mark_at timestamp_ntz")
    rows = [("a", "x", t[9], 1), ("a", "old", t[4], 2), ("a", "m", t[9], 3), ("a", "y", t[7], 4), ("b", "", None, 5), ("b", "q", None, 6), ("b", "r", None, 7), ("c", "", t[3], 8), ("a", "x", t[9], 9)]
    for k, part in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    items, after = jobs.ingest(stream, str(tmp_path / "out"), marks)
    found = {r.pos: r.status for r in items.collect()}
    assert found == {1: "saved", 2: "late", 3: "late", 4: "saved", 5: "saved", 6: "saved", 7: "saved", 8: "saved", 9: "duplicate"}
    got = {r.source: (r.mark_id, r.mark_at) for r in after.collect()}
    assert got == {"a": ("x", t[9]), "b": ("q", t[6]), "c": (None, t[3])}


def test_unique_ids_over_batches(spark, tmp_path):
    for k in range(3):
        spark.range(k * 4, k * 4 + 8).selectExpr("id % 10 AS key", f"{k} * 100 + id AS at").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("key long, at long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = [r.key for r in jobs.dedupe_stream(stream, str(tmp_path / "out"), ["key"], "at").collect()]
    assert sorted(got) == list(range(10))


def test_missing_columns_and_short_universes_are_errors(spark, tmp_path):
    from tickloom.sources import tables

    spark.range(2).write.parquet(str(tmp_path / "c"))
    with pytest.raises(ValueError, match="missing candle columns"):
        tables.read_candles(spark, str(tmp_path / "c"))
    caps = spark.createDataFrame([("A", 1.0)], "ticker string, cap double")
    with pytest.raises(ValueError, match="0 of 1"):
        selectors.select_universe(caps, spark.createDataFrame([("A", 1)], "ticker string, ts int"), 10, 1, 0.5)


def test_links_are_resolved(spark):
    from urllib.parse import urldefrag, urljoin

    from pyspark.sql import functions as F

    from tickloom.sources import feeds

    bases = ["http://h.example/a/b/c.html?x=1#f", "https://h.example", "http://h.example/a/"]
    hrefs = ["d", "/d", "../d", "../../../d", "./", "..", "?q=1", "//k.example/z", "mailto:a@b.c", "#top", "e/./f/../g", "https://o.example/p#q"]
    cases = [(b, h) for b in bases for h in hrefs]
    got = spark.createDataFrame(cases, "b string, h string").select("b", "h", feeds.absolute_url(F.col("b"), F.col("h")).alias("u")).collect()
    assert {(r.b, r.h): r.u for r in got} == {(b, h): urldefrag(urljoin(b, h))[0] for b, h in cases}


def test_extract_articles(spark):
    from tickloom.sources.feeds import extract_articles

    html = '<html><title>T</title><script>var x="<p>";</script><body><time datetime="2024-01-02">x</time><h1>Head</h1><article><p>a <b>b</b></p></article></body></html>'
    got = extract_articles(spark.createDataFrame([(1, html), (2, None), (3, "<title>only")], "page_id long, html string")).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(1, "Head", "2024-01-02", "a b"), (2, "", None, ""), (3, "only", None, "only")]


def test_newest_context(spark):
    """The newest rows without pairs of items and decisions are those of all pairs, deduped, routed and trimmed: many a decision, equal times, stories, several tags."""
    from tickloom.operators import requests

    rng, start = random.Random(5), dt.datetime(2024, 1, 1)
    items = [(f"n{i}", start + dt.timedelta(minutes=10 * rng.randrange(400))) for i in range(900)] + [("none", None)]
    tags = [(i, t, r, 0.9) for i, _ in items for t, r in (("AAA", "direct"), ("AAA", "marketwide"), ("BBB", "cluster"), ("ZZZ", "direct"), ("", "direct")) if rng.random() < 0.3]
    told = [(i, f"s{rng.randrange(200)}") for i, _ in items if rng.random() < 0.5]
    n = spark.createDataFrame(items, "news_id string, received_at timestamp_ntz")
    g = spark.createDataFrame(tags, "news_id string, ticker string, relation string, strength double")
    st = spark.createDataFrame(told, "news_id string, story_id string")
    d = spark.createDataFrame([(start + dt.timedelta(minutes=50 * k),) for k in range(90)], "as_of timestamp_ntz")
    pairs = news.context_route(news.context_dedupe(news.news_context(n, g, st, d)), ["AAA", "BBB"]).fillna("MARKET", ["ticker"])
    columns = ["as_of", "news_id", "ticker", "route", "received_at", "relation", "strength", "story_id"]
    want, got = (sorted(map(tuple, x.select(columns).collect()), key=str) for x in (requests.trim_context(pairs), requests.newest_context(n, g, st, d, ["AAA", "BBB"])))
    assert len(want) > 2000 and pairs.count() > 2 * len(want)
    assert got == want
    none = spark.createDataFrame([], "content_hash string")
    whole = requests.score_requests(requests.trim_context(pairs), d, none)
    newest = requests.score_requests(requests.payload_fields(requests.newest_context(n, g, st, d, ["AAA", "BBB"])), d, none)
    assert sorted(map(str, newest.collect())) == sorted(map(str, whole.collect()))


def _shuffled(spark, name, data):
    """MB that a query's shuffles write."""
    import __spark_entry__ as entry

    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def written():
        bus.waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, quantiles, None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    entry.queries()[name](spark, data).write.format("noop").mode("overwrite").save()
    return sum(v for k, v in written().items() if k not in before) / 1e6


@pytest.mark.parametrize("name", ["m7_score_requests", "w14_trim_context"])
def test_contexts_shuffle_no_whole_texts(spark, name):
    """Texts are cut before they are joined, and to the newest rows only: what is shuffled stays under the table's size."""
    import os

    data = "/root/testdata/sf0.01"
    assert _shuffled(spark, name, data) < os.path.getsize(f"{data}/documents.parquet") / 1e6


def test_references_without_a_semicolon(spark, tmp_path):
    """p19 leaves a cut reference as it is, like its SQL; the operator reads it, as browsers do, unless told not to."""
    import duckdb

    import __spark_entry__ as entry
    from tickloom.sources.feeds import extract_articles

    heads = ["a&amp", "b&am", "c& d", "e&amp;amp", "f&lt;g&gt;&quot;", "h&amplitude", "i&ampx;", "j&amp;lt;", "k&#38", "l&lt", "m&#", "n&amp&amp;", "o&&amp;&"]
    html = [f"<title>t</title><h1>{h}</h1><article><p>{h}</p> x <b>{h}</b></article>" for h in heads]
    pages = spark.createDataFrame([(i, "", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = duckdb.sql(f"SELECT page_id, title, text FROM ({entry.oracle_sql()['p19_extract_articles']})").fetchall()
    got = entry.queries()["p19_extract_articles"](spark, str(tmp_path)).select("page_id", "title", "text").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    read = extract_articles(pages).filter("page_id in (0, 8)").orderBy("page_id").collect()
    assert [r.title for r in read] == ["a&", "k&"]


def test_items_of_empty_documents(spark, tmp_path):
    """p9 has all its SQL's rows where documents are absent, empty or blank, or begin with such a line."""
    import duckdb

    import __spark_entry__ as entry

    texts = [None, "", " \n\t ", "\nbody", " \t \nbody", " a \u00a0 b \nbody", "title", "\u00a0\n"]
    rows = [(i, texts[i % len(texts)], "en", f"src{i % 3}", 0) for i in range(4 * len(texts))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duckdb.sql(f"SELECT news_id, title_chars, summary, external_id, url, confidence FROM ({entry.oracle_sql()['p9_normalize_items']})").fetchall()
    got = entry.queries()["p9_normalize_items"](spark, str(tmp_path)).select("news_id", "title_chars", "summary", "external_id", "url", "confidence").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r.title_chars for r in got} == {None, 0, 3, 5}


def test_all_lines_of_an_order_become_candidates(spark):
    """o1, w16, o3 and o4 against a loop over every line of lineitem, up to seven tickers an order."""
    import math

    import __spark_entry__ as entry

    data = "/root/testdata/sf0.001"
    cand = {}
    for r in spark.read.parquet(f"{data}/lineitem.parquet").collect():
        price = r.l_extendedprice / r.l_quantity / 10
        weight = (-1.0 if r.l_returnflag == "R" else 1.0) * r.l_quantity / 100
        if price > 0:
            raw = 100000.0 * weight / price
            target = int(math.copysign(math.floor(abs(raw) / 10), raw))
            held = r.l_partkey % 40 if r.l_linenumber == 1 else 0
            if target != held and abs(target - held) * 10 * price >= 100:
                cand.setdefault(r.l_orderkey, []).append((target > held, -abs(weight), str(r.l_linenumber), abs(target - held), 10 * price, abs(target) > abs(held) if target * held > 0 else target != 0))
    want = {n: [] for n in ("o1_order_candidates", "w16_order_priority", "o3_liquidity_cap", "o4_cash_cap")}
    for key, lines in cand.items():
        left = 60000.0
        for place, (buy, _, ticker, q, value, adds) in enumerate(sorted(lines), 1):
            want["o1_order_candidates"].append((key, ticker, q))
            want["w16_order_priority"].append((key, ticker, place))
            room = key % 40 if key % 3 == 0 else math.floor(20000 / value) if key % 2 == 0 and adds else q
            want["o3_liquidity_cap"].append((key, ticker, min(q, room)))
            if buy:
                q = min(q, int(left // value))
                left = max(left - q * value, 0)
            if q > 0 and q * value >= 100:
                want["o4_cash_cap"].append((key, ticker, q))
    assert {t for _, t, _ in want["w16_order_priority"]} == set("1234567")
    for name, last in (("o1_order_candidates", "requested"), ("w16_order_priority", "priority"), ("o3_liquidity_cap", "allowed"), ("o4_cash_cap", "quantity")):
        got = entry.queries()[name](spark, data).select("as_of", "ticker", last).collect()
        assert sorted(map(tuple, got)) == sorted(want[name])

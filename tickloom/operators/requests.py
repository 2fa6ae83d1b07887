"""What goes to a scorer and what comes back: contexts, cache keys, scores and relation tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized
from .news import context_dedupe, context_route
from .scores import clipped

PER_TICKER, MARKETWIDE, TITLE_CHARS, REASON_CHARS, TEXT_CHARS = 8, 20, 260, 260, 500
#: Score columns with their defaults, text columns with their default and longest length, relations and market tickers.
SCORE_DEFAULTS = {"bullish_score": 0.5, "confidence": 0.0, "relation_strength": 0.0, "already_priced_risk": 0.5}
NOTE_LENGTHS = {"direct_effect": ("none", 80), "marketwide_effect": ("none", 80), "reason": ("", 500)}
RELATIONS = ("direct", "cluster", "marketwide")
MARKET_TICKERS = ("MARKET", "MOEX_MARKET")


def _object(raw: Column) -> Column:
    """A JSON object as a map of name to JSON text; null if it is something else."""
    return F.when(F.ltrim(raw).startswith("{"), F.from_json(raw, "map<string, string>"))


def normalize_scores(raw: DataFrame, universe: DataFrame) -> DataFrame:
    """Scores of every ticker of the universe from rows (as_of, raw_json), an object of ticker to fields.

    What is absent, is no number or is no object takes the field's default, alone:
    an odd entry of one ticker leaves the others as they are.
    """
    parsed = raw.select("as_of", _object(F.col("raw_json")).alias("m"))
    tickers = universe.select("ticker").distinct()
    x = parsed.join(sized(tickers), how="cross").withColumn("f", _object(F.col("m")[F.col("ticker")]))
    numbers = [clipped(F.expr(f"try_cast(f['{c}'] as double)"), v).alias(c) for c, v in SCORE_DEFAULTS.items()]
    notes = [F.substring(F.coalesce(F.col("f")[c], F.lit(v)), 1, n).alias(c) for c, (v, n) in NOTE_LENGTHS.items()]
    return x.select("as_of", "ticker", *numbers, *notes)


def normalize_relation_tags(raw: DataFrame, known: DataFrame, tickers: list[str], order: str = "raw_json") -> DataFrame:
    """Valid tags (news_id, ticker, relation, confidence, strength, reason, tags) from rows (raw_json), each {"items": [{"news_id", "tags": [...]}]}.

    Of tags of one (news_id, ticker, relation) the first stays, in the order of
    `order` over rows, then of the items and tags in a row.

    Items and tags that are no objects are skipped. An absent strength is 0.6 for
    a cluster and 0.8 else; one that is no number is 0. Marketwide tags are the
    market's; a direct one may name the market too.
    """
    items = F.from_json(_object(F.col("raw_json"))["items"], "array<string>")
    x = raw.select(F.col(order).alias("o"), F.posexplode(items).alias("p", "i")).select("o", "p", _object(F.col("i")).alias("i"))
    x = x.select("o", "p", F.col("i")["news_id"].alias("news_id"), F.posexplode(F.from_json(F.col("i")["tags"], "array<string>")).alias("q", "t")).select("o", "p", "q", "news_id", _object(F.col("t")).alias("t"))
    field = lambda k: F.col("t")[k]
    relation = F.lower(field("relation_type"))
    x = x.withColumns({"relation": relation, "ticker": F.when(relation == "marketwide", "MARKET").otherwise(F.upper(field("ticker")))})
    x = x.filter(F.col("relation").isin(*RELATIONS) & F.col("ticker").isin(*tickers, *MARKET_TICKERS))
    confidence = F.lower(field("confidence"))
    default = F.when(F.col("relation") == "cluster", 0.6).otherwise(0.8)
    strength = F.when(F.map_contains_key("t", "relation_strength"), F.coalesce(clipped(F.expr("try_cast(t['relation_strength'] as double)"), 0.0), F.lit(0.0))).otherwise(default)
    first = F.row_number().over(Window.partitionBy("news_id", "ticker", "relation").orderBy("o", "p", "q"))
    x = x.join(known.select("news_id").distinct(), "news_id", "left_semi").withColumn("n", first).filter("n = 1")
    return x.select(
        "news_id", "ticker", "relation", F.when(confidence.isin("low", "medium", "high"), confidence).otherwise("medium").alias("confidence"), strength.alias("strength"),
        F.substring(F.coalesce(field("reason"), F.lit("")), 1, 500).alias("reason"), F.coalesce(field("tags"), F.lit("[]")).alias("tags"),
    )


#: Fields of an item of a scorer's payload, with what stands in for an absent one.
PAYLOAD = {"published_at": None, "received_at": None, "relation_type": None, "source": None, "source_count": 1, "title": "", "reason": "", "text": "", "tags": "[]"}
CUTS = {"title": TITLE_CHARS, "reason": REASON_CHARS, "text": TEXT_CHARS}


def cut_texts(rows: DataFrame) -> DataFrame:
    """rows with the long texts of CUTS cut, those there are; before a join, so that it moves no more of them than a payload holds."""
    return rows.withColumns({c: F.substring(c, 1, n) for c, n in CUTS.items() if c in rows.columns})


def payload_fields(kept: DataFrame) -> DataFrame:
    """kept with the fields of PAYLOAD, long texts cut.

    relation_type is the context's relation; a field that the context lacks, or a null one that has a default, takes the default.
    """
    if "relation_type" not in kept.columns and "relation" in kept.columns:
        kept = kept.withColumn("relation_type", F.col("relation"))
    fields = {}
    for name, default in PAYLOAD.items():
        own = F.col(name) if name in kept.columns else F.lit(default)
        own = own if default is None else F.coalesce(own, F.lit(default))
        fields[name] = F.substring(own, 1, CUTS[name]) if name in CUTS else own
    return kept.withColumns(fields)


def trim_context(context: DataFrame) -> DataFrame:
    """The newest rows of each (as_of, ticker, route), fewer for tickers than for the market, as payload_fields() has them."""
    w = Window.partitionBy("as_of", "ticker", "route").orderBy(F.col("received_at").desc(), F.col("news_id").desc())
    return payload_fields(context.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= F.when(F.col("route") == "market", MARKETWIDE).otherwise(PER_TICKER)).drop("rn"))


def newest_context(news: DataFrame, tags: DataFrame, stories: DataFrame, decisions: DataFrame, universe: list[str]) -> DataFrame:
    """The rows that trim_context() keeps of news_context(), context_dedupe() and context_route(), an absent ticker being MARKET, without the pairs of items and decisions that it drops.

    What comes first of a story, ticker and relation on a day comes first for every
    decision of that day that sees any of them, so rows are deduped by day. A row is
    among the newest for the decisions from its own time until that of the row so
    many places later, and meets only those.
    """
    seen = news.join(tags, "news_id", "left").join(stories, "news_id", "left").withColumn("day", F.to_date("received_at"))
    routed = context_route(context_dedupe(seen, "day"), universe).withColumn("ticker", F.coalesce("ticker", F.lit("MARKET")))
    w = Window.partitionBy("day", "ticker", "route").orderBy("received_at", "news_id")
    until = F.when(F.col("route") == "market", F.lead("received_at", MARKETWIDE).over(w)).otherwise(F.lead("received_at", PER_TICKER).over(w))
    d = decisions.select("as_of", F.to_date("as_of").alias("day"))
    x = routed.withColumn("until", until).join(d, "day")
    return x.filter((F.col("received_at") <= F.col("as_of")) & (F.col("until").isNull() | (F.col("as_of") < F.col("until")))).drop("day", "until")


def content_hashes(trimmed: DataFrame) -> DataFrame:
    """(as_of, content_hash) of the decisions that have items."""
    item = F.struct("ticker", "route", "received_at", "news_id", *[c for c in PAYLOAD if c != "received_at"])
    return trimmed.groupBy("as_of").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(item))), 256).alias("content_hash"))


def request_states(hashes: DataFrame, decisions: DataFrame, cache: DataFrame) -> DataFrame:
    """One row a decision: its hash, if any, and whether it needs no request ('neutral'), is in the cache ('hit') or not ('miss')."""
    x = decisions.select("as_of").distinct().join(hashes, "as_of", "left")
    x = x.join(cache.select("content_hash", F.lit(True).alias("cached")).distinct(), "content_hash", "left")
    return x.withColumn("state", F.when(F.col("content_hash").isNull(), "neutral").when(F.col("cached"), "hit").otherwise("miss")).drop("cached")


def score_requests(trimmed: DataFrame, decisions: DataFrame, cache: DataFrame) -> DataFrame:
    """request_states() of a trimmed context."""
    return request_states(content_hashes(trimmed), decisions, cache)

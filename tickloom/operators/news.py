"""News: normalising, tagging, stored facts and what a decision time may see."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text
from .common import sized

MARKET = ("", "MARKET", "MOEX_MARKET")


def normalize_items(news: DataFrame, sources: DataFrame) -> DataFrame:
    """Clean title, text, summary and external_id, of those there are; no empty texts, empty fields null; confidence at least the source's trust."""
    own = [c for c in ("title", "text", "summary", "external_id") if c in news.columns]
    x = news.withColumns({c: F.nullif(clean_text(F.col(c)), F.lit("")) for c in own}).filter("text is not null")
    return x.join(sized(sources), "source", "left").withColumn("confidence", F.greatest("confidence", "trust")).drop("trust")


def news_identity(news: DataFrame) -> DataFrame:
    """payload_hash of the item as key-sorted JSON, and news_id = source:(external id or hash).

    The JSON is that of raw, a map of texts, where an item has one, even if it is
    empty; else that of text, title and url.
    """
    pair = lambda k, v: F.concat(_quoted(k), F.lit(": "), _quoted(v))
    own = [pair(F.lit(k), F.col(k)) for k in ("text", "title", "url")]
    if "raw" in news.columns:
        raw = F.transform(F.array_sort(F.map_entries("raw")), lambda e: pair(e["key"], e["value"]))
        fields = F.when(F.col("raw").isNotNull(), raw).otherwise(F.array(*own))
    else:
        fields = F.array(*own)
    x = news.withColumn("payload_hash", F.sha2(F.concat(F.lit("{"), F.array_join(fields, ", "), F.lit("}")), 256))
    return x.withColumn("news_id", F.concat_ws(":", "source", F.coalesce(F.nullif(F.col("external_id"), F.lit("")), F.col("payload_hash"))))


def _quoted(text: Column) -> Column:
    """A text as JSON: quotes, backslashes and control characters escaped, all else as it is."""
    short = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r", "\b": "\\b", "\f": "\\f"}
    escaped = text
    for c, by in (short | {chr(i): f"\\u{i:04x}" for i in range(32) if chr(i) not in short}).items():
        escaped = F.replace(escaped, F.lit(c), F.lit(by))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))


#: Characters that a term must not stand next to, and the ticker that stands for all.
WORD_CHARS = "0-9A-Za-zА-Яа-яЁё"
EVERY = "ALL"


def _plain(term: str) -> str:
    """A term as matches are looked up: case-blind, one blank for white space, е for ё."""
    return re.sub(r"\s+", " ", term).upper().lower().replace("ё", "е")


def _one_pattern(terms: list[str]) -> str:
    """All terms as one pattern that shares common beginnings, so that its cost at a place grows with a term's length, not with their number; the longest fits first."""
    root: dict = {}
    for term in sorted(terms):
        node = root
        for c in re.sub(r"\s+", " ", term):
            node = node.setdefault(r"\s+" if c == " " else "[её]" if c in "еёЕЁ" else re.escape(c.lower()), {})
        node[""] = {}

    def written(node: dict) -> str:
        ways = [k + written(v) for k, v in node.items() if k]
        body = "|".join(ways)
        return f"(?:{body})?" if "" in node and ways else f"(?:{body})" if len(ways) > 1 else body

    return written(root)


def _looked_up(terms: dict[str, list[str]]) -> dict[str, list[tuple[str, str]]]:
    """What a match stands for: (ticker, term) of the terms that read as it does, or as its beginning up to an edge of a word."""
    pairs = [(_plain(w), t, w) for t, words in terms.items() for w in words]
    edge = re.compile(f"[{WORD_CHARS}]")
    found: dict[str, list[tuple[str, str]]] = {}
    for long in {p for p, _, _ in pairs}:
        found[long] = [(t, w) for p, t, w in pairs if long == p or (long.startswith(p) and not edge.match(long[len(p)]))]
    return found


def tag_entities(news: DataFrame, terms: dict[str, list[str]], sources: DataFrame | None = None) -> DataFrame:
    """(news_id, ticker, matched_by, terms): the terms of a ticker that title or text have as whole words, case-blind, in one scan; sorted.

    With sources (source, tickers array) an item also gets its source's own tickers
    that terms has, but for EVERY, with the term source:<source>; matched_by names
    what found a ticker, `regex`, `source` or both. The scan looks ahead from every
    place, so that a match hides no other that begins within it.
    """
    both = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    session, words = news.sparkSession, {t: [w for w in ws if w.strip()] for t, ws in terms.items()}
    means = session.createDataFrame([(k, t, w) for k, v in _looked_up(words).items() for t, w in v], "match string, ticker string, term string")
    pattern = f"(?iuU)(?<![{WORD_CHARS}])(?=({_one_pattern([w for ws in words.values() for w in ws]) or '(?!)'})(?![{WORD_CHARS}]))"
    plain = F.transform(F.regexp_extract_all(both, F.lit(pattern), F.lit(1)), lambda m: F.regexp_replace(F.regexp_replace(F.lower(F.upper(m)), "ё", "е"), r"(?U)\s+", " "))
    matches = news.select("news_id", F.explode(F.array_distinct(plain)).alias("match")).join(sized(means), "match")
    found = matches.select("news_id", "ticker", F.lit("regex").alias("by"), "term")
    if sources is not None:
        known = session.createDataFrame([(t,) for t in terms if t != EVERY], "ticker string")
        own = sources.select("source", F.explode("tickers").alias("ticker")).distinct().join(sized(known), "ticker", "left_semi")
        found = found.unionByName(news.select("news_id", "source").join(sized(own), "source").select("news_id", "ticker", F.lit("source").alias("by"), F.concat(F.lit("source:"), "source").alias("term")))
    return found.groupBy("news_id", "ticker").agg(F.array_join(F.array_sort(F.collect_set("by")), ",").alias("matched_by"), F.array_sort(F.collect_set("term")).alias("terms"))


def with_tickers(news: DataFrame, tags: DataFrame) -> DataFrame:
    """news with tickers: the sorted tickers of its tags, empty without any."""
    per = tags.groupBy("news_id").agg(F.array_sort(F.collect_set("ticker")).alias("tickers"))
    return news.drop("tickers").join(per, "news_id", "left").withColumn("tickers", F.coalesce("tickers", F.array().cast("array<string>")))


def retag_all(news: DataFrame, terms: dict[str, list[str]], sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """News with tickers written anew, and all their tags."""
    tags = tag_entities(news, terms, sources)
    return with_tickers(news, tags), tags


def merge_tags(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two taggings (news_id, ticker, matched_by, terms): merged, sorted labels and terms."""
    x = a.unionByName(b)
    by = F.array_join(F.array_sort(F.collect_set("matched_by")), ",")
    return x.groupBy("news_id", "ticker").agg(by.alias("matched_by"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))


def ticker_stats(news: DataFrame, tags: DataFrame) -> DataFrame:
    """One row: items, tagged, untagged, items with several tickers."""
    per = tags.groupBy("news_id").agg(F.countDistinct("ticker").alias("n"))
    x = news.select("news_id").join(per, "news_id", "left")
    return x.agg(F.count("*").alias("total"), F.count("n").alias("tagged"), F.sum(F.col("n").isNull().cast("long")).alias("untagged"), F.sum(F.coalesce((F.col("n") > 1).cast("long"), F.lit(0))).alias("multi"))


def ticker_counts(tags: DataFrame) -> DataFrame:
    """(ticker, n): items tagged with each ticker."""
    return tags.groupBy("ticker").agg(F.countDistinct("news_id").alias("n"))


def news_context(news: DataFrame, tags: DataFrame, stories: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items received on the day of as_of and not after it, with their tags and story; an equi-join on the day."""
    n = news.withColumn("day", F.to_date("received_at"))
    d = decisions.select("as_of", F.to_date("as_of").alias("day"))
    seen = n.join(d, "day").filter("received_at <= as_of")
    return seen.join(tags, "news_id", "left").join(stories, "news_id", "left").drop("day")


def context_dedupe(context: DataFrame, by: str = "as_of") -> DataFrame:
    """First row for each as_of, story or item, ticker and relation, by time and id."""
    key = [F.coalesce("story_id", "news_id"), F.coalesce("ticker", F.lit("")), F.coalesce("relation", F.lit("direct"))]
    w = Window.partitionBy(by, *key).orderBy("received_at", "news_id")
    return context.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def context_route(context: DataFrame, universe: list[str]) -> DataFrame:
    """Rows with route 'ticker' or 'market' and capped cluster strength; others go."""
    ticker, relation = F.coalesce("ticker", F.lit("")), F.coalesce("relation", F.lit("direct"))
    own = relation.isin("direct", "cluster") & ticker.isin(*universe)
    market = (relation == "marketwide") | ticker.isin(*MARKET)
    strength = F.when(relation == "cluster", F.least(F.coalesce("strength", F.lit(0.5)), F.lit(0.6))).otherwise(F.col("strength"))
    return context.withColumns({"route": F.when(own, "ticker").when(market, "market"), "strength": strength}).filter("route is not null")


def untagged(news: DataFrame, tags: DataFrame, as_of: str, limit: int) -> DataFrame:
    """Oldest items of as_of's day, received by then, without a tag: at most 3 * limit read, then one a story, then the limit."""
    at = F.lit(as_of).cast("timestamp_ntz")
    seen = news.filter((F.col("received_at") <= at) & (F.col("received_at") >= F.date_trunc("day", at).cast("timestamp_ntz")))
    read = seen.join(tags.select("news_id"), "news_id", "left_anti").orderBy("received_at", "news_id").limit(3 * limit)
    w = Window.partitionBy(F.coalesce("story_id", "news_id")).orderBy("received_at", "news_id")
    return read.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn").orderBy("received_at", "news_id").limit(limit)


def seed_direct_tags(found: DataFrame, tags: DataFrame) -> DataFrame:
    new = found.select("news_id", "ticker").distinct().withColumn("relation", F.lit("direct")).join(tags.select("news_id", "ticker", "relation"), ["news_id", "ticker", "relation"], "left_anti")
    return new.withColumns({"confidence": F.lit("medium"), "strength": F.lit(0.65)})

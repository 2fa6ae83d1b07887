"""Reports of one event: blocking joins, pair scores, and greedy stories within connected components."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stable
from ..functions.text import enough_signal, title_numbers, title_tokens

WINDOW_SECONDS, THRESHOLD, RARE_DF, SAME = 3600, 70.0, 8, 100.0


def story_records(news: DataFrame) -> DataFrame:
    """news_id, source, ts, url, payload_hash, tokens (distinct), numbers, title_key, signal."""
    x = news.withColumn("words", title_tokens(F.col("title"))).withColumn("numbers", title_numbers(F.col("title")))
    return x.select(
        "news_id", "source", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), "url", "payload_hash", F.array_distinct("words").alias("tokens"),
        "numbers", F.array_join("words", " ").alias("title_key"), enough_signal(F.col("words"), F.col("numbers")).alias("signal"),
    )


def token_rarity(records: DataFrame) -> DataFrame:
    return records.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def _hour(t: Column) -> Column:
    return F.floor(t / WINDOW_SECONDS)


def _title() -> Column:
    """Names what a score reads of a title: tokens in order and numbers; null if a title can't score."""
    usable = (F.size("tokens") > 0) & F.col("signal")
    return F.when(usable, F.md5(F.concat_ws("|", "title_key", F.array_join(F.array_sort("numbers"), " ")).cast("binary")))


def named_records(records: DataFrame) -> DataFrame:
    """records with title, the name of their title's content."""
    return records.withColumn("title", _title())


def titles(named: DataFrame) -> DataFrame:
    """One row a title, however many items have it: title, tokens, numbers, title_key, n."""
    return named.filter("title is not null").groupBy("title").agg(F.first("tokens").alias("tokens"), F.first("numbers").alias("numbers"), F.first("title_key").alias("title_key"), F.count("*").alias("n"))


def candidate_pairs(named: DataFrame, rarity: DataFrame) -> DataFrame:
    """(a, b) of titles, a <= b, with their tokens, numbers and keys, that occur within the window of each other and may score enough.

    A passing pair shares two rare tokens, or three tokens with Jaccard of 0.32 at
    least, or the title's words. The first two are covered by each token's place in
    the order of rising frequency: all rare tokens, and a prefix of
    n - ceil(0.32 n) + 1. Titles that many items share are one row an hour here, so
    no pairs of items are made; a title of two items or more pairs with itself.
    """
    own = titles(named)
    seen = named.filter("title is not null").select("title", _hour(F.col("t")).alias("hour")).distinct()
    ranked = own.select("title", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(rarity, "token")
    place = F.row_number().over(Window.partitionBy("title").orderBy("df", "token"))
    tokens = ranked.withColumn("place", place).filter((F.col("df") > 1) & ((F.col("df") <= RARE_DF) | (F.col("place") <= F.col("n") - F.ceil(F.col("n") * 0.32) + 1)))
    keys = tokens.select(F.concat(F.lit("token="), "token").alias("key"), "title").union(own.select(F.concat(F.lit("words="), "title_key"), "title"))
    near = keys.join(seen, "title").withColumn("bucket", F.explode(F.array(F.col("hour"), F.col("hour") + 1)))
    left = near.select("key", "bucket", F.col("title").alias("a"), F.col("hour").alias("hour_a"))
    right = near.select("key", "bucket", F.col("title").alias("b"), F.col("hour").alias("hour_b"))
    pairs = left.join(right, ["key", "bucket"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("hour_a") - F.col("hour_b")) <= 1)).select("a", "b").distinct()
    pairs = pairs.union(own.filter("n > 1").select(F.col("title"), F.col("title")))
    side = lambda p: own.select(F.col("title").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("tokens", "numbers", "title_key")])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def pair_scores(pairs: DataFrame, rarity: DataFrame) -> DataFrame:
    """(a, b, score) of candidate pairs with 70 points at least; rarity comes by joins on the common tokens."""
    x = pairs.withColumn("common", F.array_intersect("a_tokens", "b_tokens"))
    rare = x.select("a", "b", F.explode("common").alias("token")).join(rarity.filter(F.col("df") <= RARE_DF), "token").groupBy("a", "b").agg(F.count("*").alias("rare"))
    x = x.join(rare, ["a", "b"], "left")
    n, both = F.size("common"), F.size(F.array_intersect("a_numbers", "b_numbers"))
    jaccard, overlap = n / F.size(F.array_union("a_tokens", "b_tokens")), n / F.least(F.size("a_tokens"), F.size("b_tokens"))
    numbers = (F.size("a_numbers") > 0) & (F.size("b_numbers") > 0)
    points = lambda c, p: F.when(c, F.lit(float(p))).otherwise(F.lit(0.0))
    score = (
        points(F.col("a_title_key") == F.col("b_title_key"), 100) + points(n >= 3, 25) + points(F.coalesce("rare", F.lit(0)) >= 2, 25)
        + F.when(jaccard >= 0.45, 30.0).when(jaccard >= 0.32, 18.0).otherwise(0.0) + F.when(overlap >= 0.65, 20.0).when(overlap >= 0.5, 10.0).otherwise(0.0)
        + points(numbers & (both > 0), 10) - points(numbers & (both == 0) & (n < 4), 20)
    )
    return x.withColumn("score", score).filter(F.col("score") >= THRESHOLD).select("a", "b", "score")


def title_links(records: DataFrame) -> DataFrame:
    """(a, b, score): titles whose items can be of one story, by their words alone; equal urls and payloads need no list."""
    named = named_records(records)
    rarity = stable(token_rarity(records))
    return pair_scores(candidate_pairs(named, rarity), rarity)


def _same(c: str) -> Column:
    return F.coalesce((F.col(f"a_{c}") != "") & (F.col(f"a_{c}") == F.col(f"b_{c}")), F.lit(False))


def item_pairs(records: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, score) of all pairs of items that score enough, a before b in the order of ids. A report: equal titles give as many rows as pairs."""
    x = named_records(records).select("news_id", "source", "t", "title", "url", "payload_hash")
    every = links.unionByName(links.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    near = F.explode(F.array(*[_hour(F.col("t")) + k for k in (-1, 0, 1)]))
    side = lambda p, bucket: x.select(*[F.col(c).alias(f"{p}_{c}") for c in x.columns], bucket.alias("bucket"))
    left, right = side("a", _hour(F.col("t"))), side("b", near)
    found = left.join(every, F.col("a_title") == F.col("a")).join(right, (F.col("b") == F.col("b_title")) & (left["bucket"] == right["bucket"])).select(*[f"{p}_{c}" for p in "ab" for c in x.columns], "score")
    for c in ("url", "payload_hash"):
        same = left.join(right, (left["bucket"] == right["bucket"]) & (F.col(f"a_{c}") == F.col(f"b_{c}")) & (F.col(f"a_{c}") != ""))
        found = found.union(same.select(*[f"{p}_{k}" for p in "ab" for k in x.columns], F.lit(SAME).alias("score")))
    found = found.filter((F.col("a_news_id") < F.col("b_news_id")) & (F.col("a_source") != F.col("b_source")) & (F.abs(F.col("a_t") - F.col("b_t")) <= WINDOW_SECONDS))
    score = F.when(_same("url") | _same("payload_hash"), F.lit(SAME)).otherwise(F.col("score"))
    return found.select(F.col("a_news_id").alias("a"), F.col("b_news_id").alias("b"), score.alias("score")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of links (a, b): root is one node of each component, the same in every run.

    In each round every node moves to its neighbour, or itself, of the least hash,
    which differs by round, and one such step further; the links between what is
    left go on, so tables shrink by a share however chains are named.
    """
    sides = lambda x: x.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links, steps = stable(sides(links)), []
    while not links.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        both = links.union(links.select("b", "a"))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("low")).select("node", F.least("low", rank("node"))["to"].alias("to"))
        step = stable(step)
        step = stable(step.join(step.select(F.col("node").alias("to"), F.col("to").alias("further")), "to").select("node", F.col("further").alias("to")))
        steps.append(step)
        for c in ("a", "b"):
            links = links.join(step.select(F.col("node").alias(c), "to"), c).drop(c).withColumnRenamed("to", c)
        links = stable(sides(links))
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[-1]
    for step in reversed(steps[:-1]):
        later = out.select(F.col("node").alias("to"), F.col("to").alias("further"))
        out = step.join(later, "to", "left").select("node", F.coalesce("further", "to").alias("to"))
    return out.select("node", F.col("to").alias("root"))


class _Window:
    """Items of the last window of one component, by title, url and payload, and the stories that they are in."""

    def __init__(self) -> None:
        self.recent: deque = deque()
        self.held: dict[str, int] = {}
        self.sources: dict[str, set] = {}
        self.start: dict[str, float] = {}
        # kind and name -> story -> (url, payload) -> the places of its items, in order
        self.by: dict[tuple[str, str], dict[str, dict[tuple, deque]]] = {}
        self.count = 0

    def leave(self, before: float) -> None:
        while self.recent and self.recent[0][0] < before:
            _, story, names, content = self.recent.popleft()
            for name in names:
                places = self.by[name][story][content]
                places.popleft()
                if not places:
                    del self.by[name][story][content]
                    if not self.by[name][story]:
                        del self.by[name][story]
                        if not self.by[name]:
                            del self.by[name]
            self.held[story] -= 1
            if not self.held[story]:
                del self.held[story], self.sources[story], self.start[story]

    def best(self, source: str, content: tuple, names: list[tuple[str, str]], links: list[tuple[str, float]]) -> str | None:
        """The story to join: of the best score, then the earliest start, then the earliest item; none if all have the source."""
        url, payload = content
        best = None
        ways = [(name, SAME, False) for name in names if name[0] != "title"] + [(("title", o), score, True) for o, score in links]
        for name, score, by_words in ways:
            if best and -score > best[0]:
                continue
            for story, contents in self.by.get(name, {}).items():
                if source in self.sources[story]:
                    continue
                # of items that share the url or payload the score is SAME, whatever the words say
                places = [p[0] for c, p in contents.items() if not (by_words and ((url and c[0] == url) or (payload and c[1] == payload)))]
                if places:
                    rank = (-score, self.start[story], min(places), story)
                    best = min(best, rank) if best else rank
        return best and best[3]

    def join(self, story: str, t: float, source: str, content: tuple, names: list[tuple[str, str]]) -> None:
        for name in names:
            self.by.setdefault(name, {}).setdefault(story, {}).setdefault(content, deque()).append(self.count)
        self.count += 1
        self.recent.append((t, story, names, content))
        self.held[story] = self.held.get(story, 0) + 1
        self.sources.setdefault(story, set()).add(source)
        self.start.setdefault(story, t)


def _greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In order of root, time and id, an item joins the best earlier story that lacks its source; only a window's items and their stories are held."""
    root, window = None, _Window()
    for batch in batches:
        out = []
        for r in batch.itertuples():
            if r.root != root:
                root, window = r.root, _Window()
            window.leave(r.t - WINDOW_SECONDS)
            content = (r.url or None, r.payload_hash or None)
            names = [(k, v) for k, v in (("title", r.title), ("url", content[0]), ("payload", content[1])) if v]
            links = list(zip(r.others, r.scores, strict=True)) if r.others is not None else []
            story = window.best(r.source, content, names, links) or r.news_id
            window.join(story, r.t, r.source, content, names)
            out.append(story)
        yield pd.DataFrame({"news_id": batch["news_id"].to_numpy(), "story_id": pd.Series(out, dtype=object)})


def _episodes(named: DataFrame) -> DataFrame:
    """(name, hour, node, items): what items share (a title, url or payload) in hours that follow each other, as one node; an hour without it ends a node."""
    shared = F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{c}="), c)) for c in ("title", "url", "payload_hash")])
    hours = named.select(F.explode(F.array_compact(shared)).alias("name"), _hour(F.col("t")).alias("hour")).groupBy("name", "hour").agg(F.count("*").alias("items"))
    w = Window.partitionBy("name").orderBy("hour")
    new = F.when(F.coalesce(F.col("hour") - F.lag("hour").over(w) > 1, F.lit(True)), F.col("hour"))
    first = F.last(new, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = hours.withColumn("start", first)
    return x.select("name", "hour", F.concat_ws("@", "name", "start").alias("node"), F.sum("items").over(Window.partitionBy("name", "start")).alias("items"))


def assign_stories(records: DataFrame, links: DataFrame) -> DataFrame:
    """(news_id, story_id) of items in stories of two or more; a story's id is its first item's.

    links are title_links() of the records. A decision reads only items that share
    a title, url or payload with it, or have a linked title, within the window, so
    connected components of these are replayed in parallel. Components are found
    among titles, urls and payloads in hours that follow each other, never among
    pairs of items. A component may chain over any time: its rows stream in order
    of time through one task, which holds a window of them.
    """
    named = stable(named_records(records).select("news_id", "source", "t", "title", "url", "payload_hash"))
    episodes = stable(_episodes(named))
    own = F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{c}="), c)) for c in ("title", "url", "payload_hash")])
    places = named.select("news_id", _hour(F.col("t")).alias("hour"), F.explode(F.array_compact(own)).alias("name")).join(episodes, ["name", "hour"])
    each = places.groupBy("news_id").agg(F.array_sort(F.collect_set("node")).alias("nodes"), F.max("items").alias("most"))
    titled = lambda c: F.concat(F.lit("title="), c)
    of = lambda p: episodes.select(F.col("name").alias(f"{p}_name"), F.col("hour").alias(f"{p}_hour"), F.col("node").alias(p))
    apart = links.filter("a <> b").select(titled("a").alias("p_name"), titled("b").alias("q_name"))
    linked = apart.join(of("p"), "p_name").withColumn("q_hour", F.explode(F.array(*[F.col("p_hour") + k for k in (-1, 0, 1)]))).join(of("q"), ["q_name", "q_hour"]).select(F.col("p").alias("a"), F.col("q").alias("b")).distinct()
    linked, each = stable(linked), stable(each)
    within = each.filter(F.size("nodes") > 1).select(F.col("nodes")[0].alias("a"), F.explode(F.slice("nodes", 2, 2)).alias("b")).distinct()
    shared = linked.select(F.col("a").alias("node")).union(linked.select("b")).distinct()
    roots = stable(components(linked.union(within)))
    # items alone in all that they have, without links, are in no story
    alive = each.withColumn("node", F.explode("nodes")).join(shared.withColumn("linked", F.lit(True)), "node", "left").groupBy("news_id").agg(F.first("nodes").alias("nodes"), (F.max("most") > 1).alias("many"), F.max(F.coalesce("linked", F.lit(False))).alias("linked"))
    alive = alive.filter("many or linked").select("news_id", F.col("nodes")[0].alias("node")).join(roots, "node", "left").select("news_id", F.coalesce("root", "node").alias("root"))
    both = links.select(F.col("a").alias("title"), F.col("b").alias("o"), "score").union(links.filter("a <> b").select("b", "a", "score"))
    near = both.groupBy("title").agg(F.sort_array(F.collect_list(F.struct("o", "score"))).alias("l")).select("title", F.col("l.o").alias("others"), F.col("l.score").alias("scores"))
    items = named.join(alive, "news_id").join(near.hint("rebalance"), "title", "left")
    out = items.repartition("root").sortWithinPartitions("root", "t", "news_id").mapInPandas(_greedy, "news_id string, story_id string")
    return out.withColumn("n", F.count("*").over(Window.partitionBy("story_id"))).filter("n > 1").drop("n")


def story_aggregate(items: DataFrame) -> DataFrame:
    """Of (story_id, news_id, ts, title, source): first title, times, counts and sorted sources."""
    at = F.struct("ts", "news_id")
    return items.groupBy("story_id").agg(
        F.min_by(F.nullif(F.col("title"), F.lit("")), F.when(F.coalesce(F.col("title"), F.lit("")) != "", at)).alias("title"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"),
        F.count("*").alias("items"), F.countDistinct("source").alias("n_sources"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
    )

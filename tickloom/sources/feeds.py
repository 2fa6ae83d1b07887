"""Feed items, article pages and their times."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html.entities import html5
from html.parser import HTMLParser
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, is_news_url

ITEM = "guid string, id string, link string, title string, description string, pubDate string"
SHORT_TEXT = 900


def parse_msk(value: Column) -> Column:
    """Wall time in Moscow of a text: naive ones are Moscow's own, those with an offset are converted; else null."""
    zoned = value.rlike(r"([+-]\d\d:?\d\d|Z)$")
    aware = F.coalesce(F.try_to_timestamp(value, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(F.regexp_replace(value, "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss XX")))
    moscow = F.convert_timezone(F.current_timezone(), F.lit("Europe/Moscow"), aware.cast("timestamp_ntz"))
    naive = F.coalesce(F.try_to_timestamp(value, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(value, F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return F.when(zoned, moscow).otherwise(naive.cast("timestamp_ntz"))


def format_msk(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def feed_items(feeds: DataFrame, max_items: int) -> DataFrame:
    """The first items of each source from rows (source, pos, item), item being one XML entry; entries without an id go."""
    x = feeds.withColumn("x", F.from_xml("item", ITEM))
    key = F.coalesce(*[F.nullif(F.trim(f"x.{c}"), F.lit("")) for c in ("guid", "id", "link")])
    x = x.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("pos"))).filter(F.col("rn") <= max_items)
    body = F.array_join(F.filter(F.array(F.trim("x.title"), F.trim("x.description")), lambda t: t != ""), "\n\n")
    return x.select("source", "pos", key.alias("external_id"), F.trim("x.title").alias("title"), body.alias("text"), parse_msk(F.col("x.pubDate")).alias("published_at")).filter("external_id is not null")


def resolve_publish_time(article: Column, hhmm: Column, now: Column) -> Column:
    """The article's time unless it is a date only; else HH:MM of today, of yesterday if that is over ten minutes ahead."""
    today = F.try_to_timestamp(F.concat(F.date_format(now, "yyyy-MM-dd "), hhmm), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")
    listed = F.when(today > now + F.expr("interval 10 minutes"), today - F.expr("interval 1 day")).otherwise(today)
    dated = article.isNotNull() & (F.date_format(article, "HH:mm:ss") != "00:00:00")
    return F.when(dated, article).otherwise(F.coalesce(listed, article))


def enrich_full_text(items: DataFrame, pages: DataFrame) -> DataFrame:
    """items (url, title, text) whose stripped text is short or cut take the page's (url, body), if that, cleaned, is longer than the text: title, blank line, page."""
    x = items.join(pages, "url", "left")
    stripped = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    wanted = (F.char_length(stripped) < SHORT_TEXT) | stripped.endswith("...") | stripped.endswith("…")
    body = clean_text(F.col("body"))
    full = clean_text(F.array_join(F.filter(F.array(F.coalesce("title", F.lit("")), body), lambda t: t != ""), "\n\n"))
    take = F.coalesce(wanted & (F.coalesce("url", F.lit("")) != "") & (F.char_length(body) > F.char_length("text")), F.lit(False))
    return x.withColumn("enriched", take).withColumn("text", F.when(F.col("enriched"), full).otherwise(F.col("text"))).drop("body")


def _without_dots(path: Column) -> Column:
    """A path without its . and .. parts."""
    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    parts = F.split(path, "/")
    end = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.aggregate(parts, F.array().cast("array<string>"), step), end), "/")


def absolute_url(base: Column, href: Column) -> Column:
    """href as seen from the page at base, without its fragment."""
    href, page = F.regexp_replace(href, "#.*$", ""), F.regexp_replace(base, "#.*$", "")
    scheme, root = F.regexp_extract(page, "^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.regexp_extract(page, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0)
    path = F.regexp_extract(page, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    own, query = F.regexp_extract(href, "^[^?]*", 0), F.regexp_extract(href, "[?].*$", 0)
    folder = F.coalesce(F.nullif(F.regexp_replace(path, "[^/]*$", ""), F.lit("")), F.lit("/"))
    joined = F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href)).when(href == "", page)
        .when(own == "", F.concat(root, path, query)).otherwise(F.concat(root, _without_dots(joined), query))
    )


def discover_links(pages: DataFrame, max_items: int, known: DataFrame | None = None, allow: list[str] = (), block: list[str] = ()) -> DataFrame:
    """(page_id, link, n): the first max_items links of each page (page_id, url, html) to pages of its own host.

    A link must hold one of the allowed parts and none of the blocked ones,
    case-blind; with none given it must look like news. Known ones (page_id,
    link) are taken out after the count, so a page may give fewer.
    """
    found = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit("""<a\\s[^>]*href=["']([^"']*)"""), F.lit(1))).alias("pos", "href"))
    x = found.filter("href <> ''").select("page_id", "pos", F.regexp_replace("url", "#.*$", "").alias("url"), absolute_url(F.col("url"), F.col("href")).alias("link"))
    holds = lambda parts: reduce(or_, [F.contains(F.lower("link"), F.lit(p.lower())) for p in parts], F.lit(False))
    wanted = holds(allow) if allow else is_news_url(F.col("link"))
    host = lambda c: F.regexp_extract(c, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)
    x = x.filter((host("link") == host("url")) & (F.col("link") != F.col("url")) & ~holds(block) & wanted)
    first = x.groupBy("page_id", "link").agg(F.min("pos").alias("pos"))
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).filter(F.col("n") <= max_items).select("page_id", "link", "n")
    return first if known is None else first.join(known.select("page_id", "link"), ["page_id", "link"], "left_anti")


def known_id_filter(items: DataFrame, stored: DataFrame) -> DataFrame:
    """items (source, external_id, ...) that aren't stored (source, news_id) under the id source:external_id."""
    prefix = F.concat("source", F.lit(":"))
    known = stored.filter(F.startswith("news_id", prefix)).select("source", F.expr("substring(news_id, char_length(source) + 2)").alias("external_id")).distinct()
    return items.join(known, ["source", "external_id"], "left_anti")


class _Article(HTMLParser):
    """Texts of the first h1, of title, article and main, and the first time."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[str] = []
        self.parts: dict[str, list[str]] = {k: [] for k in ("h1", "title", "article", "main")}
        self.done: set[str] = set()
        self.at: str | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in self.parts or tag in ("script", "style"):
            self.open.append(tag)
        if self.at is None and (tag == "time" or (tag == "meta" and a.get("property") == "article:published_time")):
            self.at = a.get("datetime") or a.get("content")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]
            self.done.add(tag)

    def handle_data(self, data: str) -> None:
        if "script" in self.open or "style" in self.open:
            return
        for k in set(self.open) & set(self.parts):
            if k in ("article", "main") or k not in self.done:
                self.parts[k].append(data)

    def text(self, *kinds: str) -> str:
        return next((t for t in (" ".join(" ".join(self.parts[k]).split()) for k in kinds) if t), "")


_REFERENCE = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9A-Fa-f]+);|([A-Za-z][A-Za-z0-9]*;)?)")


def _ended_only(html: str) -> str:
    """html in which a & that begins no whole reference, one that ends in a semicolon, stands for itself."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] in html5 or m[0].startswith("&#") else "&amp;" + m[0][1:], html)


def extract_articles(pages: DataFrame, bare: bool = True) -> DataFrame:
    """title (h1, else title), published (first time or meta), text (article, else main, else title) of pages (page_id, html); null is as empty.

    bare: also read references that lack their semicolon, as browsers do, such as the
    &amp that is left of a cut &amp; without it they stay as they are written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for html in b.column(1).to_pylist():
                p = _Article()
                p.feed((html or "") if bare else _ended_only(html or ""))
                p.close()
                out.append((p.text("h1", "title"), p.at, p.text("article", "main", "h1", "title")))
            cols = [pa.array([r[k] for r in out], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["page_id", "title", "published", "text"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, title string, published string, text string")

"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range, built and compared by SQL functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, lookup, stable, text_hash

#: A hash is the first HASH_DIGITS hex digits of an MD5; those below LIMIT, a fraction of KEPT of all, are kept.
SHINGLE, HASH_DIGITS, KEPT, LIMIT = 5, 12, 0.25, "4"


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _kept(hashes: Column) -> Column:
    """The distinct hashes below LIMIT, in order; the least one if none is."""
    low = F.filter(hashes, lambda h: h < LIMIT)
    return _named(low, lambda x: F.when(F.size(x) > 0, F.array_sort(F.array_distinct(x))).otherwise(F.slice(F.array_sort(hashes), 1, 1)))


def sketch(text: Column) -> Column:
    """Sorted distinct hashes, below LIMIT, of the SHINGLE-word shingles of a text; null is as empty.

    Fewer words are one shingle, none are none. As the limit is the same for all
    texts, a hash that one text keeps is kept by every text that has the shingle:
    shares of kept hashes estimate shares of shingles, however unequal the texts.
    A text with shingles all of whose hashes reach the limit keeps the least one,
    so that only its likes share it. Equal words give equal sketches.
    """

    def of(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1)))
        hashes = F.transform(places, lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, SHINGLE), " ").cast("binary")), 1, HASH_DIGITS))
        return F.when(F.size(w) > 0, _named(hashes, _kept)).otherwise(F.array().cast("array<string>"))

    return _named(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), of)


def fingerprint(hashes: Column) -> Column:
    """A sketch as text: its hashes in order, HASH_DIGITS characters each."""
    return F.array_join(hashes, "")


def hashes_of(text: Column) -> Column:
    """The sketch of a fingerprint."""
    return F.regexp_extract_all(text, F.lit(f"[0-9a-f]{{{HASH_DIGITS}}}"), F.lit(0))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    return _named(F.array_union(a, b), _kept)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, from sketches: 0 to 1; if a keeps no hash, 1 if b keeps none either, else 0."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise((F.size(b) == 0).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """The larger of both containments: near 1 if one text holds the other."""
    return F.greatest(containment(a, b), containment(b, a))


def _cuts(ids: DataFrame, parts: int) -> list[int]:
    """At most parts - 1 rising ids that cut ids (doc_id) into parts of about equal counts; parts is a setting, not a size of the data."""
    at = [(i + 1) / parts for i in range(parts - 1)]
    got = ids.select(F.percentile_approx("doc_id", at, 10 * parts).alias("q")).first()["q"] if at else []
    return sorted(set(got or []))


def _part(doc_id: Column, cuts: list[int]) -> Column:
    """The number of cuts that are at most doc_id, by binary search; a null id comes before all."""
    step, all_cuts = 1 << max(0, len(cuts).bit_length() - 1), F.lit(cuts) if cuts else None
    steps = [step >> k for k in range(step.bit_length())] if cuts else []
    if not steps:
        return F.lit(0)
    further = lambda at, s: (at + s <= len(cuts)) & (F.get(all_cuts, F.least(at + s, F.lit(len(cuts))) - 1) <= doc_id)
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, s: at + F.when(F.coalesce(further(at, s), F.lit(False)), s).otherwise(0))


def with_next(docs: DataFrame, made: dict[str, Column]) -> DataFrame:
    """docs (doc_id, text) with the columns `made` of each row and next, a struct of the next row's text and made columns.

    The next row is that of the next smaller id (a null id is the smallest); of
    rows of one id, that of the next smaller text_hash(); after the last comes the
    first again. A row alone is its own next. Rows are dealt by id to ranges of
    about equal counts; the first row of a range also goes to the range before it.
    """
    session: SparkSession = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("th"))
    cuts = _cuts(docs.select(F.col("doc_id").cast("long").alias("doc_id")), 4 * int(session.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("part", _part(F.col("doc_id"), cuts))
    # The first row of each part, in falling order, is wanted at the end of the part above it (of the lowest part, if it is in the highest).
    heads = stable(rows.groupBy("part").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "th")).alias("head")))
    by = Window.orderBy("part")
    above = F.coalesce(F.lead("part").over(by), F.lit(-1))
    lowest = F.min("part").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    guests = heads.select("part", "head", F.when(above >= 0, above).otherwise(lowest).alias("host"))
    x = lookup(rows, guests, "part")
    is_head = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("th") == F.col("head.th"))
    # Equal rows of a head are one as guests: any of them gives the same text.
    x = x.withColumn("place", F.explode(F.when(is_head, F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("guest")), F.struct(F.col("host").alias("p"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("guest"))))))
    x = x.select("doc_id", "text", "th", "place.p", "place.guest").repartition("p").select("*", *[c.alias(k) for k, c in made.items()])
    order = Window.partitionBy("p").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("th").desc())
    x = x.withColumn("next", F.lead(F.struct("text", *made)).over(order))
    return x.filter("guest = 0").select("doc_id", "text", *made, "next")


def edited(text: Column, other: Column) -> Column:
    """text whose last half of code points, rounded down, is replaced by the first as many of other, or all if it has fewer."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, sketch array<string> of each row of docs (doc_id, text).

    A null text is as empty, an empty text has an empty sketch; null and repeated
    ids are rows as any other, an empty table gives none, other columns are
    ignored. A text is held by one task.
    """
    return docs.select("doc_id", sketch(F.col("text")).alias("sketch"))


def edit_report(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): its sketch, that of its edited text (see edited(), with_next()), and how alike they are."""
    blank = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    x = with_next(blank, {"own": sketch(F.col("text"))})
    x = x.withColumn("changed", edited(F.col("text"), F.col("next.text")))
    x = x.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("changed").cast("binary"), 256).alias("edited_sha256"), "own", sketch(F.col("changed")).alias("new"), F.col("next.own").alias("other"))
    return x.select("doc_id", "n_chars", "edited_sha256", F.col("own").alias("sketch"), F.col("new").alias("edited_sketch"), likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("other")).alias("near_next"))

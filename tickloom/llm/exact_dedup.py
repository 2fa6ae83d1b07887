"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, lookup, one_a_group, stable, text_hash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(text: str | Column) -> Column:
    return F.translate(text, UPPER, LOWER)


#: Most distinct lengths that are broadcast: one number each.
LENGTHS = 2_000_000


def _hashed(docs: DataFrame, prefix_chars: int, hash_all: bool) -> DataFrame:
    """doc_id, th (text_hash() of alike rows), alike (length and prefix hash repeat), sha (of alike rows; with hash_all of all).

    Each step reads the documents with the lists of the steps before it: lengths
    that repeat, then prefix hashes that repeat among rows of such lengths.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("raw"), F.coalesce("text", F.lit("")).alias("text")).withColumn("len", F.octet_length("text").cast("long"))
    lengths = stable(base.groupBy("len").agg(F.count("*").alias("same_length")).filter("same_length > 1"))
    prefix = F.when(F.col("same_length").isNotNull(), F.xxhash64(_lowered(F.substring("text", 1, prefix_chars)), F.col("len")))
    rows = lookup(base, lengths, "len", LENGTHS).withColumn("prefix", prefix)
    prefixes = stable(rows.filter("prefix is not null").groupBy("prefix").agg(F.count("*").alias("n")).filter("n > 1"))
    alike = F.col("n").isNotNull()
    sha = F.sha2(_lowered("text").cast("binary"), 256)
    flagged = lookup(rows, prefixes, "prefix")
    return stable(flagged.select("doc_id", F.when(alike, text_hash(text="raw")).alias("th"), alike.alias("alike"), (sha if hash_all else F.when(alike, sha)).alias("sha")))


def exact_dedup(docs: DataFrame, prefix_chars: int = 256, hash_all: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    The largest doc_id of a group stays. Lengths in bytes come first; only rows
    whose length repeats have their first characters hashed, and only rows whose
    length and prefix hash repeat have the whole text hashed. With hash_all the
    other rows get their hash too, for output alone. Rows that repeat both id and
    text are one document: each row is reported, and counted in group_size, and
    kept if its id is. A null doc_id is kept only if the group has no other id.
    An empty table gives no rows; other columns are ignored.
    """
    rows = _hashed(docs, prefix_chars, hash_all)
    groups = rows.filter("alike").groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    found = attach(rows, groups, "sha")
    keep = F.coalesce("keep_id", "doc_id")
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, prefix_chars: int = 256) -> DataFrame:
    """docs with one row of each group of equal texts, that of the largest id (null last; of its texts the one of the largest hash).

    All columns of docs come through.
    """
    rows = _hashed(docs, prefix_chars, hash_all=False)
    return one_a_group(docs, rows.select("doc_id", "th", F.when(F.col("alike"), F.col("sha")).alias("gid")), largest=True)

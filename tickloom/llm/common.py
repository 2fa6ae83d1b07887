"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows of a key table that is broadcast after its size has been counted.
BROADCAST_ROWS = 200_000
#: Most bytes of texts or sets in an Arrow batch of a step that stable() writes (a single longer row is a batch of its own).
BATCH_BYTES = 8 << 20


#: Lists of the tables that open scratch() blocks have written, the innermost last.
_made: list[list[str]] = []


def stable(df: DataFrame) -> DataFrame:
    """Write df as a table in the checkpoint folder that executors share, and read it from there.

    checkpoint() would keep the partitioning and order that the plan had; over
    rounds of joins those descriptions multiply until planning takes minutes.
    The table has none, so a join shuffles both sides and may split hot keys.
    Python gets small batches meanwhile: a batch is held by the JVM and, often
    more than once, by each Python worker beside the heap.
    """
    session = df.sparkSession
    sc = session.sparkContext
    if not sc.getCheckpointDir():
        folder = session.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    most = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = session.conf.get(most)
    session.conf.set(most, BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        session.conf.set(most, before)
    for made in _made[-1:]:
        made.append(path)
    return session.read.schema(df.schema).parquet(path)


def remove(session: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    sc = session.sparkContext
    for p in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(session: SparkSession) -> Iterator[list[str]]:
    """Tables that stable() writes inside are listed, and those still in the list at the end are deleted."""
    _made.append([])
    try:
        yield _made[-1]
    finally:
        remove(session, _made.pop())


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def unit_random(*parts: str | Column, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the parts and the seed alone."""
    bits = F.xxhash64(*[F.col(p) if isinstance(p, str) else p for p in parts], F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1))
    return (bits + F.lit(0.5)) / F.lit(float(1 << 53))


def attach(rows: DataFrame, groups: DataFrame, key: str | list[str]) -> DataFrame:
    """Left join of groups (one row a key, with columns of their own) to rows, whose keys may be hot.

    Rebalancing leaves the groups without a partitioning by the key, so both
    sides of a sort-merge join are shuffled for it and Spark's skew join can
    split a hot key's rows among tasks.
    """
    return rows.join(groups.hint("rebalance"), key, "left")


def at_most(table: DataFrame, n: int) -> int:
    """The number of rows of table, or n if that is less."""
    return table.limit(n).count()


def sized(table: DataFrame, n: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """table, which has n rows at most, for a join: broadcast if that is within the bound, else as in attach()."""
    return F.broadcast(table) if n <= bound else table.hint("rebalance")


def lookup(rows: DataFrame, table: DataFrame, key: str | list[str], bound: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of a key table: by broadcast if a count shows at most `bound` rows, else as attach().

    The table is computed for the count and again for the join: where that costs
    more than a read, pass it through stable() first.
    """
    return rows.join(sized(table, at_most(table, bound + 1), bound), key, "left")


def numbered(rows: DataFrame, keys: list[str], order: list[str], out: str, total: int, key_bound: int) -> DataFrame:
    """Number rows from 0 without gaps within each combination of keys.

    Rows of a key are dealt to buckets of a few thousand by a hash of the order
    columns; counts of buckets give each bucket its first number.
    """
    per_key = max(64, -(-total // (4000 * max(1, key_bound))))
    b = F.pmod(F.xxhash64(*order, F.lit(17)), F.lit(per_key)).cast("int")
    rows = rows.withColumn("_b", b)
    counts = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    first = counts.withColumn("_first", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    inner = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)) - 1
    return (
        rows.withColumn("_i", inner)
        .join(first.drop("_n"), [*keys, "_b"])
        .withColumn(out, (F.coalesce("_first", F.lit(0)) + F.col("_i")).cast("long"))
        .drop("_b", "_i", "_first")
    )


def text_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    """With the id, tells a row's text from others of that id; a null id has hashes of its own."""
    return F.xxhash64(text, F.col(doc_id).isNull())


def one_a_group(docs: DataFrame, members: DataFrame, largest: bool) -> DataFrame:
    """docs (doc_id, text) with one row of each group, by the largest or smallest id; a null id comes last.

    members (doc_id, th, gid) names the group of each row, th being text_hash();
    rows with a null gid all stay. Of one id's texts in a group the one with the
    largest or smallest hash stays, and of equal rows one. What is joined to the
    documents is the list of those to drop, broadcast while a count shows it
    small; only rows that occur twice are shuffled to become one.
    """
    one = members.filter("gid is not null").groupBy("gid", "doc_id", "th").agg(F.count("*").alias("n"))
    one = stable(one)
    named = F.struct(F.col("doc_id").isNull() if not largest else F.col("doc_id").isNotNull(), "doc_id", "th")
    best = one.groupBy("gid").agg((F.max if largest else F.min)(named).alias("best"))
    first = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.th") == F.col("th"))
    marked = attach(one, best, "gid").select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("th").alias("_th"), first.alias("_first"), "n")
    marked = stable(marked.filter("n > 1 or not _first").drop("n"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), text_hash().alias("_th"))
    found = lookup(rows, marked, ["_id", "_th"])
    out = found.filter("_first is null")
    if not marked.filter("_first").isEmpty():
        out = out.unionByName(found.filter("_first").dropDuplicates(["_id", "_th"]))
    return out.select("_row.*")

"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, stable, unit_random, word_count

BIN_BITS = 12
#: A document's expected copies fall with its size to this power, so that no long one fills a source's share alone.
DAMPING = 0.125


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """Target size of each source (skey, source_size, n): weights repeat in code-point order, null last.

    No target is above `most` times its source's size; the excess goes to the
    others by weight until none is above. That is one water level for
    target / weight, found over sources sorted by cap / weight.
    """
    rank = F.row_number().over(Window.orderBy("skey")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "skey")
    everyone = Window.partitionBy()
    capped = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_w = F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("i", F.row_number().over(by_ratio)).withColumn("level", (F.sum("source_size").over(everyone) * F.lit(float(share)) - capped) / open_w)
    fits = F.col("level") * F.col("w") <= F.col("cap")
    level = F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("i"))).over(everyone)
    target = F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap")))
    return s.select("skey", "source_size", "n", target.alias("target"))


def inclusion(sizes: DataFrame, targets: DataFrame, most: float = 3.0) -> DataFrame:
    """Expected copies of each size class (skey, class, s the class's words): base whole ones and p, the chance of one more.

    Expected copies are level * class weight, at most `most`, with one level a
    source at which they make its target; it is found over classes, the heaviest
    weights first, of which a source has some tens at most.
    """
    weight = F.pow(F.lit(2.0), -F.col("class") * F.lit(DAMPING / 2))
    x = sizes.join(targets.select("skey", "target"), "skey").withColumn("w", weight)
    w = Window.partitionBy("skey").orderBy("class")
    before = F.coalesce(F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(float(most))
    rest = F.sum(F.col("s") * F.col("w")).over(w.rowsBetween(0, Window.unboundedFollowing))
    x = x.withColumn("level", F.when(rest > 0, (F.col("target") - before) / rest))
    fits = F.col("level") * F.col("w") <= F.lit(float(most)) + 1e-9
    level = F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("class"))).over(Window.partitionBy("skey"))
    copies = F.least(F.lit(float(most)), F.greatest(F.coalesce(level * F.col("w"), F.lit(float(most))), F.lit(0.0)))
    x = x.withColumn("copies", F.when(F.col("s") > 0, copies).otherwise(0.0)).withColumn("base", F.floor(F.col("copies") + 1e-9))
    return x.select("skey", "class", "s", "base", F.greatest(F.col("copies") - F.col("base"), F.lit(0.0)).alias("p"))


def _cut(rows: DataFrame, need: DataFrame) -> DataFrame:
    """Where each source's words in order of (x, doc_id) reach need.words at most: skey, cut_x, cut_id.

    Sums of bins of x, then of bins within the bin that crosses, find where the
    words run out; only rows of that inner bin are put in order.
    """

    def crossing(at: DataFrame, before: Column, b: str) -> DataFrame:
        sums = at.groupBy("skey", b).agg(F.sum("size").alias("s"))
        end = F.sum("s").over(Window.partitionBy("skey").orderBy(b))
        table = sums.withColumn("end", end).join(before, "skey").withColumn("end", F.col("end") + F.col("done"))
        over = table.filter("end > words").groupBy("skey").agg(F.min_by(b, F.col(b)).alias(f"{b}_at"), F.min_by(F.col("end") - F.col("s"), F.col(b)).alias("done_at"))
        return over

    n = 1 << BIN_BITS
    rows = rows.withColumn("b1", F.floor(F.col("x") * n).cast("int")).withColumn("b2", F.floor((F.col("x") * n - F.floor(F.col("x") * n)) * n).cast("int"))
    start = need.select("skey", "words", F.lit(0).cast("long").alias("done"))
    one = stable(crossing(rows, start, "b1"))
    inside = rows.join(F.broadcast(one.limit(1000)), "skey") if one.limit(1001).count() <= 1000 else rows.join(one, "skey")
    inside = stable(inside.filter("b1 = b1_at").drop("done_at"))
    two = stable(crossing(inside, one.join(need.select("skey", "words"), "skey").select("skey", "words", F.col("done_at").alias("done")), "b2"))
    last = inside.join(two, "skey").filter("b2 = b2_at").join(need.select("skey", "words"), "skey")
    run = F.sum("size").over(Window.partitionBy("skey").orderBy("x", "doc_id", "size")) + F.col("done_at")
    over = last.withColumn("run", run).filter("run > words").groupBy("skey").agg(F.min(F.struct("x", "doc_id")).alias("first_out"))
    return over.select("skey", F.col("first_out.x").alias("cut_x"), F.col("first_out.doc_id").alias("cut_id"))


def _before(cut_x: Column, cut_id: Column) -> Column:
    """Whether a row (x, doc_id) stands before its source's cut; with no cut, all do."""
    return cut_x.isNull() | (F.col("x") < cut_x) | ((F.col("x") == cut_x) & (F.col("doc_id") < cut_id))


def with_copies(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0, seed: int = 7, fills: int = 2) -> DataFrame:
    """docs with size, source_size, target and copies (whole copies that the mix takes).

    A document's expected copies are its source's level times a weight that
    falls with its size (see DAMPING), at most `most`; sizes are told apart by
    half powers of two. The whole part is certain, the fraction is its inclusion
    probability. Documents are ranked by random odds / inclusion odds and taken
    from the front while their words fit what is left of the target; the next
    passes take, in the same order, documents that fit what then remains. Null
    and empty texts have size 0 and are never taken; a null source is a source
    of its own, last. Rows with equal ids and sizes (null ids: and
    texts) tie and go together. An
    empty table gives no rows. Result columns of the same name in docs are
    replaced.
    """
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    skey = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t"))  # "t" sorts behind every "s..."
    i = F.coalesce("doc_id", F.lit(-1)).cast("long")
    marked = docs.select(F.struct(*own).alias("row"), i.alias("doc_id"), skey.alias("skey"), word_count("text").alias("size"), unit_random(i, F.when(F.col("doc_id").isNull(), F.xxhash64("text")), seed=seed).alias("u"))
    marked = marked.withColumn("class", F.when(F.col("size") > 0, F.floor(2 * F.log2(F.col("size").cast("double")))).otherwise(0).cast("int"))
    narrow = stable(marked.select("doc_id", "skey", "class", "size", "u"))
    classes = stable(narrow.groupBy("skey", "class").agg(F.sum("size").alias("s"), F.count("*").alias("n")))
    targets = stable(source_targets(classes.groupBy("skey").agg(F.sum("s").alias("source_size"), F.sum("n").alias("n")), weights, share, most))
    plan = stable(inclusion(classes, targets, most))
    need = plan.groupBy("skey").agg(F.round(F.sum(F.col("p") * F.col("s"))).cast("long").alias("words"))

    def ranked(rows: DataFrame) -> DataFrame:
        odds = F.col("p") / (1 - F.col("p"))
        q = (F.col("u") / (1 - F.col("u"))) / odds
        return rows.withColumn("x", F.when(F.col("p") > 0, F.least(q / (1 + q), F.lit(1 - 2.0**-40))))

    rows = lookup(narrow, plan.select("skey", "class", "p"), ["skey", "class"]).filter("p > 0")
    rows, need, cuts = stable(ranked(rows).select("doc_id", "skey", "size", "x")), stable(need), []
    for _ in range(fills):
        cut = stable(_cut(rows, need))
        at = stable(need.join(cut, "skey", "left"))
        cuts.append(at)
        seen = lookup(rows, at, "skey").withColumn("in", _before(F.col("cut_x"), F.col("cut_id")) & (F.col("size") <= F.col("words")))
        took = seen.filter("in").groupBy("skey").agg(F.sum("size").alias("took"))
        need = stable(need.join(took, "skey", "left").select("skey", (F.col("words") - F.coalesce("took", F.lit(0))).alias("words")))
        rows = stable(lookup(seen.filter("not in").select("doc_id", "skey", "size", "x"), need, "skey").filter("size <= words").select("doc_id", "skey", "size", "x"))
    plan = plan.drop("s").join(targets.select("skey", "source_size", "target"), "skey")
    for k, c in enumerate(cuts):
        plan = plan.join(c.select("skey", *[F.col(v).alias(f"{v}_{k}") for v in ("words", "cut_x", "cut_id")]), "skey", "left")
    out = ranked(lookup(marked, stable(plan), ["skey", "class"]))
    picked = F.lit(False)
    for k in range(fills):
        front = _before(F.col(f"cut_x_{k}"), F.col(f"cut_id_{k}"))
        picked = picked | (front & (F.col("size") <= F.col(f"words_{k}")))
    picked = picked & (F.col("p") > 0) & (F.col("size") > 0)
    return out.withColumn("copies", (F.col("base") + F.coalesce(picked, F.lit(False)).cast("int")).cast("int")).select("row.*", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents: each row repeated as often as the mix takes it. Rows without words, null texts included, are not taken."""
    kept = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_document"))
    out = with_copies(kept, **how)
    return out.filter("copies > 0").select("_document", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_document.*")

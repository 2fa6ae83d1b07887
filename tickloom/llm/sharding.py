"""Sharding by a k-d tree: weighted medians along the widest metadata dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, numbered, stable

DIM_BITS, ROUND_BITS, ROUNDS = 12, 12, 3


def _dimensions() -> dict[str, Column]:
    code = lambda c: F.coalesce(F.crc32(F.min(c).cast("string")), F.lit(0)).cast("double")
    return {"length": F.log2(F.max("bytes") + F.lit(1.0)), "lang": code("lang"), "source": code("source")}


def kd_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: equal texts share a shard, shards have near equal bytes.

    Rows with equal texts (by a 64-bit hash; null apart from empty) form one
    point, placed by length, smallest language and smallest source of its rows
    and weighing the sum of their sizes. A node of k shards is cut along the
    dimension that is widest in it, against its range over all points, where the
    weight reaches floor(k/2)/k; points of equal coordinate follow their hash.
    Cuts are found by sums over 4096 bins, refined ROUNDS times: what comes to
    the driver is 4096 sums a node and round, whatever the input. Nulls in lang
    or source count as one value; an empty table gives no rows. A group of
    copies heavier than a shard fills one alone. docs needs doc_id and text;
    missing lang or source count as null.
    """
    for c in ("lang", "source"):
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit(None).cast("string"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = stable(docs.select("doc_id", (size + 1).alias("size"), size.alias("bytes"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64("text").alias("tkey"), "lang", "source"))
    dims = _dimensions()
    points = stable(rows.groupBy("tkey").agg(F.sum("size").alias("w"), F.count("*").alias("n"), *[v.alias(k) for k, v in dims.items()]))
    ends = points.agg(*[f(k).alias(f"{n}_{k}") for k in dims for n, f in (("lo", F.min), ("hi", F.max))], F.sum("n").alias("n")).first()
    if ends["n"] is None:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))

    def scaled(k: str) -> Column:
        lo, hi = ends[f"lo_{k}"], ends[f"hi_{k}"]
        return (F.floor((F.col(k) - lo) / (hi - lo) * ((1 << DIM_BITS) - 1)) if hi > lo else F.lit(0)).cast("long")

    tie = F.pmod(F.xxhash64("tkey", F.lit(3)), F.lit(1 << 24))
    tree = stable(points.select("tkey", "w", "n", *[scaled(k).alias(k) for k in dims], tie.alias("tie")))
    node, open_nodes, leaves = F.lit(0), {0: shards}, {}
    made = 1
    while any(k > 1 for k in open_nodes.values()):
        here = tree.withColumn("node", node)
        stats = {r["node"]: r for r in here.groupBy("node").agg(F.sum("w").alias("w"), *[(F.max(k) - F.min(k)).alias(k) for k in dims]).collect()}
        key, cuts = F.lit(None).cast("long"), {}
        for i, k in open_nodes.items():
            if k > 1 and i in stats:
                widest = max(dims, key=lambda d, s=stats[i]: s[d])
                key = F.when(F.col("node") == i, F.col(widest) * (1 << 24) + F.col("tie")).otherwise(key)
                cuts[i] = {"prefix": 0, "done": 0, "goal": stats[i]["w"] * (k // 2) / k}
        here = here.withColumn("key", key)
        for r in range(ROUNDS):
            shift = ROUND_BITS * (ROUNDS - 1 - r)
            above = F.shiftright("key", shift + ROUND_BITS)
            same = F.lit(False)
            for i, c in cuts.items():
                same = same | ((F.col("node") == i) & (above == c["prefix"]))
            sums: dict[int, list] = {}
            for x in here.filter(same).groupBy("node", F.shiftright("key", shift).alias("b")).agg(F.sum("w").alias("w")).collect():
                sums.setdefault(x["node"], []).append((x["b"], x["w"]))
            for i, c in cuts.items():
                for b, w in sorted(sums[i]):
                    c["prefix"] = b
                    if c["done"] + w >= c["goal"]:
                        if r == ROUNDS - 1 and c["done"] + w - c["goal"] > c["goal"] - c["done"]:
                            c["prefix"] = b - 1
                        break
                    c["done"] += w
        moved, after = node, {}
        for i, k in open_nodes.items():
            if k <= 1:
                after[i] = k
            elif i not in cuts:
                after[i] = 1
            else:
                widest = max(dims, key=lambda d, s=stats[i]: s[d])
                right = (node == i) & (F.col(widest) * (1 << 24) + F.col("tie") > cuts[i]["prefix"])
                moved = F.when(right, F.lit(made)).otherwise(moved)
                after[i], after[made] = k // 2, k - k // 2
                made += 1
        tree = stable(tree.withColumn("node", moved))
        node, open_nodes = F.col("node"), after
    ids = {i: s for s, i in enumerate(sorted(open_nodes))}
    shard = F.lit(0)
    for i, s in ids.items():
        shard = F.when(node == i, F.lit(s)).otherwise(shard)
    placed = attach(rows, tree.select("tkey", shard.cast("int").alias("shard")), "tkey")
    return numbered(placed, ["shard"], ["doc_id", "tkey"], "slot", ends["n"], shards).select("doc_id", "size", "text_crc32", "shard", "slot")

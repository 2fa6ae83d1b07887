"""Threshold-scaled sketches against brute force."""

import hashlib
import random

from pyspark.sql import functions as F

from tickloom.llm import scaled_sketch as S
from tickloom.llm.queries import op12_scaled_sketch

SCHEMA = "doc_id long, text string, part int, next string, th long, own int"


def plain_sketch(text):
    words = (text or "").encode().split()
    shingles = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    hashes = sorted({hashlib.md5(s).hexdigest()[:12] for s in shingles})
    return [h for h in hashes if h < "4"] or hashes[:1]


def alike(a, b):
    return len(set(a) & set(b)) / min(len(a), len(b)) if a and b else float(len(a) == len(b))


def expected(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    out = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        new = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, b, c = map(plain_sketch, (t, new, nxt))
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), "".join(a), "".join(b), alike(a, b), alike(a, c)))
    return sorted(out)


def some_rows():
    rng = random.Random(5)
    words = ["w%d" % k for k in range(60)] + ["é", "𝄞x", "ß"]
    rows = [(i * i - 500, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 120)))) for i in range(150)]
    rows += [(-10_000, None), (90_000, ""), (90_001, " \n"), (90_002, "one two"), (90_003, "one two"), (90_004, rows[9][1]), (1 << 60, "last words here é"), (-(1 << 60), " ".join(rng.choice(words) for _ in range(30_000)))]
    return rows


def test_query(spark, tmp_path):
    rows = some_rows()
    spark.createDataFrame([(i, t, 1, "n", 2, 3) for i, t in rows], SCHEMA).repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, op12_scaled_sketch(spark, str(tmp_path)).collect())) == expected(rows)


def test_one_row_and_few_rows(spark):
    for n in (1, 2, 3):
        rows = [(i * 7, f"a b c d e f g {i}") for i in range(n)]
        got = S.edit_report(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_chars", "edited_sha256").collect()
        assert sorted(map(tuple, got)) == [r[:3] for r in expected(rows)]


def test_null_and_repeated_ids(spark):
    rows = [(None, "null id one"), (None, "null id two"), (3, "same text"), (3, "same text"), (3, "other text"), (5, None)]
    x = S.with_next(spark.createDataFrame(rows, "doc_id long, text string"), {"n": F.char_length("text")}).select("doc_id", "text", "next.text").collect()
    pairs = [((r[0], r[1]), r[2]) for r in x]
    assert sorted(map(str, (p[0] for p in pairs))) == sorted(map(str, rows)) and len(pairs) == 6
    assert sorted(str(p[1]) for p in pairs) == sorted(str(t) for _, t in rows)  # each row is the next of one
    assert {p[1] for p in pairs if p[0][0] == 5} <= {"same text", "other text"} and [p[1] for p in pairs if p[0][0] is None][0] is not None


def test_empty_table(spark):
    assert S.edit_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_containment_of_unequal_texts_and_unions(spark):
    rng = random.Random(6)
    big, small = [[f"{k}{rng.randrange(10**6)}" for _ in range(n)] for k, n in (("b", 20_000), ("s", 900))]
    texts = {"part": " ".join(big[500:1400]), "big": " ".join(big), "small": " ".join(small), "joined": " ".join(big) + "\n" + " ".join(small)}
    k = spark.createDataFrame([tuple(texts.values())], list(texts)).select(*[S.sketch(F.col(c)).alias(c) for c in texts])
    r = k.select(
        S.containment(F.col("part"), F.col("big")).alias("inside"), S.containment(F.col("big"), F.col("part")).alias("share"), S.containment(F.col("small"), F.col("big")).alias("none"),
        S.likeness(F.col("part"), F.col("big")).alias("like"), S.merged(F.col("big"), F.col("small")).alias("union"), "joined", (F.size("big") / 19_996).alias("kept"), S.hashes_of(S.fingerprint(F.col("big"))).alias("again"), "big",
    ).first()
    assert r.inside == r.like == 1 and r.none == 0 and abs(r.share - 896 / 19_996) < 0.02 and abs(r.kept - S.KEPT) < 0.02
    assert set(r.union) <= set(r.joined) and len(r.joined) - len(r.union) <= 4 and r.again == r.big
    one, two = (spark.createDataFrame([(t,)], "t string").select(S.sketch(F.col("t")).alias("s")).first().s for t in ("lone words", "other lone words"))
    assert len(one) == len(two) == 1 and one != two


def test_parts_follow_the_ids(spark):
    x = spark.range(1000).withColumn("doc_id", F.col("id") * F.col("id"))
    cuts = S._cuts(x, 16)
    sizes = x.groupBy(S._part(F.col("doc_id"), cuts).alias("p")).agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("p").collect()
    assert len(sizes) == 16 and all(40 < r.n < 90 for r in sizes) and all(a.b < b.a for a, b in zip(sizes, sizes[1:]))

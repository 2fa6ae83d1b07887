"""Divergence of sources against brute force."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from tickloom.llm.divergence import LONG_COUNT, _counted, _scaled, _terms, counted_terms, divergence_audit
from tickloom.llm.queries import op13_source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, value long, item string, v int"


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def expected(rows, least=10, top=10):
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text or "")))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in d[2])
        kept = [t for t, n in df.items() if n >= least]
        counts = defaultdict(Counter)
        for _, source, c in own:
            counts[source].update({t: c[t] for t in kept})
        whole = sum(counts.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        ps, q = {s: p(c) for s, c in counts.items()}, p(whole)
        for s in ps:
            pairs = [(-sum(f(ps[s][t], ps[o][t]) for t in kept), o.encode(), o) for o in ps if o != s]
            found = [(-f(ps[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and ps[s][t] > q[t]]
            for part, some in (("pair", sorted(pairs)), ("term", sorted(found)[:top])):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(some, 1)]
    return sorted(out)


def test_query(spark, tmp_path):
    rng = random.Random(8)
    words = ["Wort", "wOrt2", "haus", "É", "é", "ж", "𝄞", "a_b", "it's", "Zug", "der", "x"] + ["t%s" % chr(97 + k) for k in range(24)]
    rows = [(i, " ".join(rng.choice(words[(i % 5) :]) for _ in range(rng.randrange(0, 60))), rng.choice(["de", "de", "fr", None]), rng.choice(["s0", "s0", "s1", "Ä", "", None])) for i in range(240)]
    rows += [(300 + i, "seldom words", "xx", f"s{i % 3}") for i in range(9)]  # too few documents for a kept term
    rows += [(400 + i, None if i % 2 else "1 2 3", "yy", f"s{i % 3}") for i in range(14)]  # no terms at all
    rows += [(500, None, None, "alone"), (501, "", "de", "empty"), (502, "haus " * 70_000, "de", "long"), (None, "haus", "de", "s0"), (7, "haus der", "fr", "s1"), (7, "haus der", "fr", "s1")]
    spark.createDataFrame([(*r, "t", 1, "i", 2) for r in rows], SCHEMA).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = op13_source_divergence(spark, str(tmp_path))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == expected(rows)
    again = divergence_audit(spark.read.parquet(str(tmp_path / "documents.parquet")), min_docs=3, top=2).collect()
    assert sorted(map(tuple, again)) == expected(rows, 3, 2)


def test_empty_table_and_one_source(spark):
    assert divergence_audit(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([("a b",) for _ in range(12)], "text string").selectExpr("text", "'en' lang", "'s' source")
    assert divergence_audit(one).count() == 0  # no other source, and no term above the language's share


def test_chunks_add_up_to_counts_of_documents():
    rng = random.Random(3)
    words = ["à", "Å", "é…ü", "\u00a0", "\u0085x", "Zug", "zug", "a-b", "𝄞", "ж", "1", ""] + ["w%s" % chr(97 + k) for k in range(14)]
    rows = [(rng.choice(["de", "fr", ""]), rng.choice(["s", "", "t"]), rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randrange(40)))])) for _ in range(200)]
    docs, df, times, layers = Counter(), Counter(), Counter(), Counter()
    while rows:
        n = rng.choice([1, 5, 40])
        held, rows = rows[:n], rows[n:]
        parts = [held[: n // 2], held[n // 2 :]]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*part, strict=True)], names=["lang", "source", "text"]) for part in parts if part]
        chunk = Counter()
        for lang, source, text in held:
            found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text or ""))
            docs[lang, source] += 1
            chunk.update((lang, t) for t in {"", *found})
            times.update((lang, source, t) for t in found)
        df.update({k: min(n, 4) for k, n in chunk.items()})
        for b in _counted([_terms(b) for b in batches], 4):
            for r in b.to_pylist():
                docs.subtract({(r["lang"], r["source"]): r["docs"] or 0})
                layers.update((r["lang"], t) for t in r["kinds"] or [])
                times.subtract({(r["lang"], r["source"], t): r["times"] for t in r["terms"] or []})
                assert all(len(set(r[c])) == len(r[c]) > 0 for c in ("kinds", "terms") if r[c] is not None)
    assert layers == df and not any(docs.values()) and not any(times.values())


def test_copies_are_counted_where_they_are_read(spark):
    """Of 2,000 copies of 40 words in 3 groups, a task passes each word on 10 times for its language and once for each group."""
    text = " ".join(f"{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40))
    docs = spark.range(0, 2000, 1, 1).select(F.lit(text).alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    sent = counted_terms(docs, 10).agg(F.sum(F.size("kinds")).alias("kinds"), F.sum(F.size("terms")).alias("terms"), F.sum("docs").alias("docs"))
    assert tuple(sent.filter("docs = 2000").select("kinds", "terms").first()) == (10 * 41, 3 * 40)


def test_shares_of_large_counts(spark):
    rows = [(n, n + more, v) for n in (0, 1, 7, LONG_COUNT - 1, LONG_COUNT, LONG_COUNT + 1, 10**15) for more in (0, 5, 10**12 + 7) for v in (0, 1, 3)]
    got = spark.createDataFrame(rows, "n long, total long, v long").select("n", "total", "v", _scaled(F.col("n"), F.col("total"), F.col("v")).alias("p")).collect()
    assert len(got) == len(rows) and all(r.p == (1 + 10**9 * (r.n + 2) // (r.total + 2 * r.v) if r.v else None) for r in got)

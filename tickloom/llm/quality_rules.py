"""Quality rules with an isolation forest over their statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stable, unit_random
from .textstats import RATIOS, text_stats

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rows that the trees are grown from (as expected), trees, rows a tree, and the share of good labelled rows that the threshold keeps.
SAMPLE, TREES, ROWS, KEEP_GOOD = 8192, 100, 64, 0.998
#: Statistics that a forest looks at. Each set has a forest of its own; the labelled rows say which one decides.
SETS = (
    ("word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "distinct"),
    ("word_length", "symbols", "marks"),
    ("dup_lines", "repeats", "distinct"),
    ("upper", "digits", "marks"),
)
BINS = 2000


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts, ratios = [], []
        for t in b.column(1):
            _, c, r = text_stats(t.as_py())
            counts.append(c)
            ratios.append(r)
        c = np.array(counts, np.int64).reshape(-1, len(COUNTS))
        r = np.array(ratios, float).reshape(-1, len(RATIOS))
        yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, c.T), *map(pa.array, r.T)], names=["doc_id", *COUNTS, *RATIOS])


def rule_stats(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS and RATIOS of each row of docs (doc_id, text)."""
    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), *(f"{r} double" for r in RATIOS)])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_stats, schema)


class IsolationForest:
    """Trees of random cuts; score() is near 1 for rows that few cuts isolate, under 0.5 for usual ones."""

    def __init__(self, x: np.ndarray, trees: int = TREES, rows: int = ROWS, seed: int = 11):
        rng = np.random.default_rng(seed)
        rows = min(rows, len(x))
        self.depth = max(1, int(np.ceil(np.log2(max(2, rows)))))
        size = (1 << (self.depth + 1)) - 1
        self.feature = np.full((trees, size), -1, np.int16)
        self.cut = np.zeros((trees, size))
        self.path = np.zeros((trees, size))
        self.mean = self._unfinished(rows)
        for t in range(trees):
            self._grow(t, 0, 0, x[rng.choice(len(x), rows, replace=False)], rng)

    @staticmethod
    def _unfinished(n: int) -> float:
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, t: int, node: int, depth: int, x: np.ndarray, rng: np.random.Generator) -> None:
        spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 and depth < self.depth else []
        if len(spread) == 0:
            self.path[t, node] = depth + self._unfinished(len(x))
            return
        f = int(rng.choice(spread))
        cut = rng.uniform(x[:, f].min(), x[:, f].max())
        self.feature[t, node], self.cut[t, node] = f, cut
        left = x[:, f] < cut
        self._grow(t, 2 * node + 1, depth + 1, x[left], rng)
        self._grow(t, 2 * node + 2, depth + 1, x[~left], rng)

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t][node]
                go = 2 * node + 1 + (x[rows, np.maximum(f, 0)] >= self.cut[t][node])
                node = np.where(f >= 0, go, node)
            total += self.path[t][node]
        return 2.0 ** (-total / len(self.feature) / max(self.mean, 1e-9))


def _columns(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    return np.column_stack([batch.column(k).to_numpy() for k in names]) if batch.num_rows else np.zeros((0, len(names)))


def _calibrated(stats: DataFrame, labels: DataFrame, forests: list[IsolationForest]) -> tuple[int, float]:
    """The forest and threshold that find most bad labelled rows among those that keep KEEP_GOOD of the good; (0, 2.0) finds none."""
    shared = stats.sparkSession.sparkContext.broadcast(forests)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (forest, names) in enumerate(zip(shared.value, SETS, strict=True)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, i, np.int32)), b.column("quality"), pa.array((forest.score(_columns(b, names)) * BINS).astype(np.int32))], names=["forest", "quality", "bin"])

    marks = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = stats.filter("not base_failed").join(marks, "doc_id").select("quality", *RATIOS)
    bins = known.mapInArrow(scored, "forest int, quality int, bin int").groupBy("forest", "quality", "bin").agg(F.count("*").alias("n")).collect()
    best, found = (0, 2.0), 0.0
    for i in range(len(forests)):
        good, bad = (np.bincount([r["bin"] for r in bins if r["forest"] == i and r["quality"] == q], [r["n"] for r in bins if r["forest"] == i and r["quality"] == q], BINS + 1) for q in (1, 0))
        if not good.sum() or not bad.sum():
            continue
        kept_good, kept_bad = good.cumsum() / good.sum(), bad.cumsum() / bad.sum()
        gain = np.where(kept_good >= KEEP_GOOD, kept_good - kept_bad, -1)
        at = len(gain) - 1 - int(gain[::-1].argmax())
        if gain[at] > found + 1e-9:
            best, found = (i, (at + 1) / BINS), float(gain[at])
    return best


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, COUNTS, base_failed, anomaly, kept.

    base_failed: under 10 words, or over 20 % of the words in repeated 5-word
    windows. Rows that pass are kept unless their anomaly is above a threshold:
    for each of SETS trees grow from about SAMPLE rows picked by a hash, equal
    rows once; over all labelled rows that pass the rules, forest and threshold
    are those that remove most bad rows less good rows (each as a share) among
    those that keep KEEP_GOOD of the good. Without labelled rows of both kinds
    nothing is removed by it. Null texts are empty and fail; ids may repeat or
    be null. An empty table gives no rows; other columns are ignored.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = stable(rule_stats(docs).withColumn("base_failed", failed))
    passed = stats.filter("not base_failed")
    chosen = passed.filter(unit_random("doc_id", *COUNTS, seed=5) < SAMPLE / max(1, passed.count())).select("doc_id", *COUNTS, *RATIOS).distinct()
    sample = chosen.toPandas().sort_values(["doc_id", *COUNTS, *RATIOS])
    if len(sample) < 2:
        return stats.select("doc_id", *COUNTS, "base_failed", F.lit(0.0).alias("anomaly"), (~F.col("base_failed")).alias("kept"))
    forests = [IsolationForest(sample[list(names)].to_numpy(float)) for names in SETS]
    at, threshold = _calibrated(stats, labels, forests)
    forest, names = stats.sparkSession.sparkContext.broadcast(forests[at]), SETS[at]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = ["doc_id", *COUNTS, "base_failed"]
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keep], pa.array(forest.value.score(_columns(b, names)))], names=[*keep, "anomaly"])

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "base_failed boolean", "anomaly double"])
    found = stats.mapInArrow(scored, schema)
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < threshold))

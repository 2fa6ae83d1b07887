"""Quality classifier: a factorisation machine over hashed words, structure and size."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stable, unit_random
from .textstats import RATIOS, text_stats

#: Hashed words, factors, labelled rows that the model is fitted on (as expected), passes over them.
BUCKETS, FACTORS, FIT_ROWS, PASSES = 1 << 16, 8, 8192, 6
STEPS = 8
DENSE = len(RATIOS) * STEPS


class _Buckets(dict):
    def __missing__(self, w: bytes) -> int:
        b = zlib.crc32(w) % BUCKETS
        if len(self) < 300_000:
            self[w] = b
        return b


def _sparse(text: str | None, bucket_of: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Ids and values: words by their bucket with a unit-length log count, statistics by interval, as 1."""
    words, _, ratios = text_stats(text)
    ids = np.empty(0, np.int64)
    vals = np.empty(0)
    if words:
        count = np.bincount(np.fromiter(map(bucket_of.__getitem__, words), np.int64, len(words)), minlength=0)
        ids = np.flatnonzero(count)
        vals = np.log1p(count[ids])
        vals /= np.sqrt((vals * vals).sum())
    # logs and lengths by unit steps, shares by halving steps from 1/2 down
    step = [min(STEPS - 1, int(r)) if i in (0, 1, 9) else STEPS - 1 - min(STEPS - 1, int(-np.log2(max(r, 2.0**-STEPS)))) for i, r in enumerate(ratios)]
    return np.concatenate([ids, BUCKETS + np.arange(len(ratios)) * STEPS + step]), np.concatenate([vals, np.ones(len(ratios))])


class FactorisationMachine:
    """w0 + sum w_i x_i + the sum over pairs of <v_i, v_j> x_i x_j, the last as half of (square of sums less sum of squares)."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(BUCKETS + DENSE)
        self.v = rng.normal(0, 0.02, (BUCKETS + DENSE, FACTORS))

    def raw(self, ids: np.ndarray, vals: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows that lie one behind the other; every row has some id."""
        xv = self.v[ids] * vals[:, None]
        s = np.add.reduceat(xv, starts)
        q = np.add.reduceat(xv * xv, starts)
        return self.w0 + np.add.reduceat(self.w[ids] * vals, starts) + 0.5 * (s * s - q).sum(1), s

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, passes: int = PASSES, rate: float = 0.1, decay: float = 1e-4, seed: int = 4) -> None:
        """Logistic loss by AdaGrad over small batches."""
        rng = np.random.default_rng(seed)
        gw, gv, g0 = np.full(self.w.shape, 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        p = min(max(y.mean(), 0.01), 0.99)
        self.w0 = float(np.log(p / (1 - p)))
        for _ in range(passes):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), 64):
                batch = order[at : at + 64]
                ids, vals = (np.concatenate([rows[i][k] for i in batch]) for k in (0, 1))
                sizes = np.array([len(rows[i][0]) for i in batch])
                z, s = self.raw(ids, vals, np.concatenate([[0], sizes.cumsum()[:-1]]))
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
                e = np.repeat(err, sizes)
                seen, back = np.unique(ids, return_inverse=True)
                dw = np.bincount(back, e * vals, len(seen)) + decay * self.w[seen]
                each = (e * vals)[:, None] * (np.repeat(s, sizes, 0) - self.v[ids] * vals[:, None])
                dv = np.column_stack([np.bincount(back, each[:, f], len(seen)) for f in range(FACTORS)]) + decay * self.v[seen]
                gw[seen] += dw * dw
                gv[seen] += dv * dv
                g0 += err.sum() ** 2
                self.w[seen] -= rate * dw / np.sqrt(gw[seen])
                self.v[seen] -= rate * 0.3 * dv / np.sqrt(gv[seen])
                self.w0 -= rate * err.sum() / np.sqrt(g0)

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        sizes = np.array([len(r[0]) for r in rows])
        z, _ = self.raw(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.concatenate([[0], sizes.cumsum()[:-1]]))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bucket_of = _Buckets()
    for b in batches:
        rows = [_sparse(t.as_py(), bucket_of) for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([i.astype("<i4").tobytes() for i, _ in rows], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary()), b.column(1), b.column(2).cast(pa.int64())], names=["ids", "vals", "quality", "doc_id"])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> FactorisationMachine | None:
    """Model from about fit_rows labelled ids that aren't held out, those with a small hash; None without both labels.

    An id with several labels counts with the smallest, one with several texts
    with that of the smallest hash.
    """
    marks = stable(labels.filter(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality")))
    chosen = stable(marks.filter(unit_random("doc_id", seed=9) < fit_rows / max(1, marks.count())))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality", "doc_id").mapInArrow(_features, "ids binary, vals binary, quality double, doc_id long")
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("ids", "vals").alias("h"), "ids", "vals", "quality")).alias("x"))
    got = one.select("doc_id", "x.ids", "x.vals", "x.quality").toPandas()
    y = got["quality"].to_numpy(float)
    if len(set(y)) < 2:
        return None
    order = np.argsort([zlib.crc32(i + v) for i, v in zip(got["ids"], got["vals"], strict=True)], kind="stable")
    data = [(np.frombuffer(got["ids"].iloc[k], "<i4").astype(np.int64), np.frombuffer(got["vals"].iloc[k], "<f4").astype(float)) for k in order]
    model = FactorisationMachine()
    model.fit(data, y[order])
    return model


def _scorer(session: SparkSession, model: FactorisationMachine):
    """Column function: the score of a text."""
    shared = session.sparkContext.broadcast((model.w0, model.w.astype(np.float32), model.v.astype(np.float32)))

    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = FactorisationMachine.__new__(FactorisationMachine)
        m.w0, m.w, m.v = shared.value
        bucket_of = _Buckets()
        for t in texts:
            s = [m.score([_sparse(x.as_py(), bucket_of) for x in t.slice(k, 64)]) for k in range(0, len(t), 64)]
            yield pa.array(np.concatenate([np.zeros(0), *s]))

    return F.arrow_udf(score, "double")


def score_column(docs: DataFrame, labels: DataFrame) -> Column:
    """The score of column text, by a model fitted on docs and labels; with labels of one kind only, that kind, with none 0.5."""
    model = fit(docs, labels)
    if model is None:
        kind = labels.filter(~held_out()).agg(F.avg("quality")).first()[0]
        return F.lit(0.5 if kind is None else float(kind))
    return _scorer(docs.sparkSession, model)(F.col("text"))


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold) of every row of docs (doc_id, text).

    Inputs of a score are the words, the statistics of the text's structure and
    its size: never labels, lang, source or id. Null and empty texts are scored
    by their statistics. With labels of one kind only, or none, every score is
    that kind (or 0.5). Ids may repeat or be null (then not held out). An empty
    table gives no rows; other columns are ignored.
    """
    out = docs.select(F.col("doc_id").cast("long"), score_column(docs, labels).alias("score"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_poor(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs without the rows that the classifier rejects, each by its own text, in one pass.

    Null and repeated ids, null and empty texts, and any other columns are no
    special case: a row stays if its score reaches the threshold.
    """
    return docs.filter(score_column(docs, labels) >= threshold)

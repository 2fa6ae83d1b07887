"""A selector model for each decision time, fitted on the times before it, with rolling ranks where there are too few."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stable
from .scores import rank_weights, rolling_rank_weights_at

TREES, DEPTH, RATE, LEAF_ROWS, SHARE, BINS = 60, 3, 0.05, 8, 0.9, 64
LAST_TIMES, LEAST_TIMES = 512, 48
#: Decisions that share one read of the times before them.
CHUNK = 16


class BoostedTrees:
    """Least-squares boosting of trees of DEPTH levels over binned columns; each tree sees SHARE of the rows and of the columns."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 42) -> None:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.start, self.trees = float(y.mean()), []
        rng, n, width = np.random.default_rng(seed), len(y), x.shape[1]
        bins, left = self._binned(x), y - self.start
        for _ in range(TREES):
            rows = np.sort(rng.permutation(n)[: max(1, round(SHARE * n))])
            cols = np.sort(rng.permutation(width)[: max(1, round(SHARE * width))])
            tree = self._grown(bins[np.ix_(rows, cols)], left[rows], cols)
            self.trees.append(tree)
            left = left - self._values(tree, bins)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], 1)

    @staticmethod
    def _grown(bins: np.ndarray, left: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Columns and cuts of the inner nodes, level by level, and the values of the leaves; a node that can't split sends all to the left."""
        inner = (1 << DEPTH) - 1
        column, cut = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
        node, width = np.zeros(len(left), np.int64), bins.shape[1]
        for level in range(DEPTH):
            nodes, first = 1 << level, (1 << level) - 1
            cell = ((node - first)[:, None] * width + np.arange(width)) * BINS + bins
            shape = (nodes, width, BINS)
            count = np.bincount(cell.ravel(), minlength=nodes * width * BINS).reshape(shape).cumsum(2)
            total = np.bincount(cell.ravel(), np.repeat(left, width), nodes * width * BINS).reshape(shape).cumsum(2)
            n, s = count[:, :1, -1:], total[:, :1, -1:]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = total**2 / count + (s - total) ** 2 / (n - count) - s**2 / n
            gain = np.where((count >= LEAF_ROWS) & (n - count >= LEAF_ROWS), gain, -np.inf).reshape(nodes, -1)
            best = gain.argmax(1)
            good = gain[np.arange(nodes), best] > 1e-15
            at = first + np.flatnonzero(good)
            column[at], cut[at] = cols[best[good] // BINS], best[good] % BINS
            own = np.searchsorted(cols, column[node])
            goes = bins[np.arange(len(left)), np.minimum(own, width - 1)] > cut[node]
            node = 2 * node + 1 + goes
        leaf = node - inner
        n, s = np.bincount(leaf, minlength=inner + 1), np.bincount(leaf, left, inner + 1)
        return column, cut, RATE * s / np.maximum(n, 1)

    @staticmethod
    def _values(tree: tuple[np.ndarray, np.ndarray, np.ndarray], bins: np.ndarray) -> np.ndarray:
        column, cut, values = tree
        node = np.zeros(len(bins), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (bins[np.arange(len(bins)), column[node]] > cut[node])
        return values[node - len(column)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins = self._binned(x)
        return self.start + sum(self._values(t, bins) for t in self.trees)


def _design(features: np.ndarray, selectors: int) -> np.ndarray:
    """One row for each time and selector: the time's features, the selector's index and its one-hot."""
    one = np.eye(selectors)
    wide = np.repeat(features, selectors, 0)
    return np.hstack([wide, np.tile(np.arange(selectors)[:, None], (len(features), 1)), np.tile(one, (len(features), 1))])


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def model_scores(rows: DataFrame, decisions: DataFrame, features: list[str], selectors: list[str], last: int = LAST_TIMES, least: int = LEAST_TIMES) -> DataFrame:
    """(as_of, selector, ord, score, trained_times) of decisions (as_of, features) by a model of the `last` times of rows (ts, features, returns map) before each.

    A decision with under `least` times before it, or whose returns there are all
    one value, gets no row. An absent return and a value that isn't finite are 0;
    columns are in sorted order. Times are numbered once; CHUNK decisions that
    follow each other are one group, which reads the times before them by number:
    CHUNK + last of them at most, however long the history.
    """
    names = sorted(features)
    x = F.array(*map(_finite, names)).alias("x")
    y = F.array(*[F.coalesce(_clean(F.col("returns")[s]), F.lit(0.0)) for s in selectors]).alias("y")
    times = rows.select("ts", x, y).withColumn("seq", F.row_number().over(Window.orderBy("ts")))
    marks = times.select(F.col("ts").alias("t"), F.lit(1).alias("has"), F.lit(None).cast("array<double>").alias("x")).unionByName(decisions.select(F.col("as_of").alias("t"), F.lit(0).alias("has"), x))
    known = F.sum("has").over(Window.orderBy("t", "has").rowsBetween(Window.unboundedPreceding, -1))
    asked = marks.withColumn("upto", F.coalesce(known, F.lit(0))).filter("has = 0").withColumn("chunk", F.floor((F.row_number().over(Window.orderBy("t")) - 1) / CHUNK))
    asked = asked.select("chunk", F.col("t").alias("as_of"), "upto", "x")
    reach = asked.groupBy("chunk").agg(F.min("upto").alias("a"), F.max("upto").alias("b")).filter("b > 0")
    past = reach.select(F.col("chunk").alias("part"), F.explode(F.sequence(F.greatest(F.col("a") - last + 1, F.lit(1)), "b")).alias("seq")).join(times, "seq").select("part", "seq", F.col("x").alias("x"), F.col("y").alias("y"))
    size, count = len(selectors), len(names)

    def fit(asked: pd.DataFrame, past: pd.DataFrame) -> pd.DataFrame:
        past, out = past.sort_values("seq"), []
        seq = past["seq"].to_numpy()
        xs, ys = (np.array(past[c].tolist(), float).reshape(len(past), -1) for c in ("x", "y"))
        for r in asked.itertuples():
            own = (seq > r.upto - last) & (seq <= r.upto)
            label = ys[own].ravel()
            if own.sum() < least or len(np.unique(label.round(12))) < 2:
                continue
            model = BoostedTrees(_design(xs[own], size), label)
            found = model.predict(_design(np.array(r.x, float).reshape(1, count), size))
            out += [(r.as_of, s, k, float(v), int(own.sum())) for k, (s, v) in enumerate(zip(selectors, found, strict=True))]
        return pd.DataFrame(out, columns=["as_of", "selector", "ord", "score", "trained_times"])

    kind = "timestamp_ntz" if dict(decisions.dtypes)["as_of"] == "timestamp_ntz" else dict(decisions.dtypes)["as_of"]
    return asked.groupBy("chunk").cogroup(past.groupBy("part")).applyInPandas(fit, f"as_of {kind}, selector string, ord int, score double, trained_times int")


def _clean(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def walk_forward_weights(
    rows: DataFrame, decisions: DataFrame, features: list[str], selectors: list[str], power: float = 2.0, last: int = LAST_TIMES, least: int = LEAST_TIMES, lookback: int = 24,
) -> DataFrame:
    """(as_of, selector, weight, rank, mode, trained_times): rank weights by the model's scores, or by rolling ranks (mode 'fallback') where model_scores() has none."""
    session = rows.sparkSession
    rows, decisions = stable(rows), stable(decisions)
    scored = model_scores(rows, decisions, features, selectors, last, least)
    ranked = rank_weights(stable(scored), ["as_of"], "score", "ord", power).select("as_of", "selector", "weight", "rank", F.lit("model").alias("mode"), "trained_times")
    names = session.createDataFrame(list(enumerate(selectors)), "ord int, selector string")
    ret = F.coalesce(F.element_at("returns", F.col("selector")), F.lit(0.0))
    returns = rows.select("ts", "returns").join(F.broadcast(names), how="cross").select("ts", "selector", "ord", ret.alias("ret"))
    rolled = rolling_rank_weights_at(returns, decisions.select("as_of"), names, lookback, power)
    model = ranked.select("as_of").distinct()
    rest = rolled.join(model, "as_of", "left_anti").select("as_of", "selector", "weight", "rank", F.lit("fallback").alias("mode"), F.lit(0).alias("trained_times"))
    return ranked.unionByName(rest)

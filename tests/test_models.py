"""Selector models that walk forward, and forecasts."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from tickloom.operators import selectors, walk_forward

T = dt.datetime(2024, 1, 1)
at = lambda k: T + dt.timedelta(minutes=30 * k)


def history(spark, n, names, label):
    rows = [(at(k), float(k % 5), float("nan") if k % 7 == 0 else 1.0, {s: label(k, i) for i, s in enumerate(names)}) for k in range(n)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, a double, b double, returns map<string, double>")


def asked(spark, times):
    return spark.createDataFrame([(at(k), float(k % 5), 1.0) for k in times], "as_of timestamp_ntz, a double, b double")


def test_limits_count_times_with_thirty_selectors(spark):
    """48 times before a decision make a model, 47 don't, however many selectors; the newest 512 times are learned from."""
    names = [f"s{i:02d}" for i in range(30)]
    rows = history(spark, 60, names, lambda k, i: 0.1 * (i == 7) + 0.001 * (k % 3))
    out = walk_forward.walk_forward_weights(rows, asked(spark, (0, 5, 47, 48, 60)), ["a", "b"], names).collect()
    modes = {r.as_of: (r.mode, r.trained_times) for r in out}
    assert modes == {at(0): ("fallback", 0), at(5): ("fallback", 0), at(47): ("fallback", 0), at(48): ("model", 48), at(60): ("model", 60)}
    assert len(out) == 5 * 30 and all(abs(sum(r.weight for r in out if r.as_of == t) - 1) < 1e-9 for t in modes)
    assert all(r.selector == "s07" for r in out if r.rank == 1 and r.as_of > at(40))
    assert [r.selector for r in sorted(out, key=lambda r: (r.as_of, r.rank)) if r.as_of == at(5)] == names  # under six times: default order
    long = history(spark, 600, names[:3], lambda k, i: float(k % 2 == i % 2))
    got = walk_forward.model_scores(long, asked(spark, (599, 600)), ["a", "b"], names[:3]).collect()
    assert {r.trained_times for r in got} == {512}


def test_a_model_sees_the_past_only_and_needs_a_varied_label(spark):
    names = ["x", "y"]
    rows = history(spark, 120, names, lambda k, i: float(i == (k // 60) % 2))
    score = lambda r, times: sorted(map(tuple, walk_forward.walk_forward_weights(r, asked(spark, times), ["a", "b"], names).collect()))
    before = score(rows, (55, 60))
    later = rows.withColumn("returns", F.when(F.col("ts") >= at(60), F.map_from_arrays(F.array(F.lit("x"), F.lit("y")), F.array(F.lit(9.0), F.lit(-9.0)))).otherwise(F.col("returns")))
    assert before == score(later, (55, 60))
    same = history(spark, 60, names, lambda k, i: 0.25)
    assert {r[4] for r in score(same, (60,))} == {"fallback"}
    assert {r[1] for r in before if r[3] == 1} == {"x"}


def test_chunks_give_what_single_decisions_give(spark):
    rng = random.Random(3)
    names = ["x", "y", "z"]
    noise = {(k, i): rng.random() for k in range(90) for i in range(3)}
    rows = history(spark, 90, names, lambda k, i: noise[k, i]).repartition(7)
    times = [rng.randrange(40, 100) for _ in range(5)] + [70, 71]
    together = walk_forward.model_scores(rows, asked(spark, sorted(set(times))), ["a", "b"], names).collect()
    alone = [r for t in sorted(set(times)) for r in walk_forward.model_scores(rows, asked(spark, [t]), ["a", "b"], names).collect()]
    assert sorted(map(tuple, together)) == sorted(map(tuple, alone))


def test_trees_fit_steps_with_leaves_of_eight_rows():
    rng = np.random.default_rng(1)
    x = rng.random((400, 5))
    y = np.where(x[:, 2] > 0.5, 1.0, 0.0) + np.where(x[:, 4] > 0.3, 0.5, 0.0)
    model = walk_forward.BoostedTrees(x, y)
    assert np.abs(model.predict(x) - y).mean() < 0.08
    few = walk_forward.BoostedTrees(x[:15], y[:15])
    assert np.allclose(few.predict(x), y[:15].mean(), atol=0.3)  # 15 rows, of which 14 are seen: no two leaves of 8
    assert all((t[1] == walk_forward.BINS).all() for t in few.trees)


def test_rolling_ranks_at_any_time_follow_a_loop(spark):
    from tickloom.operators.scores import rolling_rank_weights_at

    rng = random.Random(4)
    names = ["p", "q", "r"]
    data = {(k, s): rng.randrange(-5, 6) / 4 for k in range(40) for s in names if rng.random() < 0.8}
    times = sorted({k for k, _ in data})
    ret = spark.createDataFrame([(at(k), s, v) for (k, s), v in data.items()], "ts timestamp_ntz, selector string, ret double")
    when = [at(k) for k in (0, 3, 6, 7, 20, 39, 60)] + [at(20) + dt.timedelta(minutes=3)]
    got = rolling_rank_weights_at(ret, spark.createDataFrame([(w,) for w in when], "as_of timestamp_ntz"), spark.createDataFrame(list(enumerate(names)), "ord int, selector string")).collect()
    for w in when:
        past = [k for k in times if at(k) < w][-24:]
        sums = {s: sum(data.get((k, s), 0.0) for k in past) for s in names}
        order = sorted(names, key=lambda s: -sums[s]) if len(past) >= 6 else names
        assert [r.selector for r in sorted(got, key=lambda r: r.rank) if r.as_of == w] == order


def test_absent_selectors_have_label_zero(spark):
    rows = spark.createDataFrame([(at(0), 1.0, {"x": 0.5}), (at(1), float("inf"), {"x": float("nan"), "z": 2.0})], "ts timestamp_ntz, a double, returns map<string, double>")
    got = {(r.ts, r.selector): (r.a, r.selector_index, r.label, r.is_y) for r in selectors.selector_matrix(rows, ["a"], ["x", "y"]).collect()}
    assert got == {(at(0), "x"): (1.0, 0, 0.5, 0.0), (at(0), "y"): (1.0, 1, 0.0, 1.0), (at(1), "x"): (0.0, 0, 0.0, 0.0), (at(1), "y"): (0.0, 1, 0.0, 1.0)}

"""Runs of words against brute force."""

import hashlib
import random
import zlib

import pytest

from tickloom.llm import periodic_runs as R
from tickloom.llm.queries import op11_periodic_runs

SCHEMA = "doc_id long, text string, words string, runs long, g string, p long"


def longest_lyndon_words(x):
    return [max(n for n in range(1, len(x) - i + 1) if all(x[i : i + n] < x[i + k : i + n] for k in range(1, n))) for i in range(len(x))]


def runs_by_periods(x, least_length, least_repeats):
    """All stretches that agree q places on, for each q; of equal stretches that of the smallest q."""
    smallest = {}
    for q in range(1, len(x) // least_repeats + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(least_length, least_repeats * q):
                smallest.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in smallest.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = runs_by_periods(words, 24, 3)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_lyndon_arrays_under_both_orders():
    rng = random.Random(1)
    for _ in range(400):
        x = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(1, 24))]
        for y in (x, [-v for v in x]):
            assert R.lyndon_array(y) == longest_lyndon_words(y)


def test_all_runs_of_small_texts():
    rng = random.Random(2)
    for _ in range(400):
        x = [rng.randrange(rng.randint(1, 3)) for _ in range(rng.randint(1, 30))]
        assert R.runs_of(x) == runs_by_periods(x, 2, 2)


def test_stretches_lose_no_run():
    rng = random.Random(3)
    for _ in range(300):
        words = []
        while len(words) < rng.randint(20, 200):
            words += [b"%d" % rng.randrange(4) for _ in range(rng.randint(1, 12))] * rng.choice([1, 3, 5]) + [b"%d" % rng.randrange(60) for _ in range(rng.randint(0, 20))]
        assert R.word_runs(words) == runs_by_periods(words, 24, 3)
        assert R.word_runs(words, 9, 4) == runs_by_periods(words, 9, 4)


def test_boundaries():
    unit = [b"%d" % k for k in range(8)]
    assert R.word_runs(unit * 3) == [(0, 24, 8)] and R.word_runs(unit * 3 + unit[:3]) == [(0, 27, 8)]
    assert not R.word_runs((unit * 3)[:-1]) and R.word_runs([b"a"] * 24) == [(0, 24, 1)] and not R.word_runs([b"a"] * 23)
    nine = unit + [b"8"]
    assert not R.word_runs((nine * 3)[:-1]) and R.word_runs([b"x", *nine * 3, b"y"]) == [(1, 27, 9)]
    with pytest.raises(ValueError):
        R.find_runs(None, least_repeats=2)


def test_query(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(160):
        words = [rng.choice("ab c de f gé".split(" ")) + str(rng.randrange(9)) for _ in range(rng.randrange(1, 150))]
        if i % 4 == 0:
            words[10:10] = words[:7] * 5
        rows.append((i, rng.choice([" ", "\n", " \t\x0b"]).join(words)))
    long = [str(k % 700) for k in range(40_000)]
    rows += [(200, None), (201, ""), (202, " \n\x0c "), (203, "x"), (204, "a\x1fb c " * 30), (205, " ".join(long)), (None, "a b " * 40), (7, "t " * 30), (7, "t " * 30)]
    spark.createDataFrame([(i, t, "w", 1, "g", 2) for i, t in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    key = lambda r: tuple(map(str, r))
    got = sorted(map(tuple, op11_periodic_runs(spark, str(tmp_path)).collect()), key=key)
    want = [expected(i, t) if i != 205 else None for i, t in rows]
    assert [r for r in got if r[0] != 205] == sorted((w for w in want if w), key=key)
    (r,) = [r for r in got if r[0] == 205]
    assert zlib.crc32(b"205") % 10 and r[1:6] == (1, 0, 40_000, 700, 57_142)
    assert r[7] == hashlib.sha256(" ".join(long[:700]).encode()).hexdigest()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert op11_periodic_runs(spark, str(tmp_path)).count() == 0

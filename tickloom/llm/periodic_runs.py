"""Runs of periodic words: Lyndon arrays by Baier's grouping under both orders, Lyndon roots extended into runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

LEAST_LENGTH, LEAST_REPEATS = 24, 3
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, by phase one of Baier's suffix sorter.

    Places start in groups by their first rank. Groups are taken from the highest
    down. Each place of a group looks for the nearest earlier place that is in no
    group taken so far; the earlier place's group splits by how many places found
    it, each part moves above the rest, and its context grows by that many copies
    of the taken group's. A taken group's context is its places' Lyndon word.
    """
    n = len(ranks)
    places: dict[int, list[int]] = {}
    for i, r in enumerate(ranks):
        places.setdefault(r, []).append(i)
    members = [places[r] for r in sorted(places)]
    size = [1] * len(members)
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    above[-1] = -1
    group = [0] * n
    for g, held in enumerate(members):
        for i in held:
            group[i] = g
    out, back = [1] * n, list(range(n + 1))  # back[i + 1]: a way to the nearest place up to i that isn't taken, 0 for none
    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = []
        m = size[g]
        for i in own:
            out[i] = m
            back[i + 1] = i
        found: dict[int, int] = {}
        for k in own:
            while back[k] != k:
                back[k] = k = back[back[k]]
            if k:
                found[k - 1] = found.get(k - 1, 0) + 1
        parts: dict[tuple[int, int], list[int]] = {}
        for j, times in found.items():
            parts.setdefault((group[j], times), []).append(j)
        for h, times in sorted(parts, reverse=True):
            new, top = len(members), above[h]
            members.append(parts[h, times])
            size.append(size[h] + times * m)
            below.append(h)
            above.append(top)
            above[h] = new
            below[top] = new
            for j in members[new]:
                group[j] = new
        g = below[g]
    return out


class Extensions:
    """Longest common extensions of places in x, both ways and exact, from names of all windows of 1, 2, 4, ... values."""

    def __init__(self, x: np.ndarray) -> None:
        self.n, self.names = len(x), [x]
        while 2 << (len(self.names) - 1) <= self.n:
            last, w = self.names[-1], 1 << (len(self.names) - 1)
            self.names.append(np.unique(last[:-w] * (last.max() + 1) + last[w:], return_inverse=True)[1])

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Values from i and from j on that agree, i < j <= n."""
        got = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, last = self.names[k], len(self.names[k]) - 1
            a, b = i + got, j + got
            same = (b <= last) & (names[np.minimum(a, last)] == names[np.minimum(b, last)])
            got += same.astype(np.int64) << k
        return got

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Values before i and before j that agree, i < j <= n."""
        got = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a, b = i - got - (1 << k), j - got - (1 << k)
            same = (a >= 0) & (self.names[k][np.maximum(a, 0)] == self.names[k][np.maximum(b, 0)])
            got += same.astype(np.int64) << k
        return got


def runs_of(ids: list[int], least_length: int = 2, least_repeats: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs with least_length or more values and least_repeats (2 at least) or more periods, sorted by start and period.

    A run's Lyndon root, under one of the two orders of the values, is the longest
    Lyndon word at some place of the run; so each place's longest Lyndon word under
    either order, extended both ways as far as values a period apart agree, gives
    every run, with its smallest period.
    """
    if len(ids) < max(2, least_length):
        return []
    x = np.asarray(ids, np.int64)
    ext, at, found = Extensions(np.unique(x, return_inverse=True)[1]), np.arange(len(ids)), []
    for order in (ids, [-r for r in ids]):
        p = np.asarray(lyndon_array(order), np.int64)
        start = at - ext.backward(at, at + p)
        length = at + p + ext.forward(at, at + p) - start
        good = (length >= least_length) & (length >= least_repeats * p)
        found.append(np.stack([start[good], length[good], p[good]], 1))
    return [tuple(r) for r in sorted({tuple(r) for r in np.concatenate(found).tolist()}, key=lambda r: (r[0], r[2]))]


def repeated_stretches(words: list[bytes], least_length: int) -> list[tuple[int, int]]:
    """Stretches [from, to) that cover every run of 3 periods or more and least_length words or more.

    Such a run repeats, one period on, two thirds of its words or more, so each
    of its words lies in a window of 2 * least_length / 3 words that occurs again.
    Windows that share a hash by chance only lengthen the stretches.
    """
    w = least_length * 2 // 3
    n = len(words) - w + 1
    if len(words) < least_length:
        return []
    h, width = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), 1
    while width < w:  # hashes of windows of `width` words; the last step overlaps
        step = min(width, w - width)
        h = h[:-step] * _ODD + (h[step:] ^ (h[step:] >> np.uint64(29)))
        width += step
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return []
    edge = np.zeros(len(words) + 1, np.int64)
    again = np.flatnonzero(np.isin(h, twice))
    np.add.at(edge, again, 1)
    np.add.at(edge, again + w, -1)
    inside = np.concatenate([[0], (edge[:n + w - 1].cumsum() > 0).astype(np.int8), [0]])
    turn = np.flatnonzero(np.diff(inside))
    return [(a, b) for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True) if b - a >= least_length]


def word_runs(words: list[bytes], least_length: int = LEAST_LENGTH, least_repeats: int = LEAST_REPEATS) -> list[tuple[int, int, int]]:
    """runs_of() words, searched where repeated_stretches() can hold one; least_repeats is 3 at least."""
    out = []
    for a, b in repeated_stretches(words, least_length):
        ids: dict[bytes, int] = {}
        out += [(a + s, n, p) for s, n, p in runs_of([ids.setdefault(w, len(ids)) for w in words[a:b]], least_length, least_repeats)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """words without those that some run has after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return [words[i] for i in np.flatnonzero(~gone)]


def find_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_repeats: int = LEAST_REPEATS) -> DataFrame:
    """doc_id, runs array<struct<start, length, period>> by start and period, collapsed: the text without repeats, of each row of docs (doc_id, text).

    Words are runs of characters other than white space, numbered from 0. A run
    is a stretch of words with smallest period `period`, of least_length words and
    least_repeats (3 at least) periods or more, that no neighbour extends.
    collapsed joins by one space the words that no run has after its first period.
    Null and empty texts have no runs and collapse to ''; null and repeated ids
    are rows as any other, an empty table gives none, other columns are ignored.
    A text is held by one task, with memory in proportion to its length; time
    grows as n log n.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, texts = [], []
            for text in b.column(1).to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").split()
                runs = word_runs(words, least_length, least_repeats)
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                texts.append(b" ".join(collapsed(words, runs)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(RUN)), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    if least_repeats < 3:
        raise ValueError("least_repeats is 3 at least")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_planted_period(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in which a tenth of the texts, chosen and shaped by crc32 of the id, end in a period: words i >= a become word a + (i - a) % p.

    A null id's text stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    x = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words")
    a = F.pmod("g", n)
    p = 1 + F.floor((n - a) / (3 + F.pmod("g", F.lit(8)))).cast("int")
    x = x.withColumn("a", F.when(n > 0, a.cast("int"))).withColumn("p", F.when(n > 0, p))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p")))
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", place(i)))
    return x.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def strongest(runs: Column) -> Column:
    """The run of greatest exact length / period, the first of equals; null without runs."""
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.when(F.size(runs) > 0, F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(more(a, b), b).otherwise(a)))

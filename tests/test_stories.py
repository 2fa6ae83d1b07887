"""Stories against loops over all pairs, hot titles and long chains."""

import datetime as dt
import random
import re
import time

import pandas as pd
from pyspark.sql import functions as F

from tickloom.operators import stories

T = dt.datetime(2024, 1, 1)
SCHEMA = "news_id string, source string, ts timestamp_ntz, title string, url string, payload_hash string"


def score(a, b, df):
    """Points of two items (source, title, url, payload) of words without endings."""
    if a[1] == b[1]:
        return 0.0
    if (a[4] and a[4] == b[4]) or (a[5] and a[5] == b[5]):
        return 100.0
    p, q = (set(w for w in x[3].split() if len(w) >= 3) for x in (a, b))
    m, n = (set(re.findall(r"\d+(?:[,.]\d+)?", x[3])) for x in (a, b))
    signal = lambda w, k: len([t for t in w if not t.isdigit()]) >= 3 or len([t for t in w if not t.isdigit()]) >= 2 and k
    if not (p and q and signal(p, m) and signal(q, n)):
        return 0.0
    c = p & q
    j, o = len(c) / len(p | q), len(c) / min(len(p), len(q))
    same = [w for w in a[3].split() if len(w) >= 3] == [w for w in b[3].split() if len(w) >= 3]
    s = 100 * same + 25 * (len(c) >= 3) + 25 * (sum(df[w] <= 8 for w in c) >= 2) + (30 if j >= 0.45 else 18 if j >= 0.32 else 0) + (20 if o >= 0.65 else 10 if o >= 0.5 else 0)
    return float(s + 10 * bool(m & n) - 20 * bool(m and n and not m & n and len(c) < 4))


def replay(rows):
    """Every item against all earlier ones within the hour, in order of time and id."""
    rows = sorted(rows, key=lambda r: (r[2], r[0]))
    words = [set(w for w in r[3].split() if len(w) >= 3) for r in rows]
    df = {w: sum(w in x for x in words) for w in set().union(*words)}
    story, sources, first, pairs, recent = {}, {}, {}, {}, []
    for r in rows:
        recent = [c for c in recent if (r[2] - c[2]).total_seconds() <= 3600]
        best = None
        for c in recent:
            s = score(r, c, df)
            if s < 70:
                continue
            pairs[min(r[0], c[0]), max(r[0], c[0])] = s
            k = story[c[0]]
            if r[1] not in sources[k] and (best is None or s > best[0] or (s == best[0] and first[k] < best[1])):
                best = (s, first[k], k)
        k = best[2] if best else r[0]
        story[r[0]] = k
        sources.setdefault(k, set()).add(r[1])
        first.setdefault(k, r[2])
        recent.append(r)
    sizes = pd.Series(story).value_counts()
    return pairs, {i: k for i, k in story.items() if sizes[k] > 1}


def some_items(seed, n, step):
    rng = random.Random(seed)
    vocab = [a + b + "wdx" for a in "abcdfghk" for b in "klmnt"]
    base = [" ".join(rng.sample(vocab, 5)) for _ in range(6)]
    rows = []
    for i in range(n):
        words = rng.choice(base).split()
        if rng.random() < 0.5:
            words[rng.randrange(5)] = rng.choice(vocab)
        title = " ".join(words[: rng.choice([5, 5, 5, 2, 0])] + rng.choice([[], [], ["12"], ["7", "2024"]]))
        url, payload = rng.choice(["", None, "", f"u{rng.randrange(9)}"]), rng.choice([None, "", f"p{rng.randrange(25)}"])
        rows.append((f"n{rng.randrange(10**6):06}", f"s{rng.randrange(4)}", T + dt.timedelta(seconds=step * (i // 2 * 2)), title, url, payload))
    return list({r[0]: r for r in rows}.values())


def test_stories_against_a_loop(spark):
    for seed, step in ((1, 500), (2, 60), (3, 2500)):
        rows = some_items(seed, 90, step)
        pairs, want = replay(rows)
        r = stories.stable(stories.story_records(spark.createDataFrame(rows, SCHEMA)))
        links = stories.stable(stories.title_links(r))
        assert {(x.a, x.b): x.score for x in stories.item_pairs(r, links).collect()} == pairs
        assert {x.news_id: x.story_id for x in stories.assign_stories(r, links).collect()} == want


def test_ten_thousand_equal_titles_in_an_hour_make_no_pairs(spark):
    """Equal titles, of many payloads or of one, are one title: one link, stories as by a loop over sources."""
    for payload in (F.col("id").cast("string"), F.lit("same"), F.lit(None).cast("string")):
        x = spark.range(10_000).select(
            F.format_string("n%05d", "id").alias("news_id"), F.concat(F.lit("s"), (F.col("id") * 7919 % 20).cast("string")).alias("source"), (F.lit(T).cast("timestamp_ntz") + F.make_interval(secs=(F.col("id") / 3).cast("decimal(18,6)"))).alias("ts"),
            F.lit("alpha bravo charlie delta").alias("title"), F.lit("").alias("url"), payload.alias("payload_hash"),
        )
        r = stories.stable(stories.story_records(x))
        links = stories.stable(stories.title_links(r))
        assert links.count() == 1
        start = time.time()
        got = stories.assign_stories(r, links).collect()
        took = time.time() - start
        # each source comes once in twenty items, in the same order: the k-th twenty are the k-th story
        assert len(got) == 10_000 and all(g.story_id == f"n{int(g.news_id[1:]) // 20 * 20:05}" for g in got) and took < 120


def test_equal_texts_of_other_days_are_other_components(spark):
    rows = [(f"n{d}{k}", f"s{k}", T + dt.timedelta(days=d, minutes=k), "alpha bravo charlie delta", "", "p") for d in range(20) for k in range(3)]
    r = stories.stable(stories.story_records(spark.createDataFrame(rows, SCHEMA)))
    named = stories.named_records(r)
    assert stories._episodes(named).select("node").distinct().count() == 40
    got = {x.news_id: x.story_id for x in stories.assign_stories(r, stories.title_links(r)).collect()}
    assert got == {i: f"n{i[1:-1]}0" for i, *_ in rows}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(6)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(300)]
    star = [("z", f"b{i:03}") for i in range(50)]
    loose = [(f"d{rng.randrange(60):02}", f"d{rng.randrange(60):02}") for _ in range(50)]
    rounds, kept = [], stories.stable
    stories.stable = lambda df: rounds.append(1) or kept(df)
    try:
        got = {r.node: r.root for r in stories.components(spark.createDataFrame(chain + star + loose, "a string, b string")).collect()}
    finally:
        stories.stable = kept
    want = {}
    for a, b in chain + star + loose:
        want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(400):
        for a, b in chain + star + loose:
            want[a] = want[b] = min(want[a], want[b])
    assert set(got) == {n for a, b in chain + star + loose if a != b for n in (a, b)}
    groups = {(got[n], want[n]) for n in got}
    assert len(groups) == len({g for g, _ in groups}) == len({w for _, w in groups}) and all(want[r] == w for r, w in groups)
    assert len(rounds) < 45 and stories.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_a_chain_holds_a_window_only():
    rng = random.Random(7)
    rows = [(f"n{i:04}", f"s{rng.randrange(5)}", i * 900.0, f"t{i}", None, None, "root", [f"t{j}" for j in range(max(0, i - 4), i + 5)], [100.0] * len(range(max(0, i - 4), i + 5))) for i in range(400)]
    frame = pd.DataFrame(rows, columns=["news_id", "source", "t", "title", "url", "payload_hash", "root", "others", "scores"])
    run, most, got = stories._greedy(frame[i : i + 7] for i in range(0, 400, 7)), 0, []
    for part in run:
        window = run.gi_frame.f_locals["window"]
        most = max(most, len(window.recent), len(window.by), len(window.sources))
        got.append(part)
    assert most <= 6 and len(pd.concat(got)) == 400

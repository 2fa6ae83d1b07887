"""Corpus operators against brute force on small fixtures, with nulls, ties, repeats and empty tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import common, exact_dedup, language, mixing, near_dedup, packing, pii, quality_model, quality_rules, secrets, sharding, textstats
from tickloom.llm.components import components, joined

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, key string, size long, kept boolean"
WORDS = "the of and with house river stone light paper cloud table green small under over again never many these those".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ly", "ing", "s"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Prose with exact and near copies, null and odd texts, a hot source, repeated lines, and columns with clashing names."""
    rng = random.Random(3)
    out = [prose(rng, rng.randrange(1, 120)) for _ in range(60)]
    base = prose(rng, 90)
    out += [base, base.upper(), base + " end", base.replace("the", "teh", 1), "the " + base]
    chain = base.split()
    for k in range(6):
        chain = chain[4:] + prose(rng, 4).split()
        out.append(" ".join(chain))
    out += [None, "", " \n\t ", "x", "one two three four", "ONE two three four", prose(rng, 3000), "line a b\n" * 30, "<|endoftext|> a  b \n c ", "é " * 50, "4111 1111 1111 1111 a@b.co +1 (988) 555-2485 10.0.0.1"]
    data = [(i, t, ["en", "de", None][i % 3], None if i % 17 == 0 else "s0" if i % 2 else f"s{i % 7}", len(t or ""), 1, "k", 9, True) for i, t in enumerate(out)]
    return data + data[60:62]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], int(r[0] % 5 != 0), 0) for r in rows], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return (t or "").encode().lower().decode()


def test_exact_dedup(docs, rows):
    got = exact_dedup.exact_dedup(docs, prefix_chars=8, hash_all=True).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(lower(r[1]), []).append(r[0])
    text = {r[0]: lower(r[1]) for r in rows}
    for r in got:
        g = groups[text[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(g), len(g), r.doc_id == max(g), hashlib.sha256(text[r.doc_id].encode()).hexdigest())
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(lower(r.text) for r in kept.collect()) == sorted(groups)


def brute_links(rows):
    sets = []
    for r in rows:
        w = lower(r[1]).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sets, [least[find(i)] for i in range(len(rows))]


def check_near(spark, rows, docs):
    sets, want = brute_links(rows)
    expected = sorted((r[0], len(s), c, r[0] == c) for r, s, c in zip(rows, sets, want))
    assert sorted(map(tuple, near_dedup.near_duplicates(docs).collect())) == expected


def test_near_dedup(spark, rows, docs):
    check_near(spark, rows, docs)
    kept = near_dedup.drop_near_copies(docs)
    _, want = brute_links(rows)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_block_pairs_lose_no_link():
    """Two blocks of sets within a sketch: every pair at the similarity, across components, is found once."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    base = rng.choice(1 << 30, 120, replace=False)
    sets = [set(rng.choice(base, rng.integers(80, 120), replace=False).tolist()) for _ in range(60)]
    block, root = [i % 2 for i in range(60)], [i // 3 for i in range(60)]
    found = []

    def joined(edges):
        """Groups of roots that the edges connect."""
        groups = {r: {r} for r in root}
        for p, q in map(tuple, edges):
            both = groups[p] | groups[q]
            groups.update(dict.fromkeys(both, both))
        return {frozenset(g) for g in groups.values()}

    linked = {(i, j) for i in range(60) for j in range(i) if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]) and root[i] != root[j]}
    for x, y in ((0, 0), (0, 1), (1, 1)):
        at = [i for i in range(60) if block[i] in (x, y)]
        table = pa.table({"cid": pa.array(at, pa.int64()), "n": pa.array([len(sets[i]) for i in at], pa.int64()), "root": pa.array([root[i] for i in at], pa.int64()),
                          "block": pa.array([block[i] for i in at], pa.int32()), "sketch": pa.array([sorted(sets[i]) for i in at], pa.list_(pa.int32())), "earlier": pa.array([[i] for i in at], pa.list_(pa.int64()))})
        out = near_dedup._block_pairs((pa.scalar(1), pa.scalar(x, pa.int32()), pa.scalar(y, pa.int32())), table).to_pylist()
        found += [tuple(sorted((r["a"], r["b"]))) for r in out]
        # members 0 to 9 were in one list before: their pairs are left to it, all others are found
        before = table.set_column(5, "earlier", pa.array([[5, 3 + i] if i < 10 else [100 + i] for i in at], pa.list_(pa.int64())))
        later = near_dedup._block_pairs((pa.scalar(1), pa.scalar(x, pa.int32()), pa.scalar(y, pa.int32())), before).to_pylist()
        assert later == [r for r in out if max(r["a"], r["b"]) >= 10]
        few = near_dedup._block_forest((pa.scalar(1), pa.scalar(x, pa.int32()), pa.scalar(y, pa.int32())), table).to_pylist()
        assert joined(frozenset((root[r["a"]], root[r["b"]])) for r in few) == joined(frozenset((root[r["a"]], root[r["b"]])) for r in out) and len(few) < 20
    assert linked and len(found) == len(set(found))
    assert {(j, i) for i, j in linked} <= set(found)


def test_near_dedup_long_lists(spark):
    """A large group of near copies and a passage that most texts share, so lists are long and stay open."""
    rng = random.Random(8)
    passage, base = prose(rng, 60), [f"w{i}" for i in range(80)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(80)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(8, 60)))) for i in range(90)]
    rng.shuffle(rows)
    check_near(spark, rows, spark.createDataFrame(rows, "doc_id long, text string"))


def test_null_and_repeated_ids_are_judged_by_row(spark):
    long, far = prose(random.Random(1), 40), prose(random.Random(2), 40)
    x, y, alone, shout = "same words in every one of these texts", "quite another text that has its own words", "a text alone without any copies at all", "!!! ??? $$$"
    rows = [(1, x), (2, y), (None, x), (None, y), (None, y), (None, alone), (None, alone), (3, long), (None, long + " end"), (3, far), (4, far.upper()), (4, far), (5, None), (None, None), (6, ""), (7, alone + " x y z u v w a b c d e f g h")]
    data = spark.createDataFrame([(i, t, "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, th long")
    left = sorted(exact_dedup.drop_copies(data).select("doc_id", "text").collect(), key=str)
    exact, want = {}, []
    for i, t in rows:
        exact.setdefault(lower(t), []).append((i, t))
    for group in exact.values():
        top = max((i for i, _ in group if i is not None), default=None)
        want.append((top, lower(group[0][1])))
    assert sorted([(i, lower(t)) for i, t in left], key=str) == sorted(want, key=str)
    near = near_dedup.drop_near_copies(data).select("doc_id", "text", "th").collect()
    assert sorted([(i, t) for i, t, _ in near if (t or "").strip()], key=str) == sorted([(1, x), (2, y), (None, alone), (3, long), (3, far), (7, rows[-1][1])], key=str)
    assert sum(not (t or "").strip() for _, t, _ in near) == 3
    marks = spark.createDataFrame([(i, int(i % 2)) for i in range(100, 400)], "doc_id long, quality int")
    taught = spark.createDataFrame([(i, prose(random.Random(i), 30) if i % 2 else shout * 20) for i in range(100, 400)] + [(None, shout * 20), (500, shout * 20), (500, prose(random.Random(0), 30)), (None, prose(random.Random(7), 30))], "doc_id long, text string")
    kept = quality_model.drop_poor(taught, marks).collect()
    assert all(r.text != shout * 20 for r in kept) and sum(r.doc_id is None for r in kept) == 1 and sum(r.doc_id == 500 for r in kept) == 1


def check_roots(found, least):
    """One row an id but for roots, and the same groups as `least` (id to the smallest of its component)."""
    got = [(r.id, r.root) for r in found.collect()]
    named = dict(got)
    assert len(named) == len(got) and not set(named) & set(named.values())
    groups = {}
    for i in least:
        groups.setdefault(named.get(i, i), set()).add(i)
    assert {frozenset(g) for g in groups.values()} == {frozenset(i for i in least if least[i] == x) for x in set(least.values())}


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(30)] + [(7, 7)]
    root = {x: x for l in links for x in l if l[0] != l[1]}
    for _ in range(60):
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    rng.shuffle(links)
    found = components(spark.createDataFrame(links, "a long, b long"))
    check_roots(found, root)
    # links between components are added to those found before
    more = [(3, 120), (45, 46), (45, 45), (200, 201)]
    for _ in range(60):
        for a, b in links + more:
            if a != b:
                root[a] = root[b] = min(root.get(a, a), root.get(b, b))
    check_roots(joined(found, spark.createDataFrame(more, "a long, b long")), root)


def test_mixing(docs, rows):
    out = mixing.with_copies(docs).collect()
    again = mixing.with_copies(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.copies) for r in out) == sorted((r.doc_id, r.copies) for r in again)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").encode().split())
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, total = {}, set(order), sum(sizes.values())
    while open_:
        level = (total - sum(target.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] for s in over} or {s: level * w[s] for s in open_}
        open_ -= over or open_
    taken = dict.fromkeys(order, 0)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.copies * r["size"] <= 3 * r["size"]
        taken[r.source] += r.copies * r["size"]
    assert all(taken[s] <= target[s] + 1 and taken[s] >= 0.8 * target[s] - 5 for s in order)
    assert mixing.mix(docs).columns == docs.columns


def test_mixing_against_a_replay(spark):
    """Inclusion odds by size, and the documents that a plain Pareto replay takes in two passes."""
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice([1, 2, 5, 30, 200, 900])), "ab"[i % 9 == 0]) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.with_copies(docs, seed=3).collect()}
    u = {r.doc_id: r.u for r in docs.select("doc_id", common.unit_random("doc_id", seed=3).alias("u")).collect()}
    size = {i: len(t.split()) for i, t, _ in rows}
    for source in "ab":
        ids = [i for i, _, s in rows if s == source]
        target = got[ids[0]].target
        weight = {i: 2.0 ** (-int(np.floor(2 * np.log2(size[i]))) * mixing.DAMPING / 2) for i in ids}
        lo, hi = 0.0, 1e6
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(size[i] * min(3.0, mid * weight[i]) for i in ids) < target else (lo, mid)
        copies = {i: min(3.0, lo * weight[i]) for i in ids}
        base = {i: int(copies[i] + 1e-7) for i in ids}
        p = {i: max(0.0, copies[i] - base[i]) for i in ids}
        left = round(sum(p[i] * size[i] for i in ids))
        order = sorted((i for i in ids if p[i] > 1e-6), key=lambda i: (u[i] / (1 - u[i])) / (p[i] / (1 - p[i])))
        taken = set()
        for _ in range(2):
            run, room = 0, left
            for i in [i for i in order if i not in taken and size[i] <= left]:
                run += size[i]
                if run > room:
                    break
                taken.add(i)
            left = round(sum(p[i] * size[i] for i in ids)) - sum(size[i] for i in taken)
        assert len({round(x, 6) for x in p.values()}) > 2 or source == "b"
        assert {i: base[i] + (i in taken) for i in ids} == {i: got[i].copies for i in ids}
        assert abs(sum(got[i].copies * size[i] for i in ids) - target) < 0.01 * target + 3


def test_sharding(docs, rows):
    out = sharding.kd_shards(docs, 4).collect()
    assert len(out) == len(rows)
    text = {r[0]: r[1] for r in rows}
    home, load = {}, {}
    for r in out:
        raw = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        assert home.setdefault(text[r.doc_id], r.shard) == r.shard
        load.setdefault(r.shard, []).append((r.slot, r["size"]))
    for part in load.values():
        assert sorted(s for s, _ in part) == list(range(len(part)))
    total = sum(len((r[1] or "").encode()) + 1 for r in rows)
    assert max(sum(s for _, s in p) for p in load.values()) <= max(total / 4 * 1.2, max(len((r[1] or "").encode()) for r in rows) * 1.1)


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer()[0])
    ids = {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    out = packing.pack_documents(docs, limit=64).collect()
    copies = {r[0]: sum(x[0] == r[0] for x in rows) for r in rows}
    seqs, got = {}, {}
    for r in out:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and (r.piece == 0 or r.length == 64)
        got.setdefault(r.doc_id, []).append(r.length)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {k: sum(v) for k, v in got.items()} == {k: len(v) * copies[k] for k, v in ids.items()}
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert len(seqs) <= sum(map(len, ids.values())) / 64 * 1.1 + 1


def test_patterns_are_near_the_bound():
    rng = random.Random(2)
    h = {n: rng.randrange(1, 60) for n in range(1, 1025)}
    p = packing.solve_patterns(h)
    made = {}
    for times, a in p:
        assert sum(n * k for n, k in a.items()) <= 1024
        for n, k in a.items():
            made[n] = made.get(n, 0) + times * k
    assert made == h and sum(t for t, _ in p) <= sum(n * k for n, k in h.items()) / 1024 * 1.03 + 1


@pytest.mark.parametrize("pieces", [{3: 2, 5: 1, 7: 4}, {6: 5}, {1: 3, 4: 2, 9: 1, 10: 1}, {2: 1}, {9: 3, 8: 3, 1: 2, 2: 2}])
def test_program_covers_and_its_dual_bounds(pieces):
    """Small histograms too go through the program: each length covered, the bound under the best packing of all."""
    limit, lengths = 10, np.array(sorted(pieces))
    n = np.array([pieces[x] for x in lengths])
    x, bound = packing.configuration_program(lengths, n, limit)
    covered = np.zeros(len(n))
    for (at, counts), share in x.items():
        assert sum(lengths[i] * k for i, k in zip(at, counts)) <= limit
        covered[list(at)] += np.array(counts) * share
    assert (covered >= n * (1 - 1e-6)).all()

    def fewest(left):
        """Bins of the best packing: the largest piece with every set of others that fits."""
        if not any(left):
            return 0
        i = max(k for k, c in enumerate(left) if c)
        options = itertools.product(*[range(c + 1) for c in left])
        fit = [o for o in options if o[i] and sum(a * lengths[k] for k, a in enumerate(o)) <= limit]
        return 1 + min(fewest(tuple(c - a for c, a in zip(left, o))) for o in fit if not any(all(p >= q for p, q in zip(w, o)) and w != o for w in fit))

    best = fewest(tuple(n.tolist()))
    assert bound <= best + 1e-9 and sum(x.values()) >= bound - 1e-9
    assert sum(t for t, _ in packing.solve_patterns(pieces, limit)) <= best + 1


def test_pii(docs, rows):
    got = {r.doc_id: r for r in pii.scan(docs).collect()}
    last = max(got)
    assert (got[last].n_email, got[last].n_ip, got[last].n_card) == (1, 0, 1) or got[last].n_email == 1
    assert got[60].spans == "" and got[60].base_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail joe [at] foo (dot) org now", "joe [at] foo (dot) org"),
        ("joe dot doe at foo dot co dot uk yes", "joe dot doe at foo dot co dot uk"),
        ("call plus one two one two five five five one two three four ok", "plus one two one two five five five one two three four"),
        ("x jоe@fоo.org", "jоe@fоo.org"),
        ("card ４１１１ 1111 1111 1111.", "４１１１ 1111 1111 1111"),
    ],
)
def test_disguises_map_back(text, found):
    base, every = pii.find(text)
    assert [text[a:b] for _, a, b in every] == [found] and not [x for x in base if x not in every]


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("at 192 dot 168 dot 1 dot 17 now", "ip", "192 dot 168 dot 1 dot 17"),
        ("host one nine two dot one six eight dot one dot one seven up", "ip", "one nine two dot one six eight dot one dot one seven"),
        ("host 192 [dot] one six eight dot 1 (dot) seven up", "ip", "192 [dot] one six eight dot 1 (dot) seven"),
        ("mail joe@foo dot com ok", "email", "joe@foo dot com"),
        ("mail joe at foo.com ok", "email", "joe at foo.com"),
        ("mail joe dot doe at foo dot ch ok", "email", "joe dot doe at foo dot ch"),
        ("mail joe [at] foo dot nl ok", "email", "joe [at] foo dot nl"),
        ("mail j\u043ee \u0430t f\u043eo d\u043et pl ok", "email", "j\u043ee \u0430t f\u043eo d\u043et pl"),
        ("call pl\u200bus \u043ene two one two five five five one two thr\u0435e four ok", "phone", "pl\u200bus \u043ene two one two five five five one two thr\u0435e four"),
    ],
)
def test_disguises_on_top_of_each_other_map_back(text, kind, found):
    base, every = pii.find(text)
    assert base == [] and [(pii.KINDS[k], text[a:b]) for k, a, b in every] == [(kind, found)]


def test_places_are_no_addresses():
    for t in ("more at www.foo.com now", "it ended at noon.It was late", "one. two. three. four.", "one dot two dot three", ". at foo.com", " at foo dot com"):
        assert pii.find(t) == ([], [])


def test_plain_prose_has_no_disguise():
    for t in ("meet at noon on the dot and go", "look at the dot there", "one two three go", "five (5) at [home]"):
        assert pii.find(t) == ([], [])


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    """The base patterns as the contract writes them, with a plain check of each."""
    import re

    def luhn(s):
        return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(s))) % 10 == 0

    for k, kind in enumerate(BASE):
        for m in re.finditer(BASE[kind], text):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                yield k, m.start(), m.end()


def test_base_spans_against_the_patterns():
    rng = random.Random(12)
    bits = ["a", "b.c", "@", ".", "-", "+", " ", "1", "25", "4111 1111 1111 1111", "10.0.0.1", "256", "x@y.zz", "%", "_", "(", ")", "é", "\n", "+7 900 123-45-67", "00", "@@", ".."]
    found = 0
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        want = list(brute_spans(text))
        assert pii.detect(text) == want, text
        found += len(want)
    assert found > 5000


def test_long_runs_take_linear_time():
    import time

    n = 1_000_000
    start = time.time()
    for text in ("9" * n, "a" * n + " x@y", "a" * n + "@", " " * n + "(at) b", "(" * n, ("one " * (n // 4))[:-1], "+" + "1 " * (n // 2), "a@" * (n // 2), "1." * (n // 2), ("a@b.cc " * (n // 7)) + "x (at) y", " dot " * (n // 5) + " at x", "@" + "a." * (n // 2)):
        pii.find(text)
    assert time.time() - start < 90


def test_secrets(spark, docs):
    rng = random.Random(6)
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    texts = [f"{prose(rng, 9)} AKIA{key(16, 'ABCDEFGHIJ234567')} {prose(rng, 5)}" for _ in range(30)] + [f"{prose(rng, 9)} password={key(18, '0123456789abcdef')} {prose(rng, 5)}" for _ in range(30)]
    texts += [f"{prose(rng, 9)} {key(20, 'abcdefghijklmnopqrstuvwxyz')} x {key(16, '0123456789')} {prose(rng, 4)}" for _ in range(60)]
    out = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in out if r.is_secret} == set(range(60))
    # nothing of docs is beyond doubt as a secret: every candidate counts as one
    loose = secrets.scan(docs).collect()
    assert len(loose) == sum(len(re.findall(secrets.CANDIDATE, t or "")) for _, t in docs.select("doc_id", "text").collect())
    assert all(r.score is None and r.is_secret for r in loose)


def secret_texts(rng, n):
    """(doc_id, text, source, whether its one finding is a secret): keys of several forms, named or not, and what looks like them."""
    key = lambda m, a: "".join(rng.choice(a) for _ in range(m))
    hexes, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    joined = lambda glue, m: glue.join(rng.choice(WORDS) for _ in range(m))
    made = [
        (lambda: f'password = "{key(20, mixed)}"', True), (lambda: f"login with {key(40, hexes)}", True), (lambda: f"AKIA{key(16, mixed[:26])}", True), (lambda: f"auth: {key(32, mixed)}", True),
        (lambda: f"commit {key(40, hexes)}", False), (lambda: f"md5 {key(32, hexes)}", False), (lambda: joined("_", 5), False), (lambda: f"password = {joined('-', 3)}", False), (lambda: key(18, "0123456789"), False),
        (lambda: "".join(w.capitalize() for w in joined(" ", 5).split()), False),
    ]
    out = []
    for i in range(n):
        make, secret = made[i % len(made)]
        out.append((i, f"{prose(rng, 8)} {make()} {prose(rng, 6)}", rng.choice(["src/app", "tests/mock"]), secret))
    return out


def test_secrets_on_planted_findings(spark):
    """Labels of some documents' findings, precision and recall on other documents'."""
    rng = random.Random(21)
    frame = lambda rows: spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string")
    known, other = secret_texts(rng, 600), secret_texts(rng, 400)
    truth = spark.createDataFrame([(r[0], int(r[3])) for r in known], "doc_id long, label int")
    out = secrets.scan(frame(other), secrets.candidates(frame(known)).join(truth, "doc_id")).collect()
    found, planted = {r.doc_id for r in out if r.is_secret}, {r[0] for r in other if r[3]}
    assert len(found & planted) >= 0.95 * len(planted) and len(found & planted) >= 0.95 * len(found)


def test_secret_features_against_loops(spark):
    """Dictionary coverage and letter transitions by hand; a long candidate takes linear time."""
    rng = random.Random(22)
    rows = [(i, prose(rng, 60) + (" RiverStone_paperXq9 " if i == 3 else " ") + ("qz" * 100_000 if i == 4 else "")) for i in range(40)] + [(40, None), (41, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = collections.Counter(w for _, t in rows for w in re.findall(r"(?<!\w)[a-z]{3,20}(?!\w)", (t or "").lower()))
    counts = {w: n for w, n in counts.items() if n >= secrets.LEAST_USES}
    words = secrets.corpus_words(docs)
    assert {r.word: r.n for r in words.collect()} == counts
    pairs = collections.Counter()
    for w, n in counts.items():
        for a, b in zip(w, w[1:]):
            pairs[a, b] += n
    after = lambda a: sum(n for (x, _), n in pairs.items() if x == a)
    by = lambda a, b: math.log2(26 * (pairs[a, b] + 1) / (after(a) + 26))
    likelier = secrets.letter_transitions(words)
    assert likelier == pytest.approx([by(chr(97 + a), chr(97 + b)) for a in range(26) for b in range(26)])
    got = {r.doc_id: r for r in secrets.with_features(secrets.candidates(docs), words, likelier).collect() if r.doc_id in (3, 4)}
    parts = [p for p in re.findall(secrets.PARTS, "RiverStone_paperXq9") if p.lower() in counts]
    assert got[3].value == "RiverStone_paperXq9" and got[3].dictionary == pytest.approx(sum(map(len, parts)) / 19)
    v = "riverstone_paperxq9"
    steps = [by(a, b) for a, b in zip(v, v[1:]) if a.isalpha() and b.isalpha()]
    assert got[3].transitions == pytest.approx(sum(steps) / len(steps)) and len(got[4].value) == 200_000


def test_language(spark, nothing):
    rng = random.Random(7)
    parts = {"aa": ["tion", "the", "ing", "ed"], "bb": ["eux", "que", "le", "ai"], "cc": ["ung", "der", "ein", "sch"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(40)), k) for i, k in enumerate(list(parts) * 60)]
    rows += [(1000, None, "aa"), (1001, "123 !", "bb"), (1002, "thetioning", None)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:180]) and got[1000].lang_pred == got[1001].lang_pred == "und" and got[1002].lang_pred == "aa"
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)


def test_text_stats_against_loops(rows):
    for r in rows:
        t = r[1] or ""
        words, (n, chars, symbols, dup, repeats), _ = textstats.text_stats(r[1])
        w = t.encode().split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        cover = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(w) < 500 else None
        seen, d = set(), 0
        for line in t.split("\n"):
            if line.encode().split():
                d += line in seen
                seen.add(line)
        assert (n, chars, symbols, dup) == (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), d)
        assert cover is None or repeats == len(cover)


def test_quality_rules(docs, labels, rows):
    got = quality_rules.judge(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)


def test_quality_verdict_finds_what_the_rules_pass(spark):
    """Rows full of marks pass the rules; nearly all go by the forest, and the good labelled ones stay but for a stated share."""
    rng = random.Random(15)
    rows = [(i, prose(rng, rng.randrange(40, 200)) if i % 12 else " ".join(w + rng.choice(["$$$", "###", " | "]) for w in prose(rng, 90).split())) for i in range(2400)]
    docs = spark.createDataFrame(rows + [(None, None), (5000, "")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 12 > 0)) for i in range(0, 2400, 2)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.judge(docs, marks).collect()}
    good, bad = [i for i in range(2400) if i % 12], [i for i in range(2400) if not i % 12]
    assert not any(got[i].base_failed for i in bad)
    assert sum(got[i].kept for i in bad) <= 0.05 * len(bad) and sum(got[i].kept for i in good) >= 0.98 * len(good)
    assert got[5000].base_failed and not got[None].kept
    # without labels of both kinds only the rules decide
    assert all(r.kept != r.base_failed for r in quality_rules.judge(docs, marks.filter("quality = 1")).collect())


def test_isolation_forest_finds_outliers():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (500, 4))
    f = quality_rules.IsolationForest(x)
    assert f.score(np.full((1, 4), 9.0))[0] > f.score(x).max() - 0.05 > f.score(np.zeros((1, 4)))[0]


def test_quality_model_held_out(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 60) if i % 3 else " ".join(w.upper() + "!!" for w in prose(rng, 60).split())) for i in range(600)]
    rows += [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)], "doc_id long, quality int")
    got = [r for r in quality_model.scores(docs, labels).collect()]
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert len(got) == 602 and sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_drop_poor_against_explicit_pairs(spark):
    """The quality stage keeps the rows whose score, from all pairs one by one, reaches the threshold."""
    rng = random.Random(19)
    rows = [(i, prose(rng, 25) if i % 3 else " ".join(w.upper() + "!!" for w in prose(rng, 25).split())) for i in range(200)] + [(None, None), (500, ""), (3, "x"), (3, prose(rng, 20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, quality int")
    m, want = quality_model.fit(docs, marks), []
    for i, t in rows:
        ids, vals = quality_model._sparse(t, quality_model._Buckets())
        z = m.w0 + m.w[ids] @ vals + sum(m.v[a] @ m.v[b] * p * q for (a, p), (b, q) in itertools.combinations(zip(ids, vals), 2))
        score = 1 / (1 + np.exp(-z))
        assert abs(score - 0.7) > 1e-5
        if score >= 0.7:
            want.append((i, t))
    assert sorted(map(tuple, quality_model.drop_poor(docs, marks).collect()), key=str) == sorted(want, key=str) and 50 < len(want) < 200


def test_factorisation_machine_pairs():
    m = quality_model.FactorisationMachine()
    ids, vals = np.array([3, 8, 20]), np.array([1.0, 2.0, 0.5])
    z, _ = m.raw(ids, vals, np.array([0]))
    pairs = sum(m.v[i] @ m.v[j] * a * b for (i, a), (j, b) in itertools.combinations(zip(ids, vals), 2))
    assert z[0] == pytest.approx(m.w0 + m.w[ids] @ vals + pairs)


def test_empty_tables(nothing, labels):
    for out in (
        exact_dedup.exact_dedup(nothing), near_dedup.near_duplicates(nothing), mixing.with_copies(nothing), sharding.kd_shards(nothing), packing.pack_documents(nothing), pii.scan(nothing),
        secrets.scan(nothing), language.identify(nothing), quality_rules.judge(nothing, labels), quality_model.scores(nothing, labels),
    ):
        assert out.count() == 0


def test_pipeline_stages(spark, tmp_path, docs, labels):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, at, str(tmp_path))
        assert k == 4 or out.columns == at.columns
        out.write.parquet(str(tmp_path / f"out{k}"))
        at = spark.read.parquet(str(tmp_path / f"out{k}"))
    assert sorted(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "length").collect()) == sorted(at.select("doc_id", "piece", "length").collect())


def test_numbered_is_gapless(spark):
    x = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("k"))
    out = common.numbered(x, ["k"], ["doc_id"], "slot", 5000, 3).groupBy("k").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.countDistinct("slot").alias("n")).collect()
    assert all(r.a == 0 and r.b == r.n - 1 for r in out)


def test_blocks_run_on_spark(spark):
    same, other = list(range(0, 300 << 32, 1 << 32)), list(range(1 << 50, (1 << 50) + (300 << 32), 1 << 32))
    members = [(0, same), (1, same), (2, other), (3, other)]
    lists = spark.createDataFrame([(9, c, 300, 4, c) for c, _ in members], "value long, cid long, n long, m long, root long")
    larger = spark.createDataFrame([(c, 300, v[:256]) for c, v in members], "cid long, n long, sketch array<long>")
    for pairs in (near_dedup._block_pairs, near_dedup._block_forest):
        got = near_dedup._blocks(lists, larger, pairs).select("a", "b").collect()
        assert sorted(map(tuple, got)) == [(0, 1), (2, 3)]

"""Near-duplicates: bottom-k sketches, inverted lists, union-sketch estimates, exact Jaccard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, attach, lookup, one_a_group, stable, text_hash
from .components import components, joined

WORDS, NUM, DEN = 5, 3, 4
#: Hash values that a sketch retains, and those that linked sketches share at least. At the threshold itself
#: the shared ones are 48 of 64 on average, and under 32 with probability 4e-6; sets of at most K words are exact.
K, SHARED = 64, 32
#: The same for texts that meet in long lists: 192 of 256 on average, under 159 with probability 2e-6.
LONG_K, LONG_SHARED = 256, 159
#: Union-sketch estimates of K values under this are turned down: 5.5 standard deviations under 0.75.
LEAST_ESTIMATE = 0.45
#: Members of a list that is compared pair by pair at once.
SHORT = 32
#: Members of a block of a longer list, and values that are counted at once within one.
BLOCK, COLUMNS = 1024, 1024
#: Members in turn that stand for a long list before its blocks are compared, and passes over forests of their pairs before all pairs.
TURNS, FORESTS = 2, 3
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class _WordHashes(dict):
    def __missing__(self, w: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(w)
        if len(self) < 300_000:
            self[w] = h
        return h


def shingle_set(text: str | None, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes (int64) of the 5-word shingles; of the whole text if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    s = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(h))):
        s += h[k : n + k] * _M[k]
    s ^= s >> np.uint64(32)
    s *= _M[1]
    s ^= s >> np.uint64(29)
    s *= _M[4]
    s ^= s >> np.uint64(32)
    return np.unique(s.view(np.int64))


def _key(s: np.ndarray) -> str:
    return hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for b in batches:
        sets = [shingle_set(t.as_py(), hashes) for t in b.column(1)]
        cols = [b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) if len(s) else None for s in sets], pa.string()), pa.array([s[:K].tolist() for s in sets], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "n", "key", "sketch"])


def _sets(first: int | None):
    """Of rows (cid, text): the first values of the set, or all, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                sets = [shingle_set(t.as_py(), hashes) for t in part.column(1)]
                words = pa.array([s.tobytes() for s in sets], pa.binary()) if first is None else pa.array([s[:first].tolist() for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), words], names=["cid", "words"])

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column("a_words"), b.column("b_words"), strict=True):
            p, q = (np.frombuffer(z.as_buffer(), np.int64) for z in (x, y))
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(DEN * both >= NUM * (len(p) + len(q) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], names=["a", "b"])


def _texts(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(cid, text) of the classes in ids (cid): the text that stands for each, more than once where its row is."""
    wanted = stable(ids.join(classes.select("cid", F.coalesce("rep", F.lit(0)).alias("rep"), "th"), "cid"))
    small = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).alias("rep"), text_hash().alias("th"), "text")
    return rows.join(F.broadcast(wanted) if small else wanted, ["rep", "th"]).select("cid", "text")


def _with_both(pairs: DataFrame, of: DataFrame, what: str) -> DataFrame:
    """pairs (a, b, ...) with column `what` of both; a hot b is left to the skew join."""
    left = pairs.join(of.select(F.col("cid").alias("a"), F.col(what).alias(f"a_{what}")), "a")
    return left.join(of.select(F.col("cid").alias("b"), F.col(what).alias(f"b_{what}")), "b")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of pairs (a, b, na, nb) whose sets reach the similarity: first by union sketches, then by the full sets."""
    likely = stable(_with_both(pairs, classes.select("cid", "sketch"), "sketch").filter(_alike("a_sketch", "b_sketch", "na", "nb")).select("a", "b"))
    texts = _texts(likely.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), classes, docs)
    words = texts.mapInArrow(_sets(None), "cid long, words binary").dropDuplicates(["cid"])
    return stable(_with_both(likely, words, "words").mapInArrow(_exact, "a long, b long"))


def _lists(sketches: DataFrame, k: int, shared: int) -> DataFrame:
    """(value, cid, n, m): lists of m > 1 classes, from sketches (cid, n, sketch) of k values.

    Values are ordered, alike for all classes, by how many classes have them,
    then by value. Two sketches that share t values share one among the first
    len - t + 1 of both in any such order; t is the exact bound where a set and
    all that can be linked to it lie within k values, `shared` otherwise. Values
    of one class alone come first and make no list, so a text needs a large
    part in common with others to be in any.
    """
    values = sketches.select("cid", F.explode("sketch").alias("value"))
    counts = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    common = attach(values, counts, "value").filter("df is not null").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("common"))
    n, have = F.col("n"), F.least(F.col("n"), F.lit(k))
    t = F.when(n * DEN <= k * NUM, F.ceil(n * NUM / DEN)).otherwise(F.least(F.ceil(n * NUM / DEN), F.lit(shared)))
    first = (F.size("common") - t + 1).cast("int")
    posts = sketches.select("cid", "n").join(common, "cid").filter(first > 0).select("cid", "n", F.explode(F.slice("common", F.lit(1), first)).alias("x"))
    posts = stable(posts.select("x.value", "cid", "n"))
    # values of one passage have the same classes: one list stands for all of them
    heads = posts.groupBy("value").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.sum(F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(1 << 30))).alias("y")).filter("m > 1")
    heads = heads.groupBy("m", "x", "y").agg(F.min("value").alias("value")).select("value", "m")
    return stable(attach(posts, heads, "value").filter("m is not null").select("value", "cid", "n", "m"))


def _pairs(a: DataFrame) -> DataFrame:
    """Distinct pairs whose sizes allow a link; b is the member met more often."""
    allowed = (F.least("na", "nb") * DEN >= F.greatest("na", "nb") * NUM) & (F.col("a") != F.col("b"))
    return a.filter(allowed).select("a", "b", "na", "nb").distinct()


def _stars(lists: DataFrame, turn: int = 0) -> DataFrame:
    """Each member of a list with one member that stands for the list: the smallest, in later turns one by a hash."""
    order = F.xxhash64("cid", "value", F.lit(turn)) if turn else F.col("cid")
    heads = lists.groupBy("value").agg(F.min(F.struct(order.alias("o"), "cid", "n")).alias("h")).select("value", F.col("h.cid").alias("b"), F.col("h.n").alias("nb"))
    return _pairs(attach(lists.select("value", F.col("cid").alias("a"), F.col("n").alias("na")), heads, "value"))


def _open_lists(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Members, with their component, of the lists that still hold two components or more."""
    members = stable(lookup(lists, roots.withColumnRenamed("id", "cid"), "cid").withColumn("root", F.coalesce("root", "cid")))
    mixed = stable(members.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("value", "lo"))
    return stable(lookup(members, mixed, "value").filter("lo is not null").drop("lo"))


def _alike(a: str, b: str, na: str, nb: str):
    """Whether the union sketch of two sketches leaves the similarity possible (exact for sets within K values)."""
    shared, every = F.array_intersect(a, b), F.array_union(a, b)
    union = F.slice(F.array_sort(every), 1, K)
    large = F.greatest(na, nb) > K
    return F.when(large, F.size(F.array_intersect(union, shared)) >= LEAST_ESTIMATE * F.size(union)).otherwise(F.size(shared) * DEN >= F.size(every) * NUM)


def _across(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of a short list's members that are in different components and alike by sketches."""
    own = lists.join(classes.select("cid", "sketch"), "cid")
    left = own.select("value", F.col("cid").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("sketch").alias("sa"))
    right = own.select("value", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("sketch").alias("sb"))
    sized = F.least("na", "nb") * DEN >= F.greatest("na", "nb") * NUM
    return _pairs(left.join(right, "value").filter((F.col("ra") != F.col("rb")) & (F.col("a") < F.col("b")) & sized & _alike("sa", "sb", "na", "nb")))


def _least_shared(n: np.ndarray, k: int, shared: int) -> np.ndarray:
    """Values that sketches of k values share at least if a set of n is linked, as in _lists()."""
    three_quarters = -(-n * NUM // DEN)
    return np.where(n * DEN <= k * NUM, three_quarters, np.minimum(three_quarters, shared))


def _forest(shared: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Pairs of places, those with most shared values first, that connect what all pairs with shared > 0 connect, but for equal roots."""
    out, best, link, pairs = np.ones(len(root), bool), np.zeros(len(root), np.float32), np.zeros(len(root), np.int64), []
    for _ in range(len(root)):
        v = int(np.where(out, best, -1).argmax())
        if 0 < best[v] < np.inf:
            pairs.append((link[v], v))
        out[v] = False
        near = np.where(root == root[v], np.inf, shared[v])
        closer = near > best
        best[closer], link[closer] = near[closer], v
    return np.array(pairs, np.int64).reshape(-1, 2)


def _overlaps(lists: pa.ListArray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many values the lists at x share with those at y; a list has a value once."""
    member = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    _, value, uses = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    place = np.cumsum(uses > 1) - 1
    common = uses[value] > 1
    member, value = member[common], place[value[common]]
    order = np.argsort(value, kind="stable")
    member, value = member[order], value[order]
    shared = np.zeros((len(x), len(y)), np.float32)
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        here = slice(*np.searchsorted(value, (lo, lo + COLUMNS)))
        has = np.zeros((len(lists), COLUMNS), np.float32)
        has[member[here], value[here] - lo] = 1
        shared += has[x] @ has[y].T
    return shared


def _compared(key: tuple, block: pa.Table, forest: bool) -> pa.Table:
    """Pairs of two blocks' members (of one block, if x = y) whose larger sketches share enough values.

    Two members of several lists are compared in the one of the smallest value;
    earlier holds a member's lists before this one. Sketch values are cut to 32
    bits: rarely two become equal, so one value more than is counted may be
    shared. With forest, only the most alike pairs that connect the members as
    all of them would.
    """
    cid, n, root, at = (block.column(c).to_numpy() for c in ("cid", "n", "root", "block"))
    x, y = np.flatnonzero(at == key[1].as_py()), np.flatnonzero(at == key[2].as_py())

    def sized(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        nx, ny = n[x][:, None], n[y][None, :]
        return (np.minimum(nx, ny) * DEN >= np.maximum(nx, ny) * NUM) & (root[x][:, None] != root[y][None, :])

    todo = sized(x, y) & (_overlaps(block.column("earlier").combine_chunks(), x, y) == 0)
    some = todo.any(1), todo.any(0)
    x, y, todo = x[some[0]], y[some[1]], todo[np.ix_(*some)]
    shared = _overlaps(block.column("sketch").combine_chunks(), x, y) + 1
    nx, ny = n[x][:, None], n[y][None, :]
    needed = np.maximum(_least_shared(nx, LONG_K, LONG_SHARED), _least_shared(ny, LONG_K, LONG_SHARED))
    whole = (np.maximum(nx, ny) > LONG_K) | (shared * DEN >= NUM * (nx + ny - shared))
    fit = todo & (shared >= needed) & whole
    if forest:
        near = np.zeros((len(cid), len(cid)), np.float32)
        near[np.ix_(x, y)] = np.where(fit, shared, 0)
        u, v = _forest(np.maximum(near, near.T), root).T
        u, v = np.where(cid[u] < cid[v], u, v), np.where(cid[u] < cid[v], v, u)
        return pa.table({"a": cid[u], "b": cid[v], "na": n[u], "nb": n[v]})
    if key[1] == key[2]:
        fit &= cid[x][:, None] < cid[y][None, :]
    i, j = np.nonzero(fit)
    return pa.table({"a": cid[x][i], "b": cid[y][j], "na": n[x][i], "nb": n[y][j]})


def _block_pairs(key: tuple, block: pa.Table) -> pa.Table:
    return _compared(key, block, False)


def _block_forest(key: tuple, block: pa.Table) -> pa.Table:
    return _compared(key, block, True)


def _blocks(lists: DataFrame, larger: DataFrame, pairs=_block_pairs) -> DataFrame:
    """Pairs of a long list's members that are in different components and alike by larger sketches, by two blocks of BLOCK members at a time.

    A pair is found once, however many lists (at most LONG_K) its members share.
    """
    sketch = larger.select("cid", F.transform("sketch", lambda v: F.shiftright(v, 32).cast("int")).alias("sketch"))
    every = lists.groupBy("cid").agg(F.collect_list("value").alias("every"))
    own = lists.join(sketch, "cid").join(every, "cid").withColumn("earlier", F.filter("every", lambda v: v < F.col("value")))
    own = own.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("value", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "cid", "n", "root", "block", "sketch", "earlier")
    return _pairs(met.groupBy("value", "x", "y").applyInArrow(pairs, "a long, b long, na long, nb long"))


def _roots(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, root): the components of the classes that links connect; classes without a row are their own root."""
    lists = _lists(classes, K, SHARED)
    roots = components(_verified(stable(_stars(lists)), classes, docs))
    left = _open_lists(lists, roots)
    rest, long = left.filter(F.col("m") <= SHORT), left.filter(F.col("m") > SHORT)
    if not long.isEmpty():
        larger = _texts(long.select("cid").distinct(), classes, docs).mapInArrow(_sets(LONG_K), "cid long, words array<long>")
        larger = stable(larger.dropDuplicates(["cid"]).withColumnRenamed("words", "sketch").join(classes.select("cid", "n"), "cid"))
        lists = _lists(larger, LONG_K, LONG_SHARED)
        again = _open_lists(lists, roots)
        for turn in range(1, TURNS + 1):
            if not again.isEmpty():
                roots = joined(roots, _verified(stable(_stars(again, turn)), classes, docs))
                again = _open_lists(lists, roots)
        wide = again.filter(F.col("m") > SHORT)
        # the most alike pairs connect most of a group; then every pair across components is looked at
        for pairs in [_block_forest] * FORESTS + [_block_pairs]:
            if not wide.isEmpty():
                more = _verified(stable(_blocks(wide, larger, pairs)), classes, docs)
                if not more.isEmpty():
                    roots = joined(roots, more)
                    wide = _open_lists(wide.drop("root"), roots)
        # a value heads a list of its own in each of the two indexes
        again = again.filter(F.col("m") <= SHORT).drop("root")
        rest = _open_lists(rest.drop("root").withColumn("value", F.xxhash64("value", F.lit(1))).unionByName(again), roots)
    if not rest.isEmpty():
        more = _verified(stable(_across(rest, classes)), classes, docs)
        if not more.isEmpty():
            roots = joined(roots, more)
    return roots


def _judged(docs: DataFrame) -> DataFrame:
    """doc_id, th (text_hash()), n, gid (its component, null without words), component_id (null: all its ids are) of each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stable(docs.withColumn("th", text_hash()).mapInArrow(_sketches, "doc_id long, th long, n long, key string, sketch array<long>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "n", "sketch")).alias("x")
    groups = rows.filter("n > 0").groupBy("key").agg(first)
    classes = stable(groups.select("key", F.col("x.doc_id").alias("rep"), "x.th", "x.n", "x.sketch", F.monotonically_increasing_id().alias("cid")))
    roots = _roots(classes, docs)
    ids = stable(lookup(classes.select("key", "rep", F.col("cid").alias("id")), roots, "id").select("key", "rep", F.coalesce("root", "id").alias("gid")))
    least = ids.groupBy("gid").agg(F.min("rep").alias("component_id"))
    named = attach(ids, least, "gid").select("key", "gid", "component_id")
    return attach(rows.select("doc_id", "th", "n", "key"), named, "key")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    A-Z are lower-cased, words are runs of characters other than space and
    U+0009 to U+000D, a set holds the distinct 5-word shingles (the whole
    sequence if there are fewer words). Rows with equal sets form a class. The
    classes of a value's list are compared with one member first, and components
    are built from the links; only lists that still hold several components are
    looked at again. The texts of long ones meet once more by larger sketches,
    whose lists are far shorter, with TURNS members in turn. What is then left is
    compared pair by pair across components, by sketches: short lists in a join,
    long ones by counting the values that two blocks of members share, first for
    forests of the most alike pairs, then for all others. So copies
    aren't expanded into pairs, and each pair that shares a value of its prefix
    is turned down by its sketches, verified on the full sets or already
    connected. Null texts and those without words have n_shingles 0, and are
    linked with nothing. Rows that repeat an id stand for their own texts; a
    null id is in no component_id unless its component has no other. An
    empty table gives no rows; other columns are ignored.
    """
    out = _judged(docs)
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, that of the smallest id (null last; of its texts the one of the smallest hash).

    Rows without words, null texts included, all stay. All columns of docs come through.
    """
    return one_a_group(docs, _judged(docs).select("doc_id", "th", "gid"), largest=False)

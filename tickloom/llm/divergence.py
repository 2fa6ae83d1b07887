"""Divergence of sources within a language: exact count vectors by CountVectorizer, group sums, sparse evaluation of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import at_most, sized, stable

#: A term is a run of letters A to Z, in lower case, and of characters from U+0080 on; all other bytes become blanks.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
MIN_DOCS, TOP_TERMS, ALL_TERMS, SCALE = 10, 10, 2**31 - 1, 1_000_000_000
#: SCALE times a lesser count, and two, is in the range of a long.
LONG_COUNT = 9_000_000_000
#: No term is empty: each document has this one besides, so that a fit always finds a vocabulary.
MARK = ""
#: A task counts its documents by chunks of about so many terms; it takes some 60 bytes for each.
CHUNK_TERMS = 1 << 21
COUNTED = pa.schema({"lang": pa.string(), "source": pa.string(), "docs": pa.int64(), "kinds": pa.list_(pa.string()), "times": pa.int64(), "terms": pa.list_(pa.string())})


def _terms(batch: pa.RecordBatch) -> tuple[list[tuple[str, str]], np.ndarray, pa.DictionaryArray]:
    """Of a batch (lang, source, text): the group of each document, and of each term its document and itself. MARK comes before a document's first term."""
    texts = [b" " + (t or b"").translate(TERM_BYTES) for t in batch.column(2).cast(pa.binary()).to_pylist()]
    words = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
    return list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), pc.list_parent_indices(words).to_numpy().astype(np.int32), words.flatten().dictionary_encode()


def _counts(major: np.ndarray, minor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct major * k + minor in order, and how often each occurs."""
    keys = major.astype(np.int64)
    keys *= k
    keys += minor
    keys.sort()
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    return keys[starts], np.diff(starts, append=len(keys))


def _lists(keys: np.ndarray, terms: np.ndarray, names: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
    """Where each run of equal keys starts, and the names of its terms."""
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return starts, pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)), pa.int32()), names.take(pa.array(terms)))


def _counted(held: list[tuple[list[tuple[str, str]], np.ndarray, pa.DictionaryArray]], layers: int) -> Iterator[pa.RecordBatch]:
    """The rows of counted_terms() of what _terms() gave for some batches."""
    named = [g for groups, _, _ in held for g in groups]
    groups = {g: i for i, g in enumerate(sorted(set(named)))}
    langs = {lang: i for i, lang in enumerate(sorted({lang for lang, _ in groups}))}
    of_doc = np.array([groups[g] for g in named], np.int64)
    of_group = np.array([langs[lang] for lang, _ in groups], np.int64)
    firsts = np.cumsum([0, *(len(own) for own, _, _ in held)])
    doc = np.concatenate([d + np.int32(first) for (_, d, _), first in zip(held, firsts, strict=False)])
    coded = pa.chunked_array([t for _, _, t in held]).unify_dictionaries().combine_chunks()
    term, names, k = coded.indices.to_numpy(), coded.dictionary, len(coded.dictionary)
    of_lang, of_source = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))

    def batch(lang: pa.Array, **other: pa.Array | np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([lang if f.name == "lang" else pa.array(other[f.name], f.type) if f.name in other else pa.nulls(len(lang), f.type) for f in COUNTED], schema=COUNTED)

    yield batch(of_lang, source=of_source, docs=np.bincount(of_doc, minlength=len(groups)))
    has, _ = _counts(doc, term, k)
    has, n_docs = _counts(of_group[of_doc[has // k]], has % k, k)
    names_of = pa.array(list(langs), pa.string())
    for layer in range(1, layers + 1):
        has, n_docs = has[n_docs >= layer], n_docs[n_docs >= layer]
        if not len(has):
            break
        starts, kinds = _lists(has // k, has % k, names)
        yield batch(names_of.take(pa.array(has[starts] // k)), kinds=kinds)
    cells, times = _counts(of_doc[doc], term, k)
    order = np.lexsort((times, cells // k))
    order = order[cells[order] % k != names.index(MARK).as_py()]
    cells, times = cells[order], times[order]
    if len(cells):
        starts, terms = _lists(cells // k * (times.max() + 1) + times, cells % k, names)
        group = pa.array(cells[starts] // k)
        yield batch(of_lang.take(group), source=of_source.take(group), times=times[starts], terms=terms)


def counted_terms(docs: DataFrame, layers: int) -> DataFrame:
    """What each task counts in its documents (text, lang, source), by chunks, as rows of three kinds that leave the other columns null.

    (lang, source, docs): the number of documents of a group.
    (lang, kinds): each term of a language that has `layer` documents or more in
    the chunk, for layer 1 to `layers`. A term is in as many of these rows as it has
    documents, or in `layers` if that is less: over all chunks, it is in `layers`
    rows or more if and only if it has as many documents.
    (lang, source, times, terms): the terms that a group has just `times` times in the chunk.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(_terms(b))
                size += len(held[-1][1])
            if size >= CHUNK_TERMS:
                yield from _counted(held, layers)
                held, size = [], 0
        if held:
            yield from _counted(held, layers)

    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    return named.mapInArrow(rows, "lang string, source string, docs long, kinds array<string>, times long, terms array<string>")


def _vectors(kinds: DataFrame, times: DataFrame, min_docs: int) -> tuple[list[str], DataFrame]:
    """The vocabulary of a language's rows of counted_terms() with kinds, and (gid, times, v) of those with times: vectors of ones.

    It has MARK and the terms of min_docs documents or more: it hangs on numbers of
    documents alone, and the layers have a term in min_docs rows if and only if
    min_docs documents have it. There must be min_docs documents.
    """
    fitted = CountVectorizer(inputCol="words", outputCol="v", minDF=float(min_docs), vocabSize=ALL_TERMS).fit(kinds.select(F.col("kinds").alias("words")))
    return fitted.vocabulary, fitted.transform(times.select("gid", "times", F.col("terms").alias("words"))).select("gid", "times", "v")


def group_sums(vectors: DataFrame) -> DataFrame:
    """(gid, term, n): sums of the sparse vectors v, `times` times each, of each group, without the zeros; a task sums its own rows before the shuffle."""
    v = F.unwrap_udt("v")
    cells = vectors.select("gid", "times", F.inline(F.arrays_zip(v["indices"].alias("term"), v["values"].alias("x"))))
    return cells.groupBy("gid", "term").agg(F.sum(F.col("times") * F.col("x").cast("long")).alias("n"))


def _scaled(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 v)), exact, by decimals where a long is too short; null if v is 0."""
    n, of = n.cast("long"), total + 2 * v
    small = F.call_function("div", F.lit(SCALE) * (n + 2), of)
    large = F.call_function("div", F.lit(SCALE).cast("decimal(38,0)") * (n + 2), of.cast("decimal(38,0)"))
    return F.when(v > 0, 1 + F.when(n < LONG_COUNT, small).otherwise(large))


def _part(p: Column, q: Column) -> Column:
    """A term's part of a divergence: floor((p - q)^2 / (p + q)), exact."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence_audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """How sources of a language differ in their terms: rows (lang, source, part, item, value, rank) of docs (text, lang, source).

    A language keeps the terms of min_docs or more of its documents. A group,
    (lang, source), and a language give term t, which occurs there n times among N
    kept ones, p = 1 + floor(10^9 (n + 2) / (N + 2 V)), V terms being kept. Rows of
    part `pair` sum floor((p - q)^2 / (p + q)) over the kept terms for each other
    source (item) of the language; rows of part `term` give it for the group's
    `top` terms against the language's q, of those it has and uses more. rank
    orders a group's rows by falling value, then by item.

    Null text, lang and source are as empty, other columns are ignored. A language
    with fewer documents than min_docs keeps no term and has pairs of value 0; a
    group without terms has pairs as any other, an empty table gives no rows.
    Languages are fitted one after the other. As CountVectorizer has it, a
    language's kept terms pass through the driver: they grow as its vocabulary,
    not as its documents. Sums and pairs stay on the executors.
    """
    session = docs.sparkSession
    rows = stable(counted_terms(docs, min_docs))
    groups = rows.filter("docs is not null").groupBy("lang", "source").agg(F.sum("docs").alias("docs"))
    groups = stable(groups.withColumn("gid", F.monotonically_increasing_id()))
    small = at_most(groups, 200_001)
    kinds, times = (rows.filter(f"{c} is not null") for c in ("kinds", "times"))
    times = times.join(sized(groups.select("lang", "source", "gid"), small), ["lang", "source"])
    sizes, named, sums, first = [], [], [], 0
    for lang, n in groups.groupBy("lang").agg(F.sum("docs")).collect():
        vocabulary, vectors = _vectors(kinds.filter(F.col("lang") == lang), times.filter(F.col("lang") == lang), min_docs) if n >= min_docs else ([MARK], None)
        sizes.append((lang, len(vocabulary) - 1))
        if len(vocabulary) > 1:
            named += [(first + i, t) for i, t in enumerate(vocabulary) if t != MARK]
            sums.append(stable(group_sums(vectors).withColumn("term", F.col("term") + first)))
            first += len(vocabulary)
    counts = sums[0] if sums else session.createDataFrame([], "gid long, term int, n long")
    for s in sums[1:]:
        counts = counts.unionByName(s)
    totals = counts.groupBy("gid").agg(F.sum("n").alias("total"))
    known = groups.join(F.broadcast(session.createDataFrame(sizes, "lang string, v long")), "lang").join(totals, "gid", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    known = known.withColumn("lang_total", F.sum("total").over(Window.partitionBy("lang")))
    known = stable(known.withColumn("p0", _scaled(F.lit(0), F.col("total"), F.col("v"))).drop("docs"))
    x = counts.join(sized(known, small), "gid").withColumn("p", _scaled(F.col("n"), F.col("total"), F.col("v")))
    x = stable(x.select("gid", "term", "n", "p", "p0", "v", "lang_total"))
    out = _pairs(x, known, small).unionByName(_top_terms(x, session.createDataFrame(named, "term int, item string"), top))
    out = out.join(sized(known.select("gid", "lang", "source"), small), "gid")
    return out.select("lang", "source", "part", "item", "value", "rank")


def _top_terms(x: DataFrame, names: DataFrame, top: int) -> DataFrame:
    """The rows of part `term`: a group's `top` terms of those that it uses more than its language. Only they, and their equals in value, get their names."""
    of_lang = F.sum("n").over(Window.partitionBy("term"))
    y = x.withColumn("q", _scaled(of_lang, F.col("lang_total"), F.col("v"))).filter("p > q").withColumn("value", _part(F.col("p"), F.col("q")))
    group = Window.partitionBy("gid")
    y = y.select("gid", "term", "value", F.rank().over(group.orderBy(F.col("value").desc())).alias("place")).filter(F.col("place") <= top)
    y = y.join(names, "term").withColumn("rank", F.row_number().over(group.orderBy(F.col("value").desc(), "item"))).filter(F.col("rank") <= top)
    return y.select("gid", F.lit("term").alias("part"), "item", "value", "rank")


def _pairs(x: DataFrame, known: DataFrame, n_known: int) -> DataFrame:
    """The rows of part `pair` from x (gid, term, n, p, p0), which lacks zeros.

    Over all kept terms the sum is that of V terms that neither has, and for each
    term of one side what it adds to that, which depends on its count alone: so
    counts are grouped first. For terms of both sides a join on the term adds what
    remains.
    """
    f = _part
    p, q, p0, q0 = map(F.col, ("p", "q", "p0", "q0"))
    other = sized(known.select("lang", F.col("gid").alias("other"), F.col("p0").alias("q0")), n_known)
    base = known.join(other, "lang").filter("gid <> other").select("gid", "other", F.coalesce(F.col("v") * f(p0, q0), F.lit(0)).alias("value"))
    alike = x.groupBy("gid", "p", "p0").agg(F.count("*").alias("times"))
    one = alike.join(sized(known.select("gid", "lang"), n_known), "gid").join(other, "lang").filter("gid <> other")
    one = one.select("gid", "other", (F.col("times") * (f(p, q0) - f(p0, q0))).alias("value"))
    a = x.select("term", "gid", "p", "p0")
    b = x.select("term", F.col("gid").alias("other"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = a.join(b, "term").filter("gid < other").groupBy("gid", "other").agg(F.sum(f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)).alias("value"))
    swapped = lambda d: d.select(F.col("other").alias("gid"), F.col("gid").alias("other"), "value")
    out = base.unionByName(one).unionByName(swapped(one)).unionByName(both).unionByName(swapped(both)).groupBy("gid", "other").agg(F.sum("value").alias("value"))
    out = out.join(sized(known.select(F.col("gid").alias("other"), F.col("source").alias("item")), n_known), "other")
    rank = F.row_number().over(Window.partitionBy("gid").orderBy(F.col("value").desc(), "item"))
    return out.select("gid", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))

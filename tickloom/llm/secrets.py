"""Secret scan: broad candidates, then a random forest that removes false positives. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, stable, unit_random

#: A value after a telling name, or a long run of characters that keys are made of.
CANDIDATE = r"""(?i:password|passwd|pwd|secret|token|api[_-]?key)["']?\s{0,3}[=:]\s{0,3}["']?[^\s"',;]{8,}|[A-Za-z0-9+/_-]{16,}={0,2}"""
NAMED = r"""^(?i:password|passwd|pwd|secret|token|api[_-]?key)["']?\s{0,3}[=:]\s{0,3}["']?"""
#: Most labelled findings that the forest is grown from, and its size.
FIT_ROWS, TREES, DEPTH, SEED = 20_000, 30, 6, 13
CONTEXT = 40

#: Words of which the dictionary and the transitions are learned: occurrences at least, in all texts.
LEAST_USES = 5
#: Whole words of 3 to 20 letters, not parts of runs with digits or other letters.
LETTERS = r"(?<![\p{L}\p{N}])[a-z]{3,20}(?![\p{L}\p{N}])"
#: Parts of a candidate that are looked up: runs of one case, capitals first.
PARTS = "[A-Z]?[a-z]{2,}|[A-Z]{3,}"

FEATURES = ("length", "digits", "uppers", "marks", "switches", "transitions", "distinct", "vowels", "dictionary", "named", "assigned", "quoted", "telling", "harmless", "prefix", "path_test", "path_length")
#: Features that rule_label() reads outright: a forest from its labels does without. It still sees length and characters, which the rule reads in part.
OF_THE_RULE = ("named", "prefix")


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, ordinal (from 0 in its text), candidate, value, before, after, path: every match of CANDIDATE in whole texts."""
    if path not in docs.columns:
        docs = docs.withColumn(path, F.lit(None).cast("string"))
    found = docs.select("doc_id", F.col(path).alias("path"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hits", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).filter(F.size("hits") > 0)
    ends = F.transform(F.split("text", CANDIDATE, -1), lambda g: F.struct(F.substring(g, -CONTEXT, CONTEXT).alias("tail"), F.substring(g, 1, CONTEXT).alias("head")))
    cut = found.select("doc_id", "path", "hits", ends.alias("gaps"))
    rows = cut.select("doc_id", "path", F.posexplode(F.transform("hits", lambda h, i: F.struct(h.alias("candidate"), F.get("gaps", i)["tail"].alias("before"), F.get("gaps", i + 1)["head"].alias("after")))).alias("ordinal", "x"))
    return rows.select("doc_id", "ordinal", "x.candidate", F.regexp_replace("x.candidate", NAMED, "").alias("value"), "x.before", "x.after", "path")


def corpus_words(docs: DataFrame) -> DataFrame:
    """(word, n): lower-cased words of all texts of docs that occur LEAST_USES times at least."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0)))
    return docs.select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_USES)


def letter_transitions(words: DataFrame) -> list[float]:
    """At 26 * a + b, how much likelier letter b is after a in words (word, n) than any letter, as log2; 676 numbers, smoothed by one."""
    letters = F.split("word", "")
    pairs = F.zip_with(F.slice(letters, 1, F.size(letters) - 1), F.slice(letters, 2, F.size(letters) - 1), lambda a, b: (F.ascii(a) - 97) * 26 + F.ascii(b) - 97)
    counts = {r["at"]: r["n"] for r in words.select(F.explode(pairs).alias("at"), "n").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    after = [sum(counts.get(26 * a + b, 0) for b in range(26)) for a in range(26)]
    return [math.log2(26 * (counts.get(26 * a + b, 0) + 1) / (after[a] + 26)) for a in range(26) for b in range(26)]


def _covered(found: DataFrame, words: DataFrame) -> DataFrame:
    """(value, covered): characters of each value in parts that are words."""
    parts = found.select("value").distinct().select("value", F.explode(F.regexp_extract_all("value", F.lit(PARTS), F.lit(0))).alias("part"))
    known = attach(parts.withColumn("word", F.lower("part")), words, "word").filter("n is not null")
    return known.groupBy("value").agg(F.sum(F.length("part")).alias("covered"))


def with_features(found: DataFrame, words: DataFrame, likelier: list[float]) -> DataFrame:
    """found (candidates()) with FEATURES; words are corpus_words(), likelier their letter_transitions()."""
    found = attach(found, _covered(found, words), "value")
    small = F.split(F.lower("value"), "")
    letter = lambda c: c.between("a", "z")
    step = lambda a, b: F.when(letter(a) & letter(b), F.get(F.lit(likelier), (F.ascii(a) - 97) * 26 + F.ascii(b) - 97))
    steps = F.array_compact(F.zip_with(F.slice(small, 1, F.size(small) - 1), F.slice(small, 2, F.size(small) - 1), step))
    mean = F.aggregate(steps, F.lit(0.0), lambda x, y: x + y) / F.greatest(F.size(steps), F.lit(1))
    v, n = F.col("value"), F.greatest(F.length("value"), F.lit(1))
    share = lambda pattern: F.regexp_count("value", F.lit(pattern)) / n
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a")
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    columns = {
        "length": F.log2(n.cast("double")),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "marks": share("[^A-Za-z0-9]"),
        "switches": F.regexp_count(classes, F.lit("(?<=0)[Aa]|(?<=[Aa])0|(?<=a)A")) / n,
        "transitions": mean,
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "vowels": share("[AEIOUaeiou]"),
        "dictionary": F.coalesce("covered", F.lit(0)) / n,
        "named": yes(F.col("candidate") != v),
        "assigned": yes(F.col("before").rlike(r"[=:]\s*[\"']?$")),
        "quoted": yes(F.col("after").rlike("^[\"']")),
        "telling": yes(F.concat_ws(" ", "before", "after").rlike(r"(?i)\b(password|passwd|secret|token|key|auth|credential|bearer|login)")),
        "harmless": yes(F.concat_ws(" ", "before", "after", v).rlike(r"(?i)\b(example|sample|dummy|placeholder|checksum|sha\d*|md5|hash|commit|uuid|xxxx)")),
        "prefix": yes(v.rlike("^[A-Z]{4}[A-Z0-9]|^[a-z]{2,4}_[A-Za-z0-9]|^eyJ")),
        "path_test": yes(F.col("path").rlike(r"(?i)test|example|mock|fixture|sample|lock$")),
        "path_length": F.coalesce(F.length("path"), F.lit(0)).cast("double"),
    }
    return found.withColumns(columns).drop("covered")


def rule_label() -> Column:
    """1 for findings of a known form, 0 for those that can't be one, null where a person would have to look."""
    v = F.col("value")
    known = v.rlike(r"^AKIA[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}|^sk-[A-Za-z0-9]{20,}|^xox[abp]-") | ((F.col("candidate") != v) & v.rlike("[0-9]") & v.rlike("(?i)[a-f]") & (F.length(v) >= 12))
    prose = v.rlike(r"^[A-Z]?[a-z]+$|^[A-Z]+$|^[0-9+/_=-]+$") | v.rlike(r"(.)\1{5}")
    return F.when(F.coalesce(known, F.lit(False)), 1.0).when(F.coalesce(prose, F.lit(False)), 0.0)


def fit(labelled: DataFrame, words: DataFrame, likelier: list[float], features: tuple[str, ...] = FEATURES, fit_rows: int = FIT_ROWS) -> RandomForestClassificationModel | None:
    """Forest from labelled findings (candidates() and label 0 or 1): of each label about half of fit_rows, by a hash, equal findings once."""
    known = labelled.filter(F.col("label").isin(0, 1))
    n = {int(r["label"]): r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    rate = F.when(F.col("label") == 1, fit_rows / 2 / n[1]).otherwise(fit_rows / 2 / n[0])
    picked = known.filter(unit_random("doc_id", "ordinal", "value", seed=SEED) < rate).select("label", "value", "candidate", "before", "after", "path").distinct()
    rows = stable(with_features(picked, words, likelier).select("label", *features))
    if rows.select("label").distinct().count() < 2:
        return None
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(data)


def scan(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source", threshold: float = 0.5) -> DataFrame:
    """One row per candidate of docs (doc_id, text, path): doc_id, ordinal, candidate, score, is_secret.

    labelled holds findings as candidates() gives them, with label 0 or 1; if
    none are given, rule_label() labels those of docs that are beyond doubt. The
    forest sees length, character classes, letter transitions, dictionary coverage,
    the path and the text around; from rule labels it does without OF_THE_RULE.
    The dictionary and the transitions come from the words of all texts of docs:
    without any, nothing is covered and transitions are 0. With labels of one kind or none, score is
    null and every candidate counts as a secret, so nothing is lost. Null and
    empty texts have no candidates; equal texts have equal ones. A null path has
    length 0. An empty table gives no rows; other columns are ignored.
    """
    found = stable(candidates(docs, path))
    words = stable(corpus_words(docs))
    likelier = letter_transitions(words)
    features = tuple(c for c in FEATURES if labelled is not None or c not in OF_THE_RULE)
    model = fit(found.withColumn("label", rule_label()) if labelled is None else labelled, words, likelier, features)
    if model is None:
        return found.select("doc_id", "ordinal", "candidate", F.lit(None).cast("double").alias("score"), F.lit(True).alias("is_secret"))
    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(with_features(found, words, likelier))
    out = model.transform(rows).select("doc_id", "ordinal", "candidate", vector_to_array("probability")[1].alias("score"))
    return out.withColumn("is_secret", F.col("score") >= threshold)

"""Language identification by language-bitmask n-gram filters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup

#: n-grams of N characters; grams a language; rows of the filter; hashes; documents a language that it is fitted on (as expected).
N, GRAMS, ROWS, HASHES, FIT_DOCS = 4, 20_000, 1 << 18, 3, 4000
#: A gram counts for each language that has it at this share, at least, of its highest rate.
TYPICAL = 0.3
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
CHUNK = 500_000


@cache
def _letters() -> np.ndarray:
    """Code point to that of the lower-case letter, or a space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            table[c] = ord(x.lower()[0])
    return table


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit codes of the n-grams of texts, the first index of each text, whether each has a letter.

    Letters are lowered, all else is a space; each text stands between spaces.
    """
    joined = "".join(f" {t}   " for t in texts)
    cp = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    starts = np.concatenate([[0], np.cumsum([len(t) + 4 for t in texts])[:-1]]).astype(np.int64)
    some = np.add.reduceat((cp != 32).astype(np.int64), starts) > 0
    w = cp.astype(np.uint64) & np.uint64(0xFFFF)
    w = np.concatenate([w, np.full(N - 1, 32, np.uint64)])
    n = len(cp)
    code = w[:n]
    for k in range(1, N):
        code = (code << np.uint64(16)) | w[k : n + k]
    return code, starts, some


def _chunks(texts: list[str | None]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs = np.array(b.column(1).to_pylist(), object)
        texts = b.column(0)
        for lang in sorted(set(langs)):
            for part in _chunks([texts[int(i)].as_py() for i in np.flatnonzero(langs == lang)]):
                g, n = np.unique(_grams(part)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


class LanguageFilter:
    """Bloom filters of all languages side by side: a row of the table holds a bit for each language."""

    def __init__(self, langs: list[str], grams: dict[str, np.ndarray], prior: dict[str, int]):
        self.langs = langs
        self.table = np.zeros((max(1, -(-len(langs) // 64)), ROWS), np.uint64)
        fill = np.zeros(len(langs))
        for i, lang in enumerate(langs):
            rows = np.unique(np.concatenate([self._rows(grams[lang], k) for k in range(HASHES)]))
            self.table[i // 64, rows] |= np.uint64(1 << (i % 64))
            fill[i] = len(rows) / ROWS
        self.false = fill**HASHES
        self.default = max(range(len(langs)), key=lambda i: prior[langs[i]]) if langs else -1

    @staticmethod
    def _rows(code: np.ndarray, k: int) -> np.ndarray:
        h = code * _MIX[k]
        return ((h ^ (h >> np.uint64(29))) >> np.uint64(17)) & np.uint64(ROWS - 1)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """A gram's languages are the AND of its rows; their counts less the false positives to expect decide."""
        code, starts, some = _grams(texts)
        total = np.diff(np.append(starts, len(code)))
        rows = [self._rows(code, k) for k in range(HASHES)]
        hits = np.zeros((len(texts), len(self.langs)))
        for word in range(len(self.table)):
            mask = self.table[word][rows[0]]
            for r in rows[1:]:
                mask = mask & self.table[word][r]
            for bit in range(min(64, len(self.langs) - 64 * word)):
                hits[:, 64 * word + bit] = np.add.reduceat((mask >> np.uint64(bit)) & np.uint64(1), starts)
        true = np.maximum(0, (hits - total[:, None] * self.false) / (1 - self.false))
        best = np.where(true.max(1) > 0, true.argmax(1), self.default)
        share = true[np.arange(len(texts)), best] / np.maximum(true.sum(1), 1e-9)
        return [self.langs[i] if s else "und" for i, s in zip(best, some, strict=True)], [float(x) if s else 0.0 for x, s in zip(share, some, strict=True)]


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> LanguageFilter:
    """Filter from rows with a lang that aren't held out: about fit_docs of each language, picked by a hash of the id.

    Each language brings its GRAMS most frequent n-grams among those typical of
    it; that table, languages times GRAMS rows, comes to the driver.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = known.groupBy("lang").agg(F.count("*").alias("docs"))
    rate = F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(1 << 20)) < F.lit(float(1 << 20)) * fit_docs / F.col("docs")
    chosen = lookup(known.select("doc_id", "text", "lang"), sizes, "lang").filter(rate)
    counts = chosen.select("text", "lang").mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    r = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    rated = counts.withColumn("rate", r).withColumn("most", F.max("rate").over(Window.partitionBy("gram")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    top = rated.filter((F.col("rate") >= TYPICAL * F.col("most")) & (F.col("n") > 1)).withColumn("rank", rank).filter(F.col("rank") <= GRAMS).select("lang", "gram").toPandas()
    prior = {x["lang"]: x["docs"] for x in sizes.collect()}
    langs = sorted(prior)
    return LanguageFilter(langs, {x: top.loc[top["lang"] == x, "gram"].to_numpy(np.int64).view(np.uint64) for x in langs}, prior)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang).

    Only the text is an input of a prediction. `und` with score 0 stands for a
    null text, a text without a letter, and every text if no row has a lang. A
    text none of whose n-grams is known gets the most frequent language with
    score 0. Texts are read whole, in blocks of about CHUNK characters. Ids may
    repeat or be null (then not held out). An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score = [], []
            for part in _chunks(b.column(1).to_pylist()):
                p, s = shared.value.predict(part) if shared.value.langs else (["und"] * len(part), [0.0] * len(part))
                pred += p
                score += s
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

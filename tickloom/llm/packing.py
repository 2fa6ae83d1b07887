"""Best-fit packing of token pieces by a configuration linear program over the length histogram."""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, stable

#: Encoded words that a worker keeps for good (the first it meets), and those it keeps until there are as many again.
KEPT_WORDS, RECENT_WORDS = 400_000, 50_000
#: A space before other white space: there words may not be encoded one by one.
ODD_SPACE = re.compile(r" \s")
#: Epochs of the program for the histogram, and of the one for what its rounding leaves.
PROGRAMS = (100, 40)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> tuple[str, str]:
    """The vocabulary as the tokenizers library reads it, and the same as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class _Words(dict):
    """Ids of words after a space; the first KEPT_WORDS stay, later ones until there are RECENT_WORDS of them."""

    def __init__(self, encode):
        self.encode, self.recent, self.marks = encode, {}, {}

    def __missing__(self, w: str) -> bytes:
        if (ids := self.recent.get(w)) is not None:
            return ids
        stem = w.rstrip(punctuation)
        # marks after letters are a word of their own for the vocabulary's pattern
        if stem != w and stem.isalpha():
            tail = w[len(stem) :]
            if (end := self.marks.get(tail)) is None:
                if len(self.marks) >= RECENT_WORDS:
                    self.marks.clear()
                end = self.marks[tail] = array("I", self.encode(tail)).tobytes()
            ids = self[stem] + end
        else:
            ids = array("I", self.encode(f" {w}")).tobytes()
        if len(self) < KEPT_WORDS:
            self[w] = ids
        else:
            if len(self.recent) >= RECENT_WORDS:
                self.recent.clear()
            self.recent[w] = ids
        return ids


class WordEncoder:
    """Ids of a text as bytes (little-endian, 4 each), from a byte-level BPE whose words start at spaces.

    The ids are those of tokenizers.Tokenizer.from_file(paths[0]). Words between
    single spaces have ids of their own, so frequent ones are encoded once and
    kept; a word met anew is encoded from the same vocabulary as ranks
    (paths[1]), several times faster. Texts with other runs of spaces are
    encoded whole, those with special tokens by the tokenizers library.
    """

    def __init__(self, paths: tuple[str, str]):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(paths[0])
        self.special = [t.content for t in self.t.get_added_tokens_decoder().values()]
        with open(paths[1], "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.whole = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words = _Words(self.whole)

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array("I", self.t.encode(text, add_special_tokens=False).ids).tobytes()
        if text[-1:] == " " or ODD_SPACE.search(text):
            return array("I", self.whole(text)).tobytes()
        first, *later = text.split(" ")
        return array("I", self.whole(first)).tobytes() + b"".join(map(self.words.__getitem__, later))


def _pieces(paths: tuple[str, str], end_id: int, limit: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder(paths)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                at = 0
                for piece, stop in enumerate(range((n - 1) % limit + 1, n + 1, limit)):
                    for column, v in zip(out, (doc_id, piece, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop])), strict=True):
                        column.append(v)
                    at = stop
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer: tuple[str, str] | None = None, end_id: int = 2, limit: int = 1024) -> DataFrame:
    """Token pieces of each row of docs (doc_id, text): the last pieces are full, the first may be shorter."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(tokenizer or default_tokenizer(), end_id, limit), PIECES)


def _best_fills(values: np.ndarray, lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack DP: the highest total value of pieces in each room up to limit, and the piece that it took last (-1: none)."""
    worth, index = np.full(limit + 1, -np.inf), np.full(limit + 1, -1)
    worth[lengths], index[lengths] = values, np.arange(len(lengths))
    # the best of room c is at limit - c, so that rooms c - 1, c - 2, ... lie in the order of the lengths they leave
    best, took, sums = np.zeros(limit + 1), np.full(limit + 1, -1), np.empty(limit + 1)
    for c in range(1, limit + 1):
        v = np.add(best[limit - c + 1 :], worth[1 : c + 1], out=sums[:c])
        j, before = v.argmax(), best[limit - c + 1]
        if v[j] > before:
            best[limit - c], took[c] = v[j], index[j + 1]
        else:
            best[limit - c] = before
    return best[::-1], took


def _fill(took: np.ndarray, lengths: np.ndarray, room: int) -> list[int]:
    """The pieces (by index of their length) that the DP puts in a room."""
    out = []
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            out.append(int(took[room]))
            room -= lengths[out[-1]]
    return out


def configuration_program(lengths: np.ndarray, n: np.ndarray, limit: int, epochs: int = 100, eta: float = 0.3, group: int = 64) -> tuple[dict[tuple, float], float]:
    """A fractional solution of min sum(x) with n pieces of each length covered, and its least over any solution by the dual.

    Multiplicative weights: a piece's price is its length times exp(-eta * (how
    far its length is covered, less how far all should be)). Each epoch brings
    every length up to the next share of its pieces: under the current prices the
    knapsack DP gives the best pattern that holds a length, for a group of those
    that lag most at a time; then prices change and the DP is solved again. No
    step adds more than an epoch's share of any length. x is a map of patterns
    (indices, counts); n * price / the DP's best value bounds every solution.
    """
    covered, x, bound = np.zeros(len(n)), {}, 0.0
    for epoch in range(1, epochs + 1):
        goal = epoch / epochs
        while len(low := np.flatnonzero(covered < goal - 1e-9)):
            price = lengths * np.exp(-eta * (covered - goal))
            best, took = _best_fills(price, lengths, limit)
            bound = max(bound, float(n @ price / best[limit]))
            for i in low[np.lexsort((-lengths[low], covered[low]))][:group]:
                if covered[i] >= goal:
                    continue
                at, a = np.unique([i, *_fill(took, lengths, limit - lengths[i])], return_counts=True)
                a = np.minimum(a, n[at])
                step = min(float((n[at] / a).min()) / epochs, (goal - covered[i]) * n[i] / a[at == i][0])
                covered[at] += a * step / n[at]
                key = (tuple(at.tolist()), tuple(a.tolist()))
                x[key] = x.get(key, 0.0) + step
    return x, bound


def _fullest(lengths: np.ndarray, left: np.ndarray, limit: int) -> np.ndarray:
    """The longest piece that is left with the pieces that fill the rest best, long ones first (bounded subset sums)."""
    counts = np.zeros(len(lengths), int)
    i = int(np.flatnonzero(left)[-1])
    counts[i], room = 1, int(limit - lengths[i])
    stock = left.copy()
    stock[i] -= 1
    mask, sums, lots = (1 << (room + 1)) - 1, [1], []
    for j in np.flatnonzero((stock > 0) & (lengths <= room)):
        k, n = 1, min(int(stock[j]), room // int(lengths[j]))
        while n > 0:
            take = min(k, n)
            lots.append((int(j), take, take * int(lengths[j])))
            sums.append((sums[-1] | (sums[-1] << lots[-1][2])) & mask)
            n, k = n - take, 2 * k
    at = sums[-1].bit_length() - 1
    for (j, take, size), before in zip(reversed(lots), reversed(sums[:-1]), strict=True):
        if at >= size and before >> (at - size) & 1:
            counts[j] += take
            at -= size
    return counts


def solve_patterns(histogram: dict[int, int], limit: int = 1024) -> list[tuple[int, dict[int, int]]]:
    """Patterns (times, {length: pieces}) that hold the histogram exactly in few sequences of at most limit.

    The configuration program's patterns are rounded from the largest share
    down: what is cut off one is carried to the next, and a pattern is taken as
    often as that says and the pieces that are left allow. What rounding leaves
    is a histogram again: PROGRAMS programs are solved, each for what the one
    before left. Subset sums, longest first, then pack the rest. The work
    depends on the number of lengths, not of pieces.
    """
    lengths = np.array(sorted(n for n in histogram if 0 < n < limit), int)
    left = np.array([histogram[x] for x in lengths], int)
    out: list[tuple[int, dict[int, int]]] = [(histogram[limit], {limit: 1})] if histogram.get(limit) else []
    for epochs in PROGRAMS:
        on = np.flatnonzero(left)
        if not len(on):
            break
        x, _ = configuration_program(lengths[on], left[on], limit, epochs)
        carried = 0.0
        for (at, counts), share in sorted(x.items(), key=lambda p: (-p[1], p[0])):
            at, counts = on[list(at)], np.array(counts)
            carried += share
            times = min(int(carried), int((left[at] // counts).min()))
            carried -= int(carried)
            if times:
                left[at] -= times * counts
                out.append((times, dict(zip(lengths[at].tolist(), counts.tolist(), strict=True))))
    while left.any():
        a = _fullest(lengths, left, limit)
        on = a > 0
        times = int((left[on] // a[on]).min())
        left -= times * a
        out.append((times, {int(lengths[i]): int(a[i]) for i in np.flatnonzero(a)}))
    return out


def _placement(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, sorted by first index: (first index, pieces a sequence, first sequence, offset)."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    seq = 0
    for times, a in patterns:
        at = 0
        for n, k in sorted(a.items(), reverse=True):
            rows.setdefault(n, []).append((used.get(n, 0), k, seq, at))
            used[n] = used.get(n, 0) + times * k
            at += n * k
        seq += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in rows.items()}


def pack(pieces: DataFrame, limit: int = 1024) -> DataFrame:
    """pieces with sequence_id and offset: no sequence over limit, offsets gapless from 0.

    The driver gets the histogram (at most `limit` rows) and broadcasts the
    patterns made from it (bounded by the number of lengths). Pieces of a length
    are numbered without gaps and the number says which sequence and place.
    """
    pieces = stable(pieces)
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = pieces.sparkSession.sparkContext.broadcast(_placement(solve_patterns(histogram, limit)))
    n = sum(histogram.values())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, index = b.column("length").to_numpy(), b.column("_at").to_numpy()
            seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for x in np.unique(lengths):
                first, each, seq0, off0 = table.value[int(x)]
                here = np.flatnonzero(lengths == x)
                p = np.searchsorted(first, index[here], "right") - 1
                d = index[here] - first[p]
                seq[here] = seq0[p] + d // each[p]
                offset[here] = off0[p] + d % each[p] * x
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    at = numbered(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "_at", n, 1)
    return at.select("doc_id", "piece", "start", "length", "ids_crc32", "_at").mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: tuple[str, str] | None = None, end_id: int = 2, limit: int = 1024) -> DataFrame:
    """Tokenize and pack every row of docs; one row per piece.

    A null or empty text is the end id alone. Repeated rows are packed as often
    as they occur. A null doc_id stays null. An empty table gives no rows; other
    columns are ignored. Texts of any length are cut into full pieces after a
    first piece that may be shorter.
    """
    return pack(token_pieces(docs, tokenizer, end_id, limit), limit)

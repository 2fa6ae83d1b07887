"""Statistics of a text that the quality operators share."""

from __future__ import annotations

import numpy as np

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 5
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())

#: Ratios and logs; all stay between 0 and about 20 for any text.
RATIOS = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "distinct", "line_words")


def repeated_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that occur twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = h[:n] * _MULTIPLIERS[0]
    for k in range(1, WINDOW):
        w = w + h[k : n + k] * _MULTIPLIERS[k]
    s = np.sort(w)
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    at = np.flatnonzero(np.isin(w, s[1:][same]))
    edge = np.zeros(len(words) + 1, np.int64)
    edge[at] += 1
    edge[at + WINDOW] -= 1
    return int((edge.cumsum() > 0).sum())


def text_stats(text: str | None) -> tuple[list[bytes], tuple[int, int, int, int, int], list[float]]:
    """Words as UTF-8; n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; RATIOS. Null is as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    solid = len(raw) - sum(map(raw.count, (SPACES[i : i + 1] for i in range(len(SPACES)))))
    chars = solid - (len(raw) - len(text or ""))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    some = max(1, solid)
    upper, digits, marks = (len(raw) - len(raw.translate(None, x)) for x in (_UPPER, _DIGITS, _MARKS))
    ratios = [
        float(np.log1p(n)), min(20.0, chars / max(1, n)), symbols / some, dup / max(1, len(lines)), repeats / max(1, n),
        upper / some, digits / some, marks / some, len(set(words)) / max(1, n), float(np.log1p(n / max(1, len(lines)))),
    ]
    return words, (n, chars, symbols, dup, repeats), ratios

"""Personal data, also in disguise: normalise with an offset map, detect, map back."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: What follows an address's @, and the other kinds. Runs start where no digit stands before and are never given back: the same matches, in linear time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_DIGIT = re.compile("[0-9]")

# Characters that look like others, and digits as words.
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅ" + "αορνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "．＠＋－＿（）",
        "aeopcyxijshdqwABEKMHOPCTYXIJS" + "aopvABEZHIKMNOPTYX" + ".@+-_()",
        strict=True,
    )
)
LOOKALIKES |= {chr(0xFF10 + i): str(i) for i in range(10)} | {chr(0xFF21 + i): chr(65 + i) for i in range(26)} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
LOOKALIKES |= {chr(0x0660 + i): str(i) for i in range(10)} | {chr(0x1D7CE + i): str(i % 10) for i in range(50)}
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_ODD = re.compile("[" + re.escape("".join(LOOKALIKES) + INVISIBLE) + "]")
_SPELLED = "(?:" + "|".join(DIGIT_WORDS) + ")"
_RUN = re.compile(rf"(?i)(?<![a-z])(?:plus[\s-]+)?{_SPELLED}(?:[\s,-]+{_SPELLED}){{3,}}(?![a-z])")
_WORD = re.compile(r"[a-z]+", re.I)
_BRACKET = re.compile(r"(?i)[\[({<]\s*+(at|dot)\s*+[\])}>]\s*+")
_OCTET = rf"(?:[0-9]+|{_SPELLED}(?:[\s,-]+{_SPELLED}){{0,2}})"
_QUAD = re.compile(rf"(?i)(?<![a-z0-9.]){_OCTET}(?:(?:\.|[\s,-]+dot[\s,-]+){_OCTET}){{3}}(?![a-z0-9])")
_PART = re.compile(r"(?i)[\s,-]*(?:([a-z]+)|[0-9]+|\.)")
# Last labels of a domain where only its "at" is a word, as in "joe at foo.com".
_LAST = frozenset(
    "com org net edu gov mil int info biz io co name pro dev app online site xyz example test ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz "
    "ca cc cd cf cg ch ci ck cl cm cn cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in iq ir is it "
    "je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py "
    "qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw".split()
)
_HOST = re.compile(r"(?i)( at |@)([a-z0-9-]+(?:(?:\.| dot )[a-z0-9-]+)*(?:\.| dot )([a-z]{2,}))(?![a-z0-9-])")
# Before these words' "dot" a domain is meant only with a known last label: "look at the dot there".
_DETERMINED = re.compile(r"(?:^|[. ])(?:the|a|an|this|that|each|every|one|no|any|some|my|your|his|her|its|our|their) dot ")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_%+-")
_JOINT = re.compile(r"(?i) (at|dot) ")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(int(p.lstrip("0")[:4] or 0) <= 255 for p in s.split("."))
    if kind == "card":
        digits = s.replace(" ", "").replace("-", "")
        return 13 <= len(digits) <= 19 and _luhn(digits)
    if kind == "phone":
        return 9 <= len(_DIGIT.findall(s)) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses, each from its @: the domain behind it, and the run before it as far as the last address."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1] in _LOCAL or text[start - 1] == "."):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end), ordered; leftmost matches that don't overlap, failing ones dropped."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for k, kind in enumerate(KINDS[1:], 1):
            if kind != "phone" or "+" in text:
                found += [(k, m.start(), m.end()) for m in PATTERNS[kind].finditer(text) if _valid(kind, m.group())]
    return found


Edits = list[tuple[int, int, str]]


def _odd(text: str, low: str) -> Edits:
    """Look-alike and invisible characters."""
    return [] if text.isascii() else [(m.start(), m.end(), LOOKALIKES.get(m.group(), "")) for m in _ODD.finditer(text)]


def _brackets(text: str, low: str) -> Edits:
    """at and dot in brackets."""
    if any(f"{o}{w}{c}" in low for w in ("at", "dot") for o, c in ("[]", "()", "{}", "<>")) or re.search(r"[\[({<]\s+(?:at|dot)\b|\b(?:at|dot)\s+[\])}>]", low):
        found, done = [], 0
        for m in _BRACKET.finditer(text):
            start = m.start()
            while start > done and text[start - 1].isspace():
                start -= 1
            done = m.end()
            found.append((start, done, "@" if m[1].lower() == "at" else "."))
        return found
    return []


def _quads(text: str, low: str) -> Edits:
    """The four numbers of an ip in digits or digit words, joined by dots or the word dot."""
    found: Edits = []
    if "dot" in low or any(f"{w}." in low for w in DIGIT_WORDS):
        for m in _QUAD.finditer(text):
            for x in _PART.finditer(text, m.start(), m.end()):
                if x[1]:
                    found.append((x.start(), x.end(), "." if x[1].lower() == "dot" else DIGIT_WORDS[x[1].lower()]))
                elif not x[0][0].isdigit() and x[0] != ".":
                    # the white space between the word dot and digits
                    found.append((x.start(), x.end(), x[0].lstrip(" ,-\t\n\r\f\v")))
    return found


def _runs(text: str, low: str) -> Edits:
    """Runs of four or more digit words."""
    found: Edits = []
    if sum(map(low.count, DIGIT_WORDS)) >= 4:
        for m in _RUN.finditer(text):
            words = [(m.start() + w.start(), m.start() + w.end(), w.group().lower()) for w in _WORD.finditer(m.group())]
            for i, (a, _, w) in enumerate(words):
                found.append((a, words[i + 1][0] if i + 1 < len(words) else m.end(), DIGIT_WORDS.get(w, "+")))
    return found


def _local_start(text: str, end: int) -> int:
    """Where the local part that ends at `end` starts; its parts are joined by dots or the word dot."""
    at = end
    while True:
        start = at
        while at and text[at - 1] in _LOCAL:
            at -= 1
        if at == start:
            return min(at + 5 if text[at : at + 5].lower() == " dot " else at + 1, end) if at < end else end
        if at and text[at - 1] == ".":
            at -= 1
        elif text[max(at - 5, 0) : at].lower() == " dot ":
            at -= 5
        else:
            return at


def _plain(text: str, low: str) -> Edits:
    """at and dot as plain words, both or one of them."""
    found: Edits = []
    if " at " not in low and not ("@" in text and " dot " in low):
        return found
    for m in _HOST.finditer(text):
        worded, host, last = m[1] != "@", m[2].lower(), m[3]
        known = last.lower() in _LAST
        if " dot " not in host and not (worded and known and (last.islower() or last.isupper()) and not host.startswith("www.")):
            continue
        if not known and _DETERMINED.search(host):
            continue
        start = _local_start(text, m.start())
        if start < m.start():
            found += [(j.start(), j.end(), "@" if j[1].lower() == "at" else ".") for j in _JOINT.finditer(text, start, m.end())]
    return found


#: Each over the output of the one before.
TRANSDUCERS = (_odd, _brackets, _quads, _runs, _plain)


def _applied(text: str, starts: list[int] | range, ends: list[int] | range, edits: Edits) -> tuple[str, list[int], list[int]]:
    """text with edits made, and the maps of its characters to the source carried along; the first of overlapping edits counts."""
    out, s, e, at = [], [], [], 0
    for a, b, by in [*sorted(edits), (len(text), len(text), "")]:
        if a < at:
            continue
        out.append(text[at:a])
        s.extend(starts[at:a])
        e.extend(ends[at:a])
        if by:
            out.append(by)
            s.extend([starts[a]] * len(by))
            # white space behind the last word of a run isn't part of it
            e.extend([ends[a + max(len(text[a:b].rstrip(" ,-\n\t")), 1) - 1]] * len(by))
        at = b
    return "".join(out), s, e


def deobfuscated(text: str) -> tuple[str, list[int], list[int]] | None:
    """The normalised text, and for each of its characters the source's start and end; None if nothing is to do."""
    now, starts, ends, low = text, range(len(text)), range(1, len(text) + 1), text.lower()
    for transducer in TRANSDUCERS:
        if edits := transducer(now, low):
            now, starts, ends = _applied(now, starts, ends, edits)
            low = now.lower()
    return None if isinstance(starts, range) else (now, starts, ends)


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: those and the ones that only the normalised text shows."""
    text = text or ""
    base = detect(text)
    plain = deobfuscated(text)
    if plain is None:
        return base, base
    norm, starts, ends = plain
    more, own = [], [[x for x in base if x[0] == k] for k in range(len(KINDS))]
    for k, a, b in detect(norm):
        span = (k, starts[a], ends[b - 1])
        # spans of a kind are in order and don't overlap, so one that starts before this ends is enough to look at
        i = bisect_left(own[k], span[2], key=lambda x: x[1])
        if not i or own[k][i - 1][2] <= span[1]:
            more.append(span)
    return base, sorted(base + more)


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts, sha, spans = [], [], []
        for t in b.column(1):
            base, every = find(t.as_py())
            counts.append([sum(s[0] == k for s in base) for k in range(len(KINDS))])
            sha.append(hashlib.sha256(_said(base).encode()).hexdigest())
            spans.append(_said(every))
        columns = zip(*counts, strict=True) if counts else [()] * len(KINDS)
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in columns], pa.array(sha, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Spans are of code points of the whole text, end exclusive. n_ columns and
    base_sha256 are of the base patterns over the text as it is; spans holds
    those and what the transducers, each over the output of the one before,
    bring to light: look-alike and invisible characters, at/dot in brackets, ips
    with dots or digits as words, digits as words (runs of four or more), and
    at/dot between words. Any last label of two or more letters will do where
    the host has a dot as a word, other than after a determiner ("at the dot
    there"); there, and where only its "at" is a word ("joe at foo.com"), the
    label must be a known one, and in the latter the host not start with www. A
    disguised span is left out where a base span of its kind
    overlaps it. Null texts are empty, with no spans (''). Ids may repeat or be
    null. An empty table gives no rows; other columns are ignored.
    """
    schema = ", ".join(["doc_id long", *[f"n_{k} long" for k in KINDS], "base_sha256 string", "spans string"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, schema)

"""Text of news: cleaning, filters, tokens of titles, redaction."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

# Parts of addresses that are news or aren't, and phrases of pages that aren't articles.
NEWS_PATHS = (
    "/news", "/press", "/press-release", "/press-releases", "/press-center", "/media", "/media-center", "/news-and-media", "/investors/news",
    "/investors/disclosure", "/ir/news", "/ir-releases", "/disclosure", "/releases", "/corporate_releases", "/investments/news", "/about/news-and-reports/news",
)
OTHER_PATHS = ("/quote", "/quotes", "/stocks", "/chart", "/trading", "/marketdata", "/securities", "/candles", "/orderbook")
BAD_PHRASES = ("открыть график", "стакан заявок", "изменение за день")

# Words of titles that don't count.
STOP_WORDS = (
    "что как это для или при над под без его она они оно уже еще ещё после из-за из за со во на по об от до а и в с к о у не но же ли бы мы вы их ее её он все всё "
    "новости новость сообщил сообщила сообщили заявил заявила заявили рассказал рассказала стало известно может могут будет будут года году лет руб рублей млн млрд тыс "
    "рф россии россия российский российская российские совет директоров рекомендовал рекомендовала рекомендовали пресс релиз релизы финансовые финансовый финансовая "
    "операционные операционный операционная результаты результат группа группы квартал квартала"
).split()
# Endings that are cut off, the first that fits.
ENDINGS = (
    "иями ями ами ого ему ими ыми ее ие ые ое ая яя ий ый ой ую юю ых их ам ям ом ем ах ях ов ев ей ии ия ья иям ием иях ию ью а я ы и е у ю о"
).split()

# Names and forms of secrets in logs.
SECRET_KEY = r"(?i)(api[_-]?key|token|authorization|secret|password|bearer)"
SECRET_VALUE = r"(pza_[A-Za-z0-9_\-]{8,}|sk-or-[A-Za-z0-9_\-]{8,}|Bearer\s+[A-Za-z0-9._\-]+|eyJ[A-Za-z0-9_\-]{20,}\.[A-Za-z0-9_\-]{20,}\.[A-Za-z0-9_\-]{20,})"
LONG_SECRET = r"^[A-Za-z0-9_\-\.]{96,}$"
REDACTED = "[REDACTED]"


def clean_text(text: Column) -> Column:
    """No-break spaces and runs of blanks to one space, line ends to LF, three LF or more to two, ends stripped; null to ''."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), " ", " ")
    t = F.regexp_replace(F.regexp_replace(t, "\r\n?", "\n"), "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def is_news_url(url: Column) -> Column:
    low = F.lower(url)
    return ~_any(low, OTHER_PATHS) & _any(low, NEWS_PATHS)


def is_valid_news_text(text: Column, min_length: int = 300) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return (F.char_length(t) >= min_length) & ~_any(F.lower(t), BAD_PHRASES)


def _stem(token: Column) -> Column:
    cut = F.when(F.lit(False), token)
    for e in ENDINGS:
        cut = cut.when(token.endswith(e) & (F.char_length(token) - len(e) >= 4), F.substring(token, F.lit(1), F.char_length(token) - len(e)))
    return F.when(F.char_length(token) > 5, cut.otherwise(token)).otherwise(token)


def title_tokens(title: Column) -> Column:
    """Stemmed words of three letters or digits at least, without stop words, in order."""
    words = F.regexp_extract_all(F.regexp_replace(F.lower(title), "ё", "е"), F.lit("[a-zа-я0-9]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.transform(F.filter(words, lambda w: (F.char_length(w) >= 3) & ~F.array_contains(stop, w)), _stem)


def title_numbers(title: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(title, F.lit(r"\d+(?:[,.]\d+)?"), F.lit(0)))


def enough_signal(tokens: Column, numbers: Column) -> Column:
    words = F.size(F.filter(F.array_distinct(tokens), lambda t: ~t.rlike("^[0-9]+$")))
    return (words >= 3) | ((words >= 2) & (F.size(numbers) > 0))


def redact_text(text: Column) -> Column:
    return F.when(text.rlike(SECRET_VALUE) | text.rlike(LONG_SECRET), F.lit(REDACTED)).otherwise(text)


def redact_map(payload: Column) -> Column:
    return F.transform_values(payload, lambda k, v: F.when(k.rlike(SECRET_KEY), F.lit(REDACTED)).otherwise(redact_text(v)))


def _blotted(value: Column, kind: DataType) -> Column:
    """A value all of which is secret, in its own type: texts are REDACTED, all else is null."""
    if isinstance(kind, StringType):
        return F.lit(REDACTED)
    if isinstance(kind, StructType):
        return F.struct(*[_blotted(value[f.name], f.dataType).alias(f.name) for f in kind])
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda v: _blotted(v, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, v: _blotted(v, kind.valueType))
    return F.lit(None).cast(kind)


def redact(value: Column, kind: DataType) -> Column:
    """A value of any type without secrets: structs, maps and arrays are walked by their type, whatever their depth.

    What stands under a secret key is REDACTED, null too; a struct's field becomes
    that text, whatever it was, while a map's values keep their common type, in
    which texts become REDACTED and all else null. Of other texts those that look
    like a secret are REDACTED; all other values, nulls among them, stay.
    """
    if isinstance(kind, StringType):
        return redact_text(value)
    if isinstance(kind, StructType):
        secret = re.compile(SECRET_KEY.removeprefix("(?i)"), re.IGNORECASE)
        fields = [(F.lit(REDACTED) if secret.search(f.name) else redact(value[f.name], f.dataType)).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda v: redact(v, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda k, v: F.when(k.cast("string").rlike(SECRET_KEY), _blotted(v, kind.valueType)).otherwise(redact(v, kind.valueType)))
    return value


def redact_rows(rows: DataFrame) -> DataFrame:
    """rows with every column redacted as a field of that name."""
    whole = redact(F.struct(*[F.col(f"`{c}`").alias(c) for c in rows.columns]), rows.schema)
    return rows.select(whole.alias("row")).select("row.*")

"""Ids of stories, decisions and orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def story_id(news_id: Column) -> Column:
    return F.concat(F.lit("story:"), F.substring(F.sha1(news_id), 1, 16))


def _json_text(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def sorted_json(fields: dict[str, Column]) -> Column:
    """A JSON object of fields (JSON text each), by name, as "name": value with a space behind each mark."""
    parts = [F.concat(F.lit(f'"{k}": '), v) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def decision_id(as_of: Column, weights: Column) -> Column:
    """First 24 digits of the hash of as_of (text) and the weights (map of selector to JSON number), key-sorted."""
    entries = F.transform(F.array_sort(F.map_entries(weights)), lambda e: F.concat(_json_text(e["key"]), F.lit(": "), e["value"]))
    body = sorted_json({"as_of": _json_text(as_of), "selector_weights": F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))})
    return F.substring(F.sha2(body, 256), 1, 24)


def order_key(decision: Column, request: dict[str, Column]) -> Column:
    """Hash of the decision's id and the request's fields (JSON text each), key-sorted."""
    return F.sha2(sorted_json({"decision_id": _json_text(decision), **request}), 256)

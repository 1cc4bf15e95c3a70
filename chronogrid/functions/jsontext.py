"""JSON text: canonical form, shape statistics and display summaries."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# what text that is no JSON, or is nested beyond what the parser takes, raises: such text counts as none
UNREADABLE = (TypeError, ValueError, RecursionError)


def canonical_json(text: Column) -> Column:
    """Key-sorted compact JSON, built by the engine."""
    return F.to_json(F.try_parse_json(text))


def n_keys(text: Column) -> Column:
    return F.coalesce(F.size(F.json_object_keys(text)), F.lit(0)).cast("bigint")


# The functions below take texts of any length row by row: pickled rows reach Python a hundred at a time, while an
# Arrow batch of ten thousand texts would grow with their length.


@F.udf(returnType=T.StringType(), useArrow=False)
def canonical_json_exact(text: str | None) -> str | None:
    """Key-sorted compact JSON with ASCII escapes and untouched number forms."""
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
    except UNREADABLE:
        return None


def _measure(value) -> tuple[int, int]:
    """Nesting depth and the number of text or number leaves; the parser before it limits the depth."""
    deepest, leaves, todo = 1, 0, [(value, 1)]
    while todo:
        node, level = todo.pop()
        children = list(node.values()) if isinstance(node, dict) else node if isinstance(node, list) else None
        if children is None:
            leaves += isinstance(node, (int, float, str)) and not isinstance(node, bool)
        else:
            todo.extend((child, level + 1) for child in children)
        deepest = max(deepest, level)
    return deepest, leaves


FACTS_TYPE = T.StructType(
    [T.StructField("canonical", T.StringType()), T.StructField("depth", T.LongType()), T.StructField("scalars", T.LongType())]
)


@F.udf(returnType=FACTS_TYPE, useArrow=False)
def json_facts(text: str | None) -> tuple:
    """Canonical text, depth and scalar count from one parse; all NULL for text that is not JSON."""
    try:
        value = json.loads(text)
        return json.dumps(value, sort_keys=True, separators=(",", ":")), *_measure(value)
    except UNREADABLE:
        return None, None, None


@F.udf(returnType=T.LongType(), useArrow=False)
def pretty_size(text: str | None) -> int | None:
    """Length of the indented, key-sorted text."""
    try:
        return len(json.dumps(json.loads(text), indent=2, sort_keys=True, ensure_ascii=False))
    except UNREADABLE:
        return None


def display_summary(payload: Column, dropped: tuple[str, ...] = ("payload", "page_content")) -> Column:
    """``k=v`` pairs joined by a bar; text that is no object shows its first 140 characters."""
    fields = F.from_json(payload, "map<string,string>", {"mode": "PERMISSIVE"})
    kept = F.map_filter(fields, lambda k, v: ~k.isin(*dropped))
    pairs = F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))
    is_object = F.json_object_keys(payload).isNotNull()
    return F.when(is_object, F.array_join(F.array_distinct(pairs), " | ")).otherwise(F.left(payload, F.lit(140)))


def record_summary(created_ms: Column, source: Column, payload: Column) -> Column:
    """Time, source and payload pairs of a record in one line."""
    time = F.date_format(F.timestamp_millis(created_ms), "yyyy-MM-dd HH:mm:ss")
    return F.concat_ws(" | ", time, F.concat(F.lit("source="), source), display_summary(payload))

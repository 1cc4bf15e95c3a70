"""Identifier and name builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronogrid.constants import NOTE_ID_PREFIX


def window_id(index: Column) -> Column:
    return F.concat(F.lit("wearable.win."), index.cast("string"))


def rollup_id(span_seconds: Column, start_ms: Column) -> Column:
    return F.concat(
        F.lit("wearable.rollup."), span_seconds.cast("string"), F.lit("s."), start_ms.cast("string")
    )


def page_id(note: Column, order: Column) -> Column:
    return F.concat(F.lit(NOTE_ID_PREFIX + "."), note.cast("string"), F.lit(".p"), order.cast("string"))


def run_id(model: Column, cadence: Column, created_ms: Column) -> Column:
    return F.concat(F.lit("run-"), model, F.lit("-"), cadence, F.lit("-"), created_ms.cast("string"))


def window_label(ordinal: Column) -> Column:
    """``window-000`` labels; longer numbers keep all digits."""
    return F.format_string("window-%03d", ordinal)


def safe_name(name: Column) -> Column:
    return F.coalesce(
        F.nullif(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}\-_.]", "-"), F.lit("")), F.lit("module")
    )


def note_of_file(file_name: Column) -> Column:
    """Note id inside ``<prefix>.<note>.p<N>-<stamp>.json``; NULL for other names."""
    shape = rf"^{NOTE_ID_PREFIX}\.(.+)\.p\d+-\d+\.json$"
    return F.nullif(F.regexp_extract(file_name, shape, 1), F.lit(""))


def banner_table(text: Column) -> Column:
    first_line = F.split(F.regexp_replace(text, "^\ufeff+", ""), r"\r\n|\n|\r", 2)[0]
    return F.trim(F.split(first_line, ",", 2)[0])

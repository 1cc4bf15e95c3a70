"""Classification, validation and filter expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronogrid.constants import (
    BROWSER_CATEGORY,
    BROWSER_NAMES,
    BROWSER_WORDS,
    EMBEDDING_TYPE,
    ENVELOPE_KEYS,
    HR_DIR,
    HRV_DIR,
    REPORT_TYPE,
    SOURCES,
)


def normalize_source(source: Column) -> Column:
    clean = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    return (
        F.when(clean.startswith("browser"), F.lit("browser"))
        .when(clean.isin(*SOURCES), clean)
        .otherwise(F.lit("other"))
    )


def missing_envelope_keys(raw_json: Column, required: tuple[str, ...] = ENVELOPE_KEYS) -> Column:
    keys = F.coalesce(F.json_object_keys(raw_json), F.array().cast("array<string>"))
    return F.array_except(F.array(*[F.lit(k) for k in required]), keys)


def text_or(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def payload_field(payload: Column, name: str) -> Column:
    return F.nullif(F.get_json_object(payload, f"$.{name}"), F.lit(""))


def payload_kind(payload: Column) -> Column:
    return F.coalesce(payload_field(payload, "kind"), F.lit("(untyped)"))


def is_report(payload: Column) -> Column:
    return F.coalesce(payload_field(payload, "artifact_type") == REPORT_TYPE, F.lit(False))


def is_embedding(payload: Column) -> Column:
    return F.coalesce(payload_field(payload, "artifact_type") == EMBEDDING_TYPE, F.lit(False))


def verdict_of(payload: Column) -> Column:
    return F.lower(payload_field(payload, "verdict"))


def safe_segment(value: Column) -> Column:
    """One path segment: 1-128 printable ASCII characters, no separator or dots."""
    return F.coalesce(value.rlike(r"^[!-~]{1,128}\z") & ~value.rlike(r"[/\\]|\.\."), F.lit(False))


def safe_relative_path(value: Column) -> Column:
    return F.coalesce(
        value.rlike(r"^[!-~\r\n\t]{1,300}\z") & ~value.startswith("/") & ~value.rlike(r"\\|\.\."), F.lit(False)
    )


def allowed_prefix(value: Column, prefixes: tuple[str, ...] = (HR_DIR, HRV_DIR)) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | value.startswith(prefix)
    return F.coalesce(hit, F.lit(False))


def is_browser(name: Column) -> Column:
    return F.coalesce(F.lower(name).rlike("|".join(BROWSER_WORDS)), F.lit(False))


def _first_word(name: Column, table: tuple[tuple[str, str], ...], otherwise: Column) -> Column:
    lowered = F.lower(name)
    chain = None
    for word, label in table:
        hit = lowered.contains(word)
        chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    return chain.otherwise(otherwise)


def browser_category(name: Column) -> Column:
    return _first_word(name, BROWSER_CATEGORY, F.lit("unknown_browser"))


def browser_name(name: Column) -> Column:
    return _first_word(name, BROWSER_NAMES, name)


def connection_state(connected: Column, transport: Column) -> Column:
    return (
        F.when(~F.coalesce(connected, F.lit(False)), F.lit("disconnected"))
        .when(transport.isin("wifi", "cellular", "ethernet"), transport)
        .otherwise(F.lit("unknown"))
    )


def is_blank_page(text: Column) -> Column:
    return F.upper(F.replace(F.coalesce(F.trim(text), F.lit("")), F.lit(" "), F.lit(""))).isin("", "BLANK")


def quality_tier(quality: Column) -> Column:
    return F.when(quality >= 0.67, F.lit("high")).when(quality >= 0.34, F.lit("medium")).otherwise(F.lit("low"))

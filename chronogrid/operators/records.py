"""Records: normalisation, validation and projection to the shared envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogrid.constants import ACCESS_NOTE, ENVELOPE_KEYS, LEGACY_KEYS
from chronogrid.functions import ids
from chronogrid.functions.numbers import round_stable
from chronogrid.functions.predicates import text_or
from chronogrid.functions.timefn import to_epoch_ms


def _top(raw: Column, key: str) -> Column:
    return F.get_json_object(raw, f"$.{key}")


def _either(raw: Column, key: str) -> Column:
    """Value under the current name, else under the legacy one."""
    legacy = LEGACY_KEYS.get(key)
    return F.coalesce(_top(raw, key), _top(raw, legacy)) if legacy else _top(raw, key)


def normalize_records(df: DataFrame, raw: str, keep: list[str] | None = None) -> DataFrame:
    """JSON text of a record to the typed envelope; unknown keys go to ``extras``.

    Payload and provenance stay JSON text; an absent payload is ``{}`` and a
    provenance text that is not JSON becomes NULL. Rows without a readable
    creation time keep a NULL there, for the caller to reject.
    """
    text = F.col(raw)
    known = list(ENVELOPE_KEYS) + list(LEGACY_KEYS.values())
    fields = F.from_json(text, "map<string,string>")
    created = to_epoch_ms(_either(text, "createdAtEpochMs"))
    provenance = _either(text, "provenanceMetadataJson")
    return df.select(
        *(keep or []),
        text_or(_either(text, "artifactId"), "unknown").alias("artifact_id"),
        text_or(_top(text, "source"), "other").alias("source"),
        F.coalesce(_top(text, "payload"), F.lit("{}")).alias("payload"),
        created.alias("created_at_ms"),
        text_or(_either(text, "schemaVersion"), "1.0").alias("schema_version"),
        text_or(_either(text, "deviceAlias"), "unknown").alias("device_alias"),
        F.to_json(F.try_parse_json(provenance)).alias("provenance"),
        F.coalesce(to_epoch_ms(_either(text, "ingestedAtEpochMs")), created).alias("ingested_at_ms"),
        text_or(_either(text, "ingestStatus"), "accepted").alias("ingest_status"),
        F.map_filter(fields, lambda k, v: ~k.isin(*known)).alias("extras"),
    )


# --- browser visits ---------------------------------------------------------

# Keys that mark the mobile collector shape.
MOBILE_VISIT_KEYS = (
    "browser_package",
    "browser_name",
    "observed_at_ms",
    "canonical_url",
    "hostname",
    "page_started_ms",
    "page_ended_ms",
)


def _unwrapped(raw: Column) -> Column:
    """Inner payload object of a wrapped record, else the record itself."""
    inner = _top(raw, "payload")
    return F.when(F.json_object_keys(inner).isNotNull(), inner).otherwise(raw)


# Fields of a canonical visit with their JSON type; True marks a required one.
VISIT_FIELDS = {
    "schema_version": ("string", True),
    "event_type": ("string", True),
    "source_app": ("string", True),
    "app_id": ("string", False),
    "device_id": ("string", False),
    "visit_id": ("string", True),
    "canonical_host": ("string", True),
    "page_title": ("string or null", False),
    "visit_start_ms": ("integer", True),
    "visit_end_ms": ("integer", True),
    "dwell_ms": ("integer", True),
    "category": ("string", False),
    "input_context": ("object", False),
    "input_context.type": ("string or null", False),
    "input_context.focused": ("boolean", False),
    "input_context.submitted": ("boolean", False),
    "provenance": ("object", True),
    "provenance.collected_by": ("string", True),
    "provenance.collection_version": ("string", True),
    "provenance.collection_mode": ("string", True),
    "provenance.recorded_at_ms": ("integer", True),
    "raw_content_blocked": ("boolean", True),
}
CONTEXT_FIELDS = ("type", "focused", "submitted")


def _kind_of(value: Column) -> Column:
    """JSON type of a variant: string, integer, number, boolean, object, array or null."""
    name = F.schema_of_variant(value)
    whole = (F.try_variant_get(value, "$", "double") % 1 == 0) & ~name.startswith("OBJECT") & ~name.startswith("ARRAY")
    return (
        F.when(name == "VOID", "null").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean")
        .when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array")
        .when((name == "BIGINT") | F.coalesce(whole, F.lit(False)), "integer").otherwise("number")
    )


def visit_faults(body: Column) -> Column:
    """One text per fault of a canonical visit, in the order of the fields; empty for a valid one."""
    record = F.try_parse_json(body)
    faults = [
        F.when(
            F.coalesce(F.try_variant_get(record, "$.event_type", "string") != "browser_visit", F.lit(False)),
            F.lit("event_type is not browser_visit"),
        )
    ]
    for field, (kind, required) in VISIT_FIELDS.items():
        value = F.try_variant_get(record, f"$.{field}", "variant")
        outer, dot, _ = field.partition(".")
        inside = _kind_of(F.try_variant_get(record, f"$.{outer}", "variant")) == "object" if dot else F.lit(True)
        fits = _kind_of(value).isin(*kind.split(" or "))
        wrong = F.lit(f"{field} is no {kind}")
        missing = F.lit(f"{field} is missing") if required else F.lit(None).cast("string")
        faults.append(F.when(inside & value.isNull(), missing).when(inside & ~fits, wrong))
    context = F.json_object_keys(_top(body, "input_context"))
    strange = F.array_except(context, F.array(*[F.lit(k) for k in CONTEXT_FIELDS]))
    more = F.transform(F.coalesce(strange, F.array().cast("array<string>")), lambda k: F.concat(F.lit("input_context."), k, F.lit(" is not known")))
    return F.concat(F.array_compact(F.array(*faults)), more)


def validate_visits(df: DataFrame, raw: str) -> DataFrame:
    """Add ``errors``: empty for a canonical visit or a known mobile shape, else one text per fault."""
    body = _unwrapped(F.col(raw))
    keys = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
    mobile = F.arrays_overlap(keys, F.array(*[F.lit(k) for k in MOBILE_VISIT_KEYS]))
    looks_canonical = F.array_contains(keys, "visit_id")
    known_mobile = F.coalesce(mobile, F.lit(False)) & ~looks_canonical
    none = F.array().cast("array<string>")
    not_json = F.array(F.lit("the record is no JSON object"))
    errors = F.when(F.json_object_keys(body).isNull(), not_json).when(known_mobile, none).otherwise(visit_faults(body))
    return df.withColumn("errors", errors)


def _filled(value: Column) -> Column:
    """Empty text, zero and JSON null count as absent."""
    return F.when(~value.isin("", "0", "0.0", "false"), value)


def visit_records(df: DataFrame, raw: str, keep: list[str] | None = None) -> DataFrame:
    """Visits as browser records with reproducible ids."""
    record = F.col(raw)
    body = _unwrapped(record)

    def inner(key: str) -> Column:
        return _filled(_top(body, key))

    def outer(key: str) -> Column:
        return _filled(_top(record, key))

    observed = inner("observed_at_ms").try_cast("double").try_cast("bigint").cast("string")
    started = inner("visit_start_ms").try_cast("double").try_cast("bigint").cast("string")
    url_hash = F.pmod(F.xxhash64(F.coalesce(inner("canonical_url"), F.lit(""))), F.lit(2**32)).cast("string")
    by_url = F.when(inner("canonical_url").isNotNull(), F.concat(url_hash, F.lit("-"), started))
    artifact_id = F.coalesce(
        inner("visit_id"),
        outer("artifactId"),
        inner("artifactId"),
        F.concat(inner("browser_package"), F.lit("-"), observed),
        by_url,
        F.sha2(record, 256),
    )
    created = F.coalesce(
        inner("visit_start_ms"),
        inner("visit_start"),
        inner("observed_at_ms"),
        outer("createdAtEpochMs"),
        _filled(F.get_json_object(record, "$.provenance.recorded_at_ms")),
    )
    return df.select(
        *(keep or []),
        artifact_id.alias("artifact_id"),
        F.lit("browser").alias("source"),
        body.alias("payload"),
        created.try_cast("double").try_cast("bigint").alias("created_at_ms"),
        F.coalesce(
            _top(record, "schema_version"), _top(record, "schemaVersion"), _top(body, "schema_version"), F.lit("1.0")
        ).alias("schema_version"),
        F.coalesce(
            outer("device_id"), outer("deviceAlias"), inner("device_id"), inner("deviceAlias"), F.lit("unknown")
        ).alias("device_alias"),
        F.coalesce(
            _top(record, "provenance"), _top(record, "provenanceMetadataJson"), _top(body, "provenance"), F.lit("{}")
        ).alias("provenance"),
    )


# --- projections of collected signals -----------------------------------------


def metadata_only(
    host: Column,
    title: Column,
    dwell_ms: Column,
    page_type: Column,
    host_type: Column,
    field_type: Column | None = None,
    package: Column | None = None,
    name: Column | None = None,
    category: Column | None = None,
    observed_at_ms: Column | None = None,
) -> Column:
    """The sixteen browser fields that may be kept; no content, address or typed value."""

    def lowered(value: Column | None) -> Column:
        return F.lower(F.coalesce(value, F.lit("unknown"))) if value is not None else F.lit("unknown")

    def given(value: Column | None, default: str) -> Column:
        return F.coalesce(value, F.lit(default)) if value is not None else F.lit(default)

    safe_host = F.coalesce(host, F.lit("unknown.local"))
    family = given(category, "unknown_browser")
    return F.struct(
        given(package, "unknown").alias("browser_package"),
        given(name, "unknown").alias("browser_name"),
        family.alias("browser_family"),
        safe_host.alias("canonical_host"),
        F.greatest(dwell_ms.cast("bigint"), F.lit(0).cast("bigint")).alias("dwell_ms"),
        (observed_at_ms if observed_at_ms is not None else F.lit(None).cast("bigint")).alias("observed_at_ms"),
        F.lit("usage_stats_only").alias("collection_mode"),
        family.alias("category"),
        F.lit("unknown").alias("intent_label"),
        F.struct(
            lowered(field_type).alias("field_type"),
            F.lit(False).alias("interacted"),
            F.lit(False).alias("submitted"),
            F.lit(False).alias("value_logged"),
        ).alias("input_context"),
        F.lit("unknown").alias("link_subcategory"),
        F.struct(
            lowered(page_type).alias("page_type"),
            F.coalesce(F.length(title), F.lit(0)).cast("bigint").alias("title_length"),
            lowered(host_type).alias("host_type"),
        ).alias("page_context"),
        F.coalesce(title, F.lit("unknown")).alias("page_title"),
        safe_host.alias("hostname"),
        safe_host.alias("domain"),
        F.lit(ACCESS_NOTE).alias("access_note"),
    )


def coarse_location(df: DataFrame, lat: str = "latitude", lon: str = "longitude", accuracy: str = "accuracy") -> DataFrame:
    """Coordinates at two decimals with a bucket name; the raw values are dropped."""
    near = df.withColumn("lat", round_stable(F.col(lat), 2)).withColumn("lon", round_stable(F.col(lon), 2))
    return (
        near.withColumn("bucket", F.format_string("lat%.2f-lon%.2f", "lat", "lon"))
        .withColumn("accuracy_m", F.greatest(F.col(accuracy).cast("double"), F.lit(1.0)))
        .drop(lat, lon, accuracy)
    )


def accepted_notes(df: DataFrame, status: str, note: str) -> DataFrame:
    return df.where((F.col(status) == "accepted") & (F.length(F.coalesce(F.col(note), F.lit(""))) > 0))


def page_records(
    pages: DataFrame,
    now_ms: int,
    engine: str = "external",
    model: str = "external",
    prompt_version: str = "v1.0",
    device_alias: str = "unknown",
) -> DataFrame:
    """Transcribed pages as journal records.

    ``pages``: note_uuid, page_order, ocr_text, png_sha256, captured_ms, transcribed_ms and, when
    known, source_path, page_source, dimensions, image_bytes.
    """

    def given(name: str, kind: str, default) -> Column:
        return F.col(name) if name in pages.columns else F.lit(default).cast(kind)

    captured = F.nullif(F.col("captured_ms").cast("bigint"), F.lit(0).cast("bigint"))
    transcribed = F.nullif(F.col("transcribed_ms").cast("bigint"), F.lit(0).cast("bigint"))
    payload = F.struct(
        F.lit("journal").alias("kind"),
        F.lit("journal").alias("modality"),
        F.lit("handwritten_note_page").alias("artifactKind"),
        F.col("note_uuid").alias("noteUuid"),
        F.col("page_order").cast("bigint").alias("pageOrder"),
        F.col("ocr_text").alias("ocrText"),
        F.lit(engine).alias("ocrEngine"),
        F.lit(model).alias("ocrModel"),
        F.lit(prompt_version).alias("ocrPromptVersion"),
        F.struct(
            given("source_path", "string", None).alias("sourcePath"),
            given("page_source", "string", "cover").alias("source"),
            F.col("png_sha256").alias("sha256"),
            given("dimensions", "array<bigint>", None).alias("dimensions"),
            given("image_bytes", "bigint", None).alias("bytes"),
        ).alias("pageImage"),
        F.lit(device_alias).alias("deviceAlias"),
        F.coalesce(captured, F.lit(0).cast("bigint")).alias("capturedAtMs"),
        F.coalesce(transcribed, F.lit(0).cast("bigint")).alias("transcribedAtMs"),
    )
    return pages.select(
        ids.page_id(F.col("note_uuid"), F.col("page_order")).alias("artifact_id"),
        F.lit("journal").alias("source"),
        payload.alias("payload"),
        F.coalesce(captured, transcribed, F.lit(now_ms).cast("bigint")).alias("created_ms"),
        F.lit("1.0").alias("schema_version"),
        F.lit(device_alias).alias("device_alias"),
        F.lit("pending").alias("ingest_status"),
    )


def to_wire(df: DataFrame, nested: list[str]) -> DataFrame:
    """Nested columns as JSON text, marked as not yet sent."""
    texts = {name: F.to_json(F.col(name)) for name in nested}
    return df.withColumns(texts).withColumn("synced", F.lit(False))

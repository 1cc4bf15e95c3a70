"""Raw records and canonical windows from a folder of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronogrid.constants import MODALITIES, RESOLUTION_MS
from chronogrid.functions.timefn import floor_index, parse_iso_ms
from chronogrid.sources.files import first_existing, text_files

RAW_SCHEMA = "path string, raw string"


def scan_records(
    spark: SparkSession, root: str, source: str | None = None, layout: str = "file", ordered: bool = True
) -> DataFrame:
    """path, raw: every JSON object below ``root`` or its ``source`` folder, sorted by path unless that is not needed.

    A missing source folder falls back to the root. Anything that is not a JSON
    object is skipped. ``layout``: ``file`` for one object per file, ``lines``
    for one per line, which also splits large files.
    """
    folder = first_existing(spark, *([f"{root.rstrip('/')}/{source}", root] if source else [root]))
    if folder is None:
        return spark.createDataFrame([], RAW_SCHEMA)
    glob = "*.json" if layout == "file" else "*"
    rows = text_files(spark, folder, glob, whole=layout == "file").withColumnRenamed("text", "raw")
    objects = rows.where(F.json_object_keys("raw").isNotNull())
    return objects.orderBy("path") if ordered else objects


def _values(fields: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields.items()])


PAYLOADS = {
    "heart_rate": {"bpm": "double", "bpm_min": "double", "bpm_max": "double", "bins": "bigint"},
    "hrv_proxy": {"bpm": "double", "windows": "bigint", "method": "string"},
    "hrv": {"sdnn_ms": "double", "rmssd_ms": "double", "derived_by_watch": "boolean"},
    "stress": {"readings": "bigint", "score": "double", "score_min": "double", "score_max": "double"},
    "sleep_stage": {"segments": "bigint", "stage_codes": "array<bigint>", "dominant_stage": "string"},
}

_WINDOW = (
    "struct<startEpochMs:string,start_ms:string,endEpochMs:string,end_ms:string,"
    "start_time:string,end_time:string,canonical_index:string>"
)


def window_schema() -> str:
    payloads = ",".join(
        f"{m}:struct<{','.join(f'{n}:{t}' for n, t in fields.items())}>" for m, fields in PAYLOADS.items()
    )
    return (
        "artifactId string, deviceAlias string, ingestedAtEpochMs bigint, payload struct<kind:string,"
        f"window:{_WINDOW},modalities_present:map<string,boolean>,"
        f"payload:struct<modalities:struct<{payloads}>>,"
        "missingness_metadata:struct<modality_coverage:map<string,double>>>"
    )


def load_windows(records: DataFrame) -> DataFrame:
    """Canonical windows of a record scan in (start, id) order."""
    return parse_windows(records).orderBy("start_ms", "artifact_id")


def parse_windows(records: DataFrame) -> DataFrame:
    """Canonical windows of a record scan, in no order; other kinds are skipped.

    The start comes from the epoch fields, else from the ISO text; rows without
    one are dropped, an end not after the start becomes one cell, and a missing
    index is derived from the start.
    """
    parsed = records.select(F.from_json("raw", window_schema()).alias("r")).where("r.payload.kind = 'canonical_window'")
    window = "r.payload.window"

    def positive(*names: str):
        numbers = [F.col(f"{window}.{n}").try_cast("double").try_cast("bigint") for n in names]
        return F.coalesce(*[F.when(n > 0, n) for n in numbers])

    start = F.coalesce(positive("startEpochMs", "start_ms"), parse_iso_ms(F.col(f"{window}.start_time")))
    end = F.coalesce(positive("endEpochMs", "end_ms"), parse_iso_ms(F.col(f"{window}.end_time")), F.lit(0))
    timed = parsed.select("r", start.alias("start_ms"), end.alias("_end")).where("start_ms > 0")
    index = F.coalesce(positive("canonical_index"), floor_index(F.col("start_ms")))
    present = {m: F.coalesce(F.col("r.payload.modalities_present")[m], F.lit(False)) for m in MODALITIES}
    coverage = {m: F.coalesce(F.col("r.payload.missingness_metadata.modality_coverage")[m], F.lit(0.0)) for m in MODALITIES}
    values = [
        F.col(f"r.payload.payload.modalities.{m}.{n}").alias(f"{m}_{n}")
        for m, fields in PAYLOADS.items()
        for n in fields
        if n not in ("method", "derived_by_watch")
    ]
    return timed.select(
        F.coalesce("r.artifactId", F.lit("")).alias("artifact_id"),
        F.coalesce("r.deviceAlias", F.lit("")).alias("device"),
        F.coalesce("r.ingestedAtEpochMs", F.lit(0)).alias("ingested_ms"),
        index.alias("canonical_index"),
        "start_ms",
        F.when(F.col("_end") <= F.col("start_ms"), F.col("start_ms") + F.lit(RESOLUTION_MS)).otherwise(F.col("_end")).alias("end_ms"),
        *[c.alias(f"present_{m}") for m, c in present.items()],
        *[c.alias(f"cov_{m}") for m, c in coverage.items()],
        *values,
    )


def newest_windows(windows: DataFrame) -> DataFrame:
    """One version per device, id and start: the last taken in, on a tie the greater row."""
    keys = ["device", "artifact_id", "start_ms"]
    rest = [c for c in windows.columns if c not in keys]
    newest = windows.groupBy(*keys).agg(F.max(F.struct("ingested_ms", *[c for c in rest if c != "ingested_ms"])).alias("_row"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in windows.columns])


def import_visits(spark: SparkSession, path: str) -> DataFrame:
    """raw: browser visits from ``.json`` (object or array) or ``.jsonl`` (blank lines skipped)."""
    if path.lower().endswith(".jsonl"):
        lines = spark.read.text(path).select(F.col("value").alias("raw"))
        return lines.where(F.trim("raw") != "")
    return explode_visits(spark.read.text(path, wholetext=True).select(F.col("value").alias("text")))


def explode_visits(files: DataFrame) -> DataFrame:
    """Elements of a JSON array, or the object itself."""
    items = F.when(F.json_object_keys("text").isNotNull(), F.array("text")).otherwise(
        F.from_json("text", "array<string>")
    )
    return files.select(F.explode(items).alias("raw"))


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """name, value, number: telemetry counters ``<map><int name value/></map>``; text that is no integer keeps a NULL number."""
    rows = spark.read.format("xml").option("rowTag", "map").option("valueTag", "_text").schema(
        "int array<struct<_name:string,_value:string>>"
    ).load(path)
    return rows.select(F.explode("int").alias("c")).select(
        F.col("c._name").alias("name"), F.col("c._value").alias("value"), F.col("c._value").try_cast("bigint").alias("number")
    )

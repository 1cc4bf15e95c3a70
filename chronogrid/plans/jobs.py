"""Jobs that compose the operators: windows, compaction, journal and the nightly chain."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chronogrid.constants import DEFAULT_SPANS, DIVERSITY_MAX, LOSS_MAX, MIN_COVERAGE, MODALITIES
from chronogrid.functions.ids import page_id
from chronogrid.functions.predicates import is_blank_page
from chronogrid.operators import embedding as emb
from chronogrid.operators import grid, journal, records, rollup, signals, state, views
from chronogrid.sinks import tables
from chronogrid.sources import exports
from chronogrid.sources import records as record_source
from chronogrid.session import cut_lineage
from chronogrid.sources.files import first_existing, path_exists

PRODUCER = "chronogrid"

# Result codes of the nightly chain.
DONE, NOTHING, UNREACHABLE, FAILED, COMPACTION_FAILED = 0, 2, 3, 4, 5

MANIFEST_SCHEMA = (
    "export string, rel_path string, sha256 string, bytes bigint, records_emitted bigint, "
    "status string, error string, processed_at_ms bigint"
)


# --- windows from an export (M-03) ----------------------------------------------


def read_export(spark: SparkSession, root: str, device: str, offset_mode: str = "reference") -> dict:
    """Typed rows of every modality in one export folder, the file table and the rejected rows; each JSON file is read once.

    Rows whose interval is no measurement are parted off with their reason.
    Typed rows are persisted, since windows and manifest both read them.
    """
    files = exports.scan_export(spark, root).persist()
    kinds = {r["kind"]: r["count"] for r in files.groupBy("kind").count().collect()}  # at most seven names
    base = root.rstrip("/")
    out = {
        "bins": exports.parse_hr_bins(exports.items_of(files, "hr_json", exports.HR_FIELDS)),
        "hrv": exports.parse_hrv_windows(exports.items_of(files, "hrv_json", exports.HRV_FIELDS)),
        "stress": spark.createDataFrame([], "start_ms bigint, end_ms bigint, score double, source_file string"),
        "sleep": spark.createDataFrame([], "start_ms bigint, end_ms bigint, stage_code bigint, source_file string"),
    }
    if "stress" in kinds:
        out["stress"] = exports.stress_sheet(exports.sheet_lines(spark, f"{base}/{exports.STRESS_CSV}"), offset_mode, kinds["stress"])
    if "sleep_stage" in kinds:
        lines = exports.sheet_lines(spark, f"{base}/{exports.SLEEP_STAGE_CSV}")
        out["sleep"] = exports.sleep_stage_sheet(lines, offset_mode, kinds["sleep_stage"])
    fit, rejected = {"held": [files]}, None
    for name, rows in out.items():
        held = rows.withColumn("device", F.lit(device)).persist()
        fit["held"].append(held)
        fit[name], odd = grid.split_intervals(held)
        odd = odd.select(F.lit(name).alias("modality"), "device", "start_ms", "end_ms", "source_file", "reason")
        rejected = odd if rejected is None else rejected.unionByName(odd)
    return {**fit, "files": files, "rejected": rejected}


def release(parts: dict) -> None:
    for rows in parts["held"]:
        rows.unpersist()


def file_manifest(export: str, parts: dict, now_ms: int) -> DataFrame:
    """One row per discovered file: hash, records emitted, status and error."""

    def plain(path: str) -> Column:
        return F.regexp_replace(path, "^file:/+", "/").alias("path")

    rows = parts["bins"].select(plain("source_file"))
    for name in ("hrv", "stress", "sleep"):
        rows = rows.union(parts[name].select(plain("source_file")))
    counted = rows.groupBy("path").agg(F.count(F.lit(1)).alias("records"))
    files = parts["files"].where("kind <> 'unknown'").select(plain("path"), "rel_path", "sha256", "bytes", "bad_json")
    known = files.join(counted, "path", "left").withColumn("export", F.lit(export))
    error = F.when(F.col("bad_json"), F.lit("not JSON"))
    return state.manifest_rows(known, F.coalesce("records", F.lit(0)), error, now_ms)


def produce(
    spark: SparkSession,
    export_root: str,
    store: str,
    device: str,
    now_ms: int,
    export: str = "",
    manifest_path: str | None = None,
    max_windows: int = 0,
    rows_per_file: int = 0,
    offset_mode: str = "reference",
    rejects: str | None = None,
) -> DataFrame:
    """Export folder to window records in ``store``; returns one row of run counters.

    Records are added by source, device, id and start: other exports and devices
    in the store stay, a second run of one export replaces its own windows. With
    a manifest the run is skipped when no file is new or changed. Rows with an
    absurd interval are counted and, with ``rejects``, added to that folder.
    """
    export = export or export_root.rstrip("/").rsplit("/", 1)[-1]
    parts = read_export(spark, export_root, device, offset_mode)
    manifest = cut_lineage(file_manifest(export, parts, now_ms))
    if manifest_path:
        stored = tables.read_table(spark, manifest_path, spark.createDataFrame([], MANIFEST_SCHEMA).schema)
        due = state.needs_processing(manifest, stored, ["export", "rel_path"])
        if not due.head(1):
            release(parts)
            return manifest.agg(
                F.count(F.lit(1)).alias("files"), F.lit(0).cast("bigint").alias("files_due"),
                F.lit(0).cast("bigint").alias("windows_emitted"),
            )
    n_rejected = parts["rejected"].count()
    if rejects and n_rejected:
        parts["rejected"].withColumn("export", F.lit(export)).write.mode("append").parquet(rejects)
    windows = signals.produce_windows(parts["bins"], parts["hrv"], parts["stress"], parts["sleep"])
    kept = rollup.first_windows(windows, max_windows) if max_windows else windows
    seen = Observation()
    counters = views.window_counter_columns(MODALITIES)
    rows = rollup.window_records(kept.observe(seen, *counters), PRODUCER, export=export)
    accepted = rows.withColumn("ingestStatus", F.lit("accepted")).withColumn("ingestedAtEpochMs", F.lit(now_ms).cast("bigint"))
    tables.upsert_records(accepted, store, rows_per_file)
    if manifest_path:
        tables.upsert_table(
            spark, manifest_path, manifest.withColumn("arrival", F.col("processed_at_ms")), ["export", "rel_path"], ["export"]
        )
    release(parts)
    totals = manifest.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "error").alias("files_error")
    )
    totals = totals.withColumn("records_rejected", F.lit(n_rejected).cast("bigint"))
    return totals.select("*", *[F.lit(n).cast("bigint").alias(name) for name, n in seen.get.items()])


# --- compaction (M-02) -------------------------------------------------------------


def compact(
    spark: SparkSession,
    raw_root: str,
    rollup_root: str,
    out_dir: str,
    generated_at: str,
    spans: Iterable[str] = DEFAULT_SPANS,
    min_coverage: float = MIN_COVERAGE,
    source: str | None = None,
    device_alias: str = "",
    layout: str = "lines",
    parquet: bool = True,
) -> DataFrame:
    """Window records to rollup records and flat Parquet; returns one row of counters.

    An empty store gives zeros. The rollup records are written first, so a
    failing Parquet export loses nothing.
    """
    spans = tuple(spans)
    schema = "windows_loaded bigint, rollups_built bigint, partial_rollups bigint, parquet_ok boolean"
    loaded = record_source.parse_windows(record_source.scan_records(spark, raw_root, source, layout, ordered=False))
    windows = record_source.newest_windows(loaded).persist()
    count = windows.count()
    if count == 0:
        return spark.createDataFrame([(0, 0, 0, False)], schema)
    built = rollup.build_rollups(windows, spans, min_coverage, with_members=True).persist()
    if not device_alias:
        first = windows.where("device <> ''").agg(F.min_by("device", F.struct("start_ms", "artifact_id"))).scalar()
        alias = F.coalesce(first, F.lit("unknown"))
    else:
        alias = F.lit(device_alias)
    rows = rollup.rollup_records(built.withColumn("_alias", alias), F.col("_alias"), PRODUCER, min_coverage=min_coverage)
    tables.write_records(rows, rollup_root, "source")
    ok = False
    if parquet:
        try:
            tables.write_flat(rollup.flat_windows(windows), f"{out_dir}/windows.parquet", "windows", generated_at)
            tables.write_flat(rollup.flat_rollups(built), f"{out_dir}/rollups.parquet", "rollups", generated_at)
            ok = True
        except Exception as error:  # the records above are the source of truth
            print(f"parquet export failed: {error}")
    any_partial = F.greatest(*[F.col(f"partial_{m}") for m in MODALITIES])
    totals = built.agg(F.count(F.lit(1)).alias("rollups_built"), F.count_if(any_partial).alias("partial_rollups")).first()
    built.unpersist()
    windows.unpersist()
    return spark.createDataFrame([(count, totals["rollups_built"], totals["partial_rollups"], ok)], schema)


# --- nightly chain (M-04) ------------------------------------------------------------


def nightly(
    spark: SparkSession, export_root: str, work_dir: str, device: str, now_ms: int, generated_at: str,
    spans: Iterable[str] = DEFAULT_SPANS, manifest_path: str | None = None, offset_mode: str = "reference",
) -> DataFrame:
    """Producer, then compaction; the result row carries a code and the failing stage."""
    schema = "code int, stage string, windows bigint, rollups bigint, detail string"

    def result(code: int, stage: str, windows: int = 0, rollups: int = 0, detail: str = "") -> DataFrame:
        return spark.createDataFrame([(code, stage, windows, rollups, detail)], schema)

    if first_existing(spark, export_root) is None:
        return result(UNREACHABLE, "source", detail="export folder cannot be read")
    try:
        produced = produce(spark, export_root, f"{work_dir}/raw", device, now_ms, manifest_path=manifest_path, offset_mode=offset_mode).first()
    except Exception as error:
        return result(FAILED, "producer", detail=str(error))
    if produced["windows_emitted"] == 0:
        return result(NOTHING, "producer")
    try:
        stats = compact(spark, f"{work_dir}/raw", f"{work_dir}/rollup", f"{work_dir}/data", generated_at, spans).first()
    except Exception as error:
        return result(COMPACTION_FAILED, "compaction", produced["windows_emitted"], detail=str(error))
    return result(DONE, "done", produced["windows_emitted"], stats["rollups_built"])


# --- representation run (E-05, L-03 to L-07) --------------------------------------------


def represent(
    records_in: DataFrame,
    stored_weights: DataFrame | None,
    cadence: str,
    now_ms: int,
    write: Callable[[str, DataFrame], None],
    epochs: int = 25,
    rate: float = 0.05,
    seed: int = 1337,
    loss_max: float = LOSS_MAX,
    diversity_max: float = DIVERSITY_MAX,
    dry_run: bool = False,
) -> DataFrame:
    """One representation run; returns a row with verdict and losses.

    ``records_in``: artifact_id, created_ms, source, payload. The newest record
    validates; a weekly run starts from the last stored weights. ``write`` gets
    the parts of ``embedding.gated_commit``.
    """
    spark = records_in.sparkSession
    schema = "run_id string, verdict string, n_artifacts bigint, first_loss double, final_loss double, val_loss double, warm_start boolean"
    run = f"run-{cadence}-{now_ms}"
    rows = cut_lineage(emb.features(records_in).select("artifact_id", "created_ms", "features"))
    n = rows.count()
    if n == 0:
        return spark.createDataFrame([(run, "skip", 0, None, None, None, False)], schema)
    split = cut_lineage(views.temporal_split(rows))
    warm = emb.last_weights(stored_weights, cadence) if stored_weights is not None and emb.starts_warm(cadence) else None
    weights, losses = emb.train(split.where("is_train"), warm or emb.new_weights(seed), epochs, rate)
    scored = cut_lineage(emb.score(split, emb.default_backend(weights)))
    val_loss = emb.reconstruction_loss(scored.where("is_validation")).first()["loss"]
    order = ["created_ms", "artifact_id"]
    report = emb.quality_report(scored, order, F.lit(losses[-1]), run, loss_max, diversity_max)
    report = report.withColumn("cadence", F.lit(cadence)).withColumn("val_loss", F.lit(val_loss).cast("double"))
    state_rows = emb.weights_rows(spark, weights, cadence, run, now_ms)
    embedded = scored.select("artifact_id", "created_ms", "embedding")
    verdict = emb.gated_commit(cut_lineage(report), embedded, order, run, write, "artifact_id", dry_run, cadence, state_rows, now_ms)
    return spark.createDataFrame([(run, verdict, n, float(losses[0]), float(losses[-1]), val_loss, warm is not None)], schema)


# --- journal (K-01, M-05) --------------------------------------------------------------

Transcriber = Callable[[bytes], dict]


def transcribe(pages: DataFrame, engine: Transcriber, retries: int = 0) -> DataFrame:
    """Apply a page transcriber; a failing page keeps its row with the error text.

    ``pages`` needs ``content``. The engine returns ``text`` and, if it likes, ``latency_ms``.
    """
    kept = [F.col(f"`{c}`") for c in pages.columns if c != "content"]

    # pickled rows: some hundred images are in Python at once, not an Arrow batch of ten thousand
    @F.udf(returnType="ocr_text string, latency_ms bigint, error string", useArrow=False)
    def asked(content: bytearray) -> tuple:
        problem = None
        for _ in range(retries + 1):
            try:
                answer = engine(bytes(content))
                latency = answer.get("latency_ms")
                return answer.get("text", ""), None if latency is None else int(latency), None
            except Exception as error:
                problem = f"{type(error).__name__}: {error}"
        return None, None, problem

    answered = pages.select(*kept, asked.asNondeterministic()("content").alias("_answer"))
    return answered.select(*kept, "_answer.*")


def classify_pages(transcribed: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("error").isNotNull(), F.lit("failed"))
        .when(is_blank_page(F.col("ocr_text")), F.lit("blank"))
        .otherwise(F.lit("new"))
    )
    return transcribed.withColumn("status", status)


def ingest_journal(
    pages: DataFrame, manifest: DataFrame, engine: Transcriber, now_ms: int, force: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, manifest rows to commit, summary) of one journal run.

    ``pages``: note_uuid, page_id, page_order, png_sha256, content, captured_ms. Failed
    pages get no manifest row, so the next run takes them again. Write the
    records first and the manifest rows last.
    """
    due = state.needs_transcription(pages, manifest, force)
    done = classify_pages(transcribe(due, engine)).withColumn("transcribed_ms", F.lit(now_ms).cast("bigint"))
    done = cut_lineage(done)  # written once: a lost executor must not transcribe a page again with another answer
    made = records.page_records(done.where("status = 'new'"), now_ms)
    accepted = state.stamp_batch(made.withColumn("ingest_status", F.lit("accepted")), now_ms)
    commits = done.where("status <> 'failed'").select(
        "note_uuid", "page_id", "png_sha256",
        F.when(F.col("status") == "new", page_id(F.col("note_uuid"), F.col("page_order")))
        .otherwise(F.lit("")).alias("last_artifact_id"),
        (F.col("status") == "blank").alias("blank"),
        F.lit(now_ms).cast("bigint").alias("processed_at_ms"),
    )
    return accepted, commits, journal.run_summary(done)


JOURNAL_MANIFEST = "note_uuid string, page_id string, png_sha256 string, last_artifact_id string, blank boolean, processed_at_ms bigint, shard string"


def seeded_pages(spark: SparkSession, store: str, pages: DataFrame) -> DataFrame:
    """Manifest rows of the pages whose accepted record is already in the store: the cold start of a journal."""
    schema = (
        "artifactId string, ingestStatus string, ingestedAtEpochMs bigint, createdAtEpochMs bigint, "
        "payload struct<noteUuid:string,pageOrder:bigint,pageImage:struct<sha256:string>>"
    )
    stored = record_source.scan_records(spark, store, "journal", layout="lines", ordered=False)
    known = stored.select(F.from_json("raw", schema).alias("r")).where("r.ingestStatus = 'accepted' and r.payload.noteUuid <> ''")
    newest = known.groupBy(F.col("r.payload.noteUuid").alias("note_uuid"), F.col("r.payload.pageOrder").alias("page_order")).agg(
        F.max_by("r", F.struct("r.ingestedAtEpochMs", "r.createdAtEpochMs", "r.artifactId")).alias("r")
    )
    shard = F.substring("note_uuid", 1, 2).alias("shard")
    names = pages.select("note_uuid", F.col("page_order").cast("bigint").alias("page_order"), "page_id").distinct()
    return names.join(newest, ["note_uuid", "page_order"]).select(
        "note_uuid", "page_id", F.coalesce("r.payload.pageImage.sha256", F.lit("")).alias("png_sha256"),
        F.col("r.artifactId").alias("last_artifact_id"), F.lit(False).alias("blank"),
        F.coalesce("r.ingestedAtEpochMs", "r.createdAtEpochMs", F.lit(0)).cast("bigint").alias("processed_at_ms"), shard,
    )


def run_journal(
    spark: SparkSession, pages: DataFrame, store: str, manifest_path: str, engine: Transcriber, now_ms: int, force: bool = False
) -> DataFrame:
    """One whole journal run: cold start, transcription, records, then the manifest; returns the summary.

    Without a manifest it is seeded from the records in the store. Records are
    written before the manifest, both by key, so a run that breaks off in
    between is repeated without loss or double.
    """
    empty = spark.createDataFrame([], JOURNAL_MANIFEST)
    cold = not path_exists(spark, manifest_path)
    if not cold:
        manifest = cut_lineage(tables.read_table(spark, manifest_path, empty.schema))
    else:
        manifest = cut_lineage(seeded_pages(spark, store, pages)) if path_exists(spark, store) else empty
    accepted, commits, summary = ingest_journal(pages, manifest, engine, now_ms, force)
    summary = cut_lineage(summary)
    tables.upsert_records(
        accepted.select(
            F.col("artifact_id").alias("artifactId"), "source", "payload", F.col("created_ms").alias("createdAtEpochMs"),
            F.col("schema_version").alias("schemaVersion"), F.col("device_alias").alias("deviceAlias"),
            F.lit("{}").alias("provenanceMetadataJson"), F.col("ingested_ms").alias("ingestedAtEpochMs"),
            F.col("ingest_status").alias("ingestStatus"),
        ),
        store,
    )
    commits = commits.withColumn("shard", F.substring("note_uuid", 1, 2))
    marks = manifest.unionByName(commits) if cold else commits
    keyed = marks.withColumn("arrival", F.col("processed_at_ms"))
    tables.upsert_table(spark, manifest_path, keyed, ["note_uuid", "page_id"], ["shard"])
    return summary

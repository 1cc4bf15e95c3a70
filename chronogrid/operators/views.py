"""Read-only views over records: artifact_id, source, created_ms, payload."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogrid.constants import SOURCES
from chronogrid.functions.predicates import normalize_source, payload_kind
from chronogrid.operators.ordered import newest_per_group

DAY_MS = 86_400_000

# The selectable time windows.
TIME_WINDOWS = {"all": None, "24h": DAY_MS, "7d": 7 * DAY_MS, "30d": 30 * DAY_MS}


def query_records(
    records: DataFrame,
    source: str | None = None,
    from_ms: int | None = None,
    to_ms: int | None = None,
    kind: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Filtered records in (created, id) order; both time bounds are inclusive."""
    wanted = records
    if source is not None:
        wanted = wanted.where(normalize_source(F.col("source")) == normalize_source(F.lit(source)))
    if from_ms is not None:
        wanted = wanted.where(F.col("created_ms") >= from_ms)
    if to_ms is not None:
        wanted = wanted.where(F.col("created_ms") <= to_ms)
    if kind is not None:
        wanted = wanted.where(payload_kind(F.col("payload")) == kind)
    ordered = wanted.orderBy("created_ms", "artifact_id")
    return ordered if limit is None else ordered.limit(max(limit, 0))


def view_filter(
    records: DataFrame, sources: Iterable[str] | None = None, since_ms: int | None = None, until_ms: int | None = None
) -> DataFrame:
    """Subset of sources (matched as written, lower case) and inclusive time bounds."""
    wanted = records
    names = sorted(set(sources or []))
    if names:
        wanted = wanted.where(F.lower(F.trim("source")).isin(*names))
    if since_ms is not None:
        wanted = wanted.where(F.col("created_ms") >= since_ms)
    if until_ms is not None:
        wanted = wanted.where(F.col("created_ms") <= until_ms)
    return wanted


def is_narrowed(sources: Iterable[str] | None = None, since_ms: int | None = None, until_ms: int | None = None) -> bool:
    return bool(list(sources or [])) or since_ms is not None or until_ms is not None


def relative_filter(records: DataFrame, window: str, now_ms: int, sources: Iterable[str] | None = None) -> DataFrame:
    """Named window back from an injected now; choosing every source is no filter."""
    span = TIME_WINDOWS[window]
    chosen = set(sources or [])
    narrowed = sorted(chosen) if chosen and chosen != set(SOURCES) else None
    return view_filter(records, narrowed, None if span is None else now_ms - span)


def source_kind_cells(records: DataFrame) -> DataFrame:
    """Count and newest record per source and kind, with the totals used to order the matrix."""
    keyed = records.select(
        normalize_source(F.col("source")).alias("source"),
        payload_kind(F.col("payload")).alias("kind"),
        "created_ms",
        "artifact_id",
    )
    cells = keyed.groupBy("source", "kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("created_ms").alias("newest_ms"),
        F.max_by("artifact_id", F.struct("created_ms", "artifact_id")).alias("newest_id"),
    )
    totals = cells.groupBy("source").agg(F.sum("n").alias("row_total"))
    kinds = cells.groupBy("kind").agg(F.max("newest_ms").alias("kind_newest_ms"))
    return cells.join(totals, "source").join(kinds, "kind")


def source_kind_pivot(records: DataFrame, kinds: list[str]) -> DataFrame:
    """One column per given kind; absent cells are zero because they are counts."""
    keyed = records.select(
        normalize_source(F.col("source")).alias("source"), payload_kind(F.col("payload")).alias("kind")
    )
    return keyed.groupBy("source").pivot("kind", kinds).count().na.fill(0)


def _source_dimension(df: DataFrame) -> DataFrame:
    names = F.explode(F.array(*[F.lit(s) for s in sorted(SOURCES)]))
    return df.sparkSession.range(1).select(names.alias("source"))


def source_timeline(records: DataFrame, newest: int = 5, raw_sources: bool = False) -> DataFrame:
    """Per source: count, first, last and the newest ids; every known source is listed."""
    name = F.lower(F.trim("source")) if raw_sources else normalize_source(F.col("source"))
    keyed = records.select(name.alias("source"), "created_ms", "artifact_id")
    stats = keyed.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.min("created_ms").alias("first_ms"), F.max("created_ms").alias("last_ms")
    )
    top = newest_per_group(keyed, ["source"], [F.desc("created_ms"), F.asc("artifact_id")], newest)
    listed = top.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("rank", "artifact_id"))).alias("top"))
    rows = _source_dimension(records).join(stats, "source", "full").join(listed, "source", "left")
    return rows.select(
        "source",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        "first_ms",
        "last_ms",
        F.transform(F.coalesce("top", F.array().cast("array<struct<rank:bigint,artifact_id:string>>")), lambda t: t["artifact_id"]).alias("newest_ids"),
    )


def activity_histogram(records: DataFrame, now_ms: int, days: int = 14) -> DataFrame:
    """Records per UTC day up to the day of ``now_ms``; quiet days count zero."""
    today = now_ms // DAY_MS
    first = today - days + 1
    day = F.floor(F.col("created_ms") / F.lit(DAY_MS)).cast("bigint")
    counts = (
        records.where((F.col("created_ms") >= first * DAY_MS) & (F.col("created_ms") < (today + 1) * DAY_MS))
        .groupBy(day.alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    spine = records.sparkSession.range(first, today + 1).select(F.col("id").alias("day"))
    joined = spine.join(counts, "day", "left")
    return joined.select(
        F.date_format(F.timestamp_millis(F.col("day") * F.lit(DAY_MS)), "yyyy-MM-dd").alias("day"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def overview_totals(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count(F.lit(1)).alias("total"),
        F.sort_array(F.collect_set(normalize_source(F.col("source")))).alias("active_sources"),
        F.max("created_ms").alias("last_activity_ms"),
    )


def pair_runs(reports: DataFrame, embeddings: DataFrame, first_by: list[str]) -> DataFrame:
    """Each report with the first embedding of its run, newest first.

    ``reports``: run_id, artifact_id, created_ms, verdict ...; ``embeddings``: run_id,
    artifact_id, n_windows, embedding_dim and the ``first_by`` order columns. A run
    with very many embeddings collapses to one row in every task before the join.
    """
    key = F.coalesce("run_id", "artifact_id").alias("run_id")
    first = embeddings.select(
        key, F.col("artifact_id").alias("embedding_id"), "n_windows", "embedding_dim", *first_by
    ).groupBy("run_id").agg(
        F.min_by(F.struct("embedding_id", "n_windows", "embedding_dim"), F.struct(*first_by)).alias("e")
    )
    named = reports.withColumnRenamed("artifact_id", "report_id").withColumn(
        "run_id", F.coalesce("run_id", "report_id")
    )
    joined = named.join(first, "run_id", "left")
    return joined.select(
        *named.columns,
        F.col("e.embedding_id").alias("embedding_id"),
        F.col("e.n_windows").alias("n_windows"),
        F.col("e.embedding_dim").alias("embedding_dim"),
        F.col("e").isNotNull().alias("embedding_committed"),
    ).orderBy(F.desc("created_ms"), "report_id")


def verdict_counts(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count_if(F.col("verdict") == "pass").alias("pass_count"),
        F.count_if(F.col("verdict") == "fail").alias("fail_count"),
        F.max_by("verdict", F.struct("created_ms", "report_id")).alias("latest_verdict"),
    )


def window_counter_columns(modalities: Iterable[str]) -> list[Column]:
    """Aggregates for ``agg`` or, alongside a write, for ``observe``."""
    each = [F.count_if(F.col(f"present_{m}")).alias(f"windows_{m}") for m in modalities]
    return [F.count(F.lit(1)).alias("windows_emitted"), *each]


def window_counters(windows: DataFrame, modalities: Iterable[str]) -> DataFrame:
    """Windows emitted in total and per modality."""
    return windows.agg(*window_counter_columns(modalities))


def rollup_counters(rollups: DataFrame, modalities: Iterable[str]) -> DataFrame:
    any_partial = F.greatest(*[F.col(f"partial_{m}") for m in modalities])
    return rollups.groupBy("span_id").agg(
        F.count(F.lit(1)).alias("rollups"), F.count_if(any_partial).alias("partial_rollups")
    )


def counter_sums(increments: DataFrame, key: str = "name", amount: str = "amount") -> DataFrame:
    return increments.groupBy(key).agg(F.sum(amount).alias("total"))


def queue_counts(queue: DataFrame, synced: Column) -> DataFrame:
    return queue.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~synced).alias("pending"), F.count_if(synced).alias("sent")
    )


def pending(queue: DataFrame) -> DataFrame:
    return queue.where(~F.col("synced")).orderBy(F.desc("created_ms"), F.desc("artifact_id"))


def by_artifact_id(queue: DataFrame, artifact_id: str) -> DataFrame:
    return queue.where(F.col("artifact_id") == artifact_id).limit(1)


def by_fingerprint(queue: DataFrame, source: str, payload: str, created_ms: int) -> DataFrame:
    same = (F.col("source") == source) & (F.col("payload") == payload) & (F.col("created_ms") == created_ms)
    return queue.where(same).limit(1)


def newest_rows(df: DataFrame, section: str, name: Column, moment: Column, n: int) -> DataFrame:
    """The n newest rows of one section as (section, place, name, at_ms)."""
    return _placed(df.select(name.cast("string").alias("name"), moment.alias("at_ms")), section, [F.desc("at_ms"), F.desc("name")], n)


def first_names(df: DataFrame, section: str, name: Column, n: int) -> DataFrame:
    rows = df.select(name.cast("string").alias("name"), F.lit(None).cast("bigint").alias("at_ms"))
    return _placed(rows, section, [F.asc("name")], n)


def _placed(rows: DataFrame, section: str, order: list[Column], n: int) -> DataFrame:
    top = rows.orderBy(*order).limit(n).withColumn("section", F.lit(section))
    return newest_per_group(top, ["section"], order, n).select("section", F.col("rank").alias("place"), "name", "at_ms")


def health_rows(summaries: DataFrame, waiting: DataFrame, checkpoints: DataFrame, reports: DataFrame) -> DataFrame:
    """Health facts in long form. Every input has ``name`` and ``at_ms``; reports are named by id.

    Further columns of ``reports`` are metrics: those of the latest report follow as ``metric=value``.
    """
    counts = summaries.agg(F.count(F.lit(1)).alias("at_ms")).select(
        F.lit("snapshot_count").alias("section"), F.lit(1).cast("bigint").alias("place"), F.lit(None).cast("string").alias("name"), "at_ms"
    )
    waiting_count = waiting.agg(F.count(F.lit(1)).alias("at_ms")).select(
        F.lit("pending_count").alias("section"), F.lit(1).cast("bigint").alias("place"), F.lit(None).cast("string").alias("name"), "at_ms"
    )
    name, at = F.col("name"), F.col("at_ms")
    metrics = [c for c in reports.columns if c not in ("name", "at_ms")]
    rows = _health_lists(summaries, waiting, checkpoints, reports, counts, waiting_count, name, at)
    if not metrics:
        return rows
    latest = reports.agg(F.max_by(F.struct("at_ms", *metrics), F.struct("at_ms", "name")).alias("r")).where("r is not null")
    texts = F.array(*[F.concat(F.lit(f"{m}="), F.coalesce(F.col(f"r.{m}").cast("string"), F.lit("null"))) for m in metrics])
    facts = latest.select(F.col("r.at_ms").alias("at_ms"), F.posexplode(texts).alias("at", "name"))
    return rows.unionByName(
        facts.select(F.lit("report_metric").alias("section"), (F.col("at") + 1).cast("bigint").alias("place"), "name", "at_ms")
    )


def _health_lists(summaries, waiting, checkpoints, reports, counts, waiting_count, name, at) -> DataFrame:
    return (
        counts.unionByName(waiting_count)
        .unionByName(newest_rows(summaries, "last_publish", name, at, 1))
        .unionByName(first_names(waiting, "pending", name, 5))
        .unionByName(newest_rows(checkpoints, "checkpoint", name, at, 3))
        .unionByName(newest_rows(reports, "latest_report", name, at, 1))
    )


def summary_snapshot(files: DataFrame, summaries: DataFrame | None = None, first: int = 20, allowed: int = 50) -> DataFrame:
    """Count, bytes, newest time and the first paths, in long form; of ``summaries`` the first ``allowed`` paths too.

    ``files``: path, bytes, modified_ms; ``summaries``: path.
    """
    totals = files.agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("bytes").alias("total_bytes"), F.max("modified_ms").alias("newest_ms")
    )
    facts = totals.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("section"), F.lit(1).cast("bigint").alias("place"),
                             F.lit(None).cast("string").alias("name"), F.col(n).cast("bigint").alias("at_ms"))
                    for n in ("file_count", "total_bytes", "newest_ms")
                ]
            )
        ).alias("r")
    ).select("r.*")
    listed = facts.unionByName(first_names(files, "path", F.col("path"), first))
    if summaries is None:
        return listed
    return listed.unionByName(first_names(summaries, "allowed_summary", F.col("path"), allowed))


def temporal_split(rows: DataFrame, min_train: int = 2) -> DataFrame:
    """Add ``is_train`` and ``is_validation``: the newest row validates.

    One row cannot be split; with too little history all rows train and the newest validates too.
    """
    newest = F.struct("created_ms", "artifact_id") == rows.agg(F.max(F.struct("created_ms", "artifact_id"))).scalar()
    count = rows.agg(F.count(F.lit(1))).scalar()
    many, enough = count > 1, count - 1 >= min_train
    return rows.select(
        *rows.columns,
        (~newest | ~(many & enough)).alias("is_train"),
        (newest & many).alias("is_validation"),
    )

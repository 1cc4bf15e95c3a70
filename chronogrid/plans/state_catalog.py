"""View, state, lineage and journal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronogrid.constants import MODALITIES, NOTE_ID_PREFIX, SOURCES
from chronogrid.functions import ids, predicates
from chronogrid.operators import journal, lineage, rollup, signals, state, views
from chronogrid.operators.ordered import newest_per_group, with_position
from chronogrid.plans import bindings as b
from chronogrid.plans.registry import register

EV = "epoch_us(ts) // 1000"
NOW = b.NOW_MS

# --- events as records ------------------------------------------------------

ARTIFACTS = f"""art AS (SELECT 'ev-' || lpad(event_id::VARCHAR, 12, '0') AS artifact_id, {EV} AS created_ms,
  CASE event_type WHEN 'view' THEN 'mobile' WHEN 'click' THEN 'browser' WHEN 'purchase' THEN 'desktop'
    WHEN 'error' THEN 'journal' ELSE 'other' END AS source,
  CASE event_type WHEN 'view' THEN 'mobile' WHEN 'click' THEN ' Browser_tab' WHEN 'purchase' THEN 'desktop'
    WHEN 'error' THEN 'journal' ELSE 'app_usage' END AS raw_source,
  CASE WHEN k < 25 THEN 'alpha' WHEN k < 50 THEN 'beta' WHEN k < 75 THEN 'gamma' ELSE '(untyped)' END AS kind, user_id, k, value
  FROM (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events))"""


def artifacts(spark, sf_dir):
    event = F.col("event_type")
    source = (
        F.when(event == "view", F.lit("mobile")).when(event == "click", F.lit(" Browser_tab"))
        .when(event == "purchase", F.lit("desktop")).when(event == "error", F.lit("journal"))
        .otherwise(F.lit("app_usage"))
    )
    k = b.k_of(F.col("props"))
    kind = F.when(k < 25, F.lit("alpha")).when(k < 50, F.lit("beta")).when(k < 75, F.lit("gamma"))
    return b.table(spark, sf_dir, "events").select(
        F.concat(F.lit("ev-"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("artifact_id"),
        source.alias("source"),
        b.utc_ms(F.col("ts")).alias("created_ms"),
        F.to_json(F.struct(kind.alias("kind"), k.alias("k"))).alias("payload"),
        "user_id", k.alias("k"), "value",
    )


FROM_MS, TO_MS = 1_705_000_000_000, 1_706_000_000_000


@register(
    "b01_artifact_query",
    f"""WITH {ARTIFACTS} SELECT artifact_id, created_ms FROM art WHERE source = 'browser' AND kind = 'beta'
        AND created_ms BETWEEN {FROM_MS} AND {TO_MS}""",
)
def b01(spark, sf_dir):
    found = views.query_records(artifacts(spark, sf_dir), "BROWSER ", FROM_MS, TO_MS, "beta")
    return found.select("artifact_id", "created_ms")


@register(
    "b02_view_filter",
    f"""WITH {ARTIFACTS} SELECT artifact_id, raw_source AS source, true AS narrowed FROM art
        WHERE lower(trim(raw_source)) IN ('mobile', 'app_usage') AND created_ms BETWEEN {FROM_MS} AND {TO_MS}""",
)
def b02(spark, sf_dir):
    options = {"sources": ["mobile", "app_usage"], "since_ms": FROM_MS, "until_ms": TO_MS}
    found = views.view_filter(artifacts(spark, sf_dir), **options)
    return found.select("artifact_id", "source", F.lit(views.is_narrowed(**options)).alias("narrowed"))


@register(
    "b03_relative_window",
    f"WITH {ARTIFACTS} SELECT artifact_id FROM art WHERE created_ms >= {NOW} - 7 * 86400000",
)
def b03(spark, sf_dir):
    return views.relative_filter(artifacts(spark, sf_dir), "7d", NOW, SOURCES).select("artifact_id")


QUEUE = f"""{ARTIFACTS}, queue AS (SELECT *, k >= 40 AS synced FROM art)"""


def queue(spark, sf_dir):
    return artifacts(spark, sf_dir).withColumn("synced", F.col("k") >= 40)


@register("b11_pending", f"WITH {QUEUE} SELECT artifact_id, created_ms FROM queue WHERE NOT synced")
def b11(spark, sf_dir):
    return views.pending(queue(spark, sf_dir)).select("artifact_id", "created_ms")


@register("b11_by_id", f"WITH {QUEUE} SELECT artifact_id, created_ms, value FROM queue WHERE artifact_id = 'ev-000000000042'")
def b11_id(spark, sf_dir):
    return views.by_artifact_id(queue(spark, sf_dir), "ev-000000000042").select("artifact_id", "created_ms", "value")


@register("b11_by_fingerprint", f"WITH {QUEUE} SELECT artifact_id FROM queue WHERE source = 'journal' AND k = 69 AND created_ms = 1704067207179")
def b11_fingerprint(spark, sf_dir):
    payload = '{"kind":"gamma","k":69}'
    return views.by_fingerprint(queue(spark, sf_dir), "journal", payload, 1704067207179).select("artifact_id")


# --- aggregated views ----------------------------------------------------------


@register(
    "d13_source_kind_matrix",
    f"""WITH {ARTIFACTS}, cells AS (SELECT source, kind, count(*) AS n, max(created_ms) AS newest_ms,
          arg_max(artifact_id, (created_ms, artifact_id)) AS newest_id FROM art GROUP BY ALL)
        SELECT *, sum(n) OVER (PARTITION BY source)::BIGINT AS row_total, max(newest_ms) OVER (PARTITION BY kind) AS kind_newest_ms
        FROM cells""",
)
def d13(spark, sf_dir):
    return views.source_kind_cells(artifacts(spark, sf_dir))


@register(
    "d13_source_kind_pivot",
    f"""WITH {ARTIFACTS} SELECT source, count(*) FILTER (WHERE kind = 'alpha') AS alpha, count(*) FILTER (WHERE kind = 'beta') AS beta,
        count(*) FILTER (WHERE kind = 'gamma') AS gamma, count(*) FILTER (WHERE kind = 'absent') AS absent FROM art GROUP BY source""",
)
def d13_pivot(spark, sf_dir):
    return views.source_kind_pivot(artifacts(spark, sf_dir), ["alpha", "beta", "gamma", "absent"])


@register(
    "d14_source_timeline",
    f"""WITH {ARTIFACTS}, dim AS (SELECT unnest(['browser', 'desktop', 'journal', 'mobile', 'other']) AS source),
        kept AS (SELECT * FROM art WHERE source <> 'desktop'),
        ranked AS (SELECT source, artifact_id, row_number() OVER (PARTITION BY source ORDER BY created_ms DESC, artifact_id) AS r FROM kept),
        top AS (SELECT source, string_agg(artifact_id, ',' ORDER BY r) AS newest_ids FROM ranked WHERE r <= 5 GROUP BY source),
        stats AS (SELECT source, count(*) AS n, min(created_ms) AS first_ms, max(created_ms) AS last_ms FROM kept GROUP BY source)
        SELECT source, coalesce(n, 0) AS n, first_ms, last_ms, coalesce(newest_ids, '') AS newest_ids
        FROM dim LEFT JOIN stats USING (source) LEFT JOIN top USING (source)""",
)
def d14(spark, sf_dir):
    kept = artifacts(spark, sf_dir).where("source <> 'desktop'")
    return views.source_timeline(kept).withColumn("newest_ids", F.array_join("newest_ids", ","))


@register(
    "d15_activity_histogram",
    f"""WITH {ARTIFACTS}, days AS (SELECT unnest(range({NOW} // 86400000 - 13, {NOW} // 86400000 + 1)) AS d)
        SELECT strftime(make_timestamp(d * 86400000000), '%Y-%m-%d') AS day, count(artifact_id) AS n
        FROM days LEFT JOIN art ON created_ms // 86400000 = d GROUP BY d""",
)
def d15(spark, sf_dir):
    return views.activity_histogram(artifacts(spark, sf_dir), NOW)


@register(
    "d16_overview_totals",
    f"""WITH {ARTIFACTS} SELECT count(*) AS total, string_agg(DISTINCT source, ',' ORDER BY source) AS active_sources,
        max(created_ms) AS last_activity_ms FROM art""",
)
def d16(spark, sf_dir):
    return views.overview_totals(artifacts(spark, sf_dir)).withColumn("active_sources", F.array_join("active_sources", ","))


ORDER_MS = "epoch_us(o_orderdate) // 1000"


def reports(spark, sf_dir):
    """Orders as evaluation reports; the run id is absent on open ones."""
    status = F.col("o_orderstatus")
    return b.table(spark, sf_dir, "orders").select(
        F.when(status != "P", F.col("o_orderkey").cast("string")).alias("run_id"),
        F.col("o_orderkey").cast("string").alias("artifact_id"),
        b.utc_ms(F.col("o_orderdate")).alias("created_ms"),
        F.when(status == "F", F.lit("fail")).when(status == "O", F.lit("pass")).otherwise(F.lit("unknown")).alias("verdict"),
        F.col("o_totalprice").alias("final_loss"),
    )


REPORTS = f"""reports AS (SELECT o_orderkey::VARCHAR AS run_id, o_orderkey::VARCHAR AS report_id, {ORDER_MS} AS created_ms,
   CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'O' THEN 'pass' ELSE 'unknown' END AS verdict, o_totalprice AS final_loss FROM orders)"""


@register(
    "c11_report_pairing",
    f"""WITH {REPORTS}, first AS (SELECT * FROM (SELECT l_orderkey::VARCHAR AS run_id,
          l_partkey || '-' || l_suppkey AS embedding_id, l_quantity::BIGINT AS n_windows, row_number() OVER (
            PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1)
        SELECT run_id, report_id, created_ms, verdict, embedding_id, n_windows, CASE WHEN embedding_id IS NOT NULL THEN 8 END::BIGINT AS embedding_dim,
          embedding_id IS NOT NULL AS embedding_committed FROM reports LEFT JOIN first USING (run_id)""",
)
def c11(spark, sf_dir):
    embeddings = b.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"),
        F.concat_ws("-", "l_partkey", "l_suppkey").alias("artifact_id"),
        F.col("l_quantity").cast("bigint").alias("n_windows"),
        F.lit(8).cast("bigint").alias("embedding_dim"),
        "l_linenumber", "l_partkey", "l_suppkey",
    )
    order = ["l_linenumber", "l_partkey", "l_suppkey", "n_windows"]
    embeddings = embeddings.withColumn("first_windows", F.col("n_windows"))
    runs = views.pair_runs(reports(spark, sf_dir), embeddings, order[:3] + ["first_windows"])
    return runs.drop("final_loss")


@register(
    "d17_verdict_counts",
    f"""WITH {REPORTS} SELECT count(*) FILTER (WHERE verdict = 'pass') AS pass_count, count(*) FILTER (WHERE verdict = 'fail') AS fail_count,
        arg_max(verdict, (created_ms, report_id)) AS latest_verdict FROM reports""",
)
def d17(spark, sf_dir):
    return views.verdict_counts(reports(spark, sf_dir).withColumnRenamed("artifact_id", "report_id"))


@register(
    "f03_recent_runs",
    f"WITH {REPORTS} SELECT report_id, created_ms, verdict FROM reports ORDER BY created_ms DESC, report_id LIMIT 5",
)
def f03(spark, sf_dir):
    rows = reports(spark, sf_dir).select(F.col("artifact_id").alias("report_id"), "created_ms", "verdict")
    return rows.orderBy(F.desc("created_ms"), "report_id").limit(5)


@register("f01_ordered_limit", f"WITH {ARTIFACTS} SELECT artifact_id, created_ms FROM art ORDER BY created_ms, artifact_id LIMIT 100")
def f01(spark, sf_dir):
    return views.query_records(artifacts(spark, sf_dir), limit=100).select("artifact_id", "created_ms")


@register("f02_window_order", b.windows_sql() + "SELECT device, start_ms, 'wearable.win.' || canonical_index AS artifact_id FROM win")
def f02(spark, sf_dir):
    rows = b.windows(spark, sf_dir).select(
        "device", "start_ms", ids.window_id(F.col("canonical_index")).alias("artifact_id")
    )
    return rows.orderBy("start_ms", "artifact_id", "device")


@register(
    "f04_first_windows",
    b.windows_sql() + "SELECT canonical_index, device FROM win ORDER BY canonical_index, device LIMIT 250",
)
def f04(spark, sf_dir):
    return rollup.first_windows(b.windows(spark, sf_dir), 250).select("canonical_index", "device")


@register(
    "f05_emit_chunks",
    b.windows_sql()
    + "SELECT canonical_index, device, (row_number() OVER (ORDER BY canonical_index, device) - 1) // 500 AS chunk FROM win",
)
def f05(spark, sf_dir):
    rows = with_position(b.windows(spark, sf_dir).select("canonical_index", "device"), ["canonical_index", "device"])
    return rows.select("canonical_index", "device", F.floor(F.col("position") / 500).cast("bigint").alias("chunk"))


@register(
    "d12_run_counters",
    b.windows_sql() + "SELECT count(*) AS windows_emitted, " + ", ".join(
        f"count(*) FILTER (WHERE present_{m}) AS windows_{m}" for m in MODALITIES
    ) + " FROM win",
)
def d12(spark, sf_dir):
    return views.window_counters(b.windows(spark, sf_dir), MODALITIES)


@register(
    "d12_rollup_counters",
    b.rollup_sql() + "SELECT span_id, count(*) AS rollups, count(*) FILTER (WHERE "
    + " OR ".join(f"partial_{m}" for m in MODALITIES) + ") AS partial_rollups FROM roll GROUP BY span_id",
)
def d12_rollups(spark, sf_dir):
    return views.rollup_counters(rollup.build_rollups(b.windows(spark, sf_dir)), MODALITIES)


@register(
    "d19_counter_sums",
    "SELECT event_type AS name, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type",
)
def d19(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), b.k_of(F.col("props")).alias("amount"))
    return views.counter_sums(rows)


@register(
    "d20_queue_counts",
    f"WITH {QUEUE} SELECT count(*) AS total, count(*) FILTER (WHERE NOT synced) AS pending, count(*) FILTER (WHERE synced) AS sent FROM queue",
)
def d20(spark, sf_dir):
    return views.queue_counts(queue(spark, sf_dir), F.col("synced"))


def _top_sql(section: str, where: str, n: int) -> str:
    return f"""SELECT '{section}' AS section, row_number() OVER (ORDER BY {ORDER_MS} DESC, o_orderkey::VARCHAR DESC) AS place,
      o_orderkey::VARCHAR AS name, {ORDER_MS} AS at_ms FROM orders WHERE {where} QUALIFY place <= {n}"""


@register(
    "d23_health_rows",
    f"""SELECT 'snapshot_count' AS section, 1::BIGINT AS place, NULL::VARCHAR AS name, count(*) AS at_ms FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'pending_count', 1, NULL, count(*) FROM orders WHERE o_orderstatus = 'P'
    UNION ALL {_top_sql('last_publish', "o_orderstatus = 'F'", 1)}
    UNION ALL SELECT 'pending', row_number() OVER (ORDER BY o_orderkey::VARCHAR) AS place, o_orderkey::VARCHAR, NULL
      FROM orders WHERE o_orderstatus = 'P' QUALIFY place <= 5
    UNION ALL {_top_sql('checkpoint', "o_orderstatus = 'O'", 3)}
    UNION ALL {_top_sql('latest_report', "o_orderpriority = '1-URGENT'", 1)}
    UNION ALL SELECT 'report_metric', m.place, CASE m.place WHEN 1 THEN 'verdict=' || o_orderstatus WHEN 2 THEN 'n_artifacts=' || o_custkey
      ELSE 'cadence=' || o_orderpriority END, at_ms FROM (SELECT *, {ORDER_MS} AS at_ms FROM orders WHERE o_orderpriority = '1-URGENT'
        QUALIFY row_number() OVER (ORDER BY {ORDER_MS} DESC, o_orderkey::VARCHAR DESC) = 1), (VALUES (1::BIGINT), (2), (3)) m(place)""",
)
def d23(spark, sf_dir):
    rows = b.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("name"), b.utc_ms(F.col("o_orderdate")).alias("at_ms"),
        "o_orderstatus", "o_orderpriority", "o_custkey",
    )
    reports = rows.where("o_orderpriority = '1-URGENT'").select(
        "name", "at_ms", F.col("o_orderstatus").alias("verdict"), F.col("o_custkey").alias("n_artifacts"), F.col("o_orderpriority").alias("cadence")
    )
    return views.health_rows(
        rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'P'"), rows.where("o_orderstatus = 'O'"), reports
    )


@register(
    "e03_newest_per_group",
    f"""WITH {ARTIFACTS} SELECT user_id, artifact_id, row_number() OVER (PARTITION BY user_id ORDER BY created_ms DESC, artifact_id) AS rank
        FROM art QUALIFY rank <= 3""",
)
def e03(spark, sf_dir):
    top = newest_per_group(artifacts(spark, sf_dir), ["user_id"], [F.desc("created_ms"), F.asc("artifact_id")], 3)
    return top.select("user_id", "artifact_id", "rank")


@register(
    "e05_temporal_split",
    f"""WITH {ARTIFACTS} SELECT artifact_id, row_number() OVER (ORDER BY created_ms DESC, artifact_id DESC) > 1 AS is_train,
        row_number() OVER (ORDER BY created_ms DESC, artifact_id DESC) = 1 AS is_validation FROM art""",
)
def e05(spark, sf_dir):
    rows = artifacts(spark, sf_dir).select("artifact_id", "created_ms")
    return views.temporal_split(rows).select("artifact_id", "is_train", "is_validation")


@register(
    "e06_page_ordinal",
    "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY lpad(turn::VARCHAR, 6, '0') || '.png') AS page_order FROM conversations",
)
def e06(spark, sf_dir):
    pages = b.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("note_uuid"), "turn",
        F.concat(F.lpad(F.col("turn").cast("string"), 6, "0"), F.lit(".png")).alias("file_name"),
    )
    return journal.page_ordinals(pages).select(F.col("note_uuid").alias("conv_id"), "turn", "page_order")


@register(
    "e07_latest_pickers",
    f"""WITH {ARTIFACTS} SELECT source AS picker, arg_max(artifact_id, (created_ms, artifact_id)) AS newest_id, max(created_ms) AS newest_ms
        FROM art WHERE source IN ('browser', 'mobile') GROUP BY source
        UNION ALL SELECT 'any', arg_max(artifact_id, (created_ms, artifact_id)), max(created_ms) FROM art""",
)
def e07(spark, sf_dir):
    rows = artifacts(spark, sf_dir)
    source = predicates.normalize_source(F.col("source"))
    newest = [
        F.max_by("artifact_id", F.struct("created_ms", "artifact_id")).alias("newest_id"),
        F.max("created_ms").alias("newest_ms"),
    ]
    per_app = rows.where(source.isin("browser", "mobile")).groupBy(source.alias("picker")).agg(*newest)
    overall = rows.agg(*newest).select(F.lit("any").alias("picker"), "newest_id", "newest_ms")
    return per_app.unionByName(overall)


@register(
    "a26_summary_snapshot",
    """SELECT 'file_count' AS section, 1::BIGINT AS place, NULL::VARCHAR AS name, count(*) AS at_ms FROM documents
    UNION ALL SELECT 'total_bytes', 1, NULL, sum(n_chars)::BIGINT FROM documents
    UNION ALL SELECT 'newest_ms', 1, NULL, max(doc_id) FROM documents
    UNION ALL SELECT 'path', row_number() OVER (ORDER BY p) AS place, p, NULL
      FROM (SELECT source || '/' || doc_id || '.json' AS p FROM documents) QUALIFY place <= 20
    UNION ALL SELECT 'allowed_summary', row_number() OVER (ORDER BY p) AS place, p, NULL
      FROM (SELECT source || '/' || doc_id || '.json' AS p FROM documents WHERE lang = 'en') QUALIFY place <= 50""",
)
def a26(spark, sf_dir):
    files = b.table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("path"),
        F.col("n_chars").alias("bytes"), F.col("doc_id").alias("modified_ms"), "lang",
    )
    return views.summary_snapshot(files.drop("lang"), files.where("lang = 'en'").select("path"))


# --- keyed state ---------------------------------------------------------------


@register(
    "a20_keyed_upsert",
    f"""WITH target AS (SELECT 'other' AS source, doc_id::VARCHAR AS artifact_id, n_chars AS created_ms, 'old' AS payload, 'accepted' AS ingest_status FROM documents),
        batch AS (SELECT d.n_chars AS created_ms, l.doc_id::VARCHAR AS artifact_id, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id)),
        incoming AS (SELECT 'other' AS source, artifact_id, created_ms, 'toxic=' || toxic AS payload FROM batch)
        SELECT t.source, t.artifact_id, t.created_ms, coalesce(i.payload, t.payload) AS payload, t.ingest_status
        FROM target t LEFT JOIN incoming i USING (source, artifact_id, created_ms)
        UNION ALL SELECT 'mobile', artifact_id, {NOW}, 'new', 'accepted' FROM batch WHERE quality = 0""",
)
def a20(spark, sf_dir):
    """Documents are the store; labels arrive as a batch with two writes per key and some new records."""
    docs = b.table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    target = docs.select(
        predicates.normalize_source(F.col("source")).alias("source"),
        F.col("doc_id").cast("string").alias("artifact_id"), F.col("n_chars").alias("created_ms"),
        F.lit("old").alias("payload"), F.lit("accepted").alias("ingest_status"),
    )
    batch = b.table(spark, sf_dir, "labels").join(docs, "doc_id")
    versions = F.array(
        F.struct(F.lit("").alias("source"), F.col("n_chars").alias("created_ms"),
                 F.concat(F.lit("quality="), F.col("quality").cast("string")).alias("payload"), F.lit(1).alias("arrival")),
        F.struct(F.lit("Other").alias("source"), F.col("n_chars").alias("created_ms"),
                 F.concat(F.lit("toxic="), F.col("toxic").cast("string")).alias("payload"), F.lit(2).alias("arrival")),
        F.when(F.col("quality") == 0,
               F.struct(F.lit("MOBILE").alias("source"), F.lit(None).cast("bigint").alias("created_ms"),
                        F.lit("new").alias("payload"), F.lit(3).alias("arrival"))),
    )
    incoming = batch.select(
        F.col("doc_id").cast("string").alias("artifact_id"), F.explode(F.array_compact(versions)).alias("v")
    ).select("artifact_id", "v.*")
    return state.keyed_upsert(target, state.stamp_batch(incoming, NOW))


_SHA = """files AS (SELECT doc_id, sha256(text) AS sha FROM documents),
manifest AS (SELECT doc_id, CASE WHEN quality = 0 THEN '' WHEN toxic = 1 THEN 'stale' ELSE sha END AS sha
  FROM labels JOIN files USING (doc_id))"""


def doc_files(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select(
        F.lit("docs").alias("export"), F.col("doc_id").cast("string").alias("rel_path"),
        F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("bytes"), "doc_id",
    )


def doc_manifest(spark, sf_dir):
    stored = F.when(F.col("quality") == 0, F.lit("")).when(F.col("toxic") == 1, F.lit("stale")).otherwise(F.col("sha256"))
    return b.table(spark, sf_dir, "labels").join(doc_files(spark, sf_dir), "doc_id").select(
        "export", "rel_path", stored.alias("sha256"), "bytes", "quality", "toxic", "doc_id"
    )


@register(
    "c07_manifest_delta",
    f"WITH {_SHA} SELECT f.doc_id FROM files f LEFT JOIN manifest m ON m.doc_id = f.doc_id AND m.sha = f.sha AND m.sha <> '' WHERE m.doc_id IS NULL",
)
def c07(spark, sf_dir):
    due = state.needs_processing(doc_files(spark, sf_dir), doc_manifest(spark, sf_dir), ["export", "rel_path"])
    return due.select("doc_id")


@register(
    "c08_page_delta",
    f"""WITH {_SHA} SELECT f.doc_id FROM files f LEFT JOIN (SELECT m.*, l.quality, l.toxic FROM manifest m JOIN labels l USING (doc_id)) m USING (doc_id)
        WHERE m.doc_id IS NULL OR (m.sha <> '' AND m.sha <> f.sha) OR (m.quality = 0 AND m.toxic = 0)""",
)
def c08(spark, sf_dir):
    pages = doc_files(spark, sf_dir).select(
        "doc_id", F.col("export").alias("note_uuid"), F.col("rel_path").alias("page_id"), F.col("sha256").alias("png_sha256")
    )
    manifest = doc_manifest(spark, sf_dir).select(
        F.col("export").alias("note_uuid"), F.col("rel_path").alias("page_id"), F.col("sha256").alias("png_sha256"),
        F.when(F.col("quality") == 0, F.lit("")).otherwise(F.col("rel_path")).alias("last_artifact_id"),
        (F.col("toxic") == 1).alias("blank"),
    )
    return state.needs_transcription(pages, manifest).select("doc_id")


@register(
    "c09_not_pushed",
    """WITH pushed AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS sha, n_chars + (toxic = 1)::BIGINT AS bytes FROM documents JOIN labels USING (doc_id))
       SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM pushed p WHERE p.path = d.doc_id::VARCHAR AND p.sha = sha256(d.text) AND p.bytes = d.n_chars)""",
)
def c09(spark, sf_dir):
    files = doc_files(spark, sf_dir).withColumnRenamed("rel_path", "path")
    grown = F.when(F.col("toxic") == 1, F.col("bytes") + 1).otherwise(F.col("bytes"))
    pushed = b.table(spark, sf_dir, "labels").join(files, "doc_id").select("path", "sha256", grown.alias("bytes"))
    return state.not_pushed(files, pushed).select("doc_id")


@register(
    "c10_acknowledge",
    f"""WITH {QUEUE}, acked AS (SELECT DISTINCT artifact_id FROM art WHERE kind = 'alpha' AND source = 'mobile')
        SELECT artifact_id, synced OR artifact_id IN (SELECT artifact_id FROM acked) AS synced FROM queue""",
)
def c10(spark, sf_dir):
    rows = artifacts(spark, sf_dir)
    acked = rows.where((predicates.payload_kind(F.col("payload")) == "alpha") & (F.col("source") == "mobile"))
    twice = acked.select("artifact_id").unionByName(acked.select("artifact_id"))
    return state.acknowledge(queue(spark, sf_dir), twice).select("artifact_id", "synced")


@register(
    "c12_timing_enrichment",
    f"""WITH t AS (SELECT user_id, min({EV}) AS a, max({EV}) AS z, count(*) AS n FROM events GROUP BY user_id)
        SELECT conv_id, turn, a AS first_ms, z AS last_ms, (z - a) // 1000 AS duration_sec, z // 60000 - a // 60000 + 1 AS windows_covered,
          n AS strokes, a IS NOT NULL AS enriched FROM conversations LEFT JOIN t ON user_id = conv_id""",
)
def c12(spark, sf_dir):
    out = journal.enrich_records(journal_rows(spark, sf_dir), journal.note_timing(event_strokes(spark, sf_dir)), NOW)
    return out.select(
        F.col("note_uuid").cast("bigint").alias("conv_id"), "turn",
        F.col("noteTemporal.firstWrittenMs").alias("first_ms"), F.col("noteTemporal.lastEditedMs").alias("last_ms"),
        F.col("noteTemporal.durationSec").alias("duration_sec"),
        F.col("canonicalWindowGrid.windowsCovered").alias("windows_covered"),
        F.col("noteTemporal.totalStrokes").alias("strokes"),
        F.col("provenanceAdded").isNotNull().alias("enriched"),
    )


def journal_rows(spark, sf_dir):
    return b.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("note_uuid"), "turn", "text")


def event_strokes(spark, sf_dir):
    """Events as stroke files: errors are archived, signups lie outside both trees."""
    folder = (
        F.when(F.col("event_type") == "error", F.lit("/stash/archivedShape/"))
        .when(F.col("event_type") == "signup", F.lit("/template/"))
        .otherwise(F.lit("/shape/"))
    )
    note = F.col("user_id").cast("string")
    path = F.concat(F.lit("/notes/"), note, folder, b.utc_ms(F.col("ts")).cast("string"), F.lit(".zip"))
    return journal.strokes(b.table(spark, sf_dir, "events").select(note.alias("note_uuid"), path.alias("path")), "/notes")


_STROKES = f"""strokes AS (SELECT user_id::VARCHAR AS note_uuid, {EV} AS stamp_ms,
  CASE event_type WHEN 'error' THEN 'archived' WHEN 'signup' THEN 'other' ELSE 'live' END AS state FROM events)"""


@register("a13_stroke_paths", f"WITH {_STROKES} SELECT note_uuid, state, stamp_ms FROM strokes")
def a13(spark, sf_dir):
    return event_strokes(spark, sf_dir)


@register(
    "d18_note_timing",
    f"""WITH {_STROKES}, g AS (SELECT note_uuid, min(stamp_ms) AS first_written_ms, max(stamp_ms) AS last_edited_ms,
          min(stamp_ms) FILTER (WHERE state = 'live') AS lf, max(stamp_ms) FILTER (WHERE state = 'live') AS ll,
          count(*) AS total_strokes, count(*) FILTER (WHERE state = 'live') AS live_strokes FROM strokes GROUP BY note_uuid)
        SELECT note_uuid, first_written_ms, last_edited_ms, CASE WHEN live_strokes > 1 THEN lf ELSE first_written_ms END AS modified_start_ms,
          coalesce(ll, last_edited_ms) AS modified_end_ms, total_strokes, live_strokes, total_strokes - live_strokes AS archived_strokes FROM g""",
)
def d18(spark, sf_dir):
    return journal.note_timing(event_strokes(spark, sf_dir))


@register(
    "h22_payload_enrich",
    f"""WITH t AS (SELECT user_id, min({EV}) AS a, max({EV}) AS z FROM events GROUP BY user_id)
        SELECT conv_id, turn, strftime(make_timestamp(a * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS first_iso,
          a // 60000 * 60000 AS first_window_ms, (z // 60000 + 1) * 60000 AS last_window_ms,
          CASE WHEN a IS NOT NULL THEN {NOW} END::BIGINT AS extracted_ms FROM conversations LEFT JOIN t ON user_id = conv_id""",
)
def h22(spark, sf_dir):
    """Enriching twice gives the same blocks as enriching once."""
    timing = journal.note_timing(event_strokes(spark, sf_dir))
    once = journal.enrich_records(journal_rows(spark, sf_dir), timing, NOW)
    twice = journal.enrich_records(once, timing, NOW)
    return twice.select(
        F.col("note_uuid").cast("bigint").alias("conv_id"), "turn",
        F.col("noteTemporal.firstWrittenISO").alias("first_iso"),
        F.col("canonicalWindowGrid.firstWindowStartMsUtc").alias("first_window_ms"),
        F.col("canonicalWindowGrid.lastWindowEndMsUtc").alias("last_window_ms"),
        F.col("provenanceAdded.timestampExtractedAtMs").alias("extracted_ms"),
    )


@register(
    "c13_lineage_edges",
    b.rollup_sql()
    + """SELECT 'wearable.rollup.' || span_seconds || 's.' || span_start_ms AS child_id, 'wearable.win.' || canonical_index AS parent_id,
         'derived' AS edge_type, 'rollup' AS module, span_start_ms AS created_ms, device FROM x""",
)
def c13(spark, sf_dir):
    windows = b.windows(spark, sf_dir).withColumn("artifact_id", ids.window_id(F.col("canonical_index")))
    rolled = rollup.build_rollups(windows, with_members=True)
    return lineage.edges(rolled, "rollup", "span_start_ms", parents="members", keep=["device"])


@register(
    "c14_manifest_seed",
    f"""SELECT conv_id::VARCHAR AS note_uuid, '{NOTE_ID_PREFIX}.' || conv_id || '.p' || (turn + 1) AS last_artifact_id, sha256(text) AS png_sha256,
       turn + 1 AS page_order, 1706000000000 + turn AS last_ocr_at_ms FROM (SELECT *, row_number() OVER (
         PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role <> 'system') WHERE rn = 1""",
)
def c14(spark, sf_dir):
    pages = b.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("note_uuid"), (F.col("turn") + 1).alias("page_order"),
        F.lit("cover").alias("page_source"), F.lit("").alias("source_path"), F.sha2("text", 256).alias("png_sha256"),
        F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit("engine").alias("engine"),
        ids.page_id(F.col("conv_id"), F.col("turn") + 1).alias("artifact_id"),
        F.lit(0).cast("bigint").alias("ingested_ms"), (F.lit(1706000000000) + F.col("turn")).alias("created_ms"),
        F.when(F.col("role") == "system", F.lit("pending")).otherwise(F.lit("accepted")).alias("ingest_status"),
        F.lpad(F.col("turn").cast("string"), 9, "0").alias("path"),
    )
    seeded = state.seed_manifest(pages)
    return seeded.select("note_uuid", "last_artifact_id", "png_sha256", "page_order", "last_ocr_at_ms")


@register(
    "g02_insert_if_missing",
    """WITH stored AS (SELECT DISTINCT source, lang FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
       fresh AS (SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY ALL)
       SELECT source, lang, doc_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1
       UNION ALL SELECT f.source, f.lang, f.doc_id FROM fresh f LEFT JOIN stored s USING (source, lang) WHERE s.lang IS NULL""",
)
def g02(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents").select("source", "lang", "doc_id")
    toxic = b.table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    existing = docs.join(toxic, "doc_id", "left_semi").select("source", "lang", "doc_id")
    return state.insert_if_missing(existing, docs.withColumn("arrival", F.col("doc_id")), ["source", "lang"])


@register(
    "g04_run_equality",
    """WITH l AS (SELECT source, lang, n_chars FROM documents), r AS (SELECT source, CASE WHEN toxic = 1 THEN 'xx' ELSE lang END AS lang, n_chars
         FROM documents LEFT JOIN labels USING (doc_id)),
       c AS (SELECT source, lang, n_chars, sum(s)::BIGINT AS surplus FROM (SELECT *, 1 AS s FROM l UNION ALL SELECT *, -1 FROM r) GROUP BY ALL)
       SELECT * FROM c WHERE surplus <> 0""",
)
def g04(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = b.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    changed = docs.join(labels, "doc_id", "left").withColumn(
        "lang", F.when(F.col("toxic") == 1, F.lit("xx")).otherwise(F.col("lang"))
    )
    left = docs.select("source", "lang", "n_chars", F.lit(1).alias("ingested_ms"))
    return state.run_difference(left, changed.select("source", "lang", "n_chars", F.lit(2).alias("ingested_ms")))


@register(
    "g04_window_rerun",
    f"""WITH {b.SIGNALS_SHARED}, dedup AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device, start_ms // 60000,
            round(bpm, 3), round(bpm_min, 3), round(bpm_max, 3) ORDER BY start_ms, end_ms, seq) AS rn FROM bins) WHERE rn = 1)
        SELECT count(DISTINCT start_ms // 60000) AS windows, count(*) AS bins, 0::BIGINT AS differing FROM dedup""",
)
def g04_rerun(spark, sf_dir):
    """Window payloads do not depend on the order in which bins arrive: size of one run, rows that differ in the other."""

    def run(rows):
        payload = signals.hr_payload(F.col("bpm"), F.col("bpm_min"), F.col("bpm_max"))
        keyed = signals.dedup_bins(rows)
        return keyed.groupBy("device", "canonical_index").agg(payload["bpm"].alias("bpm"), payload["bins"].alias("bins"))

    rows = b.bins(spark, sf_dir, shared=True)
    first = run(rows)
    differing = state.run_difference(first, run(rows.repartition(7, "bpm"))).agg(F.count(F.lit(1))).scalar()
    return first.agg(F.count(F.lit(1)).alias("windows"), F.sum("bins").alias("bins")).select("windows", "bins", differing.alias("differing"))


@register(
    "a28_module_checkpoint",
    f"""SELECT regexp_replace(o_orderpriority, '[^A-Za-z0-9_.-]', '-', 'g') AS module, max({ORDER_MS}) AS completed_ms,
        arg_max(o_orderkey::VARCHAR, ({ORDER_MS}, o_orderkey::VARCHAR)) AS run_id FROM orders GROUP BY 1""",
)
def a28(spark, sf_dir):
    runs = b.table(spark, sf_dir, "orders").select(
        ids.safe_name(F.col("o_orderpriority")).alias("module"), b.utc_ms(F.col("o_orderdate")).alias("completed_ms"),
        F.col("o_orderkey").cast("string").alias("run_id"),
    )
    return state.module_runs(runs)


@register(
    "a27_integrity_decode",
    """SELECT doc_id, CASE WHEN source = 'src0' THEN 'unsafe path' WHEN lang = 'de' THEN 'bad base64' WHEN length(text) = 0 THEN 'empty'
         WHEN lang = 'fr' THEN 'hash mismatch' END AS reason,
       CASE WHEN lang <> 'de' THEN strlen(text) END::BIGINT AS content_bytes FROM documents""",
)
def a27(spark, sf_dir):
    """Documents as uploads: German ones carry broken base64, French ones a wrong hash, src0 an unsafe path."""
    docs = b.table(spark, sf_dir, "documents")
    encoded = F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\s", "")
    folder = F.when(F.col("source") == "src0", F.lit("../")).otherwise(F.lit("docs/"))
    uploads = docs.select(
        "doc_id",
        F.concat(folder, F.col("doc_id").cast("string")).alias("path"),
        F.when(F.col("lang") == "fr", F.sha2("source", 256)).otherwise(F.sha2("text", 256)).alias("sha256"),
        F.when(F.col("lang") == "de", F.concat(F.lit("%"), encoded)).otherwise(encoded).alias("b64"),
    )
    checked = state.check_uploads(uploads, require_png=False, safe=predicates.safe_relative_path(F.col("path")))
    return checked.select("doc_id", "reason", F.length("content").cast("bigint").alias("content_bytes"))


@register("m01_retention", f"WITH {ARTIFACTS} SELECT artifact_id FROM art WHERE created_ms >= {NOW} - 604800000")
def m01(spark, sf_dir):
    return state.drop_older_than(artifacts(spark, sf_dir), NOW - 7 * views.DAY_MS).select("artifact_id")


@register("m01_deleted_count", f"WITH {ARTIFACTS} SELECT count(*) AS deleted FROM art WHERE created_ms < {NOW} - 604800000")
def m01_count(spark, sf_dir):
    return state.count_older_than(artifacts(spark, sf_dir), NOW - 7 * views.DAY_MS)


@register(
    "d24_transcription_summary",
    """SELECT count(*) AS total_pages, count(*) FILTER (WHERE s = 'new') AS pages_new, count(*) FILTER (WHERE s = 'blank') AS blank_pages,
       count(*) FILTER (WHERE s = 'failed') AS failed_pages, count(*) FILTER (WHERE s = 'failed') AS errors
       FROM (SELECT CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 0 THEN 'blank' WHEN quality = 1 THEN 'new' ELSE 'unchanged' END AS s
             FROM documents LEFT JOIN labels USING (doc_id))""",
)
def d24(spark, sf_dir):
    labels = b.table(spark, sf_dir, "labels")
    status = (
        F.when(F.col("toxic") == 1, F.lit("failed")).when(F.col("quality") == 0, F.lit("blank"))
        .when(F.col("quality") == 1, F.lit("new")).otherwise(F.lit("unchanged"))
    )
    pages = b.table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    marked = pages.select(status.alias("status")).withColumn("error", F.when(F.col("status") == "failed", F.lit("timeout")))
    return journal.run_summary(marked)


@register(
    "b19_window_records",
    b.windows_sql()
    + """SELECT 'wearable.win.' || canonical_index AS artifact_id, device, start_ms AS created_ms, 'pending' AS ingest_status,
         heart_rate_bpm AS hr_bpm, sleep_stage_segments AS sleep_segments, present_hrv AS has_hrv,
         (present_heart_rate::INT + present_hrv_proxy::INT + present_hrv::INT + present_stress::INT + present_sleep_stage::INT)::BIGINT AS n_modalities,
         """ + b.rnd("(present_heart_rate::INT + present_hrv_proxy::INT + present_hrv::INT + present_stress::INT + present_sleep_stage::INT) / 5.0::DOUBLE", 4)
    + " AS quality FROM win",
)
def b19(spark, sf_dir):
    rows = rollup.window_records(b.windows(spark, sf_dir), producer="chronogrid")
    rows = rows.withColumn("payload", F.to_json("payload"))
    payload = F.col("payload")
    modalities = F.get_json_object(payload, "$.payload.modalities")
    return rows.select(
        F.col("artifactId").alias("artifact_id"), F.col("deviceAlias").alias("device"),
        F.col("createdAtEpochMs").alias("created_ms"), F.col("ingestStatus").alias("ingest_status"),
        F.get_json_object(modalities, "$.heart_rate.bpm").cast("double").alias("hr_bpm"),
        F.get_json_object(modalities, "$.sleep_stage.segments").cast("bigint").alias("sleep_segments"),
        F.get_json_object(payload, "$.modalities_present.hrv").cast("boolean").alias("has_hrv"),
        F.size(F.json_object_keys(modalities)).cast("bigint").alias("n_modalities"),
        F.get_json_object(payload, "$.quality_metadata.overall_window_quality").cast("double").alias("quality"),
    )

"""Streams over files that Spark cuts from the supplied tables; each result equals the batch one."""

from __future__ import annotations

from pyspark.sql import functions as F


from chronogrid.plans import bindings as b
from chronogrid.plans.registry import register
from chronogrid.plans.source_catalog import doc_inbox
from chronogrid.session import scratch_path
from chronogrid.sinks import tables
from chronogrid.streaming import jobs, rolling

EV = "epoch_us(ts) // 1000"
LATENESS = "40 days"


def inbox(df, label, order, batches=3):
    """Write rows as the files of so many batches of a stream; returns the folder and the files of a batch.

    A batch has as many files as its share of the splits of ``df``, so a task writes
    about a split's rows whatever the input, and the batches stay as many.
    """
    path = scratch_path(df.sparkSession, label)
    share = -(-df.rdd.getNumPartitions() // batches)
    df.repartitionByRange(batches * share, *order).write.parquet(path)
    return path, share


def heart_inbox(spark, sf_dir):
    rows = b.bins(spark, sf_dir).withColumn("ts", F.timestamp_millis("start_ms"))
    path, share = inbox(rows, "inbox", ["start_ms", "seq"])
    return jobs.read_inbox(spark, path, rows.schema, files_per_batch=share)


@register("j01_inbox_drain", f"SELECT event_id, user_id, {EV} AS start_ms, value FROM events")
def j01(spark, sf_dir):
    """Two drains of one inbox: the second finds nothing new."""
    rows = b.table(spark, sf_dir, "events").select("event_id", "user_id", b.utc_ms(F.col("ts")).alias("start_ms"), "value")
    (path, share), out, mark = inbox(rows, "inbox", ["event_id"]), scratch_path(spark, "drained"), scratch_path(spark, "mark")
    for _ in range(2):
        jobs.drain_to_files(jobs.read_inbox(spark, path, rows.schema, files_per_batch=share), out, mark)
    return spark.read.schema(rows.schema).parquet(out)


def _tumbling_sql(ms: int) -> str:
    return f"""WITH {b.SIGNALS} SELECT device, start_ms // {ms} * {ms} AS start_ms, (start_ms // {ms} + 1) * {ms} AS end_ms,
       count(*) AS bins, {b.rnd('avg(bpm)', 3)} AS bpm, min(bpm) AS bpm_min, max(bpm) AS bpm_max FROM bins GROUP BY ALL"""


TUMBLING_COLUMNS = ["device", "start_ms", "end_ms", "bins", "bpm", "bpm_min", "bpm_max"]


def _tumbling(spark, sf_dir, span):
    stream = jobs.tumbling(heart_inbox(spark, sf_dir), span, LATENESS)
    out = scratch_path(spark, "tumbling")
    jobs.drain_to_table(stream, out, scratch_path(spark, "mark"), ["device", "start_ms"], ["day"])
    return spark.read.parquet(out).select(*TUMBLING_COLUMNS)


@register("j02_tumbling_grid", _tumbling_sql(60_000))
def j02(spark, sf_dir):
    return _tumbling(spark, sf_dir, "60 seconds")


@register("j03_tumbling_1h", _tumbling_sql(3_600_000))
def j03_1h(spark, sf_dir):
    return _tumbling(spark, sf_dir, "1 hour")


@register("j03_tumbling_5m", _tumbling_sql(300_000))
def j03_5m(spark, sf_dir):
    return _tumbling(spark, sf_dir, "5 minutes")


@register("j03_tumbling_1d", _tumbling_sql(86_400_000))
def j03_1d(spark, sf_dir):
    return _tumbling(spark, sf_dir, "1 day")


@register(
    "j04_trailing_band",
    f"""WITH {b.SIGNALS_SHARED}, dedup AS (SELECT * FROM (SELECT *, row_number() OVER (
            PARTITION BY device, start_ms // 60000, round(bpm, 3), round(bpm_min, 3), round(bpm_max, 3)
            ORDER BY start_ms, end_ms, seq) AS rn FROM bins) WHERE rn = 1),
        cand AS (SELECT DISTINCT device, start_ms // 60000 AS i FROM dedup),
        band AS (SELECT c.device, c.i, x.bpm - lag(x.bpm) OVER (PARTITION BY c.device, c.i ORDER BY x.start_ms, x.end_ms, x.seq) AS d
          FROM cand c JOIN dedup x ON x.device = c.device AND x.start_ms BETWEEN (c.i - 9) * 60000 AND (c.i + 1) * 60000)
        SELECT device, i AS canonical_index, {b.rnd('sqrt(avg(d * d))', 3)} AS bpm, count(*) AS bins_used FROM band GROUP BY ALL HAVING count(*) >= 2""",
)
def j04(spark, sf_dir):
    rows = b.bins(spark, sf_dir, shared=True)
    path, share = inbox(rows, "inbox", ["start_ms", "seq"], batches=2)
    stream = jobs.read_inbox(spark, path, rows.schema, files_per_batch=share)
    out = scratch_path(spark, "proxy")
    jobs.drain_proxy(stream, scratch_path(spark, "bins"), out, scratch_path(spark, "mark"))
    return spark.read.parquet(out).select("device", "canonical_index", "bpm", "bins_used")


@register(
    "j04_trailing_band_stream",
    f"""WITH {b.SIGNALS_SHARED}, timed AS (SELECT *, start_ms + ((end_ms - start_ms) // 1000) * (end_ms - start_ms) AS arrival FROM bins),
        parted AS (SELECT *, (arrival - (SELECT min(arrival) FROM timed)) * 4 // (SELECT max(arrival) - min(arrival) + 1 FROM timed) AS part FROM timed),
        marks AS (SELECT p.part, (SELECT max(start_ms) - 600000 FROM parted e WHERE e.part < p.part) AS mark FROM (SELECT DISTINCT part FROM parted) p),
        judged AS (SELECT parted.*, coalesce(start_ms <= mark, FALSE) AS late FROM parted JOIN marks USING (part)),
        dedup AS (SELECT * FROM (SELECT *, row_number() OVER (
            PARTITION BY device, start_ms // 60000, round(bpm, 3), round(bpm_min, 3), round(bpm_max, 3)
            ORDER BY start_ms, end_ms, seq) AS rn FROM judged WHERE NOT late) WHERE rn = 1),
        cand AS (SELECT DISTINCT device, start_ms // 60000 AS i FROM dedup
            WHERE (start_ms // 60000 + 1) * 60000 <= (SELECT max(start_ms) FROM bins) - 600000),
        band AS (SELECT c.device, c.i, x.bpm - lag(x.bpm) OVER (PARTITION BY c.device, c.i ORDER BY x.start_ms, x.end_ms, x.seq) AS d
          FROM cand c JOIN dedup x ON x.device = c.device AND x.start_ms BETWEEN (c.i - 9) * 60000 AND (c.i + 1) * 60000)
        SELECT device, i AS canonical_index, {b.rnd('sqrt(avg(d * d))', 3)} AS bpm, count(*) AS bins_used, NULL::BIGINT AS seq, FALSE AS late
        FROM band GROUP BY device, i HAVING count(*) >= 2
        UNION ALL SELECT device, start_ms // 60000, NULL, NULL, seq, TRUE FROM judged WHERE late""",
)
def j04_stream(spark, sf_dir):
    """The same band kept in state and sent once; bins arrive k * k seconds late, in four batches, some behind the watermark."""
    k = F.floor((F.col("end_ms") - F.col("start_ms")) / 1000)
    rows = b.bins(spark, sf_dir, shared=True).withColumn("arrival", F.col("start_ms") + k * k * F.lit(1000))
    low, high = rows.agg(F.min("arrival"), F.max("arrival")).first()
    path, out = scratch_path(spark, "inbox"), scratch_path(spark, "proxy")
    for part in range(4):  # one file after the other, so that the batches come in the order of arrival
        share = F.floor((F.col("arrival") - F.lit(low)) * 4 / F.lit(high - low + 1))
        rows.where(share == part).coalesce(1).write.mode("append").parquet(path)
    stream = jobs.read_inbox(spark, path, rows.schema, files_per_batch=1)
    rolling.drain_stream(rolling.proxy_stream(stream, "10 minutes"), out, scratch_path(spark, "mark"))
    return rolling.read_sent(spark, out).select("device", "canonical_index", "bpm", "bins_used", "seq", "late")


@register("j05_repeat_suppression", f"SELECT event_id, {EV} AS start_ms FROM events")
def j05(spark, sf_dir):
    """Every event is pushed twice, in different files."""
    rows = b.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id")
    twice = rows.withColumn("push", F.explode(F.array(F.lit(0), F.lit(1))))
    (path, share), out = inbox(twice, "inbox", ["push", "event_id"], batches=4), scratch_path(spark, "once")
    stream = jobs.read_inbox(spark, path, twice.schema, files_per_batch=2 * share)
    jobs.drain_to_files(jobs.drop_repeats(stream, ["event_id"], LATENESS), out, scratch_path(spark, "mark"))
    return spark.read.parquet(out).select("event_id", F.unix_millis("ts").alias("start_ms"))


@register(
    "j06_keyed_upsert",
    f"""SELECT user_id::VARCHAR AS artifact_id, event_type AS source, arg_max(event_id, event_id) AS last_event FROM events GROUP BY ALL""",
)
def j06(spark, sf_dir):
    """The newest event of each user and type is what stays."""
    rows = b.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("artifact_id"), F.col("event_type").alias("source"), F.col("event_id").alias("last_event")
    )
    (path, _), out = inbox(rows, "inbox", ["last_event"]), scratch_path(spark, "keyed")
    stream = jobs.read_inbox(spark, path, rows.schema)

    def each(batch, batch_id):
        keyed = batch.withColumn("arrival", F.col("last_event"))
        tables.upsert_table(batch.sparkSession, out, keyed, ["artifact_id", "source"], ["source"])

    jobs.drain_batches(stream, each, scratch_path(spark, "mark"))
    return spark.read.parquet(out).select("artifact_id", "source", "last_event")


@register(
    "j07_late_status",
    f"""WITH obs AS ({b.OBS}) SELECT event_id, k * k * 1000 AS delay_ms, CASE WHEN k * k <= 300 THEN 'ON_TIME' WHEN k * k <= 3600 THEN 'DELAYED' ELSE 'BACKFILLED' END AS status FROM obs""",
)
def j07(spark, sf_dir):
    rows = b.obs(spark, sf_dir).select(
        "event_id", "end_ms", (F.col("end_ms") + F.col("k") * F.col("k") * F.lit(1000)).alias("ingest_ms")
    )
    (path, _), out = inbox(rows, "inbox", ["event_id"]), scratch_path(spark, "late")
    stream = jobs.with_late_status(jobs.read_inbox(spark, path, rows.schema), 300_000, 3_600_000)
    jobs.drain_to_files(stream.select("event_id", "delay_ms", "status"), out, scratch_path(spark, "mark"))
    return spark.read.parquet(out)


@register(
    "j07_touched_buckets",
    f"""WITH {b.SIGNALS}, t AS (SELECT DISTINCT device, start_ms // 3600000 AS hour FROM obs WHERE modality = 'heart_rate' AND k >= 60)
        SELECT device, start_ms // 3600000 AS hour, count(*) AS bins, {b.rnd('avg(bpm)', 3)} AS bpm FROM bins
        SEMI JOIN t ON t.device = bins.device AND t.hour = start_ms // 3600000 GROUP BY ALL""",
)
def j07_touched(spark, sf_dir):
    """Late bins (a minute or longer) rebuild the hours they fall into."""
    from chronogrid.functions.numbers import round_stable
    from chronogrid.functions.timefn import floor_index

    hour = floor_index(F.col("start_ms"), 3_600_000)
    stored = b.bins(spark, sf_dir).withColumn("hour", hour)
    late = b.obs(spark, sf_dir, modality="heart_rate").where("k >= 60").withColumn("hour", hour)

    def rebuild(rows):
        return rows.groupBy("device", "hour").agg(
            F.count(F.lit(1)).alias("bins"), round_stable(F.avg("bpm"), 3).alias("bpm")
        )

    return jobs.recompute_touched(stored, late, ["device", "hour"], rebuild)


@register(
    "j08_commit_after_ingest",
    f"SELECT source AS export, doc_id::VARCHAR AS rel_path, sha256(text) AS sha256, 'processed' AS status, n_chars AS bytes FROM documents",
)
def j08(spark, sf_dir):
    """The first run dies between the records and the manifest; the second takes the batch again."""
    rows = doc_inbox(spark, sf_dir)
    (path, _), mark = inbox(rows, "inbox", ["rel_path"], batches=2), scratch_path(spark, "mark")
    records, manifest = scratch_path(spark, "records"), scratch_path(spark, "manifest")

    def torn(batch, batch_id):
        keyed = batch.select("export", "rel_path", "sha256", "payload", F.lit(batch_id).cast("bigint").alias("arrival"))
        tables.upsert_table(batch.sparkSession, records, keyed, ["export", "rel_path"], ["export"])
        raise RuntimeError("lost before the manifest was written")

    try:
        jobs.drain_batches(jobs.read_inbox(spark, path, rows.schema), torn, mark)
    except Exception as error:
        if "lost before the manifest" not in str(error):
            raise
    jobs.drain_files_with_manifest(jobs.read_inbox(spark, path, rows.schema), records, manifest, mark, b.NOW_MS)
    marks = spark.read.parquet(manifest).select("export", "rel_path", "sha256", "status", "bytes")
    stored = spark.read.parquet(records).select("export", "rel_path", "sha256")
    return marks.join(stored, ["export", "rel_path", "sha256"])


@register(
    "j09_session_windows",
    f"""WITH marked AS (SELECT user_id, {EV} AS ms, CASE WHEN {EV} - lag({EV}) OVER w < 7200000 THEN 0 ELSE 1 END AS fresh
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS s FROM marked)
        SELECT user_id, min(ms) AS start_ms, max(ms) + 7200000 AS end_ms, count(*) AS events FROM grouped GROUP BY user_id, s""",
)
def j09(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").select("user_id", F.timestamp_millis(b.utc_ms(F.col("ts"))).alias("ts"))
    return jobs.sessions(rows, "user_id", "2 hours")


@register(
    "j09_session_stream",
    f"""WITH marked AS (SELECT user_id, {EV} AS ms, CASE WHEN {EV} - lag({EV}) OVER w < 7200000 THEN 0 ELSE 1 END AS fresh
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS s FROM marked),
        closed AS (SELECT user_id, min(ms) AS start_ms, max(ms) + 7200000 AS end_ms, count(*) AS events FROM grouped GROUP BY user_id, s)
        SELECT * FROM closed WHERE end_ms <= (SELECT max(ms) FROM marked) - 600000""",
)
def j09_stream(spark, sf_dir):
    """The same sessions from a stream in append mode: a session appears once, when the watermark has passed its end."""
    rows = b.table(spark, sf_dir, "events").select("user_id", F.timestamp_millis(b.utc_ms(F.col("ts"))).alias("ts"))
    low, high = rows.agg(F.min(F.unix_millis("ts")), F.max(F.unix_millis("ts"))).first()
    path, out = scratch_path(spark, "inbox"), scratch_path(spark, "sessions")
    for part in range(4):  # one file after the other, so that the batches come in the order of time
        share = F.floor((F.unix_millis("ts") - F.lit(low)) * 4 / F.lit(high - low + 1))
        rows.where(share == part).coalesce(1).write.mode("append").parquet(path)
    stream = jobs.read_inbox(spark, path, rows.schema, files_per_batch=1)
    jobs.drain_to_files(jobs.sessions(stream, "user_id", "2 hours", "10 minutes"), out, scratch_path(spark, "mark"))
    return spark.read.parquet(out)

"""Scalar functions, predicates and projections over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronogrid.constants import BROWSER_CATEGORY, BROWSER_NAMES, BROWSER_WORDS, ENVELOPE_KEYS, NOTE_ID_PREFIX, SOURCES
from chronogrid.functions import ids, jsontext, numbers, predicates, timefn, vectors
from chronogrid.operators import records
from chronogrid.operators.grid import journal_span
from chronogrid.plans import bindings as b
from chronogrid.plans.registry import register

EV = "epoch_us(ts) // 1000"


def events(spark, sf_dir):
    return b.table(spark, sf_dir, "events").withColumn("ms", b.utc_ms(F.col("ts")))


# --- time -----------------------------------------------------------------


@register(
    "h01_to_epoch_ms",
    f"""SELECT event_id, {EV} AS from_number, {EV} AS from_text, {EV} AS from_iso, {EV} // 1000 * 1000 AS from_naive,
        CAST(NULL AS BIGINT) AS from_bad FROM events""",
)
def h01(spark, sf_dir):
    ms = F.col("ms")
    return events(spark, sf_dir).select(
        "event_id",
        timefn.to_epoch_ms(ms.cast("string")).alias("from_number"),
        timefn.to_epoch_ms(F.concat(ms.cast("string"), F.lit(".0"))).alias("from_text"),
        timefn.to_epoch_ms(timefn.iso_ms(ms)).alias("from_iso"),
        timefn.to_epoch_ms(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss")).alias("from_naive"),
        timefn.to_epoch_ms(F.col("event_type")).alias("from_bad"),
    )


@register(
    "h02_parse_iso_ms",
    f"SELECT event_id, {EV} AS parsed, {EV} - 7200000 AS with_offset, CAST(NULL AS BIGINT) AS bad FROM events",
)
def h02(spark, sf_dir):
    iso = timefn.iso_ms(F.col("ms"))
    return events(spark, sf_dir).select(
        "event_id",
        timefn.parse_iso_ms(iso).alias("parsed"),
        timefn.parse_iso_ms(F.regexp_replace(iso, "Z$", "+02:00")).alias("with_offset"),
        timefn.parse_iso_ms(F.concat(F.lit("x"), iso)).alias("bad"),
    )


@register(
    "h03_parse_local_time",
    f"""SELECT event_id, {EV} // 1000 * 1000 - 14400000 + CASE WHEN {EV} % 1000 > 500 THEN 1 ELSE 0 END AS added,
        {EV} + 14400000 AS subtracted, CAST(NULL AS BIGINT) AS no_fraction FROM events""",
)
def h03(spark, sf_dir):
    moment = F.timestamp_millis("ms")
    sheet = F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSS")
    offset = F.lit("UTC-0400")
    return events(spark, sf_dir).select(
        "event_id",
        timefn.parse_local_ts_ms(sheet, offset).alias("added"),
        timefn.parse_local_ts_ms(sheet, offset, "utc").alias("subtracted"),
        timefn.parse_local_ts_ms(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"), offset).alias("no_fraction"),
    )


@register("h04_iso_ms", f"SELECT event_id, strftime(make_timestamp({EV} * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM events")
def h04(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", timefn.iso_ms(F.col("ms")).alias("iso"))


@register(
    "h05_format_epoch",
    f"""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' AS utc_text,
        strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS local_text, '—' AS empty_text FROM events""",
)
def h05(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id",
        timefn.format_epoch(F.col("ms")).alias("utc_text"),
        timefn.format_epoch(F.col("ms"), "Asia/Tokyo").alias("local_text"),
        timefn.format_epoch(F.col("ms") * F.lit(0)).alias("empty_text"),
    )


def _rel_sql(now: str) -> str:
    gap = f"CAST(floor(({now} - {EV}) / 1000.0) AS BIGINT)"
    return f"""CASE WHEN abs({gap}) < 60 THEN CASE WHEN {gap} < 0 THEN 'in <1m' ELSE 'just now' END
      ELSE (CASE WHEN {gap} < 0 THEN 'in ' ELSE '' END) ||
       CASE WHEN abs({gap}) < 3600 THEN (abs({gap}) // 60) || 'm'
            WHEN abs({gap}) < 86400 THEN CASE WHEN {gap} < 0
               THEN (abs({gap}) // 3600) || 'h ' || lpad((abs({gap}) % 3600 // 60)::VARCHAR, 2, '0') || 'm'
               ELSE (abs({gap}) // 3600) || 'h' END
            WHEN abs({gap}) < 2592000 THEN (abs({gap}) // 86400) || 'd'
            ELSE (abs({gap}) // 2592000) || 'mo' END
       || (CASE WHEN {gap} < 0 THEN '' ELSE ' ago' END) END"""


MID_MS = 1_705_320_000_000
LATER_MS = 1_715_000_000_000


@register(
    "h06_rel_time",
    f"SELECT event_id, {_rel_sql(str(MID_MS))} AS around_now, {_rel_sql(str(LATER_MS))} AS long_ago FROM events",
)
def h06(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id",
        timefn.rel_time(F.col("ms"), F.lit(MID_MS)).alias("around_now"),
        timefn.rel_time(F.col("ms"), F.lit(LATER_MS)).alias("long_ago"),
    )


@register(
    "h07_window_index",
    f"""SELECT event_id, {EV} // 60000 AS window_index, {EV} // 60000 * 60000 AS snapped,
        CAST(floor(({EV} - 1706000000000) / 60000.0) AS BIGINT) AS shifted_index FROM events""",
)
def h07(spark, sf_dir):
    ms = F.col("ms")
    return events(spark, sf_dir).select(
        "event_id",
        timefn.floor_index(ms).alias("window_index"),
        timefn.snap(ms).alias("snapped"),
        timefn.floor_index(ms - F.lit(1706000000000)).alias("shifted_index"),
    )


_NOTE = f"SELECT user_id, min({EV}) AS a, max({EV}) AS z FROM events GROUP BY user_id"


@register(
    "h09_journal_grid",
    f"""SELECT user_id, a // 60000 AS first_index, z // 60000 AS last_index, z // 60000 - a // 60000 + 1 AS windows_covered,
        a // 60000 * 60000 AS first_window_start_ms, (z // 60000 + 1) * 60000 AS last_window_end_ms,
        greatest(0, (z - a) // 1000) AS duration_sec FROM ({_NOTE})""",
)
def h09(spark, sf_dir):
    notes = events(spark, sf_dir).groupBy("user_id").agg(F.min("ms").alias("a"), F.max("ms").alias("z"))
    span = journal_span(F.col("a"), F.col("z"))
    return notes.select("user_id", *[c.alias(n) for n, c in span.items()])


@register(
    "h10_coercions",
    """SELECT event_id, value AS as_double, trunc(value)::BIGINT AS as_int, 0.0::DOUBLE AS bad_or_zero,
       CAST(NULL AS BIGINT) AS blank_int, json_extract(props, '$.k')::DOUBLE AS json_num FROM events""",
)
def h10(spark, sf_dir):
    k = F.variant_get(F.parse_json("props"), "$.k", "variant")
    return b.table(spark, sf_dir, "events").select(
        "event_id",
        numbers.as_double(F.col("value").cast("string")).alias("as_double"),
        numbers.as_int(F.col("value").cast("string")).alias("as_int"),
        numbers.as_double_or(F.col("event_type")).alias("bad_or_zero"),
        numbers.as_int(F.lit("  ")).alias("blank_int"),
        numbers.json_number(k, F.schema_of_variant(k)).alias("json_num"),
    )


# --- text and ids ------------------------------------------------------------


@register("h13_canonical_json")
def h13(spark, sf_dir):
    payload = F.to_json(F.struct("text", "source", "n_chars", "lang", "doc_id"))
    return b.table(spark, sf_dir, "documents").select(
        "doc_id",
        jsontext.canonical_json(payload).alias("native_json"),
        jsontext.canonical_json_exact(payload).alias("exact_json"),
    )


def _hash_sql(i: int) -> str:
    return f"(('0x' || substr(h, {4 * (i % 16) + 1}, 4))::BIGINT / 65535.0::DOUBLE * 2.0::DOUBLE - 1.0::DOUBLE)"


@register(
    "h14_hash_vector",
    "SELECT doc_id, " + ", ".join(f"{b.rnd(_hash_sql(i), 9)} AS v{i}" for i in range(18))
    + " FROM (SELECT doc_id, sha256(text) AS h FROM documents)",
)
def h14(spark, sf_dir):
    rows = b.table(spark, sf_dir, "documents").select("doc_id", vectors.hash_vector(F.col("text"), 18).alias("v"))
    return rows.select("doc_id", *[numbers.round_stable(F.col("v")[i], 9).alias(f"v{i}") for i in range(18)])


@register("h15_key_count", "SELECT event_id, len(json_keys(props))::BIGINT AS n_keys FROM events")
def h15(spark, sf_dir):
    return b.table(spark, sf_dir, "events").select("event_id", jsontext.n_keys(F.col("props")).alias("n_keys"))


@register(
    "k04_json_shape",
    "SELECT doc_id, 3::BIGINT + (lang = 'en')::BIGINT AS depth, 4::BIGINT + (lang = 'en')::BIGINT AS scalars FROM documents",
)
def k04(spark, sf_dir):
    inner = F.struct("lang", F.when(F.col("lang") == "en", F.array(F.lit(1))).alias("tags"), F.lit(True).alias("flag"))
    payload = F.to_json(F.struct("doc_id", "text", "n_chars", F.array(F.lit(None).cast("string")).alias("none"), inner.alias("info")))
    shape = jsontext.json_facts(payload)
    rows = b.table(spark, sf_dir, "documents").select("doc_id", shape.alias("s"))
    return rows.select("doc_id", F.col("s.depth").alias("depth"), F.col("s.scalars").alias("scalars"))




def _norm_sql(column: str) -> str:
    known = ", ".join(f"'{s}'" for s in SOURCES)
    clean = f"lower(trim({column}))"
    return f"CASE WHEN starts_with({clean}, 'browser') THEN 'browser' WHEN {clean} IN ({known}) THEN {clean} ELSE 'other' END"


ROLE_SOURCE = "CASE role WHEN 'user' THEN ' Mobile ' WHEN 'assistant' THEN 'Browser_tab' ELSE role END"


def role_source():
    return (
        F.when(F.col("role") == "user", F.lit(" Mobile "))
        .when(F.col("role") == "assistant", F.lit("Browser_tab"))
        .otherwise(F.col("role"))
    )


@register(
    "h16_one_hot_source",
    "SELECT conv_id, turn, " + ", ".join(
        f"({_norm_sql('s')} = '{name}')::INTEGER::DOUBLE AS is_{name}" for name in SOURCES
    ) + f" FROM (SELECT conv_id, turn, {ROLE_SOURCE} AS s FROM conversations)",
)
def h16(spark, sf_dir):
    rows = b.table(spark, sf_dir, "conversations")
    hot = vectors.one_hot_source(predicates.normalize_source(role_source()))
    return rows.select("conv_id", "turn", hot.alias("h")).select(
        "conv_id", "turn", *[F.col("h")[i].alias(f"is_{name}") for i, name in enumerate(SOURCES)]
    )


@register(
    "h17_id_builders",
    f"""SELECT event_id, 'wearable.win.' || ({EV} // 60000) AS window_id, 'wearable.rollup.300s.' || ({EV} // 300000 * 300000) AS rollup_id,
        '{NOTE_ID_PREFIX}.' || user_id || '.p' || event_id AS page_id, 'run-ae-weekly-' || ({EV}) AS run_id FROM events""",
)
def h17(spark, sf_dir):
    ms = F.col("ms")
    return events(spark, sf_dir).select(
        "event_id",
        ids.window_id(timefn.floor_index(ms)).alias("window_id"),
        ids.rollup_id(F.lit(300), timefn.snap(ms, 300000)).alias("rollup_id"),
        ids.page_id(F.col("user_id"), F.col("event_id")).alias("page_id"),
        ids.run_id(F.lit("ae"), F.lit("weekly"), ms).alias("run_id"),
    )


@register(
    "h18_safe_name",
    r"SELECT page_id, regexp_replace(url, '[^\pL\pN_.-]', '-', 'g') AS safe, 'module' AS empty_name FROM pages",
)
def h18(spark, sf_dir):
    return b.table(spark, sf_dir, "pages").select(
        "page_id", ids.safe_name(F.col("url")).alias("safe"), ids.safe_name(F.lit("")).alias("empty_name")
    )


@register(
    "h19_note_of_file",
    f"""SELECT note, min(file) AS first_file FROM (SELECT conv_id::VARCHAR AS note,
       '{NOTE_ID_PREFIX}.' || conv_id || '.p' || (turn + 1) || '-' || (1706000000000 + turn) || '.json' AS file FROM conversations) GROUP BY note""",
)
def h19(spark, sf_dir):
    name = F.concat(
        ids.page_id(F.col("conv_id"), F.col("turn") + 1), F.lit("-"),
        (F.lit(1706000000000) + F.col("turn")).cast("string"), F.lit(".json"),
    )
    files = b.table(spark, sf_dir, "conversations").select(name.alias("file"))
    return (
        files.withColumn("note", ids.note_of_file(F.col("file")))
        .where("note is not null").groupBy("note").agg(F.min("file").alias("first_file"))
    )


@register(
    "h20_banner_table",
    r"SELECT doc_id, trim(split_part(regexp_split_to_array(text, '\r\n|\n|\r')[1], ',', 1), ' ' || chr(9)) AS table_name FROM documents",
)
def h20(spark, sf_dir):
    name = ids.banner_table(F.concat(F.lit("\ufeff"), F.col("text")))
    return b.table(spark, sf_dir, "documents").select("doc_id", name.alias("table_name"))


@register(
    "h21_display_summary",
    f"""SELECT event_id, t || ' | source=' || event_type || ' | k=' || json_extract_string(props, '$.k') AS summary,
        t || ' | source=view | ' || left(event_type, 140) AS plain
        FROM (SELECT *, strftime(make_timestamp({EV} * 1000), '%Y-%m-%d %H:%M:%S') AS t FROM events)""",
)
def h21(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id",
        jsontext.record_summary(F.col("ms"), F.col("event_type"), F.col("props")).alias("summary"),
        jsontext.record_summary(F.col("ms"), F.lit("view"), F.col("event_type")).alias("plain"),
    )


@register("h23_pretty_size")
def h23(spark, sf_dir):
    payload = F.to_json(F.struct("doc_id", "lang", "source", "n_chars", "text"))
    rows = b.table(spark, sf_dir, "documents").select("doc_id", jsontext.pretty_size(payload).alias("pretty_chars"))
    return rows


_DOT = "list_sum(list_transform(list_zip(a, p), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
_NA = "sqrt(list_sum(list_transform(a, lambda x: x::DOUBLE * x::DOUBLE)))"
_NP = "sqrt(list_sum(list_transform(p, lambda x: x::DOUBLE * x::DOUBLE)))"


@register(
    "h12_cosine_to_reverse",
    f"""SELECT vec_id, {b.rnd(f'CASE WHEN {_NA} * {_NP} = 0 THEN 0.0 ELSE {_DOT} / ({_NA} * {_NP}) END', 6)} AS cosine
        FROM (SELECT vec_id, embedding AS a, list_reverse(embedding) AS p FROM embeddings)""",
)
def h12(spark, sf_dir):
    rows = b.table(spark, sf_dir, "embeddings")
    value = vectors.cosine(F.col("embedding"), F.reverse("embedding"))
    return rows.select("vec_id", numbers.round_stable(value, 6).alias("cosine"))


# --- predicates ------------------------------------------------------------------


@register(
    "b05_normalize_source",
    f"""SELECT conv_id, turn, {_norm_sql('s')} AS source FROM (SELECT conv_id, turn, {ROLE_SOURCE} AS s FROM conversations)""",
)
def b05(spark, sf_dir):
    rows = b.table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", predicates.normalize_source(role_source()).alias("source"))


@register("b05_normalize_documents", f"SELECT doc_id, {_norm_sql('source')} AS source FROM documents")
def b05_documents(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select("doc_id", predicates.normalize_source(F.col("source")).alias("source"))


@register(
    "b06_envelope_validation",
    "SELECT event_id, CASE WHEN json_extract(props, '$.k') IS NULL THEN 'k' ELSE '' END AS missing_small, "
    f"'{','.join(ENVELOPE_KEYS)}' AS missing_all FROM events",
)
def b06(spark, sf_dir):
    props = F.col("props")
    return b.table(spark, sf_dir, "events").select(
        "event_id",
        F.array_join(predicates.missing_envelope_keys(props, ("k",)), ",").alias("missing_small"),
        F.array_join(predicates.missing_envelope_keys(props), ",").alias("missing_all"),
    )


def report_payload():
    """Orders as derived records: urgent ones are reports, the next ones embeddings, the rest untyped."""
    urgent, high = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "2-HIGH"
    kind = F.when(urgent, "derived.embedding_evaluation_report").when(high, "derived.behavioral_embedding")
    return F.to_json(
        F.struct(
            kind.alias("artifact_type"),
            F.when(~urgent & ~high, F.col("o_orderpriority")).alias("kind"),
            F.when(urgent, F.when(F.col("o_orderstatus") == "F", "FAIL").otherwise("Pass")).alias("verdict"),
        )
    )


@register(
    "b07_kind_predicates",
    """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '(untyped)' ELSE o_orderpriority END AS kind,
       o_orderpriority = '1-URGENT' AS is_report, o_orderpriority = '2-HIGH' AS is_embedding,
       CASE WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN o_orderstatus = 'F' THEN 'fail' ELSE 'pass' END END AS verdict
       FROM orders""",
)
def b07(spark, sf_dir):
    payload = F.col("payload")
    return b.table(spark, sf_dir, "orders").withColumn("payload", report_payload()).select(
        "o_orderkey",
        predicates.payload_kind(payload).alias("kind"),
        predicates.is_report(payload).alias("is_report"),
        predicates.is_embedding(payload).alias("is_embedding"),
        predicates.verdict_of(payload).alias("verdict"),
    )


@register(
    "b10_path_safety",
    r"""SELECT page_id, regexp_full_match(url, '[!-~]{1,128}') AND NOT regexp_matches(url, '[/\\]|\.\.') AS segment_ok,
       regexp_full_match(rel, '[!-~\r\n\t]{1,300}') AND NOT starts_with(rel, '/') AND NOT regexp_matches(rel, '\\|\.\.') AS path_ok,
       starts_with(rel, 'http://') AS prefix_ok, NOT regexp_matches(host, '[/\\]|\.\.') AND regexp_full_match(host, '[!-~]{1,128}') AS host_ok
       FROM (SELECT page_id, url, url AS rel, split_part(url, '/', 3) AS host FROM pages)""",
)
def b10(spark, sf_dir):
    url = F.col("url")
    return b.table(spark, sf_dir, "pages").select(
        "page_id",
        predicates.safe_segment(url).alias("segment_ok"),
        predicates.safe_relative_path(url).alias("path_ok"),
        predicates.allowed_prefix(url, ("http://",)).alias("prefix_ok"),
        predicates.safe_segment(F.split(url, "/")[2]).alias("host_ok"),
    )


def _words_case(table, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(s), '{w}') THEN '{v}'" for w, v in table) + f" ELSE {otherwise} END"


@register(
    "b12_browser_classification",
    f"""SELECT page_id, regexp_matches(lower(s), '{"|".join(BROWSER_WORDS)}') AS is_browser,
        {_words_case(BROWSER_CATEGORY, "'unknown_browser'")} AS category, {_words_case(BROWSER_NAMES, 's')} AS display_name
        FROM (SELECT page_id, url || '/' || (CASE WHEN starts_with(url, 'https') THEN 'Firefox' ELSE '' END) AS s FROM pages)""",
)
def b12(spark, sf_dir):
    secure = F.when(F.col("url").startswith("https"), F.lit("Firefox")).otherwise(F.lit(""))
    name = F.concat(F.col("url"), F.lit("/"), secure)
    return b.table(spark, sf_dir, "pages").select(
        "page_id",
        predicates.is_browser(name).alias("is_browser"),
        predicates.browser_category(name).alias("category"),
        predicates.browser_name(name).alias("display_name"),
    )


@register(
    "b13_metadata_projection",
    """SELECT page_id, 'unknown' AS page_type, CASE WHEN starts_with(url, 'https') THEN 'secure' ELSE 'plain' END AS host_type,
       length(url)::BIGINT AS title_length, greatest(length(html) - 20000, 0)::BIGINT AS dwell_ms, false AS value_logged,
       split_part(url, '/', 3) AS canonical_host FROM pages""",
)
def b13(spark, sf_dir):
    url = F.col("url")
    meta = records.metadata_only(
        host=F.split(url, "/")[2],
        title=url,
        dwell_ms=F.length("html") - F.lit(20000),
        page_type=F.lit(None).cast("string"),
        host_type=F.when(url.startswith("https"), F.lit("Secure")).otherwise(F.lit("PLAIN")),
    )
    rows = b.table(spark, sf_dir, "pages").select("page_id", meta.alias("m"))
    return rows.select(
        "page_id", "m.page_context.page_type", "m.page_context.host_type", "m.page_context.title_length",
        "m.dwell_ms", "m.input_context.value_logged", "m.canonical_host",
    )


@register(
    "b14_coarse_geo",
    f"""SELECT c_custkey, {b.rnd('c_acctbal / 100', 2)} AS lat, {b.rnd('c_acctbal / 50', 2)} AS lon,
        printf('lat%.2f-lon%.2f', {b.rnd('c_acctbal / 100', 2)}, {b.rnd('c_acctbal / 50', 2)}) AS bucket,
        greatest(c_nationkey, 1)::DOUBLE AS accuracy_m FROM customer""",
)
def b14(spark, sf_dir):
    rows = b.table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_acctbal") / 100).alias("latitude"), (F.col("c_acctbal") / 50).alias("longitude"),
        F.col("c_nationkey").alias("accuracy"),
    )
    return records.coarse_location(rows)


@register(
    "b15_connection_state",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN 'disconnected' WHEN o_orderpriority = '1-URGENT' THEN 'wifi'
       WHEN o_orderpriority = '2-HIGH' THEN 'cellular' WHEN o_orderpriority = '5-LOW' THEN 'ethernet' ELSE 'unknown' END AS connection
       FROM orders""",
)
def b15(spark, sf_dir):
    transport = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("wifi"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("cellular"))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("ethernet"))
    )
    state = predicates.connection_state(F.col("o_orderstatus") == "O", transport)
    return b.table(spark, sf_dir, "orders").select("o_orderkey", state.alias("connection"))


@register(
    "b16_blank_pages",
    """SELECT doc_id, upper(replace(trim(text), ' ', '')) IN ('', 'BLANK') AS is_blank,
       upper(replace(trim(CASE lang WHEN 'de' THEN ' bl ank ' ELSE text END), ' ', '')) IN ('', 'BLANK') AS is_blank_marked FROM documents""",
)
def b16(spark, sf_dir):
    marked = F.when(F.col("lang") == "de", F.lit(" bl ank ")).otherwise(F.col("text"))
    return b.table(spark, sf_dir, "documents").select(
        "doc_id",
        predicates.is_blank_page(F.col("text")).alias("is_blank"),
        predicates.is_blank_page(marked).alias("is_blank_marked"),
    )


@register(
    "b17_accepted_only",
    "SELECT d.doc_id, d.source AS note_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND d.source <> ''",
)
def b17(spark, sf_dir):
    status = F.when(F.col("quality") == 1, F.lit("accepted")).otherwise(F.lit("pending"))
    labels = b.table(spark, sf_dir, "labels").select("doc_id", status.alias("ingest_status"))
    rows = b.table(spark, sf_dir, "documents").join(labels, "doc_id")
    return records.accepted_notes(rows, "ingest_status", "source").select("doc_id", F.col("source").alias("note_id"))


@register(
    "b18_page_projection",
    f"""SELECT '{NOTE_ID_PREFIX}.' || conv_id || '.p' || (turn + 1) AS artifact_id, 'journal' AS source,
        CASE WHEN role = 'user' THEN 1706000000000 ELSE 1706000060000 END + turn AS created_ms,
        text AS ocr_text, sha256(text) AS image_sha, (turn + 1)::BIGINT AS page_order, 'pending' AS ingest_status FROM conversations""",
)
def b18(spark, sf_dir):
    captured = F.when(F.col("role") == "user", F.lit(1706000000000) + F.col("turn")).otherwise(F.lit(0))
    pages = b.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("note_uuid"),
        (F.col("turn") + 1).alias("page_order"),
        F.col("text").alias("ocr_text"),
        F.sha2("text", 256).alias("png_sha256"),
        captured.alias("captured_ms"),
        (F.lit(1706000060000) + F.col("turn")).alias("transcribed_ms"),
    )
    out = records.page_records(pages, now_ms=b.NOW_MS)
    return out.select(
        "artifact_id", "source", "created_ms", F.col("payload.ocrText").alias("ocr_text"),
        F.col("payload.pageImage.sha256").alias("image_sha"), F.col("payload.pageOrder").alias("page_order"), "ingest_status",
    )


@register(
    "b20_wire_projection",
    """SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS payload, false AS synced,
       json_extract(props, '$.k')::BIGINT AS read_back FROM events""",
)
def b20(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,bigint>").alias("payload"))
    wire = records.to_wire(rows, ["payload"])
    return wire.select("event_id", "payload", "synced", F.from_json("payload", "k bigint")["k"].alias("read_back"))


@register(
    "b04_record_normalisation",
    f"""SELECT event_id, event_id::VARCHAR AS artifact_id, {EV} AS created_at_ms, {EV} AS ingested_at_ms, '1.0' AS schema_version,
        'unknown' AS device_alias, 'accepted' AS ingest_status, event_type AS extra_type, 'ring' AS extra_alias,
        json_extract(props, '$.k')::VARCHAR AS prov_k FROM events""",
)
def b04(spark, sf_dir):
    """Legacy-named records built from the events, read back through the normaliser; names that only look legacy are extras."""
    raw = F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("artifact_id"),
            F.col("event_type").alias("note"),
            F.lit("mobile").alias("source"),
            timefn.iso_ms(F.col("ms")).alias("created_at"),
            F.lit("ring").alias("device_alias"),
            F.col("props").alias("provenanceMetadataJson"),
        )
    )
    rows = records.normalize_records(events(spark, sf_dir).select("event_id", raw.alias("raw")), "raw", ["event_id"])
    return rows.select(
        "event_id", "artifact_id", "created_at_ms", "ingested_at_ms", "schema_version", "device_alias", "ingest_status",
        F.col("extras")["note"].alias("extra_type"),
        F.col("extras")["device_alias"].alias("extra_alias"),
        F.get_json_object("provenance", "$.k").alias("prov_k"),
    )


@register(
    "b08_visit_validation",
    """SELECT page_id, split_part(url, '/', 3) AS host, CASE WHEN starts_with(url, 'https') THEN
           concat_ws(';', CASE WHEN page_id % 5 = 1 THEN 'canonical_host is missing' END, CASE WHEN page_id % 3 = 1 THEN 'dwell_ms is no integer' END,
             CASE WHEN page_id % 4 = 2 THEN 'provenance.collected_by is missing' END)
         ELSE 'event_type is not browser_visit;' || (SELECT string_agg(f || ' is missing', ';') FROM (VALUES ('schema_version'), ('source_app'),
           ('visit_id'), ('canonical_host'), ('visit_start_ms'), ('visit_end_ms'), ('dwell_ms'), ('provenance'), ('raw_content_blocked')) t(f)) END AS errors
       FROM pages""",
)
def b08(spark, sf_dir):
    """Secure pages are visits, some with a fault in one field or another; the other pages lack nearly every field."""
    checked = records.validate_visits(visit_rows(spark, sf_dir, faulty=True), "raw")
    return checked.select("page_id", "host", F.array_join("errors", ";").alias("errors"))


def visit_rows(spark, sf_dir, faulty=False):
    url, number = F.col("url"), F.col("page_id")
    host = F.split(url, "/")[2]
    start = F.lit(1706000000000) + number
    dwell = F.lit(1500)

    def unless(divisor, rest, value, other=None):
        return F.when(F.lit(faulty) & (number % divisor == rest), other).otherwise(value)

    provenance = F.to_json(
        F.struct(
            unless(4, 2, F.lit("extension")).alias("collected_by"), F.lit("1").alias("collection_version"),
            F.lit("passive").alias("collection_mode"), start.alias("recorded_at_ms"),
        )
    )
    visit = F.to_json(
        F.struct(
            F.lit("1.0").alias("schema_version"),
            F.lit("browser_visit").alias("event_type"),
            F.lit("browser").alias("source_app"),
            F.concat(F.lit("v-"), number.cast("string")).alias("visit_id"),
            url.alias("canonical_url"),
            unless(5, 1, host).alias("canonical_host"),
            start.alias("visit_start_ms"),
            (start + dwell).alias("visit_end_ms"),
            F.parse_json(unless(3, 1, F.lit("1500"), F.lit('"long"'))).alias("dwell_ms"),
            F.parse_json(provenance).alias("provenance"),
            F.lit(False).alias("raw_content_blocked"),
        )
    )
    other = F.to_json(F.struct(F.lit("note").alias("event_type"), number.alias("n")))
    raw = F.when(url.startswith("https"), visit).otherwise(other)
    return b.table(spark, sf_dir, "pages").select("page_id", host.alias("host"), raw.alias("raw"))


@register(
    "b09_visit_to_artifact",
    """SELECT page_id, 'v-' || page_id AS artifact_id, 'browser' AS source, 1706000000000 + page_id AS created_at_ms,
       '1.0' AS schema_version, 'unknown' AS device_alias FROM pages WHERE starts_with(url, 'https')""",
)
def b09(spark, sf_dir):
    valid = records.validate_visits(visit_rows(spark, sf_dir), "raw").where(F.size("errors") == 0)
    return records.visit_records(valid, "raw", ["page_id"]).select(
        "page_id", "artifact_id", "source", "created_at_ms", "schema_version", "device_alias"
    )


@register(
    "h13_canonical_events",
    """SELECT event_id, '{"k":' || k || ',"type":"' || event_type || '","value":' || value || '}' AS exact_json,
       '{"k":' || k || ',"type":"' || event_type || '"}' AS native_json
       FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)""",
)
def h13_events(spark, sf_dir):
    k = b.k_of(F.col("props")).alias("k")
    kind = F.col("event_type").alias("type")
    return b.table(spark, sf_dir, "events").select(
        "event_id",
        jsontext.canonical_json_exact(F.to_json(F.struct("value", kind, k))).alias("exact_json"),
        jsontext.canonical_json(F.to_json(F.struct(kind, k))).alias("native_json"),
    )


@register(
    "h23_event_pretty_size",
    """SELECT event_id, length('{' || chr(10) || '  "k": ' || json_extract_string(props, '$.k') || chr(10) || '}')::BIGINT AS pretty_chars FROM events""",
)
def h23_events(spark, sf_dir):
    return b.table(spark, sf_dir, "events").select("event_id", jsontext.pretty_size(F.col("props")).alias("pretty_chars"))

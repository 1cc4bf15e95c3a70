"""Wearable exports: discovery, JSON arrays and banner sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronogrid.constants import HR_ALIAS_DIR, HR_CSV, HR_DIR, HRV_DIR, SLEEP_CSV, SLEEP_PREFIX, SLEEP_STAGE_CSV, STRESS_CSV
from chronogrid.functions.numbers import as_double, as_double_or, as_int
from chronogrid.functions.timefn import parse_local_ts_ms
from chronogrid.sources.files import file_path, list_files, relative_to


def canonical_path(rel_path: Column) -> Column:
    """The alias folder maps onto the canonical heart-rate folder."""
    tail = F.substring(rel_path, F.lit(len(HR_ALIAS_DIR) + 1), F.length(rel_path))
    return F.when(rel_path.startswith(HR_ALIAS_DIR), F.concat(F.lit(HR_DIR), tail)).otherwise(rel_path)


def route(rel_path: Column) -> Column:
    """Parser of one canonical path; ``unknown`` is an error, ``mirror`` yields no rows.

    A sheet may also be a folder of parts, each with its own header line.
    """
    is_json = rel_path.endswith(".json")

    def sheet(name: str) -> Column:
        return (rel_path == name) | rel_path.startswith(name + "/")

    return (
        F.when(rel_path.startswith(HR_DIR) & is_json, F.lit("hr_json"))
        .when(rel_path.startswith(HRV_DIR) & is_json, F.lit("hrv_json"))
        .when(sheet(STRESS_CSV), F.lit("stress"))
        .when(sheet(SLEEP_CSV), F.lit("sleep"))
        .when(sheet(SLEEP_STAGE_CSV), F.lit("sleep_stage"))
        .when(sheet(HR_CSV), F.lit("mirror"))
        .otherwise(F.lit("unknown"))
    )


def discover(files: DataFrame) -> DataFrame:
    """rel_path, kind added; each stored file counts once. ``files``: path and the path below the export root."""
    named = files.dropDuplicates(["path"]).withColumn("rel_path", canonical_path(F.col("below_root")))
    return named.withColumn("kind", route(F.col("rel_path"))).drop("below_root")


def discover_export(spark: SparkSession, root: str) -> DataFrame:
    files = list_files(spark, root).withColumn("below_root", relative_to(root, F.col("path")))
    return discover(files)


def scan_export(spark: SparkSession, root: str) -> DataFrame:
    """path, rel_path, kind, sha256, bytes, bad_json, items of every file below ``root``, from one read of each file.

    ``items`` holds the elements of a JSON array as text; sheets are only hashed here, their lines are read apart.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel_path = canonical_path(relative_to(root, F.col("path")))
    named = files.select("path", "content", F.col("length").alias("bytes"), rel_path.alias("rel_path"))
    typed = named.withColumn("kind", route(F.col("rel_path")))
    text = F.when(F.col("kind").isin("hr_json", "hrv_json"), F.col("content").cast("string"))
    return typed.select(
        "path", "rel_path", "kind", F.sha2("content", 256).alias("sha256"), "bytes", text.alias("text")
    ).select(
        "path", "rel_path", "kind", "sha256", "bytes",
        (F.col("text").isNotNull() & F.try_parse_json("text").isNull()).alias("bad_json"),
        _items(F.col("text")).alias("items"),
    )


def items_of(scanned: DataFrame, kind: str, fields: list[str]) -> DataFrame:
    """Objects of the scanned arrays of one kind, all fields as text, with file and position."""
    rows = scanned.where(F.col("kind") == kind).select(F.col("path").alias("source_file"), "items")
    return _fields(rows.select("source_file", F.posexplode("items").alias("seq", "item")), fields)


def newest_export(dirs: DataFrame) -> DataFrame:
    """Greatest ``<user>_<14 digits>`` name, else the newest folder. ``dirs``: dir, modified_ms."""
    stamped = F.regexp_extract("dir", r"_(\d{14})$", 1) != ""
    order = F.struct(stamped.cast("int"), F.when(stamped, F.col("dir")), F.col("modified_ms"), F.col("dir"))
    return dirs.agg(F.max_by("dir", order).alias("dir"))


# --- JSON arrays ------------------------------------------------------------------


def _json_array(spark: SparkSession, paths: str | list[str], fields: list[str]) -> DataFrame:
    """Objects of top-level arrays, all fields as text, with file and position (``seq``).

    Other elements are skipped one by one and a file that is no array gives no
    rows; an export is cut into many small files, so a file fits in one value.
    """
    files = spark.read.option("recursiveFileLookup", True).text(paths, wholetext=True)
    rows = files.select(file_path().alias("source_file"), F.posexplode(_items(F.col("value"))).alias("seq", "item"))
    return _fields(rows, fields)


def _items(text: Column) -> Column:
    is_array = F.ltrim(F.regexp_replace(text, "^\ufeff", "")).startswith("[")
    return F.from_json(F.when(is_array, text), "array<string>")


def _fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    schema = ", ".join(f"{f} string" for f in fields)
    parsed = rows.select("source_file", F.col("seq").cast("bigint").alias("seq"), F.from_json("item", schema).alias("r"))
    return parsed.select(*[F.col(f"r.{f}").alias(f) for f in fields], "source_file", "seq")


def parse_hr_bins(rows: DataFrame) -> DataFrame:
    """Text fields to heart-rate bins; rows lacking a time or a rate are dropped, a missing bound is 0."""
    return rows.select(
        as_int(F.col("start_time")).alias("start_ms"),
        as_int(F.col("end_time")).alias("end_ms"),
        as_double(F.col("heart_rate")).alias("bpm"),
        as_double_or(F.col("heart_rate_min")).alias("bpm_min"),
        as_double_or(F.col("heart_rate_max")).alias("bpm_max"),
        "source_file",
        "seq",
    ).where("start_ms is not null and end_ms is not null and bpm is not null")


def parse_hrv_windows(rows: DataFrame) -> DataFrame:
    """All four fields are required; a start or end at or before zero or an end before the start is dropped."""
    return rows.select(
        as_int(F.col("start_time")).alias("start_ms"),
        as_int(F.col("end_time")).alias("end_ms"),
        as_double(F.col("sdnn")).alias("sdnn_ms"),
        as_double(F.col("rmssd")).alias("rmssd_ms"),
        "source_file",
        "seq",
    ).where("start_ms > 0 and end_ms > 0 and end_ms >= start_ms and sdnn_ms is not null and rmssd_ms is not null")


HR_FIELDS = ["start_time", "end_time", "heart_rate", "heart_rate_min", "heart_rate_max"]
HRV_FIELDS = ["start_time", "end_time", "sdnn", "rmssd"]


def read_hr_bins(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_hr_bins(_json_array(spark, paths, HR_FIELDS))


def read_hrv_windows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_hrv_windows(_json_array(spark, paths, HRV_FIELDS))


def bad_json_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``.json`` files whose text is not JSON at all."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(paths, wholetext=True)
    return rows.where(F.try_parse_json("value").isNull()).select(file_path().alias("source_file"))


# --- banner sheets ---------------------------------------------------------------

# A cell with its comma in front: quoted text with doubled quotes, or anything up to the next comma. Possessive, so linear.
_CELL = r',("(?:[^"]++|"")*+"[^,]*+|[^,]*+)'
# A record with its line break in front; breaks inside quotes belong to it.
_RECORD = r'\n((?:[^"\n]++|"(?:[^"]++|"")*+"?)*+)'


def _cells(line: Column) -> Column:
    """Cells of one record; quoted cells lose their quotes."""
    return F.transform(
        F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), F.lit(1)),
        lambda c: F.when(
            c.startswith('"') & c.endswith('"') & (F.length(c) > 1),
            F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"')),
        ).otherwise(c),
    )


#: up to so many sheets, the header row of each is sent to every task
MAX_BROADCAST_SHEETS = 10_000


def sheet_rows(lines: DataFrame, sheets: int | None = None) -> DataFrame:
    """path, order, header, cells from lines (path, line, order): the first line naming ``start_time`` is the header.

    The banner stands before it, data lines after it. Only one header row per
    file is kept aside. With the number of ``sheets`` known to be moderate the
    headers go to the lines, so a very large sheet stays split; else lines and
    headers meet by path.
    """
    clean = lines.withColumn("line", F.regexp_replace("line", "^\ufeff+", ""))
    headers = (
        clean.where(F.col("line").contains("start_time"))
        .groupBy("path")
        .agg(F.min_by(_cells(F.col("line")), "order").alias("header"), F.min("order").alias("header_order"))
    )
    if sheets is not None and sheets <= MAX_BROADCAST_SHEETS:
        headers = F.broadcast(headers)
    cells = clean.where(F.length(F.trim("line")) > 0).select("path", "order", _cells(F.col("line")).alias("cells"))
    return cells.join(headers, "path").where(F.col("order") > F.col("header_order")).drop("header_order")


def _cell(*names: str) -> Column:
    """First filled cell under any of the column names."""
    found = []
    for name in names:
        place = F.array_position(F.col("header"), F.lit(name))
        found.append(F.when(place > 0, F.nullif(F.get(F.col("cells"), (place - 1).cast("int")), F.lit(""))))
    return F.coalesce(*found)


def _once(rows: DataFrame, columns: dict[str, Column], keep: list[str]) -> DataFrame:
    """Compute ``columns`` a single time per row.

    Going through a one-element array keeps the optimizer from copying the
    expressions into every later filter and projection that mentions them.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return rows.select(*keep, F.inline(F.array(row)))


def _times(lines: DataFrame, names: dict[str, tuple[str, ...]], offset_mode: str, sheets: int | None) -> DataFrame:
    """Named cells as text with ``start_ms`` and ``end_ms``; rows without readable times are dropped."""
    rows = sheet_rows(lines, sheets)
    text = _once(rows, {n: _cell(*aliases) for n, aliases in names.items()}, ["path", "order"])
    offset = F.coalesce("time_offset", F.lit(""))
    start = parse_local_ts_ms(F.col("start_time"), offset, offset_mode)
    end = parse_local_ts_ms(F.col("end_time"), offset, offset_mode)
    timed = _once(text, {"start_ms": start, "_end": end}, text.columns)
    ends = F.when(F.col("end_time").isNull(), F.col("start_ms")).otherwise(F.col("_end"))
    return timed.withColumn("end_ms", ends).where("start_ms is not null and end_ms is not null")


def _aliases(*names: str, prefix: str | None = None) -> dict[str, tuple[str, ...]]:
    return {n: (n, prefix + n) if prefix else (n,) for n in names}


def stress_sheet(lines: DataFrame, offset_mode: str = "reference", sheets: int | None = None) -> DataFrame:
    rows = _times(lines, _aliases("start_time", "end_time", "time_offset", "score", "datauuid"), offset_mode, sheets)
    return rows.select(
        "start_ms", "end_ms", F.when(F.col("score").isNotNull(), as_double_or(F.col("score"))).alias("score"),
        F.coalesce("datauuid", F.lit("")).alias("data_uuid"), F.col("path").alias("source_file"), F.col("order").alias("seq"),
    )


def sleep_sheet(lines: DataFrame, offset_mode: str = "reference", sheets: int | None = None) -> DataFrame:
    names = _aliases(
        "start_time", "end_time", "time_offset", "sleep_score", "efficiency", "sleep_type", "datauuid", prefix=SLEEP_PREFIX
    )
    rows = _times(lines, names, offset_mode, sheets)

    def number(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), as_double_or(F.col(name))).alias(name)

    return rows.select(
        "start_ms", "end_ms", number("sleep_score"), number("efficiency"), as_int(F.col("sleep_type")).alias("sleep_type"),
        F.coalesce("datauuid", F.lit("")).alias("data_uuid"), F.col("path").alias("source_file"),
    )


def sleep_stage_sheet(lines: DataFrame, offset_mode: str = "reference", sheets: int | None = None) -> DataFrame:
    rows = _times(lines, _aliases("start_time", "end_time", "time_offset", "stage", "sleep_id"), offset_mode, sheets)
    return rows.withColumn("stage_code", as_int(F.col("stage"))).where("stage_code is not null").select(
        "start_ms", "end_ms", "stage_code", F.coalesce("sleep_id", F.lit("")).alias("sleep_id"),
        F.col("path").alias("source_file"), F.col("order").alias("seq"),
    )


def sheet_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, line, order: one row per record of a sheet; ``order`` follows the position in the file.

    Lines of large files are split over tasks. Only a file in which some line
    has an odd number of quotes, so that a cell may hold a line break, is read
    as a whole and cut into records.
    """
    position = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = spark.read.text(paths).select(file_path().alias("path"), F.col("value").alias("line"), position.alias("order"))
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    torn = [r["path"] for r in lines.where(quotes % 2 == 1).select("path").distinct().collect()]  # sheets, not rows
    if not torn:
        return lines
    whole = spark.read.text(torn, wholetext=True).select(file_path().alias("path"), F.col("value").alias("text"))
    plain = F.concat(F.lit("\n"), F.regexp_replace("text", "\r\n?", "\n"))
    cut = whole.select("path", F.posexplode(F.regexp_extract_all(plain, F.lit(_RECORD), F.lit(1))).alias("at", "line"))
    order = F.struct(F.lit(0).cast("bigint").alias("block"), F.col("at").cast("bigint").alias("at"))
    return lines.where(~F.col("path").isin(torn)).unionByName(cut.select("path", "line", order.alias("order")))


# --- page images -------------------------------------------------------------------


def _be_uint(content: Column, start: int) -> Column:
    return F.conv(F.hex(F.substring(content, start, 4)), 16, 10).cast("bigint")


def page_images(files: DataFrame) -> DataFrame:
    """note_uuid, file_name, page_order, sha256, bytes, width, height from binary files (path, content, modificationTime)."""
    shape = r"([0-9a-f]{32})/([^/]+\.png)$"
    named = files.withColumn("note_uuid", F.regexp_extract("path", shape, 1)).where("note_uuid <> ''")
    pages = named.select(
        "note_uuid",
        F.regexp_extract("path", shape, 2).alias("file_name"),
        "path",
        F.sha2("content", 256).alias("png_sha256"),
        F.length("content").cast("bigint").alias("image_bytes"),
        _be_uint(F.col("content"), 17).alias("width"),
        _be_uint(F.col("content"), 21).alias("height"),
        F.unix_millis("modificationTime").alias("modified_ms"),
    )
    newest = pages.groupBy("note_uuid").agg(F.max("modified_ms").alias("note_modified_ms"))
    return pages.join(newest, "note_uuid")


def read_page_images(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(root)
    return page_images(files)

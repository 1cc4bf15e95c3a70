"""Presence, experiment and integrity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronogrid.functions.numbers import round_stable
from chronogrid.functions.timefn import floor_index
from chronogrid.operators import experiments, integrity, presence, state
from chronogrid.plans import bindings as b
from chronogrid.plans.registry import register
from chronogrid.plans.state_catalog import ARTIFACTS, EV, artifacts

START = 1_704_067_200_000  # 2024-01-01T00:00:00Z, the first event day
DAY = 86_400_000
SPLIT, END = START + 14 * DAY, START + 28 * DAY


def cells(spark, sf_dir):
    """Distinct windows with any record, one shared device."""
    index = floor_index(F.col("start_ms"))
    return b.obs(spark, sf_dir, shared=True).select("device", index.alias("canonical_index")).distinct()


@register(
    "n01_window_spine",
    f"""WITH c AS (SELECT DISTINCT {EV} // 60000 AS i FROM events), s AS (SELECT unnest(range((SELECT min(i) FROM c), (SELECT max(i) FROM c) + 1)) AS i)
        SELECT 'all' AS device, s.i AS canonical_index, c.i IS NOT NULL AS has_data FROM s LEFT JOIN c ON c.i = s.i""",
)
def n01(spark, sf_dir):
    return presence.window_spine(cells(spark, sf_dir))


@register(
    "n01_gaps",
    f"""WITH obs AS ({b.OBS}), l AS (SELECT *, lag(end_ms) OVER (PARTITION BY device ORDER BY start_ms, end_ms, event_id) AS p FROM obs)
        SELECT device, p AS gap_start_ms, start_ms AS gap_end_ms, start_ms - p AS gap_ms FROM l WHERE start_ms - p > {DAY}""",
)
def n01_gaps(spark, sf_dir):
    return presence.gaps(b.obs(spark, sf_dir).withColumnRenamed("event_id", "seq"), DAY)


@register(
    "n02_presence_state",
    f"""WITH obs AS ({b.OBS}), c AS (SELECT *, CASE WHEN modality <> 'journal' THEN least(1.0, k / 60.0::DOUBLE) END AS cov FROM obs),
        s AS (SELECT *, CASE WHEN value > 99 THEN 'CORRUPTED' WHEN k = 99 THEN 'DELAYED' WHEN cov IS NULL THEN 'UNKNOWN' WHEN cov = 0 THEN 'ABSENT'
          WHEN cov < 1 THEN 'PARTIAL' ELSE 'PRESENT' END AS state FROM c)
        SELECT event_id, state, {b.rnd("CASE WHEN state IN ('CORRUPTED', 'UNKNOWN') THEN 0.0 ELSE coalesce(cov, 0.0) END", 4)} AS confidence FROM s""",
)
def n02(spark, sf_dir):
    share = F.least(F.lit(1.0), F.col("k") / F.lit(60.0))
    rows = b.obs(spark, sf_dir).withColumn("cov", F.when(F.col("modality") != "journal", share))
    stated = rows.withColumn(
        "state", presence.presence_state(F.col("cov"), F.lit(False), F.col("k") == 99, F.col("value") > 99)
    )
    return stated.select("event_id", "state", round_stable(presence.confidence(F.col("cov"), F.col("state")), 4).alias("confidence"))


@register(
    "n03_rolling_mean",
    f"""WITH w AS (SELECT {EV} // 60000 AS i, avg(value) AS v, max(json_extract(props, '$.k')::BIGINT) / 60.0::DOUBLE AS cov FROM events GROUP BY 1),
        j AS (SELECT a.i, avg(p.v) FILTER (WHERE p.cov >= 0.5) AS m, count(*) FILTER (WHERE p.cov >= 0.5) AS n FROM w a JOIN w p ON p.i BETWEEN a.i - 4 AND a.i GROUP BY a.i)
        SELECT 'all' AS device, i AS canonical_index, {b.rnd('m', 3)} AS rolling_mean, n AS windows_used, n < 5 AS partial FROM j""",
)
def n03(spark, sf_dir):
    rows = b.obs(spark, sf_dir, shared=True).withColumn("canonical_index", floor_index(F.col("start_ms")))
    windows = rows.groupBy("device", "canonical_index").agg(
        F.avg("value").alias("value"), (F.max("k") / F.lit(60.0)).alias("coverage")
    )
    return presence.rolling_mean(windows, "value", "coverage")


@register(
    "n04_spread_stats",
    f"""WITH obs AS ({b.OBS}) SELECT device, count(*) AS n, {b.rnd('avg(value)', 3)} AS mean, {b.rnd('median(value)', 3)} AS median,
        {b.rnd('stddev_samp(value)', 3)} AS deviation FROM obs WHERE modality = 'heart_rate' GROUP BY device""",
)
def n04(spark, sf_dir):
    return presence.spread_stats(b.obs(spark, sf_dir, modality="heart_rate"), ["device"], "value", "event_id")


@register(
    "n04_merged_quantiles",
    f"""WITH obs AS ({b.OBS}) SELECT modality, count(value) AS n, TRUE AS low_within, TRUE AS median_within, TRUE AS high_within FROM obs GROUP BY modality""",
)
def n04_merged(spark, sf_dir):
    """Quartiles from daily sketches merged over days; each is held against its exact rank in all rows."""
    rows = b.obs(spark, sf_dir)
    day = floor_index(F.col("start_ms"), DAY)
    merged = presence.merge_quantiles(presence.quantile_states(rows.withColumn("day", day), ["modality", "day"], "value"), ["modality"])
    told = merged.select("modality", F.kll_sketch_get_quantile_double("state", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    ranks = rows.join(F.broadcast(told), "modality").groupBy("modality").agg(  # one row a modality, five of them
        F.count("value").alias("n"),
        *[F.avg((F.col("value") < F.col("q")[i]).cast("double")).alias(f"below{i}") for i in range(3)],
        *[F.avg((F.col("value") <= F.col("q")[i]).cast("double")).alias(f"upto{i}") for i in range(3)],
    )

    def within(i, share, error=0.02):
        return (F.col(f"below{i}") <= share + error) & (F.col(f"upto{i}") >= share - error)

    return ranks.select(
        "modality", "n", within(0, 0.25).alias("low_within"), within(1, 0.5).alias("median_within"), within(2, 0.75).alias("high_within")
    )


@register(
    "n08_rolling_distinct",
    f"""WITH d AS (SELECT DISTINCT modality AS app, device, start_ms // {DAY} AS day FROM ({b.OBS})), s AS (SELECT DISTINCT app, day FROM d),
        w AS (SELECT DISTINCT s.app, s.day, d.device FROM s JOIN d ON d.app = s.app AND d.day BETWEEN s.day - 6 AND s.day),
        p AS (SELECT DISTINCT s.app, s.day, d.device FROM s JOIN d ON d.app = s.app AND d.day BETWEEN s.day - 13 AND s.day - 7)
        SELECT w.app, w.day, count(*) AS members, count(p.device) AS returning FROM w LEFT JOIN p ON p.app = w.app AND p.day = w.day AND p.device = w.device GROUP BY w.app, w.day""",
)
def n08_rolling(spark, sf_dir):
    """Devices that used an app in the last seven days, and those of them that did in the seven days before."""
    rows = b.obs(spark, sf_dir).select(F.col("modality").alias("app"), floor_index(F.col("start_ms"), DAY).alias("day"), "device")
    return presence.rolling_members(rows, ["app"], "device")


@register(
    "n05_domain_summary",
    f"""WITH v AS (SELECT user_id, CASE WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN 'night' ELSE 'day' END AS part, event_type AS host,
          json_extract(props, '$.k')::BIGINT * 1000 AS d FROM events),
        h AS (SELECT user_id, part, host, sum(d) AS dwell, count(*) AS n FROM v GROUP BY ALL)
        SELECT user_id, part, count(*) AS domains, sum(n)::BIGINT AS visits, {b.rnd('avg(dwell)', 3)} AS mean_ms_on_domain FROM h GROUP BY ALL""",
)
def n05(spark, sf_dir):
    visits = b.table(spark, sf_dir, "events").select(
        "user_id", presence.day_part(b.utc_ms(F.col("ts"))).alias("part"), F.col("event_type").alias("host"),
        (b.k_of(F.col("props")) * 1000).alias("dwell_ms"),
    )
    return presence.domain_summary(visits, ["user_id", "part"])


@register(
    "n05_page_domains",
    f"""WITH h AS (SELECT split_part(url, '/', 4) AS lang, split_part(url, '/', 3) AS host, sum(length(html)) AS dwell, count(*) AS n FROM pages GROUP BY ALL)
        SELECT lang, count(*) AS domains, sum(n)::BIGINT AS visits, {b.rnd('avg(dwell)', 3)} AS mean_ms_on_domain FROM h GROUP BY lang""",
)
def n05_pages(spark, sf_dir):
    part = F.split("url", "/")
    visits = b.table(spark, sf_dir, "pages").select(
        F.coalesce(F.get(part, F.lit(3)), F.lit("")).alias("lang"), part[2].alias("host"), F.length("html").cast("bigint").alias("dwell_ms")
    )
    return presence.domain_summary(visits, ["lang"])


@register(
    "n06_calendar_overlap",
    f"""WITH obs AS ({b.OBS}), w AS (SELECT DISTINCT device, start_ms // 60000 AS i FROM obs WHERE modality = 'heart_rate'),
        c AS (SELECT device, 'k' || (k // 25) AS tag, unnest(range(start_ms // 60000, greatest(end_ms - 1, start_ms) // 60000 + 1)) AS i FROM obs WHERE modality = 'stress'),
        t AS (SELECT device, i, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM c GROUP BY ALL)
        SELECT w.device, w.i AS canonical_index, coalesce(tags, '') AS tags, tags IS NOT NULL AS in_calendar FROM w LEFT JOIN t ON t.device = w.device AND t.i = w.i""",
)
def n06(spark, sf_dir):
    windows = b.obs(spark, sf_dir, modality="heart_rate").select("device", floor_index(F.col("start_ms")).alias("canonical_index")).distinct()
    tag = F.concat(F.lit("k"), F.floor(F.col("k") / 25).cast("string"))
    calendar = b.obs(spark, sf_dir, modality="stress").select("device", "start_ms", "end_ms", tag.alias("tag"))
    out = presence.calendar_overlap(windows, calendar)
    return out.withColumn("tags", F.coalesce(F.array_join("tags", ","), F.lit("")))


_USAGE = "sum(end_ms - start_ms)::BIGINT AS total_ms, count(*) AS sessions, min(start_ms) AS first_ms, max(end_ms) AS last_ms"


@register(
    "n07_daily_app_summary",
    f"WITH obs AS ({b.OBS}) SELECT device, modality AS app, start_ms // {DAY} AS day, {_USAGE} FROM obs GROUP BY ALL",
)
def n07(spark, sf_dir):
    rows = b.obs(spark, sf_dir)
    return presence.usage_summary(rows, [F.col("device"), F.col("modality").alias("app"), floor_index(F.col("start_ms"), DAY).alias("day")])


@register("n08_time_of_day", f"WITH obs AS ({b.OBS}) SELECT start_ms // 3600000 % 24 AS hour, {_USAGE} FROM obs GROUP BY ALL")
def n08_hours(spark, sf_dir):
    hour = F.pmod(floor_index(F.col("start_ms"), 3_600_000), F.lit(24))
    return presence.usage_summary(b.obs(spark, sf_dir), [hour.alias("hour")])


@register(
    "n08_weekly_category",
    f"WITH obs AS ({b.OBS}) SELECT strftime(date_trunc('week', make_timestamp(start_ms * 1000)), '%Y-%m-%d') AS week, modality AS category, {_USAGE} FROM obs GROUP BY ALL",
)
def n08_weeks(spark, sf_dir):
    week = F.date_format(F.date_trunc("week", F.timestamp_millis("start_ms")), "yyyy-MM-dd")
    return presence.usage_summary(b.obs(spark, sf_dir), [week.alias("week"), F.col("modality").alias("category")])


@register(
    "n08_place_dwell",
    f"WITH obs AS ({b.OBS}) SELECT device, 'place-' || floor(value / 10)::BIGINT AS place, {_USAGE} FROM obs GROUP BY ALL",
)
def n08_places(spark, sf_dir):
    place = F.concat(F.lit("place-"), F.floor(F.col("value") / 10).cast("string"))
    return presence.usage_summary(b.obs(spark, sf_dir), [F.col("device"), place.alias("place")])


@register(
    "n09_correlation",
    f"SELECT event_type, {b.rnd('corr(value, json_extract(props, ' + chr(39) + '$.k' + chr(39) + ')::DOUBLE)', 6)} AS correlation, count(*) AS n FROM events GROUP BY event_type",
)
def n09(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").select("event_type", "value", b.k_of(F.col("props")).cast("double").alias("k"))
    return presence.correlation(rows, ["event_type"], "value", "k")


@register(
    "n10_drop_reloads",
    f"""WITH l AS (SELECT event_id, {EV} AS ms, lag({EV}) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events)
        SELECT event_id FROM l WHERE p IS NULL OR ms - p > 14400000""",
)
def n10(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", b.utc_ms(F.col("ts")).alias("start_ms"))
    return presence.drop_reloads(rows, ["user_id", "event_type"], ["start_ms", "event_id"], 14_400_000).select("event_id")


@register(
    "n11_visit_rules",
    f"""WITH obs AS ({b.OBS}), v AS (SELECT event_id, start_ms, CASE WHEN modality = 'stress' THEN start_ms - 5000 ELSE end_ms END AS e, k * 1000 AS dwell,
          CASE WHEN modality = 'hrv' THEN 'about:blank' ELSE 'www.example.org' END AS host, modality <> 'journal' AS blocked FROM obs)
        SELECT event_id, array_to_string(list_filter([CASE WHEN e < start_ms THEN 'end_before_start' END, CASE WHEN abs(dwell - (e - start_ms)) > 1000 THEN 'dwell_mismatch' END,
          CASE WHEN host = 'about:blank' THEN 'host_not_registrable' END, CASE WHEN NOT blocked THEN 'content_not_blocked' END], lambda x: x IS NOT NULL), ',') AS errors FROM v""",
)
def n11(spark, sf_dir):
    end = F.when(F.col("modality") == "stress", F.col("start_ms") - 5000).otherwise(F.col("end_ms"))
    host = F.when(F.col("modality") == "hrv", F.lit("about:blank")).otherwise(F.lit("www.example.org"))
    errors = integrity.visit_rule_errors(F.col("start_ms"), end, F.col("k") * 1000, host, F.col("modality") != "journal")
    return b.obs(spark, sf_dir).select("event_id", F.array_join(errors, ",").alias("errors"))


# --- experiments ------------------------------------------------------------------------


@register(
    "n12_experiment_scope",
    f"""SELECT e.event_id, r.r_name AS experiment FROM events e JOIN region r
        ON epoch_us(e.ts) // 1000 >= {START} + r_regionkey * 3 * {DAY} AND epoch_us(e.ts) // 1000 < {START} + (r_regionkey * 3 + 5) * {DAY}""",
)
def n12(spark, sf_dir):
    begin = F.lit(START) + F.col("r_regionkey") * F.lit(3 * DAY)
    plans = b.table(spark, sf_dir, "region").select(
        F.col("r_name").alias("experiment"), begin.alias("from_ms"), (begin + F.lit(5 * DAY)).alias("to_ms")
    )
    rows = b.obs(spark, sf_dir).select("event_id", "start_ms")
    return experiments.in_scope(rows, plans).select("event_id", "experiment")


PERIOD = f"CASE WHEN start_ms >= {START} AND start_ms < {SPLIT} THEN 'baseline' WHEN start_ms >= {SPLIT} AND start_ms < {END} THEN 'experiment' END"


def _effect_sql(key: str, name: str) -> str:
    return f"""WITH obs AS ({b.OBS}), p AS (SELECT {key} AS {name}, value, {PERIOD} AS period FROM obs),
      s AS (SELECT {name}, count(*) FILTER (WHERE period = 'baseline') AS n0, count(*) FILTER (WHERE period = 'experiment') AS n1,
        avg(value) FILTER (WHERE period = 'baseline') AS m0, avg(value) FILTER (WHERE period = 'experiment') AS m1,
        var_samp(value) FILTER (WHERE period = 'baseline') AS v0, var_samp(value) FILTER (WHERE period = 'experiment') AS v1
        FROM p WHERE period IS NOT NULL GROUP BY {name})
      SELECT {name}, n0 AS n_baseline, n1 AS n_experiment, {b.rnd('m0', 4)} AS baseline_mean, {b.rnd('m1', 4)} AS experiment_mean, {b.rnd('m1 - m0', 4)} AS shift,
        {b.rnd('(m1 - m0) / nullif(sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / nullif(n0 + n1 - 2, 0)), 0)', 4)} AS cohens_d,
        {b.rnd('m1 - m0 - 1.96::DOUBLE * sqrt(v0 / nullif(n0, 0) + v1 / nullif(n1, 0))', 4)} AS ci_low,
        {b.rnd('m1 - m0 + 1.96::DOUBLE * sqrt(v0 / nullif(n0, 0) + v1 / nullif(n1, 0))', 4)} AS ci_high FROM s"""


def periods(spark, sf_dir):
    return b.obs(spark, sf_dir).withColumn("period", experiments.period(F.col("start_ms"), START, SPLIT, END))


@register("n13_clock_matched", _effect_sql("start_ms // 3600000 % 24", "hour"))
def n13_clock(spark, sf_dir):
    hour = F.pmod(floor_index(F.col("start_ms"), 3_600_000), F.lit(24))
    return experiments.effect(periods(spark, sf_dir).withColumn("hour", hour), ["hour"], "value")


@register("n13_weekday_matched", _effect_sql("dayofweek(make_timestamp(start_ms * 1000)) + 1", "weekday"))
def n13_weekday(spark, sf_dir):
    weekday = F.dayofweek(F.timestamp_millis("start_ms")).cast("bigint")
    return experiments.effect(periods(spark, sf_dir).withColumn("weekday", weekday), ["weekday"], "value")


@register("n13_regime_conditioned", _effect_sql("modality", "regime"))
def n13_regime(spark, sf_dir):
    return experiments.effect(periods(spark, sf_dir).withColumnRenamed("modality", "regime"), ["regime"], "value")


@register(
    "n13_distribution_shift",
    f"""WITH obs AS ({b.OBS}), p AS (SELECT floor(value / 10)::BIGINT AS bucket, {PERIOD} AS period FROM obs),
        c AS (SELECT bucket, count(*) FILTER (WHERE period = 'baseline') AS x, count(*) FILTER (WHERE period = 'experiment') AS y FROM p WHERE period IS NOT NULL GROUP BY bucket),
        s AS (SELECT bucket, {b.rnd('x / sum(x) OVER ()', 4)} AS x, {b.rnd('y / sum(y) OVER ()', 4)} AS y FROM c)
        SELECT {b.rnd('sum(abs(x - y)) / 2', 4)} AS distance, count(*) AS buckets FROM s""",
)
def n13_shift(spark, sf_dir):
    return experiments.distribution_distance(periods(spark, sf_dir), F.floor(F.col("value") / 10))


@register(
    "n13_two_sample_distance",
    f"""WITH obs AS ({b.OBS}), p AS (SELECT value AS v, {PERIOD} AS period FROM obs),
        c AS (SELECT v, count(*) FILTER (WHERE period = 'baseline') AS x, count(*) FILTER (WHERE period = 'experiment') AS y FROM p WHERE period IS NOT NULL AND v IS NOT NULL GROUP BY v),
        f AS (SELECT v, x, y, abs(sum(x) OVER (ORDER BY v) / sum(x) OVER () - sum(y) OVER (ORDER BY v) / sum(y) OVER ()) AS d, lead(v) OVER (ORDER BY v) - v AS gap FROM c)
        SELECT {b.rnd('max(d)', 6)} AS ks_distance, {b.rnd('sum(d * gap)', 4)} AS wasserstein, sum(x)::BIGINT AS n_baseline, sum(y)::BIGINT AS n_experiment FROM f""",
)
def n13_two_sample(spark, sf_dir):
    """How far the distributions of the two periods lie apart, over all values and not over buckets."""
    return experiments.two_sample_distance(periods(spark, sf_dir), "value")


@register("n14_effect_size", _effect_sql("'all'", "scope"))
def n14(spark, sf_dir):
    return experiments.effect(periods(spark, sf_dir).withColumn("scope", F.lit("all")), ["scope"], "value")


@register(
    "n14_regime_frequency",
    f"""WITH obs AS ({b.OBS}), p AS (SELECT modality, {PERIOD} AS period FROM obs),
        c AS (SELECT modality, count(*) FILTER (WHERE period = 'baseline') AS before, count(*) FILTER (WHERE period = 'experiment') AS during FROM p WHERE period IS NOT NULL GROUP BY modality)
        SELECT modality, before, during, {b.rnd('before / sum(before) OVER ()', 4)} AS before_share, {b.rnd('during / sum(during) OVER ()', 4)} AS during_share FROM c""",
)
def n14_frequency(spark, sf_dir):
    return experiments.regime_frequency(periods(spark, sf_dir), "modality")


@register("n15_baseline_experiment", _effect_sql("device", "device"))
def n15(spark, sf_dir):
    """Fourteen days against the fourteen days after them, per device."""
    return experiments.effect(periods(spark, sf_dir), ["device"], "value")


@register("n16_regime_clusters")
def n16(spark, sf_dir):
    labelled, silhouette = experiments.regimes(b.table(spark, sf_dir, "embeddings"), "embedding", 4, 7)
    return labelled.groupBy("regime").agg(F.count(F.lit(1)).alias("n")).withColumn("silhouette", F.lit(round(silhouette, 6)))


@register("n16_bootstrap_agreement")
def n16_bootstrap(spark, sf_dir):
    return experiments.bootstrap_agreement(b.table(spark, sf_dir, "embeddings"), "embedding", 4, 7)


def _ablation_sql() -> str:
    parts = []
    for name, (low, high) in BLOCKS.items():
        rest = f"list_sum(list_transform(embedding, lambda v, i: CASE WHEN i > {low} AND i <= {high} THEN 0.0 ELSE v::DOUBLE * v::DOUBLE END))"
        whole = "list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))"
        parts.append(f"SELECT '{name}' AS block, {b.rnd(f'avg(sqrt({rest}) / sqrt({whole}))', 6)} AS agreement FROM embeddings")
    return " UNION ALL ".join(parts)


BLOCKS = {"first": (0, 16), "second": (16, 32), "third": (32, 48), "fourth": (48, 64)}


@register("n17_ablation_agreement", _ablation_sql())
def n17(spark, sf_dir):
    return experiments.ablation_agreement(b.table(spark, sf_dir, "embeddings"), "embedding", BLOCKS)


@register(
    "n18_regime_runs",
    f"""WITH obs AS ({b.OBS}), r AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY start_ms, event_id)
          - row_number() OVER (PARTITION BY device, modality ORDER BY start_ms, event_id) AS island FROM obs)
        SELECT device, modality, min(start_ms) AS from_ms, max(start_ms) AS to_ms, count(*) AS length FROM r GROUP BY device, modality, island""",
)
def n18(spark, sf_dir):
    rows = b.obs(spark, sf_dir).select("device", "modality", "start_ms", "event_id")
    return experiments.runs(rows, "device", ["start_ms", "event_id"], "modality")


# --- integrity --------------------------------------------------------------------------


def supply_edges(spark, sf_dir):
    """Lineage of orders: order, customer, nation, region."""
    orders, customer = b.table(spark, sf_dir, "orders"), b.table(spark, sf_dir, "customer")

    def named(prefix, column):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    return (
        orders.select(named("o", "o_orderkey").alias("child_id"), named("c", "o_custkey").alias("parent_id"))
        .unionByName(customer.select(named("c", "c_custkey").alias("child_id"), named("n", "c_nationkey").alias("parent_id")))
        .unionByName(b.table(spark, sf_dir, "nation").select(named("n", "n_nationkey").alias("child_id"), named("r", "n_regionkey").alias("parent_id")))
    )


EDGES = """edges AS (SELECT 'o' || o_orderkey AS child_id, 'c' || o_custkey AS parent_id FROM orders
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


@register(
    "n19_orphans",
    "SELECT 'o' || l_orderkey AS child_id, 'p' || l_partkey AS parent_id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)",
)
def n19_orphans(spark, sf_dir):
    edges = b.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("child_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("parent_id")
    )
    kept = b.table(spark, sf_dir, "part").where("p_size > 10").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("artifact_id"))
    return integrity.orphans(edges, kept).select("child_id", "parent_id")


@register(
    "n19_invalidation_closure",
    f"""WITH RECURSIVE {EDGES}, hit(artifact_id, depth) AS (SELECT 'r' || r_regionkey, 0 FROM region WHERE r_name = 'ASIA'
          UNION ALL SELECT e.child_id, h.depth + 1 FROM edges e JOIN hit h ON e.parent_id = h.artifact_id)
        SELECT artifact_id, min(depth)::INTEGER AS depth FROM hit WHERE depth > 0 GROUP BY artifact_id""",
)
def n19_closure(spark, sf_dir):
    gone = b.table(spark, sf_dir, "region").where("r_name = 'ASIA'").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("artifact_id"))
    return integrity.invalidated(supply_edges(spark, sf_dir), gone)


@register(
    "n19_cycles",
    f"""WITH RECURSIVE {EDGES}, looped AS (SELECT * FROM edges UNION ALL SELECT 'r' || r_regionkey, 'n' || r_regionkey FROM region),
        walk(start_id, at_id, depth) AS (SELECT child_id, parent_id, 1 FROM looped WHERE child_id LIKE 'n%' OR child_id LIKE 'r%'
          UNION ALL SELECT w.start_id, l.parent_id, w.depth + 1 FROM walk w JOIN looped l ON l.child_id = w.at_id WHERE w.depth < 24),
        inside AS (SELECT DISTINCT start_id FROM walk WHERE start_id = at_id)
        SELECT child_id, parent_id FROM looped WHERE child_id IN (SELECT start_id FROM inside) AND parent_id IN (SELECT start_id FROM inside)""",
)
def n19_cycles(spark, sf_dir):
    """Every region is also made a child of the nation with its number."""
    key = F.col("r_regionkey").cast("string")
    back = b.table(spark, sf_dir, "region").select(F.concat(F.lit("r"), key).alias("child_id"), F.concat(F.lit("n"), key).alias("parent_id"))
    return integrity.cyclic_edges(supply_edges(spark, sf_dir).unionByName(back))


@register(
    "n20_active_view",
    "SELECT doc_id::VARCHAR AS artifact_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0)",
)
def n20(spark, sf_dir):
    ids = b.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("artifact_id"))
    labels = b.table(spark, sf_dir, "labels").withColumn("artifact_id", F.col("doc_id").cast("string"))
    return integrity.active_view(ids, labels.where("toxic = 1"), labels.where("quality = 0"))


@register(
    "n20_newest_successor",
    f"SELECT user_id AS artifact_id, arg_max(event_id, ({EV}, event_id)) AS successor_id, max({EV}) AS at_ms FROM events GROUP BY user_id",
)
def n20_successor(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("artifact_id"), F.col("event_id").alias("successor_id"), b.utc_ms(F.col("ts")).alias("at_ms")
    )
    return integrity.newest_successor(rows)


STATES = {"view": "ingested", "click": "validated", "purchase": "finalized", "error": "failed", "signup": "archived"}


@register(
    "n21_lifecycle_transitions",
    f"""WITH s AS (SELECT user_id, {EV} AS ms, event_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items())} END AS state FROM events),
        l AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS from_state FROM s)
        SELECT from_state, state, concat(from_state, '>', state) IN ({', '.join(f"'{x}>{y}'" for x, y in integrity.ALLOWED_TRANSITIONS)}) AS allowed, count(*) AS n
        FROM l WHERE from_state IS NOT NULL AND from_state <> state GROUP BY ALL""",
)
def n21(spark, sf_dir):
    names = F.create_map(*[F.lit(v) for pair in STATES.items() for v in pair])
    rows = b.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("artifact_id"), names[F.col("event_type")].alias("state"), b.utc_ms(F.col("ts")).alias("ms"), "event_id"
    )
    moves = integrity.transitions(rows, ["ms", "event_id"])
    return moves.groupBy("from_state", "state", "allowed").agg(F.count(F.lit(1)).alias("n"))


@register(
    "n22_content_hash",
    """SELECT event_id, sha256('{"artifact_type":"' || event_type || '","payload":{"k":' || json_extract_string(props, '$.k') || '},"schema_version":"1.0"}') AS content_hash FROM events""",
)
def n22(spark, sf_dir):
    content = F.to_json(
        F.struct(F.lit("1.0").alias("schema_version"), F.col("event_type").alias("artifact_type"), F.parse_json("props").alias("payload"))
    )
    return b.table(spark, sf_dir, "events").select("event_id", integrity.content_hash(content).alias("content_hash"))


@register(
    "n23_rolling_success",
    f"""WITH d AS (SELECT event_type, {EV} // {DAY} AS day, count(*) FILTER (WHERE json_extract(props, '$.k')::BIGINT >= 5) AS ok, count(*) AS total FROM events GROUP BY ALL),
        r AS (SELECT a.event_type, a.day, sum(p.ok)::BIGINT AS ok, sum(p.total)::BIGINT AS total FROM d a JOIN d p ON p.event_type = a.event_type AND p.day BETWEEN a.day - 6 AND a.day GROUP BY ALL)
        SELECT event_type, day, ok, total, {b.rnd('ok / total', 4)} AS rate, ok / total > 0.95 AS healthy FROM r""",
)
def n23(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").select("event_type", floor_index(b.utc_ms(F.col("ts")), DAY).alias("day"), b.k_of(F.col("props")).alias("k"))
    daily = rows.groupBy("event_type", "day").agg(F.count_if(F.col("k") >= 5).alias("ok"), F.count(F.lit(1)).alias("total"))
    return presence.rolling_success(daily, ["event_type"])


@register(
    "n23_uptime",
    f"""WITH c AS (SELECT DISTINCT {EV} // 60000 AS i FROM events), d AS (SELECT i // 1440 AS day, count(*) / 60.0::DOUBLE AS hours FROM c GROUP BY 1)
        SELECT 'all' AS device, count(*) AS days, count(*) FILTER (WHERE hours >= 5) AS good_days, {b.rnd('count(*) FILTER (WHERE hours >= 5) / count(*)', 4)} AS good_share FROM d""",
)
def n23_uptime(spark, sf_dir):
    return presence.uptime(cells(spark, sf_dir), 5.0)


@register(
    "n24_retrain_trigger",
    f"""WITH s AS (SELECT count(*) FILTER (WHERE {EV} <= {SPLIT}) AS n_old, count(*) FILTER (WHERE {EV} > {SPLIT}) AS n_new, avg(value) FILTER (WHERE {EV} <= {SPLIT}) AS m0,
          avg(value) FILTER (WHERE {EV} > {SPLIT}) AS m1, stddev_samp(value) FILTER (WHERE {EV} <= {SPLIT}) AS s0 FROM events)
        SELECT n_old, n_new, {b.rnd('n_new / n_old', 4)} AS new_share, {b.rnd('abs(m1 - m0) / s0', 4)} AS mean_shift, n_new / n_old > 0.01 OR abs(m1 - m0) / s0 > 0.2 AS retrain FROM s""",
)
def n24(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").select("value", b.utc_ms(F.col("ts")).alias("ms"))
    return experiments.retrain_trigger(rows, SPLIT, "value", "ms")


@register(
    "n25_retention_split",
    f"""WITH {ARTIFACTS} SELECT 'raw' AS kind, count(*) FILTER (WHERE created_ms >= {b.NOW_MS} - 14 * {DAY}) AS kept, count(*) FILTER (WHERE created_ms < {b.NOW_MS} - 14 * {DAY}) AS removed FROM art
        UNION ALL SELECT 'summary', count(*), 0 FROM (SELECT DISTINCT user_id, created_ms // {DAY} FROM art)""",
)
def n25(spark, sf_dir):
    """Raw records are kept for 14 days, their daily summaries for 180."""
    raw = artifacts(spark, sf_dir)
    summary = raw.groupBy("user_id", floor_index(F.col("created_ms"), DAY).alias("day")).agg(F.max("created_ms").alias("created_ms"))
    out = None
    for kind, rows, days in (("raw", raw, 14), ("summary", summary, 180)):
        cutoff = b.NOW_MS - days * DAY
        kept = state.drop_older_than(rows, cutoff).agg(F.count(F.lit(1)).alias("kept")).withColumn("kind", F.lit(kind))
        part = kept.join(state.count_older_than(rows, cutoff).withColumn("kind", F.lit(kind)), "kind").withColumnRenamed("deleted", "removed")
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "n26_sensitivity_gate",
    "SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click', 'purchase') OR user_id IN (SELECT conv_id FROM conversations WHERE role = 'user')",
)
def n26(spark, sf_dir):
    """Errors and signups are of the high tier; users with a conversation have opted in."""
    event = F.col("event_type")
    tier = F.when(event == "view", F.lit("low")).when(event.isin("click", "purchase"), F.lit("medium")).otherwise(F.lit("high"))
    consent = b.table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("user_id")).distinct()
    rows = b.table(spark, sf_dir, "events").join(consent.withColumn("opted_in", F.lit(True)), "user_id", "left")
    gated = integrity.gate_by_sensitivity(rows.withColumn("tier", tier), "tier", "medium", F.col("opted_in"))
    return gated.select("event_id", "event_type")


@register(
    "n27_schema_migration",
    """SELECT c_custkey AS id, c_name AS label, c_acctbal AS balance, c_mktsegment AS segment, '2.0' AS schema_version FROM customer
       UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, '2.0' FROM supplier""",
)
def n27(spark, sf_dir):
    """Suppliers stand for the earlier schema: another name column and no segment."""
    new = b.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"), F.lit("2.0").alias("schema_version"),
    )
    old = b.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    return integrity.migrate(old, new, {"name": "label"}, {"schema_version": F.lit("2.0")})


@register(
    "k03_modality_adapters",
    f"""WITH obs AS ({b.OBS}) SELECT modality AS adapter, count(*) AS n, min(start_ms) AS first_ms, count(*) FILTER (WHERE value IS NULL) AS bad FROM obs
        WHERE modality IN ('heart_rate', 'stress') GROUP BY modality""",
)
def k03(spark, sf_dir):
    from chronogrid.sources.adapters import Adapter, Registry

    registry = Registry()
    for name in ("heart_rate", "stress"):
        registry.add(
            Adapter(
                name=name,
                fetch=lambda session, m=name: b.obs(session, sf_dir, modality=m),
                normalize=lambda rows: rows.select("device", "start_ms", "end_ms", "value"),
                healthy=lambda rows: F.col("value").isNotNull(),
            )
        )
    return registry.collect(spark).groupBy("adapter").agg(
        F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("first_ms"), F.count_if(~F.col("healthy")).alias("bad")
    )


@register(
    "h08_span_buckets",
    f"""WITH obs AS ({b.OBS}) SELECT event_id, start_ms // 300000 * 300000 AS named, start_ms // 45000 * 45000 AS seconds, start_ms // 86400000 * 86400000 AS upper FROM obs""",
)
def h08(spark, sf_dir):
    from chronogrid.operators.rollup import aligned_start

    start = F.col("start_ms")
    return b.obs(spark, sf_dir).select(
        "event_id", aligned_start(start, "5m").alias("named"), aligned_start(start, "45s").alias("seconds"), aligned_start(start, "1D").alias("upper")
    )

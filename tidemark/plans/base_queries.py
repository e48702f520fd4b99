"""Windows, ordered functions, statistics and joins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.series import lagged_correlations
from tidemark.operators import evaluation as E
from tidemark.operators import joins as J
from tidemark.operators import statistics as S
from tidemark.operators import windows as W
from tidemark.plans import params as P
from tidemark.plans.registry import query, table

ORDER = ["ts", "event_id"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with `at`, seconds since the epoch."""
    return table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))


def windows_sql(size: int, stride: int) -> str:
    """CTEs e (numbered events), k (windows of users) and x (events in windows)."""
    return f"""
e AS (SELECT *, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events),
c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
k AS (SELECT user_id, CAST(w AS BIGINT) AS w FROM c, LATERAL (SELECT unnest(generate_series(0, CAST(floor((n - {size}) / {stride}) AS BIGINT))) AS w) WHERE n >= {size}),
x AS (SELECT e.*, k.w + 1 AS window_id, e.rn - k.w * {stride} AS place FROM e JOIN k ON e.user_id = k.user_id AND e.rn >= k.w * {stride} AND e.rn < k.w * {stride} + {size})"""


@query(f"WITH {windows_sql(45, 15)} SELECT user_id, CAST(window_id AS INTEGER) AS window_id, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS n FROM x GROUP BY 1, 2")
def count_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.count_windows(events(spark, sf_dir), "user_id", ORDER)
    return w.groupBy("user_id", "window_id").agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count("*").alias("n"))


@query(f"""WITH {windows_sql(45, 15)} SELECT user_id, CAST(window_id AS INTEGER) AS window_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY place) AS sampled FROM x
WHERE place IN (SELECT k * 44 // 15 FROM range(16) r(k)) GROUP BY 1, 2""")
def even_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.window_arrays(W.count_windows(events(spark, sf_dir), "user_id", ORDER), "user_id", ["event_id"])
    return w.select("user_id", "window_id", F.array_join(C.even_sample(F.col("event_id"), P.WINDOW_FRAMES, P.SAMPLED_FRAMES).cast("array<string>"), ",").alias("sampled"))


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM t WHERE back <= 50),
k AS (SELECT DISTINCT user_id, n, unnest(generate_series(0, CAST(floor((n - 45) / 15) AS BIGINT))) AS w FROM r WHERE n >= 45)
SELECT r.user_id, CAST(w + 1 AS INTEGER) AS window_id, min(event_id) AS first_event, count(*) AS n FROM r JOIN k ON r.user_id = k.user_id AND rn >= w * 15 AND rn < w * 15 + 45 GROUP BY 1, 2""")
def retained_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.count_windows(events(spark, sf_dir), "user_id", ORDER, retain=50)
    return w.groupBy("user_id", "window_id").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"))


@query("""SELECT h.s AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value
FROM events, LATERAL (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 2 HOUR, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR, time_bucket(INTERVAL 1 HOUR, ts)]) AS s) h GROUP BY 1, 2""")
def hopping_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "events").groupBy(F.window("ts", "3 hours", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS id FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, id""")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sessions_by_gap(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours")


@query("SELECT user_id, event_id, back FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS back FROM events) WHERE back <= 5")
def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.newest(table(spark, sf_dir, "events"), "user_id", ORDER, 5).select("user_id", "event_id", "back")


@query("""SELECT event_id, round(value - lag(value) OVER w, 6) AS first_difference, round(lead(value) OVER w - 2 * value + lag(value) OVER w, 6) AS second_difference
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = W.differences(table(spark, sf_dir, "events"), "user_id", ORDER, "value")
    return d.select("event_id", F.round("first_difference", 6).alias("first_difference"), F.round("second_difference", 6).alias("second_difference"))


@query("SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id) + 1e-9, 6) AS centred FROM events")
def mean_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.centred(table(spark, sf_dir, "events"), "user_id", "value").select("event_id", F.round(F.col("centred") + 1e-9, 6).alias("centred"))


@query(f"WITH {windows_sql(45, 15)} SELECT user_id, CAST(window_id AS INTEGER) AS window_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY (place + 3) % 45) AS rolled FROM x GROUP BY 1, 2")
def circular_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.window_arrays(W.count_windows(events(spark, sf_dir), "user_id", ORDER), "user_id", ["event_id"])
    return w.select("user_id", "window_id", F.array_join(C.roll(F.col("event_id"), 3).cast("array<string>"), ",").alias("rolled"))


@query("""WITH t AS (SELECT *, row_number() OVER w AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
v AS (SELECT *, CASE WHEN step = 1 OR step % 3 = 0 THEN value END AS taken FROM t)
SELECT event_id, CAST(step AS INTEGER) AS step, last_value(taken IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM v""")
def cadence_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.carried(table(spark, sf_dir, "events"), "user_id", ORDER, "value").select("event_id", "step", "carried")


def _lag_sql() -> str:
    return f"""WITH {windows_sql(15, 15)}, l AS (SELECT unnest(range(-4, 5)) AS lag),
p AS (SELECT a.user_id, a.window_id, l.lag, a.value AS x, b.value * 0.5 + b.place AS y FROM x a JOIN l ON true JOIN x b ON a.user_id = b.user_id AND a.window_id = b.window_id AND a.place - b.place = l.lag)
SELECT user_id, CAST(window_id AS INTEGER) AS window_id, CAST(lag AS INTEGER) AS lag, round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) AS corr FROM p GROUP BY 1, 2, 3"""


@query(_lag_sql())
def lagged_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.count_windows(events(spark, sf_dir), "user_id", ORDER, 15, 15).withColumn("other", F.col("value") * 0.5 + F.col("place"))
    w = W.window_arrays(w, "user_id", ["value", "other"])
    found = F.explode(lagged_correlations(F.col("value"), F.col("other"), range(-4, 5), 4)).alias("c")
    return w.select("user_id", "window_id", found).select("user_id", "window_id", "c.lag", F.round("c.corr", 6).alias("corr"))


GAPS = "g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000.0 AS gap FROM events)"


@query(f"""WITH {GAPS}, m AS (SELECT user_id, count(*) AS n, stddev_pop(gap) AS std_ms, median(gap) AS median_ms FROM g WHERE gap IS NOT NULL GROUP BY 1 HAVING count(*) >= 10)
SELECT user_id, n, round(std_ms / 1000, 3) AS std_sec, round(median_ms / 1000, 3) AS median_sec, round(avg(CASE WHEN gap > 2.2 * median_ms THEN 1.0 ELSE 0.0 END), 6) AS drop_ratio, std_ms < 0.30 AS too_smooth,
avg(CASE WHEN gap > 2.2 * median_ms THEN 1.0 ELSE 0.0 END) > 0.35 AS drops FROM g JOIN m USING (user_id) WHERE gap IS NOT NULL GROUP BY user_id, n, m.std_ms, m.median_ms""")
def interval_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.interval_statistics(table(spark, sf_dir, "events"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0, ORDER)
    return s.select("user_id", "n", F.round(F.col("std_ms") / 1000, 3).alias("std_sec"), F.round(F.col("median_ms") / 1000, 3).alias("median_sec"), F.round("drop_ratio", 6).alias("drop_ratio"), "too_smooth", "drops")


@query("""SELECT l_partkey, count(*) AS n, round(CASE WHEN stddev_pop(l_quantity) * stddev_pop(l_discount) > 0 THEN covar_pop(l_quantity, l_discount) / (stddev_pop(l_quantity) * stddev_pop(l_discount)) END, 6) AS corr
FROM lineitem GROUP BY 1""")
def safe_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.round(S.correlation("l_quantity", "l_discount"), 6).alias("corr"))
    return rows


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) AS p5, round(quantile_cont(l_extendedprice, 0.92), 6) AS p92, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95,
round(median(l_quantity), 6) AS middle, round(var_pop(l_discount), 9) AS spread FROM lineitem GROUP BY 1""")
def exact_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    price = E.group_quantiles(rows, "l_returnflag", "l_extendedprice", {"p5": 0.05, "p92": 0.92, "p95": 0.95})
    spread = rows.groupBy("l_returnflag").agg(F.round(F.var_pop("l_discount"), 9).alias("spread"))
    out = price.join(E.group_quantiles(rows, "l_returnflag", "l_quantity", {"middle": 0.5}), "l_returnflag").join(spread, "l_returnflag")
    return out.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("p5", "p92", "p95", "middle")], "spread")


BOUNDS = [5.0, 25.0, 50.0, 100.0, 200.0]


@query(" UNION ALL ".join(f"SELECT '{b}' AS le, count(*) FILTER (value <= {b}) AS n FROM events" for b in BOUNDS) + " UNION ALL SELECT '+Inf', count(value) FROM events")
def histogram_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bucket_counts(table(spark, sf_dir, "events"), "value", BOUNDS)


@query("""WITH r AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS bucket FROM events)
SELECT user_id, bucket, round(sqrt(avg(value * value) + 1e-6), 6) AS rms, count(*) AS n FROM r GROUP BY 1, 2""")
def rms_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.envelope(table(spark, sf_dir, "events"), "user_id", ORDER, "value", 10).withColumn("rms", F.round("rms", 6))


@query("""WITH c AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS r, avg(value) FILTER (event_type = 'error' AND value > 60) AS g, avg(value) FILTER (event_type = 'view' AND value > 150) AS y FROM events GROUP BY 1)
SELECT user_id, round((coalesce(r * 0.6, 0) + coalesce(g * 0.2, 0) + coalesce(y * 0.2, 0)) / nullif((CASE WHEN r IS NULL THEN 0 ELSE 0.6 END + CASE WHEN g IS NULL THEN 0 ELSE 0.2 END + CASE WHEN y IS NULL THEN 0 ELSE 0.2 END)::DOUBLE, 0), 6) AS mixed FROM c""")
def renormalised_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, v = F.col("event_type"), F.col("value")
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(F.when(t == "click", v)).alias("r"), F.avg(F.when((t == "error") & (v > 60), v)).alias("g"), F.avg(F.when((t == "view") & (v > 150), v)).alias("y"))
    return c.select("user_id", F.round(S.weighted_mean([("r", 0.6), ("g", 0.2), ("y", 0.2)]), 6).alias("mixed"))


@query("""WITH m AS (SELECT l_returnflag, count(*) AS n, var_pop(l_quantity) AS xx, var_pop(l_discount) AS yy, var_pop(l_extendedprice) AS zz, covar_pop(l_quantity, l_discount) AS xy, covar_pop(l_quantity, l_extendedprice) AS xz,
covar_pop(l_discount, l_extendedprice) AS yz FROM lineitem GROUP BY 1),
f AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b FROM m)
SELECT l_returnflag, n, round(a, 3) AS a, round(b, 3) AS b, round(1 - (zz - a * xz - b * yz) / (zz + 1e-6), 6) AS r2 FROM f""")
def plane_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.plane_fit(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_discount", "l_extendedprice")
    return p.select("l_returnflag", "n", F.round("a", 3).alias("a"), F.round("b", 3).alias("b"), F.round("r2", 6).alias("r2"))


@query("""WITH m AS (SELECT user_id, sum(value) AS m00, sum(value * (event_id % 16)) AS m10, sum(value * (event_id // 16 % 16)) AS m01 FROM events WHERE value > 100 GROUP BY 1)
SELECT user_id, round(m00, 4) AS m00, round(m10 / m00, 6) AS cx, round(m01 / m00, 6) AS cy FROM m WHERE m00 > 15""")
def moment_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("event_id") % 16).cast("double"), (F.floor(F.col("event_id") / 16) % 16).cast("double")
    c = S.centroid(table(spark, sf_dir, "events").filter("value > 100"), "user_id", x, y, F.col("value"))
    return c.select("user_id", F.round("m00", 4).alias("m00"), F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query("SELECT o_custkey, arg_max(p, (v, -k)) AS v, arg_max(k, (v, -k)) AS k FROM (SELECT o_custkey, round(o_totalprice / 50000) AS v, round(o_totalprice / 50000) AS p, o_orderkey AS k FROM orders) GROUP BY 1")
def first_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.round(F.col("o_totalprice") / 50000).alias("v"), F.col("o_orderkey").alias("k"))
    return S.first_maximum(rows, "o_custkey", "v", "k")


@query(f"""WITH {windows_sql(45, 15)}, w AS (SELECT user_id, window_id, min(sec) AS t0, max(sec) AS t1 FROM x GROUP BY 1, 2),
p AS (SELECT user_id, event_id AS seq, CASE WHEN value > 150 THEN NULL WHEN value > 140 THEN 0 ELSE epoch_us(ts) / 1000.0 END AS t FROM events WHERE event_type = 'signup' AND value > 60)
SELECT w.user_id, CAST(w.window_id AS INTEGER) AS window_id, coalesce(string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq), '') AS found, CAST(min(seq) AS BIGINT) AS first_found FROM w LEFT JOIN p ON w.user_id = p.user_id
AND (t IS NULL OR t = 0 OR t / 1000.0 BETWEEN w.t0 - 3600 AND w.t1 + 3600) GROUP BY 1, 2""")
def interval_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    w = W.count_windows(e, "user_id", ORDER).groupBy("user_id", "window_id").agg(F.min("at").alias("t_start"), F.max("at").alias("t_end"))
    t0 = F.when(F.col("value") > 150, None).when(F.col("value") > 140, 0.0).otherwise(F.col("at") * 1000.0)
    points = e.filter("event_type = 'signup' AND value > 60").select("user_id", F.col("event_id").alias("seq"), t0.alias("t0"))
    out = J.interval_join(w, points, "user_id", 3600.0)
    return out.select("user_id", "window_id", F.array_join(F.col("found").cast("array<string>"), ",").alias("found"), F.get("found", F.lit(0)).alias("first_found"))


BAND = 1800


@query(f"""WITH l AS (SELECT user_id, event_id AS id, epoch_us(ts) / 1e6 AS at FROM events WHERE event_type = 'click'),
r AS (SELECT user_id, event_id AS place, epoch_us(ts) / 1e6 AS at, value FROM events WHERE event_type <> 'click'),
b AS (SELECT l.user_id, id, min(value) AS least, count(*) AS hits FROM l JOIN r ON l.user_id = r.user_id AND abs(l.at - r.at) <= {BAND} GROUP BY 1, 2),
n AS (SELECT user_id, id, value AS nearest FROM (SELECT l.user_id, id, r.value, row_number() OVER (PARTITION BY l.user_id, id ORDER BY abs(l.at - r.at), place) AS k FROM l JOIN r ON l.user_id = r.user_id) WHERE k = 1)
SELECT l.user_id, l.id, coalesce(least, nearest) AS value, coalesce(hits, 0) AS hits FROM l LEFT JOIN b ON l.user_id = b.user_id AND l.id = b.id LEFT JOIN n ON l.user_id = n.user_id AND l.id = n.id""")
def band_join_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    left = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("id"), "at")
    right = e.filter("event_type <> 'click'").select("user_id", F.col("event_id").alias("place"), "at", "value")
    return J.band_join_nearest(left, right, "user_id", BAND)


@query("""SELECT user_id, event_id, lag(event_id) OVER w AS prev_event_id, round(value - lag(value) OVER w, 6) AS moved FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY lag(event_id) OVER w IS NOT NULL""")
def consecutive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = J.consecutive(table(spark, sf_dir, "events"), "user_id", ORDER, ["event_id", "value"])
    return c.select("user_id", "event_id", "prev_event_id", F.round(F.col("value") - F.col("prev_value"), 6).alias("moved"))


@query("SELECT event_id, round(value - first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS from_first FROM events")
def base_row_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") - F.first_value("value").over(w), 6).alias("from_first"))


@query("""WITH u AS (SELECT user_id, 0 AS part, event_type AS f, max(value) AS v FROM events WHERE value > 40 GROUP BY ALL UNION ALL SELECT user_id, 1, event_type, min(value) FROM events WHERE value > 120 GROUP BY ALL),
l AS (SELECT user_id, f, arg_max(v, part) AS v FROM u GROUP BY 1, 2)
SELECT user_id, max(v) FILTER (f = 'click') AS click, max(v) FILTER (f = 'error') AS error, max(v) FILTER (f = 'view') AS "view", count(*) AS n FROM l GROUP BY 1""")
def module_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    first = e.filter("value > 40").groupBy("user_id", F.col("event_type").alias("feature")).agg(F.max("value").alias("value"))
    second = e.filter("value > 120").groupBy("user_id", F.col("event_type").alias("feature")).agg(F.min("value").alias("value"))
    m = J.merge_features([first, second], ["user_id"])
    get = lambda k: F.try_element_at("features", F.lit(k)).alias(k)
    return m.select("user_id", get("click"), get("error"), get("view"), F.size("features").cast("long").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    c = table(spark, sf_dir, "customer")
    return c.join(urgent, c["c_custkey"] == urgent["o_custkey"], "left_anti").select("c_custkey", "c_name")


KNOTS_SQL = "CASE WHEN l <= -4.0 THEN 0.02 WHEN l >= 4.0 THEN 0.98 " + " ".join(f"WHEN l <= {x1} THEN {y0} + (l - {x0}) / ({x1} - {x0})::DOUBLE * ({y1} - {y0})" for (x0, y0), (x1, y1) in zip(P.KNOTS, P.KNOTS[1:], strict=False)) + " END"


@query(f"SELECT event_id, round({KNOTS_SQL}, 6) AS probability FROM (SELECT event_id, (value - 50) / 12.5::DOUBLE AS l FROM events)")
def range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(J.calibrated((F.col("value") - 50) / 12.5), 6).alias("probability"))


@query("""WITH d AS (SELECT * FROM (VALUES ('click', 0.5, 10.0), ('error', 2.0, 0.0), ('view', -0.3, 40.0)) t(event_type, weight, neutral))
SELECT user_id, round(sum(weight * (value - neutral)), 4) AS score FROM events JOIN d USING (event_type) GROUP BY 1""")
def dimension_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([("click", 0.5, 10.0), ("error", 2.0, 0.0), ("view", -0.3, 40.0)], "event_type string, weight double, neutral double")
    rows = table(spark, sf_dir, "events").join(F.broadcast(d), "event_type")  # three rows
    return rows.groupBy("user_id").agg(F.round(F.sum(F.col("weight") * (F.col("value") - F.col("neutral"))), 4).alias("score"))


@query("""SELECT o_orderkey, coalesce(c_name, CAST(o_custkey AS VARCHAR)) AS original, c_custkey IS NOT NULL AS known FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def manifest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    j = o.join(c, o["o_custkey"] == c["c_custkey"], "left")
    return j.select("o_orderkey", F.coalesce("c_name", F.col("o_custkey").cast("string")).alias("original"), F.col("c_custkey").isNotNull().alias("known"))

"""Queries of the detection operators over the standard tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markerlake.functions import geometry as g
from markerlake.functions import records as r
from markerlake.operators import audit, boards, merge, relate
from markerlake.plans import sweep
from markerlake.plans.adapter import EDGE, HEIGHT, SQL, WIDTH, detections

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(read(spark, sf_dir, "events"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums of another order compare as equal."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


STAT_SQL = ", ".join(
    f"round(coalesce({f}({c}), 0), 6) AS {n}_{s}"
    for c, n in (("distance", "distance"), ("angle_of_incidence", "incidence_angle"), ("lighting_intensity", "lighting_intensity"))
    for f, s in (("min", "min"), ("max", "max"), ("avg", "mean"), ("stddev_samp", "std"), ("median", "median"))
)
TURN = "((x3 - x1) * (y4 - y2) - (y3 - y1) * (x4 - x2))"
CHIRAL = f"CAST(coalesce(sum(CASE WHEN record_type = 'TAG' AND {TURN} <= 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS chirality_failures"
ANCHOR = "CAST(coalesce(sum(CASE WHEN record_type = 'TAG' AND sqrt((cx - h - x1) * (cx - h - x1) + (cy - h - y1) * (cy - h - y1)) > 0.5 THEN 1 ELSE 0 END), 0) AS BIGINT) AS orientation_failures"
TURNED = "coalesce(bool_or(record_type = 'TAG' AND sqrt((cx - h - x1) * (cx - h - x1) + (cy - h - y1) * (cy - h - y1)) > 10 AND sqrt((cx - h - x3) * (cx - h - x3) + (cy - h - y3) * (cy - h - y3)) < 0.5), false) AS dictionary_orientation_error"
IN = "({x} >= 20 AND {x} < 1900 AND {y} >= 20 AND {y} < 1060)"
MARGIN = "CAST(coalesce(sum(CASE WHEN seq % 71 = 0 THEN " + " + ".join(f"CASE WHEN {IN.format(x=f'x{i}', y=f'y{i}')} THEN 0 ELSE 1 END" for i in range(1, 5)) + " ELSE 0 END), 0) AS BIGINT) AS margin_violations"
REPORT_SQL = f"count(*) AS tag_count, count(DISTINCT image_id) AS image_count, {STAT_SQL}, 0.0::DOUBLE AS ppm_min, 0.0::DOUBLE AS ppm_max, 0.0::DOUBLE AS ppm_mean, 0.0::DOUBLE AS ppm_std, 0.0::DOUBLE AS ppm_median, CAST(coalesce(sum(CASE WHEN distance < 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS impossible_poses, {CHIRAL}, {ANCHOR}, {TURNED}, {MARGIN}"
SCORE_SQL = "round(CASE WHEN tag_count = 0 THEN 0 ELSE greatest(0, least(100, 100.0 - impossible_poses * 10 - chirality_failures / tag_count * 50 - orientation_failures / tag_count * 50 - CASE WHEN incidence_angle_max < 45 THEN 20 ELSE 0 END - CASE WHEN distance_max - distance_min < 1 THEN 10 ELSE 0 END)) END, 6) AS score"


@query(f"WITH {SQL}, rep AS (SELECT {REPORT_SQL} FROM det) SELECT *, {SCORE_SQL} FROM rep")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.report(det(spark, sf_dir), margin=EDGE))


@query(f"WITH {SQL}, rep AS (SELECT tag_family, {REPORT_SQL} FROM det GROUP BY tag_family) SELECT *, {SCORE_SQL} FROM rep")
def audit_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.report(det(spark, sf_dir), margin=EDGE, by=("tag_family",)))


@query(f"WITH {SQL}, rep AS (SELECT {REPORT_SQL} FROM det) SELECT chirality_failures + orientation_failures + margin_violations > 0 AS quarantined, chirality_failures + orientation_failures + margin_violations = 0 AS gate_passed, CAST((chirality_failures > 0)::INT + (orientation_failures > 0)::INT + (margin_violations > 0)::INT AS INTEGER) AS failures FROM rep")
def gate_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.outcome(audit.report(det(spark, sf_dir), margin=EDGE), EDGE).select("quarantined", "gate_passed", F.size("gate_failures").alias("failures"))


@query(f"WITH {SQL}, rep AS (SELECT {REPORT_SQL} FROM det) SELECT 'tag_count' AS metric, CAST(tag_count AS DOUBLE) AS value, tag_count >= 100 AS passed FROM rep UNION ALL SELECT 'distance_max', distance_max, distance_max <= 8 FROM rep UNION ALL SELECT 'nothing', NULL, false")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("tag_count", 100.0, None, True), ("distance_max", None, 8.0, False), ("nothing", 0.0, None, False)], "metric string, min double, max double, critical boolean")
    found = audit.evaluate_gates(audit.report(det(spark, sf_dir)), rules)
    return found.select("metric", F.round("value", 6).alias("value"), "passed")


DIFF_SQL = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, round(CAST(b.{m} AS DOUBLE) - a.{m}, 5) AS delta FROM a, b"
    for m in ("tag_count", "image_count", "distance_mean", "distance_std", "incidence_angle_mean", "incidence_angle_std", "ppm_mean", "ppm_std", "lighting_intensity_mean", "lighting_intensity_std", "impossible_poses", "chirality_failures", "orientation_failures")
)


@query(f"WITH {SQL}, a AS (SELECT {REPORT_SQL} FROM det WHERE seq % 2 = 0), b AS (SELECT {REPORT_SQL} FROM det WHERE seq % 2 = 1) {DIFF_SQL}")
def audit_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det(spark, sf_dir)
    a, b = (audit.report(rows.where(F.col("seq") % 2 == i)) for i in (0, 1))
    return audit.diff(a, b).where("metric <> 'score'").select("metric", F.round("delta", 5).alias("delta"))


@query("SELECT o_orderstatus AS status, count(*) AS n, round(min(o_totalprice), 4) AS min, round(max(o_totalprice), 4) AS max, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std FROM orders GROUP BY 1")
def recipe_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.recipe_stats(read(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"), "o_totalprice", "status"), 4)


@query(f"WITH {SQL} SELECT image_id, seq, tag_id, round(distance, 6) AS distance FROM det WHERE occlusion_ratio <= 0.1 AND angle_of_incidence <= 80 AND distance >= 0.6 AND distance <= 6")
def prune_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.prune(det(spark, sf_dir), min_distance=0.6, max_distance=6).select("image_id", "seq", "tag_id", "distance"))


@query(f"WITH {SQL}, img AS (SELECT DISTINCT image_id FROM det), pick AS (SELECT image_id FROM img ORDER BY sha256('42:' || image_id), image_id LIMIT 25) SELECT image_id, count(*) AS n FROM det WHERE image_id IN (SELECT image_id FROM pick) GROUP BY image_id")
def prune_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.sample_images(det(spark, sf_dir), 25).groupBy("image_id").agg(F.count("*").alias("n"))


@query(f"WITH {SQL} SELECT CAST(least(19, greatest(0, floor(distance / 0.5))) AS INTEGER) AS bin, count(*) AS n FROM det GROUP BY 1")
def hist_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.histogram(det(spark, sf_dir), "distance", 0.0, 0.5, 20)


@query(f"WITH {SQL} SELECT seq, {TURN} <= 0 AND record_type = 'TAG' AS chirality, round((x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2 + x3 * y4 - x4 * y3 + x4 * y1 - x1 * y4) / 2, 4) AS area, CASE WHEN (x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2 + x3 * y4 - x4 * y3 + x4 * y1 - x1 * y4) / 2 > 1e-6 THEN 'cw' ELSE 'ccw' END AS winding FROM det")
def winding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det(spark, sf_dir)
    return rows.select("seq", audit.chirality_fails().alias("chirality"), F.round(g.polygon_area(F.col("corners")), 4).alias("area"), r.order_of(F.col("corners")).alias("winding"))


@query(f"WITH {SQL}, m AS (SELECT *, min(seq) OVER (PARTITION BY image_id, tag_id, record_type) AS first, row_number() OVER (PARTITION BY image_id, tag_id, record_type ORDER BY seq DESC) AS rn FROM det) SELECT s.seq, s.image_id, s.tag_id, round(m.distance, 6) AS distance, m.angle_of_incidence FROM det s LEFT JOIN (SELECT * FROM m WHERE rn = 1 AND seq % 3 = 0) m ON s.image_id = m.image_id AND s.tag_id = m.tag_id AND s.record_type = m.record_type")
def hydrate_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det(spark, sf_dir)
    last = relate.last_wins(rows.select(*relate.HYDRATION_KEY, "distance", "angle_of_incidence", "seq"), relate.HYDRATION_KEY).where("seq % 3 = 0")
    return rounded(relate.hydrate(rows.select("seq", *relate.HYDRATION_KEY), last, ["distance", "angle_of_incidence"]).select("seq", "image_id", "tag_id", "distance", "angle_of_incidence"))


@query(f"WITH {SQL} SELECT seq, image_id FROM det WHERE image_id IN (SELECT image_id FROM det WHERE seq % 7 = 0)")
def semi_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det(spark, sf_dir)
    return relate.present(rows, rows.where("seq % 7 = 0")).select("seq", "image_id")


@query("SELECT o_orderkey AS scene_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def anti_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scene_id"))
    return relate.remaining(wanted, read(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("scene_id")))


@query("WITH t AS (SELECT count(*) AS n FROM customer), e AS (SELECT s AS shard, CASE WHEN s = (SELECT (n + 63) // 64 - 1 FROM t) THEN (SELECT n - ((n + 63) // 64 - 1) * 64 FROM t) ELSE 64 END AS expected FROM (SELECT unnest(range((SELECT (n + 63) // 64 FROM t))) AS s)), f AS (SELECT c_custkey // 64 AS shard, count(*) AS found FROM customer WHERE c_custkey % 11 <> 0 OR c_custkey // 64 % 2 = 0 GROUP BY 1) SELECT e.shard, CAST(e.expected AS BIGINT) AS expected, CAST(coalesce(f.found, 0) AS BIGINT) AS found FROM e LEFT JOIN f ON e.shard = f.shard WHERE f.found IS NULL OR f.found <> e.expected")
def missing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer")
    total = rows.count()
    there = relate.shard_plan(rows.withColumnRenamed("c_custkey", "scene_id"), 64).where("scene_id % 11 <> 0 or shard % 2 = 0")
    return relate.missing_shards(there.groupBy("shard").agg(F.count("*").alias("n")), total, 64)


BOXES = "SELECT image_id, seq, cx - h AS x, cy - h AS y, 2 * h AS w FROM det"
PAIRS_SQL = f"WITH {SQL}, b AS ({BOXES}), p AS (SELECT a.image_id, a.seq AS a, b.seq AS b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.w, b.y + b.w) - greatest(a.y, b.y)) AS i, a.w * a.w + b.w * b.w AS s FROM b a JOIN b ON a.image_id = b.image_id AND a.seq < b.seq), o AS (SELECT image_id, a, b, round(i / (s - i), 6) AS iou FROM p WHERE i / (s - i) > 0.5)"


def boxes(rows: DataFrame) -> DataFrame:
    return rows.select("image_id", "seq", (F.col("cx") - F.col("h")).alias("x"), (F.col("cy") - F.col("h")).alias("y"), (2 * F.col("h")).alias("w"), (2 * F.col("h")).alias("h"))


@query(f"{PAIRS_SQL} SELECT * FROM o")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relate.overlap_pairs(boxes(det(spark, sf_dir))))


OUT = "CASE WHEN (cx - h) / 1920 < -1e-6 OR (cy - h) / 1080 < -1e-6 OR (cx + h) / 1920 > 1 + 1e-6 OR (cy + h) / 1080 > 1 + 1e-6 THEN true ELSE false END"
POINTS_IN_MARGIN = " + ".join(f"CASE WHEN seq % 71 = 0 OR {IN.format(x=f'x{i}', y=f'y{i}')} THEN 0 ELSE 1 END" for i in range(1, 5))
TAGS_SQL = f"{PAIRS_SQL}, t AS (SELECT image_id, bool_or({OUT}) AS out_of_bounds, bool_or(h > 60 AND (2 * h / 1920) * (2 * h / 1080) < 0.01) AS scale_drift, sum({POINTS_IN_MARGIN}) > 0 AS edge_case FROM det GROUP BY image_id) SELECT t.image_id, out_of_bounds, scale_drift, coalesce(o.image_id IS NOT NULL, false) AS overlap, edge_case FROM t LEFT JOIN (SELECT DISTINCT image_id FROM o) o ON t.image_id = o.image_id"


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det(spark, sf_dir)
    h = F.col("h")
    share = F.array((F.col("cx") - h) / WIDTH, (F.col("cy") - h) / HEIGHT, 2 * h / WIDTH, 2 * h / HEIGHT)
    marked = rows.select("image_id", r.out_of_bounds(share).alias("out_of_bounds"), ((h > 60) & (F.get(share, F.lit(2)) * F.get(share, F.lit(3)) < 0.01)).alias("scale_drift"), F.size(F.filter("corners_visibility", lambda v: v == r.MARGIN)).alias("margin_points"))
    return relate.image_tags(marked, relate.overlap_pairs(boxes(rows)))


@query(TAGS_SQL)
def image_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir)


@query(f"SELECT * FROM ({TAGS_SQL}) WHERE out_of_bounds OR scale_drift OR overlap")
def view_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.anomalies(tagged(spark, sf_dir))


@query(f"WITH {SQL} SELECT seq, image_id FROM det WHERE seq % 71 = 0 OR ({' AND '.join(IN.format(x=f'x{i}', y=f'y{i}') for i in range(1, 5))})")
def view_eval_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det(spark, sf_dir).where(F.forall("corners_visibility", lambda v: v == r.VISIBLE)).select("seq", "image_id")


@query(f"WITH {SQL} SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY seq) - 1 AS INTEGER) AS pos, tag_id, tag_family, round(distance, 6) AS distance FROM det")
def nest_unnest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["tag_id", "tag_family", "distance"]
    return rounded(relate.unnest(relate.nest(det(spark, sf_dir), fields), fields))


@query("SELECT CAST(n AS BIGINT) AS ordinal, 'v' || lpad(CAST(n AS VARCHAR), 3, '0') AS variant_id, 'camera.fov=' || CAST(40 + 10 * (n // 6) AS VARCHAR) || '.0, scene.mode=' || ['plain', 'cb', 'aprilgrid'][n // 2 % 3 + 1] || ', dataset.n=' || [5, 10][n % 2 + 1] AS description, CAST(42 + n * 100 AS BIGINT) AS layout_seed, CAST(42 + n * 300 AS BIGINT) AS camera_seed FROM (SELECT unnest(range(24)) AS n)")
def sweep_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = [("camera.fov", sweep.linear(40.0, 70.0, step=10.0)), ("scene.mode", ["plain", "cb", "aprilgrid"]), ("dataset.n", [5, 10])]
    return sweep.variants(spark, axes, unlocked=("layout", "camera")).select("ordinal", "variant_id", "description", "layout_seed", "camera_seed")


@query("SELECT CAST(0 AS BIGINT) AS place, 'base' AS name UNION ALL SELECT CAST(1 + n AS BIGINT), 'res__camera_resolution-' || ['640x480', '1p5'][n // 2 + 1] || '__camera_iso-' || [100, 800][n % 2 + 1] FROM (SELECT unnest(range(4)) AS n)")
def campaign_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.campaign(spark, [("base", {"a": 1})], [("res", [("camera.resolution", ["640x480", "1.5"]), ("camera.iso", [100, 800])])]).select("place", "name")


@query("SELECT n_nationkey, n_name, CAST('0x' || substr(sha256('42:' || n_name || ':' || CAST(n_nationkey AS VARCHAR)), 1, 8) AS BIGINT) & 2147483647 AS seed, CAST('0x' || substr(sha256('42:' || CAST(n_nationkey AS VARCHAR)), 1, 8) AS BIGINT) AS shard_seed FROM nation")
def derive_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select("n_nationkey", "n_name", r.derive_seed(F.lit(42), F.col("n_name"), key).alias("seed"), r.shard_seed(F.lit(42), key).alias("shard_seed"))


COCO_SQL = """WITH img AS (SELECT CAST(user_id % 12 AS VARCHAR) AS shard, event_id AS id FROM events WHERE event_id % 5 = 0),
    ann AS (SELECT CAST(user_id % 12 AS VARCHAR) AS shard, event_id AS id, event_id - event_id % 5 AS image_id, 1 + event_id % 3 AS category_id FROM events),
    io AS (SELECT shard, coalesce(sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM (SELECT shard, max(id) + 1 AS n FROM img GROUP BY shard)),
    ao AS (SELECT shard, coalesce(sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM (SELECT shard, max(id) + 1 AS n FROM ann GROUP BY shard))
    SELECT CAST(a.id + ao.o AS BIGINT) AS id, CAST(coalesce(i.id + io.o, a.image_id) AS BIGINT) AS image_id FROM ann a JOIN ao ON a.shard = ao.shard LEFT JOIN img i ON i.shard = a.shard AND i.id = a.image_id LEFT JOIN io ON io.shard = i.shard"""


@query(COCO_SQL)
def coco_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("shard", (F.col("user_id") % 12).cast("string"))
    images = e.where("event_id % 5 = 0").select("shard", F.col("event_id").alias("id"), F.lit("x.png").alias("file_name"))
    annotations = e.select("shard", F.col("event_id").alias("id"), (F.col("event_id") - F.col("event_id") % 5).alias("image_id"), (1 + F.col("event_id") % 3).alias("category_id"))
    categories = e.select("shard", (1 + F.col("event_id") % 3).alias("id")).distinct().withColumn("name", F.concat(F.lit("c"), F.col("id").cast("string")))
    return merge.merge_coco(images, annotations, categories)[1].select("id", "image_id")


@query("SELECT shard, CAST(coalesce(sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT CAST(user_id % 12 AS VARCHAR) AS shard, max(event_id) + 1 AS n FROM events GROUP BY 1)")
def shard_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select((F.col("user_id") % 12).cast("string").alias("shard"), F.col("event_id").alias("id"))
    return merge.offsets(rows).select("shard", F.col("offset").cast("long").alias("offset"))


@query(f"WITH {SQL} SELECT image_id, row_number() OVER (ORDER BY first, image_id) AS id FROM (SELECT image_id, min(seq) AS first FROM det GROUP BY image_id)")
def surrogate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.surrogate_ids(det(spark, sf_dir), "image_id")


@query("SELECT user_id AS image_id, max(event_id) AS seed FROM events GROUP BY user_id")
def provenance_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), F.col("event_id").alias("shard"), F.col("event_id").alias("seed"))
    return merge.merge_provenance(rows).select("image_id", "seed")


TELEMETRY_SQL = "t AS (SELECT user_id AS worker_id, epoch_us(ts) / 1000000.0 AS timestamp, value AS vram, event_id FROM events)"


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("worker_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("timestamp"), F.col("value").alias("vram"), "event_id")


@query(f"WITH {TELEMETRY_SQL} SELECT worker_id, event_id, round(vram, 6) AS vram FROM (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY timestamp DESC, vram DESC, event_id DESC) AS rn FROM t) WHERE rn = 1")
def worker_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relate.latest(telemetry(spark, sf_dir)).select("worker_id", "event_id", "vram"))


@query(f"WITH {TELEMETRY_SQL}, g AS (SELECT worker_id, timestamp AS a, lead(timestamp) OVER (PARTITION BY worker_id ORDER BY timestamp) AS b FROM t) SELECT worker_id, count(*) AS gaps, round(max(b - a), 5) AS longest FROM g WHERE b - a > 10 GROUP BY worker_id")
def liveness_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relate.silences(telemetry(spark, sf_dir))
    return found.groupBy("worker_id").agg(F.count("*").alias("gaps"), F.round(F.max("silence"), 5).alias("longest"))


@query(f"WITH {TELEMETRY_SQL} SELECT round(max(timestamp) - min(timestamp), 5) AS duration, count(*) AS events, round(avg(vram), 4) AS mean_vram, round(max(vram), 4) AS max_vram FROM t")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.throughput(telemetry(spark, sf_dir)).select(F.round("duration", 5).alias("duration"), "events", F.round("mean_vram", 4).alias("mean_vram"), F.round("max_vram", 4).alias("max_vram"))


@query("SELECT event_id FROM events WHERE upper(event_type) = 'CLICK' AND TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) > 50")
def log_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("level"), F.col("props").alias("payload"))
    return relate.query_logs(logs, level="click", where="k > 50", limit=None, fields={"k": "int"}).select("event_id")


@query(f"WITH {SQL} SELECT tag_family, CAST(CASE tag_family WHEN 'tag36h11' THEN 36 WHEN 'tag16h5' THEN 16 ELSE 16 END AS INTEGER) AS bits, CAST(CASE tag_family WHEN 'tag36h11' THEN 8 ELSE 6 END AS INTEGER) AS grid, CAST(CASE tag_family WHEN 'tag36h11' THEN 587 WHEN 'tag16h5' THEN 16 ELSE 50 END AS INTEGER) AS ids, count(*) AS n FROM det GROUP BY 1, 2, 3, 4")
def family_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("tag_family")
    return det(spark, sf_dir).groupBy(f, r.tag_bits(f).alias("bits"), r.tag_grid(f).alias("grid"), r.tag_id_count(f).alias("ids")).agg(F.count("*").alias("n"))


@query(f"WITH {SQL} SELECT seq, round(greatest(0, least(1920, x1)), 4) AS x1, round(greatest(0, least(1080, y1)), 4) AS y1, round(greatest(0, least(1920, x3)), 4) AS x3, round(greatest(0, least(1080, y3)), 4) AS y3 FROM det WHERE record_type = 'TAG'")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = det(spark, sf_dir).where("record_type = 'TAG'").select("seq", r.clip(F.col("corners"), F.lit(WIDTH), F.lit(HEIGHT)).alias("c"))
    at = lambda i, f: F.round(f(F.get("c", F.lit(i))), 4)
    return rows.select("seq", at(0, r.x).alias("x1"), at(0, r.y).alias("y1"), at(2, r.x).alias("x3"), at(2, r.y).alias("y3"))


@query(f"WITH {SQL} SELECT seq, cx - h AS x, cy - h AS y, 2 * h AS w, 2 * h AS h, CAST({' + '.join(f'CASE WHEN {IN.format(x=f'x{i}', y=f'y{i}')} THEN 1 ELSE 0 END' for i in range(1, 5))} AS INTEGER) AS num_keypoints, x1 AS first_x, y1 AS first_y, CASE WHEN {IN.format(x='x1', y='y1')} THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS first_v FROM det")
def coco_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, c = F.lit(WIDTH), F.lit(HEIGHT), F.col("corners")
    rows = det(spark, sf_dir).select("seq", r.bounding_box(c).alias("b"), r.num_keypoints(c, w, h, EDGE).alias("num_keypoints"), r.coco_keypoints(c, w, h, EDGE).alias("k"))
    return rows.select("seq", *(F.get("b", F.lit(i)).alias(n) for i, n in enumerate("xywh")), "num_keypoints", *(F.get("k", F.lit(i)).alias(f"first_{n}") for i, n in enumerate("xyv")))


def vec(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


@query("WITH p AS (SELECT p_partkey, p_size / 10.0 - 2 AS x, p_partkey % 17 / 8.0 - 1 AS y, 1 + p_partkey % 5 / 2.0 AS z FROM part) SELECT p_partkey, round(x / z * (1 + 0.1 * (x * x + y * y) / (z * z)) * 500 + 320 + 1e-7, 4) AS u, round(y / z * (1 + 0.1 * (x * x + y * y) / (z * z)) * 500 + 240 + 1e-7, 4) AS v, round(sqrt(x * x + y * y + z * z), 6) AS distance, round(degrees(acos(greatest(-1, least(1, z / sqrt(x * x + y * y + z * z))))), 4) AS angle, round(500 * 0.1 / (z * 8), 6) AS ppm FROM p")
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u and v are moved off exact halves of the last digit, which engines round differently."""
    key = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 10.0 - 2).alias("x"), (key % 17 / 8.0 - 1).alias("y"), (1 + key % 5 / 2.0).alias("z"))
    zero, one = F.lit(0.0), F.lit(1.0)
    k = [[F.lit(500.0), zero, F.lit(320.0)], [zero, F.lit(500.0), F.lit(240.0)], [zero, zero, one]]
    u, v = g.project(vec("x", "y", "z"), k, F.lit("brown_conrady"), F.array(F.lit(0.1), zero, zero, zero, zero))
    return rows.select("p_partkey", F.round(u + 1e-7, 4).alias("u"), F.round(v + 1e-7, 4).alias("v"), F.round(g.distance((zero, zero, zero), vec("x", "y", "z")), 6).alias("distance"), F.round(g.angle_of_incidence((zero, zero, zero), vec("x", "y", "z"), (zero, zero, one)), 4).alias("angle"), F.round(g.pixels_per_module(F.lit(500.0), F.lit(0.1), F.col("z"), F.lit(8)), 6).alias("ppm"))


BOARD_SQL = "b AS (SELECT p_partkey AS board_id, 2 + p_size % 5 AS rows, 2 + p_partkey % 4 AS cols, CASE WHEN p_partkey % 2 = 0 THEN 'charuco' ELSE 'aprilgrid' END AS type, 0.25::DOUBLE AS square_size FROM part)"


def some_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(key.alias("board_id"), (2 + F.col("p_size") % 5).cast("int").alias("rows"), (2 + key % 4).cast("int").alias("cols"), F.when(key % 2 == 0, "charuco").otherwise("aprilgrid").alias("type"), F.lit(0.25).alias("square_size"), F.lit(0.2).alias("marker_size"))


@query(f"WITH {BOARD_SQL}, s AS (SELECT b.*, r AS row, c AS col, type = 'charuco' AND (r + c) % 2 = 0 AS white FROM b, (SELECT unnest(range(10)) AS r), (SELECT unnest(range(10)) AS c) WHERE r < rows AND c < cols) SELECT board_id, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, round((col + 0.5 - cols / 2.0) * square_size, 6) AS x, round((rows / 2.0 - 0.5 - row) * square_size, 6) AS y, white, type <> 'charuco' OR white AS tagged, CAST(CASE WHEN type <> 'charuco' OR white THEN row_number() OVER (PARTITION BY board_id, type <> 'charuco' OR white ORDER BY row, col) - 1 END AS INTEGER) AS tag_id FROM s")
def board_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(boards.squares(some_boards(spark, sf_dir)))


@query(f"WITH {BOARD_SQL} SELECT board_id, c AS \"check\", true AS ok FROM b, (SELECT unnest(['white_border', 'filling', 'centred', 'dimensions', 'marker_fits']) AS c)")
def board_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = some_boards(spark, sf_dir)
    return boards.checks(rows, boards.squares(rows))


@query("SELECT CAST(i AS BIGINT) AS i, CAST((i % 5 - 2) * 0.125 AS DOUBLE) AS x, CAST((2.5 - i // 5) * 0.125 AS DOUBLE) AS y, 0.001::DOUBLE AS z FROM (SELECT unnest(range(30)) AS i)")
def grid_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(boards.grid(spark.range(30).withColumnRenamed("id", "i"), 5, 6, 0.125))


@query(f"WITH {BOARD_SQL} SELECT board_id, CAST((r * (cols - 1) + c) AS INTEGER) AS i, round((c + 1 - cols / 2.0) * 25, 6) AS x, round((rows / 2.0 - 1 - r) * 25, 6) AS y FROM b, (SELECT unnest(range(10)) AS r), (SELECT unnest(range(10)) AS c) WHERE r < rows - 1 AND c < cols - 1")
def board_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = some_boards(spark, sf_dir).select("board_id", F.posexplode(r.board_points(F.col("type"), F.col("rows"), F.col("cols"), F.lit(25.0))).alias("i", "p"))
    return rounded(rows.select("board_id", "i", r.x(F.col("p")).alias("x"), r.y(F.col("p")).alias("y")))


@query("SELECT s.s_suppkey AS a, t.s_suppkey AS b FROM supplier s JOIN supplier t ON s.s_nationkey = t.s_nationkey AND s.s_suppkey < t.s_suppkey WHERE sqrt(pow(s.s_suppkey % 50 - t.s_suppkey % 50, 2) + pow(s.s_suppkey % 7 - t.s_suppkey % 7, 2)) < 6")
def close_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select("s_nationkey", key.alias("seq"), (key % 50).cast("double").alias("x"), (key % 7).cast("double").alias("y"))
    return relate.close_pairs(rows, "s_nationkey", 6.0).select("a", "b")


@query("SELECT o_orderkey AS path, CASE WHEN o_orderkey % 5 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'tampered' ELSE 'ok' END AS status FROM orders")
def verify_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"))
    files = rows.where("path % 5 <> 0").select("path", F.when(F.col("path") % 7 == 0, F.lit("x")).otherwise(F.col("sha256")).alias("sha256"))
    return relate.verify_checksums(rows, files)


@query(f"WITH {SQL} SELECT DISTINCT tag_family, tag_id, CAST(seq % 2 AS BIGINT) AS margin_bits FROM det")
def distinct_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det(spark, sf_dir).select("tag_family", "tag_id", (F.col("seq") % 2).alias("margin_bits")).distinct()


@query(f"WITH {SQL} SELECT image_id, CAST(split_part(image_id, '_', 2) AS INTEGER) AS scene, CAST(split_part(image_id, '_', 4) AS INTEGER) AS camera, count(*) AS n FROM det GROUP BY 1, 2, 3")
def image_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = r.parse_image_id(F.col("image_id"))
    return det(spark, sf_dir).groupBy("image_id", key["scene"].alias("scene"), key["camera"].alias("camera")).agg(F.count("*").alias("n"))


from markerlake import queries_files, queries_generation, queries_geometry, queries_outlines, queries_records, queries_streaming  # noqa: E402, F401  add their queries to those above

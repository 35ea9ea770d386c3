"""Queries of record columns, boards that break their checks, and calibration pairs; they join those of queries.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerlake.functions import records as r
from markerlake.operators import boards, relate
from markerlake.plans.adapter import HEIGHT, SQL, WIDTH
from markerlake.queries import BOARD_SQL, det, query, read, rounded, some_boards


@query(f"WITH {SQL}, p AS (SELECT seq, x1, y1, CASE WHEN seq % 3 = 0 THEN x1 ELSE x2 END AS a, CASE WHEN seq % 3 = 0 THEN y1 ELSE y2 END AS b FROM det) SELECT seq, CASE WHEN a = x1 THEN x1 - 0.5 ELSE least(x1, a) END AS x, CASE WHEN b = y1 THEN y1 - 0.5 ELSE least(y1, b) END AS y, CASE WHEN a = x1 THEN 1.0::DOUBLE ELSE abs(x1 - a) END AS w, CASE WHEN b = y1 THEN 1.0::DOUBLE ELSE abs(y1 - b) END AS h FROM p")
def point_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of one point (every third detection) or of two."""
    points = F.slice("corners", 1, F.when(F.col("seq") % 3 == 0, 1).otherwise(2))
    rows = det(spark, sf_dir).select("seq", r.point_box(points).alias("b"))
    return rows.select("seq", *(F.get("b", F.lit(i)).alias(n) for i, n in enumerate("xywh")))


@query(f"WITH {SQL} SELECT seq, round(x1 / 1920, 6) AS x1, round(y1 / 1080, 6) AS y1, round(x3 / 1920, 6) AS x3, round(y3 / 1080, 6) AS y3 FROM det")
def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners in shares of the frame, through a flat list and back."""
    flat = F.flatten(r.relative_polyline(F.col("corners"), F.lit(WIDTH), F.lit(HEIGHT)))
    rows = det(spark, sf_dir).select("seq", r.pairs_of_flat(flat).alias("p"))
    return rounded(rows.select("seq", *(F.col("p")[i][j].alias(f"{'xy'[j]}{i + 1}") for i in (0, 2) for j in (0, 1))))


@query(f"WITH {BOARD_SQL}, p AS (SELECT board_id, rows, cols, CAST(unnest(range(rows * cols)) AS INTEGER) AS i FROM b) SELECT board_id, i AS a, CAST(i + 1 AS INTEGER) AS b FROM p WHERE (i + 1) % cols <> 0 UNION ALL SELECT board_id, i, CAST(i + cols AS INTEGER) FROM p WHERE i + cols < rows * cols")
def skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = some_boards(spark, sf_dir).select("board_id", F.explode(r.skeleton_edges(F.col("rows"), F.col("cols"))).alias("e"))
    return rows.select("board_id", F.col("e")[0].alias("a"), F.col("e")[1].alias("b"))


@query(f"WITH {SQL} SELECT 'scene_' || CASE WHEN user_id < 10000 THEN lpad(CAST(user_id AS VARCHAR), 4, '0') ELSE CAST(user_id AS VARCHAR) END || '_cam_000' || CAST(seq % 4 AS VARCHAR) AS name, tag_family <> 'DICT_4X4_50' AS apriltag, tag_family = 'DICT_4X4_50' AS aruco, count(*) AS n FROM det GROUP BY 1, 2, 3")
def names_and_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("tag_family")
    return det(spark, sf_dir).groupBy(r.image_id(F.col("user_id"), F.col("seq") % 4).alias("name"), r.is_apriltag(f).alias("apriltag"), r.is_aruco(f).alias("aruco")).agg(F.count("*").alias("n"))


@query(f"WITH {BOARD_SQL}, k AS (SELECT board_id, rows, cols, CAST(unnest(range(6)) AS INTEGER) AS i FROM b) SELECT 'board_' || CAST(board_id AS VARCHAR) AS image_id, i, i * 10.0::DOUBLE AS x, i * 20.0::DOUBLE + board_id % 5 AS y, round((i % (cols - 1) + 1 - cols / 2.0) * 25, 6) AS board_x, round((rows / 2.0 - 1 - i // (cols - 1)) * 25, 6) AS board_y FROM k WHERE i < (rows - 1) * (cols - 1) AND i <> board_id % 4")
def calibration_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six key points of each board, one of them a sentinel, beside the board's points; boards may have fewer."""
    key = F.col("board_id")
    point = lambda i: F.when(i == key % 4, F.array(F.lit(-1.0), F.lit(-1.0))).otherwise(F.array(i * F.lit(10.0), i * F.lit(20.0) + key % 5))
    spec = F.struct("type", "rows", "cols", F.lit(25.0).alias("square_size_mm"))
    rows = some_boards(spark, sf_dir).select(F.concat(F.lit("board_"), key.cast("string")).alias("image_id"), spec.alias("board_definition"), F.transform(F.sequence(F.lit(0), F.lit(5)), point).alias("keypoints"))
    found = relate.calibration_pairs(rows)
    at = lambda c, f: F.round(f(F.col(c)), 6)
    return found.select("image_id", "i", at("point", r.x).alias("x"), at("point", r.y).alias("y"), at("object_point", r.x).alias("board_x"), at("object_point", r.y).alias("board_y"))


@query("""WITH c AS (SELECT unnest(['white_border', 'filling', 'centred', 'dimensions', 'marker_fits']) AS "check") SELECT p_partkey AS board_id, "check",
CASE "check" WHEN 'white_border' THEN p_partkey % 6 <> 0 WHEN 'filling' THEN p_partkey % 6 > 1 WHEN 'centred' THEN p_partkey % 6 <> 2 WHEN 'dimensions' THEN p_partkey % 6 <> 3 ELSE p_partkey % 6 <> 4 END AS ok FROM part, c""")
def broken_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of six boards are broken: a square's colour, its marker, the place, the width, the marker's size."""
    kind = F.col("board_id") % 6
    corner = (F.col("row") == 0) & (F.col("col") == 0)
    rows = some_boards(spark, sf_dir).withColumn("marker_size", F.when(kind == 4, 0.3).otherwise(F.col("marker_size")))
    found = boards.squares(rows).withColumns({
        "white": F.when((kind == 0) & corner, ~F.col("white")).otherwise(F.col("white")),
        "tagged": F.when((kind == 1) & corner, ~F.col("tagged")).otherwise(F.col("tagged")),
        "x": F.when(kind == 2, F.col("x") + 0.01).when(kind == 3, F.col("x") * 1.1).otherwise(F.col("x")),
    })
    return boards.checks(rows, found)


@query("SELECT l_orderkey AS scene_id, 'warning' AS severity, 'tag ' || CAST(l_linenumber AS VARCHAR) || ' outside board' AS message FROM lineitem WHERE abs(CAST(l_quantity AS DOUBLE) / 100 - 0.02 * (l_orderkey % 3)) + 0.05 > 0.301 OR abs(l_linenumber / 20.0) + 0.05 > 0.301")
def tags_off_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers by order line, and a board for each order; a second board of the order, further on, doesn't count."""
    line = read(spark, sf_dir, "lineitem")
    tags = line.select(F.col("l_orderkey").alias("scene_id"), F.col("l_linenumber").cast("int").alias("i"), F.lit("TAG").alias("type"), (F.col("l_quantity").cast("double") / 100).alias("x"), (F.col("l_linenumber") / 20.0).alias("y"), F.lit(0.0).alias("z"), F.lit(0.05).alias("half"))
    scene = line.select(F.col("l_orderkey").alias("scene_id")).distinct()
    board = lambda i, x: scene.select("scene_id", F.lit(i).alias("i"), F.lit("BOARD").alias("type"), x.alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(0.3).alias("half"))
    return boards.scene_checks(tags.union(board(0, 0.02 * (F.col("scene_id") % 3))).union(board(99, F.lit(5.0))))


@query("SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 50")
def last_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 50 rows: the limit is the operator."""
    return relate.last_rows(read(spark, sf_dir, "events"), 50, "event_id").select("event_id", "user_id")

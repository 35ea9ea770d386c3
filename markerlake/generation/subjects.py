"""Objects of scenes: scattered markers, grids of them, and calibration boards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markerlake.functions import records
from markerlake.functions.geometry import let
from markerlake.generation import draws

TURN = 6.283185307179586
LIFT, BENEATH = 0.001, -0.005  # metres of markers above the ground, of a backing board below it
PROPERTIES = "struct<tag_id:int,tag_family:string,tag_size:double,margin_bits:int,mode:string,cols:int,rows:int,square_size:double>"
BOARD = "struct<type:string,rows:int,cols:int,marker_size:double,square_size:double,dictionary:string>"


def obj(kind: Column, name: Column, at: Column, turn: Column, scale: Column, texture: Column, material: Column, properties: dict[str, Column], board: Column | None, points: Column, calibration: Column | None = None) -> Column:
    names = ("tag_id int", "tag_family string", "tag_size double", "margin_bits int", "mode string", "cols int", "rows int", "square_size double")
    fields = [properties.get(n, F.lit(None)).cast(t).alias(n) for n, t in (x.split() for x in names)]
    none = F.lit(None)
    return F.struct(
        kind.alias("type"), name.alias("name"), at.alias("location"), turn.alias("rotation_euler"), scale.alias("scale"), texture.cast("string").alias("texture_path"),
        material.cast("struct<roughness:double,specular:double>").alias("material"), F.struct(*fields).alias("properties"), (none if board is None else board).cast(BOARD).alias("board"),
        points.cast("array<array<double>>").alias("keypoints_3d"), (none if calibration is None else calibration).cast("array<array<double>>").alias("calibration_points_3d"),
    )


def three(x: Column | float, y: Column | float, z: Column | float) -> Column:
    return F.array(*(draws.column(v).cast("double") for v in (x, y, z)))


def marker_share(family: Column, margin_bits: Column) -> Column:
    """Share of a printed marker's side that its black border spans."""
    grid = records.tag_grid(family)
    return grid / (grid + 2 * margin_bits)


def marker(job: Column, layout: Column, i: Column, at: Column, turn: Column) -> Column:
    """The i-th marker of a scene; its corners are those of the black border, in a plane from -1 to 1, top left first."""
    seed = draws.seed(layout, "tag_obj", i)

    def made(x: Column) -> Column:
        m = marker_share(x["family"], job["margin_bits"])
        corners = F.array(*(three(sx * m, sy * m, 0.0) for sx, sy in ((-1, 1), (1, 1), (1, -1), (-1, -1))))
        material = F.struct(draws.uniform(x["seed"], "roughness", job["roughness"][0], job["roughness"][1]).alias("roughness"), draws.uniform(x["seed"], "specular", job["specular"][0], job["specular"][1]).alias("specular"))
        path = F.concat(job["cache"], F.lit("/cache/tags/"), x["family"], F.lit("_"), x["id"].cast("string"), F.lit("_m"), job["margin_bits"].cast("string"), F.lit(".png"))
        props = {"tag_id": x["id"], "tag_family": x["family"], "tag_size": job["size_mm"] / 1000, "margin_bits": job["margin_bits"]}
        return obj(F.lit("TAG"), F.concat(F.lit("Tag_"), i.cast("string")), at, turn, three(1, 1, 1), path, material, props, None, corners)

    picked = let(F.struct(seed.alias("seed")), lambda s: F.struct(s["seed"].alias("seed"), draws.choice(s["seed"], "family", job["families"]).alias("family")))
    return let(let(picked, lambda s: F.struct(s["seed"].alias("seed"), s["family"].alias("family"), draws.integer(s["seed"], "id", 0, records.tag_id_count(s["family"]) - 1).alias("id"))), made)


def markers(job: Column, scene_seed: Column) -> Column:
    """A grid of markers about the origin, moved aside together in random mode, with a backing board if asked; or markers
    in flight, each at its own place."""
    layout, size = draws.seed(scene_seed, "layout"), job["size_mm"] / 1000
    n = draws.integer(layout, "count", job["tags"][0], job["tags"][1])

    def laid(x: Column) -> Column:
        n, seed = x["n"], x["layout"]
        cols = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))
        rows = F.ceil(n / cols).cast("int")
        cell = size * (1 + job["spacing_bits"] / records.tag_grid(job["families"][0]))
        r = job["scatter_radius"]
        aside = [F.when(job["sampling_mode"] == "random", draws.uniform(seed, f"offset_{a}", -r / 2, r / 2)).otherwise(0.0) for a in "xy"]
        ids = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

        def grid(i: Column, g: Column) -> Column:
            x, y = (i % g["cols"] - (g["cols"] - 1) / 2) * g["cell"], ((g["rows"] - 1) / 2 - F.floor(i / g["cols"])) * g["cell"]
            return marker(job, seed, i, three(x + g["aside"][0], y + g["aside"][1], LIFT), three(0, 0, 0))

        def backing(g: Column) -> Column:
            props = {"mode": F.lit("plain"), "cols": g["cols"], "rows": g["rows"], "tag_size": size, "square_size": g["cell"]}
            return obj(F.lit("BOARD"), F.lit("Board_Background"), three(g["aside"][0], g["aside"][1], BENEATH), three(0, 0, 0), three(1, 1, 1), F.lit(None), F.lit(None), props, None, F.lit(None))

        def flight(i: Column) -> Column:
            at = three(draws.uniform(seed, "fly_x", -r, r, i), draws.uniform(seed, "fly_y", -r, r, i), draws.uniform(seed, "fly_z", 0.1, r * 2, i))
            return marker(job, seed, i, at, three(*(draws.uniform(seed, f"turn_{a}", 0.0, TURN, i) for a in "xyz")))

        shape = F.struct(cols.alias("cols"), rows.alias("rows"), cell.alias("cell"), F.array(*aside).alias("aside"))
        on_grid = let(shape, lambda g: F.concat(F.transform(ids, lambda i: grid(i, g)), F.filter(F.array(backing(g)), lambda _: job["use_board"])))
        return F.when(job["flying"], F.transform(ids, flight)).otherwise(on_grid)

    return let(F.struct(n.alias("n"), layout.alias("layout")), laid)


def board(job: Column, scene_seed: Column) -> Column:
    """One calibration board, moved a little aside: its key points are the corners of its markers, in metres from its centre."""
    b, seed, r = job["board"], draws.seed(scene_seed, "layout_offset"), job["scatter_radius"]
    square, half = F.coalesce(b["square_size"], b["marker_size"]), b["marker_size"] / 2
    cells = F.filter(F.sequence(F.lit(0), b["rows"] * b["cols"] - 1), lambda i: (b["type"] == "aprilgrid") | ((F.floor(i / b["cols"]) + i % b["cols"]) % 2 == 0))

    def corners(i: Column) -> Column:
        x, y = (i % b["cols"] + 0.5 - b["cols"] / 2) * square, (b["rows"] / 2 - 0.5 - F.floor(i / b["cols"])) * square
        return F.array(*(three(x + sx * half, y + sy * half, 0.0) for sx, sy in ((-1, 1), (1, 1), (1, -1), (-1, -1))))

    quiet = 2 * F.coalesce(b["quiet_zone"], F.lit(0.0))
    made = F.struct(b["type"].alias("type"), b["rows"].alias("rows"), b["cols"].alias("cols"), b["marker_size"].alias("marker_size"), square.alias("square_size"), b["dictionary"].alias("dictionary"))
    at = three(draws.uniform(seed, "x", -r / 2, r / 2), draws.uniform(seed, "y", -r / 2, r / 2), 0.0)
    scale = three((b["cols"] * square + quiet) / 2, (b["rows"] * square + quiet) / 2, 1.0)
    points = records.board_points(b["type"], b["rows"], b["cols"], square)
    return F.array(obj(F.lit("BOARD"), F.lit("CalibrationBoard"), at, three(0, 0, 0), scale, F.lit(None), F.lit(None), {}, made, F.flatten(F.transform(cells, corners)), points))


def objects(job: Column, scene_seed: Column) -> Column:
    return F.when((job["subject"] == "board") & job["board"].isNotNull(), board(job, scene_seed)).otherwise(markers(job, scene_seed))

"""Schemas of the relations that detection datasets consist of."""

from __future__ import annotations

BOARD = "struct<type:string,rows:int,cols:int,square_size_mm:double,marker_size_mm:double,dictionary:string,total_keypoints:int,spacing_ratio:double>"
POINTS = "array<array<double>>"
#: One detection of an object in an image. metadata stays JSON text, so that it can be compared.
DETECTION = (
    f"image_id string, tag_id bigint, tag_family string, corners {POINTS}, record_type string, keypoints {POINTS}, "
    "distance double, angle_of_incidence double, lighting_intensity double, pixel_area double, occlusion_ratio double, ppm double, "
    f"is_mirrored boolean, position array<double>, rotation_quaternion array<double>, axes map<string,{POINTS}>, tag_size_mm double, "
    f"k_matrix {POINTS}, resolution array<int>, distortion_model string, distortion_coeffs array<double>, velocity array<double>, "
    "shutter_time_ms double, rolling_shutter_ms double, fstop double, eval_margin_px int, global_seed bigint, scene_seed bigint, "
    f"metadata string, corners_visibility array<tinyint>, keypoints_visibility array<tinyint>, eval_complete boolean, board_definition {BOARD}"
)
CONTEXT = "photometric_margin_px int, truncation_policy string"
COCO_IMAGE = "id bigint, file_name string, width int, height int"
COCO_ANNOTATION = f"id bigint, image_id bigint, category_id bigint, segmentation {POINTS}, bbox array<double>, area double, keypoints array<double>, num_keypoints int, iscrowd int, attributes string"
COCO_CATEGORY = "id bigint, name string, supercategory string, keypoints array<string>, skeleton array<array<int>>"
TELEMETRY = "timestamp double, worker_id string, telemetry struct<status:string,vram_used_mb:double,vram_total_mb:double,ram_used_mb:double,cpu_usage_percent:double,state_hash:string,uptime_seconds:double,object_count:int,active_scene_id:bigint>"
LOG = "type string, level string, logger string, timestamp timestamp, message string, context string, payload string, event string"
RECIPE = (
    "scene_id bigint, world struct<background_hdri:string,texture_path:string,lights:array<struct<type:string,intensity:double>>>, "
    "objects array<struct<type:string,name:string,location:array<double>,rotation_euler:array<double>,scale:array<double>,texture_path:string,"
    "properties:struct<tag_family:string,tag_size:double,cols:int,rows:int,square_size:double>>>, "
    "cameras array<struct<transform_matrix:array<array<double>>,intrinsics:struct<resolution:array<int>,k_matrix:array<array<double>>>,min_tag_pixels:double,max_tag_pixels:double>>"
)
CHECKSUM = "path string, sha256 string"


def fields(schema: str) -> list[str]:
    """Column names of a schema text."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).names

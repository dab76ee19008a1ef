"""Declared schemas of every table that is published, and the check of a table against one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

_TYPES: dict[str, DataType] = {"string": StringType(), "bigint": LongType(), "int": IntegerType(), "float": FloatType(), "double": DoubleType(), "boolean": BooleanType(), "strings": ArrayType(StringType()), "floats": ArrayType(FloatType())}


def _schema(fields: str, required: tuple[str, ...] = ()) -> StructType:
    """A schema without a session: name and type pairs, comma-separated."""
    pairs = [f.split() for f in fields.split(",")]
    return StructType([StructField(n, _TYPES[t], n not in required) for n, t in pairs])


REVIEW = _schema(
    "image_path string, image_status string, image_width bigint, image_height bigint, num_defects bigint, primary_cluster_id bigint, review_order bigint, "
    "detection_bbox string, detection_score string, detection_bbox_cluster string, instances_json string, error_code string, error_message string, run_id string",
    ("image_path", "image_status", "num_defects"),
)
INPUT_MANIFEST = _schema(
    "image_path string, image_sha256 string, byte_size bigint, source_mode string, image_width int, image_height int, image_status string, error_code string, error_message string, warning_codes strings"
)
INSTANCES = _schema(
    "run_id string, instance_id string, instance_key string, image_path string, image_sha256 string, bbox_xmin int, bbox_ymin int, bbox_width int, bbox_height int, bbox_xyxy_float floats, "
    "detector_score float, raw_class_id int, embedding_granularity string, embedding_row bigint, embedding_status string, cluster_id int, cosine_to_centroid float, cluster_rank int, cluster_size int, warning_codes strings"
)
CLUSTER_SUMMARY = _schema("cluster_id int, cluster_size bigint, representative_instance_id string, mean_cosine_to_centroid float, min_cosine_to_centroid float, max_cosine_to_centroid float")
FAILURES = _schema("run_id string, image_path string, image_sha256 string, instance_id string, stage string, error_code string, exception_type string, sanitized_message string, retry_count int, occurred_at_utc string")
BOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
DETECTION = f"struct<bbox:{BOX},score:double,raw_class_id:int>"
_DETECTIONS = ArrayType(StructType([StructField("bbox", _schema("xmin double, ymin double, xmax double, ymax double")), StructField("score", DoubleType()), StructField("raw_class_id", IntegerType())]))
DETECTION_CACHE = StructType([*_schema("detector_signature string, image_sha256 string, image_width int, image_height int"), StructField("detections", _DETECTIONS)])
EMBEDDING_CACHE = _schema("embedding_signature string, instance_key string, vector floats")


class SchemaError(ValueError):
    pass


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``, in its order and types; unknown and missing columns are errors."""
    have, want = set(df.columns), set(schema.names)
    if have != want or len(df.columns) != len(have):
        raise SchemaError(f"unknown columns {sorted(have - want)}, missing columns {sorted(want - have)}")
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))

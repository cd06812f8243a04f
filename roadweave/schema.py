"""Table schemas.  Fragments hold one track a row (arrays of samples); detections hold one sample a row."""

from __future__ import annotations

from pyspark.sql import types as T

_DOUBLES = T.ArrayType(T.DoubleType())
_OID = T.StructType([T.StructField("$oid", T.StringType())])

SERIES = ("timestamp", "x_position", "y_position", "velocity", "length", "width", "height", "detection_confidence")

FRAGMENT = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField("direction", T.IntegerType()),
        *(T.StructField(name, _DOUBLES) for name in SERIES),
        T.StructField("first_timestamp", T.DoubleType()),
        T.StructField("last_timestamp", T.DoubleType()),
        T.StructField("starting_x", T.DoubleType()),
        T.StructField("ending_x", T.DoubleType()),
        T.StructField("gt_ids", T.ArrayType(T.ArrayType(_OID))),
        T.StructField("_source_gt_id", T.StringType()),
        T.StructField("calib_id", T.StringType()),
        T.StructField("local_fragment_id", T.StringType()),
        T.StructField("merged_ids", T.ArrayType(T.StringType())),
        T.StructField("fragment_ids", T.ArrayType(T.StringType())),
        T.StructField("coarse_vehicle_class", T.IntegerType()),
        T.StructField("compute_node_id", T.StringType()),
    ]
)

#: As files have it: the identifier is a string or an object with ``$oid``, so it is read as text.
RAW_FRAGMENT = T.StructType([*FRAGMENT.fields, T.StructField("_corrupt_record", T.StringType())])

MOT_BOX = T.StructType(
    [T.StructField(n, T.DoubleType() if i > 1 else T.LongType()) for i, n in enumerate(("frame", "id", "left", "top", "width", "height"))]
)

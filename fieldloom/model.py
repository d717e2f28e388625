"""Schemas of the tables that the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
POLYGON = T.ArrayType(POINT)
BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")])

#: Spots of one field of view; identity is explicit, rows have no order.
TRANSCRIPTS = T.StructType(
    [T.StructField("slide", T.StringType()), T.StructField("fov", T.StringType()), T.StructField("point_id", T.LongType()), T.StructField("target", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]
)
#: Outlines of nuclei or myotubes.
OBJECTS = T.StructType(
    [T.StructField("slide", T.StringType()), T.StructField("fov", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("object_idx", T.LongType())]
    + [T.StructField("patch_idx", T.IntegerType()), T.StructField("local_id", T.LongType()), T.StructField("image_name", T.StringType()), T.StructField("polygon", POLYGON), T.StructField("local_polygon", POLYGON)]
)
#: Object by gene, non-zero entries only.
COUNTS = T.StructType([T.StructField("slide", T.StringType()), T.StructField("fov", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("object_idx", T.LongType()), T.StructField("gene", T.StringType()), T.StructField("n", T.LongType())])
LINKS = T.StructType([T.StructField("slide", T.StringType()), T.StructField("fov", T.StringType()), T.StructField("nuc_idx", T.LongType()), T.StructField("myo_idx", T.LongType()), T.StructField("overlap_frac", T.DoubleType())])
CLASSIFIER = T.StructType(
    [T.StructField("slide", T.StringType()), T.StructField("field", T.StringType()), T.StructField("patch_idx", T.IntegerType()), T.StructField("cell_line", T.StringType()), T.StructField("local_id", T.IntegerType())]
    + [T.StructField("labels", T.StringType()), T.StructField("image_name", T.StringType()), T.StructField("predicted_class", T.StringType()), T.StructField("sigmoid_logits", T.DoubleType())]
)
#: No tube: the value of myotube_id and myotube_patch_idx.
UNASSIGNED = -1

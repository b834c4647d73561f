"""Row types of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

BLOCK = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("filepath", T.StringType()), T.StructField("function", T.StringType()),
    T.StructField("code", T.StringType()), T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType()),
])
STORED = T.StructType([*BLOCK.fields, T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("indexed_at", T.TimestampType()), T.StructField("project_id", T.StringType())])
LEG = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType()), T.StructField("source", T.StringType())])
FUNCTION = T.StructType([T.StructField("name", T.StringType()), T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType()), T.StructField("code", T.StringType())])
CLASS = T.StructType([*FUNCTION.fields, T.StructField("methods", T.ArrayType(FUNCTION))])
FILE = T.StructType([T.StructField("filepath", T.StringType()), T.StructField("functions", T.ArrayType(FUNCTION)), T.StructField("classes", T.ArrayType(CLASS)), T.StructField("error", T.StringType())])
